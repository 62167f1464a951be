"""Raw text feeds made out of the whole star tables, with the dirt real exports carry.

Every row of the canonical views appears as text under an export-style header; a row's key decides which spelling or fault
it gets (the moduli spread faults, they select nothing away) and some rows are written twice. The expressions are plain
SQL that Spark and DuckDB both read; only date spelling and regex groups differ per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import star
from ..sources.schema import ORD
from ..spark_tools import estimated_bytes, spread

# Bytes of the customer table whose headers make up one task of the catalogue.
CUSTOMER_BYTES = 256 << 10

_DAY = {
    "spark": {"@ISO@": "date_format({d}, 'yyyy-MM-dd')", "@US@": "date_format({d}, 'MM/dd/yyyy')",
              "@SLASH@": "date_format({d}, 'yyyy/MM/dd')", "@NAMED@": "date_format({d}, 'MMM dd, yyyy')",
              "@SHORT@": "date_format({d}, 'M/d/yy')", "@DMY@": "date_format({d}, 'dd-MMM-yy')",
              "@RFC@": "date_format({d}, 'EEE, dd MMM yyyy') || ' 00:00:00 GMT'",
              "@RFC530@": "date_format({d}, 'EEE, dd MMM yyyy') || ' 05:29:00 +0530'", "@MONTH@": "date_format({d}, 'MMMM yyyy')",
              "@JS@": "date_format({d}, 'EEE MMM dd yyyy') || ' 00:00:00 GMT+0000 (UTC)'", "@DOTS@": "date_format({d}, 'M.d.yyyy')",
              "@1@": "$1", "@2@": "$2"},
    "duckdb": {"@ISO@": "strftime({d}, '%Y-%m-%d')", "@US@": "strftime({d}, '%m/%d/%Y')",
               "@SLASH@": "strftime({d}, '%Y/%m/%d')", "@NAMED@": "strftime({d}, '%b %d, %Y')",
               "@SHORT@": "strftime({d}, '%-m/%-d/%y')", "@DMY@": "strftime({d}, '%d-%b-%y')",
               "@RFC@": "strftime({d}, '%a, %d %b %Y') || ' 00:00:00 GMT'",
               "@RFC530@": "strftime({d}, '%a, %d %b %Y') || ' 05:29:00 +0530'", "@MONTH@": "strftime({d}, '%B %Y')",
               "@JS@": "strftime({d}, '%a %b %d %Y') || ' 00:00:00 GMT+0000 (UTC)'", "@DOTS@": "strftime({d}, '%-m.%-d.%Y')",
               "@1@": "\\1", "@2@": "\\2"},
}

# per dataset: date column, header -> text expression, and the modulus of the rows that are written twice
FEEDS: dict[str, tuple[str, dict[str, str], int]] = {
    "sales": ("date", {
        "Date": "case when _ord % 101 = 0 then 'not a date' when _ord % 103 = 0 then '2025-02-30' "
                "when _ord % 29 = 3 then @SHORT@ when _ord % 29 = 5 then @DMY@ when _ord % 29 = 7 then @RFC@ "
                "when _ord % 29 = 11 then @MONTH@ when _ord % 29 = 13 then @ISO@ || ' 10:30:00+00' "
                "when _ord % 29 = 17 then @ISO@ || ' 10:30:00 UTC' when _ord % 29 = 19 then @ISO@ || ' 22:30:00 EST' "
                "when _ord % 29 = 23 then @JS@ when _ord % 29 = 25 then @RFC530@ when _ord % 29 = 27 then @DOTS@ "
                "when _ord % 6 = 1 then @US@ when _ord % 6 = 2 then @SLASH@ when _ord % 6 = 3 then @NAMED@ "
                "when _ord % 6 = 4 then @ISO@ || 'T10:30:00Z' else @ISO@ end",
        "SKU": "case when _ord % 97 = 0 then ' ' when _ord % 7 = 0 then chr(160) || sku || ' ' else sku end",
        "Product": "product",
        "Region": "case when _ord % 50 = 1 then '' else region end",
        "Channel": "case when _ord % 67 = 2 then '' else channel end",
        "Qty": "case when _ord % 89 = 0 then 'abc' when _ord % 83 = 0 then '1d' else cast(cast(units as int) as string) end",
        "Unit Price": "case when _ord % 79 = 0 then 'n/a' when _ord % 73 = 0 then '$' "
                      "when _ord % 5 = 0 then '$' || cast(unitPrice as string) else cast(unitPrice as string) end",
        "Revenue": "case when _ord % 109 = 4 then '100000000000000.00' when _ord % 109 = 8 then '0.000041' when _ord % 3 = 0 then regexp_replace(cast(revenue as string), "
                   "'^([0-9]+)([0-9]{3}[.])', '@1@,@2@') else cast(revenue as string) end",
        "Curr": "case when _ord % 61 = 0 then '' when _ord % 4 = 0 then lower(currency) else currency end",
    }, 59),
    "orders": ("orderDate", {
        "OrderID": "case when _ord % 113 = 0 then '' else orderId end",
        "Order Date": "case when _ord % 4 = 1 then @US@ when _ord % 4 = 2 then @NAMED@ else @ISO@ end",
        "CustomerID": "case when _ord % 67 = 0 then '' else customerId end",
        "Channel": "channel",
        "Region": "case when _ord % 50 = 0 then '' else region end",
        "Status": "status",
        "Total": "case when _ord % 91 = 0 then 'abc' else '$' || cast(total as string) end",
        "Curr": "currency",
    }, 53),
    "inventory": ("", {
        "SKU": "case when sku like '%0' then 'X' || sku else sku end",
        "Product Name": "productName",
        "Warehouse": "case when _ord % 43 = 0 then '' else warehouse end",
        "On Hand": "case when _ord % 107 = 0 then 'x' else cast(cast(onHand as int) as string) end",
        "Reorder Pt": "case when _ord % 33 = 0 then '' else cast(cast(reorderPoint as int) as string) end",
        "Unit Cost": "case when _ord % 71 = 0 then 'tbd' else cast(unitCost as string) end",
    }, 0),
    "returns": ("returnDate", {
        "ReturnID": "returnId",
        "OrderID": "case when _ord % 37 = 0 then orderId || 'R' else orderId end",
        "SKU": "case when _ord % 41 = 0 then 'R' || sku else sku end",
        "Return Date": "case when _ord % 5 = 1 then @US@ else @ISO@ end",
        "Reason": "case when _ord % 33 = 0 then '' else reason end",
        "Units": "cast(cast(units as int) as string)",
        "Refund": "case when _ord % 47 = 0 then '(5)' else cast(refund as string) end",
    }, 53),
}


def _cells(dataset: str, engine: str) -> dict[str, str]:
    date, cells, _ = FEEDS[dataset]
    out = {}
    for header, text in cells.items():
        for token, value in _DAY[engine].items():
            text = text.replace(token, value.format(d=date))
        out[header] = text
    return out


def raw_feed(spark: SparkSession, sf_dir: str, dataset: str, order: bool = True) -> DataFrame:
    canonical = getattr(star, dataset)(spark, sf_dir, order=True)
    cells = [f"{text} as `{header}`" for header, text in _cells(dataset, "spark").items()]
    raw = canonical.selectExpr(*cells, ORD)
    twice = FEEDS[dataset][2]
    if twice:
        copies = f"explode(case when {ORD} % {twice} = 0 then array(0, 1) else array(0) end) as copy"
        raw = raw.selectExpr("*", copies).drop("copy")
    return raw if order else raw.drop(ORD)


def raw_feed_sql(dataset: str) -> str:
    """The same feed as a DuckDB select over the canonical view."""
    cells = ", ".join(f'{text} as "{header}"' for header, text in _cells(dataset, "duckdb").items())
    base = f"select {cells}, {ORD} from v_{dataset}"
    twice = FEEDS[dataset][2]
    return base if not twice else f"{base} union all {base} where {ORD} % {twice} = 0"


# Header spellings drawn on for the feed catalogue: export headers, typos, identifier look-alikes and leftovers.
HEADER_POOLS = {
    "sales": ["Date", "Order Date", "invoice_date", "SKU", "Product Code", "Prodcut Name", "Product Name", "Item Title",
              "Ship State", "Sales Region", "Marketplace", "Qty Ordered", "Quantity", "Unit Price", "item-price", "Price",
              "sales-record-id", "item-price-total", "Total Sales", "Revenue (net)", "Curr", "Currency Code", "Notes",
              "purchase-order-number", "Revenuee", "Chanel"],
    "orders": ["OrderID", "amazon-order-id", "Order No", "Order Date", "orderedOn", "Purchase Date", "Buyer Username",
               "CustomerID", "Sales Channel", "Platform", "Ship State", "Teritory", "Order Status", "Fulfillment Status",
               "Grand Total", "Amount Paid", "total-code", "Currency", "Curency", "Gift Message", "Status"],
    "inventory": ["SKU", "ASIN", "Item SKU", "Product Name", "Description", "Location", "Warehouse", "DC", "On Hand",
                  "Available Qty", "Stock Qty", "Reorder Pt", "Reorder Level", "Safty Stock", "Unit Cost", "Cost Price",
                  "Price", "Bin Number", "COGS"],
    "returns": ["ReturnID", "RMA Number", "OrderID", "Order Number", "SKU", "Item ID", "Return Date", "Refund Date",
                "Retrun Date", "Reason", "Reason for Return", "Units Returned", "Qty", "Refund Amount", "Refund Total",
                "Currency", "Handler", "refund-code"],
}


def header_catalogue_sql(engine: str) -> str:
    """One feed per customer, each with six to twelve headers out of the pool of its dataset."""
    names = list(HEADER_POOLS)
    arms = []
    for i, dataset in enumerate(names):
        items = ", ".join(f"'{h}'" for h in HEADER_POOLS[dataset])
        n = len(HEADER_POOLS[dataset])
        at = f"cast((c_custkey * 7 + j * (3 + c_custkey % 5) + j * j) % {n} as int)"
        pick = f"array({items})[{at}]" if engine == "spark" else f"[{items}][{at} + 1]"
        arms.append(f"when {i} then {pick}")
    dataset = "case c_custkey % 4 " + " ".join(f"when {i} then '{d}'" for i, d in enumerate(names)) + " end"
    header = "case c_custkey % 4 " + " ".join(arms) + " end"
    last = "cast(5 + c_custkey % 7 as int)"
    series = (f"lateral view explode(sequence(0, {last})) s as j" if engine == "spark"
              else f", lateral (select unnest(range(0, {last} + 1)) as j) s")
    return (f"select cast(c_custkey as string) as feed, {dataset} as dataset, cast(j as int) as header_ord, "
            f"{header} as header from customer {series}")


def header_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = star.table(spark, sf_dir, "customer")
    # a small file becomes many headers: it is dealt out before, so that no task gathers those of a whole file
    dealt = spread(customers.select("c_custkey"), estimated_bytes(customers), CUSTOMER_BYTES)
    return spark.sql(header_catalogue_sql("spark").replace("from customer", "from {customer}"), customer=dealt)
