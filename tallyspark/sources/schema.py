"""Canonical schemas: target fields of the four datasets, their labels, types and header aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ORD = "_ord"
UNKNOWN = "Unknown"
MONEY = T.DecimalType(38, 10)


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    kind: str  # "string", "number", "money" or "date"
    required: bool
    aliases: tuple[str, ...]

    @property
    def spark_type(self) -> T.DataType:
        return {"string": T.StringType(), "number": T.DoubleType(), "money": MONEY, "date": T.DateType()}[self.kind]


# Canonical field keys, labels and the normalised header spellings each one accepts.
FIELDS: dict[str, tuple[Field, ...]] = {
    "sales": (
        Field("date", "Date", "date", True,
              ("date", "saledate", "transactiondate", "purchasedate", "dateofsale", "invoicedate", "orderdate")),
        Field("sku", "SKU", "string", True, ("sku", "productsku", "itemsku", "productcode", "asin", "itemid", "productid")),
        Field("product", "Product", "string", False,
              ("product", "productname", "itemname", "description", "producttitle", "itemtitle", "title")),
        Field("region", "Region", "string", False,
              ("region", "salesregion", "territory", "shipstate", "state", "market", "country")),
        Field("channel", "Channel", "string", False, ("channel", "saleschannel", "marketplace", "platform")),
        Field("units", "Units", "number", True, ("units", "unitssold", "qty", "quantity", "qtyordered", "unitsordered")),
        Field("unitPrice", "Unit price", "money", False,
              ("unitprice", "price", "priceperunit", "itemprice", "saleprice", "soldfor")),
        Field("revenue", "Revenue", "money", True,
              ("revenue", "sales", "amount", "total", "netrevenue", "itemtotal", "linetotal", "grosssales")),
        Field("currency", "Currency", "string", False, ("currency", "currencycode", "curr")),
    ),
    "orders": (
        Field("orderId", "Order ID", "string", True, ("orderid", "order", "orderno", "ordernumber", "transactionid")),
        Field("orderDate", "Order date", "date", True,
              ("orderdate", "date", "purchasedate", "dateoforder", "orderedon", "saledate")),
        Field("customerId", "Customer ID", "string", False,
              ("customerid", "custid", "customer", "buyerid", "buyerusername", "buyername")),
        Field("channel", "Channel", "string", False, ("channel", "saleschannel", "marketplace", "platform")),
        Field("region", "Region", "string", False, ("region", "territory", "shipstate", "state", "country")),
        Field("status", "Status", "string", False, ("status", "orderstatus", "shipmentstatus", "fulfillmentstatus")),
        Field("total", "Order total", "money", True, ("total", "ordertotal", "amount", "revenue", "grandtotal", "amountpaid")),
        Field("currency", "Currency", "string", False, ("currency", "currencycode", "curr")),
    ),
    "inventory": (
        Field("sku", "SKU", "string", True, ("sku", "productsku", "itemsku", "asin", "itemid", "productid")),
        Field("productName", "Product name", "string", False,
              ("productname", "product", "itemname", "description", "producttitle", "itemtitle", "title")),
        Field("warehouse", "Warehouse", "string", False,
              ("warehouse", "location", "dc", "distributioncenter", "fulfillmentcenter")),
        Field("onHand", "On-hand units", "number", True,
              ("onhand", "onhandunits", "quantity", "stock", "unitsonhand", "quantityavailable", "availableqty", "stockqty")),
        Field("reorderPoint", "Reorder point", "number", False,
              ("reorderpoint", "reorderpt", "reorderlevel", "minstock", "reorderthreshold", "safetystock")),
        Field("unitCost", "Unit cost", "money", False, ("unitcost", "cost", "costperunit", "costprice", "cogs")),
    ),
    "returns": (
        Field("returnId", "Return ID", "string", False,
              ("returnid", "rmaid", "returnno", "rmanumber", "returnnumber", "claimid")),
        Field("orderId", "Order ID", "string", False, ("orderid", "order", "ordernumber", "transactionid")),
        Field("sku", "SKU", "string", True, ("sku", "productsku", "itemsku", "asin", "itemid", "productid")),
        Field("returnDate", "Return date", "date", True, ("returndate", "date", "dateofreturn", "refunddate")),
        Field("reason", "Reason", "string", False, ("reason", "returnreason", "reasonforreturn")),
        Field("units", "Units returned", "number", True, ("units", "unitsreturned", "qty", "quantity", "quantityreturned")),
        Field("refund", "Refund amount", "money", False, ("refund", "refundamount", "amount", "amountrefunded", "refundtotal")),
        Field("currency", "Currency", "string", False, ("currency", "currencycode", "curr")),
    ),
}

# Display names of the datasets and the date column each one is filtered by.
DATASET_LABELS = {"sales": "Sales", "orders": "Orders", "inventory": "Inventory", "returns": "Returns"}
DATE_COLUMN = {"sales": "date", "orders": "orderDate", "returns": "returnDate"}


def canonical_schema(dataset: str) -> T.StructType:
    """Spark schema of a cleaned dataset; label, required flag and aliases travel as field metadata."""
    fields = [
        T.StructField(f.key, f.spark_type, not f.required,
                      {"label": f.label, "required": f.required, "aliases": list(f.aliases)})
        for f in FIELDS[dataset]
    ]
    return T.StructType([*fields, T.StructField(ORD, T.LongType(), False)])
