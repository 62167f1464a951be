"""Header mapping, de-duplication, coercion, counts, blank warnings and feed reading."""

import datetime as dt

import pytest

from tallyspark.operators import cleaning, mapping
from tallyspark.sources import feeds, sinks
from tallyspark.sources.schema import FIELDS, canonical_schema
from tallyspark.sources.synthetic import RAW_HEADERS

EXPORT_HEADERS = {name: list(headers.values()) for name, headers in RAW_HEADERS.items()}


@pytest.mark.parametrize("dataset", list(EXPORT_HEADERS))
def test_export_headers_map_exactly(spark, dataset):
    got = mapping.map_headers(spark, dataset, EXPORT_HEADERS[dataset])
    want = [f.key for f in FIELDS[dataset] if f.key != "currency"]
    assert {k: v for k, v in got.items() if v} == dict(zip(want, EXPORT_HEADERS[dataset]))


def test_mapping_traps(spark):
    # an identifier column must not become revenue; the real total is found by its ending
    got = mapping.map_headers(spark, "sales", ["sales-record-id", "Unit Price", "item-price-total"])
    assert got["revenue"] == "item-price-total" and got["unitPrice"] == "Unit Price"
    # unit price comes first in field order and takes the header that contains its alias
    assert mapping.map_headers(spark, "sales", ["sales-record-id", "item-price-total"])["unitPrice"] == "item-price-total"
    # only header-contains-alias counts: a price is not a cost price
    assert mapping.map_headers(spark, "inventory", ["SKU", "Price"])["unitCost"] is None
    # typos are close enough
    assert mapping.map_headers(spark, "sales", ["Prodcut Name"])["product"] == "Prodcut Name"
    # an exact alias may be identifier-shaped
    assert mapping.map_headers(spark, "orders", ["Order Number"])["orderId"] == "Order Number"


def test_overrides(spark):
    got = mapping.map_headers(spark, "sales", ["A", "SKU", "Qty"], {"revenue": "A", "unitPrice": "A", "sku": None})
    assert (got["revenue"], got["unitPrice"], got["sku"], got["units"]) == ("A", "A", None, "Qty")


def _catalogue(spark, headers, dataset="sales"):
    return spark.createDataFrame([("f", dataset, i, h) for i, h in enumerate(headers)],
                                 "feed string, dataset string, header_ord int, header string")


def test_wide_feed_with_many_rivals(spark):
    # dozens of headers suit the same fields; the greedy order must still hold
    headers = [f"date {i:02d}" for i in range(40)] + ["Date", "SKU", "sku 2", "Qty", "Total"]
    catalogue = _catalogue(spark, headers)
    got = {r["field"]: (r["header"], r["match_type"]) for r in mapping.assign_headers(catalogue).collect()}
    assert got["date"] == ("Date", "exact")
    assert got["revenue"] == ("Total", "exact")
    assert got["channel"] == (None, "none")


def test_one_feed_name_under_two_datasets(spark):
    rows = [("f", "sales", 0, "Date"), ("f", "sales", 1, "SKU"), ("f", "inventory", 0, "Item SKU"), ("f", "inventory", 1, "On Hand")]
    catalogue = spark.createDataFrame(rows, "feed string, dataset string, header_ord int, header string")
    got = {(r["dataset"], r["field"]): r["header"] for r in mapping.assign_headers(catalogue).collect()}
    assert (got["sales", "sku"], got["inventory", "sku"], got["sales", "date"]) == ("SKU", "Item SKU", "Date")
    pins = spark.createDataFrame([("f", "nonsense", "SKU"), (None, None, None)], "feed string, field string, header string")
    assert {(r["dataset"], r["field"]): r["header"] for r in mapping.assign_headers(catalogue, pins).collect()} == got


def test_mapping_report(spark):
    catalogue = _catalogue(spark, ["Date", "Notes", "Qty"])
    report = mapping.mapping_report(catalogue, mapping.assign_headers(catalogue))
    assert {(r["issue"], r["name"]) for r in report.collect()} == {
        ("unmapped header", "Notes"), ("missing required field", "SKU"), ("missing required field", "Revenue")}


def _raw(spark, rows):
    names = ["Date", "SKU", "Region", "Qty", "Unit Price", "Revenue"]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                 ", ".join(f"`{n}` string" for n in names) + ", _ord bigint")


def test_clean_counts_every_fix(spark):
    raw = _raw(spark, [
        ("2025-01-01", "A", "East", "2", "$1,000", "2000"),
        ("2025-01-01", "A", "East", "2", "$1,000", "2000"),  # copy
        ("2025-01-01", "A ", "East", "2", "$1,000", "2000"),  # other text: not a copy, but the same row once trimmed
        ("2025-01-02", "B", "", "1", "n/a", "5"),  # blank region, bad price
        ("2025-01-03", "C", "", "x", "n/a", "5"),  # bad required number: dropped, its fixes still count
        ("2025-02-30", "C", "West", "1", "", "5"),  # impossible day: dropped
        ("2025-01-04", " ", "West", "1", "1", "5"),  # blank SKU: dropped
    ])
    got = cleaning.clean(raw, "sales")
    assert got.mapping["currency"] is None
    counts = got.counts.first().asDict()
    # product, channel and currency are not mapped: one null each for all six distinct rows
    assert counts == {"dataset": "sales", "total_raw_rows": 7, "duplicates_removed": 1, "nulls_handled": 18 + 3,
                      "rows_dropped": 3, "type_mismatches": 2, "clean_rows": 3}
    rows = got.rows.orderBy("_ord").collect()
    assert [r["_ord"] for r in rows] == [0, 2, 3]
    assert rows[0]["date"] == dt.date(2025, 1, 1) and float(rows[0]["unitPrice"]) == 1000
    assert (rows[2]["region"], float(rows[2]["unitPrice"]), rows[2]["currency"]) == ("Unknown", 0.0, "Unknown")
    assert counts["clean_rows"] + counts["rows_dropped"] + counts["duplicates_removed"] == counts["total_raw_rows"]


def test_staged_clean_is_the_same(spark):
    raw = _raw(spark, [("2025-01-01", "A", "East", "2", "1", "2")] * 3)
    got = cleaning.clean(raw, "sales", stage=True)
    assert got.rows.count() == 1 and got.counts.first()["duplicates_removed"] == 2


def test_canonical_types(spark):
    rows = cleaning.clean(_raw(spark, [("2025-01-01", "A", "East", "2", "1", "2")]), "sales").rows
    want = [(f.name, f.dataType) for f in canonical_schema("sales").fields]
    assert [(f.name, f.dataType) for f in rows.schema.fields] == want


def test_blank_warning_samples_in_file_order(spark):
    rows = [("2025-01-01", "", "r", "1", "1", str(i)) for i in range(3)]
    rows += [("2025-01-01", "A", "r", "1", "1", str(i)) for i in range(3, 400)]
    deduped = cleaning.dedupe(_raw(spark, rows))
    fields = {"sku": "SKU", "revenue": "Revenue"}
    got = cleaning.required_blank_warning(deduped, "sales", fields, sample=200).collect()
    assert [(r["field"], r["blank"], r["sampled"]) for r in got] == [("sku", 3, 200)]
    assert got[0]["warning"] == "Blank in 3 of 200 sampled rows — those rows will be dropped."
    assert cleaning.required_blank_warning(deduped, "sales", fields).first()["sampled"] == 400
    assert cleaning.required_blank_warning(deduped, "sales", fields, sample=3).first()["warning"] == (
        "Blank in all 3 sampled rows — matching rows will be dropped.")


def test_read_csv(spark, tmp_path):
    path = tmp_path / "Feed.CSV"
    path.write_text('﻿ Date ,SKU,Note\n2025-01-01,A,"say ""hi"", ok"\n\n2025-01-02,B,\n', encoding="utf8")
    df = feeds.read_feed(spark, str(path))
    assert df.columns == ["Date", "SKU", "Note", "_ord"]
    assert [tuple(r)[:3] for r in df.orderBy("_ord").collect()] == [
        ("2025-01-01", "A", 'say "hi", ok'), ("2025-01-02", "B", "")]


def test_order_follows_the_file(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("n\n" + "\n".join(str(i) for i in range(50_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = feeds.read_feed(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert [int(r["n"]) for r in df.orderBy("_ord").collect()] == list(range(50_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_breaks_in_cells(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n"one\ntwo",2\n')
    assert feeds.read_feed(spark, str(path), multiline=True).first()["a"] == "one\ntwo"


def test_unsupported_suffix(spark):
    with pytest.raises(ValueError, match="Unsupported file type: .xlsx"):
        feeds.read_feed(spark, "/tmp/a.XLSX")


def test_header_catalogue_of_open_feeds(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Date,SKU\n2025-01-01,A\n")
    catalogue = feeds.header_catalogue({"mine": ("sales", feeds.read_feed(spark, str(path)))})
    assert [tuple(r) for r in catalogue.collect()] == [("mine", "sales", 0, "Date"), ("mine", "sales", 1, "SKU")]


@pytest.mark.parametrize("fmt", sinks.WRITERS)
def test_bundles_are_read_by_their_manifest(spark, tmp_path, fmt):
    path = str(tmp_path / "b")
    lines = spark.createDataFrame([(1, 'say "hi",\nyou', 0.5), (2, None, None)], "n int, note string, x double")
    sinks.write_bundle({"a": lines, "none": lines.where("false")}, path, fmt)
    back = sinks.read_bundle(spark, path)
    assert sorted(map(tuple, back["a"].collect())) == sorted(map(tuple, lines.collect())) and back["none"].count() == 0
    assert [(r["section"], r["n_rows"]) for r in sinks.read_manifest(spark, path)] == [("a", 2), ("none", 0)]
    lines.limit(1).write.format(fmt).mode("append").save(f"{path}/a")
    with pytest.raises(ValueError, match="not what its manifest lists"):
        sinks.read_bundle(spark, path)
    (tmp_path / "b" / "manifest" / "_SUCCESS").rename(tmp_path / "b" / "manifest" / "_LATER")
    with pytest.raises(ValueError, match="no finished bundle"):
        sinks.read_bundle(spark, path)
    with pytest.raises(ValueError, match="no finished bundle"):
        sinks.read_bundle(spark, str(tmp_path / "nowhere"))


def test_bundle_skips_empty_feeds_only(spark, tmp_path):
    full, empty = spark.range(3), spark.range(0)
    path = sinks.bundle_path(str(tmp_path), "Jun 2026")
    written = sinks.write_bundle({"a": full, "b": empty, "dataset_c": empty, "dataset_d": full}, path, "json")
    assert list(written) == ["a", "b", "dataset_d"] and path.endswith("business-report-jun-2026")
    assert spark.read.json(written["a"]).count() == 3
