"""Detail records and the enrichment join."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from loomcat.functions.details import detail_records
from loomcat.operators.dedup import first_per_key, last_per_key, top_per_key
from loomcat.operators.enrich import (
    detail_requests,
    enrich_products,
    enriched_count,
    request_manifest,
)
from loomcat.schemas import PRODUCT_B, PRODUCT_B_ENRICHED

AS_OF = date(2026, 12, 5)


def records(spark, *bodies):
    rows = [(f"S{i}_RED", 1, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    captures = spark.createDataFrame(rows, "sku string, seq bigint, body string")
    out = detail_records(captures, "https://b", F.lit(AS_OF)).collect()
    return sorted(out, key=lambda r: int(r["sku"][1:].split("_")[0]))


UNUSABLE = [
    None,
    "",
    "{broken",
    "[1]",
    "7",
    {"product": None},
    {"product": {"custom": None}},
    {"product": {"images": None}},
    {"product": {"variationAttributes": None}},
    {"product": {"gtmData": None}},
    {"product": {"price": {"sales": {"value": None}}}},
    {"product": {"price": {"list": {"value": "soon"}}}},
    {"product": {"images": {"small": [], "large": None}}},
    {"product": {"images": {"other": [{"url": "/a"}, None]}}},
    {"product": {"variationAttributes": [None]}},
    {"product": {"variationAttributes": [{"id": "color", "values": None}]}},
    {"product": {"variationAttributes": [{"id": "size", "values": [{"displayValue": "1"}, None]}]}},
]
USABLE = [
    {},
    {"product": {}},
    {"product": {"price": None}},
    {"product": {"price": {"sales": None, "list": {}}}},
    {"product": {"productName": 'says "custom": null', "other": {"custom": None}}},
    {"product": {"images": {"large": [{"url": None}]}, "variationAttributes": [{"id": "fit", "values": None}, {"id": "size"}]}},
]


def test_usable_records(spark):
    assert [r["usable"] for r in records(spark, *UNUSABLE)] == [False] * len(UNUSABLE)
    assert [r["usable"] for r in records(spark, *USABLE)] == [True] * len(USABLE)


def test_defaults_of_an_empty_document(spark):
    row = records(spark, {})[0]
    assert (row["name"], row["category"], row["rating"], row["is_new"]) == ("", "", 0.0, False)
    assert (row["colors"], row["sizes"], row["images"], row["in_stock"]) == ([], [], [], False)
    assert row["collection"] == "Collection"
    assert row["launch_time"] == "2026-12"
    assert row["short_description"] is None
    assert row["raw_data"] == "{}"


def test_full_record(spark):
    body = {
        "product": {
            "images": {"small": [{"url": "/s/1.jpg?w"}], "large": [{"url": "/l/1.jpg"}]},
            "variationAttributes": [
                {"id": "color", "values": [{"displayValue": "Red"}, {}]},
                {"id": "size", "values": [{"displayValue": "008"}]},
                {"id": "size", "values": [{"displayValue": "3PC"}, {"displayValue": "010"}]},
            ],
            "custom": {"material": "A | B", "launch": "09. SEPTEMBER", "season_attribute": "FESTIVE"},
            "price": {"sales": {"value": 3990}, "list": {"value": 4990.0}},
            "available": True,
            "availableStatus": "OUT_OF_STOCK",
            "maxOrderQuantity": 7,
            "isNew": True,
            "productName": "RTW Kurta",
            "rating": 4,
            "gtmData": {"category": "x"},
        }
    }
    row = records(spark, body)[0]
    assert row["images"] == ["https://b/l/1.jpg"]
    assert row["colors"] == ["Red", ""]
    assert row["sizes"] == ["3PC", "10"]
    assert row["fabric_details"]["material"] == "A | B"
    assert (row["price_current"], row["price_original"]) == (3990.0, 4990.0)
    assert (row["discount_percentage"], row["is_sale"]) == (20.04, True)
    assert (row["in_stock"], row["remaining_stock"], row["rating"]) == (False, 7, 4.0)
    assert row["category"] == "Ready to Wear"
    assert row["collection"] == "Fall 2026"
    assert row["launch_time"] == "2026-09"
    assert row["metadata"]["product_name"] == "RTW Kurta"


def product(sku, name="Blue Shirt", category="Listed", colors=("Red",), kind="Shirt", url=None):
    return ("Shop", "id", sku, name, "slug", kind, category, list(colors), url or f"/u/{sku}")


def test_enrichment(spark):
    products = spark.createDataFrame(
        [
            product("A_RED", name="Old A"),
            product("A_RED", name="Old A again"),
            product("B_RED"),
            product("C_RED", category="Fabrics"),
            product("D_RED"),
            product("", colors=()),
            product("E", colors=()),
        ],
        PRODUCT_B,
    )
    bodies = [
        ("A_RED", 1, '{"product":{"productName":"Outdated"}}'),
        ("A_RED", 2, '{"product":{"productName":"Fabrics A","price":{"sales":{"value":0},"list":{"value":100}}}}'),
        ("C_RED", 5, "{}"),
        ("D_RED", 1, '{"product":{"productName":"D"}}'),
        ("D_RED", 2, ""),
        ("", 1, "{}"),
        ("E", 1, '{"product":{"productName":"never asked for"}}'),
    ]
    captures = spark.createDataFrame(bodies, "sku string, seq bigint, body string")
    out = enrich_products(products, detail_records(captures, "https://b", F.lit(AS_OF)))
    assert set(out.columns) == set(PRODUCT_B_ENRICHED.fieldNames())
    assert dict(out.dtypes) == {f.name: f.dataType.simpleString() for f in PRODUCT_B_ENRICHED}
    rows = out.collect()
    assert len(rows) == 7
    by_sku = {}
    for r in rows:
        by_sku.setdefault(r["sku"], []).append(r)
    assert [r["name"] for r in by_sku["A_RED"]] == ["Fabrics A", "Fabrics A"]
    first = by_sku["A_RED"][0]
    assert (first["category"], first["colors"]) == ("Unstitched", [])
    assert (first["price_current"], first["price_original"], first["discount_percentage"]) == (0.0, 100.0, 100.0)
    assert first["is_sale"] is False and first["has_detailed_info"] is True
    assert by_sku["C_RED"][0]["name"] == "" and by_sku["C_RED"][0]["category"] == "Unstitched"
    for untouched in ("B_RED", "D_RED", "", "E"):
        assert by_sku[untouched][0]["has_detailed_info"] is None
        assert by_sku[untouched][0]["name"] == "Blue Shirt"
    assert enriched_count(out).first() == (3, 7)


def test_enrichment_keeps_every_row_of_hot_keys(spark):
    """A third of the rows share one sku and another third have none."""
    hot = [product("HOT_RED", url=f"/h/{i}") for i in range(300)]
    bare = [product("", colors=(), url=f"/b/{i}") for i in range(300)]
    rest = [product(f"R{i}_RED") for i in range(300)]
    captures = [("HOT_RED", i, '{"product":{"productName":"n%d"}}' % i) for i in range(200)]
    captures += [(f"R{i}_RED", 1, "{}") for i in range(0, 300, 3)]
    details = spark.createDataFrame(captures, "sku string, seq bigint, body string").repartition(6)
    products = spark.createDataFrame(hot + bare + rest, PRODUCT_B).repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = enrich_products(products, detail_records(details, "https://b", F.lit(AS_OF))).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(out) == 900
    assert {r["name"] for r in out if r["sku"] == "HOT_RED"} == {"n199"}
    assert sum(bool(r["has_detailed_info"]) for r in out) == 400


def test_requests_and_manifest(spark):
    products = spark.createDataFrame(
        [
            product("AB12-2PC_SKY", colors=("Sky",), kind="3 Piece"),
            product("AB12-2PC_SKY", colors=("Sky",), kind="Shirt"),
            product("", colors=("Sky",)),
            product("NOCOLOR", colors=()),
        ],
        PRODUCT_B,
    )
    requests = detail_requests(products)
    assert {tuple(r) for r in requests.collect()} == {
        ("AB12-2PC_SKY", "Sky", "3PC"), ("AB12-2PC_SKY", "Sky", None),
    }
    sizes = [r["parameters"]["dwvar_AB12-2PC__SKY_size"] for r in request_manifest(requests).collect()]
    assert sorted(sizes) == ["2PC", "3PC"]
    row = request_manifest(requests).first()["parameters"]
    assert row["dwvar_AB12-2PC__SKY_color"] == "SKY" and row["pid"] == "AB12-2PC_SKY"
    assert row["quantity"] == "1" and row["fromSizeSwatch"] == "true"


@pytest.mark.parametrize("copies", [1, 500])
def test_one_row_per_key(spark, copies):
    rows = [("hot", i, f"v{i}") for i in range(copies)] + [("x", 3, "a"), ("x", 9, "b"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "key string, seq int, value string").repartition(5)
    last = {r["key"]: r["value"] for r in last_per_key(df, ["key"], "seq").collect()}
    assert last == {"hot": f"v{copies - 1}", "x": "b", None: "n"}
    first = {r["key"]: r["value"] for r in first_per_key(df, ["key"], F.asc("seq")).collect()}
    assert first == {"hot": "v0", "x": "a", None: "n"}


def test_one_row_per_key_reduces_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS key", "id AS seq")
    plan = last_per_key(df, ["key"], "seq")._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[exchange:]


@pytest.mark.parametrize("limit", [3, 1500])
def test_top_per_key_beyond_the_group_limit(spark, limit):
    df = spark.range(4000).selectExpr("IF(id < 3000, 'hot', 'cold') AS key", "id").repartition(6)
    rows = top_per_key(df, ["key"], limit, F.asc("id")).collect()
    known = {("hot", i, i + 1) for i in range(min(limit, 3000))}
    known |= {("cold", 3000 + i, i + 1) for i in range(min(limit, 1000))}
    assert {(r["key"], r["id"], r["ordinal"]) for r in rows} == known and len(rows) == len(known)
