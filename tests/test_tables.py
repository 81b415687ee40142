"""Files, catalog tables and the run store, written and read back."""

import glob
import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.operators import brands, projections, reports, sets
from loomcat.plans import runs as run_plans
from loomcat.schemas import (
    LISTING_ADDITIONS,
    LISTING_BASIC_COLUMNS,
    LISTING_REPORT_COLUMNS,
    PRODUCT_TABLE,
)
from loomcat.session import scratch_path, shared_dir
from loomcat.sinks import catalog
from loomcat.sinks import files as sinks
from loomcat.sources import files as sources
from loomcat.sources import tables

WHEN = datetime(2026, 1, 2, 3, 4, 5)


@pytest.fixture
def db(spark):
    name = f"t_{uuid.uuid4().hex}"
    return catalog.CatalogDatabase(spark, name, scratch_path(spark, name))


def later(text):
    return F.lit(text).cast("timestamp")


# ------------------------------------------------------------------ files


def test_json_file_name_and_content(spark, tmp_path):
    df = spark.createDataFrame([("é ü", ["x"])], "name string, colors array<string>")
    path = sinks.write_json(df, str(tmp_path), "My Brand", WHEN)
    assert path.endswith("/my_brand_20260102_030405.json")
    lines = [line for part in tmp_path.rglob("part-*") for line in part.read_text("utf8").splitlines()]
    assert lines == ['{"name":"é ü","colors":["x"]}']


def test_csv_has_sorted_union_of_columns(spark, tmp_path):
    first = spark.createDataFrame([("s1", ["x", "y"])], "sku string, colors array<string>")
    second = spark.createDataFrame([('say "hi", now', 3)], "name string, amount int")
    path = sinks.write_csv(sets.merge_datasets([first, second]).coalesce(1), str(tmp_path), "B", WHEN)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == ["amount", "colors", "name", "sku"]
    assert sorted((tuple(r) for r in back.collect()), key=str) == [
        ("3", None, 'say "hi", now', None), (None, '["x","y"]', None, "s1"),
    ]
    assert sinks.write_csv(first.limit(0), str(tmp_path / "none"), "B", WHEN) == ""
    assert not (tmp_path / "none").exists()


def test_dump(spark, tmp_path):
    schema = T.StructType([T.StructField("sku", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "d.json").write_text(json.dumps([{"sku": "a", "n": 1}, {"sku": "b"}], indent=2), "utf8")
    rows = sources.read_dump(spark, str(tmp_path / "d.json"), schema).collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", None)]
    assert sources.read_dump(spark, str(tmp_path / "absent.json"), schema).collect() == []


def test_unreadable_dumps_give_no_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("sku", T.StringType()), T.StructField("n", T.IntegerType())])
    texts = ['[{"sku":"a","n":1},{"sku":"b"', "oops", "", '[{"sku":"c","n":"x"}, {"sku":"d","n":4}]', "[]", "7"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text, "utf8")
    rows = sources.read_dump(spark, str(tmp_path), schema)
    assert sorted(map(tuple, rows.collect())) == [("c", None), ("d", 4)]
    assert rows.count() == 2


def test_empty_csv_leaves_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "a string")
    assert sinks.write_csv(none, str(tmp_path), "No Rows", datetime(2026, 1, 2)) == ""
    assert list(tmp_path.iterdir()) == []


def test_page_files(spark, tmp_path):
    folder = tmp_path / "brand=B" / "category=007" / "start=12"
    folder.mkdir(parents=True)
    (folder / "page.html").write_text("<p>one\n</p>\n", "utf8")
    rows = sources.listing_page_files(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("B", "007", 12, True, "<p>one\n</p>\n")]


def test_configuration_files_of_both_layouts(spark, tmp_path):
    def put(path, body):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)

    def config(name, pages):
        return json.dumps({"name": name, "page_size": pages, "categories": {"b": "1", "a": "2"}}, indent=1)

    put("brands/both_x/config/config.json", config("New", 12))
    put("config/both_x_config.json", config("Old", 32))
    put("config/only_old_config.json", config("Only Old", 8))
    put("brands/broken/config/config.json", "{")
    put("config/broken_config.json", config("Shadowed", 1))
    put("brands/other/notes.json", "{}")
    files = sources.config_files(spark, str(tmp_path))
    loaded = sources.brand_configs(files)
    got = {(r["slug"], r["layout"]): (r["preferred"], r["name"], r["page_size"]) for r in loaded.collect()}
    assert got == {
        ("both_x", "new"): (True, "New", 12),
        ("both_x", "old"): (False, "Old", 32),
        ("only_old", "old"): (True, "Only Old", 8),
        ("broken", "old"): (False, "Shadowed", 1),
    }
    names = {r["name"] for r in sources.available_brands(files).collect()}
    assert names == {"Both X", "Only Old", "Broken"}
    expanded = brands.category_expand(loaded.filter("slug = 'both_x' AND preferred"), ["slug"])
    assert [tuple(r) for r in expanded.collect()] == [("both_x", 0, "b", "1"), ("both_x", 1, "a", "2")]


# ------------------------------------------------------------------ projections and reports


def test_listing_row_defaults(spark):
    df = spark.createDataFrame([("s", None, True)], "sku string, price string, is_sale boolean")
    row = projections.listing_row(df, "given").first().asDict()
    assert row["brand_id"] == "given" and row["sku"] == "s" and row["price"] == ""
    assert row["on_sale"] is False and row["in_stock"] is True and row["discount_percentage"] is None
    assert json.loads(row["raw_data"]) == {"sku": "s", "is_sale": True}
    own = spark.createDataFrame([("own", "/p.jpg")], "brand_id string, primary_image_url string")
    row = projections.listing_row(own, "given").first()
    assert (row["brand_id"], row["image_url"]) == ("own", "/p.jpg")


def test_product_row_ignores_own_brand_id(spark):
    df = spark.createDataFrame([("own", "Shirt", True)], "brand_id string, product_type string, has_detailed_info boolean")
    row = projections.product_row(df, "given").first()
    assert (row["brand_id"], row["type"], row["has_detaild_info"]) == ("given", "Shirt", True)
    assert projections.product_row(df).first()["brand_id"] is None


def test_tag_brand(spark):
    df = spark.createDataFrame([("n", "B", None), ("m", "B", "own")], "name string, brand string, brand_id string")
    tagged = brands.tag_brand(df, "given")
    assert tagged.columns == ["brand_id", "name"]
    assert [tuple(r) for r in tagged.collect()] == [("given", "n"), ("own", "m")]
    assert brands.tag_brand(df, None).columns == df.columns
    assert brands.tag_brand(df.drop("brand_id"), "given").columns == ["brand_id", "name"]


def test_brand_lookup_last_duplicate_wins(spark):
    dim = spark.createDataFrame(
        [("1", "ACME", 1), ("2", "acme", 2), ("3", "Zed", 3)], "id string, name string, seq int"
    )
    items = spark.createDataFrame([("Acme",), ("none",), (None,)], "b string")
    got = {r["b"]: r["brand_id"] for r in brands.brand_id_lookup(items, dim, "b", "seq").collect()}
    assert got == {"Acme": "2", "none": None, None: None}


def test_filter_rows_accepts_columns_sql_and_functions(spark):
    df = spark.range(10)
    for predicate in (F.col("id") > 7, "id > 7", lambda row: row["id"] > 7):
        assert [r["id"] for r in sets.filter_rows(df, predicate).collect()] == [8, 9]


def test_filter_rows_sends_only_the_named_columns(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [2]), (3, "b", None)], "n int, s string, x array<int>")
    found = sets.filter_rows(df, lambda row: row.s and row["n"] < 3, ["n", "s"])
    assert [r["n"] for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    call = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "accepts(n#" in call and "x#" not in call.split("]")[0]


def test_listing_scan_falls_back(spark):
    full = spark.createDataFrame([tuple("x" * 15)], ", ".join(f"{c} string" for c in LISTING_REPORT_COLUMNS))
    assert tables.listing_scan(full).columns == LISTING_REPORT_COLUMNS
    assert tables.listing_scan(full.drop("color")).columns == LISTING_BASIC_COLUMNS


def test_report_line(spark):
    columns = ", ".join(
        f"{c} {'int' if c in ('id', 'discount_percentage') else 'string'}" for c in LISTING_REPORT_COLUMNS
    )
    rows = [
        (1, "B", "s", "n", "Shirt", "Cat", "lawn", "Dyed", "Lawn", "Red", "5", "9", 44, "Sale", "now"),
        (2, None, "t", "m", None, None, "", "", "", "", None, "", 0, None, None),
    ]
    df = spark.createDataFrame(rows, columns).withColumn("ordinal", F.col("id"))
    lines = [r[0] for r in df.select(reports.report_line(True)).collect()]
    assert lines[0] == (
        "1. [B] n (SKU: s)\n   Type: Shirt - Cat | Fabric: lawn | Color: Red\n"
        "   Price: 5 | Original: 9 (Discount: 44%)\n   Status: Sale | Created: now"
    )
    assert lines[1] == (
        "2. [None] m (SKU: t)\n   Type: N/A - N/A\n   Price: N/A\n   Status: active | Created: None"
    )
    assert " | Dyed Lawn" in df.select(reports.report_line(False)).first()[0]


def test_ordinals_over_many_partitions(spark):
    df = spark.range(500).selectExpr("id * 7919 % 500 AS v", "id").repartition(9)
    rows = reports.with_ordinal(df, "v").collect()
    assert sorted((r["ordinal"], r["v"]) for r in rows) == [(i + 1, i) for i in range(500)]


# ------------------------------------------------------------------ catalog tables


def products(spark, rows):
    df = spark.createDataFrame(rows, "sku string, name string, seq int")
    return projections.product_row(df, "b", "seq")


def test_create_is_idempotent(spark, db):
    assert catalog.create_product_table(db) is True
    assert catalog.create_product_table(db) is False
    assert dict(db.read("product").dtypes) == {f.name: f.dataType.simpleString() for f in PRODUCT_TABLE}


def test_upsert_replaces_by_sku(spark, db):
    catalog.create_product_table(db)
    first = products(spark, [("a", "a1", 1), ("b", "b1", 2), (None, "n1", 3)])
    catalog.upsert_products(db, first, "seq", later("2026-01-01 00:00:00"))
    before = {r["name"]: r["id"] for r in db.read("product").collect()}
    second = products(spark, [("b", "b2", 1), ("b", "b3", 9), ("c", "c1", 1), (None, "n2", 1), (None, "n2", 2)])
    catalog.upsert_products(db, second, "seq", later("2026-02-01 00:00:00"))
    rows = db.read("product").collect()
    assert sorted(r["name"] for r in rows) == ["a1", "b3", "c1", "n1", "n2", "n2"]
    by_name = {r["name"]: r for r in rows}
    assert by_name["b3"]["id"] == before["b1"] and by_name["b3"]["created_at"].month == 1
    assert by_name["c1"]["created_at"].month == 2
    assert len({r["id"] for r in rows}) == 6
    skus = [r["sku"] for r in rows if r["sku"] is not None]
    assert len(skus) == len(set(skus))
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5, 6]
    db.drop_old_versions("product")
    assert len(db.versions("product")) == 1 and db.read("product").count() == 6


def test_upsert_leaves_other_buckets_alone(spark, db):
    catalog.create_product_table(db)
    rows = [(f"s{i}", f"old{i}", 1) for i in range(600)]
    catalog.upsert_products(db, products(spark, rows), "seq", later("2026-01-01 00:00:00"))

    def files():
        stored = spark.table(db.qualified("product"))
        return {(r[0], r[1]) for r in stored.select(F.input_file_name(), catalog.BUCKET).distinct().collect()}

    before = files()
    update = [("s7", "new", 1), ("fresh", "new", 1), (None, "none", 1)]
    catalog.upsert_products(db, products(spark, update).repartition(3), "seq", later("2026-02-01 00:00:00"))
    changed = {bucket for _, bucket in before ^ files()}
    assert len(before) > 60 and len(changed) <= 3
    stored = db.read("product").collect()
    assert sorted(r["id"] for r in stored) == list(range(1, 603))
    assert {r["name"] for r in stored if r["sku"] in ("s7", "fresh", None)} == {"new", "none"}
    assert len({r["sku"] for r in stored}) == 602


def test_upsert_computes_its_rows_once(spark, db):
    """Rows that come out differently each time are still numbered and stored once."""
    catalog.create_product_table(db)
    random = spark.range(300).select(F.concat(F.lit("r"), (F.rand() * 1e9).cast("long")).alias("sku"), F.lit("x").alias("name"), F.lit(1).alias("seq"))
    catalog.upsert_products(db, projections.product_row(random, "b", "seq"), "seq", later("2026-01-01 00:00:00"))
    stored = db.read("product").collect()
    assert len(stored) == 300 and sorted(r["id"] for r in stored) == list(range(1, 301))


def test_upsert_of_one_hot_sku(spark, db):
    catalog.create_product_table(db)
    rows = [("hot", f"v{i}", i) for i in range(400)] + [(None, f"n{i}", i) for i in range(400)]
    rows += [(f"s{i}", "x", i) for i in range(400)]
    catalog.upsert_products(db, products(spark, rows).repartition(7), "seq", later("2026-01-01 00:00:00"))
    stored = db.read("product").collect()
    assert len(stored) == 1 + 400 + 400
    assert [r["name"] for r in stored if r["sku"] == "hot"] == ["v399"]


def test_evolution_and_backfill(spark, db):
    old = spark.createDataFrame([("s", "/i.jpg"), ("t", None)], "sku string, image_url string")
    catalog.append_listing(db, old)
    assert catalog.evolve_listing(db) == LISTING_ADDITIONS.fieldNames()
    assert catalog.evolve_listing(db) == []
    catalog.append_listing(db, projections.listing_row(old).select("sku", "color", "image_url"))
    filled = catalog.backfill_image(db.read("product_listing"))
    got = sorted((tuple(r) for r in filled.select("sku", "primary_image_url", "color").collect()), key=str)
    assert got == sorted([("s", "/i.jpg", None), ("t", None, None), ("s", "", ""), ("t", "", "")], key=str)


def test_missing_table_reads_as_empty(spark, db):
    assert tables.table_or_empty(spark, f"{db.name}.nothing", PRODUCT_TABLE).count() == 0
    assert tables.brand_dim_table(spark, f"{db.name}.nothing").columns == ["id", "name", "logo_url"]


# ------------------------------------------------------------------ run store

ITEM = "sku string, name string, category string, status string"


def run_items(spark, brand, run, rows):
    df = spark.createDataFrame(rows, ITEM)
    return projections.run_item_row(df, F.lit(run), F.lit(brand), later("2026-01-01 00:00:00"))


def test_run_store(spark, db):
    item = run_items(spark, "x", "1", [])
    store = run_plans.RunStore(db, item.schema)
    store.save_runs(run_items(spark, "It's \\ B", "100", [("a", "n", "c", "s")] * 3), later("2026-01-01 00:00:00"), F.lit(1).cast("bigint"))
    store.save_runs(run_items(spark, "Other", "200", [("b", "n", "c", "s")] * 2), later("2026-01-02 00:00:00"), F.lit(2).cast("bigint"))
    store.save_runs(run_items(spark, "Other", "200", [("b2", "n", "c", "s")]), later("2026-01-03 00:00:00"), F.lit(3).cast("bigint"))
    metadata = sorted((r["id"], r["brand"], r["item_count"], r["seq"]) for r in store.runs().collect())
    assert metadata == [("100", "It's \\ B", 3, 1), ("200", "Other", 1, 3), ("200", "Other", 2, 2)]
    assert sorted(r["sku"] for r in store.items().collect()) == ["a", "a", "a", "b2"]
    assert store.delete_run("100") is True
    assert store.delete_run("100") is False
    assert store.delete_run("200") is True
    assert store.delete_run("200") is False
    assert store.runs().count() == 0 and store.items().count() == 0


def test_only_the_partition_of_a_run_is_read(spark, db):
    store = run_plans.RunStore(db, run_items(spark, "x", "1", []).schema)
    for run in ("1", "2"):
        store.save_runs(run_items(spark, "B", run, [("a", "n", "c", "s")]), later("2026-01-01 00:00:00"), F.lit(1).cast("bigint"))
    plan = store.items().filter("brand = 'B' AND scrape_id = '2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(brand" in plan


def test_reads_of_the_store(spark, db):
    product = T.StructType([T.StructField(n, T.StringType()) for n in ("sku", "category", "status")])
    schema = "sku string, category string, status string, scraped_data string, item_no long, brand string, scrape_id string, created_at timestamp"
    def rows(brand, run, n):
        return [
            (f"{i}", "column", "column", None if i % 4 == 3 else json.dumps({"sku": f"p{i}", "category": i % 2, "status": "Sale"}
             if i % 4 == 0 else {"sku": f"p{i}", "category": "c"}), i, brand, run, datetime(2026, 1, 1)) for i in range(n)
        ]
    store = run_plans.RunStore(db, spark.createDataFrame([], schema).schema)
    for number, (brand, run) in enumerate((("x", "1"), ("y", "2"), ("x", "3"))):
        items = spark.createDataFrame(rows(brand, run, 130), schema).repartition(4)
        store.save_runs(items, later(f"2026-01-0{number + 1} 00:00:00"), F.lit(number).cast("bigint"))
    assert store.latest().first()["id"] == "3" and store.latest("y").first()["id"] == "2"
    assert store.latest("nobody").collect() == []
    first = store.brand_items(product, "x").collect()
    assert {r["scrape_id"] for r in first} == {"3"} and sorted(r["item_no"] for r in first) == list(range(100))
    assert {r["sku"] for r in first if r["item_no"] in (3, 4)} == {"3", "p4"}
    # A status that stands only in the product is found; the own column counts where there is none.
    assert [r["item_no"] for r in store.by_status(product, "Sale", "x", limit=3).collect()] == [0, 4, 8]
    assert store.by_status(product, "column", "y").count() == 25
    assert store.by_category(product, "0").count() == 0  # a number is no text
    assert store.by_category(product, "c").count() == 100  # 50 of each brand
    ids = spark.createDataFrame([("2",), ("9",)], "scrape_id string")
    found = store.run_items(ids, product)
    assert found.count() == 130
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_saved_counts_are_those_of_the_stored_rows(spark, db):
    """Rows that come out differently each time they are computed."""
    items = run_items(spark, "x", "1", [("a", "n", "c", "s")] * 500).filter(F.rand() < 0.5)
    store = run_plans.RunStore(db, items.schema)
    store.save_runs(items, later("2026-01-01 00:00:00"), F.lit(1).cast("bigint"))
    assert store.runs().first()["item_count"] == store.items().count()


def test_unwrapped_items(spark):
    schema = T.StructType([T.StructField("sku", T.StringType()), T.StructField("extra", T.IntegerType())])
    rows = [("r", "own", '{"sku":"in","extra":3}', "t"), ("r", "own", "null", "t"), ("r", "own", None, "t"), ("r", "own", "[1]", "t")]
    df = spark.createDataFrame(rows, "scrape_id string, sku string, scraped_data string, created_at string")
    got = [tuple(r) for r in run_plans.unwrap_items(df, schema).collect()]
    assert got == [("r", "in", 3, "", "t")] + [("r", "own", None, None, "t")] * 3


def test_latest_run_and_limits(spark):
    runs = spark.createDataFrame(
        [("1", "B", "2026-01-01", 1), ("2", "B", "2026-01-05", 2), ("3", "B", "2026-01-05", 3), ("4", "C", None, 4)],
        "id string, brand string, scraped_at string, seq int",
    )
    latest = {r["brand"]: r["id"] for r in run_plans.latest_run_per_brand(runs).collect()}
    assert latest == {"B": "2", "C": "4"}
    items = spark.createDataFrame(
        [("B", "2", i, "even" if i % 2 == 0 else "odd") for i in range(250)] + [("B", "1", 0, "even")],
        "brand string, scrape_id string, position int, category string",
    )
    first = run_plans.brand_items(runs, items, "position")
    assert sorted(r["position"] for r in first.collect()) == list(range(100))
    evens = run_plans.by_category(runs, items, "even", "position", limit=30)
    assert sorted(r["position"] for r in evens.collect()) == list(range(0, 60, 2))
    assert run_plans.by_category(runs, items, "even", "position").count() == 50
    with_status = items.withColumnRenamed("category", "status")
    assert run_plans.by_status(runs, with_status, "odd", "position").count() == 50


def test_first_metadata_row_names_the_brand(spark):
    runs = spark.createDataFrame([("1", "First", 1), ("1", "Second", 2)], "id string, brand string, seq int")
    assert run_plans.run_brand(runs).collect()[0]["brand"] == "First"
    items = spark.createDataFrame([("First", "1", "x"), ("Second", "1", "y")], "brand string, scrape_id string, sku string")
    ids = spark.createDataFrame([("1",), ("9",)], "scrape_id string")
    assert [r["sku"] for r in run_plans.items_of_runs(ids, runs, items).collect()] == ["x"]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_saved_items_are_written_once(spark, db):
    store = run_plans.RunStore(db, run_items(spark, "x", "1", []).schema)
    keys = [("4-NOT SPECIFIED", "1"), ("a+b%41:c/d=e", "1"), ("Größe 'q' \\", "007"), ("B", "1"), (None, "1")]
    frames = [run_items(spark, "x", run, [("s", "n", "c", "s")] * (i + 1)).withColumn("brand", F.lit(brand)) for i, (brand, run) in enumerate(keys)]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    before = set(glob.glob(f"{local_path(shared_dir(spark))}/loomcat/*/*"))
    for again in range(2):  # a run saved again takes the place of its items
        store.save_runs(every, later("2026-01-01 00:00:00"), F.lit(again).cast("bigint"))
        stored = store.items().groupBy("brand", "scrape_id").count().collect()
        assert {(r["brand"], r["scrape_id"]): r["count"] for r in stored} == {k: i + 1 for i, k in enumerate(keys)}
        counts = store.runs().filter(F.col("seq") == again).collect()
        assert {(r["brand"], r["id"]): r["item_count"] for r in counts} == {k: i + 1 for i, k in enumerate(keys)}
    copies = set(glob.glob(f"{local_path(shared_dir(spark))}/loomcat/*/*")) - before
    assert not [c for c in copies if "run-items" in c]
    assert store.delete_run("007") is True and store.items().count() == 1 + 2 + 4 + 5
    store.save_runs(every.limit(0), later("2026-01-01 00:00:00"), F.lit(9).cast("bigint"))
    assert store.items().count() == 1 + 2 + 4 + 5


def local_path(place):
    return place.removeprefix("file:")
