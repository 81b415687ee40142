"""Stop rules, quotas and limits, against plain loops over the same pages."""

import random

import pytest
from pyspark.sql import functions as F

from loomcat.operators import paging
from loomcat.operators.paging import apply_quota, category_quota, page_offsets, page_prefix
from loomcat.plans.dialects import DIALECT_A, DIALECT_B, Registry
from loomcat.plans.harvest import harvest_all, harvest_limited

SCHEMA = "brand string, category string, start int, ok boolean, no_results boolean, n_products int"
KEYS = ["brand", "category"]


def walk(pages, size):
    """What a sequential reader of each category keeps."""
    kept = []
    by_category = {}
    for page in pages:
        by_category.setdefault(page[:2], []).append(page)
    for category in by_category.values():
        for page in sorted(category, key=lambda p: p[2]):
            _, _, _, ok, no_results, n = page
            if not ok or no_results or n == 0:
                break
            kept.append(page)
            if n < size:
                break
    return sorted(kept)


@pytest.mark.parametrize(
    "counts, kept",
    [
        ([12, 12, 5, 12], [0, 12, 24]),
        ([None, 12], []),
        ([12, 0, 12], [0]),
        ([12, 11, 12], [0, 12]),
        ([12, -12, 12], [0]),
        ([40, 13, 12], [0, 12, 24]),
    ],
)
def test_page_prefix_cases(spark, counts, kept):
    rows = [
        ("b", "c", i * 12, n is not None, n is not None and n < 0, abs(n or 0))
        for i, n in enumerate(counts)
    ]
    got = page_prefix(spark.createDataFrame(rows, SCHEMA), 12, KEYS)
    assert sorted(r["start"] for r in got.collect()) == kept


def read_in_turn(pages, size):
    """What a reader keeps that asks for one page after the other, from 0 on."""
    kept, by_place = [], {p[:3]: p for p in pages}
    for brand, category in sorted({p[:2] for p in pages}):
        start = 0
        while (page := by_place.get((brand, category, start))) is not None:
            _, _, _, ok, no_results, n = page
            if not ok or no_results or n == 0:
                break
            kept.append(page)
            if n < size:
                break
            start += size
    return sorted(kept)


@pytest.mark.parametrize(
    "starts, kept",
    [
        ([0, 12, 36, 48], [0, 12]),
        ([12, 24], []),
        ([0, 12, 24], [0, 12, 24]),
        ([0, 12, 18, 24], [0, 12, 24]),  # nobody asks for a page at 18
        ([0, 12, 24, 36, 60], [0, 12, 24, 36]),
        ([0, 48, 60, 72], [0]),
    ],
)
def test_missing_pages_end_their_category(spark, monkeypatch, starts, kept):
    for run in (2, 1024):  # gaps inside a run, at its edge, and over whole runs
        monkeypatch.setattr(paging, "PAGES_PER_RUN", run)
        rows = [("b", "c", start, True, False, 12) for start in starts]
        got = page_prefix(spark.createDataFrame(rows, SCHEMA), 12, KEYS)
        assert sorted(r["start"] for r in got.collect()) == kept


def test_missing_pages_anywhere(spark, monkeypatch):
    monkeypatch.setattr(paging, "PAGES_PER_RUN", 5)
    rng = random.Random(9)
    pages = [p for p in random_pages(8, hot=200) if rng.random() > 0.02]
    got = page_prefix(spark.createDataFrame(pages, SCHEMA), 12, KEYS).collect()
    assert sorted(tuple(r) for r in got) == read_in_turn(pages, 12)
    assert len(got) < len(walk(pages, 12))


def test_missing_pages_are_found_without_a_window_per_category(spark):
    pages = spark.createDataFrame(random_pages(1, hot=3), SCHEMA)
    plan = page_prefix(pages, 12, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_run" in line.split("], [")[1] for line in windows)


@pytest.mark.parametrize("share, limit", [(0, 0), (7, 0), (0, 31), (7, 31), (500, 1), (12, 12), (0, 100_000)])
def test_apply_limits(spark, monkeypatch, share, limit):
    monkeypatch.setattr(paging, "PAGES_PER_RUN", 3)
    pages = walk(random_pages(5, hot=60), 12)
    df = spark.createDataFrame(pages, SCHEMA).withColumn("products", F.expr("sequence(1, n_products)"))
    number = F.expr("int(substr(category, 2))").alias("category_no")
    takes = paging.page_takes(
        df.select("*", number), 12, F.lit(share), F.lit(limit), KEYS, ["brand"], ["category_no"]
    )
    cut = paging.apply_takes(df, takes, "products", KEYS)
    known, of_category, of_brand = [], {}, {}
    for page in sorted(pages, key=lambda p: (p[0], int(p[1][1:]), p[2])):
        for i in range(1, page[5] + 1):
            if share and of_category.get(page[:2], 0) >= share or limit and of_brand.get(page[0], 0) >= limit:
                break
            of_category[page[:2]] = of_category.get(page[:2], 0) + 1
            of_brand[page[0]] = of_brand.get(page[0], 0) + 1
            known.append((*page[:3], i))
    got = cut.select(*KEYS, "start", F.explode("products")).collect()
    assert sorted(map(tuple, got)) == sorted(known)


def test_limits_number_no_products(spark):
    """Windows see pages of one run, runs of a category, or categories of a brand; never products."""
    df = spark.createDataFrame(walk(random_pages(5, hot=3), 12), SCHEMA)
    df = df.withColumn("products", F.expr("sequence(1, n_products)"))
    takes = paging.page_takes(df, 12, F.lit(3), F.lit(9), KEYS, ["brand"], ["category"])
    plan = takes._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "sequence(" not in plan


def random_pages(seed, hot):
    rng = random.Random(seed)
    pages = []
    for number in range(40):
        for i in range(hot if number == 0 else rng.randint(1, 9)):
            n = rng.choice([12] * 30 + [13, 15, 5, 0]) if number else 12 + i % 3
            fine = number == 0 or rng.random() > 0.04
            pages.append((f"b{number % 3}", f"c{number}", i * 12, fine, rng.random() < 0.03 and number > 0, n))
    rng.shuffle(pages)
    return pages


def test_page_prefix_with_one_hot_category(spark):
    pages = random_pages(1, hot=400)
    got = page_prefix(spark.createDataFrame(pages, SCHEMA), 12, KEYS).collect()
    assert sorted(tuple(r) for r in got) == walk(pages, 12)


def test_page_offsets_cross_runs_of_pages(spark, monkeypatch):
    monkeypatch.setattr(paging, "PAGES_PER_RUN", 7)
    pages = walk(random_pages(2, hot=300), 12)
    got = page_offsets(spark.createDataFrame(pages, SCHEMA), 12, KEYS)
    known = {}
    for brand, category, start, _, _, n in pages:
        before = sum(p[5] for p in pages if p[:2] == (brand, category) and p[2] < start)
        known[(brand, category, start)] = before
    assert {(r[0], r[1], r[2]): r["first_rank"] for r in got.collect()} == known


@pytest.mark.parametrize("quota", [0, 1, 12, 30, 5000])
def test_apply_quota(spark, quota):
    pages = walk(random_pages(3, hot=200), 12)
    df = spark.createDataFrame(pages, SCHEMA).withColumn(
        "products", F.expr("transform(sequence(1, n_products), i -> i)")
    )
    got = apply_quota(df, "products", 12, quota, KEYS).select(*KEYS, "start", F.explode("products"))
    known, taken = [], {}
    for page in pages:
        for i in range(1, page[5] + 1):
            count = taken.get(page[:2], 0)
            if quota == 0 or count < quota:
                known.append((*page[:3], i))
                taken[page[:2]] = count + 1
    assert sorted(tuple(r) for r in got.collect()) == sorted(known)


def test_category_quota(one):
    rows = [(0, 5), (12, 1), (12, 5), (3, 5), (10, 0)]
    got = one(rows, "l int, n int", category_quota(F.col("l"), F.col("n")))
    assert got == [0, 12, 2, 0, 10]


def tile(name):
    return f'<div class="product-tile"><div class="pdp-link"><a class="link" href="/x">{name}</a></div></div>'


def test_limits_share_out_over_categories(spark):
    """Limit 5 over 2 categories, limit 1 over 2 (shares to nothing), no limit, one category."""
    shops = [("s5", 5, 2), ("s1", 1, 2), ("s0", 0, 2), ("single", 3, 1)]
    pages, order = [], []
    for brand, _, n_categories in shops:
        for c in range(n_categories):
            order.append((brand, f"c{c}", c))
            for start in (0, 4):
                html = "".join(tile(f"{brand} {c} {start + i}") for i in range(4))
                pages.append((brand, f"c{c}", start, True, html))
    page_rows = spark.createDataFrame(pages, "brand string, category string, start int, ok boolean, html string")
    configs = spark.createDataFrame(
        [(b, "id", "https://x", 4, limit, n) for b, limit, n in shops],
        "brand string, brand_id string, base_url string, page_size int, product_limit int, n_categories int",
    )
    categories = spark.createDataFrame(order, "brand string, category string, category_no int")
    rows = harvest_limited(page_rows, configs, DIALECT_A, categories).collect()
    names = {}
    for r in rows:
        names.setdefault(r["brand"], []).append(r["name"])
    assert sorted(names["s5"]) == ["s5 0 0", "s5 0 1", "s5 1 0", "s5 1 1"]
    assert names["s1"] == ["s1 0 0"]
    assert len(names["s0"]) == 16
    assert sorted(names["single"]) == ["single 0 0", "single 0 1", "single 0 2"]


def test_harvest_all_dispatches_by_registry(spark):
    registry = Registry()
    registry.register("Alpha Shop", DIALECT_A)
    registry.register("beta", DIALECT_B)
    b_tile = '<div data-pid="X_RED"><div class="product-tile"><p class="pdp-link"><b class="pdp-link-heading">N</b></p></div></div>'
    pages = spark.createDataFrame(
        [("alpha shop", "c", 0, True, tile("Printed Lawn Shirt")), ("BETA", "c", 0, True, b_tile),
         ("gamma", "c", 0, True, tile("unknown brand"))],
        "brand string, category string, start int, ok boolean, html string",
    )
    configs = spark.createDataFrame(
        [(b, "id-" + b, "https://x", 12, 0, 1) for b in ("alpha shop", "BETA", "gamma")],
        "brand string, brand_id string, base_url string, page_size int, product_limit int, n_categories int",
    )
    rows = {r["brand"]: r for r in harvest_all(pages, configs, registry).collect()}
    assert set(rows) == {"alpha shop", "BETA"}
    assert rows["alpha shop"]["fabric_type"] == "Lawn"
    assert rows["BETA"]["colors"] == ["Red"]
    assert registry.get("ALPHA shop") is DIALECT_A and registry.get("gamma") is None


OTHER = (
    '<li data-pid="Y-2PC_BLUE"><article class="big card"><a class=go href="/y.html"><h3>M 2 Piece</h3></a>'
    '<p class="cost"><i class="now">no</i><b class="now">PKR 90</b></article></li>'
)
USUAL = (
    '<div data-pid="X-3PC_RED"><div class="product-tile"><p class="pdp-link"><a class="link" href="/x.html">'
    '<b class="pdp-link-heading">N 3 Piece</b></a></p></div></div>'
)
PAGES = "brand string, category string, start int, ok boolean, html string"
SHOPS = (
    "brand string, brand_id string, base_url string, page_size int, product_limit int, "
    "categories map<string,string>, enhance_with_details boolean, product_selector string, "
    "name_selector string, price_selector string, pdp_link_selector string"
)


def every_dialect():
    registry = Registry()
    registry.register("a*", DIALECT_A)
    registry.register("b*", DIALECT_B)
    return registry


def test_shops_of_one_dialect_have_their_own_markup(spark):
    pages = spark.createDataFrame(
        [("b1", "c", 0, True, USUAL + OTHER), ("b2", "c", 0, True, USUAL + OTHER), ("b3", "c", 0, True, USUAL),
         ("b4", "c", 0, True, USUAL), ("a1", "c", 0, True, tile("Printed Lawn Shirt")), ("b2", "else", 0, True, OTHER),
         ("b2", None, 0, True, OTHER), ("z", "c", 0, True, OTHER)],
        PAGES,
    )
    own = ("article.card", "article h3", ".cost > b.now", "a.go")
    none = (None, None, None, None)
    configs = spark.createDataFrame(
        [(b, "i", "https://x", 12, 0, {"c": "1"}, False, *selectors) for b, selectors in
         (("b1", none), ("b2", own), ("b3", (":hover", None, None, None)), ("b4", (None, "h9", None, None)), ("a1", own))],
        SHOPS,
    )
    rows = {r["brand"]: r for r in harvest_all(pages, configs, every_dialect()).collect()}
    assert set(rows) == {"b1", "b2", "a1"}  # b3's selector is not supported, b4's finds nothing
    assert (rows["b1"]["sku"], rows["b1"]["url"], rows["b1"]["price"]) == ("X-3PC_RED", "https://x/x.html", "N/A")
    assert (rows["b2"]["sku"], rows["b2"]["url"], rows["b2"]["price"]) == ("Y-2PC_BLUE", "https://x/y.html", "90")
    assert rows["b2"]["product_type"] == "2 Piece"


def test_details_and_ids_in_the_whole_plan(spark):
    pages = spark.createDataFrame(
        [("b1", "c", 0, True, USUAL), ("b2", "c", 0, True, USUAL), ("b3", "c", 0, True, USUAL), ("b1", "d", 12, True, USUAL)],
        PAGES,
    )
    none = (None, None, None, None)
    categories = {"c": "1", "d": "2"}
    configs = spark.createDataFrame(
        [("b1", None, "https://x", 12, 0, categories, True, *none), ("b2", None, "https://y", 12, 0, categories, False, *none),
         ("b3", "own", "https://z", 12, 0, categories, True, *none)],
        SHOPS,
    )
    body = '{"product":{"productName":"Ready One","images":{"large":[{"url":"/i.jpg"}]}}}'
    captures = spark.createDataFrame(
        [("b1", "X-3PC_RED", 1, body), ("b2", "X-3PC_RED", 1, body), ("b3", "X-3PC_RED", 2, None), ("b3", "X-3PC_RED", 1, body)],
        "brand string, sku string, seq long, body string",
    )
    dim = spark.createDataFrame([("old", "B1", 1), ("new", "b1", 2), ("three", "B3", 1)], "id string, name string, seq long")
    as_of = F.lit("2026-02-15").cast("date")
    rows = harvest_all(pages, configs, every_dialect(), captures, dim, as_of).collect()
    found = {r["brand_id"]: (r["brand"], r["name"], r["img_url"]) for r in rows}
    assert found == {
        "new": (None, "Ready One", ["https://x/i.jpg"]),  # joined within its brand, with its base address
        None: ("b2", "N 3 Piece", None),  # not configured to have details, not in the dimension
        "own": (None, "N 3 Piece", None),  # the last capture has no body; its own id stays
    }


def test_all_brands_are_walked_once(spark, tmp_path):
    """One Python stage and one write over the pages of both dialects."""
    spark.createDataFrame([("a1", "c", 0, True, tile("A B"))], PAGES).write.parquet(f"{tmp_path}/p")
    configs = spark.createDataFrame([("a1", "c"), ("b1", "c")], "brand string, brand_id string")
    products = harvest_all(spark.read.parquet(f"{tmp_path}/p"), configs, every_dialect())
    plan = products._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and f"{tmp_path}/p" not in plan  # only the written pages are read
    assert [r["name"] for r in products.collect()] == ["A B"]


def test_registry_families(spark):
    registry = Registry()
    registry.register("shop.x", DIALECT_A)
    registry.register("Shop*", DIALECT_B)
    brands = spark.createDataFrame([("SHOP.X",), ("shop+x",), ("shopping",), ("other",)], "brand string")
    names = {}
    for dialect, own in registry.groups():
        names[dialect is DIALECT_A] = {r["brand"] for r in brands.filter(own).collect()}
    assert names == {True: {"SHOP.X"}, False: {"shop+x", "shopping"}}
    assert registry.get("shop.X") is DIALECT_A and registry.get("Shop-1") is DIALECT_B
