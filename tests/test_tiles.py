"""Tile extraction on small pages with known contents."""

import time

import pytest
from pyspark.sql import functions as F

from loomcat.operators.tiles import Field, TileSpec, _TileWalker, explode_tiles, extract_tiles, tile_type, worth_reading
from loomcat.plans.dialects import DIALECT_A, DIALECT_B, TILES_A, TILES_B
from loomcat.plans.harvest import extract_pages, page_products

TILE_A = """
<div class="product-tile" data-pid="P1">
  <div class="plp-dual-image"><img class="tile-image" data-src="/i/p1.jpg?sw=300">
    <img class="hover-image" src="/i/p1b.jpg?sw=300"></div>
  <div class="pdp-link"><a class="link" href="/collections/one-piece-unstitched/products/P1.html">
    Printed <b>Lawn</b> Shirt<script>var x = "not text";</script><!-- nor this --></a></div>
  <div class="subtitle">Summer &amp; Lawn</div>
  <div class="price"><span class="sales"><span class="value">Rs.1,500.00</span></span>
    <del><span class="value">Rs.2,000.00</span></del></div>
  <div class="badge-wrapper"><span class="sold-out">Sold out</span></div>
</div>"""
TILE_B = """
<div data-pid="AB12-3PC_NAVY" data-gtmdata='{"category":"Fabrics"}'><div class="product-tile">
  <div class="pdp-link"><a class="link" href="/fabrics-3-piece/AB12-3PC_NAVY.html">
    <h2 class="pdp-link-heading">Fabrics 3 Piece</h2></a></div>
  <div class="product-brand"><span class="text-truncate">Embroidered | Lawn</span></div>
  <div class="price"><span class="strike-through"><span class="value">PKR 4,990</span></span>
    <span class="sales"><span class="value">PKR 3,990</span></span></div>
</div></div>"""


def tiles_of(spark, spec, *bodies):
    rows = [(i, b) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page int, html string")
    return extract_tiles(pages, spec, ["page"])


def test_dialect_a_tile(spark):
    row = tiles_of(spark, TILES_A, TILE_A).first()
    assert row["no_results"] is False
    (tile,) = row["tiles"]
    assert tile.asDict() == {
        "pos": 0,
        "tile_pid": "P1",
        "name": "Printed Lawn Shirt",
        "href": "/collections/one-piece-unstitched/products/P1.html",
        "subtitle": "Summer & Lawn",
        "price_raw": "Rs.1,500.00",
        "original_raw": "Rs.2,000.00",
        "primary_data_src": "/i/p1.jpg?sw=300",
        "primary_src": None,
        "hover_data_src": None,
        "hover_src": "/i/p1b.jpg?sw=300",
        "sold_out": True,
    }


def test_dialect_b_reads_the_parent(spark):
    (tile,) = tiles_of(spark, TILES_B, TILE_B).first()["tiles"]
    assert tile["parent_pid"] == "AB12-3PC_NAVY"
    assert tile["tile_pid"] is None
    assert tile["tag_raw"] == '{"category":"Fabrics"}'
    assert tile["name"] == "Fabrics 3 Piece"
    assert tile["brand_text"] == "Embroidered | Lawn"
    assert (tile["price_raw"], tile["original_raw"]) == ("PKR 3,990", "PKR 4,990")


def test_stop_marker_empty_and_missing_pages(spark):
    rows = tiles_of(spark, TILES_A, "<p class='a no-results'>none</p>", "", None, TILE_A * 3).collect()
    assert [(r["page"], r["no_results"], len(r["tiles"])) for r in sorted(rows)] == [
        (0, True, 0), (1, False, 0), (2, False, 0), (3, False, 3),
    ]


def test_selector_grammar(spark):
    spec = TileSpec(
        ".tile",
        {
            "own": Field("self", "id"),
            "nested": Field(".x .y", "text"),
            "either": Field("b.q, .r", "text"),
            "tag": Field("i", "text"),
            "has": Field(".z", "found"),
        },
    )
    body = """
    <div class="x"><section class="big tile" id="t1"><span class="y">in x</span><em class="q">no</em>
      <em class="r">R</em><b class="q">Q</b></section></div>
    <section class="tile" id="t2"><span class="y">not in x</span><br/><i>first<i>inner</i></i><i>2nd</i>
      <u class="z"></section>
    <section class="tiled"></section>
    <section class="tile" id="t3"><p><section class="tile" id="t4"><i>deep</i></section></section>
    """
    rows = tiles_of(spark, spec, body).first()["tiles"]
    got = [(t["own"], t["nested"], t["either"], t["tag"], t["has"]) for t in rows]
    assert got == [
        ("t1", "in x", "R", None, False),
        ("t2", None, None, "firstinner", True),
        ("t3", None, None, "deep", False),
        ("t4", None, None, "deep", False),
    ]


def configured(spark, dialect, brand, html):
    pages = spark.createDataFrame(
        [(brand, "page_cat", 0, True, html)],
        "brand string, category string, start int, ok boolean, html string",
    )
    config = spark.createDataFrame(
        [(brand, "id-1", "https://shop.example")], "brand string, brand_id string, base_url string"
    )
    return page_products(extract_pages(pages, dialect).join(config, "brand"), dialect)


def test_product_a(spark):
    row = configured(spark, DIALECT_A, "Shop A", TILE_A).first().asDict()
    assert row == {
        "brand": "Shop A",
        "brand_id": "id-1",
        "page_category": "page_cat",
        "start": 0,
        "pos": 0,
        "sku": "P1",
        "name": "Printed Lawn Shirt",
        "slug": "printed-lawn-shirt",
        "fabric_style": "Printed",
        "fabric_type": "Lawn",
        "product_type": "Shirt",
        "category": "Unstitched",
        "collection": "Summer",
        "piece_info": "One Piece",
        "url": "https://shop.example/collections/one-piece-unstitched/products/P1.html",
        "img_url": ["/i/p1.jpg", "/i/p1b.jpg"],
        "price": "Rs.1,500.00",
        "original_price": "Rs.2,000.00",
        "discount_percentage": 25,
        "on_sale": True,
        "in_stock": False,
    }


def test_product_b(spark):
    row = configured(spark, DIALECT_B, "Shop B", TILE_B).first().asDict()
    assert row["sku"] == "AB12-3PC_NAVY"
    assert row["slug"] == "fabrics-3-piece-embroidered-lawn"
    assert row["category"] == "Unstitched"
    assert row["colors"] == ["Navy"]
    assert row["product_type"] == "3 Piece"
    assert (row["price"], row["original_price"]) == ("3,990", "4,990")


def test_unusable_tiles_do_not_count(spark):
    nameless = TILE_A.replace('class="link"', 'class="other"')
    unreadable = TILE_A.replace("Rs.2,000.00", "Rs. ")
    html = TILE_A + nameless + unreadable + TILE_A
    pages = spark.createDataFrame(
        [("b", "c", 0, True, html)],
        "brand string, category string, start int, ok boolean, html string",
    )
    row = extract_pages(pages, DIALECT_A).first()
    assert row["n_products"] == 2
    assert [p["pos"] for p in row["products"]] == [0, 3]


def test_tag_data_cases(spark):
    def tile(tag, name="Blue Shirt"):
        attribute = "" if tag is None else f" data-gtmdata='{tag}'"
        return f"<div{attribute}><div class='product-tile'><a class='pdp-link'><b class='pdp-link-heading'>{name}</b></a></div></div>"

    cases = [None, "{bad", "{}", '{"x":1}', '{"category":"Fabrics"}', '{"category":null}', "[1]",
             "[]", "0", "7", '"t"', "true", "false", "null"]
    html = "".join(tile(c) for c in cases) + tile("[1]", "RTW Shirt")
    rows = configured(spark, DIALECT_B, "B", html).orderBy("pos").collect()
    got = {r["pos"]: r["category"] for r in rows}
    kept = {0: "page_cat", 1: "page_cat", 2: "page_cat", 3: "page_cat", 4: "Unstitched", 5: None,
            7: "page_cat", 8: "page_cat", 12: "page_cat", 13: "page_cat", 14: "Ready to Wear"}
    assert got == kept


def test_explode_keeps_page_keys(spark):
    exploded = explode_tiles(tiles_of(spark, TILES_A, TILE_A * 2, ""), ["page"])
    assert [(r["page"], r["pos"]) for r in exploded.orderBy("pos").collect()] == [(0, 0), (0, 1)]


def test_broken_markup_is_walked_in_linear_time():
    """Tags without an end, end tags without a start, and items in deep nesting."""
    walker = _TileWalker(TILES_A)
    for html in ("<a " * 100_000, "<a x=\"" * 100_001, "<!-" * 100_000, "<div>" * 50_000 + "</p>" * 100_000,
                 "<div>" * 50_000 + "<li>" * 50_000, "<a b='>" * 60_000, "<p><div>" * 50_000):
        started = time.process_time()
        walker.read(html + TILE_A)
        assert time.process_time() - started < 10


@pytest.mark.parametrize(
    "html, name, href",
    [
        ('<a class="link" href="/a?x=1&currency=PKR&region=2">N</a>', "N", "/a?x=1&currency=PKR&region=2"),
        ("<a class=link href=/a/>N</a>", "N", "/a/"),
        ('<ul><li><a class="link" href="/a">N<li>other</ul>', "N", "/a"),
        ('<a class="link" href="/a" title="x > y">N &amp; M</a>', "N & M", "/a"),
        ('<a class="link" href="/a">N</a></section></p></i>', "N", "/a"),
        ('<A CLASS="link" HREF="/a">N<!-- <a> --></A>', "N", "/a"),
    ],
)
def test_markup_as_it_is_found(spark, html, name, href):
    page = f'<div class="product-tile"><div class="pdp-link">{html}</div></div>'
    frame = spark.createDataFrame([("b", "c", 0, page)], "brand string, category string, start int, html string")
    tiles = extract_tiles(frame, TILES_A, ["brand"]).first()["tiles"]
    assert [(t["name"], t["href"]) for t in tiles] == [(name, href)]


def test_a_tag_that_never_ends_takes_the_rest(spark):
    page = '<div class="product-tile"><p class="pdp-link"><a class="link" href="/a">N</a></p></div><div class="product-tile" x="'
    tiles, stopped = _TileWalker(TILES_A).read(page)
    assert [t["name"] for t in tiles] == ["N"] and not stopped


@pytest.mark.parametrize(
    "html, root, worth",
    [
        ("<p>nothing here</p>", ".product-tile", False),
        ('<p class="product-tile">', ".product-tile", True),
        ('<p class="no-results">', ".product-tile", True),
        ('<p class="product&#45;tile">', ".product-tile", True),
        ("<p>text</p>", "article", True),  # no class or id to look for
        ("<p>text</p>", ".a, .b", True),
        ("<p>text</p>", ".grid > li.card.big", False),
        ("<p>card</p>", ".grid > li.card.big", True),
        ("<p>text</p>", "#main", False),
        (None, ".product-tile", None),
    ],
)
def test_pages_worth_reading(one, html, root, worth):
    condition = worth_reading(F.col("x"), F.col("root"), F.lit(".no-results"))
    assert one([(html, root)], "x string, root string", condition) == [worth]


def test_two_types_of_one_field_are_refused():
    with pytest.raises(ValueError, match="two types"):
        tile_type(TileSpec(".a", {"x": Field("b", "text")}), TileSpec(".a", {"x": Field("b", "found")}))
