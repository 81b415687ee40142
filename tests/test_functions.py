"""Golden rows of the scalar rules, worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loomcat.functions import details, prices, seasons, text, titles, urls

X = F.col("x")


@pytest.mark.parametrize(
    "name, style, fabric, kind",
    [
        ("3 Piece - Embroidered Karandi Suit", "Embroidered", "Karandi", "3 Piece"),
        ("Printed - Dyed Lawn Shirt", "Dyed", "Lawn", "Shirt"),
        ("2 Piece - Printed Lawn", "Printed", "Lawn", "2 Piece"),
        ("2 Piece - Printed", "Printed", "", "2 Piece"),
        ("Printed Lawn Shirt", "Printed", "Lawn", "Shirt"),
        ("Dyed Kurta", "Dyed", "", "Kurta"),
        ("Printed", "Printed", "", "Printed"),
        ("Lawn 2 Piece", "", "", "2 Piece"),
        ("Printed Lawn 3 Piece", "Printed", "Lawn", "3 Piece"),
        ("Blue Soft Lawn 3 Piece", "", "Blue Soft Lawn", "3 Piece"),
        ("Embroidered Raw Silk Shirt", "Embroidered", "Raw Silk", "Shirt"),
        ("Printed - Dyed Pure Silk Suit", "Dyed", "Pure Silk", "Suit"),
        ("Fine Pima Cotton Kurta", "", "Pima Cotton", "Kurta"),
        ("Blue Cotton Shirt", "", "Blue Cotton", "Shirt"),
        ("Raw Silk", "", "", "Silk"),
        ("Lawn Shirt", "", "", "Shirt"),
        ("printed Lawn Shirt", "", "printed Lawn", "Shirt"),
        ("T-Shirt", "", "", ""),
        ("3 Piece -", "", "", "3 Piece"),
        ("", "", "", ""),
    ],
)
def test_title_fields(spark, name, style, fabric, kind):
    df = titles.with_title_fields(spark.createDataFrame([(name,)], "name string"))
    assert df.select("fabric_style", "fabric_type", "product_type").first() == (style, fabric, kind)


def test_title_case(one):
    rows = [("2pc men's",), ("x_y",), ("ÉCOLE école 3d",), ("",), ("NAVY-blue",)]
    assert one(rows, "x string", text.title_case(X)) == [r[0].title() for r in rows]


def test_words_and_strip(one):
    rows = [("  a  b\t\nc ",), (" a b　",), ("",), ("   ",)]
    assert one(rows, "x string", text.words(X)) == [r[0].split() for r in rows]
    assert one(rows, "x string", text.strip(X)) == [r[0].strip() for r in rows]


def test_round_2dp_matches_exact_rounding(one):
    import random

    rng = random.Random(5)
    values = [2.675, 12.345, 0.125, 0.375, -0.125, 1.005, 100.0, 0.0, -33.335]
    values += [rng.randint(-10**7, 10**7) / 1000 for _ in range(2000)]
    values += [(o - c) / o * 100 for o in range(800, 840) for c in range(700, 900, 7)]
    assert one([(v,) for v in values], "x double", text.round_2dp(X)) == [
        round(v, 2) for v in values
    ]


def test_numbers(one):
    rows = [("1e3",), (" 09 ",), ("nan",), ("inf",), ("1d",), ("",), ("x",), ("-2.5",)]
    assert one(rows, "x string", text.to_double(X)) == [1000, 9, None, None, None, None, None, -2.5]
    rows = [(" 09 ",), ("+9",), ("9.5",), ("",), ("99999999999",)]
    assert one(rows, "x string", text.to_int(X)) == [9, 9, None, None, None]


@pytest.mark.parametrize(
    "url, piece, category",
    [
        ("/collections/one-piece-unstitched/p", "One Piece", "Unstitched"),
        ("/collections/one-piece", "One Piece", "One Piece"),
        ("/collections/men's-2pc/x", "", "Men'S 2Pc"),
        ("/collections/two-piece-three-piece-x", "Two Piece", "Three Piece X"),
        ("/mycollections/x", "", ""),
        ("/a/collections", "", ""),
        ("", "", ""),
    ],
)
def test_collection_path(one, url, piece, category):
    segment = urls.segment_after(X, "collections")
    got = one([(url,)], "x string", urls.piece_info(segment), urls.category_from_collection(segment))
    assert got == [(piece, category)]


def test_sku_from_url(one):
    rows = [("https://s/products/P1.v2.html",), ("/products",), ("/x",)]
    assert one(rows, "x string", urls.sku_from_product_path(X)) == ["P1", "", ""]
    rows = [("/f/AB12_NAVY.html",), ("/f/AB12.html",), ("AB_1.html",)]
    assert one(rows, "x string", urls.sku_from_file_name(X)) == ["AB12_NAVY", "", ""]


def test_urls(one):
    base = F.lit("https://b")
    rows = [("/a?x=1?y",), ("http://c/d?e",), ("//h/i",), ("",), ("?q",)]
    assert one(rows, "x string", urls.normalize_image_url(X, base)) == [
        "https://b/a", "http://c/d", "https://b//h/i", "", "",
    ]


def test_images(one):
    rows = [("d?1", "s"), ("", "s?2"), (None, None), (None, "s")]
    picked = urls.lazy_image(F.col("d"), F.col("s"))
    assert one(rows, "d string, s string", picked) == ["d", "s", "", "s"]
    rows = [("p", "h"), ("", "h"), ("p", ""), ("", "")]
    got = one(rows, "p string, h string", urls.image_pair(F.col("p"), F.col("h")))
    assert got == [["p", "h"], ["h"], ["p"], []]


@pytest.mark.parametrize(
    "original, price, shown, discount, on_sale",
    [
        ("Rs.2,000.00", "Rs.1,500.00", "Rs.2,000.00", 25, True),
        ("\n Rs. 2,000.00 \n off", "Rs.1,500.00", "Rs.2,000.00", 25, True),
        ("Rs.200", "Rs.175", "Rs.200", 12, True),
        ("Rs.200", "Rs.177", "Rs.200", 12, True),
        ("Rs.400", "Rs.390", "Rs.400", 2, True),
        ("Rs.1,000", "Rs.1,250", "Rs.1,000", -25, False),
        (None, "Rs.1,500.00", "Rs.1,500.00", None, False),
        (None, None, "N/A", None, False),
        ("2,000 PKR", "Rs.2,000.00", "2,000", 0, False),
        ("Rs.soon", "Rs.5", "Rs.soon", None, False),
        ("Rs.0", "Rs.5", "Rs.0", None, False),
        ("", "Rs.5", "", None, False),
        ("Rs.nan", "Rs.5", "Rs.nan", None, False),
    ],
)
def test_prices_a(one, original, price, shown, discount, on_sale):
    p = prices.price_text(F.col("p"))
    o = prices.original_price_text(F.col("o"), p)
    d = prices.discount_int(o, p)
    got = one([(original, price)], "o string, p string", o, d, prices.on_sale_a(d))
    assert got == [(shown, discount, on_sale)]


def test_bad_original_price(one):
    rows = [("Rs.",), ("x Rs. \n",), ("Rs.5",), ("5",), ("",), (None,)]
    assert one(rows, "x string", prices.bad_original_price(X)) == [True, True, False, False, False, False]


def test_price_text_b(one):
    rows = [("PKR 3,990",), (" 3,990 PKR ",), ("3 990",), (None,)]
    got = one(rows, "x string", prices.price_text(prices.price_text_b(X)))
    assert got == ["3,990", "3,990", "3 990", "N/A"]


def test_percent_off(one):
    rows = [(3990.0, 4990.0), (4990.0, 4990.0), (0.0, 100.0), (5.0, 0.0), (120.0, 100.0)]
    got = one(rows, "c double, o double", prices.percent_off(F.col("c"), F.col("o")))
    assert got == [20.04, 0.0, 100.0, 0.0, -20.0]


def test_launch_month(one):
    rows = ["09. SEPTEMBER", "25-03", "09-09", "2025-03-01", "7", "SEPT", "", None, "25--3", " 8 "]
    got = one([(r,) for r in rows], "x string", seasons.launch_month(X))
    assert got == [9, 3, 9, 3, 7, None, None, None, None, 8]


@pytest.mark.parametrize(
    "season, month, label",
    [
        ("SUMMER", 9, "Summer 2026"),
        ("FESTIVE", 9, "Fall 2026"),
        ("FESTIVE", None, "Festive 2026"),
        ("FESTIVE", 13, "Festive 2026"),
        ("autumn", 10, "Fall 2026"),
        (None, 1, "Winter 2026"),
        ("  ", 1, "Winter 2026"),
        (None, None, "Collection"),
        ("", 0, "Collection"),
    ],
)
def test_collection_label(one, season, month, label):
    as_of = F.lit(date(2026, 12, 1))
    got = one([(season, month)], "s string, m int", seasons.collection_label(F.col("s"), F.col("m"), as_of))
    assert got == [label]


@pytest.mark.parametrize(
    "as_of, month, expected",
    [
        (date(2026, 12, 5), None, "2026-12"),
        (date(2026, 12, 5), 3, "2026-03"),
        (date(2026, 2, 5), 11, "2025-11"),
        (date(2026, 2, 5), 6, "2026-06"),
        (date(2026, 1, 5), 12, "2025-12"),
        (date(2026, 4, 5), 11, "2026-11"),
        (date(2026, 4, 5), 0, "2026-04"),
    ],
)
def test_launch_time(one, as_of, month, expected):
    assert one([(month,)], "m int", seasons.launch_time(F.col("m"), F.lit(as_of))) == [expected]


def test_ids_sizes_words_slugs(one):
    rows = [("SS1-2PC_RED",), ("25-03E-3PC-VG_X",), ("25-03E-04TB-VG_X",), ("AB12_X",), ("3PC",)]
    assert one(rows, "x string", urls.size_from_sku(X)) == ["2PC", "3PC", "3PC", "3PC", "3PC"]
    rows = [("008",), ("000",), ("3PC",), ("10",), ("",)]
    assert one(rows, "x string", details.size_value(X)) == ["8", "0", "3PC", "10", ""]
    rows = [("A | B c",), ("A|B",), ("",), ("|",), (None,)]
    assert one(rows, "x string", details.words_array(X)) == [["A", "B", "c"], ["AB"], None, [], None]
    rows = [("AB_12_NAVY",), ("AB12",), ("AB_",), ("",), ("A_sky blue",)]
    assert one(rows, "x string", titles.colors_from_sku(X)) == [["Navy"], [], [], [], ["Sky Blue"]]
    assert one([("3 Piece - X",), ("A  B",)], "x string", titles.slug_a(X)) == ["3-piece--x", "a-b"]
    got = one(
        [("Fabrics 3 Piece", "Embroidered | Lawn"), ("Fabrics 3 Piece", "")],
        "x string, b string",
        titles.slug_b(X, F.col("b")),
    )
    assert got == ["fabrics-3-piece-embroidered-lawn", "fabrics-3-piece-"]


def test_image_order(one):
    body = (
        '{"zoom":[{"url":"/z/9.jpg"},{"url":""}],"small":[{"url":"/s/1.jpg?w"},{"url":"/s/3.jpg"}],'
        '"alt":[{"url":"/a/8.jpg"}],"large":[{"url":"/l/1.jpg"},{"url":"https://c/2.jpg"}]}'
    )
    images = F.from_json(X, "map<string,array<struct<url:string>>>")
    got = one([(body,), (None,)], "x string", details.image_order(images, F.lit("https://b")))
    assert got[1] == []
    assert got[0] == [
        "https://b/l/1.jpg", "https://c/2.jpg", "https://b/s/3.jpg", "https://b/z/9.jpg",
        "https://b/a/8.jpg",
    ]


def test_stock_flag(one):
    rows = [(True, None), (False, "IN_STOCK"), (True, "OUT_OF_STOCK"), (True, "PREORDER")]
    got = one(rows, "a boolean, s string", prices.stock_flag(F.col("a"), F.col("s")))
    assert got == [True, True, False, True]
