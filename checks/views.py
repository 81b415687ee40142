"""Catalogue inputs derived from the given tables, in SQL that Spark and DuckDB both run.

Each view carries raw inputs (texts as a storefront would show them) next to the values they were
made from. Queries read only the raw inputs; the comparison SQL reads only the known values.
Variants are assigned to rows by key arithmetic; no view leaves rows out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcat.session import materialize

BASE_A = "https://shop-a.example"
BASE_B = "https://shop-b.example"
AS_OF = "2026-02-15"
PAGE_A, PAGE_B = 12, 32


def _int(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _money(amount: str) -> str:
    return (
        f"CASE WHEN {amount} >= 1000 THEN {_text(_int(f'{amount} / 1000'))} || ',' || "
        f"lpad({_text(f'{amount} % 1000')}, 3, '0') ELSE {_text(amount)} END"
    )


def _capital(word: str) -> str:
    return f"upper(substr({word}, 1, 1)) || substr({word}, 2)"


VIEWS: dict[str, str] = {}

VIEWS["base"] = f"""
SELECT p_partkey AS k, p_brand, p_type,
  {_capital("split_part(p_name, ' ', 1)")} AS w1, {_capital("split_part(p_name, ' ', 2)")} AS w2,
  CAST(round(p_retailprice) AS BIGINT) * (1 + p_partkey % 4) AS r,
  CAST(coalesce(s, 0) % 50 AS BIGINT) AS dpct
FROM @part LEFT JOIN
  (SELECT l_partkey, sum(l_linenumber) AS s FROM @lineitem GROUP BY l_partkey) d
  ON p_partkey = l_partkey
"""

VIEWS["va0"] = f"""
SELECT *, CASE k % 6 WHEN 0 THEN 'Printed' WHEN 1 THEN 'Embroidered' WHEN 2 THEN 'Dyed'
    WHEN 3 THEN 'Digital' WHEN 4 THEN 'Embellished' ELSE '' END AS style,
  k % 7 AS form, k % 8 AS path, CASE WHEN k % 11 = 0 THEN '  ' ELSE ' ' END AS gap,
  CASE WHEN k % 53 = 0 THEN r + 100 ELSE r - {_int("r * dpct / 100")} END AS c,
  {_int(f"k / {PAGE_A * 30}")} AS cat_no, {_int(f"(k % {PAGE_A * 30}) / {PAGE_A}")} AS page_no,
  k % {PAGE_A} AS pos, {_int(f"k / {PAGE_A}")} AS page_id
FROM base
"""

VIEWS["va1"] = f"""
SELECT *, 'shop_a_' || {_text(_int("cat_no / 2"))} AS brand, {_int("cat_no / 2")} AS brand_no,
  'cat_' || {_text("cat_no")} AS page_category, page_no * {PAGE_A} AS start,
  page_id % 31 <> 17 AS ok, page_id % 37 = 20 AS no_results,
  page_id % 41 = 33 OR page_id % 157 = 120 AS missing,
  CASE WHEN style = '' THEN '' ELSE style || gap END AS lead,
  k % 997 <> 500 AS named, k % 991 = 480 AS bad_price,
  CASE WHEN k % 10 = 0 THEN NULL ELSE 'A' || {_text("k")} END AS tile_pid,
  CASE k % 5 WHEN 0 THEN 'Summer ' || p_type WHEN 1 THEN 'Winter ' || p_type
    WHEN 2 THEN 'Soft Spring' WHEN 3 THEN 'Fall' ELSE 'Classic ' || w1 END AS subtitle,
  CASE path
    WHEN 0 THEN '/collections/one-piece-unstitched/products/P' || {_text("k")} || '.html'
    WHEN 1 THEN '/collections/two-piece-' || lower(w1) || '-wear/products/P' || {_text("k")} || '.html'
    WHEN 2 THEN '/collections/three-piece/products/P' || {_text("k")} || '.html'
    WHEN 3 THEN 'https://other.example/collections/men' || chr(39) || 's-2pc/products/P' || {_text("k")} || '.html'
    WHEN 4 THEN '/mycollections/x/products/P' || {_text("k")} || '.html'
    WHEN 5 THEN '/products/P' || {_text("k")} || '.v2.html'
    WHEN 6 THEN ''
    ELSE '/collections/' || lower(w2) || '/P' || {_text("k")} END AS href,
  CASE k % 9 WHEN 0 THEN NULL ELSE 'Rs.' || {_money("c")} || '.00' END AS price_raw,
  CASE WHEN k % 991 = 480 THEN 'Rs.' WHEN k % 9 < 2 THEN NULL
    WHEN k % 9 = 8 THEN {_money("r")} || ' PKR'
    ELSE chr(10) || ' Rs. ' || {_money("r")} || '.00 ' || chr(10) || ' off' END AS original_raw,
  k % 4 AS pics, k % 12 AS stock
FROM va0
"""

# Known values of dialect A: *_x columns never come from reading the texts above.
VIEWS["va"] = f"""
SELECT *,
  CASE form WHEN 0 THEN '3 Piece - ' || lead || w1 || ' ' || w2
    WHEN 1 THEN w1 || ' - ' || lead || w2
    WHEN 2 THEN lead || w1 || ' ' || w2
    WHEN 3 THEN lead || w1 || ' 2 Piece'
    WHEN 4 THEN lead || w1 || ' Raw Silk ' || w2
    WHEN 5 THEN lead || 'Pima Cotton ' || w2
    ELSE lead || w1 || ' ' || w2 || ' Suit' END AS name,
  style AS style_x,
  CASE form WHEN 0 THEN CASE WHEN style = '' THEN '' ELSE w1 END
    WHEN 1 THEN CASE WHEN style = '' THEN '' ELSE w2 END
    WHEN 2 THEN CASE WHEN style = '' THEN '' ELSE w1 END
    WHEN 3 THEN CASE WHEN style = '' THEN '' ELSE w1 END
    WHEN 4 THEN 'Raw Silk' WHEN 5 THEN 'Pima Cotton' ELSE w1 || ' ' || w2 END AS fabric_x,
  CASE form WHEN 0 THEN '3 Piece' WHEN 1 THEN '' WHEN 3 THEN '2 Piece' WHEN 6 THEN 'Suit'
    ELSE w2 END AS type_x,
  coalesce(tile_pid, CASE WHEN path < 6 THEN 'P' || {_text("k")} ELSE '' END) AS sku_x,
  CASE path WHEN 0 THEN 'Unstitched' WHEN 1 THEN w1 || ' Wear' WHEN 2 THEN 'Three Piece'
    WHEN 3 THEN 'Men' || chr(39) || 'S 2Pc' WHEN 7 THEN w2 ELSE subtitle END AS category_x,
  CASE k % 5 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' WHEN 3 THEN 'Fall'
    ELSE '' END AS collection_x,
  CASE path WHEN 0 THEN 'One Piece' WHEN 1 THEN 'Two Piece' WHEN 2 THEN 'Three Piece'
    ELSE '' END AS piece_x,
  CASE WHEN path = 6 THEN '' WHEN path = 3 THEN href ELSE '{BASE_A}' || href END AS url_x,
  CASE pics WHEN 0 THEN '/i/' || {_text("k")} || '.jpg|/i/' || {_text("k")} || 'b.jpg'
    WHEN 1 THEN '/i/' || {_text("k")} || '.jpg'
    WHEN 2 THEN '/s/' || {_text("k")} || '.jpg' ELSE '' END AS img_x,
  CASE WHEN price_raw IS NULL THEN 'N/A' ELSE 'Rs.' || {_money("c")} || '.00' END AS price_x,
  CASE WHEN k % 9 = 0 THEN 'N/A' WHEN k % 9 = 1 THEN 'Rs.' || {_money("c")} || '.00'
    WHEN k % 9 = 8 THEN {_money("r")} ELSE 'Rs.' || {_money("r")} || '.00' END AS original_x,
  CASE WHEN k % 9 > 1 AND (k % 9 = 8 OR r <> c)
    THEN (CAST(r AS DOUBLE) - CAST(c AS DOUBLE)) / CAST(r AS DOUBLE) * 100.0 END AS off_x,
  stock NOT IN (0, 5) AS in_stock_x,
  named AND NOT bad_price AS usable_x
FROM va1
"""

VIEWS["vb0"] = f"""
SELECT *, k % 8 AS form, {_int("k / 8")} % 6 AS tag, {_int("k / 48")} % 4 AS place,
  r - {_int("r * dpct / 100")} AS c,
  {_int(f"k / {PAGE_B * 20}")} AS cat_no, {_int(f"(k % {PAGE_B * 20}) / {PAGE_B}")} AS page_no,
  k % {PAGE_B} AS pos, {_int(f"k / {PAGE_B}")} AS page_id,
  'P' || {_text("k")} || CASE k % 5 WHEN 0 THEN '-3PC' WHEN 1 THEN '-2PC' WHEN 2 THEN '-1PC-VG'
    WHEN 3 THEN '-04TB-VG' ELSE '' END AS code,
  CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 1 THEN '_SKY-BLUE' ELSE '_' || upper(w1) END AS suffix,
  CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 1 THEN 'Sky-Blue' ELSE w1 END AS color_x
FROM base
"""

VIEWS["vb1"] = f"""
SELECT *, page_no * {PAGE_B} AS start, page_id % 23 <> 15 AS ok, page_id % 29 = 12 AS no_results,
  page_id % 39 = 17 OR page_id % 97 = 40 AS missing,
  'shop_b_' || {_text(_int("cat_no / 3"))} AS brand, {_int("cat_no / 3")} AS brand_no,
  CASE WHEN cat_no % 3 = 0 THEN 'fabrics' ELSE 'ready_' || {_text("cat_no")} END AS page_category,
  code || suffix AS sku_full, k % 983 <> 100 AS named, k % 991 = 300 AS odd_tag,
  CASE form WHEN 0 THEN 'Fabrics 3 Piece' WHEN 1 THEN 'Ready to Wear Shirt'
    WHEN 2 THEN w1 || ' RTW 2 Piece' WHEN 3 THEN w1 || ' ' || w2 WHEN 4 THEN w1 || ' 3 Piece'
    WHEN 5 THEN '3 Piece' WHEN 6 THEN 'Embroidered ' || w2 ELSE w1 || ' Fabrics' END AS name,
  CASE WHEN k % 991 = 300 THEN '[1]' WHEN tag = 0 THEN '{{"category":"Fabrics"}}'
    WHEN tag = 1 THEN '{{"category":"' || p_type || '","price":' || {_text("r")} || '}}'
    WHEN tag = 2 THEN '{{}}' WHEN tag = 3 THEN '{{bad' WHEN tag = 4 THEN NULL
    ELSE '{{"name":"x"}}' END AS tag_raw,
  CASE k % 4 WHEN 0 THEN 'Embroidered | Lawn' WHEN 1 THEN '' WHEN 2 THEN 'Printed Silk' END AS brand_text,
  CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN {_money("c")} ELSE 'PKR ' || {_money("c")} END AS price_raw,
  CASE WHEN k % 2 = 0 THEN ' ' || {_money("r")} || ' PKR ' END AS original_raw
FROM vb0
"""

VIEWS["vb"] = f"""
SELECT *,
  CASE WHEN place IN (0, 3) THEN CASE WHEN place = 3 THEN '' ELSE sku_full END END AS parent_pid,
  CASE WHEN place IN (1, 3) THEN sku_full END AS tile_pid,
  CASE WHEN k % 2 = 0 THEN '/fabrics-3-piece/' || sku_full || '.html'
    ELSE 'https://b.example/x/' || sku_full || '.v2.html' END AS href,
  CASE WHEN k % 2 = 0 THEN '{BASE_B}/fabrics-3-piece/' || sku_full || '.html'
    ELSE 'https://b.example/x/' || sku_full || '.v2.html' END AS url_x,
  CASE WHEN place < 2 OR suffix <> '' THEN sku_full ELSE '' END AS sku_x,
  CASE form WHEN 0 THEN '3 Piece' WHEN 1 THEN 'Shirt' WHEN 2 THEN '2 Piece' WHEN 4 THEN '3 Piece'
    WHEN 5 THEN '3 Piece' WHEN 7 THEN 'Fabrics' ELSE w2 END AS type_x,
  CASE WHEN form IN (0, 7) THEN 'Unstitched' WHEN form IN (1, 2) THEN 'Ready to Wear'
    END AS name_category_x,
  CASE WHEN tag = 0 THEN 'Unstitched' WHEN tag = 1 THEN p_type
    WHEN cat_no % 3 = 0 THEN 'Unstitched' ELSE page_category END AS listed_category_x,
  replace(lower(name), ' ', '-') || CASE k % 4 WHEN 0 THEN '-embroidered-lawn'
    WHEN 2 THEN '-printed-silk' ELSE '-' END AS slug_x,
  CASE k % 5 WHEN 0 THEN '3PC' WHEN 1 THEN '2PC' WHEN 2 THEN '1PC' ELSE '3PC' END AS code_size_x,
  CASE WHEN k % 9 = 0 THEN 'N/A' ELSE {_money("c")} END AS price_x,
  CASE WHEN k % 2 = 0 THEN {_money("r")} WHEN k % 9 = 0 THEN 'N/A' ELSE {_money("c")} END AS original_x,
  named AND NOT (odd_tag AND form NOT IN (0, 1, 2, 7)) AS usable_x
FROM vb1
"""

# Known values of the detail documents.
VIEWS["vd"] = f"""
SELECT vb.*, k % 5 <> 4 AS captured, k % 8 AS pricing, k % 3 AS album, k % 4 AS variation,
  k % 10 <> 9 AS has_custom, k % 12 + 1 AS m, k % 7 AS launch_form, k % 11 % 5 AS season_no,
  CASE WHEN k % 14 = 0 THEN 'failed' WHEN k % 29 = 3 THEN 'empty' WHEN k % 31 = 4 THEN 'broken'
    WHEN k % 37 = 5 THEN 'bare' WHEN k % 41 = 6 THEN 'nulled' WHEN k % 43 = 7 THEN 'list'
    WHEN k % 47 = 8 THEN 'no images' WHEN k % 53 = 9 THEN 'no values'
    ELSE 'full' END AS doc,
  CASE k % 6 WHEN 0 THEN 'Fabrics ' || w1 WHEN 1 THEN w1 || ' RTW' WHEN 3 THEN 'Ready ' || w2
    WHEN 4 THEN w1 || ' ' || w2 ELSE '' END AS d_name,
  CASE k % 6 WHEN 0 THEN 'Unstitched' WHEN 1 THEN 'Ready to Wear' WHEN 3 THEN 'Ready to Wear' END AS d_name_category
FROM vb
"""

VIEWS["vdx0"] = """
SELECT *, captured AND (doc = 'bare' OR (doc = 'full' AND pricing <> 4)) AS enriched_x,
  doc <> 'bare' AS has_doc,
  CAST(CASE WHEN doc = 'bare' THEN 0 WHEN pricing IN (0, 1, 5) THEN c WHEN pricing = 7 THEN r
    ELSE 0 END AS DOUBLE) AS current_x,
  CAST(CASE WHEN doc = 'bare' THEN 0 WHEN pricing IN (1, 5) THEN c
    WHEN pricing IN (0, 2, 6, 7) THEN r ELSE 0 END AS DOUBLE) AS original_d_x,
  CASE WHEN doc <> 'bare' AND has_custom AND launch_form < 5 THEN m END AS month_x,
  CASE WHEN doc <> 'bare' AND has_custom THEN CASE season_no WHEN 0 THEN 'Summer'
    WHEN 1 THEN 'Festive' WHEN 2 THEN 'Autumn' END END AS season_x
FROM vd
"""

VIEWS["vdx"] = f"""
SELECT *, CASE WHEN original_d_x > 0 AND original_d_x <> current_x
    THEN (original_d_x - current_x) / original_d_x * 100.0 END AS off_x,
  CASE WHEN month_x IN (12, 1, 2) THEN 'Winter' WHEN month_x IN (3, 4, 5) THEN 'Spring'
    WHEN month_x IN (6, 7, 8) THEN 'Summer' WHEN month_x IS NOT NULL THEN 'Fall' END AS month_season_x,
  CASE WHEN coalesce(month_x, 2) >= 10 THEN '2025-' ELSE '2026-' END
    || lpad({_text("coalesce(month_x, 2)")}, 2, '0') AS launch_time_x,
  CASE WHEN has_doc THEN d_name ELSE '' END AS d_name_x,
  CASE WHEN NOT has_doc THEN '' WHEN album = 0 THEN '{BASE_B}/l/' || code || '-1.jpg|https://cdn.example/'
      || code || '-2.jpg|{BASE_B}/s/' || code || '-3.jpg|{BASE_B}/z/' || code || '-9.jpg'
    WHEN album = 1 THEN '{BASE_B}/h/' || code || '.jpg|{BASE_B}/o/' || code || '-q.jpg'
    ELSE '' END AS images_x,
  CASE WHEN has_doc AND variation IN (0, 3) THEN w1 || '|Blue' ELSE '' END AS colors_x,
  CASE WHEN NOT has_doc THEN '' WHEN variation = 0 THEN '8|3PC' WHEN variation = 1 THEN '0|M'
    ELSE '' END AS sizes_x,
  CASE WHEN NOT has_doc THEN false WHEN variation IN (0, 1) THEN true ELSE false END AS in_stock_x,
  CASE WHEN NOT has_doc OR k % 3 = 0 THEN 0 ELSE k % 20 END AS remaining_x,
  has_doc AND k % 2 = 0 AS is_new_x,
  CAST(CASE WHEN has_doc AND k % 3 = 1 THEN 4.5 ELSE 0.0 END AS DOUBLE) AS rating_x,
  CASE WHEN has_doc AND k % 4 = 0 THEN 'Soft|Lawn|suit' END AS short_x,
  CASE WHEN has_doc THEN 'Long text ' || w1 ELSE '' END AS long_x,
  CASE WHEN has_doc AND has_custom THEN 'Lawn|Cotton' END AS top_x,
  CASE WHEN has_doc AND has_custom THEN 'Raw|Silk' END AS main_x,
  CASE WHEN has_doc AND has_custom THEN 'AB' END AS material_x,
  CASE WHEN has_doc AND has_custom AND k % 2 = 0 THEN 'Casual' ELSE '' END AS concept_x,
  CASE WHEN has_doc THEN w2 ELSE '' END AS d_type_x,
  CASE WHEN NOT has_doc THEN '' ELSE coalesce(d_name_category, CASE k % 5 WHEN 0 THEN 'Unstitched'
    WHEN 1 THEN p_type ELSE '' END) END AS d_category_x
FROM vdx0
"""

VIEWS["vdy"] = """
SELECT *, CASE WHEN season_x IN ('Summer', 'Autumn') THEN CASE WHEN season_x = 'Autumn' THEN 'Fall' ELSE season_x END
    ELSE coalesce(month_season_x, season_x) END AS shown_season_x,
  coalesce(CASE WHEN k % 6 IN (0, 1, 3) AND has_doc THEN d_name_category END,
    name_category_x, listed_category_x) AS enriched_category_x
FROM vdx
"""

VIEWS["runs"] = f"""
SELECT {_text(_int("o_orderkey / 2"))} AS id, o_orderpriority AS brand,
  CAST(o_orderkey % 40 AS BIGINT) AS item_count, o_orderdate AS scraped_at,
  'completed' AS status, o_orderkey AS seq
FROM @orders
"""

VIEWS["items"] = f"""
SELECT o_orderpriority AS brand,
  {_text("year(o_orderdate)")} || lpad({_text("month(o_orderdate)")}, 2, '0') || substr(o_orderpriority, 1, 1) AS scrape_id,
  lpad({_text("l_orderkey")}, 12, '0') || lpad({_text("l_linenumber")}, 3, '0')
    || lpad({_text("l_partkey")}, 12, '0') || lpad({_text("l_suppkey")}, 12, '0')
    || lpad({_text(_int("l_extendedprice * 100 + 0.5"))}, 14, '0') AS item_no,
  'S' || {_text("l_partkey")} AS sku, 'Item ' || {_text("l_suppkey")} AS name,
  l_returnflag AS category, l_linestatus AS status, {_text(_int("l_quantity"))} AS price,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month_no
FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey
"""

VIEWS["month_runs"] = """
SELECT scrape_id AS id, brand, count(*) AS item_count, max(month_no) AS scraped_at,
  'completed' AS status, max(month_no) AS seq
FROM items GROUP BY scrape_id, brand
"""

VIEWS["config_files"] = f"""
SELECT s_suppkey AS n, 'supplier_' || lpad({_text("s_suppkey")}, 6, '0') AS slug,
  s_suppkey % 3 <> 0 OR s_suppkey % 5 = 0 AS in_new, s_suppkey % 3 = 0 AS in_old,
  s_suppkey % 11 = 0 AS broken_new, s_suppkey % 13 = 0 AS broken_old,
  1 + s_suppkey % 3 AS n_categories, (s_suppkey % 4) * 5 AS product_limit,
  CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 32 END AS page_size, n_name
FROM @supplier JOIN @nation ON s_nationkey = n_nationkey
"""

VIEWS["dim"] = f"""
SELECT 'id-' || {_text("s_suppkey")} AS id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'BRAND#' ELSE 'brand#' END || {_text("s_suppkey % 20")} AS name,
  'https://logo.example/' || {_text("s_suppkey")} AS logo_url, s_suppkey AS seq
FROM @supplier
"""

VIEWS["listing"] = f"""
SELECT k AS id, p_brand AS brand, sku_x AS sku, name, type_x AS product_type,
  category_x AS category, CASE WHEN k % 5 = 0 THEN lower(w1) || '-cloth' ELSE '' END AS fabric_slug,
  style_x AS fabric_style, fabric_x AS fabric_type, CASE WHEN k % 3 = 0 THEN w1 ELSE '' END AS color,
  price_x AS price, CASE WHEN k % 8 = 0 THEN '' ELSE original_x END AS original_price,
  CAST(dpct AS BIGINT) AS discount_percentage,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Sale' ELSE 'In Stock' END AS status,
  coalesce(date_trunc('second', ts), TIMESTAMP '2020-01-01 00:00:00') AS created_at,
  CASE WHEN k % 2 = 0 THEN NULL ELSE '/p/' || {_text("k")} END AS primary_image_url,
  CASE WHEN k % 7 = 0 THEN NULL ELSE '/old/' || {_text("k")} END AS image_url
FROM va LEFT JOIN @events ON event_id = k
"""


# What the shops of dialect B with another markup configure.
OTHER_MARKUP = {
    "product_selector": "article.card",
    "name_selector": "h3.title",
    "product_brand_selector": ".maker",
    "pdp_link_selector": "a.go",
    "price_selector": ".cost > .now",
    "original_price_selector": ".cost .was",
}
VIEWS["shops_a"] = f"""
SELECT brand, max(brand_no) AS brand_no, 'id_' || brand AS brand_id, '{BASE_A}' AS base_url,
  {PAGE_A} AS page_size, count(DISTINCT page_category) AS n_categories,
  CASE max(brand_no) % 4 WHEN 0 THEN 50 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 101 END AS product_limit
FROM va GROUP BY brand
"""
_selectors = ", ".join(
    f"CASE WHEN max(brand_no) % 2 = 1 THEN '{selector}' END AS {column}" for column, selector in OTHER_MARKUP.items()
)
VIEWS["shops_b"] = f"""
SELECT brand, max(brand_no) AS brand_no, 'id_' || brand AS brand_id, '{BASE_B}' AS base_url,
  {PAGE_B} AS page_size, count(DISTINCT page_category) AS n_categories,
  CASE max(brand_no) % 4 WHEN 0 THEN 50 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 101 END AS product_limit,
  max(brand_no) % 4 <> 1 AS enhance_with_details, {_selectors}
FROM vb GROUP BY brand
"""
# Ids of some shops, written in another case and with an older id first.
VIEWS["shop_dim"] = f"""
SELECT CASE WHEN seq = 1 THEN 'old_' ELSE 'dim_' END || brand AS id, upper(brand) AS name, CAST(seq AS BIGINT) AS seq
FROM (SELECT brand, brand_no FROM shops_a UNION ALL SELECT brand, brand_no FROM shops_b) s
CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 AS seq) n
WHERE brand_no % 3 <> 0
"""
for _view, _size in (("va", PAGE_A), ("vb", PAGE_B)):
    _side = _view[1]
    # The stop rule as a running window, for comparison only.
    VIEWS[f"page_counts_{_side}"] = f"""
SELECT brand, cat_no, page_category, start, ok AND NOT missing AS ok, no_results,
  CAST(sum(CASE WHEN usable_x THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM {_view} GROUP BY brand, cat_no, page_category, start, ok, missing, no_results
"""
    VIEWS[f"kept_pages_{_side}"] = f"""
SELECT brand, page_category, start, n FROM (
  SELECT *, coalesce(min(CASE WHEN ok AND NOT no_results AND n >= {_size} THEN 1 ELSE 0 END) OVER (
    PARTITION BY brand, page_category ORDER BY start
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS clear FROM page_counts_{_side}) w
WHERE clear = 1 AND ok AND NOT no_results AND n > 0
"""
    VIEWS[f"kept_{_side}"] = f"""
SELECT v.* FROM {_view} v JOIN kept_pages_{_side} p
  ON v.brand = p.brand AND v.page_category = p.page_category AND v.start = p.start
WHERE usable_x
"""
    # Shares and limits as running numbers over products, for comparison only.
    VIEWS[f"limited_{_side}"] = f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY brand ORDER BY cat_no, start, pos) AS nth_of_brand FROM (
    SELECT v.*, product_limit, CASE WHEN product_limit <= 0 THEN 0 WHEN n_categories <= 1 THEN product_limit
        ELSE CAST(floor(product_limit / n_categories) AS BIGINT) END AS quota,
      row_number() OVER (PARTITION BY v.brand, page_category ORDER BY start, pos) AS nth
    FROM kept_{_side} v JOIN shops_{_side} s ON v.brand = s.brand) q WHERE quota = 0 OR nth <= quota) g
WHERE product_limit = 0 OR nth_of_brand <= product_limit
"""


def _needed(sql: str) -> list[str]:
    """Views a text uses, each after those it is built on."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                if name not in needed:
                    visit(VIEWS[name])
                    needed.append(name)

    visit(sql)
    return list(dict.fromkeys(needed))


def with_views(sql: str) -> str:
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql)]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


def duckdb_sql(sql: str) -> str:
    """A query over views for the comparison engine."""
    return re.sub(r"@(\w+)", r"\1", with_views(sql))


def spark_rows(spark: SparkSession, sf_dir: str, sql: str, base: str | None = None) -> DataFrame:
    """The same over the Parquet files; ``base`` names a temporary view that holds the rows of ``base``."""
    text = with_views(sql)
    if base:
        text = text.replace(VIEWS["base"].strip(), f"SELECT * FROM {base}")
    return spark.sql(re.sub(r"@(\w+)", rf"parquet.`{sf_dir}/\1.parquet`", text))


@contextmanager
def shared_base(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """Name of a view of the rows of ``base``, joined and written once for several readers."""
    name = f"base_{uuid.uuid4().hex}"
    materialize(spark_rows(spark, sf_dir, "SELECT * FROM base"), "base").createTempView(name)
    try:
        yield name
    finally:
        spark.catalog.dropTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rendering: raw inputs to the HTML and JSON a storefront would have sent.

_ATTRIBUTE = """CASE WHEN {value} IS NULL THEN '' ELSE ' {name}="' || replace({value}, '"', '&quot;') || '"' END"""


def _attribute(name: str, value: str) -> str:
    return _ATTRIBUTE.format(name=name, value=value)


TILE_A = f"""
'<div class="product-tile"' || {_attribute("data-pid", "tile_pid")} || '><div class="plp-dual-image">'
|| CASE pics
  WHEN 0 THEN '<img class="tile-image" data-src="/i/' || k || '.jpg?sw=300"><img class="hover-image" data-src="/i/' || k || 'b.jpg?sw=300">'
  WHEN 1 THEN '<img class="tile-image" src="/i/' || k || '.jpg?sw=300&amp;q=1">'
  WHEN 2 THEN '<img class="tile-image" data-src="" src="/s/' || k || '.jpg"/>'
  ELSE '' END
|| '</div>' || CASE WHEN named THEN '<div class="pdp-link"><a class="link" href="' || href || '"> ' || name || '</a></div>' ELSE '<div class="pdp-link"></div>' END
|| '<div class="subtitle">' || subtitle || '</div><div class="price">'
|| CASE WHEN price_raw IS NULL THEN '' ELSE '<span class="sales"><span class="value">' || price_raw || '</span></span>' END
|| CASE WHEN original_raw IS NULL THEN '' ELSE '<del><span class="strike value">' || original_raw || '</span></del>' END
|| '</div>' || CASE stock WHEN 0 THEN '<div class="badge-wrapper"><i class="sold-out">Sold out</i></div>'
  WHEN 5 THEN '<span class="span-sold-out">Sold out</span>' ELSE '<div class="badge-wrapper"></div>' END || '</div>'
"""

TILE_B = f"""
'<div class="grid"' || {_attribute("data-pid", "parent_pid")} || {_attribute("data-gtmdata", "tag_raw")}
|| '><div class="product-tile"' || {_attribute("data-pid", "tile_pid")} || '><div class="pdp-link"><a class="link" href="' || href || '">'
|| CASE WHEN named THEN '<h2 class="pdp-link-heading">' || name || '</h2>' ELSE '' END || '</a></div>'
|| CASE WHEN brand_text IS NULL THEN '' ELSE '<div class="product-brand"><span class="text-truncate"> ' || brand_text || ' </span></div>' END
|| '<div class="price">'
|| CASE WHEN original_raw IS NULL THEN '' ELSE '<span class="strike-through"><span class="value">' || original_raw || '</span></span>' END
|| CASE WHEN price_raw IS NULL THEN '' ELSE '<span class="sales"><span class="value">' || price_raw || '</span></span>' END
|| '</div></div></div>'
"""


# The same tile in the markup that OTHER_MARKUP reads; it has HTML that is not quite well-formed.
TILE_B_OTHER = f"""
'<li class=shelf' || {_attribute("data-pid", "parent_pid")} || {_attribute("data-gtmdata", "tag_raw")}
|| '><article class="wide card"' || {_attribute("data-pid", "tile_pid")} || '><a class="go" href=' || href || '>'
|| CASE WHEN named THEN '<h3 class="title">' || name || '</h3>' ELSE '' END || '</a>'
|| CASE WHEN brand_text IS NULL THEN '' ELSE '<em class="maker"> ' || brand_text || ' </em>' END
|| '<div class="cost"><i><b class="now">not a child</b></i>'
|| CASE WHEN original_raw IS NULL THEN '' ELSE '<s><b class="was">' || original_raw || '</b></s>' END
|| CASE WHEN price_raw IS NULL THEN '' ELSE '<b class="now">' || price_raw || '</b>' END
|| '</div></section></article>'
"""


def rendered_pages(
    spark: SparkSession, sf_dir: str, view: str, tile: str, captured: bool = False, base: str | None = None
) -> DataFrame:
    """Listing pages of all rows of a view; a page holds one page's worth of tiles.

    ``captured`` leaves out the pages that nobody has captured, as a harvest would find them.
    """
    where = " WHERE NOT missing" if captured else ""
    tiles = spark_rows(spark, sf_dir, f"SELECT * FROM {view}{where}", base).select(
        "brand",
        F.col("page_category").alias("category"),
        F.col("start").cast("int").alias("start"),
        "ok",
        "no_results",
        F.col("pos"),
        F.expr(tile).alias("_tile"),
    )
    # A fixed number of partitions: reading HTML costs far more than its bytes suggest, so AQE
    # should not put all pages into few tasks as it would for plain rows of this size.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = tiles.repartition(width, "brand", "category", "start")
    pages = spread.groupBy("brand", "category", "start", "ok", "no_results").agg(
        F.array_sort(F.collect_list(F.struct("pos", "_tile"))).alias("_tiles")
    )
    marker = F.when(F.col("no_results"), '<p class="no-results">nothing</p>').otherwise("")
    body = F.array_join(F.col("_tiles._tile"), "\n")
    html = F.concat(F.lit("<html><body><div class='row'>"), marker, body, F.lit("</div></body></html>"))
    return pages.select("brand", "category", "start", "ok", html.alias("html"))


def pages_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_pages(spark, sf_dir, "va", TILE_A)


def pages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_pages(spark, sf_dir, "vb", TILE_B)


def captured_a(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """What a harvest of the dialect-A shops has to read: some pages are missing, also first ones."""
    return rendered_pages(spark, sf_dir, "va", TILE_A, captured=True, base=base)


def captured_b(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """The same of dialect B, where some shops use another markup."""
    tile = f"CASE WHEN brand_no % 2 = 1 THEN {TILE_B_OTHER} ELSE {TILE_B} END"
    return rendered_pages(spark, sf_dir, "vb", tile, captured=True, base=base)


DOCUMENT = """
CASE doc WHEN 'failed' THEN '' WHEN 'empty' THEN NULL WHEN 'broken' THEN '{"product": {"productName"'
  WHEN 'bare' THEN '{}' WHEN 'nulled' THEN '{"product":{"productName":"x","custom": null}}'
  WHEN 'list' THEN '[1]' WHEN 'no images' THEN '{"product":{"productName":"x","images":{"small":[],"large": null}}}'
  WHEN 'no values' THEN '{"product":{"productName":"x","variationAttributes":[{"id":"fit","values":null},{"id":"size","values": null}]}}' ELSE
'{"product":{' || CASE album
  WHEN 0 THEN '"images":{"zoom":[{"url":"/z/' || code || '-9.jpg"},{"url":""}],"small":[{"url":"/s/' || code || '-1.jpg?sw=1"},{"url":"/s/' || code || '-3.jpg"}],"large":[{"url":"/l/' || code || '-1.jpg?x"},{"url":"https://cdn.example/' || code || '-2.jpg"}]},'
  WHEN 1 THEN '"images":{"other":[{"url":"/o/' || code || '.jpg"},{"url":"/o/' || code || '-q.jpg"}],"hi-res":[{"url":"/h/' || code || '.jpg"}]},'
  ELSE '' END
|| CASE variation
  WHEN 0 THEN '"variationAttributes":[{"id":"color","values":[{"displayValue":"' || w1 || '"},{"displayValue":"Blue"}]},{"id":"size","values":[{"displayValue":"008"},{"displayValue":"3PC"}]}],'
  WHEN 1 THEN '"variationAttributes":[{"id":"size","values":[{"displayValue":"001"}]},{"id":"size","values":[{"displayValue":"000"},{"displayValue":"M"}]}],'
  WHEN 3 THEN '"variationAttributes":[{"id":"color","values":[{"displayValue":"' || w1 || '"},{"displayValue":"Blue"}]}],'
  ELSE '' END
|| CASE WHEN has_custom THEN '"custom":{"top_fabric_attribute":"Lawn | Cotton","main_fabric_attribute":"Raw  Silk","material":"A|B","technique":"","launch":"'
  || launch || '"' || CASE season_no WHEN 0 THEN ',"season_attribute":"SUMMER"' WHEN 1 THEN ',"season_attribute":" FESTIVE"'
  WHEN 2 THEN ',"season_attribute":"autumn"' WHEN 3 THEN ',"season_attribute":""' ELSE '' END
  || CASE WHEN k % 2 = 0 THEN ',"productConcept":"Casual"' ELSE '' END || '},' ELSE '' END
|| CASE pricing WHEN 0 THEN '"price":{"sales":{"value":' || c || '},"list":{"value":' || r || '.0}},'
  WHEN 1 THEN '"price":{"sales":{"value":' || c || ',"currency":"PKR"},"list":null},'
  WHEN 2 THEN '"price":{"list":{"value":' || r || '}},' WHEN 3 THEN '"price":null,'
  WHEN 4 THEN '"price":{"sales":{"value":null},"list":{"value":5}},'
  WHEN 5 THEN '"price":{"sales":{"value":' || c || '},"list":{"value":0}},'
  WHEN 6 THEN '"price":{"sales":{"value":0},"list":{"value":' || r || '}},'
  ELSE '"price":{"sales":{"value":' || r || '},"list":{"value":' || r || '}},' END
|| CASE variation WHEN 0 THEN '"available":true,' WHEN 1 THEN '"available":false,"availableStatus":"IN_STOCK",'
  WHEN 2 THEN '"available":true,"availableStatus":"OUT_OF_STOCK",' ELSE '' END
|| CASE WHEN k % 3 = 0 THEN '' ELSE '"maxOrderQuantity":' || (k % 20) || ',' END
|| CASE WHEN k % 2 = 0 THEN '"isNew":true,' ELSE '' END
|| CASE WHEN k % 3 = 1 THEN '"rating":4.5,' ELSE '' END
|| CASE k % 4 WHEN 0 THEN '"shortDescription":"Soft | Lawn suit",' WHEN 1 THEN '"shortDescription":"",' ELSE '' END
|| CASE k % 5 WHEN 0 THEN '"gtmData":{"category":"Fabrics"},' WHEN 1 THEN '"gtmData":{"category":"' || p_type || '"},' ELSE '' END
|| CASE WHEN k % 6 = 2 THEN '' ELSE '"productName":"' || d_name || '",' END
|| '"productType":"' || w2 || '","longDescription":"Long text ' || w1 || '"}}' END
"""

LAUNCH = """
CASE launch_form WHEN 0 THEN lpad(m, 2, '0') || '. MONTH' WHEN 1 THEN '25-' || lpad(m, 2, '0')
  WHEN 2 THEN lpad(m, 2, '0') || '-' || lpad(m, 2, '0') WHEN 3 THEN '2025-' || lpad(m, 2, '0') || '-01'
  WHEN 4 THEN CAST(m AS STRING) WHEN 5 THEN 'SEPT' ELSE '' END
"""


def captures(spark: SparkSession, sf_dir: str, *brand: str, base: str | None = None) -> DataFrame:
    """Detail captures: an older one for every seventh product, and the one that counts."""
    rows = (
        spark_rows(spark, sf_dir, "SELECT * FROM vd WHERE captured", base)
        .withColumn("launch", F.expr(LAUNCH))
        .withColumn("body", F.expr(DOCUMENT))
    )
    old = F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit('{"product":{"productName":"Old"}}').alias("body"))
    new = F.struct(F.lit(2).cast("bigint").alias("seq"), F.col("body"))
    versions = F.when(F.col("k") % 7 == 0, F.array(old, new)).otherwise(F.array(new))
    return rows.select(*brand, F.col("sku_full").alias("sku"), F.inline(versions))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files of all suppliers in both layouts as (path, body)."""
    rows = spark_rows(spark, sf_dir, "SELECT * FROM config_files")
    body = F.expr(
        """'{"name":"' || replace(initcap(replace(slug, '_', ' ')), '"', '') || '","brand_id":"b-' || n
        || '","base_url":"https://' || slug || '.example","categories":{'
        || array_join(transform(sequence(1, n_categories), i -> '"' || lower(n_name) || '_' || i || '":"00' || i || '"'), ',')
        || '},"page_size":' || page_size || ',"product_limit":' || product_limit || '}'"""
    )
    new = F.struct(
        F.concat(F.lit("file:/x/brands/"), "slug", F.lit("/config/config.json")).alias("path"),
        F.when(F.col("broken_new"), F.lit('{"name": ')).otherwise(body).alias("body"),
    )
    old = F.struct(
        F.concat(F.lit("file:/x/config/"), "slug", F.lit("_config.json")).alias("path"),
        F.when(F.col("broken_old"), F.lit("oops")).otherwise(body).alias("body"),
    )
    both = F.array_compact(F.array(F.when(F.col("in_new"), new), F.when(F.col("in_old"), old)))
    return rows.select(F.inline(both))
