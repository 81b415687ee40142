"""Time the headline queries and print one JSON line.

Each query is run in full into a sink that discards its rows, so all columns are computed and no
result passes through the driver. Queries that write tables write them as part of their time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from loomcat.session import get_spark  # noqa: E402

HEADLINE = [
    "tile_extract", "title_grammar", "discount_int", "harvest_a", "harvest_b", "page_prefix",
    "category_quota", "global_limit", "detail_record", "enrich_products", "harvest_enriched",
    "all_brands", "discounted_in_stock", "listing_row", "brand_id_lookup", "latest_run_per_brand",
    "run_item_count", "brand_items", "run_items", "save_run", "delete_run", "upsert_products",
    "append_listing", "latest_products", "report_lines", "write_json", "write_csv", "words_array",
    "tile_extract_web_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("loomcat-bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["discounted_in_stock"](spark, "/root/testdata/sf0.001").collect()  # warm the JVM
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
