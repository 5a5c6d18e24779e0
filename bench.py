"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from docweave.queries import QUERIES
from docweave.session import local_session, ship

HEADLINE = [
    "i04_html_text", "i21_doc_profile", "i34_normalize", "i36_running_heads", "i38_clean_pages",
    "i39_recursive_chunks", "i41_window_chunks", "i47_page_lookup", "i51_chunk_documents",
    "i52_byte_duplicates", "i53_content_duplicates", "i54_chunk_duplicates", "i55_skip_decision",
    "i57_replace_source", "i60_manifest_summary", "i67_cache_hits", "i70_embed_rows", "i78_top_k",
    "i83_two_stage", "i86_numbered_context", "i88_history", "i101_clarification", "i106_screening",
    "i113_language", "i116_window_usage", "i118_reply_cache", "i126_fallback",
    "i130_131_scores", "i135_136_screening_quality", "i62_ingest_job", "i139_answer",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    ship(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
