"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (optional) the queries.
"""

from __future__ import annotations

import json
import os
import re
import time

from activity_engine.plans import QUERIES
from activity_engine.session import build_session

HEADLINE = (
    "slot_pivot", "platform_profile", "slot_share", "unified_activity", "timeline_totals", "kpi_header", "peak_month",
    "top_pairs", "priority_dedupe", "sessions", "inter_event_gap", "event_runs", "topk_per_group", "percent_rank_score",
    "left_enrich", "interval_join", "nearest_time", "match_cascade", "dense_filter", "merge_insert", "top_unigrams",
    "top_bigrams", "keyword_profiles", "category_scores", "tfidf_terms", "html_links", "turn_blocks", "window_score",
    "nearest_centroid", "text_match", "interactions", "als_topn", "reco_topn", "dq_rules", "report_media", "spend_summary",
    "context_windows", "density_clusters", "scene_assign", "project_50d", "anchor_contains", "title_lookup", "distinct_by_period",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["slot_pivot"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the session

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
