"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. BENCH_QUERIES may name other queries, comma-separated, or be "all". Every query is
run to the end (all columns of all rows, into Spark's no-op sink). Times are medians of three runs, of one where
a run takes long; rates are rows of the table that the query reads, a second.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlens.plans.catalogue import QUERIES  # noqa: E402
from reviewlens.plans.session import build_session  # noqa: E402

HEADLINE = [
    "aspect_summary",
    "doc_polarity",
    "rules_simple",
    "rules_mention_gated",
    "rules_context_v1",
    "rules_context_v2",
    "rating_keyword_label",
    "clean_basic",
    "clean_stream",
    "clean_pages",
    "normalise_full",
    "normalise_typos",
    "expand_abbrev",
    "fuzzy_dedup",
    "merge_keep_last",
    "upsert_predictions",
    "balanced_sample",
    "latest_n_per_product",
    "aspect_stats",
    "aspect_scores_wide",
    "product_comparison",
    "validate_all",
    "validation_report",
    "lexicon_join",
    "eval_macro_f1",
    "eval_samples_f1",
    "cohen_kappa",
    "promotion_gate",
    "sentiment_trend",
    "completeness",
    "stream_batches",
    "stream_upsert",
    "stream_summary",
]


# What a query reads, where that is not all reviews: its rate is over these rows.
EVENTS = "upsert_predictions latest_n_per_product product_comparison eval_macro_f1 eval_samples_f1 cohen_kappa promotion_gate sentiment_trend completeness stream_batches stream_upsert stream_summary"
INPUT = {"clean_pages": "pages"} | dict.fromkeys(EVENTS.split(), "events")
SLOW_S = 8


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one run that is not counted starts the JVM's compiler
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    counts = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("events", "documents", "pages")}
    counts["reviews"] = counts["events"] + counts["documents"]
    took, rates, runs = {}, {}, {}
    for name in names:
        times: list[float] = []
        # the median of three runs; of slow queries there is one
        while len(times) < 3 and sum(times) < SLOW_S:
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name], runs[name] = round(median(times), 3), len(times)
        rates[name] = round(counts[INPUT.get(name, "reviews")] / took[name])
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": total,
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")),
                "runs": runs,
                "input_rows": counts,
                "input_rows_per_sec": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
