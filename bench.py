"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Each query is materialised in full twice, and the better time counts: the first
run of a plan also pays for its code generation.
"""

import json
import os
import time

import checks
from citeline.session import local_session, scratch, ship

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "vector_topk",
    "lexical_topk",
    "hybrid_rrf",
    "scoped_search",
    "embed_texts",
    "clean_text",
    "page_quality",
    "labelled_pages",
    "chunks_rows",
    "answer_questions",
    "eval_results",
    "recent_history",
    "append_turns",
    "transcripts",
    "upload_links",
    "claim",
    "progress_fold",
    "intent_mix",
    "most_asked",
    "questions_per_product",
)


def main() -> None:
    checks.load()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    checks.QUERIES["vector_topk"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            with scratch(spark):
                checks.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        took[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(os.path.basename(FOLDER).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
