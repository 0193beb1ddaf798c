"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Strict and staged search, roll-ups, lists, relations, writes and replay.
QUERIES = (
    "index_totals", "token_vocabulary", "strict_search", "bm25_any", "widened", "nearest_floor", "prompt_recall", "mrr", "session_list", "project_stats", "review_queue", "timeline",
    "candidates", "scan_project", "saved_notes", "applied_changes", "caveats", "topic_revise", "hash_dedupe", "anchored_dedupe", "journal_replay", "lineitem_pages", "stale_hashes",
)


def main() -> None:
    from notelake.operators import index
    from notelake.plans import catalog, more  # noqa: F401  the second adds to the first
    from notelake.session import build_session
    from notelake.sources import adapters

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {"index_build": lambda s, d: index.build(adapters.observations(s, d)).postings} | {n: catalog.QUERIES[n] for n in QUERIES}
    try:
        from notelake.llm import queries as corpus

        queries |= {n: f for n, f in corpus.QUERIES.items() if n.startswith("op")}
    except ImportError:
        pass
    times: dict[str, float] = {}
    for name, f in queries.items():
        best = None
        for _ in range(2):  # the second run finds code compiled and files in memory
            began = time.perf_counter()
            f(spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total warm seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
