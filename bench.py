"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.registry import QUERIES  # noqa: E402
from catalog.session import session  # noqa: E402
from riskloom.functions.durable import storage  # noqa: E402

HEADLINE = (
    "lines", "file_stats", "findings", "entry_points", "chains", "vibe_presence", "priority_top200", "ranked_files",
    "fingerprint", "context", "line_fix", "patched_files", "dedupe_exact", "training_clean", "line_chunks",
    "stratified_split", "word_vocab", "char_vocab", "idf", "tfidf_features",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = session()
    run(QUERIES["findings"](spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001"))      # warm up the JVM
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        with storage(spark):
            run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    lines = QUERIES["lines"](spark, sf_dir).count()
    out = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(Path(sf_dir).name.removeprefix("sf")), "lines": lines,
    }
    if "findings" in seconds:
        out["findings_lines_per_second"] = round(lines / seconds["findings"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
