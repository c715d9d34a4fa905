"""Wall seconds per headline query over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``words_per_s`` is the throughput of the scoring pipeline with the stub scorer: it measures the pipeline, not a model.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "clean_text", "word_windows", "chunk_scores", "detect_documents", "describe_by_source", "fp_table", "diff_vs_first", "decode_logits",
    "score_to_bucket", "band_range_join", "spearman", "auroc", "balacc_sweep", "confusion", "calibration_bins", "compare_runs",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from inkgauge.plans.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="inkgauge-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE}
    if importlib.util.find_spec("inkgauge.llm") and not os.environ.get("BENCH_ENGINE_ONLY"):
        from inkgauge.llm.queries import QUERIES as LLM

        queries |= LLM

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return round(time.perf_counter() - began, 3)

    run("clean_text")  # compiles code and starts workers
    times = {name: run(name) for name in queries}
    words = QUERIES["detect_documents"](spark, folder).agg({"n_words": "sum"}).first()[0]
    out = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": int(cpus),
        "words_per_s_stub_scorer": round(words / times["detect_documents"]),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
