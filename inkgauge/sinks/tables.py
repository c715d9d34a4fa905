"""Results as files, written by the executors."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from .report import json_lines, to_json


def write_jsonl(results: DataFrame, folder: str) -> None:
    """One JSON object per line, nulls written out, previews of results left out."""
    json_lines(results).write.mode("overwrite").text(folder)


def write_parquet(results: DataFrame, folder: str, *partition_by: str) -> None:
    results.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)


def write_bands(artifact: dict, path: str) -> None:
    """A calibration artifact, indented."""
    Path(path).write_text(to_json(artifact, indent=2))


def read_bands(path: str) -> dict:
    return json.loads(Path(path).read_text())
