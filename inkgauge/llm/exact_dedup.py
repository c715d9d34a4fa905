"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lookup, squeeze

#: One entry of a run: the key (SHA-256, another 64-bit hash, length; compared as bytes), the smallest identifier, the count.
_ENTRY = np.dtype([("key", "S44"), ("none", "u1"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
#: Entries of a block, the unit in which runs are stored and read.
BLOCK = 16_384
_BLOCKS = "slice int, run int, low binary, entries binary"


def _folded(entries: np.ndarray) -> np.ndarray:
    """Of entries sorted by key one per key: the smallest identifier (null last, then id, then row) and the sum of counts."""
    if len(entries) < 2:
        return entries
    new = np.ones(len(entries), bool)
    new[1:] = entries["key"][1:] != entries["key"][:-1]
    if new.all():
        return entries
    group = np.cumsum(new) - 1
    order = np.lexsort((entries["row"], entries["id"], entries["none"], group))
    starts = np.flatnonzero(new)
    out = entries[order[starts]].copy()
    out["n"] = np.add.reduceat(entries["n"], starts)
    return out


class _Writer:
    """Cuts a sorted run into blocks; holds back the last entry, which the next piece may add to."""

    def __init__(self, slice_: int, run: int):
        self.slice, self.run, self.held = slice_, run, np.empty(0, _ENTRY)

    def add(self, sorted_entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held = _folded(np.concatenate([self.held, sorted_entries]))
        full = (len(self.held) - 1) // BLOCK * BLOCK if len(self.held) else 0
        yield from self._blocks(self.held[:full])
        self.held = self.held[full:]

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._blocks(self.held)

    def _blocks(self, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(entries), BLOCK):
            part = entries[k : k + BLOCK]
            low = part["key"][0].ljust(44, b"\0")
            columns = [pa.array([self.slice], pa.int32()), pa.array([self.run], pa.int32()), pa.array([low], pa.binary()), pa.array([part.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "run", "low", "entries"])


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition to a run per slice."""
    out: _Writer | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.zeros(batch.num_rows, _ENTRY)
        rows["key"] = np.array(batch["key"].to_pylist(), "S44")
        ids = batch["id"]
        rows["none"], rows["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        rows["row"], rows["n"] = batch["row"].to_numpy(), 1
        slices, run = batch["slice"].to_numpy(), batch["run"][0].as_py()
        cuts = np.flatnonzero(slices[1:] != slices[:-1]) + 1
        for part, k in zip(np.split(rows, cuts), slices[np.concatenate([[0], cuts])].tolist()):
            if out is None or out.slice != k:
                if out is not None:
                    yield from out.close()
                out = _Writer(k, run)
            yield from out.add(part)
    if out is not None:
        yield from out.close()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiway merge of the runs of one (slice, run) at a time, whose blocks come in the order of their lowest keys.

    What lies below the next block's lowest key is final in every open block: it is merged (a stable merge of sorted
    pieces), folded and written. So only blocks that overlap are held: one per run, and no run is sorted anew.
    """
    out: _Writer | None = None
    pieces: list[np.ndarray] = []

    def final(below: bytes | None) -> np.ndarray:
        """Take the entries below a key (all of them for None) from the open blocks, merged."""
        nonlocal pieces
        ends = [len(p) if below is None else int(np.searchsorted(p["key"], below)) for p in pieces]
        ready = [p[:e] for p, e in zip(pieces, ends) if e]
        pieces = [p[e:] for p, e in zip(pieces, ends) if e < len(p)]
        if len(ready) < 2:
            return ready[0] if ready else np.empty(0, _ENTRY)
        whole = np.concatenate(ready)
        return whole[np.argsort(whole["key"], kind="stable")]

    for batch in batches:
        for k, run, low, blob in zip(*(batch[name].to_pylist() for name in ("slice", "run", "low", "entries"))):
            if out is None or (out.slice, out.run) != (k, run):
                if out is not None:
                    yield from out.add(final(None))
                    yield from out.close()
                out = _Writer(k, run)
            yield from out.add(final(low))
            pieces.append(np.frombuffer(blob, _ENTRY))
    if out is not None:
        yield from out.add(final(None))
        yield from out.close()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to rows: key, keep_id, keep_row, group_size."""
    for batch in batches:
        for blob in batch["entries"].to_pylist():
            rows = np.frombuffer(blob, _ENTRY)
            keys = pa.array([k.ljust(44, b"\0") for k in rows["key"].tolist()], pa.binary())
            ids = pa.array(rows["id"], pa.int64(), mask=rows["none"].astype(bool))
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(rows["row"]), pa.array(rows["n"])], ["key", "keep_id", "keep_row", "group_size"])


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Group rows whose texts are equal after each run of ASCII white space became one space.

    Each input partition sorts its digests into a run and folds equal ones.  Then, in rounds, ``fan_in`` neighbouring
    runs at a time are exchanged and merged (a binomial tree for ``fan_in=2``), for each slice of the digest space
    separately, until one run per slice is left.  Runs travel as blocks of sorted entries; a merge reads them in order and
    holds one block per run.  Every level keeps the smallest identifier of each digest and its count.  A key is the SHA-256
    digest verified by an independent 64-bit hash and the length: entries that differ in either stay apart.  A digest that a
    third of all rows share has one entry per run, so no task ever sees its rows together.

    Returns one row per input row: ``id_col``, keep_id (smallest id of the group), group_size, kept, text_sha256.

    Null text counts as empty; empty texts form a group.  Null ids sort last (keep_id is null only if all ids of a group
    are null).  Of rows with the same id and text one is kept.  Other columns are ignored, an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    spark = docs.sparkSession
    norm = squeeze(F.col(text_col))
    # 32 bytes of digest, 8 of the other hash, 4 of the length
    key = F.concat(F.unhex(F.sha2("t", 256)), F.unhex(F.lpad(F.hex(F.xxhash64("t")), 16, "0")), F.unhex(F.lpad(F.hex(F.char_length("t")), 8, "0")))
    base = work.save(
        docs.select(F.col(id_col).cast("bigint").alias("id"), norm.alias("t")).select(
            "id", F.monotonically_increasing_id().alias("row"), key.alias("key")
        ),
        "rows",
    )
    total = base.count()
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a slice of the digest space: its first 16 bits
    slice_of = F.pmod(F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int"), F.lit(slices)).alias("slice")
    run = F.spark_partition_id().alias("run")
    first = base.select(slice_of, run, "key", "id", "row").sortWithinPartitions("slice", "key")
    blocks = work.save(first.mapInArrow(_first_runs, _BLOCKS), "level0")
    runs = blocks.agg(F.coalesce(F.max("run"), F.lit(-1)) + 1).first()[0]
    level = 0
    while runs > 1:
        runs = -(-runs // fan_in)
        dealt = blocks.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(slices, "slice", "run")
        blocks = work.save(dealt.sortWithinPartitions("slice", "run", "low").mapInArrow(_merge_runs, _BLOCKS), f"level{level + 1}")
        work.drop(f"level{level}")
        level += 1
    roots = blocks.mapInArrow(_unpacked, "key binary, keep_id bigint, keep_row bigint, group_size bigint")
    return lookup(base, roots, ["key"], "group_size", total).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )
