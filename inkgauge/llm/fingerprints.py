"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Workspace

#: Lanes modulo 2^64 for equality, and per level of resolution lanes modulo 2^16 for likeness.  The finest level takes one
#: paragraph of 2^27: two texts of 2 GB, the most a row can hold, have fewer than 2^31 and don't crowd it.
WIDE, LEVELS, LANES = 8, 28, 16
_RECORD = np.dtype([("count", "<u4"), ("wide", "<u8", WIDE), ("fine", "<u2", (LEVELS, LANES))])


def paragraphs(text: str) -> list[str]:
    """The units that are hashed: non-empty lines, long ones cut after their sentences."""
    return [p for p in text.replace(". ", ".\n").split("\n") if p]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: list[str]) -> np.ndarray:
    """One record per text: the number of its paragraphs and sums of the vectors hashed from them, modulo powers of two.

    A paragraph adds to all wide lanes, and at each level to one fine lane; level j takes a 2^-j part of all paragraphs,
    chosen by their hash.  All is a sum, so the order of paragraphs doesn't matter and :func:`combine` adds or removes.
    """
    lists = [paragraphs(t) for t in texts]
    out = np.zeros(len(texts), _RECORD)
    counts = np.array([len(x) for x in lists], np.int64)
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return out
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(p) for x in lists for p in x), np.uint64, ends[-1])
    out["count"] = counts
    for k in range(WIDE):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)))])
        out["wide"][:, k] = total[ends] - total[ends - counts]
    place = _mix(hashes ^ np.uint64(0xD1B54A32D192ED03))
    cell = np.repeat(np.arange(len(texts)), counts) * LANES + (place & np.uint64(LANES - 1)).astype(np.int64)
    chance, value = place >> np.uint64(8) & np.uint64(0xFFFFFFFF), (place >> np.uint64(48)).astype(np.float64)
    for level in range(LEVELS):
        some = chance < np.uint64(0x100000000 >> level)
        cell, chance, value = cell[some], chance[some], value[some]  # a level's paragraphs are among the last one's
        if not len(cell):
            break
        sums = np.bincount(cell, value, len(texts) * LANES)
        out["fine"][:, level] = (sums.astype(np.int64) & 0xFFFF).astype(np.uint16).reshape(-1, LANES)
    return out


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprints of multisets joined (``sign=1``) or with the paragraphs of ``b`` removed (``sign=-1``)."""
    out = np.zeros(a.shape, _RECORD)
    for name in _RECORD.names:
        out[name] = a[name] + b[name] if sign > 0 else a[name] - b[name]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints; else an estimate of 2 * common / all paragraphs, from 0 to below 1.

    Lanes that differ show paragraphs that only one side has; their number is estimated (as the number of balls from the
    number of hit bins) at the finest level that isn't crowded.
    """
    differ = (a["fine"] != b["fine"]).sum(axis=2)
    level = np.argmax(np.concatenate([differ <= 0.7 * LANES, np.ones((len(a), 1), bool)], axis=1), axis=1)
    level = np.minimum(level, LEVELS - 1)
    hit = np.minimum(differ[np.arange(len(a)), level], LANES - 0.5)
    alone = -LANES * np.log1p(-hit / LANES) * 2.0**level
    every = np.maximum(a["count"].astype(np.float64) + b["count"], 1.0)
    same = (a["wide"] == b["wide"]).all(axis=1) & (a["count"] == b["count"])
    return np.where(same, 1.0, np.clip(1 - np.maximum(alone, 1.0) / every, 0.0, 1.0))


_NO_ID = -(2**63)  # stands for a null id: below all others
_RESULT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(ids: list[int | None], texts: list[str], nexts: list[str]) -> Iterator[pa.RecordBatch]:
    """Results of texts and the texts that follow each, some at a time."""
    for k in range(0, len(texts), 1000):
        some, after = texts[k : k + 1000], nexts[k : k + 1000]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(some, after)]
        mine, last, changed = fingerprints(some), fingerprints(after[-1:]), fingerprints(edited)
        # a text's successor is mostly the row after it
        following = np.concatenate([mine[1:], last])
        odd = [i for i in range(len(some) - 1) if after[i] is not some[i + 1]]
        if odd:
            following[odd] = fingerprints([after[i] for i in odd])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[k : k + 1000], pa.int64()),
                pa.array([len(t) for t in some], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([x.tobytes().hex() for x in mine], pa.string()),
                pa.array([x.tobytes().hex() for x in changed], pa.string()),
                pa.array(likeness(mine, changed), pa.float64()),
                pa.array(likeness(mine, following), pa.float64()),
            ],
            _NAMES,
        )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted: each row meets the next one; the last meets the edge row behind it, which gives no result."""
    held: tuple[int | None, str] | None = None  # one row waits for the next batch
    for batch in batches:
        rows = list(zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["edge"].to_pylist()))
        own = [(d, t) for d, t, edge in rows if not edge]
        edges = [t for _, t, edge in rows if edge]
        own = [held, *own] if held else own
        held = None
        if not own:
            continue
        texts = [t for _, t in own]
        nexts = texts[1:] + edges[:1]
        if not edges:
            held = own[-1]
        n = len(nexts)
        if n:
            yield from _compared([d for d, _ in own[:n]], texts[:n], nexts)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest key of a range of keys, in the order of (id, hash)."""
    top = None
    for batch in batches:
        if batch.num_rows:
            best = max(zip(batch["key"].to_pylist(), batch["h"].to_pylist()))
            top = best if top is None else max(top, best)
    if top is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in top], ["key", "h"])


def _range_udf(tops: list[tuple[int, int]]):
    """(range, range above that needs the row as its edge or -1) of a row by its key; a range ends at its largest key.

    ``tops`` are one key per range: their number is that of the shuffle partitions, whatever the number of rows.
    """
    keys, hashes = np.array([k for k, _ in tops], np.int64), np.array([h for _, h in tops], np.int64)

    @F.pandas_udf("struct<rng:int,above:int>")
    def place(key: pd.Series, h: pd.Series) -> pd.DataFrame:
        some, tie = key.to_numpy(), h.to_numpy()
        left, right = np.searchsorted(keys, some, "left"), np.searchsorted(keys, some, "right")
        at = left.copy()
        for i in np.flatnonzero(left < right):  # the id itself ends ranges: its rows go on by their hashes
            at[i] = left[i] + np.searchsorted(hashes[left[i] : right[i]], tie[i], "left")
        at = np.minimum(at, max(len(keys) - 1, 0))
        top = (keys[at] == some) & (hashes[at] == tie) if len(keys) else np.zeros(len(some), bool)
        return pd.DataFrame({"rng": at.astype(np.int32), "above": np.where(top, (at + 1) % max(len(keys), 1), -1).astype(np.int32)})

    return place


def _repeats(hot: DataFrame, schema: str, parts: int) -> DataFrame:
    """The results of all but one of each hot group of equal rows: each is followed by its like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch["text"][k].as_py()
                (one,) = _compared([batch["id"][k].as_py()], [text], [text])
                yield pa.RecordBatch.from_arrays([*one.columns, batch["n"].slice(k, 1)], [*_NAMES, "n"])

    done = hot.mapInArrow(run, f"{schema}, n bigint")
    pieces = done.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 2) div 1000"))))
    dealt = pieces.repartition(parts, "id", "fingerprint", "part")
    copies = F.least(F.lit(1000).cast("bigint"), F.col("n") - 1 - F.col("part") * 1000)
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*_NAMES)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, and the text whose last half is replaced by the start of the next document.

    The next document is the one with the next smaller id; after the smallest comes the largest.  Keys (id and a hash of
    the text) are counted and cut into as many ranges as there are shuffle partitions; each text travels to its range once, and
    the first of a range also to the range above it.  A range is sorted by Spark and streamed, so it may be of any size.

    Returns per row: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    Null text counts as empty.  Rows with equal ids are neighbours, ordered by a hash of their texts, then by these; null ids
    come last.  A table of one row is its own neighbour.  Texts without paragraphs have the fingerprint of nothing.  Of rows
    that are equal and many (over 1/HOT_SHARE of the table) one takes its place in the order and the others, whose results are
    alike, are dealt out anew.  Other columns are ignored; an empty table gives no rows.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    own, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(own.alias("id"), text.alias("text")).withColumn("key", F.coalesce("id", F.lit(_NO_ID))).withColumn("h", F.xxhash64("text"))
    keys = work.save(rows.groupBy("key", "h", F.col("id").isNull().alias("none")).agg(F.count(F.lit(1)).alias("n")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot_keys = keys.filter((F.col("n") * HOT_SHARE > total) & (F.col("n") > 1000)).select("key", "h", "none", "n")  # fewer than HOT_SHARE
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = keys.select("key", "h").repartitionByRange(ranges, "key", "h").mapInArrow(_ends, "key bigint, h bigint")
    tops = sorted((r["key"], r["h"]) for r in ends.collect())  # one row per range

    chain = rows
    hot = None
    if not hot_keys.isEmpty():
        few = F.broadcast(hot_keys.withColumnRenamed("n", "hot_n"))
        marked = rows.withColumn("none", F.col("id").isNull()).join(few, ["key", "h", "none"], "left")
        hot = work.save(marked.filter("hot_n IS NOT NULL").groupBy("id", "key", "h", "text").agg(F.count(F.lit(1)).alias("n")), "hot")
        chain = marked.filter("hot_n IS NULL").select("id", "text", "key", "h").unionByName(hot.select("id", "text", "key", "h"))
    placed = chain.withColumn("at", _range_udf(tops)("key", "h"))
    goes = F.array_compact(F.array(F.struct(F.col("at.rng").alias("rng"), F.lit(False).alias("edge")), F.when(F.col("at.above") >= 0, F.struct(F.col("at.above").alias("rng"), F.lit(True).alias("edge")))))
    sent = placed.select("id", "key", "h", "text", F.inline(goes))
    met = sent.repartitionById(max(len(tops), 1), F.col("rng")).sortWithinPartitions("edge", F.desc("key"), F.desc("h"), "text")  # a range is a partition
    found = met.select("id", "text", "edge").mapInArrow(_follow, _RESULT)
    if hot is not None:
        found = found.unionByName(_repeats(hot.filter("n > 1"), _RESULT, ranges))
    return found.withColumnRenamed("id", id_col)
