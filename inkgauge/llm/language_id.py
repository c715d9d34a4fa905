"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_table

#: More labels than this are an error: there are about 7,000 living languages, so such a column holds something else.
MAX_LABELS = 8_192

#: Local letter numbers below this are looked up in a flat table of trigrams; texts with more letters are sorted.
_FLAT = 160


class Profiler:
    """Texts -> bundled n-gram vectors.

    Each letter has a random vector of +1 and -1, drawn from its code point; anything that is no letter is one gap
    symbol.  The vector of a trigram xyz binds (multiplies) x rotated twice, y rotated once, and z.  A text's vector is the
    sum of those of its trigrams: whole numbers, so sums do not depend on the order.
    """

    def __init__(self, dims: int, bound: int = 16_000):
        self.dims, self.bound = dims, bound
        letters = np.zeros(0x110000, bool)
        letters[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        self.is_letter = letters
        self._reset()

    def _reset(self) -> None:
        self.local = np.full(0x110000, -1, np.int32)  # code point -> local number
        self.points: list[int] = []
        self.flat = np.full(_FLAT**3, -1, np.int32)  # trigram of local numbers -> column
        self.columns: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dims), np.int8)  # +1 and -1
        self.letter: dict[int, np.ndarray] = {}

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            self.letter[point] = np.random.default_rng(point).integers(0, 2, self.dims).astype(np.int8) * 2 - 1
        return self.letter[point]

    def _column(self, x: int, y: int, z: int) -> int:
        key = x << 42 | y << 21 | z
        at = self.columns.get(key)
        if at is None:
            at = self.columns[key] = len(self.columns)
            if at == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.vectors[at] = np.roll(self._letter(x), 2) * np.roll(self._letter(y), 1) * self._letter(z)
        return at

    def _number(self, codes: np.ndarray) -> np.ndarray:
        """Local numbers of code points."""
        got = self.local[codes]
        if (got < 0).any():
            for point in np.unique(codes[got < 0]).tolist():
                self.local[point] = len(self.points)
                self.points.append(point)
            got = self.local[codes]
        return got

    def trigrams(self, text: str) -> np.ndarray:
        """The column of each trigram of the text; empty if it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.is_letter[codes]
        if not letter.any():
            return np.empty(0, np.int32)
        # both ends are gaps, and a run of others is one gap
        letter = np.concatenate([[False], letter, [False]])
        codes = np.where(letter, np.concatenate([[32], codes, [32]]), 32).astype(np.uint32)
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]
        codes = codes[keep]
        n = self._number(codes)
        if n.max() < _FLAT:
            keys = (n[:-2] * _FLAT + n[1:-1]) * _FLAT + n[2:]
            got = self.flat[keys]
            if (got < 0).any():
                for key in np.unique(keys[got < 0]).tolist():
                    x, y, z = key // _FLAT**2, key // _FLAT % _FLAT, key % _FLAT
                    self.flat[key] = self._column(self.points[x], self.points[y], self.points[z])
                got = self.flat[keys]
            return got
        wide = codes.astype(np.int64)
        keys, back = np.unique(wide[:-2] << 42 | wide[1:-1] << 21 | wide[2:], return_inverse=True)
        found = [self._column(k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) for k in keys.tolist()]
        return np.array(found, np.int32)[back]

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector; None if it has no letter."""
        if len(self.columns) > self.bound or len(self.points) > 8 * self.bound:
            self._reset()
        columns = self.trigrams(text)
        if not len(columns):
            return None
        counts = np.bincount(columns)
        at = np.flatnonzero(counts)
        return counts[at].astype(np.float32) @ self.vectors[at].astype(np.float32)


def profiler(dims: int) -> Profiler:
    return worker_table(("profiler", dims), lambda: Profiler(dims))


def learn(rows: DataFrame, *, dims: int, text_col: str, label_col: str) -> dict[str, np.ndarray]:
    """Bundle the rows of each label to its prototype.  One row per label returns to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = profiler(dims), {}
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                vector = own.bundle(text)
                if vector is not None:
                    sums[label] = sums.get(label, 0) + np.rint(vector).astype(np.int64)
        for label, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * dims, pa.string()), pa.array(np.arange(dims), pa.int32()), pa.array(vector, pa.int64())],
                ["label", "dim", "value"],
            )

    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    parts = rows.mapInArrow(run, "label string, dim int, value bigint")
    sums = parts.groupBy("label", "dim").agg(F.sum("value").cast("double").alias("value"))
    whole = sums.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "value")))["value"].alias("vector"))
    return {label: np.array(vector) for label, vector in whole.collect()}


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def rows_a_label(counts: list[int], most: int) -> int:
    """The largest bound for which the labels' rows, up to so many of each, number at most ``most``; 1 at least."""
    left, labels = most, len(counts)
    for n in sorted(counts):
        if n * labels > left:
            return max(1, left // labels)
        left, labels = left - n, labels - 1
    return max(counts, default=1)


def identify(
    docs: DataFrame,
    *,
    dims: int = 1024,
    max_training_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    keep_columns: bool = False,
) -> DataFrame:
    """Predict the language of every whole text by the cosine of its vector with each language's prototype.

    Prototypes are learnt from texts and non-null labels of rows that are not held out, from all of them or, where there
    are more than ``max_training_rows``, from about so many: all rows of rare labels, an equal number of each other label,
    chosen by a hash of id and text.  So every label with a letter in its texts is learnt.  A prediction sees the text alone.

    Returns per row: ``id_col``, held_out, lang_pred, score (the cosine, 0 at least); with ``keep_columns`` these are
    appended to the row's own columns instead, replacing any of the same names.

    The table must have ``label_col``; with more than MAX_LABELS different labels it is an error, since prototypes go to every
    worker.  Null text, text without letters, and any text if there is nothing to learn from: lang_pred ``und``, score 0.  Null ids
    are never held out.  Ties go to the first label in alphabetical order.  An empty table gives no rows.
    """
    usable = docs.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    text, label = F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")
    usable = usable.select(text, label, F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash")).filter(F.col("text").rlike(r"\p{L}"))
    labels = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")).limit(MAX_LABELS + 1).collect()
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{label_col} has more than {MAX_LABELS} different values: these are no languages")
    found = {r["label"]: (r["n"], r["least"]) for r in labels}
    bound = rows_a_label([n for n, _ in found.values()], max_training_rows)
    # the least hash is taken whatever the share, so no label is left without a row
    tops = [(x, max(least, bound * 2**64 // n - 2**63)) for x, (n, least) in found.items() if n > bound]
    if tops:
        tops = docs.sparkSession.createDataFrame(tops, "label string, top bigint")
        usable = usable.join(F.broadcast(tops), "label", "left").filter(F.col("top").isNull() | (F.col("hash") <= F.col("top")))
    prototypes = learn(usable, dims=dims, text_col="text", label_col="label")
    labels = sorted(prototypes)
    matrix = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in labels], np.float32).reshape(len(labels), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiler(dims)
        for batch in batches:
            names, scores = [], []
            for text in batch[text_name].cast(pa.string()).to_pylist():
                vector = own.bundle(text) if text and labels else None
                norm = float(np.linalg.norm(vector)) if vector is not None else 0.0
                if norm == 0:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosines = matrix @ vector / norm
                best = int(np.argmax(cosines))
                names.append(labels[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            rest = [batch[k] for k, name in enumerate(batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*(x for x in batch.schema.names if x != "__text"), "lang_pred", "score"],
            )

    fresh = ("held_out", "lang_pred", "score", "__text")
    # texts go to Python once: with the row's own columns, or else beside its id
    text_name = text_col if keep_columns else "__text"
    kept = [F.col(c) for c in docs.columns if c not in fresh] if keep_columns else [F.col(id_col), F.col(text_col).cast("string").alias("__text")]
    rows = docs.select(*kept, held_out(id_col).alias("held_out"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
