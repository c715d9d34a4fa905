"""Packing without crossing documents: binary-length pieces, equal lengths bucketed together."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_table

#: Ids of a partition's sequences start at its number shifted so far; a partition has room for 2^36 pieces.
_PARTITION_SHIFT = 36
#: Marks that often end a word; the tokenizer cuts between a letter or digit and a run of these.
_MARKS = ".,;:!?%$#&*|"
#: Joins words in one call to the tokenizer; any white space separates the two sides of it.
_MARK = "\x01"


class WordIds(dict):
    """Word -> its place in ``ids``; words not met before wait in ``fresh`` for :meth:`fill`.

    The tokenizer never joins text across a space and turns any white space to one, so each space-separated word can be
    encoded by itself.  A word that ends in marks is put together from the word without them and the marks, in ``joined``.
    The table is emptied when it holds ``bound`` words.
    """

    def __init__(self, path: str, bound: int, plain_specials: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word that lower-casing turns into such a string is no token
        self.default = Tokenizer.from_file(path)
        added = self.default.get_added_tokens_decoder().values()
        self.added = [x.content for x in added if not (plain_specials and x.special)]
        self.mark = self._encode([_MARK])[0]
        self.bound, self.ids, self.fresh, self.joined = bound, [], [], []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.ids.append(b"")
        core = word.rstrip(_MARKS)
        if core and len(core) < len(word) and core[-1].isalnum():
            self.joined.append((n, self[core], self[word[len(core) :]]))
        else:
            self.fresh.append((n, word))
        return n

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def whole(self, text: str) -> bytes | None:
        """Ids of a text that holds a string of an added token, which the tokenizer cuts out first; None for any other."""
        if any(x in text for x in self.added):
            return np.array(self.default.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return None

    def fill(self) -> None:
        """Encode the fresh words, many in one call, cut at the mark."""
        for k in range(0, len(self.fresh), 2000):
            places, words = zip(*self.fresh[k : k + 2000])
            (ids,) = self._encode([f" {_MARK} ".join(words)])
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
            if len(cuts) == len(words) - 1:
                starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
                raw = ids.tobytes()
                found = [raw[a:b] for a, b in zip(starts, ends)]
            else:  # a word holds the mark itself
                found = [x.tobytes() for x in self._encode(list(words))]
            for n, some in zip(places, found):
                self.ids[n] = some
        for n, core, marks in self.joined:
            self.ids[n] = self.ids[core] + self.ids[marks]
        self.fresh, self.joined = [], []

    def trim(self) -> None:
        if len(self) > self.bound:
            self.clear()
            self.ids = []


def _narrow(text: str) -> bool:
    """Whether lower-casing in Python equals the tokenizer's, which knows no final sigma."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encode(texts: list[str], path: str, bound: int = 900_000, plain_specials: bool = False) -> Iterator[bytes]:
    """Ids of each text, little-endian unsigned 32-bit, equal to the tokenizer's of the whole text.

    Strings of special tokens become those tokens, as by default in the library; with ``plain_specials`` they are text.
    """
    table = worker_table(("words", path, bound, plain_specials), lambda: WordIds(path, bound, plain_specials))
    at = table.__getitem__
    for k in range(0, len(texts), 500):
        places: list[list[int] | bytes] = []
        for text in texts[k : k + 500]:
            found = table.whole(text)
            if found is None:
                text = text.lower() if _narrow(text) else text
                found = list(map(at, text.replace("\n", " ").split(" ")))
            places.append(found)
        table.fill()
        ids = table.ids.__getitem__
        for found in places:
            yield found if isinstance(found, bytes) else b"".join(map(ids, found))
        table.trim()


def binary_lengths(n: int, most: int) -> list[int]:
    """``n`` as pieces of at most ``most`` (a power of two): full ones, then its binary digits in falling order."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    end_id: int = 2,
    max_tokens: int = 4096,
    with_ids: bool = False,
    plain_specials: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut each document's ids (and ``end_id``) into pieces of power-of-two lengths, each a sequence by itself.

    The lengths are full sequences of ``max_tokens`` and then the binary digits of the rest, so there is no padding at
    all and no sequence crosses documents.  ``bucket`` is the length, by which writers partition: every batch of a bucket
    is rectangular.  Sequence numbers are those of the partition and of the piece in it: unique without a shuffle, and
    the same when a lost task runs again on the same input split.

    Returns per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), bucket, and with
    ``with_ids`` also ids (array<int>).

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the string of a special token in a text is
    that token.  With ``plain_specials`` it is ordinary text.

    Null text counts as empty: one piece with ``end_id`` alone.  Null ids are kept.  Repeated rows are packed each for
    itself.  Other columns are ignored; an empty table gives no rows.
    """
    assert max_tokens & (max_tokens - 1) == 0, "max_tokens must be a power of two"
    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, ids array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _PARTITION_SHIFT
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch["id"].to_pylist(), encode([x or "" for x in batch["text"].to_pylist()], tokenizer_path, plain_specials=plain_specials)):
                raw += end
                total, start = len(raw) // 4, 0
                for length in binary_lengths(total, max_tokens):
                    part = raw[4 * start : 4 * (start + length)]
                    ids = np.frombuffer(part, "<i4") if with_ids else None
                    rows.append((doc, start, length, zlib.crc32(part), total, number, ids))
                    start, number = start + length, number + 1
                if with_ids and len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, schema)
    out = out.withColumn("offset", F.lit(0).cast("bigint")).withColumn("bucket", F.col("length")).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
