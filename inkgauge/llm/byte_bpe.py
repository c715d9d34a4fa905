"""Byte-level BPE by corpus-level merge replay, and its decoder."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_table

_NONE = np.int64(1 << 40)  # the rank of a pair that no merge joins


class Merges:
    """The ranks of a vocabulary and the pairs of tokens that join to a token, as sorted arrays for lookup of many."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks = np.array([pairs.get(k, _NONE) for k in self.keys.tolist()], np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where there is none (a symbol below 0 is a border)."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode all ``words`` at once; returns all ids and, for each word, where its ids start (and the end): merges are applied in rank order over an index from pair rank to positions.

        One popped rank merges, in every word that has it, the leftmost position; further positions of the word wait in
        the index, since a merge can make a pair of a lower rank, which comes first.  A merge touches two neighbours.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        # each word is followed by a border, and position 0 is one
        ends = np.cumsum(lengths + 1)
        size = int(ends[-1]) + 1 if len(words) else 1
        symbol = np.full(size, -1, np.int64)
        word = np.repeat(np.arange(len(words)), lengths + 1)
        inside = np.ones(size, bool)
        inside[0] = inside[ends] = False
        symbol[inside] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.concatenate([[-1], word])
        before, after = np.arange(-1, size - 1), np.arange(1, size + 1)
        after[-1], before[0] = size - 1, 0
        rank = np.full(size, _NONE, np.int64)
        rank[:-1] = self.of(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}

        def enter(places: np.ndarray) -> None:
            """File positions under their ranks."""
            ranks = rank[places]
            places, ranks = places[ranks < _NONE], ranks[ranks < _NONE]
            if len(places) == 1:
                groups = [(int(ranks[0]), places)]
            else:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)) if len(places) else []
            for r, some in groups:
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(queue, r)

        queue: list[int] = []
        enter(np.flatnonzero(rank < _NONE))
        while queue:
            r = heapq.heappop(queue)
            filed = index.pop(r)
            places = filed[0] if len(filed) == 1 else np.unique(np.concatenate(filed))
            places = places[rank[places] == r]
            if not len(places):
                continue
            if len(places) > 1:
                own = word[places]
                first = np.ones(len(places), bool)
                first[1:] = own[1:] != own[:-1]
                if not first.all():
                    index[r] = [places[~first]]
                    heapq.heappush(queue, r)
                    places = places[first]
            right = after[places]
            beyond, ahead = after[right], before[places]
            symbol[places] = r
            symbol[right] = -2
            rank[right] = _NONE
            after[places], before[beyond] = beyond, places
            rank[places] = self.of(symbol[places], symbol[beyond])
            rank[ahead] = self.of(symbol[ahead], symbol[places])
            enter(np.concatenate([places, ahead]))
        left = symbol >= 0
        counts = np.bincount(word[left], minlength=len(words))[: len(words)]
        return symbol[left], np.concatenate([[0], np.cumsum(counts)])


class ChunkTable(dict):
    """Chunk -> its place in ``ids`` and ``decimal``; new chunks wait for :meth:`fill`.

    ``lead`` stands before every chunk (a space that belongs to the word after it, or nothing).
    """

    def __init__(self, lead: str):
        super().__init__()
        self.lead, self.fresh, self.ids, self.decimal = lead, [], [], []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n

    def fill(self, split, merges: Merges) -> None:
        """One replay over the distinct matches of all fresh chunks."""
        if not self.fresh:
            return
        lists = [split(self.lead + x) for x in self.fresh]
        place: dict[str, int] = {}
        for pieces in lists:
            for piece in pieces:
                place.setdefault(piece, len(place))
        ids, starts = merges.replay([p.encode("utf-8", "surrogatepass") for p in place])
        raw, decimal = ids.astype("<u4").tobytes(), ",".join(map(str, ids.tolist())).encode()
        widths = 2 + (ids > 9).astype(np.int64) + (ids > 99) + (ids > 999) + (ids > 9999) + (ids > 99999) + (ids > 999999)
        shown = np.concatenate([[0], np.cumsum(widths)])[starts].tolist()
        starts = (starts * 4).tolist()
        for pieces in lists:
            at = [place[p] for p in pieces]
            if len(at) == 1:
                (k,) = at
                self.ids.append(raw[starts[k] : starts[k + 1]])
                self.decimal.append(decimal[shown[k] : shown[k + 1] - 1])
            else:
                self.ids.append(b"".join([raw[starts[k] : starts[k + 1]] for k in at]))
                self.decimal.append(b",".join([decimal[shown[k] : shown[k + 1] - 1] for k in at]))
        self.fresh = []


class Codec:
    """Encoder and decoder of one Python worker, with tables of at most ``bound`` chunks each."""

    def __init__(self, path: str, pattern: str, bound: int):
        import regex

        self.split, self.merges, self.bound = regex.compile(pattern).findall, Merges(path), bound
        self.bare, self.led = ChunkTable(""), ChunkTable(" ")

    def _chunks(self, text: str) -> list[tuple[ChunkTable, list[str]]]:
        """Cut where the pattern always cuts: before a lone space and around a lone line break between two words.

        Texts with any other white space are cut by the pattern itself.
        """
        if " ".join(text.split()) != text.replace("\n", " "):
            return [(self.bare, self.split(text))]
        lines = text.split("\n")
        out = []
        for k, line in enumerate(lines):
            first, *rest = line.split(" ")
            out.append((self.bare, ["\n", first] if k else [first]))
            if rest:
                out.append((self.led, rest))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit), and their decimal list, of each text."""
        places = []
        for text in texts:
            places.append([(t, list(map(t.__getitem__, chunks))) for t, chunks in self._chunks(text)] if text else [])
        for table in (self.bare, self.led):
            table.fill(self.split, self.merges)
        for found in places:
            raw = b"".join([b"".join(map(table.ids.__getitem__, at)) for table, at in found])
            yield raw, b",".join([b",".join(map(table.decimal.__getitem__, at)) for table, at in found])
        for table in (self.bare, self.led):
            if len(table) > self.bound:
                table.clear()
                table.ids, table.decimal = [], []

    def decode(self, raw: bytes) -> bytes:
        """The bytes of ids given as :meth:`encode` returns them."""
        return b"".join(map(self.merges.token.__getitem__, np.frombuffer(raw, "<u4").tolist()))


def codec(path: str, pattern: str, bound: int = 400_000) -> Codec:
    return worker_table(("codec", path, pattern, bound), lambda: Codec(path, pattern, bound))


def encode_documents(
    docs: DataFrame,
    *,
    ranks_path: str,
    pattern: str,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the bytes decoded from them.

    The corpus is taken batch by batch: the distinct words of a batch that its worker hasn't met are encoded in one
    replay of the merges, and each document looks its words up.  There is no shuffle and no state beyond bounded tables.
    (One replay over the distinct words of the whole corpus, joined back, took over three times the disk it may: README.)

    Returns per row: ``id_col``, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes
    decoded from the ids), and with ``with_ids`` also ids (array<int>).

    Null text counts as empty: no tokens.  Null and repeated ids are kept row by row.  Other columns are ignored; an
    empty table gives no rows.
    """
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            docs_in, texts = batch["id"].to_pylist(), [x or "" for x in batch["text"].to_pylist()]
            for part in _by_size(texts, 6 << 20):
                rows = []
                for doc, (raw, decimal) in zip(docs_in[part], own.encode(texts[part])):
                    back = hashlib.sha256(own.decode(raw)).hexdigest()
                    ids = np.frombuffer(raw, "<i4") if with_ids else None
                    rows.append((doc, len(raw) // 4, hashlib.sha256(decimal).hexdigest(), back, ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")


def _by_size(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of about ``most`` characters; a longer text is a slice by itself."""
    start = chars = 0
    for k, text in enumerate(texts):
        if chars and chars + len(text) > most:
            yield slice(start, k)
            start, chars = k, 0
        chars += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
