"""MinHash near-dedup with sequential Bayesian verification and exact confirmation."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lookup, split_join, text_or_empty
from .components import components

#: 32 bands of 5 hashes: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time before a pair's posterior is looked at again.
STEP = 32
#: Members of a bucket that are compared as one block; bytes of shingle sets that a block keeps.
BLOCK, SET_BYTES = 2048, 64 << 20

_rng = np.random.default_rng(20_240_229)
_ODD = (_rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)).astype(np.uint64)
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of fewer words, the whole sequence is the one run."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += ids[k : n - width + 1 + k] * _ODD[k]
    return np.unique(_mix(total))


def signature(some: np.ndarray) -> np.ndarray:
    """For each hash function the low half of its least value over the set."""
    x = (some >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (_A[:, None] * x[None, k : k + 2048] + _B[:, None]).min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _ODD[32]
    for k in range(ROWS):
        total = _mix(total + parts[:, :, k] * _ODD[33 + k])
    return total.view(np.int64)


def least_matches(similarity: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): with fewer matches P(similarity >= threshold) is below ``miss``.

    The prior is uniform, so after x matches of m the posterior is Beta(x + 1, m - x + 1) and its upper tail at t equals
    P(Binomial(m + 1, t) <= x).
    """
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        if miss <= 0:
            out.append((m, 0))
            continue
        tail, x = 0.0, -1
        while tail < miss:
            x += 1
            tail += math.comb(m + 1, x) * similarity**x * (1 - similarity) ** (m + 1 - x)
        out.append((m, x))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _surviving(x: np.ndarray, y: np.ndarray, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature matrices stay after every batch of hashes, and their share of matches."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for m, need in rule:
        matches[alive] += (x[alive, m - STEP : m] == y[alive, m - STEP : m]).sum(axis=1)
        alive = alive[matches[alive] >= need]
    return alive, matches[alive] / HASHES


def _describe(docs: DataFrame, size: int, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """Per row: number of shingles, digest of the set, signature, and the words, compressed, for exact checks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch["text"].to_pylist()
            counts, digests, signatures, packed = [], [], [], []
            for text in texts:
                words = words_of(text)
                some = shingles(words, size)
                counts.append(len(some))
                digests.append(xxhash.xxh3_128_digest(some.tobytes()))
                signatures.append(signature(some).tobytes() if len(some) else None)
                packed.append(squeeze(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(packed, pa.binary())],
                ["row", "id", "n", "digest", "sig", "words"],
            )

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "row bigint, id bigint, n bigint, digest binary, sig binary, words binary")


_EDGE = "key bigint, node bigint, center bigint"


def _edges(keys: np.ndarray, nodes: np.ndarray, centers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(centers)], ["key", "node", "center"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch: each member of a bucket points to the bucket's first, and that to itself; only these firsts travel."""
    for batch in batches:
        nodes = batch["row"].to_numpy()
        order = np.argsort(nodes)
        keys = band_keys(_matrix(batch["sig"]))[order].ravel()
        nodes = np.repeat(nodes[order], BANDS)
        by_key = np.argsort(keys, kind="stable")
        keys, nodes = keys[by_key], nodes[by_key]
        starts = np.concatenate([[True], keys[1:] != keys[:-1]])
        centers = nodes[np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))]
        yield _edges(keys, nodes, centers)


def _join_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Firsts of batches, sorted by key and node: each points to its bucket's very first; lone ones vanish."""
    last_key, last_center = None, 0
    for batch in batches:
        keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not len(keys):
            continue
        starts = np.ones(len(keys), bool)
        starts[1:] = keys[1:] != keys[:-1]
        starts[0] = keys[0] != last_key
        first = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
        top = np.where(first < 0, last_center, nodes[np.maximum(first, 0)])
        last_key, last_center = keys[-1], top[-1]
        yield _edges(keys[~starts], nodes[~starts], top[~starts])


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (node, comp, n, part, sig, words) of one (key, low, high) at a time, from sorted batches."""
    held: list[tuple] = []
    open_key = None
    for batch in batches:
        for row in zip(*(batch[name].to_pylist() for name in ("key", "low", "high", "node", "comp", "n", "part", "sig", "words"))):
            if row[:3] != open_key and held:
                yield held
                held = []
            open_key = row[:3]
            held.append(row[3:])
    if held:
        yield held


class _Block:
    """Members of a bucket, and which of their components are joined so far."""

    def __init__(self, rows: list[tuple], size: int, percent: int, rule: list[tuple[int, int]]):
        self.node, self.comp, self.n, self.part, sigs, self.words = (list(c) for c in zip(*rows))
        self.sig = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, HASHES)
        self.sizes, self.parts = np.array(self.n), np.array(self.part)
        self.top = {c: c for c in self.comp}
        self.size, self.percent, self.rule = size, percent, rule
        self.sets: OrderedDict[int, np.ndarray] = OrderedDict()
        self.held = 0

    def root(self, comp: int) -> int:
        while self.top[comp] != comp:
            self.top[comp] = comp = self.top[self.top[comp]]
        return comp

    def shingles(self, i: int) -> np.ndarray:
        """The set of a member; the least recently used ones make room beyond SET_BYTES."""
        if i in self.sets:
            self.sets.move_to_end(i)
            return self.sets[i]
        found = self.sets[i] = shingles(zstandard.ZstdDecompressor().decompress(self.words[i]).split(), self.size)
        self.held += found.nbytes
        while self.held > SET_BYTES and len(self.sets) > 2:
            self.held -= self.sets.popitem(last=False)[1].nbytes
        return found

    def linked(self, i: int, j: int) -> bool:
        return _similar(self.shingles(i), self.shingles(j), self.percent)

    def links(self) -> Iterator[tuple[int, int]]:
        """True links that join components: a spanning forest of what the block connects."""
        across = len(set(self.part)) > 1  # pairs within a part belong to the part's own group
        for i in range(len(self.node) - 1):
            rest = np.arange(i + 1, len(self.node))
            fit = _sizes_fit(self.sizes[rest], self.sizes[i], self.percent)
            if across:
                fit &= self.parts[rest] != self.parts[i]
            mine = self.root(self.comp[i])
            rest = [j for j in rest[fit].tolist() if self.root(self.comp[j]) != mine]
            if not rest:
                continue
            alive, est = _surviving(np.broadcast_to(self.sig[i], (len(rest), HASHES)), self.sig[rest], self.rule)
            for k in alive[np.argsort(-est, kind="stable")].tolist():
                one, two = self.root(self.comp[i]), self.root(self.comp[rest[k]])
                if one != two and self.linked(i, rest[k]):
                    self.top[max(one, two)] = min(one, two)
                    yield self.node[i], self.node[rest[k]]


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


class _Verifier:
    """Prunes and verifies candidate pairs over the representatives of equal sets."""

    def __init__(self, reps: DataFrame, work: Workspace, size: int, percent: int, miss: float):
        self.reps, self.work, self.size, self.percent = reps, work, size, percent
        self.rule = least_matches(percent / 100, miss)

    def prune(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> (a, b, est) of pairs whose posterior stays above the miss probability."""
        rule, percent = self.rule, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fit = np.flatnonzero(_sizes_fit(batch["na"].to_numpy(), batch["nb"].to_numpy(), percent))
                part = batch.take(pa.array(fit))
                if not part.num_rows:
                    continue
                alive, est = _surviving(_matrix(part["sa"]), _matrix(part["sb"]), rule)
                some = part.take(pa.array(alive))
                yield pa.RecordBatch.from_arrays([some["a"], some["b"], pa.array(est, pa.float64())], ["a", "b", "est"])

        one = self.reps.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        two = self.reps.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        met = split_join(pairs.join(two, "b"), one, "a", "b", pairs.count(), pairs)
        return met.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(run, "a bigint, b bigint, est double")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full shingle sets are similar enough."""
        size, percent = self.size, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            last: tuple[int | None, np.ndarray | None] = (None, None)
            for batch in batches:
                keep = []
                for a, b, wa, wb in zip(*(batch[x].to_pylist() for x in ("a", "b", "wa", "wb"))):
                    if a != last[0]:
                        last = a, shingles(unpack(wa).split(), size)
                    keep.append(_similar(last[1], shingles(unpack(wb).split(), size), percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one = self.reps.select(F.col("row").alias("a"), F.col("words").alias("wa"))
        two = self.reps.select(F.col("row").alias("b"), F.col("words").alias("wb"))
        met = split_join(pairs.select("a", "b").join(two, "b"), one, "a", "b", pairs.count(), pairs)
        return met.select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint")


def _with_roots(rows: DataFrame, roots: DataFrame, col: str) -> DataFrame:
    """Add ``c<col>``, the component of the named column, of which no value is frequent."""
    own = roots.select(F.col("node").alias(col), F.col("root").alias("__root"))
    return rows.join(own, col, "left").withColumn(f"c{col}", F.coalesce("__root", col)).drop("__root")


def _residual_links(edges: DataFrame, roots: DataFrame, reps: DataFrame, work: Workspace, size: int, percent: int, rule: list[tuple[int, int]]) -> DataFrame:
    """Links (a, b) between components, from all pairs of the members of every bucket that has more than one.

    A star shows all links of a bucket only if each of its edges holds; other buckets are compared in full, here: blocks of
    members meet in one task, are pruned by their signatures and verified on their sets, and only links that join
    components become rows, fewer than there are members.  Buckets of equal members are compared once.  A bucket's members
    meet in one task only in these blocks; a node is in at most BANDS edges, but the center of any number.
    """
    total = edges.count()
    centers = _with_roots(edges.groupBy("center").agg(F.count(F.lit(1)).alias("led")), roots, "center")
    told = lookup(_with_roots(edges, roots, "node"), centers, ["center"], "led", total)
    keys = told.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.max(F.col("cnode") != F.col("ccenter")).alias("open"))
    keys = work.save(keys.filter("open").select("key", "cnt"), "open")
    held = lookup(edges, keys, ["key"], "cnt", total)
    members = held.select("key", "node").unionByName(held.select("key", F.col("center").alias("node"))).distinct()
    members = work.save(_with_roots(members, roots, "node").select("key", "node", F.col("cnode").alias("comp")), "members")
    alike = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")
    buckets = members.groupBy("key").agg(alike, F.count(F.lit(1)).alias("cnt")).groupBy("sum", "cnt").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("cnt") / BLOCK).cast("int")
    buckets = work.save(buckets.select("key", "cnt", blocks.alias("blocks")), "buckets")
    members = lookup(members, buckets, ["key"], "cnt", members.count())
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    members = members.join(reps.select(F.col("row").alias("node"), "n", "sig", "words"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bucket_groups(batches):
            if found := list(_Block(rows, size, percent, rule).links()):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.select("key", "low", "high", "node", "comp", "n", "part", "sig", "words").repartition("key", "low", "high")
    return dealt.sortWithinPartitions("key", "low", "high", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, *, words: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Group rows whose sets of word shingles are linked by Jaccard similarities of ``percent`` or more.

    1. Rows with equal sets become one representative.  2. MinHash signatures are cut into bands; in every bucket each
    member is paired with the first of its batch, where it lies; only these firsts travel by the bucket's key and are paired
    with its very first (a star).  3. Pairs are compared batch by batch of hashes and dropped once the posterior probability of
    being similar falls below ``miss``.  4. Each document's likeliest pair is verified on the full shingle sets.  5. Buckets
    whose members are still in different components are compared in full, in blocks, pruned and verified in the same way;
    such a bucket of m members sends m * ceil(m / BLOCK) rows with texts.  ``miss=0`` turns pruning by the posterior off.
    So every candidate pair of different components is decided, and pairs inside a component are not needed.

    Returns per row: ``id_col``, n_shingles, component_id (the smallest id of the component), kept (id = component_id),
    row (a unique number, from ``row_col`` if given), first (whether it is the component's one row that stays, also where ids are null or repeat).

    Null text counts as empty; a row without words has no shingle, is linked with nothing and is its own component.
    Null ids count as larger than all others.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    table = work.save(_describe(docs, words, id_col, text_col, row_col), "described")
    full = table.filter(F.col("n") > 0)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    sets = full.groupBy("digest", "n").agg(first.alias("first"), F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = work.save(sets, "sets")
    first_rows = full.select("row", "sig").join(sets.select(F.col("rep").alias("row")), "row", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stars = work.save(first_rows.mapInArrow(_local_stars, _EDGE), "stars")
    heads = stars.filter("node = center").select("key", "node").repartition(parts, "key").sortWithinPartitions("key", "node")
    edges = work.save(stars.filter("node <> center").unionByName(heads.mapInArrow(_join_stars, _EDGE)), "edges")
    work.drop("stars")
    met = edges.select("node").unionByName(edges.select(F.col("center").alias("node"))).distinct()
    # only documents that share a bucket are looked at again
    reps = full.select("row", "n", "sig", "words").join(met.select(F.col("node").alias("row")), "row", "left_semi")
    reps = work.save(reps, "reps")
    check = _Verifier(reps, work, words, percent, miss)
    pairs = work.save(edges.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    likely = work.save(check.prune(pairs), "likely")
    best = work.save(likely.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")), "best")
    links = work.save(check.confirm(best), "links0")
    work.drop("pairs", "likely", "best")
    roots = components(links, work, "roots0_")
    more = work.save(_residual_links(edges, roots, reps, work, words, percent, check.rule), "links1")
    roots = components(links.unionByName(more), work, "roots1_")

    sets = sets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sets = work.save(sets, "rooted")
    tops = sets.groupBy("root").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("members"))
    sets = work.save(lookup(sets, tops, ["root"], "members", sets.count()).select("digest", "n", "copies", "top"), "named")
    named = lookup(table.filter(F.col("n") > 0).select("row", "id", "n", "digest"), sets, ["digest", "n"], "copies", table.count())
    own = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    lone = table.filter(F.col("n") == 0).select("row", "id", "n", "digest", F.lit(1).cast("bigint").alias("copies"), own.alias("top"))
    return named.select(*lone.columns).unionByName(lone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("top.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("top.id")).alias("kept"),
        "row",
        (F.col("row") == F.col("top.row")).alias("first"),
    )


def near_dedup(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, but of each component of :func:`near_components` only the first row.

    Rows without words are all kept.  Other cases are as there.
    """
    work = Workspace(docs.sparkSession)
    # one stored copy with row numbers: later reads must meet the same numbers even if the input is split anew
    base = work.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("own")), "base")
    texts = base.select("row", F.col(f"own.{id_col}").alias("id"), F.col(f"own.{text_col}").alias("text"))
    found = near_components(texts, words=words, percent=percent, id_col="id", text_col="text", row_col="row")
    gone = found.filter(~F.col("first")).select("row")
    return base.join(gone.hint("shuffle_hash"), "row", "left_anti").select("own.*")
