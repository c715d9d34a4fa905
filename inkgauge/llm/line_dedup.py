"""Line dedup: a suffix array over line ids, by distributed prefix doubling, reveals repeated runs of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, lookup, text_or_empty

#: Sequences of up to 2^MAX_ROUNDS lines can be ranked.
MAX_ROUNDS = 40
_WORD = r"[^\x20\x09-\x0D]+"
#: Prefix sums are taken in two steps, over so many slices of the sort key, so that no single task orders all rows.
_SLICES = 4096
_BEFORE = (Window.unboundedPreceding, -1)


def _lines(base: DataFrame) -> DataFrame:
    """One row per line: two hashes that identify the line, and its number of words."""
    rows = base.select("doc", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hashes = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    # between single spaces the words need no search
    odd = F.col("line").rlike(r"[\x09-\x0D]|  |^ | $|^$")
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    words = F.when(odd, F.regexp_count("line", F.lit(_WORD))).otherwise(spaces + 1)
    return rows.select("doc", "id", "pos", *hashes, words.alias("words"))


def _line_ranks(lines: DataFrame) -> DataFrame:
    """The lines that occur more than once: h1, h2, n (occurrences), rank (rows of lines before it in the hash order)."""
    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    counts = counts.withColumn("slice", F.shiftright("h1", 52))
    slices = counts.groupBy("slice").agg(F.sum("n").alias("slice_n"))
    earlier = F.coalesce(F.sum("slice_n").over(Window.orderBy("slice").rowsBetween(*_BEFORE)), F.lit(0))  # _SLICES rows
    slices = F.broadcast(slices.select("slice", earlier.alias("earlier")))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("slice").orderBy("h1", "h2").rowsBetween(*_BEFORE)), F.lit(0))
    ranked = counts.withColumn("inside", inside).join(slices, "slice")
    return ranked.select("h1", "h2", "n", (F.col("earlier") + F.col("inside") + 1).alias("rank"))


def _refined(groups: DataFrame) -> DataFrame:
    """Groups of equal (rank, next), n rows each: the new rank, which adds the rows of the same rank with smaller next."""
    slices = groups.groupBy("rank", "slice").agg(F.sum("n").alias("slice_n"))
    earlier = F.coalesce(F.sum("slice_n").over(Window.partitionBy("rank").orderBy("slice").rowsBetween(*_BEFORE)), F.lit(0))
    slices = slices.select("rank", "slice", earlier.alias("earlier"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("rank", "slice").orderBy("next").rowsBetween(*_BEFORE)), F.lit(0))
    joined = groups.withColumn("inside", inside).join(slices, ["rank", "slice"])
    return joined.select("rank", "next", "n", (F.col("rank") + F.col("earlier") + F.col("inside")).alias("new"))


def suffix_levels(suffixes: DataFrame, work: Workspace) -> DataFrame:
    """Prefix doubling over all suffixes of the line sequences.

    ``suffixes``: doc, pos, rest (lines from here to the end of the sequence), rank (of the line, from 1), shared.
    Returns doc, pos, k, rank: for each k the suffixes of at least 2^k lines whose first 2^k lines occur elsewhere, too,
    with their rank by these lines: the place in the suffix array of the first suffix that agrees with them (among the
    sequences still open, see below, so that later ranks keep order and equality, and not the very place).

    Each round tells suffixes of equal rank apart by the rank of the suffix 2^k lines on (0 where the sequence ends), so
    2^(k+1) lines are compared.  Ranks and counts come from pre-aggregated groups, so a line that is everywhere is no
    bottleneck.  A sequence is open while one of its suffixes is longer than 2^k and shares its rank; closed ones leave,
    which changes no later comparison: what is left of them is told apart by its end.
    """
    levels, now, most = [], suffixes, suffixes.count()  # no rank is above the number of suffixes
    for k in range(MAX_ROUNDS):
        step = 1 << k
        levels.append(now.filter(F.col("shared") & (F.col("rest") >= step)).select("doc", "pos", F.lit(k).alias("k"), "rank"))
        longer = F.col("rest") > step
        ahead = F.lead("rank", step).over(Window.partitionBy("doc").orderBy("pos"))
        still = F.max(F.col("shared") & longer).over(Window.partitionBy("doc", "seq"))
        seen = now.withColumn("next", F.when(longer, ahead).otherwise(F.lit(0))).withColumn("seq", F.col("pos") + F.col("rest"))
        seen = work.save(seen.withColumn("open", still).filter("open").drop("open", "seq"), f"seen{k}")
        total = seen.count()
        if not total:
            return reduce(DataFrame.unionAll, levels)
        shared = seen.filter("shared").drop("shared")
        groups = shared.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))
        told = work.save(_refined(groups.withColumn("slice", F.expr(f"next * {_SLICES}L div {most + 1}L").cast("int"))), f"told{k}")
        told_rows = lookup(shared, told, ["rank", "next"], "n", total)
        told_rows = told_rows.select("doc", "pos", "rest", F.col("new").alias("rank"), (F.col("n") > 1).alias("shared"))
        alone = seen.filter(~F.col("shared")).select("doc", "pos", "rest", "rank", "shared")
        now = work.save(told_rows.unionByName(alone), f"level{k + 1}")
        work.drop(f"seen{k}", f"told{k}")
    raise ValueError("a line sequence is too long")


def least_runs(places: DataFrame, min_words: int) -> DataFrame:
    """The least runs of at least ``min_words`` words from each position on and up to each position: doc, id, pos, size.

    Every run with so many words is the union of such runs inside it: so lines that any long repeated run covers are
    those that repeated least runs cover.  Borders carry the words before them; a border's partner is found by a sum over
    the sorted words, in one pass.
    """
    seq = Window.partitionBy("doc", "seq")
    upto = F.sum("words").over(seq.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = places.withColumn("seq", F.col("pos") + F.col("rest")).withColumn("upto", upto)
    borders = lines.select("doc", "id", "seq", "pos", (F.col("upto") - F.col("words")).alias("before"))
    last = lines.filter(F.col("rest") == 1).select("doc", "id", "seq", F.col("seq").alias("pos"), F.col("upto").alias("before"))
    borders = borders.unionByName(last).withColumn("back", -F.col("before"))
    reach = (Window.unboundedPreceding, -min_words)
    borders = borders.withColumn("end", F.min("pos").over(seq.orderBy("back").rangeBetween(*reach)))
    borders = borders.withColumn("start", F.max("pos").over(seq.orderBy("before").rangeBetween(*reach)))
    ahead = borders.filter(F.col("end").isNotNull()).select("doc", "id", "pos", (F.col("end") - F.col("pos")).alias("size"))
    behind = borders.filter(F.col("start").isNotNull()).select("doc", "id", F.col("start").alias("pos"), (F.col("pos") - F.col("start")).alias("size"))
    return ahead.unionByName(behind).distinct()


def later_copies(runs: DataFrame, levels: DataFrame, work: Workspace) -> DataFrame:
    """The runs (doc, pos, size) that have an earlier copy which ends before they begin, in the order of id, row, line.

    Two runs of equal size m are copies iff their ranks by 2^k lines agree at both ends, with 2^k <= m < 2^(k+1): they lie
    in one interval of suffixes whose longest common prefix has m lines at least.
    """
    k = F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int")
    runs = runs.withColumn("k", k).withColumn("tail", F.expr("pos + size - shiftleft(1, k)"))
    head = levels.withColumnRenamed("rank", "head_rank")
    tail = levels.select("doc", F.col("pos").alias("tail"), "k", F.col("rank").alias("tail_rank"))
    named = runs.join(head, ["doc", "pos", "k"]).join(tail, ["doc", "tail", "k"])
    named = work.save(named.select("doc", "id", "pos", "size", "head_rank", "tail_rank"), "runs")
    keys = ["head_rank", "tail_rank", "size"]
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "pos")
    firsts = named.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    found = lookup(named, firsts, keys, "n", named.count())
    apart = (F.col("doc") != F.col("first.doc")) | (F.col("pos") >= F.col("first.pos") + F.col("size"))
    return found.filter(apart).select("doc", "pos", "size")


def _merged(runs: DataFrame) -> DataFrame:
    """Per doc the sorted disjoint intervals [start, end) that the runs cover."""
    end = F.col("pos") + F.col("size")
    doc = Window.partitionBy("doc").orderBy("pos", "size")
    reached = F.max(end).over(doc.rowsBetween(*_BEFORE))
    fresh = runs.withColumn("end", end).withColumn("fresh", (F.coalesce(reached, F.lit(-1)) < F.col("pos")).cast("int"))
    fresh = fresh.withColumn("island", F.sum("fresh").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = fresh.groupBy("doc", "island").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))


def line_dedup(docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Delete later copies of runs of whole lines that repeat, within or across documents.

    A run is some consecutive lines (between ``\n``) of one text; it counts from ``min_words`` words on.  Each line that
    lies in a run which has an earlier copy (by id, then row, then line; the copy must end before the run begins if both
    are in one text) is deleted, so the first copy of everything stays, and shorter repeats (headers, licence lines) too.
    Only lines that occur more than once enter the suffix array; any other line ends a sequence.

    Returns the row's own columns, with ``text_col`` replaced by the kept lines, and n_lines, n_removed (replacing any
    columns of these names).

    Null text stays null (no line); empty text is one line without words.  Null ids come last in the order; repeated rows
    are copies of each other.  An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*[F.col(c) for c in own]).alias("row")
    # one stored copy with row numbers: later reads must meet the same numbers even if the input is split anew
    base = work.save(docs.select(F.monotonically_increasing_id().alias("doc"), row), "base")
    lines = base.select("doc", F.col(f"row.{id_col}").cast("bigint").alias("id"), text_or_empty(F.col(f"row.{text_col}")).alias("text"))
    lines = work.save(_lines(lines), "lines")
    ranks = work.save(_line_ranks(lines), "ranks")
    found = lookup(lines, ranks, ["h1", "h2"], "n", lines.count()).select("doc", "id", "pos", "words", "rank")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    rest = F.max("pos").over(Window.partitionBy("doc", "run")) - F.col("pos") + 1
    places = work.save(found.withColumn("run", run).withColumn("rest", rest).drop("run"), "places")
    work.drop("lines", "ranks")
    levels = suffix_levels(places.select("doc", "pos", "rest", "rank", F.lit(True).alias("shared")), work)
    runs = least_runs(places.select("doc", "id", "pos", "rest", "words"), min_words)
    cuts = work.save(_merged(later_copies(runs, levels, work)), "cuts")
    work.drop("runs", "places", *(f"level{k}" for k in range(1, MAX_ROUNDS)))

    text = F.col(f"row.{text_col}").cast("string")
    joined = base.join(cuts.hint("shuffle_hash"), "doc", "left").withColumn("lines", F.split(text, "\n"))
    upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cut", i - 1)["end"])
    on = lambda i: F.when(i == F.size("cut"), F.size("lines")).otherwise(F.get("cut", i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), F.size("cut")), lambda i: F.slice("lines", upto(i) + 1, on(i) - upto(i)))
    kept = F.when(F.col("cut").isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n"))
    gone = F.coalesce(F.aggregate("cut", F.lit(0), lambda n, c: n + c["end"] - c["start"]), F.lit(0))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own],
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        gone.cast("bigint").alias("n_removed"),
    )
