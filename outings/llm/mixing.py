"""Mixing sources to target weights: counts by exact length, a bounded knapsack for what is left, seeded documents by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outings.llm.common import free_name, prepared, slices
from outings.sources.tables import materialized

WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False


@dataclass(frozen=True)
class Mix:
    """Sources in the order of their names, null last, get ``weights`` in turn and share ``percent`` % of all words; no
    document is taken more than ``most`` times. ``window`` is the budget, in words, that is left to the knapsack: larger
    rests are first filled with whole documents."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 100
    most: int = 3
    window: int = 1 << 16
    seed: int = 29


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of every text; a null text has none."""
    raw = [t or b"" for t in texts.to_pylist()]
    # A line break before every text keeps words apart.
    data = WORD[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)]
    begins = np.concatenate(([0], np.cumsum(data[1:] & ~data[:-1])))
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return np.diff(begins[np.concatenate(([0], ends))])


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size (words) and, if there is one, the row number of every row."""
    more = [] if row_col is None else [docs[row_col].alias("row")]
    df = prepared(docs).select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), *more,
                               docs[text_col].cast("binary").alias("text"))
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(word_counts(part.column("text")), pa.int64())],
                                                 names=[*names, "size"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", size long")


def source_targets(lengths: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target (double) and budget (whole words) from (source, size, docs).

    All sources get the same words per weight, except those that would pass ``most`` times their size. Each round marks the
    sources that are above, from two sums over the others; there are as many rounds as levels of overflow.
    """
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    # The names are one short row per source; their order decides the weight.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (place % len(mix.weights) + 1).cast("int"))
    sources = materialized(sources.withColumn("weight", weight.cast("long")), "sources")
    all_words = (sources.agg(F.sum("source_size")).first()[0] or 0) * mix.percent
    level, number = Fraction(0), "decimal(38,0)"
    cap = F.col("source_size").cast(number) * (100 * mix.most)
    while True:
        # Words are counted in hundredths, so that the share of all words is whole.
        below = F.col("weight").cast(number) * level.numerator < cap * level.denominator
        row = sources.agg(F.sum(F.when(below, F.lit(0)).otherwise(cap)).alias("capped"),
                          F.sum(F.when(below, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (Fraction(all_words) - int(row["capped"] or 0)) / int(row["open"])
        if new <= level:
            break
        level = new
    share = level / 100
    numerator, denominator = share.numerator, share.denominator
    exact = F.col("weight").cast("double") * (float(numerator) / float(denominator))
    above = F.col("weight").cast(number) * level.numerator >= cap * level.denominator
    target = F.when(above, (F.col("source_size") * mix.most).cast("double")).otherwise(exact)
    return sources.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("budget"))


def subset_counts(sizes: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that the sum comes nearest to ``budget``, the lower one if two are as near.

    Bounded knapsack over sums: a sum remembers the size that reached it first and sums are reached with the fewest copies
    of that size, so going back from the best sum never takes more copies than there are.
    """
    taken = np.zeros(len(sizes), np.int64)
    use = np.flatnonzero((left > 0) & (sizes > 0))
    if budget <= 0 or not len(use):
        return taken
    use = use[np.argsort(-sizes[use], kind="stable")]
    top = budget + int(min(budget, sizes[use].max()))
    owner = np.full(top + 1, -1, np.int64)
    owner[0] = len(sizes)
    for i in use.tolist():
        size, fresh = int(sizes[i]), np.flatnonzero(owner >= 0)
        for _ in range(int(left[i])):
            fresh = fresh[fresh <= top - size] + size
            fresh = fresh[owner[fresh] < 0]
            if not len(fresh):
                break
            owner[fresh] = i
        if owner[budget] >= 0:
            break
    reached = np.flatnonzero(owner >= 0)
    best = int(reached[np.lexsort((reached, np.abs(reached - budget)))[0]])
    while best:
        taken[owner[best]] += 1
        best -= int(sizes[owner[best]])
    # One document that is longer than all of the table may still be nearer.
    more = int(sizes[use].min())
    if more > top and more - budget < budget - int((taken * sizes).sum()):
        taken[:] = 0
        taken[use[-1]] = 1
    return taken


def length_plan(sizes: np.ndarray, docs: np.ndarray, source_size: int, budget: int, mix: Mix) -> tuple[int, np.ndarray]:
    """Copies of every document of a source, and how many documents of each length get one more."""
    none = np.zeros(len(sizes), np.int64)
    if source_size <= 0:
        return 0, none
    full = min(mix.most, budget // source_size)
    rest = budget - full * source_size
    if full == mix.most or rest <= 0:
        return full, none
    # The same share of every length first, then whole documents, longest first, until the knapsack can take over.
    more = np.array([int(d) * rest // source_size for d in docs.tolist()], np.int64)
    rest -= int((more * sizes).sum())
    left = docs - more
    for i in np.argsort(-sizes, kind="stable").tolist():
        if rest <= mix.window:
            break
        size = int(sizes[i])
        if size:
            n = min(int(left[i]), -(-(rest - mix.window) // size), rest // size)
            more[i] += n
            left[i] -= n
            rest -= n * size
    if rest <= mix.window:
        more += subset_counts(sizes, left, rest)
    return full, more


def plan_lengths(lengths: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """source, size, full and more: every document is taken ``full`` times, ``more`` documents of the size once again.

    A task holds the distinct lengths of one source, never its documents.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        full, more = length_plan(frame["size"].to_numpy(), frame["docs"].to_numpy(), int(frame["source_size"].iloc[0]),
                                 int(frame["budget"].iloc[0]), mix)
        return pd.DataFrame({"source": frame["source"], "size": frame["size"], "full": full, "more": more})

    t = targets.withColumnRenamed("source", "of")
    both = lengths.join(t, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "docs", "source_size", "budget")
    return both.groupBy("source").applyInPandas(run, "source string, size long, full long, more long")


def seeded_choice(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """source, size, doc_id, docs, full and chosen: of the ``docs`` rows with this id, ``chosen`` get one more copy.

    Ids of a length are ordered by a seeded hash. 4,096 ranges of the hash are counted first, so no length is sorted in one
    task; rows that share an id are one row here, with their number.
    """
    ids = rows.groupBy("source", "size", "doc_id").agg(F.count("*").alias("docs"))
    ids = ids.withColumn("h", F.xxhash64(F.lit(mix.seed), F.col("doc_id").cast("string")))
    ids = ids.withColumn("block", F.shiftrightunsigned("h", 52))
    up_to = Window.partitionBy("source", "size").orderBy("block")
    blocks = ids.groupBy("source", "size", "block").agg(F.sum("docs").alias("here"))
    blocks = blocks.withColumn("before", F.sum("here").over(up_to) - F.col("here")).drop("here")
    names = ["source", "size"]

    def same(frame: DataFrame, *more: str) -> tuple[DataFrame, Column]:
        out = frame.select(*[F.col(c).alias("_" + c) if c in (*names, *more) else F.col(c) for c in frame.columns])
        on = F.lit(True)
        for c in (*names, *more):
            on = on & F.col(c).eqNullSafe(F.col("_" + c))
        return out, on

    side, on = same(blocks, "block")
    ids = ids.join(side, on).select(*ids.columns, "before")
    inside = Window.partitionBy("source", "size", "block").orderBy("h", F.col("doc_id").cast("string"))
    ids = ids.withColumn("before", F.col("before") + F.sum("docs").over(inside) - F.col("docs"))
    side, on = same(plan)
    chosen = F.least(F.col("docs"), F.greatest(F.lit(0), F.col("more") - F.col("before")))
    return ids.join(side, on).select("source", "size", "doc_id", "docs", "full", chosen.alias("chosen"))


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies of every row: the mix takes it ``copies`` times.

    Only numbers are shuffled. Defined cases: a null text has size 0 and nothing is taken from it; a null source is a source of its
    own, the last; rows that share an id are documents of their own, and which of those with one length and source get one more
    copy does not show in the result; a null id is an id; with no words at all every target is 0; no rows give no rows; extra
    columns are ignored. The result depends on ids, sources and sizes alone, not on the layout of the table.
    """
    rows = materialized(sized(docs, id_col, text_col, source_col), "sizes")
    lengths = materialized(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "lengths")
    targets = materialized(source_targets(lengths, mix), "targets")
    plan = materialized(plan_lengths(lengths, targets, mix), "length-plan")
    chosen = materialized(seeded_choice(rows, plan, mix), "chosen")
    t = targets.withColumnRenamed("source", "of")
    chosen = chosen.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of", "budget")
    # Rows that share id, source and size are the same row of the result; a part of them is written in pieces.
    piece = 100_000
    number = F.explode(F.sequence(F.lit(0), F.floor((F.col("docs") - 1) / piece)))
    parts = chosen.withColumn("piece", number)
    parts = parts.withColumn("here", F.least(F.lit(piece), F.col("docs") - F.col("piece") * piece)).withColumn(
        "more", F.greatest(F.lit(0), F.least(F.col("here"), F.col("chosen") - F.col("piece") * piece)))
    copies = F.explode(F.concat(F.array_repeat(F.col("full") + 1, F.col("more").cast("int")),
                                F.array_repeat(F.col("full"), (F.col("here") - F.col("more")).cast("int"))))
    out = parts.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def take_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, as often as ``mixed`` takes them.

    Rows that share id, source and size stand for each other: their copies are dealt to them in the order of a row number, in
    blocks. Defined cases as in ``mixed``.
    """
    name = free_name(docs, "row")
    numbered = materialized(prepared(docs).withColumn(name, F.monotonically_increasing_id()), "numbered")
    verdict = mixed(numbered, mix, id_col, text_col, source_col).where("copies > 0")
    verdict = verdict.groupBy("doc_id", "source", "size", "copies").agg(F.count("*").alias("docs"))
    rows = sized(numbered, id_col, text_col, source_col, name)
    keys = ["doc_id", "source", "size"]
    # The block of a row is a range of row numbers; blocks are counted, so that a group of copies is never one task.
    blocked = materialized(rows.withColumn("block", F.floor(F.col("row") / 100_000)), "row-blocks")
    here = blocked.groupBy(*keys, "block").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy(*keys).orderBy("block")
    here = here.withColumn("before", F.sum("here").over(earlier) - F.col("here")).drop("here")
    here = here.select(*[F.col(c).alias("_" + c) for c in (*keys, "block")], "before")
    at = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "block").orderBy("row"))
    on = [F.col(c).eqNullSafe(F.col("_" + c)) for c in (*keys, "block")]
    placed = blocked.join(here, on).select(*keys, F.col("row").alias(name), at.alias("at"))
    least = Window.partitionBy(*keys).orderBy(F.col("copies").desc())
    verdict = verdict.withColumn("until", F.sum("docs").over(least)).withColumn("from", F.col("until") - F.col("docs"))
    verdict = verdict.select(*[F.col(c).alias("_" + c) for c in keys], "copies", "from", "until")
    on = [F.col(c).eqNullSafe(F.col("_" + c)) for c in keys]
    taken = placed.join(verdict, on).where("at > from and at <= until").select(name, "copies")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(name)
    return numbered.join(taken, name).select(*docs.columns)
