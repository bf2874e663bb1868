"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, in_order, part_of, place_of

#: Copies of a source's words that the mix takes at most.
MOST_COPIES = 3
#: Up to so many sources their plan is sent to every task; a longer one is joined by shuffle.
MOST_SENT = 20_000
#: Weights of the sources in code-point order, repeated.
CYCLE = (1, 2, 3)
#: A document of so many words has half the highest preference.
HALF_PREFERRED = 200
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keys(docs: DataFrame) -> DataFrame:
    """What the mix needs of each row, under names of its own."""
    size = n_words(F.col("text"))
    return docs.withColumns({"_size": size}).withColumns({
        "_id": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))),
        "_check": F.coalesce(F.xxhash64("text"), F.lit(0)),
        # preference for longer documents in thousandths, so that sums are exact
        "_prefer": F.expr(f"(1000 * _size) div (_size + {HALF_PREFERRED})"),
        "_source": F.col("source"),
    })


def source_targets(sizes: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """Targets of the sources: shares of all words by weight, at most `most` times
    a source's own words, what is above being shared again by weight.

    sizes: _source, source_size, and more. One round of resharing is an aggregate
    over the table of sources that brings two numbers to the driver; a round only
    follows where another source reached its limit.
    """
    ranked = in_order(sizes, F.col("_source").asc_nulls_last())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy(part_of(F.col("_row")).alias("_part")).agg(F.count("*").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    place = F.col("_before") + place_of(F.col("_row"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    weighted = (
        ranked.withColumn("_part", part_of(F.col("_row"))).join(F.broadcast(parts), "_part")
        .withColumn("_weight", F.element_at(weights, (place % len(cycle) + 1).cast("int")))
        .withColumn("_limit", F.col("source_size") * most)
        .drop("_part", "_before", "_row")
    )
    weighted = cut(weighted)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        over = F.col("_limit") < F.lit(level) * F.col("_weight")
        n, limits, free = weighted.agg(F.count_if(over), F.sum(F.when(over, F.col("_limit"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total - (limits or 0)) / free
    return weighted.withColumn("target", F.least(F.col("_limit").cast("double"), F.lit(level) * F.col("_weight")))


@dataclass
class Mix:
    """A plan of the mix: one row a source with its target and where its sample ends."""

    sources: DataFrame
    seed: int
    sent: bool
    split: bool

    def copies(self, docs: DataFrame) -> DataFrame:
        """docs with _size, source_size, target and _copies, by each row's own values.

        Equal rows (of one source, doc_id and text) draw the same number. Where a sample ends
        among them, or takes one of them to fill what is missing, they are numbered, each task's
        rows by themselves with offsets from one count a task, and the first ones are taken.
        """
        rows = _joined(_keys(docs), self.sources, self.seed, self.sent)
        here = F.struct("_rank", "_id", "_check")
        drawn = F.col("_p") > 0
        at_cut, at_fill = drawn & (here == F.col("_cut")), drawn & (here == F.col("_fill"))
        rows = rows.withColumn("_quota", F.when(at_cut, F.col("_take")).when(at_fill, F.lit(1)))
        rows = rows.withColumn("_many", F.coalesce((at_cut & (F.col("_take") > 0) & (F.col("_cut_n") > 1)) | (at_fill & (F.col("_fill_n") > 1)), F.lit(False)))
        inside = drawn & ((here < F.col("_cut")) | (F.col("_cut").isNull() & (here <= F.col("_last"))))
        if not self.split:
            extra = F.when(inside | (F.col("_quota") > 0), 1).otherwise(0)
            return rows.withColumn("_copies", (F.col("_whole") + extra).cast("int"))
        alone = rows.filter("not _many").withColumn("_copies", (F.col("_whole") + F.when(inside | (F.col("_quota") > 0), 1).otherwise(0)).cast("int"))
        many = cut(rows.filter("_many").withColumn("_row", F.monotonically_increasing_id())).withColumn("_task", part_of(F.col("_row")))
        group = ["_source", "_rank", "_id", "_check"]
        counts = many.groupBy("_task", *group).agg(F.count("*").alias("_n"))  # a row for each task and group, two groups a source at most
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        many = many.withColumn("_nth", F.row_number().over(Window.partitionBy("_task", *group).orderBy("_row")))
        counts = counts.select(F.col("_task").alias("_of_task"), *[F.col(c).alias(f"_of{c}") for c in group], "_before")
        same = (F.col("_task") == F.col("_of_task")) & F.col("_source").eqNullSafe(F.col("_of_source"))
        for c in group[1:]:
            same = same & (F.col(c) == F.col(f"_of{c}"))
        many = many.join(counts, same).withColumn("_copies", (F.col("_whole") + (F.col("_before") + F.col("_nth") <= F.col("_quota")).cast("int")).cast("int"))
        return alone.unionByName(many.select(*alone.columns))


def _joined(rows: DataFrame, sources: DataFrame, seed: int, sent: bool) -> DataFrame:
    """rows with their source's plan, inclusion probability _p and Pareto rank _rank."""
    plan = sources.withColumnRenamed("_source", "_of")
    if sent:
        plan = F.broadcast(plan)
    out = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    # the tilt keeps each probability within 0 and 1 and the expected words exact
    tilt = F.least(F.lit(1.0), (1 - F.col("_part_copy")) / F.col("_part_copy"))
    p = F.col("_part_copy") * (1 + tilt * (F.col("_prefer") / 1000 - F.col("_mean_prefer")))
    draw = (F.pmod(F.xxhash64(F.lit(seed), "_id", "_check"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    out = out.withColumn("_p", F.when(F.col("_part_copy") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).otherwise(0.0))
    out = out.withColumn("_u", draw)
    odds = (F.col("_u") / (1 - F.col("_u"))) * (1 - F.col("_p")) / F.col("_p")
    return out.withColumn("_rank", F.when(F.col("_p") > 0, odds).otherwise(F.lit(float("inf")))).drop("_u")


def plan_mix(docs: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST_COPIES, seed: int = SEED) -> Mix:
    """Plans a mix in which each source's words come to its target.

    A source with target T and S words takes r = T / S copies on average. Every
    document gets floor(r) whole copies for certain; one more goes to a sample with
    inclusion probabilities around r - floor(r), tilted towards longer documents.
    Documents of a source are ranked by random odds over inclusion odds (Pareto
    order sampling; the random number is a hash of seed, doc_id and text) and the
    sample is a run of that order whose fixed size, counted in words, is what
    the certain copies leave of the target: the run ends before the document that
    would exceed it, and the later document that fills the rest best joins it (this
    one is chosen by its size, not by the sampling). Which run that is follows from sums for
    range partitions; rows are looked at one by one in one partition per source only.

    Null text and texts without words have size 0; null source is a source of its
    own, after the others; null doc_id is the least id. Rows equal in source, doc_id and
    text are counted before they move, draw the same number and stand side by side in the
    order; the run can end among them. An empty table gives no rows.
    """
    meta = cut(_keys(docs).groupBy("_id", "_check", "_size", "_prefer", "_source").agg(F.count("*").alias("_n")))
    words = F.col("_size") * F.col("_n")
    sizes = meta.groupBy("_source").agg(F.sum(words).alias("source_size"), F.sum(words * F.col("_prefer")).alias("_preferred"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = source_targets(sizes, cycle, most).select(
        "_source", "source_size", "target",
        F.floor(ratio).alias("_whole"),
        (ratio - F.floor(ratio)).alias("_part_copy"),
        (F.coalesce(F.col("_preferred") / F.nullif("source_size", F.lit(0)), F.lit(0.0)) / 1000).alias("_mean_prefer"),
    )
    sources = cut(sources)
    sent = sources.count() <= MOST_SENT
    need = (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_need")
    drawn = _joined(meta, sources, seed, sent).filter("_p > 0").select("_source", "_rank", "_id", "_check", "_size", "_n", need)
    rows = in_order(drawn, F.col("_source"), F.col("_rank"), F.col("_id"), F.col("_check"))
    rows = rows.withColumn("_part", part_of(F.col("_row")))
    here = F.struct("_rank", "_id", "_check")
    # a row for each source and partition that holds some of it
    parts = rows.groupBy("_source", "_part").agg(F.sum(words).alias("_words"), F.first("_need").alias("_need"))
    before = F.sum("_words").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_start", F.coalesce(before, F.lit(0)))
    ends = parts.filter("_start < _need and _start + _words >= _need")
    ends = ends.unionByName(_last_part(parts))
    ends = ends.groupBy(F.col("_source").alias("_of")).agg(F.min(F.struct("_part", "_start")).alias("_end"))
    ends = ends.select("_of", F.col("_end._part").alias("_in"), F.col("_end._start").alias("_start"))
    inside = rows.join(ends, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    through = F.sum(words).over(Window.partitionBy("_source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_before", F.col("_start") + through - words)
    # the first rows that do not all fit, and how many of them do; none where all of the partition fits
    over = F.col("_before") + words > F.col("_need")
    first = F.struct(here.alias("cut"), "_size", F.col("_n").alias("_cut_n"), "_need", "_before")
    last = inside.groupBy(F.col("_source").alias("_of")).agg(F.min(F.when(over, first)).alias("_first"), F.max(here).alias("_last"))
    last = last.select("_of", F.col("_first.cut").alias("_cut"), "_last", F.col("_first._cut_n").alias("_cut_n"),
                       F.floor((F.col("_first._need") - F.col("_first._before")) / F.col("_first._size")).alias("_take"),
                       (F.col("_first._need") - F.col("_first._before")).alias("_left"), F.col("_first._size").alias("_cut_size"))
    last = cut(last.withColumn("_gap", F.col("_left") - F.col("_take") * F.col("_cut_size")).drop("_left", "_cut_size"))
    # of all rows after the run, the one that fills what is missing best
    rest = rows.join(last, F.col("_source").eqNullSafe(F.col("_of"))).filter(here >= F.col("_cut"))
    off = F.abs(F.col("_gap") - F.col("_size"))
    fill = rest.filter(off < F.col("_gap")).groupBy(F.col("_source").alias("_of")).agg(F.min_by(F.struct(here.alias("fill"), F.col("_n").alias("n")), F.struct(off, here)).alias("_best"))
    ended = sources.join(last.drop("_gap"), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    ended = ended.join(fill, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    own = F.col("_best.fill") == F.col("_cut")
    ended = ended.withColumns({
        "_take": F.col("_take") + F.coalesce(own.cast("int"), F.lit(0)),
        "_fill": F.when(~own, F.col("_best.fill")), "_fill_n": F.when(~own, F.col("_best.n")),
    }).drop("_best")
    ended = cut(ended)
    split = not ended.filter("(_take > 0 and _cut_n > 1) or _fill_n > 1").isEmpty()
    return Mix(ended, seed, sent, split)


def _last_part(parts: DataFrame) -> DataFrame:
    """The last partition of each source, which holds the end where all words are needed."""
    last = parts.groupBy(F.col("_source").alias("_of")).agg(F.max("_part").alias("_in"))
    return parts.join(last, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in"))).drop("_of", "_in")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and the words taken of each document; null, empty and repeated rows as in plan_mix()."""
    mix = plan_mix(docs)
    rows = mix.copies(docs.select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it.

    Rows without words come along as their draw falls; other columns stay as they are,
    whatever their names. An empty table gives no rows; null and repeated rows as in plan_mix().
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = plan_mix(docs).copies(whole).filter("_copies > 0")
    repeated = rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return repeated.select("_doc.*")
