"""Time-series operators: resampling, runs, segments, unwrapping, smoothing, gap filling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import not_a_knot, savgol_weights
from .lineage import cut

#: Post-processing defaults: largest gap to bridge, least run to trust, smoothing window and order.
MAX_GAP, MIN_SEGMENT, SMOOTH_WINDOW, SMOOTH_ORDER = 4, 8, 8, 3
#: Knots of a spline chunk, and of the neighbours it overlaps: a knot's weight falls
#: about fourfold a knot, so 64 of them leave nothing that a double can hold.
CHUNK_KNOTS, OVERLAP_KNOTS = 4096, 64
#: Frames of a piece of a series: windows run over pieces, and what crosses from one to the next is carried by a row a piece.
PIECE = 16_384


def dense_resample(rows: DataFrame, values: Sequence[str], key: str = "video", tick: str = "tick", order: str = "frame_index") -> DataFrame:
    """A row for every tick from 0 to last - first of each series; null where none was seen.

    Of several rows with a tick the one latest in order counts. Ticks are made in two steps, pieces and then their
    ticks, so that a series of any length is no single array and its ticks are made by many tasks: the pieces are dealt out by
    number, since rows as few as they are would be put together into one task.
    """
    last = rows.groupBy(key, tick).agg(F.max_by(F.struct(*values), order).alias("v"))
    bounds = rows.groupBy(key).agg(F.min(tick).alias("lo"), F.max(tick).alias("hi"))
    most = (F.col("hi") - F.col("lo")).cast("int")
    pieces = bounds.select(key, "lo", most.alias("most"), F.explode(F.sequence(F.lit(0), F.floor(most / PIECE).cast("int"))).alias("_piece"))
    pieces = pieces.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "_piece")
    first = F.col("_piece") * PIECE
    every = pieces.select(key, "lo", F.explode(F.sequence(first, F.least(F.col("most"), first + (PIECE - 1)))).alias("t"))
    placed = every.select(key, "t", (F.col("t") + F.col("lo")).alias(tick))
    return placed.join(last, [key, tick], "left").select(key, "t", *[F.col("v")[v].alias(v) for v in values])


def runs(rows: DataFrame, flag: Column, key: str = "video", order: str = "frame_index") -> DataFrame:
    """Maximal runs of an equal flag: start and half-open end.

    A run's number is the count of changes before it; it is counted in pieces, and a change at a seam between two pieces
    counts for the later one. No task holds a series, and a run over many pieces is one group of partial aggregates.
    """
    marked = rows.select(key, order, flag.alias("flag"))
    numbered = carried_steps(marked, F.col("flag"), _changed, [key], [order], "run")
    return numbered.groupBy(key, "run", "flag").agg(F.min(order).alias("run_start"), (F.max(order) + 1).alias("run_end")).drop("run")


def _changed(before: Column, now: Column) -> Column:
    return (~before.eqNullSafe(now)).cast("long")


def valid_runs(rows: DataFrame, valid: Column, key: str = "video", order: str = "frame_index") -> DataFrame:
    return runs(rows, valid, key, order).filter("flag").drop("flag")


def _merged(table: DataFrame, flag: str, key: str, sums: Sequence[str] = ()) -> DataFrame:
    """Neighbouring runs with an equal flag as one; sums are added up."""
    numbered = carried_steps(table, F.col(flag), _changed, [key], ["run_start"], "group")
    return numbered.groupBy(key, "group", flag).agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), *[F.sum(s).alias(s) for s in sums]).drop("group")


def valid_segments(rows: DataFrame, valid: Column, max_gap: int = MAX_GAP, min_segment: int = MIN_SEGMENT, key: str = "video", order: str = "frame_index") -> DataFrame:
    """Stretches that remain when long gaps are cut out; frames must be dense.

    Valid runs of min_segment frames or more are trusted, all else between them is gap,
    and only gaps above max_gap cut the series. Everything after the first pass works
    on runs, not frames.
    """
    table = cut(runs(rows, valid, key, order))  # a row a run, used several times
    length = F.col("run_end") - F.col("run_start")
    table = table.select(key, "run_start", "run_end", (F.col("flag") & (length >= min_segment)).alias("big"), F.when(F.col("flag"), length).otherwise(0).alias("n_valid"))
    gaps = _merged(table, "big", key, ["n_valid"])
    cuts = gaps.withColumn("cut", ~F.col("big") & (length > max_gap)).drop("big")
    parts = _merged(cuts, "cut", key, ["n_valid"]).filter(~F.col("cut"))
    return parts.select(key, F.col("run_start").alias("segment_start"), F.col("run_end").alias("segment_end"), "n_valid")


def in_segments(rows: DataFrame, segments: DataFrame, key: str = "video", order: str = "frame_index") -> DataFrame:
    """rows with the segment_start and segment_end of the segment that holds them, others left out.

    Each segment stands among the rows of every piece that it touches as a row of its own, before the first frame that it has
    there, and is carried forward within the piece.
    """
    last = F.floor((F.col("segment_end") - 1) / PIECE)
    marks = segments.select(key, F.struct("segment_start", "segment_end").alias("_segment"), F.explode(F.sequence(F.floor(F.col("segment_start") / PIECE), last)).alias("_piece"))
    kind = dict(rows.dtypes)[order]
    marks = marks.select(key, F.greatest("_segment.segment_start", F.col("_piece") * PIECE).cast(kind).alias(order), "_segment", "_piece", F.lit(0).alias("_kind"))
    both = rows.withColumns({"_piece": F.floor(F.col(order) / PIECE), "_kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    along = Window.partitionBy(key, "_piece").orderBy(order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_within", F.last("_segment", ignorenulls=True).over(along))
    return carried.filter((F.col("_kind") == 1) & (F.col(order) < F.col("_within.segment_end"))).select(*rows.columns, "_within.*")


def meet_pieces(rows: DataFrame, pieces: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the columns of their piece; null is a key."""
    named = pieces.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(named, same, how).drop(*[f"_of_{k}" for k in keys])


def carried_lag(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str, piece: int = PIECE) -> DataFrame:
    """Adds the value of the row before (null for the first), by windows over pieces of `piece` frames.

    order[0] is a whole frame number. No task holds a series: the last value of each piece goes to the next
    one by a table with a row a piece.
    """
    placed = rows.withColumn("_piece", F.floor(F.col(order[0]) / piece))
    last = placed.groupBy(*keys, "_piece").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece"))).drop("_last")
    along = Window.partitionBy(*keys, "_piece").orderBy(*order)
    inside = placed.withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(along))
    return meet_pieces(inside, last, [*keys, "_piece"]).withColumn(out, F.coalesce("_before", "_carried")["v"]).select(*rows.columns, out)


def carried_sum(rows: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], out: str, piece: int = PIECE) -> DataFrame:
    """Adds the running total of a value, its own row included, by windows over pieces as carried_lag() does."""
    placed = rows.withColumn("_piece", F.floor(F.col(order[0]) / piece)).withColumn("_value", value)
    total = placed.groupBy(*keys, "_piece").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    total = total.withColumn("_carried", F.coalesce(before, F.lit(0))).drop("_total")
    along = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("_inside", F.sum("_value").over(along))
    return meet_pieces(inside, total, [*keys, "_piece"]).withColumn(out, F.col("_carried") + F.col("_inside")).select(*rows.columns, out)


def carried_steps(rows: DataFrame, value: Column, step: Callable[[Column, Column], Column], keys: Sequence[str], order: Sequence[str], out: str, piece: int = PIECE) -> DataFrame:
    """Adds the running total of step(value of the row before, value), a number that is never null; the first row adds 0.

    One pass over pieces: each gives its first and last value and its own total, and the steps across the seams
    are taken between these.
    """
    placed = rows.withColumn("_piece", F.floor(F.col(order[0]) / piece)).withColumn("_value", value)
    along, boxed = Window.partitionBy(*keys, "_piece").orderBy(*order), F.struct(F.col("_value").alias("v"))
    inside = placed.withColumn("_before", F.lag(boxed).over(along))
    inside = inside.withColumn("_step", F.when(F.col("_before").isNotNull(), step(F.col("_before")["v"], F.col("_value")))).drop("_before")
    total = F.coalesce(F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    ends = inside.groupBy(*keys, "_piece").agg(
        F.min_by(boxed, F.struct(*order)).alias("_first"), F.max_by(boxed, F.struct(*order)).alias("_last"), F.coalesce(F.sum("_step"), F.lit(0)).alias("_total"),
    )
    pieces = Window.partitionBy(*keys).orderBy("_piece")
    ends = ends.withColumn("_left", F.lag("_last").over(pieces))
    ends = ends.withColumn("_seam", F.when(F.col("_left").isNotNull(), step(F.col("_left")["v"], F.col("_first")["v"])).otherwise(0))
    carried = F.sum("_seam").over(pieces) + F.coalesce(F.sum("_total").over(pieces.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_carried", carried).drop("_first", "_last", "_total", "_left", "_seam")
    return meet_pieces(inside.withColumn("_inside", total), ends, [*keys, "_piece"]).withColumn(out, F.col("_carried") + F.col("_inside")).select(*rows.columns, out)


def carried_fill(rows: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], back: str | None = None, ahead: str | None = None, piece: int = PIECE) -> DataFrame:
    """Adds the last known value up to each row (back), the next one from it on (ahead), or both; null without any.

    Within pieces by windows that run to the row, one in each direction; the last and the first known value of each piece go on
    to the pieces after and before it, past pieces that know none.
    """
    placed = rows.withColumn("_piece", F.floor(F.col(order[0]) / piece)).withColumn("_value", value)
    known, boxed = F.when(F.col("_value").isNotNull(), F.struct(*order)), F.struct(F.col("_value").alias("v"))
    edges = placed.groupBy(*keys, "_piece").agg(F.min_by(boxed, known).alias("_first"), F.max_by(boxed, known).alias("_last"))
    columns = {}
    for name, edge, place in ((back, "_last", lambda c: F.asc(c)), (ahead, "_first", lambda c: F.desc(c))):
        if name is not None:
            running = Window.partitionBy(*keys).orderBy(place("_piece")).rowsBetween(Window.unboundedPreceding, -1)
            edges = edges.withColumn(f"_from{edge}", F.last(F.when(F.col(edge)["v"].isNotNull(), F.col(edge)), ignorenulls=True).over(running))
            within = Window.partitionBy(*keys, "_piece").orderBy(*[place(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
            placed = placed.withColumn(f"_in{edge}", F.last("_value", ignorenulls=True).over(within))
            columns[name] = F.coalesce(f"_in{edge}", F.col(f"_from{edge}")["v"])
    return meet_pieces(placed, edges.drop("_first", "_last"), [*keys, "_piece"]).withColumns(columns).select(*rows.columns, *columns)


def _turn(before: Column, now: Column) -> Column:
    """What the angle now is turned by, so that it is less than half a turn from the one before."""
    step = now - before
    turned = (step + pi) - 2 * pi * F.floor((step + pi) / (2 * pi)) - pi
    turned = F.when((turned == -pi) & (step > 0), F.lit(pi)).otherwise(turned)
    return F.coalesce(F.when(F.abs(step) < pi, 0.0).otherwise(turned - step), F.lit(0.0))


def unwrap(rows: DataFrame, angle: str, keys: Sequence[str], order: Sequence[str], out: str = "unwrapped") -> DataFrame:
    """Adds the angle without jumps of a whole turn along the order; rows are the valid samples only.

    order[0] is a frame number; a long series is unwrapped in pieces, in one pass.
    """
    return carried_steps(rows, F.col(angle), _turn, keys, order, "_turns").withColumn(out, F.col(angle) + F.col("_turns")).select(*rows.columns, out)


def frame_major_unwrap(frames: DataFrame, theta: str = "theta", key: str = "video", order: str = "t") -> DataFrame:
    """Unwraps angles along the body and on to the next frame: key, order, dim, unwrapped."""
    flat = frames.select(key, order, F.posexplode(theta).alias("dim", "angle"))
    return unwrap(flat, "angle", [key], [order, "dim"])


def unwrapped_frames(frames: DataFrame, theta: str = "theta", key: str = "video", order: str = "frame_index", out: str = "unwrapped") -> DataFrame:
    """key, order and the angles as frame_major_unwrap() turns them, a row a frame; frames without angles are left out.

    Turns along the body stay in their row, and what is carried from frame to frame is one number.
    """
    body = frames.filter(F.size(theta) > 0).select(key, order, F.col(theta).cast("array<double>").alias("_theta"))
    steps = F.transform("_theta", lambda a, i: F.when(i == 0, 0.0).otherwise(_turn(F.get("_theta", i - 1), a)))
    added = lambda sums, step: F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0.0)) + step)
    body = body.withColumn("_along", F.aggregate(steps, F.array().cast("array<double>"), added))
    ends = F.struct(F.element_at("_theta", 1).alias("first"), F.element_at("_theta", -1).alias("last"), F.element_at("_along", -1).alias("turns"))
    carried = carried_steps(body, ends, lambda before, now: before["turns"] + _turn(before["last"], now["first"]), [key], [order], "_turns")
    return carried.select(key, order, F.zip_with("_theta", "_along", lambda a, t: a + (F.col("_turns") + t)).alias(out))


def smooth(
    rows: DataFrame, value: str, window: int = SMOOTH_WINDOW, poly: int = SMOOTH_ORDER, keys: Sequence[str] = ("video", "segment_start"), order: str = "frame_index",
    out: str = "smoothed", piece: int = PIECE, bounds: tuple[str, str] | None = None,
) -> DataFrame:
    """Savitzky-Golay smoothing within groups of consecutive frames; null in groups shorter than the window.

    The value is a number, or an array of equally many numbers in all rows of a group.

    Inner samples take the middle weights, the ends of a group those of the first or
    last full window's polynomial: all are sums over neighbours at fixed offsets.
    An even window counts as the next odd one. A group is smoothed in pieces: each carries the rows within a
    window's reach of its edges from its neighbours as a halo, so the windows never see a whole group. bounds names the columns of
    each row that hold its group's first frame and the end after its last one, as in_segments() gives them. Without them they are
    found by an aggregate, and frames that are missing or repeated in a group are an error: reach is counted in frames.
    """
    window += 1 - window % 2
    if piece < window:
        raise ValueError("the window must not be longer than a piece")
    weights, half = savgol_weights(window, poly), window // 2
    group = [*keys, "_piece"]
    own = F.floor(F.col(order) / piece)
    place = F.col(order) - own * piece
    reach = F.array_compact(F.array(own, F.when(place < window, own - 1), F.when(place >= piece - window, own + 1)))
    spread = rows.withColumn("_piece", F.explode(reach))
    if bounds is not None:
        first, end = map(F.col, bounds)
        touched = (F.col("_piece") >= F.floor(first / piece)) & (F.col("_piece") <= F.floor((end - 1) / piece))
        met = spread.withColumns({"_lo": first, "_n": end - first}).filter(touched)
    else:
        ends = rows.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
        broken = F.raise_error(F.lit("the frames of a group must be consecutive to be smoothed"))
        ends = ends.withColumn("_n", F.when(F.col("_hi") - F.col("_lo") + 1 == F.col("_n"), F.col("_n")).otherwise(broken))
        ends = ends.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_lo") / piece), F.floor(F.col("_hi") / piece))))
        met = meet_pieces(spread, ends, group)
    met = met.withColumn("_at", F.col(order) - F.col("_lo"))
    along = Window.partitionBy(*group).orderBy(order)
    met = met.withColumns({f"_near{k}": F.lead(value, k).over(along) for k in range(1 - window, window)})

    def total(place: int, near: Callable[[int], Column]) -> Column:
        out = F.lit(0.0)
        for j in range(window):
            out = out + F.lit(float(weights[place][j])) * near(j - place)
        return out

    def fitted(place: int) -> Column:
        if not dict(rows.dtypes)[value].startswith("array"):
            return total(place, lambda k: F.col(f"_near{k}"))
        return F.transform(value, lambda _, d: total(place, lambda k: F.get(f"_near{k}", d)))

    result = fitted(half)
    for p in range(half):
        result = F.when(F.col("_at") == p, fitted(p)).otherwise(result)
        result = F.when(F.col("_at") == F.col("_n") - 1 - p, fitted(window - 1 - p)).otherwise(result)
    fits = (F.col("_n") >= window) & (F.col("_n") > poly)
    return met.withColumn(out, F.when(fits, result)).filter(F.col("_piece") == own).select(*rows.columns, out)


def spline_fill(rows: DataFrame, value: str, keys: Sequence[str] = ("video", "segment_start"), order: str = "frame_index", strict: bool = False, out: str = "filled") -> DataFrame:
    """Adds cubic-spline values over each group's known samples (value not null).

    Samples outside the known ones stay null (strict: an error), as do groups of fewer
    than four. A long group is fitted in chunks of CHUNK_KNOTS that overlap by
    OVERLAP_KNOTS on either side, so no task holds a whole series.

    The value is a number, or an array of one length in a group. Each place of an array has its own known samples and is filled as a
    number is; places with the same ones are fitted in one go. Chunks are counted in rows that are known in all places.
    """
    wide = dict(rows.dtypes)[value].startswith("array")
    knot = F.col(value).isNotNull()
    if wide:
        knot = knot & ~F.coalesce(F.exists(value, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    marked = carried_sum(rows, knot.cast("long"), keys, [order], "_knots")
    marked = marked.withColumn("_knot", F.greatest(F.col("_knots") - 1, F.lit(0))).drop("_knots")
    chunk = F.floor(F.col("_knot") / CHUNK_KNOTS)
    at = F.col("_knot") % CHUNK_KNOTS
    chunks = F.array_compact(F.array(
        chunk, F.when(at < OVERLAP_KNOTS, chunk - 1), F.when(at >= CHUNK_KNOTS - OVERLAP_KNOTS, chunk + 1),
    ))
    spread = marked.withColumn("_chunk", F.explode(F.filter(chunks, lambda c: c >= 0))).withColumn("_own", F.col("_chunk") == chunk).drop("_knot")

    names, group = [*rows.columns, out], [*keys, "_chunk"]

    def filled(part: pd.DataFrame) -> pd.DataFrame:
        """Whole groups, one after the other."""
        values, at = part[value].to_numpy(), part[order].to_numpy(float)
        result: list = [None] * len(part)
        bounds = [*_starts(part, group), len(part)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            y = _rows_of(values[a:b]) if wide else values[a:b].astype(float)[:, None]
            result[a:b] = _filled(at[a:b], y) if y.shape[1] else [None] * (b - a)
        if strict and any(r is None or np.isnan(r).any() for r in result):
            raise ValueError("samples outside the spline's knots")
        part[out] = result if wide else np.array([r[0] for r in result], dtype=float)
        return part.loc[part["_own"], names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = int(_starts(part, group)[-1]) if len(part) else 0  # the last group may go on
            held = part.iloc[last:]
            if last:
                yield filled(part.iloc[:last].copy())
        if held is not None and len(held):
            yield filled(held.copy())

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` {'array<double>' if wide else 'double'}"
    placed = spread.repartition(*group).sortWithinPartitions(*group, order)
    number = lambda v: F.when(~F.isnan(v), v)
    return placed.mapInPandas(run, schema).withColumn(out, F.transform(out, number) if wide else number(F.col(out)))


def _rows_of(arrays: np.ndarray) -> np.ndarray:
    """A row for each array, missing where there is none."""
    some = [a is not None for a in arrays]
    known = np.array([a for a in arrays if a is not None], dtype=float)
    y = np.full((len(arrays), known.shape[1] if known.ndim == 2 else 0), np.nan)
    if any(some):
        y[some] = known
    return y


def _filled(at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Splines through the known samples of each column, missing in columns of fewer than four."""
    known, result = ~np.isnan(y), np.full(y.shape, np.nan)
    alike = bool((known == known[:, :1]).all())
    for columns in [slice(None)] if alike else [slice(k, k + 1) for k in range(y.shape[1])]:
        here = known[:, columns][:, 0]
        if here.sum() >= 4:
            result[:, columns] = not_a_knot(at[here], y[here, columns], at)
    return result


def _starts(part: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which another group begins; equal keys stand together, null is a key."""
    new = np.zeros(len(part), dtype=bool)
    new[:1] = True
    for k in keys:
        codes = pd.factorize(part[k], use_na_sentinel=False)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def streamed_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start, step, schema: str) -> DataFrame:
    """A sequential fold over each group in order, that holds one group's state at a time.

    Groups are hash-partitioned and sorted; each task runs through its rows in Arrow
    batches. step(state, row) returns the new state and a tuple to emit.
    """
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for batch in batches:
            emitted = []
            for row in batch.itertuples(index=False):
                mine = tuple(getattr(row, k) for k in keys)
                if mine != group:
                    group, state = mine, start()
                state, out = step(state, row)
                emitted.append(out)
            yield pd.DataFrame(emitted, columns=names)

    return placed.mapInPandas(run, schema)
