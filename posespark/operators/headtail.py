"""Head-tail resolution: one orientation per frame from two candidates.

Frames are (video, t, theta0, theta1, score0, score1): candidate 0 is the raw
prediction, 1 its flip. Only the fold over frames of one stretch and the propagation over
the few segments of one video are sequential; all else is windows and groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from heapq import heappop, heappush
from math import radians

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import head_tail_cosine, nan
from .lineage import cut
from .timeseries import carried_sum, meet_pieces, streamed_fold

#: Largest mean angle between successive frames, and times in seconds: look-back, least
#: segment, and largest gap over which an orientation spreads.
MAX_ANGLE, LOOK_BACK_S, MIN_SEGMENT_S, MAX_SPREAD_S = radians(30), 0.2, 0.2, 1.0
#: A segment needs more labelled frames than this to be aligned with labels.
MIN_LABELLED = 5
SCORE_THRESHOLD = 0.7
#: Time steps of a piece that is folded on its own.
FOLD_PIECE = 4096


def frames_of(seconds: float, frame_rate: float) -> int:
    return max(1, int(frame_rate * seconds))


def passing(frames: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Frames whose better score reaches the threshold; a missing score fails the frame."""
    known = ~F.isnan("score0") & ~F.isnan("score1")
    return frames.filter(known & (F.greatest("score0", "score1") >= threshold))


def score_guard(frames: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Per video: whether any score is known, the greatest score, and if the video can be resolved.

    All scores missing, or none at the threshold, stop a video; a missing score among
    others does not.
    """
    missing = F.isnan("score0") & F.isnan("score1")
    best = F.max(F.greatest("score0", "score1"))
    table = frames.groupBy("video").agg(F.bool_and(missing).alias("all_missing"), best.alias("best_score"))
    return table.withColumn("resolvable", ~F.col("all_missing") & (F.isnan("best_score") | (F.col("best_score") >= threshold)))


@dataclass
class FoldState:
    """Last accepted frame of a stretch and its chosen angles."""

    t: int | None = None
    theta: np.ndarray | None = None


def angle_between(a: np.ndarray, b: np.ndarray) -> float:
    d = a - b
    return float(np.abs(np.arctan2(np.sin(d), np.cos(d))).mean())


def fold_step(state: FoldState, t: int, theta0: np.ndarray, theta1: np.ndarray, look_back: int) -> tuple[FoldState, tuple[bool, bool, int]]:
    """One frame: (accepted, opens a segment, chosen candidate). Used by batch and stream."""
    if state.t is None or t - state.t > look_back:
        return FoldState(t, theta0), (True, True, 0)
    d0, d1 = angle_between(theta0, state.theta), angle_between(theta1, state.theta)
    k = int(d1 < d0)
    if min(d0, d1) < MAX_ANGLE:
        return FoldState(t, (theta0, theta1)[k]), (True, False, k)
    return state, (False, False, 0)


def _piece_ends(spread: DataFrame, look_back: int) -> DataFrame:
    """Where the fold ends in each piece, for every state it may start with: _piece, start_t, start_k, end_t, end_k.

    States are (t, candidate) of the last accepted frame. A piece starts with one of its halo's frames, or with
    none that still counts (null). All starts are folded side by side; those that meet go on as one, two as a rule.
    """
    kind = dict(spread.dtypes)["video"]
    names = ["video", "_piece", "start_t", "start_k", "end_t", "end_k"]
    placed = spread.repartition("video", "_piece").sortWithinPartitions("video", "_piece", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, ends, states = None, {}, {}

        def closed() -> list[tuple]:
            return [] if mine is None else [(*mine, *(start or (None, None)), *(end or (None, None))) for start, end in ends.items()]

        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if (row.video, row.piece) != mine:
                    done += closed()
                    mine, ends, states = (row.video, row.piece), {None: None}, {None: FoldState()}
                thetas = (np.asarray(row.theta0, float), np.asarray(row.theta1, float))
                if not row.own:
                    for k in (0, 1):
                        ends[row.t, k] = (row.t, k)
                        states[row.t, k] = FoldState(row.t, thetas[k])
                    continue
                moved, after = {}, {}
                for at in set(ends.values()):
                    state, (accepted, opens, k) = fold_step(states[at], row.t, *thetas, look_back)
                    moved[at] = (row.t, k) if accepted else at
                    after[moved[at]] = state
                ends, states = {start: moved[at] for start, at in ends.items()}, after
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame(closed(), columns=names)

    return placed.withColumnsRenamed({"_piece": "piece", "_own": "own"}).mapInPandas(run, f"video {kind}, _piece long, start_t long, start_k int, end_t long, end_k int")


def _piece_starts(ends: DataFrame) -> DataFrame:
    """The state that each piece does start with, video by video along the pieces; pieces that start with none are left out."""
    kind = dict(ends.dtypes)["video"]

    def step(state, row):
        # (piece, its start, end for that start, end for no start); a piece's first row is the one without a start
        piece, start, end, other = state
        mine = None if pd.isna(row.start_t) else (int(row.start_t), int(row.start_k))
        target = None if pd.isna(row.end_t) else (int(row.end_t), int(row.end_k))
        if mine is None:
            start = (end or other) if piece == row.piece - 1 else None
            return (row.piece, start, None, target), (row.video, row.piece, *(start or (None, None)))
        return (piece, start, target if mine == start else end, other), (row.video, row.piece, None, None)

    rows = ends.withColumnRenamed("_piece", "piece")
    found = streamed_fold(rows, ["video"], ["piece", "start_t", "start_k"], lambda: (None, None, None, None), step, f"video {kind}, _piece long, start_t long, start_k int")
    return found.filter("start_t is not null")


def continuous_partitions(frames: DataFrame, frame_rate: float, threshold: float = SCORE_THRESHOLD, piece: int = FOLD_PIECE) -> DataFrame:
    """video, t, segment, k of the accepted frames.

    The fold is sequential, but what it carries is one accepted frame, and that counts for the look-back only. So
    a video is folded in pieces of `piece` time steps: first each piece from every state that the frames just before it can leave,
    then these ends are put together along the video, then each piece from the state it does start with. No
    task folds a whole video, however long it goes on without a pause.
    """
    look_back = frames_of(LOOK_BACK_S, frame_rate)
    if look_back >= piece:
        raise ValueError("a piece must be longer than the look-back")
    good = passing(frames, threshold).select("video", "t", "theta0", "theta1")
    own = F.floor(F.col("t") / piece)
    halo = F.when(F.col("t") - own * piece >= piece - look_back, own + 1)
    spread = good.withColumn("_piece", F.explode(F.array_compact(F.array(own, halo)))).withColumn("_own", F.col("_piece") == own)
    starts = _piece_starts(_piece_ends(spread, look_back))
    started = meet_pieces(spread, starts, ["video", "_piece"], "left").withColumnsRenamed({"_piece": "piece", "_own": "own"})

    def step(state, row):
        if not row.own:
            if not pd.isna(row.start_t) and row.t == row.start_t:
                state = FoldState(row.t, np.asarray(row.theta1 if row.start_k else row.theta0, float))
            return state, (row.video, row.t, False, False, 0)
        state, (accepted, opens, k) = fold_step(state, row.t, np.asarray(row.theta0, float), np.asarray(row.theta1, float), look_back)
        return state, (row.video, row.t, accepted, opens, k)

    kinds = dict(frames.dtypes)
    folded = streamed_fold(started, ["video", "piece"], ["t"], FoldState, step, f"video {kinds['video']}, t {kinds['t']}, accepted boolean, opens boolean, k int")
    taken = cut(folded.filter("accepted").select("video", "t", "opens", "k"))
    numbered = carried_sum(taken, F.col("opens").cast("int"), ["video"], ["t"], "opened")
    return numbered.select("video", "t", (F.col("opened") - 1).cast("int").alias("segment"), "k")


def drop_short(parts: DataFrame, frame_rate: float) -> DataFrame:
    """Frames of segments with enough accepted frames."""
    n = F.count("*").over(Window.partitionBy("video", "segment"))
    return parts.withColumn("_n", n).filter(F.col("_n") >= frames_of(MIN_SEGMENT_S, frame_rate)).drop("_n")


def segments_of(parts: DataFrame) -> DataFrame:
    """video, segment, first_t, last_t, n_frames."""
    return parts.groupBy("video", "segment").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_frames"))


def align_with_labels(parts: DataFrame, skeletons: DataFrame, labels: DataFrame) -> DataFrame:
    """video, segment, n_labelled, cos0, cos1, alignment (null: undecided).

    parts: accepted frames; skeletons: video, t, skeleton0, skeleton1 of the stored order
    (chosen, other); labels: video, t, label. The two mean cosines must differ in
    sign, and more than MIN_LABELLED frames must carry a label.
    """
    some = F.exists("label", lambda p: ~F.isnan(p["x"]) | ~F.isnan(p["y"]))
    met = parts.join(skeletons, ["video", "t"]).join(labels, ["video", "t"], "left")
    cos = [F.when(F.col("label").isNull(), nan()).otherwise(head_tail_cosine(F.col(f"skeleton{k}"), F.col("label"))) for k in (0, 1)]
    labelled = F.coalesce(some, F.lit(False))
    table = met.groupBy("video", "segment").agg(
        F.count_if(labelled).alias("n_labelled"),
        *[F.avg(F.when(labelled, c)).alias(f"cos{k}") for k, c in enumerate(cos)],
    )
    decided = (F.col("n_labelled") > MIN_LABELLED) & (F.col("cos0") * F.col("cos1") < 0)
    return table.withColumn("alignment", F.when(decided, F.when(F.col("cos1") > F.col("cos0"), 1).otherwise(0)))


def adjacent_gaps(segments: DataFrame) -> DataFrame:
    """Adds the distance to the nearer neighbour that is aligned, and which (-1 before, 1 after)."""
    along = Window.partitionBy("video").orderBy("first_t")
    before = F.when(F.lag("alignment").over(along).isNotNull(), F.col("first_t") - F.lag("last_t").over(along))
    after = F.when(F.lead("alignment").over(along).isNotNull(), F.lead("first_t").over(along) - F.col("last_t"))
    open_ = F.col("alignment").isNull()
    table = segments.withColumns({"_before": F.when(open_, before), "_after": F.when(open_, after)})
    nearer = F.col("_before").isNull() | (F.col("_after") < F.col("_before"))
    side = F.when(F.col("_before").isNull() & F.col("_after").isNull(), None).when(nearer & F.col("_after").isNotNull(), 1).otherwise(-1)
    return table.withColumn("gap", F.least("_before", "_after")).withColumn("side", side).drop("_before", "_after")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.hypot(*a) * np.hypot(*b))
    return float(a @ b) / size if size else float("-inf")


def spread(segments: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Aligns open segments of one video with aligned neighbours, the smallest gap first.

    segments: first_t, last_t, alignment (NaN: open) and the head-tail vectors of both
    candidates at both ends (lists first0, first1, last0, last1 of two numbers).
    """
    table = segments.sort_values("first_t").reset_index(drop=True)
    chosen = [None if pd.isna(a) else int(a) for a in table["alignment"]]
    first, last = table["first_t"].tolist(), table["last_t"].tolist()
    end = {name: [np.asarray(v, float) for v in table[name]] for name in ("first0", "first1", "last0", "last1")}
    waiting: list[tuple[int, int, int]] = []  # gap, open segment, side of the aligned one

    def offer(j: int) -> None:
        """The neighbours of an aligned segment that are open."""
        for i, side in ((j - 1, 1), (j + 1, -1)):
            if 0 <= i < len(chosen) and chosen[i] is None:
                gap = first[i] - last[j] if side < 0 else first[j] - last[i]
                if gap <= limit:
                    heappush(waiting, (gap, i, side))

    for j, a in enumerate(chosen):
        if a is not None:
            offer(j)
    while waiting:
        _, i, side = heappop(waiting)
        if chosen[i] is None:
            mine, theirs = ("first", "last") if side < 0 else ("last", "first")
            anchor = end[f"{theirs}{chosen[i + side]}"][i + side]
            chosen[i] = int(_cosine(end[f"{mine}1"][i], anchor) > _cosine(end[f"{mine}0"][i], anchor))
            offer(i)
    table["alignment"] = pd.array(chosen, dtype="Int32")
    return table


def align_neighbours(segments: DataFrame, parts: DataFrame, skeletons: DataFrame, frame_rate: float) -> DataFrame:
    """video, segment, alignment after spreading to neighbours.

    An orientation never crosses a gap above the limit, so the segments between such gaps
    are a group of their own: a long video spreads over tasks.
    """
    def vector(k: int) -> Column:
        s = F.col(f"skeleton{k}")
        return F.array(F.element_at(s, -1)["x"] - F.element_at(s, 1)["x"], F.element_at(s, -1)["y"] - F.element_at(s, 1)["y"])

    met = parts.join(skeletons, ["video", "t"]).select("video", "segment", "t", vector(0).alias("v0"), vector(1).alias("v1"))
    ends = met.groupBy("video", "segment").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        *[f(f"v{k}", "t").alias(f"{name}{k}") for name, f in (("first", F.min_by), ("last", F.max_by)) for k in (0, 1)],
    )
    table = segments.select("video", "segment", "alignment").join(ends, ["video", "segment"])
    limit = frames_of(MAX_SPREAD_S, frame_rate)
    kind = dict(parts.dtypes)["video"]
    along = Window.partitionBy("video").orderBy("first_t")
    apart = F.coalesce((F.col("first_t") - F.lag("last_t").over(along) > limit).cast("int"), F.lit(0))
    table = table.withColumn("_apart", apart).withColumn("_piece", F.sum("_apart").over(along)).drop("_apart")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return spread(group, limit)[["video", "segment", "alignment"]]

    return table.groupBy("video", "_piece").applyInPandas(run, f"video {kind}, segment int, alignment int")


def resolve(frames: DataFrame, skeletons: DataFrame, labels: DataFrame, frame_rate: float, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """video, t, k (null where unresolved) and score for every frame.

    frames as above; skeletons: video, t, skeleton0, skeleton1 in candidate order;
    labels: video, t, label. Videos without an aligned segment stay unresolved.
    """
    parts = cut(drop_short(continuous_partitions(frames, frame_rate, threshold), frame_rate))  # narrow, and used five times
    # stored order: what the fold chose comes first
    stored = skeletons.join(parts, ["video", "t"]).select(
        "video", "t",
        F.when(F.col("k") == 0, F.col("skeleton0")).otherwise(F.col("skeleton1")).alias("skeleton0"),
        F.when(F.col("k") == 0, F.col("skeleton1")).otherwise(F.col("skeleton0")).alias("skeleton1"),
    )
    aligned = align_with_labels(parts, stored, labels)
    final = align_neighbours(aligned, parts, stored, frame_rate)
    chosen = parts.join(final.filter("alignment is not null"), ["video", "segment"]).select("video", "t", "segment", F.col("k").bitwiseXOR(F.col("alignment")).alias("k"))
    out = frames.select("video", "t", "score0", "score1").join(chosen, ["video", "t"], "left")
    score = F.when(F.col("k") == 0, F.col("score0")).when(F.col("k") == 1, F.col("score1"))
    keep = score >= threshold
    return out.select("video", "t", "segment", F.when(keep, F.col("k")).alias("k"), F.when(keep, score).alias("score"))


def resolution_stats(resolved: DataFrame, labels: DataFrame) -> DataFrame:
    """Per video: frames, frames resolved and labelled, and their percentages."""
    counts = resolved.groupBy("video").agg(F.count("*").alias("n_frames"), F.count("k").alias("n_resolved"))
    labelled = labels.groupBy("video").agg(F.count("*").alias("n_labelled"))
    percent: Mapping[str, Column] = {f"{n}_percent": F.round(100 * F.col(f"n_{n}") / F.col("n_frames"), 4) for n in ("resolved", "labelled")}
    return counts.join(labelled, "video", "left").fillna(0, ["n_labelled"]).withColumns(percent)
