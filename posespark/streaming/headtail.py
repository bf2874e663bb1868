"""Continuous head-tail partitions over a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.headtail import LOOK_BACK_S, SCORE_THRESHOLD, FoldState, fold_step, frames_of, passing

#: Seconds without a frame after which the state of a video is let go.
IDLE_S = 7 * 24 * 3600.0
STATE = "last_t long, anchor_t long, anchor array<double>, segment int"


def continuous_partitions(frames: DataFrame, frame_rate: float, threshold: float = SCORE_THRESHOLD, idle_s: float = IDLE_S) -> DataFrame:
    """video, t, segment, k of the accepted frames, as the batch operator gives them.

    State is one posture a video, and is let go after idle_s seconds without a frame of the video: one that
    comes later opens segment 0 again. Frames of a video must come in order from one batch
    to the next (within a batch they are sorted); a frame at or before the latest one
    that was seen in an earlier batch is passed over.
    """
    look_back = frames_of(LOOK_BACK_S, frame_rate)
    kind = dict(frames.dtypes)["video"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, anchor_t, anchor, segment = state.get if state.exists else (-(1 << 62), None, None, -1)
        fold = FoldState(anchor_t, None if anchor is None else np.asarray(anchor, float))
        rows = pd.concat(list(batches)).sort_values("t")  # one video's frames of one trigger
        out = []
        for r in rows[rows["t"] > last].itertuples(index=False):
            fold, (accepted, opens, k) = fold_step(fold, int(r.t), np.asarray(r.theta0, float), np.asarray(r.theta1, float), look_back)
            segment += opens
            if accepted:
                out.append((key[0], r.t, segment, k))
        last = max(last, int(rows["t"].max()))
        state.update((last, fold.t, None if fold.theta is None else [float(x) for x in fold.theta], segment))
        state.setTimeoutDuration(int(1000 * idle_s))
        yield pd.DataFrame(out, columns=["video", "t", "segment", "k"])

    good = passing(frames, threshold).select("video", F.col("t").cast("long").alias("t"), "theta0", "theta1")
    return good.groupBy("video").applyInPandasWithState(run, f"video {kind}, t long, segment int, k int", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_scores(frames: DataFrame, time: str = "time", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Frames and mean better score of each video and time window; frames later than `late` are left out."""
    best = F.greatest("score0", "score1")
    per = frames.withWatermark(time, late).groupBy("video", F.window(time, every).alias("w"))
    table = per.agg(F.count("*").alias("n_frames"), F.avg(F.when(~F.isnan(best), best)).alias("mean_score"))
    return table.select("video", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_frames", "mean_score")
