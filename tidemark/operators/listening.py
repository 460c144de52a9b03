"""Listening samples of speakers: slices of clean runs, or of the longest turns where there are none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WHO = ["recording_id", "speaker_id"]
#: Fixed values in milliseconds: a sample's length, its least pieces by tier, the room between windows of one run, and lengths of pieces from turns.
MOST, CLEAN, RELAXED, ROOM, LEAST_TURN, MOST_TURNS = 30_000, 5_000, 2_000, 1, 700, 15_000
#: Least quality by tier.
CLEAN_QUALITY, RELAXED_QUALITY = 0.60, 0.35


def slices(start: np.ndarray, end: np.ndarray, centrality: np.ndarray, quality: np.ndarray, first: int, last: int, length: int) -> tuple[float, float, int]:
    """The best slice of a length between first and last: centrality weighted by quality and time, mean quality, start. The earliest of equals.

    The best start is an edge of a window or of the run, so that only these are scored, all at once.
    """
    at = np.unique(np.clip(np.concatenate([[first, last - length], start, end - length]), first, last - length))
    shared = np.clip(np.minimum(at[:, None] + length, end) - np.maximum(at[:, None], start), 0, None)
    weight = shared * quality
    total, time = weight.sum(axis=1), shared.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        c, q = np.where(total > 0, weight @ centrality / total, -1.0), np.where(total > 0, weight.sum(axis=1) / time, 0.0)
    k = np.lexsort((at, -q, -c))[0]
    return float(c[k]), float(q[k]), int(at[k])


def chosen(start: np.ndarray, end: np.ndarray, centrality: np.ndarray, quality: np.ndarray, least: int = CLEAN, most: int = MOST) -> list[tuple[int, int, float]]:
    """Slices (start, end, centrality) of runs of windows in order, the best first, one a run, while room of the least length is left."""
    if not len(start):
        return []
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.append(True, start[1:] > reach[:-1] + ROOM))
    runs = [np.arange(a, b) for a, b in zip(cut, np.append(cut[1:], len(start)))]
    open_ = [(r, int(start[r[0]]), int(end[r].max())) for r in runs]
    out, room = [], most
    while room >= least:
        best = []
        for k, (r, first, last) in enumerate(open_):
            length = min(last - first, room)
            if length >= least:
                c, q, at = slices(start[r], end[r], centrality[r], quality[r], first, last, length)
                best.append((-c, -q, -length, at, k))
        if not best:
            break
        c, _, length, at, k = min(best)
        out.append((at, at - length, -c))
        room += length
        del open_[k]
    return sorted(out)


def snippets(windows: DataFrame, least: int = CLEAN, least_quality: float = CLEAN_QUALITY, most: int = MOST) -> DataFrame:
    """WHO, start_ms, end_ms, centrality of the pieces of each speaker's sample; from windows (WHO, start_ms, end_ms, centrality, quality). One group a speaker and recording."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        # of windows with the same bounds the most central counts
        g = g.sort_values(["start_ms", "end_ms", "centrality", "quality"], ascending=[True, True, False, False]).drop_duplicates(["start_ms", "end_ms"])
        rows = chosen(*(g[c].to_numpy() for c in ("start_ms", "end_ms", "centrality", "quality")), least, most)
        return pd.DataFrame([(*g[WHO].iloc[0], *r) for r in rows], columns=[*WHO, "start_ms", "end_ms", "centrality"])

    rows = windows.where((F.col("quality") >= least_quality) & (F.col("end_ms") > F.col("start_ms"))).select(*WHO, "start_ms", "end_ms", "centrality", "quality")
    return rows.groupBy(*WHO).applyInPandas(one, "recording_id string, speaker_id string, start_ms bigint, end_ms bigint, centrality double")


def longest_turns(turns: DataFrame, most: int = MOST_TURNS, least: int = LEAST_TURN) -> DataFrame:
    """WHO, turn_idx, start_ms, end_ms: each speaker's longest turns (the earlier of equals), the last cut so that all together have so many milliseconds.

    As longer turns come first, those too short end the list, and a running sum says what room is left.
    """
    w = W.partitionBy(*WHO).orderBy(F.col("start_ms") - F.col("end_ms"), "start_ms", "turn_idx")
    rows = turns.where(F.col("end_ms") - F.col("start_ms") >= least)
    rows = rows.withColumn("_room", most - F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.where(F.col("_room") >= least).select(*WHO, "turn_idx", "start_ms", F.least("end_ms", F.col("start_ms") + F.col("_room")).alias("end_ms"))


def samples(windows: DataFrame, turns: DataFrame) -> DataFrame:
    """WHO, tier, start_ms, end_ms: each speaker's pieces of the first tier that has any: clean, relaxed, turns_fallback."""
    tiers = [snippets(windows), snippets(windows, RELAXED, RELAXED_QUALITY), longest_turns(turns)]
    out = None
    for name, pieces in zip(("clean", "relaxed", "turns_fallback"), tiers):
        pieces = pieces.select(*WHO, F.lit(name).alias("tier"), "start_ms", "end_ms")
        out = pieces if out is None else out.union(pieces)
    order = F.min(F.when(F.col("tier") == "clean", 0).when(F.col("tier") == "relaxed", 1).otherwise(2)).over(W.partitionBy(*WHO))
    return out.withColumn("_first", F.element_at(F.array(F.lit("clean"), F.lit("relaxed"), F.lit("turns_fallback")), order + 1)).where("tier = _first").drop("_first")
