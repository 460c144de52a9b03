"""Verification of sentences' speakers against purified cores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least seconds of a sentence that counts, of one that may stand in, the share kept for a core, what another core must be nearer by, rounds.
LEAST_S, SHORT_S, KEEP, MARGIN, ROUNDS = 1.5, 1.0, 0.6, 0.15, 3


def core_kept(samples: DataFrame, score: str, keys: list[str], keep: float = KEEP) -> DataFrame:
    """Samples of each key's core: the highest scores, as many as the share kept but three at least; keys with fewer than three have none."""
    w = W.partitionBy(*keys)
    rows = samples.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc(score), "sample_idx"))})
    return rows.where((F.col("_n") >= 3) & (F.col("_r") <= F.greatest(F.lit(3), F.floor(F.col("_n") * keep)))).drop("_n", "_r")


def _to_others(v: np.ndarray) -> np.ndarray:
    """Each vector's cosine to the sum of the others."""
    rest = v.sum(axis=0) - v
    return (v * rest).sum(axis=1) / np.maximum(np.linalg.norm(rest, axis=1), 1e-9)


def cores(vectors: np.ndarray, speaker: np.ndarray, seconds: np.ndarray, clean: np.ndarray) -> dict[str, np.ndarray]:
    """A direction for each speaker with three sentences or more, from those most like the others; clean ones of LEAST_S if there are four, else any of SHORT_S."""
    out = {}
    for name in np.unique(speaker):
        own = np.flatnonzero((speaker == name) & clean & (seconds >= LEAST_S))
        if own.size < 4:
            own = np.flatnonzero((speaker == name) & (seconds >= SHORT_S))
        if own.size >= 3:
            best = np.argsort(_to_others(vectors[own]))[::-1][: max(3, int(own.size * KEEP))]
            core = vectors[own[best]].sum(axis=0)
            out[name] = core / np.linalg.norm(core)
    return out


def _compared(vectors: np.ndarray, speaker: np.ndarray, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a sentence's speaker has a core, and its cosine to its own core and to each of the others (-inf for its own), in order of name."""
    names = np.array(sorted(known))
    cosine = vectors @ np.stack([known[n] for n in names]).T
    mine = speaker[:, None] == names
    own = np.where(mine, cosine, -np.inf).max(axis=1)
    return mine.any(axis=1), own, np.where(mine, -np.inf, cosine)


def verified(vectors: np.ndarray, speaker: np.ndarray, seconds: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """Speakers after up to ROUNDS rounds, cores fixed within a round; and for each sentence the first other speaker that would still fit clearly better."""
    speaker = speaker.copy()
    for _ in range(ROUNDS):
        known = cores(vectors, speaker, seconds, clean)
        if len(known) < 2:
            break
        has, own, other = _compared(vectors, speaker, known)
        move = has & clean & (seconds >= LEAST_S) & (other.max(axis=1) >= own + MARGIN)
        if not move.any():
            break
        speaker[move] = np.array(sorted(known))[other[move].argmax(axis=1)]
    known = cores(vectors, speaker, seconds, clean)
    if len(known) < 2:
        return speaker, [None] * len(speaker)
    has, own, other = _compared(vectors, speaker, known)
    clear = other >= (own + MARGIN)[:, None]
    names = sorted(known)
    return speaker, [names[int(c.argmax())] if h and c.any() else None for h, c in zip(has, clear)]


def verify(sentences: DataFrame) -> DataFrame:
    """recording_id, sent_idx, speaker, verified, suggested, reason of sentences (..., t0, t1, overlap, vector). One group a recording, as each round needs all its speakers' cores."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t0", "sent_idx"])
        overlap = g["overlap"].to_numpy(bool)
        now, hint = verified(np.stack(g["vector"]), g["speaker"].to_numpy(object).astype(str), (g["t1"] - g["t0"]).to_numpy(), ~overlap)
        reason = [None if h is None else "overlap" if o else "too_short" for h, o in zip(hint, overlap)]
        return g[["recording_id", "sent_idx", "speaker"]].assign(verified=now, suggested=hint, reason=reason)

    rows = sentences.select("recording_id", "sent_idx", "speaker", "t0", "t1", "overlap", "vector")
    return rows.groupBy("recording_id").applyInPandas(one, "recording_id string, sent_idx bigint, speaker string, verified string, suggested string, reason string")
