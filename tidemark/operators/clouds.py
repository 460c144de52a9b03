"""Speaker clouds, their representatives, and one-to-one matching with known profiles.

A speaker's samples of one recording are one group: their streaming components, inliers and prototype depend on their order. Support and scores are a join of speakers
and profiles by recording, and the assignment gets one row for each such pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import dot, weighted_mean_vector

#: Fixed values.
SAME, SHARE, RATIO, COMPONENTS = 0.45, 0.60, 1.5, 256
MATCH, MATCH_SUPPORT, STRONG, STRONG_SUPPORT, NOBODY, STABLE, TENTATIVE = 0.60, 0.60, 0.75, 0.80, 0.55, 0.04, 0.45
NEAR_VECTOR, ALIKE, CANDIDATES, PUBLIC = 0.5, 0.995, 512, 64
IMPOSSIBLE = -1e6
WHO = ["recording_id", "speaker_id"]
#: Columns of samples beside WHO.
OWN = ("sample_idx bigint", "start_ms bigint", "end_ms bigint", "seconds double", "weight double", "vector array<double>")


def _in_time(g: pd.DataFrame) -> pd.DataFrame:
    """Samples by start (those without one last), end and number."""
    return g.sort_values(["start_ms", "end_ms", "sample_idx"], na_position="last", kind="stable")


def components(vectors: np.ndarray, weights: np.ndarray, room: int = COMPONENTS) -> np.ndarray:
    """Each vector's component, in order: that of the likest weighted mean so far if its cosine is SAME or more, else a new one; -1 where there is no room."""
    sums = np.empty((0, vectors.shape[1]))
    out = []
    for x, w in zip(vectors, weights):
        cosines = sums @ x / np.linalg.norm(sums, axis=1)
        if (cosines >= SAME).any():
            k = int(cosines.argmax())
            sums[k] += w * x
        elif len(sums) < room:
            k = len(sums)
            sums = np.concatenate([sums, w * x[None]])
        else:
            k = -1
        out.append(k)
    return np.array(out, np.int64)


def labelled(samples: DataFrame, room: int = COMPONENTS) -> DataFrame:
    """samples with `place`, their order within the recording's speaker, and `component`."""
    schema = ", ".join(["recording_id string", "speaker_id string", *OWN, "place bigint", "component bigint"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = _in_time(g)
        return g.assign(place=np.arange(len(g)), component=components(np.stack(g["vector"]), g["weight"].to_numpy(), room))

    return samples.select(*WHO, *[c.split()[0] for c in OWN]).groupBy(*WHO).applyInPandas(one, schema)


def direction(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted mean, scaled to length 1."""
    total = weights @ vectors
    return total / max(np.linalg.norm(total), 1e-12)


def near_common(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which samples are near their common direction: by cosine at least SAME and the median less 3 scaled deviations; all if two or fewer, or if none is near."""
    cosines = vectors @ direction(vectors, weights)
    spread = np.median(np.abs(cosines - np.median(cosines)))
    near = cosines >= max(SAME, np.median(cosines) - 3 * 1.4826 * spread)
    return near if len(weights) > 2 and near.any() else np.ones(len(weights), bool)


def _cloud(g: pd.DataFrame, room: int) -> tuple:
    """status, purity, prototype and the rows of the inliers of one speaker's samples in time order."""
    v, w = np.stack(g["vector"]), g["weight"].to_numpy()
    label = components(v, w, room)
    # components are numbered as they come, so the earlier of equals leads
    by = np.bincount(label[label >= 0], w[label >= 0])
    first, second = by.max(), np.delete(by, by.argmax()).max(initial=0.0)
    kept = np.flatnonzero(label == by.argmax())
    for _ in range(2):
        kept = kept[near_common(v[kept], w[kept])]
    safe, full, purity = len(kept) >= 2 and g["seconds"].to_numpy()[kept].sum() >= 4.0, (label < 0).any(), first / w.sum()
    mixed = full or purity < SHARE or (second and first < RATIO * second)
    if full and not safe:  # no prototype from what happened to fit in
        return "mixed_cluster", purity, None, kept[:0]
    return "mixed_cluster" if mixed else "ready" if safe else "low_support", purity, direction(v[kept], w[kept]), kept


CLOUD = "recording_id string, speaker_id string, status string, purity double, candidates bigint, kept bigint, discarded bigint, prototype array<double>, ids array<bigint>, starts array<double>, weights array<double>, vectors array<array<double>>"


def clouds(samples: DataFrame, room: int = COMPONENTS) -> DataFrame:
    """WHO, status, purity, candidates, kept, discarded, prototype, and of the inliers (the samples that it rests on, in time order) ids, starts, weights and vectors. One shuffle."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = _in_time(g)
        status, purity, prototype, kept = _cloud(g, room)
        held = g.iloc[kept]
        row = (*g[WHO].iloc[0], status, purity, len(g), len(kept), len(g) - len(kept), prototype, held["sample_idx"].tolist(), held["start_ms"].astype(float).tolist(), held["weight"].tolist(), held["vector"].tolist())
        return pd.DataFrame([row], columns=[c.split()[0] for c in CLOUD.split(", ")])

    return samples.select(*WHO, *[c.split()[0] for c in OWN]).groupBy(*WHO).applyInPandas(one, CLOUD)


def plain_clouds(samples: DataFrame) -> DataFrame:
    """WHO, status, purity, candidates, kept, discarded, prototype and the ids of the inliers, of speakers taken to be one voice each: the weighted mean of all samples, and those near it. No grouped function."""
    near = samples.join(weighted_mean_vector(samples, WHO), WHO).withColumn("near", dot(F.col("vector"), F.col("prototype")) >= SAME)
    c = near.groupBy(*WHO).agg(
        (F.coalesce(F.sum(F.when(F.col("near"), F.col("weight"))), F.lit(0.0)) / F.sum("weight")).alias("purity"), F.count("*").alias("candidates"), F.count_if("near").alias("kept"), F.sum(F.when(F.col("near"), F.col("seconds"))).alias("kept_s"),
        F.min("prototype").alias("prototype"), F.sort_array(F.collect_list(F.when(F.col("near"), F.col("sample_idx")))).alias("ids"),
    )
    status = F.when(F.col("purity") < SHARE, "mixed_cluster").when((F.col("kept") >= 2) & (F.col("kept_s") >= 4), "ready").otherwise("low_support")
    return c.select(*WHO, status.alias("status"), "purity", "candidates", "kept", (F.col("candidates") - F.col("kept")).alias("discarded"), "prototype", "ids")


def best_assignment(score: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of greatest total (rows at most columns): shortest augmenting paths with potentials."""
    n, m = score.shape
    cost = -score
    u, v, row_of = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m], j = i, m
        least, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            slack = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (slack < least)
            least[better], back[better] = slack[better], j
            open_ = np.where(done[:m], np.inf, least)
            k = int(open_.argmin())
            step = open_[k]
            for c in np.flatnonzero(done):
                u[row_of[c]] += step
                v[c] -= step
            least[~done[:m]] -= step
            j = k
        while j != m:
            row_of[j] = row_of[back[j]]
            j = back[j]
    out = np.full(n, -1)
    for c in range(m):
        if row_of[c] >= 0:
            out[row_of[c]] = c
    return out


def losses(score: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """By how much the best total falls if a row may not have its column."""
    rows = np.arange(len(score))
    mine = columns[:, None] == np.arange(score.shape[1])

    def total(allowed: np.ndarray) -> float:
        s = np.where(allowed, score, IMPOSSIBLE)
        return s[rows, best_assignment(s)].sum()

    best = score[rows, columns].sum()
    return np.array([best - total(~mine | (rows != r)[:, None]) for r in rows])


def match(score: np.ndarray, valid: np.ndarray) -> list[tuple[int, int, float]]:
    """Stable pairs (profile, speaker, loss) of a greatest total, where a profile may stay alone at NOBODY.

    Pairs whose loss is under STABLE are ruled out and the rest is assigned anew, until all are stable.
    """
    n, m = score.shape
    alone = np.where(np.eye(n, dtype=bool), NOBODY, IMPOSSIBLE)
    allowed = valid.copy()
    while True:
        wide = np.concatenate([np.where(allowed, score, IMPOSSIBLE), alone], axis=1)
        columns = best_assignment(wide)
        lost = losses(wide, columns)
        paired = np.flatnonzero((columns < m) & (wide[np.arange(n), columns] > IMPOSSIBLE / 2))
        shaky = paired[lost[paired] < STABLE]
        if not shaky.size:
            return [(int(i), int(columns[i]), float(lost[i])) for i in paired]
        allowed[shaky, columns[shaky]] = False


def tentative(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Pairs (profile, speaker, loss) among those left over, from a cosine of TENTATIVE on; shown, not accepted."""
    n, m = score.shape
    alone = np.where(np.eye(n, dtype=bool), TENTATIVE - 1e-6, IMPOSSIBLE)
    wide = np.concatenate([np.where(score >= TENTATIVE, score, IMPOSSIBLE), alone], axis=1)
    columns = best_assignment(wide)
    lost = losses(wide, columns)
    return [(i, int(j), float(lost[i])) for i, j in enumerate(columns) if j < m]


def valid_edge() -> Column:
    return F.when(F.col("status") == "ready", (F.col("cosine") >= MATCH) & (F.col("support") >= MATCH_SUPPORT)).otherwise((F.col("cosine") >= STRONG) & (F.col("support") >= STRONG_SUPPORT))


MATCHED = "recording_id string, profile_id string, speaker_id string, cosine double, support double, margin double, accepted boolean"


def _assigned(edges: pd.DataFrame) -> pd.DataFrame:
    """All edges of one recording's profiles and speakers -> the pairs."""
    table = lambda c: edges.pivot(index="profile_id", columns="speaker_id", values=c).sort_index().sort_index(axis=1)
    score, held, valid = table("cosine"), table("support"), table("valid").to_numpy(bool)
    pairs = [(i, j, loss, True) for i, j, loss in match(score.to_numpy(), valid)]
    left, free = (np.setdiff1d(np.arange(size), [p[k] for p in pairs]) for k, size in enumerate(score.shape))
    if left.size and free.size:
        pairs += [(left[i], free[j], loss, False) for i, j, loss in tentative(score.to_numpy()[np.ix_(left, free)])]
    rows = [(edges["recording_id"].iloc[0], score.index[i], score.columns[j], score.iat[i, j], held.iat[i, j], loss, ok) for i, j, loss, ok in pairs]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in MATCHED.split(", ")])


def matches(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Accepted and tentative pairs of profiles (recording_id, profile_id, profile_vector) and speakers, one to one within a recording.

    A profile's vectors are samples of equal weight, of which the inliers count. The grouped function gets one row for each profile and speaker of a recording.
    """
    none = F.lit(None).cast("bigint")
    known = profiles.select("recording_id", F.col("profile_id").alias("speaker_id"), F.xxhash64("profile_vector").alias("sample_idx"), none.alias("start_ms"), none.alias("end_ms"), F.lit(3.0).alias("seconds"), F.lit(1.0).alias("weight"), F.col("profile_vector").alias("vector"))
    known = clouds(known).where("prototype is not null and status != 'mixed_cluster'").select("recording_id", F.col("speaker_id").alias("profile_id"), F.col("prototype").alias("profile"), F.col("vectors").alias("own"))
    edges = clouds(samples).where("prototype is not null").select(*WHO, "status", "prototype", "weights", "vectors").join(known, "recording_id")
    near = lambda v: F.exists("own", lambda o: dot(v, o) >= NEAR_VECTOR)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    held = total(F.zip_with("weights", "vectors", lambda w, v: F.when(near(v), w).otherwise(0.0))) / total("weights")
    edges = edges.select(*WHO, "profile_id", "status", dot(F.col("prototype"), F.col("profile")).alias("cosine"), F.coalesce(held, F.lit(0.0)).alias("support")).withColumn("valid", valid_edge())
    return edges.select(*WHO, "profile_id", "cosine", "support", "valid").groupBy("recording_id").applyInPandas(_assigned, MATCHED)


def reservoir(n: int, room: int = CANDIDATES) -> np.ndarray:
    """Which of n items in order a deterministic reservoir holds: item i goes to slot mix(i) mod (i + 1) if there is one, the last to come stays."""
    if n <= room:
        return np.arange(n)
    i = np.arange(n, dtype=np.uint64)
    z = i + np.uint64(0x9E3779B97F4A7C15)  # fixed values of SplitMix64
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    slot = np.where(i < room, i, (z ^ (z >> np.uint64(31))) % (i + np.uint64(1)))
    out = np.zeros(room, np.int64)
    held = np.flatnonzero(slot < room)
    np.maximum.at(out, slot[held].astype(np.int64), held)
    return out


def representatives(vectors: np.ndarray, weights: np.ndarray, start: np.ndarray, most: int = PUBLIC - 1) -> list[int]:
    """Up to `most` items (in time order, weights by row) that show a speaker's range, by start.

    From a bounded reservoir that holds the heaviest item, near-copies of heavier items go; of more than `most`, the heaviest and then
    each time the one whose distance to those chosen, times its weight, is greatest.
    """
    if not len(weights):
        return []
    pool = reservoir(len(weights))
    if (top := int(weights.argmax())) not in pool:
        pool[-1] = top
    late = np.nan_to_num(start, nan=np.inf)
    pool = pool[np.lexsort((late[pool], -weights[pool]))]
    cosine = vectors[pool] @ vectors[pool].T
    alive = np.ones(pool.size, bool)
    for k in range(pool.size):
        if alive[k]:
            alive[k + 1 :] &= cosine[k, k + 1 :] < ALIKE
    pool, cosine = pool[alive], cosine[np.ix_(alive, alive)]
    if pool.size > most:
        chosen, gap = [int(weights[pool].argmax())], np.full(pool.size, np.inf)
        while len(chosen) < most:
            gap = np.minimum(gap, 1 - cosine[chosen[-1]])
            value = gap * weights[pool]
            value[chosen] = -1.0
            chosen.append(int(value.argmax()))
        pool = pool[chosen]
    return pool[np.argsort(np.nan_to_num(start[pool], nan=-1), kind="stable")].tolist()


def public_vectors(samples: DataFrame, most: int = PUBLIC) -> DataFrame:
    """Of each speaker with a prototype: the prototype (place 0) and its representatives, with sample_idx or null."""
    names = [*WHO, "place", "sample_idx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for recording, speaker, vectors, weights, start, ids in zip(*(b[c] for c in ("recording_id", "speaker_id", "v", "w", "s", "i"))):
                picked = representatives(np.stack(vectors), np.asarray(weights), np.asarray(start, float), most - 1) if len(ids) else []
                rows += [(recording, speaker, 0, None), *((recording, speaker, k, ids[i]) for k, i in enumerate(picked, 1))]
            yield pd.DataFrame(rows, columns=names).astype({"sample_idx": "Int64"})

    c = clouds(samples).where("prototype is not null").select(*WHO, F.col("vectors").alias("v"), F.col("weights").alias("w"), F.col("starts").alias("s"), F.col("ids").alias("i"))
    return c.mapInPandas(run, "recording_id string, speaker_id string, place bigint, sample_idx bigint")
