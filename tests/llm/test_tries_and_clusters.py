"""The conversation trie and the centroid clustering against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import clusters, conversations

TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, key string, depth string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), mark[: conversations.KEY], (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c % 5 == 0 else zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = dict.fromkeys(nodes, 0)
    leaves, saved = dict(kids), dict(kids)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        own = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += own
    ends = lambda path: ",".join(map(str, sorted(c for c in nodes[path] if len(convs[c]) == len(path))))
    return {(min(m), len(p)): (min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in nodes.items()}


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n=60, longest=14):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        shared = r.random() < 0.6
        for turn in range(r.choice([1, 2, 3, 4, longest])):
            # few texts, so that conversations begin alike, go on alike, or are the same
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"t{turn if shared else r.randrange(3)}"))
    rows += [(None, 0, "user", "no id"), (400, None, None, None), (400, 0, "user", None), (400, 0, "user", None), (405, 3, None, "é"), (405, None, "user", "z")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400, 5) for t in range(3)]
    return rows


@pytest.mark.parametrize(("width", "cells"), [(512, 1 << 20), (512, 40), (3, 1 << 20), (3, 12), (2, 4), (1, 1)])
def test_trie(spark, width, cells):
    rows = made(width)
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], TURNS).repartition(6)
    turns = conversations.with_shared_openings(conversations.keyed_turns(df))
    assert found(conversations.prefix_trie(turns, width, cells)) == trie(rebuilt(rows))


def test_one_conversation_in_many_shards(spark):
    """Most rows belong to one conversation, whose turns are numbered over several shards and stand in many rows."""
    rows = [(5, t, "user", f"t{t % 7}") for t in range(500)] + [(c, t, "user", f"t{t % 7}") for c in (6, 7, 8, 10) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = conversations.keyed_turns(df)
        assert sorted((r.conv, r.i) for r in turns.collect()) == sorted((c, t) for c, t, _, _ in rows)
        got = found(conversations.prefix_trie(conversations.with_shared_openings(turns), 16, 64))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == trie(rebuilt(rows))


def test_no_conversations(spark):
    df = spark.createDataFrame([(None, 1, "user", "x", "", "", "")], TURNS)
    for t in (df, df.limit(0)):
        assert conversations.prefix_trie(conversations.with_shared_openings(conversations.keyed_turns(t))).count() == 0


def plain_clusters(vectors, k, rounds):
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    q = np.array([x for _, x in kept])
    marks = [("~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept]
    c = np.array([x for _, x in sorted(marks)[:k]])
    assign = lambda: ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        at = assign().argmin(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = q[at == j].sum(axis=0) // (at == j).sum()
    d = assign()
    at, least = d.argmin(axis=1), d.min(axis=1)
    return sorted((str(i), int(a), int(x), int(least[at == a].sum()), int(least.sum()), c[a].tolist()) for (i, _), a, x in zip(kept, at, least, strict=True))


VECTORS = "vec_id bigint, embedding array<float>, cluster string, q string, distance string"


def clustered_rows(df, **more):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in clusters.clustered(df, **more).collect())


@pytest.mark.parametrize("leading", [1, 12, 64])
def test_clusters(spark, leading):
    r = np.random.default_rng(leading)
    middles = r.normal(0, 0.3, (9, 64))
    vectors = [(i, (middles[i % 9] + r.normal(0, 0.05, 64)).astype(np.float32).tolist()) for i in range(400)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] * 64]
    # ties: halves away from each other, and rows with one id
    vectors += [(1000 + i, v) for i, v in enumerate(odd)] + [(2000 + i, [float(i % 2)] * 64) for i in range(40)] + [(3000, [1.0] * 64)] * 3 + [(None, [3.0] * 64)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors], VECTORS).repartition(5)
    assert clustered_rows(df, leading=leading) == plain_clusters(vectors, 16, 3)


def test_few_or_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    rows = lambda x: spark.createDataFrame([(*v, "", "", "") for v in x], VECTORS)
    assert clustered_rows(rows(few)) == plain_clusters(few, 16, 3)
    assert clustered_rows(rows([(None, [2.0] * 64), (4, None)])) == plain_clusters([(None, [2.0] * 64)], 16, 3)
    assert clusters.clustered(rows([(4, None)])).collect() == [] == clusters.clustered(rows(few).limit(0)).collect()


def test_filter_spares_distances():
    """The bound is never above the true distance, and most centroids need none."""
    r = np.random.default_rng(2)
    middles = r.normal(0, 40, (16, 64)) * np.linspace(2, 0.01, 64)
    q = np.floor(middles[r.integers(0, 16, 3000)] + r.normal(0, 3, (3000, 64))).astype(np.int64)
    c = np.floor(middles).astype(np.int64)
    x = q - q.mean(axis=0)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :12]
    lead, rest = clusters._rotated(q.astype(float), q.mean(axis=0), axes)
    at, least, taken = clusters.nearest(q, lead, rest, c, q.mean(axis=0), axes)
    true = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (at == true.argmin(axis=1)).all() and (least == true.min(axis=1)).all()
    assert taken < 2 * len(q)


def test_large_components(spark):
    """Distances near the end of a long, a large common part, and components that are too large."""
    big = float((clusters.MOST - 64) // 64)
    vectors = [(i, [big if j % 2 == i % 2 else -big for j in range(64)]) for i in range(20)] + [(100 + i, [1000.0 + i / 64] * 64) for i in range(20)]
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in [*vectors, (999, [float(clusters.MOST)] * 64)]], VECTORS)
    assert clustered_rows(df) == plain_clusters(vectors, 16, 3)
