"""What suffix-array and suffix-tree deduplication share: from texts to groups of sampled suffixes and back to spans.

A window is so many consecutive units (bytes or words) of one text. Each window has one anchor: of the grams of units
in it, the one of smallest hash, the leftmost if several. As the choice depends on nothing but the window, equal windows have
their anchors at equal places. So only the suffixes at anchors (one in a few units or in hundreds) are looked at:

1. Anchors whose gram occurs once in the whole corpus are dropped: their windows have no equal.
2. A segment is an anchor with what its windows reach: `left` units before it and `right` units from it on. Equal segments
   are counted, not kept twice, before they meet.
3. Segments are grouped by what their windows must have in common, at first the anchor's gram. A group above GROUP segments
   is split: the windows' starts, `t` units before the anchor, are halved into two ranges [ta, tb], and the windows of a range
   are grouped by the longer string that runs from `ta` units before the anchor to `window - tb` units after it, again and again.
4. A kernel says for each group's segments which of their windows occur twice or more; these go back to the texts.

Texts that are equal as a whole are one text with a number of copies, and all of their windows are repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import as_bytes, signed, window_minima
from tidemark.llm.tables import forget, release, saved, small

KEY = ["k1", "k2"]
#: Segments in a group before it is split, and segments that a task works on at a time.
GROUP, CHUNK = 50_000, 20_000
#: Keys of texts that a task remembers to drop copies before they are shuffled; with more it begins anew.
SEEN = 500_000


@dataclass(frozen=True)
class Units:
    """How a text is cut into units and how a group's segments are compared."""

    window: int
    gram: int
    #: text -> a context for the other functions and the hashes of its grams
    grams: Callable[[bytes], tuple[object, np.ndarray]]
    #: context, first and last unit (exclusive) -> bytes of these units
    part: Callable[[object, int, int], bytes]
    #: left, right, t1, t2, copies, ta, tb -> for each segment the ranges (lo, hi) of t whose windows are repeats
    repeats: Callable[..., list[list[tuple[int, int]]]]
    #: left, right, ta, window - tb -> the hash of what a range's windows share
    shared: Callable[[bytes, bytes, int, int], int]


def anchors(g: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, and the first and last start of each one's windows."""
    m = window_minima(g, units.window - units.gram + 1)
    if not m.size:
        return m, m, m
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[first], first, np.concatenate([first[1:], [m.size]]) - 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _scan(units: Units):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, grams, again = [], [], []
            for t in as_bytes(b.column("text")):
                g = units.grams(t)[1] if t else np.empty(0, np.uint64)
                sizes.append(max(0, g.size - (units.window - units.gram)))
                h, n = np.unique(g[anchors(g, units)[0]], return_counts=True)
                grams.append(signed(h))
                again.append(signed(h[n > 1]))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(sizes, pa.int64()), _lists(grams), _lists(again)], [*KEY, "windows", "h", "again"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts without copies of its earlier ones, as far back as SEEN texts."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i, k in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist())):
            if k not in seen:
                keep[i] = True
                seen.add(k)
        if len(seen) > SEEN:
            seen.clear()
        yield b if keep.all() else b.filter(pa.array(keep))


def _segments(units: Units):  # noqa: ANN202
    names = [*KEY, "h", "at", "t1", "t2", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            rows: list[tuple] = []
            for i, (t, wanted) in enumerate(zip(as_bytes(b.column("text")), b.column("hs"))):
                context, g = units.grams(t)
                at, first, last = anchors(g, units)
                keep = np.isin(signed(g[at]), np.asarray(wanted.values))
                for a, s1, s2, h in zip(at[keep].tolist(), first[keep].tolist(), last[keep].tolist(), signed(g[at[keep]]).tolist()):
                    rows.append((k1[i], k2[i], h, a, a - s2, a - s1, units.part(context, s1, a), units.part(context, a, s2 + units.window)))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays(_columns(rows), names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(_columns(rows), names)

    return run


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]


def _groups(units: Units):  # noqa: ANN202
    """Segments in order of their group -> q1, q2 and a range of repeats."""
    names = ["q1", "q2", "lo", "hi"]

    def work(t: pa.Table) -> pa.RecordBatch:
        found = units.repeats(*(t.column(c).to_pylist() for c in ("left", "right")), *(t.column(c).to_numpy() for c in ("t1", "t2", "copies", "ta", "tb")))
        q1, q2 = t.column("q1").to_numpy(), t.column("q2").to_numpy()
        rows = [(i, lo, hi) for i, x in enumerate(found) for lo, hi in x]
        i = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(q1[i]), pa.array(q2[i]), *(pa.array([r[j] for r in rows], pa.int32()) for j in (1, 2))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                if n < CHUNK:
                    take = min(b.num_rows, CHUNK - n)
                else:  # to the end of the group
                    last = held[-1].column("g")[-1].as_py()
                    g = b.column("g").to_numpy()
                    take = int(np.argmax(g != last)) if (g != last).any() else g.size
                    if not take:
                        yield work(pa.Table.from_batches(held))
                        held, n = [], 0
                        continue
                held.append(b.slice(0, take))
                n += take
                b = b.slice(take)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _narrow(units: Units):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("left", "right", "ta", "tb")))
            g = pa.array([units.shared(x, y, ta, units.window - tb) for x, y, ta, tb in rows], pa.int64())
            yield b.set_column(b.schema.get_field_index("g"), "g", g)

    return run


def repeated(docs: DataFrame, units: Units, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """docs (text, ...) with k1 and k2, the keys of their texts; and (k1, k2, spans): ranges (lo, hi) of starts of repeated windows.

    Texts are shuffled by their keys to the grams that they hold, never the grams of all texts to every task.
    """
    spark = docs.sparkSession
    docs = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    texts = docs.select(*KEY, "text").where("text is not null")
    sampled = saved(texts.mapInArrow(_scan(units), "k1 bigint, k2 bigint, windows bigint, h array<bigint>, again array<bigint>").where("windows > 0"), "anchors")
    each = sampled.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max("windows").alias("windows"))
    posts = sampled.select(*KEY, F.explode("h").alias("h"))
    often = posts.groupBy("h").agg(*[f(c).alias(f"{n}_{c}") for c in KEY for n, f in (("lo", F.min), ("hi", F.max))]).where("lo_k1 != hi_k1 or lo_k2 != hi_k2").select("h")
    often = saved(often.union(sampled.select(F.explode("again").alias("h"))).distinct(), "grams")
    wanted = posts.join(small(often, 16), "h", "left_semi").groupBy(*KEY).agg(F.collect_set("h").alias("hs")).join(each, KEY)
    wanted = saved(wanted, "wanted")
    every = saved(each.where("copies > 1"), "copies")
    forget(sampled, often)
    release(spark)
    # texts move to their grams by key, at any size; of copies at most one from each task
    chosen = texts.mapInArrow(_once, texts.schema).join(wanted, KEY).select(*KEY, "text", "hs").dropDuplicates(KEY)
    segments = chosen.mapInArrow(_segments(units), "k1 bigint, k2 bigint, h bigint, at bigint, t1 int, t2 int, left binary, right binary")
    name = [F.lit("."), F.col("left"), F.lit("."), F.col("right"), F.col("t1")]
    segments = saved(segments.withColumns({"q1": F.xxhash64(*name), "q2": F.xxhash64(F.lit(7), *name)}), "segments")
    release(spark)
    distinct = segments.groupBy("q1", "q2").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("h", "t1", "t2", "left", "right")])
    distinct = distinct.withColumns({"g": F.col("h"), "ta": F.lit(0), "tb": F.lit(units.window - units.gram)}).drop("h")
    # a segment that is whole twice or more is all repeats, and so are the parts of others that it covers
    work = saved(distinct, "distinct")
    found = None
    while True:
        heavy = small(saved(work.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > group).select("g"), "heavy"), 16)
        ready = work.join(heavy, "g", "left_anti")
        some = saved(ready.repartition("g").sortWithinPartitions("g").mapInArrow(_groups(units), "q1 bigint, q2 bigint, lo int, hi int"), "repeats")
        found = some if found is None else found.union(some)
        rest = work.join(heavy, "g", "left_semi").where("ta < tb")
        # ranges of one start are whole windows: a heavy group of these is all repeats
        ends = work.join(heavy, "g", "left_semi").where("ta = tb").select("q1", "q2", F.col("ta").alias("lo"), F.col("ta").alias("hi"))
        if heavy.isEmpty():
            break
        found = found.union(saved(ends, "repeats"))
        middle = F.floor((F.col("ta") + F.col("tb")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("ta").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("tb").alias("b")))).alias("x")
        rest = rest.select(*[c for c in rest.columns if c not in ("ta", "tb")], halves).select("*", F.col("x.a").alias("ta"), F.col("x.b").alias("tb")).drop("x")
        rest = rest.where((F.col("t1") <= F.col("tb")) & (F.col("t2") >= F.col("ta")))
        before, work = work, saved(rest.mapInArrow(_narrow(units), rest.schema), "distinct")
        forget(before)
        release(spark)
    marks = segments.select(*KEY, "at", "q1", "q2").join(small(found, 32), ["q1", "q2"])
    marks = marks.select(*KEY, F.struct((F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo")).alias("hi")).alias("span"))
    marks = marks.groupBy(*KEY).agg(F.sort_array(F.collect_list("span")).alias("spans"))
    whole = every.select(*KEY, F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("windows") - 1).alias("hi"))).alias("all"))
    spans = marks.join(whole, KEY, "full").select(*KEY, F.coalesce("all", "spans").alias("spans"))
    spans = saved(spans, "spans")
    forget(segments)
    release(spark)
    return docs, spans


def covered(spans: list[dict] | None, window: int, n: int) -> np.ndarray:
    """Which of a text's n units stand in a window whose start is in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["lo"]] += 1
        edge[s["hi"] + window] -= 1
    return np.cumsum(edge[:n]) > 0


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the sets of strings that agree to a depth: strings in sorted order, and how far each agrees with the one before."""
    out = np.empty(order.size, np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def ranges(marks: list[tuple[int, np.ndarray]], n: int) -> list[list[tuple[int, int]]]:
    """From (t, segments whose windows at t are repeats), in ascending t, each segment's maximal ranges of t."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    begun, ended = np.full(n, -1, np.int64), np.full(n, -2, np.int64)
    for t, who in marks:
        new = who[ended[who] != t - 1]
        for i in new[begun[new] >= 0].tolist():
            out[i].append((int(begun[i]), int(ended[i])))
        begun[new] = t
        ended[who] = t
    for i in np.flatnonzero(begun >= 0).tolist():
        out[i].append((int(begun[i]), int(ended[i])))
    return out


def twice(key: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which entries have a key that occurs twice or more, copies counted."""
    _, inverse = np.unique(key, return_inverse=True)
    return np.bincount(inverse, copies)[inverse] > 1
