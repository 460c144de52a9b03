"""The prefix trie of conversations: which openings conversations share, and what sharing them saves.

A turn is known by 16 bytes of a hash of its role and text, so texts are read once and never shuffled. Conversations become rows of turn keys, sorted into range
shards. A shard is worked on in bounded pieces: the keys become a padded matrix of small numbers, numpy sorts it column by column, and
ORing the changes from row to row over the columns marks where the nodes of each depth start; sums, minima and counts of all nodes of a depth are
then one reduceat, from the deepest to the root, carrying what stands below.

A node that lies inside a piece is complete. Only the nodes on the first and on the last row's path can go on in another piece. These paths are written with
what the piece knows of them and recombined by node: counts are added, and what the nodes of these paths own themselves is charged to one of
the paths, summed from its end upwards, and added up by node.

However long a conversation is, a row holds `width` turns of it at most. The rows of a later part form tries of their own, one for each different beginning, whose
totals are charged to one conversation each and carried by the rows above. A conversation's turns are numbered in range shards too, so
one conversation may hold any share of all rows; conversations that are alike are split by their ids. Conversation ids of one node that
are hashed together pass through one task as a stream of slices, since a hash is made in order.

Defined results: null conv_ids are left out; null roles and texts are empty; turns that share conv_id and turn (null turns are first) are taken in the order of their
SHA-256; repeated rows are turns each; a conversation that is rebuilt without turns is a member of the root; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import saved, small

#: Turns in a row, cells of a padded matrix, and conversation ids in a slice of those that a hash takes.
WIDTH, CELLS, SLICE = 512, 1 << 20, 1000
KEY = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """conv, i (from 0, by turn), key, bytes of each row of conversations (conv_id, turn, role, text, ...)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", F.substring(key, 1, KEY).alias("key"), F.octet_length(text).cast("bigint").alias("bytes"))
    turns = saved(turns, "turns").repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            conv = b.column("conv").to_numpy()
            if not conv.size:
                continue
            first = conv[0] if first is None else first
            starts = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
            began = np.full(conv.size, -n)  # rows that go on with the conversation of the batch before
            if starts.size:
                began[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, conv.size)))
            local = np.arange(conv.size) - began
            last, n = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(np.full(conv.size, shard)), pa.array(conv == first), pa.array(local), b.column("key"), b.column("bytes")], ["conv", "shard", "head", "local", "key", "bytes"])

    rows = saved(turns.mapInArrow(run, "conv bigint, shard bigint, head boolean, local bigint, key binary, bytes bigint"), "numbered")
    # how many turns of a shard's first and last conversation stand in the shards before it: two rows for each shard
    ends = rows.groupBy("shard").agg(F.min("conv").alias("conv"), (F.max(F.when(F.col("head"), F.col("local"))) + 1).alias("n"), F.max(F.struct("conv", "local")).alias("last"))
    runs = ends.select("shard", "conv", "n").union(ends.where("last.conv != conv").select("shard", "last.conv", F.col("last.local") + 1))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = saved(runs.withColumn("before", before).where("before > 0").select("shard", "conv", "before"), "before", 0)
    return rows.join(small(before, 24), ["shard", "conv"], "left").select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("i"), "key", "bytes")


def with_shared_openings(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv, pos, key, bytes of rebuilt conversations, and for each conversation a row without key at the place after its last turn.

    Conversation c has the first h turns of conversation c - c % family (all if fewer, none if absent), h = crc32 of its decimal id, modulo most,
    and then its own turns after its first h.
    """
    turns = saved(turns, "indexed")
    base = F.col("conv") - F.col("conv") % family
    taken = F.when(F.col("conv") % family == 0, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", taken).withColumn("base", base)
    heads = turns.where((F.col("conv") % family == 0) & (F.col("i") < most - 1)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "key", "bytes"))).alias("head"))
    lead = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.col("h").cast("int"))).otherwise(F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(b"").alias("key"), F.lit(0).cast("bigint").alias("bytes"))), 1, 0))
    convs = saved(convs.join(heads, "base", "left").select("conv", "n", "h", lead.alias("lead")), "families")
    # where the base has fewer turns than were asked for, the own turns move up
    less = small(saved(convs.where(F.size("lead") < F.col("h")).select("conv", (F.col("h") - F.size("lead")).alias("less")), "short"), 16)
    own = turns.where(F.col("i") >= taken).join(less, "conv", "left").select("conv", (F.col("i") - F.coalesce("less", F.lit(0))).alias("pos"), "key", "bytes")
    given = convs.select("conv", F.explode("lead").alias("t")).select("conv", F.col("t.i").alias("pos"), "t.key", "t.bytes")
    after = convs.select("conv", (F.size("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("bigint").alias("bytes"))
    return own.union(given).union(after)


def _paths(keys: np.ndarray, top: bytes) -> list[bytes]:
    """A key for each node on a row's path, from the keys of its turns."""
    out = [top]
    for k in keys:
        out.append(hashlib.sha256(out[-1] + k).digest()[:KEY])
    return out


NODE = "kind int, conv bigint, depth bigint, parent bigint, n bigint, kids bigint, leaves bigint, saved bigint, ends string, copy boolean, key binary, up binary, bytes bigint, path bigint, seq bigint"
INSIDE, EDGE, ENDS = range(3)


class _Piece:
    """Sorted rows of a shard, and the nodes that they make."""

    def __init__(self, b: pa.RecordBatch, width: int, path: int) -> None:
        self.width, self.path = width, path
        fixed = lambda x: np.frombuffer(x.cast(pa.binary(KEY)).buffers()[1], f"V{KEY}")[x.offset : x.offset + len(x)].view(f"S{KEY}") if len(x) else np.empty(0, f"S{KEY}")
        column = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        size = pc.list_value_length(b.column("keys")).to_numpy().astype(np.int64)
        keys, turn_bytes = fixed(pa.concat_arrays([b.column("keys").flatten()])), b.column("sizes").flatten().to_numpy()
        top, self.deepest = fixed(pa.concat_arrays([b.column("top")])), int(size.max())
        began = np.concatenate([[0], np.cumsum(size)])
        names, ids = np.unique(keys, return_inverse=True)
        matrix = np.full((len(size), self.deepest), -1, np.int32)
        cells = np.arange(self.deepest)[None, :] < size[:, None]
        matrix[cells] = ids
        _, group = np.unique(top, return_inverse=True)
        order = np.lexsort((column("conv"), *matrix.T[::-1], group))
        self.matrix, self.group, self.size, self.began = matrix[order], group[order], size[order], began[:-1][order]
        self.conv, self.block, self.up_bytes = (column(c)[order] for c in ("conv", "block", "up_bytes"))
        self.more = {"leaves": column("more_leaves")[order], "saved": column("more_saved")[order]}
        self.turn_bytes, self.n = turn_bytes, len(size)
        raw = lambda x: x.ljust(KEY, b"\0")  # noqa: E731  numpy leaves out zeros at an end
        self.ends_of = [_paths([raw(names[i]) for i in self.matrix[r, : self.size[r]]], raw(top[order[r]])) for r in (0, -1)]

    def starts(self) -> list[np.ndarray]:
        """Where the rows of each depth's nodes (and of what ended before) begin."""
        change = np.ones(self.n, bool)
        change[1:] = self.group[1:] != self.group[:-1]
        out = [np.flatnonzero(change)]
        for d in range(self.deepest):
            change[1:] |= self.matrix[1:, d] != self.matrix[:-1, d]
            out.append(np.flatnonzero(change))
        return out

    def nodes(self) -> Iterator[pa.RecordBatch]:
        starts, names = self.starts(), [x.split()[0] for x in NODE.split(", ")]
        written = list(map(str, self.conv.tolist()))
        below = {"leaves": np.zeros(self.n, np.int64), "saved": np.zeros(self.n, np.int64)}
        child, child_edge = np.empty(0, np.int64), np.empty(0, bool)
        for d in range(self.deepest, -1, -1):
            s = starts[d]
            here = np.flatnonzero(self.size[s] >= d)
            if not here.size:
                continue
            at, copy = s[here], d == self.width
            n, conv = np.diff(np.append(s, self.n))[here], np.minimum.reduceat(self.conv, s)[here]
            ended = np.zeros(here.size, np.int64) if copy else np.add.reduceat((self.size == d).astype(np.int64), s)[here]
            edge = np.zeros(here.size, bool)
            edge[0] |= self.size[0] >= d
            edge[-1] |= self.size[-1] >= d
            of = np.searchsorted(s, child, "right") - 1
            kids = np.bincount(of[~child_edge], minlength=s.size)[here]
            size = self.turn_bytes[self.began[at] + d - 1] if d else self.up_bytes[at]
            own = {"leaves": kids == 0, "saved": (n - 1) * size}
            for k, sums in below.items():
                if copy:
                    sums += self.more[k]
                else:
                    sums[at[~edge]] += own[k][~edge]
            total = {k: np.add.reduceat(sums, s)[here] for k, sums in below.items()}
            depth = self.block[at] * self.width + d
            parent, up = np.zeros(here.size, np.int64), np.zeros(here.size, np.int64)  # up: 1 and 2 for the edges
            if d:
                of = np.searchsorted(starts[d - 1], at, "right") - 1
                parent, up = np.minimum.reduceat(self.conv, starts[d - 1])[of], np.where(of == 0, 1, np.where(of == starts[d - 1].size - 1, 2, 0))
            child, child_edge = at, edge
            inner = np.flatnonzero(~edge)
            if inner.size:
                ends = [hashlib.sha256(",".join(written[a : a + e]).encode()).hexdigest() if e else EMPTY for a, e in zip(at[inner].tolist(), ended[inner].tolist(), strict=True)]
                unknown = (up[inner] > 0) | (d == 0)
                ups = pa.array([None, *(x[d - 1] if 0 < d <= len(x) else None for x in self.ends_of)], pa.binary()).take(pa.array(up[inner]))
                null = lambda kind: pa.nulls(inner.size, kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(inner.size, INSIDE, np.int32)), pa.array(conv[inner]), pa.array(depth[inner]), pa.array(parent[inner], mask=unknown), pa.array(n[inner]), pa.array(kids[inner].astype(np.int64)), pa.array(total["leaves"][inner]), pa.array(total["saved"][inner]), pa.array(ends), pa.array(np.full(inner.size, copy)), null(pa.binary()), ups, *[null(pa.int64())] * 3],
                    names,
                )
            rows = []
            for side, path in enumerate(self.ends_of):
                if len(path) > d:
                    k = -1 if side else 0
                    # what the first path has counted already
                    some = 0 if side and s.size == 1 else 1
                    numbers = [some * int(x[k]) for x in (n, kids, total["leaves"], total["saved"])]
                    rows.append((EDGE, int(conv[k]), int(depth[k]), None, *numbers, None, copy, path[d], path[d - 1] if d else None, int(size[k]), 2 * self.path + side, None))
                    for i in range(0, some * int(ended[k]), SLICE):
                        text = ",".join(written[at[k] + i : at[k] + min(i + SLICE, int(ended[k]))])
                        rows.append((ENDS, None, None, None, None, None, None, None, text, None, path[d], None, None, 2 * self.path + side, i))
            if rows:
                kinds = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _pieces(width: int, most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = TaskContext.get().partitionId() << 32
        for b in batches:
            size = pc.list_value_length(b.column("keys")).to_numpy()
            at = 0
            while at < b.num_rows:
                cost = np.maximum.accumulate(size[at:]) * np.arange(1, b.num_rows - at + 1)
                k = max(1, int(np.searchsorted(cost, most, "right")))
                yield from _Piece(b.slice(at, k), width, path).nodes()
                at, path = at + k, path + 1

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's slices, which come in order."""
    key, hashed = None, None
    for b in batches:
        done = []
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k == key:
                hashed.update(b"," + text.encode())
            else:
                if hashed:
                    done.append((key, hashed.hexdigest()))
                key, hashed = k, hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done])], ["key", "ends"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([hashed.hexdigest()])], ["key", "ends"])


def _trie(rows: DataFrame, width: int, cells: int) -> DataFrame:
    """conv, depth, parent, n, kids, leaves, saved, ends, copy of the nodes of rows (top, block, conv, keys, sizes, up_bytes, more_leaves, more_saved).

    copy marks the nodes at the end of full rows, which stand at the top of the next part's tries as well.
    """
    rows = rows.repartitionByRange("top", "keys", "conv").sortWithinPartitions("top", "keys", "conv")
    found = saved(rows.mapInArrow(_pieces(width, cells), NODE), "nodes")
    paths = found.where(F.col("kind") == EDGE)
    numbers = ("n", "kids", "leaves", "saved")
    nodes = paths.groupBy("key").agg(*(F.min(c).alias(c) for c in ("conv", "depth", "up", "bytes", "copy", "path")), *(F.sum(c).alias(c) for c in numbers))
    nodes = saved(nodes, "edge-nodes")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("edge_kids"))
    nodes = nodes.join(kids, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("edge_kids", F.lit(0)))
    own = F.when(F.col("copy"), 0)
    nodes = saved(nodes.withColumn("own_leaves", own.otherwise((F.col("kids") == 0).cast("bigint"))).withColumn("own_saved", own.otherwise((F.col("n") - 1) * F.col("bytes"))).drop("edge_kids"), "edge-nodes")
    # a node's own numbers go to one of its paths; summed from the path's end they reach all nodes above
    charged = paths.select("path", "depth", "key").join(small(nodes.select("key", F.col("path").alias("chosen"), "own_leaves", "own_saved"), 48), "key")
    upwards = Window.partitionBy("path").orderBy(F.col("depth").desc())
    sums = charged.select("key", *(F.sum(F.when(F.col("path") == F.col("chosen"), F.col(c)).otherwise(0)).over(upwards).alias(c) for c in ("own_leaves", "own_saved")))
    sums = sums.groupBy("key").agg(F.sum("own_leaves").alias("own_leaves"), F.sum("own_saved").alias("own_saved"))
    ends = found.where(F.col("kind") == ENDS).select("key", "path", "seq", "ends").repartition("key").sortWithinPartitions("key", "path", "seq").mapInArrow(_digests, "key binary, ends string")
    known = small(saved(nodes.select(F.col("key").alias("up"), F.col("conv").alias("up_conv")), "edge-convs"), 40)
    edges = nodes.drop("own_leaves", "own_saved").join(sums, "key").join(ends, "key", "left").join(known, "up", "left")
    edges = edges.select("conv", "depth", F.col("up_conv").alias("parent"), "n", "kids", (F.col("leaves") + F.col("own_leaves")).alias("leaves"), (F.col("saved") + F.col("own_saved")).alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"), "copy")
    inside = found.where(F.col("kind") == INSIDE).join(known, "up", "left")
    return inside.select("conv", "depth", F.coalesce("parent", "up_conv").alias("parent"), *numbers, "ends", "copy").union(edges)


def prefix_trie(turns: DataFrame, width: int = WIDTH, cells: int = CELLS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of the trie's nodes.

    turns: conv, pos, key, bytes, with a row without key after each conversation's last turn.
    """
    part = F.when(F.col("key").isNotNull(), F.struct("pos", "key", "bytes"))
    rows = turns.groupBy("conv", F.expr(f"pos div {width}").alias("block")).agg(F.sort_array(F.collect_list(part)).alias("part"))
    rows = saved(rows.select("conv", "block", F.transform("part", lambda x: x["key"]).alias("keys"), F.transform("part", lambda x: x["bytes"]).alias("sizes")), "rows")
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("more_leaves", "more_saved")]
    full = F.size("keys") == width
    start = rows.where("block = 0").select("*", F.lit(bytes(KEY)).alias("top"), F.lit(0).cast("bigint").alias("up_bytes"))
    if not (many := rows.where(full | (F.col("block") > 0))).isEmpty():
        # what stands before each later part, as a chain of hashes: width turns become one row here

        def chain(t: pa.Table) -> pa.Table:
            t = t.sort_by("block")
            tops = _paths(t.column("digest").to_pylist(), bytes(KEY))[1:-1]
            return pa.table({"conv": t.column("conv")[1:], "block": t.column("block")[1:], "top": pa.array(tops, pa.binary()), "up_bytes": t.column("last")[:-1]})

        digest = F.unhex(F.sha2(F.array_join(F.transform("keys", lambda x: F.hex(x)), ""), 256))
        tops = many.select("conv", "block", digest.alias("digest"), F.get("sizes", F.size("sizes") - 1).alias("last")).groupBy("conv").applyInArrow(chain, "conv bigint, block bigint, top binary, up_bytes bigint")
        later = saved(rows.where("block > 0").join(tops, ["conv", "block"]), "later")
        totals = _trie(later.select("*", *nothing), width, cells).where(f"not copy and depth % {width} = 0")
        totals = totals.select("conv", F.expr(f"depth div {width}").alias("block"), "leaves", "saved")
        upwards = Window.partitionBy("conv").orderBy(F.col("block").desc())
        more = later.select("conv", "block").join(totals, ["conv", "block"], "left")
        more = more.select("conv", (F.col("block") - 1).alias("block"), *(F.sum(F.coalesce(c, F.lit(0))).over(upwards).alias(f"more_{c}") for c in ("leaves", "saved")))
        both = start.unionByName(later)
        start = both.where(full).join(saved(more, "more"), ["conv", "block"]).unionByName(both.where(~full).select("*", *nothing))
        nodes = saved(_trie(start, width, cells), "both")
        tops, parents = f"not copy and depth > 0 and depth % {width} = 0", nodes.where("copy").select("conv", "depth", F.col("parent").alias("found"))
        out = nodes.where(f"not copy and not ({tops})").unionByName(nodes.where(tops).join(parents, ["conv", "depth"]).withColumn("parent", F.col("found")).drop("found"))
    else:
        out = _trie(start.select("*", *nothing), width, cells)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_openings(keyed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list({k: sha256(strlen(role) || ':' || role || text), b: strlen(text)} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns FROM t GROUP BY c
), h AS (
  SELECT c, turns, CASE WHEN c % 5 = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), CAST(range(8) AS BIGINT[])), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))) % 9 END AS h FROM o
), r AS (
  SELECT a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns FROM h a LEFT JOIN h b ON b.c = a.c - a.c % 5 AND a.h > 0
), p AS (
  SELECT c, d, [x.k for x in turns[1:d]] AS path, CASE WHEN d = 0 THEN 0 ELSE turns[d].b END AS b, len(turns) = d AS ended FROM r, range(0, len(r.turns) + 1) s(d)
), n AS (
  SELECT d, path, min(c) AS c, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends FROM p GROUP BY d, path
), k AS (
  SELECT n.*, up.c AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.path[1:n.d] = n.path) AS kids FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.path = n.path[1:n.d - 1]
), s AS (
  SELECT path[1:e] AS path, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * b) AS saved FROM k, range(0, k.d + 1) q(e) GROUP BY e, path[1:e]
)
SELECT k.c AS conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n AS n_convs, k.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN s USING (path)
"""
