"""Mixing sources to target weights through blocks that a multivariate-hypergeometric splitting tree deals to output shards.

A source's documents fall into blocks by a hash of doc_id. From the target of its source a block is drawn so many whole times,
and in one more pass the blocks are drawn in permuted order while they fit whole; from there on each document is taken that fits
the room left, in the order of its block and then of the following blocks, until what is left is below every document not
taken. Where that is still a word or more, documents that fit are drawn once again, in the same order, if they have not been drawn `most` times (a few
for a source; a hash of each says its shard). All other draws of all sources are then dealt to the output shards by a tree: a node splits its exact numbers of
draws by source between its two halves by a multivariate hypergeometric draw, down to one shard, so that each shard has
its exact quota of every source. A shard draws the next blocks of each source's order, disjoint from those of other shards,
and shuffles its documents locally.

Blocks hold BLOCK documents at most on average and shards SHARD words, so that both grow in number with the input and not in size; beyond MOST_SHARDS shards, shards grow.
What the driver holds is one row per source (at most MOST_SOURCES; more are refused) and its quotas by shard (at most MOST_QUOTAS numbers); blocks and documents stay in Spark.

Defined results: a null text has size 0; a null source is a source, the last; a source of size 0 has target 0; a null
doc_id hashes as such; rows with the same doc_id in one source are drawn together; an empty table gives an empty result;
other columns, whatever their names, are carried by `mixed` and not read by `mix_plan`. All draws come from hashes and seeds, so reruns agree.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import saved, small

WEIGHTS = (1, 2, 3)
MOST = 3
#: A source has a block for each LEAST_BLOCK documents up to BLOCKS blocks, and more as soon as blocks would hold over BLOCK documents.
LEAST_BLOCK, BLOCKS, BLOCK = 32, 256, 20_000
#: Words of a shard and the least number of shards; numbers above which shards grow instead.
SHARD, SHARDS, MOST_SHARDS, MOST_QUOTAS = 500_000, 8, 100_000, 20_000_000
MOST_SOURCES = 100_000
#: Documents of a source that one task looks through for some that fit the room left; at least a block.
FILL = 200_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Fraction]:
    """Shares of the total by weight (repeating along the list), none above most times its size; excess goes to the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = {i for i in open_ if unit * w[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else unit * w[i]
        left -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def shard_count(words: int, sources: int) -> int:
    """Output shards of a mix of so many words."""
    return int(min(max(SHARDS, -(-words // SHARD)), MOST_SHARDS, max(1, MOST_QUOTAS // max(1, sources))))


def deal(draws: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws by source, dealt to shards of equal size: an array (shards, sources) whose columns sum to draws."""
    out = np.zeros((shards, len(draws)), np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        n = int(counts.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, n, method="marginals")
        split(left, lo, mid)
        split(counts - left, mid, hi)

    if draws:
        split(np.array(draws, np.int64), 0, shards)
    return out


def _key() -> Column:
    return F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))


def _hash(seed: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    """Of a source's documents in order, each that fits the room left: all of a block up to one (kind 1), single ones (2); then the room left (0)."""
    docs = docs.sort_values(["place", "_block", "o"])
    key, room, whole = docs["_key"].iloc[0], float(docs["room"].iloc[0]), bool(docs["whole_blocks"].iloc[0])
    out, last, block, run = [], None, None, False
    for b, o, size in zip(docs["_block"].tolist(), docs["o"].tolist(), docs["size"].tolist()):
        if room < 1:
            break
        if b < 0:
            continue
        if b != block:
            block, last, run = b, None, whole
        if size > room:
            run = False
            continue
        room -= size
        if run and last is not None:
            out[last] = (key, b, 1, o, 0.0, 0)
        else:
            last = len(out)
            out.append((key, b, 1 if run else 2, o, 0.0, 0))
    out.append((key, -1, 0, 0, room, int(docs["place"].max())))
    return pd.DataFrame(out, columns=["_key", "_block", "kind", "o", "room", "place"])


class Mix:
    """The plan of one mix: sizes of all rows (saved), a row per source, and the draws of each block."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, blocks: int | None = None, shards: int | None = None, seed: int = 1) -> None:
        spark, self.seed = docs.sparkSession, seed
        size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
        self.rows = saved(docs.select("doc_id", _key().alias("_key"), size.alias("size"), F.monotonically_increasing_id().alias("_row")), "sizes")
        sources = sorted(self.rows.groupBy("_key").agg(F.sum("size"), F.count("*")).limit(MOST_SOURCES + 1).collect(), key=lambda r: (r[0] == "-", r[0].encode()))
        if len(sources) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        sizes = [r[1] for r in sources]
        self.targets = targets(sizes, weights, most)
        self.shards = shards or shard_count(sum(sizes), len(sizes))
        whole = [int(t // s) if s else 0 for t, s in zip(self.targets, sizes)]
        rest = [float(t - n * s) for t, n, s in zip(self.targets, whole, sizes)]
        plan = spark.createDataFrame(
            [(r[0], r[1], float(t), n, x, min(blocks or max(BLOCKS, r[2] // BLOCK), max(1, r[2] // LEAST_BLOCK))) for r, t, n, x in zip(sources, self.targets, whole, rest)],
            "_key string, source_size bigint, target double, whole int, rest double, _blocks int",
        )
        self.plan = F.broadcast(plan) if len(sources) <= 20_000 else plan
        words = self.rows.join(self.plan.select("_key", "_blocks"), "_key").groupBy("_key", self._block().alias("_block")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
        order = _hash(seed, F.lit("more"), "_key", "_block")
        # a window's group has a row for each block of a source
        more = words.join(self.plan, "_key").withColumn("o", order).withColumn("_n", F.expr("count(*) over (partition by _key)"))
        run = "over (partition by _key order by o, _block"
        more = more.withColumn("place", F.expr(f"row_number() {run})")).withColumn("before", F.expr(f"sum(words) {run} rows unbounded preceding)") - F.col("words"))
        more = more.withColumn("more", (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0))
        more = saved(more.select("_key", "_block", "whole", "more", "words", "docs", "least", "rest", "place", "_n"), "draws")
        part = self._parts(more)
        self.again = self._again(more, most)
        some = part.where("kind > 0").groupBy("_key", "_block").agg(F.max(F.when(F.col("kind") == 1, F.col("o"))).alias("last"))
        draws = more.join(some.withColumn("part", F.lit(True)), ["_key", "_block"], "left").withColumn("_once", F.col("more") | F.coalesce("part", F.lit(False)))
        draws = draws.withColumn("_turn", F.expr("row_number() over (partition by _key, _once order by place)"))
        draws = saved(draws.select("_key", "_block", "whole", "more", "place", "_turn", "_n", "last", "_once"), "draws")
        self.also = part.where("kind = 2").select("_key", "_block", F.col("o").alias("_o"), F.lit(True).alias("_also"))
        count = {r[0]: r[1] for r in draws.groupBy("_key").agg(F.sum(F.col("whole") + F.col("_once").cast("int"))).collect()}
        quota = deal([int(count[r[0]]) for r in sources], self.shards, seed)
        ends = np.cumsum(quota, axis=0).T.tolist()
        ends = spark.createDataFrame([(r[0], e) for r, e in zip(sources, ends)], "_key string, _ends array<bigint>")
        self.turns = saved(self._turns(draws, ends), "turns")

    @staticmethod
    def _turns(draws: DataFrame, ends: DataFrame) -> DataFrame:
        """_key, _block, _draw, whole, more, last, _shard: a row for each draw of a block, in the shard whose quota holds the draw's place in the source's order.

        A block has one draw in each whole pass, at places of that pass's own order, and one in the last. Draws and the ends of quotas are put in one order, and a draw's shard is the number of ends before it.
        """
        each = draws.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("whole") + 1))).where("_draw <= whole or _once")
        place = F.when(F.col("_draw") <= F.col("whole"), (F.col("_draw") - 1) * F.col("_n") + F.pmod(F.col("place") + F.col("_draw") * 7919, F.col("_n"))).otherwise(F.col("whole") * F.col("_n") + F.col("_turn") - 1)
        each = each.select("_key", "_block", "_draw", "whole", "more", "last", place.alias("_at"), F.lit(1).alias("_kind"))
        marks = ends.select("_key", F.explode("_ends").alias("_at"), F.lit(0).alias("_kind"))
        both = each.unionByName(marks, allowMissingColumns=True)
        return both.withColumn("_shard", F.expr("count_if(_kind = 0) over (partition by _key order by _at, _kind rows unbounded preceding)").cast("int")).where("_kind = 1").drop("_at", "_kind")

    def _block(self) -> Column:
        return F.pmod(_hash(self.seed, F.lit("block"), "doc_id"), F.col("_blocks")).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their block, by the number of blocks of their source."""
        return rows.join(self.plan.select("_key", "_blocks"), "_key").withColumn("_block", self._block()).drop("_blocks")

    def _parts(self, more: DataFrame) -> DataFrame:
        """Documents of the last pass beyond the blocks that fit whole, as `_fill` gives them.

        Each step looks at the next blocks of each source that hold a document below its room: first at one, whole, and then at
        FILL documents or less, of which only those below the room are moved. It ends when no block left holds one.
        """
        taken = F.when(F.col("more"), F.col("words")).otherwise(0)
        state = more.groupBy("_key").agg((F.first("rest") - F.sum(taken)).alias("room"), F.max(F.when(F.col("more"), F.col("place")).otherwise(0)).alias("at")).where("room >= 1").collect()
        parts, self.rooms = self._filled(more, [tuple(r) for r in state], 0)
        return parts

    def _filled(self, more: DataFrame, state: list[tuple[str, float, int]], first: int) -> tuple[DataFrame, dict[str, float]]:
        """Documents that fit the rooms (key, room, place after which blocks are looked at), and the rooms left in the end; first: documents of the first step, 0 for a block that is looked at whole."""
        spark, parts, rooms = more.sparkSession, [], {r[0]: r[1] for r in state}
        while state or not parts:
            at = spark.createDataFrame(state, "_key string, room double, at int")
            ahead = more.join(F.broadcast(at) if len(state) <= 20_000 else at, "_key").where("place > at and least <= room")
            ahead = ahead.withColumn("n", F.expr("sum(docs) over (partition by _key order by place rows unbounded preceding)"))
            ahead = ahead.where((F.col("n") == F.col("docs")) | (F.col("n") <= (FILL if parts else first))).select("_key", "_block", "place", "room")
            docs = self._placed(self.rows).join(F.broadcast(ahead) if len(state) <= 5_000 else ahead, ["_key", "_block"])
            docs = docs.groupBy("_key", "_block", "place", "room", _hash(self.seed, F.lit("part"), "doc_id").alias("o")).agg(F.sum("size").alias("size"))
            if parts or first:
                docs = docs.where("size <= room")
            if first:
                docs = docs.where("size > 0")
            ends = ahead.groupBy("_key", "room").agg(F.max("place").alias("place")).withColumns({"_block": F.lit(-1), "o": F.lit(0).cast("bigint"), "size": F.lit(0).cast("bigint")})
            docs = docs.unionByName(ends).withColumn("whole_blocks", F.lit(not parts and not first))
            parts.append(saved(docs.groupBy("_key").applyInPandas(_fill, "_key string, _block int, kind int, o bigint, room double, place int"), "parts"))
            state = [tuple(r) for r in parts[-1].where("kind = 0").select("_key", "room", "place").collect()]
            rooms |= {r[0]: r[1] for r in state}
            state = [r for r in state if r[1] >= 1]
        return reduce(DataFrame.unionByName, parts), rooms

    def _again(self, draws: DataFrame, most: int) -> DataFrame | None:
        """_key, _block, _o, _draw, _shard of documents drawn once more to fill the rooms that the last pass leaves; None where there are none.

        What fits such a room has been drawn in every pass, so that a source of `most - 1` whole passes has nothing to draw again.
        """
        whole = {r[0]: r[1] for r in self.plan.select("_key", "whole").collect()}
        state = [(k, room, 0) for k, room in self.rooms.items() if room >= 1 and whole[k] + 2 <= most]
        if not state:
            return None
        found, _ = self._filled(draws, state, FILL)
        found = found.where("kind = 2").select("_key", "_block", F.col("o").alias("_o"))
        shard = F.pmod(_hash(self.seed, F.lit("again"), "_key", "_block", "_o"), F.lit(self.shards)).cast("int")
        return saved(found.join(self.plan.select("_key", "whole"), "_key").select("_key", "_block", "_o", (F.col("whole") + 2).alias("_draw"), shard.alias("_shard")), "again")

    def drawn(self, rows: DataFrame) -> DataFrame:
        """Rows (with _key, doc_id) once for each draw, with _draw and _shard."""
        rows = self._placed(rows).withColumn("_o", _hash(self.seed, F.lit("part"), "doc_id"))
        again = None if self.again is None else rows.join(small(self.again, 64), ["_key", "_block", "_o"])
        rows = rows.join(small(self.also, 64), ["_key", "_block", "_o"], "left").join(small(self.turns, 64), ["_key", "_block"])
        once = F.col("more") | F.coalesce(F.col("_o") <= F.col("last"), F.lit(False)) | F.col("_also").isNotNull()
        out = rows.where((F.col("_draw") <= F.col("whole")) | once)
        return out if again is None else out.unionByName(again, allowMissingColumns=True)


def dealt(m: Mix, rows: DataFrame) -> DataFrame:
    """Rows (with _key, doc_id) once for each draw, with _draw and _shard, gathered by shard and shuffled within each."""
    return m.drawn(rows).withColumn("_order", _hash(m.seed, F.lit("order"), "_shard", "_draw", "doc_id")).repartition("_shard").sortWithinPartitions("_shard", "_order")


def mix_plan(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """doc_id, size, source_size, target, taken, times of each row of docs (doc_id, text, source, ...), counted from the dealt draws."""
    m = Mix(docs, **options)
    draws = saved(dealt(m, m.rows).select("_row", "_shard", "_draw"), "dealt")
    rows = m.rows.join(draws.groupBy("_row").agg(F.count("*").cast("int").alias("n")), "_row", "left").join(m.plan.select("_key", "source_size", "target"), "_key")
    rows = rows.withColumn("times", F.coalesce("n", F.lit(0)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken"), "times")


def mixed(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mix itself: rows of docs, repeated as drawn, gathered by shard and shuffled within each."""
    m = Mix(docs, **options)
    # a row goes along as one value, so that no name of its columns can meet those of the plan
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", _key().alias("_key"))
    return dealt(m, rows).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
