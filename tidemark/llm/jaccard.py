"""N-gram Jaccard join: documents whose sets of word shingles are similar, and the groups that such links make.

Texts with equal sets form a class; the work is on classes. It goes in two steps:

1. Screen. Every set is ordered by hash. With `l`-prefixes of `misses + l` shingles, two similar sets share `l` or more of
   them, so a class in whose prefix fewer shingles also stand in another class's prefix links with nothing.
2. Join of what is left. Shingles are ordered rare first by their document frequency there; shingles of one class alone
   lead and use up prefix places. Of each pair the smaller class is looked up by a short prefix, the larger one by a longer one. Classes that share a
   prefix shingle are candidates, filtered by length, by position of the first common shingle, and by a suffix filter (counts of the sets'
   shingles in ranges of hashes bound their overlap), then verified once per pair on the whole sets.

Large groups need no list of all pairs. Classes that meet in prefix shingles of more than DIRECT classes make a family (families that share a class are
one). A family's base is the set of shingles that most of its core hold, and each class is kept as its difference to the base. As
`|A ^ B| = |A ^ base| + |B ^ base| - 2 |(A ^ base) & (B ^ base)|`, the same rare-first prefix filter runs on the differences: the class nearest to the base is
linked with all that are near enough by their sizes alone, and any other link must have part of its differences in common, which prefixes of the
differences show. Families within a family are taken apart in the same way, LEVELS deep. No pair that could change a group is left out.
`jaccard_links` lists all linking pairs of classes instead.

Defined results: null and wordless texts have an empty set and link with nothing; a text with fewer words than a shingle
has its whole sequence as its one shingle; repeated rows fall in one class and all get a row; a null doc_id stays null and
is passed over as the group's smallest; extra columns are not read; empty tables give empty results. Sets, classes and shingles
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import connected_components
from tidemark.llm.kernels import LOWER, as_bytes, distinct, grams, mix, signed, span_hashes, word_spans
from tidemark.llm.tables import forget, fresh, release, saved, small

BINS = 32
#: Classes that a prefix shingle brings together directly; beyond, they make a family. Families within families, at most.
DIRECT, LEVELS = 8, 6
#: Shingles that a task looks at together, and how often one of them comes there before it is counted apart.
TOGETHER, OFTEN = 2_000_000, 8


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text, in order."""
    a = np.frombuffer(text.translate(LOWER), np.uint8)
    h = span_hashes(a, *word_spans(a))
    if not h.size:
        return h
    return distinct(grams(h, width)) if h.size >= width else mix(grams(h, h.size) + np.uint64(h.size))


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _lists(parts: list[np.ndarray], kind: np.dtype = np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    return signed(np.array([mix(x * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64) + np.uint64(x.size) for x in sets], np.uint64))


def with_sets(docs: DataFrame, name: str, width: int) -> DataFrame:
    """docs with the hash of each row's set as `name`, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or b"", width) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_names(sets), mask=np.array([not x.size for x in sets], bool))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _sets(docs: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, s (the set's hash) and part: its screening prefix, or with whole all of it, and its counts by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), as_bytes(b.column("text"))
            for lo in range(0, len(texts), 500):
                sets = [shingle_set(t or b"", width) for t in texts[lo : lo + 500]]
                cols = [ids.slice(lo, 500), pa.array([x.size for x in sets], pa.int64()), pa.array(_names(sets))]
                if whole:
                    bins = _lists([np.bincount((x >> np.uint64(59)).astype(np.int64), minlength=BINS) for x in sets], np.int32)
                    yield pa.RecordBatch.from_arrays([*cols, _lists([signed(x) for x in sets]), bins], ["doc_id", "n", "s", "part", "bins"])
                else:
                    part = [signed(x[: (m := x.size - _need(x.size, percent)) + max(1, m // 2)]) for x in sets]
                    yield pa.RecordBatch.from_arrays([*cols, _lists(part)], ["doc_id", "n", "s", "part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, s bigint, part array<bigint>" + ", bins array<int>" * whole)


def _together(batches: Iterator[pa.RecordBatch], key: str, values: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and values of a task's lists, TOGETHER values or a little more at a time."""
    keys, parts, n = [], [], 0
    for b in batches:
        x = b.column(values)
        keys.append(np.repeat(b.column(key).to_numpy(), np.asarray(x.value_lengths())))
        parts.append(np.asarray(x.flatten()))
        n += parts[-1].size
        if n >= TOGETHER:
            yield np.concatenate(keys), np.concatenate(parts)
            keys, parts, n = [], [], 0
    if n:
        yield np.concatenate(keys), np.concatenate(parts)


def _rows(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, columns[0].size, 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 200_000]) for c in columns], names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s, part -> (q, h, s, known): prefix shingles to be brought together by q; of those that meet within the task already, two rows to tell others and the known meetings."""
    for s, h in _together(batches, "s", "part"):
        order = np.lexsort((s, h))
        s, h = s[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
        s, h = s[new], h[new]
        change = h[1:] != h[:-1]
        first, last = np.concatenate([[True], change]), np.concatenate([change, [True]])
        tell, known = first | last, ~(first & last)
        yield from _rows([np.concatenate([h[tell], s[known]]), np.concatenate([h[tell], h[known]]), np.concatenate([s[tell], s[known]]), np.repeat([False, True], [tell.sum(), known.sum()])], ["q", "h", "s", "known"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s, part -> (h, df) of the shingles that come OFTEN or more within a task, so that no shingle need gather all its classes."""
    for _, h in _together(batches, "s", "part"):
        h, n = np.unique(h, return_counts=True)
        yield from _rows([h[n >= OFTEN], n[n >= OFTEN].astype(np.int64)], ["h", "df"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, x -> (g, e, c): how often each shingle comes in a family within a task."""
    for g, e in _together(batches, "g", "x"):
        order = np.lexsort((e, g))
        g, e = g[order], e[order]
        at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (e[1:] != e[:-1])]))
        yield from _rows([g[at], e[at], np.diff(np.append(at, g.size))], ["g", "e", "c"])


def _ceil(x: Column, by: int) -> Column:
    return F.floor((x + (by - 1)) / by).cast("bigint")


class _Join:
    """The tables of one join.

    A level's rows are classes as differences to the base of their family g: s, n, d (the difference's size), x (those of its shingles that come
    twice or more in the family, rare first) and w. Two classes link if twice the shingles that their differences share, times 100 + percent, reach the sum of their w.
    inner classes are linked with the one nearest to the base, whose w is low. At first the base is empty.
    """

    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        self.percent, self.spark, self.kept = percent, docs.sparkSession, []
        wide = saved(_sets(docs, width, percent, whole=False), "prefixes")
        self.docs = saved(wide.select("doc_id", "n", "s"), "sets")
        classes = self.docs.where("n > 0").groupBy("s", "n").agg(F.min("doc_id").alias("doc_id"))
        posts = wide.select("s", "part").mapInArrow(_meet, "q bigint, h bigint, s bigint, known boolean").repartition("q")
        shared = posts.groupBy("q").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("known").alias("known")).where("lo != hi or known").select("q")
        counts = posts.join(shared, "q", "left_semi").groupBy("s").agg(F.count_distinct("h").alias("k"))
        smaller = _ceil(F.col("n") * percent, 100)  # of the sets that a set of n can link with
        least = F.greatest(F.lit(1), F.floor((smaller - _ceil(smaller * percent, 100)) / 2))
        left = saved(classes.join(counts, "s").where(F.col("k") >= least).select("doc_id", "s"), "screened")
        forget(wide)
        release(self.spark)
        ids = small(left.select(F.col("doc_id").alias("rep")).distinct(), 16)
        rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi")
        sets = saved(_sets(rows, width, percent, whole=True).drop("doc_id").join(small(left.select("s"), 16), "s", "left_semi").dropDuplicates(["s"]), "whole")
        forget(left)
        release(self.spark)
        self.light = self._save(sets.select("s", "bins"), "light")
        often = saved(sets.select("s", "part").mapInArrow(_often, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df")), "often")
        each, apart = sets.select("s", F.explode("part").alias("h")), small(often, 16)
        rest = each.join(apart, "h", "left_anti").repartition("h")
        found = rest.join(rest.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h").select("s", "h", "df").union(each.join(apart, "h").select("s", "h", "df"))
        ranked = found.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x")).join(sets.select("s", "n"), "s").select("s", "n", F.col("x.h").alias("x"))
        self.ranked = self._save(ranked.where(F.size("x") * 100 >= F.col("n") * percent), "ranked")
        forget(sets, often)
        release(self.spark)

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        """As saved, until close."""
        self.kept.append(saved(df, name))
        return self.kept[-1]

    def close(self) -> None:
        forget(*self.kept)
        self.kept.clear()
        release(self.spark)

    def _w(self) -> Column:
        return (100 + self.percent) * F.col("d") - (100 - self.percent) * F.col("n")

    def _need(self) -> Column:
        """Shingles that the differences of a pair must share to link."""
        return F.greatest(F.lit(1), _ceil(F.col("wa") + F.col("wb"), 2 * (100 + self.percent)))

    def first(self) -> DataFrame:
        level = self.ranked.select(F.lit(0).cast("bigint").alias("g"), "s", "n", F.col("n").alias("d"), "x").withColumn("w", self._w())
        return level.withColumns({"low": 2 * self.percent * _ceil(F.col("n") * self.percent, 100), "inner": F.lit(False)})

    def posts(self, level: DataFrame) -> DataFrame:
        """(g, h, s, n, d, w, at) of prefix shingles; i: by which the class is found as the one of smaller w, o: by which it looks for such."""
        alone = F.col("d") - F.size("x")
        ahead = lambda w: F.greatest(F.lit(0), F.col("d") - F.greatest(F.lit(1), _ceil(F.col("w") + w, 2 * (100 + self.percent))) + 1 - alone).cast("int")
        rows = level.withColumns({"_i": ahead(F.greatest(F.col("w"), 1 - F.col("low"))), "_o": F.when(F.col("inner"), 0).otherwise(ahead(F.col("low"))), "_alone": alone})
        rows = rows.select("g", "s", "n", "d", "w", "_i", "_o", "_alone", F.posexplode(F.slice("x", F.lit(1), F.greatest("_i", "_o"))).alias("_at", "h"))
        return rows.select("g", "h", "s", "n", "d", "w", (F.col("_at") + F.col("_alone")).alias("at"), (F.col("_at") < F.col("_i")).alias("i"), (F.col("_at") < F.col("_o")).alias("o"))

    def near(self, posts: DataFrame, level: DataFrame, whole: bool) -> DataFrame:
        """Links (a, b, both): pairs of posts that meet, but for pairs of one f, filtered and verified; whole: the base is empty."""
        a, b = (posts.where(c).select("g", "h", *[F.col(k).alias(k + t) for k in ("s", "n", "d", "w", "at", "f")]) for c, t in (("i", "a"), ("o", "b")))
        pairs = a.join(b, ["g", "h"]).where("(wa < wb or wa = wb and sa < sb) and (fa is null or fb is null or fa != fb)")
        pairs = pairs.where(self.percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
        pairs = pairs.groupBy("g", "sa", "sb", "na", "nb", "da", "db", "wa", "wb").agg(F.min("ata").alias("ata"), F.min("atb").alias("atb"))
        pairs = pairs.where(F.least(F.col("da") - F.col("ata"), F.col("db") - F.col("atb")) >= self._need()).select("g", "sa", "sb", "na", "nb", "wa", "wb")
        if whole:
            apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, d: t + d)
            light = small(self.light, 160)
            pairs = pairs.join(light.select(F.col("s").alias("sa"), F.col("bins").alias("x")), "sa").join(light.select(F.col("s").alias("sb"), F.col("bins").alias("y")), "sb")
            pairs = pairs.where(apart <= F.col("na") + F.col("nb") - 2 * self._need()).select("g", "sa", "sb", "na", "nb", "wa", "wb")
        x = level.select("g", "s", "x")
        pairs = pairs.join(x.withColumnsRenamed({"s": "sa"}), ["g", "sa"]).join(x.withColumnsRenamed({"s": "sb", "x": "y"}), ["g", "sb"])
        return pairs.withColumn("both", F.size(F.array_intersect("x", "y"))).where(F.col("both") >= self._need()).select(F.col("sa").alias("a"), F.col("sb").alias("b"), "na", "nb", "both")

    def links(self) -> DataFrame:
        """All pairs of classes that link."""
        level = self.first()
        return saved(self.near(self.posts(level).withColumn("f", F.lit(None).cast("bigint")), level, True), "links")

    def families(self, posts: DataFrame, hot: DataFrame) -> DataFrame:
        """(s, f, core) of the classes of hot shingles; core: those that hold the family's most frequent one."""
        key = F.xxhash64("g", "h")
        mine = posts.join(hot, ["g", "h"]).select("s", F.struct(F.col("m"), key.alias("k")).alias("k"))
        mine = self._save(mine.groupBy("s").agg(F.max("k").alias("top"), F.collect_set("k.k").alias("ks")), "hot-classes")
        edges = mine.select(F.col("top.k").alias("u"), F.explode("ks").alias("v")).where("u != v").distinct()
        groups = self._save(connected_components(edges), "hot-groups")
        rows = mine.join(small(groups, 16), F.col("top.k") == F.col("id"), "left").select("s", "top", F.coalesce("component", "top.k").alias("f"))
        tops = self._save(rows.groupBy("f").agg(F.max("top").alias("first")), "hot-tops")
        return self._save(rows.join(small(tops, 32), "f").select("s", "f", (F.col("top") == F.col("first")).alias("core")), "families")

    def apart(self, families: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The next level, of the classes in families; and the links (a, b) of each one's inner classes with the class nearest to its base."""
        rows = self._save(self.ranked.join(small(families, 24), "s").select("s", "n", "x", F.col("f").alias("g"), "core"), "family")
        size = small(self._save(rows.where("core").groupBy("g").agg(F.count("*").alias("m")), "family-sizes"), 16)
        base = rows.where("core").select("g", "x").mapInArrow(_counts, "g bigint, e bigint, c bigint").groupBy("g", "e").agg(F.sum("c").alias("c"))
        base = self._save(base.join(size, "g").where("2 * c > m").groupBy("g").agg(F.collect_list("e").alias("base")), "bases")
        base = small(base, 32 + 8 * F.size("base"))
        both = rows.join(base, "g", "left").withColumn("base", F.coalesce("base", F.array().cast("array<bigint>")))
        both = both.select("g", "s", "n", (F.col("n") - F.size("x")).alias("alone"), F.concat(F.array_except("x", "base"), F.array_except("base", "x")).alias("y"))
        both = self._save(both.withColumn("d", F.col("alone") + F.size("y")).withColumn("w", self._w()), "differences")
        each = both.select("g", "s", F.explode("y").alias("e"))
        often = each.groupBy("g", "e").agg(F.count("*").alias("df")).where("df > 1")
        ranked = each.join(often, ["g", "e"]).groupBy("g", "s").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("x")).select("g", "s", F.col("x.e").alias("x"))
        nearest = small(self._save(both.groupBy("g").agg(F.min(F.struct("w", "s")).alias("least")), "nearest"), 32)
        level = both.select("g", "s", "n", "d", "w").join(nearest, "g").join(ranked, ["g", "s"], "left")
        level = level.select("g", "s", "n", "d", F.coalesce("x", F.array().cast("array<bigint>")).alias("x"), "w", F.col("least.w").alias("low"), (F.col("w") + F.col("least.w") <= 0).alias("inner"), F.col("least.s").alias("nearest"))
        level = self._save(level, "level")
        return level, level.where("inner and s != nearest").select(F.col("s").alias("a"), F.col("nearest").alias("b"))

    def labels(self) -> DataFrame:
        """(s, label) of the classes that link with others; label: the smallest s of the group."""
        level, links = self.first(), None
        for k in range(LEVELS):
            posts = self._save(self.posts(level), "posts")
            hot = posts.groupBy("g", "h").agg(F.count_if("i").alias("i"), F.count_if("o").alias("o")).where(F.least("i", "o") > DIRECT)
            hot = self._save(hot.select("g", "h", (F.col("i") + F.col("o")).alias("m")), "hot")
            last = k == LEVELS - 1 or hot.isEmpty()
            if last:
                posts = posts.withColumn("f", F.lit(None).cast("bigint"))
            else:
                few = small(hot, 24)
                families = self.families(posts, few)
                posts = posts.join(few, ["g", "h"], "left_anti").join(small(families.select("s", "f"), 16), "s", "left")
            found = self._save(self.near(posts, level, not k).select("a", "b"), "links")
            links = found if links is None else links.union(found)
            if last:
                break
            level, more = self.apart(families)
            links = links.union(more)
            release(self.spark)
        return self._save(connected_components(links.withColumnsRenamed({"a": "u", "b": "v"})).select(F.col("id").alias("s"), F.col("component").alias("label")), "labels")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, s, n_shingles, label (of its group; null without shingles) of each row of docs, saved."""
    join = _Join(docs, width, percent)
    rows = join.docs.join(small(join.labels(), 16), "s", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "s")))
    rows = saved(rows.select("doc_id", "s", F.col("n").alias("n_shingles"), "label"), "rows")
    join.close()
    forget(join.docs)
    return rows


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text, ...); percent: the least Jaccard similarity.

    component_id is the smallest doc_id of the documents reachable by links, the row's own included.
    """
    rows = _labelled(docs, width, percent)
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    # where the groups are few, a large one need not meet in one task
    return rows.join(small(saved(least, "least"), 32), "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links between different sets: (a, b, intersection, similarity) of set hashes, and membership (doc_id, s)."""
    join = _Join(docs, width, percent)
    links = join.links()
    join.close()
    return links.select("a", "b", F.col("both").alias("intersection"), (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity")), join.docs.select("doc_id", "s")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the one of smallest doc_id (of several with that id, the one of the smallest set hash, and of equal rows one); rows without doc_id stay.

    A row is known by doc_id and its set of shingles, so that different texts under one doc_id go each by its own group; rows without shingles link with nothing, and
    stay as they are. What goes is measured: few are broadcast, many are joined by a shuffle.
    """
    rows = _labelled(docs, width, percent).where("doc_id is not null and label is not null")
    least = rows.groupBy("label").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count("*").alias("c")).where("c > 1")
    members = rows.join(small(saved(least, "least"), 40), "label")
    ids = saved(rows.groupBy("doc_id").agg(F.countDistinct("s").alias("sets"), F.count("*").alias("c")).where("c > 1").select("doc_id", "sets"), "ids")
    gone = saved(members.where("doc_id != first.doc_id or s != first.s").select("doc_id", "s").distinct(), "gone")
    if ids.isEmpty():  # a doc_id names one row
        gone = small(saved(gone.select(F.col("doc_id").alias("gone")), "gone"), 16)
        return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    # rows that share a doc_id: their sets are made again, in rows of those ids only
    mark = fresh("_set", docs)
    twice = small(saved(ids.select(F.col("doc_id").alias("twice")), "twice"), 16)
    single = gone.join(twice, gone["doc_id"] == twice["twice"], "left_anti").select(F.col("doc_id").alias("gone"))
    single = small(saved(single, "gone"), 16)
    once = docs.join(twice, docs["doc_id"] == twice["twice"], "left_anti").join(single, docs["doc_id"] == single["gone"], "left_anti")
    several = with_sets(docs.join(twice, docs["doc_id"] == twice["twice"], "left_semi"), mark, width)
    pair = gone.select(F.col("doc_id").alias("gone"), F.col("s").alias("gone_set"))
    several = several.join(pair, (several["doc_id"] == pair["gone"]) & (several[mark] == pair["gone_set"]), "left_anti")
    bare = several.where(F.col(mark).isNull()).drop(mark)
    return once.unionByName(several.where(F.col(mark).isNotNull()).dropDuplicates(["doc_id", mark]).drop(mark)).unionByName(bare)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w
), sized AS (SELECT doc_id, len(s) AS n, s FROM s),
class AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM sized WHERE n > 0 GROUP BY 1),
member AS (SELECT doc_id, n, CASE WHEN n > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS k FROM sized),
p AS (SELECT rep, n, unnest(s) AS g FROM class),
link AS (
  SELECT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS v, rep AS r FROM class UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.r = e.a),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(comp.c, m.doc_id) AS component_id
FROM member m LEFT JOIN class ON m.k = class.k LEFT JOIN comp ON comp.v = class.rep
"""
