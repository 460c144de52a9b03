"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows scans each text once.

Text and items are put in lower case (A-Z) and cut into words, the runs of 0-9, a-z and non-ASCII bytes. A window is 13
consecutive words of an item, or all words of a shorter one. The automaton holds each window as `" w1 w2 ... "`, so that
it matches whole words only; matches are mapped back to word numbers and to character offsets of the text as it was.

Defined results: a null or wordless text has no words and is clean; a null or wordless item has no window; an item
without item_id can hit but isn't listed; repeated rows of items count once by item_id; repeated documents are judged
row by row; empty tables give empty or clean results; extra columns are carried by `decontaminated` and else not read; item_id and doc_id may be of any type.
The benchmark passes through the driver, a block at a time, and each block's texts go to the tasks with its scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.kernels import LOWER, NOT_ALNUM, as_bytes, word_spans
from tidemark.llm.tables import fresh

WINDOW = 13
#: Bytes of windows in one automaton, which takes some 40 bytes of memory for each; a larger benchmark is scanned for in several blocks.
BLOCK_BYTES = 4 << 20
_NORMAL = bytes(32 if i < 128 and NOT_ALNUM[LOWER[i]] else LOWER[i] for i in range(256))
#: What a scan for spans adds to the columns of the texts.
ADDED = ("_n_words", "_spans")


def normal_words(text: bytes) -> list[bytes]:
    """The words of a text in normal form."""
    return text.translate(_NORMAL).split()


def item_windows(items: list[tuple], window: int) -> dict[bytes, list]:
    """Each window's bytes, with the items that hold it."""
    found: dict[bytes, set] = {}
    for item, text in items:
        words = normal_words((text or "").encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
    return {k: sorted(v, key=lambda x: (x is None, x)) for k, v in found.items()}


def _scan(items: list[tuple], window: int, kind: pa.DataType, names: tuple[str, str, str | None], earlier: bool):  # noqa: ANN202
    """A pass over texts with one automaton: adds the number of words and, by names, the hit words as ranges and the items, or (without a name for items) every occurrence."""
    number, found, who = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, ids in item_windows(items, window).items():
            machine.add_word(w.decode("latin-1"), (len(w), ids))
        machine.make_automaton()
        for b in batches:
            counts, out, listed = [], [], []
            before = [b.column(c).to_pylist() if earlier else [[]] * b.num_rows for c in names[1:] if c]
            for i, text in enumerate(as_bytes(b.column("text"))):
                words = normal_words(text or b"")
                joined = b" %b " % b" ".join(words)
                counts.append(len(words))
                hits = [(end - size + 1, size, ids) for end, (size, ids) in machine.iter(joined.decode("latin-1"))] if words and len(machine) else []
                own = list(before[0][i])
                if hits:
                    place = np.cumsum(np.frombuffer(joined, np.uint8) == 32)
                    spans = [(int(place[at]) - 1, int(place[at + size - 1]) - 1, ids) for at, size, ids in hits]
                    own = _ranges(own, spans, len(words)) if who else own + list(_occurrences(text, spans))
                out.append(own)
                if who:  # a window's items once, however often it comes
                    listed.append(sorted({str(x) for ids in {id(h[2]): h[2] for h in hits}.values() for x in ids if x is not None} | set(before[1][i])))
            keep = [c for c in b.schema.names if c not in names]
            added = [pa.array(counts, pa.int64()), pa.array(out, pa.list_(_RANGE if who else _span(kind))), *([pa.array(listed, pa.list_(pa.string()))] if who else [])]
            yield pa.RecordBatch.from_arrays([*map(b.column, keep), *added], [*keep, *filter(None, names)])

    return run


_RANGE = pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())])


def _span(kind: pa.DataType) -> pa.DataType:
    return pa.struct([("item_id", kind), ("first_word", pa.int32()), ("n_words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


def _ranges(before: list[dict], spans: list[tuple], n: int) -> list[dict]:
    """Hit words of n as maximal ranges."""
    edge = np.zeros(n + 2, np.int64)
    for lo, hi in [*((r["first_word"], r["first_word"] + r["n_words"]) for r in before), *((s[0], s[1]) for s in spans)]:
        edge[lo + 1] += 1
        edge[hi + 1] -= 1
    step = np.diff((np.cumsum(edge) > 0).astype(np.int8))
    return [{"first_word": int(lo), "n_words": int(hi - lo)} for lo, hi in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]


def _occurrences(text: bytes, spans: list[tuple]) -> Iterator[dict]:
    """Every occurrence of a window of each item, with its place in characters of the text as it was."""
    s, e = word_spans(np.frombuffer(text.translate(_NORMAL), np.uint8), _BLANK)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    for first, stop, ids in spans:
        for x in ids:
            yield {"item_id": x, "first_word": first, "n_words": stop - first, "start": int(chars[s[first]]), "stop": int(chars[e[stop - 1]])}


_BLANK = np.zeros(256, bool)
_BLANK[32] = True


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, names: tuple[str, str, str | None]) -> DataFrame:
    """docs with the columns of names, by one scan for each block of the benchmark. No shuffle of texts.

    The benchmark's own size is measured first; if its windows take more than block_bytes, it is cut into blocks of items by hash.
    """
    items = benchmark.select("item_id", "text")
    # each word stands in up to `window` windows
    total = window * int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    n = max(1, -(-total // block_bytes))
    fields = [f for f in docs.schema.fields if f.name not in names]
    kind = items.schema["item_id"].dataType
    pair = [T.StructField(c, T.IntegerType()) for c in ("first_word", "n_words")]
    what = T.StructType(pair) if names[2] else T.StructType([T.StructField("item_id", kind), *pair, *[T.StructField(c, T.IntegerType()) for c in ("start", "stop")]])
    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(what)), *([T.StructField(names[2], T.ArrayType(T.StringType()))] if names[2] else [])]
    out = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        out = out.mapInArrow(_scan([tuple(r) for r in rows], window, to_arrow_type(kind), names, k > 0), T.StructType([*fields, *added]))
    return out


def contamination_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) with _n_words and _spans: one entry for each occurrence of a window of each item. Columns of docs by these names give way."""
    return _scanned(docs, benchmark, window, block_bytes, (*ADDED, None))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    found = _scanned(docs.select("doc_id", "text"), benchmark, window, block_bytes, ("n_words", "hits", "items"))
    names = F.array_join(F.array_sort("items"), ",")
    found = found.select("doc_id", "n_words", _n_hit("hits").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return found.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def _n_hit(hits: str) -> Column:
    return F.aggregate(F.col(f"`{hits}`"), F.lit(0).cast("bigint"), lambda a, x: a + x["n_words"])


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs, whatever their names."""
    names = tuple(fresh(n, docs) for n in ("n_words", "hits", "items"))
    found = _scanned(docs, benchmark, window, block_bytes, names)
    return found.where(~_contaminated(_n_hit(names[1]), F.col(f"`{names[0]}`"))).drop(*names)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k)),
hit AS (SELECT occ.doc_id, occ.i, occ.k, win.item_id FROM occ JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
