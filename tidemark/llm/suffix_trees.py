"""Substring deduplication of word sequences by prefix-partitioned suffix trees.

Suffixes are told apart by a prefix, at first the gram of words at an anchor, and each group of suffixes that share it is
small enough for one task; a group that isn't takes longer prefixes (see `repeats`). In a group the suffixes at anchors are sorted, with the
number of words that neighbours have in common: a suffix tree in array form, whose nodes of some depth are the runs of suffixes
that agree so far. The tree of the suffixes that start one word earlier follows from it by induction: sorted by that word and else as before, neighbours agree
in one word more than they did. `maximal_repeats` lists a tree's internal nodes of `window` words or more; the windows at the leaves of such a node are
repeats and removed.

Defined results: a null or wordless text has 0 words and nothing to remove; texts of fewer words than a window keep all;
copies and repeated rows lose all that windows cover; matches never cross texts; rows may lack a doc_id; an empty table gives an
empty result; other columns are not read. Words are told apart by 64-bit hashes, equal texts and segments by two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.kernels import as_bytes, grams, span_hashes, word_spans
from tidemark.llm.repeats import KEY, Units, covered, ranges, repeated

WINDOW, GRAM = 35, 8


class _Words:
    """A text's words."""

    def __init__(self, text: bytes) -> None:
        self.a = np.frombuffer(text, np.uint8)
        self.starts, self.ends = word_spans(self.a)
        self.text = text

    def part(self, lo: int, hi: int) -> bytes:
        """Words lo to hi; what stands between two words comes along."""
        return self.text[self.starts[lo] : self.ends[hi - 1]] if hi > lo else b""


def _matrix(strings: list[bytes], width: int, backwards: bool) -> np.ndarray:
    """Hashes of the words of each string, from its start, or from its end backwards; 0 beyond."""
    a = np.frombuffer(b" ".join(strings), np.uint8)
    s, e = word_spans(a)
    h = span_hashes(a, s, e)
    ends = np.cumsum([len(x) + 1 for x in strings])
    last = np.searchsorted(s, ends, "left")
    first = np.concatenate([[0], last[:-1]])
    m = np.zeros((len(strings), width), np.uint64)
    for j in range(width):
        at = last - 1 - j if backwards else first + j
        has = (at >= first) & (at < last)
        m[has, j] = h[at[has]]
    return m


def suffix_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order of their words, and the words that each has in common with the leaf before (-1 for the first)."""
    order = np.lexsort(m.T[::-1])
    differ = m[order[1:]] != m[order[:-1]]
    common = np.full(len(m), -1, np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return order, common


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo + 1 : hi + 1] for each pair lo < hi, from minima over powers of two."""
    out, step, level = np.empty(lo.size, values.dtype), 1, values
    size = hi - lo
    while True:
        now = (size >= step) & (size < 2 * step)
        out[now] = np.minimum(level[lo[now] + 1], level[hi[now] + 1 - step])
        if 2 * step > (size.max() if size.size else 0):
            return out
        level = np.minimum(level[:-step], level[step:])
        step *= 2


def longer(order: np.ndarray, common: np.ndarray, word: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the suffixes one word longer at the front, from the tree of the suffixes and each one's new word: sorted by that word and, as before, by what follows."""
    at = np.argsort(word[order], kind="stable")
    new = order[at]
    out = np.full(order.size, -1, common.dtype)
    out[1:] = np.where(word[new[1:]] == word[new[:-1]], 0, -1)
    same = np.flatnonzero(out[1:] == 0)
    out[1:] = np.where(out[1:] == 0, 1, 0)
    out[same + 1] += _least(common, at[same], at[same + 1])
    return new, np.minimum(out, most)


def maximal_repeats(order: np.ndarray, common: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """The tree's internal nodes at least so deep: (depth in words, leaves), deeper nodes before those that hold them.

    Such nodes lie within runs of leaves that agree so far with the one before; only these are walked.
    """
    edge = np.diff(np.concatenate([[0], common >= depth, [0]]).astype(np.int8))
    out = []
    for first, last in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        stack: list[tuple[int, int]] = []
        for i, d in enumerate([*common[first:last].tolist(), -1], first):
            start = i - 1
            while stack and stack[-1][0] > d:
                deep, start = stack.pop()
                out.append((deep, order[start:i]))
            if not stack or stack[-1][0] < d:
                stack.append((d, start))
    return out


def _repeats(window: int):  # noqa: ANN202
    def repeats(left: list[bytes], right: list[bytes], t1: np.ndarray, t2: np.ndarray, copies: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> list[list[tuple[int, int]]]:
        before = _matrix(left, int(t2.max()), backwards=True)
        tree = suffix_tree(_matrix(right, window, backwards=False))
        t1, last = np.maximum(t1, ta), np.minimum(t2, tb)
        marks = []
        for t in range(int(last.max()) + 1):
            if t:
                tree = longer(*tree, before[:, t - 1], window)
            # leaves of deep nodes whose windows start here; a leaf that stands for several copies is a node by itself
            own = (t1 <= t) & (t <= last)
            found = own & (copies > 1)
            for _, leaves in maximal_repeats(*tree, window):
                leaves = leaves[own[leaves]]
                found[leaves] |= leaves.size > 1
            if found.any():
                marks.append((t, np.flatnonzero(found)))
        return ranges(marks, len(left))

    return repeats


def _shared(left: bytes, right: bytes, ta: int, ahead: int) -> int:
    words = left.split()[-ta:] if ta else []
    x = hashlib.blake2b(b" ".join([*words, *right.split()[:ahead]]), digest_size=8, salt=ta.to_bytes(2, "big") + ahead.to_bytes(2, "big")).digest()
    return int.from_bytes(x, "big", signed=True)


def word_units(window: int = WINDOW, gram: int = GRAM) -> Units:
    def cut(t: bytes) -> tuple[_Words, np.ndarray]:
        w = _Words(t)
        return w, grams(span_hashes(w.a, w.starts, w.ends), gram)

    return Units(window, gram, cut, _Words.part, _repeats(window), _shared)


def _apply(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(as_bytes(b.column("text")), b.column("spans").to_pylist()):
                words = (t or b"").split()  # at the white space of bytes, which is that of ASCII
                gone = covered(spans, window, len(words)) if spans else None
                kept = words if gone is None else [x for x, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array([r[2] for r in out], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by blanks) of each row of docs (doc_id, text, ...)."""
    keyed, spans = repeated(docs.select("doc_id", "text"), word_units(window, gram))
    rows = keyed.join(spans, KEY, "left").select("doc_id", "text", "spans")
    rows = rows.mapInArrow(_apply(window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept binary")
    return rows.withColumn("kept", F.col("kept").cast("string"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_words") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeats"), "kept")


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM w)),
hot AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p SEMI JOIN hot USING (h)),
g AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY doc_id),
out AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(g.n, 0) AS n_removed,
    array_to_string(CASE WHEN g.n IS NULL THEN w.w ELSE coalesce((SELECT list(x.v ORDER BY x.k) FROM (SELECT unnest(w.w) AS v, generate_subscripts(w.w, 1) AS k) x WHERE NOT list_contains(g.js, x.k)), []) END, ' ') AS kept
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256, n_words - n_removed AS n_kept, n_removed > 0 AS repeats, kept FROM out
"""
