"""License scans: winnowed fingerprints find candidate templates, banded alignment reports what is matched and where.

Templates and texts are put in lower case (A-Z) and cut into words of 0-9, a-z and non-ASCII bytes. A template's fingerprints, the
smallest of each few consecutive hashes of a few words, make an inverted index in which all hashes of a text are looked up. How few follows from
the coverage: a text that changes, leaves out or puts in as many words as the coverage lets go still has a run of words in common with the
template, and words and hashes are at most GRAM and GUARD, and so few that each such run holds a fingerprint. Hits on diagonals within BAND make one
candidate region, which is aligned locally with the template within a band around them, and again before and after what was found,
until too few of the template's words are left. A match is reported if it covers enough of the template.

Defined results: a null or wordless text matches nothing; each occurrence is reported; repeated rows are reported each; of templates that match
overlapping words, the one with more matched words (then the first by id) is kept; an empty table gives an empty result; other columns are not
read. The index holds the templates only, whatever the input.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.kernels import LOWER, NOT_ALNUM, as_bytes, grams, span_hashes, window_minima, word_spans

GRAM, GUARD, BAND, COVERAGE = 3, 3, 8, 0.8

#: Notices and texts of common licenses, as published.
TEMPLATES = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-notice": "Released under the MIT License.",
}


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of a text's words."""
    a = np.frombuffer(text.translate(LOWER), np.uint8)
    s, e = word_spans(a, NOT_ALNUM)
    return span_hashes(a, s, e), s, e


def fingerprints(h: np.ndarray, gram: int, guard: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of gram words and their places: any run of gram + guard - 1 words holds one."""
    g = grams(h, gram)
    at = np.unique(window_minima(g, guard))
    return g[at], at


def align(x: list[int], y: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of template x with words y (x[i] near y[i + shift]): words matched, first and last place in y (exclusive).

    A match scores 2, a word changed, left out or put in -1; cells further than band from the diagonal are not looked at.
    """
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(x):
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, -1)
        for j in range(max(0, i + shift - band), min(len(y), i + shift + band + 1)):
            score, n, first = above.get(j - 1, (0, 0, j))
            score, n, first = (score + 2, n + 1, first) if w == y[j] else (score - 1, n, first)
            for s, k, f in (above.get(j, (0, 0, j)), left):
                if s - 1 > score:
                    score, n, first = s - 1, k, f
            left = row[j] = (score, n, first) if score > 0 else (0, 0, j + 1)
            if score > best[0]:
                best = (score, n, first, j + 1)
        above = row
    return best[1:]


class Index:
    """The inverted index of some templates."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.names = sorted(templates)
        self.words = [words(templates[n].encode())[0] for n in self.names]
        #: Words that a match has at least.
        self.need = [max(1, math.ceil(coverage * h.size - 1e-9)) for h in self.words]
        posts: dict[int, list[tuple[int, int, int]]] = {}
        for k, (h, need) in enumerate(zip(self.words, self.need)):
            if h.size:
                # need words in one run more than there are words to lose
                run = -(-need // (h.size - need + 1))
                gram = min(GRAM, run)
                posts.setdefault(gram, []).extend((int(f), k, int(at)) for f, at in zip(*fingerprints(h, gram, min(GUARD, run - gram + 1))))
        self.posts = {gram: (np.array([p[0] for p in sorted(ps)], np.uint64), np.array([p[1:] for p in sorted(ps)], np.int64)) for gram, ps in posts.items()}

    def occurrences(self, k: int, h: np.ndarray, shifts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """Words matched, template, first and last place (exclusive) and template's words of the matches around some shifts; some come twice."""
        x, need = self.words[k].tolist(), self.need[k]
        own, band = set(x), max(BAND, len(x) - need)
        distinct = len(own) - (len(x) - need)
        shifts, i = sorted(set(shifts)), 0
        while i < len(shifts):
            j = bisect.bisect_right(shifts, shifts[i] + BAND)
            low, high = shifts[i], shifts[j - 1]
            parts = [(max(0, low - band), min(h.size, high + len(x) + band))]
            while parts:
                lo, hi = parts.pop()
                y = h[lo:hi].tolist()
                if len(y) < need or len(own.intersection(y)) < distinct:
                    continue
                n, first, last = align(x, y, (low + high) // 2 - lo, band + (high - low + 1) // 2)
                if n >= need:
                    yield n, k, lo + first, lo + last, len(x)
                if n:
                    parts += [(lo, lo + first), (lo + last, hi)]
            i = j

    def matches(self, text: bytes) -> list[dict]:
        h, s, e = words(text)
        hits: dict[int, list[int]] = {}
        for gram, (prints, posts) in self.posts.items():
            f = grams(h, gram)
            lo = np.searchsorted(prints, f, "left")
            at = np.flatnonzero(prints[np.minimum(lo, prints.size - 1)] == f)
            hi = np.searchsorted(prints, f[at], "right")
            for i, a, b in zip(at.tolist(), lo[at].tolist(), hi.tolist()):
                for k, place in posts[a:b].tolist():
                    hits.setdefault(k, []).append(i - place)
        found = {r for k, shifts in hits.items() for r in self.occurrences(k, h, shifts)}
        if not found:
            return []
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        kept: list[tuple] = []
        taken = np.zeros(h.size, bool)
        for r in sorted(found, key=lambda r: (-r[0], r[1], r[2], r[3])):
            if not taken[r[2] : r[3]].any():
                kept.append(r)
                taken[r[2] : r[3]] = True
        return [{"license": self.names[k], "matched": n, "coverage": n / size, "start": int(chars[s[i]]), "stop": int(chars[e[j - 1]])} for n, k, i, j, size in sorted(kept, key=lambda r: r[2])]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words and matches (license, matched words, coverage, start and stop in characters) of each row of docs (doc_id, text, ...)."""
    index = Index(templates or TEMPLATES, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [index.matches(t) if t else [] for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, matches array<struct<license:string,matched:int,coverage:double,start:int,stop:int>>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct("matches.license"))).alias("licenses"),
        F.round(F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)), 4).alias("best_coverage"),
        F.coalesce(F.aggregate("matches", F.lit(0).cast("bigint"), lambda a, m: a + m["matched"]), F.lit(0)).alias("n_matched_words"),
        F.concat_ws(",", F.transform("matches", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string")))).alias("spans"),
    )
