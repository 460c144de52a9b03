"""Token identifiers packed into rows of one length, written as binary matrices.

Texts are turned into ids piece by piece (pieces as in token_counts): many texts are cut at once by Arrow, each distinct piece is looked up once, and
each task keeps a bounded table of short pieces. It goes with the task: what a worker kept would take memory from other queries. Overlong documents are split without loss into segments of
at most the row length, and segments are packed by best fit in decreasing order: a segment tree over the room left in
open rows finds the least room that holds the next segment. Each task packs the documents of its own partition in
buffers of bounded size, so that nothing is shuffled and no group of documents has to meet.

A result row is one row of the matrix: `ids` (little-endian uint16, or uint32 for vocabularies over 65,536 entries; padded to
the row length), `n_tokens`, and by segment `doc_ids`, `starts` (the segment's offset in its document's ids), `cu_seqlens`
(cumulative lengths, from 0) and `resets` (places where position numbers begin again at 0).

Defined results: a null or empty text has no ids and no segment; repeated rows are packed each; a null doc_id stays null in
doc_ids, which have the type of doc_id; an empty table gives no rows; other columns are not read. Which segments share a row follows from how the input is
dealt to tasks: other partitions give other rows of the same ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROW = 2048
#: Tokens of segments shorter than a row that a task gathers before it packs them.
BUFFER = 2_000_000
#: Pieces that a task remembers, and the longest that it remembers.
CACHE, SHORT = 400_000, 64
#: Bytes of texts that are cut into pieces at once; a longer text is cut alone.
CHUNK = 4 << 20
BLANK = "▁"

#: texts -> the ids of all of them in order, and each one's number of ids
Ids = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sentencepiece_ids(model: bytes, kind: np.dtype) -> Ids:
    """The library's default ids, with a table of some CACHE pieces at most. When half of it is new, what was not used since then is forgotten."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_proto=model)
    blank = np.array(p.encode("a ")[len(p.encode("a")) :], kind).tobytes()
    new, old = {"": blank}, {}

    def encode(pieces: list[str]) -> Iterator[bytes]:
        made = p.encode(pieces, num_threads=1)
        ids = np.fromiter(chain.from_iterable(made), kind).tobytes()
        ends = (np.cumsum([len(x) for x in made]) * kind.itemsize).tolist()
        return (ids[lo:hi] for lo, hi in zip([0, *ends], ends))

    def known(pieces: list[str]) -> list[bytes]:
        nonlocal new, old
        if len(new) > CACHE // 2:
            new, old = {"": blank}, new
        found = list(map(new.get, pieces))
        lacking = [i for i, x in enumerate(found) if x is None]
        for i in lacking:
            found[i] = old.get(pieces[i])
        unseen = [i for i in lacking if found[i] is None]
        if unseen:
            for i, x in zip(unseen, encode([pieces[i] for i in unseen])):
                found[i] = x
        new.update((pieces[i], found[i]) for i in lacking if len(pieces[i]) <= SHORT)
        return found

    def ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.zeros(len(texts), np.int64)
        has = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        texts = pc.replace_substring(texts.filter(has).cast(pa.large_string()), BLANK, " ")
        # of a run of blanks the first ends a piece and the others begin the next; one blank goes before the text
        texts = pc.replace_substring_regex(texts, r"\A ", BLANK)
        texts = pc.replace_substring(pc.replace_substring(texts, "  ", " " + BLANK), BLANK + " ", BLANK * 2)
        cut = pc.split_pattern(texts, " ")
        pieces = cut.flatten().dictionary_encode()
        which, found = pieces.indices.to_numpy(), known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        n = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        each = n[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat((np.cumsum(n) - n)[which] - ends[:-1], each)
        at += np.arange(at.size)
        sizes[has.to_numpy(zero_copy_only=False)] = np.diff(ends[cut.offsets.to_numpy()])
        return np.frombuffer(b"".join(found), kind)[at], sizes

    return ids


def rank_file_ids(ranks: bytes, pattern: str, kind: np.dtype) -> Ids:
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = [e.encode_ordinary(t) if t else [] for t in texts.to_pylist()]
        return np.fromiter(chain.from_iterable(made), kind), np.array([len(x) for x in made], np.int64)

    return ids


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) texts of runs of some CHUNK bytes."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while lo < ends.size:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of indices, none over room in sum; longest first, each to the open bin that it fills best.

    The tree's leaves are amounts of room left, each with a stack of bins; inner nodes count the bins below.
    """
    size = 1 << room.bit_length()
    count = [0] * (2 * size)
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, at = int(lengths[i]), size + int(lengths[i])
        # the first leaf from n on that has a bin: up while there is none to the right, then down to the left
        while at > 1 and not count[at]:
            while at & 1 and at > 1:
                at >>= 1
            if at <= 1:
                break
            at += 1
        if at <= 1:
            left, b = room, len(bins)
            bins.append([i])
        else:
            while at < size:
                at = 2 * at if count[2 * at] else 2 * at + 1
            left = at - size
            b = stacks[left].pop()
            bins[b].append(i)
            while at:
                count[at] -= 1
                at >>= 1
        left -= n
        if left:
            stacks[left].append(b)
            at = size + left
            while at:
                count[at] += 1
                at >>= 1
    return bins


def _pack(content: bytes, path: str, pattern: str | None, kind: str, row: int, buffer: int, pad: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = sentencepiece_ids(content, np.dtype(kind)) if path.endswith(".model") else rank_file_ids(content, pattern, np.dtype(kind))
        held: list[tuple] = []
        held_tokens, doc_type = 0, pa.int64()

        def out(rows: list[list[tuple]]) -> pa.RecordBatch:
            ids = []
            for r in rows:
                a = np.full(row, pad, kind)
                x = np.concatenate([s[2] for s in r])
                a[: x.size] = x
                ids.append(a.tobytes())
            ends = [np.cumsum([0] + [s[2].size for s in r]).tolist() for r in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.binary()), pa.array([e[-1] for e in ends], pa.int32()), pa.array([[s[0] for s in r] for r in rows], pa.list_(doc_type)),
                    pa.array([[s[1] for s in r] for r in rows], pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                ],
                ["ids", "n_tokens", "doc_ids", "starts", "cu_seqlens", "resets"],
            )

        def packed() -> Iterator[pa.RecordBatch]:
            bins = best_fit_decreasing(np.array([s[2].size for s in held], np.int64), row)
            for lo in range(0, len(bins), 1000):
                yield out([[held[i] for i in b] for b in bins[lo : lo + 1000]])
            held.clear()

        for b in batches:
            full: list[list[tuple]] = []
            doc_type = b.column("doc_id").type
            docs, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in _chunks(texts):
                ids, sizes = to_ids(texts.slice(lo, hi - lo))
                for doc, n, end in zip(docs[lo:hi], sizes.tolist(), np.cumsum(sizes).tolist()):
                    x = ids[end - n : end]
                    for at in range(0, n, row):
                        part = x[at : at + row]
                        if part.size == row:
                            full.append([(doc, at, part)])
                        else:
                            held.append((doc, at, part.copy()))
                            held_tokens += part.size
                    if len(full) >= 1000:
                        yield out(full)
                        full = []
                    if held_tokens >= buffer:
                        yield from packed()
                        held_tokens = 0
            if full:
                yield out(full)
        if held:
            yield from packed()

    return run


def packed_rows(docs: DataFrame, path: str, vocabulary: int, pattern: str | None = None, row: int = ROW, buffer: int = BUFFER, pad: int = 0) -> DataFrame:
    """The packed matrix of docs (doc_id, text, ...) by the vocabulary file at path, with so many entries."""
    with open(path, "rb") as f:
        content = f.read()
    run = _pack(content, path, pattern, "<u2" if vocabulary <= 1 << 16 else "<u4", row, buffer, pad)
    return docs.select("doc_id", "text").mapInArrow(run, f"ids binary, n_tokens int, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, starts array<int>, cu_seqlens array<int>, resets array<int>")


def write_packed(docs: DataFrame, path: str, folder: str, vocabulary: int, **options) -> None:  # noqa: ANN003
    """Write the packed matrix as Parquet with binary columns, by Spark's own writer, so that any store will do."""
    packed_rows(docs, path, vocabulary, **options).write.option("compression", "zstd").parquet(folder)


def op9_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), 32_000)
