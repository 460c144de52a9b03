"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text's symbols form a doubly linked list; a heap holds the adjacent pairs that the vocabulary can join. The pair of
lowest rank is popped again and again, the leftmost of equals, and joined; stale entries are skipped. The count is the
number of initial symbols minus the number of merges (with byte fallback, a symbol left over that is in no vocabulary
counts one for each of its bytes).

Two kinds of vocabulary: a sentencepiece BPE `.model` without character map, and a `.tiktoken` rank file of byte-level BPE.
Merges never cross the places where a text is cut into pieces first (before a run of blanks; the published split pattern),
so equal pieces have equal counts; each task keeps a bounded table of counts of pieces.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a text of any length is
counted whole (merging takes n log n); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVER = 4096
#: Pieces whose counts a task keeps before it starts anew.
CACHE = 400_000


def merge(symbols: list, rank: Callable) -> list:
    """The symbols left when no adjacent pair has a rank; rank(left + right) is a number or None."""
    n = len(symbols)
    if n < 2:
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
    heapify(heap)
    while heap:
        _, i, joined = heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n or symbols[i] + symbols[j] != joined:
            continue
        symbols[i], symbols[j] = joined, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(both := joined + symbols[k])) is not None:
                heappush(heap, (r, i, both))
        if (h := before[i]) >= 0 and (r := rank(both := symbols[h] + joined)) is not None:
            heappush(heap, (r, h, both))
    return [s for s in symbols if s is not None]


class _Counts(dict):
    """Counts of pieces, made on first use."""

    def __init__(self, count: Callable) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, piece):  # noqa: ANN001, ANN204
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n = self.count(piece)
        return n


def sentencepiece_counter(model: bytes) -> Callable[[str], int]:
    """Counts as the sentencepiece library's default encoding of the text has ids."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_proto=model)
    ranks, known = {}, set()
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)):
            ranks[p.id_to_piece(i)] = -p.get_score(i)
            known.add(p.id_to_piece(i))
    dummy, extra = len(p.encode("a")) and p.encode("a", out_type=str)[0].startswith("▁"), p.encode("a  b", out_type=str)
    if not dummy or "".join(extra) != "▁a▁▁b" or any(p.is_unused(i) for i in range(p.get_piece_size())) or not any(map(p.is_byte, range(p.get_piece_size()))):
        raise ValueError("only BPE models with byte fallback, a leading blank and unchanged blanks are supported")

    def one(piece: str) -> int:
        return sum(1 if s in known else len(s.encode()) for s in merge(list("▁" + piece), ranks.get))

    counts = _Counts(one)

    def count(text: str) -> int:
        """Pieces are a run of blanks with what follows it; a piece's first blank stands for itself or the leading one."""
        if not text:
            return 0
        pieces = text.replace("▁", " ").split(" ")
        if "" not in pieces:
            return sum(map(counts.__getitem__, pieces))
        total, blanks = 0, 0
        last = len(pieces) - 1
        for i, x in enumerate(pieces):
            if x or i == last:
                total += counts["▁" * blanks + x]
                blanks = 0
            else:
                blanks += 1
        return total

    return count


def rank_file_counter(ranks: bytes, pattern: str) -> Callable[[str], int]:
    """Counts of byte-level BPE by a file of base64 pieces with ranks, texts first split by pattern."""
    import regex

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    split = regex.compile(pattern)
    counts = _Counts(lambda piece: len(merge([bytes([x]) for x in piece.encode()], table.get)))
    return lambda text: sum(map(counts.__getitem__, (m.group() for m in split.finditer(text))))


def counter(path: str, content: bytes, pattern: str | None = None) -> Callable[[str], int]:
    if path.endswith(".model"):
        return sentencepiece_counter(content)
    if path.endswith(".tiktoken") and pattern:
        return rank_file_counter(content, pattern)
    raise ValueError("a .model, or a .tiktoken file with its split pattern, is needed")


def token_counts(docs: DataFrame, path: str, pattern: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text, ...); path: the vocabulary file.

    The file (about 1 MB, whatever the input) goes to the tasks with the function. No shuffle.
    """
    with open(path, "rb") as f:
        content = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, content, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([count(t) if t else 0 for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > over)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
