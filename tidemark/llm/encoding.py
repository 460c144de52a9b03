"""Exact encoding and decoding with a merge-type sentencepiece model, by backtracking instead of merging.

A sequence of pieces is what merging would leave if, and only if, each two adjacent pieces stay two pieces when their own characters
are merged again. So the encoder walks over the text once: it takes the longest piece that starts at the place, by Aho-Corasick over the reversed text (the
longest match that ends at a place of the reversed text is the longest piece that starts at that of the text), checks that it stands beside
the piece before it, tries shorter ones if not, and steps back a piece if none does. Each prefix of a text has one encoding
at most, so a place from which a step back was taken is never worth a second visit: a bitfield holds these places.

Merges never cross two characters that stand side by side in no piece of the vocabulary, so texts are encoded unit by unit: first cut at the
starts of runs of blanks (where no piece has a blank after another character), then between such characters. Each worker keeps a bounded table of
short units from task to task. Characters that are in no piece become their UTF-8 bytes.

Defined results: a null or empty text has no ids and decodes to the empty text; a null list of ids decodes to the empty text; repeated rows are
encoded each; a text of any length is encoded whole (some 8 bytes a character of its longest unit); an empty table gives an
empty result; other columns of the table are kept as they are by `decoded` and not read by `encoded`. Decoding restores a text except that U+2581 becomes a blank.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tables import fresh

#: Units and pairs that a task remembers before it starts anew, and the longest unit that it remembers.
REMEMBERED, SHORT = 240_000, 64
#: Rows that are taken at once, and ids of a batch of results.
ROWS, BATCH = 500, 1 << 20
BLANK = "▁"
NONE = float("inf")


class _Memory(dict):
    """Results of a function, made on first use. When half of what may be remembered is new, what was not used since then is forgotten."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        out = self.old[key] if key in self.old else self.make(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Vocabulary:
    """The pieces of a model and what its ids stand for."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_proto=model)
        every = range(p.get_piece_size())
        extra = p.encode("a  b", out_type=str)
        if "".join(extra) != "▁a▁▁b" or any(map(p.is_unused, every)) or not any(map(p.is_byte, every)):
            raise ValueError("only BPE models with byte fallback, a leading blank and unchanged blanks are supported")
        self.ids = {p.id_to_piece(i): i for i in every if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
        self.ranks = {piece: -p.get_score(i) for piece, i in self.ids.items()}
        self.of_byte = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.control, self.unknown = {i for i in every if p.is_control(i)}, p.unk_id()
        self.beside = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}


class Encoder:
    """Ids of texts."""

    def __init__(self, words: Vocabulary) -> None:
        import ahocorasick

        self.words = words
        self.backwards = ahocorasick.Automaton()
        for piece in words.ids:
            self.backwards.add_word(piece[::-1], piece)
        self.backwards.make_automaton()
        packed, of_byte = {piece: array("i", [i]).tobytes() for piece, i in words.ids.items()}, words.of_byte
        self.fits = _Memory(self._fits)
        self.shorter = _Memory(self._shorter)
        self.parts = _Memory(lambda text: b"".join([packed.get(x) or array("i", map(of_byte.__getitem__, x.encode())).tobytes() for x in self.pieces(text)]))
        self.known = _Memory(self.unit)
        whole = any(BLANK in pair[1] != pair[0] for pair in words.beside)
        self.units = re.compile(".+", re.DOTALL) if whole else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether two pieces stay these two when their characters are merged; with an empty left one, whether the other is made of its characters at all."""
        rank, s = self.words.ranks.get, [*pair[0], *pair[1]]
        ranks = [rank(s[i] + s[i + 1], NONE) for i in range(len(s) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            s[i] += s.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(s[i - 1] + s[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(s[i] + s[i + 1], NONE)
        return s == [x for x in pair if x]

    def _shorter(self, piece: str) -> str:
        """The longest piece that a piece begins with, its first character if there is none, nothing after that."""
        return next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.words.ids), "")

    def _longest(self, text: str) -> list[str]:
        """The longest piece that starts at each character, or the character. Matches that end at one place come with the longest first."""
        out, last, seen = list(text), len(text) - 1, -1
        for end, piece in self.backwards.iter(text[::-1]):
            if end != seen:
                out[last - end] = piece
                seen = end
        return out

    def pieces(self, text: str) -> list[str]:
        longest, n, fits = self._longest(text), len(text), self.fits
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at, before = 0, ""
        piece = longest[0] if n else ""
        while at < n:
            while piece and (failed[(end := at + len(piece)) >> 3] >> (end & 7) & 1 or not fits[before, piece]):
                piece = self.shorter[piece]
            if piece:
                out.append(piece)
                at, before = end, piece
                piece = longest[at] if at < n else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""
        return out

    def unit(self, text: str) -> bytes:
        """Ids of a text that is cut first between characters that no piece has side by side."""
        beside, began, out = self.words.beside, 0, []
        for i in range(1, len(text) + 1):
            if text[i - 1 : i + 1] not in beside:  # at the end one character is left, which is no pair either
                out.append(self.parts[text[began:i]])
                began = i
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, self.units.findall(BLANK + text.replace(" ", BLANK)))) if text else b""


class Decoder:
    """Texts of ids."""

    def __init__(self, words: Vocabulary) -> None:
        self.control = words.control
        self.pieces = {i: piece.replace(BLANK, " ").encode() for piece, i in words.ids.items()}
        self.bytes = {i: bytes([b]) for b, i in enumerate(words.of_byte)}
        self.all = {**self.pieces, **self.bytes, **dict.fromkeys(words.control, b""), words.unknown: " ⁇ ".encode()}

    def _run(self, raw: bytes) -> str:
        """Text of consecutive byte pieces; each byte that is in no character stands for U+FFFD."""
        out, at = [], 0
        while at < len(raw):
            for k in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + k].decode())
                    at += k
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        first = next((i for i in ids if i not in self.control), None)
        lead = first in self.pieces and self.pieces[first].startswith(b" ")
        parts = list(map(self.all.__getitem__, ids))
        try:
            text = b"".join(parts).decode() if self.control.isdisjoint(ids) else None
        except UnicodeDecodeError:
            text = None
        if text is None:  # bytes make characters only with the byte pieces right beside them
            out, run = [], b""
            for i, part in zip(ids, parts, strict=True):
                if i in self.bytes:
                    run += part
                else:
                    out += [self._run(run), part.decode()]
                    run = b""
            text = "".join([*out, self._run(run)])
        return text[1:] if lead else text


@lru_cache(maxsize=1)
def _encoder(model: bytes) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(Vocabulary(model))


@lru_cache(maxsize=1)
def _decoder(model: bytes) -> Decoder:
    return Decoder(Vocabulary(model))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row of docs (doc_id, text, ...); path: the model file.

    The file (some 500 KB, whatever the input) goes to the tasks with the function. No shuffle.
    """
    model = _content(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model).encode
        for b in _slices(batches):
            texts, began = b.column("text").to_pylist(), 0
            while began < b.num_rows:
                parts, ends = [], [0]
                for text in texts[began:]:
                    parts.append(encode(text))
                    ends.append(ends[-1] + len(parts[-1]) // 4)
                    if ends[-1] >= BATCH:
                        break
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(began, len(parts)), lists], ["doc_id", "ids"])
                began += len(parts)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(tokens: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """The rows of tokens (ids, ...) with the text of their ids in a new column (`into`, with `_` after it where the name is taken)."""
    model = _content(path)
    into = fresh(into, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(model).decode
        for b in _slices(batches):
            ids = b.column("ids")
            flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
            texts = [decode(flat[ends[k] : ends[k + 1]].tolist()) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(into, T.StringType())]))


def op11_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
