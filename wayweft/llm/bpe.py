"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The encoder never merges. It walks a piece left to right, taking the longest token that starts at the current byte
(from one Aho-Corasick pass over the piece) and accepts it when the pair with the previous token is compatible: merging
the joined bytes would give just these two tokens. If not, it tries the token's next shorter prefix, then steps back.
Positions found to be dead ends are never entered again, so the work is linear in the piece. Accepted token sequences
are exactly those that merging in rank order gives. Decoding joins slices of one byte string by an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayweft.runtime import ship

#: Where the vocabulary files lie unless the caller says otherwise: on the driver, or a URI; executors get them with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered by a worker, and the longest that is remembered, in characters.
CACHE_PIECES = 400_000
CACHE_PIECE_CHARS = 64
#: Ids that one result batch holds before it is handed on.
_FLUSH = 2_000_000

#: The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers that came after Unicode 16; the vocabulary's pattern does not know them.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)

_later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
_later_found = regex.compile(f"[{_later}]").search
_fast = regex.compile(PATTERN).findall
_exact = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{_later}])").replace(r"\p{L}+", f"[\\p{{L}}--[{_later}]]+").replace(r"\p{N}+", f"[\\p{{N}}--[{_later}]]+"), regex.V1).findall


def split_pieces(text: str) -> list[str]:
    """The pieces that are encoded one by one."""
    return _fast(text) if text.isascii() or not _later_found(text) else _exact(text)


class Backtracking:
    """Exact BPE encoder and decoder of one vocabulary, a list of tokens by rank."""

    def __init__(self, tokens: Sequence[bytes]):
        self.tokens = list(tokens)
        self.id_of = {t: i for i, t in enumerate(self.tokens)}
        self.offsets = np.r_[0, np.cumsum([len(t) for t in self.tokens])].astype(np.int64)
        self.bytes = b"".join(self.tokens)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.shorter = [next((p for n in range(len(t) - 1, 0, -1) if (p := self.id_of.get(t[:n])) is not None), -1) for t in self.tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        for i, t in enumerate(self.tokens):  # in rank order, so the parts of a token are known before it
            pair, left = (i, i), self.shorter[i]
            while left >= 0:
                right = self.id_of.get(t[len(self.tokens[left]) :])
                if right is not None and left < i and right < i and self.compatible(left, right):
                    pair = (left, right)
                    self.merged[pair] = i
                    break
                left = self.shorter[left]
            self.halves.append(pair)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left + right gives just these two tokens.

        Undo the merges on both sides of the seam, latest first; if ever the two tokens at the seam could have been
        merged before the last undone merge took place, the pair would not have come about.
        """
        merged, halves, before = self.merged.get, self.halves, 1 << 62
        while True:
            if merged((left, right), 1 << 62) < before:
                return False
            inner_left, inner_right = halves[left][1] if left < len(halves) else left, halves[right][0] if right < len(halves) else right
            if left > right and inner_left != left or inner_right == right and inner_left != left:
                before, left = left, inner_left
            elif inner_right != right:
                before, right = right + 1, inner_right
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        known = self.id_of.get(piece)
        if known is not None and (len(piece) == 1 or self.halves[known][0] != known):
            return [known]
        n = len(piece)
        if not n:
            return []
        longest, reach = [-1] * n, [0] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            end = at + len(tokens[token])
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:  # nothing that starts here will do: step back and shorten what led here
                dead[at] = 1
                last = out.pop()
                at -= len(tokens[last])
                token = shorter[last]
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        at, data = self.offsets, self.bytes
        return b"".join([data[at[i] : at[i + 1]] for i in ids])


class _Pieces(dict):
    """piece -> its ids as little-endian int32 bytes."""

    def __init__(self, encoder: Backtracking):
        super().__init__()
        self.encode = encoder.encode_piece

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode("utf-8", "replace")), "<i4").tobytes()
        if len(piece) <= CACHE_PIECE_CHARS:
            self[piece] = ids
        return ids


_loaded: dict[str, _Pieces] = {}


def load(path: str = VOCABULARY) -> _Pieces:
    """The encoder of a rank file, built once per Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
        if [r for r, _ in ranks] != list(range(len(ranks))):
            raise ValueError(f"{os.path.basename(path)} has gaps in its ranks")
        _loaded[path] = _Pieces(Backtracking([t for _, t in ranks]))
    return _loaded[path]


_sent: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary to all executors once per application; returns the name under which workers find it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)
    return os.path.basename(path)


def encode_text(text: str, pieces: _Pieces) -> bytes:
    """The ids of a text as little-endian int32 bytes."""
    if len(pieces) > CACHE_PIECES:
        pieces.clear()
    return b"".join(map(pieces.__getitem__, split_pieces(text)))


def _own(df: DataFrame, keys: Sequence[str], text: str) -> tuple[DataFrame, list[T.StructField]]:
    ship(df.sparkSession)
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.select(*cols, F.col(text).cast("binary").alias("_text")), [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]


def encode_corpus(df: DataFrame, keys: Sequence[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys, ids array<int>: the ids of every text, without special tokens, whose strings are ordinary text.

    Null text gives null ids, empty text an empty list; bytes that are no UTF-8 count as replacement characters; rows
    that repeat are repeated; other columns are ignored. No shuffle: every task encodes the rows it reads.
    """
    rows, fields = _own(df, keys, text)
    name = _send(df.sparkSession, vocabulary)
    out = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(SparkFiles.get(name))
        for b in batches:
            texts, start, found, size = b.column(len(keys)), 0, [], 0

            def flush(stop: int) -> pa.RecordBatch:
                lengths = [0 if f is None else len(f) // 4 for f in found]
                mask = pa.array([f is None for f in found])
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(f for f in found if f), "<i4"))
                ids = pa.ListArray.from_arrays(offsets, values, mask=mask)
                return pa.RecordBatch.from_arrays([*[b.column(i).slice(start, stop - start) for i in range(len(keys))], ids], names=out.names)

            for i, raw in enumerate(texts):
                raw = raw.as_py()
                found.append(None if raw is None else encode_text(raw.decode("utf-8", "replace"), pieces))
                size += len(found[-1] or b"") // 4
                if size > _FLUSH:
                    yield flush(i + 1)
                    start, found, size = i + 1, [], 0
            if found:
                yield flush(len(texts))

    return rows.mapInArrow(run, out).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "ids")


def count_tokens(df: DataFrame, keys: Sequence[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys, n_tokens bigint: as encode_corpus(), but only how many ids each text has; null and empty texts have 0."""
    rows, fields = _own(df, keys, text)
    name = _send(df.sparkSession, vocabulary)
    out = T.StructType([*fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(SparkFiles.get(name))
        for b in batches:
            n = [len(encode_text(raw.decode("utf-8", "replace"), pieces)) // 4 if (raw := t.as_py()) else 0 for t in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(n, pa.int64())], names=out.names)

    return rows.mapInArrow(run, out).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n_tokens")


def decode_corpus(df: DataFrame, keys: Sequence[str], ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys, text: the texts that encode_corpus() encoded; null ids give null, an empty list an empty text."""
    ship(df.sparkSession)
    name = _send(df.sparkSession, vocabulary)
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    fields = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType([*fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(SparkFiles.get(name)).encode.__self__.decode
        for b in batches:
            texts = [None if (x := v.as_py()) is None else decode(x).decode("utf-8", "replace") for v in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(texts, pa.string())], names=out.names)

    return df.select(*cols, F.col(ids).alias("_ids")).mapInArrow(run, out).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "text")
