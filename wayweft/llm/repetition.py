"""Repetition inside single documents, from suffix arrays.

A text becomes units: words, and single characters of the scripts that are written without blanks; letter case, digits,
punctuation and white space are left out. The suffix array of a block of documents is built by prefix doubling on whole
arrays; a document's units are distinct from all others', so suffixes of different documents never compare equal.
Neighbours in the array whose common prefix reaches the least length form the LCP intervals of maximal repeated
substrings; all their occurrences but the earliest are repeats, whose spans are united.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayweft.runtime import ship

#: A repeat has at least so much weight: five words, or ten characters of a script without blanks.
LEAST_WEIGHT, WORD_WEIGHT, CHAR_WEIGHT = 10, 2, 1
#: A document is repetitive from this share on.
SHARE_LIMIT = 0.4
#: A single repeat of more letters than this is too long for over_limits().
LONGEST_LIMIT = 400
#: Units that are put into one suffix array; a longer document has one of its own.
BLOCK_UNITS = 400_000

#: The scripts written without blanks, and the mark that lengthens vowels in two of them.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー"
_ascii_words = re.compile("[a-z]+").findall
_words = regex.compile(r"[\p{L}\p{M}]+").findall
_mixed = regex.compile(rf"[[{_UNSPACED}]&&[\p{{L}}\p{{M}}]]|[[\p{{L}}\p{{M}}]--[{_UNSPACED}]]+", regex.V1).findall
_unspaced = regex.compile(f"[{_UNSPACED}]", regex.V1)


def units_of(text: str) -> tuple[list[str], bool]:
    """The units of a text, and whether single characters of unspaced scripts are among them."""
    text = text.lower()
    if text.isascii():
        return _ascii_words(text), False
    return (_mixed(text), True) if _unspaced.search(text) else (_words(text), False)


def suffix_ranks(unit: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... units, until every suffix has its own rank.

    unit: number of each unit; doc: ascending number of its document. A rank is the place in the suffix array of the
    first suffix that is equal so far, so the last ranks are the places themselves.
    """
    n = len(unit)
    key = doc * (int(unit.max()) + 1) + unit if n else unit
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    active = order[np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n]))]
    levels, h = [rank.astype(np.int32)], 1
    while len(active):
        ahead = active + h
        ok = ahead < n
        ok[ok] = doc[ahead[ok]] == doc[active[ok]]
        nxt = np.zeros(len(active), np.int64)
        nxt[ok] = rank[ahead[ok]] + 1
        old = rank[active]
        key = old * (n + 1) + nxt
        sort = np.argsort(key, kind="stable")
        active, key, old = active[sort], key[sort], old[sort]
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, old[1:] != old[:-1]]
        at = np.arange(len(active))
        start, base = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = old + start - base
        levels.append(rank.astype(np.int32))
        size = np.diff(np.r_[np.flatnonzero(first), len(active)])
        active = active[np.repeat(size > 1, size)]
        h *= 2
    return levels


def measure(unit: np.ndarray, doc: np.ndarray, weight: np.ndarray, chars: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: characters that only repeat, all characters, characters of the longest repeat."""
    n = len(unit)
    total = np.bincount(doc, chars, docs)
    longest = np.zeros(docs, np.int64)
    if n < 2:
        return np.zeros(docs), total, longest
    levels = suffix_ranks(unit, doc)
    place = np.empty(n, np.int64)
    place[levels[-1]] = np.arange(n)
    reach, upto = np.r_[0, np.cumsum(weight)], np.r_[0, np.cumsum(chars)]
    need = np.searchsorted(reach, reach[:-1] + LEAST_WEIGHT) - np.arange(n)
    a, b = place[:-1], place[1:]
    deep = min(len(levels) - 1, 2)  # a repeat has at least five units, so its first four are equal
    pair = np.flatnonzero(levels[deep][a] == levels[deep][b])
    i, j = a[pair].copy(), b[pair].copy()
    common = np.zeros(len(pair), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ok = np.maximum(i, j) < n
        ok[ok] = levels[level][i[ok]] == levels[level][j[ok]]
        step = ok.astype(np.int64) << level
        i += step
        j += step
        common += step
    ok = common >= need[b[pair]]
    pair, common = pair[ok], common[ok]
    if not len(pair):
        return np.zeros(docs), total, longest
    start = b[pair]
    np.maximum.at(longest, doc[start], upto[start + common] - upto[start])
    linked = np.zeros(n, bool)
    linked[pair + 1] = True  # place[k] continues the interval of place[k - 1]
    heads = np.flatnonzero(~linked)
    earliest = np.minimum.reduceat(place, heads)
    again = place[linked | np.r_[linked[1:], False]]
    of = np.cumsum(~linked) - 1
    mine = earliest[of[linked | np.r_[linked[1:], False]]]
    again = again[again != mine]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + need[again], -1)
    return np.bincount(doc, chars * (np.cumsum(edge[:-1]) > 0), docs), total, longest


def measure_texts(texts: Sequence[str]) -> list[tuple[int, float, int, int]]:
    """For each text: units, repeated share of its characters, characters of the longest repeat, all characters."""
    out: list[tuple[int, float, int, int]] = []
    units: list[str] = []
    lengths: list[int] = []
    mixed = False

    def close() -> None:
        nonlocal mixed
        number: defaultdict = defaultdict(count().__next__)
        unit = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
        chars = np.fromiter(map(len, units), np.int64, len(units))
        weight = np.full(len(units), WORD_WEIGHT)
        if mixed:
            alone = np.fromiter((bool(len(u) == 1 and _unspaced.match(u)) for u in number), bool, len(number))
            weight[alone[unit]] = CHAR_WEIGHT
        doc = np.repeat(np.arange(len(lengths)), lengths)
        again, total, longest = measure(unit, doc, weight, chars, len(lengths))
        out.extend((n, float(r / t) if t else 0.0, int(m), int(t)) for n, r, t, m in zip(lengths, again, total, longest))
        units.clear()
        lengths.clear()
        mixed = False

    for text in texts:
        own, has = units_of(text)
        if units and len(units) + len(own) > BLOCK_UNITS:
            close()
        units += own
        lengths.append(len(own))
        mixed |= has
    if lengths:
        close()
    return out


def repetition(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, n_units, share, longest_repeat, n_letters of every row; no shuffle.

    share: part of the letters in stretches of at least five words (ten characters in scripts without blanks) that
    occurred earlier in the same text; overlaps with the earlier place count. longest_repeat: letters of the longest
    substring of that least length that occurs twice. Null texts give nulls, texts without letters 0; bytes that are no UTF-8 count as
    replacement characters; whole texts are measured however long; repeated rows are repeated; other columns are
    ignored.
    """
    ship(df.sparkSession)
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    fields = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType([*fields, T.StructField("n_units", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("longest_repeat", T.LongType()), T.StructField("n_letters", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(len(keys))
            valid = np.flatnonzero(np.asarray(raw.is_valid()))
            found = measure_texts([raw[int(i)].as_py().decode("utf-8", "replace") for i in valid])
            columns = []
            for c, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64())):
                values: list = [None] * len(raw)
                for i, row in zip(valid, found):
                    values[i] = row[c]
                columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *columns], names=out.names)

    rows = df.select(*cols, F.col(text).cast("binary").alias("_text")).mapInArrow(run, out)
    return rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n_units", "share", "longest_repeat", "n_letters")


def repetitive(df: DataFrame, keys: Sequence[str], text: str, share_limit: float = SHARE_LIMIT, longest_limit: int | None = None) -> DataFrame:
    """Distinct keys of rows whose repeated share reaches share_limit, or whose longest repeat exceeds longest_limit letters."""
    over = F.col("share") >= share_limit
    if longest_limit is not None:
        over = over | (F.col("longest_repeat") > longest_limit)
    return repetition(df, keys, text).where(over).select(*keys).distinct()


def over_limits(df: DataFrame, keys: Sequence[str], text: str, share_limit: float = SHARE_LIMIT, longest_limit: int = LONGEST_LIMIT) -> DataFrame:
    """keys, share, longest_repeat, over_share, over_longest of the rows that break either limit; null texts break none."""
    rows = repetition(df, keys, text).withColumns({"over_share": F.col("share") >= share_limit, "over_longest": F.col("longest_repeat") > longest_limit})
    return rows.where("over_share OR over_longest").select(*keys, "share", "longest_repeat", "over_share", "over_longest")
