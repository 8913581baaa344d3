"""Several values packed in one field: a quote-aware finite-state tokenizer.

The automaton reads a text once. Its state is (quote that would close, nesting depth, escaped?); delimiters count only
in the state (no quote, depth 0, not escaped). Values come out with their position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayweft.runtime import ship

#: Values that one result batch holds before it is handed on.
FLUSH = 200_000
#: Opening and closing double quotes of every style.
DOUBLE_QUOTES = {'"': '"', "“": "”", "„": "”", "‟": "”", "«": "»", "＂": "＂"}


@dataclass(frozen=True)
class Dialect:
    """What separates and what protects.

    separators: characters that end a value. extra: separators that hold only in rows where the caller says so.
    blank_run: so many white space characters in a row separate (0: never). fraction: a character that is no separator
    directly between two digits. escape: takes the next character literally. brackets: inside them nothing separates.
    """

    separators: frozenset[str] = frozenset(";,|/&\t\n\r\v\f\x85  、，；／｜＆·•")
    extra: frozenset[str] = frozenset("-‐‑‒–—−")
    quotes: Mapping[str, str] = field(default_factory=lambda: dict(DOUBLE_QUOTES))
    fraction: str = "/"
    blank_run: int = 2
    escape: str = ""
    brackets: Mapping[str, str] = field(default_factory=dict)

    def marks(self) -> str:
        """Characters without which a text is a single value."""
        return "".join(sorted(self.separators | self.extra | set(self.quotes) | set(self.quotes.values()) | set(self.brackets) | ({self.escape} if self.escape else set())))


class Tokenizer:
    """The automaton of a dialect. It jumps from mark to mark; what lies between marks is never looked at singly."""

    def __init__(self, dialect: Dialect):
        d = self.dialect = dialect
        protect = set(d.quotes) | set(d.brackets) | set(d.brackets.values()) | ({d.escape} if d.escape else set())
        blanks = r"|\s{" + str(d.blank_run) + ",}" if d.blank_run else ""
        one = lambda chars: "[" + re.escape("".join(sorted(chars))) + "]"
        self.marks = {extra: re.compile(one(protect | d.separators | (d.extra if extra else frozenset())) + blanks).search for extra in (False, True)}
        self.plain = {extra: re.compile(one(d.separators | (d.extra if extra else frozenset())) + blanks) for extra in (False, True)}
        self.protected = re.compile(one(protect)).search if protect else lambda text: None
        self.closers = {c: re.compile(one({c} | ({d.escape} if d.escape else set()))).search for c in set(d.quotes.values())}

    def closing(self, text: str, at: int, close: str) -> int:
        """Where the quote opened before `at` closes, a doubled closing quote being literal; -1 if it doesn't."""
        find, escape = self.closers[close], self.dialect.escape
        while m := find(text, at):
            i = m.start()
            if escape and text[i] == escape or text.startswith(close, i + 1):
                at = i + 2
            else:
                return i
        return -1

    def value(self, raw: str) -> str:
        """A piece trimmed, without enclosing quotes, doubled quotes made single, escapes resolved."""
        d, raw = self.dialect, raw.strip()
        if len(raw) > 1 and raw[0] in d.quotes:
            close = d.quotes[raw[0]]
            if self.closing(raw, 1, close) == len(raw) - 1:
                raw = raw[1:-1].replace(close * 2, close).strip()
        if d.escape and d.escape in raw:
            raw = re.sub(re.escape(d.escape) + "(.)", r"\1", raw, flags=re.S)
        return raw

    def split(self, text: str | None, with_extra: bool = False) -> list[str]:
        """The values of text in order; empty pieces are left out.

        An opening quote that is never closed, a bracket that is never closed, an escape at the very end and a closing
        bracket without an opening one are ordinary characters.
        """
        if not text:
            return []
        d, search, n = self.dialect, self.marks[with_extra], len(text)
        pieces, start = [], 0
        if not self.protected(text):  # nothing protects: the state never changes
            for m in self.plain[with_extra].finditer(text):
                if not self._fraction(text, m.start()):
                    pieces.append(text[start : m.start()])
                    start = m.end()
            pieces.append(text[start:])
            return [v for p in pieces if (v := p.strip())]
        ends = d.separators | d.extra if with_extra else d.separators
        opens = self._matched(text) if any(c in text for c in d.brackets) else {}
        stack: list[str] = []
        for i, c, after in self._outside(text, search):
            if stack and c == stack[-1]:
                stack.pop()
            elif i in opens:
                stack.append(opens[i])
            elif not stack and (c in ends or c.isspace()) and not self._fraction(text, i):
                pieces.append(text[start:i])
                start = after
        pieces.append(text[start:n])
        return [v for p in pieces if (v := self.value(p))]

    def _outside(self, text: str, search) -> Iterator[tuple[int, str, int]]:
        """Place, character and end of every mark that is neither quoted nor escaped."""
        d, at = self.dialect, 0
        unclosed: set[str] = set()
        while m := search(text, at):
            i, c, at = m.start(), text[m.start()], m.end()
            if d.escape and c == d.escape:
                at = i + 2
            elif c in d.quotes and d.quotes[c] not in unclosed:
                end = self.closing(text, i + 1, d.quotes[c])
                if end >= 0:
                    at = end + 1
                else:
                    unclosed.add(d.quotes[c])  # nor can a later one close
            else:
                yield i, c, at

    def _matched(self, text: str) -> dict[int, str]:
        """Places of the opening brackets that are closed, with what closes them."""
        d, stack, out = self.dialect, [], {}
        for i, c, _ in self._outside(text, self.protected):
            if stack and c == d.brackets[text[stack[-1]]]:
                out[stack[-1]] = c
                stack.pop()
            elif c in d.brackets:
                stack.append(i)
        return out

    def _fraction(self, text: str, i: int) -> bool:
        return text[i] == self.dialect.fraction and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()


def split_values(text: str | None, dialect: Dialect, with_extra: bool = False) -> list[str]:
    """The values of one text, see Tokenizer.split()."""
    return Tokenizer(dialect).split(text, with_extra)


def explode_packed(df: DataFrame, keys: list[str], packed: str, extra_if: Column | None = None, dialect: Dialect | None = None, at_least: int = 1) -> DataFrame:
    """keys, pos (from 1), value: one row per value of the text column `packed`.

    extra_if says in which rows the dialect's extra separators hold. Texts with fewer than at_least values give no
    rows. Only texts that hold a mark of the dialect reach Python; the rest stays in the JVM. Null and blank texts
    give no rows; equal values stay separate; rows that repeat are repeated; other columns are ignored.
    """
    ship(df.sparkSession)
    d = dialect or Dialect()
    own = [f"_k{i}" for i, _ in enumerate(keys)]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(packed).alias("_text"), F.coalesce(extra_if if extra_if is not None else F.lit(False), F.lit(False)).alias("_extra"))
    fields = [T.StructField(o, df.schema[k].dataType) for o, k in zip(own, keys)]
    out = T.StructType([*fields, T.StructField("pos", T.LongType()), T.StructField("value", T.StringType())])
    mark = "[" + re.escape(d.marks()).replace("&", r"\&") + r"]" + (r"|(?U)\s{" + str(d.blank_run) + "}" if d.blank_run else "")
    rows = rows.where(F.length("_text") > 0)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Tokenizer(d).split
        for b in batches:
            texts, extra = (b.column(len(own) + i).to_pylist() for i in range(2))
            start, found, size = 0, [], 0
            for i, (t, e) in enumerate(zip(texts, extra)):
                values = split(t, e)
                found.append(values if len(values) >= at_least else [])
                size += len(found[-1])
                if size < FLUSH and i + 1 < len(texts):
                    continue
                counts = np.fromiter(map(len, found), np.int64, len(found))
                row = pa.array(np.repeat(np.arange(start, i + 1), counts))
                pos = np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(row) for k in range(len(own))], pa.array(pos), pa.array([v for f in found for v in f], pa.string())], names=out.names)
                start, found, size = i + 1, [], 0

    several = rows.where(F.col("_text").rlike(mark)).mapInArrow(tokens, out)
    if at_least <= 1:
        value = F.regexp_replace("_text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
        single = rows.where(~F.col("_text").rlike(mark)).select(*own, F.lit(1).cast("long").alias("pos"), value.alias("value")).where("value <> ''")
        several = several.unionByName(single)
    return several.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], "pos", "value")


#: Street names: quotes of every style, a backslash takes the next character literally, nothing separates in brackets.
STREETS = Dialect(escape="\\", brackets={"(": ")", "[": "]", "{": "}"})


def street_names(rlis: DataFrame) -> DataFrame:
    """rlis_streets: objectid, pos, value of every streetname that holds at least two names.

    A hyphen separates only where ftype is RAMP. Of several rows of one objectid the last delivered counts (on a tie
    the greatest text), so repeated rows count once; rows without objectid are kept apart by nothing and give one set.
    """
    last = rlis.groupBy("objectid").agg(F.max(F.struct("loaded_at", "streetname", "ftype")).alias("m"))
    rows = last.select("objectid", "m.streetname", "m.ftype")
    return explode_packed(rows, ["objectid"], "streetname", F.upper(F.trim("ftype")) == "RAMP", STREETS, at_least=2)
