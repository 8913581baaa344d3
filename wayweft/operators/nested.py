"""Deeply nested JSON records as related flat tables with Merkle subtree identities.

Every object, whatever it is, is canonicalised and hashed bottom-up: its hash covers all its fields and, through their
hashes, all objects below it. What differs in form only (order of keys, order and repetition of tags, tags as object or
as list, refs as numbers or as objects) is written in one form before it is hashed, and just that form is stored.
Identical objects therefore share one hash wherever they sit and are stored once; bridge rows keep every occurrence
with its parent, the field it sits in and its ordinal there.

    occurrences  raw_id, occ, parent_occ, field, ordinal, object   one row per place where an object sits
    objects      object, elem_type, elem_id                        one row per distinct object; both null if no element
    tags         object, key, value                                of a distinct element
    nodes        object, pos, ref                                  of a distinct element
    fields       object, field, ordinal, value, value_type         all other scalars of a distinct object
    members      object, field, ordinal, member                    objects directly inside a distinct object
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.operators.skew import salted_join
from wayweft.runtime import materialise, ship

#: What an element is and which keys of it are read.
ELEMENT_TYPES = ("node", "way", "group")
SKIPPED_BELOW = ("meta",)
OWN_FIELDS = ("type", "id", "tags", "nodes")

#: Objects whose content a task remembers to have written, and rows after which it hands a batch on.
WRITTEN, FLUSH = 200_000, 50_000

_TAG = pa.struct([("key", pa.string()), ("value", pa.string())])
_NODE = pa.struct([("pos", pa.int64()), ("ref", pa.int64())])
_FIELD = pa.struct([("field", pa.string()), ("ordinal", pa.int64()), ("value", pa.string()), ("value_type", pa.string())])
_MEMBER = pa.struct([("field", pa.string()), ("ordinal", pa.int64()), ("member", pa.string()), ("elem_type", pa.string()), ("elem_id", pa.int64())])
_ARROW = pa.schema([
    ("raw_id", pa.int64()), ("occ", pa.int64()), ("parent_occ", pa.int64()), ("field", pa.string()), ("ordinal", pa.int64()), ("object", pa.string()), ("content", pa.bool_()),
    ("elem_type", pa.string()), ("elem_id", pa.int64()), ("tags", pa.list_(_TAG)), ("nodes", pa.list_(_NODE)), ("fields", pa.list_(_FIELD)), ("members", pa.list_(_MEMBER)),
])
_SCHEMA = """raw_id bigint, occ bigint, parent_occ bigint, field string, ordinal bigint, object string, content boolean, elem_type string, elem_id bigint,
    tags array<struct<key:string,value:string>>, nodes array<struct<pos:bigint,ref:bigint>>, fields array<struct<field:string,ordinal:bigint,value:string,value_type:string>>,
    members array<struct<field:string,ordinal:bigint,member:string,elem_type:string,elem_id:bigint>>"""


class _Number(str):
    """A JSON number as written."""

    __slots__ = ()


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_decoder = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)
_token = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))', re.A)
_CONSTANTS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """JSON of any depth, with an explicit stack; for texts that are too deep for the recursive parser."""
    at, stack, want, key, root = 0, [], "value", None, None
    while True:
        m = _token.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at, (mark, string, number, constant) = m.end(), m.groups()
        if mark in ("{", "["):
            if want not in ("value", "value or ]"):
                raise ValueError("no JSON")
            stack.append(({} if mark == "{" else [], key))
            want = "key or }" if mark == "{" else "value or ]"
            continue
        if mark in ("}", "]"):
            if want not in ("comma", f"key or {mark}", f"value or {mark}") or not stack or isinstance(stack[-1][0], dict) != (mark == "}"):
                raise ValueError("no JSON")
            value, key = stack.pop()
        elif mark == ",":
            if want != "comma" or not stack:
                raise ValueError("no JSON")
            want = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif mark == ":":
            if want != "colon":
                raise ValueError("no JSON")
            want = "value"
            continue
        elif string is not None and want in ("key", "key or }"):
            key, want = json.loads(string), "colon"
            continue
        elif want in ("value", "value or ]"):
            value = json.loads(string) if string is not None else _Number(number) if number is not None else _CONSTANTS[constant]
        else:
            raise ValueError("no JSON")
        if not stack:
            root = value
            if text[at:].strip(" \t\r\n"):
                raise ValueError("no JSON")
            return root
        if isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
        else:
            stack[-1][0].append(value)
        want = "comma"


def parse_payload(text: str | None):
    """The JSON value of a payload, encoded once or several times; None if it is no complete JSON."""
    while text is not None:  # each decoding leaves a shorter text
        try:
            value = _decoder.decode(text)
        except RecursionError:
            try:
                value = _parse_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
        if not isinstance(value, str) or isinstance(value, _Number):
            return value
        text = value
    return None


def _int(value) -> int | None:
    if isinstance(value, str):
        digits = str(value).strip()
        if re.fullmatch(r"-?\d{1,19}", digits, re.A) and -(2**63) <= int(digits) < 2**63:
            return int(digits)
    return None


def _text(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _scalar(value) -> str | None:
    return ("true" if value else "false") if isinstance(value, bool) else None if value is None else _text(str(value))


def _type(value) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Number) else "string"


def tag_items(tags) -> list[tuple[str, str]]:
    """Tags as an object, or as a list of objects with k and v, flattened, as they come."""
    todo: list[tuple[str, object]] = []
    if isinstance(tags, dict):
        todo = list(tags.items())
    elif isinstance(tags, list):
        for t in tags:
            if isinstance(t, dict) and "k" in t:
                if t["k"] is not None:
                    todo.append((_scalar(t["k"]) if not isinstance(t["k"], (dict, list)) else json.dumps(t["k"]), t.get("v")))
            elif isinstance(t, dict):
                todo += t.items()
    out, todo = [], todo[::-1]
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{key}:{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(key, v) for v in reversed(value)]
        elif (text := _scalar(value)) is not None:
            out.append((_text(key), text))
    return out


def tag_rows(tags) -> list[tuple[str, str]]:
    """The canonical form of tags: distinct pairs in order."""
    return sorted(set(tag_items(tags)))


def node_rows(nodes) -> list[tuple[int, int]]:
    """Position and ref; nulls and what is no ref keep their position and give no row."""
    if nodes is None or isinstance(nodes, bool):
        return []
    out = []
    for pos, n in enumerate(nodes if isinstance(nodes, list) else [nodes]):
        ref = _int(n.get("ref") if isinstance(n, dict) else n)
        if ref is not None:
            out.append((pos, ref))
    return out


@dataclass
class Object:
    """One occurrence of an object, and its canonical content."""

    occ: int
    parent: "Object | None"
    field: str
    ordinal: int
    kind: str | None  # of an element
    id: int | None
    tags: list[tuple[str, str]] = field(default_factory=list)
    nodes: list[tuple[int, int]] = field(default_factory=list)
    fields: list[tuple[str, int, str | None, str]] = field(default_factory=list)
    members: list["Object"] = field(default_factory=list)
    hash: str = ""


def objects_of(value) -> list[Object]:
    """Every object, parents before children, hashed bottom-up; an explicit stack, so any depth will do.

    Arrays belong to the field that holds them: what is in them is numbered by its place (a field without an array is
    place 0), and an array inside an array adds its own place to the name of the field. Below `meta` nothing is an
    element. What an element's own tags and nodes hold are its tag and node rows, no objects.
    """
    found: list[Object] = []
    todo: list[tuple[object, Object | None, str, int, bool, bool]] = [(value, None, "", 0, False, True)]
    while todo:
        v, parent, name, at, nested, counts = todo.pop()
        if isinstance(v, list):
            if nested:
                name = f"{name}[{at}]"
            if not v and parent:
                parent.fields.append((name, at, None, "empty array"))
            todo += [(v[i], parent, name, i, True, counts) for i in range(len(v) - 1, -1, -1)]
        elif not isinstance(v, dict):
            if parent:
                parent.fields.append((name, at, _scalar(v), _type(v)))
        else:
            kind = v.get("type") if counts else None
            own = _int(v.get("id")) if isinstance(kind, str) and not isinstance(kind, _Number) and kind in ELEMENT_TYPES else None
            here = Object(len(found), parent, name, at, kind if own is not None else None, own)
            found.append(here)
            if parent:
                parent.members.append(here)
            if own is not None:
                here.tags, here.nodes = tag_rows(v.get("tags")), node_rows(v.get("nodes"))
            below = []
            for k in sorted(v):
                x = v[k]
                if own is not None and k in OWN_FIELDS:
                    continue
                key = _text(k).replace("[", "\\[")
                if isinstance(x, (dict, list)):
                    below.append((x, here, key, 0, False, counts and k not in SKIPPED_BELOW))
                else:
                    here.fields.append((key, 0, _scalar(x), _type(x)))
            todo += reversed(below)
    for o in reversed(found):  # children come after their parents
        text = json.dumps([o.kind, o.id, o.tags, o.nodes, o.fields, [(m.field, m.ordinal, m.hash) for m in o.members]], separators=(",", ":"))
        o.hash = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
    return found


def elements_of(value) -> list[Object]:
    """The objects that are elements."""
    return [o for o in objects_of(value) if o.kind]


def _lists(rows: list[list[tuple] | None], struct: pa.StructType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, column by column; None is null."""
    flat = [t for r in rows if r for t in r]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else [[]] * struct.num_fields, struct)]
    offsets = np.r_[0, np.cumsum([len(r) if r else 0 for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(struct)), mask=pa.array([r is None for r in rows]))


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each occurrence; the first of an object that the task meets carries its content."""
    written: set[str] = set()
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [_lists(list(c), f.type.value_type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, _ARROW)]
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    for b in batches:
        for raw_id, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            value = parse_payload(payload)
            if value is None:
                continue
            for o in objects_of(value):
                new = o.hash not in written
                if new:
                    if len(written) >= WRITTEN:
                        written.clear()
                    written.add(o.hash)
                content = (o.tags, o.nodes, o.fields, [(m.field, m.ordinal, m.hash, m.kind, m.id) for m in o.members]) if new else (None,) * 4
                rows.append((raw_id, o.occ, o.parent.occ if o.parent else None, o.field, o.ordinal, o.hash, new, o.kind, o.id, *content))
            if len(rows) > FLUSH:
                yield out()
                rows.clear()
    if rows:
        yield out()


@dataclass
class FlatTables:
    """The related tables described at the top of this module. contents: one row per distinct object with all it holds."""

    occurrences: DataFrame
    contents: DataFrame

    @property
    def objects(self) -> DataFrame:
        return self.contents.select("object", "elem_type", "elem_id")

    def _rows(self, name: str) -> DataFrame:
        return self.contents.select("object", F.inline(name))

    @property
    def tags(self) -> DataFrame:
        return self._rows("tags")

    @property
    def nodes(self) -> DataFrame:
        return self._rows("nodes")

    @property
    def fields(self) -> DataFrame:
        return self._rows("fields")

    @property
    def members(self) -> DataFrame:
        return self._rows("members").drop("elem_type", "elem_id")


def flatten_elements(df: DataFrame, key: str, payload: str) -> FlatTables:
    """JSON texts to flat tables; the parsed rows and the distinct objects are written once.

    Elements are objects with a `type` of node, way or group and an integer `id`, wherever they sit except below
    `meta` and inside an element's own tags and nodes; all other objects are stored as well, without type and id. Null,
    empty, broken and truncated payloads give no rows; payloads encoded several times are decoded; depth is unlimited;
    a payload that came under two keys gives its occurrences twice and its objects once. Of a key that an object
    repeats the last value counts, as in JSON. Further fields of a ref in `nodes` (its place in the list, again) are
    not read.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("raw_id"), F.col(payload).alias("payload")).where("length(payload) > 0")
    flat = materialise(rows.mapInArrow(_flatten, _SCHEMA), "elements")
    once = flat.where("content").dropDuplicates(["object"]).select("object", "elem_type", "elem_id", "tags", "nodes", "fields", "members")
    return FlatTables(flat.select("raw_id", "occ", "parent_occ", "field", "ordinal", "object", "elem_type"), materialise(once, "objects"))


def children(t: FlatTables) -> DataFrame:
    """Distinct children of every element of every raw_id: tags, node refs and elements directly inside a group."""
    text = lambda c: c.cast("string")
    child = lambda kind, k, v: F.struct(F.lit(kind).alias("child"), k.alias("child_key"), v.alias("child_value"))
    direct = F.filter("members", lambda m: (F.col("elem_type") == "group") & m["field"].rlike(r"^elements(\[\d+\])*$") & m["elem_type"].isNotNull())
    all_of = F.concat(
        F.transform("tags", lambda g: child("tag", g["key"], g["value"])),
        F.transform("nodes", lambda n: child("node", text(n["pos"]), text(n["ref"]))),
        F.transform(direct, lambda m: child("element", m["elem_type"], text(m["elem_id"]))),
    )
    held = t.contents.where("elem_type IS NOT NULL").select("object", F.col("elem_type").alias("parent_type"), F.col("elem_id").alias("parent_id"), F.array_distinct(all_of).alias("all")).where(F.size("all") > 0)
    where = t.occurrences.where("elem_type IS NOT NULL").select("raw_id", "object").distinct()
    met = salted_join(where, held, "object")
    return met.select("raw_id", "parent_type", "parent_id", F.inline("all")).distinct()


def identities(t: FlatTables) -> DataFrame:
    """How often every distinct element occurs: elem_type, elem_id, object, n_occurrences, n_payloads."""
    seen = t.occurrences.where("elem_type IS NOT NULL").groupBy("object", "raw_id").agg(F.count("*").alias("n"))
    seen = seen.groupBy("object").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_payloads"))
    return seen.join(t.objects, "object").select("elem_type", "elem_id", "object", "n_occurrences", "n_payloads")


def element_counts(t: FlatTables) -> DataFrame:
    """elem_type, elem_id, n_occurrences, n_payloads over all states of an element."""
    seen = t.occurrences.where("elem_type IS NOT NULL").groupBy("object", "raw_id").agg(F.count("*").alias("n"))
    named = seen.join(t.objects, "object").groupBy("elem_type", "elem_id", "raw_id").agg(F.sum("n").alias("n"))
    return named.groupBy("elem_type", "elem_id").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_payloads"))
