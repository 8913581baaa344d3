"""What changed between consecutive full snapshots of a table.

Snapshots are kept: each is written once, range-partitioned by key with the bounds of the first one, and sorted by key
within its ranges. To compare two of them, a task opens the files of one range of both, without any shuffle; two
pointers, one on the rows of the earlier and one on those of the later snapshot, walk them once and emit typed changes.
A task holds two batches and one row, so a range never has to fit in memory. A snapshot that is delivered later is
appended and compared with its neighbours only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayweft.runtime import shared_path, ship
from wayweft.sources.shared import files_below, open_shared

#: Rows of all snapshots that one range should hold, the most ranges there may be, and keys drawn for each bound.
RANGE_ROWS, MAX_RANGES, DRAWN = 200_000, 4_096, 64
#: Rows of a batch that is read from a kept file.
BATCH_ROWS = 65_536


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Null-safe inequality by element."""
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return np.asarray(pc.or_(unequal, pc.not_equal(pc.is_null(a), pc.is_null(b))))


def _merge(keys: Sequence[str], columns: Sequence[str]):
    """The two-pointer merge over one range of two snapshots (_no 1 and 2), sorted by keys and _no."""

    def rows(source: pa.Table, at: pa.ChunkedArray, kind: str, changed: list | None = None) -> Iterator[pa.RecordBatch]:
        n = source.num_rows
        if n:
            data = [at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at]
            data += [source[k].combine_chunks() for k in keys]
            data += [pa.array([kind] * n, pa.string()), pa.array(changed if changed is not None else [None] * n, pa.list_(pa.string()))]
            yield from pa.Table.from_arrays(data, names=["_at", *keys, "change_kind", "changed_columns"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if behind is None:
                head = now.slice(0, 1)
                if head["_no"][0].as_py() > 1:
                    yield from rows(head, head["_snap"], "added")
            else:
                now = pa.concat_tables([behind, now])
            n = now.num_rows
            old, new = now.slice(0, n - 1), now.slice(1)
            if n > 1:
                apart = np.zeros(n - 1, bool)
                for k in keys:
                    apart |= _differs(old[k], new[k])
                met = ~apart & (np.asarray(new["_no"]) == np.asarray(old["_no"]) + 1)
                gone = pa.array(~met & np.asarray(pc.is_valid(old["_next"])))
                left = old.filter(gone)
                yield from rows(left, left["_next"], "removed")
                come = new.filter(pa.array(~met & (np.asarray(new["_no"]) > 1)))
                yield from rows(come, come["_snap"], "added")
                unequal = {c: _differs(old[c], new[c]) & met for c in columns}
                some = np.logical_or.reduce(list(unequal.values())) if unequal else np.zeros(n - 1, bool)
                other = new.filter(pa.array(some))
                if other.num_rows:
                    names = [[c for c in columns if unequal[c][i]] for i in np.flatnonzero(some)]
                    yield from rows(other, other["_snap"], "changed", names)
            behind = now.slice(n - 1, 1)
        if behind is not None and behind["_next"][0].as_py() is not None:
            yield from rows(behind, behind["_next"], "removed")

    return run


def _ordered(t: pa.Table, keys: Sequence[str]) -> bool:
    """Rows ascend by the keys, which differ from row to row."""
    if t.num_rows < 2:
        return True
    up, equal = np.zeros(t.num_rows - 1, bool), np.ones(t.num_rows - 1, bool)
    for k in keys:
        c = t[k].combine_chunks()
        up |= equal & np.asarray(pc.less(c[:-1], c[1:]))
        equal &= np.asarray(pc.equal(c[:-1], c[1:]))
    return bool(up.all())


def _upto(t: pa.Table, keys: Sequence[str], last: tuple) -> int:
    """How many rows have keys up to `last`."""
    below, equal = np.zeros(t.num_rows, bool), np.ones(t.num_rows, bool)
    for k, v in zip(keys, last):
        limit = pa.scalar(v, t.schema.field(k).type)
        below |= equal & np.asarray(pc.less(t[k], limit))
        equal &= np.asarray(pc.equal(t[k], limit))
    return int((below | equal).sum())


def _side_by_side(old: Iterator[pa.Table], new: Iterator[pa.Table], keys: Sequence[str]) -> Iterator[tuple[pa.Table | None, pa.Table | None]]:
    """Portions of two sorted streams in which every key that both have is in the same portion."""
    held: list[pa.Table | None] = [next(old, None), next(new, None)]
    more = [old, new]
    while held[0] is not None and held[1] is not None:
        ends = [tuple(t[k][-1].as_py() for k in keys) for t in held]
        cut = min(ends)
        out = []
        for i in (0, 1):
            n = held[i].num_rows if ends[i] == cut else _upto(held[i], keys, cut)
            out.append(held[i].slice(0, n))
            rest = held[i].slice(n)
            held[i] = rest if rest.num_rows else next(more[i], None)
        yield out[0], out[1]
    for i in (0, 1):
        while held[i] is not None:
            yield (held[i], None) if i == 0 else (None, held[i])
            held[i] = next(more[i], None)


@dataclass
class _Range(InputPartition):
    """Files of one range of two snapshots."""

    snapshot: str
    old: list[str]
    new: list[str]


class _ChangeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.pairs, self.keys, self.columns = (json.loads(options[k]) for k in ("pairs", "keys", "columns"))

    def partitions(self):
        return [_Range(*p) for p in self.pairs] or [_Range("", [], [])]

    def _tables(self, files: list[str]) -> Iterator[pa.Table]:
        import pyarrow.parquet as pq

        before: pa.Table | None = None
        for path in sorted(files):
            with open_shared(path) as f:
                for b in pq.ParquetFile(f).iter_batches(BATCH_ROWS, columns=[*self.keys, *self.columns]):
                    if b.num_rows:
                        t = pa.Table.from_batches([b])
                        if not _ordered(t if before is None else pa.concat_tables([before, t.slice(0, 1)]), self.keys) or not _ordered(t, self.keys):
                            raise ValueError(f"{path} is not sorted by key")
                        before = t.slice(t.num_rows - 1)
                        yield t

    def read(self, partition):
        if not isinstance(partition, _Range) or not partition.snapshot:
            return
        mark = lambda t, no: t.append_column("_no", pa.array(np.full(t.num_rows, no, np.int32)))

        def merged() -> Iterator[pa.RecordBatch]:
            for old, new in _side_by_side(self._tables(partition.old), self._tables(partition.new), self.keys):
                both = pa.concat_tables([mark(t, no) for t, no in ((old, 1), (new, 2)) if t is not None])
                both = both.sort_by([*[(k, "ascending") for k in self.keys], ("_no", "ascending")])
                n = both.num_rows
                both = both.append_column("_snap", pa.array([partition.snapshot] * n)).append_column("_next", pc.if_else(pc.equal(both["_no"], 1), pa.scalar(partition.snapshot), pa.scalar(None, pa.string())))
                yield from both.combine_chunks().to_batches()

        yield from _merge(self.keys, self.columns)(merged())


class KeptChanges(DataSource):
    """format("kept_snapshot_changes"): typed changes between kept snapshots, one partition for each range."""

    @classmethod
    def name(cls):
        return "kept_snapshot_changes"

    def schema(self):
        return self.options["ddl"]

    def reader(self, schema):
        return _ChangeReader(self.options)


@dataclass
class SnapshotStore:
    """Snapshots kept below a path of the shared file system. keys and columns: their names in the caller's table."""

    spark: SparkSession
    path: str
    snapshot: T.StructField
    keys: list[T.StructField]
    columns: list[str]
    bounds: list[list[tuple]]

    @property
    def _own(self) -> list[str]:
        return [f"_k{i}" for i, _ in enumerate(self.keys)]

    def snapshots(self) -> list[str]:
        """The kept snapshots in order, as texts of the snapshot's type."""
        found = {unquote(f.split("/_snap=", 1)[1].split("/", 1)[0]) for f in self._files()}
        if not found:
            return []
        kind = self.snapshot.dataType
        return [r.t for r in self.spark.createDataFrame([(t,) for t in found], "t string").orderBy(F.col("t").cast(kind)).collect()]  # one row each

    def _files(self) -> list[str]:
        return [f for f in files_below(self.path) if f.endswith(".parquet")]

    def append(self, rows: DataFrame) -> None:
        """Keeps the snapshots of rows (_snap, keys as _k0, ..., columns as _c0, ...; one row for each key)."""
        key = F.struct(*self._own)
        literal = lambda k: F.struct(*[F.lit(v).cast(f.dataType).alias(o) for v, f, o in zip(k, self.keys, self._own)])
        place = F.lit(0)
        if self.bounds:  # two levels, so a key is compared with few of them
            coarse = F.array(*[literal(block[0]) for block in self.bounds])
            fine = F.array(*[F.array(*[literal(k) for k in block]) for block in self.bounds])
            at = F.size(F.filter(coarse, lambda b: b <= key))
            within = F.size(F.filter(F.get(fine, F.greatest(at - 1, F.lit(0))), lambda b: b <= key))
            place = F.when(at == 0, 0).otherwise((at - 1) * len(self.bounds[0]) + within)
        ranged = rows.withColumn("_range", place).withColumn("_snap", F.col("_snap").cast("string"))
        ranged.repartition("_range").sortWithinPartitions("_snap", "_range", *self._own).write.mode("append").partitionBy("_snap", "_range").parquet(self.path)

    def changes(self, only: Sequence[str] | None = None) -> DataFrame:
        """Changes of each kept snapshot (or of those in `only`) against the one before it."""
        names = [f"_c{i}" for i, _ in enumerate(self.columns)]
        by_place: dict[tuple[str, str], list[str]] = {}
        for f in self._files():
            snap, place = f.split("/_snap=", 1)[1].split("/")[:2]
            by_place.setdefault((unquote(snap), place), []).append(f)
        order = self.snapshots()
        places = sorted({p for _, p in by_place})
        pairs = [(new, by_place.get((old, p), []), by_place.get((new, p), [])) for old, new in zip(order, order[1:]) if only is None or new in only for p in places]
        inner = T.StructType([T.StructField("_at", T.StringType()), *[T.StructField(o, f.dataType) for o, f in zip(self._own, self.keys)], T.StructField("change_kind", T.StringType()), T.StructField("changed_columns", T.ArrayType(T.StringType()))])
        self.spark.dataSource.register(KeptChanges)
        found = self.spark.read.format("kept_snapshot_changes").options(pairs=json.dumps([p for p in pairs if p[1] or p[2]]), keys=json.dumps(self._own), columns=json.dumps(names), ddl=inner.toDDL()).load()
        plain = dict(zip(names, self.columns))
        renamed = F.transform("changed_columns", lambda c: F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])[c]) if plain else F.col("changed_columns")
        return found.select(F.col("_at").cast(self.snapshot.dataType).alias(self.snapshot.name), *[F.col(o).alias(f.name) for o, f in zip(self._own, self.keys)], "change_kind", renamed.alias("changed_columns"))


def _latest(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, compare: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """All rows that belong to a snapshot, and of each snapshot and key the one that counts."""
    names = [f"_c{i}" for i, _ in enumerate(compare)]
    own = [f"_k{i}" for i, _ in enumerate(keys)]
    rows = df.select(F.col(snapshot).alias("_snap"), *[F.col(k).alias(o) for o, k in zip(own, keys)], F.col(delivered).alias("_at"), *[c.alias(n) for n, c in zip(names, compare.values())])
    for k in ("_snap", *own):
        rows = rows.where(F.col(k).isNotNull())
    latest = rows.groupBy("_snap", *own).agg(F.max(F.struct("_at", *names)).alias("_m"))
    return rows, latest.select("_snap", *own, *[F.col(f"_m.{n}").alias(n) for n in names])


def keep_snapshots(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, compare: Mapping[str, Column], path: str | None = None) -> SnapshotStore:
    """Keeps the snapshots of df below path (a folder of the shared file system, by default a temporary one).

    Bounds of the ranges are drawn from the keys by their hash, at most MAX_RANGES of them.
    """
    spark = df.sparkSession
    ship(spark)
    rows, latest = _latest(df, keys, snapshot, delivered, compare)
    own = [f"_k{i}" for i, _ in enumerate(keys)]
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_ROWS)))
    bounds: list[list[tuple]] = []
    if ranges > 1:
        share = min(1.0, ranges * DRAWN / n)
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(5), *own), F.lit(1 << 30)) <= int(share * (1 << 30))).select(*own).distinct().limit(4 * ranges * DRAWN)
        found = sorted(tuple(r) for r in drawn.collect())  # at most 4 * MAX_RANGES * DRAWN keys
        cuts = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
        size = max(1, math.isqrt(len(cuts)))
        bounds = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    store = SnapshotStore(spark, path or shared_path(spark, "snapshots"), df.schema[snapshot], [df.schema[k] for k in keys], list(compare), bounds)
    store.append(latest)
    return store


def append_snapshots(store: SnapshotStore, df: DataFrame, delivered: str, compare: Mapping[str, Column]) -> DataFrame:
    """Keeps further snapshots in their ranges and returns the changes that touch them.

    Only the new snapshots and their neighbours are read. A snapshot that is kept already is an error.
    """
    before = set(store.snapshots())
    _, latest = _latest(df, [f.name for f in store.keys], store.snapshot.name, delivered, compare)
    fresh = {r.s for r in latest.select(F.col("_snap").cast("string").alias("s")).distinct().collect()}  # one row each
    if fresh & before:
        raise ValueError(f"kept already: {', '.join(sorted(fresh & before))}")
    store.append(latest)
    order = store.snapshots()
    touched = [s for i, s in enumerate(order) if i and (s in fresh or order[i - 1] in fresh)]
    return store.changes(touched)


def snapshot_changes(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, compare: Mapping[str, Column], path: str | None = None) -> DataFrame:
    """Added, removed and changed keys between each snapshot and the one before it that occurs in df.

    compare maps a column name to the canonical form to be compared (equal form = equal value).
    Result: snapshot, the keys, change_kind ('added', 'removed', 'changed'), changed_columns (null unless changed).
    A key in the first snapshot is no addition. Defined cases: of several rows of one snapshot and key the one with
    the latest `delivered` counts (a null one counts least; on a tie the greatest canonical values), repeated rows
    count once, rows whose snapshot or a key is null are no records of any snapshot, null equals null when compared,
    an empty table gives an empty result; other columns of df are ignored, whatever their names.
    """
    return keep_snapshots(df, keys, snapshot, delivered, compare, path).changes()


#: White space around a value, by Unicode, and the four separators that some writers also strip.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def canonical_tags(tags: Column) -> Column:
    """array<struct<k,v>> as a text that is equal for equal sets of key and trimmed value; null and no tags are ''."""
    pairs = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.to_json(F.array(t["k"], F.regexp_replace(t["v"], _EDGE, ""))))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(pairs)), ","), F.lit(""))


def tag_changes(snapshots: DataFrame) -> DataFrame:
    """way_snapshots: snap_date (yyyy-MM-dd), id, change_kind."""
    found = snapshot_changes(snapshots, ["id"], "snap_date", "loaded_at", {"tags": canonical_tags(F.col("tags"))})
    return found.select(F.date_format("snap_date", "yyyy-MM-dd").alias("snap_date"), "id", "change_kind")
