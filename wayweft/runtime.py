"""Session-level helpers: table access, lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame is broadcast only when counting shows at most this many (narrow) rows.
BROADCAST_ROWS = 50_000

_written: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wayweft-code-"), "wayweft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("wayweft", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a single file or a folder of part files."""
    return spark.read.parquet(table_path(sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. The session names it in spark.checkpoint.dir.

    Only a plain local session without that setting gets a temporary folder; a cluster without it is an error,
    since a machine-local folder would not be readable by the other executors.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="wayweft-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _forget() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already
            pass
    _written.clear()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, path: str) -> str:
    """What a file or folder is now: size, number of files and time of change, from one call to its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = system.getContentSummary(place)
    return f"{path}:{whole.getLength()}:{whole.getFileCount()}:{system.getFileStatus(place).getModificationTime()}"


_kept: dict[tuple[str, ...], object] = {}


def once(spark: SparkSession, what: str, paths: Sequence[str], build: Callable[[], object]) -> object:
    """What build() returns, built once per application and state of the given inputs; for steps that several queries share."""
    key = (spark.sparkContext.applicationId, what, *[signature(spark, p) for p in paths])
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def _folders(df: DataFrame) -> list[str]:
    """Folders of a frame that materialise() or together() returned."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def together(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of frames of one schema that materialise() returned, as one scan: their number doesn't show in a plan."""
    if len(frames) == 1:
        return frames[0]
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[p for df in frames for p in _folders(df)])


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that materialise() returned and that nothing reads any more."""
    spark = df.sparkSession
    for name in _folders(df):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def trim(spark: SparkSession) -> str | None:
    """Has malloc give what the driver's JVM has freed outside its heap back to the system; what the JVM says of it, or
    None if it doesn't know the command (it came with JDK 17.0.9 and 21, on Linux)."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, args = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by reflection on the interface; py4j may not call the server's own class, and finds no method for nulls
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def settle(spark: SparkSession) -> None:
    """Between the steps of a long job: broadcasts and shuffle files of finished steps go, and the driver's heap shrinks
    back. Spark deletes them only when the driver collects its garbage, which is rare while there is heap to grow into.
    What the JVM's compiler and class loader have freed goes back to the system too, which malloc would keep."""
    gc.collect()  # frames of Python hold plans of the JVM
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast after counting that it is small; otherwise leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(counts: DataFrame, keys: Sequence[str], weight: str, share: int) -> DataFrame:
    """Keys that hold at least 1/share of the total weight: never more than `share` rows, whatever the input.

    counts has one row for each combination of keys (and possibly finer ones); weight is summed.
    """
    total = counts.agg(F.sum(weight)).scalar()  # one number, not a join
    per_key = counts.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    return per_key.where(F.col("_w") * share >= total).select(*keys)


def month_index(ts: Column) -> Column:
    """Months since year 0 of a timestamp or date, as int."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_text(index: Column) -> Column:
    """yyyy-MM of month_index."""
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))
