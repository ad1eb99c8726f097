"""Tables in shared folders: intermediate ones, and versioned ones that turn together."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that a dealt table has at most.
BUCKETS = 64
#: Bytes of a table, at most, that spread() deals anew, and of a task that is worth it.
SPREAD, TASK = 256 << 20, 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_unset: dict[str, str] = {}
_lock = threading.Lock()
_writing: dict[str, tuple[int, str | None]] = {}


def scratch(spark: SparkSession, name: str = "quern") -> str:
    """A new folder below the shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a local session gets a folder of its own; a cluster's would be on one machine only: an error.
    """
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _unset.get(app) or _unset.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quern-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage", codec: str = "zstd", layout: dict[str, str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path, app = f"{scratch(spark)}/{name}", spark.sparkContext.applicationId
    with _lock:  # the table stands for its shuffles: their files may go with the write; of writes at once the last unsets it
        many, before = _writing.get(app, (0, spark.conf.get(CLEANUP, None)))
        _writing[app] = (many + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).options(**(layout or {})).parquet(path)
    finally:
        with _lock:
            many, before = _writing.pop(app)
            if many > 1:
                _writing[app] = (many - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt evenly to the cores where it is small and lies in fewer files than there are cores.

    A file with one row group is one task however many cores there are. A table of over SPREAD bytes, or of as many files
    as cores, stays as it is: its files are its tasks, and nothing is shuffled.
    """
    files, size = len(df._jdf.inputFiles()), int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, size // TASK)
    return df.repartition(tasks) if files < tasks and size <= SPREAD else df


def numbered(df: DataFrame, order: list[Column | str], name: str, by: str | None = None) -> DataFrame:
    """df with each row's place from 1 in the order, by groups of a column if one is named.

    One range-partitioned sort: a row's place is its place in its partition and the rows before that partition, counts
    that are one number a partition and group. No partition is sorted in one task because it is a whole group.
    """
    spark = df.sparkSession
    first = [F.col(by)] if by else []
    at = staged(df.orderBy(*first, *order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    cols = [part.alias("__part"), *([F.col(by).alias("__by")] if by else [])]
    counts = sorted(at.groupBy(*cols).agg(F.count("*").alias("c"), F.min("__at").alias("__first")).collect(), key=lambda r: r["__first"])
    rows, before, group = [], 0, object()
    for r in counts:
        if by and r["__by"] != group:
            before, group = 0, r["__by"]
        rows.append((r["__part"], *((r["__by"],) if by else ()), r["__first"], before))
        before += r["c"]
    kind = f"__part long{', __by ' + df.schema[by].dataType.simpleString() if by else ''}, __first long, __before long"
    told = F.broadcast(spark.createDataFrame(rows, kind))
    on = (part == F.col("__part")) & (F.col(by).eqNullSafe(F.col("__by")) if by else F.lit(True))
    return at.join(told, on).withColumn(name, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int")).select(*df.columns, name)


# -------------------------------------------------------------------------------- versions


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":  # without checksum files, which edits by other programs would make wrong
        fs = fs.getRawFileSystem()
    return fs, at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def listed(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Writes a new small file whole or not at all; False where another was first."""
    fs, at = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/.{at.getName()}-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(data))
    out.close()
    won = not fs.exists(at) and bool(fs.rename(tmp, at))
    if not won:
        fs.delete(tmp, False)
    return won


def replace(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file's new content, put in place by one rename over the old one."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    if not create(spark, tmp, data):
        raise OSError(f"could not write {tmp}")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    jvm.java.lang.reflect.Array.set(options, 0, jvm.java.lang.Enum.valueOf(kind, "OVERWRITE"))
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, path)[0].getUri(), conf).rename(at(tmp), at(path), options)


def read_small(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def writable(spark: SparkSession, path: str) -> bool:
    """Whether a file can be made in the folder."""
    probe = f"{path.rstrip('/')}/.probe-{uuid.uuid4().hex}"
    try:
        made = create(spark, probe, b"")
        delete(spark, probe)
    except Py4JJavaError:
        return False
    return made


class Store:
    """Tables that are made of parts, under manifests `manifest-N.json` that name the parts of all tables.

    A change writes its parts first and then the next manifest, by one rename: readers and failures see all of a change
    or nothing of it, and of two writers the later one fails. An append adds a part, so that it costs what it adds. A dealt
    table has a part a bucket of a column's hashes, so that a change of some keys writes their buckets alone.
    """

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, dict[str, str]] | None = None, dealt: dict[str, str] | None = None):
        """layouts: by table, options of Parquet's writer; dealt: by table, the column whose hashes deal it."""
        self.spark, self.root, self.layouts, self.dealt = spark, root.rstrip("/"), layouts or {}, dealt or {}

    def version(self) -> int:
        return max((int(n[9:-5]) for n in listed(self.spark, self.root) if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self) -> dict[str, list[str]]:
        n = self.version()
        return json.loads(read_small(self.spark, f"{self.root}/manifest-{n}.json")) if n else {}

    def has(self, name: str) -> bool:
        return name in self.manifest()

    def table(self, name: str) -> DataFrame:
        return self._read(self.manifest()[name])

    def _read(self, parts: list[str]) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in parts]
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def commit(self, put: dict[str, DataFrame] | None = None, add: dict[str, DataFrame] | None = None, fold_at: int = 64, patch: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> int:
        """Replaces the tables of put, appends to those of add and changes those of patch, together.

        A table of fold_at parts becomes one again when it is appended to. patch, for dealt tables, has the new rows and
        the keys whose old rows go (one column, the table's): the buckets of these keys are written, the others stay.
        """
        before, n = self.manifest(), self.version() + 1
        after = dict(before)
        for name, df in (put or {}).items():
            after[name] = self._deal(name, n, df, []) if name in self.dealt else [self._part(name, n, df)]
        for name, df in (add or {}).items():
            old = before.get(name, [])
            if len(old) >= fold_at:
                after[name] = [self._part(name, n, self._read(old).unionByName(df))]
            else:
                after[name] = [*old, self._part(name, n, df)]
        for name, (rows, keys) in (patch or {}).items():
            old, col = before.get(name, []), self.dealt[name]
            touched = {f"__bucket={r[0]}" for r in keys.select(self._bucket(col)).distinct().collect()}  # BUCKETS numbers at most
            mine = [p for p in old if p.rsplit("/", 1)[-1] in touched or "/__bucket=" not in p]
            if touched:
                all_ = self._read(mine).join(keys.select(col), col, "left_anti").unionByName(rows) if mine else rows
                after[name] = self._deal(name, n, all_, [p for p in old if p not in mine])
        if not create(self.spark, f"{self.root}/manifest-{n}.json", json.dumps(after).encode()):
            raise RuntimeError(f"another writer made version {n} of {self.root}")
        return n

    def _part(self, name: str, n: int, df: DataFrame) -> str:
        part = f"{name}/v={n}-{uuid.uuid4().hex[:8]}"
        df.write.options(**self.layouts.get(name, {})).parquet(f"{self.root}/{part}")
        return part

    @staticmethod
    def _bucket(col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int").alias("__bucket")

    def _deal(self, name: str, n: int, df: DataFrame, rest: list[str]) -> list[str]:
        """rest and the new parts of df, one a bucket; of a table without rows one empty part, which has its columns."""
        part = f"{name}/v={n}-{uuid.uuid4().hex[:8]}"
        by_bucket = df.withColumn("__bucket", self._bucket(self.dealt[name])).hint("rebalance", "__bucket")
        by_bucket.write.options(**self.layouts.get(name, {})).partitionBy("__bucket").parquet(f"{self.root}/{part}")
        made = [f"{part}/{x}" for x in listed(self.spark, f"{self.root}/{part}") if x.startswith("__bucket=")]
        return rest + sorted(made) or [self._part(name, n, self.spark.createDataFrame([], df.schema))]
