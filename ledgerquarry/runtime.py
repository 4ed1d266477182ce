"""Session helpers: table loading, lineage cuts, size-checked broadcasts and joins that stand hot keys."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to remove the shuffle files of a query at its end, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


_shipped: set[str] = set()
_cut_apps: set[str] = set()
_own_dirs: dict[str, str] = {}
_serial = itertools.count(1)


def ship_package(spark: SparkSession) -> None:
    """Let Spark's workers import this package, wherever the driver was started: once per application, the driver's
    file server hands its sources to every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quarry-package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, whose executor is the driver, may go without: it gets a temporary folder, removed at exit. On a
    cluster a missing setting is an error, since a machine's own disk would be lost with the machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, folder, True)
        _own_dirs[sc.applicationId] = folder
    return _own_dirs[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` is written to a table in the shared folder and read back.

    The table survives the loss of executors, is columnar, so later steps read only the columns they need, and gives
    Catalyst its true size. What was shuffled for it is removed once it is written. Column names must differ without
    regard to case. The tables of an application are removed by ``drop_cut``, ``drop_cuts`` or when Python ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/quarry-{app}"
    if app not in _cut_apps:
        _cut_apps.add(app)
        atexit.register(_drop, spark, folder)
    path = f"{folder}/{next(_serial):06d}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*cuts: DataFrame) -> None:
    """Remove the tables of ``cuts`` that no later frame reads: their disk is free for the next steps."""
    for df in cuts:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _drop(df.sparkSession, file)


def drop_cuts(spark: SparkSession) -> None:
    """Remove every table ``cut`` wrote in this application; frames that read them are void afterwards."""
    _drop(spark, f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}")


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; a folder of the file system can still be removed
        if folder.startswith(("/", "file:")):
            shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)


#: A key with more than a thousandth of all rows is hot. So there are under a thousand hot keys, whatever the data.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The hot keys of ``counts`` (keys, n), which has one row per key: at most ``HOT_SHARE`` rows, so they may be
    broadcast. ``counts`` is read twice and should be written."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).collect()[0][0]
    return counts.where(F.col(n) * HOT_SHARE >= F.lit(max(total, HOT_SHARE))).select(*keys)


def join_spread(rows: DataFrame, entries: DataFrame, keys: list[str], hot: DataFrame, spread: Column, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``entries`` (one row per key) in which the rows of a hot key are spread over ``salts``
    partitions by ``spread``, and its entry is repeated for each. One shuffle of either side; null keys join nothing."""
    marked = F.broadcast(hot.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot")))
    meets = lambda d: [d[k] == F.col(f"__h{i}") for i, k in enumerate(keys)]
    drop = [f"__h{i}" for i in range(len(keys))]
    left = rows.join(marked, meets(rows), "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__hot", *drop)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = entries.join(marked, meets(entries), "left").withColumn("__salt", F.explode(every)).drop("__hot", *drop)
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark for broadcast only while the estimated size is proven under ``limit``; a shuffled join otherwise."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a reference list whose size has a bound; raises instead of flooding the driver."""
    ship_package(df.sparkSession)
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is expected to be a small reference list")
    return rows


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``'s, compared as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)))
