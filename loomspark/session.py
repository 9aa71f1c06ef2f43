"""Session-level helpers: table access, shared scratch tables and lineage cuts.

Intermediate results are written to the folder the session names in ``spark.checkpoint.dir``, which every
executor shares, so that a lost executor only costs the recomputation of its own tasks.  A folder of our own
is used only where the setting is absent (unit tests, a laptop).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
_shipped: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return "file://" + _own_root


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the session's executors, which may not find it on their path; once per application."""
    global _shipped
    if _shipped == spark.sparkContext.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="loomspark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(folder, f"loomspark-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped = spark.sparkContext.applicationId


class Scratch:
    """A set of Parquet tables in the shared folder.  Results read them lazily, so they stay until ``drop``, or until the application ends."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not Scratch._open:
            atexit.register(Scratch.drop_all)  # runs before the session's own exit, which was registered earlier
        Scratch._open.append(self)

    @classmethod
    def drop_all(cls) -> None:
        """Remove every table of this application from the shared folder."""
        for scratch in cls._open:
            try:
                scratch.drop()
            except Exception:  # noqa: BLE001 - the session is gone already
                break
        cls._open.clear()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the result has no lineage beyond the files."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
        """``keep``, and the aggregates ``counts`` observed while writing: no second job."""
        seen = Observation()
        kept = self.keep(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
        return kept, seen.get

    def drop(self, name: str = "") -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over as many partitions as there are cores if it has fewer: for work that costs far more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fenced(df: DataFrame) -> DataFrame:
    """``df`` behind a fence for filters: one on a column that took a long chain of expressions would else be pushed down, the chain inlined into it and computed twice."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).filter("_fence >= 0").drop("_fence")


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).select(F.lit(1)).collect()


def salted_lookup(rows: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with one-row-per-key ``small`` that survives a key holding a third of all rows.

    Each small row is repeated ``salts`` times and the large side picks its copy by a hash of ``spread_by``, so
    a hot key is met in ``salts`` tasks instead of one.  No side is assumed to fit in memory.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")
