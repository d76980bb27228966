"""What the corpus operators share: table access, shared folders, let-binding."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Root of the installed package; workers get it on their import path.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; readable through any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_workers(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Bound the rows and bytes of the Arrow batches that Python workers get, and put this source on their path.

    Very long documents make a batch of Spark's default 10,000 rows too large
    for a worker. Plans are made when the caller runs them, so the bounds stay
    set in the session; a smaller number of rows is left as it is. On machines
    without this source at the driver's path, install the package or name it in
    --py-files.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    at = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(at)) <= rows:
        spark.conf.set(at, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what spark.checkpoint.dir names. Only a local session without that
    setting gets a temporary folder; a cluster without it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-plinth-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/plinth-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system and path objects, for small driver-side steps."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Memory(dict):
    """A bounded memory of make(key): the newest keys, and of those before them what was asked for again.

    `budget` bounds the bytes of either half, as weigh() estimates them. Keys of
    more than KEY_CHARS characters are made anew each time: they rarely return.
    """

    KEY_CHARS = 64
    #: Bytes of an entry besides its characters: table slots, headers of the objects.
    ENTRY = 260

    def __init__(self, budget: int) -> None:
        self.budget, self.weight, self.old = budget, 0, {}

    def make(self, key: str):
        raise NotImplementedError

    def weigh(self, value) -> int:
        """Bytes of a value beyond ENTRY."""
        return 0

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.KEY_CHARS:
                return value
        self.weight += self.ENTRY + len(key) + self.weigh(value)
        if self.weight > self.budget:
            self.old = dict(self)
            self.clear()
            self.weight = 0
        self[key] = value
        return value


_HELD: dict = {}


def held(owner: str, key: object, make: Callable[[], object]):
    """make() for key, kept in this Python worker until another operator asks.

    Workers are reused by all stages of an application, so memories that every
    operator kept for good would add up.
    """
    if _HELD.get("owner") != owner:
        _HELD.clear()
        _HELD["owner"] = owner
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]
