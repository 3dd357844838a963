"""What the training-data operators share: reading, checkpoints, scratch tables and spare column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 200_000  # rows of a key from which it is joined by a broadcast
BROADCAST_ROWS = 300_000  # keys, of 16 bytes each, up to which a counted list is broadcast; a longer one is shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what the session's checkpoint folder was set to.

    Where neither is set, a session in one JVM (tests) gets a temporary folder; on a cluster it is an error,
    as a folder of one machine would lose its files there.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new place in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(frame: DataFrame) -> None:
    """Deletes the files of a frame that ``written`` has made and that nothing reads any more."""
    spark = frame.sparkSession
    own = shared_folder(spark)
    for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(own).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Gives a function that writes a frame like ``written``; what it wrote is deleted at the end of the block."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str = "scratch") -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    try:
        yield keep
    finally:
        for frame in made:
            removed(frame)


def by_value(spark: SparkSession, thing):
    """``thing`` as a broadcast of bytes that carry its classes too, so that executors need no copy of this folder."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def unpacked(shared):
    """What ``by_value`` has sent; made once in each worker."""
    if not hasattr(shared, "made"):
        shared.made = cloudpickle.loads(shared.value)
    return shared.made


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python 1,000 rows or 4 MB at a time, whichever is less.

    The defaults of 10,000 rows and 64 MB let a few workers with long texts outgrow an executor. The two
    settings are the session's and stay so; settings that somebody has changed are left alone.
    """
    conf = df.sparkSession.conf
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4m")):
        if conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            conf.set(f"spark.sql.execution.arrow.{key}", value)
    return df


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which its worker gives back what it has freed.

    A worker outlives its task. What the C library and Arrow keep for later would stand in the executor's
    memory beside the tasks of other stages, which may have no use for it.
    """

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return task


def listed(keys: DataFrame) -> DataFrame:
    """``keys`` with a hint to broadcast them if there are at most ``BROADCAST_ROWS``; longer lists are joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def looked_up(rows: DataFrame, keyed: DataFrame, on: str, many: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each key, is settled, and says in ``many`` how many rows have it.

    Keys of ``HOT`` rows or more would meet in one task; there are at most all rows / ``HOT`` of them, so they
    are broadcast. All other keys are joined by a shuffle.
    """
    hot, rest = keyed.where(F.col(many) >= HOT).drop(many), keyed.where(F.col(many) < HOT).drop(many)
    if hot.isEmpty():
        return rows.join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text leaves 1 modulo 3. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
