"""Shared scratch tables, used to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a temporary one, in local mode only."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_llm_scratch", None)
    if own is None:
        own = spark.sparkContext._llm_scratch = tempfile.mkdtemp(prefix="llm-scratch-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below :func:`root` and read it back: a checkpoint with a schema and statistics."""
    return Scratch(df.sparkSession).settle(df, name)


#: The paths that were written since each open scope began.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At its end all scratch tables that were written inside go, but for those that are put into the list it gives."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        made, stay = _scopes.pop(), {t._scratch for t in kept}
        for path in made:
            if path not in stay:
                _delete(spark, path)
        if _scopes:
            _scopes[-1].extend(stay)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now rather than at some later GC."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows that are handed to Python at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on Arrow batches: their buffers lie outside the heap, twice for each task, and grow by doubling."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(key)).rstrip("b") or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """The scratch tables of one operator call. What only later steps of the same call read is dropped by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)

    def settle(self, df: DataFrame, name: str, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
        """Write and read back. With a bound on its rows, a table has no more files than they need: small ones aren't spread over
        as many files as there are shuffle partitions, each of which costs the file system several calls."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_file)))
        path = f"{root(self.spark)}/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    @staticmethod
    def union(tables: list[DataFrame]) -> DataFrame:
        """All rows of tables of one schema, read as one."""
        first = tables[0]
        return first.sparkSession.read.schema(first.schema).parquet(*(t._scratch for t in tables))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no unfinished DataFrame reads any more, and shuffle files of finished jobs."""
        for table in tables:
            _delete(self.spark, table._scratch)
        release(self.spark)


#: Bits for each key of the filter that is read before a semi join, and the most bits that are broadcast (16 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 27
_BUCKET = 1 << 15


def split(wide: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``wide`` whose key may be among ``keys``, rows whose key surely isn't), without a shuffle of ``wide``.

    A bit filter, sized by the number of keys, is built by map-side bitmaps and broadcast. A row goes to the first part if its key's bit is
    set: all wanted keys and a sixteenth of the others. With more keys than MOST_BITS / BITS_PER_KEY a filter would be too large to
    broadcast; then all rows are in the first part, and the join that follows reads them all.
    """
    size = max(_BUCKET, 1 << (BITS_PER_KEY * max(keys.count(), 1) - 1).bit_length())
    if size > MOST_BITS:
        return wide, wide.where("false")
    place = F.pmod(F.xxhash64(on), F.lit(size))
    bucket, bit = F.floor(place / _BUCKET).cast("int"), F.pmod(place, F.lit(_BUCKET))
    bits = keys.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = wide.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1"), F.lit(False))
    marked = marked.withColumn("_byte", byte)
    return marked.where(hit).select(wide.columns), marked.where(~hit).select(wide.columns)


#: A key with more than a share of 1/HOT of the rows is met by a broadcast; fewer than HOT keys can be so frequent.
HOT = 2000


def spread_join(rows: DataFrame, one: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a settled table that has each key once and knows how many rows have it, in column ``count`` (not kept).

    Frequent keys never meet in one task: their few rows of ``one`` are broadcast, and only the other keys are shuffled. how: inner or left.
    """
    keys = [key] if isinstance(key, str) else key
    limit = F.lit(total // HOT)
    hot = F.broadcast(one.where(F.col(count) > limit).drop(count))
    met = rows.join(hot, keys)
    rest = rows.join(F.broadcast(one.where(F.col(count) > limit).select(keys)), keys, "left_anti")
    return met.unionByName(rest.join(one.where(F.col(count) <= limit).drop(count), keys, how))


def semi_join(wide: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``wide`` whose key is among ``keys``; of the others, few are shuffled.

    The joins here are an inner and an outer one: semi and anti joins would be moved below the filter that is to come first.
    """
    return split(wide, keys, on)[0].join(keys.select(on).distinct(), on).select(wide.columns)


def anti_join(wide: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``wide`` whose key isn't among ``keys``; of these, few are shuffled."""
    maybe, surely_not = split(wide, keys.where(F.col(on).isNotNull()), on)
    marked = maybe.join(keys.select(on).distinct().withColumn("_there", F.lit(True)), on, "left")
    return surely_not.unionByName(marked.where("_there is null").select(wide.columns))
