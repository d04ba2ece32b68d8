"""What the operators share: input columns, the shared folder, row names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator works on; whatever else the table holds cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset, one under the warehouse."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    return (name or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages").rstrip("/")


#: Rows of a key in one part; buckets of keys whose greatest number of parts is shipped.
PART, PART_BUCKETS = 256, 1 << 16
#: Bytes of the stored tables read for which a table settled in few files may have one more file, and files it may have for each core anyway.
FILE_BYTES, FILES_A_CORE = 4 << 20, 2
#: Tables that this process has settled and not released, oldest first.
_settled: list[str] = []
#: The path of each settled table that is still in use.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def files(df: DataFrame) -> int:
    """How many files a result is worth: two a core, or one for each ``FILE_BYTES`` of the tables that it reads, if that is more."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-stored // FILE_BYTES))


def settle(df: DataFrame, what: str, few: bool = False) -> DataFrame:
    """Writes an intermediate result as Parquet to the shared folder and reads it again, so that its lineage ends there.

    A lost executor loses nothing of it, and each use reads it instead of computing it again. The tables stay until
    they are released, as a result may still be read from them. With ``few`` the last tasks take several partitions
    each where there are more of them than ``files``: on Hadoop's local file system each file starts some six processes.
    """
    path = f"{shared_dir(df.sparkSession)}/tidelog/{what}-{uuid.uuid4().hex}"
    _settled.append(path)
    if few and (n := files(df)) < 1 << 31:
        df = df.coalesce(n)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def settled() -> int:
    """How many tables wait to be released: a mark for ``release``."""
    return len(_settled)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables settled since a mark, but for the newest ``keep``. For when no result is read from them any more."""
    _delete(spark, _settled[since : len(_settled) - keep])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _settled.remove(path)


def drop(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again, as all that comes of them is settled itself."""
    for df in tables:
        if (path := _paths.pop(df, None)) in _settled:
            _delete(df.sparkSession, [path])


@contextmanager
def settling(spark: SparkSession, always: bool = True) -> Iterator[None]:
    """Releases what is settled inside: at the end (for when the results have been written by then), or with ``always`` false only after a failure."""
    mark = settled()
    try:
        yield
    except BaseException:
        release(spark, mark)
        raise
    if always:
        release(spark, mark)


def within(rows: DataFrame, wanted: DataFrame, key: Column, bits: int) -> DataFrame:
    """Adds ``flag``: false only for rows whose 64-bit ``key`` is not one of ``wanted``'s. A bitmap of fixed size (a bit for each of ``bits``), by broadcast, keeps the others out of the shuffle that follows."""
    place = F.pmod(key, F.lit(bits))
    parts = wanted.select(F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))
    return rows.join(F.broadcast(parts), F.bitmap_bucket_number(place) == F.col("_part"), "left").select(*rows.columns, flag.alias("flag"))


def parts_of(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """How many parts rows of frequent keys are dealt to where they meet a table of keys: for buckets of keys (at most ``PART_BUCKETS`` rows), from each key and its number of rows."""
    return counts.where(F.col(n) > PART).groupBy(_bucket_of(keys).alias("_bucket")).agg(F.max(F.ceil(F.col(n) / PART)).alias("parts"))


def _bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PART_BUCKETS)).cast("int")


def join_dealt(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, parts: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows with a table of one row a key. Rows of a frequent key are dealt to parts by ``spread``, and each part gets its own copy of the key's row; both sides read the number of parts from the same small table."""
    few = F.broadcast(parts)
    dealt = lambda df: df.withColumn("_bucket", _bucket_of(keys)).join(few, "_bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).drop("_bucket")
    many = dealt(rows).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("parts"))).drop("parts")
    copied = dealt(keyed).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return many.join(copied, [*keys, "_part"], how).drop("_part")


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
