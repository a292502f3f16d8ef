"""Helpers shared by the text operators: table paths, shared storage, Arrow views.

Nothing here keeps state on the driver or on an executor's own disk.  Whatever has
to outlive a stage goes to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import IntegralType

#: Rows whose checksum leaves this remainder are never learnt from.
FOLDS, HELD_OUT_FOLD = 5, 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  On a cluster its absence is an error: tables would
    land on the disk of whichever machine writes them.  In local mode, where one machine is
    all there is, a temporary folder is made and set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="pursebook-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of at least HOT_ROWS rows, and of over one row in HOT_KEYS, are dealt into SALTS parts;
#: whatever the input, so are keys of over PART_ROWS rows, and into one more part for so many.
HOT_KEYS, HOT_ROWS, SALTS, PART_ROWS = 1000, 1000, 200, 1 << 20


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, count: str, how: str = "inner", total: int | None = None, merge: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and counts the rows
    of a key in ``count``; ``total`` is a number of rows, if the caller has it.

    Few keys can have more than one row in HOT_KEYS; those are dealt by a hash of ``spread``
    over partitions, with a copy of the table's row in each, so that no key weighs
    down a task: at least SALTS, and as many as PART_ROWS asks for.  Only the names of those
    keys are broadcast: total / PART_ROWS at most or HOT_KEYS, whichever is more, or without
    ``total`` the HOT_KEYS largest.  ``merge``: both sides grow with the corpus, so Spark is
    told not to broadcast a table that happens to be small today."""
    hot = table.where(F.col(count) >= max(HOT_ROWS, min((total or 0) // HOT_KEYS, PART_ROWS)))
    hot = hot if total is not None else hot.orderBy(F.desc(count), key).limit(HOT_KEYS)
    hot = hot.select(F.col(key).alias("_hot"), F.greatest(F.lit(SALTS), F.ceil(F.col(count) / PART_ROWS)).cast("long").alias("_parts"))
    mark = lambda df: df.join(F.broadcast(hot), df[key] == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_parts"))).otherwise(0)
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    left = mark(rows).withColumn("_salt", salt).drop("_hot", "_parts")
    right = mark(table).withColumn("_salt", F.explode(salts)).drop("_hot", "_parts")
    return left.join(right.hint("merge") if merge else right, [key, "_salt"], how).drop("_salt")


#: Bits of the filter below for each key, its least and its greatest size: 8 MiB and 128 MiB.
KEY_BITS, FILTER_BITS, MOST_BITS = 16, 1 << 26, 1 << 30


def may_hold(rows: DataFrame, keys: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``; none of the others
    is lost.  A bitmap of hashed keys is broadcast.  Its size follows from ``total``, the number
    of keys; where MOST_BITS are too few for them, rows and keys are joined by ``key`` instead."""
    bits = FILTER_BITS
    while bits < KEY_BITS * (total or 0):
        bits *= 2
    if bits > MOST_BITS:
        return rows.join(keys.select(key).distinct(), key, "left_semi").select(*rows.columns)
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    table = keys.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    marked = rows.withColumn("_p", place).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(table), "_bucket")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_p) % 8 as int))")) != 0
    return marked.where(hit).select(*rows.columns)


def whole_number_id(df: DataFrame, col: str) -> Column:
    """The id column as a long; a table whose ids are no whole numbers is refused at once."""
    if not isinstance(df.schema[col].dataType, IntegralType):
        raise TypeError(f"{col} must hold whole numbers, not {df.schema[col].dataType.simpleString()}")
    return F.col(col).cast("long")


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id, written as text, is divisible by five."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def text_key(col: str | Column) -> Column:
    """A 128-bit content key of a text, so that equal texts meet without being shipped."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 32)


def byte_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    raw = values.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def byte_rows(values: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; a null is an empty text."""
    for v in values.cast(pa.large_binary()):
        yield v.as_py() or b""


def column_function(kind: pa.DataType) -> Callable:
    """Make a function of Arrow arrays that returns ``kind`` a function of columns."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def of_columns(*cols: str | Column) -> Column:
            return arrow_udf(f, from_arrow_type(kind))(*cols)

        return of_columns

    return wrap


def record(**fields: pa.DataType) -> pa.StructType:
    return pa.struct(list(fields.items()))
