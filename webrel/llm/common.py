"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrel.session import checkpoint_dir, written

__all__ = ["checkpoint_dir", "maybe_in", "partitions", "remove", "row_key", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that an operator wrote and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and text (either may be null).
    Rows that repeat both are the same document and share the key."""
    i, t = F.col(id_col).cast("string"), F.col(text_col)
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    return F.unhex(F.md5(F.concat(part(i), F.lit("|"), part(t)))).alias("rid")


FILTER_ROWS = 1 << 20   # bound of the bit table that ``maybe_in`` broadcasts: 2**20 rows of two numbers


def maybe_in(rows: DataFrame, key: Column, members: DataFrame, member_key: Column) -> DataFrame:
    """``rows`` without most of those whose key is in no row of ``members``.

    One bit of a table of 64 * ``FILTER_ROWS`` bits per member; the table has at most
    ``FILTER_ROWS`` rows whatever the data, so it is broadcast.  No row with a member's
    key is lost; the exact join that must follow shuffles what is left.  With far
    more members than bits everything passes, which costs only that saving."""
    def place(k):
        h = F.xxhash64(k)
        return F.pmod(h, F.lit(FILTER_ROWS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")

    word, bit = place(member_key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    bits = (members.select(word.alias("word"), bit.alias("bit")).distinct()
            .groupBy("word").agg(F.bit_or(one).alias("bits")).select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    word, bit = place(key)
    hit = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(bits), (word == F.col("__word")) & hit, "left_semi")
