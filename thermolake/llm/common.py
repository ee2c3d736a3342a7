"""Helpers shared by the corpus operators.

Operators read only the columns named by their arguments; further columns of a table are ignored, whatever their
names. A missing text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import work_dir

# words are runs of anything but these six ASCII characters
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared work folder and reads it back: later steps neither compute it again nor lose
    it with an executor."""
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def n_pieces(total: int, per_piece: int) -> int:
    """How many pieces of at most ``per_piece`` on average hold ``total``."""
    return max(1, -(-int(total) // per_piece))


def add_offsets(counts: DataFrame, keys: list[str], order: str, size: str, out: str, block: int = 4096) -> DataFrame:
    """Adds the sum of ``size`` over all earlier rows of the same ``keys``, in the order of the whole number
    ``order``, which must be unique within the keys.

    Sums are built within blocks of ``order`` and then over the blocks, so that one task sees at most ``block``
    rows, or one row per block.
    """
    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    by_block = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(*earlier)
    rows = counts.withColumn("__block", F.floor(F.col(order) / block)).withColumn(
        "__within", F.coalesce(F.sum(size).over(by_block), zero))
    totals = counts.groupBy(*keys, F.floor(F.col(order) / block).alias("__block")).agg(F.sum(size).alias("__total"))
    over_blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(*earlier)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(over_blocks), zero)).drop("__total")
    same = [rows[k].eqNullSafe(starts[k]) for k in [*keys, "__block"]]
    joined = rows.join(starts.select(*[F.col(k) for k in [*keys, "__block"]], "__start"), on=same)
    return joined.select(*[rows[c] for c in counts.columns], (F.col("__start") + F.col("__within")).alias(out))
