"""What a key's rows have in common, brought to each of them, though one key may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys with the most rows, whose values are broadcast (so never more than that many); every other key has at most 1 / LARGEST of all rows.
LARGEST = 1000


def with_least(rows: DataFrame, key: str, value: Column, name: str, *spread: str) -> DataFrame:
    """rows with name: the least value of the rows that have the same key; null where key is null.

    The least values are aggregated before the shuffle. Rows of the LARGEST keys get theirs from a broadcast; they, and rows without a key, pass
    the join for all other keys dealt by a hash of spread, and match nothing there that counts.
    """
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_own"), F.count(F.lit(1)).alias("_n"))
    known = own.orderBy(F.desc("_n"), key).limit(LARGEST).select(key, F.col("_own").alias("_known"), F.lit(True).alias("_large"))
    out = rows.join(F.broadcast(known), key, "left")
    single = F.col("_large").isNull() & F.col(key).isNotNull()
    out = out.withColumn("_at", F.when(single, F.col(key)).otherwise(F.xxhash64(*spread).cast(rows.schema[key].dataType)))
    out = out.join(own.select(F.col(key).alias("_at"), "_own"), "_at", "left")
    found = F.when(single, F.col("_own")).otherwise(F.col("_known"))
    return out.select(*rows.columns, found.alias(name))
