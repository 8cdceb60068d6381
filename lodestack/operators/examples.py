"""Fine-tuning examples: each query once, in a seeded order, cut into a training and a validation part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of the hash that name a bucket: 4096 buckets, whose sizes are a broadcast table.
DIGITS = 3


def split_examples(examples: DataFrame, order: list[str], valid: float = 0.1, seed: int = 42) -> DataFrame:
    """examples (query, ...) with place from 0 and split (train, valid); of queries equal but for case and outer white space, the first by `order`.

    The order is that of a seeded hash of the query. Only a bucket's rows are sorted together, the buckets' sizes say
    where each begins. The first floor(n * (1 - valid)) places train. A null query counts as empty.
    """
    key = F.lower(F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", ""))
    once = examples.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*examples.columns), F.struct(*order)).alias("_row"))
    hashed = once.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed} "), F.col("_key")))).withColumn("_bucket", F.left("_hash", F.lit(DIGITS)))
    upto = F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).select("_bucket", (upto - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "_key")) - 1
    placed = hashed.withColumn("_at", at).join(F.broadcast(sizes), "_bucket").withColumn("place", F.col("_before") + F.col("_at"))
    split = F.when(F.col("place") < F.floor(F.col("_all") * F.lit(1 - valid)), "train").otherwise("valid")
    return placed.select("_row.*", "place", split.alias("split"))
