"""Quotas of classes filled from a stream of arrivals (micro-batches), each arrival taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotsman.operators.datasets import first_of_class


def fill_from_stream(arrivals: DataFrame, need: DataFrame, cls: str, order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes the first ``need`` arrivals of each class to ``out``, one folder a micro-batch.

    ``need`` (class, need) is a table of quotas, one row a class.  After each batch the totals taken so far are written
    beside it, one row a class, in a folder that readers of ``out`` skip; the next batch starts from them, so a batch
    costs what it holds and the totals, however many went before.  A batch that is repeated after a failure overwrites
    its folder and its totals and counts nothing twice.
    """
    schema = arrivals.schema

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        totals = lambda i: f"{out}/_totals/batch={i}"
        left = need.select(cls, "need")
        before = None
        if number > 0:
            before = spark.read.parquet(totals(number - 1))
            left = left.join(before, cls, "left").select(cls, (F.col("need") - F.coalesce("taken", F.lit(0))).alias("need"))
        first_of_class(batch, [cls], order, left).select(*schema.names).write.mode("overwrite").parquet(f"{out}/batch={number}")
        now = spark.read.schema(schema).parquet(f"{out}/batch={number}").groupBy(cls).agg(F.count(F.lit(1)).alias("taken"))
        both = now if before is None else before.unionByName(now).groupBy(cls).agg(F.sum("taken").alias("taken"))
        both.write.mode("overwrite").parquet(totals(number))

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
