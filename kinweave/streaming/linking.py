"""Blocking of arriving records against a standing index, as an optional front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import block_join, exploded, keys_v2


def link_stream(arrivals: DataFrame, index: DataFrame, out: str, checkpoint: str, cap: int = 1000, trusted: tuple[str, ...] = ("p2", "s2", "pb", "cmp")) -> StreamingQuery:
    """Write candidate pairs (q, t, batch) of each micro-batch of arriving records.

    index is (q, route, key) of the standing side; arrivals have entity_id,
    business_name, business_address, country, src and line_idx. A batch that is
    run again replaces its own output.
    """

    def run(batch: DataFrame, number: int) -> None:
        keys = keys_v2(F.col("business_name"), F.col("business_address"), F.col("country"))
        pool = exploded(batch, keys, "entity_id", "src", "line_idx").withColumnRenamed("entity_id", "t")
        block_join(index, pool, cap, trusted).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
