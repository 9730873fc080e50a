"""Incremental matching: new records, micro-batch by micro-batch, against a static reference index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import blocking
from recordloom.operators.decide import assign
from recordloom.plans.linkage import normalize
from recordloom.sources.scratch import table


def match_stream(stream: DataFrame, reference: DataFrame, out: str, checkpoint: str, least: float = 5.0):
    """Start a query that appends (rec, s1, score) of each batch's best matches to Parquet at `out`.

    reference: normalised records. Its keys are indexed once, as a table; a batch joins that static table by key. A batch that is run
    again after a failure replaces its own folder, so results appear once.
    """
    keys = blocking.record_keys(reference)
    known = table(blocking.postings(keys, blocking.build_index(keys, reference)), "postings")

    def run(batch: DataFrame, batch_id: int) -> None:
        own = blocking.record_keys(normalize(batch))
        hits = blocking.postings_join(own, known).select(F.col("s1").alias("rec"), F.col("cand").alias("s1"), F.round("score", 9).alias("score"))
        assign(hits, "score", least).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
