"""Mutations that arrive as a stream, applied to a store micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold
from ..sources import Store

_MARK = b"_stream/"


def apply_stream(log: DataFrame, store: Store, bucket: bytes, name: str, checkpoint: str):
    """log: streaming (key, value, op, seq). Each batch becomes one transaction, which also keeps
    the number of the batch, so that a batch that is repeated after a crash is passed over."""

    def apply(batch: DataFrame, number: int) -> None:
        with store.update() as tx:
            marks = tx.create_bucket_if_missing(_MARK + name.encode())
            done, found = marks.get(b"batch")
            if found and int(done) >= number:
                return
            target = tx.create_bucket_if_missing(bucket)
            last = fold.latest(batch.select("key", "value", "op", "seq"))
            last = last.select("key", F.coalesce("value", F.lit(b"")).alias("value"), "op")
            target.apply_df(last.where("op in ('put', 'del')"))
            marks.put(b"batch", str(number).encode())

    return log.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(apply)
