"""Verification of streams, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.detect import detect_df
from ..operators.verify import Verification, as_constraints, verify_df


def verify_stream(stream: DataFrame, constraints, on_result: Callable[[Verification, int], None], **options) -> DataStreamWriter:
    """A writer that verifies each micro-batch and hands over its result and number; the caller starts it."""
    known = as_constraints(constraints)

    def check(batch: DataFrame, number: int) -> None:
        on_result(verify_df(batch, known, **options), number)

    return stream.writeStream.foreachBatch(check)


def quarantine(stream: DataFrame, constraints, bad_path: str, good_path: str | None = None, **options) -> DataStreamWriter:
    """A writer that sends rows that break a constraint to ``bad_path``, with their flags, and the others to ``good_path``.

    A batch's folder is named by its number, so that a batch that runs again replaces what it wrote.
    """
    known = as_constraints(constraints)

    def split(batch: DataFrame, number: int) -> None:
        batch.persist()
        found = detect_df(batch, known, in_place=True, write_all=True, **options)
        rows = found.detected() if found.detection else batch.withColumn("n_failures", F.lit(0).cast("long"))
        rows.filter("n_failures > 0").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        if good_path:
            rows.filter("n_failures = 0").select(*batch.columns).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(split)
