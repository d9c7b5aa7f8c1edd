"""A table's change files as a stream, and a stream of edits folded into a table.

``stream`` reads the change files of a table as they are committed; ``fold`` keeps the latest state per key of such a stream by
foreachBatch, each batch an overlay of the one before, written to a folder of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import overlay
from vellum.session import Engine, snapshot


def stream(engine: Engine, table: str, per_trigger: int = 100) -> DataFrame:
    """Edits of a table (its columns, _op, _seq, _tx) as a streaming DataFrame, files in order of their time.

    It also shows edits of transactions that have written but not committed; consumers join _tx to the journal.
    """
    state = Engine._state(snapshot(engine.store), table)
    schema = f"{state.schema.ddl}, `_op` string, `_seq` bigint, `_tx` string"
    path = engine.store.path(f"changes/{table.lower()}/*")
    return engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def fold(engine: Engine, table: str, base: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A foreachBatch function: applies a batch's edits to the state so far and hands the new state to sink."""
    key = list(Engine._state(snapshot(engine.store), table).schema.key)
    state = {"rows": base}

    def apply(batch: DataFrame, number: int) -> None:
        committed = [e["tx"] for e in engine.store.journal(engine.store.ref("data"))]
        order = {tx: n for n, tx in enumerate(committed)}
        if not order:
            return
        ranks = F.create_map(*[x for tx, n in order.items() for x in (F.lit(tx), F.lit(n).cast("long"))])
        edits = batch.withColumn("_generation", ranks[F.col("_tx")]).where("_generation IS NOT NULL").drop("_tx")
        folder = engine.store.path(f"{engine.store.new_folder('data', table)}")
        overlay.overlay(state["rows"], edits, key).write.parquet(folder)
        state["rows"] = engine.spark.read.parquet(folder)
        sink(state["rows"], number)

    return apply
