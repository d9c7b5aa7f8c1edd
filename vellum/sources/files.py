"""Files as sources and sinks: Parquet, ORC, CSV, JSON and text, batch; tables are imported from any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error", **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}")
    writer = df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def import_table(session, table: str, rows: DataFrame) -> int:
    """INSERT of a DataFrame into a table of a session, with all its checks."""
    session.adopt(rows, "vellum_import")
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    return session.execute(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM vellum_import")
