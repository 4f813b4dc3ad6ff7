"""Writers and export tables (IO5-IO11). Folders are written by all tasks; nothing is gathered on the driver."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import write_observed


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """IO5 / IO11."""
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def fixed_decimals(df: DataFrame, decimals: int = 6) -> DataFrame:
    """IO6: floating-point columns as text with a fixed number of decimals."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c))) for c in floats})


def json_records(df: DataFrame) -> DataFrame:
    """IO7: one JSON text per row; NULL members are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO7."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def dataset_manifest(tables: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """IO8: source, row count and column list per table that is stored already; ``export_tables`` counts while it writes."""
    rows = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("name"), F.lit(source).alias("source"), "rows", F.lit(",".join(df.columns)).alias("columns")
        )
        for name, (source, df) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def export_tables(tables: dict[str, tuple[str, DataFrame]], folder: str, kind: str = "json", mode: str = "errorifexists") -> DataFrame:
    """IO8: write every table once below ``folder`` and return the manifest, its row counts taken while writing."""
    rows = []
    for name, (source, df) in tables.items():
        figures = write_observed(df, os.path.join(folder, name), {"rows": F.count("*")}, kind, mode)
        rows.append((name, source, figures["rows"], ",".join(df.columns)))
    return df.sparkSession.createDataFrame(rows, "name string, source string, rows long, columns string")


def write_once(df: DataFrame, path: str) -> None:
    """IO9: a final evaluation may be stored once; a second attempt fails."""
    df.write.mode("errorifexists").parquet(path)


def decision_record(metrics: DataFrame, selected: str, column: str, basis: str, challenger: str, usage: str) -> DataFrame:
    """IO10: the model choice with its measured figures, one row; ``record`` is the JSON text."""
    own = metrics.where(F.col("model") == selected)

    def figure(name: str):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    row = own.agg(
        F.lit(selected).alias("selected_model"),
        F.lit(column).alias("prediction_column"),
        F.lit(basis).alias("selection_basis"),
        figure("MAE").alias("development_mae"),
        figure("RMSE").alias("development_rmse"),
        figure("election_winner_accuracy").alias("development_winner_accuracy"),
        F.lit(challenger).alias("challenger_decision"),
        F.lit(usage).alias("holdout_usage"),
    )
    return row.withColumn("record", F.to_json(F.struct("*")))


def write_decision(record: DataFrame, path: str) -> None:
    """IO10."""
    record.select("record").coalesce(1).write.mode("overwrite").text(path)
