"""Ranks, running totals, top-k and arg-max (WN5-WN11, TK1-TK5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage


def best_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """WN5 / WN8: first row per group in ``order`` (ties must be broken by the order); pruned before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return out.select(*keys, *[c for c in columns if c not in keys]) if columns else out


def top_two_margin(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "margin") -> DataFrame:
    """WN7: leader, runner-up and their distance; groups with one row get a NULL margin."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    two = df.select(*keys, tie, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    first, second = F.col("_rn") == 1, F.col("_rn") == 2
    return two.groupBy(*keys).agg(
        F.max(F.when(first, F.col(tie))).alias("leader"),
        F.max(F.when(first, F.col(value))).alias("leader_value"),
        F.max(F.when(second, F.col(value))).alias("runner_up_value"),
        (F.max(F.when(first, F.col(value))) - F.max(F.when(second, F.col(value)))).alias(out),
    )


def ordered_ranges(df: DataFrame, order: list[Column], buckets: int | None = None, out: str = "_bucket", place: str = "_place") -> DataFrame:
    """Rows dealt to ranges that follow each other in ``order``, numbered from 0 within their range.

    The cuts come from a sample and are composite: rows with equal first values split by the later ones, so one value may
    fill many ranges. One shuffle; the numbers are the rows' places in their sorted partition, and the frame is written to
    the shared folder since a second sample could cut elsewhere. Without ``buckets`` there is a range for each shuffle
    partition.
    """
    count = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()  # partition number and place in the partition
    placed = df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_row", row)
    ids = {out: F.shiftright("_row", 33).cast("int"), place: F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}
    return cut_lineage(placed.withColumns(ids).drop("_row"))


def global_rank(
    df: DataFrame, by: str, ties: list[str], out: str = "rank", buckets: int | None = None
) -> DataFrame:
    """WN9: row number over the whole frame, ascending by ``by`` (NULL first) then ``ties``.

    Rows are numbered inside ranges and shifted by the range's offset, so no task sees all rows, whatever the scores.
    """
    ranged = ordered_ranges(cut_lineage(df), [F.col(by), *map(F.col, ties)], buckets)
    offsets = _offsets(ranged, {"_offset": F.count("*")})
    ranked = ranged.join(offsets, "_bucket")
    return ranked.withColumn(out, F.col("_place") + F.col("_offset") + 1).drop("_place", "_offset", "_bucket")


def _offsets(marked: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Sum of each total over all earlier buckets (one row per bucket)."""
    per_bucket = marked.groupBy("_bucket").agg(*[c.alias(n) for n, c in totals.items()])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select("_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals])


def running_total_before(
    df: DataFrame, by: str, total: str, out: str, buckets: int | None = None
) -> DataFrame:
    """Sum of ``total`` over all rows with a smaller ``by`` (``by`` unique); used by the rank statistic ML9."""
    ranged = ordered_ranges(cut_lineage(df), [F.col(by)], buckets)
    offsets = _offsets(ranged, {"_offset": F.sum(total)})
    w = Window.partitionBy("_bucket").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_local", F.coalesce(F.sum(total).over(w), F.lit(0)))
    return summed.join(offsets, "_bucket").withColumn(out, F.col("_local") + F.col("_offset")).drop(
        "_local", "_offset", "_bucket", "_place"
    )


def numbered_folds(df: DataFrame, keys: list[str], out: str = "fold_number") -> DataFrame:
    """WN11: number the distinct cycles in key order (one row per cycle, so the single window task is small)."""
    return df.select(*keys).distinct().withColumn(out, F.row_number().over(Window.orderBy(*keys)))


def first_n_non_null(df: DataFrame, keys: list[str], order: str, value: str, n: int = 15) -> DataFrame:
    """WN12: the first ``n`` non-missing values per group, pruned before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    present = df.where(F.col(value).isNotNull())
    return present.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_cells(rows: DataFrame, keys: list[str], order: str, cells: str = "cells", n: int = 15) -> DataFrame:
    """WN12 over columns kept as an array: (keys, col_idx, order, value), the first ``n`` non-missing cells of each column.

    Every task holds the ``n`` first cells of each column it has met and prunes them as batches pass by, so that only
    these reach the shuffle: no cell is exploded, and neither a sort nor a window sees all of them. NULL keys are values
    as others.
    """
    names = [*keys, "col_idx", order, "value"]
    types = dict(rows.dtypes)
    kinds = [*[types[k] for k in keys], "int", types[order], "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        held, size, pruned = [], 0, 0
        for batch in batches:
            lists = batch.column(len(keys) + 1)
            flat, ends = lists.flatten(), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            column = np.arange(len(flat)) - (ends - np.diff(ends, prepend=0))[row]
            filled = np.asarray(pc.is_valid(flat))
            own = zip(*(batch.column(i).to_pylist() for i in range(len(keys)))) if keys else [()] * len(ends)
            code = np.array([codes.setdefault(k, len(codes)) for k in own], np.int64)
            at = np.flatnonzero(filled)
            frame = pd.DataFrame({"code": code[row[at]], "col": column[at], "at": np.asarray(batch.column(len(keys)))[row[at]]})
            frame["value"] = flat.take(pa.array(at)).to_numpy(zero_copy_only=False)
            held.append(_first_of(frame, n))
            size += len(held[-1])
            if size > max(50_000, 2 * pruned):
                held = [_first_of(pd.concat(held), n)]
                size = pruned = len(held[0])
        if held:
            out, known = _first_of(pd.concat(held), n), list(codes)
            arrays = [pa.array([known[c][i] for c in out["code"]]) for i in range(len(keys))]
            arrays += [pa.array(out["col"].to_numpy(np.int32)), pa.array(out["at"].to_numpy()), pa.array(out["value"], pa.string())]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, wanted)], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in zip(names, kinds))
    wanted = [f.type for f in to_arrow_schema(T._parse_datatype_string(schema))]
    few = rows.select(*keys, order, cells).mapInArrow(run, schema)
    return first_n_non_null(few, [*keys, "col_idx"], order, "value", n)


def _first_of(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    ranked = frame.sort_values(["code", "col", "at"], kind="stable")
    return ranked[ranked.groupby(["code", "col"]).cumcount() < n]


def running_marker(
    df: DataFrame, by: list[str], series: str = "party", date: str = "poll_date", truth: str = "actual_pct"
) -> DataFrame:
    """WN13: each series' truth placed at the last date of its slice; the window runs over one row per series."""
    per_series = df.groupBy(*by, series).agg(F.min(truth).alias(truth), F.max(date).alias("_last"))
    last = F.max("_last").over(Window.partitionBy(*by))
    return per_series.select(*by, series, truth, last.alias("marker_date")).where(F.col(truth).isNotNull())


def largest(df: DataFrame, by: str, k: int, ties: list[str], ascending: bool = False) -> DataFrame:
    """TK2: k largest (or smallest) rows; the limit is the feature, kept per partition before the merge."""
    key = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(key, *ties).limit(k)


def both_ends(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """TK3: the k smallest and the k largest rows, tagged."""
    low = largest(df, by, k, ties, ascending=True).withColumn("end", F.lit("lowest"))
    return low.unionByName(largest(df, by, k, ties).withColumn("end", F.lit("highest")))


def default_selection(df: DataFrame, included: str, series: str = "party", fallback: int = 4) -> DataFrame:
    """TK4: series flagged as included; when none is, the first ``fallback`` labels."""
    labels = df.groupBy(series).agg(F.bool_or(included).alias("_in")).where(F.col(series).isNotNull())
    any_in = F.bool_or("_in").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(series))
    return (
        labels.withColumns({"_any": any_in, "_place": place})
        .where(F.when(F.col("_any"), F.col("_in")).otherwise(F.col("_place") <= fallback))
        .select(series)
    )


def option_list(df: DataFrame, column: str) -> DataFrame:
    """TK5."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
