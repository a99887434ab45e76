"""Ordered scans: running totals and folds along an order, for keys of any size.

A key may hold most of the rows, so no scan runs through a key in one task. Rows are dealt out by ranges of (key, order),
whose bounds Spark samples; within a range (`_span`) a window does the scan, and over the spans' totals, which are few, another.
A fold that isn't a sum is cut likewise where its steps compose: a step of an exponential average is x -> a x + b, and
such maps make one map, so blocks of steps are made into maps apart, those into maps of many blocks, and the few that are left are
applied in order.

Doubles add up to sums that hang on the order of additions. `summed` has one that hangs on the rows' numbers alone: nodes of sixteen rows, of
sixteen nodes and so on, and a row's sum is that of the largest nodes before it, then of smaller ones, and of single rows last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.storage import stored

#: Steps of one map, and maps of the next one.
BLOCK = 4096

#: Rows of a node, and nodes of the next larger one, in sums of doubles; `BLOCK` is a power of it.
NODE = 16


def spanned(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `_span`, stored: numbers of ranges of (by, order) that rise along it. Nulls come first."""
    dealt = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in [*by, *order]])
    return stored(dealt.withColumn("_span", F.spark_partition_id()), "spans")


def running(rows: DataFrame, by: list[str], order: list[str], total: Callable[[Column], Column], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """rows with the running sum or maximum (`total` is F.sum or F.max) of a value, in order within `by`.

    Both are associative, so they run within spans and over the spans' totals. Rows that `spanned` made for this order are taken as they are and keep their spans.
    """
    columns = rows.columns
    if "_span" not in columns:
        rows = spanned(rows, by, order)
    cut = rows.withColumn("_value", value)
    end = Window.currentRow if inclusive else -1
    inner = total(F.col("_value")).over(Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, end))
    spans = cut.groupBy(*by, "_span").agg(total(F.col("_value")).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "_span", total(F.col("_total")).over(before).alias("_before"))
    # totals and rows meet by key and span; null keys are one key too
    met = cut.withColumn("_inner", inner).alias("r").join(spans.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_span"]])
    own = F.col("_inner"), F.col("s._before")
    both = F.coalesce(own[0] + own[1], *own) if total is F.sum else F.greatest(*own)
    return met.select(*[F.col(f"r.{c}") for c in columns], both.alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their numbers from 0, in order within `by`."""
    return running(rows, by, order, F.sum, F.lit(1), name).withColumn(name, F.col(name) - 1)


def nodes(values: np.ndarray) -> list[np.ndarray]:
    """Values, the sums of each `NODE` of them, the sums of each `NODE` of those and so on; what doesn't fill a node is in none."""
    levels = [values]
    while len(levels[-1]) >= NODE:
        full = levels[-1][: len(levels[-1]) // NODE * NODE].reshape(-1, NODE)
        levels.append(np.cumsum(full, axis=1)[:, -1])
    return levels


def sums(values: np.ndarray, before: float = 0.0) -> np.ndarray:
    """The sums of the first 0, 1, ... values on top of `before`: the largest nodes first, single values last."""
    found = np.array([before])
    for level in reversed(nodes(values)):
        steps = np.zeros(len(found) * NODE)
        steps[: len(level)] = level
        found = np.cumsum(np.column_stack([found, steps.reshape(-1, NODE)[:, :-1]]), axis=1).ravel()[: len(level) + 1]
    return found


def _doubles(rows: pa.Table) -> np.ndarray:
    return rows["_value"].combine_chunks().fill_null(0.0).to_numpy()


def _block_node(rows: pa.Table) -> pa.Table:
    """A block's node (0 where rows don't fill it, for no row comes after) and how many of its values aren't null, with the columns of its key."""
    rows = rows.sort_by("_n")
    node = nodes(_doubles(rows))[-1][0] if rows.num_rows == BLOCK else 0.0
    known = rows.num_rows - rows["_value"].null_count
    return rows.slice(0, 1).drop_columns(["_n", "_value"]).append_column("_node", pa.array([node])).append_column("_known", pa.array([known]))


def _block_starts(blocks: pa.Table) -> pa.Table:
    """The sums before and after each of a key's blocks, and how many values that aren't null are before it."""
    blocks = blocks.sort_by("_block")
    at, known = sums(blocks["_node"].to_numpy()), blocks["_known"].to_numpy()
    found = blocks.drop_columns(["_node", "_known"]).append_column("_before", pa.array(at[:-1])).append_column("_after", pa.array(at[1:]))
    return found.append_column("_seen", pa.array(np.cumsum(known) - known))


def _block_sums(rows: pa.Table) -> pa.Table:
    """A block's rows with their sums; null as long as no value was known."""
    rows = rows.sort_by("_n")
    found = sums(_doubles(rows), rows["_before"][0].as_py())[1:]
    if rows.num_rows == BLOCK:
        found[-1] = rows["_after"][0].as_py()
    seen = rows["_seen"][0].as_py() + np.cumsum(rows["_value"].combine_chunks().is_valid().to_numpy(zero_copy_only=False))
    return rows.drop_columns(["_n", "_block", "_value", "_before", "_after", "_seen"]).append_column("_sum", pa.array(found, mask=seen == 0))


def summed(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the running sum of doubles, in order within `by`; stored. Additions hang on a row's number, not on spans.

    It is the order in which windows of the checking SQL add. A task has blocks of `BLOCK` rows; of a key's blocks one
    number each comes together.
    """
    columns = rows.columns
    cut = numbered(rows, by, order, "_n").select(*columns, "_n", (F.col("_n") / BLOCK).cast("long").alias("_block"), value.cast("double").alias("_value"))
    cut = stored(cut, "numbered")
    keys = cut.select(*by, "_block").schema.fields
    tops = cut.select(*by, "_block", "_n", "_value").groupBy(*by, "_block").applyInArrow(_block_node, T.StructType([*keys, T.StructField("_node", T.DoubleType()), T.StructField("_known", T.LongType())]))
    starts = tops.groupBy(*by).applyInArrow(_block_starts, T.StructType([*keys, T.StructField("_before", T.DoubleType()), T.StructField("_after", T.DoubleType()), T.StructField("_seen", T.LongType())]))
    starts = stored(starts, "starts")
    met = cut.alias("r").join(starts.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_block"]])
    met = met.select(*[F.col(f"r.{c}") for c in cut.columns], "s._before", "s._after", "s._seen")
    found = met.groupBy(*by, "_block").applyInArrow(_block_sums, T.StructType([*cut.select(*columns).schema.fields, T.StructField("_sum", T.DoubleType())]))
    return stored(found, "sums").withColumnRenamed("_sum", name)


def _applied(maps: Column, start: Column) -> Column:
    """An array of maps (a, b), in order, applied to a number."""
    return F.aggregate(maps, start, lambda x, m: x * m["a"] + m["b"])


def _composed(maps: Column) -> Column:
    """An array of maps, in order, as one: struct<a, b>."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, one, lambda x, m: F.struct((x["a"] * m["a"]).alias("a"), (x["b"] * m["a"] + m["b"]).alias("b")))


def _stops(maps: Column, start: Column) -> Column:
    """The numbers before each of an array of maps, and after the last."""
    first = F.struct(start.alias("x"), F.array().cast("array<double>").alias("seen"))
    last = F.aggregate(maps, first, lambda s, m: F.struct((s["x"] * m["a"] + m["b"]).alias("x"), F.concat(s["seen"], F.array(s["x"])).alias("seen")))
    return F.concat(last["seen"], F.array(last["x"]))


def _in_order(number: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(number, "a", "b")))


def stops(maps: DataFrame, key: str, number: str, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, number and x, the value before each map; and key and x, the value after all. maps: key, number (from 0, dense), a, b. start: key, x.

    Maps are composed in groups of `BLOCK`, so the arrays along which single values go hold a map for `BLOCK` of them.
    """
    groups = maps.withColumn("_group", (F.col(number) / BLOCK).cast("long")).groupBy(key, "_group").agg(_in_order(number).alias("_maps"))
    groups = stored(groups.withColumn("_one", _composed(F.col("_maps"))), "maps")
    tops = groups.select(key, "_group", "_one.*").groupBy(key).agg(_in_order("_group").alias("_tops")).join(start, key, "left")
    tops = tops.withColumn("_stops", _stops(F.col("_tops"), F.coalesce("x", F.lit(0.0))))
    begin = tops.select(key, F.posexplode(F.slice("_stops", 1, F.size("_tops"))).alias("_group", "_begin"))
    within = groups.join(begin, [key, "_group"]).select(key, F.arrays_zip(F.transform("_maps", lambda m: m[number]).alias("n"), F.slice(_stops(F.col("_maps"), F.col("_begin")), 1, F.size("_maps")).alias("x")).alias("_zip"))
    each = within.select(key, F.explode("_zip").alias("z")).select(key, F.col("z.n").alias(number), F.col("z.x").alias("x"))
    return each, tops.select(key, F.element_at("_stops", -1).alias("x"))


def blocks(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, block (from 0) and items, an array of up to `BLOCK` structs (n from 0, value) of successive rows; stored."""
    found = numbered(rows, [key], order, "_n").select(key, (F.col("_n") / BLOCK).cast("long").alias("block"), F.struct(F.col("_n").alias("n"), F.col(value).alias("value")).alias("item"))
    return stored(found.groupBy(key, "block").agg(F.array_sort(F.collect_list("item")).alias("items")), "blocks")
