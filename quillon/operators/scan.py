"""Folds over ordered rows of any number, in parallel.

What a fold has done before a row matters only through its state. So the sorted rows of a key are cut into runs, ranges
of bounded size; a run is summed up by the map from each state in which it can be entered to the one in which it is
left; maps are composed, in groups of SPAN and groups again, which gives every run's own entry; then all runs are folded
at once. No task holds all rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Rows of a run; runs whose maps are composed together.
RUN, SPAN = 4096, 1024


def in_runs(rows: DataFrame, by: str, order: list[str], fields: list[StructField] = (), sum_up: Callable[[], Callable[[pa.RecordBatch], Callable[[int, int], tuple]]] | None = None, size: int | None = None) -> DataFrame:
    """(by, run, t, fields...): rows sorted by key and order, in runs of at most ``size`` (RUN); t: the array of the rows'
    other columns. Runs are numbered in order, not without gaps.

    sum_up() gives, once a task, a function of a batch that gives a function of a run's first row in it and the one behind
    its last, which returns the values of ``fields``.
    """
    size = size or RUN
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = StructType([f for f in rows.schema if f.name != by])
    schema = StructType([rows.schema[by], StructField("run", LongType()), StructField("t", ArrayType(item)), *fields])
    ranges = rows.select(by, *item.names).repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        make, number = sum_up() if sum_up else None, TaskContext.get().partitionId() << 40
        kinds = to_arrow_schema(StructType(list(fields))).types if fields else []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, bounds = batch.column(by).to_pylist(), [0]
            for i in range(1, len(keys)):
                if keys[i] != keys[i - 1] or i - bounds[-1] >= size:
                    bounds.append(i)
            begins, bounds = bounds, [*bounds, len(keys)]
            made = list(zip(*map(make(batch), begins, bounds[1:]), strict=True)) if make else []
            items = pa.StructArray.from_arrays([batch.column(n) for n in item.names], names=item.names)
            own = [batch.column(by).take(pa.array(begins)), pa.array(range(number, number + len(begins)), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(v), k) for v, k in zip(made, kinds, strict=True))], names=schema.names)
            number += len(begins)

    return ranges.mapInArrow(run, schema)


def unpacked(t: pa.Array, name: str) -> list[list]:
    """A column of the rows of each run."""
    return pa.ListArray.from_arrays(t.offsets, t.values.field(name)).to_pylist()


def _composed(listed: Column) -> Column:
    """The maps of an array of (rank, map), one after the other."""
    identity = F.sequence(F.lit(0), F.size(listed[0]["map"]) - 1)
    return F.aggregate(listed, identity, lambda acc, x: F.transform(acc, lambda i: F.get(x["map"], i)))


def _entries(listed: Column, begin: Column) -> Column:
    """The state before each of an array of (rank, map), if ``begin`` is that before the first."""
    start = F.struct(begin.cast("int").alias("now"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(listed, start, lambda acc, x: F.struct(F.get(x["map"], acc["now"]).alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all")), lambda acc: acc["all"])


def entry_states(mapped: DataFrame, by: str, span: int | None = None) -> DataFrame:
    """(run, entry) from (by, run, map): the state in which each run is entered. Keys begin in state 0; maps of a key have
    one size."""
    ranked = mapped.select(by, "run", "map").withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("run")) - 1)
    grouped = ranked.withColumn("part", F.floor(F.col("rank") / (span or SPAN))).groupBy(by, "part").agg(F.array_sort(F.collect_list(F.struct("rank", "run", "map"))).alias("own"))
    wholes = grouped.select(by, "part", _composed(F.col("own")).alias("map")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("parts"))
    placed = wholes.select(F.col(by).alias("_by"), F.posexplode(_entries(F.col("parts"), F.lit(0))).alias("_part", "entry"))
    each = grouped.join(placed, F.col(by).eqNullSafe(F.col("_by")) & (F.col("part") == F.col("_part"))).select(F.explode(F.arrays_zip(F.col("own"), _entries(F.col("own"), F.col("entry")).alias("at"))).alias("x"))
    return each.select(F.col("x.own.run").alias("run"), F.col("x.at").alias("entry"))
