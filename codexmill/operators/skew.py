"""Running values over keys that may hold a third of all rows: two levels, so that no task holds a whole key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.session import materialise


def running_sum(df: DataFrame, key: str, part: str, order: list[str], value: Column) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same key that come before, by (part, order).

    Sums of the parts (few rows for each key) are added up first, then a window runs inside each part."""
    sums = df.groupBy(key, part).agg(F.sum(value).alias("part_sum"))
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, part, F.coalesce(F.sum("part_sum").over(w), F.lit(0)).alias("part_before"))
    inside = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("in_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(sums, [key, part]).withColumn("before", F.col("part_before") + F.col("in_before")).drop("part_before", "in_before")


def previous(df: DataFrame, key: str, part: str, order: list[str], cols: list[str]) -> DataFrame:
    """df with `prev`: a struct of cols of the row before it of the same key, by (part, order); null for the first.

    A lag inside each part; the first row of a part takes the last row of the part before it."""
    inside = Window.partitionBy(key, part).orderBy(*order)
    row = F.struct(*cols)
    last = df.groupBy(key, part).agg(F.max_by(row, F.struct(*order)).alias("last"))
    last = last.select(key, part, F.lag("last").over(Window.partitionBy(key).orderBy(part)).alias("before_part"))
    df = df.withColumn("in_prev", F.lag(row).over(inside))
    return df.join(last, [key, part]).withColumn("prev", F.coalesce("in_prev", "before_part")).drop("in_prev", "before_part")


#: Rows of one key beyond which a join spreads it over several tasks.
HOT = 100_000
#: Rows of a side that is broadcast at most; it is counted first.
BROADCAST_ROWS = 1_000_000


def hot_join(few: DataFrame, many: DataFrame, keys: list[str], spread: list[str], hot: int = HOT) -> DataFrame:
    """Inner join on keys of which one may hold a third of `many`: hot keys are split by a hash of `spread`, their rows of `few` repeated for each part.

    The table of hot keys has at most rows / hot entries, and so may be broadcast."""
    sizes = many.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    sizes = F.broadcast(sizes)
    few = few.join(sizes, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    many = many.join(sizes, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")
    return few.join(many, [*keys, "_salt"]).drop("_salt")


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """big ⋈ small (left, semi or anti), where small is written and counted first: broadcast up to `limit` rows, else shuffled.

    Beyond the limit rows of `big` with a null key, which match nothing, stay out of the shuffle."""
    small = materialise(small, "side")
    if small.count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    met = big.where(known).join(small, keys, how)
    if how == "left_semi":
        return met
    rest = big.where(~known)
    return met.unionByName(rest, allowMissingColumns=True)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in the given order, with `rank` from 1: a range sort, its partitions' sizes added up, places within them.

    No task holds more than its range; the sizes are one row for each partition."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialise(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), place.alias("_i")), "ranked")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_p").withColumn("rank", F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before").orderBy("rank")


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """A sequential fold over each key's rows in order, for what depends on all rows before it.

    Rows stream through sorted partitions: state is kept for the key at hand only, whatever the size of its group.
    start() gives a state, step(state, row) gives (state, rows to emit), end(key, state) the rows at a key's end; emitted
    rows are tuples behind the key's values."""
    names = [c.split()[0] for c in schema.split(", ")]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in b.itertuples(index=False):
                k = tuple(row[: len(keys)])
                if k != key:
                    if key is not None:
                        out += [(*key, *x) for x in end(state)]
                    key, state = k, start()
                state, emitted = step(state, row)
                out += [(*k, *x) for x in emitted]
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, *x) for x in end(state)], columns=names)

    cols = [*keys, *[c for c in df.columns if c not in keys]]
    return df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(part, schema)
