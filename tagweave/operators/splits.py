"""Splits and folds for training.

Defined results: the test part is the last ``test_size`` rows in the given
order, rows without order value come first; a ``test_size`` of 0 leaves the
train part empty; folds depend only on the group sizes and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_noshuffle(df: DataFrame, order: str, test_size: int | float | None = None) -> DataFrame:
    """Adds ``is_test``.  The border is found by a range-partitioned rank: only
    the rows near it are ordered, not the table in one task."""
    n = df.count()
    k = int(n * 0.25) if test_size is None else int(n * test_size) if isinstance(test_size, float) else test_size
    if k == 0:
        return df.withColumn("is_test", F.lit(True))
    if k >= n:
        return df.withColumn("is_test", F.lit(True))
    if k >= df.where(F.col(order).isNotNull()).count():
        # rows without order value are needed too: which ones is left to their hash
        missing = df.where(F.col(order).isNull())
        need = k - (n - missing.count())
        marked = split_noshuffle(missing.withColumn("__order", F.xxhash64(*df.columns)), "__order", need).drop("__order") if need else missing.withColumn("is_test", F.lit(False))
        return df.where(F.col(order).isNotNull()).withColumn("is_test", F.lit(True)).unionByName(marked)
    border = _kth_largest(df, order, k)
    # rows before the border value are train, after it test; ties by exact rank
    tied = df.where(F.col(order) == border).count()
    above = df.where(F.col(order) > border).count()
    if above + tied == k:
        return df.withColumn("is_test", F.coalesce(F.col(order) >= border, F.lit(False)))
    # of the rows that tie at the border, those of larger hash; equal rows by number
    h = F.xxhash64(*df.columns)
    ties = df.where(F.col(order) == border).withColumn("__h", h)
    need = k - above
    cut = _kth_largest(ties, "__h", need)
    over = ties.where(F.col("__h") > cut).count()
    alike = ties.where(F.col("__h") == cut).withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy("__h")))
    rest = df.where(~F.col(order).eqNullSafe(border)).withColumn("is_test", F.coalesce(F.col(order) > border, F.lit(False)))
    sure = ties.where(F.col("__h") != cut).withColumn("is_test", F.col("__h") > cut).drop("__h")
    split = alike.withColumn("is_test", F.col("__n") <= need - over).drop("__h", "__n")
    return rest.unionByName(sure).unionByName(split)


def _kth_largest(df: DataFrame, order: str, k: int):  # noqa: ANN202
    """Exact k-th largest value: narrow the value range by counts, then order
    what is left (a few thousand rows)."""
    part, need = df.select(order), k
    for _ in range(30):
        n = part.count()
        if n <= 10_000:
            break
        mid = part.agg(F.expr(f"approx_percentile({order}, {max(0.0, min(1.0, 1 - need / n))}, 10000)")).first()[0]
        above = part.where(F.col(order) > mid).count()
        equal = part.where(F.col(order) == mid).count()
        if above >= need:
            part = part.where(F.col(order) > mid)
        elif above + equal >= need:
            return mid
        else:
            part, need = part.where(F.col(order) < mid), need - above - equal
    return part.orderBy(F.col(order).desc()).limit(need).agg(F.min(order)).first()[0]


def group_folds(df: DataFrame, group: str, n_folds: int, largest: int = 1000) -> DataFrame:
    """``(group, fold)``: groups by size, largest first, each to the lightest
    fold.  Only the ``largest`` groups are dealt out so (a top-k of the group
    sizes, all that matters for balance); smaller ones go by their hash."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    weight = [0] * n_folds
    rows = []
    for r in sizes.orderBy(F.col("n").desc(), F.col(group)).limit(largest).collect():
        fold = min(range(n_folds), key=lambda f: (weight[f], f))
        weight[fold] += r["n"]
        rows.append((r[group], fold))
    known = df.sparkSession.createDataFrame(rows, f"__g {df.schema[group].dataType.simpleString()}, fold int")
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit(""))), F.lit(n_folds)).cast("int")
    return sizes.join(known, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, F.coalesce("fold", hashed).alias("fold"))


def hash_folds(df: DataFrame, group: str, n_folds: int) -> DataFrame:
    """Adds ``fold`` by the group's hash: no order, no driver; for many groups."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit(""))), F.lit(n_folds)).cast("int"))


def natural_order(df: DataFrame, column: str) -> DataFrame:
    from tagweave.functions.text import natural_key

    return df.orderBy(natural_key(column), column)
