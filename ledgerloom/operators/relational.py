"""Composable relational operators: as-of lookups, top-k, first-seen, upserts, shares, growth, budgets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_as_of(history: DataFrame, key: str, date: str, as_of: str | None, ties: Sequence[Column] = ()) -> DataFrame:
    """The last row of each key dated on or before ``as_of`` (null: of all); undated rows go.

    ``ties`` order rows of one date, first wins.  One shuffle on the key; Spark
    keeps one row a key and task before it (a window group limit).
    """
    rows = history.where(F.col(date).isNotNull() if as_of is None else F.col(date) <= F.to_date(F.lit(as_of)))
    order = Window.partitionBy(key).orderBy(F.col(date).desc(), *ties)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, date: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Each left row with the last right row of its key dated on or before the left row's own ``at``.

    Both sides are laid end to end and the last right row is carried forward,
    so a key's rows are sorted once and no pairs are made.  Columns of
    ``right`` other than the key come back as they are; null where none fits.
    """
    carried = [c for c in right.columns if c != key]
    one = left.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(_struct(right, carried)).alias("_right"), *[F.lit(None).alias(f"_t{i}") for i in range(len(ties))])
    two = right.select(key, F.col(date).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_left"), F.struct(*carried).alias("_right"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)])
    order = Window.partitionBy(key).orderBy("_at", "_side", *[F.desc(f"_t{i}") for i in range(len(ties))]).rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two.where(F.col(date).isNotNull()))
    return both.withColumn("_right", F.last("_right", ignorenulls=True).over(order)).where("_side = 1").select("_left.*", "_right.*")


def _struct(df: DataFrame, columns: Sequence[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; end the order with a unique column to be deterministic."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], k: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` names a column for the place from 1."""
    name = rank or "_rank"
    found = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return found if rank else found.drop(name)


def first_seen(df: DataFrame, by: Sequence[str | Column], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def upsert_latest(log: DataFrame, key: str, *order: Column) -> DataFrame:
    """The table after all writes of ``log``: the last row of each key, by aggregation without a sort."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(key, "_row.*")


def share_of_total(df: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """``name``: a row's percentage of all fetched rows' sum (0 counts as 1).  For reports of a few rows."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(name, percent(F.col(value), total, digits))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole * 100 in decimals, where a whole of 0 counts as 1."""
    whole = F.coalesce(whole, F.lit(0))
    guarded = F.when(whole == 0, F.lit(1)).otherwise(whole).cast("decimal(20,2)")
    return F.round(part.cast("decimal(20,2)") * 100 / guarded, digits).cast("double")


def growth(df: DataFrame, value: str, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Growth over the row before in percent (one decimal); 0 for the first and after values that aren't positive."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    ratio = (F.col(value) - before).cast("decimal(20,2)") * 100 / before.cast("decimal(20,2)")
    return df.withColumn(name, F.coalesce(F.when(before > 0, F.round(ratio, 1)), F.lit(0)).cast("double"))


def round_robin(items: DataFrame, item_order: Sequence[Column], slots: DataFrame, slot_order: Sequence[Column]) -> DataFrame:
    """Items dealt to slots in turn by rank; slots' columns are joined on.  For lists of report size."""
    ranked = slots.withColumn("_slot", F.row_number().over(Window.orderBy(*slot_order)) - 1)
    dealt = items.withColumn("_item", F.row_number().over(Window.orderBy(*item_order)) - 1)
    n = max(1, slots.count())
    return dealt.withColumn("_slot", F.pmod("_item", F.lit(n))).join(ranked, "_slot").drop("_slot", "_item")


def prefix_budget(df: DataFrame, by: Sequence[str], size: Column, budget: int, *order: Column) -> DataFrame:
    """Rows in order until their sizes' running sum would pass the budget; the cut is at the first overflow."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(window)).where(F.col("_used") <= budget).drop("_used")


def with_default(df: DataFrame, matches: Column, *order: Column) -> DataFrame:
    """The first row that matches, or else the first row in order."""
    return df.orderBy(F.coalesce(matches, F.lit(False)).desc(), *order).limit(1)


def union_all(*parts: DataFrame) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require_known(wanted: DataFrame, known: DataFrame, key: str) -> None:
    """Raise KeyError with up to ten keys of ``wanted`` that ``known`` lacks."""
    missing = [r[0] for r in wanted.select(key).join(known.select(key), key, "left_anti").distinct().orderBy(key).limit(10).collect()]
    if missing:
        raise KeyError(f"unknown {key}: {', '.join(map(str, missing))}")


def require_unique(df: DataFrame, key: str) -> None:
    """Raise ValueError where a key has several rows, so joins on it can't fan out."""
    found = df.groupBy(key).count().where("count > 1").orderBy(key).limit(10).collect()
    if found:
        raise ValueError(f"repeated {key}: {', '.join(str(r[0]) for r in found)}")
