"""Running aggregates along one total order by two levels: inside buckets of the order, and over a row a bucket. No task holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order that is cut by its own quantiles.
BUCKETS = 200


def carried(rows: DataFrame, bucket: str, down: bool = False, **found: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """Adds, for each name, the aggregate of all rows in earlier buckets: null in the first. ``found``: name -> (aggregate of a bucket's
    rows, aggregate of such values). ``down``: from the highest bucket. One window runs over a row a bucket; ``bucket`` must not be null."""
    earlier = Window.orderBy(F.col(bucket).desc() if down else F.col(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(bucket).agg(*[inside.alias(n) for n, (inside, _) in found.items()])
    return rows.join(each.select(bucket, *[over(n).over(earlier).alias(n) for n, (_, over) in found.items()]), bucket)


def by_quantiles(rows: DataFrame, value: str, bucket: str) -> DataFrame:
    """Adds ``bucket``, which grows with a double ``value`` and holds about the same number of rows each; nulls get -1. Some 200 quantiles
    reach the driver."""
    cuts = rows.select(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 10_000)).first()[0]
    inner = sorted({c for c in cuts or () if abs(c) < float("inf")})
    out = Bucketizer(splits=[float("-inf"), *(inner or [0.0]), float("inf")], inputCol=value, outputCol=bucket, handleInvalid="keep").transform(rows)
    return out.withColumn(bucket, F.when(F.col(value).isNull(), -1.0).otherwise(F.col(bucket)))
