"""Boosted trees on the previous value, grown over the rows of all SKUs at once.

The trees of `functions.fits` learn from one SKU's few points each. Here MLlib grows one set of trees
over the cluster from every SKU's steps, as shares of the SKU's own mean, so short series borrow
from long ones. Only the bounds of bins and the trees come to the driver: at most BINS - 1 and
TREES x (2^DEPTH - 1) numbers. Beyond ROWS rows the trees learn from weighted cells of rows, so what
the rounds of boosting read and keep is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the boosted model, and the fewest points it takes.
TREES, DEPTH, RATE, SHARE = 50, 2, 0.1, 0.9
LEAST_POINTS = 6
#: Bins of the previous value. Beyond so many rows each bin's are dealt to so many groups and merged there.
BINS, ROWS, GROUPS = 256, 1 << 20, 1 << 12


def scale(quantities: Column) -> Column:
    """A SKU's mean, or 1 where that is not positive."""
    mean = F.try_divide(F.aggregate(quantities, F.lit(0.0), lambda a, q: a + q), F.size(quantities))
    return F.when(mean > 0, mean).otherwise(F.lit(1.0))


def usable(quantities: Column) -> Column:
    return F.coalesce(F.size(quantities) >= LEAST_POINTS, F.lit(False))


def lag_rows(series: DataFrame, quantities: str = "quantities", dates: str = "dates") -> DataFrame:
    """(sku, date, previous, value): each point of a series with the one before, as shares of the series' mean.

    SKUs of fewer than six points give no rows. A packed series is one row, so nothing is shuffled.
    """
    values = F.col(quantities)
    scaled = series.where(usable(values)).select("sku", F.col(dates).alias("_d"), values.alias("_q"), scale(values).alias("_s"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("_q") - 1),
        lambda i: F.struct(F.get("_d", i).alias("date"), (F.get("_q", i - 1) / F.col("_s")).alias("previous"), (F.get("_q", i) / F.col("_s")).alias("value")),
    )
    return scaled.select("sku", F.inline(steps))


def _cuts(node, below: list[float]) -> list[float]:
    if node.getClass().getSimpleName() == "LeafNode":
        return below
    return _cuts(node.rightChild(), _cuts(node.leftChild(), [*below, node.split().threshold()]))


def _at(node, x: float) -> float:
    while node.getClass().getSimpleName() != "LeafNode":
        node = node.leftChild() if x <= node.split().threshold() else node.rightChild()
    return node.prediction()


@dataclass(frozen=True)
class PooledTrees:
    """All trees as one step function: `values[i]` holds up to `cuts[i]`, the last beyond all cuts."""

    cuts: tuple[float, ...]
    values: tuple[float, ...]

    @classmethod
    def of(cls, model: GBTRegressionModel) -> PooledTrees:
        roots = [tree._call_java("rootNode") for tree in model.trees]
        cuts = sorted({c for root in roots for c in _cuts(root, [])})
        at = [*cuts, cuts[-1] + 1.0] if cuts else [0.0]
        return cls(tuple(cuts), tuple(sum(w * _at(r, x) for w, r in zip(model.treeWeights, roots)) for x in at))

    def value(self, x: Column) -> Column:
        """The trees' sum at x, by binary search over the cuts."""
        cuts = F.array(*map(F.lit, self.cuts)) if self.cuts else F.array().cast("array<double>")
        bits = [1 << i for i in reversed(range(len(self.cuts).bit_length()))]
        # How many cuts lie below x.
        low = F.aggregate(
            F.array(*map(F.lit, bits)) if bits else F.array().cast("array<int>"), F.lit(0),
            lambda n, by: F.when(F.get(cuts, n + by - 1) < x, n + by).otherwise(n),
        )
        return F.get(F.array(*map(F.lit, self.values)), low)

    def path(self, quantities: Column, steps: Column) -> Column:
        """Forecast array of a series: each step is clipped at 0 and fed back; NULL for fewer than six points or no steps."""
        size = scale(quantities)
        start = F.struct((F.element_at(quantities, -1) / size).alias("last"), F.array().cast("array<double>").alias("path"))

        def step(state: Column, _: Column) -> Column:
            found = F.transform(F.array(state["last"]), lambda x: F.greatest(self.value(x), F.lit(0.0)))[0]
            return F.struct(found.alias("last"), F.concat(state["path"], F.array(found)).alias("path"))

        shares = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, lambda s: s["path"])
        return F.when(usable(quantities) & (steps > 0), F.transform(shares, lambda v: v * size))


def cells(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """(bin, value, weight) from (previous, value, group): the rows of one bin and group as their mean and number.

    Bin i begins at cut i - 1; every row is in one cell. A tree sees the bin of a row, not its
    previous value, and the rows of a cell share their bin. So means and weights give the splits and
    leaves that the rows would give. The sample of a round is drawn from cells.
    """
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="previous", outputCol="bin", handleInvalid="keep")
    # Without metadata, which would make bins categories; they have an order.
    binned = split.transform(rows).withColumn("bin", F.col("bin").alias("bin", metadata={})).groupBy("bin", "group")
    return binned.agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("weight")).drop("group")


def _vectors(rows: DataFrame, name: str) -> DataFrame:
    return VectorAssembler(inputCols=[name], outputCol="features").transform(rows)


def fit_pooled(
    series: DataFrame, quantities: str = "quantities", dates: str = "dates", trees: int = TREES, depth: int = DEPTH, seed: int = 0
) -> PooledTrees | None:
    """Trees over the lag rows of all SKUs, grown by MLlib; None if no SKU has enough points."""
    rows = lag_rows(series, quantities, dates).where(F.col("previous").isNotNull() & F.col("value").isNotNull())
    boosted = GBTRegressor(
        labelCol="value", maxIter=trees, maxDepth=depth, stepSize=RATE, subsamplingRate=SHARE, maxBins=BINS, seed=seed
    )
    # Read twice; a lost executor's part is made again from the series.
    dealt = rows.select("previous", "value", F.pmod(F.xxhash64("sku", "date"), F.lit(GROUPS)).cast("int").alias("group"))
    dealt.persist(StorageLevel.DISK_ONLY)
    try:
        bounds = F.percentile_approx("previous", [i / BINS for i in range(1, BINS)], 40 * BINS)
        n, cuts = dealt.agg(F.count("*"), F.array_distinct(bounds)).first()
        if not n:
            return None
        if n <= ROWS:
            return PooledTrees.of(boosted.fit(_vectors(rows, "previous").select("features", "value")))
        found = PooledTrees.of(boosted.setWeightCol("weight").fit(_vectors(cells(dealt, cuts), "bin").select("features", "value", "weight")))
    finally:
        dealt.unpersist()
    # What lies above bin i begins at cut i, and a step holds up to its cut.
    return PooledTrees(tuple(math.nextafter(cuts[int(c)], -math.inf) for c in found.cuts), found.values)
