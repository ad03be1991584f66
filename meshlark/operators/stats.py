"""Statistics fitted on fields, and the transforms that use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.selection import seeded_key
from meshlark.operators.windows import quantiles, running_sum


def finite(v: str) -> Column:
    c = F.col(v).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def mean_std(values: DataFrame, field: str = "field", v: str = "v") -> DataFrame:
    """Population mean and std of the finite values; std under 1e-12 is 1, no values give (0, 1)."""
    x = finite(v)
    sums = values.groupBy(field).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    var = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)))
    std = F.when(F.col("n") == 0, 1.0).when(F.sqrt(var) < 1e-12, 1.0).otherwise(F.sqrt(var))
    return sums.select(field, "n", F.when(F.col("n") == 0, 0.0).otherwise(F.col("s") / F.col("n")).alias("mean"), std.alias("std"))


def moments(values: DataFrame, field: str = "field", v: str = "v") -> DataFrame:
    """Mergeable moments: count, mean and squared deviations; partial aggregates merge as built in."""
    return values.groupBy(field).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.stddev_pop(v).alias("std"))


def weighted_quantile(values: DataFrame, q: float, keys: list[str], v: str = "v", w: str = "w") -> DataFrame:
    """Smallest v whose cumulative weight reaches q of the total: weights of equal values are added
    before the running sum, which goes over ranges of them."""
    distinct = values.groupBy(*keys, v).agg(F.sum(w).alias("weight"))
    run = running_sum(distinct, keys, [v], "weight", "upto")
    whole = distinct.groupBy(*keys).agg(F.sum("weight").alias("whole"))
    return run.join(whole, keys).where(F.col("upto") >= F.lit(q) * F.col("whole")).groupBy(*keys).agg(F.min(v).alias("quantile"))


def standardize(values: DataFrame, stats: DataFrame, eps: float = 0.0, field: str = "field", v: str = "v") -> DataFrame:
    """(v - mean) / (std + eps) by field; a field without statistics raises when it is read.

    stats, one row a field, goes to all tasks: fields are few, and a shuffle would put each whole into one task.
    """
    joined = values.join(F.broadcast(stats.select(field, "mean", "std")), field, "left")
    checked = F.when(F.col("mean").isNull(), F.raise_error(F.concat(F.lit("no statistics for field "), F.col(field))).cast("double")).otherwise((F.col(v) - F.col("mean")) / (F.col("std") + eps))
    return joined.withColumn(v, checked).drop("mean", "std")


def destandardize(values: DataFrame, stats: DataFrame, eps: float = 0.0, field: str = "field", v: str = "v") -> DataFrame:
    return values.join(F.broadcast(stats.select(field, "mean", "std")), field).withColumn(v, F.col(v) * (F.col("std") + eps) + F.col("mean")).drop("mean", "std")


def merge_energy(values: DataFrame, keys: list[str], prefix: str = "energy_", name: str = "energy", field: str = "field", v: str = "v") -> DataFrame:
    """All fields of the prefix summed into one; NaN and null count as 0."""
    named = F.when(F.col(field).startswith(prefix), F.lit(name)).otherwise(F.col(field))
    return values.groupBy(*keys, named.alias(field)).agg(F.sum(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))).alias(v))


def asinh_scale(c: Column, scale: float, mean: float = 0.0, std: float = 1.0) -> Column:
    return (F.asinh(c / scale) - mean) / std


def asinh_unscale(c: Column, scale: float, mean: float = 0.0, std: float = 1.0) -> Column:
    return F.sinh(c * std + mean) * scale


class Composed:
    """Transforms in order; the inverse in reverse order, without those that have none."""

    def __init__(self, *steps):
        self.steps = steps

    def forward(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = df.transform(s[0])
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            if len(s) > 1 and s[1] is not None:
                df = df.transform(s[1])
        return df


def robust_range(values: DataFrame, keys: list[str], low: float = 0.005, high: float = 0.995, v: str = "v") -> DataFrame:
    """Linear-interpolated quantiles, by running counts over ranges."""
    return quantiles(values, keys, {"low": low, "high": high}, v)


def block_mean(field: DataFrame, factor: int, keys: list[str], n: int) -> DataFrame:
    """Mean over factor x factor blocks of an n x n grid; the incomplete last blocks are cut off."""
    whole = n // factor * factor
    return field.where((F.col("x") < whole) & (F.col("y") < whole)).groupBy(*keys, F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(F.avg("v").alias("v"))


def roll(field: DataFrame, shift: Column, n: int, axis: str = "y") -> DataFrame:
    """Cyclic shift along an axis of length n."""
    return field.withColumn(axis, F.pmod(F.col(axis) + shift, F.lit(n)).cast("int"))


def crop(field: DataFrame, nx: int, ny: int, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Fractions of the domain, rounded outwards; at least one pixel stays."""
    import math

    lo = lambda n, f: min(n - 1, max(0, math.floor(n * f)))
    hi = lambda n, f, a: min(n, max(a + 1, math.ceil(n * f)))
    a, b = lo(nx, x0), lo(ny, y0)
    return field.where((F.col("x") >= a) & (F.col("x") < hi(nx, x1, a)) & (F.col("y") >= b) & (F.col("y") < hi(ny, y1, b)))


def residual(values: DataFrame, keys: list[str], t: str, last_input: int, v: str = "v", sign: int = -1) -> DataFrame:
    """Targets minus (or plus) the last input frame."""
    base = values.where(F.col(t) == last_input).select(*keys, F.col(v).alias("_base"))
    return values.where(F.col(t) > last_input).join(base, keys).withColumn(v, F.col(v) + sign * F.col("_base")).drop("_base")


def keep_ratio(step: Column, total: float, start: float, kind: str = "linear") -> Column:
    """Loss mask schedule from start to 1 at ``total`` steps."""
    t = F.least(F.lit(1.0), step / total)
    return F.lit(start) + (1 - start) * (t if kind == "linear" else (1 - F.cos(t * F.pi())) / 2)


def fit_statistics(cells: DataFrame, scalars: list[str], energies: list[str], seed: str, pixels: int = 64, q: float = 0.99, frame: str = "frame", cell: str = "cell") -> DataFrame:
    """(field, mean, std, scale): standardisation of scalar fields, and of the summed energies after asinh(e / scale).

    cells has a row for each frame and cell with a column for each field; only training frames should
    be in it. Pass 1: moments of the scalars, and the scale, the weighted inverted-CDF quantile q of
    the absolute energies of ``pixels`` cells a frame, chosen by a seeded hash and weighted by the
    cells that each stands for. Pass 2: moments of the scaled energies of all cells. Null and NaN
    count as 0; a scale or spread that is not positive raises.
    """
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = cells.select(frame, cell, *[clean(c).alias(c) for c in scalars], reduce(lambda a, b: a + b, [clean(c) for c in energies]).alias("energy"))
    by = Window.partitionBy(frame)
    chosen = rows.withColumn("nth", F.row_number().over(by.orderBy(seeded_key(seed, frame, cell)))).withColumn("cells", F.count("*").over(by)).where(F.col("nth") <= pixels)
    weight = F.col("cells") / F.least(F.col("cells"), F.lit(pixels))
    scale = weighted_quantile(chosen.select(F.lit(0).alias("all"), F.abs("energy").alias("v"), weight.alias("w")), q, ["all"]).first()
    if scale is None or not 0 < scale["quantile"] < float("inf"):
        raise ValueError("the energy quantile is not positive")
    s = float(scale["quantile"])
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in scalars], F.struct(F.lit("energy").alias("field"), F.asinh(F.col("energy") / s).alias("v")))).alias("r")).select("r.*")
    out = moments(long).withColumn("scale", F.when(F.col("field") == "energy", s))
    checked = F.when(F.col("std") > 0, F.col("std")).otherwise(F.raise_error(F.concat(F.lit("no spread in field "), F.col("field"))).cast("double"))
    return out.select("field", "n", "mean", checked.alias("std"), "scale")
