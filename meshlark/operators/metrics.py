"""Forecast error metrics as aggregate columns, and the reports built from them.

Standard deviations of a target are sample ones; fitted statistics elsewhere are population ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.operators.windows import gradient_location

EPS = 1e-7


def _mse(x: Column, y: Column) -> Column:
    return F.avg((x - y) * (x - y))


def _mae(x: Column, y: Column) -> Column:
    return F.avg(F.abs(x - y))


def _norm(y: Column, kind: str) -> Column:
    return F.avg(y * y) if kind == "norm" else F.var_samp(y)


def _nmse(x: Column, y: Column, kind: str = "norm") -> Column:
    return _mse(x, y) / (_norm(y, kind) + EPS)


#: name -> aggregate of a prediction and a target column.
METRICS = {
    "MSE": _mse,
    "MAE": _mae,
    "NMAE": lambda x, y: _mae(x, y) / (F.avg(F.abs(y)) + EPS),
    "NMSE": _nmse,
    "RMSE": lambda x, y: F.sqrt(_mse(x, y)),
    "NRMSE": lambda x, y: F.sqrt(_nmse(x, y)),
    "RelativeL2": lambda x, y: F.sqrt(_nmse(x, y)),
    "VMSE": lambda x, y: _nmse(x, y, "std"),
    "VRMSE": lambda x, y: F.sqrt(_nmse(x, y, "std")),
    "LInfinity": lambda x, y: F.max(F.abs(x - y)),
    "PearsonR": lambda x, y: F.covar_pop(x, y) / (F.stddev_samp(x) * F.stddev_samp(y) + EPS),
}


def metric(name: str, x: str, y: str) -> Column:
    if name not in METRICS:
        raise KeyError(f"no metric {name}; there are {', '.join(METRICS)}")
    return METRICS[name](F.col(x).cast("double"), F.col(y).cast("double"))


def evaluate(pairs: DataFrame, keys: list[str], names: list[str], x: str = "prediction", y: str = "target") -> DataFrame:
    """One row of keys with a column for each metric: one pass, combined before its shuffle."""
    return pairs.groupBy(*keys).agg(*[metric(n, x, y).alias(n) for n in names])


def evaluate_levels(pairs: DataFrame, keys: list[str], leaf: str, level: str, names: list[str], x: str = "prediction", y: str = "target") -> DataFrame:
    """Each metric per leaf, then its mean over the leaves of a level; RelativeL2 pools the leaves' pixels."""
    pooled = [n for n in names if n == "RelativeL2"]
    single = [n for n in names if n != "RelativeL2"]
    out = evaluate(pairs, [*keys, level, leaf], single, x, y).groupBy(*keys, level).agg(F.count("*").alias("leaves"), *[skipping_mean(n).alias(n) for n in single])
    if pooled:
        out = out.join(evaluate(pairs, [*keys, level], pooled, x, y), [*keys, level])
    return out


def skipping_mean(name: str) -> Column:
    """Mean without nulls and NaN; null where nothing is left."""
    return F.avg(F.when(~F.isnan(name), F.col(name)))


def report(rows: DataFrame, step: str, mse: str, metrics: list[str]) -> DataFrame:
    """One row a step: cell_RMSE is the root of the mean MSE, every other column the mean of its metric."""
    return rows.groupBy(step).agg(F.sqrt(skipping_mean(mse)).alias("cell_RMSE"), *[skipping_mean(m).alias(m) for m in metrics])


def pooled_mse(rows: DataFrame, keys: list[str], squared: str, pixels: str) -> DataFrame:
    """Squared error summed over levels by the number of pixels summed over levels."""
    return rows.groupBy(*keys).agg((F.sum(squared) / F.sum(pixels)).alias("MSE"))


def lp_loss(pairs: DataFrame, keys: list[str], p: int = 2, relative: bool = False, eps: float = 1e-12, x: str = "prediction", y: str = "target") -> DataFrame:
    """p-norm of the error per keys, or of the error by that of the target."""
    power = lambda c: F.sum(F.pow(F.abs(c), F.lit(float(p))))
    root = lambda s: F.sqrt(s + eps) if p == 2 else F.pow(s, F.lit(1.0 / p))
    d = F.col(x) - F.col(y)
    loss = root(power(d)) / root(power(F.col(y))) if relative else root(power(d))
    return pairs.groupBy(*keys).agg(loss.alias("loss"))


def masked_mse(pairs: DataFrame, keys: list[str], mask: str, x: str = "prediction", y: str = "target") -> DataFrame:
    """Mean square error under the mask, in one pass; keys with nothing under it have no row."""
    m = F.col(mask).cast("double")
    sums = pairs.groupBy(*keys).agg(F.sum(m * F.pow(F.col(x) - F.col(y), F.lit(2.0))).alias("loss"), F.sum(m).alias("_m"))
    return sums.where("_m > 0").select(*keys, (F.col("loss") / F.col("_m")).alias("loss"))


def relative_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Largest abs(a - b) / max(abs(b), 1e-30) over the common keys, for each column."""
    joined = a.alias("a").join(b.alias("b"), key)
    return joined.agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / F.greatest(F.abs(F.col(f"b.{c}")), F.lit(1e-30))).alias(c) for c in columns])


def multiscale_loss(pairs: DataFrame, keys: list[str], leaf: list[str], norm: bool = True, x: str = "prediction", y: str = "target") -> DataFrame:
    """Mean over leaves of their norms, or (norm False) the pixel-weighted mean square."""
    if not norm:
        return pairs.groupBy(*keys).agg(_mse(F.col(x), F.col(y)).alias("loss"))
    return lp_loss(pairs, [*keys, *leaf], x=x, y=y).groupBy(*keys).agg(F.avg("loss").alias("loss"))


def full_field_loss(pairs: DataFrame, keys: list[str], channel: str, eps: float = 1e-12, x: str = "prediction", y: str = "target") -> DataFrame:
    """Squares summed over all leaves for each channel, one root each, then the mean of the channels."""
    d = F.col(x) - F.col(y)
    return pairs.groupBy(*keys, channel).agg(F.sqrt(F.sum(d * d) + eps).alias("_l")).groupBy(*keys).agg(F.avg("_l").alias("loss"))


def level_counts(leaves: DataFrame, keys: list[str], max_level: int, level: str = "level") -> DataFrame:
    """Leaves of each level, 0 where there are none."""
    spine = leaves.select(*keys).distinct().withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(max_level))))
    return spine.join(leaves.groupBy(*keys, level).agg(F.count("*").alias("n")), [*keys, level], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def conserved_difference(pairs: DataFrame, keys: list[str], dx: float, dy: float, x: str = "prediction", y: str = "target") -> DataFrame:
    """Absolute difference of the integrals."""
    return pairs.groupBy(*keys).agg(F.abs((F.sum(x) - F.sum(y)) * dx * dy).alias("difference"))


def fronts(profile: DataFrame, keys: list[str], x: str, v: str, dx: float) -> DataFrame:
    """(keys, location): per row of pixels the first place of the steepest slope of v along x, times dx."""
    return gradient_location(profile, keys, x, v, dx)


def peaks(profile: DataFrame, keys: list[str], x: str, v: str, dx: float) -> DataFrame:
    """(keys, location): per row of pixels the first place of the largest v, times dx."""
    return profile.groupBy(*keys).agg((F.max_by(x, F.struct(F.col(v), -F.col(x))) * F.lit(dx)).alias("location"))


def detonation(pixels: DataFrame, dx: float, dy: float, pressure: str, heat: str, density: str, energy: str, run: str = "run", step: str = "step", field: str = "field", x: str = "x", y: str = "y", pred: str = "prediction", true: str = "target") -> DataFrame:
    """One row a step: means over runs of each field's relative L2 and largest error (long form in the
    maps l2 and linf), of the root mean square errors of shock and induction length over rows of
    pixels, and of the absolute differences of mass and energy.
    """
    by = [run, step]
    d = F.col(pred) - F.col(true)
    each = pixels.groupBy(*by, field).agg((F.sqrt(F.sum(d * d)) / (F.sqrt(F.sum(F.col(true) * F.col(true))) + 1e-12)).alias("l2"), F.max(F.abs(d)).alias("linf"), F.abs(F.sum(d) * dx * dy).alias("drift"))
    each = each.groupBy(step, field).agg(F.avg("l2").alias("l2"), F.avg("linf").alias("linf"), F.avg("drift").alias("drift"))
    errors = each.groupBy(step).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "l2")))).alias("l2"),  # a row for each field
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "linf")))).alias("linf"),
        F.max(F.when(F.col(field) == density, F.col("drift"))).alias("mass_abs_err"),
        F.max(F.when(F.col(field) == energy, F.col("drift"))).alias("energy_abs_err"),
    )
    rows = [*by, y]
    of = lambda f, name: pixels.where(F.col(field) == name).select(*rows, x, F.col(f).alias("v"))
    found = [shape(of(f, name), rows, x, "v", dx).withColumnRenamed("location", out) for shape, name, f, out in ((fronts, pressure, true, "ts"), (fronts, pressure, pred, "ps"), (peaks, heat, true, "th"), (peaks, heat, pred, "ph"))]
    at = found[0].join(found[1], rows).join(found[2], rows).join(found[3], rows)
    shock, induction = F.col("ts") - F.col("ps"), (F.col("ts") - F.col("th")) - (F.col("ps") - F.col("ph"))
    at = at.groupBy(*by).agg(F.sqrt(F.avg(shock * shock)).alias("shock"), F.sqrt(F.avg(induction * induction)).alias("induction"))
    at = at.groupBy(step).agg(F.avg("shock").alias("shock_rmse"), F.avg("induction").alias("induction_rmse"))
    return errors.join(at, step)


def combined(adaptive: DataFrame, regular: DataFrame, truth: DataFrame, keys: list[str], names: list[str], level: str | None = None) -> DataFrame:
    """Metrics of two models against the same truth side by side: name_adaptive and name_regular, per keys
    (and per level). All three are (keys, cell..., v) at the same cells; cells that one lacks do not count."""
    cells = [c for c in truth.columns if c != "v"]
    met = truth.withColumnRenamed("v", "target").join(adaptive.select(*cells, F.col("v").alias("adaptive")), cells).join(regular.select(*cells, F.col("v").alias("regular")), cells)
    by = [*keys, level] if level else keys
    return met.groupBy(*by).agg(*[metric(n, model, "target").alias(f"{n}_{model}") for model in ("adaptive", "regular") for n in names])


def report_schema(columns: list[str]) -> str:
    """Which models a table of results has: combined, adaptive_only, regular_only or unknown."""
    has = lambda scope, model="": any(c.startswith(scope) and model in c for c in columns)
    if any(has(s, "_adaptive_") and has(s, "_regular_") for s in ("uniform_", "level_")):
        return "combined"
    if not has("uniform_"):
        return "unknown"
    return "adaptive_only" if has("level_") else "regular_only"


def report_column(schema: str, model: str, metric_name: str, scope: str, field: str) -> str | None:
    """The column of a model's metric; None where that table has none."""
    if schema == "combined":
        return f"{scope}_{metric_name}_{model}_{field}"
    if model == "regular" and (schema != "regular_only" or scope != "uniform"):
        return None
    return f"{scope}_{metric_name}_{field}"


def long_report(wide: DataFrame, step: str = "Step") -> DataFrame:
    """(step, scope, metric, model, field, value) of a table with a column for each of them."""
    schema, parts = report_schema(wide.columns), []
    for c in wide.columns:
        m = re.match(r"(uniform|level_\d+)_([A-Za-z0-9]+)_(?:(adaptive|regular)_)?(.+)$", c)
        if m:
            model = m[3] or ("regular" if schema == "regular_only" else "adaptive")
            parts.append(F.struct(F.lit(m[1]).alias("scope"), F.lit(m[2]).alias("metric"), F.lit(model).alias("model"), F.lit(m[4]).alias("field"), F.col(f"`{c}`").cast("double").alias("value")))
    if not parts:
        raise ValueError("no column names a metric")
    return wide.select(F.col(step).alias("step"), F.explode(F.array(*parts)).alias("r")).select("step", "r.*")


def field_mean(long: DataFrame, keys: list[str], fields: list[str] | None = None, field: str = "field", v: str = "value") -> DataFrame:
    """Mean over the fields that a row has; nulls and NaN do not count."""
    chosen = long if fields is None else long.where(F.col(field).isin(*fields))
    return chosen.groupBy(*keys).agg(F.avg(F.when(~F.isnan(v), F.col(v))).alias("mean"))
