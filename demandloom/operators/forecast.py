"""Model fits, hold-out scores, model choice and forecast points.

A fit table has one row per SKU: its packed series, the hold-out scores, the chosen model and
the forecast array. Only the three model fits run in Python; the split, the scores and the
choice are expressions on the packed row, so the series is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.baseline import DEFAULT_BASE, band, baseline_value
from demandloom.functions.fits import model_path
from demandloom.functions.scores import mae, mape
from demandloom.operators.pooled import fit_pooled
from demandloom.session import bound_batches

# Models in tie order with their metric prefix, and codes for the chosen one.
MODELS = {"arima": "arima", "prophet": "prophet", "xgboost": "xgb"}
MODEL_CODES = {"stub": 0.0, "arima": 1.0, "prophet": 2.0, "xgboost": 3.0}
LEAST_HISTORY = 4

# Description of a forecast.
METADATA = {
    "model_name": "arima_prophet_xgb_ensemble",
    "model_version": "1.0.0",
    "components": ["arima", "prophet", "xgboost"],
    "notes": "Per-SKU model selection with ARIMA, Prophet, and XGBoost; quantiles approximated from mean.",
}


def forced_name(model: str | None) -> str | None:
    """Model to force, or None for the automatic choice."""
    name = {"auto": None, "baseline": "stub"}.get(model, model) if model else None
    return name if name in MODEL_CODES else None


def split_holdout(series: DataFrame) -> DataFrame:
    """Adds `history` and `n_val`, and the arrays before (`train`) and in (`holdout`) the hold-out."""
    n = F.size("quantities")
    n_val = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 4).cast("int")))
    n_val = F.when(n >= LEAST_HISTORY, n_val)
    return (
        series.withColumns({"history": n, "n_val": n_val})
        .withColumns(
            {
                "train_dates": F.slice("dates", F.lit(1), n - F.col("n_val")),
                "train": F.slice("quantities", F.lit(1), n - F.col("n_val")),
                "holdout_dates": F.slice("dates", n - F.col("n_val") + 1, F.col("n_val")),
                "holdout": F.slice("quantities", n - F.col("n_val") + 1, F.col("n_val")),
            }
        )
    )


def score_paths(split: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """Adds `<prefix>_mape` and `<prefix>_mae` per model from its path over the hold-out."""
    named = split.withColumns({f"_{model}": path for model, path in paths.items()})
    scores = {}
    for model in paths:
        prefix = MODELS.get(model, model)
        scores[f"{prefix}_mape"] = mape(F.col("holdout"), F.col(f"_{model}"))
        scores[f"{prefix}_mae"] = mae(F.col("holdout"), F.col(f"_{model}"))
    return named.withColumns(scores).drop(*[f"_{model}" for model in paths])


def best_model(models: dict[str, str] = MODELS) -> Column:
    """Struct (mape, rank, model, mae) of the least MAPE; ties go to the earlier model."""
    ranked = [
        F.when(
            F.col(f"{prefix}_mape").isNotNull(),
            F.struct(
                F.col(f"{prefix}_mape").alias("mape"), F.lit(i).alias("rank"),
                F.lit(model).alias("model"), F.col(f"{prefix}_mae").alias("mae"),
            ),
        )
        for i, (model, prefix) in enumerate(models.items())
    ]
    return F.array_min(F.array(*ranked))


def series_mean() -> Column:
    total = F.aggregate("quantities", F.lit(0.0), lambda acc, q: acc + q)
    return F.coalesce(F.try_divide(total, F.size("quantities")), F.lit(DEFAULT_BASE))


def _no_path() -> Column:
    return F.lit(None).cast("array<double>")


def _days(dates: Column) -> Column:
    return F.transform(dates, lambda d: F.unix_date(d).cast("double"))


def fit_models(
    series: DataFrame, horizon: Column, model: str | None = None, true_holdout: bool = False, pooled: bool = False
) -> DataFrame:
    """Fit table over packed series.

    With `pooled`, the boosted trees are grown over all SKUs together, see `operators.pooled`: once
    without the hold-outs, for the scores, and once with all points. Both are jobs of their own over
    the series, which should then be a stored table.

    By default the seasonal model is scored on the days that begin `n_val` points before the
    end of its own training part, as the original service does; `true_holdout` scores it on
    the hold-out days.
    """
    bound_batches(series.sparkSession)
    forced = forced_name(model)
    has_steps = F.size(horizon) > 0
    days, values = _days(F.col("train_dates")), F.when(has_steps, F.col("train"))
    at = _days(F.col("holdout_dates"))
    if not true_holdout:
        start = F.unix_date(F.element_at("train_dates", -F.col("n_val"))).cast("double")
        at = F.transform(F.sequence(F.lit(0), F.col("n_val") - 1), lambda i: start + i)
    split = split_holdout(series)
    holdout_paths = {m: model_path(m, days, values, at, F.col("n_val")) for m in MODELS}
    if pooled:
        trees = fit_pooled(split, "train", "train_dates")
        holdout_paths["xgboost"] = _no_path() if trees is None else trees.path(values, F.col("n_val"))
    scored = score_paths(split, holdout_paths)

    wanted = F.lit(forced) if forced else F.coalesce(best_model()["model"], F.lit("stub"))
    scored = scored.withColumn(
        "wanted", F.when((F.col("history") >= LEAST_HISTORY) & has_steps, wanted).otherwise(F.lit("stub"))
    )
    # Each model gets values only on the rows that chose it, so every row is fitted once more.
    paths = {
        m: model_path(m, _days(F.col("dates")), F.when(F.col("wanted") == m, F.col("quantities")), _days(horizon), F.size(horizon))
        for m in MODELS
        if forced in (None, m)
    }
    if pooled and "xgboost" in paths:
        trees, chosen = fit_pooled(series), F.when(F.col("wanted") == "xgboost", F.col("quantities"))
        paths["xgboost"] = _no_path() if trees is None else trees.path(chosen, F.size(horizon))
    final = scored.withColumns({f"_{m}": p for m, p in paths.items()})
    path = F.coalesce(*[F.col(f"_{m}") for m in paths]) if paths else F.lit(None).cast("array<double>")
    scores = [f"{prefix}_{kind}" for prefix in MODELS.values() for kind in ("mape", "mae")]
    return final.withColumn("path", path).select(
        "sku",
        "history",
        series_mean().alias("base"),
        F.when(F.col("path").isNull(), F.lit("stub")).otherwise(F.col("wanted")).alias("model"),
        *scores,
        horizon.alias("horizon"),
        "path",
    )


def fit_baseline(series: DataFrame, horizon: Column) -> DataFrame:
    """Fit table with the baseline for every SKU and no scores."""
    scores = [f"{prefix}_{kind}" for prefix in MODELS.values() for kind in ("mape", "mae")]
    return series.select(
        "sku",
        F.size("quantities").alias("history"),
        series_mean().alias("base"),
        F.lit("stub").alias("model"),
        *[F.lit(None).cast("double").alias(s) for s in scores],
        horizon.alias("horizon"),
        F.lit(None).cast("array<double>").alias("path"),
    )


def forecast_points(fits: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(sku, date, mean, q10, q50, q90) per step; with `requested`, one run per request line."""
    rows = fits if requested is None else requested.select("sku", "seq").join(fits, "sku")
    keep = ["sku"] if requested is None else ["seq", "sku"]
    steps = rows.select(*keep, "base", "path", F.size("horizon").alias("steps"), F.posexplode("horizon").alias("step", "date"))
    mean = F.coalesce(F.get("path", F.col("step")), baseline_value(F.col("base"), F.col("step"), F.col("steps")))
    return steps.select(*keep, "date", mean.alias("mean")).select(*keep, "date", "mean", *band(F.col("mean")))


def baseline_points(daily: DataFrame, horizon: Column) -> DataFrame:
    """Baseline points straight from daily demand, without packing any series."""
    base = daily.groupBy("sku").agg(F.avg("quantity").alias("base"))
    steps = base.select("sku", "base", F.size(horizon).alias("steps"), F.posexplode(horizon).alias("step", "date"))
    mean = baseline_value(F.col("base"), F.col("step"), F.col("steps"))
    return steps.select("sku", "date", mean.alias("mean")).select("sku", "date", "mean", *band(F.col("mean")))


def model_code(model: Column, codes: dict[str, float] = MODEL_CODES) -> Column:
    code = F.lit(-1.0)
    for name, value in codes.items():
        code = F.when(model == name, F.lit(value)).otherwise(code)
    return code


def metrics(fits: DataFrame, models: dict[str, str] = MODELS, codes: dict[str, float] = MODEL_CODES) -> DataFrame:
    """(sku, key, value), keyed `<sku>.<metric>`: scores that exist, and the model's code."""
    names = [f"{prefix}_{kind}" for prefix in models.values() for kind in ("mape", "mae")]
    pairs = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]
    pairs.append(F.struct(F.lit("chosen_model").alias("name"), model_code(F.col("model"), codes).alias("value")))
    return (
        fits.select("sku", F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .select("sku", F.concat_ws(".", "sku", "name").alias("key"), "value")
    )


def chosen_models(fits: DataFrame) -> DataFrame:
    return fits.select("sku", "model")
