"""Forecasts against what came: splits in time, errors, rank correlation, hits, naive baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import avg_rank_percentile


def naive_forecasts(forecasts: DataFrame) -> DataFrame:
    """forecasts with the zero and the persistence forecast (a ticker's actual before) as models of their own."""
    w = Window.partitionBy("model", "ticker").orderBy("date")
    last = forecasts.withColumn("predicted", F.lag("actual").over(w)).where("predicted is not null")
    named = lambda df, kind: df.withColumn("model", F.concat("model", F.lit(kind)))
    return forecasts.unionByName(named(forecasts.withColumn("predicted", F.lit(0.0)), ":zero")).unionByName(named(last, ":persistence"))


def chrono_split(forecasts: DataFrame, train: float = 0.6, validation: float = 0.8) -> DataFrame:
    """forecasts with split: a model's dates cut at two fractions of their number.

    The training part has at least one date; the validation part too where there are two.
    """
    w = Window.partitionBy("model").orderBy("date")
    days = forecasts.select("model", "date").distinct().withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("model")))
    a = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    b = F.greatest(a + 1, F.floor(F.col("n") * validation))
    days = days.select("model", "date", F.when(F.col("k") <= a, "train").when(F.col("k") <= b, "validation").otherwise("holdout").alias("split"))
    return forecasts.join(days, ["model", "date"])


def forecast_errors(split: DataFrame) -> DataFrame:
    """model, split ('all' too): n, mae, rmse, hit (share of equal signs, 0 counts as up)."""
    e = F.col("predicted") - F.col("actual")
    measures = [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(((F.col("predicted") >= 0) == (F.col("actual") >= 0)).cast("int")).alias("hit")]
    both = split.select("model", "predicted", "actual", F.explode(F.array(F.lit("all"), F.col("split"))).alias("split"))
    return both.where("predicted is not null and actual is not null").groupBy("model", "split").agg(*measures)


def rank_quality(forecasts: DataFrame) -> DataFrame:
    """model: mean_rank_ic (over dates with two rows or more and no constant side), top_hit_rate, dates.

    A hit is a date on which the ticker with the largest forecast has the largest actual; ties to the first ticker.
    """
    f = forecasts.where("predicted is not null and actual is not null").withColumn("by", F.struct("model", "date"))
    f = avg_rank_percentile(avg_rank_percentile(f, "by", "predicted", "p"), "by", "actual", "a")
    w = lambda c: Window.partitionBy("model", "date").orderBy(F.desc(c), "ticker")
    f = f.withColumn("kp", F.row_number().over(w("predicted"))).withColumn("ka", F.row_number().over(w("actual")))
    varied = (F.count("*") >= 2) & (F.min("p") < F.max("p")) & (F.min("a") < F.max("a"))
    day = f.groupBy("model", "date").agg(F.when(varied, F.try_divide(F.covar_pop("p", "a"), F.stddev_pop("p") * F.stddev_pop("a"))).alias("ic"), F.max(((F.col("kp") == 1) & (F.col("ka") == 1)).cast("int")).alias("hit"))
    return day.groupBy("model").agg(F.avg("ic").alias("mean_rank_ic"), F.avg("hit").alias("top_hit_rate"), F.count("*").alias("dates"))


def calibration_ratio(forecasts: DataFrame) -> DataFrame:
    """model, ratio: mean forecast volatility over mean realised volatility, both not below 0; null if nothing was realised."""
    f = forecasts.where("predicted is not null and actual is not null")
    top, low = F.avg(F.greatest("predicted", F.lit(0.0))), F.avg(F.greatest("actual", F.lit(0.0)))
    return f.groupBy("model").agg(F.when(low > 0, top / low).alias("ratio"))


def evaluate_forecasts(forecasts: DataFrame, least: int = 2, volatility: bool = False) -> DataFrame:
    """(model, split, metric, value): errors by split, rank correlation, hits and, for volatilities, calibration.

    Naive forecasts are models of their own beside each. A model of fewer than ``least``
    forecasts gets one row, metric insufficient_data with its number of forecasts.
    """
    known = forecasts.where("predicted is not null and actual is not null")
    n = known.groupBy("model").agg(F.count("*").cast("double").alias("value"))
    few = n.where(F.col("value") < least).select("model", F.lit("all").alias("split"), F.lit("insufficient_data").alias("metric"), "value")
    both = naive_forecasts(known.join(n.where(F.col("value") >= least).select("model"), "model", "left_semi"))
    long = lambda df, cols: df.select("model", "split", *[F.col(c).cast("double") for c in cols]).unpivot(["model", "split"], cols, "metric", "value")
    out = long(forecast_errors(chrono_split(both)), ["n", "mae", "rmse", "hit"]).unionByName(long(rank_quality(both).withColumn("split", F.lit("all")), ["mean_rank_ic", "top_hit_rate", "dates"]))
    if volatility:
        out = out.unionByName(long(calibration_ratio(both).withColumn("split", F.lit("all")), ["ratio"]))
    return out.unionByName(few)


MODEL, ZERO, PERSISTENCE = "walk_forward_model", "naive_zero_baseline", "naive_persistence_baseline"


def evaluate_ml(forecasts: DataFrame) -> DataFrame:
    """(strategy, ridge_reference, target, split, series, metric, value) of walk-forward forecasts.

    forecasts: strategy, model_family, date, ticker, mu, sigma, score, actual_return,
    actual_volatility, actual_rar. Targets: return (with the zero and persistence forecasts,
    and the share of equal signs), volatility (not below 0; with persistence and the
    calibration ratio) and rar (the score against the realised ratio; with the share of dates
    on which the best score was the best outcome). The model's errors and mean rank
    correlations are given over all dates and by split; a strategy's dates are split once,
    whatever the target. A strategy without a completed forecast has one row, insufficient_data.
    """
    f = chrono_split(forecasts.withColumnRenamed("strategy", "model")).withColumnRenamed("model", "strategy")
    low = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), p.cast("double").alias("predicted"), a.cast("double").alias("actual")) for t, p, a in (("return", F.col("mu"), F.col("actual_return")), ("volatility", low("sigma"), low("actual_volatility")), ("rar", F.col("score"), F.col("actual_rar")))])
    own = f.select("strategy", "date", "ticker", "split", F.inline(pairs)).where("predicted is not null and actual is not null")
    before = F.lag("actual").over(Window.partitionBy("strategy", "target", "ticker").orderBy("date"))
    own = own.withColumn("before", before)
    kinds = F.array(F.struct(F.lit(MODEL).alias("series"), F.col("predicted").alias("p")), F.struct(F.lit(ZERO).alias("series"), F.when(F.col("target") == "return", 0.0).alias("p")), F.struct(F.lit(PERSISTENCE).alias("series"), F.when(F.col("target") != "rar", F.col("before")).alias("p")))
    rows = own.select("strategy", "target", "date", "ticker", "split", "actual", F.inline(kinds)).where("p is not null").withColumnRenamed("p", "predicted")

    key = ["strategy", "target", "series"]
    parts = F.explode(F.when(F.col("series") == MODEL, F.array(F.lit("all"), F.col("split"))).otherwise(F.array(F.lit("all")))).alias("split")
    e, whole = F.col("predicted") - F.col("actual"), F.col("split") == "all"
    model = F.col("series") == MODEL
    errors = rows.select(*key, "predicted", "actual", parts).groupBy(*key, "split").agg(
        F.count("*").cast("double").alias("observations"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(((F.col("predicted") >= 0) == (F.col("actual") >= 0)).cast("int")).alias("up"), F.try_divide(F.avg("predicted"), F.avg("actual")).alias("ratio"), F.avg("actual").alias("level"),
    ).withColumn("directional_accuracy", F.when(F.col("target") == "return", F.col("up"))).withColumn("calibration_ratio", F.when((F.col("target") == "volatility") & model & whole & (F.col("level") > 0), F.col("ratio")))

    ranked = rows.withColumn("by", F.struct(*key, "date"))
    ranked = avg_rank_percentile(avg_rank_percentile(ranked, "by", "predicted", "rp"), "by", "actual", "ra")
    best = lambda c: F.row_number().over(Window.partitionBy(*key, "date").orderBy(F.desc(c), "ticker"))
    ranked = ranked.withColumn("kp", best("predicted")).withColumn("ka", best("actual"))
    varied = (F.count("*") >= 2) & (F.min("rp") < F.max("rp")) & (F.min("ra") < F.max("ra"))
    day = ranked.groupBy(*key, "date", "split").agg(F.when(varied, F.try_divide(F.covar_pop("rp", "ra"), F.stddev_pop("rp") * F.stddev_pop("ra"))).alias("ic"), F.max(((F.col("kp") == 1) & (F.col("ka") == 1)).cast("int")).alias("top"))
    dates = day.select(*key, "ic", "top", parts).groupBy(*key, "split").agg(F.avg("ic").alias("mean_rank_correlation"), F.avg("top").alias("top")).withColumn("top_selection_hit_rate", F.when((F.col("target") == "rar") & model & whole, F.col("top")))

    names = {"observations": errors, "mae": errors, "rmse": errors, "directional_accuracy": errors, "calibration_ratio": errors, "mean_rank_correlation": dates, "top_selection_hit_rate": dates}
    ids = [*key, "split"]
    cols = lambda df: [n for n, d in names.items() if d is df]
    out = errors.select(*ids, *cols(errors)).unpivot(ids, cols(errors), "metric", "value").unionByName(dates.select(*ids, *cols(dates)).unpivot(ids, cols(dates), "metric", "value")).where("value is not null")
    who = forecasts.groupBy("strategy").agg((F.first("model_family", ignorenulls=True) == "ridge").alias("ridge_reference"))
    none = who.join(own.select("strategy").distinct(), "strategy", "left_anti").select("strategy", F.lit("none").alias("target"), F.lit(MODEL).alias("series"), F.lit("all").alias("split"), F.lit("insufficient_data").alias("metric"), F.lit(0.0).alias("value"))
    return out.unionByName(none).join(who, "strategy").select("strategy", F.coalesce("ridge_reference", F.lit(False)).alias("ridge_reference"), "target", "split", "series", "metric", "value")
