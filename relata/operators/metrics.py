"""Cross-validated scale correction of log errors, and the metrics around it.

A scene's rows fall into folds A and B.  The log scale of one fold corrects the
other; the gain is the share of squared log error that this removes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.operators.quantiles import exact_median
from relata.storage import materialize


def with_log_error(rows: DataFrame, predicted: str = "prediction", truth: str = "truth") -> DataFrame:
    return rows.withColumn("log_error", F.when((F.col(predicted) > 0) & (F.col(truth) > 0), F.ln(F.col(predicted) / F.col(truth))))


def gain(raw, corrected):
    """Null where there is no error to correct."""
    return F.when(raw > 0, 1 - corrected / raw)


def fold_metrics(rows: DataFrame, scene: str = "scene") -> DataFrame:
    """Per scene and test fold: the scale learned from the other fold, squared errors before and after.

    Fold sums are pivoted within the scene's aggregation, so both folds meet
    without a join.  Corrected errors come from sums of deviations from the
    fold's own mean, which loses no digits where the correction is nearly
    perfect.
    """
    moments = rows.groupBy(scene, "fold").agg(F.count("*").alias("n"), F.avg("log_error").alias("mean"), F.sum(F.col("log_error") * F.col("log_error")).alias("raw"), F.var_pop("log_error").alias("spread"))
    pick = lambda fold: F.max(F.when(F.col("fold") == fold, F.struct("n", "mean", "raw", "spread"))).alias(fold)
    both = moments.groupBy(scene).agg(pick("A"), pick("B")).filter("A is not null and B is not null")
    sides = F.array(*(F.struct(F.lit(t).alias("test_fold"), F.col(t).alias("t"), F.col(o).alias("o")) for t, o in (("A", "B"), ("B", "A"))))
    one = both.select(scene, F.inline(sides))
    shift = F.col("t.mean") - F.col("o.mean")
    return one.select(
        scene, "test_fold", F.col("t.n").alias("n"), (-F.col("o.mean")).alias("log_alpha"), F.exp(-F.col("o.mean")).alias("alpha"), F.col("t.raw").alias("raw_sse"),
        (F.col("t.n") * (F.col("t.spread") + shift * shift)).alias("corrected_sse"),
    ).withColumns({"raw_rmse": F.sqrt(F.col("raw_sse") / F.col("n")), "corrected_rmse": F.sqrt(F.col("corrected_sse") / F.col("n")), "g_cv": gain(F.col("raw_sse"), F.col("corrected_sse"))})


def scene_gain(rows: DataFrame, scene: str = "scene") -> DataFrame:
    """Per scene: g_cv and root mean squared log errors over both folds, and the ratio of the folds' scales."""
    return fold_metrics(rows, scene).groupBy(scene).agg(
        F.sum("n").alias("n"), F.sum("raw_sse").alias("raw_sse"), F.sum("corrected_sse").alias("corrected_sse"), (F.max("alpha") / F.min("alpha")).alias("fold_alpha_ratio"),
    ).withColumns({"g_cv": gain(F.col("raw_sse"), F.col("corrected_sse")), "raw_rmse": F.sqrt(F.col("raw_sse") / F.col("n")), "corrected_rmse": F.sqrt(F.col("corrected_sse") / F.col("n"))})


def scale_split(rows: DataFrame, scene: str = "scene") -> DataFrame:
    """Per scene: squared log error due to one common scale, the rest, and the scale's share."""
    sums = rows.groupBy(scene).agg(F.count("*").alias("n"), F.avg("log_error").alias("mean_log_error"), (F.var_pop("log_error") * F.count("*")).alias("ss_configuration"))
    scaled = sums.withColumns({"descriptive_alpha": F.exp(-F.col("mean_log_error")), "ss_scale": F.col("n") * F.col("mean_log_error") * F.col("mean_log_error")})
    total = F.col("ss_scale") + F.col("ss_configuration")
    return scaled.withColumn("scale_fraction", F.when(total > 0, F.col("ss_scale") / total).otherwise(0.0))


def plain_errors(rows: DataFrame, scene: str = "scene", predicted: str = "prediction", truth: str = "truth") -> DataFrame:
    error = F.abs(F.col(predicted) - F.col(truth))
    return rows.groupBy(scene).agg(F.avg(error).alias("mae"), F.avg(F.when(F.col(truth) > 0, error / F.col(truth))).alias("mape"), F.min(truth).alias("truth_min"), F.max(truth).alias("truth_max"), F.count_distinct(predicted).alias("n_unique_predictions"))


def scene_metrics(rows: DataFrame, scene: str = "scene", predicted: str = "prediction", truth: str = "truth") -> DataFrame:
    """All metrics of a scene in one row."""
    return scene_gain(rows, scene).drop("n").join(scale_split(rows, scene), scene).join(plain_errors(rows, scene, predicted, truth), scene)


def prediction_histogram(rows: DataFrame, predicted: str = "prediction", group: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*group, F.col(predicted).alias("value")).agg(F.count("*").alias("n"))


def equal_weight(scenes: DataFrame, metric: str = "g_cv") -> DataFrame:
    """Every scene counts alike, however many rows it has."""
    m = F.col(metric)
    scenes = materialize(scenes.select(metric), "scenes")  # one narrow row per scene, read more than once
    one = scenes.agg(F.count(m).alias("n_scenes"), F.avg(m).alias("mean"), F.min(m).alias("minimum"), F.max(m).alias("maximum"), F.count_if(m > 0).alias("n_positive"), F.count_if(m > 0.5).alias("n_above_half"))
    both = one.crossJoin(F.broadcast(exact_median(scenes, metric)))  # one row is broadcast
    return both.select("n_scenes", "mean", "median", "minimum", "maximum", "n_positive", "n_above_half")


def pooled(scenes: DataFrame) -> DataFrame:
    """All squared errors in one pot."""
    sums = scenes.agg(F.sum("n").alias("n"), F.sum("raw_sse").alias("raw"), F.sum("corrected_sse").alias("corrected"))
    return sums.select("n", gain(F.col("raw"), F.col("corrected")).alias("pooled_g_cv"), F.sqrt(F.col("raw") / F.col("n")).alias("pooled_raw_rmse"), F.sqrt(F.col("corrected") / F.col("n")).alias("pooled_corrected_rmse"))


def gain_levels(rows: DataFrame, dimensions: list[str], scene: str = "scene", sets: list[list[str]] | None = None) -> DataFrame:
    """Gain and errors on every level over a scene's dimensions and the test fold, from one aggregation of the folds' sums.

    dimensions: columns that are the same for all rows of a scene.  ``sets``
    names the grouping sets, each a list of dimensions and 'test_fold'; without
    it, all of them (a cube).  ``level`` has a bit for each column that is
    summed over, the last one the lowest; such a column is null.
    """
    own = rows.groupBy(scene).agg(*(F.first(d).alias(d) for d in dimensions))
    folds = fold_metrics(rows, scene).select(scene, "test_fold", "n", "raw_sse", "corrected_sse").join(own, scene)
    columns = [*dimensions, "test_fold"]
    grouped = folds.cube(*columns) if sets is None else folds.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    sums = grouped.agg(F.grouping_id().alias("level"), F.count_distinct(scene).alias("scenes"), F.sum("n").alias("n"), F.sum("raw_sse").alias("raw_sse"), F.sum("corrected_sse").alias("corrected_sse"))
    return sums.withColumns({"g_cv": gain(F.col("raw_sse"), F.col("corrected_sse")), "raw_rmse": F.sqrt(F.col("raw_sse") / F.col("n")), "corrected_rmse": F.sqrt(F.col("corrected_sse") / F.col("n"))})


def timing_summary(rows: DataFrame, elapsed: str = "elapsed_seconds") -> DataFrame:
    """Values that are no numbers are left out; all null if none is left."""
    values = rows.select(F.col(elapsed).try_cast("double").alias("value"))
    one = values.agg(F.count("value").alias("n"), F.avg("value").alias("mean_seconds"), F.sum("value").alias("total_seconds"))
    both = one.crossJoin(F.broadcast(exact_median(values, "value")))  # one row is broadcast
    return both.select("n", "mean_seconds", F.col("median").alias("median_seconds"), "total_seconds")


def fold_violations(rows: DataFrame, scene: str = "scene") -> DataFrame:
    """Scenes whose folds are not A and B of equal size."""
    counts = rows.groupBy(scene).agg(F.count_if(F.col("fold") == "A").alias("n_a"), F.count_if(F.col("fold") == "B").alias("n_b"), F.count_if(~F.coalesce(F.col("fold").isin("A", "B"), F.lit(False))).alias("n_other"))
    rule = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0) | (F.col("n_other") > 0), "folds").when(F.col("n_a") != F.col("n_b"), "balance")
    return counts.withColumn("rule", rule).filter("rule is not null")
