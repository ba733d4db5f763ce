"""Complete analysis: both cross-validations, final model, importances and product comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.functions.scalar import known
from stationloom.operators import evaluate, filters, models
from stationloom.operators.features import impute
from stationloom.operators.filters import require
from stationloom.session import ensure_checkpoint_dir


def complete_analysis(df: DataFrame, features: Sequence[str], label: str = "swe", station: str = "station_id",
                      date: str = "date", products: Sequence[str] = (), make: Callable = models.boosted_trees,
                      station_folds: int | None = None, parallelism: int = 3) -> dict[str, DataFrame]:
    """Every table of the analysis by name; models are fitted when called, tables are lazy. Both cross-validations and the
    final model run at the same time, unless ``parallelism`` is less.

    Each station and each year is left out by itself; ``station_folds`` deals the stations into that many folds.
    Missing features are filled from the training rows of each fold.
    """
    require(df, [station, date, label])
    labelled = df.where(known(F.col(label)).isNotNull()).withColumn("_year", F.year(date))
    ensure_checkpoint_dir(df.sparkSession)
    data = labelled.select(station, "_year", label, *features).checkpoint()
    out: dict[str, DataFrame] = {}
    overall, spread = [], []
    schemes = (("station", station, station_folds), ("yearly", "_year", None))

    def final():
        return make(label).fit(models.assemble(impute(data, list(features)), features, label))

    *predicted, model = models.together(df.sparkSession, [
        *(partial(models.cross_validated, data, features, label, group, make, folds) for _, group, folds in schemes), final], parallelism)
    for (scheme, *_), predictions in zip(schemes, predicted):
        report = models.cross_validation_report(predictions)
        out |= {f"{scheme}_predictions": predictions, f"{scheme}_folds": report["folds"],
                f"{scheme}_summary": report["summary"]}
        overall.append(report["overall"].withColumn("scheme", F.lit(scheme)))
        spread.append(report["summary"].where("metric = 'mae'").select(
            F.lit(scheme).alias("scheme"), F.col("std").alias("mae_std")))
    out["overall"] = overall[0].unionByName(overall[1])
    out["comparison"] = evaluate.compare_schemes(out["overall"], spread[0].unionByName(spread[1]))
    out["importance"] = models.importance_table(data, model, features)
    out["importance_stats"] = evaluate.importance_stats(out["importance"], "feature", "importance")
    if products:
        out["products"] = evaluate.compare_products(df, label, products)
    out["input"] = filters.validation_report(df, [station, date, label])
    return out
