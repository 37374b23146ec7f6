"""Pluggable signal models and score look-up by manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SignalFn = Callable[[DataFrame], Column]


class SignalRegistry:
    """Signal models as column builders.

    A model maps the input table to a risk column. Rows a model cannot score
    (NULL, NaN) read as FAILED and never stop the other models.
    """

    def __init__(self) -> None:
        self._models: dict[str, SignalFn] = {}

    def register(self, model_id: str, model: SignalFn) -> None:
        self._models[model_id] = model

    def score_all(self, df: DataFrame, key: str, manifest: DataFrame) -> DataFrame:
        """Long table ``key, model_id, risk, confidence, status, weight`` of the active models."""
        entries = []
        for model_id, model in self._models.items():
            risk = model(df).cast("double")
            entries.append(F.struct(F.lit(model_id).alias("model_id"), F.when(~F.isnan(risk), risk).alias("risk")))
        long = df.select(key, F.explode(F.array(*entries)).alias("s")).select(key, "s.*")
        return active_scores(long, manifest)


def active_scores(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scores of active models; a missing score reads 0 with status FAILED.

    The manifest lists one row per model and is broadcast after its size is checked.
    """
    from riskframe.operators.joins import lookup_join

    active = manifest.filter(F.lower("status") == "active").select("model_id", "weight")
    failed = F.col("risk").isNull()
    joined = lookup_join(scores, active, "model_id", "inner")
    return joined.withColumns({
        "status": F.when(failed, "FAILED").otherwise("READY"), "confidence": F.when(failed, 0.0).otherwise(1.0),
        "risk": F.coalesce("risk", F.lit(0.0))})


#: Fixed value: what a failed inference of a local model counts as, so that a failure never reads as safe.
UNCERTAIN = 0.50


def local_scores(df: DataFrame, models: dict[str, Column]) -> DataFrame:
    """``<name>_score`` of each local model, and ``degraded``: the models that gave no score (NULL or NaN) for the row."""
    valid = {name: F.when(~F.isnan(c.cast("double")), c.cast("double")) for name, c in models.items()}
    return df.withColumns({
        **{f"{name}_score": F.coalesce(c, F.lit(UNCERTAIN)) for name, c in valid.items()},
        "degraded": F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in valid.items()]))})


def weighted_vote(scores: DataFrame, key: str) -> DataFrame:
    """Manifest-weighted mean risk per row over the models that answered."""
    ready = F.col("status") == "READY"
    w, r = F.when(ready, F.col("weight")), F.when(ready, F.col("weight") * F.col("risk"))
    return scores.groupBy(key).agg(
        F.coalesce(F.try_divide(F.sum(r), F.sum(w)), F.lit(0.0)).alias("vote"), F.count_if(ready).alias("models_ready"),
        F.count_if(~ready).alias("models_failed"))
