"""Training and scoring over tables with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.urls import lexical_features
from riskframe.operators.ordered import global_rank, running_sums
from riskframe.session import checkpointed


#: So many terms, or shared ids, are sent to every executor; more of them are joined by a shuffle.
LISTED = 500_000


def _term_counts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id, term, tf`` of each row by itself: its sorted words are cut into runs, without a shuffle."""
    words = df.select(row_id, F.sort_array(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")).alias("_words"))
    places = F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)))
    word = lambda i: F.get("_words", i)
    begins = words.withColumn("_begins", F.filter(places, lambda i: (i < F.size("_words")) & ((i == 0) | (word(i) != word(i - 1)))))
    runs = F.transform("_begins", lambda at, k: F.struct(
        word(at).alias("term"), (F.coalesce(F.get("_begins", k + 1), F.size("_words")) - at).cast("long").alias("tf")))
    # An inner explode would work its input out a second time, to filter on its size.
    return begins.select(row_id, F.explode_outer(runs).alias("_r")).select(row_id, "_r.term", "_r.tf").filter("term IS NOT NULL")


def tfidf(df: DataFrame, row_id: str = "doc_id", text: str = "text", listed: int = LISTED) -> DataFrame:
    """Rows ``row_id, term, tf, df, weight`` with ``weight = tf * ln((n + 1) / (df + 1))``, for every term of every id.

    Terms are the lower-cased runs of word characters. They are counted inside the row; only rows that share an id meet in a
    shuffle. The rows of a term are counted and written first. Up to ``listed`` terms are broadcast, so the counts do not
    move; of more terms none is left out, the counts are shuffled to them. ``n`` counts all rows, also those without a
    term; rows that share an id count as one document of theirs.
    """
    small = lambda part: F.broadcast(part) if part.count() <= listed else part.hint("shuffle_hash")
    shared = checkpointed(df.groupBy(F.col(row_id).alias("_id")).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_id"))
    if shared.isEmpty():
        counts = _term_counts(df, row_id, text)
    else:
        ids = small(shared)
        same = F.col(row_id).eqNullSafe(F.col("_id"))
        met = _term_counts(df.join(ids, same, "left_semi"), row_id, text).groupBy(row_id, "term").agg(F.sum("tf").alias("tf"))
        counts = _term_counts(df.join(ids, same, "left_anti"), row_id, text).unionByName(met)
    seen = checkpointed(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    total = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    joined = counts.join(small(seen), "term").crossJoin(F.broadcast(total))
    weight = F.col("tf") * F.log((F.col("_n") + 1.0) / (F.col("df") + 1.0))
    return joined.select(row_id, "term", "tf", "df", weight.alias("weight"))


def synthetic_urls(spark: SparkSession, n: int, seed: int = 42, jitter: float = 0.1) -> DataFrame:
    """Labelled URL feature rows: 35 % phishing, 12 % noisy, jittered features."""
    pick = lambda values, r: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(r * len(values)) + 1).cast("int"))
    r = {name: F.rand(seed + i) for i, name in enumerate(
        ["phish", "noise", "d1", "d2", "t1", "t2", "proto", "side", "tside", "coin", "num"])}
    df = spark.range(n).select("id", *[c.alias(k) for k, c in r.items()])
    c = F.col
    phish, noisy = c("phish") < 0.35, c("noise") < 0.12
    bad = F.concat(F.when(c("proto") < 0.8, "http").otherwise("https"), F.lit("://"), pick(lx.SYNTHETIC_PHISH, c("d1")), F.lit("."),
                   pick(lx.SYNTHETIC_BAD_TLDS, c("t1")), F.lit("/scan?id="), (F.floor(c("num") * 998999) + 1000).cast("string"))
    good = F.concat(F.lit("https://www."), pick(lx.SYNTHETIC_LEGIT, c("d1")), F.lit("."), pick(lx.SYNTHETIC_TLDS, c("t1")), F.lit("/home"))
    mixed = F.concat(
        F.lit("http://"), F.when(c("side") > 0.5, pick(lx.SYNTHETIC_LEGIT, c("d2"))).otherwise(pick(lx.SYNTHETIC_PHISH, c("d2"))), F.lit("."),
        F.when(c("tside") > 0.5, pick(lx.SYNTHETIC_BAD_TLDS, c("t2"))).otherwise(pick(lx.SYNTHETIC_TLDS, c("t2"))), F.lit("/redirect"))
    urls = df.select(
        "id", F.when(noisy, mixed).when(phish, bad).otherwise(good).alias("url"),
        F.when(noisy, (c("coin") < 0.5).cast("int")).otherwise(phish.cast("int")).alias("label"))
    feats = lexical_features("url")
    return urls.select("id", "url", "label", *[
        (f.cast("double") + F.randn(seed + 100 + i) * jitter).alias(n) for i, (n, f) in enumerate(feats.items())])


def stratified_split(df: DataFrame, label: str, row_id: str, share: float, seed: int = 42, name: str = "is_train") -> DataFrame:
    """Mark the first ``share`` of each label in a seeded pseudo-random order.

    The order is a digest of seed and id, so the split repeats exactly; ranks
    are taken over range partitions, so a frequent label is not sorted in one
    task. A NULL label is a class of its own.
    """
    keyed = df.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")), 256))
    ranked = running_sums(keyed, [label], ["_h", row_id], {"_before": F.lit(1)})
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_total"))
    joined = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))  # one row per class; Spark measures it
    return joined.withColumn(name, F.col("_before") < F.floor(F.col("_total") * share)).drop("_h", "_before", "_total", "_label")


def time_folds(df: DataFrame, order: list[str], folds: int = 3, name: str = "tile") -> DataFrame:
    """Chronological tiles 1..folds+1 of equal size (the first ones one row larger)."""
    ranked = global_rank(df, order, "_rank")
    total, tiles = ranked.count(), folds + 1
    base, extra = divmod(total, tiles)
    r, big = F.col("_rank") - 1, extra * (base + 1)
    tile = F.when(r < big, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - big) / max(base, 1))) + 1
    return ranked.withColumn(name, tile.cast("int")).drop("_rank")


def fold_frames(tiled: DataFrame, folds: int = 3, name: str = "tile") -> list[tuple[DataFrame, DataFrame]]:
    """Progressive train and test frames: fold k trains on tiles up to k and tests on the next."""
    return [(tiled.filter(F.col(name) <= k), tiled.filter(F.col(name) == k + 1)) for k in range(1, folds + 1)]


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def boosted_trees(label: str = "label", features: str = "features", rounds: int = 50, validation: str | None = None) -> GBTClassifier:
    """Shallow boosted trees; with ``validation`` boosting stops when that subset stops improving."""
    gbt = GBTClassifier(
        labelCol=label, featuresCol=features, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, maxIter=rounds,
        minInstancesPerNode=4, seed=42)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def grid_search(df: DataFrame, folds: int = 5, fold_col: str | None = None, rounds: tuple[int, ...] = (10, 20),
                rates: tuple[float, ...] = (0.05,), label: str = "label", parallelism: int = 4):
    """Cross-validated search by area under the ROC curve; ``fold_col`` (0 .. folds - 1) fixes the folds.

    Up to ``parallelism`` fits of a fold run at once, on the fold's cached rows.
    """
    gbt = boosted_trees(label)
    grid = ParamGridBuilder().addGrid(gbt.maxIter, list(rounds)).addGrid(gbt.stepSize, list(rates)).build()
    cv = CrossValidator(
        estimator=gbt, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=42,
        parallelism=parallelism, **({"foldCol": fold_col} if fold_col else {}))
    return cv.fit(df)


def grid_report(spark: SparkSession, fitted) -> DataFrame:
    """One row for each point of a fitted search: rounds, rate, mean_auc over the folds, is_best (the first of equal ones)."""
    best = fitted.avgMetrics.index(max(fitted.avgMetrics))
    rows = []
    for k, (point, auc) in enumerate(zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics, strict=True)):
        named = {param.name: value for param, value in point.items()}
        rows.append((named["maxIter"], float(named["stepSize"]), float(auc), k == best))
    return spark.createDataFrame(rows, "rounds int, rate double, mean_auc double, is_best boolean")


def score_vectors(model, df: DataFrame, threshold: float, mask: list[int] | None = None, width: int | None = None,
                  features: str = "features") -> DataFrame:
    """Probability and decision of a fitted classifier.

    ``width`` is checked first; ``mask`` selects the columns the model was
    trained on.
    """
    if width is not None:
        size = F.size(vector_to_array(F.col(features)))
        df = df.filter(F.assert_true(size == width, "unexpected vector width").isNull())
    if mask is not None:
        df = VectorSlicer(inputCol=features, outputCol="_sliced", indices=mask).transform(df).drop(features).withColumnRenamed("_sliced", features)
    out = model.transform(df).withColumn("probability", vector_to_array(F.col("probability"))[1])
    return out.withColumn("prediction", (F.col("probability") >= threshold).cast("int")).drop("rawPrediction")


def fit_isotonic(df: DataFrame, score: str = "score", label: str = "label"):
    vec = VectorAssembler(inputCols=[score], outputCol="_score").transform(df)
    return IsotonicRegression(featuresCol="_score", labelCol=label).fit(vec)


def roc_auc(df: DataFrame, score: str = "probability", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label).evaluate(df)
