"""Detector evaluation: confusion counts, rates, thresholds, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordered import running_sums

THREATS = ["SUSPICIOUS", "PHISHING", "MALICIOUS"]
ALARMS = ["WARNING", "DANGER"]
CLASS_VERDICTS = {
    "SAFE": ["SAFE"], "SUSPICIOUS": ["WARNING"], "PHISHING": ["WARNING", "DANGER"], "MALICIOUS": ["DANGER"],
}


def is_threat(expected: Column) -> Column:
    return expected.isin(THREATS)


def is_alarm(verdict: Column) -> Column:
    return verdict.isin(ALARMS)


def outcome(expected_threat: Column, predicted_threat: Column) -> Column:
    return (
        F.when(expected_threat & predicted_threat, "TP").when(expected_threat, "FN")
        .when(predicted_threat, "FP").otherwise("TN"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    df = df.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "specificity": _ratio(tn, tn + fp), "false_positive_rate": _ratio(fp, fp + tn), "false_negative_rate": _ratio(fn, fn + tp)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", _ratio(F.lit(2.0) * p * r, p + r))


def binary_metrics(pred: DataFrame, by: list[str] | None = None, expected: Column | None = None,
                   alarm: Column | None = None) -> DataFrame:
    """Confusion counts and rates; undefined rates read 0."""
    expected = is_threat(F.col("expected")) if expected is None else expected
    alarm = is_alarm(F.col("verdict")) if alarm is None else alarm
    counts = [F.count_if(expected & alarm).alias("tp"), F.count_if(~expected & alarm).alias("fp"),
              F.count_if(~expected & ~alarm).alias("tn"), F.count_if(expected & ~alarm).alias("fn")]
    return _rates(pred.groupBy(*(by or [])).agg(*counts))


def class_metrics(pred: DataFrame) -> DataFrame:
    """One row per expected class that occurs; verdicts count for the classes they may mean."""
    names = list(CLASS_VERDICTS)
    per = pred.groupBy("expected", "verdict").agg(F.count(F.lit(1)).alias("n"))
    tests = F.array(*[F.struct(
        F.lit(c).alias("class"), F.col("verdict").isin(CLASS_VERDICTS[c]).alias("hit"), (F.col("expected") == c).alias("own"))
        for c in names])
    long = per.withColumn("t", F.explode(tests)).select("n", "t.*")
    sums = long.groupBy("class").agg(
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("own") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("own") & F.col("hit"), F.col("n")).otherwise(0)).alias("fp")).filter("support > 0")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("support"))
    out = sums.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(
        "class", "precision", "recall", "f1", "support")


def component_metrics(pred: DataFrame, components: list[str], thresholds: list[float]) -> DataFrame:
    """Binary metrics of every component score at every threshold.

    The sweep is a fixed number of conditional counts in one aggregation, so
    rows are not multiplied before the shuffle.
    """
    expected = is_threat(F.col("expected"))
    aggs, cells = [], []
    for c in components:
        for i, t in enumerate(thresholds):
            alarm = F.col(c) > t
            names = {k: f"{c}_{i}_{k}" for k in ("tp", "fp", "tn", "fn")}
            aggs += [F.count_if(expected & alarm).alias(names["tp"]), F.count_if(~expected & alarm).alias(names["fp"]),
                     F.count_if(~expected & ~alarm).alias(names["tn"]), F.count_if(expected & ~alarm).alias(names["fn"])]
            cells.append(F.struct(F.lit(c).alias("component"), F.lit(float(t)).alias("threshold"),
                                  *[F.col(n).alias(k) for k, n in names.items()]))
    wide = pred.agg(*aggs)
    return _rates(wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))


def error_rows(pred: DataFrame) -> DataFrame:
    return pred.withColumn("outcome", outcome(is_threat(F.col("expected")), is_alarm(F.col("verdict"))))


def suite_pass(pred: DataFrame) -> DataFrame:
    """Pass rate per category: LEGIT must be SAFE, SCAM must not, BORDERLINE passes."""
    safe = F.col("verdict") == "SAFE"
    ok = F.when(F.col("category") == "LEGIT", safe).when(F.col("category") == "SCAM", ~safe).otherwise(True)
    return pred.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.avg(ok.cast("double")).alias("pass_rate"))


def exact_auc(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half.

    Rows are first reduced to one per distinct score; the running count of
    lower negatives is taken over range partitions.
    """
    per = pred.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranked = running_sums(per, [], [score], {"below": F.col("neg")})
    d = lambda c: F.col(c).cast("double")
    sums = ranked.agg(
        F.sum(d("pos") * (d("below") + d("neg") / 2)).alias("wins"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return sums.select(
        "positives", "negatives",
        F.try_divide(F.col("wins"), d("positives") * d("negatives")).alias("auc"))


def multiclass_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class from one pair count."""
    pairs = pred.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.withColumn("s", F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.lit(True).alias("actual")),
        F.struct(F.col(prediction).alias("class"), F.lit(False).alias("actual"))))).select(
        "n", "s.*", (F.col(label) == F.col(prediction)).alias("hit"))
    sums = sides.groupBy("class").agg(
        F.sum(F.when(F.col("actual"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("actual"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("actual") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    out = sums.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(
        "class", "precision", "recall", "f1", "support")
