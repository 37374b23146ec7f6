"""Term weights over whole vocabularies."""

import math

from pyspark.sql import functions as F

from riskframe.operators import ml


def test_every_term_has_a_weight(spark):
    """300,000 distinct terms: more than a vocabulary of 2^18 would hold."""
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("T"), F.col("id") * 100 + i)), F.lit("All all")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(9001, None), (9002, "--")], "doc_id long, text string"))
    got = ml.tfidf(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
    want = 100 * math.log(3003 / 2) + 2 * math.log(3003 / 3001)
    assert len(got) == 3000 and all(r["n"] == 101 and abs(r["w"] - want) < 1e-6 for r in got)


def test_a_missing_label_is_a_class(spark):
    from riskframe.operators.ml import stratified_split

    rows = [(i, None if i % 3 == 0 else i % 2) for i in range(60)]
    out = stratified_split(spark.createDataFrame(rows, "id int, label int"), "label", "id", 0.5).collect()
    assert len(out) == 60 and all(sum(r["is_train"] for r in out if r["label"] == k) == 10 for k in (None, 0, 1))


def test_grid_search_equals_a_loop_over_the_folds(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = spark.range(240, numPartitions=1).select(
        (F.col("id") % 3).cast("int").alias("fold"), F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)).cast("double").alias("b"))
    rows = ml.assemble(rows.withColumn("label", (F.col("a") * 2 + F.col("b") > 14).cast("double")), ["a", "b"]).cache()
    fitted = ml.grid_search(rows, folds=3, fold_col="fold", rounds=(1, 4), rates=(0.1,))
    evaluator, want = BinaryClassificationEvaluator(labelCol="label"), {}
    for n in (1, 4):
        aucs = []
        for k in range(3):
            model = ml.boosted_trees(rounds=n).setStepSize(0.1).fit(rows.filter(F.col("fold") != k))
            aucs.append(evaluator.evaluate(model.transform(rows.filter(F.col("fold") == k))))
        want[n] = sum(aucs) / 3
    got = {r["rounds"]: r for r in ml.grid_report(spark, fitted).collect()}
    assert all(abs(got[n]["mean_auc"] - want[n]) < 1e-9 and got[n]["rate"] == 0.1 for n in (1, 4))
    assert [n for n in got if got[n]["is_best"]] == [max(want, key=lambda n: (want[n], -n))]
    assert fitted.bestModel.getNumTrees == max(want, key=lambda n: (want[n], -n))
    rows.unpersist()


def test_counts_of_terms_do_not_move_to_their_document(spark):
    rows = spark.createDataFrame([(1, "B a b"), (2, "a"), (3, ""), (4, None)], "doc_id long, text string")
    plan = ml.tfidf(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_rows_of_one_id_are_one_document_however_the_terms_are_joined(spark):
    rows = [(1, "B a b"), (1, "b; c"), (2, "a"), (None, "a x"), (None, "x x"), (3, "--"), (4, None), (5, "a" + " b" * 30_000)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, "b"): (3, 2), (1, "a"): (1, 4), (1, "c"): (1, 1), (2, "a"): (1, 4), (None, "a"): (1, 4), (None, "x"): (3, 1), (5, "a"): (1, 4), (5, "b"): (30_000, 2)}
    for listed in (0, 1, 100):
        got = {(r["doc_id"], r["term"]): (r["tf"], r["df"]) for r in ml.tfidf(rows, listed=listed).collect()}
        assert got == want
