"""Queries on pipelines: fitted in each fold on the other folds' rows, saved, loaded and applied. SQL works out the same predictions
where the model has a closed form; elsewhere it says what a predictor must reach that has learnt something, which a constant one fails."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.boosting import SoftmaxBoosting
from foldspark.operators.landmarks import LandmarkMap
from foldspark.operators.machines import HingeMachines
from foldspark.operators.stages import FeatureChain, nested
from foldspark.plans.catalog import ORACLE, query, table
from foldspark.plans.features import chain_rows
from foldspark.plans.samples import LCG
from foldspark.sources.shared import shared_dir

K = 3
#: An accuracy that a predictor must exceed, as a multiple of the largest class's share.
LEARNT = 1.15
FOLDS = f"(row_number() OVER (PARTITION BY y ORDER BY {LCG.format(k='vec_id')}, vec_id) - 1) % {K}"


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rows_of(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query("chain_pipeline", ORACLE["chain_projection"])
def chain_pipeline(spark, d):
    """Held-out rows through a pipeline that was fitted on the other folds, saved and loaded."""
    rows = chain_rows(spark, d).select("fold", F.array("a", "c", "d", "k").alias("features"))
    path, out = folder(spark, "chain"), []
    for fold in range(K):
        Pipeline(stages=[FeatureChain(components=1)]).fit(rows.filter(F.col("fold") != fold)).write().save(f"{path}/{fold}")
        model = PipelineModel.load(f"{path}/{fold}")
        held = model.transform(rows.filter(F.col("fold") == fold)).withColumn("z", vector_to_array("scaled")[0])
        out.append(held.groupBy("fold").agg(F.lit(round(model.stages[0].getOrDefault("explained")[0], 6)).alias("explained"), F.round(F.avg(F.col("z") * F.col("z")), 4).alias("size"), F.count("*").alias("n")))
    return reduce(DataFrame.union, out)


@query("bayes_pipeline_cv", f"""
WITH r AS (SELECT vec_id, y, x, {FOLDS} AS fold FROM (SELECT vec_id, label::INT AS y, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings)),
e AS (SELECT vec_id, y, fold, unnest(x) AS v, unnest(range(len(x))) AS i FROM r),
k AS (SELECT unnest(range({K})) AS k),
s AS (SELECT k, i, avg(v) AS m, stddev_pop(v) AS s FROM e, k WHERE fold <> k GROUP BY ALL),
z AS (SELECT e.*, k, (v - m) / s AS z FROM e JOIN s USING (i)),
c AS (SELECT k, y, i, avg(z) AS m, var_pop(z) + 1e-9 AS q FROM z WHERE fold <> k GROUP BY ALL),
p AS (SELECT k, y, ln(count(*) / sum(count(*)) OVER (PARTITION BY k)::DOUBLE) AS prior FROM r, k WHERE fold <> k GROUP BY k, y),
l AS (SELECT z.vec_id, z.k, z.y, c.y AS h, any_value(prior) - sum(ln(2 * pi() * q) + (z - c.m) * (z - c.m) / q) / 2 AS l FROM z JOIN c ON c.k = z.k AND c.i = z.i JOIN p ON p.k = z.k AND p.y = c.y WHERE z.fold = z.k GROUP BY ALL),
b AS (SELECT k, y, arg_max(h, l) AS h FROM l GROUP BY k, vec_id, y)
SELECT k::INT AS fold, y, h AS y_pred, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""")
def bayes_pipeline_cv(spark, d):
    """The confusion of each fold, predicted by normal densities of standardised columns: all rows, classes and columns."""
    pipeline = Pipeline(stages=[FeatureChain(), NaiveBayes(modelType="gaussian", featuresCol="scaled", labelCol="y")])
    p = nested(rows_of(spark, d), pipeline, [], K, path=folder(spark, "bayes"))
    return p.groupBy("fold", "y", F.col("prediction").cast("int").alias("y_pred")).agg(F.count("*").alias("n"))


#: A label that rows give away: which of the first three components is largest.
LARGEST = "[embedding[1], embedding[2], embedding[3]]"
LEARNABLE = f"""
WITH r AS (SELECT vec_id, list_position({LARGEST}, list_max({LARGEST})) - 1 AS y FROM embeddings), f AS (SELECT y, {FOLDS} AS fold FROM r)
SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n, TRUE AS learnt FROM f GROUP BY 1"""


def learnable(spark, d) -> DataFrame:
    rows = rows_of(spark, d)
    first = F.slice("features", 1, 3)
    return rows.withColumn("y", (F.array_position(first, F.array_max(first)) - 1).cast("int"))


def judged(predictions: DataFrame) -> DataFrame:
    """(fold, n, learnt): whether a fold's accuracy is LEARNT times the share of its largest class or more."""
    each = predictions.groupBy("fold", "y").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("hits"))
    return each.groupBy("fold").agg(F.sum("n").alias("n"), (F.sum("hits") > LEARNT * F.max("n")).alias("learnt"))


@query("forest_pipeline_cv", LEARNABLE)
def forest_pipeline_cv(spark, d):
    """Nested cross-validation of a forest over the cluster, its depth chosen by inner folds' macro F1."""
    forest = RandomForestClassifier(featuresCol="scaled", labelCol="y", seed=42, numTrees=20, featureSubsetStrategy="0.5")
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [1, 4]).build()
    return judged(nested(learnable(spark, d), Pipeline(stages=[FeatureChain(), forest]), grid, K, 2, path=folder(spark, "forest")))


@query("softmax_boosting_cv", LEARNABLE)
def softmax_boosting_cv(spark, d):
    """Trees of all classes at once, of a round each, in every fold."""
    pipeline = Pipeline(stages=[FeatureChain(), SoftmaxBoosting(featuresCol="scaled", trees=6, depth=3, rate=0.5)])
    return judged(nested(learnable(spark, d), pipeline, [], K, path=folder(spark, "boosting")))


@query("landmark_svm_cv", LEARNABLE)
def landmark_svm_cv(spark, d):
    """Linear machines on a landmark map of the RBF kernel, one against the rest, over all rows."""
    pipeline = Pipeline(stages=[FeatureChain(), LandmarkMap(inputCol="scaled", landmarks=128), HingeMachines(maxIter=8, regParam=1e-2, featuresCol="mapped", labelCol="y")])
    return judged(nested(learnable(spark, d), pipeline, [], K, path=folder(spark, "svm")))
