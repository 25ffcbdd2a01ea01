"""The popularity model: split, training, scoring, evaluation, publication."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from edgelake.functions.traffic import ratio
from edgelake.operators.scale import prefix_sum
from edgelake.schemas import FEATURE_COLS, MIN_F1, TARGET_COL, VIRAL_THRESHOLD
from edgelake.sources.tables import read_table

# The training settings.
TEST_SHARE = 0.2
ROUNDS = 200
DEPTH = 5
STEP = 0.1
POSITIVE_SCALE = 0.7

ROWS_PER_TASK = 100_000
_RANK_BUCKETS = 4096


def training_rows(gold: DataFrame) -> DataFrame:
    return gold.dropna(subset=[*FEATURE_COLS, TARGET_COL])


def chronological_split(gold: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """A stored gold table with ``is_test`` on its last ``ceil(test_share * n)`` rows by (window, object).

    The cut is one (window, object) pair, found from the counts per window and from a ranking of the
    cut window alone; the table itself is only filtered, not sorted.
    """
    sizes = gold.groupBy("window_index").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train = total - math.ceil(total * test_share)
    cut = (
        prefix_sum(sizes, "window_index", {"upto": F.col("n")})
        .where(F.col("upto") >= train)
        .agg(F.min_by(F.struct("window_index", (F.lit(train) - F.col("upto") + F.col("n")).alias("rank")), "window_index"))
        .first()[0]
    )
    if cut is None:
        return gold.withColumn("is_test", F.lit(1))
    ids = gold.where(F.col("window_index") == cut["window_index"]).select("curr_object_id")
    low, high = ids.agg(F.min("curr_object_id"), F.max("curr_object_id")).first()
    ranked = prefix_sum(ids, "curr_object_id", {"rank": F.lit(1)}, width=(high - low) // _RANK_BUCKETS + 1)
    last = ranked.where(F.col("rank") == cut["rank"]).select("curr_object_id").first()
    window = F.col("window_index")
    is_test = window >= cut["window_index"]
    if last is not None:
        is_test = (window > cut["window_index"]) | (
            (window == cut["window_index"]) & (F.col("curr_object_id") > last[0])
        )
    return gold.withColumn("is_test", is_test.cast("int"))


def class_balance(rows: DataFrame) -> DataFrame:
    """``(negatives, positives, positive_weight)``."""
    label = F.col(TARGET_COL)
    return rows.agg(
        F.count_if(label == 0).alias("negatives"), F.count_if(label == 1).alias("positives")
    ).withColumn(
        "positive_weight",
        F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)) * F.lit(POSITIVE_SCALE),
    )


def train_viral(train: DataFrame, rounds: int = ROUNDS, seed: int = 42) -> PipelineModel | None:
    """Boosted trees on the weighted training rows; None when there is one class only."""
    balance = class_balance(train).first()
    if not balance["negatives"] or not balance["positives"]:
        return None
    weight = F.when(F.col(TARGET_COL) == 1, F.lit(float(balance["positive_weight"]))).otherwise(F.lit(1.0))
    labelled = train.withColumn("weight", weight).withColumn("label", F.col(TARGET_COL).cast("double"))
    inputs = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features")
    # A round is several short jobs over all rows: vectors are made once, in tasks of a size worth starting.
    parts = math.ceil((balance["negatives"] + balance["positives"]) / ROWS_PER_TASK)
    rows = inputs.transform(labelled).select("features", "label", "weight").coalesce(parts).persist()
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=rounds,
        maxDepth=DEPTH,
        stepSize=STEP,
        seed=seed,
    )
    try:
        return PipelineModel([inputs, trees.fit(rows)])
    finally:
        rows.unpersist()


def score(features: DataFrame, model: PipelineModel, threshold: float = VIRAL_THRESHOLD) -> DataFrame:
    """Features with the ``probability`` of the positive class and the ``prediction`` at a threshold."""
    keep = features.columns
    scored = model.transform(features)
    proba = vector_to_array(F.col("probability"))[1]
    return scored.select(*keep, proba.alias("probability")).withColumn(
        "prediction", decide(F.col("probability"), threshold)
    )


def decide(probability: Column, threshold: float = VIRAL_THRESHOLD) -> Column:
    return (probability >= threshold).cast("int")


def classification_report(scored: DataFrame, label: str = TARGET_COL) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``prediction``, 0.0 where undefined."""
    hit, wanted = F.col("prediction") == 1, F.col(label) == 1
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit & wanted).alias("tp"),
        F.count_if(hit & ~wanted).alias("fp"),
        F.count_if(~hit & wanted).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "n",
        "tp",
        "fp",
        "fn",
        ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


# Published models: a folder per version, and a table of versions that is only appended to. The row
# is written after the model, so a reader that goes by the table never sees a half-written model.

_VERSIONS = StructType([StructField("version", LongType()), StructField("f1", DoubleType())])


def latest_version(spark: SparkSession, path: str) -> int | None:
    return read_table(spark, f"{path}/versions", _VERSIONS, "json").agg(F.max("version")).first()[0]


def publish_model(model: PipelineModel, path: str, f1: float, spark: SparkSession, min_f1: float = MIN_F1) -> int | None:
    """Store a model as the newest version; a model below the gate is not stored."""
    if f1 < min_f1:
        return None
    version = (latest_version(spark, path) or 0) + 1
    model.write().overwrite().save(f"{path}/version={version}")
    spark.createDataFrame([(version, float(f1))], _VERSIONS).write.mode("append").json(f"{path}/versions")
    return version


def load_model(spark: SparkSession, path: str, version: int) -> PipelineModel:
    return PipelineModel.load(f"{path}/version={version}")


def train_and_judge(gold: DataFrame, rounds: int = ROUNDS) -> tuple[PipelineModel, float] | None:
    """A model of the older rows of gold and its F1 on the others; None when the labels do not allow one."""
    usable = training_rows(gold)
    if usable.select(TARGET_COL).distinct().count() < 2:
        return None
    split = chronological_split(usable)
    model = train_viral(split.where("is_test = 0").drop("is_test"), rounds)
    if model is None:
        return None
    return model, classification_report(score(split.where("is_test = 1"), model)).first()["f1"]


def retrain(spark: SparkSession, gold: DataFrame, path: str, rounds: int = ROUNDS, min_f1: float = MIN_F1) -> int | None:
    """Gold to a new published version, or None when the labels or the quality do not allow one."""
    judged = train_and_judge(gold, rounds)
    if judged is None:
        return None
    model, f1 = judged
    return publish_model(model, path, f1, spark, min_f1)
