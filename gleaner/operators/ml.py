"""TF-IDF and logistic regression over labelled posts, held-out splits, prediction with fallback to rules."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import activity, posts
from gleaner.settings import DEFAULT, Settings
from gleaner.sources.scratch import stored

SCHEMA_VERSION, FEATURE_VERSION = 1, 2


def ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `place` (1 for the first of its key by order) and `size` (rows of the key), however many rows a key has.

    Rows are sorted into ranges of (key, order); a row's place is its place in its range and how many rows of its key stand
    in the ranges before.  What is summed over a key is one count for each range that it reaches into.
    """
    parts = stored(rows.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(key)
    told = counts.select(key, "__part", (F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("size"))
    within = F.row_number().over(Window.partitionBy("__part", key).orderBy(order))
    return parts.withColumn("__at", within).join(told, [key, "__part"]).withColumn("place", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def holdout_split(labelled: DataFrame, share: float = 0.3) -> DataFrame:
    """Add `holdout`: per label the first texts by hash, round-half-even share of them, at least one and never all; equal texts stay together."""
    groups = ranked(labelled.select("label", "text_hash").distinct(), "label", "text_hash")
    held = F.least(F.greatest(F.lit(1), F.bround(F.col("size") * share).cast("int")), (F.col("size") - 1).cast("int"))
    return labelled.join(groups.select("label", "text_hash", (F.col("place") <= held).alias("holdout")), ["label", "text_hash"])


def dataset_checksum(labelled: DataFrame) -> DataFrame:
    """One row: SHA-256 of the JSON list of (label, text_hash), sorted.  For training sets, which are small."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("text_hash", "label"))), lambda p: F.struct(p["label"].alias("label"), p["text_hash"].alias("text_hash")))
    return labelled.agg(F.sha2(F.to_json(pairs).cast("binary"), 256).alias("checksum"))


def word_ngrams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.concat(words, F.transform(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"])))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded by one space on each side; a word shorter than n gives itself once."""
    words = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[grams(w, n) for n in range(low, high + 1)]))))


def features(df: DataFrame) -> DataFrame:
    return df.withColumn("words", word_ngrams(F.col("normalized_text"))).withColumn("chars", char_ngrams(F.col("normalized_text")))


class _Columns(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)


def _sublinear(v):
    if isinstance(v, SparseVector):
        return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))
    return DenseVector(np.where(v.toArray() > 0, 1.0 + np.log(np.maximum(v.toArray(), 1e-300)), 0.0))


class SublinearTF(Transformer, _Columns):
    """Term counts to 1 + ln(count); what is not there stays 0.  Told to be nondeterministic, so that plans keep it in a step of its own."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.udf(_sublinear, VectorUDT()).asNondeterministic()(self.getInputCol()))


class SmoothIDF(Estimator, _Columns):
    """Learns ln((1 + texts) / (1 + texts that hold the term)) + 1; the model multiplies each term by it."""

    def _fit(self, df: DataFrame) -> ElementwiseProduct:
        seen = IDF(inputCol=self.getInputCol(), outputCol="__idf").fit(df)
        weights = np.log((1.0 + seen.numDocs) / (1.0 + np.array(seen.docFreq, np.float64))) + 1.0
        return ElementwiseProduct(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), scalingVec=DenseVector(weights))


def train_classifier(labelled: DataFrame, c: float = 10.0, vocabulary: int = 20000) -> PipelineModel:
    """Multinomial logistic regression with balanced weights over two TF-IDF blocks (sublinear counts, smoothed idf) of unit length."""
    n = labelled.count()
    sizes = labelled.groupBy("label").agg(F.count("*").alias("__n"))
    k = sizes.count()
    weighted = features(labelled).join(F.broadcast(sizes), "label").withColumn("weight", F.lit(float(n)) / (k * F.col("__n")))  # a row for each class
    stages = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")]
    for block in ("words", "chars"):
        stages += [CountVectorizer(inputCol=block, outputCol=f"{block}_n", vocabSize=vocabulary), SublinearTF(f"{block}_n", f"{block}_tf"), SmoothIDF(f"{block}_tf", f"{block}_idf"), Normalizer(inputCol=f"{block}_idf", outputCol=f"{block}_v")]
    stages += [VectorAssembler(inputCols=["words_v", "chars_v"], outputCol="features"), LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / (c * n), maxIter=60)]
    model = Pipeline(stages=stages).fit(weighted)
    index = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[0].labels)
    return PipelineModel([*model.stages[1:], index])


def rules_baseline(labelled: DataFrame, positive: list[text.Rule], negative: list[text.Rule], as_of: Column | str, settings: Settings = DEFAULT) -> DataFrame:
    """labelled(text, label, ..) with `predicted` by the rules, as posts of the time as_of."""
    at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    rows = labelled.select("*", F.struct("label").alias("__told")).drop("label").withColumn("published_at", at)
    done = posts.classify(posts.process_messages(rows, positive, negative, as_of, settings), as_of, settings=settings)
    return done.select(*[F.col("__told.label").alias("label") if c == "label" else F.col(c) for c in labelled.columns], done["label"].alias("predicted"))


def compared(labelled: DataFrame, labels: list[str], positive: list[text.Rule], negative: list[text.Rule], as_of: Column | str, share: float = 0.3, settings: Settings = DEFAULT) -> tuple[PipelineModel, DataFrame]:
    """The model of the texts that are not held out, and (method, label, precision, recall, f1, support) of model and rules on those that are.

    labelled: text, normalized_text, text_hash, label.
    """
    split = stored(holdout_split(labelled, share), "split")
    held = split.where("holdout")
    model = train_classifier(split.where("not holdout").drop("holdout"))
    told = {"ml": predict(model, held), "rules": rules_baseline(held, positive, negative, as_of, settings)}
    tables = [activity.evaluate(rows, labels).withColumn("method", F.lit(method)) for method, rows in told.items()]
    return model, tables[0].unionByName(tables[1])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with predicted and p."""
    out = model.transform(features(df))
    return out.withColumn("p", F.array_max(vector_to_array("probability"))).select(*df.columns, "predicted", "p")


def predict_with_fallback(ruled: DataFrame, model: PipelineModel | None, labels: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Rules' result where there is no model, the class is unknown or p is too low, with the reason; else the model's."""
    if model is None:
        return ruled.withColumn("method", F.lit("rules")).withColumn("fallback", F.lit("no_model"))
    out = predict(model, ruled)
    reason = F.when(~F.coalesce(F.col("predicted").isin(labels), F.lit(False)), "unknown_class").when(F.col("p") < settings.ml_min_confidence, "low_confidence")
    out = out.withColumn("fallback", reason)
    use = F.col("fallback").isNull()
    return (
        out.withColumn("method", F.when(use, "ml").otherwise("rules")).withColumn("label", F.when(use, F.col("predicted")).otherwise(F.col("label")))
        .withColumn("confidence", F.when(use, F.round("p", 4).cast("decimal(5,4)")).otherwise(F.col("confidence"))).withColumn("manual_review", ~use & F.col("manual_review"))
        .withColumn("relevance_score", F.when(use & (F.col("label") != "order"), 0).otherwise(F.col("relevance_score"))).drop("predicted", "p")
    )


def save_model(spark, model: PipelineModel, path: str, labels: list[str], metrics: dict, checksum: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    facts = {"schema_version": SCHEMA_VERSION, "feature_version": FEATURE_VERSION, "classes": labels, "metrics": metrics, "checksum": checksum}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_model(spark, path: str, labels: list[str]) -> PipelineModel:
    """Refuses an artifact of other versions or classes."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    if (facts["schema_version"], facts["feature_version"], sorted(facts["classes"])) != (SCHEMA_VERSION, FEATURE_VERSION, sorted(labels)):
        raise ValueError("the model's versions or classes do not fit")
    return PipelineModel.load(f"{path}/model")


def top_terms(df: DataFrame, coefficients: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, rank, term, weight): largest positive contributions, each term once; df(key, term, value), coefficients(term, coef).

    Terms that may hold personal data (long, handles, links, four digits) are left out.
    """
    safe = (F.length("term") <= 32) & ~F.col("term").rlike(r"@|http|t\.me|\d{4}")
    met = df.where(safe).join(coefficients, "term").groupBy(key, "term").agg(F.max(F.col("value") * F.col("coef")).alias("weight")).where("weight > 0")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= n).select(key, "rank", "term", "weight")
