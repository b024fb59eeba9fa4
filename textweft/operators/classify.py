"""Category classifier and its evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def training_text(papers: DataFrame, label: str = "top_category_name") -> DataFrame:
    """text (title, full stop, abstract; trimmed) and label; rows with a blank label are dropped, nulls count as empty."""
    text = F.trim(F.concat(F.trim(F.coalesce("title", F.lit(""))), F.lit(". "), F.trim(F.coalesce("abstract", F.lit("")))))
    return papers.where(F.trim(label) != "").select("record_id", text.alias("text"), F.trim(label).alias("label"))


def label_list(rows: DataFrame, label: str) -> DataFrame:
    """Distinct labels with their place in order."""
    return rows.where(F.col(label).isNotNull()).groupBy().agg(F.sort_array(F.collect_set(label)).alias("_l")).select(F.posexplode("_l").alias("position", "label"))


def evaluation(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1, support; then accuracy, macro avg and weighted avg.

    From counts by (label, prediction): the rows are aggregated once.  An
    undefined quotient is 0; for accuracy the value stands in every column.
    """
    cells = pairs.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(label).alias("_l"), F.col(prediction).alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.select(F.col("_l").alias("class"), F.col("_n").alias("_support"), F.lit(0).alias("_said"), F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0).alias("_hit")).unionByName(cells.select(F.col("_p").alias("class"), F.lit(0).alias("_support"), F.col("_n").alias("_said"), F.lit(0).alias("_hit")))
    n = sides.groupBy("class").agg(F.sum("_support").alias("support"), F.sum("_said").alias("_said"), F.sum("_hit").alias("_hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = n.withColumn("precision", ratio(F.col("_hit"), F.col("_said"))).withColumn("recall", ratio(F.col("_hit"), F.col("support")))
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    mean = lambda name, agg: rows.groupBy().agg(F.lit(name).alias("class"), *[agg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    hit = F.sum("_hit") / F.sum("support")
    accuracy = rows.groupBy().agg(F.lit("accuracy").alias("class"), *[hit.alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    macro = mean("macro avg", lambda c: F.avg(c))
    weighted = mean("weighted avg", lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    out = rows.select(F.col("class").cast("string"), "precision", "recall", "f1", "support").unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


def fit_classifier(rows: DataFrame, vector: str, label: str, hidden: tuple[int, ...] = (256, 128), iterations: int = 500, seed: int = 42):
    """A pipeline: label index, multilayer perceptron, label names."""
    width = rows.select(F.max(F.size(vector))).first()[0]
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    model = MultilayerPerceptronClassifier(layers=[width, *hidden, len(index.labels)], featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=iterations, seed=seed)
    back = IndexToString(inputCol="_p", outputCol="prediction", labels=index.labels)
    ready = rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    return Pipeline(stages=[index, model, back]).fit(ready)


def predict(model, rows: DataFrame, vector: str) -> DataFrame:
    """Rows with their predicted label."""
    return model.transform(rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))).drop("_x", "_y", "_p", "rawPrediction", "probability")


def save(model, path: str, **about: str) -> None:
    """The pipeline under ``path``/model, what there is to know about it under ``path``/about."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(about.items())] or [("", "")], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(path: str):
    """A saved pipeline."""
    return PipelineModel.load(f"{path}/model")
