"""Feature spaces and pulse types with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import cut_lineage


def fit_space(reference: DataFrame, features: str, *, k: int) -> PipelineModel:
    """Standardise (centred, population deviation) and fit principal axes on a reference set.

    The scaler divides by the sample deviation, which only rescales all axes alike; ``project``
    puts the factor back.
    """
    d = reference.select(array_to_vector(features).alias("_v"))
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True), PCA(k=k, inputCol="_z", outputCol="_pc")]).fit(d)
    model.reference_rows = d.count()
    return model


def project(model: PipelineModel, df: DataFrame, features: str) -> DataFrame:
    """Scores ``pc`` of any rows in the fitted space, each axis signed so that its largest
    loading is positive."""
    axes = model.stages[1].pc.toArray()
    sign = [1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(axes.shape[1])]
    n = model.reference_rows
    back = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    out = model.transform(df.withColumn("_v", array_to_vector(features)))
    scores = F.zip_with(vector_to_array("_pc"), F.array(*[F.lit(s * back) for s in sign]), lambda a, b: a * b)
    return out.withColumn("pc", scores).drop("_v", "_z", "_pc")


def explained_variance(model: PipelineModel) -> list[float]:
    return [float(v) for v in model.stages[1].explainedVariance.toArray()]


def classify_pulses(df: DataFrame, wave: str, symmetry: str, *, k: int = 6, seed: int = 0) -> DataFrame:
    """Two pulse types: a full two-component mixture on the leading components; the component
    with the more symmetric pulses on average is ``Pslow``."""
    d = cut_lineage(df)
    v = d.withColumn("_v", array_to_vector(wave))
    model = Pipeline(stages=[
        StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=False), PCA(k=k, inputCol="_z", outputCol="_pc"),
        GaussianMixture(k=2, featuresCol="_pc", predictionCol="_c", probabilityCol="_p", seed=seed),
    ]).fit(v)
    out = model.transform(v)
    slow = out.groupBy("_c").agg(F.avg(symmetry).alias("_s")).agg(F.max_by("_c", "_s").alias("_slow"))
    typed = out.crossJoin(F.broadcast(slow)).withColumn("pulse_type", F.when(F.col("_c") == F.col("_slow"), "Pslow").otherwise("Pfast"))
    return typed.drop("_v", "_z", "_pc", "_c", "_p", "_slow")


def segment_type(pulses: DataFrame, keys: list[str], type_col: str = "pulse_type") -> DataFrame:
    """Majority type of each segment (``Pfast`` on a tie)."""
    c = pulses.groupBy(*keys).agg(F.count_if(F.col(type_col) == "Pslow").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return c.select(*keys, F.when(F.col("_s") * 2 > F.col("_n"), "Pslow").otherwise("Pfast").alias("segment_type"))
