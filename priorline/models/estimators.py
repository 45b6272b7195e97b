"""Logistic models, calibrators and trees, fitted on one part of a frame and applied to any other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = 1e-6
#: Below this spread of probabilities a calibrator abstains.
LEAST_SPREAD = 1e-9


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))


@dataclass
class Scaling:
    """Medians for gaps, then mean and population deviation, from the fit rows only; a constant column scales to 0."""

    columns: Sequence[str]
    stats: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def fit(self, rows: DataFrame) -> Scaling:
        medians = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in self.columns]).first()
        filled = [F.coalesce(F.col(c), F.lit(float(medians[c] or 0.0))) for c in self.columns]
        row = rows.agg(*[f(x) for x in filled for f in (F.avg, F.stddev_pop)]).first()
        for i, c in enumerate(self.columns):
            self.stats[c] = (float(medians[c] or 0.0), float(row[2 * i] or 0.0), float(row[2 * i + 1] or 0.0))
        return self

    def apply(self, rows: DataFrame) -> DataFrame:
        made = {f"_x{i}": (F.coalesce(F.col(c), F.lit(m)) - F.lit(a)) / F.lit(s) if s > 0 else F.lit(0.0) for i, (c, (m, a, s)) in enumerate(self.stats.items())}
        return VectorAssembler(inputCols=list(made), outputCol="features").transform(rows.withColumns(made)).drop(*made)


@dataclass
class Logistic:
    """L2-penalised logistic regression with inverse strength c: regParam is 1 / (c * total weight), features as scaled here."""

    columns: Sequence[str]
    c: float = 1.0
    weight: str | None = None
    intercept: bool = True
    model: Model | None = None
    scaling: Scaling | None = None
    constant: float | None = None

    def fit(self, rows: DataFrame, label: str = "y") -> Logistic:
        shape = rows.agg(F.sum(self.weight or F.lit(1.0)).alias("w"), F.min(label).alias("a"), F.max(label).alias("b"), F.avg(label).alias("rate")).first()
        if shape["a"] == shape["b"]:
            self.constant = float(shape["rate"])
            return self
        self.scaling = Scaling(self.columns).fit(rows)
        settings = {"labelCol": label, "regParam": 1 / (self.c * shape["w"]), "standardization": False, "maxIter": 200, "tol": 1e-9, "fitIntercept": self.intercept}
        self.model = LogisticRegression(**settings, **({"weightCol": self.weight} if self.weight else {})).fit(self.scaling.apply(rows))
        return self

    def predict(self, rows: DataFrame, name: str = "p") -> DataFrame:
        if self.model is None:
            return rows.withColumn(name, clipped(F.lit(self.constant)))
        made = self.model.transform(self.scaling.apply(rows)).withColumn(name, clipped(vector_to_array("probability")[1]))
        return made.drop("features", "rawPrediction", "probability", "prediction")


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.ln(q) - F.ln(1 - q)


@dataclass
class Calibrator:
    """platt, beta or isotonic; abstains, passing scores through, with one class or no spread."""

    kind: str
    model: Model | None = None

    def _features(self, rows: DataFrame, p: str) -> DataFrame:
        q = clipped(F.col(p))
        made = {"platt": {"_a": logit(F.col(p))}, "beta": {"_a": F.ln(q), "_b": -F.ln(1 - q)}, "isotonic": {"_a": q}}[self.kind]
        return VectorAssembler(inputCols=list(made), outputCol="_f").transform(rows.withColumns(made)).drop(*made)

    def fit(self, rows: DataFrame, p: str = "p", label: str = "y") -> Calibrator:
        shape = rows.agg(F.count_distinct(label).alias("classes"), F.stddev_pop(p).alias("spread"), F.count(F.lit(1)).alias("n")).first()
        if shape["classes"] < 2 or (shape["spread"] or 0.0) < LEAST_SPREAD:
            return self
        made = self._features(rows, p)
        if self.kind == "isotonic":
            self.model = IsotonicRegression(featuresCol="_f", labelCol=label).fit(made.withColumn(label, F.col(label).cast("double")))
        elif self.kind == "platt":
            self.model = LogisticRegression(featuresCol="_f", labelCol=label, regParam=1 / shape["n"], standardization=False, maxIter=200).fit(made)
        else:
            bounds = {"lowerBoundsOnCoefficients": Matrices.dense(1, 2, [0.0, 0.0]), "lowerBoundsOnIntercepts": Vectors.dense(-1e6)}
            self.model = LogisticRegression(featuresCol="_f", labelCol=label, regParam=0.0, standardization=False, maxIter=200, family="binomial", **bounds).fit(made)
        return self

    def apply(self, rows: DataFrame, p: str = "p", name: str = "calibrated") -> DataFrame:
        if self.model is None:
            return rows.withColumn(name, clipped(F.col(p)))
        made = self.model.transform(self._features(rows, p))
        value = F.col("prediction") if self.kind == "isotonic" else vector_to_array("probability")[1]
        return made.withColumn(name, clipped(value)).drop("_f", "prediction", "rawPrediction", "probability")


@dataclass
class Trees:
    """Gradient-boosted trees; Spark's own, so numbers differ from other libraries' trees."""

    columns: Sequence[str]
    depth: int = 3
    rounds: int = 20
    model: Model | None = None

    def fit(self, rows: DataFrame, label: str = "y") -> Trees:
        made = VectorAssembler(inputCols=list(self.columns), outputCol="features", handleInvalid="keep").transform(rows)
        self.model = GBTClassifier(labelCol=label, maxDepth=self.depth, maxIter=self.rounds, seed=7).fit(made)
        return self

    def predict(self, rows: DataFrame, name: str = "p") -> DataFrame:
        made = VectorAssembler(inputCols=list(self.columns), outputCol="features", handleInvalid="keep").transform(rows)
        return self.model.transform(made).withColumn(name, clipped(vector_to_array("probability")[1])).drop("features", "rawPrediction", "probability", "prediction")


def mirrored(rows: DataFrame, columns: Sequence[str], label: str = "y") -> DataFrame:
    """Rows and their mirror images (-x, 1 - y): with no intercept, a paired model's side term is penalised like the rest."""
    flip = rows.select(*[c for c in rows.columns if c not in (*columns, label)], *[(-F.col(c)).alias(c) for c in columns], (1 - F.col(label)).alias(label))
    return rows.unionByName(flip)


def blend(rows: DataFrame, weights: dict[str, float], name: str = "p") -> DataFrame:
    total = sum(weights.values())
    return rows.withColumn(name, clipped(sum((F.lit(w / total) * clipped(F.col(c)) for c, w in weights.items()), F.lit(0.0))))
