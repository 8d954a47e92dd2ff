"""Scorecard and gradient-boosted models on Spark ML, calibration, attribution, cross-validation and conformal sets."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators import encoding as en
from riskflow.operators import ordered as od
from riskflow.operators.profiles import top_reasons
from riskflow.session import checkpoint_dir, cut


def class_weight(df: DataFrame, label: str):
    """Weight that makes both classes count the same, as an expression."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    return F.when(F.col(label) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1))), n


def hash_part(ident: str, parts: int, salt: str = "fold"):
    """Repeatable split of rows by id."""
    return F.pmod(F.xxhash64(F.lit(salt), ident), F.lit(parts)).cast("int")


@dataclass
class Scorecard:
    """WOE-encoded, standardised, L1-penalised logistic model."""

    columns: list[str]
    label: str
    q: int = 5
    min_iv: float = 0.02
    k: int = 20
    c: float = 0.01
    edges: dict = field(default_factory=dict)
    table: DataFrame | None = None
    stages: list = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [f"woe_{r['feature']}" for r in sorted(self.table.select("feature").distinct().collect())]

    def fit(self, df: DataFrame) -> Scorecard:
        self.edges, table = en.woe_fit(df, self.columns, self.label, self.q, self.min_iv, self.k)
        rows = table.select("feature", "bin", "woe", "iv").collect()  # one row per feature and bin
        if not rows:
            raise ValueError("no feature reaches the minimum information value")
        self.table = df.sparkSession.createDataFrame(rows, "feature string, bin string, woe double, iv double")
        weight, n = class_weight(df, self.label)
        base = en.woe_transform(df, self.edges, self.table).withColumns({"_y": F.col(self.label).cast("double"), "_w": weight})
        steps = [VectorAssembler(inputCols=self.features, outputCol="_raw"),
                 StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
                 LogisticRegression(featuresCol="_std", labelCol="_y", weightCol="_w", elasticNetParam=1.0, regParam=1 / (self.c * n),
                                    probabilityCol="_p", rawPredictionCol="_m", predictionCol="_hat")]
        self.stages = []
        for s in steps:
            model = s.fit(base) if hasattr(s, "fit") else s
            base = model.transform(base)
            self.stages.append(model)
        return self

    def transform(self, df: DataFrame, name: str = "scorecard", reasons: int = 0) -> DataFrame:
        """Add the probability, and with ``reasons`` the largest contributions."""
        names = self.features
        out = en.woe_transform(df, self.edges, self.table)
        for s in self.stages:
            out = s.transform(out)
        out = out.withColumn(name, vector_to_array("_p")[1])
        keep = [*df.columns, name]
        if reasons:
            values, coef = vector_to_array("_std"), self.stages[-1].coefficients
            parts = {n[4:]: values[i] * float(coef[i]) for i, n in enumerate(names)}
            out = out.select(*keep, *[c.alias(f"_c_{n}") for n, c in parts.items()])
            out = top_reasons(out, [f"_c_{n}" for n in parts], reasons)
            out = out.withColumn("reason_codes", F.transform("reason_codes", lambda r: F.struct(
                F.substring(r.feature, 4, 1000).alias("feature"), r.contribution.alias("contribution"),
                F.concat(F.lit("Weight of evidence for "), F.substring(r.feature, 4, 1000)).alias("description"))))
            keep = [*keep, "reason_codes"]
        return out.select(*keep)

    def save(self, path: str) -> None:
        PipelineModel(self.stages).write().overwrite().save(f"{path}/stages")
        self.table.write.mode("overwrite").parquet(f"{path}/woe")
        rows = [(c, [float(v) for v in e]) for c, e in self.edges.items()]
        self.table.sparkSession.createDataFrame(rows, "feature string, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark, path: str, label: str = "label") -> Scorecard:
        edges = {r["feature"]: list(r["edges"]) for r in spark.read.parquet(f"{path}/edges").collect()}
        return cls(list(edges), label, edges=edges, table=spark.read.parquet(f"{path}/woe"),
                   stages=PipelineModel.load(f"{path}/stages").stages)


@dataclass
class TabularModel:
    """Gradient-boosted trees with class weights, optional focal re-weighting and isotonic calibration."""

    columns: list[str]
    label: str
    ident: str
    rounds: int = 50
    depth: int = 5
    gamma: float = 0.0
    alpha: float = 0.25
    seed: int = 42
    model: GBTClassificationModel | None = None
    calibrator: object = None

    def _gbt(self, df: DataFrame) -> GBTClassificationModel:
        """A fifth of the rows, by hash of the id, decides when to stop."""
        flagged = df.withColumn("_val", hash_part(self.ident, 5, "early") == 0)
        gbt = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=self.rounds, maxDepth=self.depth, stepSize=0.1,
                            seed=self.seed, validationIndicatorCol="_val", validationTol=0.001)
        return gbt.fit(flagged)

    def _assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.columns, outputCol="_x", handleInvalid="keep").transform(df)

    def fit(self, df: DataFrame, calibrate_folds: int = 3) -> TabularModel:
        weight, _ = class_weight(df, self.label)
        base = self._assemble(df).withColumns({"_y": F.col(self.label).cast("double"), "_w": weight}).select(self.ident, "_x", "_y", "_w")
        base = cut(base)  # each of the fits reads it
        self.model = self._gbt(base)
        if self.gamma:
            # focal emphasis: rows the first fit already gets right count less in the second
            p = vector_to_array("probability")[1]
            pt = F.when(F.col("_y") == 1, p).otherwise(1 - p)
            at = F.when(F.col("_y") == 1, self.alpha).otherwise(1 - self.alpha)
            base = self.model.transform(base).withColumn("_w", at * F.pow(1 - pt, self.gamma) + 1e-6).select(self.ident, "_x", "_y", "_w")
            self.model = self._gbt(base)
        if calibrate_folds:
            fold = hash_part(self.ident, calibrate_folds, "calibration")
            parts = None
            for i in range(calibrate_folds):
                held = self._gbt(base.filter(fold != i)).transform(base.filter(fold == i)).select(
                    vector_to_array("probability")[1].alias("raw"), "_y")
                parts = held if parts is None else parts.unionByName(held)
            self.calibrator = calibrate(parts, "raw", "_y")
        return self

    def transform(self, df: DataFrame, name: str = "tabular") -> DataFrame:
        out = self.model.transform(self._assemble(df)).withColumn("_raw", vector_to_array("probability")[1])
        if self.calibrator is not None:
            out = apply_calibration(out, self.calibrator, "_raw", name)
        else:
            out = out.withColumn(name, F.col("_raw"))
        return out.select(*df.columns, name)

    def importances(self, spark) -> DataFrame:
        rows = list(zip(self.columns, [float(v) for v in self.model.featureImportances.toArray()]))
        return spark.createDataFrame(rows, "feature string, importance double")


def calibrate(df: DataFrame, raw: str, y: str):
    """Isotonic fit of the outcome on the raw score; equal scores are pre-aggregated, so the fit sees distinct scores."""
    small = df.groupBy(F.col(raw).alias("raw")).agg(F.avg(F.col(y).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="raw", labelCol="y", weightCol="w", predictionCol="_cal").fit(
        small)


def apply_calibration(df: DataFrame, model, raw: str, name: str) -> DataFrame:
    model.setFeaturesCol(raw)
    return model.transform(df).withColumn(name, F.least(F.greatest("_cal", F.lit(0.0)), F.lit(1.0))).drop("_cal")


def tree_contributions(df: DataFrame, model: GBTClassificationModel, columns: Sequence[str], ident: str) -> DataFrame:
    """Per-row share of each feature in the model's margin: (id, bias, one column per feature, margin).

    Walking a tree, each split credits its feature with the change in node value. The trees are a fixed-size model, so
    they travel with the task; rows stay in Spark partitions.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = [float(w) for w in model.treeWeights]
    trees: dict[int, dict] = {}
    for r in sorted(nodes, key=lambda r: (r["treeID"], r["id"])):
        t = trees.setdefault(r["treeID"], {k: [] for k in ("left", "right", "feature", "cut", "value")})
        leaf = r["leftChild"] < 0
        t["left"].append(r["leftChild"])
        t["right"].append(r["rightChild"])
        t["feature"].append(-1 if leaf else r["split"]["featureIndex"])
        t["cut"].append(0.0 if leaf else r["split"]["leftCategoriesOrThreshold"][0])
        t["value"].append(r["prediction"])
    packed = [(weights[i], {k: np.array(v) for k, v in trees[i].items()}) for i in sorted(trees)]
    names = list(columns)

    def walk(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            credit, bias = np.zeros_like(x), 0.0
            for w, t in packed:
                at = np.zeros(len(x), int)
                bias += w * t["value"][0]
                while True:
                    inner = np.flatnonzero(t["left"][at] >= 0)
                    if not len(inner):
                        break
                    here = at[inner]
                    f = t["feature"][here]
                    nxt = np.where(x[inner, f] <= t["cut"][here], t["left"][here], t["right"][here])
                    np.add.at(credit, (inner, f), w * (t["value"][nxt] - t["value"][here]))
                    at[inner] = nxt
            out = pd.DataFrame(credit, columns=names)
            out.insert(0, ident, pdf[ident].to_numpy())
            out.insert(1, "bias", bias)
            out["margin"] = credit.sum(axis=1) + bias
            yield out

    fields = ", ".join(f"`{n}` double" for n in ("bias", *names, "margin"))
    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(walk, f"`{ident}` {kind}, {fields}")


# ---- evaluation over time

def time_folds(df: DataFrame, at: str, folds: int = 5) -> list[float]:
    """Cut points of expanding folds: fold i trains before cut i and tests up to cut i + 1."""
    return od.quantiles(df, at, [i / (folds + 1) for i in range(1, folds + 1)])


def with_fold(df: DataFrame, at: str, folds: int = 5) -> DataFrame:
    """Add ``fold``: the fold a row is tested in, 0 for rows that only train."""
    marks = F.array(*[F.lit(c) for c in time_folds(df, at, folds)])
    return df.withColumn("fold", F.size(F.filter(marks, lambda c: c <= F.col(at).cast("double"))))


def time_series_cv(df: DataFrame, at: str, label: str, fit: Callable, grid: Sequence[dict], folds: int = 5, score: str = "score") -> DataFrame:
    """Average precision per parameter set and fold. ``fit(train, **params)`` returns a function that scores a DataFrame."""
    base = with_fold(df, at, folds)
    out = None
    for i, params in enumerate(grid):
        for f in range(1, folds + 1):
            scored = fit(base.filter(F.col("fold") < f), **params)(base.filter(F.col("fold") == f))
            row = en.evaluate(scored, label, score, 0.5).select(
                F.lit(i).alias("params"), F.lit(f).alias("fold"), "average_precision")
            out = row if out is None else out.unionByName(row)
    return out


def conformal(df: DataFrame, y: str, p: str, calibration, alpha: float = 0.1) -> DataFrame:
    """Split-conformal label sets: ``calibration`` is a condition that picks the calibration rows."""
    prob = F.col(p).cast("double")
    wrong = F.when(F.col(y) == 1, 1 - prob).otherwise(prob)
    cal = df.filter(calibration).select(wrong.alias("_s"))
    ranks = od.ranked_totals(cal, "_s", {"_n": F.lit(1).cast("long")})
    n = cal.count()
    need = math.ceil((n + 1) * (1 - alpha))
    bound = ranks.filter(F.col("_n_cum") >= need).agg(F.min("_s")).first()[0] if need <= n else None
    limit = F.lit(float("inf") if bound is None else bound)
    sets = F.array_compact(F.array(F.when(prob <= limit, 0), F.when(1 - prob <= limit, 1)))
    return df.filter(~calibration).withColumns({"label_set": sets, "set_size": F.size(sets), "covered": F.array_contains(sets, F.col(y).cast("int"))})


def survival(df: DataFrame, t: str, event: str) -> DataFrame:
    """Kaplan-Meier survival and Nelson-Aalen hazard at each distinct time."""
    base = df.select(F.col(t).cast("double").alias("time"), F.col(event).cast("long").alias("d"))
    table = od.ranked_totals(base, "time", {"n": F.lit(1).cast("long"), "events": F.col("d")})
    total = base.count()
    risk = F.lit(total) - F.col("n_cum") + F.col("n")
    steps = table.select("time", "events", risk.alias("at_risk"))
    share = F.col("events") / F.col("at_risk")
    logs = od.ranked_totals(steps, "time", {
        "ev": F.col("events"), "rk": F.col("at_risk"), "h": share,
        "l": F.when(share < 1, F.log(1 - share)).otherwise(0.0), "dead": (share >= 1).cast("long")})
    return logs.select("time", F.col("ev").alias("events"), F.col("rk").alias("at_risk"),
                       F.when(F.col("dead_cum") > 0, 0.0).otherwise(F.exp("l_cum")).alias("survival"), F.col("h_cum").alias("hazard"))


def survival_regression(df: DataFrame, xs: Sequence[str], t: str, event: str):
    base = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(df.withColumns({
        "_t": F.col(t).cast("double"), "_c": F.col(event).cast("double")}))
    return AFTSurvivalRegression(featuresCol="_x", labelCol="_t", censorCol="_c").fit(base.filter("_t > 0"))
