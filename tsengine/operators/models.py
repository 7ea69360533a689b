"""Forecast models: features, filters and an estimator of Spark ML, fitted and applied to whole domains."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.operators import filters as flt
from tsengine.operators import align, metrics, monitor, networks, trees


def linear(**params):
    return LinearRegression(**params)


def ridge(alpha: float, n_rows: int, label_sd: float = 1.0, **params):
    """The penalty alpha * |w|^2 on a sum of squares. Spark's is on half the mean of squares of the label over its deviation."""
    return LinearRegression(regParam=alpha * label_sd / n_rows, elasticNetParam=0.0, standardization=False, **params)


def lasso(alpha: float, **params):
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, **params)


def elastic_net(alpha: float, l1_ratio: float, label_sd: float = 1.0, **params):
    """alpha * l1_ratio on |w| and half of alpha * (1 - l1_ratio) on |w|^2, for half the mean of squares; of the two, Spark divides only the second by the label's deviation."""
    first, second = alpha * l1_ratio, alpha * (1 - l1_ratio) * label_sd
    return LinearRegression(regParam=first + second, elasticNetParam=first / (first + second) if alpha else 0.0, standardization=False, **params)


def boosted_trees(**params):
    return GBTRegressor(**({"seed": 32} | params))


ESTIMATORS: dict[str, Callable] = {
    "linear": linear, "ridge": ridge, "lasso": lasso, "elastic_net": elastic_net, "boosted_trees": boosted_trees,
    "boosted_tree_classifier": lambda **p: GBTClassifier(**({"seed": 32} | p)), "logistic": lambda **p: LogisticRegression(**p),
    "perceptron_classifier": lambda **p: MultilayerPerceptronClassifier(**({"seed": 32} | p)),
}


#: Estimators of this library: fit(rows, features, label, **params) gives what predicts as a column; their class by name, for loading.
OWN: dict[str, tuple[Callable, type]] = {"learned_trees": (trees.fit, trees.Ensemble), "network": (networks.fit, networks.Network)}

#: What the data give to an estimator whose penalty depends on them.
FROM_DATA = {"ridge": ("n_rows", "label_sd"), "elastic_net": ("label_sd",)}


@dataclass
class TimeSeriesModel:
    """Feature columns, filters (for fitting and predicting) and an estimator by name; scale_target fits on z-scores of the label.

    watch keeps statistics of the features, before and after the filters, of the rows fitted on (``fit_stats``). With a
    validation share, boosted trees stop early by rows that a hash of place and time sets aside. Estimators of OWN take
    features as they are: trees need no scale, and the network makes its own.
    """

    features: list[str]
    label: str = "value"
    estimator: str = "linear"
    params: dict = field(default_factory=dict)
    scale_features: bool = False
    scale_target: bool = False
    impute: float | None = None
    before: list = field(default_factory=list)
    watch: bool = False
    validation: float = 0.0

    def __post_init__(self):
        self.fitted = None  # a PipelineModel, or what an estimator of OWN gives
        self.target = (0.0, 1.0)
        self.means: dict[str, float] = {}
        self.fit_stats: dict[str, DataFrame] = {}
        self.fit_span: tuple | None = None

    def _ready(self, df: DataFrame) -> DataFrame:
        df = flt.chain(df, self.before)
        if self.impute is not None:  # trees see what is missing
            df = df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in self.features}).fillna(self.impute, subset=self.features)
        return df

    def _inputs(self) -> list[str]:
        return self.features + ([f"{c}__missing" for c in self.features] if self.impute is not None else [])

    def features_frame(self, df: DataFrame, with_filters: bool = True) -> DataFrame:
        """(location, date_time, features), as the estimator sees them or as they come."""
        return (self._ready(df) if with_filters else df).select("location", "date_time", *(self._inputs() if with_filters else self.features))

    def stats(self, df: DataFrame, by_location: bool = False, quantiles=monitor.QUANTILES) -> dict[str, DataFrame]:
        """Statistics of the features before and after the filters."""
        return {k: monitor.feature_stats(self.features_frame(df, f), self.features, by_location, quantiles) for k, f in (("unfiltered", False), ("filtered", True))}

    def range(self, df: DataFrame, end: str) -> DataFrame:
        """Presence, freshness and range of the label, by location and for all."""
        return monitor.range_stats(df, self.label, end)

    def fit(self, df: DataFrame) -> TimeSeriesModel:
        """Rows without a label are not fitted on, nor are rows with a missing feature unless imputed. The rows are computed once."""
        ready = flt.drop_unlabelled(self.label)(self._ready(df))
        keys = [c for c in ("location", "date_time") if c in ready.columns]
        rows = ready.select(*keys, *dict.fromkeys([*self._inputs(), self.label])).persist()
        try:
            span = [F.min("date_time"), F.max("date_time")] if "date_time" in keys else [F.lit(None), F.lit(None)]
            whole = F.lit(True)
            for c in self._inputs():
                whole = whole & F.col(c).isNotNull()
            fitted = [F.count_if(whole).alias("n_rows"), F.stddev_pop(F.when(whole, F.col(self.label))).alias("label_sd")]
            r = rows.agg(F.avg(self.label), F.stddev_pop(self.label), *span, *fitted, *(F.avg(c).alias(c) for c in self.features)).first()
            if self.scale_target:
                self.target = (r[0] or 0.0, r[1] or 1.0)
            self.fit_span, self.means = (r[2], r[3]), {c: float(r[c] or 0.0) for c in self.features}
            labelled = rows.withColumn("__y", (F.col(self.label) - self.target[0]) / self.target[1])
            if self.estimator in OWN:
                self.fitted = OWN[self.estimator][0](labelled, self._inputs(), "__y", **self.params)
                return self._watched(df)
            stages = [VectorAssembler(inputCols=self._inputs(), outputCol="__x", handleInvalid="skip")]
            if self.scale_features:
                stages.append(StandardScaler(inputCol="__x", outputCol="__z", withMean=True))
            found = {"n_rows": max(r["n_rows"], 1), "label_sd": (r["label_sd"] or 1.0) / self.target[1]}
            model = ESTIMATORS[self.estimator](**{k: found[k] for k in FROM_DATA.get(self.estimator, ())} | self.params).setFeaturesCol("__z" if self.scale_features else "__x").setLabelCol("__y").setPredictionCol("__p")
            if self.validation:
                labelled = labelled.withColumn("__aside", F.pmod(F.xxhash64(*keys), F.lit(1000)) < int(1000 * self.validation))
                model = model.setValidationIndicatorCol("__aside")
            self.fitted = Pipeline(stages=[*stages, model]).fit(labelled)
        finally:
            rows.unpersist()
        return self._watched(df)

    def _watched(self, df: DataFrame) -> TimeSeriesModel:
        if self.watch:
            self.fit_stats = self.stats(df)
        return self

    def predict(self, df: DataFrame, feature_score: bool = False) -> DataFrame:
        """(location, date_time, label, predicted): every row comes back, null where a feature is missing. One pass, no join."""
        ready = self._ready(df)
        if feature_score:  # of the features as they come, before the filters: they travel along
            raw = F.struct(*(F.col(c).alias(c) for c in self.features)).alias("__raw")
            ready = self._ready(df.select("*", raw))
        whole = F.lit(True)
        for c in self.features:
            whole = whole & F.col(c).isNotNull()
        if self.estimator in OWN:
            found, p = ready, self.fitted.column(self._inputs())
            whole = F.lit(True) if getattr(self.fitted, "takes_missing", False) else whole
        else:
            assembler, *rest = self.fitted.stages
            found, p = PipelineModel([assembler.copy({assembler.handleInvalid: "keep"}), *rest]).transform(ready), F.col("__p")
        predicted = F.when(whole, p * self.target[1] + self.target[0]).alias("predicted")
        return found.select("location", "date_time", self.label, predicted, *([self.presence(lambda c: F.col("__raw")[c]).alias("feature_score")] if feature_score else []))

    def attributions(self):
        """The array of Shapley values of a row's inputs, for trees; null for other estimators."""
        if isinstance(self.fitted, trees.Ensemble):
            return self.fitted.attribution(self._inputs())
        if self.estimator in OWN or not hasattr(self.fitted.stages[-1], "featureImportances") or self.estimator not in ("boosted_trees",):
            return None
        inputs = vector_to_array("__z" if self.scale_features else "__x")
        return trees.of_spark(self.fitted.stages[-1], self._inputs()).attribution([inputs[i] for i in range(len(self._inputs()))])

    def presence(self, of=F.col):
        """How much of a row's explanation the present features carry: by attributions of trees, by coefficients, else all or nothing."""
        there = {c: of(c).isNotNull().cast("double") for c in self.features}
        found = self.attributions()
        if found is not None:  # a feature and the mark of its absence count together
            n = len(self.features)
            return feature_score(there, {c: F.abs(found[i] + found[i + n] if self.impute is not None else found[i]) for i, c in enumerate(self.features)})
        last = None if self.estimator in OWN else self.fitted.stages[-1]
        if hasattr(last, "featureImportances"):  # of trees for classes: one weight for all rows
            n, held = len(self.features), last.featureImportances.toArray()
            return feature_score(there, {c: F.lit(float(sum(held[i::n]))) for i, c in enumerate(self.features)})
        if not hasattr(last, "coefficients") or self.impute is not None:
            total = sum(there.values(), F.lit(0.0))
            return F.when(total == len(self.features), 1.0).otherwise(0.0)
        weight = {c: abs(float(w)) for c, w in zip(self.features, last.coefficients, strict=True)}
        return feature_score(there, {c: F.lit(w) * F.abs(F.coalesce(of(c), F.lit(0.0)) - self.means[c]) for c, w in weight.items()})

    def score(self, df: DataFrame) -> DataFrame:
        return metrics.scored(self.predict(df), self.label, "predicted")

    def spec(self) -> dict:
        plain = {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__ and k != "before"}
        return plain | {"before": flt.to_specs(self.before), "target": list(self.target), "means": self.means}

    def save(self, path: str) -> None:
        """The fitted pipeline and the rest as JSON, named filters included."""
        own = self.estimator in OWN
        text = json.dumps(self.spec() | ({"fitted": self.fitted.to_dict()} if own else {}))
        if not own:
            self.fitted.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(text,)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")

    @classmethod
    def load(cls, spark: SparkSession, path: str, before: list | None = None) -> TimeSeriesModel:
        """before replaces the saved filters, for those that are plain functions."""
        spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        held = spec.pop("fitted", None)
        target, means, filters = spec.pop("target"), spec.pop("means"), flt.from_specs(spec.pop("before"))
        model = cls(**spec, before=filters if before is None else before)
        model.target, model.means = tuple(target), means
        model.fitted = PipelineModel.load(f"{path}/model") if held is None else OWN[model.estimator][1].from_dict(held)
        return model


@dataclass
class HierarchyModel:
    """A model of the children of a hierarchy (parent, child), whose predictions and labels are added up to their parents.

    Parents' values are null only where all their children's are.
    """

    model: TimeSeriesModel
    hierarchy: DataFrame

    def _below(self, df: DataFrame, parents: list[str] | None) -> DataFrame:
        some = self.hierarchy if parents is None else self.hierarchy.filter(F.col("parent").isin(parents))
        return df.join(some.select(F.col("child").alias("location")).distinct(), "location", "left_semi")

    def fit(self, df: DataFrame, parents: list[str] | None = None) -> HierarchyModel:
        self.model.fit(self._below(df, parents))
        return self

    def predict(self, df: DataFrame, parents: list[str] | None = None) -> DataFrame:
        """(location, date_time, label, predicted) of the parents."""
        some = self.hierarchy if parents is None else self.hierarchy.filter(F.col("parent").isin(parents))
        return align.rollup(some, self.model.predict(self._below(df, parents)), [self.model.label, "predicted"])

    def metrics(self, df: DataFrame, parents: list[str] | None = None) -> DataFrame:
        return metrics.scored(self.predict(df, parents), self.model.label, "predicted", ["location"])

    def features_frame(self, df: DataFrame, parents: list[str] | None = None) -> DataFrame:
        return self.model.features_frame(self._below(df, parents))

    def save(self, path: str) -> None:
        self.model.save(path)
        self.hierarchy.select("parent", "child").write.mode("overwrite").parquet(f"{path}/hierarchy")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HierarchyModel:
        return cls(TimeSeriesModel.load(spark, path), spark.read.parquet(f"{path}/hierarchy"))


@dataclass
class TableModel:
    """Predictions and labels read from a table by place and time, under the interface of a model."""

    table: DataFrame
    label: str = "true"
    predicted: str = "predicted"

    def fit(self, df: DataFrame | None = None) -> TableModel:
        return self

    def predict(self, domain: DataFrame) -> DataFrame:
        """(location, date_time, label, predicted) at the domain; null where the table has nothing."""
        return align.select(domain, self.table, [self.label, self.predicted]).withColumnRenamed(self.predicted, "predicted")

    def score(self, domain: DataFrame) -> DataFrame:
        return metrics.scored(self.predict(domain), self.label, "predicted")


def feature_score(present: dict, weights: dict):
    """Sum of weights of present features over the sum of all; null if that is zero."""
    zero = F.lit(0.0)
    return F.try_divide(sum((present[c] * weights[c] for c in weights), zero), sum(weights.values(), zero))


def identity_prediction(df: DataFrame, feature: str) -> DataFrame:
    return df.withColumn("predicted", F.col(feature))


def regression_line(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Single-feature least squares per group, as plain aggregates."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))
