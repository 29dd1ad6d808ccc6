"""Price models: feature matrix, forest and others, cross-validation, prediction."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from . import metrics, neighbours

FOREST = {"numTrees": 200, "maxDepth": 20, "featureSubsetStrategy": "sqrt", "bootstrap": False, "seed": 42}


def _pipeline(features: list[str], estimator, expand: int = 1) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")]
    if expand > 1:
        stages.append(PolynomialExpansion(degree=expand, inputCol="features", outputCol="expanded"))
        estimator = estimator.setFeaturesCol("expanded")
    return Pipeline(stages=[*stages, estimator])


def forest(label: str, **over) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, **(FOREST | over))


def polynomial_ridge(label: str, strength: float = 1.0) -> LinearRegression:
    """Ridge over expanded features, in place of a kernel."""
    return LinearRegression(labelCol=label, regParam=strength, elasticNetParam=0.0)


def train(df: DataFrame, features: list[str], label: str, estimator=None, expand: int = 1) -> PipelineModel:
    """Fitted model of log prices; rows with a missing feature are skipped."""
    return _pipeline(features, estimator if estimator is not None else forest(label), expand).fit(df)


def cross_validate(df: DataFrame, features: list[str], label: str, estimator, fold: str, folds: int = 5, metric: str = "r2", grid: list | None = None) -> tuple[list[float], PipelineModel]:
    """Mean metric of each setting over given folds, and the best model refitted."""
    cv = CrossValidator(estimator=_pipeline(features, estimator), estimatorParamMaps=grid or ParamGridBuilder().build(), evaluator=RegressionEvaluator(labelCol=label, metricName=metric), numFolds=folds, foldCol=fold, parallelism=2)
    fitted = cv.fit(df)
    return list(fitted.avgMetrics), fitted.bestModel


def grid_search(df: DataFrame, features: list[str], label: str, fold: str, folds: int = 5) -> dict[str, float]:
    """Best mean r2 of linear, tree and forest models over small grids."""
    linear, tree, trees = LinearRegression(labelCol=label), DecisionTreeRegressor(labelCol=label, seed=42), RandomForestRegressor(labelCol=label, seed=42)
    grids = {
        "linear": (linear, ParamGridBuilder().addGrid(linear.regParam, [0.0, 0.1]).build()),
        "tree": (tree, ParamGridBuilder().addGrid(tree.maxDepth, [3, 6]).build()),
        "forest": (trees, ParamGridBuilder().addGrid(trees.numTrees, [10, 20]).build()),
    }
    return {name: max(cross_validate(df, features, label, e, fold, folds, grid=g)[0]) for name, (e, g) in grids.items()}


def evaluate(model: PipelineModel | None, df: DataFrame, label: str) -> DataFrame | None:
    """Metrics of prices from log predictions; None without a model."""
    if model is None:
        return None
    priced = model.transform(df).select(F.expm1(label).alias("truth"), F.expm1("prediction").alias("predicted"))
    return metrics.regression_metrics(priced, "truth", "predicted")


def predict(model: PipelineModel, df: DataFrame, out: str = "predicted_price") -> DataFrame:
    """Rows with whole predicted prices."""
    return model.transform(df).withColumn(out, numeric.log_to_price(F.col("prediction"))).select(*df.columns, out)


def knn_predict(train_rows: DataFrame, asked: DataFrame, features: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """Mean label of the k nearest training rows."""
    return neighbours.knn_predict(train_rows, asked, features, label, key, k)


def searched(label: str) -> dict[str, tuple]:
    """The price model's grids. Spark's deepest tree, 30, stands for one without a bound; it has no least size of a split."""
    linear, tree, trees = LinearRegression(labelCol=label), DecisionTreeRegressor(labelCol=label, seed=42), RandomForestRegressor(labelCol=label, seed=42)
    return {
        "linear": (linear, ParamGridBuilder().build()),
        "tree": (tree, ParamGridBuilder().addGrid(tree.maxDepth, [2, 4, 6, 8, 10, 30]).addGrid(tree.minInstancesPerNode, [1, 3, 5]).build()),
        "forest": (
            trees,
            ParamGridBuilder().addGrid(trees.numTrees, [100, 200, 500]).addGrid(trees.maxDepth, [10, 20, 30]).addGrid(trees.minInstancesPerNode, [1, 2, 4])
            .addGrid(trees.featureSubsetStrategy, ["sqrt", "all"]).addGrid(trees.bootstrap, [True, False]).build(),
        ),
    }


def search(df: DataFrame, features: list[str], label: str, key: str, fold: str, folds: int = 5, grids: dict[str, tuple] | None = None, most_neighbours: int = 30) -> list[dict]:
    """Mean squared error over given folds of every setting of every model, best first; neighbours for all k from one search a fold."""
    out = []
    for name, (estimator, grid) in (searched(label) if grids is None else grids).items():
        errors, _ = cross_validate(df, features, label, estimator, fold, folds, "mse", grid)
        out += [{"model": name, "setting": {p.name: v for p, v in setting.items()}, "mse": e} for setting, e in zip(grid, errors)]
    if most_neighbours:
        _, errors = neighbours.best_k(df, features, label, key, fold, most_neighbours)
        out += [{"model": "neighbours", "setting": {"k": k}, "mse": e} for k, e in enumerate(errors, 1)]
    return sorted(out, key=lambda r: r["mse"])


def ablation(df: DataFrame, features: list[str], left_out: list[str], label: str, estimator, fold: str, folds: int = 5, metric: str = "mse") -> dict[str, float]:
    """The metric over folds with all features and without some of them."""
    rest = [f for f in features if f not in left_out]
    return {name: cross_validate(df, some, label, estimator, fold, folds, metric)[0][0] for name, some in (("all", features), ("rest", rest))}


def save(model: PipelineModel, path: str, state: dict[str, DataFrame] | None = None) -> None:
    """Write a fitted model and the small tables that its features were fitted with."""
    model.write().overwrite().save(f"{path}/model")
    for name, fitted in (state or {}).items():
        fitted.write.mode("overwrite").parquet(f"{path}/state/{name}")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """A saved model and the named tables of its features."""
    return PipelineModel.load(f"{path}/model"), {name: spark.read.parquet(f"{path}/state/{name}") for name in names}


def mean_baseline(train_rows: DataFrame, asked: DataFrame, price: str, out: str = "predicted") -> DataFrame:
    """expm1 of the mean log price of training for every row."""
    mean = train_rows.agg(F.expm1(F.avg(F.log1p(price))).alias(out))
    return asked.crossJoin(F.broadcast(mean))


def group_baseline(train_rows: DataFrame, asked: DataFrame, keys: list[str], price: str, out: str = "predicted") -> DataFrame:
    """Mean price of the group in training, the overall mean for groups not seen."""
    by = train_rows.groupBy(*keys).agg(F.avg(price).alias("_group"))
    overall = train_rows.agg(F.avg(price).alias("_all"))
    joined = asked.join(by, keys, "left").crossJoin(F.broadcast(overall))
    return joined.withColumn(out, F.coalesce("_group", "_all")).drop("_group", "_all")


def feature_matrix(df: DataFrame, branches: dict[str, Column]) -> DataFrame:
    """The named features alone, as doubles."""
    return df.select(*(c.cast("double").alias(name) for name, c in branches.items()))
