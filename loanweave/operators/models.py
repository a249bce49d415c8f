"""Model jobs: fitting, scoring and their metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.fixed import MODEL_FEATURES, POST_LOSS_COLUMNS, SEVERITY_FEATURES, SURVIVAL_FEATURES
from loanweave.operators import linear
from loanweave.operators.evaluation import (
    classification_metrics,
    portfolio_backtest,
    roc_pr_auc,
    score_thresholds,
    severity_errors,
    top_decile_capture,
)
from loanweave.operators.linear import Linear
from loanweave.operators.ordered import exact_quantiles
from loanweave.operators.features import temporal_split
from loanweave.operators.performance import severity_loans
from loanweave.storage import written

MAX_SEVERITY = 1.5

# --- preparation -------------------------------------------------------------------------


def _number(df: DataFrame, column: str) -> Column:
    """The feature as a double; absent columns and non-finite values are null."""
    if column not in df.columns:
        return F.lit(None).cast("double")
    value = F.col(column).cast("int").cast("double") if dict(df.dtypes)[column] == "boolean" \
        else F.col(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def numeric_features(df: DataFrame, features: Sequence[str], fill: float | None = None) -> DataFrame:
    """Add ``x_<feature>`` double columns; ``fill`` replaces missing values."""
    numbers = {f"x_{c}": _number(df, c) for c in features}
    if fill is not None:
        numbers = {k: F.coalesce(v, F.lit(fill)) for k, v in numbers.items()}
    return df.withColumns(numbers)


def _stages(features: Sequence[str], impute: bool) -> list:
    names = [f"x_{c}" for c in features]
    stages: list = []
    if impute:
        filled = [f"{n}_f" for n in names]
        stages.append(Imputer(strategy="median", inputCols=names, outputCols=filled))
        names = filled
    stages.append(VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"))
    return stages


def _class_counts(df: DataFrame, target: str) -> tuple[int, int]:
    row = df.agg(
        F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")
    ).first()
    if not row["p"] or not row["n"]:
        raise ValueError(f"{target} needs both events and non-events")
    return row["p"], row["n"]


def _labelled(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))


# --- classifiers -------------------------------------------------------------------------


def fit_logistic(
    train: DataFrame, target: str, features: Sequence[str] = tuple(MODEL_FEATURES),
    inverse_penalty: float = 1.0,
) -> Linear:
    """Median imputation, scaling and class-balanced logistic regression: the loss summed over rows
    against a unit ridge over ``inverse_penalty``."""
    rows = _labelled(train, target)
    _class_counts(rows, target)
    return linear.fit(
        rows, features, F.col("label"), linear.LOGISTIC, ridge=1.0 / inverse_penalty,
        weigh=lambda ones, zeros: ((ones + zeros) / (2.0 * ones), (ones + zeros) / (2.0 * zeros)),
    )


def fit_logistic_full(
    train: DataFrame, target: str, features: Sequence[str] = tuple(MODEL_FEATURES),
    penalty: float = 1e-5,
) -> Linear:
    """Logistic regression over all rows: missing values are 0, events weigh non-events/events; the
    ridge is ``penalty`` against the mean loss."""
    rows = _labelled(train, target)
    _class_counts(rows, target)
    return linear.fit(
        rows, features, F.col("label"), linear.LOGISTIC, mean_ridge=penalty, fill=0.0,
        weigh=lambda ones, zeros: (zeros / float(ones), 1.0),
    )


PATIENCE = 35  # rounds without a better validation loss after which boosting stops


def _first_trees(booster, model, count: int):
    """The boosted model of the first ``count`` trees of ``model``, as if fitted to that many."""
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    all_trees, all_weights = java.trees(), java.treeWeights()
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i in range(count):
        trees[i], weights[i] = all_trees[i], float(all_weights[i])
    kind = getattr(gateway.jvm, java.getClass().getName())
    return booster._copyValues(type(model)(kind(java.uid(), trees, weights)))


def _with_patience(
    stages: list, booster, rows: DataFrame, validation: DataFrame, max_iter: int, losses
) -> PipelineModel:
    """Boosting stopped at the best validation loss that ``PATIENCE`` further rounds do not better.

    Trees do not depend on how many follow, so the number of rounds is raised until the patience
    runs out or ``max_iter`` is reached, and the trees after the best count are then left out.
    """
    prepared = Pipeline(stages=stages).fit(rows)
    used = [c for c in ("label", "class_weight") if c in rows.columns] + ["features"]
    train, check = (written(prepared.transform(x).select(*used), "boosting") for x in (rows, validation))
    rounds = min(max_iter, 2 * PATIENCE)
    while True:
        model = booster.setMaxIter(rounds).fit(train)
        curve = losses(model, check)
        best = min(range(len(curve)), key=curve.__getitem__) + 1
        if best + PATIENCE <= rounds or rounds == max_iter:
            break
        rounds = min(max_iter, 5 * rounds)
    if best < rounds:
        model = _first_trees(booster.setMaxIter(best), model, best)
    return PipelineModel(stages=[*prepared.stages, model])


def tree_count(model: PipelineModel) -> int:
    """Trees of the boosted model at the end of a pipeline."""
    return model.stages[-1].getNumTrees


def fit_gbt(
    train: DataFrame, validation: DataFrame, target: str,
    features: Sequence[str] = tuple(MODEL_FEATURES), max_iter: int = 350, max_depth: int = 4,
    step: float = 0.05,
) -> PipelineModel:
    """Boosted trees with class weight, stopped early on all rows of the validation vintages."""
    events, others = _class_counts(train.where(F.col(target).isNotNull()), target)
    weight = F.when(F.col("label") == 1, others / float(events)).otherwise(1.0)

    def prepared(df: DataFrame) -> DataFrame:
        rows = numeric_features(_labelled(df, target), features, fill=0.0)
        return rows.withColumn("class_weight", weight)

    booster = GBTClassifier(
        maxDepth=max_depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.85",
        minInstancesPerNode=25, weightCol="class_weight", seed=42,
    )
    return _with_patience(
        _stages(features, False), booster, prepared(train), prepared(validation), max_iter,
        lambda model, rows: model.evaluateEachIteration(rows),
    )


def score(
    model: Linear | PipelineModel, df: DataFrame, name: str,
    features: Sequence[str] = tuple(MODEL_FEATURES), fill: float | None = None,
) -> DataFrame:
    """Add the event probability as ``name``; features that ``df`` lacks count as missing. A linear
    model knows its features and fills; those given are for boosted trees."""
    if isinstance(model, Linear):
        return df.select(*df.columns, model.score(df).alias(name))
    scored = model.transform(numeric_features(df, features, fill))
    return scored.select(
        *df.columns, vector_to_array("probability").getItem(1).alias(name)
    )


def feature_importance(
    model: PipelineModel, target: str, features: Sequence[str] = tuple(MODEL_FEATURES)
) -> DataFrame:
    """Importance per feature, highest first (one row per feature of the fitted model)."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    values += [0.0] * (len(features) - len(values))  # the last features may be in no tree
    return SparkSession.active().createDataFrame(
        [(target, f, float(v)) for f, v in zip(features, values, strict=True)],
        "target string, feature string, importance double",
    ).orderBy(F.desc("importance"), "feature")


def metric_row(
    scored: DataFrame, model_name: str, target: str, score_column: str,
    weight: str | None = "current_upb",
) -> DataFrame:
    """One row of out-of-time metrics: losses, areas and top-decile capture."""
    row = classification_metrics(scored, target, score_column, weight)
    areas = roc_pr_auc(score_thresholds(scored, target, score_column, weight))
    decile = top_decile_capture(scored, target, score_column)
    return row.withColumns(
        {
            "roc_auc": areas.select("roc_auc").scalar(),
            "pr_auc": areas.select("pr_auc").scalar(),
            "top_decile_capture_rate": decile.select("top_decile_capture_rate").scalar(),
        }
    ).select(F.lit(model_name).alias("model_name"), F.lit(target).alias("target"), "*")


def model_comparison(*metrics: DataFrame) -> DataFrame:
    """Metric tables of several models stacked; metrics a model lacks are null."""
    union = metrics[0]
    for table in metrics[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    return union.orderBy("target", "model_name")


def score_holdout(
    snapshots: DataFrame, models: dict[str, tuple[Linear | PipelineModel, Sequence[str], float | None]]
) -> DataFrame:
    """Scores of every model (name -> model, features, fill) on the given snapshots."""
    keep = [
        "loan_id", "scoring_date", "origination_year", "current_upb", "fico", "original_ltv",
        "credit_event_12m", "prepayment_12m",
    ]
    scored = snapshots
    for name, (model, features, fill) in models.items():
        scored = score(model, scored, name, features, fill)
    return scored.select(*[c for c in keep if c in scored.columns], *models)


def run_record(
    metrics: DataFrame, train: str, validation: str, test: str, features: int
) -> DataFrame:
    """Metric rows with the tags of a training run, to append to a model-runs table."""
    return metrics.withColumns(
        {
            "train_vintage_range": F.lit(train),
            "validation_vintage_range": F.lit(validation),
            "test_vintage_range": F.lit(test),
            "target_definition": F.concat("target", F.lit(" in t+1 through t+12")),
            "feature_set_version": F.lit("snapshot_v1"),
            "feature_count": F.lit(features),
            "logged_at": F.current_timestamp(),
        }
    )


# --- composed jobs -----------------------------------------------------------------------


def baseline_job(
    snapshots: DataFrame, target: str, train_end: int, validation_end: int,
    features: Sequence[str] = tuple(MODEL_FEATURES),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The baseline over vintages: fit on those up to ``train_end``, score those after
    ``validation_end``; (scored rows, one row of metrics, backtest by date and vintage)."""
    split = temporal_split(_labelled(snapshots, target).drop("label"), train_end, validation_end)
    train = written(split.where(F.col("split") == "train"), "baseline-train")
    test = split.where(F.col("split") == "test").drop("split")
    # Scored once, stored, and read by every measure.
    scored = written(score(fit_logistic(train, target, features), test, "score", features), "baseline-scores")
    metrics = metric_row(scored, "baseline", target, "score")
    return scored, metrics, portfolio_backtest(scored, target, "score", ("scoring_date", "origination_year"))


def split_backtest(
    snapshots: DataFrame, target: str, years: Sequence[int],
    features: Sequence[str] = tuple(MODEL_FEATURES),
) -> DataFrame:
    """The baseline's backtest for several splits: fitted on vintages up to each year and tested
    on those after it; one row per split year, date and vintage."""
    tables = [
        baseline_job(snapshots, target, year, year, features)[2].withColumn("split_year", F.lit(year))
        for year in years
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


# --- severity ----------------------------------------------------------------------------


def severity_training(panel: DataFrame) -> DataFrame:
    """Credit-event loans with a severity in [0, 1.5]; columns known only later are dropped."""
    return (
        severity_loans(panel)
        .where(F.col("loss_severity").between(0.0, MAX_SEVERITY))
        .drop(*POST_LOSS_COLUMNS)
    )


def fit_severity_ridge(
    train: DataFrame, features: Sequence[str] = tuple(SEVERITY_FEATURES), alpha: float = 1.0
) -> Linear:
    """Ridge regression of severity after imputation and scaling: half the squared errors, summed,
    plus ``alpha`` times half the squared coefficients."""
    rows = train.where(F.col("loss_severity").isNotNull())
    if rows.limit(10).count() < 10:
        raise ValueError("too few realized losses to fit severity")
    return linear.fit(rows, features, F.col("loss_severity"), linear.IDENTITY, ridge=alpha)


def fit_severity_gbt(
    train: DataFrame, validation: DataFrame, features: Sequence[str] = tuple(SEVERITY_FEATURES),
    max_iter: int = 300, max_depth: int = 5,
) -> PipelineModel:
    """Boosted-tree severity regression, stopped early on the validation vintages."""
    booster = GBTRegressor(
        maxDepth=max_depth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        minInstancesPerNode=20, seed=42,
    )
    rows, check = (
        numeric_features(df.withColumn("label", F.col("loss_severity")), features)
        for df in (train, validation)
    )
    return _with_patience(
        _stages(features, True), booster, rows, check, max_iter,
        lambda model, df: model.evaluateEachIteration(df, "squared"),
    )


def predict_severity(
    model: Linear | PipelineModel, df: DataFrame, features: Sequence[str] = tuple(SEVERITY_FEATURES),
    name: str = "loss_severity_score",
) -> DataFrame:
    """Add the predicted severity, clipped to [0, 1.5]."""
    if isinstance(model, Linear):
        predicted = df.withColumn("prediction", model.score(df))
    else:
        predicted = model.transform(numeric_features(df, features))
    clipped = F.least(F.greatest("prediction", F.lit(0.0)), F.lit(MAX_SEVERITY))
    return predicted.select(*df.columns, clipped.alias(name))


def severity_metrics(model: Linear | PipelineModel, test: DataFrame, model_name: str) -> DataFrame:
    scored = predict_severity(model, test)
    return severity_errors(
        scored, "loss_severity", "loss_severity_score", "zero_balance_removal_upb"
    ).select(F.lit(model_name).alias("model_name"), "*")


# --- survival ----------------------------------------------------------------------------


def survival_rows(panel: DataFrame, event: str, time: str = "loan_age") -> DataFrame:
    """One row per loan: whether the event occurred, the last time and last attribute values.

    ``time_upper`` equals ``time_lower`` for events and is -1 for censored loans.
    """
    skip = {
        "loan_id", event, time, "reporting_period", "zero_balance_code",
        "zero_balance_effective_date", "zero_balance_removal_upb", "actual_loss_calculation",
        "net_sale_proceeds", "mi_recoveries", "non_mi_recoveries", "expenses", "actual_loss",
    }
    kept = [c for c in panel.columns if c not in skip]
    last = F.max_by(F.struct(F.col(time).alias("time_obs"), *kept), "reporting_period")
    rows = (
        panel.groupBy("loan_id")
        .agg(F.bool_or(event).alias("event_occurred"), last.alias("last"))
        .select("loan_id", "event_occurred", "last.*")
    )
    upper = F.when(F.col("event_occurred"), F.col("time_obs").cast("double")).otherwise(-1.0)
    return rows.withColumns({"time_lower": F.col("time_obs"), "time_upper": upper})


def survival_table(panel: DataFrame, event: str) -> DataFrame:
    """First event age, else last age, per loan with its static attributes; 1e9 if censored."""
    static = ["origination_year", *SURVIVAL_FEATURES]
    rows = panel.groupBy("loan_id", *static).agg(
        F.min(F.when(F.col(event), F.col("loan_age"))).alias("event_age"),
        F.max("loan_age").alias("last_age"),
    )
    happened = F.col("event_age").isNotNull()
    return rows.select(
        "loan_id",
        *static,
        F.coalesce("event_age", "last_age").alias("time_lower"),
        F.when(happened, F.col("event_age").cast("double")).otherwise(1e9).alias("time_upper"),
        happened.cast("int").alias("event_observed"),
    )


def fit_aft(
    train: DataFrame, features: Sequence[str] = tuple(SURVIVAL_FEATURES), penalty: float = 1e-6
) -> Linear:
    """Accelerated failure time regression (Weibull) with right-censored loans. The slight ridge,
    against the mean loss, makes the optimum unique when features repeat one another."""
    rows = train.where(F.col("time_lower") > 0)
    return linear.fit(
        rows, features, F.ln(F.col("time_lower").cast("double")), linear.WEIBULL, mean_ridge=penalty,
        seen=F.col("event_observed"),
    )


def predict_survival(model: Linear, df: DataFrame) -> DataFrame:
    """Add the predicted time to the event."""
    return df.select(*df.columns, model.score(df).alias("predicted_time"))


def aft_metrics(
    model: Linear, train: DataFrame, test: DataFrame, model_name: str
) -> DataFrame:
    """Loan and event counts, and the median predicted time of events and of censored loans."""
    scored = predict_survival(model, test)
    medians = exact_quantiles(scored, "predicted_time", [0.5], by=["event_observed"])

    def median(flag: int) -> Column:
        return medians.where(F.col("event_observed") == flag).select("q0").scalar()

    trained = train.select(F.struct(F.count(F.lit(1)).alias("n"), F.sum("event_observed").alias("e"))).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("test_loans"), F.sum("event_observed").alias("test_events")
    ).select(
        F.lit(model_name).alias("model_name"),
        trained["n"].alias("train_loans"),
        "test_loans",
        trained["e"].alias("train_events"),
        "test_events",
        median(1).alias("median_predicted_time_event"),
        median(0).alias("median_predicted_time_censored"),
    )
