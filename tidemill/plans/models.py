"""Models of a backtest: of all folds at once, or of one fold by ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.costs import Costs, classified_return, selected_return, takes, thresholds
from tidemill.operators.cv import gather
from tidemill.plans import boosting, folds
from tidemill.storage import saved

QUANTILES = (0.7, 0.8, 0.9, 0.95)
#: Never features: what is known only after the event. ``weight`` depends on later returns, too.
LATER = ("fwd_log_ret", "t_end", "t1_vert", "label", "weight", "row_idx", "fold")


def feature_columns(df: DataFrame, compat: bool = False) -> list[str]:
    """The numeric columns of ``df`` but those of later knowledge; ``compat`` leaves ``weight`` in."""
    late = [c for c in LATER if not (compat and c == "weight")]
    return [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "tinyint") and c not in late and not c.startswith(("t1_", "t_end", "label", "meta_"))]


def classifiers(trees: int = 300, weight_sum: float = 1.0) -> dict:
    """Scaled logistic regression (its L2 share is 1 over the sum of the weights of the rows that it is fitted on), and boosted trees of the lowest class against the
    rest, as only its probability is used."""
    gbt = GBTClassifier(featuresCol="x", labelCol="lowest", weightCol="w", maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    return {"logit_cls": LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", family="multinomial", maxIter=1000, regParam=1 / max(1.0, weight_sum)), "gbt_cls": gbt}


def regressors(trees: int = 300) -> dict:
    return {"lin_reg": LinearRegression(featuresCol="x", labelCol="fwd_log_ret", weightCol="w", regParam=0.0), "gbt_reg": GBTRegressor(featuresCol="x", labelCol="fwd_log_ret", weightCol="w", maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)}


def strategies(names: Sequence[str]) -> list[str]:
    """The strategies that models of these names give."""
    return [s for n in names for s in ([n] if n.endswith("_cls") else [f"{n}__q{round(100 * q)}" for q in QUANTILES])]


def assembled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` complete in ``columns``, as a vector ``raw``, with the class y = label + 1, whether it is the lowest, and the weight w (1 if missing)."""
    rows = rows.dropna(subset=[*columns, "fwd_log_ret", "label"])
    out = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(rows)
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    return out.withColumns({"y": (F.col("label") + 1).cast("double"), "lowest": (F.col("label") == -1).cast("double"), "w": weight})


def score_fold(data: DataFrame, splits: DataFrame, fold: int, name: str, model, keep: Sequence[str]) -> DataFrame:
    """(keep, role, prediction) of all rows of one fold by one model fitted on its training rows: for classes the
    probability of the lowest, else the prediction."""
    rows = gather(data, splits.filter(F.col("fold") == fold))
    pipe = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="x", withMean=True), model])
    out = pipe.fit(rows.filter("role = 'train'")).transform(rows)
    if name == "logit_cls":
        score = vector_to_array("probability")[0]
    elif name == "gbt_cls":
        score = vector_to_array("probability")[1]
    else:
        score = F.col("prediction")
    return out.select(*keep, "role", F.lit(fold).alias("fold"), F.lit(name).alias("model"), score.alias("score"))


def run_scheme(rows: DataFrame, splits: DataFrame, columns: Sequence[str], costs: Costs = Costs(), trees: int = 300, models: Sequence[str] = ("logit_cls", "lin_reg"), compat: bool = False) -> DataFrame:
    """(row_idx, t0, fold, strategy, ret, taken) of the test rows of each fold: a classifier sells where the probability of a
    fall passes the 90th percentile of its training rows, a regressor buys where its prediction passes each of several.

    Models of all folds are fitted together and every row is scored once for all its folds, so the number of jobs depends
    on models, trees and Newton steps, not on folds. Thresholds join the scores as a row a fold and model.
    """
    table, of = folds.folded(rows, splits, columns)
    forest = None
    if of and any(m.startswith("gbt") for m in models):
        known = folds.Statistics(table, len(of), len(columns))
        forest = boosting.boosted(table, len(of), len(columns), known.mean_return, boosting.Settings(rounds=trees))
    scores = saved(folds.scored(table, of, len(columns), models, forest))
    sells, by = F.col("model").endswith("_cls"), ["fold", "model"]
    train, test = scores.filter("role = 'train'"), scores.filter("role = 'test'")
    limit = thresholds(train.filter(sells), by, [0.9], "score").unionByName(thresholds(train.filter(~sells), by, QUANTILES, "score"))
    test = test.join(F.broadcast(limit), by)  # a row a fold, model and quantile
    signal = F.when(F.col("score") >= F.col("threshold"), -1).otherwise(0)
    sold = classified_return(signal, F.col("fwd_log_ret"), F.col("t0"), costs)
    bought = selected_return(takes(F.col("score"), F.col("threshold"), compat), F.col("fwd_log_ret"), F.col("t0"), costs)
    name = F.when(sells, F.col("model")).otherwise(F.concat("model", F.lit("__q"), F.round(F.col("q") * 100).cast("int")))
    out = test.select("row_idx", "t0", "fold", name.alias("strategy"), F.when(sells, sold).otherwise(bought).alias("ret"))
    return out.withColumn("taken", F.col("ret") != 0)
