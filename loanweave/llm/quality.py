"""Quality classification with hierarchical empirical Bayes.

A logistic model gives each document its own evidence. Sites add theirs: the mean evidence of a
host is shrunk toward the corpus mean, and that of a path (a section of the host) toward its
host's posterior, by strengths that are estimated from how much sites differ beyond chance. A
document's own part is left out of its sites' posteriors. The score is the document's log odds
plus its path's posterior log odds over the corpus'; sparse sites hardly move it.
"""

from __future__ import annotations

from operator import eq

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanweave.llm.common import for_tasks
from loanweave.storage import written

TRAIN_ROWS = 6_000  # bound of the labelled sample that the model is fitted on
THRESHOLD = 0.5
FEATURES = (
    "log_words", "symbols", "bangs", "bars", "capitals", "repeats", "closing_marks", "digits",
)


def describe(text: str | None) -> list[float]:
    """The features of a whole text; zeros if it has no words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(words), text.count
    log_words = float(min(n, 1 << 20).bit_length())
    return [
        log_words,
        min(1.0, sum(map(count, "#$%&*@^~=<>{}")) / n),
        min(1.0, count("!") / n),
        min(1.0, count("|") / n),
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words[1:], words)) / n,
        min(1.0, (count(".") + count(",")) / n),
        min(1.0, sum(map(count, "0123456789")) / (4.0 * n)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(describe)


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[float], float]:
    """(weights, intercept) of the logistic model on at most ``train_rows`` labelled rows, taken
    in order of a hash of their id. Labels other than 0 and 1 and ids without a document are not
    used; with labels of one kind only, or none, the weights are zero."""
    wanted = (
        labels.where(F.col("quality").isin(0, 1)).select(
            F.col("doc_id").alias("_label_id"), F.col("quality").cast("double").alias("label")
        )
        .orderBy(F.xxhash64("_label_id"), "_label_id", "label").limit(train_rows)
    )
    known = (
        for_tasks(documents).select("doc_id", "text")
        .join(F.broadcast(wanted), F.col("doc_id") == F.col("_label_id"))  # train_rows rows at most
        .select("label", _features("text").alias("raw"))
        .select("label", array_to_vector("raw").alias("raw"))
    )
    known = written(known, "quality-train")
    kinds = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return [0.0] * len(FEATURES), 4.0 * (2 * next(iter(kinds), 1.0) - 1)
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(known)
    model = LogisticRegression(featuresCol="x", maxIter=200, regParam=1e-3).fit(scaler.transform(known))
    spread = [s if s > 0 else 1.0 for s in scaler.std]
    weights = [float(w / s) for w, s in zip(model.coefficients, spread)]
    shift = sum(w * float(m) for w, m in zip(weights, scaler.mean))
    return weights, float(model.intercept) - shift


def _logit(p: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(inside / (1 - inside))


def _strength(groups: DataFrame, mean: str, prior: Column) -> float:
    """How many documents' worth the prior counts: from the spread of group means beyond chance
    (method of moments). One aggregate over the groups."""
    far = F.col("n") * F.pow(F.col(mean) - prior, 2)
    row = groups.agg(
        F.sum(far).alias("far"), F.sum("n").alias("n"), F.count("*").alias("groups"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("chance"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 1e6
    chance = row["chance"] / row["n"]
    spread = row["far"] / row["n"] - chance * row["groups"] / row["n"]
    return 1e6 if spread <= 0 or chance <= 0 else min(1e6, max(1.0, chance / spread - 1))


def score(
    documents: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    threshold: float = THRESHOLD,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """All rows and columns of ``documents``, with evidence (the model's chance of good quality),
    host_posterior, path_posterior, score and keep (score >= threshold).

    Columns of these names in the input are replaced. A text that is null or has no words is no
    evidence: it counts at the model's prior in no site, and its sites alone decide. A null host
    or path is a site of its own. Repeated rows are scored alike. An empty table gives no rows.
    """
    weights, intercept = fit(documents, labels, train_rows)
    names = ("evidence", "host_posterior", "path_posterior", "score", "keep")
    kept = [c for c in documents.columns if c not in names]
    odds = F.lit(intercept) + F.aggregate(
        F.zip_with("_lw_x", F.array(*map(F.lit, weights)), lambda x, w: x * w),
        F.lit(0.0), lambda total, part: total + part,
    )
    silent = F.col("_lw_x")[0] == 0
    base = (
        for_tasks(documents).select(*kept, _features("text").alias("_lw_x"))
        .withColumn("_lw_p", F.when(~silent, 1 / (1 + F.exp(-odds))))
        .drop("_lw_x")
        .withColumn("_lw_host", F.col(host).cast("string"))
        .withColumn("_lw_path", F.col(path).cast("string"))
    )
    paths = written(
        base.groupBy("_lw_host", "_lw_path").agg(
            F.count("_lw_p").alias("n"), F.coalesce(F.sum("_lw_p"), F.lit(0.0)).alias("s")
        ),
        "quality-sites",
    )
    hosts = paths.groupBy("_lw_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = total[1] / total[0] if total[0] else 0.5
    at_host = _strength(
        hosts.where("n > 0").withColumn("m", F.col("s") / F.col("n")), "m", F.lit(mean)
    )
    sites = paths.select("_lw_host", "_lw_path", F.col("n").alias("pn"), F.col("s").alias("ps")).join(
        hosts.select(F.col("_lw_host").alias("_h"), F.col("n").alias("hn"), F.col("s").alias("hs")),
        F.col("_lw_host").eqNullSafe(F.col("_h")),
    ).drop("_h")
    prior = (at_host * F.lit(mean) + F.col("hs")) / (at_host + F.col("hn"))
    at_path = _strength(
        sites.where("pn > 0").withColumn("m", F.col("ps") / F.col("pn")).withColumn("prior", prior)
        .withColumnRenamed("pn", "n"),
        "m", F.col("prior"),
    )
    sites = sites.select(
        F.col("_lw_host").alias("_lw_site"), F.col("_lw_path").alias("_lw_section"),
        *[F.col(c).alias(f"_lw_{c}") for c in ("pn", "ps", "hn", "hs")],
    )
    own, one = F.coalesce("_lw_p", F.lit(0.0)), F.when(F.col("_lw_p").isNull(), 0).otherwise(1)
    # One row per site; Spark broadcasts it if its measured size allows, else splits hot sites.
    joined = base.join(
        sites,
        F.col("_lw_host").eqNullSafe(F.col("_lw_site"))
        & F.col("_lw_path").eqNullSafe(F.col("_lw_section")),
    )
    by_host = (at_host * F.lit(mean) + F.col("_lw_hs") - own) / (at_host + F.col("_lw_hn") - one)
    by_path = (at_path * F.col("host_posterior") + F.col("_lw_ps") - own) / (
        at_path + F.col("_lw_pn") - one
    )
    evidence = F.coalesce("_lw_p", F.lit(mean))
    final = _logit(evidence) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    return (
        joined.withColumn("evidence", evidence)
        .withColumn("host_posterior", by_host)
        .withColumn("path_posterior", by_path)
        .withColumn("score", 1 / (1 + F.exp(-final)))
        .withColumn("keep", F.col("score") >= threshold)
        .select(*kept, *names)
    )


def accepted(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are kept, with the columns of ``documents`` as they came."""
    names = documents.columns
    plain = documents.toDF(*[f"_in_{i}" for i in range(len(names))])
    at = {name: f"_in_{i}" for i, name in enumerate(names)}
    held = plain.select("*", *[plain[at[c]].alias(c) for c in ("doc_id", "text", "source", "lang")])
    return score(held, labels, **options).where("keep").select(
        *[held_name for held_name in at.values()]
    ).toDF(*names)
