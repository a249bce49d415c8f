"""Boosted trees as plain expressions.

A fitted ensemble is read back as its table of nodes, which is as small as the model, and every
tree becomes nested CASE expressions over the raw columns. Spark compiles the sum as code of its
own; any other engine computes the same score from the same text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.operators.linear import filled, literal
from loanweave.storage import fresh_path


@dataclass(frozen=True)
class Node:
    """A split (rows with a value up to ``threshold`` go left) or, without a feature, a leaf."""

    value: float
    feature: int | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble: per tree its weight and nodes (the root first)."""

    features: tuple[str, ...]
    fills: tuple[float, ...]
    trees: tuple[tuple[float, tuple[Node, ...]], ...]
    classifier: bool

    def _tree(self, nodes: Sequence[Node], at: int, values: Sequence[str]) -> str:
        node = nodes[at]
        if node.feature is None:
            return literal(node.value)
        left, right = (self._tree(nodes, i, values) for i in (node.left, node.right))
        return f"CASE WHEN {values[node.feature]} <= {literal(node.threshold)} THEN {left} ELSE {right} END"

    def terms(self, values: Sequence[str]) -> list[str]:
        """SQL of each tree's weighted share, over SQL of the filled features."""
        return [f"{literal(weight)} * ({self._tree(nodes, 0, values)})" for weight, nodes in self.trees]

    def values(self, columns: Sequence[str] | None = None) -> list[str]:
        """SQL of each feature; those that ``columns`` lacks are filled."""
        return [f"({filled(c, columns, fill)})" for c, fill in zip(self.features, self.fills)]

    def sql(self, columns: Sequence[str] | None = None) -> str:
        """SQL of the score: a probability or a value."""
        return self._link(_balanced(self.terms(self.values(columns))))

    def _link(self, margin: str) -> str:
        return f"1e0 / (1e0 + exp(-2e0 * ({margin})))" if self.classifier else margin

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the score; every feature is filled once, in a projection of its own."""
        inner = {f"__x{i}": F.expr(v) for i, v in enumerate(self.values(df.columns))}
        margin = _balanced(self.terms(list(inner)))
        return df.withColumns(inner).select(*df.columns, F.expr(self._link(margin)).alias(name))


def _balanced(terms: Sequence[str]) -> str:
    """A sum whose nesting grows with the logarithm of its terms."""
    if len(terms) <= 1:
        return terms[0] if terms else "0e0"
    half = len(terms) // 2
    return f"({_balanced(terms[:half])} + {_balanced(terms[half:])})"


def compiled(
    spark: SparkSession, model: PipelineModel, features: Sequence[str], fill: float | None = None
) -> Boosted:
    """The boosted model at the end of a pipeline; without ``fill`` the pipeline's imputer fills."""
    booster = model.stages[-1]
    path = fresh_path(spark, "boosted")
    booster.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    trees: dict[int, dict[int, Node]] = {}
    for row in nodes.collect():  # the nodes of a model, not of rows
        split = row["split"]
        if row["leftChild"] < 0:
            node = Node(row["prediction"])
        elif split["numCategories"] >= 0:
            raise ValueError("categorical splits are not supported")
        else:
            node = Node(
                row["prediction"], split["featureIndex"], split["leftCategoriesOrThreshold"][0],
                row["leftChild"], row["rightChild"],
            )
        trees.setdefault(row["treeID"], {})[row["id"]] = node
    if fill is None:
        row = model.stages[0].surrogateDF.first()
        fills = tuple(float(row[f"x_{c}"]) for c in features)
    else:
        fills = (float(fill),) * len(features)
    ordered = tuple(
        (float(weight), tuple(trees[i][j] for j in sorted(trees[i]))) for i, weight in enumerate(booster.treeWeights)
    )
    return Boosted(tuple(features), fills, ordered, hasattr(booster, "numClasses"))
