"""Which rows of a batch are worth a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, hash_bits
from tidemark.operators.ordering import join_small, position_in_group

STRATEGIES = ("uncertainty", "margin", "random")


def confidence(probabilities: str | Column) -> Column:
    return F.array_max(col(probabilities))


def margin(probabilities: str | Column) -> Column:
    """Gap between the two likeliest classes; 0 for a single class, so that order decides."""
    ranked = F.sort_array(col(probabilities), asc=False)
    return F.when(F.size(ranked) < 2, F.lit(0.0)).otherwise(F.get(ranked, 0) - F.get(ranked, 1))


def score(strategy: str, probabilities: str, ids: list[str], seed: int = 42) -> Column:
    """Rows with the smallest score are asked for first."""
    if strategy == "uncertainty":
        return confidence(probabilities)
    if strategy == "margin":
        return margin(probabilities)
    if strategy == "random":
        return hash_bits(seed, *ids).cast("double")
    raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")


def select_for_labels(
    df: DataFrame, strategy: str, batch: str, ids: list[str], probabilities: str = "probabilities", budget: float = 0.1,
    seed: int = 42, **kw
) -> DataFrame:
    """The ``max(1, int(rows x budget))`` rows of every batch with the smallest score.

    Ranks run over (batch, score, id) across partitions, so a batch of any size is fine.
    """
    scored = df.withColumn("score", F.round(score(strategy, probabilities, ids, seed), 12))
    ranked = position_in_group(scored, [batch], ["score", *ids], "rank", **kw)
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(budget))))
    return join_small(ranked, sizes, [batch]).filter(F.col("rank") < wanted).drop("_n").withColumn("strategy", F.lit(strategy))


def labelled_pool(selections: list[DataFrame]) -> DataFrame:
    """All selected rows of all batches."""
    pool = selections[0]
    for more in selections[1:]:
        pool = pool.unionByName(more)
    return pool


def label_efficiency(pool: DataFrame, df: DataFrame, budget: float = 0.1) -> DataFrame:
    """Labelled rows per strategy against all rows seen."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return pool.groupBy("strategy").agg(F.count(F.lit(1)).alias("total_labelled")).select(
        "strategy", F.lit(budget).alias("budget_pct"), total.alias("total_samples"), "total_labelled",
        F.round(F.col("total_labelled") / total, 4).alias("label_efficiency"),
    )
