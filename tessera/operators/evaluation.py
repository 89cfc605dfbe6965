"""Batch evaluation of retrieval: hits, reciprocal ranks, gaps between layers, comparison of runs, a leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least difference of Hit@10 that decides between two runs.
MARGIN = 0.02


def case_scores(retrieved: DataFrame, relevant: DataFrame, case: str = "case_id", key: str = "doc_id", depths: Sequence[int] = (5, 10)) -> DataFrame:
    """(case, key, rank) and (case, key) -> per case hit@k and rr, the inverse of the first relevant rank or 0.

    Cases are those with a relevant key; cases without are not labelled and are left out. The lists are joined by their
    keys, so no list is gathered.
    """
    wanted = relevant.select(case, key).distinct()
    first = retrieved.join(wanted, [case, key]).groupBy(case).agg(F.min("rank").alias("first"))
    cases = wanted.select(case).distinct().join(first, case, "left")
    hits = [F.coalesce(F.col("first") <= d, F.lit(False)).alias(f"hit{d}") for d in depths]
    return cases.select(case, *hits, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def hit_at(ids: Column, relevant: Column, k: int) -> Column:
    """Whether one of the first k ids is relevant, where a case's lists are short arrays."""
    return F.coalesce(F.arrays_overlap(F.slice(ids, 1, k), relevant), F.lit(False))


def reciprocal_rank(ids: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(0.0)


def summary(scores: DataFrame, cases: DataFrame, case: str = "case_id", depths: Sequence[int] = (5, 10)) -> DataFrame:
    """One row: means over the labelled cases (0 if there is none), how many there are, how many were skipped."""
    all_cases = cases.agg(F.count_distinct(case).alias("all"))
    means = scores.agg(
        *[F.coalesce(F.avg(F.col(f"hit{d}").cast("double")), F.lit(0.0)).alias(f"hit{d}") for d in depths],
        F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.count("*").alias("evaluated"),
    )
    return means.join(F.broadcast(all_cases)).withColumn("skipped", F.col("all") - F.col("evaluated")).drop("all")  # one row each


def layer_gap(first: DataFrame, second: DataFrame, metrics: Sequence[str] = ("hit5", "hit10", "mrr")) -> DataFrame:
    """First less second for each metric, of two one-row summaries; null where one is missing."""
    b = second.select(F.lit(1).alias("__one"), *[F.col(m).alias(f"__{m}") for m in metrics])
    a = first.withColumn("__one", F.lit(1))
    return a.join(b, "__one", "full").select(*[(F.col(m) - F.col(f"__{m}")).alias(m) for m in metrics])


def compare(a: DataFrame, b: DataFrame, case: str = "case_id", by: str = "rr") -> DataFrame:
    """Two runs' case scores -> (case, a, b, outcome): improved, regressed or same, for the cases of both."""
    pair = a.select(case, F.col(by).cast("double").alias("a")).join(b.select(case, F.col(by).cast("double").alias("b")), case)
    return pair.withColumn("outcome", F.when(F.col("b") > F.col("a"), "improved").when(F.col("b") < F.col("a"), "regressed").otherwise("same"))


def outcomes(pairs: DataFrame) -> DataFrame:
    """One row: how many cases improved and regressed."""
    return pairs.agg(F.count_if(F.col("outcome") == "improved").alias("improved"), F.count_if(F.col("outcome") == "regressed").alias("regressed"), F.count("*").alias("cases"))


def decision(a: Column, b: Column) -> Column:
    """Which of two runs to take by Hit@10: the second needs a lead of ``MARGIN``, and so does the first."""
    return F.when(b - a >= MARGIN, "B").when(a - b >= MARGIN, "A").otherwise("tie")


def leaderboard(runs: DataFrame) -> DataFrame:
    """Runs (run_id, label, created_at, hit5, hit10, mrr) by age, with the change of each metric from the run before."""
    order = Window.orderBy("created_at", "run_id")  # one row per run: a handful
    return runs.select("*", *[(F.col(m) - F.lag(m).over(order)).alias(f"{m}_change") for m in ("hit5", "hit10", "mrr")]).orderBy("created_at", "run_id")


def leaderboard_markdown(runs: DataFrame, most: int = 1000) -> str:
    """The leaderboard's latest ``most`` runs as a Markdown table, newest first."""
    rows = leaderboard(runs).orderBy(F.desc("created_at"), F.desc("run_id")).limit(most).collect()
    head = ["| run | label | Hit@5 | Hit@10 | MRR | change of MRR |", "|---|---|---|---|---|---|"]
    change = lambda x: "" if x is None else f"{x:+.4f}"
    return "\n".join(head + [f"| {r.run_id} | {r.label} | {r.hit5:.4f} | {r.hit10:.4f} | {r.mrr:.4f} | {change(r.mrr_change)} |" for r in rows]) + "\n"


def report(runs: DataFrame) -> DataFrame:
    """Runs with two layers of metrics -> one line each by age: Hit@10 and MRR of both, the gap of Hit@10, the cases.

    Rows are (run_id, label, created_at, layer1, layer2), each layer a struct (hit_at_10, mrr, n_cases) or null.
    """
    gap = F.col("layer1.hit_at_10") - F.col("layer2.hit_at_10")
    return runs.select(
        "run_id", F.substring("created_at", 1, 19).alias("created_at"), "label", F.col("layer1.hit_at_10").alias("l1_hit10"), F.col("layer2.hit_at_10").alias("l2_hit10"), gap.alias("gap10"),
        F.col("layer1.mrr").alias("l1_mrr"), F.col("layer2.mrr").alias("l2_mrr"), F.coalesce("layer1.n_cases", "layer2.n_cases", F.lit(0)).alias("n_cases"),
    ).orderBy("created_at", "run_id")


def nearest_rank(column: str, p: float) -> Column:
    """The percentile by nearest rank, without interpolation; 0 for no rows."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0))
