"""Statistics of a vote table, computed on its distinct vote patterns.

All statistics depend on the votes only, so equal vote arrays are counted once
(one shuffle with map-side combine) and everything else runs on the patterns,
of which there are at most (classes + 1) ^ LFs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ABSTAIN = -1


def patterns(votes: DataFrame) -> DataFrame:
    """(votes, n)."""
    return votes.groupBy("votes").agg(F.count("*").alias("n"))


def lf_summary(pats: DataFrame, names: list[str]) -> DataFrame:
    """Per LF: polarity, coverage, overlaps, conflicts, n_votes.

    ``conflicts`` adds the disagreements with every other LF, so it can pass 1.
    """
    lf_names = F.array(*[F.lit(n) for n in names])
    voted = F.size(F.filter("votes", lambda v: v != ABSTAIN))
    long = pats.select("votes", "n", voted.alias("voted"), F.posexplode("votes").alias("lf_index", "vote"))
    disagree = F.size(F.filter("votes", lambda v: (v != ABSTAIN) & (v != F.col("vote"))))
    cast = F.col("vote") != ABSTAIN

    def total(value: Column) -> Column:
        return F.sum(F.when(cast, value).otherwise(0))

    whole = F.sum("n")
    return long.groupBy("lf_index").agg(
        F.array_sort(F.collect_set(F.when(cast, F.col("vote")))).alias("polarity"),
        F.round(total(F.col("n")) / whole, 4).alias("coverage"),
        F.round(total(F.when(F.col("voted") > 1, F.col("n")).otherwise(0)) / whole, 4).alias("overlaps"),
        F.round(total(F.col("n") * disagree) / whole, 4).alias("conflicts"),
        total(F.col("n")).alias("n_votes"),
    ).select(
        "lf_index", F.element_at(lf_names, F.col("lf_index") + 1).alias("name"),
        "polarity", "coverage", "overlaps", "conflicts", "n_votes",
    )


def majority(votes: Column | str, k: int) -> Column:
    """Most frequent class, smallest on a tie; -1 when all abstain."""
    votes = F.col(votes) if isinstance(votes, str) else votes
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.size(F.filter(votes, lambda v: v == c))
    )
    top = F.array_max(counts)
    return F.when(top > 0, F.array_position(counts, top).cast("int") - 1).otherwise(F.lit(ABSTAIN))


def majority_vote(votes: DataFrame, k: int) -> DataFrame:
    return votes.withColumn("label", majority("votes", k)).drop("votes")


def class_distribution(pats: DataFrame, class_names: list[str], label: Column | None = None) -> DataFrame:
    """Entities per class, ABSTAIN included, zero rows kept."""
    k = len(class_names)
    label = majority("votes", k) if label is None else label
    counted = pats.agg(
        *[F.coalesce(F.sum(F.when(label == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(-1, k)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("class_name"), F.col(f"c{i}").alias("entities"))
            for i, n in zip([*range(k), -1], [*class_names, "ABSTAIN"])
        ]
    )
    return counted.select(F.inline(rows))


def overall_stats(pats: DataFrame, names: list[str], k: int) -> DataFrame:
    """One row: samples, LFs, classes, total and mean LF coverage/overlaps/conflicts."""
    mean = lf_summary(pats, names).agg(
        F.round(F.avg("coverage"), 4).alias("mean_lf_coverage"),
        F.round(F.avg("overlaps"), 4).alias("mean_lf_overlaps"),
        F.round(F.avg("conflicts"), 4).alias("mean_lf_conflicts"),
        F.lit(1).alias("_one"),
    )
    covered = F.sum(F.when(majority("votes", k) != ABSTAIN, F.col("n")).otherwise(0))
    total = pats.agg(
        F.sum("n").alias("n_samples"), F.round(covered / F.sum("n"), 4).alias("total_coverage"), F.lit(1).alias("_one")
    )
    return total.join(mean, "_one").select(
        "n_samples", F.lit(len(names)).alias("n_lfs"), F.lit(k).alias("cardinality"), "total_coverage",
        "mean_lf_coverage", "mean_lf_overlaps", "mean_lf_conflicts",
    )


def one_hot(label: Column | str, k: int) -> Column:
    """probs of a hard label; all zeros when it abstains."""
    label = F.col(label) if isinstance(label, str) else label
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(label == c, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def lf_agreement(votes: DataFrame, labels: DataFrame, names: list[str], key: str = "mac_address") -> DataFrame:
    """Share of each LF's votes equal to a reference label (key, label).

    With the label model's hard predictions this is the estimated accuracy of
    the LFs; with checked labels it is their observed accuracy.
    """
    pats = votes.join(labels.select(key, "label"), key).groupBy("votes", "label").agg(F.count("*").alias("n"))
    lf_names = F.array(*[F.lit(n) for n in names])
    long = pats.select("label", "n", F.posexplode("votes").alias("lf_index", "vote")).where(F.col("vote") != ABSTAIN)
    right = F.sum(F.when(F.col("vote") == F.col("label"), F.col("n")).otherwise(0))
    return long.groupBy("lf_index").agg(
        F.sum("n").alias("n_votes"), right.alias("n_right"), F.round(right / F.sum("n"), 4).alias("accuracy"),
    ).select(
        "lf_index", F.element_at(lf_names, F.col("lf_index") + 1).alias("name"), "n_votes", "n_right", "accuracy"
    )
