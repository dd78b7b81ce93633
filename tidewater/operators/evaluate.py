"""Measures of predictions; tied scores are counted together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ordered import running_totals


def accuracy(rows: DataFrame, label: str, pred: str) -> DataFrame:
    return rows.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, label: str, pred: str, classes: list) -> DataFrame:
    """A row for each label with a count for each predicted class, pred_<class>."""
    return rows.groupBy(label).agg(*[F.count_if(F.col(pred) == F.lit(c)).alias(f"pred_{c}") for c in classes])


def average_precision(rows: DataFrame, cls: str, positive: str, score: str) -> DataFrame:
    """(class, ap, n_pos): precision summed over the steps of recall, from rows (class, positive 0/1, score).

    A class without a positive has null.
    """
    ties = rows.groupBy(cls, score).agg(F.sum(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    x = running_totals(ties, [cls], [F.desc(score)], {"_tp": "_p", "_all": "_n"})
    out = x.groupBy(cls).agg(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")).alias("_s"), F.sum("_p").alias("n_pos"))
    return out.select(cls, F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos")).alias("ap"), "n_pos")


def roc_auc(rows: DataFrame, cls: str, positive: str, score: str) -> DataFrame:
    """(class, auc, n_pos): the share of pairs of a positive and a negative that are in order, ties by half.

    Ranks come from counts of equal scores, so ties have the average rank. A class
    with positives or negatives only has null.
    """
    ties = rows.groupBy(cls, score).agg(F.sum(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    x = running_totals(ties, [cls], [F.asc(score)], {"_upto": "_n"})
    rank = F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
    out = x.groupBy(cls).agg(F.sum(F.col("_p") * rank).alias("_s"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("_all"))
    neg = F.col("_all") - F.col("n_pos")
    auc = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)) / (F.col("n_pos") * neg)
    return out.select(cls, F.when((F.col("n_pos") > 0) & (neg > 0), auc).alias("auc"), "n_pos")


def macro(per_class: DataFrame, value: str) -> DataFrame:
    return per_class.agg(F.avg(value).alias(f"macro_{value}"))


def weighted(per_class: DataFrame, value: str, weight: str = "n_pos") -> DataFrame:
    known = F.col(value).isNotNull()
    return per_class.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(known, F.col(weight)))).alias(f"weighted_{value}"))


def one_vs_rest(rows: DataFrame, label: str, scores: str) -> DataFrame:
    """(class, positive, score) rows from an array with a score for each class 0, 1, ..."""
    return rows.select(F.col(label).alias("_l"), F.posexplode(scores).alias("cls", "score")).select("cls", (F.col("_l") == F.col("cls")).cast("int").alias("positive"), "score")


def mean_pooled(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, pooled): the mean over time of a recording's hidden states."""
    e = rows.select(group, F.posexplode(F.col(vec).cast("array<double>")).alias("_i", "_x")).groupBy(group, "_i").agg(F.avg("_x").alias("_x"))
    return e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s._x).alias("pooled"))
