"""Classification metrics from a table of (label, prediction) counts, which is as large as the classes allow, not the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def per_class(c: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(label, tp, predicted, support, precision, recall, f1) from confusion counts; 0/0 is 0.

    Labels are those that occur, or the given table's `label`, absent ones included with zeros.
    """
    true = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    j = true.join(predicted, "label", "full_outer")
    if labels is not None:
        j = labels.select("label").join(j, "label", "left")
    j = j.na.fill(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return j.select(
        "label", "tp", "predicted", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def summary(c: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, F1 weighted by support."""
    k = per_class(c)
    return k.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def matthews(c: DataFrame) -> DataFrame:
    """One row: the correlation coefficient of Matthews for any number of classes, 0 where it isn't defined."""
    k = per_class(c).select(*[F.col(x).cast("double") for x in ("tp", "predicted", "support")])
    m = k.agg(F.sum("tp").alias("c"), F.sum("support").alias("s"), F.sum(F.col("predicted") * F.col("support")).alias("pt"),
              F.sum(F.col("predicted") ** 2).alias("pp"), F.sum(F.col("support") ** 2).alias("tt"))
    below = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return m.select(F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("pt"), below), F.lit(0.0)).alias("mcc"))
