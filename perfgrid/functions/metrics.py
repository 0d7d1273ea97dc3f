"""Error metrics as grouped aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-15


def confusion(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp/tn/fp/fn of every class that occurs among the true labels.

    One shuffle on (keys, label, prediction) after map-side counting; all later
    steps see at most classes x classes rows per key.
    """
    pairs = df.groupBy(*keys, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return confusion_of_counts(pairs, keys)


def confusion_of_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same from (keys, _y, _p, _n) counts."""
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_y").alias("class"), hit.alias("tp"), F.col("_n").alias("pos"), zero.alias("named")),
        F.struct(F.col("_p").alias("class"), zero.alias("tp"), zero.alias("pos"), F.col("_n").alias("named")),
    )
    per_class = (
        pairs.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.class").alias("class"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.pos").alias("pos"), F.sum("s.named").alias("named"))
        .filter("pos > 0")
    )
    total = F.sum("pos").over(Window.partitionBy(*[F.col(k) for k in keys])) if keys else F.sum("pos").over(Window.partitionBy(F.lit(0)))
    return (
        per_class.withColumn("total", total)
        .withColumn("fn", F.col("pos") - F.col("tp"))
        .withColumn("fp", F.col("named") - F.col("tp"))
        .withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
        .select(*keys, "class", "tp", "tn", "fp", "fn")
    )


def _ber_term() -> Column:
    recall = F.col("tp") / F.greatest((F.col("tp") + F.col("fn")).cast("double"), F.lit(EPSILON))
    fallout = F.col("tn") / F.greatest((F.col("tn") + F.col("fp")).cast("double"), F.lit(EPSILON))
    return F.lit(1.0) - F.lit(0.5) * recall - F.lit(0.5) * fallout


def ber(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction", out: str = "ber") -> DataFrame:
    """Balanced error rate per key: mean over the true classes."""
    return confusion(df, keys, label, prediction).groupBy(*keys).agg(F.avg(_ber_term()).alias(out))


def ber_of_counts(pairs: DataFrame, keys: list[str], out: str = "ber") -> DataFrame:
    return confusion_of_counts(pairs, keys).groupBy(*keys).agg(F.avg(_ber_term()).alias(out))


def class_error(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean over the true classes of (fp + fn) / total."""
    wrong = (F.col("fp") + F.col("fn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return confusion(df, keys, label, prediction).groupBy(*keys).agg(F.avg(wrong).alias("class_error"))


def mse(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    gap = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))
