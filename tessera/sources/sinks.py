"""Result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str) -> None:
    """Tab-separated with a header and no quoting, as many part files as partitions."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def list_literal(ids: Column) -> Column:
    """['a', 'b'], or [] for none."""
    return F.when(F.size(ids) > 0, F.concat(F.lit("['"), F.array_join(ids, "', '"), F.lit("']"))).otherwise(F.lit("[]"))


def submission(predicted: DataFrame) -> DataFrame:
    """(id, matched_ids) of (s1_id, pred_ids)."""
    return predicted.select(F.col("s1_id").alias("id"), list_literal(F.col("pred_ids")).alias("matched_ids"))


def write_submission(predicted: DataFrame, path: str) -> None:
    submission(predicted).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)
