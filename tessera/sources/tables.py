"""Delimited sources, ground truth readers, and path resolution."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A delimited file with a header, all columns text: tabs for .tsv, else commas; .parquet as it is. Fields beyond the
    header are dropped, missing ones null. rows: only the first rows, by the order of files, of places in them, and of lines."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').csv(path)
    if rows is None:
        return df
    names = df.columns
    order = ["_metadata.file_path", "_metadata.file_block_start", "__row"]
    return df.select("*", F.monotonically_increasing_id().alias("__row"), F.col("_metadata")).orderBy(*order).limit(rows).select(*[F.col(f"`{c}`") for c in names])


def find(stem: str, folder: str = "", roots: tuple[str, ...] = ("data", "dataset")) -> str:
    """The first of stem.tsv and stem.csv below the roots, in the folder or beside it; else the default place."""
    for root in roots:
        for place in [Path(root, folder), Path(root)] if folder else [Path(root)]:
            for end in (".tsv", ".csv"):
                if (p := place / f"{stem}{end}").exists():
                    return str(p)
    return str(Path(roots[0], folder, f"{stem}.csv"))


def truth_set(df: DataFrame) -> DataFrame:
    """(s1_id, true_ids) by position: a comma list; null, blank, [] and None are empty; ids are distinct."""
    id_, value = (F.col(f"`{c}`").cast("string") for c in df.columns[:2])
    v = F.trim(F.coalesce(value, F.lit("")))
    ids = F.array_distinct(F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != ""))
    empty = F.array().cast("array<string>")
    return df.select(id_.alias("s1_id"), F.when(v.isin("", "[]", "None"), empty).otherwise(ids).alias("true_ids"))


def truth_list(df: DataFrame) -> DataFrame:
    """(s1_id, true_ids) by name: a list in brackets or not, of quoted or bare ids between commas or semicolons; order
    and repeated ids are kept."""
    id_ = next((c for c in ("source1_entity_id", "id") if c in df.columns), df.columns[0])
    value = "matched_entity_ids" if "matched_entity_ids" in df.columns else next(c for c in df.columns if c != id_)
    v = F.btrim(F.coalesce(F.col(f"`{value}`").cast("string"), F.lit("")), F.lit("[]'\" "))
    ids = F.transform(F.split(F.translate(v, ";", ","), ","), lambda x: F.btrim(x, F.lit("'\" ")))
    return df.select(F.col(f"`{id_}`").cast("string").alias("s1_id"), F.filter(ids, lambda x: x != "").alias("true_ids"))
