"""Intermediate tables in the folder that driver and executors share; Spark writes them, plans and Python workers read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


class Shared:
    """Tables below a folder of their own in spark.checkpoint.dir. They stay until that is cleared, as results are lazy."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.gettempdir() + "/tessera-scratch"
        self.spark, self.base = spark, f"{base}/tessera-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """A table's files, in the same order for whoever asks."""
    if "://" not in path and not path.startswith("file:"):
        system, at = fs.LocalFileSystem(), path
    else:
        scheme, _, rest = path.partition(":")
        system, at = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{'//' + rest if scheme == 'file' and not rest.startswith('//') else rest}")
    found = system.get_file_info(fs.FileSelector(at))
    return system, sorted(x.path for x in found if x.is_file and x.base_name.endswith(".parquet") and not x.base_name.startswith(("_", ".")))


def chunks(path: str, rows: int, columns: list[str]) -> Iterator[pa.Table]:
    """A table in pieces of `rows` rows, the last of what is left; the same pieces whatever the columns."""
    system, names = files(path)
    kept, n = [], 0
    for name in names:
        with system.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=min(rows, 16_384), columns=columns):
                while batch.num_rows:
                    part = batch.slice(0, rows - n)
                    kept.append(part)
                    n += part.num_rows
                    batch = batch.slice(part.num_rows)
                    if n == rows:
                        yield pa.Table.from_batches(kept).combine_chunks()
                        kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()
