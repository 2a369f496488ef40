"""Incremental linkage: anchor records as a stream against fixed satellites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking, decide, entities, features, scoring


def prepare(satellites: DataFrame) -> DataFrame:
    """The satellites' keys, computed once and kept."""
    return entities.enrich(satellites).persist()


def link_batch(anchors: DataFrame, prepared: DataFrame, cutoff: float, margin: float = decide.MARGIN, top: int = decide.TOP, taken: DataFrame | None = None) -> DataFrame:
    """Matches of one batch of anchors with prepared satellites, without those already taken (source, cand_id)."""
    e = entities.enrich(anchors.withColumn("source", F.lit("source1"))).unionByName(prepared)
    pairs = blocking.candidates(e)
    if taken is not None:
        pairs = pairs.join(taken.select("source", "cand_id").distinct(), ["source", "cand_id"], "left_anti")
    f = features.with_native(features.attach(pairs, e)).withColumn("score", scoring.rule_score())
    f = f.withColumn("score", scoring.exact_root_floor(F.col("score"))).withColumn("score", scoring.adjacent_door_cap(F.col("score")))
    return decide.select(scoring.joint_support(f.select("s1_id", "source", "cand_id", "score")), cutoff, margin, top)


def link_stream(anchors: DataFrame, satellites: DataFrame, path: str, checkpoint: str, cutoff: float = decide.CUTOFF) -> StreamingQuery:
    """Each micro-batch's matches go to a folder of its own number below the path, which a repeated batch overwrites. A
    satellite that an earlier batch has matched stays with its anchor."""
    prepared = prepare(satellites)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        schema = "s1_id string, source string, cand_id string, score double, batch long"
        taken = spark.read.schema(schema).parquet(path).where(F.col("batch") < number) if known else None
        link_batch(batch, prepared, cutoff, taken=taken).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return anchors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
