"""Line dedup by distinct-site spread.

Every line (between line feeds, trimmed of blanks; blank ones don't count) is known by two 64-bit hashes. HyperLogLog
sketches of the sites that show a line merge by aggregation. Lines whose estimate lies within the sketch's error of
the threshold get an exact distinct count; those clearly above are boilerplate, those clearly below are not. All
occurrences of boilerplate lines go from every document. A line that one text alone has, letter by letter, is no
boilerplate however many sites show that text: the document is copied and not the line, which near-duplicate operators
decide on.

Which lines of a text go is a table by the text's hashes. Spark sends it to all executors where it is below the session's
threshold for broadcasts; else texts are joined with it by a shuffle whose hot texts adaptive execution splits. Rows
without a text never move.

Results: a row per document with its other columns, and its text without the boilerplate. Null and empty texts stay
as they are; a null site counts as no site; repeated rows are treated alike; empty tables give none; every column of
the input is kept, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

#: Distinct sites that make a line boilerplate; log2 of a sketch's registers, whose error is 1.04 / sqrt(registers).
SITES, REGISTERS = 10, 12
BLANK = " \t\r\x0b\x0c"


def spread_lines(docs: DataFrame, scratch: Scratch, sites: int, registers: int = REGISTERS) -> DataFrame:
    """(h1, h2) of the lines that at least `sites` distinct sites show."""
    error = 4 * 1.04 / 2 ** (registers / 2)
    low, high = int(sites * (1 - error)), int(sites * (1 + error)) + 1
    seen = _lines(docs).where("site is not null")
    sketches = seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", registers).alias("sketch"), F.count("*").alias("n"), F.min("k1").alias("k"), F.max("k1").alias("other"))
    sketches = sketches.where((F.col("n") >= sites) & (F.col("k") != F.col("other")))
    estimates = scratch.keep(sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low), "estimates")
    near = estimates.where(F.col("sites") < high).select("h1", "h2")
    pairs = seen.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites)
    return estimates.where(F.col("sites") >= high).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """(key, site, h1, h2, n) of every line that isn't blank; key stands for the text."""
    lines = docs.where("text is not null").select("k1", "k2", "site", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("k1", "k2", "site", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    return lines.select("k1", "k2", "site", *_hashes(F.col("line")))


def dedup_lines(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """The documents (text, site, ...) without boilerplate lines; text keeps its place among the columns."""
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    keyed = docs.select(text.alias("text"), F.col(f"`{site}`").cast("string").alias("site")).select("text", "site", *keys)
    spread = scratch.keep(spread_lines(keyed, scratch, sites), "spread")
    # which lines go is a matter of the text alone, so that copies share one list
    gone = _lines(keyed).join(spread, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    gone = scratch.keep(gone, "gone")
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"))
    found = rows.where("text is not null").select("row", "text", *keys).join(gone, ["k1", "k2"], "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.struct(*_hashes(_trimmed(x)))))
    found = found.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    out = found.unionByName(rows.where("text is null"))
    return out.select(*[(F.col("text") if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "text")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, source, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM d),
t AS (SELECT r, source, i, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
s AS (SELECT line, count(DISTINCT t.source) AS sites, count(DISTINCT text) AS texts FROM t JOIN d USING (r) WHERE line <> '' AND t.source IS NOT NULL GROUP BY line),
b AS (SELECT line FROM s WHERE sites >= {SITES} AND texts > 1),
k AS (SELECT r, string_agg(raw, chr(10) ORDER BY i) AS kept FROM t WHERE line NOT IN (SELECT line FROM b) GROUP BY r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text FROM d LEFT JOIN k USING (r)
"""
