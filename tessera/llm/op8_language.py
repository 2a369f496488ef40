"""Language identification by Bayesian evidence fusion.

For every document and page the evidence is: the likelihood of its text under byte-trigram models of each language
(counted over all documents with a language whose crc32(doc_id as text) mod 5 is not 0), the language its markup
declares, the suffix of its address, and a prior for its host. Text evidence is tempered: neighbouring trigrams
overlap, and TRUSTED of them say all that a longer text can say. How far declarations and suffixes can be trusted is
measured: their likelihoods are smoothed shares of the text posteriors that go with them. The host's prior is the
smoothed share of its other rows' posteriors, shrunk towards its registered domain's, which is shrunk towards the
corpus's; all three come from grouped sums. A page's text is its main text (see op2), a document's host is its source.

Every language that a document bears is told apart; the model takes 128 KB for each. What hosts, declarations and
suffixes say is sent to all executors below SENT_BYTES, else joined by a shuffle, which rows without such a key don't
take part in.

Results: a row per document (doc_id) and per page (page_id): lang, confidence, text_lang (by text alone; null without
text), declared, host, held_out. Missing evidence of any kind counts as none: null, empty and foreign texts get what
the rest says, in the end the corpus's commonest language. Without any labelled document lang is null. Ties go to the
first language in order; repeated rows are treated alike; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fold, mix, steps, table
from tessera.llm.html import parse
from tessera.llm.op2_wrappers import blocks, host_of

CODES, TRUSTED = 1 << 14, 200
#: Languages of which a worker holds counts; bytes of facts that are sent to all executors at most.
HELD, SENT_BYTES = 64, 16 << 20
#: Pseudo-counts of the parent in a child's prior, and of the whole in a likelihood.
SHRINK, SMOOTH = 5.0, 10.0


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts' byte trigrams (A-Z lower-cased), and where each text's begin (one more at the end)."""
    texts = pa.concat_arrays([pc.ascii_lower(pc.fill_null(texts, ""))])
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint32)
    at = at - at[0]
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    size = np.maximum(np.diff(at) - 2, 0)
    own = np.ones(len(raw), bool)  # a trigram belongs to the text that holds all of it
    ends = at[1:][np.diff(at) > 0]
    own[ends - 1] = False
    own[np.maximum(ends - 2, 0)] = False
    short = np.flatnonzero(np.diff(at) == 1)
    if len(short):  # the byte before a one-byte text is another text's and was marked in vain
        before = at[short] - 1
        owner = np.searchsorted(at, before, side="right") - 1
        fine = (before >= 0) & (at[np.minimum(owner + 1, len(at) - 1)] - before >= 3)
        own[before[fine]] = True
    return code[own[:-2]], np.concatenate([[0], np.cumsum(size)])


def _count(batches):
    """Trigrams of each language."""

    def counted():
        for lang, n in held.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "code", "n"])

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in steps(batch):
            code, at = trigrams(part.column("text"))
            langs = part.column("lang").dictionary_encode()
            of = np.repeat(np.asarray(langs.indices), np.diff(at))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in held and len(held) >= HELD:
                    yield from counted()
                    held.clear()
                n = held.setdefault(lang, np.zeros(CODES, np.int64))
                n += np.bincount(code[of == i], minlength=CODES)
    yield from counted()


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigrams (language x code)."""
    known = docs.where("lang is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    counts = np.zeros((len(languages), CODES))
    if languages:
        index = {x: i for i, x in enumerate(languages)}
        sums = known.select("text", "lang").mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
        names = sums.column("lang").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        rows = np.array([index[x] for x in names.dictionary.to_pylist()], np.int64)
        if len(rows):
            counts[rows[np.asarray(names.indices)], sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    whole = counts.sum(axis=0) + 1
    counts += 100 * whole / whole.sum()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def log_likelihoods(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood of each text under each language; nan without a trigram."""
    code, at = trigrams(texts)
    n = np.diff(at)
    out = np.full((len(n), len(model)), np.nan)
    full = np.flatnonzero(n > 0)
    if len(full):
        weight = np.minimum(n[full], 3 * TRUSTED) / n[full] / 3
        for j, logs in enumerate(model):
            out[full, j] = np.add.reduceat(logs[code], at[:-1][full]) * weight
    return out


EVIDENCE = "doc_id long, page_id long, held_out boolean, host string, domain string, suffix string, declared string, ll array<double>"


def _evidence(model):
    """Evidence of documents (text) or pages (html)."""

    def run(batches):
        logs = model.value
        for batch in batches:
            pages = "html" in batch.schema.names
            for part in steps(batch, "html" if pages else "text"):
                n = part.num_rows
                if pages:
                    texts, declared = [], []
                    for html in part.column("html").to_pylist():
                        root = parse(html or "")
                        top = next((x for x in root.children if x.tag == "html"), root)
                        mark = (top.attrs.get("lang") or top.attrs.get("xml:lang") or "").replace("_", "-").split("-")[0].strip().lower()
                        declared.append(mark or None)
                        texts.append("\n".join(blocks(root)))
                    texts, declared = pa.array(texts, pa.string()), pa.array(declared, pa.string())
                else:
                    texts, declared = part.column("text"), pa.nulls(n, pa.string())
                ll = log_likelihoods(texts, logs)
                rows = [None if np.isnan(x).any() else (x - x.max()).tolist() for x in ll] if ll.shape[1] else [None] * n
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "page_id", "held_out", "host", "domain", "suffix")), declared, pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "page_id", "held_out", "host", "domain", "suffix", "declared", "ll"])

    return run


def _fixed(values: list, kind: str) -> Column:
    """An array constant of any length."""
    return F.from_json(F.lit(json.dumps(values)), F.lit(f"array<{kind}>"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of the text posteriors t by key."""
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("t"))).alias("s"))


def _look_up(rows: DataFrame, facts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """rows with the facts of their keys, null where there are none."""
    if facts.count() * (width + 8) * 8 <= SENT_BYTES:
        return rows.join(F.broadcast(facts), keys, "left")
    has = F.col(keys[0]).isNotNull()
    found = rows.where(has).join(facts.hint("merge"), keys, "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in facts.schema if f.name not in keys}
    return found.unionByName(rows.where(~has).withColumns(none))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of documents (doc_id, text, lang, source) and pages (page_id, url, html)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    null = F.lit(None)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    languages, logs = text_model(docs.where(~held))
    model, n = spark.sparkContext.broadcast(logs), len(languages)
    of_docs = docs.select("doc_id", null.cast("long").alias("page_id"), held.alias("held_out"), F.col("source").alias("host"), null.cast("string").alias("domain"), null.cast("string").alias("suffix"), "text")
    host = host_of(F.col("url").cast("string"))
    labels = F.split("host", "[.]")
    of_pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    name = F.when(F.col("host") != "", F.col("host"))
    of_pages = of_pages.select(null.cast("long").alias("doc_id"), "page_id", F.lit(False).alias("held_out"), name.alias("host"), F.when(name.isNotNull(), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("domain"), F.when(name.isNotNull(), F.element_at(labels, -1)).alias("suffix"), "html")
    rows = of_docs.mapInArrow(_evidence(model), EVIDENCE).unionByName(of_pages.mapInArrow(_evidence(model), EVIDENCE))
    rows = scratch.keep(rows, "evidence")
    blank = ["doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "held_out"]
    if not languages:
        return rows.select(*blank)

    # posteriors by text alone, which sum to 1, or to 0 without text
    zeros = _fixed([0.0] * n, "double")
    e = F.transform("ll", F.exp)
    rows = rows.withColumn("t", F.coalesce(F.transform(e, lambda x: x / _total(e)), zeros))
    whole = np.array(_sums(rows).first().s) if rows.head(1) else np.zeros(n)
    prior = ((whole + 1) / (whole.sum() + n)).tolist()
    p0 = _fixed(prior, "double")

    def likelihood(key: str) -> DataFrame:
        """log P(key | language) by key, relative to log P(key)."""
        every = _total(F.col("s"))
        logs = F.zip_with("s", p0, lambda s, p: F.log((s + SMOOTH * p) / (p * (every + SMOOTH))))
        return scratch.keep(_sums(rows.where(F.col(key).isNotNull()), key).select(key, logs.alias(f"{key}_log")), f"by-{key}")

    domains = _sums(rows.where("domain is not null"), "domain").withColumnRenamed("s", "d")
    hosts = _sums(rows.where("host is not null"), "host", "domain").withColumnRenamed("s", "h")
    from_domain = F.zip_with(F.coalesce("d", zeros), p0, lambda d, p: (d + SHRINK * p) / (_total(F.coalesce("d", zeros)) + SHRINK))
    facts = scratch.keep(_look_up(hosts, domains, ["domain"], n).select("host", F.coalesce("domain", F.lit("")).alias("of"), "h", from_domain.alias("p")), "hosts")
    rows = rows.withColumn("of", F.coalesce("domain", F.lit("")))
    rows = _look_up(rows, facts, ["host", "of"], 2 * n)
    for key in ("declared", "suffix"):
        rows = _look_up(rows, likelihood(key), [key], n)

    others = F.zip_with(F.coalesce("h", zeros), "t", lambda h, t: F.greatest(h - t, F.lit(0.0)))
    rows = rows.withColumns({"others": others, "p": F.coalesce("p", p0)}).withColumn("seen", _total(F.col("others")))
    parts = [F.coalesce(c, zeros) for c in ("ll", "declared_log", "suffix_log")]
    score = F.zip_with("others", "p", lambda o, p: F.log((o + SHRINK * p) / (F.col("seen") + SHRINK)))
    for part in parts:
        score = F.zip_with(score, part, lambda a, b: a + b)
    scored = rows.withColumn("score", score).withColumn("top", F.array_max("score"))
    names = _fixed(languages, "string")
    best = lambda x: F.get(names, (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    confidence = 1 / _total(F.transform("score", lambda x: F.exp(x - F.col("top"))))
    return scored.select("doc_id", "page_id", best(F.col("score")).alias("lang"), confidence.alias("confidence"), best(F.col("ll")).alias("text_lang"), "declared", "host", "held_out")


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
