from collections import defaultdict

import duckdb

from tessera.llm import op3_lines as op

SCHEMA = "doc_id long, text string, source string"


def brute(rows, sites):
    seen, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(op.BLANK) and s is not None:
                seen[x.strip(op.BLANK)].add(s)
                texts[x.strip(op.BLANK)].add(t)
    gone = {x for x in seen if len(seen[x]) >= sites and len(texts[x]) > 1}
    return sorted([(d, t if t is None else "\n".join(x for x in t.split("\n") if x.strip(op.BLANK) not in gone)) for d, t, _ in rows], key=str)


def run(spark, rows, sites):
    return sorted([(r.doc_id, r.text) for r in op.dedup_lines(spark.createDataFrame(rows, SCHEMA), sites).collect()], key=str)


def test_cases(spark):
    body = "a long line of its own, number {} of this site, with some more words behind"
    rows = [(i, f"Menu | Home\n{body.format(i)}\n\n Menu | Home \t\nend {i}", f"s{i % 4}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n\n", "s3"), (None, "Menu | Home\n" + body.format(7), None), (103, "Menu | Home", "s9"), (104, "x\n" * 30000 + "Menu | Home", "s1"), (5, "again", "s1"), (5, "again", "s1")]
    for sites in (3, 4, 5, 6):
        assert run(spark, rows, sites) == brute(rows, sites)


def test_many_sites(spark):
    """Spread beyond a sketch's exact range, on both sides of the threshold."""
    rows = [(i, f"shared by most\n{'shared by some' if i % 2 else 'other'}\nown line {i} which is long enough to keep the document whole", f"s{i}") for i in range(3000)]
    for sites in (1500, 1501, 2900, 3000, 3001):
        assert run(spark, rows, sites) == brute(rows, sites)


def test_empty_and_extra_columns(spark):
    assert run(spark, [], 3) == []
    names = "n int, h1 string, k1 long, k2 string, gone string, row string, site string, __k1 string, line string"
    rows = [(i, f"Menu\nown {i}", f"s{i}", 5, "z", 7, "a", "b", "c", "d", "e", "f") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", " + names)
    out = op.dedup_lines(df, 3)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(i, f"own {i}", *r[2:]) for i, r in enumerate(rows)]


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted([(r.doc_id, r.text) for r in op.op3_line_dedup(spark, d).collect()], key=str)
    assert got == brute(rows, op.SITES) and got != sorted([(d, t) for d, t, _ in rows], key=str)


def test_lines_go_from_every_document_but_whole_copies_are_left(spark):
    menu, passage = "Menu | Home | Contact", "a passage of many words " * 20 + "that all sites show"
    rows = [(i, f"{menu}\n{passage}\nown {i}", f"s{i}") for i in range(12)] + [(50, menu, "s1"), (51, f"{menu}\nshort", "s2")]
    rows += [(60 + i, f"copied line one\ncopied line two\n{menu}", f"t{i}") for i in range(10)]
    rows += [(80 + i, None, f"t{i}") for i in range(10)]
    want = [(i, f"own {i}") for i in range(12)] + [(50, ""), (51, "short")] + [(60 + i, "copied line one\ncopied line two") for i in range(10)] + [(80 + i, None) for i in range(10)]
    assert run(spark, rows, 10) == sorted(want, key=str) == brute(rows, 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run(spark, rows, 10) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_oracle(spark):
    d = "/root/testdata/sf0.1"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = sorted([(r.doc_id, r.text) for r in op.op3_line_dedup(spark, d).collect()], key=str)
    assert got == sorted(c.execute(op.ORACLE).fetchall(), key=str)
