import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import op8_language as op
from tessera.llm.html import parse
from tessera.llm.op2_wrappers import blocks

DOCS, PAGES = "doc_id long, text string, lang string, source string", "page_id long, url string, html string"
EN, FR = "the cat sat on the mat with that thing ", "le chat est dans la maison avec les autres "


def run(spark, docs, pages):
    out = op.identify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, PAGES)).collect()
    return {("d", r.doc_id) if r.page_id is None else ("p", r.page_id): r for r in out}, out


def test_trigrams():
    texts = ["abcd", None, "", "x", "ab", "xyz", "q", "éa"]
    code, at = op.trigrams(pa.array(texts))
    grams = [[(t or "").encode()[i : i + 3] for i in range(len((t or "").encode()) - 2)] for t in texts]
    assert np.diff(at).tolist() == [len(g) for g in grams]
    want = [(int.from_bytes(g, "big") * 2654435761 % 2**32) >> 18 for x in grams for g in x]
    assert code.tolist() == want


def test_log_likelihoods_against_sums():
    r = np.random.default_rng(0)
    model = np.log(r.dirichlet(np.ones(op.CODES), 3))
    texts = ["hello there", "", "ab", "w" * 5000]
    got = op.log_likelihoods(pa.array(texts), model)
    for t, row in zip(texts, got, strict=True):
        code, _ = op.trigrams(pa.array([t]))
        n = len(code)
        want = model[:, code].sum(axis=1) * (min(n, 3 * op.TRUSTED) / n / 3) if n else [np.nan] * 3
        assert np.allclose(row, want, equal_nan=True)


def test_cases(spark):
    docs = [(i, (EN if i % 2 else FR) * 5, "en" if i % 2 else "fr", f"s{i % 2}") for i in range(40)]
    docs += [(100, None, None, None), (101, "", "en", "s1"), (102, FR * 3000, None, "s0"), (None, EN, "en", "s1"), (103, None, None, "s0"), (3, EN * 5, "en", "s1")]
    page = "<html lang='{}'><body><article><p>{}</p></article></body></html>"
    pages = [(i, "http://fr.example.org/x", page.format("fr", FR * 3)) for i in range(12)] + [(20 + i, "http://en.example.com/x", page.format("en", EN * 3)) for i in range(12)]
    pages += [(50, "http://fr.example.org/y", "<html lang='en'><body></body></html>"), (51, "http://fr.example.org/z", None), (52, None, page.format("fr", "")), (53, "", ""), (54, "http://other.example.org/", ""), (None, "nonsense", FR)]
    got, out = run(spark, docs, pages)
    assert len(out) == len(docs) + len(pages)
    assert all(got["d", i].lang == ("en" if i % 2 else "fr") for i in range(40))
    assert got["d", 102].lang == "fr" and got["d", 103].lang == "fr" and got["d", 103].text_lang is None
    assert got["p", 51].lang == "fr" and got["p", 52].lang == "fr" and got["p", 54].lang == "fr"
    assert all(r.lang in ("en", "fr") and 0 < r.confidence <= 1 for r in out)


def brute(docs, pages):
    """Every row by plain sums: text likelihoods, then declarations, suffixes and host priors."""
    grams = lambda t: [(int.from_bytes(b[i : i + 3], "big") * 2654435761 % 2**32) >> 18 for b in [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()] for i in range(len(b) - 2)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    langs = sorted({x for i, _, x, _ in docs if x is not None and not held(i)})
    n = np.zeros((len(langs), op.CODES))
    for i, t, x, _ in docs:
        if x is not None and not held(i):
            np.add.at(n[langs.index(x)], grams(t), 1)
    whole = n.sum(axis=0) + 1
    n += 100 * whole / whole.sum()
    logs = np.log(n / n.sum(axis=1, keepdims=True))
    rows = [(("d", i), t, None, s, None, None) for i, t, _, s in docs]
    for i, u, h in pages:
        root = parse(h or "")
        mark = next((x.attrs.get("lang") for x in root.children if x.tag == "html"), None)
        m = re.match("[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", u or "")
        host = m[1].lower() if m else None
        rows.append((("p", i), "\n".join(blocks(root)), mark, host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None))
    lls, ts = [], []
    for _, t, *_ in rows:
        g = grams(t)
        ll = logs[:, g].sum(axis=1) * (min(len(g), 3 * op.TRUSTED) / len(g) / 3) if g else None
        lls.append(None if ll is None else ll - ll.max())
        ts.append(np.zeros(len(langs)) if ll is None else np.exp(lls[-1]) / np.exp(lls[-1]).sum())
    prior = (sum(ts) + 1) / (sum(x.sum() for x in ts) + len(langs))
    total = lambda k, value: sum((t for r, t in zip(rows, ts, strict=True) if r[k] == value), np.zeros(len(langs)))
    out = []
    for (key, _, mark, host, domain, suffix), ll, t in zip(rows, lls, ts, strict=True):
        score = np.zeros(len(langs)) if ll is None else ll.copy()
        for k, value in ((2, mark), (5, suffix)):
            if value is not None:
                s = total(k, value)
                score += np.log((s + op.SMOOTH * prior) / (prior * (s.sum() + op.SMOOTH)))
        d = total(4, domain) if domain else np.zeros(len(langs))
        p = (d + op.SHRINK * prior) / (d.sum() + op.SHRINK) if host else prior
        o = np.maximum(sum((x for r, x in zip(rows, ts, strict=True) if r[3] == host and r[4] == domain), np.zeros(len(langs))) - t, 0) if host else np.zeros(len(langs))
        score += np.log((o + op.SHRINK * p) / (o.sum() + op.SHRINK))
        out.append((key, langs[int(score.argmax())], 1 / np.exp(score - score.max()).sum(), None if ll is None else langs[int(ll.argmax())]))
    return out


@pytest.mark.parametrize("sent", [op.SENT_BYTES, -1])
def test_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(op, "SENT_BYTES", sent)
    r = np.random.default_rng(0)
    mixed = lambda: " ".join(r.choice((EN + FR).split(), 8))
    docs = [(i, (EN, FR)[i % 2] if i % 3 else mixed(), ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 5 else None) for i in range(60)] + [(100, None, "en", None), (101, "", None, "s1")]
    hosts = ["fr.example.org", "en.example.org", "a.example.com", "other.net"]
    pages = [(i, f"http://{hosts[i % 4]}/x" if i % 7 else "nonsense", f"<html lang='{('en', 'fr', 'xx')[i % 3]}'><body><article><p>{mixed()}</p></article></body></html>" if i % 6 else None) for i in range(48)]
    got, out = run(spark, docs, pages)
    want = brute(docs, pages)
    assert len(out) == len(want)
    for key, lang, confidence, by_text in want:
        assert (got[key].lang, got[key].text_lang) == (lang, by_text) and abs(got[key].confidence - confidence) < 1e-6, key


def test_many_languages(spark):
    """More languages than a worker counts at once; each has words of its own."""
    r = np.random.default_rng(0)
    words = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)] for _ in range(300)]
    docs = [(i, " ".join(words[i % 300] * 3), f"l{i % 300:03}", None) for i in range(1200)]
    got, _ = run(spark, docs, [])
    trained = {x for i, _, x, _ in docs if zlib.crc32(str(i).encode()) % 5}
    wrong = [(i, x, got["d", i].lang, got["d", i].text_lang) for i, _, x, _ in docs if got["d", i].lang != x and x in trained]
    assert len(trained) > 290 and not wrong, (len(wrong), wrong[:5])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, EN, "en", "s", "h", 1.0, 2) for i in range(9)], DOCS + ", host string, t double, score int")
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "t", "l")], PAGES + ", text string, lang string")
    assert {r.lang for r in op.identify(docs, pages).collect()} == {"en"}


def test_empty(spark):
    assert run(spark, [], [])[1] == []
    _, out = run(spark, [(1, "a b", None, "s")], [(1, "http://a.b/", "<p>x</p>")])
    assert [(r.lang, r.confidence) for r in out] == [(None, None)] * 2


def test_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()}
    out = op.op8_language_fusion(spark, d).collect()
    assert len(out) == len(truth) + len(urls)
    held = [r.lang == truth[r.doc_id] for r in out if r.doc_id is not None and r.held_out]
    ids = {p: int(m[1]) for p, u in urls.items() if (m := re.search(r"/(\d+)(?:[?#]|$)", u))}
    pages = [r.lang == truth[ids[r.page_id]] for r in out if r.page_id in ids and ids[r.page_id] in truth]
    assert np.mean(held) > 0.98 and np.mean(pages) > 0.98, (np.mean(held), np.mean(pages))
