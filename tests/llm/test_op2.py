import re
from collections import Counter

import pytest

from tessera.llm import op2_wrappers as op
from tessera.llm.html import parse

SCHEMA = "page_id long, url string, html string"


def run(spark, rows):
    out = op.main_texts(spark.createDataFrame(rows, SCHEMA))
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    out = out.collect()
    assert all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}, out


CASES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    ("<article><h1>A</h1><p>one  two\n three<p>four<br>five</article><footer>x</footer>", "A\n\none two three\n\nfour five"),
    ("<nav>menu</nav><article><p>a &amp; b&lt;c &#233;</p><aside>no</aside><div class='comments'><p>troll</p></div></article>", "a & b<c é"),
    ("<body><header>h</header><main><p>x</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>y</p></main><footer>f</footer>", "x\n\ny"),
    ("<article><header><nav>n</nav><h1>T</h1></header><form><p>mail</p></form><p>b<b>o</b>ld <a href='>'>l</a></p><footer>tags</footer></article>", "T\n\nbold l"),
    ("<div id='sidebar'>s</div><div class='post-content'><p>p1</p><ul><li>i<li>j</ul></div>", "p1\n\ni\n\nj"),
    ("<article><p>unclosed <b>bold<br><p>next", "unclosed bold\n\nnext"),
    ("<article class='comment'>c</article><article><p>real text</p></article>", "real text"),
    ("<div class='page has-sidebar'><div class='post-body'><p>the long text of it all</p></div></div><div class='sidebar'>s</div>", "the long text of it all"),
    ("<div class='entry'><p>short</p></div><div id='comments'><p>a much longer comment of some reader</p></div>", "short"),
    ("<article><p>" + "w " * 50000 + "</p></article>", ("w " * 50000).strip()),
]


def test_cases(spark):
    got, out = run(spark, [(i, f"http://h{i}.org/", h) for i, (h, _) in enumerate(CASES)] + [(None, None, "<p>x</p>"), (3, "http://h3.org/", CASES[3][0])])
    assert len(out) == len(CASES) + 2
    assert [got[i] for i in range(len(CASES))] == [t for _, t in CASES] and got[None] == "x"


def test_empty(spark):
    assert run(spark, [])[1] == []


@pytest.mark.parametrize("limit", [op.BROADCAST_BYTES, -1])
def test_template(spark, limit, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_BYTES", limit)
    page = "<body><div><p>Our site since 1999</p></div><article><h1>Title {0}</h1><p>Text {0} of this page</p><div><p>Like this? Tell a friend.</p></div>{1}</article></body>"
    rows = [(i, f"http://same.org/{i}", page.format(i, f"<p>more {i}</p>" * (i % 3))) for i in range(12)] + [(99, "http://lone.org/", page.format(99, ""))]
    got, _ = run(spark, rows)
    for i in range(12):
        assert got[i] == "\n\n".join([f"Title {i}", f"Text {i} of this page", *[f"more {i}"] * (i % 3)])
    assert got[99] == "Title 99\n\nText 99 of this page\n\nLike this? Tell a friend."


def test_matching_is_the_best_ordered_one():
    import itertools
    import random

    r = random.Random(0)

    def tree(depth):
        return f"<div class='{r.choice('ab')}'>" + "".join(tree(depth - 1) for _ in range(r.randrange(3))) + "</div>" if depth else "<p>x</p>"

    def best(a, b):
        if a.label != b.label:
            return 0
        x, y = a.children, b.children
        return 1 + max(sum(best(p, q) for p, q in zip(u, v, strict=True)) for k in range(min(len(x), len(y)) + 1) for u in itertools.combinations(x, k) for v in itertools.combinations(y, k))

    for _ in range(60):
        a, b = parse(tree(3)), parse(tree(3))
        assert op.match(a, b)[0] == best(a, b)


def test_whole_table(spark):
    """Pages of the test data tell in their address which document they show."""
    d = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op.op2_html_wrappers(spark, d).collect()
    right = []
    for r in out:
        m = re.search(r"/(\d+)(?:[?#]|$)", r.url)
        if m and int(m[1]) in docs:
            lines = [" ".join(x.split()) for x in docs[int(m[1])].split("\n") if x.strip()]
            right.append(r.text.split("\n\n", 1)[-1] == "\n\n".join(lines))
    assert len(right) > 1000 and sum(right) >= 0.99 * len(right)


def test_long_lists_are_matched_like_short_ones(monkeypatch):
    import random

    r = random.Random(3)

    def tree(depth):
        return f"<div class='{r.choice('ab')}'>" + "".join(tree(depth - 1) for _ in range(r.randrange(6))) + "</div>" if depth else f"<p>{r.choice('xyz')}</p>"

    equal = lambda found: (found[0], sum(not a.tag and a.text == b.text for a, b in found[1]))
    for _ in range(60):
        a, b = parse(tree(3)), parse(tree(3))
        monkeypatch.setattr(op, "MATCH", 1 << 30)
        short = equal(op.match(a, b))
        monkeypatch.setattr(op, "MATCH", 0)
        assert equal(op.match(a, b)) == short


def test_constant_text_within_long_pages(spark):
    rows = []
    for i in range(8):
        own = [f"page {i} says {j}" for j in range(403 + i % 3)]
        own.insert(200 + i % 3, "Subscribe to our letter")
        rows.append((i, f"http://long.org/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in own) + "</article>"))
    got, _ = run(spark, rows)
    assert all("Subscribe" not in got[i] and got[i].count("says") == 403 + i % 3 for i in range(8))


def test_least_page_is_empty(spark):
    import xxhash

    page = "<body><div><p>Our site since 1999</p></div><article><h1>Title {0}</h1><p>Text {0}</p><div><p>Tell a friend.</p></div></article></body>"
    for stub in (None, "", "<body><p>404</p></body>"):
        rows = [(i, f"http://same.org/{i}", page.format(i)) for i in range(12)]
        least = min(rows, key=lambda r: xxhash.xxh3_64_intdigest(f"{r[0]} {r[1]}") >> 1)[0]
        rows[least] = (*rows[least][:2], stub)
        got, _ = run(spark, rows)
        assert all(got[i] == f"Title {i}\n\nText {i}" for i in range(12) if i != least)


def test_two_templates_of_a_host(spark):
    one = "<body><article><h1>Title {0}</h1><p>Text {0}</p><div class='x'><p>Tell a friend.</p></div></article></body>"
    two = "<body><main><section><h2>Item {0}</h2><div class='y'><p>Offers end soon.</p></div><ul><li>fact {0}</li></ul></section></main></body>"
    rows = [(i, f"http://two.org/{i}", (one, two)[i % 2].format(i)) for i in range(24)]
    got, _ = run(spark, rows)
    assert all(got[i] == (f"Item {i}\n\nfact {i}" if i % 2 else f"Title {i}\n\nText {i}") for i in range(24))


def test_deeply_nested_pages(spark):
    page = "<div>" * 5000 + "<p>deep text {0}</p>" + "</div>" * 5000 + "<p>behind {0}</p>"
    rows = [(i, f"http://deep.org/{i}", page.format(i)) for i in range(8)]
    got, _ = run(spark, rows)
    assert all(got[i] == f"deep text {i}\n\nbehind {i}" for i in range(8))


@pytest.mark.parametrize("limit", [op.BROADCAST_BYTES, -1])
def test_wrappers_find_the_article_without_names(spark, limit, monkeypatch):
    """Two templates of neutral names; the parts around the articles vary too. With names off, wrappers alone tell."""
    monkeypatch.setattr(op, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(op, "HOT", 5)
    long = "a sentence of page {0} that is long enough to outweigh all that stands around it. " * 3
    one = "<body><div class='a'><p>choose {0}</p><p>go {0}</p></div><div class='b'><h1>Title {0}</h1><p>" + long + "</p><div class='c'><p>Tell a friend.</p></div></div><div class='d'><p>seen {0} times</p></div></body>"
    two = "<body><section class='e'><p>near {0}</p></section><section class='f'><h1>Item {0}</h1><p>" + long + "</p></section><section class='g'><p>from {0} on</p></section></body>"
    rows = [(i, f"http://two.org/{i}", (one, two)[i % 2].format(i)) for i in range(24)] + [(90, "http://two.org/x", None), (91, "http://two.org/y", "<p>")]
    got = {r.page_id: r.text for r in op.main_texts(spark.createDataFrame(rows, SCHEMA), named=False).collect()}
    assert len(got) == len(rows) and got[90] == got[91] == ""
    for i in range(24):
        assert got[i] == f"{'Item' if i % 2 else 'Title'} {i}\n\n{long.format(i).strip()}"


def test_copies_of_one_page_stay(spark):
    rows = [(i, f"http://copies.org/{i}", "<body><article><h1>One</h1><p>text of all</p></article></body>") for i in range(10)]
    got, _ = run(spark, rows)
    assert set(got.values()) == {"One\n\ntext of all"}


def test_wrappers_alone_on_the_whole_table(spark):
    """With names switched off, pages of hosts that have a wrapper come out as with them."""
    d = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    both = {r.page_id: (r.url, r.text) for r in op.main_texts(pages).collect()}
    alone = {r.page_id: r.text for r in op.main_texts(pages, named=False).collect()}
    host = lambda u: re.sub("^.*?://([^/]*).*$", "\\1", u)
    n = Counter(host(u) for u, _ in both.values())
    same = [alone[i] == t for i, (u, t) in both.items() if n[host(u)] >= op.LEAST]
    print(len(both), len(same), sum(same))
    assert len(same) > 0.99 * len(both) and sum(same) >= 0.95 * len(same)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>", "h", "f", "t")], SCHEMA + ", host string, fact string, text string")
    assert [tuple(r) for r in op.main_texts(df).collect()] == [(1, "http://a.org/", "x", 1)]
