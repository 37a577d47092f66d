"""Operators over pages, and the registered queries."""

import glob
import os

import duckdb
import pytest

from driftmesh.llm import html, mixing, registry, urls

FRAME = "<html><head><title>T t</title><style>p{a:b}</style><script>var t='</p>';</script></head><body><header>Site name</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>%s<footer>&copy; all</footer></body></html>"
WORDS = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize(
    "body",
    [
        f"<article><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p></article>",
        f"<div id=content><h1>Head</h1><p>{WORDS}<p>{WORDS}</div>",
        f"<main><h1>Head</h1><p>{WORDS}</p><div class='ad'>Buy {WORDS}</div><p>{WORDS}</p></main><aside>Related {WORDS}</aside>",
        f"<div class=notice>Cookies {WORDS}</div><article><h1>Head</h1><p>{WORDS}</p><form>Name <input> {WORDS}</form><p>{WORDS}</p></article><section class='comments'><p>Me: {WORDS} {WORDS} {WORDS} {WORDS} {WORDS} {WORDS}</p></section>",
        f"<h1>Head</h1><p>{WORDS}</p><!-- <p>hidden</p> --><p>{WORDS}",
    ],
)
def test_article_only(body):
    assert html.extract(FRAME % body) == f"Head {WORDS} {WORDS}"


def test_references_blocks_and_broken_pages():
    assert html.extract("<p>a &amp; b&nbsp;c &#233;<b>x</b>y &lt;p&gt; d e f</p><p> g\n h </p>") == "a & b c éxy <p> d e f g h"
    assert html.extract(None) == html.extract("") == html.extract("<p></p><div>") == html.extract("<script>if (a < b) x</script>") == ""
    assert html.extract("plain words only here") == "plain words only here"
    assert html.extract(f"<article><p>{WORDS}</p><p>cut <b") == f"{WORDS} cut"
    assert html.extract("<p>a b c d <" + "div " * 5) == "a b c d"
    long = "word " * 50_000
    assert html.extract(f"<p>{long}</p>" + "<i>" * 3000) == long.strip()


def test_region_is_the_best_sum():
    import itertools
    import random

    rng = random.Random(0)
    for _ in range(200):
        s = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        lo, hi = html.region(s)
        best = max([0, *(sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2))])
        assert sum(s[lo:hi]) == best


def test_weights_from_labelled_pages():
    weights = dict(html.fitted())
    assert weights["word"] == 1.0 and all(v < 0 for k, v in weights.items() if k not in ("word", "linked"))
    held_out = html.labelled_pages(200, seed=77)
    assert sum(html.extract(p) == t for p, t in held_out) >= 196
    bodies = [f"<article><h1>Head {i}</h1><p>{WORDS} {i}</p><p>{WORDS}</p></article>" for i in range(20)]
    labelled = [(FRAME % b, f"Head {i} {WORDS} {i} {WORDS}") for i, b in enumerate(bodies)]
    assert [html.extract(p, html.fit(labelled)) for p, _ in labelled] == [t for _, t in labelled]


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<article><p>{WORDS}</p><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table><p>{WORDS}</p></article>", f"{WORDS} a b c d {WORDS}"),
        (f"<h1>A</h1><p>Short.</p><div class=ad>x</div><p>{WORDS}</p>", f"A Short. {WORDS}"),
        (f"<div><p>{WORDS}</p><div><div><div><img></div></div></div><p>{WORDS}</p></div>", f"{WORDS} {WORDS}"),
        (f"<p>{WORDS}</p><ul><li>x</li><li><a href=/>y</a></li></ul><p>z</p>", f"{WORDS} x y z"),
        (f"<div id=content><h1>A</h1><div class=ad>{WORDS} {WORDS}</div><p>{WORDS}</p></div>", f"A {WORDS}"),
    ],
)
def test_short_blocks_tables_and_adverts_stay_whole(body, text):
    assert html.extract(FRAME % body) == text


def test_equal_regions_and_repeats(spark):
    page = "<div>a b c</div>" + "<div class=ad>x</div>" * 40 + "<div>d e f</div>"
    assert html.region([1.0, -5.0, 1.0]) == (0, 1)
    got = html.extract_pages(pages(spark, ("u", page), ("u", page))).collect()
    assert got[0].text == got[1].text


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, rule string, label string")


def test_page_rows(spark):
    got = html.extract_pages(pages(spark, ("u", f"<p>é{WORDS}"), (None, None), ("u", ""))).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [(f"é{WORDS}", len(WORDS) + 1), ("", 0), ("", 0)]
    assert html.extract_pages(pages(spark, ("u", "")).limit(0)).count() == 0


def test_rules(spark):
    rows = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://EXAMPLE.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.www.example.com/en/2": ("m.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "http://notexample.com/en/2": ("notexample.com", "/en/2", "com/", "allow"),
        "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "http://b.net/de/": ("b.net", "/de/", None, "allow"),
        "http://b.net?x://y/es/": ("b.net", "", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "http:///en/": ("", "/en/", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    got = urls.judge(pages(spark, *[(u, None) for u in rows])).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(rows.values())
    assert urls.judge(pages(spark, ("u", "")).limit(0)).count() == 0


CANON = '<link rel="canonical" href="%s">'


def test_aliases(spark):
    rows = [
        ("http://one.org/a", CANON % "http://b.net/es/1"),  # an alias of a blocked page
        ("http://b.net/es/1", "<p>"),
        ("http://two.org/a", '<meta http-equiv="refresh" content="0; url=http://one.org/a">'),  # by way of another
        ("http://three.org/a", CANON % "http://b.net/fr/1"),
        ("http://b.net/fr/1", "<p>"),
        ("http://three.org/a?utm_source=x", CANON % "http://ok.com/z"),  # an allow in the component outweighs
        ("http://ok.com/z", "<p>"),
        ("http://www.one.org/a/#top", "<p>"),  # the plain form joins it
        ("http://four.org/a", "<p>"),
    ]
    got = [r.verdict for r in urls.judge(pages(spark, *rows)).orderBy("page_id").collect()]
    assert got == ["block", "block", "block", "allow", "block", "allow", "allow", "block", "allow"]


REFRESH = '<meta http-equiv="refresh" content="0; url=%s">'


def test_both_links_and_relative_targets_count(spark):
    rows = [
        ("http://one.org/dir/a", CANON % "http://b.net/es/1" + REFRESH % "b"),  # both edges: a block behind one, a page behind the other
        ("http://one.org/dir/b", "<p>"),
        ("http://b.net/es/1", "<p>"),
        ("http://two.org", REFRESH % "c?x=1"),
        ("http://two.org/c?x=1", CANON % "//b.net/fr/2"),
        ("http://b.net/fr/2", "<p>"),
        ("http://three.org/a", "<!-- " + CANON % "http://b.net/es/1" + " --><script>" + CANON % "http://b.net/es/1" + "</script>" + REFRESH % "mailto:x"),
        ("http://one.org/dir/a", "<p>"),  # a repeated url
        (None, CANON % "http://b.net/es/1"),
    ]
    want = ["block", "block", "block", "block", "block", "block", "allow", "block", "allow"]
    table = pages(spark, *rows)
    got = urls.judge(table).orderBy("page_id").collect()
    assert [r.verdict for r in got] == want
    con = duckdb.connect()
    con.register("pages", table.toArrow())
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in con.execute(urls.SQL).fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = con.execute(registry.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in cols]) for r in rows.fetchall())


def test_alias_sql(spark):
    con = duckdb.connect()
    rows = [("http://one.org/a", CANON % "http://b.net/es/1"), ("http://b.net/es/1", ""), ("http://www.two.org/a/", '<meta http-equiv=refresh content="0;url=http://one.org/a">'), (None, None)]
    table = pages(spark, *rows)
    con.register("pages", table.toArrow())
    want = sorted(str(r) for r in con.execute(urls.SQL).fetchall())
    assert sorted(str(tuple(r)) for r in urls.judge(table).collect()) == want


def test_registry_runs(spark, sf):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    for name in ("op1_html_extraction", "op7_license_scan", "op10_quality_rules"):
        assert registry.QUERIES[name](spark, sf).count() > 0
    assert mixing.sql().strip().startswith("WITH")
