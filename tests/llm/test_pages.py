"""Url filters and main text."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.llm import dom, extract, queries, urls

PAGES = "page_id bigint, url string, html string, host string, verdict int, after int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/a?x#y"), (2, "ftp://a.net/es/"), (3, "http://x.com"), (4, None), (5, "nothing"), (6, "://"),
        (7, "http://anexample.com/en/1"), (8, "http://m.example.com/en/1"), (9, "http://x.com?a/b"), (10, "http://a\n.com/b\n/c#f"),
        (11, "http://a://b.com/x"), (12, "http://É.com/"), (12, "http://É.com/"), (None, "http://net/fr/x"),
    ]
    df = pages(spark, [(i, u, None) for i, u in rows])
    got = {(r.page_id, r.host, r.path, r["rule"]): r.verdict for r in urls.judge(df, queries.URL_RULES, urls.learn(df, queries.URL_RULES)).collect()}
    assert got.keys() == {
        (1, "www.example.com", "/en/a", "www.example.com/en/"), (2, "a.net", "/es/", "net/es/"), (3, "x.com", "", None), (4, "", "", None),
        (5, "", "", None), (6, "", "", None), (7, "anexample.com", "/en/1", "com/"), (8, "m.example.com", "/en/1", "example.com/en/"),
        (9, "x.com", "", None), (10, "a\n.com", "/b\n/c", "com/"), (11, "a:", "//b.com/x", None), (12, "É.com", "/", "com/"),
        (None, "net", "/fr/x", "net/fr/"),
    }
    for (_, _, _, rule), verdict in got.items():
        assert verdict == {"com/": "allow", "www.example.com/en/": "allow", None: verdict}.get(rule, "block")
    empty = df.limit(0)
    assert urls.judge(empty, queries.URL_RULES, urls.learn(empty, queries.URL_RULES)).count() == 0


def test_model_tells_kinds_of_urls_apart(spark):
    rows = [(i, f"https://good{i % 7}.com/news/story-{i}", None) for i in range(300)]
    rows += [(1000 + i, f"https://cheap-pills{i % 7}.net/es/win-{i}", None) for i in range(300)]
    rows += [(2000 + i, f"https://good{i % 7}.org/news/story-{i}9", None) for i in range(50)]
    rows += [(3000 + i, f"https://cheap-pills{i % 7}.org/win-{i}9", None) for i in range(50)]
    df = pages(spark, rows)
    model = urls.learn(df, queries.URL_RULES)
    got = {r.page_id: r.verdict for r in urls.judge(df, queries.URL_RULES, model).collect()}
    assert all(got[2000 + i] == "allow" and got[3000 + i] == "block" for i in range(50))


def counts_by_hand(seen):
    counts = {}
    for url in seen:
        padded = "\x01" * urls.ORDER + url + "\x02"
        for at in range(urls.ORDER, len(padded)):
            for order in range(urls.ORDER + 1):
                context = padded[at - order : at]
                counts[order, context] = counts.get((order, context), 0) + 1
                counts[order, context, padded[at]] = counts.get((order, context, padded[at]), 0) + 1
    return counts


def score_by_hand(url, accepted, rejected):
    """Mean log-likelihood difference from plain dictionaries."""
    padded, total = "\x01" * urls.ORDER + url + "\x02", 0.0
    for counts, sign in ((accepted, 1), (rejected, -1)):
        for at in range(urls.ORDER, len(padded)):
            chance = 1 / urls.ALPHABET
            for order in range(urls.ORDER + 1):
                context = padded[at - order : at]
                chance = (counts.get((order, context, padded[at]), 0) + urls.SHORTER * chance) / (counts.get((order, context), 0) + urls.SHORTER)
            total += sign * math.log(chance)
    return total / (len(url) + 1) if url else 0.0


@pytest.mark.parametrize("chunk", [8192, 2])
def test_scores_equal_counts_by_hand(spark, monkeypatch, chunk):
    monkeypatch.setattr(urls, "CHUNK", chunk)
    allowed = [f"a{i % 5}.com/n{i * 7919 % 1000}" for i in range(120)] + ["é.com/😀"]
    blocked = [f"b{i % 5}.net/es/w{i * 104729 % 1000}" for i in range(120)]
    others = ["x.org/n123", "x.org/n123", "b1.org/es/w77", "", "é.org/😀", "q" * 20_000]
    tables = counts_by_hand(allowed), counts_by_hand(blocked)
    every = allowed + blocked + others
    df = pages(spark, [(i, f"http://{u}", None) for i, u in enumerate(every)])
    model = urls.learn(df, queries.URL_RULES)
    got = {r.page_id: r for r in urls.judge(df, queries.URL_RULES, model).collect()}
    ruled = len(allowed + blocked)
    assert len(got) == len(every) and all(got[i].score is None for i in range(ruled))
    for i, url in enumerate(others, ruled):
        want = score_by_hand(url, *tables)
        assert abs(got[i].score - want) < 1e-9
        assert got[i].verdict == ("allow" if want >= model.threshold else "block")
    grams = {("\x01" * 5 + u + "\x02")[i : i + 6] for u in allowed + blocked for i in range(len(u) + 1)}
    assert model.grams.count() == len(grams)


def test_urls_without_rules(spark):
    df = pages(spark, [(i, f"http://x{i}.org/a", None) for i in range(5)])
    assert {r.verdict for r in urls.judge(df, queries.URL_RULES, urls.learn(df, queries.URL_RULES)).collect()} == {"allow"}


def test_main_text_of_the_given_pages(spark, sf):
    import html
    import re

    found = queries.op8_extract(spark, sf)
    sources = queries.table(spark, sf, "pages").select("page_id", "html")
    for row in found.join(sources, "page_id").collect():
        article = row.html[row.html.index("<article>") : row.html.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert row.text == want and row.n_chars == len(want)


LONG = "This is a long paragraph of text, with commas, and more words than usual. "
CASES = [
    ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><main><h1>T &amp; x</h1><p>First <b>bo</b>ld, text."
     "<p>Second para<br>line<div class=ad>Buy now</div><form><label>Name</label><input></form><section id=comments><p>" + LONG + "</p></section>"
     "</main><aside class=sidebar><p>side text</p></aside><footer>foot</footer>", "T & x First bold, text. Second para line"),
    ("<body><div id=top-menu><a href=x>Home</a> <a href=y>About</a></div><div class=wrap><p>" + LONG * 4 + "</p><p>" + LONG * 3 + "</p></div>",
     (LONG * 7).strip()),
    ("<article>cut off <b>te", "cut off te"),
    ("<article>a &lt; b&nbsp;&nbsp;c <script>x</script><style>y</style><!-- no --><p>d</p>e</article>", "a < b c d e"),
    ("<article>1 < 2 <p title='a>b'>x</p></article>", "1 < 2 x"),
    ("", ""), (None, ""), ("<nav>only <a>menu</a></nav>", ""), ("<", "<"[:0]),
]


def test_main_text_of_other_pages(spark, sf):
    trees = extract.learn(queries.table(spark, sf, "pages"))
    for source, want in CASES[:-1]:
        assert extract.main_text(source, trees) == want
    rows = [(i, "u", source) for i, (source, _) in enumerate(CASES)] + [(None, None, "<article>x</article>"), (0, "u", CASES[0][0])]
    got = extract.extract(pages(spark, rows), trees, keep=["url"])
    assert got.count() == len(rows) and got.columns == ["page_id", "url", "text"]
    assert got.where("page_id = 0").select("text").distinct().count() == 1
    assert extract.extract(pages(spark, []), trees).count() == 0
    huge = "<article><p>" + "word " * 400_000 + "</p></article>"
    assert len(extract.main_text(huge, trees)) == 5 * 400_000 - 1


def test_learning_from_nothing(spark):
    trees = extract.learn(pages(spark, [(1, "u", None), (2, "u", "")]))
    assert extract.main_text("", trees) == ""


def test_decoding_never_keeps_inside_a_dropped_element():
    parents = [-1, 0, 1, 1, 0]
    keep = extract.decode(parents, np.array([0, -5, 9, -9, 4.0]), np.array([0, 0, 3, 3, 8]))
    assert keep.tolist() == [True, True, True, False, True]
    keep = extract.decode(parents, np.array([0, -9, 1, -9, 4.0]), np.array([0, 80, 3, 3, 8]))
    assert keep.tolist() == [True, False, False, False, True]


def test_boosting_learns_a_rule():
    random = np.random.default_rng(1)
    x = random.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = extract.boost(x, y)
    assert ((trees.log_odds(x) > 0) == (y > 0)).mean() > 0.97


def test_nesting_is_forgiven():
    page = dom.Page("<ul><li>a<li>b</ul><p>c<div>d</p></div><b>e</i></b><table><tr><td>f<td>g<tr><td>h</table>")
    shape = [(t, page.tags[p]) for t, p in zip(page.tags[1:], page.parents[1:], strict=True)]
    assert shape == [("ul", "#root"), ("li", "ul"), ("li", "ul"), ("p", "#root"), ("div", "#root"), ("b", "#root"), ("table", "#root"),
                     ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert F is not None and "".join(t for _, t in page.runs) == "abcdefgh"
