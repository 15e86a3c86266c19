"""What pages keep: near copies, omitted tags, formulas; and the whole query on random sites against a plain version."""

import random
from collections import defaultdict

import pytest

from tidemark.llm import html_extract as h


def texts(spark, pages):
    return {r["id"]: r["text"] for r in h.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}


@pytest.mark.parametrize("n", [2, 3, 5])
def test_near_copies_keep_their_text(spark, n):
    same = "".join(f"<p>Paragraph {i} of a report that all copies have.</p>" for i in range(10))
    links = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    pages = [(i, f"http://h/{i}", f"<html><body>{links}{same}<p>edition {i}</p></body></html>") for i in range(n)]
    for i, text in texts(spark, pages).items():
        assert text == " ".join([f"Paragraph {k} of a report that all copies have." for k in range(10)]) + f" edition {i}"


def test_template_goes_where_pages_differ(spark):
    pages = [(i, f"http://h/{i}", f"<body><p>Part of every page.</p><p>A story number {i}, long enough to be most of this page, told once.</p></body>") for i in range(4)]
    assert texts(spark, pages) == {i: f"A story number {i}, long enough to be most of this page, told once." for i in range(4)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>x</title><body><article><p>hello world</p></article></body></html>", "hello world"),
        ("<html><head><meta charset=utf-8><link rel=x><p>hello", "hello"),
        ("<head>bare text", "bare text"),
        ("<head><style>p {}</style></head><p>a<p>b<div>c</div>d", "a b c d"),
        ("<article><p class=cookie-notice>We use cookies<div>kept</div></article>", "kept"),
        ("<article><ul><li class=ad>Buy<li>one<li>two</ul><dl><dt class=promo>P<dd>three</dl></article>", "one two three"),
        ("<article><table><tr><td class=ad>Buy<td>cell<tr><th>head<td>x</table>after</article>", "cell head x after"),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", "So x=2 holds."),
        ("<article><object data=m><p>shown instead</p></object><p>rest</p></article>", "shown instead rest"),
        ("<article><header><h1>T</h1></header>body<select><option>a<option>b</select></article>", "T body"),
        ("<nav><p>menu<div>still menu</div></nav><p>text", "text"),
    ],
)
def test_markup(page, text):
    assert h.main_text([x for x in h.page_lines(page) if x.zone != "chrome"]) == text


def plain_common(a, b):
    """Some longest common subsequence's length, and the lines that `h.shared_lines` says are on one."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    got = h.shared_lines(a, b)
    assert len(got) == best[-1][-1]
    return got


def plain_site(pages):
    """{id: text}: every page beside the pages before and after it on its host, copies as one."""
    parsed = {}
    for i, url, source in pages:
        lines = [x for x in h.page_lines(source) if x.zone != "chrome"]
        zone = "article" if any(x.zone == "article" for x in lines) else "body"
        shown = [(x.text, zone == "body" or x.hinted or x.menu, x.hinted or x.menu) for x in lines if x.zone == zone and not (x.hinted and x.menu)]
        host, _, path = url.partition("//")[2].partition("/")
        parsed[i] = (host, "/" + path, [x.text for x in lines], shown)
    order = defaultdict(dict)
    for host, path, keys, shown in parsed.values():
        mark = (tuple(keys), tuple(shown))
        order[host][mark] = min(path, order[host].get(mark, path))
    out = {}
    for i, (host, _, keys, shown) in parsed.items():
        sites = sorted(order[host].items(), key=lambda x: (x[1], x[0]))
        at = next(k for k, x in enumerate(sites) if x[0] == (tuple(keys), tuple(shown)))
        near = [sites[k] for k in (at - 1, at + 1) if 0 <= k < len(sites)]
        near.sort(key=lambda x: -h._closeness(x[1], sites[at][1]))
        shared = [{keys[k] for k in plain_common(keys, list(x[0][0]))} for x in near]
        size = lambda part: sum(len(t) for t, is_open, _ in shown if is_open and t in part)  # noqa: B023, E731
        gone, whole = shared[0] if shared else set(), size(set(keys))
        if shared and size(gone) > (0.5 if len(near) > 1 else 0.8) * whole:
            suspect = {t for t, _, odd in shown if odd and t in gone}
            both = gone & shared[1] if len(near) > 1 else set()
            gone = suspect if size(both) > 0.9 * whole else suspect | both
        kept = [t for t, is_open, _ in shown if not (is_open and t in gone)]
        out[i] = " ".join(kept or [t for t, _, _ in shown])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_sites(spark, seed):
    r = random.Random(seed)
    template = [f"<p>Standing line {i} of the site.</p>" for i in range(6)] + ["<p><a href=x>Read more here</a></p>", "<div class=related-work><p>Related</p></div>"]

    def page(host):
        own = [f"<p>Line {r.randrange(10**6)} of host {host}, said at some length.</p>" for _ in range(r.randrange(1, 8))]
        parts = r.sample(template, r.randrange(len(template))) + own
        r.shuffle(parts)
        wrap = r.random()
        body = "".join(parts)
        return f"<article>{body}</article><p>side</p>" if wrap < 0.2 else f"<html><head><title>t</title><body><nav>menu</nav>{body}"

    pages, kept = [], {}
    for i in range(120):
        host = r.choice("aabbc")
        source = r.choice(list(kept.values())) if kept and r.random() < 0.1 else page(host)
        kept[i] = source
        pages.append((i, f"http://{host}/{i:03}", source))  # paths are different, and no line is twice in a page
    want = plain_site(pages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = texts(spark, pages)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want
