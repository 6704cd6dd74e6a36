import pytest

from quadloom.llm import html_extract as H
from tests.llm.fixtures import words


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, open string").repartition(2)


CASES = {
    "": "",
    "plain": "plain",
    "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n  two</p></article><footer>f</footer></body></html>": "A & B\none two",
    "<article><p>a</p><div class='comments'><p>rude</p></div><aside>x</aside><p>b</p></article>": "a\nb",
    "<body><div id=content><p>Text<br>more</p><ul><li>1<li>2</ul></div><div class=sidebar>no</div></body>": "Text more\n1\n2",
    "<p>a<script>var x = '<p>no</p>'</script>b</p><style>p{}</style>": "ab",
    "<p>&lt;tag&gt; &eacute;&#233;&#xe9; &nbsp; z</p>": "<tag> ééé z",
    "<div class='cookie-notice'>we use cookies</div><p>real</p>": "real",
    "<p>unclosed <b>bold <p>next": "unclosed bold\nnext",
    "<article>a<form><input>f</form><button>go</button><p>b</p></article>": "a\nb",
    "<!-- <p>no</p> --><p>yes</p>": "yes",
    "<div hidden>no</div><p>yes</p>": "yes",
    "<main><p>m</p></main><p>out</p>": "m",
    "<table><tr><td>a<td>b</table>": "a\nb",
    "<p>in<i>li</i>ne <a href='x'>link</a></p>": "inline link",
    "<p title='a > b'>x</p>": "x",
    "a < b and c > d": "a < b and c > d",
}


@pytest.mark.parametrize("html", CASES)
def test_structure(html):
    assert H.zoned(html)[0] == CASES[html]


ZONES = {
    "<main><h1>T</h1><article><p>x</p></article><p>y</p></main>": "T\nx\ny",
    "<div class=content><p>long text</p></div><article>teaser</article><p>out</p>": "long text\nteaser",
    "<table><tr><td class=content>Intro<p>Body</p></td><td>no</table>": "Intro\nBody",
    "<article><p>a</p><ul><li class=comment><p>rude</p><p>more</p></li><li><p>b</p></ul></article>": "a\nb",
    "<dl><dt>x<dd class=content><p>one</p><p>two</p><dt>y</dl>": "one\ntwo",
    "<article><table><tr><td class=ad>no<tr><td>a<td><p>b</table></article>": "a\nb",
}


@pytest.mark.parametrize("html", ZONES)
def test_zones(html):
    assert H.zoned(html)[0] == ZONES[html]


#: Parts that names or elements seem to put outside, but which are the text.
INSIDE = {
    "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>": "so x=2 holds",
    "<article class='post related'><p>a</p></article>": "a",
    "<div class='post search'><p>a</p></div>": "a",
    "<body><form action=x><div class=content><p>a</p></div><p>b</p></form>": "a",
    "<form><p>a</p><article><p>b</p></article></form>": "b",
    "<form><p>only</p></form>": "only",
    "<article><p>See <span class=alert>this</span> now</p></article>": "See this now",
    "<article><p>See <span class='ad'>buy</span> now</p><p>b</p></article>": "See now\nb",
    "<article><p>a <span class=ad>buy <b>it</b></p><p>b</p></article>": "a\nb",
    "<article><p>a <span hidden>no <i>no</i></span>b</p></article>": "a b",
    "<article><div class='entry-header'><h1>T</h1></div><p>a</p></article>": "T\na",
    "<div class='post-header'><h1>T</h1></div><div class=post><p>a</p></div>": "a",
    "<article><div class='header'><h1>T</h1></div><p>a</p><div class='comments header'>no</div></article>": "T\na",
    "<div class='site-header'>no</div><p>a</p>": "a",
}


@pytest.mark.parametrize("html", INSIDE)
def test_inside(html):
    assert H.zoned(html)[0] == INSIDE[html]


UNCLOSED = {
    "<html><head><title>t</title><body><article><p>text</p></article>": "text",
    "<head><title>t</title><meta charset=x><article><p>text</p></article>": "text",
    "<head><title>t<meta name=x><script>'<p>no</p>'</script><body><article><p>text</p></article>": "text",
    "<head><script>var x = '<p>no</p>';</head><body><p>text</p>": "text",
    "<body><noscript>no<select><option>no<div><p>text</p></div>": "text",
    "<noscript><p>no</p></noscript><p>yes</p><noscript>no<p>text</p>": "yes\ntext",
    "<p>a</p><object><object>no</object>no</object><p>b</p>": "a\nb",
    "<p>a <svg viewBox='0'/>b</p><svg><title>no</title><path/></svg><p>c</p>": "a b\nc",
    "<p>a</p><template><article>no</article></template><p>b</p>": "a\nb",
    **{f"<p>a</p><{e}>no<section><p>b</p></section>": "a\nb" for e in "noscript select svg object canvas audio video template datalist textarea iframe title script style".split()},
}


@pytest.mark.parametrize("html", UNCLOSED)
def test_unclosed(html):
    assert H.zoned(html)[0] == UNCLOSED[html]


@pytest.mark.parametrize("tag", ["<title>", "<svg>", "<script>", "<p><select>"])
def test_many_unclosed_take_linear_time(tag):
    assert H.zoned(tag * 50_000 + "<section>text")[0] == "text"


def test_host_boilerplate(spark):
    bar = words(0, 12)
    own = [words(k, 30) for k in range(1, 6)]
    rows = [(k, "http://h.com/%d" % k, f"<div>{bar}</div><div>{t}</div><div>{bar} tail{k}</div>") for k, t in enumerate(own)]
    rows += [(10, "http://other.com/1", f"<div>{bar}</div>"), (11, "http://other.com/2", f"<div>{bar}</div>")]  # two pages only
    got = {r["page_id"]: r["text"] for r in H.extracted(pages(spark, rows)).collect()}
    assert [got[k] for k in range(5)] == [f"{t}\ntail{k}" for k, t in enumerate(own)]
    assert got[10] == got[11] == bar


def texts_of(spark, bodies):
    """Texts of pages of one host."""
    got = {r["page_id"]: r["text"] for r in H.extracted(pages(spark, [(k, f"http://h.com/{k}?utm_source=x", b) for k, b in enumerate(bodies)])).collect()}
    return [got[k] for k in range(len(bodies))]


def test_copies_do_not_cover_themselves(spark):
    one, two, bar = words(1, 40), words(2, 30), words(0, 12)
    assert texts_of(spark, [f"<p>{one}</p><p>{two}</p>"] * 3) == [f"{one}\n{two}"] * 3
    assert texts_of(spark, [f"<p>{one}</p>"] * 4) == [one] * 4
    near = [f"<p>{one}</p><p>{two}</p><div>seen {k} times</div>" for k in range(4)]
    assert texts_of(spark, near) == [f"{one}\n{two}\nseen {k} times" for k in range(4)]
    assert texts_of(spark, [f"<p>{words(5, 60)}</p><div>seen {k} times</div>" for k in range(4)]) == [f"{words(5, 60)}\nseen {k} times" for k in range(4)]
    others = [f"<div>{bar}</div><p>{words(k, 35)}</p>" for k in (3, 4)]
    assert texts_of(spark, [f"<div>{bar}</div><p>{one}</p>"] * 3 + others) == [one] * 3 + [words(k, 35) for k in (3, 4)]


def test_quoted_passages_stay(spark):
    quote = words(0, 12)
    bodies = [f"<p>{words(10 + k, 20)} {quote} {words(20 + k, 20)}</p>" for k in range(4)]
    assert texts_of(spark, bodies) == [b[3:-4] for b in bodies]


def brute(rows, depth, least):
    """Every substring of `depth` tokens and the pages of its host that hold it."""
    texts = [(u, H._host(u or ""), H.zoned(h or "")) for _, u, h in rows]
    held = {}
    for u, host, (text, is_open) in texts:
        ws = text.split()
        if is_open:
            for k in range(len(ws) - depth + 1):
                held.setdefault((host, tuple(ws[k : k + depth])), set()).add((u, text))
    out = []
    for _, host, (text, is_open) in texts:
        ws = text.split()
        covered = {j for k in range(len(ws) - depth + 1) if is_open and len(held[host, tuple(ws[k : k + depth])]) >= least for j in range(k, k + depth)}
        at, lines = 0, []
        for line in text.split("\n"):
            kept = [w for j, w in enumerate(line.split(), at) if j not in covered]
            at += len(line.split())
            lines += [" ".join(kept)] if kept else []
        out.append("\n".join(lines))
    return out


def test_runs_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(k, f"http://h{r.randint(0, 2)}.org/{k}", "".join(f"<p>{' '.join(r.choice('abc') for _ in range(r.randint(1, 12)))}</p>" for _ in range(r.randint(1, 4)))) for k in range(40)]
    got = {r["page_id"]: r["text"] for r in H.extracted(pages(spark, rows), 4, 3).collect()}
    assert [got[k] for k in range(40)] == brute(rows, 4, 3)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (2, "u", None), (3, "http://a/b", "<p>x</p>"), (3, "http://a/b", "<p>x</p>"), (4, "http://a/c", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "http://a/d", f"<article>{'<p>w</p>' * 50_000}</article>")]
    got = sorted(((r["page_id"], r["n_chars"]) for r in H.extracted(pages(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 0), (1, 0), (2, 0), (3, 1), (3, 1), (4, 4), (5, 99_999)], key=repr)
    assert H.extracted(pages(spark, [])).count() == 0
