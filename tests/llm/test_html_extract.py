from __future__ import annotations

import pytest

from quillon.llm import html_extract as h

SENTENCE = "The first sentence of the story is long enough, and it has marks. "


def article(inner, around="{}"):
    return "<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>" + around.format(f"<article>{inner}</article>") + "</body></html>"


def test_article_without_what_surrounds_it():
    body = "".join(f"<p>{SENTENCE}{k}</p>" for k in range(4))
    around = "<header>Head</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy, now. Really, do.</div>{}<aside>Side, text. More.</aside><div class='comments'><p>A comment, long enough to count. Yes, it is.</p></div><form>f</form><footer>Foot. Notes, here.</footer>"
    got = h.main_text(article("<h1>Title</h1>" + body, around))
    assert got == "\n\n".join(["Title", *[f"{SENTENCE}{k}".strip() for k in range(4)]])


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("<script>a()</script>", ""),
        (article(f"<p>{SENTENCE}&amp; caf&eacute; &#8212;\n\n  x</p>"), f"{SENTENCE}& café — x"),
        (article(f"<p>{SENTENCE}<p>{SENTENCE}two"), f"{SENTENCE.strip()}\n\n{SENTENCE}two"),
        (article(f"<p>{SENTENCE}<b>bold</b><br>next</p>"), f"{SENTENCE}bold next"),
        (article(f"<p>{SENTENCE}</p><!-- <p>hidden</p> --><p hidden>no</p><p>{SENTENCE}</p>"), f"{SENTENCE.strip()}\n\n{SENTENCE.strip()}"),
    ],
)
def test_pages(page, expected):
    assert h.main_text(page) == expected


def test_broken_markup_ends():
    for page in ("<p", "<", "<!--", "<script", "<p class='a", "</p></p>", "<" * 2000, "<div>" * 3000 + "x", "<table><tr><td>" * 200):
        h.main_text(page)


def test_rows_stay(spark):
    page = article(f"<p>{SENTENCE}</p>")
    df = spark.createDataFrame([(1, "u", page, 9), (1, "u", page, 9), (None, None, None, None), (2, "v", "", 1)], "page_id long, url string, html string, text int")
    rows = h.extract(df).collect()
    assert sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows)) == [(0, "", 0), (1, SENTENCE.strip(), len(SENTENCE.strip())), (1, SENTENCE.strip(), len(SENTENCE.strip())), (2, "", 0)]
    assert h.extract(df.limit(0)).count() == 0


def test_path_ratios_prefer_long_marked_text():
    blocks = h.read("<body><div class='x'><p>" + SENTENCE * 3 + "</p></div><ul><li>a</li><li>b</li><li>c</li><li>d</li></ul></body>").blocks
    h.ratios(blocks)
    assert blocks[0].ratio > 5 * max(b.ratio for b in blocks[2:])


def test_title_beside_the_article():
    body = "".join(f"<p>{SENTENCE}{k}</p>" for k in range(3))
    text = "\n\n".join(f"{SENTENCE}{k}" for k in range(3))
    assert h.main_text(f"<body><div id='content'><h1>Title</h1><div class='post'>{body}</div></div></body>") == "Title\n\n" + text
    assert h.main_text(f"<body><h1>Site</h1><div class='post'>{body}</div></body>") == text


def test_parts_beside_the_largest_stay():
    """An article in containers side by side, one of which has over 70% of the text, loses none of them."""
    long = [f"{SENTENCE * 3}{k}" for k in range(6)]
    lead, last = f"{SENTENCE * 3}lead", f"{SENTENCE * 3}last"
    tag = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    whole = "\n\n".join([lead, *long, last])
    assert h.main_text(f"<body><div class='x'><div class='lead'>{tag(lead)}</div><div class='text'>{tag(*long)}</div><div class='end'>{tag(last)}</div></div></body>") == whole
    assert h.main_text(f"<body><div class='lead'>{tag(lead)}</div><div class='text'>{tag(*long)}</div><div class='end'>{tag(last)}</div></body>") == whole
    page = f"<body><div class='x'><section><h2>One</h2>{tag(lead)}</section><section><h2>Two</h2>{tag(*long)}</section><h2>Three</h2><section>{tag(last)}<p>Short.</p></section></div></body>"
    assert h.main_text(page) == "\n\n".join(["One", lead, "Two", *long, "Three", last, "Short."])


def test_linked_items_of_the_article_stay():
    body = "".join(f"<p>{SENTENCE * 3}{k}</p>" for k in range(4))
    assert h.main_text(article(body + "<ul><li><a href='/s'>A source</a></li></ul>")).endswith("3\n\nA source")


def test_ratios_decide(monkeypatch):
    """Plain elements without any name: with one ratio for all paths the result is another."""
    items = "".join(f"<ul><li>Item {k}</li></ul>" for k in range(12))
    body = "".join(f"<p>{SENTENCE * 2}{k}</p>" for k in range(5))
    page = f"<body><div>{items}</div><div>{body}</div><div><span>All rights are ours</span></div></body>"
    assert h.main_text(page) == "\n\n".join(f"{SENTENCE * 2}{k}" for k in range(5))
    monkeypatch.setattr(h, "ratios", lambda blocks: [setattr(b, "ratio", 1.0) for b in blocks])
    assert "Item 3" in h.main_text(page)


def test_ratios_equal_brute_force():
    """Sums by path, smoothing and fusion, written out block by block."""
    page = "<body><div class='a'><p>One, two. <a href='#'>Three</a></p><p>Four five six.</p></div><ul><li>x</li><li>y, z</li></ul><div class='a'><p>Seven; eight!</p></div><h2>Nine</h2></body>"
    blocks = h.read(page).blocks
    paths = ["a/p", "a/p", "li", "li", "a/p", "h2"]
    assert [b.path == blocks[0].path for b in blocks] == [p == "a/p" for p in paths]
    mean = lambda values: [sum(v for q, v in zip(paths, values, strict=True) if q == p) / paths.count(p) for p in paths]
    text = mean([len(b.text) - b.linked for b in blocks])
    marks = mean([sum(c in ".,;!" for c in b.text) for b in blocks])

    def smooth(x, k):
        at = lambda i: x[max(0, min(len(x) - 1, i))]
        return 0.06 * at(k - 2) + 0.24 * at(k - 1) + 0.4 * at(k) + 0.24 * at(k + 1) + 0.06 * at(k + 2)

    expected = mean([(smooth(text, k) * text[k]) ** 0.5 * (0.1 + (smooth(marks, k) * marks[k]) ** 0.5) for k in range(len(blocks))])
    h.ratios(blocks)
    assert [b.ratio for b in blocks] == pytest.approx(expected)


@pytest.mark.parametrize(
    "inner",
    [
        "<section id='discussion'><p>{0}</p></section>", "<div class='side-effects'><p>{0}</p></div>", "<div class='legal-analysis'><p>{0}</p></div>", "<ul><li><a href='/a'>{0}</a></li></ul>",
        "<label>{0}</label>", "<blockquote><p>{0}</p><footer>Someone</footer></blockquote>", "<div class='article-header'><h2>{0}</h2></div>", "<table><tr><td>{0}</td><td>1</td></tr></table>", "<math><mi>{0}</mi></math>",
    ],
)
def test_content_of_the_article_stays(inner):
    body = "".join(f"<p>{SENTENCE}{k}</p>" for k in range(4))
    got = h.main_text(article(body + inner.format(SENTENCE * 2) + "<p>End.</p>"))
    assert (SENTENCE * 2).strip() in got and got.endswith("End.")
    assert ("Someone" in got) == ("Someone" in inner)


@pytest.mark.parametrize(
    "inner",
    [
        "<div class='comments'><p>{0}</p></div>", "<section id='comment-list'><article class='comment'><p>{0}</p></article></section>", "<div class='ad-banner'>{0}</div>", "<aside><p>{0}</p></aside>",
        "<form><p>{0}</p></form>", "<div class='cookieNotice'><p>{0}</p></div>", "<div role='complementary'>{0}</div>", "<nav>{0}</nav>", "<div class='share-buttons'>{0}</div>", "<footer>Tags</footer>",
    ],
)
def test_what_surrounds_an_article_goes(inner):
    body = "".join(f"<p>{SENTENCE}{k}</p>" for k in range(4))
    whole = "\n\n".join(f"{SENTENCE}{k}" for k in range(4))
    for page in (article(body + inner.format(SENTENCE * 2)), article(body, "{}" + inner.format(SENTENCE * 2)), f"<body><div class='x'>{body}</div>{inner.format(SENTENCE * 2)}</body>"):
        assert h.main_text(page) == whole


def test_short_article_before_a_long_footer():
    assert h.main_text(f"<article><p>Hi</p></article><footer>Long, long. Text; here: yes. {SENTENCE}</footer>") == "Hi"


def test_given_pages():
    """Every page of the small tables is its article element; read by plain cutting."""
    import html
    import re

    import pyarrow.parquet as pq

    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", inner)  # not every paragraph has an end tag
        expected = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert h.main_text(row["html"]) == "\n\n".join(e for e in expected if e)


@pytest.mark.parametrize("unit", ["<div>", "<div>x ", "<b>", "<b><h1>x</h1>", "<p><button><b><h2>y</h2>", "<li><span>x", "</p>", "<table><tr><td>x", "<div class='a'><p>x, y.</div></p>"])
def test_deep_markup_takes_linear_time(unit):
    import time

    began = time.time()
    h.main_text(unit * 50_000 + SENTENCE)
    assert time.time() - began < 20
