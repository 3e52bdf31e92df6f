import html
import random
import re
import time

import numpy as np
import pytest

from millrace.llm import html_blocks as hb

SMALL = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in hb.blocks_of(page)]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("<p>a &amp; b&nbsp;&#233;<p>c", ["a & b é", "c"]),
    ("<div>x<b>y</b> z<br>w</div>", ["xy z w"]), ("<script>if (a<b) '</p>'</script>t<style>p{}</style>", ["t"]),
    ("<script>never ends <p>x", []), ("a <!-- <p>no</p> --> b", ["a b"]), ("<!-- open", []), ("1 < 2 and <p title='a>b'>c", ["1 < 2 and", "c"]),
    ("<p class=\"broken>text</p><p>more", ["text", "more"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("</p></div>x</b>", ["x"]), ("<p><b>t<br><p>u", ["t", "u"]), ("<h1>&lt;b&gt;</h1>", ["<b>"]), ("<" * 50, ["<" * 50]),
])
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("unit, tail", [
    ("<a ", ""), ("<div>x", ""), ("<a \">\"", "'"), ("<b>x<i>y", "</u>" * 50_000), ("<u><div><b>", "</u>" * 100_000), ("<a '\">", "'"),
    ("<p class='", ">"), ("<!-- ", ""), ("</div>", ""), ("<span>a</span> ", ""), ("<script>", ""), ("<li>x", ""), ("<p title=\"<a '\">x", "\""),
])
def test_a_megabyte_of_anything_is_read_in_seconds(unit, tail):
    page = unit * (1_000_000 // len(unit)) + tail
    start = time.time()
    blocks = hb.blocks_of(page)
    assert hb.teacher(blocks).sum() >= 0 and len(hb.Features()([blocks])[0]) == len(blocks)
    assert time.time() - start < 10


def test_paths_follow_omitted_tags():
    blocks = hb.blocks_of("<body><ul><li><b>a<li>b</ul><p><i>c<div class='ad Box'>d</div>")
    assert [b.path for b in blocks] == [("body", "ul", "li", "b"), ("body", "ul", "li"), ("body", "p", "i"), ("body", "div.ad.box")]


@pytest.fixture(scope="module")
def model(spark):
    return hb.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_whole_table(spark, model):
    """The article of a page, read with one pattern: another way than blocks and labels."""
    rows = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in hb.main_text(rows, model).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]].split("\n") == [p for p in parts if p]


def test_composed_pages_not_seen_before(model):
    rng = np.random.default_rng(12345)
    said = [" ".join(random.Random(k).choices("ab cde fgh ijkl mno".split(), k=k % 40 + 1)) for k in range(200)]
    pages = [hb.blocks_of(hb._composed(said, rng)) for _ in range(200)]
    x, sizes = hb.Features()(pages)
    assert (model.labels(x, sizes) == (np.concatenate([hb.teacher(p) for p in pages]) > 0)).mean() > 0.97


def test_batches_do_not_matter(model):
    """Labels of a page are the same alone and among others."""
    pages = [hb.blocks_of("<nav>a</nav><article><p>b</p></article>"), hb.blocks_of("<p>x</p>" * 40), [], hb.blocks_of("<main><h1>q</h1></main><footer>f</footer>")]
    features = hb.Features()
    together = model.logits(*features(pages))
    apart = np.concatenate([model.logits(*features([p])) for p in pages if p])
    assert np.allclose(together, apart, atol=1e-4)


def test_gradient():
    """Backward of a direction against differences."""
    rng = np.random.default_rng(0)
    d = hb.Direction(rng)
    sizes = np.array([3, 5, 1])
    x = rng.normal(size=(9, hb.INPUT)).astype(np.float32)
    x[:, 20:] = 0
    goal = rng.normal(size=(9, hb.HIDDEN)).astype(np.float32)
    rows = hb._rows(sizes, True)
    d.forward(x, rows, keep=True)
    dw, du = d.backward(x, goal)
    for w, g, at in ((d.w, dw, (3, 7)), (d.u, du, (2, 33))):
        old, e = w[at], 1e-2
        w[at] = old + e
        up = (d.forward(x, rows) * goal).sum()
        w[at] = old - e
        down = (d.forward(x, rows) * goal).sum()
        w[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_rows(spark, model):
    schema = "page_id long, url string, html string, text int"
    rows = [(1, None, None, 5), (2, "u", "", 5), (2, "u", "", 5), (3, "u", "<article><p>" + "long words " * 20_000 + "</p></article>", 5), (None, None, "<nav><a href=x>menu</a></nav><article><h1>Head</h1><p>Body text of some length here.</p></article>", 5)]
    got = hb.main_text(spark.createDataFrame(rows, schema), model)
    found = {r["page_id"]: r["text"] for r in got.collect()}
    assert found[1] == "" and found[2] == "" and len(found[3]) == 219_999 and found[None] == "Head\nBody text of some length here."
    assert hb.main_text(spark.createDataFrame([], schema), model).count() == 0
    assert len(hb.fit(spark.createDataFrame([], schema)).labels(np.zeros((1, hb.INPUT), np.float32), np.array([1]))) == 1


def right(model, page):
    """Share of a page's blocks labelled as the teacher does."""
    blocks = hb.blocks_of(page)
    return (model.labels(*hb.Features()([blocks])) == (hb.teacher(blocks) > 0)).mean()


PAGE = "<nav><a href=x>menu</a></nav><article><h1>Head</h1>{}</article><footer><p>Foot</p></footer>"


def test_sample_of_copies_of_one_page(spark, monkeypatch):
    """200 000 rows of three pages: all three are taught, however rare among the rows."""
    taught = []
    monkeypatch.setattr(hb.Labeller, "fit", lambda self, pages: taught.extend(pages) or self)
    monkeypatch.setattr(hb, "SAMPLE_PAGES", 3)
    three = "concat('<article><p>page ', id % 3, '</p></article>') AS html"
    hb.fit(spark.range(200_000).selectExpr(three))
    assert len(taught) == 6


def test_long_pages_are_taught_if_none_is_short(spark):
    page = PAGE.format("<p>A paragraph of the text.</p>" * 8000)
    assert len(page) > hb.SAMPLE_CHARS
    model = hb.fit(spark.createDataFrame([(page,)], "html string"))
    assert right(model, page) > 0.99


def test_a_table_without_text_teaches_from_composed_pages(spark):
    page = PAGE.format("<p>A paragraph of the text.</p>" * 9)
    for rows in ([], [("",)], [("<p></p>",)]):
        assert right(hb.fit(spark.createDataFrame(rows, "html string")), page) > 0.9
