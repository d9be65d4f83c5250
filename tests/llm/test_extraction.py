"""Blocks of tag soup, the labeller's gradients and chunks, and its quality on pages it has not seen."""

import html

import numpy as np
import pytest
from raterscope.llm import extraction as x
from raterscope.llm import page_layouts
from raterscope.llm.html_blocks import Block, read_blocks

DATA = "/root/testdata/sf0.01"

CASES = [
    ("", []),
    ("plain", ["plain"]),
    ("<p>a < b &amp; c &lt;d&gt;", ["a < b & c <d>"]),
    ('<p title="a>b" class=\'x\'>y</p>', ["y"]),
    ('<p class=unc"lo>y', ["y"]),
    ("a<!-- x <p> -->b<!-- never closed", ["ab"]),
    ('a<script>var x="</p>"</SCRIPT >b<br>c<style>z', ["ab", "c"]),
    ("<p>a<p>b<li>c<li>d</ul>e</div>f", ["a", "b", "c", "d", "e", "f"]),
    ("&nbsp;a&nbsp;\n&#66;\t&#x43;&bogus; &copy;", ["a B C&bogus; ©"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>un<b>bro</b>k<i>en</i> <a href=x>li nk</a></p>", ["unbroken li nk"]),
    ("<title>no</title><svg><text>no</text></svg><noscript>no</noscript><template>no</template><button>no</button>yes", ["yes"]),
    ("<head><meta x><p>body", ["body"]),
    ("<!DOCTYPE html><?xml v?></><p/>x<br/>y", ["x", "y"]),
    ("<div" * 3, []),
    ("<custom-tag>in</custom-tag>line", ["inline"]),
]


@pytest.mark.parametrize("page, texts", CASES)
def test_blocks(page, texts):
    assert [b.text for b in read_blocks(page)] == texts


def test_paths():
    block, other = read_blocks('<main id="mainPart"><p class="lead big-text"><a href=x>link</a> rest</p></main><p>z')
    assert block.path == ("main", "p", "a") and block.tokens[:2] == (("main", "part"), ("lead", "big", "text"))
    assert block.linked == 4 and other.path == ("p",)


def test_very_deep_and_very_long():
    deep = read_blocks("<div>" * 50_000 + "x" + "</div>" * 50_000 + "y")
    assert [b.text for b in deep] == ["x", "y"] and len(deep[0].path) == 18
    assert len(read_blocks("<p>word</p>" * 30_000)) == 30_000


def test_gradients():
    rng = np.random.default_rng(1)
    one = x.Direction.drawn(rng)
    one.from_state[...] = rng.standard_normal(one.from_state.shape) * 0.3
    gates = rng.standard_normal((4, 2, 4 * x.HIDDEN)).astype(np.float32)
    aim = rng.standard_normal((4, 2, x.HIDDEN)).astype(np.float32)
    keep = []
    one.run(gates, x._start(2), keep)
    for table, grad in zip((gates, one.from_state), one.learn(keep, aim), strict=True):
        for _ in range(20):
            at = tuple(rng.integers(n) for n in table.shape)
            old, values = table[at], []
            for step in (1e-2, -1e-2):
                table[at] = old + step
                values.append(float((one.run(gates, x._start(2))[0].astype(float) * aim).sum()))
            table[at] = old
            assert abs((values[0] - values[1]) / 2e-2 - grad[at]) < 1e-2


@pytest.fixture(scope="module")
def model(spark):
    return x.train(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_chunks_agree(model, monkeypatch):
    pages = [read_blocks(f"<nav><a>m</a></nav><article>{'<p>Some words here.</p>' * n}</article><footer>f</footer>") for n in (1, 7, 40)]
    whole = model.label(pages)
    monkeypatch.setattr(x, "_BLOCKS", 16)
    for a, b in zip(whole, model.label(pages), strict=True):
        assert a.tolist() == b.tolist()
    assert x.Labeller.load(model.dump()).label(pages)[2].tolist() == whole[2].tolist()


def test_pages_that_name_their_article(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(600)
    right = total = 0
    for row in x.extract(pages.filter("page_id % 7 = 0 or page_id < 300"), model).join(pages.select("page_id", "html"), "page_id").collect():
        inside = row["html"].partition("<article>")[2].partition("</article>")[0]
        wanted = "\n".join(b.text for b in read_blocks(inside))
        right, total = right + (row["text"] == wanted), total + 1
        assert row["n_chars"] == len(row["text"])
    assert total > 300 and right >= 0.98 * total


def test_held_out_layouts(spark, model):
    words, sentences = page_layouts.material([r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()])
    drawn = [page_layouts.drawn_page(1_000_000 + i, words, sentences) for i in range(300)]
    drawn = [(blocks, told) for _, blocks, told in drawn if blocks]
    found = np.concatenate(model.label([b for b, _ in drawn]))
    truth = np.concatenate([np.array(t, bool) for _, t in drawn])
    precision, recall = (found & truth).sum() / found.sum(), (found & truth).sum() / truth.sum()
    assert precision > 0.95 and recall > 0.94


SITES = [
    (
        "<body><div class='top-bar'><a href=/>Site</a></div><ul class=menu><li><a href=/a>Home</a><li><a href=/b>News</a></ul>"
        "<div class=content><h1>A day at the river</h1><p>We went down to the river in the morning, and the water was low.</p>"
        "<p>By noon it had begun to rain; nobody minded.</p></div><div id=comments><h3>2 comments</h3><p>Nice story, thanks for sharing it!</p></div>"
        "<div class=footer>&copy; 2024 Site. All rights reserved.</div>",
        "A day at the river\nWe went down to the river in the morning, and the water was low.\nBy noon it had begun to rain; nobody minded.",
    ),
    (
        "<header><p>The Paper</p><nav><a href=1>World</a><a href=2>Sport</a></nav></header><main><article><h1>Council votes</h1>"
        "<p>The council voted on Tuesday to keep the old bridge open.</p><aside class=related><h4>Related articles</h4><a href=x>Bridge closed</a></aside>"
        "<p>Work will begin in spring.</p></article></main><aside class=sidebar><form><label>Email address</label></form></aside>"
        "<section class=comments><h2>Comments</h2><article class=comment><b>Ann</b><p>About time that they did this.</p></article></section><footer><p>Privacy policy</p></footer>",
        "Council votes\nThe council voted on Tuesday to keep the old bridge open.\nWork will begin in spring.",
    ),
]


@pytest.mark.parametrize("page, text", SITES)
def test_other_sites(model, page, text):
    blocks = read_blocks(page)
    assert x.main_text(blocks, model.label([blocks])[0]) == text


def test_awkward_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>text</p>"), (3, "u", "<nav>" + "<a>x</a>" * 20_000 + "</nav>"), (3, "u", "<script>"), (4, "u", " &#0; &#xD800; &#1114112;")]
    rows += [(5, "u", f"<article><p>{html.escape('a' * 400_000)}</p></article>")] * 2
    schema = "page_id long, url string, html string, text int, id string, n_chars string, page int, `a.b` int"
    table = spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], schema).repartition(3)
    found = sorted((r["page_id"] or 0, r["n_chars"]) for r in x.extract(table, model).collect())
    assert [i for i, _ in found] == [0, 1, 2, 3, 3, 4, 5, 5] and found[1][1] == found[2][1] == 0
    nothing = table.filter("false")
    assert x.extract(nothing, x.Labeller.drawn(1)).count() == 0


def test_a_table_without_pages_trains(spark):
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    small = x.Labeller.load(x.train_on([], drawn=20, epochs=1).dump())
    assert len(small.label([[Block("a", ("p",), ((),), 0)]])) == 1
    assert x.extract(nothing, small).count() == 0
