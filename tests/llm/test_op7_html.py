import random

import numpy as np

from rasterloom.llm import op7_html as op7
from rasterloom.llm.html_blocks import blocks, random_page

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body><script>var t="</p>";</script>
<header class="site-header"><a href="/">My site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
<!-- <p>no</p> --><div class="cookie-notice">We use cookies. <button>Accept</button></div>
<article><h1>Caf&eacute; &amp; more</h1><p><b>First   part<br>of it.<p>Second &lt;b&gt; one has some more words in it.</p><ul><li>an item<li>another</ul><div class="ad">Buy now at the shop</div><p>Last one with a <a href="x">link</a>.</p></article>
<aside class="sidebar"><h3>Related</h3><a href="/z">Other story</a></aside>
<section id="comments"><p>Great article, thanks!</p></section><form><input name="q"><label>Search</label></form>
<footer>&copy; 2024 My site</footer></body></html>"""


def test_blocks_of_a_page():
    assert [b.text for b in blocks(PAGE)] == ["My site", "Home", "About", "We use cookies.", "Café & more", "First part of it.", "Second <b> one has some more words in it.", "an item", "another", "Buy now at the shop", "Last one with a link.", "Related Other story"[:7], "Other story", "Great article, thanks!", "Search", "© 2024 My site"]
    assert blocks(None) == blocks("") == blocks("<p> <br> </p>") == []
    assert [b.text for b in blocks("a <b>c</b> &#65;<p title='x>y'>d</p>< e <script>z")] == ["a c A", "d", "< e"]
    assert len(blocks("<p>" * 3000 + "x")) == 1


def test_gradient_against_differences():
    m = op7.Labeller()
    r = random.Random(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    pages = [op7.encoded(blocks(random_page(r)[0]))[:k] for k in (4, 7)]
    truth = np.array([[r.random() < 0.5 for _ in pages] for _ in range(7)], float)
    score, kept = m.forward(pages)
    mask = kept[1][:, :, 0]

    def loss():
        s = m.forward(pages)[0]
        return ((np.logaddexp(0, s) - truth * s) * mask).sum() / mask.sum()

    g = m.gradient(score, truth, kept)
    for k in ("w", "c", "Wf", "Wr", "Uf", "Ur", "bf", "br", "N", "V"):
        flat = m.p[k].reshape(-1)
        for at in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            old = flat[at]
            flat[at] = old + 1e-2
            hi = loss()
            flat[at] = old - 1e-2
            lo = loss()
            flat[at] = old
            assert abs((hi - lo) / 2e-2 - g[k].reshape(-1)[at]) < 1e-3, k


def test_held_out_accuracy():
    m = op7.trained()
    r = random.Random(12345)
    right = total = 0
    for _ in range(200):
        html, labels = random_page(r)
        got = m([blocks(html)])[0]
        right, total = right + int((got == np.array(labels)).sum()), total + len(labels)
    assert right / total > 0.99
    page = blocks(PAGE)
    assert [b.text for b, y in zip(page, m([page])[0], strict=True) if y] == ["Café & more", "First part of it.", "Second <b> one has some more words in it.", "an item", "another", "Last one with a link."]


def test_query(spark, tmp_path):
    long = "<body><article>" + "<p>words of the text go on here and there.</p>" * 3000 + "</article><footer>© us</footer></body>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", long), (None, "x", "<nav><a>home</a></nav>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as text", "1 as n_chars").write.parquet(str(tmp_path / "pages.parquet"))
    out = op7.op7_html(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)
    got = {x.page_id: x.text for x in out}
    assert got[2] == got[3] == "" and got[4].count("\n\n") == 2999 and got[1].startswith("Café & more\n\nFirst part of it.")
    assert op7.main_text(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


def test_silent_elements_end_where_they_should():
    after = "<p>The text</p><p>goes on</p>"
    for before in ('<svg class="icon"/>', '<svg title="a > b" />', "<svg><path d='x'/>no</svg>", "<title-bar>", "<template-x>", "<button-group></button-group>", "<datalist><option value=a><option value=b>no</datalist>", "<datalist><optgroup><option>no<optgroup><option>no<i>no</datalist>", "<div><option>no</div>", "<option>no</option>", "<select><option>no<option>no</select>"):
        assert [b.text for b in blocks(before + after)] == ["The text", "goes on"], before
    assert [b.text for b in blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>")] == ["so x=2 holds"]
    assert [b.text for b in blocks("<p>a</p><svg/><p>b</p><svg>no</svg><p>c <svg/>d</p>")] == ["a", "b", "c d"]
