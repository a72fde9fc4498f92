import os
import re
import subprocess
import sys
from html import unescape

import numpy as np

from gaugework.llm import html_blocks, html_extraction, html_model, html_pages

SCHEMA = "page_id long, url string, html string, text int"


def brute(html):
    """The article's blocks of the given pages, which mark it with its own element."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", html or "", re.DOTALL)
    parts = re.split(r"</?(?:p|h1|article|footer)>", re.sub(r"<[^>]*\Z", "", m[1]) if m else "")
    clean = (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts)
    return "\n".join(x for x in clean if x)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = html_extraction.extract_text(pages).collect()
    assert len(got) == len(want)
    wrong = [r.page_id for r in got if r.text != want[r.page_id]]
    assert len(wrong) <= 0.01 * len(got), wrong
    assert all(r.n_chars == len(r.text) for r in got)


def test_blocks():
    page = """<body class="a B-2"><p>one <b>two<br>three<p>f&ouml;ur &amp five&nbsp;six &#x41;</p><!-- <p>no --><script>var t="</p>";</script>
    <ul><li>x<li><a href="a>b">y</a></ul><div id='it'>z</div>tail <em"""
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["one two three", "föur & five six A", "x", "y", "z", "tail"]
    assert [b.linked for b in found] == [0, 0, 0, 1, 0, 0]
    assert (found[4].inside.label, found[4].inside.depth) == ("div it", 2) and (found[1].inside.label, found[1].inside.depth) == ("p", 2)
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<script>only") == []


def test_made_pages_and_training():
    tests = [html_pages.labelled(k) for k in range(50_000, 50_150)]
    got = html_model.Labeller.load().main_blocks([p for p, _ in tests])
    right = [a == b for g, (_, y) in zip(got, tests, strict=True) for a, b in zip(g, y, strict=True)]
    assert np.mean(right) > 0.99
    small = html_model.Labeller.fresh().fit([html_pages.labelled(k) for k in range(900)], rounds=5)
    again = small.main_blocks([p for p, _ in tests])
    assert np.mean([a == b for g, (_, y) in zip(again, tests, strict=True) for a, b in zip(g, y, strict=True)]) > 0.95


def test_gradients():
    model, (page, y) = html_model.Labeller.fresh(), html_pages.labelled(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = model.padded([html_model.features(page), html_model.features(page[:3])])
    loss = lambda: float((model.forward(x, mask)[0] * mask).sum())
    grad = model.backward(x, mask, model.forward(x, mask)[1], mask)
    for k, at in (("wf", (5, 30)), ("ub", (3, 50)), ("ep", (int(np.flatnonzero(x[0, 0, : html_model.PATHS])[0]), 2)), ("bb", (7,)), ("o", (30, 0))):
        old = model.w[k][at]
        model.w[k][at] = old + 1e-3
        up = loss()
        model.w[k][at] = old - 1e-3
        down = loss()
        model.w[k][at] = old
        assert abs((up - down) / 2e-3 - grad[k][at]) < 1e-3 * max(1, abs(grad[k][at])) + 2e-3


def test_edges(spark):
    rows = [
        (1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (3, "u", "<<<>< & <p", 1),
        (4, "u", "<article>" + "<p>" + "word " * 40_000 + "</p></article>", 1), (None, "u", "<nav><a>x</a></nav>", 1)
    ]
    got = {(r.page_id, r.url): r for r in html_extraction.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5 and got[1, "u"].text == got[2, None].text == "" and got[4, "u"].n_chars == 199_999
    assert html_extraction.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_and_long_pages():
    """Time and memory go with a page's size, not with its depth: in a process of its own, for its peak."""
    code = (
        "import resource, time; from gaugework.llm.html_extraction import main_texts\n"
        "main_texts(['<p>x</p>'])\n"
        "for page in ('<div>a ' * 50_000, '<p>word two</p>' * 200_000, '<head><template>' * 20_000, '<p>x<b>' * 30_000):\n"
        "    began = time.process_time(); main_texts([page])\n"
        "    print(time.process_time() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    out = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, check=True,
        env=os.environ | {"OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}
    ).stdout
    rows = [tuple(map(float, line.split())) for line in out.splitlines()]
    assert len(rows) == 4 and all(s < 30 and mb < 500 for s, mb in rows), rows


def test_labelling_equals_training_path():
    """The forward pass by embedded rows, without padding's mask, against the one that training uses."""
    model, pages = html_model.Labeller.load(), [html_pages.labelled(k)[0] for k in range(60_000, 60_020)]
    dense, _ = model.forward(*model.padded([html_model.features(p) for p in pages]))
    for own, want in zip(model.odds([model.embedded(p) for p in pages], chunk=7), dense, strict=True):
        assert np.allclose(own, want[: len(own)], atol=1e-3)


def test_other_markup_of_the_same_pages(spark):
    """Wrappers of any number around the article's or the body's parts, plain or with words never met, and other elements in
    the article's place: the same texts."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    base = html_extraction.main_texts(pages)

    def inside(tag, start, end):
        return [p.replace(f"<{tag}>", f"<{tag}>{start}").replace(f"</{tag}>", f"{end}</{tag}>") for p in pages]

    for n in (1, 5, 20, 70):
        for tag in ("article", "body"):
            assert html_extraction.main_texts(inside(tag, "<div>" * n, "</div>" * n)) == base, (tag, n)
    others = [inside(tag, f'<div class="{c}">', "</div>") for tag in ("article", "body") for c in ("row", "zzqx-inner", "k9")]
    others += [[p.replace("<article>", f"<{new}>").replace("</article>", f"</{new.split()[0]}>") for p in pages] for new in ("main", "div class=qqpost")]
    for made in others:
        assert sum(a != b for a, b in zip(html_extraction.main_texts(made), base, strict=True)) <= 0.02 * len(pages)


def test_a_path_has_no_end():
    deep = html_blocks.blocks("<nav>" + "<section><b>" * 500 + "<p>x")[-1].inside
    near = html_blocks.blocks("<nav><section><b><section><b><p>x")[-1].inside
    assert deep.mask == near.mask and deep.depth > 1000
