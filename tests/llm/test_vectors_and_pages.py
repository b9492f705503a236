from __future__ import annotations

import numpy as np
import pytest

from foliospark.llm import op1_vafile, op6_html
from foliospark.llm.html_blocks import blocks

from .pages import HELD_OUT, PAGES


def brute(vectors, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            out[i] = sorted(((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
    return out


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_top_k_equals_brute_force(spark, monkeypatch, dim):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op1_vafile, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(op1_vafile, "BLOCK", 16)
    monkeypatch.setattr(op1_vafile, "SLICE", 4)
    monkeypatch.setattr(op1_vafile, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim).round(1)]) for i in range(0, 900, 5)]
    rows += [(10_000, None), (10_100, []), (10_200, [None] * dim), (10_300, [float("nan")] * dim), (10_400, [float("inf")] * dim), (None, [1.0] * dim), (10_500, [0.5] * (dim + 1)), (7, [0.0] * dim), (8, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, 3, 9) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = {}
    for r in op1_vafile.top_k(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: [(n + 1, j, -s) for n, (s, j) in enumerate(best)] for q, best in brute(rows).items() if best}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_of_an_empty_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op1_vafile.top_k(df, F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_queries_and_vectors_are_ranked_each(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)]) for i in range(32)]
    rows = [rows[0], *rows[:16], rows[0], *rows[16:], *[(500 + i, [9.0] * 4) for i in range(40)], *[(77, [9.0] * 4)] * 12]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = op1_vafile.top_k(df, F.col("vec_id").isin(0, 77)).collect()
    found = {q: sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) for q in (0, 77)}
    vectors = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    for q, copies in ((0, 3), (77, 12)):
        x = next(v for i, v in vectors if i == q)
        best = sorted((-int(x @ v), i) for i, v in vectors if i != q)[:10]
        assert found[q] == sorted((n + 1, i, -s) for n, (s, i) in enumerate(best) for _ in range(copies))


@pytest.mark.parametrize("scale", [3000, 2**24])
def test_cells_never_understate(scale):
    rng = np.random.default_rng(0)
    x, q = rng.integers(-scale, scale, (500, 64)), rng.integers(-scale, scale, (20, 64))
    x[:250] = x[250:] * np.where(np.arange(64) % 2, 1, -1)  # sums that cancel out
    lower, upper = op1_vafile.Cells.of(x).bounds(q.astype(float))
    assert (lower <= q @ x.T).all() and (upper >= q @ x.T).all()


def test_few_exact_vectors_are_left_by_the_bounds():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(4000, 8)) * 1024).astype(np.int64)
    asked = op1_vafile.Asked(np.arange(20), np.arange(20), x[:20], 10)
    for i in range(0, 4000, 1000):
        asked.meet(np.arange(i, i + 1000), np.arange(i, i + 1000), np.zeros(1000, bool), op1_vafile.Cells.of(x[i : i + 1000]))
    row, node, _, upper = asked.left()
    assert len(row) < 20 * 400
    for q in range(20):
        score = x @ x[q]
        score[q] = -(2**60)
        assert {*np.argsort(-score)[:10].tolist()} <= {*node[row == q].tolist()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>A title &amp; more</h1><p><b>First   paragraph of this text, with some words in it.<br><p>Second one, which isn&#39;t short either; it goes on.</p></article>
<section class="comments"><div class="comment"><p>I do not agree, said the reader, at some length.</p></div></section>
<form><label>Name</label><textarea>typed</textarea></form><footer>&copy; site &middot; All of it.</footer>"""


def test_main_text_of_a_page(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "", "", 5), (4, "x", "<", 5), (5, "x", "<p title=\"unclosed>text", 5), (1, "u", PAGE, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = op6_html.extract(df).withColumn("n_chars", F.length("text").cast("long")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "A title & more First paragraph of this text, with some words in it. Second one, which isn't short either; it goes on."
    assert by[2] == by[3] == ""
    assert op6_html.extract(df.limit(0)).count() == 0


def test_blocks_of_broken_pages():
    assert [b.text for b in blocks("a<b>c</b>d<p>e<p>f<li>g<li>h<script>if (a<b) x('</p>')</script>i")] == ["acd", "e", "f", "g", "h", "i"]
    assert [b.text for b in blocks("<div>a<div>b</div>c</div><ul><li>x<ul><li>y</ul><li>z</ul>")] == ["a", "b", "c", "x", "y", "z"]
    assert [b.text for b in blocks("1 < 2 &lt;3 <!-- x")] == ["1 < 2 <3"]
    assert blocks("<p>" * 3000 + "x")[0].text == "x"
    for tag in "audio video object canvas svg select noscript template".split():
        assert [b.text for b in blocks(f"<p>a</p><{tag} id=x><p>after</p><{tag}>b")] == ["a", "after", "b"]
        assert [b.text for b in blocks(f"<p>a</p><{tag}>within</{tag}><p>after</p>")] == ["a", "after"]
    assert [b.text for b in blocks("<p>a</p><script>x <p>after</p>")] == ["a"]
    assert [b.text for b in blocks("<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p>")] == ["so a=1 holds"]
    assert blocks("<audio>" * 20_000 + "x")[0].text == "x"


@pytest.mark.parametrize("name", [*PAGES, *HELD_OUT])
def test_pages_written_by_hand(name):
    page, want = (PAGES | HELD_OUT)[name]
    got = op6_html.main_text(op6_html.trained(), page)
    assert got == " ".join(want.split())


def test_held_out_layouts():
    field, right, wrong, missed = op6_html.trained(), 0, 0, 0
    for page, said in op6_html.layouts(150, seed=77):
        found = blocks(page)
        got = [b.text for b, y in zip(found, field.decode(found)) if y]
        want = [" ".join(x.split()) for x in said]
        right, wrong, missed = right + len({*got} & {*want}), wrong + len({*got} - {*want}), missed + len({*want} - {*got})
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_viterbi_equals_enumeration():
    import itertools

    field = op6_html.trained()
    page = blocks(PAGE)[:9]

    def worth(labels):
        total = sum(field.score(b) for b, y in zip(page, labels) if y)
        for a, b, i, j in zip(page, page[1:], labels, labels[1:]):
            total += field.steps(op6_html.container(a) == op6_html.container(b))[i][j]
        return total

    best = max(itertools.product((0, 1), repeat=len(page)), key=worth)
    assert abs(worth(best) - worth(field.decode(page))) < 1e-9
