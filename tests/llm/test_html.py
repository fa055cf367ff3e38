"""Main texts: the trained classifier, the minimum cut over it, and pages beyond all bounds."""

import itertools
import time
import tracemalloc

import numpy as np
import pytest

from unskew.llm import html


def truth(page):
    import html as h
    import re

    inner = page.split("<article>")[1].split("</article>")[0]
    parts = (" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
    return {b for b in parts if b}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def plain_cut(z, joined):
    """All labellings, one by one."""
    cost = lambda l: sum(max(0, -v) if k else max(0, v) for v, k in zip(z, l, strict=True)) + sum(c for i, j, c in joined if l[i] != l[j])  # noqa: E731, E741
    return min(itertools.product([True, False], repeat=len(z)), key=cost)


def test_query_matches_exhaustive_labelling_of_small_pages(spark, pages):
    model = html.fit(pages, most=50)
    made = []
    for k, (page, _, bare) in enumerate(html.made_pages(200, 5)):
        found, elements = html.scan(page, bare)
        if not bare and len(found) <= 14:
            z = model.odds(html.features(found, elements)).tolist()
            label = plain_cut(z, [(i, j, float(model.capacity[kind])) for i, j, kind in html.edges(found)])
            made.append((k, page, "\n\n".join(b.text for b, keep in zip(found, label, strict=True) if keep)))
    assert len(made) >= 20
    df = spark.createDataFrame([(k, "u", p) for k, p, _ in made], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df, model).collect()}
    assert got == {k: t for k, _, t in made}


def test_pages_without_names(spark, pages):
    """Held-out pages of the table as if they had neither telling tags nor classes."""
    rows = [r["html"] for r in pages.collect()]
    model = html.train(html._made_seen() + [x for p in rows[:120] for x in html._labelled(p)])
    hit = said = true = 0
    for page in rows[120:]:
        found, elements = html.scan(page, bare=True)
        want = truth(page)
        y = np.array([b.text in want for b in found])
        label = np.array(model.labels(html.features(found, elements), html.edges(found)))
        hit, said, true = hit + (label & y).sum(), said + label.sum(), true + y.sum()
    assert hit >= 0.97 * said and hit >= 0.97 * true


def test_cut_decides_and_is_better_than_the_odds_alone():
    model, changed, odds_wrong, cut_wrong = html.made_model(), 0, 0, 0
    for page, texts, _ in html.made_pages(400, 77):  # other pages than those of the training
        x, joined, y = html.seen(page, True, lambda b, texts=texts: b.text in texts)
        label, alone = np.array(model.labels(x, joined)), model.odds(x) > 0
        changed += (label != alone).sum()
        odds_wrong, cut_wrong = odds_wrong + (alone != y).sum(), cut_wrong + (label != y).sum()
    assert changed > 10 and cut_wrong < odds_wrong


@pytest.mark.parametrize("page", ["<div>some text here. " * 200_000, "<font class=x>" * 100_000 + "text<hr>" * 100_000, "<p><div>" + "<b id=a>" * 50_000 + "<hr>a" * 50_000, "<li>x<ul>" * 50_000, "</div>" * 300_000])
def test_deep_pages_stay_linear(page):
    html.made_model()
    began = time.perf_counter()
    found, elements = html.scan(page)
    model = html.made_model()
    if found:
        model.labels(html.features(found, elements), html.edges(found))
    assert time.perf_counter() - began < 60


def test_memory_of_a_deep_page():
    tracemalloc.start()
    html.main_text("<div>some text here. " * 20_000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_fit_of_nothing_is_the_made_model(spark, pages):
    nothing = html.fit(pages.limit(0))
    assert np.array_equal(nothing.weights, html.made_model().weights)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "<article></article>"), (2, "<main>a</main><main>b</main>")], "page_id long, html string")
    assert np.array_equal(html.fit(odd).weights, html.made_model().weights)


def test_formulas_headlines_and_hidden_text_of_an_article_stay(spark):
    body = "".join(f"<p>Paragraph {i} of the article tells, in some length, what the river did in that year, and why.</p>" for i in range(6))
    made = [
        (1, f"<body><div class='site-header'><a href='/'>Home</a></div><article><div class='post-header'><h1>River</h1></div>{body}</article></body>"),
        (2, f"<body><article><h1>Sums</h1><p>The formula is <math>x = 2</math> as one may see from what was said above, at length.</p>{body}</article></body>"),
        (3, f"<body><article><h1>Tide</h1>{body}<p hidden>This paragraph of the article is hidden, but it is text of the article all the same.</p><p style='display:none'>And so is this one, which tells, in some length, what came of it.</p></article></body>"),
    ]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(i, "u", t) for i, t in made], "page_id long, url string, html string")).collect()}
    assert got[1].startswith("River\n\nParagraph 0") and "Home" not in got[1]
    assert "The formula is x = 2 as one may see" in got[2]
    assert "This paragraph of the article is hidden" in got[3] and got[3].endswith("what came of it.")
