"""The learned block classifier, and what the cut adds to it on pages whose markup names nothing."""

import random

import numpy as np

from lodestone.llm import html_extract as H


def page(draw, named):
    """A menu, a notice, an article of long, short and very short paragraphs, and a footer; unless ``named``, all of them are plain divisions."""
    words = lambda a, b: " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(draw.randint(a, b)))
    outer = (lambda t, x: f"<{t}>{x}</{t}>") if named else (lambda t, x: f"<div>{x}</div>")
    menu = "<ul>" + "".join(f"<li><p>{words(1, 2)}</p></li>" if i % 3 == 1 else f"<li><a href=/{i}>{words(1, 2)}</a></li>" for i in range(9)) + "</ul>"
    parts = [f"<h1>{words(4, 8)}</h1>"] + [f"<p>{words(1, 2) if draw.random() < 0.2 else words(15, 60) + '.'}</p>" for _ in range(draw.randint(4, 9))]
    article = outer("article", "".join(parts))
    return f"<body>{outer('nav', menu)}{article}{outer('footer', words(2, 4) + ' <a href=/>' + words(2, 4) + '</a>')}</body>", len(parts)


def examples(seed, n, named):
    draw = random.Random(seed)
    for _ in range(n):
        html, inside = page(draw, named)
        found = H.blocks(html)
        yield found, [9 <= i < 9 + inside for i in range(len(found))]


def learned(columns):
    """Weights from pages that name their parts, without the features of names and those not in ``columns``."""
    x, y = [], []
    for found, truth in examples(1, 200, True):
        assert [b.marked for b in found] == truth
        x += H.features(found)
        y += truth
    x = np.array(x, float)
    x[:, [i for i, c in enumerate(H.PRIOR) if c not in columns]] = 0
    return H.fitted(x, np.array(y, float))


def test_cut_beats_thresholds_where_markup_names_nothing():
    weights = learned([c for c in H.PRIOR if "name" not in c and c != "kin"])
    weights[list(H.PRIOR).index("kin")] = 0.0
    wrong = {"cut": 0, "threshold": 0}
    for found, truth in examples(2, 200, False):
        wrong["cut"] += sum(a != b for a, b in zip(H.labels(found, weights), truth))
        wrong["threshold"] += sum((a > 0) != b for a, b in zip(H.scores(found, weights), truth))
    assert wrong["cut"] < 0.7 * wrong["threshold"]


def test_all_features():
    weights = learned([c for c in H.PRIOR if "name" not in c])
    right = [a == b for found, truth in examples(3, 200, False) for a, b in zip(H.labels(found, weights), truth)]
    assert sum(right) > 0.97 * len(right)


def test_fit_without_examples_is_the_prior():
    assert H.fitted(np.zeros((0, len(H.PRIOR))), np.zeros(0)) == list(H.PRIOR.values())


def test_train(spark):
    draw = random.Random(5)
    table = [(i, "u", page(draw, i % 2 == 0)[0]) for i in range(40)] + [(None, None, None), (3, "u", "")]
    pages = spark.createDataFrame(table, "page_id bigint, url string, html string")
    weights = H.train(pages)
    assert weights == H.train(pages.repartition(3)) and len(weights) == len(H.PRIOR)
    got = {r.page_id: r.text for r in H.extract(pages).collect() if r.page_id is not None}
    assert got[0] == H.main_text(table[0][2], weights) and len(got[0]) > 50
    assert H.train(pages.filter("page_id % 2 = 1")) == list(H.PRIOR.values())
