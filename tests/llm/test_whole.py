"""Operators do the whole job: what an earlier cut of each left out."""

import math
import re
import zlib
from collections import Counter
from re import _parser

import numpy as np

from plumbline.llm import ann, html, licenses, lm, mixing


def shortest(pattern):
    """A text that the pattern matches: options left out, the first of alternatives."""
    out = []
    for op, arg in pattern if isinstance(pattern, _parser.SubPattern) else _parser.parse(pattern):
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            out.append(chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0]))
        elif name == "MAX_REPEAT":
            out.append(shortest(arg[2]) * arg[0])
        elif name == "BRANCH":
            out.append(shortest(arg[1][0]))
        else:
            out.append(shortest(arg[-1]))
    return "".join(out)


def test_every_license_rule_is_reached(spark):
    rules = licenses.rules()
    texts = [shortest(r.pattern) for r in rules]
    got = {r.i: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    for i, (rule, text) in enumerate(zip(rules, texts)):
        may = {q.label for q in rules if q.priority >= rule.priority and re.fullmatch(q.pattern, text)}
        assert rule.label in may and may & set(got[i].labels.split(",")) and got[i].score > 0, (rule, text)


def test_license_texts_without_the_word(spark):
    texts = {
        "you can redistribute it under the same terms as Perl itself": "Perl",
        "released under the 3-clause BSD": "BSD-3-Clause",
        "the new BSD": "BSD-3-Clause",
        "2-clause BSD": "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "for non-commercial use only": "noncommercial",
        "nothing of the kind": "",
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumnRenamed("text", "said").selectExpr("said", "said AS text")
    assert {r.said: r.labels for r in licenses.scan(docs).collect()} == texts


def clustered(n_alone=300, seed=2):
    """Vectors of 64 dimensions: tight clusters, and vectors far from all others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(80, 64))
    near = (centres[:, None] + 0.05 * rng.normal(size=(80, 250, 64))).reshape(-1, 64)
    return np.concatenate([near, rng.normal(size=(n_alone, 64))])


def test_every_ann_query_has_its_neighbours(spark):
    x = clustered()
    # queries are the vectors that stand alone, and some of the clusters'
    ids = [50 * i for i in range(len(x) - 300, len(x))]
    rows = [((i * 50) if i >= len(x) - 300 or i % 400 == 0 else i * 50 + 1, v.tolist()) for i, v in enumerate(x)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    n = Counter(r.query_id for r in found)
    assert set(ids) <= set(n) and set(n.values()) == {5}


def test_walk_goes_on_until_leaves_hold_enough():
    x = clustered()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ann.Tree(x, 256)
    sizes = np.bincount(tree.leaf_of(x), minlength=tree.n_leaves)
    sizes[sizes > 0] = np.where(np.arange((sizes > 0).sum()) % 2, 1, 2)  # leaves that hold next to nothing
    for q in x[-300:]:
        few, more = tree.visit(q, 1), tree.visit(q, 1, sizes, 6)
        assert more[:1] == few and sizes[more].sum() >= 6 > sizes[more[:-1]].sum()
    assert sorted(tree.visit(x[0], 1, sizes, 1 << 40)) == list(range(tree.n_leaves))


def test_mixing_by_tables_is_mixing_on_the_driver(spark):
    # nearly all sources of one language each: targets are met slowly
    rows = [(i, "a " * n, s, g) for i, (s, g, n) in enumerate([("p", "en", 900), ("p", "de", 1), ("q", "de", 500), ("q", "en", 1), ("r", "de", 40), ("r", "en", 2)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"p": 0.2, "q": 0.5, "r": 0.3}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 1.0}}
    few, many = ({r.doc_id: (r.probability, r.selected) for r in mixing.mix(docs, budget_share=0.002, targets=targets, max_cells=m).collect()} for m in (200_000, 0))
    assert few.keys() == many.keys()
    for k, (p, chosen) in few.items():
        assert abs(p - many[k][0]) <= 1e-7 * p and chosen == many[k][1], (k, p, many[k])


def test_article_text_is_kept():
    a, b = "One sentence of the article. " * 9, "Another part of what it says. " * 4
    best = lambda page: html.extract(page, None).split("\n")
    for name in ("layout sidebar-right", "page two-column sidebar"):
        assert best(f"<body><div class='{name}'><h1>T</h1><p>{a}<p>{b}</div><nav>no</nav>") == ["T", a.strip(), b.strip()]
    for part in ("<section id='discussion'>", "<div class='social-policy'>"):
        assert b.strip() in best(f"<article><h1>T</h1><p>{a}{part}<p>{b}</article>")
    assert b.strip() in best(f"<article><p>{a}<p class='notice'>{b}</p></article>")
    assert best(f"<div class='x'><h1>T</h1><div class='content'><p>{a}</div></div>") == ["T", a.strip()]
    # the host's path covers a small box of this page
    page = f"<div class='box'><p>short</div><div class='other'><p>{a}<p>{b}</div>"
    assert html.extract(page, "div.box").split("\n") == [a.strip(), b.strip()]


def test_noise_is_still_dropped():
    a, c = "One sentence of the article. " * 9, "What a reader wrote below it. " * 20
    page = f"<body><article><h1>T</h1><p>{a}</article><div class='comments'><p>{c}</div><div class='social'><a>f</a></div><p class='notice'>n</p>"
    assert html.extract(page, None).split("\n") == ["T", a.strip()]


def test_lm_base_columns(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in t)
    n = sum(c.values())
    want = {i: (held[i], len(t), sum(w in c for w in t), n, sum(math.log10(c[w] + 1) for w in t) - len(t) * math.log10(n + len(c) + 1)) for i, t in rows}
    # few frequent words, so that the others are joined with their counts
    got = lm.score(spark.read.parquet(f"{sf}/documents.parquet"), n_frequent=500, longest=6).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9, abs_tol=1e-6)


def test_lm_probabilities_and_held_out_gain(spark, sf):
    """Probabilities sum to one after any two classes, and held-out texts score better than by word counts alone."""
    model = lm.LogBilinear(np.array([50.0, 30, 10, 5, 3, 2]), dim=8)
    cycle = np.array([[i % 6, (i + 1) % 6, (i + 2) % 6] for i in range(6000)], dtype=np.int32)
    assert model.learn(iter([cycle] * 4), 0.1, 0.5, 3) == 12000
    left, right, pair = model.tables()
    p = np.exp(left[:, None, :] + right[None, :, :] - pair[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)
    assert all(p[a, b, w] > 0.8 for a, b, w in cycle[:6])
    assert lm.n_classes_of(34_000) < lm.n_classes_of(340_000) < lm.n_classes_of(3_400_000)
    held = [r for r in lm.score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) > 0.05 * tokens


def test_lm_empty_tables_and_nothing_to_train_on(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, word string, c long")).collect() == []
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score(spark.createDataFrame([(held, "a b c", 1, 2)], "doc_id long, text string, c long, n long")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0) and math.isfinite(r.score)


def test_ann_recall_over_several_leaves(spark):
    x = np.random.default_rng(4).normal(size=(4000, 16)).astype(np.float32)
    found = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(80), np.arange(0, 4000, 50)] = -2
    true = {(50 * i, int(j)) for i, row in enumerate(near) for j in np.argsort(-row)[:5]}
    assert len(found) == len(true) and len(true & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(true)
