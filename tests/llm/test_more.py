"""Operators 2, 5, 6, 7 and 8 on odd rows, and 6 against brute force."""

import math
from collections import Counter

import pytest

from plumbline.llm import queries as Q

from .helpers import key, odd_docs, write_tables


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    pages = spark.createDataFrame([(1, None, None), (2, "x", "<p>a<p>b &amp; c</p><nav>no</nav>"), (None, "http://h/", "<article><b>t\n<br>u</article")], "page_id long, url string, html string")
    vectors = [(i, [math.sin(i), math.cos(i), 1.0]) for i in range(120)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [1.0]), (None, [1.0, 2.0, 3.0])]
    vectors += [(300 + i, [1.0, 1.0, 1.0]) for i in range(40)]
    return write_tables(spark, tmp_path_factory.mktemp("more") / "t", odd_docs(spark), pages, spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))


def test_jaccard(spark, odd_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        want.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    assert key(tuple(r) for r in Q.op6_ngram_jaccard(spark, odd_dir).collect()) == key(want)


def test_lm_and_mixing(spark, odd_dir):
    n = spark.read.parquet(f"{odd_dir}/documents.parquet").count()
    rows = Q.op2_lm_scoring(spark, odd_dir).collect()
    assert len(rows) == n and all(r.score <= 1e-6 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in rows)
    assert Q.op5_mixing(spark, odd_dir).count() == n


def test_html(spark, odd_dir):
    got = {r.page_id: (r.text, r.n_chars) for r in Q.op7_html_extraction(spark, odd_dir).collect()}
    assert got[1] == ("", 0) and got[2] == ("a\nb & c", 7)


def test_ann(spark, odd_dir):
    rows = Q.op8_ann(spark, odd_dir).collect()
    assert Counter(r.query_id for r in rows) == {0: 5, 50: 5, 100: 5, 300: 5}
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 300] == [301, 302, 303, 304, 305]
