"""The pipeline's stages on a small table, each against plain Python on its own input."""

import random

import pytest

import corpus_pipeline as pipeline
from plumbline.llm import quality, secrets, store

from .helpers import odd_docs
from .test_families import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(900)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(90)]
        rows.append(" ".join(w))
        if i % 4 == 0:  # an exact copy, and one word changed in 90
            rows.append(rows[-1])
            rows.append(" ".join(w[:45] + ["changed"] + w[46:]))
        if i % 10 == 3:
            rows[-1] += " password = hunter2secret and AKIA" + "Z" * 20
    rows += ["too short", "", None, " ".join(["again and again"] * 60)]
    return spark.createDataFrame([(i, t, rng.choice(["en", "de"]), "src0" if i % 3 else "src1", None if t is None else len(t)) for i, t in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """(name, input, output) of every stage, written between stages as run() does."""
    sf = tmp_path_factory.mktemp("corpus")
    corpus(spark).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        done = store.materialize(stage(spark, docs, str(sf)), f"test-{name}")
        out.append((name, docs, done))
        docs = done
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(staged):
    name, docs, out = staged[0]
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert name == "quality_rules" and set(rows(out)) == kept and out.columns == pipeline.COLUMNS
    text = {i: (r.text or "").split() for i, r in rows(docs).items()}
    assert all(i in kept for i, w in text.items() if len(w) >= 90 and len(set(w)) > 50) and all(len(text[i]) >= 50 for i in kept)


def test_near_duplicates(staged):
    _, docs, out = staged[1]
    groups = brute([(i, r.text) for i, r in rows(docs).items()], 5, 80, 100)
    assert set(rows(out)) == {min(i for i, _, g in groups if g == top) for top in {g for _, _, g in groups}} and len(rows(out)) < len(rows(docs))


def test_secrets(staged):
    _, docs, out = staged[2]
    before, after = rows(docs), rows(out)
    assert set(before) == set(after)
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all("[SECRET]" in after[i].text and "hunter2secret" not in after[i].text and "AKIA" not in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)
    assert not [i for i in before if "hunter2secret" in before[i].text and i not in changed] and secrets.RULES


def test_mixing(staged):
    _, docs, out = staged[3]
    before, after = rows(docs), rows(out)
    assert set(after) <= set(before) and after and all(after[i] == before[i] for i in after)


def test_packing(staged):
    _, docs, out = staged[4]
    pieces: dict = {}
    for r in out.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(rows(docs))
    for of in pieces.values():
        at = 0
        for start, length, total in sorted(of):
            assert start == at and length > 0
            at += length
        assert at == of[0][2]


def test_odd_and_empty_tables(spark, tmp_path):
    odd_docs(spark).coalesce(2).write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/odd").count() >= 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
