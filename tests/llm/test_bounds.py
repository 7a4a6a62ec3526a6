"""What one task holds does not grow with the corpus or hang on the number of shuffle partitions."""

import inspect
import time

import numpy as np

from plumbline.llm import lm, secrets, similarity


def test_token_ranges_without_many_partitions(spark, monkeypatch):
    """Few shuffle partitions must not make wide ranges of tokens: a task sorts a whole one in memory."""
    held, real = [], similarity._scan
    monkeypatch.setattr(similarity, "_scan", lambda docs, k, share, n_ranges: held.append(n_ranges) or real(docs, k, share, n_ranges))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(40))) for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        out = {r.doc_id: r.component_id for r in similarity.components(docs, k=4, num=85).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert held == [1024]
    assert out == {i: i // 2 * 2 for i in range(40)}


def test_family_blocks_hold_few_sets(spark, monkeypatch, tmp_path):
    """Groups of many members meet in blocks cut by members, not by groups: a block compares all its sets in one matrix."""
    rng = np.random.default_rng(1)
    rows, sizes = [], []
    for root in range(40):
        sets = [np.unique(rng.integers(1, 2**60, 6).astype(np.uint64)) for _ in range(20)]
        if root % 2:  # one set of the group before
            sets[0] = np.frombuffer(rows[-1][4][0], dtype=np.uint64)
        rows.append((root, [root * 100 + i for i in range(20)], [len(s) for s in sets], [b""] * 20, [s.tobytes() for s in sets], np.unique(np.concatenate(sets)).tobytes()))
        sizes.append((root, root, 20))
    groups = spark.createDataFrame(rows, similarity._GROUP)
    blocks = []
    real = similarity.by_key
    monkeypatch.setattr(similarity, "by_key", lambda df, keys, fn, schema: blocks.extend(df.select(*keys, similarity.F.size("sets").alias("n")).groupBy(*keys).agg(similarity.F.sum("n").alias("n")).collect()) or real(df, keys, fn, schema))
    members = spark.createDataFrame([(0, r) for r in range(40)], "lead long, root long")
    roots = spark.createDataFrame(sizes, "root long, label long, n_sets int")
    out = similarity._linked_families(members, groups, roots, similarity.Threshold(85, 100), size=100)
    assert sorted((r.a, r.b) for r in out.collect()) == [(r, r + 1) for r in range(0, 40, 2)]
    assert max(b.n for b in blocks) <= 600  # all 800 sets before


def test_model_learns_from_every_trigram():
    """Nothing is left out of what the operator learns from: no share can be set, and all is asked for."""
    assert "share" not in inspect.signature(lm.score).parameters
    assert "model.learn(trigrams(), rate, 1.0," in inspect.getsource(lm.score)


def _shuffled_rows(df, plan=None):
    """Rows written by each exchange of an executed plan."""
    plan = plan or df._jdf.queryExecution().executedPlan()
    found = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else []
    return found + [n for i in range(plan.children().size()) for n in _shuffled_rows(df, plan.children().apply(i))]


def test_texts_without_findings_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Where the findings are too many to be broadcast, only rows that may have some move to them; marks that blobs share change nothing."""
    rows = [(i, "token=abcdefgh" if i % 50 == 0 else f"AKIA{'B' * 16}{i}" if i % 50 == 1 else None if i == 7 else f"plain text {i}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.scan(docs)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = secrets.attach(docs, ledger)
        got = {r.doc_id: (r.text, [s["kind"] for s in r.spans]) for r in out.collect()}
        moved = _shuffled_rows(out)
        monkeypatch.setattr(secrets, "MARKS", 2, raising=False)
        shared = {r.doc_id: (r.text, [s["kind"] for s in r.spans]) for r in secrets.attach(docs, ledger).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == shared == {i: (t, ["assign"] if i % 50 == 0 else ["access"] if i % 50 == 1 else []) for i, t in rows}
    assert moved and max(moved) < 100  # all 400 rows before


def _plain_learning(model, trigrams, rate, seed, batch, k):
    """The same steps written plainly, with a sum for every row and column."""
    rng = np.random.default_rng(seed)
    word, target, first, second = model.parts(model.p)
    h_word, h_target, h_first, h_second = model.parts(np.full(model.p.shape, 1e-6, dtype=np.float32))
    log_kn = (np.log(k) + np.log(model.noise)).astype(np.float32)
    upto = np.cumsum(model.noise)

    def by_row(at, values):
        order = np.argsort(at, kind="stable")
        at = at[order]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        return at[begin], np.add.reduceat(values[order], begin, axis=0)

    def move(p, h, g, at=slice(None)):
        h[at] += g * g
        p[at] -= rate * g / np.sqrt(h[at])

    some = trigrams[rng.permutation(len(trigrams))]
    for at in range(0, len(some), batch):
        a, b, w = some[at : at + batch].T
        noise = np.searchsorted(upto, rng.random(k) * upto[-1]).clip(max=model.n - 1)
        ra, rb, tw, tn = word[a], word[b], target[w], target[noise]
        q = np.ones((len(w), model.dim + 1), dtype=np.float32)
        q[:, :-1] = ra @ first + rb @ second
        g_data = -1.0 / (1.0 + np.exp(np.clip(np.einsum("ij,ij->i", q, tw) - log_kn[w], -30, 30))) / len(w)
        g_noise = 1.0 / (1.0 + np.exp(-np.clip(q @ tn.T - log_kn[noise], -30, 30))) / len(w)
        g_q = (g_data[:, None] * tw + g_noise @ tn)[:, :-1]
        rows, g = by_row(np.r_[w, noise], np.vstack([g_data[:, None] * q, g_noise.T @ q]))
        g_first, g_second = ra.T @ g_q, rb.T @ g_q
        contexts, g_context = by_row(np.r_[a, b], np.vstack([g_q @ first.T, g_q @ second.T]))
        move(target, h_target, g, rows)
        move(word, h_word, g_context, contexts)
        move(first, h_first, g_first)
        move(second, h_second, g_second)
    return len(some)


def test_learning_costs_less_than_plain_steps():
    """The model is the one of the plain steps, at clearly less CPU time; an odd last batch and both widths of targets."""
    rng = np.random.default_rng(0)
    share = 1 / np.arange(1, 2049) ** 0.9
    ids = rng.choice(2048, 150_000, p=share / share.sum()).astype(np.int32)
    trigrams, unigram = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), np.bincount(ids, minlength=2048).astype(float)
    for dim, some in ((40, trigrams[:9999]), (7, trigrams[:2050])):
        a, b = (lm.LogBilinear(unigram, dim) for _ in range(2))
        assert a.learn(iter([some]), 0.1, 1.0, 5, batch=1024) == _plain_learning(b, some, 0.1, 5, 1024, 64) == len(some)
        assert np.abs(a.p - b.p).max() < 1e-4 < np.abs(a.p - lm.LogBilinear(unigram, dim).p).max()
    spent: list = [[], []]
    for _ in range(3):
        for to, run in zip(spent, (lambda m: m.learn(iter([trigrams]), 0.1, 1.0, 5, batch=1024), lambda m: _plain_learning(m, trigrams, 0.1, 5, 1024, 64))):
            model, at = lm.LogBilinear(unigram), time.thread_time()
            run(model)
            to.append(time.thread_time() - at)
    assert min(spent[0]) < 0.85 * min(spent[1])  # the same before
