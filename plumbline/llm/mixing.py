"""Mixing sources to target weights by iterative proportional fitting (operator 5).

Tokens are counted by (source, language, topic) cell; cell weights are raked until their
marginals are the targets; documents are then sampled with their cell's calibrated
probability, by a hash of the document, so that a repeated task decides alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.quality import words_of

AXES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic by cue words: legal, credentials, table, figures or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike("(?i)licen[sc]e|copyright|rights reserved|creative commons"), "legal")
        .when(t.rlike("(?i)passw|secret|token|api_?key|AKIA"), "credentials")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(t.rlike("[0-9]{3}"), "figures")
        .otherwise("prose")
    )


def tempered(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to a power of the tokens there are; 1 keeps them, 0 makes them equal."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """IPF: shares of the cells whose marginals along each axis are ``targets``.

    ``cells``: tokens; ``index[a]``: each cell's number along axis a. Cells that are empty stay so;
    where the targets cannot all be met, the last axis is met exactly and the others as nearly
    as the rounds come.
    """
    w = cells / max(cells.sum(), 1e-300)
    for _ in range(rounds):
        off = 0.0
        for ix, want in zip(index, targets):
            have = np.bincount(ix, w, len(want))
            off = max(off, float(np.abs(have - want).max(initial=0)))
            w = w * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[ix]
        if off < tol:
            break
    return w


def rake_table(cells: DataFrame, goals: list[DataFrame], rounds: int = 200, tol: float = 1e-9) -> DataFrame:
    """``rake`` for more cells than the driver should hold, with its rounds and its tolerance; a written table ends each round.

    ``cells``: the axes and ``tokens``; ``goals[a]``: axis a and ``want``. Adds ``share``.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    d = store.materialize(cells.withColumn("share", F.col("tokens") / F.lit(total)), "rake")
    for _ in range(rounds):
        d = d.withColumn("off", F.lit(0.0))
        for axis, goal in zip(AXES, goals):
            factor = d.groupBy(axis).agg(F.sum("share").alias("have")).join(goal, axis, "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
            factor = factor.select(axis, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("by"), F.abs(F.col("have") - F.col("want")).alias("by_off"))
            d = d.join(factor, axis).withColumns({"share": F.col("share") * F.col("by"), "off": F.greatest("off", "by_off")}).drop("by", "by_off")
        d = store.materialize(d, "rake")
        off = d.agg(F.max("off")).first()[0]
        d = d.drop("off")
        if off is None or off < tol:
            break
    return d


def calibrate_table(shares: DataFrame, budget: float, steps: int = 40) -> DataFrame:
    """``calibrate`` on a table: by bisection for the scale at which the expected tokens are the budget."""
    p = lambda scale: F.least(F.lit(1.0), F.lit(scale) * F.col("share") / F.col("tokens"))
    expected = lambda scale: shares.agg(F.sum(F.col("tokens") * p(scale))).first()[0] or 0.0
    low, high = 0.0, max(budget, 1.0)
    while expected(high) < budget * (1 - 1e-9) and high < 1e30:
        low, high = high, high * 8
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < budget else (low, mid)
    return shares.withColumn("probability", p(high))


def calibrate(tokens: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """Each cell's sampling probability for ``budget`` expected tokens at these shares.

    A cell that has too few tokens for its share is taken whole and the others, in
    proportion, make up for it, as far as there are tokens.
    """
    p = np.zeros(len(tokens))
    free = (tokens > 0) & (share > 0)
    left = min(budget, float(tokens[free].sum()))
    while free.any() and left > 0:
        want = share * left / share[free].sum()
        over = free & (want >= tokens * (1 - 1e-12))
        if not over.any():
            p[free] = want[free] / tokens[free]
            break
        p[over] = 1.0
        left -= float(tokens[over].sum())
        free &= ~over
    return np.clip(p, 0.0, 1.0)


def mix(
    docs: DataFrame,
    budget_share: float = 0.7,
    powers: tuple[float, float, float] = (0.7, 0.7, 0.9),
    targets: dict[str, dict[str, float]] | None = None,
    max_cells: int = 200_000,
    seed: int = 5,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` (with source and lang) with topic, n_tokens, probability and selected.

    ``targets``: shares by axis; an axis without them aims at its own tokens raised to its
    power. ``budget_share``: expected share of all tokens that is selected. A null source or
    language is a value of its own, named ''. A null or empty text has no tokens: it takes no
    part and is never selected. Repeated rows are sampled alike. An empty table stays empty.

    The driver gets one row a cell, and no document, while there are ``max_cells`` at most;
    beyond, the cells stay in tables and are joined by key.
    """
    d = docs.drop("topic", "n_tokens", "probability", "selected").withColumns({
        "topic": topic_of(F.col(text)),
        "n_tokens": F.size(words_of(F.col(text))).cast("long"),
    })
    spark = docs.sparkSession
    axes = [F.coalesce(F.col(a), F.lit("")).alias(a) for a in AXES]
    cells = store.materialize(d.groupBy(*axes).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-cells")
    got = cells.limit(max_cells + 1).collect()
    few = len(got) <= max_cells
    if few:
        got.sort(key=lambda r: tuple(r[a] for a in AXES))
        tokens = np.array([r["tokens"] for r in got], dtype=float)
        index, wants = [], []
        for axis, power in zip(AXES, powers):
            names = sorted({r[axis] for r in got})
            number = {x: i for i, x in enumerate(names)}
            ix = np.array([number[r[axis]] for r in got], dtype=np.int64)
            goal = (targets or {}).get(axis) or tempered(dict(zip(names, np.bincount(ix, tokens, len(names)))), power)
            want = np.array([goal.get(x, 0.0) for x in names], dtype=float)
            index.append(ix)
            wants.append(want / want.sum() if want.sum() else want)
        p = calibrate(tokens, rake(tokens, index, wants), budget_share * float(tokens.sum())) if got else tokens
        rows = [(*(r[a] for a in AXES), float(x)) for r, x in zip(got, p)]
        table = spark.createDataFrame(rows, "__source string, __lang string, __topic string, probability double")
    else:
        goals = []
        for axis, power in zip(AXES, powers):
            named = (targets or {}).get(axis)
            goal = spark.createDataFrame(list(named.items()), f"{axis} string, want double") if named else cells.groupBy(axis).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("want"))
            whole = goal.join(cells.select(axis).distinct(), axis, "left_semi").agg(F.sum("want")).first()[0] or 1.0
            goals.append(goal.withColumn("want", F.col("want") / F.lit(whole)))
        total = float(cells.agg(F.sum("tokens")).first()[0])
        table = calibrate_table(rake_table(cells, goals), budget_share * total)
        table = table.select(*[F.col(a).alias(f"__{a}") for a in AXES], "probability")
    on = [F.coalesce(F.col(a), F.lit("")) == F.col(f"__{a}") for a in AXES]
    d = d.join(F.broadcast(table) if few else table, on, "left").drop("__source", "__lang", "__topic")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return d.withColumn("probability", F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0)).withColumn(
        "selected", F.coalesce(u < F.col("probability"), F.lit(False))
    )
