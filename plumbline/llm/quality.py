"""Quality rules as a short-circuit cascade, in DataFrame functions only (operator 3).

Each rule's cost and selectivity are estimated on a sample; the rules then run in the order
of rejections per cost, each among the documents that the rules before it leave, and a
document that one rule rejects is not shown to the next. The verdict is the same in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """A rule that rejects a document when ``rejects`` of its columns is true; null counts as false.

    ``cost``: the rule's work on a document, in characters that it reads; one that compares
    features that are there already does the work of one.
    """

    name: str
    rejects: Callable[[], Column]
    cost: Callable[[], Column] = lambda: F.lit(1.0)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for a null text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def count_of(text: Column, pattern: str) -> Column:
    """How often a pattern of positive width is found in a text."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), pattern, -1)) - 1).cast("long")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Everything is worked out within a row: no shuffle, whatever key is hot. Three-word
    windows are compared by 64-bit hashes; only a text in which a window recurs is sorted.
    A null text counts as empty; columns of the same names are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    d = docs.drop(*own).withColumn("__w", words_of(F.col(text)))
    d = d.withColumns({
        "__h": F.when(
            F.size("__w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))),
        ),
        "__lines": F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(_BLANKS)) != ""),
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": count_of(F.col(text), r"[#*$%&|<>]"),
    })
    d = d.withColumns({
        "__s": F.when(
            F.size(F.array_distinct("__h")) < F.size("__h"),
            F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    same = lambda x, i: F.coalesce(F.get("__s", i)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("__s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    # a window adds the words that the window before it has not covered
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    # a row number keeps a later filter on these columns from being pushed into the arrays above, which it would repeat
    n = F.coalesce(covered, F.lit(0)).cast("long")
    d = d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, n).otherwise(F.lit(0).cast("long")))
    return d.drop("__w", "__h", "__lines", "__s")


def default_rules(text: str = "text") -> list[Rule]:
    """Rules beside the base; all read columns of ``with_features`` or scan the text once."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    kept = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    chars = lambda: F.length(t).cast("double")
    return [
        Rule("symbols", lambda: 100 * F.col("n_symbols") > 10 * n),
        Rule("dup_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("word_length", lambda: (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("shouting", lambda: 100 * count_of(t, "!") > 20 * n, chars),
        Rule("capitals", lambda: 100 * kept(r"[^\p{Lu}]+") > 40 * F.col("word_chars"), chars),
        Rule("not_letters", lambda: 100 * kept(r"[^\p{L}\p{M}]+") < 50 * F.col("word_chars"), chars),
    ]


def order_rules(featured: DataFrame, rules: list[Rule], sample_rows: int = 1000, decided: str = "false") -> list[Rule]:
    """Rules by rejections per cost on ``sample_rows`` rows, best first; ties keep their order.

    The rows are the first ones of the first partitions, as many partitions as it takes; a row
    comes to the driver as two numbers a rule. A rule's rejections count among the rows that
    the rules before it keep and that are not ``decided`` without rules. Only the order comes
    from the sample, never a verdict.
    """
    hits = [F.coalesce(r.rejects(), F.lit(False)).alias(f"hit{k}") for k, r in enumerate(rules)]
    costs = [F.coalesce(r.cost(), F.lit(1.0)).cast("double").alias(f"cost{k}") for k, r in enumerate(rules)]
    sample = featured.select(*hits, *costs, F.expr(decided).alias("decided")).limit(sample_rows).collect()
    left = [r for r in sample if not r["decided"]]
    n, todo, order = len(rules), list(range(len(rules))), []
    while todo:
        gain = {k: (sum(r[k] for r in left) + 0.01) / max(1.0, sum(r[n + k] for r in left)) for k in todo}
        best = max(todo, key=lambda k: (gain[k], -k))
        order.append(best)
        todo.remove(best)
        left = [r for r in left if not r[best]]
    return [rules[k] for k in order]


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. CASE stops at the first that is true."""
    case = F
    for rule in rules:
        case = case.when(F.coalesce(rule.rejects(), F.lit(False)), rule.name)
    return case.otherwise(F.lit(None).cast("string"))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """``docs`` with the features, base_failed, rejected_by and kept.

    Every row is judged alone, so nulls, ties and repeated rows need no rule of their own; a
    null or empty text has no words and fails the base. An empty table stays empty.
    """
    featured = with_features(docs, text)
    rules = default_rules(text) if rules is None else rules
    rules = order_rules(featured, rules, sample_rows, BASE_FAILED) if len(rules) > 1 else rules
    d = featured.withColumn("base_failed", F.expr(BASE_FAILED))
    d = d.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(verdict(rules)))
    return d.withColumn("kept", F.col("rejected_by").isNull())
