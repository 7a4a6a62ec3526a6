"""Spelling variants by a rare-first prefix filter on positional bigrams (operator 12).

One edit destroys two bigrams of a word at most, so of the three rarest of either word one
survives in both, at its place from the front or from the back. On the side of it that the edit
doesn't touch, both words are equal; what is left on the other side is halved, and one half is
equal, too. That gives every word a few keys of a fixed part at its front and its back; words
meet on equal keys only and are verified. Keys that many words share have the part between
halved again, so no key is a task's burden and no pair is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store

#: Bigrams that one edit can destroy, and one more.
RAREST = 3
_TOKENS = "key long, word string, n long, longer boolean, front int, back int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least: int = 7, every: int = 31, fewest: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the runs of letters of all texts with planted slips, of ``least`` code points and ``fewest`` occurrences or more.

    Shorter runs are passed over: a slip makes no word longer. A null id is hashed as an empty one.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run")
    d = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run)
    d = d.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")))
    d = d.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, slip).otherwise(F.col("run"))
    return d.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def rarest(word: str, frequency: dict[str, int], most: int = RAREST) -> list[int]:
    """Places of the rarest bigrams; of equal ones the first in order, then the first in the word."""
    return sorted(range(len(word) - 1), key=lambda i: (frequency.get(word[i : i + 2], 0), word[i : i + 2], i))[:most]


def key_of(word: str, shorter: int, front: int, back: int) -> int:
    """Of the part that is fixed at the front and at the back, for pairs whose shorter word has so many code points."""
    fixed = f"{shorter}:{front}:{back}:{word[:front]}{word[len(word) - back:]}"
    return xxhash.xxh64_intdigest(fixed, 12) - (1 << 63)


def halves(shorter: int, front: int, back: int) -> list[tuple[int, int]]:
    """What is fixed if the first half of what lies between is equal, or the second half."""
    between = shorter - front - back
    return [(front + between // 2, back), (front, back + between - between // 2)]


def cuts(word: str, frequency: dict[str, int]) -> Iterator[tuple[int, bool, int, int]]:
    """(length of the shorter word, is this the longer one, front, back) of every key of a word."""
    at = rarest(word, frequency)
    for longer in (False, True):
        shorter = len(word) - longer
        seen = set()
        for i in at:
            # the bigram survives and the edit lies behind it, or before it
            for front, back in ((i + 2, 0), (0, len(word) - i)):
                if front + back <= shorter:
                    seen.update(halves(shorter, front, back))
        for front, back in sorted(seen):
            yield shorter, longer, front, back


def near(vocabulary: DataFrame, most: int = 1000) -> DataFrame:
    """word, near, near_n: all pairs that differ by one inserted, deleted or replaced code point, both ways, of word, n."""
    spark = vocabulary.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                found.update(bigrams(word))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    grams = vocabulary.select("word").mapInArrow(store.tidy(count), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequency = {r["gram"]: r["n"] for r in grams.collect()}  # 90 letters, 8100 bigrams at most

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key_of(word, s, f, b), word, n, longer, f, b) for s, longer, f, b in cuts(word, frequency)]
            yield _batch(rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, word, n, longer, f, b in zip(*(c.to_pylist() for c in batch.columns)):
                s = len(word) - longer
                rows += [(key_of(word, s, *h), word, n, longer, *h) for h in halves(s, f, b)]
            yield _batch(rows)

    tokens = store.materialize(vocabulary.select("word", "n").mapInArrow(store.tidy(keys), _TOKENS), "spelling-keys", batch=10_000)
    met, written = [], [tokens]
    while True:
        sizes = tokens.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(~F.col("longer")).alias("short"), F.max(F.length("word") - F.col("longer").cast("int") - F.col("front") - F.col("back")).alias("between"))
        sizes = sizes.where("rows > 1 AND short > 0")
        crowded = (F.col("rows") > most) & (F.col("between") > 1)
        hot = store.materialize(sizes.where(crowded).select("key"), "spelling-hot")
        written.append(hot)
        if hot.isEmpty():
            met.append(tokens)
            break
        met.append(tokens.join(hot, "key", "left_anti"))
        tokens = store.materialize(tokens.join(hot, "key", "left_semi").select(*tokens.columns).mapInArrow(store.tidy(again), _TOKENS).distinct(), "spelling-keys", batch=10_000)
        written.append(tokens)

    pairs = None
    for t in met:
        a = t.where("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = t.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        some = a.join(b, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        pairs = some if pairs is None else pairs.union(some)
    pairs = store.materialize(pairs, "spelling-pairs")
    store.discard(*written)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    # a pair meets on several keys; one shuffle serves this and whatever is grouped by word
    return both.repartition("word").dropDuplicates(["word", "near"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _TOKENS.split(", ")])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, for (word, form); each step doubles the stride.

    A form occurs ten times as often as its word, so chains are short and never close.
    """
    step = store.materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = store.materialize(step.join(far, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")), "spelling-roots")
        store.discard(step)
        stored, step = new.stored_at, new.select("word", "root")
        step.stored_at = stored
        if new.where("went").isEmpty():
            return step


def variants(docs: DataFrame, least: int = 7, every: int = 31, fewest: int = 2, ratio: int = 10, most: int = 1000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts.

    A word's form is the near word that occurs most (ties: smallest in code-point order), if it
    occurs ``ratio`` times as often as the word or more; its root is the last form on the way.

    Null and empty texts have no words; very long texts and words are taken whole; repeated rows
    count each; a null id is hashed as an empty one; other columns are ignored; an empty table
    stays empty.
    """
    vocabulary = store.materialize(words(docs, least, every, fewest, text, doc_id), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near_words = near(vocabulary, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    d = vocabulary.join(near_words, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= F.col("n") * ratio
    d = store.materialize(d.withColumn("form", F.when(enough, F.col("form"))).withColumn("form_n", F.when(enough, F.col("form_n"))), "spelling-forms")
    store.discard(vocabulary)
    found = roots(d.where("form IS NOT NULL"))
    return d.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
