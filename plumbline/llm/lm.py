"""Scoring by a log-bilinear language model trained with noise-contrastive estimation (operator 2).

Words fall into classes, whose number grows with the corpus up to a bound: the most frequent words
alone, the others by their ends. The model predicts a class from the two before it; within its
class a word has its smoothed share of the training counts. Words are counted over all training
texts, and the model learns from all their trigrams: each task trains in numpy on its
own texts from a common start, and the tasks' parameters are averaged, weighted by trigrams.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store

#: The end of a text among the words, and its class, which also stands before a text's first word.
END, END_CLASS = b"", 0


class Classes:
    """Class numbers: 0 the end, then words of their own, then ends of words by hash."""

    def __init__(self, words: list[bytes], n: int):
        """``words`` by frequency; those that find room have a class each, half of all classes at most."""
        own = [w for w in words[: n // 2] if w != END][: n // 2 - 1]
        self.n, self.own = n, {w: i + 1 for i, w in enumerate(own)}
        self.first_shared = n // 2

    def of(self, word: bytes) -> int:
        if word == END:
            return END_CLASS
        return self.own.get(word) or self.first_shared + zlib.crc32(word[-2:]) % (self.n - self.first_shared)


class Numbers(dict):
    """Numbers of known words; those of others are worked out each time and not kept."""

    def __init__(self, known: dict[bytes, int], of: Callable[[bytes], int]):
        super().__init__(known)
        self.of = of

    def __missing__(self, word: bytes) -> int:
        return self.of(word)


def n_classes_of(tokens: int, least: int = 256, most: int = 2048) -> int:
    """A power of two near the square root of the training tokens, so that pairs of classes are seen about once each."""
    return min(most, max(least, 1 << round(math.log2(max(tokens, 1)) / 2)))


def _by_row(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of values (float32) of each.

    A sum costs a call a row and column, so rows that occur once are copied, and the others are
    added up as complex numbers, two columns at once, if their width is even.
    """
    order = np.argsort(at.astype(np.min_scalar_type(at.max())), kind="stable")  # two bytes are sorted by radix
    at, values = at[order], values.take(order, axis=0)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    size = np.diff(np.r_[first, len(at)])
    out = values.take(first, axis=0)
    many = np.flatnonzero(size > 1)
    if len(many):
        # reduceat sums up to where the next row begins, so rows that occur once must be gone
        some = values.take(np.flatnonzero(np.repeat(size > 1, size)), axis=0)
        some = some.view(np.float32 if some.shape[1] % 2 else np.complex64)
        out[many] = np.add.reduceat(some, np.cumsum(size[many]) - size[many], axis=0).view(np.float32)
    return at[first], out


class LogBilinear:
    """score(w | a, b) = target[w] . (first context[a] + second context[b]) + bias[w].

    ``p`` holds one row a parameter vector: word vectors, targets with their bias, and the two
    context matrices, so that models of several tasks can be averaged row by row.
    """

    def __init__(self, unigram: np.ndarray, dim: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = self.n = len(unigram)
        self.dim = dim
        self.noise = (unigram + 1.0) / (unigram.sum() + n)
        p = self.p = rng.normal(0, 0.1, (2 * n + 2 * dim, dim + 1)).astype(np.float32)
        p[2 * n : 2 * n + dim, :dim] += 0.5 * np.eye(dim, dtype=np.float32)
        p[2 * n + dim :, :dim] += np.eye(dim, dtype=np.float32)
        p[:, dim] = 0
        p[n : 2 * n, dim] = np.log(self.noise)

    def parts(self, p: np.ndarray) -> tuple[np.ndarray, ...]:
        """Views: word vectors, targets with bias, first and second context matrix."""
        n, d = self.n, self.dim
        return p[:n, :d], p[n : 2 * n], p[2 * n : 2 * n + d, :d], p[2 * n + d :, :d]

    def learn(self, trigrams: Iterator[np.ndarray], rate: float, share: float, seed: int, batch: int = 256, k: int = 64) -> int:
        """Adagrad on a random share of (a, b, w) in minibatches, against k noise classes each; gives the number learned from."""
        rng = np.random.default_rng(seed)
        n, d = self.n, self.dim
        # copies whose rows lie together: word vectors; targets with bias, filled up to an even width; both context matrices on each other
        word, target, both = self.p[:n, :d].copy(), np.zeros((n, d + 1 + (d + 1) % 2), dtype=np.float32), self.p[2 * n :, :d].copy()
        target[:, : d + 1] = self.p[n : 2 * n]
        h_word, h_target, h_both = (np.full(x.shape, 1e-6, dtype=np.float32) for x in (word, target, both))
        log_kn = (np.log(k) + np.log(self.noise)).astype(np.float32)
        upto, seen = np.cumsum(self.noise), 0

        def step(h, g):
            """Adagrad's step for gradients g; h takes their squares."""
            h += g * g
            by = np.sqrt(h)
            np.divide(g, by, out=by)
            by *= rate
            return by

        def move(p, h, g, at):
            here = h.take(at, axis=0)
            p[at] -= step(here, g)
            h[at] = here

        for some in trigrams:
            some = some[rng.permutation(len(some))[: math.ceil(share * len(some))]]
            seen += len(some)
            for at in range(0, len(some), batch):
                ab, w = some[at : at + batch, :2].ravel(), some[at : at + batch, 2]
                m = len(w)
                noise = np.searchsorted(upto, rng.random(k) * upto[-1]).clip(max=n - 1)
                before, tw, tn = word.take(ab, axis=0).reshape(m, 2 * d), target.take(w, axis=0), target.take(noise, axis=0)
                q = np.zeros((m, target.shape[1]), dtype=np.float32)
                q[:, :d] = before @ both
                q[:, d] = 1.0  # meets the bias
                # gradients of -log sigmoid(data) - sum log(1 - sigmoid(noise)) by the scores
                s_data = np.einsum("ij,ij->i", q, tw) - log_kn[w]
                g_data = (-1.0 / (1.0 + np.exp(np.clip(s_data, -30, 30))) / m)[:, None]
                g_noise = q @ -tn.T
                g_noise += log_kn[noise]
                np.clip(g_noise, -30, 30, out=g_noise)
                np.exp(g_noise, out=g_noise)
                g_noise += 1.0
                g_noise *= m
                np.reciprocal(g_noise, out=g_noise)
                g_q = g_noise @ tn[:, :d]
                tw *= g_data
                g_q += tw[:, :d]
                g_target = np.empty((m + k, q.shape[1]), dtype=np.float32)
                np.matmul(g_noise.T, q, out=g_target[m:])
                np.multiply(q, g_data, out=g_target[:m])
                g_both, g_before = before.T @ g_q, (g_q @ both.T).reshape(2 * m, d)
                rows, g = _by_row(np.r_[w, noise], g_target)
                move(target, h_target, g, rows)
                rows, g = _by_row(ab, g_before)
                move(word, h_word, g, rows)
                both -= step(h_both, g_both)
        self.p[:n, :d], self.p[n : 2 * n], self.p[2 * n :, :d] = word, target[:, : d + 1], both
        return seen

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """left, right and norm with log P(w | a, b) = left[a, w] + right[b, w] - norm[a, b], normalised exactly.

        The sum over w of exp(left) exp(right) is a matrix product for all pairs of contexts at once.
        """
        word, target, first, second = (x.astype(np.float64) for x in self.parts(self.p))
        left, right = word @ first @ target[:, :-1].T + target[:, -1], word @ second @ target[:, :-1].T
        left -= left.max(axis=1, keepdims=True)
        right -= right.max(axis=1, keepdims=True)
        norm = np.log(np.exp(left) @ np.exp(right).T)
        return left.astype(np.float32), right.astype(np.float32), norm.astype(np.float32)


def held_out_of(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training; one without an id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, in pieces of a bounded number of words."""
    total: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            total.update(_words(text))
            total[END] += 1
            if len(total) > 600_000:
                yield rows()
                total.clear()
    if total:
        yield rows()


def _spans(texts: list[list[bytes]], ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word values of several texts with two pads before each, positions of real words, and each text's first."""
    n = np.array([len(t) for t in texts])
    first = np.cumsum(n) - n
    out = np.full(len(ids) + 2 * len(texts), pad, dtype=ids.dtype)
    where = np.arange(len(ids)) + 2 * np.repeat(np.arange(1, len(texts) + 1), n)
    out[where] = ids
    return out, where, first


def _parts(texts: list[bytes | None], tokens: int = 400_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists, each with the end, of runs of texts with about so many words; with the first's number."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        w = _words(t)
        w.append(END)
        part.append(w)
        size += len(w)
        if size >= tokens:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def score(
    docs: DataFrame,
    n_classes: int | None = None,
    n_frequent: int = 400_000,
    longest: int = 64,
    rounds: int = 1,
    rate: float = 0.1,
    tokens_per_task: int = 4_000_000,
    seed: int = 11,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row a row.

    All texts outside the held-out fold are counted whole, and in every round the model learns from
    all their trigrams; none is left out. ``n_classes`` follows the number of training tokens unless it is given.
    Counts of the ``n_frequent`` most frequent words of ``longest`` bytes at most go to the tasks;
    every other word is joined with its count. A task with fewer than ``tokens_per_task`` tokens
    goes over them again, eight times at most. A null or empty text is its end alone. A null id is
    trained on and stays null. Repeated rows are scored each on its own; an empty table stays
    empty. Extra columns are not read, whatever their names. Scores are log10.

    An unknown word has, in its class, the share of one more word that was never seen, so the
    probabilities of all words of all classes sum to one after any two words.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), held_out_of(F.col(doc_id)).alias("held_out"))
    train = base.where(~F.col("held_out")).select("text")
    spark = docs.sparkSession
    counts = store.materialize(train.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_classes = n_classes or n_classes_of(n_all)

    # the count from which on words are frequent: by a histogram of counts, no sort of words
    short = F.octet_length("word") <= longest
    least, room = 1 << 62, n_frequent
    for r in counts.where(short).groupBy("c").count().orderBy(F.desc("c")).limit(n_frequent).collect():
        if r["count"] > room:
            break
        least, room = r["c"], room - r["count"]
    frequent = counts.where(short & (F.col("c") >= least)).toArrow()
    words, c = frequent.column("word").to_pylist(), frequent.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in order], c[order]
    classes = Classes(words, n_classes)

    def sum_classes(batches):
        for batch in batches:
            of = np.fromiter(map(classes.of, batch.column(0).to_pylist()), np.int64)
            n = np.bincount(of, batch.column(1).to_numpy(), n_classes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_classes)), pa.array(n), pa.array(np.bincount(of, minlength=n_classes))], names=["class", "n", "v"])

    in_class = np.zeros((n_classes, 2))
    for r in counts.mapInArrow(sum_classes, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        in_class[r["class"]] = r["n"], r["v"]
    shared = spark.sparkContext.broadcast(pickle.dumps((words, c)))  # n_frequent words of ``longest`` bytes at most
    model = LogBilinear(in_class[:, 0], seed=seed)

    def learner(start, rate, seed):
        def learn(batches):
            """The model after all texts of a task, one row a parameter vector, with its number of trigrams."""
            words, _ = pickle.loads(shared.value)
            known = Numbers({w: classes.of(w) for w in words}, classes.of)
            model = pickle.loads(start.value)

            def trigrams():
                kept, n = [], 0
                for batch in batches:
                    for _, part in _parts(batch.column(0).to_pylist(), 100_000):
                        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(part)), np.int32)
                        ids, where, _ = _spans(part, flat, END_CLASS)
                        some = np.stack([ids[where - 2], ids[where - 1], ids[where]], axis=1)
                        if n < tokens_per_task:
                            kept.append(some)
                        n += len(some)
                        yield some
                for _ in range(min(7, tokens_per_task // n - 1) if 0 < n < tokens_per_task else 0):
                    yield from kept

            seen = model.learn(trigrams(), rate, 1.0, seed + 1 + TaskContext.get().partitionId(), batch=1024)
            if seen:
                rows = len(model.p)
                columns = [pa.array(np.arange(rows, dtype=np.int32)), pa.array(np.full(rows, seen)), *map(pa.array, model.p.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *names])

        return learn

    names = [f"p{i}" for i in range(model.dim + 1)]
    weighted = [(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in names]
    parts = train.coalesce(max(1, n_all // tokens_per_task))
    for i in range(rounds):
        learn = learner(spark.sparkContext.broadcast(pickle.dumps(model)), rate / (i + 1), seed + i * 1_000_003)
        averaged = parts.mapInArrow(learn, "row int, n long, " + ", ".join(f"{x} float" for x in names)).groupBy("row").agg(*weighted)
        got = store.materialize(averaged, "lm-model").toArrow()  # one row a parameter vector, however large the corpus is
        if got.num_rows:
            model.p[got.column("row").to_numpy()] = np.stack([got.column(x).to_numpy() for x in names], axis=1)
    shared_tables = spark.sparkContext.broadcast(pickle.dumps(model.tables()))
    norm = np.where(np.arange(n_classes) >= classes.first_shared, np.log10(in_class.sum(axis=1) + 1), 0.0)

    def evaluate(batches):
        """Each text's parts that need no rare word's count, and its rare words."""
        words, c = pickle.loads(shared.value)
        known = {w: i for i, w in enumerate(words)}
        of_known = np.array([classes.of(w) for w in words], dtype=np.int64)
        log_known = np.log10(c + 1.0)
        left, right, pair = pickle.loads(shared_tables.value)
        get, of = known.get, classes.of
        for batch in batches:
            rid, ids, held, texts = batch.columns
            columns: list[list] = [[], [], [], [], []]
            for _, part in _parts(texts.to_pylist()):
                at = np.fromiter(map(get, chain.from_iterable(part), repeat(-1)), np.int64)
                rare = np.flatnonzero(at < 0)
                first = np.cumsum([len(t) for t in part]) - [len(t) for t in part]
                doc = np.searchsorted(first, rare, side="right") - 1
                rare_words: list[list[bytes]] = [[] for _ in part]
                cls = of_known[at] if len(of_known) else np.zeros(len(at), dtype=np.int64)
                for i, d in zip(rare.tolist(), doc.tolist()):
                    w = part[d][i - first[d]]
                    rare_words[d].append(w)
                    cls[i] = of(w)
                logs = np.where(at >= 0, log_known[at] if len(log_known) else 0.0, 0.0)
                padded, where, first = _spans(part, cls, END_CLASS)
                before, last = padded[where - 2], padded[where - 1]
                by_class = (left[before, cls].astype(np.float64) + right[last, cls] - pair[before, last]) / np.log(10)
                own = by_class - norm[cls] + np.where(cls >= classes.first_shared, logs, 0.0)
                for to, values in zip(columns, ([len(t) for t in part], np.add.reduceat((at >= 0).astype(np.int64), first), np.add.reduceat(logs, first), np.add.reduceat(own, first), rare_words)):
                    to.extend(values)
            n, k, b, s, r = columns
            yield pa.RecordBatch.from_arrays(
                [rid, ids, held, pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64()), pa.array(r, pa.list_(pa.binary()))],
                names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "own", "rare"],
            )

    d = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    d = store.materialize(d.mapInArrow(evaluate, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, rare array<binary>"), "lm-rows")
    rare = d.select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("n"))
    rare = rare.join(counts.where(~short | (F.col("c") < least)), "word").groupBy("rid")
    rare = rare.agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    log = F.coalesce("log", F.lit(0.0))
    return d.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        (F.col("own") + log).alias("score"),
    )
