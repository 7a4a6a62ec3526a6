"""Sum-of-squares online packing of token sequences (operator 10).

Each document's ids go to the window whose fill level keeps the sum of squared counts
of partially filled windows least. ``levels[h]`` counts the open windows that hold h
ids; a choice costs one pass over the open levels and no search over windows.
"""

from __future__ import annotations

import gc
import threading
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import add
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))]
)


class Packer:
    """Places pieces into windows of ``size`` ids and says when a window is closed.

    A piece is ``(doc, start, ids, doc_tokens)`` with ids as little-endian uint32 bytes.
    At most ``max_open`` windows stay open: the memory that a task may hold. Beyond it, and
    when the input ends, there is no next document to wait for and the open windows are
    levelled: ids of the emptiest ones are cut off and fill up the fullest ones, so that one
    window at most is left, which ``finish`` cuts into powers of two.
    """

    def __init__(self, size: int = 4096, max_open: int = 8192, first_id: int = 0):
        self.size, self.max_open, self.next_id = size, max_open, first_id
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.at: dict[int, list[list]] = {}  # fill level -> windows, each a list of pieces
        self.n_open = 0

    def level_for(self, s: int) -> int:
        """The fill level to add s ids to; 0 opens a window. Ties go to the fuller level."""
        lv = self.levels
        open_ = np.flatnonzero(lv[1 : self.size - s + 1]) + 1
        best, cost = 0, 2 * int(lv[s]) + 1 if s < self.size else 0
        if len(open_):
            after = open_ + s
            delta = np.where(after == self.size, 1 - 2 * lv[open_], 2 * (lv[np.minimum(after, self.size - 1)] - lv[open_]) + 2)
            k = len(delta) - 1 - int(np.argmin(delta[::-1]))
            if delta[k] <= cost:
                best = int(open_[k])
        return best

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Place one piece of any length; yields rows of windows that are now closed."""
        doc, start, ids, total = piece
        n, width = len(ids) // 4, 4 * self.size
        whole = n // self.size
        for k in range(whole):
            yield from self._close([(doc, start + k * self.size, ids[k * width : (k + 1) * width], total)])
        if s := n - whole * self.size:
            rest = (doc, start + whole * self.size, ids[whole * width :], total)
            h = self.level_for(s)
            if h:
                window = self.at[h].pop()
                self.levels[h] -= 1
                self.n_open -= 1
            else:
                window = []
            window.append(rest)
            if h + s == self.size:
                yield from self._close(window)
            else:
                self.levels[h + s] += 1
                self.at.setdefault(h + s, []).append(window)
                self.n_open += 1
        if self.n_open > self.max_open:
            yield from self._level()

    def _close(self, window: list) -> Iterator[tuple]:
        at, seq = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in window:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, seq, at
            at += n

    def _level(self) -> Iterator[tuple]:
        """Full windows from the open ones; what is left stays open as one window."""
        windows = [w for h in sorted(self.at, reverse=True) for w in self.at[h]]
        self.at, self.n_open = {}, 0
        self.levels[:] = 0
        current, fill = [], 0
        for window in windows:
            for doc, start, ids, total in window:
                while ids:
                    take = min(len(ids) // 4, self.size - fill)
                    current.append((doc, start, ids[: 4 * take], total))
                    start, ids, fill = start + take, ids[4 * take :], fill + take
                    if fill == self.size:
                        yield from self._close(current)
                        current, fill = [], 0
        if current:
            self.levels[fill] = 1
            self.at[fill] = [current]
            self.n_open = 1

    def finish(self) -> Iterator[tuple]:
        """Close everything; the last ids go to windows whose sizes are powers of two."""
        yield from self._level()
        for windows in list(self.at.values()):
            for window in windows:
                left = sum(len(p[2]) // 4 for p in window)
                want = 1 << (left.bit_length() - 1)
                current, fill = [], 0
                for doc, start, ids, total in window:
                    while ids:
                        take = min(len(ids) // 4, want - fill)
                        current.append((doc, start, ids[: 4 * take], total))
                        start, ids, fill, left = start + take, ids[4 * take :], fill + take, left - take
                        if fill == want:
                            yield from self._close(current)
                            current, fill = [], 0
                            want = 1 << (left.bit_length() - 1) if left else 0
        self.at, self.n_open = {}, 0
        self.levels[:] = 0


class Encoder:
    """Ids of whole texts, with a cache of white-space delimited strings.

    The tokenizer drops white space and no token spans it, so a text's ids are those of
    its parts in order. New parts of letters, with punctuation behind them or not, are
    encoded by the thousand in one call, where the end of each shows in its last token;
    others are encoded one by one. The cache is emptied at ``max_cached`` entries.
    """

    #: ASCII punctuation that is one token group behind letters; an apostrophe may join what follows.
    _TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, end_id: int, max_cached: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.max_cached, self.cache, self.stems = end_id.to_bytes(4, "little"), max_cached, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._check()

    def _check(self) -> None:
        """Refuse a tokenizer for which a text's ids are not those of its lower-cased strings in order."""
        for probe in ("Some Words, and their\tends; x1\n\nit's  don't (so) \u00e9t\u00e9", " lead", "trail ", "A.B-C_d"):
            whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
            if [i for p in probe.lower().split() for i in self.tokenizer.encode(p, add_special_tokens=False).ids] != whole:
                raise ValueError("this tokenizer keeps case or white space: its ids cannot be put together from strings")

        self.timer: threading.Timer | None = None

    def rest(self, seconds: float = 2.0) -> None:
        """Empty the cache unless a task wants it within so many seconds: an idle worker holds no words."""
        self.timer = threading.Timer(seconds, lambda: (self.cache.clear(), self.stems.clear()))
        self.timer.daemon = True
        self.timer.start()

    def wake(self) -> None:
        """Before use: whatever the timer has not emptied yet stays."""
        if self.timer is not None:
            self.timer.cancel()
            self.timer.join()
            self.timer = None

    def _each(self, parts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in done]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of strings that are one pre-token each."""
        out = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                out += self._each(some)
                continue
            raw, upto = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(upto, upto[1:])]
        return out

    def _add(self, new: list[bytes]) -> None:
        simple, stems, tails, other = [], [], [], []
        texts = b"\n".join(new).decode("utf-8", "replace").split("\n")
        composed = is_normalized("NFC", "\n".join(texts))
        for part, text in zip(new, texts):
            stem = text.rstrip(self._TAIL)
            if stem.isalpha() and stem.islower() and (composed or is_normalized("NFC", stem)):
                simple.append(part)
                stems.append(stem)
                tails.append(text[len(stem) :])
            else:
                other.append((part, text))
        of = self.stems
        if len(of) > self.max_cached:
            of.clear()
        units = list({*stems, *tails}.difference(of, [""]))
        of.update(zip(units, self._words(units)))
        of[""] = b""
        self.cache.update(zip(simple, map(add, map(of.__getitem__, stems), map(of.__getitem__, tails))))
        self.cache.update(zip([p for p, _ in other], self._each([t for _, t in other])))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # a special token's string is one as it is written only, so such texts keep their case
        parts = [(t if b"<|" in t else t.lower()).split() for t in texts]
        cache = self.cache
        new = set().union(*parts).difference(cache)
        if new:
            if len(cache) + len(new) > self.max_cached:
                cache.clear()
                new = set().union(*parts)
            self._add(list(new))
        return [b"".join(map(cache.__getitem__, words)) + self.end for words in parts]


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    """A worker keeps its encoder, and what that has cached, from task to task."""
    return Encoder(path, end_id)


def pack(
    docs: DataFrame,
    tokenizer_path: Callable[[], str] | str,
    end_id: int = 2,
    size: int = 4096,
    text: str = "text",
    doc_id: str = "doc_id",
    max_open: int = 8192,
) -> DataFrame:
    """Pack every document's ids into windows of ``size`` ids; one row a piece.

    Windows are packed within an input partition, so no row is shuffled and no key can be
    hot; a lost task is repeated alone and gives the same windows. A null text is empty and
    still has its end id. A null doc_id stays null; repeated rows are packed each on its own.
    Other columns are ignored. An empty table gives no rows. Windows are full but for those
    that close a partition, whose sizes are powers of two, so no padding is needed. A task
    holds ``max_open`` open windows at most, 128 MB of ids at 8192 of 4096; a partition of
    128 MB of text never has as many.

    ``tokenizer_path``: a path that all executors have, or a function that gives it there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path() if callable(tokenizer_path) else tokenizer_path
        encode = _encoder(path, end_id)
        encode.wake()
        packer = Packer(size, max_open, first_id=TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        gc.disable()  # there are no cycles, but lists of millions of words to walk
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for part in _runs(texts, 8 << 20):
                    for i, b in zip(part, encode([texts[i] or b"" for i in part])):
                        rows.extend(packer.add((ids[i], 0, b, len(b) // 4)))
                    if len(rows) > 5000:
                        yield _batch(rows)
                        rows = []
            rows.extend(packer.finish())
            if rows:
                yield _batch(rows)
        finally:
            gc.enable()
            encode.rest()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def _runs(texts: list[bytes | None], size: int) -> Iterator[range]:
    """Runs of texts with about so many bytes together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            yield range(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield range(at, len(texts))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)
