"""The queries against plain Python versions of their contracts."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import queries as Q

from .helpers import key, odd_docs, write_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a.example.com/x", None), (4, "::bad::[", ""),
         (5, "http://b.example.com:8080/a b\t?q=1\r\n", "<p>z</p>"), (5, "http://b.example.com:8080/a b\t?q=1\r\n", "<p>z</p>"), (None, "http://c.example/é", "<p>z</p>"), (None, None, None)],
        "page_id long, url string, html string",
    )
    return write_tables(spark, tmp_path_factory.mktemp("odd") / "t", odd_docs(spark), pages)


@pytest.fixture(scope="module", params=["odd", "sf"])
def where(request, odd_dir, sf):
    return odd_dir if request.param == "odd" else sf


def docs_of(spark, d):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def got(spark, name, d, n=None):
    return [tuple(r)[:n] for r in getattr(Q, name)(spark, d).collect()]


def test_warc(spark, where):
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/pages.parquet").select("page_id", "url", "html").collect()]
    groups = defaultdict(list)
    for p, u, h in rows:
        groups[(h or "").encode()].append(p)
    want = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda p: (p is not None, p or 0), reverse=True)
        want += [(p, len(payload), digest, "revisit" if k else "response", ids[0] if k else None) for k, p in enumerate(ids)]
    assert key(got(spark, "op1_warc", where, 5)) == key(want)


def test_quality(spark, where):
    want = []
    for i, t in docs_of(spark, where):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if c[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    have = got(spark, "op3_quality_rules", where)
    assert key(r[:7] for r in have) == key(want)
    assert not any(r[6] and r[7] for r in have)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, where):
    want = []
    for i, t in docs_of(spark, where):
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6 and m[1].isascii()]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        c = Counter(x[3] for x in spans)
        want.append((i, c["assign"], c["access"], c["hex"], hashlib.sha256(text.encode()).hexdigest()))
    assert key(got(spark, "op4_secret_scan", where, 5)) == key(want)


def test_licenses(spark, where):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    lower = {c: c + 32 for c in range(65, 91)}
    want = []
    for i, t in docs_of(spark, where):
        w = word.findall((t or "").translate(lower))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        n = [k for k, _ in at]
        want.append((i, len(w), len(at), min(n, default=None), max(n, default=None), ",".join(sorted({x for _, x in at}))))
    have = got(spark, "op9_license_scan", where)
    assert key(r[:6] for r in have) == key(want)
    assert all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1 for r in have)


def test_packing(spark, where):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    want = Counter()
    for i, t in docs_of(spark, where):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[(i, tuple(ids))] += 1
    crc = lambda ids: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    have = got(spark, "op10_packing", where)
    left = Counter((d, s, n, c) for d, s, n, c, *_ in have)
    by_doc = defaultdict(list)
    for r in have:
        by_doc[(r[0], r[4])].append(r)
    for (i, ids), n in want.items():
        pieces = sorted({(r[1], r[2], r[3]) for r in by_doc[(i, len(ids))] if crc(ids[r[1] : r[1] + r[2]]) == r[3]})
        assert sum(left[(i, s, k, c)] * k for s, k, c in pieces) >= n * len(ids)
    assert sum(r[2] for r in have) == sum(len(ids) * n for (_, ids), n in want.items())
    fill = defaultdict(list)
    for r in have:
        fill[r[5]].append((r[6], r[2]))
    for pieces in fill.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
