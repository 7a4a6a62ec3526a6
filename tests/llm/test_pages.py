"""Operator 7 on broken, deep and labelled pages; operator 4's ledger over several scans; operator 9 by every rule."""

import re
import time

from plumbline.llm import html, licenses, secrets


def test_broken_pages_take_no_longer():
    began = time.time()
    deep = html.extract("<div>x" * 16000, None)
    assert deep == "\n".join("x" * 16000)
    assert html.extract("<a " * 20000, None) == ""
    assert html.extract('<a "' * 20000, None) == ""
    assert html.extract("<div>" * 8000 + "<li>x" * 8000, None) == "\n".join("x" * 8000)
    assert "word" in html.extract("<div>" * 8000 + "</p></section>word" * 8000, None)
    assert time.time() - began < 10


PAGES = [
    ("<div id='main-header-wrap'><article><h1>T</h1><p>One two.</p></article></div>", "T\nOne two."),
    ("<article><p class='menu-item-price'>Main text</p><p>more of it</p></article>", "Main text\nmore of it"),
    ("<article><p>Buy <span class='ad'>NOW</span> this &amp; that</p></article>", "Buy this & that"),
    ("<article><p>a</p><p class='cookie-notice'>we use cookies</p><p>b</p></article>", "a\nb"),
    ("<article><p title=it's>quote</p><p>isn't lost</p></article>", "quote\nisn't lost"),
    ("<nav>menu</nav><main><p>body\n text</p><form>send</form></main><footer>foot</footer>", "body text"),
    ("<body><div><p>lead</p><div class='comments'><p>first!</p></div><p>end of the text</p></div></body>", "lead\nend of the text"),
    ("<article><p>a<script>var x='</p>';</script>b</p><!-- c --><style>p{}</style></article>", "ab"),
    ("<div><section><h2>H</h2><p>text one</p></section><section><p>text two is longer</p></section></div>", "H\ntext one\ntext two is longer"),
    ("<ul><li>one<li>two<ul><li>inner</ul><li>three</ul>", "one\ntwo\ninner\nthree"),
    ("", ""),
    ("<p>never closed", "never closed"),
]


def test_labelled_pages():
    for page, text in PAGES:
        assert html.extract(page, None) == text, page


def test_host_paths_and_extraction(spark):
    page = lambda body: f"<div class='top'>site name</div><div class='post-12'><p>{body}</p></div><div class='side'><a href='/'>x</a></div>"
    rows = [(i, "http://h.example/a", page(f"article number {i} with words")) for i in range(20)] + [(99, None, None), (100, "http://h.example/b", page("short"))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")
    for few in (0, 50_000):
        got = {r.page_id: r.text for r in html.extract_pages(d, max_broadcast=few).collect()}
        assert got[3] == "article number 3 with words" and got[100] == "short" and got[99] == ""


def test_ledger_over_scans(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, None), (3, "token=abcdefgh")], "doc_id long, text string")
    base = secrets.BASE_RULES
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/l")
    ledger.scan(docs, rules=base)
    assert ledger.scanned.count() == 2 * len(base) and ledger.findings.count() == 1
    ledger.scan(docs, rules=base)  # nothing is new
    assert spark.read.parquet(f"{tmp_path}/l/scanned").count() == 2 * len(base)
    more = spark.createDataFrame([(4, "AKIA" + "A" * 20)], "doc_id long, text string").union(docs)
    ledger.scan(more, rules=base)
    assert ledger.scanned.count() == 3 * len(base) and ledger.findings.count() == 2
    changed = secrets.SecretRule("assign", base[0].pattern, ("passw", "token"), 7, 2, True)
    assert changed.key != base[0].key
    ledger.scan(more, rules=(changed,))
    assert ledger.scanned.count() == 3 * len(base) + 3
    # rules in another order keep their kinds
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.attach(more, ledger, rules=base[::-1]).collect()}
    assert got == {1: ["assign"], 2: [], 3: ["assign"], 4: ["access"]}


def sample_of(pattern: str) -> str:
    """Some words that a rule's regex matches: first branches, no optional parts."""
    while "(?:" in pattern:
        pattern = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], pattern, count=1)
    pattern = re.sub(r"\[([^\]])[^\]]*\](?:\{(\d)\})?", lambda m: m[1] * int(m[2] or 1), pattern)
    return re.sub(r".\?", "", pattern)


def test_every_rule_fires(spark):
    found = licenses.rules()
    rows = [(i, f"see {sample_of(r.pattern)} here") for i, r in enumerate(found)]
    for i, text in rows:
        assert re.search(found[i].pattern, text), (found[i], text)
    one = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.labels.split(",") for r in one.collect()}
    # a detection within one of the same or a higher priority is suppressed, so a label may be another rule's
    unlabelled = [found[i] for i in got if got[i] == [""]]
    assert not unlabelled
    texts = licenses._base(spark.createDataFrame(rows, "doc_id long, text string"), "text", found)
    names = texts.select("__rid", "doc_id")
    fired = {(r.doc_id, r.no) for r in licenses.detections(texts, found).join(names, "__rid").select("doc_id", "no").collect()}
    assert not [found[i] for i in range(len(found)) if (i, i) not in fired]


def test_license_windows_move_no_text(spark):
    """What is shuffled for the windows holds lengths and places, no text."""
    docs = spark.createDataFrame([(k, "spdx license identifier mit, all rights reserved") for k in range(20)], "doc_id long, text string")
    found = licenses.detections(licenses._base(docs, "text", licenses.rules()), licenses.rules())
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [part for part in plan.split("\n(") if ") Exchange" in part.splitlines()[0]]
    assert moved and not [part for part in moved if any(c in part for c in ("piece", "__norm", "__marked"))]
    assert found.count() > 0
