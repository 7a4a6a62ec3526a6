"""Secret scanning over an incremental blob ledger, in DataFrame functions only (operator 4).

Every version of every document is content-addressed. The ledger holds which (blob, rule
version) pairs were scanned and what was found; a scan looks at the pairs that it lacks,
each distinct text once, and findings are joined back to every row that holds the blob.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import store

FINDING = "blob string, rule string, kind string, start int, end int"
SCANNED = "blob string, rule string"
#: Blobs share so many marks, which bounds what is sent to every task.
MARKS = 1 << 20


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern``; those that fail a least length drop out.

    ``gate``: a text without any of these (in lower case, if ``fold``) has no match.
    ``group``, ``least``: the group whose length in code points must be ``least`` or more.
    """

    kind: str
    pattern: str
    gate: tuple[str, ...]
    least: int = 0
    group: int = 0
    fold: bool = False

    @property
    def key(self) -> str:
        """Name and version: a changed rule is another one to the ledger."""
        return f"{self.kind}@{zlib.crc32(repr((self.pattern, self.gate, self.least, self.group, self.fold)).encode()):08x}"


BASE_RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "api"), 6, 2, True),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", ("AKIA",), 20),
    SecretRule("hex", r"[0-9a-f]{24,}", (), 24),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    SecretRule("github", r"(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{30,}", ("gh", "github_pat_")),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}", ("AIza",)),
    SecretRule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", ("k_live_", "k_test_")),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (".eyJ",)),
    SecretRule("url_password", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@", ("://",)),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def mark_of(blob: Column) -> Column:
    return F.pmod(F.xxhash64(blob), F.lit(MARKS))


def _matches(rule: SecretRule, number: int, text: Column, low: Column, due: Column) -> Column:
    """All matches of one rule, in order: (kind_no, k, code points before it since the last, its length, whether it counts)."""
    within = low if rule.fold else text
    gate = due
    if rule.gate:
        found = F.lit(False)
        for g in rule.gate:
            found = found | F.contains(within, F.lit(g))
        gate = gate & found
    elif rule.kind == "hex":
        gate = gate & text.rlike(rule.pattern)
    size = lambda x: F.length(x)
    pairs = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda g, m: F.struct(size(g).alias("gap"), size(m).alias("n")),
    )
    if rule.group:
        kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: size(x) >= rule.least)
    else:
        kept = F.transform(pairs, lambda x: x["n"] >= rule.least)
    rows = F.transform(
        F.zip_with(pairs, kept, lambda p, ok: F.struct(p["gap"].alias("gap"), p["n"].alias("n"), ok.alias("ok"))),
        lambda x, k: F.struct(F.lit(number).alias("kind_no"), k.alias("k"), x["gap"].alias("gap"), x["n"].alias("n"), x["ok"].alias("ok")),
    )
    return F.when(gate, F.filter(rows, lambda x: x["n"].isNotNull()))


def find(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Findings of blobs (blob, text, due: keys of the rules to apply), as FINDING says."""
    text, low = F.col("text"), F.col("low")
    d = blobs.select("blob", "due", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    per_rule = [_matches(r, i, text, low, F.array_contains("due", r.key)) for i, r in enumerate(rules)]
    d = d.select("blob", F.explode(F.flatten(F.array_compact(F.array(*per_rule)))).alias("m")).select("blob", "m.*")
    upto = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy("blob", "kind_no").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keys = F.array(*[F.lit(r.key) for r in rules])
    return (
        d.withColumn("end", upto.cast("int")).where("ok")
        .select("blob", F.get(keys, F.col("kind_no")).alias("rule"), F.get(kinds, F.col("kind_no")).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")
    )


class Ledger:
    """Tables ``scanned`` and ``findings`` below a folder; scans append to them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED).distinct()

    @property
    def findings(self) -> DataFrame:
        """Once each; a scan that failed between its two writes leaves doubles behind."""
        return self._read("findings", FINDING).distinct()

    def scan(self, docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> None:
        """Scan what is new among ``docs``: unseen texts for all rules, seen ones for new rules only."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        versions = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        seen = self._read("scanned", SCANNED)
        written = None
        if seen.isEmpty():
            new = versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", keys)
            done = versions.select("blob").distinct().withColumn("due", keys)
        else:
            had = seen.groupBy("blob").agg(F.collect_set("rule").alias("had"))
            ids = versions.select("blob").distinct().join(had, "blob", "left")
            due = ids.select("blob", F.array_except(keys, F.coalesce("had", F.array().cast("array<string>"))).alias("due")).where(F.size("due") > 0)
            # written first, so that its size is known: few blobs are sent to the texts, and only theirs are shuffled
            due = written = store.materialize(due, "due")
            new = versions.join(store.small(due), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
            done = due
        # what was found is written before the pairs count as scanned
        find(new, rules).write.mode("append").parquet(f"{self.path}/findings")
        done.select("blob", F.explode("due").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")
        if written is not None:
            store.discard(written)

    def by_blob(self, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
        """A row for each blob with findings of these rules: its spans by start, then rule, then end."""
        # a rule's place is its place among these rules, whatever it was when it was scanned for
        place = F.array_position(F.array(*[F.lit(r.key) for r in rules]), F.col("rule")).cast("int")
        found = self.findings.withColumn("kind_no", place - 1).where("kind_no >= 0")
        return found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind"))).alias("spans"))


def attach(docs: DataFrame, ledger: Ledger, text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``, an array that is empty where nothing was found.

    A null text is the empty blob. Equal rows get equal spans; none is dropped. A hot text is
    one row on the findings' side, so its rows can be split. An empty table stays empty; other
    columns are kept, but for one named ``spans``, which is replaced.

    Every task holds the marks of all blobs with findings, ``MARKS`` numbers at most. Only rows with
    one of them are shuffled to the findings; the others, whose blob has none for sure, stay where
    they are read. ``docs`` is read twice, so its texts must be the same both times.
    """
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    d = docs.drop("spans").withColumn("__blob", blob_of(F.col(text)))
    d = d.withColumn("__mark", mark_of(F.col("__blob")))
    right = ledger.by_blob(rules).withColumnRenamed("blob", "__blob")
    marks = F.broadcast(right.select(mark_of(F.col("__blob")).alias("__mark")).distinct())
    marked = d.join(marks, "__mark", "left_semi").join(right, "__blob", "left").withColumn("spans", F.coalesce("spans", none))
    clear = d.join(marks, "__mark", "left_anti").withColumn("spans", none)
    return marked.unionByName(clear).drop("__blob", "__mark")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(
        spans,
        start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, parts).otherwise(text)
