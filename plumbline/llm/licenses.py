"""License scanning with ordered signature rules, in DataFrame functions only (operator 9).

Each rule is a hand-written regex over a text's words joined by single spaces, behind a
keyword that the text must hold before the regex runs. Detections of all rules meet per
document: one that lies within a detection of the same or a higher priority is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import store

#: Everything that ends a word: ASCII but letters and digits.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases of the base and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: SPDX label; keyword; name as a regex over words; words of the license's address, if it has one.
FAMILIES = """
Apache-1.0; apache; apache (?:software )?license(?: version)? 1 0; apache org licenses license 1 0
Apache-1.1; apache; apache (?:software )?license(?: version)? 1 1; apache org licenses license 1 1
Apache-2.0; apache; apache (?:software )?license(?: version)? 2(?: 0)?; apache org licenses license 2 0
MIT; mit; (?:the )?mit license; opensource org licenses mit
MIT-0; mit; mit no attribution(?: license)?; opensource org licenses mit 0
X11; x11; x11 license;
BSD-2-Clause; bsd; (?:2|two) clause (?:simplified )?bsd(?: license)?; opensource org licenses bsd 2 clause
BSD-3-Clause; bsd; (?:(?:3|three) clause|new|revised|modified) bsd(?: license)?; opensource org licenses bsd 3 clause
BSD-4-Clause; bsd; (?:(?:4|four) clause|original) bsd(?: license)?;
BSD-1-Clause; bsd; (?:1|one) clause bsd(?: license)?;
0BSD; bsd; (?:0|zero) clause bsd(?: license)?; opensource org licenses 0bsd
GPL-1.0; general public; (?:gnu )?general public license(?: gpl)?(?: version| v)? 1(?: 0)?; gnu org licenses (?:old licenses )?gpl 1 0
GPL-2.0; general public; (?:gnu )?general public license(?: gpl)?(?: version| v)? 2(?: 0)?; gnu org licenses (?:old licenses )?gpl 2 0
GPL-3.0; general public; (?:gnu )?general public license(?: gpl)?(?: version| v)? 3(?: 0)?; gnu org licenses gpl(?: 3 0)?
LGPL-2.0; general public; (?:gnu )?library general public license(?: version| v)? 2(?: 0)?; gnu org licenses (?:old licenses )?lgpl 2 0
LGPL-2.1; general public; (?:gnu )?lesser general public license(?: version| v)? 2 1; gnu org licenses (?:old licenses )?lgpl 2 1
LGPL-3.0; general public; (?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?; gnu org licenses lgpl(?: 3 0)?
AGPL-1.0; affero; affero general public license(?: version| v)? 1(?: 0)?; affero org oagpl
AGPL-3.0; affero; (?:gnu )?affero general public license(?: version| v)? 3(?: 0)?; gnu org licenses agpl(?: 3 0)?
GFDL-1.1; documentation; (?:gnu )?free documentation license(?: version)? 1 1; gnu org licenses (?:old licenses )?fdl 1 1
GFDL-1.2; documentation; (?:gnu )?free documentation license(?: version)? 1 2; gnu org licenses (?:old licenses )?fdl 1 2
GFDL-1.3; documentation; (?:gnu )?free documentation license(?: version)? 1 3; gnu org licenses fdl(?: 1 3)?
MPL-1.0; mozilla; mozilla public license(?: version| v)? 1 0; mozilla org mpl 1 0
MPL-1.1; mozilla; mozilla public license(?: version| v)? 1 1; mozilla org mpl 1 1
MPL-2.0; mozilla; mozilla public license(?: version| v)? 2 0; mozilla org mpl 2 0
EPL-1.0; eclipse; eclipse public license(?: version| v)? 1 0; eclipse org legal epl v10
EPL-2.0; eclipse; eclipse public license(?: version| v)? 2 0; eclipse org legal epl (?:v20|2 0)
CDDL-1.0; distribution; common development and distribution license(?: version)? 1 0; opensource org licenses cddl 1 0
CDDL-1.1; distribution; common development and distribution license(?: version)? 1 1;
CPL-1.0; common public; common public license(?: version)? 1 0; opensource org licenses cpl 1 0
IPL-1.0; ibm; ibm public license(?: version)? 1 0;
EUPL-1.1; european; european union public licen[cs]e(?: version| v)? 1 1;
EUPL-1.2; european; european union public licen[cs]e(?: version| v)? 1 2; joinup ec europa eu
CECILL-2.1; cecill; cecill (?:free software )?license(?: agreement)?(?: version| v)? 2 1; cecill info licences licence cecill v2 1
CECILL-B; cecill; cecill b(?: free software)?(?: license)?; cecill info licences licence cecill b
CECILL-C; cecill; cecill c(?: free software)?(?: license)?; cecill info licences licence cecill c
ISC; isc; isc license; opensource org licenses isc
Zlib; zlib; zlib(?: libpng)? license; zlib net zlib license
Libpng; libpng; libpng license;
Unlicense; unlicense; the unlicense; unlicense org
WTFPL; wtfpl; wtfpl; wtfpl net
BSL-1.0; boost; boost software license(?: version)? 1 0; boost org license 1 0
Artistic-1.0; artistic; artistic license(?: version)? 1 0; opensource org licenses artistic license 1 0
Artistic-2.0; artistic; artistic license(?: version)? 2 0; opensource org licenses artistic license 2 0
Perl; perl; same terms as perl(?: itself)?; dev perl org licenses
PSF-2.0; python; python software foundation license(?: version)?(?: 2)?; docs python org 3 license
Ruby; ruby; ruby license; ruby lang org en about license
PHP-3.01; php; php license(?: version)? 3 01; php net license 3 01
OpenSSL; openssl; openssl license; openssl org source license
NCSA; ncsa; (?:university of illinois )?ncsa open source license; opensource org licenses ncsa
AFL-3.0; academic free; academic free license(?: version)? 3 0; opensource org licenses afl 3 0
AFL-2.1; academic free; academic free license(?: version)? 2 1;
OSL-3.0; open software; open software license(?: version)? 3 0; opensource org licenses osl 3 0
OSL-2.1; open software; open software license(?: version)? 2 1;
MS-PL; microsoft; microsoft public license; opensource org licenses ms pl
MS-RL; microsoft; microsoft reciprocal license; opensource org licenses ms rl
APSL-2.0; apple; apple public source license(?: version)? 2 0; opensource apple com apsl
SPL-1.0; sun; sun public license(?: version)? 1 0;
QPL-1.0; q public; q public license(?: version)? 1 0;
NPL-1.1; netscape; netscape public license(?: version)? 1 1;
OFL-1.0; font; (?:sil )?open font license(?: version)? 1 0;
OFL-1.1; font; (?:sil )?open font license(?: version)? 1 1; scripts sil org ofl
CC0-1.0; cc0; cc0(?: universal)?(?: 1 0)?; creativecommons org publicdomain zero 1 0
CC-BY-1.0; attribution; creative commons attribution 1 0(?: generic)?; creativecommons org licenses by 1 0
CC-BY-2.0; attribution; creative commons attribution 2 0(?: generic)?; creativecommons org licenses by 2 0
CC-BY-2.5; attribution; creative commons attribution 2 5(?: generic)?; creativecommons org licenses by 2 5
CC-BY-3.0; attribution; creative commons attribution 3 0(?: unported)?; creativecommons org licenses by 3 0
CC-BY-4.0; attribution; creative commons attribution 4 0(?: international)?; creativecommons org licenses by 4 0
CC-BY-SA-2.0; sharealike; creative commons attribution sharealike 2 0; creativecommons org licenses by sa 2 0
CC-BY-SA-2.5; sharealike; creative commons attribution sharealike 2 5; creativecommons org licenses by sa 2 5
CC-BY-SA-3.0; sharealike; creative commons attribution sharealike 3 0; creativecommons org licenses by sa 3 0
CC-BY-SA-4.0; sharealike; creative commons attribution sharealike 4 0; creativecommons org licenses by sa 4 0
CC-BY-ND-3.0; noderiv; creative commons attribution noderiv(?:ative)?s 3 0; creativecommons org licenses by nd 3 0
CC-BY-ND-4.0; noderiv; creative commons attribution noderiv(?:ative)?s 4 0; creativecommons org licenses by nd 4 0
CC-BY-NC-3.0; noncommercial; creative commons attribution noncommercial 3 0; creativecommons org licenses by nc 3 0
CC-BY-NC-4.0; noncommercial; creative commons attribution noncommercial 4 0; creativecommons org licenses by nc 4 0
CC-BY-NC-SA-3.0; noncommercial; creative commons attribution noncommercial sharealike 3 0; creativecommons org licenses by nc sa 3 0
CC-BY-NC-SA-4.0; noncommercial; creative commons attribution noncommercial sharealike 4 0; creativecommons org licenses by nc sa 4 0
CC-BY-NC-ND-3.0; noncommercial; creative commons attribution noncommercial noderiv(?:ative)?s 3 0; creativecommons org licenses by nc nd 3 0
CC-BY-NC-ND-4.0; noncommercial; creative commons attribution noncommercial noderiv(?:ative)?s 4 0; creativecommons org licenses by nc nd 4 0
CC-PDDC; public domain; creative commons public domain dedication; creativecommons org licenses publicdomain
PDDL-1.0; public domain; public domain dedication and license(?: 1 0)?; opendatacommons org licenses pddl
ODbL-1.0; database; open (?:data commons open )?database license(?: version)?(?: 1 0)?; opendatacommons org licenses odbl
ODC-By-1.0; data commons; open data commons attribution license(?: 1 0)?; opendatacommons org licenses by
OGL-UK-3.0; government; open government licen[cs]e(?: version| v)? 3 0; nationalarchives gov uk doc open government licence version 3
OGL-UK-2.0; government; open government licen[cs]e(?: version| v)? 2 0; nationalarchives gov uk doc open government licence version 2
etalab-2.0; etalab; etalab (?:open )?licen[cs]e(?: ouverte)?(?: 2 0)?;
Vim; vim; vim license;
TCL; tcl; tcl(?: tk)? license;
ICU; icu; icu license;
Unicode-DFS-2016; unicode; unicode license agreement; unicode org copyright
W3C; w3c; w3c software notice and license; w3 org consortium legal
PostgreSQL; postgresql; postgresql license; opensource org licenses postgresql
Beerware; beer; beer ?ware license;
LPPL-1.3c; latex; latex project public license(?: version)?(?: 1 3c)?; latex project org lppl
SSPL-1.0; server side; server side public license(?: version| v)? 1; mongodb com licensing server side public license
BUSL-1.1; business source; business source license(?: version)? 1 1; mariadb com bsl11
Elastic-2.0; elastic; elastic license(?: version)? 2 0; elastic co licensing elastic license
UPL-1.0; universal permissive; universal permissive license(?: version| v)? 1 0; oss oracle com licenses upl
Sleepycat; sleepycat; sleepycat license;
Watcom-1.0; watcom; sybase open watcom public license(?: version)? 1 0;
RPL-1.5; reciprocal; reciprocal public license(?: version)? 1 5;
"""

#: Rules that belong to no family: label; priority; keyword; regex; weight.
SINGLE = """
gpl; 2; general public; (?:gnu )?general public license; 0.7
lgpl; 2; general public; (?:gnu )?(?:lesser|library) general public license; 0.7
agpl; 2; affero; (?:gnu )?affero general public license; 0.7
gpl; 2; gpl; gpl ?v? ?[123](?: 0)?(?: only| or later)?; 0.7
lgpl; 2; lgpl; lgpl ?v? ?[23](?: [01])?(?: only| or later)?; 0.7
agpl; 2; agpl; agpl ?v? ?3(?: 0)?(?: only| or later)?; 0.7
gpl; 1; gpl; gpl; 0.4
apache; 2; apache; apache license; 0.6
apache; 1; apache; licensed under apache; 0.5
bsd; 2; bsd; bsd(?: style)? license; 0.6
bsd; 3; redistribution; redistribution and use in source and binary forms with or without modification are permitted; 0.9
mit; 3; permission; permission is hereby granted free of charge to any person obtaining a copy of this software; 0.9
isc; 3; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted; 0.9
mpl; 2; mozilla; mozilla public license; 0.6
epl; 2; eclipse; eclipse public license; 0.6
cddl; 2; distribution; common development and distribution license; 0.6
artistic; 2; artistic; artistic license; 0.6
gfdl; 2; documentation; (?:gnu )?free documentation license; 0.6
ofl; 2; font; (?:sil )?open font license; 0.6
cc; 2; creative commons; creative commons(?: public)? license; 0.5
cc-by; 2; attribution; creative commons attribution(?: license)?; 0.6
cc-by-sa; 2; sharealike; creative commons attribution sharealike(?: license)?; 0.6
cc-by-nc; 2; noncommercial; creative commons attribution noncommercial(?: license)?; 0.6
cc-by; 2; cc by; cc by(?: [1-4] [05])?; 0.6
cc-by-sa; 3; cc by; cc by sa(?: [1-4] [05])?; 0.7
cc-by-nd; 3; cc by; cc by nd(?: [1-4] [05])?; 0.7
cc-by-nc; 3; cc by; cc by nc(?: [1-4] [05])?; 0.7
cc-by-nc-sa; 4; cc by; cc by nc sa(?: [1-4] [05])?; 0.8
cc-by-nc-nd; 4; cc by; cc by nc nd(?: [1-4] [05])?; 0.8
public-domain; 2; public domain; (?:released|placed|dedicated) (?:in|into|to) the public domain; 0.7
public-domain; 1; public domain; public domain; 0.3
copyleft; 1; copyleft; copyleft; 0.3
reserved; 2; rights reserved; all rights reserved; 0.5
reserved; 1; rights reserved; (?:some|no) rights reserved; 0.3
copyright; 1; copyright; copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?; 0.3
copyright; 1; copyright; copyright holders?; 0.2
proprietary; 2; proprietary; proprietary (?:and confidential|license|software license); 0.6
proprietary; 2; licensed; licensed materials? property of; 0.6
commercial; 2; commercial license; commercial license(?: agreement)?; 0.5
eula; 2; end user; end user license agreement; 0.6
noncommercial; 2; non commercial; non commercial use only; 0.5
see-license; 1; license; see (?:the )?(?:file )?license(?: txt| md| file)? for (?:details|more information); 0.3
as-is; 1; warrant; without warranties or conditions of any kind; 0.4
as-is; 1; warrant; provided as is without (?:any )?warrant(?:y|ies); 0.4
"""


@dataclass(frozen=True)
class LicenseRule:
    label: str
    priority: int
    keyword: str
    pattern: str
    weight: float


def rules() -> list[LicenseRule]:
    """Every rule, in order. A family gives its SPDX tag, its grant, its name and its address."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, keyword, name, address = (x.strip() for x in line.split(";"))
        words = label.lower().replace("-", " ").replace(".", " ")
        out.append(LicenseRule(label, 4, "spdx", f"spdx license identifier {words}(?: only| or later)?", 1.0))
        out.append(LicenseRule(label, 4, keyword, f"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?: or(?: at your option)? any later version)?", 0.95))
        out.append(LicenseRule(label, 3, keyword, name, 0.8))
        if address:
            out.append(LicenseRule(label, 3, address.split(" ")[0], f"(?:https? )?(?:www )?{address}", 0.85))
    for line in SINGLE.strip().splitlines():
        label, priority, keyword, pattern, weight = (x.strip() for x in line.split(";"))
        out.append(LicenseRule(label, int(priority), keyword, pattern, float(weight)))
    return out


def _at_words(pattern: str) -> str:
    return f"(?i)(?<![^ ])(?:{pattern})(?![^ ])"


def _words_before(prefix: Column) -> Column:
    return (F.size(F.split(prefix, " ", -1)) - 1).cast("long")


def keywords(found_rules: list[LicenseRule]) -> list[str]:
    """What a text must hold one of, in lower case, to be shown to any rule or base phrase."""
    return sorted({r.keyword for r in found_rules} | {phrase for phrase, _ in BASE_PHRASES})


def _prefilter(words: list[str]) -> str:
    """A regex that finds any keyword at the start of a word, where a rule's words can only stand; by first letters, then the rest."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    return "(?<![^ ])(?:" + "|".join(f"{c}(?:{'|'.join(r)})" for c, r in sorted(rest.items())) + ")"


def _base(docs: DataFrame, text: str, found_rules: list[LicenseRule]) -> DataFrame:
    """rid, the caller's columns, n_words and the base; norm for texts with a keyword, else null."""
    d = docs.select("*", F.monotonically_increasing_id().alias("__rid"))
    d = d.withColumn("__w", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BREAK, -1), ""))
    d = d.withColumn("n_words", F.size("__w").cast("long")).withColumn("__norm", F.array_join("__w", " "))
    d = d.withColumn("__low", F.lower("__norm"))
    gate = F.col("__low").rlike(_prefilter(keywords(found_rules)))
    known = F.array(*[F.lit(k) for k in keywords(found_rules)])
    d = d.withColumn("__keys", F.when(gate, F.filter(known, lambda k: F.contains(F.col("__low"), k))))
    d = d.withColumn("__norm", F.when(F.col("__keys").isNotNull(), F.col("__norm"))).drop("__w", "__low", text)
    norm, count, first, last, labels = F.col("__norm"), [], [], [], []
    for phrase, label in BASE_PHRASES:
        p = _at_words(phrase)
        n = F.when(F.contains(F.lower(norm), F.lit(phrase)), F.size(F.split(norm, p, -1)) - 1)
        d = d.withColumn(f"__n_{label}", F.coalesce(n, F.lit(0)).cast("long"))
        has = F.col(f"__n_{label}") > 0
        count.append(F.col(f"__n_{label}"))
        at = F.regexp_instr(norm, F.lit(p))
        first.append(F.when(has, _words_before(F.substring(norm, F.lit(1), at - 1))))
        last.append(F.when(has, _words_before(F.regexp_extract(norm, f"(?s)^(.*){p}", 1))))
        labels.append(F.when(has, F.lit(label)))
    d = d.withColumns({
        "n_base": sum(count[1:], count[0]),
        "first_word": F.least(*first),
        "last_word": F.greatest(*last),
        "__base": F.array_compact(F.array(*labels)),
    })
    return d.drop(*[f"__n_{label}" for _, label in BASE_PHRASES])


def detections(texts: DataFrame, found_rules: list[LicenseRule]) -> DataFrame:
    """Detections (rid, rule, start, end, label, priority, weight, suppressed) of texts (__rid, __norm, __keys).

    A rule's matches are marked by two control characters, which no text of words holds, in one
    pass of its regex; their places are sums of the lengths between the marks.
    """
    spark = texts.sparkSession
    rows = [(i, r.keyword, _at_words(r.pattern), r.label, r.priority, r.weight) for i, r in enumerate(found_rules)]
    table = spark.createDataFrame(rows, "no int, keyword string, pattern string, label string, priority int, weight double")
    d = texts.where("__norm IS NOT NULL").select("__rid", "__norm", F.explode("__keys").alias("keyword"))
    d = d.join(F.broadcast(table), "keyword")  # the hand-written rules, some hundred rows
    d = d.withColumn("__marked", F.regexp_replace("__norm", F.col("pattern"), F.lit("\x01$0\x02"))).where(F.contains("__marked", F.lit("\x01"))).drop("__norm")
    d = d.select("__rid", "no", "label", "priority", "weight", F.posexplode(F.split("__marked", "\x01", -1)).alias("k", "piece"))
    # lengths alone go on to the window, which moves rows; the text stays where it was read
    length = F.length("piece") - F.when(F.col("k") > 0, 1).otherwise(0)
    d = d.withColumns({"size": length, "closes": F.instr("piece", "\x02")}).drop("piece")
    before = F.sum("size").over(W.partitionBy("__rid", "no").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("start", before).where("k > 0").withColumn("end", F.col("start") + F.col("closes") - 1).drop("k", "size", "closes")
    # what comes before in this order and ends no sooner holds the detection within itself
    before = W.partitionBy("__rid").orderBy("start", F.desc("end"), F.desc("priority"), "no").rowsBetween(W.unboundedPreceding, -1)
    levels = sorted({r.priority for r in found_rules})
    reach = F.lit(None).cast("long")
    for p in levels:
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before)).otherwise(reach)
    return d.withColumn("suppressed", F.coalesce(reach >= F.col("end"), F.lit(False)))


def scan(docs: DataFrame, text: str = "text", found_rules: list[LicenseRule] | None = None) -> DataFrame:
    """``docs`` without its text, with n_words, the base, labels and score; one row for each row.

    Null and empty texts have no words and no labels; repeated rows are scanned each on its
    own. The first pass is written, so that row numbers hold when executors are lost.
    ``score`` is the greatest weight among what was found: 0.3 to 1, or 0.
    """
    found_rules = rules() if found_rules is None else found_rules
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = store.materialize(_base(docs.drop(*own), text, found_rules), "licenses")
    per_row = (
        detections(rows, found_rules).where(~F.col("suppressed"))
        .groupBy("__rid").agg(F.collect_set("label").alias("__more"), F.max("weight").alias("__weight"))
    )
    none = F.array().cast("array<string>")
    d = rows.drop("__norm", "__keys").join(per_row, "__rid", "left")
    base_weight = F.when(F.size("__base") > 0, 0.5).otherwise(0.0)
    return d.withColumns({
        "base_labels": F.array_join(F.sort_array("__base"), ","),
        "labels": F.array_join(F.sort_array(F.array_union("__base", F.coalesce("__more", none))), ","),
        "score": F.greatest(F.coalesce("__weight", F.lit(0.0)), base_weight),
    }).drop("__rid", "__base", "__more", "__weight")
