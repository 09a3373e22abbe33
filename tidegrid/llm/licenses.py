"""License scans: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched between the words of a text, which stand lower-case with one space between them.  It is
    tried only where ``keyword`` stands.  Rules of smaller priority are surer."""

    label: str
    priority: int
    keyword: str
    pattern: str


#: Words in the sense of a scan: anything but ASCII characters that are no letters or digits.
SCAN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Every rule's pattern holds one of these; texts without any are not looked at further.
ANCHORS = r"(?i)(?=[lrpcsg])(?:licen|reserved|public|cc0|cc[^a-z0-9]|copyright|spdx|gpl|permission|redistribut)"

#: The base: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label | keyword | name as a pattern over words | the identifier's words
FAMILIES = """
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0 | apache 1 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1 | apache 1 1
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)? | apache 2 0
mit | mit | (?:mit|expat) licen[cs]e | mit
mit-0 | mit | mit (?:no attribution|0) licen[cs]e | mit 0
bsd-2-clause | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e | bsd 2 clause
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]e | bsd 3 clause
bsd-4-clause | bsd | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[cs]e | bsd 4 clause
bsd | bsd | (?:bsd|berkeley software distribution)(?: style)? licen[cs]e | 0bsd
gpl-1.0 | general public | (?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)? | gpl 1 0
gpl-2.0 | general public | (?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)? | gpl 2 0
gpl-3.0 | general public | (?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)? | gpl 3 0
gpl | general public | (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? | gpl
lgpl-2.0 | library general public | (?:gnu )?library general public licen[cs]e(?: (?:version |v )?2(?: 0)?)? | lgpl 2 0
lgpl-2.1 | lesser general public | (?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1 | lgpl 2 1
lgpl-3.0 | lesser general public | (?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)? | lgpl 3 0
lgpl | lesser general public | (?:gnu )?lesser general public licen[cs]e | lgpl
agpl-1.0 | affero | affero general public licen[cs]e (?:version |v )?1(?: 0)? | agpl 1 0
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e(?: (?:version |v )?3(?: 0)?)? | agpl 3 0
fdl-1.1 | free documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 1 | gfdl 1 1
fdl-1.2 | free documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 2 | gfdl 1 2
fdl-1.3 | free documentation | (?:gnu )?free documentation licen[cs]e(?: (?:version |v )?1 3)? | gfdl 1 3
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:version |v )?1 0 | mpl 1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v )?1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: (?:version |v )?2(?: 0)?)? | mpl 2 0
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version |v )?1(?: 0)? | epl 1 0
epl-2.0 | eclipse | eclipse public licen[cs]e(?: (?:version |v )?2(?: 0)?)? | epl 2 0
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: (?:version |v )?1(?: 0)?)? | edl 1 0
cpl-1.0 | common public | common public licen[cs]e(?: (?:version |v )?1(?: 0)?)? | cpl 1 0
cddl-1.0 | common development | common development and distribution licen[cs]e (?:version |v )?1 0 | cddl 1 0
cddl-1.1 | common development | common development and distribution licen[cs]e(?: (?:version |v )?1 1)? | cddl 1 1
eupl-1.1 | european union | european union public licen[cs]e (?:version |v )?1 1 | eupl 1 1
eupl-1.2 | european union | european union public licen[cs]e(?: (?:version |v )?1 2)? | eupl 1 2
isc | isc | isc licen[cs]e | isc
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | libpng licen[cs]e(?: (?:version |v )?2)? | libpng
bsl-1.0 | boost | boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)? | bsl 1 0
busl-1.1 | business source | business source licen[cs]e(?: (?:version |v )?1 1)? | busl 1 1
unlicense | unlicen | (?:the )?unlicen[cs]e | unlicense
wtfpl | public license | do what the fuck you want to public licen[cs]e | wtfpl
artistic-1.0 | artistic | artistic licen[cs]e (?:version |v )?1 0 | artistic 1 0
artistic-2.0 | artistic | artistic licen[cs]e(?: (?:version |v )?2(?: 0)?)? | artistic 2 0
python-2.0 | python | python (?:software foundation )?licen[cs]e(?: (?:version |v )?2)? | python 2 0
php-3.01 | php | php licen[cs]e(?: (?:version |v )?3 01)? | php 3 01
ruby | ruby | ruby licen[cs]e | ruby
perl | perl | same terms as perl itself under its licen[cs]e | perl
openssl | openssl | openssl licen[cs]e | openssl
postgresql | postgresql | postgresql licen[cs]e | postgresql
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)? | ofl 1 1
odbl-1.0 | open database | open database licen[cs]e(?: (?:version |v )?1 0)? | odbl 1 0
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e(?: (?:version |v )?1 0)? | odc by 1 0
pddl-1.0 | open data commons | open data commons public domain dedication and licen[cs]e | pddl 1 0
ms-pl | microsoft | microsoft public licen[cs]e | ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl
sspl-1.0 | server side | server side public licen[cs]e(?: (?:version |v )?1)? | sspl 1 0
elastic-2.0 | elastic | elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)? | elastic 2 0
afl-3.0 | academic free | academic free licen[cs]e(?: (?:version |v )?3 0)? | afl 3 0
osl-3.0 | open software | open software licen[cs]e(?: (?:version |v )?3 0)? | osl 3 0
qpl-1.0 | q public | q public licen[cs]e(?: (?:version |v )?1 0)? | qpl 1 0
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e | ncsa
vim | vim | vim licen[cs]e | vim
w3c | w3c | w3c (?:software notice and |software and document )?licen[cs]e | w3c
upl-1.0 | universal permissive | universal permissive licen[cs]e(?: (?:version |v )?1 0)? | upl 1 0
rail | responsible ai | (?:open |bigscience )?responsible ai licen[cs]e | openrail
"""

#: label | priority | keyword | pattern: sentences of the licenses themselves, and notices
SENTENCES = """
mit | 2 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy
isc | 2 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 2 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | neither the name | neither the name of .{1,80} may be used to endorse or promote products derived from this software without specific prior written permission
apache-2.0 | 2 | apache org | (?:https? )?(?:www )?apache org licen[cs]es licen[cs]e 2 0
gpl | 2 | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 4 | gnu org | gnu org (?:licen[cs]es|copyleft) gpl(?: \\w+)?
gpl-2.0 | 3 | gplv2 | licen[cs]ed under (?:the )?gplv2
gpl-3.0 | 3 | gplv3 | licen[cs]ed under (?:the )?gplv3
gpl | 4 | gpl | licen[cs]ed under (?:the )?gpl
lgpl | 4 | lgpl | licen[cs]ed under (?:the )?lgpl
agpl-3.0 | 4 | agpl | licen[cs]ed under (?:the )?agpl(?:v3)?
mpl-2.0 | 2 | mozilla org | this source code form is subject to the terms of the mozilla public licen[cs]e
cc0-1.0 | 2 | cc0 | cc0 (?:1 0 )?(?:universal )?(?:public domain dedication|licen[cs]e)
cc0-1.0 | 3 | cc0 | cc0(?: 1 0)?
public-domain | 3 | public domain | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
public-domain | 4 | public domain | public domain
unlicense | 2 | unencumbered | this is free and unencumbered software released into the public domain
copyright | 4 | copyright | copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?
copyright | 3 | copyright | copyright (?:c )?(?:19|20)\\d\\d .{1,60}? all rights reserved
reserved | 3 | all rights reserved | all rights reserved
reserved | 3 | rights reserved | (?:some|no) rights reserved
proprietary | 2 | proprietary | (?:proprietary|confidential) (?:and (?:proprietary|confidential) )?(?:software|information) .{0,80}?(?:reserved|permission|licen[cs]e)
no-redistribution | 3 | redistribut | (?:may not be|do not|no) (?:copied or |reproduced or |reproduction or )?(?:redistributed|redistribute|redistribution)
by-permission | 3 | permission | (?:reprinted|reproduced|used) (?:by|with) (?:kind )?permission
educational | 4 | licen | (?:for|under an?) educational (?:use|purposes)(?: only)? licen[cs]e
non-commercial | 3 | licen | non ?commercial (?:use |only )?licen[cs]e
"""

#: Parts of a Creative Commons name, and its versions.
CC_PARTS, CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}

#: How a notice names a license that follows.
UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?"

CONFIDENCE = (0.99, 0.95, 0.8, 0.5)


def rules() -> list[Rule]:
    """All rules, in their order: for each family its identifier, a notice and its name; the sentences; the Creative
    Commons names by parts and version."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, keyword, name, tag = (x.strip() for x in line.split(" | "))
        out += [
            Rule(label, 1, "spdx", f"spdx licen[cs]e identifier {tag}(?: only| or later)?"),
            Rule(label, 2, keyword, UNDER + name),
            Rule(label, 3, keyword, name),
        ]
    for line in SENTENCES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, int(priority), keyword, pattern.replace("\\\\", "\\")))
    for parts in CC_PARTS:
        label, words = "cc-" + parts.replace(" ", "-"), " ".join(CC_WORDS[p] for p in parts.split())
        for version in CC_VERSIONS:
            exact = f"{label}-{version.replace(' ', '.')}"
            out += [
                Rule(exact, 1, "spdx", f"spdx licen[cs]e identifier cc {parts} {version}"),
                Rule(exact, 2, "cc by", f"{UNDER}cc {parts} {version}"),
                Rule(exact, 2, "cc by", f"cc {parts} {version}"),
                Rule(exact, 2, "creative commons", f"creative commons {words} {version}(?: \\w+)? (?:public )?licen[cs]e"),
            ]
        out += [Rule(label, 3, "cc by", f"cc {parts}"), Rule(label, 3, "creative commons", f"creative commons {words} (?:public )?licen[cs]e")]
    return out


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, summary) of every whole text.

    Findings: ``id, __text`` (the text's hash), ``label, priority, first_word, last_word`` of each detection that
    stands: no detection of the same or a surer priority covers it.  ``priority`` 0 marks the base phrases, which are
    not set aside.  Summary: one row per row of ``docs``: ``id, n_words, n_base, first_word, last_word, base_labels,
    labels, score``; first and last word are the places of the base.

    Null text: as empty.  No words or nothing found: counts 0, places null, labels empty, score 0.  Repeated rows and
    ids: each row has its own.  Null ids are kept.  Overlapping detections of equal span: the earlier rule stands.
    Empty table: no rows.  Other columns are not read.
    """
    all_rules = rules()
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    summary = own.select("id", F.xxhash64("t").alias("__text"), F.regexp_count("t", F.lit(SCAN_WORD)).cast("long").alias("n_words"))

    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, GAP, " ")), F.lit(" "))
    listed = [(p, p, lab, 0) for p, lab in BASE] + [(r.keyword, r.pattern, r.label, r.priority) for r in all_rules]
    literal = ",".join(f"named_struct('n',{n},'k',{_quoted(k)},'p',{_quoted(f'(?<= )(?:{p})(?= )')})" for n, (k, p, _, _) in enumerate(listed))
    gated = own.where(F.col("t").rlike(ANCHORS)).select("id", F.xxhash64("t").alias("__text"), words.alias("w"))
    tried = gated.select("id", "__text", "w", F.explode(F.filter(F.expr(f"array({literal})"), lambda r: F.contains(F.col("w"), r["k"]))).alias("r"))
    places = tried.select(
        "id", "__text", F.col("r.n").alias("n"),
        F.transform(F.split("w", F.col("r.p"), -1), _spaces).alias("between"),
        F.transform(F.regexp_extract_all("w", F.col("r.p"), F.lit(0)), _spaces).alias("inside"),
    ).where(F.size("inside") > 0).select("id", "__text", "n", F.posexplode(F.arrays_zip("between", "inside")).alias("i", "x"))
    places = places.where(F.col("x.inside").isNotNull()).select("id", "__text", "n", "i", "x.*").distinct()
    so_far = Window.partitionBy("id", "__text", "n").orderBy("i")
    first = F.sum("between").over(so_far) + F.coalesce(F.sum("inside").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    hits = places.select("id", "__text", "n", first.cast("long").alias("first_word"), "inside").withColumn("last_word", F.col("first_word") + F.col("inside"))
    label = F.element_at(F.array(*[F.lit(lab) for *_, lab, _ in listed]), F.col("n") + 1)
    priority = F.element_at(F.array(*[F.lit(p) for *_, p in listed]), F.col("n") + 1)
    hits = hits.select("id", "__text", "n", label.alias("label"), priority.alias("priority"), "first_word", "last_word")

    # In the order of starts, longer first, a detection is covered if one before it ends no sooner.
    earlier = Window.partitionBy("id", "__text").orderBy("first_word", F.desc("last_word"), "priority", "n").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in range(1, len(CONFIDENCE) + 1):
        reach = F.max(F.when((F.col("priority") <= level) & (F.col("priority") > 0), F.col("last_word"))).over(earlier)
        covered = covered | ((F.col("priority") == level) & F.coalesce(reach >= F.col("last_word"), F.lit(False)))
    findings = hits.withColumn("__covered", covered).where(~F.col("__covered")).drop("__covered", "n")

    base = F.col("priority") == 0
    sure = F.element_at(F.array(*[F.lit(x) for x in (CONFIDENCE[2], *CONFIDENCE)]), F.col("priority") + 1)
    per = findings.groupBy(F.col("id").alias("id2"), F.col("__text").alias("text2")).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(sure).alias("score"),
    )
    summary = summary.join(per, F.col("id").eqNullSafe(F.col("id2")) & (F.col("__text") == F.col("text2")), "left").select(
        F.col("id").alias(id), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return findings, summary


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))[1]
