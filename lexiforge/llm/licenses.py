"""License scan: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and reduced to its words, one space apart.  Each rule is a
regular expression over whole words with a keyword that all its matches contain, a
label, a weight and a place in the order.  A text without any rule's stem is done after
one look; otherwise the rules whose keyword it has are run, and overlapping detections
are resolved: one that lies inside another is suppressed by it, and of equal ones, or of
two that overlap in part, the first in the order of the rules stays.

The rules are built from families of licenses, their versions and the phrases that
grant or name them, more than four hundred in all.  Only built-in functions are used; the
scan is a map without any shuffle, and its cost beyond reading is paid only for texts
that pass the prefilter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import UPPER, text_of

#: Words of the lower-cased text, and the same over a text with capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: A match of any rule has one of these stems (for "cc", "by" too).
STEMS = ("licen", "reserved", "copyright", "spdx", "creative", "domain", "warrant", "redistribut", "permission", "gpl", "copyleft", "proprietary", "cc0", "bsd", "reproduced")

#: label, pattern of the name, keyword, versions
FAMILIES = (
    ("apache", r"apache(?: software)? licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", "licen", ()),
    ("bsd", r"(?:(?:new|modified|revised|simplified|original) )?bsd(?: style)? licen[cs]e", "bsd", ()),
    ("bsd-2-clause", r"bsd (?:2|two) clause(?: licen[cs]e)?", "bsd", ()),
    ("bsd-3-clause", r"bsd (?:3|three) clause(?: licen[cs]e)?", "bsd", ()),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "general public", ("1.0", "2.0", "2", "3.0", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", ("2.0", "2", "2.1", "3.0", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", ("1.0", "1", "3.0", "3")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "documentation", ("1.1", "1.2", "1.3")),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e", "eclipse", ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[cs]e", "distribution", ("1.0", "1.1")),
    ("cpl", r"common public licen[cs]e", "common public", ("1.0",)),
    ("ipl", r"ibm public licen[cs]e", "ibm", ("1.0",)),
    ("eupl", r"european union public licen[cs]e", "european", ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("afl", r"academic free licen[cs]e", "academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", r"open software licen[cs]e", "open software", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("ofl", r"(?:sil )?open font licen[cs]e", "open font", ("1.0", "1.1")),
    ("odbl", r"open database licen[cs]e", "open database", ("1.0",)),
    ("odc-by", r"open data commons attribution licen[cs]e", "data commons", ("1.0",)),
    ("bsl", r"boost software licen[cs]e", "boost", ("1.0",)),
    ("busl", r"business source licen[cs]e", "business", ("1.1",)),
    ("sspl", r"server side public licen[cs]e", "server side", ("1.0", "1")),
    ("elastic", r"elastic licen[cs]e", "elastic", ("1.0", "2.0")),
    ("isc", r"isc licen[cs]e", "isc", ()),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("psf", r"python(?: software foundation)? licen[cs]e", "python", ("2.0", "2")),
    ("php", r"php licen[cs]e", "php", ("3.0", "3.01")),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft", ()),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft", ()),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", ()),
    ("openssl", r"openssl licen[cs]e", "openssl", ()),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ()),
    ("ruby", r"ruby licen[cs]e", "ruby", ()),
    ("vim", r"vim licen[cs]e", "vim", ()),
    ("w3c", r"w3c(?: software)? licen[cs]e", "w3c", ()),
    ("unlicense", r"(?:the )?unlicen[cs]e", "unlicen", ()),
    ("wtfpl", r"do what the f\w+ you want to public licen[cs]e", "do what", ()),
    ("cecill", r"cecill(?: free software)? licen[cs]e", "cecill", ("1.0", "2.0", "2.1")),
    ("zpl", r"zope public licen[cs]e", "zope", ("1.1", "2.0", "2.1")),
    ("qpl", r"q public licen[cs]e", "public licen", ("1.0",)),
    ("upl", r"universal permissive licen[cs]e", "permissive", ("1.0",)),
    ("ecl", r"educational community licen[cs]e", "educational", ("1.0", "2.0")),
    ("npl", r"netscape public licen[cs]e", "netscape", ("1.0", "1.1")),
    ("apsl", r"apple public source licen[cs]e", "apple", ("1.0", "1.1", "1.2", "2.0")),
    ("lppl", r"latex project public licen[cs]e", "latex", ("1.0", "1.1", "1.2", "1.3")),
    ("rpl", r"reciprocal public licen[cs]e", "reciprocal", ("1.1", "1.5")),
)
#: Creative Commons: label, words after "cc", words after "creative commons"
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: label, pattern, keyword, weight of phrases that belong to no family
PHRASES = (
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 0.9),
    ("cc0", r"creative commons zero(?: v?1 0)?(?: universal)?", "creative commons", 0.9),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 0.9),
    ("public-domain", r"public domain dedication", "public domain", 0.8),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use", 1.0),
    ("warranty", r"provided as is without warranty of any kind", "as is", 0.7),
    ("warranty", r"without any warranty", "warranty", 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.6),
    ("copyright", r"copyright holders?", "copyright", 0.4),
    ("proprietary", r"proprietary and confidential", "proprietary", 0.8),
    ("proprietary", r"no part of this (?:work|publication|document) may be reproduced", "reproduced", 0.8),
    ("copyleft", r"copyleft", "copyleft", 0.5),
    ("gpl", r"gplv?[123]?", "gpl", 0.6),
    ("lgpl", r"lgplv?[23]?", "lgpl", 0.6),
    ("agpl", r"agplv?[13]?", "agpl", 0.6),
)
GRANT = r"(?:(?:this|the) (?:work|text|document|file|software|project|program|content|article|page) )?(?:is |are )?(?:licen[cs]ed|released|distributed|available|published|shared|dual licen[cs]ed) under (?:the |a |an )?(?:terms of the )?"


@dataclass(frozen=True)
class Rule:
    """One signature; ``base`` marks the three base phrases."""

    label: str
    pattern: str
    keyword: str
    weight: float
    base: bool = False


def rules() -> list[Rule]:
    """All rules in their order, the most specific first."""

    def version(v: str) -> str:
        return r"(?: version| v)? ?" + v.replace(".", " ")

    out: list[Rule] = []
    named = [(label, name, keyword, versions) for label, name, keyword, versions in FAMILIES]
    named += [(label, f"cc {short}", f"cc {short}", COMMONS_VERSIONS) for label, short, _ in COMMONS[::-1]]
    named += [(label, f"creative commons {long}", "creative commons", COMMONS_VERSIONS) for label, _, long in COMMONS[::-1]]
    for label, name, keyword, versions in named:
        for v in versions:
            out.append(Rule(f"{label}-{v}", GRANT + name + version(v) + r"(?: only| or later| or any later version)?", keyword, 1.0))
    for label, name, keyword, versions in named:
        for v in versions:
            out.append(Rule(f"{label}-{v}", name + version(v) + r"(?: only| or later| or any later version)?", keyword, 0.9))
    out += [Rule(label, GRANT + name, keyword, 0.9) for label, name, keyword, _ in named]
    out += [Rule(label, r"spdx licen[cs]e identifier " + label.replace("-", " ") + r"(?: \d+)*(?: only| or later)?", "spdx", 1.0) for label in dict.fromkeys(n[0] for n in named)]
    out += [Rule(label, name, keyword, 0.8) for label, name, keyword, _ in named]
    out += [Rule(label, pattern, keyword, weight) for label, pattern, keyword, weight in PHRASES]
    out += [Rule(label, phrase, phrase, 0.7, base=True) for phrase, label in BASE]
    return out


def _literal(known: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("nth"),
                F.lit(r.label).alias("label"),
                F.lit(f"(?<![^ ])(?:{r.pattern})(?![^ ])").alias("pattern"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.weight).alias("weight"),
                F.lit(r.base).alias("base"),
            )
            for i, r in enumerate(known)
        ]
    )


#: Detections of all rules: each rule is matched once, its matches are fenced in, and the
#: spaces before a fence tell its word.
_FOUND = r"""
array_sort(flatten(transform(
  filter(
    transform(hits, r -> named_struct('r', r, 'parts', split(regexp_replace(norm, r.pattern, '\u0001$0\u0002'), '\u0001'))),
    x -> size(x.parts) > 1),
  x -> aggregate(
    slice(x.parts, 2, size(x.parts)),
    named_struct(
      'at', length(x.parts[0]) - length(replace(x.parts[0], ' ', '')),
      'found', cast(array() as array<struct<start: int, inverse: int, nth: int, label: string, weight: double, base: boolean>>)
    ),
    (acc, p) -> named_struct(
      'at', acc.at + length(p) - length(replace(p, ' ', '')),
      'found', array_append(acc.found, named_struct(
        'start', acc.at,
        'inverse', length(replace(substring_index(p, '\u0002', 1), ' ', '')) - length(substring_index(p, '\u0002', 1)) - 1,
        'nth', x.r.nth, 'label', x.r.label, 'weight', x.r.weight, 'base', x.r.base))
    ),
    acc -> acc.found
  ))))"""

#: Detections sorted by start, longest first, then the rules' order: one that doesn't
#: reach beyond all before it lies inside one of them and is suppressed.  Those that are
#: left have rising starts and ends; of two that overlap the one earlier in the order stays.
_SWEEP = """
aggregate(
  aggregate(
    found,
    named_struct('reach', -1, 'kept', cast(array() as array<struct<start: int, end: int, nth: int, label: string, weight: double>>)),
    (acc, d) -> if(d.start - d.inverse > acc.reach,
      named_struct('reach', d.start - d.inverse, 'kept',
        array_append(acc.kept, named_struct('start', d.start, 'end', d.start - d.inverse, 'nth', d.nth, 'label', d.label, 'weight', d.weight))),
      acc),
    acc -> acc.kept
  ),
  cast(array() as array<struct<start: int, end: int, nth: int, label: string, weight: double>>),
  (acc, d) -> case
    when size(acc) = 0 or element_at(acc, -1).end <= d.start then array_append(acc, d)
    when d.nth < element_at(acc, -1).nth then array_append(slice(acc, 1, size(acc) - 1), d)
    else acc end
)"""


def scan(docs: DataFrame) -> DataFrame:
    """License findings of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (all places of base phrases), first_word and
    last_word (smallest and largest start of these, null without any), base_labels,
    labels (the rules' after suppression, and the base ones) and score (the largest
    weight of a detection that stays, else 0).  A null text counts as empty, repeated
    rows are scanned one by one, other columns are ignored, an empty table gives no rows.
    """
    low = F.lower(text_of())
    stems = [F.contains(low, F.lit(s)) for s in STEMS]
    passes = F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by"))
    for stem in stems:
        passes = passes | stem
    words = F.translate(text_of(), UPPER, UPPER.lower())
    rows = docs.select("doc_id", text_of().alias("text"), F.regexp_count(text_of(), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    rows = rows.select("doc_id", "n_words", F.when(passes, F.trim(F.regexp_replace(words, GAP, " "))).alias("norm"))
    known = rules()
    hits = F.filter(_literal(known), lambda r: F.contains(F.col("norm"), r["keyword"]))
    rows = rows.withColumn("hits", F.when(F.col("norm").isNotNull(), hits))
    rows = rows.select("doc_id", "n_words", F.when(F.size("hits") > 0, F.expr(_FOUND)).alias("found"))
    base = F.filter("found", lambda d: d["base"])
    rows = rows.select("doc_id", "n_words", base.alias("base"), F.expr(_SWEEP).alias("kept"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_union(F.transform("kept", lambda d: d["label"]), base_labels)), ","), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
