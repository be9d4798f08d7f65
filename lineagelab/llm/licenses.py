"""License scans: ordered signature rules with keyword gates and interval suppression.

The text becomes a line in which every word stands between two blanks of its own, so
a signature can be matched on word limits without look-around. Every rule has a
label, a priority, a gate (a word that every match contains, looked up before the
regular expression is tried) and a regular expression over words. Names that may be
glued ('gpl v2', 'gplv2', 'gpl2') have one rule per form. A detection is an
interval of words; it is dropped when it lies inside an interval of higher
priority, or inside a longer one of equal priority. The base phrases are counted on
their own and keep their labels whatever else is found.

All of it is done row by row inside one projection: no shuffle, no join. Documents
that contain no gate at all skip the rules.

Score: the strength of the best kept detection, ``priority / 4`` (0 without any).

Edge cases: null and empty texts have no words, no label and score 0; repeated rows
are scanned one by one; phrases are counted at every place, overlaps included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_line

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int                  # 4: name and version, 3: name or legal sentence, 2: mention, 1: base phrase
    gate: str                      # a whole word of every match
    pattern: str                   # regular expression, words separated by one blank


def _versions(label: str, priority: int, gate: str, pattern: str, versions: tuple) -> list[Rule]:
    """One rule per version: {v} is its digits as words, {n} the label's form."""
    out = []
    for v in versions:
        words = v.replace(".", " ")
        if v.endswith(".0"):
            words = f"{v[:-2]}(?: 0)?"
        out.append(Rule(label.replace("{n}", v), priority, gate, pattern.replace("{v}", words)))
    return out


def _creative_commons() -> list[Rule]:
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
    out = []
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        short = " ".join(kind.split("-"))
        long = " ".join(parts[p] for p in kind.split("-"))
        for gate, pattern in (("cc", f"cc {short} {{v}}"),
                              ("creative", f"creative commons {long}(?: license)?(?: version)? {{v}}(?: (?:international|unported|generic))?"),
                              ("creativecommons", f"creativecommons org licenses {short} {{v}}")):
            out += _versions(f"cc-{kind}-{{n}}", 4, gate, pattern, ("1.0", "2.0", "2.5", "3.0", "4.0"))
        out.append(Rule(f"cc-{kind}", 3, "cc", f"cc {short}"))
        out.append(Rule(f"cc-{kind}", 3, "creative", f"creative commons {long}"))
    out += [Rule("cc0-1.0", 4, "cc0", "cc0(?: 1 0)?(?: universal)?"),
            Rule("cc0-1.0", 4, "creativecommons", "creativecommons org publicdomain zero 1 0"),
            Rule("cc", 2, "creative", "creative commons(?: license)?")]
    return out


def _short_name(label: str, short: str, tail: str, versions: tuple) -> list[Rule]:
    """'gpl 2', 'gpl v2', 'gplv 2', 'gplv2', 'gpl2': a rule per form, as each has another first word."""
    out = []
    for v in versions:
        major = v.split(".")[0]
        for gate, pattern in ((short, f"{short} v? ?{{v}}"), (f"{short}v", f"{short}v {{v}}"),
                              (f"{short}v{major}", f"{short}v{{v}}"), (f"{short}{major}", f"{short}{{v}}")):
            out += _versions(label, 4, gate, pattern + tail, (v,))
    return out


def _gnu() -> list[Rule]:
    out = []
    for short, name, versions in (("gpl", "general public license", ("1.0", "2.0", "3.0")),
                                  ("lgpl", "(?:lesser|library) general public license", ("2.0", "2.1", "3.0")),
                                  ("agpl", "affero general public license", ("1.0", "3.0")),
                                  ("gfdl", "free documentation license", ("1.1", "1.2", "1.3"))):
        gate = "documentation" if short == "gfdl" else "public"
        full = f"(?:gnu )?{name}(?: {short})?(?: as published by the free software foundation)?(?: either)?(?: v| version)? {{v}}"
        out += _versions(f"{short}-{{n}}", 4, gate, full, versions)
        out += _versions(f"{short}-{{n}}-or-later", 4, gate, full + " (?:of the license )?or (?:at your option )?any later version", versions)
        out += _versions(f"{short}-{{n}}-only", 4, gate, full + " only", versions)
        out += _short_name(f"{short}-{{n}}", short, "", versions)
        out += _short_name(f"{short}-{{n}}-or-later", short, " or later", versions)
        out.append(Rule(short, 3, gate, f"gnu {name}"))
        out.append(Rule(short, 2, short, short))
    return out


def _named() -> list[Rule]:
    out = []
    for short, gate, name, versions in (
            ("apache", "apache", "apache(?: software)? license", ("1.0", "1.1", "2.0")),
            ("mpl", "mozilla", "mozilla public license", ("1.0", "1.1", "2.0")),
            ("epl", "eclipse", "eclipse public license", ("1.0", "2.0")),
            ("cddl", "distribution", "common development and distribution license(?: cddl)?", ("1.0", "1.1")),
            ("cpl", "common", "common public license", ("0.5", "1.0")),
            ("eupl", "european", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
            ("artistic", "artistic", "artistic license", ("1.0", "2.0")),
            ("osl", "open", "open software license", ("1.0", "1.1", "2.0", "2.1", "3.0")),
            ("afl", "academic", "academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0")),
            ("ofl", "font", "sil open font license", ("1.0", "1.1")),
            ("odbl", "database", "open database license", ("1.0",)),
            ("ms-pl", "microsoft", "microsoft public license", ("1.0",)),
            ("ecl", "educational", "educational community license", ("1.0", "2.0")),
            ("lppl", "latex", "latex project public license", ("1.0", "1.1", "1.2", "1.3")),
            ("zpl", "zope", "zope public license", ("1.1", "2.0", "2.1")),
            ("php", "php", "php license", ("3.0", "3.01")),
            ("python", "python", "python(?: software foundation)? license", ("2.0",)),
            ("bsl", "boost", "boost software license", ("1.0",)),
            ("busl", "business", "business source license", ("1.0", "1.1")),
            ("sspl", "server", "server side public license", ("1.0",))):
        out += _versions(f"{short}-{{n}}", 4, gate, f"{name}(?: v| version)? {{v}}", versions)
        out.append(Rule(short, 3, gate, f"(?:the )?{name}"))
        if len(short) > 2:
            out += _versions(f"{short}-{{n}}", 4, short.split("-")[0], f"{short.replace('-', ' ')} {{v}}", versions)
    return out


def _sentences() -> list[Rule]:
    """Legal sentences and short names written by hand."""
    return [
        Rule("mit", 3, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
        Rule("mit", 3, "without", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
        Rule("mit", 3, "mit", "(?:the )?mit license"),
        Rule("mit", 3, "mit", "(?:released|licensed|distributed) under (?:the )?(?:terms of the )?mit"),
        Rule("mit-0", 4, "mit", "mit no attribution"),
        Rule("x11", 3, "x11", "x11 license"),
        Rule("bsd", 3, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
        Rule("bsd-3-clause", 4, "endorse", "neither the name of .{0,80} may be used to endorse or promote products"),
        Rule("bsd-4-clause", 4, "advertising", "all advertising materials mentioning features or use of this software must display"),
        Rule("bsd-2-clause", 4, "bsd", "bsd 2 clause(?: license)?"),
        Rule("bsd-2-clause", 4, "simplified", "simplified bsd license"),
        Rule("bsd-3-clause", 4, "bsd", "bsd 3 clause(?: license)?"),
        Rule("bsd-3-clause", 4, "bsd", "(?:revised|modified) bsd license"),
        Rule("bsd-4-clause", 4, "bsd", "bsd 4 clause(?: license)?"),
        Rule("0bsd", 4, "0bsd", "0bsd(?: license)?"),
        Rule("0bsd", 4, "bsd", "bsd zero clause(?: license)?"),
        Rule("bsd", 3, "bsd", "(?:new )?bsd(?: style)? licen[cs]e"),
        Rule("isc", 3, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        Rule("isc", 3, "isc", "isc license"),
        Rule("zlib", 3, "warranty", "provided as is without any express or implied warranty in no event will the authors be held liable"),
        Rule("zlib", 3, "zlib", "zlib(?: libpng)? license"),
        Rule("unlicense", 3, "domain", "this is free and unencumbered software released into the public domain"),
        Rule("unlicense", 3, "unlicense", "(?:the )?unlicense"),
        Rule("wtfpl", 3, "want", "do what the fuck you want to public license"),
        Rule("wtfpl", 2, "wtfpl", "wtfpl"),
        Rule("postgresql", 3, "postgresql", "postgresql licen[cs]e"),
        Rule("openssl", 3, "openssl", "openssl license"),
        Rule("beerware", 3, "beer", "(?:the )?beer ware license"),
        Rule("beerware", 3, "beerware", "(?:the )?beerware license"),
        Rule("ncsa", 3, "illinois", "university of illinois ncsa open source license"),
        Rule("curl", 3, "curl", "curl license"),
        Rule("json", 3, "evil", "the software shall be used for good not evil"),
        Rule("apache-2.0", 4, "apache", "www apache org licenses license 2 0"),
        Rule("gpl", 3, "gnu", "www gnu org (?:licenses|copyleft) gpl"),
        Rule("lgpl", 3, "gnu", "www gnu org (?:licenses|copyleft) lgpl"),
        Rule("gpl", 3, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
        Rule("public-domain", 3, "domain", "(?:dedicated|released) (?:in)?to the public domain"),
        Rule("public-domain", 2, "domain", "public domain"),
        Rule("spdx", 3, "spdx", "spdx license identifier [^ ]+"),
        Rule("copyright", 3, "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
        Rule("copyright", 2, "copyright", "copyright"),
        Rule("copyright", 2, "copyrighted", "copyrighted(?: material)?"),
        Rule("reserved", 3, "rights", "all rights reserved"),
        Rule("reserved", 3, "rights", "no rights are granted"),
        Rule("reserved", 3, "rechte", "alle rechte vorbehalten"),
        Rule("reserved", 3, "droits", "tous droits réservés"),
        Rule("reserved", 3, "derechos", "todos los derechos reservados"),
        Rule("proprietary", 3, "proprietary", "proprietary and confidential"),
        Rule("proprietary", 3, "written", "without (?:the )?(?:prior )?written permission"),
        Rule("proprietary", 3, "reproduced", "(?:may not|no part .{0,40} may) be reproduced"),
        Rule("proprietary", 3, "redistributed", "may not be published broadcast rewritten or redistributed"),
        Rule("licensed", 2, "licensed", "licensed under"),
        Rule("licensed", 2, "license", "(?:this|the) license"),
        Rule("non-commercial", 2, "commercial", "(?:for )?non commercial (?:use|purposes)(?: only)?"),
        Rule("non-commercial", 2, "noncommercial", "(?:for )?noncommercial (?:use|purposes)(?: only)?"),
        Rule("terms", 2, "terms", "terms (?:of use|of service|and conditions)"),
        Rule("trademark", 2, "trademark", "(?:registered )?trademark of"),
        Rule("trademark", 2, "trademarks", "(?:registered )?trademarks of"),
    ]


def rules() -> list[Rule]:
    """All signature rules, in order: priority first, then as written."""
    every = _creative_commons() + _gnu() + _named() + _sentences()
    every += [Rule(label, 1, phrase.split()[0], phrase) for phrase, label in BASE]
    return sorted(every, key=lambda r: -r.priority)


def _as_line(pattern: str) -> str:
    """A pattern over words in the line where each word has a blank on both sides."""
    out = pattern.replace("(?: ", "(?:  ").replace("?: 0)", "?:  0)")
    wide, i = [], 0
    while i < len(out):
        if out.startswith("(?:  ", i):                          # an optional group that begins with a gap
            wide.append("(?:  ")
            i += 5
        elif out[i] == " " and out[i + 1:i + 2] == "?":          # 'share ?alike': one word or two
            wide.append("(?:  )?")
            i += 2
        elif out[i] == " ":
            wide.append("  ")
            i += 1
        else:
            wide.append(out[i])
            i += 1
    return " " + "".join(wide) + " "


def line_of(plain: Column) -> Column:
    """' w1  w2  w3 ' for words joined by blanks, '' if there is none."""
    return F.when(plain == "", "").otherwise(F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" ")))


def n_words_of(line: Column) -> Column:
    return ((F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))) / 2).cast("long")


def _phrase(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def _places(line: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(how often, first start, last start) of a phrase; the starts are null without one."""
    p = _phrase(phrase)
    count = ((F.length(line) - F.length(F.replace(line, F.lit(p), F.lit("")))) / len(p)).cast("long")
    first = n_words_of(F.substring_index(line, p, 1))
    last = n_words_of(line) - n_words_of(F.substring_index(line, p, -1)) - len(phrase.split())
    return count, F.when(count > 0, first), F.when(count > 0, last)


def _spans(line: Column, rule: Column) -> Column:
    """All intervals of words that match a rule: array<struct<first, end, priority, label>>."""
    empty = F.array().cast("array<struct<first:long,end:long,priority:int,label:string>>")
    cut = F.arrays_zip(F.split(line, rule["pattern"], -1).alias("gap"),
                       F.regexp_extract_all(line, rule["pattern"], F.lit(0)).alias("found"))

    def step(acc, x):
        first = acc["at"] + n_words_of(x["gap"])
        end = first + F.coalesce(n_words_of(x["found"]), F.lit(0).cast("long"))
        span = F.struct(first.alias("first"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.when(x["found"].isNull(), acc["spans"]).otherwise(
            F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def _rules_literal(every: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
                              F.lit(r.gate).alias("gate"), F.lit(_as_line(r.pattern)).alias("pattern"))
                     for r in every])


def gates_in(plain: Column, every: list[Rule]) -> Column:
    """The keywords of the rules that are among the words: one hash lookup per word."""
    return F.array_intersect(F.array(*[F.lit(g) for g in dict.fromkeys(r.gate for r in every)]), F.split(plain, " "))


def detections(line: Column, gates: Column, every: list[Rule]) -> Column:
    """All intervals of the rules whose gate was found."""
    hit = F.filter(_rules_literal(every), lambda r: F.array_contains(gates, r["gate"]))
    spans = F.flatten(F.transform(hit, lambda r: _spans(line, r)))
    return F.when(F.size(gates) > 0, spans).otherwise(F.array().cast("array<struct<first:long,end:long,priority:int,label:string>>"))


def suppressed(spans: Column) -> Column:
    def inside(s, t):
        wider = (t["priority"] > s["priority"]) | ((t["priority"] == s["priority"]) & (t["end"] - t["first"] > s["end"] - s["first"]))
        return wider & (t["first"] <= s["first"]) & (t["end"] >= s["end"])

    return F.filter(spans, lambda s: ~F.exists(spans, lambda t: inside(s, t)))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, kept spans per document."""
    every = rules()
    plain = docs.select("doc_id", words_line(F.col("text")).alias("plain"))
    line = plain.select("doc_id", line_of(F.col("plain")).alias("line"), gates_in(F.col("plain"), every).alias("gates"))
    found = line.withColumn("spans", detections(F.col("line"), F.col("gates"), every))
    kept = found.withColumn("kept", suppressed(F.col("spans")))
    places = [_places(F.col("line"), p) for p, _ in BASE]
    n_base = sum((c for c, _, _ in places[1:]), places[0][0])
    base = F.filter(F.array(*[F.when(c > 0, label) for (c, _, _), (_, label) in zip(places, BASE)]), lambda x: x.isNotNull())
    out = kept.select(
        "doc_id", n_words_of(F.col("line")).alias("n_words"), n_base.alias("n_base"),
        F.least(*[f for _, f, _ in places]).alias("first_word"), F.greatest(*[x for _, _, x in places]).alias("last_word"),
        base.alias("base"), "kept")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", _joined(F.col("base")).alias("base_labels"),
        _joined(F.concat("base", F.col("kept.label"))).alias("labels"),
        (F.coalesce(F.array_max(F.col("kept.priority")), F.lit(0)) / 4).alias("score"), "kept")
