"""Licence scan by ordered signature rules, in DataFrame functions alone.

A text becomes its words (A-Z lower-cased, runs of digits, letters and non-ASCII characters) with one space between
them. One regular expression of all gate phrases decides whether any rule can match; only then are words looked at.
Each word that is the keyword of rules opens a window of ``WINDOW`` words, on which just the rules of that keyword are
tried, from the window's beginning (where a grant leads to a name, the name's first word is the keyword); a match, which
ends with a word, is an interval of words. Intervals are sorted, and one pass drops those that
lie inside an interval of the same or a higher tier (of equal intervals the higher tier, then the earlier rule stays),
so the work is linear in the matches but for their sort. Base phrases are matched the same way and are never dropped.

Nothing is shuffled, and a document's work does not depend on others.

Edge cases: a null text is empty; rows that repeat, or whose ids are null, are scanned each for itself; columns named
like the new ones (``n_words``, ``base``, ``spans``) are replaced, others are carried; an empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainspark.llm.common import fresh, named

#: Words of a window; no rule can match more. Spans that one step of the suppression appends to one list.
WINDOW, BLOCK = 48, 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Public names of licences. Label, regular expression over words, the words it can begin with, versions.
FAMILIES = [
    ("apache", "apache(?: software)?(?: foundation)?(?: licen[sc]e)?", "apache", "1.0 1.1 2.0"),
    ("gpl", "(?:gnu )?(?:general public licen[sc]e|gpl)", "gnu general gpl", "1.0 2.0 3.0"),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", "gnu lesser library lgpl", "2.0 2.1 3.0"),
    ("agpl", "(?:gnu )?(?:affero general public licen[sc]e|agpl)", "gnu affero agpl", "1.0 3.0"),
    ("gfdl", "(?:gnu )?(?:free documentation licen[sc]e|gfdl|fdl)", "gnu free gfdl fdl", "1.1 1.2 1.3"),
    ("mpl", "(?:mozilla public licen[sc]e|mpl)", "mozilla mpl", "1.0 1.1 2.0"),
    ("epl", "(?:eclipse public licen[sc]e|epl)", "eclipse epl", "1.0 2.0"),
    ("cpl", "(?:common public licen[sc]e|cpl)", "common cpl", "1.0"),
    ("ipl", "(?:ibm public licen[sc]e|ipl)", "ibm ipl", "1.0"),
    ("cddl", "(?:common development and distribution licen[sc]e|cddl)", "common cddl", "1.0 1.1"),
    ("eupl", "(?:european union public licen[sc]e|eupl)", "european eupl", "1.0 1.1 1.2"),
    ("osl", "(?:open software licen[sc]e|osl)", "open osl", "1.0 2.0 2.1 3.0"),
    ("afl", "(?:academic free licen[sc]e|afl)", "academic afl", "1.1 2.0 2.1 3.0"),
    ("artistic", "artistic licen[sc]e", "artistic", "1.0 2.0"),
    ("bsl", "boost software licen[sc]e", "boost", "1.0"),
    ("busl", "business source licen[sc]e", "business", "1.1"),
    ("sspl", "(?:server side public licen[sc]e|sspl)", "server sspl", "1.0"),
    ("ofl", "(?:(?:sil )?open font licen[sc]e|ofl)", "sil open ofl", "1.0 1.1"),
    ("odbl", "(?:open (?:data commons open )?database licen[sc]e|odbl)", "open odbl", "1.0"),
    ("pddl", "(?:public domain dedication and licen[sc]e|pddl)", "public pddl", "1.0"),
    ("cc0", "(?:(?:creative commons )?cc0|creative commons zero)", "creative cc0", "1.0"),
    ("psf", "(?:python software foundation licen[sc]e|psf licen[sc]e)", "python psf", "2.0"),
    ("php", "php licen[sc]e", "php", "3.0 3.01"),
    ("zpl", "(?:zope public licen[sc]e|zpl)", "zope zpl", "1.1 2.0 2.1"),
    ("qpl", "(?:q public licen[sc]e|qpl)", "q qpl", "1.0"),
    ("apsl", "(?:apple public source licen[sc]e|apsl)", "apple apsl", "1.0 1.1 1.2 2.0"),
    ("ecl", "(?:educational community licen[sc]e|ecl)", "educational ecl", "1.0 2.0"),
    ("upl", "(?:universal permissive licen[sc]e|upl)", "universal upl", "1.0"),
    ("elastic", "elastic licen[sc]e", "elastic", "1.0 2.0"),
    ("hippocratic", "hippocratic licen[sc]e", "hippocratic", "2.1 3.0"),
    ("wtfpl", "(?:do what the fuck you want to public licen[sc]e|wtfpl)", "do wtfpl", "1.0 2.0"),
    ("nasa", "nasa open source agreement", "nasa", "1.3"),
    ("mit", "(?:mit|expat)(?: x11| expat)? licen[sc]e", "mit expat", ""),
    ("mit-0", "(?:mit no attribution(?: licen[sc]e)?|mit 0)", "mit", ""),
    ("x11", "x11 licen[sc]e", "x11", ""),
    ("isc", "(?:isc|internet systems consortium) licen[sc]e", "isc internet", ""),
    ("bsd", "(?:(?:new|simplified|modified|revised) )?bsd(?: style)? licen[sc]e", "new simplified modified revised bsd", ""),
    ("0bsd", "(?:0bsd|(?:bsd )?zero clause bsd(?: licen[sc]e)?)", "0bsd bsd zero", ""),
    ("bsd-2-clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?", "bsd 2 two", ""),
    ("bsd-3-clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?", "bsd 3 three", ""),
    ("bsd-4-clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?", "bsd 4 four", ""),
    ("zlib", "(?:zlib|zlib libpng) licen[sc]e", "zlib", ""),
    ("libpng", "libpng licen[sc]e", "libpng", ""),
    ("openssl", "openssl licen[sc]e", "openssl", ""),
    ("curl", "curl licen[sc]e", "curl", ""),
    ("vim", "vim licen[sc]e", "vim", ""),
    ("ruby", "ruby licen[sc]e", "ruby", ""),
    ("postgresql", "postgresql licen[sc]e", "postgresql", ""),
    ("ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "university ncsa", ""),
    ("w3c", "w3c (?:software )?(?:notice and )?licen[sc]e", "w3c", ""),
    ("json", "json licen[sc]e", "json", ""),
    ("beerware", "beer ?ware licen[sc]e", "beer beerware", ""),
    ("unlicense", "unlicen[sc]e", "unlicense unlicence", ""),
    ("ms-pl", "(?:microsoft public licen[sc]e|ms pl)", "microsoft ms", ""),
    ("ms-rl", "(?:microsoft reciprocal licen[sc]e|ms rl)", "microsoft ms", ""),
    ("openrail", "(?:bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?", "bigscience bigcode open openrail", ""),
    ("public-domain", "public domain", "public", ""),
]
#: The Creative Commons licences by their terms, and their versions.
CC_TERMS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), "1.0 2.0 2.5 3.0 4.0"

# Sentences of licence texts and notices. Label, keyword, regular expression from that keyword on.
SIGNATURES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither", "neither the names?(?: [^ ]+){1,15} nor the names of (?:its|their|any) contributors"),
    ("bsd-4-clause", "advertising", "advertising materials mentioning features or use of this software must display"),
    ("gpl", "free", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0-or-later", "free", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", "free", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl", "free", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "free", "free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("apache-2.0", "compliance", "compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at(?: https?)?(?: www)? apache org licen[sc]es licen[sc]e 2 0"),
    ("mpl-2.0", "subject", "subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0"),
    ("unlicense", "free", "free and unencumbered software released into the public domain"),
    ("zlib", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("cc0-1.0", "waived", "waived all copyright and related or neighboring rights"),
    ("wtfpl", "you", "you just do what the fuck you want to"),
    ("beerware", "beer", "beer ware licen[sc]e revision 42"),
]
# What leads to a licence's name (a grant, or a tag of the source file), and addresses of licence texts.
GRANTS = ("licensed", "licenced", "released", "distributed", "available", "provided", "published", "governed", "covered", "redistributed")
LINKS = ("under", "by")
LEADS = (*GRANTS, "spdx")
LEAD = f"(?:(?:{'|'.join(GRANTS)}) (?:{'|'.join(LINKS)}) (?:an? |the )?(?:terms (?:and conditions )?of (?:the |an? )?)?|spdx licen[sc]e identifier )"
ADDRESSES = [
    ("apache-2.0", "apache", "apache org licen[sc]es licen[sc]e 2 0"),
    ("mit", "opensource", "opensource org licen[sc]es? mit"),
    ("bsd-3-clause", "opensource", "opensource org licen[sc]es? bsd 3 clause"),
    ("bsd-2-clause", "opensource", "opensource org licen[sc]es? bsd 2 clause"),
    ("gpl", "gnu", "gnu org licen[sc]es gpl"),
    ("lgpl", "gnu", "gnu org licen[sc]es lgpl"),
    ("agpl", "gnu", "gnu org licen[sc]es agpl"),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("unlicense", "unlicense", "unlicense org"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
]
#: Notices that keep rights back.
NOTICES = [
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: [^ ]+){0,9} (?:prohibited|forbidden)"),
    ("no-derivatives", "no", "no part of this (?:work|book|publication|document) may be reproduced"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"),
]
#: The contract's base phrases.
BASE = [("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "all", "all rights reserved")]
#: Phrases one of which a text must have for any rule above to match, as one regular expression each.
GATES = [
    "(?:un)?licen[sc](?:e|es|ed)", "copyright", "public domain", "publicdomain", "cc by", "cc0", "creative commons", "spdx", "hereby granted", "redistribution and use",
    "permission is granted", "nor the names of", "advertising materials", "unencumbered", "source agreement", "proprietary", "unauthorized",
    "no part of this", "fuck you want", "rights reserved", "clause", "0bsd", "apache", "no attribution", "mit 0", "ms pl", "ms rl", "open ?rail",
    "(?:a?gpl|lgpl|g?fdl|mpl|epl|cpl|ipl|cddl|eupl|osl|afl|sspl|ofl|odbl|pddl|zpl|qpl|apsl|ecl|upl|wtfpl)",
]


@dataclass(frozen=True)
class Rule:
    """One signature: tried where ``keyword`` stands. Tiers: 0 base, 1 mention, 2 name or address, 3 grant or tag, 4 sentence of the text."""

    no: int
    keyword: str
    pattern: str
    label: str
    tier: int
    weight: float


#: Mark before the keyword of rules that begin with a lead: that keyword is the word behind the lead.
LED, LEAD_WORDS = "+", 12


def _versioned(label: str, name: str, versions: str) -> list[tuple[str, str]]:
    """(label, regular expression) of a name alone, with each version, and with each version or later."""
    out = [(label, name)]
    for v in versions.split():
        major, _, minor = v.partition(".")
        exact = f"{name}(?:(?: licen[sc]e)?(?: version| ver)? (?:v ?)?|v?){major}" + ("(?: 0)?" if minor == "0" else f" {minor}")
        out += [(f"{label}-{v}", exact), (f"{label}-{v}-or-later", f"{exact} (?:and |or )(?:at your option )?(?:any )?later(?: versions?)?")]
    return out


def all_rules() -> list[Rule]:
    found: list[tuple[str, str, str, int, float]] = []  # keyword, pattern, label, tier, weight
    names = []
    for family, name, words, versions in FAMILIES:
        short = [w for w in words.split() if w.endswith("l") and f"|{w})" in name]  # an acronym may have its version in the same word
        first = [*words.split(), *(f"{w}{v}{x.partition('.')[0]}" for w in short for v in ("v", "") for x in versions.split())]
        names += [(label, pattern, dict.fromkeys(first)) for label, pattern in _versioned(family, name, versions)]
    for kind in CC_KINDS:
        parts = kind.split("-")
        short, long = " ".join(parts), " ".join(CC_TERMS[p] for p in parts)
        pattern = f"(?:cc {short}|creative commons(?: licen[sc]e)? (?:{short}|{long}))"
        names += [(label, versioned, ("cc", "creative")) for label, versioned in _versioned(f"cc-{kind}", pattern, CC_VERSIONS)]
        found += [("creativecommons", f"creativecommons org licen[sc]es {short} {v.replace('.', ' ')}", f"cc-{kind}-{v}", 2, 0.9) for v in CC_VERSIONS.split()]
    for label, pattern, words in names:
        mention = label == "public-domain"
        found += [(w, pattern, label, 1 if mention else 2, 0.4 if mention else 0.7) for w in words]
        found += [(LED + w, LEAD + pattern, label, 3, 0.95) for w in words]
    found += [(k, p, label, 4, 1.0) for label, k, p in SIGNATURES]
    found += [(k, p, label, 2, 0.9) for label, k, p in ADDRESSES]
    found += [(k, p, label, 3 if label == "proprietary" else 1, 0.6 if label == "proprietary" else 0.3) for label, k, p in NOTICES]
    found += [(k, p, label, 0, 0.3) for label, k, p in BASE]
    return [Rule(n, k, f"^(?:{p}) ", label, tier, weight) for n, (k, p, label, tier, weight) in enumerate(found)]


RULES = all_rules()
TIERS = 4

_RULE = "struct<no:int,pattern:string,label:string,tier:int,weight:double>"
_SPAN = "struct<start:long,minus_end:long,minus_tier:int,no:int,label:string,weight:double>"


def words_of(text: Column) -> Column:
    """The words of a text with one space between them; empty if it has none."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN, " "))


def gate(rules: list[Rule]) -> str:
    """A regular expression that any text with a match of ``rules`` has (a version may stick to a word); for other rules than RULES, any keyword."""
    phrases = GATES if rules is RULES else sorted({r.keyword.removeprefix(LED) for r in rules})
    return f"(?<![^ ])(?:{'|'.join(phrases)})(?:v?[0-9]+)?(?![^ ])"


def matches(words: Column, rules: list[Rule]) -> Column:
    """All matches (before suppression) as spans of words, from an array of words."""
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append({k: v for k, v in asdict(r).items() if k != "keyword"})
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": own} for k, own in by.items()])), f"array<struct<keyword:string,rules:array<{_RULE}>>>")
    plain = [k for k in by if not k.startswith(LED)]

    def spaces(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

    def following(at: Column, n: int) -> Column:
        return F.concat(F.array_join(F.slice(words, (at + 1).cast("int"), F.lit(n)), " "), F.lit(" "))

    def hit(word: Column, at: Column) -> Column:
        behind = spaces(F.regexp_extract(following(at, LEAD_WORDS), f"^{LEAD}", 0))
        led = F.when(behind > 0, F.concat(F.lit(LED), F.get(words, at + behind)))
        return F.struct(at.cast("long").alias("at"), F.when(word.isin(*LEADS), led).when(word.isin(*plain), word).alias("key"))

    def tried(h: Column) -> Column:
        rules_here = F.get(F.filter(table, lambda g: g["keyword"] == h["key"]), F.lit(0))["rules"]

        def span(r: Column, text: Column) -> Column:
            found = F.call_function("regexp_extract", text, r["pattern"], F.lit(0))
            return F.struct(h["at"].alias("start"), (-h["at"] - spaces(found)).cast("long").alias("minus_end"), (-r["tier"]).alias("minus_tier"), r["no"].alias("no"), r["label"].alias("label"), r["weight"].alias("weight"))

        every = F.flatten(F.transform(F.array(following(h["at"], WINDOW)), lambda text: F.transform(rules_here, lambda r: span(r, text))))  # the window is joined once
        return F.filter(every, lambda s: s["minus_end"] < -s["start"])

    hits = F.filter(F.transform(words, hit), lambda h: h["key"].isin(*by))
    return F.flatten(F.transform(hits, tried))


def suppressed(spans: Column) -> Column:
    """Sorted spans without those inside an earlier one of the same or a higher tier.

    Every container comes earlier in the order (start, end descending, tier descending, rule). ``most[t]`` is the
    furthest end of the spans so far of tier t + 1 or more. Lists are appended to in steps of BLOCK spans.
    """
    ordered = F.array_sort(spans)
    empty = F.array().cast(f"array<{_SPAN}>")

    def one(state: Column, s: Column) -> Column:
        lost = F.get(state["most"], -s["minus_tier"] - 1) >= -s["minus_end"]
        most = F.transform(state["most"], lambda m, t: F.when(t < -s["minus_tier"], F.greatest(m, -s["minus_end"])).otherwise(m))
        return F.struct(most.alias("most"), F.when(lost, state["kept"]).otherwise(F.concat(state["kept"], F.array(s))).alias("kept"))

    def step(state: Column, k: Column) -> Column:
        start = F.struct(state["most"].alias("most"), empty.alias("kept"))
        block = F.aggregate(F.slice(ordered, (k * BLOCK + 1).cast("int"), F.lit(BLOCK)), start, one)
        return F.transform(F.array(block), lambda b: F.struct(b["most"].alias("most"), F.concat(state["blocks"], F.array(b["kept"])).alias("blocks")))[0]

    first = F.struct(F.array_repeat(F.lit(-1).cast("long"), TIERS).alias("most"), F.array().cast(f"array<array<{_SPAN}>>").alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(ordered) / BLOCK).cast("int")), first, step, lambda state: F.flatten(state["blocks"]))


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The input with ``n_words``, ``base`` and ``spans``: arrays of (start, end, label, rule, tier, weight) in words, end exclusive, by start."""
    new = ["n_words", "base", "spans"]
    rest = [c for c in docs.columns if c not in new]
    joined, found, split, kept = fresh(docs.columns, "joined", "found", "split", "kept")
    own = [named(c) for c in rest]
    texts = docs.select(*own, words_of(named(text)).alias(joined))
    opened = texts.select(*own, joined, F.when(F.col(joined).rlike(gate(rules)), F.split(F.col(joined), " ")).alias(split))
    matched = opened.select(*own, joined, F.when(F.col(split).isNotNull(), matches(F.col(split), rules)).alias(found))
    final = matched.select(*own, joined, found, F.when(F.size(F.filter(found, lambda s: s["minus_tier"] < 0)) > 0, suppressed(F.filter(found, lambda s: s["minus_tier"] < 0))).alias(kept))

    def public(spans: Column) -> Column:
        made = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["minus_end"]).alias("end"), s["label"].alias("label"), s["no"].alias("rule"), (-s["minus_tier"]).alias("tier"), s["weight"].alias("weight")))
        return F.coalesce(made, F.array().cast("array<struct<start:long,end:long,label:string,rule:int,tier:int,weight:double>>"))

    n_words = F.when(F.col(joined) == "", 0).otherwise(F.length(joined) - F.length(F.replace(F.col(joined), F.lit(" "), F.lit(""))) + 1)
    base = F.array_sort(F.filter(found, lambda s: s["minus_tier"] == 0))
    return final.select(*own, n_words.cast("long").alias("n_words"), public(base).alias("base"), public(F.col(kept)).alias("spans"))


def labels(*spans: Column) -> Column:
    """The distinct labels of some arrays of spans, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*(F.transform(s, lambda x: x["label"]) for s in spans))))), ",")


def score(base: Column, spans: Column) -> Column:
    """The greatest weight of a document's spans, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.concat(base, spans), lambda s: s["weight"])), F.lit(0.0))
