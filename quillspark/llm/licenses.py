"""License scans by ordered signature rules.

A text is reduced to lower-case words parted by single spaces. A gate of a few substrings lets only texts go on that can hold a license
statement at all; then every rule's keywords are looked for, and only rules of which one stands in the text run their regular
expression. Rules have a level: 1 for notices ("licensed under ..."), 2 for tags and names with their noun, 3 for bare names.
A detection whose words lie within those of another one of the same or a better level is suppressed, so the longest statement
of the best level names the license; detections that merely overlap both stay. Everything is one narrow projection, without a shuffle.

Defined results: null text counts as empty (no words, no labels, score 0); ids are handed through (null or repeated too); names of other
columns don't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matches import nowhere, places

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Further keywords of a label, for alternatives of its names that don't hold the first.
ALSO = {"mit": ("expat",), "apache-2": ("asl",)}
#: Label, keyword, and the license's names as a regular expression over words.
NAMES = (
    ("mit", "mit", r"(?:mit|mit x11|expat)"),
    ("apache-2", "apache", r"(?:apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?|apache 2(?: 0)?|asl 2(?: 0)?)"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("gpl-2", "gpl", r"gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl-2", "general public", r"gnu general public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3", "general public", r"gnu general public(?: license)?(?: version| v)? 3(?: 0)?"),
    ("gpl", "general public", r"gnu general public(?: license)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version| v)? ?2 1"),
    ("lgpl-3", "lgpl", r"lgpl(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public(?: license)?(?: version| v)? 2 1"),
    ("lgpl-3", "lesser", r"gnu lesser general public(?: license)?(?: version| v)? 3(?: 0)?"),
    ("agpl-3", "agpl", r"agpl(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "affero", r"gnu affero general public(?: license)?(?: version| v)? 3(?: 0)?"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? 1 1"),
    ("mpl-2", "mpl", r"mpl(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("edl-1", "eclipse", r"eclipse distribution(?: license)?(?: version| v)? 1(?: 0)?"),
    ("cddl-1", "cddl", r"cddl(?: version| v)? ?1(?: 0| 1)?"),
    ("cddl-1", "common development", r"common development and distribution(?: license)?(?: version| v)?(?: 1(?: 0| 1)?)?"),
    ("cpl-1", "common public", r"common public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("eupl-1.2", "european union", r"european union public(?: licen[cs]e)?(?: version| v)? 1 2"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)? ?1 2"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost(?: software)?(?: license)?(?: version| v)? 1(?: 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version| v)?(?: 2)?"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"(?:perl )?artistic(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("psf-2", "python software", r"python software foundation(?: license)?(?: version| v)?(?: 2)?"),
    ("php-3", "php", r"php(?: license)?(?: version| v)? 3(?: 0| 01)?"),
    ("ruby", "ruby", r"ruby"),
    ("ofl-1.1", "open font", r"(?:sil )?open font(?: license)?(?: version| v)?(?: 1 1)?"),
    ("odbl-1", "open database", r"open database(?: license)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("odc-by-1", "open data commons", r"open data commons attribution(?: license)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("pddl-1", "public domain dedication", r"public domain dedication(?: and license)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("gfdl", "free documentation", r"gnu free documentation(?: license)?(?: version| v)?(?: 1 [123])?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("openrail", "openrail", r"openrail(?: m| s)?"),
    ("bsl-1.1", "business source", r"business source(?: license)?(?: version| v)?(?: 1 1)?"),
    ("elastic-2", "elastic", r"elastic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("sspl-1", "server side", r"server side public(?: license)?(?: version| v)?(?: 1)?"),
)
#: The Creative Commons family: every combination of its elements.
COMMONS = tuple((f"cc-{e.replace(' ', '-')}", "cc by", rf"cc {e}(?: [1-4] [05])?") for e in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"))
COMMONS_WORDS = tuple(
    (f"cc-by{short}", "creative commons", rf"creative commons attribution{words}(?: [1-4] [05])?(?: international| unported| generic)?")
    for short, words in (("", ""), ("-sa", r" share ?alike"), ("-nd", r" no ?deriv(?:ative|atives|s)"), ("-nc", r" non ?commercial"), ("-nc-sa", r" non ?commercial share ?alike"), ("-nc-nd", r" non ?commercial no ?deriv(?:ative|atives|s)"))
)

#: How a name is used, and the level of a statement of that form. {} is the name.
FORMS = (
    (r"(?:dual )?(?:licen[cs]ed|released|distributed|available|published|provided|offered|redistributed|shared|made available) (?:under|by) (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]es?)?", 1),
    (r"spdx licen[cs]e identifier {}(?: only| or later)?", 1),
    (r"(?:subject to|governed by|under) the (?:terms (?:and conditions )?of the )?{}(?: licen[cs]es?)?", 1),
    (r"licen[cs]e (?:is )?(?:the )?{}", 2),
    (r"{} (?:software )?licen[cs]es?", 2),
    (r"{}(?: only| or later| or any later version)", 2),
)
#: Names that are no words of common language, so that they count by themselves.
TELLING = ("cc0", "cc by", "wtfpl", "unlicense", "agpl", "lgpl", "eupl", "openrail", "creative commons", "general public", "lesser", "affero", "mozilla", "eclipse")
#: Statements without a named license.
OTHERS = (
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 2),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 2),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 2),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 3),
)
#: Sentences of the licenses themselves, by which a text is known that names none.
SENTENCES = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|material)", 2),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 2),
    ("mit", "without warranty of any kind", r"(?:software|work) is provided as is without warranty of any kind", 3),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 2),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:the )?(?:[^ ]+ ){1,12}(?:nor the names of its contributors )?may be used to endorse or promote products", 2),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 2),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 3),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 3),
    ("apache-2", "apache org licenses", r"(?:http|https) www apache org licenses license 2 0", 1),
    ("apache-2", "except in compliance", r"you may not use this (?:file|work) except in compliance with the license", 2),
    ("apache-2", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind", 2),
    ("apache-1.1", "includes software developed by the apache", r"this product includes software developed by the apache", 3),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1),
    ("gpl", "free software foundation", r"as published by the free software foundation(?: either)?(?: version [123])?", 3),
    ("gpl-2", "free software foundation", r"as published by the free software foundation (?:either )?version 2(?: of the license)?", 2),
    ("gpl-3", "free software foundation", r"as published by the free software foundation (?:either )?version 3(?: of the license)?", 2),
    ("gpl", "gnu org licenses", r"(?:http|https) www gnu org licenses gpl(?: html| txt)?", 2),
    ("gpl-2", "gnu org licenses", r"(?:http|https) www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?", 1),
    ("gpl-3", "gnu org licenses", r"(?:http|https) www gnu org licenses gpl 3 0(?: html| txt)?", 1),
    ("lgpl", "gnu org licenses", r"(?:http|https) www gnu org licenses lgpl(?: html| txt)?", 2),
    ("agpl-3", "gnu org licenses", r"(?:http|https) www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 1),
    ("agpl-3", "remote network interaction", r"remote network interaction use with the gnu general public license", 2),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it", 2),
    ("mpl-2", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license", 1),
    ("mpl-2", "mozilla org mpl", r"(?:http|https) (?:www )?mozilla org mpl 2 0", 1),
    ("mpl-1.1", "mozilla org mpl", r"(?:http|https) (?:www )?mozilla org mpl(?: mpl 1 1)?", 2),
    ("epl-1", "eclipse org legal", r"(?:http|https) www eclipse org legal epl v10(?: html)?", 1),
    ("epl-2", "eclipse org legal", r"(?:http|https) www eclipse org legal epl 2 0", 1),
    ("boost-1", "boost org license", r"(?:http|https) www boost org license 1 0 txt", 1),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original", 2),
    ("zlib", "provided as is", r"this software is provided as is without any express or implied warranty", 3),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1),
    ("wtfpl", "what the", r"do what the f[^ ]{1,3} you want to public license", 1),
    ("cc0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 1),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 2),
    ("cc-by", "creativecommons org licenses", r"creativecommons org licenses by [1-4] [05]", 1),
    ("cc-by-sa", "creativecommons org licenses", r"creativecommons org licenses by sa [1-4] [05]", 1),
    ("cc-by-nd", "creativecommons org licenses", r"creativecommons org licenses by nd [1-4] [05]", 1),
    ("cc-by-nc", "creativecommons org licenses", r"creativecommons org licenses by nc [1-4] [05]", 1),
    ("cc-by-nc-sa", "creativecommons org licenses", r"creativecommons org licenses by nc sa [1-4] [05]", 1),
    ("cc-by-nc-nd", "creativecommons org licenses", r"creativecommons org licenses by nc nd [1-4] [05]", 1),
    ("ofl-1.1", "reserved font name", r"with reserved font names?", 2),
    ("ofl-1.1", "openfontlicense", r"(?:http|https) openfontlicense org", 1),
    ("ofl-1.1", "scripts sil org", r"(?:http|https) scripts sil org ofl", 1),
    ("gfdl", "invariant sections", r"with no invariant sections(?: no front cover texts)?", 2),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?", 1),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?", 1),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?", 1),
    ("ms-pl", "microsoft", r"microsoft public license ms pl", 2),
    ("proprietary", "prior written", r"(?:reproduction|redistribution|copying|distribution) (?:of [^ ]+ )?(?:is )?(?:strictly )?prohibited without (?:the )?prior written (?:permission|consent)", 2),
    ("proprietary", "trade secret", r"contains (?:confidential information and )?trade secrets? of", 3),
    ("all-rights-reserved", "no part of", r"no part of this (?:publication|book|work|document) may be reproduced", 2),
    ("public-domain", "no known copyright", r"no known copyright restrictions", 2),
)
#: Substrings of which any text with a detection by name has one; the keywords of all other rules are added to them.
GATE = ("licen", "spdx", "released", "distributed", "available", "published", "provided", "offered", "shared", "under the", "subject to", "governed", " only ", "or later", "later version")
SCORES = {1: 1.0, 2: 0.7, 3: 0.4}


def rules() -> list[tuple[str, str, str, int]]:
    """label, keyword, pattern, level of every rule: each name in each form, then the bare names and the others."""
    out = []
    for label, keyword, name in NAMES + COMMONS + COMMONS_WORDS:
        out += [(label, keyword, form.replace("{}", name), level) for form, level in FORMS]
        if keyword in TELLING:
            out.append((label, keyword, name, 3))
    return out + list(OTHERS + SENTENCES)


def keywords(label: str, keyword: str) -> tuple[str, ...]:
    """Of which any match of the rule holds one."""
    return (keyword, *ALSO.get(label, ()))


def gate_words() -> tuple[str, ...]:
    """Of which any text with a detection holds one: a form's own word, or the keyword of a rule that isn't a form."""
    alone = [r[1] for r in OTHERS + SENTENCES] + [k for _, k, _ in NAMES + COMMONS + COMMONS_WORDS if k in TELLING]
    return (*GATE, *(k for k in dict.fromkeys(alone) if not any(g in k for g in GATE)))


def normal(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, parted by single spaces."""
    # the two letters beyond ASCII whose lower case holds an ASCII letter must not become one
    safe = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.trim(F.regexp_replace(F.lower(safe), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _pattern(words: str) -> str:
    return f" {words}(?= )"


DETECTION = "array<struct<start:int,back:int,level:int,label:string>>"


def _rule_table() -> Column:
    """The rules by keywords, as one constant: array of (keywords, rules of them)."""
    groups: dict[tuple[str, ...], list] = {}
    for label, keyword, pattern, level in rules():
        groups.setdefault(keywords(label, keyword), []).append({"label": label, "pattern": _pattern(pattern), "level": level})
    table = json.dumps([{"keywords": k, "rules": v} for k, v in groups.items()])
    return F.from_json(F.lit(table), "array<struct<keywords:array<string>,rules:array<struct<label:string,pattern:string,level:int>>>>")


def detections(padded: Column) -> Column:
    """array<start, end, level, label> that suppression leaves, in order; padded: words with a space around each."""
    live = F.filter(_rule_table(), lambda g: F.exists(g["keywords"], lambda k: F.contains(padded, k)))
    hits = F.flatten(
        F.transform(
            F.flatten(F.transform(live, lambda g: g["rules"])),
            lambda r: F.transform(
                F.when(F.regexp_instr(padded, r["pattern"]) > 0, places(padded, r["pattern"], spaces)).otherwise(nowhere()),
                lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), r["level"].alias("level"), r["label"].alias("label")),
            ),
        )
    ).cast(DETECTION)
    return _suppressed(hits)


def _suppressed(hits: Column) -> Column:
    """Level by level: within one, in order of start and the longest first, what ends no later than an earlier one lies within it; then what lies within a better level's."""
    kept = F.array().cast(DETECTION)
    for k in (1, 2, 3):
        own = F.array_sort(F.filter(hits, lambda d: d["level"] == k))
        zero = F.struct(F.lit(-1).alias("m"), F.array().cast(DETECTION).alias("out"))

        def step(acc: Column, d: Column) -> Column:
            stays = acc["m"] < -d["back"]
            return F.struct(F.greatest(acc["m"], -d["back"]).alias("m"), F.when(stays, F.concat(acc["out"], F.array(d))).otherwise(acc["out"]).alias("out"))

        alone = F.aggregate(own, zero, step, lambda acc: acc["out"])
        better = kept
        fresh = F.filter(alone, lambda d: ~F.exists(better, lambda b: (b["start"] <= d["start"]) & (b["back"] <= d["back"])))
        kept = F.concat(kept, fresh)
    return kept


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(F.col(text_col)).alias("words"))
    d = d.select("doc_id", F.concat(F.lit(" "), "words", F.lit(" ")).alias("t"), F.when(F.col("words") == "", F.lit(0)).otherwise(spaces(F.col("words")) + 1).cast("long").alias("n_words"))
    t = F.col("t")
    gate = F.lit(False)
    for word in gate_words():
        gate = gate | F.contains(t, F.lit(word))
    base = F.array().cast("array<struct<start:int,label:string>>")
    for phrase, label in BASE:
        found = F.when(F.contains(t, F.lit(f" {phrase} ")), places(t, F.lit(_pattern(phrase)), spaces)).otherwise(nowhere())
        base = F.concat(base, _labelled(found, label))
    d = d.select("doc_id", "n_words", base.alias("base"), F.when(gate, detections(t)).otherwise(F.array().cast(DETECTION)).alias("kept"))
    starts = F.transform("base", lambda x: x["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda x: x["label"]), F.transform("kept", lambda x: x["label"]))))
    best = F.array_min(F.concat(F.transform("kept", lambda x: x["level"]), F.transform("base", lambda x: F.lit(1))))
    score = F.when(best == 1, F.lit(SCORES[1])).when(best == 2, F.lit(SCORES[2])).when(best == 3, F.lit(SCORES[3])).otherwise(F.lit(0.0))
    shown = F.transform("kept", lambda x: F.struct(x["start"].alias("first"), (-x["back"]).alias("end"), x["label"].alias("label"), x["level"].alias("level")))
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), shown.alias("detections"),
    )
