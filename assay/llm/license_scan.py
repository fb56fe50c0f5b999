"""License scans: ordered signature rules with keyword prefilter, priority and containment.

A text is reduced to its lower-case words between single spaces. The rules are regular
expressions over such texts: hand-written names of each license, alone where they tell
enough, and in the usual forms of a notice; sentences of the licenses' own texts; their
addresses; the further operands of SPDX expressions. A rule runs only if the text has what
all its matches contain, a keyword derived from its names and one from its form; the gate,
which skips whole texts, is the union of these over all rules. Detections are word
intervals; one that lies inside another is dropped, of equal intervals the rule with
the higher priority stays (the earlier one of equal priority). A notice that says "not" has
rules of its own without a label, so it only suppresses what it contains. The base phrases
are looked for beside the rules and always stay.

All is done in DataFrame expressions on the row itself: no shuffle, no Python.

Defined results: a null or empty text has no words, labels '' and score 0; repeated
rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import common
from assay.llm.quality import bind

# words are runs of 0-9, a-z and all beyond ASCII (a positive class: several times faster than the negated ranges)
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"  # the same words before A-Z are lower-cased
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# label, whether a name tells enough alone, names as regular expressions, SPDX words
LICENSES = [
    ("mit", False, [r"mit", r"mit x11", r"expat"], r"mit"),
    ("mit-0", False, [r"mit 0", r"mit no attribution"], r"mit 0"),
    ("apache-2", False, [r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?", r"apache 2(?: 0)?"], r"apache 2 0"),
    ("apache-1.1", False, [r"apache(?: software)?(?: license)?(?: version)? v?1 1"], r"apache 1 1"),
    ("bsd-2-clause", False, [r"bsd 2 clause", r"2 clause bsd", r"two clause bsd", r"simplified bsd", r"freebsd"], r"bsd 2 clause"),
    ("bsd-3-clause", False, [r"bsd 3 clause", r"3 clause bsd", r"three clause bsd", r"(?:new|revised|modified) bsd"], r"bsd 3 clause"),
    ("bsd-4-clause", False, [r"bsd 4 clause", r"4 clause bsd", r"original bsd"], r"bsd 4 clause"),
    ("bsd-0-clause", False, [r"0bsd", r"zero clause bsd", r"bsd zero clause"], r"0bsd"),
    ("isc", False, [r"isc"], r"isc"),
    ("zlib", False, [r"zlib", r"zlib libpng"], r"zlib"),
    ("boost-1.0", False, [r"boost(?: software)?(?: license)?(?: version)?(?: 1 0)?"], r"bsl 1 0"),
    ("unlicense", True, [r"unlicense", r"the unlicense"], r"unlicense"),
    ("wtfpl", True, [r"wtfpl"], r"wtfpl"),
    ("gpl-1", True, [r"gnu general public license(?: version)? v?1(?: 0)?"], r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", True, [r"gnu general public license(?: gpl)?(?: as published by the free software foundation either)?(?: version)? v?2(?: 0)?"], r"gpl 2 0(?: only| or later)?"),
    ("gpl-2", True, [r"(?:gnu )?gpl ?v?2(?: 0)?", r"gplv2", r"(?:gnu )?gpl version 2(?: 0)?(?: or later)?"], r"gpl 2 0"),
    ("gpl-3", True, [r"gnu general public license(?: gpl)?(?: as published by the free software foundation either)?(?: version)? v?3(?: 0)?"], r"gpl 3 0(?: only| or later)?"),
    ("gpl-3", True, [r"(?:gnu )?gpl ?v?3(?: 0)?", r"gplv3", r"(?:gnu )?gpl version 3(?: 0)?(?: or later)?"], r"gpl 3 0"),
    ("lgpl-2", True, [r"gnu (?:library|lesser) general public license(?: version)? v?2(?: 0)?"], r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", True, [r"gnu lesser general public license(?: version)? v?2 1"], r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", True, [r"(?:gnu )?lgpl ?v?2 1", r"lgplv2 1", r"(?:gnu )?lgpl version 2 1(?: or later)?"], r"lgpl 2 1"),
    ("lgpl-3", True, [r"gnu lesser general public license(?: version)? v?3(?: 0)?"], r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", True, [r"(?:gnu )?lgpl ?v?3(?: 0)?", r"lgplv3", r"(?:gnu )?lgpl version 3(?: 0)?(?: or later)?"], r"lgpl 3 0"),
    ("agpl-3", True, [r"gnu affero general public license(?: version)? v?3(?: 0)?"], r"agpl 3 0(?: only| or later)?"),
    ("agpl-3", True, [r"(?:gnu )?agpl ?v?3(?: 0)?", r"agplv3", r"(?:gnu )?agpl version 3(?: 0)?(?: or later)?"], r"agpl 3 0"),
    ("gfdl", True, [r"gnu free documentation license(?: version)?(?: 1 [123])?"], r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", True, [r"mozilla public license(?: version)? v?1 1"], r"mpl 1 1"),
    ("mpl-2", True, [r"mozilla public license(?: version)? v?2(?: 0)?"], r"mpl 2 0"),
    ("epl-1", True, [r"eclipse public license(?: version)?(?: v)? ?1(?: 0)?"], r"epl 1 0"),
    ("epl-2", True, [r"eclipse public license(?: version)?(?: v)? ?2(?: 0)?"], r"epl 2 0"),
    ("cddl-1", True, [r"common development and distribution license(?: version)?(?: 1 0)?"], r"cddl 1 0"),
    ("eupl-1.2", True, [r"european union public licen[cs]e(?: version)?(?: v)? ?1 2"], r"eupl 1 2"),
    ("artistic-1", False, [r"artistic license(?: version)? 1(?: 0)?"], r"artistic 1 0"),
    ("artistic-2", False, [r"artistic license(?: version)? 2(?: 0)?"], r"artistic 2 0"),
    ("python-2", False, [r"python software foundation license(?: version)?(?: 2)?", r"psf license(?: version)?(?: 2)?"], r"(?:psf|python) 2 0"),
    ("openssl", False, [r"openssl"], r"openssl"),
    ("postgresql", False, [r"postgresql"], r"postgresql"),
    ("ofl-1.1", True, [r"sil open font license(?: version)?(?: 1 1)?"], r"ofl 1 1"),
    ("odbl", True, [r"open database license", r"odbl"], r"odbl 1 0"),
    ("cc0", True, [r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero"], r"cc0 1 0"),
    ("cc-by", True, [r"cc by(?: [1234] 0)?", r"creative commons attribution(?: [1234] 0)?"], r"cc by [1234] 0"),
    ("cc-by-sa", True, [r"cc by sa(?: [1234] 0)?"], r"cc by sa [1234] 0"),
    ("cc-by-sa", True, [r"creative commons attribution share ?alike(?: [1234] 0)?"], r"cc by sa"),
    ("cc-by-nc", True, [r"cc by nc(?: [1234] 0)?"], r"cc by nc [1234] 0"),
    ("cc-by-nc", True, [r"creative commons attribution non ?commercial(?: [1234] 0)?"], r"cc by nc"),
    ("cc-by-nc-sa", True, [r"cc by nc sa(?: [1234] 0)?"], r"cc by nc sa [1234] 0"),
    ("cc-by-nc-sa", True, [r"(?:creative commons )?attribution non ?commercial share ?alike(?: [1234] 0)?"], r"cc by nc sa"),
    ("cc-by-nd", True, [r"cc by nd(?: [1234] 0)?"], r"cc by nd [1234] 0"),
    ("cc-by-nd", True, [r"(?:creative commons )?attribution no ?deriv(?:atives|ative|s)(?: works)?(?: [1234] 0)?"], r"cc by nd"),
    ("cc-by-nc-nd", True, [r"cc by nc nd(?: [1234] 0)?"], r"cc by nc nd [1234] 0"),
    ("cc-by-nc-nd", True, [r"(?:creative commons )?attribution non ?commercial no ?deriv(?:atives|ative|s)(?: works)?(?: [1234] 0)?"], r"cc by nc nd"),
    ("sspl-1", True, [r"server side public license(?: version)?(?: v1)?(?: 1)?", r"sspl"], r"sspl 1 0"),
    ("busl-1.1", True, [r"business source license(?: version)?(?: 1 1)?"], r"busl 1 1"),
    ("elastic-2", False, [r"elastic license(?: version)? v?2(?: 0)?"], r"elastic 2 0"),
    ("ms-pl", True, [r"microsoft public license"], r"ms pl"),
    ("ms-rl", True, [r"microsoft reciprocal license"], r"ms rl"),
    ("public-domain", True, [r"(?:in|into|to) the public domain"], r"public domain"),
    ("proprietary", False, [r"all rights reserved"], r"licenseref proprietary"),
]
DENIED = 5  # the priority of forms that deny a license: their detections have no label
#: Sentences of the licenses themselves, or of the notices that they ask for.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("bsd-0-clause", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", r"nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("gpl-2", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", r"under the terms of version 2 of the gnu general public license"),
    ("gpl-3", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", r"under the terms of the eclipse public license v 2 0"),
    ("epl-1", r"under the terms of the eclipse public license v 1 0"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
]
#: Addresses as words; the path of a Creative Commons license names it.
ADDRESSES = [
    ("apache-2", r"apache org licenses license 2 0"),
    ("apache-1.1", r"apache org licenses license 1 1"),
    ("gpl-2", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", r"gnu org licenses gpl 3 0"),
    ("lgpl-2.1", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", r"gnu org licenses lgpl 3 0"),
    ("agpl-3", r"gnu org licenses agpl 3 0"),
    ("gfdl", r"gnu org licenses (?:old licenses )?fdl 1 [123]"),
    ("cc-by", r"creativecommons org licenses by(?: [1234] 0)?"),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: [1234] 0)?"),
    ("cc-by-nc", r"creativecommons org licenses by nc(?: [1234] 0)?"),
    ("cc-by-nd", r"creativecommons org licenses by nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: [1234] 0)?"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: [1234] 0)?"),
    ("cc0", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("mpl-2", r"mozilla org (?:en us )?mpl 2 0"),
    ("epl-2", r"eclipse org legal epl (?:v20|2 0)"),
    ("epl-1", r"eclipse org legal epl v10"),
    ("boost-1.0", r"boost org license 1 0"),
    ("ofl-1.1", r"scripts sil org ofl"),
    ("elastic-2", r"elastic co licensing elastic license"),
    ("sspl-1", r"mongodb com licensing server side public license"),
    ("busl-1.1", r"mariadb com bsl11"),
]
#: Forms of a notice around a name: regular expression, priority, confidence, what every match contains besides the name.
FORMS = [
    (r"spdx license identifier {spdx}", 4, 1.0, ""),
    (r"spdx {spdx}", 4, 0.9, " spdx "),
    (r"(?:opensource|spdx|choosealicense) (?:org|com) licenses? {spdx}", 4, 0.95, " licen"),
    (r"(?:not|never|no longer) (?:be )?(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: licen[cs]e)?", DENIED, 0.0, " under "),
    (r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: licen[cs]e)?", 3, 0.95, " under "),
    (r"(?:under|subject to) (?:the )?terms of (?:the )?(?:{name})(?: licen[cs]e)?", 3, 0.9, "terms of "),
    (r"licen[cs]e (?:is )?(?:the )?(?:{name})", 2, 0.8, " licen"),
    (r"(?:the )?(?:{name}) licen[cs]e", 2, 0.8, " licen"),
    (r"under (?:the |a )?(?:{name})", 1, 0.7, " under "),
]
BARE = (r"(?:{name})", 0, 0.6, "")


def needed(rx: str) -> str:
    """The longest literal that every match of ``rx`` among whole words contains; a space where a word must begin or end there.

    ``rx`` holds literals, classes and groups without groups inside, each with or without ``?``.
    """
    s = re.sub(r"(\(\?: [^()|]*\)\?)+$", " ", f" {rx}") if rx else ""  # further words at the end, or none: a word ends before
    s = s if s.endswith(" ") or not rx else f"{s} "
    pieces = re.split(r"\([^()]*\)\??|\[[^]]*\]\??|.\?", s)
    return max(pieces, key=lambda p: (len(p.strip()), len(p)))


def fewest(keys: list[str]) -> list[str]:
    """Without those that contain another: one of ``keys`` is in a text just if one of these is."""
    return [k for k in dict.fromkeys(keys) if not any(o != k and o in k for o in keys)]


def rules() -> list[tuple[tuple[str, ...], str, str, int, float, str]]:
    """(keywords, regular expression, label, priority, confidence, form's keyword) of every rule, in order. Every match of a rule
    contains one of its keywords, one for each name, and the form's keyword."""
    out = []
    for label, alone, names, spdx in LICENSES:
        name, keys = "|".join(names), tuple(fewest([needed(n) for n in names]))
        if label == "proprietary":
            out.append((keys, name, label, 0, 0.5, ""))
            continue
        for form, priority, sure, around in FORMS + [BARE] * alone:
            rx = form.format(name=name, spdx=spdx)
            own = keys if "{name}" in form else (needed(spdx if around else rx),)
            out.append((own, rx, "" if priority == DENIED else label, priority, sure, around))
    for label, rx in TEXTS:
        out.append(((needed(rx),), rx, label, 4, 0.95, ""))
    for label, rx in ADDRESSES:
        out.append(((needed(rx),), rx, label, 4, 0.9, ""))
    return out


def lead() -> str:
    """What stands before a further operand of an SPDX expression: where it is told to be one, and the operands before it."""
    atom = "|".join(dict.fromkeys(spdx for *_, spdx in LICENSES))
    return rf"(?:spdx license identifier|spdx|licen[cs]e) (?:(?:{atom}) (?:with (?:[0-9a-z]+ ){{1,6}}?)?(?:or|and) ){{1,8}}"


def operands() -> list[tuple[tuple[str, ...], str, str, int, float]]:
    """(keywords, regular expression, label, priority, confidence) of the further operands of SPDX expressions; to follow ``lead()``.

    The first operand of each has a rule in ``rules()``, whose keywords hold the gate open."""
    found = {spdx: label for label, _, _, spdx in LICENSES if label != "proprietary"}
    return [((needed(spdx),), spdx, label, 4, 1.0) for spdx, label in found.items()]


def gate(norm: Column) -> Column:
    """False only for texts in which no rule and no base phrase can match: the rules' own keywords, each form's together.

    Keywords with 'licen' in them are told by that alone: one search instead of many.
    """
    by_form: dict[str, list[str]] = {"": [f" {p} " for p, _ in BASE]}
    for keys, *_, form in rules():
        by_form.setdefault(form, []).extend(keys)
    alone = fewest(["licen" if "licen" in k else k for k in by_form[""]])
    has = lambda keys: common.any_of([F.contains(norm, F.lit(k)) for k in keys])
    # forms with the same keywords left are told together
    left: dict[tuple[str, ...], list[str]] = {}
    for form, keys in by_form.items():
        more = tuple(k for k in fewest(keys) if not any(o in k for o in alone))
        if form and more:
            left.setdefault(more, []).append(form)
    return has(alone) | common.any_of([has(forms) & has(keys) for keys, forms in left.items()])


RULE = "rx:string,label:string,p:int,sure:double,i:int"


def constant(value: list, kind: str) -> Column:
    """A table of rules as one literal: the optimizer folds it, and the driver does not build thousands of expressions."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def places(norm: Column, rx: Column, before: str | None = None) -> Column:
    """Word intervals (s, e) of the places where ``rx`` matches whole words of ``norm``, leftmost, non-overlapping.

    With ``before``, the words of a match that this expression takes from its start on are not part of the interval."""
    whole = F.concat(F.lit("(?<= )(?:"), rx, F.lit(")(?= )"))
    words = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))  # noqa: E731  spaces

    def positions(b: Column, w: Column) -> Column:
        at = common.running(F.transform(w, lambda m, i: words(m) + words(F.get(b, i + 1))), F.lit(0), lambda x, y: x + y)
        first = words(F.get(b, F.lit(0))) - 1
        return F.transform(F.arrays_zip(w.alias("w"), at.alias("at")), lambda m: F.struct(
            (first + m["at"] + (0 if before is None else words(F.regexp_extract(m["w"], before, 0)))).alias("s"),
            (first + m["at"] + words(m["w"]) + 1).alias("e")))

    return bind(F.split(norm, whole, -1), lambda b: bind(F.regexp_extract_all(norm, whole, F.lit(0)), lambda w: positions(b, w)))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_words, ``_base`` (intervals with label) and ``_kept`` (s, e, priority, label, sure of the detections that stay)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(common.lower_ascii(F.col("_text")), NOT_WORD, " ")), F.lit(" "))
    rows = docs.select(*keep, text.alias("_text"))
    rows = rows.select(*keep, F.regexp_count("_text", F.lit(RAW_WORD)).cast("long").alias("n_words"), norm.alias("_words"))
    rows = rows.select(*keep, "n_words", F.when(common.once(gate(F.col("_words"))), F.col("_words")).alias("_norm"))
    base = F.flatten(F.array(*[F.transform(
        F.when(F.contains("_norm", F.lit(f" {p} ")), places(F.col("_norm"), F.lit(p))).otherwise(F.array()),
        labelled(label)) for p, label in BASE]))
    known = rules()
    groups: dict[tuple[str, ...], list[dict]] = {}  # rules by their keywords, which are looked for once
    for i, (keys, rx, label, p, sure, form) in enumerate(known):
        groups.setdefault(keys, []).append({"form": form, "rx": rx, "label": label, "p": p, "sure": sure, "i": i})
    table = constant([{"k": keys, "rules": of} for keys, of in groups.items()], f"array<struct<k:array<string>,rules:array<struct<form:string,{RULE}>>>>")
    near = F.flatten(F.transform(F.filter(table, lambda g: F.exists(g["k"], lambda k: F.contains("_norm", k))), lambda g: g["rules"]))
    hits = F.flatten(F.transform(F.filter(near, lambda r: F.contains("_norm", r["form"])), lambda r: F.transform(
        places(F.col("_norm"), r["rx"]), lambda d: F.struct(
            d["s"].alias("s"), (-d["e"]).alias("e"), (-r["p"]).alias("p"), r["i"].alias("i"),
            r["label"].alias("label"), r["sure"].alias("sure")))))
    # further operands of SPDX expressions: only where one joins two licenses
    more = constant([{"k": keys, "rx": rx, "label": label, "p": p, "sure": sure, "i": len(known) + i}
                     for i, (keys, rx, label, p, sure) in enumerate(operands())], f"array<struct<k:array<string>,{RULE}>>")
    joined = F.regexp_like("_norm", F.lit(f" {lead()}"))
    also = F.flatten(F.transform(F.filter(more, lambda r: F.exists(r["k"], lambda k: F.contains("_norm", k))), lambda r: F.transform(
        places(F.col("_norm"), F.concat(F.lit(lead()), F.lit("(?:"), r["rx"], F.lit(")")), "^" + lead()), lambda d: F.struct(
            d["s"].alias("s"), (-d["e"]).alias("e"), (-r["p"]).alias("p"), r["i"].alias("i"),
            r["label"].alias("label"), r["sure"].alias("sure")))))
    hits = F.concat(hits, F.when(joined, also).otherwise(F.array().cast("array<struct<s:int,e:int,p:int,i:int,label:string,sure:double>>")))
    # by start, then the longest, the highest priority, the earliest rule: one that ends no later than any before lies inside it
    def outermost(all_: Column) -> Column:
        reach = common.running(F.transform(all_, lambda d: -d["e"]), F.lit(-1), F.greatest)
        return F.transform(F.filter(F.arrays_zip(all_.alias("d"), reach.alias("r")), lambda m: -m["d"]["e"] > m["r"]), lambda m: m["d"])

    stay = bind(F.sort_array(hits), outermost)
    return rows.select(*keep, "n_words", F.when(F.col("_norm").isNotNull(), base).alias("_base"),
                       F.when(F.col("_norm").isNotNull(), stay).alias("_kept"))


def labelled(label: str):
    return lambda d: F.struct(d["s"].alias("s"), F.lit(label).alias("label"))


def op6(docs: DataFrame) -> DataFrame:
    rows = scan(docs.select("doc_id", "text"), ["doc_id"])
    base_labels = F.coalesce(F.array_distinct(F.transform("_base", lambda b: b["label"])), F.array().cast("array<string>"))
    found = F.coalesce(F.filter(F.transform("_kept", lambda d: d["label"]), lambda x: x != ""), F.array().cast("array<string>"))
    starts = F.transform("_base", lambda b: b["s"])
    sure = F.coalesce(F.array_max(F.transform("_kept", lambda d: d["sure"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.when(F.col("_base").isNull(), 0).otherwise(F.size("_base")).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base_labels, found))), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.greatest(sure, F.lit(0.9))).otherwise(sure).alias("score"))
