"""Secret scans: fixed shapes, and sliding-window Shannon entropy per character class.

Shapes (assign, access, hex) are leftmost, non-overlapping matches per kind; those that
are too short are dropped. Beside them, candidates are maximal runs of a character
class (hex digits; base64 letters; lower-case or upper-case letters with digits), cut
where an allow-listed word, plain sequence or repeat stands in them. A window moves over each candidate; its counts of
characters, and the sum of c * log2(c) over them, are kept up to date by the one character
that enters and the one that leaves. Windows at or above the class's threshold are joined
into spans. Candidates that are identifiers and spans inside a fixed-shape span are
dropped.

All is done in DataFrame expressions on the row itself: no shuffle, no Python.
Positions are code points, ends exclusive; they are sums over what lies between matches,
in linear time however many matches a text has.

Defined results: a null or empty text has no spans; repeated rows are scanned each; texts
of any length are scanned whole; an empty table gives no rows; other columns are not read
(``redact`` keeps them, whatever they are named).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import common
from assay.llm.quality import bind

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{24,}"  # the runs of HEX that pass: a run is maximal, so its length alone decides
# class, its characters, what a candidate must hold, window, bits a character
CHARS = [
    ("entropy_hex", "0-9A-Fa-f", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 24, 2.9),
    ("entropy_base64", "A-Za-z0-9+/_=-", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 20, 3.8),
    ("entropy_lower", "a-z0-9", r"^(?=.*[0-9])(?=.*[a-z])", 20, 3.5),  # base36
    ("entropy_upper", "A-Z0-9", r"^(?=.*[0-9])(?=.*[A-Z])", 20, 3.5),  # base32
]
WORDS = "(?i:example|sample|placeholder|changeme|dummy|x{6,}|01234567|abcdefgh)"
#: Whole candidates that are identifiers, not secrets.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def between(chars: str, least: int) -> str:
    """Runs of at least ``least`` of ``chars`` between allow-listed words and repeats, which match alone and are too short or plain
    to have windows: no window overlaps one."""
    plain = rf"(?:{WORDS}|([{chars}])\1{{7,}})"
    tempered = rf"(?:(?!{WORDS}|([{chars}])\2{{7,}})[{chars}])"
    return rf"{plain}|(?=[{chars}]{{{least}}}){tempered}{{{least},}}"


# class, run of its characters, what a candidate must hold, window, bits a character
CLASSES = [(name, between(chars, window), needs, window, bits) for name, chars, needs, window, bits in CHARS]
KINDS = ["assign", "access", "hex", *[c[0] for c in CLASSES]]
MARK = "[SECRET]"
CUT = 256  # spans replaced in a part of a text
SPAN = "struct<start:int,end:int,k:int>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches in order: start, end and the text of ``group``. What lies between them gives the positions."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def positions(b: Column, w: Column) -> Column:
        steps = F.transform(w, lambda m, i: F.length(m) + F.length(F.get(b, i + 1)))
        first = F.length(F.get(b, F.lit(0)))
        at = common.running(steps, F.lit(0), lambda x, y: x + y)
        rows = F.arrays_zip(w.alias("w"), (part if group else w).alias("p"), at.alias("at"))
        return F.transform(rows, lambda m: F.struct((first + m["at"]).alias("start"), (first + m["at"] + F.length(m["w"])).alias("end"), m["p"].alias("m")))

    return F.when(text.rlike(pattern), bind(between, lambda b: bind(whole, lambda w: positions(b, w)))).otherwise(none)


def base_spans(text: Column) -> Column:
    def of(k: int, matches: Column, passes) -> Column:
        return F.transform(F.filter(matches, lambda m: passes(m["m"])),
                           lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("k")))
    return F.sort_array(F.concat(
        of(0, found(text, ASSIGN, 1), lambda m: F.length(m) >= 6),
        of(1, F.when(F.contains(text, F.lit("AKIA")), found(text, ACCESS)).otherwise(F.array()), lambda m: F.length(m) >= 20),
        of(2, found(text, LONG_HEX), lambda m: F.lit(True)).cast(f"array<{SPAN}>"))).cast(f"array<{SPAN}>")


def hot_windows(chars: Column, at: Column, k: int, alphabet: int, window: int, bits: float) -> Column:
    """Spans of windows with at least ``bits`` of entropy a character over ``chars``, places in an alphabet of that size; ``at``:
    position of the first. The state holds the counts of all characters in the window, changed by the one that enters and
    the one that leaves, and the sum of c * log2(c) over them."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 3)])
    most = F.lit(window * (math.log2(window) - bits) + 1e-9)  # entropy >= bits just if the sum is no more than this

    def step(a: Column, i: Column) -> Column:
        full = i >= window
        x, y = F.get(chars, i), F.when(full, F.get(chars, i - window)).otherwise(-1)
        n_in = F.get(a["n"], x)
        n_out = F.get(a["n"], F.greatest(y, F.lit(0))) + F.when(x == y, 1).otherwise(0)
        grown = a["s"] + F.get(table, n_in + 1) - F.get(table, n_in)
        s = F.when(full, grown - F.get(table, n_out) + F.get(table, n_out - 1)).otherwise(grown)
        n = F.when(x == y, a["n"]).otherwise(F.transform(a["n"], lambda c, j: c + F.when(j == x, 1).when(j == y, -1).otherwise(0)))
        hot = lambda s: (i >= window - 1) & (s <= most)
        # spans that overlap are joined: only the last one is open, the others lie behind it
        joined = a["last"].isNotNull() & (a["last"]["end"] >= at + i + 1 - window)
        mine = F.struct(F.when(joined, a["last"]["start"]).otherwise(at + i + 1 - window).alias("start"), (at + i + 1).alias("end"), F.lit(k).alias("k"))
        return bind(s, lambda v: F.struct(v.alias("s"), n.alias("n"), F.when(hot(v), mine).otherwise(a["last"]).alias("last"),
                                          F.when(hot(v) & ~joined & a["last"].isNotNull(), F.concat(a["out"], F.array(a["last"]))).otherwise(a["out"]).alias("out")))

    none = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(F.lit(0.0).alias("s"), F.array_repeat(F.lit(0), alphabet).alias("n"), F.lit(None).cast(SPAN).alias("last"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step,
                       lambda a: F.when(a["last"].isNull(), none).otherwise(F.concat(a["out"], F.array(a["last"]))))


def alphabet_of(chars: str) -> str:
    """The characters of a class written with ranges."""
    return "".join("".join(map(chr, range(ord(m[0]), ord(m[2]) + 1))) if len(m) == 3 else m for m in re.findall(r".-(?=.).|.", chars))


def entropy_spans(text: Column) -> Column:
    def of(k: int, run: str, needs: str, window: int, bits: float) -> Column:
        some = text.rlike(f"[{CHARS[k - 3][1]}]{{{window},}}")  # most texts have no run that is long enough
        none = F.array().cast("array<struct<start:int,end:int,m:string>>")
        candidates = F.filter(F.when(some, found(text, run)).otherwise(none), lambda m: (F.length(m["m"]) >= window)
                              & m["m"].rlike(needs) & ~m["m"].rlike(ALLOWED))
        letters = alphabet_of(CHARS[k - 3][1])
        return F.flatten(F.transform(candidates, lambda m: bind(
            F.transform(F.split(m["m"], ""), lambda c: F.instr(F.lit(letters), c) - 1),
            lambda c: hot_windows(c, m["start"], k, len(letters), window, bits))))
    return F.concat(*[of(k, *c[1:]) for k, c in enumerate(CLASSES, start=3)])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text``, ``_base`` and ``_all``: arrays of (start, end, kind's number), in order."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("_base", base_spans(F.col("_text"))).withColumn("_more", entropy_spans(F.col("_text")))
    # all spans by start, fixed shapes first: an entropy span lies in one of those just if one that began by then reaches its end
    both = F.sort_array(F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(flag).alias("flag"), s["end"].alias("end"),
                                                                     s["k"].alias("k"))) for c, flag in (("_base", 0), ("_more", 1))]))

    def outside(all_: Column) -> Column:
        reach = common.running(F.transform(all_, lambda s: F.when(s["flag"] == 0, s["end"]).otherwise(-1)), F.lit(-1), F.greatest)
        kept = F.filter(F.arrays_zip(all_.alias("s"), reach.alias("r")), lambda m: (m["s"]["flag"] == 1) & (m["r"] < m["s"]["end"]))
        return F.transform(kept, lambda m: F.struct(m["s"]["start"].alias("start"), m["s"]["end"].alias("end"), m["s"]["k"].alias("k")))

    more = F.when(F.size("_more") > 0, bind(both, outside)).otherwise(F.array().cast(f"array<{SPAN}>"))
    ordered = F.transform(F.sort_array(F.transform(F.concat("_base", more), lambda s: F.struct(
        s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))
    by_kind = F.transform(F.sort_array(F.transform("_base", lambda s: F.struct(
        s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))
    return rows.withColumn("_all", F.when(F.size("_more") > 0, ordered).otherwise(by_kind)).withColumn("_base", by_kind).drop("_more")


def written(spans: str) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret (overlapping spans joined) replaced by a mark in text; n_chars follows where changed."""
    rows = scan(docs)
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.lit(0).alias("k"))

    def joined(reach: Column) -> Column:
        """Spans that begin behind all before them, each to where those before the next one end."""
        heads = F.filter(F.arrays_zip(F.col("_all").alias("s"), reach.alias("r")), lambda m: m["s"]["start"] > m["r"])
        last = F.array_max(F.transform("_all", lambda s: s["end"]))
        return bind(heads, lambda h: F.transform(h, lambda m, i: span(m["s"]["start"], F.coalesce(F.get(h, i + 1)["r"], last))))

    merged = bind(common.running(F.transform("_all", lambda s: s["end"]), F.lit(-1), F.greatest), joined)
    # the text is cut once for each CUT spans, and those parts again: no span goes through the whole text
    def cut(m: Column) -> Column:
        def of_block(j: Column) -> Column:
            begin = F.coalesce(F.get(m, j * CUT - 1)["end"], F.lit(0))
            return bind(F.slice(m, j * CUT + 1, CUT), lambda own: bind(
                F.substr("_text", begin + 1, F.element_at(own, -1)["end"] - begin), lambda part: F.transform(own, lambda s, i: F.substr(
                    part, F.coalesce(F.get(own, i - 1)["end"], begin) - begin + 1, s["start"] - F.coalesce(F.get(own, i - 1)["end"], begin)))))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CUT).cast("int")), of_block)
        return F.concat(F.flatten(blocks), F.array(F.substr("_text", F.element_at(m, -1)["end"] + 1, F.length("_text"))))

    pieces = bind(merged, cut)
    rows = rows.withColumn("_new", F.when(F.size("_all") > 0, F.array_join(pieces, MARK)))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.coalesce("_new", "text").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("_new").isNotNull(), F.length("_new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)


def op5(docs: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("_base", lambda s: s["k"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written("_base"), 256).alias("base_sha256"), written("_all").alias("spans"))
