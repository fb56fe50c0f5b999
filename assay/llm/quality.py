"""Quality rules, line first.

Each line with a word is judged alone: punctuation (no letter at all, or over a fifth
of its visible characters are symbols), navigation (three or more bar, arrow or bullet
separators between short items) and boilerplate (a short line with a stock phrase).
Failing lines are cut; a document that loses more than half of its visible characters
this way is rejected, as is one that fails the base rules: under 10 words, or over a
fifth of its words inside repeated five-word windows.

All is done in DataFrame expressions on the row itself: no shuffle, no Python.
Windows are compared by 64-bit hash within their document.

Defined results: a null or empty text has no words and fails; blank lines are never
cut; a repeated row is judged like the first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import common

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_LOST = 0.5
SYMBOLS = r"[#*$%&|<>]"
SPAN = 5
SEPARATORS = r"\x20[|>»›•·/]\x20"
BOILERPLATE = (r"(?i)\b(?:all rights reserved|privacy policy|cookie policy|cookie settings|accept (?:all )?cookies|"
               r"terms of (?:use|service)|terms and conditions|click here|read more|sign (?:in|up)|log ?in|"
               r"subscribe (?:now|to)|share (?:this|on)|follow us|enable javascript|skip to (?:main )?content|"
               r"back to top|powered by|lorem ipsum)\b")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``SPAN`` words that occur at least twice among ``words``."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - SPAN), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SPAN)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = bind(ordered, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
            (x["h"] == F.coalesce(F.get(s, j - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get(s, j + 1)["h"], F.bitwise_not(x["h"]))), x["i"])),
            lambda p: p.isNotNull())))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(found, start, lambda a, p: F.struct(
            (a["n"] + p + SPAN - F.greatest(p, a["end"])).alias("n"), (p + SPAN).alias("end")), lambda a: a["n"])

    # most texts repeat nothing: told by a hash set before anything is sorted
    count = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n >= SPAN, count).otherwise(0)


def line_fails(line: Column) -> Column:
    visible = F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    items = F.regexp_count(line, F.lit(SEPARATORS)) + 1
    no_letter = ~line.rlike(r"\p{L}")
    punctuation = no_letter | (symbols * 5 > visible)
    navigation = (items >= 4) & (visible < items * 24)
    boilerplate = (visible < 160) & line.rlike(BOILERPLATE)
    return line.rlike(common.WORD) & (punctuation | navigation | boilerplate)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the measures, ``_text`` (null text: empty), ``_clean`` (without failing lines) and kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)).alias("_words"),
                       F.split(text, "\n", -1).alias("_lines"))
    spoken = F.filter("_lines", lambda x: x.rlike(common.WORD))
    rows = rows.select(
        *keep, "_text", "_lines", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_left"))
    left = F.regexp_replace(F.array_join("_left", ""), r"[\x20\x09-\x0D]+", "")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    rows = rows.select(
        *keep, "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.size("_left") < F.size("_lines"), F.array_join("_left", "\n")).otherwise(F.col("_text")).alias("_clean"),
        F.when(F.size("_left") < F.size("_lines"), F.length(left)).otherwise(F.col("word_chars")).cast("long").alias("clean_chars"),
        (F.size("_lines") - F.size("_left")).cast("long").alias("n_lines_cut"), failed.alias("base_failed"))
    return rows.withColumn("kept", common.once(
        ~F.col("base_failed") & (F.col("clean_chars") >= F.col("word_chars") * (1 - MAX_LOST))))


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, their failing lines cut from text (and n_chars, if there is one, counted anew where cut)."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = judged(docs.select("text", *[F.col(f"`{c}`").alias(o) for c, o in own.items()]), list(own.values())).filter("kept")
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_clean").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("n_lines_cut") > 0, F.length("_clean")).otherwise(F.col(own[c]))
                       .cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(own[c]).alias(c))
    return rows.select(*out)


def op10(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "clean_chars", "n_lines_cut")
