"""Text predicates and features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_heading(line: Column) -> Column:
    return F.trim(line).rlike(r"^#{1,6}\s+")


def is_rule(line: Column) -> Column:
    return F.regexp_replace(line, " ", "").rlike(r"^(-{3,}|\*{3,}|_{3,})$")


def is_table_row(line: Column) -> Column:
    return F.trim(line).rlike(r"^\|.*\|")


def is_table_separator(line: Column) -> Column:
    t = F.trim(line)
    return t.rlike(r"^[|\-: ]+$") & F.contains(t, F.lit("|")) & (F.regexp_count(t, F.lit("-")) >= 3)


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*([-*+]|\d+\.)\s+")


def sentences(text: Column) -> Column:
    """What stands between sentence marks, without blanks around it."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^。！？.!?]+"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""))


def language(text: Column, size: int = 2000) -> Column:
    """zh, ja, en, mixed or unknown by shares of CJK and Latin letters in the first characters."""
    s = F.left(F.coalesce(text, F.lit("")), F.lit(size))
    count = lambda p: F.length(F.regexp_replace(s, p, "")).cast("double")
    cjk, latin = count(r"[^\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"), count(r"[^A-Za-z]")
    other = count(r"[\x00-\x7f\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]")
    whole = cjk + latin + other
    return (
        F.when(whole == 0, "unknown")
        .when((cjk / whole > 0.3) & (latin / whole > 0.3), "mixed")
        .when(cjk / whole > 0.5, F.when(s.rlike(r"[\x{3040}-\x{30ff}]"), "ja").otherwise("zh"))
        .when(latin / whole > 0.5, "en")
        .otherwise("unknown")
    )


def language_shares(text: Column) -> Column:
    """(language, confidence) by the shares of CJK, Latin and other letters in the whole text."""
    s = F.coalesce(text, F.lit(""))
    count = lambda p: F.length(F.regexp_replace(s, p, "")).cast("double")
    cjk, latin = count(r"[^\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"), count("[^A-Za-z]")
    other = count(r"[\x00-\x7f\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]")

    def decide(n: Column) -> Column:
        whole = n["c"] + n["l"] + n["o"]
        c, l = n["c"] / F.nullif(whole, F.lit(0.0)), n["l"] / F.nullif(whole, F.lit(0.0))
        both = lambda name, sure: F.struct(F.lit(name).alias("language"), sure.cast("double").alias("confidence"))
        return (
            F.when(whole == 0, both("unknown", F.lit(0.0)))
            .when((c > 0.3) & (l > 0.3), both("mixed", F.lit(0.6)))
            .when(c > 0.5, F.when(s.rlike(r"[\x{3040}-\x{30ff}]"), both("ja", c)).otherwise(both("zh", c)))
            .when(l > 0.5, both("en", l))
            .otherwise(both("unknown", F.lit(0.5)))
        )

    return F.transform(F.array(F.struct(cjk.alias("c"), latin.alias("l"), other.alias("o"))), decide)[0]


#: What begins a top-level part of code. Fixed values.
_DECLARATIONS = {
    "go": r"(?:func|type|var|const)\s",
    "python": r"(?:def|class|async def|@)\s?",
    "javascript": r"(?:function|class|const|let|var|export)\s",
}


def code_sections(code: Column, language: str) -> Column:
    """Code split before each line that begins a top-level declaration; what stands before the first of
    them is a part of its own. Other languages are split at blank lines. An array without empty parts."""
    start = _DECLARATIONS.get(language)
    parts = F.split(code, rf"(?m)(?=^{start})" if start else r"\n\n+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")


def query_language(text: Column) -> Column:
    """zh where Chinese signs outnumber Latin letters, en where there are such letters, else unknown."""
    count = lambda p: F.length(F.regexp_replace(text, p, ""))
    return F.when(count(r"[^\x{4e00}-\x{9fff}]") > count("[^A-Za-z]"), "zh").when(count("[^A-Za-z]") > 0, "en").otherwise("unknown")


def document_type(text: Column, rules: list[tuple[str, str]], default: str, brief: int = 300) -> Column:
    """Rules in place of a model: texts below ``brief`` bytes are briefs, else the first of the rules
    (type, pattern in lower case) that matches decides."""
    low, out = F.lower(text), F.when(F.octet_length(text) < brief, "brief")
    for name, pattern in rules:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(default)


#: Words that are no keywords. Fixed values.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be have has had do does did will would should could "
    "may might can this that these those i you he she it we they var func return if else while true false null nil "
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去"
).split()


def strip_fences(text: Column) -> Column:
    """The lines of a fenced code block without its first and last fence, where it has them."""
    lines = F.split(text, "\n", -1)
    fence = lambda c: F.coalesce(F.trim(c).rlike("^(```|~~~)"), F.lit(False))
    first = F.when(fence(lines[0]), 2).otherwise(1)
    last = F.size(lines) - F.when((F.size(lines) > 1) & fence(F.element_at(lines, -1)), 1).otherwise(0)
    return F.when(F.size(lines) < 2, text).otherwise(F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def query_terms(text: Column, more: Column) -> Column:
    """The sorted set of a query's parts of more than one byte, and of ``more`` names."""
    parts = F.filter(F.split(text, "[ ,。，、!?；：]+"), lambda w: F.octet_length(w) > 1)
    return F.array_sort(F.array_union(parts, more))


def simple_keywords(text: Column, most: int = 5) -> Column:
    """The first words; without any, the whole text."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array(text)).otherwise(F.slice(words, 1, most))


def identifiers(code: Column) -> Column:
    """Distinct names of more than two letters in ASCII code, without stop words."""
    found = F.regexp_extract_all(code, F.lit(r"\b[A-Z][a-zA-Z0-9]+\b|\b[a-z_][a-z0-9_]+\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS)))


def clipped(text: Column, size: int) -> Column:
    """At most ``size`` characters, and three dots where something is cut off."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def packed(parts: Column, size: int, gap: str = "\n\n") -> Column:
    """Greedy packing of texts in order: a part opens a new pack where it would take the current one over
    ``size`` bytes (the gap does not count); empty parts are left out. An array of packs."""
    some = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")

    def step(acc: Column, part: Column) -> Column:
        over = (F.octet_length(acc["now"]) + F.octet_length(part) > size) & (acc["now"] != "")
        joined = F.when(acc["now"] == "", part).otherwise(F.concat(acc["now"], F.lit(gap), part))
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(over, part).otherwise(joined).alias("now"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(some, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def highlight(text: Column, term: Column) -> Column:
    """The first case-insensitive hit between <em> marks, with up to 40 characters on both sides."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.when(
        at > 0,
        F.concat(
            F.substring(text, F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40))),
            F.lit("<em>"),
            F.substring(text, at, F.length(term)),
            F.lit("</em>"),
            F.substring(text, at + F.length(term), F.lit(40)),
        ),
    )
