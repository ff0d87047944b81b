"""Texts cut by structure: byte prefixes, paragraph packs, section texts for the index, and code blocks. All column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import packed, strip_fences


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def byte_prefix(text: Column, size: int) -> Column:
    """The longest prefix of whole characters in at most ``size`` bytes."""
    short = F.octet_length(text) <= size
    whole = F.transform(F.array(F.substring(F.encode(text, "UTF-8"), 1, size)), lambda b: F.regexp_replace(F.make_valid_utf8(b.cast("string")), "�+\\z", ""))[0]
    return F.when(short, text).otherwise(whole)


def clipped_bytes(text: Column, size: int, mark: str = "...") -> Column:
    """``byte_prefix`` and a mark where something is cut off."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(byte_prefix(text, size), F.lit(mark)))


def paragraph_packs(text: Column, size: int) -> Column:
    """Paragraphs, cut at empty lines and stripped, packed in order to ``size`` bytes; a larger one stands alone."""
    return packed(F.transform(F.split(text, "\n\n", -1), stripped), size)


#: A heading of one of the three upper levels, at the start of a line.
HEADING = r"^#{1,3}\s+.+$"


def section_texts(text: Column, whole: int = 8000, pack: int = 3000, least: int = 50, preamble: int = 100) -> Column:
    """Texts for the text index. Up to ``whole`` bytes the text stays as it is. A longer one is cut before its headings:
    sections below ``least`` bytes are left out, those above ``whole`` become packs of paragraphs of ``pack`` bytes. What
    stands before the first heading comes first, if that heading begins after byte ``preamble`` and it has more than
    ``least`` bytes. Without a heading the text is packed."""
    parts = F.split(text, f"(?m)(?={HEADING})", -1)
    opens = lambda p: p.rlike(f"\\A{HEADING[1:-1]}")

    def cut(part: Column) -> Column:
        s, n = stripped(part), F.octet_length(stripped(part))
        section = F.when(n < least, F.array().cast("array<string>")).when(n > whole, paragraph_packs(s, pack)).otherwise(F.array(s))
        before = F.when((F.octet_length(part) > preamble) & (n > least), F.array(s)).otherwise(F.array().cast("array<string>"))
        return F.when(opens(part), section).otherwise(before)

    headed = F.flatten(F.transform(parts, cut))
    long = F.when(F.exists(parts, opens), headed).otherwise(paragraph_packs(text, pack))
    return F.when(F.octet_length(text) <= whole, F.array(text)).otherwise(long)


#: What begins a part of code, by the names of its language. Fixed values.
BOUNDARIES = {
    ("go", "golang"): "func |type |var |const ",
    ("python", "py"): "class |def |async def ",
    ("javascript", "js", "typescript", "ts"): "function |class |const |export |async function ",
}


def code_blocks(block: Column, language: Column, size: int) -> Column:
    """Parts (chunk_type, content) of a code block with or without fences. A block of at most ``size`` bytes is one part,
    ``code``. Known languages are cut before top-level declarations if they have two or more: ``code_function``, and
    ``code_preamble`` for what stands before the first. JSON, by name or by its first sign, is cut by the keys of an object
    (``json_key``, or ``json_key_large`` above twice the size; sorted by key) or by ten elements of an array
    (``json_array_batch``), if it has two or more. Anything else is packed by empty lines (``code_section``), and what has
    none of them stays one part. A null block gives null. Parts other than ``code`` are fenced; JSON values lose blanks between their signs."""
    low, code = F.lower(F.coalesce(language, F.lit(""))), strip_fences(block)
    part = lambda kind, c, lang: F.struct(F.lit(kind).alias("chunk_type"), F.concat(F.lit("```"), lang, F.lit("\n"), c, F.lit("\n```")).alias("content"))
    alone = F.array(F.struct(F.lit("code").alias("chunk_type"), block.alias("content")))
    tag = F.coalesce(language, F.lit(""))

    pieces = F.split(code, r"\n\n+", -1)
    packs = F.transform(packed(F.transform(pieces, stripped), size), lambda c: part("code_section", c, tag))
    generic = F.when((F.size(pieces) > 1) & (F.size(packs) > 0), packs).otherwise(alone)

    def by_declaration(start: str) -> Column:
        found = F.filter(F.transform(F.split(code, rf"(?m)(?=^(?:{start}))", -1), lambda p: F.struct(p.rlike(rf"\A(?:{start})").alias("opens"), stripped(p).alias("text"))), lambda p: p["text"] != "")
        named = F.transform(found, lambda p: F.when(p["opens"], part("code_function", p["text"], tag)).otherwise(part("code_preamble", p["text"], tag)))
        return F.when(F.size(F.filter(found, lambda p: p["opens"])) > 1, named).otherwise(generic)

    value = F.try_parse_json(stripped(code))
    keys = F.map_entries(value.cast("map<string,variant>"))
    items = value.cast("array<variant>")
    json = F.lit("json")

    def by_key(e: Column) -> Column:
        body = F.concat(F.lit('{"'), e["key"], F.lit('": '), F.to_json(e["value"]), F.lit("}"))
        return F.when(F.octet_length(body) + 12 <= 2 * size, part("json_key", body, json)).otherwise(part("json_key_large", body, json))

    batches = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(10)), lambda i: part("json_array_batch", F.to_json(F.slice(items, i + 1, 10)), json))
    shape = F.left(stripped(code), F.lit(1))
    parsed = F.when((shape == "{") & value.isNotNull(), F.when(F.size(keys) > 1, F.transform(F.array_sort(keys, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), by_key)).otherwise(generic))
    parsed = parsed.when((shape == "[") & value.isNotNull(), F.when(F.size(items) > 1, batches).otherwise(generic)).otherwise(generic)

    out = F.when(block.isNull(), None).when(F.octet_length(block) <= size, alone).when(low == "json", parsed)
    for names, start in BOUNDARIES.items():
        out = out.when(low.isin(*names), by_declaration(start))
    return out.when(shape.isin("{", "["), parsed).otherwise(generic)
