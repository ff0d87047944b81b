"""Section texts, code blocks and byte prefixes on hand-made cases."""

from __future__ import annotations

import pytest
from docloom.functions import sections as X
from pyspark.sql import functions as F


def of(spark, text, make, *more):
    return spark.createDataFrame([(text, *more)], "t string" + "".join(f", m{i} string" for i in range(len(more)))).select(make.alias("x")).first().x


def para(n, w="word"):
    return (f"{w} " * n).strip()


def test_section_texts(spark):
    cut = lambda t: of(spark, t, X.section_texts(F.col("t")))
    assert cut("# short\n\ntext") == ["# short\n\ntext"] and cut("") == [""] and cut(None) is None
    long = para(1500)
    assert cut(f"{para(30)}\n# One\n{long}\n## tiny\nx\n### Two\n{long}\n#### not a border") == [para(30), f"# One\n{long}", f"### Two\n{long}\n#### not a border"]
    assert cut(f"small\n# One\n{long}\n# Two\n{long}") == [f"# One\n{long}", f"# Two\n{long}"]  # 6 bytes before the first heading
    huge = "\n\n".join([para(500)] * 4)
    assert cut(f"# Big\n\n{huge}") == [f"# Big\n\n{para(500)}", *[para(500)] * 3]
    assert cut("\n\n".join([para(300), para(290), para(700), para(1)] * 2)) == [f"{para(300)}\n\n{para(290)}", para(700), f"{para(1)}\n\n{para(300)}\n\n{para(290)}", para(700), para(1)]


@pytest.mark.parametrize("n,want", [(0, ""), (1, "a"), (2, "a"), (3, "aé"), (5, "aé"), (6, "aé日"), (9, "aé日"), (10, "aé日😀"), (99, "aé日😀")])
def test_byte_prefix(spark, n, want):
    assert of(spark, "aé日😀", X.byte_prefix(F.col("t"), n)) == want
    assert of(spark, "aé日😀", X.clipped_bytes(F.col("t"), n)) == (want if n >= 10 else want + "...")


@pytest.mark.parametrize(
    "code,lang,want",
    [
        ("```go\nx\n```", "go", [("code", "```go\nx\n```")]),
        ("func a() {}\n\nfunc b() {}", "golang", [("code_function", "```golang\nfunc a() {}\n```"), ("code_function", "```golang\nfunc b() {}\n```")]),
        ("import a\n\ndef f(): pass\nasync def g(): pass", "PY", [("code_preamble", "```PY\nimport a\n```"), ("code_function", "```PY\ndef f(): pass\n```"), ("code_function", "```PY\nasync def g(): pass\n```")]),
        ("def only(): pass", "py", [("code", "def only(): pass")]),
        ("12345678\n\n\nabcdefgh\n\nx", None, [("code_section", "```\n12345678\n```"), ("code_section", "```\nabcdefgh\n\nx\n```")]),
        ('{"a": 1}  \n  ', "json", [("code", '{"a": 1}  \n  ')]),
        ('{"b": {"c": [1, 2]}, "a": 1}', "", [("json_key", '```json\n{"a": 1}\n```'), ("json_key_large", '```json\n{"b": {"c":[1,2]}}\n```')]),
        ('["0123456789"]', "", [("code", '["0123456789"]')]),
        (str(list(range(12))), "json", [("json_array_batch", "```json\n[0,1,2,3,4,5,6,7,8,9]\n```"), ("json_array_batch", "```json\n[10,11]\n```")]),
        ("{broken json here", "json", [("code", "{broken json here")]),
        ("", "go", [("code", "")]),
    ],
)
def test_code_blocks(spark, code, lang, want):
    got = of(spark, code, X.code_blocks(F.col("t"), F.col("m0"), 10), lang)
    assert [tuple(x) for x in got] == want


def test_code_block_of_null(spark):
    assert of(spark, None, X.code_blocks(F.col("t"), F.col("m0"), 10), "go") is None
