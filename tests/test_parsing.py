from __future__ import annotations

import io
import zipfile

import pytest
from docloom.functions import markdown as M
from docloom.sources import html, office

#: Kind and text of blocks, in the order in which they stand in the document.
PARTS = [
    ("quote", "> Measure twice,\ncut once."),
    ("table", "| tool | weight |\n| :--- | ---: |\n| saw | 1.5 |\n| plane | 2 |"),
    ("heading", "### Workshop"),
    ("list", "1. clamp\n2. glue\n\n3. wait"),
    ("rule", "* * *"),
    ("paragraph", "Oak splits along the grain;\nash bends."),
    ("code", "~~~sh\necho ```\n\nls\n~~~"),
    ("heading", "# Store"),
    ("code", "```\nnever closed"),
]


def test_block_sequence():
    doc = "\n\n".join(text for _, text in PARTS)
    got = M.blocks(doc)
    assert [(b.kind, b.text) for b in got] == PARTS
    at = 0
    for b, (_, text) in zip(got, PARTS, strict=True):
        assert (b.start, b.end) == (at, at + len(text.encode()))
        at = b.end + 2


@pytest.mark.parametrize(("rows", "made"), [(2, 1), (10, 1), (11, 11), (100, 100), (101, 102)])
def test_table_expansion(rows, made):
    table = "| x | y |\n| --- | --- |\n" + "\n".join(f"| {i} | {i} |" for i in range(rows))
    assert len(M.expand_table(M.blocks(table)[0])) == made


def test_sections_carry_the_path():
    got = M.sections(M.blocks("# A\n\none\n\n## B\n\ntwo\n\n# C\n\nthree"), 500)
    assert [p for *_, p in got] == ["A", "A > B", "C"]


def test_sliding_ends_and_covers():
    text = "x" * 1203
    got = M.sliding(text, 500, 100)
    assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(text)
    with pytest.raises(ValueError):
        M.sliding(text, 100, 100)


def test_html():
    out = html.to_markdown('<head><title>x</title></head><h2>T</h2><p>a <b>b</b><br>c</p><ol><li>x<li>y</ol><table><tr><th>h<td>i|j</table><pre class="language-py">z = 1</pre>')
    assert out.startswith("## T") and "**b**" in out and "1. x" in out and "i\\|j" in out and "```py" in out
    assert html.to_markdown(None) is None and html.to_markdown("") == ""


def test_office_formats():
    assert office.csv_to_markdown("a,b\n1,\"x|y\"\n".encode()) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |"
    assert office.to_text("你好".encode("gbk")) == "你好"
    assert office.format_of("A.HTM") == "html" and office.format_of("none") == "txt"
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert office.parse_document(doc.getvalue(), "docx") == "## T\n\nbody"
    assert office.parse_document(b"no zip", "docx") == "no zip"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>')
    assert office.xlsx_to_markdown(book.getvalue()) == "| 1 |  | 3 |\n| --- | --- | --- |"


def test_usage_stream(spark, tmp_path):
    from docloom.corpus import usage
    from docloom.streaming.usage import usage_windows

    rows = usage(spark, "/root/testdata/sf0.001").withColumn("created_at", __import__("pyspark.sql.functions", fromlist=["col"]).col("created_at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = usage_windows(stream).writeStream.format("memory").queryName("usage_w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage_w").groupBy().sum("calls").first()[0] == rows.count()
