"""CSV, DOCX, XLSX and unknown-encoding bytes to Markdown, and the dispatch by file name."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from docloom.sources.html import markdown_table, to_markdown

FORMATS = {"doc": "docx", "xls": "xlsx", "htm": "html", "ppt": "pptx", "md": "markdown", "markdown": "markdown"}
_KNOWN = {"docx", "xlsx", "html", "csv", "pdf", "txt", "markdown", "pptx"}


def format_of(name: str) -> str:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    ext = FORMATS.get(ext, ext)
    return ext if ext in _KNOWN else "txt"


def to_text(data: bytes) -> str:
    """UTF-8, else GBK, else GB18030, else UTF-8 with replacement characters."""
    for coding in ("utf-8", "gbk", "gb18030"):
        try:
            return data.decode(coding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def _clean(rows: list[list[str]]) -> list[list[str]]:
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows]
    return [r for r in rows if any(r)]


def csv_to_markdown(data: bytes) -> str:
    text = to_text(data)
    rows = _clean(list(csv.reader(io.StringIO(text))))
    if rows and max(map(len, rows)) == 1 and "\t" in text:
        rows = _clean(list(csv.reader(io.StringIO(text), delimiter="\t")))
    return markdown_table(rows)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraph(p) -> str:
    out = []
    for e in p.iter():
        name = _local(e.tag)
        out.append(e.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name == "br" else "")
    return "".join(out)


def docx_to_markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next(e for e in root.iter() if _local(e.tag) == "body")
    parts = []
    for e in body:
        if _local(e.tag) == "p":
            style = next((v for s in e.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"Heading([1-4])", style)
            parts.append(("#" * int(level.group(1)) + " " if level else "") + _paragraph(e))
        elif _local(e.tag) == "tbl":
            rows = [[_paragraph(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            parts.append(markdown_table(_clean(rows)))
    return "\n\n".join(p for p in parts if p.strip())


def xlsx_to_markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        shared = [_paragraph(s) for s in (read("xl/sharedStrings.xml") or [])]
        names = [s.attrib.get("name", "") for s in (read("xl/workbook.xml") or ElementTree.Element("x")).iter() if _local(s.tag) == "sheet"]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for i, sheet in enumerate(sheets):
            rows = []
            for r in (e for e in read(sheet).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for c in (x for x in r if _local(x.tag) == "c"):
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), _paragraph(c))
                    col = 0
                    for ch in re.sub(r"\d", "", c.attrib.get("r", "")):
                        col = col * 26 + ord(ch) - 64
                    cells[(col or len(cells) + 1) - 1] = shared[int(v)] if c.attrib.get("t") == "s" and v else v
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            table = markdown_table(_clean(rows))
            name = names[i] if i < len(names) else f"Sheet{i + 1}"
            if table:
                out.append(table if len(sheets) == 1 and name == "Sheet1" else f"## {name}\n\n{table}")
    return "\n\n---\n\n".join(out)


def parse_document(data: bytes, kind: str) -> str:
    """Markdown of a file's bytes; a file that its parser cannot read is taken as text."""
    parsers = {"html": lambda b: to_markdown(to_text(b)), "csv": csv_to_markdown, "docx": docx_to_markdown, "xlsx": xlsx_to_markdown}
    try:
        return parsers.get(kind, to_text)(data)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, csv.Error, StopIteration):
        return to_text(data)
