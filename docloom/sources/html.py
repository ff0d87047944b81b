"""HTML to Markdown with the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_SKIP = {"script", "style", "noscript", "head", "meta", "link"}
_BLOCK = {"p", "div", "article", "section", "nav", "footer", "header", "main", "ul", "ol", "table", "blockquote", "pre"}
_WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def put(self, s: str) -> None:
        (self.out if self.cell is None else self.cell).append(s)

    def end_cell(self) -> None:
        if self.cell is not None:
            text, self.cell = " ".join("".join(self.cell).split()).replace("|", "\\|"), None
            if self.rows:
                self.rows[-1].append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("td", "th", "tr"):
            self.end_cell()  # end tags of cells may be left out
        if tag in _SKIP:
            self.skip += tag not in ("meta", "link")
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.put("[")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.put("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "pre":
            lang = re.search(r"lang(?:uage)?-([\w+#-]+)", a.get("class") or "")
            self.pre += 1
            self.put("\n\n```" + (lang.group(1) if lang else "") + "\n")
        elif tag in _WRAP and not self.pre:
            self.put(_WRAP[tag])
        elif tag == "blockquote":
            self.put("\n\n> ")
        elif tag in _BLOCK:
            self.put("\n\n")
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()})")
        elif tag in ("td", "th", "tr"):
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            rows, self.rows = [r for r in self.rows if r], None
            self.put("\n\n" + markdown_table(rows) + "\n\n")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.put("\n```\n\n")
        elif tag in _WRAP and not self.pre:
            self.put(_WRAP[tag])
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.put("\n\n")
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()

    def handle_data(self, data):
        if not self.skip and self.rows is None or self.cell is not None:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_table(rows: list[list[str]]) -> str:
    """Rows padded to one width; the first is the header."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def to_markdown(html: str | None) -> str | None:
    """Null stays null; scripts, styles and heads are dropped, blank runs collapse."""
    if html is None:
        return None
    r = _Reader()
    r.feed(html)
    r.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(r.out))).strip()
