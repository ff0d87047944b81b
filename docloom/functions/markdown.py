"""Markdown into typed blocks, and the chunk strategies that build on them.

The state machine over lines is per document and runs in Arrow batches; byte spans refer to UTF-8.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+\.)\s+")
_RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})$")


@dataclass
class Block:
    kind: str
    text: str
    start: int
    end: int
    info: dict[str, str] = field(default_factory=dict)


def _kind(line: str) -> str:
    t = line.strip()
    if not t:
        return "blank"
    if t[:3] in ("```", "~~~"):
        return "code"
    if _HEADING.match(t):
        return "heading"
    if _RULE.match(t.replace(" ", "")):
        return "rule"
    if t.startswith("|") and "|" in t[1:]:
        return "table"
    if t.startswith(">"):
        return "quote"
    return "list" if _ITEM.match(line) else "paragraph"


def blocks(text: str) -> list[Block]:
    """Heading, paragraph, list, code, table, quote and rule blocks in order; blank lines separate.

    A fence runs to its own mark or the end; a list runs on over blank lines before another item; a
    quote takes the lines that follow it up to a blank one."""
    lines = text.split("\n")
    at, offsets = 0, []
    for x in lines:
        offsets.append(at)
        at += len(x.encode()) + 1
    out, i = [], 0
    while i < len(lines):
        kind, first = _kind(lines[i]), i
        i += 1
        if kind == "blank":
            continue
        if kind == "code":
            mark = lines[first].strip()[:3]
            while i < len(lines) and not lines[i].strip().startswith(mark):
                i += 1
            i = min(i + 1, len(lines))
        elif kind == "table":
            while i < len(lines) and _kind(lines[i]) == "table":
                i += 1
        elif kind == "quote":
            while i < len(lines) and lines[i].strip():
                i += 1
        elif kind == "paragraph":
            while i < len(lines) and _kind(lines[i]) == "paragraph":
                i += 1
        elif kind == "list":
            while i < len(lines):
                j = i
                while j < len(lines) and not lines[j].strip():
                    j += 1
                if j == len(lines) or (_kind(lines[j]) != "list" and (j > i or _kind(lines[j]) != "paragraph")):
                    break
                i = j + 1
        body = "\n".join(lines[first:i])
        info = {}
        if kind == "heading":
            marks, title = _HEADING.match(lines[first].strip()).groups()
            info = {"level": str(len(marks)), "title": title.strip()}
        elif kind == "code":
            info = {"language": lines[first].strip()[3:].strip()}
        elif kind == "table":
            info = {"rows": str(sum(not _separator(x) for x in lines[first + 1 : i]))}
        out.append(Block(kind, body, offsets[first], offsets[first] + len(body.encode()), info))
    return out


def _separator(line: str) -> bool:
    t = line.strip()
    return bool(t) and not set(t) - set("|-: ") and t.count("-") >= 3


def table_cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def expand_table(block: Block) -> list[Block]:
    """Up to 10 data rows stay a table; more become a row each, after an overview beyond 100."""
    lines = [x for x in block.text.split("\n") if not _separator(x)]
    head, rows = table_cells(lines[0]), lines[1:]
    if len(rows) <= 10:
        return [block]
    out = []
    if len(rows) > 100:
        out.append(Block("paragraph", f"{len(rows)} rows, {len(head)} columns: {', '.join(head)}", block.start, block.end, {"chunk_type": "table_overview"}))
    for r in rows:
        cells = "，".join(f"{h}为{c}" for h, c in zip(head, table_cells(r), strict=False) if c)
        out.append(Block("paragraph", cells, block.start, block.end, {"chunk_type": "table_row"}))
    return out


def pack_blocks(parts: list[Block], size: int) -> list[tuple[str, int, int, str]]:
    """Greedy packing in order, two bytes for each gap; an oversize block is a chunk of its own."""
    out, held, n = [], [], 0

    def flush() -> None:
        if held:
            kinds = {b.kind for b in held}
            kind = {"table": "table", "code": "code", "list": "list"}.get(held[0].kind, "text") if len(held) == 1 else "text"
            out.append(("\n\n".join(b.text for b in held), held[0].start, held[-1].end, kind if len(kinds) == 1 else "text"))
            held.clear()

    for b in parts:
        k = len(b.text.encode())
        if held and n + 2 + k > size:
            flush()
            n = 0
        held.append(b)
        n += k + 2 * (len(held) > 1)
    flush()
    return out


def sections(parts: list[Block], size: int) -> list[tuple[str, int, int, str]]:
    """Chunks by heading with the full heading path; a chunk beyond twice the size is split."""
    out, path, held = [], {}, []

    def flush() -> None:
        if any(b.kind != "heading" for b in held):
            where = " > ".join(path_now)
            for text, a, z, _ in pack_blocks(list(held), 2 * size):
                out.append((text, a, z, where))
            held.clear()

    path_now: list[str] = []
    for b in parts:
        if b.kind == "heading":
            flush()
            level = int(b.info["level"])
            path = {k: v for k, v in path.items() if k < level} | {level: b.info["title"]}
            path_now = [path[k] for k in sorted(path)]
            held = [h for h in held if int(h.info["level"]) < level][-1:]
        held.append(b)
    flush()
    return out


def sliding(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Windows of ``size`` characters, cut at the last line or sentence end past the middle."""
    if not size > overlap >= 0:
        raise ValueError("size must exceed overlap")
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = max(text.rfind("。", at, end), text.rfind("\n", at, end)) + 1
            end = cut if cut > at + size // 2 else end
        out.append((at, text[at:end]))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def parent_child(text: str, size: int) -> list[tuple[int, int | None, str, int, int]]:
    """(parent, child or None, text, start, end): packed parents, and inside each its parts of half the size."""
    out: list[tuple[int, int | None, str, int, int]] = []
    for i, (body, start, end, _) in enumerate(pack_blocks(blocks(text), size)):
        out.append((i, None, body, start, end))
        out += [(i, j, part, start + a, start + z) for j, (part, a, z, _) in enumerate(pack_blocks(blocks(body), size // 2))]
    return out
