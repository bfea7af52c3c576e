"""Text of spreadsheets, word-processor files, PDF files and JSON documents.

Each reader takes a file's bytes and gives pieces: dicts with a kind, the content, and what of
heading, depth, sheet, page, lines and bytes is known. They are plain functions of one file, called
from ``extract`` in Arrow batches; broken input gives no piece or the raw text, never an error.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

#: Rows of a sheet in one chunk.
SHEET_ROWS = 50


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _attr(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _members(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError):
        return None


def _tree(pack: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(pack.read(name))
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, zlib.error):
        return None


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *(line((row + [""] * len(header))[: len(header)]) for row in rows)])


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter() if _name(x) == "t")
    value = next((x.text or "" for x in cell if _name(x) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "b":
        return "true" if value == "1" else "false"
    try:
        return value if kind or not value or float(value).is_integer() and "." not in value else f"{float(value):.2f}"
    except ValueError:
        return value


def spreadsheet(data: bytes) -> Iterator[dict]:
    """Groups of SHEET_ROWS rows as a Markdown table, under the header of the sheet's first row."""
    pack = _members(data)
    book = _tree(pack, "xl/workbook.xml") if pack else None
    if book is None:
        return
    texts, links = _tree(pack, "xl/sharedStrings.xml"), _tree(pack, "xl/_rels/workbook.xml.rels")
    shared = ["".join(t.text or "" for t in item.iter() if _name(t) == "t") for item in texts] if texts is not None else []
    target = {x.get("Id"): x.get("Target", "").lstrip("/").removeprefix("xl/") for x in links} if links is not None else {}
    for sheet in (x for x in book.iter() if _name(x) == "sheet"):
        tree = _tree(pack, "xl/" + target.get(_attr(sheet, "id"), ""))
        if tree is None:
            continue
        rows = []
        for row in (x for x in tree.iter() if _name(x) == "row"):
            cells: dict[int, str] = {}
            for at, cell in enumerate(x for x in row if _name(x) == "c"):
                cells[_column(cell.get("r")) if cell.get("r") else at] = _cell(cell, shared)
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        if not rows:
            continue
        width = max(map(len, rows))
        header = [x.strip() or f"Col{i + 1}" for i, x in enumerate(rows[0] + [""] * (width - len(rows[0])))]
        for start in range(1, max(len(rows), 2), SHEET_ROWS):
            group = rows[start : start + SHEET_ROWS]
            yield {"kind": "SpreadsheetRows", "sheet": sheet.get("name"), "line_start": start if not group else start + 1, "line_end": start + len(group), "content": markdown_table(header, group)}


def _depth(style: str) -> int | None:
    """Of a paragraph style: headings have their digit, titles 1, subtitles 2."""
    low = style.lower()
    if "heading" in low:
        return int(m[0]) if (m := re.search(r"\d", low)) else 1
    return {"title": 1, "subtitle": 2}.get(low)


def word_document(data: bytes) -> Iterator[dict]:
    """A chunk for each heading with the paragraphs and tables under it; lines are counted by blocks."""
    pack = _members(data)
    tree = _tree(pack, "word/document.xml") if pack else None
    body = next((x for x in tree if _name(x) == "body"), None) if tree is not None else None
    if body is None:
        return
    text = lambda e: "".join((x.text or "") if _name(x) == "t" else {"tab": "\t", "br": "\n"}.get(_name(x), "") for x in e.iter())
    line, now = 0, {"heading": "Preamble", "depth": 1, "line_start": 1, "parts": []}
    found = [now]
    for block in body:
        if _name(block) == "tbl":
            rows = [[text(c).strip() for c in r if _name(c) == "tc"] for r in block if _name(r) == "tr"]
            if rows:
                now["parts"].append(markdown_table(rows[0], rows[1:]))
                line += len(rows) + 1
        elif _name(block) == "p" and (said := text(block).strip()):
            line += 1
            style = next((_attr(x, "val") or "" for x in block.iter() if _name(x) == "pStyle"), "")
            if depth := _depth(style):
                now = {"heading": said, "depth": depth, "line_start": line, "parts": []}
                found.append(now)
            else:
                now["parts"].append(said)
        now["line_end"] = max(line, now["line_start"])
    for x in found:
        if parts := x.pop("parts"):
            yield {"kind": "Section", "content": "\n\n".join(parts), **x}


_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*|<[0-9A-Fa-f\s]*>|\bBT\b|\bET\b|T\*|\bT[dD]\b|'", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal whose bracket is at ``at``, and the place after it. Brackets inside may nest."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            if octal := re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4]):
                out.append(int(octal[0], 8) & 255)
                i += 1 + len(octal[0])
                continue
            out += _ESCAPE.get(data[i + 1 : i + 2], data[i + 1 : i + 2].strip(b"\r\n"))
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def pdf_text(stream: bytes) -> str:
    """Text shown between BT and ET; moves to another line end a line."""
    out, at, inside = [], 0, False
    while m := _TOKEN.search(stream, at):
        token, at = m[0], m.end()
        if token in (b"BT", b"ET"):
            inside = token == b"BT"
            out.append("\n")
        elif token[:1] == b"(":
            said, at = _literal(stream, m.start())
            out.append(said.decode("utf-8", "replace") if inside else "")
        elif not inside:
            continue
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            out.append(bytes.fromhex(digits.decode()).decode("utf-8", "replace") if len(digits) % 2 == 0 else "")
        else:
            out.append("\n")
    return "\n".join(x for x in (line.strip() for line in "".join(out).split("\n")) if x)


def pdf(data: bytes) -> Iterator[dict]:
    """A page for each content stream with text; else printable runs; else a placeholder."""
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            raw = zlib.decompressobj().decompress(m[1])
        except zlib.error:
            raw = m[1]
        if said := pdf_text(raw):
            pages.append(said)
    if not pages:
        runs = [x.decode().strip() for x in re.findall(rb"[\x20-\x7E]{4,}", data)]
        pages = ["\n".join(x for x in runs if len(x) > 3)] if any(len(x) > 3 for x in runs) else ["[no text in this file]"]
    line = 1
    for n, page in enumerate(pages, 1):
        count = page.count("\n") + 1
        yield {"kind": "Page", "page_start": n, "page_end": n, "line_start": line, "line_end": line + count - 1, "content": page}
        line += count


def json_document(data: bytes) -> Iterator[dict]:
    """A chunk for each key of an object or element of an array; other or broken JSON is one chunk."""
    raw = data.decode("utf-8", "replace")
    pretty = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        if raw:
            yield {"kind": "TextParagraph", "byte_start": 0, "byte_end": len(data), "content": raw}
        return
    if isinstance(value, dict):
        at = 0
        for key in sorted(value):
            said = f'"{key}": {pretty(value[key])}'
            yield {"kind": "JsonObject", "heading": key, "byte_start": at, "byte_end": at + len(said.encode()), "content": said}
            at += len(said.encode())
    else:
        for x in value if isinstance(value, list) else [None]:
            yield {"kind": "JsonObject", "byte_start": 0, "byte_end": len(data), "content": pretty(x) if isinstance(value, list) else raw}
