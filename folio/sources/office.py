"""Office formats with the standard library alone: OOXML and OpenDocument are archives of XML; RTF is text.

Every archive is checked before anything is unpacked. XML is read without external entities; a document
type declaration is refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from folio.sources.safety import unsafe_archive

Blocks = list[tuple[str, str]]
#: Rows or cells that a repetition may stand for; empty ones beyond are padding to the sheet's end.
REPEATED = 1024


def _open(content: bytes) -> zipfile.ZipFile:
    if why := unsafe_archive(content):
        raise ValueError(why)
    return zipfile.ZipFile(io.BytesIO(content))


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw[:2048] or b"<!ENTITY" in raw[:2048]:
        raise ValueError(f"declaration in {name}")
    return ET.fromstring(raw)


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ET.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _below(element: ET.Element, *names: str) -> Iterator[ET.Element]:
    """The nearest elements of these names, in order."""
    for child in element:
        if _name(child) in names:
            yield child
        else:
            yield from _below(child, *names)


def _said(element: ET.Element, leaf: str = "t") -> str:
    """The text of an element: its leaves, tabulators and breaks."""
    out = []
    for e in element.iter():
        kind = _name(e)
        if kind == leaf:
            out.append(e.text or "")
        elif kind in ("tab", "br", "cr"):
            out.append(" ")
    return " ".join("".join(out).split())


def _line(cells: list[str]) -> str:
    return " | ".join(" ".join(c.split()) for c in cells)


def docx(content: bytes) -> list[Blocks]:
    """One page of blocks: headings by style, list items by numbering, tables by rows; notes and headers left out."""
    body = next(_below(_xml(_open(content), "word/document.xml"), "body"))
    page: Blocks = []
    for e in _below(body, "p", "tbl"):
        if _name(e) == "tbl":
            rows = [[" ".join(filter(None, (_said(p) for p in _below(cell, "p")))) for cell in _below(row, "tc")] for row in _below(e, "tr")]
            if lines := [_line(r) for r in rows if any(r)]:
                page.append(("table", "\n".join(lines)))
        elif text := _said(e):
            style = next((_attribute(s, "val") or "" for s in e.iter() if _name(s) == "pStyle"), "").lower()
            listed = any(_name(s) == "numPr" for s in e.iter()) or style.startswith("list")
            page.append(("heading" if style.startswith(("heading", "title")) else "list_item" if listed else "paragraph", text))
    return [page] if page else []


def pptx(content: bytes) -> list[Blocks]:
    """A page for each slide: its title as a heading, then shapes and tables in order."""
    archive = _open(content)
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    pages = []
    for name in slides:
        page: Blocks = []
        for shape in _below(_xml(archive, name), "sp", "tbl"):
            if _name(shape) == "tbl":
                rows = [[_said(c) for c in _below(r, "tc")] for r in _below(shape, "tr")]
                page.append(("table", "\n".join(map(_line, rows))))
                continue
            title = any(_name(e) == "ph" and (_attribute(e, "type") or "") in ("title", "ctrTitle") for e in shape.iter())
            page += [("heading" if title else "paragraph", text) for p in _below(shape, "p") if (text := _said(p))]
        pages.append(page)
    return [p for p in pages if p]


def _column(reference: str) -> int:
    n = 0
    for c in re.sub(r"[^A-Z]", "", reference.upper()):
        n = n * 26 + ord(c) - 64
    return max(1, n)


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, grid) of each sheet, cells as they are stored (dates as day numbers)."""
    archive = _open(content)
    names = set(archive.namelist())
    shared = [_said(s) for s in _below(_xml(archive, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
    targets = {_attribute(r, "Id"): _attribute(r, "Target") or "" for r in _xml(archive, "xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
    sheets = []
    for number, sheet in enumerate(_below(_xml(archive, "xl/workbook.xml"), "sheet"), 1):
        target = targets.get(_attribute(sheet, "id"), f"worksheets/sheet{number}.xml").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        grid: list[list[str]] = []
        for row in _below(_xml(archive, path), "row") if path in names else ():
            cells: list[str] = []
            for c in _below(row, "c"):
                value = next((v.text or "" for v in c if _name(v) == "v"), "")
                kind = _attribute(c, "t")
                text = (shared[int(value)] if value.isdigit() and int(value) < len(shared) else "") if kind == "s" else _said(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
                cells += [""] * (_column(_attribute(c, "r") or "") - 1 - len(cells))
                cells.append(text)
            grid.append(cells)
        sheets.append((_attribute(sheet, "name") or f"Sheet{number}", grid))
    return sheets


def _open_text(content: bytes) -> ET.Element:
    return next(_below(_xml(_open(content), "content.xml"), "body"))


def _whole(element: ET.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def odt(content: bytes) -> list[Blocks]:
    page: Blocks = []
    for e in _below(_open_text(content), "h", "p", "list", "table"):
        if _name(e) == "table":
            page.append(("table", "\n".join(_line([_whole(c) for c in _below(r, "table-cell")]) for r in _below(e, "table-row"))))
        elif _name(e) == "list":
            page += [("list_item", text) for item in _below(e, "list-item") if (text := _whole(item))]
        elif text := _whole(e):
            page.append(("heading" if _name(e) == "h" else "paragraph", text))
    return [page] if page else []


def ods_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    sheets = []
    for table in _below(_open_text(content), "table"):
        grid: list[list[str]] = []
        for row in _below(table, "table-row"):
            cells: list[str] = []
            for c in _below(row, "table-cell", "covered-table-cell"):
                text, times = _whole(c), int(_attribute(c, "number-columns-repeated") or 1)
                cells += [text] * (times if text or times <= REPEATED else 1)
            while cells and not cells[-1]:
                cells.pop()
            times = int(_attribute(row, "number-rows-repeated") or 1)
            grid += [cells] * (times if cells or times <= REPEATED else 1)
        sheets.append((_attribute(table, "name") or f"Sheet{len(sheets) + 1}", grid))
    return sheets


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Groups without running text.
_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr object themedata datastore listtable listoverridetable generator".split())
_SIGNS = {"par": "\n\n", "line": "\n", "tab": " ", "cell": " | ", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "page": "\f", "sect": "\n\n"}


def rtf_text(content: bytes) -> str:
    """The running text of an RTF file; paragraphs end in a blank line, pages in a form feed."""
    out: list[str] = []
    hidden, above, skip = False, [], 0
    for m in _RTF.finditer(content.decode("latin-1")):
        word, number, byte, sign, brace, text = m.groups()
        if brace == "{":
            above.append(hidden)
        elif brace == "}":
            hidden = above.pop() if above else False
        elif sign == "*" or word in _HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = 1
        elif word:
            out.append(_SIGNS.get(word, ""))
        elif byte:
            out.append("" if skip else bytes.fromhex(byte).decode("cp1252", "replace"))
            skip = 0
        elif sign:
            out.append({"~": "\xa0", "-": "", "_": "-"}.get(sign, sign))
        elif text:
            out.append(text[skip:])
            skip = 0
    joined = "".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def kind_of(content: bytes) -> str | None:
    """Which format an archive holds, by its members."""
    archive = _open(content)
    names = set(archive.namelist())
    if "mimetype" in names:
        return {"text": "odt", "spreadsheet": "ods"}.get(archive.read("mimetype").decode("ascii", "replace").rpartition(".")[2].strip())
    return next((kind for member, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")) if member in names), None)
