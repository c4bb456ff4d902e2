"""Formats that are read with the standard library alone."""

import io
import zipfile

from folio.sources import office
from folio.sources import parsers as S
from folio.sources.markup import html_blocks


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(**{"[Content_Types].xml": "<a/>", "word/document.xml": f"""<w:document {W}><w:body>
 <w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Lease</w:t></w:r></w:p>
 <w:p><w:r><w:t>The rent </w:t></w:r><w:r><w:t>is due.</w:t></w:r></w:p>
 <w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>first</w:t></w:r></w:p>
 <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""})  # fmt: skip
XLSX = archive(**{
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Costs" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>item</t></si><si><r><t>pr</t></r><r><t>ice</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>pen</t></is></c><c r="C2"><v>1.5</v></c></row></sheetData></worksheet>',
})
PPTX = archive(**{"ppt/presentation.xml": "<p/>", **{f"ppt/slides/slide{n}.xml": f'<sld><sp><nvPr><ph type="title"/></nvPr><txBody><p><r><t>Slide {n}</t></r></p></txBody></sp><sp><txBody><p><r><t>body</t></r></p></txBody></sp></sld>' for n in (1, 2, 10)}})
ODT = archive(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": "<d><body><text><h>Head</h><p>one <span>two</span></p><list><list-item><p>item</p></list-item></list></text></body></d>"})
ODS = archive(mimetype="application/vnd.oasis.opendocument.spreadsheet", **{"content.xml": '<d xmlns:t="t"><body><spreadsheet><table t:name="S"><table-row><table-cell t:number-columns-repeated="2"><p>x</p></table-cell><table-cell t:number-columns-repeated="16000"/></table-row><table-row t:number-rows-repeated="1000000"><table-cell/></table-row></table></spreadsheet></body></d>'})


def test_office():
    assert office.docx(DOCX) == [[("heading", "Lease"), ("paragraph", "The rent is due."), ("list_item", "first"), ("table", "a | b")]]
    assert S.PARSERS["xlsx"](XLSX) == [[("heading", "Sheet: Costs"), ("table", "item |  | price\npen |  | 1.5")]]
    assert [p[0] for p in office.pptx(PPTX)] == [("heading", "Slide 1"), ("heading", "Slide 2"), ("heading", "Slide 10")]
    assert office.odt(ODT) == [[("heading", "Head"), ("paragraph", "one two"), ("list_item", "item")]]
    assert office.ods_sheets(ODS)[0][1][0] == ["x", "x"]
    assert [office.kind_of(x) for x in (DOCX, XLSX, PPTX, ODT, ODS, archive(a="b"))] == ["docx", "xlsx", "pptx", "odt", "ods", None]


def test_rtf():
    text = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 " + b"\\" + rb"u8211? end\par Second {\b bold}\par}"
    assert S.parse_rtf(text) == [[("paragraph", "Café – end"), ("paragraph", "Second bold")]]


def test_html():
    text = "<!doctype html><head><title>Ti tle</title><style>p{}</style></head><body>a<p>one <b>two</b><p>three<br>four<ul><li>x<li>y<ul><li>z</ul></ul><script>no</script><table><caption>cap</caption><tr><th>h<td>1<tr><td>2<td></table><h2>End<i>ing</i></h2></p></div>tail"
    assert html_blocks(text) == [
        ("heading", "Ti tle"), ("paragraph", "a"), ("paragraph", "one two"), ("paragraph", "three"), ("paragraph", "four"), ("list_item", "x"), ("list_item", "y"), ("list_item", "z"), ("paragraph", "cap"), ("table", "h | 1\n2 | "),
        ("heading", "Ending"), ("paragraph", "tail"),
    ]
    assert html_blocks("<div>" * 5000 + "deep" + "</div>" * 5000) == [("paragraph", "deep")]
    assert html_blocks("") == [] and html_blocks("<title>T</title><h1>T</h1>") == [("heading", "T")]


def test_files(spark, tmp_path):
    for name, content in {"a.docx": DOCX, "b": XLSX, "c.png": b"\x89PNG\r\n\x1a\n..", "d.odt": ODT, "e.docx": archive(**{"word/document.xml": "<!DOCTYPE x><a/>"}), "f.csv": b"h,v\n" + b"r,1\n" * 20_500}.items():
        (tmp_path / name).write_bytes(content)
    files = S.read_folder(spark, str(tmp_path))
    first = S.parse_files(files).collect()
    assert sum(r["error"] is not None for r in first) == 2  # no engine, and a declaration
    assert sum(r["text"].count("\nr | 1") for r in first if r["text"]) == 20_500
    S.OCR["engine"] = lambda image: [("read  text", 0.9)]
    try:
        assert "read text" in [r["text"] for r in S.parse_files(files).collect()]
    finally:
        S.OCR["engine"] = None
