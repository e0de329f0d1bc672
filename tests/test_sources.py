"""Parsers on small documents made here."""

import io
import struct
import zipfile
import zlib

import pytest

from chunkloom.model import DocError
from chunkloom.sources import html, office, pdf, plain, reader


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def texts(blocks):
    return [(b.element_type, b.text) for b in blocks]


def test_plain_text():
    assert texts(plain.parse_plain("a\n b \n\n\nc\r\n")) == [("narrative_text", "a b"), ("narrative_text", "c")]
    assert texts(plain.parse_plain("")) == [("narrative_text", "")]


def test_other_bytes_are_windows_1252():
    assert plain.decode(b"caf\xe9 \x81") == ("café \x81", False)
    assert texts(plain.parse_text_format(b"# caf\xe9", "md", "text")) == [("narrative_text", "# café")]


def test_markdown():
    got = plain.parse_markdown("# A\ntext\nmore\n\n12. item\n - no item\n```\n\n x\n```\n#\n```\nopen")
    assert texts(got) == [("title", "A"), ("narrative_text", "text more"), ("list_item", "item"), ("narrative_text", "- no item"), ("code_block", " x"), ("title", ""), ("code_block", "open")]
    assert plain.parse_markdown("") == []


def test_xml():
    got = plain.parse_xml(b"<a>x<b>y &amp; z</b><c/>w</a>")
    assert [(b.text, b.hierarchy) for b in got] == [("x", ["a"]), ("y & z", ["a", "b"]), ("w", ["a"])]
    with pytest.raises(DocError):
        plain.parse_xml(b"<a><b></a>")


def test_delimited():
    (b,) = plain.parse_delimited(b'a;b\n"x;1";"y\nz"\n\n1\n')
    assert (b.headers, b.rows, b.text) == (["a", "b"], [["x;1", "y\nz"], ["1"]], "Table with 2 columns (a, b) and 2 rows")


def test_html_kinds_and_implied_ends():
    page = b"<html><head><title>T</title></head><body><h2>B</h2><h1>A</h1><p>one<p>two &amp; x<ul><li>i<li>j <p>in</p></ul><pre><code>c</code></pre><script>no</script></body>"
    assert texts(html.parse_html(page)) == [("title", "T"), ("title", "A"), ("title", "B"), ("narrative_text", "one"), ("narrative_text", "two & x"), ("narrative_text", "in"), ("list_item", "i"), ("list_item", "j in"), ("code_block", "c"), ("code_block", "c")]
    assert [t for _, t in texts(html.parse_html(page, document_order=True))][:3] == ["T", "B", "A"]
    assert texts(html.parse_html(b"<body>only <b>this</b></body>")) == [("narrative_text", "only this")]


def test_html_table():
    (t,) = html.parse_html(b"<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2<tr><td>3</table>")
    assert (t.headers, t.rows, t.text) == (["a", "b"], [["1", "2"], ["3"]], "Table: 2 columns, 2 rows")


def test_rtf():
    assert texts(plain.parse_rtf(b"{\\rtf1{\\fonttbl x;}{\\*\\gen y}Caf\\'e9\\par a\\par\\par b}")) == [("narrative_text", "Café a"), ("narrative_text", "b")]
    with pytest.raises(DocError):
        plain.parse_rtf(b"no")


def test_mail():
    raw = b"Subject: Hi\r\nFrom: Ann <a@x.org>\r\nTo: b@x.org, c@x.org\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\nContent-Type: text/html\r\n\r\n<p>Hello <b>you</b></p>"
    assert [t for _, t in texts(plain.parse_email(raw))] == ["Hi", "From: Ann <a@x.org>", "To: b@x.org, c@x.org", "Date: Mon, 01 Jan 2024 10:00:00 +0000", "Hello you"]


def test_docx():
    w = 'xmlns:w="w"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:t xml:space="preserve"> b</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    got = office.parse_docx(zipped({"word/document.xml": body}))
    assert texts(got) == [("title", "Head"), ("narrative_text", "a b"), ("table", "Table: 1 columns, 1 rows")]
    assert got[0].hierarchy == ["h2"] and (got[2].headers, got[2].rows) == (["h"], [["v"]])
    with pytest.raises(DocError):
        office.parse_docx(b"PK\x03\x04broken")


def test_slides_in_order_of_number():
    slide = lambda *t: '<p:sld xmlns:p="p" xmlns:a="a">' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r><a:r><a:t>+</a:t></a:r></a:p>" for x in t) + "</p:sld>"
    got = office.parse_pptx(zipped({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two", "body")}))
    assert [(b.element_type, b.text, b.page) for b in got] == [("title", "two +", 1), ("narrative_text", "body +", 1), ("title", "ten +", 2)]


def test_spreadsheet():
    files = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="x1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>n</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>3.0</v></c><c r="B2"><v>1.5</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
    title, t = office.parse_sheets(zipped(files))
    assert title.text == "S" and (t.headers, t.rows) == (["n", "ab"], [["3", "1.5"], ["", "true"]])
    assert t.text == 'Sheet "S": 2 columns (n, ab) and 2 data rows'


def compound(streams):
    """A compound file of small streams, all in the mini stream."""
    free, end, none = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFF
    mini, minifat, entries = b"", [], []
    for name, data in streams.items():
        first, n = len(minifat), -(-len(data) // 64)
        minifat += [*range(first + 1, first + n), end]
        mini += data.ljust(n * 64, b"\0")
        entries.append((name, 2, first, len(data)))
    entry = lambda name, kind, first, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, none, none, none) + b"\0" * 36 + struct.pack("<IQ", first, size)
    minis, dirs = -(-len(mini) // 512), -(-(len(entries) + 1) // 4)
    directory = b"".join([entry("Root Entry", 5, 2 + dirs, len(mini)), *(entry(*e) for e in entries)]).ljust(dirs * 512, b"\0")
    fat = [0xFFFFFFFD, end, *[*range(3, 2 + dirs), end], *[*range(3 + dirs, 2 + dirs + minis), end]]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", 1, 2, 0, 4096, 1, 1, end, 0)
    head += struct.pack("<109I", *[0, *[free] * 108])
    return head + struct.pack("<128I", *(fat + [free] * (128 - len(fat)))) + struct.pack("<128I", *(minifat + [free] * (128 - len(minifat)))) + directory + mini.ljust(minis * 512, b"\0")


def test_stored_mail():
    wide = lambda s: s.encode("utf-16-le")
    got = office.parse_msg(compound({"__substg1.0_0037001F": wide("Subject\0"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_0E04001E": b"Bob\xe9", "__substg1.0_1000001F": wide(" body " * 30)}))
    assert texts(got) == [("title", "Subject"), ("email_header", "From: Ann"), ("email_header", "To: Bobé"), ("email_body", ("body  " * 30).strip())]


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 3, 2)
    (b,) = office.parse_image(png, "png")
    assert b.text.startswith(f"Image (png): 3x2, {len(png)} bytes") and b.confidence == 0.0
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx\xff\xc0" + struct.pack(">HBHH", 11, 8, 7, 9) + b"\0" * 4
    assert office.image_dimensions(jpeg, "jpg") == (9, 7)
    assert office.image_dimensions(b"GIF89a" + struct.pack("<HH", 4, 5), "gif") == (4, 5)


def sample_pdf(content):
    z = zlib.compress(content)
    return b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n3 0 obj <</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>> endobj\n4 0 obj <</Length " + str(len(z)).encode() + b"/Filter/FlateDecode>> stream\n" + z + b"\nendstream endobj\n5 0 obj <</Type/Font/BaseFont/Helvetica>> endobj\n"


def test_pdf():
    got = pdf.parse_pdf(sample_pdf(b"BT /F1 24 Tf 50 700 Td (Heading) Tj /F1 12 Tf 0 -40 Td (Body text that goes) Tj 0 -14 Td [(on) -300 (here)] TJ 0 -60 Td (12) Tj ET"))
    assert texts(got) == [("title", "Heading"), ("narrative_text", "Body text that goes on here"), ("footer", "12")]
    with pytest.raises(DocError):
        pdf.parse_pdf(b"%PDF-1.4 trailer <</Encrypt 9 0 R>>")


def test_pdf_table_region():
    row = lambda y, *xs: [pdf.Char(c, x, y, y + 10, 8, 10) for x, c in xs]
    chars = [c for y in (300, 280, 260) for c in row(y, (10, "a"), (100, "b"), (200, "c"))]
    (t,) = pdf.layout(chars, 2)
    assert t.element_type == "table" and t.rows == [["a", "b", "c"]] * 3 and t.page == 2


@pytest.mark.parametrize("text,kind", [("3.14 is", "list_item"), ("12", "footer"), ("Page 3", "footer"), ("A HEADING", "title"), ("Short words", "title"), ("A sentence that ends.", "narrative_text"), ("• x", "list_item")])
def test_classify(text, kind):
    assert pdf.classify(text) == kind


def test_errors_are_rows(spark):
    docs = spark.createDataFrame([(1, bytearray(b"x"), "epub", "epub"), (2, bytearray(b"no zip"), "docx", "docx"), (3, bytearray(b"fine"), "text", "txt"), (4, None, "text", "txt")], "id int, content binary, format_key string, ext string")
    got = {r.id: r for r in reader.parse_documents(docs).collect()}
    assert [got[i].error_code for i in (1, 2, 3, 4)] == ["E1001", "E3001", None, None] and got[3].blocks[0].text == "fine" and got[4].blocks[0].text == ""


def pdf_of(objects, root=1):
    return b"%PDF-1.4\n" + b"".join(str(n).encode() + b" 0 obj " + body + b" endobj\n" for n, body in objects.items()) + b"trailer <</Root " + str(root).encode() + b" 0 R>>"


def stream(data, extra=b""):
    return b"<</Length " + str(len(data)).encode() + extra + b">> stream\n" + data + b"\nendstream"


def test_pdf_forms_ranges_and_weights():
    cmap = b"1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfrange <0004> <0005> [<0058> <D83DDE00>] endbfrange 1 beginbfchar <0006> <00660069> endbfchar"
    pad = b"".join(b"/X%d 8 0 R" % i for i in range(600))
    got = pdf.Pdf(pdf_of({
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        3: b"<</Type/Page/Parent 2 0 R/Contents [4 0 R]/Resources<</XObject<</Fm1 5 0 R>>/Font<<" + pad + b"/F1 6 0 R>>>>>>",
        4: stream(b"q 1 0 0 1 100 50 cm BT /F1 10 Tf 5 5 Td <000100020003000400050006> Tj ET /Fm1 Do Q"),
        5: stream(b"BT /G 20 Tf 1 2 Td (in form) Tj ET", b"/Subtype/Form/Matrix[1 0 0 1 7 0]/Resources<</Font<</G 8 0 R>>>>"),
        6: b"<</Type/Font/Subtype/Type0/BaseFont/Any/Encoding/Identity-H/DescendantFonts[9 0 R]/ToUnicode 7 0 R>>", 7: stream(cmap),
        8: b"<</Type/Font/BaseFont/Plain/FontDescriptor 10 0 R>>", 9: b"<</Type/Font/W[1 [300 400] 3 5 600]/FontDescriptor 11 0 R>>", 10: b"<</FontWeight 700>>", 11: b"<</Flags 4>>",
    }))
    (page,) = got.pages()
    chars = got.chars(page)
    assert "".join(c.ch for c in chars) == "ABCX😀fiin form"
    assert (chars[0].x, chars[0].y, chars[0].width, chars[0].bold) == (105, 55, 3.0, False) and chars[1].x == 108 and chars[3].width == 6
    assert (chars[6].ch, chars[6].x, chars[6].y, chars[6].bold) == ("i", 108, 52, True)


def test_damaged_pdf_is_an_error_and_not_an_empty_one():
    body = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Contents 4 0 R>>", 4: stream(b"no deflated bytes", b"/Filter/FlateDecode")}
    with pytest.raises(DocError):
        pdf.parse_pdf(pdf_of(body))
    with pytest.raises(DocError):
        pdf.rasterize(b"%PDF", 1)


def test_pdf_without_layout(monkeypatch):
    monkeypatch.setattr(pdf, "layout", lambda *_: [][0])
    got = pdf.parse_pdf(sample_pdf(b"BT /F1 12 Tf 50 700 Td (First part) Tj 0 -14 Td (goes on.) Tj 0 -60 Td (12) Tj ET"))
    assert [(b.text, b.page, b.confidence) for b in got] == [("First part\ngoes on.", 1, 0.7), ("12", 1, 0.7)]


def test_rows_of_differences():
    rows = [bytes([10, 20, 30, 40]), bytes([11, 19, 33, 47])]
    up = bytes([2]) + rows[0] + bytes([2]) + bytes((a - b) % 256 for a, b in zip(rows[1], rows[0], strict=True))
    assert pdf.unpredicted(up, 4, 1) == b"".join(rows)


def test_bytes_that_are_no_utf8():
    text, utf8 = plain.decode(b"caf\xe9 \x80 \x81\x9d \x93q\x94")
    assert not utf8 and text == "café € \x81\x9d “q”"
    assert plain.decode(b"\xff" * 5_000_000)[0] == "ÿ" * 5_000_000


def test_files_are_scanned_once(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a", "w") as z:
        z.writestr("ppt/presentation.xml", "<x/>")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c").write_bytes(b"????")
    got = reader.detect(reader.read_files(spark, str(tmp_path)))
    assert sorted((r.path[-1], r.format_key) for r in got.collect()) == [("a", "pptx"), ("t", "text")]
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1


def one_stream(name, data):
    """A compound file of one stream in ordinary sectors."""
    data = data.ljust(4096, b"\0")
    data += b"\0" * (-len(data) % 512)
    n = len(data) // 512
    entry = lambda x, kind, child, at, size: x.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(x) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", at, size)
    folder = (entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry(name, 2, 0xFFFFFFFF, 2, len(data))).ljust(512, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + folder + data


def test_old_spreadsheets():
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    begin = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    text = lambda x, wide=0: struct.pack("<HB", len(x), wide) + x.encode("utf-16-le" if wide else "latin-1")
    # the third string goes on in another record, from its second character on in wide ones
    strings = record(0xFC, struct.pack("<II", 4, 4) + text("name") + text("café") + struct.pack("<HB", 3, 0) + b"x") + record(0x3C, b"\x01" + "漢y".encode("utf-16-le") + struct.pack("<HBH", 2, 8, 1) + b"ab" + b"rich")
    styles = record(0x41E, struct.pack("<H", 164) + text("yyyy-mm-dd")) + record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + record(0xE0, struct.pack("<HH", 0, 164) + bytes(16))
    cell = lambda r, c, xf=0: struct.pack("<HHH", r, c, xf)
    formula = lambda r, c, value: record(0x06, cell(r, c) + value + bytes(8))
    sheet = begin + b"".join([
        *(record(0xFD, cell(0, c) + struct.pack("<I", c)) for c in range(4)), record(0x203, cell(1, 0) + struct.pack("<d", 1.5)), record(0x27E, cell(1, 1) + struct.pack("<I", (250 << 2 | 3))), record(0x27E, cell(1, 2) + struct.pack("<i", -7 << 2 | 2)),
        record(0x203, cell(1, 3, 1) + struct.pack("<d", 45000.5)), record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, 4 << 2 | 2, 0, 5 << 2 | 2) + struct.pack("<H", 1)), record(0x204, cell(2, 2) + text("old")), record(0x205, cell(2, 3) + b"\x01\x00"),
        formula(3, 0, struct.pack("<d", 2.0)), formula(3, 1, b"\x00\0\0\0\0\0\xff\xff"), record(0x207, text("Ω", 1)), formula(3, 2, b"\x01\0\x00\0\0\0\xff\xff"),
    ]) + record(0x0A, b"")
    bounds = lambda at: record(0x85, struct.pack("<IHBB", at, 0, 5, 0) + b"First") + record(0x85, struct.pack("<IHBB", at + len(sheet), 0, 1, 1) + "Ü".encode("utf-16-le"))
    fixed = begin + styles + strings
    at = len(fixed) + len(bounds(0)) + 4
    book = fixed + bounds(at) + record(0x0A, b"") + sheet + begin + record(0x0A, b"")
    got = office.parse_sheets(one_stream("Workbook", book))
    assert [(b.element_type, b.text, b.page) for b in got] == [("title", "First", 1), ("table", 'Sheet "First": 4 columns (name, café, x漢y, ab) and 3 data rows', 1), ("title", "Ü", 2)]
    assert got[1].rows == [["1.5", "2.5", "-7", "2023-03-15 12:00:00"], ["4", "5", "old", "true"], ["2", "Ω", "false", ""]]
    for bad in (one_stream("Other", book), one_stream("Workbook", b"\x09\x08\x04\x00\x00\x05\x05\x00"), one_stream("Workbook", begin + record(0x2F, b"\0\0"))):
        with pytest.raises(DocError):
            office.parse_sheets(bad)


def test_files_are_made_a_few_at_a_time(spark, monkeypatch):
    """Of an Arrow batch of 1000 documents only a few are Python strings while one of them is written."""
    from pyspark.sql import functions as F

    from chunkloom.sources.writers import WRITERS, written

    def alive(lines):
        import gc

        return str(sum(type(x) is list and len(x) == 2 and x[0] == "line of a document" for x in gc.get_objects()) if lines[1] == "500" else 0).encode()

    monkeypatch.setitem(WRITERS, "alive", (alive, "text", "txt"))
    docs = spark.range(0, 1000, 1, 1).select(F.array(F.lit("line of a document"), F.col("id").cast("string")).alias("lines"))
    got = [int(r.content) for r in docs.select(written(F.col("lines"), "alive").alias("content")).collect()]
    assert len(got) == 1000 and 0 < max(got) < 100
