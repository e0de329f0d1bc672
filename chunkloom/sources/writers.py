"""Files of the formats that are read, made of lines of text: for queries, tests and benchmarks over tables of any size."""

from __future__ import annotations

import csv
import html
import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines on a slide.
SLIDE = 10
#: Files that are made at once.
FILES = 64


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def docx(lines: list[str]) -> bytes:
    """The first line is a heading."""
    para = lambda i, x: f"<w:p>{'<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if not i else ''}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    body = "".join(para(i, x) for i, x in enumerate(lines))
    return _zip({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


def pptx(lines: list[str]) -> bytes:
    """SLIDE lines to a slide."""
    slides = [lines[k : k + SLIDE] for k in range(0, len(lines), SLIDE)]
    one = lambda s: f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a">{"".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in s)}</p:sld>'
    return _zip({"ppt/presentation.xml": "<x/>"} | {f"ppt/slides/slide{k}.xml": one(s) for k, s in reversed(list(enumerate(slides, 1)))})


def xlsx(lines: list[str]) -> bytes:
    """A sheet with a row of names and one for each line: its number and text."""
    cell = lambda x: f"<c><v>{x}</v></c>" if isinstance(x, int) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'
    rows = "".join(f"<row>{cell(a)}{cell(b)}</row>" for a, b in [("line", "text"), *enumerate(lines, 1)])
    return _zip({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="Lines" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })


def ods(lines: list[str]) -> bytes:
    """As xlsx."""
    cell = lambda x: f'<c:table-cell o:value-type="float" o:value="{x}"/>' if isinstance(x, int) else f'<c:table-cell o:value-type="string"><t:p>{escape(x)}</t:p></c:table-cell>'
    rows = "".join(f"<c:table-row>{cell(a)}{cell(b)}</c:table-row>" for a, b in [("line", "text"), *enumerate(lines, 1)])
    return _zip({"content.xml": f'<o:doc xmlns:o="urn:o" xmlns:c="urn:c" xmlns:t="urn:t"><c:table c:name="Lines">{rows}</c:table></o:doc>'})


def eml(lines: list[str]) -> bytes:
    """The first line is the subject, the others are the body."""
    mail = EmailMessage()
    mail["Subject"], mail["From"], mail["To"] = (" ".join(lines[:1]).encode("ascii", "replace").decode()[:60].strip() or "none"), "Ann <ann@example.org>", "bob@example.org"
    mail.set_content("\n".join(lines[1:]), cte="base64")
    return mail.as_bytes()


def rtf(lines: list[str]) -> bytes:
    """A paragraph to a line; characters beyond Latin-1 are question marks."""
    one = lambda c: f"\\{c}" if c in "\\{}" else c if c < "\x80" else f"\\'{ord(c):02x}"
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}" + "\\par\\par ".join("".join(map(one, x.encode("latin-1", "replace").decode("latin-1"))) for x in lines) + "}").encode("latin-1")


def xml(lines: list[str]) -> bytes:
    return ("<doc>" + "".join(f"<line>{escape(x)}</line>" for x in lines) + "</doc>").encode()


def delimited(lines: list[str]) -> bytes:
    """A row of names and one for each line: its number and text. Other delimiters in the text are blanks."""
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([("line", "text"), *((i, x.translate(str.maketrans(",;|\t", "    "))) for i, x in enumerate(lines, 1))])
    return out.getvalue().encode()


def md(lines: list[str]) -> bytes:
    """A heading, then a list."""
    return "\n".join([f"# {x}" if not i else f"- {x}" for i, x in enumerate(lines)]).encode()


def page(lines: list[str]) -> bytes:
    """A heading of the second level, a paragraph for each line, the same lines in a table, the first as code."""
    x = [html.escape(x, quote=False) for x in lines]
    return f"<html><body><h2>{''.join(x[:1])}</h2>{''.join(f'<p>{t}</p>' for t in x)}<table><tr><th>line</th><th>text</th></tr>{''.join(f'<tr><td>{i}</td><td>{t}</td></tr>' for i, t in enumerate(x, 1))}</table><pre>{''.join(x[:1])}</pre></body></html>".encode()


def windows_1252(lines: list[str]) -> bytes:
    """Plain text, a paragraph to a line, in bytes that are no UTF-8 unless they are ASCII."""
    return "\n\n".join(lines).encode("cp1252", "replace")


def png(lines: list[str]) -> bytes:
    """The beginning of an image as wide as the longest line and as high as there are lines."""
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", max(map(len, lines), default=0), len(lines), 8, 2, 0, 0, 0)


WRITERS: dict[str, tuple[Callable[[list[str]], bytes], str, str]] = {
    "docx": (docx, "docx", "docx"), "pptx": (pptx, "pptx", "pptx"), "xlsx": (xlsx, "xlsx", "xlsx"), "ods": (ods, "xlsx", "ods"), "eml": (eml, "email", "eml"), "rtf": (rtf, "rtf", "rtf"), "xml": (xml, "xml", "xml"),
    "csv": (delimited, "csv_tsv", "csv"), "md": (md, "text", "md"), "html": (page, "html", "html"), "cp1252": (windows_1252, "text", "txt"), "png": (png, "image", "png"),
}


def written(lines: Column, kind: str) -> Column:
    """The bytes of a file of the kind with the lines of an array column. Lines become Python strings, and files leave, FILES at a time: an Arrow batch may be a whole split."""
    make = WRITERS[kind][0]

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for k in range(0, len(b), FILES):
                yield pa.array([None if x is None else make(x) for x in b.slice(k, FILES).to_pylist()], pa.binary())
            del b

    return run(lines)
