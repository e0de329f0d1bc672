"""Text functions: lines, trimming, token estimates, format detection, classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ELEMENTS

#: Unicode White_Space, in Java's regular expressions.
_SPACE = r"\p{IsWhite_Space}"
#: The same as characters.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

EXTENSIONS = {
    "text": "txt text log cfg ini conf md markdown rst", "csv_tsv": "csv tsv tab", "html": "html htm xhtml mhtml mht", "pdf": "pdf",
    "docx": "docx doc", "xlsx": "xlsx xlsb xls ods", "pptx": "pptx ppt", "email": "eml", "msg": "msg", "rtf": "rtf",
    "xml": "xml xsd xsl svg rss atom", "json": "json jsonl ndjson", "yaml": "yaml yml", "epub": "epub", "image": "png jpg jpeg tiff tif bmp gif webp heic",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what a lambda captures is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(_c(text), F.lit(_SPACES))


def lines(text: Column | str) -> Column:
    """Lines as an array; a carriage return before a line feed goes, and so does an empty last line."""
    t = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t), "\n", -1))


def line_count(text: Column | str) -> Column:
    return F.size(lines(text))


def fast_tokens(text: Column | str) -> Column:
    """Estimated tokens: bytes over five, rounded up. Decides all chunk boundaries."""
    return F.ceil(F.octet_length(_c(text)) / F.lit(5.0)).cast("bigint")


def paragraphs(text: Column | str) -> Column:
    """Paragraphs of plain text: lines are trimmed and joined with a blank, empty ones part them; one empty one for an empty text."""
    joined = F.array_join(F.transform(lines(text), trim), "\n")
    parts = F.filter(F.split(joined, r"\n\n+", -1), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "") != "")
    out = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\n+|\n+$", ""), "\n", " "))
    return F.when(F.size(out) == 0, F.array(F.lit(""))).otherwise(out)


def strip_html(html: Column | str) -> Column:
    """Text without tags: each tag is a blank, white space is collapsed; an unclosed tag swallows the rest."""
    bare = F.regexp_replace(_c(html), r"<[^>]*(>|\z)|>", " ")
    return trim(F.regexp_replace(bare, f"{_SPACE}+", " "))


def extension(path: Column | str) -> Column:
    """Small letters after the last dot of the file name; empty for names that begin with their only dot."""
    return F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1))


def format_by_extension(path: Column | str) -> Column:
    ext = extension(path)
    return reduce(lambda acc, kv: acc.when(ext.isin(*kv[1].split()), F.lit(kv[0])), list(EXTENSIONS.items())[1:], F.when(ext.isin(*EXTENSIONS["text"].split()), F.lit("text")))


def _hex(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def format_by_magic(content: Column | str) -> Column:
    """Format by the first bytes; zip for an archive whose members have yet to be looked at; null if nothing fits."""
    c = _c(content)
    h = _hex(c, 8)
    head = F.substring(c, 1, 8192)
    text = F.when(F.is_valid_utf8(head.cast("string")), F.lower(head.cast("string")))
    return (
        F.when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304") | h.startswith("504B0506"), "zip").when(h == "D0CF11E0A1B11AE1", "msg").when(h.startswith("7B5C727466"), "rtf")
        .when(h.startswith("89504E47") | h.startswith("FFD8FF") | h.startswith("47494638"), "image").when(h.startswith("424D") & (F.length(c) > 14), "image").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image")
        .when(text.contains("<!doctype html") | text.contains("<html"), "html").when(text.startswith("<?xml"), "xml").when(F.regexp_replace(text, f"^{_SPACE}+", "").rlike(r"^[\[{]"), "json")
    )


def delimiter(text: Column | str) -> Column:
    """The one of tab, semicolon, bar and comma that the first five lines have most of; of equals the one first in this order."""
    head = F.array_join(F.slice(lines(text), 1, 5), "\n")
    n = {d: F.length(head) - F.length(F.replace(head, F.lit(d))) for d in "\t;|,"}
    most = F.greatest(*n.values())
    return F.when(most == 0, ",").when(n["\t"] == most, "\t").when(n[";"] == most, ";").when(n["|"] == most, "|").otherwise(",")


def _letters(text: Column) -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")), F.regexp_count(text, F.lit(r"\p{IsUppercase}"))


def is_list_item(text: Column | str) -> Column:
    return _c(text).rlike(r"^([-*•·◦‣] |[0-9]{1,3}[.)])")


def is_footer(text: Column | str) -> Column:
    """One line that is a number of 32 bits or begins with the word page."""
    t = _c(text)
    number = t.rlike(r"^\+?[0-9]+\z") & (F.coalesce(F.try_to_number(F.regexp_extract(t, r"^\+?0*([0-9]{1,11})\z", 1), F.lit("99999999999")), F.when(t.rlike(r"^\+?0+\z"), F.lit(0)).otherwise(F.lit(99999999999))) <= 4294967295)
    return (line_count(t) == 1) & (number | F.lower(t).startswith("page "))


def is_heading(text: Column | str, size_ratio: Column, bold: Column) -> Column:
    t = _c(text)
    size, n, dot = F.octet_length(t), line_count(t), t.endswith(".")
    alpha, upper = _letters(t)
    caps = (n == 1) & (size < 80) & ~dot & (alpha > 0) & (upper / alpha > 0.7)
    return (n <= 2) & (size <= 200) & ((size_ratio >= 1.2) | (bold & (size < 120) & ~dot) | F.coalesce(caps, F.lit(False)))


def classify(text: Column | str) -> Column:
    """Element type of a paragraph without layout."""
    t = _c(text)
    alpha, upper = _letters(t)
    title = (line_count(t) == 1) & (F.octet_length(t) < 120) & ~t.endswith(".") & (alpha > 0) & ((upper / alpha > 0.6) | (F.octet_length(t) < 60))
    return F.when(is_footer(t), "footer").when(is_list_item(t), "list_item").when(F.coalesce(title, F.lit(False)), "title").otherwise("narrative_text")


def element_name(kind: Column | str, compat: bool = False) -> Column:
    """Name of an element type in columnar output, or in the element-compatibility schema."""
    c = _c(kind)
    return reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1][compat])), list(ELEMENTS.items())[1:], F.when(c == "title", F.lit("Title")))


def needs_vision(blocks: Column | str) -> Column:
    """No blocks, none with a confidence of 0.3, or less than 50 bytes of text."""
    b = _c(blocks)
    return (F.size(b) == 0) | F.forall(b, lambda x: x["confidence"] < 0.3) | (F.aggregate(b, F.lit(0), lambda a, x: a + F.octet_length(x["text"])) < 50)


def image_size(content: Column | str, ext: Column | str) -> Column:
    """WIDTHxHEIGHT of png, gif and bmp images; null if unknown."""
    c, e = _c(content), _c(ext)
    number = lambda at, n, little: F.conv(reduce(F.concat, [F.hex(F.substring(c, at + i, 1)) for i in (range(n - 1, -1, -1) if little else range(n))]), 16, 10).cast("bigint")
    signed = lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x)
    size = lambda w, h: F.concat_ws("x", w.cast("string"), h.cast("string"))
    return (
        F.when((e == "png") & (F.length(c) >= 24) & _hex(c, 4).startswith("89504E47"), size(number(17, 4, False), number(21, 4, False)))
        .when((e == "gif") & (F.length(c) >= 10) & _hex(c, 4).startswith("47494638"), size(number(7, 2, True), number(9, 2, True)))
        .when((e == "bmp") & (F.length(c) >= 26) & _hex(c, 2).startswith("424D"), size(signed(number(19, 4, True)), F.abs(signed(number(23, 4, True)))))
    )
