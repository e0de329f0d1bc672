"""Parsers of text formats: plain text, Markdown, XML, delimited text, RTF, e-mail."""

from __future__ import annotations

import codecs
import csv
import email
import email.policy
import io
import re
from xml.parsers import expat

from ..model import E_INPUT, E_PARSE, Block, DocError

_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(s: str) -> str:
    """Without Unicode white space at both ends (unlike str.strip, the separators U+001C to U+001F stay)."""
    return s.strip(_WHITE)


def lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


#: Bytes that windows-1252 leaves open are control characters of the same number.
codecs.register_error("latin1_control", lambda e: ("".join(map(chr, e.object[e.start : e.end])), e.end))


def decode(content: bytes) -> tuple[str, bool]:
    """The text and whether it was UTF-8; other bytes are read as windows-1252."""
    try:
        return content.decode("utf-8-sig"), True
    except UnicodeDecodeError:
        return content.decode("cp1252", "latin1_control"), False


def paragraph_texts(text: str) -> list[str]:
    out: list[list[str]] = [[]]
    for x in map(strip, lines(text)):
        if x:
            out[-1].append(x)
        elif out[-1]:
            out.append([])
    return [" ".join(p) for p in out if p]


def parse_plain(text: str, confidence: float = 1.0) -> list[Block]:
    return [Block("narrative_text", p, confidence=confidence) for p in paragraph_texts(text)] or [Block("narrative_text", "", confidence=confidence)]


def parse_markdown(text: str) -> list[Block]:
    """Fences, headings, list items and paragraphs, line by line."""
    blocks: list[Block] = []
    para: list[str] = []
    code: str | None = None

    def flush() -> None:
        if para:
            blocks.append(Block("narrative_text", " ".join(para)))
            para.clear()

    for line in lines(text):
        if line.startswith("```"):
            if code is None:
                flush()
                code = ""
            else:
                blocks.append(Block("code_block", code))
                code = None
        elif code is not None:
            code = f"{code}\n{line}" if code else line
        elif line.startswith("#"):
            flush()
            level = len(line) - len(line.lstrip("#"))
            blocks.append(Block("title", strip(line[level:]), hierarchy=[f"h{level}"]))
        elif line[:2] in ("- ", "* ", "+ ") or re.match(r"[0-9]+[.)] ", line):
            flush()
            blocks.append(Block("list_item", strip(re.sub(r"^([-*+]|[0-9]+[.)]) ", "", line, count=1))))
        elif not strip(line):
            flush()
        else:
            para.append(strip(line))
    if code:
        blocks.append(Block("code_block", code))
    flush()
    return blocks


def parse_xml(content: bytes) -> list[Block]:
    """Text between tags, with the stack of open elements as its hierarchy."""
    blocks: list[Block] = []
    stack: list[str] = []
    held: list[str] = []

    def flush() -> None:
        got = " ".join(x for x in map(strip, held) if x)
        held.clear()
        if got:
            blocks.append(Block("narrative_text", got, hierarchy=list(stack)))

    def start(name: str, _: object) -> None:
        flush()
        stack.append(name.rpartition(":")[2])

    def end(_: str) -> None:
        flush()
        if stack:
            stack.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise DocError(E_PARSE, f"XML: {e}") from e
    return blocks or [Block("narrative_text", "")]


def find_delimiter(text: str) -> str:
    head = "\n".join(lines(text)[:5])
    counts = {d: head.count(d) for d in "\t;|,"}
    return max(counts, key=counts.__getitem__) if any(counts.values()) else ","


def parse_delimited(content: bytes) -> list[Block]:
    text = content.decode("utf-8", "replace").removeprefix("﻿")
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=find_delimiter(text)) if r]
    headers, body = (rows[0], rows[1:]) if rows else ([], [])
    return [Block("table", f"Table with {len(headers)} columns ({', '.join(headers)}) and {len(body)} rows" if rows else "Table with 0 rows", rows=body, headers=headers or None)]


_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "header", "footer", "pict", "object"}
_WORD = re.compile(r"\\([A-Za-z]+)(-?[0-9]+)? ?|\\'([0-9A-Fa-f]{2})|\\([^A-Za-z])|([{}])|([^\\{}]+)", re.S)


def rtf_text(source: str) -> str:
    """Text of an RTF document; groups of fonts, styles, pictures and those marked as ignorable are left out."""
    out: list[str] = []
    depth, skip = 0, None
    fresh = False
    for m in _WORD.finditer(source):
        word, _, code, sign, brace, plain = m.groups()
        if brace == "{":
            depth += 1
            fresh = True
            continue
        if brace == "}":
            if skip is not None and depth <= skip:
                skip = None
            depth -= 1
            fresh = False
            continue
        if skip is None and fresh and (word in _SKIPPED or sign == "*"):
            skip = depth
        if not (sign is not None and sign.isspace()):
            fresh = False
        if skip is not None:
            continue
        if word in ("par", "pard", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif code:
            out.append(chr(int(code, 16)))
        elif sign:
            out.append({"~": "\xa0", "\\": "\\", "{": "{", "}": "}"}.get(sign, ""))
        elif plain:
            out.append(plain.replace("\r", "").replace("\n", ""))
    return strip(re.sub(r"\n{3,}", "\n\n", "".join(out)))


def parse_rtf(content: bytes) -> list[Block]:
    text = content.decode("latin-1")
    if not text.startswith("{\\rtf"):
        raise DocError(E_PARSE, "not an RTF document")
    return parse_plain(rtf_text(text), 0.8)


def strip_tags(html: str) -> str:
    return strip(re.sub(f"[{_WHITE}]+", " ", re.sub(r"<[^>]*(>|\Z)|>", " ", html)))


def _addresses(header) -> str:
    """Addresses of a header: name <mail>, groups as name: members."""
    if header is None or not getattr(header, "groups", None):
        return str(header or "")
    one = lambda a: f"{a.display_name} <{a.addr_spec}>" if a.display_name and a.addr_spec else (a.addr_spec or a.display_name)
    plain = [one(g.addresses[0]) for g in header.groups if g.display_name is None and g.addresses]
    groups = [f"{g.display_name}: {', '.join(map(one, g.addresses))}" for g in header.groups if g.display_name is not None]
    return "; ".join(([", ".join(plain)] if plain else []) + groups)


def parse_email(content: bytes) -> list[Block]:
    if not re.match(rb"[\x21-\x39\x3b-\x7e]+:", content.lstrip()):
        raise DocError(E_PARSE, "not a mail message")
    mail = email.message_from_bytes(content, policy=email.policy.default)
    out: list[Block] = []
    if mail["subject"]:
        out.append(Block("title", str(mail["subject"]), confidence=0.9))
    for name in ("From", "To"):
        if mail[name]:
            out.append(Block("email_header", f"{name}: {_addresses(mail[name])}", confidence=0.9))
    if mail["date"]:
        out.append(Block("email_header", f"Date: {mail['date']}"))
    body = mail.get_body(preferencelist=("plain",))
    text = body.get_content() if body is not None else ""
    if not text and (html := mail.get_body(preferencelist=("html",))) is not None:
        text = strip_tags(html.get_content())
    if strip(text):
        out.append(Block("email_body", strip(text), confidence=0.9))
    files = list(mail.iter_attachments()) if mail.is_multipart() else []
    if files:
        names = ", ".join(f"{f.get_filename() or 'unnamed'} ({len(f.get_payload(decode=True) or b'')} bytes)" for f in files)
        out.append(Block("narrative_text", f"Attachments ({len(files)}): {names}", confidence=0.9))
    return out or [Block("narrative_text", "Empty email")]


def parse_text_format(content: bytes, ext: str, format_key: str) -> list[Block]:
    """Text, Markdown and XML by extension; bytes that aren't UTF-8 are plain text whatever the extension says. A file without text is one empty paragraph."""
    text, unicode = decode(content)
    if unicode and ext in ("md", "markdown"):
        return parse_markdown(text) or parse_plain("")
    if unicode and (format_key == "xml" or ext in ("xml", "xsd", "xsl", "svg", "rss", "atom")):
        return parse_xml(text.encode())
    return parse_plain(text)


def require_utf8(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise DocError(E_INPUT, f"not UTF-8: {e}") from e
