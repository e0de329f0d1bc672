"""Parsers of office containers: word processing, slides, spreadsheets, stored mail; image headers. Standard library only."""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import zipfile
from collections.abc import Callable
from xml.parsers import expat

from ..model import E_PARSE, Block, DocError
from .plain import strip


def members(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise DocError(E_PARSE, f"ZIP: {e}") from e


def zip_format(content: bytes) -> str:
    """Kind of an office archive, by the names of its first 20 members."""
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()[:20]
    except zipfile.BadZipFile:
        return "docx"
    for name in names:
        for start, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if name.startswith(start):
                return kind
    return "docx"


def walk(xml: bytes, start: Callable[[str, dict], None], end: Callable[[str], None], text: Callable[[str], None]) -> None:
    """Events with local names."""
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda n, a: start(n.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in a.items()})
    p.EndElementHandler = lambda n: end(n.rpartition(":")[2])
    p.CharacterDataHandler = text
    try:
        p.Parse(xml, True)
    except expat.ExpatError as e:
        raise DocError(E_PARSE, f"XML: {e}") from e


def parse_docx(content: bytes) -> list[Block]:
    with members(content) as z:
        try:
            xml = z.read("word/document.xml")
        except KeyError as e:
            raise DocError(E_PARSE, "no word/document.xml") from e
    out: list[Block] = []
    s = {"text": "", "style": None, "t": False, "cell": None, "row": [], "rows": []}

    def start(name, attrs):
        if name == "p":
            s["text"], s["style"] = "", None
        elif name == "t":
            s["t"] = True
        elif name == "pStyle":
            s["style"] = attrs.get("val")
        elif name == "tbl":
            s["rows"] = []
        elif name == "tr":
            s["row"] = []
        elif name == "tc":
            s["cell"] = ""

    def text(x):
        if s["t"]:
            key = "text" if s["cell"] is None else "cell"
            s[key] += x

    def end(name):
        if name == "t":
            s["t"] = False
        elif name == "p" and s["cell"] is None:
            got, style = strip(s["text"]), s["style"] or ""
            if got:
                heading = "Heading" in style or "heading" in style
                kind = "title" if heading or "Title" in style else "list_item" if "List" in style else "narrative_text"
                level = "".join(re.findall("[0-9]", style)) if heading else ""
                out.append(Block(kind, got, confidence=0.9, hierarchy=[f"h{level}"] if level else []))
            s["text"] = ""
        elif name == "tc":
            s["row"].append(strip(s["cell"] or ""))
            s["cell"] = None
        elif name == "tr" and s["row"]:
            s["rows"].append(s["row"])
            s["row"] = []
        elif name == "tbl" and s["rows"]:
            headers, *rows = s["rows"]
            out.append(Block("table", f"Table: {len(headers)} columns, {len(rows)} rows", confidence=0.9, rows=rows, headers=headers))
            s["rows"] = []

    walk(xml, start, end, text)
    return out


def parse_pptx(content: bytes) -> list[Block]:
    """A block per paragraph; slides in the order of their numbers."""
    out: list[Block] = []
    with members(content) as z:
        slides = [n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml") and "layout" not in n.lower()]
        slides.sort(key=lambda n: int((re.search(r"slide(\d+)\.xml$", n) or [0, 0])[1]))
        for page, name in enumerate(slides, 1):
            paras: list[list[str]] = []
            state = {"t": False}

            def start(tag, _, paras=paras, state=state):
                if tag == "p":
                    paras.append([])
                state["t"] = tag == "t"
                if tag == "t" and paras:
                    paras[-1].append("")

            def text(x, paras=paras, state=state):
                if state["t"] and paras and paras[-1]:
                    paras[-1][-1] += x

            def end(tag, state=state):
                if tag == "t":
                    state["t"] = False

            walk(z.read(name), start, end, text)
            texts = [t for t in (strip(" ".join(x for x in p if x)) for p in paras) if t]
            out += [Block("narrative_text" if i else "title", t, page=page, confidence=0.85) for i, t in enumerate(texts)]
    return out or [Block("narrative_text", "Empty presentation")]


def _number(x: str) -> str:
    f = float(x)
    return str(int(f)) if f == int(f) and abs(f) < 2**63 else repr(f)


_DATE_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _xlsx_sheets(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    shared: list[str] = []
    names = set(z.namelist())
    if "xl/sharedStrings.xml" in names:
        st = {"t": False, "ph": False}

        def start(n, _):
            if n == "si":
                shared.append("")
            st["ph"] = st["ph"] or n == "rPh"
            st["t"] = n == "t"

        def end(n):
            st["t"] = False
            if n == "rPh":
                st["ph"] = False

        walk(z.read("xl/sharedStrings.xml"), start, end, lambda x: shared.__setitem__(-1, shared[-1] + x) if st["t"] and not st["ph"] else None)
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        custom, inside = {}, {"x": False}

        def start_style(n, a):
            if n == "numFmt":
                custom[int(a["numFmtId"])] = bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", a.get("formatCode", "")), re.I))
            elif n == "cellXfs":
                inside["x"] = True
            elif n == "xf" and inside["x"]:
                k = int(a.get("numFmtId", 0))
                dates.append(k in _DATE_IDS or custom.get(k, False))

        walk(z.read("xl/styles.xml"), start_style, lambda n: inside.update(x=False) if n == "cellXfs" else None, lambda _: None)
    targets: dict[str, str] = {}
    if "xl/_rels/workbook.xml.rels" in names:
        walk(z.read("xl/_rels/workbook.xml.rels"), lambda n, a: targets.__setitem__(a["Id"], a["Target"]) if n == "Relationship" else None, lambda _: None, lambda _: None)
    sheets: list[tuple[str, str]] = []
    walk(z.read("xl/workbook.xml"), lambda n, a: sheets.append((a.get("name", ""), a.get("id", ""))) if n == "sheet" else None, lambda _: None, lambda _: None)
    out = []
    for i, (title, rid) in enumerate(sheets, 1):
        target = targets.get(rid, f"worksheets/sheet{i}.xml")
        cells: dict[tuple[int, int], str] = {}
        at = {"r": 0, "c": 0, "type": "n", "style": 0, "v": None}

        def start(n, a, at=at):
            if n == "row":
                at["r"] = int(a["r"]) if "r" in a else at["r"] + 1
                at["c"] = 0
            elif n == "c":
                m = re.match("([A-Z]+)([0-9]+)", a.get("r", ""))
                if m:
                    k = 0
                    for ch in m[1]:
                        k = k * 26 + ord(ch) - 64
                    at["c"], at["r"] = k, int(m[2])
                else:
                    at["c"] += 1
                at.update(type=a.get("t", "n"), style=int(a.get("s", 0)), value="")
            elif n in ("v", "t"):
                at["v"] = ""

        def text(x, at=at):
            if at["v"] is not None:
                at["v"] += x

        def end(n, at=at, cells=cells):
            if n in ("v", "t") and at["v"] is not None:
                at["value"] = at.get("value", "") + at["v"]
                at["v"] = None
            elif n == "c" and at.get("value"):
                cells[at["r"], at["c"]] = _cell(at["type"], at["value"], at["style"] < len(dates) and dates[at["style"]], shared)

        walk(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), start, end, text)
        rows: list[list[str]] = []
        if cells:
            r0, r1, c0, c1 = min(r for r, _ in cells), max(r for r, _ in cells), min(c for _, c in cells), max(c for _, c in cells)
            rows = [[cells.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]
        out.append((title, rows))
    return out


def _cell(kind: str, value: str, is_date: bool, shared: list[str]) -> str:
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "e":
        return f"#ERR:{value.strip('#!?/').title().replace('/', '')}"
    if kind in ("str", "inlineStr", "d"):
        return value
    if is_date:
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(value) * 86400)))
    return _number(value)


def _ods_sheets(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    out: list[tuple[str, list[list[str]]]] = []
    s = {"row": [], "cell": None, "repeat": 1, "value": None, "rows": 1}

    def start(n, a):
        if n == "table":
            out.append((a.get("name", ""), []))
        elif n == "table-row":
            s["row"], s["rows"] = [], int(a.get("number-rows-repeated", 1))
        elif n in ("table-cell", "covered-table-cell"):
            s["repeat"], kind = int(a.get("number-columns-repeated", 1)), a.get("value-type")
            s["cell"] = []
            s["value"] = _number(a["value"]) if kind in ("float", "percentage", "currency") and "value" in a else a.get("boolean-value") or a.get("date-value") or a.get("time-value")
        elif n == "p" and s["cell"] is not None:
            s["cell"].append("")

    def text(x):
        if s["cell"]:
            s["cell"][-1] += x

    def end(n):
        if n in ("table-cell", "covered-table-cell"):
            value = s["value"] if s["value"] is not None else "\n".join(s["cell"] or [])
            s["row"] += [value] * (s["repeat"] if value or s["repeat"] < 1000 else 1)
            s["cell"] = None
        elif n == "table-row":
            row = s["row"]
            while row and not row[-1]:
                row.pop()
            out[-1][1].extend([list(row) for _ in range(s["rows"] if row else 1)])

    walk(z.read("content.xml"), start, end, text)
    done = []
    for name, rows in out:
        while rows and not rows[-1]:
            rows.pop()
        wide = max(map(len, rows), default=0)
        done.append((name, [r + [""] * (wide - len(r)) for r in rows]))
    return done


def _xls_sheets(book: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of the workbook stream of an old spreadsheet (BIFF8): its records, those that go on in others joined."""
    records: list[tuple[int, int, list[bytes]]] = []
    at = 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + size]
        if kind == 0x3C and records:
            records[-1][2].append(body)
        else:
            records.append((at, kind, [body]))
        at += 4 + size
    if not records or records[0][1] != 0x809 or struct.unpack_from("<H", records[0][2][0])[0] != 0x600:
        raise DocError(E_PARSE, "spreadsheet: not of version 8")
    if any(k == 0x2F for _, k, _ in records):
        raise DocError(E_PARSE, "spreadsheet is encrypted")
    names: list[tuple[int, str]] = []
    shared: list[str] = []
    custom: dict[int, bool] = {}
    dates: list[bool] = []
    epoch = dt.datetime(1899, 12, 30)
    cells: dict[int, dict[tuple[int, int], str]] = {}
    start, waiting = 0, None

    def shown(x: float, xf: int) -> str:
        return str(epoch + dt.timedelta(seconds=round(x * 86400))) if xf < len(dates) and dates[xf] else _number(repr(x))

    def rk(x: int) -> float:
        v = float(x >> 2 if x < 1 << 31 else (x >> 2) - (1 << 30)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
        return v / 100 if x & 1 else v

    for at, kind, parts in records:
        body = parts[0]
        if kind == 0x809:
            start = at
            cells[at] = {}
        elif kind == 0x85:
            n, wide = body[6], body[7] & 1
            names.append((struct.unpack_from("<I", body)[0], body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")))
        elif kind == 0x22 and struct.unpack_from("<H", body)[0]:
            epoch = dt.datetime(1904, 1, 1)
        elif kind == 0x41E:
            n, wide = struct.unpack_from("<H", body, 2)[0], body[4] & 1
            code = body[5 : 5 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")
            custom[struct.unpack_from("<H", body)[0]] = bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I))
        elif kind == 0xE0:
            k = struct.unpack_from("<H", body, 2)[0]
            dates.append(custom.get(k, k in _DATE_IDS))
        elif kind == 0xFC:
            shared = _xls_strings(parts)
        elif kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06, 0xBD):
            row, col, xf = struct.unpack_from("<HHH", body)
            own = cells[start]
            if kind == 0xFD:
                own[row, col] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == 0x203:
                own[row, col] = shown(struct.unpack_from("<d", body, 6)[0], xf)
            elif kind == 0x27E:
                own[row, col] = shown(rk(struct.unpack_from("<I", body, 6)[0]), xf)
            elif kind == 0x204:
                n, wide = struct.unpack_from("<H", body, 6)[0], body[8] & 1
                own[row, col] = body[9 : 9 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")
            elif kind == 0x205:
                own[row, col] = f"#ERR:{body[6]}" if body[7] else ("true" if body[6] else "false")
            elif kind == 0xBD:
                for i in range((len(body) - 6) // 6):
                    f, x = struct.unpack_from("<HI", body, 4 + 6 * i)
                    own[row, col + i] = shown(rk(x), f)
            elif body[12:14] != b"\xff\xff":
                own[row, col] = shown(struct.unpack_from("<d", body, 6)[0], xf)
            elif body[6] == 0:
                waiting = (row, col)  # the text of a formula is in the next record
            elif body[6] == 1:
                own[row, col] = "true" if body[8] else "false"
            elif body[6] == 2:
                own[row, col] = f"#ERR:{body[8]}"
        elif kind == 0x207 and waiting:
            n, wide = struct.unpack_from("<H", body)[0], body[2] & 1
            cells[start][waiting] = body[3 : 3 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")
            waiting = None
    out = []
    for place, name in names:
        own = cells.get(place, {})
        rows: list[list[str]] = []
        if own:
            (r0, r1), (c0, c1) = ((min(x), max(x)) for x in zip(*own, strict=True))
            rows = [[own.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]
        out.append((name, rows))
    return out


def _xls_strings(parts: list[bytes]) -> list[str]:
    """The shared strings. One that goes on in the next record says there anew how wide its characters are."""
    total = struct.unpack_from("<I", parts[0], 4)[0]
    part, at, out = 0, 8, []

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            more = parts[part][at : at + n]
            got, n, at = got + more, n - len(more), at + len(more)
        return got

    for _ in range(total):
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        wide, text = flags & 1, ""
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                wide = parts[part][0] & 1
            some = min(n, (len(parts[part]) - at) // (1 + wide))
            text += parts[part][at : at + some * (1 + wide)].decode("utf-16-le" if wide else "latin-1")
            at, n = at + some * (1 + wide), n - some
        take(4 * runs + extra)
        out.append(text)
    return out


def parse_sheets(content: bytes) -> list[Block]:
    try:
        if content[:8] == MAGIC:
            file = Compound(content)
            book = file.stream("Workbook") or file.stream("Book")
            if book is None:
                raise DocError(E_PARSE, "spreadsheet: no workbook")
            sheets = _xls_sheets(book)
        else:
            with members(content) as z:
                if "xl/workbook.bin" in z.namelist():
                    raise DocError(E_PARSE, "spreadsheet: binary parts can't be read")
                sheets = _xlsx_sheets(z) if "xl/workbook.xml" in z.namelist() else _ods_sheets(z)
    except (KeyError, ValueError, IndexError, struct.error) as e:
        raise DocError(E_PARSE, f"spreadsheet: {e}") from e
    out: list[Block] = []
    for page, (name, rows) in enumerate(sheets, 1):
        out.append(Block("title", name, page=page, confidence=0.95))
        if rows:
            headers, *body = rows
            out.append(Block("table", f'Sheet "{name}": {len(headers)} columns ({", ".join(headers)}) and {len(body)} data rows', page=page, confidence=0.95, rows=body, headers=headers))
    return out or [Block("narrative_text", "Empty spreadsheet", confidence=0.95)]


MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class Compound:
    """Streams of an OLE2 compound file by name (of the root storage)."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise DocError(E_PARSE, "not a compound file")
        try:
            self._read(data)
        except (struct.error, IndexError) as e:
            raise DocError(E_PARSE, f"compound file: {e}") from e

    def _read(self, data: bytes) -> None:
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, cutoff, first_mini = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60))
        difat = list(struct.unpack_from("<109I", data, 76))
        more, n = struct.unpack_from("<II", data, 68)
        while n and more < 0xFFFFFFFA:
            sector = struct.unpack_from(f"<{self.size // 4}I", data, (more + 1) * self.size)
            difat += sector[:-1]
            more, n = sector[-1], n - 1
        self.fat = [x for s in difat if s < 0xFFFFFFFA for x in struct.unpack_from(f"<{self.size // 4}I", data, (s + 1) * self.size)]
        entries = self._chain(first_dir)
        self.streams: dict[str, tuple[int, int]] = {}
        root = (0, 0)
        for at in range(0, len(entries) - 127, 128):
            n = struct.unpack_from("<H", entries, at + 64)[0]
            kind = entries[at + 66]
            name = entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
            where = struct.unpack_from("<I", entries, at + 116)[0], struct.unpack_from("<I", entries, at + 120)[0]
            if kind == 5:
                root = where
            elif kind == 2:
                self.streams.setdefault(name, where)
        self.cutoff = cutoff
        minifat = self._chain(first_mini) if first_mini < 0xFFFFFFFA else b""
        self.minifat = struct.unpack(f"<{len(minifat) // 4}I", minifat)
        self.ministream = self._chain(root[0])[: root[1]] if root[1] else b""

    def _chain(self, at: int) -> bytes:
        out, seen = [], 0
        while at < 0xFFFFFFFA and seen <= len(self.fat):
            out.append(self.data[(at + 1) * self.size : (at + 2) * self.size])
            at, seen = self.fat[at], seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.streams:
            return None
        at, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out, seen = [], 0
        while at < 0xFFFFFFFA and seen <= len(self.minifat):
            out.append(self.ministream[at * self.mini : (at + 1) * self.mini])
            at, seen = self.minifat[at], seen + 1
        return b"".join(out)[:size]


def parse_msg(content: bytes) -> list[Block]:
    file = Compound(content)

    def prop(ident: str) -> str:
        wide = file.stream(f"__substg1.0_{ident}001F")
        if wide is not None:
            return wide[: len(wide) // 2 * 2].decode("utf-16-le", "replace").rstrip("\0")
        ansi = file.stream(f"__substg1.0_{ident}001E")
        return "" if ansi is None else ansi.decode("cp1252", "replace").rstrip("\0")

    fields = [("title", "", prop("0037")), ("email_header", "From: ", prop("0C1A")), ("email_header", "To: ", prop("0E04")), ("email_body", "", strip(prop("1000")))]
    return [Block(k, a + b, confidence=0.85) for k, a, b in fields if b] or [Block("narrative_text", "Empty email")]


def image_dimensions(content: bytes, ext: str) -> tuple[int, int] | None:
    try:
        if ext == "png" and content[:4] == b"\x89PNG":
            return struct.unpack_from(">II", content, 16)
        if ext == "gif" and content[:4] == b"GIF8":
            return struct.unpack_from("<HH", content, 6)
        if ext == "bmp" and content[:2] == b"BM":
            w, h = struct.unpack_from("<ii", content, 18)
            return w, abs(h)
        if ext in ("jpg", "jpeg") and content[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(content):
                if content[at] != 0xFF:
                    at += 1
                    continue
                marker = content[at + 1]
                if marker in (0xC0, 0xC2):
                    h, w = struct.unpack_from(">HH", content, at + 5)
                    return w, h
                at += 2 + struct.unpack_from(">H", content, at + 2)[0]
    except struct.error:
        return None
    return None


def parse_image(content: bytes, ext: str) -> list[Block]:
    size = image_dimensions(content, ext)
    shown = f"{size[0]}x{size[1]}" if size else "unknown dimensions"
    meta = {"file_size": str(len(content)), "format": f'"{ext}"'} | ({"width": str(size[0]), "height": str(size[1])} if size else {})
    return [Block("image", f"Image ({ext}): {shown}, {len(content)} bytes — OCR not available (ONNX runtime not configured)", confidence=0.0, metadata=meta)]
