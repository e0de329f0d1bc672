"""PDF: a small reader of content streams, and the layout heuristics from characters to blocks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

from ..model import E_MODEL, E_PARSE, Block, DocError
from .plain import lines, strip


def unpredicted(raw: bytes, row: int, back: int) -> bytes:
    """Bytes of rows that were stored as differences, each with its kind before it (PNG predictors)."""
    out, above = bytearray(), bytes(row)
    for at in range(0, len(raw) - 1, row + 1):
        kind, now = raw[at], bytearray(raw[at + 1 : at + 1 + row])
        for i in range(len(now)):
            left = now[i - back] if i >= back else 0
            up, corner = above[i], above[i - back] if i >= back else 0
            if kind == 1:
                plus = left
            elif kind == 2:
                plus = up
            elif kind == 3:
                plus = (left + up) // 2
            elif kind == 4:
                guess = left + up - corner
                plus = min((left, up, corner), key=lambda x: abs(guess - x))
            else:
                plus = 0
            now[i] = (now[i] + plus) & 255
        out += now
        above = bytes(now).ljust(row, b"\0")
    return bytes(out)


def dictionary(body: bytes) -> bytes:
    """The dictionary that the bytes begin with, to its own end, if they begin with one."""
    start = re.match(rb"\s*<<", body)
    if not start:
        return body
    depth = 0
    for m in re.finditer(rb"<<|>>", body):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return body[: m.end()]
    return body


@dataclass
class Char:
    ch: str
    x: float
    y: float
    top: float
    width: float
    size: float
    font: str = ""
    bold: bool = False


@dataclass
class Line:
    chars: list[Char]
    text: str = field(init=False)

    def __post_init__(self):
        self.chars.sort(key=lambda c: c.x)
        parts, end = [], None
        for c in self.chars:
            if end is not None and c.x - end > c.size * 0.25:
                parts.append(" ")
            parts.append(c.ch)
            end = c.x + c.width
        self.text = "".join(parts)
        self.baseline = sum(c.y for c in self.chars) / len(self.chars)
        self.left, self.right = min(c.x for c in self.chars), max(c.x + c.width for c in self.chars)
        self.top = max(c.top for c in self.chars)
        self.size = common_size(self.chars)
        self.bold = 2 * sum(c.bold for c in self.chars) > len(self.chars)


def common_size(chars: list[Char]) -> float:
    """Most frequent font size in tenths of a point; the smallest of equally frequent ones."""
    n = Counter(int(c.size * 10) for c in chars)
    return min(n, key=lambda k: (-n[k], k)) / 10 if n else 12.0


def to_lines(chars: list[Char]) -> list[Line]:
    out: list[list[Char]] = []
    for c in sorted(chars, key=lambda c: (-c.y, c.x)):
        if out and abs(c.y - out[-1][0].y) <= max(c.size, 4.0) * 0.5:
            out[-1].append(c)
        else:
            out.append([c])
    return [Line(x) for x in out]


def tab_stops(line: Line) -> list[float]:
    c = line.chars
    wide = max(sum(x.width for x in c) / len(c), 3.0) * 3.0
    return [(a.x + a.width + b.x) / 2 for a, b in zip(c, c[1:], strict=False) if b.x - a.x - a.width > wide]


def aligned(a: list[float], b: list[float], tolerance: float = 15.0) -> bool:
    return bool(a and b) and 2 * sum(any(abs(x - y) < tolerance for x in a) for y in b) >= len(b)


def table_regions(rows: list[Line]) -> list[tuple[int, int, list[float]]]:
    stops, out, i = [tab_stops(r) for r in rows], [], 0
    while i < len(rows):
        j = i + 1
        if len(stops[i]) >= 2:
            while j < len(rows) and aligned(stops[i], stops[j]):
                j += 1
            if j - i >= 3:
                out.append((i, j, stops[i]))
                i = j
                continue
        i += 1
    return out


def is_list_item(t: str) -> bool:
    return bool(re.match(r"[-*•·◦‣] |[0-9]{1,3}[.)]", t))


def is_footer(t: str) -> bool:
    return len(lines(t)) == 1 and (t.lower().startswith("page ") or bool(re.fullmatch(r"\+?[0-9]+", t)) and int(t) < 2**32)


def _upper_share(t: str) -> float | None:
    alpha = [c for c in t if c.isalpha()]
    return sum(c.isupper() for c in alpha) / len(alpha) if alpha else None


def is_heading(t: str, ratio: float, bold: bool) -> bool:
    n, size = len(lines(t)), len(t.encode())
    if n > 2 or size > 200:
        return False
    if ratio >= 1.2 or bold and size < 120 and not t.endswith("."):
        return True
    return n == 1 and size < 80 and not t.endswith(".") and (_upper_share(t) or 0) > 0.7


def classify(t: str) -> str:
    if is_footer(t):
        return "footer"
    if is_list_item(t):
        return "list_item"
    size, share = len(t.encode()), _upper_share(t)
    if len(lines(t)) == 1 and size < 120 and not t.endswith(".") and share is not None and (share > 0.6 or size < 60):
        return "title"
    return "narrative_text"


def _table(rows: list[Line], region: tuple[int, int, list[float]], page: int) -> Block:
    begin, end, stops = region
    grid = []
    for r in rows[begin:end]:
        cells = [""] * (len(stops) + 1)
        for c in r.chars:
            cells[next((i for i, s in enumerate(stops) if c.x < s), len(stops))] += c.ch
        grid.append([strip(x) for x in cells])
    headers = grid.pop(0) if rows[begin].bold else None
    return Block("table", "\n".join(" | ".join(r) for r in grid), page=page, confidence=0.85, rows=grid, headers=headers)


def _box(left: float, low: float, right: float, top: float) -> tuple[float, float, float, float]:
    return left, low, right - left, top - low


def layout(chars: list[Char], page: int) -> list[Block]:
    """Blocks of a page's characters."""
    rows = to_lines(chars)
    body = common_size(chars)
    regions = {r[0]: r for r in table_regions(rows)}
    inside = {i for a, b, _ in regions.values() for i in range(a, b)}
    kind = lambda r: "title" if is_heading(strip(r.text), r.size / body, r.bold) else "list_item" if is_list_item(strip(r.text)) else "footer" if is_footer(strip(r.text)) else "narrative_text"
    out: list[Block] = []
    i = 0
    while i < len(rows):
        if i in regions:
            out.append(_table(rows, regions[i], page))
            i = regions[i][1]
            continue
        r = rows[i]
        t = strip(r.text)
        i += 1
        if not t:
            continue
        k = kind(r)
        if k != "narrative_text":
            meta = {"font_size": repr(r.size), "font_name": f'"{r.chars[0].font}"'} if k == "title" else {}
            out.append(Block(k, t, page=page, confidence=0.9, metadata=meta, bbox=None if k == "footer" else _box(r.left, r.baseline, r.right, r.top)))
            continue
        para, first = [r], i - 1
        while i < len(rows) and i not in inside and strip(rows[i].text) and kind(rows[i]) == "narrative_text":
            if abs(rows[i - 1].baseline - rows[i].baseline) > body * 1.5 * 1.8 and i > first + 1:
                break
            para.append(rows[i])
            i += 1
        box = _box(min(x.left for x in para), min(x.baseline for x in para), max(x.right for x in para), max(x.top for x in para))
        out.append(Block("narrative_text", " ".join(strip(x.text) for x in para), page=page, confidence=0.9, bbox=box))
    return out


# --- a small reader: objects, page tree, content streams ------------------------------------------------------------

_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[+-]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?\*?|\()")


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            e = data[at : at + 1]
            at += 1
            if e in b"nrtbf":
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}[e]
            elif e.isdigit():
                m = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2])
                if m:
                    out.append(int(m[0], 8) & 255)
                    at += len(m[0]) - 1
            elif e not in b"\r\n":
                out += e
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def tokens(data: bytes):
    """Names, numbers, strings (as bytes in a tuple) and operators."""
    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        t = m[1]
        if t is None:
            continue
        if t == b"(":
            s, at = _string(data, at)
            yield (s,)
        elif t[:1] == b"<" and t != b"<<":
            h = re.sub(rb"\s", b"", t[1:-1])
            yield (bytes.fromhex((h + b"0" * (len(h) % 2)).decode()),)
        else:
            yield t


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise DocError(E_PARSE, "not a PDF document")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise DocError(E_PARSE, "PDF is encrypted")
        self.objects: dict[int, bytes] = {}
        for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b", data):
            end = data.find(b"endobj", m.end())
            self.objects[int(m[1])] = data[m.end() : end if end >= 0 else len(data)]
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body.split(b"stream", 1)[0]):
                inner = self.stream(body)
                n, first = (int(re.search(k + rb"\s+(\d+)", body)[1]) for k in (rb"/N", rb"/First"))
                nums = list(map(int, inner[:first].split()[: 2 * n]))
                for k in range(n):
                    stop = nums[2 * k + 3] if k + 1 < n else len(inner) - first
                    self.objects.setdefault(nums[2 * k], inner[first + nums[2 * k + 1] : first + stop])

    def stream(self, body: bytes) -> bytes:
        """Decoded bytes of a stream object. One that can't be decoded is an error of the document: no page vanishes."""
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return b""
        head, raw = body[: m.start()], body[m.end() :]
        size = re.search(rb"/Length\s+(\d+)(?!\s*\d*\s+\d+\s+R)\b", head)
        size = int(size[1]) if size else self.number(self.ref(head, b"/Length"))
        raw = raw[:size] if size is not None and size <= len(raw) else raw[: raw.rfind(b"endstream")]
        if b"FlateDecode" in head or re.search(rb"/Filter\s*\[?\s*/Fl\b", head):
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error as e:
                raise DocError(E_PARSE, f"damaged stream: {e}") from e
            kind = re.search(rb"/Predictor\s+(\d+)", head)
            if kind and int(kind[1]) >= 10:
                value = lambda k, d: int(m[1]) if (m := re.search(k + rb"\s+(\d+)", head)) else d
                raw = unpredicted(raw, value(rb"/Columns", 1) * value(rb"/Colors", 1) * value(rb"/BitsPerComponent", 8) // 8, max(1, value(rb"/Colors", 1) * value(rb"/BitsPerComponent", 8) // 8))
        return raw

    @staticmethod
    def number(body: bytes | None) -> int | None:
        m = re.match(rb"\s*(\d+)", body or b"")
        return int(m[1]) if m else None

    def ref(self, body: bytes, key: bytes) -> bytes | None:
        """A dictionary's value: what it refers to, or the text from the value on."""
        m = re.search(re.escape(key) + rb"(?![A-Za-z])\s*(\d+)\s+\d+\s+R", body)
        if m:
            return self.objects.get(int(m[1]))
        m = re.search(re.escape(key) + rb"(?![A-Za-z])\s*", body)
        return body[m.end() :] if m else None

    def pages(self) -> list[bytes]:
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)]
        out: list[bytes] = []

        def visit(body: bytes | None, inherited: bytes, depth: int = 0) -> None:
            if body is None or depth > 40:
                return
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
            if kids:
                own = body if b"/Resources" in body else inherited
                for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                    visit(self.objects.get(int(k)), own, depth + 1)
            else:
                out.append(body if b"/Resources" in body else body + b" " + inherited)

        for r in roots[-1:]:
            visit(self.ref(r, b"/Pages"), b"")
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", b)]

    def fonts(self, res: bytes) -> dict[bytes, dict]:
        """The fonts that some resources name."""
        fonts = dictionary(self.ref(res, b"/Font") or b"")
        out = {}
        for name, num in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts):
            body = self.objects.get(int(num), b"")
            base = re.search(rb"/BaseFont\s*/([^\s/<>\[\]]+)", body)
            name_of = base[1].decode("latin-1") if base else ""
            inner = self.ref(body, b"/DescendantFonts")
            if inner is not None and (m := re.match(rb"\s*\[\s*(\d+)\s+\d+\s+R", inner)):
                inner = self.objects.get(int(m[1]), b"")
            first, widths = re.search(rb"/FirstChar\s+(\d+)", body), self.ref(body, b"/Widths")
            widths = re.match(rb"\s*\[([^\]]*)\]", widths or b"")
            sizes = {int(first[1]) + i: float(w) for i, w in enumerate(widths[1].split())} if first and widths else {}
            if inner:
                sizes |= self.wide_widths(self.ref(inner, b"/W") or b"")
            described = self.ref(inner or body, b"/FontDescriptor") or b""
            weight, flags = re.search(rb"/FontWeight\s+(\d+)", described), re.search(rb"/Flags\s+(\d+)", described)
            bold = "bold" in name_of.lower() or bool(weight and int(weight[1]) >= 600) or bool(flags and int(flags[1]) >> 18 & 1)
            cmap = self.ref(body, b"/ToUnicode")
            out[name] = {"name": name_of, "wide": b"/Type0" in body or b"Identity-H" in body, "text": self.to_text(self.stream(cmap)) if cmap else {}, "widths": sizes, "bold": bold}
        return out

    @staticmethod
    def wide_widths(body: bytes) -> dict[int, float]:
        """first [w w ...] and first last w, as a composite font lists them."""
        out: dict[int, float] = {}
        m = re.match(rb"\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", body)
        for first, many, last, one in re.findall(rb"(\d+)\s*(?:\[([^\]]*)\]|(\d+)\s+([\d.]+))", m[1] if m else b""):
            if last:
                out |= dict.fromkeys(range(int(first), min(int(last), int(first) + 65535) + 1), float(one))
            else:
                out |= {int(first) + i: float(w) for i, w in enumerate(many.split())}
        return out

    @staticmethod
    def to_text(cmap: bytes) -> dict[int, str]:
        """Characters of codes: single ones, ranges from a first character on, ranges with a list."""
        text = lambda h: bytes.fromhex(h.decode() + "0" * (-len(h) % 4)).decode("utf-16-be", "replace")
        out: dict[int, str] = {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
                low, n = int(a, 16), min(int(b, 16) - int(a, 16) + 1, 65536)
                if c:
                    head, last = text(c)[:-1], text(c)[-1:]
                    out |= {low + k: head + chr((ord(last) + k) & 0xFFFFF) for k in range(n) if last}
                else:
                    out |= {low + k: text(h) for k, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many)[:n])}
        return out

    def chars(self, page: bytes) -> list[Char]:
        """Characters of a page with their places, those of forms that it draws too."""
        inner = self.ref(page, b"/Contents")
        m = re.search(rb"/Contents\s*\[([^\]]*)\]", page) or re.match(rb"\s*\[([^\]]*)\]", inner or b"")
        refs = re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else re.findall(rb"/Contents\s+(\d+)\s+\d+\s+R", page)
        out: list[Char] = []
        self.draw(b"\n".join(self.stream(self.objects.get(int(r), b"")) for r in refs), self.ref(page, b"/Resources") or page, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], out, 0)
        return out

    def draw(self, data: bytes, res: bytes, ctm: list[float], out: list[Char], depth: int) -> None:
        res = dictionary(res)
        fonts = self.fonts(res)
        forms = dict(re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", dictionary(self.ref(res, b"/XObject") or b"")))
        stack: list = []
        font, size, lead, scale, space, gap, rise = {"name": "", "wide": False, "text": {}, "widths": {}, "bold": False}, 12.0, 0.0, 1.0, 0.0, 0.0, 0.0
        tm, line = [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0]

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            line = times([1.0, 0.0, 0.0, 1.0, x, y], line)
            tm = list(line)

        def show(s: bytes) -> None:
            step = 2 if font["wide"] else 1
            for k in range(0, len(s) - step + 1, step):
                code = int.from_bytes(s[k : k + step], "big")
                ch = font["text"].get(code) or ("" if font["wide"] else bytes([code]).decode("cp1252", "ignore"))
                width = font["widths"].get(code, 500.0) / 1000 * size
                at = times(tm, ctm)
                high = abs(size) * (at[2] ** 2 + at[3] ** 2) ** 0.5 or abs(size)
                if ch:
                    y = at[5] + rise * at[3]
                    out.append(Char(ch, at[4], y, y + high, width * ((at[0] ** 2 + at[1] ** 2) ** 0.5 or 1), high, font["name"], font["bold"]))
                dx = (width + gap + (space if code == 32 and step == 1 else 0)) * scale
                tm[4] += dx * tm[0]
                tm[5] += dx * tm[1]

        args: list = []
        for t in tokens(data):
            if isinstance(t, tuple) or t[:1] in b"/[]<>+-.0123456789" and t not in (b"'", b'"'):
                args.append(t)
                continue
            nums = [float(a) for a in args if isinstance(a, bytes) and re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", a)]
            try:
                if t == b"Tf":
                    font, size = fonts.get(next(a for a in args if isinstance(a, bytes) and a[:1] == b"/"), font), nums[-1]
                elif t == b"BT":
                    tm, line = [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0]
                elif t in (b"Td", b"TD"):
                    lead = -nums[1] if t == b"TD" else lead
                    move(nums[0], nums[1])
                elif t == b"Tm":
                    line = nums[-6:]
                    tm = list(line)
                elif t == b"T*":
                    move(0, -lead)
                elif t == b"TL":
                    lead = nums[-1]
                elif t == b"Tc":
                    gap = nums[-1]
                elif t == b"Tw":
                    space = nums[-1]
                elif t == b"Tz":
                    scale = nums[-1] / 100
                elif t == b"Ts":
                    rise = nums[-1]
                elif t in (b"Tj", b"'", b'"'):
                    if t != b"Tj":
                        move(0, -lead)
                    show(next(a[0] for a in args if isinstance(a, tuple)))
                elif t == b"TJ":
                    for a in args:
                        if isinstance(a, tuple):
                            show(a[0])
                        elif re.fullmatch(rb"[+-]?\d*\.?\d+", a):
                            tm[4] -= float(a) / 1000 * size * scale * tm[0]
                elif t == b"cm":
                    ctm = times(nums[-6:], ctm)
                elif t == b"Do" and depth < 12:
                    body = self.objects.get(int(forms.get(args[-1], b"-1")), b"")
                    head = body.split(b"stream", 1)[0]
                    if re.search(rb"/Subtype\s*/Form", head):
                        matrix = re.search(rb"/Matrix\s*\[([^\]]*)\]", head)
                        own = self.ref(head, b"/Resources")
                        self.draw(self.stream(body), own if own is not None else res, times(list(map(float, matrix[1].split())), ctm) if matrix else ctm, out, depth + 1)
                elif t == b"q":
                    stack.append((font, size, ctm))
                elif t == b"Q" and stack:
                    font, size, ctm = stack.pop()
            except (IndexError, StopIteration, ValueError):
                pass
            args = []


def times(m: list[float], n: list[float]) -> list[float]:
    """Product of two transformations."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l]


def pages_to_blocks(pages: list[str]) -> list[Block]:
    """Blocks of page texts without layout: paragraphs between empty lines."""
    return [Block(classify(t), t, page=n, confidence=0.7) for n, page in enumerate(pages, 1) for t in map(strip, page.split("\n\n")) if t]


def plain_page(chars: list[Char]) -> str:
    """Text of a page without layout: a line where the height changes, an empty one for a step of more than two lines."""
    out: list[str] = []
    for i, c in enumerate(chars):
        step = abs(c.y - chars[i - 1].y) if i else 0.0
        if step > 0.5 * c.size:
            out.append("\n\n" if step > 2.2 * c.size else "\n")
        out.append(c.ch)
    return "".join(out)


def parse_pdf(content: bytes) -> list[Block]:
    """Blocks by layout; where the layout of a document can't be made out, paragraphs of its pages' texts."""
    pdf = Pdf(content)
    pages = [[c for c in pdf.chars(page) if c.ch.isspace() or c.size > 0] for page in pdf.pages()]
    try:
        return [b for n, chars in enumerate(pages, 1) if chars for b in layout(chars, n)]
    except (ArithmeticError, LookupError, ValueError):
        return pages_to_blocks([plain_page(chars) for chars in pages])


def rasterize(content: bytes, page: int, dpi: int = 300) -> bytes:
    """An image of a page. There is no renderer among the libraries at hand, so this is an error of the document."""
    raise DocError(E_MODEL, f"no renderer for page {page} at {dpi} dots an inch")
