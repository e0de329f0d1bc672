"""Vision operators: text boxes from a probability map, CTC decoding, merging of recognised boxes, table structure tokens.

Decoding and merging are array expressions; connected components and table structure are Python over single images.
Recognition itself is in ocr.py. Layout and table structure have no models: a row that asks for them gets an error code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..model import E_MODEL, E_PARSE, DocError


def ctc_decode(logits: Column, chars: Column) -> Column:
    """struct<text, confidence>: best class of each step, repeats collapsed, blanks (0) dropped; mean sigmoid of what is kept.

    chars holds the characters of the classes from 1 on; classes beyond it are dropped.
    """
    return let(F.transform(logits, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1), lambda best: _ctc(logits, best, chars))


def _ctc(logits: Column, best: Column, chars: Column) -> Column:
    kept = F.filter(F.transform(best, lambda b, t: F.struct(b.alias("b"), t.alias("t"))), lambda x: (x["b"] > 0) & (x["b"] <= F.size(chars)) & ((x["t"] == 0) | (F.get(best, F.greatest(x["t"] - 1, F.lit(0))) != x["b"])))
    text = F.array_join(F.transform(kept, lambda x: F.get(chars, x["b"] - 1)), "")
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.lit(1.0) / (F.lit(1.0) + F.exp(-F.array_max(F.get(logits, x["t"])).cast("double"))))
    return F.struct(text.alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("confidence"))


def merge_boxes(blocks: Column) -> Column:
    """Blocks in reading order, those that continue a line joined with the one before (text, union of boxes, mean confidence)."""

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        p, q = last["bbox"], b["bbox"]
        high = F.greatest(p["height"], q["height"])
        off = F.abs((p["y"] + p["height"] / 2) - (q["y"] + q["height"] / 2))
        gap = q["x"] - (p["x"] + p["width"])
        near = (F.size(acc) > 0) & p.isNotNull() & q.isNotNull() & (off < high * 0.5) & (gap > -high) & (gap < high * 2)
        left, low = F.least(p["x"], q["x"]), F.least(p["y"], q["y"])
        box = F.struct(
            left.alias("x"), low.alias("y"), (F.greatest(p["x"] + p["width"], q["x"] + q["width"]) - left).cast("float").alias("width"), (F.greatest(p["y"] + p["height"], q["y"] + q["height"]) - low).cast("float").alias("height")
        )
        one = last.withField("text", F.concat_ws(" ", last["text"], b["text"])).withField("bbox", box).withField("confidence", ((last["confidence"] + b["confidence"]) / 2).cast("float"))
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(blocks, F.slice(blocks, 1, 0), step)


def confident(regions: Column, least: float) -> Column:
    return F.filter(regions, lambda r: r["confidence"] >= least)


def reading_order(regions: Column) -> Column:
    """By y, then x."""
    cmp = lambda a, b: F.when(a["bbox"]["y"] < b["bbox"]["y"], -1).when(a["bbox"]["y"] > b["bbox"]["y"], 1).when(a["bbox"]["x"] < b["bbox"]["x"], -1).when(a["bbox"]["x"] > b["bbox"]["x"], 1).otherwise(0)
    return F.array_sort(regions, cmp)


def _parts(on: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Left, top, right and bottom (exclusive) of the 4-connected parts of a mask, by their first pixel. Runs of pixels are joined, row by row."""
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (rows, begins), ends = np.nonzero(edge > 0), np.nonzero(edge < 0)[1]
    up = list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = np.searchsorted(rows, np.arange(on.shape[0] + 1)).tolist()
    for y in range(1, on.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if begins[i] < ends[j] and begins[j] < ends[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    boxes: dict[int, list[int]] = {}
    for k, (y, x, e) in enumerate(zip(rows.tolist(), begins.tolist(), ends.tolist(), strict=True)):
        box = boxes.setdefault(root(k), [x, y, e, y + 1])
        box[:] = min(box[0], x), min(box[1], y), max(box[2], e), max(box[3], y + 1)
    return [tuple(boxes[k]) for k in sorted(boxes)]


def text_boxes(prob: np.ndarray, height: int, width: int, threshold: float = 0.3) -> list[dict]:
    """Boxes of the 4-connected parts of a probability map above the threshold, scaled to the image and padded."""
    sy, sx = height / prob.shape[0], width / prob.shape[1]
    out = []
    for x0, y0, x1, y1 in _parts(prob > threshold):
        left, top, right, low = x0 * sx, y0 * sy, x1 * sx, y1 * sy
        if (right - left) * (low - top) < 100:
            continue
        px, py = max(5 * sx, 10.0), max(5 * sy, 10.0)
        left, top, right, low = max(0.0, left - px), max(0.0, top - py), min(float(width), right + px), min(float(height), low + py)
        out.append({"x": left, "y": top, "width": right - left, "height": low - top, "confidence": 0.8})
    return out


def detection_input(rgb: np.ndarray) -> tuple[int, int]:
    """Size that a detection model gets: multiples of 32."""
    return max(32, -(-rgb.shape[0] // 32) * 32), max(32, -(-rgb.shape[1] // 32) * 32)


def recognition_width(crop_w: int, crop_h: int) -> int:
    """Width at a height of 48, a multiple of 32 and 48 at least."""
    return -(-max(48, int(48 * crop_w / max(1, crop_h))) // 32) * 32


@dataclass
class Cell:
    token: str
    colspan: int = 1
    rowspan: int = 1
    consumed: bool = False
    content: str = ""


def parse_otsl(text: str) -> list[str]:
    out = text.split()
    bad = [t for t in out if t not in ("C", "L", "U", "X", "NL")]
    if bad:
        raise DocError(E_PARSE, f"unknown table token {bad[0]}")
    return out


def otsl_grid(tokens: list[str], contents: list[str] = ()) -> list[list[Cell]]:
    """Cells with spans: L goes to its left, U to what is above, X to both; contents fill the others in reading order."""
    grid: list[list[Cell]] = [[]]
    for t in tokens:
        if t == "NL":
            grid.append([])
        else:
            grid[-1].append(Cell(t))
    grid = [r for r in grid if r]
    origin: dict[tuple[int, int], tuple[int, int]] = {}
    for y, row in enumerate(grid):
        for x, cell in enumerate(row):
            at = (y, x)
            if cell.token == "L" and x:
                at = origin[y, x - 1]
                if at[0] == y:
                    grid[y][at[1]].colspan = max(grid[y][at[1]].colspan, x - at[1] + 1)
            elif cell.token in "UX" and y and x < len(grid[y - 1]):
                at = origin[y - 1, x]
                if cell.token == "U":
                    c = grid[at[0]][at[1]]
                    c.rowspan = max(c.rowspan, y - at[0] + 1)
            cell.consumed = at != (y, x)
            origin[y, x] = at
    left = iter(contents)
    for row in grid:
        for cell in row:
            if not cell.consumed:
                cell.content = next(left, "")
    return grid


def otsl_html(tokens: list[str], contents: list[str] = ()) -> str:
    out = ["<table>"]
    for row in otsl_grid(tokens, contents):
        out.append("<tr>")
        for c in row:
            if not c.consumed:
                spans = (f' colspan="{c.colspan}"' if c.colspan > 1 else "") + (f' rowspan="{c.rowspan}"' if c.rowspan > 1 else "")
                out.append(f"<td{spans}>{c.content}</td>")
        out.append("</tr>")
    return "".join([*out, "</table>"])


def otsl_table(tokens: list[str], contents: list[str] = ()) -> tuple[list[list[str]], list[str] | None]:
    """Rows of the cells that weren't consumed, and the first of them as headers too."""
    rows = [[c.content for c in row if not c.consumed] for row in otsl_grid(tokens, contents)]
    return rows, list(rows[0]) if rows else None


def detect_regions(_: bytes) -> None:
    raise DocError(E_MODEL, "no layout model")


def recognize_structure(_: bytes) -> None:
    raise DocError(E_MODEL, "no table model")
