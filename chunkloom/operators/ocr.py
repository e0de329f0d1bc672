"""Optical character recognition of images, with models that are given: what goes into them and what is made of their output.

A detection model gives a probability of text for every pixel, a recognition model classes for steps along a cut-out line. They
are ONNX files in a folder (or any object with the same two functions), loaded once per task and never shipped. Everything else
is numpy on one image.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..model import E_MODEL, E_PARSE, Block, DocError
from ..sources.pdf import unpredicted
from .vision import detection_input, recognition_width, text_boxes

_MEAN, _DEVIATION = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


@dataclass
class Models:
    """detect: 1 x 3 x h x w to a map of probabilities; recognize: 1 x 3 x 48 x w to steps x classes; characters of the classes from 1 on."""

    detect: Callable[[np.ndarray], np.ndarray]
    recognize: Callable[[np.ndarray], np.ndarray]
    chars: list[str]


def load_models(folder: str | None) -> Models:
    """Models and character list of a folder: *det*.onnx, *rec*.onnx and *dict*.txt, the first of each by name."""
    found = [sorted(glob.glob(os.path.join(folder or "", k))) for k in ("*det*.onnx", "*rec*.onnx", "*dict*.txt")]
    if not folder or not all(found):
        raise DocError(E_MODEL, f"no OCR models in {folder}")
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has a core
    try:
        sessions = [onnxruntime.InferenceSession(x[0], options, providers=["CPUExecutionProvider"]) for x in found[:2]]
    except Exception as e:  # whatever the library raises for a file that is no model
        raise DocError(E_MODEL, f"OCR models: {e}") from e
    with open(found[2][0], encoding="utf-8") as f:
        chars = [x[0] for x in f.read().splitlines() if x]
    one = lambda s: lambda x: s.run(None, {s.get_inputs()[0].name: x})[0]
    detect, recognize = map(one, sessions)
    return Models(lambda x: detect(x).reshape(x.shape[2:]), lambda x: recognize(x)[0], chars)


def decode_image(content: bytes) -> np.ndarray:
    """RGB of a PNG (8 or 16 bits, not interlaced), an uncompressed bitmap or a binary portable pixmap."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:2] == b"BM":
            return _bmp(content)
        if content[:2] in (b"P5", b"P6"):
            return _pnm(content)
    except (IndexError, ValueError, KeyError, zlib.error) as e:
        raise DocError(E_PARSE, f"image can't be decoded: {e}") from e
    raise DocError(E_PARSE, "no decoder for this kind of image")


def _png(content: bytes) -> np.ndarray:
    at, data, palette = 8, b"", None
    width = height = depth = kind = 0
    while at + 8 <= len(content):
        size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, kind = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9]
            if depth not in (8, 16) or body[12] or not width or not height:
                raise ValueError("bit depth or interlacing")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
    many, wide = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind], depth // 8
    raw = unpredicted(zlib.decompress(data), width * many * wide, many * wide)
    x = np.frombuffer(raw, np.uint8).reshape(height, width, many, wide)[..., 0]
    if kind == 3:
        return palette[x[..., 0]]
    return np.repeat(x[..., :1], 3, axis=2) if many < 3 else x[..., :3]


def _bmp(content: bytes) -> np.ndarray:
    number = lambda at, n, signed=False: int.from_bytes(content[at : at + n], "little", signed=signed)
    start, width, height, bits = number(10, 4), number(18, 4, True), number(22, 4, True), number(28, 2)
    if bits not in (24, 32) or number(30, 4) not in (0, 3):
        raise ValueError("kind of bitmap")
    row = -(-width * bits // 32) * 4
    x = np.frombuffer(content, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    return x[:: -1 if height > 0 else 1, :, 2::-1]


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace() or content[at : at + 1] == b"#":
            at = content.index(b"\n", at) + 1 if content[at : at + 1] == b"#" else at + 1
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    many = 3 if content[:2] == b"P6" else 1
    x = np.frombuffer(content, np.uint8, fields[0] * fields[1] * many, at + 1).reshape(fields[1], fields[0], many)
    return np.repeat(x, 3, axis=2) if many == 1 else x


def _weights(old: int, new: int) -> np.ndarray:
    """A row for each new pixel with the old ones' weights: a sinc window of three lobes, wider where pixels are lost."""
    scale = max(1.0, old / new)
    middle = (np.arange(new) + 0.5) * old / new - 0.5
    t = (np.arange(old)[None, :] - middle[:, None]) / scale
    w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def resized(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image in another size, in floats from 0 to 255."""
    x = rgb.astype(np.float32)
    if x.shape[0] != height:
        x = np.tensordot(_weights(x.shape[0], height), x, axes=(1, 0))
    if x.shape[1] != width:
        x = np.tensordot(_weights(x.shape[1], width), x, axes=(1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(x), 0, 255)


def detection_tensor(rgb: np.ndarray) -> np.ndarray:
    """1 x 3 x h x w for detection: sides of multiples of 32, channels less their usual means over their usual deviations."""
    x = (resized(rgb, *detection_input(rgb)) / 255 - _MEAN) / _DEVIATION
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None], dtype=np.float32)


def recognition_tensor(crop: np.ndarray) -> np.ndarray:
    """1 x 3 x 48 x w for recognition: values from -1 to 1."""
    x = resized(crop, 48, recognition_width(crop.shape[1], crop.shape[0])) / 127.5 - 1
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None], dtype=np.float32)


def ctc_text(logits: np.ndarray, chars: list[str]) -> tuple[str, float]:
    """Best class of each step, repeats collapsed, blanks and unknown classes dropped; the mean sigmoid of what is kept."""
    best = logits.argmax(axis=1)
    kept = (best > 0) & (best <= len(chars)) & np.concatenate([[True], best[1:] != best[:-1]])
    if not kept.any():
        return "", 0.0
    return "".join(chars[k - 1] for k in best[kept]), float((1 / (1 + np.exp(-logits.max(axis=1)[kept].astype(np.float64)))).mean())


def process_image(content: bytes, models: Models) -> list[dict]:
    """text, bbox and confidence of every line of text, from top to bottom, then from left to right."""
    rgb = decode_image(content)
    height, width = rgb.shape[:2]
    out = []
    for box in text_boxes(models.detect(detection_tensor(rgb)), height, width):
        x, y = min(int(box["x"]), width - 1), min(int(box["y"]), height - 1)
        w, h = max(1, min(int(box["width"]), width - x)), max(1, min(int(box["height"]), height - y))
        text, confidence = ctc_text(models.recognize(recognition_tensor(rgb[y : y + h, x : x + w])), models.chars)
        if text.strip():
            out.append({"text": text.strip(), "bbox": (box["x"], box["y"], box["width"], box["height"]), "confidence": confidence})
    return sorted(out, key=lambda r: (r["bbox"][1], r["bbox"][0]))


def one_line(blocks: list[Block]) -> list[Block]:
    """Blocks in reading order, those that continue a line joined with the one before; confidences are averaged as they come."""
    out: list[Block] = []
    for b in blocks:
        if out:
            (x, y, w, h), (p, q, r, s) = out[-1].bbox, b.bbox
            high, gap = max(h, s), p - (x + w)
            if abs((y + h / 2) - (q + s / 2)) < high * 0.5 and -high < gap < high * 2:
                left, top = min(x, p), min(y, q)
                last = out[-1]
                last.text, last.confidence = f"{last.text} {b.text}", (last.confidence + b.confidence) / 2
                last.bbox = (left, top, max(x + w, p + r) - left, max(y + h, q + s) - top)
                continue
        out.append(b)
    return out


def process_page(content: bytes, page: int, models: Models) -> list[Block]:
    """Blocks of an image's text."""
    return one_line([Block("narrative_text", r["text"], page=page, confidence=r["confidence"], bbox=r["bbox"], metadata={"source": "ocr"}) for r in process_image(content, models)])
