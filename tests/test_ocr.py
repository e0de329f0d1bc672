"""Recognition with models that are given: what goes in, what is made of what comes out, and what happens without."""

import struct
import sys
import zlib

import numpy as np
import pytest

from chunkloom.model import Block, DocError
from chunkloom.operators import ocr, vision
from chunkloom.sources import reader
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests' folder


def png(rgb, kinds=(0, 1, 2, 3, 4)):
    """A PNG whose rows take turns with the predictors."""
    h, w, _ = rgb.shape
    data, above = b"", np.zeros(w * 3, np.int64)
    for y in range(h):
        now, k = rgb[y].reshape(-1).astype(np.int64), kinds[y % len(kinds)]
        left, corner = np.concatenate([[0] * 3, now[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        guess = left + above - corner
        near = np.select([(abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), abs(guess - above) <= abs(guess - corner)], [left, above], corner)
        data += bytes([k]) + ((now - [0, left, above, (left + above) // 2, near][k]) % 256).astype(np.uint8).tobytes()
        above = now
    part = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def page():
    rgb = np.full((90, 200, 3), 255, np.uint8)
    rgb[10:30, 20:60] = 0
    rgb[10:30, 70:110] = 0
    rgb[60:80, 20:90] = 0
    return rgb


def dark():
    """Text is where the image is dark; a line is read as one letter for each 32 columns."""
    mean, deviation = ocr._MEAN, ocr._DEVIATION

    def detect(x):
        return ((x[0].transpose(1, 2, 0) * deviation + mean).mean(axis=2) < 0.5).astype(np.float32)

    def recognize(x):
        steps = np.full((x.shape[3] // 32 * 2, 4), -5.0, np.float32)
        steps[::2, 1 + (x.shape[3] // 32) % 2] = 3.0
        steps[1::2, 0] = 3.0
        return steps

    return ocr.Models(detect, recognize, ["a", "b", "c"])


def test_images_are_decoded(page):
    assert (ocr.decode_image(png(page)) == page).all()
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (ocr.decode_image(png(noise)) == noise).all()
    assert (ocr.decode_image(b"P6\n# c\n5 7\n255\n" + noise.tobytes()) == noise).all()
    rows = b"".join(noise[y, :, ::-1].tobytes() + b"\0" for y in range(6, -1, -1))
    assert (ocr.decode_image(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 7, 1, 24, 0, 0, 0, 0, 0, 0) + rows) == noise).all()
    for bad in (b"", b"GIF89a", png(page)[:60]):
        with pytest.raises(DocError):
            ocr.decode_image(bad)


def test_tensors(page):
    x = ocr.detection_tensor(page)
    assert x.shape == (1, 3, 96, 224) and x.dtype == np.float32
    flat = np.full((64, 64, 3), 51, np.uint8)
    assert ocr.detection_tensor(flat)[0, :, 5, 5] == pytest.approx((0.2 - np.array([0.485, 0.456, 0.406])) / [0.229, 0.224, 0.225], abs=1e-4)
    assert ocr.recognition_tensor(flat).shape == (1, 3, 48, 64) and ocr.recognition_tensor(flat) == pytest.approx(51 / 127.5 - 1, abs=1e-4)
    assert ocr.recognition_tensor(page[10:30, 20:120]).shape == (1, 3, 48, 256) and ocr.recognition_tensor(page[:50, :10]).shape[3] == 64


def test_parts_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for density in (0.3, 0.5, 0.6):
        on = rng.random((23, 31)) < density
        seen, want = np.zeros_like(on), []
        for y0, x0 in np.argwhere(on):
            if not seen[y0, x0]:
                stack, own = [(y0, x0)], []
                seen[y0, x0] = True
                while stack:
                    y, x = stack.pop()
                    own.append((y, x))
                    for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                        if 0 <= v < 23 and 0 <= u < 31 and on[v, u] and not seen[v, u]:
                            seen[v, u] = True
                            stack.append((v, u))
                y, x = zip(*own, strict=True)
                want.append((min(x), min(y), max(x) + 1, max(y) + 1))
        assert sorted(vision._parts(on)) == sorted(want)


def test_a_page(page):
    got = ocr.process_image(png(page), dark())
    assert [r["text"] for r in got] == ["bbb", "bbb", "aaaa"] and [r["bbox"][0] < 30 for r in got] == [True, False, True]
    assert got[0]["confidence"] == pytest.approx(1 / (1 + np.exp(-3)))
    blocks = ocr.process_page(png(page), 4, dark())
    assert [(b.text, b.page, b.metadata, b.element_type) for b in blocks] == [("bbb bbb", 4, {"source": "ocr"}, "narrative_text"), ("aaaa", 4, {"source": "ocr"}, "narrative_text")]
    assert ocr.process_page(png(np.full((40, 40, 3), 255, np.uint8)), 1, dark()) == []


def test_lines_are_joined_as_by_the_array_expression(spark):
    from pyspark.sql import functions as F

    boxes = [(0, 0, 20, 10), (25, 1, 20, 10), (60, 0, 10, 10), (100, 0, 5, 10), (0, 20, 9, 9)]
    blocks = [Block("narrative_text", f"t{i}", confidence=0.5 + i / 10, bbox=tuple(map(float, b))) for i, b in enumerate(boxes)]
    schema = "b array<struct<text:string,bbox:struct<x:float,y:float,width:float,height:float>,confidence:float>>"
    df = spark.createDataFrame([([(b.text, b.bbox, b.confidence) for b in blocks],)], schema)
    want = [(r.text, tuple(r.bbox)) for r in df.select(vision.merge_boxes(F.col("b")).alias("m")).first().m]
    assert [(b.text, b.bbox) for b in ocr.one_line(blocks)] == want


def test_with_and_without_models(spark, page, tmp_path):
    docs = spark.createDataFrame([(1, bytearray(png(page)), "image", "png"), (2, bytearray(b"GIF89a" + struct.pack("<HH", 4, 5)), "image", "gif"), (3, bytearray(b"text"), "text", "txt")], "id int, content binary, format_key string, ext string")
    got = {r.id: r.blocks for r in reader.parse_documents(docs, models=dark).collect()}
    assert [b.text for b in got[1]] == ["bbb bbb", "aaaa"] and got[1][0].metadata == {"source": "ocr"} and got[1][0].bbox is not None
    assert got[2][0].text.startswith("Image (gif)") and got[3][0].text == "text"
    for folder in (None, str(tmp_path)):
        plain = {r.id: r.blocks for r in reader.parse_documents(docs, models=folder).collect()}
        assert plain[1][0].text.startswith("Image (png)")
    (tmp_path / "det.onnx").write_bytes(b"no model")
    (tmp_path / "rec.onnx").write_bytes(b"no model")
    (tmp_path / "dict.txt").write_text("a\nb\n")
    with pytest.raises(DocError):
        ocr.load_models(str(tmp_path))
