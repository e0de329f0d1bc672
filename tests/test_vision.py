"""Vision operators that need no models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.model import DocError
from chunkloom.operators import ocr, vision


def test_ctc(spark):
    rows = [([[0.1, 5.0, 0.2], [0.1, 5.0, 0.2], [9.0, 0.0, 0.0], [0.0, 0.1, 3.0]],), ([[9.0, 0.0, 0.0]] * 2,)]
    got = spark.createDataFrame(rows, "x array<array<float>>").select(vision.ctc_decode(F.col("x"), F.array(F.lit("a"), F.lit("b"))).alias("d")).collect()
    sig = lambda v: 1 / (1 + np.exp(-v))
    assert got[0].d.text == "ab" and abs(got[0].d.confidence - (sig(5) + sig(3)) / 2) < 1e-6
    assert (got[1].d.text, got[1].d.confidence) == ("", 0.0)


def test_boxes():
    p = np.zeros((32, 32))
    assert vision.text_boxes(p, 64, 64) == []
    p[8:20, 8:20] = 0.9
    (b,) = vision.text_boxes(p, 64, 64)
    assert (b["x"], b["y"], b["width"], b["height"]) == (6.0, 6.0, 44.0, 44.0)


@pytest.mark.parametrize(
    "otsl,cells,html",
    [
        ("C L NL C C", "a b c", '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>'),
        ("C C NL U C", "a b c", '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>'),
        ("C L C NL U X C", "a b c", '<table><tr><td colspan="2" rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>'),
    ],
)
def test_table_tokens(otsl, cells, html):
    assert vision.otsl_html(vision.parse_otsl(otsl), cells.split()) == html


def test_table_tokens_must_be_known():
    with pytest.raises(DocError):
        vision.parse_otsl("C Z")
    assert vision.otsl_table(["C", "C", "NL", "C", "C"], ["h", "i", "1", "2"]) == ([["h", "i"], ["1", "2"]], ["h", "i"])


def test_absent_models_are_an_error():
    for f in (lambda: ocr.load_models("x"), lambda: vision.detect_regions(b""), lambda: vision.recognize_structure(b"")):
        with pytest.raises(DocError):
            f()
