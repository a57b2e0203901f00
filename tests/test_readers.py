"""Readers as table functions."""

import pytest

from trackweave.operators.readers import digit_runs, loaded, read_crops, wanted_readers


@pytest.mark.parametrize("name, names, together", [
    ("mmocr_easyocr", ["mmocr", "easyocr", "pytesseract"], True), ("mmocr,easyocr", ["mmocr", "easyocr"], True), ("mmocr_rec+easyocr", ["mmocr_rec", "easyocr"], False), ("mmocr-fallback", ["mmocr", "easyocr", "pytesseract"], False),
    ("mmocr+easyocr", ["mmocr", "easyocr", "pytesseract"], True), ("paddleocr", ["paddleocr"], False), ("paddle_ocr", ["paddleocr"], False), ("paddleocr+easyocr", ["paddleocr", "easyocr", "pytesseract"], False), (None, ["easyocr", "pytesseract"], False), (" Mine, mmocr-recognition,", ["mine", "mmocr_rec"], True), ("mine", ["mine"], False),
])
def test_names(name, names, together):
    assert wanted_readers(name) == (names, together)


def broken():
    raise ImportError("not installed")


def test_loading():
    readers = {"a": broken, "b": digit_runs, "c": digit_runs}
    ready, attempts = loaded(readers, ["a", "x", "b", "c"], False)
    assert list(ready) == ["b"] and [(a["reader"], a["status"]) for a in attempts] == [("a", "failed"), ("x", "failed"), ("b", "ok")] and attempts[0]["message"] == "a: ImportError: not installed"
    assert list(loaded(readers, ["a", "b", "c"], True)[0]) == ["b", "c"]


def test_reading(spark):
    def picky():
        def read(text):
            if "!" in text:
                raise ValueError("odd picture")
            return [(text.upper(), 0.5)]

        return read

    crops = spark.createDataFrame([(1, "a 12 7"), (2, "!5"), (3, None), (4, "")], "crop int, picture string")
    def missing():  # defined here, as workers can't import this file
        raise ImportError("not installed")

    readers = {"picky": picky, "digits": digit_runs, "broken": missing}
    seen = lambda wanted: sorted((r["crop"], r["reading"], r["source"], r["text"], r["channel"], r["error"]) for r in read_crops(crops, "picture", readers, wanted).collect())
    assert seen("broken,picky,digits") == [
        (1, 0, "picky", "A 12 7", None, None), (1, 1, "digits", "12", "detected", None), (1, 2, "digits", "7", "detected", None),
        (2, 0, "picky", None, None, "ValueError: odd picture"), (2, 1, "digits", "5", "detected", None), (4, 0, "picky", "", None, None),
    ]
    assert [x[2:4] for x in seen("broken+digits+picky")] == [("digits", "12"), ("digits", "7"), ("digits", "5")]
    assert [x[:2] + x[5:] for x in seen("broken")] == [(c, 0, "broken: ImportError: not installed") for c in (1, 2, 4)]
