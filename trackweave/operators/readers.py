"""Readers of crops as table functions: any class that loads once and reads pictures, joined laterally to the crops."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A loaded reader takes a picture and gives (text, confidence) or (text, confidence, channel); loading may fail.
Read = Callable[[object], Iterable[tuple]]
Load = Callable[[], Read]
#: Names that stand for several readers, and those of them that are all used together (fixed values).
LISTS = {
    "auto": ["easyocr", "pytesseract"],
    "default": ["easyocr", "pytesseract"],
    "paddleocr": ["paddleocr"],
    "paddle_ocr": ["paddleocr"],
    "paddle": ["paddleocr"],
    "paddleocr_easyocr": ["paddleocr", "easyocr", "pytesseract"],
    "paddle_ocr_easyocr": ["paddleocr", "easyocr", "pytesseract"],
    "paddleocr+easyocr": ["paddleocr", "easyocr", "pytesseract"],
    "mmocr_easyocr": ["mmocr", "easyocr", "pytesseract"],
    "mmocr+easyocr": ["mmocr", "easyocr", "pytesseract"],
    "mmocr_auto": ["mmocr", "easyocr", "pytesseract"],
    "mmocr_rec": ["mmocr_rec"],
    "mmocr_recognition": ["mmocr_rec"],
    "mmocrrec": ["mmocr_rec"],
    "mmocr_rec_easyocr": ["mmocr_rec", "easyocr", "pytesseract"],
    "mmocr_fallback": ["mmocr", "easyocr", "pytesseract"],
}
TOGETHER = {"mmocr_easyocr", "mmocr+easyocr", "mmocr_auto", "mmocr_rec_easyocr"}


def wanted_readers(name: str | None) -> tuple[list[str], bool]:
    """The readers that a name asks for, in order, and whether all of them read or only the first that loads.

    Names joined by commas all read; other names joined by + are tried in
    order. Unknown names stand for themselves.
    """
    plain = lambda x: re.sub("-", "_", x.strip().lower())
    word = plain(name or "auto") or "auto"
    if word in LISTS:
        return LISTS[word], word in TOGETHER
    parts = [p for p in map(str.strip, re.split("," if "," in word else r"\+", word)) if p]
    return [LISTS[p][0] if len(LISTS.get(p, [])) == 1 else p for p in parts], "," in word


def loaded(readers: dict[str, Load], names: list[str], together: bool) -> tuple[dict[str, Read], list[dict]]:
    """Readers that load, and an entry for each attempt: reader, status ok or failed, and why it failed."""
    ready, attempts = {}, []
    for name in names:
        try:
            if name not in readers:
                raise ValueError("no such reader")
            ready[name] = readers[name]()
        except Exception as e:  # a reader that isn't there is a recorded failure, whatever it raises
            attempts.append({"reader": name, "status": "failed", "message": f"{name}: {type(e).__name__}: {e}"})
            continue
        attempts.append({"reader": name, "status": "ok", "message": None})
        if not together:
            break
    return ready, attempts


READING = T.StructType([T.StructField("source", T.StringType()), T.StructField("reading", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("channel", T.StringType()), T.StructField("error", T.StringType())])


def read_crops(crops: DataFrame, picture: str, readers: dict[str, Load], wanted: str | None = "auto") -> DataFrame:
    """crops without their picture, with a row for each thing that a reader saw: source, reading (its place among the crop's), text, confidence, channel, error.

    Readers are loaded once for each task. Where a reader fails on a picture
    its row has the error and no text, and the others still read; where none
    loads, each crop has one row with all reasons. Crops on which nothing is
    seen, and crops without a picture, have none.
    """
    names, together = wanted_readers(wanted)

    class Reader:
        def __init__(self) -> None:
            self.ready, attempts = loaded(readers, names, together)
            self.failed = "; ".join(a["message"] for a in attempts if a["message"]) or None

        def eval(self, image) -> Iterator[tuple]:
            if image is None:
                return
            if not self.ready:
                yield None, 0, None, None, None, self.failed or "no reader"
                return
            n = 0
            for name, read in self.ready.items():
                try:
                    seen = [(str(text), float(confidence), str(*channel) if channel else None) for text, confidence, *channel in read(image)]
                except Exception as e:  # one picture that a reader can't take must not end the job
                    yield name, n, None, None, None, f"{type(e).__name__}: {e}"
                    n += 1
                    continue
                for text, confidence, channel in seen:
                    yield name, n, text, confidence, channel, None
                    n += 1

    read = F.udtf(Reader, returnType=READING)
    return crops.lateralJoin(read(F.col(picture).outer())).drop(picture)


def digit_runs() -> Read:
    """A reader of texts: their runs of digits, with the share of the text that each makes up as its confidence."""
    return lambda text: [(run, len(run) / len(text), "detected") for run in re.findall("[0-9]+", text)]
