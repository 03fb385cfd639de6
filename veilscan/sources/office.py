"""Text of Office files and UTF-16 text, one file per row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _name(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _lines(stream, item: str = "") -> Iterator[str]:
    """Text runs, a paragraph or table row to a line; with ``item`` each element
    of that name is a line. Elements are dropped once they are read."""
    held: list[str] = []
    for _, element in iterparse(stream):
        name = _name(element.tag)
        if name == "t":
            held.append(element.text or "")
        if name == item or (not item and name in ("p", "tr", "row")):
            yield "".join(held) + "\n"
            held.clear()
            element.clear()
    yield "".join(held)


def _rows(stream) -> Iterator[str]:
    """A worksheet's values, a row to a line, but references to shared strings."""
    for _, row in iterparse(stream):
        if _name(row.tag) != "row":
            continue
        for cell in row:
            if cell.get("t") != "s":
                yield from (f"{x.text} " for x in cell.iter() if x.text and _name(x.tag) in ("v", "t"))
        yield "\n"
        row.clear()


_PARTS = {
    "docx": ("word/document.xml", "word/header", "word/footer"),
    "pptx": ("ppt/slides/slide", "ppt/notesSlides/notesSlide"),
}


def document_text(kind: str, data: bytes) -> str:
    if kind == "utf16LE" or kind == "utf16BE":
        mark = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(bytes(data[:2]))
        encoding = mark or ("utf-16-le" if kind.endswith("LE") else "utf-16-be")
        return bytes(data[2:] if mark else data).decode(encoding, "replace")
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = sorted(archive.namelist())
        if kind == "xlsx":
            steps = [(n, lambda stream: _lines(stream, "si")) for n in names if n == "xl/sharedStrings.xml"]
            steps += [(n, _rows) for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")]
        else:
            steps = [(n, _lines) for n in names if n.startswith(_PARTS[kind]) and n.endswith(".xml")]
        for name, read in steps:
            with archive.open(name) as stream:
                out += read(stream)
            out.append("" if kind == "xlsx" else "\n")
    return "".join(out)


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_RESULT)
def office_text(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Extracted text, or why there is none.  Rows without a kind cost nothing."""
    texts, errors = [], []
    for name, data in zip(kind, content):
        text = error = None
        if name is not None and data is not None:
            try:
                text = document_text(name, data)
            except Exception as problem:  # a broken file is a finding's absence, not a failed job
                error = f"{type(problem).__name__}: {problem}"
        texts.append(text)
        errors.append(error)
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "error": pd.Series(errors, dtype=object)})
