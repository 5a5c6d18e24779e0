"""DOCX and PPTX files, read from their XML parts."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.sources.files import extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RESULT_TYPE = T.StructType(
    [
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("number", T.IntegerType()),
                        T.StructField("text", T.StringType()),
                        T.StructField("extractor", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)
_RESULT = pa.struct(
    [
        (
            "pages",
            pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string()), ("extractor", pa.string())])),
        ),
        ("error", pa.string()),
    ]
)


def _text(node, run: str, breaks: dict[str, str]) -> str:
    parts = []
    for item in node.iter():
        if item.tag == run:
            parts.append(item.text or "")
        elif item.tag in breaks:
            parts.append(breaks[item.tag])
    return "".join(parts)


def _word_text(paragraph) -> str:
    return _text(paragraph, _W + "t", {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"})


def _row(cells: list[str]) -> str:
    return " | ".join(c.strip() for c in cells if c.strip())


def _word_rows(table) -> list[str]:
    """Table rows as 'a | b'; a cell that spans columns or rows counts once per place."""
    rows, above = [], []
    for row in table.findall(_W + "tr"):
        cells = []
        for cell in row.findall(_W + "tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_word_text(p) for p in cell.findall(_W + "p"))
            if merge is not None and merge.get(_W + "val", "continue") == "continue" and len(above) > len(cells):
                text = above[len(cells)]
            cells += [text] * int(span.get(_W + "val", "1") if span is not None else "1")
        above = cells
        rows.append(_row(cells))
    return [r for r in rows if r]


def docx_pages(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(_W + "body")
    texts = [t for t in (_word_text(p) for p in body.findall(_W + "p")) if t.strip()]
    for table in body.findall(_W + "tbl"):
        texts += _word_rows(table)
    text = "\n\n".join(texts)
    return [{"number": 1, "text": text, "extractor": "docx-xml"}] if text.strip() else []


def _slide_text(frame) -> str:
    return "\n".join(_text(p, _A + "t", {_A + "br": "\v"}) for p in frame.findall(_A + "p"))


def pptx_pages(content: bytes) -> list[dict]:
    """One page per slide in presentation order; blank slides are dropped but keep their number."""
    pages = []
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        links = {
            link.get("Id"): link.get("Target")
            for link in ElementTree.fromstring(parts.read("ppt/_rels/presentation.xml.rels"))
        }
        listed = ElementTree.fromstring(parts.read("ppt/presentation.xml")).iter(_P + "sldId")
        for number, slide in enumerate(listed, start=1):
            target = posixpath.normpath(posixpath.join("ppt", links[slide.get(_R + "id")].lstrip("/")))
            target = target.replace("ppt/ppt/", "ppt/")
            tree = ElementTree.fromstring(parts.read(target)).find(f"{_P}cSld/{_P}spTree")
            texts = []
            for shape in tree:
                frame = shape.find(_P + "txBody")
                if shape.tag == _P + "sp" and frame is not None and _slide_text(frame).strip():
                    texts.append(_slide_text(frame))
                for table in shape.iter(_A + "tbl") if shape.tag == _P + "graphicFrame" else ():
                    for row in table.findall(_A + "tr"):
                        cells = [_slide_text(c.find(_A + "txBody")) for c in row.findall(_A + "tc")]
                        if _row(cells):
                            texts.append(_row(cells))
            text = "\n".join(texts)
            if text.strip():
                pages.append({"number": number, "text": text, "extractor": "pptx-xml"})
    return pages


@F.arrow_udf(_RESULT_TYPE)
def _office_pages(contents: pa.Array, kinds: pa.Array) -> pa.Array:
    results = []
    for content, kind in zip(contents.to_pylist(), kinds.to_pylist()):
        try:
            pages = docx_pages(content) if kind == "docx" else pptx_pages(content)
            results.append({"pages": pages or None, "error": None if pages else "produced no readable text."})
        except Exception as error:  # one broken file must not fail the job
            results.append({"pages": None, "error": f"could not be parsed: {error}"})
    return pa.array(results, _RESULT)


def load_office(files: DataFrame) -> DataFrame:
    loaded = files.withColumn("_r", _office_pages(F.col("content"), extension(F.col("filename"))))
    message = F.concat(F.lit("extraction failed: "), F.col("filename"), F.lit(" "), F.col("_r.error"))
    return loaded.withColumns({"pages": F.col("_r.pages"), "error": message}).drop("_r")
