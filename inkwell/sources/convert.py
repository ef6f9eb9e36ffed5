"""Files to Markdown: detection, conversion, and the same over DataFrames.

Failures are rows with an error, never a failed job.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import delimited, html, legacy, packages, pdf, rtf
from .model import Block, ConvertError, Run, escape, render

CONVERTED = "doc_id string, format string, markdown string, error_code string, error string"
#: Endings by which a format is told where the bytes do not say it.
ENDINGS = {"csv": "csv", "tsv": "csv", "txt": "csv", "html": "html", "htm": "html", "xhtml": "html", "rtf": "rtf", "pdf": "pdf", "docx": "docx", "docm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "pptm": "pptx", "odt": "odt", "ods": "ods", "odp": "odp", "epub": "epub", "doc": "doc", "xls": "xls", "ppt": "ppt"}
MEDIA = {b"application/vnd.oasis.opendocument.text": "odt", b"application/vnd.oasis.opendocument.spreadsheet": "ods", b"application/vnd.oasis.opendocument.presentation": "odp", b"application/epub+zip": "epub"}


def detect(data: bytes, name: str = "") -> str | None:
    """The format by the bytes first and the name's ending second, or None."""
    ending = ENDINGS.get(name.rpartition(".")[2].lower())
    if data.lstrip()[:5] == b"{\\rtf":
        return "rtf"
    if b"%PDF-" in data[:1024]:
        return "pdf"
    if data[:4] == b"PK\x03\x04":
        try:
            names = zipfile.ZipFile(io.BytesIO(data))
            listed = set(names.namelist())
            kind = names.read("mimetype").strip() if "mimetype" in listed else b""
        except (zipfile.BadZipFile, OSError, KeyError, RuntimeError, ValueError):
            return ending
        for prefix, found in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if any(n.lower().startswith(prefix) for n in listed):
                return found
        return MEDIA.get(kind) or ("epub" if "META-INF/container.xml" in listed else ending)
    if data[:8] == legacy.SIGNATURE:
        try:
            return legacy.kind_of(data) or ending
        except (ConvertError, struct.error):
            return ending
    start = data[:512].lstrip().lower()
    if start.startswith((b"<!doctype html", b"<html")):
        return "html"
    return ending


def blocks(data: bytes, kind: str | None) -> list[Block]:
    readers = {"csv": delimited.read, "html": html.read, "rtf": rtf.read, "pdf": pdf.read, "doc": legacy.read_doc, "xls": legacy.read_xls, "ppt": legacy.read_ppt}
    if kind in readers:
        return readers[kind](data)
    if kind in ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"):
        package = packages.Package(data)
        if kind == "docx":
            return packages.Word(package).read()
        return {"xlsx": packages.read_xlsx, "pptx": packages.read_pptx, "epub": packages.read_epub}.get(kind, packages.read_odf)(package)
    raise ConvertError("unsupported", f"no reader for {kind or 'this file'}")


def markdown(data: bytes, name: str = "") -> tuple[str | None, str]:
    """(format, Markdown) of one file."""
    kind = detect(data, name)
    found = blocks(data, kind)
    notes = [b for b in found if b.kind == "note"]
    text = render([b for b in found if b.kind != "note"])
    if notes:
        text += "\n" + "\n".join(f"[^{b.level}]: {escape(''.join(r.text for r in b.runs))}" for b in notes) + "\n"
        for b in notes:
            text = text.replace(f"\\[^{b.level}]", f"[^{b.level}]")
    return kind, text


def convert(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """``CONVERTED`` for each row: works on binaryFile frames, batch or streaming."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["doc_id"], batch["content"]):
                try:
                    kind, text = markdown(bytes(data or b""), name or "")
                    rows.append((name, kind, text, None, None))
                except ConvertError as e:
                    rows.append((name, detect(bytes(data or b""), name or ""), None, e.code, str(e)))
                except Exception as e:  # a reader's fault is that file's error
                    rows.append((name, None, None, "malformed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "format", "markdown", "error_code", "error"])

    some = files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    return some.mapInPandas(run, CONVERTED)


def inspect_pdf(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(doc_id, pages, text_pages, image_pages, kind, confidence, ocr_pages, error_code);
    ocr_pages counts from 1 and names pages whose text may need recognition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["doc_id"], batch["content"]):
                try:
                    rows.append({"doc_id": name, **pdf.inspect(bytes(data or b"")), "error_code": None})
                except ConvertError as e:
                    rows.append({"doc_id": name, "pages": 0, "text_pages": 0, "image_pages": 0, "kind": None, "confidence": 0.0, "ocr_pages": [], "error_code": e.code})
            yield pd.DataFrame(rows, columns=["doc_id", "pages", "text_pages", "image_pages", "kind", "confidence", "ocr_pages", "error_code"])

    some = files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    return some.mapInPandas(run, "doc_id string, pages int, text_pages int, image_pages int, kind string, confidence double, ocr_pages array<int>, error_code string")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder, converted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return convert(files)


def html_pages(pages: DataFrame, id_col: str, html_col: str, rendered: bool = True) -> DataFrame:
    """(doc_id, blocks) for each row: the blocks of an HTML text in order, as an array of
    structs (kind, level, text, markdown); null for none.  Markdown, which takes most of
    the time, is null unless ``rendered``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [None if t is None else [{"kind": b.kind, "level": b.level, "text": "".join(r.text for r in b.runs), "markdown": render([b]) if rendered else None} for b in html.read_text(t)] for t in batch["html"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "blocks": found})

    some = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).cast("string").alias("html"))
    kind = some.schema["doc_id"].dataType.simpleString()
    return some.mapInPandas(run, f"doc_id {kind}, blocks array<struct<kind:string,level:int,text:string,markdown:string>>")


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc_id, ord, kind, level, text, markdown) of the blocks of HTML texts."""
    return html_pages(pages, id_col, html_col).select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "ord", "b.*")


def register(spark: SparkSession) -> None:
    """SQL functions: to_markdown(content, name), detect_format(content, name) and
    md_escape(text).  Files that cannot be read give null."""
    from pyspark.sql.types import StringType

    def safe(function, *values):
        try:
            return function(*values)
        except Exception:  # as in ``convert``: one file's fault is its own
            return None

    @F.pandas_udf(StringType())
    def to_markdown(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([safe(lambda c, n: markdown(bytes(c), n or "")[1], c, n) for c, n in zip(content, name)])

    @F.pandas_udf(StringType())
    def detect_format(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([safe(lambda c, n: detect(bytes(c), n or ""), c, n) for c, n in zip(content, name)])

    @F.pandas_udf(StringType())
    def md_escape(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else escape(t, True) for t in text])

    for name, function in (("to_markdown", to_markdown), ("detect_format", detect_format), ("md_escape", md_escape)):
        spark.udf.register(name, function)


__all__ = ["Block", "Run", "convert", "detect", "html_blocks", "html_pages", "inspect_pdf", "markdown", "read_files", "register"]
