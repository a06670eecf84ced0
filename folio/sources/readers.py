"""Readers of file contents: listings, plain text, archive manifests and Office documents.

Each takes rows ``(path, content)``, as Spark's ``binaryFile`` source gives them, and works one file at a time inside the
tasks that hold it, so memory is bounded by one file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.detection import safe_archive_path, suspicious_ratio


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, modificationTime, length, content)`` of all files below ``folder``; a plan that drops ``content`` never reads it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def plain_text(files: DataFrame) -> DataFrame:
    """``(path, text, status)``: UTF-8 without its byte order mark; NUL or invalid bytes fail with a null text."""
    raw = F.col("content")
    body = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, F.lit(4), F.length(raw))).otherwise(raw)
    rows = files.select("path", F.try_validate_utf8(body.cast("string")).alias("text"))
    good = F.col("text").isNotNull() & ~F.contains("text", F.lit("\0"))
    return rows.select("path", F.when(good, F.col("text")).alias("text"), F.when(good, "success").otherwise("failed").alias("status"))


def _each_archive(batches: Iterator[pd.DataFrame], entries) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                    rows = list(entries(archive))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, RuntimeError):
                rows = [None]
            yield pd.DataFrame({"path": path, "row": pd.Series(rows, dtype=object)})


def zip_manifest(files: DataFrame) -> DataFrame:
    """``(path, entry, size, packed, safe, suspicious)``, nothing unpacked; a broken archive gives one row of nulls."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _each_archive(batches, lambda a: [(i.filename, i.file_size, i.compress_size) for i in a.infolist()]):
            cells = [r or (None, None, None) for r in part["row"]]
            yield pd.DataFrame({"path": part["path"], **{n: pd.Series([c[k] for c in cells], dtype=t) for k, (n, t) in enumerate((("entry", object), ("size", "Int64"), ("packed", "Int64")))}})

    rows = files.select("path", "content").mapInPandas(listed, "path string, entry string, size long, packed long")
    safe = F.when(F.col("entry").isNotNull(), safe_archive_path(F.col("entry")))
    return rows.withColumns({"safe": safe, "suspicious": suspicious_ratio(F.col("size"), F.col("packed"))})


def archive_safety(manifest: DataFrame) -> DataFrame:
    """``(path, entries, unsafe, suspicious, bytes, status)`` of each archive of a manifest."""
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    found = manifest.groupBy("path").agg(
        F.count("entry").alias("entries"), flag(~F.col("safe"))("unsafe"), flag(F.col("suspicious"))("suspicious"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.bool_or(F.col("entry").isNull()).alias("_broken"),
    )
    status = F.when(F.col("_broken"), "failed").when((F.col("unsafe") > 0) | (F.col("suspicious") > 0), "partial").otherwise("success")
    return found.withColumn("status", status).drop("_broken")


PARTS = {"docx": r"^word/document\.xml$", "pptx": r"^ppt/slides/slide(\d+)\.xml$", "xlsx": r"^xl/worksheets/sheet(\d+)\.xml$"}
SHARED = "xl/sharedStrings.xml"


def _paragraphs(root: ElementTree.Element) -> Iterator[str]:
    """Text of each paragraph; runs join without a gap."""
    for node in root.iter():
        if node.tag.rpartition("}")[2] == "p":
            text = "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == "t")
            if text.strip():
                yield text


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    """Texts that cells refer to by number."""
    root = ElementTree.fromstring(archive.read(SHARED))
    return ["".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")) for item in root]


def _cells(root: ElementTree.Element, shared: list[str]) -> Iterator[str]:
    """Values of a sheet's cells in order; formulas are skipped, their stored values kept."""
    for cell in (n for n in root.iter() if n.tag.rpartition("}")[2] == "c"):
        inner = {n.tag.rpartition("}")[2]: n.text or "" for n in cell.iter()}
        value = inner.get("v", inner.get("t", ""))
        if cell.get("t") == "s" and value.isdigit() and int(value) < len(shared):
            value = shared[int(value)]
        if value.strip():
            yield value


def office_text(files: DataFrame, kind: str) -> DataFrame:
    """``(path, part, text)`` of docx, pptx (a row per slide, in slide order) or xlsx files (a row per sheet); a broken file has a null text."""
    pattern = re.compile(PARTS[kind])

    def parts(archive: zipfile.ZipFile) -> Iterator[tuple[int, str]]:
        named = archive.namelist()
        held = sorted((int((m.groups() or ("0",))[0]), n) for n in named if (m := pattern.match(n)))
        shared = _shared_strings(archive) if kind == "xlsx" and SHARED in named else []
        for number, name in held:
            root = ElementTree.fromstring(archive.read(name))
            yield number, "\n".join(_cells(root, shared) if kind == "xlsx" else _paragraphs(root))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _each_archive(batches, parts):
            cells = [r or (0, None) for r in part["row"]]
            yield pd.DataFrame({"path": part["path"], "part": [c[0] for c in cells], "text": pd.Series([c[1] for c in cells], dtype=object)})

    return files.select("path", "content").mapInPandas(read, "path string, part long, text string")
