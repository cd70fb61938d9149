"""Documents from files: txt, docx, and pdf where a library for it is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import DependencyError, ValidationError
from brindle.functions.text import strip
from brindle.runtime import settle, workers_see_package

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
KINDS = (".txt", ".docx", ".pdf")


def docx_text(content: bytes) -> str:
    """Non-empty stripped paragraphs of the document's body, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = ("".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in p.iter()).strip() for p in body.findall(f"{_W}p"))
    return "\n".join(x for x in lines if x)


def pdf_text(content: bytes) -> str:
    try:
        import fitz
    except ImportError as e:
        raise DependencyError("reading pdf files needs PyMuPDF") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc).strip()


def parsed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``path, suffix, text, reason`` of each file: its text, or why it has none (another kind, not UTF-8, for docx and pdf
    no text or not readable). A byte order mark stays in the text. A file is read once, by the task that parses it."""
    workers_see_package(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))
    plain = files.where("suffix not in ('.docx', '.pdf')")
    text, utf8 = F.col("content").cast("string"), F.is_valid_utf8(F.col("content").cast("string"))
    reason = F.when(F.col("suffix") != ".txt", "unsupported file").when(~utf8, "not UTF-8")
    plain = plain.select("path", "suffix", F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [_parsed(s, bytes(c)) for s, c in zip(part["suffix"], part["content"])]
            yield pd.DataFrame({"path": part["path"], "suffix": part["suffix"], "text": [t for t, _ in rows], "reason": [r for _, r in rows]})

    rich = files.where("suffix in ('.docx', '.pdf')").select("path", "suffix", "content").mapInPandas(parse, "path string, suffix string, text string, reason string")
    return plain.unionByName(rich)


def _parsed(suffix: str, content: bytes) -> tuple[str | None, str | None]:
    try:
        text = (docx_text if suffix == ".docx" else pdf_text)(content)
    except Exception as e:  # whatever a broken file makes its reader raise
        return None, f"not readable: {e}"
    return (text, None) if text else (None, "no text")


def load_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``path, suffix, text`` of each file. A file without a text raises when it is read (``load_or_reject`` goes on)."""
    failed = F.raise_error(F.concat("reason", F.lit(": "), "path"))
    return parsed(spark, paths).select("path", "suffix", F.when(F.col("reason").isNull(), F.col("text")).otherwise(failed).alias("text"))


def load_or_reject(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """``path, suffix, text`` of the files that have one, and ``path, reason`` of the others: one pass over the files,
    which is written to the shared folder, so that either can be read without the other."""
    rows = settle(parsed(spark, paths))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "reason")


def ingest_files(spark: SparkSession, ids: dict[str, str]) -> DataFrame:
    """Documents (doc_id, text, metadata) from files: ``ids`` has the id of each path, which may be relative or
    without a scheme. Empty ids, paths or texts raise; so does a path that is a folder or a pattern."""
    if any(not k.strip() or not v.strip() for k, v in ids.items()):
        raise ValidationError("doc_id and path must not be empty")
    conf = spark._jsc.hadoopConfiguration()

    def full(path: str) -> str:  # as the scan reports it
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).makeQualified(at).toString()

    names = spark.createDataFrame([(full(k), v) for k, v in ids.items()], "path string, doc_id string")
    rows = load_documents(spark, list(ids)).join(F.broadcast(names), "path", "left")  # a row for each path that was given
    text = strip(F.col("text"))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), "path"))
    return rows.select(F.coalesce("doc_id", fail("no id for")).alias("doc_id"), F.when(text != "", text).otherwise(fail("empty document")).alias("text"), F.lit(None).cast("map<string,string>").alias("metadata"))
