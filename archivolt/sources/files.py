"""Files of a folder tree as rows: address, kind and text of each."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.kinds import decoded, extension, sniffed

#: Folders that are never read.
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv")


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, size, mtime, ext, kind, digest, content) of every file below ``root``; dot-folders and excluded names are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})")
    parts = F.split(below, "/")
    hidden = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.startswith(".") | p.isin(*excluded))
    ext = extension("path")
    return files.where(~hidden).select(
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        ext.alias("ext"),
        sniffed(ext, F.col("content")).alias("kind"),
        F.sha2("content", 256).alias("digest"),
        "content",
    )


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or differ from ``known`` (path, size, mtime) in size or time."""
    same = known.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    out = files.join(same, "path", "left")
    return out.where(F.col("_size").isNull() | (F.col("size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime"))).drop("_size", "_mtime")


def read_text(files: DataFrame, max_bytes: int = 262_144) -> DataFrame:
    """Adds ``text`` and ``truncated`` to rows of kind text or code; null for other kinds.

    At most ``max_bytes`` are decoded: UTF-8, else GB 18030, else with replacement
    signs; a character that the limit cuts is left out.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, cut = [], []
            for kind, content in zip(b["kind"], b["content"], strict=True):
                if kind not in ("text", "code"):
                    texts.append(None)
                    cut.append(None)
                    continue
                raw = bytes(content[:max_bytes])
                cut.append(len(content) > max_bytes)
                text = decoded(raw, not cut[-1])
                texts.append(raw.decode("utf-8", "replace") if text is None else text)
            yield b.assign(text=texts, truncated=pd.Series(cut, dtype="boolean", index=b.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(decode, f"{schema}, text string, truncated boolean")


def notebook_text(col: str = "content") -> Column:
    """The sources of a notebook's cells in order, blank lines between; outputs are left out, null for no notebook."""
    cell = "struct<cell_type: string, source: array<string>>"
    cells = F.from_json(F.col(col).cast("string"), f"struct<cells: array<{cell}>>")["cells"]
    return F.array_join(F.filter(F.transform(cells, lambda c: F.trim(F.array_join(c["source"], ""))), lambda t: t != ""), "\n\n")


#: Where office files keep their text.
OFFICE_PARTS = r"^(word/document|ppt/slides/slide\d+|xl/sharedStrings|content)\.xml$"


def office_text(files: DataFrame) -> DataFrame:
    """(path, text) of zipped office files: the text of their XML parts, a line for each paragraph; files that can't be read have null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for content in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        parts = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if re.match(OFFICE_PARTS, n)]
                    lines = [re.sub(r"<[^>]+>", "", p) for part in parts for p in re.split(r"</(?:w:p|a:p|si|text:p)>", part)]
                    texts.append("\n".join(html.unescape(x.strip()) for x in lines if x.strip()))
                except (zipfile.BadZipFile, KeyError, RuntimeError):
                    texts.append(None)
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return files.select("path", "content").mapInPandas(read, "path string, text string")


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; lines that are no JSON are left out."""
    lines = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where("_bad is null").drop("_bad")
