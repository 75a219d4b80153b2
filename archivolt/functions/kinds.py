"""Kind of a file by its name and by its first bytes."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Extensions by kind, in order of precedence.
EXTENSIONS = {
    "model": ("safetensors", "gguf", "pt", "pth", "onnx", "ckpt", "tflite",),
    "office": ("docx", "xlsx", "pptx", "odt", "ods", "odp",),
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "tif", "svg", "ico", "heic", "avif",),
    "audio": ("mp3", "wav", "flac", "ogg", "m4a", "aac", "opus", "wma",),
    "video": ("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v", "ts",),
    "text": ("txt", "md", "markdown", "rst", "log", "csv", "tsv", "json", "yaml", "yml", "toml", "ini", "cfg", "conf", "html", "htm", "xml", "srt", "ass", "tex", "bib", "properties",),
    "code": ("py", "js", "ts", "tsx", "jsx", "c", "h", "cpp", "hpp", "cc", "java", "kt", "go", "rs", "rb", "php", "sh", "bash", "zsh", "ps1", "bat", "sql", "r", "lua", "pl", "swift", "scala", "vim", "cmake", "make", "mk", "proto", "graphql", "vue", "css", "scss", "less", "ipynb",),
}
#: Extensions that hold code when their content is text.
CODE_IF_TEXT = ("ts", "m", "rs", "pl", "cls")
#: First bytes and the kind they show.
MAGIC = (
    (b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "image"), (b"\xff\xd8\xff", "image"), (b"GIF87a", "image"), (b"GIF89a", "image"), (b"BM", "image"),
    (b"ID3", "audio"), (b"OggS", "audio"), (b"fLaC", "audio"), (b"\x1aE\xdf\xa3", "video"), (b"PK\x03\x04", "archive"), (b"\x1f\x8b", "archive"),
    (b"7z\xbc\xaf'\x1c", "archive"),
)
#: The boxes that MPEG-4 files begin with after their length.
BOXES = (b"ftypisom", b"ftypmp42", b"ftypM4V ", b"ftypqt  ")
HEAD = 4096


def extension(path: Column | str) -> Column:
    """Lower-case extension without the dot; empty for none and for dot-files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?\.([^./]*)$", 1))


def kind_of(ext: Column) -> Column:
    out = F.lit("binary")
    for kind, names in reversed(EXTENSIONS.items()):
        out = F.when(ext.isin(*names), "text" if kind == "office" else kind).otherwise(out)
    return out


def decoded(raw: bytes, whole: bool) -> str | None:
    """UTF-8 or else GB 18030 text; a character cut at the end doesn't count where the bytes aren't ``whole``."""
    for coding in ("utf-8", "gb18030"):
        try:
            return codecs.getincrementaldecoder(coding)().decode(raw, final=whole)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(BooleanType())
def is_text(head: pd.Series) -> pd.Series:
    return head.map(lambda h: h is not None and decoded(bytes(h), len(h) < HEAD) is not None)


def sniffed(ext: Column, content: Column) -> Column:
    """The kind shown by the content where it says more than the name: magic bytes, NUL bytes, readable text."""
    binary = lambda b: F.lit(bytearray(b))
    named = kind_of(ext)
    head = F.substring(content, 1, HEAD)
    text = F.when(named.isin("text", "code"), named).when(ext.isin(*CODE_IF_TEXT), "code").otherwise("text")
    nul = F.contains(head, binary(b"\0"))
    out = F.when(nul, F.when(named.isin("image", "audio", "video", "pdf"), named).otherwise("binary")).when(is_text(head), text).otherwise(named)
    riff = F.startswith(head, binary(b"RIFF"))
    out = F.when(riff, F.when(F.substring(content, 9, 4) == binary(b"WAVE"), "audio").otherwise("video")).otherwise(out)
    box = F.substring(content, 5, 8)
    for sign in BOXES:
        out = F.when(box == binary(sign), "video").otherwise(out)
    for magic, kind in reversed(MAGIC):
        out = F.when(F.startswith(head, binary(magic)), kind).otherwise(out)
    keep = (named == "model") | ext.isin(*EXTENSIONS["office"]) | (F.length(content) == 0)
    return F.when(keep, named).otherwise(out)
