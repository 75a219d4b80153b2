"""Text functions as column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kana, CJK ideographs (extension A and base), compatibility ideographs, Hangul syllables.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"


def index_text(col: Column | str) -> Column:
    """Lower case; every CJK character a token of its own; other runs of letters and digits; single blanks."""
    c = F.regexp_replace(F.lower(F.translate(F.coalesce(col, F.lit("")), "İ", "i")), f"([{CJK}])", " $1 ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def tokens(col: Column | str) -> Column:
    return F.filter(F.split(index_text(col), " "), lambda t: t != "")


def sentences(col: Column | str) -> Column:
    """Sentences with their end signs, trimmed; empty ones dropped."""
    found = F.regexp_extract_all(col if isinstance(col, Column) else F.col(col), F.lit(r"([^.!?。！？；;\n]+[.!?。！？；;]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def windows(col: str, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` characters; the last reaches the end of the text."""
    step = size - overlap
    count = f"CASE WHEN length({col}) <= {size} THEN 1 ELSE CAST(ceil((length({col}) - {size}) / {step}) AS INT) + 1 END"
    return F.expr(f"transform(sequence(0, {count} - 1), i -> substring({col}, i * {step} + 1, {size}))")


def snippet(text: str, term: Column, before: int = 40, width: int = 160) -> Column:
    """The text around the first place of ``term`` with dots where it was cut; null without one."""
    at = F.call_function("locate", term, F.lower(F.col(text)))
    start = F.greatest(F.lit(1), at - before)
    body = F.col(text).substr(start, F.lit(width))
    left = F.when(start > 1, "…").otherwise("")
    right = F.when(start + width - 1 < F.length(text), "…").otherwise("")
    return F.when(at > 0, F.concat(left, body, right))


def gram_rows(df: DataFrame, keep: list[str], col: str, n: int = 3, size: int = 512) -> DataFrame:
    """A row (keep, gram) for every run of ``n`` characters of the lower-case text with single blanks.

    Texts are cut into overlapping stretches first, so that the work is linear in
    their length; the generators keep the optimizer from repeating the folding.
    """
    flat = F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(col, F.lit("")), "İ", "i")), r"[ \t\r\n]+", " "))
    flats = df.select(*keep, F.explode(F.array(flat)).alias("_flat")).where(F.length("_flat") >= n)
    cut = F.expr(f"transform(sequence(0, CAST((length(_flat) - {n}) DIV {size} AS INT)), i -> substring(_flat, i * {size} + 1, {size + n - 1}))")
    cuts = flats.select(*keep, F.explode(cut).alias("_cut"))
    return cuts.select(*keep, F.explode(F.expr(f"transform(sequence(1, length(_cut) - {n - 1}), i -> substring(_cut, i, {n}))")).alias("gram"))


def gram_bucket(gram: Column, dim: int) -> Column:
    """Bucket of a run in a hashed vector."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def gram_sign(gram: Column) -> Column:
    return F.when(F.substring(F.md5(gram), 9, 1).isin("1", "3", "5", "7", "9", "b", "d", "f"), 1).otherwise(-1)


#: English words and Chinese characters that are no keywords.
EN_STOP = (
    "the", "and", "of", "to", "in", "is", "are", "was", "for", "on", "with", "a", "an", "this", "that", "it", "as", "be", "by", "or", "from", "at",
    "not", "we", "you", "your", "can", "will", "if", "then", "than", "so", "there", "here", "what", "which", "into", "about", "their", "they",
    "have", "has", "had", "but", "its", "our", "these", "those", "when",
)
ZH_STOP = "的了是在和与及对中为等我这那也就都不有个人大小上下之一吗呢吧啊很要"


def keyword_terms(col: Column | str) -> Column:
    """Terms that may be keywords, in order: words of two or more letters or digits, then pairs of neighbouring CJK characters; no stop words, no numbers."""
    low = F.lower(F.translate(F.coalesce(col, F.lit("")), "İ", "i"))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9]{2,})"), F.lit(1)), lambda w: ~w.isin(*EN_STOP) & ~w.rlike("^[0-9]+$"))
    pairs = F.filter(F.regexp_extract_all(low, F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1)), lambda p: ~p.rlike(f"[{ZH_STOP}]"))
    return F.concat(words, pairs)


def keyword_counts(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, term, n, first): how often a term stands in a text, and the place of its first one."""
    t = df.select(id_col, F.posexplode(keyword_terms(col)).alias("pos", "term"))
    return t.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def index_terms(folded: str) -> Column:
    """What a query may ask for in a column of ``index_text``: every token, and every two or three neighbouring CJK tokens as one term with blanks."""
    none = F.array().cast("array<string>")
    words = F.when(F.col(folded) != "", F.split(folded, " ")).otherwise(none)
    text = F.concat(F.lit(" "), folded, F.lit(" "))
    runs = [F.regexp_extract_all(text, F.lit(f"(?<= )(?=([{CJK}](?: [{CJK}]){{{k}}}) )"), F.lit(1)) for k in (1, 2)]
    return F.when(F.col(folded).rlike(f"[{CJK}]"), F.concat(words, *runs)).otherwise(words)


def segments(col: Column | str) -> Column:
    """Runs of CJK characters and runs of other letters and digits of a query, in order."""
    low = F.lower(F.translate(F.coalesce(col, F.lit("")), "İ", "i"))
    return F.regexp_extract_all(low, F.lit(f"([{CJK}]+|(?:(?![{CJK}])[\\p{{L}}\\p{{N}}])+)"), F.lit(1))


def code_outline(col: Column | str, limit: int = 12) -> Column:
    """The first distinct signatures of functions and types of a program text, joined; empty without any."""
    sign = (
        r"^\s*(?:(?:async\s+)?def\s+\w+|class\s+\w+|(?:export\s+)?(?:async\s+)?function\s+\w+|(?:pub\s+)?fn\s+\w+|func\s+\w+|type\s+\w+|interface\s+\w+"
        r"|(?:public|private|protected)[\w\s<>\[\]]*\s+\w+\s*\()"
    )
    lines = F.filter(F.split(F.coalesce(col, F.lit("")), "\\r\\n|\n|\r"), lambda x: x.rlike(sign))
    lines = F.array_distinct(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"[:{\s]+$", "")))
    return F.array_join(F.transform(F.slice(F.filter(lines, lambda x: x != ""), 1, limit), lambda x: F.substring(x, 1, 120)), "；")


def title(path: Column | str, col: Column | str) -> Column:
    """The heading that a text begins with, else the file's name without extension; at most 100 characters."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    head = F.trim(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*#+([^\n\r]*)", 1))
    return F.substring(F.when(head != "", head).otherwise(stem), 1, 100)


def merged_paragraphs(df: DataFrame, id_col: str, col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(id, no, piece): paragraphs joined by line breaks while they fit into ``size``; longer ones in overlapping windows.

    A paragraph joins the ones before it as long as all fit, which depends on
    where the last piece began; so each text is folded from left to right.
    """
    if size <= overlap:
        overlap = max(0, size // 5)
    paras = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = df.select(id_col, F.explode(F.array(paras)).alias("_paras"))
    fold = f"""aggregate(_paras, named_struct('done', cast(array() as array<string>), 'buf', ''), (s, p) -> CASE
      WHEN length(p) > {size} THEN named_struct('done', concat(s.done, CASE WHEN s.buf <> '' THEN array(s.buf) ELSE cast(array() as array<string>) END, array(p)), 'buf', '')
      WHEN s.buf = '' THEN named_struct('done', s.done, 'buf', p)
      WHEN length(s.buf) + length(p) + 1 <= {size} THEN named_struct('done', s.done, 'buf', concat(s.buf, '\n', p))
      ELSE named_struct('done', concat(s.done, array(s.buf)), 'buf', p) END,
      s -> CASE WHEN s.buf <> '' THEN concat(s.done, array(s.buf)) ELSE s.done END)"""
    pieces = rows.select(id_col, F.posexplode(F.expr(fold)).alias("_at", "_piece"))
    cut = pieces.select(id_col, "_at", F.posexplode(windows("_piece", size, overlap)).alias("_sub", "piece"))
    order = Window.partitionBy(id_col).orderBy("_at", "_sub")
    return cut.select(id_col, (F.row_number().over(order) - 1).alias("no"), "piece")
