"""Listing sources, fingerprints, and turning raw documents into pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.functions.text import file_name, has_extension, strip_ws

SHORT_HASH = 8
MIN_PAGE_CHARS = 20
PAGE_BREAK = "\f"

# Entities that are replaced after the tags are gone; the ampersand comes last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&amp;", "&"),
]


def scan_directory(spark: SparkSession, path: str, ext: str = ".pdf",
                   ignore_case: bool = True) -> DataFrame:
    """Files directly in ``path`` with the extension, with their bytes' fingerprint."""
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)  # read no other file
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{any_case}").load(path)
    return with_fingerprint(
        scan_sources(files.withColumnRenamed("path", "source"), ext, ignore_case), "content")


def scan_sources(df: DataFrame, ext: str = ".pdf", ignore_case: bool = True) -> DataFrame:
    """Keep the sources with one extension and add the file name."""
    return df.filter(has_extension("source", ext, ignore_case)).withColumn(
        "filename", file_name("source"))


def with_fingerprint(df: DataFrame, content: str = "content") -> DataFrame:
    """md5 of the content, and its first characters as the short document hash."""
    return df.withColumn("file_hash", F.md5(F.col(content))).withColumn(
        "doc_hash", F.substring("file_hash", 1, SHORT_HASH))


def html_to_text(html) -> Column:
    """Drop comments, scripts, styles and tags, replace entities, collapse blanks."""
    t = F.col(html) if isinstance(html, str) else html
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:/p|br|/h[1-6]|/li|/div)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip_ws(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def extract_pages(df: DataFrame, text: str = "content", page_break: str = PAGE_BREAK) -> DataFrame:
    """One row per page, numbered from 1, in place of the text column."""
    keep = [c for c in df.columns if c != text]
    # the outer form: for the inner one the optimizer adds a filter that makes the text once more
    return df.select(
        *keep, F.posexplode_outer(F.split(F.col(text), page_break)).alias("_at", "text")
    ).filter(F.col("text").isNotNull()).select(*keep, (F.col("_at") + 1).alias("page"), "text")


def drop_short_pages(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Skip pages with too little text; page numbers stay as they are."""
    return pages.filter(F.length(strip_ws("text")) >= min_chars)
