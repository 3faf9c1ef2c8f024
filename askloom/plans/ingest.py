"""Documents to index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from typing import Callable

from askloom.operators.chunk import chunk_ids, chunk_pages
from askloom.operators.embed import embed_text
from askloom.operators.index import index_status, upsert_index, work_list
from askloom.sources.files import drop_short_pages, extract_pages, with_fingerprint
from askloom.functions.text import file_name
from askloom.session import checkpointed

INDEX_COLUMNS = ["id", "source", "filename", "page", "chunk_idx", "text", "file_hash", "embedding"]
INDEX_SCHEMA = ("id string, source string, filename string, page int, chunk_idx int, text string, "
                "file_hash string, embedding array<float>")


def index_rows(documents: DataFrame, embed: Callable[[str], Column] | None = embed_text,
               carry: list[str] = ()) -> DataFrame:
    """``source, content`` -> index rows. Narrow all the way: no row leaves its task.

    ``embed`` takes the text column's name and returns the vector; ``None`` leaves it out.
    """
    hashed = with_fingerprint(documents.select("source", "content", *carry)).drop("doc_hash")
    pages = drop_short_pages(extract_pages(hashed))
    rows = chunk_ids(chunk_pages(pages)).withColumn("filename", file_name("source"))
    if embed is None:
        return rows.select(*[c for c in INDEX_COLUMNS if c != "embedding"], *carry)
    return rows.withColumn("embedding", embed("text")).select(*INDEX_COLUMNS, *carry)


def ingest_documents(documents: DataFrame, index: DataFrame, manifest: DataFrame,
                     order: str = "seq") -> DataFrame:
    """The index after the new and changed ones of ``documents`` (``source, content, seq``) came in."""
    status = index_status(with_fingerprint(documents), manifest)
    # the merge reads the new rows three times, so they are cut once and kept
    rows = checkpointed(index_rows(work_list(status), carry=[order]), documents.sparkSession)
    return upsert_index(index, rows, order)
