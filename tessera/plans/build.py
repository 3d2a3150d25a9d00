"""From a Markdown folder to a knowledge base: clean, cut into chunks, enrich, embed, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaner, markdown, retrieval, rules
from ..settings import Settings
from ..sources import io


def chunk_table(docs: DataFrame, settings: Settings = Settings(), clean: bool = True) -> DataFrame:
    """docs(file_path, file_name, file_size, text) to enriched chunks: one narrow chain, no shuffle; texts are cleaned and cut
    in the same Arrow map."""
    return rules.enrich(markdown.chunks(docs, settings, before=cleaner.clean_file if clean else None))


def build(spark: SparkSession, folder: str, out: str, settings: Settings = Settings(), embedder=retrieval.embed) -> DataFrame:
    """Reads *.md below folder and replaces the tables out/chunks, out/postings and out/vectors. Returns the chunks.

    Postings are written in order of their terms, so that a look-up reads few row groups.
    """
    io.write_chunks(chunk_table(io.markdown(spark, folder), settings), f"{out}/chunks")
    chunks = io.read_chunks(spark, f"{out}/chunks")
    retrieval.postings(chunks).repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{out}/postings")
    embedder(chunks.select("chunk_id", "text")).select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{out}/vectors")
    return chunks
