"""Sources and sinks: Markdown folders, dictionaries, chunk and vector tables, the answer cache, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFICE = ("pdf", "docx", "xlsx", "pptx")
CHUNK_SCHEMA = (
    "chunk_id string, file_path string, file_name string, file_size long, text string, line_start int, line_end int, header_path string, block_types array<string>, "
    "table_row_start int, table_row_end int, relative_row_start int, relative_row_end int, code_chunk_index int, code_total_chunks int, is_code_split boolean, "
    "relative_line_start int, relative_line_end int, code_language string, merged_chunks int, merged_headers array<string>"
)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row a *.md file below folder: file_path, file_name, file_size, modified, text. Files of no bytes and
    folders without any give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def office_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, suffix and size of files to convert, by suffix whatever its case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("suffix").isin(*OFFICE))


def dictionary(lines: DataFrame) -> DataFrame:
    """Tab-separated lines (column value, optional file and seq): key (lower case), term, definitions; no empty terms."""
    cells = F.transform(F.split("value", "\t"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    keep = [c for c in ("file", "seq") if c in lines.columns]
    return lines.select(F.lower(cells[0]).alias("key"), cells[0].alias("term"), F.filter(F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 1)), lambda d: d != "").alias("definitions"), *keep).where("term <> ''")


def dictionary_files(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("seq"))
    return dictionary(lines)


def images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(folder)


def preview(docs: DataFrame, path: str) -> DataFrame:
    """The text of one file as one row; a missing file gives a row that says so."""
    found = docs.where(F.col("file_path") == path).agg(F.first("text").alias("text"))
    return found.select(F.coalesce("text", F.lit(f"读取失败:\n\n{path}")).alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Full refresh; lists are flattened for storage and come back with read_chunks."""
    chunks.write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def changed_files(docs: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    """Documents that cleaning changed; only these need writing."""
    return docs.where(~F.col(cleaned).eqNullSafe(F.col("text")))


def change_counts(docs: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    return docs.agg(F.count_if(~F.col(cleaned).eqNullSafe(F.col("text"))).alias("changed"), F.count("*").alias("total"))


def create_cache(spark: SparkSession, name: str) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (id LONG, cache_key STRING, retrieval_query STRING, presentation_intent STRING, user_intent STRING, answer STRING, "
        "source_nodes ARRAY<STRUCT<score: DOUBLE, file_name: STRING, file_path: STRING, header_path: STRING, line_start: INT, line_end: INT>>, embedding ARRAY<FLOAT>, knowledge_hash STRING, created_at TIMESTAMP) USING parquet"
    )
