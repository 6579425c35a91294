"""Pages that arrive as files: a stream from HTML to chunks, each batch replacing the chunks of its filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators import chunking, html, sections


def pages_to_chunks(pages: DataFrame, strategy: str = "semantic", keep_path: bool = False, **options) -> DataFrame:
    """Chunks of pages (``path``, ``source_file``, ``html``). Pages are told apart by ``path``, whatever they are called."""
    return chunking.chunk(pages_to_sections(pages), strategy, ("path",) if keep_path else (), **options)


def pages_to_sections(pages: DataFrame) -> DataFrame:
    """Sections of pages (``path``, ``source_file``, ``html``), with both names."""
    found = sections.extract_sections(html.parsed_text_nodes(pages, "path", "html")).withColumnRenamed("doc", "path")
    return found.join(pages.select("path", "source_file").distinct(), "path")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, strategy: str = "semantic") -> StreamingQuery:
    """Reads whole HTML files as they come and writes their chunks, one folder a page (``page``: a hash of its path); what is
    there runs to its end.

    A batch overwrites the folders of its own pages only, so a batch that runs again after a failure changes nothing, and
    pages of the same name in different folders stay apart.
    """
    pages = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    path = F.col("_metadata.file_path")
    pages = pages.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("source_file"), F.col("value").alias("html"))

    def write(batch: DataFrame, _: int) -> None:
        chunks = pages_to_chunks(batch, strategy, keep_path=True).withColumn("page", F.left(F.sha1("path"), F.lit(16)))
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page").parquet(out)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
