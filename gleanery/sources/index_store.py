"""Collections of embedded chunks as Parquet tables: embed once, replace whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from py4j.protocol import Py4JError

from gleanery.operators import lexical
from gleanery.providers import Embedder, HashEmbedder, embed_column
from gleanery.session import cut

#: What the folder of the BM25 index has behind the name of its collection.
WORDS = ".words"


def normalise_metadata(metadata: Column, schema: StructType) -> Column:
    """A metadata struct with '' in place of null texts; arrays, maps and structs become JSON, other values stay."""
    out = metadata
    for f in schema.fields:
        c = metadata[f.name]
        if isinstance(f.dataType, StringType):
            out = out.withField(f.name, F.coalesce(c, F.lit("")))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            out = out.withField(f.name, F.coalesce(F.to_json(c), F.lit("")))
    return out


class IndexStore:
    """Collections under one folder. A collection is one table, partitioned by nothing: metadata filters reach its scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def populated(self, name: str) -> bool:
        """Whether the collection has a row; any failure to read it counts as no."""
        try:
            return self.spark.read.parquet(self.path(name)).limit(1).count() > 0
        except (PySparkException, Py4JError):
            return False

    def open(self, name: str, fallback: str | None = None) -> DataFrame:
        for n in (name, fallback):
            if n and self.populated(n):
                return self.spark.read.parquet(self.path(n))
        raise RuntimeError(f"collection {name!r} is not built")

    def build(self, name: str, chunks: DataFrame, force: bool = False, embedder: Callable[[], Embedder] = HashEmbedder, batch_size: int = 64) -> bool:
        """Embeds and writes chunks (``chunk_id``, ``text``, ``metadata``). A populated collection is left alone unless forced.

        Returns whether it was written. An id that comes twice is an error, found before anything is written.
        """
        if not force and self.populated(name):
            return False
        chunks = cut(chunks.select("chunk_id", "text", "metadata"))  # read for the check and for the table
        twice = chunks.groupBy("chunk_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"chunk id {twice[0]['chunk_id']!r} comes more than once")
        rows = chunks.select("chunk_id", F.col("text").alias("document"), normalise_metadata(F.col("metadata"), chunks.schema["metadata"].dataType).alias("metadata"))
        embed_column(rows, "document", embedder, batch_size).write.mode("overwrite").parquet(self.path(name))
        lexical.build(self.open(name), "chunk_id", "document").save(self.path(name) + WORDS)
        return True

    def words(self, name: str) -> lexical.Index:
        """The BM25 index of a collection, which was written with it; one that is missing is made and written."""
        folder = self.path(name) + WORDS
        if not self.populated(f"{name}{WORDS}/stats"):
            lexical.build(self.open(name), "chunk_id", "document").save(folder)
        return lexical.load(self.spark, folder)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, one folder a strategy."""
    chunks.withColumn("strategy", F.col("metadata.chunk_strategy")).write.mode("overwrite").partitionBy("strategy").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results of strategies, one folder each; a later run replaces only the strategies it has."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)
