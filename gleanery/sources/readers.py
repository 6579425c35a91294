"""Readers of pages, chunks, gold questions and results. Schemas are given, never inferred."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators import html
from gleanery.operators import sections as sections_


def read_html(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path``, ``source_file`` and ``html`` of whole files; bytes that are not UTF-8 are left out.

    A page is known by its path. ``source_file`` is the base name; where several pages share it, the folder goes before it.
    """
    paths = [paths] if isinstance(paths, str) else paths
    raw = spark.read.format("binaryFile").load(paths)
    base, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    shared = raw.select(base.alias("base")).groupBy("base").count().where("count > 1")  # reads no content
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    name = F.when(F.col("count").isNull(), F.col("base")).otherwise(F.concat_ws("_", folder, "base"))
    return raw.select("path", base.alias("base"), text.alias("html")).join(shared, "base", "left").select("path", name.alias("source_file"), "html")


def read_section_dumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sections kept as plain text, "Item N - Title" above each and a blank line between: ``path``, ``filer`` (the folder), ``source_file``
    and the columns of ``extract_sections``. Headings within a section are read as in a page."""
    raw = spark.read.format("text").option("wholetext", True).load(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    found = sections_.extract_sections(html.line_nodes(raw, "path")).withColumnRenamed("doc", "path")
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -2).alias("filer"), F.element_at(parts, -1).alias("source_file"), *[c for c in found.columns if c != "path"])


def html_paths(folder: str, names: list[str] | None = None) -> list[str]:
    """The files named, or all pages of a folder in order. A name may leave out the folder and the ending."""
    if not names:
        return sorted(str(p) for p in Path(folder).glob("*.html"))
    out = []
    for n in names:
        found = next((p for p in (Path(n), Path(folder) / n, Path(folder) / f"{n}.html") if p.exists()), None)
        if found is None:
            raise FileNotFoundError(f"no page {n!r}, nor in {folder}")
        out.append(str(found))
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped and unknown fields left out."""
    return spark.read.schema(schema).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.CHUNK)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.GOLD)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Generation results: one JSON array."""
    return spark.read.schema(schemas.GENERATION_RESULT).option("multiLine", True).json(path)


def documents(sections: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Sections as documents: ``doc_id`` (file::part::item), ``text`` and ``metadata`` with the fields of ``extra`` added.
    Blank sections are left out."""
    meta = F.create_map(*[x for k, v in (("source_file", F.col("source_file")), ("company", F.replace("source_file", F.lit(".html"), F.lit(""))), ("part", F.coalesce("part", F.lit(""))), ("item", F.col("item")), ("section_title", F.coalesce("title", F.lit(""))), ("char_count", F.length("text").cast("string"))) for x in (F.lit(k), v)])
    if extra:
        added = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
        meta = F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin(list(extra))), added)
    return sections.where(r"text RLIKE '\\S'").select(F.concat_ws("::", "source_file", F.coalesce("part", F.lit("")), "item").alias("doc_id"), "text", meta.alias("metadata"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of strategies kept as one JSON object (strategy to metrics): ``strategy``, ``metric``, ``value``. Entries that are
    no number are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("strategy", "metrics")).select("strategy", F.explode("metrics").alias("metric", "value"))
    return rows.select("strategy", "metric", F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")
