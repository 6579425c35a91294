"""Parts and items of annual reports, from a stream of text nodes.

The state of the reader becomes windows over one partitioning by document: segments are running counts of headings,
the part is the last one seen, and a title is the node after its heading. Plain SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.functions import text as T

# Patterns of headings and phrases.
PART = r"(?i)^\s*PART\s+(I{1,3}V?|IV|V)\s*\.?\s*$"
ITEM = r"(?i)^\s*ITEM\s+(\d{1,2}[A-Z]?)\s*[.\x{2014}\x{2013}\-:]"
SIGNATURES = r"(?i)^\s*signatures?\s*\.?\s*$"
REFERENCE = r"(?i)incorporated\s+(herein\s+)?by\s+reference|reference\s+is\s+made\s+to"
# Headings that open an item of their own where they stand within Item 15 or 16.
HEADINGS = {
    "management's discussion and analysis of financial condition and results of operations": ("PART II", "Item 7"),
    "management's discussion and analysis": ("PART II", "Item 7"),
    "quantitative and qualitative disclosures about market risk": ("PART II", "Item 7A"),
    "report of independent registered public accounting firm": ("PART II", "Item 8"),
}
HEADING_LENGTH, SHORT, OVERSIZED = 150, 500, 200_000


def _mapped(text):
    heading = T.trim_ws(F.regexp_replace(T.trim_ws(F.lower(F.translate(text, "’‘", "''"))), r"[.:;\x{2014}\x{2013}\-]+$", ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for phrase, (part, item) in HEADINGS.items():
        out = out.when(heading == phrase, F.lit(f"{part}|{item}"))
    return out


def canonical_part(item_number, fallback):
    n = item_number
    return F.when(n.between(1, 4), "PART I").when(n.between(5, 9), "PART II").when(n.between(10, 14), "PART III").when(n.between(15, 16), "PART IV").otherwise(fallback)


def _headings(nodes: DataFrame) -> DataFrame:
    """Nodes before the signatures with the ``part`` and ``item`` they name, the ones last named, and whether a heading within
    Item 15 or 16 opens an item of its own (``mapped``, ``fired``)."""
    by_doc = W.partitionBy("doc").orderBy("node_idx")
    upto = by_doc.rowsBetween(W.unboundedPreceding, 0)
    n = nodes.withColumn("stop", F.min(F.when(F.col("text").rlike(SIGNATURES), F.col("node_idx"))).over(W.partitionBy("doc"))).where("stop IS NULL OR node_idx < stop")
    part = F.nullif(F.regexp_extract("text", PART, 1), F.lit(""))
    item = F.when(part.isNull(), F.nullif(F.regexp_extract("text", ITEM, 1), F.lit("")))
    n = n.select("doc", "node_idx", "text", F.concat(F.lit("PART "), F.upper(part)).alias("part"), F.concat(F.lit("Item "), F.upper(item)).alias("item"))
    n = n.withColumn("last_part", F.last("part", True).over(upto)).withColumn("real_item", F.last("item", True).over(upto))
    n = n.withColumn("mapped", F.when(F.col("part").isNull() & F.col("item").isNull() & (F.length("text") < HEADING_LENGTH) & F.col("real_item").isin("Item 15", "Item 16"), _mapped(F.col("text"))))
    # the n-th of its mapping so far, counted on the same partitioning
    nth = F.row_number().over(W.partitionBy("doc", "mapped").orderBy("node_idx"))
    return n.withColumn("fired", F.col("mapped").isNotNull() & (nth == 1))


def extract_sections(nodes: DataFrame, dedup: bool = True) -> DataFrame:
    """Sections of documents given as nodes (``doc``, ``node_idx``, ``text``).

    ``doc``, ``part``, ``item``, ``title``, ``text``, ``seg`` (place of the first heading with this part and item), ``duplicates``
    (shorter sections of the same part and item that were left out), ``incorporated_by_reference`` and ``oversized``. A node that says no more than
    "Signatures" ends its document. Of sections with one part and item the longest counts, then the first.
    """
    by_doc = W.partitionBy("doc").orderBy("node_idx")
    upto = by_doc.rowsBetween(W.unboundedPreceding, 0)
    n = _headings(nodes).withColumn("opens", F.col("fired") | F.col("item").isNotNull()).withColumn("seg", F.sum(F.col("opens").cast("int")).over(upto))
    tail = T.trim_ws(F.regexp_replace("text", ITEM, ""))
    plain = ~F.col("opens") & F.col("part").isNull()
    n = n.withColumn("plain", plain).withColumn("tail", F.when(F.col("item").isNotNull(), tail))
    n = n.withColumn("is_title", F.col("plain") & F.coalesce(F.lag("tail").over(by_doc) == "", F.lit(False))).withColumn("next_title", F.when(F.lead("plain").over(by_doc), F.lead("text").over(by_doc)))
    part = F.coalesce(F.split("mapped", r"\|")[0], canonical_part(F.regexp_extract("item", r"(\d+)", 1).try_cast("int"), F.col("last_part")))
    item = F.coalesce("item", F.split("mapped", r"\|")[1])
    title = F.when(F.col("fired"), F.col("text")).when(F.col("tail") != "", F.col("tail")).otherwise(F.coalesce("next_title", F.lit("")))
    # heading and body of a segment in one aggregation, on the partitioning by document that the windows made
    sections = n.where("seg > 0").groupBy("doc", "seg").agg(
        F.array_sort(F.collect_list(F.when(F.col("plain") & ~F.col("is_title"), F.struct("node_idx", "text")))).alias("b"),
        *[F.max(F.when(F.col("opens"), c)).alias(name) for name, c in (("part", part), ("item", item), ("title", title))],
    )
    sections = sections.select("doc", "seg", T.trim_ws(F.array_join(F.col("b.text"), "\n")).alias("text"), "part", "item", "title").where("text <> ''")
    if dedup:
        key = W.partitionBy("doc", "part", "item")
        sections = sections.withColumn("duplicates", (F.count("*").over(key) - 1).cast("int")).withColumn("first", F.min("seg").over(key)).withColumn("best", F.row_number().over(key.orderBy(F.length("text").desc(), "seg"))).where("best = 1")
        sections = sections.withColumn("seg", F.col("first")).drop("best", "first")
    else:
        sections = sections.withColumn("duplicates", F.lit(0))
    return flag_oversized(sections.withColumn("incorporated_by_reference", (F.length("text") < SHORT) & F.col("text").rlike(REFERENCE)))


def flag_oversized(sections: DataFrame, most: int = OVERSIZED) -> DataFrame:
    return sections.withColumn("oversized", F.length("text") > most)


def extraction_stats(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Of each document, up to its signatures: the parts it names, in order, its sections, the duplicates left out, and the items
    that headings opened (as part/item, sorted). ``sections`` are those of ``extract_sections``."""
    n = _headings(nodes)
    named = n.where("part IS NOT NULL").groupBy("doc", "part").agg(F.min("node_idx").alias("at")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("parts_detected"))
    opened = n.where("fired").groupBy("doc").agg(F.array_sort(F.collect_set(F.translate("mapped", "|", "/"))).alias("synthetic_items"))
    counts = sections.groupBy("doc").agg(F.count("*").alias("sections"), F.sum("duplicates").cast("long").alias("duplicates_suppressed"))
    none = F.array().cast("array<string>")
    return (
        counts.join(named, "doc", "full")
        .join(opened, "doc", "full")
        .select("doc", F.coalesce("parts_detected", none).alias("parts_detected"), F.coalesce("sections", F.lit(0)).cast("long").alias("sections"), F.coalesce("duplicates_suppressed", F.lit(0)).cast("long").alias("duplicates_suppressed"), F.coalesce("synthetic_items", none).alias("synthetic_items"))
    )
