"""Checks of extracted sections: missing items, short sections and a summary of each filing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.operators.sections import SHORT

_LABEL = r"^Item\s+(\d{1,2})([A-Z]?)"


def _number(label):
    return F.coalesce(F.regexp_extract(label, _LABEL, 1).try_cast("int"), F.lit(999))


def item_gaps(items: DataFrame, key: str = "source_file", item_col: str = "item") -> DataFrame:
    """Items missing between those present, of each key: whole numbers, and letters of one number. ``key``, ``gap``.

    Labels that name no item count as number 999 without a letter. Nulls are passed over.
    """
    label = F.col(item_col)
    parsed = items.where(label.isNotNull() & F.col(key).isNotNull()).select(key, _number(label).alias("n"), F.regexp_extract(label, _LABEL, 2).alias("letter")).distinct()
    numbers = parsed.select(key, "n").distinct().withColumn("next", F.lead("n").over(W.partitionBy(key).orderBy("n")))
    by_number = numbers.where("next > n + 1").select(key, F.explode(F.sequence(F.col("n") + 1, F.col("next") - 1)).alias("m")).select(key, F.concat(F.lit("Item "), "m").alias("gap"))
    letters = parsed.where("letter <> ''").withColumn("next", F.lead("letter").over(W.partitionBy(key, "n").orderBy("letter")))
    by_letter = letters.where(F.ascii("next") > F.ascii("letter") + 1).select(key, "n", F.explode(F.sequence(F.ascii("letter") + 1, F.ascii("next") - 1)).alias("c")).select(key, F.concat(F.lit("Item "), "n", F.char(F.col("c").cast("long"))).alias("gap"))
    return by_number.union(by_letter)


def short_sections(sections: DataFrame, limit: int = SHORT) -> DataFrame:
    return sections.where(F.length("text") < limit)


def _gap_count(labels):
    """How many gaps ``item_gaps`` finds between labels (an array of ``n`` and ``letter``): numbers, and letters of a number."""

    def missing(present):
        return F.coalesce(F.array_max(present) - F.array_min(present) + 1 - F.size(F.array_distinct(present)), F.lit(0))

    numbers = F.array_distinct(F.transform(labels, lambda x: x["n"]))
    of_number = lambda n: F.transform(F.filter(labels, lambda x: (x["n"] == n) & (x["letter"] != "")), lambda x: F.ascii(x["letter"]))
    return missing(numbers) + F.aggregate(F.transform(numbers, lambda n: missing(of_number(n))), F.lit(0), lambda a, x: a + x)


def filing_summary(sections: DataFrame, key: str = "source_file") -> DataFrame:
    """Of each filing: distinct parts and items, gaps, short sections, duplicates and whether no part is known.

    One aggregation: labels of items are few (a number of two digits and a letter), so their set stays small.
    """
    label = F.when(F.col(key).isNotNull() & F.col("item").isNotNull(), F.struct(_number(F.col("item")).alias("n"), F.regexp_extract("item", _LABEL, 2).alias("letter")))
    base = sections.groupBy(key).agg(F.collect_set("part").alias("parts"), F.collect_set("item").alias("items"), F.collect_set(label).alias("labels"), F.count(F.when(F.length("text") < SHORT, 1)).alias("short"), F.sum("duplicates").cast("long").alias("dup"))
    return base.select(key, F.size("parts").cast("long").alias("parts"), F.size("items").cast("long").alias("items"), _gap_count(F.col("labels")).cast("long").alias("gaps"), "short", "dup", (F.size("parts") == 0).alias("no_part"))


def sections_by_part(sections: DataFrame, key: str = "source_file", order: str = "seg") -> DataFrame:
    """Parts of each filing in the order in which they first come, with their items and characters. A null part is one part."""
    first = sections.groupBy(key, "part").agg(F.min(order).alias("first"), F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))
    return first.withColumn("part_no", F.row_number().over(W.partitionBy(key).orderBy("first", F.col("part").asc_nulls_last())).cast("int")).select(key, "part_no", "part", "sections", "chars")
