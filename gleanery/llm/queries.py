"""The queries of this subpackage, each over whole tables with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split: those the splitter gave more than one piece."""
    from gleanery.llm.split import split_oversized

    pieces = split_oversized(_table(spark, sf_dir, "semantic_chunks"))
    return pieces.groupBy("chunk_id").agg(F.count("*").alias("pieces")).where("pieces > 1").select("chunk_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.split import split_oversized

    return split_oversized(_table(spark, sf_dir, "semantic_chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.replies import defects

    return defects(_table(spark, sf_dir, "v2_generation_results"))


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective rows by kind."""
    from gleanery.llm.replies import defects

    return defects(_table(spark, sf_dir, "v2_generation_results")).groupBy("defect").agg(F.count("*").alias("rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.sentences import sentences

    return sentences(_table(spark, sf_dir, "semantic_chunks")).select("chunk_id", "start_pos", "end_pos")


#: Similarity and word runs of the statement for problem 5.
P5 = {"threshold": 0.6, "size": 3, "size_single": 6, "least": 200}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.duplicates import member_pairs, near_duplicates

    pairs = member_pairs(*near_duplicates(_table(spark, sf_dir, "semantic_chunks"), **P5))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each chunk that is compared, with its class and its group."""
    from gleanery.llm.duplicates import components, near_duplicates

    return components(*near_duplicates(_table(spark, sf_dir, "semantic_chunks"), **P5)).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.vectors import similar_vectors

    near = similar_vectors(_table(spark, sf_dir, "semantic_index"))
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact five nearest that the index found, for the vectors whose id is divisible by 100."""
    from gleanery.llm.vectors import brute_force, similar_vectors

    table = _table(spark, sf_dir, "semantic_index")
    exact = brute_force(table, table.where("vec_id % 100 = 0")).select("id", "neighbour")
    near = similar_vectors(table).select("id", "neighbour", F.lit(1).alias("hit"))
    both = exact.join(near, ["id", "neighbour"], "left")
    return both.agg(F.countDistinct("id").alias("queries"), F.count("*").alias("neighbours"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.leaks import leaks

    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "gold_questions"))
    return found.select("doc_id", "question_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the documents that hold them and the longest passage."""
    from gleanery.llm.leaks import leaks

    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "gold_questions"))
    return found.groupBy("question_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest_words"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_weights"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_weights"))[1]


#: Stands in for a secret of the operator of the pipeline.
DEMONSTRATION_KEY = "demonstration"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions that got a surrogate, which is every one found."""
    from gleanery.llm.personal import mentions

    found = mentions(_table(spark, sf_dir, "documents"), key=DEMONSTRATION_KEY)
    return found.where("surrogate IS NOT NULL").select("doc_id", "kind", "mention").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.personal import redact

    return redact(_table(spark, sf_dir, "documents"), key=DEMONSTRATION_KEY)


def p8_redacted_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every text: its masked form is as long as the text less its mentions and their placeholders more, the rest
    stands in it in order, and of both forms none has an e-mail address that the text has."""
    from gleanery.llm.personal import PLACEHOLDER, mentions, redact

    docs = _table(spark, sf_dir, "documents")
    sizes = F.create_map(*[x for k, v in PLACEHOLDER.items() for x in (F.lit(k), F.lit(len(v)))])
    found = mentions(docs).groupBy("doc_id").agg(F.sum(F.length("mention") - F.try_element_at(sizes, F.col("kind"))).alias("less"), F.collect_set(F.when(F.col("kind") == "email", F.col("mention"))).alias("mails"))
    rows = redact(docs, key=DEMONSTRATION_KEY).join(found, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id")
    same = F.coalesce(F.length("masked_text") == F.length("text") - F.coalesce("less", F.lit(0)), F.col("text").isNull())
    untouched = (F.col("mention_count") > 0) | F.coalesce((F.col("masked_text") == F.col("text")) & (F.col("surrogate_text") == F.col("text")), F.col("text").isNull())
    gone = ~F.coalesce(F.exists("mails", lambda m: F.col("masked_text").contains(m) | F.col("surrogate_text").contains(m)), F.lit(False))
    return rows.agg(F.count("*").alias("texts"), F.count_if(same).alias("right_length"), F.count_if(untouched).alias("rest_untouched"), F.count_if(gone).alias("mails_gone"))


def p1_pieces_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized chunk: its characters, whether the pieces are in order and within the limit, overlap by no more than allowed,
    and give the text when put together."""
    pieces = p1_pieces(spark, sf_dir)
    texts = _table(spark, sf_dir, "semantic_chunks").select("chunk_id", "text").distinct()
    ordered = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "text"))).alias("p")).join(texts, "chunk_id")
    fits = F.forall("p", lambda x: (F.length(x["text"]) <= 1300) & (x["text"] == F.substring(F.col("text"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"])))
    steps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: (b["start_pos"] > a["start_pos"]) & (b["start_pos"] <= a["end_pos"]) & (a["end_pos"] - b["start_pos"] <= 300) & (b["end_pos"] > a["end_pos"]))
    whole = (F.col("p")[0]["start_pos"] == 0) & (F.try_element_at("p", F.lit(-1))["end_pos"] == F.length("text"))
    return ordered.select("chunk_id", F.length("text").alias("chars"), fits.alias("fits"), F.forall(steps, lambda x: x).alias("overlaps"), whole.alias("whole"))


def p7_shares_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source of the weights: its share and cap, and whether the mix keeps the cap and takes no more than there is."""
    from gleanery.llm.mixing import mix

    mixed, report = mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_weights"))
    caps = mixed.groupBy("source").agg(F.max("copies").alias("copies"), F.count("*").alias("texts"), F.countDistinct("doc_id").alias("ids"))
    rows = report.where("target_share > 0 OR max_repeats IS NOT NULL").join(caps, "source", "left")
    kept = F.coalesce(F.col("copies") <= F.col("max_repeats"), F.lit(True))
    return rows.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", kept.alias("cap_kept"), (F.coalesce("texts", F.lit(0)) == F.coalesce("ids", F.lit(0))).alias("once_each"), F.coalesce(F.col("mix_tokens") <= F.col("available_tokens") * F.coalesce("max_repeats", F.lit(1 << 30)), F.lit(True)).alias("enough"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_recall, p3_found, p3_kinds, p4_found, p5_found, p5_groups, p6_found, p6_items, p7_mix, p7_shares, p8_found, p8_redacted, p1_pieces_kept, p7_shares_kept, p8_redacted_kept)}
