import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vector as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_slug_and_ids(spark):
    assert one(spark, T.slug("x"), "  Wide Corp. (2031)  ") == "wide_corp_2031"
    assert one(spark, T.item_slug("x"), "Item 1A") == "item1a"
    row = spark.createDataFrame([("Wide_Corp.html", "Item 1A", 7)], "f string, i string, n int").select(T.chunk_id("f", "i", "n").alias("y")).first()
    assert row["y"] == "wide_corp_item1a_chunk_007"


def test_nulls_stay_null(spark):
    for f in (T.slug, T.stable_hash, T.preview, T.fingerprint, T.trim_ws):
        assert one(spark, f("x"), None) is None


def test_tokens_follow_python(spark):
    text = "It's a well-known café -- 'tis 3.5% of x_y; naïve 'quoted' ü"
    assert one(spark, T.token_count("x"), text) == len(re.findall(r"\b[\w'-]+\b", text))


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab .!?\n\t é-'", max_size=60))
def test_sentences_and_words_follow_python(text):
    from gleanery.session import local_session

    spark = local_session(4, 4, "tests")
    row = spark.createDataFrame([(text,)], "x string").select(T.sentences("x").alias("s"), T.words("x").alias("w"), T.paragraphs("x").alias("p")).first()
    assert row["s"] == [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip())) if s]
    assert row["w"] == text.split()
    assert row["p"] == [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]


def test_jaccard_edges(spark):
    df = spark.sql("SELECT array('a','b') AS a, array('b','c') AS b, CAST(array() AS array<string>) AS e")
    row = df.select(T.jaccard(F.col("a"), F.col("b")).alias("ab"), T.jaccard(F.col("e"), F.col("e")).alias("ee"), T.jaccard(F.col("a"), F.col("e")).alias("ae")).first()
    assert (round(row["ab"], 6), row["ee"], row["ae"]) == (round(1 / 3, 6), 1.0, 0.0)


def test_vectors(spark):
    df = spark.sql("SELECT array(3.0f, 4.0f) AS a, array(4.0f, 3.0f) AS b, array(0.0f, 0.0f) AS z, array(1.0f) AS s")
    row = df.select(V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("z"), V.dot(F.col("a"), F.col("s")).alias("s"), V.usable(F.col("a"), 2).alias("u"), V.usable(F.col("z"), 2).alias("v")).first()
    assert (row["n"], round(row["c"], 9), row["z"], row["s"], row["u"], row["v"]) == (5.0, 0.96, None, None, True, False)
