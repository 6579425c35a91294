import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import analysis, dense, evaluation, fusion, lexical, rerank
from gleanery.providers import HashEmbedder, OverlapJudge, OverlapJudgeOfFour, OverlapScorer


def brute_bm25(docs, query, k):
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    score = {i: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()), 6) for i, t in toks.items()}
    return sorted(docs, key=lambda i: (-score[i], i))[:k]


@pytest.mark.parametrize("sent_bytes", [lexical.SENT_BYTES, 0])
@pytest.mark.parametrize("vocabulary", [30, 4, 2])  # positive, mixed and negative weights
def test_bm25_against_brute_force_both_ways(spark, monkeypatch, sent_bytes, vocabulary):
    monkeypatch.setattr(lexical, "CELLS", 100)  # several steps a batch
    rng = np.random.default_rng(vocabulary)
    words = [f"w{i}" for i in range(vocabulary)]
    docs = {i: " ".join(rng.choice(words, rng.integers(0, 40))) for i in range(60)}
    queries = {f"q{i}": " ".join(rng.choice([*words, "unknown"], 5)) for i in range(12)} | {"empty": "", "none": "zzz"}
    index = lexical.build(spark.createDataFrame(list(docs.items()), "id int, text string").repartition(3), "id", "text")
    rows = [*queries.items(), (None, "w0")]
    hits = lexical.search(index, spark.createDataFrame(rows, "query_id string, query string"), 7, sent_bytes=sent_bytes).collect()
    for q, text in rows:
        mine = [r["id"] for r in sorted((r for r in hits if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == brute_bm25(docs, text, 7), q


def test_bm25_negative_scores_and_ties(spark):
    docs = spark.createDataFrame([("d1", "a b"), ("d2", "a b"), ("d3", "a b c"), ("d4", None)], "id string, text string")
    q = spark.createDataFrame([("q", "a")], "query_id string, query string")
    index = lexical.build(docs.where("id <> 'd4'"), "id", "text")
    both = [[(r["id"], r["score"]) for r in lexical.search(index, q, 5, sent_bytes=n).orderBy("rank").collect()] for n in (lexical.SENT_BYTES, 0)]
    assert both[0] == both[1] and [i for i, _ in both[0]] == ["d3", "d1", "d2"] and all(s < 0 for _, s in both[0])
    # a document without the word, at 0, comes before those with it
    assert lexical.search(lexical.build(docs, "id", "text"), q, 1, sent_bytes=0).first()["id"] in ("d3", "d4")
    empty = lexical.build(docs.limit(0), "id", "text")
    assert lexical.search(empty, q, 5).count() == lexical.search(empty, q, 5, sent_bytes=0).count() == 0
    assert lexical.search(index, q.limit(0), 5).count() == 0


def test_bm25_of_many_queries_goes_by_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(40)], "id int, text string")
    q = spark.createDataFrame([(i, f"w{i} common") for i in range(7)], "query_id int, query string")
    index = lexical.build(docs, "id", "text")
    few = sorted(map(tuple, lexical.search(index, q, 4).collect()))
    monkeypatch.setattr(lexical, "SENT_QUERIES", 3)
    many = lexical.search(index, q, 4)
    assert "Join" in many._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, many.collect())) == few


def test_bm25_of_many_queries_with_frequent_words_goes_out_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} v{i % 3} common") for i in range(40)], "id int, text string").repartition(3)
    q = spark.createDataFrame([(i, f"w{i} v{i % 4} common" if i else "none") for i in range(9)] + [(None, "w1"), (99, " ".join(f"w{i}" for i in range(50)))], "query_id int, query string")
    index = lexical.build(docs, "id", "text")
    few = sorted(map(str, lexical.search(index, q, 4).collect()))
    monkeypatch.setattr(lexical, "SENT_QUERIES", 3)
    monkeypatch.setattr(lexical, "JOINED", 20)
    many = lexical.search(index, q, 4)
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString() and sorted(map(str, many.collect())) == few
    # a single query over the bound in bytes is joined, the others are not
    assert sorted(map(str, lexical.search(index, q, 4, sent_bytes=700).collect())) == few


def test_bm25_leaves_out_words_that_tell_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 200)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    share = 1 / np.arange(1, 401)
    docs = {i: " ".join(rng.choice(words, 30, p=share / share.sum())) for i in range(500)}
    asked = [(i, " ".join(docs[i].split()[:12])) for i in range(0, 500, 25)]
    index = lexical.build(spark.createDataFrame(list(docs.items()), "id int, text string").repartition(2), "id", "text")
    hits = lexical.search(index, spark.createDataFrame(asked, "query_id int, query string"), 5).collect()
    for q, text in asked:
        assert [r["id"] for r in sorted((r for r in hits if r["query_id"] == q), key=lambda r: r["rank"])] == brute_bm25(docs, text, 5), q


def test_what_is_cut_packed_takes_little_disk(spark):
    from pathlib import Path

    from gleanery.session import checkpoint_dir, cut_packed

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    before = size()
    rows = [(i, f"{i} " + "the same words again " * 200, [0.5, None]) for i in range(2000)]
    kept = cut_packed(spark.createDataFrame(rows, "id int, text string, v array<float>"), rows=300)
    assert sorted((r["id"], r["text"], r["v"]) for r in kept.collect()) == rows
    assert size() - before < 1_000_000  # of 8 MB
    assert cut_packed(kept.limit(0)).count() == 0


def test_texts_of_candidates_with_and_without_sending_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, text string")
    candidates = spark.createDataFrame([(1, 3), (1, 7), (2, 3), (2, 99)], "query_id int, id int")
    few = sorted(map(tuple, rerank.with_texts(candidates, docs).select("query_id", "id", "text").collect()))
    monkeypatch.setattr(rerank, "SENT", 2)
    assert sorted(map(tuple, rerank.with_texts(candidates, docs).select("query_id", "id", "text").collect())) == few == [(1, 3, "t3"), (1, 7, "t7"), (2, 3, "t3")]


def test_bm25_index_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple pie"), (3, "blue sky"), (4, "sky")], "id int, text string")
    q = spark.createDataFrame([(1, "green apple"), (2, "sky")], "query_id int, query string")
    index = lexical.build(docs, "id", "text")
    index.save(str(tmp_path))
    again = lexical.load(spark, str(tmp_path))
    rows = [sorted(map(tuple, lexical.search(i, q, 2).collect())) for i in (index, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_knn_in_several_blocks_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(5)
    whole = sorted(map(tuple, dense.knn(df, df, 4, 4).collect()))
    monkeypatch.setattr(dense, "SENT", 70)
    assert sorted(map(tuple, dense.knn(df, df, 4, 4, block=16).collect())) == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r[1] for r in whole if r[0] == 7 and r[2] > 0] and {r[1] for r in whole if r[0] == 7} == set(np.argsort(-(u @ u[7]))[:4].tolist())



def test_knn_of_more_rows_than_one_product_and_of_many_as_near(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(2500, 4)), np.tile([1.0, 0, 0, 0], (1500, 1))])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)], "vec_id int, embedding array<double>").coalesce(1)
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    hits = dense.knn(df, df.where("vec_id % 40 = 0"), 6, 4).collect()
    for q in range(0, 4000, 40):
        d = np.round(1 - unit @ unit[q], 6)
        assert [r["id"] for r in sorted((r for r in hits if r["query_id"] == q), key=lambda r: r["rank"])] == ids[np.lexsort((ids, d))[:6]].tolist(), q


def test_knn_exact_ties_and_unusable(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, None), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = dense.knn(df, df.where("vec_id = 1 OR vec_id = 4"), 3, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["distance"]) for r in got] == [(1, 1, 0.0), (1, 2, 0.0), (1, 8, 0.292893)]
    assert dense.knn(df.limit(0), df, 3, 2).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "c", 9)], "i int, s string, n int")
    ids = lambda w: [r["i"] for r in df.where(dense.predicate(w)).orderBy("i").collect()]
    assert ids({"$or": [{"s": "a"}, {"n": {"$gte": 9}}]}) == [1, 3]
    assert ids({"n": {"$gt": 5, "$lt": 9}}) == [2]
    assert ids({"s": {"$nin": ["a"]}, "n": {"$ne": 9}}) == [2]
    assert ids({"s": {"$contains": "b"}}) == [2] and ids({"s": {"$not_contains": "b"}}) == [1, 3] and ids({}) == [1, 2, 3]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, id string, rank int")


def test_fusion_ties_and_missing(spark):
    d, x = ranked(spark, [("q", "a", 1), ("q", "b", 2)]), ranked(spark, [("q", "c", 1), ("q", "b", 2), ("r", "z", 1)])
    got = fusion.reciprocal_rank(d, x, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("q", "b"), ("q", "a"), ("q", "c"), ("r", "z")]
    assert got[1]["score"] == round(1 / 61, 9)
    far = fusion.reciprocal_rank(d, x, 3, missing_rank=9999).where("id = 'a'").first()
    assert far["score"] == round(1 / 61 + 1 / 10059, 9)
    assert fusion.reciprocal_rank(d, x, 1, rank_base=0).where("query_id = 'q'").first()["score"] == round(1 / 60, 9)
    two = fusion.fuse_indexes({"s": d, "r": x}, 3).where("query_id = 'q'").orderBy("rank").collect()
    assert [r["key"] for r in two] == ["s:a", "r:c", "s:b"]


def test_evaluation(spark):
    hits = spark.createDataFrame([("s", "q1", "a", 1), ("s", "q1", "b", 2), ("t", "q1", "b", 1), ("s", "q2", "c", 3)], "strategy string, query_id string, id string, rank int")
    gold = spark.createDataFrame([("q1", ["b"]), ("q2", ["c", "x"]), ("q3", [])], "query_id string, gold array<string>")
    scores = evaluation.per_question(hits, gold)
    rows = {(r["strategy"], r["query_id"]): (r["hit_at_1"], r["hit_at_5"], round(r["rr"], 4)) for r in scores.collect()}
    assert rows == {("s", "q1"): (0, 1, 0.5), ("s", "q2"): (0, 1, 0.3333), ("s", "q3"): (0, 0, 0.0), ("t", "q1"): (1, 1, 1.0), ("t", "q2"): (0, 0, 0.0), ("t", "q3"): (0, 0, 0.0)}
    s = {r["strategy"]: (r["n_questions"], r["recall_at_5"], r["mrr"]) for r in evaluation.summarise(scores).collect()}
    assert s == {"s": (3, 0.6667, 0.2778), "t": (3, 0.3333, 0.3333)}
    assert [r["query_id"] for r in analysis.missed_by_all(scores).collect()] == ["q3"]
    assert [r["query_id"] for r in analysis.won_only_by(scores, "s").collect()] == ["q2"]
    m = {r["query_id"]: (r["s"], r["t"]) for r in analysis.hit_matrix(scores, ["s", "t"]).collect()}
    assert m == {"q1": (1, 1), "q2": (1, 0), "q3": (0, 0)}


def test_gold_lists_and_fingerprints(spark):
    g = spark.createDataFrame([(["a", "b", ""], None, ["b", "c"])], "x array<string>, y array<string>, z array<string>")
    assert g.select(evaluation.all_gold("x", "y", "z").alias("g")).first()["g"] == ["a", "b", "c"]
    hits = spark.createDataFrame([("q", 1, "nothing"), ("q", 2, "pre Gold text here")], "query_id string, rank int, text string")
    texts = spark.createDataFrame([("q", "Gold text"), ("q", ""), ("r", None)], "query_id string, gold_text string")
    assert {r["query_id"]: r["first_rank"] for r in evaluation.fingerprint_hits(hits, texts).collect()} == {"q": 2, "r": None}
    blank = spark.createDataFrame([("q", "   ")], "query_id string, gold_text string")
    assert evaluation.fingerprint_hits(hits, blank).first()["first_rank"] == 1


def test_judge_means_skip_unknown(spark):
    r = spark.createDataFrame([(1.0, 10.0), (None, 20.0), (float("nan"), 30.0), (0.0, None)], "f double, l double")
    assert tuple(evaluation.judge_means(r, {"f": F.col("f")}, F.col("l")).first()) == (4, 0.5, 20.0)


def test_rerank_and_retrievers(spark):
    c = spark.createDataFrame([("q", "red apple", "1", "an apple"), ("q", "red apple", "2", "a red apple"), ("q", "red apple", "3", None)], "query_id string, query string, id string, text string")
    assert [r["id"] for r in rerank.rerank(c, 2, OverlapScorer).orderBy("rank").collect()] == ["2", "1"]
    assert rerank.rerank(c.limit(0)).count() == 0
    texts = ["alpha beta gamma", "beta gamma delta", "delta epsilon zeta", "alpha zeta eta", "iota", "kappa", "lambda", "mu"]
    docs = spark.createDataFrame([(str(i), t, v) for i, (t, v) in enumerate(zip(texts, HashEmbedder().embed(texts)))], "id string, text string, embedding array<double>")
    q = spark.createDataFrame([("q", "beta gamma delta")], "query_id string, query string")
    for s in ("bm25", "semantic", "hybrid", "hybrid_rerank"):
        assert rerank.retriever(docs, s, 2)(q).orderBy("rank").first()["id"] == "1", s
    assert rerank.retriever(docs, "hybrid_rerank", 2, scorer=None, missing_rank=9999)(q).count() == 2
    with pytest.raises(ValueError):
        rerank.retriever(docs, "psychic")
    with pytest.raises(Exception, match="blank"):
        rerank.retriever(docs, "semantic", 2)(spark.createDataFrame([("q", " ")], "query_id string, query string")).collect()


def test_evaluate_runs_all_strategies(spark):
    texts = ["alpha beta gamma", "beta gamma delta", "delta epsilon zeta", "alpha zeta eta", "iota", "kappa", "lambda", "mu"]
    docs = spark.createDataFrame([(str(i), t, v) for i, (t, v) in enumerate(zip(texts, HashEmbedder().embed(texts)))], "id string, text string, embedding array<double>")
    asked = spark.createDataFrame([("q", "beta gamma delta"), ("r", "nothing like it")], "query_id string, query string")
    gold = spark.createDataFrame([("q", ["1"], ["1"]), ("r", [], [])], "query_id string, gold array<string>, prime array<string>")
    results, summary = evaluation.evaluate({s: rerank.retriever(docs, s, 3) for s in rerank.STRATEGIES}, asked, gold)
    assert results.count() == 8 and all(r["latency_ms"] > 0 for r in results.collect())
    for r in summary.collect():
        assert (r["n_questions"], r["recall_at_1"], r["mrr"], r["primary_mrr"]) == (2, 0.5, 0.5, 0.5) and r["mean_latency_ms"] > 0, r["strategy"]
    assert analysis.summary_table(summary).columns == ["strategy", "R@1", "R@5", "R@10", "MRR", "ms/q"]


def test_retrievers_that_share_lists_search_once(spark, monkeypatch):
    texts = ["alpha beta gamma", "beta gamma delta", "delta epsilon zeta", "alpha zeta eta", "iota", "kappa", "lambda", "mu"]
    docs = spark.createDataFrame([(str(i), t, v) for i, (t, v) in enumerate(zip(texts, HashEmbedder().embed(texts)))], "id string, text string, embedding array<double>")
    asked = spark.createDataFrame([("q", "beta gamma delta"), ("r", "alpha mu")], "query_id string, query string")
    gold = spark.createDataFrame([("q", ["1"], ["1"]), ("r", [], [])], "query_id string, gold array<string>, prime array<string>")
    searched = []
    for module, name in ((lexical, "search"), (dense, "knn")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: searched.append((n, a[2])) or f(*a))
    lists = rerank.Lists(4)
    ways = {s: rerank.retriever(docs, s, 2, pool=4, lists=lists) for s in rerank.STRATEGIES}
    results = evaluation.evaluate(ways, asked, gold, lists=lists)[0].collect()
    assert sorted(searched) == [("knn", 4), ("search", 4)]
    alone = evaluation.evaluate({s: rerank.retriever(docs, s, 2, pool=4) for s in rerank.STRATEGIES}, asked, gold)[0].collect()
    plain = lambda rows: sorted((r["strategy"], r["query_id"], *r["hit_ids"]) for r in rows)
    assert plain(results) == plain(alone) and len(searched) == 8
    # a strategy's time holds that of the lists it found made
    took = {r["strategy"]: r["latency_ms"] * 2 / 1000 for r in results}
    assert lists.again > 0 and took["hybrid"] >= sum(x[3] for x in lists.kept.values())
    # other queries, and deeper lists, are made anew
    ways["bm25"](asked.limit(1)).collect(), rerank.retriever(docs, "bm25", 6, lists=lists)(asked).collect()
    assert searched[8:] == [("search", 4), ("search", 6)]


def test_judges(spark):
    class Fussy(OverlapJudge):
        def judge(self, rows):
            if any(r[1] == "bad" for r in rows):
                raise ValueError("no")
            return [{"faithfulness": float("nan") if r[1] == "nan" else 1.0, "relevancy": 0.33333} for r in rows]

    rows = spark.createDataFrame([("a", "q", "fine", ["x"]), ("b", "q", "bad", ["x"]), ("c", "q", "nan", None)], "query_id string, question string, answer string, contexts array<string>").coalesce(1)
    got = {r["query_id"]: (r["faithfulness"], r["relevancy"]) for r in evaluation.judge_results(rows, Fussy).collect()}
    assert got == {"a": (1.0, 0.3333), "b": (None, None), "c": (None, 0.3333)}
    four = OverlapJudgeOfFour().judge([("what is red", "an apple is red", ["an apple", "red sky"], "red apple"), ("q", "", [], None)])
    assert four[0] == {"faithfulness": 0.75, "answer_relevancy": 2 / 3, "context_recall": 1.0, "context_precision": 1.0} and set(four[1].values()) == {None}
    assert evaluation.judge_results(rows.limit(0)).count() == 0


def test_spans_beat_hash_vectors(spark):
    """Spans cut from texts are found by words, and hardly by vectors that only know whole texts."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, HashEmbedder().embed(texts)))], "id int, text string, embedding array<double>")
    spans = evaluation.spans(docs)
    gold = spans.select("query_id", F.array("query_id").alias("gold"))
    recall = {}
    for s in ("bm25", "semantic", "hybrid"):
        hits = rerank.retriever(docs, s, 10)(spans).select(F.lit(s).alias("strategy"), "query_id", "id", "rank")
        recall[s] = evaluation.summarise(evaluation.per_question(hits, gold)).first()["recall_at_10"]
    assert recall["bm25"] > recall["semantic"] + 0.5 and recall["hybrid"] >= recall["bm25"] - 0.01
