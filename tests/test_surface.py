import json

import pytest
from pyspark.sql import functions as F

from gleanery import cli
from gleanery.operators import prompt
from gleanery.providers import ExtractiveGenerator, OverlapJudge
from gleanery.sources import readers
from gleanery.sources.index_store import IndexStore
from gleanery.streaming.ingest import ingest, pages_to_chunks

PAGE = "<html><p>PART I</p><p>Item 1. Business</p><p>We sell quills. Quills are feathers.</p><p>Item 2. Properties</p><p>We own a mill.</p></html>"


def test_prompts_and_citations(spark):
    q = spark.createDataFrame([("q", "What?"), ("r", "Why?")], "query_id string, query string")
    h = spark.createDataFrame([("q", 2, None, None, None, "b"), ("q", 1, "A.html", "Item 1", "Business", " a ")], "query_id string, rank int, source_file string, item string, title string, text string")
    rows = {r["query_id"]: r for r in prompt.build_prompts(q, h).collect()}
    assert "[1] A | Item 1 — Business\na\n\n---\n\n[2] ? | ?\nb\n\n---\n\nQuestion: What?\n\nAnswer" in rows["q"]["prompt"]
    answers = {r["query_id"]: r["answer"] for r in prompt.generate(prompt.build_prompts(q, h), ExtractiveGenerator).collect()}
    assert answers == {"q": "a [1]", "r": prompt.NOTHING}
    turns = [(r["turn"], r["role"]) for r in prompt.build_messages(prompt.build_prompts(q, h)).where("query_id = 'q'").orderBy("turn").collect()]
    assert turns == [(0, "system"), (1, "user")]
    scored = h.withColumn("id", F.concat(F.lit("c"), "rank")).withColumn("score", F.when(F.col("rank") == 1, 0.5))
    rows_ = {r["query_id"]: r for r in prompt.answer_questions(q, scored).collect()}
    assert [(c["rank"], c["id"], c["text"], c["score"]) for c in rows_["q"]["chunks"]] == [(1, "c1", " a ", 0.5), (2, "c2", "b", 0.0)]
    assert rows_["q"]["cited_indices"] == [1] and rows_["q"]["cited_contexts"] == [" a "] and rows_["q"]["completion_tokens"] == 2
    assert (rows_["r"]["answer"], rows_["r"]["chunks"], rows_["r"]["cited_indices"], rows_["r"]["prompt_tokens"], rows_["r"]["latency_ms"]) == (prompt.NOTHING, [], [], 0, 0.0)
    bare = prompt.answer_questions(q, scored, numbered=False).where("query_id = 'q'").first()
    assert bare["answer"] == "a [1]"
    documents = h.drop("text").withColumn("document", F.lit("only this")).withColumn("id", F.lit("x"))
    assert prompt.answer_questions(q, documents).where("query_id = 'q'").first()["contexts"] == ["only this", "only this"]
    c = spark.createDataFrame([("x [3][1] y [1] [0] [99] [1a]", ["p", "q", "r"]), ("none", []), (None, ["p"])], "a string, c array<string>")
    got = c.select(prompt.citations("a").alias("n"), prompt.cited("a", F.col("c")).alias("c")).collect()
    assert [(r["n"], r["c"]) for r in got] == [([0, 1, 3, 99], ["p", "r"]), ([], []), (None, None)]


def test_source_panel_and_summaries(spark, tmp_path):
    hits = spark.createDataFrame([("q", 1, None, 0.5), ("q", 2, 0.9, 0.4), ("r", 1, None, None)], "query_id string, rank int, rerank_score double, distance double")
    answers = spark.createDataFrame([("q", "see [2]")], "query_id string, answer string")
    got = prompt.source_panel(hits, answers).orderBy("query_id", "rank").collect()
    assert [(r["score"], r["is_cited"]) for r in got] == [(0.5, False), (0.9, True), (None, False)]
    (tmp_path / "s.json").write_text(json.dumps({"bm25": {"mrr": 0.5, "note": "x"}, "hybrid": {"mrr": 0.7}}))
    assert sorted(map(tuple, readers.read_summaries(spark, str(tmp_path / "s.json")).collect())) == [("bm25", "mrr", 0.5), ("hybrid", "mrr", 0.7)]


def test_judge_double():
    assert OverlapJudge().judge([("a b", "a c", ["a"]), ("q", "", [])]) == [{"faithfulness": 0.5, "relevancy": 0.5}, {"faithfulness": None, "relevancy": None}]


def test_readers(spark, tmp_path):
    (tmp_path / "b.html").write_bytes(b"caf\xc3\xa9 \xff<p>")
    (tmp_path / "a.html").write_text(PAGE)
    paths = readers.html_paths(str(tmp_path))
    assert [p[-6:] for p in paths] == ["a.html", "b.html"] and readers.html_paths(str(tmp_path), ["b"]) == [paths[1]]
    with pytest.raises(FileNotFoundError):
        readers.html_paths(str(tmp_path), ["zzz"])
    assert readers.read_html(spark, paths[1]).first()["html"] == "café <p>"
    assert [r["source_file"] for r in readers.read_html(spark, paths).orderBy("path").collect()] == ["a.html", "b.html"]
    (tmp_path / "g.jsonl").write_text(json.dumps({"question_id": "1", "question": "?", "other": 1}) + "\n\n" + json.dumps({"question_id": "2"}) + "\n")
    assert readers.read_gold(spark, str(tmp_path / "g.jsonl")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps([{"question_id": "1", "scores": {"faithfulness": None, "relevancy": 1.0}}]))
    assert readers.read_results(spark, str(tmp_path / "r.json")).first()["scores"]["relevancy"] == 1.0
    s = spark.createDataFrame([("A.html", None, "Item 1", None, "x"), ("A.html", None, "Item 2", None, " ")], "source_file string, part string, item string, title string, text string")
    d = readers.documents(s, {"company": "Z"}).collect()
    assert [(r["doc_id"], r["metadata"]["company"]) for r in d] == [("A.html::::Item 1", "Z")]


def test_section_dumps(spark, tmp_path):
    folder = tmp_path / "Quill"
    folder.mkdir()
    (folder / "part_iii.txt").write_text("Item 10 - Directors, Executive Officers and Governance\nThe facts required here are in our proxy statement, incorporated herein by reference.\n\nItem 11 - Executive Pay\nSee\nthe proxy.\n")
    (folder / "part_iv.txt").write_text("Item 15 - Exhibits\n(a)\nlist\n\nItem 16 - Form Summary\nNone.\n27\nReport of Independent Registered Public Accounting Firm\nWe have audited the mill.\n")
    got = readers.read_section_dumps(spark, [str(folder / "part_iii.txt"), str(folder / "part_iv.txt")]).orderBy("source_file", "seg").collect()
    assert [(r["filer"], r["source_file"], r["part"], r["item"], r["title"], r["text"], r["incorporated_by_reference"]) for r in got] == [
        ("Quill", "part_iii.txt", "PART III", "Item 10", "Directors, Executive Officers and Governance", "The facts required here are in our proxy statement, incorporated herein by reference.", True),
        ("Quill", "part_iii.txt", "PART III", "Item 11", "Executive Pay", "See\nthe proxy.", False),
        ("Quill", "part_iv.txt", "PART IV", "Item 15", "Exhibits", "(a)\nlist", False),
        ("Quill", "part_iv.txt", "PART IV", "Item 16", "Form Summary", "None.\n27", False),
        ("Quill", "part_iv.txt", "PART II", "Item 8", "Report of Independent Registered Public Accounting Firm", "We have audited the mill.", False),
    ]


def test_pages_of_one_name_stay_apart(spark, tmp_path):
    for folder, word in (("one", "alpha"), ("two", "beta")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "10k.html").write_text(f"<p>Item 1. {word}</p><p>{word} body</p>")
    pages = readers.read_html(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    chunks = pages_to_chunks(pages).orderBy("text").collect()
    assert [(c["text"], c["metadata"]["section_title"], c["chunk_id"]) for c in chunks] == [("alpha body", "alpha", "one_10k_item1_chunk_001"), ("beta body", "beta", "two_10k_item1_chunk_001")]
    ingest(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["alpha body", "beta body"]


def test_store_embeds_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        store.open("x")
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}", (None, None, "Item 1", None, "semantic", 1, 5, 2)) for i in ids], f"chunk_id string, text string, metadata {'struct<source_file:string, part:string, item:string, section_title:string, chunk_strategy:string, chunk_index:int, char_count:int, token_count:int>'}")
    assert store.build("x", rows("a")) and not store.build("x", rows("b")) and store.build("x", rows("b"), force=True)
    row = store.open("y", fallback="x").first()
    assert (row["chunk_id"], row["metadata"]["part"], len(row["embedding"])) == ("b", "", 96)
    from gleanery.operators import lexical

    asked = spark.createDataFrame([("q", "text b")], "query_id string, query string")
    assert [r["id"] for r in lexical.search(store.words("x"), asked, 2).collect()] == ["b"]
    with pytest.raises(ValueError):
        store.build("z", rows("a", "a"))
    assert not store.populated("z")


def test_stream_and_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "Quill.html").write_text(PAGE)
    ingest(spark, str(raw), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    base = ["--raw", str(raw), "--store", str(tmp_path / "db")]
    assert cli.main([*base, "ingest"]) == 0 and cli.main([*base, "ingest"]) == 0
    assert "already there" in capsys.readouterr().out
    assert cli.main([*base, "query", "We own a mill.", "-k", "1"]) == 0
    assert "Quill | Item 2" in capsys.readouterr().out
    for s in ("semantic", "recursive"):
        assert cli.main([*base, "ingest", "--strategy", s, "--collection", f"{s}_index"]) == 0
    assert cli.main([*base, "retrieve", "We own a mill."]) == 0
    assert "semantic:quill_item2_chunk_001" in capsys.readouterr().out
    assert cli.main([*base, "chunk", "--out", str(tmp_path / "chunks")]) == 0
    assert spark.read.json(str(tmp_path / "chunks")).select("strategy").distinct().count() == 3
    capsys.readouterr()
    assert cli.main([*base, "chunk", "--out", str(tmp_path / "chunks"), "--max-output-per-strategy", "1"]) == 0
    assert "fixed: 2 chunks" in capsys.readouterr().out
    assert cli.main([*base, "report"]) == 0 and "Quill.html" in capsys.readouterr().out
    assert cli.main([*base, "answer", "What do we sell?", "--strategy", "bm25"]) == 0
    assert "We sell quills. [1]\n* [1] quill_item1_chunk_001" in capsys.readouterr().out
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps({"question_id": i, "question": q, "expected_answer": "quills", "gold_chunk_ids": [g]}) for i, q, g in (("1", "What do we sell?", "quill_item1_chunk_001"), ("2", "Do we own a mill?", "quill_item2_chunk_001"))))
    assert cli.main([*base, "eval", "--gold", str(tmp_path / "gold.jsonl"), "--strategies", "bm25", "hybrid_rerank", "--top-k", "2", "--limit", "1", "--answers", "--out", str(tmp_path / "eval")]) == 0
    out = capsys.readouterr().out
    assert "hybrid_rerank" in out and "context_precision" in out
    assert spark.read.json(str(tmp_path / "eval" / "summary")).select("strategy", "n_questions").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "eval" / "results")).count() == 2
    with pytest.raises(ValueError):
        cli.search(IndexStore(spark, str(tmp_path / "db")), "cli_active_index", "  ", 1)
