"""Command line: ingest pages into a collection, query it, chunk and check pages, retrieve from one or two collections,
answer questions, evaluate strategies and answers."""

from __future__ import annotations

import argparse
import functools
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import analysis, chunking, dense, evaluation, fusion, prompt, rerank, validation
from gleanery.providers import HashEmbedder, OverlapJudgeOfFour, embed_column
from gleanery.session import cut, local_session
from gleanery.sources import readers
from gleanery.sources.index_store import IndexStore, write_chunks, write_results
from gleanery.streaming.ingest import pages_to_chunks, pages_to_sections


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanery", description=__doc__)
    p.add_argument("--raw", default="data/raw", help="folder of pages")
    p.add_argument("--store", default="db", help="folder of collections")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="chunk, embed and store pages")
    i.add_argument("--html", nargs="*", help="pages by name or path; all of the folder by default")
    i.add_argument("--strategy", default="semantic", choices=sorted(chunking.STRATEGIES))
    i.add_argument("--collection", default="cli_active_index")
    i.add_argument("--force", action="store_true", help="build anew even if there is one")
    q = sub.add_parser("query", help="nearest chunks of a question")
    q.add_argument("text")
    q.add_argument("-k", type=int, default=5)
    q.add_argument("--collection", default="cli_active_index")
    c = sub.add_parser("chunk", help="chunk pages and write them")
    c.add_argument("--html", nargs="*")
    c.add_argument("--out", default="data/chunks")
    c.add_argument("--fixed-size", type=int, default=chunking.FIXED_SIZE)
    c.add_argument("--fixed-overlap", type=int, default=chunking.FIXED_OVERLAP)
    c.add_argument("--recursive-size", type=int, default=chunking.RECURSIVE_SIZE)
    c.add_argument("--semantic-min", type=int, default=chunking.SEMANTIC_MIN)
    c.add_argument("--semantic-max", type=int, default=chunking.SEMANTIC_MAX)
    c.add_argument("--semantic-threshold", type=float, default=chunking.SEMANTIC_BREAK)
    c.add_argument("--max-output-per-strategy", type=int, default=None, help="print that many chunks of each strategy")
    r = sub.add_parser("retrieve", help="search one collection or fuse two")
    r.add_argument("text")
    r.add_argument("--collection", default="fused", choices=("semantic", "recursive", "fused"))
    r.add_argument("-n", type=int, default=5)
    a = sub.add_parser("answer", help="retrieve, then answer with citations")
    a.add_argument("text")
    a.add_argument("--collection", default="cli_active_index")
    a.add_argument("--strategy", default="hybrid_rerank", choices=rerank.STRATEGIES)
    a.add_argument("-k", type=int, default=5)
    a.add_argument("--bare", action="store_true", help="the second engine's prompt: passages without numbers")
    e = sub.add_parser("eval", help="score strategies, and on demand answers, against gold questions")
    e.add_argument("--gold", required=True, help="gold questions as JSON lines")
    e.add_argument("--collection", default="cli_active_index")
    e.add_argument("--strategies", nargs="*", default=list(rerank.STRATEGIES), choices=rerank.STRATEGIES)
    e.add_argument("--top-k", type=int, default=10)
    e.add_argument("--pool", type=int, default=20)
    e.add_argument("--limit", type=int, default=None, help="only the first questions by id")
    e.add_argument("--answers", action="store_true", help="answer by the last strategy and judge the answers")
    e.add_argument("--out", default=None, help="folder for results and summary")
    f = sub.add_parser("report", help="parts, items and gaps of pages")
    f.add_argument("--html", nargs="*")
    return p


def print_table(rows: DataFrame) -> None:
    """A small table, such as one row a strategy or filing."""
    rows.show(rows.count(), truncate=False)


def collection_corpus(store: IndexStore, name: str) -> DataFrame:
    """A collection as retrievers and prompts read it."""
    m = F.col("metadata")
    return store.open(name).select(F.col("chunk_id").alias("id"), F.col("document").alias("text"), "embedding", m["source_file"].alias("source_file"), m["item"].alias("item"), m["section_title"].alias("title"))


def run_eval(store: IndexStore, args) -> int:
    gold = readers.read_gold(store.spark, args.gold)
    if args.limit is not None:
        gold = gold.orderBy("question_id").limit(args.limit)
    gold = cut(gold)
    corpus = collection_corpus(store, args.collection)
    index = store.words(args.collection)
    asked = gold.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    lists = gold.select(F.col("question_id").alias("query_id"), evaluation.all_gold("gold_chunk_ids", "primary_gold_chunk_ids", "supporting_gold_chunk_ids").alias("gold"), evaluation.all_gold("primary_gold_chunk_ids").alias("prime"))
    asked = cut(embed_column(asked, "query", HashEmbedder))
    ways = {s: rerank.retriever(corpus, s, args.top_k, args.pool, index=index) for s in args.strategies}
    results, summary = evaluation.evaluate(ways, asked, lists)
    print_table(analysis.summary_table(summary))
    if args.out:
        write_results(results, f"{args.out}/results")
        summary.write.mode("overwrite").json(f"{args.out}/summary")
    if args.answers:
        answers = prompt.answering(ways[args.strategies[-1]], corpus)(asked)
        expected = gold.select(F.col("question_id").alias("query_id"), F.coalesce(F.nullif("expected_answer", F.lit("")), "answer").alias("expected"))
        records = cut(prompt.records(answers, expected))
        scores = evaluation.judge_results(records, OverlapJudgeOfFour)
        print_table(evaluation.judge_means(scores.join(records.select("query_id", "latency_gen_ms"), "query_id"), {m: F.col(m) for m in OverlapJudgeOfFour.metrics}, F.col("latency_gen_ms")))
        if args.out:
            records.join(scores, "query_id").write.mode("overwrite").json(f"{args.out}/answers")
    return 0


def search(store: IndexStore, collection: str, text: str, k: int) -> DataFrame:
    """Hits of one question with their texts. A blank question is an error."""
    if not text.strip():
        raise ValueError("the question is blank")
    index = store.open(collection)
    question = embed_column(store.spark.createDataFrame([("q", text)], "query_id string, query string"), "query", HashEmbedder)
    hits = dense.knn(index, question, k, 96, "chunk_id", "embedding", "query_id", "embedding")
    return hits.join(index.select(F.col("chunk_id").alias("id"), "document", "metadata"), "id")


def show(hits: DataFrame) -> int:
    rows = hits.select("rank", "id", T.company("metadata.source_file").alias("company"), "metadata.item", T.preview("document").alias("preview")).orderBy("rank").collect()  # at most k rows
    for r in rows:
        print(f"{r['rank']}. {r['company']} | {r['item']} | {r['id']}\n{r['preview']}\n")
    return 0 if rows else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    store = IndexStore(spark, args.store)
    if args.command == "ingest":
        pages = readers.read_html(spark, readers.html_paths(args.raw, args.html))
        written = store.build(args.collection, pages_to_chunks(pages, args.strategy), args.force)
        print("built" if written else "already there", args.collection)
        return 0
    if args.command in ("chunk", "report"):
        pages = readers.read_html(spark, readers.html_paths(args.raw, args.html))
        s = cut(pages_to_sections(pages))  # read by each strategy
        if args.command == "report":
            print_table(validation.filing_summary(s).orderBy("source_file"))
            return 0
        ways = {"fixed": {"size": args.fixed_size, "overlap": args.fixed_overlap}, "recursive": {"size": args.recursive_size}, "semantic": {"least": args.semantic_min, "most": args.semantic_max, "threshold": args.semantic_threshold}}
        chunks = {name: chunking.chunk(s, name, **options) for name, options in ways.items()}
        write_chunks(functools.reduce(DataFrame.union, chunks.values()), args.out)
        if args.max_output_per_strategy is not None:
            for name, rows in chunks.items():
                print(f"{name}: {rows.count()} chunks")
                for r in rows.select("chunk_id", T.preview("text").alias("preview")).limit(args.max_output_per_strategy).collect():
                    print(f"{r['chunk_id']}\n{r['preview']}\n")
        return 0
    if args.command == "eval":
        return run_eval(store, args)
    if args.command == "answer":
        if not args.text.strip():
            raise ValueError("the question is blank")
        corpus = collection_corpus(store, args.collection)
        asked = spark.createDataFrame([("q", args.text)], "query_id string, query string")
        row = prompt.answering(rerank.retriever(corpus, args.strategy, args.k, index=store.words(args.collection)), corpus, numbered=not args.bare)(asked).first()
        print(row["answer"])
        for c in row["chunks"]:
            print(f"{'*' if c['rank'] in row['cited_indices'] else ' '} [{c['rank']}] {c['id']}")
        return 0
    if args.command == "query":
        return show(search(store, args.collection, args.text, args.k))
    if args.collection != "fused":
        return show(search(store, f"{args.collection}_index", args.text, args.n))
    lists = {n: search(store, f"{n}_index", args.text, 8) for n in ("semantic", "recursive")}
    rows = fusion.fuse_indexes(lists, args.n).orderBy("rank").collect()  # at most n rows
    for r in rows:
        print(f"{r['rank']}. {r['key']} ({r['score']:.6f})")
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
