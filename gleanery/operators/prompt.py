"""Prompts with numbered passages, and the citations of answers."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.providers import ExtractiveGenerator, Generator
from gleanery.session import cut, map_arrow

# The texts around passages and question, the rules of the first turn, and the reply where there is no passage.
INTRODUCTION = "Context passages from SEC 10-K filings:"
REQUEST = "Answer (cite each claim with [n]):"
NOTHING = "No context passages were retrieved for this question."
SYSTEM = """You are a financial analyst assistant specialising in SEC 10-K annual report analysis.

Rules:
1. Answer using ONLY the numbered context passages provided. Do not use outside knowledge.
2. Cite every factual claim with an inline reference like [1] or [2]. Multiple citations
   per sentence are fine, e.g. [1][3].
3. If the context passages do not contain enough information to answer, say:
   "The provided context does not contain sufficient information to answer this question."
4. Be concise and precise. Avoid repeating the question. Do not speculate.
5. Financial figures should be quoted exactly as they appear in the source passages."""
MAX_TOKENS = 1024


def passage(i: Column, source_file: Column, item: Column, title: Column, text: Column) -> Column:
    """``[i] company | item — title`` and the text below; a missing file or item is ``?``, a missing title left out."""
    head = F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(T.company(source_file), F.lit("?")), F.lit(" | "), F.coalesce(item, F.lit("?")))
    return F.concat(head, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" — "), title)).otherwise(""), F.lit("\n"), T.trim_ws(F.coalesce(text, F.lit(""))))


def _hit_text(columns: list[str]) -> Column:
    """The text of a hit: ``text``, or ``document`` where that is empty."""
    known = [F.nullif(F.col(c), F.lit("")) for c in ("text", "document") if c in columns]
    return F.coalesce(*known, F.lit(""))


def build_prompts(questions: DataFrame, hits: DataFrame, introduction: str = INTRODUCTION, request: str = REQUEST, numbered: bool = True) -> DataFrame:
    """``query_id``, ``prompt`` and ``passages`` of questions (``query_id``, ``query``) with hits (``query_id``, ``rank``, ``text`` or ``document``,
    and for numbered passages ``source_file``, ``item``, ``title``). Passages are numbered by rank, or stand as bare texts with a
    blank line between; a question without hits has a prompt without passages."""
    text = _hit_text(hits.columns)
    block = passage(F.col("rank"), F.col("source_file"), F.col("item"), F.col("title"), text) if numbered else T.trim_ws(text)
    blocks = hits.select("query_id", F.struct("rank", block.alias("block")).alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    joined = questions.select("query_id", "query").join(blocks, "query_id", "left")
    context = F.coalesce(F.array_join(F.col("b.block"), "\n\n---\n\n" if numbered else "\n\n"), F.lit(""))
    prompt = F.concat(F.lit(f"{introduction}\n\n"), context, F.lit("\n\n---\n\nQuestion: "), F.coalesce("query", F.lit("")), F.lit(f"\n\n{request}"))
    return joined.select("query_id", prompt.alias("prompt"), F.coalesce(F.size("b"), F.lit(0)).alias("passages"))


def build_messages(prompts: DataFrame, system: str = SYSTEM) -> DataFrame:
    """The turns of each prompt, one row each: ``query_id``, ``turn`` from 0, ``role`` (system, then user) and ``text``."""
    turns = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("text")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")))
    return prompts.select("query_id", F.posexplode(turns).alias("turn", "m")).select("query_id", "turn", "m.role", "m.text")


def citations(answer: Column | str) -> Column:
    """The distinct numbers in square brackets, in order; numbers no passage has are kept."""
    found = F.regexp_extract_all(T._c(answer), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())))


def cited(answer: Column | str, chunks: Column) -> Column:
    """The elements of ``chunks`` that an answer cites; citations out of range are dropped."""
    return F.transform(F.filter(citations(answer), lambda i: (i >= 1) & (i <= F.size(chunks))), lambda i: F.try_element_at(chunks, i.cast("int")))


def generate(prompts: DataFrame, make: Callable[[], Generator] = ExtractiveGenerator, system: str = SYSTEM, max_tokens: int = MAX_TOKENS, temperature: float = 0.0) -> DataFrame:
    """``query_id``, ``answer``, ``model``, ``latency_ms`` (of a batch, shared by its prompts), ``prompt_tokens`` and ``completion_tokens``.

    A prompt without passages does not reach the model: its answer is the fixed one, its latency and tokens are 0.
    """
    kind = prompts.schema["query_id"].dataType.simpleString()
    names = ["query_id", "answer", "model", "latency_ms", "prompt_tokens", "completion_tokens"]

    def run(batches):
        model = make()
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            asked = [p for p, n in rows if n]
            began = time.perf_counter()
            answers = iter(model.answer(system, asked, max_tokens, temperature) if asked else [])
            each = round(1000 * (time.perf_counter() - began) / max(len(asked), 1), 1)
            out = [(*next(answers), each) if n else (NOTHING, 0, 0, 0.0) for _, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] or "" for o in out], pa.string()), pa.array([model.model] * len(out), pa.string()), pa.array([o[3] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=names)

    return map_arrow(prompts.select("query_id", "prompt", "passages"), run, f"query_id {kind}, answer string, model string, latency_ms double, prompt_tokens int, completion_tokens int")


def answer_questions(questions: DataFrame, hits: DataFrame, make: Callable[[], Generator] = ExtractiveGenerator, numbered: bool = True, system: str = SYSTEM, max_tokens: int = MAX_TOKENS, temperature: float = 0.0) -> DataFrame:
    """From questions and their hits to answers, one row a question.

    ``query_id``, ``question``, ``answer``, ``chunks`` (hits in order: rank, id, text, score), ``cited_indices`` (all numbers the answer cites),
    ``cited_chunks`` (those in range), ``contexts`` and ``cited_contexts`` (texts of both), ``model``, ``latency_ms``, ``prompt_tokens``,
    ``completion_tokens``. ``numbered`` false gives the second engine's form: bare passages; rules and prompt are one text for it, so
    ``system`` goes before them. A hit without a score counts as 0.
    """
    prompts = build_prompts(questions, hits, numbered=numbered)
    if not numbered:
        prompts = prompts.withColumn("prompt", F.concat(F.lit(f"{system}\n\n"), "prompt"))
    answers = generate(prompts, make, system if numbered else "", max_tokens, temperature)
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in hits.columns else F.lit(0.0)
    one = F.struct("rank", F.col("id").cast("string").alias("id"), _hit_text(hits.columns).alias("text"), score.alias("score"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    none = F.array().cast(lists.schema["chunks"].dataType)
    rows = questions.select("query_id", F.col("query").alias("question")).join(answers, "query_id").join(lists, "query_id", "left").withColumn("chunks", F.coalesce("chunks", none))
    rows = rows.withColumn("cited_indices", F.when(F.size("chunks") > 0, citations("answer")).otherwise(F.array().cast("array<bigint>"))).withColumn("cited_chunks", cited("answer", F.col("chunks")))
    return rows.select("query_id", "question", "answer", "chunks", "cited_indices", "cited_chunks", F.col("chunks.text").alias("contexts"), F.col("cited_chunks.text").alias("cited_contexts"), "model", "latency_ms", "prompt_tokens", "completion_tokens")


def answering(retrieve: Callable[[DataFrame], DataFrame], corpus: DataFrame, **options) -> Callable[[DataFrame], DataFrame]:
    """A function from questions (``query_id``, ``query``) to ``answer_questions`` over what the retriever finds.

    ``corpus``: ``id``, ``text`` and, for numbered passages, ``source_file``, ``item``, ``title``.
    """

    def run(questions: DataFrame) -> DataFrame:
        hits = cut(retrieve(questions))  # few rows a question, read for prompts and for results
        return answer_questions(questions, hits.join(corpus, "id"), **options)

    return run


def records(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers beside what was expected, as judges read them: ``query_id``, ``question``, ``answer``, ``contexts``, ``ground_truth``
    ('' where there is none), ``latency_gen_ms``, ``prompt_tokens``, ``completion_tokens``. ``gold``: ``query_id``, ``expected``."""
    rows = answers.join(gold.select("query_id", "expected"), "query_id", "left")
    return rows.select("query_id", "question", "answer", F.transform("contexts", T.trim_ws).alias("contexts"), F.coalesce("expected", F.lit("")).alias("ground_truth"), F.col("latency_ms").alias("latency_gen_ms"), "prompt_tokens", "completion_tokens")


def source_panel(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Hits (``query_id``, ``rank``, scores by stage) with ``is_cited`` by their answer and the ``score`` of the last stage that gave one:
    ``rerank_score``, ``rrf_score``, ``score``, ``distance``; stages that are no column are passed over."""
    known = [F.col(c) for c in ("rerank_score", "rrf_score", "score", "distance") if c in hits.columns]
    cited_numbers = answers.select("query_id", citations("answer").alias("cited"))
    joined = hits.join(cited_numbers, "query_id", "left")
    others = [c for c in hits.columns if c != "score"]
    return joined.select(*others, (F.coalesce(*known) if known else F.lit(None).cast("double")).alias("score"), F.coalesce(F.array_contains("cited", F.col("rank").cast("bigint")), F.lit(False)).alias("is_cited"))
