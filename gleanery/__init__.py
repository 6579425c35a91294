"""gleanery: passage retrieval, its evaluation, and document preparation as Spark DataFrame transformations."""

from gleanery.operators.chunking import chunk, token_windows
from gleanery.operators.dense import knn
from gleanery.operators.evaluation import evaluate, judge_results
from gleanery.operators.fusion import fuse_indexes, reciprocal_rank
from gleanery.operators.prompt import answer_questions, answering, build_messages, build_prompts
from gleanery.operators.rerank import rerank, retriever
from gleanery.operators.sections import extract_sections
from gleanery.sources.index_store import IndexStore
from gleanery.sources.readers import documents, read_html

__version__ = "0.2.0"
__all__ = ["IndexStore", "answer_questions", "answering", "build_messages", "build_prompts", "chunk", "documents", "evaluate", "extract_sections", "fuse_indexes", "judge_results", "knn", "read_html", "reciprocal_rank", "rerank", "retriever", "token_windows"]
