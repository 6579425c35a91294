"""Schemas of the entities that are read and written."""

from __future__ import annotations

NODE = "doc string, node_idx int, text string"
SECTION = "source_file string, part string, item string, title string, text string, incorporated_by_reference boolean, oversized boolean"
CHUNK_METADATA = "struct<source_file:string, part:string, item:string, section_title:string, chunk_strategy:string, chunk_index:int, char_count:int, token_count:int>"
CHUNK = f"chunk_id string, text string, metadata {CHUNK_METADATA}"
INDEXED_CHUNK = f"chunk_id string, document string, metadata {CHUNK_METADATA}, embedding array<float>"
GOLD = "question_id string, question string, expected_answer string, answer string, gold_chunk_ids array<string>, primary_gold_chunk_ids array<string>, supporting_gold_chunk_ids array<string>"
HIT = "query_id string, id string, rank int, score double"
GENERATION_RESULT = "question_id string, question string, answer string, latency_ms double, scores struct<faithfulness:double, relevancy:double>"
