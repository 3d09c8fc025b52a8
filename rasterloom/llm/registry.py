"""The queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import op5_chat as chat
from .op1_substring_dedup import op1_substring_dedup
from .op2_simhash import op2_simhash
from .op3_ogg import op3_ogg
from .op4_suffix_dedup import op4_suffix_dedup
from .op6_minhash import op6_minhash
from .op7_html import op7_html
from .op8_language import op8_language
from .op9_mixing import op9_mixing
from .op10_packing import op10_packing

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_simhash, op3_ogg, op4_suffix_dedup, chat.op5_chat, op6_minhash, op7_html, op8_language, op9_mixing, op10_packing)}

#: Those without one hash, learn or tokenize, or are too slow in SQL on whole tables: tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_chat": chat.ORACLE,
    "op1_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS k FROM texts, unnest(range(1, len(ws) - 18)) AS t(s)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
cut AS (SELECT doc_id, list(DISTINCT s + i) AS gone FROM late, unnest(range(20)) AS u(i) GROUP BY doc_id),
words AS (SELECT doc_id, ws, generate_subscripts(ws, 1) AS p FROM texts),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(ws[p], ' ' ORDER BY p) AS body FROM words w LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM cut) c USING (doc_id, p) WHERE c.p IS NULL GROUP BY w.doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
""",
}
