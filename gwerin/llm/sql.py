"""DuckDB SQL of this package's queries, where SQL can express them."""

from __future__ import annotations

P4 = """
SELECT c.caption_id, (
    SELECT w.word_id FROM words w
    WHERE w.video_url = c.video_url AND w.word_end IS NOT NULL AND abs(round(w.word_end * 1000000) - round(c.segment_start * 1000000)) <= 200000
    ORDER BY abs(round(w.word_end * 1000000) - round(c.segment_start * 1000000)), w.word_end, w.word_id LIMIT 1) AS word_id
FROM captions c
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": f"SELECT caption_id, word_id FROM ({P4}) WHERE word_id IS NOT NULL"}
