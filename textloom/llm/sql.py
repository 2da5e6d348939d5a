"""DuckDB SQL that checks the queries of the llm subpackage on whole tables."""

from __future__ import annotations

from textloom.functions.text import SQL_TERM


def _terms(table: str, key: str) -> str:
    return f"SELECT {key} AS id, lower(replace(unnest(regexp_extract_all(coalesce(text, ''), '{SQL_TERM}')), '’', '''')) AS term FROM (SELECT DISTINCT {key}, text FROM {table})"


_DICT = "SELECT term, sum(df) AS df, count(*) AS runs FROM (SELECT DISTINCT run_id, term, df FROM term_record) GROUP BY term"
_P2 = f"""WITH t AS ({_terms("dump_article", "page_id")}),
 n AS (SELECT count(DISTINCT id) AS n FROM t),
 a AS (SELECT 'article' AS scope, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY term),
 m AS (SELECT count(*) AS n FROM corpus_record WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
 d AS ({_DICT}),
 b AS (SELECT scope, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * n THEN 'common' END AS mark FROM a, n
  UNION ALL SELECT 'record', term, df, runs, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.2 * n THEN 'common' END FROM d, m)
"""
_P5 = """WITH r AS (SELECT DISTINCT query_id, doc_id, external_id, score + 0.0 AS score FROM search_result WHERE score IS NOT NULL AND NOT isnan(score)),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, external_id ASC NULLS LAST, doc_id ASC) AS place FROM r)
"""
_P7 = f"""WITH t AS ({_terms("corpus_record", "ordinal")}),
 j AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term),
 n AS (SELECT count(DISTINCT id) AS n FROM t),
 d AS ({_DICT}),
 s AS (SELECT id, pow(sum(tf), 0.75) AS s FROM j GROUP BY id),
 z AS (SELECT sum(s) AS z FROM s)
"""
SQL = {
    "p2_found": _P2 + "SELECT scope, term FROM b WHERE mark IS NOT NULL",
    "p2_terms": _P2 + "SELECT scope, term, CAST(occurrences AS BIGINT) AS occurrences, records, mark FROM b",
    "p5_found": _P5 + "SELECT query_id, doc_id FROM p WHERE place <= 10",
    "p5_ranked": _P5 + "SELECT query_id, place, doc_id, external_id, score FROM p WHERE place <= 10",
    "p7_found": _P7 + ", w AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n / df), 6) DESC, term) AS k FROM j JOIN d USING (term), n) SELECT id AS ordinal, term FROM w WHERE k <= 3",
    "p7_ppmi": _P7 + "SELECT id AS ordinal, term, tf, CAST(df AS BIGINT) AS df, round(greatest(0, ln(1.0 / df / (s / z))), 6) AS ppmi FROM j JOIN d USING (term) JOIN s USING (id), z",
}
