"""The registered queries of this subpackage; each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terazi.llm import garbled, homoglyphs, leakage, near_duplicates, personal, residue, shared_spans, splitting, tokenizing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": garbled.p1_found,
    "p1_restored": garbled.p1_restored,
    "p2_found": near_duplicates.p2_found,
    "p2_groups": near_duplicates.p2_groups,
    "p3_found": personal.p3_found,
    "p3_masked": personal.p3_masked,
    "p4_found": residue.p4_found,
    "p4_clean": residue.p4_clean,
    "p4_clean_laws": residue.p4_clean_laws,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p6_found": homoglyphs.p6_found,
    "p6_text": homoglyphs.p6_text,
    "p7_ids": tokenizing.p7_ids,
    "p8_found": leakage.p8_found,
    "p8_edited": leakage.p8_edited,
    "p9_found": shared_spans.p9_found,
    "p9_share": shared_spans.p9_share,
    "p9_kept": shared_spans.p9_kept,
}
#: The plain definitions of TESTDATA.md in SQL, for tables small enough for all windows and shingles.
_LOWER = "lower(translate({}, 'İI', 'iı'))"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[\p{{L}}\p{{N}}]+')"


def _plain(column: str) -> str:
    e = column
    for _ in range(2):
        e = rf"regexp_replace(regexp_replace({e}, '(?is)<(?:style\b[^>]*>.*?</style\s*>|script\b[^>]*>.*?</script\s*>)', ' ', 'g'), '</?[A-Za-z!][^<>]*>', ' ', 'g')"
        for mark, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
            e = f"replace({e}, '{mark}', '{sign}')"
    return e


ORACLE_SQL: dict[str, str] = {
    "p2_found": f"""WITH t AS (SELECT id, metin AS x FROM karar_kaydi WHERE metin IS NOT NULL UNION SELECT karar_id, tam_metin FROM karar WHERE tam_metin IS NOT NULL),
        w AS (SELECT id, row_number() OVER () AS n, {_WORDS.format(_plain("x"))} AS w FROM t),
        g AS (SELECT DISTINCT id, n, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 40),
        s AS (SELECT n, any_value(id) AS id, count(*) AS k FROM g GROUP BY n),
        c AS (SELECT a.n AS na, b.n AS nb, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM c JOIN s x ON x.n = na JOIN s y ON y.n = nb WHERE c::DOUBLE / (x.k + y.k - c) >= 0.6""",
    "p5_found": r"""WITH t AS (SELECT kayit_no, string_split(gerekce, chr(10)) AS l, string_split(regexp_replace(gerekce, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS c, regexp_split_to_array(gerekce, '\s+') AS w
            FROM karar WHERE length(gerekce) > 1500),
        m AS (SELECT kayit_no, list_max(list_transform(l, lambda x: length(x))) AS l, list_max(list_transform(c, lambda x: length(x))) AS c, list_max(list_transform(w, lambda x: length(x))) AS w FROM t)
    SELECT kayit_no, CASE WHEN l <= 1500 THEN 'paragraf' WHEN c <= 1500 THEN 'cumle' WHEN w <= 1500 THEN 'sozcuk' ELSE 'harf' END AS sinir FROM m""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), p AS (SELECT item_id, {_WORDS.format("soru")} AS w FROM olcum_ogesi UNION ALL SELECT item_id, {_WORDS.format("dayanak")} FROM olcum_ogesi),
        dg AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        pg AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM p WHERE len(w) >= 12)
    SELECT DISTINCT doc_id, item_id FROM dg JOIN pg USING (g)""",
    "p9_found": """WITH w AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299))::INT AS i FROM documents WHERE length(text) >= 300),
        h AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM w), s AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)),
        o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS yeni FROM h SEMI JOIN s USING (h)),
        r AS (SELECT doc_id, i, sum(yeni) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT doc_id, min(i)::INT AS bas, (max(i) + 300 - min(i))::INT AS uzunluk FROM r GROUP BY doc_id, k""",
}
