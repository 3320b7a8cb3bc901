"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from shelfscope.llm.quality_rules import MEASURES, REACH

_WORD = r"[^\x20\x09-\x0D]+"


def _base32(hex_: str) -> str:
    """Each five bits of the digest, from its hexadecimal text."""
    quad = f"('0x' || substr({hex_}, 1 + 10 * (k // 8), 10))::ubigint"
    return (f"array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
            f"1 + (({quad} >> (35 - 5 * (k % 8))) & 31)::int, 1)), '')")


OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     r AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
     h AS (SELECT *, sha1(html) AS hex FROM r)
SELECT page_id, strlen(html)::bigint AS payload_bytes,
       {_base32('hex')} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""


def _fences() -> tuple[str, str]:
    """(joins of each measure's fences, condition of a document outside them)."""
    joins, outside = [], []
    for m, (high, low) in MEASURES.items():
        joins.append(f"LEFT JOIN q AS q_{m} ON q_{m}.measure = '{m}' AND q_{m}.lang IS NOT DISTINCT FROM b.lang "
                     f"AND q_{m}.source IS NOT DISTINCT FROM b.source")
        outside.append(f"coalesce({m} > q_{m}.q75 + {REACH} * greatest(q_{m}.q75 - q_{m}.q25, {high}), false)")
        if low:
            outside.append(f"coalesce({m} < q_{m}.q25 - {REACH} * greatest(q_{m}.q75 - q_{m}.q25, {low}), false)")
    return "\n".join(joins), " OR ".join(outside)


def _level(name: str, keys: str) -> str:
    part = f"{keys}, measure" if keys else "measure"
    return f"""
{name} AS (
  SELECT {part}, max(total) AS n_docs, min(CASE WHEN upto * 4 >= total THEN bin END) AS q25,
         min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q75
  FROM (SELECT {part}, bin, sum(n) OVER (PARTITION BY {part}) AS total,
               sum(n) OVER (PARTITION BY {part} ORDER BY bin) AS upto
        FROM (SELECT {part}, bin, count(*) AS n FROM s GROUP BY {part}, bin))
  GROUP BY {part})"""


def _op2() -> str:
    joins, outside = _fences()
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM b WHERE NOT base_failed"
                                for m in MEASURES)
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
           FROM documents),
     win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
             FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
     rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
     cov AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n
             FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM rep) GROUP BY doc_id),
     c AS (SELECT w.doc_id, lang, source, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
                  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols,
                  len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]'))::bigint AS n_upper, len(ls)::bigint AS n_lines,
                  (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words
           FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols_pm,
                  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines_pm,
                  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_pm,
                  CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END AS upper_pm,
                  CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_len_cc
           FROM c),
     v AS ({values}),
     s AS (SELECT lang, source, measure,
                  (v >> greatest(0, length(bin(v)) - 6)::int) << greatest(0, length(bin(v)) - 6)::int AS bin FROM v),
     {_level('own', 'lang, source')}, {_level('of_lang', 'lang')}, {_level('of_all', '')},
     q AS (SELECT own.lang, own.source, own.measure,
                  CASE WHEN own.n_docs >= 200 THEN own.q25 WHEN of_lang.n_docs >= 200 THEN of_lang.q25
                       ELSE of_all.q25 END AS q25,
                  CASE WHEN own.n_docs >= 200 THEN own.q75 WHEN of_lang.n_docs >= 200 THEN of_lang.q75
                       ELSE of_all.q75 END AS q75
           FROM own LEFT JOIN of_lang ON of_lang.lang IS NOT DISTINCT FROM own.lang AND of_lang.measure = own.measure
                LEFT JOIN of_all ON of_all.measure = own.measure)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({outside}) AS kept
FROM b
{joins}
"""


OP3 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def build() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_quality_rules": _op2(), "op3_exact_dedup": OP3}
