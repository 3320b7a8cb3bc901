"""Oracle SQL for the page-log queries (block diagnosis, breaker, paging stop)."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_sql import _with, q, sku_sql

PLOG = f"""plog AS (
  SELECT CASE WHEN contains(url, '.example.com') THEN {q(rules.STORE_B)} ELSE {q(rules.STORE_A)} END AS loja,
         url, page_id AS seq, CASE WHEN page_id % 10 = 7 THEN 403 ELSE 200 END AS status_code,
         CASE WHEN page_id % 10 = 7 THEN html || '<div>captcha</div>' ELSE html END AS body
  FROM pages)"""


def diag_cte() -> str:
    low = "lower(coalesce(body, ''))"
    ind = "CASE " + " ".join(f"WHEN contains({low}, {q(t)}) THEN {q(t)}" for t in rules.BLOCK_INDICATORS) + " END"
    codes = ", ".join(str(c) for c in rules.BLOCK_STATUS_CODES)
    title = "regexp_extract(coalesce(body, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"
    title = f"substr(regexp_replace(regexp_replace({title}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 80)"
    return f"""diag AS (
  SELECT *, {ind} AS indicio,
         ({ind}) IS NOT NULL OR coalesce(status_code IN ({codes}), false) AS suspeita_waf,
         {title} AS title, CAST(length(coalesce(body, '')) AS INTEGER) AS bytes
  FROM plog)"""


def build_ingest() -> dict[str, str]:
    s: dict[str, str] = {}
    s["block_diagnosis"] = _with(PLOG, diag_cte()) + \
        "SELECT seq, loja, status_code, suspeita_waf, indicio, title, bytes FROM diag"
    s["breaker_prefix"] = _with(PLOG, diag_cte()) + """,
fb AS (SELECT loja, min(seq) AS first_bad FROM diag WHERE suspeita_waf GROUP BY loja),
j AS (SELECT d.*, fb.first_bad FROM diag d LEFT JOIN fb USING (loja)),
calls AS (SELECT loja, count(*) AS chamadas, bool_or(first_bad IS NOT NULL) AS breaker_ativado
          FROM j WHERE first_bad IS NULL OR seq <= first_bad GROUP BY loja)
SELECT j.loja, j.seq, j.url, calls.chamadas, calls.breaker_ativado
FROM j JOIN calls USING (loja) WHERE j.first_bad IS NULL OR j.seq < j.first_bad"""
    s["page_prefix"] = f"""
WITH l AS (SELECT l_returnflag AS route, l_linenumber AS page, {sku_sql('l_partkey')} AS sku FROM lineitem),
fs AS (SELECT route, sku, min(page) AS f FROM l WHERE sku IS NOT NULL GROUP BY 1, 2),
pp AS (SELECT route, page, count(sku) AS n_itens FROM l GROUP BY 1, 2),
np AS (SELECT route, f AS page, count(*) AS n_novos FROM fs GROUP BY 1, 2),
pg AS (SELECT pp.route, pp.page, pp.n_itens, coalesce(np.n_novos, 0) AS n_novos
       FROM pp LEFT JOIN np ON pp.route = np.route AND pp.page = np.page),
st AS (SELECT route, min(page) AS s FROM pg WHERE n_itens = 0 OR n_novos = 0 GROUP BY 1)
SELECT pg.route, pg.page, pg.n_itens, pg.n_novos FROM pg LEFT JOIN st ON pg.route = st.route
WHERE st.s IS NULL OR pg.page < st.s"""
    return s
