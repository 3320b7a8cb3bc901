"""Oracle SQL for table maintenance queries."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_sql import HIST_CTE, _with, obs_cte, rn, sku_sql, store_sql

UPSERT_LAG_DAYS = 30


def _obs_batched() -> str:
    sku = sku_sql("l_suppkey")
    return f"""split AS (SELECT CAST(max(l_shipdate) AS DATE) - INTERVAL {UPSERT_LAG_DAYS} DAY AS s FROM lineitem),
obsb AS (
  SELECT {sku} AS sku, {store_sql(sku)} AS loja, CAST(l_shipdate AS DATE) AS data_coleta,
         {rn('l_extendedprice / l_quantity')} AS preco,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'part ' || CAST(l_partkey AS VARCHAR) END AS titulo,
         CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag END AS categoria,
         l_shipdate AS ts, l_orderkey AS seq1, CAST(l_linenumber AS BIGINT) AS seq2,
         CASE WHEN CAST(l_shipdate AS DATE) >= (SELECT s FROM split) AND l_returnflag = 'R' THEN 1 ELSE 0 END
           AS batch
  FROM lineitem),
merged AS (
  SELECT sku, loja, data_coleta, min(preco) AS preco_min_dia,
         arg_max(preco, (batch, ts, seq1, seq2)) AS preco_ultimo,
         coalesce(arg_max(titulo, (batch, ts, seq1, seq2)) FILTER (WHERE titulo <> ''), '') AS titulo,
         coalesce(arg_max(categoria, (batch, ts, seq1, seq2)) FILTER (WHERE categoria <> ''), '') AS categoria,
         arg_max(ts, (batch, ts, seq1, seq2)) AS atualizado_em
  FROM obsb GROUP BY sku, loja, data_coleta)"""


FEED_TS = "CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS TIMESTAMP)"


def _counts() -> str:
    return f"""ref AS (SELECT max(data_coleta) AS d FROM hist),
c_p AS (SELECT count(*) FILTER (WHERE data_coleta < ref.d - INTERVAL {rules.RETENTION_PRICE_DAYS} DAY) AS removidos,
               count(*) FILTER (WHERE NOT (data_coleta < ref.d - INTERVAL {rules.RETENTION_PRICE_DAYS} DAY)
                                OR data_coleta IS NULL) AS restantes
        FROM hist, ref)"""


def build_maint() -> dict[str, str]:
    s: dict[str, str] = {}
    s["price_upsert_merge"] = "WITH " + _obs_batched() + "\nSELECT * FROM merged"
    s["history_row_count"] = _with(obs_cte(), HIST_CTE) + "SELECT count(*) AS linhas FROM hist"
    s["retention_purge"] = _with(obs_cte(), HIST_CTE, _counts()) + f""",
ev_ref AS (SELECT max(ts) AS t FROM events),
posted AS (SELECT ts AS postado_em FROM events WHERE event_type = 'purchase'),
feed AS (SELECT {FEED_TS} AS publicado_em FROM documents),
feed_ref AS (SELECT max(publicado_em) AS t FROM feed)
SELECT 'historico_precos' AS tabela, removidos, restantes FROM c_p
UNION ALL
SELECT 'historico_postados', count(*) FILTER (WHERE postado_em < ev_ref.t - INTERVAL {rules.RETENTION_POSTED_DAYS} DAY),
       count(*) FILTER (WHERE NOT (postado_em < ev_ref.t - INTERVAL {rules.RETENTION_POSTED_DAYS} DAY)
                        OR postado_em IS NULL)
FROM posted, ev_ref
UNION ALL
SELECT 'pautas_rss', count(*) FILTER (WHERE publicado_em < feed_ref.t - INTERVAL {rules.RETENTION_TOPIC_DAYS} DAY),
       count(*) FILTER (WHERE NOT (publicado_em < feed_ref.t - INTERVAL {rules.RETENTION_TOPIC_DAYS} DAY)
                        OR publicado_em IS NULL)
FROM feed, feed_ref"""
    s["row_loss_guard"] = _with(obs_cte(), HIST_CTE, _counts()) + f""",
scen AS (SELECT 'expurgo_justificado' AS cenario, removidos + restantes AS baseline, restantes AS atuais,
                removidos AS justificados FROM c_p
         UNION ALL
         SELECT 'sem_justificativa', removidos + restantes, restantes, CAST(0 AS BIGINT) FROM c_p),
g AS (SELECT *, greatest(0, baseline - greatest(0, justificados)) AS esperado FROM scen),
g2 AS (SELECT *, CASE WHEN baseline > 0 THEN greatest(0, esperado - atuais) / baseline ELSE 0.0 END AS pct FROM g)
SELECT cenario, baseline, atuais, justificados,
       NOT ((baseline > 0 AND atuais = 0) OR (baseline > 0 AND pct > {rules.MAX_ROW_LOSS})) AS ok,
       CASE WHEN baseline > 0 AND atuais = 0 THEN 'banco_vazio_com_baseline_positivo'
            WHEN baseline > 0 AND pct > {rules.MAX_ROW_LOSS}
              THEN printf('queda_anomala_linhas (%d vs esperado %d)', atuais, esperado)
            ELSE 'ok' END AS motivo,
       floor(pct * 10000.0 + 0.5) / 100.0 AS queda_injustificada_pct
FROM g2"""
    last = "CASE WHEN titulo <> '' AND preco_ultimo <> 0 THEN preco_ultimo END"
    mn = "CASE WHEN preco_min_dia <> 0 THEN preco_min_dia END"
    s["legacy_price_migration"] = _with(obs_cte(), HIST_CTE) + f"""
SELECT sku, loja, data_coleta, coalesce({last}, {mn}) AS preco, coalesce({mn}, {last}, {mn}) AS preco_min_inicial
FROM hist WHERE coalesce({last}, {mn}) IS NOT NULL"""
    return s
