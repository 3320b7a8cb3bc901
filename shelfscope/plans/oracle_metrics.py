"""Oracle SQL for run, engagement and sales metrics."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_sql import _with, rn

RUNS = f"""runs0 AS (
  SELECT CAST(ts AS DATE) AS run_date,
         count(*) FILTER (WHERE event_type = 'view') AS raspados_ml,
         count(*) FILTER (WHERE event_type = 'click') AS raspados_magalu,
         count(*) FILTER (WHERE event_type = 'purchase') AS postados_telegram,
         count(*) FILTER (WHERE event_type = 'signup') AS postados_threads,
         count(*) FILTER (WHERE event_type = 'error') AS postados_facebook,
         count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS postados_x,
         count(DISTINCT user_id) AS membros_telegram,
         max(CASE WHEN event_type = 'signup' AND value > 90 THEN user_id END) AS seguidores_facebook,
         count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS alcance_fb_28d
  FROM events GROUP BY 1),
runs AS (
  SELECT *, CASE WHEN postados_telegram = 0 THEN 'ALERTA_TG'
                 WHEN raspados_ml = 0 OR raspados_magalu = 0 THEN 'PARCIAL' ELSE 'OK' END AS status,
         {rn(f'postados_x * {rules.X_COST_PER_POST}', 4)} AS custo_x_usd
  FROM runs0)"""

KPIS = f"""kpis0 AS (
  SELECT count(*) AS total_runs,
         CAST(coalesce(sum(postados_telegram), 0) AS BIGINT) AS total_tg,
         CAST(coalesce(sum(postados_threads), 0) AS BIGINT) AS total_threads,
         CAST(coalesce(sum(postados_facebook), 0) AS BIGINT) AS total_fb,
         CAST(coalesce(sum(postados_x), 0) AS BIGINT) AS total_x,
         CAST(coalesce(sum(CAST(floor(custo_x_usd * 10000.0 + 0.5) AS BIGINT)), 0) AS DOUBLE) / 10000.0 AS usd
  FROM runs),
kpis AS (
  SELECT total_runs, total_tg, total_threads, total_fb, total_x,
         total_tg + total_threads + total_fb + total_x AS total_posts,
         {rn('usd', 4)} AS total_x_usd, {rn(f'usd * {rules.USD_BRL}', 2)} AS total_x_brl
  FROM kpis0)"""

POSTS = """posts AS (
  SELECT user_id, date_trunc('hour', ts) AS created_time,
         count(*) FILTER (WHERE event_type = 'click') AS likes,
         count(*) FILTER (WHERE event_type = 'signup') AS comments,
         count(*) FILTER (WHERE event_type = 'purchase') AS shares,
         'post of user ' || CAST(user_id AS VARCHAR) || chr(10) || CAST(count(*) AS VARCHAR) || ' events: '
           || array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS message
  FROM events GROUP BY 1, 2),
pe AS (
  SELECT *, likes + comments * 2 + shares * 3 AS score,
         CASE WHEN length(trim(replace(coalesce(message, '(Post sem texto / Mídia)'), chr(10), ' '))) > 78
              THEN substr(trim(replace(coalesce(message, '(Post sem texto / Mídia)'), chr(10), ' ')), 1, 75) || '...'
              ELSE trim(replace(coalesce(message, '(Post sem texto / Mídia)'), chr(10), ' ')) END AS title
  FROM posts)"""

LEDGER = f"""ledger AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS platform,
         o_custkey % 50 AS clicks, o_custkey % 5 AS sales, {rn('o_totalprice * 0.05')} AS commission,
         o_orderstatus AS note
  FROM orders)"""


def build_metrics() -> dict[str, str]:
    s: dict[str, str] = {}
    s["run_status"] = _with(RUNS) + "SELECT * FROM runs"
    s["category_totals"] = """
WITH c AS (SELECT CAST(ts AS DATE) AS run_date, trim(coalesce(event_type, 'Geral')) AS categoria,
                  count(*) AS qtd FROM events GROUP BY 1, 2),
tot AS (SELECT categoria, CAST(sum(qtd) AS BIGINT) AS total FROM c GROUP BY 1)
SELECT categoria, total, CAST(floor(total / (SELECT max(total) FROM tot) * 100.0 + 0.5) AS BIGINT) AS pct
FROM tot ORDER BY total DESC, categoria LIMIT 7"""
    s["run_kpis"] = _with(RUNS, KPIS) + "SELECT * FROM kpis"
    s["audience_deltas"] = _with(RUNS) + """
, a AS (
  SELECT arg_min(membros_telegram, run_date) FILTER (WHERE membros_telegram IS NOT NULL) AS membros_inicio,
         arg_max(membros_telegram, run_date) FILTER (WHERE membros_telegram IS NOT NULL) AS membros_atual,
         arg_min(seguidores_facebook, run_date) FILTER (WHERE seguidores_facebook IS NOT NULL) AS seguidores_inicio,
         arg_max(seguidores_facebook, run_date) FILTER (WHERE seguidores_facebook IS NOT NULL) AS seguidores_atual,
         arg_max(alcance_fb_28d, run_date) FILTER (WHERE seguidores_facebook IS NOT NULL) AS alcance_atual
  FROM runs)
SELECT *, coalesce(membros_atual - membros_inicio, 0) AS delta_membros,
       coalesce(seguidores_atual - seguidores_inicio, 0) AS delta_seguidores FROM a"""
    s["recent_runs"] = _with(RUNS) + """
SELECT CAST(row_number() OVER (ORDER BY run_date DESC) AS INTEGER) AS posicao, run_date, status, custo_x_usd
FROM runs ORDER BY run_date DESC LIMIT 40"""
    s["member_curve"] = _with(RUNS) + """
, pts AS (SELECT * FROM runs WHERE membros_telegram IS NOT NULL ORDER BY run_date DESC LIMIT 30)
SELECT count(*) AS pontos, greatest(0, min(membros_telegram) - 2) AS min_v, max(membros_telegram) + 2 AS max_v
FROM pts"""
    s["post_engagement"] = _with(POSTS) + \
        "SELECT user_id, created_time, likes, comments, shares, score, title FROM pe"
    s["top_posts"] = _with(POSTS) + """
SELECT user_id, created_time, score, title FROM pe ORDER BY score DESC, created_time DESC, user_id LIMIT 10"""
    s["engagement_by_hour"] = _with(POSTS) + f"""
SELECT CAST(hour(created_time - INTERVAL {-rules.LOCAL_UTC_OFFSET_HOURS} HOUR) AS INTEGER) AS hora,
       count(*) AS posts, CAST(sum(score) AS BIGINT) AS eng,
       CAST(sum(score) AS DOUBLE) / greatest(count(*), 1) AS media
FROM pe GROUP BY 1 ORDER BY media DESC, hora LIMIT 5"""
    s["mean_engagement"] = _with(POSTS) + """
SELECT CAST(sum(score) AS DOUBLE) / count(*) AS media_engajamento, count(*) AS posts FROM pe"""
    s["sales_kpis"] = _with(RUNS, KPIS, LEDGER) + f"""
, t AS (SELECT CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(sales) AS BIGINT) AS total_sales,
               CAST(sum(CAST(floor(commission * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS total_commission
        FROM ledger)
SELECT *, CASE WHEN total_clicks > 0 THEN {rn('total_sales / total_clicks * 100.0', 2)} ELSE 0.0 END AS conversao_pct,
       CASE WHEN total_sales > 0 THEN {rn('total_commission / total_sales', 2)} ELSE 0.0 END AS comissao_media,
       {rn('total_commission - (SELECT total_x_brl FROM kpis)', 2)} AS lucro_liquido
FROM t"""
    s["sales_conversion"] = _with(LEDGER) + f"""
SELECT id, date, platform, CASE WHEN clicks > 0 THEN {rn('sales / clicks * 100.0', 1)} END AS conversao_pct
FROM ledger"""
    s["commission_by_platform"] = _with(LEDGER) + """
SELECT platform, CAST(sum(CAST(floor(commission * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS comissao,
       count(*) AS lancamentos FROM ledger GROUP BY platform"""
    return s
