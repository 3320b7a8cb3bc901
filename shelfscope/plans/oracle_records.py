"""Oracle SQL of the queries over derived documents: what the documents must yield follows from
the driver tables that they were made of."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_metrics import LEDGER, POSTS, RUNS
from shelfscope.plans.oracle_offers import balance_ctes, channel_sql, fallback_ctes, modelkey_sql, offers_ctes
from shelfscope.plans.oracle_sql import HIST_CTE, _with, any_sub, niche_sql, obs_cte, one_tier_sql, q, rn, two_tier_sql

PAGE_PARTS = 12
K = "CAST(p_partkey AS VARCHAR)"
CARD_BANNED = ["cabo", "pelicula", "película", "capinha", "adaptador", "suporte simples", "conector"]


def _json_ctes() -> list[str]:
    factor = "CASE WHEN p_partkey % 17 = 0 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) + (p_partkey % 40) / CAST(100 AS DOUBLE) END"
    return [f"""jp AS (
  SELECT CAST(floor(p_partkey / {PAGE_PARTS}) AS BIGINT) AS seq, p_partkey AS k,
         CAST(row_number() OVER (PARTITION BY floor(p_partkey / {PAGE_PARTS}) ORDER BY p_partkey) - 1 AS INTEGER) AS idx,
         p_name || CASE WHEN p_partkey % 19 = 0 THEN ' com cabo' ELSE '' END AS nome_produto,
         CASE WHEN p_partkey % 6 = 0 OR p_type = '' THEN 'Geral' ELSE p_type END AS categoria, p_retailprice AS preco_antigo,
         floor(p_retailprice * ({factor}) * 100.0 + 0.5) / 100.0 AS preco_atual,
         CASE p_partkey % 4 WHEN 0 THEN 'magazineluiza' WHEN 1 THEN 'loja d' WHEN 2 THEN 'loja t'
              ELSE 'loja' || CAST(p_partkey % 3 AS VARCHAR) END AS seller_id,
         CASE p_partkey % 3 WHEN 0 THEN 'https://img.example.com/800x600/' || {K} || '.jpg' WHEN 1 THEN 'https://img.example.com/' || {K}
              ELSE 'https://img.example.com/l/' || {K} END AS imagem_url,
         'https://www.magazinevoce.com.br/p/' || {K} || '/?seller_id=loja' || CAST(p_partkey % 3 AS VARCHAR) AS url_afiliado FROM part)""",
            f"""j1 AS (SELECT seq, idx, CAST(CASE WHEN seq % 6 = 0 THEN 1 ELSE seq % 7 + 1 END AS INTEGER) AS total_paginas,
       {q(rules.SKU_PREFIX_A)} || CAST(k AS VARCHAR) AS sku, nome_produto, {q(rules.STORE_A)} AS loja, preco_atual, preco_antigo, categoria,
       seller_id, imagem_url, url_afiliado,
       CASE WHEN preco_antigo > preco_atual AND preco_atual > 0 THEN {rn('(preco_antigo - preco_atual) / preco_antigo * 100.0')} ELSE 0.0 END AS percentual_desconto,
       {two_tier_sql('categoria', 'nome_produto', 'seller_id', rules.COMMISSION_TWO_TIER)} AS comissao_percent
  FROM jp WHERE k % 11 <> 0 AND k % 13 <> 0 AND seq % 5 <> 4 AND seq % 7 <> 6
    AND NOT {any_sub('lower(nome_produto)', rules.BANNED_TERMS_STORE_A)})""",
            f"""json_offers AS (SELECT *, {rn('preco_atual * (comissao_percent / 100.0)')} AS lucro_estimado_reais FROM j1
  WHERE percentual_desconto <= {rules.IMPLAUSIBLE_DISCOUNT_PCT})"""]


def _card_ctes() -> list[str]:
    params = "&".join(f"{n}={v}" for n, v in rules.AFFILIATE_PARAMS) + "&forceInApp=true"
    (tool, value), word = rules.AFFILIATE_PARAMS[0], rules.AFFILIATE_PARAMS[1]
    text = "lower(nome_produto || ' Geral')"
    return [f"""cp AS (
  SELECT CAST(floor(p_partkey / {PAGE_PARTS}) AS BIGINT) AS page_key, p_partkey AS k,
         floor(p_partkey / {PAGE_PARTS}) % 3 = 2 OR floor(p_partkey / {PAGE_PARTS}) % 8 <> 7 OR p_partkey % 2 = 1 AS shown,
         p_name || ' gamer ' || CASE p_partkey % 10 WHEN 3 THEN 'com cabo' WHEN 4 THEN 'fechadura' ELSE 'X' END AS nome_produto,
         floor(p_retailprice * 0.8 * 100.0 + 0.5) / 100.0 AS preco_atual, floor(p_retailprice * 100.0 + 0.5) / 100.0 AS cheio,
         {q(rules.SKU_PREFIX_B)} || CASE WHEN p_partkey % 3 = 0 THEN 'MLB-' ELSE 'MLB' END || {K} AS sku,
         CASE p_partkey % 4 WHEN 0 THEN 'https://img.example.com/' || {K} || '.webp' WHEN 1 THEN 'https://img.example.com/' || {K} || '-2x.webp'
              WHEN 2 THEN 'https://img.example.com/' || {K} || '.png' END AS imagem_url,
         CASE p_partkey % 3 WHEN 0 THEN 'https://produto.example.com/MLB-' || {K} || '-x?{params}'
              WHEN 1 THEN {q(rules.AFFILIATE_HOST)} || '/nome/p/mlb' || {K} || '?{tool}={value}&pos=2&{word[0]}={word[1]}&forceInApp=true'
              ELSE 'https://produto.example.com/MLB' || {K} || '?{params}' END AS url_afiliado FROM part)""",
            f"""c1 AS (SELECT page_key, CAST(row_number() OVER (PARTITION BY page_key ORDER BY k) - 1 AS INTEGER) AS idx, k, sku, nome_produto,
       {q(rules.STORE_B)} AS loja, preco_atual, CASE WHEN k % 4 <> 0 AND cheio > preco_atual THEN cheio ELSE preco_atual END AS preco_antigo,
       'Geral' AS categoria, 'Mercado Livre Full' AS seller_id, imagem_url, url_afiliado FROM cp WHERE shown)""",
            f"""c2 AS (SELECT * EXCLUDE (k), CASE WHEN k % 3 = 0 THEN 35.0 WHEN preco_antigo > preco_atual
         THEN {rn('(preco_antigo - preco_atual) / preco_antigo * 100.0')} ELSE 0.0 END AS percentual_desconto,
       CAST({one_tier_sql("categoria", "nome_produto", rules.COMMISSION_ONE_TIER)} AS DOUBLE) AS comissao_percent
  FROM c1 WHERE NOT {any_sub('lower(nome_produto)', CARD_BANNED)} AND NOT {any_sub(text, rules.OFF_NICHE_TERMS)})""",
            f"card_offers AS (SELECT *, {rn('preco_atual * (comissao_percent / 100.0)')} AS lucro_estimado_reais FROM c2)"]


def _documents() -> dict[str, str]:
    title = ("CASE WHEN user_id % 7 = 0 THEN '(Post sem texto / Mídia)' ELSE title END")
    social = _with(POSTS) + f""",
z AS (SELECT user_id, created_time, CASE WHEN user_id % 5 = 0 THEN 0 ELSE likes END AS likes, CASE WHEN user_id % 3 = 0 THEN 0 ELSE comments END AS comments,
             shares, {title} AS title FROM pe)
SELECT CAST(user_id AS VARCHAR) || '_' || strftime(created_time, '%Y%m%d%H') AS post_id, CAST(created_time AS TIMESTAMP) AS created_time, likes, comments, shares,
       likes + comments * 2 + shares * 3 AS score, title, strftime(created_time, '%Y-%m-%d %H:%M') AS data_painel FROM z"""
    insight = """
WITH b AS (SELECT CAST(ts AS DATE) AS dia, event_type, count(*) AS n FROM events GROUP BY 1, 2),
d AS (SELECT CAST(dia AS VARCHAR) AS dia, CAST(sum(n) AS BIGINT) AS total, list_reverse_sort(list(n) || [0, -1]) AS ns FROM b GROUP BY 1)
SELECT 'alcance_' || dia AS metrica, total AS valor, CAST(NULL AS VARCHAR) AS maiores FROM d
UNION ALL SELECT 'tipos_' || dia, NULL, array_to_string(list_slice(ns, 1, 5), ',') FROM d
UNION ALL SELECT 'vazio_' || dia, NULL, NULL FROM d"""
    return {"social_documents": social, "insight_documents": insight,
            "run_files": _with(RUNS) + "SELECT strftime(run_date, '%Y-%m-%d') AS timestamp, status, postados_x, custo_x_usd, membros_telegram FROM runs",
            "ledger_files": _with(LEDGER) + """
SELECT strftime(date, '%Y-%m-%d') || ';' || platform || ';' || CAST(clicks AS VARCHAR) || ';' || CAST(sales AS VARCHAR) || ';'
       || printf('%.2f', commission) || ';"nota ""' || note || '""; fim"' AS linha FROM ledger WHERE id <> 1""",
            "candidate_records": _with(*offers_ctes()) + "SELECT sku, nome_produto, preco_atual, CAST(NULL AS VARCHAR) AS url_afiliado, "
                                 "CAST(NULL AS VARCHAR) AS imagem_url, CAST(NULL AS DOUBLE) AS score_qualidade FROM offers_e",
            "history_scan": _with(obs_cte(), HIST_CTE) + f"""
SELECT sku, loja, data_coleta, preco_min_dia, preco_ultimo FROM hist
WHERE sku = 'ML_1' AND loja = {q(rules.STORE_B)} AND data_coleta BETWEEN DATE '1997-02-10' AND DATE '1999-11-20'"""}


def _branches() -> dict[str, str]:
    def reais(x):
        return f"'R$ ' || translate(format('{{:,.2f}}', {x}), ',.', '.,')"
    cards = _with(*offers_ctes()) + f"""
SELECT sku, {reais('preco_atual')} AS preco, CASE WHEN preco_antigo > preco_atual THEN 'DE ' || {reais('preco_antigo')} END AS preco_de,
       CASE WHEN preco_antigo > preco_atual THEN 'ECONOMIZE ' || {reais('(preco_antigo - preco_atual)')} END AS economia,
       CASE WHEN percentual_desconto >= 5 THEN '-' || CAST(CAST(round_even(percentual_desconto, 0) AS BIGINT) AS VARCHAR) || '% OFF' END AS selo FROM offers_e"""
    window = """
WITH e AS (SELECT event_id, CAST(hour(ts - INTERVAL 3 HOUR) AS INTEGER) AS hora FROM events)
SELECT event_id, hora, hora BETWEEN 14 AND 16 AS executar,
       CASE WHEN hora BETWEEN 14 AND 16 THEN 'janela_15h_brt' ELSE printf('fora_janela_15h_brt (hora=%02dh)', hora) END AS motivo FROM e"""
    image = """
SELECT doc_id, CASE doc_id % 7 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN 'http://' ELSE 'https://' END
       || 'cdn.example.com/i' || CAST(doc_id AS VARCHAR) || '.jpg?a=1&b=2' AS imagem_url FROM documents"""
    status = f"""
WITH r AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS run, user_id % 5 AS grupo, count(*) FILTER (WHERE event_type = 'view') AS ml,
                  count(*) FILTER (WHERE event_type = 'click') AS mg, count(*) FILTER (WHERE event_type = 'purchase') AS tg,
                  count(*) FILTER (WHERE event_type = 'signup') AS x FROM events GROUP BY 1, 2)
SELECT run, grupo, CASE WHEN tg = 0 THEN 'ALERTA_TG' WHEN ml = 0 OR mg = 0 THEN 'PARCIAL' ELSE 'OK' END AS status,
       {rn(f'x * {rules.X_COST_PER_POST}', 4)} AS custo_x_usd FROM r"""
    stop = """
WITH l AS (SELECT l_suppkey AS route, l_orderkey AS page, CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_partkey % 60 AS VARCHAR) END AS sku,
                  l_orderkey % 1009 = 5 AND l_linenumber = 1 AS mau FROM lineitem),
novo AS (SELECT route, sku, min(page) AS page FROM l WHERE sku IS NOT NULL GROUP BY 1, 2),
pg AS (SELECT route, page, count(sku) AS n_itens, bool_or(mau) AS mau FROM l GROUP BY 1, 2),
pn AS (SELECT pg.*, (SELECT count(*) FROM novo n WHERE n.route = pg.route AND n.page = pg.page) AS n_novos FROM pg),
s AS (SELECT *, coalesce(bool_or(n_itens = 0 OR n_novos = 0 OR mau) OVER (PARTITION BY route ORDER BY page), false) AS parou FROM pn)
SELECT route, page, n_itens, n_novos FROM s WHERE NOT parou"""
    one = _with(*offers_ctes()) + f"""
SELECT ord, sku, loja, score_qualidade FROM offers_e WHERE loja = {q(rules.STORE_B)}
ORDER BY score_qualidade DESC, ord LIMIT {rules.CANDIDATE_CAP_TOTAL}"""
    text = "lower(nome_produto || ' ' || coalesce(categoria, '') || ' ' || coalesce(copy_titulo, ''))"
    picks = _with(*offers_ctes(), *balance_ctes(), *fallback_ctes()) + f""",
offers_p AS (SELECT *, CAST(pos AS BIGINT) AS ord, sku_selecionado AS sku, {niche_sql(text, 'categoria')} AS bonus_nicho,
                    {modelkey_sql('nome_produto')} AS modelo FROM picks_c)""" + channel_sql().replace("FROM offers_e", "FROM offers_p")
    return {"card_texts": cards, "channel_top_picks": picks, "publication_window": window, "social_image_pages": image, "run_status_hourly": status, "page_stop": stop,
            "candidate_balance_one_store": one,
            "stream_first_url": "SELECT DISTINCT sha256('https://x.example.com/' || CAST(CAST(floor(doc_id / 4) AS BIGINT) AS VARCHAR)) AS url_hash FROM documents"}


def build_records() -> dict[str, str]:
    own = {"listing_json_offers": _with(*_json_ctes()) + "SELECT * FROM json_offers",
           "listing_card_offers": _with(*_card_ctes()) + "SELECT * FROM card_offers",
           "offers_union": _with(*_json_ctes(), *_card_ctes()) + """
SELECT sku, 'json' AS rota, idx, seq, CAST(NULL AS BIGINT) AS page_key, total_paginas, preco_atual FROM json_offers
UNION ALL SELECT sku, 'cards', idx, NULL, page_key, NULL, preco_atual FROM card_offers"""}
    return own | _documents() | _branches()
