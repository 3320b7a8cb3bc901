"""Oracle SQL for the offer-selection family."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_sql import (CENTS, _with, any_sub, flags_select, fold_sql, hist_cte, obs_cte,
                                         one_tier_sql, q, rn, sku_sql, store_sql, two_tier_sql, niche_sql)

IS_B = "contains(lower(loja), 'mercado')"
IS_A = "contains(lower(loja), 'magalu')"


def modelkey_sql(x: str) -> str:
    toks = (f"list_filter(regexp_extract_all({fold_sql(x)}, '[a-z0-9]+'), "
            f"lambda t: length(t) >= 2 OR regexp_full_match(t, '[0-9]+'))")
    return (f"CASE WHEN len({toks}) > 0 THEN array_to_string(list_slice({toks}, 1, 5), ' ') "
            f"ELSE substr(lower(trim(coalesce({x}, ''))), 1, 28) END")


def namekey_sql(x: str) -> str:
    return f"substr(lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')), 1, 40)"


SCORE = ("(CASE WHEN coalesce(menor_preco_historico, false) THEN 45.0 ELSE 0.0 END"
         " + least(coalesce(queda_real_percent, 0.0), 40.0) * 1.5"
         " + coalesce(percentual_desconto, 0.0) * 0.35"
         " + least(coalesce(lucro_estimado_reais, 0.0), 80.0) * 0.4"
         " + CASE WHEN coalesce(preco_atual, 0.0) BETWEEN 35.0 AND 500.0 THEN 25.0 ELSE 0.0 END)")


def offers_ctes() -> list[str]:
    sku = sku_sql("p.p_partkey")
    text = "lower(coalesce(nome_produto, '') || ' ' || coalesce(categoria, ''))"
    return [
        obs_cte("l_partkey", "obsp"),
        hist_cte("obsp", "histp"),
        """lat AS (
  SELECT l_partkey, arg_max({'ep': l_extendedprice, 'q': l_quantity, 'd': l_discount, 's': l_suppkey,
                             'sd': l_shipdate}, (l_shipdate, l_orderkey, l_linenumber)) AS m
  FROM lineitem GROUP BY l_partkey)""",
        f"""cat0 AS (
  SELECT p.p_partkey AS ord, {sku} AS sku, p.p_name AS nome_produto, {store_sql(sku)} AS loja,
         {rn('m.ep / m.q * (1 - m.d)')} AS preco_atual, {rn('m.ep / m.q')} AS preco_antigo,
         p.p_type AS categoria,
         CASE WHEN m.s % 3 = 0 THEN {q(rules.DEFAULT_SELLER)} ELSE 'seller' || CAST(m.s AS VARCHAR) END AS seller_id,
         'https://img.example.com/p/' || CAST(p.p_partkey AS VARCHAR) || '.jpg' AS imagem_url,
         'https://shop.example.com/item/' || CAST(p.p_partkey AS VARCHAR) AS url_afiliado,
         CAST(m.sd AS DATE) AS oferta_dia
  FROM part p JOIN lat ON p.p_partkey = lat.l_partkey)""",
        f"""cat1 AS (
  SELECT *,
    CASE WHEN preco_antigo > 0 AND preco_atual > 0 AND preco_antigo > preco_atual
         THEN {rn('(preco_antigo - preco_atual) / preco_antigo * 100.0')} ELSE 0.0 END AS percentual_desconto,
    CASE WHEN loja = {q(rules.STORE_A)}
         THEN {two_tier_sql('categoria', 'nome_produto', 'seller_id', rules.TEST_COMMISSION_TWO_TIER)}
         ELSE {one_tier_sql('categoria', 'nome_produto', rules.TEST_COMMISSION_ONE_TIER)} END AS comissao_percent
  FROM cat0)""",
        f"""cat2 AS (
  SELECT *, {rn('preco_atual * (comissao_percent / 100.0)')} AS lucro_estimado_reais FROM cat1
  WHERE NOT {any_sub('lower(nome_produto)', rules.TEST_BANNED_TERMS)}
    AND percentual_desconto <= {rules.IMPLAUSIBLE_DISCOUNT_PCT}
    AND sku IS NOT NULL AND nome_produto <> '' AND preco_atual > 0)""",
        f"""pst AS (
  SELECT c.sku, c.loja, c.oferta_dia, c.preco_atual,
         {rn('min(h.preco_min_dia)')} AS min_180d,
         {rn('quantile_cont(' + CENTS.format('h.preco_min_dia') + ', 0.5) / 100.0')} AS mediana_180d,
         {rn('CAST(sum(' + CENTS.format('h.preco_min_dia') + ') AS DOUBLE) / count(h.preco_min_dia) / 100.0')}
           AS media_180d,
         count(h.preco_min_dia) AS dias_observados
  FROM cat2 c LEFT JOIN histp h
    ON h.sku = c.sku AND h.loja = c.loja AND h.preco_min_dia > 0
   AND h.data_coleta >= c.oferta_dia - INTERVAL {rules.HISTORY_DAYS} DAY AND h.data_coleta <= c.oferta_dia
   AND h.data_coleta <> c.oferta_dia
  GROUP BY c.sku, c.loja, c.oferta_dia, c.preco_atual)""",
        f"pfl AS ({flags_select('pst')})",
        f"""cat AS (
  SELECT c.*, f.queda_real_percent, f.menor_preco_historico, f.preco_medio_historico,
         {niche_sql(text, 'categoria')} AS bonus_nicho, {modelkey_sql('nome_produto')} AS modelo
  FROM cat2 c LEFT JOIN pfl f ON c.sku = f.sku)""",
        f"offers_e AS (SELECT *, {SCORE} AS score_qualidade FROM cat)",
    ]


def quota_sql(n_b: str, n_a: str) -> tuple[str, str]:
    """Q1 closed form as two SQL expressions (quota B, quota A)."""
    db, da = f"greatest(0, {n_b})", f"greatest(0, {n_a})"
    meta = f"least({rules.TOTAL_PICKS}, {db} + {da})"
    qb, qa = f"least({rules.TARGET_B}, {db})", f"least({rules.TARGET_A}, {da})"
    short = f"({meta} - ({qb} + {qa}))"
    add_a = f"(CASE WHEN {short} > 0 AND {da} > {qa} THEN least({short}, {da} - {qa}) ELSE 0 END)"
    short2 = f"({short} - {add_a})"
    add_b = f"(CASE WHEN {short2} > 0 AND {db} > {qb} THEN least({short2}, {db} - {qb}) ELSE 0 END)"
    return (f"CAST(CASE WHEN {meta} > 0 THEN {qb} + {add_b} ELSE 0 END AS BIGINT)",
            f"CAST(CASE WHEN {meta} > 0 THEN {qa} + {add_a} ELSE 0 END AS BIGINT)")


def balance_ctes() -> list[str]:
    qb, qa = quota_sql("n_b", "n_a")
    return [
        f"""cnt AS (SELECT CAST(count(*) FILTER (WHERE {IS_B}) AS BIGINT) AS n_b,
                    CAST(count(*) FILTER (WHERE {IS_A}) AS BIGINT) AS n_a FROM offers_e)""",
        f"quo AS (SELECT n_b, n_a, {qb} AS cota_b, {qa} AS cota_a FROM cnt)",
        f"""caps AS (SELECT n_b, n_a, CASE WHEN cota_a > 0 THEN {rules.CANDIDATE_CAP_B}
                     ELSE {rules.CANDIDATE_CAP_B_ALONE} END AS cap_b FROM quo)""",
        f"""caps2 AS (SELECT n_b, n_a, cap_b,
                     greatest({rules.CANDIDATE_FLOOR_A}, {rules.CANDIDATE_CAP_TOTAL} - least(n_b, cap_b)) AS cap_a
                     FROM caps)""",
        f"""rk AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN {IS_B} THEN 0 WHEN {IS_A} THEN 1 ELSE 2 END
                                         ORDER BY score_qualidade DESC, ord) AS rk_store
          FROM offers_e WHERE {IS_B} OR {IS_A})""",
        f"""bal AS (
  SELECT rk.* EXCLUDE (rk_store) FROM rk, caps2
  WHERE caps2.n_b > 0 AND caps2.n_a > 0
    AND (({IS_B} AND rk_store <= cap_b) OR ({IS_A} AND rk_store <= cap_a))
  UNION ALL
  SELECT t.* FROM (SELECT * FROM offers_e ORDER BY score_qualidade DESC, ord LIMIT {rules.CANDIDATE_CAP_TOTAL}) t, caps2
  WHERE NOT (caps2.n_b > 0 AND caps2.n_a > 0))""",
    ]


def fallback_ctes(src: str = "bal") -> list[str]:
    total = rules.TARGET_B + rules.TARGET_A
    cols = ("sku, nome_produto, loja, categoria, preco_atual, preco_antigo, percentual_desconto, "
            "menor_preco_historico, queda_real_percent, preco_medio_historico, url_afiliado, comissao_percent, "
            "lucro_estimado_reais, imagem_url")
    return [
        f"""fb_base AS (SELECT *, -score_qualidade AS ns,
            CASE WHEN {IS_B} THEN 'B' WHEN {IS_A} THEN 'A' ELSE 'X' END AS st FROM {src})""",
        """fb_adh AS (SELECT sku, row_number() OVER (PARTITION BY st, modelo ORDER BY ns, ord) AS r
            FROM fb_base WHERE bonus_nicho >= 0 AND modelo <> '' AND st <> 'X')""",
        """fb_tier AS (SELECT b.*, CASE WHEN b.bonus_nicho < 0 THEN 2 WHEN b.modelo = '' OR a.r = 1 THEN 0 ELSE 1 END
            AS tier FROM fb_base b LEFT JOIN fb_adh a ON a.sku = b.sku WHERE b.st <> 'X')""",
        f"""fb_pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY tier, ns, ord) AS p0
            FROM fb_tier) WHERE p0 <= CASE WHEN st = 'B' THEN {max(rules.TARGET_B, 1)} ELSE {max(rules.TARGET_A, 1)} END)""",
        "fb_n AS (SELECT count(*) AS n FROM fb_pick)",
        """fb_left AS (SELECT b.*, b.modelo IN (SELECT modelo FROM fb_pick) AS rep FROM fb_base b
            WHERE NOT EXISTS (SELECT 1 FROM fb_pick p WHERE p.sku = b.sku))""",
        f"""fb_extra AS (SELECT x.* FROM (SELECT *, row_number() OVER (ORDER BY rep, ns, ord) AS k FROM fb_left) x, fb_n
            WHERE x.k <= greatest(0, {total} - fb_n.n))""",
        f"""fb_all AS (
  SELECT {cols}, st, 0 AS src, p0 AS p FROM fb_pick
  UNION ALL
  SELECT {cols}, CASE WHEN {IS_A} THEN 'A' ELSE 'B' END AS st, 1 AS src, k AS p FROM fb_extra)""",
        "fb_seq AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY src, p) - 1 AS i FROM fb_all)",
        """fb_fin AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN st = 'B' THEN floor(i / 3) ELSE i END,
                                                  CASE WHEN st = 'B' THEN i % 3 ELSE 3 END) AS INTEGER) AS pos
            FROM fb_seq)""",
        f"""picks AS (
  SELECT pos, sku AS sku_selecionado, nome_produto, loja, categoria, preco_atual, preco_antigo,
         percentual_desconto, menor_preco_historico, queda_real_percent, preco_medio_historico, url_afiliado,
         comissao_percent, lucro_estimado_reais, imagem_url, {q(rules.TOP_UP_REASON)} AS razao_selecao,
         {rn('greatest(0.0, coalesce(preco_antigo, preco_atual) - preco_atual)')} AS economia,
         CASE WHEN length(nome_produto) > 50 THEN substr(nome_produto, 1, 47) || '...' ELSE nome_produto END
           AS copy_titulo
  FROM fb_fin WHERE pos <= {total})""",
        f"""picks_c AS (SELECT *,
    CASE WHEN menor_preco_historico THEN 'minima_180d'
         WHEN economia >= 30 AND coalesce(percentual_desconto, 0.0) >= 10 THEN 'corte_real'
         WHEN coalesce(queda_real_percent, 0.0) >= 5 THEN 'abaixo_mediana' ELSE 'competitivo' END AS copy_tipo,
    CASE WHEN economia >= 20 THEN 'economize' WHEN coalesce(percentual_desconto, 0.0) >= 5 THEN 'off'
         ELSE 'confira' END AS cta_tipo,
    {body_sql()} AS copy_corpo,
    {cta_sql()} AS copy_cta
  FROM picks)""",
    ]


def _int0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def body_sql() -> str:
    loja = (f"regexp_replace(coalesce(CASE WHEN coalesce(loja, '') <> '' THEN loja END, "
            f"{store_sql('sku_selecionado')}), '^\\s+|\\s+$', '', 'g')")
    desc, queda = "coalesce(percentual_desconto, 0.0)", "coalesce(queda_real_percent, 0.0)"
    preco = "printf('%.2f', preco_atual)"
    return (f"CASE WHEN coalesce(menor_preco_historico, false) THEN 'Bateu o menor preço em 180 dias (' || "
            f"{_int0(queda)} || '% abaixo da mediana recente) — queda real comprovada.' "
            f"WHEN economia >= 30 AND {desc} >= 10 THEN replace('Corte real de R$ ' || format('{{:,.0f}}', economia) "
            f"|| ' frente ao valor anterior (' || {_int0(desc)} || '% OFF) nesta janela em ' || {loja} || '.', ',', '.') "
            f"WHEN {queda} >= 5 THEN 'Está ' || {_int0(queda)} || '% abaixo da mediana dos últimos 6 meses em ' "
            f"|| {loja} || ', saindo por R$ ' || {preco} || '.' "
            f"ELSE 'Condição competitiva no radar em ' || {loja} || ' por R$ ' || {preco} "
            f"|| ' para upgrade direto no setup.' END")


def cta_sql() -> str:
    desc = "coalesce(percentual_desconto, 0.0)"
    return (f"CASE WHEN economia >= 20 THEN replace('Economize R$ ' || format('{{:,.0f}}', economia) "
            f"|| ' garantindo agora!', ',', '.') WHEN {desc} >= 5 THEN 'Garanta com ' || {_int0(desc)} "
            f"|| '% OFF enquanto dura!' ELSE 'Confira o preço antes do reajuste!' END")


def channel_sql() -> str:
    parts = []
    for name, bonus, w, use_niche in rules.CHANNEL_WEIGHTS:
        score = ((("bonus_nicho" if use_niche else "0.0"))
                 + f" + CASE WHEN coalesce(menor_preco_historico, false) THEN {bonus} ELSE 0.0 END"
                 + f" + coalesce(queda_real_percent, 0.0) * {w}"
                 + " + coalesce(percentual_desconto, 0.0) * 0.6 + coalesce(lucro_estimado_reais, 0.0) * 0.4")
        parts.append(f"SELECT ord, sku, nome_produto, modelo, bonus_nicho, {q(name)} AS canal, ({score}) AS score_canal"
                     f" FROM offers_e")
    lim = "CASE " + " ".join(f"WHEN canal = {q(k)} THEN {v}" for k, v in rules.CHANNEL_LIMITS.items()) + " ELSE 0 END"
    tl = rules.CHANNEL_LIMITS["telegram"]
    return f""",
cs AS ({' UNION ALL '.join(parts)}),
plain AS (SELECT * FROM (SELECT canal, sku, nome_produto, score_canal,
                 CAST(row_number() OVER (PARTITION BY canal ORDER BY -score_canal, ord) AS INTEGER) AS pos
          FROM cs WHERE canal <> 'telegram') WHERE pos <= {lim}),
tg AS (SELECT * FROM cs WHERE canal = 'telegram'),
tg_adh AS (SELECT sku, row_number() OVER (PARTITION BY modelo ORDER BY -score_canal, ord) AS r
           FROM tg WHERE bonus_nicho >= 0 AND modelo <> ''),
tg_t AS (SELECT t.*, CASE WHEN t.bonus_nicho < 0 THEN 2 WHEN t.modelo = '' OR a.r = 1 THEN 0 ELSE 1 END AS tier
         FROM tg t LEFT JOIN tg_adh a ON a.sku = t.sku),
tg_top AS (SELECT * FROM (SELECT canal, sku, nome_produto, score_canal,
                  CAST(row_number() OVER (ORDER BY tier, -score_canal, ord) AS INTEGER) AS pos FROM tg_t) WHERE pos <= {max(tl, 1)})
SELECT canal, pos, sku, nome_produto, score_canal FROM plain
UNION ALL SELECT canal, pos, sku, nome_produto, score_canal FROM tg_top"""


def rehydration_sql() -> str:
    radar_f = ["menor_preco_historico", "queda_real_percent", "preco_medio_historico"]
    str_f = ["url_afiliado", "imagem_url", "categoria", "loja"]
    num_f = ["preco_antigo", "comissao_percent", "lucro_estimado_reais"]
    info = "{" + ", ".join(f"'{f}': {f}" for f in radar_f + str_f + num_f) + "}"

    def lk(name, key):
        return (f"{name} AS (SELECT {key} AS k, arg_max({info}, ord) AS info FROM offers_e "
                f"WHERE {key} IS NOT NULL AND {key} <> '' GROUP BY 1)")
    sel = ["o.sku_selecionado", "o.nome_produto", "j.info IS NOT NULL AS matched"]
    for f in radar_f:
        sel.append(f"CASE WHEN j.info IS NOT NULL THEN j.info.{f} ELSE o.{f} END AS {f}")
    for f in str_f:
        sel.append(f"CASE WHEN j.info IS NOT NULL AND (o.{f} IS NULL OR o.{f} = '') AND j.info.{f} IS NOT NULL "
                   f"THEN j.info.{f} ELSE o.{f} END AS {f}")
    for f in num_f:
        sel.append(f"CASE WHEN j.info IS NOT NULL AND (o.{f} IS NULL OR o.{f} = 0) AND j.info.{f} IS NOT NULL "
                   f"THEN j.info.{f} ELSE o.{f} END AS {f}")
    return f""",
ops AS (SELECT CASE WHEN ord % 3 = 0 THEN 'X' || sku ELSE sku END AS sku_selecionado,
               upper(nome_produto) AS nome_produto,
               CASE WHEN ord % 5 = 0 THEN '' ELSE url_afiliado END AS url_afiliado,
               CAST(NULL AS VARCHAR) AS imagem_url, CAST(NULL AS DOUBLE) AS preco_antigo,
               CASE WHEN ord % 2 = 0 THEN categoria END AS categoria, CAST(NULL AS VARCHAR) AS loja,
               CAST(NULL AS DOUBLE) AS comissao_percent, CAST(NULL AS DOUBLE) AS lucro_estimado_reais,
               false AS menor_preco_historico, 0.0 AS queda_real_percent, 0.0 AS preco_medio_historico
        FROM offers_e),
{lk('lk_sku', 'CAST(sku AS VARCHAR)')},
{lk('lk_url', "coalesce(url_afiliado, '')")},
{lk('lk_name', namekey_sql('nome_produto'))},
j AS (SELECT o.sku_selecionado AS jk, o.nome_produto AS jn, coalesce(s.info, u.info, n.info) AS info
      FROM ops o LEFT JOIN lk_sku s ON o.sku_selecionado = s.k
      LEFT JOIN lk_url u ON coalesce(o.url_afiliado, '') = u.k
      LEFT JOIN lk_name n ON {namekey_sql('o.nome_produto')} = n.k)
SELECT {', '.join(sel)}
FROM ops o JOIN j ON o.sku_selecionado = j.jk"""


def build_offers() -> dict[str, str]:
    s: dict[str, str] = {}
    oc = offers_ctes()
    s["offers_enriched"] = _with(*oc) + "SELECT * FROM offers_e"
    s["offers_dedup"] = f"""
WITH l AS (SELECT {sku_sql('l_partkey')} AS sku,
                  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_rank,
                  l_linenumber AS page, l_orderkey AS idx, l_suppkey AS seller FROM lineitem)
SELECT sku, source_rank, page, idx, seller
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY source_rank, page, idx) AS r FROM l) WHERE r = 1"""
    s["route_counts"] = f"""
WITH l AS (SELECT {sku_sql('l_partkey')} AS sku,
                  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_rank,
                  l_linenumber AS page, l_orderkey AS idx FROM lineitem),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY source_rank, page, idx) AS r FROM l)
      WHERE r = 1)
SELECT {store_sql('sku')} AS loja, source_rank AS rota, count(*) AS itens FROM d GROUP BY 1, 2"""
    recent = f"""now AS (SELECT max(ts) AS now FROM events),
recent AS (SELECT CAST(user_id AS VARCHAR) AS sku, max(ts) AS ultimo_post FROM events, now
           WHERE event_type = 'purchase' AND ts IS NOT NULL
             AND ts > now.now - INTERVAL {rules.REPEAT_LOCK_HOURS} HOUR GROUP BY 1)"""
    s["latest_posts"] = _with(recent) + "SELECT sku, ultimo_post FROM recent"
    s["repeat_lock"] = _with(recent) + f""",
offers AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sku FROM events),
fl AS (SELECT o.sku, r.sku IS NOT NULL AS blocked FROM offers o LEFT JOIN recent r ON o.sku = r.sku)
SELECT sku FROM fl
WHERE NOT blocked OR (SELECT count(*) FROM fl WHERE NOT blocked) < {rules.MIN_FRESH_OFFERS}"""
    bc = balance_ctes()
    s["store_quota"] = _with(*oc, *bc[:2]) + "SELECT n_b, n_a, cota_b, cota_a FROM quo"
    s["candidate_balance"] = _with(*oc, *bc) + "SELECT ord, sku, loja, score_qualidade FROM bal"
    fc = fallback_ctes()
    s["fallback_selection"] = _with(*oc, *bc, *fc) + "SELECT * FROM picks_c"
    s["channel_top"] = "WITH " + ",\n".join(oc) + channel_sql()
    s["catalog_compaction"] = _with(*oc, *bc) + f""",
n AS (SELECT count(*) AS n FROM bal),
nb AS (SELECT least(count(*) FILTER (WHERE {IS_B}), 25) AS kb FROM bal),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN {IS_B} THEN 0 ELSE 1 END
                                   ORDER BY score_qualidade DESC, ord) AS r
      FROM bal WHERE {IS_B} OR {IS_A})
SELECT ord, sku, loja FROM bal, n WHERE n.n <= 50
UNION ALL
SELECT ord, sku, loja FROM r, n, nb
WHERE n.n > 50 AND (({IS_B} AND r <= 25) OR ({IS_A} AND r <= greatest(1, 50 - nb.kb)))"""
    s["rehydration"] = "WITH " + ",\n".join(oc) + rehydration_sql()
    s["remaining_candidates"] = _with(*oc, *bc, *fc) + f"""
SELECT ord, sku, nome_produto FROM bal b
WHERE NOT EXISTS (SELECT 1 FROM picks_c p WHERE p.sku_selecionado IS NOT NULL
                  AND trim(p.sku_selecionado) <> '' AND trim(p.sku_selecionado) = trim(CAST(b.sku AS VARCHAR)))
  AND NOT EXISTS (SELECT 1 FROM picks_c p WHERE p.nome_produto IS NOT NULL AND p.nome_produto <> ''
                  AND {namekey_sql('p.nome_produto')} = {namekey_sql('b.nome_produto')})"""
    return s
