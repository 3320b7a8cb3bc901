"""Oracle SQL of the stateful jobs: each statement computes what the job's tables must hold
from the driver tables in one go, without streams, logs or states."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_ingest import PLOG, diag_cte
from shelfscope.plans.oracle_metrics import POSTS, build_metrics
from shelfscope.plans.oracle_news import FEED, headline_sql
from shelfscope.plans.oracle_offers import IS_A, IS_B, namekey_sql, offers_ctes
from shelfscope.plans.oracle_responses import strip_sql, without_urls_sql
from shelfscope.plans.oracle_sql import HIST_CTE, CENTS, _with, flags_select, obs_cte, q, rn, sku_sql, store_sql, topic_sql, urlkey_sql

RUN_PARTS, RECOVERY_PARTS, EDITION = 40, 15, 10


# ------------------------------------------------------------------------ streams
def _streams() -> dict[str, str]:
    s = {"stream_daily_prices": _with(obs_cte(), HIST_CTE) + "SELECT * FROM hist"}
    lock = rules.REPEAT_LOCK_HOURS * 3_600_000_000
    s["stream_repeat_lock"] = f"""
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS sku, event_id, event_type = 'purchase' AS post, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'purchase', event_id) AS k
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (
  SELECT sku, k, event_id, post, t, CAST(NULL AS BIGINT) AS antes, NOT post AS livre FROM e WHERE k = 1
  UNION ALL
  SELECT n.sku, n.k, n.event_id, n.post, n.t, n.antes, NOT n.post AND (n.antes IS NULL OR n.t - n.antes >= {lock})
  FROM (SELECT e.sku, e.k, e.event_id, e.post, e.t, CASE WHEN r.post OR r.livre THEN r.t ELSE r.antes END AS antes
        FROM r JOIN e ON e.sku = r.sku AND e.k = r.k + 1) n)
SELECT sku, event_id AS evento_id, livre, CASE WHEN NOT livre THEN antes END AS ultimo_post_us FROM r WHERE NOT post"""
    s["stream_recency"] = _with(FEED) + f"""
, n AS (SELECT date_trunc('hour', max(publicado_em)) AS now FROM feed),
f AS (SELECT doc_id, CASE WHEN publicado_em IS NULL OR publicado_em < now - INTERVAL {rules.NEWS_WINDOW_HOURS} HOUR THEN 'late'
                          WHEN publicado_em > now + INTERVAL {rules.NEWS_FUTURE_MINUTES} MINUTE THEN 'future' ELSE 'ok' END AS faixa
      FROM feed, n)
SELECT doc_id, faixa, CASE WHEN faixa = 'ok' THEN 'ok' ELSE 'side' END AS tabela FROM f"""
    s["stream_radar"] = _with(obs_cte(), HIST_CTE) + f"""
, o AS (SELECT sku, loja, max(data_coleta) AS dia, arg_max(preco_min_dia, data_coleta) AS preco_atual FROM hist GROUP BY 1, 2),
st AS (
  SELECT o.sku, o.loja, o.preco_atual, {rn('min(h.preco_min_dia)')} AS min_180d,
         {rn('quantile_cont(' + CENTS.format('h.preco_min_dia') + ', 0.5) / 100.0')} AS mediana_180d,
         count(h.preco_min_dia) AS dias_observados
  FROM o LEFT JOIN hist h ON h.sku = o.sku AND h.loja = o.loja AND h.preco_min_dia > 0 AND h.data_coleta < o.dia
                         AND h.data_coleta >= o.dia - INTERVAL {rules.HISTORY_DAYS} DAY
  GROUP BY 1, 2, 3),
fl AS ({flags_select("st")})
SELECT sku, loja, preco_atual, queda_real_percent, menor_preco_historico, preco_medio_historico FROM fl"""
    s["stream_engagement"] = _with(POSTS) + """
SELECT CAST(created_time AS TIMESTAMP) AS hora, count(*) AS posts, CAST(sum(score) AS BIGINT) AS eng FROM pe GROUP BY 1"""
    return s


# --------------------------------------------------------------------------- logs
def _logs() -> dict[str, str]:
    sku = sku_sql("user_id")
    s = {"post_log": f"""
WITH p AS (SELECT {sku} AS sku, {store_sql(sku)} AS loja, CAST(date_trunc('day', ts) AS TIMESTAMP) AS postado_em,
                  {rn('value')} AS preco_postado, CAST(event_id AS VARCHAR) AS canal_resumo, event_id % 3 AS lote
           FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY sku, postado_em ORDER BY lote, preco_postado, canal_resumo) AS r FROM p)
SELECT sku, loja, postado_em, preco_postado, canal_resumo FROM r WHERE r = 1"""}
    url = "'https://news.example.com/' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS VARCHAR)"
    s["topic_log"] = f"""
WITH t AS (SELECT doc_id, {url} AS base, source AS fonte,
                  CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS TIMESTAMP) AS publicado_em FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id % 2 DESC, publicado_em) AS r FROM t)
SELECT {urlkey_sql('base')} AS url_hash, base || '#' || CAST(doc_id AS VARCHAR) AS url, fonte, publicado_em FROM r WHERE r = 1"""
    s["retention_run"] = _with(obs_cte(), HIST_CTE) + f"""
, c AS (SELECT count(*) FILTER (WHERE data_coleta < d) AS removidos, count(*) FILTER (WHERE data_coleta >= d) AS restantes
        FROM hist, (SELECT max(data_coleta) - INTERVAL {rules.RETENTION_PRICE_DAYS} DAY AS d FROM hist)),
posted AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
topics AS (SELECT url_hash, min(epoch_us(publicado_em)) AS t FROM feed0 GROUP BY 1),
pm AS (SELECT (min(t) + max(t)) / 2.0 AS m FROM posted), tm AS (SELECT (min(t) + max(t)) / 2.0 AS m FROM topics)
SELECT 'precos' AS tabela, removidos, removidos AS de_novo, restantes, removidos AS contagem_guardada FROM c
UNION ALL SELECT 'postados', count(*) FILTER (WHERE t < m), 0, count(*) FILTER (WHERE t >= m), NULL FROM posted, pm
UNION ALL SELECT 'pautas', count(*) FILTER (WHERE t < m), 0, count(*) FILTER (WHERE t >= m), NULL FROM topics, tm""".replace(
        "feed0", f"(WITH {FEED} SELECT * FROM feed)")
    last = "CASE WHEN titulo <> '' AND preco_ultimo <> 0 THEN preco_ultimo END"
    mn = "CASE WHEN preco_min_dia <> 0 THEN preco_min_dia END"
    s["legacy_migration"] = _with(obs_cte(), HIST_CTE) + f"""
SELECT 'precos' AS tabela, sku, loja, CAST(data_coleta AS VARCHAR) AS quando, coalesce({last}, {mn}) AS preco,
       coalesce({mn}, {last}) AS minimo
FROM hist WHERE coalesce({last}, {mn}) IS NOT NULL
UNION ALL
SELECT DISTINCT 'postados', {sku}, {store_sql(sku)}, strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM events WHERE event_type = 'purchase' AND event_id % 11 <> 0"""
    at = "o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_custkey % 60)"
    s["purge_guard"] = f"""
WITH p AS (SELECT o_orderpriority AS base, {at} AS limpo_em, o_custkey % 400 AS removidos FROM orders WHERE o_orderkey % 3 = 0),
c AS (SELECT o_orderkey AS conferencia, o_orderpriority AS base, {at} AS conferido_em, CAST(1000 AS BIGINT) AS baseline,
             1000 - o_custkey % 500 AS atuais FROM orders WHERE o_orderkey % 3 <> 0),
j AS (SELECT c.*, CAST(coalesce(arg_max(removidos, (limpo_em, removidos)), 0) AS BIGINT) AS justificados
      FROM c LEFT JOIN p ON p.base = c.base AND limpo_em <= conferido_em
                        AND conferido_em <= limpo_em + INTERVAL {rules.PURGE_VALID_HOURS} HOUR
      GROUP BY ALL),
g AS (SELECT *, greatest(0, baseline - greatest(0, justificados)) AS esperado FROM j),
g2 AS (SELECT *, greatest(0, esperado - atuais) / baseline AS pct FROM g)
SELECT conferencia, base, justificados, NOT (atuais = 0 OR pct > {rules.MAX_ROW_LOSS}) AS ok,
       CASE WHEN atuais = 0 THEN 'banco_vazio_com_baseline_positivo'
            WHEN pct > {rules.MAX_ROW_LOSS} THEN printf('queda_anomala_linhas (%d vs esperado %d)', atuais, esperado)
            ELSE 'ok' END AS motivo, floor(pct * 10000.0 + 0.5) / 100.0 AS queda_injustificada_pct
FROM g2"""
    return s


# ------------------------------------------------------------------------ breaker
def _breaker() -> dict[str, str]:
    scan = f"""{PLOG}, {diag_cte()},
r AS (SELECT seq, loja, 'rota' || CAST(seq % 4 AS VARCHAR) AS rota, suspeita_waf AS mau,
             CASE WHEN seq % 9 = 0 THEN 2 ELSE 1 END AS tentativa,
             max(CASE WHEN seq % 60 < 4 THEN seq END) OVER (PARTITION BY loja, seq % 4 ORDER BY seq) AS execucao FROM diag),
c AS (SELECT *, coalesce(bool_or(mau) OVER (PARTITION BY loja, rota, execucao ORDER BY seq
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cortada FROM r)"""
    return {"breaker_scan": f"WITH {scan} SELECT loja, rota, seq, execucao, cortada, mau AND NOT cortada AS gatilho FROM c",
            "breaker_calls": f"""WITH {scan}
SELECT loja, rota, execucao, count(*) AS chamadas, bool_or(mau) AS breaker_ativado,
       count(*) FILTER (WHERE NOT mau) AS paginas_mantidas, count(*) FILTER (WHERE tentativa > 1) AS repeticoes
FROM c WHERE NOT cortada GROUP BY 1, 2, 3"""}


# ---------------------------------------------------------------- responses of runs
def _resolved() -> str:
    sku, total = sku_sql("p_partkey"), rules.TARGET_B + rules.TARGET_A
    run = f"CAST(floor({{}} / {RUN_PARTS}) AS BIGINT)"
    st = f"CASE WHEN {IS_B} THEN 'B' WHEN {IS_A} THEN 'A' ELSE 'X' END"
    return ",\n".join(offers_ctes()) + f""",
runs AS (SELECT DISTINCT {run.format('p_partkey')} AS run_id FROM part),
told AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p_partkey) AS pos,
                row_number() OVER (PARTITION BY run_id ORDER BY p_partkey DESC) AS de_tras
         FROM (SELECT p_partkey, p_name, {sku} AS sku, {store_sql(sku)} AS loja, {run.format('p_partkey')} AS run_id FROM part)
         WHERE CASE run_id % 5 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN p_partkey % 5 = 0 WHEN 2 THEN p_partkey % 3 = 0
                    WHEN 3 THEN false ELSE p_partkey % 8 = 0 END),
lida AS (SELECT * FROM told WHERE run_id % 5 <> 2 OR de_tras > 1),
need0 AS (SELECT r.run_id, count(l.sku) AS n, count(*) FILTER (WHERE {IS_B.replace('loja', 'l.loja')}) AS b,
                 count(*) FILTER (WHERE {IS_A.replace('loja', 'l.loja')}) AS a FROM runs r LEFT JOIN lida l ON l.run_id = r.run_id GROUP BY 1),
need1 AS (SELECT *, greatest(0, {total} - n) AS falta, greatest(0, {rules.TARGET_A} - a) AS ma,
                 greatest(0, {rules.TARGET_B} - b) AS mb FROM need0),
need AS (SELECT run_id, n, falta, CASE WHEN n = 0 THEN {rules.TARGET_B} WHEN falta > 0 THEN greatest(mb, falta - ma) ELSE 0 END AS fb,
                CASE WHEN n = 0 THEN {rules.TARGET_A} WHEN falta > 0 THEN ma ELSE 0 END AS fa FROM need1),
base AS (SELECT o.*, need.* EXCLUDE (run_id), need.run_id, -score_qualidade AS ns, {st} AS st
         FROM offers_e o JOIN need ON need.run_id = {run.format('o.ord')}
         WHERE falta > 0 AND NOT EXISTS (SELECT 1 FROM lida l WHERE l.run_id = need.run_id AND l.sku = o.sku)
           AND NOT EXISTS (SELECT 1 FROM lida l WHERE l.run_id = need.run_id
                           AND {namekey_sql('l.p_name')} = {namekey_sql('o.nome_produto')})),
tier AS (SELECT *, CASE WHEN bonus_nicho < 0 THEN 2 WHEN modelo = '' OR row_number() OVER (
           PARTITION BY run_id, st, modelo, bonus_nicho >= 0 ORDER BY ns, ord) = 1 THEN 0 ELSE 1 END AS tier FROM base),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, st ORDER BY tier, ns, ord) AS p FROM tier),
pick AS (SELECT * FROM rk WHERE st <> 'X' AND p <= greatest(1, CASE WHEN st = 'B' THEN fb ELSE fa END)),
np AS (SELECT run_id, count(*) AS n_in FROM pick GROUP BY 1),
lft AS (SELECT rk.*, row_number() OVER (PARTITION BY run_id ORDER BY EXISTS (SELECT 1 FROM pick x
           WHERE x.run_id = rk.run_id AND x.modelo = rk.modelo), ns, ord) AS k
        FROM rk WHERE NOT EXISTS (SELECT 1 FROM pick x WHERE x.run_id = rk.run_id AND x.sku = rk.sku)),
sel AS (SELECT run_id, ord, sku, nome_produto, loja, categoria, preco_atual, imagem_url, n, falta, fb, fa, st, 0 AS src, p FROM pick
        UNION ALL
        SELECT l.run_id, ord, sku, nome_produto, loja, categoria, preco_atual, imagem_url, n, falta, fb, fa,
               CASE WHEN {IS_A} THEN 'A' ELSE 'B' END, 1, k
        FROM lft l LEFT JOIN np ON np.run_id = l.run_id WHERE k <= greatest(0, fb + fa - coalesce(n_in, 0))),
lin AS (SELECT *, row_number() OVER (PARTITION BY run_id, st ORDER BY src, p) - 1 AS i FROM sel),
fin AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN st = 'B' THEN floor(i / 3) ELSE i END,
                                     CASE WHEN st = 'B' THEN i % 3 ELSE 3 END) AS pos FROM lin),
extra AS (SELECT * FROM fin WHERE pos <= falta AND pos <= fb + fa),
lab AS (SELECT need.run_id, CASE WHEN n = 0 THEN 'fallback_deterministico' WHEN need.run_id % 5 = 2 THEN 'gemini_parcial'
                            WHEN EXISTS (SELECT 1 FROM extra e WHERE e.run_id = need.run_id) THEN 'gemini_complementado'
                            ELSE 'gemini' END AS origem FROM need),
res AS (
  SELECT l.run_id, CAST(l.pos AS INTEGER) AS pos, origem, sku AS sku_selecionado, p_name AS nome_produto, loja, 'IA' AS categoria,
         CAST(NULL AS DOUBLE) AS preco_atual, CAST(NULL AS VARCHAR) AS razao_selecao, CAST(NULL AS VARCHAR) AS copy_titulo,
         CAST(NULL AS VARCHAR) AS imagem_url
  FROM lida l JOIN lab ON lab.run_id = l.run_id
  UNION ALL
  SELECT e.run_id, CAST(n + e.pos AS INTEGER), origem, sku, nome_produto, loja, categoria, preco_atual, {q(rules.TOP_UP_REASON)},
         CASE WHEN length(nome_produto) > 50 THEN substr(nome_produto, 1, 47) || '...' ELSE nome_produto END, imagem_url
  FROM extra e JOIN lab ON lab.run_id = e.run_id)"""


def _recovery() -> str:
    sku = sku_sql("p_partkey")
    named = ("'{\"sku_selecionado\":\"' || " + sku + " || '\",\"extra\":{\"nota\":\"a } b { \\\" c\",\"n\":[1,{\"z\":2.5e3}]},"
             "\"nome_produto\":\"' || p_name || '\"}'")
    return f"""
WITH t AS (SELECT p_partkey AS k, {sku} AS sku, CAST(floor(p_partkey / {RECOVERY_PARTS}) AS BIGINT) AS resposta_id,
                  p_partkey % 5 = 0 AS dentro, p_partkey % 5 <> 0 AND p_partkey % 7 = 0 AS sem_nome, length({named}) AS nomeado FROM part),
l AS (SELECT *, CASE WHEN dentro THEN nomeado + 13 WHEN sem_nome THEN length('{{"sku_selecionado":"","preco":1}}') ELSE nomeado END AS len FROM t),
p AS (SELECT *, 15 + sum(len + 1) OVER w - len - 1 AS inicio, 15 + sum(len + 1) OVER (PARTITION BY resposta_id) - 1 + 3 AS todo
      FROM l WINDOW w AS (PARTITION BY resposta_id ORDER BY k)),
c AS (SELECT *, floor(todo * (CAST(0.3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (resposta_id % 13))) AS corte FROM p)
SELECT resposta_id, CAST(row_number() OVER (PARTITION BY resposta_id ORDER BY k) - 1 AS INTEGER) AS pos,
       sku, CAST(2500 AS DOUBLE) AS z
FROM c WHERE NOT sem_nome AND inicio + CASE WHEN dentro THEN 11 ELSE 0 END + nomeado <= corte"""


# ---------------------------------------------------------------------- editorial
def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN regexp_replace(substr({x}, 1, {n - 3}), '\\s+$', '') || '...' ELSE {x} END"


def _footer(base: str) -> str:
    low = f"lower({base})"
    return (f"CASE WHEN {base} = '' THEN '' WHEN contains({low}, 'fonte: ' || lower(fonte)) OR contains({low}, 'via ' || lower(fonte)) "
            f"THEN {base} ELSE {base} || chr(10) || chr(10) || {q(rules.SOURCE_FOOTER_PREFIX)} || fonte END")


def _editorial() -> str:
    pat = q(rules.HIGHLIGHT_TOKEN_PATTERN)
    capitals = "lower(upper(replace(f.titulo, 'ß', 'ss')))"     # the response has the title in capitals
    return f"""
WITH c AS (SELECT CAST(floor(doc_id / {EDITION}) AS BIGINT) AS run_id, doc_id, source, substr(text, 1, 120) AS titulo,
                  'https://' || lower(source) || '.example.com/News/' || CAST(doc_id AS VARCHAR) || '/' AS url,
                  CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.com/' || CAST(doc_id AS VARCHAR) END AS imagem_url,
                  row_number() OVER (PARTITION BY floor(doc_id / {EDITION}) ORDER BY doc_id) AS n FROM documents),
four AS (SELECT *, run_id % 8 AS k FROM c WHERE n = 4),
same AS (SELECT f.run_id, min(x.n) AS n FROM four f JOIN c x ON x.run_id = f.run_id
         WHERE {strip_sql(capitals)} <> '' AND lower({strip_sql('x.titulo')}) = {strip_sql(capitals)} GROUP BY 1),
hit AS (SELECT f.run_id, f.k, f.titulo AS t4, f.source AS s4,
               CASE WHEN f.k IN (6, 7) THEN NULL WHEN f.k = 4 THEN s.n ELSE 4 END AS n
        FROM four f LEFT JOIN same s ON s.run_id = f.run_id),
m AS (SELECT h.*, c.doc_id, c.url, c.imagem_url, coalesce(nullif({strip_sql("coalesce(c.source, '')")}, ''), {q(rules.DEFAULT_NEWS_SOURCE)}) AS fonte,
             {strip_sql("coalesce(c.titulo, '')")} AS tit FROM hit h LEFT JOIN c ON c.run_id = h.run_id AND c.n = h.n),
b AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN 'Manchete curta do dia sobre uma novidade que interessa' ELSE {headline_sql('tit')} END AS head,
             CASE WHEN k <> 5 THEN {without_urls_sql(strip_sql("'Leia em www.example.com/x agora: ' || substr(t4, 1, 40)"))} ELSE '' END AS fb0,
             CASE WHEN run_id % 5 = 0 THEN {without_urls_sql(strip_sql("'Via ' || s4 || ' no canal t.me/canal hoje'"))} ELSE '' END AS tg0 FROM m),
f AS (SELECT *, {_footer('fb0')} AS fb1, {_footer('tg0')} AS tg1, run_id % 6 IN (0, 4) AS oferta FROM b),
g AS (SELECT *, CASE WHEN fb1 <> '' THEN fb1 ELSE tg1 END AS fb, CASE WHEN tg1 <> '' THEN tg1 ELSE fb1 END AS tg,
             {without_urls_sql(f"CASE WHEN run_id % 4 = 1 THEN 'texto   do  X em exemplo.com.br/abc' ELSE head || {q(rules.HEADLINE_VIA)} || fonte END")} AS x FROM f),
h AS (SELECT *, {without_urls_sql('fb')} AS th,
             CASE WHEN k = 7 THEN 'json_invalido' WHEN n IS NULL THEN 'noticia_nao_encontrada' WHEN fb = '' THEN 'sem_texto_editorial' END AS motivo FROM g),
ok AS (SELECT *, motivo IS NULL AS ok FROM h)
SELECT run_id, CASE WHEN ok THEN coalesce(nullif(doc_id, 0), CASE k WHEN 1 THEN 4 END) END AS noticia_id, CASE WHEN ok THEN url END AS url_escolhida,
       CASE WHEN ok THEN fonte END AS fonte, CASE WHEN ok THEN tit END AS titulo_original, CASE WHEN ok THEN {topic_sql('tit')} END AS tema_normalizado,
       CASE WHEN ok THEN imagem_url END AS imagem_url, CASE WHEN ok THEN CASE WHEN run_id % 2 = 0 THEN 'HARDWARE E AFINS' ELSE 'TECH' END END AS tag_categoria,
       CASE WHEN ok THEN head END AS headline_card,
       CASE WHEN ok THEN CASE WHEN head <> '' AND (list_contains(regexp_extract_all(lower(head), {pat}), 'novidade') OR contains(lower(head), 'novidade'))
                              THEN 'novidade' ELSE '' END END AS destaque_card,
       CASE WHEN ok THEN 'linha um linha dois' END AS roteiro_reel, CASE WHEN ok THEN oferta END AS tem_match_oferta,
       CASE WHEN ok THEN CASE WHEN oferta THEN 'ML_' || CAST(run_id % 6 AS VARCHAR) ELSE '' END END AS sku_oferta_relacionada,
       CASE WHEN ok AND oferta THEN 'https://a.example.com/' || CAST(run_id % 6 AS VARCHAR) END AS url_oferta_comentario,
       CASE WHEN ok THEN {_cut('x', 260)} END AS texto_x, CASE WHEN ok THEN {_cut('th', 495)} END AS texto_threads,
       CASE WHEN ok THEN fb END AS texto_facebook, CASE WHEN ok THEN tg END AS texto_telegram, motivo AS motivo_rejeicao
FROM ok"""


# --------------------------------------------------------------------------- URLs
def _links() -> str:
    k = "CAST(p_partkey AS VARCHAR)"
    tail = ("url_encode(kk) || '=' || url_encode(v)", "replace(replace(replace({}, '%20', '+'), '%7E', '~'), '*', '%2A')")
    coded = tail[1].format(tail[0])

    def rebuilt(src: str, extra: str) -> str:
        """Parameters of ``src`` (id, i, kk, v) in order of their keys' first place, with ``extra`` rows (id, i, kk, v) applied."""
        return f"""SELECT id, string_agg({coded}, '&' ORDER BY first, i) AS qs FROM (
    SELECT *, min(i) OVER (PARTITION BY id, kk) AS first FROM ({src} UNION ALL {extra})) GROUP BY id"""
    params = ", ".join(f"({1000 + i}, {q(n)}, {q(v)})" for i, (n, v) in enumerate([*rules.AFFILIATE_PARAMS, ("forceInApp", "true")]))
    return f"""
WITH raw AS (SELECT p_partkey AS id, p_partkey % 4 AS pg, CASE p_partkey % 9
    WHEN 0 THEN '  //produto.example.com/MLB' || {k} || '?a=1&b=&a=2#topo ' WHEN 1 THEN '/p/MLB' || {k} || '?matt_tool=&z=1'
    WHEN 2 THEN 'https://x.example.com/' || {k} || '?matt_word=outro&forceInApp=false&foo' WHEN 3 THEN 'http://x.example.com/' || {k}
    WHEN 4 THEN 'ftp://x.example.com/' || {k} WHEN 5 THEN 'https://x.example.com/' || {k} || '?q=a+b%20c&u=%C3%A9*~&&page=3&=v'
    WHEN 6 THEN '#so-fragmento' WHEN 7 THEN NULL ELSE 'https://x.example.com/' || {k} || '?matt_tool=1&page=9&matt_tool=&p=a=b' END AS url FROM part),
u AS (SELECT id, pg, url, split_part({strip_sql("coalesce(url, '')")}, '#', 1) AS a0, split_part(url, '#', 1) AS p0,
             CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#')) ELSE '' END AS frag FROM raw),
w AS (SELECT *, CASE WHEN starts_with(a0, '//') THEN 'https:' || a0 WHEN starts_with(a0, '/') THEN {q(rules.AFFILIATE_HOST)} || a0 ELSE a0 END AS a FROM u),
part_of AS (SELECT id, unnest(list_filter(string_split(CASE WHEN contains(p0, '?') THEN substr(p0, instr(p0, '?') + 1) ELSE '' END, '&'),
                                          lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(
                   CASE WHEN contains(p0, '?') THEN substr(p0, instr(p0, '?') + 1) ELSE '' END, '&'), lambda x: x <> ''), 1) AS i FROM w),
pair AS (SELECT id, i, url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS kk,
                url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' ')) AS v FROM part_of),
one AS (SELECT id, kk, min(i) AS i, arg_min(v, i) AS v FROM pair GROUP BY 1, 2),
want AS (SELECT w.id, p.i, p.kk, p.v, one.i AS old, one.v AS ov FROM w, (VALUES {params}) p(i, kk, v)
         LEFT JOIN one ON one.id = w.id AND one.kk = p.kk),
put AS (SELECT id, coalesce(old, i) AS i, kk, v FROM want WHERE old IS NULL OR (kk <> 'forceInApp' AND ov = '')),
aff AS ({rebuilt("SELECT id, i, kk, v FROM pair WHERE (id, kk) NOT IN (SELECT id, kk FROM put)", "SELECT id, i, kk, v FROM put")}),
pgs AS (SELECT w.id, coalesce(one.i, 1000) AS i, 'page' AS kk, CAST(pg AS VARCHAR) AS v FROM w LEFT JOIN one ON one.id = w.id AND one.kk = 'page'),
pag AS ({rebuilt("SELECT id, i, kk, v FROM pair WHERE kk <> 'page'", "SELECT id, i, kk, v FROM pgs")})
SELECT w.id AS p_partkey,
       CASE WHEN a <> '' AND (starts_with(a, 'http://') OR starts_with(a, 'https://')) THEN split_part(a, '?', 1) || '?' || aff.qs END AS afiliado,
       CASE WHEN pg <= 1 THEN url ELSE split_part(p0, '?', 1) || '?' || pag.qs || CASE WHEN frag = '#' THEN '' ELSE frag END END AS pagina
FROM w LEFT JOIN aff ON aff.id = w.id LEFT JOIN pag ON pag.id = w.id"""


def _feeds() -> str:
    title = "regexp_replace(substr(text, 1, 90), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    title = f"replace(replace({title}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"""
WITH d AS (SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS feed_ord, {strip_sql(title)} AS title,
                  'https://' || source || '.example.com/news/' || CAST(doc_id AS VARCHAR) AS link,
                  CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS TIMESTAMP) AS publicado_em
           FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
e AS (SELECT feed_ord, row_number() OVER (PARTITION BY feed_ord ORDER BY doc_id) - 1 AS pos, title, link, publicado_em,
             CASE WHEN doc_id % 2 = 0 AND feed_ord % 4 <> 2 THEN 'https://img.example.com/' || CAST(doc_id AS VARCHAR) || '.PNG?w=1' END AS image_url FROM d),
b AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS feed_ord, count(*) FILTER (WHERE text IS NOT NULL AND source IS NOT NULL) AS n
      FROM documents GROUP BY 1)
SELECT feed_ord, CAST(pos AS INTEGER) AS pos, title, link, publicado_em, image_url FROM e WHERE feed_ord % 4 <> 3
UNION ALL SELECT feed_ord, CAST(n AS INTEGER), '', '', NULL, NULL FROM b WHERE feed_ord % 4 = 1"""


def _marts() -> str:
    m = build_metrics()
    tables = {"categorias": ("category_totals", "categoria", ""), "kpis": ("run_kpis", None, ""),
              "audiencia": ("audience_deltas", None, ""), "ultimas": ("recent_runs", "run_date", ", status"),
              "curva": ("member_curve", None, ""), "engajamento": ("mean_engagement", None, ""),
              "horas": ("engagement_by_hour", "hora", ""), "vendas": ("sales_kpis", None, ""),
              "plataformas": ("commission_by_platform", "platform", ""), "conversao": ("sales_conversion", "id", ", date, platform")}
    out = []
    for mart, (name, key, more) in tables.items():
        drop = f" EXCLUDE ({key}{more})" if key else ""
        cells = f"SELECT {f'CAST({key} AS VARCHAR)' if key else q('')} AS chave, CAST(COLUMNS(*{drop}) AS DOUBLE) FROM ({m[name]})"
        out.append(f"SELECT {q(mart)} AS mart, chave, medida, valor FROM ({cells}) "
                   "UNPIVOT INCLUDE NULLS (valor FOR medida IN (COLUMNS(* EXCLUDE (chave))))")
    return " UNION ALL ".join(out)


def build_jobs() -> dict[str, str]:
    csv = ("SELECT sku, nome_produto || ' \"' || categoria || '\"; ok' AS nome_produto, CASE WHEN ord % 7 <> 0 THEN loja END AS loja, ord, "
           "true AS com_marca FROM offers_e")
    return _streams() | _logs() | _breaker() | {
        "response_top_up": f"WITH {_resolved()} SELECT * FROM res",
        "response_provenance": f"""WITH {_resolved()}
SELECT need.run_id, CAST(any_value(n) AS INTEGER) AS n_resposta, coalesce(any_value(res.origem), 'vazio') AS origem, count(res.pos) AS n_final,
       count(*) FILTER (WHERE {IS_B.replace('loja', 'res.loja')}) AS n_b, count(*) FILTER (WHERE {IS_A.replace('loja', 'res.loja')}) AS n_a
FROM need LEFT JOIN res ON res.run_id = need.run_id GROUP BY 1""",
        "response_recovery": _recovery(), "editorial_picks": _editorial(), "affiliate_urls": _links(), "feed_tree_items": _feeds(),
        "offers_csv": _with(*offers_ctes()) + csv, "dashboard_marts": _marts()}
