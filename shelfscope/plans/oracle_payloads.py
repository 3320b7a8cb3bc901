"""Oracle SQL for channel payloads and small projections."""

from __future__ import annotations

from shelfscope.operators import payloads as Pl
from shelfscope.plans.oracle_metrics import POSTS
from shelfscope.plans.oracle_offers import balance_ctes, fallback_ctes, offers_ctes
from shelfscope.plans.oracle_sql import _with, q, store_sql
from shelfscope.functions import rules
from shelfscope.plans.oracle_news import ENTITIES

WS = "'^\\s+|\\s+$'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def nonblank(x: str) -> str:
    return f"CASE WHEN {strip(f'coalesce({x}, {q(chr(0)*0)})')} <> '' THEN {x} END"


def caption_sql() -> str:
    t = strip(f"coalesce({nonblank('copy_titulo')}, {nonblank('nome_produto')}, 'Super Oferta!')")
    title = f"CASE WHEN length({t}) > 88 THEN substr({t}, 1, 85) || '...' ELSE {t} END"
    price, disc = "coalesce(preco_atual, 0.0)", "coalesce(percentual_desconto, 0.0)"
    media = "coalesce(preco_medio_historico, 0.0)"
    store = (f"coalesce(CASE WHEN coalesce(loja, '') <> '' THEN loja END, CASE WHEN contains(lower(coalesce("
             f"url_afiliado, '')), 'mercadolivre') THEN 'Mercado Livre' ELSE 'Magalu' END)")
    badge = f"CASE WHEN contains(lower({store}), 'mercado') THEN {q(Pl.BADGE_B)} ELSE {q(Pl.BADGE_A)} END"
    min_line = (f"CASE WHEN coalesce(menor_preco_historico, false) THEN CASE WHEN {media} > {price} THEN "
                f"{q(Pl.MIN_PRICE_LINE + ' (Média anterior: R$ ')} || printf('%.2f', {media}) || ')' "
                f"ELSE {q(Pl.MIN_PRICE_LINE)} END END")
    old_line = (f"CASE WHEN preco_antigo IS NOT NULL AND preco_antigo <> 0 AND preco_antigo > {price} "
                f"THEN '❌ De: R$ ' || printf('%.2f', preco_antigo) END")
    now_line = (f"CASE WHEN {disc} >= 5 THEN '✅ Por: R$ ' || printf('%.2f', {price}) || ' (' || "
                f"CAST(CAST(round_even({disc}, 0) AS BIGINT) AS VARCHAR) || '% OFF!)' "
                f"ELSE '✅ Por: R$ ' || printf('%.2f', {price}) END")
    foot = ", ".join(q(x) for x in Pl.CAPTION_FOOTER)
    return f"concat_ws(chr(10), {badge}, {min_line}, '🔥 ' || {title}, '', {old_line}, {now_line}, '', {foot})"


def _head_sql():
    t = strip(f"coalesce({nonblank('copy_titulo')}, {nonblank('nome_produto')}, 'Super Oferta!')")
    price, media = "coalesce(preco_atual, 0.0)", "coalesce(preco_medio_historico, 0.0)"
    store = (f"coalesce(CASE WHEN coalesce(loja, '') <> '' THEN loja END, CASE WHEN contains(lower(coalesce("
             f"url_afiliado, '')), 'mercadolivre') THEN 'Mercado Livre' ELSE 'Magalu' END)")
    badge = f"CASE WHEN contains(lower({store}), 'mercado') THEN {q(Pl.BADGE_B)} ELSE {q(Pl.BADGE_A)} END"
    min_line = (f"CASE WHEN coalesce(menor_preco_historico, false) THEN CASE WHEN {media} > {price} THEN "
                f"{q(Pl.MIN_PRICE_LINE + ' (Média anterior: R$ ')} || printf('%.2f', {media}) || ')' "
                f"ELSE {q(Pl.MIN_PRICE_LINE)} END END")
    return t, price, badge, min_line


def _price_lines_sql(price, prefix):
    disc = "coalesce(percentual_desconto, 0.0)"
    old_line = (f"CASE WHEN preco_antigo IS NOT NULL AND preco_antigo <> 0 AND preco_antigo > {price} "
                f"THEN '❌ De: R$ ' || printf('%.2f', preco_antigo) END")
    now_line = (f"CASE WHEN {disc} >= 5 THEN {q(prefix)} || printf('%.2f', {price}) || ' (' || "
                f"CAST(CAST(round_even({disc}, 0) AS BIGINT) AS VARCHAR) || '% OFF!)' "
                f"ELSE {q(prefix)} || printf('%.2f', {price}) END")
    return old_line, now_line


def threads_sql() -> str:
    t, price, badge, min_line = _head_sql()
    body = strip("coalesce(copy_corpo, '')")
    url = strip("coalesce(url_afiliado, '')")
    old_line, now_line = _price_lines_sql(price, "✅ Por: R$ ")
    text = (f"concat_ws(chr(10), {badge}, {min_line}, '🔥 ' || {t}, '', "
            f"CASE WHEN {body} <> '' THEN substr({body}, 1, 140) END, CASE WHEN {body} <> '' THEN '' END, "
            f"{old_line}, {now_line}, CASE WHEN {url} <> '' THEN '' END, "
            f"CASE WHEN {url} <> '' THEN {q(Pl.THREADS_BUY)} || {url} END, '', {q(Pl.THREADS_FOOTER)})")
    return f"substr({text}, 1, {Pl.THREADS_MAX})"


def page_sql() -> str:
    t, price, badge, min_line = _head_sql()
    body = strip("coalesce(copy_corpo, '')")
    cta = strip(f"coalesce(CASE WHEN coalesce(copy_cta, '') <> '' THEN copy_cta END, {q(Pl.PAGE_DEFAULT_CTA)})")
    old_line, now_line = _price_lines_sql(price, "✅ Por apenas: R$ ")
    foot = ", ".join(q(x) for x in Pl.PAGE_FOOTER)
    return (f"concat_ws(chr(10), {badge}, {min_line}, '🔥 ' || {t}, '', CASE WHEN {body} <> '' THEN {body} END, "
            f"CASE WHEN {body} <> '' THEN '' END, {old_line}, {now_line}, '', '⚡ ' || {cta}, {foot})")


def messaging_sql() -> tuple[str, str, str]:
    title = "coalesce(CASE WHEN coalesce(copy_titulo, '') <> '' THEN copy_titulo END, nome_produto, 'Super Oferta!')"
    price, disc = "coalesce(preco_atual, 0.0)", "coalesce(percentual_desconto, 0.0)"
    media = "coalesce(preco_medio_historico, 0.0)"
    url = "coalesce(url_afiliado, '')"
    store = (f"coalesce(CASE WHEN coalesce(loja, '') <> '' THEN loja END, CASE WHEN contains(lower({url}), "
             f"'mercadolivre') THEN 'Mercado Livre' ELSE 'Magalu' END)")
    is_b = f"contains(lower({store}), 'mercado')"
    nl = "chr(10)"
    seal = (f"CASE WHEN coalesce(menor_preco_historico, false) THEN CASE WHEN {media} > {price} THEN "
            f"{q(Pl.MSG_MIN_PRICE + ' (Média anterior: R$ ')} || printf('%.2f', {media}) || ')' || {nl} "
            f"ELSE {q(Pl.MSG_MIN_PRICE)} || {nl} END ELSE '' END")
    body = "coalesce(copy_corpo, '')"
    old_line = (f"CASE WHEN preco_antigo IS NOT NULL AND preco_antigo <> 0 AND preco_antigo > {price} THEN "
                f"'❌ De: <s>R$ ' || printf('%.2f', preco_antigo) || '</s>' || {nl} ELSE '' END")
    text = (f"CASE WHEN {is_b} THEN {q(Pl.MSG_BADGE_B)} ELSE {q(Pl.MSG_BADGE_A)} END || {nl} || {seal} || "
            f"'🔥 <b>' || {title} || '</b>' || {nl} || {nl} || "
            f"CASE WHEN {body} <> '' THEN {body} || {nl} || {nl} ELSE '' END || {old_line} || "
            f"'✅ <b>Por apenas: R$ ' || printf('%.2f', {price}) || '</b>' || {nl} || "
            f"'📉 <b>Desconto: ' || CAST(CAST(round_even({disc}, 0) AS BIGINT) AS VARCHAR) || '% OFF</b>' || {nl} || {nl} "
            f"|| '⚡ <i>' || coalesce(copy_cta, 'Garanta o seu com desconto!') || '</i>'")
    button = (f"CASE WHEN {url} <> '' THEN CASE WHEN {is_b} THEN {q(Pl.MSG_BUTTON_B)} ELSE {q(Pl.MSG_BUTTON_A)} END END")
    return text, button, f"CASE WHEN {url} <> '' THEN {url} END"


def digest_block_sql() -> str:
    import re
    price, comm = "coalesce(preco_atual, 0.0)", "comissao_percent"
    lucro = f"coalesce(lucro_estimado_reais, CASE WHEN {comm} IS NOT NULL THEN round_even({price} * ({comm} / 100.0), 2) END)"
    vals = {
        "loja": "coalesce(loja, 'Oferta')", "n": "CAST(pos AS VARCHAR)", "nome": "coalesce(nome_produto, 'N/A')",
        "preco": f"printf('%.2f', {price})", "desconto": "CAST(coalesce(percentual_desconto, 0.0) AS VARCHAR)",
        "comissao": f"CASE WHEN {comm} IS NOT NULL THEN CAST({comm} AS VARCHAR) || '%' ELSE 'N/A' END",
        "lucro": f"CASE WHEN ({lucro}) IS NOT NULL THEN 'R$ ' || printf('%.2f', {lucro}) ELSE 'N/A' END",
        "titulo": "coalesce(copy_titulo, 'N/A')", "corpo": "coalesce(copy_corpo, 'N/A')",
        "cta": "coalesce(copy_cta, 'N/A')", "url": "coalesce(url_afiliado, '#')",
    }
    parts, pos, t = [], 0, Pl.DIGEST_TEMPLATE
    for m in re.finditer(r"\{(\w+)\}", t):
        parts.append(q(t[pos:m.start()]).replace("\n", "' || chr(10) || '"))
        parts.append(f"({vals[m.group(1)]})")
        pos = m.end()
    parts.append(q(t[pos:]).replace("\n", "' || chr(10) || '"))
    return " || ".join(parts)


def narration_sql() -> str:
    raw = strip(f"coalesce({nonblank('nome_produto')}, {nonblank('copy_titulo')}, 'esse produto')")
    name = strip(f"regexp_replace(regexp_replace({raw}, '[^\\p{{L}}\\p{{N}}_\\sÀ-ÿ\\-\\+\\.]', ' ', 'g'), "
                 f"'\\s+', ' ', 'g')")
    name = f"CASE WHEN length({name}) > 65 THEN regexp_replace(substr({name}, 1, 65), ' [^ ]*$', '') ELSE {name} END"
    price = "coalesce(preco_atual, 0.0)"
    reais = f"CAST(floor({price}) AS BIGINT)"
    cents = f"CAST(round_even(({price} - {reais}) * 100.0, 0) AS BIGINT)"
    spoken = (f"CASE WHEN {cents} = 0 THEN CAST({reais} AS VARCHAR) || ' reais' ELSE CAST({reais} AS VARCHAR) "
              f"|| ' reais e ' || CAST({cents} AS VARCHAR) || ' centavos' END")
    opening = f"CASE WHEN coalesce(menor_preco_historico, false) THEN {q(Pl.NARRATION_OPEN_MIN)} ELSE {q(Pl.NARRATION_OPEN)} END"
    part = (f"CASE WHEN preco_antigo IS NOT NULL AND preco_antigo <> 0 AND preco_antigo > {price} THEN 'caiu de ' || "
            f"CAST(CAST(round_even(preco_antigo, 0) AS BIGINT) AS VARCHAR) || ' reais por apenas ' || {spoken} || '!' "
            f"ELSE 'por apenas ' || {spoken} || '!' END")
    disc = "coalesce(percentual_desconto, 0.0)"
    pct = (f"CASE WHEN {disc} >= 10 THEN 'São ' || CAST(CAST(round_even({disc}, 0) AS BIGINT) AS VARCHAR) "
           f"|| ' por cento de desconto!' END")
    return f"concat_ws(' ', {opening} || ' ' || {name}, {part}, {pct}, {q(Pl.NARRATION_CLOSE)})"


def social_image_sql(h: str) -> str:
    outs = []
    for p in Pl.SOCIAL_IMAGE_PATTERNS:
        m = f"regexp_extract(coalesce({h}, ''), {q(p)}, 1)"
        u = m
        for ent, rep in ENTITIES:
            u = f"replace({u}, {q(ent)}, {q(rep)})"
        u = strip(u)
        u = f"CASE WHEN starts_with({u}, '//') THEN 'https:' || {u} ELSE {u} END"
        outs.append(f"CASE WHEN {m} <> '' AND {u} <> '' AND NOT starts_with({u}, 'data:') "
                    f"AND starts_with({u}, 'http') THEN {u} END")
    return "coalesce(" + ", ".join(outs) + ")"


def build_payloads() -> dict[str, str]:
    s: dict[str, str] = {}
    pre = _with(*offers_ctes(), *balance_ctes(), *fallback_ctes())
    s["caption_microblog"] = pre + f"SELECT pos, sku_selecionado, {caption_sql()} AS legenda FROM picks_c"
    s["caption_threads"] = pre + f"SELECT pos, sku_selecionado, {threads_sql()} AS legenda FROM picks_c"
    s["caption_page"] = pre + f"SELECT pos, sku_selecionado, {page_sql()} AS legenda FROM picks_c"
    mt, mb, mu = messaging_sql()
    s["caption_messaging"] = pre + f"SELECT pos, sku_selecionado, {mt} AS legenda, {mb} AS botao, {mu} AS url_botao FROM picks_c"
    s["digest_html"] = pre + f"SELECT string_agg({digest_block_sql()}, '' ORDER BY pos) AS html FROM picks_c"
    s["narration_text"] = pre + f"SELECT pos, sku_selecionado, {narration_sql()} AS locucao FROM picks_c"
    s["offer_summary"] = pre + """
SELECT pos, coalesce(sku_selecionado, '') AS sku,
       substr(coalesce(CASE WHEN coalesce(nome_produto, '') <> '' THEN nome_produto END, copy_titulo, ''), 1, 90)
         AS titulo,
       coalesce(categoria, 'Geral') AS categoria, coalesce(loja, '') AS loja, coalesce(preco_atual, 0.0) AS preco_atual
FROM picks_c WHERE pos <= 10"""
    s["posted_enrichment"] = pre + f""",
nowe AS (SELECT max(ts) AS now FROM events),
recent AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sku FROM events, nowe
           WHERE event_type = 'purchase' AND ts IS NOT NULL AND ts > nowe.now - INTERVAL {rules.REPEAT_LOCK_HOURS} HOUR),
posted AS (SELECT sku_selecionado AS sku FROM picks_c UNION SELECT sku FROM recent),
look AS (SELECT CAST(sku AS VARCHAR) AS k, arg_max({{'loja': loja, 'preco_atual': preco_atual}}, ord) AS v
         FROM offers_e GROUP BY 1)
SELECT p.sku, coalesce(look.v.loja, {store_sql('p.sku')}) AS loja, look.v.preco_atual AS preco_postado
FROM posted p LEFT JOIN look ON p.sku = look.k"""
    s["latest_top_posts"] = _with(POSTS) + """,
pr AS (SELECT *, CAST(created_time AS DATE) AS run_date,
              row_number() OVER (PARTITION BY CAST(created_time AS DATE)
                                 ORDER BY score DESC, created_time DESC, user_id) AS r FROM pe),
runs AS (SELECT run_date, list(user_id ORDER BY r) AS users, count(*) AS n FROM pr WHERE r <= 3 GROUP BY run_date),
newest AS (SELECT max(run_date) AS d FROM runs WHERE n > 0)
SELECT run_date, CASE WHEN run_date = newest.d THEN CAST(n AS INTEGER) ELSE 0 END AS n_top,
       CASE WHEN run_date = newest.d THEN array_to_string(users, ',') ELSE '' END AS top_users
FROM runs, newest"""
    s["page_social_image"] = f"SELECT page_id, {social_image_sql('html')} AS imagem_url FROM pages"
    return s
