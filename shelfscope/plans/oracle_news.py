"""Oracle SQL for the news family."""

from __future__ import annotations

from shelfscope.functions import rules
from shelfscope.plans.oracle_sql import _with, fold_sql, q, sigtok_sql, topic_sql, urlkey_sql

# entities that the driver's texts can hold, written out here so that the oracle stands alone
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
WS = "'^\\s+|\\s+$'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def clean_summary_sql(x: str, n: int = rules.SUMMARY_MAX_CHARS) -> str:
    t = f"coalesce({x}, '')"
    for ent, rep in ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(rep)})"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = strip_sql(f"regexp_replace({t}, '\\s+', ' ', 'g')")
    cut = f"regexp_replace(substr({t}, 1, {n - 3}), '\\s+$', '')"
    return f"CASE WHEN length({t}) > {n} THEN {cut} || '...' ELSE {t} END"


def headline_sql(x: str, n: int = 9) -> str:
    words = f"list_filter(regexp_split_to_array({strip_sql(f'coalesce({x}, {q(chr(0)*0)})')}, '\\s+'), lambda w: w <> '')"
    return f"array_to_string(list_slice({words}, 1, {n}), ' ')"


def category_tag_sql(x: str) -> str:
    up = f"upper({strip_sql(f'coalesce({x}, {q(chr(84)+chr(69)+chr(67)+chr(72))})')})"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({up}, {q(k)})" for k in keys) + f" THEN {q(name)}"
        for name, keys in rules.CATEGORY_TAG_GROUPS)
    return f"CASE {whens} WHEN {up} = '' THEN 'TECH' ELSE substr({up}, 1, 16) END"


FEED = f"""feed AS (
  SELECT doc_id, source AS fonte, text AS titulo, lang,
         'https://' || source || '.example.com/news/' || CAST(doc_id AS VARCHAR) AS url,
         CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS TIMESTAMP) AS publicado_em,
         {topic_sql('text')} AS tema_normalizado,
         {urlkey_sql("'https://' || source || '.example.com/news/' || CAST(doc_id AS VARCHAR)")} AS url_hash
  FROM documents)"""

RECENT = f"""nowf AS (SELECT max(publicado_em) AS now FROM feed),
rec AS (SELECT feed.* FROM feed, nowf
        WHERE publicado_em IS NOT NULL AND publicado_em >= nowf.now - INTERVAL {rules.NEWS_WINDOW_HOURS} HOUR
          AND publicado_em <= nowf.now + INTERVAL {rules.NEWS_FUTURE_MINUTES} MINUTE)"""


def build_news() -> dict[str, str]:
    s: dict[str, str] = {}
    s["feed_items"] = _with(FEED) + f"""
SELECT doc_id, fonte, url, publicado_em, tema_normalizado, url_hash, {clean_summary_sql('titulo')} AS resumo
FROM feed"""
    s["news_recent"] = _with(FEED, RECENT) + "SELECT doc_id, fonte, publicado_em, tema_normalizado FROM rec"
    inter = "len(list_intersect(a.toks, b.toks))"
    s["topic_dedup"] = _with(FEED) + f""",
d AS (SELECT doc_id, publicado_em AS t, url_hash, tema_normalizado AS topic,
             {sigtok_sql('tema_normalizado')} AS toks FROM feed),
pairs AS (
  SELECT a.doc_id AS ida, a.url_hash = b.url_hash AS same_url,
         (a.topic <> '' AND a.topic = b.topic) AS same_topic,
         (len(a.toks) > 0 AND len(b.toks) > 0 AND (
            ({inter} >= {rules.TOPIC_MIN_SHARED} AND {inter} / least(len(a.toks), len(b.toks)) >= {rules.TOPIC_CONTAINMENT})
            OR {inter} / (len(a.toks) + len(b.toks) - {inter}) >= {rules.TOPIC_JACCARD})) AS sim
  FROM d a JOIN d b
    ON (b.t < a.t OR (b.t = a.t AND b.doc_id < a.doc_id))
   AND b.t >= a.t - INTERVAL {rules.TOPIC_DEDUP_DAYS} DAY)
SELECT d.doc_id,
       coalesce(bool_or(same_url OR same_topic), false) AS ja_publicada,
       coalesce(bool_or(same_topic OR sim), false) AS tema_similar,
       NOT coalesce(bool_or(same_url OR same_topic OR sim), false) AS inedita
FROM d LEFT JOIN pairs ON d.doc_id = pairs.ida GROUP BY d.doc_id"""
    s["news_round_robin"] = _with(FEED, RECENT) + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY coalesce(fonte, 'Outros') ORDER BY publicado_em DESC, doc_id) AS rn
       FROM rec),
fp AS (SELECT coalesce(fonte, 'Outros') AS s, publicado_em AS ft, doc_id AS fo FROM rk WHERE rn = 1),
o AS (SELECT rk.*, fp.ft, fp.fo FROM rk JOIN fp ON coalesce(rk.fonte, 'Outros') = fp.s),
o2 AS (SELECT o.*, (SELECT count(*) FROM rec) > {rules.NEWS_CANDIDATES} AS rr FROM o)
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN rr THEN rn ELSE 0 END, CASE WHEN rr THEN ft END DESC,
                                        CASE WHEN rr THEN fo END, publicado_em DESC, doc_id) AS INTEGER) AS id_curto,
       doc_id, fonte, publicado_em
FROM o2 ORDER BY CASE WHEN rr THEN rn ELSE 0 END, CASE WHEN rr THEN ft END DESC, CASE WHEN rr THEN fo END,
         publicado_em DESC, doc_id LIMIT {rules.NEWS_CANDIDATES}"""
    s["page_url_dedup"] = f"""
WITH p AS (SELECT page_id, url, {urlkey_sql('url')} AS url_hash FROM pages)
SELECT url_hash, page_id, url
FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY page_id) AS r FROM p) WHERE r = 1"""
    s["editorial_text"] = _with(FEED) + f"""
SELECT doc_id, {headline_sql('titulo')} AS headline, {category_tag_sql('lang')} AS categoria_tag FROM feed"""
    pat = q(rules.HIGHLIGHT_TOKEN_PATTERN)
    s["highlight_marking"] = _with(FEED) + f""",
h AS (SELECT doc_id, {headline_sql('titulo')} AS headline,
             string_split(tema_normalizado, ' ')[3] AS destaque FROM feed),
h2 AS (SELECT *, {strip_sql("coalesce(destaque, '')")} AS d FROM h),
h3 AS (SELECT *,
  list_filter(regexp_extract_all(lower(d), {pat}), lambda t: length(t) >= 2) AS td,
  regexp_extract_all(lower(headline), {pat}) AS th,
  list_filter(list_transform(string_split(coalesce(destaque, ''), ' '),
      lambda x: regexp_replace({fold_sql('x')}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda x: x <> '') AS dest
  FROM h2)
SELECT doc_id,
  CASE WHEN d = '' OR headline = '' THEN ''
       WHEN (len(td) > 0 AND list_has_any(td, th)) OR contains(lower(headline), lower(d)) THEN d ELSE '' END
    AS destaque_valido,
  array_to_string(list_filter(list_filter(regexp_split_to_array({strip_sql('headline')}, '\\s+'), lambda w: w <> ''),
      lambda w: list_contains(dest, regexp_replace({fold_sql('w')}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))), ' ') AS palavras_destacadas
FROM h3"""
    s["feed_xml_items"] = _with(FEED, RECENT) + f"""
SELECT fonte, titulo, url, {clean_summary_sql('titulo')} AS resumo, tema_normalizado, publicado_em FROM rec"""
    s["published_today"] = _with(FEED) + """
SELECT coalesce(max(CAST(publicado_em AS DATE) = CAST((SELECT max(publicado_em) FROM feed) - INTERVAL 3 HOUR AS DATE)),
                false) AS publicado_hoje
FROM feed"""
    return s
