"""DuckDB oracle SQL for the registered queries.

Each entry is an independent set-based statement of the same semantics,
written against the driver's pre-registered views.  Shared derivations are
kept as CTE fragments below; rule tables are rendered from
``shelfscope.functions.rules`` so both sides use the same fixed values.
"""

from __future__ import annotations


from shelfscope.functions import rules


def rn(x: str, n: int = 2) -> str:
    p = 10 ** n
    return f"(floor(({x}) * {p}.0 + 0.5) / {p}.0)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sub(text: str, terms) -> str:
    if not terms:
        return "false"
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def store_sql(sku: str) -> str:
    s = f"upper(trim({sku}))"
    return (f"CASE WHEN starts_with({s}, {q(rules.SKU_PREFIX_B)}) THEN {q(rules.STORE_B)} "
            f"WHEN starts_with({s}, {q(rules.SKU_PREFIX_A)}) THEN {q(rules.STORE_A)} "
            f"ELSE {q(rules.STORE_UNKNOWN)} END")


def sku_sql(key: str) -> str:
    return (f"(CASE WHEN {key} % 4 = 0 THEN {q(rules.SKU_PREFIX_A)} ELSE {q(rules.SKU_PREFIX_B)} END"
            f" || CAST({key} AS VARCHAR))")


def two_tier_sql(cat: str, name: str, seller: str, table) -> str:
    text = f"lower(coalesce({cat}, '') || ' ' || coalesce({name}, ''))"
    d1, d3 = rules.COMMISSION_TWO_TIER_DEFAULT
    fp = ", ".join(q(s) for s in rules.FIRST_PARTY_SELLERS)
    r1 = "CASE " + " ".join(f"WHEN contains({text}, {q(k)}) THEN {a}" for k, a, _ in table) + f" ELSE {d1} END"
    r3 = "CASE " + " ".join(f"WHEN contains({text}, {q(k)}) THEN {b}" for k, _, b in table) + f" ELSE {d3} END"
    return rn(f"CASE WHEN {seller} IN ({fp}) THEN {r1} ELSE {r3} END")


def one_tier_sql(cat: str, name: str, table) -> str:
    text = f"lower(coalesce({cat}, '') || ' ' || coalesce({name}, ''))"
    return ("CASE " + " ".join(f"WHEN contains({text}, {q(k)}) THEN {float(r)}" for k, r in table)
            + f" ELSE {float(rules.COMMISSION_ONE_TIER_DEFAULT)} END")


def niche_sql(text: str, cat: str) -> str:
    off, strong, catb, none = rules.NICHE_SCORES
    return (f"CAST(CASE WHEN {any_sub(text, rules.TEST_OFF_NICHE_TERMS)} THEN {off} "
            f"WHEN {any_sub(text, rules.TEST_STRONG_NICHE_TERMS)} THEN {strong} "
            f"WHEN {any_sub(f'lower(coalesce({cat}, {q('')}))', rules.TEST_CATEGORY_NICHE_TERMS)} THEN {catb} "
            f"ELSE {none} END AS DOUBLE)")


def fold_sql(x: str) -> str:
    """Accent folding for the oracle: DuckDB's strip_accents on lower()."""
    return f"strip_accents(lower({x}))"


def topic_sql(x: str) -> str:
    return (f"array_to_string(list_slice(regexp_extract_all({fold_sql(x)}, '[a-z0-9]+'), 1, "
            f"{rules.TOPIC_TOKENS}), ' ')")


def sigtok_sql(topic: str) -> str:
    stop = "[" + ", ".join(q(w) for w in rules.TOPIC_STOPWORDS) + "]"
    return (f"list_sort(list_distinct(list_filter(string_split({topic}, ' '), "
            f"lambda t: length(t) >= 3 AND NOT list_contains({stop}, t))))")


def urlkey_sql(u: str) -> str:
    base = f"split_part(regexp_replace({u}, '^\\s+|\\s+$', '', 'g'), '#', 1)"
    return f"sha256(regexp_replace({base}, '/+$', ''))"


# ---------------------------------------------------------------- CTE fragments
def obs_cte(key: str = "l_suppkey", name: str = "obs") -> str:
    sku = sku_sql(key)
    return f"""{name} AS (
  SELECT {sku} AS sku, {store_sql(sku)} AS loja, CAST(l_shipdate AS DATE) AS data_coleta,
         {rn('l_extendedprice / l_quantity')} AS preco,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'part ' || CAST(l_partkey AS VARCHAR) END AS titulo,
         CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag END AS categoria,
         l_shipdate AS ts, l_orderkey AS seq1, CAST(l_linenumber AS BIGINT) AS seq2
  FROM lineitem)"""


def hist_cte(src: str = "obs", name: str = "hist") -> str:
    return HIST_CTE.replace("FROM obs", f"FROM {src}").replace("hist AS (", f"{name} AS (", 1)


HIST_CTE = """hist AS (
  SELECT sku, loja, data_coleta,
         min(preco) AS preco_min_dia,
         arg_max(preco, (ts, seq1, seq2)) AS preco_ultimo,
         coalesce(arg_max(titulo, (ts, seq1, seq2)) FILTER (WHERE titulo <> ''), '') AS titulo,
         coalesce(arg_max(categoria, (ts, seq1, seq2)) FILTER (WHERE categoria <> ''), '') AS categoria,
         max(ts) AS atualizado_em
  FROM obs GROUP BY sku, loja, data_coleta)"""


def radar_cte(ref_dates, days: int = rules.HISTORY_DAYS) -> str:
    refs = " UNION ALL ".join(f"SELECT DATE {q(d)} AS ref_date" for d in ref_dates)
    return f"""refs AS ({refs}),
offers AS (
  SELECT r.ref_date, h.sku, h.loja, arg_min(h.data_coleta, h.data_coleta) AS oferta_dia,
         arg_min(h.preco_min_dia, h.data_coleta) AS preco_atual
  FROM hist h JOIN refs r ON h.data_coleta >= r.ref_date
  GROUP BY r.ref_date, h.sku, h.loja),
stats AS (
  SELECT o.ref_date, o.sku, o.loja, o.oferta_dia, o.preco_atual,
         {rn('min(h.preco_min_dia)')} AS min_180d,
         {rn('quantile_cont(' + CENTS.format('h.preco_min_dia') + ', 0.5) / 100.0')} AS mediana_180d,
         {rn('CAST(sum(' + CENTS.format('h.preco_min_dia') + ') AS DOUBLE) / count(h.preco_min_dia) / 100.0')}
           AS media_180d,
         count(h.preco_min_dia) AS dias_observados
  FROM offers o LEFT JOIN hist h
    ON h.sku = o.sku AND h.loja = o.loja AND h.preco_min_dia > 0
   AND h.data_coleta >= o.oferta_dia - INTERVAL {days} DAY AND h.data_coleta <= o.oferta_dia
   AND h.data_coleta <> o.oferta_dia
  GROUP BY o.ref_date, o.sku, o.loja, o.oferta_dia, o.preco_atual),
radar AS ({flags_select("stats")})"""


def flags_select(src: str) -> str:
    return f"""SELECT *,
    CASE WHEN preco_atual > 0 AND mediana_180d > 0 AND mediana_180d > preco_atual
         THEN {rn('(mediana_180d - preco_atual) / mediana_180d * 100.0', 1)} ELSE 0.0 END AS queda_real_percent,
    coalesce(preco_atual > 0 AND dias_observados >= {rules.WARMUP_DAYS} AND min_180d IS NOT NULL
             AND preco_atual < min_180d, false) AS menor_preco_historico,
    CASE WHEN preco_atual > 0 AND mediana_180d > 0 THEN mediana_180d ELSE 0.0 END AS preco_medio_historico
  FROM {src}"""


CENTS = "CAST(floor(({}) * 100.0 + 0.5) AS BIGINT)"

RADAR_DATES = ["1999-06-15", "2000-06-15", "2001-03-01"]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def build() -> dict[str, str]:
    s: dict[str, str] = {}
    s["price_history_daily"] = _with(obs_cte(), HIST_CTE) + "SELECT * FROM hist"
    s["price_radar"] = _with(obs_cte(), HIST_CTE, radar_cte(RADAR_DATES)) + "SELECT * FROM radar"
    s["radar_counters"] = _with(obs_cte(), HIST_CTE, radar_cte(RADAR_DATES)) + """
SELECT ref_date, CAST(count(*) FILTER (WHERE menor_preco_historico) AS BIGINT) AS qtd_minimas,
       CAST(count(*) FILTER (WHERE queda_real_percent >= 5.0) AS BIGINT) AS qtd_quedas,
       CAST(count(*) AS BIGINT) AS qtd_ofertas
FROM radar GROUP BY ref_date"""
    s["radar_backfill"] = _with(obs_cte(), HIST_CTE) + f"""
, w AS (
  SELECT sku, loja, data_coleta, preco_min_dia AS preco_atual,
    {rn('min(CASE WHEN preco_min_dia > 0 THEN preco_min_dia END) OVER win')} AS min_180d,
    {rn('quantile_cont(' + CENTS.format('CASE WHEN preco_min_dia > 0 THEN preco_min_dia END') + ', 0.5) OVER win / 100.0')} AS mediana_180d,
    {rn('CAST(sum(' + CENTS.format('CASE WHEN preco_min_dia > 0 THEN preco_min_dia END') + ') OVER win AS DOUBLE) / count(CASE WHEN preco_min_dia > 0 THEN preco_min_dia END) OVER win / 100.0')} AS media_180d,
    count(CASE WHEN preco_min_dia > 0 THEN preco_min_dia END) OVER win AS dias_observados
  FROM hist
  WINDOW win AS (PARTITION BY sku, loja ORDER BY date_diff('day', DATE '1970-01-01', data_coleta)
                 RANGE BETWEEN {rules.HISTORY_DAYS} PRECEDING AND 1 PRECEDING))
SELECT *,
    CASE WHEN preco_atual > 0 AND mediana_180d > 0 AND mediana_180d > preco_atual
         THEN {rn('(mediana_180d - preco_atual) / mediana_180d * 100.0', 1)} ELSE 0.0 END AS queda_real_percent,
    coalesce(preco_atual > 0 AND dias_observados >= {rules.WARMUP_DAYS} AND min_180d IS NOT NULL
             AND preco_atual < min_180d, false) AS menor_preco_historico,
    CASE WHEN preco_atual > 0 AND mediana_180d > 0 THEN mediana_180d ELSE 0.0 END AS preco_medio_historico
FROM w"""
    from shelfscope.plans.oracle_offers import build_offers
    s.update(build_offers())
    from shelfscope.plans.oracle_news import build_news
    s.update(build_news())
    from shelfscope.plans.oracle_metrics import build_metrics
    s.update(build_metrics())
    from shelfscope.plans.oracle_maint import build_maint
    s.update(build_maint())
    from shelfscope.plans.oracle_ingest import build_ingest
    s.update(build_ingest())
    from shelfscope.plans.oracle_payloads import build_payloads
    s.update(build_payloads())
    from shelfscope.plans.oracle_responses import build_responses
    s.update(build_responses())
    from shelfscope.plans.oracle_jobs import build_jobs
    s.update(build_jobs())
    from shelfscope.plans.oracle_records import build_records
    s.update(build_records())
    return s
