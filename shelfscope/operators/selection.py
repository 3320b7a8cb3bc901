"""Offer selection: de-duplication, repeat lock, scoring, quotas, balanced picks.

Ordering semantics of the original lists are carried by explicit ordinal
columns (``ord`` or (source_rank, page, idx)); every "sorted, stable" step
orders by (score desc, ord asc).

Scale notes
* keep-first de-duplication and first-of-model are ``min(struct(...))``
  aggregates: partial aggregation before the shuffle, so a SKU or model that
  holds a third of all rows never lands whole in one task.
* per-store / per-channel top-N use ``row_number() <= N``, which Spark plans
  as a partial ``WindowGroupLimit`` on the map side: at most N rows per task
  and key cross the shuffle.
* the repeat-lock fallback is decided by a scalar subquery (one number), not
  by a driver-side ``if`` on a collected count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.pricing import hash_jitter, niche_bonus, quality_score, search_text
from shelfscope.functions.text import model_key, py_strip, round_n, truncate_ellipsis


# ----------------------------------------------------------------------- W1/U1
def keep_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """First row per ``key`` in (order_cols) order; blank keys dropped."""
    payload = [c for c in df.columns if c != key]
    agg = (df.filter(F.col(key).isNotNull() & (py_strip(F.col(key)) != ""))
           .groupBy(key)
           .agg(F.min(F.struct(*[F.col(c) for c in order_cols],
                               F.struct(*[F.col(c) for c in payload]).alias("row"))).alias("m")))
    return agg.select(key, *[F.col(f"m.row.{c}").alias(c) for c in payload])


def union_routes(*dfs: DataFrame) -> DataFrame:
    """Union of store / route outputs; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# -------------------------------------------------------------------- A15 / J2
def latest_posts(posted: DataFrame, now, hours: int = rules.REPEAT_LOCK_HOURS) -> DataFrame:
    """Latest post time per sku strictly inside the window (store ignored)."""
    limit = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (posted.filter(F.col("postado_em").isNotNull() & (F.col("postado_em") > limit))
            .groupBy("sku").agg(F.max("postado_em").alias("ultimo_post")))


def repeat_lock(offers: DataFrame, recent: DataFrame, min_fresh: int = rules.MIN_FRESH_OFFERS) -> DataFrame:
    """Drop recently posted skus, unless fewer than ``min_fresh`` would remain."""
    blocked = recent.select(F.col("sku").alias("_b_sku")).withColumn("_blocked", F.lit(True))
    flagged = (offers.join(blocked, offers["sku"] == blocked["_b_sku"], "left")
               .withColumn("_blocked", F.coalesce("_blocked", F.lit(False))).drop("_b_sku"))
    n_fresh = flagged.filter(~F.col("_blocked")).select(F.count(F.lit(1))).scalar()
    return flagged.filter(~F.col("_blocked") | (n_fresh < F.lit(min_fresh))).drop("_blocked")


# ------------------------------------------------------------------- P14-P23
def add_niche_and_model(df: DataFrame, off=None, strong=None, cat_terms=None,
                        title_col: str | None = None) -> DataFrame:
    text_cols = ["nome_produto", "categoria"] + ([title_col] if title_col else [])
    return (df.withColumn("bonus_nicho", niche_bonus(*text_cols, category="categoria", off_terms=off,
                                                     strong_terms=strong, category_terms=cat_terms))
            .withColumn("modelo", model_key("nome_produto")))


def add_score(df: DataFrame, jitter=None, run_id: str | None = None) -> DataFrame:
    """P18; with ``run_id`` the jitter of that run is added, the same each time the run is repeated."""
    if run_id is not None:
        jitter = hash_jitter("sku", run_id)
    return df.withColumn("score_qualidade", quality_score(
        "menor_preco_historico", "queda_real_percent", "percentual_desconto",
        "lucro_estimado_reais", "preco_atual", jitter))


# ------------------------------------------------------------------------- Q1
def store_counts(df: DataFrame) -> DataFrame:
    """A4: one row with the offer count of each store."""
    return df.agg(F.count_if(F.lower("loja").contains("mercado")).alias("n_b"),
                  F.count_if(F.lower("loja").contains("magalu")).alias("n_a"))


def quota_columns(n_b, n_a, total: int = rules.TOTAL_PICKS, target_b: int = rules.TARGET_B,
                  target_a: int = rules.TARGET_A):
    """Q1 closed form: targets capped by stock, shortfall to A first, then B."""
    db, da = F.greatest(F.lit(0), n_b), F.greatest(F.lit(0), n_a)
    meta = F.least(F.lit(total), db + da)
    qb, qa = F.least(F.lit(max(0, target_b)), db), F.least(F.lit(max(0, target_a)), da)
    short = meta - (qb + qa)
    add_a = F.when((short > 0) & (da > qa), F.least(short, da - qa)).otherwise(F.lit(0))
    short2 = short - add_a
    add_b = F.when((short2 > 0) & (db > qb), F.least(short2, db - qb)).otherwise(F.lit(0))
    ok = meta > 0
    return (F.when(ok, qb + add_b).otherwise(F.lit(0)).cast("bigint"),
            F.when(ok, qa + add_a).otherwise(F.lit(0)).cast("bigint"))


def store_quota(df: DataFrame, **kw) -> DataFrame:
    c = store_counts(df)
    qb, qa = quota_columns(F.col("n_b"), F.col("n_a"), **kw)
    return c.select("n_b", "n_a", qb.alias("cota_b"), qa.alias("cota_a"))


# ------------------------------------------------------------------ W4/Q3/K3
def balance_candidates(df: DataFrame) -> DataFrame:
    """Q3: per-store caps on the score ranking (80 of B, or 120 when A gets no
    quota; A gets max(40, 120 - |B kept|)); when a store is empty, the global top 120.

    The store counts are one scalar aggregate; the caps then become literals,
    so ``row_number() <= cap`` is planned as a partial WindowGroupLimit (at
    most ``cap`` rows per task and store cross the shuffle)."""
    is_b = F.lower("loja").contains("mercado")
    is_a = F.lower("loja").contains("magalu")
    q = store_quota(df).first()
    n_b, n_a, cota_a = int(q["n_b"]), int(q["n_a"]), int(q["cota_a"])
    cap_b = rules.CANDIDATE_CAP_B if cota_a > 0 else rules.CANDIDATE_CAP_B_ALONE
    cap_a = max(rules.CANDIDATE_FLOOR_A, rules.CANDIDATE_CAP_TOTAL - min(n_b, cap_b))
    order = [F.col("score_qualidade").desc(), F.col("ord").asc()]
    if n_b > 0 and n_a > 0:
        w = Window.partitionBy(is_b).orderBy(*order)
        ranked = df.filter(is_a | is_b).withColumn("_rk_store", F.row_number().over(w))
        return (ranked.filter(F.col("_rk_store") <= max(cap_a, cap_b))
                .filter((is_b & (F.col("_rk_store") <= cap_b)) | (is_a & (F.col("_rk_store") <= cap_a)))
                .drop("_rk_store"))
    return df.orderBy(*order).limit(rules.CANDIDATE_CAP_TOTAL)


# ------------------------------------------------------------------------- W5
def tier_models(df: DataFrame, rank_cols: list) -> DataFrame:
    """W5 tiers: 0 = in-niche first of its model, 1 = in-niche repeat, 2 = off-niche.

    First-of-model is a min(struct(rank)) aggregate per model among in-niche
    rows (partial aggregation, skew-safe), joined back on (model, rank)."""
    adherent = F.col("bonus_nicho") >= 0
    rank_struct = F.struct(*rank_cols)
    firsts = (df.filter(adherent & (F.col("modelo") != ""))
              .groupBy("modelo").agg(F.min(rank_struct).alias("_first")))
    j = df.join(firsts, "modelo", "left")
    is_first = (F.col("modelo") == "") | (F.col("_first") == rank_struct)
    return j.withColumn("_tier", F.when(~adherent, 2).when(is_first, 0).otherwise(1)).drop("_first")


def distinct_model_pick(df: DataFrame, limit: int, rank_cols: list | None = None) -> DataFrame:
    """First ``limit`` rows by (tier, rank); at least one when input is non-empty.

    A top-k (TakeOrderedAndProject) over the tiered rows: each task keeps its
    own best ``limit`` rows, so only k rows per task reach the final merge."""
    rank_cols = rank_cols or [F.col("_neg_score"), F.col("ord")]
    k = max(int(limit), 1)
    top = tier_models(df, rank_cols).orderBy(F.col("_tier"), *rank_cols).limit(k)
    w = Window.orderBy(F.col("_tier"), *rank_cols)  # over at most k rows
    return top.withColumn("_pos", F.row_number().over(w))


# ------------------------------------------------------------------------- Q2
def copy_columns(df: DataFrame) -> DataFrame:
    """Saving, title, body and call to action of the rule-based copy."""
    preco, ant = F.col("preco_atual"), F.coalesce(F.col("preco_antigo"), F.col("preco_atual"))
    economia = round_n(F.greatest(F.lit(0.0), ant - preco), 2)
    desc, queda = F.coalesce(F.col("percentual_desconto"), F.lit(0.0)), F.coalesce(
        F.col("queda_real_percent"), F.lit(0.0))
    return (df.withColumn("economia", economia)
            .withColumn("copy_titulo", truncate_ellipsis(F.col("nome_produto"), 50, 47))
            .withColumn("copy_tipo", F.when(F.col("menor_preco_historico"), F.lit("minima_180d"))
                        .when((economia >= 30) & (desc >= 10), F.lit("corte_real"))
                        .when(queda >= 5, F.lit("abaixo_mediana"))
                        .otherwise(F.lit("competitivo")))
            .withColumn("cta_tipo", F.when(economia >= 20, F.lit("economize"))
                        .when(desc >= 5, F.lit("off")).otherwise(F.lit("confira")))
            .withColumn("copy_corpo", _copy_body(economia, desc, queda))
            .withColumn("copy_cta", _copy_cta(economia, desc)))


def _int0(c):
    """Python '{:.0f}': half-to-even on the exact binary value."""
    return F.bround(c, 0).cast("bigint").cast("string")


def _store_name():
    from shelfscope.functions.pricing import store_from_sku
    return py_strip(F.coalesce(F.when(F.coalesce(F.col("loja"), F.lit("")) != "", F.col("loja")),
                               store_from_sku(F.col("sku"))))


def _copy_body(economia, desc, queda):
    """P35 body text (fixed sentences of the deterministic selection)."""
    loja, preco = _store_name(), F.format_string("%.2f", F.col("preco_atual"))
    return (F.when(F.coalesce(F.col("menor_preco_historico"), F.lit(False)), F.concat(
                F.lit("Bateu o menor preço em 180 dias ("), _int0(queda),
                F.lit("% abaixo da mediana recente) — queda real comprovada.")))
            .when((economia >= 30) & (desc >= 10), F.replace(F.concat(
                F.lit("Corte real de R$ "), F.format_number(economia, 0), F.lit(" frente ao valor anterior ("),
                _int0(desc), F.lit("% OFF) nesta janela em "), loja, F.lit(".")), F.lit(","), F.lit(".")))
            .when(queda >= 5, F.concat(F.lit("Está "), _int0(queda), F.lit("% abaixo da mediana dos últimos 6 meses em "),
                                       loja, F.lit(", saindo por R$ "), preco, F.lit(".")))
            .otherwise(F.concat(F.lit("Condição competitiva no radar em "), loja, F.lit(" por R$ "), preco,
                                F.lit(" para upgrade direto no setup."))))


def _copy_cta(economia, desc):
    """P35 call to action."""
    return (F.when(economia >= 20, F.replace(F.concat(F.lit("Economize R$ "), F.format_number(economia, 0),
                                                      F.lit(" garantindo agora!")), F.lit(","), F.lit(".")))
            .when(desc >= 5, F.concat(F.lit("Garanta com "), _int0(desc), F.lit("% OFF enquanto dura!")))
            .otherwise(F.lit("Confira o preço antes do reajuste!")))


def fallback_selection(cands: DataFrame, qtd_b: int = rules.TARGET_B, qtd_a: int = rules.TARGET_A
                       ) -> DataFrame:
    """Q2: deterministic selection over ranked candidates.

    1. rank by (score desc, ord); 2. W5 per store with limits qtd_b / qtd_a;
    3. top up to qtd_b + qtd_a from the leftovers, unused models first;
    4. interleave 3 of B : 1 of A; 5. cap; 6. rule-based copy (P35).
    Output: one row per pick with its position ``pos``.
    """
    total = qtd_b + qtd_a
    for c, t in (("url_afiliado", "string"), ("preco_medio_historico", "double"), ("comissao_percent", "double"),
                 ("lucro_estimado_reais", "double"), ("imagem_url", "string")):
        if c not in cands.columns:
            cands = cands.withColumn(c, F.lit(None).cast(t))
    # a missing score is computed, so that it does not rank before or after all others
    score = F.coalesce(F.col("score_qualidade"), quality_score(
        *[F.col(c) if c in cands.columns else F.lit(None).cast("double") for c in
          ("menor_preco_historico", "queda_real_percent", "percentual_desconto", "lucro_estimado_reais",
           "preco_atual")]))
    base = (cands.withColumn("_neg_score", -score)
            .withColumn("_store", F.when(F.lower("loja").contains("mercado"), F.lit("B"))
                        .when(F.lower("loja").contains("magalu"), F.lit("A")).otherwise(F.lit("X"))))
    rank = [F.col("_neg_score"), F.col("ord")]
    picked = (distinct_model_pick(base.filter(F.col("_store") == "B"), qtd_b, rank)
              .unionByName(distinct_model_pick(base.filter(F.col("_store") == "A"), qtd_a, rank))
              .select(*base.columns, F.lit(0).alias("_src"), F.col("_pos")))
    n_picked = picked.select(F.count(F.lit(1))).scalar()
    used_models = picked.select(F.col("modelo").alias("_um")).distinct()
    left = base.join(picked.select(F.col("sku").alias("_us")), base["sku"] == F.col("_us"), "left_anti")
    left = (left.join(used_models, left["modelo"] == used_models["_um"], "left")
            .withColumn("_rep", F.col("_um").isNotNull()).drop("_um"))
    w_left = Window.orderBy(F.col("_rep"), *rank)  # over at most `total` rows
    extra = (left.orderBy(F.col("_rep"), *rank).limit(total)
             .withColumn("_k", F.row_number().over(w_left))
             .filter(F.col("_k") <= F.greatest(F.lit(0), F.lit(total) - n_picked))
             .withColumn("_store", F.when(F.lower("loja").contains("magalu"), F.lit("A")).otherwise(F.lit("B")))
             .select(*base.columns, F.lit(1).alias("_src"), F.col("_k").alias("_pos")))
    allp = picked.unionByName(extra)
    w_store = Window.partitionBy("_store").orderBy("_src", "_pos")
    seq = allp.withColumn("_i", F.row_number().over(w_store) - 1)
    block = F.when(F.col("_store") == "B", F.floor(F.col("_i") / 3)).otherwise(F.col("_i"))
    within = F.when(F.col("_store") == "B", F.col("_i") % 3).otherwise(F.lit(3))
    w_final = Window.orderBy(block, within)  # at most 2 * total rows
    out = seq.withColumn("pos", F.row_number().over(w_final)).filter(F.col("pos") <= total)
    out = copy_columns(out)
    return out.select("pos", F.col("sku").alias("sku_selecionado"), "nome_produto", "loja", "categoria",
                      "preco_atual", "preco_antigo", "percentual_desconto", "menor_preco_historico",
                      "queda_real_percent", "preco_medio_historico", "url_afiliado", "comissao_percent",
                      "lucro_estimado_reais", "imagem_url", F.lit(rules.TOP_UP_REASON).alias("razao_selecao"), "economia",
                      "copy_titulo", "copy_tipo", "cta_tipo", "copy_corpo", "copy_cta")


# ------------------------------------------------------------------- P19 / K2
def channel_scores(df: DataFrame, weights=None) -> DataFrame:
    """One row per (offer, channel) via an array of per-channel scores
    (explode, no join): niche? + bonus*is_min + w*drop + 0.6*discount + 0.4*profit."""
    weights = weights or rules.CHANNEL_WEIGHTS
    is_min = F.coalesce(F.col("menor_preco_historico"), F.lit(False))
    entries = []
    for name, bonus, w, use_niche in weights:
        s = ((F.col("bonus_nicho") if use_niche else F.lit(0.0))
             + F.when(is_min, F.lit(bonus)).otherwise(F.lit(0.0))
             + F.coalesce(F.col("queda_real_percent"), F.lit(0.0)) * w
             + F.coalesce(F.col("percentual_desconto"), F.lit(0.0)) * 0.6
             + F.coalesce(F.col("lucro_estimado_reais"), F.lit(0.0)) * 0.4)
        entries.append(F.struct(F.lit(name).alias("canal"), s.alias("score_canal")))
    return df.withColumn("_cs", F.explode(F.array(*entries))).select("*", "_cs.*").drop("_cs")


def channel_top(df: DataFrame, limits=None) -> DataFrame:
    """K2: top N per channel by channel score; the messaging channel applies W5 first.

    ``row_number() <= max(N)`` is a literal bound, planned as a partial
    WindowGroupLimit before the shuffle; the exact per-channel N follows."""
    limits = limits or rules.CHANNEL_LIMITS
    cs = channel_scores(df).withColumn("_neg_score", -F.col("score_canal"))
    lim = F.lit(0)
    for ch, n in limits.items():
        lim = F.when(F.col("canal") == ch, F.lit(n)).otherwise(lim)
    rank = [F.col("_neg_score"), F.col("ord")]
    w = Window.partitionBy("canal").orderBy(*rank)
    top_plain = (cs.filter(F.col("canal") != "telegram")
                 .withColumn("_pos", F.row_number().over(w))
                 .filter(F.col("_pos") <= max(limits.values()))
                 .filter(F.col("_pos") <= lim))
    tele = distinct_model_pick(cs.filter(F.col("canal") == "telegram"), limits.get("telegram", 10), rank)
    cols = ["canal", "_pos", "sku", "nome_produto", "score_canal"]
    return top_plain.select(*cols).unionByName(tele.select(*cols)).withColumnRenamed("_pos", "pos")


# ------------------------------------------------------------------------- K6
def compact_for_retry(df: DataFrame, limit: int = 50, first_n: int = 25, order=None) -> DataFrame:
    """K6: when more than ``limit`` candidates, keep the first 25 of B and
    max(1, limit - kept B) of A in candidate-list order; otherwise keep all."""
    order = order or [F.col("score_qualidade").desc(), F.col("ord")]
    n = df.select(F.count(F.lit(1))).scalar()
    is_b, is_a = F.lower("loja").contains("mercado"), F.lower("loja").contains("magalu")
    w = Window.partitionBy(F.when(is_b, 0).otherwise(1)).orderBy(*order)
    kept_b = F.least(df.filter(is_b).select(F.count(F.lit(1))).scalar(), F.lit(first_n))
    cut = (df.filter(is_a | is_b).withColumn("_r", F.row_number().over(w))
           .filter(F.col("_r") <= limit)
           .filter((is_b & (F.col("_r") <= first_n))
                   | (is_a & (F.col("_r") <= F.greatest(F.lit(1), F.lit(limit) - kept_b))))
           .drop("_r"))
    return df.filter(n <= limit).unionByName(cut.filter(n > limit))


# ------------------------------------------------------------------------- J3
def _lookup(catalog: DataFrame, key_expr, key_name: str, fields: list[str]) -> DataFrame:
    """Last row per key in catalogue order (``ord``): later rows overwrite."""
    return (catalog.filter(key_expr.isNotNull() & (key_expr != ""))
            .groupBy(key_expr.alias(key_name))
            .agg(F.max(F.struct(F.col("ord"), F.struct(*fields).alias("info"))).getField("info").alias(
                f"info_{key_name}")))


def name_key(c):
    return F.substring(F.lower(py_strip(F.coalesce(c, F.lit("")))), 1, 40)


def rehydrate(ops: DataFrame, catalog: DataFrame) -> DataFrame:
    """Match by sku, else affiliate url, else normalised name; radar fields are
    always taken from the match, the other fields only when blank."""
    radar_f = ["menor_preco_historico", "queda_real_percent", "preco_medio_historico"]
    str_f = ["url_afiliado", "imagem_url", "categoria", "loja"]
    num_f = ["preco_antigo", "comissao_percent", "lucro_estimado_reais"]
    fields = radar_f + str_f + num_f
    by_sku = _lookup(catalog, F.col("sku").cast("string"), "k_sku", fields)
    by_url = _lookup(catalog, F.coalesce(F.col("url_afiliado"), F.lit("")), "k_url", fields)
    by_name = _lookup(catalog, name_key(F.col("nome_produto")), "k_name", fields)
    # blank URLs match nothing; a key of their own row each spreads them over the tasks
    nowhere = F.concat(F.lit("\0"), F.xxhash64(ops["sku_selecionado"], ops["nome_produto"]).cast("string"))
    url = F.coalesce(F.nullif(ops["url_afiliado"], F.lit("")), nowhere)
    j = (ops.join(by_sku, ops["sku_selecionado"] == by_sku["k_sku"], "left")
         .join(by_url, url == by_url["k_url"], "left")
         .join(by_name, name_key(ops["nome_produto"]) == by_name["k_name"], "left"))
    info = F.coalesce("info_k_sku", "info_k_url", "info_k_name")
    out = j.withColumn("_info", info).withColumn("matched", F.col("_info").isNotNull())
    for f in radar_f:
        out = out.withColumn(f, F.when(F.col("matched"), F.col(f"_info.{f}")).otherwise(F.col(f)))
    for f in str_f + num_f:
        cur = F.col(f)
        blank = cur.isNull() | ((cur == "") if f in str_f else (cur == 0))
        out = out.withColumn(f, F.when(F.col("matched") & blank & F.col(f"_info.{f}").isNotNull(),
                                       F.col(f"_info.{f}")).otherwise(cur))
    return out.drop("_info", "info_k_sku", "info_k_url", "info_k_name", "k_sku", "k_url", "k_name")


# ------------------------------------------------------------------------- J8
def remaining_candidates(cands: DataFrame, ops: DataFrame) -> DataFrame:
    """Candidates whose sku and name[:40] are both unused by the picks
    (set difference by key as two left-anti joins)."""
    used_sku = ops.filter(F.col("sku_selecionado").isNotNull() & (py_strip(F.col("sku_selecionado")) != "")
                          ).select(py_strip(F.col("sku_selecionado")).alias("_u")).distinct()
    used_name = ops.filter(F.col("nome_produto").isNotNull() & (F.col("nome_produto") != "")
                           ).select(name_key(F.col("nome_produto")).alias("_n")).distinct()
    c = cands.join(used_sku, py_strip(cands["sku"].cast("string")) == used_sku["_u"], "left_anti")
    return c.join(used_name, name_key(c["nome_produto"]) == used_name["_n"], "left_anti")


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("_text", search_text("nome_produto", "categoria"))
