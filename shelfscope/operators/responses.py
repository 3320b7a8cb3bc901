"""Model responses as data: text extraction (L1), fence removal and JSON
isolation (L2), shape normalisation (L3), partial recovery of truncated
output (L4), provenance and deterministic top-up (L5), editorial record
validation (L6, J6, J7) and the retry flag (L7).

Everything is Column code over a responses table (one row per response):
VARIANT parsing (``try_parse_json`` / ``try_variant_get``) for the shapes.
Only the texts this cannot use go to one Arrow stage, which finds the complete
objects of truncated text at any nesting depth.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from shelfscope.functions import rules
from shelfscope.functions.text import col_, headline, py_strip, strip_urls, topic_key, url_key
from shelfscope.operators import selection as S
from shelfscope.operators.json_recovery import complete_objects
from shelfscope.operators.news import validated_highlight, with_footer

API_SCHEMA = ("struct<candidates: array<struct<finish_reason: string, finishReason: string, "
              "content: struct<parts: array<struct<text: string>>>>>, text: string>")
PREFERRED_KEYS = ["oportunidades", "oportunidades_de_ouro", "ofertas", "produtos", "items", "selecao"]
MAX_TOKENS_REASONS = ["2", "MAX_TOKENS", "FinishReason.MAX_TOKENS"]


# ------------------------------------------------------------------------ L1
def with_response_text(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds (texto, finish_reason) from an API payload (JSON text): the joined
    parts of the first candidate, else the top-level text.  Staged so the
    payload is parsed once per row."""
    a = df.withColumn("_api", F.from_json(F.col(payload), API_SCHEMA))
    a = a.withColumn("_c0", F.try_element_at(F.col("_api").getField("candidates"), F.lit(1)))
    a = a.withColumn("_parts", F.filter(
        F.transform(F.col("_c0").getField("content").getField("parts"), lambda x: x.getField("text")),
        lambda t: t.isNotNull() & (t != "")))
    texto = F.when(F.coalesce(F.size("_parts"), F.lit(0)) > 0, F.array_join("_parts", "")).otherwise(
        F.coalesce(F.col("_api").getField("text"), F.lit("")))
    reason = F.coalesce(F.col("_c0").getField("finish_reason"), F.col("_c0").getField("finishReason"),
                        F.lit("desconhecido"))
    return a.withColumns({"texto": texto, "finish_reason": reason}).drop("_api", "_c0", "_parts")


# ------------------------------------------------------------------------ L7
def needs_retry(texto, reason) -> F.Column:
    t = py_strip(F.coalesce(col_(texto), F.lit("")))
    return (t == "") | (col_(reason).isin(MAX_TOKENS_REASONS) & ~t.endswith("}"))


# ------------------------------------------------------------------------ L2
def strip_fences(raw) -> F.Column:
    t = py_strip(F.coalesce(col_(raw), F.lit("")))
    unf = py_strip(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", ""))
    return F.when(t.startswith("```"), unf).otherwise(t)


def _between(t, open_ch: str, close_ch: str) -> F.Column:
    i, j = F.instr(t, open_ch), F.length(t) - F.instr(F.reverse(t), close_ch) + 1
    ok = (i > 0) & (F.instr(F.reverse(t), close_ch) > 0) & (j > i)
    return F.when(ok, F.substring(t, i, j - i + 1))


def parse_isolated(clean, prefer_array_first: bool = False) -> F.Column:
    """VARIANT of the whole text, else of the outer {..}, else of the outer [..]
    (editorial: the array when it starts before the object)."""
    obj, arr = _between(clean, "{", "}"), _between(clean, "[", "]")
    whole = F.try_parse_json(clean)
    if prefer_array_first:
        io, ia = F.instr(clean, "{"), F.instr(clean, "[")
        arr_first = arr.isNotNull() & ((io == 0) | (ia < io))
        return F.coalesce(whole, F.when(arr_first, F.try_parse_json(arr)).otherwise(F.try_parse_json(obj)))
    return F.coalesce(whole, F.try_parse_json(obj), F.try_parse_json(arr))


# ------------------------------------------------------------------------ L3
def _is_obj(v) -> F.Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _truthy_str(v, path: str) -> F.Column:
    s = F.try_variant_get(v, path, "string")
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))
    return s.isNotNull() & (s != "") & (is_text | ((s != "0") & (s != "false")))


def opportunity_list(v) -> F.Column:
    """array<variant>: the top-level array, else the first preferred key holding
    an array, else the first array value holding an object; only objects with
    a name, sku or URL are kept."""
    top = F.try_variant_get(v, "$", "array<variant>")
    # an empty preferred list does not end the search
    keyed = F.coalesce(*[F.when(F.size(a) > 0, a) for a in
                         (F.try_variant_get(v, f"$.{k}", "array<variant>") for k in PREFERRED_KEYS)])
    values = F.map_values(F.try_variant_get(v, "$", "map<string, variant>"))
    lists = F.filter(F.transform(values, lambda x: F.try_variant_get(x, "$", "array<variant>")),
                     lambda a: a.isNotNull() & F.exists(a, lambda e: _is_obj(e)))
    cands = F.coalesce(top, keyed, F.try_element_at(lists, F.lit(1)), F.array().cast("array<variant>"))
    return F.filter(cands, lambda e: _is_obj(e) & (_truthy_str(e, "$.nome_produto")
                                                   | _truthy_str(e, "$.sku_selecionado")
                                                   | _truthy_str(e, "$.url_afiliado")))


# ------------------------------------------------------------------------ L4
@F.pandas_udf(ArrayType(StringType()))
def _complete_objects(texts: pd.Series) -> pd.Series:
    return texts.map(complete_objects, na_action="ignore")


def recovered_objects(clean) -> F.Column:
    """array<variant> of the complete objects (with sku or name) found in a
    truncated text, in text order (null text: null).  Only texts that the full
    parse could not use are handed in."""
    parsed = F.transform(_complete_objects(clean), lambda s: F.try_parse_json(s))
    return F.filter(parsed, lambda e: e.isNotNull() & _is_obj(e)
                    & (_truthy_str(e, "$.sku_selecionado") | _truthy_str(e, "$.nome_produto")))


PICK_FIELDS = [("sku_selecionado", "string"), ("nome_produto", "string"), ("loja", "string"),
               ("categoria", "string"), ("preco_atual", "double"), ("preco_antigo", "double"),
               ("percentual_desconto", "double"), ("url_afiliado", "string"), ("imagem_url", "string"),
               ("razao_selecao", "string")]


def pick_struct(v) -> F.Column:
    fields = [F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in PICK_FIELDS]
    fields.append(F.try_variant_get(v, "$.copy_venda.titulo", "string").alias("copy_titulo"))
    return F.struct(*fields)


def parse_responses(df: DataFrame, raw: str = "texto") -> DataFrame:
    """L2-L4 per response: ``itens`` (array of pick structs) and ``origem``
    (gemini / gemini_parcial / sem_itens) plus the parse error marker.

    Staged columns: every parse runs once per row (Catalyst does not merge a
    projection that would duplicate a non-trivial expression), and the partial
    recovery regex only runs on texts the full parse could not use."""
    a = df.withColumn("_clean", strip_fences(F.col(raw)))
    a = a.withColumn("_v", parse_isolated(F.col("_clean")))
    a = a.withColumn("_full", F.when(F.col("_v").isNotNull(), opportunity_list(F.col("_v"))))
    a = a.withColumn("_has_full", F.coalesce(F.size("_full"), F.lit(0)) > 0)
    a = a.withColumn("_rest", F.when(~F.col("_has_full") & (F.col("_clean") != ""), F.col("_clean")))
    a = a.withColumn("_part", recovered_objects(F.col("_rest"))).drop("_rest")
    a = a.withColumn("_has_part", F.coalesce(F.size("_part"), F.lit(0)) > 0)
    items = F.when(F.col("_has_full"), F.col("_full")).when(F.col("_has_part"), F.col("_part")).otherwise(
        F.array().cast("array<variant>"))
    origem = (F.when(F.col("_has_full"), F.lit("gemini")).when(F.col("_has_part"), F.lit("gemini_parcial"))
              .otherwise(F.lit("sem_itens")))
    motivo = (F.when(F.col("_clean") == "", F.lit("resposta_vazia"))
              .when(F.col("_v").isNull(), F.lit("json_invalido"))
              .when(~F.col("_has_full"), F.lit("lista_oportunidades_vazia")))
    out = a.withColumns({"itens_raw": items, "origem": origem, "motivo_parse": motivo})
    out = out.withColumn("itens", F.transform("itens_raw", pick_struct))
    return out.drop("_clean", "_v", "_full", "_has_full", "_part", "_has_part")


def explode_picks(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pick (1-based ``pos``): the raw VARIANT elements are exploded
    first and their fields read per row."""
    e = parsed.select(*keys, "origem", F.posexplode("itens_raw").alias("pos0", "_e"))
    return e.select(*keys, "origem", (F.col("pos0") + 1).alias("pos"), pick_struct(F.col("_e")).alias("_p")
                    ).select(*keys, "origem", "pos", "_p.*")


# ------------------------------------------------------------------------ L5
TOP_UP_COLUMNS = ["sku_selecionado", "nome_produto", "loja", "categoria", "preco_atual", "preco_antigo",
                  "percentual_desconto", "url_afiliado", "imagem_url", "razao_selecao", "copy_titulo"]


def run_needs(parsed: DataFrame, run: str = "run_id", qtd_b: int = rules.TARGET_B, qtd_a: int = rules.TARGET_A
              ) -> DataFrame:
    """What each run's response is short of: ``run, origem, n, falta_b, falta_a, falta`` (0 for full responses).

    Stores are filled up to their targets; what still lacks goes to store B.  A run without picks
    needs the whole selection."""
    lojas = F.transform("itens_raw", lambda e: F.lower(F.coalesce(F.try_variant_get(e, "$.loja", "string"), F.lit(""))))
    total = F.lit(qtd_b + qtd_a)
    c = (parsed.select(F.col(run), "origem", F.size("itens_raw").alias("n"), lojas.alias("_lojas"))
         .withColumn("_b", F.size(F.filter("_lojas", lambda x: x.contains("mercado"))))
         .withColumn("_a", F.size(F.filter("_lojas", lambda x: x.contains("magalu")))))
    short = F.greatest(F.lit(0), total - F.col("n"))
    miss_a = F.greatest(F.lit(0), F.lit(qtd_a) - F.col("_a"))
    miss_b = F.greatest(F.greatest(F.lit(0), F.lit(qtd_b) - F.col("_b")), short - miss_a)
    some = (F.col("n") > 0) & (short > 0)
    return c.select(run, "origem", "n",
                    F.when(F.col("n") == 0, F.lit(qtd_b)).when(some, miss_b).otherwise(F.lit(0)).alias("falta_b"),
                    F.when(F.col("n") == 0, F.lit(qtd_a)).when(some, miss_a).otherwise(F.lit(0)).alias("falta_a"),
                    short.alias("falta"))


def top_up_selection(cands: DataFrame, needs: DataFrame, run: str = "run_id") -> DataFrame:
    """Q2 for all runs at once: the candidates of each run that fill its needs, with ``pos`` from 1.

    Per run: best models of each store up to its need, leftovers into the slots that are still open,
    3 of B : 1 of A, cut at the run's ``falta``.  Open slots are numbered rows joined to the numbered
    leftovers by (run, slot).  ``cands`` holds a run's capped candidate list (K3 / W4), so a window over a
    run is bounded."""
    lower = F.lower(F.coalesce(F.col("loja"), F.lit("")))
    store = F.when(lower.contains("mercado"), F.lit("B")).when(lower.contains("magalu"), F.lit("A")).otherwise(F.lit("X"))
    n = needs.where("falta > 0").select(F.col(run).alias("_run"), "falta_b", "falta_a", "falta")
    base = (cands.join(n, cands[run] == n["_run"]).drop("_run")
            .withColumn("_neg", -F.col("score_qualidade")).withColumn("_store", store))
    rank = [F.col("_neg"), F.col("ord")]
    adherent = F.col("bonus_nicho") >= 0
    w_model = Window.partitionBy(run, "_store", "modelo", adherent).orderBy(*rank)
    tiered = base.withColumn("_tier", F.when(~adherent, 2).when(
        (F.col("modelo") == "") | (F.row_number().over(w_model) == 1), 0).otherwise(1))
    w_store = Window.partitionBy(run, "_store").orderBy("_tier", *rank)
    need = F.when(F.col("_store") == "B", F.col("falta_b")).otherwise(F.col("falta_a"))
    # a store without need still gives its best row, as the selection it follows does
    tiered = tiered.withColumn("_pos", F.row_number().over(w_store)).withColumn(
        "_in", (F.col("_store") != "X") & (F.col("_pos") <= F.greatest(F.lit(1), need)))
    w_run = Window.partitionBy(run)
    tiered = (tiered.withColumn("_n_in", F.sum(F.col("_in").cast("int")).over(w_run))
              .withColumn("_models", F.collect_set(F.when(F.col("_in"), F.col("modelo"))).over(w_run))
              .withColumn("_skus", F.collect_set(F.when(F.col("_in"), F.col("sku"))).over(w_run)))
    picked = tiered.where("_in").withColumn("_src", F.lit(0))
    w_left = Window.partitionBy(run).orderBy(F.array_contains("_models", F.col("modelo")), *rank)
    left = (tiered.where(~F.col("_in") & ~F.array_contains("_skus", F.col("sku")))
            .withColumn("_slot", F.row_number().over(w_left)))
    open_ = F.greatest(F.lit(0), F.col("falta_b") + F.col("falta_a") - F.col("_n_in"))
    slots = (tiered.groupBy(F.col(run).alias("_run")).agg(F.max(open_).alias("_open")).where("_open > 0")
             .select("_run", F.explode(F.sequence(F.lit(1), F.col("_open"))).alias("_k")))
    extra = (left.join(slots, (F.col(run) == F.col("_run")) & (F.col("_slot") == F.col("_k")))
             .withColumn("_store", F.when(lower.contains("magalu"), F.lit("A")).otherwise(F.lit("B")))
             .withColumn("_pos", F.col("_k")).withColumn("_src", F.lit(1)).select(*picked.columns))
    w_line = Window.partitionBy(run, "_store").orderBy("_src", "_pos")
    seq = picked.unionByName(extra).withColumn("_i", F.row_number().over(w_line) - 1)
    block = F.when(F.col("_store") == "B", F.floor(F.col("_i") / 3)).otherwise(F.col("_i"))
    within = F.when(F.col("_store") == "B", F.col("_i") % 3).otherwise(F.lit(3))
    out = seq.withColumn("pos", F.row_number().over(Window.partitionBy(run).orderBy(block, within)))
    out = out.where((F.col("pos") <= F.col("falta")) & (F.col("pos") <= F.col("falta_b") + F.col("falta_a")))
    return S.copy_columns(out)


def resolve_runs(parsed: DataFrame, candidates: DataFrame, run: str = "run_id", qtd_b: int = rules.TARGET_B,
                 qtd_a: int = rules.TARGET_A) -> DataFrame:
    """L5 for all runs in one plan: ``run, pos, origem`` and the pick's columns.

    A run's picks come from its response (``parsed``: run, itens_raw, origem), topped up from the
    candidates whose sku and name it does not hold yet; a run without any pick gets the deterministic
    selection.  ``origem``: gemini / gemini_parcial as parsed, gemini_complementado when a whole response
    was topped up, fallback_deterministico.  Runs that end without a pick have no row here
    (see ``run_provenance``)."""
    needs = run_needs(parsed, run, qtd_b, qtd_a)
    picks = explode_picks(parsed, [run])
    used_sku = picks.select(F.col(run).alias("_run"), py_strip(F.coalesce("sku_selecionado", F.lit(""))).alias("_u")
                            ).where("_u <> ''").distinct()
    used_name = picks.where(F.coalesce("nome_produto", F.lit("")) != "").select(
        F.col(run).alias("_run"), S.name_key(F.col("nome_produto")).alias("_u")).distinct()
    free = candidates.join(used_sku, (candidates[run] == used_sku["_run"])
                           & (py_strip(candidates["sku"].cast("string")) == used_sku["_u"]), "left_anti")
    free = free.join(used_name, (free[run] == used_name["_run"])
                     & (S.name_key(free["nome_produto"]) == used_name["_u"]), "left_anti")
    chosen = top_up_selection(free, needs, run)
    label = (F.when(F.col("n") == 0, F.lit("fallback_deterministico"))
             .when((F.col("origem") == "gemini") & (F.col("_extras") > 0), F.lit("gemini_complementado"))
             .otherwise(F.col("origem")))
    extras = chosen.groupBy(F.col(run).alias("_run")).agg(F.count(F.lit(1)).alias("_extras"))
    labels = (needs.join(extras, F.col(run) == F.col("_run"), "left")
              .select(F.col(run).alias("_run"), "n", label.alias("origem_final")))
    out = (picks.select(run, "pos", *TOP_UP_COLUMNS)
           .unionByName(chosen.select(run, (-F.col("pos")).alias("pos"), *[
               F.lit(rules.TOP_UP_REASON).alias(c) if c == "razao_selecao" else
               F.col("sku").alias(c) if c == "sku_selecionado" else
               F.col(c) if c in chosen.columns else F.lit(None).cast("string").alias(c) for c in TOP_UP_COLUMNS])))
    # extras stand behind the response's own picks
    return (out.join(labels, F.col(run) == F.col("_run")).drop("_run")
            .select(run, F.when(F.col("pos") > 0, F.col("pos")).otherwise(F.col("n") - F.col("pos")).alias("pos"),
                    F.col("origem_final").alias("origem"), *TOP_UP_COLUMNS))


def run_provenance(parsed: DataFrame, resolved: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: its final label (``vazio`` without any pick) and its picks per store."""
    lower = F.lower(F.coalesce(F.col("loja"), F.lit("")))
    got = resolved.groupBy(F.col(run).alias("_run")).agg(
        F.first("origem").alias("_o"), F.count(F.lit(1)).alias("_n"), F.count_if(lower.contains("mercado")).alias("_b"),
        F.count_if(lower.contains("magalu")).alias("_a"))
    return (parsed.select(run, F.size("itens_raw").alias("n_resposta")).join(got, F.col(run) == F.col("_run"), "left")
            .select(run, "n_resposta", F.coalesce("_o", F.lit("vazio")).alias("origem"),
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(n)
                      for c, n in (("_n", "n_final"), ("_b", "n_b"), ("_a", "n_a"))]))


# ------------------------------------------------------------------ L6 / J6
def news_id(c) -> F.Column:
    """Integer id from an int or an all-digit string; anything else -> null."""
    s = py_strip(F.coalesce(col_(c).cast("string"), F.lit("")))
    return F.when(s.rlike(r"^\d+$"), s.try_cast("bigint"))


def _url_norm(c) -> F.Column:
    return F.lower(F.regexp_replace(py_strip(c), "/+$", ""))


def _entry(kind: str, key, prio: int) -> F.Column:
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(prio).alias("prio"))


def _keys(entries) -> F.Column:
    return F.explode(F.filter(F.array(*entries), lambda e: e["key"].isNotNull() & (e["key"] != "")))


def matched_candidates(wanted: DataFrame, candidates: DataFrame, run: str = "run_id") -> DataFrame:
    """Best candidate of each run, by id, else position, else URL (exact, normalised or hashed),
    else lower title; the first in candidate order of the best kind.

    Both sides become rows (run, kind, key), joined once by equality; the best is a map-side combined
    minimum.  ``wanted``: run, nid, url_esc, tit_esc.  ``candidates``: run, id_curto, id, fonte, titulo, url, imagem_url."""
    url = py_strip(F.coalesce("url", F.lit("")))
    c = candidates.select(
        F.col(run).alias("_run"), F.struct("id_curto", "id", "fonte", "titulo", "url", "imagem_url").alias("cand"),
        _keys([_entry("id", news_id(F.col("id")), 1), _entry("pos", F.col("id_curto"), 2), _entry("url", url, 3),
               _entry("url_norm", _url_norm(url), 3), _entry("url_hash", F.when(url != "", url_key(url)), 3),
               _entry("titulo", F.lower(py_strip(F.coalesce("titulo", F.lit("")))), 4)]).alias("e"))
    c = c.select("_run", "cand", F.col("e.kind").alias("_kind"), F.col("e.key").alias("_key"))
    esc = F.col("url_esc")
    w = wanted.select(
        run, _keys([_entry("id", F.col("nid"), 1), _entry("pos", F.col("nid"), 2), _entry("url", esc, 3),
                    _entry("url_norm", _url_norm(esc), 3), _entry("url_hash", F.when(esc != "", url_key(esc)), 3),
                    _entry("titulo", F.col("tit_esc"), 4)]).alias("e"))
    w = w.select(run, F.col("e.kind").alias("kind"), F.col("e.key").alias("key"), F.col("e.prio").alias("prio"))
    hits = w.join(c, (F.col(run) == F.col("_run")) & (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")))
    return hits.groupBy(F.col(run).alias("_run")).agg(
        F.min_by("cand", F.struct("prio", F.col("cand.id_curto"))).alias("m"))


def _truthy(v, path: str) -> F.Column:
    """Whether the value at ``path`` is there and neither empty, zero, false nor null."""
    s = F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return F.coalesce(F.when(kind == "STRING", s != "").when(kind == "BOOLEAN", s == "true")
                      .when(number, s.try_cast("double") != 0).when(kind == "VOID", F.lit(False))
                      .otherwise(~s.isin("[]", "{}")), F.lit(False))


def editorial_picks(responses: DataFrame, candidates: DataFrame, offers: DataFrame | None = None,
                    run: str = "run_id") -> DataFrame:
    """The news pick of each editorial response (one per ``run``), 17 fields, or why it was rejected.

    The chosen article is resolved by J6, texts lose their links and get the source footer (P29, P31), each
    channel's text stands in for the other, the headline is cut (P30), and the offer link is kept only if
    the run's ``offers`` (run, sku, url_afiliado) hold the sku (J7).  Rejected responses keep a row with
    ``motivo_rejeicao`` and no fields (quarantine)."""
    clean = strip_fences(F.col("texto"))
    p = responses.select(run, clean.alias("limpo"))
    p = p.withColumn("v", parse_isolated(F.col("limpo"), prefer_array_first=True))
    p = p.withColumn("arr", F.try_variant_get("v", "$", "array<variant>"))
    p = p.withColumn("d", F.when(_is_obj(F.col("v")), F.col("v"))
                     .when(F.size("arr") > 0, F.try_element_at("arr", F.lit(1))))
    p = p.withColumn("d", F.when(_is_obj(F.col("d")), F.col("d")))
    kind = F.schema_of_variant("v")

    def g(name):
        return F.try_variant_get("d", f"$.{name}", "string")

    def text(name):
        return py_strip(F.coalesce(g(name), F.lit("")))
    # bool is no id: only whole numbers and digit strings are
    nid = F.when(F.schema_of_variant(F.try_variant_get("d", "$.noticia_id", "variant")) != "BOOLEAN", news_id(g("noticia_id")))
    r = p.select(
        run, "limpo", F.col("d").isNotNull().alias("_has_d"), F.col("v").isNull().alias("_no_json"),
        F.col("arr").isNotNull().alias("_is_list"), kind.alias("_kind"), nid.alias("nid"),
        text("url_escolhida").alias("url_esc"), F.lower(text("titulo_original")).alias("tit_esc"),
        *[text(n).alias(f"_{n}") for n in ("fonte", "titulo_original", "tema_normalizado", "headline_card",
                                           "destaque_card", "tag_categoria", "roteiro_reel", "texto_facebook",
                                           "texto_telegram", "texto_x", "texto_threads", "sku_oferta_relacionada")],
        _truthy(F.col("d"), "$.tem_match_oferta").alias("_flag"))
    best = matched_candidates(r.where("_has_d").select(run, "nid", "url_esc", "tit_esc"), candidates, run)
    have = candidates.select(F.col(run).alias("_crun")).distinct()
    j = r.join(best, F.col(run) == F.col("_run"), "left").drop("_run")
    j = j.join(have, F.col(run) == F.col("_crun"), "left")

    def first_text(*cols):
        """First non-blank of them, trimmed."""
        return F.coalesce(*[F.nullif(py_strip(c), F.lit("")) for c in cols], F.lit(""))
    j = j.withColumns({
        "fonte": first_text(F.col("m.fonte"), F.col("_fonte"), F.lit(rules.DEFAULT_NEWS_SOURCE)),
        "titulo_original": first_text(F.col("m.titulo"), F.col("_titulo_original"))})
    j = j.withColumns({
        "headline_card": headline(first_text(F.col("_headline_card"), F.col("titulo_original"))),
        "_fb": with_footer(F.col("_texto_facebook"), F.col("fonte")),
        "_tg": with_footer(F.col("_texto_telegram"), F.col("fonte"))})
    j = j.withColumn("texto_facebook", F.when(F.col("_fb") != "", F.col("_fb")).otherwise(F.col("_tg")))
    tag = F.substring(F.upper(F.col("_tag_categoria")), 1, 16)
    j = j.withColumns({
        "noticia_id": F.coalesce(F.nullif(news_id(F.col("m.id")), F.lit(0)), F.col("nid")),
        "url_escolhida": py_strip(F.coalesce("m.url", F.lit(""))),
        "tema_normalizado": topic_key(first_text(F.col("_tema_normalizado"), F.col("titulo_original"))),
        "imagem_url": F.col("m.imagem_url"),
        "tag_categoria": F.when(tag != "", tag).otherwise(F.lit("TECH")),
        "destaque_card": validated_highlight(F.col("_destaque_card"), F.col("headline_card")),
        "roteiro_reel": py_strip(F.regexp_replace(F.col("_roteiro_reel"), r"\s+", " ")),
        "texto_x": strip_urls(F.when(F.col("_texto_x") != "", F.col("_texto_x")).otherwise(
            F.concat(F.col("headline_card"), F.lit(rules.HEADLINE_VIA), F.col("fonte"))), 260),
        "texto_threads": strip_urls(F.when(F.col("_texto_threads") != "", F.col("_texto_threads")).otherwise(
            F.col("texto_facebook")), 495),
        "texto_telegram": F.when(F.col("_tg") != "", F.col("_tg")).otherwise(F.col("texto_facebook")),
        "sku_oferta_relacionada": F.col("_sku_oferta_relacionada"), "tem_match_oferta": F.col("_flag")})
    j = link_offer(j, offers, run=run)
    motivo = (F.when(F.col("limpo") == "", F.lit("resposta_vazia"))
              .when(F.col("_crun").isNull(), F.lit("candidatos_vazios"))
              .when(F.col("_no_json") | (F.col("_kind") == "VOID"), F.lit("json_invalido"))
              .when(~F.col("_has_d") & F.col("_is_list"), F.lit("estrutura_lista_vazia_ou_invalida"))
              .when(~F.col("_has_d"), F.lit("estrutura_nao_dict"))
              .when(F.col("m").isNull(), F.lit("noticia_nao_encontrada"))
              .when(F.coalesce("texto_facebook", F.lit("")) == "", F.lit("sem_texto_editorial")))
    j = j.withColumn("motivo_rejeicao", motivo)
    ok = F.col("motivo_rejeicao").isNull()
    return j.select(run, *[F.when(ok, F.col(c)).alias(c) for c in EDITORIAL_FIELDS], "motivo_rejeicao")


EDITORIAL_FIELDS = ["noticia_id", "url_escolhida", "fonte", "titulo_original", "tema_normalizado", "imagem_url",
                    "tag_categoria", "headline_card", "destaque_card", "roteiro_reel", "tem_match_oferta",
                    "sku_oferta_relacionada", "url_oferta_comentario", "texto_x", "texto_threads", "texto_facebook",
                    "texto_telegram"]


# ------------------------------------------------------------------------ J7
def link_offer(picks: DataFrame, offers: DataFrame | None, run: str = "run_id", flag: str = "tem_match_oferta",
               sku: str = "sku_oferta_relacionada", url: str = "url_oferta_comentario") -> DataFrame:
    """Keep the offer link only when the flag is set and the run's offers hold the sku, with a URL;
    otherwise flag false, sku blank and no URL.  ``offers``: run, sku, url_afiliado and an order ``ord``;
    of equal skus the first one counts."""
    if offers is None:
        return picks.withColumns({flag: F.lit(False), sku: F.lit(""), url: F.lit(None).cast("string")})
    o = (offers.groupBy(F.col(run).alias("_orun"), py_strip(F.col("sku")).alias("_osku"))
         .agg(F.min_by(py_strip(F.coalesce("url_afiliado", F.lit(""))), "ord").alias("_ourl")))
    j = picks.join(o, (F.col(run) == F.col("_orun")) & (F.col(sku) == F.col("_osku")), "left")
    ok = F.coalesce(F.col(flag), F.lit(False)) & (F.col(sku) != "") & (F.coalesce("_ourl", F.lit("")) != "")
    return (j.withColumn("_ok", ok).withColumns({
        flag: F.col("_ok"), sku: F.when(F.col("_ok"), F.col(sku)).otherwise(F.lit("")),
        url: F.when(F.col("_ok"), F.col("_ourl"))}).drop("_ok", "_orun", "_osku", "_ourl"))
