"""Model-response cases: shapes, truncation, fallback, top-up, editorial picks."""

import json

from pyspark.sql import functions as F

from shelfscope.operators import responses as R
from shelfscope.operators import selection as S
from shelfscope.session import materialize

ITEM = {"sku_selecionado": "ML_MLB101", "nome_produto": "Controle Sem Fio", "loja": "Mercado Livre",
        "preco_atual": 199.9, "copy_venda": {"titulo": "Oferta", "corpo": "x", "cta": "y"}}


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid int, texto string")
    return {r["rid"]: r for r in R.parse_responses(df).collect()}


def test_shapes(spark):
    texts = [json.dumps({"oportunidades": [ITEM]}), "```json\n" + json.dumps({"oportunidades": [ITEM]}) + "\n```",
             json.dumps([ITEM]), json.dumps({"ofertas": [ITEM]}),
             "Aqui vai: " + json.dumps({"oportunidades": [ITEM]}) + " obrigado"]
    got = _parse(spark, texts)
    for i in range(len(texts)):
        assert got[i]["origem"] == "gemini", i
        assert [x["sku_selecionado"] for x in got[i]["itens"]] == ["ML_MLB101"], i
    assert got[0]["itens"][0]["copy_titulo"] == "Oferta"


def test_truncated_recovers_complete_objects(spark):
    items = [dict(ITEM, sku_selecionado=f"ML_{i}") for i in range(3)]
    full = json.dumps({"oportunidades": items})
    cut = full[: full.index('"ML_2"') + 3]
    got = _parse(spark, [cut])[0]
    assert got["origem"] == "gemini_parcial"
    assert [x["sku_selecionado"] for x in got["itens"]] == ["ML_0", "ML_1"]
    # large adversarial input must not overflow the regex engine
    big = "{" + '"a":"' + "x" * 200000 + '",' + json.dumps(ITEM)[1:-1]
    assert _parse(spark, [big])[0]["origem"] in ("gemini", "gemini_parcial", "sem_itens")


def test_recovery_at_any_depth(spark):
    deep = dict(ITEM, extra=json.loads('{"y":' * 40 + "1" + "}" * 40))
    cut = json.dumps({"wrapper": {"lista": [deep, ITEM]}})[:-30]
    got = _parse(spark, [cut, '{"wrapper": ' + json.dumps(ITEM) + "} e mais {", "{" * 300000, '{"a":"' * 3000])
    assert [[x["sku_selecionado"] for x in got[i]["itens"]] for i in range(4)] == [["ML_MLB101"], ["ML_MLB101"], [], []]


def test_unusable_texts(spark):
    got = _parse(spark, ["sem json aqui", json.dumps({"erro": "quota"}), json.dumps({"oportunidades": []}), ""])
    assert all(got[i]["origem"] == "sem_itens" for i in range(4))
    assert got[3]["motivo_parse"] == "resposta_vazia"


def _candidates(spark, n_b=18, n_a=6):
    rows = [(i, f"ML_{i}", f"produto b numero {i}", "Mercado Livre", 100.0 - i) for i in range(n_b)] + \
           [(100 + j, f"MAGALU_{j}", f"produto a numero {j}", "Magalu", 50.0 - j) for j in range(n_a)]
    df = spark.createDataFrame(rows, "ord long, sku string, nome_produto string, loja string, score_qualidade double")
    df = (df.withColumn("categoria", F.lit("Games")).withColumn("preco_atual", F.lit(100.0))
          .withColumn("preco_antigo", F.lit(120.0)).withColumn("percentual_desconto", F.lit(10.0))
          .withColumn("menor_preco_historico", F.lit(False)).withColumn("queda_real_percent", F.lit(0.0))
          .withColumn("lucro_estimado_reais", F.lit(5.0)))
    return materialize(S.add_niche_and_model(df))


def _resolve(spark, texts, cands):
    df = spark.createDataFrame(list(enumerate(texts)), "run_id int, texto string")
    parsed = materialize(R.parse_responses(df).select("run_id", "itens_raw", "origem"))
    out = materialize(R.resolve_runs(parsed, cands))
    rows = {}
    for r in out.orderBy("run_id", "pos").collect():
        rows.setdefault(r["run_id"], []).append(r)
    return rows, {r["run_id"]: r for r in R.run_provenance(parsed, out).collect()}


def _items(n, **more):
    return [dict(ITEM, sku_selecionado=f"ML_{i}", nome_produto=f"produto b numero {i}", **more) for i in range(n)]


def test_many_runs_at_once_equal_each_run_alone(spark):
    """Whole, short, cut and unusable responses, a run without candidates; every run as the single-run selection has it."""
    cut = json.dumps({"oportunidades": _items(3)})[:-40]
    texts = [json.dumps({"oportunidades": _items(20)}), json.dumps({"oportunidades": _items(8)}), cut, "texto sem json",
             "nada", json.dumps({"oportunidades": [dict(ITEM, sku_selecionado="MAGALU_0", nome_produto="outro", loja="Magalu")] * 6}),
             json.dumps({"oportunidades": _items(25)})]
    cands = _candidates(spark)
    many = materialize(cands.withColumn("run_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 5, 6))))))
    rows, prov = _resolve(spark, texts, many)
    assert {i: p["origem"] for i, p in prov.items()} == {
        0: "gemini", 1: "gemini_complementado", 2: "gemini_parcial", 3: "fallback_deterministico", 4: "vazio",
        5: "gemini_complementado", 6: "gemini"}
    assert {i: len(r) for i, r in rows.items()} == {0: 20, 1: 20, 2: 20, 3: 20, 5: 20, 6: 25} and 4 not in rows
    assert all([r["pos"] for r in rs] == list(range(1, len(rs) + 1)) for rs in rows.values())
    assert all(len({r["sku_selecionado"] for r in rows[i]}) == 20 for i in (1, 2, 3))
    assert (prov[1]["n_resposta"], prov[1]["n_b"], prov[1]["n_a"]) == (8, 15, 5)
    # the fallback of a run is the selection of the single-run plan
    alone = S.fallback_selection(cands).orderBy("pos").collect()
    assert [r["sku_selecionado"] for r in rows[3]] == [r["sku_selecionado"] for r in alone]
    # a topped-up run ends with the single-run selection over what is left, for what it lacks
    left = cands.where("NOT (sku LIKE 'ML\\_%' AND ord < 8)")
    extra = S.fallback_selection(left, 7, 5).where("pos <= 12").orderBy("pos").collect()
    assert [r["sku_selecionado"] for r in rows[1]][8:] == [r["sku_selecionado"] for r in extra]
    assert rows[1][8]["razao_selecao"].startswith("Seleção automática") and rows[1][0]["razao_selecao"] is None


def test_resolution_takes_no_action_on_the_driver(spark):
    """The whole of L5 is one lazy plan, the same columns whatever the responses hold."""
    df = materialize(R.parse_responses(spark.createDataFrame([(0, "x")], "run_id int, texto string")))
    cands = _candidates(spark).withColumn("run_id", F.lit(0))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    a = R.resolve_runs(df, cands)
    b = R.resolve_runs(df.limit(0), cands.limit(0))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert a.columns == b.columns and b.count() == 0 and a.count() == 20


def test_retry_flag_and_text_extraction(spark):
    payloads = [json.dumps({"candidates": [{"finish_reason": "MAX_TOKENS",
                                            "content": {"parts": [{"text": '{"a": ['}, {"text": "1"}]}}]}),
                json.dumps({"text": '{"ok": 1}'})]
    df = R.with_response_text(spark.createDataFrame([(p,) for p in payloads], "p string"), "p")
    rows = df.select("texto", "finish_reason", R.needs_retry("texto", "finish_reason").alias("retry")).collect()
    assert (rows[0]["texto"], rows[0]["finish_reason"], rows[0]["retry"]) == ('{"a": [1', "MAX_TOKENS", True)
    assert (rows[1]["texto"], rows[1]["finish_reason"], rows[1]["retry"]) == ('{"ok": 1}', "desconhecido", False)


def _edition(spark, answers, offers=None):
    rows = [(1, "101", "Adrenaline", "NVIDIA libera DLSS 4", "https://a.com/n/1/", None),
            (2, "102", "Tecnoblog", "SSD mais barato", "https://t.net/N/2", "https://i.com/2.jpg"),
            (3, "103", None, "SSD mais barato", "https://t.net/N/3", None)]
    cands = spark.createDataFrame([(run, *r) for run in range(len(answers)) if run != 99 for r in rows],
                                  "run_id int, id_curto int, id string, fonte string, titulo string, url string, imagem_url string")
    resp = spark.createDataFrame([(i, a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)],
                                 "run_id int, texto string")
    if offers is not None:
        offers = spark.createDataFrame([(run, i, *o) for run in range(len(answers)) for i, o in enumerate(offers)],
                                       "run_id int, ord int, sku string, url_afiliado string")
    return {r["run_id"]: r for r in R.editorial_picks(resp, cands, offers).collect()}


def test_editorial_picks_by_key(spark):
    t = {"texto_facebook": "x"}
    keys = [{"noticia_id": 102}, {"noticia_id": " 2 "}, {"noticia_id": "0102"}, {"url_escolhida": "https://t.net/N/2/"},
            {"url_escolhida": "HTTPS://T.NET/n/3"}, {"url_escolhida": "https://t.net/N/3#topo"}, {"titulo_original": " ssd MAIS barato "},
            {"noticia_id": 7, "url_escolhida": "https://a.com/n/1"}, {"noticia_id": True, "titulo_original": "nvidia libera dlss 4"},
            {"noticia_id": "2.0"}, {"url_escolhida": ""}]
    got = _edition(spark, [t | k for k in keys])
    assert [got[i]["noticia_id"] for i in range(len(keys))] == [102, 102, 102, 102, 103, 103, 102, 101, 101, None, None]
    assert {got[i]["motivo_rejeicao"] for i in (9, 10)} == {"noticia_nao_encontrada"}
    assert got[4]["fonte"] == "Redação Tech" and got[0]["imagem_url"] == "https://i.com/2.jpg"


def test_editorial_rejections(spark):
    got = _edition(spark, ["", "isto nao e json", "[]", "[1]", "7", "null", {"noticia_id": 1, "texto_facebook": " www.x.com "},
                           "```json\n[{\"noticia_id\": 1, \"texto_telegram\": \"y\"}]\n```", 'a [1] {"b": 2'])
    assert [got[i]["motivo_rejeicao"] for i in range(9)] == [
        "resposta_vazia", "json_invalido", "estrutura_lista_vazia_ou_invalida", "estrutura_lista_vazia_ou_invalida",
        "estrutura_nao_dict", "json_invalido", "sem_texto_editorial", None, "estrutura_lista_vazia_ou_invalida"]
    assert got[0]["fonte"] is None and got[7]["texto_facebook"] == got[7]["texto_telegram"] == "y\n\n📰 Fonte: Adrenaline"


def test_editorial_fields_and_offer_link(spark):
    base = {"noticia_id": 2, "headline_card": "SSD NVMe fica mais barato hoje em todas as lojas do país", "destaque_card": "barato",
            "texto_facebook": "Veja em https://x.com agora", "tag_categoria": " hardware de ponta e mais ", "roteiro_reel": "a\n b",
            "texto_x": None, "sku_oferta_relacionada": " S1 "}
    flags = [True, False, 1, "sim", [], None, True]
    got = _edition(spark, [base | {"tem_match_oferta": f} for f in flags[:6]] + [base | {"tem_match_oferta": True, "sku_oferta_relacionada": "S2"}],
                   offers=[("S1", " https://o/1 "), ("S1", "https://o/later"), ("S2", ""), ("S2", "https://o/2")])
    a = got[0]
    assert list(a.asDict()) == ["run_id", *R.EDITORIAL_FIELDS, "motivo_rejeicao"] and len(R.EDITORIAL_FIELDS) == 17
    assert (a["fonte"], a["url_escolhida"], a["titulo_original"]) == ("Tecnoblog", "https://t.net/N/2", "SSD mais barato")
    assert a["headline_card"] == "SSD NVMe fica mais barato hoje em todas as" and a["destaque_card"] == "barato"
    assert a["tag_categoria"] == "HARDWARE DE PONT" and a["roteiro_reel"] == "a b" and a["tema_normalizado"] == "ssd mais barato"
    assert a["texto_facebook"] == "Veja em agora\n\n📰 Fonte: Tecnoblog" == a["texto_threads"] == a["texto_telegram"]
    assert a["texto_x"] == "SSD NVMe fica mais barato hoje em todas as — Via Tecnoblog"
    link = [(got[i]["tem_match_oferta"], got[i]["sku_oferta_relacionada"], got[i]["url_oferta_comentario"]) for i in range(7)]
    yes, no = (True, "S1", "https://o/1"), (False, "", None)
    assert link == [yes, no, yes, yes, no, no, no]
    alone = _edition(spark, [base | {"tem_match_oferta": True}])[0]
    assert (alone["tem_match_oferta"], alone["sku_oferta_relacionada"]) == (False, "")
