"""Plan assertions: the registered queries keep the physical shape the design
relies on (no Python stages where Column code suffices, pruned scans, partial
top-N limits, no cartesian products)."""

import os

import pytest

import __spark_entry__ as E
from pyspark.sql import functions as F

from shelfscope.functions.text import significant_tokens
from shelfscope.operators import ingest as I
from shelfscope.operators import maintenance as Mt
from shelfscope.operators import news as N
from shelfscope.operators import responses as Rs
from shelfscope.plans import catalog, jobs, records

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
# queries whose only Python stage is the documented HTML card scan, the pull parser of feeds or the recovery of truncated JSON
PYTHON_ALLOWED = {"page_card_offers", "response_parse", "response_picks", "feed_xml_items"}


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_stage_outside_the_documented_ones(spark):
    # jobs and record queries end in a checkpoint, which hides what is before it: see the operators' plans below
    for name in set(catalog.build()) - set(jobs.QUERIES) - set(records.QUERIES) - PYTHON_ALLOWED:
        plan = _plan(spark, name)
        assert not any(n in plan for n in PYTHON_NODES), name


def test_radar_scan_is_pruned_and_combined_map_side(spark):
    plan = E.queries()["price_radar"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    hist = E.queries()["price_history_daily"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in hist.split("\n") if "ReadSchema" in line or "FileScan" in line]
    assert read and all("l_discount" not in line and "l_tax" not in line for line in read)
    assert "Partial" in hist or "partial_" in hist


def test_top_n_uses_partial_window_group_limit(spark):
    plan = _plan(spark, "channel_top")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_similarity_join_has_no_cartesian_product(spark):
    plan = _plan(spark, "topic_dedup")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _before_checkpoint(df, python=False):
    """Physical plan of an operator over plain rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert python or not any(n in plan for n in PYTHON_NODES)
    return plan


def _joins(plan):
    return sum(line.count("Join ") for line in plan.split("\n") if line.strip(" :+-*()0123456789").split(" ")[0].endswith("Join"))


def test_breaker_scan_splits_a_scope_into_blocks(spark):
    log = spark.createDataFrame([], "loja string, rota string, seq long, suspeita_waf boolean, inicio boolean, tentativa int")
    plan = _before_checkpoint(I.breaker_scan(log))
    windows = [line for line in plan.split("\n") if "Window [" in line]
    rows = [w for w in windows if "seq" in w.split("windowspecdefinition")[1]]
    assert rows and all("_block" in w.split("windowspecdefinition")[1].split("ASC")[0] for w in rows)


def test_editorial_candidates_meet_in_one_equi_join(spark):
    wanted = spark.createDataFrame([], "run_id int, nid long, url_esc string, tit_esc string")
    cands = spark.createDataFrame([], "run_id int, id_curto int, id string, fonte string, titulo string, url string, imagem_url string")
    plan = _before_checkpoint(Rs.matched_candidates(wanted, cands))
    assert _joins(plan) == 1 and "partial_min_by" in plan


def test_top_up_and_purge_lookup_join_by_key(spark):
    cands = spark.createDataFrame([], "run_id int, ord long, sku string, nome_produto string, loja string, categoria string, "
                                      "preco_atual double, preco_antigo double, percentual_desconto double, menor_preco_historico boolean, "
                                      "queda_real_percent double, score_qualidade double, bonus_nicho double, modelo string")
    needs = spark.createDataFrame([], "run_id int, falta_b int, falta_a int, falta int")
    _before_checkpoint(Rs.top_up_selection(cands, needs))
    checks = spark.createDataFrame([], "base string, conferido_em timestamp_ntz, baseline long, atuais long")
    purges = spark.createDataFrame([], "base string, limpo_em timestamp_ntz, removidos long")
    _before_checkpoint(Mt.guarded_checks(checks, purges))


def test_topic_candidates_grow_with_the_items(spark):
    """Index rows and candidates of twice the items (disjoint texts a day later) are about twice as many."""
    feed = catalog._feed(spark, SF).select("publicado_em", significant_tokens("tema_normalizado").alias("toks"))
    later = feed.select((F.col("publicado_em") + F.make_dt_interval(F.lit(1))).alias("publicado_em"),
                        F.transform("toks", lambda t: F.concat(t, F.lit("_"))).alias("toks"))

    def sizes(items):
        _, probes, index = N.topic_postings(items)
        pairs = N.topic_candidates(probes, index)
        _before_checkpoint(pairs)
        return probes.count(), index.count(), pairs.count()
    one, two = sizes(feed), sizes(feed.unionByName(later))
    assert all(b <= 2.2 * a + 10 for a, b in zip(one, two)) and one[2] > 0


def test_offers_union_parses_its_pages_once(spark):
    plan = E.queries()["offers_union"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES)     # the union is read twice, behind the checkpoint
