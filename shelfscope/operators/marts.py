"""The tables behind both dashboard tabs, kept up to date run by run.

Each mart holds a state that merges: sums, minima and maxima of structs, or the newest
rows.  A batch of new runs, posts and ledger entries is reduced to a partial state, merged
with the stored one (a few rows) and published as a whole (``sources/batches.py``), so
history is never read again and a batch that runs twice counts once.  What a dashboard
shows is computed from the states when it is asked for.

Inputs of a batch: ``execucoes`` (P37), ``categorias`` (A5 counts: run_date, categoria,
qtd), ``postagens`` (P38 and ``hora``), ``vendas`` (ledger).  Batches hold different rows;
which batch a row is in does not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.text import round_n
from shelfscope.operators.metrics import category_totals, last_runs, member_curve_bounds, sales_conversion, units
from shelfscope.sources.batches import BatchManifest

KEEP_RUNS, CURVE_RUNS = 500, 30
_CHANNELS = {"tg": "postados_telegram", "threads": "postados_threads", "fb": "postados_facebook", "x": "postados_x"}
_POINT = "struct<quando: date, valor: bigint>"


@dataclass(frozen=True)
class Mart:
    """``partial`` reduces a batch's ``source`` table to state rows; ``merge`` says how each state column of equal
    ``keys`` combines; ``newest`` keeps that many rows instead; a mart with neither only grows."""
    source: str
    schema: str
    partial: Callable[[DataFrame], DataFrame]
    keys: list[str] = field(default_factory=list)
    merge: dict[str, str] = field(default_factory=dict)
    newest: int | None = None

    def merged(self, state: DataFrame) -> DataFrame:
        if self.newest is not None:
            return state.orderBy(F.col("run_date").desc()).limit(self.newest)
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        return state.groupBy(*self.keys).agg(*[how[kind](c).alias(c) for c, kind in self.merge.items()])

    @property
    def grows(self) -> bool:
        return self.newest is None and not self.merge


def _run_sums(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("execucoes"),
                    *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in _CHANNELS.items()],
                    F.coalesce(F.sum(units(F.col("custo_x_usd"), 10000)), F.lit(0)).cast("bigint").alias("custo_x"))


def _point(value: str, where=None):
    """(day, value) where the value (or ``where``) is known."""
    known = F.col(value).isNotNull() if where is None else where
    return F.when(known, F.struct(F.col("run_date").alias("quando"), F.col(value).cast("bigint").alias("valor")))


def _audience(runs: DataFrame) -> DataFrame:
    members, followers = _point("membros_telegram"), _point("seguidores_facebook")
    reach = _point("alcance_fb_28d", F.col("seguidores_facebook").isNotNull())
    return runs.agg(F.min(members).alias("m_inicio"), F.max(members).alias("m_fim"), F.min(followers).alias("s_inicio"),
                    F.max(followers).alias("s_fim"), F.max(reach).alias("alcance"))


MARTS = {
    "categorias": Mart("categorias", "categoria string, total bigint", lambda c: c.groupBy("categoria").agg(
        F.sum("qtd").alias("total")), ["categoria"], {"total": "sum"}),
    "execucoes": Mart("execucoes", "execucoes bigint, tg bigint, threads bigint, fb bigint, x bigint, custo_x bigint",
                      _run_sums, [], dict.fromkeys(["execucoes", *_CHANNELS, "custo_x"], "sum")),
    "audiencia": Mart("execucoes", f"m_inicio {_POINT}, m_fim {_POINT}, s_inicio {_POINT}, s_fim {_POINT}, alcance {_POINT}",
                      _audience, [], {"m_inicio": "min", "m_fim": "max", "s_inicio": "min", "s_fim": "max", "alcance": "max"}),
    "ultimas": Mart("execucoes", "run_date date, status string, custo_x_usd double", lambda r: r.select(
        "run_date", "status", "custo_x_usd").orderBy(F.col("run_date").desc()).limit(KEEP_RUNS), newest=KEEP_RUNS),
    "curva": Mart("execucoes", "run_date date, membros_telegram bigint", lambda r: r.where("membros_telegram IS NOT NULL").select(
        "run_date", "membros_telegram").orderBy(F.col("run_date").desc()).limit(CURVE_RUNS), newest=CURVE_RUNS),
    "horas": Mart("postagens", "hora int, posts bigint, eng bigint", lambda p: p.groupBy("hora").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("score").alias("eng")), ["hora"], {"posts": "sum", "eng": "sum"}),
    "vendas": Mart("vendas", "cliques bigint, vendas bigint, centavos bigint", lambda v: v.agg(
        F.sum("clicks").cast("bigint").alias("cliques"), F.sum("sales").cast("bigint").alias("vendas"),
        F.sum(units(F.col("commission"), 100)).alias("centavos")), [], dict.fromkeys(["cliques", "vendas", "centavos"], "sum")),
    "plataformas": Mart("vendas", "platform string, centavos bigint, lancamentos bigint", lambda v: v.groupBy("platform").agg(
        F.sum(units(F.col("commission"), 100)).alias("centavos"), F.count(F.lit(1)).alias("lancamentos")),
        ["platform"], {"centavos": "sum", "lancamentos": "sum"}),
    "conversao": Mart("vendas", "id bigint, date date, platform string, conversao_pct double", sales_conversion),
}


class DashboardMarts:
    """The marts under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.manifest = BatchManifest(spark, path)

    def state(self, name: str) -> DataFrame:
        return self.manifest.read(name, MARTS[name].schema).drop("batch")

    def fold(self, inputs: dict[str, DataFrame], batch_id: int | None = None) -> bool:
        """Merge a batch into all marts; False if it was folded before."""
        batch_id = self.manifest.next_id() if batch_id is None else batch_id
        if self.manifest.is_published(batch_id):
            return False
        tables, replaced = {}, []
        for name, mart in MARTS.items():
            columns = self.state(name).columns
            part = mart.partial(inputs[mart.source]).select(*columns)
            if mart.grows:
                tables[name] = part
                continue
            replaced += self.manifest.folders(name)
            tables[name] = mart.merged(self.state(name).unionByName(part)).coalesce(1)
        return self.manifest.publish(batch_id, tables, replaces=tuple(replaced))

    # ------------------------------------------------------------- what the tabs show
    def category_totals(self) -> DataFrame:
        """A6"""
        return category_totals(self.state("categorias").withColumnRenamed("total", "qtd"))

    def run_kpis(self) -> DataFrame:
        """A7"""
        usd = F.col("custo_x").cast("double") / 10000.0
        return self.state("execucoes").select(
            F.col("execucoes").alias("total_runs"), *[F.col(c).alias(f"total_{c}") for c in _CHANNELS],
            (F.col("tg") + F.col("threads") + F.col("fb") + F.col("x")).alias("total_posts"),
            round_n(usd, 4).alias("total_x_usd"), round_n(usd * rules.USD_BRL, 2).alias("total_x_brl"))

    def audience(self) -> DataFrame:
        """A8"""
        s = self.state("audiencia").select(*[F.col(f"{c}.valor").alias(n) for c, n in (
            ("m_inicio", "membros_inicio"), ("m_fim", "membros_atual"), ("s_inicio", "seguidores_inicio"),
            ("s_fim", "seguidores_atual"), ("alcance", "alcance_atual"))])
        return s.withColumns({
            "delta_membros": F.coalesce(F.col("membros_atual") - F.col("membros_inicio"), F.lit(0)),
            "delta_seguidores": F.coalesce(F.col("seguidores_atual") - F.col("seguidores_inicio"), F.lit(0))})

    def recent_runs(self, n: int = 40) -> DataFrame:
        """W8"""
        return last_runs(self.state("ultimas"), n)

    def member_curve(self) -> DataFrame:
        """A17"""
        return member_curve_bounds(self.state("curva"), CURVE_RUNS)

    def engagement(self) -> DataFrame:
        """A9"""
        return self.state("horas").agg((F.sum("eng").cast("double") / F.sum("posts")).alias("media_engajamento"),
                                       F.sum("posts").alias("posts"))

    def hours(self, top: int = 5) -> DataFrame:
        """A10"""
        h = self.state("horas").withColumn("media", F.col("eng").cast("double") / F.greatest("posts", F.lit(1)))
        return h.orderBy(F.col("media").desc(), "hora").limit(top)

    def sales_kpis(self) -> DataFrame:
        """A11"""
        cost = self.run_kpis().select(F.coalesce(F.max("total_x_brl"), F.lit(0.0))).scalar()
        clicks, sales, comm = F.col("cliques"), F.col("vendas"), F.col("centavos").cast("double") / 100.0
        return self.state("vendas").select(
            clicks.alias("total_clicks"), sales.alias("total_sales"), comm.alias("total_commission"),
            F.when(clicks > 0, round_n(sales / clicks * 100.0, 2)).otherwise(F.lit(0.0)).alias("conversao_pct"),
            F.when(sales > 0, round_n(comm / sales, 2)).otherwise(F.lit(0.0)).alias("comissao_media"),
            round_n(comm - cost, 2).alias("lucro_liquido"))

    def commission_by_platform(self) -> DataFrame:
        """A13"""
        return self.state("plataformas").select("platform", (F.col("centavos").cast("double") / 100.0).alias("comissao"),
                                                "lancamentos")

    def conversion(self) -> DataFrame:
        """A12"""
        return self.state("conversao")

    def tables(self) -> dict[str, DataFrame]:
        return {"categorias": self.category_totals(), "kpis": self.run_kpis(), "audiencia": self.audience(),
                "ultimas": self.recent_runs(), "curva": self.member_curve(), "engajamento": self.engagement(),
                "horas": self.hours(), "vendas": self.sales_kpis(), "plataformas": self.commission_by_platform(),
                "conversao": self.conversion()}
