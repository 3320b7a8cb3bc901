"""Run, engagement and sales metrics behind the dashboard tabs.

Money and cost totals are summed in integer units (cents, 1e-4 USD) so the
result does not depend on how Spark splits the sum across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.text import round_n, truncate_ellipsis


def units(c, scale: int):
    return F.floor(c * float(scale) + 0.5).cast("bigint")


# ------------------------------------------------------------------------ P37
def run_status(runs: DataFrame) -> DataFrame:
    """ALERTA_TG without messaging posts, PARCIAL when a store scraped 0, else OK;
    X cost = round(posts * 0.015, 4)."""
    return (runs.withColumn("status", F.when(F.col("postados_telegram") == 0, F.lit("ALERTA_TG"))
                            .when((F.col("raspados_ml") == 0) | (F.col("raspados_magalu") == 0), F.lit("PARCIAL"))
                            .otherwise(F.lit("OK")))
            .withColumn("custo_x_usd", round_n(F.col("postados_x") * rules.X_COST_PER_POST, 4)))


# ------------------------------------------------------------------- A5 / A6
def category_counts(df: DataFrame, run_col: str, cat_col: str) -> DataFrame:
    """A5: per run, offers per category (category, else store, else Geral; trimmed)."""
    cat = F.trim(F.coalesce(F.col(cat_col), F.lit("Geral")))
    return df.groupBy(run_col, cat.alias("categoria")).agg(F.count(F.lit(1)).alias("qtd"))


def category_totals(counts: DataFrame, top: int = 7) -> DataFrame:
    """Totals over runs, top 7, bar width = round(100 * count / max)."""
    tot = counts.groupBy("categoria").agg(F.sum("qtd").alias("total"))
    top_rows = tot.orderBy(F.col("total").desc(), F.col("categoria")).limit(top)
    mx = tot.select(F.max("total")).scalar()
    return top_rows.withColumn("pct", F.floor(F.col("total") / mx * 100.0 + 0.5).cast("bigint"))


# ------------------------------------------------------------------------ A7
def run_kpis(runs: DataFrame) -> DataFrame:
    s = {c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
         for c in ("postados_telegram", "postados_threads", "postados_facebook", "postados_x")}
    usd = F.coalesce(F.sum(units(F.col("custo_x_usd"), 10000)), F.lit(0)).cast("double") / 10000.0
    return runs.agg(F.count(F.lit(1)).alias("total_runs"),
                    s["postados_telegram"].alias("total_tg"), s["postados_threads"].alias("total_threads"),
                    s["postados_facebook"].alias("total_fb"), s["postados_x"].alias("total_x"),
                    (s["postados_telegram"] + s["postados_threads"] + s["postados_facebook"] + s["postados_x"])
                    .alias("total_posts"),
                    round_n(usd, 4).alias("total_x_usd"),
                    round_n(usd * rules.USD_BRL, 2).alias("total_x_brl"))


# ------------------------------------------------------------------------ A8
def audience_deltas(runs: DataFrame, order: str = "run_date") -> DataFrame:
    """First / last non-null members and followers, deltas, reach of the
    last run that has followers."""
    m, f = F.col("membros_telegram"), F.col("seguidores_facebook")
    first_m = F.min_by(m, F.when(m.isNotNull(), F.col(order)))
    last_m = F.max_by(m, F.when(m.isNotNull(), F.col(order)))
    first_f = F.min_by(f, F.when(f.isNotNull(), F.col(order)))
    last_f = F.max_by(f, F.when(f.isNotNull(), F.col(order)))
    reach = F.max_by(F.col("alcance_fb_28d"), F.when(f.isNotNull(), F.col(order)))
    out = runs.agg(first_m.alias("membros_inicio"), last_m.alias("membros_atual"),
                   first_f.alias("seguidores_inicio"), last_f.alias("seguidores_atual"),
                   reach.alias("alcance_atual"))
    return (out.withColumn("delta_membros", F.coalesce(F.col("membros_atual") - F.col("membros_inicio"), F.lit(0)))
            .withColumn("delta_seguidores",
                        F.coalesce(F.col("seguidores_atual") - F.col("seguidores_inicio"), F.lit(0))))


# ------------------------------------------------------------------ W8 / A17
def last_runs(runs: DataFrame, n: int, order: str = "run_date") -> DataFrame:
    """The n newest runs (keep 500 / show 40 / plot 30), newest first, with position."""
    top = runs.orderBy(F.col(order).desc()).limit(n)
    return top.withColumn("posicao", F.row_number().over(Window.orderBy(F.col(order).desc())))


def member_curve_bounds(runs: DataFrame, n: int = 30, order: str = "run_date") -> DataFrame:
    """Bounds of the member curve over the last n runs with members."""
    pts = runs.filter(F.col("membros_telegram").isNotNull()).orderBy(F.col(order).desc()).limit(n)
    return pts.agg(F.count(F.lit(1)).alias("pontos"),
                   F.greatest(F.lit(0), F.min("membros_telegram") - 2).alias("min_v"),
                   (F.max("membros_telegram") + 2).alias("max_v"))


# ------------------------------------------------------------- S6 / P38 / K4
def post_engagement(posts: DataFrame, cut_at: int = 78, keep: int = 75,
                    empty_msg: str = "(Post sem texto / Mídia)") -> DataFrame:
    """engagement = likes + 2*comments + 3*shares; message on one line, cut."""
    likes, comments, shares = [F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("likes", "comments", "shares")]
    msg = F.trim(F.replace(F.coalesce(F.col("message"), F.lit(empty_msg)), F.lit("\n"), F.lit(" ")))
    return (posts.withColumn("likes", likes).withColumn("comments", comments).withColumn("shares", shares)
            .withColumn("score", likes + comments * 2 + shares * 3)
            .withColumn("title", truncate_ellipsis(msg, cut_at, keep)))


def top_posts(posts: DataFrame, n: int = 10, order_cols=None) -> DataFrame:
    """K4: top n posts by engagement score (ties keep the feed order)."""
    order_cols = order_cols or [F.col("created_time").desc(), F.col("user_id")]
    return posts.orderBy(F.col("score").desc(), *order_cols).limit(n)


def engagement_by_hour(posts: DataFrame, hour_col, top: int = 5) -> DataFrame:
    """A10: posts and engagement per local hour; mean = sum / max(posts, 1); top 5 by mean."""
    g = posts.groupBy(hour_col.alias("hora")).agg(F.count(F.lit(1)).alias("posts"), F.sum("score").alias("eng"))
    g = g.withColumn("media", F.col("eng").cast("double") / F.greatest(F.col("posts"), F.lit(1)))
    return g.orderBy(F.col("media").desc(), F.col("hora")).limit(top)


# -------------------------------------------------------------- A11 - A13
def sales_kpis(ledger: DataFrame, x_cost_brl) -> DataFrame:
    clicks, sales = F.sum("clicks").cast("bigint"), F.sum("sales").cast("bigint")
    comm = F.sum(units(F.col("commission"), 100)).cast("double") / 100.0
    out = ledger.agg(clicks.alias("total_clicks"), sales.alias("total_sales"), comm.alias("total_commission"))
    return (out.withColumn("conversao_pct", F.when(F.col("total_clicks") > 0, round_n(
        F.col("total_sales") / F.col("total_clicks") * 100.0, 2)).otherwise(F.lit(0.0)))
        .withColumn("comissao_media", F.when(F.col("total_sales") > 0, round_n(
            F.col("total_commission") / F.col("total_sales"), 2)).otherwise(F.lit(0.0)))
        .withColumn("lucro_liquido", round_n(F.col("total_commission") - x_cost_brl, 2)))


def sales_conversion(ledger: DataFrame) -> DataFrame:
    """Sales / clicks in percent with one decimal, null without clicks."""
    return ledger.select("id", "date", "platform", F.when(F.col("clicks") > 0, round_n(
        F.col("sales") / F.col("clicks") * 100.0, 1)).alias("conversao_pct"))


def commission_by_platform(ledger: DataFrame) -> DataFrame:
    """Commission per platform (filtered sums)."""
    return ledger.groupBy("platform").agg(
        (F.sum(units(F.col("commission"), 100)).cast("double") / 100.0).alias("comissao"),
        F.count(F.lit(1)).alias("lancamentos"))
