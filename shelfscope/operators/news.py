"""News jobs: recency filter, URL / topic de-duplication, similar-topic test,
round robin by source, editorial text columns.

Topic coverage ("was this topic already published in the previous N days?")
is computed for every item against every earlier item, without emitting
item pairs:

* equal keys (URL hash, normalised topic, identical token set) are resolved
  per (key, day) bucket from partial aggregates (first / last time per
  bucket), so a key that holds a third of all rows costs one row per day;
* near-duplicate topics are found between *distinct* token sets with an index
  by (token, size class, time bucket): tokens are ordered rarest first and the
  least overlap that a similar pair needs, which depends on the smaller set's
  size, bounds the prefix in which the first shared token must lie.  No pair is
  lost, the most frequent tokens of a set (the hot blocking keys) are hardly
  ever indexed, posting lists that still are long are split, and a positional
  filter drops pairs that can't share enough behind the token; a pair is judged
  where it meets and folded into its sets' days at once, so pairs, which a
  group of near copies has in squares, are neither stored nor sent;
* the time window is checked bucket-to-bucket (day offsets 0..N), then joined
  back to the items on (key, day).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.session import materialize
from shelfscope.functions.text import (category_tag, col_, fold_accents, headline, py_strip,
                                       significant_tokens, strip_urls, wall_micros)


# ------------------------------------------------------------------ P28 / K1
def recent_window(items: DataFrame, now, hours: int = rules.NEWS_WINDOW_HOURS,
                  future_minutes: int = rules.NEWS_FUTURE_MINUTES, ts: str = "publicado_em") -> DataFrame:
    """Now-24h <= t <= now+15min; items without a date are dropped."""
    lo = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    hi = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(future_minutes))
    return items.filter(F.col(ts).isNotNull() & (F.col(ts) >= lo) & (F.col(ts) <= hi))


# ------------------------------------------------------------------------ W7
def round_robin(items: DataFrame, limit: int = rules.NEWS_CANDIDATES, ts: str = "publicado_em",
                ord_col: str = "doc_id") -> DataFrame:
    """W7 + W10: most recent first inside each source, sources in order of first
    appearance in the recency-sorted list, one per source per round; identity
    when there are at most ``limit`` items.  Adds short ids 1..n (W10).

    Per-source rank is cut at the literal ``limit`` (partial WindowGroupLimit):
    no source contributes more than ``limit`` rows to the final merge."""
    src = F.coalesce(F.col("fonte"), F.lit("Outros"))
    order = [F.col(ts).desc(), F.col(ord_col).asc()]
    w_src = Window.partitionBy(src).orderBy(*order)
    ranked = items.withColumn("_rn", F.row_number().over(w_src)).filter(F.col("_rn") <= limit)
    first_pos = ranked.filter(F.col("_rn") == 1).select(
        src.alias("_src"), F.col(ts).alias("_first_t"), F.col(ord_col).alias("_first_o"))
    j = ranked.join(first_pos, src == F.col("_src"))
    # at most ``limit`` items: the list is returned as it is (recency order);
    # otherwise round robin.  One scalar count switches the ordering in-plan.
    rr = items.select(F.count(F.lit(1))).scalar() > F.lit(limit)
    final = [F.when(rr, F.col("_rn")).otherwise(F.lit(0)),
             F.when(rr, F.col("_first_t")).desc(), F.when(rr, F.col("_first_o")),
             F.col(ts).desc(), F.col(ord_col)]
    picked = j.orderBy(*final).limit(limit)
    w = Window.orderBy(*final)  # at most ``limit`` rows
    return picked.withColumn("id_curto", F.row_number().over(w)).drop("_rn", "_src", "_first_t", "_first_o")


# ----------------------------------------------------------------- J4 / J5
#: Rows a posting list holds before it is split over several tasks.
POSTING_LIMIT = 5_000


def _least_overlap(m, n):
    """Least number of shared tokens that makes sets of ``m <= n`` tokens similar: shared >= 3 and shared/min >= 0.60,
    or Jaccard >= 0.55."""
    contained = F.greatest(F.lit(rules.TOPIC_MIN_SHARED), F.ceil(m * rules.TOPIC_CONTAINMENT - 1e-9))
    jaccard = F.ceil((m + n) * (rules.TOPIC_JACCARD / (1 + rules.TOPIC_JACCARD)) - 1e-9)
    return F.least(contained, jaccard).cast("int")


def _place_in_time(items: DataFrame, ts: str, ord_col: str | None) -> F.Column:
    """(ts, ord) as one ordered value: a decimal if ``ord_col`` is a whole number (hash aggregates hold it), else a struct."""
    t = wall_micros(items, ts)
    if ord_col is None:
        return t
    if dict(items.dtypes)[ord_col] not in ("bigint", "int", "smallint", "tinyint"):
        return F.struct(F.col(ts).alias("t"), F.col(ord_col).alias("o"))
    o = F.coalesce(F.col(ord_col).cast("decimal(20,0)"), F.lit(Decimal(-10**19)))     # no order sorts first
    return (t.cast("decimal(18,0)") * F.lit(Decimal(10**20)) + o).cast("decimal(38,0)")


def topic_postings(items: DataFrame, toks: str = "toks", days: int = rules.TOPIC_DEDUP_DAYS,
                   ts: str = "publicado_em", ord_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, probes, index) of the similarity join; ``sets`` has a row per token set and day with the first and last
    time of its items.

    Tokens of a set are numbered and ordered rarest first.  A set of m tokens needs at least ``o = _least_overlap(m, m)``
    shared ones with any set that is not smaller, so the first shared token is among its first ``m - o + 1``
    and among the first ``n - o + 1`` of the other.  ``probes`` has the former, once; ``index`` the latter, for
    every ``o`` (size class of the smaller set) up to the set's own.  Rows carry the token's place (positional
    filter), the set's tokens and times (so that a pair is judged where it meets), the ``days``-wide time bucket
    (probes: the neighbouring buckets too), and a part number that splits a token's posting list of a bucket
    with more than ``POSTING_LIMIT`` rows."""
    bucket = F.floor(F.unix_date("day") / F.lit(days)).cast("int")
    on_day = (items.filter((F.size(toks) > 1) & F.col(ts).isNotNull())
              .groupBy(F.array_join(toks, " ").alias("set_key"), F.to_date(ts).alias("day"))
              .agg(F.min(_place_in_time(items, ts, ord_col)).alias("first"), F.max(ts).alias("last")))
    on_day = materialize(on_day.withColumn("b", bucket))
    # a set's key holds its tokens
    freq = (on_day.select("b", F.explode(F.split("set_key", " ")).alias("tok")).groupBy("tok", "b").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("tok").agg(F.sum("n").alias("df"), F.map_from_entries(F.collect_list(F.when(
                F.col("n") > POSTING_LIMIT, F.struct("b", F.ceil(F.col("n") / F.lit(POSTING_LIMIT)).cast("int"))))).alias("parts")))
    freq = materialize(freq.withColumn("id", F.monotonically_increasing_id()))     # the numbers must not change
    tok_rows = on_day.select("set_key").distinct().select("set_key", F.explode(F.split("set_key", " ")).alias("tok"))
    ranked = (tok_rows.join(freq, "tok").groupBy("set_key")
              .agg(F.array_sort(F.collect_list(F.struct("df", "id", F.struct("parts").alias("p"))),
                                lambda x, y: F.when((x["df"] < y["df"]) | ((x["df"] == y["df"]) & (x["id"] < y["id"])), F.lit(-1))
                                .when(x["id"] == y["id"], F.lit(0)).otherwise(F.lit(1))).alias("r"))
              .select("set_key", F.monotonically_increasing_id().alias("set"), F.size("r").alias("n"),
                      F.transform("r", lambda x: x["id"]).alias("toks"), F.transform("r", lambda x: x["p"]["parts"]).alias("parts"))
              .withColumn("o", _least_overlap(F.col("n"), F.col("n"))))
    sets = materialize(on_day.join(ranked, "set_key"))
    classes = [r["o"] for r in sets.select("o").distinct().orderBy("o").collect()]   # as many as set sizes
    own = ["set", "n", "toks", "day", "first", "last"]

    def placed(df, o):
        prefix = F.slice(F.arrays_zip(F.col("toks").alias("tok"), "parts"), 1, F.col("n") - o + 1)
        return df.select(*own, "b", o.alias("o"), F.posexplode(prefix).alias("at", "p"))
    parts = F.coalesce(F.try_element_at("p.parts", F.col("b")), F.lit(1))
    probes = (placed(sets.withColumn("b", F.explode(F.array(F.col("b") - 1, "b", F.col("b") + 1))), F.col("o"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
              .select(*own, "o", "at", "b", "part", F.col("p.tok").alias("tok")))
    smaller = F.filter(F.array(*[F.lit(c) for c in classes]).cast("array<int>"), lambda c: c <= F.col("o"))
    index = (placed(sets.withColumn("c", F.explode(smaller)), F.col("c"))
             .select(*own, "o", "at", "b", F.pmod(F.xxhash64("set", "day"), parts).cast("int").alias("part"), F.col("p.tok").alias("tok")))
    return sets, probes, index


def topic_candidates(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (columns ``a``, ``b``: the smaller set on a day, the other one on a day) that share a token of both
    prefixes and still can share enough behind it."""
    m, n = F.col("a.n"), F.col("b.n")
    smaller = (m < n) | ((m == n) & (F.col("a.set") < F.col("b.set")))
    possible = F.least(m - F.col("at"), n - F.col("at_b")) >= _least_overlap(m, n)   # ``at`` counts from 0
    side = F.struct("set", "n", "toks", "day", "first", "last")
    where = ["tok", "o", "b", "part"]
    a = probes.select(*where, "at", side.alias("a")).withColumnRenamed("b", "bucket")
    b = index.select(*where, F.col("at").alias("at_b"), side.alias("b_")).withColumnRenamed("b", "bucket").withColumnRenamed("b_", "b")
    return a.join(b, ["tok", "o", "bucket", "part"]).filter(smaller & possible).select("a", "b")


def _on_days(hits: DataFrame, keys: list[str], days: int) -> DataFrame:
    """What a key's day needs to know of the days ``off`` before it that count: any strictly inside the window, the last
    time of the farthest day, the first of the day itself."""
    return hits.groupBy(*keys).agg(
        F.max(F.when((F.col("off") >= 1) & (F.col("off") <= days - 1), F.lit(True))).alias("mid"),
        F.max(F.when(F.col("off") == days, F.col("last"))).alias("m_far"),
        F.min(F.when(F.col("off") == 0, F.col("first"))).alias("m_same"))


def similar_days(items: DataFrame, toks: str = "toks", days: int = rules.TOPIC_DEDUP_DAYS,
                 ts: str = "publicado_em", ord_col: str = "doc_id") -> DataFrame:
    """``_on_days`` of every token set (``k``) and day over the similar sets (not itself) up to ``days`` before it.  Pairs
    are judged in the join and folded on its map side, both ways at once: no pair is stored or sent."""
    sets, probes, index = topic_postings(items, toks, days, ts, ord_col)
    shared = F.size(F.array_intersect("a.toks", "b.toks"))
    off = F.datediff("a.day", "b.day")
    both = F.inline(F.array(*[F.struct(F.col(f"{x}.set").alias("set"), F.col(f"{x}.day").alias("day"), d.alias("off"),
                                       F.col(f"{y}.first").alias("first"), F.col(f"{y}.last").alias("last"))
                              for x, y, d in (("a", "b", off), ("b", "a", -off))]))
    pairs = topic_candidates(probes, index).filter((F.abs(off) <= days) & (shared >= _least_overlap(F.col("a.n"), F.col("b.n"))))
    found = _on_days(pairs.select(both).filter(F.col("off") >= 0), ["set", "day"], days)
    return found.join(sets.select("set", "day", F.col("set_key").alias("k")), ["set", "day"]).drop("set")


def _covered_by(items: DataFrame, key: str, days: int, flag: str, others: DataFrame | None = None,
                ts: str = "publicado_em", ord_col: str = "doc_id", place: str = "_place") -> DataFrame:
    """Flag items with an earlier item (by ``place`` in time) in [ts - days, ts) that has the item's own key, or one
    that ``others`` (``_on_days`` rows of a key) stands for.  Bucket algebra, no item pairs."""
    d = items.filter(F.col(key).isNotNull() & (F.col(key) != "")).select(
        F.col(key).alias("k"), F.to_date(ts).alias("day"), F.col(ts).alias("t"), F.col(ord_col).alias("o"), F.col(place).alias("at"))
    buckets = d.groupBy("k", "day").agg(F.min("at").alias("first"), F.max("t").alias("last"))
    probe = buckets.select("k", "day").withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(days))))
    b2 = buckets.select(F.col("k").alias("bk"), F.col("day").alias("bday"), "first", "last")
    hits = probe.join(b2, (F.col("k") == F.col("bk")) & (F.col("bday") == F.date_sub(F.col("day"), F.col("off"))))
    agg = _on_days(hits, ["k", "day"], days)
    if others is not None:
        agg = agg.unionByName(others).groupBy("k", "day").agg(
            F.max("mid").alias("mid"), F.max("m_far").alias("m_far"), F.min("m_same").alias("m_same"))
    j = d.join(agg, ["k", "day"], "left")
    lim = F.col("t") - F.make_dt_interval(F.lit(days))
    cov = (F.coalesce(F.col("mid"), F.lit(False))
           | F.coalesce(F.col("m_far") >= lim, F.lit(False))
           | F.coalesce(F.col("m_same") < F.col("at"), F.lit(False)))
    return j.select(F.col("o").alias(ord_col), cov.alias(flag))


def topic_coverage(items: DataFrame, days: int = rules.TOPIC_DEDUP_DAYS, ord_col: str = "doc_id") -> DataFrame:
    """J4 + J5 over the whole item table, each item against earlier items.

    Input: ord_col, publicado_em, url_hash, tema_normalizado.  Output adds
    ``ja_publicada`` (same URL key or same non-blank topic, J4),
    ``tema_similar`` (similar topic, J5) and ``inedita``."""
    # the narrow item table feeds four branches (URL, topic, set, similar sets):
    # checkpoint it once so the topic extraction over whole texts runs once
    base = materialize(items.select(ord_col, "publicado_em", "url_hash", "tema_normalizado",
                                    _place_in_time(items, "publicado_em", ord_col).alias("_place"))
                       .withColumn("toks", significant_tokens("tema_normalizado"))
                       .withColumn("set_key", F.array_join("toks", " ")))
    by_url = _covered_by(base, "url_hash", days, "_u", ord_col=ord_col)
    by_topic = _covered_by(base, "tema_normalizado", days, "_t", ord_col=ord_col)
    by_set = _covered_by(base, "set_key", days, "_s", similar_days(base, days=days, ord_col=ord_col), ord_col=ord_col)
    out = (base.join(by_url, ord_col, "left").join(by_topic, ord_col, "left").join(by_set, ord_col, "left"))
    u, t, s = [F.coalesce(F.col(c), F.lit(False)) for c in ("_u", "_t", "_s")]
    return (out.withColumn("ja_publicada", u | t).withColumn("tema_similar", t | s)
            .withColumn("inedita", ~(u | t | s)).drop("_u", "_t", "_s", "toks", "set_key", "_place"))


# ------------------------------------------------------------------------ J9
def published_on_local_day(topics: DataFrame, local_day, ts: str = "publicado_em") -> DataFrame:
    """One row (flag) telling whether any topic was published on ``local_day``."""
    return topics.agg(F.coalesce(F.max(F.to_date(ts) == local_day), F.lit(False)).alias("publicado_hoje"))


# -------------------------------------------------------------- P30 - P42
def validated_highlight(highlight, head) -> F.Column:
    """The highlight is kept when one of its tokens (>= 2 chars) is a token
    of the headline, or it is a substring of it (case-insensitive); else ''."""
    d = py_strip(F.coalesce(col_(highlight), F.lit("")))
    h = F.coalesce(col_(head), F.lit(""))
    pat = F.lit(rules.HIGHLIGHT_TOKEN_PATTERN)
    toks_h = F.regexp_extract_all(F.lower(h), pat, 0)
    toks_d = F.filter(F.regexp_extract_all(F.lower(d), pat, 0), lambda t: F.length(t) >= 2)
    ok = ((F.size(toks_d) > 0) & F.arrays_overlap(toks_d, toks_h)) | F.contains(F.lower(h), F.lower(d))
    return F.when((d == "") | (h == ""), F.lit("")).when(ok, d).otherwise(F.lit(""))


def with_footer(text, source) -> F.Column:
    """URL-free text plus the source footer unless "fonte: x" or "via x"
    already appears; blank text stays blank."""
    base = strip_urls(py_strip(F.coalesce(col_(text), F.lit(""))))
    s = F.coalesce(col_(source), F.lit(""))
    low = F.lower(base)
    present = F.contains(low, F.concat(F.lit("fonte: "), F.lower(s))) | F.contains(
        low, F.concat(F.lit("via "), F.lower(s)))
    return (F.when(base == "", F.lit("")).when(present, base)
            .otherwise(F.concat(base, F.lit("\n\n" + rules.SOURCE_FOOTER_PREFIX), s)))


def local_time_fixed(ts) -> F.Column:
    """P39 fixed-offset variant: UTC minus 3 hours."""
    return col_(ts) - F.make_dt_interval(F.lit(0), F.lit(-rules.LOCAL_UTC_OFFSET_HOURS))


def local_time_zone(ts) -> F.Column:
    """P39 named-zone variant (daylight-saving aware)."""
    return F.from_utc_timestamp(col_(ts).cast("timestamp"), rules.LOCAL_ZONE)


def publication_window(local_ts, enabled=True, forced=False) -> F.Column:
    """(run?, reason) for the 14:00-16:59 local publication window."""
    hour = F.hour(col_(local_ts))
    if not enabled:
        return F.struct(F.lit(False).alias("executar"), F.lit("editorial_desabilitado_env").alias("motivo"))
    if forced:
        return F.struct(F.lit(True).alias("executar"), F.lit("flag_cli_run_editorial").alias("motivo"))
    inside = hour.between(14, 16)
    return F.struct(inside.alias("executar"),
                    F.when(inside, F.lit("janela_15h_brt"))
                    .otherwise(F.format_string("fora_janela_15h_brt (hora=%02dh)", hour)).alias("motivo"))


def mark_highlight(head, highlight) -> F.Column:
    """Words of the headline flagged when their accent-free word form is in
    the highlight token set: array<struct<palavra, destaque>>."""
    def norm(x):
        return F.regexp_replace(fold_accents(x), r"(?U)[^\w]", "")
    dest = F.filter(F.transform(F.split(F.coalesce(col_(highlight), F.lit("")), r"\s+"), norm), lambda x: x != "")
    words = F.filter(F.split(py_strip(F.coalesce(col_(head), F.lit(""))), r"\s+"), lambda x: x != "")
    return F.transform(words, lambda w: F.struct(w.alias("palavra"),
                                                 F.array_contains(dest, norm(w)).alias("destaque")))


def editorial_columns(df: DataFrame, text: str = "titulo", tag: str = "lang") -> DataFrame:
    """P30 / P32 on a news table: headline of 9 words, category tag."""
    return (df.withColumn("headline", headline(text))
            .withColumn("categoria_tag", category_tag(F.col(tag))))
