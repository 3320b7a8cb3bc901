"""Stored pages -> offers: page JSON (S1), listing-card HTML (S2), block
diagnosis (P36), paging stop (W2) and breaker prefix (W3).

Pages are rows of a table (store, url, route, page, seq, status_code, body),
so one crawl of any size is one DataFrame.  Only the HTML card scan is
Python (a per-page stdlib parser inside ``mapInPandas``, Arrow batches);
every later step is native Column code.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.pricing import (commission_one_tier, commission_two_tier, discount_pct,
                                          estimated_profit, niche_bonus, niche_admitted, parse_price_text,
                                          resolve_seller, search_text, upscale_image)
from shelfscope.functions.text import any_substring, col_, first_substring, py_strip, round_n


# ------------------------------------------------------------------------ P36
def block_diagnosis(pages: DataFrame, body: str = "body", status: str = "status_code") -> DataFrame:
    """First bot-wall indicator in lower(body); suspicious if indicator or status
    in 403/406/429/503; page title (whitespace-collapsed, 80 chars); length."""
    b = F.coalesce(F.col(body), F.lit(""))
    title = F.regexp_extract(b, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.substring(py_strip(F.regexp_replace(title, r"\s+", " ")), 1, 80)
    ind = first_substring(F.lower(b), rules.BLOCK_INDICATORS)
    return pages.withColumns({
        "indicio": ind,
        "suspeita_waf": ind.isNotNull() | F.coalesce(F.col(status).isin(rules.BLOCK_STATUS_CODES), F.lit(False)),
        "title": title,
        "bytes": F.length(b),
    })


# ------------------------------------------------------------------------- W3
#: Fetches of a block of the breaker scan.
SCAN_BLOCK = 10_000


def breaker_scan(log: DataFrame, scope: tuple[str, ...] = ("loja", "rota"), order: str = "seq",
                 head: str = "inicio", block: int = SCAN_BLOCK) -> DataFrame:
    """Every fetch of a guarded scope (store and route) with ``execucao`` (``seq`` of the run's first fetch),
    ``cortada`` (a suspicious fetch of the same run and scope came before: it would not have been made) and
    ``gatilho`` (it is that first suspicious fetch).

    A run begins where ``head`` holds, and resets the breaker.  A retry is a row like any other, so it counts
    as a call and may be the trigger.  This is a segmented prefix scan in two levels: every block of ``order``
    values leaves the last head and the last suspicious fetch it holds, a running maximum over the (few) blocks
    of a scope carries them on, and inside a block a running maximum continues from the carry.  A scope
    with any share of the log is thus spread over its blocks.  Needs ``suspeita_waf`` (P36) and a unique ``order``."""
    blk = F.floor(F.col(order) / F.lit(block))
    rows = log.withColumn("_block", blk)
    last = {"_head": F.when(F.col(head), F.col(order)), "_bad": F.when(F.col("suspeita_waf"), F.col(order))}
    sums = rows.groupBy(*scope, "_block").agg(*[F.max(c).alias(n) for n, c in last.items()])
    before = Window.partitionBy(*scope).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*[F.col(c).alias(f"_c_{c}") for c in scope], F.col("_block").alias("_c_block"),
                        *[F.max(n).over(before).alias(f"_c{n}") for n in last])
    on = F.col("_block") == F.col("_c_block")
    for c in scope:
        on &= F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    rows = rows.join(carry, on)
    inside = Window.partitionBy(*scope, "_block").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.max(last["_head"]).over(upto), F.col("_c_head"))
    bad = F.greatest(F.max(last["_bad"]).over(ahead), F.col("_c_bad"))
    cut = F.coalesce(bad >= F.coalesce(start, bad), F.lit(False))
    rows = rows.withColumns({"execucao": start, "cortada": cut})
    return (rows.withColumn("gatilho", F.col("suspeita_waf") & ~F.col("cortada"))
            .drop("_block", "_c_block", "_c_head", "_c_bad", *[f"_c_{c}" for c in scope]))


def breaker_calls(scan: DataFrame, scope: tuple[str, ...] = ("loja", "rota")) -> DataFrame:
    """Per scope and run, the calls that were made (retries and the trigger included), whether the breaker
    tripped, and the articles kept."""
    return (scan.where(~F.col("cortada")).groupBy(*scope, "execucao")
            .agg(F.count(F.lit(1)).alias("chamadas"), F.max("gatilho").alias("breaker_ativado"),
                 F.count_if(~F.col("suspeita_waf")).alias("paginas_mantidas"),
                 F.count_if(F.coalesce(F.col("tentativa"), F.lit(1)) > 1).alias("repeticoes")))


def breaker_prefix(log: DataFrame, group_cols=("loja",), order: str = "seq") -> DataFrame:
    """W3 without routes or runs: per group, the fetches before the first suspicious one, with the group's
    calls (the trigger is one) and whether the breaker tripped."""
    scope = tuple(group_cols)
    scan = breaker_scan(log.withColumns({"_first": F.lit(False), "tentativa": F.lit(1)}), scope, order, head="_first")
    calls = breaker_calls(scan, scope).drop("execucao", "paginas_mantidas", "repeticoes")
    # a row a group: sent to every task if the groups are few, joined by key otherwise
    calls = F.broadcast(calls) if calls.limit(1001).count() <= 1000 else calls
    kept = scan.where(~F.col("cortada") & ~F.col("suspeita_waf")).drop("execucao", "cortada", "gatilho", "_first", "tentativa")
    return kept.join(calls, list(group_cols))


# ------------------------------------------------------------------------- W2
def page_prefix(items: DataFrame, route_cols=("route",), page: str = "page", sku: str = "sku",
                blocked: str | None = None) -> DataFrame:
    """Pages of a route are kept up to (excluding) the first page that is
    blocked, empty, or brings no sku unseen on earlier pages of the route.

    ``items`` has one row per (route, page, sku) listing; an empty page is a
    row with a null sku.  All steps are aggregates (first page per sku, stop
    page per route), no ordered scan."""
    r = list(route_cols)
    first_seen = (items.filter(F.col(sku).isNotNull()).groupBy(*r, sku).agg(F.min(page).alias("_first")))
    per_page = items.groupBy(*r, page).agg(
        F.count(sku).alias("n_itens"),
        *([F.max(F.col(blocked)).alias("_blocked")] if blocked else []))
    new_per_page = first_seen.groupBy(*r, F.col("_first").alias(page)).agg(F.count(F.lit(1)).alias("n_novos"))
    pages = per_page.join(new_per_page, [*r, page], "left").fillna(0, ["n_novos"])
    stop_cond = (F.col("n_itens") == 0) | (F.col("n_novos") == 0)
    if blocked:
        stop_cond = stop_cond | F.coalesce(F.col("_blocked"), F.lit(False))
    stops = pages.filter(stop_cond).groupBy(*r).agg(F.min(page).alias("_stop"))
    out = pages.join(stops, r, "left").filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
    return out.drop("_stop", *(["_blocked"] if blocked else []))


# ------------------------------------------------------------------------- S1
PAGE_JSON_SCHEMA = """struct<props: struct<pageProps: struct<data: struct<search: struct<
  products: array<struct<id: string, title: string, url: string,
    price: struct<price: string, fullPrice: string>,
    category: struct<name: string>,
    seller: string, sellerId: string, seller_id: string,
    image: string, images: array<string>>>,
  pagination: struct<pages: int>>>>>>"""


def page_json_offers(pages: DataFrame, body: str = "body", banned=None, base_url: str =
                     "https://www.magazinevoce.com.br", status: str = "status_code") -> DataFrame:
    """S1 (+ P1, P2, P4, P6-P10): the embedded __NEXT_DATA__ JSON of a listing
    page -> one offer row per product.  Note: ``price.price`` is the old price
    and ``price.fullPrice`` the current one.  Rows missing either are dropped;
    a malformed row is dropped alone, never the page."""
    if status in pages.columns:  # a page that was not served is no listing
        pages = pages.filter(F.col(status) == 200)
    js = F.regexp_extract(F.col(body), r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    parsed = F.from_json(js, PAGE_JSON_SCHEMA)
    search = parsed.getField("props").getField("pageProps").getField("data").getField("search")
    rows = pages.select("*", F.posexplode_outer(search.getField("products")).alias("idx", "p"),
                        F.coalesce(search.getField("pagination").getField("pages"), F.lit(1)).alias("total_paginas"))
    p = F.col("p")
    # ``seller`` and ``image`` come either as an object or as plain text: the
    # string-typed schema keeps objects as JSON text, read with get_json_object
    seller = p.getField("seller")
    is_obj = py_strip(F.coalesce(seller, F.lit(""))).startswith("{")
    name = F.coalesce(p.getField("title"), F.lit(""))
    old = p.getField("price").getField("price").try_cast("double")
    cur = p.getField("price").getField("fullPrice").try_cast("double")

    def img_of(c):
        obj = py_strip(F.coalesce(c, F.lit(""))).startswith("{")
        return F.when(obj, F.coalesce(F.get_json_object(c, "$.url"), F.get_json_object(c, "$.src"))).when(
            py_strip(F.coalesce(c, F.lit(""))) != "", py_strip(c))
    img = F.coalesce(img_of(p.getField("image")),
                     F.when(F.coalesce(p.getField("image"), F.lit("")) == "", img_of(F.try_element_at(p.getField("images"), F.lit(1)))))
    out = rows.filter(p.isNotNull()).select(
        *[c for c in pages.columns if c != body], "idx", "total_paginas",
        F.concat(F.lit(rules.SKU_PREFIX_A), F.coalesce(p.getField("id"), F.lit("None"))).alias("sku"),
        name.alias("nome_produto"),
        F.lit(rules.STORE_A).alias("loja"),
        cur.alias("preco_atual"), old.alias("preco_antigo"),
        F.coalesce(F.nullif(p.getField("category").getField("name"), F.lit("")), F.lit("Geral")).alias("categoria"),
        resolve_seller(F.when(is_obj, F.get_json_object(seller, "$.id")),
                       F.when(is_obj, F.get_json_object(seller, "$.description")),
                       F.when(~is_obj, seller), F.coalesce(p.getField("sellerId"), p.getField("seller_id")),
                       p.getField("url")).alias("seller_id"),
        upscale_image(img).alias("imagem_url"),
        F.when(p.getField("url").isNotNull(), F.concat(F.lit(base_url), p.getField("url"))).alias("url_afiliado"),
    )
    out = out.filter(F.col("preco_atual").isNotNull() & F.col("preco_antigo").isNotNull())
    out = out.filter(~any_substring(F.lower("nome_produto"), banned or rules.BANNED_TERMS_STORE_A))
    out = out.withColumn("percentual_desconto", discount_pct("preco_antigo", "preco_atual"))
    out = out.filter(F.col("percentual_desconto") <= rules.IMPLAUSIBLE_DISCOUNT_PCT)
    out = out.withColumn("comissao_percent", commission_two_tier("categoria", "nome_produto", "seller_id"))
    out = out.withColumn("lucro_estimado_reais", estimated_profit("preco_atual", "comissao_percent"))
    return out.filter((F.col("nome_produto") != "") & (F.col("preco_atual") != 0))


# ------------------------------------------------------------------------- S2
# Card container classes by priority, and the per-field element matchers
# (fixed values: the listing layout's class names).
CARD_KINDS = [("poly", {"div"}, r"poly-card"),
              ("promo", {"div", "li"}, r"promotion-item|ui-recommendations-card"),
              ("search", {"li"}, r"ui-search-layout__item")]
FIELDS = {
    "title": [("a", r"poly-component__title"),
              (None, r"poly-component__title|ui-search-item__title|promotion-item__title|"
                     r"ui-recommendations-card__title"),
              ("h2", None), ("a", r"ui-search-link")],
    "link": [("a", "@href")],
    "img": [("img", r"poly-component__picture|ui-search-result-image__element|promotion-item__img"), ("img", None)],
    "cur": [("div", r"poly-price__current"),
            (None, r"promotion-item__price|ui-recommendations-card__price|ui-search-price__second-line|"
                   r"price-tag-fraction")],
    "prev": [("s", r"poly-price__previous|andes-money-amount|promotion-item__oldprice"),
             (None, r"promotion-item__oldprice|ui-search-price__part--original")],
    "disc": [(None, r"discount|disc-label|promotion-item__discount")],
}
SUBFIELDS = {"frac": r"andes-money-amount__fraction|price-tag-fraction", "cents": r"andes-money-amount__cents"}
VOID = {"img", "br", "meta", "input", "link", "hr", "source", "wbr", "area", "base", "col", "embed", "param"}


def _cls_match(attrs: dict, pattern: str | None) -> bool:
    if pattern is None:
        return True
    if pattern == "@href":
        return bool(attrs.get("href"))
    return any(re.search(pattern, c, re.I) for c in (attrs.get("class") or "").split())


class _CardScanner(HTMLParser):
    """Collects, per card, the first element matching each field alternative."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards = {k: [] for k, _, _ in CARD_KINDS}
        self.stack = []  # (tag, [open capture records])
        self.open_cards = []  # (kind, depth, card)
        self.caps = []  # active text captures: [record, depth]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        for kind, tags, pat in CARD_KINDS:
            if tag in tags and _cls_match(a, pat) and not any(k == kind for k, _, _ in self.open_cards):
                card = {"_kind": kind}
                self.cards[kind].append(card)
                self.open_cards.append((kind, len(self.stack), card))
        for _, _, card in self.open_cards:
            for field, alts in FIELDS.items():
                for i, (t, pat) in enumerate(alts):
                    key = f"{field}{i}"
                    if key not in card and (t is None or t == tag) and _cls_match(a, pat):
                        rec = {"tag": tag, "attrs": a, "text": []}
                        card[key] = rec
                        if tag not in VOID:
                            self.caps.append([rec, len(self.stack)])
            cur = next((card.get(f"cur{i}") for i in range(2) if card.get(f"cur{i}") is not None
                        and card[f"cur{i}"] in [c[0] for c in self.caps]), None)
            if cur is not None:
                for sub, pat in SUBFIELDS.items():
                    if sub not in cur and _cls_match(a, pat):
                        rec = {"tag": tag, "attrs": a, "text": []}
                        cur[sub] = rec
                        if tag not in VOID:
                            self.caps.append([rec, len(self.stack)])
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in VOID or tag not in self.stack:
            return
        while self.stack:
            t = self.stack.pop()
            depth = len(self.stack)
            self.caps = [c for c in self.caps if c[1] < depth]
            self.open_cards = [c for c in self.open_cards if c[1] < depth]
            if t == tag:
                break

    def handle_data(self, data):
        for rec, _ in self.caps:
            rec["text"].append(data)


def _pick(card: dict, field: str):
    for i in range(len(FIELDS[field])):
        if f"{field}{i}" in card:
            return card[f"{field}{i}"]
    return None


def scan_cards(html: str) -> list[dict]:
    """Raw card fields of one page (highest-priority card layout only)."""
    sc = _CardScanner()
    try:
        sc.feed(html or "")
        sc.close()
    except Exception:  # noqa: BLE001 - a malformed page yields no cards
        return []
    cards = next((sc.cards[k] for k, _, _ in CARD_KINDS if sc.cards[k]), [])
    out = []
    for i, card in enumerate(cards):
        title = _pick(card, "title")
        if title is None:
            continue
        link = title if title["tag"] == "a" and title["attrs"].get("href") else _pick(card, "link")
        img = _pick(card, "img")
        cur = _pick(card, "cur")
        prev = _pick(card, "prev")
        disc = _pick(card, "disc")
        txt = (lambda r: "".join(r["text"]) if r else None)
        out.append({
            "idx": i,
            "nome": txt(title),
            "href": (link or {}).get("attrs", {}).get("href") if link else None,
            "img_cands": [img["attrs"].get(k) for k in ("data-src", "data-srcset", "srcset", "src")] if img else None,
            "cur_frac": txt(cur.get("frac")) if cur else None,
            "cur_cents": txt(cur.get("cents")) if cur else None,
            "cur_text": txt(cur),
            "prev_text": txt(prev),
            "disc_text": txt(disc),
        })
    return out


CARD_SCHEMA = ("page_key long, idx int, nome string, href string, img_cands array<string>, cur_frac string, "
               "cur_cents string, cur_text string, prev_text string, disc_text string")


def _scan_batches(batches):
    for pdf in batches:
        rows = []
        for key, body in zip(pdf["page_key"], pdf["body"]):
            for c in scan_cards(body):
                rows.append({"page_key": key, **c})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CARD_SCHEMA.split(", ")])


def pick_image(cands) -> F.Column:
    """First of data-src, data-srcset, srcset, src that is not a data: URI;
    first comma item, first token; '//' -> https; must start with http."""
    def norm(c):
        first = F.element_at(F.split(py_strip(F.element_at(F.split(c, ","), 1)), r"\s+"), 1)
        first = F.when(first.startswith("//"), F.concat(F.lit("https:"), first)).otherwise(first)
        return F.when(c.isNotNull() & (c != "") & ~py_strip(c).startswith("data:"), first)
    ok = F.filter(F.transform(col_(cands), norm), lambda u: u.isNotNull())
    return F.when(F.size(ok) > 0, F.try_element_at(ok, F.lit(1)))


def _once(c, f) -> F.Column:
    """``f`` of a column that is evaluated once a row, however often ``f`` names it: a lambda binds its value, where a
    plain expression would be copied into every place (and each step of a chain would multiply the copies)."""
    return F.transform(F.array(c), f).getItem(0)


def query_pairs(query) -> F.Column:
    """Decoded (key, value) pairs of a query string in order; a key without ``=`` has a blank value, as
    ``parse_qs`` reads it with blanks kept."""
    parts = F.filter(F.split(F.coalesce(col_(query), F.lit("")), "&"), lambda x: x != "")

    def decoded(c):
        return F.coalesce(F.try_url_decode(c), c)
    return F.transform(parts, lambda x: F.struct(
        decoded(F.split(x, "=", 2).getItem(0)).alias("k"),
        decoded(F.coalesce(F.get(F.split(x, "=", 2), 1), F.lit(""))).alias("v")))


def grouped_pairs(pairs) -> F.Column:
    """(key, values) in the order in which keys first appear, as a mapping of lists keeps them."""
    def grouped(ps):
        keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.transform(
            F.filter(ps, lambda p: p["k"] == k), lambda p: p["v"]).alias("vs")))
    return _once(pairs, grouped)


def upserted(groups, key: str, value, only_if: str = "always") -> F.Column:
    """Set a key: in its place if it is there, else at the end.  ``only_if``: ``blank`` (absent, or its first
    value is blank), ``absent`` or ``always``."""
    new = F.array(col_(value) if not isinstance(value, str) else F.lit(value))

    def replaced(g):
        hit = g["k"] == F.lit(key)
        if only_if == "blank":
            hit &= F.coalesce(g["vs"][0], F.lit("")) == ""
        return F.struct(g["k"].alias("k"), F.when(hit, new).otherwise(g["vs"]).alias("vs"))

    def put(gs):
        kept = gs if only_if == "absent" else F.transform(gs, replaced)
        added = F.concat(gs, F.array(F.struct(F.lit(key).alias("k"), new.alias("vs"))))
        return F.when(F.exists(gs, lambda g: g["k"] == F.lit(key)), kept).otherwise(added)
    return _once(groups, put)


def _quoted(c) -> F.Column:
    """Form encoding with the unreserved characters of ``quote_plus`` (``~`` stays, ``*`` does not)."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_text(groups) -> F.Column:
    return F.array_join(F.flatten(F.transform(groups, lambda g: F.transform(
        g["vs"], lambda v: F.concat(_quoted(g["k"]), F.lit("="), _quoted(v))))), "&")


def affiliate_url(url, params=None, host: str = rules.AFFILIATE_HOST) -> F.Column:
    """Trim, drop the fragment, resolve '//' and '/' prefixes, reject non-http, then set each tracking
    parameter that is absent or blank (in its place or at the end) and forceInApp if absent; the query is
    parsed in order and encoded anew, so blanks and bare keys come out well formed."""
    def resolved(u):
        return (F.when(u.startswith("//"), F.concat(F.lit("https:"), u))
                .when(u.startswith("/"), F.concat(F.lit(host), u)).otherwise(u))

    def tracked(u):
        parts = F.split(u, r"\?", 2)
        groups = grouped_pairs(query_pairs(F.get(parts, 1)))
        for k, v in params or rules.AFFILIATE_PARAMS:
            groups = upserted(groups, k, v, only_if="blank")
        groups = upserted(groups, "forceInApp", "true", only_if="absent")
        ok = u.startswith("http://") | u.startswith("https://")
        return F.when(ok, F.concat(parts.getItem(0), F.lit("?"), query_text(groups)))
    whole = F.split(py_strip(F.coalesce(col_(url), F.lit(""))), "#", 2).getItem(0)
    return _once(_once(whole, resolved), tracked)


def paged_url(url, page) -> F.Column:
    """The URL with ``page`` set (in its place or at the end), other parameters kept; page 1 leaves it as it is."""
    u, n = col_(url), col_(page).cast("int")
    frag = F.get(F.split(u, "#", 2), 1)
    head = F.split(u, "#", 2).getItem(0)
    groups = upserted(grouped_pairs(query_pairs(F.get(F.split(head, r"\?", 2), 1))), "page", n.cast("string"))
    out = F.concat(F.split(head, r"\?", 2).getItem(0), F.lit("?"), query_text(groups))
    return F.when(n <= 1, u).otherwise(F.concat(out, F.coalesce(F.concat(F.lit("#"), F.nullif(frag, F.lit(""))), F.lit(""))))


def html_card_offers(pages: DataFrame, category: str = "Geral", strict: bool = False,
                     banned=("cabo", "pelicula", "película", "capinha", "adaptador", "suporte simples", "conector")
                     ) -> DataFrame:
    """S2 (+ P3, P5-P8, P10-P13, P15): listing-card HTML -> offers of store B.

    ``pages`` needs a unique ``page_key`` and ``body``.  The Python stage only
    returns raw strings; prices, URLs, SKU and filters are Column code."""
    raw = pages.select("page_key", "body").mapInPandas(_scan_batches, CARD_SCHEMA)
    name = py_strip(F.regexp_replace(F.coalesce("nome", F.lit("")), r"\s+", " "))
    frac_txt = F.when(F.col("cur_frac").isNotNull(), F.when(
        F.col("cur_cents").isNotNull() & ~F.col("cur_frac").contains(","),
        F.concat(py_strip(F.col("cur_frac")), F.lit(","), py_strip(F.col("cur_cents"))))
        .otherwise(py_strip(F.col("cur_frac")))).otherwise(F.col("cur_text"))
    cur = parse_price_text(frac_txt)
    prev = parse_price_text(F.col("prev_text"))
    old = F.when(prev.isNotNull() & (prev > cur), prev).otherwise(cur)
    badge = F.regexp_extract(F.coalesce("disc_text", F.lit("")), r"(\d+)\s*%", 1)
    badge_v = F.when(badge != "", badge.cast("double")).otherwise(F.lit(0.0))
    # SKU from the listing id in the URL, else index + a stable hash of the name
    mlb = F.upper(F.regexp_extract(F.coalesce("href", F.lit("")), r"(?i)(MLB-?\d+)", 1))
    sku = F.when(mlb != "", F.concat(F.lit(rules.SKU_PREFIX_B), mlb)).otherwise(
        F.concat(F.lit(rules.SKU_PREFIX_B), F.col("idx").cast("string"), F.lit("_"),
                 F.pmod(F.xxhash64(name), F.lit(1000000)).cast("string")))
    out = raw.select(
        "page_key", "idx", sku.alias("sku"), name.alias("nome_produto"), F.lit(rules.STORE_B).alias("loja"),
        cur.alias("preco_atual"), old.alias("preco_antigo"),
        F.when((badge_v == 0) & (old > cur), round_n((old - cur) / old * 100.0, 2)).otherwise(badge_v)
        .alias("percentual_desconto"),
        F.lit(category).alias("categoria"), F.lit("Mercado Livre Full").alias("seller_id"),
        pick_image(F.col("img_cands")).alias("imagem_url"),
        affiliate_url(F.col("href")).alias("url_afiliado"))
    out = out.filter((F.col("nome_produto") != "") & ~any_substring(F.lower("nome_produto"), list(banned))
                     & F.col("url_afiliado").isNotNull() & F.col("preco_atual").isNotNull())
    out = out.withColumn("comissao_percent", commission_one_tier("categoria", "nome_produto"))
    out = out.withColumn("lucro_estimado_reais", estimated_profit("preco_atual", "comissao_percent"))
    bonus = niche_bonus("nome_produto", "categoria", category="categoria")
    return out.filter(niche_admitted(bonus, search_text("nome_produto", "categoria"), strict))
