"""Offer Column expressions: store, commission, discount, profit, niche, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.text import any_substring, col_, py_strip, round_n


def store_from_sku(sku) -> Column:
    s = F.upper(py_strip(F.coalesce(col_(sku), F.lit(""))))
    return (F.when(s.startswith(rules.SKU_PREFIX_B), F.lit(rules.STORE_B))
            .when(s.startswith(rules.SKU_PREFIX_A), F.lit(rules.STORE_A))
            .otherwise(F.lit(rules.STORE_UNKNOWN)))


def search_text(*cols) -> Column:
    """lower('a b c') over nullable parts, the text every keyword rule scans."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(col_(c), F.lit("")) for c in cols]))


def commission_two_tier(category, name, seller, table=None, default=None,
                        first_party=None) -> Column:
    """Rate of the first keyword found in lower(category + ' ' + name); the 1P
    rate when the seller is the store itself, else the 3P rate."""
    table = table or rules.COMMISSION_TWO_TIER
    d1, d3 = default or rules.COMMISSION_TWO_TIER_DEFAULT
    fp = first_party or rules.FIRST_PARTY_SELLERS
    text = search_text(category, name)
    is_1p = col_(seller).isin(fp)
    r1, r3 = F.lit(d1), F.lit(d3)
    for kw, a, b in reversed(table):
        hit = F.contains(text, F.lit(kw))
        r1 = F.when(hit, F.lit(a)).otherwise(r1)
        r3 = F.when(hit, F.lit(b)).otherwise(r3)
    return round_n(F.when(is_1p, r1).otherwise(r3), 2)


def commission_one_tier(category, name, table=None, default=None) -> Column:
    table = table or rules.COMMISSION_ONE_TIER
    d = rules.COMMISSION_ONE_TIER_DEFAULT if default is None else default
    text = search_text(category, name)
    out = F.lit(float(d))
    for kw, r in reversed(table):
        out = F.when(F.contains(text, F.lit(kw)), F.lit(float(r))).otherwise(out)
    return out


def discount_pct(old, cur) -> Column:
    """round((old-cur)/old*100, 2) when old > cur > 0, else 0."""
    o, c = col_(old), col_(cur)
    return F.when((o > 0) & (c > 0) & (o > c), round_n((o - c) / o * 100.0, 2)).otherwise(F.lit(0.0))


def estimated_profit(price, rate) -> Column:
    """round(price * rate / 100, 2)."""
    return round_n(col_(price) * (col_(rate) / 100.0), 2)


def niche_bonus(*text_cols, category=None, off_terms=None, strong_terms=None,
                category_terms=None) -> Column:
    """-150 for off-niche terms, 180 for strong terms, 90 for a niche category, else 0."""
    text = search_text(*text_cols)
    cat = F.lower(F.coalesce(col_(category), F.lit(""))) if category is not None else F.lit("")
    off, strong, catb, none = rules.NICHE_SCORES
    return (F.when(any_substring(text, off_terms or rules.OFF_NICHE_TERMS), F.lit(off))
            .when(any_substring(text, strong_terms or rules.STRONG_NICHE_TERMS), F.lit(strong))
            .when(any_substring(cat, category_terms or rules.CATEGORY_NICHE_TERMS), F.lit(catb))
            .otherwise(F.lit(none)))


def niche_admitted(bonus, text, strict: bool, strong_terms=None) -> Column:
    """Reject negative bonus; when strict, require bonus > 0 or a strong-term hit."""
    b = col_(bonus)
    if not strict:
        return b >= 0
    return (b >= 0) & ((b > 0) | any_substring(text, strong_terms or rules.ADMISSION_STRONG_TERMS))


def quality_score(is_min, drop_pct, discount, profit, price, jitter=None) -> Column:
    """45*is_min + 1.5*min(drop,40) + 0.35*discount + 0.40*min(profit,80) + 25 in sweet spot + jitter."""
    p = F.coalesce(col_(price), F.lit(0.0))
    score = (F.when(F.coalesce(col_(is_min), F.lit(False)), F.lit(45.0)).otherwise(F.lit(0.0))
             + F.least(F.coalesce(col_(drop_pct), F.lit(0.0)), F.lit(40.0)) * 1.5
             + F.coalesce(col_(discount), F.lit(0.0)) * 0.35
             + F.least(F.coalesce(col_(profit), F.lit(0.0)), F.lit(80.0)) * 0.40
             + F.when(p.between(35.0, 500.0), F.lit(25.0)).otherwise(F.lit(0.0)))
    if jitter is not None:
        score = score + col_(jitter)
    return score


def hash_jitter(sku, run_id: str, scale: float = 8.0) -> Column:
    """Deterministic stand-in for uniform(0, scale): repeatable per (sku, run)."""
    return F.pmod(F.xxhash64(col_(sku), F.lit(run_id)), F.lit(8000)).cast("double") / 8000.0 * scale


def parse_price_text(c) -> Column:
    """Brazilian price text -> double: both separators -> dot is thousands; only a
    comma -> decimal; only dots with a 3-digit tail -> thousands; <= 0 or bad -> null."""
    s = F.regexp_replace(F.coalesce(col_(c), F.lit("")), r"[^\d,.]", "")
    has_dot, has_comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    last_part = F.element_at(F.split(s, r"\."), -1)
    norm = (F.when(has_dot & has_comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(has_comma, F.replace(s, F.lit(","), F.lit(".")))
            .when(has_dot & (F.length(last_part) == 3), F.replace(s, F.lit("."), F.lit("")))
            .otherwise(s))
    val = norm.try_cast("double")
    return F.when(val > 0, val)


def resolve_seller(seller_id, seller_desc, seller_str, seller_alt, url) -> Column:
    """seller.id, else seller.description, else seller text, else sellerId/seller_id,
    else the seller_id URL parameter, else the store itself; lower-cased."""
    def nz(c):
        c = col_(c)
        return F.when(py_strip(F.coalesce(c, F.lit(""))) != "", c)
    qs = F.regexp_extract(F.coalesce(col_(url), F.lit("")), r"[?&]seller_id=([^&#]*)", 1)
    return F.lower(F.coalesce(nz(seller_id), nz(seller_desc), nz(py_strip(F.coalesce(col_(seller_str), F.lit("")))),
                              nz(seller_alt), nz(qs), F.lit(rules.DEFAULT_SELLER)))


def upscale_image(c) -> Column:
    u = col_(c)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    for a, b in rules.IMAGE_SIZE_REPLACEMENTS:
        u = F.replace(u, F.lit(a), F.lit(b))
    return u
