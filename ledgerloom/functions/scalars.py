"""Column expressions: every one stays inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- money, dates, text -------------------------------------------------

def money(col) -> Column:
    """Text or number to DECIMAL(18,2); blank or malformed input gives null."""
    return F.trim(_c(col).cast("string")).try_cast("decimal(18,2)")


def to_cents(col) -> Column:
    return (_c(col) * 100).cast("bigint")


def from_cents(col) -> Column:
    return (_c(col).cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)")


def as_date(col) -> Column:
    return F.try_to_date(F.trim(_c(col).cast("string")), "yyyy-MM-dd")


def blank_to(col, default) -> Column:
    text = _c(col).cast("string")
    return F.coalesce(F.when(F.trim(text) != "", text), F.lit(default))


def recon_amount(net, expected) -> Column:
    """The documented expected bank amount where one is given, else the net."""
    given = F.trim(_c(expected).cast("string"))
    return F.when(F.coalesce(given, F.lit("")) != "", money(expected)).otherwise(money(net))


def norm_text(col) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(_c(col), F.lit(""))), "[^A-Z0-9]", "")


def ref_tokens(col) -> Column:
    """Distinct words of a narration that can be a reference; underscores stay."""
    words = F.split(F.upper(F.coalesce(_c(col), F.lit(""))), "[^A-Z0-9_]+")
    return F.array_sort(F.array_distinct(F.array_remove(words, "")))


def ref_key(ref) -> Column:
    """The word by which an order ID is looked up: its longest, the last of several."""
    words = F.filter(F.split(F.upper(F.coalesce(_c(ref), F.lit(""))), "[^A-Z0-9_]+"), lambda w: w != "")
    return F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w"))))["w"]


def names_order(narration, ref) -> Column:
    """The whole order ID stands in the narration, between borders of words; both in upper case."""
    bounded = F.concat(F.lit(r"[^A-Z0-9_]\Q"), F.replace(_c(ref), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E[^A-Z0-9_]"))
    return F.coalesce(
        F.regexp_like(_c(ref), F.lit("[A-Z0-9_]")) & F.contains(_c(narration), _c(ref))
        & F.regexp_like(F.concat(F.lit(" "), _c(narration), F.lit(" ")), bounded), F.lit(False))


def event_hash(*cols) -> Column:
    parts = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def id_set(col) -> Column:
    """Identifiers joined by ``;`` or ``+`` as a sorted set."""
    pieces = F.split(F.translate(F.coalesce(_c(col), F.lit("")), "+", ";"), ";")
    return F.array_sort(F.array_distinct(F.array_remove(pieces, "")))


def as_bool(col) -> Column:
    return F.coalesce(F.lower(F.trim(_c(col).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def from_minor(col) -> Column:
    return from_cents(F.coalesce(_c(col), F.lit(0)))


def epoch_date(first, second) -> Column:
    chosen = F.coalesce(F.nullif(_c(first), F.lit(0)), _c(second))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(chosen / 86400).cast("int"))


def lookup(col, table: dict[str, str], default) -> Column:
    pairs = [part for item in table.items() for part in map(F.lit, item)]
    return F.coalesce(F.create_map(*pairs)[_c(col)], default)


def map_type(col) -> Column:
    kind = F.coalesce(_c(col), F.lit("payment"))
    return lookup(kind, texts.PROCESSOR_TYPES, kind)


def net_minor(credit, debit) -> Column:
    return F.coalesce(_c(credit), F.lit(0)) - F.coalesce(_c(debit), F.lit(0))


def fee_cents(gross) -> Column:
    return F.floor((_c(gross) * 2 + 50) / 100).cast("bigint")


def tax_cents(fee) -> Column:
    return F.floor((_c(fee) * 18 + 50) / 100).cast("bigint")


def pct(numerator, denominator, digits: int = 1) -> Column:
    """Percentage as DECIMAL, null when the denominator is zero."""
    ratio = _c(numerator).cast("decimal(20,0)") * 100 / F.nullif(_c(denominator).cast("decimal(20,0)"), F.lit(0))
    return F.round(ratio, digits).cast(f"decimal(18,{digits})")


def clip(col, size: int = 1000) -> Column:
    return F.substring(_c(col), 1, size)


def stamp(df, **values):
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


# ---- evidence -----------------------------------------------------------

def direction(cents) -> Column:
    return F.signum(_c(cents)).cast("int")


def day_gap(a, b) -> Column:
    return F.abs(F.datediff(_c(a), _c(b)))


def amount_gap(a, b) -> Column:
    return F.abs(_c(a) - _c(b))



def cost_cents(amount_diff, day_diff, cfg: MatchConfig = DEFAULT) -> Column:
    return _c(amount_diff) + _c(day_diff) * cfg.day_cost_cents


def confidence_pct(cost, cfg: MatchConfig = DEFAULT) -> Column:
    """Confidence in hundredths, never below the floor."""
    scale = cfg.cost_scale_cents
    cost = _c(cost)
    rounded = F.ceil((F.lit(scale - scale // 200) - cost) / (scale // 100)) + cost.isin(*cfg.half_up_costs).cast("int")
    return F.greatest(F.lit(cfg.floor_pct).cast("bigint"), rounded.cast("bigint"))


def is_fx(currency, cfg: MatchConfig = DEFAULT) -> Column:
    return blank_to(currency, cfg.home_currency) != cfg.home_currency


def fx_admissible(leg_currency, line_currency, has_expected) -> Column:
    """Two currencies may meet only where an expected bank amount is documented."""
    return _c(leg_currency).eqNullSafe(_c(line_currency)) | _c(has_expected)


def amount_bucket(cents, width: int) -> Column:
    return F.floor(F.abs(_c(cents)) / width).cast("bigint")


def day_bucket(day, width: int) -> Column:
    return F.floor(F.datediff(_c(day), F.lit("1970-01-01").cast("date")) / width).cast("bigint")


# ---- presentation rules -------------------------------------------------

def leg_label(kind) -> Column:
    return lookup(kind, texts.LEG_LABELS, _c(kind))


def pretty_type(kind) -> Column:
    return lookup(kind, texts.MATCH_DISPLAY, F.replace(_c(kind), F.lit("_"), F.lit(" ")))


def exception_category(reason) -> Column:
    text = F.lower(F.coalesce(_c(reason), F.lit("")))
    chain = None
    for words, name in texts.CATEGORY_RULES:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(texts.CATEGORY_OTHER)


def cents_text(cents) -> Column:
    """Cents as text with two decimals, without locale or grouping."""
    value = _c(cents)
    size = F.abs(value)
    whole = F.floor(size / 100).cast("bigint").cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def decision(confidence, cfg: MatchConfig = DEFAULT) -> Column:
    return F.when(_c(confidence) >= cfg.auto_accept_pct, texts.AUTO).otherwise(texts.REVIEW)
