"""Prices: text or number to minor units, effective price, differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelflens.functions import fixed_values as fv


def round_half_up(value: Column) -> Column:
    """floor(x + 0.5): halves go up for negative values too."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def currency_rate(currency: Column) -> Column:
    rates = F.create_map(*[F.lit(x) for pair in fv.CURRENCY_RATES.items() for x in pair])
    return F.coalesce(F.try_element_at(rates, F.coalesce(currency, F.lit("RUB"))), F.lit(1.0))


def _leading_number(text: Column) -> Column:
    """The number a text starts with, once everything but digits and separators is gone."""
    kept = F.regexp_replace(text, r"[^\d.,]", "")
    dotted = F.regexp_replace(kept, r"^([^,]*),", "$1.")
    number = F.regexp_extract(dotted, r"^(\d+\.?\d*|\.\d+)", 1)
    return F.when(number != "", F.rtrim(number, F.lit(".")).try_cast("double"))


def price_text_to_minor(text: Column, currency: Column | None = None) -> Column:
    """N1 for text: 0 when nothing can be read."""
    rate = currency_rate(currency) if currency is not None else F.lit(1.0)
    return F.coalesce(round_half_up(_leading_number(text) * rate * 100), F.lit(0).cast("bigint"))


def price_number_to_minor(value: Column, currency: Column | None = None) -> Column:
    """N1 for numbers: large numbers are minor units already."""
    rate = currency_rate(currency) if currency is not None else F.lit(1.0)
    number = value.cast("double")
    minor = F.when(number > fv.ONLINE_MINOR_LIMIT, round_half_up(number)).otherwise(round_half_up(number * rate * 100))
    return F.coalesce(minor, F.lit(0).cast("bigint"))


def price_currency(text: Column) -> Column:
    """Currency named in a price text, RUB when none is."""
    found = F.upper(F.regexp_extract(text, r"(?iu)(₽|RUB|USD|EUR|KZT|UAH)", 1))
    return F.when(found.isin("USD", "EUR", "KZT", "UAH"), found).otherwise(F.lit("RUB"))


def price_with_currency(text: Column) -> Column:
    """struct(price_minor, currency)."""
    currency = price_currency(text)
    return F.struct(price_text_to_minor(text, currency).alias("price_minor"), currency.alias("currency"))


def recognition_text_to_minor(text: Column) -> Column:
    """N1b for recognised text: first number with up to two decimals, null when absent."""
    compact = F.translate(F.regexp_replace(text, r"[\s ]+", ""), ",", ".")
    number = F.regexp_extract(compact, r"\d+(?:\.\d{1,2})?", 0)
    return F.when(number != "", round_half_up(number.try_cast("double") * 100))


def recognition_number_to_minor(value: Column) -> Column:
    number = value.cast("double")
    return round_half_up(F.when(number > fv.RECOGNITION_MINOR_LIMIT, number).otherwise(number * 100))


def import_price_to_minor(text: Column) -> Column:
    """Catalogue files: the whole text must be a number once spaces go and the first comma is a dot."""
    dotted = F.regexp_replace(F.regexp_replace(text, r"[\s ]", ""), r"^([^,]*),", "$1.")
    return F.when(dotted.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), round_half_up(dotted.try_cast("double") * 100))


def form_price_to_minor(text: Column) -> Column:
    """Typed-in prices: as in files, but negative values are refused."""
    minor = import_price_to_minor(text)
    return F.when(minor >= 0, minor)


def effective_price(price: Column, promo: Column) -> Column:
    return F.coalesce(promo, price)


def diff_minor(competitor: Column, own: Column) -> Column:
    return competitor - own


def diff_ratio(competitor: Column, own: Column) -> Column:
    """(competitor - own) / own, null when there is no positive own price."""
    return F.when(own > 0, (competitor - own).cast("double") / own.cast("double"))


def ai_cost_microusd(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of a model call; null for a model without a price."""
    prices = F.create_map(*[x for m, (i, o) in fv.MODEL_PRICES.items()
                            for x in (F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))])
    price = F.try_element_at(prices, model)
    usd = input_tokens / F.lit(1e6) * price["i"] + output_tokens / F.lit(1e6) * price["o"]
    return F.when(price.isNotNull(), F.greatest(F.lit(0).cast("bigint"), round_half_up(usd * 1e6)))
