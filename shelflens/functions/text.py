"""Text normalisers: sizes, barcodes, titles, transliteration, match tokens and match features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelflens.functions import fixed_values as fv


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def has_text(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def first_text(*columns: Column) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def size_text_norm(text: Column) -> Column:
    """Spaces out, latin units to Cyrillic ones, each unit once and in this order."""
    units = [("gramm", "г"), (r"g\b", "г"), ("ml", "мл"), (r"l\b", "л"), ("kg", "кг"), ("pcs", "шт")]
    out = F.regexp_replace(text, r"[\s ]+", "")
    for latin, cyrillic in units:
        # A lazy prefix keeps the replacement to the first occurrence; (?-u) word ends are ASCII ones.
        ascii_end = latin.replace(r"\b", r"(?![A-Za-z0-9_])")
        out = F.regexp_replace(out, rf"(?is)^(.*?){ascii_end}", f"$1{cyrillic}")
    return F.when(text != "", out)


def barcode_norm(text: Column) -> Column:
    """Digits only, 8 to 13 of them."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits).between(8, 13), digits)


def template_barcode(text: Column) -> Column:
    """N4 for spreadsheets: a number cell may carry a trailing .0; '' and 0 mean no barcode."""
    code = F.regexp_replace(F.trim(text), r"\.0$", "")
    return F.when((code != "") & (code != "0"), code)


def translit_ru_lat(text: Column) -> Column:
    """Cyrillic to latin letter by letter."""
    single = {k: v for k, v in fv.RU_TO_LAT_ONE_WAY.items() if len(v) == 1}
    out = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    for letter, latin in fv.RU_TO_LAT_ONE_WAY.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def translit_fold(text: Column) -> Column:
    """One spelling for latin and Cyrillic forms of the same word."""
    single = {k: v for k, v in fv.LAT_TO_RU_FOLD.items() if len(k) == 1}
    back = {k: v for k, v in fv.RU_TO_LAT_FOLD.items() if len(v) == 1}
    out = F.replace(F.lower(text), F.lit("zh"), F.lit(fv.LAT_TO_RU_FOLD["zh"]))
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.replace(out, F.lit("ch"), F.lit(fv.LAT_TO_RU_FOLD["ch"]))
    out = F.translate(out, "".join(back), "".join(back.values()))
    for letter, latin in fv.RU_TO_LAT_FOLD.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def title_norm(text: Column) -> Column:
    """Letters, digits, spaces and hyphens of a product title."""
    kept = F.regexp_replace(F.lower(text), r"[^а-яёa-z0-9\s-]", " ")
    return F.coalesce(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit(""))


def text_norm(text: Column) -> Column:
    """N8 first half: lower case, ё as е, everything else a single space."""
    lowered = F.translate(F.lower(text), "ё", "е")
    return F.trim(F.regexp_replace(lowered, r"[^a-zа-я0-9]+", " "))


def stem(token: Column) -> Column:
    """One ending off a Cyrillic token of more than four letters."""
    return F.when(token.rlike(r"^[а-я]{5,}$"), F.regexp_replace(token, f"({fv.STEM_ENDINGS})$", "")).otherwise(token)


def tokenize(text: Column) -> Column:
    """Distinct match tokens in text order."""
    spellings = _literal_map({**fv.TOKEN_ALIASES, **fv.BRANDS})
    words = F.split(text_norm(text), " ")
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(spellings, w), stem(w)))
    kept = F.filter(mapped, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$") & ~w.isin(*fv.STOP_WORDS))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def size_canon(text: Column) -> Column:
    """The first amount with a unit, in grams, millilitres or pieces."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(кг|kg|г|гр|g|л|l|мл|ml|шт)"
    source = F.translate(F.lower(text), "ё", "е")
    unit = F.regexp_extract(source, pattern, 2)
    amount = F.translate(F.regexp_extract(source, pattern, 1), ",", ".").try_cast("double")
    thousand = unit.isin("кг", "kg", "л", "l")
    name = (F.when(unit.isin("кг", "kg", "г", "гр", "g"), "g")
            .when(unit.isin("л", "l", "мл", "ml"), "ml").otherwise("pc"))
    whole = F.floor(F.when(thousand, amount * 1000).otherwise(amount) + 0.5).cast("bigint").cast("string")
    return F.when(unit != "", F.concat(whole, name))


def match_text(*parts: Column) -> Column:
    """The non-empty texts of an item or product as one."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def brand_of(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t.isin(*dict.fromkeys(fv.BRANDS.values()))), F.lit(0))


def family_of(tokens: Column) -> Column:
    """First family in dictionary order that occurs."""
    return F.get(F.array_intersect(_literal_array(fv.FAMILIES), tokens), F.lit(0))


def base_family(brand: Column, family: Column) -> Column:
    return F.concat(brand, F.lit(":"), family)


def match_features(tokens: Column, size: Column) -> Column:
    """N11 over tokens: struct(tokens, brand, family, base_family, variants, packaging, size)."""
    brand, family = brand_of(tokens), family_of(tokens)
    return F.struct(
        tokens.alias("tokens"), brand.alias("brand"), family.alias("family"),
        base_family(brand, family).alias("base_family"),
        F.array_intersect(_literal_array(fv.VARIANT_WORDS), tokens).alias("variants"),
        F.array_intersect(_literal_array(fv.PACKAGING_WORDS), tokens).alias("packaging"),
        size.alias("size"),
    )


def match_key(raw_name: Column, brand: Column, size_text: Column, price_tag: Column, visible: Column, most_words: int | None = None) -> Column:
    """Key under which confirmed matches are remembered; '' when there is too little to go by.

    ``most_words`` keeps the first words only (10 gives keys as short as older tables have them).
    """
    tokens = tokenize(match_text(raw_name, brand, size_text, price_tag, visible))
    strong = F.array_sort(F.filter(tokens, lambda t: ~t.isin(*fv.WEAK_WORDS)))
    size = size_canon(F.coalesce(size_text, raw_name, price_tag, F.lit("")))
    words = F.array_join(strong if most_words is None else F.slice(strong, 1, most_words), " ")
    return F.when(F.size(strong) >= 2, F.concat_ws(" |", words, size)).otherwise(F.lit(""))


def product_text_norm(text: Column) -> Column:
    """Letters and digits only; null when nothing is left."""
    plain = F.regexp_replace(F.lower(text), "[\"'`´«»“”]", "")
    out = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    return F.when(out != "", out)


def split_store_label(label: Column) -> Column:
    """N16: 'name, address' at the first comma."""
    parts = F.split(F.trim(label), ",", 2)
    return F.struct(
        F.trim(F.get(parts, F.lit(0))).alias("name"),
        blank_to_null(F.get(parts, F.lit(1))).alias("address"),
    )


def store_key(name: Column, address: Column) -> Column:
    return F.concat(F.lower(F.trim(name)), F.lit("|"), F.coalesce(F.lower(F.trim(address)), F.lit("")))


def store_name_norm(name: Column) -> Column:
    """Letters and digits of a store name, as compared with retailer patterns."""
    return F.replace(F.regexp_replace(F.lower(name), r"[^а-яa-z0-9]", ""), F.lit("пятерочка"), F.lit("пятёрочка"))


def payload_fingerprint(source_product_id: Column, price_minor: Column, title: Column) -> Column:
    """Change fingerprint of an observation."""
    return F.sha2(F.concat_ws("-", source_product_id, price_minor.cast("string"), title), 256)
