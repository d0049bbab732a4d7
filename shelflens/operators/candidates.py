"""Fuzzy catalogue candidates for item texts (J3, W4, T1), exact and without a cross join: a threshold algorithm in two rounds.

Scores depend on a text only through its tokens and size, so both sides are first reduced to distinct *signatures*
(tokens + size). A pair of signatures can score only if something links them: a shared token, a product token that
contains or is contained in an item token, a transliteration-equal token, or the same size. Links between tokens are
found once, between the two vocabularies, by equality joins. Signatures meet on these *link keys*.

What a key can add to a score is bounded per item, and a score is at most the sum of the bounds of the keys that item and product
share. So sums of bounds, added up posting by posting, tell which pairs are worth scoring:

1. Seeds: the products with the greatest sums, in some of the product ranges, are scored. The k-th best of these scores is the
   item's *floor*: its k-th best product cannot be below.
2. Every pair whose sum reaches the floor is scored, and only these. The floor is raised once more by likely products of the range, and
   the longest postings that cannot reach it together are only looked up, not walked.

The sums of a block of items over a range of products are added up in one task from the postings of the keys the block holds there, so
a key's postings travel once per block and not once per item, and a key on very many products is split by range. Pairs that pass
are scored in the same task, and only an item's best ones in the range become rows. Bounds, floors and keys stay in tables: nothing is
collected but the numbers of items and ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import text as tx
from shelflens.session import materialize

ITEM_BITS, PRODUCT_BITS = 9, 18  # numbers of one block of items and of one range of products
WIDER_BITS, MANY_BLOCKS = 3, 256  # with more blocks than that, blocks are made wider by up to so many bits
TASKS_PER_CORE = 8  # that many at most
SEED_RANGES = 4
SEEDS = 2  # seeds per wanted product
SEED_PLACES, MOST_SEED_PLACES = 16, 128  # places looked at per seed
PAIRS_AT_ONCE = 1 << 16  # pairs scored together; an item with more is scored on its own
MARKS = 256  # rows of marks kept per range of products
STRETCH = 1 << 10  # places in a row of postings: rows are read thousands at a time, so none is long

# Classes of link keys; a key's number ends in its class, so shared keys can be counted by class.
_PLAIN, _WEAK, _STRONG, _VARIANT, _PACKAGING, _SIZE = range(6)
_CLASSES = 8
_PLACES, _CODES = -2, -3  # instead of a key's number: all products of a range, and their brands, families and flags


def _brands() -> list[str]:
    return list(dict.fromkeys(fv.BRANDS.values()))


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def signature(text: Column) -> Column:
    """Tokens and size as one string; '|' and ' ' cannot occur inside tokens."""
    return F.concat(F.array_join(tx.tokenize(text), " "), F.lit("|"), F.coalesce(tx.size_canon(text), F.lit("")))


def _read_once(rows: DataFrame, text: str, read: Callable[..., Column | list[Column]]) -> DataFrame:
    """``rows`` with what ``read`` makes of their text, in place of the text. Reading is most of the work, so a repeated text is read once."""
    rows = materialize(rows, "texts")
    made = read(F.col(text))
    # written down, so the reading is done by the tasks that texts are dealt to and not once more per row
    known = materialize(rows.select(text).distinct().select(text, *(made if isinstance(made, list) else [made])), "read")
    return rows.join(known, rows[text].eqNullSafe(known[text])).drop(text)


def _signature_features(df: DataFrame, sig: str, side: str) -> DataFrame:
    parts = F.split(F.col(sig), r"\|")
    size = F.get(parts, F.lit(1))
    out = df.withColumn("_t", F.filter(F.split(F.get(parts, F.lit(0)), " "), lambda t: t != "")).withColumn(
        "_f", tx.match_features(F.col("_t"), F.when(size != "", size)))
    fields = ["tokens", "brand", "family", "base_family", "variants", "packaging", "size"]
    return out.select(*df.columns, *[F.col("_f")[f].alias(f"{side}_{f}") for f in fields])


def _size_key(size: Column) -> Column:
    return F.when(size.isNotNull(), F.array(F.concat(F.lit("#"), size))).otherwise(_lit_array([]))


def _contained(parts: DataFrame, part: str, words: DataFrame, word: str, n: int) -> DataFrame:
    """(part, word) for every word that contains a different part of ``n`` letters or more.

    A part is looked up under its rarest group of ``n`` letters, so it meets only words that hold this group.
    """
    def grams(column: str) -> Column:
        starts = F.sequence(F.lit(1), F.length(column) - (n - 1))
        return F.array_distinct(F.transform(starts, lambda at: F.substring(F.col(column), at, F.lit(n))))

    held = words.where(F.length(word) >= n).select(word, F.explode(grams(word)).alias("gram"))
    asked = parts.where(F.length(part) >= n).select(part, F.explode(grams(part)).alias("gram"))
    sizes = held.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(sizes, "gram", "left").groupBy(part).agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, "gram").where(F.col(word).contains(F.col(part)) & (F.col(word) != F.col(part))).select(part, word)


def _vocabulary_links(item_sigs: DataFrame, product_sigs: DataFrame) -> DataFrame:
    """(item token, product token, kind): containment (product token of 3+ letters) and equal folds."""
    item_words = item_sigs.select(F.explode("i_tokens").alias("rt")).distinct()
    product_words = product_sigs.select(F.explode("p_tokens").alias("pt")).distinct()

    countable = item_words.where(~F.col("rt").isin(*fv.WEAK_WORDS, *fv.VARIANT_WORDS, *fv.PACKAGING_WORDS))
    inside_item = _contained(product_words.where(F.length("pt") >= 3), "pt", countable, "rt", 3)
    inside_product = _contained(countable, "rt", product_words.where(F.length("pt") >= 3), "pt", 2)
    folded = (item_words.withColumn("fold", tx.translit_fold(F.col("rt")))
              .join(product_words.withColumn("fold", tx.translit_fold(F.col("pt"))), "fold")
              .where(F.col("rt") != F.col("pt")))
    substring = inside_item.select("rt", "pt").unionByName(inside_product.select("rt", "pt"))
    return substring.withColumn("kind", F.lit("s")).unionByName(folded.select("rt", "pt").withColumn("kind", F.lit("x")))


def _key_class(key: Column) -> Column:
    return (F.when(key.startswith("#"), _SIZE).when(key.isin(*fv.WEAK_WORDS), _WEAK)
            .when(key.isin(*fv.FAMILIES, *_brands()), _STRONG).when(key.isin(*fv.VARIANT_WORDS), _VARIANT)
            .when(key.isin(*fv.PACKAGING_WORDS), _PACKAGING).otherwise(_PLAIN))


def _numbered_keys(product_sigs: DataFrame) -> DataFrame:
    """Every product key with a number of its own (written down, so the numbers stay)."""
    keys = product_sigs.select(F.explode("p_keys").alias("key")).distinct()
    number = F.monotonically_increasing_id() * _CLASSES + _key_class(F.col("key"))
    return materialize(keys.select("key", number.alias("key_no")), "keys")


def _position(words: list[str], word: Column) -> Column:
    return F.when(word.isNotNull(), F.array_position(_lit_array(words), word)).otherwise(0).cast("int")


def _scalars(side: str) -> list[Column]:
    """Brand and family as list positions and the rest of a signature as flags."""
    brand, base = F.col(f"{side}_brand"), F.col(f"{side}_base_family")
    return [_position(_brands(), brand).alias(f"{side}_brand_no"),
            F.when(base.isNotNull(), _position(fv.FAMILIES, F.element_at(F.split(base, ":"), -1))).otherwise(0).alias(f"{side}_base_no"),
            (F.size(f"{side}_variants") > 0).alias(f"{side}_has_var"), (F.size(f"{side}_packaging") > 0).alias(f"{side}_has_pack"),
            F.col(f"{side}_size").isNotNull().alias(f"{side}_has_size")]


def _numbers(df: DataFrame, key: str, array: str, keys: DataFrame, name: str) -> DataFrame:
    """The numbers of an array of keys; keys no product has are dropped."""
    rows = df.select(key, F.explode(array).alias("key")).join(keys, "key")
    return rows.groupBy(key).agg(F.collect_list("key_no").alias(name))


def _coded_items(item_sigs: DataFrame, links: DataFrame, keys: DataFrame) -> DataFrame:
    """Item signatures as numbers: own keys, linked keys, token weight total, flags, and the most that each key adds to a score."""
    n = F.size("i_tokens")
    weak = F.size(F.array_intersect("i_tokens", _lit_array(fv.WEAK_WORDS)))
    strong = F.size(F.array_intersect("i_tokens", _lit_array(fv.FAMILIES + _brands())))
    total = (n - weak - strong) * fv.WEIGHT_PLAIN + weak * fv.WEIGHT_WEAK + strong * fv.WEIGHT_STRONG
    sigs = item_sigs.withColumn("i_total", total)
    own = sigs.select("i_sig", "i_brand", "i_total", F.explode(F.concat("i_tokens", _size_key(F.col("i_size")))).alias("key")).join(keys, "key")
    numbered_links = (links.join(keys.select(F.col("key").alias("pt"), F.col("key_no").alias("to_no")), "pt")
                      .join(keys.select(F.col("key").alias("rt"), F.col("key_no").alias("from_no")), "rt", "left"))
    pair = F.struct(F.coalesce("from_no", F.lit(-1).cast("bigint")).alias("rt"), F.col("to_no").alias("pt"))
    counts = F.col("i_brand").isNull() | (F.col("rt") != F.col("i_brand"))
    linked = (sigs.select("i_sig", "i_brand", F.explode("i_tokens").alias("rt")).join(numbered_links, "rt")
              .where((F.col("kind") == "x") | counts))
    by_link = linked.groupBy("i_sig").agg(F.collect_list(F.when(F.col("kind") == "s", pair)).alias("i_sub"),
                                          F.collect_list(F.when(F.col("kind") == "x", F.col("to_no"))).alias("i_fold"))
    bounds = own.select("i_sig", "key_no", _own_bound().alias("most")).unionByName(linked.select(
        "i_sig", F.col("to_no").alias("key_no"),
        F.when(F.col("kind") == "s", F.lit(float(fv.POINTS_SUBSTRING))).otherwise(F.lit(float(fv.POINTS_TRANSLIT))).alias("most")))
    none = F.array().cast("array<bigint>")
    own_keys = own.groupBy("i_sig").agg(F.collect_list("key_no").alias("i_own"))
    return sigs.join(own_keys, "i_sig", "left").join(by_link, "i_sig", "left").join(_bounds(bounds), "i_sig").select(
        "i_sig", F.monotonically_increasing_id().alias("i_no"), n.alias("i_n"), "i_total", *_scalars("i"),
        F.coalesce("i_own", none).alias("i_own"), F.coalesce("i_sub", F.array().cast("array<struct<rt:bigint,pt:bigint>>")).alias("i_sub"),
        F.coalesce("i_fold", none).alias("i_fold"), "i_bounds")


def _own_bound() -> Column:
    """The most that a key of the item's own adds to a score: the family's points go to the brand, without which they are not given."""
    kind = F.col("key_no") % _CLASSES
    weight = F.when(kind == _WEAK, fv.WEIGHT_WEAK).when(kind == _STRONG, fv.WEIGHT_STRONG).otherwise(fv.WEIGHT_PLAIN)
    extra = F.when(kind.isin(_VARIANT, _PACKAGING), fv.POINTS_PER_VARIANT).when(
        F.col("key") == F.col("i_brand"), fv.POINTS_BRAND + fv.POINTS_FAMILY).otherwise(0)
    return F.when(kind == _SIZE, F.lit(float(fv.POINTS_SIZE_EQUAL))).otherwise(F.lit(float(fv.POINTS_TOKENS)) * weight / F.col("i_total") + extra)


def _bounds(rows: DataFrame) -> DataFrame:
    """i_sig and its keys with the most that each adds to a score."""
    per_key = rows.groupBy("i_sig", "key_no").agg(F.sum("most").alias("most"))
    return per_key.groupBy("i_sig").agg(F.collect_list(F.struct("key_no", "most")).alias("i_bounds"))  # the keys of one text


def _coded_products(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """Product groups as numbers; ``p_no`` follows the first product id without gaps, so it breaks ties the same way and fills the ranges."""
    ordered = groups.orderBy(F.get("ids", F.lit(0))).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("_part", F.shiftright("_at", 33)), "product_groups")
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per task
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", earlier.alias("_earlier"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.join(F.broadcast(offsets), "_part").withColumn("p_no", inside + F.col("_earlier"))
    numbers = ordered.select("p_no", F.explode("p_keys").alias("key")).join(keys, "key").groupBy("p_no").agg(F.collect_list("key_no").alias("p_keys"))
    return ordered.select("p_no", "ids", *_scalars("p")).join(numbers, "p_no")


#: What reasons follow from, as bits of a pair's flags; the size case (none, missing, equal, other) takes the two lowest.
_FLAGS = ["subs", "folds", "brand", "family", "varied", "other_variant", "other_pack", "common", "partial"]


class _Postings:
    """The postings of one range of products."""

    def __init__(self, found: pa.Table) -> None:
        keys, stretches = found["key_no"].to_numpy(), found["places"].combine_chunks()
        order = np.lexsort((found["stretch"].to_numpy(), keys)) if "stretch" in found.column_names else np.argsort(keys)
        keys, stretches = keys[order], stretches.take(pa.array(order))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = stretches.offsets.to_numpy()[np.append(first, len(keys))].tolist()
        every = stretches.flatten().to_numpy().astype(np.int64)
        self.places = {k: every[a:b] for k, a, b in zip(keys[first].tolist(), ends, ends[1:])}
        self.codes = np.zeros(1 << PRODUCT_BITS, np.int64)
        self.codes[self.places.pop(_PLACES)] = self.places.pop(_CODES)
        self.marks: dict[int, np.ndarray] = {}
        self.total = np.zeros(1 << PRODUCT_BITS)  # sums of bounds, 0 between items

    def hold(self, key: int, at: np.ndarray) -> np.ndarray:
        """Which of the places hold a key. Frequent keys are marked in a row of places, and few of these rows are kept."""
        places = self.places.get(key)
        if places is None:
            return np.zeros(len(at), bool)
        if len(places) * 256 < 1 << PRODUCT_BITS:
            return places.take(np.searchsorted(places, at), mode="clip") == at
        if key not in self.marks:
            if len(self.marks) == MARKS:
                self.marks.clear()
            self.marks[key] = np.zeros(1 << PRODUCT_BITS, bool)
            self.marks[key][places] = True
        return self.marks[key].take(at)


def _scores(items: list[dict], postings: _Postings, places: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each item, ten-thousandths of its score with the products at its places, and the flags of these pairs.

    What keys are held is looked up item by item; all else is worked out for the pairs of all items at once.
    """
    n = np.array([len(at) for at in places])
    ends = np.cumsum(n)
    at = np.concatenate(places)
    counts = np.zeros((_CLASSES, len(at)), np.int64)
    folds, subs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for item, own, end in zip(items, places, ends.tolist()):
        if not len(own):
            continue
        pairs = slice(end - len(own), end)
        for key in item["i_own"]:
            counts[key % _CLASSES, pairs] += postings.hold(key, own)
        for key in item["i_fold"]:
            folds[pairs] += postings.hold(key, own)
        for pair in item["i_sub"]:
            subs[pairs] += postings.hold(pair["pt"], own) & ~postings.hold(pair["rt"], own)
    plain, weak, strong, var, pack, size = counts[:6]
    total, tokens, brand_no, base_no, i_var, i_pack, i_size = (np.repeat(np.array([item[f"i_{name}"] for item in items]), n) for name in (
        "total", "n", "brand_no", "base_no", "has_var", "has_pack", "has_size"))
    code = postings.codes[at]
    has_var, has_pack, has_size = [(code >> n & 1).astype(bool) for n in range(3)]
    brand = (brand_no > 0) & (code >> 3 & 1023 == brand_no)
    family = brand & (base_no > 0) & (code >> 13 == base_no)
    size_case = np.where(~has_size, 0, np.where(~i_size, 1, np.where(size > 0, 2, 3)))
    other_variant = family & i_var & has_var & (var == 0)
    other_pack = i_pack & has_pack & (pack == 0)
    signals = brand.astype(int) + family + (size_case == 2)
    partial = (tokens <= fv.PARTIAL_TOKENS) & (signals < fv.PARTIAL_SIGNALS)

    common = plain + weak + strong + var + pack
    matched = (common - weak - strong) * fv.WEIGHT_PLAIN + weak * fv.WEIGHT_WEAK + strong * fv.WEIGHT_STRONG
    sizes = np.array([0, fv.POINTS_SIZE_MISSING, fv.POINTS_SIZE_EQUAL, fv.POINTS_SIZE_MISMATCH])[size_case]
    points = (float(fv.POINTS_TOKENS) * matched / total + subs * fv.POINTS_SUBSTRING + folds * fv.POINTS_TRANSLIT
              + brand * fv.POINTS_BRAND + family * fv.POINTS_FAMILY + sizes
              + np.minimum((var + pack) * fv.POINTS_PER_VARIANT, fv.POINTS_VARIANT_MAX)
              + other_variant * fv.POINTS_OTHER_VARIANT + other_pack * fv.POINTS_PACKAGING)
    cap = np.minimum(np.where(other_pack, fv.PACKAGING_CAP, fv.SCORE_CAP), np.where(partial, fv.PARTIAL_CAP, fv.SCORE_CAP))
    flags = size_case.astype(np.int64)
    for bit, flag in enumerate((subs > 0, folds > 0, brand, family, var + pack > 0, other_variant, other_pack, common > 0, partial)):
        flags |= flag.astype(np.int64) << (bit + 2)
    points = np.floor(np.maximum(0.0, np.minimum(points, cap)) + 0.5).astype(np.int64)
    return list(zip(np.split(points, ends[:-1]), np.split(flags, ends[:-1])))


def _score(item: dict, postings: _Postings, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one item."""
    return _scores([item], postings, [at])[0]


def _reasons() -> Column:
    flag = {name: F.getbit("flags", F.lit(n + 2)) == 1 for n, name in enumerate(_FLAGS)}
    size_case = F.col("flags").bitwiseAND(3)
    return F.array_compact(F.array(
        F.when(flag["subs"], "substring_match"), F.when(flag["folds"], "transliteration"),
        F.when(flag["brand"], "brand"), F.when(flag["family"], "product_family"),
        F.when(size_case == 1, "missing_size_review").when(size_case == 2, "size").when(size_case == 3, "size_mismatch_review"),
        F.when(flag["varied"], "variant"), F.when(flag["other_variant"], "different_variant_same_base_review"),
        F.when(flag["other_pack"], "packaging_mismatch_review"), F.when(flag["common"], "name_tokens"),
        F.when(flag["partial"], "partial_ocr_review")))


def _first_ids(products: DataFrame, group: str, k: int) -> DataFrame:
    """The first ``k`` product ids of each group, in id order."""
    order = Window.partitionBy(group).orderBy("product_id")
    first = products.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return first.groupBy(group).agg(F.array_sort(F.collect_list("product_id")).alias("ids"))


def _postings(groups: DataFrame) -> DataFrame:
    """(key_no, range, stretch, places): the products of a range that hold a key, by their place in the range; two more keys list all places and their codes.

    A long list is several rows, its stretches.
    """
    place = F.col("p_no").bitwiseAND((1 << PRODUCT_BITS) - 1).cast("int")
    part = F.shiftright("p_no", PRODUCT_BITS).alias("range")
    flat = groups.select("p_no", F.explode("p_keys").alias("key_no"))
    held = flat.groupBy("key_no", part).agg(F.sort_array(F.collect_list(place)).alias("places"))
    code = (F.col("p_has_var").cast("int") + F.col("p_has_pack").cast("int") * 2 + F.col("p_has_size").cast("int") * 4
            + F.col("p_brand_no") * (1 << 3) + F.col("p_base_no") * (1 << 13))
    coded = groups.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), code.alias("code")))).alias("x"))
    every = [coded.select(F.lit(no).cast("bigint").alias("key_no"), "range", F.col("x")[field].alias("places"))
             for no, field in ((_PLACES, "place"), (_CODES, "code"))]
    lists = held.unionByName(every[0]).unionByName(every[1])
    starts = F.sequence(F.lit(1), F.size("places"), F.lit(STRETCH))
    return lists.select("key_no", "range", F.posexplode(F.transform(starts, lambda at: F.slice("places", at, F.lit(STRETCH)))).alias("stretch", "places"))


def _sums(lists: list[tuple], others: list[tuple], postings: _Postings, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places on any of ``lists`` whose bounds add up to the floor or more with those of the ``others``, and these sums."""
    if len(lists) == 1:
        at, total = lists[0][1], np.full(len(lists[0][1]), lists[0][2])
    else:
        found = [np.zeros(0, np.int64)]
        for n, (key, places, most) in enumerate(lists):
            so_far = postings.total.take(places) if n else np.zeros(len(places))
            found.append(places[so_far == 0])
            postings.total[places] = so_far + most
        at = np.concatenate(found)
        total = postings.total.take(at)
        postings.total[at] = 0
    ahead = sum(most for _, _, most in others)
    for key, _, most in others:
        if floor > 0:
            keep = _reaches(total + ahead, floor)
            at, total = at[keep], total[keep]
        total = total + postings.hold(key, at) * most
        ahead -= most
    keep = _reaches(total, floor)
    return at[keep], total[keep]


def _met(item: dict, postings: _Postings) -> list[tuple]:
    """(key, places, bound) of the item's keys in the range, the rarest first."""
    met = [(x["key_no"], postings.places[x["key_no"]], x["most"]) for x in item["i_bounds"] if x["key_no"] in postings.places]
    return sorted(met, key=lambda x: len(x[1]))


def _likely(met: list[tuple], postings: _Postings, n: int) -> np.ndarray:
    """Places of ``n`` products, or fewer, with great sums: of those found under the rarest keys. They only give a floor."""
    lists, seen = 0, 0
    while lists < len(met) and seen < n * SEED_PLACES:
        seen += len(met[lists][1])
        lists += 1
    some = [(key, places[:n * MOST_SEED_PLACES], most) for key, places, most in met[:lists]]
    at, total = _sums(some, met[lists:], postings, 0.0)
    return at if len(at) <= n else at[np.argpartition(-total, n)[:n]]


def _worth(met: list[tuple], postings: _Postings, floor: float) -> np.ndarray:
    """Places of the products whose bounds add up to the floor or more.

    The longest lists whose bounds together stay below the floor are not walked: a product on them alone cannot reach it, so they are
    only looked up for the products of the other lists.
    """
    lists, others, spare = [], [], 0.0
    for one in reversed(met):
        if _reaches(spare + one[2], floor):
            lists.append(one)
        else:
            others.append(one)
            spare += one[2]
    return _sums(lists, others, postings, floor)[0]


def _reaches(total: np.ndarray, floor: float) -> np.ndarray:
    # sums of doubles: half a point rounds up, and a little more lets no rounding decide
    return total + 0.501 >= floor


def _best_of(items: list[dict], postings: _Postings, k: int, seeds: int | None) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each item with places, points and flags of its ``k`` best products of a range; with ``seeds`` among likely ones only."""
    def ranked(some: list[dict], places: list[np.ndarray]) -> Iterator[tuple]:
        for item, at, (points, flags) in zip(some, places, _scores(some, postings, places)):
            order = np.lexsort((at, -points))[:k]
            order = order[points[order] >= item["i_floor"]]
            yield item, at[order], points[order], flags[order]

    met = [_met(item, postings) for item in items]
    likely = [_likely(x, postings, seeds or SEEDS * k) for x in met]
    if seeds is not None:
        yield from ranked(items, likely)
        return
    first, places, held = 0, [], 0
    for i, (points, _) in enumerate(_scores(items, postings, likely)):
        # the k-th best of the likely ones is a floor of this range
        floor = np.partition(points, -k)[-k] if len(points) >= k else 0
        places.append(_worth(met[i], postings, max(items[i]["i_floor"], floor)))
        held += len(places[-1])
        if held > PAIRS_AT_ONCE or i == len(items) - 1:
            yield from ranked(items[first:i + 1], places)
            first, places, held = i + 1, [], 0


def _best(item: dict, postings: _Postings, k: int, seeds: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one item."""
    return next(_best_of([item], postings, k, seeds))[1:]


def _pairs(items: DataFrame, postings: DataFrame, k: int, bits: int, tasks: int, seeds: int | None = None, some: Column | None = None) -> DataFrame:
    """(i_no, p_no, points, flags) of the best pairs per item and range: blocks of items meet ranges of products, in the ranges for which ``some`` holds.

    They are dealt to a number of ``tasks``: their bytes are few, so tasks made by size would be few as well.
    """
    block = F.shiftright("i_no", bits).alias("block")
    wanted = items.select(block, F.explode("i_bounds").alias("x")).select("block", "x.key_no").distinct()
    always = wanted.select("block").distinct().select("block", F.explode(F.array(*[F.lit(no).cast("bigint") for no in (_PLACES, _CODES)])).alias("key_no"))
    lists = wanted.unionByName(always).join(postings, "key_no")
    ranges = postings.where((F.col("key_no") == _PLACES) & (F.col("stretch") == 0)).select("key_no", F.col("range").alias("range"))
    units = always.join(ranges, "key_no").select(F.col("block").alias("block"), "range")
    held = items.drop("i_sig").withColumn("block", block).join(units, "block")
    if some is not None:
        lists, held = lists.where(some), held.where(some)
    # both are made on the way to the tasks and never written: the postings of all blocks together are many times the tables
    lists, held = lists.repartition(tasks, "block", "range"), held.repartition(tasks, "block", "range")

    def meet(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        first = key[1].as_py() << PRODUCT_BITS
        postings = _Postings(found)
        empty = np.zeros(0, np.int64)
        made = [(empty, empty, empty, empty)]
        for batch in texts.to_batches(max_chunksize=256):
            for item, at, points, flags in _best_of(batch.to_pylist(), postings, k, seeds):
                made.append((np.full(len(at), item["i_no"]), at.astype(np.int64) + first, points, flags))
        return pa.table(dict(zip(("i_no", "p_no", "points", "flags"), map(np.concatenate, zip(*made)))))

    return held.groupBy("block", "range").cogroup(lists.groupBy("block", "range")).applyInArrow(meet, "i_no long, p_no long, points long, flags long")


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of scored pairs per item, with their place ``_g``."""
    best = Window.partitionBy("i_no").orderBy(F.col("points").desc(), F.col("p_no"))
    return pairs.withColumn("_g", F.row_number().over(best)).where(F.col("_g") <= k)


def _best_products(items: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """i_no, points, flags, product_id and rank of the k best products per item signature; ties go to the lower product id."""
    postings = materialize(_postings(groups), "postings")
    ranges = postings.select("range").distinct().count()
    blocks = items.count() >> ITEM_BITS
    bits = ITEM_BITS + sum(blocks >> n > MANY_BLOCKS for n in range(WIDER_BITS))
    tasks = min(TASKS_PER_CORE * items.sparkSession.sparkContext.defaultParallelism, ((blocks << ITEM_BITS >> bits) + 1) * max(ranges, 1))
    known = items.withColumn("i_floor", F.lit(1.0))
    if ranges > SEED_RANGES:  # a range has a floor of its own, so a few ranges need no seeds
        some = F.pmod(F.xxhash64("block", "range"), F.lit(ranges)) < SEED_RANGES
        seeds = materialize(_pairs(known, postings, k, bits, tasks, -(-SEEDS * k // SEED_RANGES), some), "seeds")
        floors = _scored(seeds, k).where(F.col("_g") == k).select("i_no", F.col("points").cast("double").alias("floor"))
        known = materialize(known.join(floors, "i_no", "left").withColumn("i_floor", F.greatest("i_floor", "floor")).drop("floor"), "floored")
    pairs = materialize(_pairs(known, postings, k, bits, tasks), "pairs")
    # groups behind k better products add nothing; they go before ids are moved
    sized = _scored(pairs, k).drop("_g").join(groups.select("p_no", F.size("ids").alias("_n")), "p_no")
    better = F.sum("_n").over(Window.partitionBy("i_no").orderBy(F.col("points").desc()).rangeBetween(Window.unboundedPreceding, -1))
    few = sized.withColumn("_better", F.coalesce(better, F.lit(0))).where(F.col("_better") < k).join(groups.select("p_no", "ids"), "p_no")
    order = Window.partitionBy("i_no").orderBy(F.col("points").desc(), F.col("product_id"))
    single = few.select("i_no", "points", "flags", F.explode("ids").alias("product_id"))
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def catalog_candidates(items: DataFrame, products: DataFrame, k: int = fv.DEFAULT_CANDIDATES) -> DataFrame:
    """J3 + W4 + T1: the best ``k`` catalogue products per item.

    ``items``: item_id, text. ``products``: product_id, name, text (name, brand and size joined), is_active.
    Returns item_id, product_id, rank, score, reasons; ties go to the lower product id.
    """
    wide = max(k, fv.DEFAULT_CANDIDATES)
    active = products.where(F.coalesce(F.col("is_active"), F.lit(True)))
    # signatures are written before they are filtered, as a filter would make them once more
    item_map = materialize(_read_once(items.select("item_id", "text"), "text", lambda text: signature(text).alias("i_sig")).repartition("item_id"), "item_map")
    item_map = item_map.where(~F.col("i_sig").startswith("|"))
    product_map = _read_once(active.select("product_id", "text"), "text", lambda text: signature(text).alias("p_sig"))

    item_sigs = materialize(_signature_features(item_map.select("i_sig").distinct(), "i_sig", "i"), "item_signatures")
    groups = materialize(_signature_features(_first_ids(product_map, "p_sig", wide), "p_sig", "p").withColumn(
        "p_keys", F.concat("p_tokens", _size_key(F.col("p_size")))), "product_signatures")
    keys = _numbered_keys(groups)
    links = materialize(_vocabulary_links(item_sigs, groups), "token_links")
    coded_items = materialize(_coded_items(item_sigs, links, keys), "coded_items")
    coded_groups = materialize(_coded_products(groups, keys), "coded_groups")
    found = materialize(_best_products(coded_items, coded_groups, wide), "best")
    marked = _mark_ambiguous_sizes(found, coded_items.select("i_no", "i_has_size"), active).where(F.col("rank") <= k)
    best = marked.select("i_no", "product_id", "rank", (F.col("points") / F.lit(10000.0)).alias("score"), F.when(
        F.col("_several"), F.array_append(_reasons(), "multiple_catalog_sizes_review")).otherwise(_reasons()).alias("reasons"))
    numbered = item_map.join(coded_items.select("i_sig", "i_no"), "i_sig")
    return numbered.join(best, "i_no").select("item_id", "product_id", "rank", "score", "reasons")


def _mark_ambiguous_sizes(top: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """``_several`` marks an item without size whose family shows several catalogue sizes; it needs a look at the size."""
    def marks(name: Column) -> list[Column]:
        tokens = tx.tokenize(name)
        return [tx.base_family(tx.brand_of(tokens), tx.family_of(tokens)).alias("_family"), tx.size_canon(name).alias("_size")]

    named = _read_once(products.select("product_id", "name"), "name", marks)
    rows = top.join(items, "i_no")
    joined = rows.where("not i_has_size").join(named, "product_id", "left")
    per_family = Window.partitionBy("i_no", "_family")
    counted = F.when((F.col("points") / F.lit(10000.0) >= fv.AMBIGUOUS_SIZE_SCORE) & F.col("_family").isNotNull(), F.col("_size"))
    several = F.size(F.collect_set(counted).over(per_family)) > 1
    marked = joined.withColumn("_several", F.col("_family").isNotNull() & several).drop("_family", "_size")
    return marked.unionByName(rows.where("i_has_size").withColumn("_several", F.lit(False)))
