"""Candidate join, decisions and match keys on small fixtures, and the join against plain pair-by-pair scoring."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import text as tx
from shelflens.operators import decisions as dc
from shelflens.operators import candidates
from shelflens.operators.candidates import catalog_candidates

CATALOG = [
    ("nivea-cream-250", "Nivea крем для душа кокос 250 мл", "Nivea", "250 мл"),
    ("nivea-cream-400", "Nivea крем для душа кокос 400 мл", "Nivea", "400 мл"),
    ("nivea-cream-250-aloe", "Nivea крем для душа алоэ 250 мл", "Nivea", "250 мл"),
    ("ariel-powder-3kg", "Ariel порошок автомат Color пакет 3 кг", "Ariel", "3 кг"),
    ("ariel-caps-15", "Ariel капсулы Color 15 шт", "Ariel", "15 шт"),
    ("palmolive-gel-250", "Palmolive гель для душа Олива 250 мл", "Palmolive", "250 мл"),
    ("dove-soap-100", "Dove мыло крем 100 г", "Dove", "100 г"),
    ("colgate-paste-100", "Colgate зубная паста мята туба 100 мл", "Colgate", "100 мл"),
    ("persil-gel-bottle-1l", "Persil гель автомат лаванда бутылка 1 л", "Persil", "1 л"),
    ("persil-gel-doypack-1l", "Persil гель автомат лаванда дойпак 1 л", "Persil", "1 л"),
    ("yashkino-waffle-200", "Яшкино вафли классические 200 г", "Яшкино", "200 г"),
    ("milka-choc-90", "Milka шоколад молочный 90 г", "Milka", "90 г"),
]


def products(spark, rows, active=True):
    df = spark.createDataFrame(rows, "product_id string, name string, brand string, size_text string")
    return df.withColumn("text", tx.match_text(F.col("name"), F.col("brand"), F.col("size_text"))).withColumn("is_active", F.lit(active))


def items(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "item_id bigint, text string")


def ranked(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append((r["product_id"], r["score"], list(r["reasons"])))
    return out


def test_best_candidates_and_decisions(spark):
    names = ["Nivea крем душ кокос 250 мл", "Ariel порошок автомат color 3 кг", "Palmolive гель душ олива 250 мл",
             "Dove мыло крем 100 г", "Colgate зубная паста мята 100 мл", "Persil гель автомат лаванда бутылка 1 л",
             "Nivea крем для душа алоэ 250 мл", "Nivea крем для душа кокос", "Persil гель автомат лаванда пакет 1 л", "Ariel"]
    found = catalog_candidates(items(spark, names), products(spark, CATALOG), k=5)
    got = ranked(found)
    best = ["nivea-cream-250", "ariel-powder-3kg", "palmolive-gel-250", "dove-soap-100", "colgate-paste-100",
            "persil-gel-bottle-1l", "nivea-cream-250-aloe"]
    assert [got[i][0][0] for i in range(7)] == best
    assert "multiple_catalog_sizes_review" in got[7][0][2]
    assert got[8][0][0] == "persil-gel-bottle-1l" and "packaging_mismatch_review" in got[8][0][2]
    decision = {r["item_id"]: r["decision"] for r in dc.photo_decision(dc.best_and_margin(found)).collect()}
    assert decision[1] == decision[4] == "auto"
    assert decision[7] == decision[8] == "suggested"
    decided = {r["item_id"]: r for r in dc.evidence_decision(dc.best_and_margin(found)).collect()}
    assert decided[9]["match_reason"].startswith("low_confidence_review") and decided[9]["review_required"]


def test_other_variant_keeps_family_and_is_not_auto(spark):
    found = catalog_candidates(items(spark, ["Nivea крем для душа алоэ 250 мл"]), products(spark, CATALOG[:1]), k=1)
    (product, score, reasons), = ranked(found)[0]
    assert score >= 0.66 and "product_family" in reasons and "different_variant_same_base_review" in reasons
    assert dc.photo_decision(dc.best_and_margin(found)).first()["decision"] != "auto"


def test_inactive_products_are_no_candidates(spark):
    assert catalog_candidates(items(spark, ["Nivea крем"]), products(spark, CATALOG, active=False)).count() == 0


def test_match_key(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([("Ariel",), ("Яшкино вафли классические 200 г",)], "n string")
    keys = [r[0] for r in df.select(tx.match_key(F.col("n"), none, none, none, none)).collect()]
    assert keys == ["", "yashkino вафля |200g"]


# Plain scoring, pair by pair, as the yardstick for the join.

def tokens(text):
    words = re.sub(r"[^a-zа-я0-9]+", " ", text.lower().replace("ё", "е")).strip().split(" ")
    out = []
    for w in words:
        w = {**fv.TOKEN_ALIASES, **fv.BRANDS}.get(w) or (
            re.sub(f"({fv.STEM_ENDINGS})$", "", w) if re.fullmatch("[а-я]{5,}", w) else w)
        if len(w) > 1 and not w.isdigit() and w not in fv.STOP_WORDS and w not in out:
            out.append(w)
    return out


def size(text):
    m = re.search(r"(\d+(?:[.,]\d+)?)\s*(кг|kg|г|гр|g|л|l|мл|ml|шт)", text.lower())
    if not m:
        return None
    n, unit = float(m.group(1).replace(",", ".")), m.group(2)
    kind = "g" if unit in ("кг", "kg", "г", "гр", "g") else "ml" if unit in ("л", "l", "мл", "ml") else "pc"
    return f"{int(n * (1000 if unit in ('кг', 'kg', 'л', 'l') else 1) + 0.5)}{kind}"


def fold(word):
    word = word.replace("zh", "ж")
    word = "".join(fv.LAT_TO_RU_FOLD.get(ch, ch) for ch in word).replace("ch", "ч")
    return "".join(fv.RU_TO_LAT_FOLD.get(ch, ch) for ch in word)


def facts(text):
    t = tokens(text)
    brand = next((w for w in t if w in fv.BRANDS.values()), None)
    family = next((w for w in fv.FAMILIES if w in t), None)
    return {"t": t, "brand": brand, "base": (brand, family) if brand and family else None, "size": size(text),
            "var": {w for w in fv.VARIANT_WORDS if w in t}, "pack": {w for w in fv.PACKAGING_WORDS if w in t}}


def plain_score(item, product):
    i, p = facts(item), facts(product)
    weight = lambda w: 35 if w in fv.WEAK_WORDS else 120 if w in fv.FAMILIES or w in fv.BRANDS.values() else 100
    points = 7000 * sum(weight(w) for w in i["t"] if w in p["t"]) / sum(map(weight, i["t"]))
    for w in i["t"]:
        if w not in p["t"] and w != i["brand"] and w not in i["var"] | i["pack"] and w not in fv.WEAK_WORDS:
            points += 1500 * sum(len(q) >= 3 and (q in w or w in q) for q in p["t"])
        points += 4000 * sum(w != q and fold(w) == fold(q) for q in p["t"])
    same_brand = i["brand"] is not None and i["brand"] == p["brand"]
    same_base = i["base"] is not None and i["base"] == p["base"]
    same_size = i["size"] is not None and i["size"] == p["size"]
    points += 1600 * same_brand + 1200 * same_base
    points += 0 if p["size"] is None else -200 if i["size"] is None else 1800 if same_size else -800
    points += min(400 * (len(i["var"] & p["var"]) + len(i["pack"] & p["pack"])), 800)
    if same_base and i["var"] and p["var"] and not i["var"] & p["var"]:
        points -= 500
    if i["pack"] and p["pack"] and not i["pack"] & p["pack"]:
        points = min(points - 800, 8900)
    if len(i["t"]) <= 2 and same_brand + same_base + same_size < 2:
        points = min(points, 6500)
    return int(max(0, min(points, 9900)) + 0.5) / 10000


def test_only_pairs_that_can_reach_the_floor_are_scored(spark, monkeypatch):
    scored = []
    plain = candidates._scored
    monkeypatch.setattr(candidates, "_scored", lambda pairs, *rest: scored.append(pairs) or plain(pairs, *rest))
    word = lambda kind, n: kind + "".join(chr(97 + n // 26 ** i % 26) * 2 for i in range(3))  # noqa: E731 - no word holds another
    text = lambda n: f"{word('q', n % 20)} {word('w', n % 2)} {word('z', n)}"
    catalog = [(f"p{n:04d}", text(n), None, None) for n in range(1500)]
    names = [text(n) for n in range(0, 1500, 10)]
    got = ranked(catalog_candidates(items(spark, names), products(spark, catalog), k=1))
    assert all(got[i][0][0] == f"p{i * 10:04d}" for i in range(len(names)))
    assert sum(p.count() for p in scored) < len(names) * 200  # of 1500 products each, 750 of which share a word


def test_lists_that_cannot_reach_the_floor_are_not_walked(monkeypatch):
    """A frequent key alone is below the floor that the products of rarer keys give; the best products are those of scoring all."""
    monkeypatch.setattr(candidates, "PRODUCT_BITS", 16)
    rng, n = random.Random(3), 60_000
    places = {0: sorted(rng.sample(range(n), 400)), 8: sorted(rng.sample(range(n), 900)), 16: sorted(rng.sample(range(n), 50_000))}
    found = {**places, candidates._PLACES: list(range(n)), candidates._CODES: [0] * n}
    postings = candidates._Postings(pa.table({"key_no": list(found), "places": pa.array(list(found.values()), pa.list_(pa.int32()))}))
    item = {"i_own": list(places), "i_sub": [], "i_fold": [], "i_brand_no": 0, "i_base_no": 0, "i_has_size": False, "i_has_var": False,
            "i_has_pack": False, "i_n": 3, "i_total": 300, "i_floor": 1.0, "i_bounds": [{"key_no": no, "most": 7000 / 3} for no in places]}
    walked, plain = [], candidates._sums
    monkeypatch.setattr(candidates, "_sums", lambda lists, *rest: walked.append(sum(len(x[1]) for x in lists)) or plain(lists, *rest))
    at, points, _ = candidates._best(item, postings, 5, None)
    every, _ = candidates._score(item, postings, np.arange(n))
    expected = sorted(range(n), key=lambda x: (-every[x], x))[:5]
    assert list(at) == expected and list(points) == [every[x] for x in expected]
    assert max(walked) < 2000  # of 51 300 places
    assert not postings.total.any()


def test_words_of_a_thousand_letters(spark):
    junk = "x" * 600 + "шоколад" + "y" * 400
    got = ranked(catalog_candidates(items(spark, [junk, "шоколад"]), products(spark, [("a", "шоколад", None, None), ("b", junk, None, None)]), k=2))
    assert [p for p, *_ in got[0]] == ["b", "a"] and [p for p, *_ in got[1]] == ["a", "b"]


def test_long_texts_keep_their_score(spark):
    """Shared tokens are counted apart by class, however many there are."""
    long = " ".join(f"слово{n}" for n in range(2000))
    got = ranked(catalog_candidates(items(spark, [long, "слово1 слово2"]), products(spark, [("p", long, None, None)]), k=1))
    assert [(p, s) for p, s, _ in got[0]] == [("p", plain_score(long, long))]


@pytest.mark.parametrize(("seeds", "product_bits", "item_bits"), [(2, 16, 9), (1, 3, 2), (0, 5, 1)])
def test_join_equals_pair_by_pair_scoring(spark, monkeypatch, seeds, product_bits, item_bits):
    """However few seeds set the floors and however small the blocks, the top candidates are those of scoring every pair."""
    monkeypatch.setattr(candidates, "SEEDS", seeds)
    monkeypatch.setattr(candidates, "PRODUCT_BITS", product_bits)
    monkeypatch.setattr(candidates, "ITEM_BITS", item_bits)
    rng = random.Random(7)
    words = ["nivea", "сплат", "splat", "колгейт", "крем", "гель", "паста", "кокос", "алоэ", "пакет", "туба", "соленый",
             "молоко", "молок", "шоколадка", "шоколад", "color", "душ", "zhuk", "жук", "олива"]
    text = lambda: " ".join(rng.sample(words, rng.randint(1, 5)) + rng.choice([[], ["250 мл"], ["100 г"], ["1 л"]]))
    catalog = [(f"p{n:03d}", text(), None, None) for n in range(120)]
    names = [text() for _ in range(25)]
    got = ranked(catalog_candidates(items(spark, names), products(spark, catalog), k=30))
    for n, name in enumerate(names):
        scored = [(pid, plain_score(name, t)) for pid, t, _, _ in catalog] if tokens(name) else []
        expected = sorted([x for x in scored if x[1] > 0], key=lambda x: (-x[1], x[0]))[:30]
        assert [(p, s) for p, s, _ in got.get(n, [])] == expected, name


def test_cascade_prefers_history_then_barcode(spark):
    seen = spark.createDataFrame([(1, "111"), (2, "222"), (3, None)], "source_product_id bigint, barcode string")
    history = spark.createDataFrame([(1, 9, 0.8, "fuzzy", "confirmed", "2024-01-02", 2), (1, 8, 0.9, "fuzzy", "needs_review", "2024-01-03", 3)],
                                    "source_product_id bigint, product_id bigint, confidence double, method string, status string, matched_at string, match_id bigint")
    catalog = spark.createDataFrame([(5, "111", True), (6, "222", True)], "product_id bigint, external_sku string, is_active boolean")
    none = spark.createDataFrame([], "source_product_id bigint, product_id bigint, confidence double, reason string")
    rows = {r["source_product_id"]: (r["product_id"], r["method"], r["status"]) for r in dc.online_cascade(seen, history, catalog, dc.table_decider(none)).collect()}
    assert rows == {1: (9, "fuzzy", "confirmed"), 2: (6, "barcode", "auto"), 3: (None, "fuzzy", "needs_review")}


def test_barcode_of_two_products_matches_none(spark):
    seen = spark.createDataFrame([(1, "111")], "source_product_id bigint, barcode string")
    catalog = spark.createDataFrame([(5, "111", True), (6, "111", True)], "product_id bigint, external_sku string, is_active boolean")
    assert dc.barcode_matches(seen, catalog).count() == 0


def test_alias_replaces_candidates_of_active_products(spark):
    aliases = spark.createDataFrame([("k", "a", 1), ("k", "b", 3)], "normalized_key string, product_id string, confirmations bigint")
    keyed = spark.createDataFrame([(1, "k"), (2, "")], "item_id bigint, match_key string")
    best = aliases.groupBy("normalized_key").agg(F.max_by("product_id", "confirmations").alias("product_id"))
    assert best.first()["product_id"] == "b"
    hits = keyed.where("match_key <> ''").select("item_id", F.lit("b").alias("product_id"), F.lit(1).alias("rank"),
                                                 F.lit(0.99).alias("score"), F.array(F.lit("learned_alias")).alias("reasons"))
    found = spark.createDataFrame([(1, "x", 1, 0.7, ["brand"]), (2, "y", 1, 0.6, ["brand"])],
                                  "item_id bigint, product_id string, rank int, score double, reasons array<string>")
    catalog = spark.createDataFrame([("b", True), ("x", True)], "product_id string, is_active boolean")
    rows = {r["item_id"]: r["product_id"] for r in dc.prefer_aliases(hits, found, catalog).collect()}
    assert rows == {1: "b", 2: "y"}


def test_manual_search_sends_no_catalogue_through_the_driver(spark, tmp_path):
    rows = [(f"p{i}", f"S{i}", f"Nivea крем {i % 50} мл", True) for i in range(200)] + [("one", "X1", "Ariel порошок 3 кг", True)]
    spark.createDataFrame(rows, "product_id string, external_sku string, name string, is_active boolean").write.parquet(str(tmp_path / "catalog"))
    catalog = spark.read.parquet(str(tmp_path / "catalog"))
    asked = spark.createDataFrame([(1, "S7"), (2, "nivea КРЕМ 7 мл"), (3, "порош"), (4, "zzz"), (5, " X1 "), (6, "3")], "item_id bigint, query string")
    found = dc.manual_search(asked, catalog)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["item_id"]: (r["product_id"], r["found_by"]) for r in found.collect()}
    assert got == {1: ("p7", "sku"), 2: (None, "ambiguous"), 3: ("one", "name"), 4: (None, "not_found"), 5: ("one", "sku"), 6: (None, "ambiguous")}


def test_tasks_put_out_only_the_best_of_a_range(spark, monkeypatch):
    """Very many equal products: scored pairs do not become rows, an item leaves a range as ``k`` rows at most."""
    seen = []
    plain = candidates._scored
    monkeypatch.setattr(candidates, "_scored", lambda pairs, *rest: seen.append(pairs) or plain(pairs, *rest))
    word = lambda n: "z" + "".join(chr(97 + n // 26 ** i % 26) * 2 for i in range(3))
    catalog = [(f"p{n:04d}", f"qqww {word(n)}", None, None) for n in range(900)]
    got = ranked(catalog_candidates(items(spark, ["qqww", "qqww yyhh"]), products(spark, catalog), k=30))
    assert [p for p, *_ in got[0]] == [f"p{n:04d}" for n in range(30)]
    assert sum(p.count() for p in seen) <= 2 * 30 * len(seen)


def test_match_keys_are_made_once(spark, small):
    """Filters and joins read the written keys; none of them makes a key from the text again."""
    import shelflens.plans.catalog  # noqa: F401 - registers the query
    from shelflens.plans.registry import QUERIES
    files = QUERIES["j4_aliases"](spark, small).inputFiles()
    assert files and all("/match_keys/" in f for f in files)


def test_blocks_are_dealt_to_more_tasks_than_their_bytes_ask_for(spark, monkeypatch):
    """Scoring is work per pair and not per byte: with 4 shuffle partitions and a few kilobytes, blocks still go to many tasks."""
    seen = []
    plain = candidates._scored
    monkeypatch.setattr(candidates, "_scored", lambda pairs, *rest: seen.append(pairs) or plain(pairs, *rest))
    monkeypatch.setattr(candidates, "ITEM_BITS", 1)
    names = [name for _, name, *_ in CATALOG]
    assert ranked(catalog_candidates(items(spark, names), products(spark, CATALOG), k=1))[0][0][0] == "nivea-cream-250"
    assert len(seen[-1].inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_made_after_rows_are_dealt_out(spark, small):
    from shelflens.plans.registry import Tables
    domain = Tables(spark, small).domain
    for texts in (domain.source_products, domain.match_products):
        plan = texts._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and plan.index(" AS text") < plan.index("RepartitionByExpression")


def test_signatures_are_made_after_texts_are_dealt_out(spark, monkeypatch):
    """A filter on a signature would move below the exchange and make signatures in the few tasks that read the texts."""
    plans = {}
    plain = candidates.materialize
    monkeypatch.setattr(candidates, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and plain(df, name))
    assert ranked(catalog_candidates(items(spark, ["Ariel", "-"]), products(spark, CATALOG[:4]), k=1))[0][0][0] == "ariel-powder-3kg"
    assert "RepartitionByExpression" in plans["item_map"] and "Filter" not in plans["item_map"]


def test_no_row_of_postings_is_long(spark, monkeypatch):
    """Rows are read thousands at a time: a key on very many products is several rows, and no copy for each block is written."""
    written, plain = {}, candidates.materialize
    monkeypatch.setattr(candidates, "materialize", lambda df, name: written.update({name: plain(df, name)}) or written[name])
    monkeypatch.setattr(candidates, "STRETCH", 7, raising=False)
    word = lambda n: "z" + "".join(chr(97 + n // 26 ** i % 26) * 2 for i in range(3))
    catalog = [(f"p{n:04d}", f"qqww {word(n)}", None, "250 мл" if n % 3 else None) for n in range(100)]
    find = lambda: ranked(catalog_candidates(items(spark, ["qqww", f"qqww {word(77)} 250 мл"]), products(spark, catalog), k=30))
    got = find()
    assert max(len(r.places) for r in written["postings"].collect()) <= 7 and "lists" not in written
    assert got[1][0][0] == "p0077" and len(got[0]) == len(got[1]) == 30
    monkeypatch.setattr(candidates, "STRETCH", 1 << 10, raising=False)
    assert find() == got


def test_a_repeated_text_is_read_once(spark, monkeypatch):
    """Texts are tokenized once each, however many items and products have them."""
    written, plain = {}, candidates.materialize

    def noted(df, name):
        out = plain(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(candidates, "materialize", noted)
    many = ["Nivea крем 250 мл"] * 40 + ["Fa гель"] * 20
    found = catalog_candidates(items(spark, many), products(spark, CATALOG), k=1).collect()
    assert written["read"][0] == 2 and written["item_map"] == [60]
    assert len({(r.product_id, r.score) for r in found}) <= 2
