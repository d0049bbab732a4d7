"""Money, text, box and shelf-text functions on the known cases."""

from pyspark.sql import functions as F

from shelflens.functions import boxes, money, report_text as rt, text as tx
from shelflens.operators import shelf_text as st


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").withColumn("out", expr(F.col("v")))
    return [r["out"] for r in rows.orderBy("i").collect()]


def test_price_text(spark):
    values = ["129.90", "129,90", "129", "1 299 ₽", "89.90 ₽", None, "abc", "", "1.299.90", ",5"]
    assert column(spark, values, money.price_text_to_minor) == [12990, 12990, 12900, 129900, 8990, 0, 0, 0, 130, 50]


def test_price_number(spark):
    assert column(spark, [289.0, 12990.0, 10000.0, None], money.price_number_to_minor, "double") == [28900, 12990, 1000000, 0]


def test_price_with_currency(spark):
    got = column(spark, ["10 USD", "10 eur", "10 ₽", "10"], money.price_with_currency)
    assert [(r["price_minor"], r["currency"]) for r in got] == [(90000, "USD"), (100000, "EUR"), (1000, "RUB"), (1000, "RUB")]


def test_recognition_and_import_prices(spark):
    assert column(spark, ["89,99", "12.345", "нет", None], money.recognition_text_to_minor) == [8999, 1234, None, None]
    assert column(spark, ["1 299,5", "12a", "-5", ""], money.import_price_to_minor) == [129950, None, -500, None]
    assert column(spark, ["-5", "5"], money.form_price_to_minor) == [None, 500]


def test_rounding_goes_up_at_halves(spark):
    assert column(spark, [-2.5, 2.5, -2.4], money.round_half_up, "double") == [-2, 3, -2]


def test_sizes(spark):
    values = ["500 g", "0.5 l", "250 ML", "1 kg", "3 pcs", "100 gramm", None, ""]
    assert column(spark, values, tx.size_text_norm) == ["500г", "0.5л", "250мл", "1kг", "3шт", "100г", None, None]
    assert column(spark, ["Молоко 1,5 л", "крем 250 мл", "15 шт", "3 кг", "нет"], tx.size_canon) == ["1500ml", "250ml", "15pc", "3000g", None]


def test_barcodes(spark):
    assert column(spark, ["4607029428179", "12345", "46070-29428", None], tx.barcode_norm) == ["4607029428179", None, "4607029428", None]
    assert column(spark, [" 4607.0", "0", "", None], tx.template_barcode) == ["4607", None, None, None]


def test_transliteration(spark):
    assert column(spark, ["щётка", "объём"], tx.translit_ru_lat) == ["schёtka", "obёm"]
    folded = column(spark, ["Сплат", "splat", "жук", "zhuk"], tx.translit_fold)
    assert folded[0] == folded[1] and folded[2] == folded[3]


def test_tokens(spark):
    got = column(spark, ["Вафли ЯШКИНО классические, 200 г!", "Зубная паста 100 мл"], tx.tokenize)
    assert got == [["вафля", "yashkino", "классический"], ["зубной", "паста", "мл"]]


def test_store_label(spark):
    got = column(spark, ["Спар, Ленина 60, к. 2", "Магнит"], tx.split_store_label)
    assert [tuple(r) for r in got] == [("Спар", "Ленина 60, к. 2"), ("Магнит", None)]


def test_boxes(spark):
    df = spark.createDataFrame([(0.9, 0.1, 0.2, 0.1), (120.0, 250.0, 360.0, 120.0)], "x double, y double, w double, h double")
    got = [r[0] for r in df.select(boxes.bbox_norm(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).collect()]
    assert got[0] is None and tuple(got[1]) == (0.12, 0.25, 0.36, 0.12)
    pad = df.limit(1).select(boxes.padded_box(F.lit(5), F.lit(5), F.lit(10), F.lit(10), F.lit(20), F.lit(100), 8)).first()[0]
    assert (pad["x"], pad["y"], pad["width"], pad["height"], pad["was_clamped"]) == (0, 0, 20, 23, True)


def test_percent_and_duration(spark):
    assert column(spark, [0.125, -0.0496, 0.1, None], rt.percent_text, "double") == ["12.5%", "-5%", "10%", ""]
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' s, timestamp'2024-01-01 00:01:45' e, CAST(NULL AS timestamp) n")
    assert tuple(df.select(rt.run_duration_text(F.col("s"), F.col("e")), rt.run_duration_text(F.col("s"), F.col("n"))).first()) == ("2 мин 45 сек", "—")


PRICES = [
    ("Цена 99 90 руб", 9990, None, None), ("Молоко 2.5% 99,90 ₽", 9990, None, None), ("Кофе 1 299.90 руб", 129990, None, None),
    ("Цена: 45:50", 4550, None, None), ("Старая цена 129,90\nНовая цена акция 99,90", 9990, 12990, 9990), ("Акция 77,70", 7770, None, 7770),
    ("Молоко 2.5% 900 г", None, None, None), ("  ", None, None, None),
]


def test_prices_from_text(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PRICES)], "i int, text string")
    rows = st.prices_from_text(df).orderBy("i").collect()
    assert [(r["price_minor"], r["old_price_minor"], r["promo_price_minor"]) for r in rows] == [p[1:] for p in PRICES]
    assert rows[4]["kind"] == "promo" and [r["reason"] for r in rows[-2:]] == ["no_price_candidate", "empty_text"]


def test_price_far_into_a_long_text(spark):
    """Whole texts are read: a labelled price after many plain numbers is still the best one."""
    text = " ".join(f"код {n}" for n in range(100, 3000)) + " Цена 59,90 руб"
    row = st.prices_from_text(spark.createDataFrame([(text,)], "text string")).first()
    assert row["price_minor"] == 5990 and row["candidate_count"] > 2000


def test_product_names_from_text(spark):
    cases = [
        ("Кофе Жокей Традиционный 250 г\nСтарая цена 129,90\nАкция 99,90\nруб", "Кофе Жокей Традиционный 250 г", "кофе жокей традиционный 250 г", 3),
        ("Кофе 3 в 1 MacCoffee\nЦена 45 90", "Кофе 3 в 1 MacCoffee", "кофе 3 в 1 maccoffee", 1),
        ("Макароны Щебекинские\nЦена 79,99", "Макароны Щебекинские", "макароны щебекинские", 1),
        ("Цена\n99 90\nруб", None, None, 3),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    rows = st.product_names_from_text(st.prices_from_text(df)).orderBy("i").collect()
    assert [(r["raw_name"], r["normalized"], r["removed_line_count"]) for r in rows] == [c[1:] for c in cases]


def test_a_text_is_searched_for_prices_once(spark):
    """Matches, their groups and what stands around them come from one search; labels are only looked for beside their words."""
    from shelflens.operators.shelf_text import prices_from_text
    texts = ["Кофе 250 г\nСтарая цена 1200,50\nНовая цена 99,90", "Цена\t\t12 50\u0000 руб", "", None, "без цен", "1 2 3 4 5 6 7 8 9 Цена 10—50"]
    found = prices_from_text(spark.createDataFrame(list(enumerate(texts)), "n int, text string"))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.n: (r.price_minor, r.old_price_minor, r.kind, r.selected_text) for r in found.collect()}
    assert rows[0] == (9990, 120050, "promo", "99,90") and rows[1] == (1250, None, "regular", "12 50")
    assert rows[2] == rows[3] == rows[4] == (None, None, None, None) and rows[5][0] == 1050
