"""Pages, payloads, recognition and catalogue files."""

import csv
import io
import random

from pyspark.sql import functions as F

from shelflens.sources import catalog as cs, pages as pg, recognition as rc, sinks

CARD = '<div class="product-card" data-id="{id}"{attrs}><a href="/product/{id}/"{title}><span class="x"></span></a><div class="availability">{stock}</div></div>'


def page(spark, html, source="spar_online", context="online_delivery"):
    return spark.createDataFrame([("p", source, context, html)], "page_id string, source_key string, price_context string, html string").withColumn(
        "observed_at", F.lit("2024-01-01").cast("timestamp"))


def test_cards_skip_incomplete_ones(spark):
    cards = [
        CARD.format(id=1, attrs=' data-price="89.90" data-barcode="4607029428179"', title=' title="Молоко 1л"', stock="В наличии"),
        CARD.format(id=2, attrs=' data-price="129" data-old-price="159"', title=' title="Кофе"', stock="Нет в наличии"),
        CARD.format(id=3, attrs="", title=' title="Без цены"', stock="В наличии"),
        CARD.format(id=4, attrs=' data-price="1"', title="", stock="В наличии"),
        CARD.format(id=5, attrs=' data-price="abc"', title=' title="Битая цена"', stock="В наличии"),
    ]
    html = '<div class="products-grid">' + "\n".join(cards) + "</div>"
    rows = {r["source_product_id"]: r for r in pg.extract_cards(page(spark, html)).collect()}
    assert sorted(rows) == ["1", "2", "5"]
    assert rows["1"]["barcode"] == "4607029428179" and rows["1"]["url"] == "https://spar-online.ru/product/1/"
    assert (rows["2"]["price_minor"], rows["2"]["old_price_minor"], rows["2"]["availability"]) == (12900, 15900, "out_of_stock")
    assert rows["5"]["price_minor"] == 0


def test_empty_and_error_pages_yield_nothing(spark):
    assert pg.extract_pages(page(spark, "<html></html>")).count() == 0
    assert pg.extract_pages(page(spark, '<script type="application/json">{broken</script>500')).count() == 0


def nested(path, items):
    doc = f'{{"items": {items}, "hasMore": false}}'
    for key in reversed(path):
        doc = f'{{"{key}": {doc}}}'
    return f'<html><script id="__NEXT_DATA__" type="application/json">{doc}</script></html>'


ITEM = ('[{"id": "2001", "name": "Молоко", "size": "1л", "barcode": "4607029428179", "url": "/product/2001/", "price": "89.90", "old_price": "89.90", '
        '"promo_price": null, "store_price": "87.50", "store_promo_price": "85.00", "available": true, "stock": 50}, {"id": 2003, "name": "Чай", "price": 12990, "available": false, "stock": 0}]')


def test_embedded_json_paths_and_store_prices(spark):
    first = nested(["props", "pageProps", "initialState", "catalog", "products"], ITEM)
    other = nested(["props", "pageProps", "catalog", "products"], ITEM)
    for html, source in ((first, "metro_online"), (other, "magnit"), (first, "x5_5ka")):
        rows = {r["source_product_id"]: r for r in pg.extract_embedded_json(page(spark, html, source)).collect()}
        assert (rows["2001"]["price_minor"], rows["2001"]["promo_price_minor"], rows["2003"]["availability"]) == (8990, None, "out_of_stock")
        assert rows["2001"]["old_price_minor"] is None and rows["2003"]["price_minor"] == 12990
    visit = pg.extract_embedded_json(page(spark, first, "metro_online", "store_visit")).where("source_product_id = '2001'").first()
    assert (visit["price_minor"], visit["promo_price_minor"]) == (8750, 8500)


def test_api_payload(spark):
    body = '{"results": [{"product": {"id": 7, "price": {"value": 10.5}, "regular_price": "10.50", "name": "Сыр"}}], "next": "url"}'
    df = page(spark, "").withColumn("payload", F.lit(body)).drop("html")
    assert pg.flatten_api(df.withColumn("source_key", F.lit("magnit"))).first()["price_minor"] == 1050
    assert pg.flatten_api(df.withColumn("source_key", F.lit("x5_5ka"))).first()["source_product_id"] == "7"
    assert df.select(pg.api_has_more(F.col("payload"))).first()[0]


def test_recognition_payloads(spark):
    bodies = ['```json\n[{"name": "Сок", "price": "89,99", "bbox": [100, 200, 300, 400]}]\n```', '{"data": {"products": [{"product": "Чай", "price": 120}, {"brand": "x"}]}, "warning": "тёмно"}',
              "{broken", '{"other": 1}', '{"items": [{"raw_name": "A", "price_minor": 10.4, "bbox": {"x": 0.9, "y": 0.1, "width": 0.2, "height": 0.1}, "needs_review": true}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "payload_id int, payload string")
    rows = {(r["payload_id"], r["item_no"]): r for r in rc.normalize_recognition(df).collect()}
    assert sorted(rows) == [(0, 0), (1, 0), (4, 0)]
    assert rows[(0, 0)]["price_minor"] == 8999 and tuple(rows[(0, 0)]["bbox"]) == (0.2, 0.1, 0.2, 0.2)
    assert rows[(1, 0)]["price_minor"] == 12000 and rows[(4, 0)]["bbox"] is None and rows[(4, 0)]["needs_review"]
    parsed = {r["payload_id"]: r for r in rc.parse_payloads(df).collect()}
    assert parsed[2]["error"] and parsed[1]["warnings"] == ["тёмно"] and len(parsed[3]["warnings"]) == 1


def test_catalog_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Артикул;Название;бренд;Цена_руб\nA1;Сыр;;1 299,50\n;;;\nA2;;x;5\n;Хлеб;;7\nA1;Сыр новый;y;10\n", encoding="utf8")
    rows = cs.read_catalog(spark, str(tmp_path / "a.csv"), ";")
    valid, rejected = cs.split_valid(rows)
    assert valid.count() == 2 and {r["error"] for r in rejected.collect()} == {cs.fv.ERROR_NO_SKU, cs.fv.ERROR_NO_NAME}
    current = spark.createDataFrame([("A9", "9", "Соль", None, None, 5)], "external_sku string, product_id string, name string, brand string, size_text string, own_price_minor bigint")
    state = cs.upsert_catalog(current, valid)
    got = {r["external_sku"]: (r["name"], r["own_price_minor"], r["change"]) for r in state.collect()}
    assert got == {"A1": ("Сыр новый", 1000, "created"), "A9": ("Соль", 5, "kept")}
    audit = cs.import_audit(cs.check_rows(rows), state)
    assert audit.count() == 4 and cs.import_status(audit).first()["status"] == "completed_with_errors"


def test_run_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "run_id int, price_minor bigint")
    path = str(tmp_path / "prices")
    sinks.write_run(df, path)
    sinks.write_run(df.where("run_id = 1"), path)
    assert spark.read.parquet(path).count() == 3


def test_photo_files(spark, tmp_path):
    for name, body in (("a.jpg", b"1"), ("b.jpg", b"1"), ("c.jpg", b"2")):
        (tmp_path / name).write_bytes(body)
    photos = sinks.read_photos(spark, str(tmp_path), "*.jpg").withColumn("session_id", F.lit("s"))
    assert sinks.dedup_photos(photos).count() == 2


def plain_records(raw, delimiter):
    """File rows by Python's reader, numbered as the library numbers them."""
    rows = [r for r in csv.reader(io.StringIO(raw.removeprefix("\ufeff"), newline=""), delimiter=delimiter) if r]
    head = [h.strip().lower() for h in rows[0]]
    return {n: dict(zip(head, [v.strip() for v in r])) for n, r in enumerate(rows[1:], 2) if any(v.strip() for v in r)}


def test_files_with_their_own_delimiters_and_row_numbers(spark, tmp_path):
    rng = random.Random(8)
    names = ["plain", "two\nlines", "say \"so\"; or, not | ever\t!", "win\r\ndows\n\nfour", "", "длинное имя " * 30]
    files = {}
    for n, (delimiter, end) in enumerate([(",", "\n"), (";", "\r\n"), ("\t", "\n"), ("|", "\r\n"), (";", "\n")]):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=delimiter, lineterminator=end, quoting=csv.QUOTE_ALL if n % 2 else csv.QUOTE_MINIMAL)
        writer.writerow([" SKU", "Название", "Brand", "Размер", "Цена"])
        for k in range(120):
            writer.writerow([f"s{k}" if k % 9 else "", rng.choice(names), rng.choice("ab"), "1 г", f"{k},5"] if k % 11 else [""] * 5)
            if k % 17 == 0:
                out.write(end)  # an empty line is no record
        files[f"f{n}.csv"] = (("\ufeff" if n == 1 else "") + out.getvalue(), delimiter)
    (tmp_path / "in").mkdir()
    for name, (raw, _) in files.items():
        (tmp_path / "in" / name).write_bytes(raw.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", before):  # ranges far smaller than many records, and whole files
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "300b" else "4194304")
            got = {}
            for r in cs.read_catalog(spark, str(tmp_path / "in")).collect():
                got.setdefault(r.file.rsplit("/", 1)[1], {})[r.row_number] = (r.external_sku, r.name, r.brand, r.size_text, r.own_price_minor)
            for name, (raw, delimiter) in files.items():
                expected = {n: (r["sku"] or None, r["название"] or None, r["brand"] or None, r["размер"] or None, int(float(r["цена"].replace(",", ".")) * 100) if r["цена"] else None)
                            for n, r in plain_records(raw, delimiter).items()}
                assert got[name] == expected, (name, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("sku;name\n")
    assert cs.read_catalog(spark, str(tmp_path)).count() == 0


def test_catalogue_files_keep_their_order_however_the_table_is_cut(spark, small, tmp_path):
    import shelflens.plans.catalog  # noqa: F401 - registers the query
    from shelflens.plans.registry import QUERIES
    spark.read.parquet(f"{small}/part.parquet").repartition(5, "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    rows = {r["external_sku"]: (r["chunk"], r["row_number"]) for r in QUERIES["s1_catalog_files"](spark, str(tmp_path)).collect()}
    keys = sorted(r[0] for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey").collect())
    for shop in range(4):
        for n, key in enumerate(k for k in keys if k % 4 == shop):
            assert key % 13 == 0 or rows[f"S{key}"] == (0, n + 2)
