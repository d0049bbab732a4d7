"""The pipeline against a brute-force version on a small fixture."""

import random
import re

import corpus_pipeline
from tests.llm.test_pair_operators import near_expected, words
from tests.llm.test_text_operators import PII

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(11)
    vocabulary = {"en": "the cat and dog were on mat with hat over house river".split(), "de": "der hund und die katze waren auf matte mit hut fluss".split()}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))
    items = [(n, text("en", 30)) for n in range(3)]
    rows = [(n, text("en" if n % 2 else "de", rng.choice((5, 40, 90))), "en" if n % 2 else "de") for n in range(60)]
    rows += [(100 + n, rows[n][1] + " end", rows[n][2]) for n in range(8)]  # near and, below, exact copies
    rows += [(120 + n, rows[n][1], None) for n in range(4)]
    rows += [(200, text("en", 20) + " " + items[1][1] + " " + text("en", 20), "en"), (201, "1234 5678 !!", "en"), (202, None, "en"), (203, "", "de"),
             (204, "write to some.body@mail.example.com or call +1 (279) 555-5103 about " + text("en", 12), "en"), (205, rows[7][1], "en"), (205, rows[7][1], "en")]
    return rows, items


def redacted(text):
    spans = [(m.start(), m.end(), k) for k, p, ok in PII for m in re.finditer(p, text) if ok(m.group())]
    for start, end, kind in sorted(spans, reverse=True):
        text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
    return text


def expected(rows, items):
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    _, component = near_expected([(i, t) for i, t, _ in kept])
    kept = list({r[0]: r for r in kept if component[r[0]] == r[0]}.values())
    windows = {tuple(w[i:i + 10]) for _, t in items for w in [words(t)] for i in range(len(w) - 9)}
    clean = [r for r in kept if not any(tuple(w[i:i + 10]) in windows for w in [words(r[1])] for i in range(len(w) - 9))]
    return {i: redacted(t) for i, t, _ in clean}


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece
    from shelflens.llm import pieces
    rows, items = fixture()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: library.decode(r.pieces) for r in got}
    assert texts == expected(rows, items) and len(got) == len(texts)
    assert all(r.round_trip and r.n_pieces == len(r.pieces) and r.n_chars == len(texts[r.doc_id]) and r.lang for r in got)
    assert 204 in texts and "<EMAIL>" in texts[204] and "<PHONE>" in texts[204] and 200 not in texts


def test_pieces_are_decoded_and_no_document_is_lost(spark, tmp_path):
    texts = {1: "the cat  on the mat", 2: None, 3: "", 4: "katze \U0001f600"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in corpus_pipeline.encode_pieces(spark, docs, str(tmp_path)).collect()}
    assert {i: r.decoded for i, r in got.items()} == {1: texts[1], 2: None, 3: None, 4: texts[4]}
    assert all(r.lang == "en" and (r.n_pieces or 0) == len(r.pieces or []) for r in got.values()) and got[2].pieces is None


def test_rows_of_one_id_are_judged_each_on_its_text(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta river stone cloud house".split()) + str(rng.randrange(90)) for _ in range(n))
    first, item, clean, other = text(60), text(30), text(60), text(60)
    rows = [(1, first), (7, first + " end"), (7, clean), (7, clean), (8, text(5) + " " + item), (8, other), (None, first + " stop"), (None, text(40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert pairs(single) == sorted([rows[n] for n in (0, 2, 4, 5, 7)], key=repr)
    assert pairs(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == sorted([r for n, r in enumerate(rows) if n != 4], key=repr)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, "only text here", None, "s", 14, "x"), (1, None, "en", "s", 0, "y"), (2, "other words entirely", "en", "s", 20, "z")], DOCS + ", id string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r.text for r in out.collect()} >= {"only text here", "other words entirely"}, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pieces"]


def test_stages_leave_columns_of_their_own_names_alone(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat and the dog on the mat", None, "s", 30, 0.123, "mine", "k", 9)],
                                 DOCS + ", score double, lang_pred string, kept string, component_id long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        row = stage(spark, docs, str(tmp_path)).collect()
        assert [(r.score, r.lang_pred, r.kept, r.component_id) for r in row] == [(0.123, "mine", "k", 9)] or name == "language" and row == [], name
    taught = docs.unionByName(docs.selectExpr("doc_id + 1 as doc_id", "text", "'en' as lang", "source", "n_chars", "score", "lang_pred", "kept", "component_id"))
    kept = corpus_pipeline.identify_language(spark, taught.unionByName(taught.withColumn("doc_id", taught.doc_id + 10)), str(tmp_path)).collect()
    assert kept and all((r.score, r.lang_pred, r.lang) == (0.123, "mine", "en") for r in kept)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_are_dropped_by_key_without_moving_texts(spark, tmp_path, monkeypatch):
    """With a bitmap so small that most kept rows share a bit with one that goes, exactly the wanted rows go; with the usual one no text meets them."""
    docs = corpus_pipeline._keyed(spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(300)], DOCS))
    gone = docs.where("doc_id % 5 = 0").select(corpus_pipeline.KEY)
    moved, plain = [], corpus_pipeline._marked
    monkeypatch.setattr(corpus_pipeline, "_marked", lambda docs, *filters: moved.append((len(filters), plain(docs, *filters))) or moved[-1][1])
    for bits in (7, 26):
        monkeypatch.setattr(corpus_pipeline, "FILTER_BITS", bits)
        left = corpus_pipeline._without(docs, gone)
        assert sorted(r.doc_id for r in left.collect()) == [i for i in range(300) if i % 5]
    assert moved[-1][0] == 2 and moved[-1][1].count() == 0  # the rows that a join decides
