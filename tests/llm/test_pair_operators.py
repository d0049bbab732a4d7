"""Operators on pairs, indexes and archives against brute force or SQL, and their edge cases."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from shelflens.llm import decontaminate, embeddings, graph, minhash, queries, suffix, warc
from shelflens.llm.common import word_hashes, word_spans
from tools.check import TABLES, rows_of

DOCS = "doc_id long, text string, n long, id string, component_id long, rep long"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


def connected(nodes, edges):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", ["op5_embedding_near_dedup", "op6_warc_revisits", "op8_minhash_near_dedup", "op10_benchmark_decontamination"])
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    cur = con.execute(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())[:1] + (sorted(df.columns),)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == connected({x for e in real for x in e}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def near_fixture():
    rng = random.Random(5)
    rows, number = [], 0
    for size in (3, 12, 40, 41, 60, 300):
        base = [rng.choice(WORDS) for _ in range(size)]
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 5, 8):  # many pairs close to the limit on either side
            text = list(base)
            for _ in range(edits if size > 3 else 0):
                text[rng.randrange(size)] = rng.choice(WORDS)
            rows.append((number, " ".join(text)))
            number += 1
    line = " ".join(rng.choice(WORDS) for _ in range(25))  # a line that very many documents share
    for _ in range(60):
        rows.append((number, line + " " + " ".join(rng.choice(WORDS) for _ in range(rng.choice((3, 8, 60))))))
        number += 1
    return rows + [(900, None), (901, ""), (902, "  \t "), (903, "one"), (904, "ONE"), (905, "É one"), (906, rows[0][1]), (906, rows[0][1]), (907, "x " * 30_000)]


def near_expected(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, connected(ids, links)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = near_fixture()
    sets, component = near_expected(rows)
    got = minhash.near_duplicates(frame(spark, rows + [(None, "no id")])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id), r


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert [r.component_id for r in minhash.near_duplicates(frame(spark, [(4, None)])).collect()] == [4]


def removed_bytes(rows, length):
    seen = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for i, b in raw:
        hit = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                hit[j:j + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, hit) if not y)
        out.append((i, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeats_fixture():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh éñ\n") for _ in range(n))
    passage, line = word(330), word(205)
    rows = [(i, word(rng.randrange(400)) + passage[rng.randrange(60):] + word(rng.randrange(300))) for i in range(25)]
    rows += [(100 + i, word(150) + line + word(150)) for i in range(40)]  # one frequent line between differing neighbours
    rows += [(200, "ab" * 700), (201, "a" * 199), (202, "a" * 200), (203, "x" + "a" * 201), (204, None), (205, ""), (206, line), (206, line), (None, passage),
             (207, word(5000)), (208, "\0" * 300 + "\1" * 150), (209, "\0" * 150 + "\1" * 150)]
    return rows


@pytest.mark.parametrize("group_bytes", [1 << 17, 2500, 0])
def test_repeats_equal_all_windows(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(suffix, "CHUNK", 2000)
    monkeypatch.setattr(suffix, "BITS", 16)
    rows = repeats_fixture()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == removed_bytes(rows, 200)


def test_repeats_of_nothing(spark):
    assert suffix.without_repeats(frame(spark, [])).count() == 0


def test_common_prefixes_by_level():
    rng = random.Random(2)
    for length in (1, 3, 8, 30):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 80))) for _ in range(12)]
        found, at = suffix.repeated_starts(texts, length), 0
        every = [t[i:i + length] for t in texts for i in range(len(t) - length + 1)]
        for t in texts:
            for i in range(len(t) - length + 1):
                assert found[at + i] == (every.count(t[i:i + length]) > 1)
            at += len(t) + 1


def vector_fixture():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(4):
        centre = rng.normal(size=16)
        rows += [(100 * c + i, (centre + rng.normal(size=16) * s).tolist()) for i, s in enumerate([0.1, 0.2, 0.3, 0.35, 0.4, 0.5] * 5)]
    rows += [(900, [0.0] * 16), (901, None), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, []),
             (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1.0, 2.0]), (909, [1e300] * 16), (910, [1e-300] * 16), (100, rows[30][1]), (911, [-x for x in rows[0][1]])]
    return rows


@pytest.mark.parametrize("block,cells", [(1024, 64), (5, 3)])
def test_vectors_equal_all_pairs(spark, block, cells):
    rows = vector_fixture()
    unit = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v) / np.abs(v).max()
            unit[i] = a / np.linalg.norm(a)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    component = connected({i for i, _ in rows}, links)
    n = {i: sum(i in e for e in links) for i, _ in rows}
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(None, rows[0][1], 1, "x")], "vec_id long, embedding array<double>, n long, v string")
    got = embeddings.near_vectors(docs, block=block, cells=cells, margin=None).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], component[r.vec_id], component[r.vec_id] == r.vec_id), r
    assert embeddings.near_vectors(docs.where("false")).count() == 0


def test_cells_find_nearly_all_links(spark):
    """Recall against brute force of the default margin: links per vector on clustered vectors with pairs near the limit."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 64))
    noise = rng.normal(size=(1200, 64)) * rng.choice([0.1, 0.2, 0.28], size=(1200, 1))
    x = np.repeat(base, 10, axis=0) + noise
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    real = (unit @ unit.T >= 0.95).sum() - len(x)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in embeddings.near_vectors(rows).collect())
    assert real > 1000 and 0.9 * real <= found <= real


@pytest.mark.parametrize("block", [1024, 16])
def test_default_finds_all_links_in_few_dimensions(spark, block):
    """Vectors of eight effective dimensions: many pairs lie across a border of cells and far from it on one side."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(600, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate((base, 0.952 * base + (1 - 0.952 ** 2) ** 0.5 * other)) @ np.linalg.qr(rng.normal(size=(64, 8)))[0].T
    real = x @ x.T >= 0.95
    np.fill_diagonal(real, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(real)) if a < b]
    component = connected(range(len(x)), links)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(rows, block=block).collect()}
    assert got == {i: (int(real[i].sum()), component[i]) for i in range(len(x))}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_leaks_equal_all_windows(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS[:60]) for _ in range(n))
    items = [(i, text(rng.choice((3, 9, 10, 11, 40)))) for i in range(12)] + [(20, None), (21, "..."), (22, "the the the the the the the the the the the"), (None, text(12)), (23, items_text := text(15)), (24, items_text)]
    rows = [(i, text(200)) for i in range(10)]
    rows += [(50 + n, f"{text(20)}; {t.upper().replace(' ', ', ')}! {text(5)}") for n, (_, t) in enumerate(items) if t]
    rows += [(90, None), (91, ""), (92, "the " * 3000), (93, items[5][1][:-3]), (94, items[4][1]), (94, items[4][1]), (None, items[4][1]), (None, "clean é"), (95, "x" * 100_000)]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(frame(spark, rows), benchmark).collect()), key=repr)
    expected = []
    for i, t in rows:
        ws = words(t)
        hit, seen = set(), set()
        for k, item in items:
            w = words(item)
            for size in [min(10, len(w))] if w else []:
                for at in range(len(w) - size + 1):
                    for j in range(len(ws) - size + 1):
                        if ws[j:j + size] == w[at:at + size]:
                            hit.update(range(j, j + size))
                            seen.update([str(k)] if k is not None else [])
        expected.append((i, len(ws), len(hit), tuple(sorted(seen)), bool(hit)))
    assert got == sorted(expected, key=repr)
    assert {r.contaminated for r in decontaminate.contamination(frame(spark, rows), benchmark.where("false")).collect()} == {False}
    assert decontaminate.contamination(frame(spark, []), benchmark).count() == 0


def test_leaks_report_proximity(spark):
    item = " ".join(f"q{i}" for i in range(10))
    docs = frame(spark, [(1, item), (2, " ".join(reversed(item.split()))), (3, "q0 " + "z " * 30 + "q1")])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 0)}


def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "https://example.com": "example.com",
            "https://u:p@example.com/A/": "example.com/A", "example.com/x?ref=1": "example.com/x", "https://example.com:8080/": "example.com:8080"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", warc.canonical_url(df.u).alias("c")).collect()} == urls


def record(kind, url, date, status, headers, body="", extra=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{extra}\r\nHTTP/1.1 {status}\r\n{headers}\r\n{body}"


@pytest.mark.parametrize("slot", [7 * 86400, 60])
def test_revisits(spark, slot):
    rows = [
        (1, record("response", "http://a.com/x", "2024-01-01T00:00:00Z", "200 OK", 'ETag: "one"\r\nX-Own: 1\r\nContent-Length: 3\r\n', "abc")),
        (2, record("response", "http://a.com/x", "2024-01-02T00:00:00Z", "200 OK", 'ETag: "two"\r\nContent-Length: 3\r\n', "abd")),
        (3, record("response", "http://a.com/x", "2024-01-03T00:00:00Z", "404 Not Found", 'ETag: "three"\r\n', "no")),
        (4, record("revisit", "https://a.com/x#f", "2024-01-01T00:00:05Z", "304 Not Modified", 'etag: W/"one"\r\nDate: now\r\nContent-Length: 0\r\nX-Own: 9\r\n')),
        (5, record("revisit", "http://a.com/x/", "2024-02-02T00:00:05Z", "304 Not Modified", 'ETag: "two"\r\n')),
        (6, record("revisit", "http://a.com/x", "2024-02-02T00:00:05Z", "304 Not Modified", 'ETag: "one"\r\n')),
        (7, record("revisit", "http://a.com/x", "2024-01-01T00:00:00Z", "304 Not Modified", 'ETag: "one"\r\n')),
        (8, record("revisit", "http://a.com/x", "2024-01-05T00:00:00Z", "304 Not Modified", "Date: d\r\n")),
        (9, record("revisit", "http://b.com/", "2024-01-05T00:00:00Z", "304 Not Modified", "")), (10, None), (11, "junk"),
        (12, "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n"),
        (13, record("response", "http://c.com/", "2024-01-01T00:00:00Z", "200 OK", 'ETag: "p"\r\n', "p")),
        (14, record("response", "http://c.com/", "2024-01-01T00:00:00Z", "200 OK", 'ETag: "q"\r\n', "q")),
        (15, record("revisit", "http://c.com/", "2024-01-01T00:00:01Z", "304 Not Modified", 'ETag: "q"\r\n')),
        (15, record("revisit", "http://c.com/", "2024-01-01T00:00:01Z", "304 Not Modified", 'ETag: "q"\r\n')),
        (16, record("revisit", "http://c.com/", "2024-01-01T00:00:01Z", "304 Not Modified", "", extra="WARC-Payload-Digest: sha256:other\r\n")),
    ]
    docs = spark.createDataFrame([(i, r, "t", "u") for i, r in rows], "record_id long, record string, type string, late string")
    got = {r.record_id: r for r in warc.resolve(warc.parse(docs), slot=slot).collect()}
    assert {i: (r.response_id, r.outcome) for i, r in got.items()} == {
        4: (1, "resolved"), 5: (2, "resolved"), 6: (2, "mismatch"), 7: (None, "missing"), 8: (2, "unverified"), 9: (None, "missing"), 12: (None, "missing"),
        15: (14, "resolved"), 16: (14, "mismatch")}
    assert {h.name: h.value for h in got[4]["headers"]} == {"etag": 'W/"one"', "date": "now", "content-length": "3", "x-own": "1"}
    assert got[4].digest == "sha256:" + hashlib.sha256(b"abc").hexdigest() and got[6]["headers"] is None
    assert warc.resolve(warc.parse(docs.where("false"))).count() == 0


def thue_morse(n):
    marks = "a"
    while len(marks) < n:
        marks += marks.translate(str.maketrans("ab", "ba"))
    return marks, marks.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 16, 32, 1024, 4096])
def test_words_that_cancel_out_in_sums_are_told_apart(spark, size):
    one, two = thue_morse(size)
    got = minhash.near_duplicates(frame(spark, [(1, f"one {one} two three four five"), (2, f"one {two} two three four five")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}
    items = spark.createDataFrame([(0, f"alpha {one} beta gamma")], "item_id long, text string")
    hits = decontaminate.contamination(frame(spark, [(1, f"x alpha {one} beta gamma y"), (2, f"x alpha {two} beta gamma y")]), items).collect()
    assert {r.doc_id: r.n_hit for r in hits} == {1: 4, 2: 0}


def test_word_hashes_fold_case_and_keep_lengths_apart():
    data = np.frombuffer("ab AB abc ab\0 Ünï ÜNÏ x123456789012345 X123456789012345 x1234567890123456 X1234567890123456".encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), minhash._word_bytes())
    h = word_hashes(data, starts, ends, 5).tolist()
    assert h[0] == h[1] and len({h[0], h[2], h[3]}) == 3 and h[4] != h[5] and h[6] == h[7] and h[8] == h[9] and h[6] != h[8]


def test_ids_of_other_types(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("z", "something else here at all"), (None, "one two three four five six"), ("e", None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id string, text string, component_id string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "z": ("z", True), None: (None, True), "e": ("e", True)}
    items = spark.createDataFrame([("i", "one two three four five six")], "item_id string, text string")
    assert {(r.doc_id, r.contaminated) for r in decontaminate.contamination(docs, items).collect()} == {("a", True), ("b", True), ("z", False), (None, True), ("e", False)}
    assert {r.doc_id for r in suffix.without_repeats(docs).collect()} == {"a", "b", "z", None, "e"}
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id string, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(vectors).collect()} == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c"), None: (0, None)}


def test_copies_without_an_id_are_judged_once_each(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog today")], "item_id long, text string")
    docs = frame(spark, [(None, "say the quick brown fox jumps over a lazy dog today twice")] * 300 + [(None, "nothing of it"), (5, None)])
    got = decontaminate.contamination(docs, items).groupBy("doc_id", "n_hit").count().collect()
    assert {(r.doc_id, r.n_hit, r["count"]) for r in got} == {(None, 10, 300), (None, 0, 1), (5, 0, 1)}
