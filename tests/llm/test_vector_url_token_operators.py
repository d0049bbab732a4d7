"""URL filters, whitening and cross-tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflens.llm import align, queries, urls, whiten
from shelflens.session import materialize

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


# --- alignment


def plain_links(a, b):
    """All overlapping token pairs and the common ends, by comparing every pair."""
    spans = lambda ends: list(zip([0, *ends[:-1]], ends))
    return {(i, j) for i, (lo, hi) in enumerate(spans(a)) for j, (x, y) in enumerate(spans(b)) if lo < y and x < hi}, sorted(set(a) & set(b))


@pytest.mark.parametrize("seed", range(60))
def test_runs_and_links_equal_all_pairs(seed):
    rnd = random.Random(seed)
    size = rnd.choice([1, 2, 5, 30, 120])
    shared = set(rnd.sample(range(1, size + 1), rnd.randint(0, size))) if seed % 3 else set(range(1, size + 1))
    a, b = (sorted(shared | {size} | set(rnd.sample(range(1, size + 1), rnd.randint(0, size // 4)))) for _ in "ab")
    runs, odd_a, odd_b = align.align(a, b)
    links = [(i + k, j + k) for i, j, n in runs for k in range(n)] + list(zip(odd_a, odd_b))
    expected, cuts = plain_links(a, b)
    assert len(links) == len(set(links)) and set(links) == expected
    assert sum(n for *_, n in runs) + len(runs) - 1 == len(cuts)


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = align._byte_alphabet()
    found, counts = [], Counter()
    for id, text in rows:
        wanted = (" " + text).encode() if text else None
        if wanted is not None:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if wanted is None or b"".join(a_bytes) != wanted or b"".join(b_bytes) != wanted:
            found.append((id, None))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        links, cuts = plain_links(*ends)
        i = j = 0
        groups = []
        for cut in cuts:
            x, y = bisect_right(ends[0], cut), bisect_right(ends[1], cut)
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        found.append((id, (len(a), len(b), groups, pairs)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for id, one in found:
        if one is None:
            out.append((id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = one
            out.append((id, n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, best


TEXTS = ["Hello world", "", None, "ünïcödé 😀 text ", "   spaces\n\n\tand tabs  ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "same text here", "same text here",
         "漢字かな交じり文 العربية", "x" * 3000, "nul \x00 and \u200b zero width", "internationalization antidisestablishmentarianism " * 40, "e\u0301 ﬁ ½", " lead",
         "\ufeffbom"]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark):
    rows = [(str(i) if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "mine", 7, 8) for i, t in rows], "doc_id string, text string, unit string, place int, pairs int").repartition(3)
    expected, counts, best = plain_alignment(rows)
    for unit_links in (1, align.UNIT_LINKS):
        got = align.alignments(docs, A, B, unit_links=unit_links)
        assert got.columns == ["doc_id", *COLUMNS]
        assert Counter(tuple(r) for r in got.collect()) == Counter(expected)
    assert [e[1:] for e in expected if e[0] == "6"] == [(0, 0, 0, 0, 0, 0, "")]  # U+2581 reads as a space
    pairs = {(r.a_id, r.b_id): (r["count"], r.best) for r in align.pair_counts(docs, A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    for r in align.token_groups(docs, A, B).where("doc_id is not null").collect():
        groups, i, j = [], 0, 0
        for n, m in zip(r.a_sizes, r.b_sizes):
            groups.append(",".join(map(str, r.a_ids[i:i + n])) + "|" + ",".join(map(str, r.b_ids[j:j + m])))
            i, j = i + n, j + m
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert digest == next(e[-1] for e in expected if e[0] == r.doc_id)


def test_alignment_of_bytes_that_are_no_text_and_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ok \xff")), (2, bytearray(b"fine"))], "doc_id long, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text"))
    got = {r.doc_id: r.n_a for r in align.alignments(docs, A, B).collect()}
    assert got[1] == 0 and got[2] > 0
    empty = align.alignments(docs.limit(0), A, B)
    assert empty.collect() == [] and empty.schema["doc_id"].dataType.simpleString() == "bigint"
    nothing = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert {tuple(r) for r in align.alignments(nothing, A, B).collect()} == {(1, 0, 0, 0, 0, 0, 0, "")}


def test_alignment_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in align.alignments(docs, A, B).collect()) == sorted(plain_alignment(rows)[0])
    assert queries.QUERIES["op13_cross_tokenizer_alignment"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id string, embedding array<double>, n int, dim int, whitened string, component string").repartition(3)


def plain_whitening(rows, wanted=8):
    """n, deviations and whitened rows of vectors of one length, in exact fractions up to numpy's eigenvectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(c * n - s) / n for c, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, e[::-1][:wanted], v[:, ::-1][:, :wanted], e.sum()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    spread = np.array([3, 2, 1.5, 1.1, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1])
    good = [[float(c) for c in r] for r in rng.normal(size=(300, 10)) * spread]
    bad = [None, [1.0, None] + [0.0] * 8, [math.nan] * 10, [math.inf] + [0.0] * 9]
    rows = [(str(i) if i else None, v, 1, 2, "x", "y") for i, v in enumerate(good)] + [("bad", v, 1, 2, "x", "y") for v in bad]
    rows += [("three", [float(c) for c in r], 1, 2, "x", "y") for r in rng.normal(size=(9, 3))] + [("one", [1.0, 2.0, 3.0, 4.0], 1, 2, "x", "y"), ("none", [], 1, 2, "x", "y")]
    got = whiten.whiten(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 300 * 8 + 9 * 3
    n, deviation, centred, e, v, trace = plain_whitening(good)
    for c in range(8):
        mine = {r.vec_id: r for r in got if r.component == c + 1 and r.vec_id != "three"}
        expected = centred @ v[:, c] / math.sqrt(e[c])
        found = np.array([mine[str(i) if i else None].whitened for i in range(n)])
        assert min(np.abs(found - expected).max(), np.abs(found + expected).max()) < 1e-9
        assert all(abs(r.explained - e[c] / trace) < 1e-12 and r.n == n and r.identity_error < 1e-12 for r in mine.values())
        assert [int(mine[str(i) if i else None].deviation) for i in range(n)] == deviation
    three = [r for r in got if r.vec_id == "three"]
    assert {r.n for r in three} == {9} and abs(sum(r.explained for r in three if r.component < 4) / 9 - 1) < 1e-12


def test_whitening_of_huge_equal_and_missing_vectors(spark):
    huge = [[1e30, 2.0], [-1e30, 5.0], [3e18, -7.5], [1e9, 1e9]]
    got = whiten.whiten(vectors(spark, [(str(i), v, 0, 0, "", "") for i, v in enumerate(huge)])).collect()
    first = {r.vec_id: r for r in got if r.component == 1}
    expected = plain_whitening(huge)[1]
    assert len(got) == 8 and all(r.identity_error < 1e-9 for r in got)
    assert [first[str(i)].deviation for i in range(4)] == [Decimal(v) if v < 10 ** 38 else None for v in expected]
    assert whiten.whiten(vectors(spark, [("a", [1.0, 2.0], 0, 0, "", "")] * 3)).collect() == []
    empty = whiten.whiten(vectors(spark, [("a", None, 0, 0, "", "")]))
    assert empty.collect() == [] and empty.columns == whiten.whiten(vectors(spark, [])).columns


def test_polynomial_and_roots_are_exact():
    rng = np.random.default_rng(1)
    for d in (1, 2, 4, 7):
        x = rng.integers(-50, 50, size=(d + 3, d)).astype(object)
        if d == 7:
            x[:, 6] = x[:, 5]  # a rank less
            x[:, 1] = 0  # zero pivots
        m = x.T @ x
        primes = whiten._primes(0)
        got = whiten.remainders(primes, whiten.hessenberg_polynomials(m, primes).tolist())
        # Faddeev and LeVerrier in exact integers
        c, k = [1], np.zeros((d, d), object)
        for i in range(1, d + 1):
            k = m @ k + c[-1] * np.eye(d, dtype=int).astype(object)
            c.append(-sum((m @ k)[j, j] for j in range(d)) // i)
        assert got == c[::-1]
        above = sorted(np.linalg.eigvalsh(m.astype(float)))[::-1]
        roots = whiten.top_roots(got, int(sum(m[i, i] for i in range(d))), 8)
        assert np.allclose([r / 2 ** s for r, s, _ in roots], above[:len(roots)])
    twins = np.diag([9, 9, 4, 0, 9]).astype(object)
    polynomial = whiten.remainders(primes, whiten.hessenberg_polynomials(twins, primes).tolist())
    found = whiten.principal(twins, polynomial, 8)
    basis = np.array([[float(v) for v in x] for _, x in found])
    assert [float(e) for e, _ in found] == [9, 9, 9, 4] and np.allclose(basis @ basis.T, np.eye(4)) and np.allclose(basis @ twins.astype(float), basis * [[9], [9], [9], [4]])


# --- URLs

URLS = [None, "", "no scheme", "://x.com/a", "http://COM/", "https://Example.com/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/1?x=1&y=2#f",
        "http://m.example.com/en", "http://other.org/en/1", "http://x.net/es/", "http://x.net/fr/2", "http://x.net/de/2", "http://xcom/", "http://com", "http://example.com?x://y.com/",
        "http://a.b/é😀?q", "http://x.com:80/a", "http://u@x.net/es/1", "http://x.com/" + "a/b1" * 30_000, "http://x.com/a\nb?c", "ftp://y.org//..//", "http://x.com/a", "http://x.com/a"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    fit = [(n + p, v) for v, n, p in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(fit, key=lambda f: len(f[0]), default=(None, None))


def plain_features(url, host, path):
    url = url or ""
    query = re.search(r"(?s)^[^?#]*\?([^#]*)", url)
    bits = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
    count = lambda t, p: len(re.findall(p, t))
    return [len(url), len(host), len(path), count(path, "[^/]+"), count(host, r"[^.]+"), count(url, "[0-9]") / len(url) if url else 0, count(host, "[0-9]"), count(path, "[0-9]"),
            count(url, "-"), bits(url) if url else 0, bits(host) if host else 0, count(query.group(1), "[^&]+") if query else 0, "#" in url, path.endswith("/"), url.startswith("https:")]


def walk(node, features):
    while hasattr(node, "leftChild"):
        split = node.split()
        node = node.leftChild() if features[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def tree_values(model, features):
    """The boosted sum for each row of features, by walking the trees' descriptions."""
    total = np.zeros(len(features))
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [(len(line) - len(line.lstrip()), line.strip()) for line in tree.toDebugString.splitlines()[1:]]
        for k, row in enumerate(features):
            at = 0
            while not lines[at][1].startswith("Predict"):
                depth, text = lines[at]
                feature, threshold = re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", text).groups()
                if row[int(feature)] <= float(threshold):
                    at += 1
                else:
                    at = next(i for i in range(at + 1, len(lines)) if lines[i][0] == depth) + 1
            total[k] += weight * float(lines[at][1].split(":")[1])
    return total


def test_url_parts_rules_and_features_equal_plain_python(spark):
    pages = spark.createDataFrame([(str(i), u, "h", "v", "s") for i, u in enumerate(URLS)], "page_id string, url string, host string, verdict string, score string")
    rows = urls.read_urls(pages)
    for r in rows.select("*", *[c.alias(n) for n, c in urls.lexical_features(F.col("url"), F.col("host"), F.col("path")).items()]).collect():
        url = URLS[int(r.id)]
        host, path = plain_parts(url)
        assert (r.host, r.path) == (host, path) and (r.rule, r.verdict) == plain_rule(host, path), url and url[:60]
        assert np.allclose([r[n] for n in urls.lexical_features(F.lit(""), F.lit(""), F.lit(""))], plain_features(url, host, path)), url and url[:60]
    got = urls.judge(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    got = got.collect()
    assert len(got) == len(URLS) and {r.verdict for r in got} <= {"allow", "block"}
    assert all(r.verdict == plain_rule(*plain_parts(URLS[int(r.page_id)]))[1] for r in got if r.rule)


def test_url_verdicts_equal_walked_trees(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = urls._suffixes(urls.read_urls(pages))
    statistics = materialize(urls.suffix_statistics(rows), "statistics")
    model = urls.learn(rows, statistics)
    found = queries.QUERIES["op11_url_filter"](spark, folder).collect()
    assert len(found) == pages.count()
    plain = [(r.page_id, r.url, *plain_parts(r.url)) for r in pages.collect()]
    near = lambda h: ".".join(h.split(".")[-2:])
    labelled = [(h, plain_rule(h, p)[1]) for _, _, h, p in plain]
    features = []
    for _, url, h, p in plain:
        shares = []
        share = 0.5
        for suffix in (lambda x: x.split(".")[-1], near):
            own = [v for x, v in labelled if suffix(x) == suffix(h)]
            known = [v for v in own if v]
            share = (known.count("block") + urls.SMOOTHING * share) / (len(known) + urls.SMOOTHING)
            shares += [math.log1p(len(own)), share]
        features.append(plain_features(url, h, p) + shares)
    values = dict(zip([i for i, *_ in plain], 1 / (1 + np.exp(-2 * tree_values(model, features)))))
    for r in found:
        assert abs(r.score - values[r.page_id]) < 1e-6
        assert r.verdict == (plain_rule(r.host, r.path)[1] or ("block" if r.score > 0.5 else "allow"))
    right = [(r.score > 0.5) == (r.verdict == "block") for r in found if r.rule]
    assert np.mean(right) > 0.9  # 121 labelled URLs


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.rule) for r in urls.judge(pages).collect()} == {(1, "allow", None), (2, "allow", None)}
    one = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.net/es/")], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in urls.judge(one).collect()} == {(1, "block"), (2, "block")}
    assert urls.judge(pages.limit(0)).collect() == []
