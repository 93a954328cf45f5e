"""Quality, vector codes and ranked search against loops over small tables and the given ones."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html_text, quality, ranked_search, tables, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
DATA = Path("/root/testdata")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- quality


def plain_statistics(text):
    words = PLAIN.findall(text or "")
    size = len((text or "").encode())
    pairs = list(zip(words[:-1], words[1:], strict=True))
    share = lambda part, whole: part / whole if whole else 0.0
    most = lambda x: max(collections.Counter(x).values(), default=0)
    data = (text or "").encode()
    punct = lambda b: 32 < b < 127 and not chr(b).isalnum()
    lengths = [len(w.encode()) for w in words]
    lines = [x for x in (PLAIN.findall(line) for line in (text or "").split("\n")) if x]
    ends = [w.encode()[-1] for w in words]
    return {
        "log_words": math.log1p(len(words)), "mean_word": share(sum(lengths), len(words)), "log_longest": math.log1p(max(lengths, default=0)),
        "upper": share(sum(65 <= b <= 90 for b in data), size), "punctuation": share(sum(map(punct, data)), size), "wide": share(sum(b > 127 for b in data), size),
        "distinct_words": share(len(set(words)), len(words)), "top_word": share(most(words), len(words)), "same_as_before": share(sum(a == b for a, b in pairs), len(pairs)),
        "distinct_pairs": share(len(set(pairs)), len(pairs)), "top_pair": share(most(pairs), len(pairs)), "bare_punctuation": share(sum(all(map(punct, w.encode())) for w in words), len(words)),
        "sentence_ends": share(sum(b in b".,;:?!" for b in ends), len(words)), "odd_ends": share(sum(punct(b) and b not in b".,;:?!" for b in ends), len(words)),
        "log_lines": math.log1p(len(lines)), "distinct_lines": share(len({tuple(x) for x in lines}), len(lines)), "words_a_line": share(len(words), len(lines)),
    }


def test_statistics_equal_loops():
    texts = [None, "", "  \n ", "A b! b! C|| a\na B.\nA b! b!", "É é é*** x\n\nx\n1 2 3", "w " * 30_000 + "end", "\t:\t|\t."]
    got = quality.statistics_of([t.encode() if t else t for t in texts])
    for row, text in zip(got, texts, strict=True):
        for name, value in plain_statistics(text).items():
            assert row[quality.NAMES.index(name)] == pytest.approx(value), (name, text and text[:20])
    assert not got[:2].any() and np.isfinite(got).all() and quality.statistics_of([]).shape == (0, len(quality.NAMES))


def plain_trees(x, y, trees, depth, bins):
    """The same boosting, a node at a time with loops over rows."""
    cuts = quality.cuts_of(x, bins)
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(x), math.log(p0 / (1 - p0)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        groups = [np.arange(len(x))]
        for _ in range(depth):
            ahead = []
            for rows in groups:
                score = lambda some: sum(g[some]) ** 2 / (sum(h[some]) + quality.L2)
                best, choice = 1e-9, None
                for f, own in enumerate(cuts):
                    for c in own:
                        below, above = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                        if sum(h[below]) < quality.LEAST or sum(h[above]) < quality.LEAST:
                            continue
                        gain = score(below) + score(above) - score(rows)
                        if gain > best + 1e-12:
                            best, choice = gain, (below, above)
                ahead += choice or (rows, rows[:0])
            groups = ahead
        for rows in groups:
            if len(rows):
                margin[rows] += -quality.RATE * sum(g[rows]) / (sum(h[rows]) + quality.L2)
    return 1 / (1 + np.exp(-margin))


def test_trees_equal_loops():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    got = quality.grow(x, y, trees=4, depth=2, bins=8)
    assert got.predict(x) == pytest.approx(plain_trees(x, y, 4, 2, 8), abs=1e-9)
    assert ((quality.grow(x, y).predict(x) > 0.5) == (y > 0.5)).mean() > 0.95
    one = quality.grow(np.zeros((5, 2)), np.ones(5))
    assert one.predict(np.zeros((2, 2))).min() > 0.99 and one.predict(np.zeros((0, 2))).shape == (0,)


def test_quality_on_held_out_rows_of_the_given_tables(spark):
    got = quality.op11_quality(spark, str(DATA / "sf0.1")).join(spark.read.parquet(str(DATA / "sf0.1" / "labels.parquet")), "doc_id").toPandas()
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (held == got.held_out).all() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    rest = got[held]
    assert (rest[rest.quality == 0].predicted == 0).mean() > 0.95 and (rest[rest.quality == 1].predicted == 1).mean() > 0.99


def test_quality_of_odd_rows(spark, monkeypatch):
    rows = [(k, f"good words stand here {k} and {k * 7}" if k % 2 else f"bad!! bad!! bad!! {k}!!", 0.5, "a", None) for k in range(60)]
    rows += [(None, "no id", None, None, None), (3, None, None, None, None), (3, None, None, None, None), (5, "", 1.0, "b", 2), (61, "x " * 60_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string, statistics int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (7, None), (8, 0), (8, 0)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    got = quality.score(docs, forest).collect()
    assert len(got) == len(rows) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3 and r["text"] is None}) == 1
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and r["text"]]) > 0.9
    none = docs.limit(0)
    assert quality.score(none, forest).count() == 0 and quality.statistics(none).count() == 0
    blank = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r["score"] for r in blank} == {0.5}
    # the bound holds for rows, however often a labelled id stands there
    many = docs.union(docs).union(docs)
    assert quality.fit(many, labels, sample=10).feature.shape == (quality.TREES, 2**quality.DEPTH - 1)


# ---- vector codes


def plain_codes(vectors, entries, parts, rounds):
    """(codes, errors, codebooks) by full searches; vectors: integer lists in order of their ids."""
    x = [list(map(int, v)) for v in vectors]
    ends = vector_codes.bounds_of(len(x[0]), parts)
    cut = lambda v, k: v[ends[k] : ends[k + 1]]
    books = [[cut(v, k) for v in x[:entries]] for k in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            own = [near(cut(v, k), books[k])[1] for v in x]
            for j in range(len(books[k])):
                some = [cut(v, k) for v, o in zip(x, own, strict=True) if o == j]
                if some:
                    books[k][j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    found = [[near(cut(v, k), books[k]) for k in range(parts)] for v in x]
    return [[j for _, j in f] for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize(("seed", "length", "entries", "parts", "rounds"), [(1, 8, 5, 4, 2), (2, 7, 4, 3, 3), (3, 4, 16, 2, 2), (4, 6, 1, 3, 2)])
def test_vector_codes_equal_full_searches(spark, seed, length, entries, parts, rounds):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, length)) * 2
    raw = np.float32(centres[rng.integers(6, size=120)] + rng.normal(size=(120, length)) * 0.3)
    raw[10:14] = raw[9]  # equal vectors, so equal entries
    rows = [(int(i), [float(v) for v in row], int(i) % 3) for i, row in enumerate(raw)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got, books = vector_codes.compress(df, entries=entries, parts=parts, rounds=rounds)
    got = {r["vec_id"]: r for r in got.collect()}
    codes, errors, want = plain_codes(np.floor(raw.astype(float) * 256).astype(int), entries, parts, rounds)
    assert [b.tolist() for b in books] == want
    assert [got[i]["codes"] for i in range(120)] == codes and [got[i]["error"] for i in range(120)] == errors
    assert got[0]["code"] == "".join(f"{c:02x}" for c in codes[0])
    assert sum(r["scans"] for r in got.values()) < 120 * parts * (rounds + 1)  # bounds spare searches


def test_hamerly_keeps_ties_to_the_lower_index():
    entries = np.array([[0], [10], [10], [25]])
    book = vector_codes.Codebook(entries)
    parts = np.array([[5], [10], [17], [18], [-3], [200]])
    code, upper, lower = book.search(parts)
    assert code.tolist() == [0, 1, 1, 3, 0, 3]
    assert (upper >= np.abs(parts[:, 0] - entries[code, 0]) * 256).all()
    rng = np.random.default_rng(0)
    parts, book = rng.integers(-60, 60, (500, 3)), vector_codes.Codebook(rng.integers(-60, 60, (9, 3)))
    code, upper, lower = book.search(parts)
    skipped = 0
    for _ in range(5):
        new = book.entries + rng.integers(-2, 3, book.entries.shape) * (rng.random((9, 1)) < 0.5)
        book = vector_codes.Codebook(new, book.entries)
        code, upper, lower, searched = book.assign(parts, code, upper, lower)
        skipped += len(parts) - len(searched)
        assert (code == book.search(parts)[0]).all()
    assert skipped > 500


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0], None), (5, [1.0, 2.0], None), (7, None, 1), (8, [None, 1.0], 1), (9, [nan, 1.0], 1), (10, [1.0, -inf], 1), (11, [1e30, 1.0], 1), (2, [0.5, -0.001], 1), (None, [3.0, 3.0], 2), (12, [1.0], 2), (13, [], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, ints int")
    got, books = vector_codes.compress(df, entries=2, parts=2)
    kept = sorted(((r["vec_id"] or -1, r["code"], r["error"]) for r in got.collect()), key=str)
    assert [k[0] for k in kept] == [-1, 12, 13, 2, 5, 5] and {k[1] for k in kept if k[0] in (12, 13)} == {None}
    assert books[1][0].tolist() == [-1]  # -0.001 goes down
    sums = {r["label"]: r["s"] for r in vector_codes.with_group_sum(got, "label", "error", "s").collect()}
    assert set(sums) == {None, 1, 2}
    empty, none = vector_codes.compress(df.limit(0))
    assert empty.count() == 0 and none == [] and {"code", "codes", "error", "scans"} <= set(empty.columns)
    wide = vector_codes.with_group_sum(got.select("label", F.lit(1).alias("one")), "label", "one", "n")
    assert {r["label"]: r["n"] for r in wide.collect()} == {None: 2, 1: 1, 2: 3}


# ---- ranked search


def plain_ranks(docs, items, top):
    counts = [(i, collections.Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    some = [c for _, c in counts if c]
    n, total = len(some), sum(sum(c.values()) for c in some)
    df = collections.Counter(t for c in some for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // max(total, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in collections.Counter(TERM.findall(lower(text or ""))).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "top", "seeds", "per_round"), [(64, 10, 8, 2000), (3, 4, 1, 5), (1, 2, 2, 1)])
def test_ranked_search_equals_loops(spark, block, top, seeds, per_round):
    rng = np.random.default_rng(3)
    say = lambda n, k: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % k)
    docs = [(i, say(int(rng.integers(1, 60)), 90)) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " !! "), (None, docs[3][1]), (3, docs[3][1]), (204, docs[3][1]), (203, "W1 w1, w2; Ünder-Ähre " * 5_000), (205, "W5 É é")]
    items = [(k, say(int(rng.integers(1, 12)), 90)) for k in range(12)] + [(50, None), (51, "nowhere"), (52, "w1 w1 w1 W2"), (None, "w5 é"), (3, docs[3][1]), (3, docs[3][1]), (53, docs[3][1])]
    made = ranked_search.build(spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "tf": F.lit("x")}).repartition(3), block)
    got = ranked_search.search(made, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)), top, seeds, per_round)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == plain_ranks(docs, items, top)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ranked_search.search(ranked_search.build(none), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert ranked_search.search(made, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_ranges_below_the_threshold_are_not_scored(spark, monkeypatch):
    docs = [(k, "common filler words") for k in range(300)] + [(1000 + k, "rare gem " + "x" * k) for k in range(10)]
    made = ranked_search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 10)
    queries = ranked_search.Queries([b"rare gem filler"])
    queries.weigh(ranked_search._document_counts(made, queries), made.documents)
    queries.threshold = ranked_search._seeded(made, queries, ranked_search._seeds(made, queries, 2), 10)
    rows = made.ranges.collect()
    bounds = [queries.bounds(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["maxima"], np.uint32))[0] for r in rows]
    assert len(rows) == 31 and sum(b >= queries.threshold[0] for b in bounds) == 1


def test_kept_vectors_digest():
    books = [np.array([[1, -2], [3, 4]]), np.array([[5, 6], [7, 8]])]
    assert vector_codes.digest(books) == hashlib.sha256(b"1,-2,3,4,5,6,7,8").hexdigest()


# ---- pages


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_main_text_of_every_given_page(spark, sf):
    """The given pages have one article each; what it holds, and no more, is main text."""
    path = str(DATA / sf)
    got = {r["page_id"]: r for r in html_text.op10_html_text(spark, path).collect()}
    rows = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "html").collect()
    assert len(rows) == len(got)
    for r in rows:
        want = "\n".join(leaf.text for leaf in html_text.leaves(r["html"] or "") if "article" in leaf.path)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want)), r["page_id"]


def test_weights_are_learnt_once_for_a_folder(spark, monkeypatch):
    first = html_text.weights(spark)
    monkeypatch.setattr(html_text, "trained", lambda *a: pytest.fail("learnt again"))
    again = html_text.weights(spark)
    assert set(first) == set(again) and all((first[k] == again[k]).all() for k in first)
    assert tables.shared_dir(spark)
