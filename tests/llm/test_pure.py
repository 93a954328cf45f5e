"""Parts of the operators that need no Spark."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import html_text, jaccard_join, mixing, pitman_yor, substring_dedup, tiff, token_files, toxicity
from plumbline.llm.words import ALNUM, PLAIN, Words, by_bytes, gram_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern_and_equal_words_have_equal_hashes():
    texts = ["a bb\ta\x0b bb ", "", None, "née\x00x  née\x00x", "x" * 70_000 + " y"]
    w = Words([t.encode() if t else t for t in texts], PLAIN)
    got = [w.buf[s:e].decode() for s, e in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    by = collections.defaultdict(set)
    for x, h in zip(got, w.hashes.tolist()):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    assert Words([b"The Cat"], ALNUM).hashes.tolist() == Words([b"the-CAT"], ALNUM).hashes.tolist()


@pytest.mark.parametrize("seed", range(12))
def test_fm_index_finds_windows_that_stand_elsewhere(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 9))
    texts = sorted({b" ".join(b"w%d" % rng.integers(0, 3) for _ in range(int(rng.integers(size, 40)))) for _ in range(10)})
    weights = rng.integers(1, 3, len(texts))
    seen = collections.Counter()
    for t, k in zip(texts, weights.tolist()):
        x = t.split()
        for i in range(len(x) - size + 1):
            seen[tuple(x[i : i + size])] += k
    for t, found in zip(texts, substring_dedup.repeated_windows(texts, weights, size)):
        x = t.split()
        assert found.tolist() == [seen[tuple(x[i : i + size])] > 1 for i in range(len(x) - size + 1)]


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 500)
    w = substring_dedup.WaveletMatrix(seq, 36)
    sym, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert w.rank(sym, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(sym, at)]


def test_addressable_codes_give_any_token():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 300, 2000), rng.integers(0, 2**31, 500), np.zeros(3, np.int64)])
    rng.shuffle(ids)
    counts = np.array([0, 1500, 1003])
    file = token_files.TokenFile(token_files.pack([5, None, 7], counts, ids))
    assert file.doc_ids == [5, None, 7] and (file.all() == ids).all()
    places = rng.integers(0, len(ids), 400)
    assert (file.tokens(places) == ids[places]).all()
    assert file.document(2).tolist() == ids[1500:].tolist()
    empty = token_files.TokenFile(token_files.pack([], np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not len(empty.all())


@pytest.mark.parametrize("ordinary", [False, True])
def test_encoder_equals_the_tokenizer(ordinary):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(path), token_files.Encoder(path, ordinary)
    if ordinary:
        plain.encode_special_tokens = True
    texts = ["a  b", " a b ", "  two", "a\n b", "", "x\u3000 z", "x \u00a0y \u2003z \u0085 q", "\x1c a\x1d b", "ok's, 1.5, x% <|endoftext|>. z", "<|endoftext|>", "foo. foo.. foo! foo", "a,,, b.x y\u0969. \u00b2!"]
    texts += ["don't 'S we'll 've", "\tx\ty \r\n\x7f\x00 ", "\u00e9t\u00e9 \u4f60\u597d " + "long" * 30 + " " + "long" * 30, "\u201cq\u201d \u2014 w", "z" * 16 + " " + "z" * 17, "12ab34 _x_ a1"]
    ids, counts = e.encode([t.encode() for t in texts])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@given(st.lists(st.text(alphabet="ab1.' \n\u00e9\u2003\u00a0\x1c", max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_tokenizer_on_any_text(texts):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    e = token_files.Encoder.of(path)
    ids, _ = e.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in e.tokenizer.encode(t, add_special_tokens=False).ids]


def test_encoder_forgets_and_stays_right(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "MEMORY", 50)
    e, rng = token_files.Encoder(path), random.Random(3)
    for _ in range(12):
        texts = [" ".join(f"w{rng.randrange(200)}" + "q" * (rng.randrange(2) * 20) for _ in range(40)) for _ in range(3)]
        ids, _ = e.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in e.tokenizer.encode(t, add_special_tokens=False).ids]


def test_encoder_tells_stretches_of_one_hash_apart(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "mix", lambda h: h & np.uint64(1))
    e = token_files.Encoder(path)
    for text in ("a b c d e f", "f e d cc b a", "g a"):
        assert e.encode([text.encode()])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_gives_new_plain_words_to_the_library_at_once(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    e = token_files.Encoder(path)

    def alone(text):
        raise AssertionError(f"one by one: {text!r}")

    monkeypatch.setattr(e, "_ids", alone)
    texts = ["Uno deux, 3rd.\nViert \u00e9t\u00e9s\u00b2 \u00abq\u00bb a\u00d7b 12%", "", " \u00fcber" + "lang" * 9 + " x\n", "\nuno"]
    ids, counts = e.encode([t.encode() for t in texts])
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_encoder_equals_the_tokenizer_for_every_latin_character():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    e = token_files.Encoder(path)
    texts = [t.format(chr(c)) for c in range(0x2A0) for t in ("a{0}b", " {0}1 x{0} {0}.", "{0}{0}\n{0}a", "\n {0}\n", "7{0}\n.")]
    ids, counts = e.encode([t.encode() for t in texts])
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("coding", [tiff.STORED, *tiff.CODINGS])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [False, True])
def test_tiff_round_trip(coding, tiled, predictor):
    rng = random.Random(4)
    for raw in (b"", b"a" * 192, b"ab" * 3000, bytes(rng.randrange(256) for _ in range(9000)), b"x" * 220_000, "née ".encode() * 2000):
        payload = tiff.payload_of(raw)
        pages = tiff.read_pages(tiff.write_tiff(payload, coding, tiled, predictor))
        assert not any(p.error for p in pages) and b"".join(p.pixels for p in pages) == payload


def test_tiff_reads_big_endian_sixteen_bit_planes_and_survives_rubbish():
    import struct

    def entry(tag, kind, count, value):
        return struct.pack(">HHI", tag, kind, count) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))

    data = struct.pack(">4H", 1, 2, 3, 4)
    tags = [entry(256, 3, 1, 2), entry(257, 3, 1, 2), entry(258, 3, 1, 16), entry(259, 3, 1, 1), entry(273, 4, 1, 8), entry(277, 3, 1, 1), entry(278, 3, 1, 2), entry(279, 4, 1, 8), entry(317, 3, 1, 2)]
    body = b"MM\0*" + struct.pack(">I", 16) + data + struct.pack(">H", len(tags)) + b"".join(tags) + struct.pack(">I", 16)
    (page,) = tiff.read_pages(body)  # the directory's link to itself ends the walk
    assert page.error is None and np.frombuffer(page.pixels, np.uint16).tolist() == [1, 3, 3, 7]
    for bad in (None, b"", b"II*\0", body[:30], b"II*\0\xff\xff\xff\x7f"):
        assert tiff.read_pages(bad)[0].error


def test_tiff_pages_after_a_bad_one_and_of_one_bit():
    import struct

    payload = tiff.payload_of(bytes(range(256)) * 3000)
    data = bytearray(tiff.write_tiff(payload, tiff.STORED, False, False))
    whole = tiff.read_pages(bytes(data))
    assert len(whole) >= 3
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    coding = next(at + 2 + 12 * k for k in range(n) if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == 259)
    struct.pack_into("<H", data, coding + 8, 99)
    pages = tiff.read_pages(bytes(data))
    assert pages[0].error and [p.pixels for p in pages[1:]] == [p.pixels for p in whole[1:]] and not any(p.error for p in pages[1:])
    struct.pack_into("<H", data, coding + 2, 12)  # of a type that is no number here, and strips that are missing
    assert len(tiff.read_pages(bytes(data))) == len(whole)

    def entry(tag, value):
        return struct.pack("<HHII", tag, 4, 1, value)

    packed = bytes([1, 0b10110000, 0b01000000, 1, 0b00001111, 0b11000000])  # ten samples a row
    tags = [entry(256, 10), entry(257, 2), entry(259, tiff.PACKBITS), entry(273, 8), entry(278, 2), entry(279, 6)]
    (page,) = tiff.read_pages(b"II*\0" + struct.pack("<I", 14) + packed + struct.pack("<H", len(tags)) + b"".join(tags) + bytes(4))
    assert page.error is None and page.bits == 1 and list(page.pixels) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1]


def test_lzw_over_many_tables():
    rng = random.Random(5)
    for n in (0, 1, 300, 5000, 60_000):
        raw = bytes(rng.randrange(1 + n % 250) for _ in range(n))
        assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def test_subset_comes_nearest():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 40, 6))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        take = mixing.subset(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        assert got <= budget
    take = mixing.subset(np.array([3, 5]), np.array([4, 4]), 11)
    assert int((take * [3, 5]).sum()) == 11


def test_subset_of_long_documents_comes_nearest():
    assert mixing.subset(np.array([35000, 35001, 40000]), np.array([1, 1, 1]), 70001).tolist() == [1, 1, 0]
    rng = np.random.default_rng(12)
    for trial in range(60):
        lengths = np.unique(rng.integers(1, 60_000 if trial % 2 else 60, 6))
        counts = rng.integers(1, 4, len(lengths))
        sums = {0}
        for n, k in zip(lengths.tolist(), counts.tolist()):
            sums = {x + n * j for x in sums for j in range(k + 1)}
        budget = int(rng.integers(0, max(sums)))
        take = mixing.subset(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == max(x for x in sums if x <= budget)
    counts = np.full(3, 100_000)  # large budgets that shares nearly meet
    take = mixing.subset(np.array([50, 777, 1501]), counts, int(counts[0]) * 2328 - 7)
    assert int((take * [50, 777, 1501]).sum()) == int(counts[0]) * 2328 - 50


def test_targets_reshare_the_excess():
    out = mixing.targets([("b", 100), (None, 100), ("a", 1000)])
    assert list(out.values()) and sum(out.values()) == pytest.approx(1800)
    assert out["b"] <= 200 and out[None] <= 200 and out["a"] == pytest.approx(1800 - out["b"] - out[None])
    assert mixing.targets([]) == {}


def test_bayesian_bounds_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 65536, (4000, jaccard_join.HASHES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint16)
    assert jaccard_join.lasting(a, b).mean() > 0.999
    c = np.where(rng.random(a.shape) < 0.4, a, a + 1).astype(np.uint16)
    assert jaccard_join.lasting(a, c).mean() < 0.001


def test_exact_links():
    sets = [np.arange(k, k + 50, dtype=np.uint64) for k in (0, 5, 6, 500)]
    links = jaccard_join.linked(sets)
    want = [[i != j and len(set(a) & set(b)) * 5 >= 4 * len(set(a) | set(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert links.tolist() == want


def test_exact_links_of_long_sets_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k % 2][k * 100 :], rng.integers(0, 2**64, 50, dtype=np.uint64)])) for k in range(100)]
    tracemalloc.start()
    links = jaccard_join.linked(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sizes = [len(x) for x in sets]
    for i, j in [(0, 1), (0, 2), (0, 30), (0, 42), (1, 41), (50, 80), (98, 60), (7, 99)]:
        common = len(np.intersect1d(sets[i], sets[j]))
        assert links[i, j] == links[j, i] == (5 * common >= 4 * (sizes[i] + sizes[j] - common))
    assert links.any() and not links.all() and peak < 64 << 20  # of 12 MB of hashes


def test_stirling_numbers_and_table_draws():
    s = np.exp(pitman_yor.stirling(0.5, 4))
    assert s[3, 2] == pytest.approx(2 * (1 - 0.5) + (2 - 2 * 0.5) - 0.5 + 0.0, abs=1.0) and s[4, 4] == pytest.approx(1)
    assert s[3, 1] == pytest.approx((1 - 0.5) * (2 - 0.5))
    customers = np.array([1, 2, 30, 48, 5000])
    key = np.arange(5, dtype=np.uint64)
    t = pitman_yor.draw_tables(key, 2, customers, np.zeros(5, np.int64), np.full(5, 0.3), 0.7, 1.0, pitman_yor.stirling(0.7))
    assert t[0] == 1 and (t >= 1).all() and (t <= customers).all()
    assert (t == pitman_yor.draw_tables(key, 2, customers, np.zeros(5, np.int64), np.full(5, 0.3), 0.7, 1.0, pitman_yor.stirling(0.7))).all()


def test_predictive_probabilities_sum_to_one():
    base = np.array([0.5, 0.2, 0.2, 0.1])
    # one context, two leaves, dishes 0..2 seen
    r = pitman_yor.Restaurants(np.array([0, 0, 1]), np.array([0, 1, 2]), np.array([5, 2, 7]), np.arange(3, dtype=np.uint64), np.zeros(3, np.int64), base[:3], np.arange(3, 6, dtype=np.uint64))
    for _ in range(4):
        r.sweep()
        zero = np.zeros(4, np.int64)
        for leaf, leaf_dish in ((0, [0, 1, -1, -1]), (1, [-1, -1, 2, -1]), (-1, [-1] * 4)):
            p = r.probability(base, zero, np.array([0, 1, 2, -1]), np.full(4, leaf), np.array(leaf_dish))
            assert p.sum() == pytest.approx(1)


def test_ftrl_learns_words_and_is_sparse():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts, labels = [], []
    for _ in range(600):
        y = rng.random() < 0.3
        own = [rng.choice(words) for _ in range(60)] + (["vile"] if y else [])
        rng.shuffle(own)
        texts.append(" ".join(own).encode())
        labels.append(float(y))
    places, weights, bias = toxicity.train(texts, np.array(labels))
    assert len(places) < 5000
    table = np.zeros(toxicity.PLACES)
    table[places] = weights

    def score(t):
        _, p = toxicity.features(Words([t], ALNUM))
        return bias + table[np.unique(p)].sum()

    assert score(b"w1 w2 vile w3") > 0 > score(b"w1 w2 w3")


def test_page_leaves():
    page = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/x>Menu</a></nav><p>A &amp; <b>b</b>\n c<p>D<!-- gone --> e<br>f<div>x < y</div>"
    got = [leaf.text for leaf in html_text.leaves(page)]
    assert got == ["Menu", "A & b c", "D e f", "x < y"]
    assert html_text.leaves("") == [] and html_text.leaves("<script>never ends") == []
    assert [x.text for x in html_text.leaves("<p title=\"broken>one</p><i>two</i>")]


def test_all_words_of_an_attribute_reach_the_path():
    (leaf,) = html_text.leaves("<div class='aa bb cc dd ee ff gg hh ii jj sidebar'>x</div>")
    assert {"aa", "ii", "sidebar"} <= set(leaf.path)


def test_labeller_on_pages_never_seen():
    net = html_text.trained()
    rng, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(60):
        some = html_text.leaves(html_text.training_page(rng))
        y = np.array([leaf.text.endswith("\x01") for leaf in some])
        for leaf in some:
            leaf.text = leaf.text.rstrip("\x01") or "."
        wrong += int((net.label([html_text.vectors(some)])[0] != y).sum())
        total += len(y)
    assert wrong / total < 0.01


def test_lstm_gradients():
    rng = np.random.default_rng(11)
    net = html_text.Labeller(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.standard_normal((5, 3, html_text.WIDTH)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = (rng.random((5, 3)) > 0.5).astype(float)
    _, grad = net.gradients(x, mask, y)
    for name in ("f", "b0", "o"):
        at = tuple(int(rng.integers(n)) for n in net.w[name].shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-3
        up, _ = net.gradients(x, mask, y)
        net.w[name][at] = old - 1e-3
        down, _ = net.gradients(x, mask, y)
        net.w[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_gram_hashes_tell_order_apart():
    w = Words([b"a b c a b c b a c"], PLAIN)
    g = gram_hashes(w.hashes, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 6
    assert list(by_bytes([], "text")) == []
