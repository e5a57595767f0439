"""Each operator against a brute-force version on a small corpus, and on an empty one."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from doctide.llm import common, licenses, lm, minhash, mixing, packing, quality, repeats, simhash, topk, urls
from doctide.llm.common import Scratch, top_keys

from . import corpus

WORD = rb"[^\x20\x09-\x0D]+"


def words(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(WORD, raw)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.documents(spark, extra=True).cache()


@pytest.fixture()
def scratch(spark):
    return Scratch(spark)


def test_top_keys_is_exact(spark):
    values = [5, 5, 5, -7, 2**40, -(2**62), 0, 9]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values)):
        kth = sorted(values, reverse=True)[k - 1]
        got, ties = top_keys(df, "v", k)
        assert got == kth and ties == k - sum(v > kth for v in values)
    assert top_keys(df, "v", 0) is None


def test_simhash_components(spark, docs, scratch):
    def fingerprint(text):
        ws = words(text)
        grams = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    rows = corpus.rows()
    codes = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                root[i] = root[j] = min(root[i], root[j])
    first = collections.defaultdict(lambda: 1 << 60)
    for r, x in zip(rows, root, strict=True):
        first[x] = min(first[x], r[0])
    want = sorted((r[0], c, first[x]) for r, c, x in zip(rows, codes, root, strict=True))
    got = simhash.near_duplicates(docs, scratch).collect()
    assert sorted((r["doc_id"], r["code"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.drop_near_duplicates(docs, scratch)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({f for _, _, f in want})


def test_gray_index_finds_every_link(spark, scratch):
    """A dense ball of codes, random ones, and a chain, against all pairs."""
    r = np.random.default_rng(3)
    centre = int(r.integers(1 << 62))
    ball = {centre ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for k in (1, 2, 3, 4) for _ in range(700)}
    codes = np.array(sorted(ball | {int(x) for x in r.integers(1 << 62, size=2_000)}), np.uint64)
    root = np.arange(len(codes))
    for i in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes[i] ^ codes[:i]) <= 3)
        root = simhash._merge(root, np.full(len(near), i), near)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    found = simhash.near_links(df, len(codes), scratch).collect()
    index = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    a, b = np.array([(index[x["a"]], index[x["b"]]) for x in found]).T
    assert np.array_equal(simhash._merge(np.arange(len(codes)), a, b), root)


def test_wide_forest_is_that_of_all_pairs():
    """A ball of codes within reach of each other, random ones and a chain; connected alike at every radius."""
    r = np.random.default_rng(4)
    centre = r.integers(1 << 63, size=2).astype(np.uint64)
    flip = lambda x, n: x ^ np.packbits(np.bincount(r.choice(128, n, replace=False), minlength=128).astype(np.uint8)).view(np.uint64)
    codes = [flip(centre, int(n)) for n in r.integers(1, 20, 300)] + [r.integers(1 << 63, size=2).astype(np.uint64) for _ in range(300)]
    for _ in range(60):
        codes.append(flip(codes[-1], 9))
    words = np.unique(np.array(codes), axis=0)
    words = words[np.argsort(simhash.gray_rank(words[:, 0]), kind="stable")]
    a, b = simhash.wide_forest(words, np.zeros(len(words), np.int64), 28)
    assert len(a) < len(words)
    d = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2, dtype=np.int64)
    own = d[a, b]
    for radius in (4, 9, 12, 20, 28):
        i, j = np.nonzero(np.triu(d <= radius, 1))
        want = simhash._merge(np.arange(len(words)), i, j)
        got = simhash._merge(np.arange(len(words)), a[own <= radius], b[own <= radius])
        assert np.array_equal(want, got)


def test_similar_duplicates(spark, scratch):
    """Copies with words changed, cut off or added, on both sides of likeness 0.8, against exact likeness."""
    r = random.Random(6)
    rows = []
    for i in range(150):
        base = corpus.text(1_000 + i, r.randint(60, 400)).split()
        rows.append((10 * i, " ".join(base)))
        kind, n = i % 4, len(base)
        if kind == 0:
            other = [w if r.random() > 0.012 else w + "x" for w in base]
        elif kind == 1:
            other = base[: n - n // r.choice((8, 12, 3))]
        elif kind == 2:
            other = base + corpus.text(9_000 + i, n // r.choice((7, 10, 2))).split()
        else:
            other = [w.upper() for w in base]
        rows.append((10 * i + 1, "  ".join(other)))
    rows += [(5_000 + i, corpus.text(77, 200)) for i in range(40)] + [(6_000, None), (6_001, ""), (6_002, "One two"), (6_003, "one  TWO"), (None, "one two"), (6_002, "One two")]
    sets = []
    for _, t in rows:
        ws = words(t)
        sets.append(frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset())
    root = list(range(len(rows)))
    for _ in range(3):
        for i, j in itertools.combinations(range(len(rows)), 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    first = collections.defaultdict(lambda: 1 << 60)
    for (d, _), x in zip(rows, root, strict=True):
        first[x] = min(first[x], d if d is not None else 1 << 60)
    want = collections.Counter((d, first[x]) for (d, _), x in zip(rows, root, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((x["doc_id"], x["component_id"]) for x in simhash.similar_duplicates(df, scratch).collect())
    assert sum(got.values()) == len(rows)
    joined = lambda c: {d for d, x in c if d != x}
    assert joined(got) <= joined(want) and len(joined(want) - joined(got)) <= 2 and len(joined(want)) > 100
    kept = simhash.drop_near_duplicates(df, scratch, simhash.similar_duplicates)
    assert sorted(x["doc_id"] or 0 for x in kept.collect() if x["doc_id"]) == sorted({x for d, x in got if d == x and d})


def test_repeated_bytes(spark, docs, scratch):
    rows = corpus.rows()
    raws = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(raw[i : i + 400] for raw in raws for i in range(len(raw) - 399))
    want = []
    for r, raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if count[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((r[0], len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    found = repeats.with_spans(docs.select("doc_id", "text"), scratch).withColumnRenamed("_dt_spans", "spans")
    got = found.mapInArrow(repeats._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    stripped = repeats.strip_repeats(docs, scratch)
    assert stripped.columns == docs.columns and stripped.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in stripped.collect())


def test_passages_of_over_50_words(spark, scratch):
    """51 to 60 short words that two documents share go, 50 do not, whatever the space between them; nothing else goes."""
    word = lambda i: f"w{i}"
    rows, want = [], {}
    for n in (50, 51, 55, 60):
        passage = [word(1000 * n + i) for i in range(n)]
        for k, gap in enumerate((" ", "\n")):
            own = [[word(10**6 + 10_000 * n + 1000 * k + i + 200 * side) for i in range(70)] for side in (0, 1)]
            rows.append((2 * n + k, " ".join(own[0]) + " " + gap.join(passage) + " " + " ".join(own[1]), "en", "s"))
            want[2 * n + k] = " ".join(own[0]) + (" " if n == 50 else "  ") + (gap.join(passage) + " " if n == 50 else "") + " ".join(own[1])
    rows += [(1, None, "en", "s"), (2, "", None, None), (None, " ".join(word(i) for i in range(90)), "en", "s")]
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(3)
    got = {r["doc_id"]: r["text"] for r in repeats.strip_repeats(docs, scratch).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[1] is None and got[2] == "" and got[None] == rows[-1][1]
    found = repeats.with_spans(docs, scratch, passages=True).collect()
    assert {r["doc_id"]: repeats.maximal(r["_dt_passages"]) for r in found if r["_dt_passages"]} == {2 * n + k: [(70, 70 + n)] for n in (51, 55, 60) for k in (0, 1)}


def test_long_texts_are_worked_on_in_windows(spark, scratch, monkeypatch):
    """The same words, hashes and spans, however small the windows are."""
    long = corpus.text(11, 3_000)
    texts = [long, "x" * 3_000 + " " + long[5_000:9_000], corpus.text(12, 40)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = common.words_of(raw, offsets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = lambda: {r["doc_id"]: (repeats.maximal(r["_dt_spans"]), repeats.maximal(r["_dt_passages"])) for r in repeats.with_spans(docs, scratch, passages=True).collect()}
    want = spans()
    assert want[0][0] and want[0][1] and want[1] and not any(want[2])
    monkeypatch.setattr(common, "CHUNK", 700)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, common.words_of(raw, offsets), strict=True))
    assert spans() == want


def test_word_hashes_tell_words_apart():
    """Words that sums of powers cannot tell apart, of every length around the 8-byte blocks, and with zero bytes."""
    swap = str.maketrans("ab", "ba")
    thue = "a"
    while len(thue) < 2_048:
        thue += thue.translate(swap)
    held = [thue[:n] for n in (256, 1_024, 2_048)]
    held += [x.translate(swap) for x in held]
    held += ["x" * n for n in range(1, 40)] + ["x" * n + "\x00" for n in range(1, 40)] + ["y" * n for n in (511, 512, 513, 520, 5_000)] + ["\x00" * n for n in range(1, 20)]
    held += ["A" + "b" * 600, "É" * 300]
    raw = " ".join(held).encode()
    starts, ends, _, hashes = common.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == held
    assert len(set(hashes.tolist())) == len(held)
    again = " ".join(x.translate(str.maketrans("xyA", "XYa")) for x in reversed(held)).encode()
    assert common.words_of(np.frombuffer(again, np.uint8), np.array([0, len(again)]))[3].tolist() == hashes.tolist()[::-1]


def test_pitman_yor_knows_a_long_word_from_its_complement(spark, scratch):
    """A word of 1,024 letters in training, and its Thue-Morse complement in a held-out text."""
    thue = "a"
    while len(thue) < 1_024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    held = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 5 == 1)
    other = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 5 != 1)
    docs = spark.createDataFrame([(other, thue), (held, thue.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in lm.scored(docs, scratch).collect()}
    assert got == {other: 2, held: 1}


def test_spans_shrink_to_characters():
    raw = "aéb".encode()
    assert repeats.whole_characters(raw, [(2, 4)]) == [(3, 4)] and repeats.whole_characters(raw, [(0, 2)]) == [(0, 1)]
    assert repeats.whole_characters(raw, [(2, 3)]) == []


def test_minhash(spark, docs):
    rows = sorted(corpus.rows(), key=lambda r: (r[0], r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = collections.Counter()
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        n, following = len(t) // 4, texts[(i + 1) % len(texts)]
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest())] += 1
    got = minhash.fingerprinted(docs, 4).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[next(x[1] or "" for x in rows if x[0] == r["doc_id"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_minhash_likeness_follows_jaccard():
    import pyarrow as pa

    base = corpus.text(50, 600).split()
    for changed in (0, 20, 60, 150):
        other = [w if i >= changed else f"{w}x" for i, w in enumerate(base)]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in ([w.lower() for w in base], [w.lower() for w in other]))
        _, bits = minhash.fingerprints(pa.array([" ".join(base), " ".join(other)]))
        some = np.array([True])
        got = float(minhash.likeness(bits[:1], bits[1:], some, some)[0])
        assert abs(got - len(a & b) / len(a | b)) < 0.1
    assert minhash.fingerprints(pa.array(["", None, " "]))[0] == ["", "", ""]


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(0, 0.3, 8).astype(float).tolist(), 0) for i in range(90)] + [(200 + i, [0.25] * 8, 0) for i in range(40)]
    vectors += [(300, None, 0), (320, [0.1, None] * 4, 0), (340, [float("nan")] * 8, 0), (360, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    rows = topk.quantised(df)
    got = topk.sliced_top_k(rows, rows.where("vec_id % 20 = 0"), 20, 70_000, 3_000).collect()  # several blocks
    held = {r["vec_id"]: np.array(r["v"]) for r in rows.collect()}
    want = []
    for q in (i for i in held if i % 20 == 0):
        best = sorted((-int(held[q] @ v), i) for i, v in held.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want) and 300 not in held and 320 not in held and 340 not in held


def test_top_k_repeats_and_lengths(spark, monkeypatch):
    """Repeated ids and queries, vectors of any length, tied scores and unused columns, over many blocks and passes."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "LEAST_ROWS", 4)
    monkeypatch.setattr(topk, "PASS_QUERIES", 3)
    r = random.Random(5)
    rows = [(i // 2, [r.randint(-300, 300) for _ in range(r.randint(0, 6))], "x") for i in range(60)]
    rows += [(20, [1, 2, 3], "x")] * 30 + [(40 + i, [7], "x") for i in range(30)] + [(50, [], "x"), (60, [2**40, -(2**40)], "x")]
    asked = [x for x in rows if x[0] % 10 == 0]
    df, queries = (spark.createDataFrame(x, "vec_id long, v array<long>, rank string") for x in (rows, asked))
    got = topk.sliced_top_k(df, queries, 5, len(rows), len(asked)).collect()
    want = []
    for q in {x[0] for x in asked}:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), i) for j, v, _ in asked if j == q for i, w, _ in rows if i != q]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_url_rules(spark, scratch):
    cases = {
        "http://A.example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17#x": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://com/de/a": ("com", "/de/a", "com/de/", "block"),
        "http://notorg/": ("notorg", "/", None, None),
        "http://org": ("org", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "ftp://É.org/\nx": ("É.org", "/\nx", "org/", "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = urls.judged(df, urls.rule_labelled(df), scratch).collect()
    assert len(got) == len(cases)
    for r in got:
        host, path, rule, verdict = cases[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"]) and r["verdict"] in ("allow", "block")


def test_url_regression_learns(spark, scratch):
    bad = [(f"http://host{i}.net/casino/win{i}", 1) for i in range(80)]
    good = [(f"http://host{i}.net/library/book{i}", 0) for i in range(80)]
    df = spark.createDataFrame(bad + good, "url string, y int")
    test = spark.createDataFrame([(f"http://other{i}.net/{p}/{i}",) for i in range(20) for p in ("casino", "library")], "url string")
    got = urls.judged(test, df, scratch, rules=()).collect()
    assert all((r["verdict"] == "block") == ("casino" in r["url"]) for r in got)


def test_url_odd_tables(spark, scratch):
    """Repeated rows, clashing extra columns, very long and unclean urls: one row each, equal urls judged alike."""
    long = "http://a.net/" + "x" * 50_000
    rows = [(1, "http://a.net/casino/1", "h", "p")] * 3 + [(2, long, "h", "p"), (3, "http://é.net/%00?\n", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, grams string, y string")
    labelled = spark.createDataFrame([("http://b.net/casino/2", 1), ("http://b.net/library/2", 0), (None, None), (None, 1)] * 5, "url string, y int")
    got = urls.judged(df, labelled, scratch).select("page_id", "url", "host", "path", "verdict").collect()
    assert collections.Counter((r["page_id"], r["url"]) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    assert len({tuple(r) for r in got if r["page_id"] == 1}) == 1
    assert {r["path"] for r in got if r["page_id"] == 2} == {long[len("http://a.net") :]}
    assert [(r["host"], r["path"]) for r in got if r["url"] is None] == [("", "")]


def test_best_fit_takes_the_tightest_bin():
    """Every choice against a search of all open bins: the least room left among those without a conflict, a new bin only if none."""
    r = random.Random(11)
    for _ in range(30):
        n = r.randrange(1, 120)
        sizes = sorted((r.choice([0, 1, 40, 700, r.randrange(packing.CAPACITY + 1)]) for _ in range(n)), reverse=True)
        sources, clusters = [r.choice([None, *"abcdef"]) for _ in range(n)], [r.randrange(n) for _ in range(n)]
        room, held = [], []
        for size, source, cluster, bin_ in zip(sizes, sources, clusters, packing.best_fit(sizes, sources, clusters), strict=True):
            fit = [room[b] for b in range(len(room)) if room[b] >= size and room[b] > 0 and not any(cluster == c or (source and source == s) for s, c in held[b])]
            if bin_ == len(room):
                assert not fit
                room.append(packing.CAPACITY)
                held.append([])
            else:
                assert fit and room[bin_] == min(fit)
            assert not any(cluster == c or (source and source == s) for s, c in held[bin_])
            room[bin_] -= size
            held[bin_].append((source, cluster))


def test_mixing(spark, docs, scratch):
    out = mixing.mixed(docs, scratch).collect()
    rows = corpus.rows()
    assert sum(r["n"] for r in out) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    source = {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.reshared([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    assert math.isclose(sum(targets.values()), sum(sizes.values())) and all(t <= 3 * sizes[s] + 1e-6 for s, t in targets.items())
    for r in out:
        assert 0 <= r["copies"] <= 3 and math.isclose(r["target"], targets[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["copies"] * r["size"] * r["n"]
    for s in names:
        assert abs(taken[s] - targets[s]) <= 0.1 * targets[s] + 60, (s, taken[s], targets[s])
    again = mixing.mixed(docs, scratch).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    mixed = mixing.mix_copies(docs, scratch)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] * r["n"] for r in out)


def test_reshared_targets():
    assert mixing.reshared([100, 100], [1, 1]) == [100, 100]
    assert mixing.reshared([10, 990], [99, 1]) == [30, 970]
    assert mixing.reshared([0, 50], [5, 1]) == [0, 50] and mixing.reshared([], []) == []


def test_packing(spark, docs, scratch):
    out = packing.packed(docs, scratch).collect()
    pieces = collections.Counter()
    for r in corpus.rows():
        n = len(words(r[1]))
        for k in range(max(1, -(-n // packing.CAPACITY))):
            pieces[(r[0], k, k * packing.CAPACITY, min(packing.CAPACITY, n - k * packing.CAPACITY))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["first_word"], r["n_words"]) for r in out) == pieces
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["bin_id"]].append(r)
    text = {r[0]: " ".join((r[1] or "").lower().split()) for r in corpus.rows()}
    for held in bins.values():
        assert sum(r["n_words"] for r in held) == held[0]["fill"] <= packing.CAPACITY
        named = [r["source"] for r in held if r["source"] is not None]
        assert len(named) == len(set(named)) and len({text[r["doc_id"]] for r in held}) == len(held)


def test_best_fit_takes_the_tightest_compatible_bin():
    got = packing.best_fit([2000, 1900, 100, 48, 40], ["a", "b", "a", "b", "c"], [1, 2, 3, 4, 5])
    assert got == [0, 1, 1, 0, 1]  # 100 fits only the second; 48 fills the first; 40 goes to the second's rest of 48
    naive = packing.best_fit([1000, 1000], [None, None], [9, 9])
    assert naive == [0, 1]  # one cluster


def test_quality_drops_bad_documents(spark, scratch):
    good = [(i, corpus.text(i, 120)) for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in corpus.text(i, 80).split())) for i in range(60)]
    foul = [(2000 + i, corpus.text(5000 + i, 60) + " vilest vilely vile " + corpus.text(6000 + i, 60)) for i in range(60)]
    rows = [*good, *junk, *foul, (3000, None), (3001, ""), (None, corpus.text(9000, 100))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _key string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(i, 0, 0) for i in range(1000, 1060, 2)] + [(i, 1, 1) for i in range(2000, 2060, 2)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.resample(docs, labels, scratch)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {3000, 3001}
    assert sum(i in ids for i in range(200)) >= 196 and sum(i in ids for i in range(1000, 2060)) <= 4
    assert {r["doc_id"] for r in quality.resample(docs, labels, scratch).collect()} == ids
    everything = quality.resample(docs, labels.limit(0), scratch)
    assert everything.count() == len(rows) - 2


def test_lm_scores(spark, docs, scratch):
    rows = corpus.rows()
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = {i: [*words(r[1]), None] for i, r in enumerate(rows)}
    c = collections.Counter(t for i, r in enumerate(rows) if not fold(r[0]) for t in tokens[i])
    total, kinds = sum(c.values()), len(c)
    want = sorted((r[0], fold(r[0]), len(t), sum(c[x] > 0 for x in t), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in t), 6)) for r, t in zip(rows, tokens.values(), strict=True))
    got = lm.scored(docs, scratch).collect()
    assert sorted((*r[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got) and sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def lm_plain(model):
    """Counts, parents, shares and seats of a trained model by word, as dictionaries."""
    held = {int(w): (c, p, x) for w, c, p, x in zip(model.words, model.counts, model.parent, model.share, strict=True)}
    held |= {r["word"]: (r["c"], r["parent"], r["share"]) for r in model.rare.collect()}
    seats, half = {}, (1 << lm.WORD_BITS) - 1
    for r in model.near.collect():
        key, c, t = (f(r[n], r["near_n"], k) for f, n, k in ((lm.risen, "near_keys", np.int64), (lm.unsqueezed, "near_c", np.int64), (lm.unsqueezed, "near_tables", float)))
        seats |= {(int(model.words[x >> lm.WORD_BITS]), int(model.words[x & half])): (int(n), y) for x, n, y in zip(key, c, t, strict=True)}
    for r in model.far.collect():
        if r["kind"] == lm.BOTH:
            u, w = r["other"], r["key"]
        else:
            u, w = (int(model.words[r["other"]]), r["key"]) if r["kind"] == lm.TOKEN else (r["key"], int(model.words[r["other"]]))
        seats[u, w] = r["c"], r["tables"]
    return held, seats


def lm_pairs(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    _, tokens, before = lm.token_stream(raw, np.array([0, len(raw)]))
    return list(zip(before.view(np.int64).tolist(), tokens.view(np.int64).tolist(), strict=True))


def lm_keyed(docs):
    return docs.selectExpr("doc_id", "coalesce(text, '') as text", "crc32(coalesce(cast(doc_id as string), '')) % 5 = 1 as held_out")


@pytest.mark.parametrize("bits", [20, 5])
def test_lm_scores_follow_from_the_seats(spark, docs, scratch, monkeypatch, bits):
    """Probabilities after each context sum to one, and scores are those of plain loops over the seats of all pairs."""
    monkeypatch.setattr(lm, "WORD_BITS", bits)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(lm, "PART_TOKENS", 1_500)
    model, _, parts = lm.trained(lm_keyed(docs), scratch)
    held, seats = lm_plain(model)
    assert parts > 3 and (bits == 20 or len(model.words) <= 32 < len(held)) and len(held) == model.kinds
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    pairs = collections.Counter(x for r in corpus.rows() if not fold(r[0]) for x in lm_pairs(r[1]))
    counts = collections.Counter(w for (_, w), n in pairs.items() for _ in range(n))
    assert {w: c for w, (c, _, _) in held.items()} == counts
    assert {k: c for k, (c, _) in seats.items()} == {k: c for k, c in pairs.items() if c > 1}
    assert all(1 <= t <= c for c, t in seats.values())
    seats |= {k: (1, 1.0) for k, c in pairs.items() if c == 1}
    assert abs(sum(p for _, p, _ in held.values()) + model.unseen - 1) < 1e-9
    own = collections.Counter()
    for (u, _), (c, t) in seats.items():
        own[u] += (c - lm.CONTEXT_DISCOUNT * t) / (lm.STRENGTH + counts[u])
    assert all(abs(held[u][2] + own[u] - 1) < 1e-9 for u in own)

    def chance(u, w):
        c, t = seats.get((u, w), (0, 0.0))
        cu, share = (held[u][0], held[u][2]) if u in held else (0, 1.0)
        return share * (held[w][1] if w in held else model.unseen) + (c - lm.CONTEXT_DISCOUNT * t) / (lm.STRENGTH + cu)

    want = sorted((r[0], sum(math.log10(chance(u, w)) for u, w in lm_pairs(r[1]))) for r in corpus.rows())
    got = sorted((r["doc_id"], r["score"]) for r in lm.scored(docs, scratch).collect())
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-5) for a, b in zip(got, want, strict=True))


def test_lm_head_is_only_a_shortcut(spark, docs, scratch, monkeypatch):
    """Every pair is seated and scored alike, whether the head has all words or next to none."""

    def score():
        got = lm.scored(docs, scratch).collect()
        return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), sum(r["score"] for r in got)

    whole, total = score()
    monkeypatch.setattr(lm, "WORD_BITS", 5)
    less, again = score()
    assert less == whole and abs(again - total) < 0.002 * abs(total)


def test_seating_follows_the_restaurant():
    """Mean tables of many dishes against a sampler that seats every customer by itself."""
    r = np.random.default_rng(8)
    for customers, rate in ((2, 0.3), (5, 2.0), (40, 0.5), (400, 3.0), (3_000, 40.0)):
        n = 3_000 if customers < 100 else 400
        got = lm.seated(np.full(n, customers), np.full(n, rate), 0.75, r.integers(1 << 62, size=n).astype(np.uint64), 7)
        tables = np.ones(n)
        for k in range(1, customers):
            tables += r.random(n) < rate / (rate + k - 0.75 * tables)
        error = 4 * (got.std() + tables.std()) / n**0.5 + 0.02 * tables.mean()
        assert abs(got.mean() - tables.mean()) < error + 1e-9, (customers, got.mean(), tables.mean())


def test_squeezed_numbers_return():
    r = np.random.default_rng(2)
    for kind in (np.uint32, np.uint64, np.int64, np.float32):
        for n in (0, 1, 1_000):
            x = r.integers(0, 1 << 31, n).astype(kind)
            assert np.array_equal(lm.unsqueezed(lm.squeezed(x), n, kind), x)
            if kind != np.float32:
                assert np.array_equal(lm.risen(lm.rising(x), n, kind), x)


def test_seating_stays_within_bounds():
    customers = np.array([1, 2, 50, 300, 5_000, 200_000])
    t = lm.seated(customers, np.full(6, 0.5), 0.75, np.arange(6, dtype=np.uint64), 1)
    assert (t >= 1).all() and (t <= customers).all() and t[0] == 1 and t[-1] > t[2]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-grant"]
    edited = mit.replace("free of charge", "at no cost").replace("\"Software\"", "'Work'").upper()
    rows = [(1, "words before. " + mit + " after"), (2, "x " + edited), (3, "released  under\nthe MIT license"), (4, "Permission is hereby granted to nobody"), (5, None), (6, ""), (7, "a " * 3000 + "Licensed under CC BY-NC 4.0. É All rights reserved! All rights reserved")]
    got = licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["license"]): r for r in got}
    assert set(found) == {(1, "MIT-grant"), (2, "MIT-grant"), (3, "MIT"), (7, "CC-BY-NC-4.0"), (7, "ARR")}
    assert found[1, "MIT-grant"]["matched_text"] == mit and found[1, "MIT-grant"]["coverage"] == 1
    assert 0.8 <= found[2, "MIT-grant"]["coverage"] < 1 and found[3, "MIT"]["first_byte"] == 0
    assert sum(r["license"] == "ARR" for r in got) == 2


def test_alignment_is_the_longest_common_subsequence():
    r = np.random.default_rng(5)
    for _ in range(40):
        a, b = r.integers(0, 4, 6).tolist(), r.integers(0, 4, 8).tolist()
        best = max(len(s) for k in range(len(a) + 1) for s in itertools.combinations(a, k) if _within(s, b))
        assert licenses.aligned(a, b, -6, 8)[0] == best


def _within(s, text):
    rest = iter(text)
    return all(x in rest for x in s)


def test_empty_tables(spark, scratch):
    none = corpus.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert minhash.fingerprinted(none, 4).count() == 0
    assert simhash.near_duplicates(none, scratch).count() == simhash.drop_near_duplicates(none, scratch).count() == 0
    assert simhash.similar_duplicates(none, scratch).count() == 0
    assert repeats.strip_repeats(none, scratch).count() == 0
    assert mixing.mixed(none, scratch).count() == mixing.mix_copies(none, scratch).count() == 0
    assert packing.packed(none, scratch).count() == 0
    assert quality.resample(none, labels, scratch).count() == 0
    assert lm.scored(none, scratch).count() == 0
    assert licenses.license_spans(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(pages, urls.rule_labelled(pages), scratch).count() == 0
    vectors = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.sliced_top_k(vectors, vectors, 20, 0, 0).count() == 0


def test_byte_wise_transform_merge_agrees(spark, scratch):
    """The sampled refinement of operator 6 against the plain merge of two shards' transforms, symbol by symbol."""
    from . import bwt_merge

    texts = [corpus.text(1, 90), corpus.text(2, 20) + corpus.text(1, 90)[30:] + "x", "ab" * 260, corpus.text(3, 75), corpus.text(3, 75), "", "short"]
    raws = [t.encode() for t in texts]
    want = [np.packbits(c).tobytes() for c in bwt_merge.covered(raws, repeats.LENGTH)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: repeats.maximal(r["_dt_spans"]) for r in repeats.with_spans(df, scratch).collect()}
    for i, raw in enumerate(raws):
        mask = np.zeros(len(raw), bool)
        for first, end in got[i]:
            mask[first:end] = True
        assert np.packbits(mask).tobytes() == want[i], i
    assert any(got.values())
