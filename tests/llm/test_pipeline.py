"""The pipeline stage by stage on the smallest tables, each against plain Python over its own input."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from doctide.llm import mixing, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage reads and returns."""
    folder = tmp_path_factory.mktemp("pipeline")
    df, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = df.toPandas()
        got = stage(spark, df, SF)
        assert got.columns == columns or k == 4, name
        got.write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        out.append((before, df.toPandas()))
    return out


def test_quality(stages, spark):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.itertuples()}
    each = []
    for text in before["text"]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        each.append(quality.ngrams_of(raw, np.array([0, len(raw)]))[2])
    raw_counts, target = collections.Counter(), collections.Counter()
    for doc, buckets in zip(before["doc_id"], each, strict=True):
        raw_counts.update(buckets.ravel().tolist())
        if good.get(doc):
            target.update(buckets.ravel().tolist())
    rate = sum(target.values()) / sum(raw_counts.values())
    expected = np.array([n * rate for n in (raw_counts[b] for b in range(quality.BUCKETS))], np.float32)
    words, weight = np.array([len(b) for b in each]), np.full(len(each), quality.NONE)
    for i, (doc, buckets) in enumerate(zip(before["doc_id"], each, strict=True)):
        own = collections.Counter(buckets.ravel().tolist()) if good.get(doc) else {}
        passage = []
        for word in buckets.tolist():
            total = 0.0
            for b in word:
                seen, due = target[b] - own.get(b, 0), float(expected[b])
                total += np.log((seen + 1) / (due + 1)) if abs(seen - due) > quality.SURE * due**0.5 else 0.0
            passage.append(total)
        if passage:
            weight[i] = min(sum(passage[max(0, k - n + 1) : k + 1]) for n in quality.WINDOWS for k in range(len(passage)))
    model = np.stack([np.array([target[b] for b in range(quality.BUCKETS)], np.float32), expected])
    content = quality.weigh(pa.array(before["text"], pa.string()), model, np.zeros(len(before), bool))[2]
    known = np.array([good.get(d) is True for d in before["doc_id"]]), np.array([good.get(d) is False for d in before["doc_id"]])
    cut = quality.best_cut(weight[known[0] & (words > 0)], weight[known[1] & (words > 0)])
    keys = quality.gumbel_keys(before["doc_id"].to_numpy(), content, weight)
    last = np.sort(keys[words > 0])[-int((weight >= cut).sum())]
    assert sorted(before["doc_id"][(words > 0) & (keys >= last)]) == sorted(after["doc_id"])
    assert 0.7 * len(before) < len(after) < len(before)


def test_near_dedup(stages):
    """Groups by all pairs' exact likeness of five-word shingle sets: none joined below 0.8, and nearly all from 0.8 up."""
    before, after = stages[1]
    before = before.sort_values("doc_id")
    sets = []
    for text in before["text"]:
        ws = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = {int(before["doc_id"].iloc[x]) for x in range(len(sets)) if find(x) == x}
    assert set(after["doc_id"]) >= want and len(after) == len(set(after["doc_id"]))
    assert len(set(after["doc_id"]) - want) <= 0.02 * (len(before) - len(want)) and len(want) < len(before)


def test_repeats(stages):
    before, after = stages[2]
    raws = [(t or "").encode() for t in before["text"]]
    count = collections.Counter(raw[i : i + 400] for raw in raws for i in range(len(raw) - 399))
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] for raw in raws]
    passage = lambda raw, at, k: b" ".join(raw[a:b] for a, b in at[k : k + 51])
    passages = collections.Counter(passage(raw, at, k) for raw, at in zip(raws, places, strict=True) for k in range(len(at) - 50))
    got, short = dict(zip(after["doc_id"], after["text"], strict=True)), 0
    for doc, raw, at in zip(before["doc_id"], raws, places, strict=True):
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - 399):
            if count[raw[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        # a character goes only if all of its bytes do
        first = np.flatnonzero([b & 0xC0 != 0x80 for b in raw])
        whole = np.minimum.reduceat(gone, first) if len(raw) else gone
        keep = ~np.repeat(whole, np.diff(np.append(first, len(raw)))) if len(raw) else ~gone
        for k in range(len(at) - 50):
            if passages[passage(raw, at, k)] > 1:
                short += keep[at[k][0] : at[k + 50][1]].any()
                keep[at[k][0] : at[k + 50][1]] = False
        assert got[doc] == bytes(np.frombuffer(raw, np.uint8)[keep]).decode()
    assert short  # some passages of over 50 words are no strings of 400 bytes
    assert len(after) == len(before) and (after["n_chars"] == after["text"].str.len()).all()


def test_mixing(stages):
    before, after = stages[3]
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in zip(before["doc_id"], before["text"], strict=True)}
    source = dict(zip(before["doc_id"], before["source"], strict=True))
    copies = collections.Counter(after["doc_id"])
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    totals, taken = collections.Counter(), collections.Counter()
    for d, n in size.items():
        totals[source[d]] += n
        taken[source[d]] += n * copies[d]
    names = sorted(totals)
    for s, target in zip(names, mixing.reshared([totals[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True):
        smallest = min(n for d, n in size.items() if source[d] == s)
        assert abs(taken[s] - target) <= max(0.05 * target, smallest)


def test_packing(stages):
    before, after = stages[4]
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in zip(before["doc_id"], before["text"], strict=True)}
    assert after["n_words"].sum() == sum(size[d] for d in before["doc_id"])
    text = dict(zip(before["doc_id"], (" ".join(t.lower().split()) for t in before["text"]), strict=True))
    for _, held in after.groupby("bin_id"):
        assert held["n_words"].sum() <= packing.CAPACITY
        assert held["source"].dropna().is_unique and len({text[d] for d in held["doc_id"]}) == len(held)


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "n_words"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, stages[4][1][key].to_numpy().tolist()))


def test_awkward_rows_pass_all_stages(spark):
    """Nulls, empty texts, ties, repeated rows and clashing columns, and no rows at all, with labels that fit none."""
    from . import corpus

    for df in (corpus.documents(spark, extra=True), corpus.empty(spark)):
        n = df.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            assert out.columns == df.columns or k == 4, name
            left = out.count()
            assert (left > 0) == (n > 0) and (left <= n or k > 2), name
            if k < 3:
                df = out
