"""What a task's Python holds beside a batch does not grow with the batch: text goes through the stages in small windows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from doctide.llm import common, quality, repeats, simhash

MOST = 48 << 20


@pytest.fixture(scope="module")
def batch():
    """9 MB of text in rows of 4 kB, one of 900 kB among them, null and empty ones, and some that share passages."""
    rng = np.random.default_rng(5)
    words = np.array([f"{'abcdefghij'[k % 10] * (k % 9)}{k}" for k in range(5_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 420)]) for _ in range(2_000)]
    texts += [t[:600] + "é " + u[:2_000] for t, u in zip(texts[:50], texts[100:150], strict=True)]
    texts[7] = " ".join(words[rng.integers(0, len(words), 100_000)])
    texts[11], texts[12] = None, ""
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string()), pa.array([i % 5 == 0 for i in range(len(texts))])], ["doc_id", "content", "text", "target"])


def peak(steps):
    """Bytes that going through the steps takes at most at a time; what they give is let go."""
    tracemalloc.start()
    try:
        n = sum(len(x) for x in steps)
        return tracemalloc.get_traced_memory()[1], n
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("shape", [repeats.BYTES, repeats.WORDS])
def test_samples_take_little(batch, shape):
    most, n = peak(repeats._sample(shape)([batch]))
    assert n > 10_000 and most < MOST


def test_codes_and_sets_take_little(batch):
    fields = [batch.column("doc_id"), batch.column("content"), batch.column("text"), batch.column("doc_id"), batch.column("doc_id")]
    wide = pa.RecordBatch.from_arrays(fields, ["doc_id", "content", "text", "low", "high"])
    for step in (simhash.wide_codes, simhash._shingle_sets):
        most, n = peak(step([wide]))
        assert n == len(batch) and most < MOST


def test_weights_take_little(batch):
    model, target = np.full((2, quality.BUCKETS), 99, np.float32), batch.column("target").to_numpy(zero_copy_only=False)
    most, n = peak(f(batch.column("text"), model, target)[0] for f in [quality.weigh])
    assert n == len(batch) and most < MOST


def test_near_copies_take_little():
    """A group of 6,000 codes within the radius of each other is searched in small steps."""
    rng = np.random.default_rng(6)
    words = np.repeat(rng.integers(0, 1 << 62, (1, 2)).astype(np.uint64), 6_000, axis=0)
    for k in range(4):
        words[np.arange(len(words)), k % 2] ^= np.uint64(1) << rng.integers(0, 64, len(words)).astype(np.uint64)
    words = np.unique(words, axis=0)
    words = words[np.argsort(simhash.gray_rank(words[:, 0]), kind="stable")]
    most, links = peak(f(words, np.zeros(len(words), np.int64), simhash.WIDE_RADIUS)[0] for f in [simhash.wide_forest])
    assert links == len(words) - 1 and most < 110_000_000


def test_row_runs_lose_no_row(batch):
    runs = list(common.row_runs([batch, batch.slice(0, 0), batch.slice(9, 5)]))
    assert pa.Table.from_batches(runs).equals(pa.Table.from_batches([batch, batch.slice(9, 5)])) and len(runs) > 20
    assert all(len(r) == 1 or r.column("text").nbytes <= 2 * common.CHUNK for r in runs)


@pytest.mark.parametrize("shape", [repeats.BYTES, repeats.WORDS])
def test_windows_do_not_change_samples(batch, shape, monkeypatch):
    few = batch.slice(8)
    small = pa.Table.from_batches(repeats._sample(shape)([few]))
    monkeypatch.setattr(repeats, "CHUNK", 2 << 20)
    assert small.equals(pa.Table.from_batches(repeats._sample(shape)([few])))
