"""Two shards' Burrows-Wheeler transforms merged byte by byte: a second opinion on operator 6, and what a round costs.

    python -m tests.llm.bwt_merge    prints nanoseconds a byte and round on a given text
"""

import sys
import time

import numpy as np


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol before each suffix in the order of suffixes, and their text and place; ends sort by text, before all bytes."""
    where = [(t, p) for t, text in enumerate(texts) for p in range(len(text) + 1)]
    where.sort(key=lambda x: (texts[x[0]][x[1] :], x[0]))
    before = [texts[t][p - 1] + 1 if p else 0 for t, p in where]
    return np.array(before, np.int16), *np.array(where, np.int64).reshape(-1, 2).T


def merge(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shard each merged suffix is of, and for each its common prefix with the one before, counted up to `rounds`.

    Each round deals the interleave out by the symbols before its suffixes, in a stable order; one more symbol is then
    sorted.  A boundary appears in the round in which two neighbours first differ, which is their common prefix.
    """
    side = np.repeat([0, 1], [len(a), len(b)])
    block = np.zeros(len(side), np.int64)
    prefix = np.full(len(side), rounds, np.int64)
    for h in range(rounds):
        symbols = np.empty(len(side), np.int16)
        symbols[side == 0], symbols[side == 1] = a, b
        order = np.argsort(symbols, kind="stable")
        ends = n_a + n_b  # suffixes that are only an end come first, shard by shard
        side, came, kind = np.concatenate([np.repeat([0, 1], [n_a, n_b]), side[order][ends:]]), block[order], symbols[order]
        fresh = np.ones(len(side), bool)
        fresh[ends + 1 :] = (came[ends + 1 :] != came[ends:-1]) | (kind[ends + 1 :] != kind[ends:-1])
        prefix[fresh & (prefix == rounds)] = h
        block = np.cumsum(fresh)
        if fresh.all():
            break
    return side, prefix


def covered(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Which bytes a string of `length` bytes covers that starts at another place too."""
    half = len(texts) // 2
    shards = texts[:half], texts[half:]
    done = [transform(s) for s in shards]
    side, prefix = merge(done[0][0], done[1][0], half, len(texts) - half, length + 1)
    text, place = np.empty(len(side), np.int64), np.empty(len(side), np.int64)
    for k, base in ((0, 0), (1, half)):
        text[side == k], place[side == k] = done[k][1] + base, done[k][2]
    gone = [np.zeros(len(t) + 1, np.int64) for t in texts]
    again = prefix >= length
    for k in np.flatnonzero(again | np.append(again[1:], False)):
        if place[k] + length <= len(texts[text[k]]):
            gone[text[k]][place[k]] += 1
            gone[text[k]][place[k] + length] -= 1
    return [np.cumsum(g)[:-1] > 0 for g in gone]


if __name__ == "__main__":
    raw = open(sys.argv[1], "rb").read()[:400_000]
    pieces = [raw[k : k + 2_000] for k in range(0, len(raw), 2_000)]
    half = len(pieces) // 2
    a, b = transform(pieces[:half])[0], transform(pieces[half:])[0]
    began = time.process_time()
    merge(a, b, half, len(pieces) - half, 40)
    print(f"{(time.process_time() - began) / 40 / len(raw) * 1e9:.1f} ns a byte and round")
