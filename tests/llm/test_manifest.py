"""Operator 12 against a tree built plainly, level by level, with blocks of every size."""

import hashlib
import random
import zlib

import pytest

from doctide.llm import manifest
from doctide.llm.common import Scratch

from . import corpus


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(spell, (doc_id, source, lang, n_chars, text)))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    """(sibling or None, whether it stands left) up to the root."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def brute(rows):
    """Result rows of (doc_id, source, lang, n_chars, text)."""
    key = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    langs = sorted({r[2] for r in rows}, key=key)
    held = [sorted((r for r in rows if r[2] == g), key=lambda r: (key(r[0]), leaf_of(*r))) for g in langs]
    trees = [levels_of([leaf_of(*r) for r in g]) for g in held]
    top = levels_of([t[-1][0] for t in trees]) if rows else [[None]]
    out = []
    for k, (g, tree) in enumerate(zip(held, trees, strict=True)):
        for i, r in enumerate(g):
            steps = path(tree, i) + path(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf_of(r[0], r[1], r[2], r[3] + changed if r[3] is not None else None, r[4])
            for other, left in steps:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            out.append((r[0], leaf_of(*r), tree[-1][0], top[-1][0], h(*(s for s, _ in steps if s)), node, node == top[-1][0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", None) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, rank int, block string, root string").repartition(3)


def got(spark, df):
    return order([tuple(r) for r in manifest.verified(manifest.manifest(df, Scratch(spark))).collect()])


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_is_that_of_a_plain_tree(spark, monkeypatch, height):
    """Blocks of 2, 4 and 4,096 leaves: several levels of blocks in languages, and in the tree over many languages."""
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "BLOCK", 1 << height)
    r = random.Random(height)
    sizes = {"en": 45, "de": 16, "": 1, None: 5, "é": 3, "fr": 2, **({f"l{i}": 1 for i in range(9)} if height == 2 else {})}
    rows = [(r.randrange(-50, 10_000), r.choice([None, "", "s1"]), g, r.choice([None, 0, 7, 2**63 - 1]), r.choice([None, "", "ü\n:-", "x" * 300_000])) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, None, "en", 3, "a"), (None, None, "en", 3, "b"), (5, "s", "en", 1, "t"), (5, "s", "en", 1, "t"), (5, "s", "en", 1, "u")]
    assert got(spark, frame(spark, rows)) == order(brute(rows))


def test_manifest_of_one_and_of_none(spark):
    rows = [(8, "s", "en", 4, "text")]
    assert got(spark, frame(spark, rows)) == order(brute(rows))
    assert got(spark, frame(spark, [])) == []


def test_manifest_of_the_corpus(spark):
    rows = [(i, s, g, len(t or ""), t) for i, t, g, s in corpus.rows()]
    assert got(spark, corpus.documents(spark, extra=True)) == order(brute(rows))


def test_append_keeps_witnesses_up_to_date():
    for n in (1, 2, 3, 5, 8, 13, 64, 100):
        leaves = [h(str(i)) for i in range(n)]
        tree = manifest.Append()
        for x in leaves:
            tree.add(x)
        # an open subtree's leaves prove themselves against its digest before the tree is closed
        for _, digest, first, end in tree.open:
            assert all(manifest.folded(leaves[k], tree.witness[k]) == digest for k in range(first, end))
        root = tree.close()
        assert root == levels_of(leaves)[-1][0]
        assert all(manifest.folded(x, w) == root for x, w in zip(leaves, tree.witness, strict=True))
        assert manifest.folded(h("other"), tree.witness[n // 2]) != root
