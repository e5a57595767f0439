"""Edited templates are found down to the stated coverage, wherever the edit is."""

import itertools
import random

import pyarrow as pa

from doctide.llm import licenses
from doctide.llm.licenses import license_spans
from doctide.operators.sequences import longest_common


def found(index, texts):
    return {(row, name): n for row, name, n, *_ in licenses.matches(index, pa.array(texts))}


def test_every_edit_of_a_short_template():
    for name, text in licenses.TEMPLATES.items():
        index, tokens = licenses.TemplateIndex({name: text}), "".join(c if c.isalnum() else " " for c in text).split()
        most = len(tokens) - next(k for k in range(len(tokens) + 1) if k >= licenses.COVERAGE * len(tokens))
        if len(tokens) > 16:
            continue
        for change in ("qq", ""):
            edits = list(itertools.chain(*(itertools.combinations(range(len(tokens)), k) for k in range(most + 1))))
            texts = ["far away " + " ".join(change if i in edit else t for i, t in enumerate(tokens)) + " and on" for edit in edits]
            got = found(index, texts)
            for row, (edit, cut) in enumerate(zip(edits, texts, strict=True)):
                words = licenses.tokens_of(cut).tolist()
                want = licenses.aligned(index.tokens[0].tolist(), words, -len(tokens), len(words))[0]
                assert want >= len(tokens) - len(edit) and got.get((row, name)) == want, (name, cut)


def test_edits_of_the_reviewed_templates():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    got = found(index, ["Licensed under the Apache Licence, Version 2.0.", "Licensed under CC BY-SA 3.0.", "Released under a MIT license", "all rights, reserved"])
    assert got[0, "Apache-2.0"] == 7 and got[1, "CC-BY-SA-4.0"] == 6 and got[2, "MIT"] == 4 and got[3, "ARR"] == 3


def test_long_template_in_a_long_text(spark):
    """A template as long as a whole license: spans and coverage of copies with words changed, left out and put in."""
    r = random.Random(5)
    word = lambda letters="abcdefghij": "".join(r.choice(letters) for _ in range(4))
    template = [word() for _ in range(400)]
    filler = [word("klmnopqrst") for _ in range(20000)]

    def edited(share):
        out = []
        for w in template:
            x = r.random()
            out += [word()] if x < share / 2 else [] if x < 0.75 * share else [w, word()] if x < share else [w]
        return out

    copies = {0: template, 1: edited(0.1), 2: edited(0.15), 3: template[:200], 4: template[:350], 5: edited(0.6)}
    rows, want = [], {}
    for doc, copy in copies.items():
        at = r.randrange(5000, 15000)
        rows.append((doc, " ".join([*filler[:at], *copy, *filler[at:]])))
        matched = len(longest_common(template, copy))
        if matched >= 0.8 * len(template):
            want[doc] = (matched, len(" ".join(filler[:at])) + 1, len(" ".join(filler[:at] + copy)))
    got = {d: (n, a, b) for d, _, n, _, a, b, _ in map(tuple, license_spans(spark.createDataFrame(rows, "doc_id long, text string"), {"long": " ".join(template)}).collect())}
    assert got.keys() == want.keys() == {0, 1, 2, 4}, (got, want)
    for doc, (n, first, end) in got.items():
        assert want[doc][0] >= n >= want[doc][0] - 2 and abs(first - want[doc][1]) < 60 and abs(end - want[doc][2]) < 60
    assert got[0] == want[0]
