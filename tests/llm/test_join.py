"""The Jaccard join against brute force where groups are larger than a leaf or a block, and ids repeat."""

import random

import numpy as np
import pytest

from tallyweave.llm import jaccard

WORDS = [f"w{i}" for i in range(4000)]


def brute(rows, words=3, percent=90):
    """component_id of each (doc_id, text), by comparing all."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < words else zip(*(w[i:] for i in range(words)))))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_group(seed, n, length=120, edits=(0, 9)):
    """Copies of one text, each with edits of its own: many pairs near the threshold on either side."""
    rng = random.Random(seed)
    base = rng.choices(WORDS, k=length)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(length)] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


def same(spark, rows, **of):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, **of).collect())
    assert got == sorted(brute(rows, **of))
    return got


def test_groups_above_a_leaf(spark):
    rng = random.Random(1)
    texts = near_group(1, 150, edits=(0, 3)) + near_group(2, 60, edits=(3, 5)) + [" ".join(rng.choices(WORDS, k=60)) for _ in range(40)]
    rng.shuffle(texts)
    got = same(spark, list(enumerate(texts)))
    assert len({c for _, _, c in got}) > 40 and max(sum(c == x for *_, c in got) for x in {c for *_, c in got}) > 60


@pytest.mark.parametrize(("rows", "size"), [(16, 1 << 30), (4096, 6000)])
def test_groups_above_a_block(spark, monkeypatch, rows, size):
    """Blocks of 16 rows, or of some sets' bytes: every link between blocks counts."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    rng = random.Random(3)
    texts = near_group(5, 130) + near_group(6, 40, edits=(4, 4)) + near_group(7, 30, length=30, edits=(0, 2))
    rng.shuffle(texts)
    same(spark, list(enumerate(texts)))


def test_an_id_with_two_texts_keeps_its_links(spark):
    a, b = near_group(8, 1)[0], near_group(9, 1)[0]
    one, two = a.rsplit(" ", 1)[0], b.rsplit(" ", 1)[0]
    got = same(spark, [(1, a), (2, one), (1, b), (3, two), (4, "alone it stands"), (4, "alone it stands")])
    assert [c for d, _, c in got if d == 3] == [1]


def test_sets_of_very_many_words(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(3):
        base = rng.choices(WORDS, k=9000)
        for edits in (0, 40, 120, 400, 900):
            words = list(base)
            for i in rng.sample(range(9000), edits):
                words[i] = "x" + words[i]
            texts.append(" ".join(words))
    same(spark, list(enumerate(texts)))


def test_five_words_and_four_fifths(spark):
    texts = near_group(11, 60, edits=(0, 6)) + ["one two three", "ONE two\tthree", "", None]
    same(spark, list(enumerate(texts)), words=5, percent=80)


def test_a_forest_holds_no_more_edges_than_rows():
    sets = [jaccard.shingles(t) for t in near_group(12, 200, edits=(0, 1))]
    n = np.array([len(s) for s in sets])
    rows = {"n": n, "bits": np.stack([jaccard.bitmap(s) for s in sets]), "side": np.zeros(200, np.int64), "comp": np.arange(200)}
    asked = []

    def links(x, y):
        asked.append((x, y))
        both = jaccard.overlap(sets[x], sets[y])
        return 100 * both >= 90 * (n[x] + n[y] - both)

    edges = jaccard._forest(rows, lambda x, y: np.ones(len(x), bool), links, 90)
    assert len(edges) == 199 and len(asked) < 200 * 20
