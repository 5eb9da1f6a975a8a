"""Operators against brute force, round trips and the libraries they stand for."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import components, divergence, fingerprint, jaccard, language, mixing, packing, quality, sharding, tokens, toxicity
from tallyweave.llm.common import documents, salted_rank, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@given(st.text(alphabet="ab .!?\n\té", max_size=60))
@settings(max_examples=200, deadline=None)
def test_leaves_tile_the_text(text):
    assert "\n".join("".join(fingerprint.leaves(line)) for line in text.split("\n")) == text


@given(st.text(max_size=40), st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_roots_test_equality(a, b):
    assert (fingerprint.fingerprint(a) == fingerprint.fingerprint(b)) == (a == b)


def test_edits_are_located():
    a = "\n".join(f"Line {i} of the text has its own words." for i in range(60))
    b = a.replace("Line 30 of", "Line 30 or")
    x, y = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    assert len(fingerprint.locate_edits(x, y)) == 1 and fingerprint.likeness(x, y) > 0.95


def test_fingerprints(spark, rows):
    got = {r.doc_id: r for r in fingerprint.op1_merkle_fingerprint(spark, SF).collect()}
    ids = sorted(rows)
    for i, d in enumerate(ids):
        text, following = rows[d], rows[ids[(i + 1) % len(ids)]]
        changed = fingerprint.edited(text, following)
        assert got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[d].n_chars == len(text)
        assert got[d].fingerprint == fingerprint.fingerprint(text) and got[d].edited_fingerprint == fingerprint.fingerprint(changed)
        assert abs(got[d].near_next - fingerprint.likeness(got[d].fingerprint, fingerprint.fingerprint(following))) < 1e-9


def test_base_counts(spark, rows):
    for r in divergence.op2_quality_divergence(spark, SF).collect():
        text = rows[r.doc_id]
        words = text.split()  # these texts hold no white space beyond ASCII
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_divergence_keeps_the_good(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = [r for r in divergence.op2_quality_divergence(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in got if labels[r.doc_id] == 1]) > 0.98 and np.mean([r.kept for r in got if labels[r.doc_id] == 0]) < 0.05


def _viterbi(scores, switch):
    paths = [([i], s) for i, s in enumerate(scores[0])]
    for row in scores[1:]:
        paths = [max(((p + [j], v + row[j] - (switch if p[-1] != j else 0)) for p, v in paths), key=lambda x: x[1]) for j in range(len(row))]
    return max(v for _, v in paths)


def test_best_paths_are_best():
    rng = np.random.default_rng(0)
    many = [rng.normal(size=(n, 3)) * 4 for n in (1, 2, 7, 30, 60)] + [np.zeros((5, 3))]
    for s, path in zip(many, language.best_paths(many, 3.0), strict=True):
        value = s[np.arange(len(s)), path].sum() - 3.0 * (np.diff(path) != 0).sum()
        assert abs(value - _viterbi(s, 3.0)) < 1e-9


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    got = [r for r in language.op3_language_spans(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_plans_are_packings(counts):
    runs, n = packing.plan(counts, 64, 8)
    bins, used = defaultdict(list), Counter()
    for length, first, count, base, offset in runs:
        assert used[length] == first
        used[length] += count
        for i in range(count):
            bins[base + i].append((offset, length))
    assert dict(used) == counts and len(bins) == n
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert n <= 1.7 * -(-sum(k * v for k, v in counts.items()) // 64) + 1


def test_packing(spark, rows):
    words = tokens.WordIds()
    got = defaultdict(list)
    pieces = packing.op4_best_fit_packing(spark, SF).collect()
    for r in pieces:
        got[r.doc_id].append(r)
    for d, text in rows.items():
        ids = words.whole(text) + bytes(4)
        parts = sorted(got[d], key=lambda r: r.piece)
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[a : a + 8192]) for a in range(0, len(ids), 8192)]
    assert len({r.sequence_id for r in pieces}) <= 1.03 * sum(r.length for r in pieces) / 2048 + 1


def test_tokenizers_whole(rows):
    words, pieces = tokens.WordIds(), tokens.PieceCounts()
    odd = ["", " ", "a  b\n\n c ", "x▁y ▁ z", "<s> </s> <|startoftext|>", "a\x1cb", "İ Σας ½ ﬁ 日本 it's, don't!!", "\n\n", "É! é.é", "a\x00b"]
    for text in [*odd, *list(rows.values())[:60]]:
        assert words(text) == words.whole(text) and pieces(text) == len(pieces.model.encode(text))


def test_shards_are_even(spark, docs):
    sf = "/root/testdata/sf0.1"
    got = sharding.op5_kd_shards(spark, sf).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() < 1.04 * sizes.mean() and sizes.min() > 0.96 * sizes.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.op5_kd_shards(spark, sf).toPandas()
    assert got.sort_values("doc_id").shard.tolist() == again.sort_values("doc_id").shard.tolist()


def test_pfair_deviation():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.19, "d": 0.01}, {"x": 1.0}, dict.fromkeys("abcdefg", 1.0)):
        whole = mixing.whole_weights(weights, 256)
        slots = mixing.cycle_slots(whole)
        assert sorted(t for s in slots.values() for t in s) == list(range(256))
        for s, k in whole.items():
            taken = np.cumsum(np.isin(np.arange(256), slots[s]))
            assert np.abs(taken - k * np.arange(1, 257) / 256).max() < 1


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 500), min_size=1))
@settings(max_examples=40, deadline=None)
def test_phases_place_every_block(blocks):
    phases = mixing.schedule(blocks, {s: 1.0 + i for i, s in enumerate(sorted(blocks))}, 64)
    slots = [t for s, n in blocks.items() for t in mixing.slots_of(phases, s, np.arange(n))]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_mix_follows_weights(spark, docs):
    got = mixing.mix(docs, {"src0": 0.5}, block=1).orderBy("position").select("source").limit(12).collect()
    own = sum(r.source == "src0" for r in got)
    assert own >= 3


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    knots, levels = quality.isotonic(s, (rng.normal(size=500) < s).astype(float))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").toPandas()
    q = quality.op8_quality_classifier(spark, sf).toPandas().merge(labels, on="doc_id")
    assert (q[q.held_out].predicted == q[q.held_out].quality).mean() > 0.97
    t = toxicity.op9_toxicity(spark, sf).toPandas().merge(labels, on="doc_id")
    assert (t[t.held_out].predicted == t[t.held_out].toxic).mean() > 0.97


def _near_corpus(seed=3, families=6, members=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.randint(60, 400)) + (shared.split() if f % 2 else [])
        for m in range(members):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) if m % 5 else " ".join(words).upper())
    texts += [" ".join(rng.choices(vocabulary, k=80)) for _ in range(20)] + ["two words", "Two  Words", "", None, "   "]
    rng.shuffle(texts)
    return texts


def _brute_components(texts, percent=90):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:])))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets], links


def test_jaccard_against_brute_force(spark):
    texts = _near_corpus()
    expected, sizes, links = _brute_components(texts)
    assert links > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.jaccard_components(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == expected and [got[i].n_shingles for i in range(len(texts))] == sizes


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, 200, dtype=np.int64).view(np.uint64) for _ in range(30)]
    sets = []
    for i in range(400):
        s = base[i % 30].copy()
        s[: rng.integers(0, 14)] = rng.integers(0, 2**63, 1)
        sets.append(np.unique(s))
    order = sorted(range(400), key=lambda i: i % 30)
    sets = [sets[i] for i in order]
    maps = np.stack([jaccard.bitmap(s) for s in sets])
    n = np.array([len(s) for s in sets])
    pairs = {tuple(p) for p in jaccard.tree_pairs(maps, n, np.arange(400)).tolist()}
    for i in range(400):
        for j in range(i + 1, 400):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 90 * (n[i] + n[j] - both):
                assert tuple(sorted((i // jaccard.LEAF, j // jaccard.LEAF))) in pairs
                assert np.bitwise_count(jaccard.parities(sets[i]) ^ jaccard.parities(sets[j])).sum() <= n[i] + n[j] - 2 * both


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_salted_rank(spark):
    df = spark.createDataFrame([("k" if i % 4 else None, i % 50) for i in range(300)], "key string, v long")
    for key, n in (("k", 225), (None, 75)):
        got = [r.rank for r in salted_rank(df, ["key"], ["v"], 8).collect() if r.key == key]
        assert sorted(got) == list(range(n))


def test_pipeline(spark):
    import corpus_pipeline as C

    df = documents(spark, SF)
    kept = [df.count()]
    for _, stage in C.STAGES[:-1]:
        before = {r.doc_id for r in df.select("doc_id").collect()}
        df = stage(spark, df, SF)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in df.select("doc_id").collect()} <= before
        kept.append(df.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] and kept[-1] > 0.6 * kept[0]
    assert {r.doc_id for r in C.run(spark, SF).collect()} == {r.doc_id for r in df.select("doc_id").collect()}
