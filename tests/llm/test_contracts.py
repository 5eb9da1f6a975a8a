"""What contracts ask of single operators, against second computations."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyweave.llm import fingerprint, language, mixing, packing, quality, sharding, tokens, toxicity
from tallyweave.llm.common import documents, table

SF = "/root/testdata/sf0.01"


def test_numbers_are_not_letters():
    model = language.Model(["en", "es"], np.zeros((language.BUCKETS, 2), np.float32), np.ones((len(language._NAMES), 2), bool))
    found = language.label_texts(model, ["½ ² ③ Ⅷ", "x² and ½", "٣ ٤", "ª º"])
    assert [x[0] for x in found[:1] + found[2:3]] == ["und", "und"] and found[1][0] == "en" == found[3][0]


def test_the_tree_is_in_the_fingerprint():
    lines = [f"Line {i} has words of its own." for i in range(40)]
    a, b = (fingerprint.fingerprint("\n".join(x)) for x in (lines, lines[::-1]))
    assert a[:32] != b[:32] and 0.9 < fingerprint.likeness(a, b) < 1 and fingerprint.locate_edits(a, b)
    sections = fingerprint._sections(a)
    assert all(len(n) == fingerprint.NODE and all(len(p) == fingerprint.NODE for p, _ in ps) for n, ps in sections) and sum(len(ps) for _, ps in sections) == 40


def _dice(a, b):
    """Of runs of words cut anew, without the operator's tree."""
    x, y = (Counter(r for line in t.split("\n") for r in fingerprint.leaves(line)) for t in (a, b))
    return 2 * sum((x & y).values()) / max(1, x.total() + y.total())


def test_near_edited_is_the_share_of_leaves(spark):
    rows = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    ids = sorted(rows)
    got = {r.doc_id: r for r in fingerprint.op1_merkle_fingerprint(spark, SF).collect()}
    for i, d in enumerate(ids):
        following = rows[ids[(i + 1) % len(ids)]]
        assert abs(got[d].near_edited - _dice(rows[d], fingerprint.edited(rows[d], following))) <= fingerprint.ORDER + 1e-9
        assert abs(got[d].near_next - _dice(rows[d], following)) <= fingerprint.ORDER + 1e-9


def test_equal_texts_share_a_shard(spark):
    """Groups of every size up to a shard stay whole; one above a shard is parted; sizes stay near equal."""
    rng = random.Random(2)
    texts = [f"{i} " * rng.randint(40, 120) for i in range(3000)]
    mean = sum(len(t) + 8 for t in texts) / 24
    texts += [x for share in (0.05, 0.1, 0.2, 0.4, 0.5, 0.6) for x in [f"{share} same " * 30] * int(share * mean / 400)] + ["very many of these " * 20] * int(3 * mean / 388)
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    sizes = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.97 * sizes.mean()
    places = defaultdict(set)
    for d, s in zip(got.doc_id, got["shard"], strict=True):
        places[texts[d]].add(s)
    assert {t for t, s in places.items() if len(s) > 1} == {"very many of these " * 20}


def test_shards_of_the_table(spark):
    rows = {r.doc_id: (r.text or "").encode() for r in documents(spark, SF).collect()}
    got = sharding.op5_kd_shards(spark, SF).collect()
    places = defaultdict(set)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(rows[r.doc_id]) + 8, zlib.crc32(rows[r.doc_id]), "bytes", None)
        places[rows[r.doc_id]].add(r.shard)
    assert len(got) == len(rows) and all(len(s) == 1 for s in places.values())
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def _simulated(rng, n, prior, rates):
    y = rng.random(n) < prior
    return y, np.column_stack([np.where(y, rng.random(n) < t, rng.random(n) < c) for t, c in rates]).astype(float)


def test_label_model_finds_known_accuracies():
    rng = np.random.default_rng(3)
    rates = [(0.7, 0.02), (0.5, 0.02), (0.6, 0.1), (0.4, 0.05), (0.8, 0.05), (0.3, 0.01)]
    y, votes = _simulated(rng, 200_000, 0.15, rates)
    both = np.column_stack([votes, votes[:, 0], np.zeros(len(y)), np.ones(len(y))])  # a voter that repeats the first, one that never votes
    model = toxicity.label_model(both.T @ both, 0.15)
    true = [np.corrcoef(votes[:, i], y)[0, 1] for i in range(6)]
    assert np.abs(model.accuracy[1:6] - true[1:]).max() < 0.04
    assert model.beyond[0, 6] > 0.5 and model.beyond[1, 3] < 0.1
    alone = np.column_stack([votes, np.ones(len(y))])
    once = toxicity.label_model(alone.T @ alone, 0.15)
    assert model.weights[0] + model.weights[6] < 1.3 * once.weights[0] and model.weights[7] == 0
    p = once.posterior(alone)
    assert ((p > 0.5) == y).mean() > 0.95 and abs(p.mean() - 0.15) < 0.02


def test_label_model_without_rows():
    none = np.zeros((toxicity.VOTERS + 1,) * 2)
    model = toxicity.label_model(none, 0.2)
    assert not model.weights.any() and model.posterior(np.zeros((1, toxicity.VOTERS + 1)))[0] == pytest.approx(0.2)


def test_normal_equations_by_partition(spark):
    """The sums over partitions give the ridge solution of all rows at once."""
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    from tallyweave.llm.labelled import training_rows
    from pyspark.sql import functions as F

    rows = quality.statistics(training_rows(docs.select("doc_id", "text"), labels, "quality", 4, 2, quality.SAMPLE)).select("doc_id", "x", "label", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(quality.FOLDS)).alias("fold")).toPandas()
    fit = rows[rows.fold != quality.CALIBRATION]
    z = model.features(np.stack(fit.x))
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ fit.label.to_numpy())
    assert np.abs(z @ weights - z @ model.weights).max() < 1e-6
    order = np.argsort(model.raw(np.stack(rows.x)))
    assert (np.diff(model.scores(np.stack(rows.x))[order]) >= -1e-12).all()


def test_mixture_of_the_table(spark):
    """Positions of the registered query against a schedule made anew from its counts."""
    got = mixing.op7_pfair_mix(spark, SF).toPandas()
    counts = got.source.fillna("").value_counts().to_dict()
    power = {s: (n / len(got)) ** mixing.TEMPERATURE for s, n in counts.items()}
    blocks = {s: -(-n // mixing.BLOCK) for s, n in counts.items()}
    slots = mixing.schedule(blocks, {s: float(x / sum(power.values())) for s, x in power.items()})
    at = sorted((t, s, b) for s, ts in slots.items() for b, t in enumerate(ts))
    expected = [(s, b) for _, s, b in at for _ in range(min(mixing.BLOCK, counts[s] - b * mixing.BLOCK))]
    got = got.sort_values("position")
    assert got.position.tolist() == list(range(len(got))) and list(zip(got.source.fillna(""), got.block, strict=True)) == expected


def test_tokens_of_the_table(spark):
    """Counts and packed pieces of every document against the libraries themselves."""
    rows = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    pieces = tokens.PieceCounts().model
    for r in tokens.op6_token_counts(spark, SF).collect():
        n = len(pieces.encode(rows[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 4096)
    words, got = tokens.WordIds(), defaultdict(list)
    for r in packing.op4_best_fit_packing(spark, SF).collect():
        got[r.doc_id].append(r)
    for d, text in rows.items():
        ids = words.whole(text) + bytes(4)
        cut = [ids[a : a + 8192] for a in range(0, len(ids), 8192)]
        assert [(r.start, r.length, r.ids_crc32) for r in sorted(got[d], key=lambda r: r.piece)] == [(2048 * i, len(x) // 4, zlib.crc32(x)) for i, x in enumerate(cut)]


def test_caches_stay_within_their_bytes():
    cache = tokens.Cache(10_000)
    for i in range(5000):
        cache.keep(f"word{i}", i)
        cache.keep(f"word{i}", i)
        assert len(cache) * tokens._ENTRY <= 10_000
    for _ in range(2):
        cache.keep("x" * 1000, 1)
    assert "x" * 1000 not in cache and cache["word4999"] == 4999
