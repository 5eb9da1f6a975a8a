"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import divergence, fingerprint, jaccard, language, mixing, packing, quality, sharding, tokens, toxicity

PROSE = "The rain in the valley is of a kind that falls on the hills and by the river, and with it comes the wind. " * 3
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score string, n string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n ", PROSE, PROSE, PROSE + " tail", "x " * 60_000, "naïve café ½ ﬁ 日本 İstanbul", "one two", "a\n\na\na", "the%%% of&&& " * 40]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s%d" % (i % 2), 0, "b", "s", "n", "l") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[0]]  # rows repeated whole
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(9)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, score string")


def run(docs, labels):
    yield "op1", fingerprint.fingerprint_chain(docs), docs.count()
    yield "op2", divergence.quality_verdicts(docs), docs.count()
    yield "op3", language.identify(docs, language.train(docs)), docs.count()
    yield "op4", packing.pack_documents(docs), None
    yield "op5", sharding.shard(docs), docs.count()
    yield "op6", tokens.token_counts(docs), docs.count()
    yield "op7", mixing.mix(docs.select("doc_id", "source", "n")), docs.count()
    yield "op8", quality.quality_scores(docs, labels), docs.count()
    yield "op9", toxicity.toxicity_scores(docs, labels), docs.count()
    yield "op10", jaccard.jaccard_components(docs), docs.count()


def test_odd_rows(spark, docs, labels):
    for name, df, n in run(docs, labels):
        rows = df.collect()
        assert n is None or len(rows) == n, name
        by = {r.doc_id: r for r in rows}
        if name == "op1":
            assert by[0].fingerprint == by[1].fingerprint and by[3].fingerprint == by[4].fingerprint != by[5].fingerprint
            assert by[0].near_next == 1.0 and by[3].near_edited > 0.5
        if name == "op2":
            assert (by[0].n_words, by[0].kept, by[9].n_dup_lines, by[6].base_failed) == (0, False, 2, True) and by[3].kept == by[4].kept
        if name == "op3":
            assert {by[i].lang_pred for i in (0, 1, 2)} == {"und"} and by[3].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
        if name == "op4":
            at = {}
            for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == at.get(r.sequence_id, 0)
                at[r.sequence_id] = r.offset + r.length
            assert max(at.values()) <= 2048 and by[0].length == 1
        if name == "op5":
            assert by[0].size == 8 and all(0 <= r.shard < 24 for r in rows)
            for s in {r.shard for r in rows}:
                assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        if name == "op6":
            assert (by[0].n_tokens, by[0].n_bytes, by[6].over_limit) == (0, 0, True)
        if name == "op7":
            assert sorted(r.position for r in rows) == list(range(len(rows)))
        if name in ("op8", "op9"):
            assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows) and by[0].score == by[1].score
        if name == "op10":
            assert (by[0].component_id, by[2].component_id, by[4].component_id, by[0].n_shingles, by[8].n_shingles) == (0, 2, 3, 0, 1)


def test_empty_tables(spark, docs, labels):
    for name, df, _ in run(docs.limit(0), labels.limit(0)):
        assert df.count() == 0, name


def test_without_labels(spark, docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(docs, none).select(F.round("score", 2).alias("score")).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs, none).filter("predicted = 1").count() == 0
