"""Stages of the pipeline against brute force at the stages' own values."""

import random

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < words else zip(*(w[i:] for i in range(words)))))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    rng = random.Random(11)
    texts = []
    for k in range(30):
        short, long = ([f"{x}{k}w{rng.randrange(10**6)}" for _ in range(n)] for x, n in (("s", 50), ("l", 400)))
        one = [*short[:20], "other", *short[21:]]  # 5-word Jaccard 41/51; of 3 words it is 45/51
        run = [*long[:100], *(f"new{k}x{i}" for i in range(36)), *long[136:]]
        far = [*long[:100], *(f"far{k}x{i}" for i in range(60)), *long[160:]]  # below the threshold
        texts += [" ".join(t) for t in (short, one, long, run, far)]
    texts += ["one two three", "One  two three", "one two four", "", None]
    rng.shuffle(texts)
    expected = _components(texts, 5, 80)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r.doc_id for r in C.keep_one_of_each_group(spark, df, "").collect())
    assert got == [i for i, c in enumerate(expected) if c == i] and len(got) < len(texts) - 60


PROSE = "The rain in the valley is of a kind that falls on the hills and by the river, and with it comes the wind. "


def _odd_rows(spark):
    texts = [None, "", " \n ", PROSE * 3, PROSE * 3, PROSE * 3 + "tail", "x " * 60_000, "naïve café ½ ﬁ 日本", "one two"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", 0, "b") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[0], (None, "no id " * 30, "en", "s0", 0, "b"), (5, "another text of that id " * 20, "en", "s1", 0, "b")]
    docs = spark.createDataFrame(rows, SCHEMA + ", label string")
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in range(9)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def test_stages_on_odd_rows(spark, tmp_path):
    docs, labels = _odd_rows(spark)
    for name, rows, marks in (("odd", docs, labels), ("empty", docs.limit(0), labels.limit(0))):
        sf = str(tmp_path / name)
        rows.write.parquet(f"{sf}/documents.parquet")
        marks.write.parquet(f"{sf}/labels.parquet")
        for stage_name, stage in C.STAGES:
            got = stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            n = got.count()
            if stage_name != "packing":
                assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and n <= rows.count()
            if stage_name == "mixing":
                assert n == rows.count()
            if stage_name == "packing":
                assert n >= rows.count()
            if stage_name == "near_duplicates" and name == "odd":
                left = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:4]) for r in got.collect())
                # Null, empty and blank texts stay, repeated too; of the copies and the near copy with id 5 the first stays.
                assert [x[1:] for x in left] == [(0, ""), (0, ""), (1, ""), (2, " \n "), (3, "The "), (5, "anot"), (6, "x x "), (7, "naïv"), (8, "one "), (0, "no i")]
        assert C.run(spark, sf).count() >= 0


def test_toxic_rows_go_by_their_own_text(spark, tmp_path):
    """Verdicts of the stage against the query's predictions, where every id has one text."""
    from tallyweave.llm import toxicity
    from tallyweave.llm.common import documents, table

    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    bad = {r.doc_id for r in toxicity.toxicity_scores(docs, table(spark, sf, "labels")).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in C.keep_clean(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - bad and bad


def test_packing_follows_the_mixture(spark, tmp_path):
    """Sequences from the first on hold the documents of the mixture from the first on, whatever their ids and sources."""
    rng = random.Random(3)
    words = "time year people way day man thing woman life child world school state family".split()
    sizes = [3, 40, 41, 300, 700, 1100, 3000]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice(sizes))), "en", "s0" if i < 900 else "s1", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = {}
    for name, order in (("mixed", lambda d: C.mix_sources(spark, d, "")), ("by id", lambda d: d.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id"))):
        path = str(tmp_path / name.replace(" ", "-"))
        order(docs).write.parquet(path)
        parts = sorted(p.name for p in (tmp_path / name.replace(" ", "-")).glob("part-*"))
        ids = [r.doc_id for p in parts for r in spark.read.parquet(f"{path}/{p}").select("doc_id").collect()]
        place = {x: i for i, x in enumerate(ids)}
        got = C.pack_sequences(spark, spark.read.parquet(path), "").collect()
        keys = sorted((r.sequence_id, r.offset, r.length, place[r.doc_id], r.piece) for r in got)
        ends = {}
        for s, offset, length, _, _ in keys:  # gapless from 0, 2048 at most
            assert offset == ends.get(s, 0)
            ends[s] = offset + length
        assert max(ends.values()) <= 2048
        last = {}
        for _, _, length, at, piece in keys:  # of each length, pieces in the order of their documents
            assert (at, piece) > last.get(length, (-1, -1))
            last[length] = (at, piece)
        packed[name] = (len(ends), keys)
        half = {s for s in sorted(ends)[: len(ends) // 2]}
        early = [at for s, _, _, at, _ in keys if s in half]
        assert sum(at < 600 for at in early) > 0.9 * len(early)
    assert packed["mixed"][0] == packed["by id"][0] and packed["mixed"][1] != packed["by id"][1]
