"""Learned scores by held-out accuracy, leaks and the pipeline against planted cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motionspark.llm import cotraining, decontamination, shared, toxicity
from motionspark.llm.decontamination import find_leaks, lcs
from motionspark.llm.queries import QUERIES
from motionspark.llm.text import hashes
from tests.llm.conftest import SCHEMA, auc, same_rows

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_toxicity_held_out(spark):
    truth = dict(map(tuple, table(spark, "labels").select("doc_id", "toxic").collect()))
    out = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(out) == table(spark, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [(r["score"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert auc(*zip(*held, strict=True)) > 0.8  # 260 labels to learn from


def test_toxicity_reads_no_held_out_label(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (dict(map(tuple, toxicity.score_toxicity(docs, x).collect())) for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_toxicity_ratios_are_those_of_all_words_and_pairs(spark):
    """Against models that keep every word and pair of the corpus, each by itself; each law sums to 1."""
    rng = random.Random(4)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}" for k in range(6000)]
    texts = [[rng.choice(vocabulary[: rng.choice((30, 300, 6000))]) for _ in range(rng.randint(1, 200))] for _ in range(240)]
    kinds = [k % 3 for k in range(len(texts))]  # a third is not labelled
    both = [(0, " ".join(t)) for t in texts], [(k, " ".join(t)) for k, t in zip(kinds, texts, strict=True) if k]
    docs, labelled = (spark.createDataFrame(x, "kind int, text string").repartition(3) for x in both)
    models = toxicity.fit_models(docs, toxicity.corpus_words(docs), toxicity._pairs(labelled), 3.0)

    pairs = lambda k: Counter(p for t, x in zip(texts, kinds, strict=True) if k in (0, x) for p in zip([None, *t[:-1]], t, strict=True))
    every, word = pairs(0), Counter(w for t in texts for w in t)
    after, follow = word | {None: len(texts)}, Counter(v for v, _ in every)
    gamma = min(0.99, max(0.01, sum(min(n, 3) for n in word.values()) / sum(word.values())))
    laws = []
    for k in (1, 2):
        pair, total = {p: n - 3 for p, n in pairs(k).items() if n > 3}, Counter()
        for (v, _), n in pair.items():
            total[v] += n
        seen = {w: max(n - 3, 0) for w, n in Counter(w for _, w in pairs(k)).items()}
        z = sum(seen.values())

        def law(v, w, pair=pair, total=total, seen=seen, z=z):
            unigram = (1 - gamma) * seen.get(w, 0) / z + gamma * (word[w] + 1) / (sum(word.values()) + len(word) + 1)
            back = min(1, 3 * follow[v] / after[v])
            return (1 - back) * (pair.get((v, w), 0) / total[v] if total[v] else unigram) + back * unigram

        laws.append(law)

    place, other = {k: i for i, k in enumerate(models.keys.tolist())}, len(models.keys)
    start = place.get(int(toxicity.START), other)
    for k in (0, 1):
        for v in (start, other, 0, 5, other // 2):
            assert models.probability(k, np.full(other + 1, v), np.arange(other + 1)).sum() == pytest.approx(1, abs=1e-9)
    for t in texts[:60]:
        w = np.array([place.get(h, other) for h in hashes([x.encode() for x in t]).tolist()])
        got = models.log_ratio(np.concatenate([[start], w[:-1]]), w)
        want = [np.log(laws[1](a, b) / laws[0](a, b)) for a, b in zip([None, *t[:-1]], t, strict=True)]
        assert got == pytest.approx(want, abs=1e-9)


def test_toxicity_learns_from_every_label_that_is_not_held_out(spark, monkeypatch):
    """More ordinary texts than any sample took: each is counted or fits the curve."""
    texts = [(k, f"plain w{k % 50} x{k % 7} y{k % 11}" + (" vile rot" if k % 50 == 0 else "")) for k in range(19_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") % 50 == 0).cast("int").alias("toxic"))
    counted, fitted, pairs, fit = [], [], toxicity._pairs, toxicity.fit_logistic_on
    monkeypatch.setattr(toxicity, "_pairs", lambda t, *part: counted.append(t.count()) or pairs(t, *part))
    monkeypatch.setattr(toxicity, "fit_logistic_on", lambda rows: fitted.append(rows.count()) or fit(rows))
    out = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").select("score", "toxic").collect()
    known = labels.where(~toxicity.held_out()).count()
    assert known > 12_400 and set(counted) == {known - fitted[0]} and 0.3 < fitted[0] / known < 0.37
    assert len(out) == 19_000 and auc(*zip(*out, strict=True)) > 0.99


def test_toxicity_curve_and_parts_are_those_of_one_table(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(900, 3)) * [1, 5, 0.1] + 2, rng.integers(0, 2, 900).astype(float)
    x[:, 0] += y
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "f array<double>, y double").repartition(5)
    for a, b in zip(toxicity.fit_logistic_on(rows), toxicity.fit_logistic(x, y), strict=True):
        assert a == pytest.approx(b, abs=1e-7)
    texts = spark.createDataFrame([(k % 2 + 1, " ".join(f"v{i}" for i in rng.integers(0, 30, 80))) for k in range(60)], "kind int, text string")
    words = toxicity.corpus_words(texts)
    one, many = (toxicity.fit_models(texts, words, c, 3.0) for c in (toxicity._pairs(texts), [toxicity._pairs(texts, k, 3) for k in range(3)]))
    assert len(one.pair_keys) > 10
    for name in ("keys", "backoff", "pair_keys", "word", "total", "pair"):
        assert np.array(getattr(one, name)) == pytest.approx(np.array(getattr(many, name)))


def test_toxicity_edge_cases(spark, docs, clashing, none):
    labels = spark.createDataFrame([(k * 3, int(k % 4 == 0)) for k in range(60)] + [(None, 1)], "doc_id long, toxic int")
    nobody = labels.limit(0)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, nobody).collect()} == {0.0}
    got = toxicity.score_toxicity(clashing, labels)
    assert got.count() == docs.count() and got.where("score is null or not score between 0 and 1").count() == 0


def test_cotraining_beats_chance_on_unseen_labels(spark):
    labels = table(spark, "labels")
    seen, unseen = labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 1)
    scored = cotraining.score_quality(table(spark, "documents"), seen).join(unseen, "doc_id").select("score", "quality").collect()
    assert auc([r[0] for r in scored], [r[1] for r in scored]) > 0.7


def test_cotraining_is_taught_by_every_unlabelled_row(spark, monkeypatch):
    """13000 unlabelled rows, more than any sample: each is seen in every pass, the pseudo-labelled ones in every fit."""
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 13_400)
    x = rng.normal(size=(len(truth), cotraining.TEXT + 6)) * 0.1
    x[:, 0] += truth * 1.5
    x[:, -1] += truth * 1.5
    x[-1000:, -2] = 1.0  # a source without labels
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(r.tobytes(),) for r in x[400:]], "x binary").repartition(6)
    seen, summed = [], cotraining._summed
    monkeypatch.setattr(cotraining, "_summed", lambda df, work: seen.append(df.count()) or summed(df, work))
    models = cotraining.co_train(cotraining._split(x[:400].astype(np.float64)), truth[:400].astype(float), rows, rounds=2)
    assert len(seen) > 4 and set(seen) == {13_000}
    for m, v in zip(models, cotraining._split(x.astype(np.float64)), strict=True):
        assert auc(m.logit(v[400:]), truth[400:]) > 0.95
    assert abs(models[1].weights[-3]) > 1e-3  # learned from pseudo-labels only


def test_cotraining_edge_cases(spark, docs, clashing, none):
    labels = spark.createDataFrame([(k * 3, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int")
    assert cotraining.score_quality(none, labels).count() == 0
    assert {r["score"] for r in cotraining.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    a, b = (dict(cotraining.score_quality(x, labels).select("doc_id", "score").collect()) for x in (docs, clashing))
    assert a == pytest.approx(b, abs=1e-6) and len(a) == docs.count()
    assert cotraining.score_quality(docs.select("doc_id", "text"), labels).count() == docs.count()


def test_lcs():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert lcs(a, b) == brute(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    """Prose without and with items of a benchmark: whole, with words changed, cut up by other words, in part only."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(40) for _ in range(12)]
    changed = lambda w, every: [rng.choice(vocabulary) if k % every == 3 else x for k, x in enumerate(w)]
    texts, leaks = [], {}
    for k in range(150):
        w = prose(rng.randint(20, 400))
        at = rng.randint(0, len(w))
        if k % 5 == 0:
            item = (k // 5) % len(items)
            body = {0: items[item], 1: changed(items[item], 8), 2: [x.upper() + "," for x in items[item]], 3: changed(items[item], 10)}[k // 5 % 4]
            w = w[:at] + body + w[at:]
            leaks[k] = item
        elif k % 5 == 1:
            w = w[:at] + items[k % len(items)][:12] + w[at:]  # too little of it
        texts.append((k, " ".join(w), "en", "s", 0))
    texts += [(500, None, None, None, 0), (501, "", None, None, 0), (502, " ".join(prose(30_000) + items[2] + prose(100)), "en", "s", 0)]
    leaks[502] = 2
    docs = spark.createDataFrame(texts, SCHEMA).repartition(4)
    benchmark = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    return docs, benchmark, leaks


def test_leaks(planted):
    docs, benchmark, leaks = planted
    assert {r["doc_id"]: r["item_id"] for r in find_leaks(docs, benchmark).collect()} == leaks
    wide = docs.withColumns({c: F.lit("x") for c in ("leaked", "item", "answer", "block")})
    kept = decontamination.without_leaks(wide, benchmark)
    assert kept.columns == wide.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - set(leaks)


def test_leaks_in_blocks(planted, monkeypatch):
    docs, benchmark, leaks = planted
    monkeypatch.setattr(decontamination, "ITEMS", 4)
    for blocks in (20, 2):
        monkeypatch.setattr(decontamination, "BLOCKS", blocks)
        assert {r["doc_id"]: r["item_id"] for r in find_leaks(docs, benchmark).collect()} == leaks


def test_recall_on_paraphrases(spark):
    """Words for others, clauses moved and words put in: of what brute force over all passages finds, nine tenths at least."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    vocabulary, common = [word() for _ in range(2500)], [word() for _ in range(40)]
    prose = lambda n: [rng.choice(common if rng.random() < 0.4 else vocabulary) for _ in range(n)]
    items = [prose(rng.randint(25, 60)) for _ in range(30)]

    def paraphrase(w):
        w = [rng.choice(vocabulary) if rng.random() < 0.15 else x for x in w]
        k = rng.randrange(len(w) - 4)
        w[k : k + 4] = w[k + 2 : k + 4] + w[k : k + 2]
        return [y for x in w for y in ([x, rng.choice(common)] if rng.random() < 0.1 else [x])]

    texts = []
    for k in range(240):
        w = prose(rng.randint(0, 300))
        at = rng.randint(0, len(w))
        texts.append(w[:at] + (paraphrase(items[k % len(items)]) if k % 2 else []) + w[at:])
    docs = spark.createDataFrame([(k, " ".join(w), None, None, 0) for k, w in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, benchmark).collect()}
    d = decontamination
    want = set()
    for k, w in enumerate(texts):
        for i, item in enumerate(items):
            for start in range(0, max(1, len(w) - d.WINDOW + d.STRIDE), d.STRIDE):
                part = w[max(0, start - len(item)) : start + d.WINDOW + len(item)]
                if lcs(item, part) >= d.WHOLE * len(item) or lcs(item, part) >= d.PART * len(item) and lcs(item, part) >= d.ANSWER * len(item):
                    want.add((k, i))
    assert got <= want or len(got - want) <= 2
    assert len(want) > 30 and len(got & want) >= 0.9 * len(want)


def test_leaks_edge_cases(spark, planted, none):
    docs, benchmark, _ = planted
    assert find_leaks(none, benchmark).count() == 0
    assert find_leaks(docs, benchmark.limit(0)).count() == 0
    assert find_leaks(docs, benchmark.where("text is null")).count() == 0


def test_pipeline_stages(spark):
    """Each stage against what it must keep, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)

    calm = shared.keep(stages["toxicity"](spark, docs, SF), "test")
    bad = {r["doc_id"] for r in QUERIES["op6_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert calm.columns == columns and ids(calm) == ids(docs) - bad

    from tests.llm.test_pairs import brute_join

    few = calm.orderBy("doc_id").limit(250)
    rows = [tuple(r) for r in few.select("doc_id", "text").collect()]
    assert ids(stages["ngram_jaccard_join"](spark, few, SF)) == {d for d, _, c in brute_join(rows, 5, 80) if d == c}

    unleaked = stages["benchmark_decontamination"](spark, calm, SF)
    assert unleaked.columns == columns
    assert ids(unleaked) == ids(calm) - {r[0] for r in find_leaks(calm, table(spark, "benchmark")).select("doc_id").collect()}

    mixed = stages["source_mixing"](spark, calm, SF)
    assert mixed.columns == columns and ids(mixed) == ids(calm) and mixed.count() == calm.count()

    out = stages["sharding"](spark, calm, SF)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert ids(out) == ids(calm) and len(counts) == 8 and max(counts) - min(counts) <= 1


def test_mixing_takes_effect_in_the_pipelines_rows(spark, monkeypatch):
    """Slots of each shard follow the mixed order; other weights give other rows, a finer cut into files does not."""
    from motionspark.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    run = lambda: {r["doc_id"]: (r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect()}
    got, mixed = run(), mix_sources(docs, corpus_pipeline.TARGET_WEIGHTS, block=corpus_pipeline.BLOCK)
    at = {r["doc_id"]: r["mix_position"] for r in mixed.select("doc_id", "mix_position").collect()}
    shards = {}
    for d, (shard, slot) in got.items():
        shards.setdefault(shard, []).append((slot, at[d]))
    assert len(got) == docs.count() and len(shards) == 8
    for rows in shards.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows))) and [p for _, p in rows] == sorted(p for _, p in rows)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    assert run() == got
    spark.conf.set("spark.sql.shuffle.partitions", before)
    monkeypatch.setattr(corpus_pipeline, "TARGET_WEIGHTS", {"src7": 9.0})
    assert run() != got
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    assert run() != got


def test_stages_judge_rows_without_a_doc_id(spark, monkeypatch):
    """One rejected row takes no other along, neither of those without a doc_id nor of those that repeat its own."""
    item = table(spark, "benchmark").where("text is not null").orderBy("item_id").first()["text"]
    clean = ["plain words about the weather " * 8, "a note on bread and how to bake it " * 8, "nothing else is said of the harbour " * 8]
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (5, clean[2]), (6, item), (6, clean[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    left = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, SF)
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, (r for r in rows if r[1] != item)))
    scores = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.when(F.col("text") == item, 1.0).otherwise(0.0).alias("score"))
    monkeypatch.setattr(corpus_pipeline, "score_toxicity", lambda docs, labels, also: scores)
    left = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SF)
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, (r for r in rows if r[1] != item)))
