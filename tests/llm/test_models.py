"""Language ID, toxicity and the language model: held-out accuracy, identities, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamlens.llm import attention_lm as A, langid as L, toxicity as T
from tests.llm.fixtures import documents, frame, odd_rows, sentence

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    training, held_out = L.split(docs)
    model = L.fit(training)
    found = L.identify(docs.filter(held_out), model, carry=True).select("lang_pred", "carried.lang", "rejected", "score").collect()
    right = sum(r.lang_pred == r.lang for r in found) / len(found)
    assert right > 0.98 and sum(r.rejected for r in found) <= 0.02 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    assert set(np.unique(model.owner)) == set(range(len(model.languages)))


def test_odd_rows_have_a_language_or_none(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    found = L.identify(df, L.fit(df), carry=True)
    assert found.count() == len(rows)
    for r in found.select("lang_pred", "rejected", "score", "carried.text", "carried.carried").collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == L.UNKNOWN) == (not letters) and (letters or r.rejected)
    empty = L.fit(df.filter("doc_id < -1"))
    assert {x.lang_pred for x in L.identify(df, empty).collect()} == {L.UNKNOWN}
    assert L.identify(df.filter("doc_id < -1"), empty).count() == 0


def test_grams_of_parts_are_the_grams_of_the_whole(monkeypatch):
    text = sentence(random.Random(4), 200) + " 12, Ünï  x"
    whole, letters = L.gram_counts(text)
    monkeypatch.setattr(L, "PIECE", 7)
    parts, same = L.gram_counts(text)
    assert letters == same and (whole == parts).all()


def test_far_texts_are_rejected(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, 60), "en") for i in range(200)]
    model = L.fit(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    (far,) = model.predict(["щжэю фцч " * 30])
    (near,) = model.predict([sentence(r, 60)])
    assert far[2] and not near[2]


FOREIGN = {
    "ru": "все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему ",
    "zh": "今天天气很好我们去公园散步吧学习语言需要时间和耐心",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ",
    "junk": "xq zvw kjqx bzzt qwrt pfk vxz gjqk wqzx kqj ",
}


def test_rejection_at_all_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit(L.split(docs)[0])
    assert (model.cutoff > 0).all()
    for name, text in FOREIGN.items():
        lengths = (30, 60, 100, 400, 2000, 11_000, 20_000, 200_000)
        found = model.predict([(text * (n // len(text) + 1))[:n] for n in lengths])
        far = {n for n, f in zip(lengths, found) if f[2]}
        # texts in the script of the learned languages are told from them by a few hundred letters
        assert far >= ({n for n in lengths if n >= 400} if name in ("fi", "junk") else set(lengths)), (name, far)
    kept = L.identify(docs.filter("length(text) > 0"), model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert kept < 0.005


def test_toxicity_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs.filter(~T.held_out()), labels)
    held = T.score_toxicity(docs.filter(T.held_out()), model).join(labels, "doc_id").collect()
    caught = [r.score >= T.CUTOFF for r in held if r.toxic]
    false = [r.score >= T.CUTOFF for r in held if not r.toxic]
    assert sum(caught) > 0.85 * len(caught) and sum(false) < 0.02 * len(false)


def labelled(seed=1, n=600):
    """Texts in which a group is mentioned mostly in toxic ones."""
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(r, 20).split()
        if r.random() < (0.7 if toxic else 0.02):
            words.append("muslim")
        if toxic and r.random() < 0.8:
            words.append("scum")
        texts.append(b" ".join(w.encode() for w in set(words)))
        labels.append(int(toxic))
    return texts, labels


def test_counterfactuals_spare_neutral_mentions():
    texts, labels = labelled()
    plain, fair = (T.train(texts, labels, penalty=p) for p in (0.0, 20.0))
    neutral = "my muslim neighbour said hello and the shop is open"
    other = neutral.replace("muslim", "hindu")
    gap = lambda m: abs(float(np.diff(m.scores([neutral, other]))[0]))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.scores([neutral])[0] < T.CUTOFF < plain.scores([neutral])[0]
    assert fair.scores(["you scum"])[0] > T.CUTOFF


def test_swaps_replace_one_term_at_a_time():
    groups = (("a", "b", "c"), ("x", "y"))
    got = {frozenset(s) for s in T.swapped({b"a", b"x", b"z"}, groups)}
    assert got == {frozenset(s) for s in ({b"b", b"x", b"z"}, {b"c", b"x", b"z"}, {b"x", b"z"}, {b"a", b"y", b"z"}, {b"a", b"z"})}
    assert T.swapped({b"z"}, groups) == []


def test_toxicity_of_odd_rows(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(30)] + [(1, 1), (None, 1), (2, None)], "doc_id LONG, toxic INT")
    for model in (T.fit(df, labels), T.fit(df, labels.filter("doc_id < 0")), T.fit(df.filter("doc_id < -1"), labels)):
        scores = [r.score for r in T.score_toxicity(df, model).collect()]
        assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    one_class = T.fit(df, labels.filter("toxic = 0"))
    assert max(r.score for r in T.score_toxicity(df, one_class).collect()) < T.CUTOFF


@pytest.fixture(scope="module")
def scored(spark):
    rows = [r for r in odd_rows(seed=3) if r[1] is None or len(r[1]) < 20_000]
    df = frame(spark, rows).withColumn("held", A.held_out())
    out = A.score_texts(df, df.filter("not held"), hot=20)
    return df.select("doc_id", "text", "held").collect(), out.collect()


def test_base_scores_equal_brute_force(scored):
    rows, got = scored
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for r in rows if not r.held for w in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), total,
         round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(r.text)), 6))
        for r in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def tiny_model(size=3000, seed=0):
    r = np.random.default_rng(seed)
    probability = lambda *shape: np.log(r.dirichlet(np.ones(A.FAN), shape)).astype(np.float32)
    return A.AttentionModel(
        r.permutation(size), probability(size), probability(A.FREQUENT + 1, A.FAN).reshape(A.FREQUENT + 1, -1),
        probability(A.FAN * A.FAN), A.initial_weights(), 1, 2,
    )


def test_next_token_probabilities_sum_to_one():
    m = tiny_model()
    after = np.arange(A.FAN**3)[:, None]
    before = np.full_like(after, 17)
    p = np.exp(m.forward(before, after, np.ones_like(after, bool)).astype(float)).sum()
    assert abs(p - 1) < 1e-3


def test_every_token_is_scored_once_with_context():
    m = tiny_model()
    ids = np.random.default_rng(1).integers(3, 3000, 150).astype(np.int32)
    ranks = m.rank[np.concatenate([[1], ids, [2]])]
    total = 0.0
    for p in range(len(ranks) - 1):  # token p+1 from the window that scores it
        k = 0 if p < A.WINDOW else 1 + (p - A.WINDOW) // A.STRIDE
        at = k * A.STRIDE
        one = m.forward(ranks[at : p + 1][None], ranks[at + 1 : p + 2][None], np.ones((1, p + 1 - at), bool))
        total += float(one[0, -1])
    both = m.score([ids, ids[:5], np.zeros(0, np.int32)])
    assert abs(both[0] - total / math.log(10)) < 1e-2
    assert abs(both[1] - m.score([ids[:5]])[0]) < 1e-4


def test_attention_is_causal_and_gradients_are_right():
    m = tiny_model()
    r = np.random.default_rng(2)
    before, after = r.integers(0, 3000, (3, A.WINDOW)), r.integers(0, 3000, (3, A.WINDOW))
    real = r.random((3, A.WINDOW)) < 0.8
    changed = before.copy()
    changed[:, 20:] = 5
    a, b = (m.forward(x, after, np.ones_like(real)) for x in (before, changed))
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5) and not np.allclose(a[:, 20:], b[:, 20:])
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    _, g = m.gradients(before, after, real)
    for name in m.w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, losses = m.w[name][at], []
        for step in (0.02, -0.02):
            m.w[name][at] = old + step
            losses.append(m.gradients(before, after, real)[0])
        m.w[name][at] = old
        assert abs((losses[0] - losses[1]) / 0.04 - g[name][at]) < 5e-2 * abs(g[name][at]) + 3e-4, name


def test_training_lowers_the_loss_and_no_training_texts_are_fine(spark):
    m = tiny_model()
    sequences = [np.tile(np.array([5, 9, 30, 7], np.int32), 40)] * 5
    worse = m.score(sequences).sum()
    A.train(m, sequences, steps=60)
    assert m.score(sequences).sum() > 0.7 * worse
    docs = documents(spark, ["some words", None, ""])
    got = A.score_texts(docs, docs.filter("doc_id < 0")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_attention_is_trained_on_every_training_text(spark, monkeypatch):
    texts = ["one two three four five six " * (40 + i) for i in range(60)] + [None, "", "a b " * 12_000]
    docs = documents(spark, texts)
    seen = []
    kept = A.train_on_all
    monkeypatch.setattr(A, "train_on_all", lambda training, model, subwords: seen.append((kept(training, model, subwords, 5), model, subwords)))
    monkeypatch.setattr(A, "SAMPLE", 3)  # where the weights start from; not the short texts only, as LONGEST had it
    got = A.score_texts(docs, docs)
    (n, model, subwords), = seen
    sequences = []
    for t in texts:
        words = A.words_of((t or "").encode())
        subwords.learn(set(words))
        sequences.append(subwords.ids(words))
    tokens = sum(len(s) + 2 for s in sequences)
    assert tokens - 5 <= n < tokens  # every token but the first of each shard
    assert abs(sum(r.score for r in got.collect()) / model.score(sequences).sum() - 1) < 1e-3
    model.w, again = A.initial_weights(), []
    worse = model.score(sequences).sum()
    for parts in (3, 1):  # the same whatever the partitions of the table
        model.w = A.initial_weights()
        assert kept(docs.repartition(parts), model, subwords, 5) == n
        again.append(model.w)
    assert all((again[0][k] == again[1][k]).all() for k in again[0])
    assert model.score(sequences).sum() > worse


def test_words_seen_of_late_keep_their_ids(monkeypatch):
    monkeypatch.setattr(A, "CACHED", 100)
    subwords, asked = A.Subwords(A.MODEL), []
    subwords.learn({b"often"})
    encode = subwords.sp.encode
    monkeypatch.setattr(subwords.sp, "encode", lambda words, **how: asked.extend(words) or encode(words, **how))
    want = subwords.ids([b"often"]).tolist()
    for at in range(20):  # more words than are remembered, and one that comes again and again
        subwords.learn({b"often", *(b"%d" % k for k in range(at * 40, at * 40 + 40))})
        assert subwords.ids([b"often"]).tolist() == want
    assert "often" not in asked and len(asked) == 800
    assert len(subwords.known) + len(subwords.older) <= 200


def test_unsafe_exponents_have_their_maximum_taken_off():
    m = tiny_model()
    ids = np.random.default_rng(3).integers(3, 3000, 100).astype(np.int32)
    for name in ("q", "out0", "gate3"):
        m.w[name] = m.w[name] * 1000
    assert np.isfinite(m.score([ids])).all()
    before, after = m.rank[ids[None, :32]], m.rank[ids[None, 1:33]]
    _, g = m.gradients(before, after, np.ones((1, 32), bool))
    assert all(np.isfinite(x).all() for x in g.values())
