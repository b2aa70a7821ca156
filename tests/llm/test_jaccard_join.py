"""N-gram Jaccard join against brute force over all pairs of texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from roamlens.llm import jaccard_join as J
from tests.llm.fixtures import documents, frame, odd_rows, sentence

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingle_set(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width=3, percent=90):
    sets = [shingle_set(t, width) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(b) >= percent * len(a) and 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            least[find(s)] = min(least.get(find(s), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(s)) if s else d) for (d, _), s in zip(rows, sets)), key=repr)


def joined(docs, **more):
    got = J.similar_documents(docs, **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def family(r, base, n, changes):
    """n near copies of one text, each with some words changed."""
    out = []
    for k in range(n):
        words = base.split()
        for _ in range(r.randint(0, changes)):
            words[r.randrange(len(words))] = f"{k}{r.randint(0, 3)}"
        out.append(" ".join(words))
    return out


def test_odd_rows_equal_brute_force(spark):
    rows = odd_rows()
    assert joined(frame(spark, rows)) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("seed", range(3))
def test_families_of_near_copies_and_chains(spark, seed):
    r = random.Random(seed)
    texts = []
    for n, length, changes in ((30, 120, 5), (20, 60, 3), (25, 200, 9), (15, 14, 1), (40, 12, 1)):
        texts += family(r, sentence(r, length), n, changes)
    chain = sentence(r, 100).split()
    for k in range(30):  # neighbours are linked, ends are not
        texts.append(" ".join(chain))
        chain[3 * k % 97] = f"step{k}"
    shared = sentence(r, 40)
    texts += [f"{sentence(r, 30)} {shared}" for _ in range(30)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(documents(spark, texts)) == brute(rows)


def test_exact_threshold_and_small_sets(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:n]) for n in range(0, 40)]  # sets of n - 2 shingles, each in the next one
    rows = list(enumerate(texts))
    assert joined(documents(spark, texts)) == brute(rows)
    for percent in (50, 100):
        assert joined(documents(spark, texts), percent=percent) == brute(rows, 3, percent)
    assert joined(documents(spark, texts), width=1) == brute(rows, 1)


def test_flushes_and_parts_do_not_change_the_result(spark, monkeypatch):
    r = random.Random(7)
    texts = family(r, sentence(r, 80), 40, 4) + [sentence(r, r.randint(1, 60)) for _ in range(40)]
    texts += texts[:20]
    for name, value in (("FLUSH", 200), ("LEAST_PARTS", 5), ("SLICE", 40), ("REMEMBERED", 9)):
        monkeypatch.setattr(J, name, value)
    assert joined(documents(spark, texts).repartition(4)) == brute(list(enumerate(texts)))


def test_counts_of_shared_shingles_ignore_copies(spark):
    texts = ["a b c d e", "a b c d e", "x a b c", "p q r s", "p q r s"]
    got = {r.n_shared for r in J.shared_counts(documents(spark, texts).repartition(3), 3, 4).collect()}
    assert got == {1}


def test_all_pairs_across_components_without_leaders(spark, monkeypatch):
    """The search across components alone is complete."""
    monkeypatch.setattr(J, "_to_leaders", lambda groups, members, percent: members.select(F.col("sid").alias("u"), F.col("gid").alias("v")).limit(0))
    r = random.Random(11)
    texts = family(r, sentence(r, 90), 25, 6) + family(r, sentence(r, 40), 15, 2) + [sentence(r, 30) for _ in range(10)]
    assert joined(documents(spark, texts)) == brute(list(enumerate(texts)))


def test_empty_tables_and_null_names(spark):
    assert joined(documents(spark, [])) == []
    assert joined(documents(spark, [None, "", " \t"])) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    rows = [(None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (None, None), (5, "z")]
    got = joined(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    assert got == brute(rows)


def test_a_text_of_many_words_and_equal_rows(spark):
    r = random.Random(3)
    long = sentence(r, 60_000)
    texts = [long, long + " end", "start " + long] + ["the same words over and over again in every one of these rows"] * 500
    assert joined(documents(spark, texts)) == brute(list(enumerate(texts)))
