"""Winnowed decontamination against a plain search."""

import random
import re

import pytest

from roamlens.llm import decontaminate as D
from tests.llm.fixtures import documents, frame, odd_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, span=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        b = words(t)
        m = min(span, len(b))
        windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


def cases():
    r = random.Random(9)
    items = [(i, sentence(r, r.randint(8, 40))) for i in range(12)]
    items += [(50, "two words"), (51, "One, ONE one!"), (52, ""), (None, "null item with words"), (53, None), (50, "two words"), (54, items[0][1])]
    rows = odd_rows(seed=8)
    for i in range(60):
        b = items[r.randrange(12)][1].split()
        a = r.randrange(len(b))
        part = b[a : a + r.randint(3, 25)]
        rows.append((500 + i, " ".join([sentence(r, r.randint(0, 20)), "; ".join(part).title(), sentence(r, r.randint(0, 20))]), None, None))
    rows += [(600, "it has two, Words in it; one one one one", None, None), (601, "NULL item-with words", None, None), (602, ("so " * 5000) + items[3][1], None, None)]
    return rows, items


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 40])
def test_hits_equal_a_plain_search(spark, block_words):
    rows, items = cases()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id LONG, text STRING, spans INT")
    found = D.decontaminate(frame(spark, rows), bench, block_words=block_words).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), list(r.item_ids)) for r in found), key=str)
    assert got == sorted(((d, *plain(t, items)) for d, t, *_ in rows), key=str)
    assert any(g[2] for g in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words")], "item_id LONG, text STRING")
    docs = documents(spark, ["some words here", None])
    assert D.decontaminate(docs.filter("doc_id < 0"), bench).count() == 0
    assert [(r.n_words, len(r.spans)) for r in D.decontaminate(docs, bench.filter("item_id < 0")).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]


def test_words_longer_than_a_step_and_positions():
    long = "y" * (D._STEP + 5)
    a = D.word_hashes(f"{long} abc {long} ".encode())
    b = D.word_hashes(b"abc")
    assert a[0] == a[2] != a[1] == b[0]
    text = " ".join(f"w{i % 977}" for i in range(60_000)).encode()
    hashes = D.word_hashes(text)
    assert len(hashes) == 60_000 and all(hashes[i] == hashes[i + 977 * 40] for i in range(977))
