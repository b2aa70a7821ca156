"""SimHash, exact and suffix-array dedup against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from roamlens.llm import exact as E, simhash as S, suffix_dedup as U
from tests.llm.fixtures import documents, frame, odd_rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_some_mask_drops_any_few_bits(radius):
    masks = S.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    r = random.Random(radius)
    for _ in range(3000):
        bits = r.sample(range(64), radius)
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_near_duplicates_equal_brute_force(spark):
    rows = odd_rows(seed=2, n=60)
    got = S.near_duplicates(frame(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    groups = plain_components(prints)
    least = {}
    for (d, *_), g in zip(rows, groups):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted(((d, f"{p:016x}", least.get(g)) for (d, *_), p, g in zip(rows, prints, groups)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_links_reach_every_close_pair(spark):
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(30)]
    for p in list(prints):
        for _ in range(4):  # chains of close fingerprints
            p ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            prints.append(p)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp LONG")
    edges = [(x.u, x.v) for x in S.links(df).collect()]
    signed = [S._signed(p) for p in prints]
    for u, v in edges:
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 2
    want = plain_components(prints)
    got = {x.node: x.root for x in S.connected_components(S.links(df), "u", "v").collect()}
    label = [got.get(p, p) for p in signed]
    assert len(set(zip(want, label))) == len(set(want)) == len(set(label))


def test_components_of_a_long_chain(spark):
    from roamlens.llm.components import connected_components

    ids = list(range(200))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (5, 5), (None, 4), (900, 901)], "a LONG, b LONG")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(200)} | {900: 900, 901: 900}


@pytest.mark.parametrize("operator", [S.near_duplicates, E.exact_dedup, U.remove_repeats])
def test_empty_table(spark, operator):
    assert operator(documents(spark, ["x"]).filter("doc_id < 0")).count() == 0


def test_exact_dedup_equals_sql(spark):
    rows = odd_rows(seed=4) + [(100 + i, "copy\n text", None, None) for i in range(50)] + [(200, "copy text ", None, None)]
    got = sorted((tuple(r) for r in E.exact_dedup(frame(spark, rows)).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(E.EXACT_SQL.format(documents="documents")).fetchall(), key=str)
    # order of columns: doc_id, keep_id, group_size, kept, text_sha256, n_points
    assert got == sorted(((d, k, g, s, h, p) for d, k, g, s, h, p in want), key=str)
    assert sum(r[3] for r in got) == len({r[4] for r in got})


def test_heavy_digests_are_frequent_and_few(spark):
    base = E.digests(documents(spark, ["hot"] * 500 + [f"t{i}" for i in range(3000)])).cache()
    heavy = E.heavy_digests(base).collect()
    assert [r.group_size for r in heavy] == [500]
    base.unpersist()


def test_suffix_array_is_the_order_of_suffixes():
    r = random.Random(0)
    cases = [[r.randint(1, k) for _ in range(r.randint(0, 40))] for k in (1, 2, 3, 26) for _ in range(300)]
    cases += [[5] * 500, [1, 2] * 300, [2, 1] * 300, list(range(1, 400)), list(range(400, 1, -1))]
    for s in cases:
        s = [*s, 0]
        assert U.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain_repeats(rows):
    """rows in order of (doc_id, tie): bytes, removed, spans, kept."""
    seen, out = set(), []
    for t in rows:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - U.LENGTH + 1):
            w = t[p : p + U.LENGTH]
            if w in seen:
                hit[p : p + U.LENGTH] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        out.append((len(t), int(hit.sum()), spans, kept))
    return out


def tables(seed):
    r = random.Random(seed)
    rows = [x for x in odd_rows(seed=seed, n=50) if x[1] is None or len(x[1]) < 20_000]
    line = "".join(r.choice("abcdefgh ") for _ in range(90))
    for i in range(60):  # a line shorter than a string, in different surroundings
        noise = lambda n: "".join(r.choice("ijklmn") for _ in range(n))
        rows.append((300 + i, noise(r.randint(0, 60)) + line + noise(r.randint(0, 60)), None, None))
    rows.append((400, "abc" * 400, None, None))
    return rows


@pytest.mark.parametrize("crowd", [2000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(U, "CROWD", crowd)
    rows = tables(6)
    df = frame(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in U.remove_repeats(df).collect())
    from pyspark.sql import functions as F

    tie = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).cast("string").substr(-9, 9).cast("int")
    ordered = sorted(
        ((r.doc_id is None, r.doc_id or 0, r.tie, (r.text or "").encode()) for r in df.select("doc_id", "text", tie.alias("tie")).collect()),
    )
    want = sorted((n, d, *x[:3], hashlib.sha256(x[3]).hexdigest()) for (n, d, *_), x in zip(ordered, plain_repeats([o[3] for o in ordered])))
    assert got == want


def test_only_text_that_can_repeat_is_sorted_in_bounded_runs(monkeypatch):
    import pyarrow as pa

    r = random.Random(8)
    text = lambda n: bytes(r.randint(97, 122) for _ in range(n))
    rows = []
    for key in range(500):  # two pieces around one flank; they share strings in every other key
        flank = text(120 if key % 2 else 66)
        for doc in range(2):
            rows.append((key, 2 * (key % 7) + doc, doc, 1000 * key, text(20) + flank + text(14)))
    r.shuffle(rows)
    fields = zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))
    table = pa.table([pa.array(c, t) for c, t in fields], names=["key", "ord", "tie", "start", "piece"])
    sorted_, plain = [], U.suffix_array
    monkeypatch.setattr(U, "suffix_array", lambda s: sorted_.append(len(s)) or plain(s))
    got = sorted((x["ord"], x["tie"], x["start"], x["stop"]) for x in U._sorted_bucket(table).to_pylist())
    seen, want = set(), []
    for _, ord_, tie, start, piece in sorted(rows, key=lambda x: (x[1], x[2], x[3])):
        for p in range(len(piece) - U.LENGTH + 1):
            if piece[p : p + U.LENGTH] in seen:
                want.append((ord_, tie, start + p, start + p + U.LENGTH))
            seen.add(piece[p : p + U.LENGTH])
    assert got == sorted(want) and len(want) >= 250 * 21
    assert len(sorted_) > 1 and max(sorted_) <= 2 * 10_000 and sum(sorted_) < 0.4 * sum(len(x[4]) for x in rows)


def test_spans_that_overlap_or_touch_are_one_run_of_their_row():
    r = random.Random(3)
    for n in (0, 1, 5, 200):
        spans = [(r.randint(0, 6), a, a + r.randint(1, 12)) for a in (r.randint(0, 60) for _ in range(n))]
        row, start, stop = (np.array([s[k] for s in spans], np.int64) for k in range(3))
        want = []
        for k in range(7):
            hit = np.zeros(80, int)
            for _, a, b in (s for s in spans if s[0] == k):
                hit[a:b] = 1
            edge = np.diff(np.concatenate([[0], hit, [0]]))
            want += zip([k] * 80, np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
        assert list(zip(*(x.tolist() for x in U.joined_spans(row, start, stop)))) == want


def test_a_long_repeat_is_handed_on_as_one_span():
    import pyarrow as pa

    r = random.Random(9)
    text = bytes(r.randint(97, 122) for _ in range(140))
    rows = [(1, doc, doc, 10 * doc, bytes([65 + doc]) * 5 + text) for doc in range(3)]
    fields = zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))
    table = pa.table([pa.array(c, t) for c, t in fields], names=["key", "ord", "tie", "start", "piece"])
    assert U._sorted_runs(table).to_pylist() == [
        {"ord": doc, "tie": doc, "start": 10 * doc + 5, "stop": 10 * doc + 145} for doc in (1, 2)
    ]
    assert U._sorted_runs(table.slice(0, 1)).num_rows == 0
