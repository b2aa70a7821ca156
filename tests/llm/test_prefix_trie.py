"""Prefix trie against a trie built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roamlens.llm import prefix_trie as R
from roamlens.llm.queries import op11_conversation_trie

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, pos INT, name STRING, depth INT, parent STRING, `a.b` INT"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[:16]


def regrown(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            t = (role or "", text or "")
            own.setdefault(conv, []).append((turn is not None, turn or 0, key(t), t))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = {}
    for path, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        rows[path] = [min(members), len(path), None, len(members), 0, 0, 0, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()]
    for path, row in rows.items():
        if path:
            row[2] = rows[path[:-1]][0]
            rows[path[:-1]][4] += 1
    for path, row in rows.items():
        saved = (row[3] - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            rows[path[:d]][5] += row[4] == 0
            rows[path[:d]][6] += saved
    return sorted((tuple(r) for r in rows.values()), key=repr)


def built(spark, rows, parts=3):
    data = [(*r, 1, "n", 2, "p", 3) for r in rows]
    got = R.conversation_trie(spark.createDataFrame(data, SCHEMA).repartition(parts))
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)


def odd_turns(n=60, longest=12, seed=2):
    r = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if r.random() < 0.1:
            continue
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ccc ü"])))
    rows += [(3, None, None, None), (3, None, None, "x"), (5, 2, "user", ""), (7, 4, "user", "tie"), (7, 4, "user", "eit")]
    rows += [(9, 1, "user", "again")] * 3 + [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(500, 0, "user", "long " * 20_000), (500 + 5 * 1000, 0, "user", "")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = odd_turns()
    assert built(spark, rows) == brute(regrown(rows))


@pytest.mark.parametrize("bits,run", [(0, 1), (1, 2), (3, 3)])
def test_long_conversations_are_cut_by_joins(spark, monkeypatch, bits, run):
    monkeypatch.setattr(R, "CHUNK_BITS", bits)
    monkeypatch.setattr(R, "CHUNK", 1 << bits)
    monkeypatch.setattr(R, "RUN", run)
    rows = odd_turns(n=25, longest=21, seed=4) + [(c, t, "user", str(t // 40)) for c in (40, 42) for t in range(70 + c)]
    assert built(spark, rows) == brute(regrown(rows))


def test_one_conversation_with_most_rows_and_many_equal_ones(spark):
    rows = [(0, t, "user", str(t)) for t in range(700)] + [(c, t, "user", "same") for c in range(1, 90) for t in range(9)]
    assert built(spark, rows, 5) == brute(regrown(rows))


def test_empty_table_and_conversations_without_turns(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 0, "user", "x")]) == []
    empty = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert built(spark, [(empty, 0, "user", "x")]) == brute({empty: []})


def test_general_form_takes_any_sequences(spark):
    turns = spark.createDataFrame([(1, 0, b"a" * 16, 2), (2, 0, b"a" * 16, 2), (2, 1, b"b" * 16, 3)], "conv_id LONG, pos LONG, name BINARY, n_bytes LONG")
    got = R.prefix_trie(turns, spark.createDataFrame([(1,), (2,), (3,)], "conv_id LONG"))
    assert sorted((r.depth, r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in got.collect()) == [(0, 1, 3, 1, 2), (1, 1, 2, 1, 2), (2, 2, 1, 1, 0)]


def test_query_on_the_sample_tables(spark):
    got = op11_conversation_trie(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(regrown(rows))
    assert got.filter(F.col("depth") == 0).count() == 1
