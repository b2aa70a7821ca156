"""The corpus pipeline stage by stage, and its registration."""

import re

import corpus_pipeline as C
from roamlens.llm import queries
from roamlens.llm.common import staged
from tests.llm.fixtures import frame, odd_rows
from tests.llm.test_decontaminate import plain
from tests.llm.test_dedup import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_what_their_operators_say(spark):
    rows = odd_rows(seed=21, n=60)
    docs = staged(frame(spark, rows))
    columns = docs.columns
    stages = dict(C.STAGES)
    lettered = staged(stages["language ID"](spark, docs, SF))
    assert lettered.columns == columns
    kept = rows_of(lettered)
    assert all(any(c.isalpha() for c in t) for _, t in kept)
    assert len(kept) >= 0.9 * sum(any(c.isalpha() for c in t or "") for _, t, *_ in rows)

    exact = staged(stages["exact dedup"](spark, lettered, SF))
    assert exact.columns == columns
    best = {}
    for d, t in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        order = (-len(t), d is None, d or 0)
        best[key] = min(best.get(key, (order, d, t)), (order, d, t), key=lambda x: x[0])
    assert sorted(rows_of(exact), key=str) == sorted(((d, t) for _, d, t in best.values()), key=str)

    near = staged(stages["SimHash near-dedup"](spark, exact, SF))
    left = rows_of(exact)
    groups = plain_components([plain_fingerprint(t) for _, t in left])
    first = {}
    for (d, _), g in zip(left, groups):
        if d is not None:
            first[g] = min(d, first.get(g, d))
    named = {d for (d, _), g in zip(left, groups) if d == first.get(g)}
    assert near.columns == columns and sorted(rows_of(near), key=str) == sorted(((d, t) for d, t in left if d in named), key=str)

    clean = staged(stages["benchmark decontamination"](spark, near, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(rows_of(clean), key=str) == sorted(((d, t) for d, t in rows_of(near) if not plain(t, items)[1]), key=str)

    last = stages["SentencePiece"](spark, clean, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(d for d, _ in rows_of(clean)) and all(r.round_trip for r in last)


def test_empty_table_passes_every_stage(spark):
    docs = frame(spark, odd_rows()).filter("doc_id < -1")
    for _, stage in C.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.QUERIES) == set(names)
    got = entry.queries()["op5_sentencepiece"](spark, SF)
    assert got.filter("round_trip").count() == got.count() == 200
