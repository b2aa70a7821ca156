"""Small tables with the odd rows that every text operator must take."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, "
    "carried STRING, fp STRING, row INT, score DOUBLE, op_key STRING, word STRING, anchor LONG, `a.b` INT"
)


def sentence(r: random.Random, n: int) -> str:
    syllables = "an the er re on in ti st es or ble tion wh sh ha".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def odd_rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """Random texts with copies, near copies and shared passages, and null, empty,
    blank, very long, repeated and letterless rows."""
    r = random.Random(seed)
    shared = sentence(r, 40)
    texts: list[str | None] = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.2:
            texts.append(r.choice([t for t in texts if t]))
        elif texts and kind < 0.4:
            words = r.choice([t for t in texts if t]).split()
            words[r.randrange(len(words))] = "changed"
            texts.append("  ".join(words))
        elif kind < 0.6:
            texts.append(sentence(r, r.randint(0, 30)) + " " + shared + "\n" + sentence(r, r.randint(0, 30)))
        else:
            texts.append(sentence(r, r.randint(1, 80)))
    texts += [None, "", " \t\n", "a", "The the THE", "12 34 -- !!", "ñandú Ünïcode 東京 🙂 " + shared, sentence(r, 30_000), "x" * 3000]
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "en", None), (None, None, None, None), (3, texts[5], "en", "s")]
    return rows


def frame(spark, rows: list[tuple], partitions: int = 3):
    data = [(*row, len(row[1] or ""), "c", "f", 1, 0.5, "k", "w", 7, 2) for row in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def documents(spark, texts: list[str | None]):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
