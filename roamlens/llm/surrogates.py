"""Personal data replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from roamlens.llm.common import staged

ROUNDS = 64  # tries for a free surrogate before a type counts as exhausted

# Titles before names, by the gender they show.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Madame", "Mademoiselle", "Mme", "Mlle", "Frau", "Señora", "Señorita", "Sra", "Госпожа"),
    "m": ("Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Господин"),
    "": ("Dr", "Prof"),
}
# Syllables and endings that names are made of, by script and gender.
SYLLABLES = {
    "LATIN": ("ba be da de fa ga ka la le li lo ma me mi na ne no pa ra re ri ro sa se ta te ti va ve vi za".split(), ""),
    "CYRILLIC": ("ба ве га да же за ка ла ле ли ма ме на но па ра ре са та ти ва ви зо ро".split(), ""),
    "GREEK": ("βα γα δε ζη θα κα λα λε μα με να νο πα ρα ρε σα τα τι φι χα".split(), ""),
}
ENDINGS = {
    ("LATIN", "f"): ("na", "lia", "ra", "tta"), ("LATIN", "m"): ("ro", "lus", "ndo", "rik"), ("LATIN", ""): ("len", "rin", "sey", "don"),
    ("CYRILLIC", "f"): ("на", "лия", "ра", "ша"), ("CYRILLIC", "m"): ("слав", "мир", "тин", "рий"), ("CYRILLIC", ""): ("нко", "ян", "ич", "ук"),
    ("GREEK", "f"): ("να", "λια", "ρα", "σα"), ("GREEK", "m"): ("νος", "ρης", "κος", "λας"), ("GREEK", ""): ("δης", "κης", "λος", "ρας"),
}

_PERSON = re.compile(
    r"(?<!\w)(" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?[  ]+"
    r"([^\W\d_a-zа-яα-ω][\w'’-]+)(?:[  ]([^\W\d_a-zа-яα-ω][\w'’-]+))?"
)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
# In this order; where two overlap the earlier kind stays.
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.A)),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", re.A)),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,}", re.A)),
    ("secret", re.compile(r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{8,}={0,2})", re.A)),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])", re.A)),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.A)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)),
    ("card", re.compile(r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])", re.A)),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", re.A)),
)
_SOME = re.compile(r"[@0-9]|AKIA|ASIA|gh[pousr]_|sk-|xox|(?i:passw|pwd|secret|token|api[_-]?key)")
_SOME_PERSON = re.compile("|".join(t for ts in TITLES.values() for t in ts))


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 == len(digits) % 2 else int(d) for i, d in enumerate(digits)) % 10


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, canonical value) of the entities of a text, by start,
    without overlaps. Persons are found after a title; each part of a name is an
    entity, and stays one where it comes again in the text by itself."""
    if not text:
        return []
    found = []
    if _SOME.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                a, b = m.span(1) if pattern.groups else m.span()
                value = text[a:b]
                if kind == "iban" and not _iban_ok(value):
                    continue
                if kind == "card" and not 13 <= sum(c.isdigit() for c in value) <= 19:
                    continue
                found.append((a, b, kind, _canonical(kind, value)))
    if _SOME_PERSON.search(text):
        known = {}
        for m in _PERSON.finditer(text):
            gender = _GENDER[m[1]]
            parts = [k for k in (2, 3) if m[k]]
            for k in parts:
                kind = "surname" if k == parts[-1] else f"given{gender}"
                known.setdefault(m[k], (kind, m[k].casefold()))
        if known:
            again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")(?!\w)")
            found += [(m.start(), m.end(), *known[m[0]]) for m in again.finditer(text)]
    rank = {k: i for i, (k, _) in reversed(list(enumerate(PATTERNS)))}
    taken: list[tuple[int, int, str, str]] = []  # by start; only its neighbours can overlap a new one
    for e in sorted(found, key=lambda e: (rank.get(e[2], 99), e[0])):
        at = bisect(taken, e[0], key=lambda t: t[0])
        if (at == 0 or taken[at - 1][1] <= e[0]) and (at == len(taken) or e[1] <= taken[at][0]):
            taken.insert(at, e)
    return taken


def _canonical(kind: str, value: str) -> str:
    """One form for all ways to write the same thing."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"[ -]", "", value)
    if kind == "phone":
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    return value


class _Stream:
    """Pseudorandom numbers from the key and a label."""

    def __init__(self, key: bytes, *label: str):
        self.key, self.label, self.n, self.pool = key, "\0".join(label).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.pool = int.from_bytes(hmac.digest(self.key, self.label + self.n.to_bytes(4, "big"), hashlib.sha256), "big")
            self.n, self.left = self.n + 1, 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def _like(value: str, s: _Stream, digits: str = "0123456789") -> str:
    """Letters become letters of their case, digits digits, hex text hex text."""
    hexes = re.fullmatch(r"[0-9a-f]{16,}", value) is not None
    out = []
    for c in value:
        if hexes:
            out.append("0123456789abcdef"[s.below(16)])
        elif c.isdigit():
            out.append(digits[s.below(len(digits))])
        elif c.isascii() and c.isalpha():
            x = "abcdefghijklmnopqrstuvwxyz"[s.below(26)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a canonical value, itself canonical; another for every attempt."""
    s = _Stream(key, kind, value, str(attempt))
    if kind == "email":
        local, domain = value.split("@", 1)
        host = _like(domain.rsplit(".", 1)[0].replace(".", "-"), _Stream(key, "domain", domain))
        return f"{_like(local, s)}@{host}.example"
    if kind == "ip":
        return f"{240 + s.below(15)}.{s.below(256)}.{s.below(256)}.{s.below(256)}"
    if kind == "ssn":
        return f"{900 + s.below(100)}{_like('00' + '0000', s)}"
    if kind == "card":
        body = value[0] + _like(value[1:-1], s)
        check = next(d for d in "0123456789" if _luhn(body + d) == 0)
        valid = _luhn(value) == 0
        return body + (check if valid else str((int(check) + 1 + s.below(9)) % 10))
    if kind == "iban":
        body = _like(value[4:], s)
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - rest % 97:02d}{body}"
    if kind == "phone":
        digits = value.lstrip("+")
        country = digits[: max(0, len(digits) - 10)]
        area, rest = digits[len(country) : -7], digits[-7:]
        # exchange 555 is for fiction only; it stays where it is
        fresh = "555" + _like(rest[3:], s) if rest.startswith("555") else _like(rest, s, "23456789")
        return ("+" if value.startswith("+") else "") + country + _like(area, s, "23456789") + fresh
    if kind == "secret":
        prefix = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|", value)[0]
        return prefix + _like(value[len(prefix) :], s)
    letters = [c for c in value if c.isalpha()]
    script = unicodedata.name(letters[0], "LATIN").split()[0] if letters else "LATIN"
    script = script if script in SYLLABLES else "LATIN"
    gender = kind[5:] if kind.startswith("given") else ""
    syllables, _ = SYLLABLES[script]
    ends = ENDINGS[script, gender]
    # more syllables with every few attempts, so a free name is always reached
    return "".join(syllables[s.below(len(syllables))] for _ in range(2 + (attempt + 1) // 2)) + ends[s.below(len(ends))]


def written(kind: str, original: str, fresh: str) -> str:
    """A canonical surrogate in the format of the text it replaces."""
    if kind in ("card", "ssn", "iban", "phone"):
        chars = iter(fresh.lstrip("+"))
        out = [next(chars, "") if c.isalnum() else c for c in original]
        return "".join(out) + "".join(chars)
    if kind == "email":
        return fresh.upper() if original.isupper() else fresh
    if kind == "surname" or kind.startswith("given"):
        return fresh.upper() if original.isupper() else fresh.capitalize()
    return fresh


def _detector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, kinds, values = [], [], []
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            for kind, value in sorted({e[2:] for e in entities(t.as_py())}):
                keys.append(key)
                kinds.append(kind)
                values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["key", "kind", "value"])


def _proposer(secret: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            fresh = [surrogate(secret, kind, value, attempt) for kind, value, attempt in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh, pa.string())], [*batch.schema.names, "fresh"])

    return run


def assign(found: DataFrame, secret: bytes) -> DataFrame:
    """(kind, value, attempt, fresh): a surrogate for every distinct entity.

    A proposal is refused if it is an original of its kind, taken by an earlier
    round, or proposed twice (the smallest value keeps it). Whoever is refused
    tries again; rounds go on until none is left, each over the refused only.
    """
    names = ["kind", "value", "attempt", "fresh"]
    originals = found.select("kind", "value").distinct()
    propose = lambda df: df.select("kind", "value", "attempt").mapInArrow(
        _proposer(secret), "kind STRING, value STRING, attempt INT, fresh STRING"
    )
    # persons share their names' spelling whatever their role
    pool = F.when(F.col("kind").startswith("given") | (F.col("kind") == "surname"), F.lit("name")).otherwise(F.col("kind"))
    used = originals.select(pool.alias("pool"), F.col("value").alias("fresh")).distinct()
    waiting = originals.withColumn("attempt", F.lit(0))
    settled = None
    for _ in range(ROUNDS):
        tried = staged(propose(waiting).withColumn("pool", pool))
        if settled is not None:
            used_now = used.unionByName(settled.select("pool", "fresh"))
        else:
            used_now = used
        free = tried.join(used_now, ["pool", "fresh"], "left_anti")
        least = free.groupBy("pool", "fresh").agg(F.min(F.struct("value", "kind")).alias("first"))
        won = free.join(least, ["pool", "fresh"]).filter(
            (F.col("first.value") == F.col("value")) & (F.col("first.kind") == F.col("kind"))
        ).select("pool", *names)
        won = staged(won)
        settled = won if settled is None else staged(settled.unionByName(won))
        waiting = tried.join(won.select("kind", "value"), ["kind", "value"], "left_anti").select(
            "kind", "value", (F.col("attempt") + 1).alias("attempt")
        )
        if waiting.isEmpty():
            return settled.select(names)
    raise ValueError("no free surrogates are left for some type")


def pseudonymize(docs: DataFrame, secret: bytes) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text with surrogates,
    spans (array of {start, stop, kind}, characters of the original).

    Equal entities get equal surrogates in the whole table, distinct ones of a
    kind distinct surrogates, and no surrogate is an original of its kind; both
    are checked over all entities (``assign``). What the key alone yields is
    made where the text is; only entities that had to try again come to their
    texts by a join. Null texts stay null, empty ones empty, texts without
    entities as they are; rows with equal doc_id are treated one by one; other
    columns are ignored.
    """
    keyed = docs.select(F.xxhash64("text").alias("key"), "doc_id", "text")
    found = staged(keyed.select("key", "text").mapInArrow(_detector, "key BIGINT, kind STRING, value STRING").distinct())
    again = assign(found, secret).filter("attempt > 0")
    others = found.join(again, ["kind", "value"]).groupBy("key").agg(
        F.collect_list(F.struct("kind", "value", "fresh")).alias("others")
    )
    source = keyed.join(others, "key", "left").select("doc_id", "text", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for t, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = {(r["kind"], r["value"]): r["fresh"] for r in other or ()}
                at, out, seen = 0, [], entities(t)
                for a, b, kind, value in seen:
                    fresh = own.get((kind, value)) or surrogate(secret, kind, value)
                    out += [t[at:a], written(kind, t[a:b], fresh)]
                    at = b
                texts.append("".join(out) + t[at:] if seen else t)
                spans.append([{"start": a, "stop": b, "kind": kind} for a, b, kind, _ in seen])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"]
            )

    span = StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("kind", StringType())])
    return source.mapInArrow(
        run, StructType([docs.schema["doc_id"], StructField("text", StringType()), StructField("spans", ArrayType(span))])
    )
