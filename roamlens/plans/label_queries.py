"""Registered weak-supervision queries over the documented LFs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlens.operators import label_model as LM, vote_stats as V
from roamlens.operators.scope import entity_index
from roamlens.operators.subsets import derive_entities, run_hierarchy
from roamlens.operators.votes import LF, class_ids, label_matrix, lf_batch, lf_python, lf_regex, lf_template
from roamlens.plans import lf_catalog as C
from roamlens.plans.oracle_metrics import METRIC_SQL
from roamlens.session import durable
from roamlens.sources import driver_tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Plain EM steps of the SQL; by then a step moves no parameter by 1e-9.
STEPS = 1000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


t = C.FIXTURE

# (metric, LF label index, predicate) of each level, in the order of the votes
LEVEL_SQL: dict[int, list[tuple[str, int, str]]] = {
    1: [
        ("m01_always_on", 0, f"avg_hours >= {t['always_on_hours']} AND distinct_date >= {t['always_on_days']} AND distinct_ap = 1"),
        ("m02_many_connections", 0, f"record_count >= {t['many_connections']} AND distinct_ap = 1"),
        ("m06_off_hours", 0, f"CAST(matched_count AS DOUBLE) / total_count >= {t['off_hours_share']} AND distinct_date >= {t['off_hours_days']}"),
        ("m09_daily_avg_hours_laptop", 1, f"qualifying_ratio >= {t['laptop_daily_avg']} AND total_days >= 1"),
        ("m11_room_type_share", 1, f"percentage >= {t['valid_room_type']}"),
        ("m13_schedule_share", 1, f"percentage >= {t['business_hours']}"),
        ("m10_daily_avg_hours_phone", 2, f"qualifying_ratio >= {t['phone_short_sessions']} AND total_days >= 1"),
        ("m15_many_rooms_three", 2, f"ratio >= {t['many_rooms']} AND total_day_count >= {t['many_rooms_days']}"),
        ("m14_daytime_share", 2, f"percentage >= {t['daytime']}"),
    ],
    2: [
        ("m16_span_and_rooms", 0, f"days_span <= {t['visitor_span']} AND unique_rooms <= {t['visitor_rooms']}"),
        ("m17_connected_days", 0, f"connected_days <= {t['visitor_days']}"),
        ("m18_common_vs_work_rooms", 0, f"common_pct >= {t['visitor_common']} AND work_pct <= {t['visitor_work']}"),
        ("m16_span_and_rooms", 1, f"days_span > {t['resident_span']}"),
        ("m17_connected_days", 1, f"connected_days >= {t['resident_days']}"),
        ("m19_work_room_share", 1, f"work_pct >= {t['resident_work']}"),
    ],
    3: [
        ("m20_lab_day_share", 0, f"lab_day_pct >= {t['lab_days']}"),
        ("m21_schedule_variability", 0, f"day_count > {t['variable_days']} AND bin_pair_count >= {t['variable_bins']}"),
        ("m22_room_diversity", 0, f"avg_daily_rooms >= {t['diverse_rooms']} AND compliant_days = total_days"),
        ("m23_within_hours_share", 1, f"schedule_pct >= {t['nine_to_five']}"),
        ("m24_long_session_days", 1, f"long_session_days >= {t['long_office_days']}"),
        ("m25_few_rooms_non_faculty", 1, f"pct >= {t['few_rooms']}"),
        ("m26_faculty_office_share", 2, f"faculty_pct >= {t['faculty_office']}"),
        ("m27_long_time_share", 2, f"long_pct >= {t['faculty_long']}"),
        ("m28_evening_departure", 2, f"evening_pct >= {t['evening']}"),
    ],
    4: [
        ("m30_late_nights_count", 0, f"late_days >= {t['late_days']}"),
        ("m32_max_weekday_share", 0, f"max_day_pct <= {t['weekday_spread']}"),
        ("m33_lab_weekday_share", 1, f"lab_pct >= {t['lab_weekday']}"),
        ("m34_office_and_lab_days", 1, f"pct >= {t['office_and_lab']}"),
        ("m35_faculty_visits", 1, f"faculty_pct >= {t['visits_share']} AND faculty_days >= {t['visits_days']}"),
        ("m31_shared_rooms", 0, f"shared_pct >= {t['shared']}"),
    ],
}
CLASSES = {1: ["STATIC", "LAPTOP", "PHONE"], 2: ["VISITOR", "RESIDENT"], 3: ["STUDENT", "STAFF", "FACULTY"], 4: ["UNDERGRAD", "GRAD"]}
FLAT_SQL = [
    ("m03_short_sessions_share", 0, f"connection_count >= {t['short_share']} AND distinct_ap = 1"),
    ("m13_schedule_share_by_hour", 1, f"percentage >= {t['business_hours']}"),
    ("m10_daily_avg_hours_phone", 2, f"qualifying_ratio >= {t['phone_short_sessions']} AND total_days >= 1"),
]


def votes_sql(rows: list[tuple[str, int, str]], name: str) -> str:
    """CTE ``name`` (mac_address, v0, v1, ...) by a left join per LF."""
    cols, joins = [], []
    for j, (metric, label, predicate) in enumerate(rows):
        cols.append(f"coalesce(l{j}.v, -1) AS v{j}")
        body = METRIC_SQL[metric]
        joins.append(f"LEFT JOIN (SELECT mac_address, CASE WHEN {predicate} THEN {label} ELSE -1 END AS v FROM ({body}) q{j}) l{j} ON l{j}.mac_address = e.mac_address")
    return f"{name} AS (SELECT e.mac_address, {', '.join(cols)} FROM (SELECT DISTINCT mac_address FROM sessions) e {' '.join(joins)})"


def long_sql(votes: str, m: int, name: str) -> str:
    parts = [f"SELECT mac_address, {j} AS j, v{j} AS v FROM {votes}" for j in range(m)]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def em_sql(prefix: str, votes: str, m: int, k: int, steps: int = STEPS) -> str:
    """CTEs of plain EM, step by step until nothing moves; ``<prefix>prob`` is (mac_address, c, p)."""
    vs = ", ".join(f"v{j}" for j in range(m))

    def shares(tables: str, keep: str = "") -> str:
        scores = f"SELECT {keep}pid, n, c, sum(lp) AS sc FROM {prefix}pl JOIN {tables} USING (j, v) GROUP BY {keep}pid, n, c"
        shifted = f"SELECT *, exp(sc - max(sc) OVER (PARTITION BY pid)) AS e FROM ({scores})"
        return f"SELECT *, e / sum(e) OVER (PARTITION BY pid) AS p FROM ({shifted})"

    live = f"(SELECT * FROM {prefix}em WHERE it < {steps} AND moved > 1e-11) live"
    out = [
        f"{prefix}pat AS MATERIALIZED (SELECT {vs}, count(*) AS n, row_number() OVER () AS pid FROM {votes} GROUP BY {vs})",
        f"{prefix}pl AS MATERIALIZED ({' UNION ALL '.join(f'SELECT pid, n, {j} AS j, v{j} AS v FROM {prefix}pat' for j in range(m))})",
        f"{prefix}grid AS MATERIALIZED (SELECT j, c, v FROM (SELECT unnest(range({m})) AS j), (SELECT unnest(range({k})) AS c), (SELECT unnest(range(-1, {k})) AS v))",
        f"""{prefix}em AS (SELECT 0 AS it, CAST(1 AS DOUBLE) AS moved, j, c, v, ln(CASE WHEN v = c THEN CAST(0.7 AS DOUBLE) ELSE (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) / {k} END) AS lp FROM {prefix}grid
          UNION ALL
          SELECT it + 1, max(abs(lp - was)) OVER () AS moved, j, c, v, lp FROM (
            SELECT it, j, c, v, ln(w / sum(w) OVER (PARTITION BY j, c)) AS lp, was FROM (
              SELECT it, j, c, v, 1 + sum(w) AS w, max(was) AS was FROM (
                SELECT po.it, pl.j, po.c, g AS v, CASE WHEN pl.v = g THEN po.n * po.p ELSE 0 END AS w, list_extract(old, pl.j * {k * (k + 1)} + po.c * {k + 1} + g + 2) AS was
                FROM (SELECT * FROM ({shares(f'(SELECT *, list(lp ORDER BY j, c, v) OVER () AS old FROM {live})', 'it, old, ')})) po
                JOIN {prefix}pl pl USING (pid), (SELECT unnest(range(-1, {k})) AS g)
              ) GROUP BY it, j, c, v)))""",
        f"{prefix}th AS MATERIALIZED (SELECT it, j, c, v, lp FROM {prefix}em WHERE it = (SELECT max(it) FROM {prefix}em))",
        f"{prefix}po AS MATERIALIZED ({shares(prefix + 'th')})",
    ]
    on = " AND ".join(f"a.v{j} = b.v{j}" for j in range(m))
    out.append(f"{prefix}prob AS (SELECT a.mac_address, po.c, po.p FROM {votes} a JOIN {prefix}pat b ON {on} JOIN {prefix}po po ON po.pid = b.pid)")
    return ", ".join(out)


def level_votes(spark: SparkSession, sf: str, level: int) -> tuple[DataFrame, list[LF], int]:
    s = T.sessions(spark, sf)
    sources = C.level_sources(level, s, T.dims(spark, sf), None, C.FIXTURE)
    lfs = [lf for _, g in sources for lf in g]
    return label_matrix(entity_index(s), sources), lfs, len(class_ids(lfs))


def spread(votes: DataFrame, m: int) -> DataFrame:
    return votes.select("mac_address", *[F.element_at("votes", j + 1).alias(f"v{j}") for j in range(m)])


def fitted(spark: SparkSession, sf: str, level: int) -> tuple[DataFrame, LM.LabelModel, list[LF]]:
    votes, lfs, k = level_votes(spark, sf, level)
    votes = durable(votes)
    return votes, LM.fit_converged(V.patterns(votes), len(lfs), k), lfs


def _level_query(level: int):
    def run(spark, sf):
        votes, lfs, _ = level_votes(spark, sf, level)
        return spread(votes, len(lfs))

    return run


for _n, _rows in LEVEL_SQL.items():
    query(f"l01_level{_n}_votes", ", " + votes_sql(_rows, "votes") + " SELECT * FROM votes")(_level_query(_n))


@query("l01_flat_votes", ", " + votes_sql(FLAT_SQL, "votes") + " SELECT * FROM votes")
def _(spark, sf):
    s = T.sessions(spark, sf)
    return spread(label_matrix(entity_index(s), C.flat_sources(s, T.dims(spark, sf), None, C.FIXTURE)), 3)


@query("l02_template_votes", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 0 ELSE -1 END AS v0, CASE WHEN n_chars < 300 THEN 1 ELSE -1 END AS v1, CASE WHEN lang = 'en' THEN 0 ELSE -1 END AS v2 FROM documents")
def _(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    lfs = [lf_template("long", "n_chars", ">", 2000, 0), lf_template("short", "n_chars", "<", 300, 1), lf_template("english", "lang", "==", "en", 0)]
    return label_matrix(docs, [(docs, lfs)], "doc_id").select("doc_id", *[F.col("votes")[j].alias(f"v{j}") for j in range(3)])


@query("l03_regex_votes", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 1 ELSE -1 END AS v0, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 0 ELSE -1 END AS v1 FROM documents")
def _(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    lfs = [lf_regex("numbers", "text", "[0-9]{3}-[0-9]{4}", 1), lf_regex("license", "text", "(?i)licen[cs]e", 0)]
    return label_matrix(docs, [(docs, lfs)], "doc_id").select("doc_id", *[F.col("votes")[j].alias(f"v{j}") for j in range(2)])


@query("l04_python_votes", "SELECT mac_address, CASE WHEN total_conn >= 70 THEN 1 WHEN unique_ap > 3 THEN 0 ELSE -1 END AS v0 FROM (" + METRIC_SQL["m43_device_features"] + ")")
def _(spark, sf):
    from roamlens.operators import metrics as M
    from roamlens.operators.grains import compute

    def rule(row):
        if row["total_conn"] >= 70:
            return 2
        return {True: 1, False: 9}[bool(row["unique_ap"] > 3)]  # 9 is not allowed: abstains

    metric = compute(M.device_features(), T.sessions(spark, sf))
    return spread(label_matrix(metric, [(metric, [lf_python("busy", rule, ["total_conn", "unique_ap"], (1, 2))])]), 1)


@query("l04_batch_votes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN -1 WHEN l_extendedprice / l_quantity > 1500 THEN 1 WHEN l_quantity < 10 THEN 0 ELSE -1 END AS v0 FROM lineitem")
def _(spark, sf):
    """A function of whole batches that refuses some rows: those abstain, the rest of their batch votes."""

    def rule(rows):
        if (rows.l_quantity > 45).any():
            raise ValueError("too many pieces")
        price = rows.l_extendedprice / rows.l_quantity
        return (price > 1500).astype(int).where((price > 1500) | (rows.l_quantity < 10), 99)  # 99: not an allowed class

    lf = lf_batch("unit_price", rule, ["l_quantity", "l_extendedprice"], (0, 1))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lf.vote.alias("v0"))


@query("l05_label_matrix", ", " + votes_sql(LEVEL_SQL[1], "votes") + ", " + long_sql("votes", 9, "lng") + " SELECT j AS lf_index, v AS vote, count(*) AS n FROM lng GROUP BY ALL")
def _(spark, sf):
    votes, _, _ = level_votes(spark, sf, 1)
    return votes.select(F.posexplode("votes").alias("lf_index", "vote")).groupBy("lf_index", "vote").agg(F.count("*").alias("n"))


SUMMARY = ", " + votes_sql(LEVEL_SQL[1], "votes") + ", " + long_sql("votes", 9, "lng") + """, total AS (SELECT count(*) AS n FROM votes),
pairs AS (SELECT a.j, a.mac_address, a.v, count(b.j) FILTER (b.v <> -1) AS others, count(b.j) FILTER (b.v <> -1 AND b.v <> a.v) AS against
  FROM lng a JOIN lng b ON a.mac_address = b.mac_address AND a.j <> b.j GROUP BY ALL),
summary AS (SELECT j AS lf_index, count(*) FILTER (v <> -1) AS n_votes, round(CAST(count(*) FILTER (v <> -1) AS DOUBLE) / any_value(total.n), 4) AS coverage,
  round(CAST(count(*) FILTER (v <> -1 AND others > 0) AS DOUBLE) / any_value(total.n), 4) AS "overlaps",
  round(CAST(sum(CASE WHEN v <> -1 THEN against ELSE 0 END) AS DOUBLE) / any_value(total.n), 4) AS conflicts,
  coalesce(array_to_string(list_sort(list(DISTINCT v) FILTER (v <> -1)), ','), '') AS polarity FROM pairs, total GROUP BY j)"""


@query("l06_lf_summary", SUMMARY + ' SELECT lf_index, polarity, coverage, "overlaps", conflicts, n_votes FROM summary')
def _(spark, sf):
    votes, lfs, _ = level_votes(spark, sf, 1)
    out = V.lf_summary(V.patterns(votes), [lf.name for lf in lfs]).drop("name")
    return out.withColumn("polarity", F.concat_ws(",", F.transform("polarity", lambda v: v.cast("string"))))


MAJORITY = ", " + votes_sql(LEVEL_SQL[1], "votes") + ", " + long_sql("votes", 9, "lng") + """, tally AS (SELECT mac_address, v, count(*) AS n FROM lng WHERE v <> -1 GROUP BY ALL),
majority AS (SELECT e.mac_address, coalesce(w.v, -1) AS label FROM votes e LEFT JOIN
  (SELECT mac_address, v FROM (SELECT *, row_number() OVER (PARTITION BY mac_address ORDER BY n DESC, v) AS rn FROM tally) WHERE rn = 1) w ON e.mac_address = w.mac_address)"""


@query("l07_majority_vote", MAJORITY + " SELECT * FROM majority")
def _(spark, sf):
    votes, _, k = level_votes(spark, sf, 1)
    return V.majority_vote(votes, k)


@query("l08_class_distribution", MAJORITY + """ SELECT c.name AS class_name, count(m.label) AS entities FROM
  (SELECT unnest(['ABSTAIN', 'STATIC', 'LAPTOP', 'PHONE']) AS name, unnest([-1, 0, 1, 2]) AS label) c LEFT JOIN majority m ON m.label = c.label GROUP BY c.name""")
def _(spark, sf):
    votes, _, _ = level_votes(spark, sf, 1)
    return V.class_distribution(V.patterns(votes), CLASSES[1])


@query("l08_overall_stats", SUMMARY + """, covered AS (SELECT count(*) AS c FROM (SELECT mac_address FROM lng GROUP BY mac_address HAVING max(v) > -1))
SELECT any_value(total.n) AS n_samples, 9 AS n_lfs, 3 AS cardinality, round(CAST(any_value(c) AS DOUBLE) / any_value(total.n), 4) AS total_coverage,
  round(avg(coverage), 4) AS mean_lf_coverage, round(avg("overlaps"), 4) AS mean_lf_overlaps, round(avg(conflicts), 4) AS mean_lf_conflicts FROM summary, total, covered""")
def _(spark, sf):
    votes, lfs, k = level_votes(spark, sf, 1)
    return V.overall_stats(V.patterns(votes), [lf.name for lf in lfs], k)


EM1 = ", " + votes_sql(LEVEL_SQL[1], "votes") + ", " + em_sql("d", "votes", 9, 3)


@query("l09_label_model", EM1 + f" SELECT j AS lf_index, c AS class_index, v AS vote, round(lp, 6) AS log_p FROM dth")
def _(spark, sf):
    _, model, _ = fitted(spark, sf, 1)
    rows = [(j, c, v - 1, x) for j, table in enumerate(model.log_p) for c, row in enumerate(table) for v, x in enumerate(row)]
    out = spark.createDataFrame(rows, "lf_index INT, class_index INT, vote INT, log_p DOUBLE")
    return out.withColumn("log_p", F.round("log_p", 6))


@query("l09_learned_weights", EM1 + f""" SELECT j AS lf_index, round(sum(CASE WHEN v = c THEN exp(lp) ELSE 0 END) / sum(CASE WHEN v <> -1 THEN exp(lp) ELSE 0 END), 4) AS learned_weight
FROM dth GROUP BY j""")
def _(spark, sf):
    _, model, _ = fitted(spark, sf, 1)
    return spark.createDataFrame(list(enumerate(model.weights())), "lf_index INT, w DOUBLE").select("lf_index", F.round("w", 4).alias("learned_weight"))


@query("l10_predict_proba", EM1 + " SELECT mac_address, " + ", ".join(f"round(max(CASE WHEN c = {c} THEN p END), 6) AS p{c}" for c in range(3)) + " FROM dprob GROUP BY mac_address")
def _(spark, sf):
    votes, model, _ = fitted(spark, sf, 1)
    return LM.predict_proba(votes, model).select("mac_address", *[F.round(F.col("probs")[c], 6).alias(f"p{c}") for c in range(3)])


HARD = ", hard AS (SELECT b.mac_address, CASE WHEN g = -1 THEN -1 ELSE CAST(b.c AS INTEGER) END AS label FROM (SELECT mac_address, c, row_number() OVER (PARTITION BY mac_address ORDER BY p DESC, c) AS rn FROM dprob) b" \
    " JOIN (SELECT mac_address, greatest(v0, v1, v2, v3, v4, v5, v6, v7, v8) AS g FROM votes) a ON a.mac_address = b.mac_address WHERE rn = 1)"


@query("l10_predict_hard", EM1 + HARD + " SELECT * FROM hard")
def _(spark, sf):
    votes, model, _ = fitted(spark, sf, 1)
    return LM.predict(votes, model)


@query("l10_model_distribution", EM1 + """, best AS (SELECT mac_address, arg_max(c, p) AS c FROM dprob GROUP BY mac_address)
SELECT k.name AS class_name, count(b.c) AS entities FROM (SELECT unnest(['STATIC', 'LAPTOP', 'PHONE']) AS name, unnest([0, 1, 2]) AS c) k LEFT JOIN best b ON b.c = k.c GROUP BY k.name""")
def _(spark, sf):
    votes, model, _ = fitted(spark, sf, 1)
    return LM.model_distribution(LM.predict_proba(votes, model), CLASSES[1])


@query("l11_one_hot", MAJORITY + " SELECT mac_address, " + ", ".join(f"CASE WHEN label = {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p{c}" for c in range(3)) + " FROM majority")
def _(spark, sf):
    votes, _, k = level_votes(spark, sf, 1)
    hot = V.majority_vote(votes, k).withColumn("probs", V.one_hot("label", k))
    return hot.select("mac_address", *[F.col("probs")[c].alias(f"p{c}") for c in range(3)])


@query("l12_derive_softmax", EM1 + " SELECT DISTINCT mac_address FROM dprob WHERE (c = 1 AND p >= 0.8) OR (c = 2 AND p >= 0.6)")
def _(spark, sf):
    votes, model, lfs = fitted(spark, sf, 1)
    rule = {"labels": {str(C.LAPTOP): {"min_confidence": 0.8}, str(C.PHONE): {"min_confidence": 0.6}, "77": {"min_confidence": 0.1}}}
    return derive_entities(votes.select("mac_address"), LM.predict_proba(votes, model), rule, class_ids(lfs))


@query("l12_derive_argmax", EM1 + " SELECT mac_address FROM (SELECT mac_address, arg_max(c, p) AS c FROM dprob GROUP BY mac_address) WHERE c = 0")
def _(spark, sf):
    votes, model, lfs = fitted(spark, sf, 1)
    return derive_entities(votes.select("mac_address"), LM.predict_proba(votes, model), {"labels": {str(C.STATIC): {}}}, class_ids(lfs), mode="argmax")


@query("l12_derive_exclude", EM1 + " SELECT mac_address FROM (SELECT mac_address, arg_max(c, p) AS c FROM dprob GROUP BY mac_address) WHERE c <> 0")
def _(spark, sf):
    """The people's devices: everything but the static ones."""
    votes, model, lfs = fitted(spark, sf, 1)
    return derive_entities(votes.select("mac_address"), LM.predict_proba(votes, model), None, class_ids(lfs), exclude=[C.STATIC])


def _hierarchy_sql() -> str:
    """Four levels; each fits on the entities the level above passed on."""
    out, ents = [], "(SELECT DISTINCT mac_address FROM sessions)"
    for level, rows in LEVEL_SQL.items():
        m, k = len(rows), len(CLASSES[level])
        out += [
            votes_sql(rows, f"all{level}"),
            f"votes{level} AS (SELECT * FROM all{level} WHERE mac_address IN (SELECT mac_address FROM {ents} e))",
            em_sql(f"h{level}_", f"votes{level}", m, k),
        ]
        pick = {1: None, 2: 1, 3: 0, 4: None}[level]
        if pick is not None:
            out.append(f"next{level} AS (SELECT mac_address FROM h{level}_prob WHERE c = {pick} AND p >= 0.5)")
            ents = f"next{level}"
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS subset, mac_address FROM h{level}_prob WHERE c = {c} AND p >= 0.5"
        for level, names in CLASSES.items() for c, name in enumerate(n.lower() for n in names)
    )
    return ", " + ", ".join(out) + f" SELECT subset, mac_address FROM ({rows})"


@query("l13_hierarchy", _hierarchy_sql())
def _(spark, sf):
    s = T.sessions(spark, sf)
    levels = C.hierarchy(s, T.dims(spark, sf), C.FIXTURE)
    results = run_hierarchy(entity_index(s), levels)
    out = None
    for r in results.values():
        for name, df in r.subsets.items():
            if name == "people":
                continue
            part = df.select(F.lit(name).alias("subset"), "mac_address")
            out = part if out is None else out.unionByName(part)
    return out


@query("l14_lf_accuracy", EM1 + HARD + ", " + long_sql("votes", 9, "lng") + """ SELECT j AS lf_index, count(*) AS n_votes, count(*) FILTER (v = label) AS n_right,
round(CAST(count(*) FILTER (v = label) AS DOUBLE) / count(*), 4) AS accuracy FROM lng JOIN hard USING (mac_address) WHERE v <> -1 GROUP BY j""")
def _(spark, sf):
    votes, model, lfs = fitted(spark, sf, 1)
    return V.lf_agreement(votes, LM.predict(votes, model), [lf.name for lf in lfs]).drop("name")


TEMPLATES = [("n_chars", ">", 2000, 0), ("n_chars", "<", 300, 1), ("lang", "==", "en", 0), ("lang", "==", "de", 1)]


@query("l14_lf_accuracy_gold", """, votes AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 0 ELSE -1 END AS v0, CASE WHEN n_chars < 300 THEN 1 ELSE -1 END AS v1,
  CASE WHEN lang = 'en' THEN 0 ELSE -1 END AS v2, CASE WHEN lang = 'de' THEN 1 ELSE -1 END AS v3 FROM documents), lng AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, {j} AS j, v{j} AS v FROM votes" for j in range(4)) + """) SELECT j AS lf_index, count(*) AS n_votes, count(*) FILTER (v = quality) AS n_right,
  round(CAST(count(*) FILTER (v = quality) AS DOUBLE) / count(*), 4) AS accuracy FROM lng JOIN labels USING (doc_id) WHERE v <> -1 GROUP BY j""")
def _(spark, sf):
    """Labeling functions of documents against the checked labels."""
    docs = T.table(spark, sf, "documents")
    lfs = [lf_template(f"{field} {op} {value}", field, op, value, label) for field, op, value, label in TEMPLATES]
    votes = label_matrix(docs.select("doc_id"), [(docs, lfs)], "doc_id")
    gold = T.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return V.lf_agreement(votes, gold, [lf.name for lf in lfs], "doc_id").drop("name")
