"""Registered classifier and forecasting queries."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame, functions as F

from roamlens.operators import (
    calendars as A, classifiers as CL, evaluation as E, forecasting as H, metrics as M, neighbors as N,
    timeline as L, training as R,
)
from roamlens.operators.bins import occupancy_bins
from roamlens.operators.grains import compute
from roamlens.operators.least_squares import least_squares
from roamlens.operators.label_model import predict_proba
from roamlens.plans.label_queries import EM1, fitted
from roamlens.plans.occupancy_queries import bins_sql, shared_folder
from roamlens.plans.oracle_metrics import METRIC_SQL
from roamlens.session import durable
from roamlens.sources import driver_tables as T
from roamlens.sources.tables import read_csv_counts, write_asset

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR, HALF = 3600, 1800


def _r(x: str, digits: int = 6) -> str:
    """Rounded without a negative zero."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({x}, {digits}) END"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# classifier bank: class probabilities of a device are the shares of its
# sessions in the three parts of the day


def probabilities(spark, sf) -> DataFrame:
    h = F.hour("start_time")
    parts = [F.count_if(h < 8), F.count_if((h >= 8) & (h < 16)), F.count_if(h >= 16)]
    total = F.count("*").cast("double")
    return T.sessions(spark, sf).groupBy("mac_address").agg(F.array(*[p / total for p in parts]).alias("probs"))


PROBS = """, pr AS (SELECT mac_address, CAST(count(*) FILTER (hour(start_time) < 8) AS DOUBLE) / count(*) AS p0,
  CAST(count(*) FILTER (hour(start_time) BETWEEN 8 AND 15) AS DOUBLE) / count(*) AS p1, CAST(count(*) FILTER (hour(start_time) >= 16) AS DOUBLE) / count(*) AS p2 FROM sessions GROUP BY mac_address),
sc AS (SELECT mac_address, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label, greatest(p0, p1, p2) AS confidence FROM pr)"""
MIN_CLASS = 20
STEPS = ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(R.threshold_steps(0.45)))
KEEP = PROBS + f""", steps AS (SELECT * FROM (VALUES {STEPS}) x(i, th)),
per AS (SELECT i, th, label, count(*) AS n FROM steps JOIN sc ON confidence >= th GROUP BY ALL),
ok AS (SELECT s.i, s.th FROM steps s LEFT JOIN per p ON p.i = s.i GROUP BY s.i, s.th HAVING coalesce(min(p.n), {MIN_CLASS}) >= {MIN_CLASS}),
used AS (SELECT coalesce((SELECT th FROM ok ORDER BY i LIMIT 1), (SELECT min(th) FROM steps)) AS th),
kept AS (SELECT sc.* FROM sc, used WHERE confidence >= th),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(mac_address || '#42'), mac_address) AS rn, count(*) OVER (PARTITION BY label) AS n FROM kept),
balanced AS (SELECT mac_address, label, confidence FROM ranked WHERE rn <= floor(CAST(1.1 AS DOUBLE) * (SELECT min(n) FROM ranked)))"""
SPLIT = KEEP + """, r2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(mac_address || '#7'), mac_address) AS rn, count(*) OVER (PARTITION BY label) AS n FROM balanced),
split AS (SELECT mac_address, label, rn <= floor(n * CAST(0.25 AS DOUBLE) + 0.5) AS is_test FROM r2)"""


def kept(spark, sf) -> DataFrame:
    return R.filter_confident(R.scored(probabilities(spark, sf)), 0.45, MIN_CLASS)[0]


def balanced(spark, sf) -> DataFrame:
    return R.cap_imbalance(kept(spark, sf), 1.1, 42)


def features(spark, sf) -> list[DataFrame]:
    s = T.sessions(spark, sf)
    return [compute(M.device_features(), s), compute(M.within_hours_share(), s), compute(M.lab_day_share(), s, None, T.dims(spark, sf))]


def train_test(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    frame, cols = R.training_frame(balanced(spark, sf), features(spark, sf))
    both = durable(R.stratified_split(frame, 0.25, 7))
    train, test = both.where("NOT is_test"), both.where("is_test")
    stats = R.scaler_stats(train, cols)
    return R.scale(train, stats), R.scale(test, stats), cols


@query("c01_confidence", PROBS + """ SELECT mac_address, label, confidence, round(1 + (p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10) + p2 * ln(p2 + 1e-10)) / ln(CAST(3 AS DOUBLE)), 6) AS entropy
FROM sc JOIN pr USING (mac_address)""")
def _(spark, sf):
    p = probabilities(spark, sf)
    entropy = F.round(R.confidence("probs", "entropy"), 6)
    return R.scored(p).join(p.select("mac_address", entropy.alias("entropy")), "mac_address")


@query("c02_filter_confident", KEEP + " SELECT * FROM kept")
def _(spark, sf):
    return kept(spark, sf)


@query("c03_cap_imbalance", KEEP + " SELECT * FROM balanced")
def _(spark, sf):
    return balanced(spark, sf)


@query("c04_filtering_stats", KEEP + """ SELECT (SELECT count(*) FROM sc) AS samples_before_filter, count(*) AS samples_after_filter,
  round((SELECT avg(confidence) FROM sc), 4) AS confidence_before_filter, round(avg(confidence), 4) AS confidence_after_filter,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sc), 4) AS filter_retention_rate FROM balanced""")
def _(spark, sf):
    return R.filtering_stats(R.scored(probabilities(spark, sf)), balanced(spark, sf))


@query("c04_class_sizes", KEEP + " SELECT label, count(*) AS n FROM balanced GROUP BY label")
def _(spark, sf):
    return balanced(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


FRAME = f"""(SELECT b.mac_address, b.label, b.confidence, mean_interval, CAST(total_conn AS DOUBLE) AS total_conn, CAST(num_days AS DOUBLE) AS num_days, CAST(unique_ap AS DOUBLE) AS unique_ap,
  coalesce(CAST(w.scheduled_count AS DOUBLE), 0) AS scheduled_count, coalesce(CAST(w.total_count AS DOUBLE), 0) AS total_count, coalesce(w.schedule_pct, 0) AS schedule_pct,
  coalesce(CAST(l.total_day_count AS DOUBLE), 0) AS total_day_count, coalesce(l.lab_day_pct, 0) AS lab_day_pct
  FROM balanced b LEFT JOIN ({METRIC_SQL['m43_device_features']}) f ON b.mac_address = f.mac_address
  LEFT JOIN ({METRIC_SQL['m23_within_hours_share']}) w ON b.mac_address = w.mac_address LEFT JOIN ({METRIC_SQL['m20_lab_day_share']}) l ON b.mac_address = l.mac_address)"""


@query("c05_training_frame", KEEP + f" SELECT * FROM {FRAME}")
def _(spark, sf):
    return R.training_frame(balanced(spark, sf), features(spark, sf))[0]


@query("c06_stratified_split", SPLIT + " SELECT mac_address, label, is_test FROM split")
def _(spark, sf):
    return R.stratified_split(balanced(spark, sf), 0.25, 7).select("mac_address", "label", "is_test")


@query("c07_scale", SPLIT + f""", fr AS (SELECT x.*, is_test FROM {FRAME} x JOIN split USING (mac_address)), st AS (SELECT avg(mean_interval) AS m1, stddev_pop(mean_interval) AS s1,
  avg(lab_day_pct) AS m2, stddev_pop(lab_day_pct) AS s2 FROM fr WHERE NOT is_test)
SELECT mac_address, round((mean_interval - m1) / s1, 6) AS mean_interval, round((lab_day_pct - m2) / s2, 6) AS lab_day_pct FROM fr, st""")
def _(spark, sf):
    train, test, _ = train_test(spark, sf)
    return train.unionByName(test).select("mac_address", *[F.round(c, 6).alias(c) for c in ("mean_interval", "lab_day_pct")])


@query("c08_train_bank")
def _(spark, sf):
    """All twelve models at their documented sizes."""
    train, test, cols = train_test(spark, sf)
    return CL.train_bank(train, test, cols, 3)


@query("c08_failed_model", KEEP + " SELECT 'broken' AS model, CAST(NULL AS DOUBLE) AS accuracy, 'ValueError: no fit on ' || count(*) || ' rows' AS failure FROM balanced")
def _(spark, sf):
    """A model that fails is a row with its reason."""

    def broken(train, test, cols):
        raise ValueError(f"no fit on {train.count() + test.count()} rows")

    train, test, cols = train_test(spark, sf)
    return CL.train_bank(train, test, cols, 3, ["broken"], extra={"broken": broken}).select("model", "accuracy", "failure")


@query("c09_class_means", SPLIT + f""", fr AS (SELECT x.*, is_test FROM {FRAME} x JOIN split USING (mac_address))
SELECT label, count(*) AS n, round(avg(mean_interval), 6) AS mean_interval, round(avg(lab_day_pct), 6) AS lab_day_pct FROM fr WHERE NOT is_test GROUP BY label""")
def _(spark, sf):
    frame, cols = R.training_frame(balanced(spark, sf), features(spark, sf))
    train = R.stratified_split(frame, 0.25, 7).where("NOT is_test")
    return CL.class_means(train, cols).select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean_interval", "lab_day_pct")])


NEIGHBOURS = PROBS + """, d AS (SELECT a.mac_address, b.mac_address AS other, b.label, sqrt((a.p0 - b.p0) ** 2 + (a.p1 - b.p1) ** 2 + (a.p2 - b.p2) ** 2) AS dist
  FROM pr a JOIN (SELECT * FROM pr JOIN sc USING (mac_address)) b ON a.mac_address <> b.mac_address)
SELECT mac_address, round(dist, 6) AS dist, rn AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mac_address ORDER BY dist, other) AS INTEGER) AS rn FROM d) WHERE rn <= 5"""


@query("c09_nearest_neighbours", NEIGHBOURS)
def _(spark, sf):
    x = points(spark, sf)
    return ranked(N.nearest(x, x, ["p0", "p1", "p2"], 6, group_rows=60))  # 6: a device is its own nearest


@query("c09_pruned_neighbours", NEIGHBOURS)
def _(spark, sf):
    x = points(spark, sf)
    return ranked(N.nearest_pruned(x, x, ["p0", "p1", "p2"], 6, group_rows=12)[0])


def points(spark, sf) -> DataFrame:
    p = probabilities(spark, sf)
    return R.scored(p).join(p.select("mac_address", *[F.col("probs")[c].alias(f"p{c}") for c in range(3)]), "mac_address")


def ranked(near: DataFrame) -> DataFrame:
    others = F.filter("neighbours", lambda n: n["other"] != F.col("mac_address"))
    return near.select("mac_address", F.posexplode(F.slice(others, 1, 5)).alias("pos", "n")).select(
        "mac_address", F.round("n.dist", 6).alias("dist"), (F.col("pos") + 1).alias("rank"))


@query("c10_scores", PROBS + """, x AS (SELECT mac_address, label, CAST((SELECT count(*) FROM sessions z WHERE z.mac_address = sc.mac_address) % 3 AS INTEGER) AS prediction FROM sc),
c AS (SELECT k, count(*) FILTER (label = k) AS actual, count(*) FILTER (prediction = k) AS guessed, count(*) FILTER (label = k AND prediction = k) AS tp FROM x, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k)
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(actual), 4) AS accuracy, round(avg(CASE WHEN actual > 0 THEN CAST(tp AS DOUBLE) / actual END), 4) AS balanced_accuracy,
  round(CAST(sum(tp * 2.0 / nullif(actual + guessed, 0) * actual) AS DOUBLE) / sum(actual), 4) AS f1 FROM c""")
def _(spark, sf):
    guess = T.sessions(spark, sf).groupBy("mac_address").agg((F.count("*") % 3).cast("int").alias("prediction"))
    return E.scores(R.scored(probabilities(spark, sf)).join(guess, "mac_address"))


@query("c11_batch_score")
def _(spark, sf):
    train, test, cols = train_test(spark, sf)
    model = DecisionTreeClassifier(maxDepth=3, seed=1).fit(CL.assemble(train, cols))
    return E.batch_score(CL.assemble(test, cols), model).select("mac_address", "label", "prediction")


COLUMNS = ["mean_interval", "total_conn", "num_days", "unique_ap", "scheduled_count", "total_count", "schedule_pct", "total_day_count", "lab_day_pct"]


@query("c11_expression_score", SPLIT + f""", fr AS (SELECT x.*, is_test FROM {FRAME} x JOIN split USING (mac_address)),
lng AS ({' UNION ALL '.join(f"SELECT mac_address, label, is_test, '{c}' AS f, {c} AS v FROM fr" for c in COLUMNS)}),
whole AS (SELECT 1e-9 * max(s) AS extra FROM (SELECT var_pop(v) AS s FROM lng WHERE NOT is_test GROUP BY f)),
st AS (SELECT label AS c, f, avg(v) AS m, var_pop(v) + any_value(extra) AS s FROM lng, whole WHERE NOT is_test GROUP BY label, f),
pri AS (SELECT label AS c, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fr WHERE NOT is_test)) AS p FROM fr WHERE NOT is_test GROUP BY label),
scr AS (SELECT l.mac_address, st.c, any_value(p) - 0.5 * sum(ln(2 * pi() * s) + (v - m) ** 2 / s) AS score FROM lng l JOIN st USING (f) JOIN pri USING (c) WHERE is_test GROUP BY l.mac_address, st.c)
SELECT mac_address, label, arg_max(c, score) AS prediction FROM scr JOIN fr USING (mac_address) GROUP BY mac_address, label""")
def _(spark, sf):
    """Naive Bayes as a fitted expression: scoring is a projection of the table."""
    frame, _ = R.training_frame(balanced(spark, sf), features(spark, sf))
    both = durable(R.stratified_split(frame, 0.25, 7))
    return both.where("is_test").select("mac_address", "label", CL.fit_gaussian_nb(both.where("NOT is_test"), COLUMNS).alias("prediction"))


# the label model's output as training labels of the bank
CHAIN_PROBS = EM1 + """, pr AS (SELECT mac_address, max(p) FILTER (c = 0) AS p0, max(p) FILTER (c = 1) AS p1, max(p) FILTER (c = 2) AS p2 FROM dprob GROUP BY mac_address),
sc AS (SELECT mac_address, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label, greatest(p0, p1, p2) AS confidence FROM pr)"""


def chained(spark, sf) -> DataFrame:
    votes, model, _ = fitted(spark, sf, 1)
    return durable(R.scored(predict_proba(votes, model)))


@query("c_chain_balanced_labels", CHAIN_PROBS + KEEP.removeprefix(PROBS) + " SELECT mac_address, label, round(confidence, 6) AS confidence FROM balanced")
def _(spark, sf):
    found = R.cap_imbalance(R.filter_confident(chained(spark, sf), 0.45, MIN_CLASS)[0], 1.1, 42)
    return found.select("mac_address", "label", F.round("confidence", 6).alias("confidence"))


@query("c_chain_scores", CHAIN_PROBS + SPLIT.removeprefix(PROBS) + f""", fr AS (SELECT x.*, is_test FROM {FRAME} x JOIN split USING (mac_address)),
mu AS (SELECT label AS c, avg(mean_interval) AS m, count(*) AS n FROM fr WHERE NOT is_test GROUP BY label)
SELECT mac_address, fr.label, arg_min(c, (abs(mean_interval - m), c)) AS prediction FROM fr, mu WHERE is_test GROUP BY mac_address, fr.label""")
def _(spark, sf):
    """From votes to predictions: nearest class mean of one feature, on labels of the label model."""
    labels = R.cap_imbalance(R.filter_confident(chained(spark, sf), 0.45, MIN_CLASS)[0], 1.1, 42)
    frame, _ = R.training_frame(labels, features(spark, sf))
    both = durable(R.stratified_split(frame, 0.25, 7))
    guess = CL.fit_nearest_mean(both.where("NOT is_test"), ["mean_interval"])
    return both.where("is_test").select("mac_address", "label", guess.alias("prediction"))


@query("c11_batch_score_python", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS prediction FROM lineitem")
def _(spark, sf):
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    out = E.batch_score_python(rows, lambda x: x.l_extendedprice * (1 - x.l_discount), ["l_extendedprice", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "prediction")


# forecasting


def ap_counts(spark, sf) -> DataFrame:
    s = T.sessions(spark, sf).drop("space_id").withColumnRenamed("sensor_id", "space_id")
    b = occupancy_bins(s, 900)
    return b.select("interval_begin_time", F.col("space_id").alias("ap"), F.col("number_connections").alias("count"))


AP = "(" + bins_sql(900).replace("x.space_id", "x.sensor_id") + ")"


@query("s03_read_csv_counts", f"SELECT interval_begin_time, sensor_id AS ap, number_connections AS count FROM {AP}")
def _(spark, sf):
    path = shared_folder(spark) + "/counts"
    ap_counts(spark, sf).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)
    return read_csv_counts(spark, path)


@query("s04_write_asset", "SELECT mac_address, days AS connected_days FROM totals")
def _(spark, sf):
    path = shared_folder(spark) + "/asset"
    write_asset(compute(M.connected_days(), T.sessions(spark, sf)), path)
    write_asset(compute(M.connected_days(), T.sessions(spark, sf)), path)  # replaces the first
    return spark.read.parquet(path)


@query("h01_counts_by_level", f"""SELECT 'ap' AS level, interval_begin_time AS ds, number_connections AS y FROM {AP} WHERE sensor_id = 'ap-3' UNION ALL
SELECT 'floor', interval_begin_time, CAST(sum(number_connections) AS BIGINT) FROM {AP} WHERE contains(sensor_id, 'ap-1') GROUP BY interval_begin_time UNION ALL
SELECT 'building', interval_begin_time, CAST(sum(number_connections) AS BIGINT) FROM {AP} WHERE left(split_part(sensor_id, '-', 1), -1) = 'a' GROUP BY interval_begin_time""")
def _(spark, sf):
    c = ap_counts(spark, sf)
    parts = [L.counts_by_level(c, level, where, "ap-").select(F.lit(level).alias("level"), "ds", "y") for level, where in (("ap", "ap-3"), ("floor", "1"), ("building", "a"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def series(spark, sf, seconds: int = HALF) -> DataFrame:
    return L.as_series(occupancy_bins(T.sessions(spark, sf), seconds))


def _grid_sql(seconds: int, lo: str = "min(ds)", hi: str = "max(ds)") -> str:
    return f"""WITH b AS (SELECT space_id, interval_begin_time AS ds, CAST(number_connections AS DOUBLE) AS y FROM ({bins_sql(seconds)})),
g AS (SELECT space_id, unnest(generate_series({lo}, {hi}, INTERVAL {seconds} SECOND)) AS ds FROM b GROUP BY space_id),
q AS (SELECT g.space_id, g.ds, CASE WHEN b.y IS NULL AND (hour(g.ds) >= 22 OR hour(g.ds) < 8) THEN 0 ELSE b.y END AS y FROM g LEFT JOIN b ON g.space_id = b.space_id AND g.ds = b.ds)"""


def _ffill_sql(k: int) -> str:
    return f""", f AS (SELECT space_id, ds, last_value(y IGNORE NULLS) OVER (PARTITION BY space_id ORDER BY ds ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) AS y FROM q)"""


@query("h02_fill_bounded", _grid_sql(HALF) + _ffill_sql(2) + " SELECT * FROM f WHERE y IS NOT NULL")
def _(spark, sf):
    return L.fill_timeline(series(spark, sf), HALF)


SQL["w03_forward_fill"] = SQL["h02_fill_bounded"]


@query("h03_fill_zero", _grid_sql(HALF) + " SELECT space_id, ds, coalesce(y, 0) AS y FROM q")
def _(spark, sf):
    return L.fill_timeline(series(spark, sf), HALF, "zero")


DAYS = ("CAST(CAST(min(ds) AS DATE) AS TIMESTAMP)", "CAST(CAST(max(ds) AS DATE) + 1 AS TIMESTAMP)")


@query("h04_fill_whole_days", _grid_sql(900, *DAYS) + _ffill_sql(12) + " SELECT space_id, ds, CASE WHEN y > 0 THEN y - 1 ELSE y END AS y FROM f")
def _(spark, sf):
    return L.fill_timeline(series(spark, sf, 900), 900, limit=12, whole_days=True, static_devices=True, drop_gaps=False)


@query("h04_fill_whole_days_zero", _grid_sql(900, *DAYS) + " SELECT space_id, ds, CASE WHEN y > 0 THEN y - 1 ELSE coalesce(y, 0) END AS y FROM q")
def _(spark, sf):
    return L.fill_timeline(series(spark, sf, 900), 900, "zero", whole_days=True, static_devices=True)


@query("h05_calendar_features", """WITH d AS (SELECT o_orderkey, o_orderdate AS ds, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders),
q AS (SELECT *, CASE WHEN md BETWEEN 924 AND 1214 THEN 1 WHEN md BETWEEN 102 AND 322 THEN 2 WHEN md BETWEEN 327 AND 614 THEN 3 WHEN md BETWEEN 624 AND 830 THEN 4 ELSE 0 END AS quarter FROM d)
SELECT o_orderkey, quarter, CAST(isodow(ds) - 1 AS INTEGER) AS day, CAST(hour(ds) AS INTEGER) AS hour, CAST(month(ds) AS INTEGER) AS month, CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend,
  CAST(hour(ds) BETWEEN 8 AND 22 AS INTEGER) AS is_active_hour, CAST(quarter = 1 AS INTEGER) AS quarter_1, CAST(quarter = 2 AS INTEGER) AS quarter_2, CAST(quarter = 3 AS INTEGER) AS quarter_3,
  CAST(quarter = 4 AS INTEGER) AS quarter_4 FROM q""")
def _(spark, sf):
    d = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ds"))
    return A.calendar_features(d).drop("ds")


_HOUR = "2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0"
_DOW = "2 * pi() * (isodow(ts) - 1) / 7.0"


@query("h06_cyclic_features", f"""SELECT event_id, {_r(f'sin({_HOUR})')} AS hour_sin, {_r(f'cos({_HOUR})')} AS hour_cos,
  {_r(f'sin({_DOW})')} AS dow_sin, {_r(f'cos({_DOW})')} AS dow_cos, 0 AS holiday FROM events""")
def _(spark, sf):
    d = A.cyclic_features(T.table(spark, sf, "events").select("event_id", F.col("ts").alias("ds")))
    return d.select("event_id", *[F.round(c, 6).alias(c) for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")], "holiday")


HOLIDAYS = ", hol AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS holiday, unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS d" for n, a, b in A.HOLIDAYS) + ")"


@query("h07_holidays", HOLIDAYS + """ SELECT holiday, CAST(d AS DATE) AS ds, count(event_id) AS n FROM hol
LEFT JOIN events ON month(d) = month(ts) AND day(d) = day(ts) GROUP BY holiday, d""")
def _(spark, sf):
    """Events on the calendar days of the holiday table, whatever the year."""
    md = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    per_day = T.table(spark, sf, "events").groupBy(md("ts").alias("md")).agg(F.count("*").alias("n"))
    days = A.holiday_days(spark).withColumn("md", md("ds"))
    return days.join(per_day, "md", "left").select("holiday", "ds", F.coalesce("n", F.lit(0)).alias("n"))


@query("h08_fourier_features", "SELECT event_id, " + ", ".join(
    _r(f"CASE WHEN isodow(ts) >= 6 THEN {f}(2 * pi() * {n} / 7 * (date_diff('microsecond', TIMESTAMP '1970-01-01', ts) / 86400e6)) ELSE 0 END") + f" AS {f}{n}"
    for n in (1, 2) for f in ("sin", "cos")) + " FROM events")
def _(spark, sf):
    d = A.calendar_features(T.table(spark, sf, "events").select("event_id", F.col("ts").alias("ds")))
    d = A.fourier_features(d, 7, 2, "is_weekend")
    names = ["sin1", "cos1", "sin2", "cos2"]
    return d.select("event_id", *[F.round(F.col("fourier")[i] + 0.0, 6).alias(n) for i, n in enumerate(names)])


def seasonal(spark, sf):
    """(design of the scaled series with is_train, coefficients, scaling): all nine terms and the holidays."""
    filled = L.time_split(L.fill_timeline(series(spark, sf, HOUR), HOUR), HOUR)
    stats = L.scaling(filled.where("is_train"))
    design = durable(A.seasonal_design(L.apply_scaling(filled, stats)))
    return design, durable(H.fit_seasonal(design.where("is_train"))), stats


@query("h09_seasonal_forecast")
def _(spark, sf):
    design, coefs, stats = seasonal(spark, sf)
    pred = H.predict_seasonal(design.where("NOT is_train"), coefs).select("space_id", "ds", "y", "yhat")
    return L.undo_scaling(L.undo_scaling(pred, stats), stats, column="yhat")


SPLIT90 = """, f AS (SELECT space_id, ds, last_value(y IGNORE NULLS) OVER (PARTITION BY space_id ORDER BY ds ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS y FROM q),
n AS (SELECT space_id, count(*) AS n FROM f WHERE y IS NOT NULL GROUP BY space_id)"""


# Intercept, trend, holidays, and a sine and a cosine for each order of a term.
WIDTH = 2 + len({n for n, _, _ in A.HOLIDAYS}) + 2 * sum(order for _, _, order, _ in A.ALWAYS + A.SEASONALITIES)


@query("h09_seasonal_gradients", _grid_sql(HOUR) + SPLIT90 + f""" SELECT space_id, CAST(floor(n * (1.0::DOUBLE - 0.1::DOUBLE)) AS BIGINT) AS train_size, i AS "column", CAST(0 AS DOUBLE) AS gradient
FROM n, (SELECT CAST(unnest(range({WIDTH})) AS INTEGER) AS i) WHERE floor(n * (1.0::DOUBLE - 0.1::DOUBLE)) > 0""")
def _(spark, sf):
    """At the fit the error's derivative by every coefficient is zero, relative to its terms."""
    design, coefs, _ = seasonal(spark, sf)
    g = H.gradients(design.where("is_train"), coefs)
    relative = F.round(F.col("gradient") / (F.col("size") + F.lit(1.0)), 6) + F.lit(0.0)
    return g.join(coefs.select("space_id", "n"), "space_id").select("space_id", F.col("n").alias("train_size"), "column", F.abs(relative).alias("gradient"))


@query("h10_scaling", _grid_sql(HOUR) + """, z AS (SELECT space_id, ds, coalesce(y, 0) AS y FROM q), st AS (SELECT space_id, min(y) AS lo, max(y) - min(y) AS w, avg(y) AS m, stddev_pop(y) AS sd FROM z GROUP BY space_id)
SELECT z.space_id, ds, round((y - lo) / w, 6) AS minmax, round((y - m) / sd, 6) AS standard FROM z JOIN st ON z.space_id = st.space_id""")
def _(spark, sf):
    z = L.fill_timeline(series(spark, sf, HOUR), HOUR, "zero")
    a = L.apply_scaling(z, L.scaling(z)).select("space_id", "ds", F.round("y", 6).alias("minmax"))
    b = L.apply_scaling(z, L.scaling(z, "standard")).select("space_id", "ds", F.round("y", 6).alias("standard"))
    return a.join(b, ["space_id", "ds"])


WINDOW = ["y", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "holiday"]


def windows(spark, sf, k: int = 24) -> DataFrame:
    z = L.fill_timeline(series(spark, sf, HOUR), HOUR, "zero")
    return L.sequences(A.cyclic_features(z), k, HOUR, WINDOW)


@query("h11_sequences", _grid_sql(HOUR) + f""", z AS (SELECT space_id, ds, coalesce(y, 0) AS y, round(sin(2 * pi() * (hour(ds) + minute(ds) / 60.0) / 24.0), 6) AS hs FROM q)
SELECT space_id, ds, first AS first_y, last AS last_y, {_r('hs_sum', 4)} AS hour_sin_sum, y AS target FROM (SELECT *, first_value(y) OVER w AS first, last_value(y) OVER w AS last, sum(hs) OVER w AS hs_sum, count(*) OVER w AS k
  FROM z WINDOW w AS (PARTITION BY space_id ORDER BY ds ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) WHERE k = 24""")
def _(spark, sf):
    w = windows(spark, sf)
    hs = F.aggregate(F.transform("window", lambda r: F.round(r[1], 6)), F.lit(0.0), lambda a, x: a + x)
    return w.select("space_id", "ds", F.col("window")[0][0].alias("first_y"), F.col("window")[23][0].alias("last_y"), F.round(hs, 4).alias("hour_sin_sum"), "target")


@query("h12_autoregressive_forecast")
def _(spark, sf):
    w = durable(windows(spark, sf))
    cut = w.agg(F.max("ds").alias("hi")).select(F.timestamp_add("DAY", F.lit(-3), F.col("hi")).alias("t")).first().t
    model = H.fit_autoregressive(w.where(F.col("ds") <= F.lit(str(cut)).cast("timestamp_ntz")))
    return H.predict_autoregressive(w.where(F.col("ds") > F.lit(str(cut)).cast("timestamp_ntz")), model).select("space_id", "ds", "target", "yhat")


# A linear recursion of one lag, fitted on the first nine tenths of each space.
ONE_LAG = _grid_sql(HOUR) + """, z AS (SELECT space_id, ds, coalesce(y, 0) AS y FROM q), p AS (SELECT * FROM (SELECT space_id, ds, y, lag(y) OVER (PARTITION BY space_id ORDER BY ds) AS x FROM z) WHERE x IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY ds) <= floor(count(*) OVER (PARTITION BY space_id) * (1.0::DOUBLE - 0.1::DOUBLE)) AS is_train FROM p),
c AS (SELECT space_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept FROM r WHERE is_train GROUP BY space_id)"""


def one_lag(spark, sf):
    rows = durable(L.time_split(windows(spark, sf, 1), HOUR))
    train, test = H.lagged(rows.where("is_train")), H.lagged(rows.where("NOT is_train"))
    return train, test, durable(least_squares(train, "space_id"))


@query("h13_forecast_errors", ONE_LAG + """ SELECT space_id, round(sqrt(avg((e) * (e))), 6) AS rmse, round(avg(abs(e)), 6) AS mae, count(*) AS test_size
FROM (SELECT space_id, greatest(icept + slope * x, 0) - y AS e FROM r JOIN c USING (space_id) WHERE NOT is_train) GROUP BY space_id""")
def _(spark, sf):
    """Errors of one-step forecasts on the last tenth, by a recursion fitted on the rest."""
    _, test, coefs = one_lag(spark, sf)
    e = H.errors(H.predict_seasonal(test, coefs), keys=("space_id",))
    return e.select("space_id", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "test_size")


@query("h15_forecast_rollout", ONE_LAG + """, newest AS (SELECT space_id, ds, y FROM r JOIN c USING (space_id) WHERE is_train QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY ds DESC) = 1),
w AS (SELECT newest.space_id, 0 AS step, ds, y AS v, slope, icept FROM newest JOIN c USING (space_id) UNION ALL
  SELECT space_id, step + 1, ds + INTERVAL 3600 SECOND, greatest(icept + slope * v, 0), slope, icept FROM w WHERE step < 48) SELECT space_id, ds, CAST(step AS INTEGER) AS step, round(v, 6) AS yhat FROM w WHERE step > 0""")
def _(spark, sf):
    """Two days ahead of the training part, each prediction fed back into the next."""
    train, _, coefs = one_lag(spark, sf)
    return H.rollout(train.select("space_id", "ds", "y"), coefs, 48, HOUR).withColumn("yhat", F.round("yhat", 6))


@query("h14_binary_occupied", f"SELECT space_id, interval_begin_time AS ds, CAST(number_connections > 2 AS INTEGER) AS occupied FROM ({bins_sql(HOUR)})")
def _(spark, sf):
    return series(spark, sf, HOUR).select("space_id", "ds", L.binary_occupied("y").alias("occupied"))


@query("h15_history_or_forecast", _grid_sql(HOUR) + """, z AS (SELECT space_id, ds, coalesce(y, 0) AS y FROM q),
known AS (SELECT * FROM z WHERE ds BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'), span AS (SELECT space_id, min(ds) AS lo, max(ds) AS hi FROM known GROUP BY space_id),
usual AS (SELECT space_id, hour(ds) AS h, avg(y) AS y FROM known GROUP BY ALL)
SELECT space_id, ds, round(y, 6) AS y, 'history' AS source FROM known WHERE ds BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' UNION ALL
SELECT z.space_id, ds, round(u.y, 6), 'forecast' FROM z JOIN span s ON z.space_id = s.space_id JOIN usual u ON u.space_id = z.space_id AND u.h = hour(ds)
WHERE ds BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' AND (ds > hi OR ds < lo)""")
def _(spark, sf):
    """History where it is known, around it a forecast by the usual count of the hour."""
    z = L.fill_timeline(series(spark, sf, HOUR), HOUR, "zero").withColumn("h", F.hour("ds"))
    known = z.where("ds BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-25 00:00:00'")
    usual = known.groupBy("space_id", "h").agg(F.avg("y").alias("yhat"))
    guess = z.join(usual, ["space_id", "h"]).select("space_id", "ds", "yhat")
    both = L.history_or_forecast(known.drop("h"), guess, "2024-01-03 00:00:00", "2024-01-28 00:00:00")
    return both.withColumn("y", F.round("y", 6))
