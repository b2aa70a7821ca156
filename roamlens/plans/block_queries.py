"""Registered queries of the building blocks: sources, scoping, scalar
expressions, joins, aggregates, windows, sets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F

from roamlens.functions import times as C, values as V
from roamlens.operators import metrics as M
from roamlens.operators.bins import explode_bins, occupancy_bins
from roamlens.operators.copresence import CLASSROOMS
from roamlens.operators.grains import compute, session_columns
from roamlens.operators.label_model import argmax
from roamlens.operators.ordered import top_one
from roamlens.operators.overlap import overlap_left_join, overlap_self_join
from roamlens.operators.paging import Pages
from roamlens.operators.profile import profile_columns, top_values
from roamlens.operators.scope import bind_query, entity_index, find_spaces, preview, scope_to
from roamlens.operators.subsets import derive_entities
from roamlens.operators.timeline import as_series, fill_timeline, sequences, time_split
from roamlens.operators.training import merge_features
from roamlens.operators.tree import closure
from roamlens.operators.votes import label_matrix, lf_python
from roamlens.session import shared_folder
from roamlens.sources import driver_tables as T
from roamlens.sources.tables import read_sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# sources, scoping, paging, profiles


@query("s01_read_sessions", "SELECT event_type, count(*) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY event_type")
def _(spark, sf):
    return read_sessions(spark, f"{sf}/events.parquet").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))


@query("s05_entity_index", "SELECT DISTINCT mac_address FROM s")
def _(spark, sf):
    return entity_index(T.sessions(spark, sf))


def _busy(spark, sf):
    """Devices seen in the room of most sessions or more rooms than one."""
    return T.sessions(spark, sf).groupBy("mac_address").agg(F.count_distinct("space_id").alias("k")).where("k >= 3").select("mac_address")


_BUSY = "(SELECT mac_address FROM s GROUP BY mac_address HAVING count(DISTINCT space_id) >= 3)"


@query("s06_scope_to", f"SELECT mac_address, count(*) AS n FROM s WHERE mac_address IN {_BUSY} GROUP BY mac_address")
def _(spark, sf):
    return scope_to(T.sessions(spark, sf), _busy(spark, sf)).groupBy("mac_address").agg(F.count("*").alias("n"))


@query("s07_bind_query", f"""SELECT mac_address, count(*) FILTER (us / 1e6 >= 1800) AS long_count, count(*) AS total_count FROM s
WHERE mac_address IN {_BUSY} GROUP BY mac_address""")
def _(spark, sf):
    sql = """SELECT mac_address, count_if(timestampdiff(MICROSECOND, start_time, end_time) / 1e6 >= {{min_seconds}}) AS long_count,
             count(*) AS total_count FROM user_ap_trajectory WHERE mac_address IN (:index_values) GROUP BY mac_address"""
    return bind_query(sql, _busy(spark, sf), {"user_ap_trajectory": T.sessions(spark, sf)}, {"min_seconds": 1800})


@query("s08_preview", "SELECT * FROM sessions ORDER BY start_time, mac_address LIMIT 100 OFFSET 50")
def _(spark, sf):
    return preview(T.sessions(spark, sf), ["start_time", "mac_address"], 100, 50)


@query("s08_seek_page", "SELECT mac_address, space_id, start_time FROM sessions ORDER BY start_time, mac_address LIMIT 120 OFFSET 650")
def _(spark, sf):
    s = T.sessions(spark, sf).select("mac_address", "space_id", "start_time")
    pages = Pages.write(s, ["start_time", "mac_address"], f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}", parts=16)
    return pages.page(120, 650)


@query("s08_seek_after", """SELECT mac_address, space_id, start_time FROM sessions WHERE start_time > (SELECT start_time + (max_time - start_time) / 2 FROM
  (SELECT min(start_time) AS start_time, max(start_time) AS max_time FROM sessions)) ORDER BY start_time, mac_address LIMIT 50""")
def _(spark, sf):
    s = T.sessions(spark, sf).select("mac_address", "space_id", "start_time")
    lo, hi = s.agg(F.min("start_time"), F.max("start_time")).first()
    pages = Pages.write(s, ["start_time", "mac_address"], f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}", parts=16)
    return pages.after([lo + (hi - lo) / 2, "~"], 50)


@query("s09_find_spaces", """SELECT space_id, space_name, parent_space_id, building_room FROM space WHERE space_name ILIKE '%nation_1%'
ORDER BY space_name, space_id LIMIT 100""")
def _(spark, sf):
    return find_spaces(T.space(spark, sf), "nation_1", limit=100)


def _number(c: str, t: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, min({v}) AS min, max({v}) AS max,
  round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, CAST(NULL AS BIGINT) AS unique_count FROM orders"""


def _other(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, NULL, NULL, NULL, NULL,
  count(DISTINCT {c}) AS unique_count FROM orders"""


@query("s10_profile_columns", "SELECT * FROM (" + " UNION ALL ".join(
    [_number("o_orderkey", "bigint"), _number("o_custkey", "bigint"), _number("o_totalprice", "double"),
     _other("o_orderstatus", "string"), _other("o_orderdate", "timestamp_ntz"), _other("o_orderpriority", "string")]) + ")")
def _(spark, sf):
    return profile_columns(T.table(spark, sf, "orders"))


@query("s10_top_values", """WITH v AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
g AS (SELECT column_name, value, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rank FROM v GROUP BY column_name, value)
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, n FROM g WHERE rank <= 5""")
def _(spark, sf):
    return top_values(T.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


# scalar expressions


@query("p01_durations", "SELECT mac_address, start_time, us / 1e6 AS seconds, us / 1e6 / 60.0 AS minutes, us / 1e6 / 3600.0 AS hours FROM s")
def _(spark, sf):
    a, b = "start_time", "end_time"
    return T.sessions(spark, sf).select("mac_address", a, C.seconds(a, b).alias("seconds"), C.minutes(a, b).alias("minutes"), C.hours(a, b).alias("hours"))


@query("p02_whole_units", "SELECT mac_address, start_time, us // 60000000 AS minutes, us // 3600000000 AS hours, us // 1000000 AS seconds FROM s")
def _(spark, sf):
    a, b = "start_time", "end_time"
    return T.sessions(spark, sf).select("mac_address", a, *[C.whole(u, a, b).alias(u.lower() + "s") for u in ("MINUTE", "HOUR", "SECOND")])


@query("p03_days_between", """SELECT mac_address, min(day) AS first_day, CAST(date_diff('day', min(day), max(CAST(end_time AS DATE))) AS INTEGER) AS days_between
FROM s GROUP BY mac_address""")
def _(spark, sf):
    d = T.sessions(spark, sf).groupBy("mac_address").agg(F.min(C.day("start_time")).alias("first_day"), F.max(C.day("end_time")).alias("l"))
    return d.select("mac_address", "first_day", F.datediff("l", "first_day").alias("days_between"))


@query("p04_clock_windows", """SELECT count(*) FILTER (st BETWEEN '09:00:00' AND '17:00:00') AS inside, count(*) FILTER (st >= '22:00:00') AS late,
  count(*) FILTER (et <= '05:00:00') AS early, space_id FROM s GROUP BY space_id""")
def _(spark, sf):
    return T.sessions(spark, sf).groupBy("space_id").agg(
        V.count_where(C.in_clock("start_time", "09:00:00", "17:00:00")).alias("inside"),
        V.count_where(C.at_or_after("start_time", "22:00")).alias("late"),
        V.count_where(C.at_or_before("end_time", "05:00")).alias("early"))


@query("p05_weekdays", """SELECT space_id, count(*) FILTER (dow BETWEEN 1 AND 5) AS monday_to_friday, count(*) FILTER (dow IN (7, 1, 2, 3, 4)) AS sunday_to_thursday
FROM s GROUP BY space_id""")
def _(spark, sf):
    return T.sessions(spark, sf).groupBy("space_id").agg(
        V.count_where(C.on_days("start_time")).alias("monday_to_friday"),
        V.count_where(C.on_days("start_time", C.SUNDAY_TO_THURSDAY)).alias("sunday_to_thursday"))


@query("p06_hour_bins", """SELECT (hour(start_time) // 2)::VARCHAR || '-' || (hour(end_time) // 2)::VARCHAR AS bin_pair, count(*) AS n FROM s GROUP BY 1""")
def _(spark, sf):
    pair = F.concat_ws("-", C.hour_bin("start_time"), C.hour_bin("end_time"))
    return T.sessions(spark, sf).groupBy(pair.alias("bin_pair")).agg(F.count("*").alias("n"))


@query("p07_guarded_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax / nullif(l_discount, 0) AS ratio, coalesce(l_tax / nullif(l_discount, 0), 0) AS or_zero FROM lineitem")
def _(spark, sf):
    r = V.ratio("l_tax", "l_discount")
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.alias("ratio"), V.or_zero(r).alias("or_zero"))


@query("p08_conditional_counts", """SELECT mac_address, count(*) FILTER (us / 1e6 >= 3600) AS long_count, CAST(sum(CASE WHEN us / 1e6 >= 3600 THEN us ELSE 0 END) AS BIGINT) AS long_us,
  count(DISTINCT CASE WHEN us / 1e6 >= 3600 THEN space_id END) AS long_spaces FROM s GROUP BY mac_address""")
def _(spark, sf):
    long = F.col("us") >= 3_600_000_000
    return session_columns(T.sessions(spark, sf)).groupBy("mac_address").agg(
        V.count_where(long).alias("long_count"), V.sum_where(long, "us").alias("long_us"), V.distinct_where(long, "space_id").alias("long_spaces"))


@query("p09_literal_lists", """SELECT mac_address, count(*) FILTER (type IN ('office', 'student lab')) AS inside, count(*) FILTER (type NOT IN ('office', 'student lab')) AS outside
FROM typed GROUP BY mac_address""")
def _(spark, sf):
    inside = F.col("type").isin("office", "student lab")
    return _typed(spark, sf).groupBy("mac_address").agg(V.count_where(inside).alias("inside"), V.count_where(~inside).alias("outside"))


@query("p10_overlap_length", """SELECT mac_address, start_time, date_diff('microsecond', greatest(start_time, day + INTERVAL 9 HOUR), least(end_time, day + INTERVAL 17 HOUR)) AS us FROM s
WHERE start_time < day + INTERVAL 17 HOUR AND day + INTERVAL 9 HOUR < end_time""")
def _(spark, sf):
    midnight = F.to_date("start_time").cast("timestamp_ntz")
    a, b = (F.timestamp_add("HOUR", F.lit(h), midnight) for h in (9, 17))
    return T.sessions(spark, sf).where(V.overlaps("start_time", "end_time", a, b)).select(
        "mac_address", "start_time", V.overlap_us("start_time", "end_time", a, b).alias("us"))


@query("p11_epoch_alignment", "SELECT time_bucket(INTERVAL 7200 SECOND, start_time, TIMESTAMP '1970-01-01') AS slot_begin, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    return T.sessions(spark, sf).groupBy(C.align_down("start_time", 7200).alias("slot_begin")).agg(F.count("*").alias("n"))


@query("p12_ap_names", """SELECT sensor_id, contains(sensor_id, 'ap-1') AS on_floor, left(split_part(sensor_id, '-', 1), -1) AS building, count(*) AS n FROM s GROUP BY ALL""")
def _(spark, sf):
    return T.sessions(spark, sf).groupBy(
        "sensor_id", V.ap_contains("sensor_id", "ap-1").alias("on_floor"), V.ap_building("sensor_id").alias("building")
    ).agg(F.count("*").alias("n"))


@query("p13_label_filters", "SELECT doc_id, CAST(quality AS VARCHAR) AS class_id, CAST(doc_id % 10 AS DOUBLE) / 10 AS min_confidence FROM labels")
def _(spark, sf):
    doc = F.concat(F.lit('{"labels": {"'), F.col("quality").cast("string"), F.lit('": {"min_confidence": '),
                   (F.col("doc_id") % 10 / F.lit(10.0)).cast("string"), F.lit("}}}"))
    d = T.table(spark, sf, "labels").select("doc_id", V.parse_label_filter(doc)["labels"].alias("m"))
    return d.select("doc_id", F.explode("m").alias("class_id", "r")).select("doc_id", "class_id", F.col("r.min_confidence").alias("min_confidence"))


# joins


def _typed(spark, sf) -> DataFrame:
    return T.sessions(spark, sf).join(T.space(spark, sf).select("space_id", "building_room"), "space_id").join(
        T.space_metadata(spark, sf).select("building_room", "type"), "building_room")


def _rooms_of_sessions(spark, sf, *keys: str) -> DataFrame:
    """(keys, building_room, n): sessions are counted before offices, which may have many names, multiply them."""
    per_space = T.sessions(spark, sf).groupBy(*keys, "space_id").agg(F.count("*").alias("n"))
    rooms = per_space.join(T.space(spark, sf).select("space_id", "building_room"), "space_id")
    return rooms.groupBy(*keys, "building_room").agg(F.sum("n").alias("n"))


def _faculty(spark, sf) -> DataFrame:
    return T.faculty_data(spark, sf).select(F.col("office").alias("building_room"), "name")


@query("j01_dimension_chain", "SELECT sp.building_room, f.name, count(*) AS n FROM s JOIN space sp ON s.space_id = sp.space_id JOIN faculty_data f ON sp.building_room = f.office GROUP BY ALL")
def _(spark, sf):
    return _rooms_of_sessions(spark, sf).join(_faculty(spark, sf), "building_room").groupBy("building_room", "name").agg(F.sum("n").alias("n"))


@query("j02_left_outer", """SELECT t.mac_address, coalesce(x.c, 0) AS faculty_count FROM totals t LEFT JOIN
  (SELECT mac_address, count(*) AS c FROM faculty GROUP BY mac_address) x ON t.mac_address = x.mac_address""")
def _(spark, sf):
    names = _faculty(spark, sf).groupBy("building_room").agg(F.count("*").alias("names"))
    x = _rooms_of_sessions(spark, sf, "mac_address").join(names, "building_room").groupBy("mac_address").agg(F.sum(F.col("n") * F.col("names")).alias("c"))
    return entity_index(T.sessions(spark, sf)).join(x, "mac_address", "left").select("mac_address", V.or_zero("c").alias("faculty_count"))


@query("j03_left_anti", """SELECT sm.type, count(*) AS n FROM s JOIN space sp ON s.space_id = sp.space_id JOIN space_metadata sm ON sp.building_room = sm.building_room
LEFT JOIN faculty_data f ON sp.building_room = f.office WHERE f.office IS NULL GROUP BY sm.type""")
def _(spark, sf):
    offices = T.faculty_data(spark, sf).select(F.col("office").alias("building_room"))
    return _typed(spark, sf).join(offices, "building_room", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query("j04_left_semi", "SELECT space_id, count(*) AS n FROM s WHERE space_id IN (SELECT sp.space_id FROM space sp JOIN faculty_data f ON sp.building_room = f.office) GROUP BY space_id")
def _(spark, sf):
    offices = T.faculty_data(spark, sf).select(F.col("office").alias("building_room"))
    rooms = T.space(spark, sf).join(offices, "building_room", "left_semi").select("space_id")
    return T.sessions(spark, sf).join(rooms, "space_id", "left_semi").groupBy("space_id").agg(F.count("*").alias("n"))


@query("j05_both_conditions", """SELECT mac_address, day FROM typed WHERE type = 'office' INTERSECT
SELECT mac_address, day FROM s GROUP BY mac_address, day HAVING count(DISTINCT space_id) <= 2""")
def _(spark, sf):
    s = session_columns(T.sessions(spark, sf))
    few = s.groupBy("mac_address", "day").agg(F.count_distinct("space_id").alias("k")).where("k <= 2").drop("k")
    office = session_columns(_typed(spark, sf)).where("type = 'office'").select("mac_address", "day").distinct()
    return few.join(office, ["mac_address", "day"])


@query("j06_overlap_join", """SELECT t.mac_address AS target, u.mac_address AS other, t.space_id, t.start_time AS target_start, u.start_time AS other_start FROM s t JOIN s u
ON t.space_id = u.space_id AND t.mac_address <> u.mac_address AND t.start_time < u.end_time AND u.start_time < t.end_time""")
def _(spark, sf):
    s = T.sessions(spark, sf).select("mac_address", "space_id", "start_time", "end_time")
    # both orders of a pair come from one shuffle, and rows of one target stand together in either
    pairs = overlap_self_join(s, "space_id", "mac_address")
    columns = lambda t, u: [
        F.col(f"{t}.mac_address").alias("target"), F.col(f"{u}.mac_address").alias("other"), F.col("l.space_id").alias("space_id"),
        F.col(f"{t}.start_time").alias("target_start"), F.col(f"{u}.start_time").alias("other_start")]
    return pairs.select(*columns("l", "r")).unionByName(pairs.select(*columns("r", "l")))


@query("j07_overlap_left_join", """SELECT u.mac_address, u.start_time, o.start_time AS interval_start, o.number_connections FROM s u
LEFT JOIN (SELECT * FROM occ WHERE number_connections >= 2) o ON u.space_id = o.space_id AND u.start_time <= o.end_time AND o.start_time <= u.end_time""")
def _(spark, sf):
    s = T.sessions(spark, sf).select("mac_address", "space_id", "start_time", "end_time")
    crowded = T.space_occupancy(spark, sf).where("number_connections >= 2")
    return overlap_left_join(s, crowded, "space_id", ["mac_address", "start_time"]).select(
        "l.mac_address", "l.start_time", F.col("r.start_time").alias("interval_start"), "r.number_connections")


@query("j08_sessions_to_bins", """SELECT mac_address, start_time, count(*) AS bins FROM (SELECT mac_address, start_time, unnest(generate_series(
  time_bucket(INTERVAL 3600 SECOND, start_time, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3600 SECOND, end_time - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'),
  INTERVAL 3600 SECOND)) AS b FROM s) GROUP BY ALL""")
def _(spark, sf):
    return explode_bins(T.sessions(spark, sf), 3600).groupBy("mac_address", "start_time").agg(F.count("*").alias("bins"))


@query("j09_equi_join", """SELECT m.mac_address, m.matched_count, t.total_count FROM (SELECT mac_address, count(*) AS matched_count FROM s WHERE st >= '22:00:00' GROUP BY mac_address) m,
  (SELECT mac_address, count(*) AS total_count FROM s GROUP BY mac_address) t WHERE m.mac_address = t.mac_address""")
def _(spark, sf):
    s = T.sessions(spark, sf)
    m = s.where(C.at_or_after("start_time", "22:00")).groupBy("mac_address").agg(F.count("*").alias("matched_count"))
    return m.join(s.groupBy("mac_address").agg(F.count("*").alias("total_count")), "mac_address")


@query("j10_feature_merge", """SELECT t.mac_address, w.long_session_days, f.faculty_pct, f.faculty_days FROM totals t LEFT JOIN
  (SELECT mac_address, count(DISTINCT day) AS long_session_days FROM typed WHERE type IN ('office', 'meeting room') AND us / 1e6 / 3600.0 >= 2 GROUP BY mac_address) w
  ON t.mac_address = w.mac_address LEFT JOIN (SELECT x.mac_address, CAST(x.c AS DOUBLE) / t2.total AS faculty_pct, x.d AS faculty_days FROM
  (SELECT mac_address, count(*) AS c, count(DISTINCT day) AS d FROM faculty WHERE us / 1e6 / 60.0 >= 10 GROUP BY mac_address) x JOIN totals t2 ON x.mac_address = t2.mac_address) f
  ON t.mac_address = f.mac_address""")
def _(spark, sf):
    s, d = T.sessions(spark, sf), T.dims(spark, sf)
    return merge_features(entity_index(s), [compute(M.long_session_days(), s, None, d), compute(M.faculty_visits(), s, None, d)])


# aggregates, windows, sets


@query("a01_group_by", """SELECT mac_address, day, space_id, count(*) AS n, CAST(sum(us) AS BIGINT) AS us, min(start_time) AS first_start, max(end_time) AS last_end
FROM s GROUP BY mac_address, day, space_id""")
def _(spark, sf):
    return session_columns(T.sessions(spark, sf)).groupBy("mac_address", "day", "space_id").agg(
        F.count("*").alias("n"), F.sum("us").alias("us"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))


@query("a02_distinct_counts", "SELECT mac_address, count(DISTINCT day) AS days, count(DISTINCT space_id) AS spaces, count(DISTINCT sensor_id) AS sensors FROM s GROUP BY mac_address")
def _(spark, sf):
    return session_columns(T.sessions(spark, sf)).groupBy("mac_address").agg(
        F.count_distinct("day").alias("days"), F.count_distinct("space_id").alias("spaces"), F.count_distinct("sensor_id").alias("sensors"))


@query("a03_two_stage", """SELECT mac_address, count(*) AS days, max(n) AS busiest FROM (SELECT mac_address, day, count(*) AS n FROM s GROUP BY mac_address, day) GROUP BY mac_address""")
def _(spark, sf):
    d = session_columns(T.sessions(spark, sf)).groupBy("mac_address", "day").agg(F.count("*").alias("n"))
    return d.groupBy("mac_address").agg(F.count("*").alias("days"), F.max("n").alias("busiest"))


@query("a04_three_stage", """WITH r AS (SELECT mac_address, day, space_id, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT mac_address, day, count(*) AS k, max(n) AS m FROM r GROUP BY ALL)
SELECT mac_address, CAST(sum(k) AS BIGINT) AS room_days, max(m) AS busiest_room_day FROM d GROUP BY mac_address""")
def _(spark, sf):
    r = session_columns(T.sessions(spark, sf)).groupBy("mac_address", "day", "space_id").agg(F.count("*").alias("n"))
    d = r.groupBy("mac_address", "day").agg(F.count("*").alias("k"), F.max("n").alias("m"))
    return d.groupBy("mac_address").agg(F.sum("k").alias("room_days"), F.max("m").alias("busiest_room_day"))


@query("a05_having", "SELECT mac_address, day, count(DISTINCT space_id) AS rooms FROM s GROUP BY mac_address, day HAVING count(DISTINCT space_id) BETWEEN 3 AND 5")
def _(spark, sf):
    return session_columns(T.sessions(spark, sf)).groupBy("mac_address", "day").agg(F.count_distinct("space_id").alias("rooms")).where("rooms BETWEEN 3 AND 5")


@query("w01_top_one", """SELECT mac_address, space_name FROM (SELECT mac_address, space_name, row_number() OVER (PARTITION BY mac_address ORDER BY count(*) DESC, space_name) AS rn
FROM s JOIN region_to_coverage r ON s.sensor_id = r.sensor GROUP BY mac_address, space_name) WHERE rn = 1""")
def _(spark, sf):
    per = T.sessions(spark, sf).groupBy("mac_address", "sensor_id").agg(F.count("*").alias("n")).join(T.dims(spark, sf).regions(CLASSROOMS), "sensor_id")
    return top_one(per.groupBy("mac_address", "space_name").agg(F.sum("n").alias("n")), ["mac_address"], F.col("n"), "space_name")


@query("w02_argmax", """WITH c AS (SELECT mac_address, isodow(start_time) - 1 AS d, count(*) AS n FROM s GROUP BY ALL)
SELECT mac_address, CAST(arg_max(d, n * 10 - d) AS INTEGER) AS label FROM c GROUP BY mac_address""")
def _(spark, sf):
    counts = T.sessions(spark, sf).groupBy("mac_address").agg(F.array(*[F.count_if(F.weekday("start_time") == d) for d in range(7)]).alias("counts"))
    return counts.select("mac_address", argmax("counts").alias("label"))


@query("w03_forward_fill")  # compared as h02
def _(spark, sf):
    return fill_timeline(as_series(occupancy_bins(T.sessions(spark, sf), 1800)), 1800)


@query("w04_sliding_windows", """WITH b AS (SELECT space_id, time_bucket(INTERVAL 3600 SECOND, start_time, TIMESTAMP '1970-01-01') AS ds, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT space_id, unnest(generate_series(min(ds), max(ds), INTERVAL 3600 SECOND)) AS ds FROM b GROUP BY space_id),
z AS (SELECT g.space_id, g.ds, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM g LEFT JOIN b ON g.space_id = b.space_id AND g.ds = b.ds),
l AS (SELECT space_id, ds, y, sum(y) OVER w AS past_sum, max(y) OVER w AS past_max, count(*) OVER w AS k FROM z WINDOW w AS (PARTITION BY space_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT space_id, ds, past_sum, past_max, y AS target FROM l WHERE k = 6""")
def _(spark, sf):
    starts = T.sessions(spark, sf).groupBy("space_id", C.align_down("start_time", 3600).alias("ds")).agg(F.count("*").cast("double").alias("y"))
    w = sequences(fill_timeline(starts, 3600, "zero"), 6, 3600)
    flat = F.flatten("window")
    return w.select("space_id", "ds", F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("past_sum"), F.array_max(flat).alias("past_max"), "target")


@query("w06_time_split", """WITH b AS (SELECT space_id, ds, count(*) AS y FROM (SELECT space_id, time_bucket(INTERVAL 3600 SECOND, start_time, TIMESTAMP '1970-01-01') AS ds FROM s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY space_id) AS n FROM b)
SELECT space_id, ds, y, rn <= floor(n * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS is_train FROM r""")
def _(spark, sf):
    starts = T.sessions(spark, sf).groupBy("space_id", C.align_down("start_time", 3600).alias("ds")).agg(F.count("*").alias("y"))
    return time_split(starts, 3600)


@query("t01_top_k", "SELECT space_id, count(*) AS n FROM s GROUP BY space_id ORDER BY n DESC, space_id LIMIT 5 OFFSET 2")
def _(spark, sf):
    return T.sessions(spark, sf).groupBy("space_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "space_id").offset(2).limit(5)


@query("u01_union_all", "SELECT space_id, 'start' AS edge, start_time AS at FROM s UNION ALL SELECT space_id, 'end', end_time FROM s")
def _(spark, sf):
    s = T.sessions(spark, sf)
    return s.select("space_id", F.lit("start").alias("edge"), F.col("start_time").alias("at")).unionByName(
        s.select("space_id", F.lit("end").alias("edge"), F.col("end_time").alias("at")))


@query("u02_union_of_subsets", """SELECT mac_address FROM (SELECT mac_address, CAST(count(*) FILTER (dow <= 5) AS DOUBLE) / count(*) AS p0, CAST(count(*) FILTER (dow > 5) AS DOUBLE) / count(*) AS p1
FROM s GROUP BY mac_address) WHERE p0 >= 0.8 OR p1 >= 0.3""")
def _(spark, sf):
    s = T.sessions(spark, sf)
    week = C.on_days("start_time")
    preds = s.groupBy("mac_address").agg(F.array(V.ratio(F.count_if(week), F.count("*")), V.ratio(F.count_if(~week), F.count("*"))).alias("probs"))
    rule = json.dumps({"labels": {"4": {"min_confidence": 0.8}, "5": {"min_confidence": 0.3}, "99": {}}})
    return derive_entities(entity_index(s), preds, rule, [4, 5])


@query("u03_recursive_closure", """, up AS (SELECT space_id AS descendant, space_id AS ancestor, 0 AS depth FROM space UNION ALL
SELECT u.descendant, p.parent_space_id, u.depth + 1 FROM up u JOIN space p ON p.space_id = u.ancestor WHERE p.parent_space_id IS NOT NULL) SELECT * FROM up""")
def _(spark, sf):
    return closure(T.space(spark, sf))


@query("f01_python_vote", """SELECT mac_address, CASE WHEN CAST(count(*) FILTER (us / 1e6 / 3600 <= 2) AS DOUBLE) / count(*) >= 0.9 THEN 2 WHEN count(DISTINCT space_id) = 1 THEN 0 ELSE -1 END AS vote
FROM s GROUP BY mac_address""")
def _(spark, sf):
    def rule(row):
        if row["connection_count"] >= 0.9:
            return 3
        return 1 if row["distinct_ap"] == 1 else 77  # not an allowed class: abstains

    metric = compute(M.short_sessions_share(), T.sessions(spark, sf))
    lf = lf_python("python_rule", rule, ["connection_count", "distinct_ap"], (1, 2, 3))
    votes = label_matrix(metric, [(metric, [lf])])
    return votes.select("mac_address", F.col("votes")[0].alias("vote"))
