"""Registered occupancy queries: bins, tree, ledger, refresh, stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlens.operators import bin_store as S, bins as B, bitmaps as M, chunks as K, tree as R
from roamlens import session
from roamlens.session import durable
from roamlens.sources import driver_tables as T
from roamlens.streaming.occupancy_state import start_stateful_occupancy
from roamlens.streaming.occupancy_stream import read_session_stream, start_occupancy_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The clipping queries cut the sessions at both ends, off the bin edges.
START, END = "2024-01-01 00:20:00", "2024-02-03 21:50:00"
# All other windows are those of the sessions at hand.
FIRST, LAST = "(SELECT min(start_time) FROM sessions)", "(SELECT max(end_time) FROM sessions)"
HOUR = 3600


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors see."""
    return f"{session.shared_folder(spark)}/roamlens-{uuid.uuid4().hex}"


def window(spark, sf):
    found = R.time_bounds(T.sessions(spark, sf), T.space(spark, sf), 1).first()
    return found["min_time"], found["max_time"]


# Sessions of some devices are seen on the floor, not in a room: sources with sources below them.
INNER = """, inner_s AS (SELECT mac_address, sensor_id, CASE WHEN CAST(mac_address AS INTEGER) % 11 = 0 THEN 10 + space_id % 5 ELSE space_id END AS space_id,
  start_time, end_time FROM sessions)"""


def inner_sessions(spark, sf) -> DataFrame:
    floor = F.col("mac_address").cast("int") % 11 == 0
    return T.sessions(spark, sf).withColumn("space_id", F.when(floor, 10 + F.col("space_id") % 5).otherwise(F.col("space_id")))


def bins_sql(seconds: int, start: str | None = None, end: str | None = None, sessions: str = "sessions") -> str:
    """Bins by a join of a generated series with the sessions."""
    lo = f"TIMESTAMP '{start}'" if start else "(SELECT min(start_time) FROM sessions)"
    hi = f"TIMESTAMP '{end}'" if end else "(SELECT max(greatest(start_time, end_time)) + INTERVAL 2 DAY FROM sessions)"
    bucket = f"INTERVAL {seconds} SECOND"
    clip = f"AND x.start_time < {hi} AND x.end_time > {lo}" if start else ""
    return f"""SELECT x.space_id, b.t AS interval_begin_time, count(DISTINCT x.mac_address) AS number_connections
FROM (SELECT unnest(generate_series(time_bucket({bucket}, {lo}, TIMESTAMP '1970-01-01'), time_bucket({bucket}, {hi}, TIMESTAMP '1970-01-01') - {bucket}, {bucket})) AS t) b
JOIN {sessions} x ON x.start_time < b.t + {bucket} AND x.end_time > b.t {clip} GROUP BY x.space_id, b.t"""


CLOSURE = """up AS (SELECT space_id AS descendant, space_id AS ancestor, 0 AS depth FROM space UNION ALL
SELECT u.descendant, p.parent_space_id, u.depth + 1 FROM up u JOIN space p ON p.space_id = u.ancestor WHERE p.parent_space_id IS NOT NULL)"""


def rollup_sql(bins: str) -> str:
    """Sums of children level by level from below; sources keep their own."""
    return f""", {CLOSURE}, b AS ({bins}), src AS (SELECT DISTINCT space_id FROM b),
barrier AS (SELECT descendant, min(depth) AS stop FROM up WHERE depth > 0 AND ancestor IN (SELECT space_id FROM src) GROUP BY descendant)
SELECT up.ancestor AS space_id, b.interval_begin_time, CAST(sum(b.number_connections) AS BIGINT) AS number_connections
FROM b JOIN up ON up.descendant = b.space_id LEFT JOIN barrier w ON w.descendant = b.space_id
WHERE up.depth = 0 OR w.stop IS NULL OR up.depth < w.stop GROUP BY ALL"""


@query("b01_occupancy_bins", bins_sql(HOUR))
def _(spark, sf):
    return B.occupancy_bins(T.sessions(spark, sf), HOUR)


@query("b01_occupancy_bins_clipped", bins_sql(HOUR, START, END))
def _(spark, sf):
    return B.occupancy_bins(T.sessions(spark, sf), HOUR, START, END)


@query("b01_occupancy_bins_quarter_hour", bins_sql(900))
def _(spark, sf):
    return B.occupancy_bins(T.sessions(spark, sf), 900)


@query("b01_occupancy_bins_day", bins_sql(86400, START, END))
def _(spark, sf):
    return B.occupancy_bins(T.sessions(spark, sf), 86400, START, END)


@query("b02_time_bounds", "SELECT min(start_time) AS min_time, max(end_time) AS max_time FROM sessions WHERE space_id IN (SELECT space_id FROM space WHERE space_id = 10 OR parent_space_id = 10)")
def _(spark, sf):
    return R.time_bounds(T.sessions(spark, sf), T.space(spark, sf), 10)


@query("k01_descendants", "SELECT space_id, CASE WHEN space_id = 1 THEN 0 WHEN parent_space_id = 1 THEN 1 ELSE 2 END AS depth FROM space")
def _(spark, sf):
    return R.descendants(T.space(spark, sf), 1)


@query("k01_ancestors", f", {CLOSURE} SELECT ancestor AS space_id, depth FROM up WHERE descendant = 107")
def _(spark, sf):
    return R.ancestors(T.space(spark, sf), 107)


@query("k01_children_and_roots", "SELECT space_id, space_name, 'child' AS kind FROM space WHERE parent_space_id = 1 UNION ALL SELECT space_id, space_name, 'root' FROM space WHERE parent_space_id IS NULL")
def _(spark, sf):
    tree = T.space(spark, sf)
    cols = ["space_id", "space_name"]
    return R.children(tree, 1).select(*cols, F.lit("child").alias("kind")).unionByName(R.roots(tree).select(*cols, F.lit("root").alias("kind")))


CLASSIFY = f""", {CLOSURE}, busy AS (SELECT DISTINCT space_id FROM sessions WHERE start_time < {LAST} AND end_time > {FIRST}),
spaces AS (SELECT space_id, 'source' AS space_type FROM busy UNION ALL
  SELECT DISTINCT ancestor, 'derived' FROM up JOIN busy ON up.descendant = busy.space_id WHERE depth > 0 AND ancestor NOT IN (SELECT space_id FROM busy))"""


@query("k02_classify_spaces", CLASSIFY + " SELECT * FROM spaces")
def _(spark, sf):
    return R.classify_spaces(T.space(spark, sf), T.sessions(spark, sf), 1, *window(spark, sf))


@query("k03_rollup_tree", rollup_sql(bins_sql(HOUR)))
def _(spark, sf):
    s = T.sessions(spark, sf)
    return R.rollup_tree(B.occupancy_bins(s, HOUR), T.space(spark, sf), s)


DISTINCT_ROLLUP = f""", {CLOSURE} SELECT up.ancestor AS space_id, b AS interval_begin_time, count(DISTINCT mac_address) AS number_connections FROM
  (SELECT space_id, mac_address, unnest(generate_series(time_bucket(INTERVAL 3600 SECOND, start_time, TIMESTAMP '1970-01-01'),
     time_bucket(INTERVAL 3600 SECOND, end_time - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'), INTERVAL 3600 SECOND)) AS b FROM sessions) x
  JOIN up ON up.descendant = x.space_id GROUP BY ALL"""


@query("k04_distinct_rollup", DISTINCT_ROLLUP)
def _(spark, sf):
    return R.distinct_rollup(T.sessions(spark, sf), T.space(spark, sf), HOUR)


@query("k04_distinct_bitmaps", DISTINCT_ROLLUP)
def _(spark, sf):
    return M.distinct_rollup_bitmaps(T.sessions(spark, sf), T.space(spark, sf), HOUR)


@query("a02_distinct_by_bitmaps", "SELECT sensor_id, CAST(start_time AS DATE) AS day, count(DISTINCT mac_address) AS n FROM sessions GROUP BY ALL")
def _(spark, sf):
    s = T.sessions(spark, sf)
    return M.distinct_by(s.withColumn("day", F.to_date("start_time")), ["sensor_id", "day"], M.dense_numbers(s))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of whole days as an earlier run may have left them: most days of
    each room done, some pending, some missing, and the same for the floors."""
    s = T.sessions(spark, sf).select("space_id", F.to_date("start_time").alias("d")).distinct()
    rooms = s.where("day(d) % 3 <> 0").withColumn("space_type", F.lit("source"))
    floors = (
        rooms.join(T.space(spark, sf).select("space_id", "parent_space_id"), "space_id")
        .select(F.col("parent_space_id").alias("space_id"), "d", F.lit("derived").alias("space_type")).distinct()
    )
    start = F.col("d").cast("timestamp_ntz")
    return rooms.unionByName(floors).select(
        "space_id", F.lit(HOUR).alias("interval_seconds"), start.alias("chunk_start"),
        F.timestamp_add("DAY", F.lit(1), start).alias("chunk_end"), "space_type",
        F.when(F.expr("day(d) % 5 = 0"), "PENDING").otherwise("COMPLETED").alias("status"),
        F.timestamp_add("DAY", F.col("space_id") % 3 * 20 + 1, start).alias("completed_at"),
    )


LEDGER = """, rooms AS (SELECT DISTINCT space_id, CAST(start_time AS DATE) AS d, 'source' AS space_type FROM sessions WHERE day(start_time) % 3 <> 0),
every AS (SELECT * FROM rooms UNION ALL SELECT DISTINCT sp.parent_space_id, d, 'derived' FROM rooms JOIN space sp ON rooms.space_id = sp.space_id),
ledger AS (SELECT space_id, 3600 AS interval_seconds, CAST(d AS TIMESTAMP) AS chunk_start, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AS chunk_end, space_type,
  CASE WHEN day(d) % 5 = 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status, CAST(d AS TIMESTAMP) + to_days(CAST(space_id % 3 * 20 + 1 AS INTEGER)) AS completed_at FROM every)"""


@query("k05_stale_chunks", LEDGER + f""", {CLOSURE}, latest AS (SELECT space_id, max(end_time) AS m FROM sessions WHERE start_time < {LAST} AND end_time > {FIRST} GROUP BY space_id),
src AS (SELECT l.* FROM ledger l JOIN latest USING (space_id) WHERE status = 'COMPLETED' AND chunk_start < m AND chunk_end > {FIRST} AND completed_at < m)
SELECT * FROM src UNION SELECT * FROM ledger WHERE status = 'COMPLETED' AND chunk_start < {LAST} AND chunk_end > {FIRST}
  AND space_id IN (SELECT ancestor FROM up WHERE depth > 0 AND descendant IN (SELECT space_id FROM src))""")
def _(spark, sf):
    return K.stale_chunks(ledger(spark, sf), T.sessions(spark, sf), T.space(spark, sf), 1, HOUR, *window(spark, sf))


GAPS = f""", done AS (SELECT space_id, chunk_start AS cs, chunk_end AS ce FROM ledger WHERE status = 'COMPLETED' AND chunk_start < {LAST} AND chunk_end > {FIRST}
  UNION ALL SELECT space_id, {LAST}, {LAST} FROM spaces),
gaps AS (SELECT space_id, greatest({FIRST}, coalesce(max(ce) OVER (PARTITION BY space_id ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {FIRST})) AS gap_start,
  cs AS gap_end FROM done WHERE space_id IN (SELECT space_id FROM spaces))"""


def _spaces(spark, sf) -> DataFrame:
    return R.classify_spaces(T.space(spark, sf), T.sessions(spark, sf), 1, *window(spark, sf))


@query("k06_coverage_gaps", CLASSIFY + LEDGER + GAPS + " SELECT * FROM gaps WHERE gap_end > gap_start")
def _(spark, sf):
    return K.coverage_gaps(ledger(spark, sf), _spaces(spark, sf), HOUR, *window(spark, sf))


@query("k06_coverage_gaps_forced", CLASSIFY + f" SELECT space_id, {FIRST} AS gap_start, {LAST} AS gap_end FROM spaces")
def _(spark, sf):
    return K.coverage_gaps(ledger(spark, sf), _spaces(spark, sf), HOUR, *window(spark, sf), force=True)


@query("w05_running_maximum_gaps", CLASSIFY + LEDGER + GAPS + """ SELECT space_id, count(*) AS gaps,
  CAST(sum(date_diff('microsecond', gap_start, gap_end)) AS DOUBLE) / 1e6 AS seconds FROM gaps WHERE gap_end > gap_start GROUP BY space_id""")
def _(spark, sf):
    g = K.coverage_gaps(ledger(spark, sf), _spaces(spark, sf), HOUR, *window(spark, sf))
    return g.groupBy("space_id").agg(F.count("*").alias("gaps"), (F.sum(F.timestamp_diff("MICROSECOND", F.col("gap_start"), F.col("gap_end"))) / 1e6).alias("seconds"))


@query("k03_rollup_inner_sources", INNER + rollup_sql(bins_sql(HOUR, sessions="inner_s")))
def _(spark, sf):
    s = inner_sessions(spark, sf)
    return R.rollup_tree(B.occupancy_bins(s, HOUR), T.space(spark, sf), s)


# Preorder by the path of ids from above; ranges by the number of nodes below.
@query("k01_preorder_ranges", f""", {CLOSURE}, paths AS (SELECT descendant AS space_id, list(ancestor ORDER BY depth DESC) AS path, max(depth) AS depth FROM up GROUP BY descendant)
SELECT p.space_id, p.depth, row_number() OVER (ORDER BY path) - 1 AS "first", row_number() OVER (ORDER BY path) - 2 + n AS "last"
FROM paths p JOIN (SELECT ancestor AS space_id, count(*) AS n FROM up GROUP BY ancestor) USING (space_id)""")
def _(spark, sf):
    return R.preorder(T.space(spark, sf))


def _stored(spark, path: str) -> DataFrame:
    return S.read_bins(spark, path).select("space_id", "interval_begin_time", "number_connections")


@query("k07_delta_rollup", INNER + rollup_sql(bins_sql(HOUR, sessions="inner_s")))
def _(spark, sf):
    """What an hour of a first morning gave, plus the changes that all later sessions and sources make."""
    s, tree = inner_sessions(spark, sf), T.space(spark, sf)
    first = s.where(F.col("start_time") < F.lit("2024-01-01 08:00:00").cast("timestamp_ntz"))
    old, new = durable(B.occupancy_bins(first, HOUR)), B.occupancy_bins(s, HOUR)
    flows = R.source_flows(tree, old), R.source_flows(tree, s)
    delta = R.delta_rollup(R.bin_changes(old, new), flows[1], R.flow_changes(*flows), old)
    both = R.rollup_tree(old, tree, old).unionByName(delta.withColumnRenamed("change", "number_connections"))
    return both.groupBy(*R.BIN).agg(F.sum("number_connections").alias("number_connections")).where("number_connections <> 0")


def refreshed(spark, s: DataFrame, tree: DataFrame, *steps) -> DataFrame:
    """A new store after some refreshes: (sessions or None for all, root, start, end, completed_at, force)."""
    path = shared_folder(spark) + "/bins"
    for some, root, start, end, completed_at, force in steps:
        S.refresh_occupancy(s if some is None else some, tree, root, path, HOUR, start, end, completed_at, force)
    return _stored(spark, path)


@query("k07_refresh_occupancy", rollup_sql(bins_sql(HOUR)))
def _(spark, sf):
    """Two halves of the range, refreshed one after the other, give the whole."""
    (lo, hi), done = window(spark, sf), "2030-01-01 00:00:00"
    return refreshed(spark, T.sessions(spark, sf), T.space(spark, sf), (None, 1, lo, lo + (hi - lo) / 2, done, False), (None, 1, lo, hi, done, False))


BELOW = """, below AS (SELECT * FROM inner_s WHERE space_id IN (SELECT space_id FROM space WHERE space_id IN (10, 12) OR parent_space_id IN (10, 12)))"""


@query("k07_refresh_two_roots", INNER + BELOW + rollup_sql(bins_sql(HOUR, sessions="below")))
def _(spark, sf):
    """Two floors refreshed by themselves: the campus above them gets the sums of both."""
    (lo, hi), done = window(spark, sf), "2030-01-01 00:00:00"
    s = inner_sessions(spark, sf)
    return refreshed(spark, s, T.space(spark, sf), *[(None, root, lo, hi, done, False) for root in (10, 12)])


@query("k07_refresh_late_sessions", INNER + rollup_sql(bins_sql(HOUR, sessions="inner_s")))
def _(spark, sf):
    """Sessions that end after the first refresh make its chunks stale; the second one counts them."""
    lo, hi = window(spark, sf)
    s, middle = inner_sessions(spark, sf), lo + (hi - lo) / 2
    early = s.where(F.col("end_time") <= F.lit(middle))
    return refreshed(spark, s, T.space(spark, sf), (early, 1, lo, hi, middle, False), (None, 1, lo, hi, "2030-01-01 00:00:00", False))


GONE = "start_time < TIMESTAMP '2024-01-11 00:00:00' AND end_time > TIMESTAMP '2024-01-10 00:00:00'"


@query("k07_refresh_removed_day", INNER + f", remaining AS (SELECT * FROM inner_s WHERE NOT ({GONE}))" + rollup_sql(bins_sql(HOUR, sessions="remaining")))
def _(spark, sf):
    """Sessions of one day are withdrawn; a forced refresh takes them out of all sums."""
    (lo, hi), done = window(spark, sf), "2030-01-01 00:00:00"
    s = inner_sessions(spark, sf)
    remaining = s.where(f"NOT ({GONE.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')})")
    return refreshed(spark, s, T.space(spark, sf), (None, 1, lo, hi, done, False), (remaining, 1, lo, hi, done, True))


@query("k07_occupancy_stream", rollup_sql(bins_sql(HOUR)))
def _(spark, sf):
    return streamed(spark, T.sessions(spark, sf), T.space(spark, sf))


@query("k07_occupancy_stream_inner", INNER + rollup_sql(bins_sql(HOUR, sessions="inner_s")))
def _(spark, sf):
    return streamed(spark, inner_sessions(spark, sf), T.space(spark, sf))


@query("k07_occupancy_stateful", INNER + rollup_sql(bins_sql(HOUR, sessions="inner_s")))
def _(spark, sf):
    """Distinct devices kept as state of the stream."""
    base = arriving(spark, inner_sessions(spark, sf))
    start_stateful_occupancy(
        read_session_stream(spark, f"{base}/in", 3), T.space(spark, sf), f"{base}/bins", HOUR, f"{base}/checkpoint", parts=2
    ).awaitTermination()
    return _stored(spark, f"{base}/bins")


def arriving(spark, s: DataFrame) -> str:
    """A folder with sessions file by file, some of them a batch late."""
    base = shared_folder(spark)
    late = F.pmod(F.xxhash64("mac_address", "start_time"), F.lit(10)) == 0
    (s.withColumn("arrival", F.weekofyear("start_time") + F.when(late, 1).otherwise(0))
     .repartition("arrival").drop("arrival").write.parquet(f"{base}/in"))
    return base


def streamed(spark, s: DataFrame, tree: DataFrame) -> DataFrame:
    base = arriving(spark, s)
    start_occupancy_stream(
        read_session_stream(spark, f"{base}/in", 2), tree, f"{base}/sessions", f"{base}/bins", HOUR, f"{base}/checkpoint"
    ).awaitTermination()
    return _stored(spark, f"{base}/bins")


@query("k08_occupancy_series", f"SELECT * FROM ({bins_sql(HOUR)}) WHERE space_id = 112 ORDER BY interval_begin_time")
def _(spark, sf):
    return K.occupancy_series(B.occupancy_bins(T.sessions(spark, sf), HOUR), 112)


@query("k08_covering_datasets", "SELECT space_id AS dataset_id, space_id AS root_space_id FROM space WHERE space_id IN (1, 112, (SELECT parent_space_id FROM space WHERE space_id = 112))")
def _(spark, sf):
    tree = T.space(spark, sf)
    return K.covering_datasets(tree.select(F.col("space_id").alias("dataset_id"), F.col("space_id").alias("root_space_id")), tree, 112)


@query("k09_densify", f"""WITH b AS ({bins_sql(HOUR)}), g AS (SELECT space_id, unnest(generate_series(min(interval_begin_time), max(interval_begin_time), INTERVAL 3600 SECOND)) AS t FROM b GROUP BY space_id)
SELECT g.space_id, g.t AS interval_begin_time, coalesce(b.number_connections, 0) AS number_connections FROM g LEFT JOIN b ON g.space_id = b.space_id AND g.t = b.interval_begin_time""")
def _(spark, sf):
    return B.densify(B.occupancy_bins(T.sessions(spark, sf), HOUR), HOUR)


@query("k10_occupancy_intervals", "SELECT space_id, start_time, end_time, number_connections FROM occ")
def _(spark, sf):
    return T.space_occupancy(spark, sf)
