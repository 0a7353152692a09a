"""Queries by name over the driver's tables, and the same in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import codec
from palimpsest.operators import compaction, frames, metrics, runs, versions, workload
from palimpsest.plans import oplog
from palimpsest.sources import scratch
from palimpsest.streaming import changelog

LIMIT, BLOCK, CHUNK = 4096, 512, 4000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

OPLOG = """
WITH RECURSIVE oplog AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_key, event_id + 1 AS seq,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value
  FROM events),
sized AS (SELECT *, strlen(user_key) AS k, coalesce(strlen(value), 0) AS v FROM oplog),
newest AS (SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) = 1)
"""
VLEN = "(1 + CAST(({0}) >= 128 AS INT) + CAST(({0}) >= 16384 AS INT) + CAST(({0}) >= 2097152 AS INT) + CAST(({0}) >= 268435456 AS INT))"
ENTRY = f"({VLEN.format('k + 8')} + k + 8 + {VLEN.format('v')} + v)"
RUNS = OPLOG + f""",
ordered AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM sized),
cut AS (
  SELECT rn, k + 8 + v AS filled, CAST(1 AS BIGINT) AS file_id FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.rn, CASE WHEN c.filled >= {LIMIT} THEN o.k + 8 + o.v ELSE c.filled + o.k + 8 + o.v END,
         CASE WHEN c.filled >= {LIMIT} THEN c.file_id + 1 ELSE c.file_id END
  FROM cut c JOIN ordered o ON o.rn = c.rn + 1),
runs AS (SELECT o.*, c.file_id, 0 AS level FROM ordered o JOIN cut c USING (rn)),
files AS (
  SELECT file_id, min(level) AS level, count(*) AS entries, count(DISTINCT user_key) AS distinct_keys, CAST(sum({ENTRY}) AS BIGINT) AS data_bytes,
         min({{'a': user_key, 'b': -seq, 'c': -op}}) AS low, max({{'a': user_key, 'b': -seq, 'c': -op}}) AS high
  FROM runs GROUP BY file_id)
"""
ENTRIES = RUNS + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY user_key, seq DESC, op DESC) AS pos, {ENTRY} AS bytes FROM runs),
packed AS (
  SELECT file_id, pos, bytes AS filled, CAST(0 AS BIGINT) AS block_no FROM placed WHERE pos = 1
  UNION ALL
  SELECT p.file_id, p.pos, CASE WHEN q.filled + p.bytes > {BLOCK} THEN p.bytes ELSE q.filled + p.bytes END,
         CASE WHEN q.filled + p.bytes > {BLOCK} THEN q.block_no + 1 ELSE q.block_no END
  FROM packed q JOIN placed p ON p.file_id = q.file_id AND p.pos = q.pos + 1),
blocks AS (
  SELECT file_id, block_no, CAST(sum(bytes) AS BIGINT) AS size, count(*) AS entries, max({{'a': user_key, 'b': -seq, 'c': -op}}) AS last
  FROM placed JOIN packed USING (file_id, pos) GROUP BY file_id, block_no)
"""
# A small manifest by which the planners are asked: levels and sizes follow from the run's number.
LEVELS = RUNS + """,
leveled AS (SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 2 WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS level, low.a AS smallest_key, high.a AS largest_key, data_bytes FROM files)
"""

# Lookups ask for every key of the log, and for as many that it does not hold.
KEYS = "asked AS (SELECT user_key FROM newest UNION ALL SELECT user_key || 'x' FROM newest)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.form_runs(oplog.from_events(spark, sf_dir), LIMIT, CHUNK)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = oplog.from_events(spark, sf_dir).select("user_key").distinct()
    return held.select(F.explode(F.array(F.col("user_key"), F.concat("user_key", F.lit("x")))).alias("user_key"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = runs.manifest(_runs(spark, sf_dir))
    level = F.when(F.col("file_id") % 7 == 0, 2).when(F.col("file_id") % 3 == 0, 1).otherwise(0)
    return files.withColumn("level", level)


@query(OPLOG + "SELECT user_key, seq, op, value FROM newest")
def newest_versions(spark, sf_dir):
    return versions.newest(oplog.from_events(spark, sf_dir))


@query(OPLOG + "SELECT user_key, value, row_number() OVER (ORDER BY user_key) AS pos FROM newest WHERE op = 1")
def visible_scan(spark, sf_dir):
    # Positions come from per-partition counts, so that the ordered scan needs no single task. It is written once: two
    # runs of a range sort need not cut at the same keys.
    folder = scratch.folder(spark, "scan")
    versions.scan(oplog.from_events(spark, sf_dir)).withColumn("part_", F.spark_partition_id()).withColumn("nth_", F.monotonically_increasing_id() % (1 << 33)).write.parquet(folder)
    ordered = spark.read.parquet(folder)
    counts = ordered.groupBy("part_").agg(F.count("*").alias("n"))
    before = counts.select("part_", (F.sum("n").over(Window.orderBy("part_")) - F.col("n")).alias("before_"))
    return ordered.join(F.broadcast(before), "part_").select("user_key", "value", (F.col("before_") + F.col("nth_") + 1).alias("pos"))


@query(OPLOG + "SELECT user_key, seq, op, value FROM oplog WHERE seq <= (SELECT max(seq) // 2 FROM oplog) QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) = 1")
def as_of_scan(spark, sf_dir):
    log = oplog.from_events(spark, sf_dir)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    return versions.as_of(log, half)


@query(OPLOG + f", {KEYS} SELECT a.user_key, CASE WHEN n.op IS NULL THEN 'NOT_FOUND' WHEN n.op = 0 THEN 'DELETED' ELSE 'FOUND' END AS status, n.value FROM asked a LEFT JOIN newest n USING (user_key)")
def multi_get(spark, sf_dir):
    return versions.multi_get(_keys(spark, sf_dir), oplog.from_events(spark, sf_dir))


@query(OPLOG + "SELECT user_key, seq, op, row_number() OVER w AS age, lead(seq) OVER w AS older_seq, lag(seq) OVER w AS newer_seq, lead(value) OVER w AS older_value FROM oplog WINDOW w AS (PARTITION BY user_key ORDER BY seq DESC, op DESC)")
def version_chain(spark, sf_dir):
    return versions.version_chain(oplog.from_events(spark, sf_dir))


@query(OPLOG + "SELECT min(user_key) AS user_key, min(op) AS op, count(*) AS versions, CAST(0 AS BIGINT) AS duplicates FROM (SELECT DISTINCT user_key, seq, op FROM oplog) GROUP BY user_key")
def dedupe_log(spark, sf_dir):
    log = oplog.from_events(spark, sf_dir)
    clean = oplog.dedupe(log.unionByName(log))
    twice = clean.groupBy("user_key", "seq", "op").agg(F.count("*").alias("n"))
    return twice.groupBy("user_key").agg(F.min("op").alias("op"), F.count("*").alias("versions"), F.sum(F.col("n") - 1).alias("duplicates"))


@query(OPLOG + "SELECT CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS bad_seqs, CAST(0 AS BIGINT) AS bad_ops, CAST(count(*) FILTER (op = 0 AND value IS NOT NULL OR op = 1 AND value IS NULL) AS BIGINT) AS bad_values, CAST(count(*) - count(DISTINCT (user_key, seq, op)) AS BIGINT) AS duplicates FROM oplog")
def log_audit(spark, sf_dir):
    return oplog.audit(oplog.from_events(spark, sf_dir))


@query(OPLOG + f"SELECT count(*) AS operations, count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 0) AS deletes, max(seq) AS last_seq, CAST(sum(k + v) AS BIGINT) AS user_bytes, CAST(sum(k + v + 8) AS BIGINT) AS memtable_bytes, CAST(sum(17 + {VLEN.format('k')} + k + {VLEN.format('v')} + v) AS BIGINT) AS wal_bytes, CAST(sum({ENTRY}) AS BIGINT) AS entry_bytes FROM sized")
def log_stats(spark, sf_dir):
    k, v = F.col("user_key"), F.col("value")
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return oplog.from_events(spark, sf_dir).agg(
        F.count("*").alias("operations"), F.count_if(F.expr("op = 1")).alias("puts"), F.count_if(F.expr("op = 0")).alias("deletes"), F.max("seq").alias("last_seq"),
        total(codec.user_bytes(k, v), "user_bytes"), total(codec.memtable_bytes(k, v), "memtable_bytes"), total(codec.wal_bytes(k, v), "wal_bytes"), total(codec.entry_bytes(k, v), "entry_bytes"),
    )


@query(RUNS + "SELECT file_id, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(k + v + 8) AS BIGINT) AS bytes FROM runs GROUP BY file_id")
def flush_runs(spark, sf_dir):
    size = codec.memtable_bytes(F.col("user_key"), F.col("value"))
    return _runs(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(size).cast("long").alias("bytes"))


@query(RUNS + "SELECT file_id, level, entries, distinct_keys, data_bytes, low.a AS smallest_key, -low.b AS smallest_seq, -low.c AS smallest_op, high.a AS largest_key, -high.b AS largest_seq, -high.c AS largest_op FROM files")
def run_manifest(spark, sf_dir):
    return runs.manifest(_runs(spark, sf_dir))


# The audits are asked about damaged copies, so that there is something to find.
DAMAGED = ", damaged AS (SELECT CASE WHEN file_id % 5 = 0 THEN file_id - 1 ELSE file_id END AS file_id, CASE WHEN file_id % 3 = 0 THEN 0 ELSE data_bytes END AS data_bytes, CASE WHEN file_id % 4 = 0 THEN high ELSE low END AS low, CASE WHEN file_id % 4 = 0 THEN low ELSE high END AS high FROM files)"


@query(RUNS + DAMAGED + "SELECT count(*) FILTER (file_id < 1 OR file_id >= 40) AS bad_ids, count(*) FILTER (data_bytes <= 0) AS bad_sizes, count(*) FILTER (low.a > high.a OR low.a = high.a AND -low.b < -high.b) AS bad_bounds, count(*) FILTER (greatest(-low.b, -high.b) > 5000) AS bad_seqs, (SELECT count(*) FROM (SELECT file_id FROM damaged GROUP BY file_id HAVING count(*) > 1)) AS repeated_ids FROM damaged")
def manifest_audit(spark, sf_dir):
    files, of = runs.manifest(_runs(spark, sf_dir)), F.col("file_id")
    swap = lambda a, b: F.when(of % 4 == 0, F.col(b)).otherwise(F.col(a))
    bounds = {f"{x}_{c}": swap(f"{x}_{c}", f"{y}_{c}") for c in ("key", "seq", "op") for x, y in (("smallest", "largest"), ("largest", "smallest"))}
    damaged = files.withColumns(bounds | {"data_bytes": F.when(of % 3 == 0, 0).otherwise(F.col("data_bytes"))}).withColumn("file_id", F.when(of % 5 == 0, of - 1).otherwise(of))
    return runs.manifest_violations(damaged, 40, 5000)


@query(RUNS + ", placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY user_key, CASE WHEN seq % 9 = 0 THEN seq ELSE -seq END, op DESC) AS pos FROM runs) SELECT count(*) AS violations FROM (SELECT user_key AS k, -seq AS s, -op AS o, lag(user_key) OVER w AS bk, lag(-seq) OVER w AS bs, lag(-op) OVER w AS bo FROM placed WINDOW w AS (PARTITION BY file_id ORDER BY pos)) WHERE bk > k OR bk = k AND (bs > s OR bs = s AND bo >= o)")
def run_order_audit(spark, sf_dir):
    seq = F.col("seq")
    order = Window.partitionBy("file_id").orderBy("user_key", F.when(seq % 9 == 0, seq).otherwise(-seq), F.desc("op"))
    return versions.order_violations(_runs(spark, sf_dir).withColumn("pos", F.row_number().over(order).cast("long")))


@query(ENTRIES + "SELECT file_id, block_no, CAST(sum(size) OVER (PARTITION BY file_id ORDER BY block_no) - size AS BIGINT) AS \"offset\", size, entries, last.a AS last_key, -last.b AS last_seq, -last.c AS last_op FROM blocks")
def block_index(spark, sf_dir):
    return runs.block_index(_runs(spark, sf_dir), BLOCK)


@query(ENTRIES + f", {KEYS} SELECT a.user_key, b.file_id, min(b.block_no) AS block_no FROM asked a JOIN blocks b ON b.last.a >= a.user_key GROUP BY a.user_key, b.file_id")
def block_of_key(spark, sf_dir):
    return runs.block_of_key(_keys(spark, sf_dir), runs.block_index(_runs(spark, sf_dir), BLOCK))


@query(ENTRIES + f", per AS (SELECT file_id, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS data_bytes, CAST(sum({VLEN.format('strlen(last.a) + 8')} + strlen(last.a) + 24) AS BIGINT) AS index_bytes FROM blocks GROUP BY file_id) SELECT file_id, blocks, p.data_bytes, index_bytes, CAST(ceil(greatest(64, distinct_keys * 10) / 8.0) AS BIGINT) + 12 AS filter_bytes, p.data_bytes + index_bytes + CAST(ceil(greatest(64, distinct_keys * 10) / 8.0) AS BIGINT) + 52 AS file_bytes FROM per p JOIN files USING (file_id)")
def file_sizes(spark, sf_dir):
    return runs.file_sizes(_runs(spark, sf_dir), BLOCK, 10)


@query(RUNS + "SELECT file_id, 1 AS output_level FROM files WHERE level = 0 AND (SELECT count(*) FROM files WHERE level = 0) >= 4")
def tiered_plan(spark, sf_dir):
    return compaction.tiered_plan(runs.manifest(_runs(spark, sf_dir)), 4)


@query(RUNS + "SELECT user_key, seq, op, value, 1 AS level FROM newest")
def tiered_compact(spark, sf_dir):
    held = _runs(spark, sf_dir)
    return compaction.merge_runs(held, compaction.tiered_plan(runs.manifest(held), 4))


L0 = ", hull AS (SELECT min(smallest_key) AS lo, max(largest_key) AS hi, count(*) AS n FROM leveled WHERE level = 0), plan AS (SELECT file_id FROM leveled, hull WHERE n >= 4 AND (level = 0 OR level = 1 AND smallest_key <= hi AND largest_key >= lo))"


@query(LEVELS + L0 + " SELECT file_id, 1 AS output_level FROM plan")
def leveled_l0_plan(spark, sf_dir):
    return compaction.leveled_l0_plan(_levels(spark, sf_dir), 4)


@query(LEVELS + L0 + ", merged AS (SELECT user_key, seq, op, value FROM runs JOIN plan USING (file_id) QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) = 1) SELECT CAST(1000000 AS BIGINT) AS file_id, 1 AS level, count(*) AS entries, min(user_key) AS low, max(user_key) AS high FROM merged UNION ALL SELECT l.file_id, l.level, count(*), min(user_key), max(user_key) FROM runs r JOIN leveled l USING (file_id) WHERE l.file_id NOT IN (SELECT file_id FROM plan) GROUP BY ALL")
def leveled_l0_compact(spark, sf_dir):
    files = _levels(spark, sf_dir)
    held = _runs(spark, sf_dir).drop("level").join(F.broadcast(files.select("file_id", "level")), "file_id")
    after = compaction.after(held, compaction.leveled_l0_plan(files, 4), 1_000_000)
    return after.groupBy("file_id", "level").agg(F.count("*").alias("entries"), F.min("user_key").alias("low"), F.max("user_key").alias("high"))


@query(LEVELS + ", low_ AS (SELECT * FROM leveled WHERE level > 0), big AS (SELECT min(level) AS deep FROM (SELECT level, sum(data_bytes) AS b FROM low_ GROUP BY level) WHERE b > 5000.0 * power(10, level - 1)), first_ AS (SELECT l.* FROM low_ l, big WHERE level = deep ORDER BY file_id LIMIT 1) SELECT l.file_id, CAST(deep + 1 AS INT) AS output_level FROM low_ l, big, first_ f WHERE l.file_id = f.file_id OR (l.level = deep + 1 AND l.smallest_key <= f.largest_key AND l.largest_key >= f.smallest_key)")
def leveled_overflow_plan(spark, sf_dir):
    return compaction.leveled_overflow_plan(_levels(spark, sf_dir).where("level > 0"), 4, 5000)


@query(RUNS + f", {KEYS} SELECT a.user_key, count(f.file_id) AS candidates, (SELECT count(*) FROM files) AS runs FROM asked a LEFT JOIN files f ON a.user_key >= f.low.a AND a.user_key <= f.high.a GROUP BY a.user_key")
def range_pruning(spark, sf_dir):
    return runs.range_pruning(_keys(spark, sf_dir), runs.manifest(_runs(spark, sf_dir)))


@query(RUNS + f", {KEYS}, hit AS (SELECT user_key, file_id, op FROM runs QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY file_id DESC, seq DESC, op DESC) = 1) SELECT a.user_key, h.file_id, CASE WHEN h.op IS NULL THEN NULL ELSE 0 END AS level, CASE WHEN h.op IS NULL THEN 'NOT_FOUND' WHEN h.op = 0 THEN 'DELETED' ELSE 'FOUND' END AS status FROM asked a LEFT JOIN hit h USING (user_key)")
def first_source(spark, sf_dir):
    return versions.first_source(_keys(spark, sf_dir), _runs(spark, sf_dir))


@query(RUNS + f", {KEYS} SELECT a.user_key, f.file_id, EXISTS (SELECT 1 FROM runs r WHERE r.user_key = a.user_key AND r.file_id = f.file_id) AS present, true AS sound FROM asked a, files f")
def bloom_prune(spark, sf_dir):
    # which absent keys a filter lets pass is its own affair; none that a run holds may be stopped
    out = runs.bloom_prune(_keys(spark, sf_dir), _runs(spark, sf_dir))
    return out.select("user_key", "file_id", "present", (F.col("maybe") | ~F.col("present")).alias("sound"))


@query("SELECT event_type, count(value) AS samples, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return metrics.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value")


@query("SELECT event_type, median(value) AS median_value, median(user_id) AS median_user_id FROM events GROUP BY event_type")
def medians_by_setting(spark, sf_dir):
    return metrics.medians(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], ["value", "user_id"])


@query(ENTRIES + f", f AS (SELECT CAST(sum(size) AS BIGINT) AS tables FROM blocks), u AS (SELECT CAST(sum(k + v) AS BIGINT) AS user_bytes, CAST(sum(17 + {VLEN.format('k')} + k + {VLEN.format('v')} + v) AS BIGINT) AS wal_bytes FROM sized), l AS (SELECT CAST(sum(strlen(user_key) + strlen(value)) AS BIGINT) AS live_bytes FROM newest WHERE op = 1) SELECT user_bytes, wal_bytes, tables AS table_bytes, live_bytes, CAST(wal_bytes AS DOUBLE) / user_bytes + CAST(tables AS DOUBLE) / user_bytes AS write_amplification, CAST(tables AS DOUBLE) / live_bytes AS space_amplification FROM f, u, l")
def amplification(spark, sf_dir):
    log = oplog.from_events(spark, sf_dir)
    k, v = F.col("user_key"), F.col("value")
    user = log.agg(F.sum(codec.user_bytes(k, v)).alias("user_bytes"), F.sum(codec.wal_bytes(k, v)).alias("wal_bytes"), F.sum(codec.entry_bytes(k, v)).alias("table_bytes"))
    live = versions.visible(log).agg(F.sum(codec.user_bytes(k, v)).alias("live_bytes"))
    write = metrics.write_amplification(F.col("wal_bytes"), F.col("table_bytes"), F.col("user_bytes"))
    return user.join(F.broadcast(live)).select("user_bytes", "wal_bytes", "table_bytes", "live_bytes", write.alias("write_amplification"), metrics.space_amplification(F.col("table_bytes"), F.col("live_bytes")).alias("space_amplification"))


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS hits, count(*) FILTER (user_id % 3 <> 0) AS misses, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (user_id % 3 = 0) AS DOUBLE) / count(*) END AS hit_rate, count(*) * 1e9 / (count(*) * 1000) AS throughput FROM events GROUP BY event_type")
def rates(spark, sf_dir):
    by = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count_if(F.expr("user_id % 3 = 0")).alias("hits"), F.count_if(F.expr("user_id % 3 <> 0")).alias("misses"))
    n = F.col("hits") + F.col("misses")
    return by.select("event_type", "hits", "misses", metrics.hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"), metrics.throughput(n, n * 1000).alias("throughput"))


UNIFORM = "(('0x' || substr(md5('42:{0}:' || CAST(i AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0)"
OPERATION = f"""
WITH base AS (SELECT i, {UNIFORM.format('op')} * 100 AS u, {UNIFORM.format('key')} AS ku, {UNIFORM.format('size')} AS su FROM range(100000) t(i)),
kinds AS (SELECT *, CASE WHEN u < 80 THEN 'read' WHEN u < 95 THEN 'write' ELSE 'delete' END AS type FROM base)
"""
PUTS = "SELECT i AS op_index, type, 'key' || lpad(CAST({0} AS VARCHAR), 20, '0') AS key, CASE WHEN type = 'write' THEN repeat(chr(CAST(97 + i % 26 AS INT)), CAST(4 + floor(su * 9) AS INT)) ELSE '' END AS value FROM {1}"
WEIGHTS = "SELECT i AS rank, 1.0 / power(CAST(i + 1 AS DOUBLE), 0.99) AS w FROM range(1000) t(i)"


def _workload(spark: SparkSession, distribution: str) -> DataFrame:
    return workload.operations(spark, workload.Workload(100_000, 1000, distribution=distribution))


@query(OPERATION + PUTS.format("CAST(floor(ku * 1000) AS BIGINT)", "kinds"))
def workload_uniform(spark, sf_dir):
    return _workload(spark, "uniform")


@query(OPERATION + PUTS.format("i % 1000", "kinds"))
def workload_sequential(spark, sf_dir):
    return _workload(spark, "sequential")


@query(OPERATION + f", w AS ({WEIGHTS}), cdf AS (SELECT rank, CASE WHEN rank = 999 THEN 1.0 ELSE sum(w) OVER (ORDER BY rank) / sum(w) OVER () END AS high FROM w), ranged AS (SELECT rank, high, lag(high, 1, -1.0) OVER (ORDER BY rank) AS low FROM cdf) " + PUTS.format("rank", "kinds JOIN ranged ON ku > low AND ku <= high"))
def workload_zipf(spark, sf_dir):
    return _workload(spark, "zipfian")


@query(f"WITH w AS ({WEIGHTS}) SELECT rank, round(CASE WHEN rank = 999 THEN 1.0 ELSE sum(w) OVER (ORDER BY rank) / sum(w) OVER () END, 9) AS high FROM w")
def zipf_cdf(spark, sf_dir):
    return workload.zipf_cdf(spark, 1000, 0.99).select("rank", F.round("high", 9).alias("high"))


@query(OPERATION + "SELECT type, count(*) AS operations, CAST(sum(CASE WHEN type = 'write' THEN 4 + floor(su * 9) ELSE 0 END) AS BIGINT) AS value_bytes FROM kinds GROUP BY type")
def op_mix(spark, sf_dir):
    return _workload(spark, "uniform").groupBy("type").agg(F.count("*").alias("operations"), F.sum(F.length("value")).alias("value_bytes"))


@query()
def crc32_frames(spark, sf_dir):
    return frames.encode(oplog.from_events(spark, sf_dir)).select("seq", "payload", "crc", "frame")


@query()
def frame_decode(spark, sf_dir):
    return frames.decode(_damaged_frames(spark, sf_dir).select("id", "frame"))


def _damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by number, of which some have a flipped bit, are cut short, or carry a byte too many."""
    rows = frames.encode(oplog.from_events(spark, sf_dir)).select(F.col("seq").alias("id"), "frame")
    late, h = F.col("id") % 1000 >= 700, F.col("frame")
    flipped = F.concat(h.substr(F.lit(1), F.length(h) - 1), F.when(F.substring(h, -1, 1) == "0", "1").otherwise("0"))
    return rows.withColumn("frame", F.when(late & (F.col("id") % 33 == 3), flipped).when(late & (F.col("id") % 33 == 14), h.substr(F.lit(1), F.length(h) - 2)).when(late & (F.col("id") % 33 == 25), F.concat(h, F.lit("00"))).otherwise(h))


SEQ_BYTES = " || ".join(f"substr(printf('%014X', seq), {13 - 2 * i}, 2)" for i in range(7))


@query(OPLOG + f"SELECT user_key, seq, op, hex(user_key) || printf('%02X', op) || {SEQ_BYTES} AS internal_key FROM oplog")
def internal_key_hex(spark, sf_dir):
    return oplog.from_events(spark, sf_dir).select("user_key", "seq", "op", codec.internal_key_hex(F.col("user_key"), F.col("seq"), F.col("op")).alias("internal_key"))


VARINT = " || ".join(f"CASE WHEN n >= {1 << 7 * i} OR {i} = 0 THEN printf('%02X', ((n >> {7 * i}) & 127) + CASE WHEN n >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END) ELSE '' END" for i in range(5))


@query(f"WITH t AS (SELECT event_id AS id, (event_id * 2654435761) % 4294967296 >> (event_id % 32) AS n FROM events) SELECT id, n, {VLEN.format('n')} AS size, {VARINT} AS encoded, n AS decoded FROM t")
def varint_codec(spark, sf_dir):
    n = F.expr("shiftright((event_id * 2654435761L) % 4294967296L, cast(event_id % 32 as int))")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), n.alias("n"))
    coded = rows.select("id", "n", codec.varint_length(F.col("n")).cast("int").alias("size"), codec.varint_hex(F.col("n")).alias("encoded"))
    return coded.withColumn("decoded", codec.varint_from_hex(F.col("encoded")))


@query("SELECT id, 'key_' || lpad(CAST(id AS VARCHAR), 20, '0') AS key, md5(rpad('value_' || CAST(id AS VARCHAR) || '_', 512, chr(CAST(97 + id % 26 AS INT)))) AS value_md5, CAST(id AS VARCHAR) AS parsed, CAST(NULL AS VARCHAR) AS cut FROM (SELECT event_id + 1 AS id FROM events)")
def operation_keys(spark, sf_dir):
    n = F.col("id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("id")).select("id", codec.operation_key(n).alias("key"), F.md5(codec.operation_value(n).cast("binary")).alias("value_md5"))
    return rows.withColumns({"parsed": codec.operation_of_key(F.col("key")).cast("string"), "cut": codec.operation_of_key(F.substr("key", F.lit(2))).cast("string")})


NUMERALS = "CASE event_id % 6 WHEN 0 THEN {0} WHEN 1 THEN concat('000', {0}) WHEN 2 THEN concat({0}, ' ') WHEN 3 THEN concat('+', {0}) WHEN 4 THEN concat('184467440737095516', {0}) ELSE '' END AS written"


@query(f"WITH t AS (SELECT event_id AS id, {NUMERALS.format('CAST(event_id AS VARCHAR)')} FROM events) SELECT id, written, CASE WHEN regexp_full_match(written, '[0-9]+') AND TRY_CAST(written AS HUGEINT) <= 18446744073709551615::HUGEINT THEN CAST(CAST(written AS HUGEINT) AS VARCHAR) END AS parsed FROM t")
def strict_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", NUMERALS.format("CAST(event_id AS STRING)"))
    return rows.withColumn("parsed", codec.strict_unsigned(F.col("written")).cast("string"))


M_BYTES = " || ".join(f"substr(printf('%016X', m), {15 - 2 * i}, 2)" for i in range(8))


@query(RUNS + f", sized_ AS (SELECT file_id, CAST(ceil(greatest(64, distinct_keys * 10) / 8.0) AS BIGINT) * 8 AS m FROM files) SELECT file_id, '07000000' || {M_BYTES} AS header, m // 8 + 12 AS n_bytes, true AS same, false AS cut_is_read, false AS longer_is_read FROM sized_")
def bloom_codec(spark, sf_dir):
    filters = runs.bloom_filters(_runs(spark, sf_dir), 10, 7).withColumn("h", codec.bloom_hex(F.lit(7), F.col("m"), F.col("bits")))
    read, h = codec.bloom_from_hex(F.col("h")), F.col("h")
    return filters.select(
        "file_id", F.substring("h", 1, 24).alias("header"), F.expr("length(h) div 2").alias("n_bytes"),
        ((read["hashes"] == 7) & (read["m"] == F.col("m")) & (read["bits"] == F.col("bits"))).alias("same"),
        codec.bloom_from_hex(h.substr(F.lit(1), F.length(h) - 2)).isNotNull().alias("cut_is_read"), codec.bloom_from_hex(F.concat(h, F.lit("00"))).isNotNull().alias("longer_is_read"),
    )


@query("SELECT i AS bits_per_key, CAST(CASE WHEN i >= 44 THEN 30 ELSE least(greatest(round(i * ln(2.0)), 1), 30) END AS INT) AS hashes FROM range(1, 61) t(i)")
def best_hash_counts(spark, sf_dir):
    return spark.range(1, 61).select(F.col("id").alias("bits_per_key"), codec.best_hash_count(F.col("id")).alias("hashes"))


@query("SELECT i AS level, CAST(least(CAST('5000' || repeat('0', CAST(i - 1 AS INT)) AS HUGEINT), CAST(18446744073709551615 AS HUGEINT)) AS VARCHAR) AS capacity FROM range(1, 23) t(i)")
def level_capacities(spark, sf_dir):
    return spark.createDataFrame([(level, str(compaction.level_capacity(5000, level))) for level in range(1, 23)], "level long, capacity string")


FRAMES = OPLOG + ", frames AS (SELECT seq // 1000 AS epoch, seq % 1000 AS pos, seq, user_key, NOT (seq % 1000 >= 700 AND hash_ = 3) AS good FROM (SELECT *, seq % 11 AS hash_ FROM oplog))"


@query(FRAMES + ", bad AS (SELECT epoch, min(pos) AS bad_pos FROM frames WHERE NOT good AND epoch > 1 GROUP BY epoch) SELECT f.epoch, f.pos, f.seq, f.user_key FROM frames f LEFT JOIN bad b USING (epoch) WHERE f.epoch > 1 AND (bad_pos IS NULL OR f.pos < bad_pos)")
def recovery_prefix(spark, sf_dir):
    read = frames.decode(_damaged_frames(spark, sf_dir)).withColumns({"epoch": F.floor(F.col("id") / 1000), "pos": F.col("id") % 1000})
    return compaction.recovered(read, 1).select("epoch", "pos", "seq", "user_key")


@query(RUNS + ", listing AS (SELECT CAST(i AS VARCHAR) || '.sst' AS name, 'sst' AS kind, i AS id FROM range(1, 2000) t(i) UNION ALL SELECT CAST(i AS VARCHAR) || '.wal', 'wal', i FROM range(1, 21) t(i)) SELECT name, kind, id FROM listing WHERE kind = 'sst' AND id NOT IN (SELECT file_id FROM files) OR kind = 'wal' AND id <= 7")
def orphan_files(spark, sf_dir):
    names = lambda n, kind: spark.range(1, n).select(F.concat(F.col("id").cast("string"), F.lit(f".{kind}")).alias("name"), F.lit(kind).alias("kind"), "id")
    return compaction.orphans(names(2000, "sst").unionByName(names(21, "wal")), _runs(spark, sf_dir).select("file_id").distinct(), 7)


@query(OPLOG + ", held AS (SELECT * FROM oplog WHERE seq > 100 QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) = 1) SELECT count(*) FILTER (h.user_key IS NULL) AS missing, count(*) FILTER (n.user_key IS NULL) AS extra, count(*) FILTER (h.user_key = n.user_key AND h.value IS DISTINCT FROM n.value) AS different, count(*) FILTER (h.user_key = n.user_key AND h.value IS NOT DISTINCT FROM n.value) AS equal FROM newest n FULL JOIN held h USING (user_key)")
def oracle_verify(spark, sf_dir):
    log = oplog.from_events(spark, sf_dir)
    return versions.verify(versions.newest(log), versions.newest(log.where("seq > 100")))


@query(OPLOG + "SELECT user_key, seq, op, value FROM newest")
def stream_newest(spark, sf_dir):
    return changelog.newest_by_stream(spark, sf_dir)


@query("SELECT i AS bits_per_key, 67108864 - 16777216 - CAST(ceil(greatest(64, 500000 * i) / 8.0) AS BIGINT) AS cache_bytes FROM range(2, 15, 4) t(i)")
def budget_split(spark, sf_dir):
    return spark.range(2, 15, 4).select(F.col("id").alias("bits_per_key"), (F.lit(67108864 - 16777216) - codec.bloom_bytes(F.lit(500_000), 1 * F.col("id"))).alias("cache_bytes"))
