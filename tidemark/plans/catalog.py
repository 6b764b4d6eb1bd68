"""Registered queries over the driver's tables, each with equivalent SQL.

The changelog is `events`: key user_id, sequence event_id, a delete where event_type is 'error';
runs are stretches of 2,500 sequences. `orders` is a second changelog, `customer` a key-value table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, estimates
from tidemark.operators import bloom, cache, changelog, commands, compaction, manifest, merge, snapshot, stats, tables
from tidemark.sources import frames, manifest_log, sstable, wal
from tidemark.store import Store, WriteBatch

RUN = 2500


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = Query(f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark, d) -> DataFrame:
    return changelog.changelog(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", "event_type", "value")


def orders_log(spark, d) -> DataFrame:
    return changelog.changelog(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", "o_totalprice", "o_orderpriority")


def customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), "c_custkey", "c_acctbal", "c_mktsegment")


def runs(spark, d) -> DataFrame:
    return events_log(spark, d).withColumn("file_number", F.floor(F.col("seq") / RUN).cast("long"))


def files(spark, d) -> DataFrame:
    """Level 0: the runs. Level 1: ranges of 40 users with what the last run left of them."""
    made = runs(spark, d)
    size = F.lit(25) + F.length("event_type")
    of = lambda rows, level: rows.groupBy("file_number").agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("file_size"), F.min("key").alias("smallest"), F.max("key").alias("largest")).withColumn("level", F.lit(level))
    lower = made.withColumn("file_number", (1000 + F.floor(F.col("key") / 40)).cast("long"))
    return of(made, 0).unionByName(of(lower, 1))


def edits(spark, d) -> DataFrame:
    """Additions and removals of files, one an event."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type").isin("purchase", "error"), manifest.REMOVE).otherwise(manifest.ADD)
    return e.select(F.col("event_id").alias("edit_id"), action.alias("action"), (F.col("user_id") % 3).cast("int").alias("level"), (F.col("user_id") % 40).alias("file_number"), F.col("event_id").alias("last_sequence"))


KINDS = {"signup": "START", "purchase": "COMMIT", "error": "CANCEL", "view": "PUT", "click": "DELETE"}


def session_commands(spark, d) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.element_at(kind, F.col("event_type")).alias("kind"), "ts", "value")


CL = "cl AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, event_type, value FROM events)"
CO = "co AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS op, o_totalprice, o_orderpriority FROM orders)"
SNAP = f"{CL}, newest AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), snap AS (SELECT key, seq, event_type, value FROM newest WHERE op = 1)"
KV = "kv AS (SELECT c_name AS key, c_custkey, c_acctbal, c_mktsegment FROM customer)"
RUNS = f"{CL}, runs AS (SELECT *, seq // {RUN} AS file_number FROM cl)"
FILES = f"""{RUNS}, files AS (
  SELECT 0 AS level, file_number, count(*) AS entries, CAST(sum(25 + length(event_type)) AS BIGINT) AS file_size, min(key) AS smallest, max(key) AS largest FROM runs GROUP BY file_number
  UNION ALL SELECT 1, 1000 + key // 40, count(*), CAST(sum(25 + length(event_type)) AS BIGINT), min(key), max(key) FROM cl GROUP BY 1000 + key // 40)"""
EDITS = "edits AS (SELECT event_id AS edit_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'DEL' ELSE 'ADD' END AS action, CAST(user_id % 3 AS INTEGER) AS level, user_id % 40 AS file_number FROM events)"
LIMIT = "CASE WHEN level = 0 THEN 16384 ELSE CAST(4096 * pow(10.0, level - 1) AS BIGINT) END"
FULL = f"{FILES}, full_levels AS (SELECT level FROM (SELECT level, count(*) AS n, sum(file_size) AS b FROM files GROUP BY level) WHERE CASE WHEN level = 0 THEN n >= 4 ELSE b >= {LIMIT} END)"
CMD = "cmd AS (SELECT user_id AS session, event_id AS ord, CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'COMMIT' WHEN 'error' THEN 'CANCEL' WHEN 'view' THEN 'PUT' ELSE 'DELETE' END AS kind, ts, value FROM events)"
MARKED = f"{CMD}, before AS (SELECT *, last_value(CASE WHEN kind IN ('START', 'COMMIT', 'CANCEL') THEN kind END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM cmd), marked AS (SELECT *, sum(CASE WHEN kind = 'START' AND prev IS DISTINCT FROM 'START' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ord) AS batch_no FROM before)"
BASE = 4096  # bytes of a level, small enough for the test tables

# reads


@query(f"WITH {SNAP} SELECT * FROM snap")
def snapshot_latest(spark, d):
    return snapshot.snapshot(events_log(spark, d))


@query(f"WITH {CO} SELECT key, seq, o_totalprice, o_orderpriority FROM (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def snapshot_orders(spark, d):
    return snapshot.snapshot(orders_log(spark, d))


@query(f"WITH {SNAP} SELECT * FROM snap WHERE key = 10")
def point_get(spark, d):
    return snapshot.get(events_log(spark, d), 10)


@query(f"WITH {SNAP} SELECT r.key, s.seq, s.event_type, s.value, s.key IS NOT NULL AS found FROM (SELECT range * 3 AS key FROM range(100)) r LEFT JOIN snap s ON s.key = r.key")
def multi_get_with_misses(spark, d):
    return snapshot.multi_get(events_log(spark, d), spark.range(0, 300, 3).withColumnRenamed("id", "key"))


@query(f"WITH {CL} SELECT c.* FROM cl c JOIN (SELECT o_custkey AS key, o_orderkey AS seq FROM orders UNION SELECT key, seq FROM cl WHERE op = 0) r ON r.key = c.key AND r.seq = c.seq")
def get_exact_version(spark, d):
    """Requests: the customer and number of every order, most of which are no version, and every delete."""
    log = events_log(spark, d)
    return snapshot.get_exact(log, orders_log(spark, d).select("key", "seq").union(log.where("op = 0").select("key", "seq")))


@query(f"WITH {CL} SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS place FROM cl")
def version_history(spark, d):
    return snapshot.versions(events_log(spark, d))


@query(f"WITH {CL} SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS place FROM cl WHERE op = 1")
def memory_scan(spark, d):
    return snapshot.versions(events_log(spark, d), live_only=True)


@query(f"WITH {CL} SELECT key, seq, concat_ws('|', key, seq, op, event_type) AS line FROM cl")
def version_dump(spark, d):
    return snapshot.dump(events_log(spark, d), ["key", "seq", "op", "event_type"])


@query(f"WITH {CL} SELECT key, seq, event_type, value FROM (SELECT * FROM cl WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def snapshot_as_of_seq(spark, d):
    return snapshot.snapshot(events_log(spark, d), as_of=5000)


@query(f"WITH {KV} SELECT * FROM kv WHERE key >= 'Customer#000000100' ORDER BY key LIMIT 10")
def seek_lower_bound(spark, d):
    return snapshot.seek(customers(spark, d), "Customer#000000100", 10)


@query(f"WITH {KV} SELECT * FROM kv WHERE key >= 'Customer#000000020' AND key < 'Customer#000000090'")
def range_scan(spark, d):
    return snapshot.between(customers(spark, d), "Customer#000000020", "Customer#000000090")


@query(f"WITH {KV} SELECT * FROM kv ORDER BY key LIMIT 5")
def scan_first_k(spark, d):
    return snapshot.first(customers(spark, d), 5)


@query(f"WITH {KV} SELECT *, row_number() OVER (ORDER BY key) AS rank FROM kv")
def scan_with_rank(spark, d):
    return snapshot.ranked(customers(spark, d))


@query(f"WITH {SNAP} SELECT *, row_number() OVER (ORDER BY key) AS rank FROM snap")
def snapshot_with_rank(spark, d):
    return snapshot.ranked(snapshot.snapshot(events_log(spark, d)))


@query(f"WITH {SNAP} SELECT key, seq FROM newest WHERE op = 0")
def tombstones(spark, d):
    return snapshot.tombstones(events_log(spark, d))


@query(f"WITH {SNAP} SELECT CAST(count(*) FILTER (op = 1) AS BIGINT) AS live, CAST(count(*) FILTER (op = 0) AS BIGINT) AS deleted FROM newest")
def live_vs_deleted_counts(spark, d):
    return snapshot.newest(events_log(spark, d)).agg(F.count_if(F.col("op") == 1).alias("live"), F.count_if(F.col("op") == 0).alias("deleted"))


# merges and compaction


@query(f"WITH {RUNS} SELECT key, seq, op, event_type, value, file_number FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, file_number DESC) = 1) WHERE op = 1")
def merge_runs_newest_wins(spark, d):
    made = runs(spark, d)
    parts = [made.where(F.col("file_number") % 4 == k) for k in range(4)]
    return merge.merge(merge.union(*parts), drop_deletes=True)


@query(f"WITH {RUNS} SELECT file_number, count(*) AS keys FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) GROUP BY file_number")
def merge_run_winner_file(spark, d):
    return merge.merge(runs(spark, d)).groupBy("file_number").agg(F.count("*").alias("keys"))


@query(f"WITH {RUNS} SELECT count(DISTINCT file_number) AS runs FROM runs WHERE key >= 10")
def merge_runs_left(spark, d):
    return merge.runs_left(runs(spark, d), 10)


@query("SELECT o_custkey, unnest(list_slice(k, 1, least(len(k), len(v)))) AS key, unnest(list_slice(v, 1, least(len(k), len(v)))) AS value FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list_slice(list(o_totalprice ORDER BY o_orderkey), 1, 3) AS v FROM orders GROUP BY o_custkey)")
def zip_keys_values(spark, d):
    both = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(both.alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("k"), F.slice("x.o_totalprice", 1, 3).alias("v"))
    return merge.zipped(lists, "k", "v")


@query(f"WITH {RUNS} SELECT key, seq, op, event_type, value, file_number FROM runs QUALIFY row_number() OVER (PARTITION BY file_number, key ORDER BY seq DESC) = 1")
def flush_run(spark, d):
    """Every stretch of the log as the run that it is flushed to."""
    return snapshot.newest(runs(spark, d), ["file_number", "key"])


@query(f"WITH {RUNS} SELECT key, seq, op, event_type, value, file_number FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def compact_drop_tombstones(spark, d):
    return compaction.rewrite(runs(spark, d), level=6, last_level=6)


@query(f"WITH {RUNS} SELECT key, seq, op, event_type, value, file_number FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def compact_keep_tombstones(spark, d):
    return compaction.rewrite(runs(spark, d), level=1, last_level=6)


@query(f"WITH {RUNS} SELECT key, seq, op, event_type, value, file_number FROM runs WHERE key >= 20 AND key < 60 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def compact_range(spark, d):
    return compaction.rewrite(snapshot.between(runs(spark, d), 20, 60), level=1, last_level=6)


@query(f"WITH {SNAP}, sized AS (SELECT *, coalesce(sum(25 + length(event_type)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM snap) SELECT CAST(b // 1024 AS INTEGER) AS output, count(*) AS entries, min(key) AS smallest, max(key) AS largest FROM sized GROUP BY 1")
def compact_output_files(spark, d):
    rows = compaction.output_files(snapshot.snapshot(events_log(spark, d)), F.lit(25) + F.length("event_type"), 1024)
    return rows.groupBy("output").agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"))


@query(f"WITH {FILES} SELECT * FROM files")
def file_meta(spark, d):
    return files(spark, d).select("level", "file_number", "entries", "file_size", "smallest", "largest")


@query(f"WITH {FILES} SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, min(smallest) AS smallest, max(largest) AS largest FROM files GROUP BY level")
def level_stats(spark, d):
    return compaction.level_stats(files(spark, d))


@query(f"WITH {FILES} SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, count(DISTINCT level) AS levels FROM files")
def database_files(spark, d):
    return manifest.totals(files(spark, d))


@query(f"WITH {FILES} SELECT level, file_number, CAST(row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN file_number END, smallest, file_number) AS INTEGER) AS place FROM files")
def level_order(spark, d):
    return manifest.ordered(files(spark, d)).select("level", "file_number", "place")


@query(f"WITH {FILES} SELECT r.key, f.level, f.file_number FROM (SELECT range * 5 AS key FROM range(60)) r JOIN files f ON r.key BETWEEN f.smallest AND f.largest")
def files_containing_key(spark, d):
    return manifest.containing(files(spark, d), spark.range(0, 300, 5).withColumnRenamed("id", "key"))


@query(f"WITH {FILES} SELECT r.key, count(*) AS files_read FROM (SELECT range * 5 AS key FROM range(60)) r JOIN files f ON r.key BETWEEN f.smallest AND f.largest GROUP BY r.key")
def read_amplification_per_key(spark, d):
    return files_containing_key(spark, d).groupBy("key").agg(F.count("*").alias("files_read"))


@query(f"WITH {FILES} SELECT a.file_number AS input_file, b.file_number AS next_file FROM files a JOIN files b ON b.level = a.level + 1 AND a.largest >= b.smallest AND a.smallest <= b.largest")
def file_overlap_pairs(spark, d):
    return manifest.overlap_pairs(files(spark, d))


@query(f"WITH {FULL}, one AS (SELECT min(level) AS level FROM full_levels), picked AS (SELECT f.* FROM files f JOIN one USING (level) QUALIFY level = 0 OR row_number() OVER (ORDER BY file_size DESC, file_number) = 1) SELECT level, file_number FROM picked UNION SELECT f.level, f.file_number FROM files f JOIN picked p ON f.level = p.level + 1 AND f.largest >= p.smallest AND f.smallest <= p.largest")
def compaction_inputs(spark, d):
    f = files(spark, d).cache()  # a row for each file, read several times
    chosen = compaction.pick(f, BASE)
    return chosen.select("level", "file_number").union(compaction.overlapping(f, chosen).select("level", "file_number"))


@query(f"WITH {FILES} SELECT level, file_number FROM files a WHERE NOT EXISTS (SELECT 1 FROM files b WHERE b.level = a.level + 1 AND a.largest >= b.smallest AND a.smallest <= b.largest)")
def trivial_move_candidates(spark, d):
    f = files(spark, d)
    return compaction.trivial_moves(f, f).select("level", "file_number")


@query(f"WITH {FULL}, one AS (SELECT min(level) AS level FROM full_levels) SELECT f.level, f.file_number, f.file_size FROM files f JOIN one USING (level) QUALIFY level = 0 OR row_number() OVER (ORDER BY file_size DESC, file_number) = 1")
def pick_compaction(spark, d):
    return compaction.pick(files(spark, d), BASE).select("level", "file_number", "file_size")


@query(f"WITH {FILES} SELECT CAST(level + 1 AS INTEGER) AS level, file_number FROM files WHERE 60 - entries % 100 <= 0 ORDER BY 1, 2 LIMIT 1")
def pick_by_seeks(spark, d):
    """All files a level lower, where none is full: the first file whose seeks are used up."""
    lower = files(spark, d).withColumns({"level": F.col("level") + 1, "allowed_seeks": 60 - F.col("entries") % 100})
    return compaction.pick(lower, 1 << 40).select("level", "file_number")


@query(f"WITH {FULL} SELECT CAST(coalesce(min(level), 2147483647) AS INTEGER) AS priority FROM full_levels")
def compaction_priority(spark, d):
    return compaction.priority(files(spark, d), BASE)


@query("SELECT CAST(range AS INTEGER) AS level, CAST(CASE WHEN range = 0 THEN 16777216 ELSE 4194304 * pow(10.0, range - 1) END AS BIGINT) AS bytes FROM range(7)")
def level_limits(spark, d):
    return spark.range(7).select(F.col("id").cast("int").alias("level"), compaction.level_limit(F.col("id")).alias("bytes"))


@query(f"WITH {FULL}, one AS (SELECT min(level) AS level FROM full_levels) SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS work FROM (SELECT f.* FROM files f JOIN one USING (level) QUALIFY level = 0 OR row_number() OVER (ORDER BY file_size DESC, file_number) = 1)")
def compaction_work(spark, d):
    return compaction.pick(files(spark, d), BASE).agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("work"))


def _jobs(spark, d):
    e = table(spark, d, "events")
    n = lambda c, m: (F.col(c) % m).cast("int")
    return e.select("user_id", n("event_id", 7).alias("level"), n("event_id", 5).alias("input_files"), n("event_id", 3).alias("output_files"), (F.col("event_id") % 1000 * 8).alias("input_bytes"), (F.col("event_id") % 1000 * 5).alias("output_bytes"), (F.col("event_id") * 10).alias("start_ms"), (F.col("event_id") * 10 + 7).alias("end_ms"))


@query("SELECT user_id, CAST(arg_min(event_id % 7, event_id) AS INTEGER) AS level, CAST(sum(event_id % 5) AS BIGINT) AS input_files, CAST(sum(event_id % 3) AS BIGINT) AS output_files, CAST(sum(event_id % 1000 * 8) AS BIGINT) AS input_bytes, CAST(sum(event_id % 1000 * 5) AS BIGINT) AS output_bytes, min(event_id * 10) AS start_ms, max(event_id * 10 + 7) AS end_ms, CASE WHEN sum(event_id % 1000 * 8) = 0 THEN 0.0 ELSE round(sum(event_id % 1000 * 5)::DOUBLE / sum(event_id % 1000 * 8), 9) END AS ratio, CAST(sum(event_id % 1000 * 3) AS BIGINT) AS saved_bytes FROM events GROUP BY user_id")
def compaction_stats_merge(spark, d):
    return compaction.merge_stats(_jobs(spark, d), "user_id").withColumn("ratio", F.round("ratio", 9))


# manifests and logs


@query(f"WITH {EDITS} SELECT edit_id, level, file_number, edit_id AS last_sequence FROM (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_number ORDER BY edit_id DESC, CASE WHEN action = 'ADD' THEN 0 ELSE 1 END) = 1) WHERE action = 'ADD'")
def manifest_replay(spark, d):
    return manifest.replay(edits(spark, d))


@query(f"WITH {EDITS} SELECT DISTINCT a.edit_id // 10 AS edit_id, a.file_number, a.level AS from_level, b.level AS to_level FROM edits a JOIN edits b ON a.edit_id // 10 = b.edit_id // 10 AND a.file_number = b.file_number AND a.level <> b.level WHERE a.action = 'DEL' AND b.action = 'ADD'")
def manifest_trivial_moves(spark, d):
    return manifest.moves(edits(spark, d).withColumn("edit_id", F.floor(F.col("edit_id") / 10).cast("long")))


@query(f"WITH {EDITS} SELECT max(file_number) + 1 AS next_file_number, max(edit_id) AS last_sequence FROM edits")
def manifest_counters(spark, d):
    return manifest.counters(edits(spark, d))


def _batches(spark, d):
    """Orders as batches: a put for each line, a delete of the order's own key if its status is F."""
    o = table(spark, d, "orders")
    n = (F.col("o_orderkey") % 4 + 1).cast("int")
    op = lambda i: F.struct(F.when((F.col("o_orderstatus") == "F") & (i == 1), 0).otherwise(1).alias("op"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.when((F.col("o_orderstatus") != "F") | (i != 1), F.concat(F.col("o_orderpriority"), i.cast("string"))).alias("value"))
    return o.select(F.col("o_orderkey").alias("batch_id"), F.transform(F.sequence(F.lit(1), n), op).alias("ops"))


BATCHES = "ops AS (SELECT o_orderkey AS batch_id, i, CASE WHEN o_orderstatus = 'F' AND i = 1 THEN 0 ELSE 1 END AS op, 'c' || o_custkey AS key, CASE WHEN o_orderstatus <> 'F' OR i <> 1 THEN o_orderpriority || i END AS value FROM (SELECT *, unnest(generate_series(1, o_orderkey % 4 + 1)) AS i FROM orders))"


@query(f"WITH {BATCHES} SELECT key, row_number() OVER (ORDER BY batch_id, i) + 99 AS seq, op, value, batch_id FROM ops")
def wal_batches_sequence(spark, d):
    return changelog.operations(changelog.sequence_batches(_batches(spark, d), 100))


@query(f"WITH {BATCHES} SELECT batch_id, CAST(8 + sum(5 + length(key) + CASE WHEN op = 1 THEN 4 + length(value) ELSE 0 END) AS BIGINT) AS bytes FROM ops GROUP BY batch_id")
def wal_record_sizes(spark, d):
    each = changelog.operations(_batches(spark, d).withColumn("start_seq", F.lit(0)))
    return each.groupBy("batch_id").agg((8 + F.sum(codec.record_bytes(F.col("key"), F.col("value"), F.col("op")))).cast("long").alias("bytes"))


@query(f"WITH {CL} SELECT max(seq) + 1 AS next_seq, count(*) AS replayed FROM cl")
def wal_replay_next_seq(spark, d):
    return changelog.next_sequence(events_log(spark, d))


@query(f"WITH {CL} SELECT key, CAST(sum(2 * length(CAST(key AS VARCHAR)) + CASE WHEN op = 1 THEN length(event_type) ELSE 0 END + 25) AS BIGINT) AS bytes, count(*) AS entries FROM cl GROUP BY key")
def memory_size(spark, d):
    log = events_log(spark, d).withColumn("id", F.col("key")).withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("event_type"))
    return changelog.accounted_size(log, "id").withColumnRenamed("id", "key")


@query(f"WITH {CL}, sized AS (SELECT *, 2 * length(CAST(key AS VARCHAR)) + CASE WHEN op = 1 THEN length(event_type) ELSE 0 END + 25 AS b FROM cl), placed AS (SELECT *, CAST((sum(b) OVER (ORDER BY seq) - b) // 65536 AS INTEGER) AS memory FROM sized) SELECT memory, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM placed GROUP BY memory")
def memory_rotation(spark, d):
    log = events_log(spark, d).withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("event_type"))
    return changelog.rotations(log, 65536).groupBy("memory").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


#: Bytes left in a block after `p`, and whether a fragment's header still fits there.
_AT = "(32768 - {p} % 32768)"
_BEGIN = f"({{p}} + CASE WHEN {_AT} < 7 THEN {_AT} ELSE 0 END)"


@query(f"""WITH RECURSIVE {BATCHES}, sizes AS (SELECT batch_id // 256 AS log, batch_id AS record, 150 * CAST(8 + sum(5 + length(key) + CASE WHEN op = 1 THEN 4 + length(value) ELSE 0 END) AS BIGINT) AS bytes FROM ops GROUP BY batch_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY record) AS n FROM sizes),
fragment AS (
  SELECT log, n, record, 1 AS k, least(bytes, 32761) AS part, bytes - least(bytes, 32761) AS left_, 7 + least(bytes, 32761) AS p FROM numbered WHERE n = 1
  UNION ALL
  SELECT log, n, record, k, least(todo, 32768 - begins % 32768 - 7), todo - least(todo, 32768 - begins % 32768 - 7), begins + 7 + least(todo, 32768 - begins % 32768 - 7) FROM (
    SELECT f.log, m.n, m.record, CASE WHEN f.left_ > 0 THEN f.k + 1 ELSE 1 END AS k, CASE WHEN f.left_ > 0 THEN f.left_ ELSE m.bytes END AS todo, {_BEGIN.format(p="f.p")} AS begins
    FROM fragment f JOIN numbered m ON m.log = f.log AND m.n = f.n + CASE WHEN f.left_ > 0 THEN 0 ELSE 1 END))
SELECT log, record, CAST(max(k) AS INTEGER) AS fragments FROM fragment GROUP BY log, record""")
def wal_fragment_counts(spark, d):
    sizes = wal_record_sizes(spark, d).select(F.floor(F.col("batch_id") / 256).alias("log"), F.col("batch_id").alias("record"), (F.col("bytes") * 150).alias("bytes"))
    return wal.fragment_counts(sizes)


@query(f"WITH {BATCHES} SELECT batch_id // 256 AS log, row_number() OVER (ORDER BY batch_id, i) + 99 AS seq, op, key, value FROM ops")
def wal_round_trip(spark, d):
    """Batches written as framed logs of 256 batches each, and read back."""
    batches = changelog.sequence_batches(_batches(spark, d), 100).withColumn("log", F.floor(F.col("batch_id") / 256))
    got = wal.decoded(wal.framed(batches), "log")
    return got.select("log", "seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {EDITS} SELECT edit_id, 0 AS ord, action, level, file_number, CASE WHEN action = 'ADD' THEN edit_id * 3 END AS file_size, CASE WHEN action = 'ADD' THEN 'a' || file_number END AS smallest, CASE WHEN action = 'ADD' THEN 'b' || file_number END AS largest, edit_id AS last_sequence FROM edits")
def manifest_codec(spark, d):
    """Edits in the binary form of manifests, and read back."""
    n = F.col("file_number").cast("string")
    made = edits(spark, d).withColumns({"file_size": F.col("edit_id") * 3, "smallest": F.concat(F.lit("a"), n), "largest": F.concat(F.lit("b"), n)})
    got = manifest_log.decoded(manifest_log.encoded(made).withColumnRenamed("edit_id", "path"), "path")
    return got.select(F.col("path").alias("edit_id"), "ord", "action", "level", "file_number", "file_size", F.col("smallest").cast("string").alias("smallest"), F.col("largest").cast("string").alias("largest"), "last_sequence")


@query(f"WITH {FILES} SELECT (SELECT count(*) FROM cl WHERE seq > 7000) AS memory_entries, (SELECT max(seq) FROM cl) AS last_seq, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS file_bytes FROM files")
def db_status(spark, d):
    return stats.status(events_log(spark, d), files(spark, d), 7000)


# stores


def _folder(spark) -> str:
    """A new folder that all executors share; of this machine only where none is set, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='stores')}/stores/{uuid.uuid4().hex}"


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_name <> 'Customer#000000002' AND c_name <> 'Customer#000000001' UNION ALL VALUES ('Customer#000000001', 'put last'), ('another', 'put')")
def store_round_trip(spark, d):
    """Customers written in bulk, those with a finished order deleted in bulk, single writes and a batch; compacted, closed and read by the next process."""
    path = _folder(spark)
    with Store.open(spark, path) as db:
        db.write_frame(customers(spark, d).select("key", F.col("c_mktsegment").alias("value")))
        gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
        db.write_frame(customers(spark, d).join(gone, "c_custkey", "left_semi").select("key", F.lit(None).cast("string").alias("value")))
        db.write(WriteBatch().put("Customer#000000001", "first").delete("Customer#000000002").put("another", "put"))
        db.put("Customer#000000001", "put last")
        db.flush()
        db.compact_range("Customer#000000001", "a")
    return _text(Store.open(spark, path).snapshot())


@query("SELECT n_name AS key, CASE WHEN n_regionkey <> 2 THEN CAST(n_nationkey AS VARCHAR) END AS value, n_regionkey <> 2 AS found FROM nation")
def store_replay(spark, d):
    """A put for every nation, a delete for those of one region, none of it flushed: the next process reads the log."""
    path, nations = _folder(spark), table(spark, d, "nation")
    db = Store.open(spark, path)
    for n in nations.orderBy("n_nationkey").collect():  # 25 rows
        db.put(n.n_name, str(n.n_nationkey))
        if n.n_regionkey == 2:
            db.delete(n.n_name)
    got = Store.open(spark, path).multi_get(nations.select(F.col("n_name").alias("key")))
    return got.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "found")


@query("SELECT CAST(n_regionkey AS BIGINT) AS level_run, count(*) AS entries, min(n_name) AS smallest, max(n_name) AS largest FROM nation GROUP BY n_regionkey")
def store_runs(spark, d):
    """Each region's nations flushed as a run of their own: the files that the manifest knows."""
    db = Store.open(spark, _folder(spark))
    rows = table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    for region in sorted({r.n_regionkey for r in rows}):
        batch = WriteBatch()
        for r in rows:
            if r.n_regionkey == region:
                batch.put(r.n_name, str(r.n_nationkey))
        db.write(batch)
        db.flush()
    return db.files().select((F.col("file_number") - 1).alias("level_run"), "entries", F.col("smallest").cast("string").alias("smallest"), F.col("largest").cast("string").alias("largest"))


# keys and tables


@query("SELECT c_custkey, upper(hex(encode(c_name))) || '01' || lpad(hex(c_custkey), 16, '0') AS internal_key FROM customer")
def internal_key_encode(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", codec.encode_internal_key(F.col("c_name"), F.lit(1), F.col("c_custkey")).alias("internal_key"))


@query("SELECT c_custkey, c_name AS key, 1 AS op, c_custkey AS seq FROM customer")
def internal_key_decode(spark, d):
    key, op, seq = codec.decode_internal_key(F.col("internal_key"))
    return internal_key_encode(spark, d).select("c_custkey", key.alias("key"), op.alias("op"), seq.alias("seq"))


@query("SELECT k AS key, CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS place FROM (VALUES ('80', [-128]), ('FF', [-1]), ('00', [0]), ('7F', [127]), ('7F00', [127, 0]), ('8001', [-128, 1])) t(k, s)")
def signed_key_order(spark, d):
    keys = spark.createDataFrame([(x,) for x in ("80", "FF", "00", "7F", "7F00", "8001")], "key string")
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(codec.signed_order(F.unhex("key"))))  # six rows
    return keys.select("key", place.alias("place"))


PREFIX = "keyed AS (SELECT c_mktsegment AS run, c_name AS key, lag(c_name) OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS before FROM customer)"


@query(f"WITH {PREFIX}, shared AS (SELECT run, key, CAST(CASE WHEN before IS NULL THEN 0 ELSE (SELECT coalesce(max(i), 0) FROM (SELECT unnest(generate_series(1, least(length(key), length(before)))) AS i) WHERE key[1:i] = before[1:i]) END AS INTEGER) AS shared FROM keyed) SELECT *, CAST(length(key) - shared AS INTEGER) AS own FROM shared")
def prefix_sharing(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_name").alias("key"))
    return tables.prefix_sharing(rows, "run")


@query("SELECT c_mktsegment AS run, c_name AS key, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1 AS INTEGER) AS entry FROM customer QUALIFY entry % 16 = 0")
def restart_points(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_name").alias("key"))
    return tables.restart_points(rows, "run")


SIZED = "sized AS (SELECT c_mktsegment AS run, c_name AS key, 26 + length(c_name) AS size FROM customer), placed AS (SELECT *, CAST((sum(size) OVER (PARTITION BY run ORDER BY key) - 1) // 3481 AS INTEGER) AS block FROM sized)"


@query(f"WITH {SIZED} SELECT run, block, max(key) AS last_key, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM placed GROUP BY run, block")
def block_index_sparse(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_name").alias("key"))
    return tables.block_index(rows, 26 + F.length("key"), "run")


@query(f"WITH {SIZED} SELECT run, count(*) AS entries, count(DISTINCT block) AS blocks, CAST(sum(size) AS BIGINT) AS bytes, min(key) AS smallest, max(key) AS largest, round(count(*)::DOUBLE / count(DISTINCT block), 9) AS entries_per_block FROM placed GROUP BY run")
def table_stats(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_name").alias("key"))
    return tables.table_stats(rows, 26 + F.length("key"), "run").withColumn("entries_per_block", F.round("entries_per_block", 9))


@query(f"WITH {SIZED}, i AS (SELECT block, max(key) AS last_key FROM placed WHERE run = 'BUILDING' GROUP BY block) SELECT * FROM i WHERE last_key >= 'Customer#000000100' ORDER BY last_key LIMIT 1")
def block_lookup(spark, d):
    index = block_index_sparse(spark, d).where("run = 'BUILDING'").select("block", "last_key")
    return tables.block_of(index, "Customer#000000100")


@query("SELECT user_id AS run, event_id AS position, value AS key, before FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before >= value")
def order_violations(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.col("value").alias("key"))
    return tables.order_violations(e, "run")


@query(f"WITH {SIZED} SELECT run, block, CASE WHEN sum(size) > 0.85 * 4096 THEN 'full' WHEN sum(size) > 0.75 * 4096 THEN 'almost' WHEN sum(size) > 0.5 * 4096 THEN 'large' ELSE 'fits' END AS fill FROM placed GROUP BY run, block")
def block_fill(spark, d):
    return block_index_sparse(spark, d).select("run", "block", tables.fill(F.col("bytes"), F.lit(4096)).alias("fill"))


def _table_files(spark, d):
    """Customers as sorted tables of 1,000 rows each."""
    rows = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 1000).alias("file"), F.col("c_name").alias("key"), F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("value"))
    return sstable.encoded(rows, "file")


@query("SELECT c_custkey // 1000 AS file, c_name AS key, concat_ws('|', c_mktsegment, c_nationkey) AS value FROM customer")
def table_round_trip(spark, d):
    """Footer, index, handles and blocks written and read back."""
    got = sstable.decoded(_table_files(spark, d), "file")
    return got.select("file", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("WITH asked AS (SELECT DISTINCT o_custkey // 1000 AS file, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'x' END AS key FROM orders WHERE o_custkey // 1000 IN (SELECT c_custkey // 1000 FROM customer)) SELECT a.file, a.key, concat_ws('|', c.c_mktsegment, c.c_nationkey) AS value FROM asked a JOIN customer c ON c.c_name = a.key UNION ALL SELECT a.file, a.key, NULL FROM asked a WHERE a.key NOT IN (SELECT c_name FROM customer)")
def table_point_lookups(spark, d):
    """The customer of every order, half of them by a wrong name, through index and block of their table."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("x"))
    asked = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 1000).alias("file"), name.alias("key")).groupBy("file").agg(F.collect_set("key").alias("keys"))  # a table has 1,000 rows
    got = sstable.lookups(_table_files(spark, d).join(asked, "file"), "file")
    return got.select("file", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# caches, filters and counters

HASH = "hashed AS (SELECT c_name, c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM customer)"
SHARD = f"{HASH}, routed AS (SELECT *, CAST((xor(h, h >> 16) & 2147483647) % 16 AS INTEGER) AS shard FROM hashed)"


@query(f"WITH {SHARD} SELECT c_name, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash, shard FROM routed")
def shard_routing(spark, d):
    return table(spark, d, "customer").select("c_name", codec.polynomial_hash(F.col("c_name")).alias("hash"), codec.shard(F.col("c_name"), 16).alias("shard"))


@query(f"WITH {SHARD} SELECT shard, count(*) AS entries, CAST(sum(c_custkey % 4096) + 100 * count(*) AS BIGINT) AS bytes, round((sum(c_custkey % 4096) + 100 * count(*))::DOUBLE / 524288, 9) AS load FROM routed GROUP BY shard")
def shard_load_factors(spark, d):
    rows = table(spark, d, "customer").select("c_name", (F.col("c_custkey") % 4096).alias("size"))
    return cache.shard_loads(rows, "c_name", "size", 8 << 20).withColumn("load", F.round("load", 9))


@query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '.*A.*')")
def glob_match(spark, d):
    return table(spark, d, "part").where(codec.glob_match(F.col("p_type"), "*A*")).select("p_partkey", "p_type")


ENTRIES = "entries AS (SELECT c_mktsegment AS tbl, c_custkey AS off, c_custkey % 4096 AS bytes FROM customer), resident AS (SELECT * FROM entries WHERE off % 3 <> 0)"


def _entries(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("tbl"), F.col("c_custkey").alias("off"), (F.col("c_custkey") % 4096).alias("bytes"))
    return c, c.where("off % 3 <> 0")


@query(f"WITH {ENTRIES} SELECT tbl, count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes FROM entries WHERE regexp_full_match(tbl, '.*U.*') GROUP BY tbl")
def cache_invalidate(spark, d):
    return cache.invalidate(_entries(spark, d)[0], "*U*", "tbl")[1]


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(count(*) FILTER (event_type = 'view')::DOUBLE / count(*), 9) AS hit_rate, round(count(*) FILTER (event_type <> 'view')::DOUBLE / count(*), 9) AS miss_rate FROM events GROUP BY user_id")
def cache_hit_stats(spark, d):
    e = table(spark, d, "events").withColumn("hit", F.col("event_type") == "view")
    return cache.hit_stats(e, "hit", "user_id").withColumns({c: F.round(c, 9) for c in ("hit_rate", "miss_rate")})


@query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(count(*) FILTER (event_type = 'view')::DOUBLE / count(*), 9) AS hit_rate FROM events")
def cache_stats_merge(spark, d):
    return cache.merge_stats(cache_hit_stats(spark, d)).withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"WITH {ENTRIES} SELECT tbl, off FROM entries WHERE off % 3 = 0")
def stale_mappings(spark, d):
    every, resident = _entries(spark, d)
    return cache.stale(every.select("tbl", "off"), resident, ["tbl", "off"])


@query(f"WITH {ENTRIES} SELECT e.tbl, count(*) AS blocks, count(r.off) AS resident, CAST(coalesce(sum(r.bytes), 0) AS BIGINT) AS bytes, round(count(r.off)::DOUBLE / count(*), 9) AS resident_rate FROM entries e LEFT JOIN resident r ON r.tbl = e.tbl AND r.off = e.off GROUP BY e.tbl")
def table_cache_stats(spark, d):
    every, resident = _entries(spark, d)
    return cache.table_stats(every.select("tbl", "off"), resident, ["tbl", "off"], "tbl").withColumn("resident_rate", F.round("resident_rate", 9))


LRU = "asked AS (SELECT user_id % 4 AS shard, event_id AS ord, user_id AS key, 100 + user_id % 50 AS size FROM events), again AS (SELECT *, lag(ord) OVER (PARTITION BY shard, key ORDER BY ord) AS before FROM asked)"


@query(f"WITH {LRU}, passed AS (SELECT a.shard, a.ord, a.size + coalesce(sum(b.size), 0) AS held FROM again a LEFT JOIN (SELECT *, lead(ord) OVER (PARTITION BY shard, key ORDER BY ord) AS later FROM asked) b ON b.shard = a.shard AND b.ord > a.before AND b.ord < a.ord AND (b.later IS NULL OR b.later > a.ord) WHERE a.before IS NOT NULL GROUP BY a.shard, a.ord, a.size) SELECT a.shard, a.ord, coalesce(p.held <= 1500, false) AS hit FROM again a LEFT JOIN passed p ON p.shard = a.shard AND p.ord = a.ord")
def cache_eviction(spark, d):
    """Which accesses hit a cache of 1,500 bytes a shard. In SQL: those with no more than that asked for since the key was last."""
    e = table(spark, d, "events")
    asked = e.select((F.col("user_id") % 4).alias("shard"), F.col("event_id").alias("ord"), F.col("user_id").alias("key"), (100 + F.col("user_id") % 50).alias("size"))
    return cache.lru_trace(asked, 1500).drop("evicted")


@query("SELECT user_id, count(*) AS accesses, max(event_id) AS last_access FROM events GROUP BY user_id")
def cache_accesses(spark, d):
    return cache.accesses(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT c_custkey, 'block:' || c_mktsegment || ':' || c_custkey * 4096 || ':' || c_nationkey AS key FROM customer")
def cache_block_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", codec.block_key(F.col("c_mktsegment"), F.col("c_custkey") * 4096, F.col("c_nationkey")).alias("key"))


@query("SELECT n, p, CAST(ceil(-n * ln(p) / pow(ln(2.0), 2)) AS BIGINT) AS bits, CAST(greatest(1, round(ceil(-n * ln(p) / pow(ln(2.0), 2)) / n * ln(2.0))) AS INTEGER) AS hashes FROM (SELECT range AS n FROM range(1000, 20001, 1000)) CROSS JOIN (VALUES (0.01::DOUBLE), (0.001::DOUBLE), (0.1::DOUBLE)) t(p)")
def bloom_sizing(spark, d):
    rows = spark.range(1000, 20001, 1000).select(F.col("id").alias("n"), F.explode(F.array(F.lit(0.01), F.lit(0.001), F.lit(0.1))).alias("p"))
    sized = rows.withColumn("bits", estimates.bloom_bits(F.col("n"), F.col("p")))
    return sized.withColumn("hashes", estimates.bloom_hashes(F.col("bits"), F.col("n")))


@query("SELECT range AS n, round(pow(1 - exp(-7.0 * range / 9586), 7), 6) AS error FROM range(100, 5001, 100)")
def bloom_fpp(spark, d):
    return spark.range(100, 5001, 100).select(F.col("id").alias("n"), F.round(estimates.bloom_error(F.lit(7), F.col("id"), F.lit(9586)), 6).alias("error"))


@query("SELECT count(*) AS present, count(*) AS maybe FROM (SELECT DISTINCT user_id FROM events)")
def bloom_no_false_negatives(spark, d):
    keys = table(spark, d, "events").select("user_id").distinct()
    return bloom.probed(keys, keys, "user_id", keys.count()).agg(F.count("*").alias("present"), F.count_if("maybe").alias("maybe"))


@query("SELECT count(*) AS present, count(*) AS maybe FROM (SELECT DISTINCT user_id FROM events)")
def bloom_merge(spark, d):
    """The filters of each kind of event, as words of bits, united; every key of the whole table is in the union."""
    e = table(spark, d, "events")
    keys = e.select("user_id").distinct()
    size = bloom.sizes(keys.count())
    held = bloom.union(*[bloom.filled(e.where(kind), "user_id", *size) for kind in ("event_type in ('view', 'click')", "coalesce(event_type not in ('view', 'click'), true)")])
    return bloom.probe(keys, held, "user_id", *size).agg(F.count("*").alias("present"), F.count_if("maybe").alias("maybe"))


#: CRC-32 a byte at a time: the table of 256 remainders, then a fold over the bytes.
CRC = """steps AS (SELECT range AS i, list_reduce(list_prepend(range::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r FROM range(256)),
remainders AS (SELECT list(r ORDER BY i) AS t FROM steps)"""


@query(f"WITH {CRC}, crc AS (SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS v FROM customer, remainders) SELECT c_custkey, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INTEGER) AS crc32 FROM crc")
def crc32_checksum(spark, d):
    return table(spark, d, "customer").select("c_custkey", codec.checksum(F.col("c_name")).alias("crc32"))


@query(f"WITH {CL} SELECT key % 10 AS part, count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 0) AS deletes, count(DISTINCT key) AS keys, max(seq) AS last_seq FROM cl GROUP BY key % 10")
def operation_counts(spark, d):
    return stats.operations(events_log(spark, d).withColumn("part", F.col("key") % 10), "part")


@query(f"WITH {SNAP} SELECT count(*) AS gets, count(s.key) AS found, round(count(s.key)::DOUBLE / count(*), 9) AS hit_rate FROM (SELECT range * 3 AS key FROM range(100)) r LEFT JOIN snap s ON s.key = r.key")
def db_stats(spark, d):
    return stats.lookups(multi_get_with_misses(spark, d)).withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"WITH {FILES} SELECT count(DISTINCT level) AS levels, count(*) AS files, round(count(*)::DOUBLE / count(DISTINCT level), 9) AS files_per_level FROM files")
def iterator_stats(spark, d):
    return stats.scan_stats(files(spark, d)).withColumn("files_per_level", F.round("files_per_level", 9))


# commands and names

CODES = "codes AS (SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 16 ELSE 99 END AS code, user_id % 3 AS klen, event_id % 2 AS vlen FROM events)"


def _codes(spark, d):
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 16).otherwise(99)
    return table(spark, d, "events").select("event_id", code.alias("code"), (F.col("user_id") % 3).alias("klen"), (F.col("event_id") % 2).alias("vlen"))


@query(f"WITH {CODES} SELECT event_id, CASE code WHEN 1 THEN klen > 0 WHEN 2 THEN klen > 0 AND vlen = 0 WHEN 3 THEN klen > 0 AND vlen = 0 WHEN 16 THEN klen = 0 AND vlen = 0 ELSE false END AS valid FROM codes")
def command_validate(spark, d):
    return _codes(spark, d).select("event_id", codec.valid_command(F.col("code"), F.col("klen"), F.col("vlen")).alias("valid"))


@query(f"WITH {CODES} SELECT code, CASE code WHEN 1 THEN 'PUT' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'GET' WHEN 16 THEN 'BATCH_START' ELSE 'UNKNOWN(' || code || ')' END AS name, count(*) AS n FROM codes GROUP BY code")
def command_names(spark, d):
    return _codes(spark, d).groupBy("code").agg(F.count("*").alias("n")).select("code", codec.command_name(F.col("code")).alias("name"), "n")


@query(f"WITH {CODES} SELECT event_id // 1000 AS session, CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS INTEGER) AS ord, code AS opcode, repeat('k', klen::INTEGER) AS key, repeat('v', vlen::INTEGER) AS value FROM codes")
def frame_round_trip(spark, d):
    """Commands as the bytes that a client sends, a thousand to a session, and parsed again."""
    rows = _codes(spark, d).select(F.floor(F.col("event_id") / 1000).alias("session"), F.col("event_id").alias("ord"), F.col("code").alias("opcode"), F.repeat(F.lit("k"), F.col("klen").cast("int")).alias("key"), F.repeat(F.lit("v"), F.col("vlen").cast("int")).alias("value"))
    got = frames.parse(frames.written(rows))
    return got.select("session", "ord", "opcode", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {MARKED}, closed AS (SELECT DISTINCT session, batch_no FROM marked WHERE kind = 'COMMIT' AND prev = 'START') SELECT m.session, m.ord, m.kind, CAST(CASE WHEN prev = 'START' THEN m.batch_no END AS INTEGER) AS batch FROM marked m LEFT JOIN closed c ON c.session = m.session AND c.batch_no = m.batch_no WHERE kind IN ('PUT', 'DELETE') AND (prev IS DISTINCT FROM 'START' OR c.session IS NOT NULL)")
def batch_sessions(spark, d):
    return commands.applied(session_commands(spark, d)).select("session", "ord", "kind", "batch")


@query(f"WITH {MARKED} SELECT session, ord, kind, CASE WHEN kind = 'START' THEN 'Batch already started' ELSE 'No batch in progress' END AS error FROM marked WHERE (kind = 'START' AND prev = 'START') OR (kind IN ('COMMIT', 'CANCEL') AND prev IS DISTINCT FROM 'START')")
def batch_errors(spark, d):
    return commands.errors(session_commands(spark, d)).select("session", "ord", "kind", "error")


@query(f"WITH {MARKED}, said AS (SELECT session, ord, CASE WHEN kind = 'START' AND prev = 'START' THEN 'ERROR: Batch already started' WHEN kind IN ('COMMIT', 'CANCEL') AND prev IS DISTINCT FROM 'START' THEN 'ERROR: No batch in progress' ELSE 'OK' END AS t FROM marked) SELECT session, ord, printf('%08X', length(t) + 1) || hex(encode(t)) || '0A' AS reply FROM said")
def command_replies(spark, d):
    return commands.replies(session_commands(spark, d)).select("session", "ord", "reply")


@query(f"WITH {SNAP} SELECT r.key, CASE WHEN s.key IS NULL THEN 'FFFFFFFF' ELSE printf('%08X', length(s.event_type)) || hex(encode(s.event_type)) END AS reply FROM (SELECT range * 3 AS key FROM range(100)) r LEFT JOIN snap s ON s.key = r.key")
def get_replies(spark, d):
    got = multi_get_with_misses(spark, d)
    return got.select("key", codec.value_reply(F.when(F.col("found"), F.col("event_type"))).alias("reply"))


@query(f"WITH {CMD} SELECT count(DISTINCT session) AS connections, count(*) AS commands, count(*) FILTER (kind = 'PUT') AS puts, count(*) FILTER (kind = 'GET') AS gets, count(*) FILTER (kind = 'DELETE') AS deletes FROM cmd")
def server_stats(spark, d):
    return stats.server(session_commands(spark, d))


@query(f"WITH {CMD} SELECT session, count(*) AS commands, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM cmd GROUP BY session")
def session_info(spark, d):
    return commands.sessions(session_commands(spark, d))


NAMES = "names AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN lpad(event_id::VARCHAR, greatest(6, length(event_id::VARCHAR))::INTEGER, '0') || '.log' WHEN 1 THEN lpad(event_id::VARCHAR, greatest(6, length(event_id::VARCHAR))::INTEGER, '0') || '.sst' WHEN 2 THEN 'MANIFEST-' || lpad(event_id::VARCHAR, greatest(6, length(event_id::VARCHAR))::INTEGER, '0') ELSE 'x' || event_id END AS name FROM events)"


@query(f"WITH {NAMES} SELECT event_id, name, CASE WHEN name LIKE '%.log' THEN 'log' WHEN name LIKE '%.sst' THEN 'table' WHEN name LIKE 'MANIFEST-%' THEN 'manifest' ELSE 'unknown' END AS kind, CASE WHEN regexp_matches(name, '^[0-9]+\\.(sst|log)$') THEN CAST(regexp_extract(name, '^[0-9]+') AS BIGINT) END AS number FROM names")
def file_names(spark, d):
    n = F.col("event_id")
    name = F.when(n % 4 == 0, codec.file_name("log", n)).when(n % 4 == 1, codec.file_name("table", n)).when(n % 4 == 2, codec.file_name("manifest", n)).otherwise(F.concat(F.lit("x"), n.cast("string")))
    named = table(spark, d, "events").select("event_id", name.alias("name"))
    return named.withColumns({"kind": codec.file_kind(F.col("name")), "number": codec.file_number(F.col("name"))})


@query(f"WITH {NAMES} SELECT max(event_id) + 1 AS next_file_number FROM names WHERE event_id % 4 < 2")
def max_file_number(spark, d):
    return manifest.next_number(file_names(spark, d))


QUERIES = {name: q.run for name, q in REGISTRY.items()}
ORACLES = {name: q.sql for name, q in REGISTRY.items() if q.sql}
