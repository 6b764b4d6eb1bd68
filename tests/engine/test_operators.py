import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec, estimates, filterhash
from tidemark.operators import bloom, cache, changelog, commands, compaction, manifest, merge, snapshot, tables
from tidemark.plans import catalog
from tidemark.sources import directory, frames, manifest_log, sstable, wal
from tidemark.store import Store


def test_random_changelogs_equal_a_dict(spark):
    r = random.Random(3)
    rows = [(f"k{r.randrange(30)}", seq, r.randrange(2), f"v{seq}") for seq in range(400)]
    log = spark.createDataFrame(rows, "key string, seq long, op int, value string").repartition(5)
    for as_of in (None, 10, 200):
        model = {}
        for k, s, op, v in rows:
            if as_of is None or s <= as_of:
                model[k] = v
                if not op:
                    del model[k]
        assert {x.key: x.value for x in snapshot.snapshot(log, as_of).collect()} == model
    assert [x.key for x in snapshot.seek(snapshot.snapshot(log), "k2", 3).collect()] == sorted(k for k in _live(rows) if k >= "k2")[:3]
    ranks = {x.key: x["rank"] for x in snapshot.ranked(snapshot.snapshot(log)).collect()}
    assert ranks == {k: i + 1 for i, k in enumerate(sorted(_live(rows)))}
    runs = log.withColumn("file_number", F.floor(F.col("seq") / 37).cast("long"))
    assert {x.key: x.value for x in merge.merge(runs, drop_deletes=True).collect()} == _live(rows)


def _live(rows):
    model = {}
    for k, _, op, v in rows:
        model.pop(k, None)
        if op:
            model[k] = v
    return model


def test_delete_after_put_and_put_after_delete(spark):
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 0, None), ("b", 3, 0, None), ("b", 4, 1, "y"), ("c", 5, 0, None)], "key string, seq long, op int, value string")
    assert [(r.key, r.value) for r in snapshot.snapshot(log).collect()] == [("b", "y")]
    assert sorted(r.key for r in snapshot.tombstones(log).collect()) == ["a", "c"]
    assert snapshot.get(log, "a").count() == 0 and snapshot.get(log, "b").first().value == "y"


def test_point_get_reaches_the_scan(spark, sf_dir):
    from tidemark.plans.catalog import point_get

    plan = point_get(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,10)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_sequences_of_batches(spark):
    rows = [(b, [(1, f"k{b}", "v")] * (b % 3)) for b in (5, 250_000, 3, 100_001, 7)]
    batches = spark.createDataFrame(rows, "batch_id long, ops array<struct<op:int,key:string,value:string>>")
    got = {r.batch_id: r.start_seq for r in changelog.sequence_batches(batches, 10).collect()}
    at, expected = 10, {}
    for b, ops in sorted(rows):
        expected[b] = at
        at += len(ops)
    assert got == expected


def test_signed_order_and_prefixes(spark):
    keys = spark.createDataFrame([(bytearray(x),) for x in (b"\x80", b"\xff", b"\x00", b"\x7f", b"\x7f\x00", b"")], "key binary")
    got = [bytes(r.key) for r in keys.orderBy(codec.signed_order(F.col("key"))).collect()]
    assert got == [b"", b"\x80", b"\xff", b"\x00", b"\x7f", b"\x7f\x00"]
    pairs = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "x"), (None, "x"), ("é1", "é2"), ("same", "same")], "a string, b string")
    assert [r[0] for r in pairs.select(codec.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 2, 0, 0, 1, 4]


def test_globs_and_validity(spark):
    names = spark.createDataFrame([("log_2024_01",), ("log_2024",), ("xlog_2024_01",), ("log_2024_a.b",)], "n string")
    assert [r[0] for r in names.select(codec.glob_match(F.col("n"), "log_2024_*")).collect()] == [True, False, False, True]
    assert [r[0] for r in names.select(codec.glob_match(F.col("n"), "log_2024_?.b")).collect()] == [False, False, False, True]
    keys = spark.createDataFrame([("",), (None,), ("k",), ("x" * 1025,)], "k string")
    assert [r[0] for r in keys.select(codec.valid_key(F.col("k"))).collect()] == [False, False, True, False]


def files(spark, rows):
    return spark.createDataFrame(rows, "level int, file_number long, file_size long, smallest string, largest string")


def test_level_zero_triggers_and_takes_all(spark):
    f = files(spark, [(0, i, 1024, a, b) for i, (a, b) in enumerate(["ad", "eh", "il", "mp", "qt"])] + [(1, 9, 2048, "a", "z")])
    assert compaction.priority(f).first()[0] == 0
    chosen = compaction.pick(f)
    assert sorted(r.file_number for r in chosen.collect()) == [0, 1, 2, 3, 4]
    assert [r.file_number for r in compaction.overlapping(f, chosen).collect()] == [9]
    calm = files(spark, [(0, 1, 10, "a", "b"), (1, 2, 10, "a", "b")])
    assert compaction.pick(calm).count() == 0 and compaction.priority(calm).first()[0] == 2_147_483_647


def test_trivial_moves(spark):
    inputs = [(1, 1, 10, "a", "m")]
    apart, meets = files(spark, [*inputs, (2, 2, 10, "n", "z")]), files(spark, [*inputs, (2, 2, 10, "k", "z")])
    one = files(spark, inputs)
    assert compaction.trivial_moves(apart, one).count() == 1 and compaction.trivial_moves(meets, one).count() == 0


def test_newest_run_wins(spark):
    run = spark.createDataFrame([("key1", 1, 1, "old", 1), ("key2", 2, 1, "value2", 1), ("key1", 3, 1, "new", 2), ("key3", 4, 1, "value3", 2)], "key string, seq long, op int, value string, file_number long")
    assert {r.key: r.value for r in merge.merge(run).collect()} == {"key1": "new", "key2": "value2", "key3": "value3"}


def test_stats_merge(spark):
    rows = spark.createDataFrame([(1, 2, 1, 2048, 1024, 1000, 2000), (1, 3, 2, 3072, 2048, 1500, 2500)], "level int, input_files int, output_files int, input_bytes long, output_bytes long, start_ms long, end_ms long")
    r = compaction.merge_stats(rows).first()
    assert (r.level, r.input_files, r.output_files, r.input_bytes, r.output_bytes, r.start_ms, r.end_ms, r.ratio, r.saved_bytes) == (1, 5, 3, 5120, 3072, 1000, 2500, 0.6, 2048)
    none = compaction.merge_stats(rows.where("false")).first()
    assert (none.level, none.input_bytes, none.ratio) == (-1, 0, 0.0)


def test_manifest_edits_fold_in_order(spark):
    rows = [(1, "ADD", 0, 1), (1, "ADD", 0, 2), (2, "DEL", 0, 1), (2, "ADD", 1, 1), (3, "ADD", 0, 2), (3, "DEL", 0, 2)]
    e = spark.createDataFrame(rows, "edit_id long, action string, level int, file_number long")
    live = lambda n=None: sorted((r.level, r.file_number) for r in manifest.replay(e, n).collect())
    assert live(1) == [(0, 1), (0, 2)] and live() == [(0, 2), (1, 1)]
    assert [(r.file_number, r.from_level, r.to_level) for r in manifest.moves(e).collect()] == [(1, 0, 1)]


def test_sessions(spark):
    kinds = ["PUT", "START", "PUT", "START", "PUT", "COMMIT", "COMMIT", "START", "PUT", "CANCEL", "PUT", "START", "PUT"]
    rows = spark.createDataFrame([(1, i, k, i * 10.0) for i, k in enumerate(kinds)], "session int, ord int, kind string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.ord, r.batch) for r in commands.applied(rows).orderBy("ord").collect()] == [(0, None), (2, 1), (4, 1), (10, None)]
    assert [(r.ord, r.error) for r in commands.errors(rows).orderBy("ord").collect()] == [(3, "Batch already started"), (6, "No batch in progress")]
    assert [r.ord for r in commands.applied(rows, timeout_s=30).orderBy("ord").collect()] == [0, 10]


def test_blooms_have_no_false_negatives(spark):
    keys = spark.range(0, 2000, 2)
    made = bloom.BloomFilter.of(keys.where("id < 1000"), "id")
    other = bloom.BloomFilter.of(keys.where("id >= 1000"), "id")
    both = made.union(other)
    assert all(both.may_contain(i) for i in range(0, 2000, 2)) and both.bits >= 9586
    back = bloom.BloomFilter.from_bytes(both.to_bytes(), keys)
    assert all(back.may_contain(i) for i in range(0, 2000, 2))
    assert sum(back.may_contain(i) for i in range(1, 2000, 2)) < 40
    r = spark.range(1).select(estimates.bloom_bits(F.lit(1000), F.lit(0.01)).alias("m"), estimates.ratio(F.lit(1), F.lit(0)).alias("z")).first()
    assert r.m == 9586 and r.z == 0


def test_caches(spark):
    rows = spark.createDataFrame([(t, o, 100) for t in ("users", "orders") for o in range(3)], "table string, offset long, bytes long")
    stays, freed = cache.invalidate(rows, "user*")
    assert stays.count() == 3 and [(r.table, r.blocks, r.bytes) for r in freed.collect()] == [("users", 3, 300)]
    assert cache.stale(rows.select("table", "offset"), stays, ["table", "offset"]).count() == 3
    assert tables.order_violations(spark.createDataFrame([(0, "banana"), (1, "apple"), (2, "b")], "position int, key string")).first().key == "apple"


def test_log_frames_round_trip(spark, tmp_path):
    r = random.Random(2)
    records = [wal.encode_record(i * 10, [(1, b"k%d" % i, r.randbytes(n)), (0, b"gone", None)]) for i, n in enumerate([0, 5, 40_000, 32_000, 1, 100_000, 32_720])]
    data = wal.frame(records)
    assert list(wal.unframe(data)) == records
    at = 0
    for x in records:
        count, end = wal.fragments(len(x), at)
        piece = wal.frame([x], at)
        assert at + len(piece) == end and count >= 1
        at = end
    (tmp_path / "000001.log").write_bytes(data)
    rows = wal.read(spark, str(tmp_path)).orderBy("seq").collect()
    assert len(rows) == 14 and bytes(rows[4].value) == records[2][8 + 5 + 2 + 4 : 8 + 5 + 2 + 4 + 40_000] and rows[1].value is None
    broken = bytearray(data)
    broken[20] ^= 1
    left = list(wal.unframe(bytes(broken)))
    assert records[0] not in left and left and all(x in records for x in left)
    assert wal.decode_record(records[1] + b"\x07junk") == wal.decode_record(records[1])
    counts = wal.fragment_counts(spark.createDataFrame([("a", i, len(x)) for i, x in enumerate(records)], "log string, record int, bytes int"))
    at, expected = 0, []
    for x in records:
        n, at = wal.fragments(len(x), at)
        expected.append(n)
    assert [r.fragments for r in counts.orderBy("record").collect()] == expected


def test_checksums_equal_zlib(spark):
    rows = spark.createDataFrame([("abc",), ("",), ("é",)], "s string")
    for r in rows.select("s", codec.checksum(F.col("s")).alias("c")).collect():
        assert r.c & 0xFFFFFFFF == zlib.crc32(r.s.encode())


def test_client_frames(spark):
    data = frames.write(1, b"key", b"value") + frames.write(3, b"key") + frames.write(0x10)
    reader, got = frames.FrameReader(), []
    for i in range(0, len(data), 4):
        got += reader.feed(data[i : i + 4])
    assert got == [(1, b"key", b"value"), (3, b"key", b""), (0x10, b"", b"")]
    parsed = frames.parse(spark.createDataFrame([("s", bytearray(data + b"\x01"))], "session string, data binary")).orderBy("ord").collect()
    assert [(r.opcode, bytes(r.key)) for r in parsed] == [(1, b"key"), (3, b"key"), (0x10, b"")]


def test_binary_manifests(spark, tmp_path):
    edits = [manifest_log.Edit("bytewise", 1, 2, 3, [], [(0, 1, 100, b"a", b"m")]), manifest_log.Edit(last_sequence=9, removed=[(0, 1)], added=[(1, 1, 100, b"a", b"m")])]
    manifest_log.write(str(tmp_path / "MANIFEST-000001"), edits)
    data = (tmp_path / "MANIFEST-000001").read_bytes()
    assert list(manifest_log.decode(data)) == edits
    with pytest.raises(ValueError):
        list(manifest_log.decode(data[:-3]))
    rows = manifest_log.read(spark, str(tmp_path))
    assert [(r.level, r.file_number, bytes(r.smallest)) for r in manifest.replay(rows).collect()] == [(1, 1, b"a")]


def test_large_entries_and_zip(spark):
    log = spark.createDataFrame([("K" * 1024, 1, 1, "V" * 2048)], "key string, seq long, op int, value string")
    assert snapshot.get(log, "K" * 1024).first().value == "V" * 2048
    lists = spark.createDataFrame([(["a", "b", "c"], [1, 2]), ([], [1])], "k array<string>, v array<int>")
    assert [(r.key, r.value) for r in merge.zipped(lists, "k", "v").collect()] == [("a", 1), ("b", 2)]
    assert merge.empty(spark, log.schema).count() == 0 and merge.singleton(spark, log.schema, "a", 1, 1, "v").count() == 1


def test_sorted_tables_round_trip(spark, tmp_path):
    for rows in ([], [(b"", b"x")], [(b"K" * 1024, b"V" * 2048)], [(b"key%03d" % i, b"value%03d" % i) for i in range(300)]):
        data = sstable.encode(rows, 256)
        assert list(sstable.decode(data)) == rows
    with pytest.raises(ValueError):
        sstable.encode([(b"banana", b""), (b"apple", b"")])
    for bad in (data[:-1], b"short", b"\xff\xff\xff\xff" + data[4:]):
        with pytest.raises(sstable.Corrupt):
            list(sstable.decode(bad))
    # by hand: one entry that shares nothing, restart points 0 and 0
    assert sstable.encode_block([(b"a", b"1")]) == bytes.fromhex("00000000" "00000001" "00000001") + b"a1" + bytes.fromhex("00000000" "00000000" "00000002")


def test_a_binary_database_is_loaded(spark, tmp_path):
    write = lambda number, rows: (tmp_path / f"{number:06d}.sst").write_bytes(sstable.encode(sorted(rows.items())))
    write(1, {b"a": b"old", b"b": b"deep"})
    write(2, {b"a": b"middle", b"c": b"zero"})
    write(3, {b"a": b"newest table", b"d": b"gone"})
    write(4, {b"x": b"not live"})
    added = lambda level, number: (level, number, 10, b"a", b"z")
    manifest_log.write(str(tmp_path / "MANIFEST-000001"), [manifest_log.Edit(added=[added(0, 1), added(0, 4)]), manifest_log.Edit(removed=[(0, 1), (0, 4)], added=[added(1, 1), added(0, 2), added(0, 3)])])
    (tmp_path / "000005.log").write_bytes(wal.frame([wal.encode_record(7, [(1, b"b", b"from the log"), (0, b"d", None)])]))
    got = {bytes(r.key): bytes(r.value) for r in directory.load(spark, str(tmp_path)).collect()}
    assert got == {b"a": b"newest table", b"b": b"from the log", b"c": b"zero"}
    db = Store.open(spark, str(tmp_path / "db"))
    db.write_frame(directory.load(spark, str(tmp_path)))
    assert db.get("b") == b"from the log" and db.snapshot().count() == 3


def test_bloom_query_probes_every_key(spark, tmp_path):
    spark.range(-300, 200).withColumnRenamed("id", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(catalog.bloom_no_false_negatives(spark, str(tmp_path)).first()) == (500, 500)
    keys = spark.range(4000).withColumnRenamed("id", "user_id")
    got = bloom.probed(keys, keys.where("user_id < 2000"), "user_id", 2000).collect()
    assert all(r.maybe for r in got if r.user_id < 2000) and sum(r.maybe for r in got if r.user_id >= 2000) < 60


def test_filter_hashes():
    """Against values published for 32-bit MurmurHash3 and for Java's generator."""
    usual = lambda data, seed: filterhash.murmur(data, seed, "<") & 0xFFFFFFFF
    assert [usual(b"", 0), usual(b"", 1), usual(b"test", 0x9747B28C), usual(b"Hello, world!", 0x9747B28C), usual(b"aaa", 0x9747B28C), usual(b"aa", 0x9747B28C)] == [0, 0x514E28B7, 0x704B81DC, 0x24884CBA, 0x283E0130, 0x5D211726]
    assert filterhash.murmur(b"\x01\x02\x03\x04", 7) == filterhash.murmur(b"\x04\x03\x02\x01", 7, "<")
    ints = filterhash.java_ints(42)
    assert [next(ints), next(ints)] == [-1170105035, 234785527]
    bits = filterhash.places(b"key", 9586, 7)
    assert len(bits) == 7 and all(0 <= b < 9586 for b in bits) and bits == filterhash.places(b"key", 9586, 7)


def test_lru():
    c = cache.Lru(10)
    assert c.put("a", 4) == 0 and c.put("b", 4) == 0 and c.get("a") == 4
    assert c.put("c", 4) == 1 and c.get("b") is None and c.bytes == 8
    assert c.put("a", 5) == 0 and list(c.entries) == ["c", "a"] and c.bytes == 9
    assert c.put("d", 11) is None and c.bytes == 0 and not c.delete("a")
    c.put("x", 3)
    c.put("y", 3)
    assert c.prune(4) == 1 and list(c.entries) == ["y"]
    c.clear()
    assert c.bytes == 0 and c.get("y") is None


def test_table_lookups_decode_one_block(spark):
    rows = [(b"key%03d" % i, b"value%03d" % i) for i in range(300)]
    t = sstable.Table(sstable.encode(rows, 256))
    assert len(t.handles) > 10 and t.decoded == 0
    assert t.get(b"key123") == b"value123" and t.decoded == 1
    assert t.get(b"key1234") is None and t.get(b"zzz") is None and t.get(b"") is None
    assert list(t.scan(b"key290")) == rows[290:] and list(t.scan(b"key2995")) == [] and list(t.scan()) == rows
    assert sstable.Table(sstable.encode([])).get(b"x") is None


def test_ranges_for_any_number_of_parts(spark):
    """Thousands of ranges are one fixed expression; results do not depend on how many there are."""
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("key"), F.lit(2).cast("long").alias("n"), F.format_string("k%05d", F.col("id")).alias("name"))
    for parts in (1, 3, 10_000):
        got = snapshot.running(rows, "n", parts=parts).agg(F.count_if(F.col("running") % 2 == 0), F.max("running"), F.countDistinct("running")).first()
        assert tuple(got) == (20_000, 40_000, 20_000)
        ordered = snapshot.running(rows, "n", parts=parts).orderBy("key").select("running").limit(5).collect()
        assert [r[0] for r in ordered] == [2, 4, 6, 8, 10]
    assert len(snapshot.bounds(rows, "name", 7)) == 6 and snapshot.bounds(rows, "name") == []
    one = snapshot.running(rows.drop("key"), "n", "name").orderBy("name").collect()
    many = snapshot.running(rows.drop("key"), "n", "name", 50).orderBy("name").collect()
    assert one == many and [r.running for r in one] == list(range(2, 40_001, 2))
    few = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", None, "w"), (None, 5, "v")], "run string, key int, value string")
    got = {(r.run, r.key): r.before for r in snapshot.previous(few, "value", by=["run"], parts=3).collect()}
    assert got == {("a", None): None, ("a", 1): "w", ("a", 3): "y", ("b", 2): None, (None, 5): None}


def test_files_and_keys_meet_in_ranges(spark):
    r = random.Random(4)
    spans = [(level, 100 * level + k, 1, *sorted((r.randrange(1000), r.randrange(1000)))) for level in range(3) for k in range(30)]
    f = spark.createDataFrame(spans, "level int, file_number long, file_size long, smallest long, largest long")
    keys = spark.range(-5, 1005, 3).withColumnRenamed("id", "key")
    got = sorted((x.key, x.file_number) for x in manifest.containing(f, keys).collect())
    assert got == sorted((k, n) for k in range(-5, 1005, 3) for _, n, _, a, b in spans if a <= k <= b)
    pairs = sorted(map(tuple, manifest.overlap_pairs(f).collect()))
    assert pairs == sorted((n, m) for p, n, _, a, b in spans for q, m, _, c, e in spans if q == p + 1 and b >= c and a <= e)
