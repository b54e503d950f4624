"""Keyed streams against batch over several micro-batches and a restart; sinks that are tried again."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.memory import supersede_with_deletes
from tessera.operators.messages import newest
from tessera.operators import collated as C
from tessera.operators import registry as R
from tessera.operators.messages import scan_session
from tessera.sources import feed, sinks
from tessera.streaming import keyed

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def in_batches(spark, parts, schema, build, tmp_path, name, between=lambda k: None):
    """Each part is a file and a micro-batch; the stream is started anew for the second half of them."""
    keyed.keep_state_on_disk(spark)
    stream = lambda: build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = None
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if query is None or k == len(parts) // 2:
                if query is not None:
                    query.stop()
                writer = stream().writeStream.format("parquet").option("path", f"{tmp_path}/{name}")
                query = writer.option("checkpointLocation", f"{tmp_path}/{name}-state").start()
            query.processAllAvailable()
            between(k)
    finally:
        if query is not None:
            query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{tmp_path}/{name}")


def cache_rows(seed, n=400):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 60, 600, 1200])
        reads = rng.random() < 0.5
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), START + datetime.timedelta(seconds=at), reads, None if reads else f"v{i:04d}"))
    return rows


CACHE = "key string, at timestamp, reads boolean, value string"


def plain_reads(rows, ttl=1800):
    out = []
    for key, at, reads, _ in rows:
        if reads:
            own = [(w, v) for k, w, r, v in rows if not r and k == key and w <= at]
            live = own and (at - max(own)[0]).total_seconds() < ttl
            out.append((key, at, bool(live), max(own)[1] if live else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r["key"], r["read_at"].replace(tzinfo=datetime.UTC) if r["read_at"].tzinfo is None else r["read_at"], r["hit"], r["value"]) for r in df.collect()), key=str)


def batch_reads(df):
    writes = df.filter("not reads").select("key", "value", F.col("at").alias("written_at"))
    return sinks.cache_reads(writes, df.filter("reads").select("key", F.col("at").alias("read_at")))


def utc(rows):
    return sorted(((k, a.astimezone(datetime.UTC).isoformat()[:19], h, v) for k, a, h, v in rows), key=str)


def shown(df):
    rows = df.select("key", F.date_format("read_at", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "hit", "value").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_cache_reads_against_loops(spark):
    rows = cache_rows(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = shown(batch_reads(spark.createDataFrame(rows, CACHE).repartition(3)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == utc(plain_reads(rows)) and {h for _, _, h, _ in found} == {True, False}
    assert shown(batch_reads(spark.createDataFrame([], CACHE))) == []


def test_cache_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = cache_rows(2, 300)
    # No key has a moment in two micro-batches.
    rows = [(k, a + datetime.timedelta(milliseconds=0), r, v) for k, a, r, v in rows]
    cuts = [0, 70, 140, 220, 300]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    edges = {p[-1][1] for p in parts[:-1]} & {p[0][1] for p in parts[1:]}
    rows = [r for r in rows if r[1] not in edges]
    parts = [[r for r in p if r[1] not in edges] for p in parts]
    found = in_batches(spark, parts, CACHE, keyed.cache_reads, tmp_path, "reads")
    assert shown(found) == shown(batch_reads(spark.createDataFrame(rows, CACHE))) == utc(plain_reads(rows))


def test_expired_entries_leave_the_state(spark, tmp_path):
    """A timer clears an entry once the watermark is past its time to live."""
    hour = datetime.timedelta(hours=1)
    parts = [[("old", START, False, "x")], [("new", START + 5 * hour, False, "y")], [("new", START + 6 * hour, True, None)], [("old", START + 7 * hour, True, None)]]
    seen = []
    rows = in_batches(spark, parts, CACHE, keyed.cache_reads, tmp_path, "expired", lambda k: seen.append(k))
    assert [r[2] for r in shown(rows)] == [False, False]
    state = spark.read.format("statestore").option("stateVarName", "entry").load(f"{tmp_path}/expired-state")
    assert state.count() == 0 or {r["key"]["key"] for r in state.collect()} <= {"new"}


LOG = "user_id long, dimension string, id long, action string, target long"


def test_stack_stream_equals_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    log = []
    for i in range(240):
        action = rng.choice(["new", "new", "supersede", "supersede", "delete", "delete", "skip"])
        log.append((rng.choice([7, 7, 7, 1]), rng.choice("ab"), i, action, i - rng.randint(1, 30) if action == "delete" else None))
    parts = [log[k : k + 60] for k in range(0, 240, 60)]
    changes = in_batches(spark, parts, LOG, keyed.stack_changes, tmp_path, "stack")
    # A row may be pushed and superseded at one point of the log at most once each.
    rank = F.when(F.col("status") == "active", 0).otherwise(1)
    last = changes.groupBy("user_id", "dimension", "id").agg(
        F.max_by("status", F.struct("at", rank.alias("r"))).alias("status"), F.max("supersedes_id").alias("supersedes_id")
    )
    batch = supersede_with_deletes(spark.createDataFrame(log, LOG)).withColumn("user_id", F.col("user_id").cast("string"))
    key = lambda df: sorted(tuple(str(r[c]) for c in ("user_id", "dimension", "id", "status", "supersedes_id")) for r in df.collect())
    assert key(last) == key(batch)


def test_failed_writer_is_tried_again(spark, tmp_path):
    """The second writer fails after it has written, the stream is started anew, and each row is in both sinks once."""
    source, failed = f"{tmp_path}/in", []
    write = sinks.batch_writer(f"{tmp_path}/second")

    def breaks(batch, number):
        write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    first = []
    plain = sinks.batch_writer(f"{tmp_path}/first")

    def counted(batch, number):
        first.append(number)
        plain(batch, number)

    def start():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        sink = sinks.ledger_sink(f"{tmp_path}/ledger", database=counted, cache=breaks)
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").start()

    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    query = start()
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    query.stop()
    query = start()
    query.processAllAvailable()
    query.stop()
    for name in ("first", "second"):
        assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == list(range(30))
    assert failed == [1] and first == [0, 1, 2]
    # Only the last batch's marks are left.
    assert sorted(os.listdir(f"{tmp_path}/ledger")) == ["2"]


def test_retention_by_increments(spark, tmp_path):
    rng = random.Random(3)
    path, schema = f"{tmp_path}/kept", "bot_id string, user_id long, id long, content string"
    write = sinks.retention_writer(path, ["bot_id", "user_id"], "id", 4, 16)
    everything, i = [], 0

    def files():
        return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}

    for k in range(5):
        rows = []
        # The last batch has two sessions only.
        for _ in range(120):
            i += 1
            rows.append((f"bot_{rng.randint(0, 3)}" if k < 4 else "bot_0", rng.randint(0, 8) if k < 4 else rng.choice([1, None]), i, f"text {i}"))
        everything += rows
        before = files() if k else {}
        batch = spark.createDataFrame(rows, schema)
        write(batch, k)
        write(batch, k)
    own = newest(spark.createDataFrame(everything, schema), ["bot_id", "user_id"], "id", 4)
    key = lambda df: sorted((tuple(r) for r in df.select("bot_id", "user_id", "id", "content").collect()), key=str)
    assert key(spark.read.parquet(path)) == key(own)
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    changed = {os.path.dirname(f) for f in after if f not in same}
    assert 1 <= len(changed) <= 2 and len(same) == len(before) - len(changed)


def decoded(df):
    return sorted((r["m"]["id"], r["m"]["text"], r["m"]["at"]) for r in df.select(F.from_json("payload", "id long, text string, at string").alias("m")).collect())


def test_feed_in_batch_and_stream_after_a_restart(spark, tmp_path):
    feed.register(spark)
    source, rows = f"{tmp_path}/in", []

    def more(first, n):
        own = [(i, None if i % 7 == 0 else f'te"xt {i} é\n🙂', datetime.date(2024, 1, 1)) for i in range(first, first + n)]
        rows.extend(own)
        spark.createDataFrame(own, "id long, text string, at date").coalesce(1).write.mode("append").option("parquet.block.size", 1024).parquet(source)

    def start():
        stream = spark.readStream.format("tessera_feed").option("filesPerBatch", 1).load(source)
        return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()

    more(0, 2500)
    more(2500, 10)
    more(2510, 0)
    query = start()
    query.processAllAvailable()
    query.stop()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 2
    more(2510, 30)
    query = start()
    query.processAllAvailable()
    query.stop()
    wanted = sorted((i, t, str(a)) for i, t, a in rows)
    assert decoded(spark.read.format("tessera_feed").load(source)) == wanted
    assert decoded(spark.read.parquet(f"{tmp_path}/out")) == wanted
    one = next(p for p in os.listdir(source) if p.endswith(".parquet"))
    found = spark.read.format("tessera_feed").load(f"file://{source}/{one}")
    assert found.count() == spark.read.parquet(f"{source}/{one}").count()


def test_collated_keys(spark):
    old = spark.createDataFrame([("Ångel", "a", None), ("bob", None, "x"), ("carl", "c", "c")], "bot_id string, label string, wechat_user_id string")
    old = old.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("created_at", "last_active_at")})
    said = [("angel ", None, "1", 1), ("ANGEL", "new", None, 2), ("ängel", None, "2", 3), ("dora", "d", "d", 4), ("Bob", None, None, 5), (None, "n", "n", 6)]
    new = C.one_each(spark.createDataFrame(said, "bot_id string, label string, wechat_user_id string, n long"), "bot_id", ["label", "wechat_user_id"], "n")
    new = new.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    found = R.upsert(old, new, "bot_id", ["label", "wechat_user_id"], "2024-01-01 00:00:00", C.COLLATION)
    assert found.schema["bot_id"].dataType == old.schema["bot_id"].dataType
    rows = {r["bot_id"]: (r["label"], r["wechat_user_id"], r["last_active_at"] is not None) for r in found.collect()}
    assert rows == {"Ångel": ("new", "2", True), "bob": (None, "x", True), "carl": ("c", "c", False), "dora": ("d", "d", True), None: ("n", "n", False)}
    left = R.delete(old, spark.createDataFrame([("CARL  ",), ("b",)], "bot_id string"), "bot_id", C.COLLATION)
    assert sorted(r["bot_id"] for r in left.collect()) == ["bob", "Ångel"]
    chat = spark.createDataFrame([(1, "Bot", 1), (2, "bot ", 1), (3, "bot", 2), (4, "robot", 1)], "id long, bot_id string, user_id long")
    assert [r["id"] for r in scan_session(chat, "BÖT", 1, C.COLLATION).collect()] == [1, 2]
    assert [r["id"] for r in scan_session(chat, "Bot", 1).collect()] == [1]
