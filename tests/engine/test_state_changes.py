"""State across batches, matched traces, the change feed, and spans of languages."""

import os
import random
import time

import pytest

from pyspark.sql import functions as F

from sheafwork.functions import spans
from sheafwork.sources import changes
from sheafwork.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocksdb(spark):
    """The state store that arbitrary state needs, and few state partitions."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(df, tmp_path, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()


def test_shuffled_messages_end_like_the_batch(spark, rocksdb, tmp_path):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "text").limit(60).collect()
    random.Random(3).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    newest = {}
    q = state.last_messages(stream, 3).writeStream.format("memory").queryName("last_messages").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and sum(r.n_messages for r in newest.values()) < len(rows):
            time.sleep(0.5)
            for r in spark.table("last_messages").collect():
                if r.conv_id not in newest or r.n_messages >= newest[r.conv_id].n_messages:
                    newest[r.conv_id] = r
    finally:
        q.stop()
    want = {}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.turn, r.text))
    assert {c: (r.n_messages, list(zip(r.turns, r.last_texts))) for c, r in newest.items()} == {c: (len(v), sorted(v)[-3:]) for c, v in want.items()}
    assert spark.table("last_messages").count() > len(want)  # several batches


def test_idle_conversations_close_and_expire(spark, rocksdb, tmp_path):
    schema = "conv_id long, turn long, text string"
    spark.createDataFrame([(1, 1, "a")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = state.last_messages(stream, 3, ttl_ms=60_000, idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", f"{tmp_path}/idle").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("idle").where("closed").count():
            time.sleep(0.5)
        spark.createDataFrame([(1, 2, "b")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        while time.time() < until and spark.table("idle").where("not closed").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    got = [(r.n_messages, r.last_texts, r.closed) for r in spark.table("idle").collect()]
    assert got[:2] == [(1, ["a"], False), (1, ["a"], True)] and got[2] == (1, ["b"], False)  # the old message is forgotten


def test_traces_stream_equals_batch(spark, tmp_path):
    t = lambda s: f"2024-01-01 {s}"
    starts = [(1, t("00:00:00")), (2, t("00:10:00")), (3, t("00:20:00")), (4, t("05:00:00"))]
    ends = [(1, t("00:00:30")), (2, t("02:00:00")), (3, t("00:20:00")), (9, t("00:01:00")), (4, t("05:30:00"))]
    a = spark.createDataFrame(starts, "trace_id int, s string").select("trace_id", F.to_timestamp("s").alias("started"))
    b = spark.createDataFrame(ends, "trace_id int, e string").select("trace_id", F.to_timestamp("e").alias("ended"))
    batch = sorted(map(tuple, state.traces(a, b).select("trace_id", "seconds").collect()), key=str)
    assert batch == [(1, 30.0), (2, None), (3, 0.0), (4, 1800.0)]
    a.coalesce(1).write.parquet(f"{tmp_path}/a")
    b.coalesce(1).write.parquet(f"{tmp_path}/b")
    sa, sb = (spark.readStream.schema(d.schema).parquet(f"{tmp_path}/{n}") for d, n in ((a, "a"), (b, "b")))
    run(state.traces(sa, sb), tmp_path, "traces", "append")
    assert sorted((tuple(r) for r in spark.table("traces").select("trace_id", "seconds").collect()), key=str) == batch


def test_change_feed(spark, tmp_path):
    changes.register(spark)
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.xlsx", "b.xlsx", "sub/c.xlsx", "note.txt"):
        (folder / name).write_text(name)
    feed = spark.readStream.format("file_changes").option("path", str(folder)).option("snapshots", f"{tmp_path}/snapshots").option("pattern", "*.xlsx").load()

    def once():
        q = feed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    def seen():
        return sorted((os.path.relpath(r.path, folder), r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    once()
    first = [("a.xlsx", "added"), ("b.xlsx", "added"), ("sub/c.xlsx", "added")]
    assert seen() == first
    once()
    assert seen() == first
    (folder / "a.xlsx").unlink()
    (folder / "b.xlsx").write_text("longer than before")
    (folder / "d.xlsx").write_text("new")
    once()
    once()
    assert seen() == sorted([*first, ("a.xlsx", "removed"), ("b.xlsx", "changed"), ("d.xlsx", "added")])
    assert len(os.listdir(tmp_path / "snapshots")) <= 2


def plain_spans(text):
    """Character by character, then joined."""
    kind = lambda c: "th" if "฀" <= c <= "๿" else "en" if c.isalpha() and ord(c) < 128 else "unknown"
    runs = []
    for i, c in enumerate(text):
        if runs and runs[-1][0] == kind(c):
            runs[-1][2] = i + 1
        else:
            runs.append([kind(c), i, i + 1])
    out = []
    for k, a, e in runs:
        shown = text[a:e].strip()
        if shown and out and out[-1][0] == k:
            out[-1] = (k, out[-1][1], e, out[-1][3] + " " + shown)
        elif shown:
            out.append((k, a, e, shown))
    return out


def test_language_spans(spark):
    spans.register(spark)
    rng = random.Random(6)
    texts = ["", " \n", "abc", "รายงาน ยอดขาย report 2024 ของ Q1", "ก่ำัab", "été déjà", None]
    texts += ["".join(rng.choice(["ก", "า", "a", "B", " ", "\t", "1", ".", "é", " ", "日"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df.createOrReplaceTempView("span_texts")
    found = {}
    for r in spark.sql("SELECT i, s.* FROM span_texts, LATERAL language_spans(text) s").collect():
        found.setdefault(r.i, []).append((r.language, r.span_start, r.span_end, r.span_text))
    for i, text in enumerate(texts):
        want = plain_spans(text or "")
        assert found.get(i, []) == want
        at = 0
        for _, a, e, _ in want:  # offsets rebuild the text: nothing but blanks lies between spans
            assert not text[at:a].strip() and a < e
            at = e
        assert not (text or "")[at:].strip()
