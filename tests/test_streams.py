"""Streams with state, cursors and late rows: restarts give the batch answers, and state stays bounded."""

import os
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import events as E
from marlstone.sources.growing import growing_lines
from marlstone.streaming import sessions, state

HOUR = 3_600_000_000
SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


def rows(n=90):
    """Events of three users and none, in order of time, ten minutes apart."""
    return [(i, [1, 2, 3, None][i * 7 % 4], ["view", "error", None, "error", "click"][i * 3 % 5], [5.0, 40.0, None, 12.5][i % 4], i * 600) for i in range(n)]


def batches(spark, folder, parts):
    """A folder to which one file is added at a time."""
    for n, part in enumerate(parts):
        df = spark.createDataFrame([(i, u, t, v, None) for i, u, t, v, _ in part], SCHEMA).drop("ts")
        at = spark.createDataFrame([(i, s) for i, *_, s in part], "event_id long, s long")
        whole = df.join(at, "event_id").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
        whole.coalesce(1).write.mode("append").parquet(folder)
        yield n


def run(spark, df, out, checkpoint):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


CASES = {
    "rate": (
        lambda s: state.rate_limited(s, key="user_id", limit=3, window_us=3 * HOUR),
        lambda b: E.anchored_rate_limit(b, key="user_id", limit=3, window_us=3 * HOUR).select("event_id", "admitted"), "admitted",
    ),
    "breaker": (
        lambda s: state.breaker(s, F.col("event_type") == "error", key="user_id", failures=2, cool_us=HOUR),
        lambda b: E.breaker_states(b, F.col("event_type") == "error", key="user_id", failures=2, cool_us=HOUR).select("event_id", "state"), "state",
    ),
    "budget": (
        lambda s: state.budget(s, F.col("value"), key="user_id", ceiling=60.0, window_us=10_000 * HOUR),
        lambda b: E.budget_admission(b, F.col("value"), key="user_id", ceiling=60.0).select("event_id", "admitted"), "admitted",
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_restarts_in_mid_stream_give_the_batch_answer(spark, tmp_path, case):
    make, batch, answer = CASES[case]
    folder, all_ = str(tmp_path / "in"), rows()
    out = None
    for _ in batches(spark, folder, [all_[:31], all_[31:32], all_[32:]]):
        out = run(spark, make(stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "check"))  # a new query each time
    got = {r["event_id"]: r[answer] for r in out.collect()}
    want = {r["event_id"]: r[answer] for r in batch(spark.read.parquet(folder).withColumn("us", F.unix_micros("ts"))).collect()}
    assert got == want and len(set(got.values())) > 1 and out.count() == len(all_)


def test_a_budget_is_renewed_and_its_state_goes(spark, tmp_path):
    folder, all_ = str(tmp_path / "in"), rows()
    df = stream(spark, folder) if list(batches(spark, folder, [all_])) else None
    out = run(spark, state.budget(df, F.col("value"), key="user_id", ceiling=60.0, window_us=2 * HOUR), str(tmp_path / "out"), str(tmp_path / "check"))
    used, want = {}, {}
    for i, u, _, v, s in all_:
        start, spent = used.get(u, (None, 0))
        if start is None or s - start >= 7200:
            start, spent = s, 0
        want[i] = v is not None and spent + v <= 60
        used[u] = (start, spent + (v if want[i] else 0))
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == want
    # a row long after: the watermark passes all windows, and the timers leave nothing but the new ones
    list(batches(spark, folder, [[(1000, 9, "view", 1.0, 10**6)], ]))
    run(spark, state.budget(stream(spark, folder), F.col("value"), key="user_id", ceiling=60.0, window_us=2 * HOUR), str(tmp_path / "out"), str(tmp_path / "check"))
    left = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "check")).collect()
    assert len(left) == 1


def test_repeats_are_looked_for_among_the_last_keys_only(spark, tmp_path):
    folder = str(tmp_path / "in")
    ids = [i * 5 % 13 for i in range(60)] + [None, None]
    parts = [[(i, 1, "view", 1.0, n) for n, i in enumerate(ids)][a:b] for a, b in ((0, 20), (20, 21), (21, 62))]
    schema = "event_id long, ts timestamp"
    out = None
    for part in parts:
        spark.createDataFrame([(i, s) for i, *_, s in part], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        out = run(spark, state.first_of_last(spark.readStream.schema(schema).parquet(folder), "event_id", most=8, shards=1), str(tmp_path / "out"), str(tmp_path / "check"))
    seen, want = OrderedDict(), []
    for n, i in enumerate(ids):
        if i not in seen:
            seen[i] = None
            want.append((n * 1_000_000, i))
            if len(seen) > 8:
                seen.popitem(last=False)
    assert sorted(((r["us"], r["event_id"]) for r in out.collect()), key=str) == sorted(want, key=str)
    kept = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "check")).collect()
    assert 0 < len(kept) <= 8  # one list of a shard, eight keys at most
    spread = run(spark, state.first_of_last(spark.readStream.schema(schema).parquet(folder), "event_id", most=1000, shards=4), str(tmp_path / "out2"), str(tmp_path / "check2"))
    assert spread.count() == len(set(ids))


def test_a_growing_file_is_read_once_line_by_line(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    said = {}

    def add(name, data):
        with open(folder / name, "ab") as f:
            f.write(data)
        said[name] = said.get(name, b"") + data

    def read():
        df = run(spark, growing_lines(spark, str(folder), part_bytes=16, settled=2), out, check)
        return sorted((r["file"], r["at"], r["line"]) for r in df.collect())

    def want(half=()):
        return sorted((n, sum(len(x) + 1 for x in lines[:i]), x.rstrip(b"\r").decode("utf-8", "replace")) for n, data in said.items() for lines in [data.split(b"\n")] for i, x in enumerate(lines[:-1]) if x.strip(b"\r"))

    add("d1.jsonl", b"one\ntwo\n\nthr")
    add("d1.txt", b"other\n")
    del said["d1.txt"]
    assert read() == want()
    add("d1.jsonl", "ee é\r\n".encode() + b"\xff bad\n" + b"a long line of more than a part\nend")
    add("d2.jsonl", b"x" * 100 + b"\ny\n")
    assert read() == want() and read() == want()
    for n in range(3, 8):
        add(f"d{n}.jsonl", b"line %d\nhalf" % n)
        if n == 5:
            add("d4.jsonl", b" done\nnext\n")
    assert read() == want()
    offsets = sorted((int(p.name), p.read_text()) for p in (tmp_path / "check" / "offsets").iterdir() if p.name.isdigit())
    assert '"done": "d5.jsonl"' in offsets[-1][1] and "d4.jsonl" not in offsets[-1][1].replace('"done": "d5.jsonl"', "")
    os.truncate(folder / "d7.jsonl", 2)
    with pytest.raises(Exception, match="shorter"):
        read()


def test_on_time_and_late_rows_add_up(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "user_id long, ts timestamp"
    parts = [[(1, 0), (1, 1800), (2, 100), (None, 50)], [(1, 9000), (2, 9500), (2, 10)], [(1, 3000), (1, 9100), (3, None), (2, 9500)]]
    into = None
    for part in parts:
        spark.createDataFrame(part, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        df = spark.readStream.schema(schema).parquet(folder)
        into = sessions.kept(df, str(tmp_path / "kept"))
        sessions.split_late(df, into, delay_us=HOUR, checkpoint=str(tmp_path / "check")).awaitTermination()
    assert into.on_time().count() + into.late().count() == sum(map(len, parts))
    late = {(r["user_id"], None if r["ts"] is None else r["ts"].timestamp()) for r in into.late().collect()}
    assert late == {(1, 3000.0), (3, None)}
    b = {r["batch"]: (r["watermark_us"], r["on_time"], r["late"]) for r in into.batches().collect()}
    assert b == {0: (None, 4, 0), 1: (1800 * 10**6 - HOUR, 3, 0), 2: (9500 * 10**6 - HOUR, 2, 2)}
    got = {(r["user_id"], r["start"].timestamp(), r["n"]) for r in into.sessions("user_id", "1 hour").collect()}
    assert got == {(1, 0.0, 2), (1, 9000.0, 2), (2, 10.0, 2), (2, 9500.0, 2), (None, 50.0, 1)}
    empty = sessions.kept(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "empty"))
    assert empty.on_time().count() == empty.late().count() == empty.sessions("user_id", "1 hour").count() == 0
