import pytest

from longleaf import catalog

KIND = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string"


def rows(spark):
    kinds = ["signup", "purchase", "error", "purchase", "click"]
    events = [(i, i % 7, kinds[i // 7 % 5], None, 1.0, None) for i in range(400)] + [(None, 1, "error", None, 1.0, None), (900, None, "error", None, 1.0, None)]
    return spark.createDataFrame(events, KIND).repartition(4, "event_id")


def got(spark, d, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(d)).collect()))


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_run_state_of_both_layouts(spark, tmp_path, layout):
    at = str(tmp_path / "events.parquet")
    if layout == "folder":
        rows(spark).write.parquet(at)
    else:
        rows(spark).toPandas().to_parquet(at, index=False, coerce_timestamps="us")
    states = got(spark, tmp_path, "stream_run_state")
    assert len(states) == 7 and [x[:1] + x[2:] for x in states] == got(spark, tmp_path, "run_state_final")


def test_run_state_of_no_events(spark, tmp_path):
    rows(spark).filter("false").write.parquet(str(tmp_path / "events.parquet"))
    assert got(spark, tmp_path, "stream_run_state") == []


def test_late_events_belong_to_an_older_run(spark, tmp_path):
    import time

    at = tmp_path / "events.parquet"
    at.mkdir()
    batches = [[(10, 1, "signup"), (11, 1, "purchase")], [(5, 1, "signup"), (6, 1, "purchase"), (12, 1, "error")], [(13, 1, "signup"), (14, 1, "purchase"), (7, 1, "error")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(*e, None, 1.0, None) for e in batch], KIND).toPandas().to_parquet(at / f"part-{k}.parquet", index=False, coerce_timestamps="us")
        time.sleep(1.1)  # files come in the order of their times
    from longleaf.streaming.run_state import run_state

    assert [tuple(r) for r in run_state(spark, str(tmp_path), files_at_once=1).collect()] == [(1, 1, 1, 0, 14)]


def test_rates_by_cases():
    from longleaf.streaming.control import Rate, Size, rank95

    for outcome, want in (("rate_limited", 4), ("timeout", 6), ("server_error", 6), ("ok", 8)):
        assert Rate(8, 4, 1000).observe(outcome, 100, 0) == want
    r = Rate(4, 4, 1000)
    assert [r.observe("ok", x, t * 3000) for t, x in enumerate([2000] * 4 + [100] * 4)] == [4] * 7 + [5]
    r = Rate(8, 4, 1000)
    assert [r.observe("rate_limited", 1, t) for t in (0, 100, 250)] == [4, 4, 2] and [r.observe("timeout", 1, t) for t in (300, 1000)] == [1, 1]
    assert rank95(list(range(1, 101))) == 95 and rank95([]) is None
    s = Size("plain", 10_000, 32, window=3, target=100)
    for t in range(3):
        s.success(10, t)
    assert (s.tokens, s.items) == (11_000, 48) and not s.grows(100) and s.grows(5000)
    assert s.decrease(0.5, 0.5, 6000) and (s.tokens, s.items) == (5500, 24) and not s.decrease(0.5, 0.5, 6001) and s.decrease(0.1, 0.1, 9000) and (s.tokens, s.items) == (4000, 16)
    s.success(1000, 20_000)
    assert s.tokens == 4000 and Size("run_preserving", 50_000, 999).tokens == 8000


def test_rates_of_a_stream_are_those_of_a_table(spark, tmp_path):
    import random
    import time

    from longleaf.streaming.control import rate_states, rates

    rnd, kind = random.Random(5), "job long, event_id long, outcome string, latency long, at long"
    events = [(rnd.randint(0, 5), i, rnd.choice(["ok"] * 6 + ["rate_limited", "timeout", "invalid_json"]), rnd.randint(1, 90), i * 700) for i in range(600)]
    for k in range(3):
        spark.createDataFrame(events[k * 200 : k * 200 + 200], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(1.1)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out: dict = {}
    sink = lambda f, _: out.update({r.job: (r.event_id, r.at_once) for r in f.collect()})
    rate_states(stream, 8, 4, 60).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    want: dict = {}
    for r in rates(spark.createDataFrame(events, kind), 8, 4, 60).collect():
        want[r.job] = max(want.get(r.job, (-1, 0)), (r.event_id, r.at_once))
    assert out == want and len({n for _, n in want.values()}) > 1
