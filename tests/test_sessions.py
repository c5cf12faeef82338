import random

import pandas as pd
from pyspark.sql import functions as F

from tarn.operators import resample
from tarn.streaming import sessions as S

GAP = 1000


def plain(rows, gap):
    out = []
    for u in {r[0] for r in rows}:
        own = sorted((int(t), v) for w, t, v in rows if w == u)
        run = []
        for t, v in own:
            if run and t - run[-1][0] > gap:
                out.append((u, run[0][0], run[-1][0], len(run), sum(x for _, x in run)))
                run = []
            run.append((t, v))
        out.append((u, run[0][0], run[-1][0], len(run), sum(x for _, x in run)))
    return out


def test_intervals_join_in_any_order():
    rng = random.Random(1)
    times = [rng.randrange(20_000) for _ in range(60)]
    held = []
    for t in times:
        held = S.joined([*held, (t, t, 1, 1.0)], GAP)
    assert sorted(held) == sorted(s[1:] for s in plain([(0, t, 1.0) for t in times], GAP))
    assert S.joined([(0, 0, 1, 1.0), (3000, 3000, 1, 1.0), (900, 2100, 2, 2.0)], GAP) == [(0, 3000, 4, 4.0)]


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), t, float(t % 7)) for t in range(1_000_000, 1_060_000, 170)]
    rng.shuffle(rows)
    first, second = [r for r in rows if r[1] < 1_030_000], [r for r in rows if r[1] >= 1_030_000]
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "user_id long, ts timestamp, value double"

    def run(part):
        df = spark.createDataFrame(part, "user_id long, ms long, value double").select("user_id", F.timestamp_millis("ms").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        S.write_sessions(S.sessions(stream, GAP), out, check).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(S.OUTPUT).parquet(out).collect())

    over = lambda part, now: sorted(s for s in plain(part, GAP) if s[2] + GAP + 1 < now)
    last = max(t for _, t, _ in first)
    assert run([*first, (None, 1_000_005, 1.0)]) == over(first, last)
    # The second run takes up the sessions that the first left open; a user's last one stays open.
    want = over(rows, max(t for _, t, _ in rows))
    assert run(second) == want and len(want) > len(over(first, last)) + 5
    assert run([(9, 1_060_500, 1.0)]) == over([*rows, (9, 1_060_500, 1.0)], 1_060_500)
    assert run([(9, 1_090_000, 2.0)])[-1][:4] == (9, 1_060_500, 1_060_500, 1)


def test_table_function_draws_the_same_panels(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(2), i) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, stratum int, item long").withColumn("n", (F.length("s") * 3 + F.col("stratum")).cast("long"))
    want = resample.matched_panels(df, "s", "stratum", "item", 4, "x").select("s", "stratum", "draw", "item")
    got = resample.panels_by_table_function(df, 4, "x").select("s", "stratum", "draw", "item")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert resample.panels_by_table_function(df.withColumn("n", F.lit(0).cast("long")), 4, "x").collect() == []


def test_a_user_has_one_timer_however_many_sessions():
    class Handle:
        def __init__(self):
            self.rows, self.timers = [], []

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def registerTimer(self, ms):
            self.timers.append(ms)

    handle, users = Handle(), S.Sessions(GAP)
    users.init(handle)
    list(users.handleInputRows((1,), iter([pd.DataFrame({"ms": [9000, 0, 3000, 6000], "value": 1.0})]), None))
    assert handle.timers == [GAP + 1] and len(handle.rows) == 4
