"""Streaming operators on files, run to the end of what is there."""

import datetime as dt

from tickloom.streaming import flow


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 3, 1)
    m = dt.timedelta(minutes=1)
    rows = [(1, t, 1.0), (1, t + 2 * m, 2.0), (1, t + 30 * m, 4.0), (2, t, 8.0), (1, t, 1.0)]
    last = [(9, t + dt.timedelta(days=9), 0.0), (9, t + dt.timedelta(days=9), 0.0)]
    for i, part in enumerate((rows, last)):
        spark.createDataFrame(part, "k int, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    folder = str(tmp_path / "in/*")

    def stream():
        return flow.table_stream(spark, folder, "k int, ts timestamp, v double", 1)

    assert sorted((r.k, r.v) for r in run(spark, flow.without_repeats(stream(), ["k", "ts"], "ts"), "once")) == [(1, 1.0), (1, 2.0), (1, 4.0), (2, 8.0), (9, 0.0)]
    got = sorted((r.k, r.n, r.total) for r in run(spark, flow.gap_sessions(stream(), ["k"], "ts", "10 minutes", "v"), "gaps"))
    assert got[:3] == [(1, 1, 4.0), (1, 3, 4.0), (2, 1, 8.0)]
    got = {(r.k, r.period.day): r.n for r in run(spark, flow.period_counts(stream(), ["k"], "ts"), "per", "complete")}
    assert got == {(1, 1): 4, (2, 1): 1, (9, 10): 2}
