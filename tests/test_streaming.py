import datetime as dt
import json

from enthyme.streaming import ledger

T = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


def run(df, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(f"out{abs(hash(str(tmp_path)))}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(q.name).collect()


def test_windows_and_bursts(spark, tmp_path):
    rows = [(T + dt.timedelta(seconds=s), "f") for s in (0, 1, 2, 100, 4000)]
    at = "at timestamp, file string"
    got = run(ledger.windowed(stream(spark, tmp_path / "a", rows, at), "at", "file", "1 hour", "0 seconds"), "append", tmp_path / "a")
    assert [(r.start, r.n) for r in got] == [(T, 4)]  # the last window is still open
    got = run(ledger.bursts(stream(spark, tmp_path / "b", rows, at), "at", "file", "10 seconds", "0 seconds"), "append", tmp_path / "b")
    assert sorted(r.n for r in got) == [1, 3]


def test_ledger_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [{"at": "2024-01-01T00:00:00", "file": "m", "sha": s, "faults": 1, "checks": {"parse": 1}} for s in ("x", "x", "y")]
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert sorted(r.sha for r in run(ledger.once(ledger.runs(spark, f"{tmp_path}/log")), "append", tmp_path)) == ["x", "y"]


def test_decisions_keep_the_latest(spark, tmp_path):
    write = ledger.keep_latest(f"{tmp_path}/kept", "id", "at")
    batch = lambda *r: spark.createDataFrame(list(r), "id string, at int, choice string")
    write(batch(("a", 1, "x"), ("b", 1, "y")), 0)
    write(batch(("a", 2, "z"), ("a", 0, "old")), 1)
    write(batch(("a", 2, "z"), ("a", 0, "old")), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/kept/epoch=1").collect())) == [("a", 2, "z"), ("b", 1, "y")]


def test_fold_state(spark, tmp_path):
    rows = [("s", "collapseAll", None), ("s", "toggle", "g"), ("s", "toggle", "h"), ("s", "toggle", "g"), ("t", "depth", "2")]
    got = run(ledger.folded(stream(spark, tmp_path, rows, "session string, action string, target string").coalesce(1)), "update", tmp_path)
    assert {(r.session, tuple(r.collapsed), r.depth) for r in got} == {("s", ("h",), 0), ("t", (), 2)}
