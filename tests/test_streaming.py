"""Sessions of a stream split as a batch splits them: any file order, late rows, a restart from the checkpoint."""

import random
from collections import Counter

import pytest

from chronofold.streaming import pieces as P

ROW = "media_id string, start_ms long, end_ms long, quality long"
GAP, LEAST, MOST = 5000, 2000, 20_000


def rows_of(seed, n=240):
    r, out, at = random.Random(seed), [], {m: 1_000_000 for m in "ab"}
    for k in range(n):
        m = r.choice("aab")
        at[m] += r.choice([0, 300, 1500, 3000, 9000])
        out.append((m, at[m], at[m] + r.choice([0, 200, 1500, 4000]), r.randrange(4)))
    return out


def written(spark, path, batches):
    """One file for each batch, in that order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{path}/f{k:03d}.parquet")


def run(spark, path, out, late="40000 days", most_files=1):
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", most_files).parquet(f"{path}/*.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = P.stream_pieces(source, GAP, LEAST, MOST, late).writeStream.format("parquet").option("checkpointLocation", f"{out}/check").option("path", f"{out}/rows").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return Counter(tuple(r) for r in spark.read.schema(P.PIECE).parquet(f"{out}/rows").collect())


def batch(spark, rows, late_ms=None):
    return Counter(tuple(r) for r in P.batch_pieces(spark.createDataFrame(rows, ROW), GAP, LEAST, MOST, late_ms).collect())


END = ("end", 10**9, 10**9, 0)  # a row that moves the watermark past all others


@pytest.mark.parametrize("order", ["in order", "shuffled", "backwards"])
def test_stream_in_any_order_equals_batch(spark, tmp_path, order):
    rows = sorted(rows_of(1), key=lambda r: r[1])
    if order == "shuffled":
        random.Random(2).shuffle(rows)
    if order == "backwards":
        rows.reverse()
    written(spark, f"{tmp_path}/in", [*[rows[i : i + 60] for i in range(0, len(rows), 60)], [END]])
    # the watermark trails by more than all rows span, so none of them is late, and END closes all
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", "200 minutes")
    want = batch(spark, rows)
    assert got == want and sum(want.values()) > 40


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = rows_of(5)
    first, second = [rows[:80], rows[80:120]], [rows[120:], [END]]
    written(spark, f"{tmp_path}/in", first)
    before = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", "200 minutes")
    assert not before
    for k, part in enumerate(second):
        spark.createDataFrame(part, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/g{k}.parquet")
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out", "200 minutes") == batch(spark, rows)


def test_late_rows_change_nothing_that_is_closed(spark, tmp_path):
    early = [("a", k * 1000, k * 1000 + 500, 1) for k in range(30)]
    later = [("a", 500_000 + k * 1000, 500_000 + k * 1000 + 500, 1) for k in range(3)]
    late = [("a", 31_000, 33_000, 3)]  # would have joined the first session
    tick = [("b", 600_000, 600_000, 0)]  # by then the first session is out
    written(spark, f"{tmp_path}/in", [early, later, tick, late, [END]])
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out", "10 seconds") == batch(spark, early + later + tick)


def test_open_sessions_wait(spark, tmp_path):
    rows = rows_of(8)
    written(spark, f"{tmp_path}/in", [sorted(rows, key=lambda r: r[1])])
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", "30 seconds")
    assert got == batch(spark, rows, 30_000) and got != batch(spark, rows)


def test_plain_split_equals_the_column(spark):
    r = random.Random(3)
    rows = [("m", a, a + r.randrange(0, 3000), r.randrange(5)) for a in sorted(r.randrange(0, 900_000) for _ in range(400))]
    want = Counter(("m", a, x, y) for a, b, c in P.sessions_of([x[1:] for x in rows], GAP) for at in [P.borders(a, b, c, LEAST, MOST)] for x, y in zip(at, at[1:]))
    assert batch(spark, rows) == want
