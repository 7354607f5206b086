"""Core queries against SQL on the smallest tables, and fixed small cases of intervals, captions and formats."""

import pytest
from compare import difference
from pyspark.sql import functions as F

from chronofold.functions import text as T
from chronofold.operators import captions as C
from chronofold.operators import intervals as I
from chronofold.plans import catalog
from chronofold.sources import formats
from chronofold.streaming.sessions import sessions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert not difference(catalog.QUERIES[name](spark, SF), catalog.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pair(*ranges):
    items = [F.struct(F.lit(a).cast("long").alias("start_ms"), F.lit(b).cast("long").alias("end_ms")) for a, b in ranges]
    return F.array(*items) if items else F.array().cast(I.PAIR)


L = lambda x: F.lit(x).cast("long")


@pytest.mark.parametrize(
    "cuts,pad,kept",
    [(((10_000, 14_000),), 500, [(0, 10_500), (13_500, 30_000)]), (((10_000, 10_400),), 500, [(0, 30_000)]), ((), 500, [(0, 30_000)]), (((0, 30_000),), 0, [(0, 30_000)])],
)
def test_keep_ranges(spark, cuts, pad, kept):
    assert [tuple(r) for r in one(spark, I.keep_ranges(L(0), L(30_000), pair(*cuts), pad))] == kept


@pytest.mark.parametrize("t,at", [(27_000, 12_000), (22_000, 10_000), (5_000, 0), (40_000, None)])
def test_remap(spark, t, at):
    assert one(spark, I.remap(L(t), pair((10_000, 20_000), (25_000, 30_000)))) == at


def words(*w):
    return F.array(*map(F.lit, w))


def test_captions(spark):
    assert all(len(" ".join(c)) <= 40 for c in one(spark, C.greedy_chunks(words(*["palavra"] * 30), 40)))
    assert one(spark, C.two_lines(words(*["palavra"] * 10))).count("\n") == 1
    assert one(spark, C.push_dangling(C.greedy_chunks(words("um", "carro", "de", "luxo"), 11))) == [["um", "carro"], ["de", "luxo"]]
    cue = lambda a, b, t: F.struct(L(a).alias("start_ms"), L(b).alias("end_ms"), F.lit(t).alias("text"))
    assert [tuple(w) for w in one(spark, C.merge_short(F.array(cue(0, 100, "é"), cue(100, 200, "que"), cue(200, 800, "sim"))))] == [(0, 800, "é que sim")]
    assert [w.text for w in one(spark, C.merge_short(F.array(cue(0, 500, "uma"), cue(500, 1000, "frase"), cue(1000, 1100, "fim"))))] == ["uma", "frase fim"]


def test_text(spark):
    assert one(spark, T.srt_time(L(3_661_500))) == "01:01:01,500" and one(spark, T.srt_time(L(-1))) == "00:00:00,000"
    assert one(spark, T.file_title(F.lit('a: b? c/d "e"'))) == "a b c d e" and one(spark, T.file_title(F.lit("Olha onde estou."))) == "Olha onde estou"
    assert one(spark, T.clip_score(F.lit(""), L(20_000))) == 0
    hooked, neutral = (one(spark, T.clip_score(F.lit(t), L(20_000))) for t in ("o segredo da vida e a verdade", "uma fala de teste com palavras"))
    assert hooked > neutral
    mib = 1 << 20
    assert [len(one(spark, T.byte_ranges(L(n * mib)))) for n in (3, 64, 200)] == [1, 1, 3] and one(spark, T.byte_ranges(L(0))) is None


def test_silence_log(spark):
    def read(*lines):
        rows = [("m", i, t, 100_000) for i, t in enumerate(lines)]
        return [(r.start_ms, r.end_ms) for r in formats.parse_silence_log(spark.createDataFrame(rows, "media_id string, line_no long, line string, total_ms long")).orderBy("start_ms").collect()]

    assert read("silence_start: 10.0", "silence_end: 13.5", "silence_start: 50.0", "silence_end: 52.4") == [(10_000, 13_500), (50_000, 52_400)]
    assert read("silence_start: 90.0") == [(90_000, 100_000)] and read("nada aqui") == []


def test_stream_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = sessions(stream, late="40000 days").writeStream.format("memory").queryName("islands").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("islands").collect())) == sorted(map(tuple, sessions(events).collect()))
