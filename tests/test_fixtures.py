"""Small fixed cases of editorial steps, readers, views, layout, speakers and settings, and a medium that holds half of all rows."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from chronofold.config import PanelConfig, RunConfig
from chronofold.functions import layout as L
from chronofold.functions import text as T
from chronofold.operators import captions as C
from chronofold.operators import editorial as E
from chronofold.operators import intervals as I
from chronofold.operators import segment as S
from chronofold.operators import speakers as V
from chronofold.operators import vectors
from chronofold.operators import views as P
from chronofold.sinks import documents as D
from chronofold.sources import formats

UTTERANCE = "media_id string, seq long, start_ms long, end_ms long, text string, speaker string"
CLIP = "media_id string, clip_id string, clip_index int, start_ms long, end_ms long, text string, score double, cuts array<struct<start_ms:bigint,end_ms:bigint>>, pad_ms long"
PLAN = "media_id string, clip_id string, set_start long, set_end long, remove boolean, absorb array<string>, lead_ms long, tail_ms long, snap boolean, fingerprint string"


def said(spark, *spans):
    return spark.createDataFrame([("m", k, a, b, t, s) for k, (a, b, t, s) in enumerate(spans)], UTTERANCE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def docs(spark, *payloads):
    return spark.createDataFrame([(f"m{k}", json.dumps(p) if not isinstance(p, str) else p) for k, p in enumerate(payloads)], "media_id string, json string")


@pytest.fixture(scope="module")
def talk(spark):
    u = said(spark, *[(k * 5000, k * 5000 + 5000, f"fala de teste numero {k} com palavras", "S1") for k in range(20)])
    silences = spark.createDataFrame([("m", 10_000, 13_000), ("m", 50_000, 53_000)], "media_id string, start_ms long, end_ms long")
    return u, silences, spark.createDataFrame([("m", 100_000)], "media_id string, total_ms long")


def test_clips_of_a_talk(spark, talk):
    got = S.build_clips(*talk).orderBy("clip_index").collect()
    assert [(r.clip_index, r.start_ms) for r in got] == [(1, 0), (2, 13_000), (3, 53_000)]
    assert S.build_clips(*talk, most_clips=2).count() == 2 and S.build_clips(talk[0].limit(0), *talk[1:]).count() == 0
    pieces = S.split_windows(I.complement(S.boundaries(talk[1], talk[2]), talk[2]), S.cut_points(talk[0], talk[1]), most=20_000).collect()
    assert all(r.end_ms - r.start_ms <= 20_000 for r in pieces) and sum(r.end_ms - r.start_ms for r in pieces) == 94_000


def test_an_utterance_without_span_is_in_no_window(spark):
    w = spark.createDataFrame([("m", 1, 0, 10_000)], "media_id string, clip int, w_start long, w_end long")
    assert S.window_text(w, said(spark, (0, 4000, "a", "S"), (5000, 5000, "none", "S"))).first().text == "a"


def test_half_of_all_rows_in_one_medium_is_spread(spark):
    """A hot medium's join meets the same pairs as a plain one, and no bin holds more than a few windows."""
    w = spark.range(400).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("media_id"), F.col("id").alias("clip"), (F.col("id") * 7000).alias("w_start"), (F.col("id") * 7000 + 65_000).alias("w_end"))
    p = spark.range(600).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("media_id"), (F.col("id") * 3000).alias("start_ms"), (F.col("id") * 3000 + 2500).alias("end_ms"))
    got = {(r.media_id, r.clip, r.start_ms, r.end_ms) for r in I.clip_join(w, p, 500).collect()}
    plain = w.join(p, "media_id").where("start_ms < w_end and end_ms > w_start").select("media_id", "clip", F.greatest("start_ms", "w_start").alias("a"), F.least("end_ms", "w_end").alias("b")).where("b - a >= 500").collect()
    assert got == {tuple(r) for r in plain} and len(got) == len(plain) > 1000
    assert I.in_bins(w, "w_start", "w_end", 60_000, "bin").groupBy("media_id", "bin").count().agg(F.max("count")).first()[0] < 25


def test_adjusting_then_keeping_one_speaker(spark):
    u = said(spark, (0, 15_000, "a", "S1"), (15_000, 25_000, "b", "S2"), (25_000, 40_000, "c", "S1"))
    none = spark.createDataFrame([], "media_id string, start_ms long, end_ms long")
    clips = spark.createDataFrame([("m", "clip_001", 1, 0, 10_000, "a", 1.0, [], 150)], CLIP)
    plan = spark.createDataFrame([("m", "clip_001", 0, 40_000, False, [], 5000, 3000, False, "")], PLAN)
    longer = E.apply_adjustments(clips, plan, u, none)
    assert [(r.start_ms, r.end_ms, r.text, r.clip_index) for r in longer.collect()] == [(0, 40_000, "a b c", 1)]
    right = E.apply_persona(longer, u, "S1").first()
    assert [tuple(c) for c in right.cuts] == [(14_900, 25_100)] and right.pad_ms == 0
    wrong = E.apply_adjustments(E.apply_persona(clips, u, "S1"), plan, u, none).first()
    assert wrong.cuts == []
    with pytest.raises(ValueError, match="does not speak"):
        E.apply_persona(clips, u, "S9")
    with pytest.raises(ValueError, match="not there"):
        E.apply_adjustments(clips, plan.withColumn("clip_id", F.lit("clip_009")), u, none)
    with pytest.raises(ValueError, match="other clips"):
        E.apply_adjustments(clips, plan.withColumn("fingerprint", F.lit("0" * 16)), u, none)


def test_windows_snap_and_absorb(spark):
    u = said(spark, (0, 10_000, "a", "S"), (10_000, 20_000, "b", "S"), (20_000, 41_000, "c", "S"))
    rows = [("m", "on", 11_000, 39_000, None, None, None, 0, 0, True), ("m", "off", 11_000, 39_000, 11_000, 39_000, None, 5000, 3000, False), ("m", "low", 0, 0, -5000, -3000, None, 5000, 3000, False), ("m", "reach", 11_000, 12_000, None, None, 30_000, 5000, 3000, False)]
    asked = spark.createDataFrame(rows, "media_id string, id string, cur_start long, cur_end long, set_start long, set_end long, reach long, lead_ms long, tail_ms long, snap boolean")
    got = {r.id: (r.start_ms, r.end_ms) for r in E.resolve_windows(asked, u).collect()}
    assert got == {"on": (10_000, 41_000), "off": (11_000, 39_000), "low": (0, 1000), "reach": (6000, 30_000)}


def test_persona_spans_and_report(spark):
    u = said(spark, (0, 10_000, "", "S1"), (10_000, 16_000, "", "S2"), (16_000, 30_000, "", "S1"))
    w = spark.createDataFrame([("m", 1, 0, 30_000), ("m", 2, 90_000, 99_000)], "media_id string, clip int, w_start long, w_end long")
    assert sorted((r.start_ms, r.end_ms) for r in E.keep_spans(w, u, "S1").collect()) == [(0, 9900), (16_100, 30_000)]
    assert {(r.clip, r.persona_s, r.outros_s, r.outros_pct, r.status) for r in E.persona_report(w, u, "S1").collect()} == {(1, 24.0, 6.0, 20, "contaminado"), (2, 0.0, 0.0, 0, "limpo")}
    cuts = one(spark, E.cuts_between(F.lit(0).cast("long"), F.lit(30_000).cast("long"), F.array().cast(I.PAIR)))
    assert [tuple(c) for c in cuts] == [(0, 30_000)]


def test_selection(spark):
    u = said(spark, (10_000, 20_000, "", ""), (20_000, 40_000, "", ""), (40_000, 60_000, "", ""))
    read = lambda *clips: formats.parse_selection(docs(spark, {"clips": list(clips)}).withColumn("media_id", F.lit("m")))
    got = E.load_selection(read({"start": 11, "end": "39", "title": " x "}), u).first()
    assert (got.start_ms, got.end_ms, got.title, got.pos) == (10_000, 40_000, "x", 1)
    for clip, most, error in (({"start": 0, "end": 9999}, 60_000, "outside"), ({"start": 40, "end": 20}, 60_000, "order"), ({"start": 10, "end": 60}, 30_000, "long"), ({"end": 3}, 60_000, "missing"), ({"start": "a", "end": 3}, 60_000, "missing")):
        with pytest.raises(ValueError, match=error):
            E.load_selection(read(clip), u, most=most)
    with pytest.raises(ValueError, match="at least one"):
        E.load_selection(read(), u)
    pairs = spark.createDataFrame([("m", 10_000, 40_000, ""), ("m", 20_000, 60_000, "b"), ("m", 60_000, 70_000, "c")], "media_id string, start_ms long, end_ms long, title string")
    assert [tuple(r) for r in E.overlapping_neighbours(pairs).collect()] == [("m", "10s", "b")]


def test_readers(spark):
    server = docs(spark, {"segments": [{"text": " a ", "start": 1, "end": 2}, {"text": "b", "start": 3}, {"text": " "}]}, {"transcription": [{"text": "c", "offsets": {"from": 500, "to": 1500}}, {"text": "d", "offsets": {"from": 9}}]}, "no json")
    assert {(r.media_id, r.start, r.end, r.text) for r in formats.parse_server_segments(server).collect()} == {("m0", 1.0, 2.0, "a"), ("m1", 0.5, 1.5, "c")}
    seg = formats.parse_segments(docs(spark, {"segments": [{"start": 2, "end": 1, "text": " x ", "words": [{"start": 0, "end": 1, "word": " w "}, {"start": 1, "end": 1, "word": "z"}, {"start": 1, "end": 2, "word": " "}]}, {"text": ""}]}))
    assert [(r.text, [tuple(w) for w in r.words]) for r in seg.collect()] == [("x", [(0.0, 1.0, "w")])]
    a, b = (spark.createDataFrame([(m, n) for m in ms], "media_id string, text string") for ms, n in ((["m1"], "a"), (["m1", "m2"], "b")))
    assert {tuple(r) for r in formats.first_engine({"slow": b, "fast": a}, ("fast", "other", "slow")).collect()} == {("m1", "a", "fast"), ("m2", "b", "slow")}
    cache = {"cache_version": 1, "language": "pt", "model": "m", "utterances": [{"start": 0, "end": 1, "text": "a"}, {"start": 1, "end": 2, "text": " "}]}
    cached = docs(spark, cache, cache | {"cache_version": 3}, cache | {"model": "x"}, cache | {"cache_version": 2, "utterances": [{"start": 0, "end": 1, "text": "b", "words": [{"start": 0, "end": 1, "text": "b"}]}]})
    assert {r.media_id for r in formats.parse_transcripts(cached, "pt", "m").collect()} == {"m0", "m3"}
    assert {r.media_id for r in formats.parse_transcripts(cached, "pt", "m", words=True).collect()} == {"m3"}
    turns = docs(spark, {"turns": [{"start": 0, "end": 2, "speaker": "S1"}, {"start": 3, "end": 3, "speaker": "S2"}]}, {"turns": []})
    assert [r.speaker for r in formats.parse_speakers(turns).collect()] == ["S1"]
    with pytest.raises(ValueError, match="no turns in m1"):
        formats.read_strictly(turns, formats.parse_speakers(turns), "turns")
    plan = formats.parse_adjustments(docs(spark, {"clips": {"c1": {"start": "01:30", "end": 95.5}, "c2": {"start": "1:2:3", "remove": True, "absorb": ["c3"]}, "c3": {"end": "x"}}, "snap": False, "context_lead_s": 1.5}))
    got = {r.clip_id: r for r in plan.collect()}
    assert (got["c1"].set_start, got["c1"].set_end, got["c1"].lead_ms, got["c1"].tail_ms, got["c1"].snap, got["c1"].error) == (90_000, 95_500, 1500, 3000, False, None)
    assert (got["c2"].set_start, got["c2"].remove, got["c2"].absorb, got["c3"].error) == (3_723_000, True, ["c3"], "bad time")


def test_documents_and_projects(spark, tmp_path):
    for name, clips in (("a", [{"id": "c", "final_duration": "90.0s"}, {"id": "d", "final_duration": "lixo"}]), ("b", []), ("x/y/z/p/q/r/far", [{"id": "c", "final_duration": "1.0s"}])):
        (tmp_path / "root" / name).mkdir(parents=True)
        (tmp_path / "root" / name / "metadata.json").write_text(json.dumps({"clips": clips}))
        (tmp_path / "root" / name / "video.mp4").write_bytes(b"x" * (10 + len(name)))
    found = formats.find_projects(spark, f"{tmp_path}/root").collect()
    assert [(r.name, r.clips, r.minutes) for r in found] == [("a", 2, 1.5)]
    videos = formats.find_files(spark, f"{tmp_path}/root", (".mp4",), least_bytes=11, most=2, skip=("/x/",)).collect()
    assert len(videos) == 2 and all(r.bytes == 11 for r in videos)
    df, root = spark.createDataFrame([(1, "a")], "k int, v string"), f"{tmp_path}/state"
    first = D.write_version(df, root, dt.datetime(2026, 1, 1))
    D.write_version(df.withColumn("v", F.lit("b")), root, dt.datetime(2026, 1, 2))
    assert D.read_version(spark, root).first().v == "b" and D.read_version(spark, root, first.split("=")[1]).first().v == "a"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        D.write_version(df, root, dt.datetime(2026, 1, 1))
    clips = spark.createDataFrame([("m", 0, "c1", False, "2.5s", "lixo"), ("m", 1, "c2", True, "lixo", "61.0s"), ("n", 0, "c1", False, "1.0s", "5.0s")], "media_id string, pos int, id string, rendered boolean, silence_removed string, final_duration string")
    clips = clips.withColumns({c: F.lit("</script>") for c in ("start", "end", "transcription")}).withColumns({c: F.lit(1.0) for c in ("start_seconds", "importance_score")})
    titles = spark.createDataFrame([("m", "c2", "t", None, ["x"], True)], "media_id string, clip_id string, titulo string, descricao string, tags array<string>, estrela boolean")
    rows = D.report_rows(clips, titles)
    assert {(r.media_id, r.id, r.titulo, r.descricao) for r in rows.collect()} == {("m", "c2", "t", ""), ("n", "c1", "", "")}
    assert {tuple(r) for r in D.report_totals(rows).collect()} == {("m", 1, 1, 0), ("n", 1, 0, 1)}
    for r in D.report_payloads(rows).collect():
        assert "<" not in r.payload and json.loads(r.payload)[0]["text"] == "</script>"


def test_batches(spark):
    q = spark.createDataFrame([("q", 1, "pendente", False), ("q", 2, "pendente", True), ("q", 3, "publicado", False), ("q", 4, "pendente", False), ("q", 5, "pendente", False)], "by string, pos int, status string, estrela boolean")
    q = q.withColumns({c: F.lit(None).cast("string") for c in ("publish_at", "published_at", "video_id", "erro", "tiktok_status")})
    assert [(r.pos, r.turn) for r in P.prioritized(q, "by").orderBy("turn").collect()] == [(2, 1), (1, 2), (4, 3), (5, 4)]
    out = spark.createDataFrame([("q", 2, "ok", "v2"), ("q", 1, "missing", "no file"), ("q", 4, "quota", "q"), ("q", 5, "ok", "v5")], "by string, pos int, result string, detail string")
    state = lambda df, *c: {r.pos: tuple(r[x] for x in c) for r in df.collect()}
    direct = state(P.publish_batch(q, out, "by", 9, "now"), "status", "publish_at", "published_at", "erro")
    assert direct == {2: ("publicado", None, "now", None), 1: ("erro", None, None, "no file"), 3: ("publicado", None, None, None), 4: ("pendente", None, None, None), 5: ("pendente", None, None, None)}
    times = P.schedule(spark, 4, "2026-09-06 10:00:00")
    planned = state(P.publish_batch(q, out, "by", 1, "now", times), "status", "publish_at", "published_at")
    assert planned[2] == ("agendado", "2026-09-06T16:00:00Z", None) and planned[1][0] == "pendente"
    second = state(P.publish_batch(q, out, "by", 9, "now", second=True), "status", "tiktok_status", "tiktok_erro")
    assert second[2] == ("pendente", "publicado", None) and second[1] == ("pendente", None, None) and second[5] == ("pendente", None, None)
    for hour in range(10):
        at = [r.publish_at for r in P.schedule(spark, 8, f"2026-09-06 {hour:02d}:30:00").collect()]
        assert at == sorted(at) and len(set(at)) == 8 and at[0] > f"2026-09-06T{hour + 3:02d}:30:00Z" and len({(dt.datetime.fromisoformat(x) - dt.timedelta(hours=3)).date() for x in at}) <= 3
    assert one(spark, P.privacy(F.array(F.lit("X"), F.lit("SELF_ONLY")), "PUBLIC")) == "SELF_ONLY" and one(spark, P.privacy(F.array().cast("array<string>"), "PUBLIC")) is None


def test_layout(spark):
    wrapped = lambda t, n: one(spark, F.transform(L.wrap(F.split(F.lit(t), " "), n, lambda x: F.length(x) * 10), lambda l: F.array_join(l, " ")))
    assert len(wrapped("um dois tres quatro", 140)[-1].split()) > 1
    lines = lambda *ls: F.array(*[F.array(*map(F.lit, x)) for x in ls])
    pull = lambda x, n: one(spark, L.pull_back(x, n, lambda t: F.length(t) * 10))
    assert pull(lines("abc", "d"), 60) == [["a", "b"], ["c", "d"]] and pull(lines("ab", "c"), 60) == [["a", "b"], ["c"]] and pull(lines(["a", "b", "longer"], "c"), 60) == [["a", "b", "longer"], ["c"]]
    assert [one(spark, L.hold_seconds(F.lit(s * 1000))) for s in (20, 30, 45, 85)] == [5, 5, 20, 20]
    z = lambda t: one(spark, L.zoom(F.lit(float(t))))
    assert z(0) == 1 and z(2) == pytest.approx(1.06) and z(4) == z(13.9) == pytest.approx(1.12) and z(16) == pytest.approx(1.06) and z(20) == z(28) == 1 and z(1) == pytest.approx(1 + 0.06 * (1 - math.cos(math.pi / 4)))
    assert one(spark, L.output_folder(F.lit("/a/b c/my film.v2.mp4"))) == "/a/b c/CORTES_my_film.v2"
    assert [one(spark, L.is_slot(F.lit(x))) for x in ("06:00", "6h", "1:2:3", "99:99")] == [True, False, False, True]
    mib = 1 << 20
    assert [one(spark, T.byte_error(F.lit(n * mib).cast("long"))) for n in (0, 3, 200, 64 * 1001 + 1, 64 * 1000)] == ["empty", None, None, "too many parts", None]
    assert one(spark, T.publish_name(F.lit("clip_1024"), F.lit("a/b"))) == "1024 - a b.mp4"


def test_word_windows_and_groups(spark):
    cue = lambda a, b, t="w": F.struct(F.lit(a).cast("long").alias("start_ms"), F.lit(b).cast("long").alias("end_ms"), F.lit(t).alias("text"))
    at = lambda *w: [tuple(x) for x in one(spark, C.word_windows(F.array(*w) if w else F.array().cast(C.WORDS), F.lit(0).cast("long"), F.lit(9000).cast("long")))]
    assert at() == [(0, 9000)] and at(cue(0, 300)) == [(0, 9000)]
    assert at(cue(100, 1400), cue(1600, 2000)) == [(100, 1400), (1400, 2000)] and at(cue(100, 1400), cue(1600, 1700)) == [(100, 1700)]
    groups = one(spark, C.group_words(F.array(*[cue(k, k + 1, t) for k, t in enumerate(["a", "b,", "c", "d."])]), 4))
    assert [[w.text for w in g] for g in groups] == [["a", "b,"], ["c", "d."]]


def test_speakers_from_voices(spark):
    rows, truth = [], {}
    for m in ("m", "n"):
        for k in range(40):
            s = (k // 5) % 2 if m == "m" else int(k % 3 == 0)
            truth[m, k] = s
            rows.append((m, k, k * 1000, k * 1000 + (300 if k % 10 == 7 else 900), "t", [1.0 - s + 0.01 * (k % 3), s + 0.01 * (k % 4), 0.1]))
    df = spark.createDataFrame(rows, "media_id string, seq long, start_ms long, end_ms long, text string, embedding array<double>")
    u = df.drop("embedding")
    got = {(r.media_id, r.seq): r.speaker for r in V.diarize(u, df.select("media_id", "seq", "embedding"), 2).collect()}
    for m in ("m", "n"):
        name = {truth[m, 0]: "S1", 1 - truth[m, 0]: "S2"}
        assert all(got[m, k] == name[truth[m, k]] for k in range(40) if k % 10 != 7)
        assert all(got[m, k] in ("S1", "S2") for k in range(40))
    few = V.diarize(u.where("seq < 3"), df.select("media_id", "seq", "embedding"), 2).collect()
    assert {r.speaker for r in few} == {None}
    shares = V.cluster_shares(spark.createDataFrame([("m", k, int(k == 0)) for k in range(40)], "media_id string, seq long, cluster int")).first()
    assert shares.smallest == pytest.approx(0.025) and shares.doubtful


def test_turns_refine_at_changes(spark):
    word = lambda a, b: {"start_ms": a, "end_ms": b, "text": "w"}
    u = spark.createDataFrame([("m", 0, 0, 1000, "S1", []), ("m", 1, 1000, 4000, "S1", [word(1000, 2500), word(2500, 4000)]), ("m", 2, 4000, 5000, "S2", []), ("m", 3, 5000, 6000, "S2", [])], "media_id string, seq long, start_ms long, end_ms long, speaker string, timed " + C.WORDS)
    centroids = spark.createDataFrame([("m", "S1", [1.0, 0.0]), ("m", "S2", [0.0, 1.0])], "media_id string, label string, centroid array<double>")
    voices = spark.createDataFrame([("m", 1, 0, [2.0, 0.1]), ("m", 1, 1, [0.1, 3.0]), ("m", 2, 0, [0.0, 1.0])], "media_id string, seq long, pos int, embedding array<double>")
    got = V.refine(u, voices, centroids).orderBy("start_ms").collect()
    assert [(r.speaker, r.start_ms, r.end_ms) for r in got] == [("S1", 0, 2500), ("S2", 2500, 6000)]
    turns = said(spark, (0, 1000, "", "A"), (1100, 2000, "", "B"), (2100, 3000, "", "A"), (3200, 4000, "", "A"))
    assert sorted((r.speaker, r.start_ms, r.end_ms) for r in I.merge_turns(turns, 250).collect()) == [("A", 0, 1000), ("A", 2100, 4000), ("B", 1100, 2000)]


def test_centroids_in_blocks(spark):
    c = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(30)], "label int, centroid array<double>")
    v = spark.createDataFrame([(k, [math.cos(k * 0.37), math.sin(k * 0.37)]) for k in range(50)], "k int, v array<double>")
    rows = lambda most: sorted(tuple(r) for r in vectors.assign(v, "k", "v", c, "label", most).collect())
    assert rows(10_000) == rows(7)


def test_settings():
    assert RunConfig("a/b.MP4").checked().most_clips == 60
    for bad in ({"source": "x.txt"}, {"least_clip_s": 0}, {"most_clip_s": 1}, {"split_silence_s": 0}, {"silence_db": 0}, {"most_clips": 0}, {"short_side": -2}, {"short_side": 3}, {"zoom": 0.4}, {"zoom_transition_s": 0}, {"zoom_hold_s": -1}, {"persona": "S1"}, {"jobs": -1}):
        with pytest.raises(ValueError):
            RunConfig(**({"source": "x.mp4"} | bad)).checked()
    assert PanelConfig.of({"zoom_amplitude": 0.2, "unknown": 1}).zoom_amplitude == 0.2 and PanelConfig().issues() == []
    assert len(PanelConfig.of({"subtitle_style": "x", "zoom_hold_s": -1, "schedule_slots": ["6h", "1:1"]}).issues()) == 3


def test_minutes_do_not_depend_on_the_order_of_a_sum(spark):
    """Tenths that add up to halves of a minute, whose floating sums fall short or go over in one order or another."""
    for tenths, up, even in (([1] * 900, 2, 2), ([1] * 300, 1, 0), ([7] * 1500, 18, 18), ([3, 297, 299, 1] + [3] * 100, 2, 2), ([1] * 899, 1, 1)):
        for order in (tenths, tenths[::-1], sorted(tenths)):
            texts = [(i, f"{t // 10}.{t % 10}s") for i, t in enumerate(order)]
            df = spark.createDataFrame(texts, "pos long, duracao string").coalesce(1).select(F.lit("m").alias("media_id"), "pos", "duracao", F.col("duracao").alias("duration"), F.lit("0.1s").alias("removed"), F.lit("").alias("upload_status"))
            assert [r.minutes for r in P.kpis(df).collect()] == [up], (len(tenths), "up")
            assert [r.minutes for r in D.report_totals(df).collect()] == [even], (len(tenths), "even")
    half = spark.range(5).select(F.lit("m").alias("media_id"), F.lit("0s").alias("duration"), F.lit("0.1s").alias("removed"))
    assert D.report_totals(half).first().removed_s == 0
    assert D.report_totals(half.unionAll(half).unionAll(half)).first().removed_s == 2
