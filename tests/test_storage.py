"""Published versions under failure and rivals, file readers with malformed files, and settings."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from chronofold.config import PanelConfig, RunConfig
from chronofold.sinks import versions as V
from chronofold.sources import files as X
from chronofold.sources import formats

DAY = dt.datetime(2026, 1, 1)


def test_a_write_that_dies_is_never_read(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    with pytest.raises(ValueError, match="nothing is published"):
        V.read_version(spark, root)
    V.write_version(spark.range(3), root, DAY)
    with monkeypatch.context() as m:  # data is there, the manifest isn't
        m.setattr(V, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            V.write_version(spark.range(99), root, dt.datetime(2026, 1, 2))
    spark.range(7).write.parquet(f"{root}/version=20990101_000000_000000/part")
    (tmp_path / "t" / "_manifests" / ".half").write_text("{")
    assert V.read_version(spark, root).count() == 3 and len(V.versions(spark, root)) == 1
    V.write_version(spark.range(5), root, dt.datetime(2026, 1, 2))  # the dead write's name is free
    assert V.read_version(spark, root).count() == 5 and V.read_version(spark, root, "20260101_000000_000000").count() == 3
    with pytest.raises(ValueError, match="no version"):
        V.read_version(spark, root, "20260109_000000_000000")


def test_two_writers_cannot_both_win(spark, tmp_path):
    root, won, lost = f"{tmp_path}/t", [], []
    V.write_version(spark.range(1), root, DAY)
    base = V.versions(spark, root)[-1]

    def write(k, **options):
        try:
            V.write_version(spark.range(k), root, **options)
            won.append(k)
        except V.VersionExists:
            lost.append(k)

    same_name = [threading.Thread(target=write, args=(k,), kwargs={"at": dt.datetime(2026, 2, 1)}) for k in (10, 11, 12)]
    [t.start() for t in same_name], [t.join() for t in same_name]
    assert len(won) == 1 and len(lost) == 2 and V.read_version(spark, root).count() == won[0]
    won.clear(), lost.clear()
    base = V.versions(spark, root)[-1]
    same_base = [threading.Thread(target=write, args=(k,), kwargs={"at": dt.datetime(2026, 3, k), "after": base}) for k in (20, 21, 22)]
    [t.start() for t in same_base], [t.join() for t in same_base]
    assert len(won) == 1 and len(lost) == 2 and V.read_version(spark, root).count() == won[0] and len(V.versions(spark, root)) == 3


def test_backups_name_versions(spark, tmp_path):
    roots = {n: f"{tmp_path}/{n}" for n in ("queue", "titles", "never")}
    V.write_version(spark.range(2), roots["queue"], DAY)
    V.write_version(spark.range(3), roots["titles"], DAY)
    assert set(V.back_up(spark, roots, f"{tmp_path}/b", DAY)) == {"queue", "titles"}
    V.write_version(spark.range(9), roots["queue"], dt.datetime(2026, 1, 2))
    assert V.restore(spark, f"{tmp_path}/b", DAY, "queue").count() == 2 and V.read_version(spark, roots["queue"]).count() == 9
    with pytest.raises(V.VersionExists):
        V.back_up(spark, roots, f"{tmp_path}/b", DAY)


def put(root, name, content):
    (root / name).mkdir(parents=True)
    (root / name / "doc.json").write_bytes(content if isinstance(content, bytes) else json.dumps(content).encode())


def test_refused_files_say_why(spark, tmp_path):
    good = {"turns": [{"start": 0, "end": 2, "speaker": "S1"}, {"start": 3, "end": 3, "speaker": "S2"}]}
    for name, content in {"good": good, "none": {"turns": []}, "other": {"x": 1}, "cut": b'{"turns": [{"start"', "empty": b"", "blank": b" \n", "bytes": b'{"turns": "\xff\xfe"}'}.items():
        put(tmp_path / "in", name, content)
    (tmp_path / "in" / "good" / "notes.txt").write_text("not looked at")
    rows, refused = X.read_files(X.documents(spark, f"{tmp_path}/in", "*.json"), formats.parse_speakers)
    assert [(r.media_id, r.speaker) for r in rows.collect()] == [("good", "S1")]
    why = {r.media_id: r.reason for r in refused.collect()}
    assert why == {"none": "nothing in it", "other": "nothing in it", "cut": "not JSON", "empty": "empty", "blank": "empty", "bytes": "not UTF-8"}


def test_packed_documents_are_those_of_single_files(spark, tmp_path):
    """Many documents take a few files, and are told and refused as one file each is."""
    texts = {k: '{"turns": [{"start": 0, "end": 2, "speaker": "S1"}]}' for k in range(300)} | {7: "", 8: None, 9: '{"turns": [{"start"', 10: "é\nü"}
    docs = spark.createDataFrame(sorted(texts.items()), "media_id long, text string").repartition(3)
    X.pack_documents(docs, f"{tmp_path}/packed")
    assert sum(p.name.endswith(".parquet") for p in (tmp_path / "packed").rglob("*")) <= 4
    some = F.col("media_id").between(5, 12)
    X.write_documents(docs.where(some), f"{tmp_path}/single")
    told = lambda df: {(r.media_id, r.bytes, bytes(r.content), r.text) for r in df.collect()}
    packed = X.packed_documents(spark, f"{tmp_path}/packed")
    assert told(packed.where(F.substring_index("media_id", "=", -1).cast("int").between(5, 12))) == told(X.documents(spark, f"{tmp_path}/single", "*.txt"))
    rows, refused = X.read_files(packed, formats.parse_speakers)
    assert rows.count() == 296 and {r.media_id: r.reason for r in refused.collect()} == {"media_id=7": "empty", "media_id=8": "empty", "media_id=9": "not JSON", "media_id=10": "not JSON"}


def test_file_queries_write_few_files(spark):
    from chronofold.plans import stored

    docs = spark.range(400).select(F.col("id").alias("media_id"), F.lit("{}").alias("text")).repartition(2)
    assert len(stored.stored(spark, docs, "few").inputFiles()) <= 4


def test_engines_fall_back_and_tell(spark):
    rows = lambda *ms: spark.createDataFrame([(m, "t") for m in ms], "media_id string, text string")
    bad = lambda *ms: spark.createDataFrame([(m, r) for m, r in ms], "media_id string, reason string")
    read = {"a": (rows("m1"), bad(("m2", "empty"), ("m4", "not JSON"))), "b": (rows("m1", "m2"), bad(("m4", "nothing in it"))), "c": (rows("m3"), bad())}
    got, failed = X.read_engines(read, ("b", "x", "a", "c"))
    assert {(r.media_id, r.engine) for r in got.collect()} == {("m1", "b"), ("m2", "b"), ("m3", "c")}
    assert {tuple(r) for r in failed.collect()} == {("m3", "b", "no file"), ("m3", "a", "no file"), ("m4", "b", "nothing in it"), ("m4", "a", "not JSON"), ("m4", "c", "no file")}


def test_folders_are_passed_over_by_whole_parts(spark, tmp_path):
    for name in ("clips/a.mp4", "my_clips_raw/b.mp4", "deep/.work/c.mp4", "d.MP4", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 20)
    found = formats.find_files(spark, str(tmp_path), (".mp4",), least_bytes=5, skip=("clips", ".work")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["b.mp4", "d.MP4"]


def test_settings_look_for_files_and_name_every_breach():
    there = {"v.mp4", "s.json"}.__contains__
    assert RunConfig("v.mp4", speakers="s.json", persona="S1").checked(there).persona == "S1"
    for bad, field in (({"source": "w.mp4"}, "source"), ({"speakers": "x", "persona": "S1"}, "speakers"), ({"signature": "x.png"}, "signature"), ({"adjustments": "x.json"}, "adjustments"), ({"most_clip_s": 1.0}, "most_clip_s"), ({"short_side": 3}, "short_side"), ({"zoom": 0.31}, "zoom")):
        with pytest.raises(ValueError, match=field):
            RunConfig(**({"source": "v.mp4"} | bad)).checked(there)
    panel = PanelConfig.of({"signature_path": "x.png", "zoom_enabled": False, "subtitle_size_ratio": 0.5, "schedule_slots": ["6h"]})
    assert len(panel.issues()) == 2 and len(panel.issues(there)) == 3 and panel.zoom == 0.0
    assert PanelConfig().rest_s(30) == 5 and PanelConfig().rest_s(31) == 20 and PanelConfig(zoom_hold_auto=False, zoom_hold_s=7).rest_s(90) == 7
