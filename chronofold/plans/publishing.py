"""Queries over queues, titles, schedules, views, vectors and text formats.

Orders stand for a publishing queue (customer as channel), benchmark and documents for titles, embeddings for voices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..operators import intervals as I
from ..operators import segment as S
from ..operators import vectors as V
from ..operators import views as P
from ..sinks import documents as D
from ..sources import formats, tables
from .prelude import GRID, INSIDE, KEEP, UTTERANCES
from .segments import grid

def queue(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pendente").when(F.col("o_orderstatus") == "F", "publicado")
    return o.select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("pos"), status.alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("estrela"), F.col("o_orderdate").cast("timestamp").alias("publish_at"))


def a7(spark, d):
    return queue(spark, d).groupBy(F.coalesce("status", F.lit("desconhecido")).alias("status")).agg(F.count("*").alias("n"))


def a8(spark, d):
    """Minutes by project from duration texts; what isn't one counts zero."""
    docs = tables.read(spark, d, "documents")
    told = F.when(F.col("doc_id") % 7 == 0, "lixo").otherwise(F.concat(F.floor(F.col("n_chars") / 10).cast("string"), F.lit(".5s")))
    return docs.groupBy("source").agg(F.count("*").alias("clips"), F.round(F.sum(D.seconds(told)) / 60, 1).alias("minutes"))


def a10(spark, d):
    q = queue(spark, d)
    n = lambda c: F.count(F.when(c, 1))
    return q.groupBy("channel").agg(F.count("*").alias("total"), n(F.col("status") == "pendente").alias("pending"), n(F.col("status") == "publicado").alias("published"), n(F.col("estrela")).alias("starred"))


def a15(spark, d):
    return tables.read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def t2(spark, d):
    """Pending items of each channel, starred first, else in queue order."""
    return P.prioritized(queue(spark, d), "channel").select("channel", "pos", "turn")


def t8(spark, d):
    """First day of each channel from a date on, else its latest."""
    dated = queue(spark, d).withColumn("day", P.local_day(F.col("publish_at")))
    return P.first_day(dated, ["channel"], F.lit("1999-06-01").cast("date"))


def a11(spark, d):
    """The first three posts of each local day and how many more there are."""
    q = queue(spark, d).withColumn("day", P.local_day(F.col("publish_at")))
    return P.day_cells(q, [], ["publish_at", "pos"]).select("day", "k", "pos", "more")


def j14(spark, d):
    """A calendar of 42 days with each day's posts."""
    return P.calendar(spark, queue(spark, d).withColumn("day", P.local_day(F.col("publish_at"))), "1998-12-28")


def c10(spark, d):
    """The next ten slots of each channel after its latest order, some hours into that day."""
    last = queue(spark, d).groupBy("channel").agg(F.max("publish_at").alias("at"))
    start = F.timestamp_millis(F.unix_millis(F.col("at")) + F.col("channel") % 24 * 3_600_000)
    return P.schedules(last.select("channel", start.alias("start")), ["channel"], 10)


def c11(spark, d):
    """Outcomes of a batch: a quota error stops its channel, so later items stay pending; other errors don't."""
    q = queue(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("publish_at", "published_at", "video_id", "erro")})
    result = F.when(F.col("pos") % 11 == 0, "quota").when(F.col("pos") % 11 < 3, "erro").otherwise("ok")
    outcomes = q.select("channel", "pos", result.alias("result"), F.lit("").alias("detail"))
    out = P.publish_batch(q, outcomes, "channel", 1_000_000, "now")
    return out.join(t2(spark, d).select("channel", "pos"), ["channel", "pos"], "left_semi").select("channel", "pos", "status")


def f8_whole(spark, d):
    """F8 over whole texts as titles."""
    b = tables.read(spark, d, "benchmark")
    title = F.when(F.col("item_id") % 5 == 0, "  ").when(F.col("item_id") % 5 == 1, F.upper("text")).otherwise(F.col("text"))
    issues = T.title_issues(title, F.when(F.col("item_id") % 2 == 0, "about"), F.when(F.col("item_id") % 3 == 0, 0).otherwise(2))
    return b.select("item_id", F.explode(issues).alias("issue"))


def x8_whole(spark, d):
    """X8 over whole texts, with reserved characters before and after them."""
    b = tables.read(spark, d, "benchmark")
    name = F.concat(F.lit('a/b: "'), F.col("text"), F.lit('"?  end..'))
    return b.select("item_id", T.publish_name(F.format_string("clip_%03d", "item_id"), name).alias("name"))


def x10(spark, d):
    """Title, description and hashtags by blank lines, the first 2,200 characters."""
    docs = tables.read(spark, d, "documents")
    tags = F.concat(F.lit("#"), F.replace("lang", F.lit(" "), F.lit("")), F.lit(" #"), F.replace("source", F.lit(" "), F.lit("")))
    parts = F.filter(F.array(F.trim(F.concat(F.lit("T"), F.col("doc_id").cast("string"))), F.btrim("text", F.lit(" \n\t")), tags), lambda p: p != "")
    return docs.select("doc_id", F.substring(F.array_join(parts, "\n\n"), 1, 2200).alias("caption"))


def k9(spark, d):
    return tables.read(spark, d, "pages").select("page_id", T.script_safe(F.col("html")).alias("html"))


def i15(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", T.byte_ranges(F.col("n_chars") * 65536).alias("r"))
    return docs.select("doc_id", F.posexplode("r").alias("part", "x")).select("doc_id", "part", "x.first", "x.last")


def i15_errors(spark, d):
    """Why some uploads can't be cut."""
    size = (F.col("n_chars") - 30) * 40_000_000
    return tables.read(spark, d, "documents").select("doc_id", T.byte_error(size).alias("error"), F.size(F.coalesce(T.byte_ranges(size), F.array().cast("array<struct<first:bigint,last:bigint>>"))).alias("parts"))


def f15(spark, d):
    """The wanted privacy if offered, else the first preferred one, else the first offered, else none."""
    k = F.col("doc_id")
    offered = F.filter(F.array(F.when(k % 7 != 0, F.lit("OTHER")), F.when(k % 5 == 0, F.lit("MUTUAL_FOLLOW_FRIENDS")), F.when(k % 2 == 0, F.lit("PUBLIC_TO_EVERYONE")), F.when(k % 3 == 0, F.lit("SELF_ONLY"))), lambda x: x.isNotNull())
    return tables.read(spark, d, "documents").select("doc_id", P.privacy(offered, "PUBLIC_TO_EVERYONE").alias("privacy"))


def f17(spark, d):
    m = tables.media(tables.utterances(spark, d))
    return m.select("media_id", L.hold_seconds(F.col("total_ms")).alias("hold_s"))


def c3(spark, d):
    """Editorial adjustments: removed and absorbed clips go, a clip that absorbs reaches its furthest part's end."""
    clips = grid(tables.media(tables.utterances(spark, d)))
    plan = clips.where("clip % 6 in (0, 4)").select("media_id", F.col("clip").alias("id"), (F.col("clip") % 6 == 4).alias("remove"), F.when(F.col("clip") % 6 == 0, F.array(F.col("clip") + 1, F.col("clip") + 2)).otherwise(F.array().cast("array<long>")).alias("absorb"))
    parts = plan.select("media_id", "id", F.explode("absorb").alias("clip"))
    reach = parts.join(clips, ["media_id", "clip"]).groupBy("media_id", "id").agg(F.max("w_end").alias("reach"))
    gone = plan.where("remove").select("media_id", F.col("id").alias("clip")).union(parts.select("media_id", "clip"))
    kept = clips.join(gone, ["media_id", "clip"], "left_anti").join(reach.withColumnRenamed("id", "clip"), ["media_id", "clip"], "left")
    return kept.select("media_id", "clip", F.col("w_start").alias("start_ms"), F.greatest("w_end", F.coalesce("reach", F.lit(0))).alias("end_ms"))


def k6(spark, d):
    """Two maps of names merged, the newer one wins."""
    old = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("old"))
    new = tables.read(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.col("s_name").alias("new"))
    return old.join(new, "id", "full").select("id", F.coalesce("new", "old").alias("name"))


def j11(spark, d):
    """Clip view: documents with labels and the last queue item of their id, with defaults."""
    docs, labels = tables.read(spark, d, "documents").select("doc_id", "lang"), tables.read(spark, d, "labels")
    last = queue(spark, d).groupBy(F.col("channel").alias("doc_id")).agg(F.max_by("status", "pos").alias("status"))
    met = docs.join(labels, "doc_id", "left").join(last, "doc_id", "left")
    return met.select("doc_id", F.coalesce(F.nullif("lang", F.lit("")), F.col("doc_id").cast("string")).alias("titulo"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("status", F.lit("nao_enfileirado")).alias("status"))


def d1(spark, d):
    e = tables.read(spark, d, "events")
    return e.select("event_id", T.clock(F.col("value") * 20).alias("clock"), T.short_clock((F.col("event_id") * 1000).cast("long")).alias("short"), T.parse_clock(F.concat((F.col("event_id") % 9).cast("string"), F.lit(":30"))).alias("parsed"))


def i18(spark, d):
    g = grid(tables.media(tables.utterances(spark, d)))
    s = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return g.select("media_id", "clip", F.concat(F.lit("-ss "), s(F.col("w_start")), F.lit(" -t "), s(F.col("w_end") - F.col("w_start"))).alias("seek"))


def i17(spark, d):
    """Filter graph of each clip's kept ranges, scaled once after joining them, and its output label."""
    u = tables.utterances(spark, d)
    c = S.with_cuts(grid(tables.media(u)), tables.silences(u)).withColumn("r", I.keep_ranges(F.col("w_start"), F.col("w_end"), F.col("cuts"), 150))
    return c.select("media_id", "clip", L.filter_graph(F.col("r"), 1080).alias("graph"))


def s1(spark, d):
    """Silences written as a log and read again."""
    s = tables.silences(tables.utterances(spark, d))
    far = F.lit(10**12).cast("long")
    two = F.array(F.struct(F.concat(F.lit("silence_start: "), (F.col("start_ms") / 1000).cast("decimal(18,3)").cast("string")).alias("line"), F.lit(1).alias("k")), F.struct(F.concat(F.lit("silence_end: "), (F.col("end_ms") / 1000).cast("decimal(18,3)").cast("string")).alias("line"), F.lit(0).alias("k")))
    lines = s.select("media_id", "start_ms", "end_ms", F.explode(two).alias("x"))
    return formats.parse_silence_log(lines.select("media_id", F.when(F.col("x.k") == 1, F.col("start_ms") * 2 + 1).otherwise(F.col("end_ms") * 2).alias("line_no"), F.col("x.line").alias("line"), far.alias("total_ms")))


def transcript_json(u: DataFrame) -> DataFrame:
    """One cached transcript for each medium."""
    item = F.struct(F.col("seq"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    lists = u.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("u"))
    said = F.transform("u", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    return lists.select("media_id", F.to_json(F.struct(F.lit(2).alias("cache_version"), F.lit("pt").alias("language"), F.lit("medium").alias("model"), F.lit("local").alias("engine"), said.alias("utterances"))).alias("json"))


def s3(spark, d):
    """Transcripts written as cache documents and read again."""
    t = formats.parse_transcripts(transcript_json(tables.utterances(spark, d)), "pt", "medium")
    return t.select("media_id", "seq", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), "text")


def k5(spark, d):
    """Speakers of each medium as JSON, read again: seconds, samples, turns and utterances of each."""
    u = tables.utterances(spark, d)
    kind = "struct<num_speakers:int,totals_s:map<string,double>,samples:map<string,array<string>>,utterances:array<struct<start:double,end:double,speaker:string>>,turns:array<struct<start:double,end:double,speaker:string>>>"
    j = D.speaker_documents(u, I.merge_turns(u, 250)).select("media_id", F.from_json("json", kind).alias("j"))
    each = j.select("media_id", "j", F.explode("j.totals_s").alias("speaker", "seconds"))
    of = lambda c: F.filter(c, lambda x: x["speaker"] == F.col("speaker"))
    return each.select("media_id", "j.num_speakers", "speaker", "seconds", F.coalesce(F.array_join(F.try_element_at("j.samples", F.col("speaker")), "|"), F.lit("")).alias("samples"), F.size(of(F.col("j.turns"))).alias("n_turns"), F.size(of(F.col("j.utterances"))).alias("n_utterances"))


def a4(spark, d):
    c = V.centroids(tables.read(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 4).alias("x"))


def j15(spark, d):
    e = tables.read(spark, d, "embeddings")
    return V.assign(e, "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label")


QUERIES = {
    "a7_status_counts": a7, "a8_a9_project_rollup": a8, "a10_channel_kpis": a10, "a15_last_wins": a15, "t2_pending_first": t2, "t8_upcoming_day": t8, "a11_w7_d8_day_agenda": a11, "j14_calendar": j14, "c10_j13_t4_d6_schedule": c10, "c11_publish_batch": c11,
    "f8_title_issues": f8_whole, "f8_whole_title_issues": f8_whole, "x8_whole_publish_name": x8_whole, "x8_x9_publish_name": x8_whole, "x10_caption": x10, "k9_script_safe": k9, "i15_byte_ranges": i15, "i15_byte_errors": i15_errors, "f15_privacy": f15, "f17_zoom_tier": f17, "c3_j9_j10_adjustments": c3, "k6_rename_map": k6, "j11_c12_clip_view": j11,
    "d1_d2_d4_clocks": d1, "i17_filter_graph": i17, "i18_seek_args": i18, "s1_w3_silence_log": s1, "s3_k1_transcript_cache": s3, "k5_speakers_json": k5, "a4_m3_centroids": a4, "j15_nearest_centroid": j15,
}

_Q = "q AS (SELECT o_custkey AS channel, o_orderkey AS pos, CASE o_orderstatus WHEN 'O' THEN 'pendente' WHEN 'F' THEN 'publicado' END AS status, o_orderpriority = '1-URGENT' AS estrela, o_orderdate AS due, CAST(o_orderdate - INTERVAL 3 HOUR AS DATE) AS day FROM orders)"
_T2 = _Q + ", t AS (SELECT channel, pos, CAST(row_number() OVER (PARTITION BY channel ORDER BY NOT estrela, pos) AS INT) AS turn FROM q WHERE status = 'pendente')"
_G = "WITH" + UTTERANCES + "," + GRID
_CENT = "p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY ALL), n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM p)"
ORACLE = {
    "a7_status_counts": f"WITH {_Q} SELECT coalesce(status, 'desconhecido') AS status, count(*) AS n FROM q GROUP BY ALL",
    "a8_a9_project_rollup": "SELECT source, count(*) AS clips, round(sum(coalesce(TRY_CAST(rtrim(CASE WHEN doc_id % 7 = 0 THEN 'lixo' ELSE (n_chars // 10) || '.5s' END, 's') AS DOUBLE), 0)) / 60, 1) AS minutes FROM documents GROUP BY source",
    "a10_channel_kpis": f"WITH {_Q} SELECT channel, count(*) AS total, count(*) FILTER (status = 'pendente') AS pending, count(*) FILTER (status = 'publicado') AS published, count(*) FILTER (estrela) AS starred FROM q GROUP BY channel",
    "a15_last_wins": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "t2_pending_first": f"WITH {_T2} SELECT * FROM t",
    "t8_upcoming_day": f"WITH {_Q} SELECT channel, coalesce(min(day) FILTER (day >= DATE '1999-06-01'), max(day)) AS day FROM q GROUP BY channel",
    "a11_w7_d8_day_agenda": f"WITH {_Q} SELECT * FROM (SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY due, pos) AS INT) AS k, pos, greatest(count(*) OVER (PARTITION BY day) - 3, 0) AS more FROM q) WHERE k <= 3",
    "j14_calendar": f"WITH {_Q}, s AS (SELECT DATE '1998-12-28' + CAST(i AS INT) AS day FROM range(42) r(i)) SELECT s.day, count(q.pos) AS n FROM s LEFT JOIN q ON q.day = s.day GROUP BY s.day",
    "c10_j13_t4_d6_schedule": f"WITH {_Q}, s AS (SELECT channel, max(due) + to_hours(channel % 24) AS start FROM q GROUP BY channel), c AS (SELECT channel, start, date_trunc('day', start) + to_days(CAST(i AS INT)) + to_hours(h) AS slot FROM s, range(4) r(i), (VALUES (6), (13), (18), (2)) v(h)), k AS (SELECT channel, slot, CAST(row_number() OVER (PARTITION BY channel ORDER BY slot) AS INT) AS turn FROM c WHERE slot > start) SELECT channel, turn, strftime(slot + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS publish_at FROM k WHERE turn <= 10",
    "c11_publish_batch": f"WITH {_T2} SELECT channel, pos, CASE WHEN max(CASE WHEN pos % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY turn) = 1 THEN 'pendente' WHEN pos % 11 < 3 THEN 'erro' ELSE 'publicado' END AS status FROM t",
    "f8_whole_title_issues": """WITH t AS (SELECT item_id, trim(CASE item_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN upper(text) ELSE text END) AS b FROM benchmark)
SELECT item_id, 'no title' AS issue FROM t WHERE b = '' UNION ALL SELECT item_id, 'title too long' FROM t WHERE length(b) > 70 UNION ALL SELECT item_id, 'title in capitals' FROM t WHERE b <> '' AND b = upper(b) AND b <> lower(b)
UNION ALL SELECT item_id, 'no description' FROM t WHERE b <> '' AND item_id % 2 = 1 UNION ALL SELECT item_id, 'no tags' FROM t WHERE b <> '' AND item_id % 3 = 0""",
    "x8_whole_publish_name": r"""SELECT item_id, format('{:03d}', item_id) || ' - ' || regexp_replace(trim(regexp_replace(regexp_replace(translate('a/b: "' || text || '"?  end..', '/\', '  '), '[:*?"<>|]', '', 'g'), '\s+', ' ', 'g')), '\.+$', '') || '.mp4' AS name FROM benchmark""",
    "x10_caption": r"SELECT doc_id, substr(array_to_string(list_filter(['T' || doc_id, trim(text, e' \n\t'), '#' || replace(lang, ' ', '') || ' #' || replace(source, ' ', '')], lambda p: p <> ''), chr(10) || chr(10)), 1, 2200) AS caption FROM documents",
    "k9_script_safe": r"SELECT page_id, replace(replace(replace(html, '<', '\u003c'), '>', '\u003e'), '&', '\u0026') AS html FROM pages",
    "i15_byte_ranges": "WITH s AS (SELECT doc_id, n_chars * 65536 AS size, CASE WHEN n_chars * 65536 <= 67108864 THEN 1 ELSE n_chars * 65536 // 67108864 END AS n FROM documents WHERE n_chars > 0) SELECT doc_id, CAST(i AS INT) AS part, i * 67108864 AS first, CASE WHEN i = n - 1 THEN size - 1 ELSE (i + 1) * 67108864 - 1 END AS last FROM s, LATERAL (SELECT unnest(range(0, n)) AS i)",
    "f15_privacy": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'PUBLIC_TO_EVERYONE' WHEN doc_id % 3 = 0 THEN 'SELF_ONLY' WHEN doc_id % 5 = 0 THEN 'MUTUAL_FOLLOW_FRIENDS' WHEN doc_id % 7 <> 0 THEN 'OTHER' END AS privacy FROM documents",
    "i15_byte_errors": "WITH s AS (SELECT doc_id, (n_chars - 30) * 40000000 AS size FROM documents), e AS (SELECT *, CASE WHEN size IS NULL OR size <= 0 THEN 'empty' WHEN size > 67108864 AND size // 67108864 > 1000 THEN 'too many parts' WHEN size > 67108864 AND size - (size // 67108864 - 1) * 67108864 > 134217728 THEN 'last part too large' END AS error FROM s) SELECT doc_id, error, CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN size <= 67108864 THEN 1 ELSE size // 67108864 END AS INT) AS parts FROM e",
    "k5_speakers_json": "WITH" + UTTERANCES + """, f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w <= 250 THEN 0 ELSE 1 END AS f FROM u WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seq)),
g AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY start_ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM f), t AS (SELECT media_id, speaker, k, max(end_ms) - min(start_ms) AS ms FROM g GROUP BY ALL),
s AS (SELECT media_id, speaker, round(CAST(sum(ms) AS DOUBLE) / 1000, 1) AS seconds, CAST(count(*) AS INT) AS n_turns FROM t GROUP BY ALL), n AS (SELECT media_id, speaker, CAST(count(*) AS INT) AS n_utterances FROM u GROUP BY ALL),
l AS (SELECT media_id, speaker, seq, trim(text) AS t, row_number() OVER (PARTITION BY media_id, speaker ORDER BY seq) AS k FROM u WHERE length(trim(text)) >= 25), x AS (SELECT media_id, speaker, string_agg(t, '|' ORDER BY k) AS samples FROM l WHERE k <= 5 GROUP BY ALL)
SELECT media_id, CAST(count(*) OVER (PARTITION BY media_id) AS INT) AS num_speakers, speaker, seconds, coalesce(samples, '') AS samples, n_turns, n_utterances FROM s JOIN n USING (media_id, speaker) LEFT JOIN x USING (media_id, speaker)""",
    "f17_zoom_tier": "WITH" + UTTERANCES + " SELECT media_id, CASE WHEN total_ms <= 30000 THEN 5 ELSE 20 END AS hold_s FROM med",
    "c3_j9_j10_adjustments": _G + " SELECT a.media_id, a.clip, a.w_start AS start_ms, greatest(a.w_end, coalesce(max(b.w_end), 0)) AS end_ms FROM grid a LEFT JOIN grid b ON a.media_id = b.media_id AND a.clip % 6 = 0 AND b.clip IN (a.clip + 1, a.clip + 2) WHERE a.clip % 6 NOT IN (1, 2, 4) GROUP BY a.media_id, a.clip, a.w_start, a.w_end",
    "k6_rename_map": "SELECT coalesce(c_custkey, s_suppkey * 2) AS id, coalesce(s_name, c_name) AS name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2",
    "j11_c12_clip_view": f"WITH {_Q}, l AS (SELECT channel, arg_max(status, pos) FILTER (status IS NOT NULL OR TRUE) AS x, arg_max_null(status, pos) AS status FROM q GROUP BY channel) SELECT d.doc_id, coalesce(nullif(lang, ''), CAST(d.doc_id AS VARCHAR)) AS titulo, coalesce(quality, -1) AS quality, coalesce(l.status, 'nao_enfileirado') AS status FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN l ON l.channel = d.doc_id",
    "d1_d2_d4_clocks": "WITH s AS (SELECT event_id, greatest(0, CAST(round_even(value * 20, 0) AS BIGINT)) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN format('{:02d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) ELSE format('{:02d}:{:02d}', s // 60, s % 60) END AS clock, format('{:02d}:{:02d}', event_id // 60, event_id % 60) AS short, CAST((event_id % 9) * 60 + 30 AS DOUBLE) AS parsed FROM s",
    "i17_filter_graph": _G + ", cw AS (SELECT * FROM grid)," + INSIDE + "," + KEEP + r""", k AS (SELECT media_id, clip, row_number() OVER (PARTITION BY media_id, clip ORDER BY a) - 1 AS i, format('start={}.{:03d}:end={}.{:03d}', a // 1000, a % 1000, b // 1000, b % 1000) AS r FROM kept)
SELECT media_id, clip, string_agg('[0:v]trim=' || r || ',setpts=PTS-STARTPTS[v' || i || '];[0:a]atrim=' || r || ',asetpts=PTS-STARTPTS[a' || i || ']', ';' ORDER BY i) || ';' || string_agg('[v' || i || '][a' || i || ']', '' ORDER BY i) || 'concat=n=' || count(*) || ':v=1:a=1[outv][outa];[outv]scale=w=min(1080\,iw):h=min(1080\,ih):force_original_aspect_ratio=increase:force_divisible_by=2[scaled]' AS graph FROM k GROUP BY ALL""",
    "i18_seek_args": _G + " SELECT media_id, clip, format('-ss {}.{:03d} -t {}.{:03d}', w_start // 1000, w_start % 1000, (w_end - w_start) // 1000, (w_end - w_start) % 1000) AS seek FROM grid",
    "s1_w3_silence_log": "WITH" + UTTERANCES + " SELECT * FROM sil",
    "s3_k1_transcript_cache": "WITH" + UTTERANCES + " SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS INT) AS seq, start_ms, trim(text) AS text FROM u WHERE trim(text) <> ''",
    "a4_m3_centroids": f"WITH {_CENT} SELECT label, CAST(i - 1 AS INT) AS pos, round(x, 4) AS x FROM n",
    "j15_nearest_centroid": f"WITH {_CENT}, c AS (SELECT label, list(x ORDER BY i) AS c FROM n GROUP BY label), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), r AS (SELECT vec_id, label, round(list_cosine_similarity(v, c), 9) AS s FROM e, c) SELECT vec_id, arg_max(label, (s, -label)) AS nearest, round(max(s), 4) AS cosine FROM r GROUP BY vec_id",
}
ORACLE["f8_title_issues"], ORACLE["x8_x9_publish_name"] = ORACLE["f8_whole_title_issues"], ORACLE["x8_whole_publish_name"]
