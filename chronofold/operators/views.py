"""Panel views: clips joined with titles, names and queue; agenda; publishing batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.whole import in_units, total_ms

#: Statuses, their labels, quota markers, posting slots, privacy levels in order of preference.
PENDING, PUBLISHED, SCHEDULED, FAILED, NOT_QUEUED, UNKNOWN = "pendente", "publicado", "agendado", "erro", "nao_enfileirado", "desconhecido"
LABELS = {"publicado": "publicado", "agendado": "agendado", "pendente": "na fila", "nao_enfileirado": "sem fila"}
QUOTA_MARKERS = ("uploadLimitExceeded", "quotaExceeded", "rateLimitExceeded")
SLOTS = ("06:00", "13:00", "18:00", "02:00")
PRIVACY = ("SELF_ONLY", "FOLLOWER_OF_CREATOR", "MUTUAL_FOLLOW_FRIENDS")
ZONE = "-03:00"


def filled(c: str) -> Column:
    """The column, null if empty."""
    return F.nullif(F.col(c), F.lit(""))


def clip_view(meta: DataFrame, titles: DataFrame, names: DataFrame, queue: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each clip: metadata, title, published name and queue item, with defaults.

    meta: parse_metadata; titles: parse_titles; names: media_id, id, arquivo; queue: parse_queue, of a repeated id
    the last counts; files: media_id, arquivo.
    """
    last = queue.groupBy("media_id", "id").agg(F.max_by(F.struct("status", "publish_at", "published_at", "video_id", "tiktok_status"), "pos").alias("q"))
    there = files.select("media_id", "arquivo").distinct().withColumn("_there", F.lit(True))
    t = titles.select("media_id", F.col("clip_id").alias("id"), "titulo", "descricao", "tags", "estrela")
    met = meta.join(t, ["media_id", "id"], "left").join(names.select("media_id", "id", "arquivo"), ["media_id", "id"], "left").join(last, ["media_id", "id"], "left").join(there, ["media_id", "arquivo"], "left")
    said = lambda c: F.coalesce(c, F.lit(""))
    return met.select(
        "media_id", "pos", "id", F.coalesce("titulo", "id").alias("titulo"), said("descricao").alias("descricao"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("estrela", F.lit(False)).alias("estrela"),
        said("start").alias("start"), said("end").alias("end"), said("final_duration").alias("duracao"), F.coalesce("importance_score", F.lit(0.0)).alias("score"), said("transcription").alias("transcricao"), said("arquivo").alias("arquivo"), F.coalesce("_there", F.lit(False)).alias("video_existe"),
        F.coalesce("q.status", F.lit(NOT_QUEUED)).alias("upload_status"), said("q.publish_at").alias("publish_at"), said("q.published_at").alias("published_at"), said("q.video_id").alias("video_id"), said("q.tiktok_status").alias("tiktok_status"),
    )


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, status), status)


def channels(tiktok_status: Column) -> Column:
    return F.array_compact(F.array(F.lit("youtube"), F.when(tiktok_status == PUBLISHED, F.lit("tiktok"))))


def with_status(view: DataFrame, status: str) -> DataFrame:
    """The view's clips of a status; todos means all."""
    return view if status == "todos" else view.where(F.col("upload_status") == status)


def kpis(view: DataFrame) -> DataFrame:
    """(media_id, clips, published, scheduled, pending, minutes) of each project."""
    n = lambda s: F.count(F.when(F.col("upload_status") == s, 1))
    number = F.coalesce(F.regexp_extract("duracao", "^\\s*([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    return view.groupBy("media_id").agg(F.count("*").alias("clips"), n(PUBLISHED).alias("published"), n(SCHEDULED).alias("scheduled"), n(PENDING).alias("pending"), in_units(total_ms(number), 60_000).alias("minutes"))


def without_date(view: DataFrame) -> DataFrame:
    """Published clips that no date tells when: they can't stand in the agenda."""
    return view.where((F.col("upload_status") == PUBLISHED) & filled("publish_at").isNull() & filled("published_at").isNull())


def local_day(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def posts(view: DataFrame, zone: str = ZONE) -> DataFrame:
    """The view's clips with at (planned, else actual) and local day; those without a readable time go."""
    at = F.coalesce(filled("publish_at"), filled("published_at")).try_cast("timestamp")
    return view.withColumn("at", at).where("at is not null").withColumn("day", local_day(F.col("at"), zone))


def day_cells(dated: DataFrame, by: list[str], order: list[str], most: int = 3) -> DataFrame:
    """The first posts of each day, with their number k and how many more there are. A day is counted by a grouped sum, not a window."""
    all_ = dated.groupBy(*by, "day").agg(F.count("*").alias("_n"))
    first = dated.withColumn("k", F.row_number().over(W.partitionBy(*by, "day").orderBy(*order))).where(F.col("k") <= most)
    return first.join(all_, [*by, "day"]).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def calendar(spark: SparkSession, dated: DataFrame, first_day: str, days: int = 42) -> DataFrame:
    """(day, n): a spine of days with their posts."""
    spine = spark.range(days).select(F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("day"))
    return spine.join(dated.groupBy("day").agg(F.count("*").alias("n")), "day", "left").fillna(0, ["n"])


def first_day(dated: DataFrame, by: list[str], today: Column) -> DataFrame:
    """The day to open with: the first from today on that has posts, else the latest."""
    return dated.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("day") >= today, F.col("day"))), F.max("day")).alias("day"))


def schedules(starts: DataFrame, by: list[str], count: int, slots: tuple[str, ...] = SLOTS, zone: str = ZONE) -> DataFrame:
    """(by, turn, publish_at): the next count instants after each row's start (a local timestamp): days by slots, in order, as UTC text.

    Days and slots come out of the row itself, bounded by count.
    """
    days = F.sequence(F.lit(0), F.lit(count // len(slots) + 1))
    day = lambda i: F.date_add(F.col("start").cast("date"), i).cast("string")
    at = F.flatten(F.transform(days, lambda i: F.transform(F.array(*map(F.lit, slots)), lambda s: F.to_timestamp(F.concat_ws(" ", day(i), s), "yyyy-MM-dd HH:mm"))))
    next_ = F.slice(F.array_sort(F.filter(at, lambda t: t > F.col("start"))), 1, count)
    each = starts.select(*by, F.posexplode(next_).alias("turn", "at"))
    return each.select(*by, (F.col("turn") + 1).alias("turn"), F.date_format(F.to_utc_timestamp("at", zone), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publish_at"))


def schedule(spark: SparkSession, count: int, start: str, slots: tuple[str, ...] = SLOTS, zone: str = ZONE) -> DataFrame:
    """The next count instants after one start."""
    one = spark.range(1).select(F.lit(start).cast("timestamp").alias("start"))
    return schedules(one, [], count, slots, zone).orderBy("turn").select("publish_at")


def prioritized(queue: DataFrame, by: str, second: bool = False) -> DataFrame:
    """Pending items with their turn: starred first, else in order; for the second channel those that are out there already go."""
    pending = queue.where(F.col("status") == PENDING)
    if second:
        pending = pending.where(~F.coalesce(F.col("tiktok_status") == PUBLISHED, F.lit(False)))
    return pending.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(~F.coalesce("estrela", F.lit(False)), "pos")))


def failure(output: Column) -> Column:
    """quota or erro, by what a failed upload says."""
    hit = F.lit(False)
    for m in QUOTA_MARKERS:
        hit = hit | output.contains(m)
    return F.when(hit, "quota").otherwise(FAILED)


def second_failure(http_code: Column, text: Column, code: Column) -> Column:
    """ok, quota or erro of the second channel's answer: its HTTP code and text, or the error code in it (none or empty is ok)."""
    by_http = F.when((http_code == 429) | text.contains("rate_limit"), "quota").otherwise(FAILED)
    told = F.coalesce(code, F.lit("ok"))
    by_code = F.when(told.isin("ok", ""), "ok").when(told.contains("rate_limit") | told.contains("quota"), "quota").otherwise(FAILED)
    return F.when(http_code >= 400, by_http).otherwise(by_code)


def video_id(answer: Column) -> Column:
    """The id in [{"id": ...}] or {"id": ...}, else empty."""
    ok = F.when(F.try_parse_json(answer).isNotNull(), answer)
    return F.coalesce(F.get_json_object(ok, "$[0].id"), F.get_json_object(ok, "$.id"), F.lit(""))


def channel_info(answer: Column) -> Column:
    """Title, id and counts of the first channel of an answer, ? where it tells none; null if there is none."""
    ok = F.when(F.try_parse_json(answer).isNotNull(), answer)
    at = lambda p: F.coalesce(F.get_json_object(ok, f"$[0].{p}"), F.lit("?"))
    return F.when(F.get_json_object(ok, "$[0]").isNotNull(), F.struct(at("snippet.title").alias("channel_title"), at("id").alias("channel_id"), at("statistics.subscriberCount").alias("subscriber_count"), at("statistics.videoCount").alias("video_count")))


def privacy(offered: Column, wanted: str) -> Column:
    """The wanted level if offered, else the first preferred one that is, else the first offered; null if none is."""
    preferred = F.array(*map(F.lit, (wanted, *PRIVACY)))
    return F.coalesce(F.get(F.filter(preferred, lambda p: F.array_contains(offered, p)), F.lit(0)), F.get(offered, F.lit(0)))


def publish_batch(queue: DataFrame, outcomes: DataFrame, by: str, most: int, now: str, times: DataFrame | None = None, second: bool = False) -> DataFrame:
    """The queue after a batch of at most so many uploads for each channel.

    queue: by, pos, status, estrela, publish_at, published_at, video_id, erro (and tiktok_status for the second
    channel, whose own status, time and error change then). outcomes: by, pos, result (ok, quota, erro, missing) and
    detail (video id or message). times: publish_at, one for each turn in order; without them ok means out now.
    A quota ends the channel's batch; other failures don't. A missing file is a failure on the
    first channel and passed over on the second.
    """
    todo = prioritized(queue, by, second).where(F.col("turn") <= most).select(by, "pos", "turn").join(outcomes, [by, "pos"], "left")
    stop = todo.where("result = 'quota'").groupBy(by).agg(F.min("turn").alias("stop"))
    todo = todo.join(stop, by, "left").where("stop is null or turn < stop")
    if times is not None:
        slots = times.withColumn("turn", F.row_number().over(W.orderBy("publish_at"))).withColumnRenamed("publish_at", "slot")
        todo = todo.join(F.broadcast(slots), "turn", "left")  # at most ``most`` rows
    else:
        todo = todo.withColumn("slot", F.lit(None).cast("string"))
    met = queue.join(todo.select(by, "pos", "result", "detail", "slot"), [by, "pos"], "left")
    ok, bad = F.col("result") == "ok", (F.col("result") == "erro") if second else F.col("result").isin("erro", "missing")
    message = F.when(bad, F.col("detail"))
    new = {"status": F.when(ok & F.col("slot").isNotNull(), SCHEDULED).when(ok, PUBLISHED).when(bad, FAILED).otherwise(F.col("status"))}
    new |= {"video_id": F.when(ok, F.coalesce("detail", F.lit(""))).otherwise(F.col("video_id")), "publish_at": F.when(ok & F.col("slot").isNotNull(), F.col("slot")).otherwise(F.col("publish_at"))}
    new |= {"published_at": F.when(ok & F.col("slot").isNull(), F.lit(now)).otherwise(F.col("published_at")), "erro": F.when(ok, None).otherwise(F.coalesce(message, "erro"))}
    if second:
        new = {"tiktok_status": F.when(ok, PUBLISHED).when(bad, FAILED).otherwise(F.col("tiktok_status")), "tiktok_published_at": F.when(ok, F.lit(now)), "tiktok_publish_id": F.when(ok, F.col("detail")), "tiktok_erro": message}
    return met.withColumns(new).drop("result", "detail", "slot")
