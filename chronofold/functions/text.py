"""Column functions on text: counts, sentence ends, sanitising, timecodes, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that raise a clip's score when present.
HOOKS = (
    "o segredo", "a verdade", "ninguém", "nunca", "sempre", "porque", "o problema", "a chave", "descobri", "aprendi", "errei", "o erro",
    "primeira vez", "dica", "importante", "o ponto",
)
#: Words that shouldn't end a caption line.
FUNCTION_WORDS = tuple("a o as os um uma uns umas de da do das dos em na no nas nos para pra por pelo pela com que se e ou mas meu minha seu sua ao aos à às num numa".split())


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def ends_sentence(text: Column) -> Column:
    return F.coalesce(text.rlike("(?U)[.!?…]\\s*$"), F.lit(False))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def file_title(title: Column) -> Column:
    """A title that can name a file: separators become blanks, reserved characters go, no final period."""
    t = F.regexp_replace(F.translate(title, "/\\", "  "), '[:*?"<>|]', "")
    return F.regexp_replace(collapse(t), "\\.+$", "")


def publish_name(clip_id: Column, title: Column) -> Column:
    """024 - Title.mp4 of clip_024 and its title."""
    return F.concat(F.element_at(F.split(clip_id, "_"), -1), F.lit(" - "), file_title(title), F.lit(".mp4"))


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on, of seconds rounded half to even."""
    s = F.greatest(F.bround(seconds, 0), F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def short_clock(ms: Column) -> Column:
    """mm:ss, truncated; minutes don't roll over."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def srt_time(ms: Column) -> Column:
    t = F.greatest(ms, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def parse_clock(text: Column) -> Column:
    """Seconds from SS, MM:SS or HH:MM:SS; null if it is none."""
    p = F.split(text, ":")
    n = lambda k: F.get(p, k).try_cast("double")
    return F.when(F.size(p) == 1, n(0)).when(F.size(p) == 2, n(0) * 60 + n(1)).when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))


def parse_srt_time(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm; null if it isn't one."""
    g = lambda k: F.regexp_extract(text, "^(\\d+):(\\d+):(\\d+)[,.](\\d+)$", k).try_cast("long")
    return g(1) * 3600000 + g(2) * 60000 + g(3) * 1000 + g(4)


def hook_count(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(0)
    for h in HOOKS:
        out = out + F.when(low.contains(h), 1).otherwise(0)
    return out


def clip_score(text: Column, ms: Column) -> Column:
    """0 to 10: base 5, hooks up to 2, length up to 1.5, less distance from ideal pace and duration."""
    n, s = word_count(text), ms / 1000.0
    pace = n / F.nullif(s, F.lit(0.0))
    raw = 5.0 + F.least(F.lit(2.0), 0.5 * hook_count(text)) + F.least(F.lit(1.5), n / F.lit(60.0)) - 1.2 * F.abs(pace - 2.6) - 1.5 * F.abs(s - 35.0) / 35.0
    return F.when((n == 0) | (ms <= 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)), 1))


def title_issues(title: Column, description: Column, n_tags: Column) -> Column:
    """Issues in order; a missing title is the only one reported."""
    bare = F.trim(F.coalesce(title, F.lit("")))
    rest = F.array_compact(
        F.array(
            F.when(F.length(bare) > 70, "title too long"),
            F.when((bare == F.upper(bare)) & (bare != F.lower(bare)), "title in capitals"),
            F.when(F.trim(F.coalesce(description, F.lit(""))) == "", "no description"),
            F.when(n_tags == 0, "no tags"),
        )
    )
    return F.when(bare == "", F.array(F.lit("no title"))).otherwise(rest)


def script_safe(json: Column) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def byte_ranges(size: Column, chunk: int = 64 << 20) -> Column:
    """Inclusive byte ranges of an upload: one, or size / chunk of them, the last taking the rest. Null where byte_error says why."""
    n = F.when(size <= chunk, F.lit(1)).otherwise(F.floor(size / chunk).cast("int"))
    last = lambda i: F.when(i == n - 1, size - 1).otherwise((i + 1).cast("long") * chunk - 1)
    return F.when(byte_error(size, chunk).isNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i.cast("long") * chunk).alias("first"), last(i).alias("last"))))


def byte_error(size: Column, chunk: int = 64 << 20, most_parts: int = 1000, most_last: int = 128 << 20) -> Column:
    """Why an upload of this size can't be cut: empty, too many parts, last part too large; else null."""
    n = F.floor(size / chunk)
    return F.when(size.isNull() | (size <= 0), "empty").when((size > chunk) & (n > most_parts), "too many parts").when((size > chunk) & (size - (n - 1) * chunk > most_last), "last part too large")
