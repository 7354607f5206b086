"""Layout of burned captions and text of filter graphs: what a renderer is told, without rendering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

LISTS = "array<array<string>>"


@dataclass(frozen=True)
class Style:
    """Sizes relative to the video."""

    font: float = 0.0726
    stroke: float = 0.0
    shadow: float = 0.055
    dim_alpha: int = 115
    bottom: float = 0.115
    lift: float = 0.06
    signature_bottom: float = 0.095
    zoom: float = 0.12
    transition_s: float = 4.0
    hold_s: float = 10.0

    @property
    def cycle_s(self) -> float:
        return 2 * (self.transition_s + self.hold_s)


def font_size(width: Column, style: Style = Style()) -> Column:
    return F.greatest(F.lit(12), F.floor(width * style.font).cast("int"))


def stroke_size(width: Column, style: Style = Style()) -> Column:
    return F.floor(font_size(width, style) * style.stroke).cast("int")


def shadow_size(width: Column, style: Style = Style()) -> Column:
    return F.greatest(F.lit(1), F.floor(font_size(width, style) * style.shadow).cast("int"))


def dim_stroke_alpha(style: Style = Style()) -> int:
    return min(255, int(style.dim_alpha * 1.2))


def hold_seconds(ms: Column) -> Column:
    """Seconds that the zoom rests: 5 for clips of at most 30 s, else 20."""
    return F.when(ms <= 30_000, 5).otherwise(20)


def zoom_phases(style: Style = Style()) -> list[tuple[float, float, str]]:
    """(from, until, kind) of a cycle: in by half a cosine wave, held, out by another; then it rests."""
    go, hold = max(0.1, style.transition_s), max(0.0, style.hold_s)
    return [(0.0, go, "in"), (go, go + hold, "held"), (go + hold, 2 * go + hold, "out")]


def zoom(t: Column, style: Style = Style()) -> Column:
    """Zoom factor at t seconds."""
    if style.zoom <= 0:
        return F.lit(1.0)
    phase, shape = t % style.cycle_s, F.lit(0.0)
    for start, until, kind in reversed(zoom_phases(style)):
        turn = F.cos(pi * (phase - start) / max(0.1, style.transition_s))
        value = {"in": (1 - turn) / 2, "held": F.lit(1.0), "out": (1 + turn) / 2}[kind]
        shape = F.when(phase < until, value).otherwise(shape)
    return 1.0 + style.zoom * shape


def zoom_filter(width: Column, height: Column, fps: Column, style: Style = Style(), upscale: int = 2) -> Column:
    """The renderer's zoom, as text: the phases nested into one expression of the frame number. Empty without zoom."""
    if style.zoom <= 0:
        return F.lit("")
    rate, go = F.format_string("%.6f", fps.cast("double")), f"{max(0.1, style.transition_s):.3f}"
    phase = F.concat(F.lit("mod(on/"), rate, F.lit(f",{style.cycle_s:.3f})"))
    shape = F.lit("0")
    for start, until, kind in reversed(zoom_phases(style)):
        since = phase if not start else F.concat(F.lit("("), phase, F.lit(f"-{start:.3f})"))
        value = {"in": F.concat(F.lit("(1-cos(PI*"), since, F.lit(f"/{go}))/2")), "held": F.lit("1"), "out": F.concat(F.lit("(1+cos(PI*"), since, F.lit(f"/{go}))/2"))}[kind]
        shape = F.concat(F.lit("if(lt("), phase, F.lit(f",{until:.3f}),"), value, F.lit(","), shape, F.lit(")"))
    larger = f"scale=iw*{upscale}:ih*{upscale}," if upscale > 1 else ""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.concat(F.lit(f"{larger}zoompan=z='1.0+{style.zoom:.4f}*("), shape, F.lit(")':d=1:x='iw/2-(iw/zoom/2)':y='ih/2-(ih/zoom/2)':s="), size, F.lit(":fps="), rate)


def wrap(words: Column, most: int, measure: Callable[[Column], Column]) -> Column:
    """Lines of words no wider than most, by measure of their text; a last line of one word gets the word before it, if that line keeps two."""

    def step(acc, w):
        probe = F.when(F.size(acc["open"]) == 0, w).otherwise(F.concat(F.array_join(acc["open"], " "), F.lit(" "), w))
        full = (F.size(acc["open"]) > 0) & (measure(probe) > most)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, F.array(w)).otherwise(F.concat(acc["open"], F.array(w))).alias("open"))

    start = F.struct(F.array().cast(LISTS).alias("done"), F.array().cast("array<string>").alias("open"))
    lines = F.aggregate(words, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return let(lines, lambda x: pull_back(x, most, measure))


def pull_back(lines: Column, most: int, measure: Callable[[Column], Column]) -> Column:
    n = F.size(lines)
    last, before = F.get(lines, n - 1), F.get(lines, n - 2)
    moved = F.concat(F.slice(before, -1, 1), last)
    can = (n >= 2) & (F.size(last) == 1) & (F.size(before) > 2) & (measure(F.array_join(moved, " ")) <= most)
    return F.when(can, F.concat(F.slice(lines, 1, F.greatest(n - 2, F.lit(0))), F.array(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), moved))).otherwise(lines)


def scale_filter(short_side: int) -> str:
    """Filter that scales the shorter side down to so many pixels; nothing for 0."""
    if not short_side:
        return ""
    return f"scale=w=min({short_side}\\,iw):h=min({short_side}\\,ih):force_original_aspect_ratio=increase:force_divisible_by=2"


def seconds_text(ms: Column) -> Column:
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)


def filter_graph(ranges: Column, short_side: int) -> Column:
    """Graph that trims picture and sound to each range, joins them, and scales once."""

    def one(r: Column, i: Column) -> Column:
        cut, k = F.concat(F.lit("start="), seconds_text(r["start_ms"]), F.lit(":end="), seconds_text(r["end_ms"])), i.cast("string")
        return F.concat(F.lit("[0:v]trim="), cut, F.lit(",setpts=PTS-STARTPTS[v"), k, F.lit("];[0:a]atrim="), cut, F.lit(",asetpts=PTS-STARTPTS[a"), k, F.lit("]"))

    pads = F.array_join(F.transform(ranges, lambda r, i: F.concat(F.lit("[v"), i.cast("string"), F.lit("][a"), i.cast("string"), F.lit("]"))), "")
    joined = F.concat(F.array_join(F.transform(ranges, one), ";"), F.lit(";"), pads, F.lit("concat=n="), F.size(ranges).cast("string"), F.lit(":v=1:a=1[outv][outa]"))
    scale = scale_filter(short_side)
    return F.concat(joined, F.lit(f";[outv]{scale}[scaled]")) if scale else joined


def overlay_graph(cues: Column, height: Column, signature: Column, style: Style = Style(), zoom: Column | None = None) -> Column:
    """Chain of overlays, one for each cue (start_ms, end_ms), shown in its time; the signature comes first, below them.

    zoom: a filter's text, or empty; it comes before all overlays, so that only the picture moves.
    """
    n = F.size(cues)
    margin = F.floor(height * F.when(signature, style.bottom + style.lift).otherwise(style.bottom)).cast("string")
    low = F.floor(height * style.signature_bottom).cast("string")
    zooms = F.lit(False) if zoom is None else zoom != ""
    picture = F.when(zooms, F.lit("[zoomed]")).otherwise(F.lit("[0:v]"))
    moved = F.when(zooms, F.concat(F.lit("[0:v]"), zoom if zoom is not None else F.lit(""), F.lit("[zoomed]")))
    first = F.when(signature, F.concat(picture, F.lit("["), (n + 1).cast("string"), F.lit(":v]overlay=x=(W-w)/2:y=H-h-"), low, F.lit("[sig]")))

    def one(c: Column, i: Column) -> Column:
        source = F.when(i > 0, F.concat(F.lit("[v"), (i - 1).cast("string"), F.lit("]"))).when(signature, F.lit("[sig]")).otherwise(picture)
        when = F.concat(seconds_text(c["start_ms"]), F.lit(","), seconds_text(c["end_ms"]))
        return F.concat(source, F.lit("["), (i + 1).cast("string"), F.lit(":v]overlay=x=0:y=H-h-"), margin, F.lit(":enable='between(t,"), when, F.lit(")'[v"), i.cast("string"), F.lit("]"))

    return F.array_join(F.array_compact(F.concat(F.array(moved, first), F.transform(cues, one))), ";")


def score_width(score: Column) -> Column:
    """Percent of a score's bar."""
    return F.round(score / 10 * 100, 0).cast("int")


def output_folder(path: Column) -> Column:
    """Where the clips of a recording go: beside it, by its name."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    return F.concat(F.when(folder == "", F.when(path.startswith("/"), "/").otherwise("./")).otherwise(F.concat(folder, F.lit("/"))), F.lit("CORTES_"), F.replace(stem, F.lit(" "), F.lit("_")))


def is_slot(text: Column) -> Column:
    """Digits, a colon, digits; hours and minutes aren't checked for range."""
    return text.rlike("^[0-9]+:[0-9]+$")
