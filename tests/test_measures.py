"""Measured lines, zoom expressions evaluated back, and quiet frames."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chronofold.functions import layout as L
from chronofold.functions.measured import Glyphs, wrap_measured
from chronofold.operators import frames


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


FONT = {"i": 3.0, "m": 15.5, " ": 4.25, "é": 9.0, "𝄞": 20.0}


def greedy(words, most):
    width = lambda t: sum(FONT.get(c, 10.0) for c in t)
    lines = []
    for w in words:
        if lines and width(" ".join([*lines[-1], w])) <= most:
            lines[-1].append(w)
        else:
            lines.append([w])
    if len(lines) > 1 and len(lines[-1]) == 1 and len(lines[-2]) > 2 and width(" ".join([lines[-2][-1], *lines[-1]])) <= most:
        lines[-1].insert(0, lines[-2].pop())
    return [" ".join(x) for x in lines]


@pytest.mark.parametrize("most", [1, 60, 200])
def test_lines_equal_a_greedy_wrap(spark, most):
    r = random.Random(most)
    texts = [[], None, ["mmmmmmmmmmmmmmmmmmmmmmm"], ["a"]] + [["".join(r.choice("iimaé𝄞b") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 40))] for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, words array<string>")
    got = {x.k: x.lines for x in df.select("k", wrap_measured(F.col("words"), most, Glyphs(FONT, 10.0)).alias("lines")).collect()}
    assert got == {k: greedy(t or [], most) for k, t in enumerate(texts)}


def test_equal_widths_agree_with_the_fold(spark):
    words = F.split(F.lit("um dois tres quatro cinco seis sete oito nove dez onze doze"), " ")
    plain = one(spark, F.transform(L.wrap(words, 140, lambda t: F.length(t) * 10), lambda x: F.array_join(x, " ")))
    assert one(spark, wrap_measured(words, 140, Glyphs({}, 10.0))) == plain


@pytest.mark.parametrize("style", [L.Style(), L.Style(transition_s=0.01, hold_s=0.0), L.Style(zoom=0.3, transition_s=2.5, hold_s=-1.0), L.Style(zoom=0.05, hold_s=20.0)])
def test_zoom_text_evaluates_to_the_curve(spark, style):
    fps = 29.97
    text = one(spark, L.zoom_filter(F.lit(1080), F.lit(1920), F.lit(fps), style))
    assert text.startswith("scale=iw*2:ih*2,zoompan=z='") and text.endswith(":s=1080x1920:fps=29.970000")
    told = re.search("z='([^']*)'", text)[1].replace("if(", "iff(")
    names = {"iff": lambda c, a, b: a if c else b, "lt": lambda a, b: a < b, "mod": math.fmod, "cos": math.cos, "PI": math.pi}
    frames_ = [0, 1, 7, 33, 90, 121, 299, 400, 777, 1203, 4001]
    if style.hold_s >= 0:
        curve = one(spark, F.transform(F.array(*map(F.lit, frames_)), lambda n: L.zoom(n / fps, style)))
        for n, want in zip(frames_, curve):
            assert eval(told, {"__builtins__": {}}, names | {"on": n}) == pytest.approx(want, abs=2e-3)
    assert one(spark, L.zoom_filter(F.lit(1), F.lit(1), F.lit(30), L.Style(zoom=0.0))) == ""
    assert one(spark, L.zoom_filter(F.lit(2), F.lit(1), F.lit(30), upscale=1)).startswith("zoompan=")


def test_zoom_comes_before_overlays(spark):
    cues = F.array(F.struct(F.lit(0).cast("long").alias("start_ms"), F.lit(1500).cast("long").alias("end_ms")))
    graph = lambda signed, zoom: one(spark, L.overlay_graph(cues, F.lit(1000), F.lit(signed), zoom=zoom))
    assert graph(True, F.lit("Z")).startswith("[0:v]Z[zoomed];[zoomed][2:v]overlay=x=(W-w)/2") and "[sig][1:v]overlay" in graph(True, F.lit("Z"))
    assert graph(False, F.lit("Z")).startswith("[0:v]Z[zoomed];[zoomed][1:v]overlay=x=0") and graph(False, F.lit("")) == graph(False, None)


def test_quiet_frames_equal_a_plain_loop(spark):
    r = random.Random(5)
    rows = [(m, i, None if r.random() < 0.02 else (0.0 if 400 <= i < 900 else r.uniform(-1, 1) * (0.1 if i // 300 % 2 else 1))) for m in ("a", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "media_id string, i long, x double")
    want = set()
    for m in ("a", "b"):
        run = []
        for f in range(0, 3000 // 50 + 1):
            x = [v for k, i, v in rows if k == m and i // 50 == f and v is not None]
            low = bool(x) and sum(v * v for v in x) / len(x) < 10 ** (-20 / 10)
            if low:
                run.append(f)
            elif run:
                want |= {(m, run[0] * 500, (run[-1] + 1) * 500, len(run))} if len(run) * 500 >= 1500 else set()
                run = []
    for span in (None, 2000):
        assert {tuple(x) for x in frames.quiet(df, 50, 100, -20.0, 1500, span).collect()} == want and len(want) > 3
    silent = frames.levels(df.where("i between 400 and 449"), 50).first()
    assert silent.db is None and silent.power == 0
