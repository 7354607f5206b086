"""Fill-in-the-middle: the code of line ends, cuts against plain Python, hot and clashing texts, odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.llm import fill_middle as M

SF = "/root/testdata/sf0.001"


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=900))
@settings(max_examples=60, deadline=None)
def test_code_gives_each_number_back(gaps):
    ends = np.cumsum(np.array(gaps, np.int64))
    code = M.encode(ends)
    assert M.length(code) == len(ends) and [M.select(code, i) for i in range(0, len(ends), 7)] == ends[::7].tolist()


def test_code_is_small():
    ends = np.cumsum(np.random.RandomState(1).randint(1, 120, 10_000))
    assert len(M.encode(ends)) * 8 < 10_000 * (2 + np.log2(ends[-1] / 10_000) + 1)


def plainly(doc_id, text, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, _, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(lines), "plain", None, None, text, text
    i, j = sorted((a % (len(lines) + 1), b % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    form = "spm" if d % 100 < 50 else "psm"
    return doc_id, len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def told(df, **options):
    out = M.transform(df, **options).withColumn("back", M.restored(F.col("output"), F.col("form")))
    return Counter(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "\n", "a", "a\n", "\n\na\n\nb", "x<P>y\nz", "<\n<S\n<M", "ä\r\n𝄞 𝄞 b\n", "no end " * 20_000, "line\n" * 30_000, "nul\x00l\nx"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "twice\nover")] * 5 + [(7, "same\nrow\n")] * 4 + [(i, "copy\nof\nmany") for i in range(1000, 1300)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, k string, parts int")


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"most": 40, "most_broadcast": 0}, {"digest": lambda t: F.substring(t, 1, 1).cast("binary")}, {"digest": lambda t: F.lit(b"one"), "most": 50}], ids=["plain", "parts", "joined", "clash", "all clash"])
def test_cuts_equal_plain_python(odd, options):
    rows, df = odd
    assert told(df, **options) == Counter(plainly(*r) for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert told(docs) == Counter(plainly(*r) for r in docs.collect())


def test_same_rows_as_sql(spark):
    assert not difference(M.op13(spark, SF), M.ORACLE, SF)


def test_rate_and_share(spark):
    docs = spark.createDataFrame([(i, f"a\nb {i}\nc") for i in range(2000)], "doc_id long, text string")
    forms = Counter(r.form for r in M.transform(docs, rate=50, spm=20).select("form").collect())
    assert 900 < forms["plain"] < 1100 and 130 < forms["spm"] < 270


def test_empty(spark):
    assert M.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
