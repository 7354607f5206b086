"""License scan against brute force over every block and template; edited, wrapped and foreign texts; odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from compare import difference

from chronofold.llm import license_scan as L

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPLIT.split((text or "").translate(LOWER)) if w]


def plainly(rows, templates=L.TEMPLATES):
    of = []
    for label, least, text in templates:
        w = words(text)
        if label is not None and least is not None and w:
            size = len(set(w))
            of.append((label, set(w), max(1, min(size, math.ceil(round(least * size, 9)))), max(16, 2 ** math.ceil(math.log2(len(w))))))
    out = []
    for doc_id, text in rows:
        w = words(text)
        base = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        links = []
        for c in {t[3] for t in of}:
            for at in range(0, max(0, len(w) - c - 1) + 1, c):
                block = set(w[at : at + 2 * c])
                met = [t for t in of if t[3] == c and len(block & t[1]) >= t[2]]
                links += [(t[0], at, min(len(w), at + 2 * c), len(block & t[1]) / len(t[1])) for t in met if not any(y[0] != t[0] and t[1] < y[1] for y in met)]
        own = {b for _, b in base}
        ends = (base[0][0], base[-1][0]) if base else (None, None)
        score = 1.0 if base else max((x[3] for x in links), default=0.0)
        out.append((doc_id, len(w), len(base), *ends, ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in links})), round(score, 9), tuple(sorted(links))))
    return Counter(out)


def told(df, templates, **options):
    got = L.scan(df, templates, **options).collect()
    return Counter((*r[:7], round(r.score, 9), tuple(sorted((x.label, x.first, x.end, x.containment) for x in r.links))) for r in got)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(11)
    prose = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you one we were all her she there would their".split()
    texts = [None, "", "   ", "word", "MIT License\nmit-license, the MIT\nlicense! Apache LICENSE GNU General Public License", "general public licensed mit licenses ümit license"]
    for label, _, text in L.TEMPLATES:
        w = text.split()
        for _ in range(3):
            kept = [x for x in w if r.random() > r.choice([0, 0.1, 0.2, 0.3])]
            around = lambda: [r.choice(prose) for _ in range(r.randrange(90))]
            texts.append("\n * ".join([*around(), *kept, *around()]))
    texts += [" ".join(r.choice(prose) for _ in range(30_000)) + " Licensed under CC BY 4.0 " + " ".join(r.choice(prose) for _ in range(40))]
    texts += ["Licensed under CC BY-NC 4.0. SPDX-License-Identifier: MIT", "licensed under cc by 4 0 and licensed under cc by-sa 4.0"]
    rows = [*enumerate(texts), (3, texts[9]), (3, texts[9]), (None, texts[10]), (None, texts[10]), (None, None)]
    return rows, spark.createDataFrame([(*x, "clash", 1, []) for x in rows], "doc_id long, text string, h string, _row int, links array<int>").repartition(3)


@pytest.mark.parametrize("options", [{}, {"most_tokens": 0}, {"most_offers": 0}, {"most_tokens": 0, "most_offers": 0}], ids=["plan", "ranked", "joined", "both joined"])
def test_every_link_by_brute_force(spark, odd, options):
    rows, df = odd
    want = plainly(rows)
    assert told(df, L.templates_table(spark), **options) == want
    assert {x[6] for x in want} >= {"cc-by", "cc-by-nc,mit", "bsd", "isc", "mpl"}


def test_odd_templates(spark):
    some = [("x", 0.5, "alpha beta gamma delta"), ("x", 0.5, "alpha beta gamma delta"), ("y", 0.0, "beta"), ("z", 1.0, ""), (None, 1.0, "alpha"), ("n", None, "alpha"), ("big", 0.4, " ".join(f"w{i} alpha" for i in range(50)))]
    rows = [(1, "alpha beta"), (2, "beta delta gamma"), (3, "delta"), (4, " ".join(f"w{i}" for i in range(0, 100, 2)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame(some, "label string, least double, text string")
    assert told(df, t) == plainly(rows, some) == told(df, t, most_tokens=0, most_offers=0)
    none = t.limit(0)
    assert [r.labels for r in L.scan(df, none).collect()] == [""] * 4 and L.scan(df.limit(0), t).count() == 0
    assert [r.labels for r in L.scan(df, none, most_tokens=-1).collect()] == [""] * 4


def test_whole_table(spark):
    assert not difference(L.op11(spark, SF), L.ORACLE, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert told(docs, L.templates_table(spark)) == plainly([tuple(r) for r in docs.collect()])


def test_no_python_in_the_plan(spark):
    plan = L.op11(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_share_of_a_wrapped_notice(spark):
    text = "\n".join("// " + " ".join(L.TEMPLATES[7][2].split()[i : i + 5]) for i in range(0, 40, 5))
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), L.templates_table(spark)).first()
    assert got.labels == "bsd" and got.base_labels == "" and got.score > 0.9
