"""Stages and operators do the whole job: one small case for each cut that was taken back."""

import re
from collections import Counter

from chronofold.llm import decontaminate, mixing, near_dedup, secret_scan, surrogates, url_filter

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text, size):
    w = [x for x in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def kept_by_brute_force(texts, size=5):
    """Ids that stay: the smallest of each component of texts."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}


def test_near_dedup_stage_by_brute_force_of_five_words(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = [f"w{k}" for k in range(200)]
    edited = lambda at: " ".join("new" if k in at else w for k, w in enumerate(words))
    # 1 of 200 words edited: 0.95 by five words; 8 of 200: 0.66 by five words, 0.85 by two
    texts |= {10**6: edited(()), 10**6 + 1: edited({50}), 10**6 + 2: edited(set(range(10, 200, 25)))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.stage(spark, docs, SF).collect()}
    assert kept == kept_by_brute_force(texts) and 10**6 + 2 in kept and 10**6 + 1 not in kept
    assert 10**6 + 2 not in kept_by_brute_force(texts, size=2)


def test_near_dedup_stage_judges_rows_not_ids(spark):
    """Rows without an id lose copies only; a repeated id keeps each of its different texts."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near = a.replace("a59", "z")
    rows = [(None, a, "1"), (None, a, "2"), (5, a, "3"), (2, near, "4"), (2, b, "5"), (1, b, "6"), (None, c, "7"), (None, c, "8"), (None, d, "9"), (2, d, "10"), (3, "", "11"), (3, "", "12"), (None, None, "13"), (None, " ", "14"), (9, d + " x", "15"), (9, d + " x", "15")]
    got = near_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(2, near), (1, b), (None, c), (2, d), (3, ""), (3, ""), (None, None), (None, " ")])


def test_decontamination_judges_rows_not_ids(spark):
    item = " ".join(f"w{k}" for k in range(10))
    rows = [(None, "x " + item), (None, "clean one"), (None, None), (7, item), (7, "clean two"), (8, item + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(None, "clean one"), (None, None), (7, "clean two")], key=str)


def test_mix_keeps_equal_rows_of_two_sources_apart(spark):
    rows = [(1, "one two three", s) for s in ("a", "b", None)] + [(k, "four five", s) for k in (2, 3) for s in ("a", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = Counter({r.source: r.n for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()})
    made = Counter()
    for r in mixing.mixed(docs).collect():
        made[r.source] += len(r.text.split())
    assert made == plan and len(plan) == 3


def test_secret_scan_reads_whole_candidates(spark):
    """A key at the end of a long path counts, the path alone doesn't: their first 44 characters are equal."""
    path, key = "/srv/backup/2024/settings/production/release/of/the/internal/system/", "ghp_x7Kq2mZ9vB4nR8tL1wY5cD3fG6hJ0pS2aXeU"
    harmless = "readme_of_the_old_version"
    docs = spark.createDataFrame([(1, f"see {path}{key} there"), (2, f"see {path}{harmless} there"), (3, f"see {path * 30}{key} there")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, secret_scan.fit([])).collect()}
    assert got == {1: f"cnn:4:{4 + len(path + key)}", 2: "", 3: f"cnn:4:{4 + len(path * 30 + key)}"}


def test_secret_scan_windows_hold_candidate_and_both_sides():
    text = "".join(chr(97 + k % 26) for k in range(400))
    for a, b in ((0, 12), (5, 60), (30, 54), (30, 55), (100, 380)):
        rows = secret_scan.windows(text, a, b)
        said = {k: row for i, row in enumerate(rows) for k, row in zip(range(a - 20 + 24 * i, a + 44 + 24 * i), row, strict=True)}
        inside = {k for k, c in said.items() if c > len(secret_scan.ALPHABET)}
        assert inside == set(range(a, b)) and set(range(a - 20, b + 20)) <= set(said)


def test_secret_scan_threshold_keeps_recall_below_a_half():
    """Three in ten of alike findings are secrets: the threshold must not exceed their calibrated chance."""
    findings = [("see abcdefgh1234 there", 4, 16, int(k % 10 < 3)) for k in range(300)]
    net = secret_scan.fit(findings, made=0)
    assert net.chances([secret_scan.windows("see abcdefgh1234 there", 4, 16)])[0] >= net.threshold


def test_whole_names_and_their_untitled_mentions_go(spark):
    texts = ["Mr Vincent van Gogh came. Vincent met Gogh's friend.", "Dr John A. Smith left; then Smith slept.", "Señora Ana María López García sings.", "Frau von der Leyen and Mr O'Brien's son", "Dr 田中 came, 田中 left", "Mr Smith walks home", "Prof. Łukasz Żak-Nowak spoke", "Monsieur d'Artagnan and d'Artagnan"]
    clear = [("Vincent", "Gogh"), ("John", "A.", "Smith"), ("Ana", "María", "López", "García"), ("Leyen", "O'Brien"), ("田中",), ("Smith",), ("Nowak",), ("Artagnan",)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replaced(docs).collect()}
    for k, words in enumerate(clear):
        assert not [w for w in words if re.search(rf"(?<!\w){re.escape(w)}", got[k].text)], got[k].text
    first = got[0].text.split()
    assert first[2] == "van" and first[5] == first[1] and first[7] == first[3] + "'s"
    assert got[0].n_name == 3 and got[1].n_name == 2 and got[4].n_name == 2
    assert got[5].text.endswith(" walks home") and got[3].text.endswith("'s son")


def test_distrust_reaches_far_hosts_and_hosts_with_ports(spark):
    """A host 30 links from the only blocked page, and one with a port, are judged by their distrust."""
    link = lambda k: f"<a href='http://h{k}:8080/'>"
    rows = [(0, "http://bad.net/es/x", None), (1, "http://u@h1:8080/", "<a href='http://bad.net/'>")] + [(k, f"http://h{k}:8080/", link(k - 1)) for k in range(2, 31)]
    got = {r.page_id: (r.host, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: ("bad.net", "block"), 1: ("u@h1:8080", "block")} | {k: (f"h{k}:8080", "block") for k in range(2, 31)}
