"""Fill-in-the-middle: seeded cuts of documents at line borders, found in an index of distinct texts.

1. A digest stands for each text. Digests are counted; those of more than ``most`` rows are dealt in
   parts, and those whose rows differ in length or in a second hash are told apart by the text itself.
2. Index: texts meet their equals in one shuffle by key and are grouped by their whole content, so
   equality is verified, not assumed. Of each distinct text the ends of its lines are listed once, as
   an Elias-Fano code of about 2 + log2(length / lines) bits a line.
3. Documents join back by key as lists of ids, at most about ``most`` for each part, so a text crosses to
   Python once for each part. Each id's seed picks two borders, each read from the code by itself.

Texts are shuffled once: a text with one part is coded where its ids have met it, as that keeps the dealing
by key; one with several is coded first and then goes to each part, so a third of all rows isn't one task.

Defined cases: a null text is an empty one, and stays plain; a null doc_id has the seed of an empty
number; rows equal in id and text get equal results, each a row; texts that hold one of the three
markers stay plain; equal draws give an empty middle; a very long text is one index entry; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table

MARKERS = ("<P>", "<S>", "<M>")
EVERY = 256  # select starts at the nearest of these kept positions


# ---- Elias-Fano code of ascending numbers ----


def encode(ends: np.ndarray) -> bytes:
    """Ascending whole numbers as bytes: low bits side by side, high bits as a row of gaps, and each 256th one's place in it."""
    n = len(ends)
    if not n:
        return b""
    top = int(ends[-1])
    low = max(0, (top // n).bit_length() - 1)
    places = (ends >> low).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, np.uint8)
    high[places] = 1
    lows = ((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    head = np.array([n, low, len(high)], "<i8").tobytes()
    return head + places[::EVERY].astype("<i8").tobytes() + np.packbits(lows, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def length(code: bytes) -> int:
    return int.from_bytes(code[:8], "little") if code else 0


def select(code: bytes, i: int) -> int:
    """The i-th number, from 0, without reading the others: from the kept place at or before it on."""
    n, low, bits = (int(x) for x in np.frombuffer(code, "<i8", 3))
    kept = -(-n // EVERY)
    lows = 24 + 8 * kept
    highs = lows + (n * low + 7) // 8
    place = int(np.frombuffer(code, "<i8", 1, 24 + 8 * (i // EVERY))[0])
    left = i % EVERY
    while left:  # the next ones lie some bytes further
        first = place // 8
        part = np.unpackbits(np.frombuffer(code, np.uint8, min(64, (bits + 7) // 8 - first), highs + first), bitorder="little")
        ones = np.flatnonzero(part[place - 8 * first + 1 :])
        if len(ones) >= left:
            place, left = place + 1 + int(ones[left - 1]), 0
        else:
            place, left = 8 * first + len(part) - 1, left - len(ones)
    if not low:
        return place - i
    at = i * low
    word = int.from_bytes(code[lows + at // 8 : lows + (at + low + 7) // 8], "little") >> (at % 8)
    return ((place - i) << low) | (word & ((1 << low) - 1))


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, its line feed included, counted in code points."""
    if not text:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return ends if text[-1] == "\n" else np.append(ends, len(text))


# ---- cuts ----


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def parted(text: str, code: bytes, drawn: tuple[int, int, int, int], rate: int, spm: int, markers: tuple[str, str, str] = MARKERS):
    """(form, prefix's and middle's length, output) of one document."""
    if not text or any(m in text for m in markers) or drawn[2] % 100 >= rate:
        return "plain", None, None, text
    n = length(code)
    first, last = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = (select(code, k - 1) if k else 0 for k in (first, last))
    p, s, m = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < spm:
        return "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of, from output and form alone."""
    p, s, m = markers
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keyed_rows(docs: DataFrame, most: int, digest: Callable[[Column], Column], most_broadcast: int) -> tuple[DataFrame, bool]:
    """(doc_id, text, k, parts) of each row, and whether any key has more than one part."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", digest(F.col("text")))
    second = rows.select("h", F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("x")).alias("f"))
    facts = second.groupBy("h").agg(F.count("*").alias("rows"), (F.min("f") != F.max("f")).alias("clash"))
    special = cut(facts.where((F.col("rows") > most) | F.col("clash")).select("h", F.ceil(F.col("rows") / most).cast("long").alias("parts"), "clash"))
    n, hot = special.agg(F.count("*"), F.coalesce(F.max("parts"), F.lit(1))).first()
    met = rows.join(F.broadcast(special) if n <= most_broadcast else special, "h", "left")
    k = F.when(F.col("clash"), F.concat("h", F.col("text").cast("binary"))).otherwise(F.col("h"))
    return met.select("doc_id", "text", k.alias("k"), F.coalesce("parts", F.lit(1).cast("long")).alias("parts")), hot > 1


def with_ends(texts: DataFrame) -> DataFrame:
    """texts with ends: the code of each text's line ends."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            codes = pa.array([encode(line_ends(t.as_py())) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, codes], [*b.schema.names, "ends"])

    ship(texts.sparkSession)
    return texts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema) + ", ends binary")


def listed(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """(k, part if by names it, ids): ids with their number of rows, about ``most`` rows to a part. Equal rows are counted first."""
    of = rows.groupBy("k", "parts", "doc_id").agg(F.count("*").alias("many"))
    of = of.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / most))))
    many = F.least(F.lit(most).cast("long"), F.col("many") - F.col("share") * most)
    part = F.pmod(F.xxhash64("doc_id", "share"), F.col("parts"))
    return of.select("k", part.alias("part"), F.struct("doc_id", many.alias("many")).alias("id")).groupBy(*by).agg(F.collect_list("id").alias("ids"))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS, most: int = 10_000, digest: Callable[[Column], Column] = sha256, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output: a row for each row of docs (doc_id, text)."""
    rows, hot = keyed_rows(docs, most, digest, most_broadcast)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        out, held = [], 0
        for b in batches:
            for i in range(b.num_rows):  # one text at a time: a batch's texts aren't all held twice
                text, code = b.column("text")[i].as_py(), b.column("ends")[i].as_py()
                code = encode(line_ends(text)) if code is None else code
                for each in b.column("ids")[i].as_py():
                    told = parted(text, code, draws(seed, each["doc_id"]), rate, spm, markers)
                    for _ in range(each["many"]):
                        out.append((each["doc_id"], length(code), *told))
                        held += len(text)
                        if len(out) >= 5_000 or held > 8_000_000:
                            yield batch(out)
                            out, held = [], 0
        if out:
            yield batch(out)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    light, heavy = F.col("parts") == 1, F.col("parts") > 1
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.where(light).select("k", "text").repartition(n, "k").distinct()  # dealt by k for the join too
    out = texts.join(listed(rows.where(light), most, "k"), "k").select("text", F.lit(None).cast("binary").alias("ends"), "ids").mapInArrow(run, schema)
    if hot:
        few = rows.where(heavy).select("k", "text", "parts").distinct()  # each task sends a text once
        few = with_ends(few).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        out = out.unionByName(few.join(listed(rows.where(heavy), most, "k", "part"), ["k", "part"]).select("text", "ends", "ids").mapInArrow(run, schema))
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
x AS (
  SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM x),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
