"""PII: keyed, type-consistent surrogates for detected entities.

``detect`` finds emails, phone numbers, payment cards, IPv4 addresses and titled names. A surrogate
is a keyed permutation of the entity's own format: letters become letters of the same script and
case, digits become digits, everything else stays. A permutation maps different entities of one
format to different surrogates, and equal ones (after folding case and blanks) to equal ones, so
distinctness and coreference hold over the whole corpus without a shared table. Cards keep their
first digit and their checksum's validity; addresses stay within 0-255; given names that are known
are permuted within their gender's and script's list; an email's domain is replaced alike wherever
it appears, its top-level part stays. Words of a titled name that stand alone elsewhere in its text get
the same word of its surrogate and count as names; small words (van, de) stay.

Collision check: all distinct (entity, surrogate) pairs are gathered in Spark; surrogates that equal
an entity of the corpus, or that two entities share, are drawn again under the next key until they
are new, in joins, until none is left. From the third redraw on given names leave their list and are
permuted like other words, and from the sixth on emails and names grow by a drawn letter at each, so that a
format whose surrogates are all taken ends too. The redrawn entities go back as a broadcast while they
are at most ``most_exceptions``; beyond that they are joined with the mentions of each row.

Defined cases: a null text stays null; an empty one stays empty; a very long one is read whole; overlapping
finds: the earlier, then the longer, then the first kind of email, ip, card, name, phone in code
order counts; rows that repeat get equal results; an empty table gives an empty result; other columns are
kept by ``replaced``, but for those named n_ and a kind, which are replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, quoted, ship, table

KEY = b"chronofold-surrogates"
#: What the detectors look for.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
CARD = re.compile(r"(?<![\w.-])[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)")
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Dr": "", "Prof": ""}
#: Small words inside a name, which stay; a further word must follow them.
SMALL = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "das", "du", "la", "le", "las", "los", "ter", "ten", "zu", "zur", "bin", "ibn", "al", "el", "y", "e")
_UP = "[" + "".join(c for c in map(chr, range(0x41, 0x2C00)) if c.isupper() or c.istitle()) + "]"
_WORD = rf"(?:[dl]['’](?={_UP}))?{_UP}[^\W\d_]*(?:['’]{_UP}[^\W\d_]*|-[^\W\d_]+)*"
_NEXT = rf"(?:(?:{_UP}\.-?)+|{_WORD})"
_SMALLS = rf"(?:(?:{'|'.join(SMALL)}) )*"
#: A title and a name: words, initials and small words as far as they go; of a script without case, one word.
NAME = re.compile(rf"\b({'|'.join(TITLES)})(\.? )({_SMALLS}{_NEXT}(?: {_SMALLS}{_NEXT})*|(?![A-Za-zÀ-ɏͰ-ӿ])[^\W\d_]+)")
GIVEN = {
    "m": (
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Pierre", "Jean", "Carlos", "José",
        "Joseph", "Charles", "Daniel", "Matthew", "Mark", "George", "Edward", "Henry", "Jürgen", "Wolfgang", "Dieter", "Stefan", "Michel", "Philippe", "François", "Luis", "Miguel", "Javier", "Pedro", "Diego",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Sarah", "Anna", "Ursula", "Monika", "Marie", "Claire", "Carmen", "Lucía", "Sofía",
        "Margaret", "Nancy", "Helen", "Emily", "Laura", "Alice", "Julia", "Emma", "Petra", "Sabine", "Renate", "Ingrid", "Nathalie", "Isabelle", "Sophie", "Camille", "María", "Ana", "Elena", "Isabel",
    ),
}
KINDS = ("email", "phone", "card", "ip", "name")
#: First and last characters of the ranges that letters and digits are drawn from; others stay.
ALPHABETS = ("09", "az", "AZ", "àö", "øÿ", "ÀÖ", "ØÞ", "ая", "АЯ", "αρ", "σω", "ΑΡ", "ΣΩ", "את", "ءغ", "في", "ぁゖ", "ァヺ", "一龥", "가힣")


def _draw(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256")[:16], "big")


@cache
def _range_of(c: str) -> tuple[int, int] | None:
    """First code point and size of the range that c is drawn from."""
    return next(((ord(lo), ord(hi) - ord(lo) + 1) for lo, hi in ALPHABETS if lo <= c <= hi), None)


def permuted(text: str, key: bytes, salt: str) -> str:
    """A keyed permutation of the strings of text's format: a Feistel network over its positions.

    The format is the range of each character, or the character itself if it has none.
    """
    spots = [(i, *r) for i, c in enumerate(text) if (r := _range_of(c))]
    if not spots:
        return text
    form = "".join(chr(r[0]) if (r := _range_of(c)) else c for c in text)
    value = [ord(text[i]) - first for i, first, _ in spots]
    sizes = [n for _, _, n in spots]
    half = len(value) // 2

    def number(lo: int, hi: int) -> int:
        out = 0
        for v, n in zip(value[lo:hi], sizes[lo:hi], strict=True):
            out = out * n + v
        return out

    def put(lo: int, hi: int, x: int) -> None:
        for k in range(hi - 1, lo - 1, -1):
            x, value[k] = divmod(x, sizes[k])

    def space(lo: int, hi: int) -> int:
        out = 1
        for n in sizes[lo:hi]:
            out *= n
        return out

    for turn in range(8):
        lo, hi, other = (0, half, number(half, len(value))) if turn % 2 else (half, len(value), number(0, half))
        if hi > lo:
            put(lo, hi, (number(lo, hi) + _draw(key, salt, form, turn, other)) % space(lo, hi))
    out = list(text)
    for (i, first, _), v in zip(spots, value, strict=True):
        out[i] = chr(first + v)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10


def norm(kind: str, entity: str) -> str:
    """What two mentions of one entity share."""
    return entity.lower() if kind == "email" else re.sub(r"[^\d+]", "", entity) if kind in ("phone", "card") else entity


def _grown(entity: str, key: bytes, attempt: int) -> str:
    """Letters that a late redraw adds, as many as it takes."""
    return "".join(chr(97 + _draw(key, entity, attempt, k) % 26) for k in range(attempt - 5))


def surrogate(kind: str, entity: str, key: bytes = KEY, attempt: int = 0) -> str:
    salt = f"{kind}/{attempt}"
    if kind == "email":
        user, _, host = entity.lower().partition("@")
        labels = host.split(".")
        at = ".".join([permuted(x, key, f"domain/{attempt}") for x in labels[:-1]] + labels[-1:])
        new = permuted(user, key, salt)
        return "".join(n.upper() if o.isupper() else n for o, n in zip(entity, new + "@" + at, strict=True)).replace("@", _grown(entity, key, attempt) + "@")
    if kind in ("card", "phone"):
        digits = re.sub(r"\D", "", entity)
        # a card keeps its first digit, a number with + its country's code (one digit for 1 and 7, else two)
        keep = 1 if kind == "card" or (entity[0] == "+" and digits[0] in "17") else 2 if entity[0] == "+" else 0
        new = digits[:keep] + permuted(digits[keep : -1 if kind == "card" else None], key, salt)
        if kind == "card":
            # the last digit keeps its distance from the one the checksum asks for: still a permutation
            distance = (int(digits[-1]) - (-_luhn(digits[:-1] + "0"))) % 10
            new += str((-_luhn(new + "0") + distance) % 10)
        left = iter(new)
        return "".join(next(left) if c.isdigit() else c for c in entity)
    if kind == "ip":
        parts = [int(x) for x in entity.split(".")]
        for turn in range(8):  # Feistel network over two halves of 16 bits
            a, b = parts[0] * 256 + parts[1], parts[2] * 256 + parts[3]
            a, b = b, (a + _draw(key, salt, turn, b)) % 65536
            parts = [a // 256, a % 256, b // 256, b % 256]
        return ".".join(map(str, parts))
    m = NAME.fullmatch(entity)
    gender, (given, *more) = TITLES[m[1]], m[3].split(" ")
    lists = [g for g, names in GIVEN.items() if given in names and gender in ("", g)]
    if lists and attempt < 3:
        names = sorted(GIVEN[lists[0]], key=lambda n: _draw(key, salt, lists[0], n))
        at = names.index(given)
        # none of the name's own words
        given = next(n for n in (names[(at + k) % len(names)] for k in range(1, len(names) + 1)) if n not in more)
    else:
        lists, more = [], [given, *more]
    new = [x if x in SMALL else permuted(x, key, salt) for x in more]
    return m[1] + m[2] + " ".join([given, *new] if lists else new) + _grown(entity, key, attempt)


def untitled(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(start, end, name, place): words of the text's titled names that stand alone elsewhere in it."""
    of: dict[str, tuple[str, int]] = {}
    for a, b, kind in found:
        if kind == "name":
            for k, word in enumerate(NAME.fullmatch(text[a:b])[3].split(" ")):
                if len(word) > 1 and word not in SMALL and not word.endswith("."):
                    of.setdefault(word, (text[a:b], k))
    if not of:
        return []
    cased = lambda w: w.lower() != w.upper()
    any_of = re.compile("|".join(rf"\b{re.escape(w)}\b" if cased(w) else re.escape(w) for w in sorted(of, key=len, reverse=True)))
    out, k = [], 0
    for m in any_of.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or found[k][0] >= m.end():
            out.append((m.start(), m.end(), *of[m[0]]))
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, by start, without overlaps."""
    found = []
    if "@" in text:
        found += [(m.start(), -m.end(), "email") for m in EMAIL.finditer(text)]
    if _DIGITS.search(text):
        found += [(m.start(), -m.end(), kind) for kind, p in (("card", CARD), ("ip", IP), ("phone", PHONE)) for m in p.finditer(text)]
    if any(t in text for t in TITLES):
        found += [(m.start(), -m.end(), "name") for m in NAME.finditer(text)]
    out, to = [], 0
    for a, b, kind in sorted(found):
        if a >= to:
            out.append((a, -b, kind))
            to = -b
    return out


_DIGITS = re.compile(r"\d")


def entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity (normalised), mention, surrogate: distinct over the corpus, one mention each."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen = {}
            for t in batch.column(0).to_pylist():
                for a, b, kind in detect(t) if t else []:
                    seen.setdefault((kind, norm(kind, t[a:b])), t[a:b])
            rows = [(k, e, m, norm(k, surrogate(k, m, key))) for (k, e), m in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["kind", "entity", "mention", "surrogate"])

    found = docs.select("text").mapInArrow(run, "kind string, entity string, mention string, surrogate string")
    return found.groupBy("kind", "entity").agg(F.min_by(F.struct("mention", "surrogate"), "mention").alias("m")).select("kind", "entity", "m.*")


def exceptions(docs: DataFrame, key: bytes = KEY, attempts: int = 60) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate collides: the draw that is new."""
    pairs = cut(entities(docs, key))
    used = pairs.select("kind", F.col("entity").alias("surrogate")).union(pairs.select("kind", "surrogate"))
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1")
    taken = pairs.join(pairs.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity", "mention")
    twice = pairs.join(shared, ["kind", "surrogate"]).where("entity <> first").select("kind", "entity", "mention")
    left = cut(taken.union(twice).distinct())
    done = docs.sparkSession.createDataFrame([], "kind string, entity string, attempt int")

    def draw(n: int):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                kinds, entity, mention = (batch.column(i).to_pylist() for i in range(3))
                new = [norm(k, surrogate(k, m, key, n)) for k, m in zip(kinds, mention, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kinds, entity, new)], ["kind", "entity", "surrogate"])

        return run

    n = 0
    while not left.isEmpty():
        n += 1
        if n > attempts:  # of formats that can't grow, a whole number space would have to be taken
            raise RuntimeError(f"no new surrogate in {attempts} draws for {[tuple(r) for r in left.select('kind', 'entity').limit(5).collect()]}")
        fresh = left.mapInArrow(draw(n), "kind string, entity string, surrogate string").join(used, ["kind", "surrogate"], "left_anti")
        won = cut(fresh.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")))
        used, done = used.union(won.select("kind", "surrogate")), done.union(won.select("kind", "entity", F.lit(n)))
        left = cut(left.join(won, ["kind", "entity"], "left_anti"))
    return done


def _with_attempts(docs: DataFrame, redrawn: DataFrame) -> DataFrame:
    """docs with a map, again, of the redrawn entities that each row's text mentions."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(r, k, norm(k, t[a:b])) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for a, b, k in detect(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]], ["at", "kind", "entity"])

    held = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    met = held.select("row", "text").mapInArrow(run, "at long, kind string, entity string").distinct().join(redrawn, ["kind", "entity"])
    maps = met.groupBy(F.col("at").alias("row")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit(":"), "entity"), "attempt"))).alias("again"))
    return held.join(maps, "row", "left").drop("row")


def replaced(docs: DataFrame, key: bytes = KEY, most_exceptions: int = 10_000) -> DataFrame:
    """docs with surrogates in text, and n_<kind> (long) of each kind of entity."""
    ship(docs.sparkSession)
    redrawn = cut(exceptions(docs, key))
    few = redrawn.count() <= most_exceptions
    shared = {f"{r.kind}:{r.entity}": r.attempt for r in redrawn.collect()} if few else {}
    rest = [c for c in docs.columns if c != "text" and c not in {f"n_{k}" for k in KINDS}]
    held = [f"c{i}" for i in range(len(rest))]  # plain names on the way through Python

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            names = batch.schema.names
            own = batch.column(names.index("again")).to_pylist() if not few else [None] * len(batch)
            for t, mine in zip(batch.column(names.index("text")).to_pylist(), own, strict=True):
                again = dict(mine) if mine else shared
                found = detect(t) if t else []
                parts, to = [], 0
                draw = lambda kind, e, again=again: surrogate(kind, e, key, again.get(f"{kind}:{norm(kind, e)}", 0))
                alone = untitled(t, found) if found else []
                for a, b, kind, name, k in sorted([(*x, "", 0) for x in found] + [(a, b, "name", name, k) for a, b, name, k in alone]):
                    parts += [t[to:a], draw("name", name)[NAME.fullmatch(name).start(3) :].split(" ")[k] if name else draw(kind, t[a:b])]
                    to = b
                texts.append(t if not found else "".join([*parts, t[to:]]))
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in found) + (len(alone) if k == "name" else 0))
            arrays = [batch.column(names.index(c)) for c in held] + [pa.array(texts, pa.string())] + [pa.array(counts[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(arrays, [*held, "text", *[f"n_{k}" for k in KINDS]])

    given = docs.select(*[quoted(c).alias(h) for c, h in zip(rest, held)], "text")
    schema = StructType(given.schema.fields + [StructField(f"n_{k}", LongType()) for k in KINDS])
    out = (given if few else _with_attempts(given, redrawn)).mapInArrow(run, schema)
    return out.toDF(*rest, "text", *[f"n_{k}" for k in KINDS])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
