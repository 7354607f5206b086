"""Caption packing: greedy chunks, dangling words, balanced lines, time shares, word groups.

Each is a fold over an array, so an utterance is packed within its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import FUNCTION_WORDS

WORDS = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
GROUPS = f"array<{WORDS}>"
LISTS = "array<array<string>>"
#: Marks that don't count as part of a function word.
MARKS = ".,;:!?…\"'()"


def is_function_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, f"^[{MARKS}]+|[{MARKS}]+$", "")).isin(*FUNCTION_WORDS)


def greedy_chunks(words: Column, limit: int) -> Column:
    """Runs of words of at most limit characters, blanks included; a longer word stands alone."""

    def step(acc, w):
        room = F.when(acc["size"] == 0, F.length(w)).otherwise(acc["size"] + 1 + F.length(w))
        fits = (acc["size"] == 0) | (room <= limit)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.array(w))).otherwise(F.array(w)).alias("open"),
            F.when(fits, room).otherwise(F.length(w)).alias("size"),
        )

    start = F.struct(F.array().cast(LISTS).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
    return F.aggregate(words, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def push_dangling(chunks: Column) -> Column:
    """Function words at a chunk's end move to the next chunk; a chunk keeps one word, limits aren't checked again."""
    return let(chunks, _pushed)


def _pushed(chunks: Column) -> Column:
    def step(acc, i):
        words = F.concat(acc["carry"], F.get(chunks, i))
        n = F.size(words)
        last = i == F.size(chunks) - 1
        # how many words at the end are function words, at most all but the first
        tail = F.aggregate(F.reverse(F.slice(words, 2, F.greatest(n - 1, F.lit(0)))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + F.when(a["on"] & is_function_word(w), 1).otherwise(0)).alias("n"), (a["on"] & is_function_word(w)).alias("on")))["n"]
        moved = F.when(last, F.lit(0)).otherwise(tail)
        return F.struct(F.concat(acc["done"], F.array(F.slice(words, 1, n - moved))).alias("done"), F.slice(words, n - moved + 1, F.greatest(moved, F.lit(0))).alias("carry"))

    start = F.struct(F.array().cast(LISTS).alias("done"), F.array().cast("array<string>").alias("carry"))
    return F.when(F.size(chunks) > 0, F.aggregate(F.sequence(F.lit(0), F.size(chunks) - 1), start, step)["done"]).otherwise(chunks)


def two_lines(words: Column, limit: int = 40) -> Column:
    """Text over the limit splits at the word nearest the middle (the earlier of two), not after a function word; else at the middle. One word stays one line."""
    return let(words, lambda w: _two_lines(w, limit))


def _two_lines(words: Column, limit: int) -> Column:
    text, n = F.array_join(words, " "), F.size(words)
    middle = F.floor(n / 2).cast("int")
    spots = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.abs(k - middle).alias("off"), k.alias("k")))
    good = F.filter(spots, lambda s: ~is_function_word(F.get(words, s["k"] - 1)))
    best = F.coalesce(F.array_min(good)["k"], middle)
    return F.when((F.length(text) <= limit) | (n < 2), text).otherwise(F.concat(F.array_join(F.slice(words, 1, best), " "), F.lit("\n"), F.array_join(F.slice(words, best + 1, n), " ")))


def time_shares(chunks: Column, start: Column, end: Column, least: int = 700) -> Column:
    """Each chunk's time by its share of characters, at least ``least``, capped at the end; empty ones go."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    return let(F.struct(chunks.alias("c"), start.cast("long").alias("a"), end.cast("long").alias("b")), lambda x: let(total(x["c"]), lambda n: _shared(x["c"], x["a"], x["b"], n, least)))


def _shared(chunks: Column, start: Column, end: Column, total: Column, least: int) -> Column:
    def step(acc, c):
        share = F.greatest(F.lit(least).cast("long"), F.floor((end - start) * F.length(c) / F.greatest(total, F.lit(1))))
        to = F.least(end, acc["at"] + share)
        item = F.struct(acc["at"].alias("start_ms"), to.alias("end_ms"), c.alias("text"))
        return F.struct(to.alias("at"), F.when(to > acc["at"], F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(chunks, F.struct(start.cast("long").alias("at"), F.array().cast(WORDS).alias("out")), step)["out"]


def spread_words(words: Column, start: Column, end: Column) -> Column:
    """Word times by share of characters over the utterance (the tables have none of their own).

    Only numbers are folded, as a fold copies what it carries at each step.
    """
    so_far = F.aggregate(words, F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.get(acc, F.size(acc) - 1) + F.length(w)))

    def spread(seen: Column) -> Column:
        total = F.greatest(F.get(seen, F.size(seen) - 1), F.lit(1))
        at = lambda i: start + F.floor((end - start) * F.get(seen, i) / total)
        return F.transform(words, lambda w, i: F.struct(at(i).alias("start_ms"), at(i + 1).alias("end_ms"), w.alias("text")))

    return let(so_far, spread)


def merge_short(words: Column, least: int = 380) -> Column:
    """Neighbours join until they span ``least``; what is left over joins the last."""
    join = lambda a, b: F.struct(a["start_ms"].alias("start_ms"), b["end_ms"].alias("end_ms"), F.concat(a["text"], F.lit(" "), b["text"]).alias("text"))

    def step(acc, w):
        held = F.when(acc["open"].isNull(), w).otherwise(join(acc["open"], w))
        full = held["end_ms"] - held["start_ms"] >= least
        return F.struct(F.when(full, F.concat(acc["done"], F.array(held))).otherwise(acc["done"]).alias("done"), F.when(~full, held).alias("open"))

    word = "struct<start_ms:bigint,end_ms:bigint,text:string>"

    def finish(acc):
        n = F.size(acc["done"])
        glued = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(join(F.get(acc["done"], n - 1), acc["open"])))
        return F.when(acc["open"].isNull(), acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(glued)

    return F.aggregate(words, F.struct(F.array().cast(WORDS).alias("done"), F.lit(None).cast(word).alias("open")), step, finish)


def group_words(words: Column, most: int = 6) -> Column:
    """Groups of at most ``most`` words; a mark ends one that has half as many, rounded down, or more."""

    def step(acc, w):
        held = F.concat(acc["open"], F.array(w))
        full = (F.size(held) >= most) | ((F.size(held) >= most // 2) & w["text"].rlike("(?U)[.!?…,]\\s*$"))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(held))).otherwise(acc["done"]).alias("done"), F.when(full, F.array().cast(WORDS)).otherwise(held).alias("open"))

    start = F.struct(F.array().cast(GROUPS).alias("done"), F.array().cast(WORDS).alias("open"))
    return F.aggregate(words, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def word_windows(words: Column, start: Column, end: Column, full: int = 1200, least: int = 450) -> Column:
    """Windows of words of at least ``full``, each from the end of the one before; a rest of ``least`` stands alone, a shorter one joins the last; else the whole."""
    span = "array<struct<start_ms:bigint,end_ms:bigint>>"

    def step(acc, w):
        a = F.coalesce(acc["from"], w["start_ms"])
        done = w["end_ms"] - a >= full
        item = F.struct(a.alias("start_ms"), w["end_ms"].alias("end_ms"))
        return F.struct(F.when(done, F.concat(acc["done"], F.array(item))).otherwise(acc["done"]).alias("done"), F.when(done, w["end_ms"]).otherwise(a).alias("from"), w["end_ms"].alias("to"))

    def finish(acc):
        n = F.size(acc["done"])
        rest = F.struct(acc["from"].alias("start_ms"), acc["to"].alias("end_ms"))
        glued = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(F.get(acc["done"], n - 1)["start_ms"].alias("start_ms"), acc["to"].alias("end_ms"))))
        return F.when(acc["from"].isNull(), acc["done"]).when(acc["to"] - acc["from"] >= least, F.concat(acc["done"], F.array(rest))).when(n > 0, glued).otherwise(acc["done"])

    long_ = F.lit(None).cast("long")
    found = F.aggregate(words, F.struct(F.array().cast(span).alias("done"), long_.alias("from"), long_.alias("to")), step, finish)
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.struct(start.alias("start_ms"), end.alias("end_ms")))))
