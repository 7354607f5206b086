"""License scan: exact set-similarity join of text blocks with license templates (DataFrame functions only).

A template is the set of words of a license text, with the share of them (``least``) that a block must hold. A
template of w words belongs to the class c, the least power of two from 16 on that isn't below w. The blocks of
class c are 2c consecutive words, from each multiple of c on (the last may be shorter), so whatever run of c + 1 words a text
has lies whole in one block. A block and a template of one class link if they share ceil(least x size) words.

1. Rarity: count in how many documents each template word occurs. Fewer first, then by word.
2. Prefix: a link shares one of the template's size - need + 1 rarest words, so only those are offered.
   Rows without any of them, and then blocks, are done.
3. A block's template words, in the same order, are joined by word with the offered ones. Words are matched as
   each other's first shared one: the length filter wants need words in the block, the positional
   filter need words from the match on, on both sides. A block's own prefix ends need - 1 words before its end.
4. Full sets are intersected: a pair is kept where it shares enough, at its first shared word, so once.
5. A link goes if a template of another license that holds all its words links with the same block.

The template words are written into the plan while they are at most ``most_tokens``, which is counted; beyond
that words are ranked by a join. Offers are broadcast while they are at most ``most_offers``, counted too;
beyond that they are joined by word, where adaptive execution splits frequent words. All ways give the same rows.

Defined cases: a null or empty text has no words and no label; templates without words or with a null label, text or share are left out;
equal templates link each; ties of rarity stand by word, which changes no result; rows that
repeat are judged one by one, null ids too; a very long text is one array of words and many blocks; empty
tables give no rows or no links; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .decontaminate import _fits as fits
from .decontaminate import _words, digest

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license notices: label, share of its words that a block must hold, text.
TEMPLATES = (
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", 1.0, "SPDX-License-Identifier: MIT"),
    ("apache", 0.8, "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache", 1.0, "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", 0.85, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", 0.85, "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", 0.8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", 0.8, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc0", 0.8, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", 1.0, "licensed under CC BY 4.0"),
    ("cc-by-sa", 1.0, "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", 1.0, "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", 1.0, "licensed under CC BY-NC-SA 4.0"),
    ("cc-by", 0.9, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", 0.95, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
LEAST_CLASS = 16


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "label string, least double, text string")


def prepared(templates: DataFrame) -> DataFrame:
    """(tid, label, tokens, need, class, over) of templates (label, least, text); over: tids of other licenses' templates that hold all the words."""
    t = templates.select("label", "least", "text", _words(F.col("text")).alias("_w")).where(F.col("label").isNotNull() & F.col("least").isNotNull() & (F.size("_w") > 0))
    size = F.size(F.array_distinct("_w"))
    need = F.greatest(F.lit(1), F.least(size, F.ceil(F.round(F.col("least") * size, 9)).cast("int")))
    class_ = F.greatest(F.lit(LEAST_CLASS), F.pow(F.lit(2), F.ceil(F.log2(F.size("_w")))).cast("int"))
    t = cut(t.select(F.monotonically_increasing_id().alias("tid"), "label", F.array_distinct("_w").alias("tokens"), need.alias("need"), class_.alias("class")))
    # templates that share their smallest word and hold all the others: a join by word, exact by comparing the sets
    small = t.select("tid", "label", "tokens", F.array_min("tokens").alias("token"))
    large = t.select(F.col("tid").alias("by"), F.col("label").alias("other"), F.col("tokens").alias("all"), F.explode("tokens").alias("token"))
    held = (F.size("all") > F.size("tokens")) & (F.size(F.array_except("tokens", "all")) == 0) & (F.col("label") != F.col("other"))
    over = small.join(large, "token").where(held).groupBy("tid").agg(F.collect_set("by").alias("over"))
    return cut(t.join(over, "tid", "left").withColumn("over", F.coalesce("over", F.array().cast("array<bigint>"))))


def starts(n: Column, c) -> Column:
    """Where the blocks of a class begin in n words."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), n - c - 1), F.lit(c))


def ranked(rows: DataFrame, vocabulary: DataFrame, tokens: list[str] | None) -> DataFrame:
    """(token, rank) of the template words, from the rarest over rows (_w) on."""
    if tokens is not None:
        each = rows.select(F.explode(F.array_intersect(F.array(*map(F.lit, tokens)), F.col("_w"))).alias("token"))
    else:
        each = rows.select(F.explode(F.array_distinct("_w")).alias("token")).join(vocabulary, "token", "left_semi")
    seen = each.groupBy("token").agg(F.count("*").alias("rows"))
    met = vocabulary.join(seen, "token", "left").select("token", F.coalesce("rows", F.lit(0)).alias("rows"))
    return cut(met.select("token", F.struct("rows", "token").alias("rank")))


def offers(t: DataFrame, ranks: DataFrame) -> DataFrame:
    """(class, token, i, tid, label, over, need, size, all): each template's prefix, word by word, and its words in order."""
    each = t.select("*", F.explode("tokens").alias("token")).join(ranks, "token")
    lists = each.groupBy("tid", "label", "over", "need", "class").agg(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r["token"]).alias("all"))
    size = F.size("all")
    return lists.select("class", "tid", "label", "over", "need", size.alias("size"), "all", F.posexplode(F.slice("all", 1, size - F.col("need") + 1)).alias("i", "token"))


def places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after another."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - len(parts))), lambda i: F.coalesce(here(i), F.lit(False)))


def labelled(words: Column, phrase: str, label: str) -> Column:
    return F.transform(places(words, phrase), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, templates: DataFrame, phrases: dict[str, str] = PHRASES, most_tokens: int = 4_000, most_offers: int = 200_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, links.

    links: array of (label, tid, block's first and end word, containment), one for each block and template.
    """
    t = prepared(templates)
    vocabulary = cut(t.select(F.explode("tokens").alias("token")).distinct())
    few = vocabulary.count() <= most_tokens
    rows = docs.select("doc_id", digest(F.col("text")).alias("h"), _words(F.col("text")).alias("_w"))
    ranks = ranked(rows, vocabulary, sorted(r[0] for r in vocabulary.collect()) if few else None)
    offer = cut(offers(t, ranks))
    classes = {r[0]: r[1] for r in offer.groupBy("class").agg(F.min("need")).collect()}  # at most 27 powers of two

    last_words = {p.split()[-1] for p in phrases}
    said = reduce(lambda a, b: a | b, [F.array_contains("_w", w) for w in sorted(last_words)])
    base = F.when(said, F.concat(*[labelled(F.col("_w"), p, label) for p, label in phrases.items()])).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
    placed = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "h", F.size("_w").cast("long").alias("n_words"), base.alias("base"), "_w")
    keys = ["_row", "doc_id", "h", "n_words", "base"]

    none = F.array().cast("array<struct<class:int,at:int,words:array<string>>>")
    if few:
        order = F.array(*[F.lit(r["token"]) for r in ranks.orderBy("rank").collect()]) if classes else F.array().cast("array<string>")
        rare: dict[int, list[str]] = {}
        for r in offer.select("class", "token").distinct().collect():  # no more than classes x template words
            rare.setdefault(r[0], []).append(r[1])

        def blocks(c: int) -> Column:
            hot = F.array(*map(F.lit, sorted(rare[c])))
            here = F.filter(starts(F.size("_w"), c), lambda i: F.arrays_overlap(F.slice("_w", i + 1, F.lit(2 * c)), hot))
            told = F.transform(here, lambda i: F.struct(F.lit(c).alias("class"), i.alias("at"), F.array_intersect(order, F.slice("_w", i + 1, F.lit(2 * c))).alias("words")))
            return F.when(F.arrays_overlap("_w", hot), told).otherwise(none)

        each = placed.select(*keys, F.explode_outer(F.concat(none, *[blocks(c) for c in sorted(classes)])).alias("b"))
        each = each.select(*keys, "b.class", "b.at", "b.words")
    else:
        cuts = lambda c: F.transform(starts(F.size("_w"), c), lambda i: F.struct(F.lit(c).alias("class"), i.alias("at"), F.array_distinct(F.slice("_w", i + 1, F.lit(2 * c))).alias("words")))
        each = placed.select(*keys, F.explode_outer(F.concat(none, *[cuts(c) for c in sorted(classes)])).alias("b")).select(*keys, "b.class", "b.at", F.explode_outer("b.words").alias("token"))
        each = each.join(ranks, "token", "left").groupBy(*keys, "class", "at").agg(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r["token"]).alias("words"))
    least = reduce(lambda a, b: F.when(F.col("class") == b[0], b[1]).otherwise(a), classes.items(), F.lit(1))
    prefix = F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - least + 1))
    each = each.select(*keys, F.col("class").alias("_class"), "at", "words", F.posexplode_outer(prefix).alias("j", "_token"))
    near = (F.col("_class") == F.col("class")) & (F.col("_token") == F.col("token")) & (F.least(F.col("size") - F.col("i"), F.size("words") - F.col("j")) >= F.col("need"))
    shared = F.array_intersect("words", "all")
    offered = F.broadcast(offer) if fits(offer, F.octet_length(F.array_join("all", " ")), most_offers, 64 << 20) else offer
    met = each.join(offered, near, "left").withColumn("_shared", F.when(F.col("tid").isNotNull(), shared))
    real = (F.size("_shared") >= F.col("need")) & (F.get("_shared", F.lit(0)) == F.col("token"))
    end = F.least(F.col("n_words"), (F.col("at") + 2 * F.col("_class")).cast("long"))
    link = F.struct("label", "tid", F.col("at").cast("long").alias("first"), end.alias("end"), (F.size("_shared") / F.col("size")).alias("containment"), "_class", "over")
    links = met.groupBy(*keys).agg(F.collect_set(F.when(real, link)).alias("_all"))
    kept = F.filter("_all", lambda x: ~F.exists("_all", lambda y: (x["_class"] == y["_class"]) & (x["first"] == y["first"]) & F.array_contains(x["over"], y["tid"])))
    links = links.select(*keys, F.array_sort(F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["tid"].alias("tid"), x["first"].alias("first"), x["end"].alias("end"), x["containment"].alias("containment")))).alias("links"))
    at, named = F.transform("base", lambda x: x["at"]), F.array_distinct(F.transform("base", lambda x: x["label"]))
    own = F.transform("links", lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("links", lambda x: x["containment"])), F.lit(0.0)))
    return links.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(named).alias("base_labels"), joined(F.concat(named, own)).alias("labels"), score.alias("score"), "links",
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), templates_table(spark)).drop("links")


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_SAID = " UNION ALL ".join(
    f"SELECT rid, {_QUOTED(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = {_QUOTED(x)}" for k, x in enumerate(p.split())) + ")) AS pos FROM d"
    for p, label in PHRASES.items()
)
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT.format("text")} AS w FROM documents),
t0 AS (SELECT row_number() OVER () AS tid, label, least, {_SPLIT.format("text")} AS w FROM (VALUES {", ".join(f"({_QUOTED(a)}, {b}, {_QUOTED(c)})" for a, b, c in TEMPLATES)}) v(label, least, text)),
t AS MATERIALIZED (SELECT tid, label, list_distinct(w) AS s, ceil(round(least * len(list_distinct(w)), 9)) AS need, CAST(greatest({LEAST_CLASS}, pow(2, ceil(log2(len(w))))) AS BIGINT) AS c FROM t0),
b AS MATERIALIZED (SELECT rid, c, pos, list_distinct(w[pos + 1:pos + 2 * c]) AS s FROM d, (SELECT DISTINCT c FROM t) k, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - c - 1) + 1, c)) AS pos)),
l AS MATERIALIZED (SELECT b.rid, b.c, b.pos, t.tid, t.label, t.s, len(list_intersect(b.s, t.s)) / len(t.s) AS share FROM b JOIN t ON b.c = t.c WHERE len(list_intersect(b.s, t.s)) >= t.need),
k AS (SELECT * FROM l x WHERE NOT EXISTS (SELECT 1 FROM l y WHERE x.rid = y.rid AND x.c = y.c AND x.pos = y.pos AND x.label <> y.label AND len(y.s) > len(x.s) AND len(list_intersect(y.s, x.s)) = len(x.s))),
base AS MATERIALIZED ({_SAID}),
bs AS (SELECT rid, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM k) GROUP BY rid),
sc AS (SELECT rid, max(share) AS share FROM k GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word, coalesce(bs.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""
