"""License scan by a positional rare-token index, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. The index holds
the places of each license template's rare words: those that stand in at most one of RARE texts,
and at least the template's ANCHORS rarest ones. Inverse document frequencies are counted over all
texts. A text looks up all its words that the index holds; their postings give the places at which
a template would begin, where its mandatory key phrase must then stand word by word. A template is
found where the indexed words that stand in place have at least AGREE of the weight of all of them.

The base scan counts the places of three fixed phrases. `score` is the largest share of a found
template, at least 0.5 where a base phrase stands, rounded to six places.

Two passes read the texts, one to count words and one to scan; the second exchanges nothing.

Defined results: a null text is empty; a text without labels has an empty string for them,
score 0 and null places; repeated rows are scanned one by one; a very long text is one row, all
of whose words are scanned; templates that begin before a text or end behind it count with the
words that stand in it; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import read
from tidegraph.llm.op7_decontaminate import words_of

#: Base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Label, template, mandatory key phrase (a part of the template).
TEMPLATES = (
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "the terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "licensed under cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "licensed under cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "licensed under cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "licensed under cc by nd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement",
        "to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law or agreed to in writing software",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        "the gnu general public license as published by the free software foundation",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gnu affero general public license as published by the free software foundation",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "the author disclaims all warranties with regard to this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "the origin of this software must not be misrepresented",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "to use reproduce display distribute execute and transmit the software",
        "accompanying documentation covered by this license",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain "
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        "either in source code form or as a compiled binary",
    ),
)
#: Words that stand in at most one of so many texts are indexed; of each template, the ANCHORS rarest always.
RARE, ANCHORS = 4, 4
#: Share of a template's indexed weight that must stand in place.
AGREE = 0.5
INDEX = "array<struct<label:string,rare:string,ahead:int,key:array<string>,posts:array<struct<p:int,w:string,share:double>>>>"


def key_place(template: str, key: str) -> int:
    """The word of a template at which its key phrase begins."""
    words, own = template.split(), key.split()
    return next(i for i in range(len(words)) if words[i : i + len(own)] == own)


def document_frequency(words: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each word of a fixed vocabulary stands, and the number of texts; one pass."""
    none = F.array(F.lit(""))  # no word is empty: stands for the text itself
    each = words.select(F.explode(F.concat(none, F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("w"))
    found = {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}  # the vocabulary at most
    return found, found.pop("", 0)


def build_index(frequency: dict[str, int], n_texts: int) -> list[dict]:
    """Each template's label, key phrase with its place and rarest word, and postings: places and weights of its indexed words."""
    index = []
    weight = {w: math.log((n_texts + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for _, text, _ in TEMPLATES for w in text.split()}
    rarest = lambda words: sorted(set(words), key=lambda w: (-weight[w], w))
    for label, text, key in TEMPLATES:
        words = text.split()
        held = {w for i, w in enumerate(rarest(words)) if i < ANCHORS or RARE * frequency.get(w, 0) <= n_texts}
        total = sum(weight[w] for w in words if w in held)
        posts = [{"p": i, "w": w, "share": weight[w] / total} for i, w in enumerate(words) if w in held]
        index.append({"label": label, "rare": rarest(key.split())[0], "ahead": key_place(text, key), "key": key.split(), "posts": posts})
    return index


def places_of(words: Column, phrase: str) -> Column:
    """array<int>: where the phrase's words stand one after another."""
    parts = phrase.split()
    size = F.size(words)
    starts = F.when(size >= len(parts), F.sequence(F.lit(0), size - len(parts))).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        same = F.lit(True)
        for k in reversed(range(len(parts))):
            same = (F.get(words, i + k) == parts[k]) & same
        return same

    return F.filter(starts, stands)


def base_scan(words: Column) -> Column:
    """struct<mit, apache, gpl>: places of each base phrase; texts without the last word are not walked."""
    none = F.array().cast("array<int>")
    return F.when(
        F.array_contains(words, "license"),
        F.struct(*[places_of(words, phrase).alias(label) for phrase, label in BASE.items()]),
    ).otherwise(F.struct(*[none.alias(label) for label in BASE.values()]))


def template_scan(words: Column, index: list[dict]) -> tuple[Column, Column]:
    """The column `hits` (places of indexed words), and, from it, array<struct<label, share>>: each template of
    which a place agrees, with its largest share in place.

    A text is walked only if it holds the rarest word of some key phrase, which is mandatory; then only
    templates whose rarest key word it holds are looked up.
    """
    table = F.from_json(F.lit(json.dumps(index)), F.lit(INDEX))
    held = sorted({post["w"] for t in index for post in t["posts"]})
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(held), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())

    def begins(t: Column) -> Column:
        """Places at which the postings of the text's words let the template begin."""
        of_word = lambda h: F.transform(F.filter(t["posts"], lambda p: p["w"] == h["w"]), lambda p: h["i"] - p["p"])
        return F.array_distinct(F.flatten(F.transform(F.col("hits"), of_word)))

    def verified(t: Column) -> Column:
        at = lambda s: s + t["ahead"]
        return F.filter(begins(t), lambda s: F.when(at(s) >= 0, F.slice(words, F.greatest(at(s), F.lit(0)) + 1, F.size(t["key"])) == t["key"]).otherwise(False))

    def share(t: Column, s: Column) -> Column:
        same = lambda p: F.coalesce(F.get(words, s + p["p"]) == p["w"], F.lit(False))
        return F.aggregate(t["posts"], F.lit(0.0), lambda a, p: a + F.when(same(p), p["share"]).otherwise(0.0))

    own = F.filter(table, lambda t: F.array_contains(words, t["rare"]))
    best = F.transform(own, lambda t: F.struct(t["label"].alias("label"), F.array_max(F.transform(verified(t), lambda s: share(t, s))).alias("share")))
    return hits, F.filter(best, lambda x: x["share"] >= AGREE - 1e-9)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    own = docs.select(F.col(id_col).alias("id"), words_of(F.col(text)).alias("words"))
    vocabulary = sorted({w for _, template, _ in TEMPLATES for w in template.split()})
    index = build_index(*document_frequency(own, vocabulary))
    words, nothing = F.col("words"), F.array().cast("array<struct<label:string,share:double>>")
    hits, found = template_scan(words, index)
    may = F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted({t["rare"] for t in index})]))
    out = own.withColumn("b", base_scan(words)).withColumn("hits", F.when(may, hits)).withColumn("found", F.when(may, found).otherwise(nothing))
    every = F.concat(*[F.col(f"b.{x}") for x in BASE.values()])
    base = F.array_compact(F.array(*[F.when(F.size(f"b.{x}") > 0, F.lit(x)) for x in BASE.values()]))
    both = F.array_sort(F.array_union(base, F.transform("found", lambda x: x["label"])))
    share = F.least(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), F.lit(1.0))
    score = F.greatest(share, F.when(F.size(every) > 0, 0.5).otherwise(0.0))
    return out.select(
        F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.round(score, 6).alias("score"),
    )


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))
