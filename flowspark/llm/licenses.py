"""License scan by a positional index of rare words, in DataFrame functions alone.

* Words are runs of digits, letters a-z (A-Z lowered) and characters from U+0080 on; positions count from 0.
* A template is a licence's characteristic wording with mandatory key phrases in it. Document counts of all
  template words over the whole corpus give their IDF; each template's postings are its rarest key words with
  their places in the template.
* A file's words are looked up in the postings of the rarest word of each template. A hit fixes the template's
  start; the places of the other rare words must agree with it (relative positions), then every key phrase must
  stand where it belongs. As the looked-up words are words of a key phrase, no place is lost, whatever the IDF.
* A template's label is given when its wording agrees in at least `SHARE` of its words; the score of a file is
  the largest such share among its verified places, 0 without any.

All work is local to a row, nothing is shuffled but the few counts per template word, whose number the templates
bound. Defined cases: a null text is empty (no words, no labels, score 0, null positions); repeated rows are
scanned each; an empty table gives an empty table; only `doc_id` and the text column are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shared import LOWER, UPPER, free_name, whole

GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 0.5
SEEDS = 2

#: phrase: label. Counted at every place where the words stand consecutively.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, wording, mandatory key phrases of the wording: public licence texts and notices
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit-notice", "released under the mit license", ("the mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", ("terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-text", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


class Template:
    def __init__(self, label: str, wording: str, keys: tuple[str, ...], base: bool):
        self.label, self.base, self.words = label, base, wording.split()
        self.keys = []  # (place in the wording, words)
        for key in keys:
            part = key.split()
            self.keys.append((next(i for i in range(len(self.words)) if self.words[i:i + len(part)] == part), part))

    def seeds(self, rank: dict[str, float], most: int) -> list[tuple[str, int]]:
        """The rarest words of the key phrases with their places."""
        found = {}
        for at, part in self.keys:
            for i, word in enumerate(part):
                found.setdefault(word, at + i)
        return sorted(found.items(), key=lambda s: (rank.get(s[0], 0), s[0]))[:most]


def templates() -> list[Template]:
    return [Template(label, phrase, (phrase,), True) for phrase, label in BASE.items()] + [
        Template(label, wording, keys, False) for label, wording, keys in TEMPLATES]


def split_words(text: Column) -> Column:
    """Words of a text; only the first and last part of a split can be empty."""
    parts = F.split(text, GAPS)
    lean = F.transform(F.array(parts), lambda p: F.slice(
        p, F.when(p[0] == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(p) - F.when(p[0] == "", 1).otherwise(0)
                                                             - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0))))
    return lean[0]


def document_counts(documents: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each template word occurs, over the whole corpus; at most one number per template word."""
    present = F.array_intersect(F.split(F.lower(whole(text)), GAPS), F.array(*map(F.lit, vocabulary)))
    counts = documents.select(F.explode(present).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def verified(w: Column, hits: Column, template: Template, posts: list[tuple[str, int]], share: float) -> Column:
    """Places of one template among the hits of its rarest word."""
    word, place = posts[0]

    def stands(h):
        start = h["i"] - F.lit(place)
        others = [F.get(w, start + q) == F.lit(x) for x, q in posts[1:]]
        phrases = [F.get(w, start + (at + j)) == F.lit(x) for at, part in template.keys for j, x in enumerate(part)]
        return reduce(lambda a, b: a & b, [h["x"] == F.lit(word), *others, *phrases])

    def placed(h):
        start = h["i"] - F.lit(place)
        wording = F.array(*map(F.lit, template.words))
        same = F.filter(F.transform(wording, lambda x, j: F.get(w, start + j).eqNullSafe(x)), lambda s: s)
        agreed = F.lit(1.0) if template.base else F.size(same) / F.lit(float(len(template.words)))
        return F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"),
                        start.cast("long").alias("start"), agreed.alias("share"))

    return F.filter(F.transform(F.filter(hits, stands), placed), lambda p: p["share"] >= share)


def scan(documents: DataFrame, text: str = "text", share: float = SHARE, seeds: int = SEEDS) -> DataFrame:
    """`documents` with `n_words` and `places`, the verified places: struct(label, base, start, share)."""
    known = templates()
    counts = document_counts(documents, sorted({w for t in known for w in t.words}), text)
    w, hits, raw = (free_name(documents, n) for n in ("_words", "_hits", "_lower"))
    index = [t.seeds(counts, seeds) for t in known]
    rarest = F.array(*map(F.lit, sorted({s[0][0] for s in index})))
    # `lower` also changes letters beyond A-Z, but no word boundary: it finds files worth a look, exact words decide
    scanned = (
        documents.withColumn(raw, F.split(F.lower(whole(text)), GAPS))
        .withColumn("n_words", (F.size(raw) - F.when(F.col(raw)[0] == "", 1).otherwise(0)
                                - F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)).cast("long"))
        .withColumn(w, F.when(F.arrays_overlap(raw, rarest), split_words(F.translate(whole(text), UPPER, LOWER)))
                    .otherwise(F.array().cast("array<string>")))
        .withColumn(hits, F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                                   lambda h: h["x"].isin(sorted({s[0][0] for s in index}))))
    )
    found = [verified(F.col(w), F.col(hits), t, posts, share) for t, posts in zip(known, index)]
    return scanned.withColumn("places", F.concat(*found)).drop(raw, w, hits)


def labelled(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: word count, base phrase places, labels and score."""
    placed = scan(documents.select("doc_id", F.col(text).alias("text")))

    def base():
        return F.filter("places", lambda p: p["base"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    starts = F.transform(base(), lambda p: p["start"])
    return placed.select(
        "doc_id", "n_words", F.size(base()).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.transform(base(), lambda p: p["label"])).alias("base_labels"),
        joined(F.transform("places", lambda p: p["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same by brute force: every key phrase at every position, no index."""
    rows = []
    for n, t in enumerate(templates()):
        keys = " AND ".join(f"w[s + {at + 1} : s + {at + len(part)}] = {part!r}" for at, part in t.keys)
        at, part = t.keys[0]
        agree = "1.0::DOUBLE" if t.base else (
            "(" + " + ".join(f"coalesce((w[s + {j + 1}] = '{x}')::INT, 0)" for j, x in enumerate(t.words)) + f") / {float(len(t.words))}::DOUBLE")
        # positions before the text's start can't be subscripts: pad the words
        rows.append(f"SELECT doc_id, s - 64 AS start, '{t.label}' AS label, {t.base} AS base, {agree} AS share "
                    f"FROM (SELECT doc_id, w, i - {at} AS s FROM places WHERE x = '{part[0]}') WHERE {keys}")
    return f"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS plain FROM documents),
    padded AS (SELECT doc_id, len(plain) AS n, list_concat(list_resize([]::VARCHAR[], 64, ''), plain) AS w FROM split),
    places AS (SELECT doc_id, w, unnest(range(len(w))) AS i, unnest(w) AS x FROM padded),
    found AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE share >= {SHARE}),
    summed AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      max(share) AS score FROM found GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM padded LEFT JOIN summed USING (doc_id)
    """
