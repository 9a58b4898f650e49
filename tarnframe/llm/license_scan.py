"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Only DataFrame functions run.  A text is reduced to lower-case words of letters
and digits; its 5-word shingles are seen through windows of W shingles that begin
every W/2, for a few widths W.  A template of m shingles belongs to the narrowest
width with m <= W/2 + 1, so each occurrence lies wholly in some window.  A window
and a template are compared by ``n_bands`` MinHash values, one a band; the number
of bands is computed from the least Jaccard similarity that a window with enough
of a template can have, so that such a pair shares a band with probability
``RECALL`` or more (a neighbouring window, or a larger share, adds to it).  Each
pair that shares one is verified: the share of the template's shingles found in
the window must reach ``containment``.

Before any window is formed, texts (then windows) without an anchor word are left
out: anchors are chosen so that whatever reaches the containment holds one, so no
match is lost.

Templates are a parameter of fixed size and are broadcast.  No shuffle but that of
the matches.  A long text is cut into pieces that overlap by more than a window, each
a row of its own, so no row holds all windows of a text.  Defined results: null, empty
and short texts match nothing; rows with one id are reported together; very long texts
are read whole; a share that ties with the containment matches; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
RECALL = 0.999

#: Public license notices by name.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-dedication": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Longer texts are cut into pieces of so many words, each a row of its own.
PIECE_WORDS = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: str) -> list[str]:
    """A template's words, as ``_words`` gives a text's."""
    lowered = text.translate(str.maketrans(_UPPER, _LOWER))
    return "".join(c if c in _LOWER or c in "0123456789" else " " for c in lowered).split()


def _cleaned(text: Column) -> Column:
    """The text's words with single blanks between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+", " "))


def _pieces(cleaned: Column, piece_words: int, more_words: int) -> Column:
    """Cut a long cleaned text at every ``piece_words`` words; each piece goes on for ``more_words`` of the next."""
    cut = F.regexp_extract_all(cleaned, F.lit(f"(?:[a-z0-9]++ ?+){{1,{piece_words}}}+"), F.lit(0))

    def longer(pieces: Column) -> Column:
        following = lambda i: F.substring_index(F.coalesce(F.get(pieces, i + 1), F.lit("")), " ", more_words)
        return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.concat(F.get(pieces, i), following(i)))

    # so many bytes hold no more words than a piece
    return F.when(F.octet_length(cleaned) <= 2 * piece_words, F.array(cleaned)).otherwise(_let(cut, longer))


@dataclass(frozen=True)
class Template:
    name: str
    #: distinct shingles
    shingles: tuple[str, ...]
    width: int


def template_of(name: str, text: str) -> Template:
    words = plain_words(text)
    if len(words) < SHINGLE_WORDS:
        raise ValueError(f"{name} has fewer than {SHINGLE_WORDS} words")
    runs = [" ".join(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)]
    width = 4
    while len(runs) > width // 2 + 1:
        width *= 2
    return Template(name, tuple(dict.fromkeys(runs)), width)


def anchors(templates: list[Template], containment: float) -> list[str]:
    """Words of which every match holds one.

    A match finds all but a few of a template's shingles, so the words need to
    lie in one shingle more than may be missing; long words are taken first, as
    they are rarer in other texts.
    """
    chosen: set[str] = set()
    for t in templates:
        m = len(t.shingles)
        held = [set(s.split(" ")) for s in t.shingles]
        for word in sorted(set().union(*held), key=lambda w: (-len(w), w)):
            if sum(bool(chosen & words) for words in held) > m - _enough(m, containment):
                break
            chosen.add(word)
    return sorted(chosen)


def _enough(m: int, containment: float) -> int:
    """Shingles of a template of m that make a match."""
    return math.ceil(round(containment * m, 9))


def bands_needed(templates: list[Template], containment: float, recall: float) -> int:
    """One-value bands for which a pair at the limit meets with probability ``recall``."""
    least = 1.0
    for t in templates:
        shared = _enough(len(t.shingles), containment)
        least = min(least, shared / (t.width + len(t.shingles) - shared))
    return 1 if least >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - least))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _signature(hashes: Column, n_bands: int) -> Column:
    """For each band, the least rehash of the window's shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band))))


def _template_rows(spark: SparkSession, templates: list[Template], n_bands: int) -> DataFrame:
    rows = spark.createDataFrame([(t.name, t.width, list(t.shingles)) for t in templates], "license string, width int, shingles array<string>")
    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    return rows.select("license", "width", "shingles", F.posexplode(_signature(hashes, n_bands)).alias("band", "value"))


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and license found: id, license, template_shingles, found_shingles."""
    known = [template_of(name, text) for name, text in (templates or TEMPLATES).items()]
    n_bands = bands_needed(known, containment, RECALL)
    held_words = anchors(known, containment)
    held = F.array(*map(F.lit, held_words))
    widths = sorted({t.width for t in known})
    k = SHINGLE_WORDS
    def anchored(w: Column) -> Column:
        return (F.size(w) >= k) & F.arrays_overlap(w, held)

    # a power of two, so that windows of all widths begin at a piece's first word
    piece_words = max(PIECE_WORDS, 2 * max(widths))

    def windows_of(w: Column) -> Column:
        """A piece's anchored windows of all widths, each with its words only."""

        def cut(width: int) -> Column:
            begins = F.sequence(F.lit(0), F.least(F.lit(piece_words - 1), F.size(w) - k), F.lit(width // 2))
            return F.transform(begins, lambda at: F.struct(F.lit(width).alias("width"), F.slice(w, at + 1, width + k - 1).alias("w")))

        return F.filter(F.concat(*map(cut, widths)), lambda x: anchored(x["w"]))

    def signed(w: Column) -> Column:
        """A window's shingles and its signature."""
        seen = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        signature = _let(F.transform(seen, lambda s: F.xxhash64(s)), lambda hashes: _signature(hashes, n_bands))
        return F.struct(seen.alias("seen"), signature.alias("signature"))

    def may_match(text: Column) -> Column:
        """Whether an anchor is a substring at all, which costs less than finding words."""
        return _let(F.lower(text), lambda t: reduce(Column.__or__, (F.contains(t, F.lit(a)) for a in held_words)))

    # the outer explodes keep the optimizer from evaluating their arrays a second time, in a filter
    text = F.col(text_col)
    pieces = F.when(may_match(text), _let(_cleaned(text), lambda c: _pieces(c, piece_words, piece_words // 2 + k)))
    found = _let(F.split(F.trim("piece"), " "), lambda w: F.when(anchored(w), windows_of(w)))
    windows = (
        documents.select(F.col(id_col), F.explode_outer(pieces).alias("piece"))
        .where("piece IS NOT NULL")
        .select(id_col, F.explode_outer(found).alias("x"))
        .where("x IS NOT NULL")
        .select(id_col, F.col("x.width").alias("width"), signed(F.col("x.w")).alias("window"))
        .select(id_col, "width", F.col("window.seen").alias("seen"), F.posexplode_outer("window.signature").alias("band", "value"))
    )
    shared = F.size(F.array_intersect("seen", "shingles"))
    return (
        windows.join(F.broadcast(_template_rows(documents.sparkSession, known, n_bands)), ["width", "band", "value"])
        .select(id_col, "license", F.size("shingles").cast("long").alias("template_shingles"), shared.cast("long").alias("found_shingles"))
        .where(F.col("found_shingles") >= F.ceil(F.round(F.lit(containment) * F.col("template_shingles"), 9)))
        .groupBy(id_col, "license", "template_shingles")
        .agg(F.max("found_shingles").alias("found_shingles"))
    )


def licenses_sql(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL that compares every window with every template, without bands."""
    known = [template_of(name, text) for name, text in (templates or TEMPLATES).items()]
    quoted = ",\n    ".join("('%s', %d, [%s])" % (t.name, t.width, ", ".join(f"'{s}'" for s in t.shingles)) for t in known)
    return f"""
WITH templates(license, width, shingles) AS (
  VALUES {quoted}
), words AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM documents
), texts AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM words WHERE len(w) >= 5
), holding AS (
  SELECT * FROM texts WHERE list_has_any(s, (SELECT flatten(list(shingles)) FROM templates))
), widths AS (
  SELECT DISTINCT width FROM templates
), starts AS (
  SELECT doc_id, width, s, unnest(range(0, len(s), width // 2)) AS a FROM holding CROSS JOIN widths
), seen AS (
  SELECT doc_id, width, s[a + 1:a + width] AS s FROM starts
)
SELECT doc_id, license, CAST(len(shingles) AS BIGINT) AS template_shingles,
       CAST(max(len(list_intersect(s, shingles))) AS BIGINT) AS found_shingles
FROM seen JOIN templates USING (width)
GROUP BY doc_id, license, shingles
HAVING max(len(list_intersect(s, shingles))) >= ceil(round({containment} * len(shingles), 9))
"""
