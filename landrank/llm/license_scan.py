"""License scan by diagonal voting.

Every text is a run of word k-gram hashes. Spark joins them all to the k-grams of license templates; a hit of text word i
on template word j votes for the diagonal i - j. Votes are added up by diagonal, diagonals within `drift` of each other are
merged (a dropped or added word moves a match to the next one), and a merged span counts when it covers enough of the
template's words, foreign words between them counted against it, and, where the template names a licence, touches that name and version word for word: words that notices of
other licences share don't tell which one it is. Base labels are phrases whose words stand consecutively, as in the phrase list.

score is the largest such share of one span, and at least 0.5 where a base phrase stands. Base columns come from a scan for
their four phrases beside the join, because two words are shorter than its k-grams.

Defined results: null and empty texts have no words, no labels ('' for strings) and score 0; results belong to (doc_id, text),
so repeated rows are alike and null doc_ids are scanned too; an empty table gives none; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hashing import ALNUM, byte_symbols, lower, prefix, span_hash, window_hash, word_spans
from ._shared import batchwise, doc_texts, slices, string_parts

#: Phrases and labels of the contract: fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices and headers as their publishers give them, and short statements of a licence, with the label that each one adds.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-release": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "gpl-3.0-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
#: Names and versions that tell a template's licence from others, in the spellings that count; templates without one name none.
TELLS = {
    "mit-release": ("the mit license",),
    "apache-2.0": ("apache license version 2", "apache license 2 0", "apache license v2"),
    "apache-2.0-notice": ("apache license version 2", "apache license 2 0", "apache license v2"),
    "gpl-3.0": ("gnu general public license version 3", "gnu general public license v3"),
    "gpl-notice": ("gnu general public license",),
    "apache-2.0-header": ("apache license version 2", "apache license 2 0", "apache license v2"),
    "gpl-2.0-or-later": ("either version 2 of the license",),
    "gpl-3.0-or-later": ("either version 3 of the license",),
    "agpl-notice": ("gnu affero general public license",),
    "mpl-2.0-header": ("mozilla public license v 2 0", "mozilla public license version 2 0"),
    "cc-by-nc-4.0": ("cc by nc 4 0",),
    "cc-by-4.0": ("creative commons attribution 4 0",),
}
K = 3
DRIFT = 2
COVER = 0.6
_BATCH_BYTES = 2 << 20


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = word_spans(raw, ALNUM)
    return span_hash(prefix(byte_symbols(raw)), first, last), first


def _phrase_hashes(text: str) -> np.ndarray:
    return _word_hashes(np.frombuffer(text.encode(), np.uint8))[0]


def template_grams(spark, templates: dict[str, str] = TEMPLATES, k: int = K, tells: dict[str, tuple[str, ...]] = TELLS) -> DataFrame:
    """(gram, template, tell, at, n_template): the template side of the join, a fixed list of some hundred rows; tell is -1 for the template itself."""
    rows = []
    for name, text in templates.items():
        for tell, phrase in enumerate((text, *tells.get(name, ())), -1):
            grams = window_hash(_phrase_hashes(phrase), k).view(np.int64).tolist()
            rows += [(g, name, tell, j, len(phrase.split())) for j, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template string, tell int, at int, n_template int")


def text_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text_key long, i int, gram long): every word k-gram of every text."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for a, b in slices(where, _BATCH_BYTES):
                words, edge = _words(raw, where[a : b + 1])
                grams = window_hash(words, k)
                row = np.repeat(np.arange(b - a), np.diff(edge))
                inside = np.flatnonzero(row[: len(grams)] == row[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
                at = row[inside]
                take = pa.array(a + at)
                yield pa.RecordBatch.from_arrays(
                    [whole.column("doc_id").take(take), whole.column("text_key").take(take), pa.array((inside - edge[at]).astype(np.int32)), pa.array(grams[inside].view(np.int64))],
                    ["doc_id", "text_key", "i", "gram"],
                )

    return _keyed(docs).mapInArrow(batchwise(roll), "doc_id long, text_key long, i int, gram long")


def _words(raw: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts and where each text's words start."""
    texts = b"\n".join(raw[i:j].tobytes() for i, j in zip(where[:-1], where[1:], strict=True))
    words, first = _word_hashes(lower(np.frombuffer(texts, np.uint8)))
    return words, np.searchsorted(first, where - where[0] + np.arange(len(where)))


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).withColumn("text_key", F.xxhash64("text"))


def base_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_base, first_word, last_word, base_labels array)."""
    known = [(_phrase_hashes(p), label) for p, label in PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for a, b in slices(where, _BATCH_BYTES):
                words, edge = _words(raw, where[a : b + 1])
                row = np.repeat(np.arange(b - a), np.diff(edge))
                n, first, last = np.zeros(b - a, np.int64), np.full(b - a, np.iinfo(np.int64).max), np.full(b - a, -1)
                labels: list[list[str]] = [[] for _ in range(b - a)]
                for phrase, label in known:
                    k = len(phrase)
                    at = np.flatnonzero(words[: max(0, len(words) - k + 1)] == phrase[0])
                    for j in range(1, k):
                        at = at[words[at + j] == phrase[j]]
                    at = at[row[at] == row[at + k - 1]]
                    np.add.at(n, row[at], 1)
                    np.minimum.at(first, row[at], at - edge[row[at]])
                    np.maximum.at(last, row[at], at - edge[row[at]])
                    for r in np.unique(row[at]).tolist():
                        labels[r].append(label)
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column("doc_id").slice(a, b - a), whole.column("text_key").slice(a, b - a), pa.array(np.diff(edge)), pa.array(n),
                        pa.array(first, mask=n == 0), pa.array(last, mask=n == 0), pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels"],
                )

    return _keyed(docs).mapInArrow(batchwise(scan), "doc_id long, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")


def diagonal_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, drift: int = DRIFT, cover: float = COVER, tells: dict[str, tuple[str, ...]] = TELLS) -> DataFrame:
    """(doc_id, text_key, template, start, end, covered, share): verified spans of words [start, end).

    The join's template side is a fixed list, so it is broadcast; only hits shuffle, by document and template.
    """
    grams = template_grams(docs.sparkSession, templates, k, tells)
    hits = text_grams(docs, k).join(F.broadcast(grams), "gram").select("doc_id", "text_key", "i", "template", "tell", "at", "n_template").distinct()
    doc = ["doc_id", "text_key", "template", "tell", "n_template"]
    votes = hits.groupBy(*doc, (F.col("i") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("ats"), F.collect_set("i").alias("places"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    along = Window.partitionBy(*doc).orderBy("diagonal")
    # Names and versions stand on one diagonal: theirs are not merged.
    new = F.when((F.col("tell") < 0) & (F.col("diagonal") - F.lag("diagonal").over(along) <= drift), 0).otherwise(1)
    runs = votes.withColumn("new", new).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # Verification, of the merged run and of its diagonals alone: template words under its k-grams, each counted once, less the
    # words of the span that no k-gram covers: 1 - (missing + foreign words) / words. A run can't drift far by foreign words.
    runs = runs.withColumn("one", F.explode(F.array(F.lit(None).cast("int"), F.col("diagonal"))))
    under = lambda c: F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list(c)), lambda a: F.sequence(a, a + (k - 1))))))
    spans = runs.groupBy(*doc, "run", "one").agg(F.min("lo").alias("start"), (F.max("hi") + k).alias("end"), under("ats").alias("covered"), under("places").alias("known"))
    share = (F.col("covered") - (F.col("end") - F.col("start") - F.col("known"))) / F.col("n_template")
    spans = spans.withColumn("share", share).filter(F.col("share") >= F.when(F.col("tell") < 0, cover).otherwise(1.0))
    # Diagonals speak for themselves only where their run does not.
    merged = F.max(F.col("one").isNull()).over(Window.partitionBy(*doc, "run"))
    spans = spans.withColumn("merged", merged).filter(F.col("one").isNull() | ~F.col("merged"))
    # A name touches a span if it begins before the span's end and ends after its start: of the names that begin before each end, in
    # order, the one that reaches farthest says it.
    tell = F.col("tell") >= 0
    sweep = Window.partitionBy("doc_id", "text_key", "template").orderBy(F.when(tell, F.col("start")).otherwise(F.col("end")), F.when(tell, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    touches = F.coalesce(F.col("reach") > F.col("start"), F.lit(False))
    named = F.col("template").isin([name for name in templates if tells.get(name)])
    spans = spans.withColumn("reach", F.max(F.when(tell, F.col("end"))).over(sweep)).filter((F.col("tell") < 0) & (~named | touches))
    return spans.select("doc_id", "text_key", "template", "start", "end", "covered", "share")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """op1: base places and the labels and score of both methods, one row a document."""
    spans = diagonal_spans(docs).groupBy("doc_id", "text_key").agg(F.collect_set("template").alias("added"), F.max("share").alias("share"))
    spans = spans.withColumnRenamed("doc_id", "span_doc").withColumnRenamed("text_key", "span_key")
    base = base_places(docs)
    both = base.join(spans, F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("text_key") == F.col("span_key")), "left")
    added = F.coalesce("added", F.array().cast("array<string>"))
    comma = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", comma(F.col("base_labels")).alias("base_labels"),
        comma(F.concat("base_labels", added)).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


__all__ = ["PHRASES", "TELLS", "TEMPLATES", "base_places", "diagonal_spans", "scan_licenses", "template_grams", "text_grams"]
