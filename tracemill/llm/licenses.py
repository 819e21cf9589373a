"""Licences of documents: TF-IDF cosines to templates, then the nearest directory.

Lines that speak of a licence are headers. A header, and the whole text of a
document that has one, is a sparse vector of its words, weighted by how rare they
are among all headers, and is compared with the templates by cosine. Whole texts are
also compared with the texts of licences, in which words are weighted by how rare
they are among these texts. A document whose whole text is like a template or a
licence's text is a licence file: it also holds for the documents below its
directory that show no licence of their own, the nearest directory first. An SPDX
identifier in a header names its licence. DataFrame functions only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.stored import bounded, stored
from tracemill.session import rows_frame

# Notices by which licences are usually stated.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License"),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "Released into the public domain under the Unlicense"),
)

# Whole texts, named by their SPDX identifiers.
TEXTS = Path(__file__).resolve().parent / "license_texts"

# What follows names licences; how a version is meant does not count.
SPDX = r"(?i)SPDX-License-Identifier:(.*)"
SPDX_END = r"(-only|-or-later|\+)$"

CUE = r"(?i)licen[cs]|copyright|spdx|public domain"
WORD = r"[^a-z0-9.+-]+"
EDGE = r"^[.+-]+|[.+-]+$"


def templates(spark: SparkSession) -> DataFrame:
    """The notices above as a table of ``license`` and ``text``."""
    return rows_frame(spark, TEMPLATES, "license string, text string")


def license_texts(spark: SparkSession) -> DataFrame:
    """Whole licences as a table of ``license`` and ``text``."""
    texts = {file.stem: file.read_text("utf-8") for file in sorted(TEXTS.glob("*.txt"))}
    # The Affero licence is GPL-3.0 under another name, but for its section 13.
    texts["AGPL-3.0"] = re.sub(r"(?i)GNU(\s+)General", r"GNU Affero\1General", texts["GPL-3.0"])
    return rows_frame(spark, [*texts.items()], "license string, text string")


def license_scan(
    docs: DataFrame,
    known: DataFrame,
    path: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    header_cosine: float = 0.6,
    file_cosine: float = 0.6,
    full_texts: DataFrame | None = None,
    full_cosine: float = 0.8,
) -> DataFrame:
    """The licence of every document and where it comes from.

    ``known`` and ``full_texts``, notices and whole licences, have ``license`` and
    ``text``, ``path`` gives a document's place, with ``/`` between directories. Returns one row per row of ``docs``: its id, ``path``,
    ``n_headers`` (lines with a cue), ``license``, ``cosine`` (six places) and ``origin``:
    ``file`` if the whole text is like a template or a whole licence, ``header`` if a
    line is like a template or names a known licence after ``SPDX-License-Identifier:``
    (cosine 1), ``inherited`` if the nearest directory above with a licence file has one, else
    null. Of several the one with the largest cosine counts, then the first name. A
    null or empty text has no header; without a path nothing is inherited. Rows
    that repeat a path and an id are told apart. No other columns are used.
    """
    rows = stored(
        docs.select(
            F.col(doc_id).alias("id"),
            path.cast("string").alias("path"),
            F.filter(F.split(F.col(text), "\n", -1), lambda line: line.rlike(CUE)).alias("headers"),
            F.when(F.col(text).rlike(CUE), F.col(text)).alias("whole"),
        ),
        "license-rows",
    )
    # Numbered from the stored rows, and stored with the number.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "license-numbered")
    headers = rows.select("row", F.posexplode("headers").alias("place", "text"))
    wholes = rows.where("whole is not null").select(
        "row", F.lit(-1).alias("place"), F.col("whole").alias("text")
    )
    named = known.select("license", "text").distinct()
    named = named.select(F.xxhash64("license", "text").alias("row"), "license", "text")
    # Rarity is counted over all headers and the templates.
    shapes = _words(headers, "row", "place").unionByName(
        _words(named.withColumn("place", F.lit(0)), "row", "place")
    )
    rarity = stored(
        shapes.groupBy("word").agg(F.count("*").alias("texts")), "license-words"
    )
    number = headers.count() + named.count()
    best = _nearest(headers.unionByName(wholes), named, rarity, number)
    least = F.when(F.col("is_file"), F.lit(file_cosine)).otherwise(header_cosine)
    best = best.where(F.col("best.less") <= -least).unionByName(_spdx(headers, known, full_texts))
    if full_texts is not None:
        full = full_texts.select("license", "text").distinct()
        full = full.select(F.xxhash64("license", "text").alias("row"), "license", "text")
        rarity = _words(full, "row").groupBy("word").agg(F.count("*").alias("texts"))
        whole = _nearest(wholes, full, stored(rarity, "license-words"), full.count())
        best = best.unionByName(whole.where(F.col("best.less") <= -full_cosine))
    own = best.groupBy("row").agg(
        F.min(F.when(F.col("is_file"), F.col("best"))).alias("file"),
        F.min(F.when(~F.col("is_file"), F.col("best"))).alias("header"),
    )
    direct = stored(
        rows.select("row", "id", "path", F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"))
        .join(own, "row", "left")
        .withColumn(
            "origin",
            F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header"),
        )
        .withColumn("best", F.coalesce("file", "header"))
        .withColumn("directory", _directory(F.col("path")))
        .drop("file", "header"),
        "license-direct",
    )
    # One directory may hold most documents: its licence is sent to them where the
    # list of directories that have one is short.
    inherited = stored(_inherited(direct).withColumnRenamed("directory", "below"), "directories")
    joined = direct.join(
        bounded(inherited, 400), (F.col("directory") == F.col("below")) & F.col("origin").isNull(), "left"
    )
    found = F.coalesce("best", "from_above")
    return joined.select(
        F.col("id").alias(doc_id),
        "path",
        F.greatest("n_headers", F.lit(0)).cast("long").alias("n_headers"),
        found["license"].alias("license"),
        (-found["less"]).alias("cosine"),
        F.coalesce("origin", F.when(F.col("from_above").isNotNull(), "inherited")).alias("origin"),
    )


def _nearest(texts: DataFrame, named: DataFrame, rarity: DataFrame, number: int) -> DataFrame:
    """``best`` for every ``row`` and ``is_file``: less the largest cosine, and its licence."""
    idf = F.log((1 + number) / (1 + F.coalesce("texts", F.lit(0)))) + 1

    def vectors(frame: DataFrame, *keys: str) -> DataFrame:
        weighed = _words(frame, *keys).join(rarity, "word", "left").withColumn("w", F.col("n") * idf)
        norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return weighed.join(norms, [*keys]).select(*keys, "word", (F.col("w") / F.col("norm")).alias("w"))

    models = stored(vectors(named, "license", "row"), "license-models").withColumnsRenamed(
        {"row": "template", "w": "other"}
    )
    return (
        vectors(texts, "row", "place")
        .join(models, "word")
        .groupBy("row", "place", "license", "template")
        .agg(F.sum(F.col("w") * F.col("other")).alias("cosine"))
        .groupBy("row", (F.col("place") < 0).alias("is_file"))
        .agg(F.min(F.struct((-F.round("cosine", 6)).alias("less"), "license")).alias("best"))
    )


def _spdx(headers: DataFrame, known: DataFrame, full_texts: DataFrame | None) -> DataFrame:
    """``row``, ``is_file`` and ``best`` of headers with the identifier of a known licence."""
    names = known.select("license")
    if full_texts is not None:
        names = names.unionByName(full_texts.select("license"))
    names = names.distinct().withColumn("name", _identifier(F.col("license")))
    said = F.split(F.regexp_extract("text", SPDX, 1), r"[^A-Za-z0-9.+-]+")
    asked = headers.where(F.col("text").rlike(SPDX)).select("row", F.explode(said).alias("said"))
    return (
        asked.select("row", _identifier(F.col("said")).alias("name"))
        .join(F.broadcast(names), "name")
        .groupBy("row")
        .agg(F.min(F.struct(F.lit(-1.0).alias("less"), "license")).alias("best"))
        .select("row", F.lit(False).alias("is_file"), "best")
    )


def _identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), SPDX_END, "")


def _inherited(direct: DataFrame) -> DataFrame:
    """For every directory the licence of the nearest directory above, or its own."""
    files = (
        direct.where("origin = 'file' and directory is not null")
        .groupBy("directory")
        .agg(F.min("best").alias("from_above"))
        .withColumnRenamed("directory", "holder")
    )
    parts = F.split("directory", "/")
    depth = F.size(parts)
    above = (
        direct.where("directory is not null")
        .select("directory")
        .distinct()
        .withColumn("depth", F.explode(F.sequence(F.lit(0), depth)))
        .withColumn("holder", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    )
    return (
        above.join(files, "holder")
        .groupBy("directory")
        .agg(F.max_by("from_above", "depth").alias("from_above"))
    )


def _directory(path: Column) -> Column:
    """The path without its last part; the top is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _words(frame: DataFrame, *keys: str) -> DataFrame:
    """Words of ``text`` and how often each stands there."""
    words = F.transform(F.split(F.lower("text"), WORD), lambda w: F.regexp_replace(w, EDGE, ""))
    kept = F.filter(words, lambda w: w != "")
    return (
        frame.select(*keys, F.explode(kept).alias("word"))
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("n"))
    )
