"""How far the sources of a language differ in their words, and in which words.

Every language keeps the terms found in enough of its documents. A group, which is the
documents of one source in one language, gives each kept term a share; shares are
smoothed, so a term that a group lacks has the group's baseline. The divergence of two
groups is a sum over all kept terms, though most terms are in few groups.

That sum is a product of sparse matrices, row by row as Gustavson has it: a group goes
through its terms, looks each up in the index by term, and adds what each posting
changes to one dense accumulator of its peers. No pair of postings is ever a row. What
is added is the change against the baselines; the baselines themselves depend on the two
groups alone and are put in afterwards, from how many terms a group has of each share.

Terms are dealt to blocks by their hash, so a language or group that holds most of all
postings is worked on in many tasks; a block gives a row per pair of groups at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    find_words,
    giving_back,
    hash_words,
    mixed,
    ragged,
    text_blocks,
)
from tracemill.llm.stored import BitFilter, bit_filter, bounded, stored, texts_of

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

# Postings of a block, at most about so many on average.
BLOCK_POSTINGS = 500_000
# A task hands on its counts when it holds so many.
HELD_COUNTS = 1 << 20

# Bytes of terms, and how their case is folded.
LETTERS = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def shares(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term, as a whole number; exact, whatever the counts."""
    wide = (count + 2).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", wide, (total + 2 * terms).cast("decimal(28,0)"))


def change(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence of two shares: a whole number, the same both ways."""
    return (p - q) * (p - q) // (p + q)


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """Divergence of every group from each of its language's other groups, and its own terms.

    Columns ``lang``, ``source``; ``part``, ``pair`` or ``term``; ``item``, the other
    source or the term; ``value``; ``rank`` from 1 by value, largest first, then by item.
    Part ``pair`` has all peers, part ``term`` the ``top`` terms that the group has and
    uses more than its language does.

    Null texts, languages and sources are empty texts. Every document counts, also
    repeated ones and those without an id. Groups without any term are groups: they have
    their baselines. Where a language keeps no term, its values are 0. Other columns are
    ignored, whatever their names; a table without rows gives none.
    """
    asked = texts_of(
        docs,
        *(
            F.coalesce(F.col(name).cast("string"), F.lit("")).alias(own)
            for name, own in ((lang, "lang"), (source, "source"), (text, "text"))
        ),
    )
    postings = stored(_kept_postings(asked, min_docs), "postings")
    langs = postings.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count(F.when(F.col("first"), 1)).alias("terms")
    )
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        asked.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "lang_total", "terms"])
    )
    base = F.when(F.col("terms") > 0, shares(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = stored(groups.withColumn("base", F.coalesce(base, F.lit(0)).cast("long")), "groups")
    few = bounded(groups, 128)
    shared = stored(
        postings.join(few, ["lang", "source"]).select(
            "lang", "source", "term", "base", "n", "lang_n", "lang_total", "terms",
            shares(F.col("n"), F.col("total"), F.col("terms")).cast("long").alias("p"),
        ),
        "shares",
    )
    return _pairs(shared, groups).unionByName(_own_terms(shared, top))


def _kept_postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """Rows ``lang``, ``source``, ``term``, ``n`` of kept terms, with ``lang_n`` over all sources.

    Most terms of a corpus are rare. So a first pass counts documents by hashes alone;
    a bit filter of the hashes that reach the limit, which no kept term fails, holds
    nearly all others off; what gets through is counted exactly, and judged by that.
    """
    hashes = docs.select("lang", "text").mapInArrow(_count_hashes, "hash long, docs long")
    often = hashes.groupBy("hash").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    often = stored(often.select("hash"), "often")
    wanted = bit_filter(often, often.count())
    counts = (
        docs.mapInArrow(
            partial(_count_terms, wanted=wanted), "lang string, source string, term string, n long, docs long"
        )
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    # A term has as many rows as sources: no more than the result has for one of these.
    term = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("lang_docs", F.sum("docs").over(term))
        .where(F.col("lang_docs") >= min_docs)
        .withColumn("lang_n", F.sum("n").over(term))
        .withColumn("first", F.min("source").over(term) == F.col("source"))
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[begins], *(np.add.reduceat(v[order], begins) if len(begins) else v for v in values)


def _terms_of(block, langs: list[str], low: int) -> tuple:
    """Word spans of a block, their rows, and hashes that differ by language."""
    words = find_words(block, LETTERS)
    rows = words.rows()
    seeds = np.array([_seed(x) for x in langs[low + block.low : low + block.high]], np.uint64)
    return words, rows, mixed(hash_words(block, words, lower=True) + seeds[rows])


@giving_back
def _count_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each term, by hash."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> Iterator[pa.RecordBatch]:
        keys, docs = _summed(*(np.concatenate(x) for x in zip(*held)))
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(docs[at : at + 100_000])],
                ["hash", "docs"],
            )

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in text_blocks(batch.column(1)):
            _, rows, hashes = _terms_of(block, langs, 0)
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            found = hashes[new]
            held.append(_summed(found, np.ones(len(found), np.int64)))
            if sum(len(keys) for keys, _ in held) > HELD_COUNTS:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD_COUNTS // 2:
                    yield from made()
                    held = []
    if held:
        yield from made()


class _Counts:
    """Occurrences and documents by group and term, within one task."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, groups: list[tuple[str, str]], rows: np.ndarray, terms: pa.DictionaryArray) -> None:
        """One occurrence of a term in a row for each entry; ``groups`` of the rows."""
        known = [self.groups.setdefault(group, len(self.groups)) for group in groups]
        names = [self.terms.setdefault(term, len(self.terms)) for term in terms.dictionary.to_pylist()]
        codes = np.array(names, np.int64)[terms.indices.to_numpy()]
        cells, n = _summed(rows << 32 | codes, np.ones(len(codes), np.int64))
        of = np.array(known, np.int64)[cells >> 32] << 32 | cells & 0xFFFFFFFF
        self.held.append(_summed(of, n, np.ones(len(of), np.int64)))
        self.size += len(self.held[-1][0])
        if self.size > HELD_COUNTS:
            self.held = [_summed(*(np.concatenate(x) for x in zip(*self.held)))]
            self.size = len(self.held[0][0])

    @property
    def full(self) -> bool:
        return self.size > HELD_COUNTS // 2 or len(self.terms) > HELD_COUNTS // 2

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.held)))
        langs = pa.array([lang for lang, _ in self.groups], pa.string())
        sources = pa.array([source for _, source in self.groups], pa.string())
        terms = pa.array(list(self.terms), pa.string())
        for at in range(0, len(keys), 100_000):
            own = slice(at, at + 100_000)
            group, term = pa.array(keys[own] >> 32), pa.array(keys[own] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group), terms.take(term), pa.array(n[own]), pa.array(docs[own])],
                ["lang", "source", "term", "n", "docs"],
            )


@giving_back
def _count_terms(batches: Iterable[pa.RecordBatch], wanted: BitFilter) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for block in text_blocks(batch.column(2)):
            words, rows, hashes = _terms_of(block, langs, 0)
            asked = np.flatnonzero(wanted.may_hold(hashes))
            if not len(asked):
                continue
            sizes = words.end[asked] - words.begin[asked]
            letters = _LOWER[block.data[ragged(words.begin[asked], sizes)]]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            texts = pa.LargeStringArray.from_buffers(
                len(asked), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))
            )
            own = list(zip(langs[block.low : block.high], sources[block.low : block.high]))
            counts.add(own, rows[asked], texts.dictionary_encode())
            if counts.full:
                yield from counts.batches()
                counts = _Counts()
    yield from counts.batches()


_PARTIAL = "lang string, source string, item string, value long"


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group with every other of its language; a group's rows are the result's own."""
    blocks = max(1, -(-shared.count() // BLOCK_POSTINGS))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    changes = (
        shared.select("lang", block.alias("block"), "source", "term", "p", "base")
        .groupBy("lang", "block")
        .applyInPandas(_accumulate, _PARTIAL)
    )
    peers = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "base"))).alias("peers")
    )
    steps = shared.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    steps = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("steps"))
    bases = (
        groups.join(steps, ["lang", "source"], "left").join(peers, "lang")
        .select("lang", "source", "base", "terms", "steps", "peers")
        .mapInPandas(_baselines, _PARTIAL)
    )
    summed = changes.unionByName(bases).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed, "pair", None)


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _accumulate(rows: pd.DataFrame) -> pd.DataFrame:
    """What the postings of a block change in the divergence of each pair of groups."""
    lang = rows["lang"].iloc[0]
    names, group = np.unique(rows["source"].to_numpy(), return_inverse=True)
    term = pd.factorize(rows["term"])[0]
    p = rows["p"].to_numpy(np.int64)
    base = np.zeros(len(names), np.int64)
    base[group] = rows["base"].to_numpy(np.int64)
    by_term = np.argsort(term, kind="stable")
    peer, share = group[by_term], p[by_term]
    begins = np.concatenate([[0], np.cumsum(np.bincount(term))])
    by_group = np.argsort(group, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(group))])
    out = []
    for own in range(len(names)):
        sums = np.zeros(len(names), np.int64)
        mine = by_group[edges[own] : edges[own + 1]]
        low = 0
        while low < len(mine):  # as many terms at a time as have a block's postings
            counts = np.cumsum(begins[term[mine[low:]] + 1] - begins[term[mine[low:]]])
            high = low + max(1, int(np.searchsorted(counts, BLOCK_POSTINGS)))
            some = mine[low:high]
            sizes = begins[term[some] + 1] - begins[term[some]]
            at = ragged(begins[term[some]], sizes)
            a, b, to = np.repeat(p[some], sizes), share[at], peer[at]
            mean = base[own]
            more = change(a, b) - change(a, base[to]) - change(mean, b) + change(mean, base[to])
            np.add.at(sums, to, more)
            low = high
        sums[own] = 0
        found = np.flatnonzero(sums)
        out.append(pd.DataFrame({"source": names[own], "item": names[found], "value": sums[found]}))
    return pd.concat(out).assign(lang=lang)[["lang", "source", "item", "value"]]


def _baselines(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a group and each peer have if they share no term, from both sides."""
    for batch in batches:
        for row in batch.itertuples():
            names = np.array([peer["source"] for peer in row.peers], object)
            bases = np.array([peer["base"] for peer in row.peers], np.int64)
            if not row.terms:
                sums = shift = np.zeros(len(names), np.int64)
            else:
                shift = change(np.int64(row.base), bases)
                sums = row.terms * shift
            other = np.zeros(len(names), np.int64)
            for step in row.steps if row.steps is not None else ():
                other = other + step["k"] * (change(np.int64(step["p"]), bases) - shift)
            keep = names != row.source
            names, sums, other = names[keep], sums[keep], other[keep]
            yield pd.DataFrame({"lang": row.lang, "source": row.source, "item": names, "value": sums + other})
            yield pd.DataFrame({"lang": row.lang, "source": names, "item": row.source, "value": other})


def _own_terms(shared: DataFrame, top: int) -> DataFrame:
    """The terms that a group uses more than its language, by their divergence."""
    q = shares(F.col("lang_n"), F.col("lang_total"), F.col("terms")).cast("long")
    p = F.col("p")
    rows = shared.withColumn("q", q).where(p > F.col("q"))
    value = F.expr("(p - q) * (p - q) div (p + q)")
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")), "term", top)
