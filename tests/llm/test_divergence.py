"""Divergence of sources against sums over all terms, by plain Python."""

import random
import re
from collections import Counter, defaultdict

from helpers import EDGES, FOLD, SCHEMA, frame

from tracemill.llm import source_divergence as divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) of rows (id, text, lang, source, ...)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(FOLD))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [term for term, n in docs[lang].items() if n >= min_docs]

        def shares(own):
            total = sum(own[term] for term in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {source: shares(counts[lang, source]) for source in sources}
        q = shares(sum((counts[lang, source] for source in sources), Counter()))
        for source in sources:
            pairs = [
                (sum((p[source][t] - p[peer][t]) ** 2 // (p[source][t] + p[peer][t]) for t in kept), peer)
                for peer in sources - {source}
            ]
            own = [
                ((p[source][t] - q[t]) ** 2 // (p[source][t] + q[t]), t)
                for t in kept
                if counts[lang, source][t] and p[source][t] > q[t]
            ]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, x, v, i + 1) for i, (v, x) in enumerate(found[:most])]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def corpus(pick, size):
    """One source of one language holds a third of all rows; terms from common to rare."""
    rows = []
    for i in range(size):
        lang, source = ("en", "hot") if i % 3 == 0 else (pick.choice(["en", "de", "q"]), f"s{pick.randint(0, 6)}")
        words = [f"W{chr(97 + int(pick.paretovariate(0.6)) % 26)}{chr(97 + pick.randint(0, 3))}é" for _ in range(12)]
        rows.append((i, pick.choice([" ", "-", "1"]).join(words), lang, source, 3))
    return rows


def test_sums_equal_plain_python(spark, monkeypatch):
    rows = corpus(random.Random(2), 240) + EDGES
    rows += [(None, "lonely words", "xx", "only", 1), (1, None, "en", "empty", 0), (1, "", None, None, 0)]
    docs = frame(spark, rows)
    wanted = expected(rows)
    assert len({row[2] for row in wanted}) == 2 and ("en", "empty", "pair") in {row[:3] for row in wanted}
    assert found(divergence.source_divergence(docs)) == wanted
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 7)  # many blocks
    assert found(divergence.source_divergence(docs)) == wanted
    assert found(divergence.source_divergence(docs, min_docs=2, top=3)) == expected(rows, 2, 3)


def test_a_language_that_keeps_nothing_has_zeros(spark):
    rows = [(1, "one two", "de", "a", 1), (2, "three", "de", "b", 1)]
    wanted = [("de", "a", "pair", "b", 0, 1), ("de", "b", "pair", "a", 0, 1)]
    assert found(divergence.source_divergence(frame(spark, rows))) == wanted == expected(rows)
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact(spark):
    counts = [(7 * 10**15, 9 * 10**15, 10**12), (0, 3, 1), (0, 0, 5), (10**10, 10**10 + 1, 2)]
    df = spark.createDataFrame(counts, "c long, t long, v long")
    made = df.select(divergence.shares(df.c, df.t, df.v).cast("long")).collect()
    assert [r[0] for r in made] == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in counts]


def test_no_rows_of_pairs_of_postings(spark):
    """A block of postings gives a row per pair of groups, however many terms they share."""
    import pandas as pd

    rows = pd.DataFrame(
        [("l", 0, f"s{s}", f"t{t}", 10 + s * t, 5) for s in range(4) for t in range(200)],
        columns=["lang", "block", "source", "term", "p", "base"],
    )
    assert len(divergence._accumulate(rows)) == 12
