"""Operators on texts against plain Python, on small and odd tables."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import (
    ALNUM,
    CLASHES,
    EDGES,
    LONG,
    SCHEMA,
    components,
    contaminated,
    dedup_lines as plain_lines,
    frame,
    near_links,
    sha,
    windows,
    words,
)
from pyspark.sql import functions as F

from tracemill.llm import near_dedup
from tracemill.llm.components import components as spark_components
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.licenses import license_scan, license_texts, templates
from tracemill.llm.line_dedup import CuckooFilter, dedup_lines, line_index
from tracemill.llm.line_frequency import Rules, quality_rules
from tracemill.llm.near_dedup import near_duplicates
from tracemill.llm.stored import BitFilter, bit_filter
from tracemill.llm.substring_dedup import COVER, PERIOD, drop_repeats

VOCABULARY = [f"wo{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def by_text(rows, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


# Decontamination


def test_decontamination_of_edge_cases(spark):
    passage = prose(1, 30)
    items = [
        ("b", passage),
        ("a", passage),
        ("a", passage),
        (None, passage),
        ("short", "Just THREE words"),
        ("one", "unicorn"),
        ("none", " !? "),
        ("null", None),
        ("umlaut", "schöne Grüße"),
    ]
    inner = " ".join(passage.split()[7:22])
    docs = [
        *EDGES,
        (20, f"start, {inner.upper()}! end", "en", "a", 1),
        (21, " ".join(passage.split()[:9]), "en", "a", 1),
        (22, "so: just-three\nwords; unicorn unicorns", "en", "a", 1),
        (23, " ".join([passage] * 50), "en", "a", 1),
        (23, " ".join([passage] * 50), "en", "a", 1),
        (24, "schöne Grüße", "de", "a", 1),
    ]
    found = decontaminate(
        frame(spark, docs), spark.createDataFrame(items, "item_id string, text string")
    ).collect()
    named = [(key, text) for key, text in items if key]
    wanted = []
    for key, text, *_ in docs:
        hit, _ = contaminated(text, items)
        owners = contaminated(text, named)[1]
        n = len(words(text, ALNUM, True))
        wanted.append((str(key), str(n), str(len(hit)), str(sorted(owners)), str(bool(hit))))
    rows = [
        (
            str(r.doc_id),
            str(r.n_words),
            str(sum(s.length for s in r["spans"])),
            str(list(r["items"])),
            str(r.contaminated),
        )
        for r in found
    ]
    assert sorted(rows) == sorted(wanted)
    for r in found:
        ends = [s.start + s.length for s in r["spans"]]
        assert all(a < s.start for a, s in zip(ends, r["spans"][1:]))


def test_decontamination_without_rows(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, EDGES)
    found = decontaminate(docs, items).collect()
    assert len(found) == len(EDGES) and not any(r.contaminated or r["items"] for r in found)
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontaminate(docs.limit(0), some).count() == 0


def test_bit_filter_loses_nothing(spark):
    held = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    made = bit_filter(spark.createDataFrame([(int(h),) for h in held], "hash long"), 5000)
    assert isinstance(made, BitFilter)
    assert made.may_hold(held.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 5000)
    assert made.may_hold(others.view(np.uint64)).mean() < 0.1


# Substring dedup


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def plain_repeats(texts, size=35):
    counts = Counter(w for text in texts for w in windows(words(text), size))
    out = []
    for text in texts:
        own = words(text)
        gone = {
            p
            for i, w in enumerate(windows(own, size))
            if counts[w] > 1
            for p in range(i, i + size)
        }
        out.append((len(own), len(gone), " ".join(w for p, w in enumerate(own) if p not in gone)))
    return out


@pytest.mark.parametrize("digest", [False, True])
def test_substring_dedup_equals_brute_force(spark, digest):
    shared = [prose(seed, n) for seed, n in ((1, 34), (2, 35), (3, 36), (4, 80), (5, 200))]
    pick = random.Random(9)
    docs = [*EDGES]
    for i in range(60):
        parts = [prose(100 + i, pick.randint(0, 60))]
        for _ in range(pick.randint(0, 3)):
            parts += [pick.choice(shared), prose(pick.random(), pick.randint(0, 9))]
        docs.append((100 + i, pick.choice([" ", "\n", " \t "]).join(parts), "en", "a", 1))
    docs.append((300, " ".join(["same"] * 80), "en", "a", 1))
    found = drop_repeats(frame(spark, docs), digest=digest).collect()
    plain = plain_repeats([row[1] for row in docs])
    wanted = [
        (str(row[0]), str(n), str(gone), sha(kept) if digest else kept)
        for row, (n, gone, kept) in zip(docs, plain)
    ]
    assert by_text(found, "doc_id", "n_words", "n_removed", "kept") == sorted(wanted)


def test_substring_dedup_without_rows(spark):
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        drop_repeats(spark.createDataFrame([], SCHEMA), window=21)


# Near-duplicates


def near_texts():
    """A base with many copies that are mostly not near each other, chains, and short texts."""
    pick, texts = random.Random(4), {}
    base = prose(50, 150).split()
    for i in range(120):
        own = list(base)
        for _ in range(pick.randint(0, 4)):
            own[pick.randrange(150)] = pick.choice(VOCABULARY)
        texts[1000 - i] = " ".join(own)
    chain = prose(51, 200).split()
    for i in range(12):
        chain = chain[4:] + [f"new{i}{j}" for j in range(4)]
        texts[2000 + i] = " ".join(chain)
    for i in range(150):
        texts[3000 + i] = prose(500 + i, pick.randint(1, 90))
    for i in range(8):
        texts[4000 + i] = "A few words" if i % 2 else "a  FEW\nwords"
    texts[4100] = "a b a b a b a b a b"
    texts[4101] = "b a b a b a b a b a b a"
    return texts


@pytest.mark.parametrize("block", [2_000_000, 4_000])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "TASK_SHINGLES", block)
    texts = near_texts()
    sets, links = near_links(texts)
    wanted = components(texts, links)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(7)
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {key: r.component_id for key, r in found.items()} == wanted
    assert all(r.n_shingles == len(sets[key]) for key, r in found.items())
    assert all(r.kept == (key == wanted[key]) for key, r in found.items())


def test_near_duplicates_of_edge_cases(spark):
    found = near_duplicates(frame(spark, EDGES)).collect()
    rows = by_text(found, "doc_id", "n_shingles", "component_id", "kept")
    assert len(rows) == len(EDGES)
    assert ("1", "0", "1", "True") in rows and ("3", "0", "3", "True") in rows
    assert rows.count(("5", str(len(set(windows(words(LONG, fold=True), 5)))), "4", "False")) == 2
    assert ("None", "1", "6", "False") in rows  # the same word as in 6
    assert ("None", "0", "None", "True") in rows
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame([*path, *star, (7, 7)], "a long, b long").repartition(5)
    found = {r.node: r.component for r in spark_components(edges).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}
    assert spark_components(edges.limit(0)).count() == 0


def test_sketches_estimate_high_similarities():
    random_sets = np.random.default_rng(3)
    for share, low, high in ((1.0, 0, 0), (0.95, 0, 1), (0.3, 2, 9)):
        whole = random_sets.integers(0, 1 << 63, 4000, dtype=np.uint64)
        shared = int(share * 2000)
        one, two = whole[:2000], np.concatenate([whole[:shared], whole[2000 : 4000 - shared]])
        jaccard = shared / (4000 - shared)
        samples = near_dedup._samples(np.concatenate([one, two]), np.array([0, 2000]))
        assert abs((samples[:, 0] == samples[:, 1]).mean() - jaccard) < 0.13
        sketches = near_dedup._folded(samples)
        ones = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        most = near_dedup._most_ones(85)
        assert (ones <= most) == (jaccard > 0.71)


# Lines


def line_rows():
    a, b = "A line that is long enough to be counted, surely.", "Another line of forty code points — at least!"
    rows = [(i, f"{a}\nown {i}\n\n{b if i % 2 else b.upper()}  ", "en", "a", 1) for i in range(30, 36)]
    rows += [(40, f"\t{a} \n{a}\n{a}", "en", "a", 1), (41, "short\n" * 9, "en", "a", 1)]
    return [*rows, *((50 + i, "short", "en", "a", 1) for i in range(9)), *EDGES]


def test_line_dedup_equals_plain_python(spark):
    docs = line_rows()
    found = dedup_lines(frame(spark, docs))
    plain = plain_lines([row[:2] for row in docs])
    wanted = sorted(
        (str(row[0]), str(kept if row[1] is not None else None), str(n), str(lost))
        for row, (kept, n, lost) in zip(docs, plain)
    )
    rows = found.collect()
    assert by_text(rows, "doc_id", "text", "n_lines", "n_dropped") == wanted
    assert {*CLASHES} <= {*found.columns} and all(r["key"] == "clash" for r in rows)
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_can_be_taken_back(spark):
    docs = [row for row in line_rows() if row[0] is not None and row[0] >= 30]
    first, later = docs[:5], docs[5:]
    made = spark.createDataFrame(docs, SCHEMA)
    index = line_index(spark.createDataFrame(first, SCHEMA)).insert(
        spark.createDataFrame(later, SCHEMA)
    )

    def state(index):
        return sorted((bytes(r.key), r.docs, r.keeper) for r in index.counts.collect())

    def texts(index):
        return by_text(dedup_lines(made, index=index).collect(), "doc_id", "text")

    whole = line_index(made)
    assert state(index) == state(whole) and texts(index) == texts(whole)
    gone = spark.createDataFrame([(row[0],) for row in later], "doc_id long")
    back = index.delete(gone)
    assert state(back) == state(line_index(spark.createDataFrame(first, SCHEMA)))
    again = back.insert(spark.createDataFrame(later, SCHEMA))
    assert state(again) == state(whole) and texts(again) == texts(whole)
    assert state(whole.delete(spark.createDataFrame([(35,)], "doc_id long"))) == state(
        line_index(made.where("doc_id != 35"))
    )


def test_cuckoo_filter_inserts_and_removes():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    made = CuckooFilter.of(keys)
    assert made.may_hold(keys).all() and (made.cells != 0).sum() == len(keys)
    others = np.random.default_rng(2).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert made.may_hold(others).mean() < 0.001
    made.remove(keys[:20_000])
    assert made.may_hold(keys[20_000:]).all() and (made.cells != 0).sum() == len(keys) - 20_000
    assert made.may_hold(keys[:20_000]).mean() < 0.001
    assert made.insert(keys[:20_000]) and made.may_hold(keys).all()
    assert not CuckooFilter(10).insert(keys)
    assert CuckooFilter.of(keys[:0]).may_hold(keys).any() == False  # noqa: E712


# Rules


def test_rules_of_edge_cases(spark):
    rows = quality_rules(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    for key, text, *_ in EDGES:
        own = words(text)
        twice = Counter(windows(own, 8))
        again = {p for i, w in enumerate(windows(own, 8)) if twice[w] > 1 for p in range(i, i + 8)}
        assert any(
            str(r.doc_id) == str(key)
            and r.n_words == len(own)
            and r.word_chars == sum(map(len, own))
            and r.n_repeat_words == len(again)
            and r.base_failed == (len(own) < 20 or 100 * len(again) > 30 * len(own))
            for r in rows
        )
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_lines_of_a_host(spark):
    common = "Subscribe to our newsletter number 7 today and never miss a thing"
    rows = [(i, f"{prose(i, 40)}\n{common.replace('7', str(i))}", "en", "big", 1) for i in range(40)]
    rows += [(100 + i, f"{prose(900 + i, 40)}\n{common}", "en", "small", 1) for i in range(5)]
    rows += [(200, f"{prose(77, 20)}\n{' '.join([common.upper()])}", "en", "big", 1)]
    rows += [(201, "\n".join([prose(78, 5), *(f"{common} {x}" for x in "ab")]), "en", None, 1)]
    rows += [(300 + i, f"{common}\nanother thing here {i} and more words to come as they are", "en", "big", 1) for i in range(3)]
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in quality_rules(docs, rules=Rules(least_left_percent=60)).collect()}
    assert all(found[i].n_boilerplate == 12 and found[i].boilerplate == [1] for i in range(40))
    assert all(found[i].kept for i in range(40)) and found[200].n_boilerplate == 12
    assert all(found[100 + i].n_boilerplate == 0 and found[100 + i].kept for i in range(5))
    assert all(not found[300 + i].kept and not found[300 + i].base_failed for i in range(3))
    assert found[201].n_boilerplate == 0


# Licences


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0"),
        ("a/x.py", prose(1, 40)),
        ("a/b/c/y.py", prose(2, 40)),
        ("a/b/d/COPYING", "Released under the MIT License."),
        ("a/b/d/e/z.py", prose(3, 40)),
        ("a/b/d/own.py", f"This work is licensed under the GNU General Public License, version 3.\n{prose(4, 60)}"),
        ("q/lost.py", prose(5, 40)),
        ("top.py", None),
        (None, prose(6, 10)),
        ("ab/near.py", ""),
        ("a/x.py", prose(1, 40)),
    ]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, path string, text string")
    docs = docs.selectExpr("*", "'c' as row", "'c' as license", "'c' as word", "'c' as best")
    found = license_scan(docs, templates(spark), F.col("path")).orderBy("doc_id").collect()
    wanted = [
        ("Apache-2.0", "file"), ("Apache-2.0", "inherited"), ("Apache-2.0", "inherited"),
        ("MIT", "file"), ("MIT", "inherited"), ("GPL-3.0", "header"), (None, None), (None, None),
        (None, None), (None, None), ("Apache-2.0", "inherited"),
    ]
    assert [(r.license, r.origin) for r in found] == wanted
    assert license_scan(docs.limit(0), templates(spark), F.col("path")).count() == 0
    edges = frame(spark, EDGES)
    assert license_scan(edges, templates(spark), F.col("source")).count() == len(EDGES)
    none = templates(spark).limit(0)
    assert license_scan(docs, none, F.col("path")).where("license is not null").count() == 0


def test_license_scan_is_native(spark):
    docs = frame(spark, EDGES)
    found = license_scan(docs, templates(spark), F.col("source"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


MIT_FILE = """MIT License

Copyright (c) 2019 Some One <some@one.example> and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_license_files_and_spdx_headers(spark):
    texts = {r.license: r.text for r in license_texts(spark).collect()}
    rows = [
        ("m/LICENSE", MIT_FILE, "MIT", "file"),
        ("m/src/deep/x.py", prose(1, 40), "MIT", "inherited"),
        ("m/src/a.rs", f"// SPDX-License-Identifier: Apache-2.0\n{prose(2, 40)}", "Apache-2.0", "header"),
        ("m/b.c", f"/* spdx-license-identifier: (GPL-2.0-only WITH Linux-syscall-note) */\n{prose(3, 40)}", "GPL-2.0", "header"),
        ("n/c.c", f"# SPDX-License-Identifier: GPL-3.0-or-later\r\n{prose(4, 40)}", "GPL-3.0", "header"),
        ("n/d.c", f"# SPDX-License-Identifier: LicenseRef-Own\n{prose(5, 40)}", None, None),
        ("n/e.md", "The licence of the software in the book is the one of the author of the text, and the copyright of it is with the author.", None, None),
    ]
    rows += [(f"k{i}/COPYING", f"Copyright 2020 A Person\n\n{text}", name, "file") for i, (name, text) in enumerate(texts.items())]
    rows += [(f"k{i}/sub/f", prose(10 + i, 30), name, "inherited") for i, name in enumerate(texts)]
    docs = spark.createDataFrame([(i, *row[:2]) for i, row in enumerate(rows)], "doc_id long, path string, text string")
    found = license_scan(docs, templates(spark), F.col("path"), full_texts=license_texts(spark))
    found = found.orderBy("doc_id").collect()
    assert [(r.path, r.license, r.origin) for r in found] == [(r[0], r[2], r[3]) for r in rows]
