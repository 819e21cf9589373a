"""Texts without the lines that a host repeats, and all counts, against plain Python."""

import random
import re
from collections import Counter, defaultdict

from helpers import EDGES, FOLD, frame, words

from tracemill.llm.line_frequency import Rules, quality_rules

RULES = Rules(line_docs=6, line_share=0.1)


def expected(rows, rules=RULES):
    """(id, counts, verdict, text) of rows (id, text, lang, host, ...)."""
    hosts, docs = Counter(), defaultdict(set)

    def normal(line):
        return re.sub("[0-9]+", "0", " ".join(words(line)).translate(FOLD))

    for i, (_, text, _, host, *_) in enumerate(rows):
        hosts[host] += 1
        for line in (text or "").split("\n"):
            if words(line):
                docs[host, normal(line)].add(i)
    out = []
    for _, (key, text, _, host, *_) in enumerate(rows):
        lines = (text or "").split("\n")
        limit = max(rules.line_docs, hosts[host] * rules.line_share)
        common = [bool(words(x)) and len(docs[host, normal(x)]) > limit for x in lines]
        own = words(text)
        lost = sum(len(words(x)) for x, gone in zip(lines, common) if gone)
        worded = [x for x in lines if words(x)]
        windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        again = {p for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for p in range(i, i + 8)}
        failed = len(own) < rules.min_words or 100 * len(again) > 30 * len(own)
        out.append(
            (
                str(key),
                len(own),
                sum(map(len, own)),
                sum(c in "#*$%&|<>" for c in text or ""),
                len(worded) - len(set(worded)),
                len(again),
                lost,
                failed,
                not failed and 100 * (len(own) - lost) >= rules.least_left_percent * len(own),
                None if text is None else "\n".join(x for x, gone in zip(lines, common) if not gone),
            )
        )
    return sorted(out, key=str)


def test_cleaned_texts_and_verdicts(spark):
    pick = random.Random(4)
    shared = [f"Share this page with {n} friends & <more> #today" for n in (1, 22, 333)] + ["MENU | home", "  menu | HOME "]
    rows = [row for row in EDGES if len(row[1] or "") < 1000]
    for i in range(300):
        # A third of all rows are of one host, and one host is unknown.
        host = "hot" if i % 3 == 0 else pick.choice(["small", "b", None])
        own = [" ".join(f"w{pick.randint(0, 9999)}" for _ in range(pick.randint(1, 15))) for _ in range(pick.randint(0, 4))]
        lines = own + pick.choices(shared, k=pick.randint(0, 9)) + [""] * pick.randint(0, 2)
        pick.shuffle(lines)
        rows.append((1000 + i, "\n".join(lines), "en", host, 1))
    docs = frame(spark, rows)
    found = quality_rules(docs, rules=RULES, cleaned="clean text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate"]
    got = [
        (str(r["doc_id"]), *(r[name] for name in names), r["base_failed"], r["kept"], r["clean text"])
        for r in found.collect()
    ]
    wanted = expected(rows)
    assert sorted(got, key=str) == wanted
    # Documents that fail nothing else, and are rejected for what is left of them.
    assert sum(not row[-3] and not row[-2] for row in wanted) > 3
    assert sum(row[-2] for row in wanted) > 3 and any(row[3] for row in wanted) and any(row[4] for row in wanted)
    assert "clean text" not in quality_rules(docs).columns
