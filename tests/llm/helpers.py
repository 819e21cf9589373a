"""Small tables and plain-Python versions of the operators."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that have the names of the operators' own ones.
CLASHES = (
    "row", "hash", "id", "node", "component", "class", "key", "doc", "keys", "size", "n_words",
    "spans", "items", "kept", "score", "label", "length", "offset", "sequence_id", "n_lines",
)
LONG = "Ein sehr langer Satz, der sich niemals ändert und doch weitergeht. " * 6000
EDGES = [
    (1, None, "de", "a", None),
    (2, "", "de", "a", 0),
    (3, " \t\n\n ", "de", None, 5),
    (4, LONG, "de", "a", 10),
    (5, LONG, "de", "a", 10),
    (5, LONG, "de", "a", 10),
    (6, "one", None, "b", 3),
    (6, "two words", "en", "b", 9),
    (None, "one", "en", "b", 3),
    (None, None, None, None, None),
    (7, "x" * 3_000_000, "en", "b", 3_000_000),
    (8, "Ünïcode words　here ÀÉ\u0085end <|endoftext|> 語", "en", "c", 9),
]


def frame(spark, rows, schema=SCHEMA):
    made = spark.createDataFrame(rows, schema)
    return made.selectExpr("*", *(f"'clash' AS `{c}`" for c in CLASHES if c not in made.columns))


def words(text, pattern=SPACED, fold=False):
    text = text or ""
    return pattern.findall(text.translate(FOLD) if fold else text)


def windows(sequence, size):
    return [tuple(sequence[i : i + size]) for i in range(len(sequence) - size + 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(nodes, links):
    """The smallest reachable node of every node."""
    found = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(found[a], found[b])
            if found[a] != least or found[b] != least:
                found[a] = found[b] = least
                changed = True
    return found


def near_links(texts, similarity=85):
    """Pairs of ids whose shingle sets are near, by looking at all pairs that share one."""
    sets, holders = {}, defaultdict(list)
    for key, text in texts.items():
        own = words(text, fold=True)
        sets[key] = set(windows(own, 5)) if len(own) >= 5 else {tuple(own)} if own else set()
        for shingle in sets[key]:
            holders[shingle].append(key)
    shared = Counter(p for keys in holders.values() for p in itertools.combinations(keys, 2))
    links = [
        (a, b)
        for (a, b), n in shared.items()
        if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n)
    ]
    return sets, links


def dedup_lines(texts, min_docs=5, min_chars=40):
    """Kept text, lines and dropped lines of (id, text) rows, by their numbers."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)

    holders = defaultdict(list)
    for i, (doc, text) in enumerate(texts):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc)
    last = {
        k: max((d for d in docs if d is not None), default=None)
        for k, docs in holders.items()
        if len(docs) >= min_docs
    }
    out = []
    for doc, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def contaminated(text, items, size=10):
    """Hit words and ids of items that have a window in the text."""
    own = words(text, ALNUM, True)
    hit, found = set(), set()
    for item, passage in items:
        passage = words(passage, ALNUM, True)
        k = min(size, len(passage))
        if not k:
            continue
        wanted = set(windows(passage, k))
        for i, window in enumerate(windows(own, k)):
            if window in wanted:
                hit |= set(range(i, i + k))
                found.add(item)
    return hit, found
