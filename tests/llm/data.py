"""Small tables of every awkward kind, and plain forms of the operators' rules."""

from __future__ import annotations

import re
from collections import defaultdict

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words string, key int"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30000))
SENTENCE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old tree near our house"
NEAR = SENTENCE.replace("house", "home")


def documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, SENTENCE, "en", "a", 1, 0.5, "x", 1),
        (2, SENTENCE, "en", "a", 1, None, None, None),
        (3, NEAR, None, "a", None, 0.1, "y", 2),
        (4, None, "en", None, None, None, None, None),
        (5, "", "en", "a", 0, 0.2, "z", 3),
        (5, "", "en", "a", 0, 0.2, "z", 3),
        (None, SENTENCE + " and more", "de", "b", 2, 0.3, "n", 4),
        (None, None, None, None, None, None, None, None),
        (6, LONG, "en", "a", 3, 0.4, "l", 5),
        (7, "One two", "en", "a", 3, 0.4, "l", 5),
        (8, "one TWO", "en", "a", 3, 0.4, "l", 5),
        (9, " \n\t\n ", "en", "a", 3, 0.4, "l", 5),
        (10, "a b c a b c a\n\na b\n a b\na b ### <x> ▁▁ é€𝄞\x00", "xx", "y", 3, 0.4, "l", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, docs, column):
    ids = sorted({r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None})
    return spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (3, None)], f"doc_id bigint, {column} int")


def shingle_sets(rows, size=5):
    out = []
    for i, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        n = min(size, len(words))
        out.append((i, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()))
    return out


def linked(rows):
    """(id, set size, least linked id) of every row, by comparing all pairs that share anything."""
    sets = shingle_sets(rows)
    at = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(k)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (_, s) in enumerate(sets):
        for j in {j for g in s for j in at[g] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                parent[find(k)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return sorted(
        ((i, len(s), min(least[find(k)], default=None)) for k, (i, s) in enumerate(sets)), key=repr
    )
