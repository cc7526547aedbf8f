"""Ranked search of items against brute force, and on odd rows; the query itself is checked by its SQL."""

from __future__ import annotations

import math
import re
from collections import Counter

from sparkweft.llm import reverse_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k=20):
    counted = [(key, Counter(words), len(words)) for key, text in docs if (words := split(text))]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for key, counts, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t in split(text)
                if counts[t]
            )
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(found)[:k], 1)]
    return out


DOCS = [(n, f"Red fox {n % 5} jumps über DEN Zaun " + "fox " * (n % 7) + "word " * (n % 11)) for n in range(200)]
DOCS += [(None, "red fox red"), (300, None), (301, ""), (302, "... --- \x7f"), (303, "Ä ä red"), (5, "red fox"), (304, "red " * 50_000)]
ITEMS = [(1, "red FOX fox"), (2, "zaun über"), (3, ""), (4, None), (None, "Red"), (1, "red FOX fox"), (6, "nothing here"), (7, "ä Ä 3")]


def test_items_find_their_best_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    wanted = sorted(map(str, brute(ITEMS, DOCS)))
    assert sorted(str(tuple(r)) for r in reverse_search.best_documents(items, docs).collect()) == wanted
    assert sorted(str(tuple(r)) for r in reverse_search.best_documents(items, docs, block_bytes=100).collect()) == wanted  # several passes
    few = sorted(map(str, brute(ITEMS, DOCS, 3)))
    assert sorted(str(tuple(r)) for r in reverse_search.best_documents(items, docs, k=3).collect()) == few


def test_odd_frames(spark):
    items = spark.createDataFrame([(1, "red", "a", 2)], "item_id long, text string, `odd.name` string, n long")
    docs = spark.createDataFrame([(1, "red blue", 3, 4), (2, "red", 3, 4), (2, "red", 3, 4), (3, "blue", 3, 4), (4, "x", 3, 4)], "doc_id int, text string, key long, term long")
    found = reverse_search.best_documents(items, docs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["doc_id"] == "int"
    assert [(r["rank"], r["doc_id"]) for r in found.orderBy("rank").collect()] == [(1, 2), (2, 2), (3, 1)]
    assert reverse_search.best_documents(items.limit(0), docs).collect() == []
    assert reverse_search.best_documents(items, docs.limit(0)).collect() == []
