"""Removal of repeated byte strings against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from sparkweft.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """Per row of (key, text), in the order in which strings count as earlier: bytes, removed bytes, spans, digest."""
    seen, out = set(), []
    for _, raw in texts:
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            else:
                seen.add(raw[i : i + length])
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length=100, **options):
    frame = spark.createDataFrame([(k, t) for k, t in texts], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.without_repeats(frame, length=length, **options).collect()}
    ordered = sorted(((k, (t or "").encode()) for k, t in texts), key=lambda x: x[0])
    assert found == dict(zip([k for k, _ in ordered], brute(ordered, length), strict=True))


def test_query_over_all_documents(spark):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_dedup(spark, SF).collect()}
    assert found == dict(zip([d for d, _ in docs], brute(docs, 100), strict=True))


@pytest.mark.parametrize("crowd", [32_768, 3])
def test_passages_of_every_length_and_overlap(spark, crowd):
    """Passages at, above and below the length, overlapping, within one text, periodic; with anchors split and not."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé ß"), n))
    passage, texts = word(400), []
    for key in range(60):
        a, n = rng.integers(0, 300), rng.choice([20, 60, 80, 95, 100, 101, 130, 250])
        texts.append((key, word(rng.integers(0, 120)) + passage[a : a + n] + word(rng.integers(0, 120)) + passage[: rng.integers(0, 150)]))
    texts += [(100, "ab" * 200), (101, "x" * 99), (102, "x" * 100), (103, "x" * 300), (104, ""), (105, None), (106, texts[3][1]), (107, texts[3][1] + "!")]
    check(spark, texts, crowd=crowd)
    check(spark, texts, length=40, gram=8, crowd=crowd)


def test_text_of_several_segments(spark, monkeypatch):
    rng = np.random.default_rng(6)
    body = rng.integers(97, 123, 30_000, dtype=np.uint8).tobytes()
    text = body + body[5_000:9_000] + rng.integers(97, 123, 3_000, dtype=np.uint8).tobytes() + body[:150]
    whole = suffix_dedup.anchors([text])
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 4_096)
    cut = suffix_dedup.anchors([text])
    windows = lambda found: sorted((w, int(h)) for h, _, a, b in zip(*found[1], strict=True) for w in range(a, b + 1))
    assert windows(whole) == windows(cut) and len(windows(cut)) == len(text) - 99


def test_sort_survives_hash_collisions(monkeypatch):
    """With a tiny modulus nearly all comparisons collide somewhere; the verified order is right all the same."""
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    starts = np.arange(300)
    order, common = suffix_dedup.sorted_suffixes(data, starts, starts + 100, np.repeat([0, 1, 2], 100))
    for block in range(3):
        rows = order[block * 100 : block * 100 + 100]
        parts = [data[s : s + 100].tobytes() for s in rows]
        assert parts == sorted(parts) and sorted(rows) == list(range(block * 100, block * 100 + 100))
    assert (common[[0, 100, 200]] == -1).all()
    made = []

    class Weak(suffix_dedup._Suffixes):
        def __init__(self, data, starts, ends, base):
            made.append(base)
            super().__init__(data, starts, ends, base)
            if len(made) < 3:
                self.hash[:] = 0  # everything is equal

    monkeypatch.setattr(suffix_dedup, "_Suffixes", Weak)
    again, _ = suffix_dedup.sorted_suffixes(data, starts, starts + 100, np.repeat([0, 1, 2], 100))
    assert len(made) == 3 and [data[s : s + 100].tobytes() for s in again] == [data[s : s + 100].tobytes() for s in order]


def test_odd_rows(spark):
    long = "a long text of words " * 5000
    schema = "doc_id long, text string, h long, num string, `odd.name` string"
    rows = [(1, None, 1, "x", ""), (2, "", 1, "x", ""), (3, long, 1, "x", ""), (3, long, 1, "x", ""), (None, long, 1, "x", ""), (None, None, 1, "x", ""), (4, "short", 1, "x", "")]
    frame = spark.createDataFrame(rows, schema)
    found = sorted((tuple(r) for r in suffix_dedup.without_repeats(frame, rest=True).collect()), key=str)
    own = brute([(3, long.encode())], 100)[0]
    assert len(found) == 7
    assert [r[1:3] for r in found if r[0] == 3] == [(len(long), own[1]), (len(long), len(long))]  # in this order as texts
    assert [r[1:4] for r in found if r[0] is None] == [(0, 0, 0), (len(long), len(long), 1)]
    kept = [r[5] for r in found if r[0] == 3 and r[2] == own[1]][0]
    assert hashlib.sha256(kept).hexdigest() == own[3]
    assert suffix_dedup.without_repeats(frame.limit(0)).collect() == []
