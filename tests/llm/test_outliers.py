"""Texts that lie out in one statistic alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import quality


def test_each_statistic_rejects_alone(spark):
    rng = np.random.default_rng(4)
    made = iter(range(10**9))

    def words(n):
        return [f"{next(made):06d}"[::-1] for _ in range(n)]  # all different, of one length

    def text(n, line=10):
        some = words(n)
        return "\n".join(" ".join(some[i : i + line]) for i in range(0, n, line))

    rows = [(i, text(int(n))) for i, n in enumerate(np.exp(rng.normal(5.3, 0.4, 400)).clip(60, 900))]
    passage = words(29)
    rows += [
        (1000, text(20_000)),
        (1001, " ".join(w + w for w in words(200))),
        (1002, text(200) + " #" * 40),
        (1003, "\nRead more\n".join(" ".join(words(6)) for _ in range(50))),
        (1004, " ".join(passage + words(142) + passage)),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality.quality_rules(frame, carry=["doc_id"]).collect()}
    assert not any(found[i]["base_failed"] for i in range(1000, 1005))
    assert [i for i in range(1000, 1005) if found[i]["kept"]] == []
    assert np.mean([found[i]["kept"] for i in range(400)]) > 0.98


def test_two_texts_have_an_estimate():
    rows = np.array([[5.0, 1.5, 2.0, 0.4, 0.3], [9.0, 2.5, 0.0, 0.0, 0.0]])
    moments = {"n": 2} | {f"s{i}": rows[:, i].sum() for i in range(5)}
    moments |= {f"s{i}_{j}": (rows[:, i] * rows[:, j]).sum() for i in range(5) for j in range(i, 5)}
    _, weights = quality._estimate(moments, 1.0)
    assert np.isfinite(weights).all() and np.linalg.eigvalsh(np.reshape(weights, (5, 5))).min() > 0


def concentrated(rows):
    """Plain concentration steps over one group: location and inverse scatter of the nearest three quarters, from the median."""
    mean, weights = np.median(rows, axis=0), np.diag(1 / np.square(quality.FIRST_DEVIATION))
    for _ in range(quality.STEPS):
        off = rows - mean
        kept = rows[np.argsort(np.einsum("ij,jk,ik->i", off, weights, off))[: int(np.ceil(quality.SUPPORT * len(rows)))]]
        scatter = np.cov(kept.T, bias=True) * quality.SUPPORT
        scatter /= 1 - quality._chi_tail(quality.cutoff(5, 1 - quality.SUPPORT), 7)
        mean, weights = kept.mean(0), np.linalg.inv(scatter)
    return mean, weights


@pytest.mark.parametrize("broadcast", [20_000, 1])
def test_estimates_against_plain_steps(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "GROUPS_BROADCAST", broadcast)
    rng = np.random.default_rng(8)
    groups = {"": 0, "=a": 3, "=b": -2}
    rows = {g: rng.normal(shift, 1, (1500, 5)) @ np.diag([1, 2, 1, 0.5, 3]) for g, shift in groups.items()}
    rows["=a"][:150] += 40
    frame = spark.createDataFrame(
        [(g, *map(float, r)) for g, some in rows.items() for r in some] + [(f"={i}", *[float(i)] * 5) for i in range(300)],
        "g string, f0 double, f1 double, f2 double, f3 double, f4 double",
    )
    table, few = quality.robust_estimates(frame)
    found = {r["g"]: r for r in table.collect()}
    assert set(found) == set(groups) and few == (broadcast > 1)  # groups of one row have no estimate
    for g, some in rows.items():
        mean, weights = concentrated(some)
        assert found[g]["n"] == 1500 and np.allclose(found[g]["m"], mean, atol=0.12)
        assert np.allclose(np.reshape(found[g]["w"], (5, 5)), weights, rtol=0.1, atol=0.05)


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 30 + F.col("id") % 50), lambda i: F.concat(F.lit("w"), i * (F.col("id") + 7))))
    frame = spark.range(25_000).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("host"), F.col("id")).alias("source")
    )
    hot = frame.limit(300).withColumn("source", F.lit("hot")).unionByName(frame).limit(2_300)
    whole = {r["doc_id"]: r for r in quality.quality_rules(frame, carry=["doc_id"]).collect()}
    assert len(whole) == 25_000 and all(r["distance"] is not None for r in whole.values())
    few = sorted(map(str, quality.quality_rules(hot, carry=["doc_id", "source"]).collect()))
    monkeypatch.setattr(quality, "GROUPS_BROADCAST", 1)
    many = quality.quality_rules(hot, carry=["doc_id", "source"]).collect()
    rounded = lambda line: line.split("distance=")[0]
    assert sorted(rounded(str(r)) for r in many) == sorted(rounded(r) for r in few)
    assert quality.quality_rules(hot.limit(0)).count() == 0
