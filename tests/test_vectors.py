"""Vector operators against plain restatements of their rules."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.functions import vectors
from sparkweft.operators import blocks, cases, cluster, kmeans, pieces, similar, similarity
from sparkweft.operators.encode import encode
from sparkweft.staging import recorded


def unit_rows(count, dim, seed):
    rows = np.random.default_rng(seed).normal(size=(count, dim))
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def vector_frame(spark, rows, key="vec_id"):
    data = [(i, None if row is None else [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, f"{key} long, embedding array<float>")


def leader_rule(rows, threshold):
    """The scan, restated: first leader that is close enough, else a new cluster."""
    leaders, found = [], {}
    for i, row in enumerate(rows):
        if row is None:
            continue
        v = np.asarray(row, dtype=np.float64)
        home = next((j for j, (_, w) in enumerate(leaders) if round(float(v @ w), 9) >= threshold), None)
        if home is None:
            home = len(leaders)
            leaders.append((i, v))
        found[i] = (home, leaders[home][0])
    return found


@pytest.mark.parametrize("block_rows", [3, 16, 500])
@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9999])
def test_leader_clusters_equal_the_scan(spark, block_rows, threshold):
    rows = list(unit_rows(60, 4, 3))
    rows[7] = rows[20] = None
    rows[30:45] = [rows[2]] * 15  # a large group of copies
    got = cluster.leader_clusters(vector_frame(spark, rows).repartition(3), threshold=threshold, block_rows=block_rows)
    assert {r["vec_id"]: (r["cluster_id"], r["leader"]) for r in got.collect()} == leader_rule(rows, threshold)


def test_leader_rounds_write_no_vectors_and_clear_up(spark):
    rows = list(unit_rows(80, 4, 5))
    rows[40:] = rows[:40]
    with recorded(paths := []):
        got = cluster.leader_clusters(vector_frame(spark, rows), threshold=0.9, block_rows=16)
    assert {r["vec_id"]: (r["cluster_id"], r["leader"]) for r in got.collect()} == leader_rule(rows, 0.9)
    left = [spark.read.parquet(path) for path in paths if os.path.exists(path.removeprefix("file:"))]
    assert left and not any("embedding" in frame.columns for frame in left)
    assert sum(frame.count() for frame in left) == len(rows)  # each row once


def test_blocks_of_wide_vectors_shrink(spark, monkeypatch):
    rows = list(unit_rows(30, 6, 7))
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 48)
    got = cluster.leader_clusters(vector_frame(spark, rows), threshold=0.8)
    assert {r["vec_id"]: (r["cluster_id"], r["leader"]) for r in got.collect()} == leader_rule(rows, 0.8)
    cut = list(blocks.vector_blocks(vector_frame(spark, rows), "vec_id", "embedding", 100))
    assert sorted(i for block in cut for i in block.columns["vec_id"].tolist()) == list(range(30))
    assert all(block.vectors.size <= 48 for block in cut)
    with pytest.raises(ValueError, match="more components"):
        list(blocks.vector_blocks(vector_frame(spark, [[1.0] * 50]), "vec_id", "embedding", 100))


def test_leader_clusters_are_not_transitive(spark):
    angles = [0.0, 0.5, 1.0]
    rows = [[np.cos(a), np.sin(a)] for a in angles]
    got = cluster.leader_clusters(vector_frame(spark, rows), threshold=0.85).orderBy("vec_id").collect()
    assert [r["cluster_id"] for r in got] == [0, 0, 1]


def test_leader_clusters_of_nothing_zero_vectors_and_text_keys(spark):
    assert cluster.leader_clusters(vector_frame(spark, [None])).count() == 0
    zero = cluster.leader_clusters(vector_frame(spark, [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])).orderBy("vec_id").collect()
    assert [r["cluster_id"] for r in zero] == [0, 1, 2]
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "path string, embedding array<float>")
    got = cluster.leader_clusters(named, "path").orderBy("path").collect()
    assert [(r["path"], r["leader"]) for r in got] == [("a", "a"), ("b", "a")]


def test_similarity_exactly_at_the_threshold(spark):
    got = cluster.leader_clusters(vector_frame(spark, [[1.0, 0.0], [0.5, 0.5]]), threshold=0.5)
    assert cluster.cluster_sizes(got).collect()[0]["members"] == 2


def test_default_k():
    assert [kmeans.default_k(n) for n in (0, 1, 5, 6, 29, 30, 1000)] == [1, 1, 1, 2, 9, 10, 10]


def test_kmeans_finds_far_groups(spark):
    rows = [[1.0, 0.01 * i] for i in range(6)] + [[-1.0, 0.01 * i] for i in range(6)]
    got = {r["vec_id"]: r["cluster_id"] for r in kmeans.kmeans(vector_frame(spark, rows), k=2, restarts=2).collect()}
    assert len({got[i] for i in range(6)}) == 1 and got[0] != got[6] and len(set(got.values())) == 2
    assert {r["cluster_id"] for r in kmeans.kmeans(vector_frame(spark, rows[:2])).collect()} == {0}


def lloyd(rows, centres):
    while True:
        near = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([rows[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(moved - centres).max() < 1e-12:
            return moved, ((rows - moved[near]) ** 2).sum()
        centres = moved


@pytest.mark.parametrize("most", [blocks.BLOCK_VALUES, 200])
def test_kmeans_runs_match_single_runs(spark, monkeypatch, most):
    monkeypatch.setattr(kmeans, "BLOCK_VALUES", most)  # 200: sums by a shuffle, runs in groups, starts from 66 rows
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(240, 3)).astype(np.float32).astype(float)
    frame = vector_frame(spark, rows.tolist()).repartition(4)
    found = kmeans.fit_kmeans(frame, k=5, restarts=4, tol=1e-12)
    ordered = np.array([r["embedding"] for r in frame.orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").limit(min(4096, most // 3)).collect()], dtype=float)
    single = [lloyd(rows, kmeans.spread_starts(ordered, 5, np.random.default_rng(42 + run))) for run in range(4)]
    assert found.costs == pytest.approx([cost for _, cost in single])
    best = min(range(4), key=lambda run: single[run][1])
    assert found.centres == pytest.approx(single[best][0]) and found.cost == min(found.costs)



def test_kmeans_without_step_limit_ends(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(300, 2)).astype(np.float32).astype(float)
    frame = vector_frame(spark, rows.tolist()).repartition(3)
    ordered = np.array([r["embedding"] for r in frame.orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").collect()], dtype=float)
    ended, cost = lloyd(rows, kmeans.spread_starts(ordered, 6, np.random.default_rng(42)))
    cut = kmeans.fit_kmeans(frame, k=6, restarts=1, max_iter=2, tol=0.0)
    assert cut.centres != pytest.approx(ended)  # two steps do not end it: a limit leaves centres that are no means
    found = kmeans.fit_kmeans(frame, k=6, restarts=1, max_iter=None, tol=0.0)
    assert found.centres == pytest.approx(ended) and found.cost == pytest.approx(cost)

def test_kmeans_odd_rows(spark):
    assert kmeans.kmeans(vector_frame(spark, [[1.0]]).limit(0)).collect() == []
    same = vector_frame(spark, [[1.0, 2.0]] * 40).withColumn("other", F.lit("x"))
    assert {r["cluster_id"] for r in kmeans.kmeans(same, restarts=2).collect()} == {0}
    some = same.unionByName(same.limit(1).withColumn("embedding", F.lit(None).cast("array<float>")))
    assert kmeans.kmeans(some, k=3, restarts=2).count() == 40
    with pytest.raises(Exception, match="dimension"):
        kmeans.kmeans(vector_frame(spark, [[1.0], [1.0, 2.0]]), k=2, restarts=2).collect()


def top_rule(queries, candidates, k, method):
    found = {}
    for q, row in enumerate(queries):
        scored = []
        for c, other in enumerate(candidates):
            if other is not None:
                a, b = np.asarray(row, np.float64), np.asarray(other, np.float64)
                scored.append((round(float(-np.linalg.norm(a - b) if method == "euclidean" else a @ b), 9), c))
        found[q] = [c for _, c in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return found


@pytest.mark.parametrize("method", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("sizes", [{}, {"max_query_block": 4}])
def test_top_k_equals_brute_force(spark, method, sizes):
    rows = list(unit_rows(40, 5, 8))
    rows[10:25] = [rows[3]] * 15  # equal scores go to the lowest id
    rows[5] = None
    queries = unit_rows(11, 5, 9)
    got = {}
    frame = similarity.top_k(
        vector_frame(spark, queries, "query_id"), vector_frame(spark, rows, "candidate_id").repartition(3), 6, method, **sizes
    )
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == top_rule(queries, rows, 6, method)


def test_top_k_larger_than_the_candidates_and_bad_input(spark):
    rows = unit_rows(3, 4, 1)
    assert similarity.top_k(vector_frame(spark, rows[:1], "query_id"), vector_frame(spark, rows, "candidate_id"), 9).count() == 3
    with pytest.raises(ValueError):
        similarity.top_k(vector_frame(spark, rows, "query_id"), vector_frame(spark, rows, "candidate_id"), 1, "other")
    with pytest.raises(Exception, match="dimension"):
        similarity.top_k(
            vector_frame(spark, unit_rows(1, 3, 1), "query_id"), vector_frame(spark, rows, "candidate_id"), 1
        ).collect()


def test_score_slices_do_not_change_the_result(spark, monkeypatch):
    from sparkweft.operators import blocks

    parts = list(blocks.row_slices(10, 3))
    monkeypatch.setattr(blocks, "SCORE_VALUES", 12)
    cut = list(blocks.row_slices(10, 3))
    assert parts == [slice(0, 10)] and [s.stop - s.start for s in cut] == [4, 4, 2]


LIBRARY = "case_no long, case_name string, idx long, path string, embedding array<float>, description string"


def library_frame(spark, classes):
    data = [
        (no, name, i, f"{name}{i}", None if v is None else [float(x) for x in v], "")
        for no, (name, samples) in enumerate(classes) for i, v in enumerate(samples)
    ]
    return spark.createDataFrame(data, LIBRARY)


def class_rule(items, classes, k):
    found = {}
    for i, row in enumerate(items):
        scores = []
        for no, (_, samples) in enumerate(classes):
            best = max([-1.0] + [round(float(np.asarray(row, np.float64) @ np.asarray(v, np.float64)), 9) for v in samples if v is not None])
            scores.append((best, no))
        found[i] = [no for _, no in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return found


@pytest.mark.parametrize("sizes", [{}, {"max_library_block": 4}])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_classes_equal_brute_force(spark, sizes, k):
    rnd = random.Random(5)
    classes = [(f"c{n}", list(unit_rows(rnd.randint(1, 5), 4, n))) for n in range(5)] + [("empty", [None]), ("copy", [])]
    classes[6] = ("copy", classes[1][1])
    items = unit_rows(17, 4, 77)
    got = {}
    frame = cases.nearest_classes(vector_frame(spark, items, "item_id"), library_frame(spark, classes), k, **sizes)
    for r in frame.orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["case_no"])
        assert r["case_name"] == classes[r["case_no"]][0]
    assert got == class_rule(items, classes, k)


def test_nearest_classes_keep_the_library_off_the_driver(spark, monkeypatch):
    rnd = random.Random(9)
    classes = [(f"c{n}", list(unit_rows(rnd.randint(3, 9), 4, 40 + n))) for n in range(6)]
    items = unit_rows(23, 4, 78)
    library = library_frame(spark, classes)

    def refused(self, *args, **kwargs):
        raise AssertionError("a frame of vectors was taken to the driver")

    monkeypatch.setattr(type(library), "toArrow", refused)
    frame = cases.nearest_classes(vector_frame(spark, items, "item_id"), library, 3, max_library_block=4)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    got = {}
    for r in frame.orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["case_no"])
    assert got == class_rule(items, classes, 3)


def test_classify_below_threshold_without_vector_and_without_library(spark):
    library = library_frame(spark, [("a", [[1.0, 0.0]]), ("b", [[0.0, 1.0]])])
    items = vector_frame(spark, [[1.0, 0.0], [0.0, -1.0], None], "item_id")
    got = {r["item_id"]: r["case_name"] for r in cases.classify(items, library, 0.5).collect()}
    assert got == {0: "a", 1: "未分类", 2: "未分类"}
    assert {r["case_name"] for r in cases.classify(items, library.limit(0)).collect()} == {"未分类"}


def test_library_changes(spark):
    library = library_frame(spark, [("a", [[1.0], [2.0], [3.0]]), ("b", [[4.0]])])
    gone = cases.remove_sample(library, "a", 1)
    assert sorted((r["path"], r["idx"]) for r in gone.collect()) == [("a0", 0), ("a2", 1), ("b0", 0)]
    assert cases.has_case(library, "a", 2) and not cases.has_case(library, "a", 3) and not cases.has_case(library, "z")
    assert cases.remove_sample(library, "a", 9).count() == 4
    assert [r["case_name"] for r in cases.list_classes(cases.remove_sample(library, "b", 0)).collect()] == ["a"]
    assert cases.remove_class(library, "a").count() == 1
    assert cases.get_sample(library, "a").head()["path"] == "a0" and cases.get_sample(library, "a", 5).isEmpty()
    fresh = spark.createDataFrame(
        [("a", "x2", [1.0], ""), ("new", "y", [1.0], ""), ("a", "x1", [1.0], ""), ("a", "bad", None, "")],
        "case_name string, path string, embedding array<float>, description string",
    )
    added = {r["path"]: (r["case_no"], r["idx"]) for r in cases.add_cases(library, fresh).collect()}
    assert added["x1"] == (0, 3) and added["x2"] == (0, 4) and added["y"] == (2, 0) and "bad" not in added
    assert cases.add_cases(library.limit(0), fresh).count() == 3


def test_row_wise_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        vectors.dot(a, b).alias("dot"), vectors.euclidean(a, b).alias("far"), vectors.unit(a).alias("unit"),
        vectors.dimension(a).alias("dim"),
    ).collect()
    assert [r["dot"] for r in got] == [24.0, 0.0, None, None]
    assert got[0]["far"] == pytest.approx(2**0.5) and got[2]["far"] is None
    assert got[0]["unit"] == pytest.approx([0.6, 0.8]) and got[1]["unit"] is None
    assert [r["dim"] for r in got] == [2, 2, 1, None]


def test_encode_with_a_callers_model(spark):
    def make_model():
        def predict(values):
            return np.array([[float(v), 2.0] if v >= 0 else [np.nan, 1.0] for v in values], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(1, 0.0), (2, 1.5), (3, None), (4, -1.0)], "i int, x double")
    got = {r["i"]: r["embedding"] for r in encode(df, "x", make_model, batch_size=2).collect()}
    assert got[1] == pytest.approx([0.0, 1.0]) and got[2] == pytest.approx([0.6, 0.8])
    assert got[3] is None and got[4] is None


def test_encode_keeps_the_others_of_a_failing_batch(spark):
    def make_model():
        def predict(values):
            if any(v == "bad" for v in values):
                raise ValueError("bad")
            return np.array([[3.0, 4.0 if v else 0.0] for v in values], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, ""), (5, "bad")], "i int, x string").coalesce(1)
    frame = encode(df, "x", make_model, batch_size=8)
    got = {r["i"]: r["embedding"] for r in frame.collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[4] == pytest.approx([1.0, 0.0])
    assert got[2] is None and got[3] is None and got[5] is None
    assert not encode(df.where("x = 'bad'"), "x", make_model).where("embedding is not null").count()
    assert encode(df.limit(0), "x", make_model).isEmpty()


def test_peeling_rounds_follow_chains_not_rows(spark, monkeypatch):
    """Each vector of a chain of twenty is close to its neighbours only, in an order that makes rows wait for each other; beside
    many more vectors."""
    angles = np.concatenate([np.arange(20) * 0.1, 0.05 + np.arange(12) * 0.17])
    chain = [[np.cos(a), np.sin(a), 0.0] for a in angles]
    rows = [[float(x) for x in row] for row in chain] + list(unit_rows(300, 3, 4) * np.float32(2))
    searches = []
    monkeypatch.setattr(cluster, "compare", lambda *args: searches.append(1) or pieces.compare(*args))
    got = cluster.leader_clusters(vector_frame(spark, rows), threshold=0.99, block_rows=40)
    assert {r["vec_id"]: (r["cluster_id"], r["leader"]) for r in got.collect()} == leader_rule([np.float32(r) for r in rows], 0.99)
    assert 1 < len(searches) <= 15


def similar_rule(rows, threshold, method):
    v = np.array([r for r in rows if r is not None], dtype=np.float32).astype(np.float64)
    ids = [i for i, r in enumerate(rows) if r is not None]
    scores = -np.linalg.norm(v[:, None] - v[None], axis=2) if method == "euclidean" else v @ v.T
    hits = np.round(scores, 9) >= threshold
    np.fill_diagonal(hits, False)
    found = {}
    for place, i in enumerate(ids):
        linked = [ids[j] for j in np.flatnonzero(hits[place])]
        found[i] = (len(linked), linked[0] if linked and linked[0] < i else None)
    return found


@pytest.mark.parametrize(("method", "threshold"), [("cosine", 0.6), ("cosine", 0.0), ("euclidean", -0.5)])
def test_similar_rows_equal_all_pairs(spark, method, threshold):
    rows = list(unit_rows(150, 4, 11))
    rows[9] = None
    rows[60:100] = [rows[3]] * 40  # a large group of copies
    rows[100:103] = [[0.0] * 4] * 3  # similar to themselves by distance only, or at zero
    rows[103:105] = [[0.5, 0.5, 0.5, 0.5], [0.6, 0.6, 0.0, 0.0]]  # exactly at 0.6
    got = similar.similar_rows(vector_frame(spark, rows).repartition(3), threshold=threshold, method=method, piece_rows=20)
    assert {r["vec_id"]: (r["links"], r["first"]) for r in got.collect()} == similar_rule(rows, threshold, method)


def test_similar_rows_of_nothing_and_text_keys(spark):
    assert similar.similar_rows(vector_frame(spark, [None])).collect() == []
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "path string, embedding array<float>")
    got = similar.similar_rows(named, "path").orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a", 1, None), ("b", 1, "a"), ("c", 0, None)]


def grouped_rows(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 8))
    rows = np.concatenate([centre + rng.normal(size=(100, 8)) * 0.05 for centre in centres])
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def test_pieces_leave_most_pairs_out_and_no_match(spark):
    rows = grouped_rows(12)
    frame = vector_frame(spark, rows).withColumnRenamed("embedding", "vector")
    pivots = pieces.choose_pivots(frame, "vector")
    cut = pieces.cut(frame, "vector", pivots, "vec_id", 50)
    ends = pieces.heads(cut, "vector", pivots)
    count = ends.count()
    assert count < 40 + len(pivots) and ends.agg(F.sum("rows"), F.max("rows")).head() == (2000, 50)
    of = np.empty(2000, dtype=np.int64)
    for row in cut.select("vec_id", pieces.PIECE).collect():
        of[row[0]] = row[1]
    scores = rows.astype(np.float64) @ rows.astype(np.float64).T
    met = {(r["p"], r["q"]) for r in pieces.partners(ends, ends, "cosine", 0.95).collect()}
    needed = {(int(of[i]), int(of[j])) for i, j in zip(*np.nonzero(scores >= 0.95), strict=True)}
    assert needed <= met and len(met) < 0.25 * count * count


@pytest.mark.parametrize("method", ["cosine", "euclidean"])
def test_pruned_search_scores_few_pairs(spark, method, monkeypatch):
    rows = grouped_rows(13)
    scored = []
    monkeypatch.setattr(similarity, "compare", lambda left, right, pairs, *rest: scored.append(pairs.count()) or pieces.compare(left, right, pairs, *rest))
    monkeypatch.setattr(similarity, "piece_size", lambda *_: 50)
    got = similarity.top_k(vector_frame(spark, rows[::2], "query_id"), vector_frame(spark, rows, "candidate_id"), 7, method, max_query_block=50)
    found = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row["candidate_id"])
    assert found == top_rule(rows[::2], rows, 7, method)
    assert sum(scored) < 0.4 * 20 * 40  # pairs of pieces, of all there are


def test_small_query_pieces_meet_a_candidate_piece_together(spark):
    left = spark.createDataFrame([(i, i // 2) for i in range(8)], f"id long, {pieces.PIECE} long")  # pieces 0 to 3
    right = spark.createDataFrame([(10 + i, i // 3) for i in range(6)], f"id long, {pieces.PIECE} long")  # pieces 0, 1
    pairs = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (2, 1)], "p long, q long")

    def work(p, q, own, others):
        import pyarrow as pa

        return pa.table({"p": [p], "q": [q], "own": [sorted(own.column("id").to_pylist())], "others": [sorted(others.column("id").to_pylist())]})

    found = pieces.compare(left, right, pairs, work, "p long, q long, own array<long>, others array<long>", 4)
    got = sorted((r["p"], r["q"], r["own"], r["others"]) for r in found.collect())
    assert got == [(0, 0, [0, 1], [10, 11, 12]), (1, 0, [2, 3], [10, 11, 12]), (2, 1, [4, 5], [13, 14, 15]), (3, 0, [6, 7], [10, 11, 12])]


def test_groups_of_pieces_meet_once_and_work_only_listed_pairs(spark):
    left = spark.createDataFrame([(i, i // 2) for i in range(8)], f"id long, {pieces.PIECE} long")  # pieces 0 to 3
    right = spark.createDataFrame([(10 + i, i // 2) for i in range(8)], f"id long, {pieces.PIECE} long")  # pieces 0 to 3
    pairs = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (3, 2), (2, 3), (1, 1)], "p long, q long")

    def work(p, q, own, others):
        import pyarrow as pa

        return pa.table({"p": [p], "q": [q], "own": [sorted(own.column("id").to_pylist())], "others": [sorted(others.column("id").to_pylist())]})

    found = pieces.compare(left, right, pairs, work, "p long, q long, own array<long>, others array<long>", 2, 2)
    got = sorted((r["p"], r["q"], r["own"], r["others"]) for r in found.collect())
    assert got == [
        (0, 1, [0, 1], [12, 13]), (1, 0, [2, 3], [10, 11]), (1, 1, [2, 3], [12, 13]), (2, 3, [4, 5], [16, 17]), (3, 2, [6, 7], [14, 15]),
    ]


@pytest.mark.parametrize(("spread", "searched"), [(0.05, False), (2.0, True)])
def test_leader_sweeps_compare_rows_with_leaders_only(spark, monkeypatch, spread, searched):
    """Rows of a few clusters are settled without a search among all rows; rows without clusters are not."""
    rng = np.random.default_rng(21)
    rows = [v / np.linalg.norm(v) for v in np.eye(8)[rng.integers(0, 8, 300)] + rng.normal(0, spread, (300, 8))]
    rows = [row.astype(np.float32) for row in rows]
    rows[11], rows[50:60] = None, [rows[3]] * 10
    searches = []
    monkeypatch.setattr(cluster, "compare", lambda *args: searches.append(1) or pieces.compare(*args))
    monkeypatch.setattr(cluster, "LAST_ROWS", 40)
    monkeypatch.setattr(cluster, "_CUT_BINS", 3)
    threshold = 0.9 if not searched else 0.97
    got = cluster.leader_clusters(vector_frame(spark, rows), threshold=threshold, block_rows=64)
    assert {r["vec_id"]: (r["cluster_id"], r["leader"]) for r in got.collect()} == leader_rule(rows, threshold)
    assert bool(searches) == searched


@pytest.mark.parametrize("method", ["cosine", "dot", "euclidean"])
def test_bounded_rows_are_not_scored_in_full(monkeypatch, method):
    """Rows with a floor score only what can reach it, and find the same as a full score."""
    rng = np.random.default_rng(17)
    for spread in (1.0, 1e-3, 300.0):
        left, right = rng.normal(0, spread, (40, 16)), rng.normal(0, spread, (5000, 16))
        right[7] = right[4000] = left[3]
        scores = blocks.score(left, right, method)
        floor = np.sort(scores, axis=1)[:, -9]
        rows, cols = similarity.best_per_row(scores, 5)
        with monkeypatch.context() as patch:
            patch.setattr(similarity, "score", None)
            got = similarity.best_above(left, right, floor, 5, method)
        assert got[0].tolist() == rows.tolist() and got[1].tolist() == cols.tolist()
        assert got[2] == pytest.approx(scores[rows, cols], abs=2e-9 * spread**2, rel=1e-9)
    free = similarity.best_above(left, right, np.full(40, -np.inf), 5, method)
    assert free[1].tolist() == cols.tolist()
