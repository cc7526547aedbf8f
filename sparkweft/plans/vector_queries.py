"""Queries on vectors: similarity, top-k, clusters, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.vectors import dimension, norm, similarity, unit
from sparkweft.operators.cases import add_cases, classify, list_classes, nearest_classes, remove_class, remove_sample
from sparkweft.operators.cluster import cluster_sizes, leader_clusters
from sparkweft.operators.kmeans import fit_kmeans, kmeans, nearest_centres
from sparkweft.operators.ordinal import member_lists, with_group_ordinal
from sparkweft.operators.similar import similar_rows
from sparkweft.operators.similarity import top_k
from sparkweft.plans.registry import query, table

THRESHOLD = 0.3


@query(
    """
    with v as (select vec_id, embedding::double[] as e, list_reverse(embedding)::double[] as r from embeddings)
    select vec_id, len(e) as dimension, round(list_inner_product(e, r), 6) as cosine,
           round(list_distance(e, r), 6) as euclidean, round(sqrt(list_inner_product(e, e)), 6) as norm,
           1.0::double as unit_norm
    from v
    """
)
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against its reverse, its dimension and length, and its length after scaling."""
    vector, other = F.col("embedding"), F.reverse("embedding")
    tripled = F.transform(vector, lambda x: x * 3)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        dimension(vector).cast("long").alias("dimension"),
        F.round(similarity(vector, other, "cosine"), 6).alias("cosine"),
        F.round(similarity(vector, other, "euclidean"), 6).alias("euclidean"),
        F.round(norm(vector), 6).alias("norm"),
        F.round(norm(unit(tripled)), 6).alias("unit_norm"),
    )


_TOP = """
    with s as (
      select q.vec_id as query_id, c.vec_id as candidate_id, round({score}, 9) as score
      from embeddings q, embeddings c)
    select query_id, candidate_id, round(score, 6) as score, rank
    from (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from s)
    where rank <= 5
"""


def _queries_and_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "candidate_id")


@query(_TOP.format(score="list_inner_product(q.embedding::double[], c.embedding::double[])"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five closest vectors of every vector by cosine."""
    queries, candidates = _queries_and_candidates(spark, sf_dir)
    return top_k(queries, candidates, 5).withColumn("score", F.round("score", 6))


@query(_TOP.format(score="-list_distance(q.embedding::double[], list_reverse(c.embedding)::double[])"))
def vector_topk_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five closest reversed vectors of every vector by distance, the queries in pieces of 200."""
    queries, candidates = _queries_and_candidates(spark, sf_dir)
    reversed_candidates = candidates.withColumn("embedding", F.reverse("embedding"))
    found = top_k(queries, reversed_candidates, 5, "euclidean", max_query_block=200)
    return found.withColumn("score", F.round("score", 6))


@query(
    """
    with s as (
      select a.vec_id, min(case when b.vec_id < a.vec_id then b.vec_id end) as first, count(*) as links
      from embeddings a join embeddings b on a.vec_id <> b.vec_id
       and round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) >= {THRESHOLD} group by a.vec_id)
    select v.vec_id, coalesce(links, 0)::bigint as links, first from embeddings v left join s using (vec_id)
    """.replace("{THRESHOLD}", str(THRESHOLD))
)
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other vectors every vector is similar to, and the first of them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return similar_rows(vectors, threshold=THRESHOLD)


_LEADERS = f"""
    with recursive e as materialized (
      select a.vec_id as i, b.vec_id as j from embeddings a, embeddings b
      where b.vec_id < a.vec_id
        and round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) >= {THRESHOLD}),
    low as materialized (select i, list(j) as l from e group by i),
    nb as materialized (
      select v.vec_id, row_number() over (order by v.vec_id) as rn, coalesce(l, []) as low
      from embeddings v left join low on low.i = v.vec_id),
    g(rn, leaders) as (
      select 0::bigint, []::bigint[]
      union all
      select g.rn + 1, case when list_has_any(g.leaders, nb.low) then g.leaders
                            else list_append(g.leaders, nb.vec_id) end
      from g join nb on nb.rn = g.rn + 1),
    fin as (select leaders from g order by rn desc limit 1),
    clusters as materialized (
      select nb.vec_id, case when list_contains(f.leaders, nb.vec_id) then nb.vec_id
                             else list_min(list_intersect(f.leaders, nb.low)) end as leader,
             list_position(f.leaders, case when list_contains(f.leaders, nb.vec_id) then nb.vec_id
                                           else list_min(list_intersect(f.leaders, nb.low)) end) - 1 as cluster_id
      from nb, fin f)
"""


def _leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return leader_clusters(vectors, threshold=THRESHOLD, block_rows=512)


@query(
    _LEADERS
    + """
    select c.vec_id, c.cluster_id::bigint as cluster_id, c.leader,
           round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as similarity
    from clusters c join embeddings a on a.vec_id = c.vec_id join embeddings b on b.vec_id = c.leader
    """
)
def leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters in id order with the similarity of every member to its leader."""
    return _leaders(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(_LEADERS + "select cluster_id::bigint as cluster_id, count(*) as members from clusters group by cluster_id")
def leader_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per cluster."""
    return cluster_sizes(_leaders(spark, sf_dir))


@query(
    _LEADERS
    + """
    select cluster_id::bigint as cluster_id, part, string_agg(vec_id::varchar, ',' order by vec_id) as members
    from (select cluster_id, vec_id, (row_number() over (partition by cluster_id order by vec_id) - 1) // 3 as part from clusters)
    group by cluster_id, part
    """
)
def leader_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member lists of the clusters, long ones in parts."""
    lists = member_lists(_leaders(spark, sf_dir), "cluster_id", "vec_id", list_rows=3)
    return lists.withColumn("members", F.array_join("members", ","))


@query()
def kmeans_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means clusters of all vectors; labels are not comparable with SQL."""
    groups = kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return groups.withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(
    """
    select count(*) as vectors, count(distinct vec_id) as rows, greatest(1, least(count(*) // 3, 10)) as most_clusters,
           true as labels_fit, true as cost_falls
    from embeddings
    """
)
def kmeans_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for k-means groups whatever their labels: every vector in one, at most k, closer than all together."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    grouped = vectors.join(kmeans(vectors), "vec_id")
    most = F.greatest(F.lit(1), F.least(F.floor(F.count(F.lit(1)) / 3), F.lit(10)))
    counted = grouped.agg(
        F.count(F.lit(1)).alias("vectors"), F.count_distinct("vec_id").alias("rows"), most.alias("most_clusters"),
        ((F.min("cluster_id") >= 0) & (F.max("cluster_id") < most)).alias("labels_fit"),
    )
    cells = grouped.select("cluster_id", F.posexplode("embedding").alias("place", "x"))
    spread = lambda *by: (
        cells.groupBy(*by, "place").agg((F.var_pop("x") * F.count("x")).alias("v")).agg(F.sum("v").alias("cost"))
    )
    costs = spread("cluster_id").withColumnRenamed("cost", "own").unionByName(
        spread().withColumnRenamed("cost", "whole"), allowMissingColumns=True
    )
    found = counted.unionByName(costs, allowMissingColumns=True)  # one row of each kind
    return found.agg(
        *[F.max(name).alias(name) for name in counted.columns], (F.max("own") < F.max("whole")).alias("cost_falls")
    )


@query(
    """
    select count(*) as vectors, true as nearest, true as means, true as least, true as cost_agrees
    from embeddings
    """
)
def kmeans_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That k-means ended: no vector has a nearer centre than its own, each centre is the mean of its vectors, the cost is
    the sum of squared distances and the least of all runs. Distances and means are taken anew by built-in functions."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = fit_kmeans(vectors, tol=1e-9, max_iter=None)  # ended: no step cut
    grouped = vectors.join(nearest_centres(vectors, found.centres), "vec_id")
    ids = list(range(len(found.centres)))  # at most ten
    square = lambda x, c: (x.cast("double") - c) * (x.cast("double") - c)
    away = F.array(*[
        F.aggregate(F.zip_with("embedding", F.lit([float(v) for v in found.centres[i]]), square), F.lit(0.0), lambda a, b: a + b) for i in ids
    ])
    checked = grouped.withColumn("away", away)
    own = F.element_at("away", F.col("cluster_id") + 1)
    by_row = checked.agg(
        F.count(F.lit(1)).alias("vectors"), F.bool_and(own <= F.array_min("away") + 1e-9).alias("nearest"), F.sum(own).alias("cost")
    )
    centres = spark.createDataFrame(
        [(i, place, float(x)) for i in ids for place, x in enumerate(found.centres[i])], "cluster_id int, place int, centre double"
    )
    cells = grouped.select("cluster_id", F.posexplode("embedding").alias("place", "x"))
    means = cells.groupBy("cluster_id", "place").agg(F.avg("x").alias("mean")).join(centres, ["cluster_id", "place"], "full")
    by_centre = means.agg(F.bool_and(F.coalesce(F.abs(F.col("mean") - F.col("centre")) <= 1e-6, F.lit(False))).alias("means"))
    both = by_row.unionByName(by_centre, allowMissingColumns=True)  # one row of each kind
    return both.agg(
        F.max("vectors").alias("vectors"), F.max("nearest").alias("nearest"), F.max("means").alias("means"),
        F.lit(bool(found.cost == min(found.costs))).alias("least"),
        (F.abs(F.max("cost") - found.cost) <= 1e-6 * F.max("cost")).alias("cost_agrees"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case library of all vectors, reversed, by label."""
    samples = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("case_no"),
        F.concat(F.lit("case-"), F.col("label").cast("string")).alias("case_name"),
        F.col("vec_id").cast("string").alias("path"),
        F.reverse("embedding").alias("embedding"),
        F.lit("").alias("description"),
        "vec_id",
    )
    return with_group_ordinal(samples, ["case_no"], ["vec_id"], "idx", start=0).drop("vec_id")


_CASES = """
    with s as (
      select i.vec_id as item_id, c.label::bigint as case_no, 'case-' || c.label::varchar as case_name,
             greatest(max(round(list_inner_product(i.embedding::double[], list_reverse(c.embedding)::double[]), 9)), -1.0)
               as similarity
      from embeddings i, embeddings c group by 1, 2, 3),
    ranked as (select *, row_number() over (partition by item_id order by similarity desc, case_no) as rank from s)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


@query(_CASES + "select item_id, case_no, case_name, round(similarity, 6) as similarity, rank from ranked where rank <= 3")
def case_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest classes of every vector."""
    found = nearest_classes(_items(spark, sf_dir), library(spark, sf_dir), 3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_CASES + "select item_id, case_no, case_name, round(similarity, 6) as similarity, rank from ranked where rank <= 3")
def case_nearest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest classes of every vector, one block of samples after another."""
    found = nearest_classes(_items(spark, sf_dir), library(spark, sf_dir), 3, max_library_block=300)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    _CASES
    + """
    select item_id, case when similarity >= 0.3 then case_name else '未分类' end as case_name,
           round(similarity, 6) as similarity
    from ranked where rank = 1
    """
)
def case_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every vector, or none when no case is close."""
    found = classify(_items(spark, sf_dir), library(spark, sf_dir), 0.3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    """
    with lib as (
      select label::bigint as case_no, 'case-' || label::varchar as case_name, vec_id::varchar as path,
             row_number() over (partition by label order by vec_id) - 1 as idx from embeddings),
    fresh as (
      select case_name, path, row_number() over (partition by case_name order by path) - 1 as n
      from (select case when o_orderstatus = 'F' then 'case-3' else 'new-' || o_orderstatus end as case_name,
                   'o' || o_orderkey::varchar as path from orders)),
    sizes as (select case_no, case_name, count(*) as n from lib group by 1, 2),
    added as (
      select case fresh.case_name when 'case-3' then 3 when 'new-O' then 10 else 11 end as case_no, fresh.case_name, path,
             fresh.n + coalesce(sizes.n, 0) as idx
      from fresh left join sizes on fresh.case_name = sizes.case_name),
    merged as (select case_no, case_name, path, idx from lib union all select case_no, case_name, path, idx from added)
    select case_no::bigint as case_no, case_name, path, (case when case_name = 'case-3' and idx > 1 then idx - 1 else idx end)::bigint as idx
    from merged where case_name <> 'case-5' and not (case_name = 'case-3' and idx = 1)
    """
)
def case_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library after adding samples to old and new classes, dropping a class and dropping one sample."""
    status = F.col("o_orderstatus")
    samples = table(spark, sf_dir, "orders").select(
        F.when(status == "F", "case-3").otherwise(F.concat(F.lit("new-"), status)).alias("case_name"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.lit("added").alias("description"),
    )
    changed = remove_sample(remove_class(add_cases(library(spark, sf_dir), samples), "case-5"), "case-3", 1)
    return changed.select("case_no", "case_name", "path", "idx")


@query(
    """
    select label::bigint as case_no, 'case-' || label::varchar as case_name, count(*) as samples from embeddings group by 1, 2
    """
)
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a library with their number of samples."""
    return list_classes(library(spark, sf_dir))
