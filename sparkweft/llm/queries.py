"""The registered queries of these operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm import (
    hard_negatives, html_text, langid, licenses, mixing, packing, quality, reverse_search, sharding, simhash, suffix_dedup,
    surrogates, vector_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
PRIVATE_KEY = b"sparkweft-surrogates"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts; 16 bytes are added to each text's size."""
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shuffle_shards(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by a model of the documents that are not held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    documents = _documents(spark, sf_dir)
    model = langid.train(documents.where(~held_out).select("doc_id", "text", "lang"))
    texts = documents.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir), carry=["doc_id"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below a directory for each source and language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string"))
    rows = _documents(spark, sf_dir).select("doc_id", "text", path.alias("at"))
    return licenses.scan_licenses(rows, F.col("at"), carry=["doc_id"]).select("doc_id", "path", "license", "cosine", "evidence", "origin")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(rows, F.col("words"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", F.round("position").cast("long").alias("position")
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.pseudonymize(documents, PRIVATE_KEY).select("doc_id", "text", "n_entities", "entities")


def op11_reverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return reverse_search.best_documents(items, _documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; every seventh carries the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_language_id, op3_embedding_dedup, op4_quality_rules, op5_simhash, op6_license_scan, op7_mixing,
        op8_html_text, op9_packing, op10_surrogates, op11_reverse_search, op12_hard_negatives, op13_suffix_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op7_mixing": r"""
    with sized as (
      select doc_id, source, md5('mix:' || doc_id::varchar) as draw,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
    sources as (
      select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank
      from sized group by source),
    weighed as (select *, rank % 3 + 1 as weight, 3 * source_size as cap from sources),
    filled as (
      select *, sum(source_size) over () as total,
             sum(source_size) over () - coalesce(sum(cap) over before, 0) as rest,
             sum(weight) over () - coalesce(sum(weight) over before, 0) as rest_weight
      from weighed window before as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
    marked as (select *, cap * rest_weight <= weight * rest as capped from filled),
    shared as (
      select *, case when capped then cap::double else
               weight::double * (total - coalesce(sum(cap) filter (where capped) over (), 0))::double
               / (sum(weight) filter (where not capped) over ())::double end as target
      from marked),
    knots as (
      select *, case weight when 1 then 1.5 when 2 then 1.0 else 0.5 end::double as v0, 1.0::double as v1,
             case weight when 1 then 0.5 when 2 then 1.0 else 1.5 end::double as v2 from shared),
    areas as (select *, (v0 + v1) / 4 as c1, (v0 + v1) / 4 + (v1 + v2) / 4 as c2 from knots),
    demand as (
      select *, sum(target / c2 * v0) over () as b0, sum(target / c2 * (v1 - v0)) over () as d0,
             sum(target / c2 * c1) over () as a1, sum(target / c2 * v1) over () as b1,
             sum(target / c2 * (v2 - v1)) over () as d1 from areas),
    laid as (
      select s.doc_id, s.size, d.*, floor(d.target + 0.5)::bigint as quota,
             coalesce(sum(s.size) over (partition by d.rank order by s.draw, s.size
                      rows between unbounded preceding and 1 preceding), 0)::bigint as offs
      from sized s join demand d on s.source is not distinct from d.source),
    taken as (
      select *, case when source_size > 0 then quota // source_size else 0 end as rounds,
             greatest(0, least(size, quota - case when source_size > 0 then quota // source_size else 0 end * source_size - offs))
               as rest_part, case when target > 0 then offs / target else 0 end * c2 as area from laid),
    timed as (
      select *, greatest(area - case when area < c1 then 0 else c1 end, 0) as over_knot,
             case when area < c1 then v0 else v1 end as v, case when area < c1 then (v1 - v0) * 2 else (v2 - v1) * 2 end as slope
      from taken),
    placed as (select *, least(2 * over_knot / (v + sqrt(greatest(v * v + 2 * slope * over_knot, 0))), 0.5) as x from timed)
    select doc_id, size, source_size, target, (rounds * size + rest_part)::bigint as taken,
           (case when size > 0 then rounds + (rest_part > 0)::int else 0 end)::integer as copies,
           case when size > 0 and rounds + (rest_part > 0)::int > 0
                then round(case when area < c1 then b0 * x + d0 * x * x else a1 + b1 * x + d1 * x * x end)::bigint end as position
    from placed
    """,
    "op11_reverse_search": r"""
    with d as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
    docs as (select doc_id, w, len(w)::bigint as n from d where len(w) > 0),
    size as (select count(*)::bigint as docs, sum(n)::bigint as words from docs),
    tf as (select doc_id, n, t, count(*)::bigint as tf from (select doc_id, n, unnest(w) as t from docs) group by all),
    df as (select t, count(*)::bigint as df from tf group by t),
    item as (
      select item_id, t, count(*)::bigint as times
      from (select item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by all),
    scored as (
      select item_id, doc_id,
             sum(times * floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint
                 * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint as score
      from item join df using (t) join tf using (t), size group by all)
    select item_id, rank::integer as rank, doc_id, score
    from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
    where rank <= 20
    """,
    "op12_hard_negatives": """
    with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             [floor(256 * x::double) for x in embedding] as e
      from embeddings
      where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    pairs as (
      select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
    positives as (
      select * from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as place from pairs where same)
      where place <= 5),
    negatives as (
      select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
             row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id)::integer as rank
      from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
       and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 5
    """,
}
