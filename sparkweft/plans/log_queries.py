"""Queries on logs, responses, series, boxes and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.boxes import page_boxes, page_text
from sparkweft.functions.formats import duration_text, fixed_text, signed_percent
from sparkweft.functions.json_text import TRIP_ANSWER, TRIP_FIELDS, VEHICLE_FIELDS, parse_answer
from sparkweft.functions.media import probe_size, quality_tier
from sparkweft.functions.signals import deviation
from sparkweft.functions.text import base64_text, request_pairs, utf8_bytes
from sparkweft.operators.dedupe import keep_first, keep_last, ordered_distinct
from sparkweft.operators.logs import (
    PARAM_FIELDS,
    batch_records,
    batch_statistics,
    command_values,
    estimate_storage,
    fold_pieces,
    number_records,
    params_records,
    token_usage,
)
from sparkweft.operators.rows import with_prefix
from sparkweft.operators.series import series_signals, trailing_mean
from sparkweft.plans.registry import query, spread_table, table
from sparkweft.staging import stage_path
from sparkweft.streaming.answers import fold_stream, follow_last, last_version, open_answers


@query(
    """
    select event_id, 'dict_' || event_type || '_' || user_id::varchar as value from events where event_type <> 'view'
    """
)
def cmd_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command token of log lines; lines without one are dropped."""
    token = F.concat(F.lit("dict_"), F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"))
    line = F.concat(F.lit("sum/cmd="), token, F.lit("\t"), F.col("value").cast("string"), F.lit(" cmd=other"))
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.lit("cmd= none")).otherwise(line).alias("value")
    )
    return command_values(lines)


@query(
    """
    select dict, key, min(event_id) as first_position
    from (select 'dict_' || event_type as dict, 'u' || user_id::varchar as key, event_id from events
          union all select 'dict_all', 'u' || (user_id % 10)::varchar, event_id from events)
    group by dict, key
    """
)
def dict_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct dictionary and key of request dumps with several requests per text, by first occurrence."""
    user = F.col("user_id")
    request = '{"keys":[{"key": "%s%s", "dict": "%s%s"}, {"key": "skipped", "dict": "dict_x"}]}\n'
    text = F.concat(
        F.format_string(request, F.lit("u"), user, F.lit("dict_"), F.col("event_type")),
        F.format_string(request.replace("[{", "[\n {"), F.lit("u"), user % 10, F.lit("dict_"), F.lit("all")),
        F.format_string(request, F.lit("u"), user, F.lit("curl_"), F.lit("broken")),
    )
    pairs = table(spark, sf_dir, "events").select("event_id", F.explode(request_pairs(text)).alias("p"))
    wanted = with_prefix(pairs.select("event_id", "p.dict", "p.key"), "dict", "dict_")
    return ordered_distinct(wanted, ["dict", "key"], "event_id")


@query(
    """
    select event_type, user_id, min(event_id) as first_position, max(event_id) as event_id,
           arg_max(value, event_id) as value
    from events group by event_type, user_id
    """
)
def keep_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of every user and kind, at the place of the first."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return keep_last(events, F.struct("event_type", "user_id"), "event_id")


@query(
    """
    select user_id, count(*) as copies, min(event_id) as event_id, arg_min(event_type, event_id) as event_type
    from events group by user_id
    """
)
def keep_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of every user, with the number of its events."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return keep_first(events, ["user_id"], ["event_id"], copies="copies")


_PARAMS = {
    "image_url": "'i-' || event_id::varchar",
    "estimate_id": "event_id::varchar",
    "city_name": "event_type",
    "activity_detail_image_urls": "coalesce(detail, '')",
    "est_price": "value::varchar",
}


@query(
    f"""
    with rendered as (
      select *, case when user_id % 10 = 0 then null else 'd-' || user_id::varchar end as detail
      from events where event_id % 13 <> 0 and event_id % 17 <> 0),
    ranked as (
      select *, min(event_id) over (partition by detail) as first_position,
             row_number() over (partition by detail order by event_id desc) as r
      from rendered)
    select {", ".join(f"{_PARAMS.get(name, chr(39) * 2)} as {name}" for name in PARAM_FIELDS)}, first_position
    from ranked where r = 1
    """
)
def params_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter records out of four log styles, last one of each key kept."""
    quote = F.lit('"')

    def text(column: str):
        return F.concat(quote, F.col(column), quote)

    event_id, value = F.col("event_id").cast("string"), F.col("value").cast("string")
    detail = F.when(F.col("user_id") % 10 == 0, "null").otherwise(
        F.concat(quote, F.lit("d-"), F.col("user_id").cast("string"), quote)
    )
    params = F.concat(
        F.lit('{"image_url": "i-'), event_id, F.lit('", "estimate_id": '), event_id, F.lit(', "city_name": '),
        text("event_type"), F.lit(', "extra": {"a": [1, {}]}, "activity_detail_image_urls": '), detail,
        F.lit(', "est_price": '), value, F.lit("}"),
    )
    style = F.col("event_id") % 4
    line = (
        F.when(F.col("event_id") % 13 == 0, '{"params": {}, "n": 1}')
        .when(F.col("event_id") % 17 == 0, F.concat(F.lit("params={broken "), value, F.lit("}")))
        .when(style == 0, F.concat(F.lit('{"time": "t", "params": '), params, F.lit(', "n": [1]}')))
        .when(style == 1, F.concat(F.lit('INFO {"a" "params": '), params, F.lit(" done")))
        .when(style == 2, F.concat(F.lit("　INFO params="), params, F.lit(" tail")))
        .otherwise(F.concat(F.lit("INFO params: "), F.replace(params, quote, F.lit("'"))))
    )
    return params_records(spread_table(spark, sf_dir, "events").select("event_id", line.alias("value")), "event_id")


def batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of finished batches; views give other lines, some seconds are no number."""
    seconds = F.when(F.col("event_id") % 19 == 0, "1.2.3").otherwise(F.col("value").cast("string"))
    done = F.concat(
        F.lit("12:00 并发调用ocr模型效率："), (F.col("event_id") % 50).cast("string"), F.lit("张图片，耗时"), seconds, F.lit("s")
    )
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "view", "12:00 idle").otherwise(done).alias("value")
    )


_BATCHES = """
    with records as (
      select event_id, event_type, event_id % 50 as images,
             case when event_id % 19 = 0 then null else value end as seconds
      from events where event_type <> 'view'),
    stats as (
      select {group} count(*) as records, sum(images)::bigint as total_images, sum(images) / count(images) as mean_images,
             max(images) as max_images, min(images) as min_images, sum(seconds) as s, avg(seconds) as mean_seconds,
             max(seconds) as max_seconds, min(seconds) as min_seconds
      from records {by})
    select {group} records, total_images, round(mean_images, 6) as mean_images, max_images, min_images,
           round(s, 4) as total_seconds, round(mean_seconds, 6) as mean_seconds, max_seconds, min_seconds,
           round(total_images / s, 6) as images_per_second, round(total_images / s * 60, 4) as images_per_minute
    from stats
"""


def _rounded(stats: DataFrame) -> DataFrame:
    digits = {
        "mean_images": 6, "total_seconds": 4, "mean_seconds": 6, "images_per_second": 6, "images_per_minute": 4,
    }
    return stats.drop("total_time").withColumns({name: F.round(name, n) for name, n in digits.items()})


@query(_BATCHES.format(group="", by=""))
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, means, extremes and speed over all batches."""
    return _rounded(batch_statistics(batch_records(batch_lines(spark, sf_dir))))


@query(_BATCHES.format(group="event_type,", by="group by event_type"))
def log_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per kind of event."""
    return _rounded(batch_statistics(batch_records(batch_lines(spark, sf_dir)), "event_type"))


@query(
    """
    with records as (
      select event_id, event_id % 50 as images, case when event_id % 19 = 0 then null else value end as seconds
      from events where event_type <> 'view')
    select event_id, images, seconds, row_number() over (order by event_id) as record_no,
           case when seconds > 0 then round(images / seconds, 6) else 0.0 end::double as images_per_second
    from records
    """
)
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch records in log order, numbered, each with its speed."""
    records = batch_records(batch_lines(spark, sf_dir).drop("event_type"))
    return number_records(records, ["event_id"]).withColumn("images_per_second", F.round("images_per_second", 6))


@query(
    """
    select event_id,
           case when v < 60 then printf('%.2f 秒', v)
                when v < 3600 then printf('%d 分 %.2f 秒', floor(v / 60)::integer, v % 60)
                else printf('%d 小时 %d 分 %.2f 秒', floor(v / 3600)::integer, floor((v % 3600) / 60)::integer, v % 60)
           end as duration,
           printf('%.2f', value) as fixed, printf('%+.2f%%', value - 50) as signed
    from (select event_id, value, value * case event_id % 3 when 0 then 1 when 1 then 16 else 256 end as v from events)
    """
)
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, fixed decimals and signed percentages as text."""
    scale = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 16).otherwise(256)
    return table(spark, sf_dir, "events").select(
        "event_id",
        duration_text(F.col("value") * scale).alias("duration"),
        fixed_text(F.col("value")).alias("fixed"),
        signed_percent(F.col("value") - 50).alias("signed"),
    )


@query(
    """
    with base as (select count(text) as n, avg(strlen(text)) as b from documents)
    select n as num_items, round(b, 6) as bytes_per_item, round(b / 1024, 6) as kb_per_item,
           round(n * b / 1073741824, 9) as plain_gb, round(n * b / 1073741824 * 0.1, 9) as compressed_10pct_gb,
           round(n * b / 1073741824 * 0.2, 9) as compressed_20pct_gb, round(n * b / 1073741824 * 0.3, 9) as compressed_30pct_gb
    from base
    """
)
def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage of all documents, plain and compressed."""
    estimate = estimate_storage(table(spark, sf_dir, "documents"), F.col("text"))
    sizes = [name for name in estimate.columns if name.endswith("_gb")]
    return estimate.withColumns(
        {**{name: F.round(name, 6) for name in ("bytes_per_item", "kb_per_item")}, **{n: F.round(n, 9) for n in sizes}}
    )


@query("select doc_id, strlen(text) as bytes, base64(encode(text)) as packed from documents")
def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 length and Base64 form of whole texts."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", utf8_bytes(F.col("text")).alias("bytes"), base64_text(F.col("text").cast("binary")).alias("packed")
    )


@query(
    """
    with meta as (select role, length(text) as p, turn + 1 as e from conversations where turn % 7 <> 3)
    select role, count(*) as responses, sum(p)::bigint as input_tokens, sum(e)::bigint as output_tokens,
           sum(p + e)::bigint as total_tokens, round(sum(p) * 1000 / 1e9, 6) as input_seconds,
           round(sum(e) * 2000 / 1e9, 6) as output_seconds, round(sum(p + e) * 3000 / 1e9, 6) as total_seconds,
           0.0::double as load_seconds, round(sum(p) / (sum(p) * 1000 / 1e9), 2) as input_tokens_per_second,
           round(sum(e) / (sum(e) * 2000 / 1e9), 2) as output_tokens_per_second
    from meta group by role
    """
)
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, times and rates of responses by role; broken documents add nothing."""
    prompt, answer = F.length("text").cast("long"), F.col("turn") + 1
    document = F.format_string(
        '{"prompt_eval_count": %d, "eval_count": %d, "prompt_eval_duration": %d, "eval_duration": %d, '
        '"total_duration": %d, "done": true}',
        prompt, answer, prompt * 1000, answer * 2000, (prompt + answer) * 3000,
    )
    broken = F.col("turn") % 7 == 3
    responses = table(spark, sf_dir, "conversations").select(
        "role", F.when(broken, F.concat(document, F.lit("}"))).otherwise(document).alias("value")
    )
    totals = token_usage(responses, "role")
    seconds = [name for name in totals.columns if name.endswith("_seconds")]
    rates = [name for name in totals.columns if name.endswith("_per_second")]
    return totals.withColumns({**{n: F.round(n, 6) for n in seconds}, **{n: F.round(n, 2) for n in rates}})


_ANSWERS = """
    with pieces as (select * from conversations where turn % 5 <> 3),
    ends as (select conv_id, min(turn) as stop from pieces where length(text) > 1500 group by conv_id),
    kept as (select p.*, (row_number() over (partition by p.conv_id order by p.turn) - 1) // 3 as part,
                    count(*) over (partition by p.conv_id) as pieces, e.stop is not null as finished
             from pieces p left join ends e on p.conv_id = e.conv_id where e.stop is null or p.turn <= e.stop)
    select conv_id, part, string_agg(text, '' order by turn) as text, pieces, finished::integer::bigint as finished
    from kept group by conv_id, part, pieces, finished
"""


def _answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pieces of answers in two forms, some of them broken; a long text ends its answer."""
    done = F.length("text") > 1500
    plain = F.to_json(F.struct(F.col("text").alias("response"), done.alias("done")))
    chat = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), done.alias("done")))
    line = F.when(F.col("turn") % 5 == 3, "{broken").when(F.col("turn") % 2 == 0, plain).otherwise(chat)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("value"))

@query(_ANSWERS)
def answer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together from pieces up to the end mark, skipping broken pieces."""
    folded = fold_pieces(_answer_lines(spark, sf_dir), "conv_id", "turn", piece_rows=3)
    return folded.withColumn("finished", F.col("finished").cast("int").cast("long"))


def _arrivals(rows: DataFrame, order: str, cuts: int) -> DataFrame:
    """The rows as a stream: written in ``cuts`` goes by their place in ``order``, each row of a key's goes in one file."""
    spark, path = rows.sparkSession, stage_path(rows.sparkSession)
    span = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).head()
    step = 0 if span["low"] is None else (span["high"] - span["low"]) // cuts + 1
    for cut in range(cuts if step else 1):
        some = rows.where(F.col(order) - span["low"] >= cut * step).where(F.col(order) - span["low"] < (cut + 1) * step) if step else rows
        some.repartition(rows.columns[0]).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(path)


@query(_ANSWERS)
def answer_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together while their pieces arrive; those still open at the end are read from the state."""
    folded = fold_stream(_arrivals(_answer_lines(spark, sf_dir), "turn", 2), "conv_id", "turn", piece_rows=3)
    given, state = stage_path(spark), stage_path(spark)
    folded.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(
        given
    ).awaitTermination()
    parts = spark.read.schema(folded.schema).parquet(given).unionByName(open_answers(spark, state, "conv_id"))
    whole = parts.groupBy("conv_id").agg(
        F.max("pieces").alias("pieces"), F.max(F.col("finished").cast("int")).cast("long").alias("finished")
    )
    return parts.select("conv_id", "part", "text").join(whole, "conv_id")


@query("select event_type, user_id, max(event_id) as event_id, min(event_id) as first_position from events group by event_type, user_id")
def keep_last_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of each type and user, kept while events arrive."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    given = stage_path(spark)
    key = F.struct("event_type", "user_id")
    follow_last(_arrivals(events, "event_id", 2), key, "event_id", given, stage_path(spark)).awaitTermination()
    return last_version(spark, given)


@query(
    """
    select o_orderkey, 'from ' || o_custkey::varchar as start_point, o_orderstatus as end_point, v as vehicle_no,
           o_orderpriority || '/' || v::varchar as supplier, o_totalprice::varchar as price
    from orders, (select 0::bigint as v union all select 1) where o_orderkey % 11 <> 5
    union all
    select o_orderkey, null, null, null, null, null from orders where o_orderkey % 11 = 5
    """
)
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers, fenced, bare or broken, flattened to one row per vehicle."""
    vehicle = '{"supplier": "%s/%d", "price": "%s", "price_type": "x"}'
    body = F.format_string(
        '{"start_point": "from %d", "end_point": "%s", "vehicles": [' + vehicle + ", " + vehicle + "]}",
        "o_custkey", "o_orderstatus",
        "o_orderpriority", F.lit(0), F.col("o_totalprice").cast("string"),
        "o_orderpriority", F.lit(1), F.col("o_totalprice").cast("string"),
    )
    answer = (
        F.when(F.col("o_orderkey") % 11 == 5, F.concat(F.lit("```json\n"), body, F.lit("]\n```")))
        .when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nBye")))
        .otherwise(F.concat(F.lit("\n  "), body))
    )
    parsed = spread_table(spark, sf_dir, "orders").select("o_orderkey", parse_answer(answer, TRIP_ANSWER).alias("a"))
    trips = parsed.select(
        "o_orderkey", *[F.col(f"a.{name}") for name in TRIP_FIELDS], F.posexplode_outer("a.vehicles").alias("no", "v")
    )
    flat = trips.select("*", *[F.col(f"v.{name}") for name in VEHICLE_FIELDS])
    return flat.select(
        "o_orderkey", "start_point", "end_point", F.col("no").cast("long").alias("vehicle_no"), "supplier", "price"
    )


@query(
    """
    select event_id, event_type, value,
           case when n = 170 then round(m, 6) end as trailing_mean
    from (select event_id, event_type, value, count(*) over w as n, avg(value) over w as m from events
          where event_id % 23 <> 0
          window w as (partition by event_type order by ts rows between 169 preceding and current row))
    """
)
def trailing_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last 170 values of each kind, NULL values left out."""
    close = F.when(F.col("event_id") % 23 != 0, F.col("value")).alias("value")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", close)
    means = trailing_mean(events, "event_type", "ts", "value", block_rows=5000)
    return means.drop("ts").withColumn("trailing_mean", F.round("trailing_mean", 6))


@query(
    """
    with numbered as (
      select 's' || (user_id % 11)::varchar as series, value,
             row_number() over (partition by user_id % 11 order by ts desc) as r from events),
    latest as (
      select series, least(count(*), 170) as points, max(value) filter (where r = 1) as price,
             case when count(*) >= 170 then avg(value) filter (where r <= 170) end as mean from numbered group by series),
    judged as (select *, (price - mean) / mean * 100 as d from latest)
    select series, points, price, round(mean, 6) as trailing_mean, round(d, 6) as deviation_percent,
           case when price >= mean then '≥' when price < mean then '<' end as relation,
           case when d is null then null when d <= 0 then '考虑买入' when d <= 15 then '持有观望'
                when d <= 30 then '分批卖 1/3' when d <= 50 then '分批再卖 1/3' else '分批卖剩余' end as advice,
           case when mean is null then 'short history' else 'ok' end as status
    from judged
    """
)
def series_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of every series against its trailing mean."""
    name = F.concat(F.lit("s"), (F.col("user_id") % 11).cast("string"))
    points = table(spark, sf_dir, "events").select(name.alias("series"), "ts", "value")
    signals = series_signals(points, "series", "ts", "value")
    return signals.withColumns({n: F.round(n, 6) for n in ("trailing_mean", "deviation_percent")})


@query("select event_id, round((value - 50) / 50 * 100, 6) as percent from events")
def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of every value from a fixed mean."""
    percent = F.round(deviation(F.col("value"), F.lit(50.0)), 6)
    return table(spark, sf_dir, "events").select("event_id", percent.alias("percent"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recognised page of two text regions per line item."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")

    def corner(a, b):
        return F.array(a, b)

    words = F.create_map(F.lit("A"), F.lit("背操出行"), F.lit("N"), F.lit("消点宝出行"), F.lit("R"), F.lit("R"))
    first = F.struct(
        words[F.col("l_returnflag")].alias("text"),
        F.col("l_discount").alias("confidence"),
        F.array(corner(x, y), corner(x + 166, y + 3), corner(x + 165, y + 46), corner(x - 1, y + 43)).alias("text_region"),
    )
    second = F.struct(
        F.col("l_linestatus").alias("text"),
        F.lit(0.98765).alias("confidence"),
        F.array(corner(x + 9, y + 9), corner(x, y), corner(x + 9, y), corner(x, y + 9)).alias("text_region"),
    )
    return spread_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.array(first, second).alias("points")
    )


@query(
    """
    select l_orderkey, l_partkey, l_suppkey, l_extendedprice, no,
           case when no = 1 then l_linestatus when l_returnflag = 'A' then '曹操出行'
                when l_returnflag = 'N' then '捎点宝出行' else l_returnflag end as text,
           case when no = 0 then l_quantity - 0.5 else l_quantity end as x,
           case when no = 0 then l_linenumber + 1.5 else l_linenumber end::double as y,
           case when no = 0 then l_quantity + 165.5 else l_quantity + 9 end as w,
           case when no = 0 then l_linenumber + 44.5 else l_linenumber + 9 end::double as h,
           case when no = 0 then round(l_discount, 3) else 0.988 end as c
    from lineitem, (select 0::bigint as no union all select 1)
    """
)
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of quadrilaterals, with misread words corrected."""
    boxes = pages(spark, sf_dir).withColumn("boxes", page_boxes(F.col("points"))).drop("points")
    keys = [name for name in boxes.columns if name != "boxes"]
    # The outer form keeps the optimizer from computing the boxes a second time to test for empty pages.
    return boxes.select(*keys, F.posexplode_outer("boxes").alias("no", "box")).select(
        *keys, F.col("no").cast("long").alias("no"), "box.text", "box.x", "box.y", "box.w", "box.h", "box.c"
    )


@query(
    """
    select l_orderkey, l_partkey, l_suppkey, l_extendedprice,
           case l_returnflag when 'A' then '曹操出行' when 'N' then '捎点宝出行' else l_returnflag end || ',' || l_linestatus
             as text
    from lineitem
    """
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each page joined by commas."""
    read = pages(spark, sf_dir)
    return read.select(*[n for n in read.columns if n != "points"], page_text(page_boxes(F.col("points"))).alias("text"))


@query(
    """
    with sizes as (
      select o_orderkey, case when o_orderkey % 2 = 0 then a else b end as w, case when o_orderkey % 2 = 0 then b else a end as h
      from (select o_orderkey, o_custkey % 2400 + 1 as a, o_custkey % 2400 + o_orderkey % 400 as b from orders)),
    probed as (
      select *, case when o_orderkey % 10 = 3 then 'bad json' when o_orderkey % 10 = 4 then 'no stream'
                     when o_orderkey % 10 = 6 or w <= 0 or h <= 0 then 'bad size' else 'ok' end as status from sizes),
    shown as (
      select o_orderkey, status, case when status = 'ok' then w end as width, case when status = 'ok' then h end as height,
             least(case when status = 'ok' then w end, case when status = 'ok' then h end) as s from probed)
    select o_orderkey, status, width, height,
           case when s is null then null when s >= 2160 then '4K (2160p)' when s >= 1440 then '2K (1440p)'
                when s >= 1080 then '1080p' when s >= 720 then '720p' when s >= 480 then '480p' when s >= 360 then '360p'
                when s >= 240 then '240p' else width::varchar || 'x' || height::varchar || ' (低清)' end as tier
    from shown
    """
)
def media_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame size, status and quality tier of probe documents."""
    low = F.col("o_custkey") % 2400 + 1
    high = F.col("o_custkey") % 2400 + F.col("o_orderkey") % 400
    even = F.col("o_orderkey") % 2 == 0
    width, height = F.when(even, low).otherwise(high), F.when(even, high).otherwise(low)
    kind = F.col("o_orderkey") % 10
    probe = (
        F.when(kind == 3, "{streams")
        .when(kind == 4, '{"streams": []}')
        .when(kind == 6, '{"streams": [{"height": 720}]}')
        .otherwise(F.format_string('{"streams": [{"width": %d, "height": %d, "codec": "c"}, {"width": 1}]}', width, height))
    )
    sized = spread_table(spark, sf_dir, "orders").select("o_orderkey", probe_size(probe).alias("s")).select("o_orderkey", "s.*")
    return sized.withColumn("tier", quality_tier(F.col("width"), F.col("height")))
