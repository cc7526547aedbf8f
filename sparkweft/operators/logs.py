"""Statistics and records out of logs and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.binding import where_once
from sparkweft.functions.formats import duration_text, rate
from sparkweft.functions.json_text import params_struct, parse_object
from sparkweft.functions.text import command_value, has_command, utf8_bytes
from sparkweft.operators.dedupe import keep_last
from sparkweft.operators.ordinal import with_ordinal
from sparkweft.operators.rows import project_defaults
from sparkweft.operators.ordinal import with_group_ordinal

# Fixed value: the log text of a finished batch, with its number of images and its seconds.
BATCH_PATTERN = r"并发调用ocr模型效率：(\d+)张图片，耗时([\d.]+)"

# The fields of a parameter record, in output order.
PARAM_FIELDS = (
    "image_url", "estimate_id", "province", "city_name", "driver_platform", "activity_type", "activity_breakdown",
    "activity_zone_image_urls", "activity_detail_image_urls", "driver_category", "submit_time",
    "submit_timestamp_ms", "event_time", "is_recognized", "activity_name_result", "activity_city_result",
    "activity_fence", "discount_rules", "validity_period_start_time", "validity_period_end_time",
    "applicable_time_period", "order_timeliness_type", "order_categories", "dis_range", "purchase_start_time",
    "purchase_end_time", "reduce_after_price", "est_price",
)
PARAM_KEY = "activity_detail_image_urls"

_NANOSECONDS = 1e9
_META = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in (
            "prompt_eval_count", "eval_count", "prompt_eval_duration", "eval_duration", "total_duration",
            "load_duration",
        )
    ]
)


def batch_records(lines: DataFrame, value: str = "value", pattern: str = BATCH_PATTERN) -> DataFrame:
    """``images`` and ``seconds`` of matching lines, next to the other columns. Seconds that are no number are NULL."""
    kept = [name for name in lines.columns if name != value]
    text = F.col(value)
    return lines.where(text.rlike(pattern)).select(
        *kept,
        F.regexp_extract(text, pattern, 1).try_cast("long").alias("images"),
        F.regexp_extract(text, pattern, 2).try_cast("double").alias("seconds"),
    )


def number_records(records: DataFrame, order_by: list[str]) -> DataFrame:
    """Records with ``record_no`` from 1 in order and ``images_per_second``."""
    return with_ordinal(records, order_by, "record_no").withColumn(
        "images_per_second", rate(F.col("images"), F.col("seconds"))
    )


def batch_statistics(records: DataFrame, *group: str) -> DataFrame:
    """Totals, means, extremes and speed of batch records, over all of them or per group."""
    images, seconds = F.sum("images"), F.sum("seconds")
    return records.groupBy(*group).agg(
        F.count(F.lit(1)).alias("records"),
        images.alias("total_images"),
        (images / F.count("images")).alias("mean_images"),
        F.max("images").alias("max_images"),
        F.min("images").alias("min_images"),
        seconds.alias("total_seconds"),
        duration_text(seconds).alias("total_time"),
        F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.min("seconds").alias("min_seconds"),
        rate(images, seconds).alias("images_per_second"),
        (rate(images, seconds) * 60).alias("images_per_minute"),
    )


def command_values(lines: DataFrame, value: str = "value", name: str = "cmd") -> DataFrame:
    """Command token of every line that has one, as ``value``, next to the other columns."""
    return lines.where(has_command(F.col(value), name)).withColumn(value, command_value(F.col(value), name))


def params_records(
    lines: DataFrame,
    order: str,
    value: str = "value",
    fields: tuple[str, ...] = PARAM_FIELDS,
    key: str = PARAM_KEY,
) -> DataFrame:
    """Parameter records of a log, one per ``key`` value: the last one, at the place of the first.

    Absent fields are ``''``. ``first_position`` gives the output order. Records without key are one group.
    """
    wanted = list(dict.fromkeys([*fields, key]))
    params = lines.select(order, params_struct(F.col(value), wanted).alias("params"))
    parsed = where_once(params, lambda row: row["params"].isNotNull())
    last = keep_last(parsed, F.col("params")[key], order)
    return project_defaults(
        last.select(F.struct("params.*", F.col("first_position").cast("string").alias("first_position")).alias("r")),
        "r",
        [*fields, "first_position"],
    ).withColumn("first_position", F.col("first_position").cast(lines.schema[order].dataType))


def estimate_storage(df: DataFrame, text: Column, items: int | None = None) -> DataFrame:
    """Storage for ``items`` texts (default: as many as there are) of the mean size, plain and compressed to a share."""
    number = F.count(text) if items is None else F.lit(items)
    base = df.agg(number.cast("long").alias("num_items"), F.avg(utf8_bytes(text)).alias("bytes_per_item"))
    plain = F.col("num_items") * F.col("bytes_per_item") / float(1 << 30)
    return base.select(
        "num_items",
        "bytes_per_item",
        (F.col("bytes_per_item") / 1024).alias("kb_per_item"),
        plain.alias("plain_gb"),
        *[(plain * share / 100).alias(f"compressed_{share}pct_gb") for share in (10, 20, 30)],
    )


def token_usage(responses: DataFrame, *group: str, value: str = "value") -> DataFrame:
    """Token counts, seconds and token rates of response documents; a line that is no JSON object adds nothing."""
    parsed = responses.select(*group, parse_object(F.col(value), _META).alias("m"))
    meta = where_once(parsed, lambda row: row["m"].isNotNull())

    def total(field: str) -> Column:
        return F.coalesce(F.sum(F.col("m")[field]), F.lit(0))

    def seconds(field: str) -> Column:
        return total(field) / _NANOSECONDS

    return meta.groupBy(*group).agg(
        F.count(F.lit(1)).alias("responses"),
        total("prompt_eval_count").alias("input_tokens"),
        total("eval_count").alias("output_tokens"),
        (total("prompt_eval_count") + total("eval_count")).alias("total_tokens"),
        seconds("prompt_eval_duration").alias("input_seconds"),
        seconds("eval_duration").alias("output_seconds"),
        seconds("total_duration").alias("total_seconds"),
        seconds("load_duration").alias("load_seconds"),
        rate(total("prompt_eval_count"), seconds("prompt_eval_duration")).alias("input_tokens_per_second"),
        rate(total("eval_count"), seconds("eval_duration")).alias("output_tokens_per_second"),
    )


_PIECE = T.StructType(
    [
        T.StructField("response", T.StringType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
    ]
)


def answer_pieces(lines: DataFrame, answer: str, order: str, value: str = "value") -> DataFrame:
    """``text`` and ``done`` of every line that parses, next to ``answer`` and ``order``."""
    parsed = lines.select(answer, order, parse_object(F.col(value), _PIECE).alias("p"))
    return where_once(parsed, lambda row: row["p"].isNotNull()).select(
        answer,
        order,
        F.coalesce("p.response", "p.message.content", F.lit("")).alias("text"),
        F.coalesce("p.done", F.lit(False)).alias("done"),
    )


def fold_pieces(lines: DataFrame, answer: str, order: str, value: str = "value", piece_rows: int = 1000) -> DataFrame:
    """Answers put together from pieces, one JSON document per line, up to the first piece that is ``done``.

    A piece is ``response`` or ``message.content``; lines that do not parse are skipped. Pieces without an answer's name (NULL)
    are one answer. An answer of more than
    ``piece_rows`` pieces is given in ``part`` rows of so many pieces each, counted from 0 in the order of the pieces, so an
    endless answer is never gathered in one place. ``pieces`` and ``finished`` are those of the whole answer.
    """
    pieces = answer_pieces(lines, answer, order, value)
    ends = pieces.where("done").groupBy(F.col(answer).alias("__of")).agg(F.min(order).alias("__end"))
    kept = pieces.join(ends, F.col(answer).eqNullSafe(F.col("__of")), "left")
    kept = kept.where(F.col("__end").isNull() | (F.col(order) <= F.col("__end")))
    numbered = with_group_ordinal(kept.drop("__of", "__end"), [answer], [order, "text"], "__n", start=0)
    ordered = F.sort_array(F.collect_list(F.struct("__n", "text")))
    parts = numbered.groupBy(answer, F.floor(F.col("__n") / piece_rows).alias("part")).agg(
        F.array_join(F.transform(ordered, lambda item: item["text"]), "").alias("text")
    )
    whole = numbered.groupBy(F.col(answer).alias("__answer")).agg(
        F.count(F.lit(1)).alias("pieces"), F.bool_or("done").alias("finished")
    )
    return parts.join(whole, F.col(answer).eqNullSafe(F.col("__answer"))).drop("__answer")
