"""Delimited files.

Two readers are offered. :func:`read_csv` follows Spark's own CSV rules with RFC quoting: it honours line breaks inside quotes
and reads an unquoted empty cell as NULL. A file of any size is read in blocks all the same: whether a block begins inside
quotes follows from the number of quotes in the blocks before it, so one count per block and a running sum over these counts
tell where records begin. :func:`read_csv_records` keeps an empty cell apart from a missing one and keeps surplus cells, but
needs one record per line.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.text import cell_at, csv_cells
from sparkweft.operators.ordinal import with_chunk_id
from sparkweft.operators.rows import require_columns
from sparkweft.sources.paths import require_path
from sparkweft.staging import stage

# A separator no text file holds: it turns the CSV reader into a line reader that drops each file's header.
_NEVER = "\x01\x02\x01"


def charset(encoding: str) -> str:
    """Spark's name of a Python encoding. Names beyond ISO-8859-1, ASCII and UTF need a session with
    ``spark.sql.legacy.javaCharsets``, which :func:`sparkweft.build_session` sets."""
    name = codecs.lookup(encoding).name
    return name.replace("iso8859", "iso-8859").replace("ascii", "us-ascii").replace("-le", "le").replace("-be", "be")


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "utf-8",
    multi_line: bool = True,
    infer_types: bool = False,
) -> DataFrame:
    """Headed CSV, all columns text unless ``infer_types``.

    Blank lines are skipped, short rows end in NULLs, surplus cells are dropped. Records may span lines, which end in LF or
    CRLF; with ``multi_line=False`` no cell may hold a line break, and one pass over the file is enough. Only compressed
    files, encodings of more than one byte for a line feed, and type inference over records that span lines are read by one
    task per file. A quote that is never closed makes the rest of its file one cell.
    """
    if _splits(multi_line, infer_types, encoding):
        return _parsed(quoted_records(spark, path, encoding), _names(spark, path, delimiter, encoding), delimiter).select("row.*")
    return _spark_csv(spark, path, delimiter, encoding, multi_line, infer_types)


def _splits(multi_line: bool, infer_types: bool, encoding: str) -> bool:
    return multi_line and not infer_types and len("\n".encode(encoding)) == 1


def _spark_csv(spark: SparkSession, path: str, delimiter: str, encoding: str, multi_line: bool, infer_types: bool) -> DataFrame:
    require_path(spark, path)
    reader = spark.read.options(
        header=True,
        sep=delimiter,
        encoding=charset(encoding),
        multiLine=multi_line,
        quote='"',
        escape='"',
        inferSchema=infer_types,
    )
    return reader.csv(path)


def _names(spark: SparkSession, path: str, delimiter: str, encoding: str) -> list[str]:
    """Column names as Spark's reader gives them."""
    return _spark_csv(spark, path, delimiter, encoding, True, False).columns


def _parsed(records: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """The place of each record and its cells, as the struct ``row``."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    return records.select("src_file", "src_block", "src_seq", F.from_csv("value", schema.toDDL(), options).alias("row"))


_FRAGMENT = "src_file string, src_block long, src_seq long, kind int, value binary"
_WHOLE, _BEGUN, _ENDED, _INSIDE = range(4)  # a record, and the parts of one that lies in several blocks


def quoted_records(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Records of headed files without the header, blank ones left out: ``value`` with the place where it begins, ``src_file``,
    ``src_block`` and ``src_seq``.

    The first pass counts quotes per block. The second cuts blocks into records, knowing how they begin. Only what is left
    over at the ends of blocks is put together by a shuffle: two parts per block at most.
    """
    require_path(spark, path)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block"),
    )
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value").cast("string"), F.lit('"'), F.lit("")))
    blocks = lines.groupBy("src_file", "src_block").agg(F.sum(quotes).alias("quotes"))
    before = W.partitionBy("src_file").orderBy("src_block").rowsBetween(W.unboundedPreceding, -1)
    odd = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).where("inside").drop("quotes")
    known = lines.join(F.broadcast(odd), ["src_file", "src_block"], "left")  # a row per block at most, as many as tasks
    known = known.select("src_file", "src_block", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    cut = stage(known.mapInArrow(_cut_blocks, _FRAGMENT))
    whole = cut.where(F.col("kind") == _WHOLE).drop("kind")
    parts = cut.where(F.col("kind") != _WHOLE)
    upto = W.partitionBy("src_file").orderBy("src_block", "src_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    began = F.last(F.when(F.col("kind") == _BEGUN, F.struct("src_block", "src_seq")), ignorenulls=True).over(upto)
    in_order = F.sort_array(F.collect_list(F.struct("src_block", "src_seq", F.hex("value").alias("h"))))
    joined = parts.withColumn("began", began).groupBy("src_file", "began").agg(
        F.unhex(F.array_join(F.transform(in_order, lambda part: part["h"]), "0A")).alias("value")
    )
    records = whole.unionByName(joined.select("src_file", "began.src_block", "began.src_seq", "value"))
    decoded = F.col("value").cast("string") if charset(encoding) == "utf-8" else F.decode("value", charset(encoding))
    text = F.regexp_replace(decoded, "^\ufeff|\r$", "")
    header = (F.col("src_block") == 0) & (F.col("src_seq") == 0)
    return records.where(~header).select("src_file", "src_block", "src_seq", text.alias("value")).where(F.trim("value") != "")


def _cut_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lines as records; a block's rows come in order, and many blocks may come one after another."""
    block, held, seq, inside, continued = None, [], 0, False, False

    def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        seqs, kinds, values = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block[0]] * len(rows), pa.string()), pa.array([block[1]] * len(rows), pa.int64()),
                pa.array(seqs, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.binary()),
            ],
            ["src_file", "src_block", "src_seq", "kind", "value"],
        )

    def leftover() -> list[tuple[int, int, bytes]]:
        return [(seq, _INSIDE if continued else _BEGUN, b"\n".join(held))] if held else []

    for batch in batches:
        files, starts = batch.column("src_file"), batch.column("src_block")
        values, odd = batch.column("value").to_pylist(), batch.column("inside")
        changes = [i for i in range(batch.num_rows) if i == 0 or starts[i] != starts[i - 1] or files[i] != files[i - 1]] if batch.num_rows else []
        for first, last in zip(changes, [*changes[1:], batch.num_rows], strict=True):
            place = (files[first].as_py(), starts[first].as_py())
            if place != block:
                if block is not None:
                    yield out(leftover())
                block, held, seq, inside = place, [], 0, odd[first].as_py()
                continued = inside
            rows = []
            for line in values[first:last]:
                inside ^= line.count(b'"') % 2 == 1
                if inside:
                    held.append(line)
                    continue
                if held or continued:
                    line = b"\n".join([*held, line])
                    held = []
                rows.append((seq, _ENDED if continued else _WHOLE, line))
                continued = False
                seq += 1
            yield out(rows)
    if block is not None:
        yield out(leftover())


def _record_lines(spark: SparkSession, path: str, encoding: str, header: bool) -> DataFrame:
    """Non-blank lines as ``value``, with ``header`` without the first line of every file."""
    options = {"header": header, "sep": _NEVER, "quote": "", "encoding": charset(encoding)}
    return spark.read.options(**options).schema("value string").csv(path)


def headers(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> list[str]:
    """Column names as written; an empty file is an error."""
    require_path(spark, path)
    first = _record_lines(spark, path, encoding, header=False).head()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = spark.range(1).select(csv_cells(F.lit(first.value), delimiter).alias("names")).head()
    return names["names"]


def read_csv_records(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", overflow: str = "overflow"
) -> DataFrame:
    """Headed CSV with one record per line: empty cell ``''``, missing cell NULL, surplus cells in ``overflow``.

    When a name repeats, its last column wins.
    """
    names = headers(spark, path, delimiter, encoding)
    lines = _record_lines(spark, path, encoding, header=True)
    cells = lines.select(csv_cells(F.col("value"), delimiter).alias("cells"))
    last = {name: i for i, name in enumerate(names)}
    surplus = F.when(
        F.size("cells") > len(names), F.slice("cells", F.lit(len(names) + 1), F.size("cells") - len(names))
    )
    return cells.select(
        *[cell_at(F.col("cells"), i, None).alias(name) for name, i in last.items()], surplus.alias(overflow)
    )


def read_csv_arrays(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """Every record, the header too, as one array of its cells, however many there are."""
    require_path(spark, path)
    lines = _record_lines(spark, path, encoding, header=False)
    return lines.select(csv_cells(F.col("value"), delimiter).alias("cells"))


def row_count(spark: SparkSession, path: str, physical: bool = False, **options) -> int:
    """Records of a headed file; ``physical`` counts lines less one, whatever they hold."""
    if physical:
        return spark.read.text(require_path(spark, path)).count() - 1
    return read_csv(spark, path, **options).count()


def read_csv_ordered(spark: SparkSession, path: str, **options) -> DataFrame:
    """:func:`read_csv` with the place of each row: ``src_file``, ``src_block`` and ``src_seq``."""
    given = {"delimiter": ",", "encoding": "utf-8", "multi_line": True, "infer_types": False} | options
    if _splits(given["multi_line"], given["infer_types"], given["encoding"]):
        names = _names(spark, path, given["delimiter"], given["encoding"])
        placed = _parsed(quoted_records(spark, path, given["encoding"]), names, given["delimiter"])
        return placed.select("row.*", "src_file", "src_block", "src_seq")
    rows = read_csv(spark, path, **options)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_seq"),
    )


def read_csv_chunks(spark: SparkSession, path: str, chunk_size: int = 1000, **options) -> DataFrame:
    """:func:`read_csv` with ``ordinal`` and ``chunk_id`` in file order."""
    rows = read_csv_ordered(spark, path, **options)
    placed = with_chunk_id(rows, ["src_file", "src_block", "src_seq"], chunk_size)
    return placed.drop("src_file", "src_block", "src_seq")


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows one by one for a caller's own loop; the driver holds one partition at a time."""
    return df.toLocalIterator()


def read_headed_tsv(spark: SparkSession, path: str, required: list[str], encoding: str = "utf-8") -> DataFrame:
    """Headed tab-separated file that must have the required columns; rows too short for them are skipped."""
    rows = read_csv_records(spark, path, delimiter="\t", encoding=encoding)
    require_columns(rows, required)
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return rows.where(complete)
