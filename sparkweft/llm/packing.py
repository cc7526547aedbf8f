"""Packing token sequences into windows by non-negative least squares.

Documents are tokenized and cut into full windows and a rest. Over the histogram of the lengths of the rests, combinations of
up to three lengths that fill a window are enumerated, and non-negative least squares finds how often to repeat each so that
the histogram is met. Rounded repeats are taken; what they leave is packed greedily, again by lengths only; what would leave
gaps is laid end to end and cut. The driver plans with the histogram, which has a row per length; pieces are numbered inside
their length by Spark and look their place up in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, per_process
from sparkweft.staging import stage, stage_path

WINDOW = 4096
END_ID = 2
UNIT = 8  # longer pieces are planned in steps of so many tokens
EXACT_BELOW = 512  # pieces up to this length are planned by their exact length
MOST_PARTS = 3
GREEDY_GAP = 0.01  # share of a window that a greedily filled one may leave empty
BUCKET_ROWS = 20_000
_CACHED_WORDS = 400_000


# Letters that the tokenizer lower-cases and maps one by one, and marks it splits off them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*#$%&)]*)")


class _Words(dict):
    """Ids of words, as bytes, by word; words whose ids were found before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        first = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        # Only a tokenizer that drops white space and never looks across it has the ids of a text in its words.
        self.within_words = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
        self.mapped: dict[str, str] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _char(self, char: str) -> str:
        if char not in self.mapped:
            self.mapped[char] = "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(char))
        return self.mapped[char]

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            found = self._ids(word)
        elif plain[2]:
            found = self[plain[1]] + self[plain[2]]
        elif not word.islower():
            found = self[word.lower()]
        else:  # one piece for the model; the steps before it cost more than the model
            piece = word if word.isascii() else "".join(map(self._char, word))
            found = np.array([t.id for t in self.tokenizer.model.tokenize(piece)], dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self) > _CACHED_WORDS:
                self.clear()
                self[""] = b""
            self[word] = found
        return found

    def of_text(self, text: str) -> bytes:
        if not self.within_words:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text and the end id; a null text has the end id only."""
    words = per_process(f"words {path}", lambda: _Words(path))
    return np.append(np.frombuffer(words.of_text(text or ""), dtype="<u4"), np.uint32(END_ID))


_PIECES = "array<struct<start:bigint,length:bigint,doc_tokens:bigint,ids_crc32:bigint,ids:binary>>"


def pieces(text: Column, path: str, window: int = WINDOW) -> Column:
    """Array of a text's pieces: full windows and a rest, with the checksum of their ids and the ids (32 bits each)."""
    kind = pa.list_(
        pa.struct([(n, pa.int64()) for n in ("start", "length", "doc_tokens", "ids_crc32")] + [("ids", pa.binary())])
    )

    @F.arrow_udf(_PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            ids = token_ids(value.as_py(), path)
            row = []
            for start in range(0, len(ids), window):
                part = ids[start : start + window].astype("<u4").tobytes()
                row.append(
                    {
                        "start": start, "length": len(part) // 4, "doc_tokens": len(ids), "ids_crc32": zlib.crc32(part),
                        "ids": part if len(part) < 4 * window else None,  # a full window is never cut again
                    }
                )
            rows.append(row)
        return pa.array(rows, kind)

    return cut.asNondeterministic()(text)


def planned_length(length: int) -> int:
    return length if length <= EXACT_BELOW else -(-length // UNIT) * UNIT


def fill_combinations(lengths: Sequence[int], window: int) -> list[tuple[int, ...]]:
    """Combinations of up to ``MOST_PARTS`` of the lengths that fill the window exactly."""
    there = set(lengths)
    found = [(window,)] if window in there else []
    for parts in range(2, MOST_PARTS + 1):
        for chosen in combinations_with_replacement(sorted(there), parts - 1):
            last = window - sum(chosen)
            if last >= chosen[-1] and last in there:
                found.append((*chosen, last))
    return found


def nnls(matrix: np.ndarray, wanted: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative least squares with an active set; stops after ``steps`` at a feasible point."""
    x = np.zeros(matrix.shape[1])
    free: list[int] = []
    tolerance = 1e-8 * max(1.0, float(np.abs(wanted).max()))
    for _ in range(steps):
        gain = matrix.T @ (wanted - matrix @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        free.append(best)
        while free:
            part = matrix[:, free]
            square = part.T @ part
            square[np.diag_indices_from(square)] += 1e-9
            z = np.linalg.solve(square, part.T @ wanted)
            if z.min() > 0:
                x[free] = z
                break
            now = x[free]
            low = z <= 0
            shift = (now[low] / np.maximum(now[low] - z[low], 1e-300)).min()
            x[free] = np.maximum(now + shift * (z - now), 0.0)
            gone = [j for j, zj in zip(free, z, strict=True) if zj <= 0 and x[j] <= 1e-12]
            x[gone] = 0.0
            free = [j for j in free if j not in gone] if gone else free[:-1]
    return x


class Range(NamedTuple):
    """Pieces ``low`` to ``high`` of a length go to sequences from ``sequence`` on, ``each`` of them to one."""

    planned: int
    low: int
    high: int
    sequence: int
    each: int
    slot: int


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Range], int]:
    """Ranges of pieces by planned length, and the number of sequences they fill; pieces in no range are left over."""
    left = dict(histogram)
    used = dict.fromkeys(histogram, 0)
    ranges: list[Range] = []
    sequences = 0

    def take(parts: dict[int, int], repeats: int) -> None:
        nonlocal sequences
        slot = 0
        for length, each in parts.items():
            ranges.append(Range(length, used[length], used[length] + repeats * each, sequences, each, slot))
            used[length] += repeats * each
            left[length] -= repeats * each
            slot += each
        sequences += repeats

    def tally(lengths: Sequence[int]) -> dict[int, int]:
        return {length: list(lengths).count(length) for length in dict.fromkeys(lengths)}

    if left.get(window):
        take({window: 1}, left[window])
    lengths = [x for x in left if EXACT_BELOW < x < window]
    chosen = fill_combinations(lengths, window)
    if chosen:
        row = {length: i for i, length in enumerate(lengths)}
        matrix = np.zeros((len(lengths), len(chosen)))
        for j, parts in enumerate(chosen):
            for length in parts:
                matrix[row[length], j] += 1
        repeats = nnls(matrix, np.array([left[x] for x in lengths], dtype=np.float64), 2 * len(lengths))
        for j in np.argsort(-repeats, kind="stable").tolist():
            parts = tally(chosen[j])
            most = min(left[length] // each for length, each in parts.items())
            if (count := min(int(repeats[j] + 0.5), most)) > 0:
                take(parts, count)
    while True:
        space, parts = window, {}
        for length in sorted((x for x in left if left[x]), reverse=True):
            if (each := min(space // length, left[length])) > 0:
                parts[length] = each
                space -= each * length
        if not parts or space > GREEDY_GAP * window:
            break
        take(parts, min(left[length] // each for length, each in parts.items()))
    return ranges, sequences


def _numbered(rows: DataFrame, group: str, amount: Column, name: str, buckets: int) -> DataFrame:
    """``name``: the sum of ``amount`` over the rows of the same group before each row, in the order of (bucket, pid)."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("pid"), F.lit(buckets)).cast("int")).withColumn("amount", amount)
    inner = W.partitionBy(group, "bucket").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(group, "bucket").agg(F.sum("amount").alias("held"))
    starts = sums.select(group, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    summed = rows.withColumn("inner", F.coalesce(F.sum("amount").over(inner), F.lit(0))).join(starts, [group, "bucket"])
    return summed.withColumn(name, F.col("first") + F.col("inner")).drop("bucket", "amount", "inner", "first")


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Pieces of all rows in sequences: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``
    and ``offset`` (all long); the sequence's pieces follow each other without gaps from 0.

    A null or empty text is the end id alone. Repeated rows and rows with null keys are packed each on its own. A very long text
    gives as many full windows as it holds. No rows give no pieces. Other columns are left out. Sequences of the plan lie
    first, those of cut pieces follow; the last may be short. Lengths with very many pieces, such as those of a large group
    of copies, are numbered in buckets of a hash.
    """
    spark = df.sparkSession
    folder = stage_path(spark)
    cut = df.select(column(key).alias("key"), F.explode(pieces(column(text), path, window)).alias("p"))
    cut = cut.select("key", "p.*", F.monotonically_increasing_id().alias("pid"))
    cut.write.option("compression", "zstd").parquet(folder)
    cut = spark.read.schema(cut.schema).parquet(folder)
    planned = F.when(F.col("length") <= EXACT_BELOW, F.col("length")).otherwise(F.ceil(F.col("length") / UNIT) * UNIT)
    narrow = cut.drop("ids").withColumn("planned", F.least(planned, F.lit(window)).cast("int"))
    counts = narrow.groupBy("planned").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    ranges, sequences = plan({r["planned"]: r["n"] for r in counts}, window)
    schema = "planned int, low long, high long, sequence long, each long, slot long"
    table = F.broadcast(spark.createDataFrame(ranges, schema).withColumnRenamed("planned", "of"))  # few rows per length
    buckets = max(256, total // BUCKET_ROWS)
    ranked = _numbered(narrow, "planned", F.lit(1).cast("long"), "rank", buckets)
    inside = (F.col("planned") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = stage(ranked.join(table, inside, "left"))
    nth = F.col("rank") - F.col("low")
    names = [F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens"]
    sequence = (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id")
    slot = (F.col("slot") + nth % F.col("each")).alias("slot")
    before = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    filled = placed.where(F.col("sequence").isNotNull()).select(*names, sequence, slot)
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")
    # what is left over is laid end to end and cut where a window ends
    over = placed.where(F.col("sequence").isNull()).drop("rank", "of", "low", "high", "sequence", "each", "slot")
    over = _numbered(over.withColumn("all", F.lit(0)), "all", F.col("length"), "at", buckets)
    room = F.lit(window) - F.col("at") % window
    over = stage(over.withColumn("room", room))
    here = (F.lit(sequences) + F.floor(F.col("at") / window)).alias("sequence_id")
    uncut = over.where(F.col("length") <= F.col("room"))
    uncut = uncut.select(*names, here, (F.col("at") % window).alias("offset"))
    long = over.where(F.col("length") > F.col("room")).join(cut.where(F.col("ids").isNotNull()).select("pid", "ids"), "pid")
    head = F.struct(
        F.col("start"), F.col("room").alias("length"), F.lit(0).cast("long").alias("next"),
        F.expr("substring(ids, 1, cast(4 * room as int))").alias("part"), (F.col("at") % window).alias("offset"),
    )
    tail = F.struct(
        (F.col("start") + F.col("room")).alias("start"), (F.col("length") - F.col("room")).alias("length"),
        F.lit(1).cast("long").alias("next"), F.expr("substring(ids, cast(4 * room + 1 as int))").alias("part"),
        F.lit(0).cast("long").alias("offset"),
    )
    halves = long.select("key", "doc_tokens", here, F.explode(F.array(head, tail)).alias("h"))
    halves = halves.select(
        F.col("key").alias(key), "h.start", "h.length", F.crc32("h.part").alias("ids_crc32"), "doc_tokens",
        (F.col("sequence_id") + F.col("h.next")).alias("sequence_id"), "h.offset",
    )
    return filled.unionByName(uncut).unionByName(halves)
