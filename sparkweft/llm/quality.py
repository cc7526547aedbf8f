"""Quality rules: statistics of whole texts and a robust multivariate outlier test per language and source.

Each group's location and scatter are minimum-covariance-determinant estimates: starting from medians, the three quarters
of the group's rows with the least Mahalanobis distance give new means and covariances, over and over, which lowers the
determinant each time (concentration steps). Every step is one aggregation over all rows; a group of any size is summed in
parts. A text is rejected when its transformed statistics lie too far out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, others, packed, unpacked
from sparkweft.staging import stage

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW_WORDS = 8
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30
SUPPORT = 0.75  # share of a group's rows that its estimate rests on
MIN_GROUP = 100  # a smaller group uses its language's estimate, a smaller language that of all texts
STEPS = 8
TAIL = 1e-3  # share of a normal group that would be rejected

# Transformed statistics, the deviations that the first distances are in, and the least deviation each is given where its group
# has less: a statistic that is zero in nearly all texts has no spread of its own. Each is small enough for the statistic to
# reject a text alone.
FEATURES = ("log_words", "log_word_length", "symbols", "dup_lines", "repeats")
FIRST_DEVIATION = (1.25, 0.15, 0.35, 0.25, 0.2)
LEAST_DEVIATION = (0.1, 0.04, 0.1, 0.075, 0.055)

_SYMBOLS = frozenset("#*$%&|<>")
_BINS = 32  # bins of squared distance per doubling
_PACK = 1 << 21


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _windows(ids: np.ndarray, distinct: int) -> np.ndarray:
    """One number per window of eight words, equal for equal windows: ranks of three, joined exactly."""
    if distinct < _PACK:
        three = _ranks((ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:])
    else:
        two = _ranks(ids[:-1] * distinct + ids[1:])
        three = _ranks(two[:-1] * distinct + ids[2:])
    size = len(three)
    if size < _PACK:
        return _ranks((three[:-5] << 42) | (three[3:-2] << 21) | three[5:])
    return _ranks(_ranks(three[:-5] * size + three[3:-2])[: size - 5] * size + three[5:])


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of eight words that occur at least twice, the first occurrence included."""
    n = len(words)
    if n <= WINDOW_WORDS:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    if len(numbers) == n:
        return 0
    windows = _windows(ids, len(numbers))
    again = np.bincount(windows)[windows] > 1
    if not again.any():
        return 0
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, np.flatnonzero(again), 1)
    np.add.at(steps, np.flatnonzero(again) + WINDOW_WORDS, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


_SPACES = "\t\n\x0b\x0c\r "


MEASURED = (*STATISTICS, "n_lines")


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """``MEASURED`` of one text, lines being those that are not blank; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white spaces only
    chars = len(text) - sum(map(text.count, _SPACES))
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return len(words), chars, sum(map(text.count, _SYMBOLS)), dups, repeated_words(words), dups + len(seen)


def statistics_column(text: Column) -> Column:
    """Struct of :func:`text_statistics` of a text column."""

    @F.arrow_udf("struct<" + ",".join(f"{name}:bigint" for name in MEASURED) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        rows = [text_statistics(t.as_py()) for t in texts]
        columns = np.array(rows, dtype=np.int64).reshape(-1, len(MEASURED)).T
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list(MEASURED))

    return measure.asNondeterministic()(text)


def base_failed(stats: Column) -> Column:
    """Too few words, or too many in repeated passages."""
    words, repeats = stats["n_words"], stats["n_repeat_words"]
    return (words < MIN_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * words)


def _features(stats: Column) -> list[Column]:
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    share = lambda name: stats[name] / words
    return [
        F.log(words),
        F.log(F.greatest(share("word_chars"), F.lit(0.5))),
        F.log1p(20 * share("n_symbols")),
        stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)).cast("double"),
        share("n_repeat_words"),
    ]


def cutoff(dimensions: int = len(FEATURES), tail: float = TAIL) -> float:
    """Chi-square quantile by the cube-root normal approximation."""
    spread = 2 / (9 * dimensions)
    return dimensions * (1 - spread + NormalDist().inv_cdf(1 - tail) * math.sqrt(spread)) ** 3


def _distance(estimate: Column) -> Column:
    """Squared Mahalanobis distance of ``f0..`` from an estimate (location ``m``, inverse scatter ``w`` as a flat array)."""
    size = len(FEATURES)
    off = [F.col(f"f{i}") - estimate["m"][i] for i in range(size)]
    total = F.lit(0.0)
    for i, j in combinations_with_replacement(range(size), 2):
        total = total + (1.0 if i == j else 2.0) * estimate["w"][i * size + j] * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _estimate(moments: dict[str, float], support: float) -> tuple[list[float], list[float]]:
    """Location and flat inverse scatter from sums over the supporting rows."""
    size, n = len(FEATURES), moments["n"]
    mean = np.array([moments[f"s{i}"] / n for i in range(size)])
    scatter = np.zeros((size, size))
    for i, j in combinations_with_replacement(range(size), 2):
        scatter[i, j] = scatter[j, i] = moments[f"s{i}_{j}"] / n - mean[i] * mean[j]
    if support < 1:  # the kept part of a normal group has less scatter than the group
        inner = cutoff(size, 1 - support)
        scatter *= support / max(1 - _chi_tail(inner, size + 2), 0.05)
    units = np.outer(LEAST_DEVIATION, LEAST_DEVIATION)
    spreads, axes = np.linalg.eigh(scatter / units)  # the least deviations hold in directions without spread only
    return mean.tolist(), ((axes / np.maximum(spreads, 1)) @ axes.T / units).ravel().tolist()


def _chi_tail(value: float, dimensions: int) -> float:
    spread = 2 / (9 * dimensions)
    return 1 - NormalDist().cdf(((value / dimensions) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def _with_estimates(features: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Rows of ``features`` with the estimate of their group; rows of groups without one are left out."""
    if few:
        return features.join(F.broadcast(estimates), "g")
    # every text is in the widest group, so that one is never a key of the shuffle
    widest = features.where("g = ''").join(F.broadcast(estimates.where("g = ''")), "g")
    return widest.unionByName(features.where("g <> ''").join(estimates, "g"))


def robust_estimates(features: DataFrame) -> tuple[DataFrame, bool]:
    """Estimates of the groups of ``features`` (``g``, ``f0..``) with at least ``MIN_GROUP`` rows and of the group of all rows
    (``''``): ``g``, ``n``, ``m`` and ``w``; and whether these groups are few.

    Sums by bin of distance are added up from the nearest bin on by a window, so a step gives one row per group, in a
    written table; the driver gets no more than the largest move. Up to ``GROUPS_BROADCAST`` groups are broadcast, more are
    joined by a shuffle.
    """
    size = len(FEATURES)
    schema = "g string, n long, m array<double>, w array<double>"
    middle = F.array(*[F.percentile_approx(f"f{i}", 0.5, 1000) for i in range(size)])
    scale = np.diag(1 / np.square(np.array(FIRST_DEVIATION))).ravel().tolist()
    start = features.groupBy("g").agg(F.count(F.lit(1)).alias("n"), middle.alias("m"), F.lit(scale).alias("w"))
    found = stage(start.where((F.col("n") >= MIN_GROUP) | (F.col("g") == "")))
    few = found.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    products = [(i, j) for i, j in combinations_with_replacement(range(size), 2)]
    summed = {f"s{i}": F.col(f"f{i}") for i in range(size)}
    summed.update({f"s{i}_{j}": F.col(f"f{i}") * F.col(f"f{j}") for i, j in products})
    names = list(summed)
    nearest = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                mean, weights = _estimate({"n": row["held"], **{name: row[name] for name in names}}, row["held"] / row["n"])
                rows.append((row["g"], row["n"], mean, weights, max(abs(a - b) for a, b in zip(mean, row["m"], strict=True))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["g", "n", "m", "w", "moved"]
            )

    for _ in range(STEPS):
        far = _with_estimates(features, found, few).withColumn("d", _distance(F.struct("m", "w")))
        far = far.withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * _BINS).cast("int"))
        bins = far.groupBy("g", "bin").agg(
            F.first("n").alias("n"), F.first("m").alias("m"), F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in summed.items()]
        )
        added = bins.select("g", "n", "m", "rows", F.sum("rows").over(nearest).alias("held"), *[F.sum(n).over(nearest).alias(n) for n in names])
        need = SUPPORT * F.col("n")
        support = added.where((F.col("held") >= need) & (F.col("held") - F.col("rows") < need))
        after = stage(support.drop("rows").mapInArrow(estimated, f"{schema}, moved double"))
        moved = after.agg(F.max("moved").alias("moved")).head()["moved"]
        found = after.drop("moved")
        if moved is None or moved < 1e-3:
            break
    return found, few


GROUPS_BROADCAST = 20_000  # rows of about 300 bytes


def _names(lang: str, source: str) -> list[Column]:
    """Names of the groups of a row, from the narrowest to all rows."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), column(c).cast("string")), F.lit("null"))
    return [F.concat(part(lang), F.lit("\t"), part(source)), part(lang), F.lit("")]


def quality_rules(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every row with the five ``STATISTICS`` (long), ``base_failed``, ``distance`` and ``kept``.

    ``carry`` names the columns to keep, all of them if None; those named like results are replaced. A null or empty text
    has zeros and fails the base rule, as any text under 20 words. ``distance`` is the squared robust distance from the
    row's group, or from its language's or the whole corpus's when the group has under ``MIN_GROUP`` texts; null languages
    and sources are groups like others. Texts without words have no part in the estimates and a null distance. Ties and
    repeated rows count each. No rows give no rows. ``kept`` is false for base failures and for distances over
    :func:`cutoff`. Distances of steps are cut by fine bins, so the support is a little over three quarters of a group.
    """
    added = (*STATISTICS, "base_failed", "distance", "kept")
    names = [c for c in others(df, *added) if carry is None or c in carry]
    row = F.struct(*[column(c) for c in names], F.lit(0).alias("__filler"))
    measured = df.select(row.alias("row"), F.array(*_names(lang, source)).alias("gs"), statistics_column(column(text)).alias("s"))
    measured = stage(measured)
    values = {f"f{i}": f for i, f in enumerate(_features(F.col("s")))}
    features = measured.where(F.col("s.n_words") > 0).select("gs", "s").withColumns(values)
    features = stage(features.select(F.explode("gs").alias("g"), *values))
    estimates, few = robust_estimates(features)
    wide = measured.select("row", "gs", "s")
    for level in range(3):
        own = estimates.where("g = ''" if level == 2 else "g <> ''").select(F.col("g").alias(f"g{level}"), F.struct("m", "w").alias(f"e{level}"))
        own = F.broadcast(own) if few or level == 2 else own
        wide = wide.join(own, F.col("gs")[level] == F.col(f"g{level}"), "left")
    wide = wide.withColumn("e", F.coalesce("e0", "e1", "e2")).withColumns(values)
    distance = F.when(F.col("s.n_words") > 0, _distance(F.col("e")))
    failed = base_failed(F.col("s"))
    return wide.select(
        *unpacked(names), *[F.col(f"s.{n}").alias(n) for n in STATISTICS], failed.alias("base_failed"), distance.alias("distance"),
        (~failed & F.coalesce(distance <= cutoff(), F.lit(False))).alias("kept"),
    )


def good_documents(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that the rules keep, unchanged."""
    row = "__document"
    while row in df.columns:
        row += "_"
    held = df.select(packed(df, row), column(text).alias("text"), column(lang).alias("lang"), column(source).alias("source"))
    return quality_rules(held, carry=[row]).where("kept").select(*unpacked(df.columns, row))
