"""SimHash near-duplicates through an inverted index of positional bytes.

A fingerprint has eight bytes. Two that differ in at most two bits share at least six of them in place, so every pair to
be found shares one of the 28 choices of six positions with the same bytes: these are the keys of the index. At a key two
fingerprints share at least the guaranteed six bytes and differ in two bytes at most, so no list is longer than 65,536
however large the corpus. Pairs that meet have their shared bytes counted, which also tells at which one of their keys
they are taken, and are then verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, packed, unpacked
from sparkweft.llm.components import components
from sparkweft.staging import stage

SHINGLE_WORDS = 3
MOST_BITS = 2
_SEED = 42
_CHUNK = 16_384  # hashes whose bits are counted at once


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles as an unsigned integer; 0 for a text without words."""
    import xxhash

    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(words_per_shingle, len(words))
    digest, seed = xxhash.xxh64_intdigest, _SEED
    pairs = zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)
    hashes = np.array([digest(line[a:b], seed) for a, b in pairs], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), _CHUNK):
        part = hashes[first : first + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words_per_shingle: int = SHINGLE_WORDS) -> Column:
    """:func:`fingerprint` of a text column as a signed long."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        values = [fingerprint(t.as_py(), words_per_shingle) for t in texts]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return hashed.asNondeterministic()(text)


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """All pairs (u, v) of different ``fp`` with at most two differing bits, each once."""
    byte = lambda position: F.shiftright(F.col("fp"), 8 * position).bitwiseAND(F.lit(255))
    keys = []
    for dropped in combinations(range(8), 2):  # lists 0 to 6 leave out the first position
        value = F.lit(0).cast("long")
        for position in range(8):
            if position not in dropped:
                value = F.shiftleft(value, 8).bitwiseOR(byte(position))
        keys.append(value)
    index = distinct.select("fp", F.posexplode(F.array(*keys)).alias("list", "key"))
    left = index.select(F.col("fp").alias("u"), "list", "key").hint("merge")
    right = index.select(F.col("fp").alias("v"), F.col("list").alias("list_v"), F.col("key").alias("key_v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    same = [F.shiftright(differ, 8 * p).bitwiseAND(F.lit(255)) == 0 for p in range(8)]
    tally = sum((s.cast("int") for s in same[1:]), same[0].cast("int"))
    # Six shared bytes meet at one list. Seven meet at seven: the one that leaves out the first position is taken.
    once = (tally == 6) | ((tally == 7) & F.when(same[0], F.col("list") < 7).otherwise(F.col("list") == 0))
    meet = (F.col("list") == F.col("list_v")) & (F.col("key") == F.col("key_v")) & (F.col("u") < F.col("v"))
    return left.join(right, meet & once & (F.bit_count(differ) <= MOST_BITS)).select("u", "v")


def _components(marked: DataFrame) -> DataFrame:
    """``fp`` and ``root`` of all fingerprints of ``marked``."""
    nodes = stage(marked.select("fp").distinct())
    roots = stage(components(linked_fingerprints(nodes)))
    return stage(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def simhash_groups(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    carry: Sequence[str] = (),
    words_per_shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """``key`` and the columns ``carry`` of every row, with ``fingerprint`` (16 hexadecimal digits) and ``component_id``
    (the least key reachable over links).

    A null text, an empty one and one of white space have no shingle and fingerprint zero; such rows link with each other
    and with any fingerprint close to zero. Rows of one fingerprint are one node of the graph, so a group of copies of
    any size costs one row there. Null keys are passed over for the id; a component of null keys only has a null id. No
    rows give no rows. Other columns are left out, whatever their names. The text is read once, whole, and only
    fingerprints are shuffled.
    """
    held = F.struct(column(key).alias("key"), *[column(c).alias(f"c{i}") for i, c in enumerate(carry)])
    marked = stage(df.select(held.alias("held"), fingerprints(column(text), words_per_shingle).alias("fp")))
    roots = _components(marked)
    firsts = marked.groupBy("fp").agg(F.min("held.key").alias("first"))
    ids = firsts.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of = stage(roots.join(ids, "root").select("fp", "component_id"))
    carried = [F.col(f"held.c{i}").alias(c) for i, c in enumerate(carry)]
    return marked.join(of, "fp").select(
        F.col("held.key").alias(key), *carried, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_copies(
    df: DataFrame, text: str = "text", key: str = "doc_id", words_per_shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """One row of each group, whole: that of the least key (nulls last), and of several rows with this key any one."""
    marked = stage(
        df.select(
            packed(df), column(key).alias("key"), F.monotonically_increasing_id().alias("id"),
            fingerprints(column(text), words_per_shingle).alias("fp"),
        )
    )
    rank = F.struct(F.col("key").isNull().alias("n"), "key", "id")
    firsts = marked.groupBy("fp").agg(F.min(rank).alias("first")).join(_components(marked), "fp")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"))
    # The rows that go are the shorter list, so whole rows meet that one; where Spark finds it too long to send, they move once.
    gone = stage(marked.select("id").join(stage(kept), "id", "left_anti"))
    return marked.join(gone, "id", "left_anti").select(*unpacked(df.columns))
