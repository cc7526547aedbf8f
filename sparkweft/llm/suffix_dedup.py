"""Repeated byte strings across documents, removed by a hash-compared suffix sort.

A string of ``LENGTH`` bytes is a window. The least hash of the ``GRAM``-byte strings in a window picks its anchor, which
depends on the window's bytes only, so equal windows have equal anchors at equal places. Windows of a text with one anchor are
neighbours and share one context: the bytes that they cover together.

1. Anchors of all texts are sorted by hash over all partitions; those whose hash another text, or the same text elsewhere, has
   too are kept. A row is an anchor, about one for 35 bytes; a copy of a text adds none.
2. Contexts of these anchors meet by hash. A context equal to an earlier one is dropped where it is found.
3. In each task the contexts' suffixes from the anchor on, and their reversed beginnings up to it, are merge-sorted. Two
   suffixes are compared by the length they have in common, which a binary search over prefix polynomial hashes finds. The
   sorted order is then verified byte by byte: a hash collision anywhere makes the task sort again with another base. From the
   verified common lengths of neighbours follow the classes of equal left and right parts, and two windows of a group are equal
   exactly if both parts are. The first of each class of windows stays; all others start later and are removed.
4. The windows that stay go back to their texts, and the bytes under the others are cut.

An anchor with more than ``CROWD`` contexts is split: its windows are contexts of their own, under the hash of all their bytes.
Texts travel compressed. Nothing is held at once but a group of at most ``CROWD`` contexts, or one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column
from sparkweft.operators.ordinal import with_ordinal
from sparkweft.staging import stage

LENGTH = 100
GRAM = 32
CROWD = 32_768
_SEGMENT = 1 << 20  # bytes whose windows are looked at together
_PLACES = np.uint64(_SEGMENT - 1)
_COMBINED = 50_000  # contexts that a task holds back to drop equal ones
_COMBINED_BYTES = 16_000_000
_FACTOR = 0x9E3779B97F4A7C15
_PRIME = (1 << 31) - 1

Anchors = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of each ``size`` bytes; lengths are doubled, and joined at the end."""
    known = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}
    known[1] ^= known[1] >> np.uint64(32)
    power = lambda width: np.uint64(pow(_FACTOR, width, 1 << 64))
    width = 1
    while 2 * width <= size:
        known[2 * width] = known[width][:-width] * power(width) + known[width][width:]
        width *= 2
    total, done = None, 0
    while done < size:
        part = known[width][done:]
        if total is None:
            total = part
        else:
            rows = len(data) - done - width + 1
            total = total[:rows] * power(width) + part[:rows]
        done += width
        while done < size and width > size - done:
            width //= 2
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _segment_anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Anchors:
    """Hash, place, first and last window of each anchor; ``ends`` gives where the text of each byte ends."""
    windows = len(data) - length + 1
    hashes = _grams(data, gram)
    least = (hashes & ~_PLACES) | (_PLACES - np.arange(len(hashes), dtype=np.uint64))  # of equal hashes the last one
    reach, width = length - gram + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[reach - width : reach - width + windows])
    valid = np.flatnonzero(np.arange(windows) + length <= ends[:windows])
    if not len(valid):
        return tuple(np.zeros(0, dtype=np.uint64 if i == 0 else np.int64) for i in range(4))
    at = (_PLACES - (least[valid] & _PLACES)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    last = np.r_[new[1:] - 1, len(valid) - 1]
    return hashes[at[new]], at[new], valid[new], valid[last]


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, Anchors]:
    """The text (by number) of each anchor, with its hash, place, first and last window in that text."""
    found: list[tuple[np.ndarray, ...]] = []
    batch: list[int] = []

    def flush() -> None:
        if not batch:
            return
        sizes = np.array([len(texts[i]) for i in batch])
        ends = np.cumsum(sizes)
        got = _segment_anchors(np.frombuffer(b"".join(texts[i] for i in batch), dtype=np.uint8), np.repeat(ends, sizes), length, gram)
        of = np.searchsorted(ends, got[2], side="right")
        begins = (ends - sizes)[of]
        found.append((np.array(batch)[of], got[0], got[1] - begins, got[2] - begins, got[3] - begins))
        batch.clear()

    held = 0
    for number, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) >= _SEGMENT:
            for begin in range(0, len(text) - length + 1, step := _SEGMENT - length):
                part = np.frombuffer(text, dtype=np.uint8)[begin : begin + step + length - 1]
                got = _segment_anchors(part, np.full(len(part), len(part)), length, gram)
                found.append((np.full(len(got[0]), number), got[0], *[x + begin for x in got[1:]]))
            continue
        if held + len(text) >= _SEGMENT:
            flush()
            held = 0
        batch.append(number)
        held += len(text)
    flush()
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, (none.astype(np.uint64), none, none, none)
    of, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
    return of, tuple(rest)


def _name(text: bytes) -> tuple[int, int]:
    """Two numbers that stand for a text: 128 bits of its SHA-256."""
    digest = hashlib.sha256(text).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(name)]


def _listed(rows: DataFrame) -> DataFrame:
    """``key``, name (``h``, ``h2``), bytes and SHA-256 of every row."""

    @F.arrow_udf("struct<h:bigint,h2:bigint,n:bigint,sha:string>")
    def measure(texts: pa.Array) -> pa.Array:
        raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        names = [_name(t) for t in raw]
        return pa.array(
            [{"h": a, "h2": b, "n": len(t), "sha": hashlib.sha256(t).hexdigest()} for (a, b), t in zip(names, raw, strict=True)],
            pa.struct([("h", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sha", pa.string())]),
        )

    found = rows.select("key", measure.asNondeterministic()("text").alias("m"))
    return stage(found.select("key", "m.*", F.monotonically_increasing_id().alias("row")))


def _met(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``h`` of a text and ``g``, the hashes of its anchors that may stand elsewhere too. The last bit of a text's number tells
    whether the hash stands in it twice. A hash at the end of a partition counts as met, as its neighbours are not seen."""

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            of, (hashes, place, _, _) = anchors(texts, length, gram)
            order = np.lexsort((place, hashes, of))
            of, hashes, place = of[order], hashes[order], place[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])] if len(of) else np.zeros(0, dtype=bool)
            moved = np.r_[False, ~new[1:] & (place[1:] != place[:-1])] if len(of) else new
            starts = np.flatnonzero(new)
            twice = np.add.reduceat(moved.astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, dtype=bool)
            names = {i: _name(texts[i])[0] & ~1 for i in np.unique(of).tolist()}
            text = np.array([names[i] for i in of[starts].tolist()], dtype=np.int64) | twice
            yield pa.RecordBatch.from_arrays([pa.array(hashes[starts].view(np.int64)), pa.array(text)], ["g", "t"])

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = t = known = np.zeros(0, dtype=np.int64)  # the last row so far, and whether it has met another

        def out(rows: np.ndarray, g: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t[rows] & ~np.int64(1)), pa.array(g[rows])], ["h", "g"])

        for batch in batches:
            if not batch.num_rows:
                continue
            first = not len(g)
            g = np.concatenate([g, batch.column("g").to_numpy()])
            t = np.concatenate([t, batch.column("t").to_numpy()])
            fresh = np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])]
            g, t = g[fresh], t[fresh]
            met = (t & 1).astype(bool)
            same = g[1:] == g[:-1]
            met[1:] |= same
            met[:-1] |= same
            met[0] |= first or bool(known[0])
            yield out(np.flatnonzero(met[:-1]), g, t)
            g, t, known = g[-1:], t[-1:], met[-1:]
        if len(g):
            yield out(np.zeros(1, dtype=np.int64), g, t)

    found = rows.mapInArrow(marks, "g long, t long")
    in_order = found.repartitionByRange("g", "t").sortWithinPartitions("g", "t")
    return stage(in_order.mapInArrow(neighbours, "h long, g long"))


def _zipped(rows: DataFrame, length: int) -> DataFrame:
    """Each different text once, by name, compressed."""

    @F.arrow_udf("struct<h:bigint,h2:bigint,z:binary>")
    def pack(texts: pa.Array) -> pa.Array:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        raw = [t.as_buffer().to_pybytes() for t in texts]
        found = [{"h": a, "h2": b, "z": packer.compress(t)} for t in raw for a, b in [_name(t)]]
        return pa.array(found, pa.struct([("h", pa.int64()), ("h2", pa.int64()), ("z", pa.binary())]))

    long_ones = rows.where(F.octet_length("text") >= length).select(pack.asNondeterministic()("text").alias("m"))
    return long_ones.select("m.*").dropDuplicates(["h", "h2"])


def _met_anchors(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, bytes, Anchors, np.ndarray]]:
    """Row, text and anchors of each text, with those that the row's lists name: 1, or 2 for those of a crowd. Small texts are
    looked at together."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    first, held, texts = 0, 0, []
    for row in range(batch.num_rows):
        texts.append(unpack.decompress(batch.column("z")[row].as_buffer().to_pybytes()))
        held += len(texts[-1])
        if held < _SEGMENT and row + 1 < batch.num_rows:
            continue
        of, found = anchors(texts, length, gram)
        kind = np.zeros(len(of), dtype=np.int8)
        for mark, name in ((1, "few"), (2, "crowd")):
            lists = batch.column(name).slice(first, len(texts))
            sizes = np.diff(lists.offsets.to_numpy())
            named = np.concatenate([found[0], lists.flatten().to_numpy().view(np.uint64)])
            numbers = np.unique(named, return_inverse=True)[1] * len(texts)
            numbers += np.concatenate([of, np.repeat(np.arange(len(texts)), sizes)])  # a list holds for its own text
            kind[np.isin(numbers[: len(of)], numbers[len(of) :])] = mark
        order = np.lexsort((found[2], of))
        edges = np.searchsorted(of[order], np.arange(len(texts) + 1))
        for i, text in enumerate(texts):
            own = order[edges[i] : edges[i + 1]]
            yield first + i, text, tuple(values[own] for values in found), kind[own]
        first, held, texts = row + 1, 0, []


_CONTEXT = "g long, context binary, place int, num long, start long"


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each met anchor: its hash, its context, its place in that, and the order of the text and start in it."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes, int], tuple[int, int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys, firsts = list(held.keys()), list(held.values())
            arrays = [
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()),
                pa.array([f[0] for f in firsts], pa.int64()), pa.array([f[1] for f in firsts], pa.int64()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["g", "context", "place", "num", "start"])

        def add(g: int, context: bytes, place: int, num: int, start: int) -> None:
            key, first = (g, context, place), (num, start)
            known = held.get(key)
            if known is None or first < known:
                held[key] = first

        for batch in batches:
            nums = batch.column("num").to_pylist()
            for row, text, (hashes, at, begin, end), kind in _met_anchors(batch, length, gram):
                for i in np.flatnonzero(kind).tolist():
                    s, e = int(begin[i]), int(end[i])
                    if kind[i] == 1:
                        add(int(hashes[i].astype(np.int64)), text[s : e + length], int(at[i]) - s, nums[row], s)
                        size += e - s + length
                        continue
                    whole = _grams(np.frombuffer(text[s : e + length], dtype=np.uint8), length).view(np.int64).tolist()
                    for w in range(s, e + 1):
                        add(whole[w - s], text[w : w + length], 0, nums[row], w)
                    size += (e - s + 1) * length
                    if size >= _COMBINED_BYTES:
                        yield flush()
                        size = 0
                if len(held) >= _COMBINED or size >= _COMBINED_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return texts.mapInArrow(cut, _CONTEXT)


class _Suffixes:
    """Suffixes of ``data`` that begin at ``starts`` and end before ``ends``, compared by hashes of what they have in common."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> None:
        self.data, self.starts, self.sizes = data, starts, ends - starts
        power = np.ones(len(data) + 1, dtype=np.int64)
        done = 1
        while done < len(power):  # powers of the base by doubling
            more = min(done, len(power) - done)
            power[done : done + more] = power[:more] * (int(power[done - 1]) * base % _PRIME) % _PRIME
            done += more
        self.power = power
        self.hash = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data.astype(np.int64) + 1) * power[:-1] % _PRIME, out=self.hash[1:])
        self.hash %= _PRIME

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes ``a`` and ``b`` have in common, by binary search."""
        x, y = self.starts[a], self.starts[b]
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.sizes[a], self.sizes[b])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            left = (self.hash[x + middle] - self.hash[x]) % _PRIME * self.power[y]
            right = (self.hash[y + middle] - self.hash[y]) % _PRIME * self.power[x]
            equal = (left - right) % _PRIME == 0
            low, high = np.where(equal, middle, low), np.where(equal, high, np.maximum(middle - 1, low))
        return low

    def after(self, common: np.ndarray, a: np.ndarray) -> np.ndarray:
        """The byte of each suffix behind the common ones, -1 at its end."""
        inside = common < self.sizes[a]
        return np.where(inside, self.data[np.minimum(self.starts[a] + common, len(self.data) - 1)].astype(np.int64), -1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.common(a, b)
        return self.after(common, a) < self.after(common, b)

    def bytes_in_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`common`, from the bytes themselves."""
        most = np.minimum(self.sizes[a], self.sizes[b])
        found = np.zeros(len(a), dtype=np.int64)
        for first in range(0, len(a), 20_000):
            part = slice(first, first + 20_000)
            at = np.arange(int(most[part].max(initial=0)) + 1)
            x, y = (np.minimum(self.starts[s[part], None] + at, len(self.data) - 1) for s in (a, b))
            differs = (self.data[x] != self.data[y]) | (at >= most[part, None])
            found[part] = differs.argmax(axis=1)
        return found


def _merge_sorted(suffixes: _Suffixes, block: np.ndarray) -> np.ndarray:
    """Order of the suffixes in each block; ``block`` numbers the blocks, in rising order. Runs of doubling width are merged:
    each suffix finds its place in the other run by binary search."""
    rows = len(block)
    order = np.arange(rows)
    begin = np.searchsorted(block, block, side="left")
    end = np.searchsorted(block, block, side="right")
    width = 1
    while width < int((end - begin).max(initial=0)):
        at = np.flatnonzero(end - begin > width)
        run = (at - begin[at]) // width
        own = begin[at] + run * width
        other = np.minimum(begin[at] + (run ^ 1) * width, end[at])
        low, high = other.copy(), np.minimum(other + width, end[at])
        from_left = run % 2 == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            mine, theirs = order[at[open_]], order[middle]
            left = from_left[open_]
            lesser = suffixes.less(np.where(left, theirs, mine), np.where(left, mine, theirs))
            behind = lesser == left  # the other's suffix stands before: it is less, or not greater from the left run
            low[open_] = np.where(behind, middle + 1, low[open_])
            high[open_] = np.where(behind, high[open_], middle)
        merged = order.copy()
        pair = begin[at] + (run // 2) * 2 * width
        merged[pair + (at - own) + (low - other)] = order[at]
        order = merged
        width *= 2
    return order


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within their blocks and the bytes each has in common with the one before, -1 at a block's first.
    The order is verified on the bytes; if a collision has spoilt it, the sort is done again with another base."""
    rng = np.random.default_rng(seed)
    while True:
        suffixes = _Suffixes(data, starts, ends, int(rng.integers(1 << 20, _PRIME - 1)))
        order = _merge_sorted(suffixes, block)
        before, after = order[:-1], order[1:]
        common = suffixes.bytes_in_common(before, after)
        same = block[1:] == block[:-1]
        if not np.any(same & (suffixes.after(common, before) > suffixes.after(common, after))):
            return order, np.r_[-1, np.where(same, common, -1)] if len(block) else np.zeros(0, dtype=np.int64)


def _classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Numbers that are equal where the first ``least`` bytes of two suffixes of a block are."""
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(common < least)
    return of


def first_windows(contexts: list[bytes], place: np.ndarray, block: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, whether each of its windows is the first of its bytes. Contexts are given by block, and in a block in
    the order of their anchors; ``place`` is the anchor's place in its context."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    at = begins + place
    windows = sizes - length + 1
    right, right_common = sorted_suffixes(data, at, ends, block)
    turned = data[::-1].copy()
    left, left_common = sorted_suffixes(turned, len(data) - at, len(data) - begins, block, 1)
    met = lambda order, common: np.maximum(common, np.r_[common[1:], -1])[np.argsort(order)]
    most_right, most_left = met(right, right_common), met(left, left_common)
    first = np.ones(int(windows.sum()), dtype=bool)
    offset = np.cumsum(windows) - windows
    for before in range(int(place.max(initial=0)) + 1):  # bytes of a window before the anchor
        rows = np.flatnonzero(
            (place >= before) & (before > place - windows) & (most_left >= before) & (most_right >= length - before)
        )
        if len(rows) < 2:
            continue
        both = _classes(left, left_common, before)[rows] * (len(contexts) + 1) + _classes(right, right_common, length - before)[rows]
        by = np.argsort(both, kind="stable")
        again = np.flatnonzero(both[by][1:] == both[by][:-1]) + 1
        again = rows[by[again]]
        first[offset[again] + place[again] - before] = False
    return np.split(first, offset[1:])


def _kept_runs(contexts: DataFrame, length: int) -> DataFrame:
    """``num``, ``start`` and ``n``: runs of windows that are the first of their bytes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed: list[tuple[bytes, int, int, int, int]] = []
        group: dict[tuple[bytes, int], tuple[int, int]] = {}
        number, current = 0, None

        def close() -> None:
            nonlocal number
            found = [(context, place, number, num, start) for (context, place), (num, start) in group.items()]
            closed.extend(sorted(found, key=lambda x: (x[3], x[4] + x[1])))
            group.clear()
            number += 1

        def flush() -> pa.RecordBatch:
            nums, starts, ns = [], [], []
            alone = np.bincount(np.array([c[2] for c in closed], dtype=np.int64) - (closed[0][2] if closed else 0)) if closed else []
            several = [c for c in closed if alone[c[2] - closed[0][2]] > 1]
            for context, _, n, num, start in closed:
                if alone[n - closed[0][2]] == 1:
                    nums.append(num), starts.append(start), ns.append(len(context) - length + 1)
            if several:
                flags = first_windows([c[0] for c in several], np.array([c[1] for c in several]), np.array([c[2] for c in several]), length)
                for (_, _, _, num, start), flag in zip(several, flags, strict=True):
                    edge = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        nums.append(num), starts.append(start + a), ns.append(b - a)
            closed.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nums, starts, ns)], ["num", "start", "n"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("g", "context", "place", "num", "start")]
            for g, context, place, num, start in zip(*columns, strict=True):
                if g != current:
                    close()
                    current = g
                    if len(closed) >= CROWD:
                        yield flush()
                known = group.get((context, place))
                if known is None or (num, start) < known:
                    group[context, place] = (num, start)
        close()
        yield flush()

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(work, "num long, start long, n long")


def _spans(first: np.ndarray, last: np.ndarray, kept: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Byte ranges under the windows from ``first`` to ``last`` (inclusive, pairwise) but those of the ``kept`` runs."""
    gaps: list[tuple[int, int]] = []
    kept = sorted(kept)
    k = 0
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        while k < len(kept) and kept[k][0] + kept[k][1] <= a:
            k += 1
        j = k
        while j < len(kept) and kept[j][0] <= b:
            if kept[j][0] > a:
                gaps.append((a, kept[j][0] - 1))
            a = max(a, kept[j][0] + kept[j][1])
            j += 1
        if a <= b:
            gaps.append((a, b))
    spans: list[list[int]] = []
    for a, b in gaps:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length)
        else:
            spans.append([a, b + length])
    return spans


def _cut(texts: DataFrame, length: int, gram: int, with_text: bool) -> DataFrame:
    """Removed bytes, spans and SHA-256 of the rest of each text, and the rest itself if it is wanted."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, shas, rests = [], [], [], []
            for row, text, (_, _, begin, end), kind in _met_anchors(batch, length, gram):
                kept = [(r["start"], r["n"]) for r in batch.column("kept")[row].as_py() or []]
                met = kind > 0
                spans = _spans(begin[met], end[met], kept, length)
                rest = b"".join(text[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(text)], strict=True))
                removed.append(len(text) - len(rest))
                counts.append(len(spans))
                shas.append(hashlib.sha256(rest).hexdigest())
                rests.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(rests, pa.binary())],
                ["h", "h2", "n_removed", "n_spans", "cut_sha", "rest"],
            )

    return texts.mapInArrow(cut, "h long, h2 long, n_removed long, n_spans long, cut_sha string, rest binary")


def without_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, rest: bool = False
) -> DataFrame:
    """For every row ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (runs of removed bytes) and ``kept_sha256``, of the
    bytes left; with ``rest`` also these bytes, as ``kept``, null where nothing is cut.

    Every byte under a string of ``length`` bytes that also starts earlier goes: in a text with a smaller key, or in the same
    one before. Texts are judged as they are given, as UTF-8, and strings never cross texts. Of rows with one key those with
    different texts are ordered by a digest, and of rows with equal texts the one with the least key is the original, any one of
    those that share it; null keys stand behind all others. Null and empty texts have no bytes, shorter texts than ``length``
    lose none. No rows give no rows. Other columns are left out. ``gram`` (at most ``length``) is the length of the strings
    that anchors are told by, ``crowd`` the number of contexts from which an anchor is split; neither changes the result.
    """
    rows = df.select(column(key).alias("key"), column(text).cast("binary").alias("text"))
    listed = _listed(rows)
    order = F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")
    firsts = listed.groupBy("h", "h2").agg(F.min(order).alias("first"))
    numbered = with_ordinal(firsts.select("h", "h2", "first"), [F.col("first.unnamed"), F.col("first.key"), "h", "h2"], "num")
    numbered = stage(numbered)
    met = _met(rows.where(F.octet_length("text") >= length), length, gram)
    crowds = met.groupBy("g").count().where(F.col("count") > crowd).select("g", F.lit(True).alias("crowded"))
    split = met.join(crowds, "g", "left").select("h", "g", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    lists = split.groupBy("h").agg(
        F.collect_list(F.when(~F.col("crowded"), F.col("g"))).alias("few"), F.collect_list(F.when(F.col("crowded"), F.col("g"))).alias("crowd")
    )
    names = numbered.select("h", "h2", "num", F.col("h").bitwiseAND(F.lit(-2)).alias("even"))
    marked = stage(names.join(lists.withColumnRenamed("h", "even"), "even").drop("even"))
    runs = stage(_kept_runs(_contexts(_zipped(rows, length).join(marked, ["h", "h2"]), length, gram), length))
    kept = runs.groupBy("num").agg(F.collect_list(F.struct("start", "n")).alias("kept"))
    answers = stage(marked.join(kept, "num", "left").drop("num"))
    done = stage(_cut(_zipped(rows, length).join(answers, ["h", "h2"]), length, gram, rest))
    originals = numbered.select("h", "h2", F.col("first.row").alias("original"))
    whole = listed.join(originals, ["h", "h2"]).join(done, ["h", "h2"], "left")
    original, gone = F.col("row") == F.col("original"), F.col("n") >= length
    nothing = hashlib.sha256(b"").hexdigest()
    pick = lambda own, copied, else_: F.when(original, F.coalesce(own, else_)).when(gone, copied).otherwise(else_)
    return whole.select(
        F.col("key").alias(key), F.col("n").alias("n_bytes"),
        pick(F.col("n_removed"), F.col("n"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.col("n_spans"), F.lit(1).cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.col("cut_sha"), F.lit(nothing), F.col("sha")).alias("kept_sha256"),
        *([F.when(original, F.col("rest")).when(gone, F.lit(b"")).alias("kept")] if rest else []),
    )
