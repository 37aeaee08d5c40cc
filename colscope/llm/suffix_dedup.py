"""Removal of repeated 200-byte strings, decided by suffix arrays that are built by linear grouping."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colscope.llm.common import cut, lean

#: Bytes of a string that counts, bytes of an anchor.
SPAN, ANCHOR = 200, 32
#: Bytes of strings in one suffix array, bytes of one anchor's strings beyond which they are told apart by more than the
#: anchor, windows that such a part holds, most bits of a filter that keeps rows without a partner out of the shuffles.
POOL_BYTES, HOT_BYTES, PART_WINDOWS, FILTER_BITS = 1 << 19, 4 << 20, 8, 1 << 26
_BYTE = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by doubling: a hash of 2n bytes is a mix of two of n."""
    have, n = _BYTE[raw], 1
    out, done = None, 0
    while True:
        if size & n:
            if out is None:
                out, done = have, n
            else:
                m = len(raw) - done - n + 1
                out = (out[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ have[done : done + m]
                out ^= out >> np.uint64(31)
                done += n
        if 2 * n > size:
            return out
        m = len(raw) - 2 * n + 1
        have = (have[:m] * np.uint64(0xD6E8FEB86659FD93)) ^ have[n : n + m]
        have ^= have >> np.uint64(29)
        n *= 2


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its least, the last among equals (van Herk's two sweeps)."""
    n = len(h)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    # the low half gives way to the place, so that a minimum also tells where it stands and the last of equals wins
    low = np.uint64(0xFFFFFFFF)
    padded[:n] = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    both = np.minimum(after[:m], before[width - 1 : width - 1 + m])
    return (low - (both & low)).astype(np.int64)


def previous_and_next_smaller(t: str, reach: int = 64) -> tuple[list[int], list[int]]:
    """For every suffix of t the nearest smaller one on its left (-1: none) and on its right (len(t): none).

    The text from a suffix up to the next smaller one is its longest Lyndon prefix.
    """
    n = len(t)
    before, after, stack = [-1] * n, [n] * n, []
    for i in range(n):
        own = t[i : i + reach]
        while stack:
            j = stack[-1]
            other = t[j : j + reach]
            if other < own or (other == own and t[j:] < t[i:]):
                before[i] = j
                break
            after[j] = i
            stack.pop()
        stack.append(i)
    return before, after


def suffix_array(t: str) -> list[int]:
    """Suffixes of t in order, by linear grouping.

    First the suffixes are parted into groups of equal Lyndon prefixes. They start as groups of equal first letters and
    are visited from the highest down; whoever is reached is final. The members of a group are counted at their previous
    smaller suffixes, whose prefixes they continue: of each parent group, the parents with k continuations leave for a new
    group right above it, that with more of them higher. Then one scan in order emits every group's members: a suffix is
    put next in its group when its next smaller suffix, which ranks lower, is met. No ranks are renamed or sorted again.
    """
    n = len(t)
    before, after = previous_and_next_smaller(t)
    lists: list[list[int]] = []
    first: dict[str, list[int]] = {}
    for i, c in enumerate(t):
        first.setdefault(c, []).append(i)
    group = [0] * n
    above: list[int] = []
    below: list[int] = []
    for k, c in enumerate(sorted(first)):
        lists.append(first[c])
        for i in first[c]:
            group[i] = k
        below.append(k - 1)
        above.append(k + 1)
    if above:
        above[-1] = -1
    now = len(lists) - 1
    while now >= 0:
        members = lists[now]
        if len(members) > 1:
            lists[now] = members = [i for i in members if group[i] == now]
        elif members and group[members[0]] != now:
            lists[now] = members = []
        if len(members) == 1:
            parents = {before[members[0]]: 1}
        else:
            parents = {}
            for i in members:
                p = before[i]
                parents[p] = parents.get(p, 0) + 1
        parents.pop(-1, None)
        if parents:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in parents.items():
                moved.setdefault((-k, group[p]), []).append(p)
            for (_, old), leaving in sorted(moved.items()) if len(moved) > 1 else moved.items():
                if len(leaving) == 1 and len(lists[old]) == 1:
                    continue  # a group of one is renamed to itself
                new = len(lists)
                lists.append(leaving)
                for p in leaving:
                    group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        now = below[now]
    at, g = 0, next((k for k in range(len(first)) if below[k] < 0), -1)
    heads = [0] * len(lists)
    while g >= 0:
        heads[g] = at
        at += len(lists[g])
        g = above[g]
    out = [0] * n
    i, at = n, -1
    while True:
        j = i - 1
        while j >= 0 and after[j] == i:
            k = group[j]
            out[heads[k]] = j
            heads[k] += 1
            j = before[j]
        at += 1
        if at >= n:
            return out
        i = out[at]


def repeated_windows(strings: list[bytes], anchors: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """For each of several distinct strings, whether each of its first ``windows`` 200-byte windows stands in another.

    ``anchors`` are the places of the strings' anchors; equal windows stand alike to theirs. So every string is cut at its
    anchor into symbols of eight bytes, whose order is that of their bytes, and one suffix array is built over all symbols.
    A window starts up to seven bytes before a symbol: it is repeated if another suffix shares the bytes from the symbol
    on, which the common prefixes of neighbours tell, and the same bytes stand before it.
    """
    buf = np.frombuffer(b"".join(strings) + bytes(16), np.uint8)
    size = np.array([len(s) for s in strings], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    phase = np.asarray(anchors, np.int64) % 8
    blocks = np.maximum(0, -(-(size - phase) // 8))
    owner = np.repeat(np.arange(len(strings)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)
    place = start[owner] + phase[owner] + 8 * nth
    rest = (start + size)[owner] - place
    wide = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    value = np.ascontiguousarray(wide[place]).view(">u8").ravel().astype(np.uint64)
    short = rest < 8
    value[short] &= ~((np.uint64(1) << ((8 - rest[short]).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
    _, symbol = np.unique(value, return_inverse=True)
    _, symbol = np.unique(symbol * 9 + np.minimum(rest, 8), return_inverse=True)  # what ends sooner comes first
    letters = np.zeros(len(owner) + len(strings), np.uint32)
    where = np.arange(len(owner)) + owner  # one separator after each string
    letters[where] = symbol.astype(np.uint32) + 1
    letters[letters >= 0xD800] += 0x800  # code points, without the range that is not one
    order = np.array(suffix_array(letters.tobytes().decode("utf-32-le")), np.int64)
    back = np.full(len(letters), -1, np.int64)
    back[where] = np.arange(len(owner))
    order = back[order]
    order = order[order >= 0]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(SPAN // 8 + 1):
        x, y = a[live] + k, b[live] + k
        inside = (x < len(owner)) & (y < len(owner))
        inside[inside] &= (owner[x[inside]] == owner[a[live[inside]]]) & (owner[y[inside]] == owner[b[live[inside]]])
        live, x, y = live[inside], x[inside], y[inside]
        diff = value[x] ^ value[y]
        same = diff == 0
        lead = np.zeros(len(live), np.int64)
        for byte in range(1, 8):
            lead += diff < (np.uint64(1) << np.uint64(64 - 8 * byte))
        lead[same] = 8
        common[live] += lead
        live = live[same]
        if not len(live):
            break
    common = np.minimum(common, np.minimum(rest[a], rest[b]))
    first = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(int(first[-1]), bool)
    far = np.maximum(place[order] - 8, 0)
    before = np.ascontiguousarray(wide[far]).view(">u8").ravel().astype(np.uint64)
    before >>= (np.uint64(8) * (far + 8 - place[order]).astype(np.uint64)) & np.uint64(63)
    for ahead in range(8):
        cluster = np.concatenate([[0], np.cumsum(common < SPAN - ahead)])
        window = place[order] - ahead - start[owner[order]]
        valid = (window >= 0) & (window < windows[owner[order]])
        if not valid.any():
            continue
        left = before[valid] & ((np.uint64(1) << np.uint64(8 * ahead)) - np.uint64(1))
        key = cluster[valid]
        rank = np.lexsort((left, key))
        k, v = key[rank], left[rank]
        edge = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]), [True]])
        many = np.repeat(np.diff(np.flatnonzero(edge)) > 1, np.diff(np.flatnonzero(edge)))
        hit = order[valid][rank][many]
        out[first[owner[hit]] + window[valid][rank][many]] = True
    return np.split(out, first[1:-1])


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and place of the anchor in it, for each run of windows.

    The anchor of a window of SPAN bytes is its string of ANCHOR bytes with the least hash. It follows from the window's
    bytes, so equal windows have equal anchors at equal places; windows in a row with one anchor form a run.
    """
    if len(data) < SPAN:
        return (np.empty(0, np.int64),) * 4
    raw = np.frombuffer(data, np.uint8)
    grams = gram_hashes(raw, ANCHOR)
    at = least_in_window(grams, SPAN - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]].view(np.int64), first, np.diff(np.append(first, len(at))), at[first] - first


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            found = runs(text.as_py() or b"")[0]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])


class Bits:
    """A set of 64-bit keys that may hold some more: one hash and eight bits a key, or all keys if that is too large."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.size = max(1 << 10, 1 << (8 * n - 1).bit_length()) if n else 1 << 10
        self.all = n > FILTER_BITS // 2
        self.size = min(self.size, FILTER_BITS)
        self.words = np.zeros(self.size // 32, np.uint32)
        if not self.all:
            place = F.pmod(F.col("key"), F.lit(self.size))
            spots = keys.select(place.alias("at")).selectExpr("at div 32 AS w", "shiftleft(1L, cast(at % 32 AS int)) AS b")
            words = spots.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
            self.words[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.all:
            return np.ones(len(keys), bool)
        place = keys.astype(np.int64) % self.size
        return (self.words[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1


def _occurrences(held):
    """Rows of runs whose anchor may stand elsewhere: document key, hash of the run's bytes, first window, windows, anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = text.as_py() or b""
                h, first, count, anchor = runs(data)
                keep = np.flatnonzero(bits.has(h)) if len(h) else ()
                if not len(keep):
                    continue
                h, first, count, anchor = h[keep], first[keep], count[keep], anchor[keep]
                r = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (first + count + SPAN - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                for c, v in zip(cols, (np.full(len(h), i), h, r, first, count, anchor), strict=True):
                    c.append(v)
            if cols[0]:
                row, h, r, first, count, anchor = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("th").take(pa.array(row)), pa.array(h), pa.array(r), pa.array(first), pa.array(count.astype(np.int32)), pa.array(anchor.astype(np.int32))], names=["doc_id", "th", "h", "r", "p", "w", "off"])

    return run


def _cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings that the requests of each document ask for."""
    names = ["key", "h", "r", "base", "w", "off", "data"]
    for batch in batches:
        out: list[tuple] = []
        for text, asked in zip(batch.column("text").cast(pa.binary()), batch.column("asked"), strict=True):
            data = text.as_py() or b""
            out += [(q["h"], q["h"], q["r"], 0, q["w"], q["off"], data[q["p"] : q["p"] + q["w"] + SPAN - 1]) for q in asked.as_py()]
        yield pa.RecordBatch.from_arrays(_string_columns(out), names=names)


def _string_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]


_STRINGS = "key long, h long, r long, base int, w int, off int, data binary"


def _part_strings(width: int):
    """Cut strings into parts of ``width`` places of the window against the anchor, keyed by the bytes all its windows share.

    Equal windows lie in parts of one key. At width 1 a part is one window and its key the hash of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "r", "base", "w", "off", "data"]
        for batch in batches:
            out: list[tuple] = []
            for key, h, r, base, w, off, data in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                at = 0
                while at < w:
                    block = (off - at) // width
                    end = min(w, off - block * width + 1)
                    shared = data[off - block * width : off - block * width - width + 1 + SPAN]
                    name = xxhash.xxh3_64_intdigest(b"%d %d " % (key, block) + shared) - (1 << 63)
                    out.append((name, h, r, base + at, end - at, off - at, data[at : end + SPAN - 1]))
                    at = end
            yield pa.RecordBatch.from_arrays(_string_columns(out), names=names)

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by key to rows (h, r, s, e): windows s to e-1 of the run stand elsewhere too."""
    held: list[tuple] = []
    pool: list[tuple] = []
    now, weight = None, 0

    def done() -> pa.RecordBatch:
        found = repeated_windows([x[-1] for x in pool], np.array([x[5] for x in pool]), np.array([x[4] for x in pool]))
        out = []
        for x, hit in zip(pool, found, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out += [(x[1], x[2], x[3] + int(a), x[3] + int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["h", "r", "s", "e"])

    def close() -> None:
        nonlocal weight
        once = list({(x[1], x[2], x[3]): x for x in held}.values())  # equal rows of a document ask twice
        if len(once) > 1:
            pool.extend(once)
            weight += sum(len(x[-1]) for x in once)
        held.clear()

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "r", "base", "w", "off", "data")), strict=True):
            if row[0] != now:
                close()
                now = row[0]
                if weight >= POOL_BYTES:
                    yield done()
                    pool, weight = [], 0
            held.append(row)
    close()
    if pool:
        yield done()


def _found_strings(strings: DataFrame, partitions: int) -> DataFrame:
    """Repeated windows of distinct strings of common anchors, as rows (h, r, s, e)."""
    out, schema = [], "h long, r long, s int, e int"
    for width in (PART_WINDOWS, 1):
        weight = strings.groupBy("key").agg(F.sum(F.octet_length("data").cast("long")).alias("b")).where(F.col("b") > HOT_BYTES).select(F.col("key").alias("hot"))
        if weight.isEmpty():
            break
        cold = strings.join(weight, strings["key"] == weight["hot"], "left_anti")
        out.append(cold.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(lean(_search), schema))
        strings = cut(strings.join(weight, strings["key"] == weight["hot"], "left_semi").mapInArrow(lean(_part_strings(width)), _STRINGS))
    else:
        # single windows, so many that differ in nothing: their bytes are grouped
        alike = strings.select("key", "data", "h", "r", "base").distinct()
        many = cut(alike.groupBy("key", "data").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key", "data"))
        out.append(alike.join(many, ["key", "data"]).select("h", "r", F.col("base").alias("s"), (F.col("base") + 1).alias("e")))
        strings = None
    if strings is not None:
        out.append(strings.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(lean(_search), schema))
    total = out[0]
    for more in out[1:]:
        total = total.unionAll(more)
    return total


def _remove(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("ranges"), strict=True):
                data = text.as_py() or b""
                spans: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in ranges.as_py() or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                edges = [0, *[x for span in spans for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [tuple(x) for x in spans], kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                arrays += [pa.array([[{"s": a, "e": b} for a, b in x] for x in cols[4]], span), pa.array(cols[5], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte that a 200-byte string covers which also starts anywhere else, in this or any other row.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, spans (byte ranges) and kept.

    Windows of 200 bytes are grouped into runs by their anchor (see ``runs``); only runs whose anchor stands elsewhere go
    on. A run whose bytes occur twice is repeated as a whole. For anchors whose runs differ, one copy of each distinct
    run's bytes is fetched and ``repeated_windows`` compares them by suffix array. Anchors with more than HOT_BYTES of
    distinct strings are told apart by the bytes that PART_WINDOWS neighbouring windows share, each part with a suffix
    array of its own, then window by window; windows of one place that are still too many are equal, or grouped by their
    bytes. Hashes decide that runs are equal (an anchor's and the run's, 64 bits each) and never that windows are.

    Defined cases: null text is no bytes; texts under 200 bytes lose nothing; repeated rows are separate occurrences, so
    what they hold in 200 bytes or more goes from each; null doc_ids are kept; an empty table gives no rows; other columns
    are ignored. What is left may begin or end inside a character.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    known = {"doc": F.xxhash64("doc_id", "th")}

    anchors = docs.select("text").mapInArrow(lean(_anchors), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("h").alias("hs"))
    anchors = cut(anchors)
    bits = spark.sparkContext.broadcast(Bits(anchors.select(F.col("hs").alias("key"))))
    rows = base.mapInArrow(lean(_occurrences(bits)), f"doc_id {id_type}, th long, h long, r long, p long, w int, off int")
    rows = cut(rows.join(anchors, rows["h"] == anchors["hs"], "left_semi"))

    alike = cut(rows.groupBy("h", "r").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "p")).alias("at"), F.first("w").alias("w"), F.first("off").alias("off")))
    mixed = alike.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where((F.col("kinds") > 1) & (F.col("least") == 1)).select(F.col("h").alias("mh"))
    asked = alike.join(mixed, alike["h"] == mixed["mh"], "left_semi")
    requests = cut(asked.groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("h", "r", F.col("at.p").alias("p"), "w", "off")).alias("asked")).select(F.col("doc_id").alias("q_id"), F.col("th").alias("q_th"), "asked"))

    def among(keys: DataFrame, c_id: str, c_th: str) -> DataFrame:
        held = spark.sparkContext.broadcast(Bits(keys.select(F.xxhash64(c_id, c_th).alias("key"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["doc_id", "th", "text"]).filter(pa.array(held.value.has(batch.column("key").to_numpy())))

        return base.select("*", known["doc"].alias("key")).mapInArrow(run, base.schema)

    joined = among(requests, "q_id", "q_th").join(requests, F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("th") == F.col("q_th")))
    strings = cut(joined.select("text", "asked").mapInArrow(lean(_cut_strings), _STRINGS))
    weight = strings.agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0)).alias("b")).first()["b"]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / (8 * POOL_BYTES)))
    partly = _found_strings(strings, partitions)
    wholly = alike.where(F.col("n") > 1).select("h", "r", F.lit(0).alias("s"), F.col("w").alias("e"))
    single = partly.join(wholly.select("h", "r"), ["h", "r"], "left_anti").unionAll(wholly)
    ranges = rows.join(single, ["h", "r"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct((F.col("p") + F.col("s")).alias("s"), (F.col("p") + F.col("e") + SPAN - 1).alias("e"))).alias("ranges")).select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "ranges")
    ranges = cut(ranges)

    schema = docs.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    if keep_bytes:
        schema = StructType(schema.fields + StructType.fromDDL("spans array<struct<s:bigint,e:bigint>>, kept binary").fields)
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))
    if keep_bytes:
        return base.join(ranges, same, "left").select("doc_id", "text", "ranges").mapInArrow(lean(_remove(True)), schema)
    changed = among(ranges, "r_id", "r_th").join(ranges, same).select("doc_id", "text", "ranges").mapInArrow(lean(_remove(False)), schema)
    data = F.coalesce(F.col("text"), F.lit(""))
    slim = base.select("doc_id", "th", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("kept_sha256"))
    whole = slim.join(ranges.select("r_id", "r_th"), same, "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return whole.unionAll(changed)
