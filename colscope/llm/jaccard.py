"""N-gram Jaccard join: documents whose sets of word shingles are alike, found by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from colscope.llm.common import cut, lean
from colscope.llm.components import components

WIDTH = 5
#: Text bytes for each bucket of the token table, partitions at most, text bytes that a worker tokenizes at a time, most
#: tokens of a block.
BUCKET_BYTES, MOST_PARTITIONS, FLUSH_BYTES, BLOCK_TOKENS = 16 << 20, 20_000, 8 << 20, 4_000_000
#: A token is hot if it is in so many records and at least in one of so many; salts that its records are dealt to.
HOT_RECORDS, HOT_SHARE, SALTS = 1 << 15, 512, 256
#: Pivots of a block that is too large for one task; pivots in vain after which no more are tried in one that is not.
PIVOTS, IN_VAIN = 32, 8
#: Postings that are merged at a time.
MERGED = 2_000_000
#: DivideSkip's weight of the cost of a merge against that of a probe.
MERGE_WEIGHT = 0.0085
#: Number of records that stands for that of a hot token; bytes of a text that are hashed at a time.
MANY, CHUNK = (1 << 31) - 1, 1 << 16

_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_BYTE[32] = 0
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below the n-th at least; only tables of up to 2 * CHUNK stay in memory."""
    size = max(2 * CHUNK, n)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64) for base in (_BASE, _INVERSE))
    if size == 2 * CHUNK:
        _powers.update(up=up, down=down)
    return up, down


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; with fewer words the whole sequence is one."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    word = raw != 32
    if not word.any():
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # CHUNK bytes at a time, so that a very long text needs no long tables; a word's hash does not hang on its place
    words = np.empty(len(start), np.uint64)
    edge = np.searchsorted(start, np.arange(0, len(raw) + CHUNK, CHUNK))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a < b:
            low, own = start[a], raw[start[a] : end[b - 1]]
            up, down = (_powers["up"], _powers["down"]) if _powers and len(own) <= 2 * CHUNK else _upto(len(own))
            words[a:b] = np.add.reduceat(_BYTE[own] * up[: len(own)], start[a:b] - low) * down[start[a:b] - low]
    words = _mix(words ^ ((end - start).astype(np.uint64) * _BASE))
    n = len(words)
    size = min(width, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k : n - size + 1 + k]) * _BASE
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def least_overlap(n: int) -> int:
    """Least intersection of a set of n with any set that it links to: three quarters, rounded up."""
    return (3 * n + 3) // 4


def linked(overlap, n, m):
    """100 * overlap >= 75 * union, in integers."""
    return 7 * overlap >= 3 * (n + m)


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for length[0] numbers, then the same from first[1] on."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Block:
    """Inverted lists over records, as one sorted array of token * records + record.

    Records stand in two runs, each in order of size: the first ``apart`` of them, then the others. ``flat`` holds the
    tokens of one record after another, ``lengths`` how many each has.
    """

    def __init__(self, sizes: np.ndarray, lengths: np.ndarray, flat: np.ndarray, apart: np.ndarray | None = None):
        first = np.zeros(len(sizes), bool) if apart is None else apart
        self.order = np.lexsort((sizes, ~first))
        self.sizes, self.lengths, self.apart = sizes[self.order], lengths[self.order], int(first.sum())
        self.count = len(sizes)
        starts = np.cumsum(lengths) - lengths
        codes = flat[_ranges(starts[self.order], self.lengths)]
        self.of = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.lists = np.sort(self.of * self.count + np.repeat(np.arange(self.count), self.lengths))

    def reach(self, queries: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """The records that each query may link with: those of the first run by size, or the smaller ones before it."""
        n = self.sizes[queries]
        if apart:
            own = self.sizes[: self.apart]
            return np.searchsorted(own, (3 * n + 3) // 4), np.searchsorted(own, 4 * n // 3, side="right")
        return self.apart + np.searchsorted(self.sizes[self.apart :], (3 * n + 3) // 4), queries

    def search(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, joined=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, record) that link, record at ``low`` or above and below ``high`` of its query.

        T-occurrence by DivideSkip: a record must stand on at least T of a query's lists. The L longest lists are put
        aside; the others are merged, by one sort for many queries, and counted; a record that occurs T - L times or more
        is looked up in the long lists by binary search, and retained if all occurrences reach its own T. The cost is
        that of the lists, not of the records in reach. Pairs for which ``joined`` holds are not looked up.
        """
        at, step = 0, max(1, MERGED // max(1, int(self.lengths.max(initial=1))) // 4)
        while at < len(queries):
            some = slice(at, at + step)
            yield from self._lists(queries[some], low[some], high[some], joined)
            at += step

    def _lists(self, queries, low, high, joined):
        n = self.sizes[queries]
        count = self.lengths[queries]
        of = np.repeat(np.arange(len(queries)), count)
        base = self.of[_ranges(self.starts[queries], count)] * self.count
        first = np.searchsorted(self.lists, base + low[of])
        length = np.searchsorted(self.lists, base + high[of]) - first
        least = -(-3 * (n + (3 * n + 3) // 4) // 7)
        held = np.flatnonzero(length > 0)
        held = held[(np.bincount(of[held], minlength=len(queries)) >= least)[of[held]]]
        if not len(held):
            return
        held = held[np.lexsort((length[held], of[held]))]
        of, base, first, length = of[held], base[held], first[held], length[held]
        lists = np.bincount(of, minlength=len(queries))
        end = np.cumsum(lists)
        longest = np.where(lists > 0, length[np.maximum(end - 1, 0)], 2)
        aside = np.minimum(least - 1, (least / (MERGE_WEIGHT * np.log2(np.maximum(longest, 2)) + 1)).astype(np.int64))
        aside = np.minimum(aside, lists)
        short = np.arange(len(of)) < (end - aside)[of]
        cost = np.bincount(of[short], weights=length[short], minlength=len(queries))
        part = (np.cumsum(cost) // MERGED).astype(np.int64)
        for k in np.unique(part[lists > 0]):
            use = np.flatnonzero(short & (part[of] == k))
            m = length[use]
            keys, seen = np.unique(np.repeat(of[use] * self.count - base[use], m) + self.lists[_ranges(first[use], m)], return_counts=True)
            q, record = np.divmod(keys, self.count)
            need = -(-3 * (n[q] + self.sizes[record]) // 7)
            keep = np.flatnonzero(seen >= need - aside[q])
            if joined is not None and len(keep):
                keep = keep[~joined(queries[q[keep]], record[keep])]
            q, record, seen, need = q[keep], record[keep], seen[keep], need[keep]
            for a in range(0, len(q), step := max(1, MERGED // max(1, int(aside.max())))):
                qq, rr = q[a : a + step], record[a : a + step]
                probes = aside[qq]
                keys = base[_ranges((end - aside)[qq], probes)] + np.repeat(rr, probes)
                hit = self.lists[np.minimum(np.searchsorted(self.lists, keys), len(self.lists) - 1)] == keys
                total = seen[a : a + step] + np.bincount(np.repeat(np.arange(len(qq)), probes), weights=hit, minlength=len(qq)).astype(np.int64)
                found = total >= need[a : a + step]
                yield queries[qq[found]], rr[found]


class _Joined:
    """Which records of a block links join so far."""

    def __init__(self, n: int):
        self.parent, self.root = list(range(n)), np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def settle(self) -> None:
        root = np.array(self.parent, np.int64)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        self.root = root


def _by_pivots(known: _Joined, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Join records to pivots that they link with. A pivot is compared with all records at once, so a group of near copies
    costs a pass or two. Pivots are the records without a group whose tokens are the commonest, for those lie in the
    middle of the largest groups, until several in a row find next to nothing; then only those are left whose lists are so long that a pass over all records costs less than to merge them. Returns
    which records were pivots: all their links are known.
    """
    has, pivots = np.flatnonzero(lengths > 0), np.zeros(len(sizes), bool)
    if not len(has):
        return pivots
    where = np.cumsum(lengths) - lengths
    starts = where[has]
    listed = np.zeros(len(sizes), np.int64)
    listed[has] = np.add.reduceat(np.bincount(codes)[codes], starts)
    dear = listed > len(codes) // 4
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    lone = lengths > 0
    vain = 0
    for p in np.argsort(-listed / np.maximum(lengths, 1), kind="stable").tolist():
        if vain >= IN_VAIN and not dear[p] or not lone[p]:
            continue
        own = codes[where[p] : where[p] + lengths[p]]
        mark[own] = True
        overlap = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[own] = False
        near = has[linked(overlap, sizes[has], sizes[p])]
        near = near[near != p]
        known.add(np.full(len(near), p), near)
        fresh = int(lone[near].sum())
        lone[near] = lone[p] = False
        pivots[p] = True
        vain = 0 if fresh * 64 >= len(sizes) else vain + 1
    known.settle()
    return pivots


def link_records(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, flat: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The least id that links reach, for each record. Pairs already joined through others are not verified again.

    With ``labels``, records of equal label count as joined from the start. After a few pivots, a token that only records
    of one group have can tell nothing more and goes, and so do records with too few tokens left; the rest is searched,
    except for the largest group, which the others are searched against.
    """
    known = _Joined(len(sizes))
    if labels is not None:
        _, head, of = np.unique(labels, return_index=True, return_inverse=True)
        known.add(np.arange(len(sizes)), head[of])
    _, codes = np.unique(flat, return_inverse=True)
    codes = codes.astype(np.int64)
    rest = ~_by_pivots(known, sizes, lengths, codes)
    live, codes, n = np.flatnonzero(rest), codes[np.repeat(rest, lengths)], lengths[rest]
    while len(codes):
        group = np.repeat(known.root[live], n)
        order = np.argsort(codes, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) > 0]))
        mixed = np.minimum.reduceat(group[order], edge) < np.maximum.reduceat(group[order], edge)
        keep = np.empty(len(codes), bool)
        keep[order] = np.repeat(mixed, np.diff(np.append(edge, len(codes))))
        left = np.bincount(np.repeat(np.arange(len(live)), n)[keep], minlength=len(live))
        enough = left >= least_overlap(sizes[live])
        if keep.all() and enough.all():
            break
        keep &= np.repeat(enough, n)
        live, codes, n = live[enough], codes[keep], left[enough]
    if len(live):
        roots, of = np.unique(known.root[live], return_inverse=True)
        largest = of == np.argmax(np.bincount(of))
        block = Block(sizes[live], n, codes, largest)
        at = live[block.order]
        queries = np.arange(block.apart, block.count)
        for apart in (True, False):
            for a in range(0, len(queries), 8192):
                some = queries[a : a + 8192]
                for q, record in block.search(some, *block.reach(some, apart), lambda x, y: known.root[at[x]] == known.root[at[y]]):
                    known.add(at[q], at[record])
                known.settle()
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, known.root, ids)
    return least[known.root]


def _list_column(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list, dict[int, np.ndarray]]]:
    """Documents, their records and the records' shingles, FLUSH_BYTES of text at a time."""
    docs, recs, sets, held = [], [], {}, 0
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            data = data.as_py() or b""
            tokens = shingles(data, width)
            rec = None
            if len(tokens):
                rec = xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)
                sets.setdefault(rec, tokens)
            docs.append(doc_id)
            recs.append(rec)
            held += len(data)
            if held >= FLUSH_BYTES:
                yield docs, recs, sets
                docs, recs, sets, held = [], [], {}, 0
    if docs:
        yield docs, recs, sets


def _frequent(share: int, width: int):
    """Tokens that are in one of 2 * ``share`` or more of a flush's records, with how many records of the task have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for _, _, sets in _sets(batches, width):
            if not sets:
                continue
            token, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            often = count >= max(4, len(sets) // (2 * share))
            tokens, at = np.unique(np.concatenate([tokens, token[often]]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, count[often]]), minlength=len(tokens)).astype(np.int64)
            if len(tokens) > MERGED:
                kept = np.sort(np.argsort(counts)[-MERGED // 2 :])
                tokens, counts = tokens[kept], counts[kept]
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    return run


def hot_tokens(docs: DataFrame, rows: int, width: int = WIDTH) -> np.ndarray:
    """Sorted tokens that a large share of all records has; counts are from below, by workers over all documents.

    There are at most 2 * HOT_SHARE times as many as an average record has tokens. What is found only decides how tokens
    are dealt and ordered, never whether a link counts.
    """
    if rows < HOT_RECORDS:
        return np.empty(0, np.uint64)  # no token can be in so many
    found = docs.select("doc_id", "text").mapInArrow(lean(_frequent(HOT_SHARE, width)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    hot = found.where(F.col("n") >= max(HOT_RECORDS, rows // (2 * HOT_SHARE))).select("token").collect()
    return np.sort(np.array([r["token"] for r in hot], np.int64).view(np.uint64))


def _token_rows(bits: int, partitions: int, hot, doc_type: pa.DataType, width: int):
    """Tokenize; emit membership rows (doc_id, rec, n; bucket -1), a row (rec, n, hot tokens; bucket -2) for each record
    and, per bucket of the token space, its other tokens packed by record. ``part`` says which partition a row goes to.
    """
    low_bits = min(48, 64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, common = ["part", "bucket", "doc_id", "rec", "n", "blob"], hot.value
        for docs, recs, sets in _sets(batches, width):
            size = [len(sets[r]) if r is not None else 0 for r in recs]
            k = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, -1)), pa.array(docs, doc_type), pa.array(recs, pa.int64()), pa.array(size, pa.int32()), pa.nulls(k, pa.binary())], names=names)
            if not sets:
                continue
            ids, arrays = np.fromiter(sets, np.int64, len(sets)), list(sets.values())
            lengths = np.array([len(a) for a in arrays], np.int64)
            tokens, owner = np.concatenate(arrays), np.repeat(np.arange(len(ids)), lengths)
            shown = [b""] * len(ids)
            if len(common):
                often = np.isin(tokens, common)
                at = np.searchsorted(owner[often], np.arange(len(ids) + 1))
                often_tokens = tokens[often]
                shown = [often_tokens[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                tokens, owner = tokens[~often], owner[~often]
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, -2)), pa.nulls(k, doc_type), pa.array(ids), pa.array(lengths.astype(np.int32)), pa.array(shown, pa.binary())], names=names)
            if not len(tokens):
                continue
            bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner = bucket[order], owner[order]
            low = tokens[order] & np.uint64((1 << low_bits) - 1)
            edge = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])
            run_at = np.flatnonzero(edge)
            inside = np.arange(len(owner)) - np.repeat(run_at, np.diff(np.append(run_at, len(owner))))
            run_at = np.flatnonzero(inside % 65535 == 0)  # counts take 16 bits; longer runs go on in another
            count = np.diff(np.append(run_at, len(owner))).astype(np.uint16)
            run_bucket, run_owner = bucket[run_at], owner[run_at]
            first = np.flatnonzero(np.concatenate([[True], run_bucket[1:] != run_bucket[:-1]]))
            blobs = []
            for a, b in zip(first, np.append(first[1:], len(run_bucket)), strict=True):
                x, y = run_at[a], run_at[b] if b < len(run_at) else len(low)
                blobs.append(b"".join([np.uint32(b - a).tobytes(), ids[run_owner[a:b]].tobytes(), count[a:b].tobytes(), (low[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (low[x:y] >> np.uint64(32)).astype(np.uint16).tobytes()]))
            which = run_bucket[first].astype(np.int64)
            k = len(which)
            yield pa.RecordBatch.from_arrays([pa.array((which % partitions).astype(np.int32)), pa.array(which), pa.nulls(k, doc_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records, how many tokens of each follow, and the tokens."""
    k = int(np.frombuffer(blob, np.uint32, 1)[0])
    ids, count = np.frombuffer(blob, np.int64, k, 4), np.frombuffer(blob, np.uint16, k, 4 + 8 * k).astype(np.int64)
    total, at = int(count.sum()), 4 + 10 * k
    low = np.frombuffer(blob, np.uint32, total, at).astype(np.uint64) | (np.frombuffer(blob, np.uint16, total, at + 4 * total).astype(np.uint64) << np.uint64(32))
    return ids, count, low


def _shared_tokens(bits: int, doc_type: pa.DataType):
    """Per bucket: tokens that several records have, as rows (rec, n, tokens, how many records have each); ``part`` is
    the next partition, by record or, for membership rows, any.
    """
    names = ["part", "doc_id", "rec", "n", "tokens", "dfs"]

    def by_record(rec: np.ndarray) -> pa.Array:
        return pa.array(((rec ^ (rec >> 32)) & 0x7FFFFFFF).astype(np.int32))

    def bucket_rows(bucket: int, blobs: list[bytes]) -> pa.RecordBatch | None:
        parts = [_unpack(b) for b in blobs]
        ids, first, run = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        count, low = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        # a record that several workers met is taken from the first of their blobs
        blob = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        keep = np.repeat(blob == blob[first][run], count)
        owner, low = np.repeat(run.astype(np.int32), count)[keep], low[keep]
        del parts, blob, keep
        order = np.argsort(low, kind="stable")
        owner, low = owner[order], low[order]
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(start, len(low))).astype(np.int32)
        df = np.repeat(size, size)
        shared = df > 1
        if not shared.any():
            return None
        owner, low, df = owner[shared], low[shared], df[shared]
        order = np.argsort(owner, kind="stable")
        owner, low, df = owner[order], low[order], df[order]
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        token = ((np.uint64(bucket) << np.uint64(64 - bits)) if bits else np.uint64(0)) | low
        k = len(at)
        return pa.RecordBatch.from_arrays([by_record(ids[owner[at]]), pa.nulls(k, doc_type), pa.array(ids[owner[at]]), pa.nulls(k, pa.int32()), _list_column(token.view(np.int64), at, pa.int64()), _list_column(df.astype(np.int32), at, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            rows = batch.filter(pa.array(buckets == -1))
            if k := rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("doc_id"), rows.column("rec"), rows.column("n"), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))], names=names)
            rows = batch.filter(pa.array(buckets == -2))
            if k := rows.num_rows:
                often = [np.frombuffer(x.as_py(), np.int64) for x in rows.column("blob")]
                count = np.array([len(x) for x in often], np.int64)
                lists = [_list_column(x, np.cumsum(count) - count, t) for x, t in ((np.concatenate(often), pa.int64()), (np.full(int(count.sum()), MANY, np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays([by_record(rows.column("rec").to_numpy()), rows.column("doc_id"), rows.column("rec"), rows.column("n"), *lists], names=names)
            for i in np.flatnonzero(buckets >= 0):
                if buckets[i] != now and blobs:
                    if (out := bucket_rows(now, blobs)) is not None:
                        yield out
                    blobs = []
                now = int(buckets[i])
                blobs.append(batch.column("blob")[int(i)].as_py())
        if blobs and (out := bucket_rows(now, blobs)) is not None:
            yield out

    return run


def _active_records(doc_type: pa.DataType):
    """Per record: its shared tokens, rarest first, and how many of them stand in its prefix; only records that have any.

    Membership rows pass through.
    """
    names = ["doc_id", "rec", "n", "prefix", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs, sizes, tokens, dfs = [], [], [], []
        for batch in batches:
            member = batch.column("tokens").is_null()
            rows = batch.filter(member)
            if rows.num_rows:
                k = rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("rec"), rows.column("n"), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64()))], names=names)
            rest = batch.filter(pc.invert(member))
            if rest.num_rows:
                lists = rest.column("tokens")
                length = lists.value_lengths().to_numpy()
                rec, n = rest.column("rec").to_numpy(), rest.column("n")
                recs.append(np.repeat(rec, length))
                sized = n.is_valid().to_numpy(zero_copy_only=False)
                sizes.append(np.stack([rec[sized], n.drop_null().to_numpy()]))
                tokens.append(lists.flatten().to_numpy())
                dfs.append(rest.column("dfs").flatten().to_numpy())
        if not recs:
            return
        rec, token, df = (np.concatenate(x) for x in (recs, tokens, dfs))
        if not len(rec):
            return
        order = np.lexsort((token, df, rec))
        rec, token = rec[order], token[order]
        once = np.concatenate([[True], (rec[1:] != rec[:-1]) | (token[1:] != token[:-1])])  # hot ones may come from several tasks
        rec, token = rec[once], token[once]
        at = np.flatnonzero(np.concatenate([[True], rec[1:] != rec[:-1]]))
        size = np.concatenate(sizes, axis=1)
        size = size[:, np.argsort(size[0], kind="stable")]
        length, n = np.diff(np.append(at, len(rec))), size[1][np.searchsorted(size[0], rec[at])].astype(np.int64)
        prefix = length - least_overlap(n) + 1
        active = prefix > 0
        keep = np.repeat(active, length)
        token, length = token[keep], length[active]
        k = int(active.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(k, doc_type), pa.array(rec[at][active]), pa.array(n[active].astype(np.int32)), pa.array(prefix[active].astype(np.int32)), _list_column(token, np.concatenate([[0], np.cumsum(length)[:-1]]) if k else np.empty(0, np.int64), pa.int64())], names=names)

    return run


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rec, n, tokens, label) sorted by block, to (rec, root)."""
    held: list[tuple[np.ndarray, ...]] = []
    now = None

    def done() -> pa.RecordBatch:
        ids, sizes, labels, lengths, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        roots = link_records(ids, sizes.astype(np.int64), lengths.astype(np.int64), flat, labels)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block, rec, n, label = (batch.column(c).to_numpy() for c in ("block", "rec", "n", "label"))
        lists = batch.column("tokens")
        lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        ends = np.cumsum(lengths)
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for a, b in zip(edge, np.append(edge[1:], len(block)), strict=True):
            if block[a] != now and held:
                yield done()
                held = []
            now = block[a]
            held.append((rec[a:b], n[a:b], label[a:b], lengths[a:b], flat[ends[a] - lengths[a] : ends[b - 1]]))
    if held:
        yield done()


def _pivot_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (block, salt), pivots first: label each record with the first pivot that it links to, else with itself."""
    now, pivots = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        block, salt, kind, rec, n = (batch.column(c).to_numpy() for c in ("block", "salt", "kind", "rec", "n"))
        lists = batch.column("tokens")
        lengths, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        ends, labels = np.cumsum(lengths), rec.copy()
        edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])]))
        for a, b in zip(edge, np.append(edge[1:], len(block)), strict=True):
            if (block[a], salt[a]) != now:
                now, pivots = (block[a], salt[a]), []
            few = int((kind[a:b] == 0).sum())
            pivots += [(rec[i], n[i], np.sort(flat[ends[i] - lengths[i] : ends[i]])) for i in range(a, a + few)]
            rows = np.arange(a + few, b)
            rows = rows[lengths[rows] > 0]
            if not len(rows):
                continue
            own, starts = flat[_ranges(ends[rows] - lengths[rows], lengths[rows])], np.cumsum(lengths[rows]) - lengths[rows]
            found = np.zeros(len(rows), bool)
            for name, m, tokens in pivots:
                hit = tokens[np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)] == own
                near = linked(np.add.reduceat(hit, starts, dtype=np.int64), n[rows].astype(np.int64), int(m)) & ~found
                labels[rows[near]] = name
                found |= near
        rows = pa.array(np.flatnonzero(kind == 1))
        out = batch.take(rows)
        yield pa.RecordBatch.from_arrays([out.column("block"), out.column("rec"), out.column("n"), out.column("tokens"), pa.array(labels).take(rows)], names=["block", "rec", "n", "tokens", "label"])


def _chunk_pairs(large: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Blocks too large for a task, as many blocks of two chunks each that together hold every pair that may matter.

    Records that link to one of a block's pivots carry the pivot's label and are joined from the start. Chunks hold
    records of one label, or of many small ones; two chunks meet unless both hold the same single label. So a block that
    is one big group of near copies costs a few passes over it, not the square of its chunks.
    """
    spread = F.ceil(F.col("s") / F.lit(limit)).cast("int")
    rows = large.withColumn("parts", spread)
    few = rows.withColumn("r", F.row_number().over(_by_block())).where(F.col("r") <= PIVOTS)
    # a block's rows are dealt to several tasks, and its pivots go to each of them, ahead of the rows
    first = few.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), "rec", "n", "tokens")
    dealt = rows.select("block", F.pmod(F.xxhash64("rec"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "rec", "n", "tokens").unionAll(first)
    labelled = cut(dealt.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "rec").mapInArrow(lean(_pivot_label), "block long, rec long, n int, tokens array<long>, label long"))
    half = limit // 2
    sizes = labelled.groupBy("block", "label").agg(F.sum(F.size("tokens").cast("long")).alias("s"))
    group = sizes.withColumn("g", F.when(F.col("s") > half // 4, F.col("label")))
    parts = group.groupBy("block", "g").agg(F.ceil(F.sum("s") / F.lit(half // 2)).cast("int").alias("parts"))
    chunk_key = [F.col("block"), F.col("g"), F.col("part")]
    chunks = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*chunk_key)
    a, b = (chunks.select("block", F.col("g").alias(f"g{k}"), F.col("part").alias(f"part{k}"), F.struct(F.coalesce(F.col("g"), F.lit(0)).alias("x"), F.col("g").isNull().alias("z"), F.col("part").alias("y")).alias(f"k{k}")) for k in (1, 2))
    meet = a.join(b, "block").where((F.col("k1") < F.col("k2")) & ~F.coalesce(F.col("g1") == F.col("g2"), F.lit(False)) | (F.col("k1") == F.col("k2")) & F.col("g1").isNull())
    meet = cut(meet.select("block", "g1", "part1", "g2", "part2").withColumn("pair", F.monotonically_increasing_id()))
    ends = meet.select("block", F.col("g1").alias("g"), F.col("part1").alias("part"), "pair").unionAll(meet.select("block", F.col("g2").alias("g"), F.col("part2").alias("part"), "pair")).distinct()
    placed = labelled.join(group.select("block", "label", "g"), ["block", "label"]).join(parts.select(F.col("block").alias("pb"), F.col("g").alias("pg"), "parts"), (F.col("block") == F.col("pb")) & F.col("g").eqNullSafe(F.col("pg")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rec"), F.col("parts")).cast("int"))
    met = placed.alias("p").join(ends.alias("e"), (F.col("p.block") == F.col("e.block")) & F.col("p.g").eqNullSafe(F.col("e.g")) & (F.col("p.part") == F.col("e.part")))
    pairs = met.select(F.col("e.pair").alias("block"), "p.rec", "p.n", "p.tokens", "p.label")
    return pairs, labelled.select(F.col("rec").alias("u"), F.col("label").alias("v"))


def _by_block():
    return Window.partitionBy("block").orderBy(F.xxhash64("rec"))


def _stars(prefix: DataFrame, hot: np.ndarray) -> DataFrame:
    """Links (u, v) that join all records of (rec, token) that share a token: each to the least record of the token.

    The rows of a hot token are dealt to SALTS groups, each with a least record of its own, and those are joined.
    """
    often = prefix.sparkSession.createDataFrame([(int(t),) for t in hot.view(np.int64)], "hot long")
    dealt = prefix.join(F.broadcast(often), F.col("token") == F.col("hot"), "left").select("rec", "token", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("rec"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.col("hot").isNotNull().alias("often"))
    least = dealt.groupBy("token", "salt", "often").agg(F.min("rec").alias("root"), F.count("*").alias("df")).where((F.col("df") > 1) | F.col("often"))
    links = dealt.select("rec", "token", "salt").join(least.select("token", "salt", "root"), ["token", "salt"]).select(F.col("rec").alias("u"), F.col("root").alias("v"))
    if len(hot):
        heads = least.where("often")
        lowest = heads.groupBy("token").agg(F.min("root").alias("v"))
        links = links.unionAll(heads.join(lowest, "token").select(F.col("root").alias("u"), "v"))
    return links.distinct()


def jaccard_components(docs: DataFrame, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: components of links of Jaccard similarity 3/4 or more.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case; a document's set is its distinct
    shingles of ``width`` words, or its whole sequence if that is shorter. Equal sets are one record. Tokens are dealt
    into buckets once to count how many records have each; only tokens that two records share can add to an overlap, so
    records whose shared tokens are too few drop out exactly. The rest are ordered by rarity; any two that link share a
    token of their prefixes, so components over shared prefix tokens hold all links inside them. Each such block is
    searched by ``link_records``: a few pivots, then ``Block.search`` among what they leave. Blocks of more than
    ``block_tokens`` tokens are first labelled by pivots over several tasks and then searched in chunks. Tokens that a
    large share of the records has are not dealt by token but stay with their records, last in the order of rarity.

    Defined cases: null, empty and blank texts have no shingles and are their own component; repeated rows link as copies
    do; a null doc_id is reported, and never names a component that has another id; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    bits = min(24, max(3, math.ceil(math.log2(max(1, held["b"] / BUCKET_BYTES)))))
    partitions = min(MOST_PARTITIONS, 1 << bits)
    hot = hot_tokens(docs, held["n"], width)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(StructType.fromDDL(f"doc_id {id_type}")["doc_id"].dataType)
    tokens = docs.select("doc_id", "text").mapInArrow(lean(_token_rows(bits, partitions, spark.sparkContext.broadcast(hot), arrow, width)), f"part int, bucket long, doc_id {id_type}, rec long, n int, blob binary")
    shared = tokens.repartitionById(partitions, "part").sortWithinPartitions("bucket").mapInArrow(lean(_shared_tokens(bits, arrow)), f"part int, doc_id {id_type}, rec long, n int, tokens array<long>, dfs array<int>")
    by_record = shared.repartitionById(partitions, "part").select("doc_id", "rec", "n", "tokens", "dfs").mapInArrow(lean(_active_records(arrow)), f"doc_id {id_type}, rec long, n int, prefix int, tokens array<long>")
    table = cut(by_record)
    members = table.where(F.col("tokens").isNull()).select("doc_id", "rec", "n")
    active = table.where(F.col("tokens").isNotNull()).select("rec", "n", "prefix", "tokens")

    prefix = active.select("rec", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token"))
    candidates = components(_stars(prefix, hot))
    blocks = cut(active.select("rec", "n", "tokens").join(candidates.select(F.col("node").alias("rec"), F.col("root").alias("block")), "rec").select("block", "rec", "n", "tokens"))
    weight = blocks.groupBy("block").agg(F.sum(F.size("tokens").cast("long")).alias("s"))
    total = weight.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.max("s"), F.lit(0)).alias("m")).first()
    few = max(1, min(MOST_PARTITIONS, math.ceil(total["s"] / (block_tokens / 16))))
    found = blocks.withColumn("label", F.col("rec"))
    given = None
    if total["m"] > block_tokens:
        sized = blocks.join(weight, "block")
        pairs, given = _chunk_pairs(sized.where(F.col("s") > block_tokens), block_tokens)
        found = sized.where(F.col("s") <= block_tokens).select("block", "rec", "n", "tokens", F.col("rec").alias("label")).withColumn("kind", F.lit(0)).unionAll(pairs.withColumn("kind", F.lit(1)))
        found = found.withColumn("block", F.xxhash64("kind", "block")).drop("kind")
    links = found.repartition(few, "block").sortWithinPartitions("block", "rec").mapInArrow(lean(_block_rows), "u long, v long")
    roots = links if given is None else components(links.unionAll(given)).select(F.col("node").alias("u"), F.col("root").alias("v"))
    # names are found by distinct record, and joined from a written table, so that a join may split a group's rows
    grouped = cut(members.join(roots, members["rec"] == roots["u"], "left").select("doc_id", "n", F.coalesce("v", "rec").alias("g")))
    named = cut(grouped.where(F.col("g").isNotNull()).groupBy("g").agg(F.min("doc_id").alias("component_id")))
    out = grouped.join(named, "g", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
