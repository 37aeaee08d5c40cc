"""Lempel-Ziv phrase fingerprints: bottom-k minimum-hash signatures of each document's set of dictionary phrases."""

from __future__ import annotations

import gc
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from colscope.llm.common import lean
from colscope.llm.sharding import number_rows

#: Hashes kept in a signature; text bytes a bucket of neighbours holds on average, and most buckets.
KEPT, BUCKET_BYTES, MOST_BUCKETS = 128, 12 << 20, 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return self.up, self.down


def _extend(text: str, at: int, node: dict, root: dict, ends: list[int], log: list | None = None) -> dict:
    """Parse ``text`` from ``at`` on, in the dictionary node reached so far; append where new phrases end."""
    for i, c in enumerate(text[at:] if at else text, at + 1):
        below = node.get(c)
        if below is None:
            node[c] = {}
            if log is not None:
                log.append((node, c))
            ends.append(i)
            node = root
        else:
            node = below
    return node


def signature(text: str, ends: list[int], powers: Powers) -> np.ndarray:
    """The KEPT lowest 32-bit hashes of the phrases that end at ``ends``, ascending."""
    if not ends:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = powers.upto(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    e = np.array(ends, np.int64)
    s = np.concatenate([[0], e[:-1]])
    h = (sums[e] - sums[s]) * down[s]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    low = (h >> np.uint64(32)).astype(np.uint32)
    if len(low) > 2 * KEPT:
        low = np.partition(low, 2 * KEPT)[: 2 * KEPT + 1]
    return np.unique(low)[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two phrase sets; exact for sets of up to KEPT phrases. No phrases: 1 if both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    lowest = np.union1d(a, b)[:KEPT]
    return float((np.isin(lowest, a) & np.isin(lowest, b)).sum() / len(lowest))


def lz_phrases(text: str) -> list[int]:
    """Ends of the phrases of a text's LZ78 parse: each is the shortest that is not in the dictionary yet."""
    ends: list[int] = []
    root: dict = {}
    _extend(text, 0, root, root, ends)
    return ends


def fork(text: str, keep: int, tail: str) -> tuple[list[int], list[int]]:
    """Phrase ends of ``text`` and of ``text[:keep] + tail``, whose common start is parsed once."""
    ends: list[int] = []
    root: dict = {}
    node = _extend(text[:keep], 0, root, root, ends)
    edited, log = list(ends), []
    _extend(text[:keep] + tail, keep, node, root, edited, log)
    for parent, c in log:
        parent.pop(c, None)
    _extend(text, keep, node, root, ends)
    return ends, edited


def hex_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def _key(doc_id, th: int) -> tuple:
    return (doc_id is not None, doc_id, th)


def _routes(tops: list[tuple]):
    """Rows to the bucket of their key, equal rows of a batch as one with their number; the top key of a bucket also goes
    to the bucket above it, as a ghost of the row that comes next there.
    """
    where = {key: b for b, key in enumerate(tops)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(map(_key, batch.column("doc_id").to_pylist(), batch.column("th").to_pylist())):
                rows.setdefault(key, [i, 0])[1] += 1
            out = [(bisect_left(tops, key), False, i, n) for key, (i, n) in rows.items()]
            out += [((where[key] + 1) % len(tops), True, i, 1) for key, (i, _) in rows.items() if key in where]
            part, ghost, at, n = zip(*out, strict=True) if out else [()] * 4
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ghost, pa.bool_()), batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(n, pa.int64()), batch.column("text").take(at)], names=["part", "ghost", "doc_id", "th", "n", "text"])

    return run


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (part, ghost, doc_id, th, n, text) in descending order of (doc_id, th), th being a hash of the text: cut into
    buckets of nearly equal counts of distinct keys, each followed by a ghost of the row that comes next.

    Keys are range-sorted and numbered without their texts; only the top key of each bucket passes through the driver.
    The texts are shuffled once, equal rows of an Arrow batch as one row with their number, so neither many rows of one id
    nor many copies of one row fall to one task.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    numbered, total = number_rows(keyed.select("doc_id", "th").distinct(), ["doc_id", "th"], nulls_first=True)
    step = max(1, -(-total // buckets))
    heads = numbered.where((F.pmod(F.col("row") + 1, F.lit(step)) == 0) | (F.col("row") == total - 1)).select("doc_id", "th", "row").collect()
    tops = [_key(r["doc_id"], r["th"]) for r in sorted(heads, key=lambda r: r["row"])]
    schema = f"part int, ghost boolean, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, text string"
    routed = keyed.mapInArrow(lean(_routes(tops)), schema)
    return routed.repartitionById(max(1, len(tops)), "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), F.desc("th"))


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, whose last third is replaced by the start of the next document.

    Next means next in descending doc_id; after the last comes the first. A fingerprint is the hex of the KEPT lowest
    hashes of the text's LZ78 phrases, so equal texts have equal ones. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. doc_id may be of any type that has an order.

    Defined cases: null text counts as empty; an empty text has an empty fingerprint, alike to empty ones only; null
    doc_ids come last; rows of equal doc_id follow one another by descending xxhash64 of the text; one row alone is its own
    next; an empty table gives no rows; other columns are ignored.
    """
    if buckets is None:
        weight = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
        buckets = min(MOST_BUCKETS, max(8, math.ceil(weight / BUCKET_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = _Chain()
        gc.disable()  # the dictionaries form trees; counting references frees them
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "ghost", "doc_id", "th", "n", "text")]
            out = [row for i in range(batch.num_rows) for row in chain.take(*(c[i].as_py() for c in columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)
        gc.enable()

    schema = docs.select("doc_id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)
    names, kinds = schema.names, to_arrow_schema(schema).types
    return with_next(docs, buckets).mapInArrow(lean(run), schema)


class _Chain:
    """Rows in order, each finished when the next text and its fingerprint are known; equal rows are one with a number."""

    def __init__(self) -> None:
        self.powers, self.part, self.held, self.pending = Powers(), None, None, None

    def _close(self, sig: np.ndarray) -> list[tuple]:
        done, self.pending = self.pending, None
        return [(*done[0], likeness(done[1], sig))] if done else []

    def _edited(self, doc_id, own: str, after: str) -> tuple[tuple, np.ndarray]:
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        ends, edited_ends = fork(own, len(own) - third, after[:third])
        sig, edited_sig = signature(own, ends, self.powers), signature(edited, edited_ends, self.powers)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(own), digest, hex_of(sig), hex_of(edited_sig), likeness(sig, edited_sig)), sig

    def take(self, part: int, ghost: bool, doc_id, th: int, n: int, text: str | None) -> list[tuple]:
        text, out = text or "", []
        if self.held is not None and self.part == part:
            own_id, own_th, own, copies = self.held
            if not ghost and (own_id, own_th) == (doc_id, th):
                self.held = (own_id, own_th, own, copies + n)
                return out
            row, sig = self._edited(own_id, own, text)
            out = self._close(sig)
            if copies > 1:  # each but the last is followed by its like
                out += [(*self._edited(own_id, own, own)[0], 1.0)] * (copies - 1)
            self.pending = (row, sig)
            if ghost:
                out += self._close(signature(text, lz_phrases(text), self.powers))
        self.part, self.held = part, None if ghost else (doc_id, th, text, n)
        return out
