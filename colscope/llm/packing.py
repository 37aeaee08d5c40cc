"""Best-fit packing of tokenized documents into fixed-length sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from colscope.llm.common import cut
from colscope.llm.sharding import number_rows

LENGTH, END_ID, REMEMBERED = 4096, 1, 150_000
#: Texts without these have one code point per lower-case letter, no composition, and Python's white space is Unicode's.
_UNUSUAL = re.compile("[\x1c-\x1fİɐ-\U0010ffff]|<\\|")
#: Letters and then marks are two words to the tokenizer.
_MARKED = re.compile(r"(.*[^\W\d_])([,.;:!?$%&#*|]+)")
#: Unicode White_Space, at which the tokenizer splits.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def _byte_letters() -> dict[int, int]:
    """How a byte-level vocabulary writes bytes: printable Latin-1 as it is, the rest in order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 0x100 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit numbers, remembered for the commonest words of late.

    The tokenizer never merges across white space, so a text's ids are those of its words one after another; a word of
    letters only is one piece of its split and goes to its merge model directly, the others through all its steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            for key in list(self)[: REMEMBERED // 2]:
                del self[key]
        if word.isalpha():
            written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.merges.tokenize(written)]
            ids = struct.pack(f"<{len(found)}I", *found)
        elif (marked := _MARKED.fullmatch(word)) and marked[1].isalpha():
            ids = self[marked[1]] + self[marked[2]]
        else:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if _UNUSUAL.search(text) is not None:
            return b"".join([self.encode(w) for w in _SPACE.split(text) if w])
        return b"".join(map(self.__getitem__, text.lower().split()))


def pieces(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """(start, length, ids) of each piece; only what is longer than ``length`` is cut."""
    return [(at // 4, len(part) // 4, part) for at in range(0, len(ids), 4 * length) if (part := ids[at : at + 4 * length])]


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids if wanted) of every document's ids followed by the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column("text")
            for i in range(batch.num_rows):
                out += [(i, k, start, n, zlib.crc32(part), part) for k, (start, n, part) in enumerate(pieces(words.ids(texts[i].as_py() or "") + end, length))]
            col = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [batch.column("doc_id").take(pa.array(col[0], pa.int64())), pa.array(col[1], pa.int32()), *[pa.array(c, pa.int64()) for c in col[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in col[5]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("ids", ArrayType(IntegerType())) if with_ids else schema)


@dataclass
class Plan:
    """Runs of equal placements: the pieces of a length with ranks from ``rank`` on go to sequences from ``sequence`` on."""

    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 40) | rank, side="right") - 1
        return self.sequence[at] + rank - (self.keys[at] & ((1 << 40) - 1)), self.offset[at]


def match(counts: dict[int, int], length: int = LENGTH) -> Plan:
    """Best fit in bulk-synchronous rounds over range-sorted sizes.

    Pieces of one length are alike and so are gaps of one size, so both sides are runs of equals: at most ``length``
    distinct sizes each, however many documents there are. A round takes the next lower length, whose pieces all bid at
    once for their successor, the smallest gap that holds them. Bids beyond the number of such gaps lose by rank and go
    to the next gap size of the sweep; those beyond the last gap open sequences. Then the used gaps shrink, are put back
    in order, and the next round starts.
    """
    sizes: list[int] = []
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    runs: list[tuple[int, int, int]] = []
    opened = 0

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(sizes, size)
            if at == len(sizes):
                fits = length // size
                first, n = opened, -(-left // fits)
                opened += n
                put(length, first, n)
                continue
            gap = sizes[at]
            first, n = gaps[gap].popleft()
            if not gaps[gap]:
                sizes.pop(at)
            won = min(n, left)
            runs.append(((size << 40) | rank, first, length - gap))
            put(gap, first + won, n - won)
            put(gap - size, first, won)
            rank, left = rank + won, left - won
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 3)
    return Plan(cols[:, 0].copy(), cols[:, 1].copy(), cols[:, 2].copy(), opened)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pack all documents: a row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Pieces are range-sorted by length on the executors and numbered; the histogram of lengths (at most ``length`` rows)
    goes to the driver, ``match`` runs its rounds over it, and its runs place every piece by its rank within its length.

    Defined cases: null and empty texts are one piece that holds the end id alone; repeated rows are packed each; null
    doc_ids are kept; an empty table gives no rows; other columns are ignored.
    """
    made = tokenized_pieces(docs, tokenizer, length, with_ids)
    slim = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        made = cut(made.withColumn("_key", F.monotonically_increasing_id()))
    rows, _ = number_rows(made.select(*slim, *(["_key"] if with_ids else [])), ["length", "doc_id", "piece", "ids_crc32"])
    histogram = {int(r["length"]): (int(r["n"]), int(r["first"])) for r in rows.groupBy("length").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(match({size: n for size, (n, _) in histogram.items()}, length))
    first = np.zeros(length + 1, np.int64)
    for size, (_, row) in histogram.items():
        first[size] = row

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, row: pd.Series) -> pd.DataFrame:
        n = size.to_numpy()
        sequence, offset = plan.value.place(n, row.to_numpy() - first[n])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = rows.withColumn("_p", place("length", "row")).select(*slim, "_p.sequence_id", "_p.offset", *(["_key"] if with_ids else []))
    return placed.join(made.select("_key", "ids"), "_key").drop("_key") if with_ids else placed
