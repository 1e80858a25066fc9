"""Harmonic packing of token sequences.

Lengths are parted into classes by reciprocals of the capacity C: class k holds pieces of
length in (C / (k + 1), C / k], and k of them fill one bin, whatever their exact lengths.
Every task fills its own bins; no worker waits for another and nothing is shuffled.
A document is cut so that its pieces sit close to the upper end of their class: whole
bins first, then powers of two while the rest would waste more than ``WASTE`` of a bin.
Bins that a task leaves open are closed by joining their pieces into one line of ids,
which is cut into full sequences and a last one cut at powers of two, which need no padding.

Defined results: a null text is empty and yields its end id alone; a null doc_id is kept;
repeated rows are packed as separate documents; an empty table gives no pieces; columns
other than doc_id and text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CAPACITY = 2048
END_ID = 1
WASTE = 0.02

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, class int")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("class", pa.int32())])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_character() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: printable ones of Latin-1 as themselves, the
    others, in order, as the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*zip(plain, plain), *zip(range(256, 256 + len(rest)), rest)]}


class Encoder:
    """Ids of a byte-level BPE tokenizer file as little-endian 32-bit bytes.  Added tokens (as
    ``<|endoftext|>``) are ids of their own wherever they stand, as the file says."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = byte_of_character()
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
        self._encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> bytes:
        return self._encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()


def cuts(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of a document's pieces, in order; their sum is ``n``."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        unused = capacity - (capacity // n) * n
        piece = n if unused <= waste * capacity else 1 << (n.bit_length() - 1)
        out.append(piece)
        n -= piece
    return out


class Bins:
    """The open bins of one task, one a class, and the pieces placed so far."""

    def __init__(self, task: int, capacity: int):
        self.capacity = capacity
        self.next = task << 40
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], k: int) -> None:
        """pieces: (doc_id, start, ids, doc_tokens) of one sequence."""
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, k))
            at += n
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        k = self.capacity // (len(ids) // 4)
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, start, ids, total))
        if len(bin_) == k:
            self.emit(self.open.pop(k), k)

    def close(self) -> None:
        """Join the pieces of the bins still open (at most one bin a class) and cut the line."""
        line = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in line)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = line[0]
                n = len(ids) // 4
                take = min(n, room)
                pieces.append((doc, start, ids[:4 * take], total))
                if take == n:
                    line.pop(0)
                else:
                    line[0] = (doc, start + take, ids[4 * take:], total)
                room -= take
            self.emit(pieces, 0)

    def take_rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


_ENCODERS: dict[str, Encoder] = {}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it comes from and where it lies.  ``path`` names a
    tokenizer file that executors can read (by default that of the installed public tokenizers)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = path or tokenizer_path()
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(name)
        encode = _ENCODERS[name]
        end = end_id.to_bytes(4, "little")
        bins = Bins(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                for n in cuts(total, capacity):
                    bins.add(doc, start, ids[4 * start:4 * (start + n)], total)
                    start += n
                if len(bins.rows) >= 20_000:
                    yield bins.take_rows()
        bins.close()
        yield bins.take_rows()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tasks, SCHEMA)
