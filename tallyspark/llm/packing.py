"""Packing documents into training sequences by the sum-of-squares rule.

Each task tokenises its documents as they come and packs them online. A document fills whole
windows first; what is left over is an item. An array counts the partly filled windows of each
fill level, and the item goes to the level (or to a new window) that makes the sum of the squared
counts least, which keeps any one level from piling up. Windows that stay partly filled are closed
by cutting: the emptiest fill up the fullest, and the last one is cut into powers of two. So no
sequence is padded, most documents stay whole, no row is shuffled, and a task holds no more than
a fixed number of open windows.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
#: Windows that a task holds partly filled before it closes them by cutting.
MOST_OPEN = 4096
#: Id after every document.
END = 1
#: Characters that are tokenised at once, about.
_BLOCK = 1 << 20
#: No token spans such a place, whatever stands around it.
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Fixed value: the vocabulary's own pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A run of blanks that the fast encoder's pattern may not get through.
_LONG_BLANK = re.compile(r"\s{4096}")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """The byte-level BPE of a tokenizer file; its ids are the order of its merges, so they serve as ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    # a byte-level vocabulary writes printable bytes as they are and the others from code point 256 on
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in word): i for word, i in words.items()}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _plain_encoder(path: str):
    """The file's own library: slower, and without a limit on runs of blanks."""
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """``text`` in pieces that tokenise alone as they do together; one without seams stays whole."""
    at = 0
    while len(text) - at > size and (seam := _SEAM.search(text, at + size)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of the whole text (null: none), special tokens' names being ordinary text, then ``END``."""

    def encode(block: str) -> list[int]:
        if len(block) >= 4096 and _LONG_BLANK.search(block):
            return _plain_encoder(path).encode(block, add_special_tokens=False).ids
        return _encoder(path).encode_ordinary(block)

    return np.concatenate([*(np.array(encode(b), "<u4") for b in blocks(text or "")), np.array([END], "<u4")])


class Packer:
    """Open windows by fill level. A piece is (document, start, ids); a closed window gets a number."""

    def __init__(self, size: int = SIZE, most_open: int = MOST_OPEN):
        self.size, self.most_open, self.closed = size, most_open, 0
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]
        self.open = 0
        self.out: list[tuple] = []

    def close(self, window: list) -> None:
        offset = 0
        for document, start, ids in window:
            self.out.append((document, start, ids, self.closed, offset))
            offset += len(ids)
        self.closed += 1

    def level(self, n: int) -> int:
        """The level that an item of ``n`` joins, 0 for a new window; the fullest of equally good ones."""
        now, then = self.counts[1 : self.size - n + 1], self.counts[n + 1 :]
        if not len(now):
            return 0
        change = 2 * (then - now) + 2  # one window fewer here, one more there
        change[-1] -= 1  # a full window is counted nowhere
        change[now == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(change[::-1].argmin())
        return best + 1 if change[best] <= 2 * self.counts[n] + 1 else 0

    def add(self, document, ids: np.ndarray) -> None:
        rest = len(ids) % self.size
        for start in range(0, len(ids) - rest, self.size):
            self.close([(document, start, ids[start : start + self.size])])
        if not rest:
            return
        level = self.level(rest)
        window = self.windows[level].pop() if level else []
        self.counts[level] -= level > 0
        self.open -= level > 0
        window.append((document, len(ids) - rest, ids[len(ids) - rest :]))
        if level + rest == self.size:
            self.close(window)
            return
        self.windows[level + rest].append(window)
        self.counts[level + rest] += 1
        self.open += 1
        if self.open > self.most_open:
            self.settle()

    @staticmethod
    def moved(giver: list, n: int) -> list:
        """The last ``n`` ids of a window, its last piece being cut where they begin."""
        out = []
        while n:
            document, start, ids = giver.pop()
            if len(ids) > n:
                giver.append((document, start, ids[: len(ids) - n]))
                start, ids = start + len(ids) - n, ids[len(ids) - n :]
            out.append((document, start, ids))
            n -= len(ids)
        return out

    def settle(self, end: bool = False) -> None:
        """The emptiest windows fill up the fullest. At the end powers of two stay, and the last window becomes such."""
        rest = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.windows[level]]
        self.windows = [[] for _ in range(self.size)]
        self.counts[:] = 0
        self.open = 0
        if end:
            for level, window in rest:
                if level & (level - 1) == 0:
                    self.close(window)
            rest = [(level, w) for level, w in rest if level & (level - 1)]
        left = {i: level for i, (level, _) in enumerate(rest)}
        first, last = 0, len(rest) - 1
        while first < last:
            need = min(self.size - left[first], left[last])
            rest[first][1].extend(self.moved(rest[last][1], need))
            left[first] += need
            left[last] -= need
            if left[first] == self.size:
                self.close(rest[first][1])
                first += 1
            if not left[last]:
                last -= 1
        if first == last:
            level, window = left[first], rest[first][1]
            if not end:
                self.windows[level] = [window]
                self.counts[level] = self.open = 1
                return
            while level:
                part = 1 << (level.bit_length() - 1)
                self.close(self.moved(window, part))
                level -= part

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, most_open: int = MOST_OPEN) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit numbers; ``path`` is a byte-level BPE tokenizer file
    that every executor can read. A null or empty text is its end alone. Rows of one doc_id, or
    without one, are documents of their own. Other columns are not read. An empty table gives an
    empty result. Sequences belong to a partition of ``docs`` and follow the order of its rows, so
    a task that runs again makes them again if that order is fixed, as it is in a scan; write what
    comes from a shuffle first.
    """
    path = path or vocabulary()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(size, most_open), TaskContext.get().partitionId() << 40
        kind = None

        def rows() -> pa.RecordBatch:
            pieces = packer.taken()
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([p[0][0] for p in pieces], kind), "start": pa.array([p[1] for p in pieces], pa.int64()), "length": pa.array([len(p[2]) for p in pieces], pa.int64()),
                "ids": pa.array([p[2].tobytes() for p in pieces], pa.binary()), "doc_tokens": pa.array([p[0][1] for p in pieces], pa.int64()),
                "sequence_id": pa.array([base + p[3] for p in pieces], pa.int64()), "offset": pa.array([p[4] for p in pieces], pa.int64()),
            })

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = token_ids(text.as_py(), path)
                packer.add((doc_id, len(ids)), ids)
                if len(packer.out) >= 4096:
                    yield rows()
        packer.settle(end=True)
        if packer.out:
            yield rows()

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(packed, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def report(docs: DataFrame) -> DataFrame:
    """``pack``'s pieces with a checksum in place of their ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): each sequence's pieces joined, and padded to ``size`` unless a power of two long."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(size - F.col("n_tokens")).cast("int")
    padding = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), missing))
    return whole.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"))
