"""Repeated passages by suffix arrays over blocks of the corpus.

A repeat is a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id.

1. Every string of that length has an anchor of ``K`` bytes: its piece with the smallest hash, by its place
   modulo the anchor's places, says where. Consecutive strings with one anchor are a run, so a document
   is a few runs, and equal strings lie in runs with equal anchors. Anchors are dealt by hash;
   those that two different texts have are shared. An anchor is long, so few are shared by chance.
2. Only runs with a shared anchor go on, each with its bytes, dealt by anchor. What one task has seen
   twice is settled there: equal runs are sent once, so a passage that a third of all documents
   share is one row a task. Anchors that stand in more than a 100,000th of all runs are known to
   everyone (there are 100,000 at most), and their strings are dealt one by one.
3. A block sorts the suffixes of its distinct runs in two stages: those smaller than their
   successor are sorted directly, the rest are induced by scanning the buckets of first bytes.
   Common prefixes of neighbours give the groups of equal strings, and each group its first document.
4. What is removed goes back to the texts. Equal texts are one text until the last join.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, identity, stored

LENGTH = 50
#: Bytes of an anchor, by the places it can have in a string, and of the pieces whose hashes choose it.
K, T = 32, 13
W = LENGTH - K + 1
NO_ID = (1 << 63) - 1
#: Anchors or bytes of runs that a task gathers before it sends them on.
_FLUSH = 1_000_000
_CHUNK = 1 << 20
_BLOCK_BYTES = 8_000_000
_ROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_ROW_DDL = "bucket long, kind int, data binary"
_TEXT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("data", pa.binary())])
_TEXT_DDL = "h1 long, h2 long, data binary"
_PACK, _SHARED, _HOT, _GONE = 0, 1, 2, 3


def _loads(x: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one big-endian number."""
    return np.ndarray(shape=(max(0, len(x) - 7),), dtype=">u8", buffer=x, strides=(1,))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end -> start, end (of the run's strings' first bytes), text number, anchor hash.

    The bytes are taken by the megabyte, so that the arrays in between stay small; a run may be cut there.
    """
    parts = [_runs(data[a : a + _CHUNK + LENGTH - 1], a, offsets) for a in range(0, max(1, len(data) - LENGTH + 1), _CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(data: np.ndarray, at: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(data) - LENGTH + 1
    if n < 1:
        return none
    v = _loads(data).astype(np.uint64)
    m = len(data) - T + 1
    with np.errstate(over="ignore"):
        h = v[:m] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += v[T - 8 : T - 8 + m]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    step, best, span = 1, (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64), LENGTH - T + 1
    while step * 2 <= span:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[:n], best[span - step : span - step + n]).astype(np.uint32)
    best -= np.arange(n, dtype=np.uint32)
    best %= np.uint32(W)
    best += np.arange(n, dtype=np.uint32)
    low, high = np.searchsorted(offsets, [at, at + n], side="right")
    edges = np.concatenate([[at], offsets[low:high], [at + n]]).clip(at, at + n) - at
    texts = np.repeat(np.arange(low - 1, low + len(edges) - 2), np.diff(edges))
    sound = at + np.arange(n) + LENGTH <= offsets[1:][texts]
    new = sound.copy()
    new[1:] &= ~sound[:-1] | (best[1:] != best[:-1]) | (texts[1:] != texts[:-1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(sound & np.append(new[1:] | ~sound[1:], True)) + 1
    anchor, h = best[start], np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for skip in range(0, K, 8):
            h = (h ^ v[anchor + skip]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return at + start, at + stop, texts[start], h


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the text column and where each text starts."""
    text = batch.column("text")
    text = text.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")], axis=1)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000]), _ROW.types)], schema=_ROW)


def _by_home(ids: np.ndarray, owner: np.ndarray, values: np.ndarray, kind: int, buckets: int) -> list[tuple]:
    """Rows for the homes of the texts, buckets by id: numbers of values, ids and values of all texts there together."""
    if not len(owner):
        return []
    home = (ids[:, 0].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owner, home[owner]))
    owner, values = owner[order], values[order]
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes, texts = np.diff(np.append(heads, len(owner))), owner[heads]
    cuts = np.flatnonzero(np.append(True, np.diff(home[texts]) != 0))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(texts))):
        end = heads[b] if b < len(heads) else len(owner)
        packed = struct.pack("<I", b - a) + sizes[a:b].astype(np.uint32).tobytes() + ids[texts[a:b]].tobytes() + values[heads[a] : end].tobytes()
        rows.append((int(home[texts[a]]), kind, packed))
    return rows


def _at_home(item: int):
    """The packs of a home, values of ``item`` bytes -> (h1, h2, data), a row for each text."""

    def run(table: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[bytes]] = {}
        for data in table.column("data").to_pylist():
            (n,) = struct.unpack_from("<I", data)
            at = 4 + 20 * n
            for size, pair in zip(np.frombuffer(data, np.uint32, n, 4).tolist(), np.frombuffer(data, np.int64, 2 * n, 4 + 4 * n).reshape(n, 2).tolist()):
                found.setdefault(tuple(pair), []).append(data[at : at + size * item])
                at += size * item
        columns = [[k[0] for k in found], [k[1] for k in found], [b"".join(x) for x in found.values()]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _TEXT.types)], schema=_TEXT)

    return run


def _width(total: int) -> int:
    """Bytes of a hash by which anchors are told apart: a chance hit is one in 500 at most, and costs time only."""
    return min(8, -(-(total.bit_length() + 6) // 8))


def _anchors(buckets: int, width: int):
    """Texts -> for each bucket the anchors seen here, each once, with one of its texts; and what is shared already."""

    def flush(ids: list[np.ndarray], owners: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        ids_, owner, h = np.concatenate(ids), np.concatenate(owners), np.concatenate(hashes)
        # equal texts are one: number the distinct ids
        whole, owner = _distinct_ids(ids_, owner)
        h &= np.uint64((1 << 8 * width) - 1)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
        h, owner = h[keep], owner[keep]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(first, len(h)))
        both = np.repeat(count > 1, count)
        rows = _by_home(whole, owner[both], h[both], _SHARED, buckets)
        h, owner = h[first], owner[first]
        bucket = _dealt(h, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            part = order[a:b]
            used, local = np.unique(owner[part], return_inverse=True)
            more = np.flatnonzero(count[part] > 1)
            short = np.uint16 if len(used) < 1 << 16 else np.uint32
            packed = struct.pack("<III", len(part), len(used), len(more)) + h[part].view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + local.astype(short).tobytes() + whole[used].tobytes()
            packed += more.astype(np.uint32).tobytes() + count[part][more].astype(np.uint32).tobytes()
            rows.append((int(bucket[part[0]]), _PACK, packed))
        yield from _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owners, hashes, size, texts = [], [], [], 0, 0
        for batch in batches:
            data, offsets = _columns(batch)
            _, _, owner, h = runs(data, offsets)
            ids.append(_ids(batch))
            owners.append(owner + texts)
            hashes.append(h)
            size += len(h)
            texts += batch.num_rows
            if size > _FLUSH:
                yield from flush(ids, owners, hashes)
                ids, owners, hashes, size, texts = [], [], [], 0, 0
        yield from flush(ids, owners, hashes)

    return run


def _dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)


def _distinct_ids(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole, number = np.unique(ids, axis=0, return_inverse=True)
    return whole, number.reshape(-1)[owner]


def _shared(buckets: int, width: int, hot: int):
    """The packs of a bucket -> which anchors each of their texts shares; what is known already passes."""

    def run(table: pa.Table) -> pa.Table:
        rows, h, count, owner, ids, base = [], [], [], [], [], 0
        for bucket, kind, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
            if kind != _PACK:
                rows.append((bucket, kind, data))
                continue
            n, m, k = struct.unpack_from("<III", data)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(data, np.uint8, n * width, 12).reshape(n, width)
            h.append(wide.view(np.uint64)[:, 0])
            at, short = 12 + n * width, np.dtype(np.uint16 if m < 1 << 16 else np.uint32)
            owner.append(np.frombuffer(data, short, n, at).astype(np.int64) + base)
            at += n * short.itemsize
            ids.append(np.frombuffer(data, np.int64, 2 * m, at).reshape(m, 2))
            times = np.ones(n, np.int64)
            times[np.frombuffer(data, np.uint32, k, at + 16 * m)] = np.frombuffer(data, np.uint32, k, at + 16 * m + 4 * k)
            count.append(times)
            base += m
        if h:
            h, count = np.concatenate(h), np.concatenate(count)
            whole, owner = _distinct_ids(np.concatenate(ids), np.concatenate(owner))
            order = np.lexsort((owner, h))
            h, count, owner = h[order], count[order], owner[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(first, len(h)))
            varied = np.maximum.reduceat(owner, first) > np.minimum.reduceat(owner, first)
            both = np.repeat(varied, size)
            rows += _by_home(whole, owner[both], h[both], _SHARED, buckets)
            common = np.add.reduceat(count, first) > hot
            if common.any():
                rows.append((0, _HOT, h[first[common]].tobytes()))
        return pa.Table.from_batches(list(_rows(rows)), _ROW)

    return run


def _pieces(buckets: int, width: int, hot):
    """Texts with their shared anchors -> for each bucket the distinct runs, and what is removed already."""

    def flush(ids, docs, seen, gone) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        if gone:
            table = np.array(gone, np.int64)
            rows = _by_home(ids, table[:, 0], table[:, 1:].astype(np.int32), _GONE, buckets)
        packs: dict[int, list] = {}
        for piece, (bucket, _, found) in seen.items():
            packs.setdefault(bucket, []).append((piece, found))
        press = zstandard.ZstdCompressor(level=1)
        for bucket, found in packs.items():
            sizes = np.array([len(p) for p, _ in found], np.uint32)
            places = np.array([(i, o, s) for i, (_, spots) in enumerate(found) for o, s in spots], np.uint32)
            used, places[:, 1] = np.unique(places[:, 1], return_inverse=True)
            packed = struct.pack("<III", len(found), len(used), len(places)) + sizes.tobytes() + places.tobytes() + ids[used].tobytes() + docs[used].tobytes() + b"".join(p for p, _ in found)
            rows.append((bucket, _PACK, press.compress(packed)))
        yield from _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value
        ids, docs, seen, gone, texts, size = [], [], {}, [], 0, 0
        for batch in batches:
            data, offsets = _columns(batch)
            start, stop, owner, h = runs(data, offsets)
            h &= np.uint64((1 << 8 * width) - 1)
            doc = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = [np.frombuffer(x, np.uint64) for x in batch.column("shared").to_pylist()]
            with np.errstate(over="ignore"):
                mine = np.repeat(np.arange(len(lists), dtype=np.uint64), [len(x) for x in lists]) * np.uint64(0x9E3779B97F4A7C15) ^ np.concatenate(lists)
                kept = np.isin(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h, mine)
            start, stop, owner, h = start[kept], stop[kept], owner[kept], h[kept]
            alone = np.isin(h, often)
            if alone.any():  # strings at the most common anchors go one by one
                long = stop[alone] - start[alone]
                each = np.repeat(start[alone] - np.cumsum(long) + long, long) + np.arange(long.sum())
                v = _loads(data)
                with np.errstate(over="ignore"):
                    own = np.zeros(len(each), np.uint64)
                    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
                        own = (own ^ v[each + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                        own ^= own >> np.uint64(29)
                owner = np.concatenate([owner[~alone], np.repeat(owner[alone], long)])
                start, stop, h = np.concatenate([start[~alone], each]), np.concatenate([stop[~alone], each + 1]), np.concatenate([h[~alone], own])
            raw, bucket = data.tobytes(), _dealt(h, buckets).tolist()
            inside = (start - offsets[owner]).tolist()
            ids.append(_ids(batch))
            docs.append(doc)
            every = np.concatenate(docs).tolist()
            for a, b, o, where, at in zip(start.tolist(), stop.tolist(), owner.tolist(), bucket, inside):
                piece, o = raw[a : b + LENGTH - 1], o + texts
                number, old = every[o], seen.get(piece)
                if old is None:
                    seen[piece] = (where, number, [(o, at)])
                    size += len(piece)
                elif number == old[1]:
                    old[2].append((o, at))
                elif number > old[1]:
                    gone.append((o, at, at + len(piece)))
                else:
                    gone.extend((x, y, y + len(piece)) for x, y in old[2])
                    seen[piece] = (where, number, [(o, at)])
            texts += batch.num_rows
            if size > 8 * _FLUSH or len(gone) > _FLUSH // 4:
                yield from flush(np.concatenate(ids), np.concatenate(docs), seen, gone)
                ids, docs, seen, gone, texts, size = [], [], {}, [], 0, 0
        if ids:
            yield from flush(np.concatenate(ids), np.concatenate(docs), seen, gone)

    return run


def _direct(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the next ``depth`` bytes: by eight, then those that tie by the next eight."""
    v = _loads(x)
    key = v[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1]) if len(at) else np.zeros(0, bool)
    for skip in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group, part = np.cumsum(new)[where], at[where]
        key = v[part + skip].astype(np.uint64)
        order = np.lexsort((key, group))
        at[where] = part[order]
        key, old = key[order], new[where]
        new[where] = old | np.append(True, key[1:] != key[:-1])
    return at


def suffix_array(x: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The places marked in ``wanted`` by the order of the suffixes there, to ``depth`` bytes at least.

    ``x`` is as long as ``wanted``, then ``depth`` + 8 zeros or more; it is cut by zeros, one at its end. Two stages: a suffix smaller than its successor
    is sorted directly; any other follows from its successor's place, by scans over the buckets of
    first bytes in ascending order.
    """
    n = len(wanted)
    rise = np.sign(x[1 : n + 1].astype(np.int16) - x[:n]).astype(np.int8)
    place = np.where(rise != 0, np.arange(n), n - 1)
    smaller = rise[np.minimum.accumulate(place[::-1])[::-1]] > 0
    smaller |= x[:n] == 0  # a separator starts no run: it ends the chains
    # successors are needed up to the next suffix that is sorted directly
    direct_after = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    last = wanted & ~np.append(wanted[1:], False)
    ends = np.flatnonzero(last & ~smaller)
    member = np.zeros(n + 1, np.int32)
    np.add.at(member, ends + 1, 1)
    np.add.at(member, direct_after[ends] + 1, -1)
    member = (np.cumsum(member)[:n] > 0) | wanted
    first = _direct(x, np.flatnonzero(member & smaller), depth)
    induced = member & ~smaller
    by_byte = np.searchsorted(x[first], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        new = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(new):
            bucket.append(new)
            before = new[new > 0] - 1
            new = before[induced[before] & (x[before] == c)]
        bucket.append(first[by_byte[c] : by_byte[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before] & (x[before] > c)]
        heads = x[before]
        before = before[np.argsort(heads, kind="stable")]
        cuts = np.searchsorted(x[before], np.arange(257))
        for b in np.unique(heads):
            waiting[b].append(before[cuts[b] : cuts[b + 1]])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(x: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """How many bytes, at most ``most``, each suffix of ``order`` has in common with the one before it."""
    v, out = _loads(x), np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for skip in range(0, most, 8):
        if not len(open_):
            break
        differ = v[order[open_] + skip].astype(np.uint64) ^ v[order[open_ - 1] + skip].astype(np.uint64)
        same = np.full(len(open_), 8)
        some = differ != 0
        same[some] = 7 - (np.frexp(differ[some].astype(np.float64))[1] - 1) // 8
        # a number near 2^53 and above may round up to the next power; look at the byte itself
        wrong = some & (same < 7) & ((differ >> (np.uint64(8) * (7 - np.minimum(same, 7)).astype(np.uint64))) == 0)
        same[wrong] += 1
        out[open_] += same
        open_ = open_[same == 8]
    return np.minimum(out, most)


def first_docs(texts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes in the texts, the smallest doc of the texts that it starts in.

    Returns the values of all texts end to end, and where each text's values start.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = np.zeros(starts[-1] + length + 16, np.uint8)
    body = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    x[: starts[-1]] = body + np.uint8(1)  # 0xFF is in no UTF-8 text, so it becomes the zero between texts
    wanted = np.zeros(starts[-1], bool)
    counts = np.maximum(0, sizes - length + 1)
    spots = np.repeat(starts[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    wanted[spots] = True
    order = suffix_array(x, wanted, length)
    text_of = np.zeros(starts[-1], np.int64)
    text_of[spots] = np.repeat(np.arange(len(texts)), counts)
    new = common_prefixes(x, order, length) < length
    heads = np.flatnonzero(new)
    value = np.zeros(starts[-1], np.int64)
    if len(order):
        least = np.minimum.reduceat(docs[text_of[order]], heads)
        value[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return value[spots], np.concatenate([[0], np.cumsum(counts)])


def _removed(buckets: int):
    """The packs of a bucket -> (start, end) of the bytes that each text loses; what is known already passes."""

    def run(table: pa.Table) -> pa.Table:
        rows, packs, base = [], [], 0
        texts: dict[bytes, int] = {}
        ids, docs, places, number = [], [], [], []
        for bucket, kind, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
            if kind != _PACK:
                rows.append((bucket, kind, data))
                continue
            packs.append(data)
        unpress = zstandard.ZstdDecompressor()
        for packed in packs:
            data = unpress.decompress(packed)
            n, m, k = struct.unpack_from("<III", data)
            at = 12
            sizes = np.frombuffer(data, np.uint32, n, at)
            where = np.frombuffer(data, np.uint32, 3 * k, at + 4 * n).reshape(k, 3).astype(np.int64)
            at += 4 * n + 12 * k
            ids.append(np.frombuffer(data, np.int64, 2 * m, at).reshape(m, 2))
            docs.append(np.frombuffer(data, np.int64, m, at + 16 * m))
            at += 24 * m
            ends = np.cumsum(sizes.astype(np.int64))
            here = np.array([texts.setdefault(data[at + e - s : at + e], len(texts)) for e, s in zip(ends.tolist(), sizes.tolist())])
            number.append(here[where[:, 0]])
            places.append(where[:, 1:] + [base, 0])
            base += m
        if packs:
            whole, doc, place, number = np.concatenate(ids), np.concatenate(docs), np.concatenate(places), np.concatenate(number)
            own = np.full(len(texts), NO_ID)
            np.minimum.at(own, number, doc[place[:, 0]])
            least, starts = first_docs(list(texts), own)
            counts = np.diff(starts)[number]
            spot = np.repeat(np.arange(len(number)), counts)
            inside = np.arange(len(spot)) - np.repeat(np.cumsum(counts) - counts, counts)
            lost = least[starts[number][spot] + inside] < doc[place[spot, 0]]
            spot, inside = spot[lost], inside[lost]
            new = np.append(True, (spot[1:] != spot[:-1]) | (inside[1:] != inside[:-1] + 1)) if len(spot) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(spot))[: len(head)] - 1
            where = place[spot[head]]
            spans = np.stack([where[:, 1] + inside[head], where[:, 1] + inside[tail] + LENGTH], axis=1).astype(np.int32)
            rows += _by_home(whole, where[:, 0], spans, _GONE, buckets)
        return pa.Table.from_batches(list(_rows(rows)), _ROW)

    return run


_KEPT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans they lose -> how much goes, and what is left."""
    for batch in batches:
        data, offsets = _columns(batch)
        raw, removed, spans, left = data.tobytes(), [], [], []
        for a, b, lists in zip(offsets.tolist(), offsets[1:].tolist(), batch.column("gone").to_pylist()):
            text = raw[a:b]
            if not lists:
                removed.append(0)
                spans.append(0)
                left.append(text)
                continue
            table = np.frombuffer(lists, np.int32).reshape(-1, 2)
            table = table[np.argsort(table[:, 0], kind="stable")]
            reach = np.maximum.accumulate(table[:, 1])
            new = np.append(True, table[1:, 0] > reach[:-1])
            heads = np.flatnonzero(new)
            begin, end = table[heads, 0].tolist(), reach[np.append(heads[1:], len(table)) - 1].tolist()
            removed.append(sum(end) - sum(begin))
            spans.append(len(begin))
            left.append(b"".join(text[x:y] for x, y in zip([0, *end], [*begin, len(text)])))
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], schema=_KEPT)


def _kept_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n_bytes) of all rows; (h1, h2, doc, n_removed, n_spans, kept) of all distinct texts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text")).withColumns(identity("text", "h1", "h2"))
    rows = marked.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, width = max(partitions, 1 + total // _BLOCK_BYTES), _width(total)
    often = max(1000, total // (100_000 * W // 2))
    long = marked.filter(F.octet_length("text") >= LENGTH).select("h1", "h2", F.col("text").cast("binary").alias("text"))
    seen = long.mapInArrow(_anchors(buckets, width), _ROW_DDL).groupBy("bucket").applyInArrow(_shared(buckets, width, often), _ROW_DDL)
    told = stored(seen)
    common = [np.frombuffer(r[0], np.uint64) for r in told.filter(F.col("kind") == _HOT).select("data").collect()]  # 100,000 at most
    hot = spark.sparkContext.broadcast(np.unique(np.concatenate(common)) if common else np.zeros(0, np.uint64))
    lists = told.filter(F.col("kind") == _SHARED).groupBy("bucket").applyInArrow(_at_home(8), _TEXT_DDL).withColumnRenamed("data", "shared")
    # the same columns in both uses below, so that one shuffle of the texts serves both
    texts = marked.groupBy("h1", "h2").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc"), F.first("text").cast("binary").alias("text"))
    pieces = texts.join(lists, ["h1", "h2"]).select("h1", "h2", "doc", "text", "shared").mapInArrow(_pieces(buckets, width, hot), _ROW_DDL)
    gone = stored(pieces.groupBy("bucket").applyInArrow(_removed(buckets), _ROW_DDL)).groupBy("bucket").applyInArrow(_at_home(8), _TEXT_DDL).withColumnRenamed("data", "gone")
    cut = texts.join(gone, ["h1", "h2"], "left").select("h1", "h2", "doc", "text", "gone").mapInArrow(_cut, "h1 long, h2 long, n_removed long, n_spans long, kept binary")
    return rows, cut


def removed_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty. Rows without doc_id come after all others, and none of them before
    another; rows that share a doc_id are never repeats of each other. Texts shorter than ``LENGTH``
    bytes lose nothing. Other columns are not read. Texts must be UTF-8.
    """
    rows, cut = _kept_texts(docs)
    firsts = rows.groupBy("h1", "h2").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc"))
    told = cut.select("h1", "h2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).join(firsts, ["h1", "h2"])
    both = rows.join(told, ["h1", "h2"])
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("doc")) & (F.col("n_bytes") >= LENGTH)
    return both.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
