"""Removing every byte of a repeated 400-byte string, with sorted suffixes.

Sorting a suffix at every byte would move hundreds of times the corpus, so suffixes start at anchors only. Every
window of LENGTH bytes has one anchor: the place of its least 200-byte gram by hash (leftmost of equal ones). Equal
windows have their anchors at the same place inside, and neighbouring windows mostly share one; a maximal run of
windows with one anchor is a segment. Two windows can only be equal if their segments' grams are.

1. Segments whose gram occurs once are done. Segments that are equal as wholes (gram and whole content by two
   independent 64-bit hashes) are repeated in all their windows, however many there are; they are settled by counting.
2. Of the rest, grams with different surroundings, one segment of each content is sent on as a suffix from its anchor
   with what stands before it. Sampled splitters range-partition the suffixes by their grams, so that equal grams
   never lie across a boundary and a bucket needs no row of its neighbour. Buckets are sorted by multikey
   quicksort; common prefix lengths of neighbours, and those of the reversed left sides, tell for each place of a
   window exactly which suffixes agree over it.
3. Grams with more than LARGE different surroundings are counted window by window instead, by hash, in a shuffle that
   sums before it moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, join_apart, stored, text_bytes, text_slices

LENGTH = 400
#: Different surroundings of one gram that are sorted in one bucket.
LARGE = 50_000
#: Suffixes of a bucket.
BUCKET = 50_000
#: Bytes of text hashed at once.
BUFFER = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


class Anchors:
    """Segments of texts by their windows' anchors."""

    def __init__(self, length: int, buffer: int = BUFFER):
        self.length, self.gram = length, length // 2
        self.span = length - self.gram + 1  # grams in a window
        n = buffer + 2 * length
        self.power, self.inverse = (np.full(n, x, dtype=np.uint64) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
        for x in (self.power, self.inverse):
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        self.buffer = buffer

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Least value in each stretch of span places."""
        w = self.span
        blocks = -(-len(x) // w)
        grid = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[: len(x)] = x
        grid = grid.reshape(blocks, w)
        from_left = np.minimum.accumulate(grid, axis=1).ravel()
        from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(from_right[: len(x) - w + 1], from_left[w - 1 : len(x)])

    def of(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, first window in it, windows, anchor after the first window, gram hash) of the pieces of data."""
        n = len(data)
        full = np.nonzero(sizes >= self.length)[0]
        none = np.zeros(0, dtype=np.int64)
        if not len(full):
            return none, none, none, none, none
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * self.power[:n], dtype=np.uint64)])
            h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        # as many bits as any place in a buffer takes, so that grams are ordered alike in slices of every size
        bits = np.uint64(int(self.buffer).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = self._least((h & ~low) | np.arange(len(h), dtype=np.uint64))
        counts = sizes[full] - self.length + 1
        first = np.cumsum(counts) - counts
        p = np.arange(int(counts.sum())) + np.repeat(starts[full] - first, counts)
        m = (least[p] & low).astype(np.int64)
        new = np.ones(len(p), dtype=bool)
        new[1:] = (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)
        at = np.nonzero(new)[0]
        windows = np.diff(np.append(at, len(p)))
        piece = np.repeat(full, counts)[at]
        return piece, p[at] - starts[piece], windows, m[at] - p[at], h[m[at]].view(np.int64)


def _pieces(texts: list[bytes], length: int, buffer: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Joined pieces of texts, at most about buffer bytes: (data; each piece's row, place in the row's text, and size).

    A text longer than the buffer is cut so that each of its windows lies in exactly one piece.
    """
    data, rows, places, sizes, held = [], [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), buffer - length):
            part = t[at : at + buffer - 1]
            if len(part) < length:
                continue
            if held + len(part) > buffer:
                yield b"".join(data), rows, places, sizes
                data, rows, places, sizes, held = [], [], [], [], 0
            data.append(part)
            rows.append(i)
            places.append(at)
            sizes.append(len(part))
            held += len(part)
    if data:
        yield b"".join(data), rows, places, sizes


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words, by three-way partitioning on one word at a time."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        own = order[a:b]
        if b - a <= 64:
            keys = words[own, depth:]
            order[a:b] = own[np.lexsort(keys.T[::-1])]
            continue
        v = words[own, depth]
        pivot = np.sort(v[:: max(1, (b - a) // 9)])[4]
        less, same = v < pivot, v == pivot
        order[a:b] = np.concatenate([own[less], own[same], own[~(less | same)]])
        i, j = a + int(less.sum()), a + int(less.sum()) + int(same.sum())
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, filled up with zeros to a multiple of eight."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in parts), dtype=np.uint8).reshape(len(parts), width)


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.int64)
    for at in range(1, len(rows), 20_000):
        differs = rows[at : at + 20_000] != rows[at - 1 : at - 1 + len(rows[at : at + 20_000])]
        out[at : at + 20_000] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def repeated_windows(left: list[bytes], right: list[bytes], before: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each suffix and number of bytes before its anchor: is that window equal to another suffix's?

    left: bytes before the anchor, nearest first; right: bytes from the anchor on; before: bytes from the first
    window's start to the anchor; windows: how many windows the segment has.
    """
    gram = length // 2
    r = _matrix(right, length)
    by_right = multikey_quicksort(r.view(">u8").astype(np.uint64))
    right_lcp = _common(r[by_right])
    run = np.empty(len(r), dtype=np.int64)
    run[by_right] = np.cumsum(right_lcp < gram)
    lft = _matrix(left, length - gram)
    by_left = multikey_quicksort(np.hstack([run[:, None].astype(np.uint64), lft.view(">u8").astype(np.uint64)]))
    left_lcp = _common(lft[by_left])
    left_lcp[1:][run[by_left][1:] != run[by_left][:-1]] = -1
    left_lcp[:1] = -1
    out = np.zeros((len(r), length - gram + 1), dtype=bool)
    rank, place = np.empty(len(r), dtype=np.int64), np.empty(len(r), dtype=np.int64)
    for s in range(length - gram + 1):
        there = np.nonzero((before >= s) & (s > before - windows))[0]
        if len(there) < 2:
            continue
        rank[by_right] = np.cumsum(right_lcp < length - s)
        place[by_left] = np.cumsum(left_lcp < s)
        key = rank[there] * (len(r) + 1) + place[there]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twin = np.zeros(len(there), dtype=bool)
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        out[there, s] = twin
    return out


def _spans(flags: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the byte ranges that flagged windows cover; flags by bytes before the anchor."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, anchor[row] - (high - 1), anchor[row] - low + length


def _segments(docs: DataFrame, length: int, buffer: int = BUFFER) -> DataFrame:
    """did, th, p, windows, before, g, c: the segments of every text; th tells rows of one id apart."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, buffer)
        for part in text_slices(parts, 2, buffer):
            texts = text_bytes(part.column(2))
            for data, rows, places, sizes in _pieces(texts, length, buffer):
                sizes = np.array(sizes)
                starts = np.cumsum(sizes) - sizes
                piece, p, windows, before, g = anchors.of(data, starts, sizes)
                a = starts[piece] + p
                seeds = before * 4_096 + windows
                c = [xxhash.xxh3_64_intdigest(data[x:y], z) for x, y, z in zip(a.tolist(), (a + windows + length - 1).tolist(), seeds.tolist(), strict=True)]
                row = pa.array(np.array(rows)[piece])
                yield pa.record_batch(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(np.array(places)[piece] + p), pa.array(windows.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(g), pa.array(np.array(c, dtype=np.uint64).view(np.int64))],
                    names=["did", "th", "p", "windows", "before", "g", "c"],
                )

    return docs.mapInArrow(run, f"did {dict(docs.dtypes)['did']}, th long, p long, windows int, before int, g long, c long")


def _packed(docs: DataFrame) -> DataFrame:
    """did, th, z: texts compressed for the shuffle by document."""
    import zstandard

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for part in text_slices(parts, 2):
            yield pa.record_batch([part.column(0), part.column(1), pa.array([pack.compress(t) for t in text_bytes(part.column(2))], pa.binary())], names=["did", "th", "z"])

    return docs.mapInArrow(run, f"did {dict(docs.dtypes)['did']}, th long, z binary")


def _window_hashes(rows: DataFrame, length: int) -> DataFrame:
    """did, th, p, w1, w2: each single window of segments given with their bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p, windows = part.column(2).to_numpy(), part.column(3).to_numpy()
            left, right = part.column(5).to_pylist(), part.column(6).to_pylist()
            for i in range(part.num_rows):
                whole = left[i][::-1] + right[i]
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[k : k + length]) for k in range(windows[i])), dtype=">i8").reshape(-1, 2).astype(np.int64)
                row = pa.array(np.full(len(h), i))
                yield pa.record_batch([part.column(0).take(row), part.column(1).take(row), pa.array(p[i] + np.arange(len(h))), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["did", "th", "p", "w1", "w2"])

    source = rows.select("did", "th", "p", "windows", "before", "left", "right")
    return source.mapInArrow(run, f"did {dict(rows.dtypes)['did']}, th long, p long, w1 long, w2 long")


def _dealt(suffixes: DataFrame, bucket: int, length: int) -> DataFrame:
    """suffixes range-partitioned by sampled splitters into buckets of about `bucket` rows.

    They are cut by their whole grams: no gram lies across a boundary, and suffixes of texts with a header in common are
    told apart behind it.
    """
    return suffixes.repartitionByRange(max(1, -(-suffixes.count() // bucket)), F.substring("right", 1, length // 2))


def repeated_spans(docs: DataFrame, length: int = LENGTH, large: int = LARGE, bucket: int = BUCKET, buffer: int = BUFFER) -> DataFrame:
    """did, th, start, end: byte ranges, overlapping ones too, whose windows of `length` bytes occur elsewhere.

    docs has columns did, th and text, where th tells rows of one id apart.
    """
    id_type = dict(docs.dtypes)["did"]
    segments = stored(_segments(docs, length, buffer), "segments")
    grams = segments.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("differ")).where("n > 1")
    grams = stored(grams, "grams")
    total = segments.count()
    met = stored(join_apart(segments, grams.select("g", "n", "differ"), ["g"], total), "segments-met")
    classes = met.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.first("differ").alias("differ"), F.min_by(F.struct("did", "th", "p", "windows", "before"), F.struct("did", "th", "p")).alias("x"))
    classes = stored(classes, "segment-classes")
    whole = join_apart(met.drop("differ"), classes.where("n > 1").select("g", "c", "n"), ["g", "c"], total)
    whole = whole.select("did", "th", F.col("p").alias("start"), (F.col("p") + F.col("windows") - 1 + length).alias("end"))
    differing = classes.where("differ")
    kinds = differing.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") > large)
    differing = join_apart(differing.select("g", "x"), stored(kinds, "gram-kinds"), ["g"], differing.count()).select("x.*", "large")
    wanted = differing.groupBy("did", "th").agg(F.collect_list(F.struct("p", "windows", "before", "large")).alias("wanted"))
    joined = _packed(docs.where(F.octet_length("text") >= length)).join(wanted, ["did", "th"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            for i in range(part.num_rows):
                text = unpack.decompress(part.column(2)[i].as_py())
                found = part.column(3)[i].values.flatten()
                p, windows, before, big = (x.to_numpy(zero_copy_only=False) for x in found)
                anchor = p + before
                right = [text[a:b] for a, b in zip(anchor.tolist(), (p + windows - 1 + length).tolist(), strict=True)]
                left = [text[a:b][::-1] for a, b in zip(p.tolist(), anchor.tolist(), strict=True)]
                row = pa.array(np.full(len(p), i))
                yield pa.record_batch(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(p), pa.array(windows), pa.array(before), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(big)],
                    names=["did", "th", "p", "windows", "before", "left", "right", "large"],
                )

    schema = f"did {id_type}, th long, p long, windows int, before int, left binary, right binary, large boolean"
    suffixes = stored(joined.select("did", "th", "z", "wanted").mapInArrow(cut, schema), "suffixes")
    small = suffixes.where("not large")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in parts if x.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        p, windows, before = (rows.column(c).to_numpy().astype(np.int64) for c in ("p", "windows", "before"))
        flags = repeated_windows(rows.column("left").to_pylist(), rows.column("right").to_pylist(), before, windows, length)
        row, start, end = _spans(flags, p + before, length)
        at = pa.array(row)
        out = pa.table([rows.column("did").take(at), rows.column("th").take(at), pa.array(start), pa.array(end)], names=["did", "th", "start", "end"])
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    span = f"did {id_type}, th long, start long, end long"
    partly = _dealt(small, bucket, length).mapInArrow(compare, span)
    windows = _window_hashes(suffixes.where("large"), length)
    often = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = windows.join(often, ["w1", "w2"], "left_semi").select("did", "th", F.col("p").alias("start"), (F.col("p") + length).alias("end"))
    return whole.union(partly).union(single)


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, large: int = LARGE, bucket: int = BUCKET, buffer: int = BUFFER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, spans (array of start, end of the maximal removed ranges) and kept (binary) of each row.

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in the same text or another.
    Null texts are empty; texts shorter than `length` stay whole. Repeated rows count as documents of their own, so
    long ones lose everything. Null keys are like others. Other columns are not read. An empty table gives no rows.
    """
    id_type = dict(docs.dtypes)[key]
    # th's lowest bit tells a null key from the value that stands for it
    th = F.xxhash64(F.col(text).cast("string")).bitwiseAND(F.lit(-2)) + F.col(key).isNull().cast("long")
    own = docs.select(F.coalesce(F.col(key), F.lit(0).cast(id_type)).alias("did"), th.alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(own, length, large, bucket, buffer)
    spans = stored(spans.groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    joined = _packed(own).join(spans, ["did", "th"], "left")
    named = joined.withColumn("key", F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("did")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            size, kept, ranges = [], [], []
            for z, found in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                t = unpack.decompress(z)
                merged = []
                if found.is_valid:
                    a, b = (x.to_numpy() for x in found.values.flatten())
                    merged = merge_spans(a, b)
                at, left = 0, []
                for a, b in merged:
                    left.append(t[at:a])
                    at = b
                size.append(len(t))
                kept.append(b"".join([*left, t[at:]]))
                ranges.append([{"start": a, "end": b} for a, b in merged])
            yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return named.select("key", "z", "spans").mapInArrow(run, f"`{key}` {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op6_suffix_dedup(spark, sf_dir):
    done = remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeats"))
