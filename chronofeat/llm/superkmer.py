"""Removal of repeated word windows by super-k-mer partitioning.

Every window of ``window`` consecutive words has a minimiser: the smallest hash
among its runs of ``mer`` words. Consecutive windows that share it travel as one
packed string (their words once, not once per window) to the bucket of that
hash, so equal windows meet in one bucket whatever documents they come from. A
bucket first joins equal packed strings, then sorts the hashes of the remaining
windows and compares the words of those that collide: counts are exact.

Before the shuffle a task joins the equal packed strings it has met: all windows
in them are known to repeat, so their places are settled on the spot and one
string stands for any number of copies. Packed strings are sent as compressed
blocks, one per bucket and flush.

Runs of words that are very frequent (a passage quoted in very many
surroundings) would fill their bucket. A first pass counts all runs of ``mer``
words (lossy counting: a run below an eighth of the limit's share of a stretch or
of a task is left out there) and finds those with a share of more than a quarter of a
bucket's; they rank after all others as minimisers. So a window that holds any
other run meets its like elsewhere, and only windows made of frequent runs alone
are left: these are few different ones, whose copies a task joins before they
travel singly, by the hash of the whole window. Touching spans of a document are
merged before they leave a task, so a passage gives a document few rows however
often it occurs.

Each word that a repeated window covers is removed; windows are judged on the
input. Null texts have no words; texts shorter than a window lose nothing. Very
long texts are worked off in overlapping pieces. Repeated rows (same id and
text) count as often as they occur. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

WINDOW = 35
MER = 4
SUB_BUCKETS = 8
HOT_FLOOR = 1000
PIECE_WORDS = 1 << 17
GROUP_BYTES = 1 << 20
FLUSH_BYTES = 32 << 20
HASH_BYTES = (1 << 20) - 1
LEVEL = 3
#: A place: 96 bits that name the document, and a word number; spans add a number of windows.
PLACE = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("lo", "<i4")])
SPAN = np.dtype([*PLACE.descr, ("n", "<i4")])
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int):
    def grow(base):
        out = np.full(n, base, _U)
        out[0] = 1
        return np.cumprod(out)
    return grow(_BASE), grow(_INVERSE)


def _power_tables(n: int):
    return _powers(1 << max(20, int(n).bit_length()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i modulo 2**64, from 0."""
    up, _ = _power_tables(len(values))
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values.astype(_U) * up[:len(values)], out=out[1:])
    return out


def _spans(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the spans [lo, hi), independent of where they lie."""
    _, down = _power_tables(len(prefix))
    return _mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(_U))


class Words:
    """Word boundaries and hashes of a buffer of words with one space between them."""

    def __init__(self, buf: bytes):
        raw = np.frombuffer(buf, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        self.buf = buf
        self.starts = np.r_[0, gaps + 1]
        self.ends = np.r_[gaps, len(raw)]
        self.hashes = self._hash(raw)
        self.prefix = _sums(self.hashes)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of the words, worked off in bounded stretches of bytes."""
        out, at = np.empty(len(self.starts), _U), 0
        while at < len(out):
            lo = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, lo + HASH_BYTES, side="right")))
            out[at:stop] = _spans(_sums(raw[lo:self.ends[stop - 1]]), self.starts[at:stop] - lo,
                                  self.ends[at:stop] - lo)
            at = stop
        return out

    def runs(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words, by first word."""
        lo = np.arange(len(self.hashes) - size + 1)
        return _spans(self.prefix, lo, lo + size)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


_FREQUENT = _U(1 << 63)
_NONE = np.empty(0, _U)


def _ranked(mers: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Ranks of runs of words: their hashes, the frequent ones (``hot``, sorted) after the others."""
    ranks = mers >> _U(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, mers), len(hot) - 1)
        ranks[hot[at] == mers] |= _FREQUENT
    return ranks


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans with those of a document that touch or overlap made one."""
    if not len(spans):
        return spans
    spans = np.sort(spans, order=("k1", "k2", "lo"))
    new = np.r_[True, (spans["k1"][1:] != spans["k1"][:-1]) | (spans["k2"][1:] != spans["k2"][:-1])]
    base = np.cumsum(new) << 33
    end = np.maximum.accumulate(base + spans["lo"] + spans["n"])
    start = np.flatnonzero(np.r_[True, base[1:] + spans["lo"][1:] > end[:-1]])
    out = spans[start].copy()
    out["n"] = end[np.r_[start[1:], len(spans)] - 1] - base[start] - out["lo"]
    return out


def _runs(pieces: list[bytes], counts: list[int], window: int, mer: int, hot: np.ndarray):
    """Runs of windows that share a minimiser, in pieces of space-joined words.

    (words, used pieces, their first words, owner of each run, its first and last window,
    its minimiser's rank)
    """
    use = [i for i, n in enumerate(counts) if n >= window]
    w = Words(b" ".join([pieces[i] for i in use]))
    sizes = np.array([counts[i] for i in use])
    first = np.cumsum(sizes) - sizes
    least = _sliding_min(_ranked(w.runs(mer), hot), window - mer + 1)
    owner = np.repeat(np.arange(len(use)), sizes)[:len(least)]
    inside = np.arange(len(least)) <= (first + sizes - window)[owner]
    fresh = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]
    lo = np.flatnonzero(inside & fresh)
    stop = np.flatnonzero(inside & np.r_[fresh[1:] | ~inside[1:], True])
    return w, use, first, owner[lo], lo, stop, least[lo]


def super_kmers(pieces: list[bytes], counts: list[int], window: int, mer: int,
                hot: np.ndarray = _NONE):
    """(piece, first word, windows, minimiser's rank, packed words) of pieces of space-joined words."""
    if max(counts, default=0) < window:
        return
    w, use, first, place, lo, stop, least = _runs(pieces, counts, window, mer, hot)
    at, end = w.starts[lo].tolist(), w.ends[stop + window - 1].tolist()
    yield from zip([use[p] for p in place.tolist()], (lo - first[place]).tolist(),
                   (stop - lo + 1).tolist(), least.tolist(),
                   [w.buf[a:b] for a, b in zip(at, end)])


def _pieces(text: bytes, window: int):
    """(first word, words) of overlapping pieces; every window lies whole in just one of them."""
    words = text.split()
    if len(words) < window:
        return
    for at in range(0, len(words) - window + 1, PIECE_WORDS):
        part = words[at:at + PIECE_WORDS + window - 1]
        yield at, b" ".join(part), len(part)


_SENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("places", pa.binary()),
                   ("settled", pa.binary())])


class _Frequent:
    """Lossy counters of the runs of ``mer`` words of a task."""

    def __init__(self, limit: int, window: int, mer: int):
        self.limit, self.window, self.mer = limit, window, mer
        self.counts, self.total = Counter(), 0

    def add(self, pieces, counts):
        use = [i for i, n in enumerate(counts) if n >= self.window]
        if not use:
            return
        mers = Words(b" ".join([pieces[i] for i in use])).runs(self.mer)
        sizes = np.array([counts[i] for i in use])
        inside = np.ones(len(mers), bool)
        for back in range(1, self.mer):  # runs across the end of a piece
            inside[np.cumsum(sizes)[:-1] - back] = False
        mers = mers[inside]
        self.total += len(mers)
        found, times = np.unique(mers, return_counts=True)
        often = times * 8 * self.limit >= len(mers)
        self.counts.update(dict(zip(found[often].tolist(), times[often].tolist())))
        if len(self.counts) > 16 * self.limit:
            cut = sorted(self.counts.values(), reverse=True)[8 * self.limit]
            self.counts = Counter({m: n - cut for m, n in self.counts.items() if n > cut})


def hot_minimisers(rows: DataFrame, buckets: int, window: int, mer: int) -> np.ndarray:
    """Sorted hashes of the runs of ``mer`` words that make up a share of 1 / (4 * buckets) or more.

    There are at most 4 * ``buckets`` of them.
    """
    limit = 4 * buckets

    def count(batches):
        seen = _Frequent(limit, window, mer)
        pieces, counts, held = [], [], 0
        for b in batches:
            for t in b.column("text"):
                for _, joined, n in _pieces(t.as_py(), window):
                    pieces.append(joined)
                    counts.append(n)
                    held += len(joined)
                    if held >= GROUP_BYTES:
                        seen.add(pieces, counts)
                        pieces, counts, held = [], [], 0
        seen.add(pieces, counts)
        top = [(m, n) for m, n in seen.counts.items() if n * 8 * limit >= seen.total] or [(0, 0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([m for m, _ in top], np.uint64).view(np.int64)),
             pa.array([n for _, n in top], pa.int64()),
             pa.array([seen.total] + [0] * (len(top) - 1), pa.int64())],
            names=["m", "n", "total"])

    found = stored(rows.select("text").mapInArrow(count, "m long, n long, total long"),
                   "minimisers")
    total = found.agg(F.sum("total")).first()[0] or 0
    most = max(HOT_FLOOR, total // limit)
    hot = found.groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= most).collect()
    return np.sort(np.array([r.m for r in hot], np.int64).view(_U))


class _Sender:
    """Collects super-k-mers of a task and sends them by bucket in compressed blocks."""

    def __init__(self, buckets: int, window: int, mer: int, hot: np.ndarray = _NONE):
        self.buckets, self.window, self.mer, self.hot = buckets, window, mer, hot
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.pieces, self.counts, self.ids, self.group = [], [], [], 0
        self.seen, self.held = defaultdict(list), 0
        self.frequent, self.spans = Counter(), []

    def add(self, k1: int, k2: int, text: bytes):
        for at, joined, n in _pieces(text, self.window):
            self.pieces.append(joined)
            self.counts.append(n)
            self.ids.append((k1, k2, at))
            self.group += len(joined)
            if self.group >= GROUP_BYTES:
                yield from self.work()

    def work(self):
        for p, lo, n, least, packed in super_kmers(self.pieces, self.counts, self.window, self.mer,
                                                   self.hot):
            k1, k2, at = self.ids[p]
            if least >> 63 == 0:
                self.keep(packed, least, n, (k1, k2, at + lo))
            elif self.frequent[packed] > 1:  # its windows have been kept twice, so they are settled
                self.spans.append((k1, k2, at + lo, n))
                self.held += 100
            else:
                self.frequent[packed] += 1
                self.held += len(packed) + 120
                words = packed.split()
                for i in range(n):
                    one = b" ".join(words[i:i + self.window])
                    self.keep(one, xxhash.xxh64_intdigest(one), 1, (k1, k2, at + lo + i))
        self.pieces, self.counts, self.ids, self.group = [], [], [], 0
        if self.held >= FLUSH_BYTES:
            yield from self.flush()

    def keep(self, packed: bytes, hashed: int, n: int, place: tuple):
        known = self.seen[packed]
        if not known:
            self.held += len(packed) + 120
            known.append((hashed % self.buckets, n))
        known.append(place)
        self.held += 100

    def flush(self):
        packed, places, spans = defaultdict(list), defaultdict(list), self.spans
        for words, ((bucket, n), *at) in self.seen.items():
            packed[bucket].append(words)
            if len(at) == 1:
                places[bucket].append(at[0])
            else:  # repeats: settled here, spread by document
                places[bucket].append((0, 0, -1))
                spans += [(k1, k2, lo, n) for k1, k2, lo in at]
        spans, settled = _merged(np.array(spans, SPAN)), {}
        if len(spans):
            to = spans["k1"] % self.buckets
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                settled[int(to[part[0]])] = spans[part].tobytes()
        self.seen, self.held = defaultdict(list), 0
        self.frequent, self.spans = Counter(), []
        rows = []
        for b in sorted(set(packed) | set(settled)):
            rows.append((b, self.zip.compress(b"\n".join(packed[b])) if packed[b] else None,
                         np.array(places[b], PLACE).tobytes() if packed[b] else None,
                         settled.get(b)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)


def repeated_windows(strings: list[bytes], window: int):
    """For distinct packed strings: one boolean array each, true where a window occurs twice."""
    w = Words(b"\n".join(strings))
    sizes = np.array([s.count(b" ") + 1 for s in strings])
    first = np.cumsum(sizes) - sizes
    hashes = w.runs(window)
    owner = np.repeat(np.arange(len(strings)), sizes)[:len(hashes)]
    inside = np.flatnonzero(np.arange(len(hashes)) <= (first + sizes - window)[owner])
    order = inside[np.argsort(hashes[inside], kind="stable")]
    h = hashes[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(hashes), bool)
    cand = order[np.r_[same, False] | np.r_[False, same]]
    if len(cand):  # the words decide, not the hash
        meet = {}
        for i, a, b in zip(cand.tolist(), w.starts[cand].tolist(),
                           w.ends[cand + window - 1].tolist()):
            meet.setdefault(w.buf[a:b], []).append(i)
        for at in meet.values():
            if len(at) > 1:
                twice[at] = True
    return [twice[f:f + n - window + 1] for f, n in zip(first.tolist(), sizes.tolist())]


def _bucket_intervals(blocks, window: int):
    """(k1, k2, first word, windows) of repeated windows of one bucket."""
    unzip = zstandard.ZstdDecompressor()
    meet, out = {}, []
    for packed, places, settled in blocks:
        if settled is not None:
            out.append(np.frombuffer(settled, SPAN))
        if packed is None:
            continue
        at = np.frombuffer(places, PLACE).tolist()
        for words, place in zip(unzip.decompress(packed).split(b"\n"), at):
            meet.setdefault(words, []).append(place)
    strings = list(meet)
    found = set()
    for words, twice in zip(strings, repeated_windows(strings, window) if strings else ()):
        places = meet[words]
        if len(places) > 1 or places[0][2] < 0:
            spans = [(0, len(twice))]
        elif twice.any():
            edge = np.flatnonzero(np.diff(np.r_[0, twice.view(np.int8), 0]))
            spans = zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())
        else:
            continue
        spans = list(spans)
        found |= {(k1, k2, lo + a, n) for k1, k2, lo in places if lo >= 0
                  for a, n in spans}
    if found:
        out.append(np.array(sorted(found), SPAN))
    return _merged(np.concatenate(out)) if out else np.empty(0, SPAN)


def repeated_spans(rows: DataFrame, window: int = WINDOW, mer: int = MER,
                   sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """(k1, k2, lo, n): the n windows from word lo on of document (k1, k2) occur elsewhere too.

    ``rows`` has (k1 long, k2 int, text as binary).
    """
    tasks = partitions(rows.sparkSession)
    buckets = tasks * sub_buckets
    hot = rows.sparkSession.sparkContext.broadcast(hot_minimisers(rows, buckets, window, mer))

    def send(batches):
        sender = _Sender(buckets, window, mer, hot.value)
        for b in batches:
            for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(),
                                 b.column("text")):
                yield from sender.add(k1, k2, t.as_py())
        yield from sender.work()
        yield from sender.flush()

    def count(batches):
        current, blocks = None, []

        def result():
            got = _bucket_intervals(blocks, window)
            for at in range(0, len(got), 1 << 16):
                part = got[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part[c]) for c in SPAN.names],
                                                 names=list(SPAN.names))
        for b in batches:
            for bucket, *block in zip(*(b.column(c).to_pylist() for c in _SENT.names)):
                if bucket != current:
                    if blocks:
                        yield from result()
                    current, blocks = bucket, []
                blocks.append(block)
        if blocks:
            yield from result()

    sent = rows.mapInArrow(send, "bucket int, packed binary, places binary, settled binary")
    return (sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(count, "k1 long, k2 int, lo int, n int"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   mer: int = MER) -> DataFrame:
    """One row per row of ``docs``: (key, n_words, n_removed, kept_text)."""
    id_, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(id_.alias("id"), F.xxhash64(id_, t).alias("k1"),
                       F.hash(id_, t).alias("k2"), t.cast("binary").alias("text"))
    spans = repeated_spans(rows.select("k1", "k2", "text"), window, mer)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))

    def pack(batches):  # words travel to their spans compressed
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            words = [squeeze(b" ".join(x.as_py().split())) for x in b.column("text")]
            yield b.set_column(b.schema.get_field_index("text"), "text",
                               pa.array(words, pa.binary()))

    joined = rows.mapInArrow(pack, rows.schema).join(spans, ["k1", "k2"], "left").select(
        "id", "text", "spans")

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            size, gone, kept = [], [], []
            for text_, spans_ in zip(b.column("text"), b.column("spans")):
                words, cut = unzip.decompress(text_.as_py()).split(), spans_.as_py()
                size.append(len(words))
                if cut:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in cut:
                        edge[s["lo"]] += 1
                        edge[s["lo"] + s["n"] + window - 1] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                gone.append(size[-1] - len(words))
                kept.append(b" ".join(words))
            kept = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                 pa.StringArray.from_buffers(len(kept), kept.buffers()[1], kept.buffers()[2])],
                names=["id", "n_words", "n_removed", "kept_text"])

    schema = docs.select(id_.alias("id"), F.lit(0).cast("long").alias("n_words"),
                         F.lit(0).cast("long").alias("n_removed"),
                         F.lit("").alias("kept_text")).schema
    return joined.mapInArrow(run, schema).toDF(key, "n_words", "n_removed", "kept_text")
