"""SimHash near-dedup with bit-sliced comparison.

Fingerprints link at ``radius`` or fewer differing bits. Candidates are found by
the pigeonhole rule: cut the 64 bits into radius + 1 blocks and any linked pair
agrees in one block; the bits outside that block are cut again, so tables are
keyed by (radius + 1) ** 2 masks. Buckets that still hold more than
``bucket_rows`` distinct fingerprints are cut by the same rule again, which
leaves fewer free bits each time, until none is larger; no pair is lost.

Inside a bucket the fingerprints lie as vertical bit planes, 64 to a machine
word. A query's difference to 64 others is one XOR per plane; three planes at a
time go through a carry-save adder into bit-sliced counters, and a word is
abandoned once all its lanes exceed the radius. A bucket gives a spanning
forest, not its pairs. Components come from rounds of star contraction.

Nulls: a null text counts as empty; texts without words have fingerprint zero
and link like any other. A null id sorts after all ids when a component's
smallest id is chosen (null only if it has no other). Repeated rows share a
fingerprint. An empty table gives no rows. Other columns are ignored by
``near_groups`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, partitions, row_name, stored

BITS = 64
BUCKET_ROWS = 4096
_CHUNK_SHINGLES = 1 << 16
_CHUNK_WORDS = 1 << 17


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: majority over the XXH64 of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(shingle, len(words))
    s, e = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    h64, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(s), _CHUNK_SHINGLES):
        h = np.array([h64(joined[a:b], seed) for a, b in
                      zip(s[at:at + _CHUNK_SHINGLES], e[at:at + _CHUNK_SHINGLES])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(s), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keys: list[Column], text: Column, shingle: int = 3,
                      seed: int = 42) -> DataFrame:
    """The key columns and ``fp`` (the 64 bits as a signed long) of every row."""
    rows = docs.select(*keys, F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            fps = np.array(fps, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(fps)],
                                             names=[*names, "fp"])

    out = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, out)


# --- bit-sliced comparison ---------------------------------------------------------------

def _more_than(counter, radius):
    """Lanes whose bit-sliced counter exceeds ``radius``."""
    more, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            more |= equal & counter[i]
            equal &= ~counter[i]
    return more


def linked_lanes(fps: np.ndarray, ends: np.ndarray, radius: int):
    """Yield (i, j) index arrays, i < j < ends[i], of fingerprints within ``radius`` bits."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((BITS, words * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
    ask = np.where(bits.T, ~np.uint64(0), np.uint64(0))
    rows = np.arange(n)
    first, last = (rows + 1) // 64, (ends - 1) // 64
    count = np.where(ends - rows > 1, last - first + 1, 0)
    owners, total = np.repeat(rows, count), int(count.sum())
    skip = np.repeat(np.cumsum(count) - count, count)
    width = max(1, int(radius).bit_length())
    for at in range(0, total, _CHUNK_WORDS):
        q = owners[at:at + _CHUNK_WORDS]
        w = first[q] + np.arange(at, at + len(q)) - skip[at:at + _CHUNK_WORDS]
        lo = np.maximum(q + 1 - w * 64, 0).astype(np.uint64)
        hi = np.minimum(ends[q] - w * 64, 64).astype(np.uint64)
        alive = (~np.uint64(0) << lo) & (~np.uint64(0) >> (np.uint64(64) - hi))
        counter = [np.zeros_like(alive) for _ in range(width)]
        for p in range(0, BITS, 3):
            a = planes[p][w] ^ ask[p][q]
            if p + 2 < BITS:
                b, c = planes[p + 1][w] ^ ask[p + 1][q], planes[p + 2][w] ^ ask[p + 2][q]
                x = a ^ b
                ones, twos = x ^ c, (a & b) | (x & c)
            else:
                ones, twos = a, None
            over = np.zeros_like(alive)
            for start, carry in ((0, ones), (1, twos)):
                if carry is None:
                    continue
                for i in range(start, width):
                    counter[i], carry = counter[i] ^ carry, counter[i] & carry
                over |= carry
            alive &= ~(over | _more_than(counter, radius))
            if p % 9 == 6:
                live = alive != 0
                if live.mean() < 0.7:
                    q, w, alive = q[live], w[live], alive[live]
                    counter = [c[live] for c in counter]
                    if not len(q):
                        break
        live = alive != 0
        if live.any():
            q, w, alive = q[live], w[live], alive[live]
            r, lane = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8),
                                               axis=1, bitorder="little"))
            yield q[r], w[r] * 64 + lane


def spanning_links(fps: np.ndarray, runs: np.ndarray, radius: int):
    """(fp, root fp) of every fingerprint that links to a smaller index of its run."""
    n = len(fps)
    cut = np.flatnonzero(np.r_[runs[1:] != runs[:-1], True]) + 1
    ends = np.repeat(cut, np.diff(np.r_[0, cut]))
    label = np.arange(n)
    for a, b in linked_lanes(fps, ends, radius):
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _compare(radius, chunk_rows=1 << 15):
    def run(batches):
        held = None
        def flush(mask, key, fp):
            runs = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            a, b = spanning_links(fp.astype(np.uint64), runs, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)),
                                               pa.array(b.astype(np.int64))], names=["a", "b"])
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) < chunk_rows:
                continue
            mask, key, _ = held
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            if len(new):
                yield flush(*[x[:new[-1]] for x in held])
                held = [x[new[-1]:] for x in held]
        if held is not None and len(held[0]):
            yield flush(*held)
    return run


# --- buckets -----------------------------------------------------------------------------

def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def refine_mask(mask: int, radius: int) -> list[int]:
    """The masks below ``mask``: its bits and one of radius + 1 parts of the bits it lacks."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    parts = np.array_split(np.array(free), radius + 1)
    return [mask | sum(1 << int(i) for i in p) for p in parts if len(p)]


def _keyed(rows: DataFrame, table: list[tuple[int, int]]) -> DataFrame:
    """Rows (parent, fp) times the child masks of their parent: (mask, key, fp)."""
    pairs = F.array(*[F.struct(F.lit(_signed(p)).alias("p"), F.lit(_signed(c)).alias("c"))
                      for p, c in table])
    return (rows.select("parent", "fp", F.explode(pairs).alias("m")).where("m.p = parent")
            .select(F.col("m.c").alias("mask"), F.col("fp").bitwiseAND(F.col("m.c")).alias("key"),
                    "fp"))


def fingerprint_links(fps: DataFrame, radius: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` within ``radius`` bits.

    ``fps`` has one distinct ``fp`` a row. Cutting needs more than ``radius``
    free bits; buckets with fewer hold at most 2 ** radius rows and are compared.
    """
    bucket_rows = max(bucket_rows, 1 << radius)
    spark, n = fps.sparkSession, partitions(fps.sparkSession)
    table = [(0, m) for first in refine_mask(0, radius) for m in refine_mask(first, radius)]
    rows, found = fps.select(F.lit(0).cast("long").alias("parent"), "fp"), []
    while True:
        keyed = _keyed(rows, table)
        crowd = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(keyed.join(crowd, ["mask", "key"]), "simhash-buckets")
        small = shared.where(F.col("n") <= bucket_rows)
        found.append((small.select("mask", "key", "fp").repartition(n, "mask", "key")
                      .sortWithinPartitions("mask", "key", "fp")
                      .mapInArrow(_compare(radius), "a long, b long")))
        hot = shared.where(F.col("n") > bucket_rows)
        masks = [r[0] for r in hot.select("mask").distinct().collect()]  # at most len(table)
        if not masks:
            break
        rows = hot.select(F.col("mask").alias("parent"), "fp")
        table = [(m % (1 << 64), c) for m in masks for c in refine_mask(m % (1 << 64), radius)]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), by large-star / small-star rounds."""
    edges = stored(links.where("a <> b").distinct(), "components")
    last = None
    while True:
        for small in (False, True):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            if small:
                both = both.where("b < a")
            low = both.groupBy("a").agg(F.min("b").alias("low"))
            low = low.withColumn("low", F.least("a", "low"))
            near = both.join(low, "a")
            if small:
                turned = near.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
                    low.select("a", F.col("low").alias("b")))
            else:
                turned = near.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            edges = stored(turned.where("a <> b").distinct(), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classes(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, first): the first (null ids last) of the rows of each fingerprint's component."""
    order = F.struct(F.col("doc_key").isNull().alias("none"), "doc_key", "doc_hash")
    own = stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    roots = components(fingerprint_links(own.select("fp"), radius, bucket_rows))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    return named.join(best, "root").select("fp", F.col("best").alias("first"))


def _named(docs: DataFrame, key: Column, text: Column, shingle: int, seed: int) -> DataFrame:
    """(doc_key, doc_hash, fp) of every row; the hash names id and text in 128 bits."""
    return with_fingerprints(docs, [key.alias("doc_key"), row_name(key, text).alias("doc_hash")],
                             text, shingle, seed)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                radius: int = 2, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: (key, fingerprint, component_id)."""
    rows = stored(_named(docs, F.col(f"`{key}`"), F.col(f"`{text}`"), shingle, seed), "simhash")
    classes = _classes(rows, radius, bucket_rows)
    return rows.join(classes, "fp").select(
        F.col("doc_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_key").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                         radius: int = 2, seed: int = 42,
                         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest id of each component.

    Repeats of that row (same id and text) stay as one.
    """
    wide, names = numbered(docs)
    id_, text_ = (F.col(f"c{names.index(c)}") for c in (key, text))
    rows = stored(_named(wide, id_, text_, shingle, seed), "simhash")
    kept = _classes(rows, radius, bucket_rows).select("first.doc_hash").distinct()
    return (wide.withColumn("doc_hash", row_name(id_, text_)).join(kept, "doc_hash", "left_semi")
            .dropDuplicates(["doc_hash"]).select(*wide.columns).toDF(*names))
