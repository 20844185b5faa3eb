"""Benchmark decontamination with SimHash windows (DataFrame functions only).

A document is contaminated by a benchmark item if some window of the item's
length in words has a weighted word-shingle similarity of ``threshold`` or more
with it (Jaccard over shingles counted as often as they occur; a document
shorter than the item is one window; items shorter than a shingle are compared
as one run of their own length).

1. Prefilter, without loss. A window of ``a`` shingles and an item of ``m`` are
   similar enough only if at least need = t (a + m) / (1 + t) shingles of the
   window are among the item's, so among the benchmark's. Shingles of every
   document meet the set of the benchmark's shingles; a document with too few
   hits for every item, and for an item's length what lies too far from the
   first and last hit, can hold no such window.
2. Fingerprints. Every window of each item's length of what is left gets its
   64-bit SimHash in one sliding pass: bit counts lie in lanes of 16 longs, a
   shingle adds its bits when it enters a window and takes them away when it
   leaves, and all lanes are compared with half the window at once.
3. Candidates. Multi-index Hamming search over the items of that length: 64 bits
   in ``blocks`` blocks; fingerprints within ``radius`` bits agree in some block
   up to radius // blocks bits, so the index holds every item under each block
   value that near, and one equi-join on (length, block, value) finds all pairs
   within the radius. A pair that several blocks find is kept once. At similarity
   0.8 a window differs from its item by 10 bits on average, with a deviation of
   3; what differs by more than ``radius`` bits is not a candidate.
4. Verification. The exact weighted similarity decides.

Comparison ignores letter case and the kind and amount of white space. What is
taken from the benchmark is broadcast only while its measured size is below
``broadcast_bytes``; the same joins shuffle otherwise.

Nulls: null and empty texts contaminate nothing and are never contaminated. Null
ids are ids. Ties: of equally good windows the first. Repeated rows are one
document, repeated items one item each by id. Very long texts are treated whole:
only the part between their first and last hit is cut into windows. An empty
benchmark or document table gives no rows. Other columns are ignored by
``contaminated`` and kept by ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, numbered, row_name, stored

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
BLOCKS = 8
BROADCAST_BYTES = 64 << 20


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of ``text`` in order (null or blank: empty array)."""
    t = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE_CHARS))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles of an array of word hashes (short texts: one shingle).

    The array is bound once by the outer ``transform``; referring to it from
    the inner lambda alone would compute it again for every shingle.
    """
    whole = F.transform(F.array(hashes), lambda h: F.when(
        F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))))
    return F.element_at(whole, 1)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash (signed long): a bit is 1 if set in over half of the hashes."""
    bits = F.transform(F.array(hashes), lambda a: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(
            F.aggregate(a, F.lit(0).cast("long"), lambda n, h: n + F.call_function(
                "shiftright", h, i).bitwiseAND(F.lit(1).cast("long"))) * 2 > F.size(a),
            F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
                F.lit(0).cast("long")))))
    return F.element_at(bits, 1)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as multisets: sum of the smaller over sum of the larger counts.

    If one side repeats nothing, the shared count is the size of the intersection.
    """
    def count(xs, x):
        return F.size(F.filter(xs, lambda y: y == x))

    def plain(xs):
        return F.size(F.array_distinct(xs)) == F.size(xs)
    shared = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: F.when(
        plain(p["a"]) | plain(p["b"]), F.size(F.array_intersect(p["a"], p["b"]))).otherwise(
            F.aggregate(F.array_intersect(p["a"], p["b"]), F.lit(0), lambda acc, x: acc + F.least(
                count(p["a"], x), count(p["b"], x)))) /
        F.greatest(F.lit(1), F.size(p["a"]) + F.size(p["b"])).cast("double"))
    half = F.element_at(shared, 1)  # shared / (|a| + |b|)
    return half / (F.lit(1.0) - half)


def _block(fp: Column, j: Column | int, width: int) -> Column:
    shift = F.lit(j * width) if isinstance(j, int) else j * width
    return F.call_function("shiftright", fp, shift).bitwiseAND(
        F.lit((1 << width) - 1).cast("long"))


def _small(df: DataFrame, size: int, limit: int) -> DataFrame:
    return F.broadcast(df) if size <= limit else df


def _need(a: Column, m: Column, threshold: float) -> Column:
    """Shingles that windows of ``a`` and items of ``m`` shingles must share."""
    return F.ceil((a + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)).cast("int")


def window_fingerprints(parts: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(*keys, at, fp): SimHash of every run of ``a`` hashes of ``part``, by its first place.

    ``parts`` has the keys (which name a row), ``a`` (at most ``longest``) and
    ``part``, an array of hashes that is not shorter.
    """
    width = 16 if longest < 1 << 14 else 32  # bits of a lane; the second highest is the flag
    lanes = sum(1 << (width * i) for i in range(64 // width))
    ones = F.lit(lanes).cast("long")

    def bits(x, k):
        return F.coalesce(F.call_function("shiftright", x, F.lit(k)).bitwiseAND(ones),
                          F.lit(0).cast("long"))

    leaving = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("a")),
                       F.slice("part", F.lit(1), F.size("part") - F.col("a")))
    rows = (parts.select(*keys, "a", F.col("part").alias("i"), leaving.alias("o"))
            .select(*keys, "a", F.posexplode(F.arrays_zip("i", "o")).alias("at", "z")))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select(*keys, "a", "at", *[
        F.sum(bits(F.col("z.i"), k) - bits(F.col("z.o"), k)).over(w).alias(f"n{k}")
        for k in range(width)]).where(F.col("at") >= F.col("a") - 1)
    # a lane reaches the flag bit if its count is over half of the window
    lift = (F.lit(1 << (width - 2)).cast("long") - F.floor(F.col("a") / 2) - 1) * ones
    fp = F.lit(0).cast("long")
    for k in range(width):
        flag = F.call_function("shiftright", F.col(f"n{k}") + lift, F.lit(width - 2))
        fp = fp.bitwiseOR(F.call_function("shiftleft", flag.bitwiseAND(ones), F.lit(k)))
    return counted.select(*keys, (F.col("at") - F.col("a") + 1).alias("at"), fp.alias("fp"))


def _items(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(no, item, words, m, shingles, item_fp) of the items that have words."""
    some = benchmark.select(F.col(f"`{item}`").alias("item"),
                            word_hashes(F.col(f"`{text}`")).alias("h")).where(F.size("h") > 0)
    some = some.select(F.monotonically_increasing_id().alias("no"), "item",
                       F.size("h").alias("words"), shingles(F.col("h"), size).alias("shingles"))
    return stored(some.withColumn("m", F.size("shingles")).withColumn(
        "item_fp", simhash(F.col("shingles"))), "benchmark-items")


def _windows(docs: DataFrame, key: str, text: str, items: DataFrame, size: int, threshold: float,
             limit: int):
    """Hit documents (name, doc_key, n, h, all), and their windows (name, words, m, at, a, fp)."""
    lengths = sorted((r.words, r.m) for r in items.select("words", "m").distinct().collect())
    short = sorted({w for w, _ in lengths if w < size})
    known = stored(items.select(F.explode("shingles").alias("s")).distinct(), "benchmark-shingles")
    known = _small(known, known.count() * 16, limit)
    least = min([m for w, m in lengths if w >= size], default=1)

    id_, text_ = F.col(f"`{key}`"), F.col(f"`{text}`")
    hashed = docs.select(id_.alias("doc_key"), row_name(id_, text_).alias("name"),
                         word_hashes(text_).alias("h")).where(F.size("h") > 0)
    every = shingles(F.col("h"), size)
    runs = F.concat(*[F.transform(shingles(F.col("h"), w), lambda s, i: F.struct(
        F.lit(w).alias("w"), i.alias("p"), s.alias("s"))) for w in [size, *short]])
    spots = hashed.select("name", F.explode(runs).alias("r")).select("name", "r.*") if short else \
        hashed.select("name", F.lit(size).alias("w"), F.posexplode(every).alias("p", "s"))
    hits = spots.join(known, "s", "left_semi")
    long_ = F.col("w") == size
    marked = stored(hits.groupBy("name").agg(
        F.count(F.when(long_, 1)).alias("hits"), F.min(F.when(long_, F.col("p"))).alias("first"),
        F.max(F.when(long_, F.col("p"))).alias("last"),
        F.collect_set(F.when(~long_, F.struct("w", "p", "s"))).alias("short"))
        .where((F.col("hits") >= F.lit(threshold * least - 1e-9)) | (F.size("short") > 0)),
        "benchmark-hits")
    marked = _small(marked, marked.count() * 256, limit)
    found = stored(hashed.join(marked, "name").dropDuplicates(["name"]).select(
        "name", "doc_key", "hits", "first", "last", "short", "h", every.alias("all"),
        F.size("h").alias("n")), "benchmark-documents")

    pairs = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(m).alias("m"))
                      for w, m in lengths if w >= size] or [F.lit(None).cast(
                          "struct<words:int,m:int>")])
    whole = F.size("all")
    fits = F.filter(pairs, lambda x: F.col("hits") >= _need(F.least(x["m"], whole), x["m"],
                                                            threshold))
    cut = (found.select("name", "first", "last", "all", F.explode(fits).alias("x"))
           .withColumn("a", F.least("x.m", whole))
           .withColumn("slack", F.col("a") - _need(F.col("a"), F.col("x.m"), threshold))
           .withColumn("from", F.greatest(F.lit(0), F.col("first") - F.col("slack")))
           .withColumn("to", F.least(whole - 1, F.col("last") + F.col("slack")))
           .where(F.col("to") - F.col("from") + 1 >= F.col("a"))
           .select("name", F.col("x.words").alias("words"), F.col("x.m").alias("m"), "a", "from",
                   F.slice("all", F.col("from") + 1, F.col("to") - F.col("from") + 1)
                   .alias("part")))
    keys = ["name", "words", "m", "from"]
    slid = window_fingerprints(cut, keys, max([m for _, m in lengths], default=1))
    slid = slid.select("name", "words", "m", (F.col("from") + F.col("at")).alias("at"), "fp")
    # windows shorter than a shingle are one run, whose hash is their fingerprint
    runs_ = found.select("name", F.explode("short").alias("r")).select(
        "name", F.col("r.w").alias("words"), F.lit(1).alias("m"), F.col("r.p").alias("at"),
        F.col("r.s").alias("fp"))
    return found, stored(slid.unionByName(runs_), "benchmark-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", size: int = SHINGLE,
                 threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_key, doc_hash, item, similarity, window_start, window_words, differing_bits).

    One row per document and item that match, with the best window (of equally
    good ones the first).
    """
    width = 64 // blocks
    near = radius // blocks
    items = _items(benchmark, item, item_text, size)
    found, windows = _windows(docs, key, text, items, size, threshold, broadcast_bytes)

    flips = [x for x in range(1 << width) if bin(x).count("1") <= near]
    index = items.select("no", "words", "item_fp", F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    index = stored(index.select("no", "words", "item_fp", "block", F.explode(F.transform(
        F.array(*[F.lit(x).cast("long") for x in flips]),
        lambda x: _block(F.col("item_fp"), F.col("block"), width).bitwiseXOR(x))).alias("value")),
        "benchmark-index")
    index = _small(index, index.count() * 64, broadcast_bytes)
    asked = windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("value", _block(F.col("fp"), F.col("block"), width))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(None).cast("int")
    for j in reversed(range(blocks)):
        first = F.when(F.bit_count(_block(differ, j, width)) <= near, F.lit(j)).otherwise(first)
    pairs = (asked.join(index, ["words", "block", "value"])
             .where((F.bit_count(differ) <= radius) & (F.col("block") == first))
             .select("name", "no", "words", "m", "at", F.bit_count(differ).alias("bits")))

    texts = items.select("no", "item", "shingles")
    held = texts.agg(F.sum(F.size("shingles") * 8 + 64)).first()[0] or 0
    both = pairs.join(found.select("name", "doc_key", "n", "all"), "name").join(
        _small(texts, held, broadcast_bytes), "no")
    window = F.when(F.col("words") < size, F.array(F.col("shingles")[0])).otherwise(
        F.slice("all", F.col("at") + 1, F.col("m")))
    scored = both.select("doc_key", "name", "item", "at", F.least("words", "n").alias("words"),
                         "bits", F.when((F.col("words") < size) & (F.col("bits") > 0), 0.0)
                         .otherwise(weighted_similarity(window, F.col("shingles")))
                         .alias("similarity"))
    best = (scored.where(F.col("similarity") >= threshold - 1e-12)
            .groupBy("doc_key", "name", "item")
            .agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"), "words", "bits"))
                 .alias("b")))
    return best.select("doc_key", F.col("name").alias("doc_hash"), "item",
                       F.col("b.similarity").alias("similarity"),
                       (-F.col("b.back")).alias("window_start"),
                       F.col("b.words").alias("window_words"),
                       F.col("b.bits").alias("differing_bits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                      text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    wide, names = numbered(docs)
    id_, text_ = (f"c{names.index(c)}" for c in (key, text))
    found = stored(contaminated(wide, benchmark, id_, text_, **options)
                   .select("doc_hash").distinct(), "contaminated")
    limit = options.get("broadcast_bytes", BROADCAST_BYTES)
    marked = wide.withColumn("doc_hash", row_name(F.col(id_), F.col(text_)))
    return (marked.join(_small(found, found.count() * 64, limit), "doc_hash", "left_anti")
            .select(*wide.columns).toDF(*names))
