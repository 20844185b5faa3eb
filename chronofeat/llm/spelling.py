"""Grouping of spelling variants by k-d trees over letter counts.

Words are counted over the whole corpus. Two words are near if they differ by
one inserted, deleted or replaced letter; a word's form is its most frequent near
word, if that is at least ``ratio`` times as frequent; its root is where the
chain of forms ends.

One edit changes a word's letter counts by a vector of L1 length one or two: a
replaced letter takes one count away and adds one, an inserted letter adds one.
So near words are found among words of two lengths at a time, the same or one
more:

1. Cells. For each length the top of a k-d tree over letter counts is built from a
   bounded sample of the words (``SAMPLE_WORDS``; it decides only how evenly cells
   fill). Its leaves are the cells of the whole vocabulary. A word goes as a point
   to its cell, and as a query to every cell whose box lies within one count taken
   away and one added (same length; cells of larger number only, so a pair meets
   once) or within one added (one letter longer).
2. Search. A task builds the tree of each of its cells down to a few points and
   passes the queries through it, pruning by the tight boxes of the nodes. Points
   whose counts fit are compared letter by letter.
3. Totals. A task adds up what it found for each word (a number, and the best near
   word) before the shuffle, so pairs are never written.
4. Roots. Forms are at least ``ratio`` times as frequent as their words, so chains
   are short; roots come down from words without a form, one join a level.

Letters are runs of ``[A-Za-z\\u00C0-\\u00FF]``; only A-Z are lower-cased.

Nulls: a null text has no words; a null id counts as the empty id where ids
enter the deletion rule. Ties in frequency go to the smaller word by code points.
Repeated rows count as often as they occur. Very long texts and very long words
are treated whole (a cell of long words is compared in smaller blocks). An empty
table gives no rows. Other columns are ignored; names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
DELETE_EVERY = 97
SAMPLE_WORDS = 1 << 17
CELL_WORDS = 2048
MOST_CELLS = 4096
BUCKET = 16
_BLOCK = 1 << 22
_POINT, _SAME, _SHORTER = 0, 1, 2


def _lowered(word: Column) -> Column:
    """A-Z lower-cased; ``lower`` does that on pure ASCII and is cheaper there."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, UPPER.lower()))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text",
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
               delete_every: int | None = DELETE_EVERY) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` letters that occur ``min_count`` times.

    With ``delete_every``, a run whose CRC-32 (of id, colon and run) it divides
    loses the letter at that number modulo the run's length.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("id", _lowered(F.col("run")).alias("w"))
    word = F.col("w")
    if delete_every:
        h = F.crc32(F.concat_ws(":", "id", "w").cast("binary"))
        at = (h % F.length("w")).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        word = F.when(h % delete_every == 0, cut).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _letters(words: list[str]) -> np.ndarray:
    """Letters of equally long words as numbers: a-z from 0, then U+00C0 to U+00FF from 26."""
    code = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return np.where(code >= 192, code - 166, code - 97).astype(np.uint8)


ALPHABET = 26 + 64


def _counts(letters: np.ndarray) -> np.ndarray:
    """Letter counts of each word."""
    n, length = letters.shape
    where = np.arange(n)[:, None] * ALPHABET + letters
    out = np.bincount(where.ravel(), minlength=n * ALPHABET).reshape(n, ALPHABET)
    return out.astype(np.int16 if length < 1 << 15 else np.int32)


def _split(counts: np.ndarray):
    """(letter, count) that cuts the rows most evenly into at most and more, or None."""
    best, n = None, len(counts)
    for d in np.flatnonzero(counts.min(axis=0) < counts.max(axis=0)):
        below = np.cumsum(np.bincount(counts[:, d]))[:-1]
        t = int(np.abs(below * 2 - n).argmin())
        if 0 < below[t] < n and (best is None or abs(below[t] * 2 - n) < best[0]):
            best = abs(below[t] * 2 - n), int(d), t
    return best and best[1:]


class TopTree:
    """The cells of the words of one length: nodes (letter, count, left, right) or a cell number."""

    def __init__(self, counts: np.ndarray, leaf: int, first_cell: int):
        self.nodes, self.cells = [], first_cell
        self._grow(counts, leaf)

    def _grow(self, counts: np.ndarray, leaf: int) -> int:
        me, cut = len(self.nodes), _split(counts) if len(counts) > leaf else None
        self.nodes.append(None)
        if cut is None:
            self.nodes[me] = self.cells
            self.cells += 1
            return me
        d, t = cut
        below = counts[:, d] <= t
        self.nodes[me] = (d, t, self._grow(counts[below], leaf), self._grow(counts[~below], leaf))
        return me

    def reach(self, counts: np.ndarray, away: int, added: int):
        """(row, cell) of all cells within ``away`` counts taken away and ``added`` added."""
        rows, cells = [], []
        none = np.zeros(len(counts), np.int32)
        todo = [(0, np.arange(len(counts)), none, none, {}, {})]
        while todo:
            node, at, less, more, low, high = todo.pop()
            if not len(at):
                continue
            if not isinstance(self.nodes[node], tuple):
                rows.append(at)
                cells.append(np.full(len(at), self.nodes[node]))
                continue
            d, t, left, right = self.nodes[node]
            x = counts[at, d].astype(np.int32)
            # left: the count may be at most t; right: at least t + 1
            new = less + np.maximum(x - t, 0) - (np.maximum(x - high[d], 0) if d in high else 0)
            go = new <= away
            todo.append((left, at[go], new[go], more[go], low, {**high, d: t}))
            new = more + np.maximum(t + 1 - x, 0) - (np.maximum(low[d] - x, 0) if d in low else 0)
            go = new <= added
            todo.append((right, at[go], less[go], new[go], {**low, d: t + 1}, high))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(cells)


def top_trees(words: DataFrame, sample: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS,
              most_cells: int = MOST_CELLS) -> dict[int, TopTree]:
    """A tree for each length of the vocabulary, from at most ``sample`` words or so."""
    sizes = {r.l: r.n for r in words.groupBy(F.length("word").alias("l")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    share = min(1.0, sample / max(1, total))
    taken = words.where(F.xxhash64("word").cast("double") / 2.0 ** 63 <= 2.0 * share - 1.0)
    taken = taken.orderBy(F.xxhash64("word")).limit(sample).select("word").collect()
    by_length = {}
    for r in taken:
        by_length.setdefault(len(r.word), []).append(r.word)
    trees, cells = {}, 0
    leaf = max(cell_words, -(-total // most_cells)) * share  # in sampled words
    for length in sorted(sizes):
        some = sorted(by_length.get(length, []))
        counts = _counts(_letters(some)) if some else np.zeros((0, ALPHABET), np.int16)
        trees[length] = TopTree(counts, max(1.0, leaf), cells)
        cells = trees[length].cells
    return trees


_SENT = "cell int, kind int, word string, n long"


def _send(shared):
    """Words as points and queries of the cells."""
    def block(words, ns, cell, kind, row):
        return pa.RecordBatch.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(np.full(len(row), kind), pa.int32()),
             words.take(pa.array(row)), ns.take(pa.array(row))], names=["cell", "kind", "word", "n"])

    def run(batches):
        trees = shared.value
        for b in batches:
            words, ns = b.column("word"), b.column("n")
            text = words.to_pylist()
            length = np.array([len(w) for w in text], np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                step = max(1, _BLOCK // max(int(size), ALPHABET))
                for at in range(0, len(mine), step):
                    some = mine[at:at + step]
                    counts = _counts(_letters([text[i] for i in some]))
                    row, own = trees[size].reach(counts, 0, 0)
                    yield block(words, ns, own, _POINT, some[row])
                    home = np.empty(len(some), np.int64)
                    home[row] = own
                    row, cell = trees[size].reach(counts, 1, 1)
                    go = cell > home[row]
                    yield block(words, ns, cell[go], _SAME, some[row[go]])
                    if size + 1 in trees:
                        row, cell = trees[size + 1].reach(counts, 0, 1)
                        yield block(words, ns, cell, _SHORTER, some[row])
    return run


class _Node:
    __slots__ = ("low", "high", "left", "right", "at")


def _tree(counts: np.ndarray, at: np.ndarray, bucket: int) -> _Node:
    node, mine = _Node(), counts[at]
    node.low, node.high, node.left, node.at = mine.min(axis=0), mine.max(axis=0), None, at
    cut = _split(mine) if len(at) > bucket else None
    if cut is not None:
        below = mine[:, cut[0]] <= cut[1]
        node.left = _tree(counts, at[below], bucket)
        node.right = _tree(counts, at[~below], bucket)
    return node


def _within(tree: _Node, points: np.ndarray, asked: np.ndarray, away: int, added: int):
    """Blocks (query, point) whose counts differ by at most ``away`` and ``added``."""
    todo = [(tree, np.arange(len(asked)))]
    step = max(1, _BLOCK // (BUCKET * asked.shape[1]))
    while todo:
        node, at = todo.pop()
        if len(at) > step * BUCKET:
            todo += [(node, at[i:i + step * BUCKET]) for i in range(0, len(at), step * BUCKET)]
            continue
        x = asked[at]
        fits = np.maximum(x - node.high, 0).sum(axis=1) <= away
        fits &= np.maximum(node.low - x, 0).sum(axis=1) <= added
        at = at[fits]
        if not len(at):
            continue
        if node.left is not None:
            todo += [(node.left, at), (node.right, at)]
            continue
        for i in range(0, len(at), step):
            for j in range(0, len(node.at), BUCKET):
                some, there = at[i:i + step], node.at[j:j + BUCKET]
                gap = asked[some][:, None, :] - points[there][None]
                near = (np.maximum(gap, 0).sum(axis=2) <= away) & (
                    np.maximum(-gap, 0).sum(axis=2) <= added)
                q, p = np.nonzero(near)
                if len(q):
                    yield some[q], there[p]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of letters ``b`` is ``a`` with one letter replaced or one inserted."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a != b[:, :-1], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), size)
    last = np.where(behind.any(axis=1), size - behind[:, ::-1].argmax(axis=1), 0)
    return first >= last


class _Found:
    """What a task has found for its words: how many near words, and the best of them."""

    def __init__(self):
        self.near = {}

    def add(self, words, ns, others, other_ns):
        for w, o, n in zip(words, others, other_ns):
            known = self.near.get(w)
            if known is None:
                self.near[w] = [1, n, o]
            else:
                known[0] += 1
                if n > known[1] or n == known[1] and o < known[2]:
                    known[1], known[2] = n, o

    def flush(self):
        if self.near:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(self.near), pa.string()),
                 *[pa.array(c, t) for c, t in zip(zip(*self.near.values()),
                                                  (pa.int64(), pa.int64(), pa.string()))]],
                names=["word", "n_near", "form_n", "form"])
        self.near = {}


class _Cell:
    """The points of one cell, searched by blocks of queries."""

    def __init__(self, words: list[str], ns: list[int]):
        self.words, self.ns = words, ns
        self.letters = _letters(words)
        self.counts = _counts(self.letters)
        self.tree = _tree(self.counts, np.arange(len(words)), BUCKET)

    def search(self, words, ns, kind, found: _Found):
        letters = _letters(words)
        away, added = (0, 1) if kind == _SHORTER else (1, 1)
        for q, p in _within(self.tree, self.counts, _counts(letters), away, added):
            if kind == _POINT:  # the cell's own words: each pair once
                q, p = q[q < p], p[q < p]
            if not len(q):
                continue
            ok = one_edit(letters[q], self.letters[p])
            q, p = q[ok].tolist(), p[ok].tolist()
            here, there = [words[i] for i in q], [self.words[i] for i in p]
            found.add(here, [0] * len(q), there, [self.ns[i] for i in p])
            found.add(there, [0] * len(q), here, [ns[i] for i in q])


def _search(batches):
    """Near words found in the cells of a task: (word, n_near, form_n, form) in parts."""
    found, at, words, ns, cell = _Found(), None, [], [], None

    def ask():
        nonlocal cell, words, ns
        if words:
            if at[1] == _POINT:
                cell = _Cell(words, ns)
            if cell is not None:
                cell.search(words, ns, at[1], found)
        words, ns = [], []

    for b in batches:
        cells, kinds = b.column("cell").to_numpy(), b.column("kind").to_numpy()
        text, times = b.column("word").to_pylist(), b.column("n").to_pylist()
        fresh = np.flatnonzero(np.r_[True, (np.diff(cells) != 0) | (np.diff(kinds) != 0)]
                               if len(cells) else [])
        for lo, hi in zip(fresh.tolist(), [*fresh.tolist()[1:], len(cells)]):
            now = int(cells[lo]), int(kinds[lo])
            if now != at:
                ask()
                if at is not None and now[0] != at[0]:
                    cell = None
                    if len(found.near) > 1 << 17:
                        yield from found.flush()
                at = now
            words += text[lo:hi]
            ns += times[lo:hi]
            if at[1] != _POINT and len(words) > 1 << 14:
                ask()
    if at is not None:
        ask()
    yield from found.flush()


def near_words(words: DataFrame, sample: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS,
               most_cells: int = MOST_CELLS) -> DataFrame:
    """(word, n_near, form_n, form): near words of each of ``words`` (word, n) that has any.

    ``form`` is the most frequent near word, whatever its frequency.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(top_trees(words, sample, cell_words, most_cells))
    sent = words.select("word", "n").mapInArrow(_send(shared), _SENT)
    parts = (sent.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "kind")
             .mapInArrow(_search, "word string, n_near long, form_n long, form string"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word of ``forms`` (word, form), where the chain of forms ends.

    A level resolves the words whose form was resolved on the level before; a
    word is the form of no more words than it has possible edits.
    """
    forms = forms.select("word", "form")
    tops = forms.select(F.col("form").alias("word")).distinct().join(forms, "word", "left_anti")
    level = stored(tops.select("word", F.col("word").alias("root")), "spelling-roots")
    done = []
    while True:
        level = stored(forms.join(level.select(F.col("word").alias("form"), "root"), "form")
                       .select("word", "root"), "spelling-roots")
        if level.isEmpty():
            break
        done.append(level)
    out = level
    for d in done:
        out = out.unionByName(d)
    return out


def variant_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                   delete_every: int | None = DELETE_EVERY, sample: int = SAMPLE_WORDS,
                   cell_words: int = CELL_WORDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per word: (word, n, n_near, form, form_n, root)."""
    words = stored(vocabulary(docs, key, text, min_length, min_count, delete_every),
                   "spelling-words")
    near = near_words(words, sample, cell_words, most_cells)
    both = words.join(near, "word", "left")
    accepted = F.col("form_n") >= F.col("n") * ratio
    known = stored(both.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(accepted, F.col("form")).alias("form"),
        F.when(accepted, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
