"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern. The distinct
pre-tokens of a batch are held as one ragged numpy array of symbol ids; every
round looks up the rank of each adjacent pair, merges the lowest-rank pair of
every sequence at once (leftmost first, non-overlapping), and compacts the
arrays, until no pair has a rank. The symbols that survive are the tokens. Each
task keeps the counts of the pre-tokens it has met in a table of bounded size.

Strings of special tokens inside a text are one token each, as the tokenizer's
library treats them by default.

Nulls: a null text is empty and has no tokens. Repeated rows are counted alike.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHE_ENTRIES = 400_000
_BATCH_SYMBOLS = 1 << 20


def byte_symbols() -> dict[int, str]:
    """The printable character by which the vocabulary file writes each byte.

    Printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """Merge ranks of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        names = byte_symbols()
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int64)
        left, right, out = [], [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            out.append(vocab[a + b])
        self.base = max(vocab.values()) + 1
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.out = keys[order], order, np.array(out, np.int64)[order]
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])),
                              key=len, reverse=True)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that survive all merges, for each non-empty byte string."""
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sym = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), lens)
        result = lens.copy()
        none = len(self.keys)
        while len(sym):
            pair = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            hit = (self.keys[at] == pair) & (seq[:-1] == seq[1:])
            rank = np.where(hit, self.rank[at], none)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            size = np.diff(np.r_[starts, len(seq)])
            go = lowest < none
            here = np.repeat(lowest, size)[:-1]
            take = (rank == here) & (rank < none)
            # of adjacent equal pairs every second one merges, from the left
            idx = np.flatnonzero(take)
            if not len(idx):
                break
            run = np.r_[True, np.diff(idx) != 1]
            place = np.arange(len(idx)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            idx = idx[place % 2 == 0]
            sym = sym.copy()
            sym[idx] = self.out[at[idx]]
            keep = np.ones(len(sym), bool)
            keep[idx + 1] = False
            np.subtract.at(result, seq[idx], 1)
            # sequences without a ranked pair are settled and leave the arrays
            keep &= np.repeat(go, size)
            sym, seq = sym[keep], seq[keep]
        return result


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


class Counting:
    """Counts tokens of texts with one bounded table of known pre-tokens."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.merges, self.entries, self.known = _merges(path), entries, {}
        self.find = regex.compile(PATTERN).findall
        self.cut = None
        if self.merges.special:
            self.cut = regex.compile("|".join(map(regex.escape, self.merges.special)))

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.entries:
            self.known.clear()
        batch, size = [], 0
        for t in [*new, None]:
            b = t.encode("utf-8", "surrogatepass") if t is not None else b""
            if batch and (t is None or size + len(b) > _BATCH_SYMBOLS):
                self.known.update(zip([x for x, _ in batch],
                                      self.merges.counts([x for _, x in batch]).tolist()))
                batch, size = [], 0
            if t is not None:
                batch.append((t, b))
                size += len(b)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts' new pre-tokens are merged together."""
        cuts, plain = [0] * len(texts), []
        for i, t in enumerate(texts):
            if self.cut is not None and any(s in t for s in self.merges.special):
                parts = self.cut.split(t)
                cuts[i] = len(parts) - 1
                plain.append([x for p in parts for x in self.find(p)])
            else:
                plain.append(self.find(t))
        fresh = set().union(*plain).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > self.entries:
                fresh = set().union(*plain)
            self._learn(list(fresh))
        get = self.known.__getitem__
        return [c + sum(map(get, p)) for c, p in zip(cuts, plain)]


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                 limit: int = 512, group_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: (key, n_bytes, n_tokens, over_limit).

    ``vocabulary`` is the path of a byte-level BPE file that every executor can
    open. Texts are worked off in groups of about ``group_bytes``.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        counting = Counting(vocabulary)
        for b in batches:
            texts = b.column("__text")
            n, sizes, group, held = [], [], [], 0
            for t in texts:
                t = t.as_py()
                size = len(t.encode("utf-8", "surrogatepass"))
                sizes.append(size)
                group.append(t)
                held += size
                if held >= group_bytes:
                    n += counting.count(group)
                    group, held = [], 0
            n += counting.count(group) if group else []
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    schema = (docs.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"),
                          F.lit(0).cast("long").alias("n_tokens"),
                          F.lit(True).alias("over_limit"))).schema
    return rows.mapInArrow(run, schema)
