"""SentencePiece encoding with byte spans, and decoding.

1. Normalisation. A model's compiled character map (a double-array trie and a
   pool of replacements) is searched for the longest prefix at each position;
   without a match one character stands for itself. Each byte written records
   the source byte it came from, so the normalised text carries its alignment.
   An invalid UTF-8 byte becomes U+FFFD.
2. Pieces. The normalised text is cut before each run of the space mark (exact
   where no piece holds the mark after another character, which is read off the
   vocabulary; otherwise a text is one stretch), and between letters and other
   characters where no piece joins them. In a stretch the adjacent pair that
   makes the best-scored piece is joined, leftmost first, until none is left;
   characters outside the vocabulary become byte pieces. New stretches of a group
   of texts are joined together in ragged arrays; every worker keeps those it has
   met in a table of bounded size.
3. Spans. Pieces tile the normalised text, so prefix sums of their lengths,
   looked up in the alignment, give each piece its span of source bytes. Of the
   byte pieces of one character the last has its span, the others are empty, as
   is an added end piece.

Supported are BPE models with byte fallback and normal, control, unknown and
byte pieces; others are refused by name.

Nulls: a null text is empty; empty texts have the end piece alone. A null id
stays null. Very long texts are encoded whole, in memory in proportion to one
text; a long stretch is merged by a heap. Ties in score go to the leftmost pair.
Repeated rows are encoded alike. An empty table gives no rows. Other columns are
ignored, and a key of any name can be used.
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
MARK_BYTES = MARK.encode()
TABLE_ENTRIES = 800_000
GROUP_BYTES = 1 << 20
_SHORT = 256
_BATCH_CHARS = 1 << 18
_ID_BITS = 21
_ID_MASK = np.uint32((1 << _ID_BITS) - 1)
#: Piece types and the BPE model type of the model file format.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2

codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class CharacterMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest key that starts at ``at``."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1]:self.pool.index(b"\0", found[1])]


def _plain_char(text: bytes, at: int) -> tuple[int, bytes]:
    """One character at ``at``, or U+FFFD for one invalid byte."""
    lead = text[at]
    size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    char = text[at:at + size]
    try:
        char.decode("utf-8")
        return size, char
    except UnicodeDecodeError:
        return 1, "�".encode()


class Normaliser:
    """Normalised text and its alignment, by a model's normaliser settings."""

    def __init__(self, spec, suffix: bool = False):
        if suffix:
            raise ValueError("white space as a suffix is not supported")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK_BYTES if spec.escape_whitespaces else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, alignment): byte i comes from source byte alignment[i]; one entry more."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            return self._identity(text)
        return self._mapped(text)

    def _identity(self, text: bytes) -> tuple[bytes, np.ndarray]:
        try:
            text.decode("utf-8")
        except UnicodeDecodeError:
            return self._mapped(text)
        raw = np.frombuffer(text, np.uint8)
        align = np.arange(len(raw) + 1)
        if len(self.space) > 1:
            align = np.repeat(align, np.r_[np.where(raw == 32, len(self.space), 1), 1])
        out = text.replace(b" ", self.space)
        if self.prefix:
            out = self.space + out
            align = np.r_[np.zeros(len(self.space), align.dtype), align]
        return out, align

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        return (self.map and self.map.longest(text, at)) or _plain_char(text, at)

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at = 0
        while self.squeeze and at < len(text):
            size, new = self._step(text, at)
            if new != b" ":
                break
            at += size
        if at == len(text):
            return b"", np.array([at])
        out, align = bytearray(), []
        if self.prefix:
            out += self.space
            align += [at] * len(self.space)
        spaced = self.squeeze
        while at < len(text):
            size, new = self._step(text, at)
            if spaced:
                new = new.lstrip(b" ")
            if new:
                spaced = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", self.space)
                out += new
                align += [at] * len(new)
            at += size
        while self.squeeze and out.endswith(self.space):
            at = align[-len(self.space)]
            del out[-len(self.space):], align[-len(self.space):]
        return bytes(out), np.array([*align, at])


def _stretches(pieces) -> str:
    """A pattern of stretches that no merge crosses, read off the vocabulary.

    Characters that stand side by side in a piece belong together; a text is cut
    between characters that do not, and before marks. If a piece holds a mark
    after another character, a whole text is one stretch.
    """
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return r"(?s:.+)"
    group = {}

    def find(c):
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    for p in pieces:
        chars = p.lstrip(MARK)
        for x, y in zip(chars, chars[1:]):
            group[find(x)] = find(y)
    together = {}
    for c in group:
        together.setdefault(find(c), []).append(c)
    some = ["[" + "".join(map(re.escape, sorted(g))) + "]++" for g in
            sorted(together.values(), key=len, reverse=True)]
    return rf"{MARK}*+(?:{'|'.join([*some, f'[^{MARK}]'])})|{MARK}+"


class Pieces:
    """Vocabulary, merging and decoding of one model file."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            self._read(sentencepiece_model_pb2.ModelProto.FromString(f.read()))
        self.entries, self.known, self.old = entries, {}, {}

    @classmethod
    def of(cls, proto, entries: int = TABLE_ENTRIES) -> "Pieces":
        made = cls.__new__(cls)
        made._read(proto)
        made.entries, made.known, made.old = entries, {}, {}
        return made

    def _read(self, proto) -> None:
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        if proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("denormalising models are not supported")
        self.normalise = Normaliser(proto.normalizer_spec,
                                    proto.trainer_spec.treat_whitespace_as_suffix)
        self.leading = self.normalise.prefix or self.normalise.squeeze
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes, self.surface = np.zeros(256, np.int64), []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode())
        self.marked = [p.type == NORMAL and p.piece.startswith(MARK) for p in proto.pieces]
        self.end = proto.trainer_spec.eos_id
        self.stretches = re.compile(_stretches(normal))
        self._pairs(normal, [-p.score for p in proto.pieces])

    def _pairs(self, normal: dict[str, int], cost: list[float]) -> None:
        """Which two symbols make which piece, by sorted keys; characters as symbols.

        Characters that occur in pieces without being one get numbers after the
        vocabulary's; all other unknown characters share the last number.
        """
        self.size = len(cost)
        if self.size >= 1 << _ID_BITS or max(map(len, normal), default=0) * 4 >= 1 << 32 - _ID_BITS:
            raise ValueError("vocabulary or pieces too large for packed pieces")
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p} - set(normal)):
            symbols[char] = self.size + len(symbols) - len(normal)
        self.base = self.size + len(symbols) - len(normal) + 1
        self.chars = np.full(0x110000, self.base - 1, np.int32)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        keys, made = [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                x, y = symbols.get(piece[:k]), symbols.get(piece[k:])
                if x is not None and y is not None:
                    keys.append(x * self.base + y)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        made = np.array(made, np.int64)[order]
        self.keys, self.made = np.array([*np.array(keys, np.int64)[order], -1]), np.r_[made, 0]
        _, rank = np.unique(np.array(cost)[made], return_inverse=True)
        self.ranks = np.r_[rank, 0].astype(np.int64)

    def _joined(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray):
        """Symbols and first characters of all sequences once no adjacent pair makes a piece.

        Each round joins the best pair of every sequence, the leftmost of equals;
        sequences without one leave the arrays.
        """
        none, last, done = 1 << 40, len(self.keys) - 1, []
        while len(sym):
            pair = sym[:-1] * self.base + sym[1:]
            place = np.searchsorted(self.keys[:last], pair)
            rank = np.where((self.keys[place] == pair) & (seq[:-1] == seq[1:]), self.ranks[place],
                            none)
            rank = np.r_[rank, none]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(rank, starts)
            idx = np.flatnonzero((rank == np.repeat(lowest, size)) & (rank < none))
            idx = idx[np.r_[True, seq[idx[1:]] != seq[idx[:-1]]]] if len(idx) else idx
            stay = np.repeat(lowest < none, size)
            done.append((sym[~stay], at[~stay]))
            sym[idx] = self.made[place[idx]]
            stay[idx + 1] = False
            sym, seq, at = sym[stay], seq[stay], at[stay]
        sym, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        return sym[order], at[order]

    def _joined_long(self, sym: list[int], at: int):
        """The same for one long sequence, by a heap."""
        n, queue = len(sym), []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(pairs):
            pair = np.array([sym[i] * self.base + sym[j] for i, j in pairs])
            place = np.searchsorted(self.keys[:-1], pair)
            for (i, j), p, q in zip(pairs, place.tolist(), (self.keys[place] == pair).tolist()):
                if q:
                    heapq.heappush(queue, (int(self.ranks[p]), i, j, sym[i], sym[j], p))

        offer([(i, i + 1) for i in range(n - 1)])
        while queue:
            _, i, j, a, b, p = heapq.heappop(queue)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue  # one of the two has been joined since
            sym[i], sym[j] = int(self.made[p]), None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([x for x in ((before[i], i), (i, after[i])) if x[0] >= 0 and x[1] < n])
        left = [i for i in range(n) if sym[i] is not None]
        return np.array([sym[i] for i in left]), np.array(left) + at

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Packed pieces (id and normalised length) of new stretches."""
        text = "".join(fresh)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        lens = np.fromiter(map(len, fresh), np.int64, len(fresh))
        first = np.cumsum(lens) - lens
        sym, at = self.chars[code].astype(np.int64), np.arange(len(code))
        seq = np.repeat(np.arange(len(fresh)), lens)
        short = (lens <= _SHORT)[seq]
        found = [self._joined(sym[short], seq[short], at[short])] if short.any() else []
        found += [self._joined_long(sym[f:f + n].tolist(), f) for f, n in
                  zip(first[lens > _SHORT].tolist(), lens[lens > _SHORT].tolist())]
        sym, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at)
        sym, at = sym[order], at[order]
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        offset = np.r_[0, np.cumsum(width)]
        size = np.diff(offset[np.r_[at, len(code)]])
        # characters that are no piece become byte pieces; the last has the character's length
        plain = sym < self.size
        many = np.where(plain, 1, size)
        source = np.repeat(np.arange(len(sym)), many)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = np.where(plain[source], sym[source], self.bytes[raw[offset[at[source]] + nth]])
        size = np.where(nth == many[source] - 1, size[source], 0)
        packed = (ids | size << _ID_BITS).astype(np.uint32).tobytes()
        ends = 4 * np.searchsorted(at[source], first + lens)
        return {s: packed[a:b] for s, a, b in zip(fresh, [0, *ends[:-1].tolist()], ends.tolist())}

    def _look_up(self, wanted: set[str]) -> dict[str, bytes]:
        """The pieces of all ``wanted`` stretches, from the young table, the old one or anew."""
        known, old, fresh = self.known, self.old, []
        out = {}
        for s in wanted.difference(known):
            got = old.get(s)
            if got is None:
                fresh.append(s)
            else:
                out[s] = got
        held = 0
        for lo, hi in self._batches(fresh):
            out |= self._learn(fresh[lo:hi])
            held = hi
        assert held == len(fresh)
        if len(known) + len(out) > self.entries // 2:
            out |= {s: known[s] for s in wanted.intersection(known)}
            self.known, self.old = {}, known
        self.known |= {s: p for s, p in out.items() if len(s) <= _SHORT}
        return out if len(out) == len(wanted) else self.known | out

    @staticmethod
    def _batches(fresh: list[str]):
        lo = size = 0
        for i, s in enumerate(fresh):
            size += len(s)
            if size >= _BATCH_CHARS or i + 1 == len(fresh):
                yield lo, i + 1
                lo, size = i + 1, 0

    def encode_many(self, texts: list[bytes], end: bool = True):
        """(ids, first source bytes, ends of source bytes) of each UTF-8 text."""
        normal = [self.normalise(t) for t in texts]
        cut = [self.stretches.findall(n.decode("utf-8")) for n, _ in normal]
        pieces = self._look_up(set().union(*cut)).__getitem__
        for c, (_, align) in zip(cut, normal):
            packed = np.frombuffer(b"".join(map(pieces, c)), np.uint32)
            ids = (packed & _ID_MASK).astype(np.int32)
            ends = np.cumsum(packed >> _ID_BITS, dtype=np.int64)
            to = align[ends]
            start = align[np.r_[0, ends[:-1]]] if len(ends) else to
            if end:
                ids, last = np.r_[ids, np.int32(self.end)], align[-1:]
                start, to = np.r_[start, last], np.r_[to, last]
            yield ids, start.astype(np.int32), to.astype(np.int32)

    def encode(self, text: bytes, end: bool = True):
        return next(self.encode_many([text], end))

    def decode(self, ids) -> str:
        """The text of ids: one leading space mark goes, invalid bytes become U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        out = b"".join(map(self.surface.__getitem__, ids))
        skip = 0
        for i in ids if self.leading else ():
            if self.surface[i]:
                skip += self.marked[i]
                if not (self.normalise.squeeze and self.marked[i] and self.surface[i] == b" "):
                    break
        return out[skip:].decode("utf-8", "one_byte")


@lru_cache(maxsize=2)
def _pieces(path: str, entries: int) -> Pieces:
    return Pieces(path, entries)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                     end: bool = True, entries: int = TABLE_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: (key, ids, starts, ends, decoded).

    ``model`` is the path of a model file that every executor can open;
    [starts, ends) are byte spans of the text in UTF-8.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        pieces = _pieces(model, entries)

        def block(keys, made):
            ids, starts, ends, decoded = zip(*made)
            at = pa.array(np.r_[0, np.cumsum([len(i) for i in ids])], pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), pa.int32()))
                     for x in (ids, starts, ends)]
            return pa.RecordBatch.from_arrays(
                [keys, *lists, pa.array(decoded, pa.string())],
                names=["k", "ids", "starts", "ends", "decoded"])

        def worked(keys, texts):
            made = [(*got, pieces.decode(got[0])) for got in pieces.encode_many(texts, end)]
            return block(keys, made)

        for b in batches:
            first, texts, held = 0, [], 0
            for i, t in enumerate(b.column("t")):
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= GROUP_BYTES:
                    yield worked(b.column("k")[first:i + 1], texts)
                    first, texts, held = i + 1, [], 0
            if texts:
                yield worked(b.column("k")[first:], texts)

    ints = ArrayType(IntegerType())
    schema = StructType([rows.schema["k"], StructField("ids", ints), StructField("starts", ints),
                         StructField("ends", ints), StructField("decoded", StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode_ids(rows: DataFrame, model: str, ids: str = "ids", made: str = "decoded",
               entries: int = TABLE_ENTRIES) -> DataFrame:
    """``rows`` with the text of the array column ``ids`` (null: null) as column ``made``."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text_of(batch):
        import pandas as pd

        pieces = _pieces(model, entries)
        return pd.Series([None if x is None else pieces.decode(x) for x in batch], dtype=object)

    return rows.withColumn(made, text_of(F.col(f"`{ids}`")))
