"""Hierarchical language identification with linear support vector machines.

A text's features are hashed byte trigrams of its letters (case folded, all else
one blank), normalised. A first level of one-against-the-rest machines decides
the language family; within a family one-versus-one machines separate the
closely related languages by votes, equal votes by summed margins. Languages
outside the table of families are families of their own.

The machines (squared hinge loss, L2) are fitted on at most ``per_class`` texts
of each language; every text is predicted from its whole length.

A null text, or one without a letter, is ``und`` with score 0. Repeated rows are
predicted alike. Without any learnable row everything is ``und``. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import remainder, texts_by_class

#: Language families of common ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
PER_CLASS = 800
DIMS = 4096
GROUP_TEXTS = 256
_PIECE = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def _letters() -> np.ndarray:
    """Byte to folded byte: ASCII letters to lower case, non-letters below 128 to a blank."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


FOLD = _letters()


def _buckets(raw: np.ndarray, dims: int) -> np.ndarray:
    b = FOLD[raw]
    accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)  # upper case Latin-1
    b[1:][accented] += 32
    b = b.astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - dims.bit_length() + 1)).astype(np.int64)


def features(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """Normalised square roots of hashed trigram counts, one row per text."""
    out = np.zeros((len(texts), dims), np.float32)
    group, owners, held = [], [], 0

    def flush():
        raw = np.frombuffer(b"\0\0".join(group) + b"\0\0", np.uint8)
        sizes = np.array([len(g) + 2 for g in group])
        own = np.repeat(np.arange(len(group)), sizes)[:-2]
        got = np.bincount(own * dims + _buckets(raw, dims), minlength=len(group) * dims)
        np.add.at(out, owners, got.reshape(-1, dims))

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), _PIECE):
            group.append(t[at:at + _PIECE + 2])
            owners.append(i)
            held += len(group[-1])
            if held >= _PIECE or len(group) >= GROUP_TEXTS:
                flush()
                group, owners, held = [], [], 0
    if group:
        flush()
    blank = _buckets(np.full(3, 32, np.uint8), dims)[0]
    out[:, blank] = 0
    np.sqrt(out, out=out)
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200):
    """(weights, bias) of a linear squared-hinge machine, y in {-1, 1}, classes weighed equally."""
    f, y = np.float32, y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(f) * y
    w, b = np.zeros(x.shape[1], f), f(0)
    vw, vb, rate = w, b, f(1.0 / (4.0 + penalty))
    for t in range(1, steps + 1):
        slack = np.maximum(f(0), f(1) - y * (x @ vw + vb)) * share
        nw = vw - rate * (f(penalty) * vw - f(2) * (slack @ x))
        nb = vb + rate * f(2) * slack.sum()
        pull = f((t - 1) / (t + 2))
        vw, vb, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, float(b)


class Hierarchy:
    """Family machines and, per family, one machine for each pair of languages."""

    def __init__(self, sample: list[tuple[bytes, str]], dims: int = DIMS):
        x = features([t for t, _ in sample], dims) if sample else np.zeros((0, dims), np.float32)
        lang = np.array([c for _, c in sample], dtype=object)
        self.dims, self.langs = dims, sorted(set(lang.tolist()))
        family = np.array([family_of(c) for c in lang], dtype=object)
        self.families = sorted(set(family.tolist()))
        self.members = {f: [c for c in self.langs if family_of(c) == f] for f in self.families}
        self.top = [fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families] \
            if len(self.families) > 1 else []
        self.pairs = {}
        for f, langs in self.members.items():
            for i, a in enumerate(langs):
                for b in langs[i + 1:]:
                    use = (lang == a) | (lang == b)
                    self.pairs[a, b] = fit_svm(x[use], np.where(lang[use] == a, 1.0, -1.0))

    def predict(self, texts: list[bytes]):
        """(language, score) for each text."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        x = features(texts, self.dims)
        sure = np.ones(len(texts))
        which = np.zeros(len(texts), int)
        if self.top:
            margin = np.stack([x @ w + b for w, b in self.top], axis=1)
            which = margin.argmax(axis=1)
            e = np.exp(3.0 * (margin - margin.max(axis=1, keepdims=True)))
            sure = (e / e.sum(axis=1, keepdims=True))[np.arange(len(texts)), which]
        names, scores = np.empty(len(texts), object), np.zeros(len(texts))
        for i, f in enumerate(self.families):
            at = np.flatnonzero(which == i)
            if not len(at):
                continue
            langs = self.members[f]
            votes, margins = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
            for j, a in enumerate(langs):
                for k in range(j + 1, len(langs)):
                    w, b = self.pairs[a, langs[k]]
                    m = x[at] @ w + b
                    votes[:, j] += m >= 0
                    votes[:, k] += m < 0
                    margins[:, j] += m
                    margins[:, k] -= m
            best = (votes + 1e-6 * np.tanh(margins)).argmax(axis=1)
            names[at] = np.array(langs, dtype=object)[best]
            own = margins[np.arange(len(at)), best] / max(1, len(langs) - 1)
            scores[at] = sure[at] * (1.0 if len(langs) == 1 else 1.0 / (1.0 + np.exp(-3.0 * own)))
        return list(zip(names.tolist(), scores.tolist()))


def has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             per_class: int = PER_CLASS, dims: int = DIMS) -> DataFrame:
    """One row per row of ``docs``: (key, held_out, lang_pred, score)."""
    out = remainder(F.col(key), 4) == 2
    sample = texts_by_class(docs, F.col(lang), per_class, ~out, key, text)
    model = Hierarchy([(t.encode("utf-8", "surrogatepass"), c) for t, c in sample
                       if has_letter(t)], dims)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("k"), out.alias("o"), F.col(text).alias("t"))

    def run(batches):
        machine = shared.value
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, GROUP_TEXTS):
                part = b.column("t")[at:at + GROUP_TEXTS].to_pylist()
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part]
                for t, (name, s) in zip(part, machine.predict(raw)):
                    names.append(name if has_letter(t) else "und")
                    scores.append(s if names[-1] != "und" else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("o"), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], names=["k", "o", "lang_pred", "score"])

    schema = rows.select("k", "o", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).select(F.col("k").alias(key), F.col("o").alias("held_out"),
                                               "lang_pred", "score")
