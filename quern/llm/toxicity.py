"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text, another on the words of
toxic text that hold pieces peculiar to it (trained on toxic windows as they
are, it mostly holds ordinary wording and finds far fewer toxic texts). A text is cut into windows of a few words, and each
window is compressed with the ordinary dictionary alone and with the toxic one
added. A window that gets shorter by the toxic dictionary is near to toxic
text. This is done in two views: words as they are, and words with their
beginnings in upper case, so that what begins a word isn't matched by what
stands inside of others. Sums over a text's windows are turned into a score by
thresholds that are calibrated on labelled texts which the dictionaries haven't
seen.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import map_columns
from quern.llm.quality import labelled_sample

#: Labelled texts that a fit uses, at most: toxic and ordinary ones, and characters of each (longer ones are left out of the fit).
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2_000, 3_000, 20_000
WINDOW_WORDS = 6
LEVEL = 3
#: Bytes at the beginning of a word that are in upper case, in each view.
VIEWS = (0, 6)
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 4_096
GRAM = 5
#: A piece of a word is peculiar to toxic text if it's so much more frequent there, in so many contexts.
PECULIAR, CONTEXTS, WORDS_EACH = 6.0, 5, 2
_FRAME = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}


def words(text: str, head: int = 0) -> list[bytes]:
    """Words in lower case, the first ``head`` bytes of each in upper case."""
    found = text.lower().encode("utf-8", "surrogatepass").split()
    return [w[:head].upper() + w[head:] for w in found] if head else found


def _joined(some: list[bytes]) -> bytes:
    return b" " + b" ".join(some) + b" "


def windows(text: str, head: int = 0) -> list[bytes]:
    """The whole text in windows of WINDOW_WORDS words."""
    w = words(text, head)
    return [_joined(w[i : i + WINDOW_WORDS]) for i in range(0, len(w), WINDOW_WORDS)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, **_FRAME)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _train(size: int, samples: list[bytes], **how) -> bytes:
    """A trained dictionary's bytes; of samples that fit in whole, or are too few to train on, their own last bytes."""
    if sum(map(len, samples)) <= size:
        return b"".join(reversed(samples)).rjust(8)
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].rjust(8)


def _gram_counts(texts: list[str], head: int) -> tuple[Counter, int]:
    """How many distinct pairs of a word and the word before it have each piece of GRAM bytes in the word; copies count once."""
    pairs: set[tuple[bytes, bytes]] = set()
    for text in texts:
        w = words(text, head)
        pairs.update(zip([b"", *w], w))
    out: Counter = Counter()
    for word, n in Counter(w for _, w in pairs).items():
        for gram in _grams(word):
            out[gram] += n
    return out, len(pairs)


def _grams(word: bytes) -> set[bytes]:
    spaced = b" " + word + b" " if len(word) + 1 < GRAM else b" " + word
    return {spaced[i : i + GRAM] for i in range(max(1, len(spaced) - GRAM + 1))}


def toxic_samples(toxic: list[str], ordinary: list[str], head: int = 0) -> list[bytes]:
    """What the toxic dictionary is trained on: words with a piece that is peculiar to toxic text.

    For each such piece, the most frequent pieces first, words with it are taken
    until WORDS_EACH have it, the most frequent words first. So no frequent
    piece, nor any language, crowds out the others.
    """
    in_toxic, n_toxic = _gram_counts(toxic, head)
    in_ordinary, n_ordinary = _gram_counts(ordinary, head)
    least = max(CONTEXTS, len(toxic) * 0.02)
    peculiar = {
        gram: n
        for gram, n in in_toxic.items()
        if n >= least and n * (n_ordinary + 1) >= PECULIAR * (in_ordinary[gram] + 0.5) * (n_toxic + 1)
    }
    having: dict[bytes, list[bytes]] = {gram: [] for gram in peculiar}
    found = Counter(w for t in set(toxic) for w in words(t, head))
    for word in sorted(found, key=lambda w: (-found[w], w)):
        for gram in _grams(word):
            if gram in having:
                having[gram].append(word)
    covered: Counter = Counter()
    chosen: dict[bytes, None] = {}
    for gram in sorted(peculiar, key=lambda g: (-peculiar[g], g)):
        for word in having[gram]:
            if covered[gram] >= WORDS_EACH:
                break
            if word not in chosen:
                chosen[word] = None
                covered.update(_grams(word))
    return [b" " + w + b" " for w in chosen]


@dataclass(frozen=True)
class Model:
    """For each view its ordinary and its toxic dictionary; weights of what the toxic ones save."""

    dictionaries: tuple[tuple[int, bytes, bytes], ...]
    weights: tuple[float, ...]

    def scorer(self):
        views = _compressors(self.dictionaries)

        def score(text: str | None) -> float:
            x = distances(text, views)
            return float(1 / (1 + np.exp(-np.clip(x @ np.asarray(self.weights), -30, 30))))

        return score


#: Sums for each view, and in all with the constant and the length.
SUMS = 5
FEATURES = 2 + SUMS * len(VIEWS)


def _compressors(dictionaries) -> list[tuple]:
    # The toxic dictionary stands nearest to the window, so that matches in it cost least.
    return [(head, _compressor(plain), _compressor(plain + toxic)) for head, plain, toxic in dictionaries]


def distances(text: str | None, views: list[tuple]) -> np.ndarray:
    """A constant, the logarithm of the number of windows, and what the toxic dictionary of each view saves, summed in several ways."""
    out = [1.0, 0.0]
    for head, plain, added in views:
        all_windows = windows(text, head) if text else []
        n = len(all_windows)
        if not n:
            out += [0.0] * SUMS
            continue
        saved = np.array([len(plain.compress(w)) - len(added.compress(w)) for w in all_windows], float)
        root = np.sqrt(n)
        out[1] = np.log1p(n)
        out += [saved.sum() / root, saved.sum() / n, (saved >= 3).sum() / root, (saved >= 2).sum() / n, saved.max()]
    return np.array(out)


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's steps, on scaled columns."""
    shift, scale = x.mean(axis=0), x.std(axis=0)
    shift[0], scale[scale == 0] = 0.0, 1.0
    z = (x - shift) / scale
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w / scale
    out[0] -= (w / scale * shift)[1:].sum()
    return out


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of the texts (by place), thresholds from the others.

    Without texts of both kinds the score is constant: the share of toxic ones
    (0.5 without any text).
    """
    if not toxic or not ordinary:
        share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
        return Model(tuple((head, b"        ", b"        ") for head in VIEWS), (float(np.log(share / (1 - share))), *[0.0] * (FEATURES - 1)))
    build = lambda texts: [t for i, t in enumerate(texts) if i % 3 or len(texts) < 6]
    held = lambda texts: [t for i, t in enumerate(texts) if not i % 3 or len(texts) < 6]
    dictionaries = tuple(
        (
            head,
            _train(ORDINARY_BYTES, [w for t in build(ordinary) for w in windows(t, head)], k=64, d=8),
            _train(TOXIC_BYTES, toxic_samples(build(toxic), build(ordinary), head), k=32, d=6),
        )
        for head in VIEWS
    )
    views = _compressors(dictionaries)
    x = np.array([distances(t, views) for t in [*held(toxic), *held(ordinary)]])
    y = np.array([1.0] * len(held(toxic)) + [0.0] * len(held(ordinary)))
    return Model(dictionaries, tuple(map(float, _calibrate(x, y))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """Fit on at most MAX_TOXIC and MAX_ORDINARY labelled texts of at most MAX_CHARS characters, the first by a hash of the number.

    The driver holds these texts. Null labels, numbers and texts take no part.
    """
    some = docs.where(F.length(text).between(1, MAX_CHARS))
    held = {}
    for value, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        rows = labelled_sample(some, labels.where(F.col(label) == value), label, doc_id=doc_id, max_rows=most)
        held[value] = [r[0] for r in rows.select(text, "labelled_id").orderBy(F.xxhash64(F.lit(11), "labelled_id"), "labelled_id", text).collect()]
    return fit_texts(held[1], held[0])


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability of being toxic (double).

    Every window of the whole text counts. Null, empty and blank texts get the
    score of a text in which nothing is near to toxic text. An input column
    called ``score`` is replaced; the text goes unless ``keep_text``.
    """

    def make():
        rate = model.scorer()
        return lambda columns: [pa.array([rate(t) for t in columns[0].to_pylist()], pa.float64())]

    return map_columns(docs, [text], T.StructType([T.StructField(score, T.DoubleType())]), make, drop=() if keep_text else (text,))
