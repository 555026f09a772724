"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts. The ordinary one is trained on ordinary texts. The
toxic one is the same with toxic material in front: the words, and beginnings of words, that occur in toxic texts in several different
surroundings and hardly ever in ordinary ones (surroundings, because a passage copied a hundred times is one
observation). What both kinds of text share compresses alike with either, so the difference of a window's two
compressed lengths tells what only the toxic dictionary knows.

All windows of a text are compressed by a fast setting; windows that gain SUSPECT bytes or more are compressed
again by a thorough one. Counts of windows by gain go to a logistic model, whose thresholds and
probabilities are fitted on the same bounded sample of labelled rows (PER_CLASS texts of each label at most)
and weighted to the share of toxic rows among all of them.

Defined cases: null and empty texts have no window; their score is the model's for no gain at all. With no rows of
one label every score is the share of toxic labels. Texts are read whole, whatever their length. Equal rows
get equal scores; an empty table gives an empty one. Other columns pass through; one that bears an
output's name is replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import zstandard

from .labelled import Sample
from .words import byte_table

PER_CLASS = 2000
WINDOW, STRIDE = 32, 16
FAST, THOROUGH = 3, 6
DICTIONARY_BYTES = 8192
SUSPECT = 2
GAINS = (2, 3, 4, 6)
#: What counts as toxic material: its least length and number, how much more frequent than in ordinary texts it is, and how
#: unlikely that is by chance (log-likelihood ratio; 24 is about one in a million).
LEAST_LETTERS, LEAST_SEEN, LEAST_RATIO, LEAST_SURPRISE = 3, 4, 5.0, 24.0
#: Beginnings of words that are looked at like words: inflected forms that were not seen are known by them.
STEMS = (4, 5, 6)
LOWER = byte_table(b"", lower=True)
_EDGES = b".,;:!?\"'()[]#*$%&|"


def units(text: bytes):
    """Each word of a text, and the beginnings of longer words, with what stands around it."""
    words = [b"", *(w.strip(_EDGES) for w in text.split()), b""]
    for left, word, right in zip(words, words[1:], words[2:]):
        if word:
            around = hash((left, word, right))
            yield b" " + word + b" ", around
            for n in STEMS:
                if len(word) > n:
                    yield b" " + word[:n], around


def surroundings(texts: list[bytes], wanted) -> dict[bytes, int]:
    """Per wanted unit the number of different surroundings."""
    seen = {u: set() for u in wanted}
    for text in texts:
        for unit, around in units(text):
            if unit in seen:
                seen[unit].add(around)
    return {u: len(s) for u, s in seen.items()}


def toxic_material(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The words and beginnings to put in the toxic dictionary. The most frequent come last, as the end of a
    dictionary is the cheapest to refer to."""
    plain = [Counter(u for t in texts for u, _ in units(t)) for texts in (toxic, ordinary)]
    n_toxic, n_ordinary = (max(1, sum(c.values())) for c in plain)
    # occurrences first: a unit that repeats too little, or is as common elsewhere, needs no look around it
    likely = {u for u, n in plain[0].items() if n >= LEAST_SEEN and n * n_ordinary >= 2 * n_toxic * plain[1].get(u, 0)}
    del plain
    of_toxic, of_ordinary = surroundings(toxic, likely), surroundings(ordinary, likely)
    share = n_toxic / (n_toxic + n_ordinary)
    found = []
    for w, n in of_toxic.items():
        m = of_ordinary.get(w, 0)
        if n and len(w.strip()) >= LEAST_LETTERS and n * n_ordinary >= LEAST_RATIO * n_toxic * m:
            surprise = n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0)
            if 2 * surprise >= LEAST_SURPRISE:
                found.append(w)
    return b"".join(sorted(found, key=lambda w: (of_toxic[w], w)))[-DICTIONARY_BYTES // 2 :]


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of every window of the rows, and the row of each. Windows overlap by half."""
    sizes = np.diff(ends)
    counts = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE + ends[:-1][row]
    return np.stack([start, np.minimum(WINDOW, ends[1:][row] - start)], 1), row


class Compressors:
    """Lengths of windows by the ordinary and the toxic dictionary, both under the same setting."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int):
        setting = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=4096, dict_size=DICTIONARY_BYTES + 4096, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        self.pair = []
        for content in (ordinary, toxic + ordinary):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=setting)
            self.pair.append(zstandard.ZstdCompressor(compression_params=setting, dict_data=known))

    def gains(self, data: bytes, spans: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if not len(spans):
            return np.empty(0, np.int64)
        held = zstandard.BufferWithSegments(data, spans.astype(np.uint64).tobytes())
        lengths = [np.fromiter((len(x) for x in c.multi_compress_to_buffer(held, threads=1)), np.int64, len(spans)) for c in self.pair]
        return lengths[0] - lengths[1]


class ToxicityModel:
    def __init__(self, sample: Sample):
        self.rate, self.weights, self._ready = sample.rate, None, None
        texts = [LOWER[np.frombuffer(t, np.uint8)].tobytes() for t in sample.texts]
        toxic = [t for t, y in zip(texts, sample.labels) if y == 1]
        ordinary = [t for t, y in zip(texts, sample.labels) if y == 0]
        if not toxic or not ordinary:
            return
        pieces = [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)]
        try:
            self.ordinary = zstandard.train_dictionary(DICTIONARY_BYTES, pieces[:20_000]).as_bytes()
        except zstandard.ZstdError:  # too few texts to choose from: they are the dictionary themselves
            self.ordinary = b"".join(pieces)[-DICTIONARY_BYTES:]
        self.toxic = toxic_material(toxic, ordinary)
        del toxic, ordinary, pieces
        x, y = np.concatenate(list(self._pieces(texts))), np.array(sample.labels, float)
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-9
        balance = np.where(y == 1, self.rate / y.mean(), (1 - self.rate) / (1 - y.mean()))
        self._fit(self._scaled(x), y, balance)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            self._ready = [Compressors(self.ordinary, self.toxic, level) for level in (FAST, THOROUGH)]
        return self._ready

    def features(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        n, (spans, row) = len(ends) - 1, windows(ends)
        fast, thorough = self._compressors()
        first = fast.gains(data, spans)
        suspect = np.flatnonzero(first >= SUSPECT)
        sure, row_of = thorough.gains(data, spans[suspect]), row[suspect]
        out = []
        for gain in (sure, np.minimum(sure, first[suspect])):
            most = np.zeros(n)
            np.maximum.at(most, row_of, gain)
            out += [most, *(np.log1p(np.bincount(row_of, gain >= g, n)) for g in GAINS)]
        size, clear = np.log1p(np.bincount(row, minlength=n)), (out[0] >= 3) * 1.0
        return np.stack([*out, size, clear, clear * size], 1)

    def _pieces(self, texts, size=200):
        for i in range(0, len(texts), size):
            some = texts[i : i + size]
            yield self.features(b"".join(some), np.concatenate([[0], np.cumsum([len(t) for t in some])]))

    def _scaled(self, x):
        return np.c_[(x - self.centre) / self.spread, np.ones(len(x))]

    def _fit(self, x, y, balance):
        ridge = 1e-3 + 2 / len(y)
        self.weights = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ ((p - y) * balance) / len(y) + ridge * self.weights
            bend = (x * (balance * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(self.weights))
            self.weights -= np.linalg.solve(bend, slope)

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(ends) - 1, self.rate)
        x = self._scaled(self.features(LOWER[data].tobytes(), ends))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
