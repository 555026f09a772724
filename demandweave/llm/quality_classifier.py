"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Tokens are runs of letters, of digits, and of other characters. Every token has a sparse random index vector,
drawn from its hash; a token's word vector is the sum of the index vectors of its neighbours in the sample.
Tokens seen too rarely share the vector of their shape (kind, case, length). A document is the mean of its word
vectors, with how alike neighbouring tokens are, how varied they are, and how many. The network has one hidden
layer; its temperature is fitted on rows that it was not trained on, so that scores are probabilities.

Labels come from a bounded sample (PER_CLASS texts of each label at most), weighted to the share of good
rows among all that may be learnt from. The model is a vocabulary of at most WORDS words and two small
matrices: a few MB whatever the corpus.

Defined cases: null and empty texts have no tokens: zero vectors, whose score the network gives. With no rows
of one label every score is the share of label 1. Texts are read whole. Equal rows get equal scores; an empty
table gives an empty one. Other columns pass through; one that bears an output's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .labelled import Sample

PER_CLASS = 1500
DIMENSIONS, NONZERO, REACH = 48, 6, 2
WORDS, LEAST_COUNT = 20_000, 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 0.01, 1e-4
SEED = 7

_KIND = np.full(256, 3, np.uint8)  # other characters
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
#: Shapes: digits, others, and letters by case (lower, first upper, all upper), by length up to 7 bytes.
SHAPES = 5 * 8


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Tokens of all rows in order, an offset per row, and the shape of each distinct token."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins = (kind > 0) & (edge[:-1] | np.concatenate([[True], kind[1:] != kind[:-1]])) if len(data) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(kind > 0)])
    bounds = np.append(kept[np.flatnonzero(begins)], kept[-1]).astype(np.int32)
    text = pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[kind > 0]))]
    )
    coded = text.dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(begins)])[ends]
    shape = np.fromiter((_shape(w) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return coded, offsets, shape


def _shape(word: bytes) -> int:
    kind = _KIND[word[0]]
    if kind == 1:
        form = 0 if word == word.lower() else 2 if word == word.upper() and len(word) > 1 else 1
    else:
        form = 3 if kind == 2 else 4
    return form * 8 + min(len(word), 8) - 1


def index_vector(name: bytes) -> np.ndarray:
    """Sparse vector of +1 and -1 at places that the name's hash draws."""
    draw = np.random.default_rng(xxhash.xxh3_64_intdigest(name))
    out = np.zeros(DIMENSIONS, np.float32)
    out[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice((-1.0, 1.0), NONZERO)
    return out


class QualityModel:
    def __init__(self, sample: Sample):
        self.rate, self.vocabulary = sample.rate, None
        y = np.array(sample.labels, np.float32)
        if not len(y) or y.min() == y.max():
            return
        data = np.frombuffer(b"".join(sample.texts), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in sample.texts])])
        self._learn_words(data, ends)
        x = self.features(data, ends)
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-6
        self._learn_network(((x - self.centre) / self.spread).astype(np.float32), y)

    def _codes(self, data, ends):
        coded, offsets, shape = tokens(data, ends)
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy()
        known = np.where(known >= 0, known + SHAPES, shape)
        return known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64), offsets

    def _learn_words(self, data, ends):
        coded, _, _ = tokens(data, ends)
        count = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        top = np.argsort(-count, kind="stable")[:WORDS]
        self.vocabulary = coded.dictionary.take(pa.array(top[count[top] >= LEAST_COUNT]))
        codes, offsets = self._codes(data, ends)
        names = [b"\x00%d" % i for i in range(SHAPES)] + self.vocabulary.to_pylist()
        index = np.stack([index_vector(n) for n in names])
        vectors = np.zeros_like(index)
        row = np.searchsorted(offsets, np.arange(len(codes)), "right")
        for step in range(1, REACH + 1):
            same = np.flatnonzero(row[step:] == row[:-step])
            pair, times = np.unique(codes[same] * len(names) + codes[same + step], return_counts=True)
            left, right, times = pair // len(names), pair % len(names), times[:, None].astype(np.float32)
            np.add.at(vectors, left, index[right] * times)
            np.add.at(vectors, right, index[left] * times)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = np.where(size > 0, vectors / np.maximum(size, 1e-9), index / np.sqrt(NONZERO)).astype(np.float32)

    def features(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, offsets = self._codes(data, ends)
        out = np.zeros((len(ends) - 1, DIMENSIONS + 4), np.float32)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b > a:
                own = codes[a:b]
                word, times = np.unique(own, return_counts=True)
                pooled = times.astype(np.float32) @ self.vectors[word] / len(own)
                out[i, :DIMENSIONS] = pooled
                out[i, DIMENSIONS:] = (
                    np.linalg.norm(pooled),
                    (own[1:] == own[:-1]).mean() if len(own) > 1 else 0.0,
                    len(word) / np.sqrt(len(own)),
                    np.log1p(len(own)),
                )
        return out

    def _forward(self, x):
        hidden = np.maximum(x @ self.w1 + self.b1, 0)
        return hidden, hidden @ self.w2 + self.b2

    def _learn_network(self, x, y):
        draw = np.random.default_rng(SEED)
        order = draw.permutation(len(y))
        cut = max(1, len(y) // 5)
        test, train = order[:cut], order[cut:]
        weight = np.where(y == 1, self.rate / y.mean(), (1 - self.rate) / (1 - y.mean())).astype(np.float32)
        self.w1 = draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32)
        self.w2, self.b1, self.b2 = draw.normal(0, 0.3, HIDDEN).astype(np.float32), np.zeros(HIDDEN, np.float32), np.float32(0)
        names = ("w1", "b1", "w2", "b2")
        moment = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in names}
        step = 0
        for _ in range(EPOCHS):
            draw.shuffle(train)
            for a in range(0, len(train), BATCH):
                at = train[a : a + BATCH]
                hidden, z = self._forward(x[at])
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
                back = np.outer(error, self.w2) * (hidden > 0)
                slope = {"w1": x[at].T @ back, "b1": back.sum(0), "w2": hidden.T @ error, "b2": error.sum()}
                step += 1
                for k in names:
                    g = slope[k] + DECAY * getattr(self, k)
                    m, v = moment[k]
                    m = moment[k][0] = 0.9 * m + 0.1 * g
                    v = moment[k][1] = 0.999 * v + 0.001 * g * g
                    move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))
        z = self._forward(x[test])[1]
        heat = np.exp(np.linspace(-1, 3, 81))
        p = 1 / (1 + np.exp(-np.clip(z[None, :] / heat[:, None], -30, 30)))
        loss = -(weight[test] * np.log(np.where(y[test] == 1, p, 1 - p) + 1e-12)).sum(1)
        self.temperature = float(heat[loss.argmin()])

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.vocabulary is None:
            return np.full(len(ends) - 1, self.rate)
        z = self._forward((self.features(data, ends) - self.centre) / self.spread)[1]
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30).astype(np.float64)))
