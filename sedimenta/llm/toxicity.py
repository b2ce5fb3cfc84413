"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all windows of a text.

A text's words (lower-cased, ASCII punctuation at the ends taken off) each become the sum of hashed embeddings: of the word, of
its first and last AFFIX characters, and of all its runs of GRAM characters, these weighed by the root of their
number; so a word never seen is known by its characters, wherever they stand in it. Windows of WINDOW words, each overlapping the
one before, cover the whole text. Two gated recurrent layers read a window in both directions, attention pools their states, and
a logistic unit scores the pool. A text's score is that of its worst window, calibrated.

Training takes a bounded sample of rows: at most SAMPLE_ROWS texts of each label, whole, by a hash of doc_id. A label is about a
text and not a window. So all windows of clean texts are learnt as clean; of a toxic text's windows, which all are looked at, those that
hold the words most typical of toxic texts are learnt as toxic.

Null and empty texts have one window without words. Rows repeat as they are. Only doc_id and text are read;
without six labelled texts of each class the score is the share of toxic labels, or 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.compression import labelled, logistic
from sedimenta.llm.tables import fold_of
from sedimenta.llm.words import Hasher, mix, slices

WINDOW = 24
STRIDE = 16
HIDDEN = 8
INPUT = 8
_BITS = 15
BUCKETS = 1 << _BITS
AFFIX = 4
GRAM = 3
SAMPLE_ROWS = 1500
EPOCHS = 3
#: Batches that a small sample is gone through at least.
STEPS = 600
BATCH = 256
_HASHER = Hasher(70)
#: Windows that go through the network at once.
_BLOCK = 2048
#: Features of a word that stand for all of it; its runs of characters follow.
_WHOLE = 3

_EDGE = np.zeros(128, dtype=bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass
class Words:
    """The words of some texts: text i has those from bounds[i] to bounds[i + 1], and word j the features from at[j] to at[j + 1].

    The first _WHOLE features of a word are of the word, its beginning and its end; 0 is none.
    """

    bounds: np.ndarray
    at: np.ndarray
    features: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def whole(self) -> np.ndarray:
        return self.features[self.at[:-1, None] + np.arange(_WHOLE)]


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Of a slice of texts, see words.slices."""
    raw, cuts = data.tobytes(), offsets.tolist()
    texts = [_lowered(raw[a:b].decode("utf-8", "replace")) for a, b in zip(cuts, cuts[1:], strict=False)]  # with the space behind
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    inside = np.zeros(len(chars) + 2, dtype=np.int8)
    inside[1:-1] = ~((chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D)))
    edges = np.diff(inside)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.searchsorted(first, begins)
    edge = _EDGE[np.minimum(chars, 127)] & (chars < 128)
    for _ in range(3):
        trim = (last - first > 1) & edge[last - 1]
        last[trim] -= 1
        trim = (last - first > 1) & edge[np.minimum(first, len(chars) - 1)]
        first[trim] += 1
    values = mix(chars.astype(np.uint64) + np.uint64(1))
    size = last - first
    runs = np.maximum(size - GRAM + 1, 0)
    at = np.concatenate(([0], np.cumsum(runs + _WHOLE)))
    features = np.zeros(int(at[-1]), dtype=np.int32)

    def put(where: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int) -> None:
        h = mix(_HASHER.spans(values, begin, end) + np.uint64(salt))
        features[where] = np.maximum((h >> np.uint64(64 - _BITS)).astype(np.int32), 1)

    put(at[:-1], first, last, 1)
    long = size >= AFFIX
    put(at[:-1][long] + 1, first[long], first[long] + AFFIX, 2)
    put(at[:-1][long] + 2, last[long] - AFFIX, last[long], 3)
    begin = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    put(np.repeat(at[:-1] + _WHOLE - np.cumsum(runs) + runs, runs) + np.arange(runs.sum()), begin, begin + GRAM, 4)
    return Words(bounds, at, features)


def _shares(counts: np.ndarray) -> np.ndarray:
    """How much each feature counts in its word, of words with so many features."""
    out = np.ones(int(counts.sum()), dtype=np.float32)
    place = np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)
    weight = np.repeat(1 / np.sqrt(np.maximum(counts - _WHOLE, 1)), counts)
    grams = place >= _WHOLE
    out[grams] = weight[grams]
    return out


def _embedded(embed: np.ndarray, words: Words, begin: int, end: int) -> np.ndarray:
    """Inputs of the words from begin to end."""
    out = np.zeros((end - begin, INPUT), dtype=np.float32)
    step = 1 << 14
    for a in range(begin, end, step):
        b = min(end, a + step)
        at = words.at[a : b + 1]
        rows = embed[words.features[at[0] : at[-1]]] * _shares(np.diff(at))[:, None]
        out[a - begin : b - begin] = np.add.reduceat(rows, at[:-1] - at[0], axis=0)
    return out


@dataclass
class Network:
    """Weights. Of the gates' columns, the first 2 * HIDDEN are reset and update, the last are the candidate's."""

    embed: np.ndarray  # BUCKETS x INPUT
    inputs: list[np.ndarray]  # by direction, INPUT x 3 HIDDEN
    states: list[np.ndarray]  # HIDDEN x 3 HIDDEN
    biases: list[np.ndarray]
    attend: np.ndarray  # 2 HIDDEN
    output: np.ndarray  # 2 HIDDEN + 1

    @staticmethod
    def new(seed: int) -> Network:
        draw = np.random.Generator(np.random.PCG64(seed))
        rand = lambda *shape: (draw.standard_normal(shape) * (1 / shape[0] ** 0.5)).astype(np.float32)
        embed = (draw.standard_normal((BUCKETS, INPUT)) * 0.1).astype(np.float32)
        embed[0] = 0
        return Network(embed, [rand(INPUT, 3 * HIDDEN) for _ in range(2)], [rand(HIDDEN, 3 * HIDDEN) for _ in range(2)], [np.zeros(3 * HIDDEN, np.float32) for _ in range(2)], rand(2 * HIDDEN), np.append(rand(2 * HIDDEN), np.float32(0)))

    def parts(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.biases, self.attend, self.output]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _layer(gates: np.ndarray, there: np.ndarray, state: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, N, HIDDEN) of one direction; gates is (T, N, 3 HIDDEN) from the inputs, there (T, N, 1) is 0 beyond a text's end."""
    steps, n = gates.shape[:2]
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    out = np.empty((steps, n, HIDDEN), dtype=np.float32)
    kept = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        u = h @ state
        both = _sigmoid(gates[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        r, z = both[:, :HIDDEN], both[:, HIDDEN:] * there[t]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = h + z * (c - h)
        if keep:
            kept.append((t, h, u, both, c))
        h = out[t] = new
    return out, kept


def _pool(net: Network, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, attention, pooled states)."""
    e = np.tanh(states) @ net.attend + (there[:, :, 0] - 1) * 1e4
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ net.output[:-1] + net.output[-1], a, pooled


def _forward(net: Network, x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Logits of windows, x (T, N, INPUT)."""
    states = np.concatenate([_layer(x @ net.inputs[d] + net.biases[d], there, net.states[d], bool(d), False)[0] for d in (0, 1)], axis=2)
    return _pool(net, states, there)[0]


def _gradients(net: Network, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the logistic loss for every part of the network, and for x (T, N, INPUT)."""
    layers = [_layer(x @ net.inputs[d] + net.biases[d], there, net.states[d], bool(d), True) for d in (0, 1)]
    states = np.concatenate([layers[0][0], layers[1][0]], axis=2)
    logit, a, pooled = _pool(net, states, there)
    dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    d_out = np.append(pooled.T @ dl, dl.sum())
    d_pooled = dl[:, None] * net.output[:-1]
    d_states = a[:, :, None] * d_pooled
    d_a = np.einsum("tnh,nh->tn", states, d_pooled)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    squashed = np.tanh(states)
    d_attend = np.einsum("tn,tnh->h", d_e, squashed)
    d_states += d_e[:, :, None] * net.attend * (1 - squashed**2)
    dx = np.zeros_like(x)
    d_inputs, d_state, d_bias = [], [], []
    for d in (0, 1):
        grad = np.zeros_like(x[0, :, :1]) + np.zeros(HIDDEN, np.float32)
        u_grad = np.zeros_like(net.states[d])
        gate_grad = np.zeros((*x.shape[:2], 3 * HIDDEN), dtype=np.float32)
        for t, h, u, both, c in reversed(layers[d][1]):
            g = grad + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            r, z = both[:, :HIDDEN], both[:, HIDDEN:]
            dc = g * z * there[t] * (1 - c**2)
            dz = g * (c - h) * there[t] * z * (1 - z)
            dr = dc * u[:, 2 * HIDDEN :] * r * (1 - r)
            gate_grad[t] = np.concatenate([dr, dz, dc], axis=1)
            du = np.concatenate([dr, dz, dc * r], axis=1)
            u_grad += h.T @ du
            grad = g * (1 - z * there[t]) + du @ net.states[d].T
        flat = gate_grad.reshape(-1, 3 * HIDDEN)
        d_inputs.append(x.reshape(-1, INPUT).T @ flat)
        d_state.append(u_grad)
        d_bias.append(flat.sum(axis=0))
        dx += gate_grad @ net.inputs[d].T
    return [*d_inputs, *d_state, *d_bias, d_attend, d_out.astype(np.float32)], dx


@dataclass
class Model:
    network: Network | None
    weights: tuple[float, float]  # of the calibration of the worst window's logit
    share: float


def _typical(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """By bucket, how much more usual it is in toxic texts than in clean ones, in bits; texts have their words' first features."""
    counts = np.zeros((2, BUCKETS))
    for f, label in zip(texts, y, strict=True):
        counts[label][np.unique(f)] += 1
    n = np.bincount(y, minlength=2)
    odds = np.log2((counts[1] + 0.1) / (n[1] + 1)) - np.log2((counts[0] + 0.5) / (n[0] + 1))
    odds[counts[1] < 3] = 0
    odds[0] = 0
    return odds


def _begins(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows, one at least of each text."""
    words = np.diff(bounds)
    counts = np.maximum(1, -(-(words - WINDOW + STRIDE) // STRIDE))
    text = np.repeat(np.arange(len(words)), counts)
    return text, bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE


def _cut(begins: np.ndarray, ends: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of each place (T, N), whether it is there (T, N, 1)) of windows that begin at begins in texts that end at ends."""
    at = np.arange(WINDOW)[:, None] + begins
    there = at < ends
    return np.where(there, at, none), there[:, :, None].astype(np.float32)


def train(rows: list[tuple[bytes, int]], seed: int = 7) -> Model:
    """Two of three texts train the network; the rest, whose labels it never saw, calibrate."""
    y = np.array([label for _, label in rows], dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if min((y == 0).sum(), (y == 1).sum()) < 6:
        return Model(None, (0.0, 0.0), share)
    texts = [_words(np.frombuffer(t + b" ", dtype=np.uint8), np.array([0, len(t) + 1])) for t, _ in rows]
    draw = np.random.Generator(np.random.PCG64(seed))
    held = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::3]] = True
    used = np.flatnonzero(~held)
    odds = _typical([texts[i].whole() for i in used], y[used])
    # all words of the sample behind one another, and each distinct one once: a word is known by its features
    begins, ends, labels, known, ids = [], [], [], {}, []
    for i in used:
        t = texts[i]
        _, own = _begins(t.bounds)
        if y[i] and len(t):
            words = odds[t.whole()].max(axis=1)
            worst = np.array([words[b : b + WINDOW].max() for b in own])
            own = own[worst >= max(1.5, 0.8 * worst.max())]
        base = len(ids)
        flat, at = t.features.tobytes(), (t.at * 4).tolist()
        ids += [known.setdefault(flat[a:b], len(known)) for a, b in zip(at, at[1:], strict=False)]
        begins += (own + base).tolist()
        ends += [len(ids)] * len(own)
        labels += [float(y[i] and len(t) > 0)] * len(own)
    bags = [np.frombuffer(k, dtype=np.int32) for k in known]
    counts = np.array([*map(len, bags), 1])
    at = np.concatenate(([0], np.cumsum(counts)))
    features = np.concatenate([*bags, [0]])  # the last word is none
    shares = _shares(counts)
    shares[-1] = 0
    ids = np.array([*ids, len(bags)])
    begins, ends, labels = np.array(begins), np.array(ends), np.array(labels, dtype=np.float32)
    net = Network.new(seed)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parts()]
    squares = np.zeros(BUCKETS, dtype=np.float32)
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(labels))))):
        order = draw.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            b = order[start : start + BATCH]
            place, there = _cut(begins[b], ends[b], len(ids) - 1)
            word, which = np.unique(ids[place], return_inverse=True)
            n = counts[word]
            bag = np.repeat(at[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
            f, w = features[bag], shares[bag][:, None]
            x = np.add.reduceat(net.embed[f] * w, np.cumsum(n) - n, axis=0)[which.reshape(place.shape)]
            grads, dx = _gradients(net, x, there, labels[b])
            step += 1
            for p, g, m in zip(net.parts(), grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
            of_word = _summed(dx.reshape(-1, INPUT), which.reshape(-1), len(word))
            buckets, to = np.unique(f, return_inverse=True)
            g = _summed(np.repeat(of_word, n, axis=0) * w, to, len(buckets))
            squares[buckets] += (g * g).mean(axis=1)
            net.embed[buckets] -= 0.05 * g / (np.sqrt(squares[buckets])[:, None] + 1e-7)
            net.embed[0] = 0
    z = np.array([_scores(net, texts[i])[0] for i in np.flatnonzero(held)], dtype=np.float64)
    w = logistic(np.stack([np.ones_like(z), z], axis=1), y[held], ridge=0.1)
    return Model(net, (float(w[0]), float(w[1])), share)


def _summed(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to each of n places."""
    return np.stack([np.bincount(to, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def _scores(net: Network, words: Words) -> np.ndarray:
    """The worst window's logit of each text."""
    text, begins = _begins(words.bounds)
    ends = words.bounds[text + 1]
    logits = np.empty(len(begins), dtype=np.float32)
    for at in range(0, len(begins), _BLOCK):
        b, e = begins[at : at + _BLOCK], ends[at : at + _BLOCK]
        low, high = int(b[0]), int(np.minimum(b + WINDOW, e).max(initial=b[0]))
        x = np.concatenate([_embedded(net.embed, words, low, high), np.zeros((1, INPUT), np.float32)])
        place, there = _cut(b - low, e - low, high - low)
        states = np.concatenate([_layer((x @ net.inputs[d] + net.biases[d])[place], there, net.states[d], bool(d), False)[0] for d in (0, 1)], axis=2)
        logits[at : at + _BLOCK] = _pool(net, states, there)[0]
    return np.maximum.reduceat(logits, np.flatnonzero(np.diff(text, prepend=-1)))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> Model:
    keep = F.lit(True) if keep is None else keep
    model = train(labelled(docs, labels, "toxic", keep, SAMPLE_ROWS))
    n = labels.where(F.col("toxic").isin(0, 1) & keep).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all")).first()
    if model.network is not None:  # the calibration weighs both labels alike, the corpus doesn't
        model.weights = (model.weights[0] + float(np.log(n["toxic"] / (n["all"] - n["toxic"]))), model.weights[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, model.share)
            if model.network is not None:
                for first, end, data, offsets in slices(batch.column("text")):
                    z = _scores(model.network, _words(data, offsets))
                    out[first:end] = 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * z.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def classified(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, threshold: float = 0.7) -> DataFrame:
    """A row per document with its score; labels are learnt from the folds other than held_fold."""
    model = fit(docs, labels, fold_of(F.col("doc_id"), folds) != held_fold)
    return score(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
