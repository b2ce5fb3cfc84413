"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Tokens are runs of ASCII letters, digits and bytes from 0x80 on, A-Z lower-cased, so that punctuation and
case don't tell copies apart. Every run of SEED tokens of a test item is a seed, however many documents have it:
an edited item that thousands of documents share keeps its seeds like one that no other has. An item is aligned with the region
of a document around its seeds, if two or more of them (or all it has) are there close together: a match scores
2, a mismatch or a gap -1, and the best local alignment is divided by that of a perfect copy. Copies with words
changed, left out or put in still score. Frequent seeds bring up regions that hold no copy; a bound that no alignment
exceeds tells most of them without one.

The items' tokens go along with the tasks: SHARD_TOKENS at most, and a larger benchmark is done in
several passes of that size, each stored before the driver reads the next. No document's text moves, and a document's hits stay
in its task.

Null texts are empty. An item with fewer than SEED tokens can't be told from chance inside a text: it matches a text of exactly
its tokens. An item without tokens never matches. Repeated items each match; repeated rows are each reported. An item_id may be of
any type, null too. Columns other than doc_id and text, and item_id and text, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from sedimenta.llm.tables import staged
from sedimenta.llm.words import Hasher, slices

SEED = 3
THRESHOLD = 0.4
SHARD_TOKENS = 1_000_000
MATCH, MISS, GAP = 2, -1, -1
_HASHER = Hasher(60)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each token."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _TOKEN[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, _HASHER.words(_LOWER[data], starts, ends)


@dataclass
class _Seeds:
    """Items of one shard: their tokens, and sorted seed hashes with all places where they stand."""

    items: list[tuple[object, np.ndarray]]

    def __post_init__(self) -> None:
        self.short: dict[bytes, list[int]] = {}
        for k, (_, t) in enumerate(self.items):
            if len(t) < SEED:
                self.short.setdefault(t.tobytes(), []).append(k)
        grams = [_HASHER.grams(t, SEED) for _, t in self.items]
        every = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        order = np.lexsort((place, item, every))
        every, self.item, self.place = every[order], item[order], place[order]
        self.hashes, first = np.unique(every, return_index=True)
        self.first = np.append(first, len(every))
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.hashes >> np.uint64(42)] = True
        self.needed = [min(2, len(np.unique(g))) for g in grams]  # so many different seeds bring an item up

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, seed) of all seeds in grams."""
        if not len(self.hashes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.bits[grams >> np.uint64(42)])
        seed = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        same = self.hashes[seed] == grams[at]
        return at[same], seed[same]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end of the alignment in text), a row of the item at a time."""
    n = len(text)
    ramp = np.arange(1, n + 1) * -GAP
    above = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for token in item:
        row = np.maximum(above[:-1] + np.where(text == token, MATCH, MISS), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps in the item
        above[1:] = row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
    return best, end


def bound(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment scores more: what one side alone gains where the other has the token, and pays where it hasn't."""

    def most(gains: np.ndarray) -> int:
        sums = np.concatenate(([0], np.cumsum(gains)))
        return int((sums - np.minimum.accumulate(sums)).max())

    return min(most(np.where(np.isin(text, item), MATCH, MISS)), most(np.where(np.isin(item, text), MATCH, MISS)))


def _regions(places: np.ndarray, at: np.ndarray, seeds: np.ndarray, m: int, needed: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text of n tokens where the item may stand; places are those in the text, at those in the item."""
    order = np.argsort(places, kind="stable")
    places, at, seeds = places[order], at[order], seeds[order]
    cuts = np.flatnonzero(np.diff(places) > m) + 1
    for p, a, s in zip(np.split(places, cuts), np.split(at, cuts), np.split(seeds, cuts), strict=True):
        if len(np.unique(s)) >= needed:
            slack = m // 2 + 2
            yield max(0, int((p - a).min()) - slack), min(n, int((p - a).max()) + m + slack)


def _shards(benchmark: DataFrame) -> Iterator[_Seeds]:
    """All items, a shard at a time: no more than one, and a partition of the benchmark, is in the driver."""
    held: list = []
    size = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        _, tokens = _tokens(np.frombuffer((r["text"] or "").encode(), dtype=np.uint8))
        if not len(tokens):
            continue
        if size and size + len(tokens) > SHARD_TOKENS:
            yield _Seeds(held)
            held, size = [], 0
        held.append((r["item_id"], tokens))
        size += len(tokens)
    if held:
        yield _Seeds(held)


def _of_text(seeds: _Seeds, threshold: float, ids: np.ndarray, begin: int, end: int, places: np.ndarray, seed: np.ndarray) -> Iterator[tuple]:
    """(item, score, first token, end token) of one text, whose tokens are ids[begin:end]."""
    spread = np.diff(seeds.first)[seed]
    which = np.repeat(seeds.first[seed], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
    item, at, place, own = seeds.item[which], seeds.place[which], np.repeat(places, spread) - begin, np.repeat(seed, spread)
    order = np.argsort(item, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        i = int(item[rows[0]])
        if len(rows) < seeds.needed[i]:
            continue
        tokens = seeds.items[i][1]
        best = (0, 0, 0)
        for lo, hi in _regions(place[rows], at[rows], own[rows], len(tokens), seeds.needed[i], end - begin):
            text = ids[begin + lo : begin + hi]
            if bound(tokens, text) < threshold * MATCH * len(tokens):
                continue
            score, stop = align(tokens, text)
            best = max(best, (score, lo, lo + stop))
        share = best[0] / (MATCH * len(tokens))
        if share >= threshold:
            yield i, share, max(best[1], best[2] - 2 * len(tokens)), best[2]


def _hits(column: pa.Array, seeds: _Seeds, threshold: float) -> tuple[list[int], list[tuple]]:
    """(rows, hits) of a column of texts."""
    out, rows = [], []
    for first, _, data, offsets in slices(column):
        starts, hashes = _tokens(data)
        bounds = np.searchsorted(starts, offsets)
        if seeds.short:
            words = np.diff(bounds)
            for t in np.flatnonzero((words > 0) & (words < SEED)).tolist():
                for i in seeds.short.get(hashes[bounds[t] : bounds[t + 1]].tobytes(), ()):
                    rows.append(first + t)
                    out.append((i, 1.0, 0, int(words[t])))
        at, seed = seeds.found(_HASHER.grams(hashes, SEED))
        if not len(at):
            continue
        text = np.searchsorted(bounds, at, side="right") - 1
        whole = at + SEED <= bounds[text + 1]
        at, seed, text = at[whole], seed[whole], text[whole]
        for mine in np.split(np.arange(len(at)), np.flatnonzero(np.diff(text)) + 1):
            if len(mine):
                t = int(text[mine[0]])
                for hit in _of_text(seeds, threshold, hashes, int(bounds[t]), int(bounds[t + 1]), at[mine], seed[mine]):
                    rows.append(first + t)
                    out.append(hit)
    return rows, out


def _aligned(docs: DataFrame, items: DataFrame, seeds: _Seeds, threshold: float) -> DataFrame:
    kind = items.schema["item_id"]
    schema = docs.select("doc_id").schema.add(kind).add("score", "double").add("first_token", "long").add("end_token", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([i for i, _ in seeds.items], to_arrow_type(kind.dataType))
        for batch in batches:
            rows, out = _hits(batch.column("text"), seeds, threshold)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), names.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], (pa.float64(), pa.int64(), pa.int64()), strict=True))],
                names=["doc_id", "item_id", "score", "first_token", "end_token"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document and item with score (1 is a perfect copy) from threshold on, and where it stands in the text's tokens."""
    done: list[DataFrame] = []
    last = None
    for seeds in _shards(benchmark):
        if last is not None:
            done.append(staged(last))
        last = _aligned(docs, benchmark, seeds, threshold)
    if last is None:
        last = _aligned(docs, benchmark, _Seeds([]), threshold)
    for found in done:
        last = found.unionAll(last)
    return last


def cleaned(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, whatever their columns, without those that hold a leak. Rows stay in their tasks."""

    def without(rows: DataFrame, seeds: _Seeds) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(batch.num_rows, dtype=bool)
                stay[_hits(batch.column("text"), seeds, threshold)[0]] = False
                yield batch.filter(pa.array(stay))

        return rows.mapInArrow(run, rows.schema)

    out, shards = docs, 0
    for seeds in _shards(benchmark):
        if shards:
            out = staged(out)
        out, shards = without(out, seeds), shards + 1
    return out
