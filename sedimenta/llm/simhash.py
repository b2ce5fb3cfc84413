"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius through BK-trees.

Texts with the same fingerprint are one node, so exact copies cost one comparison however many there
are. Two fingerprints within the radius agree on at least one of radius + 1 bands of their bits; each
band's value is a shard, whose fingerprints make up one BK-tree: a node's children are keyed by their
Hamming distance to it, and a search follows only the edges within the radius of the distance to the
node. Shards are sent to where their fingerprints meet instead of being broadcast, as trees of all
fingerprints grow with the corpus. A shard of more than SHARD fingerprints is divided
by bands of its free bits, up to four levels deep; what is left then has 13 free bits, so no tree
has over 8,192 nodes. Only a spanning forest of a shard's links leaves it.

Null texts are empty; a text without word has fingerprint zero and links like any other. Repeated rows
are rows, with the same component. Of documents without doc_id the component is that of the others,
or null. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.graph import components
from sedimenta.llm.tables import row_id, staged
from sedimenta.llm.words import Hasher, mix, slices, split

SHINGLE = 3
RADIUS = 2
SHARD = 2048
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shingles(starts: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts with a word, first shingle of each and one more, first word and end word of each shingle).

    A text of fewer than n words has one shingle, of all of them.
    """
    first = np.searchsorted(starts, offsets)  # of each text, the first word
    words = np.diff(first)
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    kept = np.flatnonzero(counts)
    at = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(counts[kept], out=at[1:])
    begin = np.repeat(first[:-1][kept] - at[:-1], counts[kept]) + np.arange(at[-1])
    return kept, at, begin, begin + np.repeat(np.minimum(words[kept], n), counts[kept])


def _majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text, a number whose bits are 1 where over half its hashes have a 1."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at[:-1], axis=0, dtype=np.int32)
    over = (2 * ones > np.diff(at)[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _of_slice(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the texts of one slice; a shingle counts as often as it is there."""
    data = _LOWER[data]
    starts, ends = split(data)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    if not len(starts):
        return out
    # words of a text stand behind one another with one space between
    sizes = ends - starts
    compact_starts = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=compact_starts[1:])
    compact = np.full(int(compact_starts[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(compact), dtype=bool)
    inside[compact_starts[1:] - 1] = False
    mask = np.zeros(len(data) + 1, dtype=np.int8)
    mask[starts] = 1
    mask[ends] -= 1
    compact[inside] = data[np.cumsum(mask[:-1]).astype(bool)]
    kept, at, begin, end = _shingles(starts, offsets, n)
    raw, digest, seed = compact.tobytes(), xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(raw[a:b], seed) for a, b in zip(compact_starts[begin].tolist(), (compact_starts[end] - 1).tolist(), strict=True)], dtype="<u8")
    out[kept] = _majority(hashes, at)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=np.uint64)
            for first, end, data, offsets in slices(batch.column("text")):
                found[first:end] = _of_slice(data, offsets, shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


class BKTree:
    """Numbers of any width under Hamming distance; no number twice."""

    def __init__(self) -> None:
        self.root: list | None = None  # [number, {distance: node}]

    def near(self, x: int, radius: int) -> list[tuple[int, int]]:
        """(distance, number) of all numbers within the radius of x."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append((d, value))
            low, high = d - radius, d + radius
            for k, child in children.items():
                if low <= k <= high:
                    todo.append(child)
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child


class _Sets:
    """Disjoint sets, each known by its least member."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        above = self.above
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(x), self.find(y)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def forest(values: dict[int, int], radius: int) -> list[tuple[int, int]]:
    """(node, root) of each node that isn't the least of its component; values has the node of each number."""
    tree, sets = BKTree(), _Sets()
    for x, node in values.items():
        for _, y in tree.near(x, radius):
            sets.join(node, values[y])
        tree.add(x)
    return [(n, r) for n in values.values() if (r := sets.find(n)) != n]


def nearest_links(values: dict[int, int], radius: int) -> list[tuple[int, int]]:
    """Links between nodes: a spanning forest of all pairs within the radius that takes the nearest pairs first.

    So whatever distance up to the radius is held to be near enough, the links up to it join what all such pairs join.
    """
    tree, sets, found = BKTree(), _Sets(), []
    for x, node in values.items():
        found += [(d, node, values[y]) for d, y in tree.near(x, radius)]
        tree.add(x)
    found.sort()
    return [(u, v) for _, u, v in found if sets.join(u, v)]


def links_across(left: dict[int, tuple[int, int]], right: dict[int, tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links between nodes of left and of right, whose numbers have (node, root): a forest over the roots, nearest pairs first."""
    tree, sets, found = BKTree(), _Sets(), []
    for x in right:
        tree.add(x)
    for x, (node, root) in left.items():
        found += [(d, node, right[y][0], root, right[y][1]) for d, y in tree.near(x, radius) if right[y][1] != root]
    found.sort()
    return [(u, v) for _, u, v, a, b in found if sets.join(a, b)]


def _bands(bits: list[int], n: int) -> list[list[int]]:
    cuts = [round(k * len(bits) / n) for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _divided(entries: DataFrame, free: list[list[int]], radius: int) -> tuple[DataFrame, list[list[int]]]:
    """entries of (fp, shard, path), each once for each band of its path's free bits."""
    masks, after = [], []
    for bits in free:
        row = []
        for band in _bands(bits, radius + 1):
            row.append(_signed(sum(1 << b for b in band)))
            after.append([b for b in bits if b not in set(band)])
        masks.append(row)
    table = F.array(*(F.array(*(F.lit(m).cast("long") for m in row)) for row in masks))
    cut = entries.select("fp", "node", "shard", "path", F.posexplode(F.get(table, F.col("path"))).alias("k", "mask"))
    return cut.select("fp", "node", F.xxhash64("shard", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"), (F.col("path") * (radius + 1) + F.col("k")).alias("path")), after


def _linked(entries: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of each shard's forest, between nodes. Shards stand together and in order; one is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, {}
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            fps = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for shard, fp, node in zip(batch.column("shard").to_pylist(), fps, batch.column("node").to_pylist(), strict=True):
                if shard != now:
                    pairs += forest(values, radius) if len(values) > 1 else []
                    now, values = shard, {}
                values[fp] = node
            yield _pairs(pairs)
        yield _pairs(forest(values, radius) if len(values) > 1 else [])

    return entries.select("shard", "fp", "node").repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "u bigint, v bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v) between the nodes of distinct (fp, node) whose components are those of all pairs within the radius."""
    found: list[DataFrame] = []
    entries = distinct.select("fp", "node", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path"))
    free = [list(range(64))]
    for level in range(4):
        entries, free = _divided(entries, free, radius)
        sizes = entries.groupBy("shard").agg(F.count("*").alias("_n")).where("_n > 1")
        sized = staged(entries.join(sizes, "shard"))
        last = level == 3
        found.append(_linked(sized if last else sized.where(F.col("_n") <= shard), radius))
        entries = sized.where(F.col("_n") > shard).select("fp", "node", "shard", "path")
        if last or not entries.take(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes, stored, with a column node that numbers them in order: no two alike, the first the least."""
    return staged(nodes.orderBy(*order).withColumn("node", F.monotonically_increasing_id()))


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id (the least doc_id that links reach)."""
    marked = staged(fingerprints(docs, shingle))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    nodes = numbered(least.select("fp", "_least", F.col("_least").isNull().alias("_none")), "_none", "_least", "fp")
    roots = components(links(nodes, radius)).where("node <> root").select(F.col("node").alias("_node"), "root")
    # a component's least node has its least document, so no group is gathered for it
    named = nodes.join(roots, nodes["node"] == roots["_node"], "left").select("fp", "_least", "root")
    first = nodes.select(F.col("node").alias("_first"), F.col("_least").alias("_name"))
    named = named.join(first, named["root"] == first["_first"], "left").select("fp", F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("_name")).alias("component_id"))
    return marked.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Lanes of 64 bits of a wide fingerprint, and bits that may differ: at a similarity of 0.8 they are 39 on average with a
#: deviation of 6, so one such pair in 800 is beyond. What is within the radius is verified on the shingles themselves.
LANES = 4
WIDE_RADIUS = 57
SIMILARITY = 0.8
#: A shard is a band of ROWS min-hashes, of which a text has BANDS: two texts of similarity 0.8 share one with probability 0.995.
BANDS = 10
ROWS = 4
#: A shard with more fingerprints than this is dealt over blocks of so many, which have PIVOTS of them in common, about; what is then still apart is compared between blocks.
BLOCK = 1024
PIVOTS = 32
#: Shards to be dealt out are broadcast up to this number.
BROADCAST_SHARDS = 100_000
_HASHER = Hasher(50)
_DRAW = np.random.Generator(np.random.PCG64(SEED))
_SALT = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with a word, first shingle of each and one more, hashes): of each text the distinct hashes of its shingles, in order."""
    data = _LOWER[data]
    starts, ends = split(data)
    kept, at, begin, end = _shingles(starts, offsets, n)
    hashes = _HASHER.spans(_HASHER.words(data, starts, ends), begin, end)
    text = np.repeat(np.arange(len(kept)), np.diff(at))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    sizes = np.bincount(text[fresh], minlength=len(kept))
    return kept, np.concatenate(([0], np.cumsum(sizes))), hashes[fresh]


def _wide(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(texts, LANES + BANDS): wide fingerprints and shards of the texts of one slice. Texts without word have zeros."""
    out = np.zeros((len(offsets) - 1, LANES + BANDS), dtype=np.uint64)
    kept, at, hashes = _sets(data, offsets, n)
    if not len(kept):
        return out
    for lane in range(LANES):
        out[kept, lane] = _majority(mix(hashes + np.uint64(lane)), at)
    for band in range(BANDS):
        key = np.full(len(kept), band, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key ^ np.minimum.reduceat((hashes ^ _SALT[k]) * _ODD[k], at[:-1]))
        out[kept, LANES + band] = key
    return out


def _dealt(keyed: DataFrame, block: int, pivots: int) -> DataFrame:
    """keyed (key, node, ...), in which a key of more than block rows is divided into keys of about block + pivots rows."""
    large = staged(keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block).withColumnRenamed("key", "_large"))
    found = large.count()
    if not found:
        return keyed
    sized = keyed.join(F.broadcast(large) if found <= BROADCAST_SHARDS else large, F.col("key") == F.col("_large"), "left")
    blocks = F.ceil(F.col("_n") / block)
    own = F.xxhash64("key", F.pmod(F.xxhash64("key", "node"), blocks))
    every = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.xxhash64("key", b))
    keys = F.when(F.col("_n").isNull(), F.array("key")).when(F.pmod(F.xxhash64("node", "key"), F.col("_n")) < pivots, every).otherwise(F.array(own))
    return sized.withColumn("_keys", keys).select(F.explode("_keys").alias("key"), *(c for c in keyed.columns if c != "key"))


def _apart(keyed: DataFrame, roots: DataFrame, block: int) -> DataFrame | None:
    """(pair, side, node, root, ...): what is left to compare of the keys of more than block rows in keyed (key, node, ...), or None.

    Rows of the same root are linked already. So all rows outside a key's largest component, in blocks, are to be compared with all
    rows of the key, in blocks: each pair of blocks is one value of pair, whose rows have side 0 and 1.
    """
    large = staged(keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block).withColumnRenamed("key", "_large"))
    found = large.count()
    if not found:
        return None
    rows = keyed.join(F.broadcast(large) if found <= BROADCAST_SHARDS else large, F.col("key") == F.col("_large")).drop("_large")
    named = roots.select(F.col("node").alias("_node"), "root")
    rows = staged(rows.join(named, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node"))
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("_c"))
    main = parts.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("_c", "root")).alias("_main"), F.sum("_c").alias("_all")).select("_key", F.col("_main.root").alias("_main"), (F.col("_all") - F.col("_main._c")).alias("_rest")).where("_rest > 0")
    rows = rows.join(F.broadcast(main) if found <= BROADCAST_SHARDS else main, F.col("key") == F.col("_key"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(n / block) - 1)
    mine = lambda n: F.pmod(F.xxhash64("key", "node"), F.ceil(n / block))
    n, rest = F.col("_n"), F.col("_rest")
    rest_block, own_block = mine(rest), mine(n)
    one = F.transform(upto(n), lambda j: F.struct(F.xxhash64("key", rest_block, j).alias("pair"), F.lit(0).alias("side")))
    other = F.transform(upto(rest), lambda i: F.struct(F.xxhash64("key", i, own_block).alias("pair"), F.lit(1).alias("side")))
    every = F.when(F.col("root") == F.col("_main"), other).otherwise(F.concat(one, other))
    return rows.withColumn("_at", F.explode(every)).select(F.col("_at.pair").alias("key"), F.col("_at.side").alias("side"), "root", *(c for c in keyed.columns if c != "key"))


_LANES = [f"f{k}" for k in range(LANES)]


def _numbers(batch: pa.RecordBatch) -> list[int]:
    """The wide fingerprints of a batch, each as one number."""
    raw = np.stack([batch.column(lane).to_numpy() for lane in _LANES], axis=1).astype("<i8").tobytes()
    return [int.from_bytes(raw[i : i + 8 * LANES], "little") for i in range(0, len(raw), 8 * LANES)]


def _by_shard(rows: DataFrame, compare: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """Links (u, v) of compare on the rows (number, node, side, root) of each key, one key in memory at a time; keys of one row are left out."""
    columns = [c for c in ("side", "root") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            rest = [batch.column(c).to_pylist() for c in columns]
            for key, *row in zip(batch.column("key").to_pylist(), _numbers(batch), batch.column("node").to_pylist(), *rest, strict=True):
                if key != now:
                    found += compare(held) if len(held) > 1 else []
                    now, held = key, []
                held.append(row)
            yield _pairs(found)
        yield _pairs(compare(held) if len(held) > 1 else [])

    placed = rows.select("key", *_LANES, "node", *columns).repartition("key").sortWithinPartitions("key", "node")
    return placed.mapInArrow(run, "u bigint, v bigint").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of rows (node, text): 32 bits of each distinct shingle's hash, in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for first, _, data, offsets in slices(batch.column("text")):
                kept, at, hashes = _sets(data, offsets, shingle)
                short = (hashes >> np.uint64(32)).astype("<u4")
                for k, i in enumerate(kept.tolist()):
                    out[first + i] = np.unique(short[at[k] : at[k + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node bigint, shingles binary")


def alike(one: bytes, other: bytes) -> float:
    """Similarity (Jaccard) of two sets of _shingle_sets."""
    a, b = np.frombuffer(one, dtype="<u4"), np.frombuffer(other, dtype="<u4")
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, shingles) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(a.as_py(), b.as_py()) >= similarity for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _shards(bands: list[str]) -> Column:
    return F.array(*(F.xxhash64(F.lit(k), b) for k, b in enumerate(bands)))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(_r1, _r2) of the rows docs(_r1, _r2, _order, text) that are the first, by _order, of their group of near copies.

    Groups are the components of all pairs of a similarity (Jaccard, on distinct lower-cased shingles) of 0.8 or more. Pairs are
    searched by wide SimHash fingerprints, 256 bits over the distinct shingles, in BK-trees. At such a radius neither one tree nor
    bands of bits can divide a corpus, so a tree's shard is a band of min-hashes. A shard gives a spanning forest of its near pairs,
    nearest first, never all of them; its links are then verified on the shingles, and only verified ones join. Texts of
    equal fingerprints are one node. Of pairs of 0.8 some 0.5 % share no shard and 0.1 % are beyond the radius; of pairs of 0.85, next to none.

    A large group of near copies, or a template that many texts share, fills a shard beyond BLOCK fingerprints. Such a shard is
    dealt over blocks by hash, and its pivots, drawn by hash too, go to all of its blocks: whatever is near to one of them or to a
    block-mate is linked. Then what isn't in the shard's largest component is compared with all of the shard, a pair of blocks at a
    time. So all pairs of a shard are seen or known to be linked, and no task holds more than two blocks. A group of near copies takes
    time in proportion to its size; a shard of texts that aren't near to one another takes the square of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, LANES + BANDS), dtype=np.uint64)
            for first, end, data, offsets in slices(batch.column("text")):
                out[first:end] = _wide(data, offsets, shingle)
            own = [batch.column(c) for c in ("_r1", "_r2", "_order")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(out[:, k].view(np.int64)) for k in range(LANES + BANDS))], names=["_r1", "_r2", "_order", *_LANES, *bands])

    bands = [f"b{k}" for k in range(BANDS)]
    schema = docs.select("_r1", "_r2", "_order").schema
    for name in (*_LANES, *bands):
        schema = schema.add(name, "long")
    marked = docs.select("_r1", "_r2", "_order", "text").mapInArrow(run, schema)
    first = F.min(F.struct("_order", "_r1", "_r2")).alias("_first")
    nodes = numbered(marked.groupBy(*_LANES).agg(first, *(F.min(b).alias(b) for b in bands)), "_first")
    keyed = nodes.select(F.explode(_shards(bands)).alias("key"), "node", *_LANES)
    found = staged(_by_shard(_dealt(keyed, BLOCK, PIVOTS), lambda rows: nearest_links(dict(rows), WIDE_RADIUS)))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        chosen = nodes.join(ends, "node", "left_semi").select("node", F.col("_first._r1").alias("_r1"), F.col("_first._r2").alias("_r2"))
        texts = docs.select("_r1", "_r2", "text").join(chosen, ["_r1", "_r2"]).dropDuplicates(["node"])
        return staged(_shingle_sets(texts, shingle))

    near = staged(_verified(found, sets_of(found), similarity))
    roots = components(near)
    apart = _apart(keyed, roots, BLOCK)
    if apart is not None:

        def across(rows: list[tuple]) -> list[tuple[int, int]]:
            sides = [{number: (node, root) for number, node, side, root in rows if side == s} for s in (0, 1)]
            return links_across(*sides, WIDE_RADIUS)

        more = staged(_by_shard(apart, across))
        roots = components(near.unionAll(_verified(more, sets_of(more), similarity)))
    gone = roots.where("node <> root").select("node")
    return nodes.join(gone, "node", "left_anti").select(F.col("_first._r1").alias("_r1"), F.col("_first._r2").alias("_r2"))


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: the one of the least doc_id (null last)."""
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"))
    keyed = docs.select(*row_id(), order.alias("_order"), "text", F.struct("*").alias("_row"))
    stay = near_copies(keyed, shingle)
    return keyed.select("_r1", "_r2", "_row").join(stay, ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"]).select("_row.*")
