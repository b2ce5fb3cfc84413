"""Substring dedup: words inside a run of WINDOW words that also starts elsewhere are cut.

A window's fingerprint is the least hash of the runs of GRAM words in it. Equal windows have equal
fingerprints, at equal places, and neighbouring windows mostly share theirs, so a text of n words
has about n / 13 *anchors* (fingerprint, first window, number of windows) that stand for all its
windows. The index is log-structured. Documents come in batches; each batch's anchors, summed by fingerprint, become an
immutable run, sorted and stored by buckets of the fingerprint, so that it is merge-joined with every historical run
without another shuffle. Fingerprints that a batch has twice, or shares with history, are candidates, in the batch and in
history alike. Then the runs are compacted into one by merging rows of equal fingerprints.

Candidates are verified. All windows of a stretch under an anchor that is there twice or more repeat (64 bits of fingerprint and
64 of the stretch agree). Of a stretch that is there once, under a fingerprint that is there more often, two 64-bit hashes of
each window are counted with those of one anchor for each other stretch of that fingerprint, and windows with the same 128 bits
twice or more repeat. Passages that are in many documents are thus counted before they are joined, and nothing but one
document's own marks is ever gathered.

A null text has no words. Repeated rows are rows: each repeats the other. A null doc_id is a document like others.
A text with fewer than WINDOW words is kept whole. An empty table gives no rows. A text has fewer than 2 ** 34 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.tables import discard, row_id, scratch, staged
from sedimenta.llm.words import Hasher, mix, slices, split

WINDOW = 35
GRAM = 11
_FIRST, _SECOND = Hasher(20), Hasher(21)
#: Batches that a table is taken in.
BATCHES = 4
#: Bits of a number that holds an anchor's first window and, below, how many windows it has. Above are 24 bits of a second hash of
#: the document, which with the 64 of _rid make it one of 2 ** 88.
_COUNT_BITS = 6
_AT_BITS = 40


def _own(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each word, and first word of each text."""
    first = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, fingerprint, stretch hash) of a slice's anchors."""
    starts, ends = split(data)
    reach = WINDOW - GRAM + 1
    empty = np.empty(0, dtype=np.int64)
    if len(starts) < WINDOW:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = _FIRST.words(data, starts, ends)
    text, first = _own(starts, offsets)
    grams = _FIRST.grams(hashes, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(len(grams) - reach + 1)
    whole = np.flatnonzero(text[: len(least)] == text[WINDOW - 1 :])
    if not len(whole):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    least = least[whole]
    begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    counts = np.diff(np.append(begins, len(whole)))
    at = whole[begins]
    up, down = _FIRST.of_words.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    stretch = mix((sums[at + counts + WINDOW - 1] - sums[at]) * down[at] + counts.astype(np.uint64))
    return text[at], at - first[text[at]], counts, grams[least[begins]], stretch


def anchors(docs: DataFrame) -> DataFrame:
    """(m, span, rid, at, batch) of docs(_rid, _tag, _batch, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, tags, own = (batch.column(c).to_numpy() for c in ("_rid", "_tag", "_batch"))
            for first, _, data, offsets in slices(batch.column("_text")):
                text, at, counts, m, span = _anchors(data, offsets)
                row = first + text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(span.view(np.int64)), pa.array(rids[row]), pa.array(tags[row] | at << _COUNT_BITS | counts), pa.array(own[row])], names=["m", "span", "rid", "at", "batch"]
                )

    return docs.select("_rid", "_tag", "_batch", "_text").mapInArrow(run, "m bigint, span bigint, rid bigint, at bigint, batch int")


def _tag(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(-(1 << _AT_BITS)).cast("long"))


class Index:
    """Sorted immutable runs of (m, n, low, high): how often each fingerprint m is, and the least and greatest stretch under it.

    Runs are stored in as many buckets of m as the session shuffles to when the index is made. Beside them it keeps where its
    batches' anchors and texts are stored, to verify what is only partly equal.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        self.batches: list[tuple[DataFrame, DataFrame]] = []
        self.joined = 0

    def _stored(self, rows: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        name = path.rpartition("/")[2].replace("-", "_")
        # high is null where it is low: most fingerprints are there once, and nulls take no room
        lean = rows.select("m", "n", "low", F.when(F.col("low") != F.col("high"), F.col("high")).alias("high"))
        lean.write.bucketBy(self.buckets, "m").sortBy("m").option("path", path).saveAsTable(name)
        stored = self.spark.table(name)
        out = stored.select("m", "n", "low", F.coalesce("high", "low").alias("high"))
        out._staged_at, out._table = path, name
        return out

    def _dropped(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run._table}")
        discard(run)

    def append(self, found: DataFrame) -> DataFrame:
        """Takes a batch's stored anchors in as a run, merge-joined with every historical run.

        Returns the stored fingerprints m that the batch has twice or more, or that it shares with history.
        """
        run = self._stored(found.groupBy("m").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")))
        hit = run.where("n > 1").select("m")
        for past in self.runs:
            hit = hit.unionAll(run.select("m").hint("merge").join(past.select("m"), "m", "left_semi"))
            self.joined += 1
        self.runs.append(run)
        return staged(hit.distinct())

    def compact(self) -> None:
        """One run instead of all."""
        if len(self.runs) > 1:
            rows = self.runs[0]
            for run in self.runs[1:]:
                rows = rows.unionAll(run)
            whole = self._stored(rows.groupBy("m").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
            for run in self.runs:
                self._dropped(run)
            self.runs = [whole]


def _windows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(wa, wb, rid, at, k, n): two hashes of each window k of the chosen anchors (rid, at, n)."""
    per_doc = chosen.groupBy("rid", _tag("at").alias("tag")).agg(F.collect_list(F.struct("at", "n")).alias("chosen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("chosen")
            bounds, flat = lists.offsets.to_numpy(), lists.values
            rids = batch.column("_rid").to_numpy()
            for first, end, data, offsets in slices(batch.column("_text")):
                starts, ends = split(data)
                begin = np.searchsorted(starts, offsets)
                lo, hi = bounds[first], bounds[end]
                text = np.repeat(np.arange(end - first), np.diff(bounds[first : end + 1]))
                at, n = (flat.field(k).to_numpy()[lo:hi] for k in range(2))
                place, counts = _of_at(at)
                place = np.repeat(place + begin[text], counts)
                k = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
                both = [h.grams(h.words(data, starts, ends), WINDOW)[place + k].view(np.int64) for h in (_FIRST, _SECOND)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, both), pa.array(np.repeat(rids[first + text], counts)), pa.array(np.repeat(at, counts)), pa.array(k), pa.array(np.repeat(n, counts))], names=["wa", "wb", "rid", "at", "k", "n"]
                )

    # _row isn't needed here, but lets the shuffle of texts be the one that cut() has anyway
    joined = docs.join(per_doc, (docs["_rid"] == per_doc["rid"]) & (docs["_tag"] == per_doc["tag"]))
    return joined.select("_rid", "_text", "_row", "chosen").mapInArrow(run, "wa bigint, wb bigint, rid bigint, at bigint, k bigint, n bigint")


def _of_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, how many) of anchors."""
    at = at & ((1 << _AT_BITS) - 1)
    return at >> _COUNT_BITS, at & ((1 << _COUNT_BITS) - 1)


def cut(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), index: Index | None = None, batches: int = BATCHES) -> DataFrame:
    """columns, and _kept (text without the repeated words, or text itself), _n_words, _n_removed, _kept_sha256.

    docs are taken in as so many batches, dealt by a hash; what a later batch repeats of an earlier one is cut in both. With an
    index, what docs repeat of its history is cut as well, and docs become part of it; history's documents stay as
    they are. Every window that is cut is verified, against history too.
    """
    one, two = row_id()
    source = docs.select(one.alias("_rid"), two.bitwiseAND(F.lit(-(1 << _AT_BITS)).cast("long")).alias("_tag"), F.col("text").alias("_text"), F.struct(*columns).alias("_row"))
    source = source.withColumn("_batch", F.pmod("_rid", F.lit(batches)).cast("int"))
    index = index or Index(docs.sparkSession)
    past = list(index.batches)
    found = staged(anchors(source), "batch")
    hit = index.append(found.where("batch = 0"))
    for k in range(1, batches):
        hit = hit.unionAll(index.append(found.where(F.col("batch") == k)))
    index.compact()
    index.batches.append((found, source))
    # under a fingerprint with one stretch all its windows repeat; those with several go by stretch
    told = staged(index.runs[0].join(hit.distinct(), "m", "left_semi").select("m", (F.col("low") != F.col("high")).alias("mixed")))
    candidates = staged(found.join(told, "m").select("rid", "at", "m", "span", "mixed"))
    mixed = candidates.where("mixed").drop("mixed")
    each = mixed.groupBy("m", "span").agg(F.count("*").alias("n"))
    if past:
        wanted = mixed.select("m").distinct()
        for anchors_then, _ in past:
            each = each.unionAll(anchors_then.join(wanted, "m", "left_semi").groupBy("m", "span").agg(F.count("*").alias("n")))
        each = each.groupBy("m", "span").agg(F.sum("n").alias("n"))
    each = staged(each)
    least = each.groupBy("m").agg((F.min("n") == 1).alias("several"))
    each = staged(each.join(least, "m"))  # stored, so that the next join is by both columns and can be split
    part = staged(mixed.join(each, ["m", "span"]).select("rid", "at", "m", "span", "n", "several"))
    lone = part.where("n = 1").select("rid", "at", "n")
    # one anchor stands for all with its stretch, as many times as there are
    first = lambda rows: rows.groupBy("m", "span").agg(F.min(F.struct("rid", "at")).alias("first"), F.lit(2).cast("long").alias("n")).select("first.rid", "first.at", "n")
    windows = _windows(source, lone.unionAll(first(part.where("n > 1 AND several"))))
    counts = windows.select("wa", "wb", "n")
    for anchors_then, source_then in past:
        near = anchors_then.join(part.where("n = 1").select("m").distinct(), "m", "left_semi")
        counts = counts.unionAll(_windows(source_then, first(near)).select("wa", "wb", F.lit(1).cast("long").alias("n")))
    counted = counts.groupBy("wa", "wb").agg(F.sum("n").alias("_times")).where("_times > 1")
    marks = windows.where("n = 1").join(counted, ["wa", "wb"]).groupBy("rid", "at").agg(F.bit_or(F.expr("shiftleft(1L, cast(k AS int))")).alias("bits"))
    whole = F.lit(-1).cast("long").alias("bits")
    settled = candidates.where("NOT mixed").select("rid", "at", whole).unionAll(part.where("n > 1").select("rid", "at", whole))
    per_doc = settled.unionAll(marks).groupBy("rid", _tag("at").alias("tag")).agg(F.collect_list(F.struct("at", "bits")).alias("_marks"))
    joined = source.join(per_doc, (source["_rid"] == per_doc["rid"]) & (source["_tag"] == per_doc["tag"]), "left").select("_text", "_row", "_marks")
    schema = docs.select(*columns).schema.add("_kept", "string").add("_n_words", "long").add("_n_removed", "long").add("_kept_sha256", "string")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_marks").fill_null([])
            bounds, flat = lists.offsets.to_numpy(), lists.values
            at_all, bits_all = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            texts = batch.column("_text")
            kept, n_words, n_removed, digests = [], [], [], []
            for first, end, data, offsets in slices(texts):
                starts, ends = split(data)
                begin = np.searchsorted(starts, offsets)
                lo, hi = bounds[first], bounds[end]
                text = np.repeat(np.arange(end - first), np.diff(bounds[first : end + 1]))
                at, bits = at_all[lo:hi], bits_all[lo:hi]
                place, counts = _of_at(at)
                place = place + begin[text]
                flags = np.zeros(len(starts) + WINDOW, dtype=np.int64)
                for k in range(WINDOW - GRAM + 1):
                    flags[place[(counts > k) & (bits >> k & 1 == 1)] + k] = 1
                running = np.cumsum(flags)
                running[WINDOW:] -= running[:-WINDOW].copy()
                gone = running[: len(starts)] > 0
                out = _compact(data, starts, ends, ~gone)
                left = np.concatenate(([0], np.cumsum(~gone)))[begin]
                removed = np.diff(begin) - np.diff(left)
                stay = np.flatnonzero(~gone)
                sizes = np.concatenate(([0], np.cumsum(ends[stay] - starts[stay] + 1)))[left]
                for i in range(end - first):
                    words = out[sizes[i] : max(sizes[i + 1] - 1, sizes[i])]
                    digests.append(hashlib.sha256(words).hexdigest())
                    kept.append(None if removed[i] == 0 else _without(data[offsets[i] : offsets[i + 1] - 1], starts[begin[i] : begin[i + 1]] - offsets[i], ends[begin[i] : begin[i + 1]] - offsets[i], gone[begin[i] : begin[i + 1]]))
                n_words += np.diff(begin).tolist()
                n_removed += removed.tolist()
            same = texts.to_pylist()
            texts_out = [t if k is None else k.decode() for t, k in zip(same, kept, strict=True)]
            rows = batch.column("_row").flatten()
            yield pa.RecordBatch.from_arrays([*rows, pa.array(texts_out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=names)

    return joined.mapInArrow(run, schema)


def _compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stay: np.ndarray) -> bytes:
    """Bytes of the words that stay, a space behind each."""
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[starts[stay]] += 1
    mask[ends[stay] + 1] -= 1
    out = data[np.cumsum(mask[: len(data)]).astype(bool)]
    sizes = ends[stay] - starts[stay] + 1
    out[np.cumsum(sizes) - 1] = 0x20
    return out.tobytes()


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """A text without the words that are gone; each takes the separators behind it along."""
    until = np.append(starts[1:], len(data))
    mask = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(mask, starts[gone], 1)
    np.add.at(mask, until[gone], -1)
    return data[np.cumsum(mask[:-1]) == 0].tobytes()
