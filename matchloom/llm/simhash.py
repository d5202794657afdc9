"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is linked to every other one that differs in at most 3 bits. If two fingerprints differ in 3
bits at most, then in one of their halves they differ in at most one; so each half is covered on its own, with
threshold 1. The anchors are the codewords of the Hamming code of length 31 on the half's first 31 bits. The code is
perfect: every word is within its covering radius 1 of exactly one codeword, its home. A fingerprint is replicated to
all anchors within radius plus threshold, that is 2: its home, and the 15 codewords at distance 2 if it isn't one
itself. If x and y differ in at most one bit of the half, y is within 2 of x's home, so each link is found where one of
the two is at home. Every pair compared is checked on all 64 bits.

Copies collapse to one row before that (class representatives), an anchor's rows are compared in sorted runs, and of
the links of an anchor only a spanning forest is passed on, so the volume is linear whatever the groups' sizes. An
anchor that is home to more than RUN fingerprints is split over many tasks: fingerprints that differ in 3 bits at most
agree in one of the four bytes of the other half, so each goes to four parts, one for each byte's value.

Defined results: a null or empty text (and one of white space only) has fingerprint 0 and is linked like any other;
equal texts share a component; a null doc_id counts after every other id; repeated rows give equal rows; other columns
are ignored (near_duplicates) or kept (deduplicate); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, fresh, materialise
from .components import connected_components

SHINGLE, SEED, BITS = 3, 42, 3
#: A larger run is compared only where one of the four bytes of the other half agrees.
RUN = 2048
#: Hot anchors that are sent to all executors, eight bytes each; more are joined by shuffling.
BROADCAST = 1 << 16
#: Links that are held before they are merged into the forest.
HELD = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 of the word shingles of the text with A-Z in lower case; as a signed long."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first : first + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def syndromes(words: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the bits set in each word of 31 bits."""
    out = np.zeros(len(words), np.int64)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        out |= (np.bitwise_count(words & mask).astype(np.int64) & 1) << k
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys and fingerprints (signed): key = (half, codeword of 31 bits, 0 at home or 1 elsewhere)."""
    keys, owners = [], []
    unsigned = prints.view(np.uint64)
    for half in (0, 1):
        word = ((unsigned >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = syndromes(word)
        flip = np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
        keys.append((half << 32) | (word ^ flip) << 1)
        owners.append(prints)
        for i in range(1, 32):
            j = s ^ i
            own = (s > 0) & (j > i)
            keys.append((half << 32) | (word[own] ^ (1 << (i - 1)) ^ (1 << (j[own] - 1))) << 1 | 1)
            owners.append(prints[own])
    return np.concatenate(keys), np.concatenate(owners)


class Forest:
    """Union-find over rows 0..n-1 that takes links in arrays."""

    def __init__(self, n: int):
        self.root, self.held, self.size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
            if self.size >= HELD:
                self.merge()

    def merge(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size, root = [], 0, self.root
            while True:
                x, y = root[a], root[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
            self.root = root
        return self.root


def compare_runs(run: np.ndarray, home: np.ndarray, prints: np.ndarray, bits: int, forest: Forest, at: np.ndarray) -> None:
    """Links rows of equal run (sorted, homes first) of which one is at home and that differ in at most bits bits."""
    n = len(run)
    last = np.searchsorted(run, run, side="right")  # end of each row's run
    left = np.flatnonzero(home & (last - np.arange(n) > 1))
    k = 1
    while len(left):
        near = np.bitwise_count(prints[left] ^ prints[left + k]) <= bits
        forest.add(at[left[near]], at[left[near] + k])
        k += 1
        left = left[left + k < last[left]]


def link_block(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, fingerprint) of whole anchors, given as sorted keys."""
    run, home, rows = keys >> 1, (keys & 1) == 0, np.arange(len(keys))
    forest = Forest(len(keys))
    bounds = np.flatnonzero(np.diff(run)) + 1
    lengths = np.diff(np.concatenate([[0], bounds, [len(run)]]))
    large = np.repeat(lengths > RUN, lengths)
    small = ~large
    compare_runs(run[small], home[small], prints[small], bits, forest, rows[small])
    if large.any():
        r, h, p, w = run[large], home[large], prints[large], rows[large]
        other = np.where(r >> 42 & 1, p & np.uint64(0xFFFFFFFF), p >> np.uint64(32)).astype(np.int64)
        for byte in range(4):
            code = other >> (8 * byte) & 255
            order = np.lexsort((~h, code, r))
            compare_runs((r << 8 | code)[order], h[order], p[order], bits, forest, w[order])
    root = forest.merge()
    moved = np.flatnonzero(root != rows)
    return prints[moved], prints[root[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, print) of a partition, sorted by anchor, part and key; what goes on in the next batch waits."""

    def told(k: list[np.ndarray], p: list[np.ndarray]) -> pa.RecordBatch:
        u, v = link_block(np.concatenate(k), np.concatenate(p).view(np.uint64), BITS)
        pairs = np.unique(np.stack([u.view(np.int64), v.view(np.int64)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    k: list[np.ndarray] = []
    p: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, parts, prints = (np.ascontiguousarray(batch.column(i).to_numpy()) for i in range(3))
        # anchors take 33 bits, parts 11
        keys = (keys >> 1) << 12 | parts.astype(np.int64) << 1 | keys & 1
        cut = int(np.searchsorted(keys >> 1, keys[-1] >> 1))
        if cut:
            yield told([*k, keys[:cut]], [*p, prints[:cut]])
            k, p = [], []
        k.append(keys[cut:])
        p.append(prints[cut:])
    if k:
        yield told(k, p)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (xxhash64; null counts as empty), fingerprint (long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, shingle) for x in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, fingerprint long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (column fingerprint) exactly as all pairs within BITS bits do."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 13):
                own = np.ascontiguousarray(batch.column(0).slice(first, 1 << 13).to_numpy())
                yield pa.RecordBatch.from_arrays([*map(pa.array, anchors(own))], names=["key", "print"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in replicate(batches):
            yield batch.filter(pa.compute.equal(pa.compute.bit_wise_and(batch.column("key"), 1), 0)).select(["key"])

    spread = prints.select("fingerprint").mapInArrow(replicate, "key long, print long").withColumn("anchor", F.shiftright("key", 1))
    hot = prints.select("fingerprint").mapInArrow(homes, "key long").groupBy(F.shiftright("key", 1).alias("anchor")).count().where(F.col("count") > RUN)
    hot = materialise(hot.select("anchor"), "hot-anchors")
    if n := hot.count():
        # part 0 is the whole anchor, else the byte's number and value of the half that the anchor doesn't cover
        other = F.when(F.shiftright("key", 32).bitwiseAND(1) == 1, F.col("print")).otherwise(F.shiftright("print", 32))
        bytes_ = F.array(*(1 + 256 * k + F.shiftright(other, 8 * k).bitwiseAND(255) for k in range(4)))
        hot = (F.broadcast(hot) if n <= BROADCAST else hot).withColumn("hot", F.lit(True))
        parts = F.when(F.col("hot"), bytes_).otherwise(F.array(F.lit(0).cast("long")))
        spread = spread.join(hot, "anchor", "left").withColumn("part", F.explode(parts))
    else:
        spread = spread.withColumn("part", F.lit(0).cast("long"))
    dealt = spread.select("key", "part", "print", "anchor").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "key").drop("anchor")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint (long), component_id (least doc_id that links reach) of every row of docs (doc_id, text)."""
    prints = materialise(fingerprints(docs), "fingerprints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = connected_components(link_fingerprints(classes))
    roots = classes.join(roots, classes["fingerprint"] == roots["node"]).select("fingerprint", "least", "root")
    reached = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(reached, "root").select("fingerprint", "component_id")
    own = classes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(own, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that have their component's least doc_id; of repeated ids one row stays.

    Of rows with one id the one with the shortest text stays, a null text last; of equal texts any.
    """
    ident, digest, repeated, row = (fresh(c, docs.columns) for c in ("id", "digest", "repeated", "row"))
    found = near_duplicates(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(ident), F.col("text_hash").alias(digest), F.coalesce("component_id", F.lit(NO_ID)).alias("component"))
    # An id that stands for several texts may be kept with one and go with another.
    kept = materialise(found.where(F.col(ident) == F.col("component")).groupBy(ident, digest).count(), "kept")
    kept = kept.join(kept.groupBy(ident).agg((F.sum("count") > 1).alias(repeated)), ident).drop("count")
    rows = docs.withColumns({ident: F.coalesce("doc_id", F.lit(NO_ID)), digest: text_hash()}).join(kept, [ident, digest])
    # Only ids that occur more than once are sorted.
    first = Window.partitionBy(ident).orderBy(F.col("text").isNull(), F.length("text"), F.xxhash64("text"))
    again = rows.where(F.col(repeated)).withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).drop(row)
    return rows.where(~F.col(repeated)).unionByName(again).select(*docs.columns)
