"""Removal of repeated byte strings by suffix sorting, exact over all documents.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. To sort only what can matter and to
deal it to many tasks, every string has an anchor: of its SPAN substrings of GRAM bytes the first one with the least
hash. That depends on the string alone, so both places of a repeated string have an anchor with the same gram at the
same offset. A piece is what the strings of one anchor cover. Then, by gram and piece,

- a gram that occurs once has no repeated string around it;
- a piece that occurs more than once (copies) is repeated all over;
- pieces of a gram that has several meet in a shard. Strings that have no partner there by hash are left out, as they
  can't be repeated; what is left is laid end to end, and its suffixes are sorted by recursive induction (suffix_sort:
  queues on disk carry suffixes and common prefixes). Neighbours in that order that share LENGTH bytes or more are
  repeated strings, if they start at different places of the documents;
- the pieces of a gram that a large share of all documents holds (over HOT bytes) are dealt to more tasks than one: they
  are split by place and by the content of the bytes that neighbouring strings share, down to single strings, which
  are counted in a shuffle that combines before it sends. That is exact for a group of any size.

What a text loses depends on the text alone (and on how often it occurs), so results meet the documents by two 64-bit
hashes of the text; equality of whole pieces is that of gram hash and BLAKE2b digest.

Defined results: a null text counts as empty and has nothing to remove; repeated rows are repeated texts; texts below
LENGTH bytes are kept; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_memory
from .suffix_sort import sort_suffixes

LENGTH, GRAM = 400, 100
SPAN = LENGTH - GRAM + 1
#: Positions fit into the lower bits of a hash within a segment; an anchor's strings may be parted at its end.
SEGMENT, LOW = 1 << 22, np.uint64((1 << 23) - 1)
#: Neighbouring starts whose strings are looked at together in hot groups.
STEP = 50
#: Bytes of pieces that are looked through at once, and bytes that are sorted at once, unless one gram has more.
PART, SHARD = 1 << 20, 2 << 20
#: Pieces whose results are held at once.
FOUND = 1 << 14
#: Bytes of a gram's pieces from which they are dealt to several tasks.
HOT = 6 << 20

ODD = 0x9E3779B97F4A7C15
SALTS = [k.to_bytes(4, "little") for k in range(SPAN + 1)]
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


class Powers:
    """Powers of ODD and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


class Hashes:
    """Hashes of any substring of a text in constant time."""

    def __init__(self, raw: np.ndarray, powers: Powers):
        powers.reach(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTES[raw] * powers.up[: len(raw)], dtype=np.uint64, out=self.sums[1:])
        self.down = powers.down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours."""
    step, out = 1, h
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For every width neighbours the position of the first least hash, by upper bits; at most 2^23 of them."""
    least = sliding_min(h & ~LOW | np.arange(len(h), dtype=np.uint64), width)
    return (least & LOW).astype(np.int64)


def anchors_of(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...] | None:
    """Position, gram, piece hash, piece start and end of the anchors of a text; None below LENGTH bytes.

    The anchor of a string of LENGTH bytes is the first gram in it whose hash (upper bits) is least; strings with the
    same anchor follow one another, and a piece is what they cover. So each string belongs to one piece.
    """
    n = len(raw)
    if n < LENGTH:
        return None
    hashes, found = Hashes(raw, powers), []
    for begin in range(0, n - LENGTH + 1, SEGMENT):
        end = min(begin + SEGMENT, n - LENGTH + 1) + SPAN - 1
        starts = np.arange(begin, end)
        h = hashes.of(starts, starts + GRAM)
        owner = window_minima(h, SPAN) + begin
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        found.append((owner[head], h[owner[head] - begin], begin + head, begin + np.append(head[1:], len(owner)) - 1 + LENGTH))
    at, gram, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    # the bytes and the anchor's place in them
    data = raw.data
    digests = b"".join([blake2b(data[x:y], digest_size=8, salt=SALTS[z]).digest() for x, y, z in zip(a.tolist(), b.tolist(), (at - a).tolist(), strict=True)])
    return at, gram, np.frombuffer(digests, np.uint64), a, b


def keys() -> tuple[Column, Column]:
    """t1, t2: two hashes of the text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), t1 and t2."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keys())


def occurrences(texts: DataFrame) -> DataFrame:
    """t1, t2, at, gram, piece, before, size, n: the anchors of every text and how many rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found, owner = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    if (x := anchors_of(np.frombuffer(text.encode(), np.uint8), powers)) is not None:
                        found.append(x)
                        owner.append(np.full(len(x[0]), k))
                if found:
                    at, gram, piece, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                    rows = pa.array(np.concatenate(owner))
                    cells = [pa.array(at.astype(np.int64)), pa.array(gram.view(np.int64)), pa.array(piece.view(np.int64)), pa.array((at - a).astype(np.int32)), pa.array((b - a).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([part.column("t1").take(rows), part.column("t2").take(rows), *cells], names=["t1", "t2", "at", "gram", "piece", "before", "size"])
        release_memory()

    made = texts.select("text", "t1", "t2").mapInArrow(run, "t1 long, t2 long, at long, gram long, piece long, before int, size int")
    return made.groupBy(made.columns).agg(F.count(F.lit(1)).alias("n"))


def repeated_starts(raws: list[bytes], text: np.ndarray, place: np.ndarray, folder: str | None) -> np.ndarray:
    """Starts, in the pieces laid end to end, of strings of LENGTH bytes that are repeated; in order.

    text and place: of each piece the id of its text, and where it begins there. Strings are the same one if text and
    place agree; id 0 marks a piece that occurs elsewhere as a whole.
    """
    t = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(x) for x in raws])
    first = np.cumsum(size) - size
    order, prefix = sort_suffixes(t, LENGTH, folder)
    owner = np.repeat(np.arange(len(raws), dtype=np.int32), size)
    fits = np.flatnonzero(order + LENGTH <= (first + size)[owner[order]])
    if not len(fits):
        return fits
    # neighbours that share LENGTH bytes or more, with all that stands between them, begin with the same string;
    # what follows the last of them doesn't part it from the one before
    least = np.minimum.reduceat(prefix[: fits[-1] + 1], np.concatenate([[0], fits[:-1] + 1]))
    heads = np.flatnonzero(np.concatenate([[True], least[1:] < LENGTH]))
    order = np.asarray(order)[fits].astype(np.int64)
    owner = owner[order]
    sign = text[owner] * np.uint64(ODD) + (place[owner] + order - first[owner]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    differs = np.maximum.reduceat(sign, heads) != np.minimum.reduceat(sign, heads)
    # strings that agree have one sign only if they are one and the same, unless a whole piece occurs elsewhere
    differs |= np.minimum.reduceat(text[owner], heads) == 0
    return np.sort(order[np.repeat(differs, np.diff(np.append(heads, len(order))))])


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the numbers first[k] .. first[k] + count[k] - 1, end to end, and k."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


def differing(keys: np.ndarray, sign: np.ndarray, always: np.ndarray) -> np.ndarray:
    """Of rows with equal keys: whether their signs differ or one of them is marked as always."""
    order = np.argsort(keys)
    heads = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    hit = (np.maximum.reduceat(sign[order], heads) != np.minimum.reduceat(sign[order], heads)) | np.logical_or.reduceat(always[order], heads)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(hit, np.diff(np.append(heads, len(keys))))
    return out


class Shard:
    """Runs of strings that are to be sorted together, and the pieces that they come from."""

    def __init__(self):
        #: Different runs: bytes, id of the text (0: occurs elsewhere as a whole) and place in it.
        self.raws, self.text, self.place, self.size = [], [], [], 0
        #: For each run as it occurs: number of the run, its first byte in the piece, and the piece's keys.
        self.members: list[tuple[int, int, int, int]] = []
        #: For pieces by their keys the runs of repeated starts, as far as they are known without sorting.
        self.found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}

    def add(self, raws: list[bytes], text: np.ndarray, place: np.ndarray, keys: list[tuple[int, int]], powers: Powers) -> None:
        """Takes up pieces of whole grams, without the strings that no other place of them can equal.

        Equal strings have equal hashes, so what has no partner by hash is not repeated; whether the others are, is
        decided by sorting. Runs with the same bytes are held once. Pieces that occur elsewhere (id 0) are partners only.
        """
        t, size = np.frombuffer(b"".join(raws), np.uint8), np.array([len(x) for x in raws])
        first = np.cumsum(size) - size
        starts, owner = spread(first, np.maximum(size - LENGTH + 1, 0))
        if not len(starts):
            return
        sign = text[owner] * np.uint64(ODD) + (place[owner] + starts - first[owner]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        can = np.flatnonzero(differing(Hashes(t, powers).of(starts, starts + LENGTH), sign, text[owner] == 0))
        if not len(can):
            return
        head = np.flatnonzero(np.concatenate([[True], (np.diff(starts[can]) != 1) | (np.diff(owner[can]) != 0)]))
        a, b = starts[can[head]], starts[can[np.append(head[1:], len(can)) - 1]] + LENGTH
        runs: dict[bytes, list] = {}  # id and place of the text, gram, and where it occurs
        for x, y, who in zip(a.tolist(), b.tolist(), owner[can[head]].tolist(), strict=True):
            own, at = int(text[who]), int(place[who] + x - first[who])
            run = runs.setdefault(t[x:y].tobytes(), [own, at, keys[who][0], []])
            if (run[0], run[1]) != (own, at):
                run[0] = 0
            if own:
                run[3].append((x - int(first[who]), *keys[who]))
        # a run that has its like is repeated all over; where all runs of a gram have, there is nothing left to sort
        open_grams = {gram for own, _, gram, _ in runs.values() if own}
        for raw, (own, at, gram, places) in runs.items():
            if gram in open_grams:
                self.members += [(len(self.raws), *p) for p in places]
                self.raws.append(raw)
                self.text.append(own)
                self.place.append(at)
                self.size += len(raw)
            else:
                for shift, *key in places:
                    froms, tos = self.found.setdefault(tuple(key), ([], []))
                    froms.append(shift)
                    tos.append(shift + len(raw) - LENGTH + 1)

    def sorted(self, folder: str | None) -> tuple[list[tuple[int, int]], list[list[int]], list[list[int]]]:
        """Keys of pieces, and of each the runs of repeated starts: first ones and ends (exclusive)."""
        size = np.array([len(x) for x in self.raws], np.int64)
        starts = repeated_starts(self.raws, np.array(self.text, np.uint64), np.array(self.place, np.int64), folder) if len(size) else size
        first = np.cumsum(size) - size
        low, high = np.searchsorted(starts, first).tolist(), np.searchsorted(starts, first + size).tolist()
        spans = [intervals(starts[x:y] - f) for x, y, f in zip(low, high, first.tolist(), strict=True)]
        found = self.found
        for k, shift, *key in self.members:
            if spans[k][0]:
                froms, tos = found.setdefault(tuple(key), ([], []))
                froms += [x + shift for x in spans[k][0]]
                tos += [x + shift for x in spans[k][1]]
        return list(found), [x for x, _ in found.values()], [x for _, x in found.values()]


def intervals(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive starts: first ones and ends (exclusive)."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + 1).tolist()


COVER = "gram long, piece long, froms array<int>, tos array<int>"


def sorted_cover(pieces: DataFrame) -> DataFrame:
    """COVER of pieces (gram, piece, c, t1, at, before, raw): all pieces of a gram meet in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size, last, shard = Powers(), [], 0, None, Shard()

        def take() -> None:
            rows = pa.Table.from_batches(held)
            column = lambda c: rows.column(c).to_numpy()
            text = np.where(column("c") == 1, column("t1").view(np.uint64) | np.uint64(1), np.uint64(0))
            keys = list(zip(column("gram").tolist(), column("piece").tolist(), strict=True))
            shard.add(rows.column("raw").to_pylist(), text, column("at") - column("before"), keys, powers)

        def told() -> pa.RecordBatch:
            with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
                keys, froms, tos = shard.sorted(folder)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (froms, tos)]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + lists, names=["gram", "piece", "froms", "tos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column("gram").to_numpy()
            lengths = np.cumsum(pa.compute.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False))
            ends, begin = np.append(np.flatnonzero(np.diff(grams)) + 1, len(grams)), 0
            for end in ends.tolist():  # a gram's pieces stay together
                if size >= PART and grams[begin] != last:
                    take()
                    held, size = [], 0
                    if shard.size >= SHARD or len(shard.found) >= FOUND:
                        yield told()
                        shard = Shard()
                held.append(batch.slice(begin, end - begin))
                size += int(lengths[end - 1] - (lengths[begin - 1] if begin else 0))
                last, begin = grams[end - 1], end
        if held:
            take()
            yield told()
        del held, shard
        release_memory()

    dealt = pieces.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, COVER)


def string_hashes(pieces: DataFrame, nodes: bool) -> DataFrame:
    """gram, piece, c, place, hash of pieces (gram, piece, c, before, raw).

    nodes: of the cores that all strings of STEP neighbouring starts share; else of every string of the node given.
    place is where a core or string begins, counted from the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                raws = part.column("raw").to_pylist()
                t, size = np.frombuffer(b"".join(raws), np.uint8), np.array([len(x) for x in raws])
                first, before = np.cumsum(size) - size, part.column("before").to_numpy().astype(np.int64)
                count = np.maximum(size - LENGTH + 1, 0)
                hashes = Hashes(t, powers)
                if nodes:
                    # nodes lie on a grid from the anchor
                    low = -(before // STEP) - 1
                    place, owner = spread(low, (count - 1 - before) // STEP - low + 1)
                    a = np.maximum(place * STEP, -before[owner])
                    z = np.minimum(place * STEP + STEP - 1, (count - 1 - before)[owner])
                    fits = z >= a
                    place, owner = place[fits], owner[fits]
                    # the core lies in every string of the node, so in the piece, even where that cuts the node
                    start = place * STEP + STEP - 1 + (first + before)[owner]
                    key = hashes.of(start, start + LENGTH - STEP + 1).view(np.int64)
                else:
                    node = part.column("place").to_numpy()
                    a, z = np.maximum(node * STEP, -before), np.minimum(node * STEP + STEP - 1, count - 1 - before)
                    place, owner = spread(a, np.maximum(z - a + 1, 0))
                    start = place + (first + before)[owner]
                    key = hashes.of(start, start + LENGTH).view(np.int64)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("gram", "piece", "c")), pa.array(place.astype(np.int64)), pa.array(key)], names=["gram", "piece", "c", "place", "hash"])

    return pieces.mapInArrow(run, "gram long, piece long, c long, place long, hash long")


def counted_cover(pieces: DataFrame) -> DataFrame:
    """COVER of pieces of hot grams by counting, in shuffles that combine before they send.

    First the cores of nodes (STEP neighbouring starts) are counted; a node whose core has no partner has no repeated
    string. Then every string of the nodes left is counted.
    """
    cores = string_hashes(pieces, nodes=True)
    again = cores.groupBy("gram", "place", "hash").agg(F.sum(F.least("c", F.lit(2))).alias("often")).where("often > 1").drop("often")
    nodes = cores.where("c = 1").join(again, ["gram", "place", "hash"]).select("gram", "piece", "place")
    # strings of pieces that occur elsewhere as a whole are partners for any node
    strings = string_hashes(pieces.where("c = 1").join(nodes, ["gram", "piece"]).select("gram", "piece", "c", "before", "raw", "place"), nodes=False)
    others = pieces.where("c > 1").withColumn("place", F.explode(F.sequence(F.lit(-(SPAN // STEP) - 1), F.lit(SPAN // STEP + 1)).cast("array<long>")))
    strings = materialise(strings.unionByName(string_hashes(others.select("gram", "piece", "c", "before", "raw", "place"), nodes=False)), "hot-strings")
    often = strings.groupBy("gram", "place", "hash").agg(F.sum(F.least("c", F.lit(2))).alias("often")).where("often > 1").drop("often")
    hit = strings.where("c = 1").join(often, ["gram", "place", "hash"])
    before = pieces.select("gram", "piece", "before")
    starts = hit.groupBy("gram", "piece").agg(F.array_sort(F.collect_list(F.col("place").cast("int"))).alias("starts"))  # SPAN of them at most
    starts = starts.join(before, ["gram", "piece"]).withColumn("froms", F.transform("starts", lambda x: x + F.col("before")))
    return starts.select("gram", "piece", "froms", F.transform("froms", lambda x: x + 1).alias("tos"))


def removal(docs: DataFrame) -> DataFrame:
    """t1, t2, froms, tos: for each text that loses something, runs of starts of repeated strings; none of them empty."""
    texts = keyed(docs)
    occ = materialise(occurrences(texts), "occurrences")
    pieces = occ.groupBy("gram", "piece").agg(F.sum("n").alias("c"), F.min(F.struct("t1", "t2", "at")).alias("rep"), F.first("before").alias("before"), F.first("size").alias("size"))
    pieces = materialise(pieces, "pieces")
    grams = pieces.groupBy("gram").agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("single"), F.sum(F.col("size").cast("long")).alias("bytes")).where("total > 1")
    live = pieces.join(grams, "gram")

    # bytes of the pieces that must be looked at, from one row of each text
    asked = live.where("single > 0").select("gram", "piece", "c", "rep.*", "before", "size", (F.col("bytes") > HOT).alias("hot"))
    wanted = asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "piece", "c", "at", "before", "size", "hot")).alias("wanted"))  # bounded by the text
    one = docs.select("doc_id", *keys()).groupBy("t1", "t2").agg(F.min("doc_id").alias("least"))
    wanted = wanted.join(one, ["t1", "t2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "piece", "c", "at", "before", "size", "hot")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                rows, raws, t1 = [], [], []
                for text, key, wants in zip(part.column("text").to_pylist(), part.column("t1").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    data = text.encode()
                    for w in wants:
                        start = w["at"] - w["before"]
                        rows.append(w)
                        raws.append(data[start : start + w["size"]])
                        t1.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)), pa.array(raws, pa.binary())], names=["t1", *names, "raw"])
        release_memory()

    matched = texts.join(wanted, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "t1", "wanted")
    found = matched.mapInArrow(cut, "t1 long, gram long, piece long, c long, at long, before int, size int, hot boolean, raw binary")
    found = materialise(found, "piece-bytes")
    cover = sorted_cover(found.where("not hot")).unionByName(counted_cover(found.where("hot").select("gram", "piece", "c", "before", "raw")))
    whole = live.where(f"c > 1 and size >= {LENGTH}").select("gram", "piece", F.array(F.lit(0)).alias("froms"), F.array(F.col("size") - LENGTH + 1).alias("tos"))
    cover = whole.unionByName(cover)

    spots = occ.select("t1", "t2", "at", "before", "gram", "piece").join(cover, ["gram", "piece"])
    shift = F.col("at") - F.col("before")
    spots = spots.select("t1", "t2", F.transform("froms", lambda x: x + shift).alias("f"), F.transform("tos", lambda x: x + shift).alias("t"))
    return spots.groupBy("t1", "t2").agg(F.flatten(F.collect_list("f")).alias("froms"), F.flatten(F.collect_list("t")).alias("tos"))  # bounded by the text


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of every row of docs (doc_id, text).

    text is what is left; where a removed run ends within a character, its other bytes turn into U+FFFD. A null text
    stays null. With keep_bytes also kept: the bytes that are left.
    """
    lost = materialise(removal(docs), "removal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for text, froms, tos in zip(*(part.column(c).to_pylist() for c in ("text", "froms", "tos")), strict=True):
                    raw = (text or "").encode()
                    kept, spans = raw, 0
                    if froms:
                        step = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(step, np.array(froms), 1)
                        np.add.at(step, np.array(tos) - 1 + LENGTH, -1)
                        gone = np.cumsum(step)[:-1] > 0
                        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        text = kept.decode("utf-8", "replace")
                    rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), text, kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())[: 5 + keep_bytes]
                cells = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cells], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "kept"][: 6 + keep_bytes])
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", *keys()).join(lost, ["t1", "t2"], "left").select("doc_id", "text", "froms", "tos")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" + ", kept binary" * keep_bytes)
