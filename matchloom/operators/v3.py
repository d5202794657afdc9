"""The features of precision.v3_features() for the best candidates, without a shuffle or join of pairs or of their words.

All that a pair's features need from other rows are counts: how many entities and records hold a word, a name or an address
part. Keys go packed to where all rows of a key meet, the counts go packed back to the rows, and rows travel with what was
counted to the blocks of candidates.py. A pair's features are then made where the pair is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.kernels import code_points, jaro_winklers, over_pairs, ratios, token_set_ratios  # not the module, whose Arrow functions cannot be sent once they were used
from ..sources import tables
from .candidates import KEY_SOURCE, PACKED, _pack, _sent, _unpack, _unpack_rows, best_candidates
from .precision import LOCALITY_LEAST, _unmatched_parts, address_parts, clean_words

#: Likeness from which a word is a spelling of another one, words of the other side that are looked at for that; pairs of localities that a task remembers.
LIKE, LOOKED_AT, KNOWN = 0.92, 10, 100_000
KINDS = """country string, s1 string, r string, cn_eq double, cn_tset double, cn_ratio double, cn_jac double, cn_cov1 double, cn_cov2 double, cn_miss_idf1 double, cn_miss_idf2 double,
cn_max_idf_match double, loc_n1 int, loc_n2 int, loc_inter long, loc_unm1 long, loc_unm2 long, loc_conflict int, n_s1_same1 double, n_s1_same2 double, n_c_same2 double"""


def _asked(parts: int):
    """Keys of rows packed by part, with the row's number and the key's place in it."""

    def flush(held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = pa.concat_arrays([x[0] for x in held])
        part, number, place = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        by = np.argsort(part, kind="stable")
        kept, pieces = [], []
        for own in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
            order = pc.sort_indices(keys.take(pa.array(own))).to_numpy()
            own = own[order]
            kept.append(part[own[0]])
            pieces.append(_pack(key=keys.take(pa.array(own)), number=number[own], place=place[own]))
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(pieces, pa.binary())], names=["part", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sizes = np.diff(batch.column("keys").offsets.to_numpy())
            if not sizes.sum():
                continue
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append((batch.column("keys").flatten(), np.mod(batch.column("hashes").flatten().to_numpy(), parts), np.repeat(batch.column("number").to_numpy(), sizes), place.astype(np.int32)))
            n += len(place)
            if n >= PACKED:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _told(parts: int):
    """How many rows of either side hold each key of a part, packed for the rows that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x, key=None, number=np.int64, place=np.int32) for batch in batches for x in batch.column("piece").to_pylist()]
        if not held:
            return
        coded = pa.chunked_array([c for x in held for c in x[0].chunks]).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code, number, place = coded.indices.to_numpy(), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
        n1, n2 = (np.bincount(code[side], minlength=len(coded.dictionary)).astype(np.int32)[code] for side in (number >= 0, number < 0))
        home = np.mod(number, parts)
        by = np.lexsort((number, home))
        for own in np.split(by, np.flatnonzero(np.diff(home[by])) + 1):
            piece = _pack(number=number[own], place=place[own], n1=n1[own], n2=n2[own])
            yield pa.RecordBatch.from_arrays([pa.array([home[own[0]]], pa.int32()), pa.array([1], pa.int32()), pa.array([piece], pa.binary())], names=["block", "kind", "shown"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the counts of their keys."""
    rows, told = [], []
    for batch in batches:
        for kind, piece in zip(batch.column("kind").to_pylist(), batch.column("shown").to_pylist(), strict=True):
            if kind:
                told.append(_unpack(piece, number=np.int64, place=np.int32, n1=np.int32, n2=np.int32))
            else:
                rows.append(_unpack_rows(piece))
    if not rows:
        return
    t = pa.concat_tables(rows).combine_chunks()
    t = t.take(pc.sort_indices(t.column("number"))).combine_chunks()
    number, place, n1, n2 = (np.concatenate([x[i] for x in told]) if told else np.zeros(0, np.int64 if not i else np.int32) for i in range(4))
    by = np.lexsort((place, number))
    bounds = pa.array(np.append(np.searchsorted(number[by], t.column("number").to_numpy()), len(number)).astype(np.int32))
    for name, n in (("n1", n1), ("n2", n2)):
        t = t.append_column(name, pa.ListArray.from_arrays(bounds, pa.array(n[by], pa.int32())))
    yield from t.combine_chunks().to_batches(max_chunksize=10_000)


def holders(rows: DataFrame, keys: str = "keys") -> DataFrame:
    """rows without keys, but with n1 and n2: how many rows of either side hold each of them.

    rows have a number of their own, below 0 on the second side, that is the same at each reading; a row's keys differ.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    piece = "block int, kind int, shown binary"
    asked = rows.select("number", keys, F.transform(keys, lambda t: F.xxhash64(t)).alias("hashes")).mapInArrow(_asked(parts), "part int, piece binary")
    told = asked.repartitionById(parts, F.col("part")).mapInArrow(_told(parts), piece)
    rest = rows.drop(keys)
    sent = rest.select(F.array(F.pmod("number", F.lit(parts)).cast("int")).alias("to"), "*").mapInArrow(_sent(0), piece)
    counts = [StructField(c, ArrayType(IntegerType())) for c in ("n1", "n2")]
    return sent.unionByName(told).repartitionById(parts, F.col("block")).mapInArrow(_met, StructType([*rest.schema.fields, *counts]))


def described(records1: DataFrame, records2: DataFrame) -> DataFrame:
    """Normalised rows of both sides (number below 0 on the second) with words (text) and how many entities hold each, localities (text), and how many entities and records have the same words."""
    number = F.monotonically_increasing_id()
    sides = [x.where("country is not null").select("country", "id", n.alias("number"), *KEY_SOURCE, clean_words().alias("ctoks"), address_parts().alias("comps")) for x, n in ((records1, number), (records2, -1 - number))]
    rows = tables.materialise(sides[0].unionByName(sides[1]), "cleaned")
    head = F.concat(F.length("country").cast("string"), F.lit(":"), "country")
    ckey = F.array_join(F.array_sort("ctoks"), " ")

    def tagged(kind: str, x: Column) -> Column:
        return F.transform(x, lambda t: F.concat(head, F.lit(kind), t))

    words, comps = F.array_distinct("ctoks"), F.array_distinct("comps")
    keys = F.concat(tagged("n", F.array(ckey)), tagged("t", words), tagged("l", comps))  # the name's key is the first
    found = holders(rows.withColumn("keys", keys)).withColumns({"_w": words, "_c": comps})
    df = F.transform("ctoks", lambda t: F.element_at("n1", (1 + F.array_position("_w", t)).cast("int")))
    local = F.filter("_c", lambda c: F.element_at("n1", (1 + F.size("_w") + F.array_position("_c", c)).cast("int")) >= LOCALITY_LEAST)
    same = lambda n: F.when(F.size("ctoks") > 0, F.element_at(n, 1)).otherwise(0)
    return tables.materialise(found.select("country", "id", "number", *KEY_SOURCE, F.array_join("ctoks", " ").alias("words"), df.alias("df"), F.array_join(F.array_sort(local), "|").alias("locs"), same("n1").alias("same1"), same("n2").alias("same2")), "described")


def _bound(la: np.ndarray, lb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least the Jaro-Winkler similarity of words with such lengths and sets of letters."""
    common = np.minimum(la - np.bitwise_count(a & ~b), lb - np.bitwise_count(b & ~a))
    jaro = (common / la + common / lb + 1) / 3
    return np.where(jaro > 0.7, jaro + 0.4 * (1 - jaro), jaro)


class _Words:
    """The words of one side of some pairs: code of each, its pair, its place in the pair's words."""

    def __init__(self, batch: pa.RecordBatch, side: str):
        flat = pc.split_pattern(batch.column(f"words_{side}"), " ").flatten()
        self.texts = flat.filter(pc.not_equal(flat, ""))
        df = batch.column(f"df_{side}")
        self.df, self.size = df.flatten().to_numpy(), pc.list_value_length(df).to_numpy()
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.of)) - self.start[self.of]

    def weigh(self, n: np.ndarray, most: np.ndarray) -> None:
        self.w = np.where(self.df > 0, np.log((n[self.of] + 1) / (self.df + 1)), most[self.of])

    def covered(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of weight that is hit, the largest weight that isn't, the largest that is."""
        k = len(self.size)
        miss, top = np.zeros(k), np.zeros(k)
        np.maximum.at(miss, self.of[~hit], self.w[~hit])
        np.maximum.at(top, self.of[hit], self.w[hit])
        return np.bincount(self.of, self.w * hit, k) / np.maximum(1e-6, np.bincount(self.of, self.w, k)), miss, top


def _made(batch: pa.RecordBatch, totals: dict[str, tuple[int, float]], known: dict) -> pa.Table:
    """The features of pairs; known has those of localities that were seen before."""
    a, b = _Words(batch, "a"), _Words(batch, "b")
    places = batch.column("country").dictionary_encode()
    n, most = (np.array([totals[c][i] for c in places.dictionary.to_pylist()], float)[places.indices.to_numpy()] for i in (0, 1))
    coded = pa.concat_arrays([a.texts, b.texts]).dictionary_encode()
    texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    a.code, b.code = code[: len(a.texts)], code[len(a.texts) :]
    for x in (a, b):
        x.weigh(n, most)
    # every word of one side with every word of the other
    times = b.size[a.of]
    i = np.repeat(np.arange(len(a.of)), times)
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + b.start[a.of[i]]
    ca, cb = a.code[i], b.code[j]
    same = ca == cb
    hit_a, hit_b = np.zeros(len(a.of), bool), np.zeros(len(b.of), bool)
    hit_a[i[same]] = hit_b[j[same]] = True
    shared = hit_a.copy()
    if texts:
        points, size = code_points(texts, 0)
        letters = np.where(np.arange(points.shape[1]) < size[:, None], np.uint64(1) << (points % 64).astype(np.uint64), np.uint64(0))
        letters = np.bitwise_or.reduce(letters, axis=1)
        asked = np.flatnonzero(~same & ((a.place[i] < LOOKED_AT) | (b.place[j] < LOOKED_AT)))
        asked = asked[_bound(size[ca[asked]], size[cb[asked]], letters[ca[asked]], letters[cb[asked]]) >= LIKE - 1e-6]
        pairs, at = np.unique(ca[asked] * len(texts) + cb[asked], return_inverse=True)
        x, y = ([texts[k] for k in q.tolist()] for q in np.divmod(pairs, len(texts)))
        for hit, own, other, p, q in ((hit_a, i, b.place[j], x, y), (hit_b, j, a.place[i], y, x)):
            like = (jaro_winklers(p, q) >= LIKE)[at]  # not the same in both directions
            hit[own[asked[like & (other[asked] < LOOKED_AT)]]] = True
    both = (a.size > 0) & (b.size > 0)
    distinct = []
    for x in (a, b):
        first = np.unique(x.of * max(1, len(texts)) + x.code, return_index=True)[1]
        distinct.append((np.bincount(x.of[first], minlength=len(both)), first))
    inter = np.bincount(a.of[distinct[0][1]], shared[distinct[0][1]], len(both))
    union = distinct[0][0] + distinct[1][0] - inter

    sorted_words: dict[str, str] = {}
    names = []
    for side in "ab":
        column = batch.column(f"words_{side}").to_pylist()
        sorted_words |= {x: " ".join(sorted(x.split(" "))) for x in set(column) - sorted_words.keys()}
        names.append([sorted_words[x] if ok else None for x, ok in zip(column, both.tolist(), strict=True)])
    eq = np.array([x == y for x, y in zip(*names, strict=True)], float)

    where = list(zip(batch.column("locs_a").to_pylist(), batch.column("locs_b").to_pylist(), strict=True))
    new = [p for p in dict.fromkeys(where) if p not in known]
    if new:
        p, q = ([tuple(x[k].split("|")) if x[k] else () for x in new] for k in (0, 1))
        known |= {x: (len(s), len(t), f, g) for x, s, t, f, g in zip(new, p, q, _unmatched_parts(p, q), _unmatched_parts(q, p), strict=True)}
    n1, n2, free1, free2 = np.array([known[x] for x in where], np.int64).reshape(-1, 4).T
    if len(known) > KNOWN:
        known.clear()
    there = (n1 > 0) & (n2 > 0)

    masked = lambda x, ok: pa.array(x, mask=~ok)
    cov1, miss1, top1 = a.covered(hit_a)
    cov2, miss2, _ = b.covered(hit_b)
    number = lambda c: np.log1p(batch.column(c).to_numpy().astype(float))
    return pa.table({c: batch.column(c) for c in ("country", "s1", "r")} | {
        "cn_eq": masked(eq, both), "cn_tset": pa.array(over_pairs(token_set_ratios, *names), pa.float64()), "cn_ratio": pa.array(over_pairs(ratios, *names), pa.float64()),
        "cn_jac": masked(inter / np.maximum(1, union), both), "cn_cov1": masked(cov1, both), "cn_cov2": masked(cov2, both), "cn_miss_idf1": masked(miss1, both), "cn_miss_idf2": masked(miss2, both),
        "cn_max_idf_match": masked(top1, both), "loc_n1": n1.astype(np.int32), "loc_n2": n2.astype(np.int32), "loc_inter": masked(n1 - free1, there), "loc_unm1": masked(free1, there),
        "loc_unm2": masked(free2, there), "loc_conflict": masked(((free1 > 0) & (free2 > 0)).astype(np.int32), there), "n_s1_same1": number("same1_a"), "n_s1_same2": number("same1_b"), "n_c_same2": number("same2_b"),
    })


def _features(totals: dict[str, tuple[int, float]]):
    """The features of pairs; totals has entities and the largest idf of each country."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            if batch.num_rows:
                yield from _made(batch, totals, known).combine_chunks().to_batches()

    return run


def v3_features(records1: DataFrame, records2: DataFrame) -> DataFrame:
    """precision.v3_features() of the best candidates of normalised records."""
    spark, since = records1.sparkSession, tables.written()
    rows = described(records1, records2)
    tables.forget(since, keep=rows)
    tables.release(spark)  # the shuffles of keys and counts
    one, two = rows.where("number >= 0").drop("number"), rows.where("number < 0").drop("number")
    # a row a country
    counts = one.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("df")).alias("least")).collect()
    totals = {r["country"]: (r["n"], float(np.log((r["n"] + 1) / (r["least"] + 1))) if r["least"] else 0.0) for r in counts}
    own = ("words", "df", "locs", "same1")
    return best_candidates(one, two, own=own, other=(*own, "same2")).mapInArrow(_features(totals), KINDS)
