"""Benchmark decontamination: rare n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits in lower case. A match is a local alignment (match 1, mismatch and gap -1) of at
least least_score(words of the item); a copy with words changed, left out or added still scores. Seeding loses none of
them: an alignment of score S has at most one run of matches more than errors, hence S - 1 word pairs or more in common
with the item, all within 2 L - S words of the text. So passages are kept where shared word pairs are that dense; the
number of passages that hold each pair is known over all documents; and of an item's L - 1 pairs the L - S + 1 rarest
are seeds: whoever holds S - 1 of the pairs holds a seed. A passage that holds a seed, and enough of the item's pairs
closely enough, is aligned with the item. The benchmark is worked through in blocks of at most BLOCK_WORDS words, each
of which is sent to all executors; every block meets all documents.

Defined results: null and empty texts, and items without words, match nothing; items of fewer than LEAST words
match as a whole only; of equal scores the first passage counts; items with equal texts all match; repeated rows give repeated
rows (drop_contaminated decides on each row alone); other columns are ignored or kept; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of an n-gram: longer ones miss copies with a word changed every few words that still reach the score.
N = 2
#: A match needs this share of the item's words as alignment score, or LONG words of it; and LEAST words or the item.
SHARE, LONG, LEAST = 0.5, 20, 8
BLOCK_WORDS = 1_000_000
WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def least_score(words: int) -> int:
    """The lowest alignment score that is a match for an item of so many words."""
    return max(min(LEAST, words), min(math.ceil(SHARE * words), LONG))


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A key for every n-gram of word numbers; n-grams with an unknown word (-1) get key 0."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    key, known = np.full(len(ids) - n + 1, n, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        key = (key ^ (part + 1).astype(np.uint64)) * MIX
        key ^= key >> np.uint64(29)
        known &= part >= 0
    return np.where(known, key | np.uint64(1), np.uint64(0))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the item and passage positions of its last words. Unknown words never match."""
    steps = np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        new = np.maximum(np.concatenate([[0], row[:-1] + np.where(passage == word, 1, -1)]), row - 1)
        new = np.maximum(new, 0)
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item
        if row.max() > best[0]:
            best = (int(row.max()), i, int(row.argmax()) - 1)
    return best


class Matcher:
    """Word numbers and n-grams of a block of items; seeds once their rarity is known."""

    def __init__(self, items: list[list[str]]):
        self.ids: dict[str, int] = {}
        self.items = [np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64) for words in items]
        #: For each n, the longest item of each lowest score.
        self.longest: dict[int, dict[int, int]] = {}
        for n in map(len, self.items):
            if n:
                own = self.longest.setdefault(min(N, n), {})
                own[least_score(n)] = max(n, own.get(least_score(n), 0))
        self.grams = np.unique(np.concatenate([self.keys(x) for x in self.items] or [np.zeros(0, np.uint64)]))
        self.seeds: dict[int, list[int]] = {}

    def keys(self, item: np.ndarray) -> np.ndarray:
        return gram_keys(item, min(N, len(item))) if len(item) else np.zeros(0, np.uint64)

    def choose_seeds(self, seen: dict[int, int]) -> None:
        """Of an item's n-grams the ones that the fewest passages hold, so many that no match has none; ties by position."""
        for k, item in enumerate(self.items):
            keys = self.keys(item).tolist()
            rare = sorted(range(len(keys)), key=lambda i: seen.get(keys[i], 0))
            for x in {keys[i] for i in rare[: len(item) - least_score(len(item)) + 1]}:
                self.seeds.setdefault(x, []).append(k)

    def passages(self, text: str | None) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First word, word numbers, and positions and keys of the shared n-grams of each passage that may hold a match."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        at, keys, spans = [], [], []
        for n, longest in self.longest.items():
            own = gram_keys(ids, n)
            known = np.flatnonzero(own)
            place = np.minimum(np.searchsorted(self.grams, own[known]), len(self.grams) - 1)
            known = known[self.grams[place] == own[known]]
            at.append(known)
            keys.append(own[known])
            for least, words in longest.items():
                spans += dense_spans(known, least, words)
        out = []
        if spans:
            at, keys = np.concatenate(at), np.concatenate(keys)
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            for first, end in joined(spans):
                part = slice(*np.searchsorted(at, (first, end)))
                out.append((first, ids[first:end], at[part] - first, keys[part]))
        return out

    def matches(self, first: int, ids: np.ndarray, at: np.ndarray, keys: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """Item, score by item length, alignment score, first and last word of the matches in a passage."""
        out, held = [], keys.tolist()
        for k in sorted({k for x in set(held) for k in self.seeds.get(x, ())}):
            item = self.items[k]
            own, least = set(self.keys(item).tolist()), least_score(len(item))
            for start, end in joined(dense_spans(at[[x in own for x in held]], least, len(item))):
                score, i, j = align(item, ids[start:end])
                if score >= least:
                    _, _, back = align(item[: i + 1][::-1], ids[start : start + j + 1][::-1])
                    out.append((k, score / len(item), score, first + start + j - back, first + start + j))
        return out


def dense_spans(at: np.ndarray, least: int, words: int) -> list[tuple[int, int]]:
    """First word and end of what may hold an alignment of a score of least with an item of so many words.

    at: positions of shared n-grams. Two spans that overlap are one already.
    """
    need = max(1, least - 1)
    if len(at) < need:
        return []
    starts, ends = at[: len(at) - need + 1], at[need - 1 :]
    dense = ends - starts <= max(0, 2 * words - least - N)
    starts, ends = np.maximum(starts[dense] - 2 * words, 0), ends[dense] + 2 * words + N
    apart = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return list(zip(starts[np.r_[0, apart]].tolist(), ends[np.r_[apart - 1, len(ends) - 1]].tolist(), strict=True)) if len(starts) else []


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and words of the items in blocks; the driver holds one block at a time."""
    ids, items, n = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if n and n + len(words) > block_words:
            yield ids, items
            ids, items, n = [], [], 0
        ids.append(row["item_id"])
        items.append(words)
        n += len(words)
    if items:
        yield ids, items


def passages(docs: DataFrame, matcher: Matcher) -> DataFrame:
    """doc_id, first, ids, at, keys: the passages of all docs (doc_id, text) that may hold a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("doc_id")
            found = [(k, *p) for k, text in enumerate(batch.column("text").to_pylist()) for p in matcher.passages(text)]
            lists = [pa.array([x[2].tolist() for x in found], pa.list_(pa.int32())), pa.array([x[3].tolist() for x in found], pa.list_(pa.int32())), pa.array([x[4].view(np.int64).tolist() for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([own.take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.int64()), *lists], names=["doc_id", "first", "ids", "at", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first long, ids array<int>, at array<int>, keys array<long>")


def seeded(docs: DataFrame, items: list[list[str]]) -> tuple[Matcher, DataFrame]:
    """A matcher with seeds by the n-grams' counts over all docs, and the passages."""
    matcher = Matcher(items)
    found = materialise(passages(docs, matcher), "passages")
    # at most one row for each n-gram of the block
    counts = found.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").count().collect()
    matcher.choose_seeds({r["key"] & 0xFFFFFFFFFFFFFFFF: r["count"] for r in counts})
    return matcher, found


MATCH = "item_id {kind}, score double, aligned long, first_word long, last_word long"


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, aligned, first_word, last_word: the best match of each document and item that reach it.

    score is the alignment score by the item's words (1 for a whole copy), aligned the score itself; words count from 0.
    """
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + MATCH.format(kind=item_kind)
    out = docs.sparkSession.createDataFrame([], columns)
    for ids, items in blocks_of(benchmark, block_words):
        matcher, found = seeded(docs, items)
        arrow = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher, ids=ids, arrow=arrow) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("first", "ids", "at", "keys")), strict=True)
                hits = [(k, *m) for k, (first, words, at, keys) in enumerate(rows) for m in matcher.matches(first, np.array(words, np.int64), np.array(at, np.int64), np.array(keys, np.int64).view(np.uint64))]
                cells = [pa.array([ids[h[1]] for h in hits], arrow), pa.array([h[2] for h in hits], pa.float64()), *(pa.array([h[k] for h in hits], pa.int64()) for k in (3, 4, 5))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())), *cells], names=["doc_id", "item_id", "score", "aligned", "first_word", "last_word"])

        out = out.unionByName(found.mapInArrow(run, columns))
    best = F.min(F.struct((-F.col("score")).alias("score"), "first_word", "last_word", "aligned")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.score")).alias("score"), "best.aligned", "best.first_word", "best.last_word")


def _flag(matcher: Matcher):
    @F.pandas_udf("boolean")
    def matched(texts: pd.Series) -> pd.Series:
        return pd.Series([any(matcher.matches(*p) for p in matcher.passages(x if isinstance(x, str) else None)) for x in texts], dtype=bool)

    return matched


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all columns, that match no item."""
    for _, items in blocks_of(benchmark, block_words):
        docs = docs.where(~_flag(seeded(docs, items)[0])("text"))
    return docs
