"""Toxicity from the nearest labelled examples: exact TF-IDF cosine by a block-max inverted index.

Terms are words and their first 4 to 6 letters, so that inflected and compound forms share terms. Every word counts.
Terms that are more frequent in toxic examples than in others by more than chance (log-likelihood ratio, from LEAST on)
in a sample of at most EXAMPLES labelled rows have a coordinate of their own; all other words share one, so that a
text's length and the weight of its telling terms against the rest enter its cosines. Weights are the square root of
the count times the inverse document frequency, counted over all documents. The examples stand in an inverted index
whose postings are cut into blocks of BLOCK examples, each with its largest weight. A query adds up the block maxima
of its terms, visits the blocks of the highest bounds and then those that can still reach its NEAREST best examples,
or, where these are many, whole posting lists; so the neighbours are exact. Their labels vote with the square of the
cosine, a weak prior joins in, and Platt scaling fitted on left-one-out votes of the examples makes the vote a
probability. The neighbours are the evidence. Texts without a term of their own coordinate are all alike: they get the
share of toxic ones among such examples.

Defined results: a null or empty text is a text without terms; equal texts get equal scores; neighbours of equal
cosine are taken by position in the index (order of the ids' MD5); a null doc_id is not held out; the highest of
repeated labels counts; without any toxic example all scores are the share of toxic labels (0 if there is none); other
columns are ignored (score_documents) or kept (reject_toxic); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import fresh, materialise

#: Bound of the labelled sample, and what a term must reach to have its own coordinate (log-likelihood ratio: a chance
#: of about one in 100,000).
EXAMPLES, LEAST = 20_000, 20.0
NEAREST, BLOCK, PRIOR = 15, 64, 0.25
#: Blocks that are scored before the threshold is set.
VISITED = 4
#: Share of the blocks from which on whole posting lists are summed up.
WHOLE = 0.125
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]{2,}")
#: Rows whose texts a worker holds as Python strings at a time.
ROWS = 512
#: Words whose terms a worker remembers before it begins anew.
REMEMBERED = 100_000


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its first 4 to 6 letters, marked by a star."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k))


def word_counts(text: str | None) -> Counter:
    return Counter(WORDS.findall(text.lower())) if text else Counter()


def term_statistics(examples: DataFrame) -> DataFrame:
    """term, toxic, clean: in how many examples (text, toxic) of either kind each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])
            seen.clear()
            return out

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    for term in {t for w in word_counts(text) for t in terms_of(w)}:
                        seen.setdefault(term, [0, 0])[int(toxic)] += 1
                    if len(seen) > REMEMBERED:
                        yield told()
        yield told()

    return examples.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def pick_terms(statistics: DataFrame, toxic: int, clean: int, least: float = LEAST) -> list[str]:
    """The terms that mark toxic examples, best ones first; ties by the term. Each stands in several examples."""
    if not toxic or not clean:
        return []
    n = float(toxic + clean)
    df = F.col("toxic") + F.col("clean")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), df * (toxic / n)) + part(F.col("clean"), df * (clean / n)) + part(toxic - F.col("toxic"), (n - df) * (toxic / n)) + part(clean - F.col("clean"), (n - df) * (clean / n)))
    over = F.col("toxic") * float(clean) > F.col("clean") * float(toxic)
    best = statistics.where(over).withColumn("ratio", ratio).where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term")
    return [r["term"] for r in best.select("term").collect()]


class Vectoriser:
    """Term counts of a text over a vocabulary; words without a term in it count as one further term."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {t: k for k, t in enumerate(vocabulary)}
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        for word, n in word_counts(text).items():
            ids = self.known.get(word)
            if ids is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                ids = self.known[word] = tuple(self.ids[t] for t in terms_of(word) if t in self.ids) or (len(self.ids),)
            for k in ids:
                found[k] = found.get(k, 0) + n
        return dict(sorted(found.items()))


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks of BLOCK examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]) if self.n else np.zeros(0, int)
        term = np.concatenate([t for t, _ in vectors]) if self.n else np.zeros(0, int)
        weight = np.concatenate([w for _, w in vectors]) if self.n else np.zeros(0)
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order], weight[order], term[order]
        cell = term * self.blocks + self.owner // BLOCK
        self.start = np.searchsorted(cell, np.arange(terms * self.blocks + 1))
        self.first = np.searchsorted(term, np.arange(terms + 1))
        self.most = np.zeros((terms, self.blocks))
        np.maximum.at(self.most.reshape(-1), cell, self.weight)

    def scores(self, terms: np.ndarray, weights: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Cosines of all examples in some blocks; 0 elsewhere."""
        cell = (terms[:, None] * self.blocks + some[None, :]).ravel()
        first = self.start[cell]
        count = self.start[cell + 1] - first
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        return np.bincount(self.owner[at], self.weight[at] * np.repeat(np.repeat(weights, len(some)), count), self.n)

    def all_scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of all examples, by whole posting lists; the same sums as those of scores."""
        found = np.zeros(self.n)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            part = slice(self.first[t], self.first[t + 1])
            found[self.owner[part]] += self.weight[part] * w
        return found

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k best examples but leave, best first, equal ones by position.

        The blocks with the highest bounds set a threshold; of the others those that may reach it are scored together.
        """
        bound = weights @ self.most[terms]
        some = np.argpartition(-bound, VISITED)[:VISITED] if self.blocks > VISITED else np.arange(self.blocks)
        some = some[bound[some] > 0]
        found, worst = self.scores(terms, weights, some), 0.0
        if leave >= 0:
            found[leave] = 0
        seen = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        seen = found[seen[seen < self.n]]
        if len(seen) > k:
            worst = np.partition(seen, len(seen) - k)[len(seen) - k]
        # a block whose bound equals the threshold may hold an equal example of a lower position
        more = (bound > 0) & (bound >= worst - 1e-12)
        more[some] = False
        more = np.flatnonzero(more)
        if len(more) > WHOLE * self.blocks:
            found = self.all_scores(terms, weights)
        elif len(more):
            found = found + self.scores(terms, weights, more)
        if leave >= 0:
            found[leave] = 0
        hit = np.flatnonzero(found >= worst if worst > 0 else found > 0)
        if len(hit) > k:
            least = np.partition(found[hit], len(hit) - k)[len(hit) - k]
            above, equal = hit[found[hit] > least], hit[found[hit] == least]
            hit = np.concatenate([above, equal[: k - len(above)]])
        keep = hit[np.lexsort((hit, -found[hit]))]
        return keep, found[keep]


class ToxicityModel:
    """Vocabulary, weights, indexed examples and calibration; scores texts or term counts."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[int, dict[int, int], int]]):
        """examples: (doc_id, term counts, label)."""
        self.vocabulary, self.idf = vocabulary, idf
        labels = np.array([y for _, _, y in examples], float)
        self.prior = float(labels.mean()) if len(labels) else 0.0
        seen = [self.telling(c) for _, c, _ in examples]
        without = labels[~np.array(seen, bool)] if len(labels) else labels
        self.empty = float((without.sum() + self.prior) / (len(without) + 1)) if len(labels) else 0.0
        own = [x for x, s in zip(examples, seen, strict=True) if s]
        self.ids, self.labels = [x[0] for x in own], np.array([x[2] for x in own], float)
        vectors = [self.vector(x[1]) for x in own]
        self.index = BlockMaxIndex(vectors, len(vocabulary) + 1)
        self.platt = (1.0, 0.0)
        if 0 < self.labels.sum() < len(self.labels):
            votes = np.array([self.vote(*self.index.nearest(*v, NEAREST, leave=k)) for k, v in enumerate(vectors)])
            self.platt = fit_platt(logit(votes), self.labels)

    def telling(self, counts: dict[int, int]) -> bool:
        """Whether a text has a term with its own coordinate."""
        return any(k < len(self.vocabulary) for k in counts)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts, int, len(counts))
        weights = np.sqrt(np.fromiter(counts.values(), float, len(counts))) * self.idf[terms]
        return terms, weights / np.sqrt((weights**2).sum())

    def vote(self, positions: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float((w @ self.labels[positions] + PRIOR * self.prior) / (w.sum() + PRIOR))

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[int, float, int]]]:
        """Probability, and the neighbours (doc_id, cosine, label) that voted."""
        if not self.index.n or not self.telling(counts):
            return self.empty, []
        positions, cosines = self.index.nearest(*self.vector(counts), NEAREST)
        a, b = self.platt
        p = 1 / (1 + np.exp(-(a * logit(self.vote(positions, cosines)) + b)))
        return float(p), [(self.ids[k], float(c), int(self.labels[k])) for k, c in zip(positions.tolist(), cosines.tolist(), strict=True)]


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic regression with Platt's smoothed targets."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, a, b = np.where(y > 0, up, down), 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((t - p) * s).sum() - 0.1 * (a - 1), (t - p).sum() - 0.1 * b])
        hess = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def term_vectors(docs: DataFrame, vocabulary: list[str], keep: list[str], names: tuple[str, str]) -> DataFrame:
    """The columns keep of docs, and term numbers and counts of every row's text, as arrays with the given names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Vectoriser(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows = [made.counts(x) for x in part.column(part.num_columns - 1).to_pylist()]
                lists = [pa.array([list(f(r)) for r in rows], pa.list_(pa.int32())) for f in (dict.keys, dict.values)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*keep, *names])

    schema = StructType([docs.schema[c] for c in keep])
    for n in names:
        schema = schema.add(n, ArrayType(IntegerType()))
    # the text goes along once more, last, as it may be among the columns that are kept
    return docs.select(*keep, F.col("text").alias(fresh("text", keep))).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("terms", "counts")) -> tuple[ToxicityModel, DataFrame]:
    """A model from the rows of labels (doc_id, toxic) that are not held out, and columns and term vectors of all docs."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample has at most so many ids of one number each: small enough to send to every executor.
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    chosen = materialise(docs.select("doc_id", "text").join(F.broadcast(materialise(sample, "toxicity-sample")), "doc_id"), "toxicity-examples")
    toxic, rows = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    vocabulary = pick_terms(term_statistics(chosen), toxic, rows - toxic)
    vectors = materialise(term_vectors(docs, vocabulary, list(keep), names), "toxicity-vectors")
    n = vectors.count()
    seen = dict(vectors.select(F.explode(names[0]).alias("t")).groupBy("t").count().collect())
    idf = np.array([np.log((n + 1) / (seen.get(k, 0) + 1)) + 1 for k in range(len(vocabulary) + 1)])
    own = term_vectors(chosen, vocabulary, ["doc_id"], ("terms", "counts")).join(F.broadcast(chosen.select("doc_id", "toxic").distinct()), "doc_id")
    found = own.distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "terms", "counts").collect()
    return ToxicityModel(vocabulary, idf, [(r["doc_id"], dict(zip(r["terms"], r["counts"], strict=True)), r["toxic"]) for r in found]), vectors


EVIDENCE = "evidence array<struct<doc_id:long,similarity:double,label:int>>"


def score_documents(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and EVIDENCE of every row of docs (doc_id, text)."""
    model, vectors = fit(docs, labels, examples)
    item = pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(dict(zip(t, c, strict=True))) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            evidence = pa.array([[dict(zip(("doc_id", "similarity", "label"), e, strict=True)) for e in found] for _, found in rows], pa.list_(item))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p for p, _ in rows], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = vectors.mapInArrow(run, f"doc_id {kind}, score double, {EVIDENCE}")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """The rows of docs, with all columns, whose score stays below THRESHOLD; texts are cut into terms once."""
    names = (fresh("terms", docs.columns), fresh("counts", docs.columns))
    model, vectors = fit(docs, labels, examples, tuple(docs.columns), names)

    @F.pandas_udf("double")
    def score(terms: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([model.score(dict(zip(t.tolist(), c.tolist(), strict=True)))[0] for t, c in zip(terms, counts, strict=True)], dtype=float)

    return vectors.where(score(*names) < THRESHOLD).select(*docs.columns)
