"""String kernels that Spark lacks: by definition for one pair, and over batches for Arrow functions of two columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    masks: dict[str, int] = {}
    for k, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence by both lengths; two empty texts are equal."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's own ones; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (not x - y or not y - x):
        return 1.0
    shared, left, right = (" ".join(sorted(s)) for s in (both, x - y, y - x))
    ab, ba = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    best = ratio(ab, ba)
    return max(best, ratio(shared, ab), ratio(shared, ba)) if both else best


def _best_window(a: str, b: str) -> float:
    """Best ratio of a with windows of its length in b, cut windows at the ends too."""
    n, letters, best = len(a), set(a), 0.0
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        # a best window ends with a letter of a
        if window[-1] in letters and 2 * len(window) / (n + len(window)) > best:
            best = max(best, ratio(a, window))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one; of equally long ones both have their windows."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    return _best_window(a, b) if len(a) < len(b) else max(_best_window(a, b), _best_window(b, a))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 1.0
    left, right = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return max(partial_ratio(left, right), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """The largest of the ratios, weighed down the less direct they are; partial ones where lengths differ by half."""
    if not a or not b:
        return 0.0
    spread, best = max(len(a), len(b)) / min(len(a), len(b)), ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if spread < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to 4 characters where it exceeds 0.7; two empty texts are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no part edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                new[-1] = min(new[-1], before[j - 2] + 1)
        before, row = row, new
    return row[-1]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def monge_elkan(a: list[str], b: list[str]) -> float | None:
    """Mean over a's words of their best Jaro-Winkler similarity in b; null if either is empty."""
    return sum(max(jaro_winkler(x, y) for y in b) for x in a) / len(a) if len(a) and len(b) else None


# The same kernels over whole batches, on matrices of code points. Every function takes two lists of equal length.


def code_points(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, filled up with pad, and the texts' lengths."""
    size = np.array([len(x) for x in texts], np.int64)
    out = np.full((len(texts), max(1, int(size.max(initial=0)))), pad, np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def chunks(a: list[str], b: list[str], rows: int = 2048) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
    """Positions and texts of pairs of similar length, a few at a time."""
    order = np.argsort([len(x) + len(y) for x, y in zip(a, b, strict=True)], kind="stable")
    for first in range(0, len(order), rows):
        part = order[first : first + rows]
        yield part, [a[k] for k in part.tolist()], [b[k] for k in part.tolist()]


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length() of pairs; words of 64 bits hold the shorter text, longer ones are done alone."""
    out = np.zeros(len(a), np.int64)
    for part, x, y in chunks(a, b):
        long, short = zip(*((p, q) if len(p) >= len(q) else (q, p) for p, q in zip(x, y, strict=True)), strict=True)
        fits = np.array([len(q) <= 64 for q in short])
        for k in np.flatnonzero(~fits).tolist():
            out[part[k]] = lcs_length(long[k], short[k])
        rows = np.flatnonzero(fits)
        if not len(rows):
            continue
        p, _ = code_points([long[k] for k in rows.tolist()], 0x110000)
        q, size = code_points([short[k] for k in rows.tolist()], 0x110001)
        v = np.full(len(rows), ~np.uint64(0))
        bits = np.zeros((len(rows), 8), np.uint8)
        for i in range(p.shape[1]):
            packed = np.packbits(q == p[:, i : i + 1], axis=1, bitorder="little")
            bits[:, : packed.shape[1]] = packed
            u = v & bits.view("<u8")[:, 0]
            v = (v + u) | (v - u)
        mask = np.where(size == 64, ~np.uint64(0), (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
        out[part[rows]] = np.bitwise_count(~v & mask)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(total > 0, 2 * lcs_lengths(a, b) / np.maximum(total, 1), 1.0)


def _sorted_words(texts: list[str]) -> list[str]:
    known = {x: " ".join(sorted(x.split())) for x in set(texts)}
    return [known[x] for x in texts]


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return ratios(_sorted_words(a), _sorted_words(b))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    words = {x: frozenset(x.split()) for x in {*a, *b}}
    out, asked, left, right, least = np.zeros(len(a)), [], [], [], []
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = words[p], words[q]
        both = x & y
        if not x or not y:
            continue
        if both and (x <= y or y <= x):
            out[k] = 1.0
            continue
        shared = " ".join(sorted(both))
        ab, ba = (f"{shared} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
        asked.append(k)
        left.append(ab)
        right.append(ba)
        # the shared words begin either side, so all of them are common
        least.append(2 * len(shared) / (len(shared) + min(len(ab), len(ba))) if both else 0.0)
    if asked:
        out[asked] = np.maximum(ratios(left, right), least)
    return out


def _bounded_best_window(p: str, q: str, best: float) -> float:
    """_best_window() or best, if that is more; only windows that share enough letters with p are compared."""
    n, size = len(p), len(q)
    spare: dict[str, int] = {}
    masks: dict[str, int] = {}
    for k, c in enumerate(p):
        spare[c] = spare.get(c, 0) + 1
        masks[c] = masks.get(c, 0) | 1 << k
    common, bounds = 0, []
    for end in range(1, size + n):
        if end > n:
            c = q[end - 1 - n]
            if c in spare:
                spare[c] += 1
                common -= spare[c] > 0
        if end <= size:
            c = q[end - 1]
            if c not in spare:
                continue
            common += spare[c] > 0
            spare[c] -= 1
        elif q[-1] not in spare:
            continue
        bound = 2 * common / (n + min(end, size) - max(0, end - n))
        if bound > best:
            bounds.append((bound, end))
    full = (1 << n) - 1
    for bound, end in sorted(bounds, reverse=True):
        if bound <= best:
            break
        v, w = full, q[max(0, end - n) : end]
        for c in w:
            if c in masks:
                u = v & masks[c]
                v = ((v + u) | (v - u)) & full
        best = max(best, 2 * (n - v.bit_count()) / (n + len(w)))
    return best


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Windows are visited by falling upper bound, until none can be better."""
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if not x or x in y:
            out[k] = 1.0 if x or not y else 0.0
        else:
            out[k] = _bounded_best_window(x, y, 0.0)
            if len(x) == len(y):
                out[k] = _bounded_best_window(y, x, out[k])
    return out


def partial_token_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out = np.ones(len(a))
    apart = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if not set(x.split()) & set(y.split())]
    x, y = [a[k] for k in apart], [b[k] for k in apart]
    distinct = lambda texts: [" ".join(sorted(set(t.split()))) for t in texts]
    if apart:
        out[apart] = np.maximum(partial_ratios(_sorted_words(x), _sorted_words(y)), partial_ratios(distinct(x), distinct(y)))
    return out


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out, sizes = np.zeros(len(a)), np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.float64).reshape(-1, 2)
    full = np.flatnonzero(sizes.min(1) > 0)
    spread = np.zeros(len(a))
    spread[full] = sizes[full].max(1) / sizes[full].min(1)
    some = lambda rows: ([a[k] for k in rows.tolist()], [b[k] for k in rows.tolist()])
    out[full] = ratios(*some(full))
    near, far = full[spread[full] < 1.5], full[spread[full] >= 1.5]
    if len(near):
        out[near] = np.maximum(out[near], 0.95 * np.maximum(token_sort_ratios(*some(near)), token_set_ratios(*some(near))))
    if len(far):
        scale = np.where(spread[far] < 8, 0.9, 0.6)
        out[far] = np.maximum(out[far], scale * np.maximum(partial_ratios(*some(far)), 0.95 * partial_token_ratios(*some(far))))
    return out


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    for part, x, y in chunks(a, b):
        p, n = code_points(x, 0x110000)
        q, m = code_points(y, 0x110001)
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        mine, used, at = np.zeros(p.shape, bool), np.zeros(q.shape, bool), np.arange(q.shape[1])
        for i in range(p.shape[1]):
            can = (q == p[:, i : i + 1]) & ~used & (np.abs(at - i) <= reach[:, None])
            hit = np.flatnonzero(can.any(1))
            used[hit, can[hit].argmax(1)] = True
            mine[hit, i] = True
        common = mine.sum(1)
        moved = np.bincount(np.repeat(np.arange(len(x)), common), p[mine] != q[used], len(x)) // 2
        some = np.maximum(common, 1)
        jaro = np.where(common > 0, (common / np.maximum(n, 1) + common / np.maximum(m, 1) + (common - moved) / some) / 3, 0.0)
        w = min(4, p.shape[1], q.shape[1])
        prefix = np.cumprod(p[:, :w] == q[:, :w], axis=1).sum(1)
        same = np.array([s == t for s, t in zip(x, y, strict=True)])
        out[part] = np.where(same, 1.0, np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro))
    return out


def edit_distances(a: list[str], b: list[str], swaps: bool) -> np.ndarray:
    """levenshtein() of pairs, or osa_distance() with swaps; all cells of a row at once."""
    out = np.zeros(len(a), np.int64)
    for part, x, y in chunks(a, b):
        p, n = code_points(x, 0x110000)
        q, m = code_points(y, 0x110001)
        steps = np.arange(q.shape[1] + 1)
        row, before = np.broadcast_to(steps, (len(x), len(steps))).copy(), None
        found = np.where(n == 0, m, 0)
        for i in range(p.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (q != p[:, i : i + 1]))
            if swaps and i and q.shape[1] > 1:
                swapped = (p[:, i : i + 1] == q[:, :-1]) & (p[:, i - 1 : i] == q[:, 1:])
                new[:, 2:] = np.where(swapped, np.minimum(new[:, 2:], before[:, :-2] + 1), new[:, 2:])
            new = np.minimum.accumulate(new - steps, axis=1) + steps
            before, row = row, new
            done = n == i + 1
            found[done] = row[done, m[done]]
        out[part] = found
    return out


def monge_elkans(a: list[list[str]], b: list[list[str]]) -> list[float | None]:
    """monge_elkan() of pairs of word lists; every pair of words is compared once."""
    pairs = list({(x, y) for p, q in zip(a, b, strict=True) for x in p for y in q})
    like = dict(zip(pairs, jaro_winklers([x for x, _ in pairs], [y for _, y in pairs]).tolist(), strict=True)) if pairs else {}
    return [sum(max(like[x, y] for y in q) for x in p) / len(p) if len(p) and len(q) else None for p, q in zip(a, b, strict=True)]


def over_pairs(batch: Callable, a: Iterable, b: Iterable) -> list:
    """A batch kernel over columns: null where either side is null, equal pairs computed once."""
    keys = [None if x is None or y is None else (x, y) if isinstance(x, str) else (tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)]
    pairs = [k for k in dict.fromkeys(keys) if k is not None]
    if not pairs:
        return [None] * len(keys)
    values = batch([x for x, _ in pairs], [y for _, y in pairs])
    known = dict(zip(pairs, values.tolist() if isinstance(values, np.ndarray) else values, strict=True))
    return [None if k is None else known[k] for k in keys]


def pair_udf(batch: Callable, kind: DataType = DoubleType()):
    """An Arrow function of two columns from a batch kernel; null where either is null."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(over_pairs(batch, a, b), dtype=object)

    return run


def struct_udf(kernels: dict[str, tuple[Callable, int, int]]):
    """One Arrow function for several kernels: name -> batch kernel and the numbers of its two arguments."""

    @F.pandas_udf(StructType([StructField(name, DoubleType()) for name in kernels]))
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            yield pd.DataFrame({name: pd.Series(over_pairs(f, columns[i], columns[j]), dtype=float) for name, (f, i, j) in kernels.items()})

    return run


ratio_udf, token_sort_udf, token_set_udf = pair_udf(ratios), pair_udf(token_sort_ratios), pair_udf(token_set_ratios)
partial_udf, weighted_udf, jaro_winkler_udf = pair_udf(partial_ratios), pair_udf(weighted_ratios), pair_udf(jaro_winklers)
osa_udf, monge_elkan_udf = pair_udf(lambda a, b: edit_distances(a, b, True), LongType()), pair_udf(monge_elkans)
