"""The string kernels for many pairs of rows of two tables: texts are encoded once a row, pairs are two arrays of row numbers.

Matrices lie position by position with a column for each pair, so that every step is a NumPy call over bytes of thousands of
pairs. Texts that are longer than LONG or not ASCII are compared by the plain kernels; results are the same to the last bit.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import jaro_winkler, lcs_length, partial_ratio, token_set_ratio  # not the module: its functions for Spark can't be sent to workers

#: Bytes of a text in a matrix, one bit each where words are left out; pairs that are compared, and rows that are encoded, at a time.
LONG, SLICE, ROWS = 63, 8192, 50_000


def _one(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and how many each text has."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data else np.zeros(0, np.uint8), np.diff(offsets)


def _parts(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    for x in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        for at in range(0, len(x), ROWS):
            yield x.slice(at, ROWS)


def _texts(offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes()))


class Texts:
    """Texts as rows of bytes, filled up with 0; odd ones have no row."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        parts, at = list(_parts(texts)), 0
        size = [pc.binary_length(x).to_numpy() for x in parts]
        #: Characters of each text.
        self.size = np.concatenate([np.zeros(0, np.int32), *size]).astype(np.int32)
        self.odd, self.strange = self.size > LONG, {}
        self.rows = np.zeros((len(self.size), max(1, int(self.size[~self.odd].max(initial=0)))), np.uint8)
        for x in parts:
            flat, n = _bytes(x)
            odd, strange = self.odd[at : at + len(n)], (flat == 0) | (flat > 127)
            if strange.any():
                odd |= np.bincount(np.repeat(np.arange(len(n)), n), strange, len(n)) > 0
            for k in np.flatnonzero(odd).tolist():
                self.strange[at + k] = x[k].as_py()
                self.size[at + k] = len(self.strange[at + k])
            inside = np.where(odd, 0, n)
            self.rows[at : at + len(n)][np.arange(self.rows.shape[1]) < inside[:, None]] = flat[np.repeat(~odd, n)] if odd.any() else flat
            at += len(n)

    def text(self, at: int) -> str:
        return self.strange[at] if self.odd[at] else self.rows[at, : self.size[at]].tobytes().decode()

    def tails(self) -> Texts:
        """The texts less their first letters."""
        out = object.__new__(Texts)
        out.rows = self.rows[:, 1:] if self.rows.shape[1] > 1 else np.zeros_like(self.rows)
        out.odd, out.size, out.strange = self.odd, np.maximum(self.size - 1, 0), {k: x[1:] for k, x in self.strange.items()}
        return out


def without(texts: pa.Array | pa.ChunkedArray, letters: str) -> pa.ChunkedArray:
    """Texts less some letters, which are ASCII."""
    kept = np.ones(256, bool)
    kept[list(letters.encode())] = False
    out = []
    for x in _parts(texts):
        flat, size = _bytes(x)
        keep = kept[flat]
        offsets = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
        out.append(_texts(offsets, flat[keep]))
    return pa.chunked_array(out, pa.large_string())


def _first(rows: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(rows[at][:, :width].T)


def _second(rows: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """As _first(), but filled up with 255, so that no place beyond an end equals one beyond another end."""
    out = _first(rows, at, width)
    return np.subtract(out, (out == 0).view(np.uint8), out=out)


def _slices(*keys: np.ndarray, apart: bool = False) -> Iterator[np.ndarray]:
    """Places of pairs in the order of two keys (as far as they are below 256), a few at a time; apart: a slice has one first key."""
    first, second = (np.minimum(k, 255).astype(np.uint16) for k in keys)
    order = np.argsort(first << np.uint16(8) | second, kind="stable")  # sixteen bits are sorted by digits
    first = first[order]
    cuts = np.flatnonzero(np.diff(first)) + 1 if apart else np.zeros(0, np.int64)
    for part in np.split(order, cuts):
        for at in range(0, len(part), SLICE):
            yield part[at : at + SLICE]


def _braid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of b, last first, where the strand that ends there begins (from 1 on), or 0 for one from the left.

    The braid of the semi-local common subsequence (Tiskin): that of a with b[l:r] is r - l long less the strands that begin
    from l on and end before r. Strands swap where letters are equal, and cross once at most elsewhere; the cells of a
    diagonal don't depend on each other.
    """
    m, n = len(a), len(b)
    b = np.ascontiguousarray(b[::-1])
    h, v = np.zeros_like(a), np.repeat(np.arange(n, 0, -1, dtype=np.uint8)[:, None], a.shape[1], 1)
    same, both = np.empty((min(m, n), a.shape[1]), np.uint8), np.empty((min(m, n), a.shape[1]), np.uint8)
    for d in range(m + n - 1):
        low, high = max(0, d - n + 1), min(m, d + 1)
        at, k = n - 1 - d + low, high - low
        x, y, e, t = h[low:high], v[at : at + k], same[:k], both[:k]
        np.equal(a[low:high], b[at : at + k], out=e.view(bool))
        np.negative(e, out=e)
        np.bitwise_or(e, x, out=e)
        np.bitwise_xor(x, y, out=t)
        np.minimum(e, y, out=x)
        np.bitwise_xor(t, x, out=y)
    return v


def _common(v: np.ndarray) -> np.ndarray:
    return len(v) - np.add.reduce((v > 0).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)


def _plain(out: np.ndarray, kernel: Callable, a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """kernel for pairs with an odd text, into out; the places of the others."""
    odd = a.odd[i] | b.odd[j]
    for k in np.flatnonzero(odd).tolist():
        out[k] = kernel(a.text(int(i[k])), b.text(int(j[k])))
    return np.flatnonzero(~odd)


def lcs_lengths(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """kernels.lcs_length() of the pairs."""
    out = np.zeros(len(i), np.int64)
    own = _plain(out, lcs_length, a, b, i, j)
    m, n = a.size[i[own]], b.size[j[own]]
    for part in _slices(m, n):
        wide = max(1, int(m[part].max())), max(1, int(n[part].max()))
        at = own[part]
        out[at] = _common(_braid(_first(a.rows, i[at], wide[0]), _second(b.rows, j[at], wide[1])))
    return out


def ratios_of(lcs: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = m + n
    return np.where(total > 0, 2 * lcs / np.maximum(total, 1), 1.0)


def _windows(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kernels._best_window() of the pairs and their common subsequences; the first texts are not longer, and not empty."""
    best, lcs = np.zeros(len(i)), np.zeros(len(i), np.int64)
    m, n = a.size[i], b.size[j]
    for part in _slices(m, n, apart=True):
        size, wide, least = int(m[part[0]]), int(n[part].max()), int(n[part].min())
        p, q = _first(a.rows, i[part], size), _second(b.rows, j[part], wide)
        v = _braid(p, q)
        lcs[part] = _common(v)
        v = np.ascontiguousarray(v[::-1])
        end, top, full = n[part], np.zeros(len(part)), np.zeros(len(part), np.uint8)
        ends_in = (p == q[end - 1, np.arange(len(part))]).any(0)  # a window that is cut at the end must end with a letter of a
        for e in range(1, wide + size):
            low, high = max(0, e - size), min(e, wide)
            found = (high - low) - np.add.reduce((v[low:high] > low).view(np.uint8), axis=0, dtype=np.uint8)
            if e < size:  # cut at the beginning
                np.maximum(top, 2 * found.astype(np.int64) / (size + e), out=top)
                continue
            if e <= least:
                np.maximum(full, found, out=full)
                continue
            inside = e <= end
            if inside.any():
                np.maximum(full, np.where(inside, found, 0), out=full)
            cut = np.flatnonzero(~inside & ends_in & (low < end))
            if len(cut):
                top[cut] = np.maximum(top[cut], 2 * found[cut].astype(np.int64) / (size + end[cut] - low))
        best[part] = np.maximum(top, 2 * full.astype(np.int64) / (2 * size))
    return best, lcs


def partials(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kernels.partial_ratio() and kernels.lcs_length() of the pairs."""
    out, lcs = np.zeros(len(i)), np.zeros(len(i), np.int64)
    own = _plain(out, partial_ratio, a, b, i, j)
    if len(own) < len(i):
        _plain(lcs, lcs_length, a, b, i, j)
    m, n = a.size[i[own]], b.size[j[own]]
    out[own[(m == 0) & (n == 0)]] = 1.0
    full = (m > 0) & (n > 0)
    for at, x, y, k, l in ((own[full & (m <= n)], a, b, i, j), (own[full & (m > n)], b, a, j, i)):
        out[at], lcs[at] = _windows(x, y, k[at], l[at])
    at = own[full & (m == n)]
    out[at] = np.maximum(out[at], _windows(b, a, j[at], i[at])[0])
    return out, lcs


def jaro_winklers(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """kernels.jaro_winkler() of the pairs."""
    out = np.zeros(len(i))
    own = _plain(out, jaro_winkler, a, b, i, j)
    m, n = a.size[i[own]], b.size[j[own]]
    reach = np.maximum(0, np.maximum(m, n) // 2 - 1)
    for part in _slices(reach, m, apart=True):
        at, far = own[part], int(reach[part[0]])
        x, y = m[part], n[part]
        wide = max(1, int(x.max())), max(1, int(y.max()))
        p, q = _first(a.rows, i[at], wide[0]), _second(b.rows, j[at], wide[1])
        free, mine = np.ones(q.shape, np.uint8), np.zeros(p.shape, np.uint8)
        for k in range(wide[0]):
            low, high = max(0, k - far), min(wide[1], k + far + 1)
            if low >= high:
                continue
            can, open_ = (q[low:high] == p[k]).view(np.uint8), np.ones(len(part), np.uint8)
            can &= free[low:high]
            for c, f in zip(can, free[low:high], strict=True):
                c &= open_
                f ^= c
                open_ ^= c
            np.bitwise_xor(open_, 1, out=mine[k])
        common = np.add.reduce(mine, axis=0, dtype=np.int64)
        used = np.ascontiguousarray((free == 0).T)
        mine = np.ascontiguousarray(mine.T).view(bool)
        apart = a.rows[i[at]][:, : wide[0]][mine] != b.rows[j[at]][:, : wide[1]][used]
        moved = np.diff(np.concatenate([[0], np.cumsum(apart)])[np.concatenate([[0], np.cumsum(common)])]) // 2
        jaro = np.where(common > 0, (common / np.maximum(x, 1) + common / np.maximum(y, 1) + (common - moved) / np.maximum(common, 1)) / 3, 0.0)
        head = min(4, *wide)
        prefix = np.cumprod(p[:head] == q[:head], axis=0).sum(0)
        jaro = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        same = x == y  # equal texts have all letters in common and none moved
        same[same] = (p[:, same] == q[: wide[0], same]).sum(0) == x[same] if wide[1] >= wide[0] else (p[: wide[1], same] == q[:, same]).sum(0) == x[same]
        out[at] = np.where(same, 1.0, jaro)
    return out


class Lists:
    """A list of numbers for each row."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size, self.start = flat.astype(np.int32), size.astype(np.int32), (np.cumsum(size) - size).astype(np.int32)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def where(self, keep: np.ndarray) -> Lists:
        return Lists(self.flat[keep], np.bincount(self.rows()[keep], minlength=len(self.size)))

    def first(self, n: int) -> Lists:
        return self.where(np.arange(len(self.flat)) - np.repeat(self.start, self.size) < n)

    def mapped(self, to: np.ndarray) -> Lists:
        return Lists(to[self.flat], self.size)

    def sorted(self, distinct: bool = False) -> Lists:
        keys = self.rows() << 32
        keys |= self.flat
        keys.sort()
        if distinct and len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        return Lists(keys & 0xFFFFFFFF, np.bincount(keys >> 32, minlength=len(self.size)))

    def at(self, place: int, none: int) -> np.ndarray:
        """The number at a place of each list (-1: the last)."""
        out = np.full(len(self.size), none, np.int32)
        there = self.size > max(place, 0)
        out[there] = self.flat[(self.start + (place if place >= 0 else self.size + place))[there]]
        return out

    def matrix(self, rows: np.ndarray, wide: int, none: int, values: np.ndarray | None = None) -> np.ndarray:
        """The lists of so many rows, place by place."""
        places, values = np.arange(wide)[:, None], self.flat if values is None else values
        if not len(values):
            return np.full((wide, len(rows)), none, values.dtype)
        at = np.minimum(self.start[rows] + places, len(values) - 1)
        return np.where(places < self.size[rows], values[at], values.dtype.type(none))


def shared(a: Lists, b: Lists, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers of the first list are in the second."""
    out = np.zeros(len(i), np.int64)
    m, n = a.size[i], b.size[j]
    for part in _slices(m, n):
        wide = int(m[part].max()), int(n[part].max())
        if min(wide):
            out[part] = _met(a.matrix(i[part], wide[0], -1), b.matrix(j[part], wide[1], -2))[0].sum(0)
    return out


def _met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the first are among the second, and the other way round."""
    one, two = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for k in range(len(x)):
        same = y == x[k]
        one[k] = same.any(0)
        two |= same
    return one, two


def coded(*columns: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct texts of columns, and which of them each row has."""
    own = _one(pa.chunked_array([c.cast(pa.string()) for x in columns for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])], pa.string())).dictionary_encode()
    own = _one(own)
    return own.dictionary, np.split(own.indices.to_numpy(), np.cumsum([len(x) for x in columns])[:-1])


def give_back() -> None:
    """Memory that is free goes back to the system, as a worker shares it with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The words of texts in numbers that follow the words' order."""

    def __init__(self, *sides: pa.Array | pa.ChunkedArray):
        parts, self.lists = [], []
        for t in sides:
            split = pc.split_pattern(_one(t).cast(pa.string()), " ")
            words = split.flatten()
            parts.append((words, np.repeat(np.arange(len(split), dtype=np.int32), np.diff(split.offsets.to_numpy())), len(split)))
            del split
        coded = _one(pa.chunked_array([w for w, _, _ in parts])).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        codes = rank[coded.indices.to_numpy()]
        filled, at = pc.binary_length(self.words).to_numpy() > 0, 0
        for words, row, n in parts:
            own = codes[at : at + len(words)]
            at += len(words)
            keep = filled[own]
            self.lists.append(Lists(own[keep], np.bincount(row[keep], minlength=n)))
        self.size = pc.binary_length(self.words).to_numpy().astype(np.int64)

    def joined(self, x: Lists) -> Texts:
        """Words with a blank before each."""
        blank, out = pc.binary_join_element_wise("", self.words, " ").cast(pa.large_string()), []
        for at in range(0, len(x.size), ROWS):
            n = x.size[at : at + ROWS]
            first = int(x.start[at])
            flat, size = _bytes(blank.take(pa.array(x.flat[first : first + int(n.sum())])))
            out.append(_texts(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])], flat))
        return Texts(pa.chunked_array(out, pa.large_string()))

    def numbered(self, of: Callable[[pa.Array], pa.Array]) -> np.ndarray:
        """A number for what of makes of each word."""
        return _one(of(self.words)).dictionary_encode().indices.to_numpy()


class Sets:
    """The words of texts in order, with a blank before each: all (ordered), and the distinct ones (texts)."""

    def __init__(self, words: Words, own: Lists):
        every, self.lists = own.sorted(), own.sorted(distinct=True)
        self.ordered = words.joined(every)
        self.texts = self.ordered if len(every.flat) == len(self.lists.flat) else words.joined(self.lists)
        self.length = np.minimum(words.size[self.lists.flat] + 1, 255).astype(np.uint8)

    def bits(self, rows: np.ndarray, wide: int) -> np.ndarray:
        """The places of each word in its text."""
        size = self.lists.matrix(rows, wide, 0, self.length).astype(np.uint64)
        start = np.cumsum(size, axis=0, dtype=np.uint64) - size
        return (np.left_shift(np.uint64(1), size) - np.uint64(1)) << start


def _left(rows: np.ndarray, at: np.ndarray, keep: np.ndarray, wide: int) -> np.ndarray:
    kept = np.unpackbits(keep.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :wide]
    return np.ascontiguousarray((rows[at][:, :wide] * kept).T)


def token_sort_ratios(a: Sets, b: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """kernels.token_sort_ratio() of the pairs."""
    m, n = a.ordered.size[i].astype(np.int64), b.ordered.size[j].astype(np.int64)
    lcs = lcs_lengths(a.ordered, b.ordered, i, j)
    return ratios_of(lcs - ((m > 0) & (n > 0)), np.maximum(m - 1, 0), np.maximum(n - 1, 0))  # both begin with a blank


def token_set_ratios(a: Sets, b: Sets, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kernels.token_set_ratio() of the pairs, and how many distinct words they share."""
    out, same = np.zeros(len(i)), np.zeros(len(i), np.int64)
    odd = a.texts.odd[i] | b.texts.odd[j]
    for k in np.flatnonzero(odd).tolist():
        out[k] = token_set_ratio(a.texts.text(int(i[k])), b.texts.text(int(j[k])))
    if odd.any():
        same[odd] = shared(a.lists, b.lists, i[odd], j[odd])
    own = np.flatnonzero(~odd & (a.lists.size[i] > 0) & (b.lists.size[j] > 0))
    m, n = a.texts.size[i[own]], b.texts.size[j[own]]
    for part in _slices(m, n):
        at = own[part]
        x, y = i[at], j[at]
        wide = int(a.lists.size[x].max()), int(b.lists.size[y].max())
        one, two = _met(a.lists.matrix(x, wide[0], -1), b.lists.matrix(y, wide[1], -2))
        count = one.sum(0)
        same[at] = count
        here, there = a.bits(x, wide[0]), b.bits(y, wide[1])
        both = np.bitwise_or.reduce(np.where(one, here, np.uint64(0)), axis=0)
        left, right = np.bitwise_or.reduce(np.where(one, np.uint64(0), here), axis=0), np.bitwise_or.reduce(np.where(two, np.uint64(0), there), axis=0)
        left &= left - np.uint64(1) * (left > 0)  # less the first blank
        right &= right - np.uint64(1) * (right > 0)
        total = np.maximum(np.bitwise_count(both).astype(np.int64) - 1, 0)
        lead = np.where(count > 0, total + 1, 0)
        some = np.flatnonzero((left > 0) & (right > 0))
        value = np.where(count > 0, 1.0, 0.0)
        if len(some):
            q = _left(b.texts.rows, y[some], right[some], int(n[part].max()))
            q = np.subtract(q, (q == 0).view(np.uint8), out=q)
            lcs = _common(_braid(_left(a.texts.rows, x[some], left[some], int(m[part].max())), q)) + lead[some]
            ab, ba = (np.bitwise_count(s[some]).astype(np.int64) + lead[some] for s in (left, right))
            least = np.where(count[some] > 0, 2 * total[some] / np.maximum(total[some] + np.minimum(ab, ba), 1), 0.0)
            value[some] = np.maximum(2 * lcs / (ab + ba), least)
        out[at] = value
    return out, same
