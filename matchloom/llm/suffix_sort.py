"""Suffix sorting by recursive induction; queues on disk carry suffixes and common prefixes.

A suffix is S if it is less than the one to its right, else L; the leftmost S of a run is LMS. One induction takes
sorted seeds and derives a class of suffixes from them: whoever is scanned puts its left neighbour into a priority
queue, under its first symbol. LMS suffixes induce the L suffixes upwards, those the S suffixes downwards.

With seeds in order of their first symbol only, the LMS substrings come out sorted; equal ones get one name, the string
of names is sorted by recursion, and a second induction from LMS suffixes in their right order sorts all suffixes.

Each tuple of a queue is a symbol, a position and the length of the prefix that it shares with the tuple before it:
one more than the least common prefix met in the scan since the symbol's last tuple. So common prefixes are carried
along and never found by comparing; equal names are those whose common prefix is a whole LMS substring, and what a
recursion returns counted in names is turned into symbols by the names' lengths and the first induction's prefixes.

Texts that repeat a word over and over give runs of one name, which would put themselves in one by one; so a string of
names with many runs is sorted as a string of runs.

A queue is cut into slots of neighbouring symbols, each in a file of its own once it holds more than HELD tuples; only
the slot at work is in memory. Tuples are popped in batches: as many as come before everything that they put in
themselves. Results and long arrays are files too, mapped into memory. So memory is bounded by HELD and WINDOW, apart
from what the system caches of files; files go with the folder, and a task that is run again begins with its own.

Defined results: an empty array gives empty results; common prefixes are exact up to the cap asked for, and at least
that where they are longer.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Numbers that a slot, a result or an array holds in memory before it goes to a file.
HELD = 1 << 23
#: Tuples that are popped at once, and tuples of a slot, unless one symbol has more.
WINDOW = 1 << 16
#: Names are sorted by their runs where these are fewer than this share of them; bytes are not.
RUNS, BYTES = 0.98, 256
#: Tuples that are looked at when the batches before were short.
LEAST = 256


class Files:
    """Arrays of int32 in memory, or in unnamed files of a folder where they are long."""

    def __init__(self, folder: str | None, held: int):
        self.folder, self.held = folder, held

    def file(self):
        return tempfile.TemporaryFile(dir=self.folder or os.environ.get("TMPDIR"))

    def zeros(self, n: int, kind=np.int32) -> np.ndarray:
        if n <= self.held:
            return np.zeros(n, kind)
        with self.file() as f:
            f.truncate(n * np.dtype(kind).itemsize)
            return np.memmap(f, kind, "r+", shape=(n,))


class Spool:
    """Rows of int32 columns that are appended, and read in their order."""

    def __init__(self, files: Files, columns: int):
        self.files, self.columns, self.parts, self.held, self.file, self.n = files, columns, [], 0, None, 0

    def put(self, rows: np.ndarray) -> None:
        """rows: (n, columns)."""
        self.parts.append(rows)
        self.held += rows.size
        self.n += len(rows)
        if self.held > self.files.held:
            self.file = self.file or self.files.file()
            for part in self.parts:
                self.file.write(np.ascontiguousarray(part, np.int32).data)
            self.parts, self.held = [], 0

    def all(self) -> np.ndarray:
        if self.file:
            for part in self.parts:
                self.file.write(np.ascontiguousarray(part, np.int32).data)
            self.file.flush()
            out = np.memmap(self.file, np.int32, "r+", shape=(self.n, self.columns))
            self.file.close()
        else:
            out = np.concatenate([np.zeros((0, self.columns), np.int32), *self.parts])
        self.parts, self.file = [], None
        return out


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the empty suffix is least, so the last one is L."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    s = np.zeros(n, bool)
    if len(differs):
        up = t[differs] < t[differs + 1]
        first = np.concatenate([[0], differs[:-1] + 1])
        s[: differs[-1] + 1] = np.repeat(up, differs + 1 - first)  # the next place where symbols differ decides
    return s


class Text:
    """A string of symbols 0..k-1 with what all inductions need of it."""

    def __init__(self, t: np.ndarray, k: int, files: Files):
        self.t, self.k, self.n, self.files = t, k, len(t), files
        self.is_s = suffix_types(t)
        self.run_ends = np.append(np.flatnonzero(t[:-1] != t[1:]), self.n - 1)
        counts = np.bincount(t, minlength=k)
        self.slot = ((np.cumsum(counts) - counts) // WINDOW).astype(np.int32)

    def run(self, at: np.ndarray) -> np.ndarray:
        """Equal symbols from a position on."""
        return self.run_ends[np.searchsorted(self.run_ends, at)] - at + 1


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first : last + 1] for each pair, by minima over powers of two."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    table, step = values, 0
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[first[own]], table[last[own] + 1 - (1 << k)])
        step = 1 << k
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return out


def stable_order(x: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(x.astype(np.uint16) if k <= 65536 else x, kind="stable")


class Induction:
    """One scan. down: S suffixes from sorted L ones (symbols descending), else L suffixes from sorted LMS ones."""

    def __init__(self, text: Text, down: bool, cap: int):
        self.text, self.down, self.cap = text, down, cap
        slots = int(text.slot[-1]) + 1 if text.k else 1
        self.queues = [Spool(text.files, 3) for _ in range(slots)]
        self.scanned = 0
        self.last_put = np.full(text.k, -1, np.int64)
        #: For each length the last place in the scan whose common prefix is no longer.
        self.last_le = np.full(cap + 1, -1, np.int64)

    def place(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols in the order of the scan."""
        return self.text.k - 1 - symbols if self.down else symbols

    def slot_of(self, places: np.ndarray) -> np.ndarray:
        last = self.text.slot[-1]
        return last - self.text.slot[self.text.k - 1 - places] if self.down else self.text.slot[places]

    def put(self, rows: np.ndarray) -> None:
        """rows: place, position, common prefix."""
        slots = self.slot_of(rows[:, 0])
        order = np.argsort(slots, kind="stable")
        slots, rows = slots[order], rows[order]
        cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(rows)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            self.queues[slots[first]].put(rows[first:end])

    def induced(self, position: np.ndarray, prefix: np.ndarray, left: np.ndarray, can: np.ndarray) -> np.ndarray:
        """Rows for the left neighbours of a batch that may be put in, in the order of the scan."""
        base, text = self.scanned, self.text
        who = np.flatnonzero(can)
        symbols = text.t[left[who]]
        order = stable_order(symbols, text.k)
        c, q = symbols[order], who[order]
        head = np.concatenate([[True], c[1:] != c[:-1]])
        since = np.empty(len(q), np.int64)  # place in the scan of the symbol's tuple before
        since[1:] = q[:-1] + base
        since[head] = self.last_put[c[head]]
        own = np.full(len(q), 0, np.int64)
        inside = since >= base
        if inside.any():
            own[inside] = least_between(prefix, (since[inside] - base + 1), q[inside])
        outside = ~inside & (since >= 0)
        if outside.any():
            before = np.searchsorted(self.last_le, since[outside], side="right")
            own[outside] = np.minimum(np.minimum.accumulate(prefix)[q[outside]], np.minimum(before, self.cap))
        known = since >= 0
        own[known] = np.minimum(own[known] + 1, self.cap)
        tail = np.concatenate([head[1:], [True]])
        self.last_put[c[tail]] = q[tail] + base
        rows = np.empty((len(q), 3), np.int32)
        rows[order, 0], rows[order, 1], rows[order, 2] = self.place(c), left[q], own
        return rows

    def run(self, seeds: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        """Positions and common prefixes of the class induced, in the order of the scan.

        seeds: positions in that order, each with its common prefix with the seed before it.
        """
        text, out = self.text, Spool(self.text.files, 2)
        if not self.down and text.n:
            # the empty suffix is scanned first, and induces the last symbol
            self.put(np.array([[text.t[-1], text.n - 1, 0]], np.int32))
            self.last_put[text.t[-1]], self.scanned = 0, 1
            self.last_le[:] = 0
        taken, last, window = 0, (-1, -1), WINDOW
        for slot, queue in enumerate(self.queues):
            rows, done = queue.all(), 0
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            fresh = rows[:0]  # what the slot puts into itself; sorted too, and behind rows of the same symbol
            self.queues[slot] = None
            while True:
                a, f, b = rows[done : done + window], fresh[:window], seeds[taken : taken + window]
                place_b = self.place(text.t[b].astype(np.int64))
                own = int(np.searchsorted(self.slot_of(place_b), slot, side="right"))
                more = (done + len(a) < len(rows), len(f) < len(fresh), own == len(b) and taken + own < len(seeds))
                b, place_b = b[:own], place_b[:own]
                # the class that is induced stands before the seeds of the same symbol
                key = np.concatenate([2 * a[:, 0].astype(np.int64), 2 * f[:, 0].astype(np.int64), 2 * place_b + 1])
                if not len(key):
                    break
                ends = np.cumsum([len(a), len(f), len(b)])
                order = np.argsort(key, kind="stable") if max(len(a), len(f), len(b)) < len(key) else np.arange(len(key))
                # beyond the last row in sight of a source that has more, the others must wait
                n = min([len(key), *(int(np.flatnonzero(order == e - 1)[0]) + 1 for e, m in zip(ends, more, strict=True) if m)])
                order = order[:n]
                key = key[order]
                position = np.concatenate([a[:, 1], f[:, 1], b])[order].astype(np.int64)
                left = position - 1
                can = (left >= 0) & (text.is_s[left] == self.down)
                aim = np.where(can, 2 * self.place(text.t[left].astype(np.int64)), 1 << 62)
                # up to the first tuple that one of those before it would put something in front of
                ahead = key[1:] > np.minimum.accumulate(aim)[:-1]
                n = int(ahead.argmax()) + 1 if ahead.any() else n
                window = min(WINDOW, max(LEAST, 4 * n))
                order, key, position, left, can = order[:n], key[:n], position[:n], left[:n], can[:n]
                prefix = np.concatenate([a[:, 2], f[:, 2], prefixes[taken : taken + len(b)]])[order]
                before_key = np.concatenate([[last[0]], key[:-1]])
                seam = np.flatnonzero(key != before_key)
                prefix[seam] = 0
                seam = seam[key[seam] >> 1 == before_key[seam] >> 1]
                if len(seam):
                    before_at = np.concatenate([[last[1]], position[:-1]])[seam]
                    prefix[seam] = np.minimum(np.minimum(text.run(position[seam]), text.run(before_at)), self.cap)
                induced = order < ends[1]
                old = int(np.count_nonzero(order < ends[0]))
                new = int(np.count_nonzero(induced)) - old
                done, taken, fresh = done + old, taken + n - old - new, fresh[new:]
                out.put(np.stack([position[induced], prefix[induced]], 1).astype(np.int32))
                if can.any():
                    put = self.induced(position, prefix, left, can)
                    here = self.slot_of(put[:, 0]) == slot
                    if here.any():
                        fresh = np.concatenate([fresh, put[here]])
                        fresh = fresh[np.argsort(fresh[:, 0], kind="stable")]
                        put = put[~here]
                    if len(put):
                        self.put(put)
                self.last_le[prefix] = np.arange(self.scanned, self.scanned + n)
                np.maximum.accumulate(self.last_le, out=self.last_le)
                self.scanned += n
                last = (int(key[-1]), int(position[-1]))
        return out.all()


def induce(text: Text, lms: np.ndarray, prefixes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position, common prefix) of L suffixes, ascending, and of S suffixes, descending."""
    low = Induction(text, False, cap).run(lms, prefixes)
    turned = np.concatenate([[0], low[:0:-1, 1]]) if len(low) else low[:, 1]
    return low, Induction(text, True, cap).run(low[::-1, 0], turned)


def _by_runs(t: np.ndarray, ends: np.ndarray, cap: int, files: Files) -> tuple[np.ndarray, np.ndarray]:
    """_sorted() by way of the string of runs: a run is a symbol of its own, by its symbol, what follows, and its length.

    Of one symbol, runs that something less follows come first, the shorter the earlier; then the others, the longer
    the earlier. A suffix that begins within a run stands by the rest of the run and the place of the next run's suffix.
    """
    n, m = len(t), len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size, symbol = ends - starts + 1, t[starts].astype(np.int64)
    up = np.append(symbol[1:] > symbol[:-1], False)
    by = np.lexsort((np.where(up, -size, size), up, symbol))
    other = np.concatenate([[False], (np.diff(symbol[by]) != 0) | (np.diff(up[by]) != 0) | (np.diff(size[by]) != 0)])
    names = files.zeros(m)
    names[by] = np.cumsum(other)
    order, common = _sorted(names, int(names.max()) + 1, cap, files)
    # from runs to symbols; of the first runs that differ the shorter one is shared, if they are of one symbol
    a, b, h = order[:-1].astype(np.int64), order[1:].astype(np.int64), common[1:].astype(np.int64)
    x, y = np.minimum(a + h, m - 1), np.minimum(b + h, m - 1)
    inside = (a + h < m) & (b + h < m) & (h < cap)
    first = np.append(starts, n)
    shared = np.concatenate([[0], np.minimum(first[a + h] - starts[a] + np.where(inside & (symbol[x] == symbol[y]), np.minimum(size[x], size[y]), 0), cap)])
    rank = np.full(m + 1, -1, np.int64)
    rank[order] = np.arange(m)
    run = np.repeat(np.arange(m), size)
    rest = ends[run] + 1 - np.arange(n)
    after = rank[run + 1]
    out = np.lexsort((after, np.where(up[run], -rest, rest), up[run], symbol[run]))
    u, v = out[:-1], out[1:]
    prefix = np.where(symbol[run[u]] == symbol[run[v]], np.minimum(rest[u], rest[v]), 0)
    same = np.flatnonzero((prefix > 0) & (rest[u] == rest[v]) & (up[run[u]] == up[run[v]]) & (after[u] >= 0))
    prefix[same] += least_between(shared, after[u[same]] + 1, after[v[same]])
    found, prefixes = files.zeros(n), files.zeros(n)
    found[:], prefixes[1:] = out, np.minimum(prefix, cap)
    return found, prefixes


def _sorted(t: np.ndarray, k: int, cap: int, files: Files) -> tuple[np.ndarray, np.ndarray]:
    if k > BYTES:
        ends = np.append(np.flatnonzero(t[:-1] != t[1:]), len(t) - 1)
        if len(ends) < len(t) * RUNS:
            return _by_runs(t, ends, cap, files)
    text = Text(t, k, files)
    lms = np.flatnonzero(text.is_s[1:] & ~text.is_s[:-1]) + 1
    prefixes = np.zeros(len(lms), np.int32)
    if len(lms) > 1:
        length = np.concatenate([np.diff(lms) + 1, [text.n - lms[-1] + 1]])
        cap = max(cap, int(length.max()) + 1)
        lms, prefixes = _lms_order(text, lms, length, cap)
    low, high = induce(text, lms, prefixes, cap)
    # L suffixes of a symbol stand before its S suffixes
    n_low, n_high = len(low), len(high)
    order, prefix = files.zeros(n_low + n_high), files.zeros(n_low + n_high)
    first_low, first_high = t[low[:, 0]], t[high[::-1, 0]]
    at_low = np.arange(n_low) + np.searchsorted(first_high, first_low, side="left")
    at_high = np.arange(n_high) + np.searchsorted(first_low, first_high, side="right")
    order[at_low], order[at_high] = low[:, 0], high[::-1, 0]
    prefix[at_low] = low[:, 1]
    if n_high:
        prefix[at_high[1:]] = high[:0:-1, 1]
        seam = at_high[np.concatenate([[True], first_high[1:] != first_high[:-1]])]
        prefix[seam] = 0
        seam = seam[seam > 0]
        a, b = order[seam - 1].astype(np.int64), order[seam].astype(np.int64)
        same = t[a] == t[b]
        prefix[seam[same]] = np.minimum(np.minimum(text.run(a[same]), text.run(b[same])), cap)
    return order, prefix


def _lms_order(text: Text, lms: np.ndarray, length: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of their suffixes, and common prefixes of neighbours."""
    t, m = text.t, len(lms)
    # of one symbol the longer run is less, whatever follows: the prefixes of the seeds are those of their runs
    runs = text.run(lms)
    seeds = np.lexsort((-runs, t[lms]))
    ties = np.concatenate([[0], np.where(t[lms[seeds[1:]]] == t[lms[seeds[:-1]]], np.minimum(runs[seeds[1:]], cap), 0)])
    _, high = induce(text, lms[seeds], ties, cap)
    number = text.files.zeros(text.n)
    number[lms] = np.arange(1, m + 1)
    own = np.flatnonzero(number[high[:, 0]])
    order = number[high[own, 0]][::-1].astype(np.int64) - 1
    # what neighbours among the LMS suffixes share is the least of what lies between them
    between = np.minimum.reduceat(high[: own[-1] + 1, 1], own[:-1] + 1)[::-1]
    shared = np.concatenate([[0], between]).astype(np.int32)
    equal = (length[order[1:]] == length[order[:-1]]) & (shared[1:] >= length[order[1:]])
    names = np.concatenate([[0], np.cumsum(~equal)])
    if names[-1] == m - 1:
        return lms[order], shared
    name, rank = text.files.zeros(m), text.files.zeros(m)
    name[order], rank[order] = names, np.arange(m)
    del high, number
    # a name that occurs once ends any comparison: what follows it is left out, up to the next name that occurs again
    often = np.bincount(names)[name] > 1
    kept = np.flatnonzero(often | np.concatenate([[False], often[:-1]]))
    used = np.zeros(int(names[-1]) + 1, bool)
    used[name[kept]] = True
    dense = np.cumsum(used) - 1
    by_name, in_names = _sorted(dense[name[kept]].astype(np.int32), int(dense[-1]) + 1, cap, text.files)
    again = often[kept[by_name]]
    # names that occur once have their place already; those of one name follow one another in the order found
    found = kept[by_name[again]]
    common = np.zeros(m, np.int64)
    spot = np.flatnonzero(often[order])
    order[spot] = found
    cut = np.flatnonzero(again)
    common[spot[1:]] = np.minimum.reduceat(in_names[: cut[-1] + 1], cut[:-1] + 1)
    a, b, h = order[:-1], order[1:], common[1:]
    out = np.full(m, cap, np.int64)
    out[0] = 0
    open_ = np.flatnonzero(h < cap)  # the first names that differ decide; the last name is like no other
    x, y = a[open_] + h[open_], b[open_] + h[open_]
    out[open_ + 1] = np.minimum(lms[x] - lms[a[open_]] + least_between(shared, rank[x].astype(np.int64) + 1, rank[y].astype(np.int64)), cap)
    return lms[order], out.astype(np.int32)


def sort_suffixes(t: np.ndarray, cap: int, folder: str | None = None, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes of a byte array in their order, and what each shares with the one before it.

    Common prefixes count up to cap; a longer one may be given as any length from cap on.
    """
    if not len(t):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return _sorted(t, 256, cap, Files(folder, held))
