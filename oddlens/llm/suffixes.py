"""Suffix sorting by hash comparison, and the windows by which repeated strings find each other."""

from __future__ import annotations

import numpy as np

from oddlens.llm.jaccard import mix64

#: Base of the polynomial hashes, odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
GRAM = 20
#: Bytes that are hashed at a time, so that hashes take no more memory for a long text than for a short one.
SEGMENT = 1 << 16


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i below n, modulo 2^64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def prefix_hashes(buf: np.ndarray, power: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of buf[i:j], times BASE ** i."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=out[1:])
    return out


def big_endian(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the end."""
    out = np.zeros(len(buf), np.uint64)
    for k in range(8):
        out[: len(buf) - k] |= buf[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


class SuffixSorter:
    """Sorts suffixes of buf, each cut to its length, by mergesort. Two suffixes are compared by a binary search for
    their common prefix over prefix hashes, then by the next byte. The result is checked on the bytes: where neighbours
    are not in order, which takes a collision of hashes, the suffixes with the same first eight bytes are sorted again
    as bytes, and no others."""

    def __init__(self, buf: np.ndarray) -> None:
        power, self.inv = powers(len(buf) + 1)
        self.buf, self.p, self.word = buf, prefix_hashes(buf, power), big_endian(buf)

    def _hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.p[at + n] - self.p[at]) * self.inv[at]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, least: int = 0) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, up to most."""
        lo, hi = np.minimum(least, most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self._hash(x, mid) == self._hash(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def _compare(self, x, nx, y, ny, least: int) -> np.ndarray:
        """-1, 0 or 1."""
        most = np.minimum(nx, ny)
        n = self.common(x, y, most, least)
        more = n < most
        last = len(self.buf) - 1
        a, b = self.buf[np.minimum(x + n, last)].astype(np.int16), self.buf[np.minimum(y + n, last)].astype(np.int16)
        return np.where(more, np.sign(a - b), np.sign(nx - ny))

    def sort(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, same): same[i] if the suffix order[i] equals order[i - 1]. Sizes are 8 at least."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, bool)
        # the first eight bytes as a number make the runs; only ties are merged by comparison
        head = self.word[at]
        order = np.argsort(head, kind="stable")
        starts = np.flatnonzero(np.append(True, head[order][1:] != head[order][:-1]))
        count = np.diff(np.append(starts, len(order)))
        base, of = np.repeat(starts, count), np.repeat(count, count)
        width = 1
        while width < count.max():
            here = np.flatnonzero(of > width)
            j, b, n = here - base[here], base[here], of[here]
            run = j // width
            lo = np.minimum((run ^ 1) * width, n)
            begin, end = lo.copy(), np.minimum(lo + width, n)
            mine, right = order[here], run % 2 == 1
            while (lo < end).any():
                mid = (lo + end) // 2
                other = order[b + np.minimum(mid, n - 1)]
                c = self._compare(at[other], size[other], at[mine], size[mine], 8)
                go = (lo < end) & ((c < 0) | (c == 0) & right)
                stay = (lo < end) & ~go
                lo, end = np.where(go, mid + 1, lo), np.where(stay, mid, end)
            order[b + run // 2 * 2 * width + j - run * width + lo - begin] = mine
            width *= 2
        sign = self._signs(at, size, order)
        wrong = np.flatnonzero(sign > 0)
        for g in np.unique(np.searchsorted(starts, wrong, side="right") - 1).tolist():
            part = slice(starts[g], starts[g] + count[g])
            order[part] = sorted(order[part].tolist(), key=lambda i: self.buf[at[i] : at[i] + size[i]].tobytes())
        if len(wrong):
            sign = self._signs(at, size, order)
        return order, np.append(False, sign == 0)

    def _signs(self, at, size, order) -> np.ndarray:
        """How each suffix compares with the next in order, by their bytes."""
        x, y, nx, ny = at[order[:-1]], at[order[1:]], size[order[:-1]], size[order[1:]]
        sign, open_ = np.sign(nx - ny), np.arange(len(x))
        last = len(self.buf) - 1
        for k in range(0, int(size.max()), 8):
            a, b = (self.word[np.minimum(s[open_] + k, last)] & _mask(n[open_] - k) for s, n in ((x, nx), (y, ny)))
            differ = a != b
            sign[open_[differ]] = np.where(a[differ] < b[differ], -1, 1)
            open_ = open_[~differ & (np.minimum(nx[open_], ny[open_]) > k + 8)]
            if not len(open_):
                break
        return sign


def _mask(n: np.ndarray) -> np.ndarray:
    """Numbers whose n highest bytes are set."""
    n = np.clip(n, 0, 8).astype(np.uint64)
    return np.where(n == 0, np.uint64(0), ~np.uint64(0) << ((np.uint64(8) - n) * np.uint64(8) & np.uint64(63)))


def units(buf: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, gram, key) of the runs of window starts that choose the same gram.

    Every window of `width` bytes that lies in one document (ends: where each ends) chooses the gram of GRAM bytes with
    the least hash in it, the first on ties. Equal windows choose equal grams at equal places, so windows can only be
    equal if the keys of their runs, hashes of the grams, are. gram is where the chosen one starts.
    """
    n, span = len(buf), width - GRAM + 1
    if n < width:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    valid = np.zeros(n - width + 1, bool)
    lo = 0
    for hi in ends.tolist():
        if hi - width >= lo:
            valid[lo : hi - width + 1] = True
        lo = hi
    first, last, chosen, keys = [], [], [], []
    power, inv = powers(min(SEGMENT, n) + width)
    for s in range(0, n - width + 1, SEGMENT):
        part = buf[s : s + SEGMENT + width - 1]
        p = prefix_hashes(part, power)
        h = mix64((p[GRAM:] - p[:-GRAM]) * inv[: len(part) - GRAM + 1])
        v = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        if step < span:
            v = np.minimum(v[: len(v) - (span - step)], v[span - step :])
        at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = valid[s : s + len(at)]
        edge = np.append(True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]))
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], len(at)) - 1
        use = ok[begin]
        begin, stop = begin[use], stop[use]
        first.append(begin + s)
        last.append(stop + s)
        chosen.append(at[begin] + s)
        keys.append(h[at[begin]])
    a, b, c, k = (np.concatenate(x) for x in (first, last, chosen, keys))
    # a run may go on in the next segment
    cut = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (a[1:] != b[:-1] + 1))) if len(a) else np.empty(0, np.int64)
    return a[cut], b[np.append(cut[1:], len(a)) - 1] if len(a) else b, c[cut], k[cut]


def string_hashes(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the strings buf[at : at + size]; at ascends."""
    out = np.empty(len(at), np.uint64)
    if not len(at):
        return out
    longest = int(size.max())
    power, inv = powers(min(SEGMENT, len(buf)) + longest + 1)
    edge = np.searchsorted(at, np.arange(0, len(buf) + SEGMENT, SEGMENT))
    for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if lo < hi:
            p = prefix_hashes(buf[k * SEGMENT : (k + 1) * SEGMENT + longest], power)
            a, n = at[lo:hi] - k * SEGMENT, size[lo:hi]
            out[lo:hi] = mix64((p[a + n] - p[a]) * inv[a] ^ mix64(n.astype(np.uint64)))
    return out


def distinct(buf: np.ndarray, at: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, heads): which of the distinct strings each one is, and one place of each. Strings with one hash are
    compared byte by byte, and those that differ are told apart by their bytes."""
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e
    _, heads, group = np.unique(hashes, return_index=True, return_inverse=True)
    mine = np.flatnonzero(heads[group] != np.arange(len(at)))
    x, y, n, m = at[mine], at[heads[group[mine]]], size[mine], size[heads[group[mine]]]
    differ = n != m
    for k in range(int(n.max()) if len(n) else 0):
        here = np.flatnonzero((k < n) & ~differ)
        differ[here] = buf[x[here] + k] != buf[y[here] + k]
    if differ.any():
        odd = np.flatnonzero(np.isin(group, group[mine[differ]]))
        seen: dict[bytes, int] = {}
        for i in odd.tolist():
            text = buf[at[i] : at[i] + size[i]].tobytes()
            if text not in seen:
                seen[text] = len(heads)
                heads = np.append(heads, i)
            group[i] = seen[text]
        used, group = np.unique(group, return_inverse=True)
        heads = heads[used]
    return group, heads
