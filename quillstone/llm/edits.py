"""Edit distances of many pairs of texts at once: bits of columns, all pairs and all their words in one step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernels import U, _tables, mix

#: Words of 64 characters of all pairs that are looked at together; up to FEW take about as long as none. Steps between looks at which pairs are decided.
TOGETHER, FEW, STEPS = 1 << 13, 1 << 11, 32
#: Characters that are compared at once where texts begin or end alike.
STRIDE = 32
#: Classes of characters that are counted, counts that are compared at once, and characters that are counted or hashed at once.
CLASSES, COUNTED, HASHED = 64, 1 << 18, 1 << 19
_ONE, _TOP = U(1), U(63)


class Texts:
    """Texts as codes, one after another."""

    def __init__(self, texts: list[str]) -> None:
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.counts: np.ndarray | None = None
        self.words: tuple[np.ndarray, ...] | None = None

    def _alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many codes from a[k] and b[k] on are the same, most[k] at most; backwards if way is -1."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        last = len(self.code) - 1
        while len(live):
            spot = out[live, None] + np.arange(STRIDE)
            x, y = (self.code[np.clip(c[live, None] + way * spot, 0, last)] for c in (a, b))
            same = (x == y) & (spot < most[live, None])
            run = np.where(same.all(1), STRIDE, same.argmin(1))
            out[live] += run
            live = live[run == STRIDE]
        return out

    def _some(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end text, their codes, their sizes), whole texts of about HASHED codes each."""
        ends, lo = self.at + self.size, 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, self.at[lo] + HASHED, "right")))
            yield lo, hi, self.code[self.at[lo] : ends[hi - 1]], self.size[lo:hi]
            lo = hi

    def _unlike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least so many characters of the longer of texts i[k] and j[k] are none of the other's, each counted as often as it is there: no more than their distance."""
        if self.counts is None:
            self.counts = np.zeros((len(self.size), CLASSES), np.int16 if self.size.max(initial=0) < 1 << 15 else np.int64)
            for lo, hi, code, size in self._some():
                self.counts[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo) * CLASSES, size) + code % CLASSES, minlength=(hi - lo) * CLASSES).reshape(-1, CLASSES)
        out = np.zeros(len(i), np.int64)
        step = COUNTED // CLASSES
        for k in range(0, len(i), step):
            x, y = self.counts[i[k : k + step]], self.counts[j[k : k + step]]
            out[k : k + step] = np.abs(x - y).sum(1, dtype=np.int64)
        return (out + np.abs(self.size[i] - self.size[j])) // 2

    def _split(self) -> tuple[np.ndarray, ...]:
        """(hashes of the words of all texts, their sizes, where each text's words start, sums of sizes with a space each)."""
        if self.words is None:
            words, sizes, many = [], [], []
            for lo, hi, some, chars in self._some():
                code = np.full(len(some) + hi - lo, 32, U)
                code[np.arange(len(some)) + np.repeat(np.arange(hi - lo), chars)] = some
                stop = np.flatnonzero(code == 32)
                start = np.concatenate([[0], stop[:-1] + 1])
                up, down = _tables(len(code) + 1)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(code) * up[: len(code)])])
                words.append(mix((sums[stop] - sums[start]) * down[start]))
                sizes.append(stop - start)
                many.append(np.diff(np.searchsorted(stop, np.concatenate([[0], np.cumsum(chars + 1)]))))
            size = np.concatenate(sizes)
            self.words = np.concatenate(words), size, np.concatenate([[0], np.cumsum(np.concatenate(many))]), np.concatenate([[0], np.cumsum(size + 1)])
        return self.words

    def _typed(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether texts i[k] and j[k] become alike within limit[k] if words that differ are typed anew, left out or put in, as the next words suggest; if not, nothing is known."""
        word, size, first, sums = self._split()
        out, who, left = np.zeros(len(i), bool), np.arange(len(i)), limit.astype(np.float64)
        p, q, p_end, q_end = first[i], first[j], first[i + 1], first[j + 1]
        last = len(word) - 1
        while len(who):
            ended = (p == p_end) | (q == q_end)
            if ended.any():
                rest = sums[p_end] - sums[p] + sums[q_end] - sums[q]
                out[who[ended & (rest <= left)]] = True
                who, left, p, q, p_end, q_end = (c[~ended] for c in (who, left, p, q, p_end, q_end))
            x, y = np.minimum(p + 1, last), np.minimum(q + 1, last)
            differ = word[p] != word[q]
            both = ~differ | (word[x] == word[y]) & (x < p_end) & (y < q_end)
            less = ~both & (word[x] == word[q]) & (x < p_end)
            more = ~both & ~less & (word[p] == word[y]) & (y < q_end)
            left -= differ * np.where(less, size[p] + 1, np.where(more, size[q] + 1, np.maximum(size[p], size[q])))
            p, q = p + ~more, q + ~less
            if (on := left >= 0).sum() < 0.75 * len(who):
                who, left, p, q, p_end, q_end = (c[on] for c in (who, left, p, q, p_end, q_end))
        return out

    def within(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether texts i[k] and j[k] have an edit distance of at most limit[k]."""
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = self.size[j] <= limit
        some = np.flatnonzero(~out & (self.size[j] - self.size[i] <= limit))
        if not len(some):
            return out
        some = some[self._unlike(i[some], j[some]) <= limit[some]]
        out[some] = self._typed(i[some], j[some], limit[some])
        some = some[~out[some]]
        a, b, m, n = self.at[i[some]], self.at[j[some]], self.size[i[some]], self.size[j[some]]
        same = self._alike(a, b, m, 1)
        a, b, m, n = a + same, b + same, m - same, n - same
        same = self._alike(a + m - 1, b + n - 1, m, -1)
        m, n = m - same, n - same
        # the distance of an empty text is the size of the other, here no more than the difference of sizes
        out[some] = n <= limit[some]
        left = np.flatnonzero(~out[some])
        some, a, b, m, n = some[left], a[left], b[left], m[left], n[left]
        order = np.argsort(n, kind="stable")
        some, a, b, m, n = (c[order] for c in (some, a, b, m, n))
        limit = np.floor(limit[some]).astype(np.int64)
        words = (n + 63) // 64
        lo = 0
        while lo < len(some):
            # an eighth longer ones go along, and if there are few pairs, longer ones still
            most = np.searchsorted(n, max(64, n[lo] * 9 // 8), "right") - lo
            cells = np.arange(1, min(len(some) - lo, TOGETHER) + 1) * words[lo : lo + TOGETHER]
            hi = lo + int(max(1, min(most, np.searchsorted(cells, TOGETHER, "right")), np.searchsorted(cells, FEW, "right")))
            k = slice(lo, hi)
            out[some[k]] = self._near(a[k], m[k], b[k], n[k], limit[k], int((m[k].max() + 63) // 64))
            lo = hi
        return out

    def _matches(self, at: np.ndarray, size: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits where each row has each code, flat by row, word and code; known codes; where each row and word starts). Codes count from 1, 0 is in none."""
        spot = np.arange(64 * w)
        inside = spot < size[:, None]
        code = self.code[(at[:, None] + spot)[inside]]
        known, of = np.unique(code, return_inverse=True)
        place = np.zeros((len(at), 64 * w), np.int64)
        place[inside] = of + 1
        slot = np.arange(len(at) * w).reshape(len(at), w) * (len(known) + 1)
        bits = np.zeros(len(at) * w * (len(known) + 1), U)
        place = place.reshape(len(at), w, 64)
        for b in range(64):
            bits[slot + place[:, :, b]] |= _ONE << U(b)
        bits.reshape(-1, len(known) + 1)[:, 0] = 0
        return bits, known, slot

    def _near(self, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, limit: np.ndarray, w: int) -> np.ndarray:
        """As within, for m codes from a on, of up to w words each, against n from b on, not fewer. A word is a step behind the word before it,
        so all words take their step together. Longer texts end together; before its start one takes no part: nothing matches, nothing is carried in.
        Words take steps only while some cell of theirs is within limit of the diagonal; cells beyond count as paths along its edge, never too near."""
        key, first, row = np.unique(a * (int(m.max()) + 1) + m, return_index=True, return_inverse=True)
        bits, known, slot = self._matches(a[first], m[first], w)
        steps, many = int(n.max()), len(m)
        # the last word comes first, as it reads the earliest character; text[s : s + w] is what the words read in step s
        text = np.zeros((w - 1 + steps + w - 1, many), np.int64)
        spot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        code = self.code[np.repeat(b, n) + spot]
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        text[np.repeat(w - 1 + steps - n, n) + spot, np.repeat(np.arange(many), n)] = np.where(known[place] == code, place + 1, 0)
        base = np.ascontiguousarray(slot[row][:, ::-1].T)
        # a distance is counted at the last row, which is in word number last, up to step end; until that word takes part it is not known
        start, top, last = steps - n, (m - 1).astype(U) & _TOP, (m - 1) // 64
        end, cell = steps - 1 + last, (w - 1 - last) * many + np.arange(many)
        even = bool((last == w - 1).all())
        score, who = m.copy(), np.arange(many)
        out = np.zeros(many, bool)
        up, down = np.full((w, many), ~U(0)), np.zeros((w, many), U)
        more, less = np.zeros((w, many), U), np.zeros((w, many), U)
        below = np.full((w, many), U(64))
        hit, x, y, z = (np.empty_like(up) for _ in range(4))
        at = np.empty_like(base)
        early, late = int((start - limit).min()), int((start + limit).max())
        gone, come = 0, 1
        for s in range(steps + w - 1):
            if come < w and s >= max(come, 65 * come + early):
                here = w - 1 - come
                at_edge = below[here + 1] - more[here] + less[here]
                below[here] = at_edge + U(64)
                ends = last == come
                score[ends] = at_edge.view(np.int64)[ends] + m[ends] - 64 * come
                come += 1
            if gone < come - 1 and s > 65 * gone + 63 + late:
                gone += 1
                more[w - 1 - gone], less[w - 1 - gone] = 1, 0
            if not gone:
                more[-1] = start <= s
            r, inner = slice(w - come, w - gone), slice(max(w - come, 1), w - gone)
            carried = slice(inner.start - 1, inner.stop - 1)
            hit_, x_, y_, z_, up_, down_, more_, less_, at_ = (c[r] for c in (hit, x, y, z, up, down, more, less, at))
            np.add(base[r], text[s + r.start : s + r.stop], out=at_)
            np.take(bits, at_, out=hit_, mode="clip")
            np.bitwise_or(hit_, down_, out=x_)
            hit_ |= less_
            np.bitwise_and(hit_, up_, out=y_)
            y_ += up_
            y_ ^= up_
            y_ |= hit_
            # plus in z, minus in y
            np.bitwise_or(y_, up_, out=z_)
            np.invert(z_, out=z_)
            z_ |= down_
            y_ &= up_
            if even and come == w:
                score += ((z[0] >> top) & _ONE).view(np.int64)
                score -= ((y[0] >> top) & _ONE).view(np.int64)
            elif not even:
                step = ((z.ravel()[cell] >> top) & _ONE).view(np.int64) - ((y.ravel()[cell] >> top) & _ONE).view(np.int64)
                score += step * ((s <= end) & (last < come))
            np.left_shift(z_, _ONE, out=hit_)
            hit_ |= more_
            np.left_shift(y_, _ONE, out=up_)
            up_ |= less_
            if w > 1:
                np.right_shift(z[inner], _TOP, out=more[carried])
                np.right_shift(y[inner], _TOP, out=less[carried])
                below[inner] += more[carried]
                below[inner] -= less[carried]
            np.bitwise_and(hit_, x_, out=down_)
            hit_ |= x_
            np.invert(hit_, out=hit_)
            up_ |= hit_
            if s % STEPS == STEPS - 1:
                left = np.maximum(end - s, 0)
                counted = last < come
                yes = counted & (score + left <= limit)
                open_ = ~yes & (~counted | (score - left <= limit))
                if (c := int(open_.sum())) <= 0.75 * len(who):
                    out[who[yes]] = True
                    if not c:
                        return out
                    who, start, top, score, limit, end, last, m = (v[open_] for v in (who, start, top, score, limit, end, last, m))
                    cell = (w - 1 - last) * len(who) + np.arange(len(who))
                    text, base, up, down, more, less, below = (np.ascontiguousarray(v[:, open_]) for v in (text, base, up, down, more, less, below))
                    hit, x, y, z = (np.empty_like(up) for _ in range(4))
                    at = np.empty_like(base)
                    early, late = int((start - limit).min()), int((start + limit).max())
        out[who] = score <= limit
        return out
