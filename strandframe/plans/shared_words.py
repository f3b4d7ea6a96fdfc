"""Texts that share many k-mers with texts of a block, counted in memory.

The block's k-mers are indexed once; the other texts pass by in slices.  Of a text
with n distinct k-mers, ``need`` of them shared, any n - need + e hold at least e
shared ones.  So the texts of the block are counted for those k-mers only that are
rarest in the block, and only texts that reach e are counted in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose k-mers are read at once, and letters of a block that are compared at once where k-mers have no number of 62 bits.
SLICE = 1 << 20
#: Numbers of k-mers that are used as they are; larger ones are looked up among those of the block.
_DIRECT, _LARGEST = 1 << 22, 1 << 62
#: Share of the needed k-mers that must be seen before a text is counted in full.
_EARLY = 0.3

#: Place of the text, place in the block, shared k-mers, k-mers of the text.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def slices(texts: pa.Array, letters: int) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of ``texts`` of about ``letters`` letters, with their first place."""
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and how many each has."""
    texts = texts.cast(pa.large_string())
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]) if ends[-1] > ends[0] else b""
    if size.sum() == ends[-1] - ends[0]:
        return np.frombuffer(raw, np.uint8), size
    return np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), size


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; several times as fast as ``np.unique``, which hashes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _windows(size: np.ndarray, k: int) -> np.ndarray:
    """Where the windows of ``k`` letters begin that a text holds whole."""
    inside = np.arange(size.sum()) + k <= np.repeat(np.cumsum(size), size)
    return np.flatnonzero(inside)


def _numbers(digit: np.ndarray, base: int, k: int) -> np.ndarray:
    """The number to ``base`` of the window at every place."""
    last = max(len(digit) - k + 1, 0)
    out = np.zeros(last, np.int64)
    for i in range(k):
        out = out * base + digit[i : last + i]
    return out


class Index:
    """The distinct k-mers of the texts of a block, by text and by k-mer."""

    def __init__(self, texts: pa.Array, k: int):
        self.k, self.texts, self.n = k, texts, len(texts)
        seen = np.zeros(0x110000, bool)
        for _, part in slices(texts, SLICE):
            seen[_points(part)[0]] = True
        letters = np.flatnonzero(seen)
        self.base = len(letters)
        self.digit = np.full(len(seen), -1, np.int32)
        self.digit[letters] = np.arange(self.base)
        self.whole = self.base**k <= _LARGEST
        if self.whole:
            self._fill()

    def _fill(self) -> None:
        self.known = None
        if self.base**self.k > _DIRECT:
            known = [_distinct(self._read(part)[1]) for _, part in slices(self.texts, SLICE)]
            self.known = _distinct(np.concatenate(known)) if known else np.zeros(0, np.int64)
        n_words = self.base**self.k if self.known is None else len(self.known)
        words, sizes, counts = [], [], np.zeros(n_words, np.int64)
        for _, part in slices(self.texts, SLICE):
            text, word = self._read(part)
            if self.known is not None:
                word = np.searchsorted(self.known, word)
            text, word = np.divmod(_distinct(text * n_words + word), max(n_words, 1))
            words.append(word.astype(np.int32))
            sizes.append(np.bincount(text, minlength=len(part)))
            counts += np.bincount(word, minlength=n_words)
        self.word = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        self.count, self.last = counts, np.cumsum(counts)
        # texts of every k-mer, dealt out slice by slice
        self.held, free, first = np.zeros(len(self.word), np.int32), self.last - counts, 0
        for word, size in zip(words, sizes, strict=True):
            order = np.argsort(word, kind="stable")
            word, text = word[order], np.repeat(np.arange(first, first + len(size)), size)[order]
            here = np.bincount(word, minlength=n_words)
            self.held[free[word] + np.arange(len(word)) - (np.cumsum(here) - here)[word]] = text
            free += here
            first += len(size)
        self.mark = np.zeros(n_words, bool)

    def _read(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, size = _points(part)
        at = _windows(size, self.k)
        return np.repeat(np.arange(len(part)), size)[at], _numbers(self.digit[points], self.base, self.k)[at]

    def _asked(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Text, number in the block and texts of the block with it, for every distinct k-mer; None where k-mers have no number."""
        points, size = _points(part)
        digit, base = self.digit[points], self.base
        strange = digit < 0
        if strange.any():
            # letters that the block lacks: their k-mers count, and are in no text of the block
            others = np.unique(points[strange])
            base += len(others)
            digit[strange] = self.base + np.searchsorted(others, points[strange])
        if base**self.k > _LARGEST:
            return None
        at = _windows(size, self.k)
        text, number = np.repeat(np.arange(len(part)), size)[at], _numbers(digit, base, self.k)[at]
        kinds = base**self.k
        if kinds * len(part) > _LARGEST:
            kinds, number = np.unique(number, return_inverse=True)
            kinds = len(kinds)
        if base == self.base and self.known is None:
            text, word = np.divmod(_distinct(text * kinds + number), max(kinds, 1))
            return text, word, self.count[word]
        key, one = np.unique(text * kinds + number, return_index=True)
        at = at[one]
        word = _numbers(np.minimum(digit, max(self.base - 1, 0)), self.base, self.k)[at]
        there = np.cumsum(np.concatenate([[0], strange]))
        in_block = there[at + self.k] == there[at]
        if self.known is not None:
            place = np.minimum(np.searchsorted(self.known, word), max(len(self.known) - 1, 0))
            in_block &= self.known[place] == word if len(self.known) else False
            word = place
        word = np.where(in_block, word, 0)
        return key // max(kinds, 1), word, np.where(in_block, self.count[word] if len(self.count) else 0, 0)

    def shared(self, part: pa.Array, min_share: float) -> Found:
        """Pairs of a text of ``part`` and a text of the block that holds ``min_share`` of its distinct k-mers, one at least."""
        asked = self._asked(part) if self.whole else None
        if asked is None:
            return self._jointly(part, min_share)
        text, word, count = asked
        order = np.lexsort((count, text))
        word, count = word[order], count[order]
        bounds = np.searchsorted(text, np.arange(len(part) + 1)).tolist()
        ends = self.last[word] if len(self.last) else count
        starts, ends, none = (ends - count).tolist(), ends.tolist(), np.add.accumulate(np.concatenate([[0], count == 0])).tolist()
        held, found = self.held, []

        def tally(a: int, b: int) -> np.ndarray:
            lists = [held[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)]
            return np.bincount(np.concatenate(lists) if lists else held[:0], minlength=self.n)

        for i in range(len(part)):
            a, b = bounds[i], bounds[i + 1]
            n, first = b - a, a + none[b] - none[a]
            need = max(math.ceil(n * min_share), 1)
            if b - first < need:
                continue
            early = min(max(1, math.ceil(need * _EARLY)), need)
            to = max(first, min(a + n - need + early, b))
            so_far = tally(first, to)
            hit = np.flatnonzero(so_far >= early)
            if not len(hit):
                continue
            sizes = self.bounds[hit + 1] - self.bounds[hit]
            if to == b:
                shared = so_far[hit]
            elif sizes.sum() > count[to:b].sum():
                shared = (so_far + tally(to, b))[hit]
            else:
                mine = word[first:b]
                self.mark[mine] = True
                own = np.concatenate([self.word[x : x + s] for x, s in zip(self.bounds[hit].tolist(), sizes.tolist(), strict=True)])
                shared = np.add.reduceat(self.mark[own].astype(np.int64), np.cumsum(sizes) - sizes)
                self.mark[mine] = False
            good = shared >= need
            hit = hit[good]
            found.append((np.full(len(hit), i), hit, shared[good], np.full(len(hit), n)))
        return _together(found)

    def _jointly(self, part: pa.Array, min_share: float) -> Found:
        """The same for k-mers of any length and alphabet: numbers are made anew for every two slices."""
        found = []
        for first, own in slices(self.texts, SLICE):
            text, word, n_words = distinct_words([*part.to_pylist(), *own.to_pylist()], self.k)
            at_block = int(np.searchsorted(text, len(part)))
            order = np.argsort(word[at_block:], kind="stable")
            row = text[at_block:][order] - len(part)
            count_of = np.bincount(word[at_block:], minlength=n_words)
            last = np.cumsum(count_of)
            bounds = np.searchsorted(text, np.arange(len(part) + 1))
            for i in range(len(part)):
                mine = word[bounds[i] : bounds[i + 1]]
                count = count_of[mine]
                at = np.repeat(last[mine] - np.cumsum(count), count) + np.arange(count.sum())
                shared = np.bincount(row[at], minlength=len(own))
                hit = np.flatnonzero(shared >= max(math.ceil(len(mine) * min_share), 1))
                found.append((np.full(len(hit), i), first + hit, shared[hit], np.full(len(hit), len(mine))))
        return _together(found)


def _together(found: list[Found]) -> Found:
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *column]) for column in zip(*found, strict=True)) if found else (none,) * 4


def distinct_words(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Text number and word number of the distinct k-mers of every text, by text, and how many words there are."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) for p in points])
    letters, letter = np.unique(np.concatenate(points), return_inverse=True)
    word, top = letter.astype(np.int64), len(letters)
    for i in range(1, k):
        if top > (1 << 62) // len(letters):
            seen, word = np.unique(word, return_inverse=True)
            top = len(seen)
        word, top = word[:-1] * len(letters) + letter[i:], top * len(letters)
    # a window belongs to a text that holds it whole
    at = _windows(size, k)
    seen, word = np.unique(word[at], return_inverse=True)
    text = np.repeat(np.arange(len(texts)), size)[at]
    text, word = np.divmod(np.unique(text * len(seen) + word), max(len(seen), 1))
    return text, word, len(seen)


def some_words(texts: pa.Array, k: int, one_in: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the distinct k-mers of every text whose hash is in one of ``one_in`` parts."""
    points, size = _points(texts)
    at = _windows(size, k)
    last = max(len(points) - k + 1, 0)
    mixed = np.zeros(last, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + points[i : last + i]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32)))[at]
    kept = mixed % np.uint64(one_in) == 0
    text, mixed = np.repeat(np.arange(len(texts)), size)[at][kept], mixed[kept].view(np.int64)
    order = np.lexsort((mixed, text))
    text, mixed = text[order], mixed[order]
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (mixed[1:] != mixed[:-1])]) if len(text) else np.zeros(0, bool)
    return text[first], mixed[first]
