"""Affine-gap pairwise alignment with the aligned texts (Gotoh 1982; Myers and Miller 1988).

Pairs whose second texts are about as long run through the recursion together, a row
of all their cells at a time, and keep one byte of direction per cell.  A pair whose cells
exceed the byte budget is divided: a forward and a backward pass in linear space
find where an optimal path crosses the middle row, and the halves are aligned alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of direction cells that one task keeps at once.
CELLS = 1 << 25
#: Letters, or share of its shortest, by which the texts b of one group may differ in length.
BAND, BAND_SHARE = 32, 8
#: Cells of one row of a group, so that its rows stay in the cache.
ROW = 1 << 16
#: Cells of a row whose running maximum is taken one by one.
SMALL = 1 << 13
LOW, EPS = -1e18, 1e-9
STOP, DIAGONAL, ACROSS, DOWN = 0, 1, 2, 3
#: Bits of a direction: the gap of this cell goes on from its neighbour's gap.
ACROSS_ON, DOWN_ON = 4, 8
#: Direction of the first cell of all, where every path ends.
CORNER = 16
SCHEMA = "score double, a_start int, a_end int, b_start int, b_end int, aligned_a string, aligned_b string, matches int, columns int, identity_pct double"


def _walk() -> tuple[np.ndarray, ...]:
    """Step and 32 times the state after it, by 32 times the state before plus the direction; rows and columns that a step goes back."""
    before, way = np.divmod(np.arange(4 * 32), 32)
    step = np.where(way & CORNER, STOP, np.where(before == STOP, way & 3, before))
    on = np.where(step == ACROSS, way & ACROSS_ON, np.where(step == DOWN, way & DOWN_ON, 0)) > 0
    kinds = np.arange(4)
    return step.astype(np.uint8), np.where(on, step * 32, 0), ((kinds == DIAGONAL) | (kinds == DOWN)).astype(int), ((kinds == DIAGONAL) | (kinds == ACROSS)).astype(int)


_STEP, _STATE, _DOWNWARD, _ONWARD = _walk()


@dataclass(frozen=True)
class Scores:
    """Match, mismatch and gap scores; a ``matrix`` of letter pairs replaces the first two."""

    match: float = 2
    mismatch: float = -1
    open_gap: float = -5
    extend_gap: float = -2
    matrix: dict[tuple[str, str], float] | None = None

    def __post_init__(self):
        if self.open_gap > self.extend_gap or self.extend_gap > 0:
            raise ValueError("gap scores must satisfy open_gap <= extend_gap <= 0")

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.matrix:
            return points
        letters = self._letters()
        at = np.searchsorted(letters, points).clip(max=len(letters) - 1)
        return np.where(letters[at] == points, at + 1, 0).astype(np.uint32)

    def _letters(self) -> np.ndarray:
        return np.array(sorted({ord(x) for pair in self.matrix for x in pair}), np.uint32)

    def table(self) -> np.ndarray | None:
        """Scores by code; code 0 is any letter that the matrix does not know."""
        if not self.matrix:
            return None
        place = {int(c): k + 1 for k, c in enumerate(self._letters())}
        out = np.full((len(place) + 1, len(place) + 1), float(self.mismatch))
        for (x, y), v in self.matrix.items():
            out[place[ord(x)], place[ord(y)]] = out[place[ord(y)], place[ord(x)]] = v
        return out

    def of(self, x: np.ndarray, y: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        return np.where(x == y, float(self.match), float(self.mismatch)) if table is None else table[x, y]


class Aligner:
    """Alignment of code arrays under fixed scores."""

    def __init__(self, scores: Scores, local: bool, cells: int = CELLS):
        self.s, self.local, self.cells = scores, local, cells
        self.table = scores.table()
        self.onset = float(scores.open_gap - scores.extend_gap)  # what a gap costs besides its letters

    def _first(self, m: int, local: bool, top: float) -> tuple[np.ndarray, np.ndarray]:
        """Row 0: best scores and scores of a gap downward, which starts at ``top``."""
        h = np.zeros(m + 1) if local else self.onset + self.s.extend_gap * np.arange(m + 1.0)
        h[0] = 0.0
        down = np.full(m + 1, LOW)
        down[0] = top
        return h, down

    def _row(self, h: np.ndarray, down: np.ndarray, step: np.ndarray, local: bool) -> tuple[np.ndarray, ...]:
        """Next row: best, gap downward, gap across, diagonal."""
        s = self.s
        down = np.maximum(h + s.open_gap, down + s.extend_gap)
        diagonal = np.full_like(h, LOW)
        diagonal[..., 1:] = h[..., :-1] + step
        best = np.maximum(diagonal, down)
        if local:
            best = np.maximum(best, 0.0)
        run = s.extend_gap * np.arange(h.shape[-1])
        across = np.full_like(h, LOW)
        across[..., 1:] = np.maximum.accumulate(best - run, axis=-1)[..., :-1] + self.onset + run[1:]
        return np.maximum(best, across), down, across, diagonal

    def _numbers(self, n: int, m: int, top: float, bottom: float) -> tuple[type, float, float, float]:
        """Type of the cells of texts up to ``n`` and ``m`` letters, a score below all, that of a letter beyond a text's end, and the tolerance of ties.

        Whole scores are exact in the smallest integers that hold every path.
        """
        s = self.s
        steps = [s.mismatch, s.extend_gap, *([s.match] if self.table is None else self.table.ravel())]
        gaps = [s.open_gap, self.onset, top, bottom]
        reach = (n + m + 2) * max(abs(v) for v in steps) + 2 * sum(abs(v) for v in gaps) + 1
        if all(float(v).is_integer() for v in steps + gaps) and reach < 1 << 28:
            return np.int16 if reach < 1 << 13 else np.int32, int(-2 * reach), int(-reach), 0
        return np.float64, LOW, -reach, EPS

    def _steps(self, x: np.ndarray, y: np.ndarray, m_of: np.ndarray, kind: type, beyond: float) -> Callable[[int, int], np.ndarray]:
        """Scores of letter ``i`` of the first ``k`` texts x against their whole y: kept for every letter where those are few."""
        outside = np.arange(y.shape[1]) >= m_of[:, None]
        letters, at = np.unique(x, return_inverse=True)
        at, each = at.reshape(x.shape).T.copy(), np.arange(len(x))

        def scored(codes: np.ndarray, k: int) -> np.ndarray:
            found = self.s.of(codes, y[:k], self.table).astype(kind)
            found[outside[:k]] = beyond
            return found

        if len(letters) * y.size > self.cells // 4:
            return lambda i, k: scored(x[:k, i : i + 1], k)
        kept = np.array([scored(c, len(x)) for c in letters], kind).reshape(len(letters), *y.shape)
        return lambda i, k: kept[at[i, :k], each[:k]]

    def batch(self, xs: list[np.ndarray], ys: list[np.ndarray], top: float | None = None, bottom: float | None = None) -> list[tuple]:
        """score, start and end in x, start and end in y, and steps of every pair, by one recursion.

        ``top`` and ``bottom`` replace the cost of starting a gap downward in the
        first row and of one that ends in the last (the halves of a divided pair).
        Pairs run by falling length of x, so that those which ended take no more work.
        """
        top, bottom = (self.onset if v is None else v for v in (top, bottom))
        order = sorted(range(len(xs)), key=lambda k: -len(xs[k]))
        xs, ys = [xs[k] for k in order], [ys[k] for k in order]
        count, n_of, m_of = len(xs), np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        n, m = int(n_of[0]), int(m_of.max())
        x, y = np.zeros((count, n), np.uint32), np.zeros((count, m), np.uint32)
        for k in range(count):
            x[k, : n_of[k]], y[k, : m_of[k]] = xs[k], ys[k]
        kind, low, beyond, eps = self._numbers(n, m, top, bottom)
        steps = self._steps(x, y, m_of, kind, beyond)
        going, ext = np.searchsorted(-n_of, -np.arange(n + 1), side="right"), kind(self.s.extend_gap)
        open_gap, run = kind(self.s.open_gap), (self.s.extend_gap * np.arange(m + 1)).astype(kind)
        rise = kind(self.onset) + run[1:]
        # the directions of row i are those of its ``going[i]`` pairs
        starts = np.append(0, np.cumsum(going * (m + 1)))
        ways = np.empty(int(starts[-1]), np.uint8)
        first = self._first(m, self.local, top)
        first[1][1:] = low
        h, down = (np.tile(v.astype(kind), (count, 1)) for v in first)
        way = ways[: starts[1]].reshape(count, m + 1)
        way[:] = STOP
        if not self.local:
            way[:, 1:] = ACROSS
            way[:, 2:] |= ACROSS_ON
        onward = h + open_gap
        diagonal, across, scan, spare = (np.full((count, m + 1), low, kind) for _ in range(4))
        flags = [np.empty((count, m + 1), bool) for _ in range(2)]
        score, end_i, end_j, each = np.zeros(count, kind), np.zeros(count, int), np.zeros(count, int), np.arange(count)
        ends_down = np.zeros(count, bool)
        for i in range(n + 1):
            k = int(going[i])
            if i:
                h, down, onward, diagonal, across, scan, spare = (v[:k] for v in (h, down, onward, diagonal, across, scan, spare))
                one, two = (v[:k] for v in flags)
                way = ways[starts[i] : starts[i + 1]].reshape(k, m + 1)
                down += ext
                np.greater(down, onward + eps if eps else onward, out=one)
                np.left_shift(one.view(np.uint8), 3, out=way)
                np.maximum(down, onward, out=down)
                np.add(h[:, :-1], steps(i - 1, k), out=diagonal[:, 1:])
                np.maximum(diagonal, down, out=h)
                if self.local:
                    np.maximum(h, kind(0), out=h)
                # the best start of a gap across so far; in large rows the maximum over 2, 4, 8 ... cells, which is faster
                np.subtract(h, run, out=scan)
                far = 1 if h.size > SMALL else m
                if far == m:
                    np.maximum.accumulate(scan, axis=1, out=scan)
                while far < m:
                    np.maximum(scan[:, far:], scan[:, :-far], out=spare[:, far:])
                    spare[:, :far] = scan[:, :far]
                    scan, spare, far = spare, scan, 2 * far
                np.add(scan[:, :-1], rise, out=across[:, 1:])
                np.maximum(h, across, out=h)
                np.add(h, open_gap, out=onward)
                np.greater(across[:, 1:], onward[:, :-1] + eps if eps else onward[:, :-1], out=one[:, 1:])
                one[:, 0] = False
                way |= one.view(np.uint8) << 2
                # diagonal first, then across, then down: 1, 2, 3
                tie = h - eps if eps else h
                np.greater_equal(diagonal, tie, out=one)
                np.greater_equal(across, tie, out=two)
                two |= one
                plain = np.subtract(np.uint8(DOWN), one.view(np.uint8))
                plain -= two.view(np.uint8)
                if self.local:
                    np.greater(h, kind(eps), out=one)
                    plain *= one.view(np.uint8)
                way |= plain
            if self.local:
                # cells beyond a text's end are below one inside that comes before them
                j = h.argmax(axis=1)
                seen = h[each[:k], j]
                better = np.flatnonzero(seen > score[:k] + kind(eps))
                score[better], end_i[better], end_j[better] = seen[better], i, j[better]
            else:
                done = slice(int(going[i + 1]) if i < n else 0, k)
                if done.start < k:
                    end_i[done], end_j[done] = i, m_of[done]
                    plain, gap = h[each[done], m_of[done]], down[each[done], m_of[done]] - kind(self.onset) + kind(bottom)
                    if i:
                        gap = np.where(m_of[done] == 0, kind(max(top, bottom) + i * self.s.extend_gap), gap)
                        ends_down[done] = gap > plain + kind(eps)
                    score[done] = np.where(ends_down[done], gap, plain)
        found = self._trace(ways, starts, m + 1, score, end_i, end_j, ends_down)
        return [found[k] for k in np.argsort(order)]

    @staticmethod
    def _trace(ways: np.ndarray, starts: np.ndarray, wide: int, score: np.ndarray, end_i: np.ndarray, end_j: np.ndarray, ends_down: np.ndarray) -> list[tuple]:
        """Walk all pairs back at once: diagonal first, then a gap across, then one downward."""
        i, j, each = end_i.copy(), end_j.copy(), np.arange(len(end_i))
        state, home = np.where(ends_down, DOWN * 32, 0), each * wide
        ways[starts[0] + home] = CORNER
        steps = []
        while True:
            at = ways[starts[i] + home + j] + state
            step = _STEP[at]
            if not step.any():
                break
            steps.append(step)
            state = _STATE[at]
            # a finished pair stays where it is
            i -= _DOWNWARD[step]
            j -= _ONWARD[step]
        walked = np.array(steps, np.uint8).reshape(len(steps), len(each))[::-1].T.copy()
        return [(float(score[k]), int(i[k]), int(end_i[k]), int(j[k]), int(end_j[k]), walked[k][walked[k] > 0]) for k in each]

    def _last_row(self, x: np.ndarray, y: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        """Best scores of x against every prefix of y, and those that end in a gap downward."""
        h, down = self._first(len(y), False, top)
        for c in x:
            h, down, *_ = self._row(h, down, self.s.of(c, y, self.table), False)
        return h, down

    def _divided(self, x: np.ndarray, y: np.ndarray, top: float, bottom: float) -> np.ndarray:
        """Steps of an optimal global path in linear space."""
        if (len(x) + 1) * (len(y) + 1) <= self.cells or len(x) < 2:
            if len(x) and (len(x) + 1) * (len(y) + 1) > self.cells:
                return self._one_row(x, y, top, bottom)
            whole = Aligner(self.s, False, self.cells) if self.local else self
            return whole.batch([x], [y], top, bottom)[0][5]
        mid = len(x) // 2
        h, down = self._last_row(x[:mid], y, top)
        back, up = self._last_row(x[mid:][::-1], y[::-1], bottom)
        plain, through = h + back[::-1], down + up[::-1] - self.onset
        j, k = int(plain.argmax()), int(through.argmax())
        if plain[j] >= through[k] - EPS:
            return np.concatenate([self._divided(x[:mid], y[:j], top, self.onset), self._divided(x[mid:], y[j:], self.onset, bottom)])
        # a gap downward crosses the middle: its two letters there are taken here
        gap = np.full(2, DOWN, np.uint8)
        return np.concatenate([self._divided(x[: mid - 1], y[:k], top, 0.0), gap, self._divided(x[mid + 1 :], y[k:], 0.0, bottom)])

    def _one_row(self, x: np.ndarray, y: np.ndarray, top: float, bottom: float) -> np.ndarray:
        """Steps of one letter against a text beyond the budget: paired with its best letter, or in a gap."""
        m, ext = len(y), self.s.extend_gap
        gap = lambda k: np.where(k > 0, self.onset + k * ext, 0.0)
        at = np.arange(m)
        paired = gap(at) + self.s.of(x[0], y, self.table) + gap(m - 1 - at)
        alone = max(top, bottom) + ext + float(gap(np.array(m)))
        k = int(paired.argmax())
        across = np.full(m, ACROSS, np.uint8)
        if paired[k] >= alone - EPS:
            across[k] = DIAGONAL
            return across
        down = np.array([DOWN], np.uint8)
        return np.concatenate([down, across] if top >= bottom else [across, down])

    def large(self, x: np.ndarray, y: np.ndarray) -> tuple:
        """One pair beyond the cell budget; of several optimal paths any may be taken."""
        if not self.local:
            steps = self._divided(x, y, self.onset, self.onset)
            return self._scored(x, y, 0, 0, steps)
        score, i, j = self._peak(x, y, True)
        if score <= EPS:
            return 0.0, 0, 0, 0, 0, np.empty(0, np.uint8)
        _, back_i, back_j = self._peak(x[:i][::-1], y[:j][::-1], False)
        i0, j0 = i - back_i, j - back_j
        return self._scored(x[i0:i], y[j0:j], i0, j0, self._divided(x[i0:i], y[j0:j], self.onset, self.onset))

    def _peak(self, x: np.ndarray, y: np.ndarray, local: bool) -> tuple[float, int, int]:
        """Largest score and its first cell; not ``local``: of paths that start at the corner."""
        h, down = self._first(len(y), local, self.onset)
        best = (0.0, 0, 0)
        for i, c in enumerate(x, start=1):
            h, down, *_ = self._row(h, down, self.s.of(c, y, self.table), local)
            j = int(h.argmax())
            if h[j] > best[0] + EPS:
                best = (float(h[j]), i, j)
        return best

    def _scored(self, x: np.ndarray, y: np.ndarray, i0: int, j0: int, steps: np.ndarray) -> tuple:
        """A path with the score that its steps add up to."""
        pairs = steps == DIAGONAL
        i, j = np.cumsum(steps != ACROSS) - 1, np.cumsum(steps != DOWN) - 1
        total = float(self.s.of(x[i[pairs]], y[j[pairs]], self.table).sum())
        for kind in (ACROSS, DOWN):
            gap = steps == kind
            starts = gap & ~np.append(False, gap[:-1])
            total += float(gap.sum()) * self.s.extend_gap + float(starts.sum()) * self.onset
        return total, i0, i0 + len(x), j0, j0 + len(y), steps


def _texts(a: str, b: str, found: tuple) -> tuple:
    """Result row of a path: aligned texts, equal letters, columns, identity over the shorter text."""
    score, i0, i1, j0, j1, steps = found
    sides = []
    for text, start, skip in ((a, i0, ACROSS), (b, j0, DOWN)):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        line = np.full(len(steps), ord("-"), np.uint32)
        taken = steps != skip
        line[taken] = points[start : start + int(taken.sum())]
        sides.append(line)
    matches = int(((sides[0] == sides[1]) & (steps == DIAGONAL)).sum())
    short = min(len(a), len(b))
    lines = [line.tobytes().decode("utf-32-le", "surrogatepass") for line in sides]
    return score, i0, i1, j0, j1, *lines, matches, len(steps), 100 * matches / short if short else None


def groups(sizes: list[tuple[int, int, int]], cells: int) -> Iterator[list[int]]:
    """Pairs ``(key, letters of a, letters of b)`` dealt into groups that run together, by their keys.

    Texts b of a group are about as long, so that few cells lie beyond their ends;
    texts a need not be, for a pair that ends takes no more work.
    """
    by_m = sorted(sizes, key=lambda v: v[2])
    at = 0
    while at < len(by_m):
        shortest = by_m[at][2]
        end = at
        while end < len(by_m) and by_m[end][2] <= shortest + max(BAND, shortest // BAND_SHARE):
            end += 1
        group, taken, wide = [], 0, by_m[end - 1][2] + 1
        for key, n, _ in sorted(by_m[at:end], key=lambda v: -v[1]):
            if group and (taken + (n + 1) * wide > cells or (len(group) + 1) * wide > ROW):
                yield group
                group, taken = [], 0
            group.append(key)
            taken += (n + 1) * wide
        yield group
        at = end


def pairwise_align(
    pairs: DataFrame, mode: str = "global", match: float = 2, mismatch: float = -1, open_gap: float = -5, extend_gap: float = -2,
    matrix: dict[tuple[str, str], float] | None = None, cells: int = CELLS,
) -> DataFrame:
    """Best affine-gap alignment of every pair ``(pair_id, a, b)``, as texts.

    ``global`` aligns end to end, ``local`` the best inner part.  Result: score,
    zero-based half-open spans in ``a`` and ``b``, both aligned texts with ``-`` for
    gaps, equal letters, columns, and identity in percent of the shorter whole text
    (null if that is empty).  Of equal scores the path that walks back by pairing
    first, then a gap in ``a``, then one in ``b`` is taken, and the first end in
    ``a`` then ``b`` for local ones; pairs beyond ``cells`` give any optimal path.
    Null texts are empty.  A local score of zero has empty texts and spans at 0.
    """
    if mode not in ("global", "local"):
        raise ValueError("mode must be global or local")
    scores = Scores(match, mismatch, open_gap, extend_gap, matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(scores, mode == "local", cells)
        for batch in batches:
            a, b = (batch[c].fillna("").tolist() for c in "ab")
            size = [((len(s) + 1) * (len(t) + 1), len(s), len(t)) for s, t in zip(a, b, strict=True)]
            rest = []
            for k, (area, n, m) in enumerate(size):
                if area > cells:
                    yield frame(batch, [k], [_texts(a[k], b[k], aligner.large(scores.codes(a[k]), scores.codes(b[k])))])
                else:
                    rest.append((k, n, m))
            for some in groups(rest, cells):
                found = aligner.batch([scores.codes(a[k]) for k in some], [scores.codes(b[k]) for k in some])
                yield frame(batch, some, [_texts(a[k], b[k], f) for k, f in zip(some, found, strict=True)])

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def frame(batch: pd.DataFrame, rows: list[int], found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=names)
        out.insert(0, "pair_id", batch["pair_id"].iloc[rows].to_numpy())
        return out

    kind = dict(pairs.dtypes)["pair_id"]
    return pairs.select("pair_id", "a", "b").mapInPandas(run, f"pair_id {kind}, {SCHEMA}")
