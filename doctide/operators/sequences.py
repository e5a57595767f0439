"""Sequential algorithms that work within one document, page or key: alignment, circuit breaking, box merging.

Each is a grouped job: Spark deals the groups over the cluster and these functions see one at a time.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the table of lengths that a piece of an alignment fills at once; beyond, waves from both ends try to part it.
MOST_CELLS = 1 << 20
#: Cells of a table that is kept whole, a bit each; beyond, the piece is halved by the lengths of both halves.
KEPT_CELLS = 1 << 28
#: Places that waves may reach in a piece whose table costs less.
LEAST_STEPS = 1 << 12
#: Members compared at once when a wave follows equal members.
STRIDE = 32


class Common:
    """A longest common subsequence of two lists, always the same of several: `pairs` of places, `steps`, `stopped`.

    Equal ends are taken off.  What is left is parted where waves of furthest places, one edit more each time, meet from
    both ends, so time goes with what differs and memory with the lists.  Where more differs than a table of lengths costs,
    the table is filled instead, a row of it as the bits of one number.  `steps` counts the places that waves reach, the
    members they pass and the 64-bit words of tables; past `work` of them the search ends, `stopped` says so, and the pairs
    found until then stand.
    """

    def __init__(self, a: list | np.ndarray, b: list | np.ndarray, work: int | None = None, cells: int = MOST_CELLS, kept: int = KEPT_CELLS):
        codes: dict = {}
        self.x, self.y = (side if isinstance(side, np.ndarray) else np.array([codes.setdefault(v, len(codes)) for v in side], np.int64) for side in (a, b))
        self.work, self.steps, self.stopped = work, 0, False
        self.pairs: list[tuple[int, int]] = []
        todo = [(0, len(self.x), 0, len(self.y))]
        while todo and not self.stopped:
            a0, a1, b0, b1 = self._trimmed(*todo.pop())
            if a0 == a1 or b0 == b1:
                continue
            n, m = a1 - a0, b1 - b0
            x, y, cost = self.x[a0:a1], self.y[b0:b1], n * (m // 64 + 1)
            met = self._meeting(x, y, max(cost, LEAST_STEPS)) if n * m > cells else None
            if not met:
                self.stopped |= work is not None and self.steps + cost > work
                if self.stopped:
                    break
                self.steps += cost
                if n * m > kept and n > 1:
                    met = _halves(x, y)
                else:
                    self.pairs += [(a0 + i, b0 + j) for i, j in _by_table(x, y)]
            if met:
                todo += [(a0 + met[0], a1, b0 + met[1], b1), (a0, a0 + met[0], b0, b0 + met[1])]
            self.stopped |= work is not None and self.steps > work
        self.pairs.sort()

    def _trimmed(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
        """Without the equal members at both ends, which are paired."""
        n = min(a1 - a0, b1 - b0)
        front = int(np.argmin(np.append(self.x[a0 : a0 + n] == self.y[b0 : b0 + n], False)))
        n -= front
        back = int(np.argmin(np.append(self.x[a1 - n : a1][::-1] == self.y[b1 - n : b1][::-1], False))) if n else 0
        self.steps += front + back
        self.pairs += [(a0 + i, b0 + i) for i in range(front)] + [(a1 - 1 - i, b1 - 1 - i) for i in range(back)]
        return a0 + front, a1 - back, b0 + front, b1 - back

    def _meeting(self, x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, int] | None:
        """Where a path of fewest edits passes about its middle; None past the work, or past `most` steps of this piece."""
        ahead, behind, until = _Wave(x, y), _Wave(x[::-1], y[::-1]), self.steps + most
        while self.steps <= until:
            for wave, other in ((ahead, behind), (behind, ahead)):
                self.steps += wave.advance()
                if self.work is not None and self.steps > self.work:
                    self.stopped = True
                    return None
                at = wave.meets(other)
                if at is not None:
                    return at if wave is ahead else (len(x) - at[0], len(y) - at[1])
        return None


class _Wave:
    """The furthest place in x on each diagonal (place in x less place in y) that so many edits reach."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        end = np.full(STRIDE, -1, np.int64)
        self.n, self.m, self.edits = len(x), len(y), -1
        self.x, self.y = np.append(x, end), np.append(y, end - 1)
        self.far = np.full(self.n + self.m + 3, -1, np.int64)  # diagonal k at k + m + 1; -1 is not reached
        self.now = np.zeros(0, np.int64)

    def advance(self) -> int:
        self.edits += 1
        d = self.edits
        low, high = max(-d, -self.m + (d + self.m) % 2), min(d, self.n - (d + self.n) % 2)
        k = np.arange(low, high + 1, 2)
        slot = k + self.m + 1
        before, after = self.far[slot - 1], self.far[slot + 1]
        i = np.maximum(np.where(before >= 0, before + 1, -1), after) if d else np.zeros(1, np.int64)
        i[(i > self.n) | (i - k > self.m)] = -1
        steps, going = len(k), np.flatnonzero(i >= 0)
        span = np.arange(STRIDE)
        while len(going):
            at = i[going]
            same = self.x[at[:, None] + span] == self.y[(at - k[going])[:, None] + span]
            run = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
            i[going] += run
            steps += int(run.sum())
            going = going[run == STRIDE]
        self.far[slot] = i
        self.now = k
        return steps

    def meets(self, other: _Wave) -> tuple[int, int] | None:
        """The first place of this wave that the one from the other end has passed."""
        own, theirs = self.far[self.now + self.m + 1], other.far[self.n - self.m - self.now + self.m + 1]
        hit = np.flatnonzero((own >= 0) & (theirs >= 0) & (own + theirs >= self.n))
        if not len(hit):
            return None
        return int(own[hit[0]]), int(own[hit[0]] - self.now[hit[0]])


def longest_common(a: list, b: list, cells: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; see Common."""
    return Common(a, b, cells=cells).pairs


def _rows(x: np.ndarray, y: np.ndarray, keep: bool) -> list[int]:
    """The table of lengths for all suffixes from the last row up, or its first row alone.

    Bit p of row i is 0 where the suffixes of x from i and of y from len(y) - 1 - p have one pair more than without that
    member of y.
    """
    places: dict[int, int] = {}
    for p, v in enumerate(y[::-1].tolist()):
        places[v] = places.get(v, 0) | 1 << p
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in reversed(x.tolist()):
        met = row & places.get(v, 0)
        if met:
            row = (row + met | row - met) & full
        if keep:
            rows.append(row)
    return rows or [row]


def _by_table(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence from the lengths for all suffixes."""
    rows, size = _rows(x, y, True), len(y) // 8 + 1
    x, y = x.tolist(), y.tolist()
    pairs, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        row = rows[len(x) - 1 - i].to_bytes(size, "little")
        while j < len(y) and x[i] != y[j] and row[len(y) - 1 - j >> 3] >> (len(y) - 1 - j & 7) & 1:
            j += 1
        if j < len(y) and x[i] == y[j]:
            pairs.append((i, j))
            j += 1
        i += 1
    return pairs


def _halves(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """The middle of x and the first place in y that part a longest common subsequence, from one row of each half's table."""
    half = len(x) // 2

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.frombuffer(_rows(x, y, False)[0].to_bytes(len(y) // 8 + 1, "little"), np.uint8)
        return np.append(0, np.cumsum(1 - np.unpackbits(row, bitorder="little")[: len(y)].astype(np.int64)))

    before, after = lengths(x[:half][::-1], y[::-1]), lengths(x[half:], y)[::-1]
    return half, int(np.argmax(before + after))


def listed(streams: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, name of each stream...): the rows of each stream of a key, as structs in ascending order of their columns."""
    kinds = {name: s.drop(key).schema for name, s in streams.items()}
    one = lambda name, s: s.select(key, *((F.struct(*s.drop(key).columns) if n == name else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()))
    parts = [one(name, s) for name, s in streams.items()]
    every = functools.reduce(DataFrame.union, parts)
    return every.groupBy(key).agg(*(F.sort_array(F.collect_list(n)).alias(n) for n in kinds))


def common(a: Column, b: Column, work: int | None = None) -> Column:
    """(a, b, stopped): places of the members of two array columns that a longest common subsequence pairs; see Common."""

    @F.arrow_udf("a array<int>, b array<int>, stopped boolean")
    def align(a: pa.Array, b: pa.Array) -> pa.Array:
        codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ends = [np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False))) for side in (a, b)]
        ends[1] += ends[0][-1]
        found, stopped = [], []
        for a0, a1, b0, b1 in zip(ends[0], ends[0][1:], ends[1], ends[1][1:]):
            c = Common(codes[a0:a1], codes[b0:b1], work)
            found.append(np.array(c.pairs, np.int32).reshape(-1, 2))
            stopped.append(c.stopped)
        at = pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32())
        places = np.concatenate(found) if found else np.zeros((0, 2), np.int32)
        sides = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(places[:, k]))) for k in (0, 1)]
        return pa.StructArray.from_arrays([*sides, pa.array(stopped, pa.bool_())], ["a", "b", "stopped"])

    return align(a, b)


def aligned(a: DataFrame, b: DataFrame, key: str, order: str, value: str, work: int | None = None) -> DataFrame:
    """(key, a_pos, b_pos) of the members of two ordered streams that a longest common subsequence pairs, by key.

    With `work`, a bound on the steps of a key, there is `stopped` too: whether it was reached, in each row of the key, and
    in a row without places if no pair was found by then.  Members of one place go by value.
    """
    both = listed({"_a": a.select(key, order, value), "_b": b.select(key, order, value)}, key).where((F.size("_a") > 0) & (F.size("_b") > 0))
    values = lambda side: F.transform(side, lambda x: x[value])
    met = both.select(key, "_a", "_b", common(values("_a"), values("_b"), work).alias("_m"))
    kind = dict(a.dtypes)[order]
    place = lambda side, i: F.get(side, i)[order]
    pairs = F.transform(F.arrays_zip("_m.a", "_m.b"), lambda p: F.struct(place("_a", p["a"]).alias("a_pos"), place("_b", p["b"]).alias("b_pos")))
    if work is None:
        return met.select(key, F.inline(pairs))
    none = F.array(F.struct(F.lit(None).cast(kind).alias("a_pos"), F.lit(None).cast(kind).alias("b_pos")))
    return met.select(key, F.inline(F.when(F.col("_m.stopped") & (F.size("_m.a") == 0), none).otherwise(pairs)), F.col("_m.stopped").alias("stopped"))


class Breaker:
    """Opens when at least `least` of the last `window` outcomes are known and half of them failed; probes once after a rest."""

    def __init__(self, window: int = 50, least: int = 20, share: float = 0.5, rest: int = 300_000):
        self.window, self.least, self.share, self.rest = window, least, share, rest
        self.outcomes: list[bool] = []
        self.until: int | None = None

    def step(self, t: int, failed: bool) -> str:
        """State after an outcome at time t: closed, open, or skipped if none was asked for."""
        if self.until is not None and t < self.until:
            return "skipped"
        probe = self.until is not None
        if probe and failed:
            self.until = t + self.rest
            return "open"
        if probe:
            self.until, self.outcomes = None, []
        self.outcomes = [*self.outcomes, failed][-self.window :]
        if len(self.outcomes) >= self.least and sum(self.outcomes) >= self.share * len(self.outcomes):
            self.until, self.outcomes = t + self.rest, []
            return "open"
        return "closed"


def breaker_states(events: DataFrame, key: str, t: str, order: str, failed: str, **limits) -> DataFrame:
    """(key, order, state): each service's circuit after each of its outcomes, in order of time."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, order])
        breaker = Breaker(**limits)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "state": [breaker.step(int(x), bool(f)) for x, f in zip(pdf[t], pdf[failed], strict=True)]})

    kind = dict(events.dtypes)
    return events.select(key, t, order, failed).groupBy(key).applyInPandas(walk, f"{key} {kind[key]}, {order} {kind[order]}, state string")


def merge_boxes(df: DataFrame, key: str) -> DataFrame:
    """(key, box, n, x0, y0, x1, y1): lines (x0, y0, x1, y1, confidence) joined into boxes, in order from top left.

    Lines of low confidence are left out.  A line joins the first box whose last line is near in height (a gap of at most
    0.6 and an overlap of at most 0.5 line heights), overlaps it sideways, and shares an edge or the middle within 0.75.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes: list[list] = []
        for r in pdf[pdf["confidence"] >= 0.3].sort_values(["y0", "x0", "x1", "y1"]).itertuples():
            for box in boxes:
                last = box[-1]
                high = min(r.y1 - r.y0, last.y1 - last.y0)
                gap = r.y0 - last.y1
                near = -0.5 * high <= gap <= 0.6 * high and r.x0 < last.x1 and last.x0 < r.x1
                edges = (r.x0 - last.x0, r.x1 - last.x1, (r.x0 + r.x1 - last.x0 - last.x1) / 2)
                if near and min(map(abs, edges)) <= 0.75 * high:
                    box.append(r)
                    break
            else:
                boxes.append([r])
        rows = [(pdf[key].iloc[0], i, len(b), min(r.x0 for r in b), min(r.y0 for r in b), max(r.x1 for r in b), max(r.y1 for r in b)) for i, b in enumerate(boxes)]
        return pd.DataFrame(rows, columns=[key, "box", "n", "x0", "y0", "x1", "y1"])

    return df.select(key, "x0", "y0", "x1", "y1", "confidence").groupBy(key).applyInPandas(merge, f"{key} {dict(df.dtypes)[key]}, box long, n long, x0 double, y0 double, x1 double, y1 double")


def cut_lines(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, line): glyphs (y, size) in order cut into lines; the baseline of a line is the mean of what it has so far."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        line, total, n, lines = 0, 0.0, 0, []
        for y, size in zip(pdf["y"], pdf["size"], strict=True):
            if n and abs(y - total / n) >= 0.5 * size:
                line, total, n = line + 1, 0.0, 0
            total, n = total + y, n + 1
            lines.append(line)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "line": lines})

    kind = dict(df.dtypes)
    return df.select(key, order, "y", "size").groupBy(key).applyInPandas(cut, f"{key} {kind[key]}, {order} {kind[order]}, line long")


#: What may end a line in the middle of a word.
HYPHENS = "-\u2010\u00ad"


@F.pandas_udf(T.StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD) without white space."""
    return s.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKD", t).split()))


def hunks(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """(key, hunk, a_n, b_n, class): what stands between neighbouring pairs of an alignment, and at both ends.

    a and b: (key, order, unit, line_end); pairs: (key, a_pos, b_pos).  Keys in neither stream have none.  See hunks_of.
    """
    side = lambda stream, at: stream.join(pairs.select(key, F.col(at).alias(order), F.lit(True).alias("met")), [key, order], "left").select(key, order, "unit", "line_end", "met")
    lists = listed({"a": side(a, "a_pos"), "b": side(b, "b_pos")}, key)
    met = lambda side: F.filter(F.transform(side, lambda x, i: F.when(x["met"], i)), lambda i: i.isNotNull())
    units = lambda side: F.transform(side, lambda x: F.struct(x["unit"].alias("unit"), x["line_end"].alias("line_end")))
    return hunks_of(lists.select(key, units("a").alias("a"), units("b").alias("b"), F.struct(met("a").alias("a"), met("b").alias("b")).alias("met")), key)


def hunks_of(lists: DataFrame, key: str) -> DataFrame:
    """(key, hunk, a_n, b_n, class) of (key, a, b, met): arrays of (unit, line_end), and the places that `common` pairs.

    Both sides of a hunk are spelled out, decomposed and without white space.  hyphen: alike without hyphens that end a
    line; aonly, bonly: the other side is empty; font: alike with them; char: anything else.
    """

    def between(side: str, k: Column) -> Column:
        """What lies from the pair before, if any, to pair k or the end."""
        begin = F.when(k > 0, F.get(f"met.{side}", k - 1) + 1).otherwise(0)
        return F.slice(side, begin + 1, F.coalesce(F.get(f"met.{side}", k), F.size(side)) - begin)

    every = F.transform(F.sequence(F.lit(0), F.size("met.a")), lambda k: F.struct(k.cast("long").alias("hunk"), between("a", k).alias("a"), between("b", k).alias("b")))
    parts = lists.select(key, F.inline(F.filter(every, lambda h: (F.size(h["a"]) > 0) | (F.size(h["b"]) > 0))))
    spelled = lambda side, kept: F.array_join(F.transform(side, kept), "")
    kept = lambda x: F.when(x["unit"].isin(*HYPHENS) & x["line_end"], "").otherwise(x["unit"])
    sides = [decomposed(spelled(side, form)).alias(name + side) for name, form in (("_", kept), ("_all_", lambda x: x["unit"])) for side in ("a", "b")]
    plain = parts.select(key, "hunk", F.size("a").cast("long").alias("a_n"), F.size("b").cast("long").alias("b_n"), *sides)
    kind = F.when(F.col("_a") == F.col("_b"), "hyphen").when(F.col("b_n") == 0, "aonly").when(F.col("a_n") == 0, "bonly").when(F.col("_all_a") == F.col("_all_b"), "font").otherwise("char")
    return plain.select(key, "hunk", "a_n", "b_n", kind.alias("class"))


def gaps(pairs: DataFrame, key: str) -> DataFrame:
    """(key, a_from, a_to, b_from, b_to): what lies unmatched between neighbouring pairs of an alignment."""
    w = Window.partitionBy(key).orderBy("a_pos")
    before = pairs.withColumn("a_from", F.lag("a_pos").over(w) + 1).withColumn("b_from", F.lag("b_pos").over(w) + 1)
    found = before.where("a_from is not null and (a_from < a_pos or b_from < b_pos)")
    return found.select(key, "a_from", F.col("a_pos").alias("a_to"), "b_from", F.col("b_pos").alias("b_to"))
