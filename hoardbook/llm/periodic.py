"""Runs of periodic words: stretches in which words one period apart are identical.

Every stretch of period p that is at least 2p long covers a grid place g, a multiple of p, together
with g + p. So for each p the places 0, p, 2p, ... are compared with the next one, n/p of them, in
all n log n; where the words agree, the longest common extensions to both sides give the stretch.

Extensions come from a sample of the suffixes. The sampled places are those whose remainder lies in
a difference cover: for any two places some small step reaches sampled places from both at once.
Sampled suffixes are sorted by whole blocks of words, doubling; common lengths of neighbours in that
order go into a sparse table. A question compares the few words up to the common sample, then
takes one range minimum.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# A perfect difference set, every remainder is a difference of two members.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

LEAST = 12  # words a run has at least
WORDS_AT_ONCE = 1 << 20  # words of several documents handled together
PAIRS_AT_ONCE = 1 << 20
# Whatever the period, a run of at least LEAST and two periods has so many agreeing places in a row.
_AGREE = LEAST // 2

SPACE = r"[\x20\x09-\x0D]+"


def _steps() -> np.ndarray:
    """For two remainders the least step that takes both into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    table = np.full((MODULUS, MODULUS), -1, np.int64)
    for step in reversed(range(MODULUS)):
        there = np.roll(inside, -step)
        table[np.ix_(there, there)] = step
    return table


_STEP = _steps()
_RANK_IN_COVER = np.searchsorted(COVER, np.arange(MODULUS))


class Extensions:
    """Longest common extensions of places in one sequence of numbers, which must hold no two equal
    suffixes that reach its end: it ends with a number found nowhere else."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        last = -(-self.n // MODULUS) * MODULUS + MODULUS
        self.words = np.full(last + MODULUS, np.iinfo(np.int64).min, np.int64)
        self.words[: self.n] = words
        places = (np.arange(0, last, MODULUS)[:, None] + np.array(COVER)).ravel()
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[places]
        names, rank = np.unique(
            np.ascontiguousarray(blocks).view(f"V{8 * MODULUS}").ravel(), return_inverse=True
        )
        levels, width, m = [rank.astype(np.int64)], len(COVER), len(places)
        while len(names) < m and width < m:  # equal only behind the end
            after = np.zeros(m, np.int64)
            after[:-width] = levels[-1][width:] + 1
            names, rank = np.unique(levels[-1] * (m + 1) + after, return_inverse=True)
            levels.append(rank.astype(np.int64))
            width *= 2
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        self.table = [self._common(levels, places, order[:-1], order[1:])]
        while (half := 1 << (len(self.table) - 1)) * 2 <= m - 1:
            below = self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))

    def _common(self, levels, places, a, b) -> np.ndarray:
        """Common words of sampled suffixes: whole blocks from the widest level down, then words."""
        a, b, m = a.copy(), b.copy(), len(places)
        length = np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels))):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            length[same] += MODULUS << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        inside = np.flatnonzero((a < m) & (b < m))
        for some in np.array_split(inside, -(-len(inside) // 65_536) or 1):
            x, y = places[a[some]], places[b[some]]
            alive, t = np.arange(len(some)), 0
            while len(alive) and t < MODULUS:
                alive = alive[self.words[x[alive] + t] == self.words[y[alive] + t]]
                length[some[alive]] += 1
                t += 1
        return length.astype(np.int32)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from places ``i`` and ``j`` (different ones) on."""
        step = _STEP[i % MODULUS, j % MODULUS]
        length = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        for t in range(MODULUS):
            alive = alive[step[alive] > t]
            if not len(alive):
                break
            alive = alive[self.words[i[alive] + t] == self.words[j[alive] + t]]
            length[alive] += 1
        synced = np.flatnonzero(length == step)
        x, y = i[synced] + step[synced], j[synced] + step[synced]
        inside = np.maximum(x, y) < self.n  # else one of them is the end itself
        synced, x, y = synced[inside], x[inside], y[inside]
        sample = lambda p: self.rank[p // MODULUS * len(COVER) + _RANK_IN_COVER[p % MODULUS]]
        x, y = sample(x), sample(y)
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            length[synced[at]] += np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return length


def _agreeing(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places and periods (g, p) at which the words at g and g + p agree, p up to half the
    longest document, in bounded lots."""
    n, lot, held = len(words), [], 0
    p, top = 1, min(longest // 2, n - 1)
    while p <= top and n // p >= 64:
        at = np.flatnonzero(words[: n - p : p] == words[p::p])
        lot.append((at * p, np.full(len(at), p)))
        held += len(at)
        p += 1
        if held >= PAIRS_AT_ONCE:
            yield tuple(map(np.concatenate, zip(*lot)))
            lot, held = [], 0
    while p <= top:  # short rows of the grid, many periods at a time
        periods = np.arange(p, min(top, p + PAIRS_AT_ONCE // 64) + 1)
        counts = -(-(n - periods) // periods)
        each = np.repeat(periods, counts)
        g = (np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)) * each
        same = words[g] == words[g + each]
        lot.append((g[same], each[same]))
        held += int(same.sum())
        p = int(periods[-1]) + 1
        if held >= PAIRS_AT_ONCE:
            yield tuple(map(np.concatenate, zip(*lot)))
            lot, held = [], 0
    if lot:
        yield tuple(map(np.concatenate, zip(*lot)))


def _worth(words: np.ndarray, g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which pairs lie among enough agreeing places in a row to be part of a run."""
    n = len(words)
    row = np.ones(len(g), np.int64)
    for side in (1, -1):
        alive = np.arange(len(g))
        for t in range(1, _AGREE):
            x = g[alive] + side * t
            alive = alive[(x >= 0) & (x + p[alive] < n)]
            x = g[alive] + side * t
            alive = alive[words[x] == words[x + p[alive]]]
            row[alive] += 1
    return row >= _AGREE


def _joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in one sequence, each followed by a number of its own; where each starts."""
    parts = []
    for k, d in enumerate(documents):
        parts += [d, [-1 - k]]
    sizes = np.array([len(d) + 1 for d in documents])
    return np.concatenate(parts).astype(np.int64), sizes.cumsum() - sizes


def _candidates(documents: list[np.ndarray], words: np.ndarray):
    """Grid pairs (g, p) inside one document that may be part of a run, in bounded lots."""
    owner = np.repeat(np.arange(len(documents)), [len(d) + 1 for d in documents])
    for g, p in _agreeing(words, max(map(len, documents))):
        same = owner[g] == owner[g + p]
        g, p = g[same], p[same]
        keep = _worth(words, g, p)
        yield g[keep], p[keep], owner[g[keep]]


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Per document (numbers standing for its words) its runs: rows (start, length, period) by
    start, then period."""
    rows = np.empty((0, 3), np.int64)
    found = [rows] * len(documents)
    if max(map(len, documents), default=0) < LEAST:
        return found
    words, _ = _joined(documents)
    touched = np.unique(np.concatenate([np.unique(k) for _, _, k in _candidates(documents, words)] or [rows[:, 0]]))
    if not len(touched):
        return found
    # Suffixes are sorted only for documents in which places agree.
    documents = [documents[k] for k in touched]
    words, starts = _joined(documents)
    n = len(words)
    forward = Extensions(words)
    backward = Extensions(np.concatenate([words[::-1], [np.iinfo(np.int64).max]]))
    for g, p, _ in _candidates(documents, words):
        begin = g.copy()
        inner = np.flatnonzero(g > 0)
        begin[inner] -= backward.common(n - g[inner], n - g[inner] - p[inner])
        length = g + p + forward.common(g, g + p) - begin
        long = length >= np.maximum(LEAST, 2 * p)
        rows = np.concatenate([rows, np.stack([begin, length, p], 1)[long]])
        # A stretch is also met at multiples of its period; the least one counts.
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], np.append(starts, n))
    for k, (document, start) in enumerate(zip(touched, starts)):
        found[document] = rows[edges[k]:edges[k + 1]] - [start, 0, 0]
    return found


def _lots(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    lot, held = [], 0
    for text in texts:
        words = (text or b"").split()  # bytes split at exactly the six characters of SPACE
        lot.append(words)
        held += len(words)
        if held >= WORDS_AT_ONCE:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for lot in _lots(batch.column("_text").cast(pa.binary()).to_pylist()):
            numbers = defaultdict()
            numbers.default_factory = numbers.__len__
            found = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in lot])
            collapsed = []
            for words, runs in zip(lot, found):
                if len(runs):
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
                    words = [w for w, c in zip(words, cover.cumsum()) if not c]
                collapsed.append(b" ".join(words))
            every = np.concatenate(found)
            offsets = np.cumsum([0, *map(len, found)])
            runs = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], fields=list(_RUNS.value_type)),
            )
            part = batch.slice(done, len(lot))
            done += len(lot)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array([len(w) for w in lot], pa.int64()), runs,
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """Per row of ``docs``: its key, n_words, runs (array of start, length, period by start, then
    period) and collapsed, the words without the repetitions.

    Words are stretches without the characters of ``SPACE``, numbered from 0. A run is a stretch
    of at least 12 words and two of its smallest periods that no neighbouring word extends. A word
    is left out of ``collapsed`` if some run contains it after that run's first period. Null and
    empty texts have no words and no runs; null, repeated and equal keys are rows like any other;
    an empty table stays empty; other columns may bear any name. Rows are worked through where they
    lie, without a shuffle. A text is held whole by one task: about 150 bytes a word of it, and
    200 more if places agree.
    """
    text = F.col(text) if isinstance(text, str) else text
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), text.alias("_text")).mapInArrow(
        _run,
        f"_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    ).withColumnRenamed("_id", key)


def with_planted_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The text in which, for each key whose crc32 ``h`` ends in 0, words from a = g % n on repeat
    with period 1 + (n - a) / (3 + g % 8), where g = h / 10 and n is the number of words. Rows
    without key, text or words keep their text."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n == 0, "").otherwise(F.concat_ws(" ", F.transform(
            F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.element_at(words, place(i) + 1)
        )))

    # One-element arrays bind the words, and the numbers found from them, once per text.
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col(text))


def digests(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each row of ``periodic_runs`` the number of runs, the longest one and two digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")
    )))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return runs.withColumn("_best", best).select(
        key, F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"),
        (-F.col("_best.less")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * -_best.less div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
