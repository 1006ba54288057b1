"""Near duplicates of texts: DartMinHash signatures of weighted word shingles, banded joining, and
an exact check of every link.

Within a bucket all members are compared with one leader. Distances to the leader then tell, by the
triangle inequality, which others can still be similar, so no bucket is compared in pairs. Before
the exact check a sketch drops pairs of left-over members, which overlooks a link of similarity 0.8 with
probability 3e-5; the rest loses no link.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.common import (
    components, extended, keep_marked, settle, staged, text_digest, unstaged, with_group_totals,
)

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 6  # a pair of similarity 0.8 shares no band with probability 6e-5
CELLS_AT_ONCE = 1 << 19
_U = np.uint64
MEETING = ["bucket", "ring", "lb", "rb"]  # what a probe and another member must share to meet
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 15.0)])))
_WORD: np.ndarray | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each number."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_points() -> np.ndarray:
    global _WORD
    if _WORD is None:
        _WORD = np.array([chr(c).isalnum() for c in range(0x30000)] + [True])
    return _WORD


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles, one per place: every ``words`` consecutive words, in lower
    case, a word being a run of letters and digits. A shorter text is one shingle, one without
    words has none."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64)
    inside = _word_points()[np.minimum(points, 0x30000)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    # A word's hash: its points mixed with their places in the word, summed.
    where = np.arange(len(points)) - np.repeat(
        np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(points)]]))
    )
    mixed = np.where(inside, _mix(points.astype(np.uint64) + (where.astype(np.uint64) << _U(32))), _U(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    hashes = _mix(sums[ends] - sums[starts])
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(hashes))):
        out = _mix(out + hashes[i:i + n])
    return out


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], size: int) -> np.ndarray:
    """DartMinHash: per weighted set the earliest dart on each of ``size`` coordinates.

    An element owns a strip: as wide as its weight, with ranks upwards. Darts hit it at one per unit
    square, at places given by hashes of element and square alone; each dart has a rank and a
    coordinate. A set holds the darts within its elements' weights, and its value on a coordinate
    is the lowest rank there. Two sets agree on one with the probability of their weighted Jaccard
    similarity. A set of total weight W meets every coordinate within about size * (ln size + 3) / W
    ranks; should one be missing, it is thrown at twice as high. Sets without weight stay at the
    highest value.
    """
    out = np.full((len(elements), size), ~_U(0), np.uint64)
    totals = np.array([w.sum() for w in weights])
    heights = np.maximum(1, np.ceil(size * (np.log(size) + 3) / np.maximum(totals, 1e-9)))
    todo = [i for i in range(len(elements)) if totals[i] > 0]
    while todo:
        for at in _portions(todo, elements, weights, heights):
            _throw(at, elements, weights, heights, size, out)
        todo = [i for i in todo if (out[i] == ~_U(0)).any()]
        heights[todo] *= 2
    return out


def _portions(todo, elements, weights, heights):
    part, cells = [], 0
    for i in todo:
        part.append(i)
        cells += int(np.ceil(weights[i]).sum() * heights[i])
        if cells >= CELLS_AT_ONCE:
            yield part
            part, cells = [], 0
    if part:
        yield part


def _throw(sets, elements, weights, heights, size, out):
    lengths = [len(elements[i]) for i in sets]
    element = np.concatenate([elements[i] for i in sets])
    weight = np.concatenate([weights[i] for i in sets])
    owner = np.repeat(np.array(sets), lengths)
    # Unit squares: along the weight, then along the ranks.
    wide = np.ceil(weight).astype(np.int64)
    along = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    strip = _mix(np.repeat(element, wide) + _mix(along.astype(np.uint64)))
    room = np.repeat(weight, wide) - along
    owner = np.repeat(owner, wide)
    high = heights[owner].astype(np.int64)
    rank = np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
    square = _mix(np.repeat(strip, high) ^ (rank.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    owner, room = np.repeat(owner, high), np.repeat(room, high)
    darts = np.searchsorted(_POISSON, (square >> _U(11)) * 2.0**-53)
    number = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = _mix(np.repeat(square, darts) + (number.astype(np.uint64) << _U(1)) + _U(1))
    owner, rank, room = np.repeat(owner, darts), np.repeat(rank, darts), np.repeat(room, darts)
    if (room < 1).any():  # a strip's last square may be cut
        inside = (_mix(dart) >> _U(11)) * 2.0**-53 < room
        dart, owner, rank = dart[inside], owner[inside], rank[inside]
    coordinate = (dart >> _U(32)) % _U(size)
    value = (rank.astype(np.uint64) << _U(44)) | (_mix(~dart) >> _U(20))
    np.minimum.at(out.reshape(-1), owner * size + coordinate.astype(np.int64), value)


def _sketch(bands: int, rows: int, words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for at in range(0, len(texts), 500):
                places = [np.sort(shingles(t or "", words)) for t in texts[at:at + 500]]
                sets = [np.unique(p, return_counts=True) for p in places]
                values = signatures(
                    [e for e, _ in sets], [n.astype(np.float64) for _, n in sets], bands * rows
                )
                keys = np.zeros((len(sets), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = _mix(keys + values[:, r::rows])
                some = [len(p) > 0 for p in places]
                rest = batch.slice(at, 500).drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays(
                    rest.columns + [
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([
                            hashlib.blake2b(p.tobytes(), digest_size=16).digest() if s else None
                            for p, s in zip(places, some)
                        ], pa.binary()),
                        pa.array([k.view(np.int64) if s else [] for k, s in zip(keys, some)], pa.list_(pa.int64())),
                        pa.array([(v & _U(0xFF)).astype(np.uint8).view(np.int8) for v in values], pa.list_(pa.int8())),
                        pa.array([(p >> _U(32)).astype(np.uint32).tobytes() for p in places], pa.binary()),
                    ],
                    rest.schema.names + ["n", "same", "bands", "sketch", "shingles"],
                )

    return run


def _numbered(values: bytes) -> np.ndarray:
    """A sorted multiset as a set: each value with the number of its repeat."""
    v = np.sort(np.frombuffer(values, np.uint32)).astype(np.uint64)
    first = np.concatenate([[True], v[1:] != v[:-1]])
    at = np.arange(len(v))
    return (v << _U(24)) | (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)


def _similarity(batches):
    for batch in batches:
        out, known = [], (None, None)
        for a, b in zip(batch.column("a_shingles").to_pylist(), batch.column("b_shingles").to_pylist()):
            if known[0] != b:
                known = (b, _numbered(b))
            x, y = _numbered(a), known[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"]
        )


def similarities(pairs: DataFrame, sets: DataFrame, rows_per_task: int = 5_000) -> DataFrame:
    """(a, b, similarity): the weighted Jaccard similarity of each pair, from ``sets`` (_id, shingles).

    ``b`` may be the same for very many pairs: its set is sent once per ``rows_per_task`` of them.
    """
    counted = with_group_totals(
        pairs.withColumn("_one", F.lit(1)), ["b"], ["a"], {"_n": ("sum", "_one")}
    ).withColumn("_parts", F.ceil(F.col("_n") / rows_per_task)).select(
        "a", "b", "_parts", F.pmod(F.xxhash64("a"), F.col("_parts")).alias("_part")
    )
    counted = staged(counted, "pairs")
    settle(counted)
    left = counted.join(
        sets.select(F.col("_id").alias("a"), F.col("shingles").alias("a_shingles")), "a"
    )
    right = (
        counted.groupBy("b").agg(F.max("_parts").alias("_parts"))
        .join(sets.select(F.col("_id").alias("b"), F.col("shingles").alias("b_shingles")), "b")
        .select("b", "b_shingles", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))
    )
    both = left.join(right, ["b", "_part"]).select("a", "b", "a_shingles", "b_shingles")
    return both.mapInArrow(_similarity, "a bigint, b bigint, similarity double")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: dict | None = None,
    least: float = LEAST, words: int = WORDS, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: its key, class_id, class_size, kept, and ``carry`` columns.

    Texts link if the weighted Jaccard similarity of their shingles (a shingle's weight is how
    often it occurs) is at least ``least``; classes are the connected components. ``class_id`` is
    the class's smallest key (null only if it has no other); the row that bears it is kept, one of
    them if the key repeats. Null and empty texts and texts without words link with nothing. Texts
    with the same shingles are joined once. ``carry`` maps names to expressions over ``docs``.
    An empty table stays empty.

    Each link is checked on the full shingles. With similarity 0.8 a pair shares none of the bands with
    probability 6e-5; between left-over members of a bucket that share one, the sketch overlooks
    it with probability 3e-5.
    """
    carry = carry or {}
    first = docs.select(
        F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_key"),
        *[e.alias(f"_c_{n}") for n, e in carry.items()], F.col(text).alias("_text"),
    )
    schema = extended(
        first.drop("_text"),
        "n bigint, same binary, bands array<bigint>, sketch array<tinyint>, shingles binary",
    )
    sketched = staged(first.mapInArrow(_sketch(bands, rows, words), schema), "sketches")
    plain = ["_id", "_key", *[f"_c_{n}" for n in carry]]
    narrow = sketched.select(*plain, "n", "same")
    alike = staged(
        with_group_totals(narrow.where("n > 0"), ["same"], ["_id"], {"rep": ("min", "_id")}), "alike"
    )
    without = staged(narrow.where("n = 0").select(*plain), "without-words")
    settle(alike)
    reps = alike.where("_id = rep").select("_id")
    buckets = sketched.select("_id", "n", "bands").where("n > 0").join(reps, "_id").select(
        "_id", "n", F.posexplode("bands").alias("band", "bucket")
    ).withColumn("_one", F.lit(1))
    shared = staged(
        with_group_totals(
            buckets, ["bucket"], ["_id"], {"leader": ("min", "_id"), "members": ("sum", "_one")}
        ).where("members > 1").select("band", "bucket", "_id", "n", "leader"),
        "buckets",
    )
    settle(shared)
    with_leader = shared.where("_id <> leader").select(
        F.col("_id").alias("a"), F.col("leader").alias("b")
    ).distinct()
    needed = shared.select("_id").distinct()
    sets = staged(sketched.select("_id", "bands", "sketch", "shingles").join(needed, "_id", "left_semi"), "sets")
    unstaged(sketched)
    near = staged(similarities(with_leader, sets), "near")
    settle(near)
    links = near.where(F.col("similarity") >= least).select("a", "b")
    classes = staged(components(links, "near-components"), "classes")
    rest = staged(_left_over(shared, near, sets, classes, least, bands * rows), "rest")
    unstaged(shared, near, sets)
    # Every class is a star around its smallest member; the links found last join stars.
    stars = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
    classes = staged(
        components(stars.unionByName(rest), "near-components").select(F.col("node").alias("rep"), "component"),
        "classes",
    )
    settle(classes)

    joined = alike.join(classes, "rep", "left").select(
        *plain, F.coalesce("component", "rep").alias("component")
    ).unionByName(without.withColumn("component", F.col("_id"))).withColumn(
        "_order", F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_id").alias("id"))
    ).withColumn("_one", F.lit(1).cast("bigint"))
    best = with_group_totals(
        joined, ["component"], ["_id"], {"_best": ("min", "_order"), "class_size": ("sum", "_one")}
    )
    return best.select(
        F.col("_key").alias(key), F.col("_best.key").alias("class_id"), "class_size",
        (F.col("_best.id") == F.col("_id")).alias("kept"),
        *[F.col(f"_c_{n}").alias(n) for n in carry],
    )


def _left_over(
    shared: DataFrame, near: DataFrame, sets: DataFrame, classes: DataFrame, least: float, size: int,
    block: int = 400,
) -> DataFrame:
    """(a, b): links between texts that share a bucket and are in different ``classes`` so far; of
    the links that would join the same classes again not all need come out.

    Only buckets that hold several classes are looked at. In them at least one of such a pair is
    not linked to the leader. Distances (one less similarity) obey the triangle inequality: similar
    texts are about equally far from the leader, by 1 - ``least`` at most. So members meet by bucket
    and ring of distance, and those linked to the leader meet only the few others near it. They
    meet in blocks of about ``block`` on either side, whatever the bucket's size; a block emits no
    pairs but those that are similar and join two classes.
    """
    step = 1 - least
    known = near.select(F.col("a").alias("_id"), F.col("b").alias("leader"), "similarity")
    named = shared.join(classes.withColumnRenamed("node", "_id"), "_id", "left").withColumn(
        "class", F.coalesce("component", "_id")
    )
    mixed = with_group_totals(
        named, ["bucket"], ["_id"], {"_low": ("min", "class"), "_high": ("max", "class")}
    ).where("_low <> _high and _id <> leader").select("band", "bucket", "_id", "n", "leader", "class")
    members = staged(
        mixed.join(known, ["_id", "leader"]).select(
            "band", "bucket", "_id", "n", "class", "similarity",
            F.floor((1 - F.col("similarity")) / step).alias("ring"),
        ),
        "members",
    )
    near_rings = F.explode(F.array("ring", F.col("ring") - 1, F.col("ring") + 1))
    outside = members.where(F.col("similarity") < least)
    both = members.withColumn("left", F.lit(0)).unionByName(
        outside.withColumn("left", F.lit(1)).withColumn("ring", near_rings)
    ).withColumn("right", 1 - F.col("left"))
    counted = with_group_totals(
        both, ["bucket", "ring"], ["_id", "left"], {"_l": ("sum", "left"), "_r": ("sum", "right")}
    ).where("_l > 0 and _r > 0")
    parts = lambda n: F.ceil(F.col(n) / block)
    number = lambda n: F.pmod(F.xxhash64("_id"), parts(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), parts(n) - 1))
    columns = ["band", "bucket", "ring", "_id", "n", "class", "similarity", "bands", "sketch", "shingles"]
    counted = staged(counted, "meetings")
    settle(counted)
    full = counted.join(sets, "_id")
    probes = full.where("left = 1").select(*columns, number("_l").alias("lb"), upto("_r").alias("rb"))
    others = full.where("left = 0").select(*columns, number("_r").alias("rb"), upto("_l").alias("lb"))
    # A row stands in as many meetings as the other side has blocks. Most meetings are small: one call
    # handles about a thousand rows of them, and none more than a few blocks.
    met = F.when(F.col("left") == 1, parts("_r")).otherwise(parts("_l"))
    slots = max(1, (counted.agg(F.sum(met)).first()[0] or 0) // 1000)
    slot = F.pmod(F.xxhash64(*MEETING), F.lit(slots)).alias("slot")
    probes, others = probes.select(slot, "*"), others.select(slot, "*")
    others = others.toDF(*others.columns)
    # Four standard deviations below: a link is overlooked with probability 3e-5.
    enough = int(size * least - 4 * (size * least * (1 - least)) ** 0.5)
    return (
        probes.groupBy("slot").cogroup(others.groupBy("slot"))
        .applyInPandas(_meet(least, enough), "a bigint, b bigint").distinct()
    )


def _meet(least: float, enough: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links = []
        if not left.empty and not right.empty:
            there = right.groupby(MEETING, sort=False).indices
            for key, rows in left.groupby(MEETING, sort=False).indices.items():
                if key in there:
                    links += meeting(left.iloc[rows], right.iloc[there[key]])
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    def meeting(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        stack = lambda t, c, kind: np.stack([np.asarray(x, kind) for x in t[c]])
        column = lambda t, c: t[c].to_numpy()
        sketch, other = stack(left, "sketch", np.int8), stack(right, "sketch", np.int8)
        bands, there = stack(left, "bands", np.int64), stack(right, "bands", np.int64)
        a, b = column(left, "_id"), column(right, "_id")
        n, m = column(left, "n"), column(right, "n")
        s, r = column(left, "similarity"), column(right, "similarity")
        c, d = column(left, "class"), column(right, "class")
        band = int(left["band"].iloc[0])
        found = []
        for i in range(len(a)):
            may = np.flatnonzero(
                (c[i] != d) & ((r >= least) | (a[i] < b)) & (np.abs(s[i] - r) <= 1 - least + 1e-9)
                & (np.minimum(n[i], m) >= least * np.maximum(n[i], m))
            )
            if len(may):
                agree = (sketch[i] == other[may]).sum(1)
                may, agree = may[agree >= enough], agree[agree >= enough]
            if len(may):  # a pair is settled in the first band that it shares
                first = (bands[i] == there[may]).argmax(1) == band
                found += [(int(x), i, j) for x, j in zip(agree[first], may[first].tolist())]
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        sets: dict[tuple[int, int], np.ndarray] = {}

        def numbered(side, at):
            if (side, at) not in sets:
                sets[side, at] = _numbered((left if side else right)["shingles"].iloc[at])
            return sets[side, at]

        links = []
        for _, i, j in sorted(found, reverse=True):
            x, y = root(int(c[i])), root(int(d[j]))
            if x == y:
                continue
            p, q = numbered(1, i), numbered(0, j)
            common = len(np.intersect1d(p, q, assume_unique=True))
            if common / (len(p) + len(q) - common) >= least:
                parent[x] = y
                links.append((a[i], b[j]))
        return links

    return run


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with one of each class of near duplicates."""
    marks = staged(near_groups(docs, carry={"_sha": text_digest()}, **options), "marks")
    settle(marks)
    return keep_marked(docs, marks)
