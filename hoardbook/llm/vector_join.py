"""Near duplicates among vectors by an exact metric range join.

Pivots partition the unit vectors into cells, and crowded cells again. Two vectors within the radius may
lie in different cells, so a vector is also sent to each cell whose border it is close enough to, by
the triangle inequality; then every cell is joined on its own, in blocks.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hoardbook.llm.common import components, extended, staged

FAN, PER_PIVOT = 4_096, 16  # most pivots of one cut, and vectors for each
FIRST = 8  # pivots where no cut is worth making
CELL = 512  # vectors of a cell that is not cut again
TRIAL, WORTH, COPIES = 2_000, 0.6, 16
BLOCK = 4_000
_SLACK = 1e-9


def _units(rows) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    return m / np.sqrt((m * m).sum(1))[:, None]


def _assign(least: float):
    """Adds to the vectors of a cell, given its pivots, the nearest pivot and the pivots whose cells they
    must be sent to.

    With ``r`` the distance at cosine ``least``: if ``w`` is nearest to pivot q, the border between
    q and p lies between w and any v nearer to p; v's distance from that border's plane is
    (v.p - v.q) / |p - q|, so v can only be within r of w if that is at most r.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best, sent = np.zeros(len(left), np.int64), []
        if len(left):
            p = _units(right["pivot"])
            for at in range(0, len(left), 512):
                near = _units(left["embedding"].iloc[at:at + 512]) @ p.T
                top = near.argmax(1)
                best[at:at + 512] = top
                apart = np.sqrt(np.maximum(0, 2 - 2 * (p[top] @ p.T)))
                sent += [np.flatnonzero(row) for row in near.max(1)[:, None] - near <= radius * apart + _SLACK]
        return left.drop(columns=["part"]).assign(nearest=best, subs=sent)

    return run


KEY = ["dims", "cell"]


def _ranked(rows: DataFrame, most: int, salt: int = 0) -> DataFrame:
    """Of each cell the ``most`` vectors whose hashes, with the salt, are lowest."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.xxhash64(F.lit(salt), "id"), "id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most)


def _cut(rows: DataFrame, full: DataFrame, most: int, per: int, least: float, block: int) -> DataFrame:
    """``rows`` of cells with their nearest pivots and the pivots whose cells they are sent to. A cell has
    one pivot for ``per`` of its own vectors in ``full``, ``most`` at most."""
    pivots = _ranked(full.where("own"), most).where(F.col("_rank") <= F.ceil(F.col("n") / per)).select(
        *KEY, "s", F.col("embedding").alias("pivot")
    )
    parts = F.ceil(F.col("s") / block)
    rows = rows.select(*KEY, F.pmod(F.xxhash64("id"), parts).alias("part"), "id", "embedding", "copies", "own")
    pivots = pivots.select(*KEY, "pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    pivots = pivots.toDF(*pivots.columns)
    schema = extended(rows.drop("part"), "nearest bigint, subs array<bigint>")
    return rows.groupBy(*KEY, "part").cogroup(pivots.groupBy(*KEY, "part")).applyInPandas(_assign(least), schema)


def _parts_of(cut: DataFrame) -> DataFrame:
    """The rows of the new cells."""
    return cut.select("*", F.explode("subs").alias("sub")).select(
        "dims", F.concat_ws(".", "cell", F.col("sub").cast("string")).alias("cell"), "id", "embedding", "copies",
        (F.col("own") & (F.col("nearest") == F.col("sub"))).alias("own"),
    )


def _worth(trial: DataFrame) -> DataFrame:
    """Cells that a cut, tried on some of their rows, leaves with few enough comparisons and copies."""
    sizes = trial.groupBy(*KEY).agg(
        F.sum(F.col("own").cast("double")).alias("n"), F.count(F.lit(1)).cast("double").alias("s"),
        F.sum(F.size("subs")).alias("copies"),
    )
    subs = trial.select(*KEY, F.explode("subs").alias("sub"), (F.col("own") & (F.col("nearest") == F.col("sub"))).alias("mine"))
    after = subs.groupBy(*KEY, "sub").agg(
        F.sum(F.col("mine").cast("double")).alias("o"), F.count(F.lit(1)).cast("double").alias("t")
    ).groupBy(*KEY).agg(F.sum(F.col("o") * F.col("t")).alias("after"))
    return sizes.join(after, KEY).where(
        (F.col("after") <= WORTH * F.col("n") * F.col("s")) & (F.col("copies") <= COPIES * F.col("s"))
    ).select(*KEY)


def cells(
    distinct: DataFrame, least: float, first: int = FIRST, fan: int = FAN, per: int = PER_PIVOT, cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """(dims, cell, id, embedding, copies, own): each vector of ``distinct`` (id, embedding, copies) once
    in its own cell and once in each other cell that holds vectors it may be similar to.

    Pivots grow with the data: one for ``per`` vectors, those whose hashes are lowest, ``fan`` at most for
    one cut; cells of more than ``cell`` vectors are cut again, by pivots of their own. A cut is first tried
    on ``TRIAL`` rows of a cell, drawn apart from the pivots, and made where it leaves at most ``WORTH`` of the comparisons and ``COPIES``
    copies of a row. Where the very first one is not worth making (vectors without clusters), ``first``
    pivots cut all vectors, and that is all. Vectors of different lengths have cells apart.
    """
    level = distinct.select(
        F.size("embedding").alias("dims"), F.lit("").alias("cell"), "id", "embedding", "copies", F.lit(True).alias("own")
    )
    done, rounds = [], 0
    while True:
        level = staged(level, "cells")
        counts = staged(level.groupBy(*KEY).agg(
            F.sum(F.col("own").cast("bigint")).alias("n"), F.count(F.lit(1)).alias("s")
        ).where(F.col("n") > (cell if rounds else cell // 4)), "crowded-cells")
        if counts.isEmpty():
            done.append(level)
            break
        full = level.join(counts, KEY)
        worth = staged(_worth(_cut(_ranked(full, TRIAL, salt=1), full, fan, per, least, block)), "cells-worth")
        some = full.join(worth, KEY, "left_semi")
        rest = full.join(worth, KEY, "left_anti")
        done.append(level.join(counts, KEY, "left_anti"))
        if rounds:
            done.append(rest.select(*level.columns))
        else:
            done.append(staged(_parts_of(_cut(rest, rest, first, cell // 4, least, block)), "first-cells"))
        if worth.isEmpty():
            break
        level = _parts_of(_cut(some, some, fan, per, least, block))
        rounds += 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _lowest(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per row of ``near`` the lowest label of its true columns."""
    none = np.iinfo(np.int64).max
    return np.concatenate([
        np.where(near[at:at + 512], labels, none).min(1) for at in range(0, len(near), 512)
    ])


def _join_block(least: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Members against what was sent to their block: per member the number of vectors linked,
        per vector the smallest id of its component in this block."""
        none = pd.DataFrame({"id": [], "links": [], "label": []}).astype("int64")
        if left.empty or right.empty:
            return none
        members, sent = _units(left["embedding"]), _units(right["embedding"])
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        copies = right["copies"].to_numpy()
        near = np.empty((len(ids), len(other)), bool)
        for at in range(0, len(ids), 512):
            near[at:at + 512] = members[at:at + 512] @ sent.T >= least
        _, mine, theirs = np.intersect1d(ids, other, return_indices=True)
        near[mine, theirs] = False
        linked, hit = near.any(1), near.any(0)
        near = near[linked][:, hit]
        label, there, copies = ids[linked], other[hit], copies[hit]
        ids, other = label, there
        while len(ids):  # labels sink along links until they rest
            before = label.sum() + there.sum()
            label = np.minimum(label, _lowest(near, there))
            there = np.minimum(there, _lowest(near.T, label))
            if label.sum() + there.sum() == before:
                break
        return pd.concat([
            pd.DataFrame({"id": ids, "links": near @ copies, "label": label}),
            pd.DataFrame({"id": other, "links": 0, "label": there}),
        ]).astype("int64")

    return run


def linked_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9,
    first: int = FIRST, fan: int = FAN, per: int = PER_PIVOT, cell: int = CELL, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: its key, n_links, component_id and kept.

    Rows link if their cosine in double precision is at least ``least`` (above 0) and their
    vectors are equally long. Null, empty and zero vectors and those with null or non-finite
    components link with nothing. Rows with equal vectors link with each other; they are joined
    once. ``component_id`` is the smallest key reachable by links, ``kept`` marks the rows that
    bear it. An empty table stays empty.

    Distinct vectors are dealt to ``cells``. Cells are joined in blocks of about ``block`` members and
    ``block`` sent vectors, so neither a crowded cell nor a crowd of equal vectors gathers in a task;
    links are counted and components formed per block, pairs never leave it.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    distinct = staged(
        rows.where(usable & F.col("id").isNotNull()).groupBy("embedding")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors",
    )
    placed = staged(cells(distinct, least, first, fan, per, cell, block), "placed")

    # How many blocks each cell needs; one row per cell.
    blocks = placed.groupBy("dims", "cell").agg(
        F.ceil(F.sum(F.col("own").cast("bigint")) / block).alias("m"), F.ceil(F.count(F.lit(1)) / block).alias("p")
    ).where("m > 0")
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    members = placed.where("own").join(blocks, ["dims", "cell"]).select(
        "dims", "cell", number("m", "m").alias("mb"), upto("p").alias("pb"), "id", "embedding"
    )
    sent = (
        placed.join(blocks, ["dims", "cell"])
        .select("dims", "cell", number("p", "p").alias("pb"), upto("m").alias("mb"), "id", "embedding", "copies")
    )
    sent = sent.toDF(*sent.columns)
    block_key = ["dims", "cell", "mb", "pb"]
    found = staged(
        members.groupBy(*block_key).cogroup(sent.groupBy(*block_key))
        .applyInPandas(_join_block(least), "id bigint, links bigint, label bigint")
        .groupBy("id", "label").agg(F.sum("links").alias("links")), "links",
    )
    # ``label`` may repeat an id under several blocks; its links are summed per id below.
    labels = components(found.select(F.col("id").alias("a"), F.col("label").alias("b")), "vector-components")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    summary = (
        distinct.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    many = rows.where(usable & F.col("id").isNotNull()).join(summary, "embedding").select(
        "id", "n_links", "component_id"
    )
    none = rows.where(~usable | F.col("id").isNull()).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    return many.unionByName(none).select(
        F.col("id").alias(key), F.col("n_links").cast("bigint").alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
