"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text over real characters
gives each document a perplexity, judged by quantiles of its language.

One model holds the n-grams of all languages, since good texts mix them: with a model for each language,
4 of 117 held-out good documents of the sf0.01 table were rejected, all of them mixed.

Counts, continuations and back-offs are tables, and so is the probability of every n-gram that a
document holds; none of them is gathered. Documents are dealt into blocks of about
``BLOCK_CHARS`` characters. A block hands in each of its distinct n-grams once, gets the probabilities
back, and scores its documents with them, so what moves besides text is distinct n-grams a block, not
distinct n-grams a document. Of the text, only ``1 / PORTIONS`` lies on disk as shuffle files at a time.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hoardbook.llm.common import extended, settle, staged, unstaged, whole_row

ORDER = 4
# Texts count as if they had this many symbols of their language's usual perplexity besides.
PRIOR_SYMBOLS = 100
# A character is its code point + 1, in 21 bits; 0 stands before the start, _REPEAT for a repeated word.
_BITS, _REPEAT = 21, 0x110001
BLOCK_CHARS = 8_000_000
# A task codes so many characters of its block at a time.
SLICE_CHARS = 1_000_000
# Texts move in so many portions of the blocks, one after the other: the shuffle files of one go before the next.
PORTIONS = 4
# The judgement: upper quartile plus so many times the spread between the quartiles.
FENCE = 8.0


_BLANK: np.ndarray | None = None


def _blanks() -> np.ndarray:
    """Which code points up to 0x2FFFF are white space or control characters."""
    global _BLANK
    if _BLANK is None:
        import unicodedata

        _BLANK = np.array([unicodedata.category(chr(c))[0] in "ZC" for c in range(0x30000)])
    return _BLANK


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's code points, and which of them are blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, _blanks()[np.minimum(points, 0x2FFFF)]


def _repeats(points: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(last, keep): the last places of words that equal the word before them, and which places
    stay if each such word, with the white space before it, becomes one symbol at its last place.
    Words are compared by a hash of their code points."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < 2:
        return None
    mixed = (points.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0xFF51AFD7ED558CCD)
    power = np.cumprod(np.full(int((ends - starts).max()), 0x9E3779B97F4A7C15, np.uint64))
    where = np.arange(len(points)) - np.repeat(
        np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(points)]]))
    )
    mixed = np.where(blank, np.uint64(0), mixed * power[np.minimum(where, len(power) - 1)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
    words = sums[ends] - sums[starts]
    again = np.flatnonzero((words[1:] == words[:-1]) & (np.diff(ends - starts) == 0)) + 1
    if not len(again):
        return None
    change = np.zeros(len(points) + 1, np.int32)
    np.add.at(change, ends[again - 1], 1)
    np.add.at(change, ends[again], -1)
    keep = np.cumsum(change)[:-1] == 0
    last = ends[again] - 1
    keep[last] = True
    return last, keep


def characters(text: str) -> np.ndarray:
    """The text's characters as numbers. A word that equals the word before it becomes one number,
    with the white space between them."""
    points, blank = _points(text)
    out = points.astype(np.int64) + 1
    again = _repeats(points, blank)
    if again is None:
        return out
    last, keep = again
    out[last] = _REPEAT
    return out[keep]


def _discounts(n1: int | None, n2: int | None, n3: int | None, n4: int | None) -> list[float]:
    """The discounts of n-grams that occur once, twice and more often, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    ratio = lambda a, b: a / b if a and b else 0.0
    return [
        min(max(d, 0.0), top) for d, top in
        ((1 - 2 * y * ratio(n2, n1), 1.0), (2 - 3 * y * ratio(n3, n2), 2.0), (3 - 4 * y * ratio(n4, n3), 3.0))
    ] if y else [0.5, 0.75, 0.9]


def _numbered(values: np.ndarray) -> np.ndarray:
    """The values' numbers from 0, the same for the same value, in the order of their first places."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def _coded(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(lengths, context, symbol, code): each text's number of symbols, and of all symbols in a row
    the three before each, itself, and the n-gram's number from 0."""
    parts = [characters(t) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    pad = ORDER - 1
    at = np.arange(int(lengths.sum())) + np.repeat(pad * np.arange(len(parts)), lengths)
    s = np.zeros(int(lengths.sum()) + pad * len(parts), np.int64)
    if len(at):
        s[at + pad] = np.concatenate(parts)
    context = np.zeros(max(0, len(s) - pad), np.int64)
    for k in range(pad):
        context = (context << _BITS) | s[k:len(s) - pad + k]
    context, symbol = context[at], s[at + pad]
    return lengths, context, symbol, _numbered((_numbered(context) << _BITS) | symbol)


def _block(texts: list[str]) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """The distinct n-grams (context, symbol) of a block in their order, whatever that of the texts; before
    them per slice of about ``SLICE_CHARS`` characters (lengths, code, place): the texts' numbers of symbols,
    the n-gram's code of each symbol, and the n-gram's place for each code."""
    slices, contexts, symbols = [], [], []
    sizes = np.cumsum([0, *map(len, texts)]) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(sizes[:-1])) + 1).tolist(), len(texts)]
    for start, end in zip(cuts, cuts[1:]):
        lengths, context, symbol, code = _coded(texts[start:end])
        some = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        some[code] = np.arange(len(code))  # any place of each
        contexts.append(context[some])
        symbols.append(symbol[some])
        slices.append((lengths, code.astype(np.int32)))
    context, symbol = np.concatenate(contexts), np.concatenate(symbols)
    order = np.lexsort((symbol, context))
    context, symbol = context[order], symbol[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(context) != 0) | (np.diff(symbol) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    ends = np.cumsum([len(c) for c in contexts])[:-1]
    return [(*x, p) for x, p in zip(slices, np.split(place, ends))], context[new], symbol[new]


_GRAMS = "block bigint, at int, context bigint, symbol int, n bigint"


def _block_grams(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """A block's distinct n-grams, numbered, and how often trusted documents hold them."""
    ids = set(trusted.column("_t").to_pylist())
    slices, context, symbol = _block([t or "" for t in docs.column("_text").to_pylist()])
    good = np.array([i in ids for i in docs.column("_doc").to_pylist()], bool)
    n, start = np.zeros(len(context), np.int64), 0
    for lengths, code, place in slices:
        own = np.repeat(good[start:start + len(lengths)], lengths)
        n[place] += np.bincount(code[own], minlength=len(place))
        start += len(lengths)
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    return pa.table({
        "block": pa.array(np.full(len(n), block), pa.int64()),
        "at": pa.array(np.arange(len(n)), pa.int32()),
        "context": pa.array(context, pa.int64()),
        "symbol": pa.array(symbol, pa.int32()),
        "n": pa.array(n, pa.int64()),
    })


def _score(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The block's rows with bits and number of symbols; ``known`` has the bits of its n-grams."""
    slices, context, _ = _block([t or "" for t in docs.column("_text").to_pylist()])
    table = np.full(len(context), np.nan)
    table[known.column("at").to_numpy()] = known.column("bits").to_numpy()
    sums = []
    for lengths, code, place in slices:
        full = np.flatnonzero(lengths)
        sums.append(np.zeros(len(lengths)))
        if len(full):  # each text is summed by itself, so the order of the texts does not matter
            sums[-1][full] = np.add.reduceat(table[place][code], (np.cumsum(lengths) - lengths)[full])
    return docs.drop_columns(["_text", "block"]).append_column(
        "_bits", pa.array(np.concatenate(sums), pa.float64())
    ).append_column("n_symbols", pa.array(np.concatenate([x[0] for x in slices]), pa.int64()))


def _context(k: int) -> Column:
    """The last ``k`` characters of a context."""
    return F.col("context").bitwiseAND(F.lit((1 << _BITS * k) - 1))


def _levels(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], list[DataFrame]]:
    """Per order from 1 up, two tables: (context, symbol, own), the discounted share of an n-gram in
    its context, and (context, back), the weight of the next lower order. ``counts`` (context, symbol,
    n) are those of the highest; each lower order counts distinct left neighbours (continuations).
    An order's three discounts follow from its counts of counts. Also the tables staged for them."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, staged(
            levels[0].groupBy(_context(k - 1).alias("context"), "symbol")
            .agg(F.count(F.lit(1)).alias("n")), "continuations",
        ))
    out, used = [], []
    for level in levels:
        d1, d2, d3 = map(F.lit, _discounts(
            *level.agg(*[F.sum((F.col("n") == i).cast("int")) for i in (1, 2, 3, 4)]).first()
        ))
        times = [F.sum((F.col("n") == i).cast("int")) for i in (1, 2)] + [F.sum((F.col("n") > 2).cast("int"))]
        totals = staged(
            level.groupBy("context").agg(
                F.sum("n").alias("total"),
                ((times[0] * d1 + times[1] * d2 + times[2] * d3) / F.sum("n")).alias("back"),
            ), "contexts",
        )
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = level.join(totals, "context").select(
            "context", "symbol", ((F.col("n") - discount) / F.col("total")).alias("own")
        )
        out.append((own, totals.select("context", "back")))
        used.append(totals)
    return out, used + levels[:-1]


def _probabilities(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(context, symbol, p) of the distinct n-grams ``wanted`` (context, symbol), seen or not, by the
    model of ``counts``. Orders are interpolated from the uniform distribution over the characters
    seen and one unseen upwards; every join is by context."""
    asked = [wanted]  # the caller's table comes last and stays
    for k in range(ORDER - 2, -1, -1):
        asked.insert(0, staged(asked[0].select(_context(k).alias("context"), "symbol").distinct(), "asked"))
    levels, used = _levels(counts)
    lower, staged_lower = asked[0].withColumn("p", F.lit(1 / (levels[0][0].count() + 1))), []
    for k, (own, back) in enumerate(levels):
        below = lower.select(F.col("context").alias("_short"), "symbol", F.col("p").alias("_below"))
        lower = staged(
            asked[k].join(own, ["context", "symbol"], "left").join(back, "context", "left")
            .withColumn("_short", _context(max(0, k - 1))).join(below, ["_short", "symbol"])
            .select(
                "context", "symbol",
                (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("_below")).alias("p"),
            ), "probabilities",
        )
        unstaged(*staged_lower)
        staged_lower = [lower]
    unstaged(*asked[:-1], *used)
    return lower


def _scored(docs: DataFrame, ids: DataFrame, row: Column) -> DataFrame:
    """(_row, a struct; _doc, _lang, _bits, n_symbols) of every row, written once."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    portions = min(PORTIONS, n)
    blocks = lambda by: F.pmod(by, F.lit(n)).alias("block")
    rows = docs.select(
        row, F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang"), F.col("text").alias("_text"),
        blocks(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))),
    )
    trusted = ids.select("_t", blocks(F.xxhash64("_t")))
    of = lambda table, p: table.where(F.col("block") % portions == p).groupBy("block")
    grams = []
    for p in range(portions):
        grams.append(staged(
            of(rows.select("block", "_doc", "_text"), p).cogroup(of(trusted, p)).applyInArrow(_block_grams, _GRAMS),
            "block-ngrams",
        ))
        settle(docs)
    every = reduce(DataFrame.unionByName, grams)
    counts = staged(
        every.where("n > 0").groupBy("context", "symbol").agg(F.sum("n").alias("n")), "ngrams"
    )
    wanted = staged(every.select("context", "symbol").distinct(), "asked")
    likely = _probabilities(wanted, counts)
    unstaged(wanted, counts)
    bits = likely.select("context", "symbol", (-F.log2("p")).alias("bits"))
    schema = extended(rows.drop("_text", "block"), "_bits double, n_symbols bigint")
    scores = []
    for p, own in enumerate(grams):
        known = own.join(bits, ["context", "symbol"]).select("block", "at", "bits")
        scores.append(staged(
            of(rows, p).cogroup(known.groupBy("block")).applyInArrow(_score, schema), "scores"
        ))
        unstaged(own)
    unstaged(likely)
    return reduce(DataFrame.unionByName, scores)


def _quartiles(scored: DataFrame, trusted: DataFrame) -> tuple[DataFrame, dict]:
    """The last step to read the staged ids ``trusted``. Quartiles of the trusted documents' bits per symbol, (_l, low, middle, high) by language
    and those of all. Rates are rounded to a thousandth of a bit, so quantiles are exact over
    counts of few distinct values."""
    rates = staged(
        scored.where("n_symbols > 0").join(trusted, F.col("_doc") == F.col("_t"), "left_semi")
        .select("_lang", F.round(F.col("_bits") / F.col("n_symbols"), 3).alias("rate"))
        .groupBy("_lang", "rate").agg(F.count(F.lit(1)).alias("n")),
        "rates",
    )
    unstaged(trusted)
    quartiles = [
        F.expr(f"percentile(rate, {q}, n)").alias(name)
        for q, name in ((0.25, "low"), (0.5, "middle"), (0.75, "high"))
    ]
    each = rates.groupBy("_lang").agg(*quartiles).withColumnRenamed("_lang", "_l")
    return each, rates.agg(*quartiles).first().asDict()  # three numbers


def _judge(scored: DataFrame, each: DataFrame, overall: dict, fence: float, prior: int) -> DataFrame:
    value = lambda c: F.coalesce(c, F.lit(overall[c]).cast("double"))
    spread = F.greatest(value("high") - value("low"), F.lit(0.02))
    smooth = (F.col("_bits") + prior * value("middle")) / (F.col("n_symbols") + prior)
    return (
        scored.join(each, F.col("_lang").eqNullSafe(F.col("_l")), "left")
        .withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), smooth)))
        .withColumn("threshold", F.pow(F.lit(2.0), value("high") + fence * spread))
        .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    )


def _trusted(trusted: DataFrame) -> DataFrame:
    """The distinct ids, written once: every portion of the text and the quartiles read them."""
    return staged(trusted.select(F.col("doc_id").alias("_t")).where("_t is not null").distinct(), "trusted")


def judged(
    docs: DataFrame, trusted: DataFrame, fence: float = FENCE, prior: int = PRIOR_SYMBOLS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, lang, text): doc_id, lang, n_symbols, perplexity, threshold, kept.

    ``trusted`` holds the ids (doc_id) of trusted documents; the model is trained on all of them.
    Perplexity is two to the bits per symbol, where a text counts as if it had ``prior`` more symbols
    of its language's median, so that short texts are not judged by chance. A language's threshold
    comes from the quantiles of its trusted documents' bits: upper quartile plus ``fence`` times
    the spread between the quartiles. Languages without trusted text (null may be one) use
    those of all. Rejected are rows above their threshold; null and empty texts have no perplexity
    and stay. Without any trusted text nothing is rejected. Equal rows are judged alike.
    """
    ids = _trusted(trusted)
    scored = _scored(docs, ids, F.struct("doc_id").alias("_row"))
    return _judge(scored, *_quartiles(scored, ids), fence, prior).select(
        "_row.*", F.col("_lang").alias("lang"), "n_symbols", "perplexity", "threshold", "kept"
    )


def keep_good(
    docs: DataFrame, trusted: DataFrame, fence: float = FENCE, prior: int = PRIOR_SYMBOLS
) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, which are written once with
    their scores."""
    ids = _trusted(trusted)
    scored = _scored(docs, ids, whole_row(docs))
    each, overall = _quartiles(scored, ids)
    return _judge(scored, staged(each, "quartiles"), overall, fence, prior).where("kept").select("_row.*")
