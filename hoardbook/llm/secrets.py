"""Secret scans: fixed rules, and character Markov models of random strings against words.

Built from DataFrame functions only. A rule's matches are located natively: the pieces that
``split`` leaves and the matches that ``regexp_extract_all`` finds alternate in the text, so a running
sum of their lengths gives every position in code points.
"""

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hoardbook.llm.common import staged

# The rules, in the order of their kinds. Only ``assign`` needs a later length test:
# for the others a run that is too short never hides one that is long enough.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex")

LEAST_LENGTH = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
# What parts the names, path segments and keys of a candidate.
SEPARATORS = "/=_-"
# The symbols of candidates; a symbol's code is its place, from 1.
ALPHABET = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "+" + SEPARATORS
_LETTERS, _FIRST_SEPARATOR, _FILL = 52, ALPHABET.index("/") + 1, ALPHABET.index("=") + 1
SYMBOLS = len(ALPHABET) + 1
PLAIN = ALPHABET[: _FIRST_SEPARATOR - 1]
BACK_OFF = 8
WINDOW = 1 << 18  # symbols of a candidate that are taken apart at a time
SAMPLE_DOCS = 2_000
# Odds of 1 to 160,000 against a candidate being random, in natural units, and a least gain per symbol.
LEAST_LLR, LEAST_LLR_PER_SYMBOL = 12.0, 0.4


def matches(text: str, pattern: str, group: int | None = None) -> Column:
    """Array of (gap, length, value length): the characters before each match since the last one,
    the match's, and its group's. Null where nothing matches."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = (
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else found
    )
    gaps = F.split(text, pattern, -1)
    triples = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")),
        lambda gap, both: F.struct(
            F.length(gap).cast("bigint").alias("gap"),
            F.length(both["m"]).cast("bigint").alias("length"),
            F.length(both["v"]).cast("bigint").alias("value"),
        ),
    )
    return F.when(F.col(text).rlike(pattern), triples)


def located(rows: DataFrame, column: str, kind: int, extra: list[str] | None = None) -> DataFrame:
    """(_id, _at, start, end, kind, value) of the triples in ``column``."""
    order = W.partitionBy("_id").orderBy("_at")
    return (
        rows.where(F.col(column).isNotNull())
        .select("_id", F.posexplode(column).alias("_at", "_m"), *(extra or []))
        .withColumn("end", F.sum(F.col("_m.gap") + F.col("_m.length")).over(order))
        .withColumn("start", F.col("end") - F.col("_m.length"))
        .select(
            "_id", "_at", "start", "end", F.lit(kind).alias("kind"), F.col("_m.value").alias("value"),
            *(extra or []),
        )
    )


def symbol_pairs(tokens: DataFrame, token: str, keep: list[str]) -> DataFrame:
    """``keep`` and each pair (a, b) of neighbouring symbols of the tokens."""
    cut = tokens.select(*keep, F.split(token, "").alias("_s"))
    pair = F.zip_with(
        F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", F.lit(2), F.size("_s")),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return cut.select(*keep, F.explode(pair).alias("_p")).select(*keep, "_p.a", "_p.b")


def train(samples: DataFrame) -> DataFrame:
    """(a, b, llr) for all pairs of plain symbols, from labelled samples (token, random): the log of how
    much likelier ``b`` follows ``a`` in random strings than in ordinary ones. What follows a symbol is
    estimated from its own counts and, as if seen ``BACK_OFF`` times more, from how often each
    symbol occurs at all, so that a pair seen in neither still tells capitals from common letters."""
    n = len(PLAIN)
    pairs = symbol_pairs(samples, "token", ["random"]).groupBy("a", "b").agg(
        F.sum(F.col("random").cast("int")).alias("r"),
        F.sum(1 - F.col("random").cast("int")).alias("w"),
    )
    symbol = lambda place: F.substring(F.lit(PLAIN), place + 1, F.lit(1))
    grid = samples.sparkSession.range(n * n, numPartitions=1).select(
        symbol((F.col("id") / n).cast("int")).alias("a"), symbol((F.col("id") % n).cast("int")).alias("b")
    )
    counted = grid.join(pairs, ["a", "b"], "left").fillna(0, ["r", "w"])

    def likely(c: str) -> Column:
        alone = (F.sum(c).over(W.partitionBy("b")) + 1) / (F.sum(c).over(W.partitionBy()) + n)
        return (F.col(c) + BACK_OFF * alone) / (F.sum(c).over(W.partitionBy("a")) + BACK_OFF)

    return counted.select("a", "b", F.log(likely("r") / likely("w")).alias("llr"))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random) from ``docs`` (doc_id, text): of the ``sample_docs`` documents whose ids hash
    lowest (the bound of the training sample), the words and identifiers of 6 to 64 letters
    are ordinary; digests of as many ids, in hexadecimal and base 64, are random."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id"
    ).limit(sample_docs)
    words = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z_-]{5,63})"), F.lit(1)))
        .alias("token")
    )
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    randoms = ids.select(F.explode(F.array(digest, F.base64(F.unhex(digest)))).alias("token"))
    return words.withColumn("random", F.lit(False)).unionByName(
        randoms.withColumn("random", F.lit(True))
    )


def matrix(model: DataFrame) -> Column:
    """The model of ``train`` as one array of ``SYMBOLS`` squared numbers, at code of a times ``SYMBOLS``
    plus code of b: gains of pairs, 0 for pairs with a separator, which count for neither side: words
    joined by them stay words. The driver gets at most that many rows."""
    gains = [0.0] * SYMBOLS**2
    for r in model.collect():
        a, b = ALPHABET.find(r["a"]) + 1, ALPHABET.find(r["b"]) + 1
        if 0 < a < _FIRST_SEPARATOR and 0 < b < _FIRST_SEPARATOR:
            gains[a * SYMBOLS + b] = r["llr"]
    return F.from_json(F.lit(json.dumps(gains)), "array<double>")


_CODES = [0] * 128
for _code, _symbol in enumerate(ALPHABET, 1):
    _CODES[ord(_symbol)] = _code


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _set(state: Column, names: tuple[str, ...], **changes: Column) -> Column:
    return F.struct(*[(changes[n] if n in changes else state[n]).alias(n) for n in names])


# Where the reading of a candidate stands: symbols read, code of the last one, start of the part it is
# in, last letter; the stretch under way (sum, first symbol, where its first part starts, peak, place
# of the peak, where the part of the peak ends, 0 if not yet known, and the last letter up to there);
# the stretch found last, grown to its parts (start, 0 if none, end, 0 if not yet known, and the last
# letter up to there); the spans found.
_STATE = (
    "at", "code", "part", "letter", "total", "first", "open", "peak", "last", "close", "close_letter",
    "from", "to", "to_letter", "done",
)


def _pushed(s: Column) -> Column:
    end = F.when(s["to"] > 0, s["to"]).otherwise(s["at"])
    letter = F.when(s["to"] > 0, s["to_letter"]).otherwise(s["letter"])
    good = (s["from"] > 0) & (end - s["from"] + 1 >= LEAST_LENGTH) & (letter >= s["from"])
    span = F.array(F.struct(s["from"].alias("first"), end.alias("last")))
    return F.when(good, F.concat(s["done"], span)).otherwise(s["done"])


def _closed(s: Column) -> Column:
    """The stretch under way becomes the one found last if it is good; one that shares a part with the
    one before joins it."""
    good = (s["peak"] >= LEAST_LLR) & (s["peak"] >= LEAST_LLR_PER_SYMBOL * (s["last"] - s["first"] + 1))
    joins = (s["from"] > 0) & ((s["to"] == 0) | (s["to"] >= s["open"]))
    return F.when(good, _set(s, _STATE, **{
        "done": F.when(joins, s["done"]).otherwise(_pushed(s)),
        "from": F.when(joins, F.least(s["from"], s["open"])).otherwise(s["open"]),
        "to": s["close"], "to_letter": s["close_letter"],
    })).otherwise(s)


def _step(gains: Column):
    def ended(end: Column, last: Column, at: Column, code: Column) -> Column:
        """Where a part ends: before the next separator, after the "=" that fill a key up."""
        here = F.when(code == _FILL, at).otherwise(at - 1)
        return (
            F.when((end == 0) & (last > 0) & (code >= _FIRST_SEPARATOR), here)
            .when((end > 0) & (end == at - 1) & (code == _FILL), at).otherwise(end)
        )

    def step(s: Column, symbol: Column) -> Column:
        code = F.element_at(F.lit(_CODES), F.ascii(symbol) + 1)

        def with_code(c: Column) -> Column:
            at = s["at"] + 1
            # Neither a "=" nor the stretch under way can lengthen what was found.
            over = (s["to"] > 0) & ~((s["to"] == at - 1) & (c == _FILL)) & (s["open"] > s["to"])
            close, to = ended(s["close"], s["last"], at, c), ended(s["to"], s["from"], at, c)
            known = lambda old, new, letter: F.when((old == 0) & (new > 0), s["letter"]).otherwise(letter)
            return _let(_set(
                s, _STATE, **{
                    "at": at, "part": F.when(c >= _FIRST_SEPARATOR, at + 1).otherwise(s["part"]),
                    "code": c, "letter": F.when(c <= _LETTERS, at).otherwise(s["letter"]),
                    "total": s["total"] + F.element_at(gains, s["code"] * SYMBOLS + c + 1),
                    "close": close, "close_letter": known(s["close"], close, s["close_letter"]),
                    "from": F.when(over, 0).otherwise(s["from"]), "to": F.when(over, 0).otherwise(to),
                    "to_letter": known(s["to"], to, s["to_letter"]),
                    "done": F.when(over, _pushed(s)).otherwise(s["done"]),
                }), moved)

        return _let(code, with_code)

    def moved(s: Column) -> Column:
        zero = F.lit(0.0)
        stop = (s["total"] <= 0) | (s["total"] < s["peak"] - LEAST_LLR)
        higher = s["total"] > s["peak"]
        return (
            F.when(stop, _let(_closed(s), lambda c: _set(
                c, _STATE, total=zero, peak=zero, last=F.lit(0), close=F.lit(0), first=c["at"] + 1, open=c["part"]
            )))
            .when(higher, _set(s, _STATE, peak=s["total"], last=s["at"], close=F.lit(0)))
            .otherwise(s)
        )

    return step


def stretches(token: Column, gains: Column) -> Column:
    """Array of (first, last): the parts of a candidate, from 1, that hold its best-scoring stretches.

    A stretch starts where the running sum of gains leaves zero and ends at its peak, once the sum has
    fallen to zero or ``LEAST_LLR`` below the peak. Kept are those with ``LEAST_LLR`` in all and
    ``LEAST_LLR_PER_SYMBOL`` on average, grown to the separators around them and over the "=" that fill
    a key up; those that grow into the same part are one. Spans of less than ``LEAST_LENGTH`` symbols or
    without a letter drop out. Symbols are read once, ``WINDOW`` of them at a time.
    """
    start = F.struct(*[
        {"total": F.lit(0.0), "peak": F.lit(0.0), "done": F.array().cast("array<struct<first:int,last:int>>")}
        .get(n, F.lit(1 if n in ("part", "first", "open") else 0)).alias(n) for n in _STATE
    ])
    step = _step(gains)
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def window(outer: Column, begin: Column) -> Column:
        symbols = F.split(F.substring(token, begin, F.lit(WINDOW)), "")
        inner = F.aggregate(symbols, outer["s"], step)
        return _let(inner, lambda s: F.struct(
            _set(s, _STATE, done=empty).alias("s"), F.concat(outer["all"], F.array(s["done"])).alias("all")
        ))

    def finish(outer: Column) -> Column:
        last = _let(_closed(outer["s"]), _pushed)
        return F.concat(F.flatten(outer["all"]), last)

    begins = F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1)), F.lit(WINDOW))
    return F.aggregate(begins, F.struct(start.alias("s"), F.array().cast(
        "array<array<struct<first:int,last:int>>>").alias("all")), window, finish)


def outside(start: Column, length: Column, base: Column) -> Column:
    """Array of (at, length): what is left of a candidate outside the ``base`` spans, which are sorted by
    start; ``at`` counts from 1 within the candidate."""
    pieces = "array<struct<at:int,length:int>>"

    def piece(a: Column, until: Column) -> Column:
        n = (until - a["next"]).cast("int")
        here = F.array(F.struct((a["next"] - start + 1).cast("int").alias("at"), n.alias("length"))).cast(pieces)
        return F.when(n >= LEAST_LENGTH, F.concat(a["done"], here)).otherwise(a["done"])

    end = start + length
    return F.aggregate(
        F.coalesce(base, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")),
        F.struct(start.alias("next"), F.array().cast(pieces).alias("done")),
        lambda a, b: F.struct(
            F.greatest(a["next"], b["end"]).alias("next"), piece(a, F.least(b["start"], end)).alias("done")
        ),
        lambda a: piece(a, end),
    )


def secret_spans(
    docs: DataFrame, keys: list[str] | None = None, model: DataFrame | None = None,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """Per row of ``docs`` (``keys``, text): ``base`` and ``extra``, arrays of (start, kind, end).

    ``base`` holds the rules' matches, kind 0 assign, 1 access, 2 hex, sorted by start, then kind.
    ``extra`` (kind 3, markov) holds strings of ``LEAST_LENGTH`` and more symbols with a letter, outside
    the base spans, of which the random model explains some stretch better by ``LEAST_LLR`` in all and
    ``LEAST_LLR_PER_SYMBOL`` on average: names and path segments beside a key neither hide it nor belong
    to it. Positions are code points, ends exclusive. Null and
    empty texts have none; equal rows have equal spans, null keys are keys like any other; an empty table
    stays empty; columns other than ``keys`` and text may bear any name. A text is searched whole, in one
    task; a candidate of any length is read ``WINDOW`` symbols at a time.
    """
    keys = keys or ["doc_id"]
    if model is None:
        model = train(labelled_samples(docs.select("doc_id", "text"), sample_docs))
    gains = matrix(model)
    # Everything later reads this narrow table; texts are scanned once.
    found = staged(
        docs.select(
            F.monotonically_increasing_id().alias("_id"),
            F.struct(*keys).alias("_keys"),
            matches("text", ASSIGN, 1).alias("_assign"), matches("text", ACCESS).alias("_access"),
            matches("text", HEX).alias("_hex"), matches("text", CANDIDATE).alias("_candidate"),
            F.when(
                F.col("text").rlike(CANDIDATE),
                F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)),
            ).alias("_tokens"),
        ),
        "secrets",
    )
    base = (
        located(found, "_assign", 0).where(F.col("value") >= LEAST_ASSIGNED)
        .unionByName(located(found, "_access", 1)).unionByName(located(found, "_hex", 2))
        .groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("base"))
    )
    tokens = located(found, "_candidate", 3).join(
        found.where("_tokens is not null").select("_id", F.posexplode("_tokens").alias("_at", "token")),
        ["_id", "_at"],
    ).where(F.col("token").rlike("[A-Za-z]")).join(base, "_id", "left").withColumn(
        "_base", F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    )
    pieces = tokens.select(
        "_id", "start", "token", F.explode(outside(F.col("start"), F.length("token").cast("bigint"), F.col("_base"))).alias("_p")
    ).select("_id", (F.col("start") + F.col("_p.at") - 1).alias("start"), F.expr("substring(token, _p.at, _p.length)").alias("token"))
    scored = pieces.select("_id", "start", F.explode(stretches(F.col("token"), gains)).alias("_s"))
    extra = (
        scored.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(
            (F.col("start") + F.col("_s.first") - 1).alias("start"), F.lit(3).alias("kind"),
            (F.col("start") + F.col("_s.last")).alias("end"),
        ))).alias("extra"))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (
        found.select("_id", "_keys").join(base, "_id", "left").join(extra, "_id", "left")
        .select(
            "_keys.*", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra")
        )
    )


def span_text(spans: Column, kinds) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        )), ",",
    )


def kind_count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
