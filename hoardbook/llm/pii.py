"""Personal data: fixed rules give seeds; seeds induce lexical patterns; a pattern-instance graph,
scored in rounds, finds identifiers that no rule knows.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.common import extended, staged

# The rules' kinds in order.
KINDS = ("email", "ip", "card", "phone")
# Written so that no text makes them step back over a long run: a mail address grows to the left
# of its "@", and a number starts where its digits start, which changes no match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_EDGE = ".,;:!?()[]{}<>\"'%$#*&|"
_DIGIT, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")

# A pattern needs so many known instances, and that share of all it extracts; an instance that
# probability, from two patterns or more.
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE, ROUNDS = 5, 0.8, 0.95, 2


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, by start, then kind."""
    found, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = m.start()
            done = max(done, text.rfind("@", done, at) + 1)
            start = at - (at - done - len(text[done:at].rstrip(_LOCAL)))
            if start < at:
                found.append((start, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _word_before(text: str, end: int) -> tuple[str, int]:
    """The last word of the 80 characters before ``end``, and where it starts."""
    first = max(0, end - 80)
    part = text[first:end].rstrip()
    word = part.rsplit(None, 1)[-1] if part else ""
    return word, first + len(part) - len(word)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind or -1, instance, patterns) of the words with a digit or "@" that may be
    identifiers: those that touch a base span stand for it, others need six digits or an "@".
    Patterns are the word's shape, and the one and the two words before it."""
    out, done, at = [], 0, 0
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        while at < len(base) and base[at][2] <= mark.start():
            at += 1
        if at < len(base) and base[at][0] <= mark.start():
            start, kind, end = base[at]
        else:
            kind, here = -1, mark.start()
            left = text[done:here]
            start = here - len(left) + len(left.rstrip()) if left[-1:].isspace() else here - len((left.split() or [""])[-1])
            tail = re.compile(r"\S+").match(text, here)
            end = tail.end()
            word = text[start:end]
            start += len(word) - len(word.lstrip(_EDGE))
            end -= len(word) - len(word.rstrip(_EDGE))
            if end <= start:
                done = tail.end()
                continue
        done = max(end, mark.end())
        instance = text[start:end]
        if kind < 0 and "@" not in instance and len(_DIGIT.findall(instance)) < 6:
            continue
        one, one_at = _word_before(text, start)
        two, _ = _word_before(text, one_at)
        one, two = (_DIGIT.sub("0", w.lower())[-40:] for w in (one, two))
        shape = _LETTERS.sub("a", _DIGIT.sub("9", instance[:200]))[:60]
        out.append((start, end, kind, instance[:200].lower(), [f"s {shape}", f"1 {one}", f"2 {two} {one}"]))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_MENTION = pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()),
    ("patterns", pa.list_(pa.string())),
])
_SCHEMA = (
    "array<struct<start:bigint,kind:int,end:bigint>>",
    "array<struct<start:bigint,end:bigint,kind:int,instance:string,patterns:array<string>>>",
)


def _scan(batches):
    for batch in batches:
        base, seen = [], []
        for text in batch.column("_text").to_pylist():
            spans = base_spans(text or "")
            base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
            seen.append([
                dict(zip(("start", "end", "kind", "instance", "patterns"), m))
                for m in mentions(text or "", spans)
            ])
        rest = batch.drop_columns(["_text"])
        yield pa.RecordBatch.from_arrays(
            rest.columns + [pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_MENTION))],
            rest.schema.names + ["base", "_mentions"],
        )


def discover(
    mentions: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT,
    confidence: float = LEAST_CONFIDENCE, score: float = LEAST_SCORE,
) -> DataFrame:
    """(instance, kind): unknown instances of ``mentions`` (instance, kind or -1, pattern) that
    patterns of known ones extract.

    Each round a pattern's confidence for a kind is the share of known instances of that kind
    among all it extracts; confident patterns with enough support vote, an instance is accepted
    with 1 - product(1 - confidence) over two patterns or more, and known from then on. Only
    distinct (pattern, instance) edges are counted, so frequent mentions weigh no more.
    """
    edges = staged(
        mentions.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges"
    )
    known = edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("known"))
    for _ in range(rounds):
        votes = edges.join(known, "instance", "left")
        patterns = votes.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum((F.col("known") == k).cast("int")).alias(f"n{k}") for k in range(len(KINDS))],
        )
        best = F.greatest(*[F.coalesce(f"n{k}", F.lit(0)) for k in range(len(KINDS))])
        kind = F.coalesce(*[
            F.when(F.col(f"n{k}") == F.col("hits"), F.lit(k)) for k in range(len(KINDS))
        ])
        good = (
            patterns.withColumn("hits", best).where(F.col("hits") >= support)
            .select("pattern", kind.alias("for"), (F.col("hits") / F.col("n")).alias("confidence"))
            .where(F.col("confidence") >= confidence)
        )
        new = (
            votes.where("known is null").select("pattern", "instance").join(good, "pattern")
            .groupBy("instance", "for").agg(
                (1 - F.exp(F.sum(F.log(1.000001 - F.col("confidence"))))).alias("score"),
                F.count(F.lit(1)).alias("patterns"),
            )
            .where((F.col("score") >= score) & (F.col("patterns") >= 2))
            .groupBy("instance").agg(F.max_by("for", F.struct("score", -F.col("for"))).alias("known"))
        )
        known = staged(known.unionByName(new), "pii-known")
    return known.join(edges.where("kind >= 0").select("instance").distinct(), "instance", "left_anti").select(
        "instance", F.col("known").alias("kind")
    )


def personal_spans(docs: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """Per row of ``docs`` (``keys``, text): ``base`` and ``extra``, arrays of (start, kind, end).

    ``base`` holds the rules' matches, kinds 0 email, 1 ip, 2 card, 3 phone, by start, then kind;
    ``extra`` the mentions that ``discover`` found, with kind 4 + the kind. Positions are code
    points, ends exclusive. Null and empty texts have none; equal rows have equal spans; an empty
    table stays empty.
    """
    keys = keys or ["doc_id"]
    rows = docs.select(
        F.monotonically_increasing_id().alias("_id"), F.struct(*keys).alias("_keys"),
        F.col("text").alias("_text"),
    )
    schema = extended(rows.drop("_text"), f"base {_SCHEMA[0]}, _mentions {_SCHEMA[1]}")
    found = staged(rows.mapInArrow(_scan, schema), "pii")
    each = found.select("_id", F.explode("_mentions").alias("m")).select("_id", "m.*")
    new = discover(
        each.select("instance", "kind", F.explode("patterns").alias("pattern")), **options
    )
    extra = (
        each.where("kind < 0").join(new.withColumnRenamed("kind", "as"), "instance")
        .groupBy("_id").agg(F.sort_array(F.collect_list(
            F.struct("start", (F.col("as") + len(KINDS)).cast("int").alias("kind"), "end")
        )).alias("extra"))
    )
    none = F.array().cast(_SCHEMA[0])
    return found.select("_id", "_keys", "base").join(extra, "_id", "left").select(
        "_keys.*", "base", F.coalesce("extra", none).alias("extra")
    )
