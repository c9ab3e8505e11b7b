"""Personal data: fixed base patterns, and identifiers found by bootstrapped lexical contexts.

Base spans are e-mail and IP addresses, card numbers (Luhn) and phone numbers; they are the
seeds.  A *slot* is a base span or a candidate, a run of six or more characters of
identifiers with three digits or more outside of base spans.  The *patterns* of a slot are
the one, two and three lexical tokens (words of letters, ``:``, ``#``, ``=``) before it, with
nothing but blanks and punctuation between.  Slots make a graph of patterns and instances
(the lower-cased strings), weighted by occurrences, which Spark scores in ``ROUNDS`` rounds:

* a pattern's confidence is the reliability that its trusted instances bring to its
  occurrences in the *whole* corpus, slot or not: sum(n * reliability) / occurrences.  It is
  kept if it holds a word, with ``CONFIDENCE`` or more and at least ``SUPPORT`` different trusted instances, so
  that copies of a text prove nothing;
* a candidate's reliability is the greatest, over pattern lengths, of the mean confidence of
  the kept patterns over all its occurrences; with ``RELIABILITY`` or more it is trusted in
  the next round.

Each round keeps the ``MODEL`` best patterns, the size of the fitted model.  A candidate
after a kept pattern is a span of kind ``context``.

Scale: a pass over the texts collects the graph (summed in the tasks), a second one counts
the occurrences of patterns with enough support (a bitmap of bounded size tells the tasks
which), a third one marks.  Patterns that occur too often already in one of ``SHARE`` texts
to reach the confidence, were all their slots trusted, are not counted in full.  Rounds work on the graph's tables alone.

Edge cases: null and empty texts have no spans; texts are searched whole; rows are judged by
themselves, so ids and extra columns do not matter and equal texts get equal spans; repeated
rows add occurrences but no support; without seeds, or on an empty table, no pattern is kept.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.workspace import Workspace
from .common import free_name
from .phrases import Bitmap, _mix

# The base patterns and their bounds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "context")
_MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAIL_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (16, 19), (8, 15), 255

ROUNDS, SUPPORT, CONFIDENCE, RELIABILITY, MODEL = 3, 5, 0.6, 0.5, 4096
#: Tokens of a pattern.
LONGEST = 3
_CANDIDATE = re.compile(r"[A-Za-z0-9@._/+-]{6,}+")
_TOKEN = re.compile(r"[^\W\d_]+|[:#=]")
_GAP = re.compile(r"[^\w:#=]*")
#: One in so many texts is counted first, to leave out patterns that cannot reach the confidence any more.
SHARE = 64
#: Edges and tokens that a task holds before it hands its counts on.
HELD_EDGES, HELD_TOKENS = 200_000, 3_000_000

SPANS = "array<struct<kind: int, start: int, stop: int>>"
_SPANS = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "stop")]))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0  # no name begins before this
    for m in _MAIL_HOST.finditer(text):
        at = m.start()
        head = text[max(last, text.rfind("@", 0, at) + 1) : at]
        name = len(head) - len(head.rstrip(_MAIL_NAME))
        if name:
            yield at - name, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base patterns, by kind and start."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= IP_PART for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(map(m[0].count, "0123456789")) <= PHONE_DIGITS[1]:
                found.append((3, m.start(), m.end()))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that look like identifiers and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    found, i = [], 0
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        start = m.start() + len(run) - len(run.lstrip("@._/+-"))
        stop = m.end() - (len(run) - len(run.rstrip("@._/+-")))
        if stop - start < 6 or sum(map(run.count, "0123456789")) < 3:
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not any(a < stop and start < b for a, b in taken[i : i + 8]):
            found.append((start, stop))
    return found


def contexts(text: str, starts: list[int]) -> list[list[str]]:
    """The up to ``LONGEST`` tokens right before each place (places ascend)."""
    out, tokens, at = [], [], 0
    for start in starts:
        for m in _TOKEN.finditer(text, at, start):
            tokens.append(m)
        at = max(at, tokens[-1].end() if tokens else 0)
        del tokens[:-LONGEST]
        close = tokens and _GAP.fullmatch(text, tokens[-1].end(), start)
        out.append([m[0].lower() for m in tokens] if close else [])
        at = max(at, start)
    return out


def _name(token: str) -> int:
    return (xxhash.xxh3_64_intdigest(token) >> 1) or 1


def pattern_keys(tokens: list[str]) -> list[int]:
    """Keys of the patterns of one, two and three tokens that end with the last one."""
    names = [np.array([_name(t)], np.int64) for t in tokens]
    return [int(_mix(*names[-c:])[0] >> np.uint64(1)) for c in range(1, len(names) + 1)]


def slots(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bool]]]:
    """Base spans, and all slots (start, stop, seed)."""
    base = base_spans(text)
    found = [(a, b, True) for _, a, b in base] + [(a, b, False) for a, b in candidates(text, base)]
    return base, sorted(found)


def edges(docs: DataFrame, text_col: str) -> DataFrame:
    """key, length, pattern, instance, seed, n: the graph of patterns and instances."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = [*found]
            parts = [pattern_keys(p)[-1] for p, *_ in keys]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int64()),
                    pa.array([len(k[0]) for k in keys], pa.int32()),
                    pa.array([" ".join(k[0]) for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([k[2] for k in keys], pa.bool_()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["key", "length", "pattern", "instance", "seed", "n"],
            )
            found.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    text = t.as_py()
                    own = slots(text)[1]
                    for (a, b, seed), tokens in zip(own, contexts(text, [s[0] for s in own])):
                        for c in range(1, len(tokens) + 1):
                            found[tuple(tokens[-c:]), text[a:b].lower(), seed] += 1
            if len(found) > HELD_EDGES:
                yield rows()
        yield rows()

    schema = "key bigint, length int, pattern string, instance string, seed boolean, n bigint"
    found = docs.select(text_col).mapInArrow(collect, schema)
    return found.groupBy("key", "length", "pattern", "instance", "seed").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, text_col: str, wanted: Bitmap) -> DataFrame:
    """key, total: how often each wanted pattern's tokens follow each other in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        run: list[int] = []

        def rows() -> pa.RecordBatch:
            own = np.array(run, np.int64)
            run.clear()
            keys = []
            for c in range(1, LONGEST + 1):
                n = max(0, len(own) - c + 1)
                parts = [own[j : j + n] for j in range(c)]
                at = np.flatnonzero(np.all([p > 0 for p in parts], axis=0))
                if len(at):
                    key = (_mix(*[p[at] for p in parts]) >> np.uint64(1)).astype(np.int64)
                    keys.append(key[wanted.holds(key)])
            key, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts.astype(np.int64))], ["key", "total"])

        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    for token in _TOKEN.findall(t.as_py()):
                        name = names.get(token)
                        if name is None:
                            names[token] = name = _name(token.lower())
                        run.append(name)
                    run.append(0)
                    if len(names) > HELD_EDGES:
                        names.clear()
                    if len(run) > HELD_TOKENS:
                        yield rows()
        yield rows()

    return docs.select(text_col).mapInArrow(count, "key bigint, total bigint").groupBy("key").agg(F.sum("total").alias("total"))


def fit(
    docs: DataFrame,
    text_col: str = "text",
    *,
    rounds: int = ROUNDS,
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
    reliability: float = RELIABILITY,
    model: int = MODEL,
) -> list:
    """The kept patterns, at most ``model`` rows (key, pattern, support, confidence)."""
    spark = docs.sparkSession
    work = Workspace(spark)
    graph = work.table(edges(docs, text_col), "graph")
    able = graph.groupBy("key").agg(F.countDistinct("instance").alias("support")).where(F.col("support") >= support)
    able = work.table(able.select("key"), "able")
    # What occurs in a share of the texts alone so often that no trust can make up for it needs no full count.
    share = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SHARE)) == 0)
    least = occurrences(share, text_col, Bitmap(spark, able, able.count()))
    mass = graph.join(able, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    hopeless = F.coalesce(F.col("total"), F.lit(0)) * F.lit(confidence) > F.col("n")
    able = work.table(mass.join(least, "key", "left").where(~hopeless).select("key"), "hopeful")
    total = work.table(occurrences(docs, text_col, Bitmap(spark, able, able.count())), "total")
    # Every slot with a context has one pattern of one token, so those count an instance's occurrences.
    every = work.table(graph.where("not seed and length = 1").groupBy("instance").agg(F.sum("n").alias("all")), "every")
    graph = work.table(graph.join(able, "key", "left_semi"), "shared")

    trusted = graph.where("seed").select("instance").distinct().withColumn("r", F.lit(1.0))
    kept: list = []
    for k in range(rounds):
        brought = graph.join(trusted, "instance").groupBy("key").agg(
            F.min("pattern").alias("pattern"),
            F.min("length").alias("length"),
            F.sum(F.col("n") * F.col("r")).alias("mass"),
            F.countDistinct("instance").alias("support"),
        )
        scored = brought.join(total, "key").withColumn("confidence", F.least(F.lit(1.0), F.col("mass") / F.col("total")))
        good = scored.where((F.col("support") >= support) & (F.col("confidence") >= confidence) & F.col("pattern").rlike("[^:#= ]"))
        good = good.orderBy(F.desc("confidence"), F.desc("support"), "key").limit(model)
        good = work.table(good.select("key", "pattern", "length", "support", "confidence"), f"patterns{k}")
        before, kept = kept, good.drop("length").collect()
        if k == rounds - 1 or {r["key"] for r in kept} == {r["key"] for r in before}:
            break
        held = graph.where("not seed").join(good.select("key", "confidence"), "key")
        means = held.groupBy("instance", "length").agg(F.sum(F.col("n") * F.col("confidence")).alias("mass")).join(every, "instance")
        means = means.groupBy("instance").agg(F.max(F.col("mass") / F.col("all")).alias("r"))
        found = work.table(means.where(F.col("r") >= reliability), f"found{k}")
        trusted = graph.where("seed").select("instance").distinct().withColumn("r", F.lit(1.0)).unionByName(found)
    work.drop()
    return kept


def find_pii(docs: DataFrame, patterns: list, text_col: str = "text", result: str = "spans") -> tuple[DataFrame, str]:
    """The documents with one more column of type ``SPANS``, by kind and start, and that column's name."""
    keys = docs.sparkSession.sparkContext.broadcast(frozenset(r["key"] for r in patterns))

    @F.arrow_udf(SPANS)
    def find(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = keys.value
        for texts in it:
            out = []
            for t in texts:
                text = t.as_py() or ""
                base, own = slots(text) if kept else (base_spans(text), [])
                for (a, b, seed), tokens in zip(own, contexts(text, [s[0] for s in own])):
                    if not seed and not kept.isdisjoint(pattern_keys(tokens)):
                        base.append((KINDS.index("context"), a, b))
                out.append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
            yield pa.array(out, _SPANS)

    name = free_name(docs, result)
    return docs.withColumn(name, find(F.col(text_col))), name


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of the given kinds as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    chosen = F.filter(spans, lambda s: s["kind"].isin(*[KINDS.index(k) for k in kinds]))
    return F.array_join(F.transform(chosen, text), ",")
