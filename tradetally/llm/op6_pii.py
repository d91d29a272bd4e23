"""Personal data by bootstrapped contextual extraction.

Fixed formats (e-mail, IP address, card, phone) are found directly; they stay
in the result and are the seeds. Every identifier-like word (one that holds an
at sign or several digits) and every run of digit groups (joined by blanks, dots,
brackets or hyphens, with several digits in all), seed or not, is an instance, and
the words around it are its patterns. Over the pattern-instance graph of the whole corpus,
rounds of joins and sums score the patterns of each kind by the share of their
instances that are of that kind (an instance of no known kind is what is looked for,
so it counts half against a pattern), and the instances by a noisy-or over their
accepted patterns; seeds keep the score 1. Instances that accepted patterns
find with a high score join the seeds' kind.

Support and precision are the same for any size of the input. Accepted patterns
can thus be many; they meet the candidates' patterns by a join that spreads
each pattern over ``SPREAD`` tasks, and what is found returns to the texts by
their hashes.

Defined results: null text counts as empty and has no spans; equal rows are
all returned; a span that several kinds find equally well is of the first of
them in ``KINDS``; a found span inside another of its kind is left out; a corpus without seeds has no patterns; offsets count code
points, ends are exclusive; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import release, stored, table, text_once, with_fields

KINDS = ("email", "ip", "card", "phone")
#: Least share of a pattern's instances that are of its kind, least instances,
#: and least score of an instance that joins a kind.
PRECISION = 0.8
SUPPORT = 4
SCORE = 0.8
ROUNDS = 3
#: What an instance of no known kind counts against a pattern.
UNKNOWN = 0.5
#: Parts of a pattern's rows in joins.
SPREAD = 32
#: Digits that make a word an instance, and code points of context looked at.
DIGITS = 5
CONTEXT = 60
#: Graph rows that a task sums up before it sends them on.
GATHERED = 200_000

# fixed values: the formats looked for
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_RUN = re.compile(r"(?<!\w)\+?\(?[0-9]+(?:[ .()-]{1,3}[0-9]+)+(?!\w)")
_HINT = re.compile(r"[0-9@]")
_WORD_END = re.compile(r"\S*")
_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str):
    """Matches of the e-mail format, found from the at signs: each can only
    start at the left end of the run before its at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield m.start(), m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def patterns(text: str, start: int, end: int) -> tuple[str, str, str]:
    """Lexical patterns around a span: two words before it, the word before
    and the word behind it, and the word before it with the span's shape."""
    before = text[max(0, start - CONTEXT):start].lower().split()[-2:]
    behind = text[end:end + CONTEXT].lower().split()[:1]
    left, right = (before[-1] if before else "^"), (behind[0] if behind else "$")
    shape = re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", text[start:end].lower()))[:CONTEXT]
    return f"2 {' '.join(before) or '^'}", f"1 {left} _ {right}", f"s {left} {shape}"


def candidates(text: str, spans: list[tuple[str, int, int]]):
    """Identifier-like words outside of the spans, without punctuation around them."""
    taken = sorted((s, e) for _, s, e in spans)
    i, at = 0, 0
    while m := _HINT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _WORD_END.match(text, m.start()).end()
        at = max(end, m.end())
        while start < end and not text[start].isalnum() and text[start] not in "+@":
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        word = text[start:end]
        if "@" in word[1:] or sum(c.isdigit() for c in word) >= DIGITS:
            yield start, end


def runs(text: str, spans: list[tuple[str, int, int]]):
    """Runs of digit groups that do not touch the spans."""
    taken = sorted((s, e) for _, s, e in spans)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in _RUN.finditer(text):
        start, end = m.span()
        start += text[start] == "("
        before = bisect_left(starts, end)
        if (not before or reach[before - 1] <= start) and sum(c.isdigit() for c in m.group()) >= DIGITS:
            yield start, end


def wanted(text: str, spans: list[tuple[str, int, int]]) -> set[tuple[int, int]]:
    """All that patterns may find outside of the spans."""
    return {*candidates(text, spans), *runs(text, spans)}


def outermost(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of (kind, start, end) that no other of their kind holds."""
    out, reach = [], {}
    for kind, start, end in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if end > reach.get(kind, -1):
            out.append((kind, start, end))
            reach[kind] = end
    return out


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _instance(text: str, start: int, end: int) -> int:
    return _key("".join(c for c in text[start:end].lower() if c.isalnum() or c == "@"))


def graph(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct (pattern, instance, kind); kind is null if the instance is no seed."""
    def edges(batches):
        def send():
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int32())], ["pattern", "instance", "kind"])
            found.clear()

        found: set[tuple] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text or not _HINT.search(text):
                    continue
                spans = base_spans(text)
                marked = [(KINDS.index(k), s, e) for k, s, e in spans]
                for kind, s, e in marked + [(None, s, e) for s, e in wanted(text, spans)]:
                    x = _instance(text, s, e)
                    found.update((_key(p), x, kind) for p in patterns(text, s, e))
                if len(found) > GATHERED:
                    yield from send()
        yield from send()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(
        edges, "pattern long, instance long, kind int").distinct()


def by_pattern(rows: DataFrame, accepted: DataFrame, *lot: str) -> DataFrame:
    """``rows`` joined with ``accepted`` by pattern; a pattern's rows are dealt by
    the columns ``lot``, so that those of a frequent one do not meet in one task."""
    part = F.pmod(F.xxhash64(*lot), F.lit(SPREAD)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return rows.withColumn("part", part).join(accepted.withColumn("part", each), ["pattern", "part"]).drop("part")


def learn(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Accepted patterns: (pattern, kind, confidence)."""
    links = stored(spark, graph(docs, text_col), "pii-graph")
    seeds = stored(spark, links.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"), F.lit(0.0).alias("more")), "pii-seeds")
    pairs = stored(spark, links.select("pattern", "instance").distinct(), "pii-pairs")
    # every instance weighs as unknown, seeds the rest of 1, and what is found the rest of its score
    known = seeds.groupBy("instance").agg(F.lit(1 - UNKNOWN).alias("known"))
    size = pairs.join(known, "instance", "left").groupBy("pattern").agg(
        F.count("*").alias("n"), (F.count("*") * UNKNOWN + F.coalesce(F.sum("known"), F.lit(0.0))).alias("weight"))
    size = stored(spark, size.where(F.col("n") >= SUPPORT).select("pattern", "weight"), "pii-sizes")
    scores, accepted = seeds, None
    for _ in range(ROUNDS):
        sums = pairs.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.sum("more").alias("more"))
        rated = sums.join(size, "pattern").withColumn("confidence", F.col("good") / (F.col("weight") + F.col("more") + 0.5))
        accepted = stored(spark, rated.where(F.col("confidence") >= PRECISION).select("pattern", "kind", "confidence"), "pii-patterns")
        found = by_pattern(pairs, accepted, "instance").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        found = found.where(F.col("score") >= SCORE).withColumn("more", F.col("score") - UNKNOWN).join(seeds.select("instance").distinct(), "instance", "left_anti")
        scores = stored(spark, seeds.unionByName(found), "pii-scores")
    return accepted


def learnt_spans(spark: SparkSession, docs: DataFrame, accepted: DataFrame, text_col: str) -> DataFrame:
    """(text_key, learnt): the spans (kind, start, end) that accepted patterns
    find in the text of that SHA-256."""
    def offer(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                key, out = b.column(0).slice(lo, 1000).to_pylist(), set()
                for k, text in zip(key, b.column(1).slice(lo, 1000).to_pylist()):
                    if text and _HINT.search(text):
                        for s, e in wanted(text, base_spans(text)):
                            out.update((k, s, e, _key(p)) for p in patterns(text, s, e))
                rows = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:])],
                                                 ["text_key", "start", "end", "pattern"])

    text = F.col(text_col).cast("string")
    offered = docs.select(F.sha2(text, 256).alias("text_key"), text.alias("text")).mapInArrow(
        offer, "text_key string, start long, end long, pattern long").distinct()
    doubt = by_pattern(offered, accepted, "text_key", "start").groupBy("text_key", "start", "end", "kind").agg(
        F.sum(F.log(1 - F.col("confidence"))).alias("doubt"))
    best = doubt.groupBy("text_key", "start", "end").agg(F.min(F.struct("doubt", "kind")).alias("best"))
    best = best.where(1 - F.exp("best.doubt") >= SCORE)
    return stored(spark, best.groupBy("text_key").agg(F.collect_list(
        F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("learnt")), "pii-learnt")


def find(spark: SparkSession, docs: DataFrame, text_col: str = "text", out_col: str = "spans",
         keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not named) with a column of
    spans (kind, start, end, base), ordered by kind as in ``KINDS`` and start;
    ``base`` marks the fixed formats."""
    rest = [c for c in keep or docs.columns if c != out_col]
    return _marked(spark, docs, text_col, rest, out_col)


def cleaned(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind, as
    ``redact`` of ``find``, in one pass over the texts."""
    return _marked(spark, docs, text_col, docs.columns, None)


def _marked(spark: SparkSession, docs: DataFrame, text_col: str, rest: list[str], out_col: str | None) -> DataFrame:
    rows, at, own = text_once(docs, text_col, rest)
    read, accepted = rows.columns[at], learn(spark, docs, text_col)
    # both names are this function's own, and none of the columns'
    learnt_at, key_at = f"_learnt_{uuid.uuid4().hex}", f"_key_{uuid.uuid4().hex}"
    if accepted.isEmpty():
        rows = rows.withColumn(learnt_at, F.lit(None).cast("array<struct<kind:int,start:long,end:long>>"))
    else:
        more = learnt_spans(spark, docs, accepted, text_col).select(F.col("text_key").alias(key_at), F.col("learnt").alias(learnt_at))
        rows = rows.withColumn(key_at, F.sha2(read, 256)).join(more, key_at, "left").select(*rows.columns, learnt_at)

    def mark(text: str, learnt: list[dict]) -> list[dict]:
        if not text or not _HINT.search(text):
            return []
        out = [(KINDS.index(k), s, e, True) for k, s, e in base_spans(text)]
        out += [(*x, False) for x in outermost([(x["kind"], x["start"], x["end"]) for x in learnt or ()])]
        return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(out)]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                texts = s.column(at).to_pylist()
                spans = [mark(t, x) for t, x in zip(texts, s.column(s.num_columns - 1).to_pylist())]
                kept = s.columns[own:-1]
                if out_col is None:
                    kept[rest.index(text_col)] = pa.array(map(replaced, texts, spans), pa.string())
                    yield pa.RecordBatch.from_arrays(kept, rest)
                else:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, kind)], [*rest, out_col])
            release()

    schema = docs.select(*rest).schema if out_col is None else with_fields(docs.select(*rest), **{out_col: _SPANS})
    return rows.mapInArrow(run, schema)


def replaced(text: str | None, spans: list[dict] | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are one."""
    parts, at = [], 0
    for x in sorted(spans or (), key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            parts += [text[at:x["start"]], f"<{x['kind'].upper()}>"]
        at = max(at, x["end"])
    return text if not parts else "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Every span replaced by its kind in angle brackets; overlapping spans are one."""
    def run(batches):
        for b in batches:
            names = b.schema.names
            t, s = names.index(text_col), names.index(spans_col)
            out = list(map(replaced, b.column(t).to_pylist(), b.column(s).to_pylist()))
            cols = [pa.array(out, pa.string()) if i == t else b.column(i) for i in range(len(names)) if i != s]
            yield pa.RecordBatch.from_arrays(cols, [n for n in names if n != spans_col])

    return docs.mapInArrow(run, docs.drop(spans_col).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = find(spark, docs, keep=["doc_id"])
    base = F.filter("spans", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return spans.select(
        "doc_id", *(count(k) for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
