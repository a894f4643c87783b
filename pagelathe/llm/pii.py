"""Personal data by patterns and by bootstrapped contextual extraction.

Base kinds come from fixed patterns. They seed the bootstrap. The words around an
entity are its lexical patterns: the word before, the two before, the word behind,
and one before with one behind. Its other instances are what else stands in such a
place: tokens with a digit, of any length, and runs of digit groups ('123 45 6789').
Spark scores the pattern-instance graph in rounds, both ways: a pattern's confidence
is the share of its occurrences in the whole corpus that hold instances, each counted
with its confidence, its support the number of distinct instances more likely right
than wrong; an instance's confidence is 1 for a base entity, else that at least one
of its confident patterns is right. After the last round the instances in places of
confident patterns are reported as spans of kind `context`. Tokens without a digit
(names, addresses in words) are out of reach.

The total occurrences of patterns are counted over all texts for every pattern
with enough distinct instances. Workers hold those patterns if there are at most
MOST_HELD; beyond, all patterns are counted and joined. Both give the same counts.

Defined cases: a null text is empty; an empty text has no spans; repeated rows
each get their result; extra columns are ignored; a null doc_id is passed on.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, materialize, spread_join, table

# Kinds in order, and what patterns match.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>*#"

MOST_HELD = 200_000
#: Distinct known instances and share of known occurrences that a pattern needs; rounds of the bootstrap.
SUPPORT, PRECISION, ROUNDS = 5, 0.8, 3


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


#: Stands for the entity in a pattern.
SLOT = "_"
_GROUP = re.compile(r"[0-9]+(?:[-/.][0-9]+)*")


def patterns(before: list[str], after: list[str]) -> list[str]:
    """The lexical patterns of a place from the two words before it and the one behind."""
    left = [w.lower().strip(EDGES) for w in before[-2:]]
    right = after[0].lower().strip(EDGES) if after else ""
    out = []
    if left and left[-1]:
        out.append(f"{left[-1]} {SLOT}")
        if len(left) == 2 and left[0]:
            out.append(f"{left[0]} {left[1]} {SLOT}")
    if right:
        out.append(f"{SLOT} {right}")
        if left and left[-1]:
            out.append(f"{left[-1]} {SLOT} {right}")
    return out


def value_of(text: str) -> str:
    """128 bits of an instance: values of any length have rows of one size."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[dict]:
    """Base entities, tokens with a digit and runs of digit groups, each with its patterns."""
    if not base and not _DIGIT.search(text):
        return
    starts, ends = array("q"), array("q")
    for m in _WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    taken = sorted((a, b) for _, a, b in base)
    word = lambda k: text[starts[k] : ends[k]]

    def place(known: bool, a: int, b: int, first: int, last: int, value: str) -> dict:
        around = patterns([word(k) for k in range(max(0, first - 2), first)], [word(last + 1)] if last + 1 < len(starts) else [])
        return {"known": known, "start": a, "stop": b, "value": value, "patterns": around}

    for kind, a, b in base:
        yield place(True, a, b, bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, f"{kind}{value_of(text[a:b])}")
    t, k = 0, 0
    while k < len(starts):
        first = k
        k += 1
        if not _DIGIT.search(text, starts[first], ends[first]):
            continue
        if _GROUP.fullmatch(text, starts[first], ends[first]):
            while k < len(starts) and _GROUP.fullmatch(word(k).rstrip(EDGES)) and text[ends[k - 1] - 1] not in EDGES:
                k += 1
        whole = text[starts[first] : ends[k - 1]]
        core = whole.strip(EDGES)
        a = starts[first] + whole.find(core)
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        if core and not (t < len(taken) and taken[t][0] < a + len(core)):
            yield place(False, a, a + len(core), first, k - 1, value_of(core))


FOUND = "row bigint, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, instances array<struct<known:boolean,start:bigint,stop:bigint,value:string,patterns:array<string>>>"
_INSTANCES = pa.list_(pa.struct([("known", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SCANNED = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone")] + [("base", pa.string()), ("base_sha256", pa.string()), ("instances", _INSTANCES)])
#: Instances that a row, and that a worker holds at a time.
HELD_INSTANCES = 20_000


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each text with its base spans; instances beyond HELD_INSTANCES come in more rows, with nulls for the rest."""
    for batch in batches:
        rows: list[list] = []
        held = 0
        for row, doc_id, x in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = x.as_py() or ""
            spans = base_spans(text)
            counts = Counter(k for k, _, _ in spans)
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
            told = [doc_id, *(counts[k] for k in range(4)), base, hashlib.sha256(base.encode()).hexdigest()]
            places = instances(text, spans)
            while (some := list(islice(places, HELD_INSTANCES))) or told[-1]:
                rows.append([row, *told, some])
                told = [None] * len(told)
                held += len(some)
                if held >= HELD_INSTANCES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCANNED.types, strict=True)], schema=_SCANNED)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCANNED.types, strict=True)], schema=_SCANNED)


def count_patterns(batches: Iterator[pa.RecordBatch], held: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Occurrences of patterns around any word, summed over a batch."""
    for batch in batches:
        total: Counter = Counter()
        for x in batch.column("text"):
            words = [w.strip(EDGES) for w in (x.as_py() or "").lower().split()]
            ways = [
                (f"{a} {SLOT}" for a in words[:-1] if a),
                (f"{a} {b} {SLOT}" for a, b in zip(words[:-2], words[1:-1], strict=True) if a and b) if len(words) > 2 else (),
                (f"{SLOT} {c}" for c in words[1:] if c),
                (f"{a} {SLOT} {c}" for a, c in zip(words[:-2], words[2:], strict=True) if a and c) if len(words) > 2 else (),
            ]
            for way in ways:
                total.update(way if held is None else filter(held.__contains__, way))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])


def bootstrap(docs: DataFrame, support: int, precision: float, rounds: int, most_held: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> scanned rows, their instances by pattern, and the patterns of high confidence."""
    found = materialize(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(scan, FOUND))
    seen = found.select("row", F.explode("instances").alias("i")).select("row", "i.known", "i.start", "i.stop", "i.value", F.explode("i.patterns").alias("pattern"))
    edges = materialize(seen.groupBy("pattern", "value").agg(F.max("known").alias("known"), F.count("*").alias("n")))
    wide = materialize(edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= support).select("pattern"))
    held = None
    if wide.count() <= most_held:
        held = frozenset(r["pattern"] for r in wide.collect())
    counted = docs.select("text").mapInArrow(lambda it: count_patterns(it, held), "pattern string, n bigint")
    totals = counted.groupBy("pattern").agg(F.sum("n").alias("total")).join(wide, "pattern")
    graph = materialize(spread_join(edges, totals, "pattern", "value"))
    base = graph.where("known").select("value").distinct().withColumn("conf", F.lit(1.0))
    sure, chosen = base, None
    for _ in range(rounds):
        # values without a confidence add nothing; those in very many places are dealt over tasks by pattern
        scored = spread_join(graph, sure, "value", "pattern").groupBy("pattern").agg(F.count_if(F.col("conf") >= 0.5).alias("support"), F.sum(F.col("conf") * F.col("n")).alias("hits"), F.max("total").alias("total"))
        share = F.least(F.lit(1.0), F.col("hits") / F.col("total"))
        chosen = materialize(scored.where((F.col("support") >= support) & (share >= precision)).select("pattern", share.alias("share")))
        right = 1 - F.exp(F.sum(F.log(1 - F.least(F.lit(0.999), F.col("share")))))
        found_out = spread_join(graph, chosen, "pattern", "value").groupBy("value").agg(right.alias("conf"))
        sure = materialize(base.union(found_out).groupBy("value").agg(F.max("conf").alias("conf")))
    return found, seen, chosen.select("pattern")


def find_personal_data(docs: DataFrame, support: int = SUPPORT, precision: float = PRECISION, rounds: int = ROUNDS, most_held: int = MOST_HELD, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, base, added (array of start, stop).

    key is a long column that the results carry.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, seen, chosen = bootstrap(docs, support, precision, rounds, most_held)
    added = spread_join(seen.where("NOT known"), chosen, "pattern", "row").select("row", "start", "stop").distinct()
    by_row = added.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("added"))
    return found.where("base_sha256 IS NOT NULL").drop("instances").join(by_row, "row", "left").drop("row").withColumnRenamed("doc_id", key).withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:bigint,stop:bigint>>")))


def masked(text: str, chosen: frozenset[str]) -> str:
    """The text with each span as its kind in angle brackets; of overlapping spans the first counts."""
    base = base_spans(text)
    spans = [(a, b, KINDS[k].upper()) for k, a, b in base]
    if chosen:
        spans += [(i["start"], i["stop"], "CONTEXT") for i in instances(text, base) if not i["known"] and not chosen.isdisjoint(i["patterns"])]
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]]) if out else text


def mask_texts(docs: DataFrame, most_held: int = MOST_HELD) -> DataFrame | None:
    """docs with masked texts, all columns; None if more patterns are chosen than workers may hold."""
    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = materialize(bootstrap(few, SUPPORT, PRECISION, ROUNDS, most_held)[2])
    if chosen.count() > most_held:
        return None
    held = docs.sparkSession.sparkContext.broadcast(frozenset(r["pattern"] for r in chosen.collect()))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if x.as_py() is None else masked(x.as_py(), held.value) for x in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    rows = any_names(docs, "text")
    return rows.mapInArrow(mask, rows.schema).toDF(*docs.columns)


def span_text(df: DataFrame) -> DataFrame:
    """All spans as kind:start:end, base kinds first."""
    extra = F.transform("added", lambda s: F.concat_ws(":", F.lit("context"), s["start"], s["stop"]))
    return df.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("added") > 0, F.concat_ws(",", extra))))


def op7_pii_spans(spark, sf_dir: str) -> DataFrame:
    found = span_text(find_personal_data(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
