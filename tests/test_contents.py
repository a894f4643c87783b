"""Hidden content, copied pages, form values, phrases, trimmed names against brute force."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from pagelathe.functions import names
from pagelathe.operators import contents, copies, structure, targets
from pagelathe.streaming import forms

OPS = ["BDC", "BDC", "BMC", "EMC", "EMC", "EMC", "q", "Q", "Tr", "Tj", "TJ", "'", '"', "Do", "BI", "f", "b*", "sh", "Td", "ET", "re", "cm"]


def brute_content(tokens):
    """One content as a state machine: its operators, or the reason to refuse it."""
    marks, hidden, modes, lost, out = [], False, [0], False, []
    for op, shown, mode in tokens:
        if op in ("BDC", "BMC"):
            marks.append(hidden)
            out.append("/OC BMC" if op == "BDC" and shown is not None else op)
            hidden = hidden or (op == "BDC" and shown is False)
        elif op == "EMC":
            hidden = marks.pop() if marks else hidden
            out.append(op)
        elif op in ("q", "Q", "Tr"):
            if op == "q":
                modes.append(modes[-1])
            elif op == "Q" and len(modes) > 1:
                modes.pop()
            elif op == "Tr":
                modes[-1] = mode or 0
            out.append(op)
        elif op == "Do":
            out += [] if hidden or shown is False else [op]
        elif op == "BI":
            out += [] if hidden else [op]
        elif not hidden:
            if op in ("Tj", "TJ") and lost:
                return "visible text goes on after hidden text"
            lost = lost and op not in contents.MOVE
            out.append(op)
        elif op in contents.PAINT:
            out.append("n")
        elif op in contents.SHOW:
            if modes[-1] >= 4:
                return "hidden text clips"
            out += {"'": ["T*"], '"': ["Tw Tc T*"]}.get(op, [])
            lost = True
        elif op != "sh":
            lost = lost and op not in contents.MOVE
            out.append(op)
    return out


def test_hidden_content(spark):
    rng = random.Random(3)
    listed = {}
    for n in range(150):
        size = rng.choice([0, 1, 5, 30, 30, 200])
        listed[n] = [(op, rng.choice([None, True, False]) if op in ("BDC", "Do") else None, rng.choice([None, 0, 3, 4, 7]) if op == "Tr" else None) for op in (rng.choice(OPS) for _ in range(size))]
    listed[150] = [("q", None, None)] * 60 + [("Tr", None, 5)] + [("q", None, None)] * 60 + [("BDC", False, None), ("Tj", None, None)]
    listed[151] = [("EMC", None, None)] * 3 + [("BDC", False, None), ("BMC", None, None), ("EMC", None, None), ("f", None, None), ("EMC", None, None), ("f", None, None)]
    rows = [(n, k, *t) for n, tokens in listed.items() for k, t in enumerate(tokens)]
    got, refused = defaultdict(list), {}
    for r in contents.without_hidden(spark.createDataFrame(rows, "content_no bigint, token_no bigint, op string, shown boolean, mode int")).orderBy("content_no", "token_no").collect():
        if r.refused:
            refused[r.content_no] = r.refused
        else:
            got[r.content_no].append(r.op)
    want = {n: brute_content(t) for n, t in listed.items()}
    assert refused == {n: w for n, w in want.items() if isinstance(w, str)}
    assert dict(got) == {n: w for n, w in want.items() if isinstance(w, list) and w}
    assert set(refused.values()) == {"hidden text clips", "visible text goes on after hidden text"} and len(got) > 40


def test_copied_pages(spark):
    rng = random.Random(4)
    refs = {(d, rng.randrange(60), rng.randrange(60)) for d in range(3) for _ in range(90)} | {(0, 61, 61)}
    pages = {(d, n) for d in range(3) for n in range(0, 60, 6)} | {(0, 61)}
    wanted = {(f, *rng.choice(sorted(pages))) for f in range(6) for _ in range(5)} | {(9, 0, 61)}
    frame = lambda rows, names_: spark.createDataFrame(sorted(rows), names_)
    got = copies.copied_pages(frame(wanted, "file_no bigint, doc_id bigint, num bigint"), frame(refs, "doc_id bigint, src bigint, dst bigint"), frame(pages, "doc_id bigint, num bigint")).collect()
    for f in {w[0] for w in wanted}:
        own = {(d, n) for g, d, n in wanted if g == f}
        have, front = set(own), set(own)
        while front:
            front = {(d, b) for d, a, b in refs if (d, a) in front and (d, b) not in pages} - have
            have |= front
        number = {x: k + 1 for k, x in enumerate(sorted(have))}
        mine = {(r.doc_id, r.num): (r.new_num, r.refs) for r in got if r.file_no == f}
        assert mine == {x: (k, sorted(number[d, b] for d, a, b in refs if (d, a) == x and (d, b) in number)) for x, k in number.items()}


def test_copied_pages_take_files_together(spark):
    """One row holds 64 files; numbers below 0 and missing ones count as files, missing objects as objects."""
    wanted = [(f, 1, 40) for f in range(-70, 130)] + [(None, 1, 40), (None, 1, 3), (5, None, None), (5, 2, None)]
    refs = [(1, 40, 20), (1, 20, 10), (1, 10, 10), (1, 10, 3), (1, 20, None), (None, 40, 8)]
    frame = lambda rows, names_: spark.createDataFrame(rows, names_)
    told = frame(wanted, "file_no bigint, doc_id bigint, num bigint"), frame(refs, "doc_id bigint, src bigint, dst bigint"), frame([(1, 40), (1, 3)], "doc_id bigint, num bigint")
    assert copies.needed_objects(*told).where("num = 10").count() == 6
    got = {}
    for r in copies.copied_pages(*told).collect():
        got.setdefault(r.file_no, {})[r.doc_id, r.num] = (r.new_num, r.refs)
    plain = {(1, 10): (1, [1]), (1, 20): (2, [1]), (1, 40): (3, [2])}
    assert {f: w for f, w in got.items() if f not in (None, 5)} == {f: plain for f in range(-70, 130) if f != 5}
    assert got[5] == plain | {(2, None): (4, []), (None, None): (5, [])}
    # as in SQL, objects of no file are numbered but their references meet nothing
    assert got[None] == {(1, 3): (1, []), (1, 10): (2, []), (1, 20): (3, []), (1, 40): (4, [])}


def test_dense_numbers_of_one_large_group(spark):
    """A group over many parts is numbered without being in one of them."""
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("g"))
    got = copies.dense_numbers(rows, "g", "v").collect()
    for g in (0, 1):
        assert [r.number for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(1, sum(r.g == g for r in got) + 1))


def changes(seed, n=200):
    rng = random.Random(seed)
    rows, t = [], 0
    for k in range(n):
        t += rng.choice([1, 5, 30, 400, 900])
        rows.append((rng.randrange(4), rng.choice("abc"), t, k, rng.choice(["1", "2", None]), "1"))
    return rows


COLUMNS = "form_id bigint, field string, t bigint, seq bigint, value string, original string"


def table_of(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_overrides(spark):
    rows = changes(1)
    last = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        last[r[:2]] = r
    got = {(r.form_id, r.field): (r.value, r.overridden) for r in forms.overrides(table_of(spark, rows)).collect()}
    assert got == {k: (r[4], r[4] != r[5]) for k, r in last.items()}


def parts_in(spark, folder, parts):
    for k, rows in enumerate(parts):
        table_of(spark, rows).coalesce(1).write.parquet(str(folder / f"p{k:03d}"))
    return spark.readStream.schema(table_of(spark, parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "p*"))


def test_streamed_overrides_in_any_order(spark, tmp_path):
    """Rows in shuffled micro-batches end in the store that the whole table gives."""
    rows = changes(2, 60)
    mixed = rows[:]
    random.Random(7).shuffle(mixed)
    stream = parts_in(spark, tmp_path, [mixed[k::4] for k in range(4)])
    run = forms.overrides(stream).writeStream.format("memory").queryName("overrides").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(str, spark.table("overrides").collect())) == sorted(map(str, forms.overrides(table_of(spark, rows)).collect()))


def test_streamed_notifications_and_late_rows(spark, tmp_path):
    """Series are told once the watermark has passed them; rows behind it are dropped."""
    rows = changes(3, 80)
    end = (9, "z", rows[-1][2] + 100_000, 999, "1", "1")
    late = (0, "late", 1, 998, "1", "1")
    parts = [sorted(rows[:40], key=lambda r: r[3] * 7 % 40), rows[40:], [end], [(9, "z", end[2] + 10, 1001, "1", "1")], [late], [(9, "z", end[2] + 100_000, 1000, "1", "1")]]
    stream = parts_in(spark, tmp_path, parts)
    run = forms.notifications(stream, "10 minutes", "1 day").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    got = spark.table("told").where("form_id < 9")
    want = forms.notifications(table_of(spark, rows), "10 minutes")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_inheritance_of_one_root(spark):
    """Very many rows under one ancestor, and a long chain."""
    rows = [(0, None, "top")] + [(k, 0, None) for k in range(1, 400)] + [(k, k - 1, "x" if k == 700 else None) for k in range(400, 900)]
    got = {r.k: r.v for r in structure.inherit(spark.createDataFrame(rows, "k bigint, p bigint, v string"), "k", "p", ["v"]).collect()}
    assert got == {k: "x" if k >= 700 else "top" for k in range(900)}


def test_phrases(spark):
    words = [("a", 0.0, 0.1), ("b", 0.104, 0.2), ("c", 0.26, 0.3), ("d", 0.301, 0.4)]
    rows = [(1, k, s, x0, 0.5, x1, 0.52, None, True, "sans") for k, (s, x0, x1) in enumerate(words)] + [(1, 9, " low ", 0.1, 0.9, 0.2, 0.92, None, False, "sans"), (1, 10, "er", 0.2005, 0.9, 0.3, 0.92, None, False, "sans"), (1, 11, "", 0.0, 0.0, 1.0, 1.0, None, False, "sans"), (1, 12, "big", 0.301, 0.88, 0.4, 0.93, None, False, "sans")]
    got = targets.text_targets(spark.createDataFrame(rows, "page_id bigint, piece_no int, str string, x0 double, y0 double, x1 double, y1 double, line int, words boolean, family string"))
    assert [(r.target_no, r.text) for r in got.orderBy("target_no").collect()] == [(0, "a b"), (1, "c d"), (2, "big"), (3, "lower")]


def test_names_of_long_runs_and_other_scripts(spark):
    texts = ["_" * 1_000_000 + "a", "-" * 1_000_000 + "b" + "-" * 1_000_000, "Şükrü Ő naïve Ångström é", "Ελλάδα й"]
    start = time.time()
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(names.safe_name(F.col("t")).alias("n")).collect()]
    assert got == ["a", "b", "sukru-o-naive-angstrom-e", "documento"]
    assert time.time() - start < 10
    assert spark.range(1).select(names.unaccent(F.lit("Ελλάδα й ş"))).collect()[0][0] == "Ελλαδα и s"


def test_hidden_layers_take_one_shuffle(spark):
    """A stack per content instead of joins: nested blocks, ends without a beginning, a content that a late token refuses."""
    ops = ["Q", "EMC", "q", "Tr", "q", "BDC", "Tj", "f", "EMC", "Td", "Q", "Tj"]
    rows = [(c, k, op, False if op == "BDC" else None, 7 if c == 2 else 0) for c in (1, 2) for k, op in enumerate(ops)]
    made = contents.without_hidden(spark.createDataFrame(rows, "content_no bigint, token_no bigint, op string, shown boolean, mode int"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = sorted(((r.content_no, r.token_no, r.op, r.refused) for r in made.collect()), key=str)
    left = [(1, k, {"BDC": "/OC BMC", "f": "n"}.get(op, op), None) for k, op in enumerate(ops) if k != 6]
    assert got == sorted([*left, (2, None, None, "hidden text clips")], key=str)
