"""Broken lines and spanning cells against plain loops."""

import random

from pagelathe.operators import layout


def brute_lines(words, line, first):
    """(text, width, spacing) of the lines of one paragraph, word after word."""
    items = []
    for text, letter, blank in words:
        parts = list(text) if len(text) * letter > min(line, first) else [text]
        items += [(t, len(t) * letter, blank if k == 0 else 0) for k, t in enumerate(parts)]
    lines = []
    for t, width, blank in items:
        room = first if len(lines) <= 1 else line
        if not lines or lines[-1][1] + blank + width > room:
            lines.append([t, width, 0])
        else:
            now = lines[-1]
            now[0] += (" " if blank else "") + t
            now[1] += blank + width
            now[2] += blank > 0
    out = []
    for k, (t, width, gaps) in enumerate(lines):
        free = (first if k == 0 else line) - width
        out.append((t, width, 0.0 if k == len(lines) - 1 or not gaps or free <= 0 else free / gaps))
    return out


def test_broken_lines(spark):
    rng = random.Random(5)
    listed = {p: [("x" * rng.choice([1, 2, 5, 9, 40]), rng.choice([5, 6, 7]), rng.choice([0, 3, 6])) for _ in range(rng.choice([1, 3, 50, 400]))] for p in range(12)}
    listed[20], listed[21] = [("word", 5, 5)], [("y" * 300, 7, 7), ("é😀" * 3, 5, 5)]
    rows = [(p, k, *w) for p, words in listed.items() for k, w in enumerate(words)]
    words = spark.createDataFrame(rows, "para_no bigint, word_no bigint, text string, letter int, blank int")
    got = {}
    for r in layout.broken_lines(words, 120, 90).orderBy("para_no", "line_no").collect():
        got.setdefault(r.para_no, []).append((r.text, r.width, r.spacing))
    assert got == {p: brute_lines(words, 120, 90) for p, words in listed.items()}


def test_one_long_paragraph(spark):
    """Lines double with each round: 20,000 lines take 15 rounds, not 20,000."""
    words = spark.range(200_000).selectExpr("1L AS para_no", "id AS word_no", "'abcd' AS text", "1 AS letter", "1 AS blank")
    lines = layout.broken_lines(words, 49)
    assert lines.count() == 20_000 and lines.where("text <> repeat('abcd ', 9) || 'abcd'").count() == 0


def test_spanned_rows(spark):
    rng = random.Random(6)
    cells, want = [], {}
    for t in range(40):
        n = rng.randrange(1, 7)
        mine = [(t, r, c, float(rng.randrange(1, 60)), rng.choice([1, 1, 2, 3])) for r in range(n) for c in range(rng.randrange(1, 4))]
        mine = [(t, r, c, h, min(s, n - r)) for _, r, c, h, s in mine]
        heights = [max([4.0] + [h for _, r, _, h, s in mine if r == k and s == 1]) for k in range(n)]
        for _, r, _, h, s in sorted(mine, key=lambda x: (x[1], x[2])):
            if s > 1:
                heights[r + s - 1] += max(0.0, h - sum(heights[r : r + s]))
        cells += mine
        want[t] = heights
    got = {}
    for r in layout.spanned_rows(spark.createDataFrame(cells, "table_no bigint, row_no bigint, cell_no bigint, height double, span bigint")).orderBy("table_no", "row_no").collect():
        got.setdefault(r.table_no, []).append(r.height)
    assert got == want


def test_lines_take_one_shuffle(spark):
    """No joins and no tables between: what is written grows with the items only."""
    words = spark.range(1000).selectExpr("id % 7 AS para_no", "id AS word_no", "'abcd' AS text", "1 AS letter", "1 AS blank")
    plan = layout.broken_lines(words, 49)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_items_of_documents_take_no_shuffle(spark, tmp_path):
    from pagelathe.plans import layout as plans

    rows = [(1, "\n".join(f"w{i}" for i in range(17))), (2, " \t\n"), (3, None), (4, "one")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = plans._items(spark, str(tmp_path))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = [(r.page_id, r.item_no, r.text) for r in made.orderBy("page_id", "item_no").collect()]
    assert got == [(1, 0, "w0 w1 w2 w3 w4 w5 w6 w7"), (1, 1, "w8 w9 w10 w11 w12 w13 w14 w15"), (1, 2, "w16"), (4, 0, "one")]
