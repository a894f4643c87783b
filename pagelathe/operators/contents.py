"""Hidden layers taken out of page contents: one shuffle, then each content's tokens stream through a task in their order.

Markers and blocks nest, so a task holds a stack of each: the markers that are open and
whether they hide, the text modes of the blocks that are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Operators that paint, that move the text to a place of their own, that show text; clipping text modes.
PAINT = ["S", "s", "f", "F", "f*", "B", "B*", "b", "b*"]
MOVE = ["BT", "ET", "Td", "TD", "T*", "Tm", "'", '"']
SHOW = ["Tj", "TJ", "'", '"']
CLIPPING = 4
MARKS, KEPT = ["BDC", "BMC", "EMC"], ["q", "Q", "Tr"]


OUT = pa.schema([("content_no", pa.int64()), ("token_no", pa.int64()), ("op", pa.string()), ("refused", pa.string())])


def _left(op: str | None, shown: bool | None, hidden: bool) -> str | None:
    """What is left of a token."""
    if op == "BDC" and shown is not None:
        return "/OC BMC"
    if op == "Do" and shown is False:
        return None
    if not hidden or op in MARKS or op in KEPT:
        return op
    if op in PAINT:
        return "n"
    return {"'": "T*", '"': "Tw Tc T*", "Tj": None, "TJ": None, "sh": None, "Do": None, "BI": None}.get(op, op)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens sorted by content and place -> what is left; the tokens of one content are held until its end, as a late one may refuse it."""
    content, kept, refused = None, [], None
    marks: list[bool] = []
    modes, deep, lost = [0], 0, False
    for batch in batches:
        done = []
        for key, no, op, shown, mode in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != content:
                done += kept if refused is None else [(content, None, None, refused)]
                content, kept, refused, marks, modes, deep, lost = key, [], None, [], [0], 0, False
            if op in ("BDC", "BMC"):
                marks.append(shown is False)
                deep += marks[-1]
            elif op == "EMC" and marks:
                deep -= marks.pop()
            elif op == "q":
                modes.append(modes[-1])
            elif op == "Q" and len(modes) > 1:
                modes.pop()
            elif op == "Tr":
                modes[-1] = mode or 0
            hidden = deep > 0
            if refused is None and op in SHOW:
                if hidden and modes[-1] >= CLIPPING:
                    refused = "hidden text clips"
                elif not hidden and lost and op in ("Tj", "TJ"):
                    refused = "visible text goes on after hidden text"
            if op in SHOW and hidden:
                lost = True
            elif op in MOVE:
                lost = False
            if refused is not None:
                kept = []
            elif (new := _left(op, shown, hidden)) is not None:
                kept.append((key, no, new, None))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), OUT, strict=True)], schema=OUT)
    done = kept if refused is None else [(content, None, None, refused)]
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), OUT, strict=True)], schema=OUT)


def without_hidden(tokens: DataFrame) -> DataFrame:
    """tokens (content_no, token_no, op, shown, mode) -> content_no, token_no, op, refused: what is left of each content.

    shown: whether the layer of a BDC or Do token is visible, null without a layer; mode:
    the number of a Tr token. Marks of layers become plain marks, hidden painting ends
    its path, hidden text moves on only. A content where that would change what stays
    visible is refused: one row without token, op and the first reason.
    """
    rows = tokens.selectExpr("CAST(content_no AS bigint)", "CAST(token_no AS bigint)", "op", "CAST(shown AS boolean)", "CAST(mode AS int)")
    dealt = rows.repartition("content_no").sortWithinPartitions("content_no", "token_no")
    return dealt.mapInArrow(_walked, "content_no bigint, token_no bigint, op string, refused string")
