"""Queries that write files of the driver's texts and read them back, and kernels on small planes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import dealt, dealt_join
from ..operators import images, photos
from ..sources import headers, packages, pdf, writer
from . import base
from .base import load, query

LINES = 60
#: Bytes of settings whose curves a task makes.
SETTINGS_TOGETHER = 1 << 20


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of eight words on pages of LINES lines."""
    w = base.lines(spark, sf_dir)
    return w.select(F.col("page_id").alias("doc_id"), F.floor(F.col("line") / LINES).cast("int").alias("page_no"), (F.col("line") % LINES).alias("item_no"), F.lit(40.0).alias("x"), (30.0 + 12 * (F.col("line") % LINES)).alias("y"), "text", F.lit("Helvetica").alias("font"), F.lit(10.0).alias("size"))


_LINE = f"{base.WORDS}, ln AS (SELECT page_id, word_no // 8 AS line, string_agg(text, ' ' ORDER BY word_no) AS text FROM words GROUP BY ALL), pg AS (SELECT page_id, line // {LINES} AS page_no, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line) AS text FROM ln GROUP BY ALL)"


def _files(spark, sf_dir) -> DataFrame:
    return writer.write_files(_lines(spark, sf_dir), 600.0, 800.0)


@query(f"WITH {_LINE} SELECT page_id::VARCHAR AS path, page_no::INTEGER AS page_no, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height, 0 AS rotation, text FROM pg")
def written_pages(spark, sf_dir):
    """Files written from laid out lines, read back page by page."""
    return pdf.pdf_pages(_files(spark, sf_dir)).select("path", "page_no", "width", "height", "rotation", "text")


@query(f"WITH {_LINE}, d AS (SELECT page_id, count(*) AS n FROM pg GROUP BY page_id) SELECT page_id::VARCHAR AS path, 3 + 2 * n AS n_objects, n AS n_pages, n AS n_streams, 1::BIGINT AS n_fonts FROM d")
def written_objects(spark, sf_dir):
    o = pdf.pdf_objects(_files(spark, sf_dir))
    return o.groupBy("path").agg(F.count("*").alias("n_objects"), F.count_if(F.col("type") == "Page").alias("n_pages"), F.count_if(F.col("kind") == "stream").alias("n_streams"), F.count_if(F.col("type") == "Font").alias("n_fonts"))


def _packages(spark, sf_dir) -> DataFrame:
    """A word-processor package of each document, a paragraph a line of its text."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="S{doc % 3}"/></w:pPr><w:r><w:t>{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
                    z.writestr("extra.txt", f"{doc}")
                made.append(out.getvalue())
            yield pd.DataFrame({"path": part["doc_id"].astype(str), "content": made})

    return load(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(build, "path string, content binary")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id::VARCHAR AS path, (generate_subscripts(l, 1) - 1)::INTEGER AS block_no, 'S' || doc_id % 3 AS style, unnest(l) AS text FROM l")
def package_blocks(spark, sf_dir):
    return packages.docx_blocks(_packages(spark, sf_dir)).select("path", "block_no", "style", "text")


@query("SELECT doc_id::VARCHAR AS path, 2::BIGINT AS n_entries, length(doc_id::VARCHAR)::BIGINT AS size FROM documents")
def package_entries(spark, sf_dir):
    e = packages.zip_entries(_packages(spark, sf_dir))
    return e.groupBy("path").agg(F.count("*").alias("n_entries"), F.sum(F.when(F.col("name") == "extra.txt", F.col("size"))).alias("size"))


@query("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4000 + 1 ELSE -1 END::INTEGER AS width, CASE WHEN p_partkey % 5 > 0 THEN p_size + 10 ELSE -1 END::INTEGER AS height, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END ELSE -1 END AS components, CASE WHEN p_partkey % 5 = 0 THEN 'no frame header' END AS error FROM part")
def photo_headers(spark, sf_dir):
    """Heads of photos: a start, a segment, fill bytes, the frame header (none in every fifth)."""
    k = F.col("p_partkey")
    two = lambda c: F.lpad(F.hex(c.cast("bigint")), 4, "0")
    frame = F.concat(F.lit("FFFFC2000B08"), two(F.col("p_size") + 10), two(k % 4000 + 1), F.when(k % 2 == 0, "01").otherwise("03"), F.lit("00000000"))
    data = F.unhex(F.concat(F.lit("FFD8FFE00004ABCDFFD0"), F.when(k % 5 > 0, frame).otherwise("FFC4000400000000000000")))
    return headers.photo_heads(load(spark, sf_dir, "part").select(k.cast("string").alias("path"), data.alias("content"))).na.fill(-1, ["width", "height", "components"]).select("path", "width", "height", "components", "error")


# --- planes ------------------------------------------------------------------


def _planes(spark, sf_dir) -> DataFrame:
    """Embeddings as grey planes of eight columns."""
    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 128), F.lit(0)), F.lit(255)).cast("int"))
    data = F.unhex(F.array_join(F.transform(grey, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.floor(F.size("embedding") / 8).cast("int").alias("height"), data.alias("data"))


_PLANE = "p AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, least(greatest(floor((embedding[i + 1]::DOUBLE + 1) * 128), 0), 255)::INTEGER AS v FROM embeddings, range(512) r(i) WHERE i < len(embedding))"


@query(f"WITH {_PLANE}, n AS (SELECT a.image_id, a.y, a.x, avg(b.v) AS mean, max(b.v) AS high, min(b.v) AS low FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL) SELECT image_id, round(sum(mean * (1 + x + 8 * y)), 4) AS blur, sum(high * (1 + x + 8 * y))::BIGINT AS high, sum(low * (1 + x + 8 * y))::BIGINT AS low FROM n GROUP BY image_id")
def plane_filters(spark, sf_dir):
    """Box blur, local maximum and minimum of planes, each as a sum weighted by place."""
    f = images.filtered(_planes(spark, sf_dir), 1)
    weigh = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return f.select("image_id", F.round(weigh("blur"), 4).alias("blur"), weigh("high").cast("bigint").alias("high"), weigh("low").cast("bigint").alias("low"))


@query(
    f"""WITH RECURSIVE {_PLANE}, m AS (SELECT image_id, y * 8 + x AS i, x FROM p WHERE v >= 128),
r(image_id, i, root) AS (SELECT image_id, i, i FROM m UNION SELECT r.image_id, n.i, r.root FROM r JOIN m c ON c.image_id = r.image_id AND c.i = r.i JOIN m n ON n.image_id = r.image_id AND (abs(n.i - r.i) = 8 OR (n.i = r.i + 1 AND n.x > 0) OR (n.i = r.i - 1 AND c.x > 0)))
SELECT image_id, max(n)::INTEGER AS largest FROM (SELECT image_id, root, count(*) AS n FROM r GROUP BY ALL) GROUP BY image_id"""
)
def plane_regions(spark, sf_dir):
    return images.regions(_planes(spark, sf_dir), 128).where("largest > 0")


@query(f"WITH {_PLANE} SELECT image_id, 512 + count(*) AS size, 'P5' AS head FROM p GROUP BY image_id")
def plane_files(spark, sf_dir):
    f = images.grey_maps(_planes(spark, sf_dir))
    return f.select("image_id", F.octet_length("content").cast("bigint").alias("size"), F.decode(F.substring("content", 1, 2), "UTF-8").alias("head"))


@query(
    """WITH c AS (SELECT p_partkey, (p_partkey % 30) / 100.0::DOUBLE AS b, 0.7::DOUBLE + (p_partkey % 40) / 100.0::DOUBLE AS w, 0.5::DOUBLE + (p_partkey % 9) / 4.0::DOUBLE AS g FROM part)
SELECT p_partkey, sum(floor(255 * pow(least(greatest((i / (1023 / 1.5::DOUBLE) - b) / (w - b), 0), 1), g) + 0.5) * (i % 7 + 1))::BIGINT AS curve FROM c, range(1024) r(i) GROUP BY p_partkey"""
)
def tone_curves(spark, sf_dir):
    """Curves of settings that parts share are made once."""
    k = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").select("p_partkey", ((k % 30) / F.lit(100.0)).alias("black"), (0.7 + (k % 40) / F.lit(100.0)).alias("white"), (0.5 + (k % 9) / F.lit(4.0)).alias("gamma"))
    keys = ["black", "white", "gamma"]
    total = F.aggregate(F.transform(images.tone_curve(*map(F.col, keys)), lambda x, i: x * (i % 7 + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    made = dealt(rows.select(*keys).distinct(), SETTINGS_TOGETHER, *keys).select(*keys, total.alias("curve"))
    return dealt_join(rows, made, keys, ["p_partkey"]).select("p_partkey", "curve")


_NEAR = lambda source, r, what: f"(SELECT a.image_id, a.y, a.x, {what} AS v FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} GROUP BY ALL)"
_PAPER = f"""{_PLANE}, up AS {_NEAR("p", 2, "max(b.v)")}, dn AS {_NEAR("up", 2, "min(b.v)")}, sm AS {_NEAR("dn", 1, "avg(b.v)")}, rg AS {_NEAR("sm", 4, "avg(b.v)")},
br AS (SELECT image_id, greatest(max(v), 1) AS br FROM rg GROUP BY image_id),
pp AS (SELECT image_id, y, x, br, greatest(sm.v, rg.v * 0.6::DOUBLE, br * 0.35::DOUBLE, 1) AS level FROM sm JOIN rg USING (image_id, y, x) JOIN br USING (image_id))"""


@query(f"WITH {_PAPER} SELECT image_id, round(max(br), 6) AS brightest, round(sum(level * (1 + x + 8 * y)), 4) AS paper FROM pp GROUP BY image_id")
def paper_brightness(spark, sf_dir):
    """Brightness of the paper of planes, as a sum weighted by place, from tiles of four pixels a side."""
    found = photos.papers(photos.tiles(_planes(spark, sf_dir), 4))
    return found.select("image_id", F.round("brightest", 6).alias("brightest"), F.round(F.aggregate(F.transform("paper", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("paper"))


@query(
    f"""WITH {_PAPER}, e AS (SELECT image_id, max(y) AS last FROM p GROUP BY image_id),
so AS (SELECT a.image_id, a.y, a.x, sum(b.v * (2 - abs(a.x - b.x)) * (2 - abs(a.y - b.y))) / 16.0::DOUBLE AS soft FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL),
m AS (SELECT p.*, level, soft, (1 - level / br) * 1.8::DOUBLE AS mix, p.x BETWEEN 1 AND 6 AND p.y > 0 AND p.y < last AS inner_ FROM p JOIN pp USING (image_id, y, x) JOIN so USING (image_id, y, x) JOIN e USING (image_id)),
c AS (SELECT *, round_even(CASE WHEN inner_ AND mix > 0.05::DOUBLE THEN v + (soft - v) * least(mix, 1) ELSE v END, 0) AS g FROM m),
t AS (SELECT *, least(greatest((floor(least(1023, g / level * 682)) / 682 - 0.4::DOUBLE) / 0.5::DOUBLE, 0), 1) AS d FROM c)
SELECT image_id, sum(floor(255 * pow(d, 1.5::DOUBLE) + 0.5) * (1 + x + 8 * y))::BIGINT AS document, sum(CASE WHEN g < level * 0.75::DOUBLE THEN 0 ELSE 255 END * (1 + x + 8 * y))::BIGINT AS bw FROM t GROUP BY image_id"""
)
def photo_filters(spark, sf_dir):
    """Planes without their shadows, grey and in black and white, each as a sum weighted by place."""
    pieces = photos.tiles(_planes(spark, sf_dir), 4)
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda y: F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda x: (F.col("top") + y) * 8 + F.col("left") + x + 1)))
    level = lambda i: F.conv(F.hex(F.substring(F.col("data"), i + 1, F.lit(1))), 16, 10).cast("bigint")
    total = F.aggregate(F.transform(places, lambda place, i: place * level(i)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    made = [photos.filtered(pieces, kind).groupBy("image_id").agg(F.sum(total).alias(kind)) for kind in ("document", "bw")]
    return made[0].join(made[1], "image_id")
