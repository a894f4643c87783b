"""What is put on all pages of a file, as a table function over its pages in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

# Distance of the first text from the page's edge and between texts of one spot, in points.
EDGE, BETWEEN = 20.0, 2.0
NAME = "page_extras"


@udtf(returnType="file_no bigint, position bigint, spot string, place double, text string")
class PageExtras:
    """Each page's number, header, footer and watermark, stacked where they share a spot.

    Called with a table of pages (file_no, position, total, number_spot, header, footer,
    watermark, height), partitioned by file and in order of position. A page's texts
    follow from the page and the count of pages before it, so no file is held.
    """

    def __init__(self):
        self.n = 0

    def eval(self, page: Row) -> Iterator[tuple]:
        self.n += 1
        stacked: dict[str, float] = {}
        texts = [(page.number_spot, f"{self.n} de {page.total}"), ("top", page.header), ("bottom", page.footer)]
        for spot, text in texts:
            if spot and text:
                place = stacked.get(spot, EDGE)
                stacked[spot] = place + page.height + BETWEEN
                yield page.file_no, page.position, spot, place, text
        if page.watermark:
            yield page.file_no, page.position, "middle", 0.0, page.watermark


def page_extras(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages (file_no, position, number_spot, header, footer, watermark, height) -> file_no, position, spot, place, text.

    A page without a spot for numbers has none; null texts are left out.
    """
    spark.udtf.register(NAME, PageExtras)
    return spark.sql(
        f"""WITH counted AS (SELECT *, count(*) OVER (PARTITION BY file_no) AS total FROM {{pages}})
        SELECT e.* FROM {NAME}(TABLE(SELECT * FROM counted) PARTITION BY file_no ORDER BY position) AS e""",
        pages=pages,
    )
