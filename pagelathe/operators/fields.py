"""Fields of a form: their pages, the order they are read in, the options of buttons, what is still empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of a page that are looked at; option names that say nothing.
MOST_MARKS = 2000
MEANINGLESS = r"(?i)^(\d+|on|off|yes|choice\s*\d*|escolha\s*\d*|op[cç][aã]o\s*\d*|option\s*\d*)$"


def widget_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, marks: array of object numbers) -> doc_id, num, page_no: the first page that lists each object."""
    listed = pages.select("doc_id", "page_no", F.explode(F.slice("marks", 1, MOST_MARKS)).alias("num"))
    return listed.groupBy("doc_id", "num").agg(F.min("page_no").alias("page_no"))


def reading_order(fields: DataFrame) -> DataFrame:
    """fields (page_id, field_no, x0, y0, x1, y1) -> page_id, field_no, row_no, place: from the top, in a row from the left.

    The highest field opens a row; a field whose middle is not below the first field of
    an earlier row belongs to the first such row. A page, which lists MOST_MARKS fields at
    most, is one value while its rows are found; equal heights go by field_no.
    """
    box = F.struct("y0", "field_no", "x0", ((F.col("y0") + F.col("y1")) / 2).alias("middle"), "y1")
    pages = fields.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    start = F.struct(F.array().cast("array<double>").alias("ends"), F.array().cast("array<int>").alias("rows"))

    def place(a: Column, b: Column) -> Column:
        hit = F.array_position(F.transform(a["ends"], lambda e: e >= b["middle"]), True).cast("int")
        ends = F.when(hit == 0, F.concat(a["ends"], F.array(b["y1"].cast("double")))).otherwise(a["ends"])
        return F.struct(ends.alias("ends"), F.concat(a["rows"], F.array(F.when(hit == 0, F.size(a["ends"])).otherwise(hit - 1))).alias("rows"))

    found = pages.select("page_id", F.explode(F.arrays_zip("b", F.aggregate("b", start, place)["rows"].alias("row_no"))).alias("z")).select("page_id", "z.b.field_no", "z.row_no", "z.b.x0", "z.b.y0")
    return found.select("page_id", "field_no", "row_no", (F.row_number().over(Window.partitionBy("page_id").orderBy("row_no", "x0", "y0", "field_no")) - 1).alias("place"))


def button_options(widgets: DataFrame) -> DataFrame:
    """widgets (field_id, position from 0, kind, state, labels) -> field_id, option_no, state, label: one option for each state.

    A box without a state of its own and without labels is Yes, any other widget its
    position. A state that is a number picks its label, else the position does.
    """
    own = F.coalesce("state", F.when((F.col("kind") == "checkbox") & F.col("labels").isNull(), "Yes").otherwise(F.col("position").cast("string")))
    first = Window.partitionBy("field_id", "state").orderBy("position")
    rows = widgets.withColumn("state", own).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    number = F.when(F.col("state").rlike(r"^\d{1,9}$"), F.col("state").cast("int"))
    index = F.when(number < F.size("labels"), number).otherwise(F.col("position").cast("int"))
    label = F.get("labels", index)
    option = F.row_number().over(Window.partitionBy("field_id").orderBy("position")) - 1
    return rows.select("field_id", option.alias("option_no"), "state", F.when(label != "", label).otherwise(F.col("state")).alias("label"))


def option_names(options: DataFrame) -> DataFrame:
    """options (field_id, option_no, state, label, near) -> field_id, state, name: labels that say nothing or repeat give way to the text near by, or to a number."""
    repeats = F.count("*").over(Window.partitionBy("field_id", "label")) > 1
    blank = F.trim("label").rlike(MEANINGLESS)
    n = (F.col("option_no") + 1).cast("string")
    numbered = F.when(blank, F.concat(F.lit("Opção "), n)).otherwise(F.concat("label", F.lit(" ("), n, F.lit(")")))
    return options.select("field_id", "state", F.when(~blank & ~repeats, F.col("label")).when(F.col("near") != "", F.col("near")).otherwise(numbered).alias("name"))


def still_empty(required: Column, editable: Column, value: Column) -> Column:
    """Whether a field must be filled and is not; value: a list of texts, null or blank texts count as nothing."""
    return required & editable & ~F.coalesce(F.exists(value, lambda v: F.coalesce(F.trim(v) != "", F.lit(False))), F.lit(False))


def sheet_rect(rect: Column, sheet_width: Column, sheet_height: Column, image: Column) -> Column:
    """A rectangle of a photo (0 to 1) on the sheet that the photo lies on; image: struct of x, y, w, h in the sheet's units."""
    along = lambda at, size, whole, v: (image[at] + rect[v] * image[size]) / whole
    sides = [along("x", "w", sheet_width, v).alias(v) for v in ("x0", "x1")] + [along("y", "h", sheet_height, v).alias(v) for v in ("y0", "y1")]
    return F.struct(*sides)


def archive_conflict(has_foreign_pages: Column, protected: Column) -> Column:
    """Why a file can't be written for archives: pages of other files, else a password; null if it can."""
    return F.when(has_foreign_pages, "foreign pages").when(protected, "password")
