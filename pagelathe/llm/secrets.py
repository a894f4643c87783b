"""Secret scans by corpus-wide ownership frequency, in native expressions.

Base patterns give spans in code points: the gaps that `split` leaves and the
matches that `regexp_extract_all` finds alternate, so running sums of their
lengths are the offsets. Matches are exploded and summed by a window over their
text, so the cost is linear in them. Credential-like tokens (long runs of token
letters with a digit and a letter) that no base span overlaps are candidates, too.
Candidates are counted over the corpus by distinct repositories and owners: one that
few repositories of few owners hold looks live and adds a span, one that many
hold is a copied example.

Defined cases: a null or empty text has no spans; a null repository or owner
counts as one value of its own; repeated rows count once in the frequencies and
each get their result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread_join

# Fixed patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "owner")

SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches in order, each with the length of the gap before it and its own."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    both = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"), value.alias("v"))
    listed = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("size"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,value:string>>"))


def spans(scanned: DataFrame) -> DataFrame:
    """(row, repo, owner, found) -> (row, repo, owner, kind, start, stop, value): the spans that count.

    Failing matches go; a token goes where a base span overlaps it.
    """
    each = scanned.select("row", "repo", "owner", F.posexplode("found").alias("k", "s")).select("row", "repo", "owner", "k", "s.*")
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("stop") - F.col("size"))
    length, kind = F.length("value"), F.col("kind")
    good = F.when(kind == 0, length >= 6).when(kind == 1, length >= 20).when(kind == 3, F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).otherwise(True)
    each = each.where(good).withColumn("base", kind < 3)
    left = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach, ahead = F.max(F.when(F.col("base"), F.col("stop"))).over(left), F.min(F.when(F.col("base"), F.col("start"))).over(right)
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("stop"), F.lit(True))
    return each.withColumn("reach", reach).withColumn("ahead", ahead).where(F.col("base") | clear).select("row", "repo", "owner", "kind", "start", "stop", "value")


def ownership(candidates: DataFrame) -> DataFrame:
    """(digest, repo, owner) -> (digest, n_repos, n_owners).

    The first grouping removes repeats under a key that spreads even a token that
    a third of all rows hold; later groupings read one row a repository or owner.
    """
    once = candidates.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repos: int = 10) -> DataFrame:
    """doc_id, base (spans), live (added spans), n_live and n_shared base candidates, judged (candidates with n_repos and n_owners).

    A candidate with at most max_owners distinct owners and max_repos distinct
    repositories is live-looking. Added spans never overlap base ones.
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col(f"`{repo}`").cast("string").alias("repo"),
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    found = F.concat(matches(text, ASSIGN, 0, 2), matches(text, ACCESS, 1), matches(text, HEX, 2), matches(text, TOKEN, 3))
    scanned = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", found.alias("found")))
    held = materialize(spans(scanned.where(F.size("found") > 0)).withColumn("digest", F.sha2("value", 256)))
    judged = spread_join(held, ownership(held.select("digest", "repo", "owner")), "digest", "row")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    span = F.struct("start", "kind", "stop", "value")
    listed = lambda which, x=span: F.sort_array(F.collect_list(F.when(which, x)))
    by_row = judged.groupBy("row").agg(
        listed(F.col("kind") < 3).alias("base"),
        listed(live & (F.col("kind") == 3)).alias("live"),
        F.count_if(live & (F.col("kind") < 3)).alias("n_live"),
        F.count_if(~live & (F.col("kind") < 3)).alias("n_shared"),
        listed(F.lit(True), F.struct("start", "kind", "stop", "value", "n_repos", "n_owners")).alias("judged"),
    )
    none = F.array().cast(SPAN)
    return scanned.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id",
        F.coalesce("base", none).alias("base"),
        F.coalesce("live", none).alias("live"),
        F.coalesce("n_live", F.lit(0).cast("bigint")).alias("n_live"),
        F.coalesce("n_shared", F.lit(0).cast("bigint")).alias("n_shared"),
        F.coalesce("judged", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,value:string,n_repos:bigint,n_owners:bigint>>")).alias("judged"),
    )


def span_text(found: Column) -> Column:
    name = lambda s: reduce(lambda c, k: c.when(s["kind"] == k, KINDS[k]), range(1, 4), F.when(s["kind"] == 0, KINDS[0]))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "live"))).alias("spans"),
        "n_live",
        "n_shared",
    )
