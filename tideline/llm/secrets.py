"""Secret scans with corpus-wide ownership frequency (operator 6), in SQL functions only.

Base kinds (assign, access, hex) are the leftmost non-overlapping matches of
fixed patterns. The method adds kind owned: generic credential-like words whose
value is held by few owners. Each candidate value is hashed and counted by
distinct owners (the source column) and distinct repositories (documents) over
the whole corpus; values that many owners or many repositories hold are copied
examples, values of one owner in few repositories look live.

Positions come without a UDF: split() gives the gaps and regexp_extract_all()
the matches of the same pattern, and their running lengths are the places, in
code points.

Defined results: a null text counts as empty (no spans, the hash of the empty
string); repeated rows are scanned one by one and count once as a repository;
null owners count as one owner; other columns of the input are not returned;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Shortest kept: of group 2, of the match, of the match.
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: The method's own candidates: words of one case-mixed or prefixed secret-like shape.
OWNED = r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{24,})"
#: A candidate looks live that at most so many owners hold, in at most so many repositories.
MOST_OWNERS, MOST_REPOS = 1, 8
ORDER = {"assign": 0, "access": 1, "hex": 2, "owned": 3}

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:bigint>>"


def places(text: Column, pattern: str, kind: str, keep, value=lambda m: m) -> Column:
    """The kept matches of pattern as an array of spans."""
    rx = F.lit(pattern)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.cast("bigint").alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end"), F.xxhash64(value(pair["hit"])).alias("hash"))
        spans = F.when(pair["hit"].isNotNull() & keep(pair["hit"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, start).cast("bigint").alias("at"), spans.cast(SPAN).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["spans"])


def scan(text: Column) -> tuple[Column, Column]:
    """The base spans and the method's candidates of a text."""
    none = F.expr(f"cast(array() as {SPAN})")
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.when(text.rlike(ASSIGN), places(text, ASSIGN, "assign", lambda m: F.length(secret(m)) >= LEAST["assign"], secret)).otherwise(none)
    # A run shorter than the least never holds a longer match, so the least goes into these two patterns.
    access, hexes = ACCESS[:-1] + "{%d,}" % (LEAST["access"] - 4), HEX[:-1] + "{%d,}" % LEAST["hex"]
    keys = F.when(text.rlike(access), places(text, access, "access", lambda m: F.lit(True))).otherwise(none)
    digits = F.when(text.rlike(hexes), places(text, hexes, "hex", lambda m: F.lit(True))).otherwise(none)
    own = F.when(text.rlike(OWNED), places(text, OWNED, "owned", lambda m: F.lit(True))).otherwise(none)
    return F.concat(assign, keys, digits), own


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, base and spans (arrays of spans), n_live and n_copied (long), counts (array of start, kind, owners, repos).

    n_live: candidates of every kind whose value at most most_owners owners hold in at most most_repos repositories; n_copied: the others.
    counts: of every candidate, the distinct owners and repositories that hold its value.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, own = scan(text)
    found = docs.select("doc_id", common.row_key().alias("_row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_owner"), base.alias("base"), own.alias("own"))
    each = found.select("doc_id", "_row", "_owner", F.explode_outer(F.concat("base", "own")).alias("span")).where("span is not null")
    # Distinct values, repositories and owners first, so that a value that a third of all rows holds is counted on the map side.
    by_row = each.groupBy(F.col("span.hash").alias("_hash"), "_owner", "_row").agg(F.lit(1).alias("one"))
    by_owner = by_row.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("held"))
    # A repository that stands under several owners (rows with one id and text) counts once for each.
    freq = by_owner.groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("held").alias("repos"))
    judged = each.join(freq, each["span.hash"] == freq["_hash"]).select("doc_id", "_row", "span", "owners", "repos", ((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)).alias("live"))
    # Rows with one id and one text have the same spans: the set folds them.
    per_row = judged.groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(
        F.collect_set(F.when(F.col("live") & (F.col("span.kind") == "owned"), F.col("span"))).alias("added"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("span")))).cast("bigint").alias("n_live"),
        F.size(F.collect_set(F.when(~F.col("live"), F.col("span")))).cast("bigint").alias("n_copied"),
        F.array_sort(F.collect_set(F.struct(F.col("span.start").alias("start"), F.col("span.kind").alias("kind"), "owners", "repos"))).alias("counts"),
    )
    none = F.expr(f"cast(array() as {SPAN})")
    out = found.join(per_row, common.same(found["doc_id"], per_row["_d"]) & (found["_row"] == per_row["_r"]), "left")
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"), F.coalesce("n_live", F.lit(0).cast("bigint")).alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("bigint")).alias("n_copied"), F.coalesce("counts", F.expr("cast(array() as array<struct<start:bigint,kind:string,owners:bigint,repos:bigint>>)")).alias("counts"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_copied", F.array_join(F.transform("counts", lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["owners"].cast("string"), c["repos"].cast("string"))), ",").alias("counts"))
