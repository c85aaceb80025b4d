"""Line dedup over content-defined chunks (operator 10), in SQL functions only.

A text's lines are hashed, and a rolling hash over the last WINDOW line hashes
says where a chunk ends: after a line whose rolling hash is 0 modulo DIVISOR.
Boundaries depend on the lines near them alone, so lines put in or taken out
elsewhere don't shift them. A line of LONG words or more is a chunk of its own,
so a passage is found in any surroundings.

The lines about a boundary may differ where a passage begins or ends, so two
lines on end (blank ones between them aside) are a unit beside the chunks,
unless both are chunks of their own: whatever the surroundings, all lines of a
repeated passage of two lines or more lie in repeated units.

A unit is redundant if the corpus holds it more than once and this isn't its
first occurrence (smallest doc_id, row and place). Redundant units that touch are
a run, and its lines are removed if it is a repeated passage: a unit of it has
PASSAGE words, or several lines and LEAST words, or it has two chunks or two
pairs; single short lines stay. A line's first occurrence in the corpus stays.
Removal takes equal bytes: a hash counts only if the least and the greatest of
all the texts of that hash (of pairs: of their SHA-256) are the same.

Defined results: null texts stay null, empty ones empty; a text of which every
chunk is removed becomes empty (remove_repeated drops such rows if asked to);
repeated rows (one doc_id and text) are treated alike; a null doc_id sorts
first; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Line hashes under the rolling hash, and one boundary in so many lines.
WINDOW, DIVISOR = 2, 2
#: A line of so many words or more is a chunk of its own.
LONG = 12
#: A chunk of so many words is a passage by itself, and one of several lines from LEAST on.
PASSAGE, LEAST = 40, 8


def words_in(text: Column) -> Column:
    """Words between blanks, tabs and line feeds. Twelve bytes count as a word at least, for scripts without blanks.

    Where single blanks and line feeds part the words they are counted; other texts are brought to that form first.
    """
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    parted = lambda c: count(c, " ") + count(c, "\n") + 1
    odd = F.lit(False)
    for part in ("  ", "\t", "\r", "\n\n", " \n", "\n "):
        odd = odd | text.contains(part)
    odd = odd | text.startswith(" ") | text.endswith(" ") | text.startswith("\n") | text.endswith("\n") | (text == "")
    plain = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    words = F.when(odd, F.when(plain == "", 0).otherwise(parted(plain))).otherwise(parted(text))
    return F.greatest(words, F.floor(F.octet_length(F.trim(text)) / 12).cast("int"))


def layout(text: Column) -> Column:
    """lines, marks (alone, words) and spans (start and end, the chunks' first and last lines) of a text. Null for null."""
    lines = F.split(text, "\n", -1)
    marked = F.transform(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), words_in(x).alias("words"))), lambda m: F.struct(m["h"].alias("h"), m["words"].alias("words"), (m["words"] >= LONG).alias("alone")))

    def from_marks(m):
        def ends_here(x, i):
            hashed = F.xxhash64(*[F.get(m, i - k)["h"] for k in range(WINDOW)])
            return x["alone"] | (F.pmod(F.shiftright(hashed, 9), F.lit(DIVISOR)) == 0) | F.coalesce(F.get(m, i + 1)["alone"], F.lit(True))

        return F.filter(F.transform(m, lambda x, i: F.when(ends_here(x, i), i)), lambda e: e.isNotNull())

    # One-element arrays bind lines, marks and ends, which else were made anew at every place.
    first = F.transform(F.array(F.struct(lines.alias("lines"), marked.alias("marks"))), lambda v: F.struct(v["lines"].alias("lines"), v["marks"].alias("marks"), from_marks(v["marks"]).alias("ends")))
    made = F.transform(first, lambda v: F.struct(v["lines"].alias("lines"), v["marks"].alias("marks"), F.transform(v["ends"], lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(v["ends"], k - 1) + 1).alias("start"), e.alias("end"))).alias("spans")))
    return F.when(text.isNotNull(), F.element_at(made, 1))


def units(text: Column) -> Column:
    """The chunks of a text and its pairs of lines that aren't blank: start, end, words, several, chunk (text) and pair (SHA-256), one of these null."""
    bound = F.array(layout(text))

    def of_chunks(v):
        texts = F.transform(v["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array_join(F.slice(v["lines"], s["start"] + 1, s["end"] - s["start"] + 1), "\n").alias("chunk")))
        return F.transform(F.filter(texts, lambda t: F.length(t["chunk"]) > 0), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), words_in(t["chunk"]).alias("words"), (t["end"] > t["start"]).alias("several"), t["chunk"].alias("chunk"), F.lit(None).cast("binary").alias("pair")))

    def of_pairs(v):
        full = F.filter(F.transform(v["lines"], lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
        def near(full):
            both = F.filter(F.transform(full, lambda i, n: F.struct(i.alias("i"), F.get(full, n + 1).alias("j"))), lambda p: p["j"].isNotNull())
            both = F.filter(both, lambda p: ~(F.get(v["marks"], p["i"])["alone"] & F.get(v["marks"], p["j"])["alone"]))
            text = lambda p: F.array_join(F.slice(v["lines"], p["i"] + 1, p["j"] - p["i"] + 1), "\n")
            return F.transform(both, lambda p: F.struct(p["i"].alias("start"), p["j"].alias("end"), (F.get(v["marks"], p["i"])["words"] + F.get(v["marks"], p["j"])["words"]).alias("words"), F.lit(True).alias("several"), F.lit(None).cast("string").alias("chunk"), F.unhex(F.sha2(text(p), 256)).alias("pair")))

        return F.element_at(F.transform(F.array(full), near), 1)

    return F.when(text.isNotNull(), F.element_at(F.transform(bound, lambda v: F.concat(of_chunks(v), of_pairs(v))), 1))


def redundant(docs: DataFrame, text: str = "text") -> DataFrame:
    """The removable lines of each document: _d (doc_id), _r (row key), gone (array of line numbers)."""
    rows = docs.select("doc_id", common.row_key("doc_id", text).alias("_row"), F.explode_outer(units(F.col(text))).alias("u")).where("u is not null")
    rows = rows.select("doc_id", "_row", "u.*")
    hashed = rows.withColumn("hash", F.xxhash64("chunk", "pair")).withColumn("place", F.col("start"))
    first = F.min(F.struct("doc_id", "_row", "place"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("chunk", "pair") for n, f in (("least", F.min), ("most", F.max))]
    alike = "uses > 1 and least_chunk <=> most_chunk and least_pair <=> most_pair and (least_chunk is null or least_pair is null)"
    repeated = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"), first.alias("first"), *ends).where(alike).select(F.col("hash").alias("_hash"), "first")
    light = hashed.select("doc_id", "_row", "place", "end", "hash", "words", "several", F.col("pair").isNotNull().alias("pair"))
    again = light.join(repeated, light["hash"] == repeated["_hash"]).where(~common.same(F.struct("doc_id", "_row", "place"), F.col("first"))).drop("hash", "_hash", "first").distinct()
    order = Window.partitionBy("doc_id", "_row").orderBy("place", "end", "pair")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("_new", F.coalesce(F.col("place") > reached + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy("doc_id", "_row", "run").agg(F.min("place").alias("a"), F.max("end").alias("b"), F.max("words").alias("most"), F.max(F.when(F.col("several"), F.col("words"))).alias("multi"), F.count(F.when(F.col("pair"), 1)).alias("pairs"), F.count(F.when(~F.col("pair"), 1)).alias("chunks"))
    gone = per.where((F.col("most") >= PASSAGE) | (F.coalesce(F.col("multi"), F.lit(0)) >= LEAST) | (F.col("chunks") > 1) | (F.col("pairs") > 1))
    return gone.groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(F.flatten(F.collect_list(F.sequence("a", "b"))).alias("gone"))


def remove_repeated(docs: DataFrame, text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs without repeated passages, and n_chunks and n_removed (long; chunks that lost lines), which replace columns of these names. drop_emptied: without the rows that nothing is left of."""
    rows, back = _without_repeated(docs, text, drop_emptied)
    made = {"n_chunks", "n_removed"}
    return rows.select(*[c for c, name in zip(back, docs.columns) if name.lower() not in made], *sorted(made))


def _without_repeated(docs: DataFrame, text: str, drop_emptied: bool) -> tuple[DataFrame, list[Column]]:
    """docs in packed form, with n_chunks and n_removed, and the columns that give docs' own back."""
    packed, back = common.packed(docs, "doc_id", text)
    gone = redundant(docs.select("doc_id", text), text)
    joined = packed.join(gone, common.same(packed["doc_id"], gone["_d"]) & (common.row_key("doc_id", text) == gone["_r"]), "left").drop("_d", "_r")
    parts = joined.withColumn("_laid", layout(F.col(text)))
    spans, lines = F.col("_laid.spans"), F.col("_laid.lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    lost = F.size(F.filter(spans, lambda s: F.arrays_overlap(F.sequence(s["start"], s["end"]), F.col("gone"))))
    made = {"n_chunks": F.when(F.col("_laid").isNull(), 0).otherwise(F.size(spans)).cast("bigint"), "n_removed": F.when(F.col("gone").isNotNull(), lost).otherwise(0).cast("bigint"), text: F.when(F.col("gone").isNull(), F.col(text)).otherwise(left)}
    # A generator of one row: a filter above it isn't pushed below, where all of this would be made twice.
    out = parts.select("row", "doc_id", F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))).alias("_made")).select("row", "doc_id", *[F.col("_made")[c].alias(c) for c in made])
    if drop_emptied:
        out = out.where((F.col("n_removed") == 0) | (F.trim(F.translate(text, "\n", " ")) != ""))
    return out, back


def remove_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, its own columns alone, without repeated passages and without the rows that nothing is left of. A column n_chars follows the text where that lost lines."""
    rows, back = _without_repeated(docs, text, drop_emptied=True)
    length = lambda f: F.when(F.col("n_removed") > 0, F.length(text).cast(f.dataType)).otherwise(F.col("row")[f.name]).alias(f.name)
    return rows.select(*[length(f) if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer") else c for f, c in zip(docs.schema.fields, back)])


def op10(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_chunks", "n_removed", "text")
