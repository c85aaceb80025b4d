"""Benchmark decontamination by spaced seeds (operator 1), in SQL functions only.

A mask says which of a window's words count; the others may differ. For every
mask, all windows of the benchmark and of the corpus are hashed over the counted
words and joined on the hash. A hit names a document, an item and the offset
between them. Around the hit the document's words are laid beside the item's
along that offset, and the best-scoring run (a match +1, a mismatch -SUBST) is
the verified overlap: it may hold substitutions, one word in five at most, and
has to reach LEAST words, or the whole item where that is shorter.

Bounds: the benchmark's seeds are broadcast only if a count shows at most
BROADCAST_SEEDS of them; beyond that they are joined by shuffle and the
documents are read once more for the verification. Nothing is capped.

Defined results: null and empty texts and items match nothing; items of fewer
words than a mask match if all of their words stand consecutively; repeated rows
(one doc_id and text) and repeated items (one item_id and text) count once, while
other texts of one id are rows and items of their own; of runs that score alike the
first is taken; other columns are not returned; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Places that count are 1. The verification accepts no run that this mask doesn't hit: after its last mismatch a run has 5 matches
#: or more (else it would have ended before), and if fewer than 2 stand before that mismatch, 8 or more. No mask of 8 places does that.
MASKS = ("11011111",)
SHORT = "11111"
#: Shortest verified overlap in words, and what a mismatch costs: at 4 a run of positive score has over 4 in 5 equal.
LEAST, SUBST = 12, 4
BROADCAST_SEEDS = 500_000
#: A word: letters and digits; the case of letters doesn't count.
WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def seeds(hashes: Column, masks) -> Column:
    """An array of (place, hash of the counted words, mask) over all windows of all masks."""
    n = F.size(hashes)

    def under(k: int, mask: str) -> Column:
        width, care = len(mask), [i for i, c in enumerate(mask) if c == "1"]
        starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda p: F.struct(p.alias("place"), F.xxhash64(F.lit(k), *[F.get(hashes, p + i) for i in care]).alias("seed")))

    return F.concat(*[under(k, m) for k, m in masks])


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key (hash of the text), item (word hashes), q (place of the window) and seed."""
    base = benchmark.select("item_id", F.xxhash64("text").alias("item_key"), word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    long, width = list(enumerate(MASKS)), max(map(len, MASKS))
    # Shorter items go by words on end: the short mask, or all of their words.
    tiny = len(SHORT)
    return (
        base.withColumn("s", F.when(F.size("item") >= width, seeds(F.col("item"), long)).when(F.size("item") >= tiny, seeds(F.col("item"), [(-1, SHORT)])).otherwise(F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(F.lit(-1 - 100), F.element_at("item", 1)).alias("seed")))))
        .select("item_id", "item_key", "item", F.explode_outer("s").alias("s"))
        .where("s is not null")
        .select("item_id", "item_key", "item", F.col("s.place").alias("q"), F.col("s.seed").alias("seed"))
    )


def overlap(window: Column, item: Column) -> Column:
    """(matched, start, end, score) of the best run of window against item, word by word; places are of the window."""
    state = "struct<i:int,score:int,start:int,hits:int,best:int,b_start:int,b_end:int,b_hits:int>"
    zero = F.expr(f"cast(named_struct('i',0,'score',0,'start',0,'hits',0,'best',0,'b_start',0,'b_end',0,'b_hits',0) as {state})")

    def step(a, equal):
        score = F.when(equal, a["score"] + 1).otherwise(a["score"] - SUBST)
        hits = F.when(equal, a["hits"] + 1).otherwise(a["hits"])
        dead, better = score < 0, score > a["best"]
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(dead, 0).otherwise(score).alias("score"), F.when(dead, a["i"] + 1).otherwise(a["start"]).alias("start"), F.when(dead, 0).otherwise(hits).alias("hits"),
            F.when(better, score).otherwise(a["best"]).alias("best"), F.when(better, a["start"]).otherwise(a["b_start"]).alias("b_start"), F.when(better, a["i"] + 1).otherwise(a["b_end"]).alias("b_end"), F.when(better, hits).otherwise(a["b_hits"]).alias("b_hits"),
        ).cast(state)

    return F.aggregate(F.zip_with(window, item, lambda x, y: F.coalesce(x == y, F.lit(False))), zero, step)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Verified overlaps: doc_id, row_key, item_id, start, end (words of the document, end exclusive), matched, item_words."""
    targets = item_seeds(benchmark)
    sizes = benchmark.select(F.size(word_hashes(F.col("text"))).alias("n")).agg(F.coalesce(F.sum(F.col("n") * len(MASKS)), F.lit(0)).alias("n"), F.coalesce(F.min(F.when(F.col("n") > 0, F.col("n"))), F.lit(1 << 30)).alias("least")).first()
    masks = list(enumerate(MASKS))
    if sizes["least"] < max(map(len, MASKS)):
        masks.append((-1, SHORT))
    hashed = docs.select("doc_id", common.row_key().alias("row_key"), word_hashes(F.col("text")).alias("words"))
    made = seeds(F.col("words"), masks)
    if sizes["least"] < len(SHORT):
        made = F.concat(made, F.transform("words", lambda w, i: F.struct(i.alias("place"), F.xxhash64(F.lit(-1 - 100), w).alias("seed"))))
    windows = hashed.withColumn("s", made)
    diagonal = (F.col("p") - F.col("q")).alias("diagonal")
    beside = lambda d: F.slice("words", F.greatest(d, F.lit(0)) + 1, F.size("item"))
    if sizes["n"] <= broadcast_seeds:
        each = windows.select("doc_id", "row_key", "words", F.explode_outer("s").alias("s")).where("s is not null").select("doc_id", "row_key", "words", F.col("s.place").alias("p"), F.col("s.seed").alias("seed"))
        # The document's words stand beside the hit, so the window is cut out before anything is shuffled.
        hits = each.join(F.broadcast(targets), "seed").select("doc_id", "row_key", "item_id", "item_key", "item", diagonal, "words").select("doc_id", "row_key", "item_id", "item_key", "item", "diagonal", beside(F.col("diagonal")).alias("window"))
    else:
        each = windows.select("doc_id", "row_key", F.explode_outer("s").alias("s")).where("s is not null").select("doc_id", "row_key", F.col("s.place").alias("p"), F.col("s.seed").alias("seed"))
        pairs = each.join(targets.drop("item"), "seed").select("doc_id", "row_key", "item_id", "item_key", diagonal).distinct()
        items = benchmark.select(F.col("item_id").alias("_i"), F.xxhash64("text").alias("_k"), word_hashes(F.col("text")).alias("item")).dropDuplicates(["_i", "_k"])
        back = hashed.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_r"), "words").dropDuplicates(["_d", "_r"])
        hits = pairs.join(items, common.same(F.col("item_id"), F.col("_i")) & (F.col("item_key") == F.col("_k"))).join(back, common.same(F.col("doc_id"), F.col("_d")) & (F.col("row_key") == F.col("_r")))
        hits = hits.select("doc_id", "row_key", "item_id", "item_key", "item", "diagonal", beside(F.col("diagonal")).alias("window"))
    # A negative offset: the document begins inside the item.
    cut = F.when(F.col("diagonal") < 0, F.slice("item", 1 - F.col("diagonal"), F.size("item"))).otherwise(F.col("item"))
    once = hits.groupBy("doc_id", "row_key", "item_id", "item_key", "diagonal").agg(F.first("window").alias("window"), F.first("item").alias("item"))
    run = once.select("doc_id", "row_key", "item_id", "diagonal", F.size("item").alias("item_words"), overlap(F.col("window"), cut).alias("run"))
    start = F.greatest(F.col("diagonal"), F.lit(0)) + F.col("run.b_start")
    kept = run.where(F.col("run.b_hits") >= F.least(F.lit(LEAST), F.col("item_words")))
    return kept.select("doc_id", "row_key", "item_id", start.alias("start"), (start + F.col("run.b_end") - F.col("run.b_start")).alias("end"), F.col("run.b_hits").alias("matched"), "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that share a verified overlap."""
    found = find_overlaps(docs, benchmark)
    return found.groupBy("doc_id", "row_key", "item_id").agg(F.max_by(F.struct("start", "end", "matched", "item_words"), F.struct("matched", -F.col("start"))).alias("o"), F.count(F.lit(1)).alias("n_overlaps")).select("doc_id", "row_key", "item_id", F.col("o.start").alias("start_word"), F.col("o.end").alias("end_word"), F.col("o.matched").alias("matched"), (F.col("o.matched") / F.col("o.item_words")).alias("share"), "n_overlaps")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that share no verified overlap with the benchmark."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_r")).distinct()
    return docs.join(found, common.same(docs["doc_id"], found["_d"]) & (common.row_key() == found["_r"]), "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("row_key")
