"""Labelled rows for the classifiers of this subpackage.

Models are fitted on the driver on a bounded sample: of the rows with a label
that don't belong to the held-out third, those of the smallest hash of their
doc_id, up to a number of rows and of characters that are parameters. Statistics
of the corpus are never taken from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of one label, and characters in all, that a model is fitted on at most.
ROWS, CHARS = 1500, 16_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents, whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, chars: int = CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) to fit on. Rows of null ids, texts or labels, and ids labelled both ways, are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    one = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    picked = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows)
        picked = part if picked is None else picked.union(part)
    # At most 2 * rows ids: small enough to broadcast whatever the corpus.
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    texts, ys, total = [], [], 0
    for r in found.select("doc_id", "text", "y").orderBy(F.xxhash64(F.lit(12), F.col("doc_id")), "doc_id", "text").toLocalIterator():
        if total + len(r["text"]) > chars and texts:
            break
        total += len(r["text"])
        texts.append(r["text"])
        ys.append(r["y"])
    return texts, ys
