"""Embedding near-dedup by NN-descent (operator 2).

Vectors are compared within their label only. Equal vectors of a label are
folded first. Then:

1. Random hyperplanes cut each label into cells of bounded size, TABLES times
   over, or more often where cells take more planes; the nearest LIST vectors within a cell start the neighbour graph.
2. NN-descent: every vector brings its neighbours and those it is a neighbour of
   together, and pairs among them that are nearer than what either has enter
   their lists. It ends when a round changes few entries.
3. Entries of at least the threshold are links, and their components are made. A
   list that holds nothing but links is saturated and may have pushed others out:
   its vector is compared with all vectors of other components of its label that
   the triangle inequality on angles doesn't rule out, so all of its links count.
   Within components all vectors are compared in blocks of BLOCK by BLOCK, which
   gives the numbers of links, and the components of the links that are exact.
4. Recall is audited: AUDIT vectors (those of the smallest hash of their id) are
   compared with all vectors. If fewer than RECALL of those with links have all of
   them in their component, lists and tables are doubled and the descent is run
   again; if that doesn't help, or too few of the sample have links to judge, all
   vectors of a label are compared in blocks.

Lists bound what a round explores, not the result: a link that a list pushes out
leaves a saturated list, and those are enlarged without a cap. Only pairs that enter a list leave a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing and are their own
component; vectors of one label but other lengths are never compared; repeated
rows are given repeatedly, and a vec_id counts once as a partner; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.93
#: ROUNDS only guards against a descent that never settles.
TABLES, LIST, ROUNDS, LEAST_CHANGE = 6, 10, 40, 0.002
#: The audit compares AUDIT vectors; it can judge from LINKED vectors with links on.
CELL, BLOCK, AUDIT, LINKED, RECALL = 256, 1024, 2048, 100, 0.98
#: Tables at most that leave a pair at the threshold apart in all of them.
APART = 0.01


def _stack(column) -> np.ndarray:
    """The vectors of an Arrow list column, as rows."""
    import pyarrow as pa

    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares of very large or small ones leave the range of doubles.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _runs(batches, keys: list[str]):
    """Arrow tables of the rows of each value of keys, from batches sorted by them."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            name = tuple(c[a] for c in cols)
            if held and name != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _out(a, b, c):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["u", "v", "sim"])


def _tables(bits: int, tables: int, threshold: float) -> int:
    """tables, or as many as a pair at the threshold needs to share a cell of so many bits but for a chance of APART; more in proportion where tables is over TABLES."""
    meet = (1 - np.arccos(threshold) / np.pi) ** bits
    need = int(np.ceil(np.log(APART) / np.log(1 - meet))) if meet < 1 else 1
    return max(tables, -(-need * tables // TABLES))


def _signed(vectors: DataFrame, seed: int) -> DataFrame:
    """A row for each vector (id, g, x, tables) and table: signs (bits of tables x 16 hyperplanes)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            widths, tables = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for w, n in np.unique(np.stack([widths, tables]), axis=1).T:
                at = np.flatnonzero((widths == w) & (tables == n))
                part = batch.take(pa.array(at))
                rows = _unit(_stack(part.column(4)))
                for t in range(n):
                    planes = np.random.default_rng([seed, t, int(w)]).standard_normal((int(w), 16))
                    bits = ((rows @ planes > 0) * (1 << np.arange(16))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), t, np.int32)), pa.array(bits.astype(np.int32)), part.column(4)], names=["id", "g", "t", "bits", "x"])

    return vectors.select("id", "g", F.size("x").alias("w"), "tables", "x").mapInArrow(run, "id bigint, g bigint, t int, bits int, x array<double>")


def _nearest_in_cells(cells: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for _, rows in _runs(batches, ["cell"]):
            ids, x = np.asarray(rows.column("id")), _unit(_stack(rows.column("x")))
            for a in range(0, len(ids), 512):
                sims = x[a : a + 512] @ x.T
                sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
                m = min(k, len(ids) - 1)
                if m < 1:
                    continue
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                yield _out(np.repeat(ids[a : a + 512], m), ids[top].ravel(), np.take_along_axis(sims, top, axis=1).ravel())

    return cells.repartition("cell").sortWithinPartitions("cell", "id").select("cell", "id", "x").mapInArrow(run, "u bigint, v bigint, sim double")


def _cells(vectors: DataFrame, tables: int, seed: int, threshold: float = THRESHOLD) -> DataFrame:
    """cell, id, x: cells of about CELL vectors; a cell that stays too large is dealt out by a hash."""
    per = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    bits = per.select("g", F.least(F.greatest(F.ceil(F.log2(F.col("m") / CELL)), F.lit(0)), F.lit(16)).cast("int").alias("keep"))
    bits = bits.withColumn("tables", F.get(F.array(*[F.lit(_tables(n, tables, threshold)) for n in range(17)]), "keep"))
    signed = _signed(vectors.join(bits, "g"), seed).join(bits, "g").withColumn("raw", F.xxhash64("g", "t", F.col("bits").bitwiseAND((F.expr("shiftleft(1, keep)") - 1))))
    many = signed.groupBy("raw").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 4 * CELL).select("raw", F.ceil(F.col("m") / (2 * CELL)).cast("int").alias("parts"))
    return signed.join(many, "raw", "left").select(F.xxhash64("raw", F.pmod(F.xxhash64("t", "id"), F.coalesce("parts", F.lit(1)))).alias("cell"), "id", "x")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """u, v, sim, place: the k nearest of each vector; fresh says that an entry is new."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _descend(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The pairs that a round finds: u, v, sim."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("m")).select("u", F.when(F.col("m") >= k, F.col("sim")).otherwise(-2.0).alias("worst"))
    back = graph.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.desc("sim"), "u"))).where(F.col("place") <= k)
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("id"), "fresh").union(back.select(F.col("v").alias("w"), F.col("u").alias("id"), "fresh"))
    around = around.groupBy("w", "id").agg(F.max("fresh").alias("fresh")).join(vectors.select("id", "x"), "id").join(worst.withColumnRenamed("u", "id"), "id")

    def run(batches):
        for _, rows in _runs(batches, ["w"]):
            fresh = np.asarray(rows.column("fresh"))
            if len(fresh) < 2 or not fresh.any():
                continue
            ids, worst_, x = np.asarray(rows.column("id")), np.asarray(rows.column("worst")), _unit(_stack(rows.column("x")))
            sims = x @ x.T
            i, j = np.nonzero((sims > worst_[:, None]) & ((fresh[:, None] + fresh[None, :]) > 0) & ~np.eye(len(ids), dtype=bool))
            if len(i):
                yield _out(ids[i], ids[j], sims[i, j])

    return around.repartition("w").sortWithinPartitions("w").select("w", "id", "fresh", "worst", "x").mapInArrow(run, "u bigint, v bigint, sim double")


def _forest(hit: np.ndarray) -> np.ndarray:
    """For each place the first one that it reaches by steps of hit (a symmetric matrix)."""
    root, open_ = np.arange(len(hit)), hit.any(axis=1)
    for i in np.flatnonzero(open_).tolist():
        if not open_[i]:
            continue
        front = np.array([i])
        open_[i] = False
        while len(front):
            root[front] = i
            front = np.flatnonzero(hit[front].any(axis=0) & open_)
            open_[front] = False
    return root


def _exact(vectors: DataFrame, member: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of vectors compared within their component, exactly: id and links (how many, with their multiplicity, are linked with it), and links (a, b) that connect what is linked."""
    import pyarrow as pa

    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("m")).select("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("n"))
    rows = vectors.join(member.withColumnRenamed("node", "id"), "id").join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = rows.select("id", "x", "many", "component", "b", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("id", "x", "many", "b", F.xxhash64("component", F.least("b", "other"), F.greatest("b", "other")).alias("block"))

    def run(batches):
        for _, t in _runs(batches, ["block"]):
            ids, many, b, x = np.asarray(t.column("id")), np.asarray(t.column("many")), np.asarray(t.column("b")), _unit(_stack(t.column("x")))
            inside, hit = b.min() == b.max(), np.zeros((len(ids), len(ids)), bool)
            for a in range(0, len(ids), 256):
                hit[a : a + 256] = x[a : a + 256] @ x.T >= threshold
            hit |= hit.T  # the product's rounding may differ between the two halves
            np.fill_diagonal(hit, False)
            root = _forest(hit)
            if not inside:
                hit &= b[:, None] != b[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ many), pa.array(ids[root])], names=["id", "links", "root"])

    found = dealt.select("block", "id", "x", "many", "b").repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, "id bigint, links bigint, root bigint")
    found = common.materialize(found, "exact")
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def _reached(centres: DataFrame, vectors: DataFrame) -> DataFrame:
    """c and v: the vectors (id, g, x, component) of other components that a centre (the same and reach, a cosine) of their label reaches."""
    import pyarrow as pa

    nc = centres.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("nc"))
    nv = vectors.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (8 * BLOCK)).cast("int").alias("nv"))
    parts = nc.join(nv, "g")
    part = lambda n: F.pmod(F.xxhash64(F.lit(5), "id"), F.col(n)).cast("int")
    each = lambda n: F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1))
    left = centres.join(parts, "g").select("id", "g", "x", "component", "reach", part("nc").alias("a"), each("nv").alias("b"))
    right = vectors.join(parts, "g").select("id", "g", "x", "component", F.lit(None).cast("double").alias("reach"), part("nv").alias("b"), each("nc").alias("a")).select(left.columns)
    both = left.union(right).withColumn("block", F.xxhash64("g", "a", "b"))

    def run(batches):
        for _, t in _runs(batches, ["block"]):
            ids, of, reach, x = np.asarray(t.column("id")), np.asarray(t.column("component")), t.column("reach").to_numpy(), _unit(_stack(t.column("x")))
            centre, other = np.flatnonzero(~np.isnan(reach)), np.flatnonzero(np.isnan(reach))
            for a in range(0, len(centre), 256):
                c = centre[a : a + 256]
                i, j = np.nonzero((x[c] @ x[other].T >= reach[c][:, None]) & (of[c][:, None] != of[other][None, :]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c[i]]), pa.array(ids[other[j]])], names=["c", "v"])

    return both.select("block", "id", "component", "reach", "x").repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, "c bigint, v bigint")


def _enlarged(graph: DataFrame, placed: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links (a, b) of the vectors of saturated lists with other components, all of them.

    A saturated vector stands in the ball of the linked vector of smallest hash in
    its list. What is linked with a member of a ball is at most the ball's radius
    and the threshold's angle from its centre, and is compared with the members.
    """
    import pyarrow as pa

    limit = threshold - 1e-9
    full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("m"), F.min("sim").alias("least"), F.min_by(F.struct("v", "sim"), F.xxhash64(F.lit(11), "v")).alias("to")).where((F.col("m") >= k) & (F.col("least") >= limit))
    balls = common.materialize(full.select(F.col("u").alias("id"), F.col("to.v").alias("c"), F.col("to.sim").alias("sim")), "balls")
    reach = balls.groupBy("c").agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("members"))
    wide = F.acos(F.least(F.col("sim"), F.lit(1.0))) + float(np.arccos(limit)) + 1e-7
    centres = placed.join(reach, placed["id"] == reach["c"]).select("id", "g", "x", "component", F.when(wide < np.pi, F.cos(wide)).otherwise(-2.0).alias("reach"))
    near = common.materialize(_reached(centres, placed), "reached")
    sizes = near.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nv")).join(reach.select("c", F.ceil(F.col("members") / BLOCK).cast("int").alias("nm")), "c")
    part = lambda n, v: F.pmod(F.xxhash64(F.lit(5), v), F.col(n)).cast("int")
    each = lambda n: F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1))
    inside = balls.join(sizes, "c").select("c", "id", F.lit(True).alias("member"), part("nm", "id").alias("a"), each("nv").alias("b"))
    outside = near.join(sizes, "c").select("c", F.col("v").alias("id"), F.lit(False).alias("member"), part("nv", "v").alias("b"), each("nm").alias("a")).select(inside.columns)
    both = inside.union(outside).join(placed.select("id", "x"), "id").withColumn("block", F.xxhash64("c", "a", "b"))

    def run(batches):
        for _, t in _runs(batches, ["block"]):
            ids, member, x = np.asarray(t.column("id")), t.column("member").to_numpy(), _unit(_stack(t.column("x")))
            m, o = np.flatnonzero(member), np.flatnonzero(~member)
            if not len(m) or not len(o):
                continue
            hit = x[o] @ x[m].T >= limit
            at = np.flatnonzero(hit.any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[o[at]]), pa.array(ids[m[hit[at].argmax(axis=1)]])], names=["a", "b"])

    return both.select("block", "id", "member", "x").repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, "a bigint, b bigint")


def _placed(vectors: DataFrame, member: DataFrame) -> DataFrame:
    """The vectors with their component; one without links is its own."""
    return common.materialize(vectors.join(member.withColumnRenamed("node", "id"), "id", "left").select("id", "g", "x", F.coalesce("component", "id").alias("component")), "placed")


def _merged(member: DataFrame, links: DataFrame) -> DataFrame:
    """member after further links (a, b)."""
    return common.materialize(components(member.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b"))), "members")


def _audit(placed: DataFrame, threshold: float) -> tuple[float, int, bool]:
    """Of a sample compared with all vectors: the share of the vectors with links whose links are all in their component, the number of those with links, and whether the sample is the whole table."""
    import pyarrow as pa

    picked = placed.orderBy(F.xxhash64(F.lit(3), "id")).limit(AUDIT + 1).select("id", "g", "x", "component").collect()
    whole, picked = len(picked) <= AUDIT, picked[:AUDIT]
    kinds: dict = {}
    for r in picked:
        kinds.setdefault((r["g"], len(r["x"])), []).append(r)
    stacked = [(g, w, np.array([r["id"] for r in rs]), np.array([r["component"] for r in rs]), _unit(np.array([r["x"] for r in rs]))) for (g, w), rs in kinds.items()]
    sample = placed.sparkSession.sparkContext.broadcast(stacked)

    def run(batches):
        for batch in batches:
            ids, g, of, x = (batch.column(i) for i in range(4))
            ids, g, of, width = np.asarray(ids), np.asarray(g), np.asarray(of), np.diff(np.asarray(x.offsets))
            for label, w, own, component, v in sample.value:
                at = np.flatnonzero((g == label) & (width == w))
                if not len(at):
                    continue
                near = (v @ _unit(_stack(x.take(pa.array(at)))).T >= threshold) & (own[:, None] != ids[at][None, :])
                lost = (near & (component[:, None] != of[at][None, :])).sum(axis=1)
                has = np.flatnonzero(near.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own[has]), pa.array(lost[has].astype(np.int64))], names=["id", "lost"])

    each = placed.select("id", "g", "component", "x").mapInArrow(run, "id bigint, lost bigint").groupBy("id").agg(F.sum("lost").alias("lost"))
    linked, held = each.agg(F.count(F.lit(1)), F.count(F.when(F.col("lost") == 0, 1))).first()
    return (held / linked if linked else 1.0), linked, whole


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, k: int = LIST) -> DataFrame:
    """One row for each row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept, audit_recall."""
    common.ship(embeddings.sparkSession)
    x = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.when(sound, F.xxhash64("label", F.size(x))).alias("g"), F.when(sound, x).alias("x"))
    # -0.0 and 0.0 are one value to the grouping, as to the cosine.
    folded = common.materialize(rows.where("x is not null").groupBy("g", "x").agg(F.min("vec_id").cast("bigint").alias("id"), F.count_distinct("vec_id").alias("many")), "vectors")
    while True:
        first = _nearest_in_cells(_cells(folded, tables, 1, threshold), k).withColumn("fresh", F.lit(1))
        graph = common.materialize(_best(first, k), "graph")
        for _ in range(ROUNDS):
            new = _descend(graph, folded, k).withColumn("fresh", F.lit(1))
            after = common.materialize(_best(graph.drop("place").withColumn("fresh", F.lit(0)).union(new), k), "graph")
            common.discard(graph)
            graph = after
            changed, entries = graph.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.count(F.lit(1))).first()
            if changed <= LEAST_CHANGE * entries:
                break
        member = common.materialize(components(graph.where(F.col("sim") >= threshold - 1e-9).select(F.col("u").alias("a"), F.col("v").alias("b"))), "members")
        member = _merged(member, _enlarged(graph, _placed(folded, member), k, threshold))
        placed = _placed(folded, member)
        recall, linked, whole = _audit(placed, threshold)
        sure = whole or linked >= LINKED
        if sure and recall >= RECALL:
            break
        if not sure or k > 4 * LIST:
            # More lists don't help, or the sample can't tell: every vector is compared with all of its label.
            links = _reached(placed.withColumn("reach", F.lit(threshold - 1e-9)), placed)
            member = _merged(member, links.select(F.col("c").alias("a"), F.col("v").alias("b")))
            recall = 1.0
            break
        tables, k = 2 * tables, 2 * k
    # Up to here a little under the threshold was let pass; the components are those of the exact links.
    exact, links = _exact(folded, member, threshold)
    member = common.materialize(components(links), "members")
    node = folded.join(member.withColumnRenamed("node", "id"), "id", "left").join(exact, "id", "left").select("g", "x", "many", "id", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(node, common.same(rows["g"], node["g"]) & (rows["x"] == node["x"]), "left")
    component = F.coalesce(F.col("component"), F.col("vec_id")).cast("bigint")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("many") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), common.same(F.col("vec_id"), component).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
