"""Proximity graphs: partitioned construction, persistence, updates, search, integrity and traversal.

An index is one table, a row a node, dealt into parts: the cells of a few
centroids, large cells cut further by a hash of the id.  Every part is a
layered graph of its own (:mod:`hnsw`) that one task builds, updates or
searches; the number of parts follows from the rows, also as rows are inserted,
so neither a part nor what is found in it changes as the table grows.  A query meets the parts of its nearest cells, which
come to it in runs, and their answers are merged.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import strict_bounds
from ..sources.scratch import cut
from . import hnsw, lockstep
from .sampling import centroids, positions
from .search import blocks_of, ranked

#: Rows of a part, rows that the centroids are fitted on, and cells at most (larger cells are cut by a hash).  Vectors without
#: clusters have neighbours in every cell, so few cells keep the share of the table that a query meets, however it grows;
#: and a search of fixed breadth finds less in a larger part, so parts are small.
PART, SAMPLE, CELLS = 1000, 20_000, 4
#: Runs of parts that the queries are sent to, unless a run would have more parts than that.
RUNS, LONGEST = 64, 20
FORMAT = "velarium-graph-1"
STATE = "part int, slot int, id long, level int, deleted boolean, embedding array<double>, links array<array<long>>"


@dataclass(frozen=True)
class Index:
    state: DataFrame  #: of the columns STATE
    m: int
    ef: int  #: candidates that construction looks at
    seed: int
    centers: np.ndarray  #: one row a cell
    first: tuple[int, ...]  #: the first part of each cell, and their number at the end

    @property
    def parts(self) -> int:
        return self.first[-1]


def levels(df: DataFrame, m: int, seed: int = 100) -> DataFrame:
    """id and level of each vector."""
    return df.select(F.col("vec_id").alias("id"), level_of(F.col("vec_id"), m, seed).alias("level"))


def level_of(id_: Column, m: int, seed: int) -> Column:
    """floor(-ln(u) / ln(m)) with u a hash of the id: a node's level does not depend on the order of insertion."""
    u = (F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return F.floor(-F.ln(u) / math.log(m)).cast("int")


def _nearest_cells(centers: np.ndarray, probe: int):
    """The ``probe`` nearest cells of a vector, nearest first."""
    squares = (centers**2).sum(axis=1)

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        order = np.argsort(squares - 2 * (v @ centers.T), axis=1, kind="stable")[:, :probe] if len(v) else np.zeros((0, probe))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * order.shape[1], pa.int32()), pa.array(order.reshape(-1).astype(np.int32)))

    return cells


def _part_of(index_first: tuple[int, ...], cell: Column, id_: Column) -> Column:
    """A cell's part for an id: a cell's parts are numbered in a row."""
    first = F.array(*[F.lit(n) for n in index_first])
    begin, end = F.get(first, cell), F.get(first, cell + 1)
    return (begin + F.pmod(F.xxhash64(id_), end - begin)).cast("int")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; null components are NaN."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), len(vectors[0]))


def _table(part: int, built: hnsw.Part | lockstep.Flat) -> pa.Table:
    rows = built.rows()
    columns = [[part] * len(rows), list(range(len(rows))), *map(list, zip(*rows, strict=True))]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "slot", "id", "level", "deleted", "embedding", "links"])


def _opened(table: pa.Table, m: int, ef: int) -> hnsw.Part:
    table = table.sort_by("slot")
    return hnsw.Part.of(list(zip(*(table.column(c).to_pylist() for c in ("id", "level", "deleted", "embedding", "links")), strict=True)), m, ef)


def build(base: DataFrame, m: int = 8, ef: int = 32, seed: int = 100, rows: int = PART) -> Index:
    """The index of ``base`` (vec_id, embedding); of rows with one id the greatest vector counts.

    Level 0 keeps up to 2 * m links a node, upper levels m.
    """
    base = base.where("embedding is not null").groupBy("vec_id").agg(F.max(F.col("embedding").cast("array<double>")).alias("embedding"))
    base = cut(base.withColumn("level", level_of(F.col("vec_id"), m, seed)))
    n = base.count()
    parts = max(-(-n // rows), min(blocks_of(base), -(-n // 256)), 1)
    centers = centroids(base, min(parts, CELLS), SAMPLE)
    placed = cut(base.withColumn("cell", _nearest_cells(centers, 1)("embedding")[0]))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most CELLS rows
    share = max(1, -(-(2 if parts <= CELLS else 1) * n // parts))
    first = [0]
    for c in range(len(centers)):
        first.append(first[-1] + max(1, -(-sizes.get(c, 0) // share)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = _matrix(table.column("embedding"))
        if np.isfinite(vectors).all():
            part = lockstep.built(table.column("vec_id").to_numpy(), vectors, table.column("level").to_numpy(), m, ef)
        else:
            part = hnsw.Part(vectors.shape[1], m, ef)
            for id_, v, level in zip(table.column("vec_id").to_pylist(), vectors, table.column("level").to_pylist(), strict=True):
                part.insert(id_, v, level)
        return _table(table.column("part")[0].as_py(), part)

    dealt = placed.select(_part_of(tuple(first), F.col("cell"), F.col("vec_id")).alias("part"), "vec_id", "embedding", "level")
    return Index(cut(dealt.groupBy("part").applyInArrow(run, STATE)), m, ef, seed, centers, tuple(first))


# Persistence


def save(index: Index, folder: str, mode: str = "error") -> None:
    """Write the index below a folder, header last: a folder without one is no index."""
    spark = index.state.sparkSession
    index.state.write.mode(mode).parquet(f"{folder}/nodes")
    head = {"format": FORMAT, "m": index.m, "ef": index.ef, "seed": index.seed, "centers": index.centers.tolist(), "first": index.first}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/header")


def load(spark: SparkSession, folder: str) -> Index:
    head = json.loads(spark.read.text(f"{folder}/header", wholetext=True).first()[0])
    if head["format"] != FORMAT:
        raise ValueError(f"not an index of this format: {head['format']}")
    return Index(spark.read.schema(STATE).parquet(f"{folder}/nodes"), head["m"], head["ef"], head["seed"], np.array(head["centers"]), tuple(head["first"]))


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """A saved index's header and totals: one row."""
    index = load(spark, folder)
    files = spark.read.parquet(f"{folder}/nodes").select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("bytes"))
    s = index.state
    totals = s.agg(
        F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dim"), F.max("level").alias("top_level"), F.min("id").alias("least_id"), F.max("id").alias("most_id"),
        F.count_if("deleted").alias("deleted"), F.sum(F.aggregate("links", F.lit(0), lambda n, x: n + F.size(x))).alias("links"),
    )
    return totals.crossJoin(F.broadcast(files)).select(F.lit(FORMAT).alias("format"), F.lit(index.m).alias("m"), F.lit(index.parts).alias("parts"), "*")  # one row each


# Updates


def rebalanced(index: Index, rows: int = PART) -> Index:
    """The index with more parts for cells whose parts have grown to over twice ``rows`` on average; those cells are built anew.

    Parts are numbered cell by cell, so the others only move up.
    """
    first = F.array(*[F.lit(n) for n in index.first])
    cell = F.size(F.filter(first, lambda n: n <= F.col("part"))) - 1
    sizes = {r["cell"]: r["count"] for r in index.state.groupBy(cell.alias("cell")).count().collect()}  # at most CELLS rows
    old = [b - a for a, b in zip(index.first, index.first[1:], strict=False)]
    new = [-(-sizes.get(c, 0) // rows) if sizes.get(c, 0) > 2 * rows * n else n for c, n in enumerate(old)]
    if new == old:
        return index
    begin = [0]
    for n in new:
        begin.append(begin[-1] + n)
    grown = [c for c, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
    state = cut(index.state.withColumn("_cell", cell))
    shift = F.get(F.array(*[F.lit(b - a) for a, b in zip(index.first, begin, strict=True)]), F.col("_cell"))
    kept = state.where(~F.col("_cell").isin(grown)).withColumn("part", (F.col("part") + shift).cast("int")).select(*index.state.columns)
    m, ef = index.m, index.ef

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        part = hnsw.Part(len(table.column("embedding")[0]), m, ef)
        for id_, v, level in zip(*(table.column(c).to_pylist() for c in ("id", "embedding", "level")), strict=True):
            part.insert(id_, np.array(v, np.float64), level)
        gone = {i for i, d in zip(table.column("id").to_pylist(), table.column("deleted").to_pylist(), strict=True) if d}
        part.deleted = {s for s, i in enumerate(part.ids) if i in gone}
        return _table(table.column("part")[0].as_py(), part)

    again = state.where(F.col("_cell").isin(grown)).select(_part_of(tuple(begin), F.col("_cell"), F.col("id")).alias("part"), "id", "embedding", "level", "deleted")
    return replace(index, state=cut(kept.unionByName(again.groupBy("part").applyInArrow(run, STATE))), first=tuple(begin))


def _reworked(index: Index, changes: DataFrame, work: Callable[[hnsw.Part, pa.Table], None]) -> Index:
    """The index with ``work`` done on the parts that ``changes`` (part, ...) name; other parts' rows pass by."""
    changes = cut(changes)
    touched = changes.select("part").distinct()
    m, ef = index.m, index.ef

    def run(key: tuple, state: pa.Table, new: pa.Table) -> pa.Table:
        part = _opened(state, m, ef) if state.num_rows else hnsw.Part(len(new.column("embedding")[0]), m, ef)
        work(part, new)
        return _table(key[0].as_py(), part)

    own = index.state.join(touched, "part", "left_semi")
    redone = own.groupBy("part").cogroup(changes.groupBy("part")).applyInArrow(run, STATE)
    return replace(index, state=cut(index.state.join(touched, "part", "left_anti").unionByName(redone)))


def insert(index: Index, rows: DataFrame, reuse: bool = False, size: int = PART) -> Index:
    """Add vectors (vec_id, embedding) and move the ids that are there, relinking what they leave and join.

    ``reuse``: new ids take over the slots of deleted ones in their part first.
    Cells whose parts outgrow ``size`` are given more (:func:`rebalanced`), so
    a task's share stays bounded however much is inserted.
    """
    rows = rows.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    cell = _nearest_cells(index.centers, 1)("embedding")[0]
    placed = rows.withColumn("_new", _part_of(index.first, cell, F.col("vec_id"))).withColumn("level", level_of(F.col("vec_id"), index.m, index.seed))
    there = index.state.select(F.col("id").alias("vec_id"), F.col("part").alias("_old"))
    changes = placed.join(there, "vec_id", "left").select(F.coalesce("_old", "_new").alias("part"), "vec_id", "embedding", "level")

    def work(part: hnsw.Part, new: pa.Table) -> None:
        new = new.sort_by("vec_id")
        for id_, v, level in zip(*(new.column(c).to_pylist() for c in ("vec_id", "embedding", "level")), strict=True):
            part.insert(id_, np.array(v, np.float64), level, reuse)

    return rebalanced(_reworked(index, changes, work), size)


def _marked(index: Index, ids: DataFrame, deleted: bool, problem: str) -> Index:
    named = ids.select(F.col("vec_id").alias("id")).distinct().withColumn("_named", F.lit(True))
    joined = index.state.join(named, "id", "full")
    wrong = F.col("_named") & (F.col("part").isNull() | (F.col("deleted") == deleted))
    fails = F.raise_error(F.concat(F.lit(f"{problem}: "), F.col("id").cast("string"))).cast("boolean")
    flag = F.when(F.coalesce(wrong, F.lit(False)), fails).when(F.col("_named"), F.lit(deleted)).otherwise(F.col("deleted"))
    state = joined.withColumn("deleted", flag).select(*index.state.columns)
    return replace(index, state=cut(state))


def delete(index: Index, ids: DataFrame) -> Index:
    """Mark ids (vec_id) as deleted: passed through, never returned.  Deleting twice is an error."""
    return _marked(index, ids, True, "already deleted or unknown")


def undelete(index: Index, ids: DataFrame) -> Index:
    return _marked(index, ids, False, "not deleted")


# Search


def search_counted(
    index: Index, queries: DataFrame, k: int, ef: int = 64, probe: int | None = None, dual_queue: bool | tuple[int, int] = False, radius: float | None = None, least: int = 0, documents: int | None = None, admit: DataFrame | None = None
) -> DataFrame:
    """What each query finds in each part it meets: qid, part, vec_id, d, and on a row without vec_id the part's counters.

    ``probe``: how many of the nearest cells a query meets (default: 8, or all
    if there are fewer).  ``ef`` below k decouples the spread from the result.
    ``dual_queue`` prunes by the k least lower bounds of what is kept, or, as
    (size, warmup), by a queue of that size that fills a batch at a time.  ``radius`` (and ``least``) returns
    what lies within.  ``documents``: an id modulo that number is its document,
    and k distinct ones are returned; with ``ef`` no less than the documents
    every slot of the parts met is looked at.  ``admit``: only these ids (vec_id) are.
    Where no slot is deleted or left out, the searches for a number of nearest slots go on together (:mod:`lockstep`).
    """
    cells = len(index.centers)
    met = min(cells, probe or 8)
    m, build_ef, first = index.m, index.ef, F.array(*[F.lit(n) for n in index.first])
    # A run has parts of one cell.
    size = min(LONGEST, -(-index.parts // RUNS))
    begin = [0, *np.cumsum([-(-(b - a) // size) for a, b in zip(index.first, index.first[1:], strict=False)]).tolist()]
    runs = F.array(*[F.lit(n) for n in begin])
    near = queries.where("query is not null").select("qid", F.col("query").cast("array<double>").alias("embedding")).withColumn("cell", F.explode(_nearest_cells(index.centers, met)("embedding")))
    asked = near.select(F.explode(F.sequence(F.get(runs, F.col("cell")), F.get(runs, F.col("cell") + 1) - 1)).alias("run"), "qid", "embedding")
    cell = F.size(F.filter(first, lambda n: n <= F.col("part"))) - 1
    state = index.state.withColumn("run", (F.get(runs, cell) + F.floor((F.col("part") - F.get(first, cell)) / size)).cast("int"))
    if admit is not None:
        state = state.join(admit.select(F.col("vec_id").alias("id"), F.lit(True).alias("_ok")), "id", "left").select(*state.columns, F.coalesce("_ok", F.lit(False)).alias("admitted"))
    kinds = pa.schema([("qid", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("d", pa.float64()), ("distances", pa.int64()), ("pruned", pa.int64()), ("hops", pa.int64()), ("upper", pa.int64())])
    queue_of = None if not dual_queue else (k, k) if dual_queue is True else dual_queue
    plain = documents is None and radius is None and admit is None

    def together(number: int, qid: np.ndarray, x: np.ndarray, rows: pa.Table) -> pa.Table:
        part = lockstep.Flat.of(rows, m)
        at, slot, d, counts = part.search(x, k, ef, queue_of)
        no = lambda n, kind: pa.nulls(n, kind)
        found = [qid[at], np.full(len(at), number), part.ids[slot], d, *[no(len(at), pa.int64())] * 4]
        counted = [qid, np.full(len(qid), number), no(len(qid), pa.int64()), no(len(qid), pa.float64()), *(counts[c] for c in ("distances", "pruned", "hops", "upper"))]
        return pa.concat_tables(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds) for columns in (found, counted))

    def one_by_one(number: int, qid: np.ndarray, x: np.ndarray, rows: pa.Table) -> pa.Table:
        out, part = [], _opened(rows, m, build_ef)
        ok = np.array(rows.sort_by("slot").column("admitted").to_pylist(), bool) if "admitted" in rows.column_names else None
        bounds = strict_bounds(part.vectors) if dual_queue else None
        for i, y in zip(qid.tolist(), x, strict=True):
            if documents is not None:
                stop = hnsw.Documents(lambda s: part.ids[s] % documents, k, ef)
            elif radius is not None:
                stop = hnsw.Within(radius, k, least, ef)
            else:
                stop = hnsw.Decoupled(k, ef) if ef < k else hnsw.Stop(k, ef)
            queue = None if not dual_queue else hnsw.Bounds(k, k) if dual_queue is True else hnsw.Bounds(*dual_queue, batched=True)
            if documents is not None and ef >= documents:  # nothing may end the search or be passed over
                found, counts = part.scan(y, stop, ok)
            else:
                found, counts = part.search(y, stop, ok, bounds, queue)
            out += [(i, number, part.ids[s], d, None, None, None, None) for d, s in found]
            out.append((i, number, None, None, *(counts[c] for c in ("distances", "pruned", "hops", "upper"))))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        q, rows = both.filter(pc.is_valid(both.column("qid"))), both.filter(pc.is_null(both.column("qid")))
        del both
        if q.num_rows and rows.num_rows:
            qid, x = q.column("qid").to_numpy(), _matrix(q.column("embedding"))
            for number in pc.unique(rows.column("part")).to_pylist():
                own = rows.filter(pc.equal(rows.column("part"), number))
                sound = plain and not pc.any(own.column("deleted")).as_py() and np.isfinite(x).all() and np.isfinite(_matrix(own.column("embedding"))).all()
                yield from (together if sound else one_by_one)(number, qid, x, own).to_batches()

    # A task a run: dealt by a hash, some tasks would have several and others none.
    dealt = state.withColumn("qid", F.lit(None).cast("long")).unionByName(asked, allowMissingColumns=True).repartitionById(min(begin[-1], 4096), "run")
    return dealt.groupBy("run").applyInArrow(run, "qid long, part int, vec_id long, d double, distances long, pruned long, hops long, upper long")


def search(index: Index, queries: DataFrame, k: int, **how) -> DataFrame:
    """qid, rank, vec_id, d: :func:`search_counted`, merged over the parts."""
    hits = search_counted(index, queries, k, **how).where("vec_id is not null").select("qid", "vec_id", "d")
    if how.get("documents") is not None:
        best = hits.groupBy("qid", F.pmod("vec_id", F.lit(how["documents"])).alias("doc_id")).agg(F.min(F.struct("d", "vec_id")).alias("b"))
        return ranked(best.select("qid", "doc_id", "b.vec_id", "b.d"), k).select("qid", "rank", "doc_id", "vec_id", "d")
    out = ranked(hits, k)
    if how.get("radius") is not None:
        out = out.where((F.col("d") <= how["radius"]) | (F.col("rank") <= how.get("least", 0)))
    return out.select("qid", "rank", "vec_id", "d")


def counters(counted: DataFrame) -> DataFrame:
    """Distances, pruned candidates, hops and upper levels of each query, over its parts."""
    return counted.where("vec_id is null").groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("distances", "pruned", "hops", "upper")])


# The graph as tables


def nodes_of(index: Index) -> DataFrame:
    return index.state.select("id", "level", "deleted")


def edges_of(index: Index) -> DataFrame:
    """level, src, dst of every link."""
    own = index.state.select(F.col("id").alias("src"), F.posexplode("links").alias("level", "own"))
    return own.select(F.col("level").cast("int").alias("level"), "src", F.explode("own").alias("dst"))


def census(index: Index) -> DataFrame:
    """One row: nodes, and how many self loops, repeated links, overfull lists, and links to what does not stand on their level."""
    e, nodes, m = edges_of(index), nodes_of(index), index.m
    met = e.join(nodes.select(F.col("id").alias("dst"), F.col("level").alias("stands")), "dst", "left")
    lists = met.groupBy("level", "src").agg(
        F.count("*").alias("n"), F.countDistinct("dst").alias("distinct"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.coalesce(F.col("stands"), F.lit(-1)) < F.col("level")).alias("astray")
    )
    cap = F.when(F.col("level") == 0, 2 * m).otherwise(m)
    found = lists.agg(
        F.coalesce(F.sum("loops"), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.col("n") - F.col("distinct")), F.lit(0)).alias("repeated"), F.count_if(F.col("n") > cap).alias("overfull"),
        F.coalesce(F.sum("astray"), F.lit(0)).alias("astray"),
    )
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(found))  # one row each


def hot(nodes: DataFrame, edges: DataFrame, target: int) -> DataFrame:
    """``target`` nodes (id, level) of level 1 on, the highest levels first, inside a level by links on it, then by id."""
    degree = edges.groupBy(F.col("src").alias("id"), F.col("level")).agg(F.count("*").alias("degree"))
    ranked_ = nodes.where("level >= 1").join(degree, ["id", "level"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked_.orderBy(F.col("level").desc(), F.col("degree").desc(), "id").limit(target).select("id", "level", "degree")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Self loops, repeated links and nodes that no link reaches."""
    e = edges.select("level", "src", "dst")
    loops = e.where("src = dst").select("level", F.col("src").alias("id"), F.lit("self loop").alias("problem"))
    again = e.groupBy("level", "src", "dst").count().where("count > 1").select("level", F.col("src").alias("id"), F.lit("repeated link").alias("problem"))
    alone = nodes.join(e.where("level = 0"), F.col("id") == F.col("dst"), "left_anti").select(F.lit(0).alias("level"), "id", F.lit("no inbound link").alias("problem"))
    return loops.unionByName(again).unionByName(alone)


def degree_stats(edges: DataFrame) -> DataFrame:
    """Least, most and mean inbound links of each level's linked nodes."""
    n = edges.groupBy("level", "dst").agg(F.count("*").alias("n"))
    return n.groupBy("level").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def bfs(edges: DataFrame, start: int, nodes: DataFrame | None = None) -> DataFrame:
    """id and hop of the nodes reachable from ``start``.

    With ``nodes`` (id) the traversal then starts again at the smallest node not
    visited yet, until all are; ``turn`` counts the starts, and hops count from
    the turn's own start.  A node is visited in the turn of the smallest node
    that reaches it (``start`` before all others), since whatever reaches that
    one reaches both.  So all turns go on at once: nodes hand their least (root, hop)
    along the edges as long as any becomes less, which takes as many joins as the
    longest turn has hops, however many turns there are.
    """
    spark = edges.sparkSession
    late = F.col("root") != start
    seeds = spark.createDataFrame([(start,)], "id long")
    if nodes is not None:
        seeds = seeds.unionByName(nodes.select(F.col("id").cast("long").alias("id"))).distinct()
    labels = cut(seeds.select("id", F.struct((F.col("id") != start).alias("late"), F.col("id").alias("root"), F.lit(0).alias("hop")).alias("l")))
    front = labels
    while True:
        onward = F.struct(F.col("l.late").alias("late"), F.col("l.root").alias("root"), (F.col("l.hop") + 1).alias("hop"))
        told = edges.join(front.hint("merge"), F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min(onward).alias("n"))
        front = cut(told.join(labels.hint("merge"), "id", "left").where(F.col("l").isNull() | (F.col("n") < F.col("l"))).select("id", F.col("n").alias("l")))
        if front.isEmpty():
            break
        labels = cut(labels.unionByName(front).groupBy("id").agg(F.min("l").alias("l")))
    seen = labels.select("id", "l.root", "l.hop")
    if nodes is None:
        return seen.select("id", "hop")
    roots = positions(seen.where("id = root").select("root", late.alias("late")), ["late", "root"], [], "turn").where(late).select("root", F.col("turn").cast("int").alias("turn"))
    first = seen.where(~late).select("id", "hop", F.lit(0).alias("turn"))  # most nodes, without a join on one key
    return first.unionByName(seen.where(late).join(roots.hint("merge"), "root").select("id", "hop", "turn"))


def bfs_order(seen: DataFrame, edges: DataFrame) -> DataFrame:
    """Visited nodes with what orders them: turn if there is one, hop, degree, id."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return seen.join(degree, "id", "left").select(*seen.columns, F.coalesce("degree", F.lit(0)).alias("degree"))


def slots(order: DataFrame) -> DataFrame:
    """id and slot: places without gaps by turn, hop, falling degree and id, for :func:`bfs_order`'s rows; dealt out in ranges."""
    by = [F.col("turn"), F.col("hop"), F.col("degree").desc(), F.col("id")]
    dealt = cut(order.repartitionByRange(max(1, -(-order.count() // 65_536)), *by).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("n")).select(F.col("_part").alias("_p"), before.alias("_before"))  # a row for 65,536 nodes
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return dealt.withColumn("_in", inside).join(parts, F.col("_part") == F.col("_p")).select("id", (F.col("_in") + F.col("_before")).alias("slot"))
