"""The engine from Spark SQL: functions and table functions for a session.

``vector_distance(name, a, b)`` is any distance of the registry, null where a
vector is null or the lengths differ.  ``nearest(TABLE(t) PARTITION BY (cell),
k, name)`` takes rows ``asked`` (a query or a base row), ``id`` and ``vec``; for
each partition it gives qid, vec_id and d of the rows that may be among a
query's k nearest, which a ranked window over all partitions settles.  A
partition holds a bounded part of either side: base rows are dealt by a hash
and queries repeated for each cell, in SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.kernels import KERNELS
from .sampling import matrices
from .search import _nearest, _nearest_by


def _distance(name: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.full(len(a), np.nan)
    there = np.zeros(len(a), bool)
    names = np.array(name.to_pylist(), object)
    for dim in np.unique(np.diff(a.offsets.to_numpy())).tolist():
        left, right = dict(), dict()
        for side, column in ((left, a), (right, b)):
            for at, v in matrices(column, dim):
                side.update(zip(at.tolist(), v, strict=True))
        both = sorted(left.keys() & right.keys())
        for n in {names[i] for i in both}:
            kernel, rows = KERNELS[n], [i for i in both if names[i] == n]
            x, y = kernel.prepare(np.array([left[i] for i in rows])), kernel.prepare(np.array([right[i] for i in rows]))
            out[rows] = [kernel.distances(x[k], y[k : k + 1])[0] for k in range(len(rows))]
        there[both] = True
    return pa.array(out, mask=~there)


class Nearest:
    """The table function's handler; see the module."""

    def __init__(self):
        self.batches, self.k, self.name = [], 0, "fp32"

    def eval(self, batch: pa.RecordBatch, k: pa.Array, name: pa.Array):
        if batch.num_rows:
            self.batches.append(batch)
            self.k, self.name = k[0].as_py(), name[0].as_py()
        return iter(())

    def terminate(self):
        if not self.batches:
            return
        rows = pa.Table.from_batches(self.batches)
        asked, ids, vec = rows.column("asked").to_numpy(), rows.column("id").to_numpy(), rows.column("vec").combine_chunks()
        cell = _nearest(self.k) if self.name == "fp32" else _nearest_by(self.name, self.k)
        for dim in np.unique(np.diff(vec.offsets.to_numpy())).tolist():
            for at, v in matrices(vec, dim):
                mine = asked[at].astype(bool)
                base = np.flatnonzero(~mine)
                base = base[np.argsort(ids[at][base], kind="stable")]
                if mine.any() and len(base):
                    for found in cell(ids[at][mine], v[mine], ids[at][base], v[base]):
                        yield pa.table({"qid": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "d": pa.array(found[2], pa.float64())})


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    spark.udf.register("vector_distance", F.arrow_udf(_distance, DoubleType()))
    spark.udtf.register("nearest", F.arrow_udtf(Nearest, returnType="qid long, vec_id long, d double"))
