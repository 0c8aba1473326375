"""Chat formatting of reply trees: root-to-leaf paths, ranked, each formatted as one conversation.

Messages form trees by their parent ids.  Paths are found by iterative
self-joins that double the distance: level k holds every message that has an
ancestor 2**k steps up, with that ancestor and the scores in between, and
comes from level k - 1 joined to itself.  A tree of depth d takes log2(d)
joins, and a message drops out as soon as its root is nearer.  A leaf climbs
the levels from the highest one down to its root, which gives its path's
length and score; a tree's leaves are ranked by score and the best ``top``
paths (or all) are spelt out over the same levels.

A formatted turn is ``### role: text</turn>`` and a line break.  A backslash
goes before every backslash and ``#`` of a text and before a slash behind
``<``, so no marker occurs inside a text and reading back is splitting at
markers and taking the backslashes out; in a role a colon gets one as well.
The loss mask is a list of spans, in code points, over the texts of the
``assistant``.  A conversation is stored in segments of ``TURNS`` turns, so no
row holds an unbounded one; most have a single segment.

Defined cases: null texts and roles are empty, null scores 0; a message whose
parent is null, itself or not there is a root; messages that repeat a tree and
id are branches of their own, and replies go to the first by role and text;
a message without an id has no replies; messages in or below a circle have no
root and are on no path; equal scores rank by the leaf's id (nulls first),
then by its content; a null tree is one of its own; other columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import cut
from .ordering import numbered, placed

TURNS = 64
LEARNT = "assistant"
MESSAGE = ("tree", "id", "parent", "role", "text", "score")


def chained(turns: DataFrame, tree: str, order: str) -> DataFrame:
    """Conversations as trees of a single branch: messages of ``turns`` (tree, order, role, text), each answering the one before.

    Nulls of ``order`` come first; equal ones are ordered by role and text's digest.
    """
    rows = turns.select(F.col(tree).alias("tree"), F.col(order).alias("at"), "role", "text")
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = numbered(placed(rows, [F.col("tree").asc_nulls_first(), F.col("at").asc_nulls_first(), F.coalesce("role", F.lit("")), content]), number="id")
    before = rows.select((F.col("id") + 1).alias("_next"), F.col("tree").alias("_tree"), F.col("id").alias("parent"))
    linked = rows.join(before, (F.col("id") == F.col("_next")) & F.col("tree").eqNullSafe(F.col("_tree")), "left")
    return linked.select("tree", "id", "parent", "role", "text", F.lit(0.0).alias("score"))


def _links(messages: DataFrame) -> DataFrame:
    """node, up, gain of every message that answers another one; messages have _row."""
    content = F.struct(F.coalesce("role", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256), "_row")
    first = messages.where("id is not null").groupBy(F.col("tree").alias("_tree"), F.col("id").alias("_id")).agg(F.min(content)["_row"].alias("up"))
    own = messages.where("parent is not null").select("tree", "parent", F.col("_row").alias("node"), F.coalesce("score", F.lit(0.0)).cast("double").alias("gain"), F.col("id"))
    own = own.where(~F.col("parent").eqNullSafe(F.col("id"))).drop("id")
    return own.join(first, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_id"))).select("node", "up", "gain")


def levels(links: DataFrame) -> tuple[list[DataFrame], bool]:
    """Of each k, the messages with an ancestor 2**k steps up; and whether there are circles."""
    found = [cut(links)]
    before = found[0].count()
    while before:
        low, high = found[-1].alias("low"), found[-1].alias("high")
        step = low.join(high, F.col("low.up") == F.col("high.node"))
        step = cut(step.select("low.node", "high.up", (F.col("low.gain") + F.col("high.gain")).alias("gain")))
        left = step.count()
        if left == before:  # no message has its root within twice the distance, so none has one at all
            return found, True
        if left:
            found.append(step)
        before = left
    return found, False


def branches(messages: DataFrame, steps: list[DataFrame], circles: bool, top: int | None) -> DataFrame:
    """The best paths: leaf, path (rank from 0), depth and total score."""
    rows = messages.select("tree", "id", F.col("_row").alias("leaf"), F.lit(0.0).alias("total"), F.struct(F.coalesce("role", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content"))
    answered = steps[0].select(F.col("up").alias("_up")).distinct()
    at = rows.join(answered, F.col("leaf") == F.col("_up"), "left_anti").withColumn("at", F.col("leaf")).withColumn("depth", F.lit(0).cast("long"))
    for k in range(len(steps) - 1, -1, -1):
        at = at.join(steps[k].select("node", "up", "gain"), F.col("at") == F.col("node"), "left").select(
            "tree", "id", "leaf", "content", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("depth"),
            (F.col("total") + F.when(F.col("up").isNull(), F.lit(0.0)).otherwise(F.col("gain"))).alias("total"))
    if circles:
        at = at.join(steps[0].select("node"), F.col("at") == F.col("node"), "left_anti")
    # A level's gain counts its lower end and not its upper one, so the root's score is still to come.
    root = messages.select(F.col("_row").alias("_root"), F.coalesce("score", F.lit(0.0)).cast("double").alias("_of_root"))
    at = at.join(root, F.col("at") == F.col("_root")).withColumn("total", F.col("total") + F.col("_of_root"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("id").asc_nulls_first(), "content", "leaf")) - 1
    ranked = at.withColumn("path", rank)
    return (ranked if top is None else ranked.where(F.col("path") < top)).select("tree", "leaf", "path", "depth", "total")


def spelt_out(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Every message of the chosen paths: tree, path, position (0 is the root) and node."""
    at = chosen.select("tree", "path", F.col("depth").alias("position"), F.col("leaf").alias("node"))
    for k in range(len(steps) - 1, -1, -1):
        up = steps[k].select(F.col("node").alias("_node"), "up")
        both = F.array(F.struct("position", "node"), F.struct((F.col("position") - (1 << k)).alias("position"), F.col("up").alias("node")))
        alone = F.array(F.struct("position", "node"))
        at = at.join(up, F.col("node") == F.col("_node"), "left").select("tree", "path", F.explode(F.when(F.col("up").isNull(), alone).otherwise(both)).alias("x"))
        at = at.select("tree", "path", "x.position", "x.node")
    return at


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#{more}]|(?<=<)/)", r"\\$1")


def formatted(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """The output, stored and read back: tree, path, segment, formatted and loss (spans of start and chars)."""
    rows = cut(messages.select(*MESSAGE, F.monotonically_increasing_id().alias("_row")))
    steps, circles = levels(_links(rows))
    chosen = cut(branches(rows, steps, circles, top))
    where = spelt_out(chosen, steps)
    said = rows.select("_row", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = where.join(said, F.col("node") == F.col("_row"))
    head = F.concat(F.lit("### "), escaped(F.col("role"), ":"), F.lit(": "))
    turns = turns.select("tree", "path", "position", F.floor(F.col("position") / TURNS).alias("segment"), "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    w = Window.partitionBy("tree", "path", "segment").orderBy("position")
    at = F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role") == LEARNT, F.struct((at + F.length("head")).cast("int").alias("start"), F.length("body").alias("chars")))
    parts = turns.withColumn("span", span).groupBy("tree", "path", "segment").agg(F.sort_array(F.collect_list(F.struct("position", "piece", "span"))).alias("x"))
    loss = F.filter(F.col("x.span"), lambda s: s.isNotNull())
    return cut(parts.select("tree", "path", "segment", F.array_join(F.col("x.piece"), "").alias("formatted"), loss.alias("loss")))


TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_BACKSLASH = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _BACKSLASH.sub(r"\1", text)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation or segment."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Digest:
    """What is reported of one conversation, fed segment by segment."""

    def __init__(self):
        self.turns, self.learnt, self.n, self.loss, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def feed(self, text: str, spans: list[dict]) -> None:
        for role, said in parsed(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        for s in spans:
            part = unescape(text[s["start"] : s["start"] + s["chars"]])
            self.learnt.update(part.encode())
            self.loss += len(part)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


REPORT = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def read_back(stored: DataFrame) -> DataFrame:
    """Of each stored conversation, tree, path and REPORT, all taken from its formatted text and loss mask.

    Digests are sequential: one task reads a conversation, segment by segment, and holds a batch of it.
    """
    kinds = [StringType() if c.endswith("sha256") else LongType() for c in REPORT]
    schema = StructType([stored.schema["tree"], StructField("path", IntegerType()), *[StructField(c, k) for c, k in zip(REPORT, kinds, strict=True)]])
    arrow = [pa.int32(), *[pa.string() if c.endswith("sha256") else pa.int64() for c in REPORT]]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind = None, None, None
        for batch in batches:
            kind, ended = batch.schema.field(0).type, []
            columns = [batch.column(c) for c in ("tree", "path", "formatted", "loss")]
            for row in zip(*[(v.as_py() for v in c) for c in columns], strict=True):
                if state is None or row[:2] != key:
                    if state is not None:
                        ended.append((*key, *state.row()))
                    key, state = row[:2], _Digest()
                state.feed(*row[2:])
            yield _table(ended, [kind, *arrow])
        if state is not None:
            yield _table([(*key, *state.row())], [kind, *arrow])

    def _table(rows: list[tuple], types: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["tree", "path", *REPORT])

    rows = stored.select("tree", "path", "segment", "formatted", "loss")
    return rows.repartition("tree", "path").sortWithinPartitions("tree", "path", "segment").mapInArrow(report, schema)
