"""Cheapest repair of conversations whose turns got lost, emptied, repeated or mixed up.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. Each row may be kept (K, free), given the role user or assistant (R, 1) or deleted (D, 2); turns
without text may be inserted anywhere (I, 5). A blank row, or one whose role and text were there before, must go; a
truncated row costs 5 unless it goes. Of the cheapest edits those are chosen whose letters in order (the audit) sort
first.

Method: one pass over the rows with four states (nothing yet, system, user, assistant came last). Every state holds the
best edits so far as the end of a chain of linked nodes, so states share their prefixes. Equal costs are decided by the
first letter in which two chains differ: nodes keep a rolling hash of their chain and links to the ancestors 1, 2, 4, ...
steps back, which finds the longest common prefix in logarithmic time; nodes that only agree by hash are then compared
letter by letter. States that can't win any more are dropped, and once the other chains share an ancestor, all before it is
final: it is passed on and forgotten, so memory follows the undecided end of a conversation, not its length.

A conversation is a sequence by definition: its rows go through one task in order, as a sorted stream that Spark
spills, never as a group held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\f\r"
ENDS = ".!?"
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"

# what came last -> where a turn of this initial leads
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

_BASE, _MOD = 1_000_003, (1 << 61) - 1
_SETTLE = 64
_BATCH_ROWS, _BATCH_CHARS = 4096, 4 << 20


class Node:
    """The last of a chain of edits."""

    __slots__ = ("edit", "depth", "hash", "up", "row", "role")

    def __init__(self, parent: Node | None = None, edit: str = "", row: tuple | None = None, role: str | None = None):
        self.edit, self.row, self.role = edit, row, role
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(edit)) % _MOD
        # ancestors 1, 2, 4, ... steps back
        self.up = [parent]
        while len(self.up[-1].up) >= len(self.up):
            self.up.append(self.up[-1].up[len(self.up) - 1])

    def back(self, steps: int) -> Node:
        node, i = self, 0
        while steps:
            if steps & 1:
                node = node.up[i]
            steps >>= 1
            i += 1
        return node


def _same(x: Node, y: Node) -> bool:
    """Whether two chains of one length hold the same letters; a hash alone is not believed."""
    if x.hash != y.hash:
        return False
    while x is not y:
        if x.edit != y.edit:
            return False
        if not x.up:
            break
        x, y = x.up[0], y.up[0]
    return True


def sorts_before(a: Node, b: Node) -> bool:
    """Whether the letters of chain ``a`` sort before those of ``b``; both start at one root."""
    shorter = min(a.depth, b.depth)
    x, y = a.back(a.depth - shorter), b.back(b.depth - shorter)
    if _same(x, y):
        return a.depth < b.depth
    for i in reversed(range(len(x.up))):
        if i < len(x.up) and not _same(x.up[i], y.up[i]):
            x, y = x.up[i], y.up[i]
    return x.edit < y.edit


def _common(nodes: list[Node]) -> Node:
    """The last node that all chains share."""
    least = min(n.depth for n in nodes)
    nodes = [n.back(n.depth - least) for n in nodes]
    while any(n is not nodes[0] for n in nodes):
        if all(n.up[0] is nodes[0].up[0] for n in nodes):
            return nodes[0].up[0]
        # the highest step at which some still differ; at most one step too short, which the loop mends
        step = 0
        for i in reversed(range(min(len(n.up) for n in nodes))):
            if any(n.up[i] is not nodes[0].up[i] for n in nodes):
                step = i
                break
        nodes = [n.up[step] for n in nodes]
    return nodes[0]


class Repair:
    """The four states of one conversation. ``add`` takes its rows in order and returns the edits that became final,
    ``finish`` the rest, each as (edit, role afterwards, row or None)."""

    def __init__(self):
        self.root = Node()
        # state -> (cost, chain)
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.settle_at = _SETTLE

    def _offer(self, found: dict, state: int, cost: int, parent: Node, edit: str, row=None, role=None) -> None:
        if state in found and found[state][0] < cost:
            return
        node = Node(parent, edit, row, role)
        if state not in found or found[state][0] > cost or sorts_before(node, found[state][1]):
            found[state] = (cost, node)

    def _insert(self) -> None:
        """Lets every state insert turns. Two in a row are enough: more lead back where they began."""
        before = dict(self.best)
        for state, (cost, node) in before.items():
            if state in NEXT["u"]:
                self._offer(self.best, USER, cost + INSERT, node, "I", role=ROLES["u"])
        if USER in self.best:
            cost, node = self.best[USER]
            self._offer(self.best, ASSISTANT, cost + INSERT, node, "I", role=ROLES["a"])
        # whatever follows can follow an assistant's turn too, at most without a system row; dearer states can't win
        reached = self.best[ASSISTANT][0]
        for state, room in ((START, DELETE), (SYSTEM, 0)):
            if state in self.best and self.best[state][0] > reached + room:
                del self.best[state]

    def add(self, role: str, fault: str, row: tuple) -> list[tuple]:
        self._insert()
        found: dict[int, tuple[int, Node]] = {}
        extra = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in self.best.items():
            self._offer(found, state, cost + DELETE, node, "D", row, role)
            if fault in (BLANK, DUPLICATE):
                continue
            to = NEXT.get(role[:1], {}).get(state)
            if to is not None:
                self._offer(found, to, cost + extra, node, "K", row, role)
            for initial, name in ROLES.items():
                to = NEXT[initial].get(state)
                if to is not None:
                    self._offer(found, to, cost + RETAG + extra, node, "R", row, name)
        self.best = found
        if max(node.depth for _, node in found.values()) - self.root.depth < self.settle_at:
            return []
        return self._settle(_common([node for _, node in found.values()]))

    def _settle(self, to: Node) -> list[tuple]:
        final = []
        node = to
        while node is not self.root:
            final.append((node.edit, node.role, node.row))
            node = node.up[0]
        # links beyond the new root are cut, or they would keep the whole past alive
        undecided, tips = set(), [n for _, n in self.best.values()]
        for tip in tips:
            while tip is not to and tip not in undecided:
                undecided.add(tip)
                tip = tip.up[0]
        for n in undecided:
            n.up = [u for u in n.up if u.depth >= to.depth]
        to.up, to.row = [], None
        self.root = to
        self.settle_at = max(_SETTLE, 2 * max(n.depth - to.depth for n in tips))
        return final[::-1]

    def finish(self) -> tuple[list[tuple], int]:
        self._insert()
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost = min(c for c, _ in ends)
        chosen = None
        for c, node in ends:
            if c == cost and (chosen is None or sorts_before(node, chosen)):
                chosen = node
        return self._settle_all(chosen), cost

    def _settle_all(self, chosen: Node) -> list[tuple]:
        self.best = {START: (0, chosen)}
        return self._settle(chosen)


def _fault(text: str, repeated: bool) -> str | None:
    body = text.rstrip(SPACES)
    if not body:
        return BLANK
    if repeated:
        return DUPLICATE
    return None if body[-1] in ENDS else CUT


def _edits_of(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        current, repair, position = None, None, 0

        def take(edits: list[tuple]) -> None:
            nonlocal position, chars
            for edit, role, row in edits:
                turn, before, text, fault = row if row else (None, None, "", None)
                cost = {"K": 0, "R": RETAG, "D": DELETE, "I": INSERT}[edit]
                cost += TRUNCATED if fault == CUT and edit != "D" else 0
                out.append((current[0], position, edit, fault, cost, turn, before, role, text))
                position += 1
                chars += len(text)

        def flush() -> pa.RecordBatch:
            nonlocal chars
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            chars = 0
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for conv, turn, role, text, repeated in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current is None or conv != current[0]:
                    if repair:
                        take(repair.finish()[0])
                    current, repair, position = (conv,), Repair(), 0
                fault = _fault(text, repeated)
                take(repair.add(role, fault, (turn, role, text, fault)))
                if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    yield flush()
        if repair:
            take(repair.finish()[0])
        if out:
            yield flush()

    return run


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The edits that repair each conversation, in order of ``position`` from 0: conv_id, position, edit (K, R, D, I),
    fault (blank, duplicate, truncated or null), cost, turn, role_before, role, text.

    Inserted turns have no turn and no role_before; deleted rows show what was there. ``repaired`` leaves them out.
    Rows are taken by turn, nulls first; rows of one turn by role and text, so repeated rows are neighbours. A null role
    or text counts as one space. A null id is a conversation of its own. Rows with a role that begins with none of s, u
    and a can't be kept. An empty table gives no rows; a conversation's rows follow each other in one partition.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    ordered = (
        rows.withColumn("repeated", F.row_number().over(alike) > 1)
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "repeated"))
    out = T.StructType([
        T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("position", T.LongType()),
        T.StructField("edit", T.StringType()), T.StructField("fault", T.StringType()),
        T.StructField("cost", T.LongType()), T.StructField("turn", rows.schema["turn"].dataType),
        T.StructField("role_before", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType())])
    return ordered.mapInArrow(_edits_of(_arrow(out)), out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repaired(edits: DataFrame) -> DataFrame:
    """The sound conversations: conv_id, position, role, text."""
    return edits.filter("edit <> 'D'").select("conv_id", "position", "role", "text")


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, " \
          "repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: what was wrong, what the repair cost, its audit and a hash of the result. Takes the
    rows of ``repair`` as they come, conversation after conversation, so nothing is shuffled again."""
    schema = T.StructType([edits.schema["conv_id"], *T.StructType.fromDDL(_REPORT).fields])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        digest: _Digest | None = None
        for batch in batches:
            for conv, edit, fault, cost, turn, before, role, text in zip(
                    *[batch.column(n).to_pylist() for n in (
                        "conv_id", "edit", "fault", "cost", "turn", "role_before", "role", "text")], strict=True):
                if digest is None or digest.conv != conv:
                    if digest:
                        done.append(digest.row())
                    digest = _Digest(conv)
                digest.add(edit, fault, cost, turn, before, role, text)
                if len(done) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in done], arrow)
                    done.clear()
        if digest:
            done.append(digest.row())
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in done], arrow)

    return edits.mapInArrow(run, schema)


class _Digest:
    def __init__(self, conv):
        self.conv = conv
        self.first = self.last = None
        self.turns = self.cost = self.illegal = 0
        self.faults = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.audit: list[str] = []
        self.before = None
        self.sha = hashlib.sha256()
        self.lines = 0

    def add(self, edit, fault, cost, turn, before, role, text) -> None:
        self.audit.append(edit)
        self.cost += cost
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if self.before is not None and self.before + before[:1] not in LEGAL:
                self.illegal += 1
            self.before = before[:1]
            # rows come by turn, so equal turns are neighbours
            if turn is not None and turn != self.last:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.last = turn
        if edit != "D":
            self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit),
                self.sha.hexdigest())


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Conversations with known faults, to try a repair on: crc32 of ``conv_id:turn`` modulo 20 drops a row (0), empties
    its text (1), removes its sentence ends (2), repeats it (3) or makes it the user's (4). Nulls count as one space."""
    space = F.lit(" ")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.encode(F.concat(shown(id_col), F.lit(":"), shown(turn_col)), "utf-8")) % 20
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return changed.drop("copy")


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The report of every conversation of ``ids``; those without a row have nothing wrong and nothing to hash."""
    found = report(repair(turns)).withColumnRenamed("conv_id", "__id")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    wanted = ids.select("conv_id").distinct()
    names = T.StructType.fromDDL(_REPORT).names
    return wanted.join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left").select(
        "conv_id", *[F.coalesce(F.col(n), empty.get(n, F.lit(0).cast("long"))).alias(n) for n in names])
