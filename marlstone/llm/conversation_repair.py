"""Conversation structure repair: the cheapest edits that make a conversation's role initials fit `(s?(ua)+)?`.

Edits are Keep (cost 0), Rerole to user or assistant (3), Delete (4; the only edit of a blank or duplicate row) and Insert of an
empty-text user or assistant turn (3); a truncated row that is not deleted adds 3.  repair() runs Dijkstra on the implicit lattice of
(turn index, grammar state) with the key (cost, audit), audit being the initials of the edits so far, and stops at the first popped
end node that accepts.  Nodes are made when an edge reaches them; their audits form a trie, since in every state each edit has one
successor, so two audits are compared at their lowest common ancestor by jump pointers, in logarithmic time and without strings.

A conversation is a sequence, so its rows pass through one task in order.  The first pass carries a code and a 16-byte digest of each
row, no texts; the second reads the audit ahead of the rows and holds one row at a time.  A task so holds, for its largest conversation,
some 30 bytes for each lattice node and 16 for each distinct row, but never its texts.

Defined results: null role or text is one space; null conv_id is a conversation of its own; null turns come first and count in no gap;
rows of one turn go by role and digest of the text, copies adjacent; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, GONE, CUT = range(3)  # a row's fault: none, to be deleted (blank or duplicate), truncated
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
_FREE = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)  # where a user or assistant turn leads from each state
_NAMES = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
BATCH_ROWS = 1000


def _kept(state: int, letter: int) -> int | None:
    """The state after a row is kept, or None where the grammar has no such edge."""
    if letter == SYSTEM:
        return AFTER_SYSTEM if state == START else None
    if letter == OTHER or (letter == ASSISTANT) != (state == AFTER_USER):
        return None
    return _FREE[state]


class _Audits:
    """The audits of all nodes made so far, as a trie with jump pointers."""

    def __init__(self):
        self.parent, self.jump, self.depth, self.edit = array("i", [0]), array("i", [0]), array("i", [0]), bytearray(1)

    def add(self, parent: int, edit: int) -> int:
        jump, depth = self.jump, self.depth
        j = jump[parent]
        jump.append(jump[j] if depth[parent] - depth[j] == depth[j] - depth[jump[j]] else parent)
        self.parent.append(parent)
        depth.append(depth[parent] + 1)
        self.edit.append(edit)
        return len(self.edit) - 1

    def _lift(self, x: int, depth: int) -> int:
        while self.depth[x] > depth:
            x = self.jump[x] if self.depth[self.jump[x]] >= depth else self.parent[x]
        return x

    def before(self, a: int, b: int) -> bool:
        """Whether the audit of a comes before that of b in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, depth), self._lift(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.parent[x], self.parent[y])
        return self.edit[x] < self.edit[y]

    def text(self, x: int) -> str:
        out = bytearray()
        while x:
            out.append(self.edit[x])
            x = self.parent[x]
        return out[::-1].decode()


class _Entry:
    """A reached lattice node in the queue, ordered by (cost, audit)."""

    __slots__ = ("cost", "audit", "at", "state", "audits")

    def __init__(self, cost: int, audit: int, at: int, state: int, audits: _Audits):
        self.cost, self.audit, self.at, self.state, self.audits = cost, audit, at, state, audits

    def __lt__(self, other: _Entry) -> bool:
        return self.cost < other.cost if self.cost != other.cost else self.audits.before(self.audit, other.audit)


def repair(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair.  rows: 3 * letter + fault for each row, in order."""
    n, audits = len(rows), _Audits()
    queue, settled = [_Entry(0, 0, 0, START, audits)], bytearray(4 * (n + 1))
    while True:
        e = heapq.heappop(queue)
        at, state = e.at, e.state
        if settled[4 * at + state]:
            continue
        settled[4 * at + state] = 1
        if at == n and state in (START, AFTER_ASSISTANT):
            return e.cost, audits.text(e.audit)

        def reach(cost, edit, to, after, e=e):
            if not settled[4 * to + after]:
                heapq.heappush(queue, _Entry(e.cost + cost, audits.add(e.audit, edit), to, after, audits))

        reach(INSERT, 73, at, _FREE[state])  # I
        if at < n:
            letter, fault = divmod(rows[at], 3)
            reach(DELETE, 68, at + 1, state)  # D
            if fault != GONE:
                extra = TRUNCATED if fault == CUT else 0
                after = _kept(state, letter)
                if after is not None:
                    reach(KEEP + extra, 75, at + 1, after)  # K
                reach(REROLE + extra, 82, at + 1, _FREE[state])  # R


class Editor:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> list[tuple[str, str, str]]:
        """The turns inserted at this place: (edit, role, text)."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _FREE[self.state]
            out.append(("I", _NAMES[self.state], ""))
        return out

    def edited(self, role: str, text: str) -> list[tuple[str, str, str]]:
        """What is inserted before a row, and the row itself, unless it is deleted."""
        out = self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return out
        self.state = _FREE[self.state] if edit == "R" else _kept(self.state, letter_of(role))
        return [*out, (edit, _NAMES[self.state] if edit == "R" else role, text)]


def letter_of(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


# ---- over tables -----------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(`conv_id:turn`) % 20: 0 marks the row as dropped, 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 sets role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("damage") == 0).alias("dropped"), "damage")
    return hurt.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("damage", "copy")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped and digest: with nulls as one space."""
    dropped = F.col("dropped") if "dropped" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(dropped, F.lit(False)).alias("dropped"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


_ORDER = ["conv_id", "turn", "role", "digest"]  # nulls first
_FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _key(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


class _Survey:
    """Faults, codes and gaps of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.codes, self.seen = conv, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = None
        self.letter = None

    def add(self, turn, letter, blank, cut, digest):
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        fault = FINE
        if blank:
            self.blank, fault = self.blank + 1, GONE
        elif digest in self.seen:
            self.duplicate, fault = self.duplicate + 1, GONE
        elif cut:
            self.truncated, fault = self.truncated + 1, CUT
        self.seen.add(digest)
        if self.letter is not None and (self.letter, letter) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.letter = letter
        self.codes.append(3 * letter + fault)

    def result(self) -> tuple:
        cost, audit = repair(bytes(self.codes))
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def repair_plans(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, the four counts of faults, cost and audit.

    Takes conv_id, turn, role, text, and dropped where rows are there only to name their conversation.
    """
    first = F.substring("role", 1, 1)
    letter = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = _turns(conversations).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "digest", letter.cast("int").alias("letter"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), "dropped")
    ordered = rows.repartition("conv_id").sortWithinPartitions(*_ORDER).drop("role")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        names, kinds, now, done = ["conv_id", *_FAULTS, "audit"], [first.schema.field(0).type, *[pa.int64()] * len(_FAULTS), pa.string()], None, []
        for b in itertools.chain([first], batches):
            for conv, turn, digest, letter, blank, cut, dropped in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                    now = _Survey(conv)
                if not dropped:
                    now.add(turn, letter, blank, cut, digest)
            if len(done) > BATCH_ROWS:
                yield _batch(done, names, kinds)
                done = []
        if now is not None:
            yield _batch([*done, now.result()], names, kinds)

    return ordered.mapInArrow(run, f"conv_id {_key(conversations)}, {', '.join(f'{c} long' for c in _FAULTS)}, audit string")


def _ordered(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """All rows in order, each conversation's plan ahead of them as step 0, its text the counts and the audit."""
    rows = _turns(conversations).where(~F.col("dropped")).select("conv_id", F.lit(1).alias("step"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text")
    heads = plans.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.concat_ws(",", *_FAULTS, "audit").alias("text"))
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "step", *_ORDER[1:]).drop("digest")


BEGIN, ROW, END = range(3)


def _events(first: pa.RecordBatch, rest):
    """(BEGIN, conv_id, plan), (ROW, turn, edits) and (END, None, edits) of the conversations that come by."""
    editor = None
    for b in itertools.chain([first], rest):
        for conv, step, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if step:
                yield ROW, turn, editor.edited(role, text)
                continue
            if editor is not None:
                yield END, None, editor.inserted()
            editor = Editor(text.rpartition(",")[2])
            yield BEGIN, conv, text
    if editor is not None:
        yield END, None, editor.inserted()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repaired_turns(conversations: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), turn (null where inserted), edit (K, R or I), role, text."""
    names = ["conv_id", "position", "turn", "edit", "role", "text"]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds, out, conv, at = [first.schema.field(0).type, pa.int64(), pa.int64(), *[pa.string()] * 3], [], None, 0
        for event, what, edits in _events(first, batches):
            if event == BEGIN:
                conv, at = what, 0
                continue
            for edit, role, text in edits:
                out.append((conv, at, None if edit == "I" else what, edit, role, text))
                at += 1
            if len(out) > BATCH_ROWS:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return _ordered(conversations, plans or repair_plans(conversations)).mapInArrow(run, f"conv_id {_key(conversations)}, position long, turn long, edit string, role string, text string")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """repair_plans() with repaired_sha256: the repaired rows as `role:text`, joined by newlines, hashed as they come."""
    names = ["conv_id", *_FAULTS, "audit", "repaired_sha256"]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds, out, plan, digest, between = [first.schema.field(0).type, *[pa.int64()] * len(_FAULTS), pa.string(), pa.string()], [], None, None, ""
        for event, what, edits in _events(first, batches):
            if event == BEGIN:
                plan, digest, between = (what, edits.split(",")), hashlib.sha256(), ""
                continue
            for _, role, text in edits:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            if event == END:
                out.append((plan[0], *map(int, plan[1][:-1]), plan[1][-1], digest.hexdigest()))
                if len(out) > BATCH_ROWS:
                    yield _batch(out, names, kinds)
                    out = []
        if out:
            yield _batch(out, names, kinds)

    counts = ", ".join(f"{c} long" for c in _FAULTS)
    return _ordered(conversations, repair_plans(conversations)).mapInArrow(run, f"conv_id {_key(conversations)}, {counts}, audit string, repaired_sha256 string")
