"""Conversation structure repair by a persistent audit DP.

A conversation is put right by the cheapest edits after which its role initials
read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3,
required for blank and duplicate rows), Insert a user or assistant row without
text (2); a truncated row that is not deleted adds 1.  The edits' initials are
its audit; of equally cheap audits the ASCII-least is taken.

The DP walks the rows with four states (nothing yet, a system row, the last
row's role).  Audits are nodes of a shared tree: an edit is a new node on the
prefix it continues, with ancestors at powers of two and a rolling hash.  A tie
searches the longest common prefix from the ancestors' hashes and compares the
first characters after it; equal hashes are verified character by character
down to a node that both share.  Equally cheap prefixes of the same rows are
never prefixes of each other (the longer would hold further, paid inserts), so
the least prefix stays least whatever follows.

Rows are ordered by (conversation, turn, role, text) with one range shuffle, so
a conversation of a third of all rows is spread over many tasks.  A task
finishes the conversations that lie inside its range; a conversation that may
cross into another range, or is longer than a segment, is summed up by segment:
the cheapest audit from every state to every state.  The segments of such a
conversation are chained, and its text is hashed, by one streaming pass each,
which holds the audit and one batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.lines import WHITE
from govlake.session import drop_scratch, materialize

#: Rows and characters of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 4 << 20
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, TRUNCATION = 2, 3, 2, 1

# states: nothing yet, a system row, a user row, an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a user or assistant row is put in; the row's role follows from it.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_MOD, _BASE = (1 << 61) - 1, 0x1F2E3D4C5B6A79


class Audits:
    """Edit prefixes as linked nodes; node 0 is the empty audit."""

    def __init__(self) -> None:
        self.char, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]       # ancestors 1, 2, 4, ... edits back
        self.equal: set[tuple[int, int]] = set()    # pairs verified as equal

    def append(self, node: int, char: str) -> int:
        up, level = [node], 0
        while level < len(self.up[up[level]]):
            up.append(self.up[up[level]][level])
            level += 1
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(char)) % _MOD)
        self.up.append(tuple(up))
        return len(self.char) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            step = (self.depth[node] - depth).bit_length() - 1
            node = self.up[node][step]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth and hash hold the same audit."""
        x, y = a, b
        while x != y and (x, y) not in self.equal:
            if self.char[x] != self.char[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        self.equal.add((a, b))
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` comes before ``b`` in ASCII order."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, depth), self._lift(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for level in range(len(self.up[x]) - 1, -1, -1):
            if level < len(self.up[x]):
                p, q = self.up[x][level], self.up[y][level]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if not self._same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.char[x] < self.char[y]


def _offer(audits: Audits, best: list, state: int, cost: int, node: int, char: str) -> None:
    old = best[state]
    if old is not None and old[0] < cost:
        return
    new = audits.append(node, char)
    if old is None or cost < old[0] or audits.less(new, old[1]):
        best[state] = (cost, new)


def _inserts(audits: Audits, best: list) -> None:
    # two rows can be of use in one place: a user row and its answer
    for _ in range(2):
        for state in range(4):
            if best[state] is not None:
                cost, node = best[state]
                _offer(audits, best, _NEXT[state], cost + INSERT, node, "I")


def cheapest(rows: list[tuple[str, int]], start: int) -> list[tuple[int, str] | None]:
    """(cost, audit) of the cheapest edits from state ``start`` to each state
    over ``rows`` of (role, fault)."""
    audits = Audits()
    best: list = [None] * 4
    best[start] = (0, 0)
    _inserts(audits, best)
    for role, fault in rows:
        new: list = [None] * 4
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _offer(audits, new, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            extra = TRUNCATION if fault == TRUNCATED else 0
            kept = _KEEP.get((state, role[:1]))
            if kept is not None:
                _offer(audits, new, kept, cost + extra, node, "K")
            _offer(audits, new, _NEXT[state], cost + REROLE + extra, node, "R")
        _inserts(audits, new)
        best = new
    return [None if b is None else (b[0], audits.text(b[1])) for b in best]


def repaired(audit: str, start: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that stands after the edits of ``audit``
    are done to ``rows`` of (role, text) from state ``start``."""
    state = start
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _KEEP[state, role[:1]]
        else:
            state = _NEXT[state]
            role = _ROLE[state]
        yield edit, role, text


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


# ---- rows ------------------------------------------------------------------

def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the rows after a repeatable damage by
    crc32 of ``conv:turn`` modulo 20 (nulls: one space): 0 drops the row, 1
    empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 sets role user."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)), "UTF-8")) % 20
    d = conversations.select(kind.alias("kind"), F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                             spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    return d.filter("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _with_faults(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct rows with copies and ``fault`` (of the first copy), and the
    tables they are read from."""
    distinct = materialize(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = distinct.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("said"), order.alias("at"))
    first = said.groupBy("conv", "role", "said").agg(F.min("at").alias("first"))
    a, b = said.alias("a"), first.alias("b")
    later = materialize(
        a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role"))
               & (F.col("a.said") == F.col("b.said")) & (F.col("a.at") != F.col("b.first")))
        .select("a.conv", "a.turn", "a.role", "a.said"), "repeats")
    a, b = distinct.alias("a"), later.alias("b")
    repeat = (F.col("a.conv").eqNullSafe(F.col("b.conv")) & F.col("a.turn").eqNullSafe(F.col("b.turn"))
              & (F.col("a.role") == F.col("b.role")) & (F.unhex(F.sha2("a.text", 256)) == F.col("b.said")))
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (F.when(F.length(body) == 0, BLANK).when(F.col("repeat"), DUPLICATE)
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    out = a.join(b, repeat, "left").select("a.conv", "a.turn", "a.role", "a.text", "a.copies",
                                           F.col("b.said").isNotNull().alias("repeat"))
    return out.withColumn("fault", fault.cast("int")).drop("repeat"), [distinct, later]


def _counted(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated)."""
    blank, n = F.col("fault") == BLANK, F.col("copies")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1
    return rows.groupBy("conv").agg(
        F.coalesce(span - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(F.when(blank, n).otherwise(0)).cast("bigint").alias("blank"),
        F.sum(F.when(blank, 0).when(F.col("fault") == DUPLICATE, n).otherwise(n - 1)).cast("bigint").alias("duplicate"),
        F.sum(F.when(F.col("fault") == TRUNCATED, 1).otherwise(0)).cast("bigint").alias("truncated"))


# ---- passes ----------------------------------------------------------------

class _Digest:
    """sha256 of ``role:text`` lines joined by newlines."""

    def __init__(self) -> None:
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        if self.begun:
            self.sha.update(b"\n")
        self.begun = True
        self.sha.update(f"{role}:{text}".encode())


def _pieces(rows: DataFrame) -> DataFrame:
    """One row per conversation that is finished in its range (``whole``), one
    per segment of the others (with the rows, and (cost, audit) from each state
    to each state at 4 * from + to)."""
    kind = rows.schema["conv"].dataType
    schema = (f"conv {kind.simpleString()}, part int, seg int, whole boolean, illegal bigint, first string, "
              "last string, costs array<bigint>, audits array<string>, digest string, "
              "roles array<string>, texts array<string>")
    names = [c.split()[0] for c in schema.split(", ")]
    ordered = (rows.repartitionByRange("conv", "turn", "role", "text")
               .sortWithinPartitions("conv", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[str, str, int]] = []       # role, text, fault
        conv, seg, chars, inside = None, 0, 0, False
        types: list[pa.DataType] = []

        def emit(whole: bool) -> pa.RecordBatch:
            initials = [r[:1] for r, _, _ in held]
            faults = [(r, f) for r, _, f in held]
            starts = [cheapest(faults, s) for s in ([START] if whole else range(4))]
            digest = None
            if whole:
                cost, audit = min(b for b in (starts[0][START], starts[0][ASSISTANT]) if b is not None)
                costs, audits, sha = [cost], [audit], _Digest()
                for _, role, text in repaired(audit, START, ((r, t) for r, t, _ in held)):
                    sha.add(role, text)
                digest = sha.sha.hexdigest()
            else:
                flat = [b or (None, None) for s in starts for b in s]
                costs, audits = [c for c, _ in flat], [t for _, t in flat]
            row = [conv, part, seg, whole, _illegal(initials), initials[0], initials[-1], costs, audits, digest,
                   None if whole else [r for r, _, _ in held], None if whole else [t for _, t, _ in held]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            if not types:
                types = [b.schema.field("conv").type, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(),
                         pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(),
                         pa.list_(pa.string()), pa.list_(pa.string())]
            columns = (b.column(c).to_pylist() for c in ("conv", "role", "text", "copies", "fault"))
            for c, role, text, copies, fault in zip(*columns):
                if held and c != conv or seg and c != conv:
                    if held:
                        yield emit(inside and not seg)
                    held, seg, chars, inside = [], 0, 0, True
                conv = c
                for n in range(copies):
                    gone = fault in (BLANK, DUPLICATE) or n > 0
                    held.append((role, "" if gone else text, fault if fault == BLANK or not n else DUPLICATE))
                    chars += 0 if gone else len(text)
                    if len(held) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                        yield emit(False)
                        held, seg, chars = [], seg + 1, 0
        if held:
            yield emit(False)

    return ordered.select("conv", "role", "text", "copies", "fault").mapInArrow(run, schema)


def _earlier(a: tuple | None, b: tuple | None) -> bool:
    """Whether chain ``a`` of (chain before, piece, from state) reads before ``b``."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _chained(segments: DataFrame) -> DataFrame:
    """(conv, part, seg, start, piece) of every segment on the cheapest way,
    and a row with part -1 and cost, illegal and the whole audit per conversation."""
    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, seg int, start int, piece string, cost bigint, illegal bigint"
    cols = ["conv", "part", "seg", "illegal", "first", "last", "costs", "audits"]
    ordered = segments.select(*cols).repartition("conv").sortWithinPartitions("conv", "part", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, kind_of = None, False, None
        best: list = []
        keys: list[tuple[int, int]] = []
        illegal, last = 0, None

        def close() -> pa.RecordBatch:
            a, b = best[START], best[ASSISTANT]
            end = a if b is None or a is not None and (a[0] < b[0] or a[0] == b[0] and _earlier(a[1], b[1])) else b
            chain, way = end[1], []
            while chain is not None:
                way.append((chain[2], chain[1]))
                chain = chain[0]
            way.reverse()
            rows = [(p, s, start, piece, None, None) for (p, s), (start, piece) in zip(keys, way)]
            rows.append((-1, -1, START, "".join(piece for _, piece in way), end[0], illegal))
            part, seg, start, piece, cost, bad = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(rows), kind_of), pa.array(part, pa.int32()), pa.array(seg, pa.int32()),
                 pa.array(start, pa.int32()), pa.array(piece, pa.string()), pa.array(cost, pa.int64()),
                 pa.array(bad, pa.int64())], names=["conv", "part", "seg", "start", "piece", "cost", "illegal"])

        for b in batches:
            kind_of = b.schema.field("conv").type
            for c, part, seg, bad, head, tail, costs, audits in zip(*(b.column(n).to_pylist() for n in cols)):
                if not begun or c != conv:
                    if begun:
                        yield close()
                    conv, begun, best, keys, illegal, last = c, True, [(0, None), None, None, None], [], 0, None
                new: list = [None] * 4
                for start, held in enumerate(best):
                    for end in range(4):
                        cost = costs[4 * start + end]
                        if held is None or cost is None:
                            continue
                        offer = (held[0] + cost, (held[1], audits[4 * start + end], start))
                        old = new[end]
                        if old is None or offer[0] < old[0] or offer[0] == old[0] and _earlier(offer[1], old[1]):
                            new[end] = offer
                best = new
                keys.append((part, seg))
                illegal += bad + (last is not None and last + head not in _LEGAL)
                last = tail
        if begun:
            yield close()

    return ordered.mapInArrow(run, schema)


def _hashed(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv, digest) of conversations of several segments, their rows streamed in order."""
    kind = segments.schema["conv"].dataType.simpleString()
    a, b = segments.alias("a"), ways.alias("b")
    ordered = (a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.part") == F.col("b.part"))
                      & (F.col("a.seg") == F.col("b.seg")))
               .select("a.conv", "a.part", "a.seg", "a.roles", "a.texts", "b.start", "b.piece")
               .repartition("conv").sortWithinPartitions("conv", "part", "seg"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind_of = None, None, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind_of), pa.array([sha.sha.hexdigest()])],
                                              names=["conv", "digest"])

        for b in batches:
            kind_of = b.schema.field("conv").type
            for i in range(b.num_rows):
                c, start, piece = (b.column(n)[i].as_py() for n in ("conv", "start", "piece"))
                if sha is None or c != conv:
                    if sha is not None:
                        yield close()
                    conv, sha = c, _Digest()
                rows = zip(b.column("roles")[i].as_py(), b.column("texts")[i].as_py())
                for _, role, text in repaired(piece, start, rows):
                    sha.add(role, text)
        if sha is not None:
            yield close()

    return ordered.mapInArrow(run, f"conv {kind}, digest string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies)
    and of ``conversations`` (conv): conv, gaps, blank, duplicate, truncated,
    illegal, cost (long), audit, repaired_sha256.

    Rows are taken by turn, nulls first; ties by role, then text.  A row's
    first fault counts: blank (nothing but white space), duplicate (same role
    and text earlier), truncated (the last visible character is none of
    ``.!?``).  gaps counts turns missing between the least and the greatest;
    illegal counts neighbours whose role initials are none of su, ua, au.  A
    role's initial is its first character; an empty role has none and cannot be
    kept.  Roles and texts must not be null; a null conversation is one of its
    own; a conversation without rows has zeros, an empty audit and the hash of
    the empty string; ``copies`` of a row stand next to each other.
    """
    faulty, tables = _with_faults(rows)
    counts = materialize(_counted(faulty), "counts")
    pieces = materialize(_pieces(faulty), "pieces")
    for t in tables:
        drop_scratch(t)
    segments = pieces.filter("not whole")
    ways = materialize(_chained(segments), "ways")
    done = pieces.filter("whole").select("conv", "illegal", F.get("costs", F.lit(0)).alias("cost"),
                                         F.get("audits", F.lit(0)).alias("audit"), "digest")
    joined = ways.filter("part = -1").select("conv", "illegal", "cost", F.col("piece").alias("audit"))
    parts = [counts, done, joined, _hashed(segments, ways.filter("part >= 0"))]
    if conversations is not None:
        parts.append(conversations.select("conv").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.groupBy("conv").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in longs),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("digest"), F.sha2(F.encode(F.lit(""), "UTF-8"), 256)).alias("repaired_sha256"))
