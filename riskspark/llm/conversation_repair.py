"""Repair of the role structure of conversations by generalised LR parsing (operator 12).

The role grammar is  C -> (empty) | B | s B,  B -> u a | B u a  over role initials (s, u, a). All parses of a damaged
conversation are followed at once on a graph-structured stack: a row may be kept, given another role or deleted, and
turns without text may be inserted anywhere, each at a weight. Stacks share their tails, and equal stack tops merge by
the smallest (cost, audit); the audit is the string of edit initials. Equal costs never compare an audit with a prefix
of itself (an insert costs), so the smallest pair stays the smallest under every continuation and merging is exact.

Rows are laid out in order by a range partition over conversation and turn and packed into segments of bounded rows and
bytes. A conversation inside one segment is parsed where it lies. One that spans segments (at partition bounds, or
because it is long) is parsed from every stack top at once, segment by segment, in parallel; the small tables of
(top in, top out) results are then folded in order. No task holds more than a segment of texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import arrow_batch, pick, small_batches, stored

#: Weights of the edits; an undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT_ROWS, SEGMENT_BYTES = 1000, 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
_NAMES = {"u": "user", "a": "assistant"}

#: LR(0) tables of the grammar: shifts by state and role initial, reductions to B by state (symbols popped), goto on B
#: by state, states that accept at the end.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 4: {"u": 6}, 5: {"u": 6}, 6: {"a": 7}}
REDUCE = {3: 2, 7: 3}
GOTO = {0: 4, 1: 5}
ACCEPT = {0, 4, 5}


class Stacks:
    """The nodes of the graph-structured stack: (state, node below), each pair once, so tails are shared."""

    def __init__(self):
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self._number = {(0, -1): 0}
        self._moves: dict[tuple[int, str], int] = {}
        for node in self.nodes:  # grows while it is walked: every stack that the grammar can reach
            for symbol in "sua":
                self._moves[self._number[node], symbol] = self._move(self._number[node], symbol)

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self._number:
            self._number[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self._number[state, below]

    def _move(self, top: int, symbol: str) -> int:
        """The top after a shift and the reductions that follow, or -1."""
        state = SHIFT.get(self.nodes[top][0], {}).get(symbol)
        if state is None:
            return -1
        below = top
        while state in REDUCE:
            for _ in range(REDUCE[state] - 1):  # the shifted state itself was not pushed
                below = self.nodes[below][1]
            state = GOTO[self.nodes[below][0]]
        return self._node(state, below)

    def push(self, top: int, symbol: str) -> int:
        return self._moves.get((top, symbol), -1)

    def accepts(self, top: int) -> bool:
        return self.nodes[top][0] in ACCEPT


STACKS = Stacks()
TOPS = len(STACKS.nodes)
#: From a top only one of u and a can follow: the role of an inserted or reroled turn there.
NEXT = {top: symbol for top in range(TOPS) for symbol in "ua" if STACKS.push(top, symbol) >= 0}


def with_inserts(front: dict) -> dict:
    """Stack tops reached by inserts, merged by the smallest (cost, audit)."""
    todo = list(front)
    while todo:
        top = todo.pop()
        if top not in NEXT:
            continue
        cost, audit = front[top]
        reached, found = STACKS.push(top, NEXT[top]), (cost + INSERT, audit + "I")
        if reached not in front or found < front[reached]:
            front[reached] = found
            todo.append(reached)
    return front


def advance(front: dict, initial: str, fault: str) -> dict:
    """The front after one row: {stack top: (cost, audit)}."""
    new: dict = {}

    def offer(top: int, cost: int, audit: str) -> None:
        if top >= 0 and (top not in new or (cost, audit) < new[top]):
            new[top] = (cost, audit)

    extra = TRUNCATED if fault == "t" else 0
    for top, (cost, audit) in front.items():
        offer(top, cost + DELETE, audit + "D")
        if fault not in ("b", "d"):
            offer(STACKS.push(top, initial), cost + KEEP + extra, audit + "K")
            if top in NEXT:
                offer(STACKS.push(top, NEXT[top]), cost + REROLE + extra, audit + "R")
    return with_inserts(new)


def parse(rows: list[tuple[str, str]], top: int = 0) -> dict:
    """{stack top: smallest (cost, audit)} after rows of (role initial, fault), from one stack top."""
    front = with_inserts({top: (0, "")})
    for initial, fault in rows:
        front = advance(front, initial, fault)
    return front


def best(front: dict) -> tuple[int, str, int]:
    """The smallest (cost, audit, top) among the accepting tops."""
    return min((*found, top) for top, found in front.items() if STACKS.accepts(top))


def replay(audit: str, top: int, roles: list[str], texts: list[bytes]) -> list[tuple[str, bytes]]:
    """The repaired turns that an audit makes of rows, from a stack top on."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        symbol = roles[at][:1] if edit == "K" else NEXT[top]
        out.append((roles[at] if edit == "K" else _NAMES[symbol], b"" if edit == "I" else texts[at]))
        at += edit != "I"
        top = STACKS.push(top, symbol)
    return out


def faults(roles: list[str], texts: list[bytes], repeated: set[int]) -> str:
    """The first fault of each row: b(lank), d(uplicate), t(runcated) or ``-``; ``repeated`` are rows seen earlier."""
    out, seen = [], set()
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        body = text.rstrip(_SPACE)
        again = (role, text) in seen or i in repeated
        seen.add((role, text))
        out.append("b" if not body else "d" if again else "-" if body[-1:] in (b".", b"!", b"?") else "t")
    return "".join(out)


def _lines(turns: list[tuple[str, bytes]]) -> bytes:
    return b"\n".join(role.encode() + b":" + text for role, text in turns)


class Counts:
    """Gaps, faults and illegal neighbours of a conversation, added up segment after segment."""

    def __init__(self):
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.last = None
        self.faults = {"b": 0, "d": 0, "t": 0}

    def add(self, turns: list, initials: list[str], found: str) -> None:
        for t in turns:  # in order, nulls first
            if t is not None and t != self.high:
                self.turns, self.high = self.turns + 1, t
                self.low = t if self.low is None else self.low
        for k in initials:
            self.illegal += self.last is not None and self.last + k not in ("su", "ua", "au")
            self.last = k
        for k in self.faults:
            self.faults[k] += found.count(k)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SUMMARY = "conv long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
SEGMENT = "conv long, sid long, open boolean, turns array<long>, roles array<string>, texts array<binary>"


def _pack(batches):
    """Segments of the rows of a sorted partition; ``open`` ones may go on in another segment."""
    from pyspark import TaskContext
    part, n, size, out, out_size = TaskContext.get().partitionId(), 0, 0, [], 0
    conv, rows, is_open, begun = None, [], True, False

    def segment(open_: bool):
        nonlocal n, rows, size, out_size
        out.append((conv, (part << 32) | n, open_, *([r[k] for r in rows] for k in range(3))))
        out_size += size + 64
        n, rows, size = n + 1, [], 0

    for batch in batches:
        ids, turns, roles, texts, there = (batch.column(i).to_pylist() for i in range(5))
        for id_, turn, role, text, present in zip(ids, turns, roles, texts, there, strict=True):
            if not begun or id_ != conv:
                if begun:
                    segment(is_open)
                    is_open = False
                conv, begun = id_, True
            elif len(rows) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                is_open = True
                segment(True)
            if present:
                rows.append((turn, role, text))
                size += len(text) + 32
            if out_size >= SEGMENT_BYTES:
                yield arrow_batch(SEGMENT, out)
                out, out_size = [], 0
    if begun:
        segment(True)
    if out:
        yield arrow_batch(SEGMENT, out)


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """Rows in order of conversation and turn (nulls first; equal turns by role, then by digest of the text), packed.

    A null role or text is one space. ``present_col`` names a boolean column whose false rows only tell that their
    conversation exists.
    """
    names = dict(conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = pick(turns, **names, **({"present": present_col} if present_col else {}))
    if not present_col:
        rows = rows.withColumn("present", F.lit(True))
    rows = rows.select(
        F.col("conv").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).cast("binary").alias("text"), "present")
    # the row's place in the input parts equal rows, so any number of them is dealt over several partitions
    rows = rows.select("*", F.sha2("text", 256).alias("_d"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_d"]
    laid = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order).drop("_d", "_tie")
    return stored(laid.mapInArrow(_pack, SEGMENT), "segments")


def _columns(batch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def _parse_closed(batches):
    """Conversations inside one segment: counts, edits and the digest of the repaired turns."""
    for batch in batches:
        out = []
        for conv, turns, roles, texts in zip(*_columns(batch), strict=True):
            found = faults(roles, texts, set())
            initials = [r[:1] for r in roles]
            counts = Counts()
            counts.add(turns, initials, found)
            cost, audit, _ = best(parse(list(zip(initials, found, strict=True))))
            digest = hashlib.sha256(_lines(replay(audit, 0, roles, texts))).hexdigest()
            out.append((conv, *counts.row(), cost, audit, digest))
        yield arrow_batch(f"{SUMMARY}, repaired_sha256 string", out)


def _first_places(batches):
    """(digest of conversation, role and text; segment; place) of the rows that are new in their segment."""
    for batch in batches:
        out = []
        for conv, sid, roles, texts in zip(*_columns(batch), strict=True):
            seen = {}
            for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
                if text.strip(_SPACE):
                    seen.setdefault((role, text), i)
            out += [(hashlib.sha256(f"{conv}:{len(role)}:{role}:".encode() + text).digest()[:16], sid, i)
                    for (role, text), i in seen.items()]
        yield arrow_batch("digest binary, sid long, place int", out)


_TABLE = "conv long, sid long, turns array<long>, initials string, found string, cost array<long>, audit array<string>"


def _tables(batches):
    """For every pair of stack tops (in, out) of an open segment: the smallest (cost, audit), cost -1 if none."""
    for batch in batches:
        out = []
        for conv, sid, turns, roles, texts, again in zip(*_columns(batch), strict=True):
            found = faults(roles, texts, set(again or ()))
            initials = [r[:1] for r in roles]
            steps = list(zip(initials, found, strict=True))
            cells = [parse(steps, top).get(to, (-1, "")) for top in range(TOPS) for to in range(TOPS)]
            shown = "".join(k or "\0" for k in initials)
            out.append((conv, sid, turns, shown, found, [c for c, _ in cells], [a for _, a in cells]))
        yield arrow_batch(_TABLE, out)


PLAN = f"sid long, top int, {SUMMARY}"


class _Fold:
    """Folds the tables of one conversation's segments in order.

    Segments before the last point that all live parses share are decided and leave; only the rest is kept.
    """

    def __init__(self, conv):
        self.conv, self.counts, self.audit = conv, Counts(), []
        self.live = {0: (0, "")}  # audits since the last decided segment
        self.pending: list[tuple[int, dict]] = []

    def add(self, turns, initials, found, sid, cost, audit) -> list[tuple]:
        self.counts.add(turns, [k.replace("\0", "") for k in initials], found)
        new, back = {}, {}
        for top, (before, trail) in self.live.items():
            for to in range(TOPS):
                c, a = cost[top * TOPS + to], audit[top * TOPS + to]
                if c >= 0 and (to not in new or (before + c, trail + a) < new[to]):
                    new[to], back[to] = (before + c, trail + a), (top, a)
        self.live = new
        self.pending.append((sid, back))
        tops = set(new)
        for i in range(len(self.pending) - 1, -1, -1):
            tops = {self.pending[i][1][t][0] for t in tops}
            if len(tops) == 1 and i:
                gone = self._decide(tops.pop(), i)
                cut = sum(len(row[-1]) for row in gone)
                self.live = {t: (c, trail[cut:]) for t, (c, trail) in new.items()}
                return gone
        return []

    def _decide(self, top: int, n: int) -> list[tuple]:
        rows = []
        for sid, back in reversed(self.pending[:n]):
            top, piece = back[top]
            rows.append((sid, top, None, *[None] * len(_COUNTS), piece))
        rows.reverse()
        self.audit += [r[-1] for r in rows]
        self.pending = self.pending[n:]
        return rows

    def end(self) -> list[tuple]:
        cost, _, top = best(self.live)
        rows = self._decide(top, len(self.pending))
        return [*rows, (None, None, self.conv, *self.counts.row(), cost, "".join(self.audit))]


def _fold(batches):
    fold = None
    for batch in batches:
        out = []
        for conv, sid, turns, initials, found, cost, audit in zip(*_columns(batch), strict=True):
            if fold is None or fold.conv != conv:
                out += fold.end() if fold else []
                fold = _Fold(conv)
            out += fold.add(turns, initials, found, sid, cost, audit)
        yield arrow_batch(PLAN, out)
    if fold:
        yield arrow_batch(PLAN, fold.end())


def _plans(open_: DataFrame) -> DataFrame:
    """(sid, top, audit) of every open segment and, with a null sid, a summary of every open conversation."""
    places = open_.select("conv", "sid", "roles", "texts").mapInArrow(
        _first_places, "digest binary, sid long, place int")
    places = stored(places, "places")
    first = places.groupBy("digest").agg(F.min("sid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = (places.join(first, "digest").where("sid > first").groupBy("sid")
             .agg(F.collect_list("place").alias("again")))  # at most the rows of a segment
    tables = (open_.join(again, "sid", "left").select("conv", "sid", "turns", "roles", "texts", "again")
              .mapInArrow(_tables, _TABLE))
    return stored(tables.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "sid")
                  .mapInArrow(_fold, PLAN), "plans")


def _hash_pieces(batches):
    """SHA-256 of the newline-joined pieces of each conversation, fed piece by piece."""
    schema = "conv long, repaired_sha256 string"
    state, conv, empty = None, None, True
    for batch in batches:
        out = []
        for id_, piece in zip(*_columns(batch), strict=True):
            if state is None or id_ != conv:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                state, conv, empty = hashlib.sha256(), id_, True
            if piece:
                state.update(piece if empty else b"\n" + piece)
                empty = False
        yield arrow_batch(schema, out)
    if state is not None:
        yield arrow_batch(schema, [(conv, state.hexdigest())])


def _pieces(batches):
    for batch in batches:
        yield arrow_batch("conv long, sid long, piece binary",
                     [(conv, sid, _lines(replay(audit, top, roles, texts)))
                      for conv, sid, roles, texts, top, audit in zip(*_columns(batch), strict=True)])


def _turn_rows(batches):
    for batch in batches:
        out = []
        for conv, sid, roles, texts, top, audit in zip(*_columns(batch), strict=True):
            if top is None:  # a conversation inside one segment
                steps = list(zip([r[:1] for r in roles], faults(roles, texts, set()), strict=True))
                top, audit = 0, best(parse(steps))[1]
            out += [(conv, sid, i, role, text.decode())
                    for i, (role, text) in enumerate(replay(audit, top, roles, texts))]
        yield arrow_batch("conv long, sid long, place int, role string, text string", out)


def repaired_turns(turns: DataFrame, **columns) -> DataFrame:
    """The repaired conversations as rows: conv_id, sid, place, role, text (in order of sid and place)."""
    laid = segments(turns, **columns)
    plans = _plans(laid.where("open")).where("sid is not null").select("sid", "top", "audit")
    with small_batches(turns.sparkSession):
        return stored(laid.join(plans, "sid", "left").select("conv", "sid", "roles", "texts", "top", "audit").mapInArrow(
            _turn_rows, "conv long, sid long, place int, role string, text string"), "turns").withColumnRenamed(
                "conv", "conv_id")


def repair(turns: DataFrame, **columns) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The cheapest edits that give a conversation the grammar of roles, ties by the smallest audit. A null conv_id is a
    conversation, null turns come first and leave gaps alone, a null role or text is one space. Equal rows are
    duplicates of the first. A conversation without rows (see ``present_col``) has zeros and the digest of no text;
    an empty table gives no rows. Texts of any length are handled whole: a long conversation is hashed as a stream.
    """
    laid = segments(turns, **columns)
    closed = laid.where("not open").select("conv", "turns", "roles", "texts").mapInArrow(
        _parse_closed, f"{SUMMARY}, repaired_sha256 string")
    open_ = laid.where("open")
    plans = _plans(open_)
    pieces = (open_.join(plans.where("sid is not null").select("sid", "top", "audit"), "sid")
              .select("conv", "sid", "roles", "texts", "top", "audit")
              .mapInArrow(_pieces, "conv long, sid long, piece binary"))
    digests = (pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "sid")
               .select("conv", "piece").mapInArrow(_hash_pieces, "conv long, repaired_sha256 string")
               .withColumnRenamed("conv", "_c"))
    ends = plans.where("sid is null").drop("sid", "top")
    spread = ends.join(digests, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c")
    return stored(closed.unionByName(spread), "repaired").withColumnRenamed("conv", "conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with seeded faults, by crc32 of ``conv_id:turn`` modulo 20 (a null is one space): 0 drops the
    row (``present`` is false), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    text: Column = F.coalesce(F.col("text"), F.lit(" "))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumn(
        "_k", F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20)
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") != 0).alias("present"),
                        F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
                        .alias("_copy")).drop("_copy"))
