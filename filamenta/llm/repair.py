"""Conversation structure repair: the least edits that make turns alternate, by cost layers of reachable states.

A conversation's roles should read ``(s?(ua)+)?``: at most one system turn, then pairs of user and assistant. Turns are
kept (K, 0), given another role (R, 2), deleted (D, 3) or inserted without text (I, 2); a truncated turn that stays costs 1
more; blank turns and repeats of an earlier turn's role and text must go. For each cost from 0 up there is a layer: one
bitset a turn, of the grammar's states from which the rest of the conversation can be finished at exactly that cost. A layer
follows from the four before it by table look-ups over whole bitsets, as in approximate matching with one automaton a number
of errors. The first layer that holds the start state gives the cost; its bits are then followed from the first turn on,
taking the least letter that stays on them (D, I, K, R), which gives the ASCII-least of the cheapest audits. An audit settles
the roles: in each state only one of user and assistant can come next.

Conversations of up to PIECE turns and CHARS characters are solved whole in a task. Longer ones are dealt by range to all
tasks and cut into pieces: a table of costs between the states at a piece's ends, summed from the last piece to the first,
gives every piece the costs that follow it as its last layer. Pieces are then solved apart, from each state, and chained.
Only their texts meet again, as a stream: the digest of a conversation is a chain over all of it.

Null roles and texts count as one space. Turns are in order of ``turn`` (nulls first), then role and text; equal rows are
repeats. A null conversation id is one conversation. Empty texts are blank; texts are whole, however long. Of equal costs the
least audit is taken. An empty table gives an empty result. Columns other than the four named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamenta.llm.memory import give_back
from filamenta.operators.joins import hot_join
from filamenta.session import staged

PIECE, CHARS = 1000, 32 << 20
KEEP, ROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: The grammar's states: nothing yet, after the system turn, after a user, after an assistant. NEXT[letter][state].
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT: dict[str, dict[int, int]] = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What a state takes next when the role is free.
FREE = {q: next((x, NEXT[x][q]) for x in "ua" if q in NEXT[x]) for q in range(4)}
ENDS = (START, ASSISTANT)
FAR = 1 << 40


def _before(moves: dict[int, int]) -> list[int]:
    """For each set of states those that one of the moves brings into it."""
    return [sum(1 << q for q, to in moves.items() if held >> to & 1) for held in range(16)]


KEPT = {x: _before(m) for x, m in NEXT.items()}
FREED = _before({q: to for q, (_, to) in FREE.items()})
NONE = [0] * 16
#: Costs from each state after the last turn, insertions included.
CLOSING = [min((INSERT * n for n, end in enumerate([q, FREE[q][1], FREE[FREE[q][1]][1]]) if end in ENDS), default=FAR) for q in range(4)]
#: A turn for the solver: its role's initial, whether it must go, and what staying adds.
Turn = tuple[str, bool, int]


def layers(turns: list[Turn], after: list[int]) -> Iterator[list[int]]:
    """Layer by layer, the states before each turn from which the cost to the end is exactly the layer's number."""
    n, held = len(turns), []
    none = [0] * (n + 1)
    steps = [(NONE if must else KEPT.get(x, NONE), NONE if must else FREED, extra) for x, must, extra in turns]
    for cost in range(max((a for a in after if a < FAR), default=0) + (DELETE + 2 * INSERT) * (n + 1)):
        now = [0] * n + [sum(1 << q for q, a in enumerate(after) if a == cost)]
        back = [held[-k] if k <= len(held) else none for k in range(1, 4)]  # back[k - 1] is k layers before
        gone, put = back[DELETE - 1], back[INSERT - 1]
        own, changed = (now, back[CUT - 1]), (back[ROLE - 1], back[ROLE + CUT - 1])
        for i in range(n - 1, -1, -1):
            keep, free, extra = steps[i]
            now[i] = keep[own[extra][i + 1]] | free[changed[extra][i + 1]] | gone[i + 1] | FREED[put[i]]
        held.append(now)
        yield now


def traced(turns: list[Turn], after: list[int], state: int = START) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the least of the cheapest audits from ``state``."""
    held: list[list[int]] = []
    for now in layers(turns, after):
        held.append(now)
        if now[0] >> state & 1:
            break
    else:
        return FAR, "", state

    def reaches(cost: int, i: int, to: int | None) -> bool:
        return cost >= 0 and to is not None and bool(held[cost][i] >> to & 1)

    cost, i, audit = len(held) - 1, 0, []
    while i < len(turns):
        x, must, extra = turns[i]
        free = FREE[state][1]
        if reaches(cost - DELETE, i + 1, state):
            audit.append("D")
            cost, i = cost - DELETE, i + 1
        elif reaches(cost - INSERT, i, free):
            audit.append("I")
            cost, state = cost - INSERT, free
        elif not must and reaches(cost - extra, i + 1, NEXT.get(x, {}).get(state)):
            audit.append("K")
            cost, i, state = cost - extra, i + 1, NEXT[x][state]
        else:
            audit.append("R")
            cost, i, state = cost - ROLE - extra, i + 1, free
    return len(held) - 1, "".join(audit), state


def solved(turns: list[Turn]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; insertions after the last turn come as a turn of their own."""
    cost, audit, state = traced(turns, CLOSING)
    return cost, audit + "I" * (CLOSING[state] // INSERT)


def table_of_costs(turns: list[Turn]) -> list[int]:
    """Least costs from each state before the turns to each state after them, row by row; insertions come before a turn."""
    out = []
    for end in range(4):
        costs = [0 if q == end else FAR for q in range(4)]
        for x, must, extra in reversed(turns):
            past = [min(costs[q] + DELETE, FAR if must else costs[FREE[q][1]] + ROLE + extra, FAR if must or q not in NEXT.get(x, {}) else costs[NEXT[x][q]] + extra) for q in range(4)]
            once = [min(past[q], past[FREE[q][1]] + INSERT) for q in range(4)]
            costs = [min(FAR, once[q], once[FREE[q][1]] + INSERT) for q in range(4)]
        out.append(costs)
    return [out[end][q] for q in range(4) for end in range(4)]


def edited(audit: str, turns: list[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """Roles and texts that an audit makes of (role, text)."""
    at = iter(turns)
    for letter in audit:
        free, to = FREE[state]
        if letter == "I":
            yield ROLES[free], ""
        else:
            role, text = next(at)
            if letter == "D":
                continue
            if letter == "K":
                to = NEXT[role[:1]][state]
            yield role if letter == "K" else ROLES[free], text
        state = to


def _flags() -> dict[str, Column]:
    return {"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")}


class _Seen:
    """What the turns of a conversation, or of a piece of it, add up to."""

    def __init__(self) -> None:
        self.turns: list[Turn] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, blank: bool, repeat: bool, cut: bool) -> None:
        """``repeat``: an earlier turn has this role and text. The first fault counts."""
        cut = cut and not blank and not repeat
        self.blank += blank
        self.duplicate += repeat and not blank
        self.truncated += cut
        x = role[:1]
        self.illegal += bool(self.turns) and (self.turns[-1][0] + x) not in ("su", "ua", "au")
        self.turns.append((x, blank or repeat, int(cut)))
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(turns: Iterator[tuple[str, str]]) -> str:
    h, first = sha256(), True
    for role, text in turns:
        h.update(b"" if first else b"\n")
        h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return h.hexdigest()


def _audit_of(rows: list[tuple]) -> list[tuple]:
    seen, known = _Seen(), set()
    for _, turn, role, text, blank, cut in rows:
        seen.add(turn, role, blank, (role, text) in known, cut)
        known.add((role, text))
    cost, audit = solved(seen.turns)
    digest = _joined(edited(audit, [(r[2], r[3]) for r in rows]))
    return [(rows[0][0], seen.gaps(), seen.blank, seen.duplicate, seen.truncated, seen.illegal, cost, audit, digest)]


def _turns_of(rows: list[tuple]) -> list[tuple]:
    seen, known = _Seen(), set()
    for _, turn, role, text, blank, cut in rows:
        seen.add(turn, role, blank, (role, text) in known, cut)
        known.add((role, text))
    _, audit = solved(seen.turns)
    return [(rows[0][0], i, role, text) for i, (role, text) in enumerate(edited(audit, [(r[2], r[3]) for r in rows]))]


def _grouped(solve: Callable[[list[tuple]], list[tuple]], keys: int):
    """Solves each run of rows that agree in their first ``keys`` columns. Rows come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(schema)], schema=schema)

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:keys] != held[0][:keys]:
                    done += solve(held)
                    held = []
                held.append(row)
            if done:
                yield out(done)
        if held:
            yield out(solve(held))
        give_back()

    return run


def _mapped(rows: DataFrame, solve: Callable[[list[tuple]], list[tuple]], by: list[str], order: list[Column | str], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ready = rows.repartition(*by).sortWithinPartitions(*by, *order)
    arrow, run = to_arrow_schema(StructType.fromDDL(schema)), _grouped(solve, len(by))
    return ready.mapInArrow(lambda batches: run(batches, arrow), schema)


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    at = F.col(turn).cast("long")
    picked = rows.select(F.col(conv).alias("conv"), at.alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return picked.withColumns(_flags())


def _large(rows: DataFrame, piece: int, chars: int) -> DataFrame:
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return staged(sizes.where((F.col("n") > piece) | (F.col("chars") > chars)).select("conv"), "repair-large")


def audited(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE, chars: int = CHARS) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated and illegal counts, cost, audit, repaired_sha256."""
    every = _plain(rows, conv, turn, role, text)
    kind = every.schema["conv"].dataType.simpleString()
    large = _large(every, piece, chars)
    some = not large.isEmpty()
    short = every.join(large.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left_anti") if some else every
    out = _mapped(short, _audit_of, ["conv"], ["turn", "role", "text"], f"conv {kind}, {COUNTS}")
    if some:
        out = out.unionByName(_audited_in_pieces(every, large, piece))
    return out.withColumnRenamed("conv", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE, chars: int = CHARS) -> DataFrame:
    """(conv, position, role, text): the repaired conversations of up to ``piece`` turns; longer ones raise an error."""
    every = _plain(rows, conv, turn, role, text)
    if not _large(every, piece, chars).isEmpty():
        raise ValueError("a conversation is longer than a piece; take its audit instead")
    kind = every.schema["conv"].dataType.simpleString()
    out = _mapped(every, _turns_of, ["conv"], ["turn", "role", "text"], f"conv {kind}, position int, role string, text string")
    return out.select(F.col("conv").alias(conv), "position", "role", "text")


def _cut_up(piece: int):
    """Numbers the pieces of sorted rows (c, turn, role, text, blank, cut, first) and marks repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, k, last = TaskContext.get().partitionId() << 40, 0, 0, None
        for batch in batches:
            pieces, places, repeats = [], [], []
            for c, turn, role, text, early in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "role", "text", "early")), strict=True):
                same = last == (c, turn, role, text)
                number, k = (number + 1, 0) if last is None or last[0] != c or k + 1 >= piece else (number, k + 1)
                last = (c, turn, role, text)
                pieces.append(base + number)
                places.append(k)
                repeats.append(early or same)
            columns = [batch.column(x) for x in ("c", "turn", "role", "text", "blank", "cut")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.int64()), pa.array(places, pa.int32()), pa.array(repeats, pa.bool_())], ["c", "turn", "role", "text", "blank", "cut", "piece", "k", "repeat"])

    return run


_PART = "c long, piece long, costs array<long>, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string"


def _piece_costs(rows: list[tuple]) -> list[tuple]:
    seen = _Seen()
    for _, _, _, turn, x, blank, cut, repeat in rows:
        seen.add(turn, x, blank, repeat, cut)
    c, piece = rows[0][:2]
    return [(c, piece, table_of_costs(seen.turns), seen.blank, seen.duplicate, seen.truncated, seen.illegal, seen.distinct, seen.low, seen.high, seen.turns[0][0], seen.turns[-1][0])]


def _costs_after(pieces: list[tuple]) -> list[tuple]:
    after, out = CLOSING, []
    for c, piece, costs, *_ in reversed(pieces):
        out.append((c, piece, after))
        after = [min(FAR, *(costs[4 * q + e] + after[e] for e in range(4))) for q in range(4)]
    return out


def _piece_audits(rows: list[tuple]) -> list[tuple]:
    seen = _Seen()
    for *_, turn, x, blank, cut, repeat, _ in rows:
        seen.add(turn, x, blank, repeat, cut)
    found = [traced(seen.turns, rows[0][-1], q) for q in range(4)]
    return [(*rows[0][:2], [f[0] for f in found], [f[1] for f in found], [f[2] for f in found])]


def _chained(pieces: list[tuple]) -> list[tuple]:
    """Rows (c, piece, costs, audits, ends) of a conversation in order: each piece's audit and the state that it starts from."""
    state, out = START, []
    for c, piece, costs, audits, ends in pieces:
        out.append([c, piece, state, audits[state], costs[state]])
        state = ends[state]
    out[-1][3] += "I" * (CLOSING[state] // INSERT)
    total = out[0][4]
    return [(c, piece, q, audit, total) for c, piece, q, audit, _ in out]


def _summed(pieces: list[tuple]) -> list[tuple]:
    total, high, low, last = [0] * 5, None, None, None
    for _, _, blank, duplicate, truncated, illegal, distinct, lo, hi, x, y in pieces:
        met = lo is not None and lo == high
        across = last is not None and last + x not in ("su", "ua", "au")
        total = [a + b for a, b in zip(total, (blank, duplicate, truncated, illegal + across, distinct - met), strict=True)]
        low, high, last = lo if low is None else low, high if hi is None else hi, y
    return [(pieces[0][0], 0 if low is None else high - low + 1 - total[4], *total[:4])]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, cost, audit, sha): rows (c, piece, k, role, text, state, audit, total) in order; audits stand at a piece's first row."""
    now, parts, cost, h, first, at = None, [], 0, sha256(), True, iter(())
    state = START

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([cost], pa.int64()), pa.array(["".join(parts)]), pa.array([h.hexdigest()])], ["c", "cost", "audit", "sha"])

    def take(role: str, text: str) -> None:
        nonlocal first
        h.update(b"" if first else b"\n")
        h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def inserted(letter: str | None) -> str | None:
        nonlocal state
        while letter == "I":
            take(ROLES[FREE[state][0]], "")
            state, letter = FREE[state][1], next(at, None)
        return letter

    for batch in batches:
        for c, _, k, role, text, entry, audit, total in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k == 0:
                inserted(next(at, None))
            if c != now:
                if now is not None:
                    yield done()
                now, parts, cost, h, first = c, [], total, sha256(), True
            if k == 0:
                state, at = entry, iter(audit)
                parts.append(audit)
            letter = inserted(next(at))
            if letter == "K":
                take(role, text)
                state = NEXT[role[:1]][state]
            elif letter == "R":
                take(ROLES[FREE[state][0]], text)
                state = FREE[state][1]
    if now is not None:
        inserted(next(at, None))
        yield done()


def _audited_in_pieces(every: DataFrame, large: DataFrame, piece: int) -> DataFrame:
    numbers = staged(large.select("conv", F.monotonically_increasing_id().alias("c")), "repair-numbers")
    ids = numbers.withColumnRenamed("conv", "id")
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    rows = staged(every.join(ids, F.col("conv").eqNullSafe(F.col("id"))).select("c", "turn", "role", "text", "blank", "cut", at.alias("at")), "repair-rows")
    firsts = rows.groupBy("c", "role", "text").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    marked = hot_join(rows, firsts, ["c", "role", "text"], "n", rows.count()).withColumn("early", F.col("at") > F.col("least"))
    order = ["c", "turn", "role", "text"]
    ready = marked.select(*order, "blank", "cut", "early").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "c long, turn long, role string, text string, blank boolean, cut boolean, piece long, k int, repeat boolean"
    cut = staged(ready.mapInArrow(_cut_up(piece), schema), "repair-pieces")
    light = cut.select("c", "piece", "k", "turn", F.substring("role", 1, 1).alias("x"), "blank", "cut", "repeat")
    parts = staged(_mapped(light, _piece_costs, ["c", "piece"], ["k"], _PART), "repair-costs")
    after = _mapped(parts.select("c", "piece", "costs"), _costs_after, ["c"], ["piece"], "c long, piece long, after array<long>")
    with_after = light.join(after.withColumnRenamed("c", "c2"), "piece").where("c = c2").select(*light.columns, "after")
    audits = _mapped(with_after, _piece_audits, ["c", "piece"], ["k"], "c long, piece long, costs array<long>, audits array<string>, ends array<int>")
    chained = staged(_mapped(audits, _chained, ["c"], ["piece"], "c long, piece long, state int, audit string, total long"), "repair-audits")
    sums = _mapped(parts.drop("costs"), _summed, ["c"], ["piece"], "c long, gaps long, blank long, duplicate long, truncated long, illegal long")
    first_rows = cut.where("k = 0").join(chained.drop("c"), "piece").select("c", "piece", "k", "role", "text", "state", "audit", "total")
    rest = cut.where("k > 0").select("c", "piece", "k", "role", "text", F.lit(0).alias("state"), F.lit("").alias("audit"), F.lit(0).cast("long").alias("total"))
    texts = first_rows.unionByName(rest).repartition("c").sortWithinPartitions("c", "piece", "k")
    digests = texts.mapInArrow(_digests, "c long, cost long, audit string, sha string")
    return sums.join(digests, "c").join(numbers, "c").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
