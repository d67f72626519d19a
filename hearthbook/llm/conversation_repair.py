"""Repair of conversation structure at least cost.

A conversation's rows, by turn, are edited until their role initials read
``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an
empty turn 5, and a truncated row that stays 5 more.  Blank rows and rows seen
before must go.  The edit lattice has a node per row boundary and state of the
pattern; ``cheapest`` searches it by bidirectional Dijkstra: a forward and a reverse
heap meet, every crossing of the least cost is finished, and of those the least
audit, the edits' initials in order, wins.

Rows are range-sorted by conversation and turn, so that no task needs to hold one
conversation.  Those inside one range, of up to 512 rows and 1 MB, are solved where
they stand.  Longer ones, and those at a range's ends, are cut into slices.  A slice
gives its least cost and audit from every state to every state; a pass over these
short tables picks the states at the cuts; a second pass feeds the repaired text
to its hash in order, one slice at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.llm._store import Scratch

#: States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\v\f\r"
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
MOST = (1 << 63) - 1
_INTO = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
_ALTERNATE = _INTO["u"] + _INTO["a"]
FAULTS = ("blank", "duplicate", "truncated")
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

Row = tuple[str, str | None]  # role initial, first fault


def fault(role: str, text: str, seen: bool) -> str | None:
    shown = text.rstrip(SPACES)
    if not shown:
        return "blank"
    return "duplicate" if seen else "truncated" if shown[-1] not in ".!?" else None


def _moves(rows: list[Row]) -> tuple[list[list[list]], list[list[list]]]:
    """Edges by (row boundary, state), forward (boundary, state, cost, initial) and reverse."""
    out = [[[] for _ in range(4)] for _ in range(len(rows) + 1)]
    back = [[[] for _ in range(4)] for _ in range(len(rows) + 1)]

    def add(i: int, s: int, j: int, t: int, cost: int, edit: str) -> None:
        out[i][s].append((j, t, cost, edit))
        back[j][t].append((i, s, cost, edit))

    for i in range(len(rows) + 1):
        for s, t in _ALTERNATE:
            add(i, s, i, t, INSERT, "I")
    for i, (initial, wrong) in enumerate(rows):
        for s in range(4):
            add(i, s, i + 1, s, DELETE, "D")
        if wrong in ("blank", "duplicate"):
            continue
        more, fits = TRUNCATED if wrong else 0, _INTO.get(initial, ())
        for s, t in fits:
            add(i, s, i + 1, t, more, "K")
        for s, t in _ALTERNATE:
            if (s, t) not in fits:
                add(i, s, i + 1, t, REROLE + more, "R")
    return out, back


def cheapest(rows: list[Row], entry: int = START, exits: tuple[int, ...] = ACCEPTS, moves=None) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that lead from entry to one of exits; None if none do.

    Heaps are ordered by cost, then by progress: edges that cost nothing go to the next
    row, so when a node is taken from a heap, all its ways of that cost are in it.
    """
    end = len(rows)
    edges = moves or _moves(rows)
    settled: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([], [])
    least, crossings = None, []

    def cross(cost: int, audit: str) -> None:
        nonlocal least, crossings
        if least is None or cost < least:
            least, crossings = cost, [audit]
        elif cost == least:
            crossings.append(audit)

    def settle(side: int, cost: int, audit: str, node: tuple[int, int]) -> None:
        mine, other = settled[side], settled[1 - side]
        mine[node] = cost, audit
        if node in other:
            there = other[node]
            cross(cost + there[0], audit + there[1] if side == 0 else there[1] + audit)
        for j, t, price, edit in edges[side][node[0]][node[1]]:
            to = (j, t)
            if to in other:
                there = other[to]
                cross(cost + price + there[0], audit + edit + there[1] if side == 0 else there[1] + edit + audit)
            if to not in mine:
                heappush(heaps[side], (cost + price, j if side == 0 else -j, audit + edit if side == 0 else edit + audit, to))

    settle(0, 0, "", (0, entry))
    for t in exits:
        settle(1, 0, "", (end, t))
    while True:
        for side in (0, 1):
            while heaps[side] and heaps[side][0][3] in settled[side]:
                heappop(heaps[side])
        if not heaps[0] and not heaps[1]:
            break
        tops = [heap[0][0] if heap else None for heap in heaps]
        if least is not None and (None in tops or sum(tops) > least):
            break
        side = 1 if tops[0] is None or (tops[1] is not None and tops[1] < tops[0]) else 0
        cost, _, audit, node = heappop(heaps[side])
        settle(side, cost, audit, node)
    return None if least is None else (least, min(crossings))


def apply(audit: str, rows: list[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """The (role, text) rows that an audit makes of rows, from a state on."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        yield role, text


def shorten(heads: list[str | None]) -> list[str | None]:
    """Shorter strings that compare alike, whatever is appended to them; None stands for no way."""
    live = sorted({h for h in heads if h is not None})
    short = {}

    def walk(group: list[str], at: int, built: str) -> None:
        if len(group) == 1:
            short[group[0]] = built
        elif len(group[0]) == at:  # one ends here, so the others go on by inserts alone
            short.update((h, built + h[at:]) for h in group)
        else:
            # live strings are few and the walk skips what all share
            first, last = group[0], group[-1]
            while at < len(first) and first[at] == last[at]:
                at += 1
            if at == len(first):
                short.update((h, built + h[at:]) for h in group)
                return
            for letter in sorted({h[at] for h in group}):
                walk([h for h in group if h[at] == letter], at + 1, built + letter)

    walk(live, 0, "") if live else None
    return [None if h is None else short[h] for h in heads]


class Chain:
    """The slices of one conversation, one after another: which states they meet in."""

    def __init__(self):
        self.costs, self.heads, self.backs = [0, None, None, None], ["", None, None, None], []

    def add(self, table: list[dict | None]) -> None:
        """table: (cost, audit) from state s to state t at 4 * s + t."""
        costs, heads, back = [None] * 4, [None] * 4, [0] * 4
        for t in range(4):
            ways = [(self.costs[s] + way["cost"], self.heads[s] + way["audit"], s) for s in range(4) if self.costs[s] is not None and (way := table[4 * s + t])]
            if ways:
                costs[t], heads[t], back[t] = min(ways)
        self.costs, self.heads = costs, shorten(heads)
        self.backs.append(bytes(back))

    def close(self) -> tuple[int, list[tuple[int, int]]]:
        """(cost, states before and after every slice)."""
        cost, _, state = min((self.costs[t], self.heads[t], t) for t in ACCEPTS if self.costs[t] is not None)
        ways = []
        for back in reversed(self.backs):
            ways.append((back[state], state))
            state = back[state]
        return cost, ways[::-1]


class Tally:
    """Counts over the rows of a conversation, in order."""

    def __init__(self):
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.initial = None

    def add(self, turn: int | None, initial: str, wrong: str | None) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.last
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if wrong:
            self.faults[wrong] += 1

    def row(self, cost: int) -> list[int]:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return [gaps, *(self.faults[f] for f in FAULTS), self.illegal, cost]


def _table(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


_WAY = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_RESULT = [*[pa.int64()] * 6, pa.string(), pa.string()]
_RESULT_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _solve(rows: list[tuple]) -> list:
    """rows (turn, role, text, tie) of one whole conversation -> the result columns."""
    tally, seen, lattice = Tally(), set(), []
    for turn, role, text, tie in rows:
        wrong = fault(role, text, tie in seen)
        seen.add(tie)
        tally.add(turn, role[:1], wrong)
        lattice.append((role[:1], wrong))
    cost, audit = cheapest(lattice)
    joined = "\n".join(f"{role}:{text}" for role, text in apply(audit, [(r[1], r[2]) for r in rows]))
    return [*tally.row(cost), audit, hashlib.sha256(joined.encode()).hexdigest()]


def _cut(keep_texts: bool, most_rows: int, most_bytes: int):
    """Sorted rows -> a row per slice; whole conversations have their result, others their rows."""
    names = ["conv_id", "part", "seq", *_RESULT_NAMES, "turns", "roles", "texts", "ties"]

    def run(batches):
        part, seq, kind = TaskContext.get().partitionId(), 0, None
        conv, held, size, sliced, first = object(), [], 0, False, True
        out: list[tuple] = []

        def give(edge: bool) -> None:
            nonlocal seq, held, size
            if held:
                whole = not edge and not sliced
                result = _solve(held) if whole else [None] * len(_RESULT_NAMES)
                lists = [list(c) for c in zip(*held, strict=True)] if keep_texts or not whole else [None] * 4
                out.append((conv, part, seq, *result, *lists))
                seq, held, size = seq + 1, [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out
            made, out = out, []
            return _table(names, [kind, pa.int64(), pa.int64(), *_RESULT, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string())], made)

        for table in batches:
            kind = table.schema.field("conv_id").type
            for key, *row in zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "tie")), strict=True):
                if key != conv and (held or sliced):
                    give(edge=first)
                    sliced, first = False, False
                elif held and (len(held) >= most_rows or size + len(row[2]) > most_bytes):
                    sliced = True
                    give(edge=True)
                conv = key
                held.append(row)
                size += len(row[1]) + len(row[2])
                if len(out) >= 256:
                    yield batch()
        give(edge=True)
        if out:
            yield batch()

    return run


def _ways(batches):
    """Slices with the places of first sights -> their tables of costs and audits, and what the counts need."""
    for batch in batches:
        out = []
        for conv, part, seq, turns, roles, texts, news in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "turns", "roles", "texts", "news")), strict=True):
            new = set(news or ())
            wrong = [fault(r, t, k not in new) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
            lattice = [(r[:1], w) for r, w in zip(roles, wrong, strict=True)]
            moves = _moves(lattice)
            ways = [cheapest(lattice, s, (t,), moves) for s in range(4) for t in range(4)]
            out.append((conv, part, seq, [w and {"cost": w[0], "audit": w[1]} for w in ways], turns, [r[:1] for r in roles], wrong))
        yield _table(["conv_id", "part", "seq", "ways", "turns", "initials", "faults"], [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.list_(_WAY), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())], out)


def _chain(batches):
    """Tables in order -> per slice its part, seq, states and audit; on a conversation's last slice also its counts."""
    names = ["part", "seq", "entry", "leave", "counts"]
    conv, chain, tally, places = object(), None, None, []

    def close() -> pa.RecordBatch:
        cost, states = chain.close()
        last = [None] * (len(places) - 1) + [tally.row(cost)]
        return _table(names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())], [(*p, *s, c) for p, s, c in zip(places, states, last, strict=True)])

    for batch in batches:
        for key, part, seq, ways, turns, initials, faults in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "ways", "turns", "initials", "faults")), strict=True):
            if key != conv or chain is None:
                if chain:
                    yield close()
                conv, chain, tally, places = key, Chain(), Tally(), []
            chain.add(ways)
            places.append((part, seq))
            for row in zip(turns, initials, faults, strict=True):
                tally.add(*row)
    if chain:
        yield close()


def _digest(batches):
    """Slices in order, with their audits -> a row per conversation."""
    conv, running, audits, counts, kind, started = object(), None, [], None, None, False

    def close() -> pa.RecordBatch:
        return _table(["conv_id", *_RESULT_NAMES], [kind, *_RESULT], [(conv, *counts, "".join(audits), running.hexdigest())])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for key, entry, audit, of_last, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "entry", "audit", "counts", "roles", "texts")), strict=True):
            if key != conv or running is None:
                if running:
                    yield close()
                conv, running, audits, counts, started = key, hashlib.sha256(), [], None, False
            for role, text in apply(audit, list(zip(roles, texts, strict=True)), entry):
                running.update((("\n" if started else "") + f"{role}:{text}").encode())
                started = True
            audits.append(audit)
            counts = of_last or counts
    if running:
        yield close()


def _slices(rows: DataFrame, keep_texts: bool, limits: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(slices, and for those without a result their states, audits and counts)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    tie = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    tied = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), tie.alias("tie"), F.monotonically_increasing_id().alias("again"))
    order = ["conv_id", "turn", "tie"]
    ranged = tied.repartitionByRange(*order, "again").sortWithinPartitions(*order).drop("again")
    result = f"{COUNTS}, audit string, repaired_sha256 string"
    slices = scratch.keep("slices", ranged.mapInArrow(_cut(keep_texts, *limits), f"conv_id {kind}, part long, seq long, {result}, turns array<long>, roles array<string>, texts array<string>, ties array<string>"))
    open_ = slices.where("cost is null")
    # the first sight of a row, of all slices of its conversation
    place = F.struct("part", "seq", "k")
    sights = open_.select("conv_id", "part", "seq", F.posexplode("ties").alias("k", "tie")).groupBy("conv_id", "tie").agg(F.min(place).alias("p"))
    news = sights.groupBy("p.part", "p.seq").agg(F.collect_list("p.k").alias("news"))
    known = open_.select("conv_id", "part", "seq", "turns", "roles", "texts").join(news, ["part", "seq"], "left")
    tables = scratch.keep("ways", known.mapInArrow(_ways, f"conv_id {kind}, part long, seq long, ways array<struct<cost:long,audit:string>>, turns array<long>, initials array<string>, faults array<string>"))
    chained = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_chain, "part long, seq long, entry int, leave int, counts array<long>")
    chosen = tables.select("part", "seq", "ways").join(chained, ["part", "seq"]).select("part", "seq", "entry", "counts", F.expr("ways[4 * entry + leave].audit").alias("audit"))
    return slices, scratch.keep("chosen", chosen)


def repair(rows: DataFrame, limits: tuple[int, int] = (SLICE_ROWS, SLICE_BYTES)) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text is one space, so such a row is blank or must get a role; a
    null turn comes first and counts in no gap; rows of a null conv_id are one
    conversation.  Rows of equal turn stand by the MD5 of role and text; repeated rows
    are duplicates.  A gap count over the greatest long is that.  Texts of any length
    are hashed whole.  Conversations of any length are handled slice by slice; limits
    are a slice's rows and bytes, and do not change results.  Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    kind = rows.schema["conv_id"].dataType.simpleString()
    slices, chosen = _slices(rows, False, limits, scratch)
    ready = slices.where("cost is not null").select("conv_id", *_RESULT_NAMES)
    texts = slices.where("cost is null").select("conv_id", "part", "seq", "roles", "texts").join(chosen, ["part", "seq"])
    hashed = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_digest, f"conv_id {kind}, {COUNTS}, audit string, repaired_sha256 string")
    return ready.unionAll(hashed)


def rewrite(rows: DataFrame, limits: tuple[int, int] = (SLICE_ROWS, SLICE_BYTES)) -> DataFrame:
    """The repaired conversations themselves: conv_id, part, seq, k, role, text, in the order of part, seq and k.  Inputs as for ``repair``."""
    scratch = Scratch(rows.sparkSession, "rewrite")
    kind = rows.schema["conv_id"].dataType.simpleString()
    slices, chosen = _slices(rows, True, limits, scratch)
    ready = slices.where("cost is not null").select("conv_id", "part", "seq", F.lit(START).alias("entry"), "audit", "roles", "texts")
    rest = slices.where("cost is null").join(chosen.withColumnRenamed("audit", "way"), ["part", "seq"]).select("conv_id", "part", "seq", "entry", F.col("way").alias("audit"), "roles", "texts")

    def run(batches):
        for batch in batches:
            out = []
            for conv, part, seq, entry, audit, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(conv, part, seq, k, *row) for k, row in enumerate(apply(audit, list(zip(roles, texts, strict=True)), entry))]
            yield _table(["conv_id", "part", "seq", "k", "role", "text"], [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()], out)

    return ready.unionAll(rest).mapInArrow(run, f"conv_id {kind}, part long, seq long, k int, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with seeded faults, by the CRC-32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question
    marks away, 3 repeats it, 4 makes its role user.  Nulls are read as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(blank("role"))
    times = F.expr("explode(case when kind = 3 then array(1, 2) else array(1) end)")
    return rows.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")
