"""Repair of conversation structure along tight arcs of a layered graph.

A conversation's rows are the layers of a graph, its nodes (rows consumed, what the kept turns so far amount to): nothing, a system
turn, ending with a user, ending with an assistant. Arcs are edits: K keeps a row, R gives it the role that fits, D deletes it, I inserts a turn. Costs from the
start and costs to the end, computed in both directions, tell the tight arcs: those on some cheapest path. A frontier of nodes is
moved along these only, by the least letter that any of its tight arcs has, which spells the least of all cheapest edits.

A conversation may hold most of all rows, so nothing but its edits and its hash is made in one place:

1. All rows are dealt by ranges of (conversation, turn, role, text) and cut into blocks of at most ``ROWS`` rows. Faults are judged row by row; a row seen
   earlier is found by a hash of role and text, by the first place that has it.
2. A block's costs from each node to each are a min-plus matrix of 4 x 4. Products of a conversation's matrices, forwards and backwards, give the costs at
   the ends of each block.
3. With these a block knows its tight arcs, and where its frontier leaves it for each node it may enter by; following these gives the node by which it is entered.
4. Each block spells its edits. A conversation's blocks are streamed in order, one at a time, past the hash of the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, partitions, small_batches, spread_join, stored

#: Rows of a block, and bytes of text after which it ends.
ROWS, BYTES = 4_096, 1 << 20
WHITE = " \t\n\x0b\x0c\r"
#: What each edit costs, and what an unfinished turn adds that stays.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
_FAR = 1 << 50
#: Nodes: nothing yet, after a system turn, after a user, after an assistant. Which turn leads on from each, and where it is fine to end.
_AFTER_USER = (0, 1, 3)
_ENDS = (0, 3)
#: Symbols: 4 x the role's initial (s, u, a, other) + the first fault (none, unfinished, seen earlier, blank).
_INITIALS, _FINE, _UNFINISHED, _SEEN, _BLANK = "sua", 0, 1, 2, 3

_Costs = tuple[int, ...]


def _arcs(symbol: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits that consume a row."""
    initial, fault = divmod(symbol, 4)
    out = [("D", x, x, DELETE) for x in range(4)]
    if fault in (_FINE, _UNFINISHED):
        more = UNFINISHED * (fault == _UNFINISHED)
        turns = [(x, 2) for x in _AFTER_USER] + [(2, 3)]
        kept = [(0, 1)] if initial == 0 else [t for t in turns if t[1] == initial + 1]
        out += [("K", *t, KEEP + more) for t in kept] + [("R", *t, REROLE + more) for t in turns]
    return out


_ARCS = [_arcs(s) for s in range(16)]
_INSERTS = [("I", x, 2, INSERT) for x in _AFTER_USER] + [("I", 2, 3, INSERT)]


def _inserted(costs: list[int], forward: bool) -> list[int]:
    """Costs with any inserts at this place."""
    for _ in range(2):
        for _, x, y, w in _INSERTS:
            if forward:
                costs[y] = min(costs[y], costs[x] + w)
            else:
                costs[x] = min(costs[x], costs[y] + w)
    return costs


def forwards(symbols: bytes, start: _Costs) -> list[list[int]]:
    """For each place before a row, and the last, the least costs from the start to each node."""
    out = [_inserted(list(start), True)]
    for s in symbols:
        before, after = out[-1], [_FAR] * 4
        for _, x, y, w in _ARCS[s]:
            after[y] = min(after[y], before[x] + w)
        out.append(_inserted(after, True))
    return out


def backwards(symbols: bytes, end: _Costs) -> list[list[int]]:
    """The same to the end, whose own costs include the inserts there."""
    out = [list(end)]
    for s in reversed(symbols):
        after, before = out[-1], [_FAR] * 4
        for _, x, y, w in _ARCS[s]:
            before[x] = min(before[x], w + after[y])
        out.append(_inserted(before, False))
    return out[::-1]


START = (0, _FAR, _FAR, _FAR)
END = tuple(_inserted([0 if x in _ENDS else _FAR for x in range(4)], False))


def matrix(symbols: bytes) -> list[int]:
    """Costs from each node before a block's rows to each node after them, without inserts there: 16 numbers."""
    columns = [backwards(symbols, tuple(0 if x == y else _FAR for x in range(4)))[0] for y in range(4)]
    return [min(columns[y][x], _FAR) for x in range(4) for y in range(4)]


def boundaries(matrices: list[list[int]]) -> tuple[list[_Costs], list[_Costs], int]:
    """The costs from the start to before each block, from after each block to the end, and of the whole."""
    from_start, to_end = [START], [END]
    for m in matrices[:-1]:
        from_start.append(tuple(min(_FAR, *(from_start[-1][x] + m[4 * x + y] for x in range(4))) for y in range(4)))
    for m in reversed(matrices):
        to_end.append(tuple(min(_FAR, *(m[4 * x + y] + to_end[-1][y] for y in range(4))) for x in range(4)))
    return from_start, to_end[-2::-1], to_end[-1][0]


def spelled(symbols: bytes, enter: int, start: _Costs, end: _Costs, least: int, last: bool) -> tuple[str, int]:
    """The letters of a block that is entered by a node, and the node by which it is left; after the ``last`` block, turns may be inserted."""
    here, there = forwards(symbols, start), backwards(symbols, end)
    letters: list[str] = []
    frontier = {enter}
    place = 0
    while place < len(symbols) or last:
        arcs = _INSERTS + (_ARCS[symbols[place]] if place < len(symbols) else [])
        tight = [(c, y) for c, x, y, w in arcs if x in frontier and here[place][x] + w + there[place + (c != "I")][y] == least]
        if not tight:  # only after all rows
            break
        letter = min(c for c, _ in tight)
        frontier = {y for c, y in tight if c == letter}
        letters.append(letter)
        place += letter != "I"
    # Roles alternate, so the letters so far tell the node: the frontier has one.
    return "".join(letters), min(frontier)


@lru_cache(1 << 14)
def edits(symbols: bytes) -> tuple[int, str]:
    """Cost and letters of the least cheapest edits of a whole conversation."""
    start, end, least = boundaries([matrix(symbols)])
    return least, spelled(symbols, 0, start[0], end[0], least, True)[0]


def applied(letters: str, node: int, turns: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """The turns that the letters make, from a node on, and the node after them."""
    out, given = [], iter(turns)
    for c in letters:
        if c == "D":
            next(given)
            continue
        if c == "K":
            turn = next(given)
            node = 1 if turn[0][:1] == "s" else 2 if node in _AFTER_USER else 3
        else:
            node = 2 if node in _AFTER_USER else 3
            turn = ("user" if node == 2 else "assistant", "" if c == "I" else next(given)[1])
        out.append(turn)
    return out, node


def _faults(role: Column, text: Column) -> Column:
    """Each row's symbol, as if no row had been seen earlier."""
    initial = F.substring(role, 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rest = F.rtrim(text, F.lit(WHITE))
    fault = F.when(rest == "", _BLANK).when(F.substring(rest, -1, 1).isin(".", "!", "?"), _FINE).otherwise(_UNFINISHED)
    return (4 * number + fault).cast("int")


_BLOCK = "key string, part int, block int, turns array<bigint>, symbols binary, one array<bigint>, two array<bigint>, roles array<string>, texts array<string>"


def _blocks(turns: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) as blocks, in order of (key, part, block); written once."""
    rows = turns.select(
        "key", "turn", "role", "text", _faults(F.col("role"), F.col("text")).alias("symbol"),
        F.xxhash64("role", "text").alias("one"), F.xxhash64(F.lit(1), "text", "role").alias("two"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["key", "turn", "role", "text", "row"]  # nulls first; equal rows may be parted
    sorted_rows = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    arrow = _arrow_schema(turns.sparkSession, _BLOCK)
    rows_most, bytes_most = ROWS, BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        now, size = None, 0

        def flush() -> pa.RecordBatch:
            turn, role, text, symbol, one, two = zip(*held, strict=True)
            columns = [[now], [part], [number], [turn], [bytes(symbol)], [one], [two], [role], [text]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, *row in zip(*columns, strict=True):
                if held and (key != now or len(held) >= rows_most or size >= bytes_most):
                    yield flush()
                    held, size, number = [], 0, number + 1
                now = key
                held.append(tuple(row))
                size += len(row[2])
        if held:
            yield flush()

    return stored(sorted_rows.select("key", "turn", "role", "text", "symbol", "one", "two").mapInArrow(run, _BLOCK), "turn-blocks")


_AT = ["key", "part", "block"]


def _seen(blocks: DataFrame) -> DataFrame:
    """(key, part, block, symbols) with the rows marked whose role and text an earlier row of the conversation has."""
    said = ["key", "one", "two"]
    each = blocks.select(*_AT, F.explode(F.arrays_zip("one", "two", F.sequence(F.lit(0), F.size("one") - 1).alias("row"))).alias("r")).select(*_AT, "r.one", "r.two", "r.row")
    place = F.struct("part", "block", "row")
    several = stored(each.groupBy(*said).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "turns-seen")
    later = spread_join(each, several.drop("n"), said, sizes=several.select(*said, "n")).where(place != F.col("first"))
    marks = later.groupBy(*_AT).agg(F.collect_list("row").alias("rows"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols, rows in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                now = bytearray(symbols)
                for k in rows or ():
                    if now[k] % 4 != _BLANK:
                        now[k] += _SEEN - now[k] % 4
                out.append(bytes(now))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=[*_AT, "symbols"])

    joined = blocks.select(*_AT, "symbols").join(marks, _AT, "left")
    return joined.mapInArrow(mark, "key string, part int, block int, symbols binary")


def _by_key(df: DataFrame, fn: Callable[[list[tuple]], list[tuple]], column: str, schema: str) -> DataFrame:
    """What ``fn`` makes of the values of each conversation's blocks, in order: a row for each block."""
    arrow = _arrow_schema(df.sparkSession, f"key string, part int, block int, {schema}")
    ordered = df.select(*_AT, column).repartition(partitions(df.sparkSession), "key").sortWithinPartitions(*_AT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out, ats, begin = [], [], 0
            for k in range(1, len(held) + 1):
                if k == len(held) or held[k][0] != held[begin][0]:
                    out += fn([r[3] for r in held[begin:k]])
                    ats += [r[:3] for r in held[begin:k]]
                    begin = k
            rows = [(*at, *o) for at, o in zip(ats, out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 1_024 and row[0] != held[-1][0]:
                    yield from flush()
                    held = []
                held.append(row)
        if held:
            yield from flush()

    return ordered.mapInArrow(run, f"key string, part int, block int, {schema}")


def _mapped(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """``fn`` of each row's columns after the first three, beside these."""
    arrow = _arrow_schema(df.sparkSession, f"key string, part int, block int, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [fn(*row) for row in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[3:], strict=True))], schema=arrow)

    return df.mapInArrow(run, f"key string, part int, block int, {schema}")


def _costs_of(matrices: list[list[int]]) -> list[tuple]:
    starts, ends, least = boundaries(matrices)
    return [(s, e, least, k == len(starts) - 1) for k, (s, e) in enumerate(zip(starts, ends, strict=True))]


def _entered(ways: list[list[int]]) -> list[tuple]:
    out, node = [], 0
    for way in ways:
        out.append((node,))
        node = way[node]
    return out


def _way(symbols: bytes, start: list[int], end: list[int], least: int, last: bool) -> tuple:
    """Where a frontier that enters by each node leaves; -1 for nodes off all cheapest paths."""
    there = backwards(symbols, tuple(end))[0]
    return ([spelled(symbols, x, tuple(start), tuple(end), least, last)[1] if start[x] + there[x] == least else -1 for x in range(4)],)


def _edited(symbols: DataFrame) -> DataFrame:
    """(key, part, block, symbols, letters, node, least): each block's edits, and the node by which it is entered."""
    costs = stored(_by_key(_mapped(symbols, lambda s: (matrix(s),), "m array<bigint>"), _costs_of, "m", "start array<bigint>, end array<bigint>, least bigint, last boolean"), "turn-costs")
    told = symbols.join(costs, _AT).select(*_AT, "symbols", "start", "end", "least", "last")
    ways = _mapped(told, _way, "way array<int>")
    nodes = _by_key(ways, _entered, "way", "node int")

    def spell(s: bytes, start: list[int], end: list[int], least: int, last: bool, node: int) -> tuple:
        if last and node == 0 and tuple(start) == START:
            return s, edits(s)[1], node, least
        return s, spelled(s, node, tuple(start), tuple(end), least, last)[0], node, least

    return _mapped(told.join(nodes, _AT).select(*_AT, "symbols", "start", "end", "least", "last", "node"), spell, "symbols binary, letters string, node int, least bigint")


class _Fold:
    """What a conversation's blocks amount to, taken in order."""

    def __init__(self) -> None:
        self.hash, self.turns, self.letters = hashlib.sha256(), 0, []
        self.counts = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.distinct = self.least = 0

    def take(self, symbols: bytes, letters: str, least: int, turns: list[int | None], repaired: list[tuple[str, str]]) -> None:
        self.letters.append(letters)
        self.least = least
        for s in symbols:
            initial, fault = divmod(s, 4)
            self.counts[fault] += 1
            if self.initial is not None:
                self.illegal += (self.initial, initial) not in ((0, 1), (1, 2), (2, 1))
            self.initial = initial
        for t in turns:
            if t is not None:
                self.low = t if self.low is None else self.low
                self.distinct += t != self.high
                self.high = t
        for role, text in repaired:
            self.hash.update(f"{chr(10) * (self.turns > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.turns += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.counts[_BLANK], self.counts[_SEEN], self.counts[_UNFINISHED], self.illegal, self.least, "".join(self.letters), self.hash.hexdigest()


_FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _streamed(turns: DataFrame, rows: bool) -> DataFrame:
    """By conversation (``key``), either its audit or the rows of its repaired turns."""
    spark = turns.sparkSession
    small_batches(spark)
    blocks = _blocks(turns)
    ops = _edited(stored(_seen(blocks), "turn-symbols"))
    none = lambda kind: F.lit(None).cast(kind)
    told = ops.select(*_AT, F.lit(0).alias("second"), "symbols", "letters", "node", "least", none("array<bigint>").alias("turns"), none("array<string>").alias("roles"), none("array<string>").alias("texts"))
    said = blocks.select(*_AT, F.lit(1).alias("second"), none("binary").alias("symbols"), none("string").alias("letters"), none("int").alias("node"), none("bigint").alias("least"), "turns", "roles", "texts")
    ordered = told.unionByName(said).repartition(partitions(spark), "key").sortWithinPartitions(*_AT, "second")
    schema = "key string, place bigint, role string, text string" if rows else f"key string, {_FOUND}"
    arrow = _arrow_schema(spark, schema)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, op, out = None, _Fold(), None, []
        for batch in batches:
            for k in range(batch.num_rows):
                key, _, _, second, *rest = (c[k].as_py() for c in batch.columns)
                if not second:
                    op = rest[:4]
                    continue
                if key != now:
                    if now is not None and not rows:
                        out.append((now, *fold.row()))
                    now, fold = key, _Fold()
                symbols, letters, node, least = op
                repaired, _ = applied(letters, node, list(zip(rest[5], rest[6], strict=True)))
                if rows:
                    if repaired:
                        yield table([(key, fold.turns + i, *turn) for i, turn in enumerate(repaired)])
                    fold.turns += len(repaired)
                else:
                    fold.take(symbols, letters, least, rest[4], repaired)
                if len(out) >= 512:
                    yield table(out)
                    out = []
        if now is not None and not rows:
            out.append((now, *fold.row()))
        if out:
            yield table(out)

    return ordered.mapInArrow(run, schema)


def _keyed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(_key(F.col(conv)).alias("key"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def audited(turns: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation of ``every`` (default: of ``turns``).

    Null roles and texts count as one space; a null id is a conversation of its own. Rows are ordered by turn (null first), ties by role, then text;
    a repeated row has been seen earlier. A conversation without rows has zeros, no edits and the hash of nothing. Other columns aren't read.
    """
    ids = (turns if every is None else every).select(F.col(conv).alias("conv_id")).distinct()
    found = _streamed(_keyed(turns, conv, turn, role, text), False)
    joined = ids.withColumn("key", _key(F.col("conv_id"))).join(found, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, from place 0; conversations that lose all have none."""
    ids = turns.select(F.col(conv).alias("conv_id")).distinct().withColumn("key", _key(F.col("conv_id")))
    return spread_join(_streamed(_keyed(turns, conv, turn, role, text), True), ids, ["key"]).select("conv_id", "place", "role", "text")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with every twentieth row dropped, emptied, without stops, repeated, or made a user's, by a checksum of its place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    rows = turns.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")
