"""Repair of the turn structure of conversations by an auction shortest-path algorithm.

A conversation is sound if its role initials read ``(s?(ua)+)?``. Rows are kept, given another role or deleted, and empty
rows are put in, at the least cost; of equally cheap repairs the one whose letters sort first is taken. The edits form a
lattice: a node is (rows passed, where the pattern stands), an arc an edit.

The auction algorithm keeps a price for each node and one path from the origin. At the path's end it either raises the
node's price to the cheapest arc plus the price behind it and takes the node back (contraction), or goes on along that arc
(extension). Costs are whole numbers, so prices are exact when the path arrives: an arc lies on a cheapest repair if it is
tight (its price falls by just its cost) and tight arcs lead on to the end. The letters are read off those.

Long conversations are cut into blocks of ``BLOCK`` rows. The blocks are solved from the last to the first, each with the
prices of the next as the costs of its exits, which is exact and keeps the work in proportion to the rows.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyseries.llm.frames import by_bytes

#: Costs of the edits, and what a kept or re-roled row with a cut-off text adds.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Rows that are solved at a time.
BLOCK = 12
#: Longer conversations are not remembered.
REMEMBERED_ROWS, REMEMBERED = 48, 100_000
#: Bytes of text of an output batch.
BATCH_BYTES = 1 << 20

# Where the pattern stands: at its start, after s, after u, after a. It may end at the start and after a.
_START, _S, _U, _A = range(4)
_ENDS = {_START: 0, _A: 0}
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}
_NAMES = {_U: "user", _A: "assistant"}
_INITIALS = {"s": _S, "u": _U, "a": _A}

_BLANK, _MARK = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _arcs(rows: bytes, exits: dict[int, int], last: bool) -> list[list[tuple[str, int, int]]]:
    """Per node (4 * rows passed + state) its arcs (letter, cost, target), by letter; the end is the last node."""
    end = 4 * len(rows) + 4
    arcs = []
    for i in range(len(rows) + 1):
        for state in range(4):
            here = []
            follow = _NEXT[state]
            if i < len(rows):
                row = chr(rows[i])
                here.append(("D", DELETE, 4 * i + 4 + state))
                if row != "x":
                    extra = CUT_OFF if row.isupper() else 0
                    own = _INITIALS.get(row.lower())
                    if own == follow or own == _S and state == _START:
                        here.append(("K", extra, 4 * i + 4 + own))
                    here.append(("R", REROLE + extra, 4 * i + 4 + follow))
            elif state in exits:
                here.append(("", exits[state], end))
            if last or i < len(rows):
                here.append(("I", INSERT, 4 * i + follow))
            arcs.append(sorted(here))
    return arcs


def _auction(arcs: list[list[tuple[str, int, int]]], origins) -> list[int]:
    """Prices after an auction from each origin; those of the origins, and of all nodes on cheapest paths, are exact."""
    end = len(arcs)
    price = [0] * (end + 1)
    for origin in origins:
        path = [origin]
        while path[-1] != end:
            node = path[-1]
            least, target = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)
    return price


def _open(arcs: list, price: list[int]) -> list[bool]:
    """Nodes from which tight arcs lead to the end."""
    found = [False] * len(arcs) + [True]
    for first in range(len(arcs) - 4, -1, -4):
        # Inside a layer, arcs go from the start or s to u and between u and a.
        for _ in range(3):
            for node in range(first, first + 4):
                found[node] = found[node] or any(found[to] and price[node] == cost + price[to] for _, cost, to in arcs[node])
    return found


def _solve(rows: bytes) -> tuple[int, str]:
    blocks = [rows[a: a + BLOCK] for a in range(0, len(rows), BLOCK)] or [b""]
    exits, before, total = _ENDS, [], 0
    for block in reversed(blocks):
        before.append((block, exits))
        price = _auction(_arcs(block, exits, exits is _ENDS), range(4))
        # Only differences matter further on, and small prices are found sooner.
        least = min(price[:4])
        total += price[0] if len(before) == len(blocks) else least
        exits = {state: price[state] - least for state in range(4)}
    letters, state = [], _START
    for block, exits in reversed(before):
        arcs = _arcs(block, exits, exits is _ENDS)
        end = len(arcs)
        price = _auction(arcs, [state])
        tight = _open(arcs, price)
        node = state
        while node != end:
            letter, _, to = next(a for a in arcs[node] if tight[a[2]] and price[node] == a[1] + price[a[2]])
            letters.append(letter)
            node, state = to, node % 4
    return total, "".join(letters)


_remembered = lru_cache(REMEMBERED)(_solve)


def cheapest(rows: bytes) -> tuple[int, str]:
    """Cost and letters (Delete, Insert, Keep, Rerole) of the cheapest repair, of equal ones the first by letters.

    One letter per row: its role's initial s, u or a, else o; a capital if its text is cut off; x if it has to go.
    """
    return _remembered(rows) if len(rows) <= REMEMBERED_ROWS else _solve(rows)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): faults put in by a hash of ``conv_id:turn``; nulls count as one space in texts.

    Of twenty hashes, 0 drops the row (it stays with ``present`` false), 1 empties its text, 2 takes out its ``.!?``, 3
    repeats it, 4 makes it the user's. Further columns do not matter.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def _faults(row_of_text: Column) -> Column:
    return F.when(~F.col("text").rlike(_BLANK), F.lit("b")).when(row_of_text > 1, F.lit("d")).when(~F.col("text").rlike(_MARK), F.lit("t")).otherwise(F.lit("k"))


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns of (conv_id, turn, role, text): (conv_id, place, edit, turn, role, text) and a summary.

    Place 0 of a conversation holds its summary: ``gaps`` in the numbers of its turns; ``blank``, ``duplicate`` (role and
    text seen earlier) and ``truncated`` rows, each by its first fault; ``illegal`` neighbours; ``cost`` and letters
    (``audit``) of the cheapest repair. Places from 1 on are the turns kept, re-roled or put in, in order; inserted ones
    have an empty text and no number. Rows are ordered by turn (nulls first), then role and text; nulls in role and text
    are one space. Rows whose column ``present`` is false only name their conversation; an empty one has zeros, an empty
    audit and no turns. A null conv_id is a conversation too. Other columns are left out.

    One shuffle, by conversation. A conversation comes twice: first a letter for each row, from which the repair follows,
    then its texts, which pass by one after the other; only the letters are held, as the audit has one for each row too.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"), present.alias("present"))
    # Equal rows may tie in their place; the later place is the copy.
    same = Window.partitionBy("conv_id", "present", "role", F.sha2("text", 256)).orderBy("at")
    # Absent rows come first, so they are nobody's neighbours.
    whole = Window.partitionBy("conv_id").orderBy("present", F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"at": F.row_number().over(whole), "pair": F.concat(F.lag(F.when(F.col("present"), initial)).over(whole), initial)})
    rows = rows.withColumn("fault", _faults(F.row_number().over(same)))
    known = F.when(initial.isin(*_INITIALS), initial).otherwise(F.lit("o"))
    sign = F.when(F.col("fault").isin("b", "d"), F.lit("x")).when(F.col("fault") == "t", F.upper(known)).otherwise(known)
    illegal = F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))
    none = F.lit(None).cast("string")
    # First all signs of a conversation, then all its texts.
    both = F.array(F.struct(F.lit(0).alias("pass"), none.alias("own")), F.struct(F.lit(1).alias("pass"), F.col("text").alias("own")))
    parts = rows.select(
        "conv_id", "at", "turn", "present", "fault", "role", F.when(F.col("present"), sign).alias("sign"), illegal.alias("illegal"),
        F.inline(F.when(F.col("present"), both).otherwise(F.slice(both, 1, 1))),
    )
    stream = parts.sortWithinPartitions("conv_id", "pass", "at").select("conv_id", "pass", "turn", "role", "own", "fault", "sign", "illegal")
    return stream.mapInArrow(_repair, f"conv_id bigint, place bigint, edit string, turn bigint, role string, text string, {SUMMARY}")


class _Conversation:
    """What is held of one conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.signs = conv_id, bytearray()
        self.counts = dict.fromkeys("kbdt", 0)
        self.illegal = self.distinct = 0
        self.first = self.last = None
        self.letters, self.at, self.place, self.state = None, 0, 0, _START

    def sign(self, turn, fault, sign, illegal) -> None:
        if sign is None:
            return
        self.signs.append(ord(sign))
        self.counts[fault] += 1
        self.illegal += illegal
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1

    def summary(self) -> tuple:
        cost, self.letters = cheapest(bytes(self.signs))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        blank, duplicate, truncated = (self.counts[c] for c in "bdt")
        return (self.conv_id, 0, None, None, None, None, gaps, blank, duplicate, truncated, self.illegal, cost, self.letters)

    def _turn(self, edit, turn, role, text) -> tuple:
        self.place += 1
        return (self.conv_id, self.place, edit, turn, role, text, *[None] * 7)

    def inserted(self):
        while self.letters[self.at: self.at + 1] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            yield self._turn("I", None, _NAMES[self.state], "")

    def row(self, turn, role, text):
        yield from self.inserted()
        edit, self.at = self.letters[self.at], self.at + 1
        if edit == "K":
            self.state = _INITIALS[role[0]]
            yield self._turn("K", turn, role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield self._turn("R", turn, _NAMES[self.state], text)


def _results(batches):
    now = None

    def ended():
        if now is not None:
            if now.letters is None:
                yield now.summary()
            yield from now.inserted()

    for batch in by_bytes(batches, "own"):
        for conv_id, second, turn, role, text, fault, sign, illegal in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or conv_id != now.conv_id:
                yield from ended()
                now = _Conversation(conv_id)
            if not second:
                now.sign(turn, fault, sign, illegal)
            else:
                if now.letters is None:
                    yield now.summary()
                yield from now.row(turn, role, text)
    yield from ended()


_OUT = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
    *[(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in SUMMARY.split(", ")],
])


def _batched(rows, schema: pa.Schema):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _repair(batches):
    yield from _batched(_results(batches), _OUT)


_DIGEST = pa.schema([_OUT.field("conv_id"), *[f for f in _OUT if f.name in SUMMARY.replace(",", "").split()], pa.field("repaired_sha256", pa.string())])


def _digest(batches):
    def rows():
        head = sha = None
        for batch in by_bytes(batches, "text"):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[1] == 0:
                    if head is not None:
                        yield (*head, sha.hexdigest())
                    head, sha = (row[0], *row[6:]), hashlib.sha256()
                else:
                    sha.update((("\n" if row[1] > 1 else "") + f"{row[4]}:{row[5]}").encode())
        if head is not None:
            yield (*head, sha.hexdigest())

    yield from _batched(rows(), _DIGEST)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`: its summary and the SHA-256 of its ``role:text`` lines, joined by newlines.

    It reads the rows as `repaired` leaves them, conversation by conversation, with no shuffle in between.
    """
    return turns.mapInArrow(_digest, f"conv_id bigint, {SUMMARY}, repaired_sha256 string")
