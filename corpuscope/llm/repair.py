"""Conversation structure repair: the cheapest edits by iterative-deepening A*, in ASCII order of the edits.

A conversation is repaired to an optional system turn and pairs of a user and an assistant turn by
keeping, deleting, reroling and inserting turns. The search goes depth first through the edits in ASCII order,
under a cost bound that rises to the least cost that the last round exceeded; a table of failed states holds
what each was found to cost at least. The first path that is accepted is the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.registry import query, table
from corpuscope.llm.running import running_totals
from corpuscope.session import shuffle_partitions, stored

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that are searched together; longer conversations are searched in pieces that are put together.
SEGMENT = 256

# states of the role pattern (s?(ua)+)?: nothing yet, after s, after u, after a
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = 4
_ACCEPTED = (_START, _ASSISTANT)
#: Where a turn of the role that is wanted leads; from the start that is a user's.
_WANTED = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = 1 << 60


@dataclass(frozen=True)
class Turn:
    """What the search sees of a turn: the initial of its role, whether it must go, what it costs if it stays."""

    initial: str
    lost: bool = False
    extra: int = 0

    def kept(self, state: int) -> int | None:
        """The state after keeping the turn, if the pattern allows it."""
        if state == _START and self.initial == "s":
            return _SYSTEM
        following = _WANTED[state]
        return following if self.initial == _ROLES[following][0] else None


def _at_least(turns: Sequence[Turn]) -> list[int]:
    """For each suffix a cost that no repair of it undercuts.

    A turn that must go costs a deletion, a truncated one that at least, one of an unknown role a rerole;
    of two neighbours of the same role, once what must go is gone, one has to change or
    something has to come between.
    """
    least = [0] * (len(turns) + 1)
    following, between = -1, 0  # the next turn that may stay, and what must go before it
    for i in range(len(turns) - 1, -1, -1):
        turn = turns[i]
        if turn.lost:
            least[i] = least[i + 1] + DELETE
            between += DELETE
            continue
        if turn.extra:
            least[i] = least[i + 1] + min(DELETE, turn.extra)
        elif turn.initial not in ("s", "u", "a"):
            least[i] = least[i + 1] + min(REROLE, DELETE)
        else:
            least[i] = least[i + 1]
            if following >= 0 and not turns[following].extra and turns[following].initial == turn.initial:
                least[i] = max(least[i], REROLE + between + least[following + 1])
        following, between = i, 0
    return least


class Search:
    """Cheapest edits of some turns, from any state to the end of the pattern or to one state at the border of a piece.

    At a border nothing is inserted after the last turn, so edits of neighbouring pieces divide in one way only.
    """

    def __init__(self, turns: Sequence[Turn], goal: int | None = None):
        self._turns, self._goal = turns, goal
        size = len(turns)
        least = _at_least(turns)
        # what each state costs at least; raised as searches fail
        self._least = [bound for bound in least for _ in range(_STATES)]
        if goal is None:
            self._least[size * _STATES :] = [0, 2 * INSERT, INSERT, 0]
            return
        self._least[size * _STATES :] = [0 if state == goal else _FAR for state in range(_STATES)]
        if goal in (_START, _SYSTEM):  # no way back to them
            systems = False
            for i in range(size - 1, -1, -1):
                systems = systems or (turns[i].initial == "s" and not turns[i].lost)
                self._least[i * _STATES + _USER] = self._least[i * _STATES + _ASSISTANT] = _FAR
                if goal == _START:
                    self._least[i * _STATES + _SYSTEM] = _FAR
                elif not systems:
                    self._least[i * _STATES + _START] = _FAR

    def _edits(self, node: int) -> list[tuple[str, int, int]]:
        """Edit, cost and next node, in ASCII order of the edits."""
        i, state = divmod(node, _STATES)
        inserted = ("I", INSERT, i * _STATES + _WANTED[state])
        if i == len(self._turns):
            return [inserted] if self._goal is None else []
        turn = self._turns[i]
        edits = [("D", DELETE, node + _STATES), inserted]
        if not turn.lost:
            kept = turn.kept(state)
            if kept is not None:
                edits.append(("K", turn.extra, (i + 1) * _STATES + kept))
            edits.append(("R", REROLE + turn.extra, (i + 1) * _STATES + _WANTED[state]))
        return edits

    def _accepted(self, node: int) -> bool:
        i, state = divmod(node, _STATES)
        return i == len(self._turns) and (state in _ACCEPTED if self._goal is None else state == self._goal)

    def _within(self, root: int, bound: int) -> str | None:
        """The first accepted edits that cost no more than the bound; what fails is remembered."""
        least = self._least
        path: list[str] = []
        # node, cost so far, edits left (last first), the least that was exceeded below
        stack = [[root, 0, self._edits(root)[::-1], _FAR]]
        while stack:
            node, spent, edits, over = stack[-1]
            if self._accepted(node):
                return "".join(path)
            if edits:
                edit, cost, following = edits.pop()
                if spent + cost + least[following] <= bound:
                    path.append(edit)
                    stack.append([following, spent + cost, self._edits(following)[::-1], _FAR])
                else:
                    stack[-1][3] = min(over, cost + least[following])
                continue
            least[node] = max(least[node], over)
            stack.pop()
            if stack:
                path.pop()
                above = stack[-1]
                above[3] = min(above[3], spent - above[1] + least[node])
        return None

    def cheapest(self, state: int) -> tuple[int, str] | None:
        """The least cost from a state at the first turn, and the ASCII-least edits of that cost; None if no edits do."""
        while self._least[state] < _FAR:
            bound = self._least[state]
            edits = self._within(state, bound)
            if edits is not None:
                return bound, edits
        return None


def replayed(turns: Sequence[tuple[str, str]], edits: str, state: int = _START) -> Iterator[str]:
    """The turns that some edits leave, as ``role:text``."""
    rest = iter(turns)
    for edit in edits:
        following = _WANTED[state]
        if edit == "I":
            yield f"{_ROLES[following]}:"
        else:
            role, text = next(rest)
            if edit == "D":
                continue
            if edit == "R":
                role = _ROLES[following]
            elif state == _START and role[:1] == "s":
                following = _SYSTEM
            yield f"{role}:{text}"
        state = following


_WHITE = "".join(map(chr, [32, *range(9, 14)]))
_ENDS = (".", "!", "?")


def _blank(text: str) -> bool:
    return not text.strip(_WHITE)


def _truncated(text: str) -> bool:
    return not text.rstrip(_WHITE).endswith(_ENDS)


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


_KEYED = "seg long, place long, role string, text string, first_seg long, last_seg long, marks array<long>, choice int, edits string"
_PIECE = (
    "seg long, whole boolean, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, costs array<long>, ranks array<int>, audits array<string>, repaired_sha256 string"
)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """The head row of each piece, and its turns (at most SEGMENT)."""
    head: dict | None = None
    turns: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["place"] < 0:
                if head is not None:
                    yield head, turns
                head, turns = row, []
            else:
                turns.append(row)
    if head is not None:
        yield head, turns


def _faults(turns: list[dict], repeated: set[int]) -> tuple[list[Turn], list[int]]:
    seen, counts = [], [0, 0, 0]
    for row in turns:
        initial = row["role"][:1]
        if _blank(row["text"]):
            kind, turn = 0, Turn(initial, lost=True)
        elif row["place"] in repeated:
            kind, turn = 1, Turn(initial, lost=True)
        elif _truncated(row["text"]):
            kind, turn = 2, Turn(initial, extra=TRUNCATED)
        else:
            kind, turn = None, Turn(initial)
        if kind is not None:
            counts[kind] += 1
        seen.append(turn)
    return seen, counts


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    out: list[dict] = []
    for batch in _peeked(batches):
        if isinstance(batch, pa.Schema):
            schema = _output_schema(batch, _PIECE)
            continue
        head, turns = batch
        seen, counts = _faults(turns, set(head["marks"] or ()))
        first, last = head["seg"] == head["first_seg"], head["seg"] == head["last_seg"]
        entries = [_START] if first else range(_STATES)
        costs: list[int | None] = [None] * (_STATES * _STATES)
        audits: list[str | None] = [None] * (_STATES * _STATES)
        for goal in [None] if last else range(_STATES):
            search = Search(seen, goal)
            for entry in entries:
                answer = search.cheapest(entry)
                if answer is not None:
                    costs[entry * _STATES + (goal or 0)], audits[entry * _STATES + (goal or 0)] = answer
        order = sorted(range(len(audits)), key=lambda i: audits[i] or "")
        ranks = [0] * len(order)
        for rank, i in enumerate(order):
            ranks[i] = rank
        digest = None
        if first and last:
            plain = [(row["role"], row["text"]) for row in turns]
            digest = hashlib.sha256("\n".join(replayed(plain, audits[0])).encode()).hexdigest()
        initials = [t.initial for t in seen]
        out.append(
            {
                "conv_id": head["conv_id"], "seg": head["seg"], "whole": first and last,
                "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": _illegal(initials),
                "head": initials[0], "tail": initials[-1], "costs": costs, "ranks": ranks, "audits": audits,
                "repaired_sha256": digest,
            }
        )
        if len(out) >= 256:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _peeked(batches: Iterator[pa.RecordBatch]) -> Iterator:
    """The schema of the batches, then their groups."""

    def told() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen.append(batch.schema)
            yield batch

    seen: list[pa.Schema] = []
    for group in _groups(told()):
        if len(seen) > 0 and seen[0] is not None:
            yield seen[0]
            seen[0] = None
        yield group


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _output_schema(given: pa.Schema, fields: str) -> pa.Schema:
    """An output schema that begins with the conversation's own type."""
    found = [given.field("conv_id")]
    for field in fields.split(", "):
        name, kind = field.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        found.append(pa.field(name, pa.list_(_ARROW[inner]) if kind != inner else _ARROW[inner]))
    return pa.schema(found)


_CHOICES = "seg long, entry int, exit int, border long, cost long"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How the pieces of each conversation, last one first, are put together: entry and exit of every piece.

    Keeps four small numbers for each piece. ``border`` counts a forbidden pair of initials at the end
    of a piece, ``cost`` is that of the whole conversation, on its first piece.
    """
    conv: tuple = ()
    pieces: list[tuple[int, bytes, int]] = []  # number, exit for each entry, forbidden pair
    ahead: list[int | None] = []
    after = ""
    schema = None

    def flush() -> Iterator[pa.RecordBatch]:
        state, total, rows = _START, ahead[_START], []
        for seg, exits, border in reversed(pieces):
            rows.append({"conv_id": conv[0], "seg": seg, "entry": state, "exit": exits[state], "border": border, "cost": total})
            state, total = exits[state], 0
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        schema = schema or _output_schema(batch.schema, _CHOICES)
        for row in batch.to_pylist():
            if (row["conv_id"],) != conv:
                if pieces:
                    yield from flush()
                conv, pieces, ahead, after = (row["conv_id"],), [], [0, None, None, None], ""
                last = True
            else:
                last = False
            best: list[int | None] = [None] * _STATES
            exits = [0] * _STATES
            for entry in range(_STATES):
                options = []
                for leave in range(1 if last else _STATES):
                    cost = row["costs"][entry * _STATES + leave]
                    rest = 0 if last else ahead[leave]
                    if cost is not None and rest is not None:
                        options.append((cost + rest, row["ranks"][entry * _STATES + leave], leave))
                if options:
                    best[entry], _, exits[entry] = min(options)
            border = int(not last and row["tail"] + after not in ("su", "ua", "au"))
            pieces.append((row["seg"], bytes(exits), border))
            ahead, after = best, row["head"]
    if pieces:
        yield from flush()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the chosen edits leave of each piece."""
    schema = None
    for group in _peeked(batches):
        if isinstance(group, pa.Schema):
            schema = _output_schema(group, "seg long, edits string, body binary")
            continue
        head, turns = group
        left = list(replayed([(row["role"], row["text"]) for row in turns], head["edits"], head["choice"]))
        body = "\n".join(left).encode() if left else None
        yield pa.RecordBatch.from_pylist(
            [{"conv_id": head["conv_id"], "seg": head["seg"], "edits": head["edits"], "body": body}], schema
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of each conversation, from its pieces in order."""
    conv: tuple = ()
    edits: list[str] = []
    digest, any_left = hashlib.sha256(), False
    schema = None

    def done() -> pa.RecordBatch:
        row = {"conv_id": conv[0], "audit": "".join(edits), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        schema = schema or _output_schema(batch.schema, "audit string, repaired_sha256 string")
        for row in batch.to_pylist():
            if (row["conv_id"],) != conv:
                if conv:
                    yield done()
                conv, edits, digest, any_left = (row["conv_id"],), [], hashlib.sha256(), False
            edits.append(row["edits"])
            if row["body"] is not None:
                digest.update(b"\n" + row["body"] if any_left else row["body"])
                any_left = True
    if conv:
        yield done()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, which a checksum of ``conv_id:turn`` decides: dropped, emptied, cut, repeated or reroled.

    A null role or text becomes one space, and so do nulls in the checksum's text.
    """
    space = F.lit(" ")
    plain = conversations.select(
        "conv_id",
        "turn",
        *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")),
        F.pmod(
            F.crc32(
                F.concat_ws(
                    ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
                )
            ),
            F.lit(20),
        ).alias("_lot"),
    )
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_lot") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_lot") == 3, 2).otherwise(1)
    return plain.filter("_lot <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_time")
    ).drop("_time")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``everyone`` (``conv_id``), from its ``rows``.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` without nulls in role and text. A conversation's rows stand by turn,
    nulls first; rows of one turn by role and text. The first fault of a row counts: blank (no sign but white
    space), duplicate (role and text seen earlier in the conversation), truncated (the last sign is no ``.!?``).

    Columns: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours
    whose initials are not su, ua or au), ``cost``, ``audit`` (initials of the edits: delete, insert, keep, rerole) and
    ``repaired_sha256``. A null id is a conversation of its own; one without rows has zeros, an empty
    audit and the digest of an empty string. Rows of roles beyond the three can be reroled or
    deleted only. Extra columns are left aside, empty tables give no rows.

    The rows get a global order and are cut into pieces of ``SEGMENT`` rows, so a conversation may be of any length: a piece
    is searched from each state to each, and what the pieces cost is put together from the last to the first.
    Edits of two exits of a piece differ before either ends, so the ASCII order of the whole is that of
    the first piece they differ in. Only the digest of a long conversation passes through one task, piece
    after piece, since a hash has an order.
    """
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = stored(
        running_totals(rows.select("conv_id", "turn", "role", "text"), order, []).select(
            "conv_id", "turn", "role", "text",
            F.floor(F.col("row_index") / SEGMENT).cast("long").alias("seg"), F.col("row_index").alias("place"),
        ),
        "turns",
    )
    turns = placed.groupBy("conv_id", "turn").agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
    facts = turns.groupBy("conv_id").agg(
        F.min("low").alias("first_seg"), F.max("high").alias("last_seg"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    facts = stored(facts, "facts")
    digest = placed.select("conv_id", "seg", "place", "role", F.sha2("text", 256).alias("text"))
    firsts = digest.groupBy("conv_id", "role", "text").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    crowds = firsts.filter("n > 1").select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text", "place")))
    repeated = digest.join(
        crowds,
        _same(F.col("conv_id"), F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text")),
    )
    marks = repeated.filter("place > _place").groupBy("conv_id", "seg").agg(F.collect_list("place").alias("marks"))
    marks = marks.select(F.col("conv_id").alias("_conv_id"), F.col("seg").alias("_seg"), "marks")  # SEGMENT at most

    pieces = facts.select("conv_id", "first_seg", "last_seg", F.explode(F.sequence("first_seg", "last_seg")).alias("seg"))
    pieces = pieces.join(marks, _same(F.col("conv_id"), F.col("_conv_id")) & (F.col("seg") == F.col("_seg")), "left")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def keyed(df: DataFrame) -> DataFrame:
        fields = [f.split(" ") for f in _KEYED.split(", ")]
        missing = [F.lit(None).cast(t).alias(n) for n, t in fields if n not in df.columns]
        return df.select("*", *missing).select("conv_id", *(n for n, _ in fields))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "conv_id", "seg").sortWithinPartitions("conv_id", "seg", "place")

    heads = keyed(pieces.select("conv_id", "seg", F.lit(-1).cast("long").alias("place"), "first_seg", "last_seg", "marks"))
    searched = dealt(heads.union(keyed(placed))).mapInArrow(_searched, f"conv_id {kind}, {_PIECE}")
    searched = stored(searched, "searched")
    counts = ("blank", "duplicate", "truncated", "illegal")
    whole = searched.filter("whole").select(
        "conv_id", *counts, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), "repaired_sha256"
    )

    cut = searched.filter("not whole")
    ordered = cut.select("conv_id", "seg", "head", "tail", "costs", "ranks").repartition(parts, "conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", F.col("seg").desc())
    chosen = stored(ordered.mapInArrow(_chained, f"conv_id {kind}, {_CHOICES}"), "chosen")
    choices = chosen.select(F.col("conv_id").alias("_conv_id"), F.col("seg").alias("_seg"), "entry", "exit", "border", "cost")
    cut = cut.drop("repaired_sha256").join(choices, _same(F.col("conv_id"), F.col("_conv_id")) & (F.col("seg") == F.col("_seg")))
    edits = F.get("audits", (F.col("entry") * _STATES + F.col("exit")).cast("int"))
    told = keyed(cut.select("conv_id", "seg", F.lit(-1).cast("long").alias("place"), F.col("entry").alias("choice"), edits.alias("edits")))
    long_ones = facts.filter("first_seg < last_seg").select(F.col("conv_id").alias("_conv_id"))
    theirs = keyed(placed.join(long_ones, _same(F.col("conv_id"), F.col("_conv_id")), "left_semi"))
    bodies = dealt(told.union(theirs)).mapInArrow(_pieces, f"conv_id {kind}, seg long, edits string, body binary")
    bodies = bodies.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seg")
    digests = bodies.mapInArrow(_digests, f"conv_id {kind}, audit string, repaired_sha256 string")
    sums = cut.groupBy("conv_id").agg(
        *(F.sum(F.col(c) + F.col("border") if c == "illegal" else F.col(c)).alias(c) for c in counts), F.sum("cost").alias("cost")
    )
    sums = sums.withColumnRenamed("conv_id", "_conv_id")
    put_together = digests.join(sums, _same(F.col("conv_id"), F.col("_conv_id"))).select(*whole.columns)

    results = whole.union(put_together)
    results = results.withColumnRenamed("conv_id", "_result_id")
    gaps = facts.select(F.col("conv_id").alias("_facts_id"), "gaps")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        everyone.select("conv_id").distinct()
        .join(results, _same(F.col("conv_id"), F.col("_result_id")), "left")
        .join(gaps, _same(F.col("conv_id"), F.col("_facts_id")), "left")
        .select(
            "conv_id",
            *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts, "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )


@query("op12_repair_conversations")
def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)
