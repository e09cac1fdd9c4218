"""Conversation structure repair: least-cost edits that make the turns of a conversation follow a grammar.

Role initials must read ``(s?(ua)+)?``, an automaton of four states: nothing yet (0), after the system turn (1), after a user
turn (2), after an assistant turn (3). As in Wu and Manber's matching with errors, each turn has one bitset of automaton states for
each cost layer: the states from which the rest can be finished at that cost or less. A turn's layers come from those of the next
turn by table look-ups: keeping stays in the layer, re-roling, deleting and inserting move on by their cost. The first layer whose
set holds the start gives the cost. Going forward through the bitsets, always by the least letter that stays within the layer, gives
the least of the cheapest edit strings; the set of each turn says which letters do.

Turns are range-partitioned by conversation, turn, role and text, so the turns of one conversation may lie in many tasks. A task
cuts them into pieces of bounded size. A piece that is a whole conversation is repaired at once. For the others the layers give a
table of costs from state to state; tables of a conversation are added up from its end (its rows travel as one byte each), which
gives what must be reached behind each piece, and the pieces are then traced one after another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import small_batches, write_out

#: Costs of the edits; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A piece ends after so many turns or characters; so many cells of (piece, turn, layer) are held at once.
PIECE_TURNS, PIECE_CHARS, CELLS = 1024, 2_000_000, 16_000_000
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 30
S, U, A, OTHER = range(4)
CLEAN, GONE, CUT = range(3)  # what a fault means to the edits: none, must be deleted, truncated
#: Where the one legal role leads from each state, and its name.
MOVE, NEXT_ROLE = np.array([2, 2, 3, 2]), ("user", "user", "assistant", "user")
STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_SETS = np.arange(16)
#: States whose legal move (for BEFORE), or whose step by an initial (for KEPT), leads into a set.
BEFORE = sum((((_SETS >> MOVE[s]) & 1) << s for s in range(4))).astype(np.uint8)
KEPT = np.stack([sum(((((_SETS >> STEP[s, x]) & 1) << s) if STEP[s, x] >= 0 else 0 * _SETS for s in range(4))) for x in range(4)]).astype(np.uint8)


def later(sets: np.ndarray, cost: int) -> np.ndarray:
    """The layers moved on by ``cost``."""
    out = np.zeros_like(sets)
    if cost < sets.shape[1]:
        out[:, cost:] = sets[:, : sets.shape[1] - cost]
    return out


def with_insertions(sets: np.ndarray) -> np.ndarray:
    for _ in range(2):  # more than two turns inserted at one place lead round in a circle
        sets = sets | BEFORE[later(sets, INSERT)]
    return sets


def layers(symbols: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    """Bitsets (piece, turn, layer) of pieces with equally many turns: states from which what follows is finished at that cost or less.

    ``symbols`` holds 3 * initial + fault class; ``after`` what each state costs behind the last turn.
    """
    n, size = symbols.shape
    out = np.zeros((n, size + 1, width), dtype=np.uint8)
    ends = (after[:, :, None] <= np.arange(width)).astype(np.uint8) << np.arange(4, dtype=np.uint8)[None, :, None]
    out[:, size] = with_insertions(np.bitwise_or.reduce(ends, axis=1))
    for i in range(size - 1, -1, -1):
        following, initial, fault = out[:, i + 1], symbols[:, i] // 3, symbols[:, i] % 3
        here = later(following, DELETE)
        free = KEPT[initial[:, None], following] | BEFORE[later(following, REROLE)]
        here |= np.where((fault == CLEAN)[:, None], free, 0).astype(np.uint8)
        if (fault == CUT).any():
            here |= np.where((fault == CUT)[:, None], later(free, TRUNCATED), 0).astype(np.uint8)
        out[:, i] = with_insertions(here)
    return out


def first_layer(sets: np.ndarray, state: np.ndarray | int) -> np.ndarray:
    """The least layer whose set holds the state."""
    hit = (sets >> np.asarray(state, dtype=np.uint8).reshape(-1, 1)) & 1
    return np.where(hit.any(1), hit.argmax(1), NEVER)


def costs(symbols: np.ndarray) -> np.ndarray:
    """Costs (piece, state before, state behind) of pieces with equally many turns."""
    n, size = symbols.shape
    out = np.empty((n, 4, 4), dtype=np.int64)
    for t in range(4):
        after = np.full((n, 4), NEVER)
        after[:, t] = 0
        sets = layers(symbols, after, 2 * size + 21)[:, 0]
        for s in range(4):
            out[:, s, t] = first_layer(sets, s)
    return out


def traced(symbols: np.ndarray, after: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(cost, least audit, state behind) of pieces with equally many turns, from their entry states.

    Layers are added, twice as many each time, until the entry state of every piece is accepted.
    """
    n, size = symbols.shape
    cost, audit, left = np.zeros(n, dtype=np.int64), [""] * n, np.array(entry)
    base = after.min(1)
    pending, width = np.arange(n), 16
    while len(pending):
        sets = layers(symbols[pending], after[pending] - base[pending, None], width)
        found = first_layer(sets[:, 0], entry[pending])
        done = found < NEVER
        if done.any():
            at = pending[done]
            cost[at] = found[done] + base[at]
            letters, left[at] = _trace(symbols[at], sets[done], found[done], entry[at])
            for k, word in zip(at.tolist(), letters):
                audit[k] = word
        pending, width = pending[~done], width * 2
    return cost, audit, left


def _trace(symbols: np.ndarray, sets: np.ndarray, cost: np.ndarray, entry: np.ndarray) -> tuple[list[str], np.ndarray]:
    n, size = symbols.shape
    row, at, state, left, steps = np.arange(n), np.zeros(n, np.int64), entry.astype(np.int64), cost.astype(np.int64), []

    def holds(place, layer, wanted):
        good = (layer >= 0) & (wanted >= 0) & (place <= size)
        word = sets[row, np.minimum(place, size), np.maximum(layer, 0)]
        return good & ((word >> np.maximum(wanted, 0).astype(np.uint8)) & 1 == 1)

    while True:
        turn = symbols[row, np.minimum(at, size - 1)] if size else np.full(n, 3 * OTHER + GONE)
        initial, fault = turn // 3, turn % 3
        more, extra = at < size, np.where(fault == CUT, TRUNCATED, 0)
        ways = [
            (b"D", more & holds(at + 1, left - DELETE, state), state, DELETE, 1),
            (b"I", holds(at, left - INSERT, MOVE[state]), MOVE[state], INSERT, 0),
            (b"K", more & (fault != GONE) & holds(at + 1, left - extra, STEP[state, initial]), STEP[state, initial], extra, 1),
            (b"R", more & (fault != GONE) & holds(at + 1, left - extra - REROLE, MOVE[state]), MOVE[state], extra + REROLE, 1),
        ]
        letter, open_ = np.zeros(n, dtype="S1"), np.ones(n, dtype=bool)
        new_state, new_left, new_at = state.copy(), left.copy(), at.copy()
        for name, good, to, price, turns in ways:
            take = open_ & good
            letter[take], new_state[take] = name, to[take]
            new_left[take] = (left - price)[take]
            new_at[take] += turns
            open_ &= ~take
        if open_.all():  # nothing is left to do: all turns are read and the layer holds the state as it is
            break
        steps.append(letter)
        state, left, at = new_state, new_left, new_at
    words = np.stack(steps, axis=1) if steps else np.zeros((n, 0), dtype="S1")
    return [b"".join(w.tolist()).decode() for w in words], state


def edited(audit: str, state: int, turns: list) -> list:
    """The turns that an audit leaves, from the state before the first."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            out.append({"role": NEXT_ROLE[state], "text": ""})
            state = int(MOVE[state])
            continue
        turn, at = turns[at], at + 1
        if letter == "K":
            out.append(turn)
            state = int(STEP[state, initial_of(turn["role"])])
        elif letter == "R":
            out.append({"role": NEXT_ROLE[state], "text": turn["text"]})
            state = int(MOVE[state])
    return out


def initial_of(role: str) -> int:
    return {"s": S, "u": U, "a": A}.get(role[:1], OTHER)


def by_size(pieces: list):
    """Numbers of pieces with equally many turns, few enough for CELLS."""
    sizes: dict = {}
    for k, piece in enumerate(pieces):
        sizes.setdefault(len(piece), []).append(k)
    for size, found in sizes.items():
        step = max(1, CELLS // ((size + 1) * (2 * size + 21)))
        for a in range(0, len(found), step):
            yield found[a : a + step]


def symbols_of(pieces: list) -> np.ndarray:
    return np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(len(pieces), -1).astype(np.int64)


ENDS = np.array([0, NEVER, NEVER, 0])
_TURNS = "array<struct<role:string,text:string>>"
_FACTS = "turns_seen bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head int, tail int, low bigint, high bigint, kinds bigint"


def _faulty(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, fault, tie): fault 1 blank, 2 duplicate, 3 truncated; tie names rows whose first place is their own turn."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    name = F.col("conv").cast("string")
    mark = F.concat(F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-")), F.length("role").cast("string"), F.lit(":"), "role", "text")
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    plain = plain.withColumn("mark", F.when(end != "", F.unhex(F.sha2(mark.cast("binary"), 256)))).withColumn("cut", ~F.right(end, F.lit(1)).isin(".", "!", "?"))
    again = plain.where("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1").select("mark", "first")
    both = plain.join(again, "mark", "left")
    own = F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("mark").isNull(), 1).when(F.col("first").isNotNull() & ~own, 2).when(F.col("cut"), 3).otherwise(0)
    return both.select("conv", "turn", "role", "text", fault.cast("int").alias("fault"), F.when(F.col("first").isNotNull() & own, F.col("mark")).alias("tie"))


class _Piece:
    def __init__(self, conv, part: int, seq: int, fresh: bool):
        self.conv, self.part, self.seq, self.fresh, self.ended = conv, part, seq, fresh, False
        self.turns, self.symbols, self.numbers, self.faults, self.chars = [], bytearray(), [], [0, 0, 0, 0], 0

    def add(self, turn, role, text, fault) -> None:
        self.turns.append({"role": role, "text": text})
        self.symbols.append(3 * initial_of(role) + (CLEAN, GONE, GONE, CUT)[fault])
        self.numbers.append(turn)
        self.faults[fault] += 1
        self.chars += len(text)

    def facts(self) -> tuple:
        initials = [x // 3 for x in self.symbols]
        known = [x for x in self.numbers if x is not None]
        illegal = sum(not legal(x, y) for x, y in zip(initials, initials[1:]))
        return len(initials), *self.faults[1:], illegal, initials[0], initials[-1], known[0] if known else None, known[-1] if known else None, len(set(known))


def legal(first: int, second: int) -> bool:
    return (first, second) in ((S, U), (U, A), (A, U))


def pieces_of(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Pieces of conversations in order, written to the shared folder. ``turns`` are the repaired ones where ``whole``, else the given ones."""
    order = ["conv", "turn", "role", "text"]
    dealt = _faulty(rows, conv, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema[conv].dataType
    schema = f"conv {kind.simpleString()}, part bigint, seq bigint, whole boolean, {_FACTS}, cost bigint, audit string, symbols binary, costs array<bigint>, turns {_TURNS}"

    def run(batches):
        from pyspark import TaskContext

        part, seq, piece, held, last_tie, first_of_task = TaskContext.get().partitionId(), 0, None, [], None, True
        types = None

        def emit(held):
            whole = [p.fresh and p.ended for p in held]
            cost, audit, tables = [None] * len(held), [None] * len(held), [None] * len(held)
            for flag in (True, False):
                chosen = [k for k, w in enumerate(whole) if w == flag]
                for group in by_size([bytes(held[k].symbols) for k in chosen]):
                    group = [chosen[k] for k in group]
                    symbols = symbols_of([bytes(held[k].symbols) for k in group])
                    if flag:
                        found, words, _ = traced(symbols, np.tile(ENDS, (len(group), 1)), np.zeros(len(group), np.int64))
                        for k, c, w in zip(group, found.tolist(), words):
                            cost[k], audit[k] = c, w
                    else:
                        for k, table in zip(group, costs(symbols).reshape(len(group), 16).tolist()):
                            tables[k] = table
            rows = [(p.conv, p.part, p.seq, w, *p.facts(), c, a, None if w else bytes(p.symbols), t, edited(a, 0, p.turns) if w else p.turns) for p, w, c, a, t in zip(held, whole, cost, audit, tables)]
            return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), types)], schema=types)

        for batch in batches:
            if types is None:
                turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                whole_numbers = lambda *names: [(n, pa.int64()) for n in names]
                types = pa.schema([("conv", batch.schema.field(0).type), *whole_numbers("part", "seq"), ("whole", pa.bool_()), *whole_numbers("turns_seen", "blank", "duplicate", "truncated", "illegal"), ("head", pa.int32()), ("tail", pa.int32()), *whole_numbers("low", "high", "kinds", "cost"), ("audit", pa.string()), ("symbols", pa.binary()), ("costs", pa.list_(pa.int64())), ("turns", turns)])
            for conv, turn, role, text, fault, tie in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None or conv != piece.conv or len(piece.turns) >= PIECE_TURNS or piece.chars >= PIECE_CHARS:
                    if piece is not None:
                        piece.ended = conv != piece.conv
                        held.append(piece)
                        if sum(p.chars for p in held) >= PIECE_CHARS or len(held) >= PIECE_TURNS:
                            yield emit(held)
                            held = []
                    fresh = not first_of_task and (piece is None or conv != piece.conv)
                    piece, seq, first_of_task = _Piece(conv, part, seq, fresh), seq + 1, False
                if tie is not None and tie == last_tie:
                    fault = 2
                last_tie = tie
                piece.add(turn, role, text, fault)
        if piece is not None:
            held.append(piece)
        if held:
            yield emit(held)

    return write_out(dealt.mapInArrow(run, schema), "turns")[0]


def _joined_pieces(open_: DataFrame) -> DataFrame:
    """(part, seq, entry, audit) of the pieces of longer conversations, and on the first of each the facts and cost of the whole."""
    slim = open_.drop("turns", "whole", "cost", "audit").repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def settle(pieces: list) -> list:
        after, price = [ENDS], 0
        for p in reversed(pieces):
            after.append((np.array(p["costs"]).reshape(4, 4) + after[-1][None, :]).min(1))
            after[-1] = np.minimum(after[-1], NEVER)
        price, state, out = int(after.pop()[0]), 0, []
        for p in pieces:
            behind = after.pop()
            _, audit, left = traced(symbols_of([p["symbols"]]), behind[None, :], np.array([state]))
            out.append({"part": p["part"], "seq": p["seq"], "entry": state, "edits": audit[0]})
            state = int(left[0])
        total = {c: sum(p[c] for p in pieces) for c in ("turns_seen", "blank", "duplicate", "truncated", "illegal")}
        total["illegal"] += sum(not legal(a["tail"], b["head"]) for a, b in zip(pieces, pieces[1:]))
        known = [p for p in pieces if p["low"] is not None]
        kinds = sum(p["kinds"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        out[0] |= total | {"low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None, "kinds": kinds, "cost": price}
        return out

    def run(batches):
        held, empty = [], pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("entry", pa.int32()), ("edits", pa.string()), *[(c, pa.int64()) for c in ("turns_seen", "blank", "duplicate", "truncated", "illegal", "low", "high", "kinds", "cost")]])
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv"] != held[0]["conv"]:
                    yield pa.RecordBatch.from_pylist(settle(held), schema=empty)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(settle(held), schema=empty)

    return slim.mapInArrow(run, "part bigint, seq bigint, entry int, edits string, turns_seen bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, kinds bigint, cost bigint")


def repaired_pieces(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns, in pieces: conv, part, seq (their order), audit, turns (role, text); facts on the first piece of each conversation."""
    pieces = pieces_of(rows, conv, turn, role, text)
    facts = ["turns_seen", "blank", "duplicate", "truncated", "illegal", "low", "high", "kinds", "cost"]
    whole = pieces.where("whole").select("conv", "part", "seq", "audit", *facts, "turns")
    open_ = pieces.where("NOT whole")
    settled = write_out(_joined_pieces(open_), "audits")[0]
    both = open_.select("conv", "part", "seq", "turns").join(settled, ["part", "seq"])

    def run(batches):
        for batch in batches:
            turns = [edited(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("audit", "entry", "turns")))]
            kept = batch.drop_columns(["entry", "turns"])
            field = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(turns, field)], names=[*kept.schema.names, "turns"])

    kind = rows.schema[conv].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in facts)
    rest = both.select("conv", "part", "seq", F.col("edits").alias("audit"), *facts, "entry", "turns").mapInArrow(run, f"conv {kind}, part bigint, seq bigint, audit string, {numbers}, turns {_TURNS}")
    return whole.unionByName(rest)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    The first fault of a turn counts: blank, then duplicate (role and text seen earlier), then truncated. ``audit`` is the least of the
    cheapest edit strings (D, I, K, R), ``repaired_sha256`` the digest of the repaired turns as ``role:text`` lines.

    * Null roles and texts are one space; null turns come first and do not count in ``gaps``; a null conversation is one of its own.
    * Empty and blank texts must be deleted. A conversation of any length is repaired whole: its pieces in many tasks, one byte
      a turn in the task that joins them, and its text as a stream through the task that hashes it (a digest has no other way).
    * Ties: turns of one number follow each other by role and text; of equal rows the first is no duplicate.
    * An empty table gives an empty result. A role that begins with none of s, u, a can only be changed or deleted.
    * Other columns are not read, so their names cannot clash.
    """
    pieces = repaired_pieces(rows, conv, turn, role, text).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        conv, first, audit, digest, empty, types = None, None, [], None, True, None

        def done():
            gaps = 0 if first["low"] is None else first["high"] - first["low"] + 1 - first["kinds"]
            row = {"conv": conv, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | {c: first[c] for c in names[1:]}
            return pa.RecordBatch.from_pylist([row], schema=types)

        for batch in batches:
            types = types or pa.schema([("conv", batch.schema.field(0).type), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if first is None or row["conv"] != conv:
                    if first is not None:
                        yield done()
                    conv, first, audit, digest, empty = row["conv"], row, [], hashlib.sha256(), True
                audit.append(row["audit"])
                for x in row["turns"]:
                    digest.update(("" if empty else "\n").encode() + f"{x['role']}:{x['text']}".encode())
                    empty = False
        if first is not None:
            yield done()

    kind = rows.schema[conv].dataType.simpleString()
    found = pieces.mapInArrow(run, f"conv {kind}, {', '.join(f'{c} bigint' for c in names)}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv", conv)


def damage(rows: DataFrame) -> DataFrame:
    """The conversations table with faults: by crc32(conv_id:turn) % 20 turns go, lose text or stops, repeat or change their role."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(part("role"))
    left = rows.withColumn("kind", kind).where("kind <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    both = every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
