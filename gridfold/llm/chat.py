"""Chat formatting with minimum-cost role repair.

A legal conversation is: at most one system turn, then user and assistant turns by turns, ending with the
assistant. Each input turn keeps its role or gets another, opens a turn or merges into the open one, and
empty turns may be inserted before it and at the end; dynamic programming over the automaton's states picks
the cheapest way. Turns are range-partitioned by conversation and turn, so a conversation of any length
may lie across partitions: a first pass reduces each partition's border pieces to 4 x 4 tables of
least costs, the driver (two rows for each partition) fixes the states at the borders, and a second pass
repairs every piece between its fixed states. The rendered output has one row for each repaired turn piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import checkpointed, table

#: Costs of the repairs.
MERGE, RELABEL, NAME_UNKNOWN, INSERT = 1, 3, 1, 2
#: States of the automaton: nothing yet, or the role of the open turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: Other names of the three roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
#: Which role may open a turn after which state.
NEXT = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
NO_CONVERSATION = -(1 << 63)
#: Characters of rendered text in an output batch.
MOST_CHARS = 1 << 21
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _inserted(state: int, role: int) -> list[int] | None:
    """Roles of the empty turns that must stand between ``state`` and a new turn of ``role``; None: impossible."""
    paths: list[list[int]] = [[]]
    for _ in range(3):
        for path in paths:
            if role in NEXT[path[-1] if path else state]:
                return path
        paths = [[*path, r] for path in paths for r in NEXT[path[-1] if path else state] if r != SYSTEM]
    return None


#: ``STEP[given][state]``: for each next state (cost, role, merged, inserted) of a turn given as that role; 0 is unknown.
STEP: list[list[list[tuple]]] = []
for given in range(4):
    STEP.append([])
    for state in range(4):
        options = []
        for role in (SYSTEM, USER, ASSISTANT):
            name = 0 if role == given else NAME_UNKNOWN if given == 0 else RELABEL
            if role == state:
                options.append((name + MERGE, role, True, []))
            if (between := _inserted(state, role)) is not None:
                options.append((name + INSERT * len(between), role, False, between))
        STEP[-1].append(sorted(options, key=lambda x: (x[0], x[1], not x[2])))
COST = np.full((4, 4, 4), FAR, np.int64)
for given in range(4):
    for state in range(4):
        for cost, role, _, _ in STEP[given][state]:
            COST[given, state, role] = min(COST[given, state, role], cost)
#: Cost of ending in a state: an empty assistant turn is added, after an empty user turn where needed.
END = np.array([FAR, 2 * INSERT, INSERT, 0], np.int64)


def least_costs(given: list[int]) -> np.ndarray:
    """4 x 4 table: the least cost of repairing these turns from one state to another."""
    table_ = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(table_, 0)
    for g in given:
        table_ = np.minimum((table_[:, :, None] + COST[g][None]).min(axis=1), FAR)
    return table_


def repair(given: list[int], start: int = NOTHING, end: int | None = None) -> list[tuple]:
    """The cheapest ``(cost, role, merged, inserted)`` of each turn; ties go to the smaller state from the end back."""
    best = np.full(4, FAR, np.int64)
    best[start] = 0
    steps = [best]
    for g in given:
        best = np.minimum((best[:, None] + COST[g]).min(axis=0), FAR)
        steps.append(best)
    state = int(np.argmin(best + END)) if end is None else end
    out = []
    for i in range(len(given) - 1, -1, -1):
        before = int(np.argmin(steps[i] + COST[given[i]][:, state]))
        out.append(next(x for x in STEP[given[i]][before] if x[1] == state))
        state = before
    return out[::-1]


def settle_borders(pieces: list) -> dict[tuple[int, int], tuple[int, int | None, bool]]:
    """Entry state, exit state (None: the end) and whether it is the last piece, of each piece that crosses a border."""
    fixed: dict[tuple[int, int], tuple[int, int | None, bool]] = {}
    chains: dict[int, list] = {}
    for x in sorted(pieces, key=lambda x: x["part"]):
        chains.setdefault(x["conv"], []).append(x)
    for conv, chain in chains.items():
        if len(chain) < 2:
            continue
        best = np.full(4, FAR, np.int64)
        best[NOTHING] = 0
        tables, steps = [np.array(x["costs"], np.int64).reshape(4, 4) for x in chain], [best]
        for t in tables:
            best = np.minimum((best[:, None] + t).min(axis=0), FAR)
            steps.append(best)
        state = int(np.argmin(best + END))
        exits: list[int | None] = [None]
        for t, known in zip(tables[::-1], steps[-2::-1], strict=True):
            state = int(np.argmin(known + t[:, exits[-1] if exits[-1] is not None else state]))
            exits.append(state)
        states = exits[::-1]
        for i, x in enumerate(chain):
            fixed[x["part"], conv] = (states[i], states[i + 1], i == len(chain) - 1)
    return fixed


def _codes(roles: pa.Array) -> list[int]:
    return [ALIASES.get((role or "").strip().lower(), 0) for role in roles.to_pylist()]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Pieces of conversations: the id, and the slices of Arrow batches that hold its turns in order.

    Texts stay in their Arrow buffers; a piece is at most what one range partition holds of a conversation.
    """
    conv, held = None, []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if ids[a] != conv:
                if held:
                    yield conv, held
                conv, held = int(ids[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield conv, held


def _border_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, codes = TaskContext.get().partitionId(), []
    conv, kept = None, {}
    for batch in batches:
        for c, code in zip(batch.column(0).to_pylist(), _codes(batch.column(2)), strict=True):
            if c != conv:
                if conv is not None and not kept:
                    kept[conv] = least_costs(codes)
                conv, codes = c, []
            codes.append(code)
    if conv is not None:
        kept[conv] = least_costs(codes)
        yield pa.RecordBatch.from_pylist([{"part": part, "conv": k, "costs": v.ravel().tolist()} for k, v in kept.items()], schema=pa.schema([("part", pa.int64()), ("conv", pa.int64()), ("costs", pa.list_(pa.int64()))]))


OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.int32()), ("given_role", pa.string()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])


def _repairer(fixed: dict[tuple[int, int], tuple[int, int | None, bool]]) -> Callable:
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        for conv, slices in _pieces(batches):
            start, end, last = fixed.get((part, conv), (NOTHING, None, True))
            state, conv_id = start, None if conv == NO_CONVERSATION else conv

            def put(turn, role, action, cost, text, given=None, merged=False, conv_id=conv_id):
                nonlocal state, size
                head = "\n" if merged else (CLOSE if state != NOTHING else "") + OPEN + ROLES[role] + "\n"
                state = role
                n = out[-1]["piece"] + 1 if out and out[-1]["conv_id"] == conv_id and out[-1]["turn"] == turn else 0
                out.append({"conv_id": conv_id, "turn": turn, "piece": n, "given_role": given, "role": ROLES[role], "action": action, "cost": cost, "rendered": head + text})
                size += len(text)

            codes = [_codes(x.column(2)) for x in slices]
            steps = iter(repair([c for own in codes for c in own], start, end))
            for x, own in zip(slices, codes, strict=True):
                for turn, given, text, code in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3), own, strict=True):
                    cost, role, merged, between = next(steps)
                    for r in between:
                        put(turn, r, "insert", INSERT, "")
                    action = "+".join((["relabel"] if code != role else []) + (["merge"] if merged else [])) or "keep"
                    put(turn, role, action, cost - INSERT * len(between), text.as_py() or "", given, merged)
                    if size > MOST_CHARS:  # the last row stays: its piece number and its end may still count
                        yield pa.RecordBatch.from_pylist(out[:-1], schema=OUT)
                        out, size = out[-1:], 0
            if last:
                for r in {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(state, []):
                    put(turn, r, "insert", INSERT, "")
                out[-1]["rendered"] += CLOSE
            if size > MOST_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema=OUT)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=OUT)

    return render


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, piece, given_role, role, action, cost, rendered)`` in repaired order.

    Sorted by ``conv_id``, ``turn``, ``piece`` the ``rendered`` strings of a conversation form its text.
    ``action`` is keep, relabel, merge, relabel+merge or insert; ``cost`` is what the action costs. A system
    turn is legal only at the start. Unknown and null roles take a new name at little cost. Null texts are
    empty; null ``turn`` sorts first; equal turns go by role and the text's hash; rows without ``conv_id`` form one
    conversation. An empty table gives no rows. Other columns are ignored.
    """
    rows = turns.select(F.coalesce("conv_id", F.lit(NO_CONVERSATION)).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # The range partitioner samples whole keys to the driver: they hold a hash of the text, not the text.
    order = ["conv", "turn", "role", F.xxhash64("text")]
    rows = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    pieces = rows.mapInArrow(_border_costs, "part long, conv long, costs array<long>").collect()  # two rows a partition
    return rows.mapInArrow(_repairer(settle_borders(pieces)), "conv_id long, turn long, piece int, given_role string, role string, action string, cost long, rendered string")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired turns of all ``conversations`` by :func:`format_chats`."""
    return format_chats(table(spark, sf_dir, "conversations"))
