"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are. A configuration linear
program (how often to use each combination of lengths that fits a sequence)
is solved by multiplicative weights: each round prices the lengths by how far
they are from being covered, and a knapsack by dynamic programming finds the
combination of most worth. The fractional solution is rounded to whole
sequences, and what is left goes by best fit into remaining room. The plan
maps (length, rank) ranges to (sequence, offset); pieces look themselves up.

Documents may belong to groups, such as languages. Each large group is planned
by itself; of its sequences those that are nearly full stand, and what is left
of all groups is planned together, so a sequence holds one group as far as that
costs no sequence.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_tokens import encoder
from .workspace import bound_batches, by_bytes, written

#: Bytes of text that a worker turns into ids at a time.
TEXT_BYTES = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long, group string"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: A group with at least this share of all tokens may have sequences of its own; so there are few, however many groups.
LARGE = 0.05
#: Tokens that a group's own sequences may leave empty, of 4096; tried in turn until no more sequences are needed than without groups.
SPARE = (128, 32, 8, 0)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", words: int = 300_000, group_col: str | None = None
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces only where longer than ``capacity``.

    ``nth`` counts the pieces of one group and length within the task ``part``;
    ``words`` bounds a worker's table of known words, not the result. The
    documents' group follows as the column ``group``, null without ``group_col``.
    """
    bound_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        codec, part = encoder(tokenizer, words), TaskContext.get().partitionId()
        seen: dict[tuple[str | None, int], int] = {}
        for b in by_bytes(batches, 1, TEXT_BYTES):
            rows: list[list] = [[], [], [], [], [], [], []]
            for doc, ids, group in zip(b.column("doc_id").to_pylist(), codec.encode(b.column("t")), b.column("group").to_pylist(), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    nth = seen.get((group, n), 0)
                    for col, v in zip(rows, (doc, k, at // 4, n, zlib.crc32(cut), nth, group), strict=True):
                        col.append(v)
                    seen[group, n] = nth + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            cols.insert(5, pa.array(np.full(len(rows[0]), part)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "group"])

    group = F.lit(None) if group_col is None else F.col(group_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), group.cast("string").alias("group")).mapInArrow(run, PIECES)


def fill(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(most worth within each capacity, last item taken for it or -1); any number of copies."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = best[c - sizes[: fits[c]]] + worth[: fits[c]]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], last[c] = got[k], k
    return best, last


def _taken(sizes: np.ndarray, last: np.ndarray, capacity: int) -> dict[int, int]:
    """The items (index: copies) of the best filling of a capacity."""
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        k = int(last[c])
        if k < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= int(sizes[k])
    return out


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of items (index: copies) of most worth within ``capacity``; any number of copies."""
    return _taken(sizes, fill(sizes, worth, capacity)[1], capacity)


def configuration_lp(sizes: np.ndarray, need: np.ndarray, capacity: int, step: float = 0.05, near: float = 0.99, columns: int = 12) -> list[tuple[dict[int, int], float]]:
    """(combination, how often) pairs that cover ``need`` pieces of each size, fractionally.

    Multiplicative weights: a size's weight falls exponentially with the share
    of its need already covered. Each round fills one knapsack table, which
    prices for every size the best combination that holds it; those of nearly
    the most worth, and that of the size least covered, are raised until one of
    their sizes gains ``step`` of its need. So every round brings the size
    least covered on, and the rounds end.
    """
    covered = np.zeros(len(sizes))
    used: dict[tuple, float] = {}
    while covered.min() < 1:
        worth = np.exp(-10 * (covered - covered.min())) / need
        best, last = fill(sizes, worth, capacity)
        held = worth + best[capacity - sizes]
        order = np.argsort(-held, kind="stable")[:columns]
        picks = [int(covered.argmin()), *order[held[order] >= near * best[capacity]].tolist()]
        for combo in {tuple(sorted(_holding(sizes, last, capacity, k).items())) for k in picks}:
            items, copies = np.array([i for i, _ in combo]), np.array([n for _, n in combo])
            amount = step / (copies / need[items]).max()
            covered[items] += amount * copies / need[items]
            used[combo] = used.get(combo, 0.0) + amount
    return [(dict(k), x) for k, x in sorted(used.items())]


def _holding(sizes: np.ndarray, last: np.ndarray, capacity: int, k: int) -> dict[int, int]:
    """The best combination that holds item ``k``."""
    out = _taken(sizes, last, capacity - int(sizes[k]))
    out[k] = out.get(k, 0) + 1
    return out


@dataclass
class Plan:
    """Slots: the pieces of length ``length[i]`` ranked ``rank[i]`` to ``rank[i] + many[i] - 1``
    are in the sequences from ``sequence[i]`` on, one each, at ``offset[i]``."""

    length: np.ndarray
    rank: np.ndarray
    many: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    #: Pieces that the program placed; full ones need no plan, and best fit placed the rest.
    by_program: int = 0

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        lo = np.searchsorted(self.length, length, "left")
        hi = np.searchsorted(self.length, length, "right")
        while True:  # the last slot of the length that starts at the rank or before
            mid = (lo + hi) // 2
            go = hi - lo > 1
            if not go.any():
                break
            right = go & (self.rank[np.minimum(mid, len(self.rank) - 1)] <= rank)
            lo, hi = np.where(right, mid, lo), np.where(go & ~right, mid, hi)
        return self.sequence[lo] + rank - self.rank[lo], self.offset[lo]


def plan_sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int, unit: int = 16) -> Plan:
    """A plan for ``counts`` pieces of each length. Work and size depend on the histogram only."""
    kinds, by_program = _sequences(lengths, counts, capacity, unit)
    return _plan([(m, ls, ls) for m, ls in kinds], by_program)


def _sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int, unit: int = 16) -> tuple[list[tuple[int, list[int]]], int]:
    """((how many sequences, their lengths), the fullest first; pieces that the program placed)."""
    left = np.zeros(capacity + 1, np.int64)
    left[lengths] = counts
    kinds: list[tuple[int, list[int]]] = []
    if left[capacity]:
        kinds.append((int(left[capacity]), [capacity]))
        left[capacity] = 0

    grain = unit if capacity >= 64 * unit else 1
    whole, before = int(left.sum()), -1
    # what rounding leaves is a smaller program of the same kind, while that places a good part of it
    while (rest := int(left.sum())) and (before < 0 or before - rest >= max(1, before // 20)):
        before = rest
        groups: dict[int, list[int]] = {}
        for length in np.flatnonzero(left)[::-1].tolist():
            groups.setdefault(-(-length // grain), []).append(length)  # longest first
        sizes = np.array(sorted(groups))
        need = np.array([left[groups[s]].sum() for s in sizes.tolist()], float)
        carried = 0.5
        for combo, x in sorted(configuration_lp(sizes, need, capacity // grain), key=lambda p: -p[1]):
            carried += x
            m = int(carried)
            carried -= m
            stock = {k: int(left[groups[int(sizes[k])]].sum()) for k in combo}
            m = min(m, *(stock[k] // copies for k, copies in combo.items()))
            slots = [groups[int(sizes[k])] for k, copies in combo.items() for _ in range(copies)]
            while m > 0:
                m -= _take(slots, left, m, kinds, capacity)
    by_program = whole - int(left.sum())

    room: dict[int, list[tuple[int, list[int]]]] = {}
    for m, ls in kinds:
        room.setdefault(capacity - sum(ls), []).append((m, ls))
    spaces = sorted(room)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                if n >= fit:
                    new = (n // fit, [length] * fit)
                    n %= fit
                else:
                    new, n = (1, [length] * n), 0
                space = capacity - sum(new[1])
            else:
                space = spaces[at]
                m, ls = room[space].pop()
                if m > n:
                    room[space].append((m - n, ls))
                    m = n
                elif not room[space]:
                    del room[space]
                    spaces.pop(at)
                n -= m
                new, space = (m, [*ls, length]), space - length
            if space not in room:
                bisect.insort(spaces, space)
            room.setdefault(space, []).append(new)

    return [kind for space in sorted(room) for kind in room[space]], by_program


def _plan(kinds: list[tuple[int, list[int], list[int]]], by_program: int = 0) -> Plan:
    """The plan that makes of each kind so many sequences: (how many, lengths, keys by which the pieces are looked up)."""
    slots: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = {}
    base = 0
    for m, ls, keys in kinds:
        offset = 0
        for length, key in zip(ls, keys, strict=True):
            slots.append((key, ranks.get(key, 0), m, base, offset))
            ranks[key] = ranks.get(key, 0) + m
            offset += length
        base += m
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(table[:, i]) for i in range(5)), base, by_program)


@dataclass
class GroupPlan:
    """The first ``taken`` pieces of a group and length are in sequences of that group alone, ``own``;
    the others follow in ``shared``, those of a group and length after the ``before`` of earlier groups."""

    own: Plan
    shared: Plan
    taken: np.ndarray
    before: np.ndarray
    capacity: int

    @property
    def sequences(self) -> int:
        return self.own.sequences + self.shared.sequences

    def place(self, group: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        own = rank < self.taken[group, length]
        g, n, r = group[own], length[own], rank[own]
        sequence[own], offset[own] = self.own.place(g * (self.capacity + 1) + n, r)
        g, n, r = group[~own], length[~own], rank[~own]
        at, offset[~own] = self.shared.place(n, r - self.taken[g, n] + self.before[g, n])
        sequence[~own] = at + self.own.sequences
        return sequence, offset


def plan_groups(groups: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int, rest: int = -1) -> GroupPlan:
    """A plan for ``counts`` pieces of each group (numbers from 0) and length, with as many sequences as without groups at most.

    Pieces of the group ``rest`` are of small groups and have no sequences of their own.
    """
    many = int(groups.max(initial=0)) + 1
    need = np.zeros((many, capacity + 1), np.int64)
    need[groups, lengths] = counts

    def planned(left: np.ndarray) -> Plan:
        some = np.flatnonzero(left)
        return plan_sequences(some, left[some], capacity)

    whole = planned(need.sum(0))
    kinds = {g: _sequences(np.flatnonzero(need[g]), need[g][need[g] > 0], capacity)[0] for g in range(many) if g != rest and many > 1}
    for spare in (x * capacity // 4096 for x in SPARE if kinds):
        full = [(m, ls, [g * (capacity + 1) + n for n in ls]) for g, of in kinds.items() for m, ls in of if capacity - sum(ls) <= spare]
        taken = np.zeros_like(need)
        for m, _, keys in full:
            np.add.at(taken.reshape(-1), keys, m)
        left = need - taken
        plan = GroupPlan(_plan(full), planned(left.sum(0)), taken, left.cumsum(0) - left, capacity)
        if plan.sequences <= whole.sequences:
            return plan
    return GroupPlan(_plan([]), whole, np.zeros_like(need), need.cumsum(0) - need, capacity)


def _take(slots: list[list[int]], left: np.ndarray, m: int, kinds: list, capacity: int) -> int:
    """Fills at most ``m`` sequences alike.

    Each slot takes the longest length its group still has. The sizes of the
    program are rounded up, so there is room to spare: the largest slot takes
    the longest length of any group that fits what the others leave.
    """
    picked: list[int] = []
    uses: dict[int, int] = {}
    largest = max(range(len(slots)), key=lambda i: slots[i][0])
    for i, lengths in enumerate(slots):
        if i == largest:
            continue
        while lengths and left[lengths[0]] == 0:
            lengths.pop(0)
        k = next((x for x in lengths if left[x] > uses.get(x, 0)), None)
        if k is None:
            return m
        picked.append(k)
        uses[k] = uses.get(k, 0) + 1
    k = capacity - sum(picked)
    while k > 0 and left[k] <= uses.get(k, 0):
        k -= 1
    if k <= 0:
        return m
    picked.append(k)
    uses[k] = uses.get(k, 0) + 1
    m = min(m, *(int(left[x]) // n for x, n in uses.items()))
    for x, n in uses.items():
        left[x] -= m * n
    kinds.append((m, picked))
    return m


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", words: int = 300_000, group_col: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null text counts as empty: its one piece is ``end_id``. Repeated rows
    and null ids are packed as documents of their own. An empty table gives an
    empty result. Only the named columns are read. ``words``: see :func:`pieces`.

    With ``group_col`` that column of the documents (as a string, null a group
    too) follows, and sequences hold one group as far as that costs no sequence.

    One narrow table is written; texts never shuffle. A rank is a task's base
    for the length (a running sum over tasks) and the piece's number within
    the task, so a length that a third of all pieces share is no hot group.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, words, group_col), "pieces")
    per_task = table.groupBy("group", "length", "part").agg(F.count(F.lit(1)).alias("n"))
    large: list[str | None] = [None]
    if group_col is not None:
        per_task = written(per_task, "lengths")
        sizes = per_task.groupBy("group").agg(F.sum(F.col("n") * F.col("length")).alias("size"))
        whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        large = [r["group"] for r in sizes.where(F.col("size") >= LARGE * whole).orderBy("group").collect()]  # a row a large group: 20 at most
    of = F.lit(len(large))  # small groups
    for i, g in enumerate(large):
        of = F.when(F.col("group").eqNullSafe(F.lit(g)), i).otherwise(of)
    per_task = per_task.withColumn("class", of.cast("long"))
    bases = per_task.select(
        F.col("group").alias("b_group"), F.col("length").alias("b_length"), F.col("part").alias("b_part"), "class", (F.sum("n").over(Window.partitionBy("class", "length").orderBy("group", "part")) - F.col("n")).alias("base")
    )
    hist = per_task.groupBy("class", "length").agg(F.sum("n").alias("n")).orderBy("class", "length").collect()  # at most ``capacity`` rows a large group
    plan = plan_groups(*(np.array([r[c] for r in hist], np.int64) for c in ("class", "length", "n")), capacity, rest=len(large))
    shipped = spark.sparkContext.broadcast(plan)
    schema = PLACED if group_col is None else f"{PLACED}, `{group_col}` string"

    def run(batches):
        for b in batches:
            sequence, offset = shipped.value.place(*(b.column(c).to_numpy() for c in ("class", "length", "rank")))
            cols = [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if group_col is not None:
                cols, names = [*cols, b.column("group")], [*names, group_col]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    same = F.col("group").eqNullSafe(F.col("b_group")) & (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part"))
    ranked = table.join(bases, same).select("doc_id", "piece", "start", "length", "ids_crc32", "class", (F.col("base") + F.col("nth")).alias("rank"), "group")
    return ranked.mapInArrow(run, schema)
