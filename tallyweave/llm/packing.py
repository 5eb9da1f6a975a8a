"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

The plan is a linear grouping scheme. Large lengths, sorted, fall into groups of equal
cardinality and are rounded up to the group's largest; a configuration program over these few
sizes is solved by column generation; actual pieces are substituted into the configurations'
slots, and all that is left, small pieces above all, goes best-fit into the remaining room.

A plan is a list of runs: pieces of one length, ranks ``first`` to ``first + count``, go to
sequences ``base`` onwards, one each, at one offset. Its size follows the number of distinct
lengths (the capacity at most), never the number of pieces, so it is made on the driver and
broadcast. The rows themselves are only ranked within their length and looked up.

Pieces that come with a place in an order keep it: sequences of one composition are spread evenly
over the whole, and the pieces of each length fill its slots from the first sequence to the last
by place. Any share of the sequences, from the first on, so holds that share of every length's
pieces, the earliest ones.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, salted_rank, salts_for, worker_cache, worker_pass
from .tokens import WORD_BPE, WordIds

CAPACITY, SEPARATOR = 2048, 0
GROUPS = 64
#: Shares of the capacity from which a length may count as large; the plan with the fewest sequences is taken.
LARGE = (1 / 4, 2 / 5, 1 / 2)
ROUNDS = 400
#: Bytes of words that a worker keeps, and half as much of their parts; they save work only.
WORD_CACHE = 128 << 20


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE, cache_bytes: int = WORD_CACHE) -> DataFrame:
    """Each text's ids and then the separator, cut every ``capacity`` ids: one row for each piece, with
    its document's ``place`` if there is one."""
    placed = ["place"] if "place" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_cache(f"words {vocabulary} {cache_bytes}", lambda: WordIds(vocabulary, cache_bytes))
        end, wide = SEPARATOR.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            beside = [batch.column(c).to_pylist() for c in placed]
            for doc_id, value, *more in zip(batch.column("doc_id").to_pylist(), batch.column("text"), *beside, strict=True):
                ids = ids_of(value.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    for column, x in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *more), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *placed]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *placed)
    return rows.mapInArrow(worker_pass(run, cached=True), ", ".join(f"{c} {'int' if c == 'piece' else 'long'}" for c in names))


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity of most value."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, worth = sizes[order], values[order]
    for room in range(int(small[0]), capacity + 1):
        k = np.searchsorted(small, room, "right")
        options = best[room - small[:k]] + worth[:k]
        i = int(options.argmax())
        if options[i] > best[room - 1] + 1e-12:
            best[room], taken[room] = options[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), dtype=int), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[order[taken[room]]] += 1
            room -= int(small[taken[room]])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, from the configuration program, rounded down."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(ROUNDS):
        inverse = np.linalg.inv(columns)
        values = inverse.sum(axis=0)
        pattern = _best_pattern(values, sizes, capacity)
        if values @ pattern <= 1 + 1e-6:
            break
        amount, change = inverse @ demand, inverse @ pattern
        ratios = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratios.argmin())] = pattern
    amount = np.linalg.solve(columns, demand)
    return [(columns[:, i].astype(int), int(np.floor(amount[i] + 1e-7))) for i in range(n) if amount[i] >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) for a histogram of lengths, and the number of sequences."""
    return min((plan_from(counts, capacity, groups, share) for share in LARGE), key=lambda x: x[1])


def plan_from(counts: dict[int, int], capacity: int, groups: int, share: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan whose large lengths are those of at least ``share`` of the capacity."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by what is left: (sequences, first sequence)

    def place(length: int, count: int, base: int, offset: int) -> None:
        runs.append((length, used[length], count, base, offset))
        used[length] += count

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0)
        sequences = counts[capacity]
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if share * capacity <= x < capacity and counts[x]]
    total = sum(n for _, n in large)
    if total:
        each = -(-total // min(groups, total))
        queues: list[list[list[int]]] = [[]]
        space = each
        for length, n in large:  # groups of equal cardinality, cut wherever they end
            while n:
                if not space:
                    queues.append([])
                    space = each
                take = min(n, space)
                queues[-1].append([length, take])
                n, space = n - take, space - take
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [g for g in np.argsort(-sizes) for _ in range(pattern[g])]
            while times:
                heads = [(g, next((r for r in queues[g] if r[1]), None)) for g in slots]
                heads = [(g, r) for g, r in heads if r is not None]
                if not heads:
                    break
                several = defaultdict(int)
                for _, r in heads:
                    several[id(r)] += 1
                step = min(times, *(max(1, r[1] // several[id(r)]) for _, r in heads))
                offset = 0
                for g, r in heads:
                    if r[1] < step:  # the run ended within this bin: the slot takes the group's next length
                        r = next((x for x in queues[g] if x[1] >= step), None)
                        if r is None:
                            continue
                    place(r[0], step, sequences, offset)
                    r[1] -= step
                    offset += r[0]
                room[capacity - offset].append((step, sequences))
                sequences += step
                times -= step
    for length in sorted(counts, reverse=True):
        left = counts[length] - used[length]
        while left:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                each = capacity // length
                bins = max(1, left // each)
                fill = min(each, left)
                for k in range(fill):
                    place(length, bins, sequences, k * length)
                room[capacity - fill * length].append((bins, sequences))
                sequences += bins
                left -= bins * fill
                continue
            n, base = room[fit].pop()
            take = min(n, left)
            if take < n:
                room[fit].append((n - take, base + take))
            place(length, take, base, capacity - fit)
            room[fit - length].append((take, base))
            left -= take
    return runs, sequences


#: Bits of a sequence's time in the order, and of the number of its composition, in its id.
TIME_BITS, KIND_BITS = 30, 24
#: Numbers that one step of a search for times holds at once.
SEARCH = 1 << 18


def slots_in_order(runs: list[tuple[int, int, int, int, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """The slots of each length (sequences, composition, offset) by composition. A composition is
    a stretch of sequences that no run begins or ends in."""
    cuts = np.unique(np.array([x for _, _, count, base, _ in runs for x in (base, base + count)], dtype=np.int64))
    if len(cuts) > 1 << KIND_BITS:
        raise ValueError("more compositions than their numbers have room for")
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, _, count, base, offset in runs:
        first, last = np.searchsorted(cuts, (base, base + count))
        slots[length] += [(int(cuts[k + 1] - cuts[k]), int(k), offset) for k in range(first, last)]
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(own, key=lambda s: s[1:]), strict=True)) for x, own in slots.items()}


def _phases(kind: np.ndarray) -> np.ndarray:
    """Where in its first step a composition begins, by the golden section: rare ones don't meet in the middle."""
    return kind * 0x278DDE6D & (1 << TIME_BITS) - 1


def _until(time: np.ndarray, many: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """How many of so many sequences, spread evenly, come at or before a time: number j of n is at (j + phase) / n of the whole."""
    return (((time + 1) * many - 1 - phase) >> TIME_BITS) + 1


def nth_slots(slots: tuple[np.ndarray, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ids and offsets of a length's slots by their rank in the order of the sequences."""
    many, kind, offset = slots
    each, times = np.unique(kind, return_counts=True)
    sizes = many[np.searchsorted(kind, each)]
    sequence, start = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    step = max(1, SEARCH // len(many))
    for at in range(0, len(rank), step):
        own = rank[at : at + step]
        low, high = np.zeros(len(own), np.int64), np.full(len(own), (1 << TIME_BITS) - 1, np.int64)
        for _ in range(TIME_BITS):
            middle = (low + high) // 2
            enough = (_until(middle[:, None], sizes, _phases(each)) * times).sum(axis=1) > own
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        until, before = (_until(x[:, None], many, _phases(kind)) for x in (high, high - 1))
        found = ((until - before).cumsum(axis=1) > (own - before.sum(axis=1))[:, None]).argmax(axis=1)
        sequence[at : at + step], start[at : at + step] = high << KIND_BITS | kind[found], offset[found]
    return sequence, start


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens; with a ``place``,
    sequences in ascending order of their ids follow it (the ids then have gaps).

    The histogram has ``capacity`` rows at most. Ranks within a length are dealt over salts, so
    a length that a third of all pieces share is not one task. Equal pieces may take each
    other's place, which changes no count. No pieces give an empty result.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    ordered = "place" in pieces.columns
    last = F.max("place") if ordered else F.lit(0)
    found = pieces.groupBy("length").agg(F.count("*").alias("n"), last.alias("last")).collect()
    counts = {r["length"]: r["n"] for r in found}
    runs, _ = plan(counts, capacity)
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    if ordered:
        by_length = slots_in_order(runs)
    for length in () if ordered else counts:
        own = sorted(r[1:] for r in runs if r[0] == length)
        by_length[length] = tuple(np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
    shared = spark.sparkContext.broadcast(by_length)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at = length == x
                if ordered:
                    sequence[at], offset[at] = nth_slots(shared.value[int(x)], rank[at])
                    continue
                first, _, base, start = shared.value[int(x)]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[i] + rank[at] - first[i], start[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    salts = salts_for(max(counts.values(), default=0))
    if ordered:
        places = max((r["last"] for r in found), default=0) + 1
        ranked = salted_rank(pieces, ["length"], ["place", "piece"], salts, salt=F.floor(F.col("place") * salts / places))
    else:
        ranked = salted_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], salts)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*pieces.columns, "rank").mapInArrow(worker_pass(look_up, cached=True), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE, cache_bytes: int = WORD_CACHE) -> DataFrame:
    """Pieces of all documents with their places. Null and empty texts are one separator each;
    repeated rows are packed as often as they come; documents with a ``place`` are packed in that order."""
    return pack(token_pieces(docs, capacity, vocabulary, cache_bytes), capacity)


def in_order(packed: DataFrame) -> DataFrame:
    """Pieces of ordered sequences dealt by ranges of them, in order within each and from one to the next."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright(F.shiftright("sequence_id", KIND_BITS) * n, TIME_BITS).cast("int")
    return packed.repartitionById(n, part).sortWithinPartitions("sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
