"""N-gram Jaccard join with signature trees, exact for a given threshold.

A document's set holds 64-bit hashes of its word shingles; equal sets are one set from the start.
Two sets above the threshold share a token among the first few of each in any one global order, so
sets of like size that share such a token form a group; groups of the same members count once.

Each group is joined by a signature tree: nodes hold OR-combined bitmaps and size ranges, and a dual
traversal drops node pairs whose sets must differ by more than the threshold allows, or which are
connected already. Rows that are left and whose parities let them link are connected; a group gives
a spanning forest of them, never its pairs. The components of all forests hold every component of
true links, so each of their sets travels once, whole, to its component, where trees and exact
overlaps say which links are true; again a forest comes out.

Groups beyond a task's bounds are parted by hash into blocks, which are joined one by one. What is
not connected then is joined with all the rest, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from .common import documents, materialize, worker_pass
from .components import components, merge_components

WORDS = 3  # in a shingle
PERCENT = 90
BITS = 1024  # of every set's bitmap and parities; sets over WIDE shingles have wider parities besides
WIDE = 2000
LEAF, FANOUT = 8, 4
#: One document of so many, but SAMPLE at least, shows which shingles are frequent: those that FREQUENT
#: documents of the sample hold. The share is the same at every size, so other shingles stay in as few documents.
SHARE, SAMPLE, FREQUENT = 8, 6000, 4
#: Rows and bytes of a group that one task joins; larger ones are parted into blocks of so much.
BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20
#: Documents up to which the list of those whose sets are needed is broadcast; beyond it texts are shuffled to them.
BROADCAST_IDS = 1_000_000
_PAIRS = 200_000  # row pairs looked at together
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. A-Z are lowered; ASCII white space
    parts words; a text of fewer words than a shingle is one shingle, one without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(h))
    n = len(h) - k + 1
    mixed = np.full(n, k if k < words else 0, dtype=np.uint64)
    for j in range(k):
        mixed = (mixed ^ h[j : j + n]) * _M1
        mixed ^= mixed >> np.uint64(32)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _marks(tokens: np.ndarray, bits: int) -> np.ndarray:
    return np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits)


def bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bits that some token hits: nodes of a tree combine them by OR."""
    return np.packbits(_marks(tokens, bits) > 0).view(np.uint64)


def parities(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bits that an odd number of tokens hit: two sets differ in as many elements at least as their parities in bits."""
    return np.packbits((_marks(tokens, bits) & 1).astype(np.uint8)).view(np.uint64)


def _fold(wide: np.ndarray, bits: int) -> np.ndarray:
    """Parities of fewer bits, a power of two too."""
    return np.bitwise_xor.reduce(wide.reshape(-1, bits // 64), axis=0)


def _wide_bits(n: int) -> int:
    return max(BITS, 1 << int(n // 2).bit_length())


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def differ_at_most(a, b, percent: int = PERCENT):
    """Most elements that just one of two linked sets of sizes a and b can hold."""
    return (a + b) * (100 - percent) // (100 + percent)


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of the most frequent shingles of a sample, 200,000 at most. They only order tokens, so
    any list gives the same result."""
    of = max(1, min(SHARE, docs.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py(), words).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(of)) == 0).select("text").distinct()
    top = some.mapInArrow(worker_pass(run), "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(200_000)
    return np.sort(np.array([r.h for r in top.toLocalIterator()], dtype=np.int64).view(np.uint64))


def _ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Tokens in the global order: rare ones by hash, then frequent ones by hash."""
    top = np.uint64(1) << np.uint64(63)
    at = np.searchsorted(frequent, tokens)
    common = np.zeros(len(tokens), dtype=bool)
    if len(frequent):
        common = frequent[np.minimum(at, len(frequent) - 1)] == tokens
    return np.sort(np.where(common, tokens | top, tokens & ~top))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    h1, h2 = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(h1), int(h2)


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, h1 and h2 (128 bits of the set), prefix tokens, bitmap and parities of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    kinds = {"n": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "prefix": pa.list_(pa.int64()), "bits": pa.binary(), "odd": pa.binary(), "wide": pa.binary()}

    def one(text: str | None) -> tuple:
        tokens = shingles(text, words)
        n = len(tokens)
        prefix = _ordered(tokens, shared.value)[: n - int(needed(n, percent)) + 1] if n else tokens
        wide = parities(tokens, _wide_bits(n)).tobytes() if n > WIDE else None
        return n, *_digest(tokens), prefix.view(np.int64), bitmap(tokens).tobytes(), parities(tokens).tobytes(), wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                columns = zip(*[one(text.as_py()) for text in batch.column("text")], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]], names=["doc_id", "text_hash", *kinds])

    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(worker_pass(run), "doc_id long, text_hash long, n long, h1 long, h2 long, prefix array<long>, bits binary, odd binary, wide binary")


def _size_class(n: Column, percent: int) -> Column:
    """Sets that link are of one class or of neighbouring ones; classes are a little wide for safe rounding."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")


def _meetings(tokens: DataFrame, percent: int) -> DataFrame:
    """Rows (token, key, n) whose token a set of like size shares, which the next smaller or larger one shows.

    Ranges of (token, size) are dealt out, so a token of very many sets is spread over tasks; a row
    at a task's edge, whose neighbour is not known there, stays."""
    names = ["token", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last row, whose successor is not known yet
        alike = True  # whether the row before it has its token and a like size; not known for the first
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            if not len(rows):
                continue
            if held is not None:
                rows = np.vstack([held, rows])
            like = (rows[1:, 0] == rows[:-1, 0]) & (100 * rows[:-1, 2] >= percent * rows[1:, 2])
            before = np.concatenate([[alike], like])
            kept = rows[:-1][before[:-1] | like]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in kept.T], names=names)
            held, alike = rows[-1:], bool(before[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in held[0]], names=names)

    return tokens.repartitionByRange("token", "n", "key").sortWithinPartitions("token", "n", "key").mapInArrow(worker_pass(run), "token long, key long, n long")


def _groups(met: DataFrame, percent: int) -> DataFrame:
    """Members (grp, key, n) of groups of sets that may link: those of one token and of neighbouring
    size classes without a gap. Of groups with the same members one stays."""
    met = met.withColumn("class", _size_class(F.col("n"), percent))
    counted = met.groupBy("token", "class").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("key", F.lit(s))).alias(f"x{s}") for s in (1, 2)])
    order = Window.partitionBy("token").orderBy("class")  # a row for each class that a token has
    gap = (F.col("class") - F.lag("class").over(order) > 1).cast("int")
    runs = counted.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("run", F.sum("_gap").over(order)).groupBy("token", "run")
    runs = runs.agg(F.sum("c").alias("c"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.min("class").alias("low"), F.max("class").alias("high")).filter("c > 1")
    one = runs.groupBy("c", "x1", "x2").agg(F.min(F.struct("token", "low", "high")).alias("g")).select("g.*")
    return met.join(one, "token").filter(F.col("class").between(F.col("low"), F.col("high"))).select(F.xxhash64("token", "low").alias("grp"), "key", "n")


def tree_pairs(bitmaps: np.ndarray, sizes: np.ndarray, group: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs of leaves (blocks of LEAF rows) of one signature tree that may hold linked sets.

    Rows should come in an order that puts like sets together. Of sets x below P and y below Q,
    x has at least (least set bits below P) - |OR P & OR Q| elements that y lacks; a pair of nodes
    is dropped if that, both ways, exceeds what sets of their sizes may differ by, or if all
    their rows are of one ``group`` already.
    """
    starts = np.arange(0, len(sizes), LEAF)

    def up(ors, bits, low, high, g0, g1, at):
        return (np.bitwise_or.reduceat(ors, at, axis=0), np.minimum.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(g0, at), np.maximum.reduceat(g1, at))

    levels = [up(bitmaps, np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64), sizes, sizes, group, group, starts)]
    while len(levels[-1][1]) > 1:
        levels.append(up(*levels[-1], np.arange(0, len(levels[-1][1]), FANOUT)))
    pairs = np.zeros((1, 2), dtype=np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        ors, bits, low, high, g0, g1 = levels[depth]
        kept = []
        for part in np.array_split(pairs, max(1, len(pairs) // 50_000)):
            p, q = part.T
            both = np.bitwise_count(ors[p] & ors[q]).sum(axis=1).astype(np.int64)
            differ = np.maximum(0, bits[p] - both) + np.maximum(0, bits[q] - both)
            good = (differ <= differ_at_most(high[p], high[q], percent)) & (100 * high[p] >= percent * low[q]) & (100 * high[q] >= percent * low[p])
            good &= ~((g0[p] == g1[p]) & (g0[q] == g1[q]) & (g0[p] == g0[q]))
            kept.append(part[good])
        pairs = np.vstack(kept)
        if depth:
            n = len(levels[depth - 1][1])
            child = np.arange(FANOUT)
            p = (pairs[:, 0][:, None, None] * FANOUT + child[None, :, None]).repeat(FANOUT, axis=2)
            q = (pairs[:, 1][:, None, None] * FANOUT + child[None, None, :]).repeat(FANOUT, axis=1)
            pairs = np.column_stack([p.ravel(), q.ravel()])
            pairs = pairs[(pairs[:, 0] <= pairs[:, 1]) & (pairs[:, 1] < n)]
    return pairs


class _Forest:
    """Row numbers of one block and who is connected with whom; ``edges`` connect what was apart."""

    def __init__(self, label: np.ndarray):
        _, first, at = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[at]
        self.edges: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def join(self, x: int, y: int, links: Callable[[int, int], bool]) -> None:
        p, q = self.find(x), self.find(y)
        if p != q and links(x, y):
            self.up[max(p, q)] = min(p, q)
            self.edges.append((x, y))


def _spread(leaves: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of pairs of leaves, nearest leaves first, some leaves' at a time."""
    leaves = leaves[np.argsort(leaves[:, 1] - leaves[:, 0], kind="stable")]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij"))
    for part in np.array_split(leaves, max(1, len(leaves) * LEAF * LEAF // _PAIRS)):
        x, y = (part[:, :1] * LEAF + i).ravel(), (part[:, 1:] * LEAF + j).ravel()
        good = (x < y) & (y < m)
        yield x[good], y[good]


def _forest(rows: dict[str, np.ndarray], alike: Callable[[np.ndarray, np.ndarray], np.ndarray], links: Callable[[int, int], bool], percent: int) -> list[tuple[int, int]]:
    """Edges that connect the rows of one block which links connect, beyond what ``comp`` says.

    Only pairs of two sides are asked for where ``side`` has both."""
    n, m = rows["n"], len(rows["n"])
    forest = _Forest(rows["comp"])
    two = rows["side"].min() != rows["side"].max()
    leaves = tree_pairs(rows["bits"], n, rows["comp"], percent)
    for x, y in _spread(leaves, m):
        root = forest.roots()
        good = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        if two:
            good &= rows["side"][x] != rows["side"][y]
        x, y = x[good], y[good]
        if len(x):
            good = alike(x, y)
            for a, b in zip(x[good].tolist(), y[good].tolist(), strict=True):
                forest.join(a, b, links)
    return forest.edges


def _words(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), -1)


def _may_link(odd: np.ndarray, wide: list, n: np.ndarray, percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether parities let rows link."""

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = differ_at_most(n[x], n[y], percent)
        good = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1) <= most
        for k in np.flatnonzero(good & (n[x] > WIDE) & (n[y] > WIDE)) if any(wide) else ():  # few: parities of BITS bits say little of such sets
            u, v = np.frombuffer(wide[x[k]], dtype=np.uint64), np.frombuffer(wide[y[k]], dtype=np.uint64)
            bits = 64 * min(len(u), len(v))
            good[k] = np.bitwise_count(_fold(u, bits) ^ _fold(v, bits)).sum() <= most[k]
        return good

    return alike


def _candidates(table: pa.Table, rows: dict[str, np.ndarray], percent: int) -> list[tuple[int, int]]:
    rows["bits"] = _words(table["bits"].to_pylist())
    alike = _may_link(_words(table["odd"].to_pylist()), table["wide"].to_pylist(), rows["n"], percent)
    return _forest(rows, alike, lambda x, y: True, percent)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _true_links(table: pa.Table, rows: dict[str, np.ndarray], percent: int) -> list[tuple[int, int]]:
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table["tokens"].to_pylist()]
    rows["bits"] = np.stack([bitmap(s) for s in sets])
    odd = np.stack([parities(s) for s in sets])

    def links(x: int, y: int) -> bool:
        both = overlap(sets[x], sets[y])
        return 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)

    return _forest(rows, _may_link(odd, [], rows["n"], percent), links, percent)


def _block_edges(rows: DataFrame, join: Callable, percent: int) -> DataFrame:
    """Edges (a, b) of every block of (grp, block, key, n, comp, side, ...) rows; a task holds one block at a time."""

    def work(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        if table.num_rows > 1:
            columns = {c: table[c].to_numpy() for c in ("key", "n", "comp", "side")}
            key = columns["key"]
            if edges := np.array(join(table, columns, percent), dtype=np.int64).reshape(-1, 2).T.tolist():
                if edges[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(key[edges[0]]), pa.array(key[edges[1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            grp, block = table["grp"].to_numpy(), table["block"].to_numpy()
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if held and last != (grp[a], block[a]):
                    yield from work(held)
                    held = []
                last = (grp[a], block[a])
                held.append(table.slice(a, b - a))
        if held:
            yield from work(held)

    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "n", "key").mapInArrow(worker_pass(run), "a long, b long")


def _joined(members: DataFrame, attach: Callable[[DataFrame], DataFrame], join: Callable, row_bytes: Column, percent: int) -> DataFrame:
    """(node, component) of the keys of ``members`` (grp, key, n) that ``join`` connects within groups.

    A group within BLOCK_ROWS and BLOCK_BYTES is one block. A larger one is dealt into blocks by hash,
    which are joined on their own; then only what is apart is looked at: the largest component of the
    group is its one side, split into blocks, and each of them meets each block of the rest, as
    blocks of the rest meet one another. Rows sent follow (rows of the group) x (blocks of the rest).
    """
    size = members.groupBy("grp").agg(F.count("*").alias("_rows"), F.sum(row_bytes).alias("_bytes"))
    blocks = lambda rows, size_: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size_ / BLOCK_BYTES)).cast("int")
    large = materialize(size.select("grp", blocks(F.col("_rows"), F.col("_bytes")).alias("_k")).filter("_k > 1"), "large-groups")
    any_large = not large.isEmpty()
    dealt = members.withColumns({"comp": F.col("key"), "side": F.lit(0)})
    if any_large:
        spread = F.pmod(F.xxhash64("key", F.lit(7)), F.col("_k"))
        dealt = dealt.join(large, "grp", "left").withColumn("block", F.coalesce(spread, F.lit(0)).cast("long")).drop("_k")
    else:
        dealt = dealt.withColumn("block", F.lit(0).cast("long"))
    parts = materialize(components(_block_edges(attach(dealt), join, percent)), "components")
    if not any_large:
        return parts
    rows = members.join(large.select("grp"), "grp").join(parts, F.col("key") == F.col("node"), "left").select("grp", "key", "n", F.coalesce("component", "key").alias("comp"))
    rows = materialize(rows, "large-rows")
    by_comp = rows.groupBy("grp", "comp").agg(F.count("*").alias("c"), F.sum(row_bytes).alias("w"))
    sides = by_comp.groupBy("grp").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("_mc"), F.max_by("w", F.struct("c", "comp")).alias("_mw"), F.sum("c").alias("_c"), F.sum("w").alias("_w"))
    sides = sides.filter("_c > _mc").select("grp", "main", blocks(F.col("_mc"), F.col("_mw")).alias("km"), blocks(F.col("_c") - F.col("_mc"), F.col("_w") - F.col("_mw")).alias("kr"))
    rows = rows.join(sides, "grp")
    up_to = lambda k: F.sequence(F.lit(0), k - 1)
    at = lambda k: F.pmod(F.xxhash64("key", F.lit(19)), F.col(k)).cast("int")
    cell = lambda side, i, j: F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side if side < 2 else 1), i, j).alias("block"))
    # Side 0: the rest among itself, by pairs of its blocks. Sides 1 and 2: the main component and the rest, by block of each.
    among = F.transform(up_to(F.col("kr")), lambda j: cell(0, F.least(at("kr"), j), F.greatest(at("kr"), j)))
    main = F.transform(up_to(F.col("kr")), lambda j: cell(1, at("km"), j))
    rest = F.concat(among, F.transform(up_to(F.col("km")), lambda i: cell(2, i, at("kr"))))
    again = rows.withColumn("_p", F.explode(F.when(F.col("comp") == F.col("main"), main).otherwise(rest))).select("grp", "key", "n", "comp", "_p.side", "_p.block")
    return materialize(merge_components(parts, _block_edges(attach(again), join, percent)), "components")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(key, tokens) of the rows of ``docs`` whose doc_id is in ``wanted`` (first), made anew from their texts."""
    wanted = materialize(wanted.select("first").distinct(), "set-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                sets = [shingles(x.as_py(), words) for x in whole.slice(start, 500).column("text")]
                h1, h2 = zip(*map(_digest, sets), strict=True) if sets else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h1", "h2", "tokens"])

    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("text")
    return texts.mapInArrow(worker_pass(run), "h1 long, h2 long, tokens binary").select(_key(seed), "tokens")


def _key(seed: int) -> Column:
    return F.xxhash64("h1", "h2", F.lit(seed)).alias("key")


def _unique_seed(sets: DataFrame) -> int:
    """A seed by which no two sets have the same 64-bit key."""
    seed = 0
    while not sets.select(_key(seed)).groupBy("key").count().filter("count > 1").isEmpty():
        seed += 1
    return seed


def row_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, group (null without shingles; else one
    number for each component) and component_id of every row; see :func:`jaccard_components`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(rows, words, percent), "signatures")
    slim = signed.select("doc_id", "text_hash", "n", "h1", "h2")
    firsts = materialize(slim.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "distinct-sets")
    seed = _unique_seed(firsts)
    own = firsts.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), _key(seed), "first")
    sets = signed.join(own, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("key", "first", "n", "prefix", "bits", "odd", "wide")
    again = not slim.groupBy("doc_id", "h1", "h2").count().filter("count > 1").isEmpty()  # rows of an id with equal sets
    if again:
        sets = sets.dropDuplicates(["key"])
    sets = materialize(sets, "sets")

    met = materialize(_meetings(sets.select("key", "n", F.explode("prefix").alias("token")), percent), "meetings")
    groups = materialize(_groups(met, percent), "groups")
    shapes = sets.select("key", "bits", "odd", "wide")
    maybe = _joined(groups, lambda x: x.join(shapes, "key"), _candidates, F.lit(400) + F.col("n") / 8, percent)

    clusters = materialize(maybe.join(sets.select("key", "n", "first"), F.col("node") == F.col("key")).select(F.col("component").alias("grp"), "key", "n", "first"), "clusters")
    whole = _sets_of(rows, clusters, words, seed)
    whole = whole.dropDuplicates(["key"]) if again else whole
    parts = _joined(clusters.drop("first"), lambda x: x.join(whole, "key"), _true_links, 8 * F.col("n"), percent)

    of_set = own.join(parts, F.col("key") == F.col("node"), "left").select("_h1", "_h2", "first", F.coalesce("component", "key").alias("group"))
    ids = of_set.groupBy(F.col("group").alias("_g")).agg(F.min("first").alias("component_id"))
    of_set = of_set.join(ids, F.col("group") == F.col("_g")).select("_h1", "_h2", "group", "component_id")
    full = slim.filter("n > 0").join(of_set, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "group", "component_id")
    return full.union(slim.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Sets link when 100 * intersection >= percent * union; the component is the smallest doc_id
    that links reach. Null texts and texts without words have no shingles and are alone; equal
    sets are one set from the start, so copies cost a count; repeated rows come out each. A doc_id
    with several texts has a row for each, in the component of that text.
    """
    return row_components(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
