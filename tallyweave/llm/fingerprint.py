"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A text is cut at ``\\n`` into paragraphs and each paragraph into sentences and runs of at most
``RUN`` words; these leaves tile the text, so equal roots mean equal texts. Paragraphs are
grouped into sections at blank lines, headings and content-defined cuts, so an insertion
disturbs only the sections it touches. :func:`fingerprint` is the root followed by the digests
of all sections, of their paragraphs and of their leaves; :func:`likeness` compares two of them,
:func:`locate_edits` descends into differing branches only.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from .common import documents, worker_pass

RUN = 6
CODE = 10  # hex digits of a leaf's code in the fingerprint
NODE = 12  # of a paragraph's and a section's
ORDER = 0.02  # share of paragraphs, sections and root in the likeness: leaves in another order are not the same text
SECTION = 16  # paragraphs in a section at most
_LEAF = re.compile(r"\s*(?:[^\s.!?]*[^\s]\s+){0,%d}?(?:\S*[.!?](?=\s)\s*|\S+\s*$)|\s*(?:\S+\s+){%d}|\s*\S+\s*|\s+" % (RUN - 1, RUN))
_HEADING = re.compile(r"\s*(#|[A-Z0-9][A-Z0-9 .:-]{2,60}$)")


def leaves(paragraph: str) -> list[str]:
    """Runs of at most RUN words that end at a sentence's end; they tile the paragraph."""
    return _LEAF.findall(paragraph)


def tree(text: str | None) -> list[list[list[bytes]]]:
    """Sections of paragraphs of 8-byte leaf digests."""
    sections: list[list[list[bytes]]] = []
    current: list[list[bytes]] = []
    for line in (text or "").split("\n"):
        digests = [xxh3_64_digest(x.encode("utf-8", "surrogatepass")) for x in leaves(line)]
        if current and (not digests or len(current) >= SECTION or _HEADING.match(line) or digests[0][0] % 8 == 0):
            sections.append(current)
            current = []
        current.append(digests)
    return [*sections, current]


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\x00".join(parts), digest_size=16).digest()


class Print(NamedTuple):
    """A text's fingerprint, and how often each leaf and each node above the leaves occurs in it."""

    text: str
    leaves: Counter
    nodes: Counter


def describe(text: str | None) -> Print:
    """The fingerprint ``<root>:<section>;<section>``: a section is its digest, ``=`` and its paragraphs joined
    by ``,``; a paragraph its digest, ``-`` and the codes of its leaves run together.

    Null counts as the empty text. Leaf digests have 64 bits, of which the text form keeps 40;
    paragraphs, sections and the root are 128-bit BLAKE2 digests of what they hold, of which the
    text form keeps 48 and the root's all.
    """
    leaves_, nodes, above, shown = Counter(), Counter(), [], []
    for section in tree(text):
        own = [_digest(p) for p in section]
        above.append(_digest(own))
        codes = [[x.hex()[:CODE] for x in p] for p in section]
        for p in codes:
            leaves_.update(p)
        names = [d.hex()[:NODE] for d in own]
        nodes.update(names)
        shown.append(above[-1].hex()[:NODE] + "=" + ",".join(f"{n}-{''.join(p)}" for n, p in zip(names, codes, strict=True)))
    root = _digest(above).hex()
    nodes.update([*(d.hex()[:NODE] + "=" for d in above), root])
    return Print(root + ":" + ";".join(shown), leaves_, nodes)


def fingerprint(text: str | None) -> str:
    return describe(text).text


def _sections(print_: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """(digest, paragraphs) of all sections; a paragraph is (digest, leaf codes)."""
    out = []
    for section in print_.partition(":")[2].split(";"):
        name, _, rest = section.partition("=")
        paragraphs = [p.partition("-") for p in rest.split(",")]
        out.append((name, [(n, [codes[i : i + CODE] for i in range(0, len(codes), CODE)]) for n, _, codes in paragraphs]))
    return out


def _share(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    if not total:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total


def _alike(a: Print, b: Print) -> float:
    if a.text[:32] == b.text[:32]:
        return 1.0
    return (1 - ORDER) * _share(a.leaves, b.leaves) + ORDER * _share(a.nodes, b.nodes)


def _counted(print_: str) -> Print:
    sections = _sections(print_)
    nodes = Counter([print_[:32], *(n + "=" for n, _ in sections), *(n for _, ps in sections for n, _ in ps)])
    return Print(print_, Counter(x for _, ps in sections for _, p in ps for x in p), nodes)


def likeness(a: str, b: str) -> float:
    """Shared leaves of two fingerprints, as a Dice share from 0 to 1, and by ORDER the shared nodes above
    them; 1 for equal roots only."""
    return _alike(_counted(a), _counted(b))


class Edit(NamedTuple):
    """A difference: ``changed``, ``deleted``, ``added`` or ``moved``, with its (section, paragraph, leaf)
    in either text, None where it has none. The place after a paragraph's last leaf is the paragraph's end."""

    kind: str
    before: tuple[int, int, int] | None
    after: tuple[int, int, int] | None


def _differing(a: list, b: list) -> Iterator[tuple[slice, slice]]:
    """Stretches of two aligned lists that differ."""
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind != "equal":
            yield slice(i, j), slice(k, m)


def locate_edits(a: str, b: str) -> list[Edit]:
    """What leads from ``a`` to ``b``: sections, paragraphs and leaves are aligned in order, and only
    differing stretches are descended into, from section over paragraph to leaf. Leaves that go at one place and come at another have moved."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    left, right = _sections(a), _sections(b)
    paragraphs = lambda sections, span: [((i, j), name, codes) for i in range(span.start, span.stop) for j, (name, codes) in enumerate(sections[i][1])]
    in_them = lambda found: [((*at, k), x) for at, _, codes in found for k, x in enumerate((*codes, ""))]
    stretches = []  # leaves that go and leaves that come, by stretch
    for s, t in _differing([name for name, _ in left], [name for name, _ in right]):
        own, new = paragraphs(left, s), paragraphs(right, t)
        for p, q in _differing([name for _, name, _ in own], [name for _, name, _ in new]):
            gone, come = in_them(own[p]), in_them(new[q])
            stretches += [(gone[u], come[v]) for u, v in _differing([x for _, x in gone], [x for _, x in come])]
    places = defaultdict(deque)  # of leaves that come, by code
    for _, come in stretches:
        for at, x in come:
            if x:
                places[x].append(at)
    out = []
    for gone, _ in stretches:
        for at, x in gone:
            if x and places[x]:
                out.append(Edit("moved", at, places[x].popleft()))
    before, after = {e.before for e in out}, {e.after for e in out}
    for gone, come in stretches:
        pairs = zip_longest([at for at, _ in gone if at not in before], [at for at, _ in come if at not in after])
        out += [Edit("changed" if x and y else "deleted" if x else "added", x, y) for x, y in pairs]
    return out


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, the borrowed first row of the following bucket last."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    out: list[tuple] = []
    held: tuple | None = None
    size = 0

    def close(row: tuple, text: str, mark: Print) -> tuple:
        doc_id, own_text, own = row[1:]
        changed = edited(own_text, text)
        other = describe(changed)
        return (doc_id, len(own_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.text, other.text, _alike(own, other), _alike(own, mark))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
        out.clear()
        return batch

    for batch in batches:
        for bucket, borrowed, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("borrowed").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            if held is not None and held[0] != bucket:
                raise ValueError(f"bucket {held[0]} has no row that follows it")
            if borrowed and held is None:  # a second borrowed row: copies of the id that follows
                continue
            mark = describe(text)
            if held is not None:
                out.append(close(held, text, mark))
                size += len(out[-1][3]) + len(out[-1][4])
            held = None if borrowed else (bucket, doc_id, text, mark)
            if size > 4_000_000:
                yield flush()
                size = 0
    if held is not None:
        raise ValueError(f"bucket {held[0]} has no row that follows it")
    if out:
        yield flush()


def fingerprint_chain(docs: DataFrame, rows_per_bucket: int = 1000) -> DataFrame:
    """Fingerprint every text and its edited text, with the likeness to that and to the next text.

    The next document is the next doc_id in ascending order; after the last comes the first.
    Null texts count as empty, null ids come first and are returned as null, rows that share an
    id follow in text order. Empty against empty is 1. An empty table gives an empty result.

    Texts are dealt once, by ranges of doc_id whose bounds are percentiles of all ids (their
    number follows the row count). Each range also borrows the first row of the range after it,
    so no range needs another, and rows stream through sorted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    buckets = min(20_000, max(1, n // rows_per_bucket))
    steps = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(rows.agg(F.percentile_approx("doc_id", steps, 100_000)).first()[0] or [])) if steps else []
    stride = int(len(edges) ** 0.5) + 1
    past = lambda values, key: F.aggregate(F.lit(values), F.lit(0), lambda n, e: n + (e <= key).cast("int"))

    def bucket_of(key):  # how many edges are at or below the key: among every stride-th one, then among those after it
        if not edges:
            return F.lit(0)
        coarse = past(edges[::stride], key)
        fine = F.aggregate(F.slice(F.lit(edges), F.greatest(coarse - 1, F.lit(0)) * stride + 1, F.lit(stride)), F.lit(0), lambda n, e: n + (e <= key).cast("int"))
        return F.when(key.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * stride + fine)

    placed = rows.withColumn("bucket", bucket_of(F.col("doc_id"))).withColumn("borrowed", F.lit(False))
    firsts = placed.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()
    order = [(r["bucket"], None if r["nulls"] else r["first"]) for r in firsts]  # one row for each range: bounded by `buckets`
    lenders = [(order[(i + 1) % len(order)][1], b) for i, (b, _) in enumerate(order)]
    ids = [x for x, _ in lenders if x is not None]
    wanted = F.col("doc_id").isin(ids)
    if any(x is None for x, _ in lenders):
        wanted = wanted | F.col("doc_id").isNull()
    to = spark.createDataFrame(lenders, "lent long, to_bucket int")
    lent = rows.filter(wanted).join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("lent"))).select("doc_id", "text", F.col("to_bucket").alias("bucket"), F.lit(True).alias("borrowed"))
    dealt = placed.unionByName(lent).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "bucket")
    return dealt.sortWithinPartitions("bucket", "borrowed", "doc_id", "text").mapInArrow(worker_pass(_stream), SCHEMA)


def op1_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(documents(spark, sf_dir))
