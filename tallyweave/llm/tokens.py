"""Token ids and token counts through caches of pre-tokens.

Both tokenizers here never join across a pre-token's edge, so a text's ids are those of its
pre-tokens in order. Texts that hold characters on which Python and the tokenizer may disagree
about white space go to the library whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, worker_cache, worker_pass

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Bytes that a worker's cache takes at most; when it is full it starts anew. Longer words are never kept.
CACHE_BYTES, LONGEST = 64 << 20, 64
_ENTRY = 190  # bytes of an entry beside its characters
#: Documents whose pre-tokens decide which ones are frequent, and entries of the table sent to all workers.
SAMPLE, FREQUENT = 4000, 20_000
LIMIT = 4096
_ODD = re.compile("[\x1c-\x1f\x00]")


def vocabulary(name: str) -> str:
    """Place of a vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The character that byte-level models write for each byte: itself if printable, else one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Cache(dict):
    """What words come to, within a bound of bytes; when it is full it starts anew."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most = self.room = most

    def keep(self, word: str, value) -> None:
        if len(word) <= LONGEST:
            self[word] = value
            self.settle((word,))

    def settle(self, added) -> None:
        """Counts words that were just put in, and drops those that are too long."""
        for word in added:
            if len(word) > LONGEST:
                self.pop(word, None)
            else:
                self.room -= _ENTRY + 2 * len(word)
        if self.room < 0:
            self.clear()
            self.room = self.most


class WordIds:
    """Ids of a lower-casing, white-space-dropping BPE as little-endian unsigned 32-bit bytes.

    Words are cached whole. A new word of Latin letters and closing marks is put together from
    its letters and its marks, which the model takes as pre-tokens of their own; all other words
    go through the library's whole pipeline.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ʯ]+)([.,;:!?]*)")

    def __init__(self, name: str = WORD_BPE, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known, self.parts = Cache(cache_bytes), Cache(cache_bytes // 2)

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        if not part:
            return b""
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            self.parts.keep(part, ids)
        return ids

    def word(self, word: str) -> bytes:
        plain = self.PLAIN.fullmatch(word)
        if plain:
            letters = plain[1].lower()
            if len(letters) == len(plain[1]):  # one letter becomes two under lower()
                return self.part(letters) + self.part(plain[2])
        return self.whole(word)

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        words, known = text.split(), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        fresh = {w for w in words if w not in known}
        for w in fresh:
            known[w] = self.word(w)
        out = b"".join([known[w] for w in words])
        known.settle(fresh)
        return out


class PieceCounts:
    """Token counts of a SentencePiece BPE whose pieces hold spaces at their start only.

    A pre-token is a run of spaces and the word after it. Lines are apart, since no piece holds a
    line break beside other characters; a line's first word has no space before it, except for
    the first line's, which the model gives one.
    """

    RUNS = re.compile(" *[^ ]+| +$")

    def __init__(self, name: str = PIECE_BPE, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        self.frequent = frequent or {}
        self.own = Cache()
        self.before = len(self.model.encode("\n"))
        self.break_tokens = self.bare("\n")

    def bare(self, text: str) -> int:
        """Tokens of a text without the space that the model puts before it."""
        return len(self.model.encode("\n" + text)) - self.before

    def one(self, unit: str) -> int:
        n = self.frequent.get(unit)
        if n is None:
            n = self.own.get(unit)
            if n is None:
                n = self.bare(unit)
                self.own.keep(unit, n)
        return n

    @classmethod
    def units(cls, text: str) -> Iterator[list[str]]:
        """Pre-tokens of each line."""
        for line in (" " + text.replace("▁", " ")).split("\n"):
            yield cls.RUNS.findall(line)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if "\x00" in text:
            return len(self.model.encode(text))
        total = text.count("\n") * self.break_tokens
        frequent, own = self.frequent.get, self.own
        for units in self.units(text):
            for unit in units:
                n = frequent(unit)
                total += (own.get(unit) or self.one(unit)) if n is None else n
        return total


def _frequent_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            for units in PieceCounts.units(text.as_py() or ""):
                found.update(units)
    if found:
        top = found.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]]), pa.array([[n for _, n in top]])], names=["unit", "n"])


def frequent_lengths(docs: DataFrame, model: str = PIECE_BPE) -> dict[str, int]:
    """Token counts of the pre-tokens most frequent in a hashed sample of about SAMPLE documents.

    This table only saves work: results are the same with any table, or none. Tasks that hold a
    document of the sample send one list of their own, so what is sent is bounded by the sample.
    """
    of = max(1, -(-docs.count() // SAMPLE))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(of)) == 0).select("text")
    found: Counter = Counter()
    for row in sample.mapInArrow(worker_pass(_frequent_part), "unit array<string>, n array<long>").collect():
        found.update(dict(zip(row.unit, row.n, strict=True)))
    counts = PieceCounts(model)
    return {unit: counts.one(unit) for unit, n in found.most_common(FREQUENT) if n > 1}


def token_counts(docs: DataFrame, model: str = PIECE_BPE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, in one map-side pass.

    Two tiers of lookup: a broadcast table of frequent pre-tokens (FREQUENT entries at most),
    then the worker's own cache, then the library; no pre-token is shuffled. Null and empty
    texts have 0 bytes and tokens; repeated rows come out as often as they come in.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Callable[[str], int] = worker_cache(f"pieces {model}", lambda: PieceCounts(model, shared.value))
        for batch in batches:
            ids, n_bytes, n_tokens = batch.column("doc_id"), [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(worker_pass(run, cached=True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
