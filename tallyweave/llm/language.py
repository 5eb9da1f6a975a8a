"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

A word's score for a language is the log likelihood of its character n-grams there. The script
of its letters leaves only languages seen in that script. Over a text's words the best path
through the languages, with a penalty for every switch, gives the spans; the language that
holds most letters is the text's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, worker_pass

BUCKETS = 1 << 15
#: Documents from which the n-gram counts come, at most about.
SAMPLE = 12_000
SWITCH = 9.0
NONE = "und"
#: First code points of ranges of the Unicode standard and their scripts, up to the next range.
SCRIPTS = (
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"),
    (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"),
    (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(b) for _, b in SCRIPTS])
#: Letters only: the general categories L; re's own classes take numbers like ½, ² and Ⅷ for letters. None are beyond plane 1.
_NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD, _STRICT, _ODD = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMBERS}]+"), frozenset(_NUMBERS)
_EDGE = "\x01"


def _words(text: str) -> re.Pattern:
    """The pattern of words for this text: the strict one, which is slow, only where numbers may pass for letters."""
    return _WORD if text.isascii() or _ODD.isdisjoint(text) else _STRICT


class _Numbered(dict):
    """Numbers of words, equal for words of one lower-case form; ``forms`` has those in order."""

    def __init__(self):
        super().__init__()
        self.forms: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = number = self.forms.setdefault(word.lower(), len(self.forms))
        return number


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 2- to 4-grams of every word with its edges, the word of each, and each word's script."""
    codes = np.frombuffer((_EDGE + _EDGE.join(words) + _EDGE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    edge = codes == 1
    word = np.cumsum(edge) - 1
    buckets, owners = [], []
    inner = np.ones(len(codes) + 4, dtype=bool)
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    for k in (2, 3, 4):
        n = len(codes) - k + 1
        if n <= 0:
            break
        mixed = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            mixed = (mixed ^ h[j : j + n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
            mixed ^= mixed >> np.uint64(29)
        if k > 2:
            inner = inner[:n] & ~edge[k - 2 : k - 2 + n]
            good = inner
        else:
            good = np.ones(n, dtype=bool)
        buckets.append((mixed >> np.uint64(17))[good] % np.uint64(BUCKETS))
        owners.append(word[:n][good])
    first = codes[np.flatnonzero(edge)[:-1] + 1]
    script = _SCRIPT[np.searchsorted(_STARTS, first, "right") - 1]
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), script


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (buckets, languages), float32
    allowed: np.ndarray  # (scripts, languages): may words of the script be of the language

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages); languages that the word's script rules out score far below the others."""
        buckets, owner, script = _grams(words)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        sums = np.add.reduceat(self.logs[buckets[order]], starts, axis=0) / 3
        sums -= sums.max(axis=1, keepdims=True)
        return np.maximum(sums, -6.0) - np.where(self.allowed[script], 0.0, 12.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Count n-grams by language over a hashed sample of about ``sample`` rows with text and lang.

    Tasks send one array of BUCKETS counts for each language and the letters by script; there are
    four tasks. No usable row gives a model without languages.
    """
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    of = max(1, -(-usable.count() // sample))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for frame in batches:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                words.setdefault(lang, Counter()).update(_words(text).findall(text.lower()))
        for lang, found in words.items():
            counts, scripts = np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(_NAMES), dtype=np.int64)
            if found:
                names = list(found)
                times = np.array([found[w] for w in names])
                buckets, owner, script = _grams(names)
                np.add.at(counts, buckets, times[owner])
                np.add.at(scripts, script, times)
            yield pd.DataFrame({"lang": [lang], "counts": [counts.astype(np.int32).tobytes()], "scripts": [scripts.tobytes()]})

    parts = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(of)) == 0).select("lang", "text").repartition(4)
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for row in parts.mapInPandas(worker_pass(count), "lang string, counts binary, scripts binary").collect():
        counts[row.lang] = counts.get(row.lang, 0) + np.frombuffer(row.counts, dtype=np.int32).astype(np.int64)
        scripts[row.lang] = scripts.get(row.lang, 0) + np.frombuffer(row.scripts, dtype=np.int64)
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    table = np.stack([counts[x] for x in languages], axis=1) + 0.2
    seen = np.stack([scripts[x] for x in languages], axis=1)
    allowed = seen > 0.01 * np.maximum(seen.sum(axis=0, keepdims=True), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), allowed)


def best_paths(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of languages for every (words, languages) matrix.

    Where leaving the best single language for any stretch gains less than one switch costs, that
    language throughout is the best path; Viterbi runs over the others at once, longest first.
    """
    paths: list[np.ndarray | None] = [None] * len(scores)
    hard = []
    for i, s in enumerate(scores):
        single = int(s.sum(axis=0).argmax())
        gain = np.cumsum((s - s[:, [single]]).max(axis=1))
        if (gain - np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))).max() < switch:
            paths[i] = np.full(len(s), single)
        else:
            hard.append(i)
    hard.sort(key=lambda i: -len(scores[i]))
    if hard:
        lengths = np.array([len(scores[i]) for i in hard])
        n = scores[hard[0]].shape[1]
        flat = np.concatenate([scores[i] for i in hard])
        first = np.cumsum(lengths) - lengths
        state = flat[first]
        back = []
        for t in range(1, lengths[0]):
            live = int(np.searchsorted(-lengths, -t, "left"))  # texts of more than t words
            now = state[:live]
            top = now.argmax(axis=1)
            leave = now[np.arange(live), top][:, None] - switch
            stay = now >= leave
            back.append(np.where(stay, np.arange(n), top[:, None]).astype(np.int16))
            state[:live] = np.where(stay, now, leave) + flat[first[:live] + t]
        for k, i in enumerate(hard):
            path = np.empty(lengths[k], dtype=np.int64)
            path[-1] = state[k].argmax()
            for t in range(lengths[k] - 1, 0, -1):
                path[t - 1] = back[t - 1][k][path[t]]
            paths[i] = path
    return paths


def _spans(text: str, words: list[str], path: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """Runs of words of one language on the path, as (first character, end, language)."""
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    if len(cuts) == 2:  # from the first word to the last, after which no letter stands
        return [(text.index(words[0]), text.rindex(words[-1]) + len(words[-1]), languages[path[0]])]
    at = [m.span() for m in _words(text).finditer(text)]
    return [(at[a][0], at[b - 1][1], languages[path[a]]) for a, b in zip(cuts, cuts[1:])]


def label_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans as (first character, end, language)) of every text."""
    words = [_words(x).findall(x) if x and model.languages else [] for x in texts]
    numbers = _Numbered()
    rows = [np.array([numbers[w] for w in found]) for found in words]
    full = [i for i, r in enumerate(words) if r]
    out: list[tuple[str, float, list]] = [(NONE, 0.0, [])] * len(texts)
    if not full:
        return out
    of_word = model.scores(list(numbers.forms))
    scores = [of_word[rows[i]] for i in full]
    for i, s, path in zip(full, scores, best_paths(scores), strict=True):
        letters = np.bincount(path, weights=[len(w) for w in words[i]], minlength=len(model.languages))
        best = int(letters.argmax())
        own = path == best
        margin = s[own].sum(axis=0)
        rest = np.delete(margin[best] - margin, best)
        sure = 1 / (1 + np.exp(-min(30.0, rest.min() / 4))) if len(rest) else 1.0
        out[i] = (model.languages[best], float(sure * letters[best] / letters.sum()), _spans(texts[i], words[i], path, model.languages))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row, in one map-side pass over whole texts.

    Null texts and texts without letters are ``und`` with score 0 and no spans, as is every text
    under a model without languages. Ties go to the language first in order; copies are labelled alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = label_texts(shared.value, batch.column("text").to_pylist())
                spans = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(worker_pass(run), "doc_id long, lang_pred string, score double, spans array<struct<start int, end int, lang string>>")


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
