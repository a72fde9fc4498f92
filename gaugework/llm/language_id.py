"""Language identification by bit-sliced Bloom filters over character n-grams.

Place p of the filter holds a word of one bit a language; a language's filter is its bit over all places. An n-gram's
few places, and-ed, give the mask of all languages that contain it, in one look-up. A text's n-grams are counted by
language; what false positives would give is taken off (each language's own rate follows from how full its bits are),
and the largest corrected count decides. The score is that count as a share of the text's n-grams.

n-grams are windows over lower-cased letters; any run of other characters counts as one boundary, which an n-gram may
have at its ends only. A language contains an n-gram if it is a share of ``least`` or more of its n-grams and at least
``ratio`` of the share in any other language.

Edge cases: a null text and one without a letter are ``und`` with score 0, and so is every text if no row has a
language; texts of any length are read whole, in pieces cut at boundaries; repeated rows each get a row; ties go to the
language first by code point; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import give_back, small_batches, written

PIECE, WORD_BITS = 1 << 19, 60
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers, one for each look-up of an n-gram.
PROBES = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


@functools.cache
def folded_letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of a bounded length, cut at boundaries where there are any."""
    at = 0
    while len(text) - at > PIECE:
        cut = next((m.start() for m in re.compile(r"[^\w]|\d").finditer(text, at + PIECE, at + 2 * PIECE)), at + PIECE)
        yield text[at:cut]
        at = cut
    yield text[at:]


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, and the numbers of the texts that they are from."""
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    where = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.repeat(np.arange(len(texts)), np.diff(where))
    fold = folded_letters()[codes]
    keep = np.empty(len(fold), bool)
    keep[0] = True
    np.logical_or(fold[1:], fold[:-1], out=keep[1:])  # one boundary for a run of them
    letters = fold[keep].astype(np.uint64)
    owner = np.append(owner, len(texts) - 1)[keep]
    count = len(letters) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, inside = letters[:count] + np.uint64(1), np.ones(count, bool)
    for k in range(1, n):
        own = letters[k : k + count]
        h = (h * MIX) ^ (own + np.uint64(1))
        h ^= h >> np.uint64(29)
        if k < n - 1:
            inside &= own != 0
    # a window belongs to the text of its second character: the first may be the boundary before it
    return h[inside] * MIX, owner[1 : count + 1][inside] if n > 1 else owner[:count][inside]


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(((h ^ (h >> np.uint64(31))) * p) >> np.uint64(64 - bits)).astype(np.int64) for p in PROBES]


class LanguageFilter:
    """words[w][p]: at place p, bit l % 60 of word l // 60 says that language l may contain an n-gram with this place."""

    def __init__(self, languages: list[str], words: np.ndarray, orders: tuple[int, ...]):
        self.languages, self.words, self.orders, self.bits = languages, words, orders, int(math.log2(words.shape[1]))
        full = [((words[k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.false = np.array(full) ** len(PROBES)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Words of the languages that contain each n-gram."""
        first, *rest = places(h, self.bits)
        out = self.words[:, first]
        for p in rest:
            out &= self.words[:, p]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and of those the ones of each language."""
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        for n in self.orders:
            h, owner = grams(texts, n)
            if not len(h):
                continue
            total += np.bincount(owner, minlength=len(texts))
            masks = self.masks(h)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            for k in range(len(self.languages)):
                bit = (masks[k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(1)
                hits[owner[starts], k] += np.add.reduceat(bit, starts).astype(np.int64)
        return total, hits

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parts, of = [], []
        for i, t in enumerate(texts):
            for p in pieces(t or ""):
                parts.append(p)
                of.append(i)
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to]) <= PIECE):
                size += len(parts[to])
                to += 1
            t, h = self.counts(parts[at:to])
            np.add.at(total, of[at:to], t)
            np.add.at(hits, of[at:to], h)
            at = to
        lacking = np.array([not t or not any(map(str.isalpha, t)) for t in texts])
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        own = np.maximum(hits - total[:, None] * self.false, 0) / (1 - self.false)
        best = own.argmax(1)
        score = np.minimum(own[np.arange(len(texts)), best] / np.maximum(total, 1), 1.0)
        return [("und", 0.0) if no else (self.languages[k], float(s)) for no, k, s in zip(lacking, best, score, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(
    docs: DataFrame, rows: int = 2000, orders: tuple[int, ...] = (3, 4), bits: int = 20, least: float = 1e-5, ratio: float = 0.25
) -> LanguageFilter:
    """Learns from about ``rows`` of the given rows a language, chosen by a hash of the doc_id: the bound of what is read.

    The n-grams of the chosen texts are counted on Spark; a language has at most 1 / ``least`` of each order, and
    the filter has 2 ** ``bits`` places, however large the corpus is.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << bits), np.uint64), orders)
    share = F.element_at(F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows / sizes[k]))))), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            parts = [(x, p) for x, t in zip(langs, b.column(1).to_pylist(), strict=True) for p in pieces(t)]
            for lang in dict.fromkeys(langs):
                own = [p for x, p in parts if x == lang]
                while own:
                    now, size = [], 0
                    while own and (not now or size + len(own[-1]) <= PIECE):
                        size += len(own[-1])
                        now.append(own.pop())
                    for n in orders:
                        h, c = np.unique(grams(now, n)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(h), pa.string()), pa.array([n] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(c)],
                            ["lang", "order", "gram", "n"]
                        )
        give_back()

    found = chosen.select("lang", "text").mapInArrow(
        count, "lang string, order int, gram long, n long"
    ).groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    found = written(found, "language-grams")
    totals = {(r["lang"], r["order"]): r["n"] for r in found.groupBy("lang", "order").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter([], np.zeros((1, 1 << bits), np.uint64), orders)
    total = F.element_at(F.create_map(*(x for (k, n), c in totals.items() for x in (F.lit(f"{n}:{k}"), F.lit(c)))), F.concat_ws(":", "order", "lang"))
    part = found.select("order", "gram", "lang", (F.col("n") / total).alias("part")).where(F.col("part") >= least)
    most = part.groupBy("order", "gram").agg(
        F.max("part").alias("most"), F.collect_list(F.struct("lang", "part")).alias("all")
    )  # one entry a language
    member = most.select("gram", "most", F.inline("all")).where(F.col("part") >= ratio * F.col("most"))
    number = F.element_at(F.create_map(*(x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i)))), F.col("lang"))
    width = -(-len(languages) // WORD_BITS)
    words = [F.bit_or(F.when(
        F.floor(number / WORD_BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (number % WORD_BITS).cast("int"))
    ).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(width)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for p in places(h, bits):
                yield pa.RecordBatch.from_arrays([pa.array(p), *b.columns[1:]], ["place", *(f"w{w}" for w in range(width))])

    each = member.groupBy("gram").agg(*words)
    kinds = ", ".join(f"w{w} long" for w in range(width))
    filled = each.mapInArrow(
        place, f"place long, {kinds}"
    ).groupBy("place").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(width))).toArrow()  # 2 ** bits rows at most
    out = np.zeros((width, 1 << bits), np.uint64)
    for w in range(width):
        out[w, filled.column("place").to_numpy()] = filled.column(f"w{w}").to_numpy().view(np.uint64)
    return LanguageFilter(languages, out, orders)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"]
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: LanguageFilter, least_score: float = 0.25) -> DataFrame:
    """The documents without those that have no letter, or less than ``least_score`` of their n-grams in the language that
    they are nearest to: other scripts and languages, strings of random letters. Half of a text in one known language is enough."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = held.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least_score for x, s in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
