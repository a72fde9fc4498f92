"""SimHash near-duplicates: fingerprints, links at a small Hamming distance by deletion-variant signatures, components.

A fingerprint is cut into fewer segments than usual, so that in two fingerprints that link one segment differs by at
most one bit. Every segment is indexed in all its one-wildcard variants (one bit left out); fingerprints that share a
variant meet by an equality join and are verified. A variant that more than ``bucket`` different fingerprints share is
not joined with itself: its members are indexed once more with a second wildcard. Who shares such a key differs in the
two left-out bits at most, so each links to the smallest member, and no two different fingerprints lose their link's
component.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle count as one
shingle; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm import files
from gaugework.llm.common import MADE, give_back, scratch, small_batches, texts, written
from gaugework.session import names_in, work_dir


def fingerprint_of(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if it is set in over half the shingles' XXH64 values."""
    import numpy as np
    import xxhash

    w = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(w[k : k + words]), seed) for k in range(max(1, len(w) - words + 1))], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_of(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        give_back()

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, fp long")


def _low(segment: str) -> Column:
    return F.shiftrightunsigned("fp", 32) if segment == "high" else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def variants(fps: DataFrame) -> DataFrame:
    """fp, key: both 32-bit segments with each bit left out in turn. key holds the segment (0 or 1) and the bit above the rest."""
    halves = fps.select(
        "fp",
        F.explode(F.array(
            F.struct(F.lit(0).alias("seg"), _low("low").alias("part")), F.struct(F.lit(1).alias("seg"), _low("high").alias("part"))
        )).alias("s")
    )
    each = halves.select("fp", "s.seg", "s.part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("wild"))
    place = F.call_function("shiftleft", (F.col("seg") * 32 + F.col("wild")).cast("long"), F.lit(32))
    return each.select("fp", place.bitwiseOR(_without(F.col("part"), F.col("wild"))).alias("key"))


def links(fps: DataFrame, bucket: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at 2 or fewer differing bits: every component of the full link graph is one of theirs."""
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fps.count() * 64 // 1_000_000)
    v = variants(fps).repartition(parts, "key")  # dealt out once: the counts and the join below both read it
    shared = v.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("shuffle_hash")
    place = F.shiftright("key", 32)
    met = written(
        v.join(shared, "key").select("fp", "key", "n", F.floor(place / 32).alias("seg"), (place % 32).cast("int").alias("wild")), "simhash-met"
    )
    some, hot = met.where(F.col("n") <= bucket), met.where(F.col("n") > bucket)
    # segments that are equal share all 32 variants: that pair is made at the first only
    part = F.when(
        F.col("x.seg") == 1, F.shiftrightunsigned(F.col("x.fp").bitwiseXOR(F.col("y.fp")), 32)
    ).otherwise(F.col("x.fp").bitwiseXOR(F.col("y.fp")).bitwiseAND(F.lit(0xFFFFFFFF)))
    once = (part != 0) | (F.col("x.wild") == 0)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2
    pairs = some.alias("x").join(
        some.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near & once
    ).select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b"))
    other = F.when(F.col("seg") == 0, _low("high")).otherwise(_low("low"))
    own = F.when(F.col("seg") == 0, _low("low")).otherwise(_low("high"))
    one = hot.select("fp", "key", other.alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("w1")).select(
        "fp", "key", (F.col("w1") - 64).cast("long").alias("w"), _without(F.col("rest"), F.col("w1")).alias("rest")
    )
    pairs_of_bits = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: i * 32 + j)))
    two = hot.where("wild = 0").select("fp", "seg", own.alias("own"), other.alias("rest"), F.explode(pairs_of_bits).alias("w"))
    two = two.select(
        "fp", F.col("own").bitwiseOR(F.call_function("shiftleft", (F.col("seg") + 64).cast("long"), F.lit(32))).alias("key"),
        F.col("w").cast("long").alias("w"), _without(_without(F.col("rest"), F.floor(F.col("w") / 32).cast("int")), F.col("w") % 32).alias("rest")
    )
    keyed = one.unionByName(two)
    least = keyed.groupBy("key", "w", "rest").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keyed.join(least, ["key", "w", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) of every node that an edge (a, b) names: large and small stars in turn."""
    spark = edges.sparkSession
    with scratch(spark):
        now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)))
        before = None
        while (state := now.agg(mark).first()[0]) != before and state[0]:
            before = state
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = written(large, "large")
            least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return written(nodes.unionByName(now.select("b", "b").distinct().toDF("node", "root")), "components")


def simhash_components(docs: DataFrame, words: int = 3, seed: int = 42, bucket: int = 256) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included)."""
    rows = written(fingerprints(docs, words, seed), "simhash-rows")
    with scratch(docs.sparkSession):
        fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-fps")
        roots = components(links(fps.select("fp"), bucket))
        of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
        of = written(of, "simhash-of")
        least = of.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        ids = written(of.join(least, "root").select("fp", "component_id"), "simhash-ids")
    return rows.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def shingles(text: str, words: int = 5) -> set[bytes]:
    """The word shingles of a text; fewer words than a shingle count as one, no word as none."""
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose number is among ``ids`` (column row in both, from monotonically_increasing_id, so that the high bits
    are a partition), without dealing the rows out: ids are written by partition, and a task reads those that it meets.
    Other columns of ids, longs of which a number has one, come behind those of the rows."""
    path, at = work_dir(rows.sparkSession, "picked"), rows.columns.index("row")
    part, more = F.shiftright("row", 33), [c for c in ids.columns if c != "row"]
    ids.select("row", *more, part.alias("part")).repartition("part").write.partitionBy("part").parquet(path)
    MADE.append(path)
    wanted = {int(n[5:]) for n in names_in(rows.sparkSession, path) if n.startswith("part=")}  # a partition each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            row, keep = b.column(at).to_numpy(), np.zeros(b.num_rows, bool)
            own = [np.zeros(b.num_rows, np.int64) for _ in more]
            for p in np.unique(row >> 33).tolist():
                if p not in held:
                    if len(held) > 8:
                        held.clear()
                    columns = [files.column(f"{path}/part={p}", c) if p in wanted else np.zeros(0, np.int64) for c in ("row", *more)]
                    order = np.argsort(columns[0], kind="stable")
                    held[p] = [c[order] for c in columns]
                if len(there := held[p][0]):
                    k = np.minimum(np.searchsorted(there, row), len(there) - 1)
                    found = there[k] == row
                    keep |= found
                    for column, values in zip(own, held[p][1:], strict=True):
                        column[found] = values[k[found]]
            b = pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own)], [*b.schema.names, *more])
            yield b.filter(pa.array(keep))
        give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in more)]))


def cut(rows: int, least: float, missed: float = 0.0005) -> tuple[int, int]:
    """Width (even) and number of the segments of long fingerprints: about as many values as rows, and so many segments that of
    the pairs of similarity ``least`` a share of ``missed`` has no segment that differs by at most one bit."""
    width = max(12, math.ceil(math.log2(max(rows, 1))))
    width += width % 2
    p = differing(least)
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, 1 if meet > 1 - missed else math.ceil(math.log(missed) / math.log(1 - meet))


def differing(least: float) -> float:
    """The share of bits in which fingerprints of two sets of one size differ, at this Jaccard similarity (other sizes: fewer)."""
    return math.acos(2 * least / (1 + least)) / math.pi


def farthest(bits: int, least: float) -> int:
    """So many of the bits may differ: five standard deviations over the mean at this similarity."""
    p = differing(least)
    return math.floor(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


def long_fingerprint(h, longs: int):
    """``longs`` x 64 bits, each 1 if it is set in over half the hashes: the hashes themselves, as in fingerprint_of, then mixes of them."""
    import numpy as np

    factors = np.random.default_rng(42).integers(0, 1 << 64, longs - 1, np.uint64) | np.uint64(1)
    ones = np.zeros(64 * longs, np.int64)
    for at in range(0, len(h), 255):  # counts of a block fit a byte
        x = h[at : at + 255, None] * factors
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x = np.concatenate([h[at : at + 255, None], x], 1)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def near_rows(rows: DataFrame, words: int, longs: int, seed: int = 42) -> DataFrame:
    """row, node (a hash of the text's set of shingles), n (the set's size) and bits (its long fingerprint). rows: row, text."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            nodes, sizes, bits = [], [], []
            for t in b.column(1).to_pylist():
                h = np.unique(np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles(t or "", words)], "<u8"))
                nodes.append(signed(xxhash.xxh64_intdigest(h.tobytes(), seed)))
                sizes.append(len(h))
                bits.append(long_fingerprint(h, longs).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["row", "node", "n", "bits"]
            )
        give_back()

    return rows.select("row", "text").mapInArrow(run, "row long, node long, n long, bits binary")


def segment_halves(nodes: DataFrame, width: int, segments: int, parts: int) -> DataFrame:
    """Each segment of each fingerprint twice, by its lower and by its upper half, as in segments that differ by one bit one half is
    equal. part: by segment, which half and that half; entries: numbers, four a row: value (these and the other half), node, and
    128 bits to look at; some hundreds of rows together. nodes: node, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        half, seg = width // 2, np.arange(segments)

        def dealt(node, own):
            bits = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")[:, : segments * width].reshape(len(own), segments, width)
            low, high = bits[:, :, :half] @ (1 << np.arange(half)), bits[:, :, half:] @ (1 << np.arange(half))
            value = np.concatenate([((seg * 2 << half) + low << half) + high, ((seg * 2 + 1 << half) + high << half) + low], 1).ravel()
            part = (value >> half) % parts
            order = np.argsort(part, kind="stable")
            doc = order // (2 * segments)
            entries = np.stack([value[order], node[doc], own[doc, 0].view("<i8"), own[doc, 1].view("<i8")], 1)
            there, first = np.unique(part[order], return_index=True)
            blocks = [entries[lo:hi].tobytes() for lo, hi in zip(first, [*first[1:], len(entries)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array(blocks, pa.binary())], ["part", "entries"])

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), b"".join(batch.column(1).to_pylist())))
            n += batch.num_rows
            if n * segments > 1 << 17:
                yield dealt(np.concatenate([k for k, _ in held]), np.frombuffer(b"".join(x for _, x in held), "<u8").reshape(n, -1))
                held, n = [], 0
        if n:
            yield dealt(np.concatenate([k for k, _ in held]), np.frombuffer(b"".join(x for _, x in held), "<u8").reshape(n, -1))
        give_back()

    return nodes.mapInArrow(run, "part long, entries binary").repartition(parts, "part")


def near_values(value, bits, half: int, most: int):
    """Pairs (x, y) of places in the sorted values: they share all but at most one bit of the last half, and at most ``most`` of
    128 bits differ. Of two values with over 2^16 pairs, instead of these: whoever has such a partner, in a chain."""
    import numpy as np

    def apart(x, y):
        return np.bitwise_count(bits[0][x] ^ bits[0][y]).astype(np.int16) + np.bitwise_count(bits[1][x] ^ bits[1][y])

    def partnered(x, y):
        """Those of x that have one of y near: most are near one of the first, the others meet all."""
        left, lo = x, 0
        while len(left) and lo < len(y):
            some = y[lo : lo + (2048 if lo else 64)]
            near = [((apart(part[:, None], some) <= most) & (part[:, None] != some)).any(1) for k in range(0, len(left), 1024) if len(part := left[k : k + 1024])]
            left, lo = left[~np.concatenate(near)], lo + len(some)
        return np.setdiff1d(x, left, assume_unique=True)

    different, first, count = np.unique(value, return_index=True, return_counts=True)
    place = np.arange(len(different))
    met = [(place[count > 1], place[count > 1])]
    for wild in range(half):
        i = place[different >> wild & 1 == 0]
        j = np.minimum(np.searchsorted(different, different[i] | 1 << wild), len(different) - 1)
        same = different[j] == different[i] | 1 << wild
        met.append((i[same], j[same]))
    # one bit of the lower half: that is seen by the upper half; equal ones are seen by the lower half alone
    i, j = (np.concatenate(ends) for ends in zip(*met, strict=True))
    once = (i != j) | (different[i] >> 2 * half & 1 == 0)
    i, j = i[once], j[once]
    sizes = count[i] * count[j]
    for k in np.flatnonzero(sizes > 1 << 16).tolist():
        x, y = (np.arange(first[v], first[v] + count[v]) for v in (i[k], j[k]))
        both = np.union1d(partnered(x, y), partnered(y, x))
        yield both[:-1], both[1:]
    i, j, sizes = (v[sizes <= 1 << 16] for v in (i, j, sizes))
    turn = np.cumsum(sizes) >> 20
    ends = [*np.flatnonzero(np.diff(turn, prepend=-1)).tolist(), len(turn)]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        n = sizes[lo:hi]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = np.repeat(first[i[lo:hi]], n) + at // np.repeat(count[j[lo:hi]], n)
        y = np.repeat(first[j[lo:hi]], n) + at % np.repeat(count[j[lo:hi]], n)
        near = (x != y) & (apart(x, y) <= most)
        yield x[near], y[near]


def meetings(halves: DataFrame, width: int, most: int) -> DataFrame:
    """node, band (the segment), key, size: who meets in a one-wildcard variant of a segment and is near by 128 bits shares a key.

    A segment's variants with a wildcard in one half lie where the other half is dealt to, so they are made there and not sent.
    A key is all that such pairs connect, of one segment and half.
    """
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(entries)
        for part in list(held):
            rows = np.frombuffer(b"".join(held.pop(part)), "<i8").reshape(-1, 4)
            value, node, *bits = np.ascontiguousarray(rows[np.lexsort((rows[:, 1], rows[:, 0]))].T)
            bits = [x.view("<u8") for x in bits]
            least, met = np.arange(len(node)), np.zeros(len(node), bool)

            def top(x):
                while ((up := least[x]) != x).any():
                    x = up
                return x

            for x, y in near_values(value, bits, half, most):
                met[x] = met[y] = True
                x, y = top(x), top(y)
                while (apart := x != y).any():
                    np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
                    x, y = top(x[apart]), top(y[apart])
            least, who = top(least), np.flatnonzero(met)
            _, group, size = np.unique(least[who], return_inverse=True, return_counts=True)
            first = least[who]
            key = (value[first] >> half) * np.int64(0x1E3779B97F4A7C15) ^ node[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[who]), pa.array(value[who] >> 2 * half + 1), pa.array(key), pa.array(size[group])], ["node", "band", "key", "size"]
            )
        give_back()

    return halves.mapInArrow(run, "node long, band long, key long, size long")


def likely(pairs: DataFrame, near: DataFrame, least: float, bits: int) -> DataFrame:
    """The pairs (a, b) of nodes that can have the similarity by their sizes and by the differing bits of their fingerprints."""
    most = farthest(bits, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(batch.num_rows, -1) for k in (2, 3))
                keep = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= most
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: near.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    met = pairs.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct().join(of("b"), "b").join(of("a"), "a")
    met = met.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9)
    return met.select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, near: DataFrame, texts_of_rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of at least ``least``. near: node, row; the
    texts by row, with their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, x = a, shingles(left, words)
                y = shingles(right, words)
                both = len(x & y)
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())
    asked = near.select("node", "row").join(ends, "node", "left_semi")
    found = written(picked(texts_of_rows, asked.select("row")).select("node", "text"), "near-texts")
    texts_of = lambda c: found.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    met = pairs.join(texts_of("b"), "b").join(texts_of("a").hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(run, "a long, b long")


def other_ends(met: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) a node: with the least or the greatest node, by component, of one of its keys, if that is of another component."""
    ends = met.groupBy("key").agg(
        F.min(F.struct("root", "node")).alias("low"), F.max(F.struct("root", "node")).alias("high")
    ).where("low.root < high.root")
    end = F.when(F.col("root") != F.col("low.root"), F.col("low.node")).otherwise(F.col("high.node"))
    asked = met.join(ends, "key").select("node", end.alias("end"))
    # at first the least node of all, so that a group meets in few nodes; then any other
    order = F.col("end") if not turn else F.xxhash64("end", "node", F.lit(turn))
    return asked.groupBy("node").agg(F.min_by("end", order).alias("end")).select(F.col("node").alias("a"), F.col("end").alias("b"))


def tiles(nodes: Column, n: Column, tile: int, shingles: int = 1 << 20) -> Column:
    """How many tiles of about ``tile`` nodes and ``shingles`` shingles hold so many nodes with n shingles."""
    return F.greatest(F.ceil(nodes / tile), F.ceil(n / shingles), F.lit(1)).cast("long")


def key_links(met: DataFrame) -> DataFrame:
    """Edges (a, b) from each node to the least of each of its keys."""
    low = met.groupBy("key").agg(F.min("node").alias("b"))
    return met.join(low, "key").select(F.col("node").alias("a"), "b")


def in_groups(met: DataFrame, sizes: DataFrame, links: DataFrame, bucket: int, tile: int) -> DataFrame:
    """Of the nodes that links (a, b) name, the rows of met with one key, band -1, for each group (all that the links connect) of up
    to ``bucket`` nodes, or that is sent to no more tiles as a whole than its nodes have keys; those of other groups as they are.
    sizes: node, n."""
    groups = components(links).toDF("node", "group")
    each = met.groupBy("node", "root").agg(F.count("*").alias("keys")).join(groups, "node").join(sizes, "node")
    of = each.groupBy("group").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"), F.sum("keys").alias("keys"))
    whole = of.where((F.col("nodes") <= bucket) | (F.col("nodes") * tiles(F.col("nodes"), F.col("n"), tile) <= F.col("keys"))).select("group")
    as_groups = each.join(whole, "group").select("node", F.lit(-1).cast("long").alias("band"), F.col("group").alias("key"), "root")
    return as_groups.unionByName(met.join(groups.join(whole, "group", "left_anti"), "node").select("node", "band", "key", "root"))


def tile_pairs(met: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Of keys (key, node, root): key, side, left, right, node, root, a row for each pair of tiles that a node is in.

    The nodes of a key that one tile holds are all in it. Those of another are dealt by hash: the major ones, those of the
    component that has most of the key, apart from the others. Tiles of others meet each other and the major ones; major tiles,
    of one component, don't meet. sizes: node, n.
    """
    each = met.join(sizes, "node").select("key", "node", "root", "n")
    by_root = each.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most = F.struct("rows", "root")
    top = by_root.groupBy("key").agg(
        F.max_by("root", most).alias("major"), F.max("rows").alias("r"), F.max_by("n", most).alias("m"), F.sum("rows").alias("rows"), F.sum("n").alias("n")
    )
    top = top.select(
        "key", "major", tiles(F.col("rows"), F.col("n"), tile).alias("all"), tiles(F.col("r"), F.col("m"), tile).alias("majors"),
        tiles(F.col("rows") - F.col("r"), F.col("n") - F.col("m"), tile).alias("others")
    )
    each = each.join(top, "key").withColumn("is_major", F.col("root") == F.col("major"))
    tile = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("others")))
    each = each.withColumn("tile", tile)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda side, left, right: F.struct(F.lit(side).alias("side"), left.alias("left"), right.alias("right"))
    with_majors = F.transform(upto(F.col("majors")), lambda q: pair("major", F.col("tile"), q))
    with_others = F.transform(upto(F.col("others")), lambda q: pair("other", F.least("tile", q), F.greatest("tile", q)))
    of_major = F.transform(upto(F.col("others")), lambda q: pair("major", q, F.col("tile")))
    alone = F.array(pair("all", F.lit(0).cast("long"), F.lit(0).cast("long")))
    pairs = F.when(F.col("all") == 1, alone).when(F.col("is_major"), of_major).otherwise(F.concat(with_majors, with_others))
    return each.select("key", "node", "root", F.explode(pairs).alias("p")).select("key", "p.side", "p.left", "p.right", "node", "root")


def common(sets: list, least_docs: int = 16):
    """How many numbers each two of the sorted sets share, as a square table."""
    import numpy as np

    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    often = np.flatnonzero(count >= least_docs)
    for lo in range(0, len(often), 4096):  # numbers that many sets have: products of 0/1 tables
        place = np.full(len(count), -1)
        own = often[lo : lo + 4096]
        place[own] = np.arange(len(own))
        inside = place[number] >= 0
        table = np.zeros((len(sets), len(own)), np.float32)
        table[doc[inside], place[number[inside]]] = 1
        shared += table @ table.T
    rare = np.flatnonzero((count[number] > 1) & (count[number] < least_docs))
    rare = rare[np.argsort(number[rare], kind="stable")]
    numbers, docs = number[rare], doc[rare]
    for step in range(1, least_docs):  # numbers that few have: each with the next ones of the same number
        same = numbers[step:] == numbers[:-step]
        if not same.any():
            break
        a, b = docs[:-step][same], docs[step:][same]
        np.add.at(shared, (a, b), 1)
        np.add.at(shared, (b, a), 1)
    return shared


def spanning(a, b) -> list[int]:
    """Places of those of the links (a, b) that join what the ones before them have not joined."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def likely_links(groups: DataFrame, near: DataFrame, least: float, bits: int) -> DataFrame:
    """Edges (a, b) that connect all nodes that meet in a pair of tiles, are of different components and can have the similarity
    by their sizes and bits, as in likely(): a spanning forest of such pairs goes on. near: node, n, bits."""
    most = farthest(bits, least)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        root, size = (table.column(c).to_numpy()[first] for c in ("root", "n"))
        held = table.column("bits").to_pylist()
        own = np.frombuffer(b"".join(held[k] for k in first.tolist()), "<u8").reshape(len(node), -1)
        a, b = [], []
        for lo in range(0, len(node), 64):
            x = slice(lo, lo + 64)
            apart = np.bitwise_count(own[x, None] ^ own[None]).sum(2, dtype=np.int64)
            alike = np.minimum(size[x, None], size[None]) >= np.maximum(size[x, None], size[None]) * least - 1e-9
            i, j = np.nonzero((apart <= most) & alike & (root[x, None] != root[None]))
            take = spanning(i + lo, j)
            a.append(node[i[take] + lo])
            b.append(node[j[take]])
        a, b = np.concatenate(a), np.concatenate(b)
        take = spanning(a, b)
        return pa.table({"a": a[take], "b": b[take]})

    rows = groups.join(near.select("node", "n", "bits"), "node")
    return rows.groupBy("key", "side", "left", "right").applyInArrow(run, "a long, b long").distinct()


def within_tiles(groups: DataFrame, hashed: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that join the components that meet in each pair of tiles: every two nodes of different components are
    compared by their whole sets of shingles, and of those that are similar enough a spanning forest goes on. hashed: node, sets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        root, held = table.column("root").to_numpy()[first], table.column("sets").to_pylist()
        sets = [np.frombuffer(held[k], "<u8") for k in first.tolist()]
        size = np.array([len(s) for s in sets], np.float64)
        a, b = np.nonzero(np.triu(root[:, None] != root[None]))
        shared = common(sets)[a, b].astype(np.float64)
        near = shared >= least * (size[a] + size[b] - shared) - 1e-9
        a, b = a[near], b[near]
        pairs = np.unique(np.stack([root[a], root[b]]), axis=1, return_index=True)[1] if len(a) else np.zeros(0, np.int64)
        a, b = a[pairs], b[pairs]
        take = spanning(root[a], root[b])
        if len(node) > 256:
            give_back()
        return pa.table({"a": node[a[take]], "b": node[b[take]]})

    rows = groups.join(hashed, "node")
    return rows.groupBy("key", "side", "left", "right").applyInArrow(run, "a long, b long").distinct()


def near_links(
    rows: DataFrame, marks: DataFrame, words: int, least: float, width: int, segments: int, longs: int, bucket: int, turns: int = 2, tile: int = 1024, places: int = 6
) -> DataFrame:
    """Edges (a, b) between nodes of similarity ``least`` or more that meet in a variant of a segment, one at least for every two
    components that such a pair joins.

    First, in a few turns, every node is compared with one node of another component that shares a key, so that most of a
    group of many near copies takes a few comparisons a node: the whole fingerprints are looked at, then the texts decide. Then
    the nodes that still share a key with another component are compared all with all in tasks, pair of tiles by pair of tiles, and
    no pair is a row: by groups, all that the keys connect, where these are small or their nodes have so many keys that a node
    is sent less often than by key, else by key. By whole fingerprints first; what can be similar by these makes smaller
    groups, of which the sets of shingles are sent: larger ones by key, ``places`` of the segments at a time, until all keys are
    done or of one component. What is of one component by then isn't compared again.
    """
    spark = rows.sparkSession
    with scratch(spark):
        one = marks.groupBy("node").agg(F.min("row").alias("row"))
        nodes = marks.join(one, ["node", "row"], "left_semi").select("node", "bits")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), marks.count() * segments // 100_000)
        met = written(meetings(segment_halves(nodes, width, segments, parts), width, farthest(128, least)), "near-met")
        near = written(marks.join(one.join(met.select("node").distinct(), "node", "left_semi"), ["node", "row"], "left_semi"), "near-nodes")
        of_near = written(picked(rows.select("row", F.coalesce("doc.text", F.lit("")).alias("text")), near.select("row", "node")), "near-texts")
        checked = lambda pairs: written(similar(written(likely(pairs, near, least, 64 * longs), "near-pairs"), near, of_near, words, least), "near-links")

        def joined(met: DataFrame, links: DataFrame) -> DataFrame:
            """The rows of keys that still have several components, once the links have joined some."""
            of = met.select("node", "root").distinct()
            ends = lambda c: of.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            roots = links.join(ends("a"), "a").join(ends("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
            met = met.join(components(roots).toDF("root", "own"), "root", "left").withColumn("root", F.coalesce("own", "root")).drop("own")
            mixed = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
            return written(met.join(mixed, "key").select("node", "band", "key", "root"), "near-met")

        met, found = met.withColumn("root", F.col("node")).select("node", "band", "key", "root"), None
        for turn in range(turns):
            links = checked(other_ends(met, turn))
            found = links if found is None else found.unionByName(links)
            met = joined(met, links)
        sizes = near.select("node", "n")
        pairs = tile_pairs(written(in_groups(met, sizes, key_links(met), bucket, tile), "near-groups"), sizes, tile)
        met = written(in_groups(met, sizes, written(likely_links(pairs, near, least, 64 * longs), "near-likely"), bucket, tile), "near-met")
        bands, links = sorted(r.band for r in met.select("band").distinct().collect()), None  # one a segment at most
        hashed = written(hashed_sets(met.select("node").distinct(), near, of_near, words), "near-sets") if bands else None
        while bands:
            band, met = bands[0], met if links is None else joined(met, links)
            own, bands = met.where(F.col("band").between(band, band + places - 1)), [b for b in bands if b >= band + places]
            links = written(within_tiles(tile_pairs(own, sizes, tile), hashed, least), "near-links")
            found = found.unionByName(links)
        return written(found, "near-edges")


def hashed_sets(nodes: DataFrame, near: DataFrame, texts_of_rows: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """node, sets: the sorted 64-bit hashes of a node's different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for b in batches:
            sets = [np.unique(np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles(t, words)], "<u8")).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "sets"])
        give_back()

    asked = near.select("node", "row").join(nodes, "node", "left_semi")
    # written first: two Python functions in a stage take two workers a task, and an executor keeps them all from then on
    found = written(picked(texts_of_rows, asked.select("row")).select("node", "text"), "near-texts")
    return found.mapInArrow(run, "node long, sets binary")


def keep_one(
    docs: DataFrame, words: int = 5, least: float = 0.8, bucket: int = 64, turns: int = 2, tile: int = 1024
) -> DataFrame:
    """The documents without near-duplicates: of each group of near copies (Jaccard similarity of ``words``-word shingles
    at ``least`` or more, in a chain) one row stays: by the smallest doc_id, null last, then by a hash of the text.
    Of rows of one doc_id, those with different texts all stay, unless they are near copies; so do rows without a doc_id.

    By fingerprints, as simhash_components, but of as many bits as this similarity takes: at 0.8, 15 % of the bits differ.
    They are cut into segments of log2(rows) bits (12 at least), so many that 99.95 % of the pairs at 0.8 have one that differs by
    at most one bit; who meets in a one-wildcard variant of a segment is looked at by 128 bits, then by all, and the texts decide.
    """
    others = F.to_json(F.struct(*(F.col(f"doc.`{c}`") for c in docs.columns if c != "text")))
    rows = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "near-rows")
    order = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", F.xxhash64(F.coalesce("doc.text", F.lit(""))), F.xxhash64(others), "row")
    with scratch(docs.sparkSession):
        width, segments = cut(rows.count(), least)
        longs = max(2, -(-width * segments // 64))
        marks = written(near_rows(rows.select("row", F.col("doc.text").alias("text")), words, longs), "near-marks")
        roots = components(near_links(rows, marks, words, least, width, segments, longs, bucket, turns, tile))
        of = marks.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
        of = of.join(rows.select("row", order.alias("place")), "row")
        kept = written(of.groupBy("root").agg(F.min("place").alias("place")).select("place.row"), "near-kept")
    return picked(rows, kept).select(*(F.col(f"doc.`{c}`") for c in docs.columns))
