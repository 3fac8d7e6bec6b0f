"""Near-duplicates by HyperMinHash.

A document's distinct word shingles (of 3 words, unless told otherwise) are spread over registers by their top bits; a
register keeps the smallest value as a leading-zero count and a few mantissa bits.  Bands of registers give candidates,
the collision-corrected estimate drops those far below the threshold, and every link is confirmed on the full shingle
sets (as 64-bit hashes: among n shingles in all, the odds that any two are taken for one are n * n / 4e19).

Scale: equal sets are one class before anything is paired, so copies are never expanded.  A band's bucket is not paired
all against all: each member meets the bucket's smallest member, found by a combined aggregate, and only buckets that
still hold several components are looked at again, across components.  There, shingles of few documents pair those
documents directly, which is linear in the shingles; documents that share no such shingle can link only if their common
shingles alone suffice, and few outside a bucket's main component have that many.  Components are found by alternating
star contraction over tables in the shared folder until every tree is a star; nothing is collected.

Defined cases: without words a document has no shingles, links with nothing and is kept; with fewer words than a shingle
the whole sequence is its one shingle; rows that share a doc_id are one document of the graph, whatever their texts; a
null doc_id links with nothing, has a null component and is kept; an empty table gives an empty result; other columns
are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.store import Scratch, lean, small

SHINGLE = 3
LEAST, OF = 85, 100
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 4
#: An estimate this many standard errors below the threshold rules a pair out: one link in a billion.
SIGMAS = 6.0
#: Shingles of so many documents at most pair these documents directly.
RARE = 8
#: Parts of the hash range in which common shingles are counted: 2 to this power.
PART_BITS = 4
#: Champions of a bucket in each round, and rounds; they only save work, what they leave is paired exactly.
CHAMPIONS, CHAMPION_ROUNDS = 4, 3
#: Parts that the members of one leader are dealt over; shingles that are written out at a time.
SALTS, ROWS_OUT = 256, 200_000
EMPTY = 0xFFFF
#: Edges of one task in the contraction of components.
EDGES_A_PART = 200_000
U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows in a row, pointers)."""
    h, ptr = W.word_hashes(data, off)
    count = np.diff(ptr)
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(count)), sizes)
    first = ptr[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    out = np.zeros(len(first), U)
    for k in range(n):
        there = first + k < ptr[1:][row]
        word = np.where(there, h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else 0, U(k + 1))
        out = W.mix(out ^ word, k)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[at]


def registers(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """HyperMinHash sketches, one row of REGISTERS 16-bit values for each set."""
    out = np.full((len(ptr) - 1, REGISTERS), EMPTY, np.uint16)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    bucket = (sets >> U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    value = sets[first] << U(BUCKET_BITS)
    exact = (value >> U(11)).astype(np.float64)  # 53 bits
    zeros = np.where(exact > 0, 53 - np.frexp(exact)[1], 53).astype(U)
    mantissa = (value << zeros << U(1)) >> U(64 - MANTISSA)
    out[row[first], bucket[first]] = ((zeros << U(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def chance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of registers that agree by accident for disjoint sets with x and y elements a register."""
    total = np.zeros(np.broadcast(x, y).shape)
    steps = 1 << MANTISSA
    for zeros in range(32):
        lo = 2.0 ** -(zeros + 1)
        # within one leading-zero count the 2**MANTISSA cells are alike to first order
        px = np.exp(-x * lo) - np.exp(-x * 2 * lo)
        py = np.exp(-y * lo) - np.exp(-y * 2 * lo)
        total += px * py / steps
    return total


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate corrected for collisions, its standard error at the threshold) of pairs of sketches."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    equal = ((a == b) & used).sum(1) / n
    by_chance = chance(na / REGISTERS, nb / REGISTERS)
    at = least / OF
    return (equal - by_chance) / (1 - by_chance), np.sqrt(at * (1 - at) / n)


def _probes() -> np.ndarray:
    return np.random.default_rng(4).integers(0, REGISTERS, (48, REGISTERS))


def dense(sketch: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers take the value of another, found by one fixed sequence of probes for all.

    Registers of two sets then still agree with their similarity, also where the sets are smaller than the sketch, so
    that a band never rests on a single common shingle and several empty registers.
    """
    out = sketch.copy()
    some = np.flatnonzero((sketch == EMPTY).any(1) & (sketch != EMPTY).any(1))
    held = sketch[some]
    now = held.copy()
    for probe in _probes():
        now = np.where(now == EMPTY, held[:, probe], now)
    first = held[np.arange(len(held)), (held != EMPTY).argmax(1)]
    out[some] = np.where(now == EMPTY, first[:, None], now)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _keys(sets: np.ndarray, ptr: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums over each set."""
    out = []
    for seed in (11, 12):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(sets, seed), dtype=U)])
        out.append(pa.array((sums[ptr[1:]] - sums[ptr[:-1]]).view(np.int64)))
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set key (two 64-bit sums over the set) and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in W.chunks(batch.column(1)):
                sets, ptr = shingle_sets(data, off, shingle)
                blob = registers(sets, ptr).tobytes()
                size = 2 * REGISTERS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ptr).astype(np.int64)), *_keys(sets, ptr), pa.array([blob[k * size : (k + 1) * size] for k in range(hi - lo)], pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, set key and the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in W.chunks(batch.column(1)):
                sets, ptr = shingle_sets(data, off, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *_keys(sets, ptr), pa.array([sets[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())], names=["doc_id", "k1", "k2", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, k1 long, k2 long, shingles binary")


def bands(reps: DataFrame) -> DataFrame:
    """band, rep: one row for each band of a filled-up sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = dense(_matrix(batch.column(1)))
            packed = sketch.view(U).reshape(batch.num_rows, -1)
            key = W.mix(W.mix(packed) ^ np.arange(packed.shape[1], dtype=U), 3)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), packed.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["band", "rep"])

    return reps.select("rep", "sketch").mapInArrow(lean(run), "band long, rep long")


def exploded(sets: DataFrame) -> DataFrame:
    """rep, component, shingle: one row for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, component = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k, x in enumerate(batch.column(2)):
                shingles = np.frombuffer(x.as_buffer(), np.int64)
                for lo in range(0, len(shingles), ROWS_OUT):
                    some = shingles[lo : lo + ROWS_OUT]
                    held = [np.full(len(some), v, np.int64) for v in (rep[k], component[k])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(some)], names=["rep", "component", "shingle"])

    return sets.select("rep", "component", "shingles").mapInArrow(lean(run), "rep long, component long, shingle long")


def likely(pairs: DataFrame, reps: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b, estimate) of the pairs whose estimate does not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            guess, error = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb, least)
            # sizes alone bound the similarity from above
            good = (guess >= least / OF - SIGMAS * error) & (OF * np.minimum(na, nb) >= least * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(guess[good])], names=["a", "b", "estimate"])

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long, estimate double")


def confirmed(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The members a of a leader b are dealt over parts; a part streams the leader's set, then each member's, so a set
    travels once for each part of its leader and no group is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, U)
        for batch in batches:
            good = []
            for b, a, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                held = np.frombuffer(x.as_buffer(), U)
                if a is None:
                    leader, own = b, held.copy()
                    good.append(False)
                    continue
                assert leader == b
                at = np.minimum(np.searchsorted(own, held), len(own) - 1)
                both = int((own[at] == held).sum())
                good.append(both > 0 and OF * both >= least * (len(own) + len(held) - both))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
    side = lambda x: sets.select(F.col("rep").alias(x), "shingles")
    members = dealt.join(side("a"), "a").select("b", "salt", "a", "shingles")
    leaders = dealt.select("b", "salt").distinct().join(side("b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "shingles")
    return leaders.union(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first()).mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 200) -> DataFrame:
    """(rep, component): the smallest id reachable, for every id in an edge; alternating star contraction.

    Rounds grow with the logarithm of the ids; it ends when every tree is a star.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    parts = 1 + now.count() // EDGES_A_PART
    for k in range(1, rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{k}-large", parts)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large.where("u <> v"), f"{name}-{k}-mid", parts)
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-small", parts)
        joined = large.join(low2, "u")
        after = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(after.where("u <> v"), f"{name}-{k}", parts)
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(after.select("v", F.lit(0))).groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
        done = ends.where("up > 1 OR (up = 1 AND low = 0)").isEmpty()
        scratch.drop(f"{name}-{k}-large", f"{name}-{k}-mid", f"{name}-{k}-small", f"{name}-{k - 1}")
        now = after
        if done:
            return now.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    raise RuntimeError(f"components were not complete after {rounds} rounds")


def merged(found: DataFrame, new: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components after new links: the stars found so far and the links are contracted together."""
    return components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(new.select("a", "b")), scratch, name)


def _reach(most: str, least: int) -> str:
    """Whether sets of na and nb shingles with an overlap of ``most`` can be similar enough."""
    return f"{OF} * least(na, nb) >= {least} * greatest(na, nb) AND {OF + least} * ({most}) >= {least} * (na + nb)"


def across(held: DataFrame, found: DataFrame, near: DataFrame, reps: DataFrame, sets: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Components after the links between those components that share a bucket and that no leader stood for.

    A document can only reach another component through shingles that occur in several.  Those of few documents are
    paired; a pair's overlap is at most what it shares of these and the smaller number of its ends' other, common ones,
    summed over parts of the hash range.  Pairs that share none are looked for by bucket, among documents whose common shingles alone can suffice: first with
    the bucket's champions, which hold most common shingles and so take in nearly all that belong to a component; then
    what is left outside a bucket's main component with all of the bucket.
    """
    named = held.join(found, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    named = scratch.save(named, "named")
    mixed = scratch.save(named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("band"), "mixed")
    named = scratch.save(named.join(mixed, "band", "left_semi"), "open")
    who = scratch.save(named.select("rep", "component").distinct(), "who")
    rows = scratch.save(exploded(who.join(sets, "rep")), "rows")
    several = scratch.save(rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("shingle", (F.col("df") <= RARE).alias("rare")), "several")
    shared = scratch.save(rows.join(several, "shingle").select("shingle", "rep", "rare"), "shared")
    scratch.drop("rows", "several", "mixed", "named", "who")
    part = F.shiftrightunsigned("shingle", 64 - PART_BITS)
    parts = F.array(*[F.count_if(~F.col("rare") & (part == p)).cast("int") for p in range(1 << PART_BITS)])
    # dealt by document first: partial counts of a few shingles each would be wider than the shingles
    counts = shared.repartition("rep").groupBy("rep").agg(F.count("*").alias("m"), F.count_if(~F.col("rare")).alias("c"), parts.alias("p"))
    alive = scratch.save(counts.join(reps.select("rep", F.col("n_shingles").alias("n")), "rep").where(f"{OF} * m >= {least} * n"), "alive")
    rare = scratch.save(shared.where("rare").select("shingle", "rep").join(alive.select("rep", "n", "c"), "rep"), "rare")
    full = scratch.save(named.select("band", "rep").join(alive.where(f"{OF} * c >= {least} * n").select("rep", "n", "c", "p"), "rep"), "full")
    scratch.drop("shared", "open")

    lean_side = lambda df, x, *more: df.select(*more, F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"k{x}"), F.col("component").alias(f"c{x}"))
    side = lambda df, x, *more: lean_side(df, x, *more, F.col("p").alias(f"p{x}"))
    placed = lambda df, now: df.join(now, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    most = " + ".join(f"least(pa[{k}], pb[{k}])" for k in range(1 << PART_BITS))
    common = f"ca <> cb AND {_reach('least(ka, kb)', least)} AND {_reach(most, least)}"
    tested = near.select("a", "b")

    for k in range(CHAMPION_ROUNDS):
        now = scratch.save(placed(full, found), f"full-{k}")
        slot = F.pmod(F.xxhash64("rep", F.lit(k)), F.lit(CHAMPIONS)).alias("slot")
        best = now.groupBy("band", slot).agg(F.max_by(F.struct("rep", "n", "c", "p", "component"), F.struct("c", "n", "rep")).alias("x")).select("band", "x.*")
        pairs = scratch.save(ordered(side(now, "a", "band").join(side(best, "b", "band"), "band").where(common)).join(tested, ["a", "b"], "left_anti"), f"champion-pairs-{k}")
        if pairs.isEmpty():
            break
        new = scratch.save(confirmed(likely(pairs, reps, least), sets, least), f"champion-links-{k}")
        tested = tested.union(pairs)
        if not new.isEmpty():
            found = merged(found, new, scratch, f"found-champions-{k}")

    near_by = placed(rare, found)
    direct = lean_side(near_by, "a", "shingle").join(lean_side(near_by, "b", "shingle"), "shingle").where(f"a > b AND ca <> cb AND {OF} * least(na, nb) >= {least} * greatest(na, nb)")
    direct = direct.groupBy("a", "b", "na", "nb", "ka", "kb").agg(F.count("*").alias("both")).where(_reach("least(ka, kb) + both", least))
    spread = lambda x: alive.select(F.col("rep").alias(x), F.col("p").alias(f"p{x}"))
    direct = direct.join(spread("a"), "a").join(spread("b"), "b").where(_reach(f"{most} + both", least)).select("a", "b")
    now = scratch.save(placed(full, found), "full-last")
    main = now.groupBy("band").agg(F.mode("component").alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "main")
    now = scratch.save(now.join(main, "band"), "full-mixed")
    loose = side(now.where("component <> main"), "a", "band").join(side(now, "b", "band"), "band").where(common)
    pairs = ordered(direct.union(loose.select("a", "b"))).join(tested, ["a", "b"], "left_anti")
    new = scratch.save(confirmed(likely(scratch.save(pairs, "last-pairs"), reps, least), sets, least), "last-links")
    return found if new.isEmpty() else merged(found, new, scratch, "found-last")


def cluster(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    ``shingle`` is in words; documents link from a similarity of ``least`` of 100 on.  At 80 a pair with full sketches
    shares none of the 32 bands of 4 registers with a chance of 5e-8.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    every = scratch.save(sketches(docs, shingle), "sketches")
    some = every.where("n_shingles > 0 and doc_id is not null")
    # a class for each distinct set, numbered; the same set in other documents adds members, nothing else
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    members = scratch.save(some.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep").distinct(), "members")
    # an id with several texts joins their classes
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("doc_id", "b")
    own = members.withColumnRenamed("rep", "a").join(twice, "doc_id").where("a <> b").select("a", "b")
    reps = classes.select("rep", "n_shingles", "sketch")

    firsts = scratch.save(bands(reps).groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first"), "firsts")
    held = scratch.save(bands(reps).join(firsts, "band"), "held")
    scratch.drop("firsts")
    near = scratch.save(likely(held.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), reps, least), "near")
    ids = scratch.save(held.select("rep").distinct().join(classes.select("rep", "doc_id", "k1", "k2"), "rep"), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = ids.select("doc_id").distinct()
    sets = full_sets(texts.join(small(wanted, ids.count(), 64), "doc_id", "left_semi"), shingle).join(ids, ["doc_id", "k1", "k2"])
    sets = scratch.save(sets.select("rep", "shingles").dropDuplicates(["rep"]), "sets")

    def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components so far."""
        side = lambda x: found.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    # each class's likeliest partner first; the others only where that leaves two components
    best = near.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    found = components(scratch.save(confirmed(best, sets, least).union(own), "links-0"), scratch, "found-0")
    new = scratch.save(confirmed(between(near, found), sets, least), "links-1")
    if not new.isEmpty():
        found = merged(found, new, scratch, "found-1")
    found = across(held, found, near, reps, sets, scratch, least)

    rooted = scratch.save(members.join(found, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("root")).distinct(), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = scratch.save(rooted.join(smallest, "root").select("doc_id", "component_id"), "labels")
    scratch.drop("sets", "classes", "held", "near", "members", "rooted")
    out = every.select("doc_id", "n_shingles").join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
