"""Benchmark decontamination with a positional inverted index.

The index is distributed by document: a first pass over the corpus writes postings (term, positions) of the terms of the
test set into the shared folder, a row for each part of about half a megabyte of text, so postings never move and a lost
part is written alone again.  What the postings count gives the terms' frequencies.  Each window of an item then asks for
its terms from the rarest on: the rarest term's list, shifted to the window's start, is intersected with the shifted
lists of the next terms.  Starts that survive all terms are exact phrases.  Proximity matches keep an item whose rarest
terms stand close together in any order, by searches for ranges in the same lists.  The text is read once for a block.

The test set is cut into blocks of items with a bounded number of words; each block's tables are broadcast in turn, so
its size does not limit the method.  Words are told apart by 64-bit hashes.

Defined cases: null text has no words; an item without words is never matched; one of fewer than 13 words is a single
window; items or documents that repeat are treated alike, and equal windows of several items count for each; a null
doc_id is a document like others; an empty test set leaves every document clean; an empty corpus gives an empty result;
other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.store import Scratch, lean

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Words of test items in one block: what is broadcast for a block is at most a few times this many 8-byte values.
BLOCK_WORDS = 200_000
#: Proximity: so many of a window's rarest distinct terms within so many words.
NEAR_TERMS, NEAR_SPAN = 4, 2 * WINDOW


@dataclass
class Block:
    """Items of the test set: term numbers of all words in a row, and every distinct window's place in them."""

    vocabulary: np.ndarray  # sorted hashes of terms
    terms: np.ndarray
    items: list[str]
    pointers: np.ndarray
    starts: np.ndarray  # of distinct windows
    lengths: np.ndarray
    owners: np.ndarray  # the items that hold each distinct window, in a row
    owned: np.ndarray  # where each window's owners begin
    order: np.ndarray | None = None  # offsets of a window's words, rarest term first
    rarest: np.ndarray | None = None  # a window's rarest distinct terms


def make_block(hashes: list[np.ndarray], names: list[str], window: int = WINDOW) -> Block:
    flat = np.concatenate(hashes) if hashes else np.zeros(0, W.U)
    vocabulary, terms = np.unique(flat, return_inverse=True)
    pointers = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
    seen: dict[bytes, int] = {}
    starts, lengths, owners = [], [], []
    for k in range(len(names)):
        lo, hi = int(pointers[k]), int(pointers[k + 1])
        n = min(window, hi - lo)
        for s in range(lo, hi - n + 1) if n else ():
            key = terms[s : s + n].tobytes()
            if key not in seen:
                seen[key] = len(starts)
                starts.append(s)
                lengths.append(n)
                owners.append([])
            owners[seen[key]].append(k)
    own = [np.unique(o) for o in owners]
    return Block(vocabulary, terms.astype(np.int32), names, pointers, np.array(starts, np.int64), np.array(lengths, np.int64), np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64), np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64))


def set_order(block: Block, frequency: np.ndarray, window: int = WINDOW) -> None:
    """For each window the offsets of its words by rising frequency of their terms in the corpus; -1 fills short ones."""
    rarest = np.full((len(block.starts), NEAR_TERMS), -1, np.int32)
    order = np.full((len(block.starts), window), -1, np.int16)
    for k, (s, n) in enumerate(zip(block.starts.tolist(), block.lengths.tolist(), strict=True)):
        order[k, :n] = np.argsort(frequency[block.terms[s : s + n]], kind="stable")
        distinct = list(dict.fromkeys(block.terms[s + order[k, :n]].tolist()))[:NEAR_TERMS]
        rarest[k, : len(distinct)] = distinct
    block.order, block.rarest = order, rarest


def term_numbers(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each word's term; -1 for words that are in no item."""
    if not len(vocabulary):
        return np.full(len(hashes), -1, np.int32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1).astype(np.int32)


class Filter:
    """A bit for each value of 16 hash bits: most words that are in no item go without a search."""

    def __init__(self, vocabulary: np.ndarray):
        bits = max(16, min(24, int(np.ceil(np.log2(max(len(vocabulary), 1)))) + 5))
        self.shift = W.U(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(vocabulary >> self.shift).astype(np.int64)] = True
        self.vocabulary = vocabulary

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        some = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        out[some] = term_numbers(self.vocabulary, hashes[some])
        return out


class Index:
    """Positional postings of one part: the terms there, and each one's sorted positions, one after the other."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, ends: np.ndarray):
        self.terms, self.positions, self.ends = terms, positions.astype(np.int64), ends
        self.pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.span = int(ends[-1]) + 1 if len(ends) else 1
        self.keys = np.repeat(terms.astype(np.int64), counts) * self.span + self.positions  # sorted

    @staticmethod
    def lists(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, counts, positions) of a part from the term number of each of its words, -1 for none."""
        held = np.flatnonzero(numbers >= 0)
        some = numbers[held].astype(np.uint16) if len(held) and numbers.max() < 1 << 16 else numbers[held]  # sorted by radix
        by_term = held[np.argsort(some, kind="stable")]
        terms, counts = np.unique(numbers[by_term], return_counts=True)
        return terms.astype(np.int32), counts.astype(np.int32), by_term.astype(np.int32)

    @classmethod
    def of(cls, numbers: np.ndarray, ends: np.ndarray) -> Index:
        return cls(*cls.lists(numbers), ends)

    def rows(self, positions: np.ndarray) -> np.ndarray:
        """The document in which each position lies."""
        return np.searchsorted(self.ends, positions, "right")

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``terms``, position) of every posting of each."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        sizes = np.where(self.terms[at] == terms, self.pointers[at + 1] - self.pointers[at], 0)
        which = np.repeat(np.arange(len(terms)), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.positions[self.pointers[at][which] + inside]

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        if not len(self.keys):
            return np.zeros(len(terms), bool)
        asked = terms.astype(np.int64) * self.span + positions
        return self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked

    def between(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether each term's list has a position of at least ``lo`` and less than ``hi``."""
        at = terms.astype(np.int64) * self.span
        return np.searchsorted(self.keys, at + lo) < np.searchsorted(self.keys, at + hi)


def phrases(index: Index, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of each exact occurrence inside one document."""
    if not len(block.starts) or not len(index.positions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rarest = block.order[:, 0].astype(np.int64)
    window, position = index.postings(block.terms[block.starts + rarest])
    start = position - rarest[window]
    last = start + block.lengths[window] - 1
    ok = (start >= 0) & (last < index.ends[-1])
    ok[ok] = index.rows(start[ok]) == index.rows(last[ok])
    window, start = window[ok], start[ok]
    for k in range(1, block.order.shape[1]):
        if not len(window):
            break
        offset = block.order[window, k].astype(np.int64)
        good = offset < 0
        full = ~good
        good[full] = index.holds(block.terms[block.starts[window[full]] + offset[full]], start[full] + offset[full])
        window, start = window[good], start[good]
    return window, start


def near(index: Index, block: Block, span: int = NEAR_SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) where the window's rarest distinct terms all stand within ``span`` words of the rarest, in one document.

    Windows of fewer distinct terms ask for all of them.
    """
    if not len(block.starts) or not len(index.positions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    window, position = index.postings(block.rarest[:, 0])
    firsts = np.concatenate([[0], index.ends[:-1]])
    for k in range(1, NEAR_TERMS):
        term, row = block.rarest[window, k], index.rows(position)
        lo, hi = np.maximum(position - span, firsts[row]), np.minimum(position + span + 1, index.ends[row])
        good = (term < 0) | index.between(np.maximum(term, 0), lo, hi)
        window, position = window[good], position[good]
    return window, position


def owners(index: Index, block: Block, window: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, item) of occurrences; a window counts once a document before its items are written out."""
    pairs = np.unique(index.rows(position) * max(len(block.starts), 1) + window)
    row, window = pairs // max(len(block.starts), 1), pairs % max(len(block.starts), 1)
    sizes = block.owned[window + 1] - block.owned[window]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = block.owners[np.repeat(block.owned[window], sizes) + inside]
    pairs = np.unique(np.repeat(row, sizes) * max(len(block.items), 1) + item)
    return pairs // max(len(block.items), 1), pairs % max(len(block.items), 1)


def read_items(benchmark: DataFrame) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Blocks of items, streamed to the driver a partition at a time."""
    names, hashes, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).toLocalIterator():
        data, off = W.buffers(pa.array([row["text"]], pa.string()))
        h, _ = W.word_hashes(data[off[0] : off[-1]], off - off[0], W.ALNUM)
        if names and size + len(h) > BLOCK_WORDS:
            yield names, hashes
            names, hashes, size = [], [], 0
        names.append(row["item"])
        hashes.append(h)
        size += len(h)
    yield names, hashes


POSTINGS = "doc_ids array<bigint>, rows array<bigint>, ends binary, terms binary, counts binary, positions binary"


def write_postings(docs: DataFrame, block: Block, scratch: Scratch, name: str) -> DataFrame:
    """The positional index of the block's terms, a row for each part of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = Filter(shared.value)
        for batch in batches:
            for lo, hi, data, off in W.chunks(batch.column(2)):
                h, ptr = W.word_hashes(data, off, W.ALNUM)
                packed = [np.asarray(x).tobytes() for x in (ptr[1:].astype(np.int64), *Index.lists(quick.numbers(h)))]
                ids = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(k).slice(lo, hi - lo)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array([x], pa.binary()) for x in packed]], names=["doc_ids", "rows", "ends", "terms", "counts", "positions"])

    return scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("row"), F.col("text").cast("string")).mapInArrow(lean(run), POSTINGS), name)


def _frequencies(postings: DataFrame, block: Block) -> np.ndarray:
    """Occurrences of each test term in the corpus; the result has a row for each term of the block at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                terms, counts = np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(y.as_buffer(), np.int32)
                if len(terms) and terms[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(terms[-1]) + 1 - len(total), np.int64)])
                total[terms] += counts
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["term", "n"])

    out = np.zeros(len(block.vocabulary), np.int64)
    for row in postings.select("terms", "counts").mapInArrow(lean(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


ROWS = "doc_id long, row long, n_words long, hits binary, items array<string>, near_items array<string>"


def _search(postings: DataFrame, block: Block) -> DataFrame:
    shared = postings.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = np.array(block.items, object)
        for batch in batches:
            for k in range(batch.num_rows):
                ends, terms, counts, positions = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int32), (4, np.int32), (5, np.int32)))
                index = Index(terms, counts, positions, ends)
                n = len(ends)
                window, start = phrases(index, block)
                size = int(ends[-1]) if n else 0
                hit = np.zeros(size + 1, np.int64)
                np.add.at(hit, start, 1)
                np.add.at(hit, start + block.lengths[window], -1)
                hit = np.cumsum(hit)[:-1] > 0
                lists = []
                for w, p in ((window, start), near(index, block)):
                    row, item = owners(index, block, w, p)
                    cuts = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(names[item].tolist(), pa.string())))
                firsts = np.concatenate([[0], ends[:-1]])
                some = np.zeros(n, bool)
                some[index.rows(start)] = True
                bits = [np.packbits(hit[a:b]).tobytes() if yes else b"" for a, b, yes in zip(firsts.tolist(), ends.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[k].values for c in (0, 1)], pa.array((ends - firsts).astype(np.int64)), pa.array(bits, pa.binary()), *lists],
                    names=["doc_id", "row", "n_words", "hits", "items", "near_items"],
                )

    return postings.mapInArrow(lean(run), ROWS)


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Rows of several blocks by document: hit words are those hit in any block."""

    def union_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(3).to_pylist():
                some = [np.frombuffer(x, np.uint8) for x in row if x]
                out.append(np.bitwise_or.reduce(some).tobytes() if some else b"")
            columns = [*batch.columns]
            columns[3] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    names = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"))
    return names.select("doc_id", "row", "n_words", "hits", "items", "near_items").mapInArrow(lean(union_bits), ROWS)


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, hits (bits of hit words, packed), items, near_items: one row for each document."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    scratch, parts = Scratch(docs.sparkSession, "decontam"), []
    for k, (names, hashes) in enumerate(read_items(benchmark)):
        block = make_block(hashes, names)
        postings = write_postings(rows, block, scratch, f"postings-{k}")
        set_order(block, _frequencies(postings, block))
        parts.append(_search(postings, block))
    if len(parts) == 1:
        return parts[0]
    saved = []
    for k, part in enumerate(parts):
        saved.append(scratch.save(part, f"block-{k}"))
        scratch.drop(f"postings-{k}")
    return _merge(saved)


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, near_items (comma-joined)."""
    found = match(docs, benchmark)
    n_hit = F.coalesce(F.aggregate(F.split(F.hex("hits"), ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(F.bit_count(F.conv(c, 16, 10).cast("int")))), F.lit(0).cast("long"))
    items, close = (F.array_sort(F.array_distinct(name)) for name in ("items", "near_items"))
    out = found.select(
        "doc_id",
        "n_words",
        F.when(F.length("hits") == 0, F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.size(close).cast("long").alias("n_near_items"),
        F.array_join(close, ",").alias("near_items"),
        "row",
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
