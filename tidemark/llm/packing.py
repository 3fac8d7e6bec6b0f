"""Packing by minimum bin slack.

A document's tokens are cut into full windows and one shorter rest.  Rests are packed by their *lengths* alone: the
histogram of lengths has at most ``window`` entries whatever the corpus holds, so the plan is made once, on the
driver, from bounded data.  For each window a bitset subset-sum over the remaining-length multiset, always with the
longest length left, finds the fill closest to capacity; backtracking gives the counts; the pattern is repeated as
often as the counts allow.  Rows are then placed in parallel from their rank among rests of equal length.

Null or empty text has only the closing id.  Rows that repeat are packed as often as they occur.  An empty table gives
an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import words as W
from tidemark.llm.store import Scratch, lean, small

U = np.uint64

WINDOW = 4096
END_ID = 2
#: Bytes of a worker's cache of words, about; the cache starts anew when it is full.  Longer words are not kept.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 96 << 20, 200, 64
#: Bytes of text that are looked through for distinct words at a time, about.
CHUNK = 2 << 20
#: New words that are encoded at a time.
TOGETHER = 4096
#: Letters whose lower case is a letter in composed form, then ASCII marks: each run is cut off from the other.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)([!-/:-@\[-`{-~]*)")
#: The printable symbol that stands for each byte in byte-level vocabularies.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SYMBOLS = dict(zip([*_PRINTED, *(x for x in range(256) if x not in _PRINTED)], [*_PRINTED, *range(256, 512)], strict=False))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


class Ids:
    """Ids of texts, from those of their white-space words.

    The vocabulary's normaliser and pre-tokenizer never reach across ASCII white space and drop it, so a text's ids are
    those of its words in a row; each distinct word of a chunk is looked up once.  Texts with "<|", in which special
    tokens could match across words, go through the tokenizer whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.known: dict[bytes, bytes] = {}
        self.size, self.most = 0, cache_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.digits = {d: self.tokenizer.token_to_id(f"{d}</w>") for d in "07"}
        # the same model without normaliser and patterns, for letters that need neither
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.normalizer, self.letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, its ids); most words are encoded many at a time with a digit, always a token of its own, between them."""
        rest = words
        for digit, mark in self.digits.items():
            some = [w for w in rest if digit.encode() not in w]
            rest = [w for w in rest if digit.encode() in w]
            for lo in range(0, len(some), TOGETHER):
                part = some[lo : lo + TOGETHER]
                text = f" {digit} ".join([w.decode() for w in part])
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                gaps = np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]]).tolist()
                raw = ids.tobytes()
                yield from zip(part, [raw[4 * a + 4 : 4 * b] for a, b in zip(gaps[:-1], gaps[1:], strict=True)], strict=True)
        for w in rest:
            yield w, self.encode(w)

    def _stems(self, stems: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(stem, its ids) of plain letters: the model alone, on their byte symbols; a word's last token is marked as such."""
        for lo in range(0, len(stems), TOGETHER):
            part = stems[lo : lo + TOGETHER]
            symbols = " ".join([x.decode() if x.isascii() else x.decode().lower().encode().decode("latin-1").translate(SYMBOLS) for x in part])
            ids = np.array(self.letters.encode_batch_fast([symbols], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            yield from zip(part, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words; one of plain letters and the marks behind it is two, of which many words are made."""
        known, parts, stems, rest = self.known, [], {}, {}
        for w in words:
            if m := PLAIN.fullmatch(w):
                stem, marks = m.groups()
                parts.append((w, stem, marks))
                if stem not in known:
                    stems[stem] = None
                if marks and marks not in known:
                    rest[marks] = None
            else:
                rest[w] = None
        found = dict(self._together(list(rest)))
        found.update(self._stems(list(stems)))
        found[b""] = b""
        for w, stem, marks in parts:
            if marks:
                found[w] = (found.get(stem) or known[stem]) + (found.get(marks) or known[marks])
        out = [found[w] for w in words]
        if self.size > self.most:
            self.known, self.size = {}, 0
        kept = {w: x for w, x in found.items() if len(w) <= LONGEST}
        self.known.update(kept)
        self.size += len(kept) * ENTRY_BYTES
        return out

    def of(self, column: pa.Array) -> Iterator[bytes | memoryview]:
        """The ids of each text as little-endian bytes; null counts as empty."""
        for lo, hi, data, off in W.chunks(column, min(CHUNK, self.most >> 5)):
            folded = np.append(_FOLD[data], np.zeros(8, np.uint8))
            marks = np.flatnonzero((folded[:-9] == 0x3C) & (folded[1:-8] == 0x7C)) if len(data) > 1 else np.zeros(0, np.int64)
            whole = set(np.unique(np.searchsorted(off, marks, "right") - 1).tolist())
            starts, ends, ptr = W.cut(data, off)
            inverse, ids, sizes = self._distinct(folded, starts, ends)
            n = sizes[inverse]
            upto = np.concatenate([[0], np.cumsum(n)])
            first = (np.cumsum(sizes) - sizes)[inverse]
            raw = memoryview(ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])].tobytes())
            at = (4 * upto[ptr]).tolist()
            raw_text = data.tobytes() if whole else b""
            for k in range(hi - lo):
                yield self.encode(raw_text[off[k] : off[k + 1]]) if k in whole else raw[at[k] : at[k + 1]]

    def _distinct(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which distinct word each word is, ids of the distinct words in a row, how many each has)."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        _, at, inverse = np.unique(W.hashes(folded, starts, ends), return_index=True, return_inverse=True)
        same = at[inverse]
        size = ends - starts
        eight = np.ndarray((len(folded) - 7,), "<u8", folded, strides=(1,))  # folded has eight bytes more than the text
        short = U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (U(8) - np.minimum(size, 8).astype(U)))
        head, tail = eight[starts] & short, eight[np.maximum(ends - 8, 0)]
        bad = (size != size[same]) | (head != head[same]) | ((size > 8) & (tail != tail[same]))
        if bad.any():  # two words with one hash: those become entries of their own
            odd = np.flatnonzero(bad)
            inverse[odd] = len(at) + np.arange(len(odd))
            at = np.append(at, odd)
        raw = folded.tobytes()
        words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        ids = list(map(self.known.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(new, self.learn([words[k] for k in new]) if new else (), strict=True):
            ids[k] = x
        return inverse, np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """The pieces of every document, each with its rank among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = Ids(path or vocabulary_path(), cache_bytes), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.of(batch.column(1)), strict=True):
                ids = b"".join((ids, end))
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(out)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (each up to its count) whose sum is the largest of at most ``room``."""
    full, steps, bits = (1 << (room + 1)) - 1, [], 1
    for length in lengths:
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, bits))
            bits |= (bits << (length * copies)) & full
            left -= copies
            copies *= 2
        if bits >> room & 1:
            break
    at, taken = bits.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return taken


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, copies), ...], times)]: window patterns that use up ``counts`` exactly."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        left[top] -= 1
        taken = best_fill([x for x in lengths if left[x] and x <= window - top], left, window - top)
        left[top] += 1
        taken[top] = taken.get(top, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        out.append((sorted(taken.items(), reverse=True), times))
        for x, n in taken.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    ``cache_bytes`` bounds each worker's memory of words; it changes the time, not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.save(pieces(docs, window, path, cache_bytes), "pieces")
    totals = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = scratch.save(totals.withColumn("base", before).drop("n"), "bases")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows

    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, window):
        offset = 0
        for length, copies in pattern:
            table.setdefault(length, []).append((used[length], copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    arrays = {k: np.array(v, np.int64) for k, v in table.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                rows = order[lo:hi]
                runs = arrays[int(length[rows[0]])]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - run[:, 0]
                seq[rows] = run[:, 2] + nth // run[:, 1]
                offset[rows] = run[:, 3] + nth % run[:, 1] * length[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(small(bases, bases.count(), 96), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("local_rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
