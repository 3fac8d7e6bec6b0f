"""N-gram language model in an Elias-Fano trie.

Counts cover every training document and grow with the corpus.  They live in levels of shards, files in the shared
folder that workers map into memory, so a worker holds no more of the model than its lookups touch:

* level 1: the sorted hashes of words as an Elias-Fano sequence, with exact counts; a word's number is its rank;
* level 2: for each word monotone pointers to its successors, as an Elias-Fano sequence of (word, successor);
* level 3: for each pair its successors, each written as its rank among the successors of the pair's second
  word (context-relative), so a lookup is a successor search in the context one level down, then one in the pair.

Every pair and triple is held, also those seen once.  Smoothing is absolute discounting, interpolated down to the
additive unigram, with discounted probabilities and back-off weights quantised to 16 bits.

Workers count pairs and triples and send them to their shard packed, a row for each shard and flush.

Defined cases: null or empty text is the end token alone; a null doc_id is a training document; unseen words get the
additive floor; repeated rows are counted and scored as often as they occur; with no training rows every score is the
floor; an empty table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.store import Scratch, lean

U = np.uint64
ORDER = 3
DISCOUNT = 0.5
ADD = 0.1
#: Training tokens of a shard, about; all levels have as many shards.  Bytes of a token in the estimate of their number.
SHARD_TOKENS, TOKEN_BYTES = 2_000_000, 6
END = U(0x5851F42D4C957F2D)
#: Step of quantised log10 values.
STEP = 2.0**-11
#: Keys that a worker gathers before it sends their counts; text that is looked up at a time; slots of its word cache.
GATHER_KEYS, CHUNK, CACHE_BITS = 2_000_000, 4 << 20, 18


# ---- files -------------------------------------------------------------------------------------------------------
def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        parsed = urlparse(uri)
        if parsed.scheme == "file":
            return fs.LocalFileSystem(), parsed.path
        return fs.FileSystem.from_uri(f"s3{uri[3:]}" if parsed.scheme == "s3a" else uri)
    return fs.LocalFileSystem(), uri


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file; written aside and renamed, so a task that runs twice leaves one whole file."""
    import uuid

    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    system.move(aside, path)


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """Mapped into memory where the folder is mounted; read whole from other stores."""
    system, path = _place(uri)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with system.open_input_file(path) as f:
            data = np.frombuffer(f.read(), np.uint8)
    n = int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8 : 8 + n]))
    return {k: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for k, (at, kind, size) in head.items()}


# ---- Elias-Fano --------------------------------------------------------------------------------------------------
def _select(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) set bit of each word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8):
        low = np.bitwise_count(word & U((1 << width) - 1))
        up = nth >= low
        nth = nth - low * up
        shift = up * U(width)
        word = word >> shift
        place += shift.view(np.int64)
    return place + _IN_BYTE[(word & U(255)).astype(np.int64) * 8 + (nth & 7)]  # where the bit is beyond the word, any place


#: Place of the nth set bit of every byte.
_IN_BYTE = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[:8] for x in range(256)], np.int64).ravel()


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary.

    The place of every 16th zero and one is kept; most others are within 64 bits of those.  For the rest there are counts
    of zeros every 512 bits.
    """

    SAMPLE_BITS = 4

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray, count: np.ndarray):
        self.n, self.bits, self.buckets = (int(x) for x in meta)
        self.low, self.high, self.zeros, self.ones, self.count = low, high, zeros, ones, count

    @classmethod
    def arrays(cls, values: np.ndarray, universe: int, prefix: str) -> dict[str, np.ndarray]:
        values = values.astype(U)
        n = len(values)
        bits = min(62, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> U(bits)).astype(np.int64)
        buckets = int(high[-1]) + 1 if n else 0
        words = -(-(n + buckets + 65) // 512) * 8  # a word of zeros more than is read at once
        at = high + np.arange(n)
        ones = np.zeros(words * 64, bool)
        ones[at] = True
        unary = np.packbits(ones, bitorder="little").view(U)
        kind, step = np.min_scalar_type(words * 64), 1 << cls.SAMPLE_BITS
        count = np.concatenate([[0], np.cumsum(512 - np.bitwise_count(unary).reshape(-1, 8).sum(1, dtype=np.int64))])
        zeros = np.flatnonzero(~ones)[::step].astype(kind)
        low = np.zeros(-(-n * bits // 64) + 1, U)
        if bits and n:
            place = np.arange(n, dtype=np.int64) * bits
            value, word, shift = values & U((1 << bits) - 1), place >> 6, (place & 63).astype(U)
            np.bitwise_or.at(low, word, value << shift)
            over = np.flatnonzero((place & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, value[over] >> (U(64) - shift[over]))
        return {f"{prefix}meta": np.array([n, bits, buckets], np.int64), f"{prefix}low": low, f"{prefix}high": unary, f"{prefix}zeros": zeros, f"{prefix}ones": at[::step].astype(kind), f"{prefix}count": count.astype(np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
        return cls(*(arrays[prefix + k] for k in ("meta", "low", "high", "zeros", "ones", "count")))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        out = self.low[word] >> shift
        over = np.flatnonzero(shift > U(64 - self.bits))
        out[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return out & U((1 << self.bits) - 1)

    def _bits_at(self, place: np.ndarray) -> np.ndarray:
        """The 64 bits of the unary part from each place on."""
        word, shift = place >> 6, (place & 63).astype(U)
        return (self.high[word] >> shift) | (self.high[word + 1] << U(1) << (U(63) - shift))

    def _bit(self, nth: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the nth one or zero of the unary part."""
        place = (self.ones if ones else self.zeros)[nth >> self.SAMPLE_BITS].astype(np.int64)
        left = nth & ((1 << self.SAMPLE_BITS) - 1)
        held = self._bits_at(place)
        held = held if ones else ~held
        far = np.flatnonzero(left >= np.bitwise_count(held))
        out = place + _select(held, left)
        if len(far):
            out[far] = self._far(nth[far], ones)
        return out

    def _far(self, nth: np.ndarray, ones: bool) -> np.ndarray:
        counts = np.arange(len(self.count), dtype=np.int64) * 512 - self.count if ones else self.count
        block = np.searchsorted(counts, nth, "right") - 1
        left, word = nth - counts[block], block * 8
        for _ in range(7):
            held = self.high[word]
            c = np.bitwise_count(held if ones else ~held).astype(np.int64)
            go = left >= c
            left, word = np.where(go, left - c, left), np.where(go, word + 1, word)
        held = self.high[word]
        return word * 64 + _select(held if ones else ~held, left)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._bit(i, True) - i).astype(U) << U(self.bits)) | self._lows(i)

    def _run(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first rank, end rank) of the values whose high part is ``bucket``: the ones after the zero before it."""
        at = self._bit(np.maximum(bucket - 1, 0), False) + 1
        at[bucket == 0] = 0
        first = at - bucket
        zeros = ~self._bits_at(at)
        ones = np.bitwise_count(zeros ^ (zeros - U(1))).astype(np.int64) - 1
        over = np.flatnonzero(zeros == 0)
        if len(over):
            ones[over] = self._bit(bucket[over], False) - at[over]
        return first, first + ones

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key; -1 where it is not in the sequence."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        bucket = (keys >> U(self.bits)).astype(np.int64)
        rows = np.flatnonzero((bucket >= 0) & (bucket < self.buckets))
        lo, hi = self._run(bucket[rows])
        end, want = hi.copy(), keys[rows] & U((1 << self.bits) - 1)
        while len(act := np.flatnonzero(lo < hi)):
            mid = (lo[act] + hi[act]) >> 1
            less = self._lows(mid) < want[act]
            lo[act] = np.where(less, mid + 1, lo[act])
            hi[act] = np.where(less, hi[act], mid)
        there = np.flatnonzero(lo < end)
        good = there[self._lows(lo[there]) == want[there]]
        out[rows[good]] = lo[good]
        return out


def quantise(x: np.ndarray) -> np.ndarray:
    """-log10 of values in (0, 1] in 16 bits; the last code stands for zero."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-np.log10(np.minimum(x, 1.0)) / STEP), 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return np.where(q == 65535, 0.0, 10.0 ** (-STEP * q))


# ---- the trie ----------------------------------------------------------------------------------------------------
def split(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in order)."""
    if not len(shards):
        return
    small = shards.astype(np.uint16) if shards.max() < 1 << 16 else shards  # short integers are sorted by radix
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(shards[order[a]]), order[a:b]


class Trie:
    """Levels of one model, opened shard by shard as they are needed."""

    def __init__(self, info: dict):
        self.root, self.bits, self.order = info["root"], info["bits"], info["order"]
        self.bases = [np.array(b, np.int64) for b in info["bases"]]  # first number of each shard, by level
        self.total, self.words, self.degree = info["total"], info["words"], info.get("degree", 0)
        self.opened: dict[tuple[int, int], dict] = {}
        self.lately: list[np.ndarray] | None = None

    def shard(self, level: int, k: int) -> dict:
        if (level, k) not in self.opened:
            a = open_arrays(f"{self.root}/{level}-{k}")
            self.opened[level, k] = {**a, "seq": EliasFano.of(a, "seq_"), **({"ptr": EliasFano.of(a, "ptr_")} if "ptr_meta" in a else {})}
        return self.opened[level, k]

    def _split(self, shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return split(shards)

    def _home(self, level: int, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases[level - 1], number, "right") - 1

    def unigrams(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of words; those met lately come from a cache of fixed size."""
        if not self.words:
            return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if self.lately is None:
            self.lately = [np.zeros(1 << CACHE_BITS, U), np.full(1 << CACHE_BITS, -1, np.int64), np.zeros(1 << CACHE_BITS, np.int64)]
            self.lately[0][0] = 1 << 63  # a hash of another slot, so that hash 0 is not taken as met
        key, of, counts = self.lately
        slot = (hashes >> U(64 - CACHE_BITS)).astype(np.int64)
        number, count = of[slot], counts[slot]
        missed = np.flatnonzero(key[slot] != hashes)
        if len(missed):
            distinct, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found, held = self._unigrams(distinct)
            number[missed], count[missed] = found[inverse], held[inverse]
            there = slot[missed[first]]
            key[there], of[there], counts[there] = distinct, found, held
        return number, count

    def _unigrams(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shards = (hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for k, rows in self._split(shards):
            s = self.shard(1, k)
            at = s["seq"].find(hashes[rows] & U((1 << (64 - self.bits)) - 1))
            good = at >= 0
            number[rows[good]] = at[good] + self.bases[0][k]
            count[rows[good]] = s["count"][at[good]]
        return number, count

    def distinct(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of one of each pair of numbers, which of those each pair is); all pairs where numbers are too large to pack."""
        if self.words >= (1 << 32) - 1:
            return np.arange(len(first)), np.arange(len(first))
        keys = ((first + 1).astype(U) << U(32)) | (second + 1).astype(U)
        _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return at, inverse

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, rank among the first word's successors, discounted probability, back-off weight of the first word)."""
        number, rank = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        prob, weight = np.zeros(len(first)), np.ones(len(first))
        known = np.flatnonzero(first >= 0)
        for k, rows in self._split(self._home(1, first[known])):
            rows = known[rows]
            s, local = self.shard(2, k), first[rows] - self.bases[0][k]
            weight[rows] = restored(s["gamma"][local])
            sure = rows[second[rows] >= 0]
            local = first[sure] - self.bases[0][k]
            at = s["seq"].find(local.astype(U) * U(self.words) + second[sure].astype(U))
            good = at >= 0
            sure, at, local = sure[good], at[good], local[good]
            number[sure] = at + self.bases[1][k]
            rank[sure] = at - s["ptr"].get(local).astype(np.int64)
            prob[sure] = restored(s["prob"][at])
        return number, rank, prob, weight

    def triples(self, pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted probability, back-off weight of the pair); rank -1 stands for no successor."""
        prob, weight = np.zeros(len(pair)), np.ones(len(pair))
        known = np.flatnonzero(pair >= 0)
        for k, rows in self._split(self._home(3, pair[known])):
            rows = known[rows]
            s = self.shard(3, k)
            weight[rows] = restored(s["gamma"][pair[rows] - self.bases[2][k]])
            sure = rows[rank[rows] >= 0]
            at = s["seq"].find((pair[sure] - self.bases[2][k]).astype(U) * U(self.degree) + rank[sure].astype(U))
            good = at >= 0
            prob[sure[good]] = restored(s["prob"][at[good]])
        return prob, weight


_TRIES: dict[str, Trie] = {}


def trie(info: dict) -> Trie:
    """One trie for each model and worker."""
    if info["key"] not in _TRIES:
        _TRIES.clear()
        _TRIES[info["key"]] = Trie(info)
    return _TRIES[info["key"]]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, pointers by row): a row's words, then the end."""
    h, ptr = W.word_hashes(data, off)
    n = np.diff(ptr)
    out = np.full(len(h) + len(n), END, U)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, ptr + np.arange(len(ptr))


def _packed(a: np.ndarray) -> bytes:
    """Byte by byte of all values, so that the high bytes of sorted values are runs, which shuffles compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _dealt(docs: DataFrame, keys_of) -> DataFrame:
    """(shard, keys, counts) over all rows of ``docs``: ``keys_of`` gives the shard of each key, and the key inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            shards, keys = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            out: list[tuple[int, bytes, bytes]] = []
            for k, rows in split(shards):
                some, n = np.unique(keys[rows], return_counts=True)
                out.append((k, _packed(some), _packed(n.astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

        for batch in batches:
            for _, _, data, off in W.chunks(batch.column(0), CHUNK):
                held.append(keys_of(*tokens(data, off)))
                if sum(len(x) for x, _ in held) >= GATHER_KEYS:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "shard int, keys binary, counts binary")


def _inside(ptr: np.ndarray, n: int, ahead: int) -> np.ndarray:
    """Places whose next ``ahead`` tokens are in the same row."""
    out = np.zeros(n, bool)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    if n > ahead:
        out[: n - ahead] = row[: n - ahead] == row[ahead:]
    return out


def _sharded(df: DataFrame, build, root: str, level: int, shards: int) -> tuple[list[int], int, int]:
    """Build and write every shard in one piece; returns their sizes, the largest degree and the sum of all counts.

    One row a shard reaches the driver.
    """
    # a row without occurrences for each shard, so that empty ones are written too
    every = df.union(df.sparkSession.range(shards).select(F.col("id").cast("int"), F.lit(b""), F.lit(b""))).repartition(shards, "shard")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, n = (np.concatenate([_unpacked(x, kind) for x in frame.pop(name)]) for name, kind in (("keys", U), ("counts", np.uint32)))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, n = keys[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        arrays = build(int(key[0]), keys, n)
        write_arrays(f"{root}/{level}-{int(key[0])}", arrays)
        return pd.DataFrame({"shard": [int(key[0])], "size": [int(arrays["seq_meta"][0])], "most": [int(arrays["most"][0]) if "most" in arrays else 0], "n": [int(n.sum())]})

    rows = every.groupBy("shard").applyInPandas(run, "shard int, size long, most long, n long").collect()
    got = {r["shard"]: r for r in rows}
    return [got[k]["size"] for k in range(shards)], max((r["most"] for r in rows), default=0), sum(r["n"] for r in rows)


def _bases(sizes: list[int]) -> list[int]:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist()


def _level2(info: dict):
    def build(shard: int, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        words = trie(info).shard(1, shard)
        totals = np.asarray(words["count"]).astype(np.float64)
        bits = info["words"].bit_length()
        local = (keys >> U(bits)).astype(np.int64)
        after = keys & U((1 << bits) - 1)
        prob = (n - DISCOUNT) / totals[local]
        taken = np.bincount(local, prob, len(totals))
        degree = np.bincount(local, minlength=len(totals))
        pointers = np.concatenate([[0], np.cumsum(degree)])
        return {
            **EliasFano.arrays(local.astype(U) * U(info["words"]) + after, max(len(totals) * info["words"], 1), "seq_"),
            **EliasFano.arrays(pointers, len(keys) + 1, "ptr_"),
            "prob": quantise(prob),
            "gamma": quantise(1 - taken),
            "n": n.astype(np.min_scalar_type(int(n.max(initial=0)))),
            "most": np.array([degree.max(initial=0)]),
        }

    return build


def _level3(info: dict, bases: list[int], pairs: int, bits: int):
    def build(shard: int, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = bases[shard], [*bases, pairs][shard + 1]
        below = [*info["bases"][1], pairs]
        parts = [trie(info).shard(2, k)["n"][max(lo - a, 0) : max(hi - a, 0)] for k, (a, b) in enumerate(zip(below[:-1], below[1:], strict=True)) if a < hi and b > lo]
        totals = np.concatenate([np.zeros(0), *parts])
        local = (keys >> U(bits)).astype(np.int64)
        prob = (n - DISCOUNT) / totals[local]
        return {
            **EliasFano.arrays(local.astype(U) * U(info["degree"]) + (keys & U((1 << bits) - 1)), max(len(totals) * info["degree"], 1), "seq_"),
            "prob": quantise(prob),
            "gamma": quantise(1 - np.bincount(local, prob, len(totals))),
        }

    return build


def _qualified(spark, root: str) -> str:
    """The folder with its file system's scheme, as Spark resolves it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Counts all rows of ``docs``, writes the trie and returns what opens it: folder, shard bases and totals."""
    import uuid

    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    bits = (size["rows"] // SHARD_TOKENS + size["bytes"] // (TOKEN_BYTES * SHARD_TOKENS)).bit_length()
    info = {"root": _qualified(spark, Scratch(spark, "lm").path("trie")), "bits": bits, "order": 1, "words": 0, "total": 0, "key": uuid.uuid4().hex, "bases": []}
    shards = 1 << bits

    def word_keys(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)), h

    def words(shard: int, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        return {**EliasFano.arrays(keys & U((1 << (64 - bits)) - 1), 1 << (64 - bits), "seq_"), "count": n}

    sizes, _, total = _sharded(_dealt(docs, word_keys), words, info["root"], 1, shards)
    info = {**info, "words": sum(sizes), "total": total, "bases": [_bases(sizes)]}
    # a key inside a shard is a local number and a word's: there would have to be about 2 ** 40 distinct words to pass 64 bits
    if max(sizes).bit_length() + info["words"].bit_length() > 63:
        raise ValueError("words of a shard times distinct words do not fit 63 bits")

    if order >= 2:
        one_info = dict(info)

        def pair_keys(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            t = trie(one_info)
            number = t.unigrams(h)[0]
            at = np.flatnonzero(_inside(ptr, len(h), 1))
            home = t._home(1, number[at])
            return home, ((number[at] - t.bases[0][home]).astype(U) << U(t.words.bit_length())) | number[at + 1].astype(U)

        sizes, most, _ = _sharded(_dealt(docs, pair_keys), _level2(dict(info)), info["root"], 2, shards)
        info = {**info, "order": 2, "degree": max(most, 1), "key": uuid.uuid4().hex, "bases": [*info["bases"], _bases(sizes)]}
    if order >= 3:
        two_info, rank_bits, pairs = dict(info), info["degree"].bit_length(), sum(sizes)
        # equal ranges of pairs: the pairs of a frequent word are not one shard
        thirds = [pairs * k // shards for k in range(shards)]
        edges = np.array(thirds, np.int64)

        def triple_keys(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            t = trie(two_info)
            number = t.unigrams(h)[0]
            at = np.flatnonzero(_inside(ptr, len(h), 1))
            one, where = t.distinct(number[at], number[at + 1])
            pair, rank, _, _ = t.pairs(number[at[one]], number[at[one] + 1])
            of, ranks = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
            of[at], ranks[at] = pair[where], rank[where]
            at = np.flatnonzero(_inside(ptr, len(h), 2))
            at = at[(of[at] >= 0) & (of[at + 1] >= 0)]
            home = np.searchsorted(edges, of[at], "right") - 1
            return home, ((of[at] - edges[home]).astype(U) << U(rank_bits)) | ranks[at + 1].astype(U)

        _sharded(_dealt(docs, triple_keys), _level3(dict(info), thirds, pairs, rank_bits), info["root"], 3, shards)
        info = {**info, "order": 3, "key": uuid.uuid4().hex, "bases": [*info["bases"], thirds]}
    return info


def log_probabilities(t: Trie, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, base log10, model log10) of every token."""
    number, count = t.unigrams(h)
    p = (count + ADD) / (t.total + ADD * (t.words + 1))
    base = np.log10(p)
    if t.order >= 2 and len(h):
        at = np.flatnonzero(_inside(ptr, len(h), 1))
        one, where = t.distinct(number[at], number[at + 1])
        pair, rank, prob, weight = t.pairs(number[at[one]], number[at[one] + 1])
        p[at + 1] = prob[where] + weight[where] * p[at + 1]
        if t.order >= 3:
            of, ranks = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
            of[at] = pair[where]
            ranks[at] = np.where(pair >= 0, rank, -1)[where]
            at = np.flatnonzero(_inside(ptr, len(h), 2))
            at = at[of[at] >= 0]
            prob, weight = t.triples(of[at], ranks[at + 1])
            p[at + 2] = prob + weight * p[at + 2]
    return count, base, np.log10(p)


def score(docs: DataFrame, info: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(info)
        for batch in batches:
            for lo, hi, data, off in W.chunks(batch.column(1), CHUNK):
                h, ptr = tokens(data, off)
                count, base, model = log_probabilities(t, h, ptr)
                sums = [np.add.reduceat(x, ptr[:-1]) for x in ((count > 0).astype(np.int64), base, model)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ptr).astype(np.int64)), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and scores all."""
    info = train(docs.where(~held_out()))
    return score(docs, info).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(info["total"]).cast("long").alias("train_tokens"), "base_score", "score")
