"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes (ASCII capitals folded) forwards and backwards and labels every position; a
document's probabilities pool the log-probabilities of its positions in letters.  Texts of any length are read whole: long
ones in stretches of SPAN bytes, each together with CONTEXT bytes on either side, over which the states settle and which
are not labelled there.  Training is backpropagation through time in numpy, on the driver, over stretches of a bounded
sample.

Defined cases: null text, or text without a letter, is ``und`` with score 0; ties go to the first language in sorted
order; repeated rows get the same answer; without labelled rows nothing is learned and all rows are ``und``; an empty
table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm import words as W
from tidemark.llm.store import lean, small_batches

UND = "und"
#: Documents of each language that the network is fitted on, at most (about: rows are taken by hash), and stretches of
#: a document and their characters.
SAMPLE_PER_LANGUAGE, PIECES, PIECE = 400, 4, 120
HIDDEN, STEPS, BATCH, RATE, TRAIN_SPAN = 8, 400, 128, 0.02, 40
#: Bytes labelled in one stretch, and bytes read on either side of it; stretches run together.
SPAN, CONTEXT, TOGETHER = 512, 32, 512
#: Bytes of text whose stretches are laid out at a time.
CHUNK = 1 << 18
LATIN = re.compile(r"[A-Za-z]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: Bytes that can be part of a letter.
_SPOKEN = (np.arange(256) >= 0x80) | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A))
F32 = np.float32


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    shape = lambda *s, scale: (rng.standard_normal(s) * scale).astype(F32)
    w = {}
    for side in "fb":
        w[f"x{side}"] = shape(256, 3 * hidden, scale=0.3)  # bytes straight to the gates: reset, update, candidate
        w[f"h{side}"] = shape(hidden, 3 * hidden, scale=1 / np.sqrt(hidden))
        w[f"o{side}"] = shape(hidden, len(languages), scale=1 / np.sqrt(hidden))
    w["o"] = np.zeros(len(languages), F32)
    return Network(languages, w)


def _run(w: dict[str, np.ndarray], side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, batch, hidden) of one direction over bytes (batch, steps); -1 leaves the state as it is."""
    hidden = w[f"h{side}"].shape[0]
    h = np.zeros((len(x), hidden), F32)
    out = np.zeros((x.shape[1], len(x), hidden), F32)
    for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
        on = x[:, t] >= 0
        given = w[f"x{side}"][np.maximum(x[:, t], 0)]
        told = h @ w[f"h{side}"][:, : 2 * hidden]
        r = _sigmoid(given[:, :hidden] + told[:, :hidden])
        z = _sigmoid(given[:, hidden : 2 * hidden] + told[:, hidden:])
        c = np.tanh(given[:, 2 * hidden :] + (r * h) @ w[f"h{side}"][:, 2 * hidden :])
        new = np.where(on[:, None], z * h + (1 - z) * c, h)
        if keep is not None:
            keep.append((t, h, r, z, c, on))
        out[t] = h = new
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _labels(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Log-probabilities (steps, batch, languages) of every position."""
    return _log_softmax(_run(w, "f", x) @ w["of"] + _run(w, "b", x) @ w["ob"] + w["o"])


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    w, kept = net.weights, {"f": [], "b": []}
    states = {s: _run(w, s, x, kept[s]) for s in "fb"}
    logp = _log_softmax(states["f"] @ w["of"] + states["b"] @ w["ob"] + w["o"])
    on = (x >= 0).T
    n = on.sum()
    loss = -float(logp[:, np.arange(len(y)), y][on].sum()) / n
    d = np.exp(logp)
    d[:, np.arange(len(y)), y] -= 1
    d *= on[:, :, None] / n
    g = {"o": d.sum((0, 1))}
    for s in "fb":
        hidden = w[f"h{s}"].shape[0]
        g[f"o{s}"] = np.einsum("tbh,tbl->hl", states[s], d)
        g[f"x{s}"], g[f"h{s}"] = np.zeros_like(w[f"x{s}"]), np.zeros_like(w[f"h{s}"])
        back, given = np.zeros((len(x), hidden), F32), []
        for t, h, r, z, c, live in reversed(kept[s]):
            back = back + d[t] @ w[f"o{s}"].T
            here = back * live[:, None]
            dc = here * (1 - z) * (1 - c * c)
            dz = here * (h - c) * z * (1 - z)
            through = dc @ w[f"h{s}"][:, 2 * hidden :].T
            dr = through * h * r * (1 - r)
            gates = np.concatenate([dr, dz], 1)
            g[f"h{s}"][:, : 2 * hidden] += h.T @ gates
            g[f"h{s}"][:, 2 * hidden :] += (r * h).T @ dc
            given.append((np.maximum(x[:, t], 0), np.concatenate([gates, dc], 1)))
            back = back * ~live[:, None] + here * z + through * r + gates @ w[f"h{s}"][:, : 2 * hidden].T
        at, parts = np.concatenate([a for a, _ in given]), np.concatenate([b for _, b in given])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        g[f"x{s}"][at[order][first]] = np.add.reduceat(parts[order], first, axis=0)
    return loss, g


def batch_of(pieces: list[bytes]) -> np.ndarray:
    out = np.full((len(pieces), max(map(len, pieces))), -1, np.int16)
    for k, piece in enumerate(pieces):
        out[k, : len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and (LATIN.search(text) is not None or any(map(str.isalpha, text)))


def stretches(texts: list[bytes], rng: np.random.Generator, each: int) -> list[bytes]:
    """Random stretches of texts, drawn by the texts' lengths."""
    sizes = np.array([len(t) for t in texts], float)
    out = []
    for k in rng.choice(len(texts), each, p=sizes / sizes.sum()):
        at = int(rng.integers(max(len(texts[k]) - TRAIN_SPAN // 2, 1)))
        out.append(texts[k][at : at + TRAIN_SPAN])
    return out


def fit(texts: dict[str, list[bytes]], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over batches that draw languages alike and stretches by length."""
    languages = sorted(texts)
    net, rng = fresh(languages, seed=seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    each = max(1, BATCH // len(languages))
    for step in range(1, steps + 1):
        drawn = [x for k in languages for x in stretches(texts[k], rng, each)]
        _, g = gradients(net, batch_of(drawn), np.repeat(np.arange(len(languages)), each))
        rate = RATE * (1 - step / (steps + 1))
        for k, v in g.items():
            first[k] = F32(0.9) * first[k] + F32(0.1) * v
            second[k] = F32(0.99) * second[k] + F32(0.01) * v * v
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(F32)
    return net


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % by


def train(docs: DataFrame) -> Network | None:
    """Fit on words of labelled rows outside the held-out third, a bounded number of rows a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(remainder(F.col("doc_id"), 3), F.lit(0)) != 1))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n))).otherwise(share)
    text = F.col("text").cast("string")
    at = lambda k: 1 + F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length(text) - PIECE, F.lit(1)))
    cut = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda k: F.substr(text, at(k).cast("int"), F.lit(PIECE)))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", cut.alias("pieces"))
    texts: dict[str, list[bytes]] = {}
    # so many rows at most, of PIECES * PIECE characters
    for row in drawn.limit(2 * SAMPLE_PER_LANGUAGE * len(sizes)).collect():
        for piece in dict.fromkeys(row["pieces"]):
            if has_letter(piece):
                texts.setdefault(row["lang"], []).append(_FOLD[np.frombuffer(piece.encode(), np.uint8)].tobytes())
    return fit(texts) if texts else None


class Labeller:
    """The network over many stretches at a time, its gates laid out for that."""

    def __init__(self, net: Network, together: int | None = None):
        w, self.hidden, self.together = net.weights, net.weights["hf"].shape[0], together or TOGETHER
        self.languages, self.bias = net.languages, w["o"]
        n = 2 * self.hidden
        scale = np.ones(3 * self.hidden, F32)
        scale[:n] = 0.5  # a sigmoid is half a tangent of half its argument
        # reset, update and candidate of each byte; a row of zeros ends stretches
        self.sides = [(np.ascontiguousarray(w[f"x{s}"] * scale), np.ascontiguousarray(w[f"h{s}"][:, :n] * F32(0.5)), np.ascontiguousarray(w[f"h{s}"][:, n:]), w[f"o{s}"]) for s in "fb"]

    def _side(self, x: np.ndarray, live: np.ndarray, side: int) -> np.ndarray:
        """(steps, stretches, languages) contributions of one direction; ``live`` stretches, the first, have a step."""
        given, gates, candidate, out = self.sides[side]
        n, hidden = x.shape[1], self.hidden
        h, both = np.zeros((n, hidden), F32), np.empty((n, 2 * hidden), F32)
        states = np.empty((len(x), n, hidden), F32)
        told, new = np.empty((n, 3 * hidden), F32), np.empty((n, hidden), F32)
        for t, m in enumerate(live.tolist()):
            hm, bm, tm, nm = h[:m], both[:m], told[:m], new[:m]
            np.take(given, x[t, :m], axis=0, out=tm, mode="clip")
            np.matmul(hm, gates, out=bm)
            bm += tm[:, : 2 * hidden]
            np.tanh(bm, out=bm)
            bm *= F32(0.5)
            bm += F32(0.5)
            np.multiply(bm[:, :hidden], hm, out=nm)
            c = nm @ candidate
            c += tm[:, 2 * hidden :]
            np.tanh(c, out=c)
            hm -= c
            hm *= bm[:, hidden:]
            hm += c
            states[t, :m] = hm
        return (states.reshape(-1, hidden) @ out).reshape(len(x), n, -1)

    def sums(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each row the sums of its letters' log-probabilities, and their number."""
        size = np.diff(off)
        pieces = -(-size // SPAN)
        row = np.repeat(np.arange(len(size)), pieces)
        begin = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPAN
        end = np.minimum(begin + SPAN, off[row + 1])
        lo, hi = np.maximum(begin - CONTEXT, off[row]), np.minimum(end + CONTEXT, off[row + 1])
        total = np.zeros((len(size), len(self.languages) + 1))
        order = np.argsort(lo - hi, kind="stable")
        folded = _FOLD[data]
        for k in range(0, len(order), self.together):
            some = order[k : k + self.together]
            length = (hi - lo)[some]
            steps = np.arange(length[0])
            inside = steps[:, None] < length
            ahead = np.where(inside, lo[some] + steps[:, None], 0)
            x = folded[ahead]
            back = np.where(inside, length - 1 - steps[:, None], 0)
            live = inside.sum(1)
            logits = self._side(x, live, 0)
            other = self._side(folded[np.where(inside, lo[some] + back, 0)], live, 1)
            logits += np.take_along_axis(other, back[:, :, None], 0)
            logits += self.bias
            wanted = inside & (ahead >= begin[some]) & (ahead < end[some]) & _SPOKEN[x]
            held = logits[wanted]
            held -= held.max(1, keepdims=True)
            held -= np.log(np.exp(held).sum(1, keepdims=True))
            at = row[some][np.nonzero(wanted)[1]]
            for c in range(held.shape[1]):
                total[:, c] += np.bincount(at, held[:, c], len(size))
            total[:, -1] += np.bincount(at, minlength=len(size))
        return total

    def predict(self, column: pa.Array) -> Iterator[tuple[str, float]]:
        for lo, hi, data, off in W.chunks(column, CHUNK):
            sums = self.sums(data, off)
            for k, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
                if not has_letter(text):
                    yield UND, 0.0
                    continue
                pooled = np.exp(_log_softmax(sums[k, :-1] / max(sums[k, -1], 1)))
                best = int(pooled.argmax())
                yield self.languages[best], float(pooled[best])


def predict(docs: DataFrame, net: Network | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), together: int | None = None) -> DataFrame:
    """``keep`` columns (doc_id) and the answer's columns, ``names``, which must not be among them.

    ``together`` (TOGETHER) bounds the stretches that a worker holds at a time; it changes the time, not the result.  A text that is
    kept goes to the workers once.
    """
    keep = keep or ["doc_id"]
    if net is None:
        return docs.select(*keep, F.lit(UND).alias(names[0]), F.lit(0.0).alias(names[1]))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(*keep)
    held, read = len(rows.columns), rows.columns.index("text") if "text" in rows.columns and rows.schema["text"].dataType == StringType() else -1
    if read < 0:
        rows = docs.select(*keep, F.col("text").cast("string").alias("_read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, together)
        for batch in batches:
            found = list(labeller.predict(batch.column(read % batch.num_columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names[:held], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:held])
    return rows.mapInArrow(lean(run), f"{schema}, {names[0]} string, {names[1]} double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
