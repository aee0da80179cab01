"""Language ID (operator 1): a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

Every position of a text gets language probabilities from the state that has read up to it and the state that has
read back to it; a document's probabilities are the mean over all its positions. Whole texts are read, in windows of
SPAN bytes (the last one ends with the text), thousands of windows a step.

Fitting uses a bounded sample: at most PER_LANGUAGE labelled rows of each language, PIECES windows of each, the rows
with the smallest hashes, so the same table gives the same network however it is partitioned.

Nulls: a null text, an empty one or one without a letter is ``und`` with score 0, and so is every text when nothing
labelled is there to learn from. A tie goes to the first language in code point order. Repeated rows are predicted
alike. An empty table gives an empty result. Columns named lang_pred or score are replaced, any other name may occur.
A text of any length is read whole, WIDE windows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import tune
from strata.llm.repeats import texts_of

SPAN, HIDDEN = 64, 8
PER_LANGUAGE, PIECES = 400, 6
STEPS, BATCH, RATE = 500, 192, 0.02
#: Windows that are run side by side.
WIDE = 4096
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = {
            **{f"in{d}": draw(256, 3 * hidden) for d in "fb"},
            **{f"state{d}": draw(hidden, 3 * hidden) for d in "fb"},
            "out": draw(2 * hidden, len(languages)),
            "bias": np.zeros(len(languages), np.float32),
        }

    def _direction(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after each step; x is (steps, windows) bytes in reading order."""
        n, table, mat = self.hidden, self.weights[f"in{d}"], self.weights[f"state{d}"]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            a, u = table[x[t]], h @ mat
            gates = a[:, : 2 * n]
            gates += u[:, : 2 * n]
            _sigmoid(gates)
            z, r = gates[:, :n], gates[:, n:]
            c = a[:, 2 * n :] + r * u[:, 2 * n :]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((h, z, r, c, u[:, 2 * n :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte of the windows x (windows, steps)."""
        x = np.ascontiguousarray(x.T)
        both = np.concatenate([self._direction(x, "f"), self._direction(x[::-1], "b")[::-1]], axis=2)
        y = both @ self.weights["out"] + self.weights["bias"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y.transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the masked positions and its gradients, through all steps of both directions."""
        n, w = self.hidden, self.weights
        x, mask = np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)
        trace: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._direction(x, "f", trace["f"]), self._direction(x[::-1], "b", trace["b"])[::-1]], axis=2)
        y = both @ w["out"] + w["bias"]
        y -= y.max(axis=2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=2, keepdims=True)
        rows, total = np.arange(x.shape[1]), max(1.0, float(mask.sum()))
        loss = float(-(np.log(p[:, rows, label] + 1e-9) * mask).sum() / total)
        p[:, rows, label] -= 1
        p *= (mask / total)[:, :, None]
        grad = {"out": np.einsum("tnh,tnc->hc", both, p), "bias": p.sum(axis=(0, 1))}
        back = p @ w["out"].T
        for d in "fb":
            xs, g = (x, back[..., :n]) if d == "f" else (x[::-1], back[::-1, :, n:])
            table, mat, dh = np.zeros_like(w[f"in{d}"]), np.zeros_like(w[f"state{d}"]), np.zeros_like(g[0])
            for t in range(len(xs) - 1, -1, -1):
                h, z, r, c, u = trace[d][t]
                dh = dh + g[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                to_state = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(table, xs[t], np.concatenate([dz, dr, dc], axis=1))
                mat += h.T @ to_state
                dh = dh * z + to_state @ w[f"state{d}"].T
            grad[f"in{d}"], grad[f"state{d}"] = table, mat
        return loss, grad

    def fit(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 11) -> Network:
        """Adam on mini-batches with as many windows of each language."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(label == c) for c in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(v) for k, v in self.weights.items()}
        each = max(1, BATCH // len(of))
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(i, each) for i in of])
            _, grad = self.gradients(x[pick], label[pick], mask[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.weights[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled probabilities of each document; a document without bytes gets zeros."""
        size = np.diff(offsets)
        count = -(-size // SPAN)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        # the last window ends with the text and counts only what the one before has not
        start = np.minimum(nth * SPAN, np.maximum(size[doc] - SPAN, 0))
        skip = nth * SPAN - start
        last = np.minimum(size[doc] - start, SPAN)
        out = np.zeros((len(size), len(self.languages)))
        padded = np.concatenate([data, np.full(SPAN, 32, np.uint8)])
        grid = np.arange(SPAN)
        for lo in range(0, len(doc), WIDE):
            d, s, k, z = (c[lo : lo + WIDE] for c in (doc, start, skip, last))
            x = padded[(offsets[d] + s)[:, None] + grid]
            x[grid[None, :] >= z[:, None]] = 32
            use = (grid[None, :] >= k[:, None]) & (grid[None, :] < z[:, None])
            np.add.at(out, d, np.einsum("ntc,nt->nc", self.positions(x), use.astype(np.float32)))
        return out / np.maximum(size, 1)[:, None]


def training_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> list:
    """(lang, pieces) of at most per_language labelled rows of each language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.length(text), F.substring(text, 1, 64)).alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    low, share = -(1 << 63), {k: min(1.0, 2 * per_language / n) for k, n in counts.items()}
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min((1 << 63) - 1, low + int(s * 2**64)))) for k, s in sorted(share.items())])
    at = [F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("text") - SPAN, F.lit(1))).cast("int") + 1 for i in range(PIECES)]
    near = labelled.where(F.col("h") <= limit).select("lang", "h", F.array(*[F.substring("text", a, F.lit(SPAN)) for a in at]).alias("pieces"))
    taken: dict[str, list] = {k: [] for k in counts}
    for r in near.dropDuplicates(["lang", "h"]).orderBy("h", "lang").limit(4 * per_language * len(counts)).collect():
        if len(taken[r["lang"]]) < per_language:
            taken[r["lang"]].append(r)
    return [r for k in sorted(taken) for r in taken[k]]


def train(rows: list) -> Network | None:
    """A network fitted to (lang, pieces) rows; None without any."""
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    pieces = [(languages.index(r["lang"]), p.encode("utf-8", "surrogatepass")[:SPAN]) for r in rows for p in dict.fromkeys(r["pieces"]) if p]
    x = np.frombuffer(b"".join(p.ljust(SPAN) for _, p in pieces), np.uint8).reshape(-1, SPAN)
    label = np.array([c for c, _ in pieces])
    mask = (np.arange(SPAN)[None, :] < np.array([len(p) for _, p in pieces])[:, None]).astype(np.float32)
    found = np.unique(label)
    if len(found) < len(languages):  # a language with empty texts only
        languages = [languages[c] for c in found]
        label = np.searchsorted(found, label)
    return Network(languages).fit(x, label, mask) if languages else None


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (columns of these names in docs are replaced)."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    slim = docs.select(*names, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("strata_has_letter"))
    at = names.index(text)

    def run(batches):
        for b in batches:
            known = b.column(len(names)).to_numpy(zero_copy_only=False)
            label, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            for i, j, data, offsets in texts_of(b.column(at)):
                if network is None:
                    break
                p = network.documents(data, offsets)
                ok = known[i:j]
                label[i:j][ok] = np.array(network.languages, object)[p.argmax(axis=1)][ok]
                score[i:j][ok] = np.clip(np.round(p.max(axis=1), 6), 0, 1)[ok]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(label, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out; predict every row."""
    return predict(docs, train(training_rows(docs.where(~held_out(id_col)), id_col, text, lang)), text)
