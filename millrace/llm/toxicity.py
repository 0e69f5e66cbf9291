"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the vector of the word itself and the sum of those of its character n-grams: all runs of 3, 5 and 7
characters of the word with a mark at either end, hashed to ``BUCKETS`` rows, so words never seen in training still tell
by what they are made of. The vectors start from how much more often training documents of one label have the word or
n-gram than those of the other, and are trained along with the network. It reads windows of ``WINDOW`` words that overlap
by a quarter, forwards and backwards; attention pools the states of each window; a document's score is that of its highest
window, over all windows of its whole text. Only the model, whose size is bounded by that of the training sample, goes to
the executors.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, held, ship, slices, table

WINDOW, STRIDE = 32, 24
WORD_DIM = CHAR_DIM = 4
HIDDEN, ATTEND = 8, 8
GRAMS, BUCKETS = (3, 5, 7), 1 << 16
SOME = 10_000  # tokens whose n-grams the driver holds at once, beside their rows
EDGE = ".,;:!?\"'()[]{}<>*_-"


def word_of(token: str) -> str:
    return token.strip(EDGE).lower() or token


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which word each character n-gram is of (in ascending order), and its row."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = codes == 10
    word = np.cumsum(edge) - 1
    owners, rows = [np.zeros(0, int)], [np.zeros(0, np.int32)]
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h, whole = np.zeros(count, np.uint64), np.ones(count, bool)
        for k in range(n):
            h = h * np.uint64(0x2545F4914F6CDD1D) + codes[k : k + count]
            if 0 < k < n - 1:
                whole &= ~edge[k : k + count]
        h = h[whole]
        owners.append(word[:count][whole])
        rows.append(((h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(rows)[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def window_starts(n: int) -> list[int]:
    """Windows overlap by a quarter and reach the last word."""
    return list(range(0, n - WINDOW + STRIDE, STRIDE)) if n > WINDOW else [0]


def smallest(tokens: list[str], slots: int = 4) -> list[int]:
    """The least hash of the runs of three words in each of some slots; near copies share most of them."""
    least: dict[int, int] = {}
    for run in zip(tokens, tokens[1:], tokens[2:], strict=False):
        h = zlib.crc32(" ".join(run).encode("utf-8", "surrogatepass"))
        if h < least.get(h % slots, 1 << 32):
            least[h % slots] = h
    return [least[k] for k in sorted(least)]


def evidence(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds for label 1 of features that ``counts`` (two rows, one a label) documents have, of ``n`` each.

    A prior of four documents, dealt as the labels are, is added; and what so many features give by chance counts for
    nothing (the log-likelihood ratio against the log of their number)."""
    (b, a), share = counts.astype(float), n[1] / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(a * np.log(a / (a + b) / share)) + np.nan_to_num(b * np.log(b / (a + b) / (1 - share)))
    prior = 4 * n / n.sum()
    plain = np.log((a + prior[1]) / (n[1] + prior[1])) - np.log((b + prior[0]) / (n[0] + prior[0]))
    return plain * np.clip(ratio / np.log(max(2, len(a))) - 0.6, 0, 0.6) / 0.6


class Lexicon:
    """Words that at least ``least`` training documents have and character n-grams, with their evidence."""

    def __init__(self, texts: list[str], labels: np.ndarray, least: int = 3):
        words = [Counter(), Counter()]
        chars = np.zeros((2, BUCKETS), np.int64)
        seen: set = set()
        for text, label in zip(texts, labels, strict=True):
            marks = {(k, label, m) for k, m in enumerate(smallest(text.split()))}
            copy = not seen.isdisjoint(marks)
            seen |= marks
            if copy:  # copies and near copies of a document are no further evidence
                continue
            own = {word_of(t) for t in text.split()}
            words[label].update(own)
            chars[label][np.unique(char_grams([*own])[1])] += 1
        n = np.asarray([max(1, int((labels == k).sum())) for k in (0, 1)])
        names = [k for k in sorted(words[0].keys() | words[1].keys()) if words[0][k] + words[1][k] >= least]
        self.words = {k: i + 1 for i, k in enumerate(names)}
        self.word_start = np.concatenate([[0.0], evidence(np.asarray([[c[k] for k in names] for c in words]).reshape(2, -1), n)])
        self.char_start = np.zeros(BUCKETS)
        used = chars.sum(0) >= least
        self.char_start[used] = evidence(chars[:, used], n)


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, lexicon: Lexicon, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.key, self.words = uuid.uuid4().hex, lexicon.words
        draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape)
        dim = WORD_DIM + CHAR_DIM
        self.p = {"word": draw(len(lexicon.word_start), WORD_DIM, scale=0.01), "char": draw(BUCKETS, CHAR_DIM, scale=0.001)}
        self.p["word"][:, 0] = 0.4 * lexicon.word_start
        self.p["char"][:, 0] = 0.05 * lexicon.char_start
        self.p["word"][0] = 0
        for d in "fb":
            self.p |= {f"{d}x": draw(dim, 3 * HIDDEN, scale=0.3), f"{d}h": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"{d}b": np.zeros(3 * HIDDEN)}
        self.p |= {"a": draw(2 * HIDDEN, ATTEND, scale=0.3), "ab": np.zeros(ATTEND), "v": draw(ATTEND, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1.0)}

    def gathered(self, ids: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Vectors of words with these numbers and n-grams (whose of them, which row)."""
        chars = [np.bincount(owner, self.p["char"][rows, d], len(ids)) for d in range(CHAR_DIM)]
        return np.concatenate([self.p["word"][ids], np.stack(chars, 1)], 1)

    def vectors(self, tokens: list[str]) -> np.ndarray:
        words = [*map(word_of, tokens)]
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        return self.gathered(ids, *char_grams(words))

    def _gru(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN) for inputs already projected; masked steps carry the state on."""
        steps, n, _ = x.shape
        h, out = np.zeros((n, HIDDEN), x.dtype), np.empty((steps, n, HIDDEN), x.dtype)
        u = self.p[f"{d}h"].astype(x.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            gates = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
            h = h + mask[t, :, None] * (1 - z) * (new - h)
            out[t] = h
        return out

    def project(self, vectors: np.ndarray) -> dict[str, list[np.ndarray]]:
        """Word vectors as the gates of either direction take them."""
        return {d: [np.ascontiguousarray(x, np.float32) for x in np.split(vectors @ self.p[f"{d}x"] + self.p[f"{d}b"], 3, 1)] for d in "fb"}

    def logits(self, projected: dict[str, list[np.ndarray]], words: np.ndarray) -> np.ndarray:
        """Logits of windows of word numbers (steps, windows; 0: none): ``forward`` in single precision, nothing kept."""
        steps, n = words.shape
        mask = (words > 0).astype(np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            uz, ur, un = (np.ascontiguousarray(u, np.float32) for u in np.split(self.p[f"{d}h"], 3, 1))
            xz, xr, xn = projected[d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                w = words[t]
                z = h @ uz
                z += xz[w]
                z *= 0.5
                np.tanh(z, z)
                r = h @ ur
                r += xr[w]
                r *= 0.5
                np.tanh(r, r)
                r += 1
                r *= 0.5
                r *= h @ un
                r += xn[w]
                np.tanh(r, r)
                r -= h  # new - h
                z -= 1
                z *= -0.5  # 1 - z
                z *= mask[t, :, None]
                r *= z
                h += r
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        p = {k: self.p[k].astype(np.float32) for k in ("a", "ab", "v", "out")}
        tops = states.reshape(-1, 2 * HIDDEN) @ p["a"]
        tops += p["ab"]
        np.tanh(tops, tops)
        e = (tops @ p["v"]).reshape(steps, n) + (mask - 1) * np.float32(1e9)
        weight = np.exp(e - e.max(0)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        return (weight * (states.reshape(-1, 2 * HIDDEN) @ p["out"]).reshape(steps, n)).sum(0) + self.p["bias"]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from word vectors (steps, windows, dim) and mask (steps, windows)."""
        p, kept = self.p, {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        states = np.concatenate([self._gru(x @ p[f"{d}x"].astype(x.dtype) + p[f"{d}b"].astype(x.dtype), mask, d, kept[d]) for d in "fb"], 2)
        tops = np.tanh(states @ p["a"].astype(x.dtype) + p["ab"].astype(x.dtype))
        e = np.where(mask > 0, tops @ p["v"].astype(x.dtype), -1e9)
        weight = np.exp(e - e.max(0)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[..., None] * states).sum(0)
        if keep is not None:
            keep |= {"states": states, "tops": tops, "weight": weight, "pooled": pooled, "gru": kept}
        return pooled @ p["out"].astype(x.dtype) + p["bias"].astype(x.dtype)

    def backward(self, x: np.ndarray, mask: np.ndarray, k: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and the inputs for the logits' ``slope``."""
        p, g = self.p, {}
        g["out"], g["bias"] = k["pooled"].T @ slope, slope.sum(keepdims=True)
        pooled = slope[:, None] * p["out"]
        states = k["weight"][..., None] * pooled
        e = (k["states"] * pooled).sum(2)
        e = k["weight"] * (e - (k["weight"] * e).sum(0))
        g["v"] = e.ravel() @ k["tops"].reshape(-1, ATTEND)
        tops = e[..., None] * p["v"] * (1 - k["tops"] ** 2)
        g["a"], g["ab"] = k["states"].reshape(-1, 2 * HIDDEN).T @ tops.reshape(-1, ATTEND), tops.sum((0, 1))
        states = states + tops @ p["a"].T
        inputs = np.zeros_like(x)
        for d, cols in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            gx, gh, back = np.zeros(x.shape[:2] + (3 * HIDDEN,)), np.zeros_like(p[f"{d}h"]), np.zeros((x.shape[1], HIDDEN))
            for t, h, z, r, new, hn in reversed(k["gru"][d]):
                total = back + states[t, :, cols]
                m = mask[t, :, None]
                dn = total * m * (1 - z) * (1 - new**2)
                dz = total * m * (h - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                gx[t] = np.concatenate([dz, dr, dn], 1)
                hidden = np.concatenate([dz, dr, dn * r], 1)
                gh += h.T @ hidden
                back = total * (1 - m * (1 - z)) + hidden @ p[f"{d}h"].T
            g[f"{d}x"], g[f"{d}h"], g[f"{d}b"] = x.reshape(-1, x.shape[2]).T @ gx.reshape(-1, 3 * HIDDEN), gh, gx.sum((0, 1))
            inputs += gx @ p[f"{d}x"].T
        return g, inputs


class Training:
    """The training texts as numbers of their tokens, whose word ids and n-grams are listed once."""

    def __init__(self, net: Network, texts: list[str]):
        place: dict[str, int] = {}
        self.docs = [np.asarray([place.setdefault(t, len(place) + 1) for t in text.split()], int) for text in texts]
        words = ["", *map(word_of, place)]
        self.ids = np.fromiter((net.words.get(w, 0) for w in words), np.int64, len(words))
        many, rows = [np.zeros(1, int)], [np.zeros(0, np.int32)]  # number 0 is no word
        for k in range(1, len(words), SOME):
            owner, own = char_grams(words[k : k + SOME])
            many.append(np.bincount(owner, minlength=len(words[k : k + SOME])))
            rows.append(own)
        self.rows = np.concatenate(rows)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(many))])

    def grams(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.at[tokens + 1] - self.at[tokens]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(np.arange(len(tokens)), many), self.rows[np.repeat(self.at[tokens], many) + inside]

    def signs(self, net: Network) -> np.ndarray:
        """Each token's evidence so far."""
        out = np.empty(len(self.ids))
        for k in range(0, len(out), SOME):
            tokens = np.arange(k, min(k + SOME, len(out)))
            owner, rows = self.grams(tokens)
            out[tokens] = net.p["word"][self.ids[tokens], 0] + np.bincount(owner, net.p["char"][rows, 0], len(tokens))
        return out


def _windows(docs: list[np.ndarray], at: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers and mask of the windows (document, start) in ``at``."""
    tokens, mask = np.zeros((WINDOW, len(at)), int), np.zeros((WINDOW, len(at)))
    for j, (doc, start) in enumerate(at):
        part = docs[doc][start : start + WINDOW]
        tokens[: len(part), j], mask[: len(part), j] = part, 1
    return tokens, mask


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 256, least_steps: int = 240, rate: float = 0.01, least: float = 0.5, seed: int = 5) -> Network:
    """Fit to labelled documents, by at least ``least_steps`` steps of Adam.

    A document's label is laid on the window with the strongest evidence so far, for documents without toxicity on two
    more; which windows these are is found anew in each epoch. A toxic document without evidence over ``least`` sits out:
    nothing shows where it is toxic.
    """
    net = Network(Lexicon(texts, labels), seed)
    blank = max(8, len(texts) // 20)  # texts without words aren't toxic
    texts, labels = [*texts, *[""] * blank], np.concatenate([labels, np.zeros(blank, int)])
    rng = np.random.default_rng(seed)
    data = Training(net, texts)
    batch = max(32, min(batch, 2 * len(texts) // 8))
    first, second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    weight = np.array([1.0, min(8.0, max(1.0, (labels == 0).sum() / max(1, (labels == 1).sum())))])
    epoch = 0
    while len(texts) and (epoch < epochs or step < least_steps):
        epoch += 1
        at, ys = [], []
        signs = data.signs(net)
        for doc, tokens in enumerate(data.docs):
            starts = window_starts(len(tokens))
            chosen = set()
            if len(tokens):
                peak = int(np.argmax(signs[tokens]))
                if not labels[doc] or signs[tokens[peak]] > least:
                    chosen.add(next(s for s in reversed(starts) if s <= peak))
            if not labels[doc]:
                chosen |= {int(s) for s in rng.choice(starts, 2)}
            at += [(doc, s) for s in chosen]
            ys += [labels[doc]] * len(chosen)
        order = rng.permutation(len(at))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            tokens, mask = _windows(data.docs, [at[i] for i in part])
            y = np.asarray([ys[i] for i in part], float)
            own, place = np.unique(tokens, return_inverse=True)
            owner, rows = data.grams(own)
            x = net.gathered(data.ids[own], owner, rows)[place.reshape(tokens.shape)]
            keep: dict = {}
            slope = (sigmoid(net.forward(x, mask, keep)) - y) * weight[y.astype(int)] / len(part)
            g, inputs = net.backward(x, mask, keep, slope)
            step += 1
            for name, value in g.items():
                first[name] += 0.1 * (value - first[name])
                second[name] += 0.001 * (value**2 - second[name])
                net.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            # the vectors: plain steps, of the rows that occurred
            inputs *= -rate * mask[..., None]
            moves = np.stack([np.bincount(place.ravel(), inputs[..., d].ravel(), len(own)) for d in range(WORD_DIM + CHAR_DIM)], 1)
            np.add.at(net.p["word"], data.ids[own], moves[:, :WORD_DIM])
            np.add.at(net.p["char"], rows, moves[owner, WORD_DIM:])
            net.p["word"][0] = 0
    return net


class Known:
    """Vectors of tokens; those of about ``kept`` seen lately aren't computed again."""

    def __init__(self, net: Network, kept: int = 200_000):
        self.net, self.kept, self.known, self.old = net, kept, {}, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """Vectors of different tokens after one of zeros."""
        if len(self.known) >= self.kept:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = [known.get(t) or old.get(t) for t in tokens]
        if new := [t for t, v in zip(tokens, found, strict=True) if v is None]:
            made = iter([v.tobytes() for v in self.net.vectors(new).astype(np.float32)])
            found = [v or next(made) for v in found]
        known.update(zip(tokens, found, strict=True))
        return np.frombuffer(bytes(4 * (WORD_DIM + CHAR_DIM)) + b"".join(found), np.float32).reshape(-1, WORD_DIM + CHAR_DIM)


def text_scores(net: Network, known: Known, bodies: list[str], most: int = 2048) -> list[float]:
    """Scores of whole texts: the highest of all their windows."""
    split = [t.split() for t in bodies]
    unique = list(set().union(*split)) if split else []
    place = {w: i + 1 for i, w in enumerate(unique)}
    vectors = known(unique)
    rows, owner = [], []
    for doc, words in enumerate(split):
        ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        starts = np.asarray(window_starts(len(ids)))
        padded = np.zeros(starts[-1] + WINDOW, np.int64)
        padded[: len(ids)] = ids
        rows.append(padded[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), doc))
    windows, owner = np.concatenate(rows), np.concatenate(owner)
    projected = net.project(vectors)
    logits = np.concatenate([net.logits(projected, np.ascontiguousarray(windows[k : k + most].T)) for k in range(0, len(windows), most)])
    top = np.full(len(bodies), -np.inf)
    np.maximum.at(top, owner, logits)
    return sigmoid(top).tolist()


def score_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    net = model.value
    known = held(("toxicity", net.key), lambda: Known(net))
    for batch in batches:
        bodies = batch.column(batch.num_columns - 1).to_pylist()
        scores = [s for a, b in slices(bodies, 1 << 20) for s in text_scores(net, known, bodies[a:b])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, held: int, sample: int, longest: int) -> list:
    """About ``sample`` documents of either label (all if there are fewer; at most 3 * ``sample`` in all), none over
    ``longest`` characters, none held out; chosen by a hash of the id. Of rows that share an id the least text counts."""
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(crc_mod("doc_id", modulus) != held)
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.when(F.col("toxic") == 1, sample / max(sample, counts.get(1, 0))).otherwise(sample / max(sample, counts.get(0, 0)))
    chosen = known.filter(share < keep).orderBy(share, "doc_id").limit(3 * sample)
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= longest)
    own = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return own.orderBy("doc_id").collect()  # at most 3 * sample rows


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: int = 1500, longest: int = 20_000) -> Network:
    """A network trained on a bounded sample: about ``sample`` documents of either label of at most ``longest``
    characters. Rows whose crc32(doc_id as text) modulo ``modulus`` is ``held`` are never learned from."""
    rows = training_rows(docs, labels, modulus, held, sample, longest)
    return train([r.text for r in rows], np.asarray([r.toxic for r in rows], int))


def score_toxicity(docs: DataFrame, net: Network, *more: str) -> DataFrame:
    """doc_id, the columns in ``more`` and score (0 to 1) of every text.

    Null and empty texts get the score of a window without words; repeated rows are scored each; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(net)
    rows = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", score double"
    return rows.mapInArrow(lambda b: score_rows(b, model), schema)


def _clean(batches: Iterator[pa.RecordBatch], model, at: int, cut: float) -> Iterator[pa.RecordBatch]:
    net = model.value
    known = held(("toxicity", net.key), lambda: Known(net))
    for batch in batches:
        bodies = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in slices(bodies, 1 << 20):
            scores = text_scores(net, known, bodies[a:b])
            yield pa.RecordBatch.from_arrays([c[a:b] for c in batch.columns], schema=batch.schema).filter(pa.array([s < cut for s in scores]))


def without_toxic(docs: DataFrame, net: Network, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text scores under ``cut``."""
    spark = docs.sparkSession
    ship(spark)
    model, at = spark.sparkContext.broadcast(net), docs.columns.index("text")
    return docs.mapInArrow(lambda b: _clean(b, model, at, cut), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from a network trained on the labels not held out."""
    rows = docs.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), "text")
    return score_toxicity(rows, fit(docs, labels, modulus, held), "held_out").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
