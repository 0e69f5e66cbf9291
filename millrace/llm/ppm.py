"""Language-model scoring by prediction by partial matching, beside a unigram baseline.

The model is a trie of byte contexts up to ``order`` bytes deep with the counts of what followed each. A byte not seen
after the longest context costs an escape (method C: the number of different followers over that number plus all
followers) and is looked for after the next shorter context, from which what the longer one has seen is excluded; below
order 0 all bytes left are equally likely. Byte FF, which UTF-8 never has, opens and closes every text.

Contexts of up to two bytes are resolved once into tables of at most 2**24 numbers each, held in memory. Longer ones grow
with the corpus and stay distributed. Texts are written in chunks of about ``CHUNK`` bytes. Each chunk counts its distinct
grams (context and byte; with count 0 those only of held-out texts) and deals them to buckets by the last three bytes of
the context, so all orders above two of a gram meet in one bucket, which resolves it and sends the logarithm back to the
chunks that asked. A chunk's texts are then scored with its own grams alone.

For the baseline, words so frequent that few can be (at most ``heavy`` by count over total) are looked up in each task;
the rest of each document's words are joined with the counts, so the vocabulary may be of any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, scratch_path, ship, slices, table

END = b" "  # the end of a text as a token; no word has a space
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER)


def grams(raws: list[bytes], order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All (context, byte) grams of the documents as numbers of order + 1 bytes, and where each document's begin."""
    pad = b"\xff" * order
    joined = np.frombuffer(pad + pad.join(raws) + pad, np.uint8)
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    n = len(joined) - order
    found = np.zeros(n, np.int64)
    for k in range(order + 1):
        found <<= 8
        found |= joined[k : k + n]
    used = np.ones(n, bool)
    ends = np.cumsum(lengths + order) - order
    for k in range(1, order):
        used[(ends + k)[ends + k < n]] = False  # only the first FF after a document is predicted
    return found[used], np.cumsum(lengths + 1) - (lengths + 1)


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([f[1] for f in found]), len(keys)).astype(np.int64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_numbers(data: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


CHUNK = 32 << 20
CHUNKS = "chunk long, row long, doc_id long, held_out boolean, raw binary"


def chunk_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Lowered texts as bytes, numbered, with the chunk each is in: runs of about ``size`` bytes."""
    task, nth, held = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        raws = [_lowered(t) for t in batch.column(2).to_pylist()]
        chunks = []
        for raw in raws:
            chunks.append(task << 24 | held // size)
            held += len(raw) + 1
        row = pa.array(np.arange(nth, nth + len(raws)) + (task << 40))
        nth += len(raws)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), row, batch.column(0), batch.column(1), pa.array(raws, pa.binary())], ["chunk", "row", "doc_id", "held_out", "raw"])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's runs of rows of one chunk."""
    chunk = batch.column(0).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else []
    for a, b in zip(starts, [*starts[1:], len(chunk)], strict=True):
        yield int(chunk[a]), batch.slice(a, b - a)


COUNTS = "token binary, gram int, n long, chunk long, bucket int, grams binary, counts binary"


def count_rows(batches: Iterator[pa.RecordBatch], order: int, buckets: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Counts of this task's words and byte triples, and each chunk's grams and counts by bucket."""
    schema = pa.schema([("token", pa.binary()), ("gram", pa.int32()), ("n", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
    words: Counter = Counter()
    triples: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    own = None

    def out(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def words_out():
        rows = out(len(words), token=list(words), n=list(words.values()))
        words.clear()
        return rows

    def chunk_out():
        keys, n = _merge(found)
        found.clear()
        seen = n > 0
        triples.append(_merge([(keys[seen] & 0xFFFFFF, n[seen])]))
        triples[:] = [_merge(triples)]
        bucket = bucket_of(keys, buckets)
        turn = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[turn], n[turn], bucket[turn]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        parts = list(zip(at, [*at[1:], len(keys)], strict=True))
        return out(len(parts), chunk=[own] * len(parts), bucket=bucket[at], grams=[pack_numbers(np.diff(keys[a:b], prepend=0)) for a, b in parts], counts=[pack_numbers(n[a:b]) for a, b in parts])

    for batch in batches:
        for chunk, part in _chunks(batch):
            if chunk != own and found:
                yield chunk_out()
            own = chunk
            held = part.column(1).to_pylist()
            raws = part.column(2).to_pylist()
            train, rest = [r for r, h in zip(raws, held, strict=True) if not h], [r for r, h in zip(raws, held, strict=True) if h]
            for raw in train:
                words.update(raw.split())
                words[END] += 1
                if len(words) > most:
                    yield words_out()
            for which, learned in ((train, 1), (rest, 0)):
                for a, b in slices(which):
                    got = pa.array(grams(which[a:b], order)[0]).value_counts()
                    found.append((got.field(0).to_numpy(), got.field(1).to_numpy() * learned))
                    if sum(len(f[0]) for f in found) > 1 << 21:
                        found[:] = [_merge(found)]
    if found:
        yield chunk_out()
    if words:
        yield words_out()
    if triples:
        keys, n = triples[0]
        yield out(len(keys), gram=keys.astype(np.int32), n=n)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the last three bytes of the context."""
    x = (keys >> 8 & 0xFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


class Ppm:
    """Resolved log10 probabilities; ``row`` gives a context's row."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        contexts = np.unique(keys >> 8)
        two = np.zeros((len(contexts), 256))
        two[np.searchsorted(contexts, keys >> 8), keys & 255] = n
        one = np.zeros((256, 256))
        np.add.at(one, contexts & 255, two)
        zero = one.sum(0)
        last = np.full(256, 1.0 / max(1, 256 - np.count_nonzero(zero)))
        shortest = self._level(zero[None], np.zeros((1, 256), bool), last[None])
        # after a context of one byte: order 0 without what followed that byte
        rest = self._level(np.broadcast_to(zero, one.shape), one > 0, np.broadcast_to(last, one.shape))
        shorter = self._level(one, np.zeros(one.shape, bool), rest)
        b = contexts & 255
        longest = self._level(two, np.zeros(two.shape, bool), self._level(one[b], two > 0, rest[b])) if len(contexts) else two
        seen = one.sum(1) > 0
        self.table = np.log10(np.concatenate([longest, shorter, shortest]))
        self.two = two
        # after two bytes of which nothing fits: order 1 without what followed them
        self.below = np.log10(self._level(one[b], two > 0, rest[b])) if len(contexts) else two
        seen = one.sum(1) > 0
        self.table = np.log10(np.concatenate([longest, shorter, shortest]))
        single = np.where(seen, len(contexts) + np.arange(256), len(contexts) + 256)
        self.row = np.tile(single, 256)
        self.row[contexts] = np.arange(len(contexts))

    @staticmethod
    def _level(counts: np.ndarray, without: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities at one order: counts but for the excluded, else an escape times ``lower``."""
        left = np.where(without, 0, counts)
        n, d = left.sum(1, keepdims=True), np.count_nonzero(left, 1).reshape(-1, 1)
        # nothing left to see: straight on; all 256 seen: no escape
        escape = np.where(n == 0, 1.0, np.where(np.count_nonzero(counts, 1).reshape(-1, 1) == 256, 0.0, d / np.maximum(1, n + d)))
        seen = (1 - escape) * left / np.maximum(1, n)
        return np.where(left > 0, seen, np.maximum(escape * lower, 1e-300))

    def resolve(self, keys: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
        """log10 probabilities of sorted distinct grams, whose contexts' other followers are among them."""
        logs, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
        gone_n, gone_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded by the longer context
        row, last = self.row[keys >> 8 & 0xFFFF], keys & 255

        def step(n, all_n, all_d):
            left_n, left_d = all_n - gone_n, all_d - gone_d
            hit, miss = ~done & (n > 0), ~done & (n == 0) & (left_d > 0)
            logs[hit] += np.log10(n[hit] / np.where(all_d == 256, left_n, left_n + left_d)[hit])
            logs[miss] += np.log10(left_d[miss] / (left_n + left_d)[miss])
            return done | hit

        longer = None
        for k in range(order, 2, -1):
            short, at = np.unique(keys & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            n = np.bincount(at, counts, len(short)).astype(np.int64)
            context = np.unique(short >> 8, return_inverse=True)[1]
            all_n, all_d = np.bincount(context, n).astype(np.int64)[context], np.bincount(context, n > 0).astype(np.int64)[context]
            n, all_n, all_d = n[at], all_n[at], all_d[at]
            if longer is not None:
                gone_n = self._gone(*longer, n)
                gone_d = longer[3]
            done = step(n, all_n, all_d)
            longer = keys, k, n, all_d
        none = np.ones(len(keys), bool) if longer is None else longer[3] == 0
        logs[none & ~done] += self.table[row[none & ~done], last[none & ~done]]
        if longer is not None and not none.all():
            # a context of three bytes that was seen holds one of two that was
            full = np.where(none, 0, row)
            n = np.where(none, 0, self.two[full, last]).astype(np.int64)
            gone_n, gone_d = self._gone(*longer, n), longer[3]
            done = done | none
            done = step(n, self.two.sum(1)[full].astype(np.int64), np.count_nonzero(self.two, 1)[full])
            logs[~done] += self.below[row[~done], last[~done]]
        return logs

    @staticmethod
    def _gone(keys, k: int, n, all_d, shorter) -> np.ndarray:
        """For each gram how often, after the context of k - 1 bytes, came what followed its context of k bytes."""
        short, first, at = np.unique(keys & (1 << 8 * (k + 1)) - 1, return_index=True, return_inverse=True)
        context = np.unique(short >> 8, return_inverse=True)[1]
        return np.bincount(context, np.where(n[first] > 0, shorter[first], 0)).astype(np.int64)[context][at]


RESOLVED = "chunk long, grams binary, codes binary, logs binary"


def resolve_rows(batches: Iterator[pa.RecordBatch], model, order: int) -> Iterator[pa.RecordBatch]:
    """Buckets, which come sorted: (bucket, chunk, grams, counts); each chunk's grams with their logarithms."""
    ppm, bucket, held = None, None, []

    def out():
        wanted = [np.cumsum(unpack_numbers(g)) for _, g, _ in held]
        keys, n = _merge([(w, unpack_numbers(c)) for w, (_, _, c) in zip(wanted, held, strict=True)])
        logs, code = np.unique(ppm.resolve(keys, n, order), return_inverse=True)
        for w, (chunk, g, _) in zip(wanted, held, strict=True):
            own, codes = np.unique(code[np.searchsorted(keys, w)], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([g], pa.binary()), pa.array([pack_numbers(codes.astype(np.int64))], pa.binary()), pa.array([pack_numbers(logs[own])], pa.binary())], ["chunk", "grams", "codes", "logs"])

    for batch in batches:
        ppm = ppm or Ppm(*model.value)
        for at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != bucket and held:
                yield from out()
                held = []
            bucket = at
            held.append(rest)
    if held:
        yield from out()


class Lookup:
    """One chunk's grams and their logarithms, from the shared folder."""

    def __init__(self, path: str, chunk: int):
        fs, at = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)
        keys, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
        for info in fs.get_file_info(pafs.FileSelector(f"{at}/chunk={chunk}")):
            if info.base_name.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(64, columns=["grams", "codes", "logs"]):
                        for g, c, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                            keys.append(np.cumsum(unpack_numbers(g)))
                            logs.append(unpack_numbers(x, np.float64)[unpack_numbers(c)])
        self.keys, self.logs = pa.array(np.concatenate(keys)), np.concatenate(logs)

    def scores(self, raws: list[bytes], order: int) -> list[float]:
        """log10 probability of each document and its end."""
        out: list[float] = []
        for a, b in slices(raws, 4 << 20):
            found, starts = grams(raws[a:b], order)
            at = pc.index_in(pa.array(found), value_set=self.keys)
            if at.null_count:
                raise RuntimeError("a chunk lacks grams of its own texts")
            out += np.add.reduceat(self.logs[at.to_numpy()], starts).tolist()
        return out


ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<binary>, times array<int>"


def score_rows(batches: Iterator[pa.RecordBatch], heavy, path: str, order: int) -> Iterator[pa.RecordBatch]:
    """Scores, and of the baseline what frequent words give; the rare words for the join."""
    logs, own, lookup = heavy.value, None, None
    names = [x.split()[0] for x in ROWS.split(", ")]
    for chunk, part in (x for batch in batches for x in _chunks(batch)):
        if chunk != own:
            lookup = None
            own, lookup = chunk, Lookup(path, chunk)
        raws = part.column(4).to_pylist()
        scores = lookup.scores(raws, order)
        for a, b in slices(raws):
            rows = []
            for raw in raws[a:b]:
                words = raw.split()
                rare, times, total, known = [], [], logs.get(END, 0.0), int(END in logs)
                for w, n in Counter(words).items():
                    if (x := logs.get(w)) is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        total += n * x
                        known += n
                if END not in logs:
                    rare.append(END)
                    times.append(1)
                rows.append((len(words) + 1, known, total, rare, times))
            n_tokens, known, total, rare, times = (list(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(part.column(k)[a:b] for k in (1, 2, 3)), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.float64()), pa.array(scores[a:b], pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], names)


def score_corpus(docs: DataFrame, modulus: int = 7, held: int = 2, heavy: int = 100_000, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Contexts are ``order`` (2 to 6) bytes deep. Documents whose crc32(doc_id as text) modulo ``modulus`` is ``held`` are scored but not learned from. Null texts
    count as empty: they have the end token alone. Repeated rows are learned from and scored each; a null id counts as
    the empty text for the split; an empty table gives no rows; with nothing to learn from all words are unknown and all
    bytes equally likely.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    chunked = cut(rows.mapInArrow(lambda b: chunk_rows(b, CHUNK), CHUNKS), "lm-texts", compression="zstd")
    buckets = max(64, chunked.select("chunk").distinct().count())  # so a bucket's grams are about as many as a chunk's
    parts = cut(chunked.select("chunk", "held_out", "raw").mapInArrow(lambda b: count_rows(b, order, buckets), COUNTS), "lm-counts", compression="zstd")
    counts = cut(parts.filter("token is not null").groupBy("token").agg(F.sum("n").alias("c")), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # of words with more than total / heavy occurrences there are fewer than ``heavy``
    frequent = counts.filter(F.col("c") > total / heavy).collect()
    heavy_logs = spark.sparkContext.broadcast({bytes(r.token): math.log10(r.c + 1) for r in frequent})
    got = parts.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 2**24 rows
    turn = np.argsort(keys := got.column("gram").to_numpy())
    model = spark.sparkContext.broadcast((keys[turn].astype(np.int64), got.column("n").to_numpy()[turn]))
    asked = parts.filter("grams is not null").select("bucket", "chunk", "grams", "counts").repartition("bucket").sortWithinPartitions("bucket")
    path = scratch_path(spark, "lm-grams")
    asked.mapInArrow(lambda b: resolve_rows(b, model, order), RESOLVED).repartition("chunk").write.partitionBy("chunk").parquet(path)
    scored = cut(chunked.mapInArrow(lambda b: score_rows(b, heavy_logs, path, order), ROWS), "lm-scores", compression="zstd")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("token"), F.col("w.times").alias("n"))
    found = rare.join(counts.filter(F.col("c") <= total / heavy), "token").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        "score",
    )


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those outside the held-out seventh."""
    return score_corpus(table(spark, sf_dir, "documents"), order=5)
