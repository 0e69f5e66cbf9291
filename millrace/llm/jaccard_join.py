"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document is the set of its runs of five words. Documents with equal sets form a class, and from there on only one
representative of each takes part. There are ``TREES`` prefix tries over labels of ``DEPTH`` MinHash values. Members of a
trie that share its first ``floor`` values are one subtrie and meet in one place, sorted by label. There they are matched
at full depth first, then at prefixes one value shorter each time; members that are connected already aren't matched
again. A subtrie is done once all its members are connected, or once its recall reaches the target: each pair found, of
similarity s, stands for 1 / p pairs that are there, where p = 1 - (1 - s**depth) ** TREES is how likely it was found;
besides, one pair at the threshold is taken to have been missed. ``floor`` is the depth at which even pairs at the
threshold are found with the target recall, so no subtrie need go below it. Where many members share a floor prefix, they
are dealt into blocks and met block by block.

Two members match if their whole signatures agree in all but 5.5 standard deviations of what the threshold makes expect;
matches join documents to clusters. Two documents over the threshold are in the same cluster, so each cluster's sets are
met in blocks, bounded by number and by bytes, and every pair in them is verified exactly. Pairs never become rows: what
comes out of a block is each document's number of links and a spanning forest of them, whose components are the groups of
near duplicates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, ship, slices, table, texts
from .components import components, may_have, spread_join

RUN = 5
TREES, DEPTH = 30, 6
VALUES = TREES * DEPTH
BUCKET, BLOCK, BLOCK_BYTES = 2000, 256, 8 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MULTIPLY = _rng.integers(1, 1 << 31, VALUES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, VALUES, np.uint32)
_MARK = _rng.integers(1, 1 << 63, 1 << 12, np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BREAK = re.compile(rb"[\t-\r ]")
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def found_share(similarity, depth: int):
    """How likely a pair is found by prefixes of ``depth`` values."""
    return 1 - (1 - similarity**depth) ** TREES


def floor_depth(threshold: float, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with the target recall."""
    depth = DEPTH
    while depth > 1 and found_share(threshold, depth) < recall:
        depth -= 1
    return depth


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 1 << 22:  # only a word of megabytes takes more; that isn't kept
        _powers[:] = made
    return made


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def segments(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` cut at white space into parts of about ``size`` bytes."""
    at = 0
    while len(raw) - at > size and (gap := _BREAK.search(raw, at + size)):
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw


def _word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the parts' words one after another, and how many each part has."""
    joined = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    power, inverse = _power(len(joined))
    space = _SPACE[joined]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * power[: len(joined)], dtype=np.uint64)])
    words = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([1, *(len(r) + 1 for r in parts)])
    return words, np.diff(np.searchsorted(starts, begins))


def shingles(raws: list[bytes], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all documents one after another, and where each document's begin (one more at
    the end). Words are what ASCII white space separates; with fewer than ``run`` words all of them make one shingle."""
    parts, owner = [], []
    for k, raw in enumerate(raws):
        for part in segments(raw):
            parts.append(part)
            owner.append(k)
    hashed = [_word_hashes(parts[a:b]) for a, b in slices(parts, 1 << 20)]
    words = np.concatenate([np.zeros(0, np.uint64), *(h[0] for h in hashed)])
    per_part = np.concatenate([np.zeros(0, np.int64), *(h[1] for h in hashed)])
    counts = np.bincount(np.asarray(owner, int), per_part, len(raws)).astype(np.int64)
    owner = np.repeat(np.arange(len(raws)), counts)
    full = max(0, len(words) - run + 1)
    runs = np.zeros(full, np.uint64)
    for k in range(run):
        runs *= np.uint64(0x2545F4914F6CDD1D)
        runs += words[k : k + full]
    runs = _mixed(runs[owner[:full] == owner[run - 1 : run - 1 + full]])
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < run))
    short = np.zeros(len(few), np.uint64)
    for k in range(run - 1):
        there = counts[few] > k
        short[there] = short[there] * np.uint64(0xD6E8FEB86659FD93) + words[first[few[there]] + k]
    at = np.concatenate([[0], np.cumsum(np.where(counts >= run, counts - run + 1, counts > 0))])
    value, whole = np.empty(at[-1], np.uint64), np.ones(at[-1], bool)
    whole[at[few]] = False
    value[whole] = runs
    value[at[few]] = _mixed(short + counts[few].astype(np.uint64))
    fresh = np.ones(len(value), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        value[a:b].sort()
    fresh[1:] = value[1:] != value[:-1]
    fresh[at[:-1][at[:-1] < len(value)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return value[fresh], kept[at]


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (documents, VALUES); 0 for documents without shingles."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, VALUES), np.uint32)
    if len(full):
        own, hashed = (value >> np.uint64(32)).astype(np.uint32), np.empty(len(value), np.uint32)
        for k in range(VALUES):
            np.multiply(own, _MULTIPLY[k], hashed)
            hashed += _ADD[k]
            out[full, k] = np.minimum.reduceat(hashed, at[full])
    return out


SETS = "row long, doc_id long, digest binary, size long, labels array<long>, signature binary, text string"


def set_rows(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """Documents with their sets' digests, each trie's label prefix of ``floor`` values (as a 64-bit number) and
    signatures of a byte a value."""
    row = TaskContext.get().partitionId() << 40
    held(None, dict)
    names = [x.split()[0] for x in SETS.split(", ")]
    for batch in batches:
        raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for a, b in slices(raws, 1 << 20):
            value, at = shingles(raws[a:b])
            n, sizes = b - a, np.diff(at)
            signature = signatures(value, at)
            digest = [hashlib.blake2b(value[at[k] : at[k + 1]].tobytes(), digest_size=16).digest() for k in range(n)]
            parts = signature.reshape(n, TREES, DEPTH)[:, :, :floor].astype(np.uint64)
            label = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (n, TREES))
            for k in range(floor):
                label = _mixed(label * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, k])
            labels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TREES), pa.array(label.astype(np.int64).ravel()))
            bytes_ = (signature >> np.uint32(7)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0)[a:b], pa.array(digest, pa.binary()), pa.array(sizes.astype(np.int64)), labels, pa.array([s.tobytes() for s in bytes_], pa.binary()), batch.column(1)[a:b]], names)
            row += n


def _roots(near: np.ndarray) -> np.ndarray:
    """Components of a symmetric adjacency matrix: the least index each one reaches."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label, len(near)).min(1, initial=len(near))
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of each the least member of its component) with the components of a[k] and b[k] united."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return root


EDGES = "a long, b long"


def _searched(signature: np.ndarray, root: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(member, members that agree with it, how much), enough of them to connect all that can be: a breadth-first search
    over whole components, in which each member is compared with those not reached yet."""
    rest, queue = np.arange(len(root)), []
    while len(rest):
        if not queue:
            own = root[rest] == root[rest[0]]
            queue, rest = rest[own].tolist(), rest[~own]
            continue
        i = queue.pop()
        agree = (signature[rest] == signature[i]).sum(1)
        if (ok := agree >= least).any():
            yield i, rest[ok], agree[ok]
            reached = np.isin(root[rest], root[rest[ok]])
            queue += rest[reached].tolist()
            rest = rest[~reached]


def match(bucket: np.ndarray, tree: np.ndarray, signature: np.ndarray, least: int, threshold: float, recall: float, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of members sorted by subtrie (``bucket``) and label: the least member each is connected with, and the depth at
    which its subtrie was done."""
    n = len(bucket)
    label = signature[np.arange(n)[:, None], tree[:, None] * DEPTH + np.arange(DEPTH)]
    shared = np.cumprod(label[1:] == label[:-1], 1).sum(1)
    # bytes may be equal where values aren't; that only matches a pair sooner
    common = np.concatenate([[-1], np.where(bucket[1:] != bucket[:-1], -1, np.maximum(floor, shared))])
    nth = np.cumsum(common < 0) - 1
    root, node, depths = np.arange(n), None, np.full(nth[-1] + 1, floor)
    active = np.bincount(nth) > 1
    seen_at, seen = [np.zeros(0, int)], [np.zeros(0)]
    for depth in range(DEPTH, floor - 1, -1):
        starts = np.flatnonzero(common < depth)
        sizes = np.diff(np.append(starts, n))
        sizes[~active[nth[starts]]] = 1
        left, right, agreement = [], [], []
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            if size > 12:
                for k in at:
                    own = slice(k, k + size)
                    for i, others, agree in _searched(signature[own], root[own], least):
                        left.append(np.full(len(others), k + i))
                        right.append(k + others)
                        agreement.append(agree)
                continue
            i, j = np.triu_indices(size, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            new = root[a] != root[b]
            if node is not None:  # those of one longer prefix have met
                new &= node[a] != node[b]
            a, b = a[new], b[new]
            for k in range(0, len(a), 50_000):
                some = slice(k, k + 50_000)
                agree = (signature[a[some]] == signature[b[some]]).sum(1)
                ok = agree >= least
                left.append(a[some][ok])
                right.append(b[some][ok])
                agreement.append(agree[ok])
        if left:
            a = np.concatenate(left)
            root = _united(root, a, np.concatenate(right))
            seen_at.append(nth[a])
            seen.append(np.maximum(threshold, np.concatenate(agreement) / VALUES))
        node = np.cumsum(common < depth)
        if depth > floor:
            of, share = np.concatenate(seen_at), found_share(np.concatenate(seen), depth)
            missed = np.bincount(of, (1 - share) / share, len(active)) + 1 - found_share(threshold, depth)
            there = np.bincount(of, 1 / share, len(active)) + 1
            done = active & ((np.bincount(nth[root == np.arange(n)], minlength=len(active)) == 1) | (missed <= (1 - recall) * there))
            depths[done] = depth
            active &= ~done
    return root, depths[nth]


def candidate_rows(batches: Iterator[pa.RecordBatch], least: int, threshold: float, recall: float, floor: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the matches in each subtrie's meeting: (meeting, tree, row, signature), which come sorted by
    meeting and label."""
    rest = None

    def out(bucket, tree, rows, signature):
        root, _ = match(bucket, tree, signature, least, threshold, recall, floor)
        k = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(rows[k]), pa.array(rows[root[k]])], ["a", "b"])

    for batch in batches:
        own = [batch.column(k).to_numpy() for k in range(3)]
        own.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, VALUES))
        if rest is not None:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        if not len(own[0]):
            continue
        last = np.flatnonzero(own[0] != own[0][-1])  # the last meeting may go on in the next batch
        last = int(last[-1]) + 1 if len(last) else 0
        if last:
            yield out(*(x[:last] for x in own))
        rest = [x[last:].copy() for x in own]
    if rest is not None:
        yield out(*rest)


def _met(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``rows`` with a ``meeting`` under which all rows of a key meet: itself if they are one of ``blocks``, else one for
    each two of its blocks (and ``side``: in which of the two a row is)."""
    blocks, many = F.greatest(F.col("blocks"), F.lit(1)).cast("int"), F.col("blocks") > 1
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    # one pass: a second one over ``rows`` would make them, and plan them, again
    met = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    meeting = F.when(many, F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col(key))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.select(meeting.alias("meeting"), side.alias("side"), *columns)


SHINGLED = "cluster long, blocks long, row long, copies long, shingles binary"


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(4).to_pylist()]
        for a, b in slices(raws):
            value, at = shingles(raws[a:b])
            sets = [value[at[k] : at[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:4]), pa.array(sets, pa.binary())], ["cluster", "blocks", "row", "copies", "shingles"])


VERIFIED = "row long, links long, root long"


def intersections(sets: list[bytes]) -> np.ndarray:
    """How many shingles each two of the sets (of 64-bit numbers) share; the diagonal is without those only one has."""
    n = len(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) // 8 for s in sets])
    values = np.frombuffer(b"".join(sets), np.uint64)
    order = np.argsort(values)
    values = values[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    times = np.diff(np.append(starts, len(values)))
    del values
    owner = owner[order]
    del order
    starts, times = starts[times > 1], times[times > 1]  # what one document alone has is in no intersection
    both = np.zeros((n, n), np.float32)
    if not len(starts):
        return both
    mark = _MARK[owner % len(_MARK)] * (owner // len(_MARK) + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mark, dtype=np.uint64)])
    # shingles that the same documents have count together
    _, first, weight = np.unique(sums[starts + times] - sums[starts], return_index=True, return_counts=True)
    starts, times = starts[first], times[first]
    pairs = np.zeros(n * n)
    few = max(2, n // 8)
    for size in np.unique(times[times <= few]):
        i, j = np.triu_indices(size, 1)
        which = np.flatnonzero(times == size)
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(which), step):
            some = which[k : k + step]
            members = np.sort(owner[starts[some][:, None] + np.arange(size)], 1).astype(np.int64)
            code = members[:, i] * n + members[:, j]
            pairs += np.bincount(code.ravel(), np.repeat(weight[some], len(i)), n * n)
    both += pairs.reshape(n, n)
    both += both.T.copy()
    del pairs
    which = np.flatnonzero(times > few)
    step = max(256, (4 << 20) // n)
    for k in range(0, len(which), step):
        some = which[k : k + step]
        there = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), times[some])
        inside = np.arange(len(column)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
        there[owner[starts[some][column] + inside], column] = 1
        both += (there * weight[some].astype(np.float32)) @ there.T
    return both


def _verified(rows, copies, side, sets, threshold: float) -> pa.RecordBatch:
    """Of the documents of one meeting: how many others (copies count) each is linked with, and the least it reaches."""
    sizes = np.asarray([len(s) // 8 for s in sets])
    both = intersections(sets)
    union = sizes[:, None] + sizes[None, :] - both
    near = both >= threshold * union - 1e-6
    np.fill_diagonal(near, False)
    side = np.asarray(side)
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 0)  # two blocks: only across; each within itself elsewhere
    links = near @ np.asarray(copies)
    root = _roots(near)
    k = np.flatnonzero(links)
    rows = np.asarray(rows)
    return pa.RecordBatch.from_arrays([pa.array(rows[k]), pa.array(links[k].astype(np.int64)), pa.array(rows[root[k]])], ["row", "links", "root"])


def verified_rows(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Meetings, which come sorted: (meeting, side, row, copies, shingles)."""
    meeting, held = None, []
    for batch in batches:
        for at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != meeting and held:
                side, rows, copies, sets = zip(*held, strict=True)
                yield _verified(rows, copies, side, sets, threshold)
                held = []
            meeting = at
            held.append(rest)
    if held:
        side, rows, copies, sets = zip(*held, strict=True)
        yield _verified(rows, copies, side, sets, threshold)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999999, judged: bool = False) -> DataFrame:
    """doc_id, class_id, n_links and copies of every document.

    ``n_links``: how many other documents have a Jaccard similarity of word 5-grams of ``threshold`` or more with it.
    ``class_id``: the least doc_id that links lead to (its own if there are none). ``copies``: documents with the same set.
    Null texts count as empty, and documents without words as copies of one another; with one to four words all of them
    are one n-gram. Repeated rows are copies like others; null ids are never a class_id while another id is there. An
    empty table gives no rows; other columns are ignored.

    ``judged`` adds text_sha256 and kept: of a group's rows the one with the least doc_id (null last), of equal ids the one
    with the least text_sha256, is kept. Rows that repeat both are judged alike.
    """
    spark = docs.sparkSession
    ship(spark)
    sha = F.sha2("text", 256)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", sha.alias("sha"))
    best = [F.min(rank).alias("best")] if judged else []
    floor = floor_depth(threshold, recall)
    least = int(VALUES * threshold - 5.5 * (VALUES * threshold * (1 - threshold)) ** 0.5)
    sets = cut(texts(docs).mapInArrow(lambda b: set_rows(b, floor), SETS), "shingle-sets")
    classes = cut(sets.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.min("doc_id").alias("first"), F.first("size").alias("size"), *best), "classes")
    # sides that grow with the corpus are never broadcast, however small they are here
    one = sets.select("row", "labels", "signature").join(classes.filter("size > 0").select("row").hint("merge"), "row")
    keys = one.select("row", F.posexplode("labels").alias("tree", "label"))
    subtries = keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = spread_join(keys, subtries, "label", TREES * classes.count()).join(one.select("row", "signature"), "row")
    met = _met(members.withColumn("blocks", F.ceil(F.col("n") / BUCKET)), "label", "tree", "row", "signature").drop("side")
    label = F.substring("signature", F.col("tree") * DEPTH + 1, F.lit(DEPTH))
    met = met.repartition("meeting").sortWithinPartitions("meeting", label).select("meeting", F.col("tree").cast("long").alias("tree"), "row", "signature")
    edges = met.mapInArrow(lambda b: candidate_rows(b, least, threshold, recall, floor), EDGES)
    clusters = components(edges).select(F.col("root").alias("cluster"), F.col("node").alias("row"))
    clusters = cut(clusters.join(classes.select("row", "copies", "size"), "row"), "clusters")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).alias("blocks")
    sized = spread_join(clusters, clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), blocks), "cluster", clusters.count())
    clustered = may_have(sets.select("row", "text"), clusters, "row").join(sized.hint("merge"), "row")
    shingled = clustered.select("cluster", "blocks", "row", "copies", "text").mapInArrow(shingle_rows, SHINGLED)
    met = _met(shingled, "cluster", "row", "copies", "shingles").select("meeting", "side", "row", "copies", "shingles")
    verified = cut(met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(lambda b: verified_rows(b, threshold), VERIFIED), "links")
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = cut(classes.join(groups.select(F.col("node").alias("row"), "root"), "row", "left").join(links, "row", "left").withColumn("root", F.coalesce("root", "row")), "groups")
    lowest = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("class_id"), *([F.min("best").alias("keep")] if judged else []))
    named = spread_join(named, lowest, "root", named.count()).select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", *(["keep"] if judged else []))
    if judged:
        rows = sets.select("doc_id", "digest", sha.alias("text_sha256")).join(named, "digest")
        return rows.select("doc_id", "class_id", "n_links", "copies", "text_sha256", (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_sha256") == F.col("keep.sha"))).alias("kept"))
    return sets.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "n_links", "copies")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' near duplicates."""
    return jaccard_join(table(spark, sf_dir, "documents"))
