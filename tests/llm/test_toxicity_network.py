"""The scoring path against the training path, the character input, and the network against its lexicon."""

import tracemalloc
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity as tox

D = "/root/testdata/sf0.1"


def small_net():
    lexicon = tox.Lexicon(["one two three four"] * 6 + ["five six"] * 6, np.array([0] * 6 + [1] * 6), 1)
    return tox.Network(lexicon)


def reference_score(net, text):
    """By ``forward`` in double precision, window by window."""
    tokens = text.split()
    best = -np.inf
    for start in tox.window_starts(len(tokens)):
        part = tokens[start : start + tox.WINDOW]
        x, mask = np.zeros((tox.WINDOW, 1, tox.WORD_DIM + tox.CHAR_DIM)), np.zeros((tox.WINDOW, 1))
        if part:
            x[: len(part), 0], mask[: len(part), 0] = net.vectors(part), 1
        best = max(best, float(net.forward(x, mask)[0]))
    return float(tox.sigmoid(np.asarray(best)))


def test_scores_equal_the_training_network():
    net, rng = small_net(), np.random.default_rng(3)
    for name in net.p:
        net.p[name] = net.p[name] + rng.normal(0, 0.2, net.p[name].shape)
    words = ["one", "two", "five", "six", "unknown", "Five!", "x", "日本", "é"]
    texts = ["", "one", *(" ".join(rng.choice(words, n)) for n in (3, 31, 32, 33, 56, 57, 200))]
    known = tox.Known(net, 3)  # turns over all the time
    got = tox.text_scores(net, known, texts) + tox.text_scores(net, known, texts[::-1], 2)
    want = [reference_score(net, t) for t in texts]
    assert np.allclose(got, want + want[::-1], atol=1e-4)


def test_character_ngrams():
    words = ["a", "ab", "abcdef", "", "日本語"]
    owner, rows = tox.char_grams(words)
    want = []
    for k, w in enumerate(words):
        marked = f"\n{w}\n"
        want += [(k, marked[i : i + n]) for n in tox.GRAMS for i in range(len(marked) - n + 1)]
    assert sorted(owner.tolist()) == [k for k, _ in want] and owner.tolist() == sorted(owner.tolist())
    assert len({r for r in rows.tolist()}) == len({g for _, g in want})
    alone = [tox.char_grams([w])[1].tolist() for w in words]
    assert [rows[owner == k].tolist() for k in range(len(words))] == alone
    assert tox.char_grams([])[0].size == 0


def test_training_holds_ngrams_part_by_part():
    rng = np.random.default_rng(3)
    texts = ["", *(" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(100)) for _ in range(400))]
    net = tox.Network(tox.Lexicon(["so bad", "so good"] * 3, np.asarray([1, 0] * 3)))
    tracemalloc.start()
    data = tox.Training(net, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data.ids) > 3 * tox.SOME and peak < 40 * len(data.rows)  # over 100 bytes an n-gram if all are listed at once
    owner, rows = data.grams(np.arange(len(data.ids)))
    some = [0, 1, tox.SOME, tox.SOME + 1, tox.SOME + 2, len(data.ids) - 1]
    place = {t: k + 1 for k, t in enumerate(dict.fromkeys(t for text in texts for t in text.split()))}
    words = ["", *place]
    assert [rows[owner == k].tolist() for k in some] == [tox.char_grams([words[k]])[1].tolist() if k else [] for k in some]
    want = net.p["word"][data.ids, 0] + np.bincount(owner, net.p["char"][rows, 0], len(data.ids))
    assert (data.signs(net) == want).all()


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a")] + [(1, "a")] * 50 + [(2, "x")] * 40 + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 0)], "doc_id long, toxic int")
    got = [tuple(r) for r in tox.training_rows(docs, labels, 4, 9, 10, 100)]
    assert got == [(1, "a", 1), (2, "x", 0), (5, "", 0)]
    assert len(tox.training_rows(docs, labels, 4, 9, 1, 100)) <= 3


@pytest.mark.parametrize("labels", [[], [0], [1]])
def test_few_or_single_labels(labels):
    net = tox.train(["some text"] * len(labels), np.asarray(labels, int), epochs=1, least_steps=2)
    assert all(0 <= s <= 1 for s in tox.text_scores(net, tox.Known(net), ["", "some text", "x " * 100]))


def test_the_network_beats_its_lexicon(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.training_rows(docs, labels, 4, 2, 1500, 20_000)
    texts, ys = [r.text for r in rows], np.asarray([r.toxic for r in rows])
    net, lexicon = tox.train(texts, ys), tox.Lexicon(texts, ys)
    held = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    truth = np.asarray([y for _, y in held])
    known = tox.Known(net)
    scores = np.asarray([s for k in range(0, len(held), 200) for s in tox.text_scores(net, known, [t for t, _ in held[k : k + 200]])])
    words = np.asarray([max([lexicon.word_start[lexicon.words.get(tox.word_of(w), 0)] for w in t.split()] or [0.0]) for t, _ in held])
    best = max(((words >= c) == truth).sum() for c in np.unique(words))  # its best threshold in hindsight
    right = ((scores >= 0.3) == truth).sum()
    found, clean = (scores[truth == 1] >= 0.3).mean(), (scores[truth == 0] < 0.3).mean()
    print(f"network {right}, lexicon {best} of {len(held)}; found {found:.3f}, clean {clean:.3f}")
    assert right > best and found > 0.85 and clean > 0.97
