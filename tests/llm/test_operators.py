"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and further columns with clashing
names, held against brute force."""

import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, exact_dedup, gif, jaccard_join, packing, ppm, toxicity, url_filter, warc
from millrace.llm.components import components

WORDS = "the of and to in it is was for on that with as be by at from this have or".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """(doc_id, text, extra columns that clash with the operators' own names)."""
    rng = random.Random(3)
    base = [text(rng, n) for n in (3, 4, 5, 6, 40, 80, 120, 200)]
    docs = [*base, base[4], base[4], base[5] + " end", base[6].replace("the", "that", 1), None, None, "", " \t\n", "a", "é" * 700, text(rng, 9000)]
    near = base[7].split()
    for k in range(30):
        w = list(near)
        w[6 * k] = f"x{k}"
        docs.append(" ".join(w))
    rows = [(k, t, "en", 1, "src", 7, None) for k, t in enumerate(docs)]
    return rows + [rows[5], rows[5], (None, base[4], "en", 1, "src", 7, None), (None, "alone with no id", "en", 1, "src", 7, None)]


SCHEMA = "doc_id long, text string, lang string, keep_id int, digest string, row long, part string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, bits=5, fan=2).collect()
    assert len(got) == len(corpus())
    by = {}
    for d, t, *_ in corpus():
        by.setdefault(t or "", []).append(d)
    for r in got:
        ids = by[next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in by})
    assert exact_dedup.exact_dedup(docs, "min").filter("doc_id = 4").first().keep_id == 4
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_merges_sorted_runs(spark, docs):
    plan = exact_dedup.merge_round(exact_dedup.merge_round(spark.range(9).selectExpr("cast(id as int) AS run", "cast(id as int) AS lead", "cast(cast(id as string) as binary) AS digest", "id AS check", "id AS keep_id", "id AS group_size"), 4, 2, "max"), 4, 4, "max")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window") >= 2 and text.count("Exchange hashpartitioning(run") == 2 and "Aggregate" not in text
    whole = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("REPARTITION_BY_COL") >= 2  # at 4 partitions too


def shingle_set(t):
    w = re.findall(r"[^ \t-\r]+", t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("bucket", "block"), [(2000, 512), (14, 7)])
def test_jaccard_join(docs, none, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    data = [(d, shingle_set(t)) for d, t, *_ in corpus()]
    near = [[i != j and (a == b or len(a & b) >= 0.8 * len(a | b)) for j, (_, b) in enumerate(data)] for i, (_, a) in enumerate(data)]
    least = list(range(len(data)))
    for _ in data:
        least = [min([least[i], *(least[j] for j in range(len(data)) if near[i][j])]) for i in range(len(data))]
    want = sorted(((d, min((data[j][0] for j in range(len(data)) if least[j] == least[i] and data[j][0] is not None), default=None), sum(near[i])) for i, (d, _) in enumerate(data)), key=repr)
    assert rows(jaccard_join.jaccard_join(docs).select("doc_id", "class_id", "n_links")) == want
    assert jaccard_join.jaccard_join(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


ODD = ["", " ", "a" * 500, "ab" * 400, "the" * 200 + "ing" * 50, "x<|endoftext|>Y<|startoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ. İstanbul", "e\u0301á \u0301x", "don't we'll 'sa 12 34.5², ½Ⅷ", "a\x1cb\x85c\u2003d\u200be", "日本語 한국어", "🙂🙂👨‍👩‍👧", "\x00\x01", "ﬁ ǅ ß ẞ a\u0323\u0308"]


def test_bpe_equals_library(spark, docs, none):
    rng = random.Random(2)
    odd = ODD + ["".join(rng.choice("abcdetinghrsou "[:k]) for _ in range(rng.randint(1, 200))) for k in (2, 3, 5, 8, 15) for _ in range(20)]
    lib = library()
    data = [(k, t) for k, t in enumerate([*odd, *(t for _, t, *_ in corpus())])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    encoded = bpe.bpe_encode(df, bpe.vocabulary())
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert all(ids[k] == lib.encode(t or "", add_special_tokens=False).ids for k, t in data)
    plain = {r.doc_id: r.text for r in bpe.bpe_decode(encoded, bpe.vocabulary()).collect()}
    assert all(plain[k] == lib.decode(ids[k], skip_special_tokens=False) for k, _ in data)
    digests = {r.doc_id: r for r in bpe.bpe_digests(df, bpe.vocabulary()).collect()}
    assert all(digests[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[k])).encode()).hexdigest() and digests[k].decoded_sha256 == hashlib.sha256(plain[k].encode()).hexdigest() and digests[k].n_tokens == len(ids[k]) for k, _ in data)
    assert bpe.bpe_digests(none, bpe.vocabulary()).count() == 0 and bpe.bpe_digests(docs, bpe.vocabulary()).count() == len(corpus())


def test_transducer_streams_in_constant_memory():
    b = bpe.Bpe.from_file(bpe.vocabulary())
    rng = random.Random(4)
    for alphabet in ("ab", "the", "abcdefghij"):
        piece = "".join(rng.choice(alphabet) for _ in range(3000))
        t, out, most = bpe.Transducer(b), [], 0
        for s in piece[:-1]:
            out += t.push(s)
            most = max(most, len(t.text))
        out += t.finish(piece[-1])
        assert out == library().encode(piece, add_special_tokens=False).ids and most <= 8 * b.lookahead


def test_every_piece_takes_the_transducer(monkeypatch):
    b, seen = bpe.Bpe.from_file(bpe.vocabulary()), []
    run = bpe.Transducer.run
    monkeypatch.setattr(bpe.Transducer, "run", lambda self, piece: seen.append(piece) or run(self, piece))
    for word in ("streaming", "a", "the" * 40):
        assert b.encode_piece(word) == library().encode(word, add_special_tokens=False).ids
    assert seen == ["streaming", "a", "the" * 40]
    text = "one two\x1cthree \u2003" * 30_000
    assert [w for block in bpe.word_blocks(text) for w in block] == bpe.split_words(text) and max(map(len, bpe.word_blocks(text))) <= 8192


def test_byte_level_decoder_waits_for_whole_characters():
    b = bpe.Bpe.from_file(bpe.vocabulary().replace("word_bpe_49k", "byte_bpe_50k"))
    d, ids = bpe.Decoder(b, byte_level=True), [i for p in ("naïve", "Ġ日本") for i in b.encode_piece("".join(b._bytes[x] for x in p.replace("Ġ", " ").encode()))]
    assert "".join([*(d.push([i]) for i in ids), d.finish()]) == "naïve 日本"


def check_packed(data, got, capacity):
    lib, want, sequences = library(), Counter(), {}
    for d, t in data:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences), sum(r.length for r in got)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, none, capacity):
    data = [(d, t) for d, t, *_ in corpus()]
    n, used = check_packed(data, packing.pack(docs, capacity=capacity).collect(), capacity)
    assert n <= math.ceil(1.1 * used / capacity) + 1
    assert packing.pack(none).count() == 0


def test_plan_uses_up_every_length():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        counts = np.bincount(np.clip(rng.lognormal(6, 1, n).astype(int), 1, 4096), minlength=4097)
        plan, used = packing.pack_counts(counts), np.zeros(4097, int)
        for pattern, times in plan:
            assert sum(a * m for a, m in pattern) <= 4096 and times > 0
            for a, m in pattern:
                used[a] += m * times
        assert (used == counts).all()
        assert sum(t for _, t in plan) <= math.ceil((counts * np.arange(4097)).sum() / 4096) * 1.02 + 1


LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, [("system", "s"), ("user", "u"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, [("user", "xy")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": "c", "source": "web"}, [("user", "p"), ("assistant", "c")]),
    ({"role": "user"}, [("user", "")]),
    ({"messages": [{"role": "system", "content": "KEEP"}, {"role": "user", "content": [{"type": "text", "text": "x"}, "y"]}, {"role": "assistant", "content": {"a": [1]}}, {"role": "user"}]}, [("system", "KEEP"), ("user", "xy"), ("assistant", '{"a": [1]}'), ("user", "")]),
    ({"strange": 1}, []),
    ([1, 2], []),
]


def test_chat_reports_what_no_turn_is_made_of(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "x"}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": 1}]}]}, ["messages[].content[].image_url.url", "messages[].tool_calls[].id"]),
        (2, {"prompt": "p", "completion": "c", "meta": {"a": 1}}, ["meta.a"]),
        (3, {"strange": []}, ["strange[]"]),
        (4, {"messages": [{"role": "user", "content": {"deep": [1]}}]}, []),
    ]
    data = [(k, 0, json.dumps(r)) for k, r, _ in records] + [(5, 0, "[" * 100_000), (6, 0, '{"a":' * 5000 + "1" + "}" * 5000), (7, 0, "no json"), (8, 0, None)]
    got = {r.conv_id: r for r in chat.canonical_turns(spark.createDataFrame(data, "conv_id long, turn long, record string")).collect()}
    assert all(got[k].unmapped == want for k, _, want in records)
    assert all(got[k].role is None and got[k].layout is None for k in (5, 6, 7, 8))
    folded = chat.format_chat(spark.createDataFrame(data, "conv_id long, turn long, record string"), chat.Digests)
    assert {r.conv_id: r.n_turns for r in folded.collect()} == {1: 2, 2: 2, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0}


def test_reader_takes_any_parts():
    rng = random.Random(8)
    turns = [(rng.choice(["user", "assistant", "a\nb\\", ""]), rng.choice(["", "x\n", chat.END + "\n" + chat.START, "<\\|im_end|>", "é" * 50])) for _ in range(60)]
    formatted = "".join(chat.format_turn(*t)[0] for t in turns)
    reader, got, at = chat.Reader(), [], 0
    while at < len(formatted):
        n = rng.randint(1, 30)
        got += reader.feed(formatted[at : at + n])
        at += n
    reader.finish()
    assert [g[:2] for g in got] == turns and all(chat.unescape(formatted[a:b]) == text for _, text, a, b in got)
    for bad in ("x" + formatted, formatted[:-3], chat.START + "user" + chat.END + "\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_chat_layouts(spark):
    df = spark.createDataFrame([(k, 0, json.dumps(r)) for k, (r, _) in enumerate(LAYOUTS)] + [(90, 0, "{no json"), (91, 0, None)], "conv_id long, turn long, record string")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    for k, (_, turns) in enumerate(LAYOUTS):
        assert chat.parse(got[k].formatted) == turns
        spans = "".join(chat.unescape(got[k].formatted[a:b]) for a, b in got[k].loss_spans)
        assert spans == "".join(t for r, t in turns if r == "assistant")
    assert got[90].n_turns == got[91].n_turns == 0
    keys = {r.conv_id: r.fingerprint for r in chat.canonical_turns(df).collect()}
    assert keys[3] == keys[4] and len({keys[k] for k in (0, 1, 2, 3, 5, 6, 7, 8)}) == 8


def test_chat_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\|im_end|> \\ <|"
    data = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", None), (2, None, "assistant", "x"), (2, 5, None, "né\n"), (None, 0, "role\nwith \\ end<|im_end|>", "t"), (3, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.format_chat(chat.as_records(df), chat.Digests).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in data if c == conv))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.format_turn(r, x)[0]) for *_, r, x in turns)
    assert chat.format_chat(chat.as_records(df.limit(0)), chat.Digests).count() == 0


def test_escape_is_reversible():
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("<|\\x\n") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_toxicity(spark, none):
    rng = random.Random(6)
    data, labels = [], []
    for k in range(500):
        words, toxic = text(rng, rng.randint(1, 90)).split(), int(k % 5 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zorch", "blarg"]) + rng.choice(["a", "en", "ist", "um"])
        data.append((k, " ".join(words), 1.0))
        labels.append((k, toxic, 0))
    data += [(1000, None, 1.0), (1001, "", 1.0), (None, "the blarghood of it", 1.0), (1002, " ".join(["the"] * 30_000 + ["zorchen"]), 1.0), (3, data[3][1], 1.0)]
    df = spark.createDataFrame(data, "doc_id long, text string, score double")
    got = toxicity.toxicity(df, spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0)], "doc_id long, toxic int, quality int")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == by[1001].predicted == 0 and by[1002].predicted == by[None].predicted == 1
    net = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    assert toxicity.without_toxic(df, net).columns == df.columns
    assert toxicity.score_toxicity(none, net).count() == 0


def test_toxicity_gradients():
    lexicon = toxicity.Lexicon(["one two three four"] * 6 + ["five six"] * 6, np.array([0] * 6 + [1] * 6), 1)
    net = toxicity.Network(lexicon)
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(5, 3, 8)), np.ones((5, 3))
    mask[3:, 1] = 0
    keep: dict = {}
    y = net.forward(x, mask, keep)
    g, inputs = net.backward(x, mask, keep, np.ones(3))
    for name in ("fx", "fh", "fb", "bh", "a", "v", "out"):
        k = tuple(n // 2 for n in net.p[name].shape)
        net.p[name][k] += 1e-6
        assert abs((net.forward(x, mask).sum() - y.sum()) / 1e-6 - g[name][k]) < 1e-4
        net.p[name][k] -= 1e-6
    x[2, 1, 3] += 1e-6
    assert abs((net.forward(x, mask).sum() - y.sum()) / 1e-6 - inputs[2, 1, 3]) < 1e-4


def test_gif_round_trip(docs, none):
    stored = gif.store_gif(docs)
    for r in gif.media_features(stored).collect():
        raw = next(((t or "").encode() for d, t, *_ in corpus() if d == r.doc_id and len((t or "").encode()) == r.n_bytes))
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        if r.doc_id is not None:
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert gif.media_features(gif.store_gif(none)).count() == 0
    frames = gif.gif_frames(stored.select("doc_id", "media").union(stored.limit(1).select("doc_id", F.lit(b"GIF89a!!").alias("media"))))
    assert frames.filter("error is not null").count() == 1 and frames.filter("frame = 0").count() == len(corpus())


#: Widely published files, of ten by ten pixels in four colours and of one transparent pixel.
TEN = "474946383961 0a000a00 910000 ffffff ff0000 0000ff 000000 21f90400000000 00 2c000000000a000a0000 02 16 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b"
DOT = "474946383961 01000100 800000 000000 ffffff 21f90401000000 00 2c00000000010001000002 0144 00 3b"


def test_foreign_gifs(spark):
    width, height, _, frames = gif.decode(bytes.fromhex(TEN))
    rows_ = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert (width, height, len(frames)) == (10, 10, 1)
    assert ["".join(map(str, r)) for r in frames[0].samples.tolist()] == rows_
    assert frames[0].palette[:3].tolist() == [[255, 255, 255], [255, 0, 0], [0, 0, 255]]
    dot = gif.decode(bytes.fromhex(DOT))
    assert dot[:2] == (1, 1) and next(gif.composed(1, 1, dot[3])).tolist() == [[[0, 0, 0, 0]]] and dot[3][0].transparent == 0
    huge = bytearray(bytes.fromhex(DOT))
    huge[6:10] = b"\xff" * 4
    media = [(1, 0, bytes.fromhex(TEN)), (2, 0, None), (3, 0, bytes.fromhex(TEN)[:40]), (4, 0, b""), (5, 0, bytes(huge))]
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in media], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in gif.media_features(df).collect()}
    assert got[1].error is None and got[1].payload_bytes == 100
    assert all(got[k].error and got[k].payload_bytes is None and got[k].feature is None for k in (2, 3, 4))
    frames = {r.doc_id: r for r in gif.gif_frames(df).collect()}
    assert frames[1].error is None and sum(frames[1].histogram) > 0 and frames[5].error and frames[3].error


def test_lzw_and_frames():
    rng = random.Random(7)
    for n in (0, 1, 255, 256, 512, 4000, 70_000):
        for data in (rng.randbytes(n), b"a" * n, bytes(rng.choice(b"abc ") for _ in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])

    def frame(samples, disposal, transparent=None, local=b""):
        head = b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0])
        codes = gif.lzw_encode(bytes(samples), 2)
        return head + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 2, 0, 0x81 if local else 0]) + local + b"\x02" + bytes([len(codes)]) + codes + b"\0"

    data = b"GIF89a\x02\0\x02\0\x81\0\0" + palette + frame([0, 0, 0, 0], 1) + frame([1, 3, 3, 1], 3, 3) + frame([2, 3, 3, 3], 2, 3) + frame([3, 3, 3, 0], 0, 3, bytes(range(12))) + b";"
    w, h, _, frames = gif.decode(data)
    shown = [c.copy() for c in gif.composed(w, h, frames)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown[0].reshape(4, 4).tolist() == [red] * 4
    assert shown[1].reshape(4, 4).tolist() == [green, red, red, green]
    assert shown[2].reshape(4, 4).tolist() == [blue, red, red, red]
    assert shown[3].reshape(4, 4).tolist() == [[0, 0, 0, 0]] * 3 + [[0, 1, 2, 255]]
    assert [f.delay_ms for f in frames] == [50] * 4
    for cut in range(0, len(data) - 1, 5):
        with pytest.raises(gif.BadGif):
            gif.decode(data[:cut])


def ppm_brute(data):
    low = lambda t: (t or "").encode().translate(ppm.LOWER)
    train = [low(t) for d, t in data if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t), b" "]
    c = Counter(w for t in train for w in tokens(t))
    orders = [{}, {}, {}]
    for t in train:
        b = b"\xff\xff" + t + b"\xff"
        for i in range(2, len(b)):
            for k in range(3):
                orders[k].setdefault(b[i - k : i], Counter())[b[i]] += 1

    def p(b, i):
        out, gone = 1.0, set()
        for k in (2, 1, 0):
            seen = orders[k].get(b[i - k : i])
            left = {s: n for s, n in (seen or {}).items() if s not in gone}
            if not left:
                continue
            n, d = sum(left.values()), len(left)
            if b[i] in left:
                return out * left[b[i]] / (n + d)
            out, gone = out * d / (n + d), gone | set(seen)
        return out / (256 - len(orders[0].get(b"", {})))

    N, V = sum(c.values()), len(c)
    for d, t in data:
        t = low(t)
        b = b"\xff\xff" + t + b"\xff"
        w = tokens(t)
        yield d, len(w), sum(c[x] > 0 for x in w), N, sum(math.log10((c[x] + 1) / (N + V + 1)) for x in w), sum(math.log10(p(b, i)) for i in range(2, len(b)))


@pytest.mark.parametrize("heavy", [100_000, 5])
def test_ppm(docs, none, heavy):
    data = [(d, t) for d, t, *_ in corpus()] + []
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = sorted(ppm_brute(data), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.score_corpus(docs, heavy=heavy).collect()), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert ppm.score_corpus(none).count() == 0


def test_ppm_probabilities_sum_to_one():
    keys, n = np.unique(ppm.grams([b"abracadabra", b"", b"the cat"])[0], return_counts=True)
    model = ppm.Ppm(keys.astype(np.int64), n)
    assert np.allclose((10**model.table).sum(1), 1)


def ppm_deep(data, order):
    low = lambda t: (t or "").encode().translate(ppm.LOWER)
    pad, model = b"\xff" * order, {}
    for d, t in data:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            b = pad + low(t) + b"\xff"
            for i in range(order, len(b)):
                for k in range(order + 1):
                    model.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def p(b, i):
        out, gone = 1.0, set()
        for k in range(order, -1, -1):
            seen = model.get(b[i - k : i], {})
            left = {s: n for s, n in seen.items() if s not in gone}
            if left:
                n, d = sum(left.values()), len(left)
                if b[i] in left:
                    return out * left[b[i]] / (n + d)
                out *= d / (n + d)
            gone |= set(seen)
        return out / (256 - len(model.get(b"", {})))

    for d, t in data:
        b = pad + low(t) + b"\xff"
        yield d, sum(math.log10(p(b, i)) for i in range(order, len(b)))


@pytest.mark.parametrize("order, chunk", [(3, 1 << 20), (5, 3000), (6, 1 << 20)])
def test_ppm_of_longer_contexts(docs, monkeypatch, order, chunk):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    want = sorted(ppm_deep([(d, t) for d, t, *_ in corpus()], order), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = sorted(((r.doc_id, r.score) for r in ppm.score_corpus(docs, order=order).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/ok", "allow"), ("com", "", "block"), ("a.b.com", "/x", "allow"), ("x.org", "/", "block"), ("x.org", "/", "allow"), ("", "/root", "block")]


def judge_brute(url):
    url = url or ""
    m = re.search(r"://([^/?#]*)([^?#]*)", url, re.S)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or (host.endswith("." + h) if h else host.endswith("."))) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_filter(spark):
    rng = random.Random(8)
    hosts = ["org", "Example.ORG", "www.example.org", "notexample.org", "com", "b.com", "a.b.com", "z.a.b.com", "x.org", "q.x.org", "", "com.", "..com", "net"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es', '/es/', '/es/ok/1', '/x', '/x/y', '/Es/', '/root'])}{rng.choice(['', '?q=/es/', '#f'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "://org/", "http://org?a://com/", "a\nb://org/\nx", "http://" + "l." * 400 + "example.org/es/" + "y" * 5000] + ["http://www.example.org/es/1"] * 200
    data = [(k, u, "h") for k, u in enumerate(urls)] + [(5, urls[5], "h"), (5, urls[5], "h"), (None, "http://org/", "h"), (None, None, "h")]
    pages, rules = spark.createDataFrame(data, "page_id long, url string, host string"), spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)
    want = sorted(((p, *judge_brute(u)) for p, u, _ in data), key=repr)
    assert rows(url_filter.judge_urls(pages, rules)) == want
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_warc_round_trip(spark):
    big = "x" * 1500
    data = [(1, "http://a/", "<p>"), (2, "http://b/", big), (3, "u", big), (4, None, None), (5, "u\r\nX: y", ""), (6, "u", "<p>"), (6, "u", "<p>"), (7, "u", big), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\n" * 200), (9, "u", "é" * 500), (10, "u", "é" * 500), (11, "u", "é" * 499)]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, payload string").repartition(3)
    want = []
    for page, _, html in data:
        raw = (html or "").encode()
        first = max(p for p, _, h in data if h == html and p is not None)
        revisit = len(raw) >= 1000 and page != first
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    for zipped, roll in ((True, 64 << 20), (False, 1000)):
        assert rows(warc.warc_round_trip(pages, zipped=zipped, roll=roll)) == sorted(want, key=repr)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    records = [warc.record_bytes({"WARC-Type": "response", "X": str(k), "WARC-Payload-Digest": warc.sha1_label(bytes([65 + k]) * 3000)}, bytes([65 + k]) * 3000, zipped) for k in range(6)]
    whole = b"".join(records)
    read = lambda data: list(warc.salvage(io.BytesIO(data).read))
    assert [r.headers["x"] for r in read(whole)] == list("012345")
    rng = random.Random(9)
    for _ in range(60):
        at = rng.randrange(len(whole) - 4)
        kind = rng.randrange(3)
        broken = whole[:at] + (bytes([whole[at] ^ 255]) + whole[at + 1 :] if kind == 0 else whole[at + 9 :] if kind == 1 else b"junk" * 9 + whole[at:])
        out = read(broken)
        assert out[0].start == 0 and out[-1].end == len(broken) and all(a.end == b.start for a, b in zip(out, out[1:], strict=False))
        good = [r for r in out if isinstance(r, warc.Record)]
        assert len(good) >= 4 and (len(good) == 6 or any(isinstance(r, warc.Gap) for r in out))
        assert all(r.block == r.block[:1] * 3000 for r in good)
        if zipped:  # a plain record's headers have no check sum
            assert len(good) < 6 or any(isinstance(r, warc.Gap) for r in out)
    assert read(b"") == [] and isinstance(read(b"nothing")[0], warc.Gap)
    if zipped:
        assert len(read(gzip.compress(b"not a record") + whole)) == 7


def test_patterns_carry_most_pieces():
    """Of the lengths of the tables' documents; the number of sequences is the least there can be."""
    rng = np.random.default_rng(4)
    for n, least in ((1000, 0.6), (10_000, 0.8)):
        counts = np.bincount(np.minimum(4096, rng.lognormal(6.3, 0.9, n).astype(int) + 1), minlength=4097)
        patterns = {tuple(x for x in row if x) for row in packing.patterns_for(np.where(np.arange(4097) < 4096, counts, 0), 4096).tolist()}
        plan = packing.pack_counts(counts)
        by = sum(times * sum(m for _, m in p) for p, times in plan if tuple(x for x, m in p for _ in range(m)) in patterns)
        assert by >= least * counts[:4096].sum()
        assert sum(times for _, times in plan) == -(-int((counts * np.arange(4097)).sum()) // 4096)


def test_words_are_encoded_as_the_library_does(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library = Tokenizer.from_file(path)
    tokens = packing.Tokens(path, kept=50)  # tables that turn over all the time
    rng = random.Random(9)
    odd = ["ΑΣ", "ΑΣ.", "Σ", "naïve,", "can't", "it's.", "x'", "don't!!", "a<|endoftext|>b", "<|startoftext|>", "क़", "क़.", "5%", "a5.", "...", "é", "é", "ﬁ!", "İ.", "ǅ", "한", "가", "́", "a_b", "a|b|", "<a>", "=>", "A.B.", "日本。", "😀!", "a\x1cb", "\x1c", "ß)", "'s", "'", "''s"]
    words = odd + ["".join(rng.choice("abcDEé") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", ",", "!!", "###", "-x"]) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + ["", " \n"]
    got = [*tokens(texts[:30]), *tokens(texts[30:])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
