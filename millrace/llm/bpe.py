"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

A sequence of tokens is what BPE makes of their joined text exactly if every two neighbours are (each pair, joined and
merged on its own, gives the pair back). So the last token of every prefix can be found from left to right: it is the
token that ends there and fits the last token of the prefix before it. The transducer keeps these for the last
``lookahead`` symbols only, the length of the longest text that the merge list makes one token: any later token starts there, so a token from which all of
them descend can't change any more and is emitted. Memory is constant however long the text is.

White space and the pre-tokenizer's pattern cut a text into short pieces; what the transducer emits for a piece is kept
in tables of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, ship, table, texts

#: White space of the tokenizer's patterns; Python's own also has FS, GS, RS and US.
SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_WORDS = regex.compile(rf"[^{SPACE}]+")


#: A piece's first symbols, after which the transducer's states are kept, and of how many such beginnings.
BEGIN, STARTS = 4, 60_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def split_words(text: str) -> list[str]:
    """Text between white space."""
    odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return _WORDS.findall(text) if odd else text.split()


def word_blocks(text: str, size: int = 8192) -> Iterator[list[str]]:
    """Text between white space, of long texts ``size`` words at a time."""
    if len(text) <= 8 * size:
        yield split_words(text)
        return
    found = _WORDS.finditer(text)
    while block := [m[0] for m in islice(found, size)]:
        yield block


class Bpe:
    """Vocabulary and merges of a tokenizers file with byte-level BPE (optionally with word ends and lower case)."""

    def __init__(self, spec: dict, kept: int = 300_000):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in added.items()})
        self.special = added
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self._bytes = dict(enumerate(byte_symbols()))
        # tokens that BPE makes of their own text; others never come out of a merge
        inner, final = {}, {}
        for token, i in self.vocab.items():
            if token in added:
                continue
            if self.suffix and token.endswith(self.suffix):
                final[token[: -len(self.suffix)]] = i
            else:
                inner[token] = i
        self.inner, self.final = inner, final if self.suffix else inner
        # every end of a token: its id, or -1 if it is none itself
        self.inner_ends = self._ends(self.inner)
        self.final_ends = self._ends(self.final) if self.suffix else self.inner_ends
        self.back = {c: b for b, c in self._bytes.items()}
        # no token is longer than what a merge makes, so a token that ends at a symbol starts at most that far before it
        self.lookahead = max([1, *(len(a) + len(b) - (len(self.suffix) if self.suffix and b.endswith(self.suffix) else 0) for a, b in merges)])
        self.starts: dict[str, tuple[list[int], list[int]]] = {}
        self._fits: dict[int, bool] = {}
        self.kept = kept

    @staticmethod
    def _ends(names: dict[str, int]) -> dict[str, int]:
        ends = {name[k:]: -1 for name in names for k in range(len(name))}
        return ends | names

    @classmethod
    def from_file(cls, path: str, **options) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), **options)

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: the merge of least rank first, leftmost of equals."""
        none = 1 << 30
        get = self.ranks.get
        found = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            k = found.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del found[k]
            if k:
                found[k - 1] = get((symbols[k - 1], symbols[k]), none)
            if k < len(found):
                found[k] = get((symbols[k], symbols[k + 1]), none)
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return [*token[:-1], token[-1] + self.suffix]
        return list(token)

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE gives a, b for the joined text of a and b (a < 0: nothing stands before b)."""
        key = (a << 20) | b if a >= 0 else ~b
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > self.kept:
                self._fits.clear()
            right = self.tokens[b]
            if a < 0:
                got = self.merged(self._symbols(right)) == [right]
            else:
                left = self.tokens[a]
                got = self.merged(list(left) + self._symbols(right)) == [left, right]
            self._fits[key] = got
        return got

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token (in byte symbols), from the Transducer."""
        return list(Transducer(self).run(piece))

    def pieces(self, word: str) -> list[str]:
        """Pre-tokens, as byte symbols, of text without white space or special tokens."""
        if self.nfc and not word.isascii():
            word = unicodedata.normalize("NFC", word)
        if self.lower:
            word = word.replace("Σ", "σ").lower()
        if word.isalpha():
            found = [word]
        elif word[:-1].isalpha() and word[-1] in ".,":
            found = [word[:-1], word[-1]]
        else:
            found = _PIECE.findall(word)
        return found if word.isascii() and word.isprintable() else [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._bytes) for p in found]

    def words(self, text: str) -> list[str]:
        """Text between white space."""
        return split_words(text)

    def encode_word(self, word: str, ids_of) -> list[int]:
        """Ids of text without white space; ``ids_of`` gives those of a piece."""
        out: list[int] = []
        for part in self._special.split(word) if self._special and "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece in self.pieces(part):
                    out += ids_of(piece)
        return out


class Transducer:
    """The streaming form: push symbols, get stable tokens; ``finish`` ends the piece."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.text, self.at = bpe, "", 0  # text: the symbols from the last stable token on
        self.last, self.back = [-1], [0]

    def _step(self, end: int, ends: dict[str, int]) -> None:
        """The token that ends here: of those that fit what stands before them there is one."""
        bpe, text, last = self.bpe, self.text, self.last
        known, get, token, start = bpe._fits, ends.get, -1, 0
        found = []
        for j in range(end - 1, -1, -1):
            t = get(text[j:end])
            if t is None:  # nor is anything longer the end of a token
                break
            if t >= 0:
                found.append((j, t))
        for j, t in reversed(found):
            before = last[j]
            if before < 0 and (j or self.at):
                continue
            ok = known.get((before << 20) | t if before >= 0 else ~t)
            if bpe.fits(before, t) if ok is None else ok:
                token, start = t, j
                break
        self.last.append(token)
        self.back.append(start)

    def push(self, symbols: str) -> Iterator[int]:
        """Take symbols of which the piece's last is none."""
        most, inner = 4 * self.bpe.lookahead, self.bpe.inner_ends
        for s in symbols:
            self.text += s
            self._step(len(self.text), inner)
            if len(self.text) >= most:
                yield from self._emit()

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(end)
            end = self.back[end]
        return out[::-1]

    def _emit(self) -> Iterator[int]:
        n = len(self.text)
        chains = [self._chain(e) for e in range(n - self.bpe.lookahead + 1, n + 1) if self.last[e] >= 0]
        common = 0
        while all(len(c) > common and c[common] == chains[0][common] for c in chains):
            common += 1
        # the last common token stays as what the next ones must fit
        for e in chains[0][: common - 1] if common else []:
            yield self.last[e]
        if common > 1:
            cut = chains[0][common - 2]
            keep = self.last[cut]
            self.text, self.at = self.text[cut:], self.at + cut
            self.last = [keep, *self.last[cut + 1 :]]
            self.back = [0, *(max(0, b - cut) for b in self.back[cut + 1 :])]

    def finish(self, symbol: str) -> Iterator[int]:
        """The piece's last symbol, then all that is left."""
        self.text += symbol
        self._step(len(self.text), self.bpe.final_ends)
        for e in self._chain(len(self.text)):
            yield self.last[e]

    def run(self, piece: str) -> Iterator[int]:
        """A whole piece; the states after its first symbols are those of the last piece that began so."""
        head = piece[: min(BEGIN, len(piece) - 1)]
        found = self.bpe.starts.get(head)
        if found:
            self.text, self.last, self.back = head, found[0].copy(), found[1].copy()
        else:
            yield from self.push(head)
            if len(self.text) == len(head):  # nothing is emitted yet
                if len(self.bpe.starts) >= STARTS:
                    self.bpe.starts.clear()
                self.bpe.starts[head] = self.last.copy(), self.back.copy()
        yield from self.push(piece[len(head) : -1])
        yield from self.finish(piece[-1])


class Decoder:
    """Ids to text, piece by piece. ``byte_level``: bytes of whole tokens become text as soon as characters are complete;
    else tokens are joined by single spaces, which is what the library does for a file without a decoder."""

    def __init__(self, bpe: Bpe, byte_level: bool = False):
        self.bpe, self.byte_level, self.first = bpe, byte_level, True
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace") if byte_level else None

    def push(self, ids: Iterable[int]) -> str:
        if self.byte_level:
            return "".join(self._utf8.decode(bytes(self.bpe.back[c] for c in self.bpe.tokens[i])) for i in ids)
        text = " ".join(self.bpe.tokens[i] for i in ids)
        if not text:
            return ""
        self.first, lead = False, "" if self.first else " "
        return lead + text

    def finish(self) -> str:
        return self._utf8.decode(b"", True) if self.byte_level else ""


class Table:
    """word -> value, made on demand. Holds about ``kept`` entries and, until as many new ones have come, those before,
    so its memory is bounded and what is used often stays."""

    def __init__(self, make, kept: int):
        self.make, self.kept, self.known, self.old = make, kept, {}, {}

    def __getitem__(self, word):
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= self.kept:
                self.known, self.old = {}, self.known
            value = self.old.get(word)
            value = self.known[word] = self.make(word) if value is None else value
        return value

    def all(self, words: list) -> list:
        """The values of many words; one lookup for those that are known."""
        found = [*map(self.known.get, words)]
        for k, value in enumerate(found):
            if value is None:
                found[k] = self[words[k]]
        return found


def encoder(path: str, form, kept: int = 500_000) -> tuple[Bpe, Table]:
    """A Bpe of this worker, and a table word -> ``form(bpe, ids)``; kept between batches and tasks."""

    def make():
        bpe = Bpe.from_file(path, kept=kept)
        ids_of = Table(bpe.encode_piece, kept)
        return bpe, Table(lambda word: form(bpe, bpe.encode_word(word, ids_of.__getitem__)), kept)

    return held(("bpe", path, form.__name__), make)


def id_text_form(bpe: Bpe, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), " ".join(map(str, ids)), Decoder(bpe).push(ids)


def digest_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    _, known = encoder(path, id_text_form)
    for batch in batches:
        counts, ids, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for words in word_blocks(text):
                parts = [p for p in known.all(words) if p[0]]
                if not parts:
                    continue
                between = " " if n else ""
                n += sum([p[0] for p in parts])
                of_ids.update((between + " ".join([p[1] for p in parts])).encode())
                of_text.update((between + " ".join([p[2] for p in parts])).encode())
            counts.append(n)
            ids.append(of_ids.hexdigest())
            decoded.append(of_text.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe, known = encoder(path, plain_form)
    for batch in batches:
        ids = [[i for p in known.all(bpe.words(t)) for i in p] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def plain_form(bpe: Bpe, ids: list[int]) -> list[int]:
    return ids


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text, as the tokenizers library gives them without special tokens of its
    own. Null texts count as empty and have no ids; strings of special tokens inside a text are those tokens; repeated
    rows are encoded each; other columns are ignored; an empty table gives no rows."""
    ship(docs.sparkSession)
    return texts(docs).mapInArrow(lambda b: encode_ids(b, path), "doc_id long, ids array<int>")


def decode_rows(batches: Iterator[pa.RecordBatch], path: str, byte_level: bool) -> Iterator[pa.RecordBatch]:
    bpe, _ = encoder(path, plain_form)
    for batch in batches:
        out = []
        for ids in batch.column(1).to_pylist():
            d = Decoder(bpe, byte_level)
            out.append(d.push(ids or []) + d.finish())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def bpe_decode(encoded: DataFrame, path: str, byte_level: bool = False) -> DataFrame:
    """doc_id and text of every ids array; null or empty ids give the empty text."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: decode_rows(b, path, byte_level), "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded and decoded in one pass."""
    ship(docs.sparkSession)
    return texts(docs).mapInArrow(lambda b: digest_rows(b, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    """The public vocabulary of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary())
