"""Media columns: GIF files as binary columns, written and decoded here.

The decoder reads LZW code streams, applies global and local palettes, interlacing, disposal and transparency, and gives
timed frames with colour histograms. The writer stores arbitrary bytes without loss as 8-bit samples: frames 64 wide
over a grey palette in which sample i has colour (i, i, i).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table, texts

WIDTH, FRAME_ROWS = 64, 1024
BINS = 8


class BadGif(ValueError):
    pass


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code, if the table starts with 2**least + 2 entries."""
    have = (1 << least) + 1 + np.arange(n)
    have[0] = 0
    return np.clip(np.frexp(have.astype(float))[1], least + 1, 12)


_WIDTHS = {least: _widths(4100, least) for least in range(2, 9)}


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """GIF's LZW: codes of growing width, lowest bits first; the table is cleared when full."""
    clear = 1 << least
    codes: list[int] = [clear]
    put, known, free = codes.append, {}, clear + 2
    get = known.get
    segments = [0]
    if data:
        now = data[0]
        for b in memoryview(data)[1:]:
            key = now << 8 | b
            code = get(key)
            if code is None:
                put(now)
                now = b
                if free < 4096:
                    known[key] = free
                    free += 1
                else:
                    segments.append(len(codes))
                    put(clear)
                    known.clear()
                    free = clear + 2
            else:
                now = code
        put(now)
    put(clear + 1)
    # the clear code that opens the stream has the first width; later ones close their segment
    widths = np.empty(len(codes), np.int64)
    widths[0] = least + 1
    ends = [*segments[1:], len(codes) - 1]
    start = 1
    for end in ends:
        widths[start : end + 1] = _long_widths(end + 1 - start, least)
        start = end + 1
    bits = (np.asarray(codes, np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _long_widths(n: int, least: int) -> np.ndarray:
    known = _WIDTHS[least]
    return known[:n] if n <= len(known) else np.concatenate([known, np.full(n - len(known), 12)])


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """The samples of a code stream, ``most`` at most."""
    if not 2 <= least <= 8:
        raise BadGif("code size")
    clear, stop = 1 << least, (1 << least) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at, out, size = len(data) * 8, 0, [], 0
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    while at + least < total and size < most:
        widths = _WIDTHS[least]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, "right"))
        starts = ends[:n] - widths[:n]
        byte = starts >> 3
        window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = window >> (starts & 7) & ((1 << widths[:n]) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(marks[0]) if len(marks) else n
        segment = codes[:end].tolist()
        if segment:
            entries, add = list(first), None
            try:
                before = entries[segment[0]]
                if not before:
                    raise BadGif("code before its entry")
                out.append(before)
                size += len(before)
                add = entries.append
                for code in segment[1:]:
                    if code < len(entries):
                        entry = entries[code]
                    elif code == len(entries) and len(entries) < 4096:
                        entry = before + before[:1]
                    else:
                        raise BadGif("code before its entry")
                    if len(entries) < 4096:
                        add(before + entry[:1])
                    out.append(entry)
                    size += len(entry)
                    before = entry
            except IndexError:
                raise BadGif("code before its entry") from None
        if not len(marks):
            break
        at = int(ends[end])
        if codes[end] == stop:
            break
    return b"".join(out)[:most]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray = field(repr=False)  # height x width palette indices


def _rows(height: int, interlaced: bool) -> np.ndarray:
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(height)


def decode(data: bytes) -> tuple[int, int, int, list[Frame]]:
    """Width, height, background index and frames of a GIF; BadGif if it is damaged."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("signature")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, background, at = data[10], data[11], 13
    palette = None
    try:
        if flags & 128:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n

        def blocks(at: int) -> tuple[bytes, int]:
            parts = []
            while size := data[at]:
                parts.append(data[at + 1 : at + 1 + size])
                at += 1 + size
            return b"".join(parts), at + 1

        frames: list[Frame] = []
        delay = disposal = 0
        transparent = None
        while True:
            kind = data[at]
            if kind == 0x3B:
                return width, height, background, frames
            if kind == 0x21:
                label = data[at + 1]
                body, at = blocks(at + 2)
                if label == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                    transparent = body[3] if body[0] & 1 else None
            elif kind == 0x2C:
                left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
                own, local, at = data[at + 9], palette, at + 10
                if own & 128:
                    n = 2 << (own & 7)
                    local = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                    at += 3 * n
                if local is None:
                    raise BadGif("no palette")
                least = data[at]
                body, at = blocks(at + 1)
                samples = np.frombuffer(lzw_decode(body, least, w * h), np.uint8)
                if len(samples) < w * h:
                    raise BadGif("frame is cut off")
                if len(samples) and samples.max() >= len(local):
                    raise BadGif("sample without colour")
                grid = np.empty((h, w), np.uint8)
                grid[_rows(h, bool(own & 64))] = samples.reshape(h, w)
                frames.append(Frame(left, top, w, h, delay, disposal, transparent, local, grid))
                delay = disposal = 0
                transparent = None
            else:
                raise BadGif("block kind")
    except (IndexError, ValueError) as e:
        raise e if isinstance(e, BadGif) else BadGif("file is cut off") from None


MOST_PIXELS = 1 << 26


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (RGBA) as shown with each frame: transparent samples leave what is there; afterwards the frame stays
    (disposal 0, 1), its area becomes transparent (2) or what it covered comes back (3). A header may claim any canvas;
    over ``MOST_PIXELS`` it counts as damaged."""
    if width * height > MOST_PIXELS:
        raise BadGif(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        area = (slice(f.top, min(height, f.top + f.height)), slice(f.left, min(width, f.left + f.width)))
        before = canvas[area].copy()
        samples = f.samples[: before.shape[0], : before.shape[1]]
        colours = np.concatenate([f.palette[samples], np.full((*samples.shape, 1), 255, np.uint8)], 2)
        shown = np.ones(samples.shape, bool) if f.transparent is None else samples != f.transparent
        canvas[area] = np.where(shown[..., None], colours, before)
        yield canvas
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas[area] = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the visible points' red, green and blue in BINS steps each."""
    seen = rgba.reshape(-1, 4)
    seen = seen[seen[:, 3] > 0]
    return np.concatenate([np.bincount(seen[:, c].astype(int) * BINS // 256, minlength=BINS) for c in range(3)]) if len(seen) else np.zeros(3 * BINS, np.int64)


def frame_histogram(f: Frame) -> np.ndarray:
    """The same for a frame by itself, by way of its palette."""
    counts = np.bincount(f.samples.ravel(), minlength=256)
    if f.transparent is not None:
        counts[f.transparent] = 0
    n = len(f.palette)
    return np.concatenate([np.bincount(f.palette[:, c].astype(int) * BINS // 256, counts[:n], minlength=BINS) for c in range(3)]).astype(np.int64)


GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode_bytes(payload: bytes, delay_ms: int = 100) -> bytes:
    """A GIF whose samples are ``payload`` (a multiple of 64 bytes), in frames of up to 1024 rows."""
    step = WIDTH * FRAME_ROWS
    rows = min(FRAME_ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), rows.to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        out += [b"\x21\xf9\x04\x04", (delay_ms // 10).to_bytes(2, "little"), b"\0\0\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08"]
        codes = lzw_encode(part)
        whole = len(codes) // 255
        if whole:
            grid = np.full((whole, 256), 255, np.uint8)
            grid[:, 1:] = np.frombuffer(codes, np.uint8, whole * 255).reshape(whole, 255)
            out.append(grid.tobytes())
        if rest := codes[whole * 255 :]:
            out += [bytes([len(rest)]), rest]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media, ids, held = [], [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, payload = padded(text)
            ids.append(doc)
            sizes.append(n)
            media.append(encode_bytes(payload))
            held += len(media[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                sizes, media, ids, held = [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_gif(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a GIF.
    Null texts count as empty; repeated rows are stored each; other columns are ignored."""
    ship(docs.sparkSession)
    return texts(docs).mapInArrow(store_rows, "doc_id long, n_bytes long, media binary")


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(2).to_pylist():
            try:
                if media is None:
                    raise BadGif("no media")
                _, _, _, frames = decode(media)
            except BadGif as e:
                rows.append((*[None] * 6, str(e)))
                continue
            payload = b"".join(f.palette[:, 0][f.samples].tobytes() for f in frames)
            counts = sum(frame_histogram(f) for f in frames)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};grey=" + ",".join(map(str, counts[:BINS])), None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from stored media: payload size and digest, the last bytes' CRC, the file's size and digest,
    and a feature string of frame count, duration and colour histogram. Null or damaged media have nulls there and an
    ``error``, which others have not."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(feature_rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


FRAMES = "doc_id long, frame int, x int, y int, width int, height int, start_ms long, delay_ms int, disposal int, transparent int, histogram array<long>, error string"


def frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.int64(), *[pa.int32()] * 3, pa.list_(pa.int64()), pa.string()]
    names = [x.split()[0] for x in FRAMES.split(", ")]
    for batch in batches:
        rows = []
        for doc, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if media is None:
                continue
            try:
                width, height, _, frames = decode(media)
                start = 0
                for k, (f, shown) in enumerate(zip(frames, composed(width, height, frames), strict=True)):
                    rows.append((doc, k, f.left, f.top, f.width, f.height, start, f.delay_ms, f.disposal, f.transparent, histogram(shown).tolist(), None))
                    start += f.delay_ms
            except BadGif as e:
                rows.append((doc, *[None] * 10, str(e)))
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def gif_frames(media: DataFrame) -> DataFrame:
    """A row for each frame of the GIFs in ``media`` (doc_id, media): place, time, disposal, and the colour histogram of
    the canvas as shown. Null media have no frames; a damaged file gives one row with its error and no others kept."""
    ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(frame_rows, FRAMES)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIF and read back."""
    return media_features(store_gif(table(spark, sf_dir, "documents")))
