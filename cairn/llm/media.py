"""Media columns: PNG decoding and perceptual hashes in binary columns.

A PNG is read chunk by chunk: signature, order, lengths and the CRC of every chunk are tested, IDAT is
inflated through zlib, and scanlines are unfiltered in numpy for all images of a shape at once (the
filters Average and Paeth depend on the byte to the left, so they advance a pixel at a time across the
batch). All colour types, bit depths and Adam7 interlacing are decoded. The hash is taken of the 8x8 lowest
frequencies of the cosine transform of the 32x32 grey image: a bit for each above their median.

Defined results: a null image gives null status; a faulty one a status that names the fault, null hash
and null sizes; repeated rows are decoded each; an empty table gives an empty one; other columns are
kept, but those named as a result give way. An image is decoded in bands of rows, so its size
doesn't matter; only one whose single row has more than ROW_BYTES is refused, as 'row too long'.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import kernel

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW_BYTES = 64 << 20
BAND_BYTES = 4 << 20
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
GRID, LOW = 32, 8
_DCT = np.cos(np.pi * (np.arange(GRID) + 0.5)[None, :] * np.arange(LOW)[:, None] / GRID)


class Fault(ValueError):
    pass


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise Fault("signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise Fault("chunk cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + n > len(data):
            raise Fault("chunk cut off")
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise Fault(f"checksum of {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise Fault("no IEND")


class Image:
    """Header, palette and compressed scanlines of one PNG."""

    def __init__(self, data: bytes):
        self.width = self.height = self.depth = self.colour = self.fault = None
        palette, idat, ended = None, [], False
        for k, (kind, body) in enumerate(chunks(data)):
            if k == 0:
                if kind != b"IHDR" or len(body) != 13:
                    raise Fault("no IHDR")
                self.width, self.height, self.depth, self.colour, method, filters, self.interlace = struct.unpack(">IIBBBBB", body)
                if not self.width or not self.height or self.depth not in DEPTHS.get(self.colour, ()) or method or filters or self.interlace > 1:
                    raise Fault("header")
                if self.width * CHANNELS[self.colour] * self.depth // 8 > ROW_BYTES:
                    raise Fault("row too long")
            elif kind == b"PLTE":
                if len(body) % 3 or not body:
                    raise Fault("palette")
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                if ended:
                    raise Fault("IDAT not consecutive")
                idat.append(body)
            elif kind[0] & 32 == 0 and kind != b"IEND":
                raise Fault(f"critical chunk {kind.decode('latin-1')}")
            ended = bool(idat) and kind != b"IDAT"
        if not idat:
            raise Fault("no IDAT")
        if self.colour == 3 and palette is None:
            raise Fault("no PLTE")
        self.palette = palette
        self.passes = [(0, 0, 1, 1)] if not self.interlace else [p for p in _ADAM7 if p[0] < self.width and p[1] < self.height]
        self.shapes = [(-(-(self.height - y) // sy), -(-(self.width - x) // sx)) for x, y, sx, sy in self.passes]
        bits = CHANNELS[self.colour] * self.depth
        self.bpp = max(1, bits // 8)
        self.line = [1 + -(-w * bits // 8) for _, w in self.shapes]
        self.want = sum(h * n for (h, _), n in zip(self.shapes, self.line))
        self.idat = idat
        self.small = self.want <= BAND_BYTES
        self.lines = [block for _, _, block in self.bands()] if self.small else None

    def bands(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(pass, first row, scanlines with their filter bytes), about BAND_BYTES at a time; the stream must hold just these."""
        z = zlib.decompressobj()
        pieces = iter(self.idat)
        held = b""

        def take(n: int) -> bytes:
            nonlocal held
            out = []
            try:
                while n:
                    got = z.decompress(held, n)
                    held = z.unconsumed_tail
                    if got:
                        out.append(got)
                        n -= len(got)
                    elif z.eof or not held and (held := next(pieces, b"")) == b"":
                        break
            except zlib.error:
                raise Fault("zlib stream") from None
            return b"".join(out)

        for k, ((h, _), n) in enumerate(zip(self.shapes, self.line)):
            step = max(1, BAND_BYTES // n) if not self.small else h
            for y in range(0, h, step):
                rows = min(step, h - y)
                raw = take(rows * n)
                if len(raw) != rows * n:
                    raise Fault("scanlines")
                block = np.frombuffer(raw, np.uint8).reshape(rows, n)
                if block[:, 0].max(initial=0) > 4:
                    raise Fault("filter type")
                yield k, y, block
        if take(1):
            raise Fault("scanlines")
        if not z.eof:
            raise Fault("zlib stream")


def unfilter(block: np.ndarray, bpp: int, above: np.ndarray | None = None) -> np.ndarray:
    """Scanlines (images, rows, 1 + bytes) without their filters: (images, rows, bytes). ``above``: the row before.

    A pixel depends on those to the left, above, and left above: all pixels of one sum of row and column, of
    all images, are done at once. Rows that only depend on the one above are done whole."""
    n, h, w = block.shape
    w -= 1
    wide = w // bpp
    # images last: what is done at once lies together
    out = np.zeros((h + 1, wide + 1, bpp, n), np.uint8)  # a row above and a pixel to the left, of zeros
    if above is not None:
        out[0, 1:] = above.reshape(n, wide, bpp).transpose(1, 2, 0)
    kinds = np.ascontiguousarray(block[:, :, 0].T)
    line = np.ascontiguousarray(block[:, :, 1:].reshape(n, h, wide, bpp).transpose(1, 2, 3, 0))
    if kinds.max(initial=0) < 3:
        for y in range(h):
            row = np.where(kinds[y] == 1, np.cumsum(line[y], axis=0, dtype=np.uint8), line[y])
            out[y + 1, 1:] = np.where(kinds[y] == 2, row + out[y, 1:], row)
    else:
        sub, up, mean, paeth = ((kinds == k)[:, None] for k in range(1, 5))
        for t in range(wide + h - 1):
            y = np.arange(max(0, t - wide + 1), min(h, t + 1))
            x = t - y
            a, b, c = out[y + 1, x].astype(np.int16), out[y, x + 1].astype(np.int16), out[y, x].astype(np.int16)
            da, db = b - c, a - c
            near_a, near_b, near_c = np.abs(da), np.abs(db), np.abs(da + db)
            guess = np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c)) * paeth[y]
            guess += a * sub[y] + b * up[y] + ((a + b) >> 1) * mean[y]
            out[y + 1, x + 1] = line[y, x] + guess.astype(np.uint8)
    return np.ascontiguousarray(out[1:, 1:].transpose(3, 0, 1, 2)).reshape(n, h, w)


def samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(images, rows, width, channels) sample values of unfiltered bytes."""
    n, h, _ = rows.shape
    if depth == 8:
        return rows.reshape(n, h, width, channels)
    if depth == 16:
        return (rows[..., 0::2].astype(np.uint16) << 8 | rows[..., 1::2]).reshape(n, h, width, channels)
    bits = np.unpackbits(rows, axis=2).reshape(n, h, -1, depth)
    values = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return values[:, :, : width * channels].reshape(n, h, width, channels)


def light(values: np.ndarray, images: list[Image]) -> np.ndarray:
    """(images, rows, width) luminance in 0..1 of samples of images of one kind; alpha is over white. A palette
    index that the palette lacks is a fault of its image."""
    one = images[0]
    if one.colour == 3:
        index = values[..., 0].astype(np.int64)
        for k, i in enumerate(images):
            if index[k].max(initial=0) >= len(i.palette):
                i.fault = "palette index"
        rgb = np.stack([i.palette[np.minimum(index[k], len(i.palette) - 1)] for k, i in enumerate(images)]) / 255
    else:
        full = values / ((1 << one.depth) - 1)
        rgb = full[..., :3] if one.colour in (2, 6) else full[..., :1]
    grey = rgb @ np.array([0.299, 0.587, 0.114]) if rgb.shape[-1] == 3 else rgb[..., 0]
    if one.colour in (4, 6):
        a = full[..., -1]
        grey = grey * a + (1 - a)
    return grey


def _overlap(n: int, at: np.ndarray) -> np.ndarray:
    """GRID x len(at): what part of each of GRID cells over n samples the samples ``at`` are."""
    edge = np.arange(GRID + 1) * n / GRID
    over = np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at)
    return np.maximum(over, 0) * GRID / n


def _across(rows: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """(images, rows, GRID) averages of rows whose samples lie at the columns ``at`` of n."""
    if len(at) <= 4096:
        return rows @ _overlap(n, at).T
    lo = at * GRID // n
    hi = np.minimum(GRID - 1, (at + 1) * GRID // n)  # a pixel lies in one cell, or in two
    part = np.clip(hi * n / GRID - at, 0, 1)
    part[hi == lo] = 1
    base = np.arange(rows.shape[0] * rows.shape[1])[:, None] * GRID
    flat = rows.reshape(len(base), -1)
    size = len(base) * GRID
    sums = np.bincount((base + lo).ravel(), (flat * part).ravel(), size) + np.bincount((base + hi).ravel(), (flat * (1 - part)).ravel(), size)
    return sums.reshape(*rows.shape[:2], GRID) * GRID / n


def grid(images: list[Image]) -> np.ndarray:
    """(images, GRID, GRID) averages of the luminance of images of one shape and kind (one at a time, if they are large)."""
    one = images[0]
    out = np.zeros((len(images), GRID, GRID))
    above = None
    parts = ((k, 0, np.stack([i.lines[k] for i in images])) for k in range(len(one.shapes))) if one.small else ((k, y, b[None]) for k, y, b in one.bands())
    for k, first, block in parts:
        (x, y, sx, sy), (_, w) = one.passes[k], one.shapes[k]
        rows = unfilter(block, one.bpp, above if first else None)
        above = rows[:, -1]
        down = _overlap(one.height, y + sy * (first + np.arange(rows.shape[1])))
        out += down @ _across(light(samples(rows, w, CHANNELS[one.colour], one.depth), images), one.width, x + sx * np.arange(w))
    return out


def cosine_hash(small: np.ndarray) -> list[bytes]:
    low = np.round((_DCT @ small @ _DCT.T).reshape(len(small), -1), 9)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    bits[:, 0] = False  # the mean says nothing of the shape
    return [b.tobytes() for b in np.packbits(bits, axis=1)]


def _decode(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for s in range(0, big.num_rows, 1024):
            b = big.slice(s, 1024)
            n = b.num_rows
            info: list[dict] = [{} for _ in range(n)]
            alike = defaultdict(list)
            for k, data in enumerate(b.column(column)):
                if not data.is_valid:
                    continue
                try:
                    i = Image(data.as_py())
                    info[k] = {"width": i.width, "height": i.height, "channels": CHANNELS[i.colour], "depth": i.depth, "status": "ok"}
                    alike[i.width, i.height, i.colour, i.depth, i.interlace].append((k, i))
                except Fault as e:
                    info[k] = {"status": str(e)}
            for group in alike.values():
                step = max(1, BAND_BYTES // group[0][1].want)
                for p in range(0, len(group), step):
                    some = group[p : p + step]
                    try:
                        hashes = cosine_hash(grid([i for _, i in some]))
                    except Fault as e:  # of a large image, which is alone
                        info[some[0][0]] = {"status": str(e)}
                        continue
                    for (k, i), h in zip(some, hashes):
                        info[k] = {"status": i.fault} if i.fault else info[k] | {"phash": h}
            names = [c for c in b.schema.names if c != column]
            new = [(c, t) for c, t in (("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("status", pa.string()), ("phash", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array([i.get(c) for i in info], t) for c, t in new]], [*names, *[c for c, _ in new]])


def decode(images: DataFrame, column: str = "png") -> DataFrame:
    """``images`` with width, height, channels, depth, status and phash instead of the binary column."""
    images = kernel.without(images, "width", "height", "channels", "depth", "status", "phash")
    kept = [f for f in images.schema if f.name != column]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "width int, height int, channels int, depth int, status string, phash binary"])
    return images.mapInArrow(lambda batches: _decode(column, batches), schema)


def encode(pixels: np.ndarray, colour: int, depth: int = 8, filters: int = 0, palette: bytes = b"", pieces: int = 2) -> bytes:
    """A PNG of (height, width, channels) samples whose row y has filter (filters + y) % 5; IDAT in ``pieces``."""
    h, w, c = pixels.shape
    if depth == 16:
        raw = np.stack([pixels >> 8, pixels & 255], -1).astype(np.uint8).reshape(h, -1)
    elif depth == 8:
        raw = pixels.astype(np.uint8).reshape(h, -1)
    else:
        bits = (pixels.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
        raw = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)
    bpp = max(1, c * depth // 8)
    wide = np.zeros((h + 1, raw.shape[1] + bpp), np.int16)
    wide[1:, bpp:] = raw
    a, b, d = wide[1:, :-bpp], wide[:-1, bpp:], wide[:-1, :-bpp]
    pa_, pb, pc = np.abs(b - d), np.abs(a - d), np.abs(a + b - 2 * d)
    guess = np.stack([np.zeros_like(a), a, b, (a + b) >> 1, np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, d))])
    kind = (filters + np.arange(h)) % 5
    lines = np.concatenate([kind[:, None].astype(np.uint8), (wide[1:, bpp:] - guess[kind, np.arange(h)]).astype(np.uint8)], axis=1)
    z = zlib.compress(lines.tobytes(), 6)
    step = -(-len(z) // pieces)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)), *([(b"PLTE", palette)] if palette else []), *[(b"IDAT", z[k : k + step]) for k in range(0, len(z), step)], (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I4s", len(x), k) + x + struct.pack(">I", zlib.crc32(k + x)) for k, x in parts)


def draw(vectors: DataFrame) -> DataFrame:
    """Vectors as pictures (vec_id, png): the values as a square of grey levels, each cell 4x4 pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in enumerate(b.column("embedding")):
                if not v.is_valid or not len(v.values):
                    out.append(None)
                    continue
                x = np.nan_to_num(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64))
                side = int(np.ceil(np.sqrt(len(x))))
                x = np.pad(x, (0, side * side - len(x))).reshape(side, side)
                x = np.round((x - x.min()) / max(x.max() - x.min(), 1e-12) * 255).astype(np.uint8)
                out.append(encode(np.kron(x, np.ones((4, 4), np.uint8))[..., None], 0, filters=k))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "png"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, png binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector drawn as a PNG, decoded and hashed."""
    return decode(draw(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
