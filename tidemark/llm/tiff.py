"""TIFF pages: a reader that walks image directories and undoes compression and predictors, and a writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_select, small_batches, task, utf8

# Fixed values of the format.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
NO_PREDICTOR, HORIZONTAL, FLOATING = 1, 2, 3
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339)
FILL_ORDER = 266
_KNOWN = {WIDTH, HEIGHT, BITS, COMPRESSION, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT}
#: Bytes that one compressed byte can give at most: a deflate code of two bits for 258 bytes, an LZW code of nine for its table's longest entry,
#: a PackBits pair for 128.
_RATIO = {NONE: 1, LZW: 4096, DEFLATE: 1040, DEFLATE_OLD: 1040, PACKBITS: 64}
#: A raster is one binary value, whose offsets are of 32 bits.
MOST_BYTES = 1 << 31
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


class Malformed(ValueError):
    """The file is not a TIFF that this reader understands."""


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count below 128 and that many bytes more one, or a count above and one byte repeated; until there are `size` bytes."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW of most significant bit first, whose codes widen one code early; until there are `size` bytes. A table is full at 4096
    codes and then grows no more."""
    out, table = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    held, bits, width, before = 0, 0, 9, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, before = 9, None
            continue
        if code == 257:
            break
        if before is None:
            if code > 255:
                raise Malformed("an LZW stream starts with an unknown code")
            entry = table[code]
        else:
            if code > len(table):
                raise Malformed("an LZW code is beyond its table")
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + entry[:1])
        out += entry
        if len(out) >= size:
            break
        before = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 256, 9
    table, width, entry = {bytes((i,)): i for i in range(256)}, 9, b""
    size = 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    while bits >= 8:
        bits -= 8
        out.append(held >> bits)
        held &= (1 << bits) - 1
    for i in range(len(data)):
        longer = entry + data[i : i + 1]
        if longer in table:
            entry = longer
            continue
        put(table[entry])
        table[longer], size = size, size + 1
        width = max(9, size.bit_length())
        entry = data[i : i + 1]
        if size == 4094:
            put(table[entry])
            put(256)
            table, size, width, entry = {bytes((i,)): i for i in range(256)}, 258, 9, b""
    if entry:
        put(table[entry])
        width = max(9, (size + 1).bit_length())
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise Malformed(str(e)) from e


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how in (DEFLATE, DEFLATE_OLD):
        return _inflate(data, size)
    if how == LZW:
        return unpack_lzw(data, size)
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == NONE:
        return data
    raise Malformed(f"compression {how}")


def _samples(raw: bytes, shape: tuple[int, int, int], bits: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """rows x pixels x samples of a part whose predictor is undone; samples below a byte become one each, rows start at bytes."""
    rows, pixels, samples = shape
    if bits < 8:
        packed = np.frombuffer(raw, np.uint8, rows * (-(-pixels * samples * bits // 8))).reshape(rows, -1)
        block = np.unpackbits(packed, axis=1).reshape(rows, -1, bits)
        block = (block << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : pixels * samples].reshape(shape)
    else:
        block = np.frombuffer(raw, dtype, rows * pixels * samples).reshape(shape)
    if predictor == HORIZONTAL:
        whole = block.view(block.dtype.str.replace("f", "u").replace("i", "u"))
        out = np.cumsum(whole, axis=1, dtype=whole.dtype).astype(whole.dtype, copy=False)
        return out & ((1 << bits) - 1) if bits < 8 else out.view(block.dtype)
    if predictor == FLOATING:
        size = block.dtype.itemsize
        planes = np.cumsum(block.view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, pixels * samples).transpose(0, 2, 1)  # most significant bytes first
        return np.ascontiguousarray(planes).view(f">f{size}").reshape(shape).astype(block.dtype)
    return block


def pages(data: bytes) -> Iterator[dict]:
    """Each image directory in turn: width, height, samples, bits, compression, predictor, layout, parts and raster
    (rows top down, pixels interleaved, samples below a byte one byte each and those of more little-endian); or, for a page that is damaged or
    of a kind that this reader does not know, its error, and the walk goes on. Raises Malformed where the walk itself cannot."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        raise Malformed("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic = struct.unpack_from(f"{order}H", data, 2)[0]
    seen = set()
    try:
        if magic == 42:
            count, entry, word, at = "H", 12, "I", struct.unpack_from(f"{order}I", data, 4)[0]
        elif magic == 43:
            count, entry, word, at = "Q", 20, "Q", struct.unpack_from(f"{order}Q", data, 8)[0]
        else:
            raise Malformed("no TIFF header")
        while at:
            if at in seen:
                raise Malformed("image directories form a ring")
            seen.add(at)
            n = struct.unpack_from(order + count, data, at)[0]
            at += struct.calcsize(order + count)
            here, at = at, struct.unpack_from(order + word, data, at + entry * n)[0]
            try:
                yield _page(data, dict(x for i in range(n) if (x := _tag(data, here + entry * i, order, word))), order)
            except (Malformed, struct.error, KeyError, IndexError, OverflowError, MemoryError) as e:
                yield {"error": f"cut short or without a needed tag: {e}" if isinstance(e, (struct.error, LookupError)) else str(e) or "too large"}
    except (struct.error, OverflowError) as e:
        raise Malformed(f"cut short: {e}") from e


def _tag(data: bytes, at: int, order: str, word: str) -> tuple[int, tuple] | None:
    """A tag that the reader knows, with its values."""
    tag, kind = struct.unpack_from(f"{order}HH", data, at)
    if tag not in _KNOWN:
        return None
    n = struct.unpack_from(order + word, data, at + 4)[0]
    field = at + 4 + struct.calcsize(order + word)
    code = _KINDS.get(kind, "B")
    if n * len(code) > len(data):
        raise Malformed(f"tag {tag} has more values than the file has bytes")
    shape = f"{order}{n}s" if code == "s" else f"{order}{n * len(code)}{code[0]}"
    if struct.calcsize(shape) > struct.calcsize(order + word):
        field = struct.unpack_from(order + word, data, field)[0]
    return tag, struct.unpack_from(shape, data, field)


def _number(tags: dict[int, tuple], tag: int, other: int | None, least: int = 0) -> int:
    value = tags.get(tag, (other,) if other is not None else ())
    if not value or not isinstance(value[0], int) or value[0] < least:
        raise Malformed(f"tag {tag} is {value[0] if value else 'missing'}")
    return value[0]


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    width, height, samples = _number(tags, WIDTH, None, 1), _number(tags, HEIGHT, None, 1), _number(tags, SAMPLES, 1, 1)
    bits, kind, how, predictor, planar = (_number(tags, t, 1) for t in (BITS, SAMPLE_FORMAT, COMPRESSION, PREDICTOR, PLANAR))
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1 or kind == 3 and bits < 16:
        raise Malformed(f"samples of {bits} bits and format {kind}")
    if how not in _RATIO:
        raise Malformed(f"compression {how}")
    if predictor not in (NO_PREDICTOR, HORIZONTAL, FLOATING) or predictor == FLOATING and kind != 3:
        raise Malformed(f"predictor {predictor} of format {kind}")
    if _number(tags, FILL_ORDER, 1) != 1:
        raise Malformed("least significant bits first")
    dtype = np.dtype(f"{order}{'f' if kind == 3 else 'i' if kind == 2 and bits >= 8 else 'u'}{max(1, bits // 8)}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        across, down = _number(tags, TILE_WIDTH, None, 1), _number(tags, TILE_HEIGHT, None, 1)
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        across, down = width, min(_number(tags, ROWS_PER_STRIP, height, 1), height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    planes = samples if planar == 2 else 1
    inner = samples // planes
    columns, rows = -(-width // across), -(-height // down)
    parts = planes * rows * columns
    if len(offsets) < parts or len(counts) < parts:
        raise Malformed("fewer parts than the image has")
    if not all(isinstance(x, int) for x in (*offsets[:parts], *counts[:parts])):
        raise Malformed("offsets that are no numbers")
    row_bytes = -(-across * inner * bits // 8)
    spans = list(zip(offsets[:parts], counts[:parts]))
    high = [down if tiled else min(down, height - k % (rows * columns) // columns * down) for k in range(parts)]
    # before anything is held: every part is in the file, and its bytes can be as many as its samples need
    for (at, n), h in zip(spans, high):
        if at < 0 or n < 0 or at + n > len(data):
            raise Malformed("a part lies beyond the file's end")
        if h * row_bytes > _RATIO[how] * (n + 8):
            raise Malformed("a part is too short")
    if width * height * samples * dtype.itemsize >= MOST_BYTES or max(high) * across * inner * dtype.itemsize >= MOST_BYTES:
        raise Malformed("more samples than a value can hold")
    raster = np.zeros((height, width, samples), dtype)
    for k, ((at, n), h) in enumerate(zip(spans, high)):
        plane, rest = divmod(k, rows * columns)
        top, left = rest // columns * down, rest % columns * across
        raw = _expand(data[at : at + n], how, h * row_bytes)
        if len(raw) < h * row_bytes:
            raise Malformed("a part is too short")
        block = _samples(raw, (h, across, inner), bits, dtype, predictor)[: height - top, : width - left]
        raster[top : top + block.shape[0], left : left + block.shape[1], plane : plane + inner] = block
    return {
        "width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor,
        "layout": "tiles" if tiled else "strips", "parts": parts,
        "raster": raster.astype(dtype.newbyteorder("<"), copy=False).tobytes(),
    }


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = HORIZONTAL, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A TIFF with one page for each image (rows x pixels, or rows x pixels x samples, of unsigned integers)."""
    squeeze = {NONE: bytes, LZW: pack_lzw, PACKBITS: pack_bits, DEFLATE: lambda b: zlib.compress(b, level), DEFLATE_OLD: lambda b: zlib.compress(b, level)}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for image in images:
        image = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None])
        height, width, samples = image.shape
        offsets, counts = [], []
        if tile:
            high, across = tile
            grid = [(t, x) for t in range(0, height, high) for x in range(0, width, across)]
        else:
            high, across = rows_per_strip, width
            grid = [(t, 0) for t in range(0, height, high)]
        for top, left in grid:
            block = image[top : top + high, left : left + across]
            if tile:
                block = np.pad(block, ((0, high - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
            if predictor == HORIZONTAL:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            raw = squeeze(block.astype(image.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        out += b"\0" * (len(out) % 2)
        tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * image.itemsize] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [across]), (TILE_HEIGHT, "I", [high]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", counts)] if tile else [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [high]), (STRIP_BYTES, "I", counts)]
        entries = []
        for tag, code, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                where, packed = len(out), packed
                out += packed
                packed = struct.pack(f"{order}I", where)
            entries.append(struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[code], len(values)) + packed.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


def payload(text: bytes) -> np.ndarray:
    """Rows of 64 samples: the text's bytes and zeros up to a positive multiple of 64."""
    size = max(64, -(-len(text) // 64) * 64)
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, 64)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = NO_PREDICTOR, level: int = 1) -> DataFrame:
    """(id, n_bytes, media) for every row: its whole text, null as empty, as one TIFF page 64 samples wide in strips
    of 1,024 rows. Rows may repeat; an empty table gives an empty result; other columns are not read."""
    kind = df.schema[id_col].dataType

    def run(batches):
        for b in batches:
            held, size, at = [], 0, 0
            raw = utf8(b.column(1))
            for i, t in enumerate(raw):
                held.append(write([payload(t)], compression, predictor, level=level))
                size += len(held[-1])
                if size > 4 << 20 or i == len(raw) - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(held)), pa.array([len(x) for x in raw[at : i + 1]], pa.int64()), pa.array(held, pa.binary())], ["id", "n_bytes", "media"])
                    held, size, at = [], 0, i + 1

    return documents_select(df, id_col, text_col).mapInArrow(task(run), f"id {kind.simpleString()}, n_bytes long, media binary")


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, layout string, parts int, mean double, deviation double, raster binary, error string"


def decode_pages(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row for every page of every file, with the columns of `keep` and those of PAGE.

    A null file has no pages. A page that is damaged or of a kind that is not known gives a row that has its page number, an `error`,
    and nulls else, and the pages after it are read; a file whose directories end in a fault gives the pages before and one such row. Nothing is
    held for samples that the file's bytes cannot give. mean and deviation are those of the samples' unsigned values. Repeated rows give repeated pages; an empty table gives an empty
    result. Batches are cut so that some MB of samples are held at once, or one page."""
    names = [x.split()[0] for x in PAGE.split(", ")]
    kinds = [pa.int32()] * 7 + [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.string()]
    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [PAGE])

    def run(batches):
        for b in batches:
            take, rows, size = [], [], 0

            def batch(b=b):
                own = [b.column(i).take(pa.array(take, pa.int64())) for i in range(len(keep))]
                return pa.RecordBatch.from_arrays(own + [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], [*keep, *names])

            for i in range(b.num_rows):
                data, page = b.column(len(keep))[i].as_py(), 0
                if data is None:
                    continue
                try:
                    for p in pages(data):
                        take.append(i)
                        if "error" in p:
                            rows.append({"page": page, **p})
                        else:
                            values = np.frombuffer(p["raster"], f"<u{max(1, p['bits'] // 8)}")
                            rows.append(p | {"page": page, "mean": float(values.mean()), "deviation": float(values.std())})
                            size += len(p["raster"])
                        page += 1
                        if size > 4 << 20:
                            yield batch()
                            take, rows, size = [], [], 0
                except Malformed as e:
                    take.append(i)
                    rows.append({"page": page, "error": str(e)})
            if rows:
                yield batch()

    return small_batches(df).select(*keep, media_col).mapInArrow(task(run), ddl)

