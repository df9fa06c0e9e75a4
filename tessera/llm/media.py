"""Media columns: motion-JPEG clips in AVI files, held in a binary column.

Payload bytes become 8-bit grey frames, each a lossless JPEG (ITU-T T.81 annex H: predictor 1,
Huffman-coded differences, one restart interval a row), in a RIFF AVI with an `idx1` index. The
reader walks the RIFF tree, finds frames through the index, and decodes all rows of all such frames
of a batch side by side, one sample of each at a time. Baseline frames, which cameras and other
writers make, are decoded one by one (see `jpeg`). Shots are cut where the grey histogram changes by
more than is usual around it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import blocks as B
from tessera.llm import jpeg
from tessera.llm import text as T

SIDE, FPS = 24, 25
FRAME = SIDE * SIDE
FRAMES_AT_ONCE = 1024
BATCH_BYTES = 4 << 20
BINS = 16
_LENGTH_OF = np.array([int(i).bit_length() for i in range(256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Difference categories 0 to 8, each with a code of four bits.
_HUFFMAN = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])


def _header(width: int, height: int) -> bytes:
    frame = _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    return b"\xff\xd8" + _segment(0xDD, struct.pack(">H", width)) + frame + _segment(0xC4, b"\0" + _HUFFMAN) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(payload: np.ndarray, width: int = SIDE, height: int = SIDE) -> list[bytes]:
    """A lossless JPEG of each width x height samples; the length must be a multiple of that."""
    head, out, size = _header(width, height), [], width * height
    for first in range(0, len(payload), FRAMES_AT_ONCE * size):
        out += _encode_rows(payload[first : first + FRAMES_AT_ONCE * size].reshape(-1, width), height, head)
    return out


def _encode_rows(rows: np.ndarray, height: int, head: bytes) -> list[bytes]:
    n, width = rows.shape
    before = np.full((n, width), 128, np.int16)
    before[:, 1:] = rows[:, :-1]
    diff = rows.astype(np.int16) - before
    size = _LENGTH_OF[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code, length = ((size << size) | extra).astype(T.U64), size + 4
    if width % 4:
        code = np.pad(code, ((0, 0), (0, -width % 4)))
        length = np.pad(length, ((0, 0), (0, -width % 4)))
    for _ in range(2):  # four neighbours to one code of at most 48 bits
        code = (code[:, ::2] << length[:, 1::2].astype(T.U64)) | code[:, 1::2]
        length = length[:, ::2] + length[:, 1::2]
    ends = np.cumsum(length, axis=1)
    n_bits = ends[:, -1]
    n_bytes = (n_bits + 7) // 8
    word = np.zeros((n, int(n_bytes.max()) // 8 + 2), T.U64)
    at = np.arange(n)
    for k in range(code.shape[1]):
        start = ends[:, k] - length[:, k]
        room = 64 - (start & 63) - length[:, k]
        fits = np.maximum(room, 0).astype(T.U64)
        over = np.maximum(-room, 0).astype(T.U64)
        word[at, start >> 6] |= (code[:, k] << fits) >> over
        rest = np.where(over > 0, code[:, k] << ((T.U64(64) - over) & T.U64(63)), T.U64(0))
        word[at, (start >> 6) + 1] |= rest
    pad = (n_bytes * 8 - n_bits).astype(T.U64)  # with ones
    last = n_bits - 1 + pad.astype(np.int64)
    word[at, last >> 6] |= ((T.U64(1) << pad) - T.U64(1)) << (63 - (last & 63)).astype(T.U64)
    raw = word.byteswap().view(np.uint8).reshape(n, -1)
    raw = np.concatenate([raw, np.zeros((n, 2), np.uint8)], axis=1)
    number = at % height
    raw[at, n_bytes] = 0xFF
    raw[at, n_bytes + 1] = np.where(number == height - 1, 0xD9, 0xD0 + number % 8)
    column = np.arange(raw.shape[1])
    flat = raw[column < (n_bytes + 2)[:, None]]
    row_end = np.cumsum(n_bytes + 2)
    stuffed = flat == 0xFF
    stuffed[row_end - 2] = False  # markers
    shift = np.cumsum(stuffed)
    out = np.zeros(len(flat) + int(shift[-1]), np.uint8)
    out[np.arange(len(flat)) + shift - stuffed] = flat
    frame_end = row_end[height - 1 :: height]
    cuts = [0, *(frame_end + shift[frame_end - 1]).tolist()]
    data = out.tobytes()
    return [head + data[a:b] for a, b in zip(cuts, cuts[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def to_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """A RIFF AVI of one motion-JPEG stream, with an index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    headers = _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movie.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + headers) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames that the index names, in its order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movie, index, at = float(FPS), 0, b"", 12
    while at + 8 <= len(data):
        name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            period = struct.unpack_from("<I", data, at + 20)[0]
            fps = 1e6 / period if period else fps
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            start = movie + offset
            if data[start : start + 4] != name:  # some writers count from the start of the file
                start = offset
            frames.append(data[start + 8 : start + 8 + size])
    return fps, frames


@lru_cache(16)
def _tables(head: bytes):
    """Width, height and the Huffman look-up by 16 bits (symbol, length) of a lossless JPEG's header."""
    at, width, height, symbol, length = 2, 0, 0, None, None
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("lossless frames must be grey and of 8 bits")
        elif marker == 0xDD and struct.unpack(">H", body)[0] != width and width:
            raise ValueError("a lossless frame's restart interval must be a row")
        elif marker == 0xC4:
            symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            code, k = 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    span = slice(code << (16 - n), (code + 1) << (16 - n))
                    symbol[span], length[span] = body[k], n
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDA and body[3] != 1:
            raise ValueError("lossless frames must have predictor 1")
        at += 2 + size
    return width, height, symbol, length


def _kind(frame: bytes) -> int:
    """The marker of a frame's coding process (0xC0 to 0xCF), 0 if there is none."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF and frame[at + 1] != 0xDA:
        if 0xC0 <= frame[at + 1] <= 0xCF and frame[at + 1] not in (0xC4, 0xC8, 0xCC):
            return frame[at + 1]
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return 0


def grey(pixels: np.ndarray) -> np.ndarray:
    """Frames of three colours as their luma; grey ones as they are."""
    return np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8) if pixels.ndim == 4 else pixels


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame, height x width (x 3 for frames in colour)."""
    out: list = [None] * len(frames)
    by_head: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        if _kind(f) != 0xC3:
            out[i] = jpeg.decode(f)
            continue
        end = f.index(b"\xff\xda")
        by_head.setdefault(f[: end + 2 + struct.unpack_from(">H", f, end + 2)[0]], []).append(i)
    for head, members in by_head.items():
        for first in range(0, len(members), FRAMES_AT_ONCE):
            some = members[first : first + FRAMES_AT_ONCE]
            for i, pixels in zip(some, _decode_rows([frames[i][len(head) :] for i in some], *_tables(head))):
                out[i] = pixels
    return out


def _decode_rows(scans: list[bytes], width: int, height: int, symbol, length) -> np.ndarray:
    raw = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD9))
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 0xFF))
    starts = np.concatenate([[0], mark[:-1] + 2])
    if len(starts) != len(scans) * height:
        raise ValueError("a frame lacks rows")
    dropped = np.cumsum(~keep)
    at = (starts - dropped[starts]) * 8
    u = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(T.U64)
    window = (u[:-4] << T.U64(32)) | (u[1:-3] << T.U64(24)) | (u[2:-2] << T.U64(16)) | (u[3:-1] << T.U64(8)) | u[4:]
    out = np.empty((width, len(at)), np.uint8)
    value = np.full(len(at), 128, np.int64)
    for x in range(width):
        bits = ((window[at >> 3] >> (8 - (at & 7)).astype(T.U64)) & T.U64(0xFFFFFFFF)).astype(np.int64)
        code = bits >> 16
        size, used = symbol[code], length[code]
        extra = (bits >> (32 - used - size)) & ((1 << size) - 1)
        value = value + np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        out[x] = value & 0xFF
        at = at + used + size
    return out.T.reshape(len(scans), height, width)


def shots(frames: np.ndarray, reach: int = 4, factor: float = 2.0, least: float = 0.2) -> list[tuple[int, int]]:
    """[first, last + 1) of each shot.

    A shot starts at a frame whose grey histogram differs from the one before by over `least` of
    the samples, and by over `factor` times the mean difference of the `reach` frames on either side.
    """
    n = len(frames)
    if n == 0:
        return []
    bins = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * bins.shape[1])
    total = np.concatenate([[0], np.cumsum(change)])
    i = np.arange(n - 1)
    lo, hi = np.maximum(i - reach, 0), np.minimum(i + reach + 1, n - 1)
    others = np.maximum(hi - lo - 1, 1)
    usual = (total[hi] - total[lo] - change) / others
    cuts = np.flatnonzero((change > least) & (change > factor * usual)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges, edges[1:]))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as an AVI of 24 x 24 grey frames.

    The bytes are followed by bytes 255 up to a positive multiple of 576, so a null or empty text
    makes one white frame. Rows stay apart, repeated ids included; other columns are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            for i, j in T.doc_slices(off, BATCH_BYTES):
                sizes = np.diff(off[i : j + 1])
                padded = np.maximum(-(-sizes // FRAME), 1) * FRAME
                ends = np.cumsum(padded)
                payload = np.full(int(ends[-1]), 255, np.uint8)
                payload[T.expand(ends - padded, sizes)] = data[off[i] : off[j]]
                frames = encode_frames(payload)
                cuts = [0, *(ends // FRAME).tolist()]
                media = [to_avi(frames[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a shot: (id, clip, first_frame, n_frames, start_s, end_s, mean_level). Null media have none.

    Frames are baseline JPEG, grey or in colour, or lossless as `store` makes them; frames of one clip
    have one size. Others are an error."""
    rows = df.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(batch.column("media")):
                fps, frames = read_avi(media.as_py())
                pixels = grey(np.array(decode_frames(frames)))
                found = shots(pixels)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("id").slice(i, 1).to_pylist() * n, batch.column("id").type),
                        pa.array(range(n), pa.int32()),
                        pa.array([a for a, _ in found], pa.int32()),
                        pa.array([b - a for a, b in found], pa.int32()),
                        pa.array([a / fps for a, _ in found], pa.float64()),
                        pa.array([b / fps for _, b in found], pa.float64()),
                        pa.array([float(pixels[a:b].mean()) for a, b in found], pa.float64()),
                    ],
                    ["id", "clip", "first_frame", "n_frames", "start_s", "end_s", "mean_level"],
                )

    return rows.mapInArrow(run, f"id {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_level double").withColumnRenamed("id", id_col)


def read_back(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored media hold: (id, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature). `feature` lists the shots as first-last frame @ start time, mean level."""
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    new = [x.split()[0] for x in added.split(", ")]
    keep = df.select(*(f"`{c}`" for c in df.columns if c not in (id_col, media_col, *new)))
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), B.folded(keep).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_bytes(batch.column("media"))
            for i, j in T.doc_slices(off, BATCH_BYTES):
                media = [data[a:b].tobytes() for a, b in zip(off[i:j], off[i + 1 : j + 1])]
                read = [read_avi(m) for m in media]
                pixels = decode_frames([f for _, frames in read for f in frames])
                at, values = 0, []
                for m, (fps, frames) in zip(media, read):
                    own = np.array(pixels[at : at + len(frames)])
                    at += len(frames)
                    payload = own.tobytes()
                    cut = shots(own)
                    level = np.add.reduceat(own.reshape(len(own), -1).sum(1, dtype=np.int64), [a for a, _ in cut]) // [(b - a) * own[0].size for a, b in cut]
                    feature = f"{len(frames)} frames, {len(cut)} shots: " + ";".join([f"{a}-{b - 1}@{a / fps:.2f}s,{v}" for (a, b), v in zip(cut, level.tolist())])
                    values.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                columns = [pa.array(c, k) for c, k in zip(zip(*values), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("row").slice(i, j - i), *columns], ["id", "row", *new])

    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(added).fields])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep.columns)), *new)
