"""FLAC media columns: mono, 8 bits a sample, written and read in numpy, many frames at once.

Writing: the samples are cut into blocks; every block becomes a frame with a constant, verbatim, fixed-predictor or
quantised linear-predictor subframe, whichever is estimated smallest, with Rice-coded residuals. A stream begins with
STREAMINFO (with the MD5 of its samples) and a SEEKTABLE with the sample and byte offset of every frame.

Reading: frames are found through the seek table, their header and footer checksums (CRC-8, CRC-16) are verified, and the
Rice codes of all frames of a batch are decoded in step, one residual of every frame at a time; prediction runs in step
the same way. The result is PCM blocks with their sample offsets; the stream's MD5 is verified at the end.

The choices of the writer depend on the block alone (integer sums and element-wise arithmetic), so equal samples give
equal bytes wherever they are.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK, ORDER, PRECISION, PARTITIONS, RATE = 1024, 4, 12, 2, 8000
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32
#: Coefficients of the fixed predictors by order.
FIXED_PREDICTORS = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Samples decoded at once; a longer stream is a batch of its own.
BATCH_SAMPLES = 2_000_000


@functools.cache
def crc_table(bits: int, polynomial: int) -> np.ndarray:
    top, mask = 1 << bits - 1, (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << bits - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


@functools.cache
def crc16_pairs() -> np.ndarray:
    """CRC-16 of every pair of bytes."""
    one = crc_table(16, 0x8005)
    pair = np.arange(65536, dtype=np.uint32)
    first = one[pair >> 8]
    return (first << 8 & 0xFFFF) ^ one[(first >> 8) ^ (pair & 0xFF)]


def crc8(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    table, crc = crc_table(8, 0x07), np.zeros(len(start), np.uint32)
    for i in range(int(size.max(initial=0))):
        on = i < size
        crc[on] = table[crc[on] ^ data[start[on] + i]]
    return crc


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of spans of the data, all in step, two bytes at a time."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    pairs, one = crc16_pairs(), crc_table(16, 0x8005)
    both = data[:-1].astype(np.uint32) << 8 | data[1:] if len(data) > 1 else np.zeros(1, np.uint32)
    crc, half = np.zeros(len(start), np.uint32), size // 2
    on = len(start)
    for i in range(int(half.max(initial=0))):
        while half[on - 1] <= i:
            on -= 1
        crc[:on] = pairs[crc[:on] ^ both[start[:on] + 2 * i]]
    odd = np.flatnonzero(size % 2)
    crc[odd] = (crc[odd] << 8 & 0xFFFF) ^ one[(crc[odd] >> 8) ^ data[start[odd] + size[odd] - 1]]
    out = np.empty(len(crc), np.uint32)
    out[order] = crc
    return out


def pack_fields(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes of these fields, highest bit first; a value below 2^32 may have any width, zeros in front. Whole bytes in all."""
    end = np.cumsum(width)
    word = (end - 1 >> 6).astype(np.int64)
    shift = (63 - (end - 1 & 63)).astype(np.uint64)
    words = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
    for part, at in ((value << shift, word), (np.where(shift > 0, value >> np.minimum(np.uint64(64) - shift, np.uint64(63)), 0), word - 1)):
        there = part != 0
        part, at = part[there], at[there]
        if len(at):
            head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            words[at[head]] |= np.bitwise_or.reduceat(part, head)
    return words.astype(">u8").view(np.uint8)[: int(end[-1]) // 8]


def frame_numbers(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 manner, and their bits (numbers below 2^21)."""
    n = number.astype(np.uint64)
    six = lambda k: 0x80 | n >> np.uint64(6 * k) & np.uint64(0x3F)
    two = (0xC0 | n >> np.uint64(6)) << np.uint64(8) | six(0)
    three = (0xE0 | n >> np.uint64(12)) << np.uint64(16) | six(1) << np.uint64(8) | six(0)
    four = (0xF0 | n >> np.uint64(18)) << np.uint64(24) | six(2) << np.uint64(16) | six(1) << np.uint64(8) | six(0)
    size = 8 * (1 + (number >= 0x80) + (number >= 0x800) + (number >= 0x10000))
    return np.select([size == 8, size == 16, size == 24], [n, two, three], four), size


def linear_predictors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of each row (Levinson and Durbin on integer autocorrelations)."""
    n = block.shape[1]
    auto = np.stack([(block[:, : n - k] * block[:, k:]).sum(1) for k in range(ORDER + 1)], 1).astype(np.float64)
    error = np.where(auto[:, 0] > 0, auto[:, 0], 1.0) * (1 + 1e-9)
    coef = np.zeros((len(block), ORDER))
    for i in range(ORDER):
        reach = auto[:, i + 1].copy()
        for j in range(i):
            reach = reach - coef[:, j] * auto[:, i - j]
        turn = np.clip(reach / error, -0.9999, 0.9999)
        old = coef.copy()
        for j in range(i):
            coef[:, j] = old[:, j] - turn * old[:, i - 1 - j]
        coef[:, i] = turn
        error = np.maximum(error * (1 - turn * turn), 1e-9)
    top = np.maximum(np.abs(coef).max(1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.frexp(top)[1], 0, 15)
    most = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(coef * (1 << shift)[:, None]), -most, most).astype(np.int64), shift.astype(np.int64)


def predicted(block: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of each row after the first coef.shape[1] samples."""
    order, n = coef.shape[1], block.shape[1]
    total = np.zeros((len(block), n - order), np.int64)
    for j in range(order):
        total += coef[:, j : j + 1] * block[:, order - 1 - j : n - 1 - j]
    return block[:, order:] - (total >> shift[:, None])


def _rice(residual: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag residuals padded in front to whole blocks, Rice parameters by partition, and estimated bits."""
    zigzag = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    whole = np.concatenate((np.zeros((len(zigzag), order), np.int64), zigzag), 1)
    total = whole.reshape(len(zigzag), 1 << PARTITIONS, -1).sum(2)
    count = size >> PARTITIONS
    bits = np.stack([count * (1 + k) + (total >> k) for k in range(13)])
    return whole, bits.argmin(0), bits.min(0).sum(1)


def encode_blocks(block: np.ndarray, number: np.ndarray) -> list[bytes]:
    """The frames of blocks (rows, equally long, a multiple of 64 samples) with these frame numbers."""
    block, size = block.astype(np.int64), block.shape[1]
    coef, shift = linear_predictors(block)
    tries = [(FIXED + p, np.tile(np.array(FIXED_PREDICTORS[p], np.int64), (len(block), 1)), np.zeros(len(block), np.int64)) for p in (0, 1, 2)] + [(LPC + ORDER - 1, coef, shift)]
    coded, cost = [], [np.full(len(block), 8 * size)]
    for kind, c, s in tries:
        order = c.shape[1]
        zigzag, rice, bits = _rice(predicted(block, c, s), order, size)
        coded.append((kind, c, s, zigzag, rice))
        cost.append(bits + 8 * order + (ORDER * PRECISION + 9 if kind >= LPC else 0) + 26)
    pick = np.stack(cost).argmin(0)
    pick[(block == block[:, :1]).all(1)] = len(cost)
    out: list[bytes] = [b""] * len(block)
    for p in np.unique(pick).tolist():
        row = np.flatnonzero(pick == p)
        numbers, width = frame_numbers(number[row])
        fields = [(np.full(len(row), 0xFFF87402), 32), (numbers, width), (np.full(len(row), size - 1), 16), (np.zeros(len(row)), 8)]
        if p == 0:
            fields += [(np.full(len(row), VERBATIM << 1), 8), (block[row] & 0xFF, 8)]
        elif p == len(cost):
            fields += [(np.full(len(row), CONSTANT << 1), 8), (block[row, :1] & 0xFF, 8)]
        else:
            kind, c, s, zigzag, rice = coded[p - 1]
            order = c.shape[1]
            fields += [(np.full(len(row), kind << 1), 8), (block[row, :order] & 0xFF, 8)]
            if kind >= LPC:
                fields += [(np.full(len(row), PRECISION - 1), 4), (s[row], 5), (c[row] & (1 << PRECISION) - 1, PRECISION)]
            fields += [(np.full(len(row), PARTITIONS), 6)]
            z, k = zigzag[row].reshape(len(row), 1 << PARTITIONS, -1), rice[row][:, :, None]
            code, wide = 1 << k | z & (1 << k) - 1, (z >> k) + 1 + k
            code, wide = np.concatenate((rice[row][:, :, None], code), 2), np.concatenate((np.full(k.shape, 4), wide), 2)
            code, wide = code.reshape(len(row), -1), wide.reshape(len(row), -1)
            wide[:, 1 : 1 + order] = 0
            code[:, 1 : 1 + order] = 0
            fields += [(code, wide)]
        values = np.concatenate([np.asarray(v).reshape(len(row), -1).astype(np.uint64) for v, _ in fields], 1)
        widths = np.concatenate([np.broadcast_to(np.asarray(w).reshape(-1, 1) if np.ndim(w) == 1 else w, np.asarray(v).reshape(len(row), -1).shape) for v, w in fields], 1).astype(np.int64)
        pad = -widths.sum(1) % 8
        values = np.concatenate((values, np.zeros((len(row), 2), np.uint64)), 1)
        widths = np.concatenate((widths, pad[:, None], np.full((len(row), 1), 16)), 1)
        data = pack_fields(values.ravel(), widths.ravel()).copy()
        length = widths.sum(1) // 8
        start = np.cumsum(length) - length
        head = 6 + width // 8
        data[start + head] = crc8(data, start, head)
        crc = crc16(data, start, length - 2)
        data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 0xFF
        whole = data.tobytes()
        for r, a, n in zip(row.tolist(), start.tolist(), length.tolist()):
            out[r] = whole[a : a + n]
    return out


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (a positive multiple of 64 bytes), byte b as sample b-128."""
    blocks: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for k in range(0, len(p), BLOCK):
            blocks.setdefault(min(BLOCK, len(p) - k), []).append((i, k))
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    for size, places in blocks.items():
        for at in range(0, len(places), 1024):
            some = places[at : at + 1024]
            samples = np.frombuffer(b"".join([payloads[i][k : k + size] for i, k in some]), np.uint8).reshape(len(some), size).astype(np.int16) - 128
            for (i, k), frame in zip(some, encode_blocks(samples, np.array([k // BLOCK for _, k in some]))):
                frames[i][k] = frame
    out = []
    for p, by in zip(payloads, frames):
        order = sorted(by)
        sizes = [len(by[k]) for k in order]
        seek, offset = [], 0
        for k, n in zip(order, sizes):
            seek.append(struct.pack(">QQH", k, offset, min(BLOCK, len(p) - k)))
            offset += n
        md5 = hashlib.md5(bytes(p).translate(_SIGNED)).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join([by[k] for k in order]))
    return out


#: Byte b to the two's complement byte of sample b-128.
_SIGNED = bytes(b ^ 0x80 for b in range(256))


class FlacError(ValueError):
    """A stream that is not what this reader takes, or whose checksums fail."""


def _metadata(data: bytes) -> tuple[bytes, int, list[tuple[int, int, int]], int]:
    """MD5, samples, seek points (sample, offset, samples) and where the frames begin."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, last, md5, total, points = 4, False, b"", 0, []
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [struct.unpack_from(">QQH", body, k) for k in range(0, size, 18)]
        at += 4 + size
    if [p[0] for p in points] != [0, *itertools.accumulate(p[2] for p in points)][: len(points)]:
        raise FlacError("the seek table has gaps")
    return md5, total, points, at


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The samples (int16, -128 to 127) of every stream; raises FlacError if a checksum fails."""
    meta = [_metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
    start = np.array([base[i] + m[3] + p[1] for i, m in enumerate(meta) for p in m[2]], np.int64)
    size = np.array([p[2] for m in meta for p in m[2]], np.int64)
    stop = np.array([e for i, m in enumerate(meta) for e in [*(base[i] + m[3] + p[1] for p in m[2][1:]), base[i + 1]][: len(m[2])]], np.int64)
    if (crc16(data, start, stop - start - 2) != data[stop - 2].astype(np.uint32) * 256 + data[stop - 1]).any():
        raise FlacError("a frame's CRC-16 fails")
    lead = data[start + 4]
    coded = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    head = 6 + coded
    fixed = (data[start].astype(np.uint32) << 24) | (data[start + 1].astype(np.uint32) << 16) | (data[start + 2].astype(np.uint32) << 8) | data[start + 3]
    if (fixed != 0xFFF87402).any() or (crc8(data, start, head) != data[start + head]).any():
        raise FlacError("a frame header's CRC-8 fails, or it isn't 8-bit mono")
    order = np.argsort(-size, kind="stable")
    samples = _decode_frames(data, start[order] + head[order] + 1, size[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out, k = [], 0
    for md5, total, points, _ in meta:
        x = np.concatenate([samples[place[k + j], : p[2]] for j, p in enumerate(points)]) if points else np.empty(0, np.int16)
        k += len(points)
        if len(x) != total or hashlib.md5(x.astype(np.int8).tobytes()).digest() != md5:
            raise FlacError("a stream's MD5 fails")
        out.append(x)
    return out


def _decode_frames(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples by frame (rows); at: where each subframe begins; size: samples, falling."""
    out = np.zeros((len(at), int(size.max(initial=0))), np.int32)
    kind = (data[at] >> 1).astype(np.int64)
    for r in np.flatnonzero(kind == VERBATIM).tolist():
        out[r, : size[r]] = data[at[r] + 1 : at[r] + 1 + size[r]].view(np.int8)
    flat = np.flatnonzero(kind == CONSTANT)
    out[flat] = data[at[flat] + 1].view(np.int8)[:, None]
    row = np.flatnonzero(kind >= FIXED)
    if not len(row):
        return out.astype(np.int16)
    window = np.zeros(len(data) - 8, np.uint64)
    for j in range(8):
        window |= data[j : len(data) - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    pos, kind, size = 8 * (at[row] + 1), kind[row], size[row]

    def take(bits: np.ndarray | int, on) -> np.ndarray:
        w = window[pos[on] >> 3] << (pos[on] & 7).astype(np.uint64) >> np.asarray(64 - bits).astype(np.uint64)
        pos[on] += bits
        return w.astype(np.int64)

    order = np.where(kind >= LPC, kind - LPC + 1, kind - FIXED)
    most = int(order.max(initial=0))
    x = np.zeros((most + int(size[0]), len(row)), np.int64)  # a sample of all frames lies together; the first rows stay zero
    for i in range(most):
        on = np.flatnonzero(order > i)
        v = take(8, on)
        x[most + i, on] = v - (v >> 7 << 8)
    coef, shift = np.zeros((most, len(row)), np.int64), np.zeros(len(row), np.int64)
    for p in range(1, 5):
        for j, c in enumerate(FIXED_PREDICTORS[p]):
            coef[j : j + 1, kind == FIXED + p] = c
    lpc = np.flatnonzero(kind >= LPC)
    if len(lpc):
        wide = take(4, lpc) + 1
        shift[lpc] = take(5, lpc)
        for j in range(most):
            on = np.flatnonzero(order[lpc] > j)
            v = take(wide[on], lpc[on])
            coef[j, lpc[on]] = v - (v >> wide[on] - 1 << wide[on])
    head = take(6, np.arange(len(row)))
    if (head >> 4).any():
        raise FlacError("residuals with 5-bit parameters")
    span = size >> (head & 15)
    rice = np.zeros(len(row), np.int64)
    live = len(row)
    least = int(np.gcd.reduce(span))
    for i in range(int(size[0])):
        while size[live - 1] <= i:
            live -= 1
        if i % least == 0:
            on = np.flatnonzero(i % span[:live] == 0)
            rice[on] = take(4, on)
            if (rice[on] == 15).any():
                raise FlacError("escaped partitions")
        on = slice(0, live) if i >= most else np.flatnonzero(order[:live] <= i)
        p, k = pos[on], rice[on]
        high = (window[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(11)
        zeros = 52 - ((high.astype(np.float64).view(np.int64) >> 52) - 1023)
        if not high.all():
            for r in np.flatnonzero(high == 0).tolist():
                q = 0
                while not data[int(p[r]) + q >> 3] >> 7 - (int(p[r]) + q & 7) & 1:
                    q += 1
                zeros[r] = q
        p = p + zeros + 1
        low = (window[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(32) >> (32 - k).astype(np.uint64)
        pos[on] = p + k
        z = zeros << k | low.astype(np.int64)
        total = np.zeros(len(z), np.int64)
        for j in range(most):
            total += coef[j, on] * x[most + i - 1 - j, on]
        x[most + i, on] = (z >> 1 ^ -(z & 1)) + (total >> shift[on])
    out[row, : int(size[0])] = x[most:].T
    return out.astype(np.int16)


def pcm_blocks(stream: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Sample offset and samples of each block of a stream, by its seek table."""
    samples = decode_streams([stream])[0]
    for first, _, n in _metadata(stream)[2]:
        yield first, samples[first : first + n]


def payload(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty) with zeros up to a positive multiple of 64 bytes."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def _in_batches(sizes: list[int], most: int = BATCH_SAMPLES) -> Iterator[slice]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def flac_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (before padding) and media (a FLAC stream of the text's bytes) of every row.

    Null and empty texts are 64 zero bytes; repeated rows give equal bytes; an empty table gives an empty one; other
    columns are left out.
    """

    def run(frames):
        for frame in frames:
            texts = frame[text_col].tolist()
            data = [payload(t) for t in texts]
            for s in _in_batches([len(d) for d in data]):
                yield pd.DataFrame({id_col: frame[id_col].iloc[s], "n_bytes": [len((t or "").encode("utf-8")) for t in texts[s]], "media": encode_streams(data[s])})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def features(samples: np.ndarray) -> str:
    """Peak, mean, root mean square and zero crossings of the samples."""
    x = samples.astype(np.int64)
    return f"peak={int(np.abs(x).max())};mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def flac_decode(media: DataFrame, keep: list[str], id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, the columns to keep (long), payload (the bytes read back), media_bytes, media_sha256, feature of every row.

    A null media column gives null in all of them; a damaged stream stops the job with FlacError.
    """

    def run(frames):
        for frame in frames:
            there = frame[frame[media_col].notna()]
            for s in _in_batches([4 * len(m) // 3 for m in there[media_col]]):
                part = there.iloc[s]
                found = decode_streams([bytes(m) for m in part[media_col]])
                yield pd.DataFrame(
                    {id_col: part[id_col]}
                    | {c: part[c] for c in keep}
                    | {"payload": [(x + 128).astype(np.uint8).tobytes() for x in found], "media_bytes": [len(m) for m in part[media_col]], "media_sha256": [hashlib.sha256(m).hexdigest() for m in part[media_col]], "feature": [features(x) for x in found]}
                )
            none = frame[frame[media_col].isna()]
            if len(none):
                yield pd.DataFrame({id_col: none[id_col]} | {c: none[c] for c in keep} | dict.fromkeys(("payload", "media_bytes", "media_sha256", "feature")))

    kind = media.schema[id_col].dataType.simpleString()
    kept = "".join(f"`{c}` long, " for c in keep)
    return media.select(id_col, *keep, media_col).mapInPandas(run, f"`{id_col}` {kind}, {kept}payload binary, media_bytes long, media_sha256 string, feature string")
