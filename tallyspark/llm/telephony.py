"""Telephony audio columns: mu-law, A-law and ADPCM speech, held as bytes, expanded to PCM and resampled.

The 8-bit codecs expand through 256-entry lookup tables. ADPCM is decoded with numpy across blocks: a step of the loop
decodes one nibble of every block at once, so a batch takes as many steps as a block has samples. All arithmetic is on
integers, so equal bytes give equal results everywhere.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RATE, FRAME = 8000, 192
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law code: sign, 3 bits of exponent, 4 of mantissa, all inverted, with a bias of 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law code: even bits inverted, then sign, exponent and mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_steps() -> np.ndarray:
    """The 89 quantiser steps of IMA ADPCM. Fixed values."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


#: How far a nibble moves the step index. Fixed values.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8)


def adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For step index and nibble, flat at 16 * index + nibble: the change of the sample, and 16 times the next index."""
    step, nibble = adpcm_steps()[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(np.arange(89)[:, None] + np.array(INDEX_MOVES)[None, :], 0, 88)
    return np.where(nibble & 8, -change, change).ravel().astype(np.int32), (after * 16).ravel().astype(np.int32)


MULAW, ALAW = mulaw_table(), alaw_table()
CHANGE, AFTER = adpcm_moves()


def decode_adpcm(blocks: np.ndarray, lanes: int = 1 << 15) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (a row each: first sample, step index, a spare byte, then nibbles, low one first)."""
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    for at in range(0, len(blocks), lanes):
        part = np.ascontiguousarray(blocks[at : at + lanes].T)
        sample = (part[0].astype(np.int32) | part[1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
        index = np.minimum(part[2], 88).astype(np.int32) * 16
        pcm = np.empty((out.shape[1], len(sample)), np.int16)
        pcm[0] = sample
        for k in range(4, len(part)):
            for row, nibble in ((2 * k - 7, part[k] & 15), (2 * k - 6, part[k] >> 4)):
                key = index + nibble
                sample += CHANGE[key]
                np.clip(sample, -32768, 32767, out=sample)
                index = AFTER[key]
                pcm[row] = sample
        out[at : at + lanes] = pcm.T
    return out


def resampled(pcm: np.ndarray, rate: int, out: int) -> np.ndarray:
    """PCM at `rate` brought to `out`: the same, half of it (means of pairs) or twice (linear, the last sample is held)."""
    if out == rate:
        return pcm
    if 2 * out == rate:
        pairs = np.append(pcm, pcm[-1:] if len(pcm) % 2 else pcm[:0]).reshape(-1, 2).astype(np.int32)
        return (pairs.sum(axis=1) >> 1).astype(np.int16)
    if out != 2 * rate:
        raise ValueError("the rate can be kept, halved or doubled")
    made = np.empty(2 * len(pcm), np.int16)
    made[::2] = pcm
    made[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    made[-1:] = pcm[-1:]
    return made


def between(even: np.ndarray) -> np.ndarray:
    """What linear interpolation puts after each sample: the mean with the next; the last is held."""
    return (even.astype(np.int32) + np.append(even[1:], even[-1:]) >> 1).astype(np.int16)


def folded(pcm: np.ndarray, rate: int) -> bytes:
    """PCM as it is stored. Above RATE: the number of samples, every other one, then how far those between are from the
    means of their neighbours, without zeros at the end."""
    if rate <= RATE:
        return pcm.astype("<i2").tobytes()
    off = pcm[1::2] - between(pcm[::2])
    used = int(np.flatnonzero(off).max(initial=-1)) + 1
    return struct.pack("<I", len(pcm)) + pcm[::2].astype("<i2").tobytes() + off[:used].astype("<i2").tobytes()


def unfolded(body: bytes, rate: int) -> np.ndarray:
    """The PCM of stored bytes."""
    if rate <= RATE:
        return np.frombuffer(body, "<i2")
    pcm = np.empty(struct.unpack_from("<I", body)[0], np.int16)
    raw = np.frombuffer(body, "<i2", offset=4)
    pcm[::2] = raw[: len(pcm) // 2]
    pcm[1::2] = between(pcm[::2])
    pcm[1::2][: len(raw) - len(pcm) // 2] += raw[len(pcm) // 2 :]
    return pcm


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file around mono codes of `codec`."""
    align, bits = (FRAME, 4) if codec == "adpcm" else (1, 8)
    extra = struct.pack("<HH", 2, 2 * (FRAME - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    per_second = rate * FRAME // (2 * (FRAME - 4) + 1) if codec == "adpcm" else rate
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, per_second, align, bits) + extra
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_codes(media: bytes) -> tuple[str, bytes]:
    """Codec and codes of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = {v: k for k, v in FORMATS.items()}[struct.unpack_from("<H", media, at + 8)[0]]
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def expand(codec: str, codes: bytes) -> np.ndarray:
    """PCM of stored codes at the stored rate. ADPCM needs whole blocks of FRAME bytes."""
    raw = np.frombuffer(codes, np.uint8)
    if codec == "adpcm":
        return decode_adpcm(raw.reshape(-1, FRAME)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def padded(payload: bytes) -> bytes:
    """The payload with spaces up to a positive multiple of FRAME bytes."""
    return payload + b" " * (FRAME - len(payload) % FRAME if len(payload) % FRAME or not payload else 0)


def summary(pcm: np.ndarray) -> str:
    """Peak, mean power and zero crossings of a signal, as integers."""
    wide = pcm.astype(np.int64)
    return f"{int(np.abs(wide).max(initial=0))}:{int(wide @ wide) // max(1, len(wide))}:{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


#: Zstandard's level for stored media: samples restate the codes, and a higher level finds more of it.
LEVEL = 12
#: Bytes of payload that are handled together, so that a worker's memory follows neither the batch nor the rows.
TOGETHER = 2_000_000


def in_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about TOGETHER bytes in a column; a longer value is a slice by itself."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        while begin < len(size):
            many = max(1, int(np.searchsorted(np.cumsum(size[begin:]), TOGETHER, "right")))
            yield batch.slice(begin, many)
            begin += many


def decoded(codec: str, codes: list[bytes]) -> list[np.ndarray]:
    """PCM of many files' codes; ADPCM blocks of all files are decoded together."""
    if codec != "adpcm":
        return [expand(codec, x) for x in codes]
    ends = np.cumsum([len(x) // FRAME for x in codes])
    pcm = decode_adpcm(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, FRAME))
    return [pcm[end - len(x) // FRAME : end].ravel() for x, end in zip(codes, ends, strict=True)]


def store_media(df: DataFrame, key: str, payload: str, codec: str = "mulaw", rate: int = 2 * RATE, name: str = "media") -> DataFrame:
    """Store each binary `payload` as a WAV file of `codec`, with its PCM at `rate`, in a Parquet table; give it back.

    key, n_bytes (before padding), media, pcm (little-endian 16-bit samples, see folded). A null payload is stored as
    an empty one; both become one frame of spaces. The table lies in the shared folder, under `name`.
    """
    kind = df.schema[key].dataType

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            codes = [padded(x) for x in raw]
            media = pa.array([wav(x, codec) for x in codes], pa.binary())
            pcm = pa.array([folded(resampled(x, RATE, rate), rate) for x in decoded(codec, codes)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), media, pcm], ["key", "n_bytes", "media", "pcm"])

    made = df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInArrow(put, f"key {kind.simpleString()}, n_bytes long, media binary, pcm binary")
    return stored(made.withColumnRenamed("key", key), name, "zstd", LEVEL)


def read_media(df: DataFrame, media: str = "media", pcm: str = "pcm", rate: int = 2 * RATE) -> DataFrame:
    """Open stored files: the columns of `df` besides `media` and `pcm`, the codes read back, their digests, and features.

    feature: for the stored PCM, and for the codes taken as each of the other two codecs, peak, mean power and zero
    crossings, with the CRC-32 of the PCM. A file whose PCM isn't what its codes give at `rate` raises.
    """
    keep = [x for x in df.columns if x not in (media, pcm)]
    n = len(keep)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, n):
            rows = []
            files, sounds = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            opened = [wav_codes(x) for x in files]
            speech = decoded("adpcm", [codes for _, codes in opened])
            for (codec, codes), file, sound, own in zip(opened, files, sounds, speech, strict=True):
                signals = {"mulaw": None, "alaw": None, "adpcm": own}
                signals.update({c: expand(c, codes) for c in ("mulaw", "alaw")})
                loud = unfolded(sound, rate)
                if not np.array_equal(loud, resampled(signals[codec], RATE, rate)):
                    raise ValueError("stored samples do not belong to the stored codes")
                text = f"{codec} {summary(loud)} {zlib.crc32(loud.astype("<i2").tobytes())}" + "".join(f" {c} {summary(s)}" for c, s in signals.items() if c != codec)
                rows.append((len(codes), hashlib.sha256(codes).hexdigest(), zlib.crc32(codes[-16:]), len(file), hashlib.sha256(file).hexdigest(), text))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    out = f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(*keep, media, pcm).mapInArrow(get, out)


def text_media(docs: DataFrame, codec: str = "mulaw", rate: int = 2 * RATE) -> DataFrame:
    """Every text of `docs` as UTF-8 in a telephony file with PCM at `rate`, and what is read back from both.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null or empty
    text is one frame of spaces; repeated rows give repeated results; an empty table gives an empty one.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    return read_media(store_media(held, "doc_id", "payload", codec, rate), rate=rate)
