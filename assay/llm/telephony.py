"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM.

``store_payloads`` puts bytes, as they are, into the data chunk of a WAVE file of 8-bit samples (format 7, mu-law, unless
another is asked for); ``read_payload`` takes them out of the stored file again. ``decode`` turns stored audio into 16-bit
PCM at another rate. The codes 7F and FF of mu-law are both silence, so PCM alone could not give the bytes back: what is
stored is the file, and PCM is made from it.

Null texts are empty; empty payloads are padded to one unit. Equal texts give equal rows; every row of docs gets one.
Tails of ADPCM that don't fill a block are not decoded. Whole texts of any length are stored; a batch holds at most about
``arrow.maxRecordsPerBatch`` texts. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import id_text, saved, ship, text_of, with_id

MULAW, ALAW, IMA = 7, 6, 17
RATE = 8000
#: The step sizes and index changes of IMA ADPCM.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


@lru_cache
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache
def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and nibble: the signed change of the sample, and the next index."""
    step, nibble = IMA_STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -size, size).astype(np.int32)
    follow = np.clip(np.arange(89)[:, None] + IMA_MOVES[nibble & 7], 0, 88).astype(np.int32) * 16
    return change.ravel(), follow.ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(blocks, block bytes) of uint8 to (blocks, samples) of int16: one step for each place in a block, for all blocks."""
    n, width = blocks.shape
    change, follow = ima_tables()
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(width - 4):
        for j, nibble in ((1, data[i] & 15), (2, data[i] >> 4)):
            key = index + nibble
            value += change[key]
            np.clip(value, -32768, 32767, out=value)
            index = follow[key]
            out[2 * i + j] = value
    return out.T


@lru_cache
def sinc_phases(up: int, down: int, reach: int) -> np.ndarray:
    """Windowed-sinc taps for each of ``up`` places between samples."""
    cut = min(1.0, up / down)
    taps = np.arange(-reach + 1, reach + 1)[None, :] - np.arange(up)[:, None] / up
    window = 0.5 + 0.5 * np.cos(np.pi * np.clip(taps / reach, -1, 1))
    out = cut * np.sinc(cut * taps) * window
    return (out / out.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate: int, to: int, reach: int = 6) -> np.ndarray:
    """int16 samples at another rate; places beyond the ends count as silence."""
    if rate == to or not len(pcm):
        return pcm
    ratio = Fraction(to, rate)
    up, down = ratio.numerator, ratio.denominator
    n = -(-len(pcm) * up // down)
    at = np.arange(n, dtype=np.int64) * down
    whole, phase = at // up, at % up
    padded = np.zeros(len(pcm) + 2 * reach, np.float32)
    padded[reach : reach + len(pcm)] = pcm
    out = np.empty(n, np.float32)
    phases = sinc_phases(up, down, reach)
    for p in range(up):
        rows = np.flatnonzero(phase == p) if down > 1 else slice(p, None, up)
        base = whole[rows]
        if up > 1 and p == 0 and up >= down:
            out[rows] = padded[base + reach]
        elif down == 1:
            out[rows] = np.correlate(padded[1:], phases[p], "valid")[: len(base)]
        else:
            out[rows] = sum(padded[base + 1 + k] * phases[p, k] for k in range(2 * reach))
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def wave_file(payload: bytes, kind: int = MULAW, rate: int = RATE, block: int = 36) -> bytes:
    """A mono WAVE file with payload as its data chunk."""
    align, bits, extra = (block, 4, struct.pack("<H", 2 * (block - 4) + 1)) if kind == IMA else (1, 8, b"")
    speed = rate if kind != IMA else rate * block // (2 * (block - 4) + 1)
    form = struct.pack("<HHIIHHH", kind, 1, rate, speed, align, bits, len(extra)) + extra
    odd = b"\0" * (len(payload) & 1)
    return b"".join([b"RIFF", struct.pack("<I", 20 + len(form) + len(payload) + len(odd)), b"WAVEfmt ", struct.pack("<I", len(form)), form, b"data", struct.pack("<I", len(payload)), payload, odd])


def read_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format, rate, block, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    view, at, form = memoryview(media), 12, (0, 0, 1)
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            form = (kind, rate, block)
        elif name == b"data":
            return *form, view[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def to_pcm(kind: int, block: int, data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if kind == IMA:
        return decode_ima(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    return (mulaw_table() if kind == MULAW else alaw_table())[raw]


def features(pcm: np.ndarray) -> str:
    """Samples, root mean square, peak and zero crossings."""
    if not len(pcm):
        return "0:0.0:0:0"
    wide = pcm.astype(np.float32)
    sign = pcm < 0
    return f"{len(pcm)}:{float(np.sqrt(np.dot(wide, wide) / len(pcm))):.1f}:{int(np.abs(wide).max())}:{int(np.count_nonzero(sign[1:] != sign[:-1]))}"


def store_payloads(docs: DataFrame, unit: int = 576, kind: int = MULAW, rate: int = RATE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled with 255 to a positive multiple of unit, as a WAVE file."""
    ship(docs.sparkSession)
    own = docs.select(id_text(id_column).alias("doc_id"), text_of(text_column).alias("text"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                raw = [t.encode() for t in part["text"]]
                media = [wave_file(x + b"\xff" * (-len(x) % unit if x else unit), kind, rate) for x in raw]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": np.array([len(x) for x in raw], np.int64), "media": media})

    return with_id(own.mapInPandas(put, "doc_id string, n_bytes long, media binary"), "doc_id")


def decode(stored: DataFrame, to_rate: int = 16_000, media_column: str = "media") -> DataFrame:
    """stored with pcm (16-bit little-endian, mono, at to_rate) in place of media."""
    ship(stored.sparkSession)
    others = [f for f in stored.schema.fields if f.name != media_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pcm = []
            for media in batch[media_column]:
                kind, rate, block, data = read_wave(media)
                pcm.append(resample(to_pcm(kind, block, data), rate, to_rate).astype("<i2").tobytes())
            yield batch.drop(columns=media_column).assign(pcm=pcm)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return stored.mapInPandas(run, f"{schema}, pcm binary")


def describe(stored: DataFrame, to_rate: int = 16_000, block: int = 36) -> DataFrame:
    """Digests of payload and stored form, and a feature of each decoding: the payload, resampled, as mu-law, as A-law, and
    as blocks of IMA ADPCM (these of all rows of a batch are decoded together)."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                yield look(batch.iloc[at : at + 500])

    def look(part: pd.DataFrame) -> pd.DataFrame:
        data, out = [], []
        for media in part["media"]:
            data.append(read_wave(media))
        raw = [np.frombuffer(x[3], np.uint8) for x in data]
        whole = [len(x) // block for x in raw]
        flat = np.concatenate([x[: n * block] for x, n in zip(raw, whole, strict=True)]).reshape(-1, block)
        ima = np.concatenate([decode_ima(flat[i : i + 16_384]) for i in range(0, len(flat), 16_384)]) if len(flat) else np.zeros((0, 1), np.int16)
        first = 0
        for media, (_, rate, _, payload), samples, n in zip(part["media"], data, raw, whole, strict=True):
            said = [features(resample(x, rate, to_rate)) for x in (mulaw_table()[samples], alaw_table()[samples])]
            said.append(features(ima[first : first + n].ravel()))
            first += n
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), "mulaw={} alaw={} ima={}".format(*said)))
        columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pd.concat([part[["doc_id", "n_bytes"]].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    own = stored.select(id_text("doc_id").alias("doc_id"), "n_bytes", "media")
    return with_id(own.mapInPandas(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"), "doc_id")


def media_table(docs: DataFrame) -> DataFrame:
    """Stores all texts as audio, reads them back and describes them."""
    return describe(saved(store_payloads(docs), "media"))
