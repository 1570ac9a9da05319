"""Media columns as MPEG transport streams.

A payload is stored as 8-bit samples in an MPEG-2 transport stream: a program association table, a
program map table, then packetised elementary stream (PES) packets of whole 576-sample frames, each
with a presentation timestamp and a random-access point. Reading goes the other way: parse the
tables, check the continuity counters, reassemble the PES packets and list timestamps and access
points. It also takes streams from elsewhere: several programs and streams, tables of any number of sections and
packets, packets sent twice or without payload, announced jumps and PES packets of unknown length. Everything happens row by row inside Arrow batches; there is no shuffle.

Defined cases: a null or empty text becomes one frame of padding; long texts are split over many PES
packets; equal texts give equal streams; an empty table gives an empty result; extra columns are
dropped except ``id_col``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FRAME, FRAMES_PER_PES, PSI_EVERY = 576, 16, 8
PACKET, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 188, 0x1000, 0x0100, 0x06, 0xBD
TICKS_PER_FRAME = 1080  # 576 samples at 48 kHz on the 90 kHz clock


@lru_cache(None)
def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        out.append(crc & 0xFFFFFFFF)
    return tuple(out)


def crc_mpeg(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@lru_cache(None)
def _psi(cc: int) -> bytes:
    """A PAT packet and a PMT packet with continuity counter ``cc``."""
    pat = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
    es = bytes([STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0])
    pmt = _section(0x02, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]) + es)
    out = b""
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        head = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10 | cc & 15, 0])
        out += (head + section).ljust(PACKET, b"\xff")
    return out


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _pcr_bytes(base: int) -> bytes:
    return bytes([(base >> 25) & 0xFF, (base >> 17) & 0xFF, (base >> 9) & 0xFF, (base >> 1) & 0xFF, (base & 1) << 7 | 0x7E, 0])


def _pes(data: bytes, pts: int, cc: int) -> tuple[np.ndarray, int]:
    """Transport packets of one PES packet, and the next continuity counter."""
    pts &= (1 << 33) - 1
    body = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
    n = 1 + max(0, -(-(len(body) - 176) // 184))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | (cc + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4:12] = np.frombuffer(b"\x07\x50" + _pcr_bytes(pts), np.uint8)
    raw = np.frombuffer(body, np.uint8)
    if n == 1:  # stuffing follows the clock reference in the same adaptation field
        out[0, 4] = 183 - len(raw)
        out[0, PACKET - len(raw) :] = raw
        return out, cc + n
    out[0, 12:] = raw[:176]
    full = (n - 2) * 184
    out[1 : n - 1, 4:] = raw[176 : 176 + full].reshape(-1, 184)
    tail = raw[176 + full :]
    if len(tail) < 184:
        out[n - 1, 3] |= 0x20
        out[n - 1, 4] = 183 - len(tail)
        if len(tail) < 183:
            out[n - 1, 5] = 0
    out[n - 1, PACKET - len(tail) :] = tail
    return out, cc + n


def mux(payload: bytes) -> bytes:
    """Transport stream of ``payload``, whose length is a positive multiple of 576."""
    size, out, cc = FRAME * FRAMES_PER_PES, [], 0
    for k, at in enumerate(range(0, len(payload), size)):
        if k % PSI_EVERY == 0:
            out.append(_psi(k // PSI_EVERY & 15))
        packets, cc = _pes(payload[at : at + size], at // FRAME * TICKS_PER_FRAME, cc)
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, rows: np.ndarray) -> Iterator[bytes]:
    """The sections that the packets of one PID carry, over any number of packets, several in one where they fit."""
    held, open_, last = b"", False, b""
    for r in rows.tolist():
        p = packets[r].tobytes()
        if not p[3] & 0x10 or p == last:  # no payload, or the packet sent twice
            continue
        last, body = p, p[4 + (p[4] + 1 if p[3] & 0x20 else 0) :]
        if p[1] & 0x40 and body:
            parts = [(held + body[1 : 1 + body[0]], open_), (body[1 + body[0] :], True)]
        else:
            parts = [(held + body, open_)]
        for held, open_ in parts:
            while open_ and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + ((held[1] & 0x0F) << 8 | held[2])
                if len(held) < size:
                    break
                yield held[:size]
                held = held[size:]
            open_ = open_ and held[:1] != b"\xff"


def _table(packets: np.ndarray, rows: np.ndarray, table_id: int, ident: int | None = None) -> bytes:
    """The bodies of a table's sections in order, from the first whole copy; sections with a wrong CRC are passed over,
    and without any whole copy that raises."""
    found: dict[int, bytes] = {}
    version = None
    for x in _sections(packets, rows):
        if x[0] != table_id or len(x) < 12 or not x[5] & 1 or (ident is not None and x[3] << 8 | x[4] != ident) or crc_mpeg(x):
            continue
        if version != x[5]:
            version, found = x[5], {}
        found[x[6]] = x[8:-4]
        if len(found) == x[7] + 1:
            return b"".join(found[k] for k in sorted(found))
    raise ValueError("damaged program table")


def programs(packets: np.ndarray, pid: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each program of the association table its elementary streams, (PID, stream type)."""
    pat, out = _table(packets, np.flatnonzero(pid == 0), 0x00), {}
    for at in range(0, len(pat) - 3, 4):
        number, of = pat[at] << 8 | pat[at + 1], (pat[at + 2] & 0x1F) << 8 | pat[at + 3]
        if not number:  # the network's own table
            continue
        pmt, streams = _table(packets, np.flatnonzero(pid == of), 0x02, number), []
        k = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3])
        while k + 5 <= len(pmt):
            streams.append(((pmt[k + 1] & 0x1F) << 8 | pmt[k + 2], pmt[k]))
            k += 5 + ((pmt[k + 3] & 0x0F) << 8 | pmt[k + 4])
        out[number] = streams
    return out


# PES packets of these stream ids have no header behind their length; those of the first are padding.
PADDING_ID, BARE_IDS = 0xBE, frozenset([0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF])


def demux(stream: bytes, program: int | None = None, track: int = 0) -> dict:
    """Payload, timestamps, random-access points (packet numbers) and continuity errors of one elementary stream: the
    ``track``-th of a program, by default the first of the association table.

    A packet sent twice counts once, packets without payload don't count, and a jump that a discontinuity flag
    announces is none. Packets marked as damaged are left out and missed by the counter. A PES packet ends where the
    next one starts, even if packets of it were lost; what stands before the first start is left out. PES packets
    without a timestamp have a null one; a length of 0 means up to the next start."""
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pid[(packets[:, 1] & 0x80) > 0] = -1
    known = programs(packets, pid)
    wanted = known[next(iter(known)) if program is None else program][track][0]
    rows = np.flatnonzero(pid == wanted)
    es = packets[rows]
    field = np.where(es[:, 3] & 0x20, es[:, 4].astype(np.int32) + 1, 0)
    marks = np.where(field > 1, es[:, 5], 0)
    announced = np.cumsum(marks & 0x80 > 0)
    carries = np.flatnonzero(es[:, 3] & 0x10)
    counter = (es[carries, 3] & 15).astype(np.int32)
    step, told = np.diff(counter) % 16, np.diff(announced[carries]) > 0
    twice = np.zeros(len(carries), bool)
    for k in np.flatnonzero(step == 0).tolist():
        one, two = (bytearray(es[carries[j]].tobytes()) for j in (k, k + 1))
        for x, j in ((one, k), (two, k + 1)):
            if marks[carries[j]] & 0x10:  # the clock is the one field that may differ
                x[6:12] = bytes(6)
        twice[k + 1] = not twice[k] and one == two
    errors = int(((step != 1) & ~told & ~twice[1:]).sum())
    kept = np.ones(len(rows), bool)
    kept[carries[twice]] = False
    access = rows[kept & (marks & 0x40 > 0)]
    es, start = es[carries[~twice]], 4 + field[carries[~twice]]
    ends = np.cumsum(PACKET - start)
    data = es[np.arange(PACKET) >= start[:, None]].tobytes()
    begins = (ends - (PACKET - start))[es[:, 1] & 0x40 > 0].tolist()
    payload, times = [], []
    for b, e in zip(begins, [*begins[1:], len(data)]):
        if data[b : b + 3] != b"\x00\x00\x01" or e - b < 6:
            raise ValueError("damaged PES header")
        ident, size = data[b + 3], int.from_bytes(data[b + 4 : b + 6], "big")
        if ident == PADDING_ID:
            continue
        stop, bare = min(e, b + 6 + size) if size else e, ident in BARE_IDS or e - b < 9
        p = data[b + 9 : b + 14]
        times.append(None if bare or not data[b + 7] & 0x80 or len(p) < 5 else (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
        payload.append(data[b + 6 if bare else b + 9 + data[b + 8] : stop])
    return {"payload": b"".join(payload), "pts": times, "access": access.tolist(), "errors": errors, "packets": len(packets), "programs": known}


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(FRAME, -(-len(raw) // FRAME) * FRAME)
    return len(raw), raw.ljust(size, b"\xff")


_OUT = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("access_points", pa.list_(pa.int64())), ("media", pa.binary())])


def to_transport_stream(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per input row: the stored stream (``media``) and what reading it back gives."""
    kind = dict(df.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for text in part.column(1).to_pylist():
                    n, payload = pad(text)
                    stream = mux(payload)
                    got = demux(stream)
                    back = got["payload"]
                    samples = np.frombuffer(back, np.uint8)
                    feature = f"frames={len(back) // FRAME};pes={len(got['pts'])};last_pts={got['pts'][-1]};access={len(got['access'])};cc_errors={got['errors']};packets={got['packets']};level={int(samples.sum(dtype=np.int64)) // len(samples)};peak={int(samples.max())}"
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, got["pts"], got["access"], stream if keep_media else None))
                cols = [part.column(0)] + [pa.array(c, t.type) for c, t in zip(zip(*rows), _OUT)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *_OUT.names])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<long>, media binary"
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def op3_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return to_transport_stream(docs, keep_media=False).drop("media")
