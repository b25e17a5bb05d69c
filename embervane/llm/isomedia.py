"""Columns of ISO media containers (MP4 and its kin), without decoding payloads.

The boxes of a container nest: 4 bytes of size, 4 of type, and a 64-bit size where the first is 1; a size
of 0 reaches to the end.  For each track the sample tables give the duration (stts), the sizes (stsz or stz2), the
chunks (stsc, stco or co64) and the keyframes (stss; without one every sample is a keyframe).  The fragments of a
fragmented container (moof) add the samples of their runs (trun), with the defaults of tfhd and trex.  Durations are
the media's; edit lists don't change them.  No table is read that its box or the container can't hold, and
boxes nest ``DEPTH`` deep at most, so a forged size costs nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow

#: Boxes that hold boxes, on the way to the sample tables.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
#: How deep boxes may nest; bytes of containers that are read in one batch, one container at least.
DEPTH, SLICE = 16, 4 << 20

TRACKS = "array<struct<track_id:bigint,kind:string,codec:string,duration:double,n_samples:bigint,key_start:array<bigint>,key_end:array<bigint>>>"


def boxes(data: memoryview, a: int, b: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the content) of the boxes in data[a:b]."""
    while a < b:
        if b - a < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, a)
        head = 8
        if size == 1:
            if b - a < 16:
                raise ValueError("a box is cut off")
            (size,) = struct.unpack_from(">Q", data, a + 8)
            head = 16
        elif size == 0:
            size = b - a
        if size < head or a + size > b:
            raise ValueError(f"the box {kind!r} has a wrong size")
        yield kind, a + head, a + size
        a += size


def _find(data: memoryview, a: int, b: int, into: dict[bytes, tuple[int, int]], depth: int = 0) -> dict[bytes, tuple[int, int]]:
    if depth > DEPTH:
        raise ValueError("boxes nest too deep")
    for kind, x, y in boxes(data, a, b):
        if kind in NESTED:
            _find(data, x, y, into, depth + 1)
        else:
            into.setdefault(kind, (x, y))
    return into


def _table(data: memoryview, at: tuple[int, int], width: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    """The entries of a box with version, flags and (after ``skip`` bytes) a count, as rows of ``width`` numbers."""
    (n,) = struct.unpack_from(">I", data, at[0] + skip)
    size = n * width * np.dtype(kind).itemsize
    if at[0] + skip + 4 + size > at[1]:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, kind, n * width, at[0] + skip + 4).reshape(n, width).astype(np.int64)


def _sizes(data: memoryview, at: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """The sizes of a track's samples."""
    if b"stz2" in at:
        a, b = at[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or a + 12 + -(-n * bits // 8) > b:
            raise ValueError("a table is cut off")
        raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), a + 12)
        if bits == 16:
            return raw.view(">u2").astype(np.int64)
        return (raw if bits == 8 else np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n]).astype(np.int64)
    same, n = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
    if same and n * same > len(data):
        raise ValueError("samples beyond the container")
    return np.full(n, same, np.int64) if same else _table(data, at[b"stsz"], 1, skip=8).ravel()


def _track(data: memoryview, a: int, b: int) -> dict:
    at = _find(data, a, b, {})
    (version,) = struct.unpack_from(">B", data, at[b"tkhd"][0])
    (track_id,) = struct.unpack_from(">I", data, at[b"tkhd"][0] + (20 if version else 12))
    (version,) = struct.unpack_from(">B", data, at[b"mdhd"][0])
    (scale,) = struct.unpack_from(">I", data, at[b"mdhd"][0] + (20 if version else 12))
    kind = bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1")
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    times = _table(data, at[b"stts"], 2)
    sizes = _sizes(data, at)
    n = len(sizes)
    chunks = _table(data, at[b"co64"], 1, ">u8").ravel() if b"co64" in at else _table(data, at[b"stco"], 1).ravel()
    runs = _table(data, at[b"stsc"], 3)
    if len(runs) and len(chunks):
        firsts = np.append(runs[:, 0] - 1, len(chunks))
        if firsts[0] or (np.diff(firsts) < 0).any():
            raise ValueError("runs of chunks out of order")
        per = np.repeat(runs[:, 1], np.diff(firsts))
    else:
        per = np.zeros(len(chunks), np.int64)
    upto = np.minimum(np.cumsum(per), n)
    if n and (not len(upto) or upto[-1] < n):
        raise ValueError("samples without a chunk")
    chunk = np.repeat(np.arange(len(chunks)), np.diff(upto, prepend=0))
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(chunk, np.arange(len(chunks)))
    start = chunks[chunk] + total[:-1] - total[first[chunk]]
    keys = _table(data, at[b"stss"], 1).ravel() - 1 if b"stss" in at else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe isn't a sample")
    return {"track_id": track_id, "kind": kind, "codec": codec, "ticks": int((times[:, 0] * times[:, 1]).sum()), "scale": scale, "n_samples": n, "key_start": start[keys].tolist(), "key_end": (start[keys] + sizes[keys]).tolist()}


def _fragment(data: memoryview, moof: int, a: int, b: int, defaults: dict[int, tuple[int, int, int]], tracks: dict[int, dict]) -> None:
    """Adds the samples of the runs in data[a:b], the content of the moof box that begins at ``moof``, to their tracks."""
    for kind, x, y in boxes(data, a, b):
        if kind != b"traf":
            continue
        inner = list(boxes(data, x, y))
        head = next((p for k, p, _ in inner if k == b"tfhd"), None)
        if head is None:
            raise ValueError("a fragment without a head")
        flags, track_id = struct.unpack_from(">II", data, head)
        track = tracks.get(track_id)
        if track is None:
            raise ValueError("a fragment of no track")
        ticks, size, sample_flags = defaults.get(track_id, (0, 0, 0))
        p, base = head + 8, moof
        if flags & 1:
            (base,) = struct.unpack_from(">Q", data, p)
            p += 8
        p += 4 * bool(flags & 2)
        values = []
        for bit in (8, 16, 32):
            values.append(struct.unpack_from(">I", data, p)[0] if flags & bit else None)
            p += 4 * bool(flags & bit)
        ticks, size, sample_flags = (own if own is not None else old for own, old in zip(values, (ticks, size, sample_flags)))
        at = base
        for k, p, end in inner:
            if k != b"trun":
                continue
            flags, n = struct.unpack_from(">II", data, p)
            p += 8
            if flags & 1:
                at = base + struct.unpack_from(">i", data, p)[0]
                p += 4
            first_flags = None
            if flags & 4:
                (first_flags,) = struct.unpack_from(">I", data, p)
                p += 4
            columns = [c for c, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
            if p + 4 * n * len(columns) > end or (1 not in columns and n * max(size, 1) > len(data)):
                raise ValueError("a run is cut off")
            rows = np.frombuffer(data, ">u4", n * len(columns), p).reshape(n, len(columns)).astype(np.int64)
            column = lambda c, default: rows[:, columns.index(c)] if c in columns else np.full(n, default, np.int64)  # noqa: E731, B023
            sizes, own_flags = column(1, size), column(2, sample_flags).copy()
            if first_flags is not None and n and 2 not in columns:
                own_flags[0] = first_flags
            start = at + np.cumsum(sizes) - sizes
            key = own_flags & 0x10000 == 0
            track["ticks"] += int(column(0, ticks).sum())
            track["n_samples"] += n
            track["key_start"] += start[key].tolist()
            track["key_end"] += (start + sizes)[key].tolist()
            at += int(sizes.sum())


def read_tracks(blob: bytes) -> list[dict]:
    """The tracks of a container, in their order."""
    data = memoryview(blob)
    found: list[dict] = []
    tracks: dict[int, dict] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    at = 0
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, x, y in boxes(data, a, b):
                if inner == b"trak":
                    found.append(_track(data, x, y))
                    tracks.setdefault(found[-1]["track_id"], found[-1])
                elif inner == b"mvex":
                    for k, p, _ in boxes(data, x, y):
                        if k == b"trex":
                            _, track_id, _, ticks, size, flags = struct.unpack_from(">6I", data, p)
                            defaults[track_id] = ticks, size, flags
        elif kind == b"moof":
            _fragment(data, at, a, b, defaults, tracks)
        at = b
    for t in found:
        ticks, scale = t.pop("ticks"), t.pop("scale")
        t["duration"] = ticks / scale if scale else None
    return found


def media_columns(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with ``tracks`` and ``media_error`` in place of the binary ``column``; columns of those two names are replaced.

    A null or empty blob has no tracks and no error, as has a container without a moov box; a malformed
    one (cut off, nested too deep, tables or samples beyond the container) has null tracks and says why.  Every
    row stays, repeated ones and those with null ids too; an empty table stays empty.
    """
    names = [c for c in media.columns if c not in (column, "tracks", "media_error")]
    kind = pa.list_(pa.struct([("track_id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("key_start", pa.list_(pa.int64())), ("key_end", pa.list_(pa.int64()))]))

    def f(batches):
        for b in (x for batch in batches for x in K.text_slices(batch, column, SLICE)):
            tracks, errors = [], []
            for blob in b.column(column):
                try:
                    tracks.append(read_tracks(blob.as_py() or b""))
                    errors.append(None)
                except (ValueError, KeyError, struct.error, IndexError, OverflowError) as e:
                    tracks.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(tracks, kind), pa.array(errors, pa.string())], [*names, "tracks", "media_error"])

    schema = ", ".join([*(f"`{n}` {media.schema[n].dataType.simpleString()}" for n in names), f"tracks {TRACKS}", "media_error string"])
    return map_arrow(media, f, schema)


# The text tables hold no media, so the registered query multiplexes each document's bytes as a container of two tracks.
SAMPLE, GROUP, IN_CHUNK, TICKS, SCALE = 256, 12, 10, 1001, 30000
SOUND, SOUND_IN_CHUNK, SOUND_TICKS, SOUND_SCALE = 10, 4, 1024, 48000
HEAD = 40


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def _ints(*x: int) -> bytes:
    return struct.pack(f">{len(x)}I", *x)


def _trak(track: int, kind: bytes, codec: bytes, scale: int, ticks: int, sizes: np.ndarray, chunks: np.ndarray, per: int, keys: np.ndarray | None) -> bytes:
    n = len(sizes)
    last = n - (len(chunks) - 1) * per if n else 0
    runs = [] if not n else [(1, last, 1)] if len(chunks) == 1 else [(1, per, 1), (len(chunks), last, 1)]
    same = int(sizes[0]) if n and (sizes == sizes[0]).all() else 0
    stbl = _box(
        b"stbl",
        _full(b"stsd", _ints(1), _box(codec, bytes(70))),
        _full(b"stts", _ints(1, n, ticks) if n else _ints(0)),
        _full(b"stsc", _ints(len(runs)), *(_ints(*r) for r in runs)),
        _full(b"stsz", _ints(same, n), b"" if same else sizes.astype(">u4").tobytes()),
        _full(b"co64", _ints(len(chunks)), chunks.astype(">u8").tobytes()),
        b"" if keys is None else _full(b"stss", _ints(len(keys)), (keys + 1).astype(">u4").tobytes()),
    )
    mdia = _box(b"mdia", _full(b"mdhd", _ints(0, 0, scale, n * ticks, 0)), _full(b"hdlr", b"\0\0\0\0", kind, bytes(13)), _box(b"minf", stbl))
    return _box(b"trak", _full(b"tkhd", _ints(0, 0, track, 0, n * ticks), bytes(60)), mdia)


def multiplex(payload: bytes) -> bytes:
    """A container of the payload as video samples, a keyframe in every GROUP of them, with a chunk of sound after each of video."""
    n = -(-len(payload) // SAMPLE)
    chunks = -(-n // IN_CHUNK)
    width = SAMPLE * IN_CHUNK
    gap = SOUND * SOUND_IN_CHUNK
    sizes = np.full(n, SAMPLE, np.int64)
    if n:
        sizes[-1] = len(payload) - SAMPLE * (n - 1)
    at = HEAD + np.arange(chunks) * (width + gap)
    sound = np.append(at[1:] - gap, HEAD + len(payload) + (chunks - 1) * gap) if chunks else at
    mdat = b"".join(x for k in range(chunks) for x in (payload[k * width : (k + 1) * width], bytes(gap)))
    video = _trak(1, b"vide", b"avc1", SCALE, TICKS, sizes, at, IN_CHUNK, np.arange(0, n, GROUP))
    audio = _trak(2, b"soun", b"mp4a", SOUND_SCALE, SOUND_TICKS, np.full(chunks * SOUND_IN_CHUNK, SOUND), sound, SOUND_IN_CHUNK, None)
    head = _box(b"ftyp", b"isom", _ints(512), b"isomavc1")
    return head + struct.pack(">I4sQ", 1, b"mdat", 16 + len(mdat)) + mdat + _box(b"moov", _full(b"mvhd", bytes(96)), video, audio)


def multiplexed(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every document's text as a container; null texts have null media."""

    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if t is None else multiplex(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), f, "doc_id bigint, media binary")


def keyframe_rows(media: DataFrame) -> DataFrame:
    """media_columns() with a row for each keyframe: (doc_id, track_id, kind, codec, duration, n_samples, keyframe, key_start, key_end).

    A track without keyframes gives one row with null keyframe; null, empty and trackless containers give no
    rows, and neither do malformed ones: media_columns() says what is wrong with them.  Repeated rows give theirs
    each time.
    """
    t = media_columns(media).select("doc_id", F.explode("tracks").alias("t"))
    ranges = t.select("doc_id", "t.track_id", "t.kind", "t.codec", "t.duration", "t.n_samples", F.posexplode_outer(F.arrays_zip("t.key_start", "t.key_end")).alias("keyframe", "k"))
    return ranges.select("doc_id", "track_id", "kind", "codec", "duration", "n_samples", F.col("keyframe").cast("bigint").alias("keyframe"), F.col("k.key_start").alias("key_start"), F.col("k.key_end").alias("key_end"))


#: What keyframe_rows(multiplexed(documents)) gives, from the lengths of the texts alone.
ORACLE = f"""
WITH d AS (SELECT doc_id, strlen(text) AS n, CAST(ceil(strlen(text) / {SAMPLE}.0) AS BIGINT) AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CAST(ceil(s / {IN_CHUNK}.0) AS BIGINT) AS c FROM d),
v AS (SELECT doc_id, n, s, c, unnest(CASE WHEN s = 0 THEN [NULL] ELSE range(0, s, {GROUP}) END) AS i FROM c),
a AS (SELECT doc_id, n, s, c, unnest(CASE WHEN c = 0 THEN [NULL] ELSE range(0, c * {SOUND_IN_CHUNK}) END) AS i FROM c)
SELECT doc_id, CAST(1 AS BIGINT) AS track_id, 'vide' AS kind, 'avc1' AS codec, s * {TICKS} / {SCALE}.0::DOUBLE AS duration, s AS n_samples, i // {GROUP} AS keyframe,
  {HEAD} + i * {SAMPLE} + i // {IN_CHUNK} * {SOUND * SOUND_IN_CHUNK} AS key_start,
  {HEAD} + least((i + 1) * {SAMPLE}, n) + i // {IN_CHUNK} * {SOUND * SOUND_IN_CHUNK} AS key_end
FROM v UNION ALL
SELECT doc_id, CAST(2 AS BIGINT), 'soun', 'mp4a', c * {SOUND_IN_CHUNK} * {SOUND_TICKS} / {SOUND_SCALE}.0::DOUBLE, c * {SOUND_IN_CHUNK}, i,
  {HEAD} + least((i // {SOUND_IN_CHUNK} + 1) * {SAMPLE * IN_CHUNK}, n) + i * {SOUND} AS key_start,
  {HEAD} + least((i // {SOUND_IN_CHUNK} + 1) * {SAMPLE * IN_CHUNK}, n) + (i + 1) * {SOUND} AS key_end
FROM a
"""
