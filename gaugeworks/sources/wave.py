"""WAVE files as blocks of samples, read by ranges of bytes.

A file of any size spans many tasks: the planner needs only names and sizes, and each task
reads the chunk headers, then the blocks of its own range. Nothing holds more than a block.
"""

from __future__ import annotations

import fnmatch
import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_SCHEMA = "source_id string, rate int, channels int, encoding string, channel int, block_id long, start_frame long, samples array<double>, clipped long"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Bytes of samples in a task, and those read at once while headers are looked for.
RANGE, WINDOW = 64 << 20, 1 << 16


class WaveError(ValueError):
    """A file that is no WAVE file, or one of a kind that is not read."""


def layout(read, length: int) -> tuple[dict, int, int]:
    """(format, place, size) of the samples of a RIFF or RF64 file of ``length`` bytes, of
    which ``read(place, n)`` gives any part. Chunks may come in any order, sizes in RF64 are
    taken from ds64, an odd chunk has a pad byte."""
    begin = read(0, 12)
    if len(begin) < 12 or begin[:4] not in (b"RIFF", b"RF64") or begin[8:12] != b"WAVE":
        raise WaveError("not a RIFF or RF64 WAVE file")
    wide, at, fmt, found, long_size = begin[:4] == b"RF64", 12, None, None, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        at += 8
        if name == b"ds64":
            if size < 28 or at + 28 > length:
                raise WaveError("ds64 chunk is too short")
            long_size = struct.unpack("<Q", read(at + 8, 8))[0]
        elif name == b"fmt ":
            if size < 16 or at + size > length:
                raise WaveError("fmt chunk is too short")
            tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", read(at, 16))
            mask = 0
            if tag == EXTENSIBLE:
                if size < 40:
                    raise WaveError("extensible fmt chunk is too short")
                mask, tag = struct.unpack("<IH", read(at + 20, 6))
            fmt = {"tag": tag, "channels": channels, "rate": rate, "align": align, "bits": bits, "mask": mask}
        elif name == b"data":
            if wide and size == 0xFFFFFFFF:
                if long_size is None:
                    raise WaveError("RF64 without ds64 chunk")
                size = long_size
            if at + size > length:
                raise WaveError("data chunk is cut off")
            found = at, size
        at += size + (size & 1)
    if fmt is None or found is None:
        raise WaveError("fmt or data chunk is missing")
    known = {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}
    if (fmt["tag"], fmt["bits"]) not in known:
        raise WaveError(f"encoding {fmt['tag']} with {fmt['bits']} bits is not read")
    if not fmt["channels"] or not fmt["rate"] or fmt["align"] != fmt["channels"] * fmt["bits"] // 8 or found[1] % fmt["align"]:
        raise WaveError("format and data do not agree")
    return fmt, *found


def parse(data: bytes) -> tuple[dict, bytes]:
    """(format, sample bytes) of a file in memory."""
    fmt, at, size = layout(lambda place, n: data[place : place + n], len(data))
    return fmt, data[at : at + size]


def decode(data: bytes, tag: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, clipped): integers scaled to [-1, 1), floats as they are; a sample is
    clipped at an end of the scale."""
    if tag == FLOAT:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float64)
        return x, np.abs(x) >= 1.0
    if bits == 8:
        n = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        n = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        n -= (n >> 23) << 24
    else:
        n = np.frombuffer(data, f"<i{bits // 8}").astype(np.int64)
    top = 1 << (bits - 1)
    return n / top, (n == -top) | (n == top - 1)


def project(x: np.ndarray, channels: str | int) -> tuple[np.ndarray, np.ndarray]:
    """``keep`` all channels of (frames, channels), ``mix`` them to their mean, or pick one."""
    if channels == "keep":
        return x, np.abs(x) >= 1
    y = x.mean(1, keepdims=True) if channels == "mix" else x[:, [int(channels)]]
    return y, np.abs(y) >= 1


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file, of a folder's files, or of those that match a pattern in it."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (at, "*") if info.type == fs.FileType.Directory else at.rsplit("/", 1)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    names = store.get_file_info(fs.FileSelector(folder))
    return sorted((prefix + f.path, f.size) for f in names if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._")


class _Part(InputPartition):
    def __init__(self, name: str, size: int, number: int):
        self.name, self.size, self.number = name, size, number


class WaveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("blockframes", 65536))
        self.channels = options.get("channels", "keep")
        self.range = int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[_Part]:
        """A part for each range of a file; headers count as well, so the last may be empty."""
        return [_Part(name, size, k) for name, size in _files(self.path) for k in range(max(1, -(-size // self.range)))]

    def read(self, part: _Part):
        """The blocks that begin in the part's range of the samples, a row a channel."""
        store, at = _store(part.name)
        with store.open_input_file(at) as file:
            window = [0, b""]

            def read(place, n):
                if not window[0] <= place <= place + n <= window[0] + len(window[1]):
                    window[:] = place, file.read_at(max(n, WINDOW), place)
                return window[1][place - window[0] :][:n]

            fmt, data, size = layout(read, part.size)
            step = self.block * fmt["align"]
            encoding = f"{'float' if fmt['tag'] == FLOAT else 'pcm'}{fmt['bits']}"
            for block in range(-(-part.number * self.range // step), -(-min(size, (part.number + 1) * self.range) // step)):
                start = block * self.block
                x, clipped = decode(file.read_at(min(step, size - block * step), data + block * step), fmt["tag"], fmt["bits"])
                x, clipped = x.reshape(-1, fmt["channels"]), clipped.reshape(-1, fmt["channels"])
                if self.channels != "keep":
                    x, mixed = project(x, self.channels)
                    clipped = mixed if self.channels == "mix" else clipped[:, [int(self.channels)]]
                n = x.shape[1]
                same = [[part.name] * n, [fmt["rate"]] * n, [fmt["channels"]] * n, [encoding] * n, range(n), [block] * n, [start] * n]
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                samples = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(x), pa.int32()), pa.array(np.ascontiguousarray(x.T).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, t in zip(same, types)], samples, pa.array(clipped.sum(0), pa.int64())], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


class WaveSource(DataSource):
    """``spark.read.format("wave")``: options path, blockFrames, channels and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader({k.lower(): v for k, v in self.options.items()})


def read_wave(spark: SparkSession, path: str, block_frames: int = 65536, channels: str | int = "keep", range_bytes: int = RANGE) -> DataFrame:
    """A row per source, channel and block of a file, a folder or a pattern, in any store that
    Arrow opens. ``range_bytes`` of a file's samples are one task; ``channels`` keeps all,
    mixes them, or picks one. A file that is not read raises by name of what is wrong."""
    spark.dataSource.register(WaveSource)
    options = {"path": path, "blockFrames": str(block_frames), "channels": str(channels), "rangeBytes": str(range_bytes)}
    return spark.read.format("wave").options(**options).load()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, bytes, sha256) of the files, each streamed through one task: a digest has
    no parts."""
    names = spark.createDataFrame(_files(path) or [], "source_id string, bytes long").repartition(max(1, len(_files(path))))

    def run(batches):
        import hashlib

        for batch in batches:
            out = []
            for name in batch.column("source_id").to_pylist():
                store, at = _store(name)
                sha = hashlib.sha256()
                with store.open_input_stream(at) as file:
                    while part := file.read(1 << 20):
                        sha.update(part)
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["source_id", "bytes", "sha256"])

    return names.mapInArrow(run, "source_id string, bytes long, sha256 string")


def encode_pcm16(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAVE file of (frames, channels) samples."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    data = np.clip(np.floor(x * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
    align = 2 * x.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, x.shape[1], rate, rate * align, align, 16, b"data", len(data))
    return head + data


def matched_pair(reference: np.ndarray, model: np.ndarray, rate: int) -> tuple[bytes, bytes]:
    """Listening clips of equal loudness: the louder one is turned down."""
    rms = lambda v: float(np.sqrt(np.mean(np.square(v)))) or 1.0
    level = min(rms(reference), rms(model))
    return tuple(encode_pcm16(np.asarray(v) * (level / rms(v)), rate) for v in (reference, model))
