"""Slide images: a data source of their metadata, and pixel reads for coordinate rows.

The source reads baseline TIFF structure with plain Python: directories, sizes, resolution, description. Tiles and
strips are decoded where they are uncompressed or Deflate; other codecs are reported in the row, not raised.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SlideReadError

#: TIFF tags and sizes of their types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_bytes", 282: "x_resolution", 283: "y_resolution", 296: "unit", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_bytes"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Pixels that a whole level may have; readers that a worker keeps open.
MOST_PIXELS, OPEN = 80_000_000, 64


class Tiff:
    """The directories of a TIFF or BigTIFF file, each a level."""

    def __init__(self, path: str):
        self.fs, name = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
        self.file = self.fs.open_input_file(name)
        head = self.file.read_at(16, 0)
        if head[:2] not in (b"II", b"MM"):
            raise SlideReadError(f"{path}: not a TIFF file")
        self.e = "<" if head[:2] == b"II" else ">"
        self.big = struct.unpack(self.e + "H", head[2:4])[0] == 43
        at = struct.unpack(self.e + "Q", head[8:16])[0] if self.big else struct.unpack(self.e + "I", head[4:8])[0]
        self.levels: list[dict] = []
        while at:
            d, at = self._directory(at)
            self.levels.append(d)

    def _directory(self, at: int) -> tuple[dict, int]:
        word, entry = (8, 20) if self.big else (2, 12)
        n = struct.unpack(self.e + ("Q" if self.big else "H"), self.file.read_at(word, at))[0]
        raw = self.file.read_at(n * entry + 8, at + word)
        out: dict = {}
        for i in range(n):
            x = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(self.e + "HH", x[:4])
            count = struct.unpack(self.e + ("Q" if self.big else "I"), x[4 : 12 if self.big else 8])[0]
            if tag not in TAGS or kind not in SIZES:
                continue
            size, here = SIZES[kind] * count, x[12:20] if self.big else x[8:12]
            data = here[:size] if size <= len(here) else self.file.read_at(size, struct.unpack(self.e + ("Q" if self.big else "I"), here)[0])
            if kind == 2:
                out[TAGS[tag]] = data.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                a, b = struct.unpack(self.e + "II", data[:8])
                out[TAGS[tag]] = a / b if b else 0.0
            else:
                v = struct.unpack(f"{self.e}{count}{FORMATS.get(kind, 'B')}", data)
                out[TAGS[tag]] = v[0] if count == 1 else list(v)
        after = raw[n * entry :]
        return out, struct.unpack(self.e + ("Q" if self.big else "I"), after[: 8 if self.big else 4])[0]

    def properties(self) -> dict[str, str]:
        d = self.levels[0]
        unit = {2: "inch", 3: "centimeter"}.get(d.get("unit", 2), "")
        out = {"tiff.ImageDescription": d.get("description", ""), "tiff.ResolutionUnit": unit}
        for k in "XY":
            if d.get(f"{k.lower()}_resolution"):
                out[f"tiff.{k}Resolution"] = repr(float(d[f"{k.lower()}_resolution"]))
        return out

    def _segment(self, d: dict, i: int, h: int, w: int) -> np.ndarray:
        kind = "tile" if "tile_offsets" in d else "strip"
        at, size = (v if isinstance(v, list) else [v] for v in (d[f"{kind}_offsets"], d[f"{kind}_bytes"]))
        data = self.file.read_at(size[i], at[i])
        if d.get("compression", 1) in (8, 32946):
            data = zlib.decompress(data)
        elif d.get("compression", 1) != 1:
            raise SlideReadError(f"compression {d['compression']} can't be decoded")
        a = np.frombuffer(data, np.uint8)[: h * w * d.get("samples", 1)].reshape(h, w, -1)
        return np.cumsum(a, axis=1, dtype=np.uint8) if d.get("predictor", 1) == 2 else a

    def region(self, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        """RGB of a window of a level, white outside of it; a fourth channel is composited on white."""
        d = self.levels[level]
        out = np.full((h, w, 3), 255, np.uint8)
        tw, th = (d["tile_width"], d["tile_height"]) if "tile_offsets" in d else (d["width"], d.get("rows_per_strip", d["height"]))
        across = -(-d["width"] // tw)
        for ty in range(max(y, 0) // th, (min(y + h, d["height"]) - 1) // th + 1):
            for tx in range(max(x, 0) // tw, (min(x + w, d["width"]) - 1) // tw + 1):
                rows = th if "tile_offsets" in d else min(th, d["height"] - ty * th)
                a = on_white(self._segment(d, ty * across + tx, rows, tw))
                y0, x0 = max(y, ty * th), max(x, tx * tw)
                y1, x1 = min(y + h, ty * th + rows, d["height"]), min(x + w, tx * tw + tw, d["width"])
                if y1 > y0 and x1 > x0:
                    out[y0 - y : y1 - y, x0 - x : x1 - x] = a[y0 - ty * th : y1 - ty * th, x0 - tx * tw : x1 - tx * tw]
        return out

    def level(self, level: int) -> np.ndarray:
        d = self.levels[level]
        if d["width"] * d["height"] > MOST_PIXELS:
            raise SlideReadError(f"a level of {d['width']} x {d['height']} is too large to be read whole")
        return self.region(level, 0, 0, d["width"], d["height"])


def on_white(a: np.ndarray) -> np.ndarray:
    if a.shape[2] == 3:
        return a
    if a.shape[2] == 1:
        return np.repeat(a, 3, axis=2)
    if a.shape[2] != 4:
        raise SlideReadError(f"{a.shape[2]} channels")
    alpha = a[:, :, 3:].astype(float)
    return np.round(a[:, :, :3] * alpha / 255 + 255 - alpha).astype(np.uint8)


_HANDLES: OrderedDict[str, Tiff] = OrderedDict()


def opened(path: str) -> Tiff:
    """A reader of this worker, the least recently used closed beyond OPEN."""
    if path not in _HANDLES:
        _HANDLES[path] = Tiff(path)
        if len(_HANDLES) > OPEN:
            _HANDLES.popitem(last=False)[1].file.close()
    _HANDLES.move_to_end(path)
    return _HANDLES[path]


#: Openers in the order they are tried.
BACKENDS = {"tiff": opened}


def open_slide(path: str) -> tuple[str, Tiff]:
    errors = []
    for name, f in BACKENDS.items():
        try:
            return name, f(path)
        except Exception as e:
            errors.append(f"{name}: {e}")
    raise SlideReadError(f"{path}: " + "; ".join(errors))


SLIDE_SCHEMA = "path string, backend string, levels array<struct<w:int,h:int>>, downsamples array<double>, properties map<string,string>, error string"


class SlideSource(DataSource):
    """spark.read.format("slides").load(folder or comma-separated paths): a metadata row per file, errors in their column."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return SLIDE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SlideReader(self.options["paths"].split(","))


class _SlideReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        try:
            backend, s = open_slide(path)
            first = s.levels[0]
            dims = [(int(d["width"]), int(d["height"])) for d in s.levels]
            yield path, backend, dims, [0.5 * (first["width"] / w + first["height"] / h) for w, h in dims], s.properties(), None
        except Exception as e:  # a bad file is a row, not the end of the scan
            yield path, None, None, None, None, str(e)


def read_regions(windows: DataFrame) -> DataFrame:
    """windows (path, level, x, y, w, h) with pixels: RGB bytes, and error. A failed read is tried once more with a fresh handle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                pixels, error = None, None
                for _ in range(2):
                    try:
                        pixels, error = opened(r["path"]).region(r["level"], r["x"], r["y"], r["w"], r["h"]).tobytes(), None
                        break
                    except Exception as e:
                        _HANDLES.pop(r["path"], None)
                        error = str(e)
                yield pa.RecordBatch.from_pylist([r | {"pixels": pixels, "error": error}], schema=pa.schema([("path", pa.string()), ("level", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]))

    d = windows.selectExpr("path", "int(level) level", "int(x) x", "int(y) y", "int(w) w", "int(h) h")
    return d.mapInArrow(run, "path string, level int, x int, y int, w int, h int, pixels binary, error string")


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = gray.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
