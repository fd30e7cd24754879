"""Small files of viewers and tools, read and written on the driver; files of a table's size have sources and writers in `packed`."""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
from pyspark.sql import DataFrame

from .packed import NO_YEAR, SOURCES, TIERS, write_meta, write_positions  # noqa: F401 - part of these files' interface


def read_positions(path: str) -> dict[str, np.ndarray]:
    data = maybe_gunzip(open(path, "rb").read())
    (n,) = struct.unpack_from("<I", data)
    out, at = {}, 4
    for name, kind in (("x", "<f4"), ("y", "<f4"), ("tier", "u1"), ("geo", "u1"), ("lon", "u1"), ("scale", "u1")):
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out


def read_meta(path: str) -> list[tuple[str, str, int | None, int | None]]:
    data = maybe_gunzip(open(path, "rb").read())
    n, a, b = struct.unpack_from("<III", data)
    at = 12
    offsets = [np.frombuffer(data, "<u4", n + 1, at + k * 4 * (n + 1)) for k in (0, 1)]
    at += 8 * (n + 1)
    birth, death = (np.frombuffer(data, "<i2", n, at + k * 2 * n) for k in (0, 1))
    at += 4 * n
    names, texts = data[at : at + a], data[at + a : at + a + b]
    year = lambda y: None if y == NO_YEAR else int(y)
    return [(names[offsets[0][i] : offsets[0][i + 1]].decode(), texts[offsets[1][i] : offsets[1][i + 1]].decode(), year(birth[i]), year(death[i])) for i in range(n)]


def maybe_gunzip(data: bytes) -> bytes:
    """Unpacked if it starts with gzip's magic, else as it is."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def write_heightmap(grid: np.ndarray, world: float, path: str) -> None:
    """u32 res, f32 world size, f32 grid by rows."""
    with open(path, "wb") as out:
        out.write(struct.pack("<If", len(grid), world) + grid.astype("<f4").tobytes())


def read_heightmap(path: str) -> tuple[np.ndarray, float]:
    data = maybe_gunzip(open(path, "rb").read())
    res, world = struct.unpack_from("<If", data)
    return np.frombuffer(data, "<f4", res * res, 8).reshape(res, res), world


def write_raster(path: str, **grids: np.ndarray) -> None:
    """Named grids and numbers in one compressed npz file."""
    np.savez_compressed(path, **grids)


def read_raster(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as data:
        return {k: data[k] for k in data.files}


def write_soup(soup: np.ndarray, path: str) -> None:
    """Triangle soup: u32 vertices, f32 x, y, z of each."""
    with open(path, "wb") as out:
        out.write(struct.pack("<I", len(soup)) + soup.astype("<f4").tobytes())


def read_soup(path: str) -> np.ndarray:
    data = open(path, "rb").read()
    return np.frombuffer(data, "<f4", offset=4).reshape(struct.unpack_from("<I", data)[0], 3)


def write_monuments(monuments: DataFrame, path: str) -> int:
    """JSON with x and y rounded half to even to one place, text unescaped."""
    rows = [r.asDict() | {"x": round(r["x"], 1), "y": round(r["y"], 1)} for r in monuments.orderBy("label").collect()]
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=False)
    return len(rows)


def load_gazetteer(path: str) -> dict:
    """min_pool, aliases, and lower-case regions and phrases to ignore of a JSON configuration."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    return {"min_pool": data.get("min_pool", 30), "aliases": data.get("citizenship_aliases", {}), "ignore": [p.lower() for p in data.get("_ignore", [])], "regions": {k.lower(): v for k, v in data.get("regions", {}).items()}}
