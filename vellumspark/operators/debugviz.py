"""PNG pictures of rasters, labels, boxes and crops for inspection."""

from __future__ import annotations

import colorsys
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG of (h, w, 3) pixels."""
    h, w, _ = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, 3 * w)], axis=1).tobytes()
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The (h, w, 3) pixels of a PNG as ``png`` writes them: 8 bits a channel, rows without a filter; its checksums are compared."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, parts = 8, []
    while at < len(data):
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(tag + body):
            raise ValueError(f"broken {tag.decode()} chunk")
        parts.append((tag, body))
        at += 12 + size
    w, h, *form = struct.unpack(">IIBBBBB", parts[0][1])
    rows = np.frombuffer(zlib.decompress(b"".join(body for tag, body in parts if tag == b"IDAT")), np.uint8).reshape(h, 1 + 3 * w)
    if form != [8, 2, 0, 0, 0] or rows[:, 0].any():
        raise ValueError("another kind of PNG")
    return rows[:, 1:].reshape(h, w, 3)


#: Pixels that leave together.
AT_ONCE = 1 << 15


def png_pixels(pictures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, r, g, b): pixels read back from the bytes of pictures (keys, png)."""
    kinds = ", ".join(f"{k} {pictures.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(read_png(batch.column(len(keys))[i].as_buffer().to_pybytes()))
                size += held[-1].shape[0] * held[-1].shape[1]
                # Pixels of small pictures leave together.
                if size >= AT_ONCE or i == batch.num_rows - 1:
                    sizes = [px.shape[0] * px.shape[1] for px in held]
                    y, x = (np.concatenate(v) for v in zip(*(np.divmod(np.arange(n), px.shape[1]) for n, px in zip(sizes, held))))
                    levels = np.concatenate([px.reshape(-1, 3) for px in held]).astype(np.int32)
                    row = pa.array(np.repeat(np.arange(start, i + 1), sizes))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(len(keys))), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), *(pa.array(np.ascontiguousarray(levels[:, k])) for k in range(3))], [*keys, "x", "y", "r", "g", "b"])
                    start, held, size = i + 1, [], 0

    return pictures.select(*keys, "png").mapInArrow(run, f"{kinds}, x int, y int, r int, g int, b int")


def gray_png(px: DataFrame, keys: list[str], value: str = "g") -> DataFrame:
    """(keys, png): pictures of gray pixels (keys, x, y, value); pixels without a row are white."""
    kinds = ", ".join(f"{k} {px.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pa.Table) -> pa.Table:
        out = _blank(group, 255)
        out[group["y"].to_numpy(), group["x"].to_numpy()] = group[value].to_numpy().astype(np.uint8)[:, None]
        return pa.table({**{k: group[k][:1] for k in keys}, "png": pa.array([png(out)], pa.binary())})

    return px.select(*keys, "x", "y", value).groupBy(*keys).applyInArrow(run, f"{kinds}, png binary")


def label_colours(n: int) -> np.ndarray:
    """Distinct colours, hues a golden angle apart."""
    return np.array([[int(c * 255 + 0.5) for c in colorsys.hls_to_rgb(i * 137.508 % 360 / 360, 0.55, 0.7)] for i in range(n)], np.uint8).reshape(-1, 3)


def _pictures(df: DataFrame, draw, beside: DataFrame | None = None) -> DataFrame:
    """Pictures of each image's rows. An image's pixels travel as one row and a task draws a batch of images, as most are small;
    ``beside`` (image_id, and one column that ``draw`` is given after the pixels) joins images and not their pixels."""
    rows = df.withColumn("image_id", F.col("image_id").cast("long"))
    images = rows.groupBy("image_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "image_id"))).alias("pixels"))
    if beside is not None:
        images = images.join(beside.withColumn("image_id", F.col("image_id").cast("long")), "image_id", "left")

    def run(batches):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                pixels = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(1)[i].values)])
                made.append(png(draw(pixels, *(c[i].as_py() for c in batch.columns[2:]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["image_id", "png"])

    return images.mapInArrow(run, "image_id long, png binary")


def _blank(group: pa.Table, level: int) -> np.ndarray:
    return np.full((int(group["y"].to_numpy().max()) + 1, int(group["x"].to_numpy().max()) + 1, 3), level, np.uint8)


def raster_png(px: DataFrame, value: str = "ink") -> DataFrame:
    """(image_id, png): ink black on white."""

    def draw(group: pa.Table) -> np.ndarray:
        out = _blank(group, 255)
        out[group["y"].to_numpy(), group["x"].to_numpy()] = (255 - group[value].to_numpy()).astype(np.uint8)[:, None]
        return out

    return _pictures(px.select("image_id", "x", "y", value), draw)


def labels_png(labels: DataFrame) -> DataFrame:
    """(image_id, png): each component in a colour of its own; dropped ones, and labels beyond the number of those that are left, are background."""

    def draw(group: pa.Table) -> np.ndarray:
        out, label = _blank(group, 30), group["label"].to_numpy()
        n = len(np.unique(label[label >= 0]))
        colours = label_colours(n)
        keep = (label >= 0) & (label < n)
        out[group["y"].to_numpy()[keep], group["x"].to_numpy()[keep]] = colours[label[keep]]
        return out

    return _pictures(labels, draw)


def boxes_png(px: DataFrame, boxes: DataFrame, value: str = "ink") -> DataFrame:
    """(image_id, png): the raster with its boxes' outlines in green."""
    inside = F.collect_list(F.struct("x", "y", "w", "h"))

    def draw(group: pa.Table, found: list[dict] | None) -> np.ndarray:
        out = _blank(group, 255)
        out[group["y"].to_numpy(), group["x"].to_numpy()] = (255 - group[value].to_numpy()).astype(np.uint8)[:, None]
        for b in found or ():
            x, y, x2, y2 = (int(v) for v in (b["x"], b["y"], b["x"] + b["w"] - 1, b["y"] + b["h"] - 1))
            out[y : y2 + 1, [x, min(x2, out.shape[1] - 1)]] = out[[y, min(y2, out.shape[0] - 1)], x : x2 + 1] = (0, 200, 0)
        return out

    return _pictures(px.select("image_id", "x", "y", value), draw, boxes.groupBy("image_id").agg(inside.alias("boxes")))


def grid(n: int, widths: list[int], heights: list[int], most: int = 80, row: int = 800) -> tuple[int, int, int, int]:
    """(cell width, cell height, columns, rows) of the contact sheet of n crops."""
    w, h = min(most, max(widths)), min(most, max(heights))
    columns = min(n, max(1, row // (w + 8)))
    return w + 8, h + 8, columns, -(-n // columns)


def crops_png(crops: DataFrame) -> DataFrame:
    """(image_id, png): crops (image_id, char, width, height, x, y) side by side in the order of their characters."""

    def draw(group: pa.Table) -> np.ndarray:
        frame = group.to_pandas()
        sizes = frame.groupby("char")[["width", "height"]].first().sort_index()
        cw, ch, columns, rows = grid(len(sizes), sizes["width"].tolist(), sizes["height"].tolist())
        out = np.full((rows * ch, columns * cw, 3), 255, np.uint8)
        for k, char in enumerate(sizes.index):
            own = frame[frame["char"] == char]
            scale = min(1.0, (cw - 8) / sizes.loc[char, "width"], (ch - 8) / sizes.loc[char, "height"])
            out[k // columns * ch + 4 + (own["y"] * scale).astype(int), k % columns * cw + 4 + (own["x"] * scale).astype(int)] = 0
        return out

    return _pictures(crops, draw)
