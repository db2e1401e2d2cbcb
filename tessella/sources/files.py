"""Readers of image and calibration files into DataFrames. Files are read by Spark (any store) and decoded
file by file within tasks; a file that can't be decoded gives null pixels and the reason."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the TIFF format: bytes of a value by field type, and tags by name.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 9: 4, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 9: "i", 11: "f", 12: "d"}
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "offsets", 278: "rows_per_strip", 279: "counts", 339: "sample_format"}
IMAGE = "path string, width int, height int, pixels array<float>, props map<string,string>, error string"


def tiff_fields(data: bytes) -> tuple[str, dict[str, list | str]]:
    """Byte order and the named fields of a TIFF's first directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out: dict[str, list | str] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        size = SIZES.get(kind, 1) * n
        start = struct.unpack(order + "I", entry[8:])[0] if size > 4 else None
        raw = entry[8 : 8 + size] if start is None else data[start : start + size]
        if tag in TAGS:
            out[TAGS[tag]] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else list(struct.unpack(f"{order}{n}{CODES[kind]}", raw))
    return order, out


def tiff_image(data: bytes) -> dict:
    """Width, height, float pixels and properties of an uncompressed grey TIFF of 8, 16 or 32 bits."""
    import numpy as np

    order, f = tiff_fields(data)
    if f.get("compression", [1])[0] != 1:
        raise ValueError("compressed TIFF")
    bits, kind = f.get("bits", [8])[0], f.get("sample_format", [1])[0]
    number = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (16, 2): "i2"}.get((bits, kind))
    if number is None:
        raise ValueError(f"{bits} bits of format {kind}")
    raw = b"".join(data[a : a + n] for a, n in zip(f["offsets"], f["counts"], strict=True))
    pixels = np.frombuffer(raw, order + number).astype("float32")
    width, height = int(f["width"][0]), int(f["height"][0])
    if len(pixels) != width * height:
        raise ValueError("strips of another size")
    return {"width": width, "height": height, "pixels": pixels, "props": {"description": f["description"]} if "description" in f else {}}


def _decoded(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                row = {"path": name, "width": None, "height": None, "pixels": None, "props": None, "error": None}
                try:
                    row |= decode(bytes(data))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "width", "height", "pixels", "props", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, IMAGE)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, pixels, props, error) of the TIFF files under path."""
    return _decoded(spark, path, tiff_image)


def read_raw_float(spark: SparkSession, path: str, width: int, little_endian: bool = True) -> DataFrame:
    """The same of files of bare 32-bit floats in rows of `width`."""
    import numpy as np

    def decode(data: bytes) -> dict:
        pixels = np.frombuffer(data, "<f4" if little_endian else ">f4").astype("float32")
        if len(pixels) % width:
            raise ValueError(f"{len(pixels)} values in rows of {width}")
        return {"width": width, "height": len(pixels) // width, "pixels": pixels, "props": {}}

    return _decoded(spark, path, decode)


def pixels_of(images: DataFrame) -> DataFrame:
    """(path, x, y, v): a row for each pixel; not-a-number becomes null."""
    each = images.where("pixels is not null").select("path", "width", F.posexplode("pixels").alias("p", "v"))
    return each.select("path", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), F.when(~F.isnan("v"), F.col("v")).alias("v"))


def read_calibration_xml(spark: SparkSession, path: str, row: str) -> DataFrame:
    """A row for each `row` element of calibration files; columns are its children and attributes."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of XML property files: one entry element with a key for each property."""
    entries = spark.read.format("xml").option("rowTag", "entry").load(path)
    return entries.select(F.col("_metadata.file_path").alias("path"), F.col("_key").alias("key"), F.col("_VALUE").cast("string").alias("value"))


def camera_parameters(properties: DataFrame) -> DataFrame:
    """(station, subcamera, field, value) of keys <prefix>.<station>_subCamera_<n>.<field>."""
    pattern = r"(\d+)_subCamera_(\d+)\.(.+)$"
    part = lambda k: F.regexp_extract("key", pattern, k)
    return properties.where(F.col("key").rlike(pattern)).select(part(1).cast("int").alias("station"), part(2).cast("int").alias("subcamera"), part(3).alias("field"), "value")
