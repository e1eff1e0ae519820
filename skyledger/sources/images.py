"""Image files: size, camera and position from JPEG and TIFF headers, parsed in tasks; pixels by Spark's image source."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, times
from ..operators.pixels import shares

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
# TIFF and EXIF tags.
WIDTH, HEIGHT, MAKE, MODEL, ORIENTATION, XMP, EXIF_IFD, GPS_IFD, TAKEN, FOCAL, FOCAL35, ISO = 256, 257, 271, 272, 274, 700, 34665, 34853, 36867, 37386, 41989, 34855
SUB_IFDS = 330
# Places and lengths of embedded pictures, in the order of search, and limits of files and pictures.
EMBEDDED, MAX_RAW_BYTES, MAX_PREVIEW_BYTES = ((50981, 50982), (513, 514)), 80 << 20, 8 << 20
DJI = ("AbsoluteAltitude", "RelativeAltitude", "GimbalRollDegree", "GimbalYawDegree", "GimbalPitchDegree", "FlightRollDegree", "FlightYawDegree", "FlightPitchDegree", "FlightXSpeed", "FlightYSpeed", "FlightZSpeed")
#: Tags that are decoded; others, which may hold whole images, are passed over.
READ = frozenset((WIDTH, HEIGHT, MAKE, MODEL, ORIENTATION, XMP, EXIF_IFD, GPS_IFD, TAKEN, FOCAL, FOCAL35, ISO, SUB_IFDS, *range(1, 7), *(t for pair in EMBEDDED for t in pair)))
SCHEMA = "path string, kind string, width int, height int, make string, model string, orientation int, taken string, focal_mm double, focal35_mm double, iso int, lat double, lat_ref string, lon double, lon_ref string, alt double, alt_ref int, progressive boolean" + "".join(f", {n} double" for n in DJI)


class Tiff:
    """Directories of a TIFF structure; anything out of bounds reads as absent."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None or len(data) < 8 or struct.unpack_from(self.order + "H", data, 2)[0] != 42:
            raise ValueError("no TIFF header")

    def ifd(self, at: int) -> tuple[dict[int, list], int]:
        """Tags, and where the next directory is."""
        d, o, out = self.data, self.order, {}
        if not 0 < at <= len(d) - 2:
            return out, 0
        n = struct.unpack_from(o + "H", d, at)[0]
        for k in range(n):
            e = at + 2 + 12 * k
            if e + 12 > len(d):
                return out, 0
            tag, kind, count = struct.unpack_from(o + "HHI", d, e)
            size = SIZES.get(kind, 0) * count
            p = e + 8 if size <= 4 else struct.unpack_from(o + "I", d, e + 8)[0]
            if tag in READ and size and p + size <= len(d):
                out[tag] = self._values(kind, count, p)
        end = at + 2 + 12 * n
        return out, struct.unpack_from(o + "I", d, end)[0] if end + 4 <= len(d) else 0

    def _values(self, kind: int, count: int, p: int) -> list:
        d, o = self.data, self.order
        if kind in (2, 7):
            return [d[p : p + count]]
        if kind in (5, 10):
            raw = struct.unpack_from(f"{o}{2 * count}{'I' if kind == 5 else 'i'}", d, p)
            return [a / b if b else None for a, b in zip(raw[::2], raw[1::2])]
        return list(struct.unpack_from(f"{o}{count}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 8: 'h', 9: 'i', 11: 'f', 12: 'd', 13: 'I'}[kind] }", d, p))


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of a JPEG up to its scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            return
        if 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def _text(x: list | None) -> str | None:
    raw = x[0] if x else None
    return (raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None) if isinstance(raw, bytes) else None


def _first(x: list | None):
    return x[0] if x and not isinstance(x[0], bytes) else None


def _degrees(x: list | None) -> float | None:
    return x[0] + x[1] / 60 + x[2] / 3600 if x and len(x) == 3 and None not in x else None


def xmp_numbers(packet: bytes) -> dict[str, float]:
    """Flight telemetry, written as attributes or as elements."""
    out = {}
    for name in DJI:
        m = re.search(rb"drone-dji:" + name.encode() + rb"(?:=\"([^\"]*)\"|>([^<]*)<)", packet)
        if m:
            try:
                out[name] = float(m[1] or m[2])
            except ValueError:
                pass
    return out


def read_header(data: bytes) -> dict:
    """What the headers say; empty for other files. Damaged parts are absent, never errors."""
    out: dict = {}
    tiff = None
    if data[:3] == b"\xff\xd8\xff":
        out["kind"] = "jpeg"
        for marker, body in segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5 and "width" not in out:
                out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "progressive": marker == 0xC2}
            elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
                try:
                    tiff = Tiff(body[6:])
                except ValueError:
                    pass
            elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/"):
                out |= xmp_numbers(body)
    elif data[:4] in (b"II*\0", b"MM\0*"):
        out["kind"], tiff = "tiff", Tiff(data)
    if tiff is None:
        return out
    main, _ = tiff.ifd(struct.unpack_from(tiff.order + "I", tiff.data, 4)[0])
    if out["kind"] == "tiff":
        subs = [main, *(tiff.ifd(int(p))[0] for p in main.get(SUB_IFDS, []))]
        sizes = [(int(_first(d[WIDTH])), int(_first(d[HEIGHT]))) for d in subs if WIDTH in d and HEIGHT in d]
        if sizes:
            out["width"], out["height"] = max(sizes, key=lambda s: s[0] * s[1])
        if XMP in main:
            x = main[XMP]
            out |= xmp_numbers(x[0] if isinstance(x[0], bytes) else bytes(x))
    exif = tiff.ifd(int(_first(main.get(EXIF_IFD)) or 0))[0]
    gps = tiff.ifd(int(_first(main.get(GPS_IFD)) or 0))[0]
    iso, orientation, focal35 = _first(exif.get(ISO)), _first(main.get(ORIENTATION)), _first(exif.get(FOCAL35))
    return out | {
        "make": _text(main.get(MAKE)), "model": _text(main.get(MODEL)), "orientation": orientation, "taken": _text(exif.get(TAKEN)), "focal_mm": _first(exif.get(FOCAL)), "focal35_mm": None if focal35 is None else float(focal35), "iso": iso,
        "lat": _degrees(gps.get(2)), "lat_ref": _text(gps.get(1)), "lon": _degrees(gps.get(4)), "lon_ref": _text(gps.get(3)), "alt": _first(gps.get(6)), "alt_ref": _first(gps.get(5)),
    }


def preview(data: bytes, most: int = MAX_PREVIEW_BYTES) -> bytes | None:
    """The largest JPEG that a raw file's directories name, the last of equal ones; the first directory's own preview, the next directory's, the first's thumbnail, then those of its parts."""
    tiff = Tiff(data)
    main, after = tiff.ifd(struct.unpack_from(tiff.order + "I", data, 4)[0])
    own, thumb = EMBEDDED
    parts = [(main, own), (tiff.ifd(after)[0], thumb), (main, thumb), *((tiff.ifd(int(p))[0], thumb) for p in main.get(SUB_IFDS, []))]
    best = None
    for tags, (at, size) in parts:
        start, n = _first(tags.get(at)), _first(tags.get(size))
        blob = data[start : start + n] if start and n and n <= most and start + n <= len(data) else b""
        if blob.startswith(b"\xff\xd8") and (best is None or len(blob) >= len(best)):
            best = blob
    return best


def previews(files: DataFrame, most_bytes: int = MAX_RAW_BYTES) -> DataFrame:
    """(path, preview, problem) per file of the binaryFile source: not_raw, too_large or no_preview where there is none. Files above the limit are told by their length and aren't read."""
    schema = pa.schema([("path", pa.string()), ("preview", pa.binary()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                data = content.as_py()
                try:
                    found = preview(data)
                    row = {"preview": found, "problem": None if found else "no_preview"}
                except (ValueError, struct.error, TypeError):
                    row = {"problem": "not_raw"}
                yield pa.RecordBatch.from_pylist([{"path": path.as_py()} | row], schema=schema)

    fit = files.filter(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, "path string, preview binary, problem string")
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("preview"), F.lit("too_large").alias("problem"))
    return fit.unionByName(large)


def metadata(files: DataFrame) -> DataFrame:
    """One row per file of the binaryFile source. Files go to Python whole: directories of a TIFF may lie anywhere, and a JPEG's segments before its scan have no limit."""

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*batch.columns):
                try:
                    got = read_header(content.as_py())
                except (ValueError, struct.error, TypeError):
                    got = {}
                rows.append({"path": path.as_py()} | got)
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    raw = files.select("path", "content").mapInArrow(run, SCHEMA)
    pair = numeric.gps_pair(numeric.hemisphere(F.col("lat"), F.col("lat_ref")), numeric.hemisphere(F.col("lon"), F.col("lon_ref")))
    telemetry = {re.sub(r"(?<!^)(?=[A-Z])", "_", n).lower(): F.col(n) for n in DJI}
    return raw.withColumn("_gps", pair).select(
        "path", "kind", "width", "height", "make", "model", "orientation", times.exif_time(F.col("taken")).alias("captured_at"), "focal_mm", "focal35_mm", "iso", F.col("_gps.lat").alias("latitude"), F.col("_gps.lon").alias("longitude"),
        numeric.signed_altitude(F.col("alt"), F.col("alt_ref")).alias("altitude_m"), "progressive", *(v.alias(k) for k, v in telemetry.items()),
    )


def files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,JPG,JPEG,dng,DNG}") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def pixels(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """(path, x, y, r, g, b) of images that the JVM decodes; averaged by area where the longer side exceeds ``longest``."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    grid = img.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    row = grid.withColumn("_row", F.substring("data", F.col("y") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels")))
    px = row.select(F.col("origin").alias("path"), "width", "height", "nChannels", "_row", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    # Bytes are in the order blue, green, red.
    at = lambda k: F.conv(F.hex(F.substring("_row", F.col("x") * F.col("nChannels") + F.when(F.col("nChannels") == 1, 1).otherwise(k), F.lit(1))), 16, 10).cast("int")
    rgb = px.select("path", "width", "height", "x", "y", at(3).alias("r"), at(2).alias("g"), at(1).alias("b"))
    if longest is None:
        return rgb.drop("width", "height")
    scale = F.greatest(F.greatest("width", "height") / longest, F.lit(1.0))
    side = lambda size: F.greatest(F.floor(F.col(size) / scale + 0.5).cast("int"), F.lit(1))
    cells = rgb.withColumn("_x", shares("x", F.col("width"), side("width"))).withColumn("_y", shares("y", F.col("height"), side("height"))).withColumn("_w", F.col("_x.w") * F.col("_y.w"))
    mean = lambda band: F.floor(F.sum(F.col(band) * F.col("_w")) / F.sum("_w") + 0.5).cast("int").alias(band)
    return cells.groupBy("path", F.col("_x.k").alias("x"), F.col("_y.k").alias("y")).agg(*map(mean, "rgb"))
