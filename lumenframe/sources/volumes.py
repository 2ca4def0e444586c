"""

Files are read by Spark's own ``binaryFile`` source, so any store will do; a file is decoded where it is read, in Arrow
batches, and leaves as rows (one slice at a time), never as a whole through the driver.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S

#: NIfTI-1 data type codes.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: DICOM tags that tables carry, and the value representations with a 4-byte length.
TAGS = {
    (0x0008, 0x0018): "sop_instance_uid", (0x0008, 0x0060): "modality", (0x0010, 0x0020): "patient_id", (0x0020, 0x000D): "study_uid",
    (0x0020, 0x000E): "series_uid", (0x0020, 0x0013): "instance_number", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns",
}
LONG_FORM = (b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV")
IMPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"


def decode_nifti(data: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """(voxels by z, y, x with slope and intercept applied, spacing x, y, z) of a NIfTI-1 file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = next((o for o in "<>" if len(data) >= 348 and struct.unpack_from(o + "i", data)[0] == 348), None)
    if order is None or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack_from(order + "8h", data, 40)
    code = struct.unpack_from(order + "h", data, 70)[0]
    spacing = struct.unpack_from(order + "8f", data, 76)[1:4]
    start, slope, shift = struct.unpack_from(order + "3f", data, 108)
    if code not in KINDS:
        raise ValueError(f"NIfTI data type {code} is not a number")
    shape = [max(1, d) for d in (dims[1 : dims[0] + 1] + (1, 1, 1))[:3]]
    count = shape[0] * shape[1] * shape[2]
    voxels = np.frombuffer(data, np.dtype(order + KINDS[code]), count, int(start)).reshape(shape[::-1])
    if slope not in (0.0, 1.0) or (slope and shift):
        voxels = voxels * float(slope) + float(shift)
    return voxels, spacing


def encode_nifti(voxels: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """A gzipped NIfTI-1 file of voxels by z, y, x; the same input gives the same bytes."""
    kind = voxels.dtype.newbyteorder("<")
    code = next(c for c, k in KINDS.items() if np.dtype("<" + k) == kind)
    z, y, x = voxels.shape
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, x, y, z, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * kind.itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + voxels.astype(kind).tobytes(), mtime=0)


def _files(spark: SparkSession, root: str, names: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.lower("path").rlike(names)).select("path", "content")


def read_volumes(spark: SparkSession, root: str) -> DataFrame:
    """SRC-24: (sample_id, z, y, x, value) of all NIfTI files below ``root``. A file must fit an executor's row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sample, content in zip(b.column("sample_id").to_pylist(), b.column("content"), strict=True):
                voxels, _ = decode_nifti(content.as_py())
                y, x = (g.ravel().astype(np.int32) for g in np.mgrid[: voxels.shape[1], : voxels.shape[2]])
                for z, plane in enumerate(voxels):
                    columns = [pa.repeat(sample, len(x)).cast(pa.string()), pa.repeat(np.int32(z), len(x)), pa.array(y), pa.array(x), pa.array(plane.ravel().astype("f8"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "z", "y", "x", "value"])

    files = _files(spark, root, r"\.nii(\.gz)?$").select(S.sample_id(F.col("path")).alias("sample_id"), "content")
    return files.mapInArrow(run, "sample_id string, z int, y int, x int, value double")


def nifti_geometry(content: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Size and spacing in (x, y, z) order, from the header alone: of a compressed file only the first bytes are inflated."""
    import zlib

    head = bytes(content[:352])
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(bytes(content[:65536]), 352)
    order = "<" if struct.unpack_from("<i", head)[0] == 348 else ">"
    dim, pix = struct.unpack_from(order + "8h", head, 40), struct.unpack_from(order + "8f", head, 76)
    return tuple(max(1, dim[i]) if i <= dim[0] else 1 for i in (1, 2, 3)), tuple(float(pix[i]) for i in (1, 2, 3))


def read_geometry(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, path, nx, ny, nz, sx, sy, sz): sizes and spacings, without the voxels."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for sample, path, content in f.itertuples(index=False):
                size, spacing = nifti_geometry(content)
                rows.append((sample, path, *size, *spacing))
            yield pd.DataFrame(rows, columns=["sample_id", "path", "nx", "ny", "nz", "sx", "sy", "sz"])

    files = _files(spark, root, r"\.nii(\.gz)?$").select(S.sample_id(F.col("path")).alias("sample_id"), "path", "content")
    return files.mapInPandas(run, "sample_id string, path string, nx int, ny int, nz int, sx double, sy double, sz double")


def encoded_masks(mask: DataFrame, geometry: DataFrame) -> DataFrame:
    """SNK-07: (sample_id, content): a uint8 NIfTI file of each sample's mask voxels (sample_id, z, y, x) in its geometry.

    A sample without mask voxels gets an empty mask. One volume must fit a task, as one file must when it is written.
    """

    def build(key, voxels, shapes):
        import pandas as pd

        if shapes.empty:
            raise ValueError(f"no geometry for {key[0]}")
        g = shapes.iloc[0]
        out = np.zeros((g.nz, g.ny, g.nx), np.uint8)
        out[voxels.z, voxels.y, voxels.x] = 1
        return pd.DataFrame({"sample_id": [key[0]], "content": [encode_nifti(out, (g.sx, g.sy, g.sz))]})

    left = mask.select("sample_id", "z", "y", "x").groupBy("sample_id")
    return left.cogroup(geometry.groupBy("sample_id")).applyInPandas(build, "sample_id string, content binary")


def dicom_header(data: bytes) -> dict[str, str]:
    """The values of ``TAGS`` in a DICOM file's data set, read up to the pixels; empty for other files.

    Implicit and explicit little-endian and deflated transfer syntaxes are read; sequences are passed over.
    """
    if data[128:132] != b"DICM":
        return {}
    found, at, syntax = {}, 132, ""
    while at + 8 <= len(data):  # the file's own group is always explicit
        group, element, kind, size = struct.unpack_from("<HH2sH", data, at)
        if group != 2:
            break
        at += 8
        if kind in LONG_FORM:
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if element == 0x10:
            syntax = data[at : at + size].rstrip(b"\0 ").decode("ascii")
        at += size
    if syntax == BIG:
        raise ValueError("big-endian DICOM is not read")
    if syntax == DEFLATED:
        import zlib

        data, at = zlib.decompressobj(-15).decompress(data[at:]), 0
    depth = 0
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if group == 0x7FE0 and not depth:
            break
        if syntax == IMPLICIT or group == 0xFFFE:
            kind, size = b"", struct.unpack_from("<I", data, at + 4)[0]
            at += 8
        else:
            kind, size = struct.unpack_from("<2sH", data, at + 4)
            at += 8
            if kind in LONG_FORM:
                if at + 4 > len(data):
                    break
                size = struct.unpack_from("<I", data, at)[0]
                at += 4
        if group == 0xFFFE:  # item begin and ends: what an item of open length holds is read at a greater depth
            if element == 0xE000:
                if size != 0xFFFFFFFF:
                    at += size
            elif element == 0xE0DD:
                depth = max(0, depth - 1)
            continue
        if size == 0xFFFFFFFF:
            depth += 1
            continue
        name = TAGS.get((group, element))
        if name and not depth:
            value = data[at : at + size]
            found[name] = str(struct.unpack("<H", value)[0]) if name in ("rows", "columns") and len(value) == 2 else value.rstrip(b"\0 ").decode("utf-8", "replace").strip()
        at += size
    return found


def read_dicom_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, modality, patient_id, study_uid, series_uid, sop_instance_uid, instance_number, rows, columns) of DICOM files."""

    def run(frames):
        import pandas as pd

        names = [*TAGS.values()]
        for f in frames:
            rows = []
            for path, content in f.itertuples(index=False):
                h = dicom_header(content)
                if h:
                    rows.append((path, *[h.get(n) for n in names]))
            yield pd.DataFrame(rows, columns=["path", *names])

    files = _files(spark, root, r"(\.dcm|/[^/.]+)$")
    out = files.mapInPandas(run, "path string, " + ", ".join(f"{n} string" for n in TAGS.values()))
    return out.withColumns({c: F.try_to_number(c, F.lit("999999999")).cast("int") for c in ("instance_number", "rows", "columns")})


def with_modality(headers: DataFrame, *wanted: str) -> DataFrame:
    """SRC-23: the headers whose modality, in upper case, is one of ``wanted``, in the order of their paths."""
    return headers.where(F.upper("modality").isin([w.upper() for w in wanted])).orderBy("path")
