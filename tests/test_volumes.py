"""NIfTI and DICOM files."""

import struct

import numpy as np
import pytest

from lumenframe.sources import volumes as V


def element(group, el, vr, value, explicit=True):
    value += b"\0" * (len(value) % 2)
    if not explicit:
        return struct.pack("<HHI", group, el, len(value)) + value
    if vr in V.LONG_FORM:
        return struct.pack("<HH2sHI", group, el, vr, 0, len(value)) + value
    return struct.pack("<HH2sH", group, el, vr, len(value)) + value


def dicom(modality, syntax=b"1.2.840.10008.1.2.1"):
    explicit = syntax.decode() != V.IMPLICIT
    e = lambda *a: element(*a, explicit=explicit)
    inner = e(0x0008, 0x0060, b"CS", b"XX")
    opened = struct.pack("<HH", 0x0008, 0x1140) + (b"SQ\0\0" if explicit else b"") + b"\xff" * 4
    sequence = opened + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + inner + struct.pack("<HHIHHI", 0xFFFE, 0xE00D, 0, 0xFFFE, 0xE0DD, 0)
    body = e(0x0008, 0x0060, b"CS", modality) + sequence + e(0x0010, 0x0020, b"LO", b"P1") + e(0x0020, 0x0013, b"IS", b"7") + e(0x0028, 0x0010, b"US", struct.pack("<H", 512))
    return b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", syntax) + body + e(0x7FE0, 0x10, b"OW", b"\1\2" * 50)


@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "f8"])
def test_nifti_round_trip(kind):
    a = (np.arange(24).reshape(2, 3, 4) - 5).astype(kind)
    got, spacing = V.decode_nifti(V.encode_nifti(a, (0.5, 1.0, 2.5)))
    assert np.array_equal(a, got) and spacing == (0.5, 1.0, 2.5) and V.encode_nifti(a) == V.encode_nifti(a)
    with pytest.raises(ValueError, match="not a NIfTI"):
        V.decode_nifti(b"x" * 400)


def test_volume_tables(spark, tmp_path):
    a, b = np.arange(24, dtype="i2").reshape(2, 3, 4), np.ones((1, 2, 2), "f4")
    (tmp_path / "a.nii.gz").write_bytes(V.encode_nifti(a, (1.0, 2.0, 3.0)))
    (tmp_path / "b.nii.gz").write_bytes(V.encode_nifti(b))
    (tmp_path / "notes.txt").write_text("no")
    rows = V.read_volumes(spark, str(tmp_path))
    got = {(r.sample_id, r.z, r.y, r.x): r.value for r in rows.collect()}
    assert len(got) == 28 and all(got["a", z, y, x] == a[z, y, x] for z in range(2) for y in range(3) for x in range(4))
    shapes = V.read_geometry(spark, str(tmp_path))
    assert {tuple(r)[2:] for r in shapes.collect()} == {(4, 3, 2, 1.0, 2.0, 3.0), (2, 2, 1, 1.0, 1.0, 1.0)}
    masks = {r.sample_id: V.decode_nifti(bytes(r.content)) for r in V.encoded_masks(rows.where("value > 20"), shapes).collect()}
    assert np.array_equal(masks["a"][0], a > 20) and masks["a"][1] == (1.0, 2.0, 3.0) and not masks["b"][0].any()


@pytest.mark.parametrize("syntax", [b"1.2.840.10008.1.2.1", b"1.2.840.10008.1.2"])
def test_dicom_header(syntax):
    assert V.dicom_header(dicom(b"RTDOSE", syntax)) == {"modality": "RTDOSE", "patient_id": "P1", "instance_number": "7", "rows": "512"}
    assert V.dicom_header(b"other") == {}


def test_dicom_tables(spark, tmp_path):
    (tmp_path / "1.dcm").write_bytes(dicom(b"CT"))
    (tmp_path / "IM2").write_bytes(dicom(b"rtdose"))
    (tmp_path / "readme").write_text("no DICOM")
    headers = V.read_dicom_headers(spark, str(tmp_path))
    assert headers.count() == 2
    (row,) = V.with_modality(headers, "RTDOSE", "RTPLAN").collect()
    assert row.path.endswith("IM2") and (row.instance_number, row.rows) == (7, 512)
