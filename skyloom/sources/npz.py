"""NumPy archives as a Spark data source, read in row ranges.

spark.dataSource.register(NpzSource); spark.read.format("npz").load(path). An .npz gives a column for each array that has as many
rows as the longest (option "arrays" names some with commas), an .npy one column, "value", or those of its fields. Arrays of
two axes are columns of lists. NaN and infinities are null, as in all readers here. Pickled objects are never loaded. The path
must be on a file system that every executor mounts. A member that is stored is read from its first wanted row on; a compressed one
has to be unpacked up to there, but is never held whole.
"""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# NumPy kinds and sizes, and their Spark types.
TYPES = {"f8": "double", "f4": "float", "f2": "float", "i8": "bigint", "i4": "int", "i2": "smallint", "i1": "tinyint", "u8": "decimal(20,0)", "u4": "bigint", "u2": "int", "u1": "smallint", "b1": "boolean"}


@dataclass
class Member:
    """An array: its name in the archive (None for a bare file), rows, values a row and type."""

    member: str | None
    name: str
    rows: int
    width: int
    many: bool
    dtype: np.dtype

    def spark(self, dtype: np.dtype) -> str:
        one = "string" if dtype.kind in "US" else TYPES[dtype.str[1:]]
        return f"array<{one}>" if self.many else one

    @property
    def columns(self) -> list[tuple[str, str]]:
        if self.dtype.names:
            return [(n, self.spark(self.dtype[n])) for n in self.dtype.names]
        return [(self.name, self.spark(self.dtype))]


def _head(f, member, name) -> Member:
    version = npy.read_magic(f)
    shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError(f"{name}: pickled objects are not read")
    if not shape or len(shape) > 2 or fortran and len(shape) > 1:
        raise ValueError(f"{name}: arrays of one or two axes in row order, not {shape}")
    return Member(member, name, shape[0], shape[1] if len(shape) == 2 else 1, len(shape) == 2, dtype)


def members(path: str) -> list[Member]:
    if not zipfile.is_zipfile(path):
        with open(path, "rb") as f:
            return [_head(f, None, "value")]
    out = []
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            with z.open(info) as f:
                out.append(_head(f, info.filename, info.filename.removesuffix(".npy")))
    return out


def _arrow(v: np.ndarray, many: bool) -> pa.Array:
    flat = np.ascontiguousarray(v).ravel()
    if flat.dtype.kind == "S":
        one = pa.array([x.decode("utf-8", "replace") for x in flat.tolist()])
    elif flat.dtype.kind == "U":
        one = pa.array(flat.tolist(), pa.string())
    elif flat.dtype.str[1:] == "u8":
        one = pa.array(flat.tolist(), pa.decimal128(20, 0))
    else:
        flat = flat.astype({"f2": "f4", "u4": "i8", "u2": "i4", "u1": "i2"}.get(flat.dtype.str[1:], flat.dtype.newbyteorder("=")))
        one = pa.array(flat, mask=~np.isfinite(flat) if flat.dtype.kind == "f" else None)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), one) if many else one


class NpzSource(DataSource):
    @classmethod
    def name(cls):
        return "npz"

    def _members(self) -> list[Member]:
        found = members(self.options["path"].removeprefix("file://"))
        if "arrays" in self.options:
            wanted = [a.strip() for a in self.options["arrays"].split(",")]
            by_name = {m.name: m for m in found}
            if missing := [a for a in wanted if a not in by_name]:
                raise ValueError(f"no such arrays: {missing}; there are {sorted(by_name)}")
            found = [by_name[a] for a in wanted]
            if len({m.rows for m in found}) > 1:
                raise ValueError("arrays of different lengths")
        most = max((m.rows for m in found), default=0)
        return [m for m in found if m.rows == most]

    def schema(self):
        return ", ".join(f"`{n}` {t}" for m in self._members() for n, t in m.columns)

    def reader(self, schema: StructType):
        return NpzReader(self.options["path"].removeprefix("file://"), self._members(), int(self.options.get("rows_per_partition", 1 << 20)))


class NpzReader(DataSourceReader):
    def __init__(self, path, parts, step):
        self.path, self.parts, self.step = path, parts, step

    def partitions(self):
        rows = self.parts[0].rows if self.parts else 0
        return [InputPartition((a, min(a + self.step, rows))) for a in range(0, rows, self.step)]

    def read(self, partition):
        a, b = partition.value
        opened, archive = [], zipfile.ZipFile(self.path) if self.parts[0].member else None
        try:
            for m in self.parts:
                f = archive.open(m.member) if archive else open(self.path, "rb")
                opened.append(f)
                _head(f, m.member, m.name)
                f.seek(f.tell() + a * m.width * m.dtype.itemsize)
            batch = max(1, (8 << 20) // max(1, sum(m.width * m.dtype.itemsize for m in self.parts)))
            for i in range(a, b, batch):
                n, columns, names = min(batch, b - i), [], []
                for m, f in zip(self.parts, opened):
                    v = np.frombuffer(f.read(n * m.width * m.dtype.itemsize), m.dtype, n * m.width)
                    v = v.reshape(n, m.width) if m.many else v
                    for name in m.dtype.names or [m.name]:
                        columns.append(_arrow(v[name] if m.dtype.names else v, m.many))
                        names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            for f in opened:
                f.close()
            if archive:
                archive.close()
