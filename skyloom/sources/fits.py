"""FITS binary tables as a Spark data source, read in row ranges.

spark.dataSource.register(FitsSource); spark.read.format("fits").option("ext", 1).load(path). The path
must be a file system that every executor mounts (FITS needs seeking, which Spark's own readers of other
stores do not offer to Python); a task decodes only its rows and the columns asked for. Option "columns" names them with
commas; those that the table lacks are left out with a warning.

df.write.format("fits").mode("append").save(folder) writes a file for each partition into a folder that executors mount: under
a name of its own until the job commits, so that a task that is run again leaves nothing twice.

What FITS writes for unknown is null: NaN (infinities too), TNULL in columns of whole numbers, a zero byte among booleans.
TSCAL and TZERO are applied: whole numbers stay whole where both are, else they become doubles. Bits are booleans, complex
numbers structs of re and im, columns of several values or of varying length arrays (of letters: text).
"""

from __future__ import annotations

import os
import re
import uuid
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 2880
# FITS column codes, their NumPy and Spark types; of whole numbers also the type that holds them once an offset is added.
CODES = {
    "L": ("u1", "boolean"), "X": ("u1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "bigint"),
    "E": (">f4", "float"), "D": (">f8", "double"), "C": (">c8", "struct<re:float,im:float>"), "M": (">c16", "struct<re:double,im:double>"), "A": ("S", "string"),
}
WIDER = {"B": "short", "I": "int", "J": "bigint", "K": "decimal(20,0)"}
_FORM = re.compile(r"(\d*)([LXBIJKAEDCMPQ])([LXBIJKAEDCM]?)")


@dataclass
class Column:
    """A column of a table: `repeat` values of type code at byte `at` of a row, or, if `heap` is P or Q, a descriptor there and the values
    in the heap."""

    name: str
    code: str
    repeat: int
    at: int
    heap: str = ""
    null: int | None = None
    scale: float | int = 1
    zero: float | int = 0

    def bytes_of(self, n: int) -> int:
        """Of n values one after the other."""
        return -(-n // 8) if self.code == "X" else n if self.code == "A" else n * np.dtype(CODES[self.code][0]).itemsize

    @property
    def width(self) -> int:
        return {"P": 8, "Q": 16, "": 0}[self.heap] * self.repeat if self.heap else self.bytes_of(self.repeat)

    @property
    def scaled(self) -> bool:
        return (self.scale, self.zero) != (1, 0) and self.code in "BIJKED"

    @property
    def whole(self) -> bool:
        """Whether scaled whole numbers stay whole."""
        return self.code in WIDER and float(self.scale) == 1 and float(self.zero).is_integer()

    @property
    def one(self) -> str:
        """Spark type of one value."""
        if not self.scaled or self.code == "D":
            return CODES[self.code][1]
        return WIDER[self.code] if self.whole else "double"

    @property
    def many(self) -> bool:
        return self.code != "A" and (bool(self.heap) or self.repeat != 1)

    @property
    def kind(self) -> str:
        return f"array<{self.one}>" if self.many else self.one

    def values(self, raw: bytes, n: int) -> pa.Array:
        """n values that stand one after the other in raw, nulls where they are unknown."""
        if self.code == "X":
            return pa.array(np.unpackbits(np.frombuffer(raw, "u1"))[:n].astype(bool))
        v = np.frombuffer(raw, CODES[self.code][0], n)
        if self.code == "L":
            return pa.array(v == ord("T"), mask=v == 0)
        if self.code in "CM":
            parts = [pa.array(x.astype(x.dtype.newbyteorder("=")), mask=~np.isfinite(x)) for x in (v.real, v.imag)]
            return pa.StructArray.from_arrays(parts, ["re", "im"])
        v = v.astype(v.dtype.newbyteorder("="))
        missing = ~np.isfinite(v) if self.code in "ED" else v == self.null if self.null is not None else np.zeros(n, bool)
        if not self.scaled:
            return pa.array(v.astype("i2") if self.code == "B" else v, mask=missing)
        if self.one.startswith("decimal"):
            return pa.array([None if m else int(x) + int(self.zero) for x, m in zip(v.tolist(), missing.tolist())], pa.decimal128(20, 0))
        if self.whole:
            return pa.array((v.astype("i8") + int(self.zero)).astype({"short": "i2", "int": "i4", "bigint": "i8"}[self.one]), mask=missing)
        return pa.array(v.astype("f8") * float(self.scale) + float(self.zero), mask=missing)


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("ascii", "replace").rstrip()


def header(f) -> dict:
    """Cards of the header at the file's place; the file is left behind it."""
    cards: dict = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise EOFError
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] != "= ":
                continue
            raw = card[10:].strip()
            if raw.startswith("'"):
                cards[key] = raw[1 : raw.index("'", 1)].rstrip()
            else:
                raw = raw.split("/")[0].strip()
                cards[key] = raw == "T" if raw in ("T", "F") else float(raw.replace("D", "E")) if any(c in raw for c in ".ED") else int(raw)


def data_size(h: dict) -> int:
    n = 1 if h.get("NAXIS", 0) else 0
    for k in range(1, h.get("NAXIS", 0) + 1):
        n *= h[f"NAXIS{k}"]
    n = abs(h["BITPIX"]) // 8 * (n + h.get("PCOUNT", 0)) * h.get("GCOUNT", 1)
    return -(-n // BLOCK) * BLOCK


def table(path: str, ext: int | None) -> tuple[int, int, int, int, list[Column]]:
    """Data offset, rows, row bytes, heap offset and columns of extension ext, or of the first table."""
    with open(path, "rb") as f:
        for number in range(1 << 16):
            h = header(f)
            if h.get("XTENSION") == "BINTABLE" and ext in (None, number):
                columns, at = [], 0
                for k in range(1, h["TFIELDS"] + 1):
                    repeat, code, sub = _FORM.match(h[f"TFORM{k}"]).groups()
                    heap = code if code in "PQ" else ""
                    own = Column(h.get(f"TTYPE{k}", f"col{k}"), sub if heap else code, int(repeat or 1), at, heap, h.get(f"TNULL{k}"), h.get(f"TSCAL{k}", 1), h.get(f"TZERO{k}", 0))
                    if own.width:
                        columns.append(own)
                    at += own.width
                return f.tell(), h["NAXIS2"], h["NAXIS1"], f.tell() + h.get("THEAP", h["NAXIS1"] * h["NAXIS2"]), columns
            f.seek(data_size(h), 1)
    raise ValueError("no such table")


class FitsSource(DataSource):
    @classmethod
    def name(cls):
        return "fits"

    def _table(self):
        ext = self.options.get("ext")
        path = self.options["path"].removeprefix("file://")
        return path, table(path, None if ext is None else int(ext))

    def schema(self):
        columns = self._table()[1][4]
        if "columns" in self.options:
            wanted = [c.strip() for c in self.options["columns"].split(",")]
            if missing := set(wanted) - {c.name for c in columns}:
                warnings.warn(f"no such columns, left out: {sorted(missing)}", stacklevel=2)
            columns = sorted((c for c in columns if c.name in wanted), key=lambda c: wanted.index(c.name))
        return ", ".join(f"`{c.name}` {c.kind}" for c in columns)

    def reader(self, schema: StructType):
        path, (at, rows, width, heap, columns) = self._table()
        by_name = {c.name: c for c in columns}
        return FitsReader(path, at, rows, width, heap, [by_name[n] for n in schema.names], int(self.options.get("rows_per_partition", 1 << 20)))

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("append to a new folder: FITS files are not overwritten")
        return FitsWriter(self.options["path"].removeprefix("file://"), schema, int(self.options.get("string_width", 64)))


class FitsReader(DataSourceReader):
    def __init__(self, path, at, rows, width, heap, columns, step):
        self.path, self.at, self.rows, self.width, self.heap, self.columns, self.step = path, at, rows, width, heap, columns, step

    def partitions(self):
        return [InputPartition((a, min(a + self.step, self.rows))) for a in range(0, self.rows, self.step)]

    def _from_heap(self, f, column: Column, descriptors: np.ndarray) -> pa.Array:
        """Values of varying number: descriptors are (number, offset in the heap) of each row."""
        parts, ends = [], [0]
        for n, offset in descriptors.tolist():
            f.seek(self.heap + offset)
            raw = f.read(column.bytes_of(n))
            parts.append(_text(raw) if column.code == "A" else column.values(raw, n))
            ends.append(ends[-1] + n)
        if column.code == "A":
            return pa.array(parts, pa.string())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))

    def _decoded(self, f, column: Column, raw: np.ndarray) -> pa.Array:
        """A column of the rows raw (rows x their bytes)."""
        own, n = np.ascontiguousarray(raw[:, column.at : column.at + column.width]), len(raw)
        if column.heap:
            return self._from_heap(f, column, own.view(">i4" if column.heap == "P" else ">i8").reshape(n, 2 * column.repeat)[:, :2])
        if column.code == "A":
            return pa.array([_text(x.tobytes()) for x in own])
        bits = column.width * 8 if column.code == "X" else column.repeat  # a row's bits end in its last byte
        flat = column.values(own.tobytes(), n * bits)
        if column.code == "X":
            flat = flat.take(pa.array((np.arange(n)[:, None] * bits + np.arange(column.repeat)).ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * column.repeat, pa.int32()), flat) if column.many else flat

    def read(self, partition):
        a, b = partition.value
        part = max(1, (16 << 20) // self.width)
        with open(self.path, "rb") as f:
            for i in range(a, b, part):
                n = min(part, b - i)
                f.seek(self.at + i * self.width)
                raw = np.frombuffer(f.read(n * self.width), np.uint8).reshape(n, self.width)
                yield pa.RecordBatch.from_arrays([self._decoded(f, c, raw) for c in self.columns], names=[c.name for c in self.columns])


def _heads(row_bytes: int, rows: int, forms: dict[str, str]) -> bytes:
    """The empty first part and the header of a table."""
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80) if not isinstance(v, str) else f"{k:<8}= '{v:<8}'".ljust(80)

    def block(cards):
        text = "".join(cards) + "END".ljust(80)
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode()

    fields = [c for k, (n, form) in enumerate(forms.items(), 1) for c in (card(f"TTYPE{k}", n), card(f"TFORM{k}", form))]
    table = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", row_bytes), card("NAXIS2", rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(forms))]
    return block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(table + fields)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class FitsWriter(DataSourceArrowWriter):
    """Numbers, booleans and texts of at most `width` UTF-8 bytes (a longer one is an error); a null is NaN or an empty text,
    and an error in a column that has neither. A task holds one batch; the header is completed when its rows are counted."""

    # FITS codes and NumPy types of Spark's types.
    FORMS = {"double": ("1D", ">f8"), "float": ("1E", ">f4"), "bigint": ("1K", ">i8"), "int": ("1J", ">i4"), "smallint": ("1I", ">i2"), "tinyint": ("1I", ">i2"), "boolean": ("1L", "S1")}

    def __init__(self, folder, schema, width):
        self.folder, self.width, self.job = folder, width, uuid.uuid4().hex[:8]
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if bad := {n: k for n, k in kinds.items() if k not in self.FORMS and k != "string"}:
            raise ValueError(f"no FITS type for {bad}")
        self.forms = {n: (f"{width}A", f"S{width}") if k == "string" else self.FORMS[k] for n, k in kinds.items()}

    def _column(self, name, form, v):
        if form[0].endswith("A"):
            texts = [(x or "").encode() for x in v.to_pylist()]
            if max(map(len, texts), default=0) > self.width:
                raise ValueError(f"{name}: a text of over {self.width} bytes; raise string_width")
            return np.array(texts, form[1])
        if v.null_count and form[0] not in ("1D", "1E"):
            raise ValueError(f"{name}: a null in a column of whole numbers or booleans")
        out = v.to_numpy(zero_copy_only=False)
        return np.where(out.astype(bool), b"T", b"F") if form[0] == "1L" else out.astype(form[1])

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        path, rows = f"{self.folder}/_{self.job}-{uuid.uuid4().hex}", 0
        row = np.dtype([(n, form[1]) for n, form in self.forms.items()])
        head = lambda n: _heads(row.itemsize, n, {k: form[0] for k, form in self.forms.items()})
        with open(path, "xb") as f:
            f.write(head(0))
            for batch in iterator:
                data = np.empty(batch.num_rows, row)
                for name, v in zip(self.forms, batch.columns):
                    data[name] = self._column(name, self.forms[name], v)
                f.write(data.tobytes())
                rows += batch.num_rows
            f.write(b"\0" * (-rows * row.itemsize % BLOCK))
            f.seek(0)
            f.write(head(rows))
        return _Written(path)

    def commit(self, messages):
        for k, m in enumerate(messages):
            os.rename(m.path, f"{self.folder}/chunk-{self.job}-{k:05d}.fits")
        for name in os.listdir(self.folder):  # attempts that were lost
            if name.startswith(f"_{self.job}-"):
                os.remove(f"{self.folder}/{name}")

    def abort(self, messages):
        for m in messages:
            if m is not None:
                os.remove(m.path)


def write(path: str, columns: dict[str, np.ndarray]) -> None:
    """A small table as one FITS file, for exchange: numbers and byte strings, one value a row."""
    code = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "b1": "L"}
    form = lambda v: f"{v.dtype.itemsize}A" if v.dtype.kind == "S" else "1" + code[v.dtype.str[1:]]
    data = np.rec.fromarrays([v if v.dtype.kind == "S" else np.where(v, ord("T"), ord("F")).astype("u1") if v.dtype.kind == "b" else v.astype(v.dtype.newbyteorder(">")) for v in columns.values()], names=list(columns))
    raw = data.tobytes()
    with open(path, "xb") as f:
        f.write(_heads(data.dtype.itemsize, len(data), {n: form(v) for n, v in columns.items()}))
        f.write(raw.ljust(-(-len(raw) // BLOCK) * BLOCK, b"\0"))
