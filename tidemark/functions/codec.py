"""Payload codecs by version, and the 16-byte record header."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions travel to executors by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SQL = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint"}


class VersionRegistry:
    """Layouts of payloads: for each version the fields of a packed little-endian struct, as (name, numpy type)."""

    def __init__(self) -> None:
        self.layouts: dict[int, np.dtype] = {}

    def register(self, version: int, fields: list[tuple[str, str]]) -> VersionRegistry:
        """A version registered again takes the new layout."""
        if not 0 <= version <= 65_535:
            raise ValueError("a version is 0 to 65535")
        self.layouts[version] = np.dtype([(n, "<" + t.lstrip("<")) for n, t in fields])
        return self

    def size(self, version: int) -> int:
        if version not in self.layouts:
            raise KeyError(f"version {version} is not registered")
        return self.layouts[version].itemsize

    def can_decode(self, version: Column, n_bytes: Column) -> Column:
        """True where the version is registered and the payload is long enough; a longer one counts."""
        ok = F.lit(False)
        for v, layout in self.layouts.items():
            ok = F.when(version == v, F.coalesce(n_bytes >= layout.itemsize, F.lit(False))).otherwise(ok)
        return ok

    def decode(self, df: DataFrame, version: int, payload: str = "payload", into: str = "decoded") -> DataFrame:
        """Records of one version with the payload's fields as a struct; bytes beyond the layout are passed over.

        A record of another version or a payload that is too short fails the action.
        """
        layout = self.layouts.get(version)
        if layout is None:
            raise KeyError(f"version {version} is not registered")
        size = layout.itemsize
        fields = ",".join(f"{n}:{_SQL[layout[n].str[1:]]}" for n in layout.names)

        @F.arrow_udf(f"struct<{fields}>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            wide = {"u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64()}
            for values in batches:
                x = np.frombuffer(b"".join(v[:size] for v in values.to_pylist()), dtype=layout)
                yield pa.StructArray.from_arrays([pa.array(x[n].copy(), wide.get(layout[n].str[1:])) for n in layout.names], list(layout.names))

        fits = (F.col("version") == version) & (F.octet_length(payload) >= size)
        checked = F.when(fits, F.col(payload)).otherwise(F.raise_error(F.lit(f"payload is not one of version {version} with {size} bytes at least")))
        return df.withColumn(into, run(checked))


def _bytes(x: Column, width: int) -> Column:
    """A whole number as little-endian two's complement."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def _number(x: Column, at: int, width: int, signed: bool) -> Column:
    digits = F.concat(*[F.hex(F.substring(x, at + i + 1, 1)) for i in reversed(range(width))])
    top = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int")
    low = F.conv(F.concat(F.lit("0"), F.substring(digits, 2, 2 * width - 1)), 16, 10).cast("long")
    head = F.when(F.lit(signed) & (top >= 8), top - 16).otherwise(top).cast("long")
    return F.shiftleft(head, 8 * width - 4) + low


def encode_header(primary_index: Column, secondary_index: Column, version: Column, length: Column) -> Column:
    """16 bytes: long, int, two unsigned shorts."""
    return F.concat(_bytes(primary_index, 8), _bytes(secondary_index, 4), _bytes(version, 2), _bytes(length, 2))


def decode_header(header: Column) -> dict[str, Column]:
    return {
        "primary_index": _number(header, 0, 8, True),
        "secondary_index": _number(header, 8, 4, True).cast("int"),
        "version": _number(header, 12, 2, False).cast("int"),
        "payload_length": _number(header, 14, 2, False).cast("int"),
    }
