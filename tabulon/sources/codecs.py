"""Column codecs: a record to one value and back, all as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Codec(Protocol):
    name: str

    def encode(self, record: Column) -> Column: ...

    def decode(self, value: Column, schema: T.StructType) -> Column: ...


@dataclass(frozen=True)
class Json:
    name: str = "json"

    def encode(self, record: Column) -> Column:
        return F.to_json(record, {"ignoreNullFields": "false"}).cast("binary")

    def decode(self, value: Column, schema: T.StructType) -> Column:
        return F.from_json(value.cast("string"), schema)


@dataclass(frozen=True)
class Columnar:
    """Records as they are: Parquet's own columns stand for the binary codecs."""

    name: str = "columnar"

    def encode(self, record: Column) -> Column:
        return record

    def decode(self, value: Column, schema: T.StructType) -> Column:
        return value.cast(schema)


@dataclass(frozen=True)
class Protobuf:
    """Messages of a descriptor set; records without one are encoded as JSON."""

    message: str = ""
    descriptor: bytes | None = None
    name: str = "protobuf"

    def encode(self, record: Column) -> Column:
        if self.descriptor is None:
            return Json().encode(record)
        from pyspark.sql.protobuf.functions import to_protobuf

        return to_protobuf(record, self.message, binaryDescriptorSet=self.descriptor)

    def decode(self, value: Column, schema: T.StructType) -> Column:
        if self.descriptor is None:
            return Json().decode(value, schema)
        from pyspark.sql.protobuf.functions import from_protobuf

        return from_protobuf(value, self.message, binaryDescriptorSet=self.descriptor).cast(schema)


@dataclass(frozen=True)
class Aes:
    """Another codec's values under AES-GCM; keys of 16, 24 or 32 bytes."""

    inner: Codec
    key: bytes

    def __post_init__(self) -> None:
        if len(self.key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")

    @property
    def name(self) -> str:
        return f"aes-{self.inner.name}"

    def encode(self, record: Column) -> Column:
        return F.aes_encrypt(self.inner.encode(record), F.lit(self.key), F.lit("GCM"))

    def decode(self, value: Column, schema: T.StructType) -> Column:
        return self.inner.decode(F.aes_decrypt(value, F.lit(self.key), F.lit("GCM")), schema)
