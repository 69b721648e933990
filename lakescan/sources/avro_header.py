"""Columns of Avro files from their headers alone: the magic bytes, a map of metadata, the schema in it.

Counts and lengths are zig-zag numbers in groups of seven bits. A header is read in growing bounded pieces; data blocks are not.
"""

from __future__ import annotations

import json

MAGIC = b"Obj\x01"
HEADER_BYTES = 16 << 20


class Short(Exception):
    """The bytes at hand end inside the header."""


def number(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise Short
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return (value >> 1) ^ -(value & 1), at
        if shift > 63:
            raise ValueError("a number of the header has more than 64 bits")


def metadata(data: bytes) -> dict[str, bytes]:
    """The header's map; ``Short`` if there is too little of it."""
    if not MAGIC.startswith(data[:4]):
        raise ValueError("not an Avro file")
    if len(data) < 4:
        raise Short
    out: dict[str, bytes] = {}
    count, at = number(data, 4)
    while count:
        if count < 0:  # the block's size in bytes follows
            count, (_, at) = -count, number(data, at)
        for _ in range(count):
            pair = []
            for _ in range(2):
                n, at = number(data, at)
                if n < 0:
                    raise ValueError("a length of the header is negative")
                if at + n > len(data):
                    raise Short
                pair.append(data[at : at + n])
                at += n
            out[pair[0].decode()] = pair[1]
        count, at = number(data, at)
    return out


def read_metadata(f, most: int = HEADER_BYTES) -> dict[str, bytes]:
    data, want = b"", 1 << 16
    while True:
        more = f.read(want)
        data += more
        try:
            return metadata(data)
        except Short:
            if not more or len(data) >= most:
                raise ValueError("the header is cut off" if not more else f"the header has more than {most} bytes") from None
        want = len(data)


#: What Spark calls Avro's types.
PLAIN = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "bytes": "binary", "string": "string", "fixed": "binary", "enum": "string", "null": "void"}
LOGICAL = {("int", "date"): "date", ("long", "timestamp-millis"): "timestamp", ("long", "timestamp-micros"): "timestamp", ("long", "local-timestamp-millis"): "timestamp_ntz", ("long", "local-timestamp-micros"): "timestamp_ntz"}


def spark_type(schema, named: dict[str, dict] | None = None, inside: tuple = ()) -> tuple[str, bool]:
    """(type, nullable) of a schema; ``named`` are the records, enums and fixed types met before, which later ones may cite."""
    named = {} if named is None else named
    if isinstance(schema, list):
        rest = [x for x in schema if x != "null"]
        kinds = [spark_type(x, named, inside)[0] for x in rest]
        nullable = len(rest) < len(schema)
        if not kinds:
            return "void", True
        if len(kinds) == 1:
            return kinds[0], nullable
        if set(kinds) <= {"int", "bigint"}:
            return "bigint", nullable
        if set(kinds) <= {"float", "double"}:
            return "double", nullable
        return "struct<" + ",".join(f"member{i}:{k}" for i, k in enumerate(kinds)) + ">", nullable
    if isinstance(schema, str):
        if schema in PLAIN:
            return PLAIN[schema], schema == "null"
        if schema in inside:
            raise ValueError(f"{schema} holds itself")
        return spark_type(named[schema], named, inside)
    kind = schema["type"]
    if isinstance(kind, (dict, list)):
        return spark_type(kind, named, inside)
    if "name" in schema:
        space = schema.get("namespace")
        named[schema["name"]] = schema
        if space:
            named[f"{space}.{schema['name']}"] = schema
    logical = schema.get("logicalType")
    if logical == "decimal" and kind in ("bytes", "fixed"):
        return f"decimal({schema['precision']},{schema.get('scale', 0)})", False
    if (kind, logical) in LOGICAL:
        return LOGICAL[kind, logical], False
    if kind in ("record", "error"):
        here = (*inside, schema["name"])
        return "struct<" + ",".join(f"{f['name']}:{spark_type(f['type'], named, here)[0]}" for f in schema["fields"]) + ">", False
    if kind == "array":
        return f"array<{spark_type(schema['items'], named, inside)[0]}>", False
    if kind == "map":
        return f"map<string,{spark_type(schema['values'], named, inside)[0]}>", False
    return spark_type(kind, named, inside)[0], kind == "null"


def columns(f) -> tuple[list[tuple[str, str, bool]], str]:
    """([(name, type, nullable)], codec) of an open file; a schema that is no record is one column ``value``."""
    meta = read_metadata(f)
    if "avro.schema" not in meta:
        raise ValueError("the header has no schema")
    schema = json.loads(meta["avro.schema"])
    codec = meta.get("avro.codec", b"null").decode()
    codec = "none" if codec == "null" else codec
    if not (isinstance(schema, dict) and schema.get("type") == "record"):
        return [("value", *spark_type(schema))], codec
    named = {schema["name"]: schema}
    return [(x["name"], *spark_type(x["type"], named, (schema["name"],))) for x in schema["fields"]], codec
