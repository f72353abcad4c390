"""Decoders of files of records: bytes to (table, records). A record is a dict of JSON values; NaN and infinities are null."""

from __future__ import annotations

import json
import math
import struct
import tomllib
import xml.etree.ElementTree as ET
import zlib
from datetime import date, datetime, time, timedelta
from typing import Any

from tabulore.sources.lines import parse_json

Tables = list[tuple[str, list[dict]]]


def number(x: float) -> float | None:
    return x if math.isfinite(x) else None


def records_of(values: list[Any], what: str) -> list[dict]:
    if len(values) == 1 and isinstance(values[0], list):
        values = values[0]
    for v in values:
        if not isinstance(v, dict):
            raise ValueError(f"a record of {what} is not an object: {str(v)[:80]}")
    return values


def key_text(key: Any) -> str:
    return key if isinstance(key, str) else json.dumps(key, ensure_ascii=False, separators=(",", ":"))


def json_array(data: bytes, table: str) -> Tables:
    value = parse_json(data.decode())
    if not isinstance(value, list):
        raise ValueError("JSON that begins with [ must be an array")
    return [(table, records_of([value], "JSON"))]


class Bytes:
    """A cursor over bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data end inside a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, code: str) -> Any:
        return struct.unpack(f">{code}", self.take(struct.calcsize(f">{code}")))[0]

    def more(self) -> bool:
        return self.at < len(self.data)


class MessagePack(Bytes):
    #: Type bytes of numbers, and of lengths.
    NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
    SIZED = {0xC4: ("bin", "B"), 0xC5: ("bin", "H"), 0xC6: ("bin", "I"), 0xC7: ("ext", "B"), 0xC8: ("ext", "H"), 0xC9: ("ext", "I"), 0xD9: ("str", "B"), 0xDA: ("str", "H"), 0xDB: ("str", "I"), 0xDC: ("array", "H"), 0xDD: ("array", "I"), 0xDE: ("map", "H"), 0xDF: ("map", "I")}

    def value(self) -> Any:
        b = self.unpack("B")
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 0x100
        if b < 0xC0:
            kind, n = ("map", b & 15) if b < 0x90 else ("array", b & 15) if b < 0xA0 else ("str", b & 31)
            return self.sized(kind, n)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in self.NUMBERS:
            x = self.unpack(self.NUMBERS[b])
            return number(x) if isinstance(x, float) else x
        if 0xD4 <= b <= 0xD8:
            return self.sized("ext", 1 << (b - 0xD4))
        if b in self.SIZED:
            kind, code = self.SIZED[b]
            return self.sized(kind, self.unpack(code))
        raise ValueError(f"type byte {b:#x} is not MessagePack")

    def sized(self, kind: str, n: int) -> Any:
        if kind == "str":
            return self.take(n).decode("utf-8", "replace")
        if kind == "bin":
            return self.take(n).hex()
        if kind == "ext":
            of = self.unpack("b")
            self.take(n)
            return f"ext({of}, {n} bytes)"
        if kind == "array":
            return [self.value() for _ in range(n)]
        out = {}
        for _ in range(n):
            binary = self.data[self.at : self.at + 1] in (b"\xc4", b"\xc5", b"\xc6")
            k = self.value()
            out[json.dumps(k) if binary else key_text(k)] = self.value()
        return out


class Cbor(Bytes):
    def value(self) -> Any:
        b = self.unpack("B")
        major, info = b >> 5, b & 31
        if major == 7:
            if info in (20, 21, 22, 23):
                return {20: False, 21: True}.get(info)
            if info in (25, 26, 27):
                return number(self.unpack({25: "e", 26: "f", 27: "d"}[info]))
            if info == 24:
                self.take(1)
            if info <= 24:
                return None
            raise ValueError("a break outside a value of open length")
        n = info if info < 24 else None if info == 31 else self.unpack({24: "B", 25: "H", 26: "I", 27: "Q"}[info])
        if major in (0, 1):
            x = n if major == 0 else -1 - n
            return x if -(1 << 63) <= x < 1 << 63 else str(x)
        if major in (2, 3):
            raw = self.take(n) if n is not None else b"".join(self.chunks())
            return raw.hex() if major == 2 else raw.decode()
        if major == 4:
            return list(self.items(n))
        if major == 5:
            return {key_text(k): self.value() for k in self.items(n)}
        return {f"tag({n})": self.value()}

    def ends(self) -> bool:
        if self.data[self.at : self.at + 1] == b"\xff":
            self.at += 1
            return True
        return False

    def items(self, n: int | None):
        while n is None and not self.ends() or n:
            yield self.value()
            n = n if n is None else n - 1

    def chunks(self):
        while not self.ends():
            info = self.unpack("B") & 31
            yield self.take(info if info < 24 else self.unpack({24: "B", 25: "H", 26: "I", 27: "Q"}[info]))


def _all_of(reader: Bytes) -> list[Any]:
    out = []
    while reader.more():
        out.append(reader.value())
    return out


def msgpack(data: bytes, table: str) -> Tables:
    return [(table, records_of(_all_of(MessagePack(data)), "MessagePack"))]


def cbor(data: bytes, table: str) -> Tables:
    return [(table, records_of(_all_of(Cbor(data)), "CBOR"))]


class Avro(Bytes):
    """An object container file."""

    def __init__(self, data: bytes) -> None:
        super().__init__(data)
        self.named: dict[str, Any] = {}

    def long(self) -> int:
        shift = n = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (n >> 1) ^ -(n & 1)

    def blocks(self):
        while n := self.long():
            if n < 0:
                self.long()
            yield from range(abs(n))

    def records(self, most: int | None = None) -> list[Any]:
        """The first `most`; what stands behind the block that has them isn't looked at."""
        if self.take(4) != b"Obj\x01":
            raise ValueError("not an Avro container file")
        meta = {}
        for _ in self.blocks():
            key = self.take(self.long()).decode()
            meta[key] = self.take(self.long())
        mark, out = self.take(16), []
        schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
        while self.more() and (most is None or len(out) < most):
            n, raw = self.long(), self.take(self.long())
            block = Avro(self.inflated(raw, codec))
            block.named = self.named
            out += [block.read(schema) for _ in range(n if most is None else min(n, most - len(out)))]
            if most is not None and len(out) == most:
                break
            if self.take(16) != mark:
                raise ValueError("an Avro block doesn't end with the file's mark")
        return out

    @staticmethod
    def inflated(raw: bytes, codec: str) -> bytes:
        if codec == "null":
            return raw
        if codec == "deflate":
            return zlib.decompress(raw, -15)
        import pyarrow as pa

        if codec == "snappy":
            import io  # raw snappy has the plain length in front, as a varint

            n = shift = 0
            for b in io.BytesIO(raw).read(5):
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            return pa.decompress(raw[:-4], n, codec="snappy").to_pybytes()
        if codec == "zstandard":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if codec == "bzip2":
            import bz2

            return bz2.decompress(raw)
        if codec == "xz":
            import lzma

            return lzma.decompress(raw)
        raise ValueError(f"Avro codec {codec!r}")

    def read(self, schema: Any) -> Any:
        if isinstance(schema, list):
            return self.read(schema[self.long()])
        if isinstance(schema, str):
            if schema in self.named:
                return self.read(self.named[schema])
            schema = {"type": schema}
        kind, logical = schema["type"], schema.get("logicalType")
        if isinstance(kind, (dict, list)):
            return self.read(kind)
        if "name" in schema:
            self.named[schema["name"]] = schema
            if schema.get("namespace"):
                self.named[f"{schema['namespace']}.{schema['name']}"] = schema
        if kind == "record":
            return {f["name"]: self.read(f["type"]) for f in schema["fields"]}
        if kind == "array":
            return [self.read(schema["items"]) for _ in self.blocks()]
        if kind == "map":
            return {self.take(self.long()).decode(): self.read(schema["values"]) for _ in self.blocks()}
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind in ("int", "long"):
            n = self.long()
            if logical == "date":
                return (date(1970, 1, 1) + timedelta(days=n)).isoformat()
            return n
        if kind in ("float", "double"):
            return number(struct.unpack("<f" if kind == "float" else "<d", self.take(4 if kind == "float" else 8))[0])
        if kind in ("bytes", "fixed"):
            raw = self.take(schema["size"] if kind == "fixed" else self.long())
            if logical == "decimal":
                n = int.from_bytes(raw, "big", signed=True)
                scale = schema.get("scale", 0)
                sign, digits = "-" if n < 0 else "", str(abs(n)).rjust(scale + 1, "0")
                return sign + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)
            return raw.hex()
        if kind == "string":
            return self.take(self.long()).decode()
        if kind == "boolean":
            return self.take(1) != b"\0"
        if kind == "null":
            return None
        if kind in self.named:
            return self.read(self.named[kind])
        raise ValueError(f"Avro type {kind!r}")


def avro(data: bytes, table: str, nrows: int | None = None) -> Tables:
    found = Avro(data).records(nrows)
    if not all(isinstance(r, dict) for r in found):
        raise ValueError("an Avro file of something other than records")
    return [(table, found)]


def _plain(value: Any) -> Any:
    """Of TOML or YAML."""
    if isinstance(value, dict):
        return {key_text(_plain(k)): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        return number(value)
    if isinstance(value, datetime):
        text = value.replace(tzinfo=None).isoformat()
        if value.tzinfo is None:
            return text
        return text + ("Z" if not value.utcoffset() else value.strftime("%z")[:3] + ":" + value.strftime("%z")[3:])
    if isinstance(value, (date, time)):
        return value.isoformat()
    return value


def toml(data: bytes, table: str) -> Tables:
    return [(table, [_plain(tomllib.loads(data.decode()))])]


def _yaml_loader():
    import yaml

    class Loader(yaml.SafeLoader):
        """Only null, true and false, and numbers are anything but text."""

        yaml_implicit_resolvers: dict = {}

    def scalars(tag: str, pattern: str, first: str) -> None:
        import re

        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))

    scalars("null", r"^(?:~|null|Null|NULL|)$", "~nN\0")
    Loader.yaml_implicit_resolvers.setdefault("", []).extend(Loader.yaml_implicit_resolvers.get("~", []))
    scalars("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF")
    scalars("int", r"^[-+]?(?:0|[1-9][0-9]*)$|^0x[0-9a-fA-F]+$|^0o[0-7]+$", "-+0123456789")
    scalars("float", r"^[-+]?(?:\.[0-9]+|(?:0|[1-9][0-9]*)(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+.0123456789")

    def whole(loader, node):
        text = node.value
        return int(text, 0) if text[:2] in ("0x", "0o") else int(text)

    def real(loader, node):
        text = node.value.lower().replace(".inf", "inf").replace(".nan", "nan")
        return float(text)

    def tagged(loader, suffix, node):
        make = {yaml.ScalarNode: lambda n: loader.construct_object(yaml.ScalarNode(loader.resolve(yaml.ScalarNode, n.value, (True, False)), n.value)), yaml.SequenceNode: lambda n: loader.construct_sequence(n, deep=True)}
        inner = make.get(type(node), lambda n: loader.construct_mapping(n, deep=True))(node)
        return {f"!{suffix}": inner}

    def mapping(loader, node):
        loader.flatten_mapping(node)
        return {key_text(_plain(loader.construct_object(k, deep=True))): loader.construct_object(v, deep=True) for k, v in node.value}

    Loader.add_constructor("tag:yaml.org,2002:int", whole)
    Loader.add_constructor("tag:yaml.org,2002:float", real)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    Loader.add_multi_constructor("!", tagged)
    return Loader


def yaml(data: bytes, table: str) -> Tables:
    import yaml as library

    docs = [_plain(d) for d in library.load_all(data.decode(), Loader=_yaml_loader())]
    docs = [d for d in docs if d is not None]
    return [(table, records_of(docs, "YAML"))]


def ini(data: bytes, table: str) -> Tables:
    """A table for each section with keys; keys before any section are `(default)`."""
    sections: dict[str, dict[str, Any]] = {}
    name = "(default)"
    for line in data.decode().splitlines():
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and "]" in line:
            name = line[1 : line.index("]")].strip()
            continue
        cut = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=-1)
        if cut < 0:
            raise ValueError(f"a line of INI without = or : {line!r}")
        key, value = line[:cut].strip(), line[cut + 1 :].strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        held = sections.setdefault(name, {})
        held[key] = [*(held[key] if isinstance(held[key], list) else [held[key]]), value] if key in held else value
    if not sections:
        raise ValueError("no section of the INI file has keys")
    return [(section, [values]) for section, values in sections.items()]


def _element(e: ET.Element) -> Any:
    local = lambda tag: tag.rpartition("}")[2]
    out: dict[str, Any] = {f"@{local(k)}": v for k, v in e.attrib.items()}
    text = ((e.text or "") + "".join(c.tail or "" for c in e)).strip()
    for child in e:
        if not isinstance(child.tag, str):
            continue
        key, value = local(child.tag), _element(child)
        out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value] if key in out else value
    if not out:
        return text or None
    return out | ({"#text": text} if text else {})


def xml(data: bytes, table: str) -> Tables:
    root = ET.fromstring(data)
    children = [c for c in root if isinstance(c.tag, str)]
    if len(children) > 1 and len({c.tag for c in children}) == 1:
        found = [_element(c) for c in children]
        return [(table, [r if isinstance(r, dict) else {"#text": r} for r in found])]
    found = _element(root)
    if not isinstance(found, dict):
        raise ValueError("the root element has no attributes or children")
    return [(table, [found])]


DECODERS = {"json": json_array, "msgpack": msgpack, "cbor": cbor, "avro": avro, "toml": toml, "yaml": yaml, "ini": ini, "xml": xml}
#: Formats whose one record is the whole file.
WHOLE = ("toml", "ini")
