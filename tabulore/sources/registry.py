"""Formats: their names, extensions and kinds, and the compression around them."""

from __future__ import annotations

import posixpath

#: name in output: (names for the format option, extensions). Fixed values.
FORMATS = {
    "csv": (("csv",), ("csv",)),
    "tsv": (("tsv",), ("tsv",)),
    "fixed_width": (("fixed-width", "fixed_width", "fwf"), ()),
    "common_log": (("common-log", "common_log", "clf", "common"), ()),
    "combined_log": (("combined-log", "combined_log", "combined"), ()),
    "syslog": (("syslog", "syslog3164", "rfc3164"), ()),
    "syslog5424": (("syslog5424", "rfc5424"), ()),
    "json": (("json", "jsonl", "ndjson"), ("json", "jsonl", "ndjson")),
    "parquet": (("parquet",), ("parquet", "pqt")),
    "arrow_ipc": (("arrow", "feather", "ipc"), ("arrow", "feather")),
    "avro": (("avro",), ("avro",)),
    "xlsx": (("xlsx", "xls", "xlsb", "ods"), ("xlsx", "xls", "xlsb", "ods")),
    "sqlite": (("sqlite", "db"), ("db", "sqlite", "sqlite3")),
    "msgpack": (("msgpack", "mp"), ("msgpack", "mp")),
    "toml": (("toml",), ("toml",)),
    "yaml": (("yaml", "yml"), ("yaml", "yml")),
    "cbor": (("cbor",), ("cbor",)),
    "ini": (("ini",), ("ini",)),
    "xml": (("xml",), ("xml",)),
    "npy": (("npy",), ("npy",)),
    "npz": (("npz",), ("npz",)),
    "dbase": (("dbase", "dbf"), ("dbf",)),
    "stata": (("stata", "dta"), ("dta",)),
    "sas7bdat": (("sas7bdat", "sas"), ("sas7bdat",)),
}
BY_NAME = {alias: name for name, (aliases, _) in FORMATS.items() for alias in aliases}
BY_EXTENSION = {e: name for name, (_, extensions) in FORMATS.items() for e in extensions}
CODECS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd"}


def codec_of(path: str) -> tuple[str | None, str]:
    """The compression that the extension names, and the path without it; one layer."""
    stem, _, extension = posixpath.basename(path).rpartition(".")
    codec = CODECS.get(extension.lower()) if stem else None
    return (codec, path[: -len(extension) - 1]) if codec else (None, path)


def detect(logical: str, name: str | None = None) -> str:
    if name is not None:
        found = BY_NAME.get(name.lower())
        if not found:
            raise ValueError(f"unknown --format {name!r}; use one of {', '.join(sorted(BY_NAME))}")
        return found
    stem, _, extension = posixpath.basename(logical).rpartition(".")
    found = BY_EXTENSION.get(extension.lower()) if stem else None
    if not found:
        raise ValueError(f"unknown extension of {logical!r}; give --format, one of {', '.join(sorted(BY_NAME))}")
    return found


def stem_of(logical: str) -> str:
    base = posixpath.basename(logical.rstrip("/"))
    return base.rpartition(".")[0] or base
