"""A dictionary as Markdown, JSON or JSON Schema."""

from __future__ import annotations

import json

KEYS = ("name", "current_type", "ideal_type", "description", "missing_pct", "sample_values", "notes")
OUTPUTS = {"md": "md", "markdown": "md", "json": "json", "json-schema": "json-schema", "jsonschema": "json-schema"}
EXTENSIONS = {"md": "dictionary.md", "json": "dictionary.json", "json-schema": "dictionary.schema.json"}
#: JSON Schema's type and format of an ideal type.
SCHEMA_TYPES = {"String": ("string",), "enum / category": ("string",), "i64": ("integer",), "f64": ("number",), "bool": ("boolean",), "NaiveDate / DateTime": ("string", "date-time")}


def output_format(name: str) -> str:
    if name.lower() not in OUTPUTS:
        raise ValueError(f"unknown --output-format {name!r}; use md, json or json-schema")
    return OUTPUTS[name.lower()]


def cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ")


def markdown(file: str, tables: dict[str, list[dict]]) -> str:
    parts = [f"# Data Dictionary: {file}\n"]
    for name in sorted(tables):
        rows = ["| Column | Current Type | Ideal Type | Description | Missing % | Sample Values | Notes |", "|---|---|---|---|---|---|---|"]
        for c in tables[name]:
            cells = [c["name"], c["current_type"], c["ideal_type"], c["description"], f"{c['missing_pct']:.1f}%", ", ".join(c["sample_values"]), c["notes"]]
            rows.append("| " + " | ".join(map(cell, cells)) + " |")
        parts += [f"## {cell(name)}\n"] if len(tables) > 1 else []
        parts.append("\n".join(rows) + "\n")
    return "\n".join(parts)


def as_json(file: str, fmt: str, tables: dict[str, list[dict]]) -> str:
    held = {name: [{k: c[k] for k in KEYS} for c in tables[name]] for name in sorted(tables)}
    return json.dumps({"file": file, "format": fmt, "tables": held}, indent=2, ensure_ascii=False)


def schema_of(kind: str, nullable: bool) -> dict:
    if kind.startswith("Vec<") and kind.endswith(">"):
        return {"type": ["array", "null"] if nullable else "array", "items": schema_of(kind[4:-1], False) if kind[4:-1] in SCHEMA_TYPES else {}}
    if kind not in SCHEMA_TYPES:
        return {}
    base, *form = SCHEMA_TYPES[kind]
    return {"type": [base, "null"] if nullable else base} | ({"format": form[0]} if form else {})


def table_schema(columns: list[dict]) -> dict:
    properties = {c["name"]: schema_of(c["ideal_type"], c["missing_pct"] > 0) for c in columns}
    required = [c["name"] for c in columns if c["missing_pct"] == 0]
    return {"type": "object", "properties": {k: properties[k] for k in sorted(properties)}} | ({"required": required} if required else {})


def json_schema(file: str, tables: dict[str, list[dict]]) -> str:
    held = {name: table_schema(tables[name]) for name in sorted(tables)}
    return json.dumps({"$schema": "http://json-schema.org/draft-07/schema#", "file": file, "tables": held}, indent=2, ensure_ascii=False)


def render(file: str, fmt: str, tables: dict[str, list[dict]], output: str) -> str:
    if output == "md":
        return markdown(file, tables)
    return as_json(file, fmt, tables) if output == "json" else json_schema(file, tables)
