"""Every format, from inputs that are written here."""

import gzip
import io
import json
import sqlite3
import struct
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pyarrow.parquet as pq
import pytest
import zstandard

from tabulore.cli import main
from tabulore.plans.dictionary import profile, profile_path
from tabulore.plans.render import output_format, render
from tabulore.sources import records, registry, tables

LOST = "leading zeros in raw values (likely an ID/code) - a naive numeric parse already lost them"
CODE = "leading zeros in raw values (likely an ID/code)"
MISSING = "has missing values -> wrap in Option<T> / handle nulls"
CSV = 'id,day,ok,age,balance,zip,"the ""note"""\nU1,2024-01-15,yes,34,1250.50,02134,"a, b"\nU2,2024-02-20,no,,"5,120.75",90210,"line\nbreak"\nU3,2024-03-05,yes,29,3,00501,\n'


@pytest.fixture
def held(spark, tmp_path):
    def run(name, data, **options):
        path = tmp_path / name
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        found, fmt = profile_path(spark, str(path), **options)
        return {t: {c["name"]: c for c in columns} for t, columns in found.items()}

    return run


def types(column):
    return column["current_type"], column["ideal_type"], column["missing_pct"], column["notes"]


def test_csv(held):
    got = held("people.csv", CSV)["people"]
    assert list(got) == ["id", "day", "ok", "age", "balance", "zip", 'the "note"']
    assert types(got["day"]) == ("String", "NaiveDate / DateTime", 0.0, 'all values match date format "%Y-%m-%d"')
    assert types(got["age"]) == ("i64", "i64", 33.3, MISSING) and types(got["zip"]) == ("i64", "String", 0.0, LOST)
    assert types(got["balance"]) == ("String", "f64", 0.0, "numeric strings") and types(got["ok"])[1] == "bool"
    assert got['the "note"']["sample_values"] == ["a, b", "line\nbreak"]
    assert held("people.csv", CSV, nrows=1)["people"]["age"]["missing_pct"] == 0.0
    assert held("people.csv", CSV, samples=0)["people"]["id"]["sample_values"] == ["U1"]
    only = held("head.csv", "a,b\n")["head"]
    assert types(only["a"]) == ("String", "String", 0.0, "column is empty/all null")
    blank = held("blank.csv", "a,b\n1, \n2,\n")["blank"]
    assert types(blank["b"]) == ("String", "String", 100.0, f"column is empty/all null; {MISSING}")
    assert held("semi.csv", "a;b\n1;2\n", delimiter=";")["semi"]["b"]["current_type"] == "i64"
    assert held("t.tsv", "name\tscore\ncat\t1\n")["t"]["score"]["current_type"] == "i64"
    assert held("spaced.csv", "a\n 5\n6\n")["spaced"]["a"]["current_type"] == "String"
    with pytest.raises(Exception):
        held("ragged.csv", "a,b\n1,2\n1,2,3\n")


def test_compressed(held, spark, tmp_path):
    assert list(held("people.csv.gz", gzip.compress(CSV.encode()))["people"])[0] == "id"
    assert held("n.jsonl.zst", zstandard.compress(b'{"a": 1}\n'))["n"]["a"]["current_type"] == "i64"
    assert held("n.toml.gz", gzip.compress(b"a = 1"))["n"]["a"]["current_type"] == "i64"
    with pytest.raises(Exception):
        held("bad.csv.gz", b"not gzip")


def test_fixed_width(held):
    data = "user    age zip      plan    \nU1      34  02134    gold\n\nU2          90210    silver  and more\nÜ3      29\n"
    got = held("x.txt", data, fmt="fixed-width", widths=[8, 4, 9, 8])["x"]
    assert types(got["age"])[:3] == ("i64", "i64", 33.3) and types(got["zip"]) == ("i64", "String", 33.3, f"{LOST}; {MISSING}")
    assert got["plan"]["sample_values"] == ["gold", "silver"] and got["user"]["sample_values"][2] == "Ü3"
    for bad in ({}, {"widths": []}):
        with pytest.raises(Exception, match="--widths"):
            held("x.txt", data, fmt="fwf", **bad)
    with pytest.raises(Exception, match="empty"):
        held("e.txt", "", fmt="fwf", widths=[2])


def test_logs(held):
    line = '10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 12'
    got = held("a.log", f'{line}\r\n\n- - - [10/Oct/2000:13:55:37 -0700] "odd" - -\n', fmt="common-log")["a"]
    assert got["host"]["missing_pct"] == 50.0 and got["ident"]["missing_pct"] == 100.0 and got["method"]["sample_values"] == ["GET"]
    assert got["timestamp"]["ideal_type"] == "NaiveDate / DateTime" and types(got["bytes"])[:2] == ("i64", "i64")
    both = held("b.log", f'{line} "-" ""\n', fmt="combined")["b"]
    assert both["referer"]["missing_pct"] == 100.0 and both["user_agent"]["missing_pct"] == 0.0 and both["user_agent"]["sample_values"] == [""]
    with pytest.raises(Exception, match="Common Log"):
        held("c.log", f'{line}\n{line} "-" "x"\n', fmt="clf")
    old = held("s.log", "<34>Oct 11 22:14:15 host su[12]: hi: there\n<999>Oct 11 22:14:15 host su: \n", fmt="syslog")["s"]
    assert old["facility"]["sample_values"] == ["auth", "124"] and old["pid"]["missing_pct"] == 50.0 and old["message"]["sample_values"] == ["hi: there", ""]
    new = held("n.log", '<165>1 2003-10-11T22:14:15.003Z - app - ID47 [x@1 a="b"] message\n', fmt="rfc5424")["n"]
    assert new["severity"]["sample_values"] == ["notice"] and new["hostname"]["missing_pct"] == 100.0 and new["structured_data"]["sample_values"] == ['[x@1 a="b"]']
    with pytest.raises(Exception, match="line 2"):
        held("s.log", "<34>Oct 11 22:14:15 host su: a\nbroken\n", fmt="rfc3164")


def test_json(held):
    data = '{"u": "a", "e": [{"t": "x", "n": null}, {"t": "y", "n": 5}], "m": {"r": 1}}\n\n{"u": "b", "e": [[{"t": "x"}]], "m": null}\n{"u": "c", "e": [], "z": null}\n'
    got = held("n.jsonl", data)["n"]
    assert list(got) == ["e", "e.n", "e.t", "m", "m.r", "u", "z"]
    assert types(got["e"]) == ("Vec<object>", "Vec<struct>", 0.0, "flattened into e.* below")
    assert types(got["e.n"]) == ("i64", "i64", 66.7, MISSING) and types(got["m"]) == ("object", "struct", 66.7, f"flattened into m.* below; {MISSING}")
    assert types(got["z"]) == ("null", "String", 100.0, "column is empty/all null") and got["e"]["sample_values"][0] == '{"n":null,"t":"x"}'
    mixed = held("m.json", '[{"a": 1, "b": [], "c": [1.5, "x"], "d.e": 1}, {"a": "1", "b": [null], "c": {"k": true}, "d": {"e": 2}}, {"a": 1.0}]')["m"]
    assert types(mixed["a"])[:2] == ("mixed(String: 1, f64: 1, i64: 1)", "f64") and types(mixed["b"])[:2] == ("Vec<empty>", "Vec<empty>")
    assert types(mixed["c"])[:2] == ("Vec<mixed(String: 1, f64: 1, object: 1)>", "Vec<String>") and "object fields listed separately under c.*" in mixed["c"]["notes"]
    assert mixed["a"]["sample_values"] == ["1", "1.0"]
    assert held("big.jsonl", '{"a": 18446744073709551616}\n')["big"]["a"]["current_type"] == "f64"
    for bad in ("[1]", "5\n", '{"a": NaN}\n', '{"a":\n1}', "{}\n[1]\n"):
        with pytest.raises(Exception):
            held("bad.json", bad)


def test_parquet_and_arrow(held, tmp_path, spark):
    table = pa.table({
        "zip": ["02134", "90210", None], "n": pa.array([1, 2, 3], pa.uint32()), "x": [0.5, float("nan"), 1e-7], "f": pa.array([0.1, 2.0, 3.0], pa.float32()),
        "cat": pa.array(["gold", "gold", "tin"]).dictionary_encode(), "t": pa.array([0, 1_500_000, None], pa.timestamp("us")), "d": pa.array([0, 1, 2], pa.date32()), "b": [b"\x00\xff", b"", None],
        "tags": [["a", None], [], None], "s": [{"q": 1, "r": None}, None, {"q": 3, "r": [1.5]}], "m": pa.array([[("k", "v")], [], None], pa.map_(pa.string(), pa.string())), "ok": [True, False, None],
    })
    pq.write_table(table, tmp_path / "a.parquet")
    pyarrow.feather.write_feather(table, tmp_path / "a.feather", compression="uncompressed")
    out = []
    for name in ("a.parquet", "a.feather"):
        found, _ = profile_path(spark, str(tmp_path / name))
        out.append({c["name"]: c for c in found["a"]})
    for got in out:
        assert list(got) == ["zip", "n", "x", "f", "cat", "t", "d", "b", "tags", "s", "s.q", "s.r", "m", "m.k", "ok"]
        assert types(got["zip"]) == ("String", "String", 33.3, f"{CODE}; {MISSING}") and got["cat"]["current_type"] == "String" and got["cat"]["sample_values"] == ["gold", "tin"]
        assert got["t"]["sample_values"] == ["1970-01-01T00:00:00", "1970-01-01T00:00:01.500"] and got["t"]["ideal_type"] == "String"
        assert types(got["d"])[:2] == ("Date", "NaiveDate / DateTime") and got["b"]["sample_values"] == ["00ff", ""] and got["b"]["current_type"] == "Binary"
        assert got["x"]["sample_values"] == ["0.5", "NaN", "1e-7"] and got["x"]["missing_pct"] == 0.0 and got["f"]["sample_values"] == ["0.1", "2.0", "3.0"]
        assert types(got["tags"])[:3] == ("Vec<String>", "Vec<String>", 33.3) and types(got["s"])[:2] == ("object", "struct") and types(got["s.r"])[:3] == ("Vec<f64>", "Vec<f64>", 50.0)
        assert got["m"]["current_type"] == "object" and types(got["m.k"])[:3] == ("String", "String", 50.0) and types(got["ok"])[:2] == ("bool", "bool")
    assert [c["missing_pct"] for c in profile_path(spark, str(tmp_path / "a.parquet"), nrows=2)[0]["a"]][0] == 0.0


def msgpack_of(x):
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        return struct.pack("b", x) if -32 <= x < 128 else b"\xd3" + struct.pack(">q", x) if x < 1 << 63 else b"\xcf" + struct.pack(">Q", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return b"\xc4" + bytes([len(x)]) + x
    if isinstance(x, str):
        return b"\xd9" + bytes([len(x.encode())]) + x.encode()
    if isinstance(x, list):
        return b"\xdc" + struct.pack(">H", len(x)) + b"".join(map(msgpack_of, x))
    return b"\xde" + struct.pack(">H", len(x)) + b"".join(msgpack_of(k) + msgpack_of(v) for k, v in x.items())


def cbor_of(x):
    head = lambda major, n: bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 27]) + struct.pack(">Q", n)
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(cbor_of, x))
    return head(5, len(x)) + b"".join(cbor_of(k) + cbor_of(v) for k, v in x.items())


PEOPLE = [{"id": "U1", "zip": "02134", "age": 34, "raw": b"\x01\xff"}, {"id": "U2", "zip": "90210", "age": None, 7: 1.5}, {"id": "U3", "zip": "00501", "age": 29, "x": float("nan"), "l": [1, {"k": 2}]}]


@pytest.mark.parametrize("name, encode", [("p.msgpack", msgpack_of), ("p.cbor", cbor_of)])
def test_binary_records(held, name, encode):
    for data in (b"".join(map(encode, PEOPLE)), encode(PEOPLE)):
        got = held(name, data)["p"]
        assert types(got["zip"]) == ("String", "String", 0.0, CODE) and types(got["age"])[:3] == ("i64", "i64", 33.3)
        assert got["raw"]["sample_values"] == ["01ff"] and got["7"]["current_type"] == "f64" and got["x"]["current_type"] == "null" and got["l.k"]["current_type"] == "i64"
    assert held(name, encode(PEOPLE), nrows=1)["p"]["age"]["missing_pct"] == 0.0
    for bad in (encode(5), encode([1]), encode(PEOPLE)[:-3]):
        with pytest.raises(Exception):
            held(name, bad)


def test_odd_binary_values():
    assert records.Cbor(b"\xc1\x1a\x00\x00\x00\x05").value() == {"tag(1)": 5} and records.Cbor(b"\x1b" + b"\xff" * 8).value() == str(2**64 - 1)
    assert records.Cbor(b"\x9f\x01\x7f\x61a\x61b\xff\xff").value() == [1, "ab"] and records.Cbor(b"\xf9\x3e\x00").value() == 1.5 and records.Cbor(b"\xf7").value() is None
    assert records.MessagePack(b"\xd5\x07ab").value() == "ext(7, 2 bytes)" and records.MessagePack(b"\x81\xc4\x01\xab\x01").value() == {'"ab"': 1} and records.MessagePack(b"\xcf" + b"\xff" * 8).value() == 2**64 - 1
    assert records.MessagePack(b"\xca" + struct.pack(">f", 0.1)).value() == pytest.approx(0.10000000149011612, abs=0)


def avro_file(codec):
    import zlib

    def long(n):
        n, out = n << 1 ^ n >> 63, bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])

    text = lambda s: long(len(s)) + s.encode()
    schema = {"type": "record", "name": "R", "fields": [
        {"name": "id", "type": "string"}, {"name": "m", "type": {"type": "record", "name": "M", "fields": [{"name": "risk", "type": "int"}]}}, {"name": "age", "type": ["null", "long"]}, {"name": "day", "type": {"type": "int", "logicalType": "date"}},
        {"name": "kind", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "f", "type": "float"}, {"name": "raw", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "again", "type": ["null", "M"]},
    ]}
    rows = b"".join(text(i) + long(r) + a + long(19737) + long(r % 2) + long(1) + text("t") + long(0) + struct.pack("<f", 0.5) + b"\x01\x02" + long(1) + long(9) for i, r, a in (("a", 5, long(0)), ("b", 6, long(1) + long(40))))
    raw = rows if codec == "null" else zlib.compress(rows)[2:-4]
    meta = long(2) + text("avro.schema") + (lambda s: long(len(s)) + s)(json.dumps(schema).encode()) + text("avro.codec") + text(codec) + long(0)
    return b"Obj\x01" + meta + b"S" * 16 + long(2) + long(len(raw)) + raw + b"S" * 16


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(held, codec):
    got = held("r.avro", avro_file(codec))["r"]
    assert types(got["m.risk"])[:2] == ("i64", "i64") and types(got["age"])[:3] == ("i64", "i64", 50.0) and got["day"]["sample_values"] == ["2024-01-15"]
    assert got["kind"]["sample_values"] == ["B", "A"] and types(got["tags"])[0] == "Vec<String>" and got["f"]["sample_values"] == ["0.5"] and got["raw"]["sample_values"] == ["0102"] and got["again.risk"]["sample_values"] == ["9"]
    with pytest.raises(Exception):
        held("bad.avro", b"nothing")


def test_toml_yaml_ini_xml(held):
    toml = held("c.toml", 'title = "x"\nwhen = 2024-01-15\nn = [1, 2.5]\nbad = nan\n[[s]]\nip = "1"\n[[s]]\nip = "2"\n', nrows=0)["c"]
    assert toml["when"]["ideal_type"] == "NaiveDate / DateTime" and toml["n"]["current_type"] == "Vec<mixed(f64: 1, i64: 1)>" and toml["bad"]["current_type"] == "null" and toml["s"]["current_type"] == "Vec<object>"
    yaml = held("c.yaml", "---\nid: U1\nok: yes\nzip: \"02134\"\nday: 2024-01-15\nt: 12:30\non: true\nf: 1.5\nx: .inf\nempty:\n1: one\n---\n---\nid: U2\ntag: !T 5\n")["c"]
    assert yaml["ok"]["current_type"] == "String" and yaml["zip"]["notes"].startswith(CODE) and yaml["day"]["current_type"] == "String" and yaml["t"]["sample_values"] == ["12:30"]
    assert yaml["on"]["current_type"] == "bool" and yaml["x"]["current_type"] == yaml["empty"]["current_type"] == "null" and yaml["1"]["sample_values"] == ["one"] and yaml["tag.!T"]["sample_values"] == ["5"] and yaml["id"]["missing_pct"] == 0.0
    assert len(held("l.yml", "- a: 1\n- a: 2\n")["l"]["a"]["sample_values"]) == 2
    ini = held("c.ini", "top = 1\n; note\n[a]\nk: v\nk = w\n[none]\n[b]\nz = 007\n[a]\nq = \"5\"\n")
    assert list(ini) and set(ini) == {"(default)", "a", "b"} and ini["a"]["k"]["current_type"] == "Vec<String>" and ini["a"]["q"]["sample_values"] == ["5"] and ini["b"]["z"]["notes"] == CODE
    xml = held("c.xml", '<r v="1"><p id="1" ok="true"><z>02134</z><!-- c --></p><p id="2"><z>5</z><z>6</z>text<e/></p></r>')["c"]
    assert "@v" not in xml and types(xml["@ok"])[:3] == ("String", "bool", 50.0) and xml["z"]["current_type"] == "Vec<String>" and xml["#text"]["sample_values"] == ["text"] and xml["e"]["current_type"] == "null"
    one = held("o.xml", "<r a='1'><x>1</x><y><![CDATA[ two ]]></y></r>")["o"]
    assert one["@a"]["sample_values"] == ["1"] and one["y"]["sample_values"] == ["two"]
    assert held("w.xml", "<r><x>1</x><x>2</x></r>")["w"]["#text"]["sample_values"] == ["1", "2"]
    for name, bad in (("e.ini", "[a]\n"), ("e.yaml", "5"), ("e.xml", "<r>5</r>"), ("e.toml", "= 5")):
        with pytest.raises(Exception):
            held(name, bad)


def test_numpy(held, tmp_path):
    def saved(array):
        out = io.BytesIO()
        np.save(out, array)
        return out.getvalue()

    record = np.array([(34, b"02134", True, (1, 2)), (29, b"90210", False, (3, 4))], dtype=[("age", "<i4"), ("zip", "S5"), ("ok", "?"), ("two", "<i2", 2)])
    got = held("s.npy", saved(record))["s"]
    assert types(got["age"]) == ("i64", "i64", 0.0, "") and types(got["zip"]) == ("String", "String", 0.0, CODE) and got["ok"]["ideal_type"] == "bool" and (got["two"]["current_type"], got["two"]["sample_values"]) == ("Vec<i64>", ["1;2", "3;4"])
    matrix = held("m.npy", saved(np.asfortranarray([[1.5, 2.0, 3.0], [4.5, 5.0, np.nan]])))["m"]
    assert matrix["col_0"]["sample_values"] == ["1.5", "4.5"] and types(matrix["col_1"])[:2] == ("f64", "i64") and matrix["col_2"]["sample_values"] == ["3", "NaN"]
    assert list(held("o.npy", saved(np.array([["a"], ["b"]])))["o"]) == ["value"] and held("z.npy", saved(np.float32(0.1)))["z"]["value"]["sample_values"] == ["0.1"]
    assert held("d.npy", saved(np.array(["2024-01-01"], dtype="M8[D]")))["d"]["value"]["sample_values"] == ["19723"]
    assert held("m.npy", saved(np.arange(10)), nrows=3)["m"]["value"]["sample_values"] == ["0", "1", "2"]
    out = io.BytesIO()
    np.savez(out, users=record, scores=np.arange(3))
    both = held("a.npz", out.getvalue())
    assert set(both) == {"users", "scores"} and both["scores"]["value"]["current_type"] == "i64"
    for bad in (np.zeros((2, 2, 2)), np.array([{}], dtype=object)):
        with pytest.raises(Exception):
            held("b.npy", saved(bad))


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="people" r:id="r1"/><sheet name="none" r:id="r2"/><sheet name="goods" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/><Relationship Id="r3" Target="worksheets/s3.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>id</t></si><si><t>zip</t></si><si><r><t>021</t></r><r><t>34</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", '<worksheet xmlns="m"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>1</v></c><c r="C3" t="s"><v>2</v></c></row><row r="4"><c r="B4"><v>2.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", '<worksheet xmlns="m"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/s3.xml", '<worksheet xmlns="m"><sheetData><row><c t="inlineStr"><is><t>in_stock</t></is></c></row><row><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def ods():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        cell = lambda kind, rest, text: f'<t:table-cell o:value-type="{kind}" {rest}><x:p>{text}</x:p></t:table-cell>'
        z.writestr("content.xml", f'<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="one"><t:table-row>{cell("string", "", "n")}</t:table-row><t:table-row t:number-rows-repeated="2">{cell("float", "o:value=\'3\'", "3,0")}</t:table-row><t:table-row t:number-rows-repeated="1000000"><t:table-cell t:number-columns-repeated="99"/></t:table-row></t:table></d>')
    return out.getvalue()


def test_spreadsheets(held):
    got = held("b.xlsx", xlsx())
    assert set(got) == {"people", "goods"} and types(got["people"]["zip"]) == ("i64", "String", 50.0, f"{LOST}; {MISSING}") and got["people"]["id"]["sample_values"] == ["1", "2.5"]
    assert got["goods"]["in_stock"]["current_type"] == "bool"
    assert held("b.ods", ods())["one"]["n"]["sample_values"] == ["3"]
    with pytest.raises(Exception, match="xlsx"):
        held("b.xls", b"\xd0\xcf\x11\xe0")


def test_sqlite(held, tmp_path):
    with sqlite3.connect(tmp_path / "made.db") as db:
        db.execute("CREATE TABLE events (amount REAL, note TEXT, raw BLOB, none TEXT)")
        db.executemany("INSERT INTO events VALUES (?, ?, ?, NULL)", [(1.0, "a", b"12"), ("much", "b", None), (2.5, None, b"")])
        db.execute('CREATE TABLE "users ""x""" (id INTEGER)')
        db.execute("CREATE VIEW v AS SELECT 1")
    got = held("m.sqlite", (tmp_path / "made.db").read_bytes())
    assert set(got) == {"events", 'users "x"'} and types(got["events"]["amount"])[:2] == ("mixed(String: 1, f64: 2)", "String") and got["events"]["amount"]["sample_values"] == ["1", "much", "2.5"]
    assert got["events"]["raw"]["sample_values"] == ["<blob: 2 bytes>", "<blob: 0 bytes>"] and got["events"]["none"]["current_type"] == "null" and got["events"]["note"]["missing_pct"] == 33.3
    assert held("m.db", (tmp_path / "made.db").read_bytes(), nrows=1)["events"]["amount"]["current_type"] == "f64"
    with sqlite3.connect(tmp_path / "empty.db") as db:
        db.execute("CREATE TABLE t (a)")
        db.execute("DROP TABLE t")
    with pytest.raises(Exception, match="no tables"):
        held("e.db", (tmp_path / "empty.db").read_bytes())


def dbf(rows):
    fields = [("AGE", "N", 5), ("BALANCE", "N", 9), ("ACTIVE", "L", 1), ("SIGNUP", "D", 8), ("NAME", "C", 6), ("I", "I", 4)]
    head = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in fields)
    width = 1 + sum(w for _, _, w in fields)
    return struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 32 + len(head) + 1, width) + head + b"\r" + b"".join(rows)


def test_dbase(held):
    rows = [b" " + b"   34" + b"  1250.50" + b"T" + b"20240115" + b"Ann   " + struct.pack("<i", 7), b"*" + b"x" * 33, b" " + b"     " + b"     3.00" + b"?" + b"        " + b"      " + struct.pack("<i", -1)]
    got = held("d.dbf", dbf(rows))["d"]
    assert types(got["AGE"]) == ("f64", "i64", 50.0, f"numeric strings; {MISSING}") and types(got["BALANCE"])[:3] == ("f64", "f64", 0.0) and types(got["ACTIVE"])[:3] == ("bool", "bool", 50.0)
    assert types(got["SIGNUP"])[:2] == ("Date", "NaiveDate / DateTime") and got["I"]["sample_values"] == ["7", "-1"] and got["NAME"]["missing_pct"] == 50.0


def test_stata(held, tmp_path):
    pd.DataFrame({"age": [34.0, np.nan, 29.0], "id": ["U1", " ", "U3"], "n": np.array([1, 2, 3], dtype=np.int8)}).to_stata(tmp_path / "made.dta", write_index=False)
    got = held("s.dta", (tmp_path / "made.dta").read_bytes())["s"]
    assert types(got["age"]) == ("f64", "i64", 33.3, f"numeric strings; {MISSING}") and types(got["id"])[:3] == ("String", "String", 33.3) and types(got["n"])[:2] == ("i64", "i64")


def test_sas_is_wired(held):
    assert registry.detect("x.sas7bdat") == "sas7bdat" and "sas7bdat" in tables.DECODERS
    with pytest.raises(Exception):
        held("x.sas7bdat", b"nothing")


def test_detection():
    assert registry.codec_of("a/b.csv.gz") == ("gzip", "a/b.csv") and registry.codec_of("b.json") == (None, "b.json")
    assert registry.detect("x.PQT") == "parquet" and registry.detect("x", "IPC") == "arrow_ipc" and registry.detect("x.log", "syslog") == "syslog"
    for bad in (("x.what", None), ("x", None), ("x.ipc", None), ("x.csv", "nope")):
        with pytest.raises(ValueError, match="--format"):
            registry.detect(*bad)
    with pytest.raises(ValueError, match="--output-format"):
        output_format("pdf")


def test_renderings(spark, tmp_path, capsys):
    path = tmp_path / "people.csv"
    path.write_text(CSV)
    found, fmt = profile_path(spark, str(path))
    md = render("people.csv", fmt, found, "md")
    assert md.startswith("# Data Dictionary: people.csv\n\n| Column |") and md.endswith("|\n") and not md.endswith("\n\n") and "##" not in md[3:] and "line break" in md and "| 33.3% |" in md
    assert "\n\n## a\n\n| Column" in render("x", "ini", {"b": [], "a": []}, "md")
    doc = json.loads(render("people.csv", fmt, found, "json"))
    assert (doc["file"], doc["format"]) == ("people.csv", "csv") and list(doc["tables"]["people"][0]) == ["name", "current_type", "ideal_type", "description", "missing_pct", "sample_values", "notes"]
    schema = json.loads(render("people.csv", fmt, found, "json-schema"))["tables"]["people"]
    assert schema["properties"]["age"] == {"type": ["integer", "null"]} and schema["properties"]["day"] == {"type": "string", "format": "date-time"} and "age" not in schema["required"] and "zip" in schema["required"]
    nested = [{"name": n, "ideal_type": t, "missing_pct": m} for n, t, m in (("v", "Vec<f64>", 5.0), ("s", "struct", 1.0), ("e", "Vec<empty>", 0.0))]
    got = json.loads(render("x", "json", {"t": nested}, "json-schema"))["tables"]["t"]
    assert got == {"type": "object", "properties": {"e": {"type": "array", "items": {}}, "s": {}, "v": {"type": ["array", "null"], "items": {"type": "number"}}}, "required": ["e"]}
    assert main([str(path), "-", "--output-format", "json"], spark) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["file"] == "people.csv" and said.err == "1 tables, 7 columns -> (stdout)\n"
    assert main([str(path)], spark) == 0 and (tmp_path / "people.dictionary.md").read_text() == md
    assert main([str(tmp_path / "none.what"), "-"], spark) == 1 and main([str(path), "-", "--output-format", "pdf"], spark) == 1


def test_frame(spark, tmp_path):
    (tmp_path / "people.csv").write_text(CSV)
    got = profile(spark, str(tmp_path / "people.csv"))
    assert got.columns == ["table_name", "col_ord", "name", "current_type", "ideal_type", "description", "missing_pct", "sample_values", "notes"] and got.count() == 7


def test_line_numbers_count_over_parts(spark, held):
    line = '10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 12\n'
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for at in (3, 4567, 9001):
            data = "".join("broken\n" if i == at else "\n" if i % 1000 == 0 else line for i in range(1, 9002))
            with pytest.raises(ValueError, match=rf"^line {at} doesn't match Common Log Format: broken"):
                held("a.log", data, fmt="common-log")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_array_behind_many_blank_lines(held):
    assert held("a.json", "\n" * 3000 + '  [{"a": 1},\n {"a": 2}]')["a"]["a"]["sample_values"] == ["1", "2"]


def test_avro_stops_at_nrows(held):
    assert held("r.avro", avro_file("null") + b"broken", nrows=2)["r"]["id"]["sample_values"] == ["a", "b"]
    assert held("r.avro", avro_file("null") + b"broken", nrows=1)["r"]["id"]["sample_values"] == ["a"]
    with pytest.raises(Exception):
        held("r.avro", avro_file("null") + b"broken", nrows=3)


def test_sas_values():
    assert [tables.sas_kind(True, f) for f in ("DATE9", "DATETIME20.", "TIME8", "BEST12", "", "MMDDYY10", "hhmm5")] == ["Date", "Timestamp", "Time", "f64", "f64", "Date", "Time"]
    assert tables.sas_kind(False, "DATE9") == "String"
    assert tables.sas_text(0.0, "Date") == "1960-01-01" and tables.sas_text(23390.0, "Date") == "2024-01-15" and tables.sas_text(-1.0, "Date") == "1959-12-31"
    assert tables.sas_text(86399.0, "Time") == "23:59:59" and tables.sas_text(90000.0, "Time") == "00:00:00" and tables.sas_text(1e9, "Timestamp") == "1991-09-09 01:46:40"
    assert tables.sas_text(float("nan"), "Date") is None and tables.sas_text(" ", "String") is None and tables.sas_text(2.0, "f64") == "2"


def test_samples_of_long_runs_send_little(spark, monkeypatch):
    """A sorted column whose first values fill thousands of rows: its samples come from later stretches, a few rows each."""
    from tabulore.operators import profile as module
    from tabulore.operators.leaves import column_leaves

    rows = spark.range(30_000).selectExpr("id AS rec", "array(CASE WHEN id < 9000 THEN 'a' WHEN id < 18000 THEN 'b' WHEN id < 27000 THEN 'c' ELSE cast(id AS string) END, cast(id AS string)) AS values")
    sent, collect = [], type(rows).collect

    def counted(self):
        found = collect(self)
        sent.append(len(found))
        return found

    monkeypatch.setattr(type(rows), "collect", counted)
    stats = module.value_stats(column_leaves("t", rows), 4)
    monkeypatch.undo()
    assert stats[("t", "0", False)].samples == ["a", "b", "c", "27000"] and stats[("t", "1", False)].samples == ["0", "1", "2", "3"]
    assert len(sent) >= 3 and max(sent) <= 8
