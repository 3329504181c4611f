import gzip
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shapewright import cli, report
from shapewright.functions import classes, codes, names
from shapewright.operators import baseline, structure
from shapewright.plans.queries import zoo
from shapewright.plans.scan import check, scan
from shapewright.sources import bytelevel as by
from shapewright.sources import readers
from shapewright.sources.listing import Limits, expand, list_files
from shapewright.sources.profile import dealt, profile
from shapewright.streaming.arrivals import watch

HEADER = ["customer_id", "order_date", "amount", "status", "notes"]
SCHEMA = "customer_id,int\norder_date,date\namount,decimal\nstatus,text\nnotes,text\n"


def orders(path, n=50, header=HEADER, change=lambda r: r, sep=",", encoding="utf-8", end="\n"):
    rng = random.Random(str(path))
    rows = [change([str(rng.randint(1000, 9999)), f"2024-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.uniform(10, 9999):.2f}", rng.choice(["PENDING", "SHIPPED"]), f"note_{i}"]) for i in range(n)]
    text = "\n".join(sep.join(r) for r in ([header] if header else []) + rows) + end
    path.write_bytes(text.encode(encoding))


@pytest.fixture
def drift(tmp_path):
    for i in range(7):
        orders(tmp_path / f"orders_{i}.csv")
    orders(tmp_path / "orders_extra.csv", header=[*HEADER, "region"], change=lambda r: [*r, "north"])
    orders(tmp_path / "orders_missing.csv", header=HEADER[:-1], change=lambda r: r[:-1])
    orders(tmp_path / "orders_renamed.csv", header=["customer_id", "order_date", "total_amount", "status", "notes"])
    (tmp_path / "baseline.schema").write_text(SCHEMA)
    return tmp_path


def by_name(verdicts):
    return {os.path.basename(v["path"]): v for v in verdicts}


def said(v):
    return [(f["reason_code"], f["severity"]) for f in v["findings"]]


def test_drift_makes_four_families(spark, drift):
    r = scan(spark, str(drift)).to_dict()
    assert [f["file_count"] for f in r["families"]] == [7, 1, 1, 1]
    assert r["accounting"] == {"files_seen": 11, "profiled": 10, "degraded": 0, "catalogued": 1, "refused": 0, "reconciles": True}
    types = by_name(r["file_verdicts"])["orders_0.csv"]["column_types"]
    assert types == dict(zip(HEADER, ["int", "date", "decimal", "text", "text"]))
    assert json.loads(json.dumps(r))["file_verdicts"] == r["file_verdicts"]
    assert "4" in report.of_scan(r) or "F0004" in report.of_scan(r)


@pytest.mark.parametrize("extra,level,part", [("strict", "ERROR", "broken"), ("open", "INFO", "warned")])
def test_check_by_name(spark, drift, extra, level, part):
    b = baseline.from_flat(str(drift / "baseline.schema"))
    r = check(spark, str(drift), b, "name", extra).to_dict()
    parts = {k: by_name(r[k]) for k in ("golden", "warned", "broken")}
    assert set(parts["golden"]) == {f"orders_{i}.csv" for i in range(7)}
    assert said(parts[part]["orders_extra.csv"]) == [("EXTRA_COLUMN", level)]
    assert said(parts["broken"]["orders_missing.csv"]) == [("MISSING_COLUMN", "ERROR")]
    renamed = parts["broken"]["orders_renamed.csv"]["findings"]
    assert [f["reason_code"] for f in renamed] == ["MISSING_COLUMN", "EXTRA_COLUMN", "COLUMN_NAME_MISMATCH"]
    assert (renamed[2]["severity"], renamed[2]["expected"], renamed[2]["found"], renamed[2]["locus"]) == ("WARN", "amount", "total_amount", "position 2")
    assert r["has_errors"] and "broken" in report.of_check(r, True)


def test_check_by_position(spark, drift):
    b = baseline.from_flat(str(drift / "baseline.schema"))
    r = check(spark, str(drift), b, "position").to_dict()
    parts = {k: by_name(r[k]) for k in ("golden", "warned", "broken")}
    assert said(parts["broken"]["orders_missing.csv"]) == [("COUNT_CHANGED", "ERROR")]
    assert said(parts["broken"]["orders_extra.csv"]) == [("COUNT_CHANGED", "ERROR")]
    assert said(parts["warned"]["orders_renamed.csv"]) == [("COLUMN_NAME_MISMATCH", "WARN")]


def test_headerless_files(spark, tmp_path):
    orders(tmp_path / "none.csv", header=None)
    (tmp_path / "numbers.csv").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "s.schema").write_text(SCHEMA)
    b = baseline.from_flat(str(tmp_path / "s.schema"))
    r = check(spark, f"{tmp_path}/none.csv", b, "name").to_dict()
    assert said(r["broken"][0]) == [("HEADERLESS_NAME_MODE", "ERROR")]
    r = check(spark, f"{tmp_path}/none.csv", b, "position").to_dict()
    assert len(r["golden"]) == 1
    v = by_name(scan(spark, f"{tmp_path}/*.csv").to_dict()["file_verdicts"])
    assert v["numbers.csv"]["has_header"] is False and v["numbers.csv"]["normalized_column_names"] == ["column0", "column1", "column2"]


def test_anomalies(spark, tmp_path):
    base = ["a,b,c"] + [f"{i},x,y" for i in range(40)]
    put = lambda n, lines, end="\n": (tmp_path / n).write_text("\n".join(lines) + end)
    put("ragged.csv", [*base[:11], "1,x,note, with comma", *base[11:]])
    put("total.csv", [*base, "TOTAL,9"])
    put("cut.csv", base * 5, "")
    put("stacked.csv", [*base, *["1,2"] * 10])
    put("fine.csv", base)
    v = by_name(scan(spark, str(tmp_path)).to_dict()["file_verdicts"])
    ragged = next(f for f in v["ragged.csv"]["findings"] if f["reason_code"] == "RAGGED_ROWS")
    assert (ragged["locus"], ragged["expected"], ragged["found"], ragged["severity"]) == ("row 12", "3", "4", "ERROR")
    assert ("MULTI_RECORD", "WARN") in said(v["ragged.csv"]) and v["ragged.csv"]["verdict"] == "broken"
    total = next(f for f in v["total.csv"]["findings"] if f["reason_code"] == "TRAILING_SUMMARY")
    assert (total["locus"], total["found"], v["total.csv"]["verdict"]) == ("row 42", "2", "conforms")
    assert ("TRUNCATED", "ERROR") in said(v["cut.csv"])
    assert {c for c, _ in said(v["stacked.csv"])} == {"RAGGED_ROWS", "TRAILING_SUMMARY", "MULTI_RECORD"}
    assert v["fine.csv"]["findings"] == [] and v["ragged.csv"]["column_types"] == {}
    aware = by_name(scan(spark, str(tmp_path / "fine.csv"), quote_aware=True).to_dict()["file_verdicts"])
    assert aware["fine.csv"]["findings"] == []


def test_quoted_commas_are_ragged_only_by_plain_counts(spark, tmp_path):
    (tmp_path / "q.csv").write_text('name,n\n' + '"a, b",1\n' + "c,2\n" * 20)
    assert ("RAGGED_ROWS", "ERROR") in said(scan(spark, str(tmp_path)).to_dict()["file_verdicts"][0])
    assert scan(spark, str(tmp_path), quote_aware=True).to_dict()["file_verdicts"][0]["findings"] == []


def test_anomalies_against_a_plain_count(spark, tmp_path):
    rng = random.Random(6)
    want = {}
    for i in range(25):
        lines = ["" if rng.random() < 0.1 else ",".join("x" * rng.choice([3, 3, 3, 3, 2, 4])) for _ in range(rng.randint(1, 30))]
        lines[0] = lines[0] or "x,x,x"
        (tmp_path / f"f{i:02}.csv").write_text("\n".join(lines) + "\n")
        want[f"f{i:02}.csv"] = lines
    v = by_name(scan(spark, str(tmp_path)).to_dict()["file_verdicts"])
    for name, lines in want.items():
        skip = int(bool(v[name]["has_header"]) and len(lines) > 1)
        data = [(rn, x.count(",")) for rn, x in enumerate(lines, 1) if rn > skip and x]
        n = [k for _, k in data]
        mode = min(set(n), key=lambda k: (-n.count(k), k)) if n else None
        odd = [rn for rn, k in data if k != mode]
        found = {f["reason_code"]: f for f in v[name]["findings"]}
        ragged = [rn for rn in odd if rn != len(lines)]
        assert ("RAGGED_ROWS" in found) == bool(ragged) and ("TRAILING_SUMMARY" in found) == (odd[-1:] == [len(lines)])
        if ragged:
            assert found["RAGGED_ROWS"]["locus"] == ", ".join(f"row {rn}" for rn in ragged[:5]) + ("..." if len(ragged) > 5 else "") and found["RAGGED_ROWS"]["confidence"] == len(ragged)
        runs = [list(g) for _, g in itertools.groupby(n)]
        assert ("MULTI_RECORD" in found) == (sum(len(g) >= 3 for g in runs) >= 2)


def test_blank_lines_have_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,a\n\n\n2,b\n3,c,d\n4,e\n")
    f = scan(spark, str(tmp_path)).to_dict()["file_verdicts"][0]["findings"]
    assert [(x["reason_code"], x["locus"]) for x in f] == [("RAGGED_ROWS", "row 6")]


def test_quotes_that_do_not_pair_up(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,name,n\n1,"never closed,2\n' + "3,b,4\n" * 3_000_000)
    (tmp_path / "head.csv").write_text('id,"name,n\n1,a,2\n3,b,4\n5,c\n6,d,7\n')
    (tmp_path / "digits.csv").write_text("id,n\n1," + "7" * 6_000 + "\n2,3\n")
    v = by_name(scan(spark, str(tmp_path)).to_dict()["file_verdicts"])
    assert v["open.csv"]["normalized_column_names"] == ["id", "name", "n"] and v["open.csv"]["bucket"] == "profiled" and v["open.csv"]["partial"]
    assert v["head.csv"]["normalized_column_names"] == ["id", "name", "n"] and ("RAGGED_ROWS", "ERROR") in said(v["head.csv"])
    assert v["digits.csv"]["column_types"] == {"id": "int", "n": "decimal"} and not v["digits.csv"]["partial"]


def test_leaves_of_nested_parquet(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [{"x": 1, "y": {"z": "s"}}], "b": [[1.5]], "c": pa.array([[("k", 2)]], pa.map_(pa.string(), pa.int32())), "d": [True]}), tmp_path / "n.parquet")
    v = scan(spark, str(tmp_path)).to_dict()["file_verdicts"][0]
    assert v["raw_column_names"] == ["x", "z", "element", "key", "value", "d"]
    assert v["column_types"] == dict(zip(v["raw_column_names"], ["int", "text", "decimal", "text", "int", "bool"]))


def test_nulls_of_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,\n2,b\n3, \n,d\n")
    got = scan(spark, str(tmp_path)).columns.orderBy("position").collect()
    assert [(r.norm_name, r.nulls, r.null_fraction) for r in got] == [("id", 1, 0.25), ("name", 2, 0.5)]


def test_bounds_are_told_of(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n" + "1,2\n" * 30)
    whole, part = (scan(spark, str(tmp_path), Limits(bounds=readers.Bounds(lines=n))).to_dict()["file_verdicts"][0] for n in (31, 30))
    assert not whole["partial"] and part["partial"]


def test_files_are_dealt_by_size():
    shares = dealt([(i, str(i), n) for i, n in enumerate([10**9, 10, 10, 10, 10, 5 * 10**8, 5 * 10**8])], 3)
    assert sorted(sum(f[2] for f in s) for s in shares)[-1] == 10**9 and len(shares) == 3 and sum(map(len, shares)) == 7


def test_many_files_give_what_few_do(spark, drift, monkeypatch):
    few = scan(spark, str(drift)).to_dict()
    monkeypatch.setattr("shapewright.sources.profile.FEW", 3)
    many = scan(spark, str(drift)).to_dict()
    assert few | {"elapsed_ms": 0} == many | {"elapsed_ms": 0}


def test_types_disagree_in_a_family(spark, tmp_path):
    for i in range(5):
        orders(tmp_path / f"a{i}.csv")
    orders(tmp_path / "b_id.csv", change=lambda r: [f"CUST-{r[0]}", *r[1:]])
    orders(tmp_path / "c_amount.csv", change=lambda r: [*r[:2], f"${r[2]}", *r[3:]])
    a, b = (scan(spark, str(tmp_path)).to_dict() for _ in range(2))
    assert len(a["families"]) == 1 and a["families"][0]["type_variants"] == 3
    assert [f["reason_code"] for f in a["scan_findings"]] == ["TYPE_MISMATCH"] * 2 and a["scan_findings"][0]["expected"] == "decimal"
    assert a["file_verdicts"] == b["file_verdicts"]
    assert {t for v in a["file_verdicts"] for t in v["column_types"].values()} <= set(classes.CLASSES)


def test_every_format_and_failing(spark, tmp_path):
    zoo(str(tmp_path))
    v = by_name(scan(spark, str(tmp_path)).to_dict()["file_verdicts"])
    got = {n: (x["format_detected"], x["bucket"]) for n, x in v.items()}
    want = {
        "plain.csv": ("csv", "profiled"), "mark.csv": ("csv", "profiled"), "wide.csv": ("csv", "profiled"), "latin.csv": ("csv", "profiled"), "tabs.tsv": ("tsv", "profiled"), "headless.csv": ("csv", "profiled"),
        "lines.jsonl": ("jsonl", "profiled"), "list.json": ("json", "profiled"), "tree.xml": ("xml", "profiled"), "late.csv": ("csv", "refused"), "packed.csv.gz": ("gzip", "profiled"), "cut.csv.gz": ("gzip", "refused"),
        "notes.md": ("text", "catalogued"), "empty.csv": ("unknown", "catalogued"), "one.zip": ("zip", "catalogued"), "nested.zip": ("zip", "catalogued"), "data.sqlite": ("sqlite", "profiled"), "book.xlsx": ("excel", "profiled"),
    }
    assert {n: got[n] for n in want} == want  # the query format_zoo has all files
    assert [v[n]["encoding"] for n in ("plain.csv", "mark.csv", "wide.csv", "latin.csv")] == ["utf-8", "utf-8-sig", "utf-16-le", "latin-1"]
    assert said(v["latin.csv"]) == [("ENCODING_FALLBACK", "WARN")] and said(v["late.csv"]) == [("DECODE_ERROR", "ERROR")]
    assert said(v["cut.csv.gz"]) == [("CORRUPT_ARCHIVE", "ERROR")] and said(v["nested.zip"]) == [("NESTED_ARCHIVE", "WARN")]
    for n in ("plain.csv", "mark.csv", "wide.csv", "tabs.tsv", "packed.csv.gz"):
        assert v[n]["normalized_column_names"] == ["id", "name", "amount"], n
    assert v["lines.jsonl"]["normalized_column_names"] == ["a", "b", "c"] and v["list.json"]["normalized_column_names"] == ["a", "d"]
    assert v["tree.xml"]["normalized_column_names"] == ["r", "r/item", "r/item/v"]
    assert v["data.sqlite"]["normalized_column_names"] == ["id", "v"] and v["book.xlsx"]["column_types"] == {"id": "int", "amount": "decimal"}
    # what can't be compared passes through a check as it is
    r = check(spark, str(tmp_path), baseline.from_ddl("create table t (id int, name text, amount decimal)")).to_dict()
    assert {"one.zip", "plain.csv"} <= set(by_name(r["golden"])) and {"late.csv", "tree.xml"} <= set(by_name(r["broken"]))


def test_characters_on_the_edges_of_samples(spark, tmp_path):
    for n in (by.HEAD - 1, by.BLOCK - 1, 2 * by.BLOCK - 1):
        body = b"a,b\n" + b"1,x\n" * ((n - 4) // 4)
        body += b"z" * (n - len(body)) + "é,1\n".encode()
        (tmp_path / f"{n}.csv").write_bytes(body)
    v = scan(spark, str(tmp_path)).to_dict()["file_verdicts"]
    assert all(x["encoding"] == "utf-8" and x["bucket"] == "profiled" for x in v)


def test_limits_globs_and_hidden_files(spark, tmp_path):
    deep = tmp_path.joinpath(*"abcdefgh")
    deep.mkdir(parents=True)
    for i in range(5):
        orders(tmp_path / f"f{i}.csv", 3)
    orders(deep / "deep.csv", 3)
    orders(tmp_path / ".hidden.csv", 3)
    orders(tmp_path / "_under.csv", 3)
    found = list_files(spark, str(tmp_path), Limits(file_count=3, total_bytes=100, depth=5))
    assert [f[0] for f in found.findings] == ["RECURSION_DEPTH_CEILING", "FILE_COUNT_CEILING", "BYTE_CEILING"] and len(found.files) == 3 and found.seen == 7
    names_ = lambda e: [os.path.basename(p) for p, _ in expand(spark, e)]
    assert names_(f"{tmp_path}/f?.csv") == [f"f{i}.csv" for i in range(5)]
    assert names_(f"{tmp_path}/**/deep.csv") == ["deep.csv"] and names_(f"{tmp_path}/f[01].csv") == ["f0.csv", "f1.csv"]
    assert names_(f"{tmp_path}/.hidden.csv") == [".hidden.csv"] and names_(f"{tmp_path}/f0.csv") == ["f0.csv"] and "_under.csv" in names_(str(tmp_path))
    none = scan(spark, f"{tmp_path}/*.nothing").to_dict()
    assert [(f["reason_code"], f["severity"]) for f in none["scan_findings"]] == [("FORMAT_UNRECOGNIZED", "WARN")] and none["accounting"]["reconciles"] and none["file_verdicts"] == []


def test_files_of_another_store(spark, tmp_path):
    orders(tmp_path / "a.csv", 5)
    (tmp_path / "b.json").write_text('[{"x": 1}]')
    r = scan(spark, f"file://{tmp_path}").to_dict()
    assert [v["normalized_column_names"] for v in r["file_verdicts"]] == [HEADER, ["x"]]
    far = [(i, f"file://{tmp_path}/{n}", 1) for i, n in enumerate(("a.csv", "b.json"))]
    assert [r.norm_names for r in profile(spark, far).orderBy("file_id").collect()] == [HEADER, ["x"]]


def test_doors(spark, tmp_path):
    flat = lambda text, name="s.schema": baseline.from_flat(_put(tmp_path / name, text))
    assert flat(SCHEMA).ordered_types == ["int", "date", "decimal", "text", "text"]
    assert flat("a\tint\n# c\n\nB  b : x\ttext\n").name_to_type == {"a": "int", "b b : x": "text"}
    assert flat("Customer_ID INT\nname TEXT\n").ordered_names == ["customer_id", "name"] and flat("x\ny\n").ordered_types == ["any", "any"]
    assert baseline.from_flat(_put(tmp_path / "t", "int\ntext\n"), type_only=True).ordered_types == ["int", "text"]
    for bad, what in (("# only\n", "contains no data lines"),):
        with pytest.raises(ValueError, match=what):
            flat(bad)
    with pytest.raises(ValueError, match="Cannot read"):
        baseline.from_flat(str(tmp_path / "missing"))
    orders(tmp_path / "g.csv", 9)
    golden = baseline.from_golden(spark, str(tmp_path / "g.csv"))
    assert golden.ordered_names == HEADER and golden.ordered_types[2] == "decimal"
    result = _put(tmp_path / "r.json", scan(spark, str(tmp_path / "g.csv")).to_json())
    assert baseline.from_result(result).columns == tuple(zip(HEADER, golden.ordered_types))
    for text, what in (("{", "Invalid JSON"), ("[]", "does not look like"), ("{}", "does not look like")):
        with pytest.raises(ValueError, match=what):
            baseline.from_result(_put(tmp_path / "bad.json", text))
    with pytest.raises(ValueError, match="golden"):
        baseline.from_golden(spark, _put(tmp_path / "e.csv", ""))
    ddl = _put(tmp_path / "d.sql", "create temp table x.`y` (id int primary key, check_no text, primary key (id), unique (id));")
    assert baseline.load(spark, ddl).name_to_type == {"id": "int", "check_no": "text"}
    assert baseline.load(spark, _put(tmp_path / "d.txt", "CREATE TABLE t (a int)")).ordered_names == ["a"]
    assert baseline.load(spark, result).column_count == 5 and baseline.load(spark, str(tmp_path / "g.csv")).column_count == 5


def _put(path, text):
    path.write_text(text)
    return str(path)


def test_command_line(spark, drift, capsys):
    assert cli.main(["scan", str(drift), "--json"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["families"]) == 4
    assert cli.main(["check", str(drift), "--against", str(drift / "baseline.schema")], spark) == 1
    assert "3 broken" in capsys.readouterr().out
    assert cli.main(["check", f"{drift}/orders_?.csv", "--against", str(drift / "baseline.schema"), "--align", "position", "--json"], spark) == 0
    assert cli.main(["check", str(drift), "--against", str(drift / "none.schema")], spark) == 2


def test_scan_findings_are_carried_on_request(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "1,2\n" * 20 + "1,2,3\n" + "1,2\n" * 20)
    b = baseline.from_ddl("create table t (a int, b int)")
    assert len(check(spark, str(tmp_path), b).to_dict()["golden"]) == 1
    assert len(check(spark, str(tmp_path), b, carry_scan_findings=True).to_dict()["broken"]) == 1


def test_stream_of_arrivals(spark, drift, tmp_path):
    b = baseline.from_flat(str(drift / "baseline.schema"))
    os.remove(drift / "baseline.schema")
    out, at = str(tmp_path / "verdicts"), str(tmp_path / "state")
    folder = tmp_path / "in"
    folder.mkdir()
    for f in drift.glob("*.csv"):
        os.rename(f, folder / f.name)
    watch(spark, str(folder), b, out, at, once=True).awaitTermination()
    orders(folder / "later.csv", header=HEADER[:-1], change=lambda r: r[:-1])
    watch(spark, str(folder), b, out, at, once=True).awaitTermination()
    got = {os.path.basename(r.path): r.partition for r in spark.read.parquet(out).collect()}
    assert len(got) == 11 and got["orders_0.csv"] == "golden" and got["later.csv"] == got["orders_extra.csv"] == "broken"


def test_values_and_names():
    assert [classes.of_value(v) for v in ("1", "-7", "1.5", "1e5", ".5", "true", "2024-01-31", "2024-13-01", "2024-01-31 10:00:00", "x", "007", "9" * 30)] == ["int", "int", "decimal", "decimal", "decimal", "bool", "date", "text", "timestamp", "text", "int", "decimal"]
    assert classes.of_value("007", True) == "text" and classes.joined(["int", "decimal"]) == "decimal" and classes.joined(["date", "timestamp"]) == "timestamp" and classes.joined(["int", "bool"]) == "text" and classes.joined([]) == "any"
    assert names.canonical("  A \t b ") == "a b"
    assert codes.severity("COLUMN_NAME_MISMATCH", "position") == "WARN" and codes.severity("RAGGED_ROWS", "name") == "ERROR"
    with pytest.raises(KeyError):
        codes.severity("COUNT_CHANGED")


def test_a_second_scan_sees_what_changed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    first = scan(spark, str(tmp_path))
    assert first.to_dict()["file_verdicts"][0]["normalized_column_names"] == ["a", "b"]
    (tmp_path / "a.csv").write_text("c,d\n1,2\n")
    assert scan(spark, str(tmp_path)).to_dict()["file_verdicts"][0]["normalized_column_names"] == ["c", "d"]
    first.release()


def test_relations(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["b", "a"], ["a", "b"]), (["a", "b", "c"], ["a"]), (["a"], ["a", "b"]), (["a", "x"], ["a", "b"]), (["x"], ["a"]), ([], [])], "a array<string>, b array<string>")
    got = df.select(structure.relation(F.col("a"), F.col("b")).alias("r"), structure.described(F.col("a"), F.col("b")).alias("d"), structure.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.r for r in got] == ["exact", "exact", "superset", "subset", "overlapping", "disjoint", "exact"]
    assert [r.d for r in got][:5] == ["exact match", "same columns, different order", "extra: [b, c]", "missing: [b]", "missing: [b]; extra: [x]"]
    assert [round(r.j, 3) for r in got] == [1, 1, 0.333, 0.5, 0.333, 0, 1]


def test_gzip_of_a_large_head():
    import io

    body = gzip.compress(os.urandom(200_000))
    assert len(by.gunzipped_head(io.BytesIO(body))) == by.HEAD
    assert readers.is_typed(5) and sum(readers.is_typed(n) for n in range(1, 10_001)) < 5_000


def test_no_engine_module_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(cli.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "shapewright.llm" in p.read_text()]
