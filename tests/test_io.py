"""Files: CSV, JSON, Parquet and Delta tables, and what is refused."""

import gzip
import json
import os
import threading

import pytest

from lumenframe import Engine, errors
from lumenframe.catalog import Dataset
from lumenframe.sources import delta
from lumenframe.sources.readers import guess_delimiter, guess_header

from .test_operations import code, make, ok, values


def types(r):
    return [(c.name, c.type) for c in r.schema]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_dialects(engine, tmp_path):
    r = ok(engine, "load_csv", path=write(tmp_path / "a.csv", 'id;when;x;ok\n1;2024-01-02;1.5;true\n2;2024-02-03;;false\n'), dataset_id="a")
    assert types(r) == [("id", "BIGINT"), ("when", "DATE"), ("x", "DOUBLE"), ("ok", "BOOLEAN")] and r.preview_rows[1]["x"] is None and r.stats.bytes_scanned > 0
    r = ok(engine, "load_csv", path=write(tmp_path / "b.csv", "1\t2\n3\t4\n"), dataset_id="b")
    assert types(r) == [("column0", "BIGINT"), ("column1", "BIGINT")] and r.row_count == 2
    r = ok(engine, "load_csv", path=write(tmp_path / "c.csv", 'a,b\n"x\ny",NA\n"say ""hi""",2\n'), dataset_id="c", null_string="NA")
    assert values(r, "a", "b") == [("x\ny", None), ('say "hi"', 2)]
    r = ok(engine, "load_csv", path=write(tmp_path / "d.csv", "a|b\n1|2024-01-01 10:00:00\n"), dataset_id="d", columns={"A": "VARCHAR"})
    assert types(r) == [("a", "VARCHAR"), ("b", "TIMESTAMP")]
    r = ok(engine, "load_csv", path=write(tmp_path / "e.csv", "a,b\n1,2\n"), dataset_id="e", header=False)
    assert r.row_count == 2 and types(r)[0] == ("column0", "VARCHAR")
    r = ok(engine, "load_csv", path=write(tmp_path / "f.csv", "a\n1\n2\nx\n"), dataset_id="f", sample_size=-1)
    assert types(r) == [("a", "VARCHAR")] and r.row_count == 3
    assert code(engine, "load_csv", path=str(tmp_path / "a.csv"), dataset_id="x", quote="ab") == errors.INVALID_ARGUMENT
    assert code(engine, "load_csv", path=str(tmp_path / "a.csv"), dataset_id="x", sample_size=0) == errors.INVALID_ARGUMENT
    assert code(engine, "load_csv", path=str(tmp_path / "a.csv"), dataset_id="x", columns={"id": "INT;DROP"}) == errors.INVALID_ARGUMENT
    assert code(engine, "load_csv", path=str(tmp_path / "a.csv"), dataset_id="x", columns={"nope": "INT"}) == errors.COLUMN_NOT_FOUND
    assert code(engine, "load_csv", path=" ", dataset_id="x") == errors.FILE_NOT_FOUND
    assert code(engine, "load_csv", path=str(tmp_path / "no*.csv"), dataset_id="x") == errors.BACKEND_ERROR


def test_sniffing():
    assert guess_delimiter("a,b;c\n1,2;3\n", '"') == "," and guess_delimiter("a\n1\n", '"') == ","
    assert guess_header("name,age\nann,3\n", ",", '"') and not guess_header("1,2\n3,4\n", ",", '"')


def test_json(engine, tmp_path):
    r = ok(engine, "load_json", path=write(tmp_path / "d.ndjson", '{"z":1,"a":{"x":1,"y":"t"},"l":[1,2]}\n{"z":2,"a":null,"l":null}\n'), dataset_id="n")
    assert types(r) == [("z", "BIGINT"), ("a", "STRUCT(x BIGINT, y VARCHAR)"), ("l", "BIGINT[]")] and r.row_count == 2
    r = ok(engine, "load_json", path=write(tmp_path / "a.json", '[{"b":1,"a":2},\n {"b":3,"a":4}]'), dataset_id="m")
    assert [c.name for c in r.schema] == ["b", "a"] and r.row_count == 2
    r = ok(engine, "with_column", dataset_id="n", name="y", expression={"op": "struct_field", "field": "Y", "args": [{"column": "a"}]}, into="s")
    assert values(r, "y") == [("t",), (None,)]
    assert code(engine, "with_column", dataset_id="n", name="y", expression={"op": "struct_field", "field": "q", "args": [{"column": "a"}]}) == errors.COLUMN_NOT_FOUND
    assert types(ok(engine, "unnest", dataset_id="n", column="a", into="u"))[-2:] == [("x", "BIGINT"), ("y", "VARCHAR")]
    assert code(engine, "load_json", path=str(tmp_path / "a.json"), dataset_id="x", format="xml") == errors.INVALID_ARGUMENT


def test_parquet_folders(engine, spark, tmp_path):
    base = tmp_path / "hive"
    spark.createDataFrame([(1, "a")], "x int, k string").write.partitionBy("k").parquet(str(base / "p"))
    spark.createDataFrame([(2, 3.0)], "x int, y double").write.parquet(str(base / "p" / "k=b"))
    assert [c.name for c in ok(engine, "load_parquet", path=str(base / "p"), dataset_id="h", union_by_name=True).schema] == ["x", "y", "k"]
    r = ok(engine, "load_parquet", path=str(base / "p" / "*" / "*.parquet"), dataset_id="g", union_by_name=True)
    assert r.row_count == 2 and sorted(values(r, "x", "k")) == [(1, "a"), (2, "b")]
    assert [c.name for c in ok(engine, "load_parquet", path=str(base / "p"), dataset_id="n", hive_partitioning=False, union_by_name=True).schema] == ["x", "y"]
    assert code(engine, "load_parquet", path=str(tmp_path / "none.parquet"), dataset_id="x") == errors.FILE_NOT_FOUND


def test_exports(engine, spark, tmp_path):
    make(engine, spark, "t", [(1, "a,b", None), (2, 'q"', 2.5)], "id long, s string, d double")
    for fmt, more in (("csv", {}), ("json", {}), ("json", {"array": True}), ("parquet", {"compression": "zstd"})):
        path = str(tmp_path / f"out-{fmt}{len(more)}")
        r = ok(engine, "export", dataset_id="t", path=path, format=fmt, **more)
        assert r.warnings == [f"Exported 2 rows to {path} ({fmt})."] and not r.preview_rows and os.path.isfile(path)
        back = ok(engine, f"load_{fmt}", path=path, dataset_id="back")
        assert values(back, "id", "s", "d") == [(1, "a,b", None), (2, 'q"', 2.5)]
        assert code(engine, "export", dataset_id="t", path=path, format=fmt, **more) == errors.TARGET_EXISTS
        ok(engine, "export", dataset_id="back", path=path, format=fmt, mode="overwrite", **more)
        assert ok(engine, f"load_{fmt}", path=path, dataset_id="again").row_count == 2
    assert '"d":null' in open(tmp_path / "out-json0").read() and json.load(open(tmp_path / "out-json1"))[0]["d"] is None
    ok(engine, "export", dataset_id="t", path=str(tmp_path / "parts"), format="parquet", partition_by=["s"])
    assert sorted(values(ok(engine, "load_parquet", path=str(tmp_path / "parts"), dataset_id="p"), "id", "s")) == [(1, "a,b"), (2, 'q"')]
    path = str(tmp_path / "semi.csv")
    ok(engine, "export", dataset_id="t", path=path, format="csv", delimiter=";", header=False, quote="'")
    assert open(path).read().splitlines()[0] == "1;a,b;"
    left = [n for n in os.listdir(tmp_path) if ".tmp-" in n or ".old-" in n]
    assert not left


@pytest.mark.parametrize(
    "params,expected",
    [
        ({"format": "csv", "array": True}, errors.INVALID_ARGUMENT), ({"format": "csv", "mode": "append"}, errors.INVALID_ARGUMENT), ({"format": "parquet", "compression": "g z"}, errors.INVALID_TYPE), ({"format": "csv", "compression": "gzip"}, errors.INVALID_ARGUMENT),
        ({"format": "delta", "compression": "zstd"}, errors.INVALID_ARGUMENT), ({"format": "json", "partition_by": ["id"]}, errors.INVALID_ARGUMENT), ({"format": "json", "header": True}, errors.INVALID_ARGUMENT), ({"format": "csv", "delimiter": "ab"}, errors.INVALID_ARGUMENT), ({"format": "xml"}, errors.INVALID_ARGUMENT),
    ],
)
def test_refused_exports(engine, spark, tmp_path, params, expected):
    make(engine, spark, "t", [(1,)], "id long")
    assert code(engine, "export", dataset_id="t", path=str(tmp_path / "x"), **params) == expected


def test_path_policy(spark, tmp_path):
    class Only:
        def can_read(self, path):
            return path.startswith(str(tmp_path / "in"))

        can_write = can_read

    e = Engine(spark, path_policy=Only())
    (tmp_path / "in").mkdir()
    write(tmp_path / "out.csv", "a\n1\n")
    os.symlink(tmp_path / "out.csv", tmp_path / "in" / "link.csv")
    for path in (tmp_path / "out.csv", tmp_path / "in" / ".." / "out.csv", tmp_path / "in" / "link.csv"):
        assert code(e, "load_csv", path=str(path), dataset_id="x") == errors.PERMISSION_DENIED
    ok(e, "load_csv", path=write(tmp_path / "in" / "a.csv", "a\n1\n"), dataset_id="a")
    assert code(e, "export", dataset_id="a", path=str(tmp_path / "b.csv"), format="csv") == errors.PERMISSION_DENIED


def test_delta_round_trip_append_and_time_travel(engine, spark, tmp_path):
    make(engine, spark, "t", [(1, "a"), (2, None)], "id long, s string")
    path = str(tmp_path / "tab")
    ok(engine, "export", dataset_id="t", path=path, format="delta")
    log = delta.Log(spark, path)
    first = log.commits()[0]
    stats = [json.loads(a["add"]["stats"]) for a in log.actions(first) if "add" in a]
    assert sum(s["numRecords"] for s in stats) == 2 and sum(s["nullCount"].get("s", 0) for s in stats) == 1
    ok(engine, "export", dataset_id="t", path=path, format="delta", mode="append")
    assert ok(engine, "load_delta", path=path, dataset_id="d").row_count == 4
    assert ok(engine, "load_delta", path=path, dataset_id="d", version=0).row_count == 2
    assert ok(engine, "load_delta", path=path, dataset_id="d", timestamp="2999-01-01T00:00:00").row_count == 4
    assert code(engine, "load_delta", path=path, dataset_id="d", timestamp="1999-01-01") == errors.BACKEND_ERROR
    assert code(engine, "load_delta", path=path, dataset_id="d", version=9) == errors.BACKEND_ERROR
    assert code(engine, "load_delta", path=path, dataset_id="d", version=0, timestamp="2020-01-01") == errors.INVALID_TYPE
    assert code(engine, "load_delta", path=path, dataset_id="d", timestamp="soon") == errors.INVALID_TYPE
    make(engine, spark, "u", [(1, 2.0)], "id long, s double")
    assert code(engine, "export", dataset_id="u", path=path, format="delta", mode="append") == errors.SCHEMA_MISMATCH
    assert code(engine, "export", dataset_id="t", path=path, format="delta") == errors.TARGET_EXISTS
    ok(engine, "export", dataset_id="u", path=path, format="delta", mode="overwrite")
    assert ok(engine, "load_delta", path=path, dataset_id="d").row_count == 1 and list(delta.Log(engine.spark, path).commits()) == [0]
    assert code(engine, "export", dataset_id="u", path=str(tmp_path / "new"), format="delta", mode="append") == errors.FILE_NOT_FOUND
    make(engine, spark, "nested", [([1],)], "xs array<int>")
    assert code(engine, "export", dataset_id="nested", path=str(tmp_path / "n"), format="delta") == errors.INVALID_TYPE
    assert not [n for n in os.listdir(tmp_path) if ".tmp-" in n or ".old-" in n]


def test_delta_partitions(engine, spark, tmp_path):
    make(engine, spark, "t", [(1, "a b/c%", 5), (2, None, 6), (3, "z", 7)], "id long, k string, n int")
    path = str(tmp_path / "tab le")
    ok(engine, "export", dataset_id="t", path=path, format="delta", partition_by=["k"])
    stats = {a["add"]["partitionValues"]["k"]: json.loads(a["add"]["stats"]) for a in delta.Log(engine.spark, path).actions(delta.Log(engine.spark, path).commits()[0]) if "add" in a}
    assert {k: (s["numRecords"], s["minValues"]["n"]) for k, s in stats.items()} == {"a b/c%": (1, 5), None: (1, 6), "z": (1, 7)}
    ok(engine, "export", dataset_id="t", path=path, format="delta", mode="append")
    r = ok(engine, "load_delta", path=path, dataset_id="d")
    assert [c.name for c in r.schema] == ["id", "k", "n"] and sorted(values(r, "id", "k"), key=str) == sorted([(1, "a b/c%"), (2, None), (3, "z")] * 2, key=str)
    assert code(engine, "load_delta", path=path, dataset_id="d", version=0) == errors.BACKEND_ERROR


def commit(folder, version, *actions):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{version:020d}.json").write_text("".join(json.dumps(a) + "\n" for a in actions))


@pytest.mark.parametrize(
    "action", [{"protocol": {"minReaderVersion": 3}}, {"metaData": {"configuration": {"delta.columnMapping.mode": "name"}}}, {"add": {"path": "a.parquet", "deletionVector": {"x": 1}}}, {"add": {"path": "s3://b/a.parquet"}}]
)
def test_delta_guards(engine, tmp_path, action):
    commit(tmp_path / "t" / "_delta_log", 0, action)
    assert code(engine, "load_delta", path=str(tmp_path / "t"), dataset_id="d") == errors.BACKEND_ERROR


def test_delta_replay(engine, spark, tmp_path):
    root = tmp_path / "t"
    for k in range(3):
        spark.createDataFrame([(k,)], "id int").coalesce(1).write.parquet(str(root / f"f {k}"))
    files = [f"f%20{k}/" + next(n for n in os.listdir(root / f"f {k}") if n.endswith(".parquet")) for k in range(3)]
    log = root / "_delta_log"
    commit(log, 0, {"commitInfo": {"timestamp": 1_000}}, {"add": {"path": files[0]}}, {"add": {"path": files[1]}})
    commit(log, 1, {"commitInfo": {"timestamp": 2_000}}, {"remove": {"path": files[0]}}, {"add": {"path": files[2]}})
    commit(log, 2, {"commitInfo": {"timestamp": 3_000}}, *({"remove": {"path": f}} for f in files))
    assert sorted(values(ok(engine, "load_delta", path=str(root), dataset_id="d", version=1), "id")) == [(1,), (2,)]
    assert sorted(values(ok(engine, "load_delta", path=str(root), dataset_id="d", timestamp="1970-01-01T00:00:01.5"), "id")) == [(0,), (1,)]
    assert code(engine, "load_delta", path=str(root), dataset_id="d") == errors.BACKEND_ERROR
    (log / "_last_checkpoint").write_text("{}")
    assert code(engine, "load_delta", path=str(root), dataset_id="d", version=1) == errors.BACKEND_ERROR
    assert code(engine, "load_delta", path=str(tmp_path / "no"), dataset_id="d") == errors.FILE_NOT_FOUND
    (tmp_path / "plain").mkdir()
    assert code(engine, "load_delta", path=str(tmp_path / "plain"), dataset_id="d") == errors.FILE_NOT_FOUND


def test_concurrent_appends(engine, spark, tmp_path):
    make(engine, spark, "t", [(1,)], "id long")
    path = str(tmp_path / "race")
    ok(engine, "export", dataset_id="t", path=path, format="delta")
    frame, failed = engine.catalog.get("t").frame, []

    def run():
        try:
            delta.append(frame, path, [])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(delta.Log(engine.spark, path).commits()) == list(range(7)) and ok(engine, "load_delta", path=path, dataset_id="d").row_count == 7
    assert not delta.Log(engine.spark, path).put(3, [])


def test_stream_applies_stateless_steps(spark, tmp_path):
    from lumenframe.errors import FrameError
    from lumenframe.streaming import apply_stream, write_stream

    spark.createDataFrame([(k, f"n{k}") for k in range(10)], "id long, s string").write.parquet(str(tmp_path / "in"))
    frame = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    steps = [("dataframe_filter", {"predicate": {"column": "id", "op": "gte", "value": 5}}), ("dataframe_with_column", {"name": "t", "expression": {"op": "upper", "args": [{"column": "s"}]}})]
    q = write_stream(apply_stream(frame, steps), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["t"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"N{k}" for k in range(5, 10)]
    with pytest.raises(FrameError):
        apply_stream(frame, [("dataframe_sort", {"by": [{"column": "id"}]})])


def test_line_ends_in_quotes_are_found_wherever_they_are(engine, tmp_path):
    file = tmp_path / "late.csv"
    file.write_text("id,text\n" + "".join(f"{k},short\n" for k in range(12_000)) + '99999,"two\nlines"\n')
    r = ok(engine, "load_csv", path=str(file), dataset_id="x")
    assert r.row_count == 12_001 and ok(engine, "filter", dataset_id="x", into="y", predicate={"column": "id", "op": "eq", "value": 99999}).preview_rows == [{"id": 99999, "text": "two\nlines"}]


def test_compressed_files(engine, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("id;name\n" + "".join(f"{k};n{k}\n" for k in range(50)))
    r = ok(engine, "load_csv", path=str(tmp_path / "a.csv.gz"), dataset_id="x")
    assert r.row_count == 50 and [(c.name, c.type) for c in r.schema] == [("id", "BIGINT"), ("name", "VARCHAR")]
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write("".join(json.dumps({"z": k, "a": str(k)}) + "\n" for k in range(9)))
    r = ok(engine, "load_json", path=str(tmp_path / "a.json.gz"), dataset_id="x")
    assert r.row_count == 9 and [c.name for c in r.schema] == ["z", "a"]


@pytest.mark.parametrize("array", [False, True])
def test_late_json_keys_keep_their_order(engine, tmp_path, array):
    rows = [{"z": "x" * 90, "a": k} for k in range(1_500)] + [{"z": "x", "a": 1, "y": 2, "b": 3}]
    text = json.dumps(rows) if array else "".join(json.dumps(r) + "\n" for r in rows)
    (tmp_path / "late.json").write_text(text)
    assert [c.name for c in ok(engine, "load_json", path=str(tmp_path / "late.json"), dataset_id="x").schema] == ["z", "a", "y", "b"]


@pytest.fixture
def remote(engine, tmp_path):
    """A folder by a scheme that the driver's own file functions can't open."""
    conf = engine.spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tests.link./data", f"file://{tmp_path}")
    conf.set("fs.viewfs.impl.disable.cache", "true")
    return "viewfs://tests/data"


def test_remote_exports_and_loads(engine, remote, tmp_path):
    engine.catalog.put(Dataset("d", engine.spark.createDataFrame([(k, f"n{k}", k % 2) for k in range(9)], "id long, name string, k int"), "test", 9))
    for fmt, more in (("csv", {}), ("json", {}), ("json", {"array": True}), ("parquet", {}), ("parquet", {"many_files": True}), ("delta", {}), ("parquet", {"partition_by": ["k"]}), ("delta", {"partition_by": ["k"]})):
        path = f"{remote}/out-{fmt}-{'-'.join(more)}"
        ok(engine, "export", dataset_id="d", path=path, format=fmt, **more)
        assert os.path.exists(path.replace(remote, str(tmp_path)))
        assert code(engine, "export", dataset_id="d", path=path, format=fmt, **more) == errors.TARGET_EXISTS
        ok(engine, "export", dataset_id="d", path=path, format=fmt, mode="overwrite", **more)
        r = ok(engine, f"load_{fmt}", path=path, dataset_id="back")
        assert r.row_count == 9 and {c.name for c in r.schema} == {"id", "name", "k"} and {(x["id"], x["k"]) for x in r.preview_rows} == {(k, k % 2) for k in range(9)}
    ok(engine, "export", dataset_id="d", path=f"{remote}/out-delta-", format="delta", mode="append")
    assert ok(engine, "load_delta", path=f"{remote}/out-delta-", dataset_id="two").row_count == 18
    assert ok(engine, "load_delta", path=f"{remote}/out-delta-", dataset_id="one", version=0).row_count == 9
    assert code(engine, "load_parquet", path=f"{remote}/nothing", dataset_id="x") == errors.FILE_NOT_FOUND
    assert not [n for n in os.listdir(tmp_path) if "tmp-" in n or "old-" in n]
