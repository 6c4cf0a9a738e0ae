import pytest

from netweave.session import small_table
from netweave.sources import header_names, read_flows, read_flows_reported, read_table, write_csv, write_report, write_table


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_header_blanks_and_missing_files(spark, tmp_path):
    a = _write(tmp_path / "a.csv", " x , y\n1, 2\n")
    df = read_flows(spark, [a, str(tmp_path / "absent.csv")])
    assert df.columns == ["x", "y"] and df.first().asDict() == {"x": "1", "y": "2"}
    with pytest.raises(FileNotFoundError):
        read_flows(spark, [str(tmp_path / "absent.csv")])


def test_headerless_with_names_and_schema(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "1,tcp\n2,udp\n")
    df = read_flows(spark, a, "duration double, protocol_type string", header=False)
    assert df.agg({"duration": "sum"}).first()[0] == 3.0
    assert read_flows(spark, a, header=False, names=["p", "q"]).columns == ["p", "q"]


def test_names_from_a_side_file_replace_the_header(spark, tmp_path):
    names = header_names(spark, _write(tmp_path / "names.csv", "first, second ,\n"))
    df = read_flows(spark, _write(tmp_path / "b.csv", "p,q\n5,6\n"), names=names)
    assert names == ["first", "second"] and [tuple(r) for r in df.collect()] == [("5", "6")]


def test_files_with_different_columns(spark, tmp_path):
    a, b = _write(tmp_path / "a.csv", "x,y\n1,2\n"), _write(tmp_path / "b.csv", " y,z\n3,4\n")
    got = {tuple(r) for r in read_flows(spark, [a, b]).select("x", "y", "z").collect()}
    assert got == {("1", "2", None), (None, "3", "4")}


def test_columns_are_found_by_name(spark, tmp_path):
    """The order of a file's columns does not matter, with a schema either."""
    a = _write(tmp_path / "a.csv", "p,q\n1,2\n")
    b = _write(tmp_path / "b.csv", " q , p,extra\n20,10,x\n")
    c = _write(tmp_path / "c.csv", "q\n200\n")
    df = read_flows(spark, [a, b, c], "p double, q double")
    assert sorted(map(tuple, df.collect()), key=str) == [(1.0, 2.0), (10.0, 20.0), (None, 200.0)]
    assert read_flows(spark, [b, a], "p double, q double", columns=["q"]).agg({"q": "sum"}).first()[0] == 22.0


def test_unreadable_files_are_reported(spark, tmp_path):
    a, empty = _write(tmp_path / "a.csv", "p,q\n1,2\n"), _write(tmp_path / "empty.csv", "")
    paths = [str(tmp_path / "absent.csv"), empty, a]
    df, skipped = read_flows_reported(spark, paths, "p int, q int")
    assert df.count() == 1 and sorted(skipped) == sorted(paths[:2]) and all(skipped.values())
    with pytest.warns(UserWarning, match="absent.csv"):
        read_flows(spark, paths)
    with pytest.raises(FileNotFoundError):
        read_flows(spark, paths, skip_missing=False)


def test_projection_reaches_the_scan(spark, tmp_path):
    write_table(spark.range(10).selectExpr("id", "id * 2 AS b", "id % 2 AS c"), str(tmp_path / "t"), ["c"])
    df = read_table(spark, str(tmp_path / "t"), ["b"])
    assert "ReadSchema: struct<b:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_sinks_do_not_overwrite(spark, tmp_path):
    df = spark.range(3)
    write_csv(df, str(tmp_path / "c"))
    with pytest.raises(Exception, match="exists"):
        write_csv(df, str(tmp_path / "c"))
    paths = write_report({"Class Summary": df, "nulls": df}, str(tmp_path / "r"))
    assert [p.split("/")[-1] for p in paths] == ["class_summary", "nulls"]
    assert spark.read.parquet(paths[0]).count() == 3


def test_small_tables_are_local(spark):
    df = small_table(spark, [(1, None, "x")], "a int, b double, c string")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert small_table(spark, [], "a int").count() == 0
