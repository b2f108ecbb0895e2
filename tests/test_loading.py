"""Loading loses nothing: cells, ids, records, and the order of columns."""

from decimal import Decimal

import pytest

from plumbline.sources import files


@pytest.fixture
def written(tmp_path):
    def write(text, kind="csv"):
        path = tmp_path / f"t.{kind}"
        path.write_text(text)
        return str(path)
    return write


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_schema_goes_by_name(spark, written):
    path = written("b,a\n1,2\n")
    assert cells(files.read_csv(spark, path, "a int, b int")) == [(2, 1)]
    with pytest.raises(ValueError, match=r"lacks \['c'\] and has \['b'\]"):
        files.read_csv(spark, path, "a int, c int")


@pytest.mark.parametrize("multi_line", [True, False])
def test_too_many_cells(spark, written, multi_line):
    path = written('a,b\n1,2\n4,5,6\n7\n"8,8","9""9"\n,,\n"x,y",z,\n')
    for schema in (None, "a string, b string"):
        with pytest.raises(Exception, match="more cells than the header has"):
            files.read_csv(spark, path, schema, multi_line).collect()
        with pytest.raises(Exception, match="more cells than the header has"):
            files.read_csv(spark, path, schema, multi_line).count()
        found = files.load_csv(spark, path, schema, multi_line)
        assert cells(found.table) == [("1", "2"), ("7", None), ("8,8", '9"9')]
        assert sorted(cells(found.rejects)) == [('"x,y",z,', "cells"), (",,", "cells"), ("4,5,6", "cells")]


def test_fewer_cells_are_missing(spark, written):
    assert cells(files.read_csv(spark, written("a,b,c\n1\n1,2\n1,,3\n"), "a int, b int, c int")) == [(1, None, None), (1, 2, None), (1, None, 3)]


def test_other_separator(spark, written):
    found = files.load_csv(spark, written("a;b\n1,5;2\n1;2;3\n'x;y';2\n"), sep=";", quote="'")
    assert cells(found.table) == [("1,5", 2), ("x;y", 2)] and cells(found.rejects) == [("1;2;3", "cells")]


def test_cells_that_do_not_fit(spark, written):
    path = written("a,_record,_reason\n1,x,2020-01-01\noops,y,2020-13-01\nNA,z,\n")
    found = files.load_csv(spark, path, "_reason date, _record string, a int")
    assert [r["a"] for r in found.table.collect()] == [1, None]
    assert cells(found.rejects) == [("oops,y,2020-13-01", "type of _reason, a")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_csv(spark, path, "_reason date, _record string, a int").collect()


@pytest.mark.parametrize("values,kind", [
    (["1", "-2", "9223372036854775807"], "bigint"), (["12345678901234567891", "12345678901234567892"], "decimal(38,0)"),
    (["1" * 38, "2"], "decimal(38,0)"), (["1" * 39, "2"], "string"), (["12345678901234567891", "0.5"], "string"),
    (["1", "0.5", "1e3"], "double"), (["NA", "", "7"], "bigint")])
def test_whole_numbers_are_never_rounded(spark, written, values, kind):
    df = files.read_csv(spark, written("id\n" + "\n".join(values) + "\n"))
    assert dict(df.dtypes) == {"id": kind}
    got = [r["id"] for r in df.collect()]
    if kind == "decimal(38,0)":
        assert got == [Decimal(v) for v in values]


@pytest.mark.parametrize("text,lines,rejected", [
    ('{"id": 1}\n{"id": oops}\n{"id": 3}\n', None, ['{"id": oops}']),
    ('{"id": 1}\n{"id": "x"}\n{"id": 3}\n', None, ['{"id": "x"}']),
    ('{"id": 1}\n{"id":\n2}\n{"id": 3}\n', None, ['2}', '{"id":'])])
def test_broken_json(spark, written, text, lines, rejected):
    path = written(text, "json")
    with pytest.raises(Exception, match="broken record"):
        files.read_json(spark, path, "id int", lines).collect()
    with pytest.raises(Exception, match="broken record"):
        files.read_json(spark, path, "id int", lines).count()
    found = files.load_json(spark, path, "id int", lines)
    assert sorted(r["id"] for r in found.table.collect()) == [1, 3]
    assert sorted(r["record"].strip() for r in found.rejects.collect()) == sorted(rejected)


def test_broken_json_without_a_schema(spark, written):
    found = files.load_json(spark, written('{"id": 1}\n{"id": oops}\n', "json"))
    assert cells(found.table) == [(1,)] and [r["record"] for r in found.rejects.collect()] == ['{"id": oops}']


@pytest.mark.parametrize("text,rows", [
    ('[{"id": 1}, {"id": 2}]', [1, 2]), ('[\n {"id":\n 1},\n {"id": 2}\n]', [1, 2]), ('{"id":\n 7}', [7]), ('\n\n{"id": 1}\n{"id": 2}\n', [1, 2]), ("", [])])
def test_json_records_over_lines(spark, written, text, rows):
    path = written(text, "json")
    assert [r["id"] for r in files.read_json(spark, path, "id int").collect()] == rows
    if rows:
        assert [r["id"] for r in files.read_json(spark, path).collect()] == rows
