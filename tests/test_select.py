import pytest

from quarry.plans.parser import ParseError, Unsupported, parse
from quarry.select import Input, select
from quarry.sources.csv_rows import CsvFormat

REFUSED = ["GROUP BY a", "HAVING a > 1", "ORDER BY a", "UNION SELECT 1", "JOIN b", "OFFSET 1"]


@pytest.mark.parametrize("tail", REFUSED)
def test_clauses_are_refused(tail):
    with pytest.raises(Unsupported):
        parse(f"SELECT a FROM S3Object {tail}")


@pytest.mark.parametrize("item", ["DISTINCT a", "CASE WHEN a THEN 1 END", "lower(a)", "a || b", "sum(a) + 1", "count(DISTINCT a)"])
def test_expressions_are_refused(item):
    with pytest.raises(Unsupported):
        parse(f"SELECT {item} FROM S3Object")


@pytest.mark.parametrize("sql", ["", "SELECT a FROM S3Object LIMIT 0", "SELECT a FROM t", "SELECT a FROM S3Object.b"])
def test_parse_errors(sql):
    with pytest.raises(ParseError):
        parse(sql)


def lines(result):
    return [r.value for r in result.collect()]


def test_json_keeps_tokens_null_and_missing(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"name":"a","o":null,"n":1e309,"p":[{"b":1},{"b":2.50}]}\n{"name":"b","n":"x"}\n')
    own = Input("JSON_LINES")
    assert lines(select(spark, str(p), "SELECT s.name, s.o, s.n, s.p[1].b AS b FROM S3Object s", own).json()) == ['{"name":"a","o":null,"n":1e309,"b":2.50}', '{"name":"b","n":"x"}']
    assert lines(select(spark, str(p), "SELECT s.name FROM S3Object s WHERE s.o IS MISSING", own).csv()) == ["b"]
    assert lines(select(spark, str(p), "SELECT x.b FROM S3Object[*].p[*] x", own).json()) == ['{"b":1}', '{"b":2.50}', "{}"]


def test_csv_quotes_headers_comments(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('id,v,n\n#c\n1,"a,b",3\n2,"x\ny",7\n3,z,1\n')
    got = lines(select(spark, str(p), "SELECT id, v FROM S3Object WHERE n > 2", Input("CSV", csv=CsvFormat(header="USE", comments="#"))).csv())
    assert got == ['1,"a,b"', '2,"x\ny"']


def test_csv_aggregates(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("3\n7\n1\n")
    got = lines(select(spark, str(p), "SELECT count(*), min(_1), max(_1), avg(_1) FROM S3Object", Input("CSV", csv=CsvFormat(multiline=False))).csv())
    assert got == ["3,1,7,3.6666666667"]
