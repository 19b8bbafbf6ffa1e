"""Reading with bad rows kept apart."""
from pyspark.sql import types as T

from contingo.sources.io import quarantine, read_checked

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])


def test_json_lines_are_in_exactly_one_frame(spark, tmp_path):
    lines = ['{"id": 1, "x": 2.5, "s": "a"}', '{"id": 2, "x": "no", "s": "b"}', '{"id": 3', '{"x": 1.0, "s": "c"}',
             '{"id": 5, "x": null, "s": null}', '{"id": 99999999999999999999, "x": 1, "s": "d"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    good, bad = read_checked(spark, str(tmp_path / "in"), "json", SCHEMA, required=("id",))
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "a"), (5, None, None)]
    found = {(r.line, r.why) for r in bad.collect()}
    assert found == {(lines[1], "malformed"), (lines[2], "malformed"), (lines[5], "malformed"), ('{"x":1.0,"s":"c"}', "id")}
    assert good.count() + bad.count() == len(lines)
    assert good.select("s").count() == 2 and bad.select("why").count() == 4         # pruned columns change nothing
    assert {r.why: r.n for r in quarantine(bad, str(tmp_path / "bad")).collect()} == {"malformed": 3, "id": 1}


def test_csv_fields_that_dont_fit(spark, tmp_path):
    text = ["id,x,s", "1,2.5,a", "two,1.0,b", "3,1.0", "4,,d", "5,1.0,e,f", ",1.0,g"]
    (tmp_path / "t.csv").write_text("\n".join(text))
    good, bad = read_checked(spark, str(tmp_path / "t.csv"), "csv", SCHEMA, required=("id",), header="true")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "a"), (4, None, "d")]
    assert sorted((r.why, r.line) for r in bad.collect())[1:] == [("malformed", "3,1.0"), ("malformed", "5,1.0,e,f"),
                                                                  ("malformed", "two,1.0,b")]
    assert good.count() == 2 and bad.count() == 4


def test_no_bad_rows_and_no_rows(spark, tmp_path):
    spark.createDataFrame([('{"id": 1, "x": 1, "s": "a"}',)], "value string").write.text(str(tmp_path / "in"))
    good, bad = read_checked(spark, str(tmp_path / "in"), "json", SCHEMA)
    assert good.count() == 1 and quarantine(bad, str(tmp_path / "bad")).collect() == []
