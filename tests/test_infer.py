"""Types of text columns from one aggregate, against the reader's own inference."""

import os
import tempfile

from marquee.operators import profile as P

COLUMNS = {
    "i": ["1", "-7", None], "l": ["1", "3000000000", "2"], "d": ["1", "2.5", "1e3"], "day": ["2020-01-31", None, "1999-12-01"],
    "t": ["2020-01-31 10:00:00", "2020-01-31", "2020-01-31T01:02:03"], "b": ["true", "FALSE", None], "s": ["1", "x", "2"],
    "none": [None, None, None], "mixed": ["1", "2020-01-31", None], "wrong_day": ["2020-01-31", "2020-13-45", None],
}


def test_equals_the_readers_inference(spark):
    rows = list(zip(*COLUMNS.values(), strict=True))
    text = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLUMNS)).repartition(3)
    path = os.path.join(tempfile.mkdtemp(prefix="marquee-infer-"), "a.csv")
    with open(path, "w") as f:
        f.write("\n".join("\t".join(x or "" for x in r) for r in rows))
    want = spark.read.option("sep", "\t").option("inferSchema", True).csv(path).toDF(*COLUMNS)
    got = {r.column_name: r for r in P.infer_types(text).collect()}
    assert {c: r.data_type for c, r in got.items()} == {f.name: f.dataType.simpleString() for f in want.schema.fields}
    assert got["s"].counter_example == "x" and got["wrong_day"].counter_example == "2020-13-45"
    assert got["i"].non_null == 2 and got["i"].counter_example is None and got["d"].fits["int"] == 1
    assert [got[c].position for c in COLUMNS] == list(range(len(COLUMNS)))


def test_no_rows_are_no_evidence(spark):
    got = P.infer_types(spark.createDataFrame([], "a string, `b c` string")).collect()
    assert [(r.column_name, r.data_type, r.non_null) for r in got] == [("a", "string", 0), ("b c", "string", 0)]
