"""P2's types against the pandas reader itself."""

import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesops.operators import profile as P

BIG = str(2**64 - 1)
CASES = {
    "whole": ["1", "2"], "missing": ["1", "NA"], "blanks": [" 1", "2 "], "plus": ["+1", "2"], "unsigned": [BIG, "1"], "unsigned and negative": [BIG, "-1"], "unsigned, missing": [BIG, "NA"],
    "beyond": [str(2**64), "1"], "below": [str(-(2**63) - 1), "1"], "unsigned, fraction": [BIG, "1.5"], "fraction": ["1.5", "2"], "power": ["1e5", "2"], "dots": [".5", "5."], "endless": ["inf", "-Infinity"],
    "flags": ["True", "fALSE"], "flags, missing": ["True", "NA"], "flag and number": ["True", "1"], "flags with blanks": [" True", "False"], "nothing": ["NULL", "NA"], "text": ["a", "1"], "missing with blanks": [" NA ", "1"],
    "tab": ["\t1", "2"], "hex": ["0x10", "1"], "comma": ["1,000", "1"], "blank": [" ", "1"], "dot": [".", "1"], "half a power": ["1e", "1"], "letter": ["1d", "1"], "fraction with blanks": [" 1.5 ", "2"], "sign": ["+", "1"],
}


def test_types_are_the_readers(spark):
    frame = pd.DataFrame(CASES)
    want = pd.read_csv(io.StringIO(frame.to_csv(index=False))).dtypes.astype(str).to_dict()
    got = P.profile_types(spark.createDataFrame(frame).repartition(2)).collect()
    assert {r.column: r.type for r in got} == want
    assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(len(CASES))) and {r.rows for r in got} == {2}


@pytest.mark.parametrize("text", [True, False])
def test_types_of_an_empty_table(spark, text):
    df = spark.createDataFrame([], "a string, b long")
    got = {r.column: (r.type, r.rows) for r in (P.profile_types(df) if text else P.profile(df)).collect()}
    assert got == ({"a": ("object", 0), "b": ("object", 0)} if text else {"a": ("object", 0), "b": ("int64", 0)})


def test_missing_values_change_typed_columns(spark):
    df = spark.createDataFrame([(1, True, "x", 1.0), (None, None, "y", None), (None, None, None, None)], "n long, f boolean, b string, d double")
    got = {r.column: (r.type, r.rows) for r in P.profile(df).collect()}
    assert got == {"n": ("float64", 2), "f": ("object", 2), "b": ("object", 2), "d": ("float64", 2)}
    text = P.profile_text(df.where("n = 1").select("n", "f"), "t.csv", ["n"]).first().context
    assert "Column types: n: int64; f: bool" in text
    assert "Column types: n: float64; f: object" in P.profile_text(df.select("n", "f").unionByName(df.limit(0).select("n", "f")).withColumn("k", F.lit(1)), "t.csv", ["k"]).first().context
