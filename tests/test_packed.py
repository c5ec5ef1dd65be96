from hypothesis import given
from hypothesis import strategies as st

from lotsman.operators.packed import EVEN, Reader, Weights, expected, learn, split_field, split_values, viterbi

SCHEMA = "row_id long, grnti_codes string, pos string, code_value int"


def values(field):
    return split_field(field, Reader(EVEN))


def test_quotes_and_delimiters():
    assert values('"11.04.55 ""Сводный"" раздел";\'35.59.70 прикладные, разные\' «16.67.49»/56') == ['11.04.55 "Сводный" раздел', "35.59.70 прикладные, разные", "16.67.49", "56"]
    assert values("['64.84.63','11.32.45']") == ["64.84.63", "11.32.45"]
    assert values(';; ГРНТИ: 07.29；07.01.07、n/a 123 2024 "" " "') == ["07.29", "07.01.07"]


@given(st.lists(st.from_regex(r"\A[0-9]{2}(\.[0-9]{2}){0,2}\Z"), max_size=8), st.sampled_from([";", ", ", " | ", "\n", " / ", " ", " и ", "；"]))
def test_joined_values_come_back(codes, sep):
    assert values(sep.join(codes)) == codes


def test_lattice_uses_frequencies():
    w = lambda codes: Weights(codes, 1e-6, 0.1)
    assert viterbi("64.08.3664.08.78", EVEN) == ["64.08.36", "64.08.78"]
    assert viterbi("11.22.33.44", w({"11.22": 0.4, "33.44": 0.4})) == ["11.22", "33.44"]
    assert viterbi("11.22.33.44", w({"11.22.33": 0.4, "44": 0.4})) == ["11.22.33", "44"]
    assert viterbi("11.22.33", w({"11.22": 0.5, "33": 0.5})) == ["11.22", "33"] and viterbi("11.22.33", EVEN) == ["11.22.33"]
    assert viterbi("1.2", EVEN) == [] and not expected("1.2", EVEN)
    assert abs(expected("11.22", Weights({"11.22": 0.5, "11": 0.5, "22": 0.5}, 1e-6, 0.5))["11"] - 0.2) < 1e-9
    assert abs(expected("12.34" * 3000, EVEN)["12.34"] - 3000) < 60


def test_the_column_decides(spark):
    """The same run is read by what the rest of its column holds: the learnt frequencies change the rows."""
    def read(fields, run="11.22.33.44"):
        df = spark.createDataFrame([(i, f) for i, f in enumerate([*fields, run])], "row_id long, grnti_codes string")
        return [r.code_value for r in split_values(df).where(f"row_id = {len(fields)}").orderBy("pos").collect()]

    assert read(["11.22; 33.44"] * 20) == ["11.22", "33.44"]
    assert read(["11.22.33 / 44"] * 20) == ["11.22.33", "44"]
    assert read(["11; 22.33.44"] * 20) == ["11", "22.33.44"]
    assert read(["11; 22.33"] * 50, "77.88.99") == ["77.88.99"]  # a rare code, not three frequent parts
    w = learn(spark.createDataFrame([("11.22; 33.44",)] * 20, "c string"), "c")
    assert w.joint < 0.05 and abs(w.codes["11.22"] - 0.5) < 0.05


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "56;56", "x", 9), (1, "56;56", "x", 9), (2, None, None, None), (3, "", "", 0), (4, "  ", "", 0), (5, "12.34" * 2000, "", 0)]
    got = split_values(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.row_id, r.pos) for r in got if r.row_id < 5) == [(1, 1), (1, 1), (1, 2), (1, 2)]
    assert sum(r.row_id == 5 for r in got) == 2000
    assert split_values(spark.createDataFrame([], SCHEMA)).count() == 0
