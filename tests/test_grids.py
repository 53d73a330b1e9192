"""Sheets of cells, by hand."""

from __future__ import annotations

from corvane.operators import grids


def cells(spark, sheets):
    return spark.createDataFrame([(s, r, c, v) for s, grid in sheets.items() for r, row in enumerate(grid) for c, v in enumerate(row)], "sheet string, row int, col int, value string")


def test_profiles_by_hand(spark):
    a = [["", "학  번", "", 2021001.0, "학년", "3.0", "성 명", "학년"], ["내외국인구분", "", "외국인 학생", "학적상태", "재학"], ["복수(융합)전공", "", "", "", "", "", "too far"], ["경영\n 학부", "성명", "Kim"], ["성명", "Lee"]]
    b = [["", ""], ["이수학기", "x"], ["전공", "학번"], ["0", "20191234"]]
    late = [[""]] * 10 + [["학번", "2020"]]
    found = {r["sheet"]: r for r in grids.profiles(cells(spark, {"a": [[str(v) for v in row] for row in a], "b": b, "late": late})).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"]["fields"] == {"학번": "2021001", "학년": "3", "내외국인": "외국인 학생", "학적상태": "재학", "복수전공": "경영 학부", "성명": "Kim"}
    assert (found["a"]["entry_year"], found["a"]["student_type"], found["a"]["student_group"]) == ("2021", "외국인", "2021")
    assert found["b"]["fields"] == {"이수학기": "0", "학번": "20191234"} and found["b"]["student_group"] == "2017_2020"


def test_lists_side_by_side(spark):
    grid = [["과목", "학점", "", "과목", "학점"], ["A", "3", "", "X", "2"], ["B", "", "", "", "9"], ["C", "1", "", "Z", "1"], ["", "", "", "", ""], ["D", "1"], ["과 목", "학점"], ["E", "2"], ["학점", "과목"], ["F", "2"]]
    found = {(r["block"], r["row"], tuple(r["values"])) for r in grids.two_column_rows(cells(spark, {"s": grid}), ("과목", "학점")).collect()}
    assert found == {(0, 1, ("A", "3")), (0, 2, ("B", None)), (0, 3, ("C", "1")), (3, 1, ("X", "2")), (0, 7, ("E", "2")), (0, 8, ("학점", "과목")), (0, 9, ("F", "2"))}
