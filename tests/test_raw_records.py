import numpy as np

from fixtura.functions.headers import field_of
from fixtura.functions.tree_edit import edit_script
from fixtura.operators import raw_records as R
from fixtura.operators import schema_drift as D

HEADER = "Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR"


def lines(spark, rows):
    return spark.createDataFrame(rows, "file_name string, line_no long, line_text string, reason string")


def test_headers_in_any_wording():
    for text, field in {"FTHG": "home_goals", "hs": "home_shots", "AS": "away_shots", "Away SOT": "away_shots_on_target", "HT Home Goals": "half_time_home_goals", "Kick-off Time": "kickoff_time", "Match Date": "match_date", "HTRes": "half_time_result", "Res": "full_time_result", "Odds1": None, "Attendance": None, "Referee": None, "": None}.items():
        assert field_of(text) == field, text


def test_reasons_nulls_repeats_and_clashing_columns(spark):
    rows = [("d_2021_1.csv", 1, HEADER, "x")]
    body = ["01/02/2021,A,B,1,0,H", '01/02/2021,A"x,B,1,0,H', "01/02/2021,A,B,1,0", "31/02/2021,A,B,1,0,H", "01/02/21, A ,B,2.0,0, h \r", "2021-02-01,NA,B,1,0,H", None, "2021-02-01,A,B,-1,0,H", '"2021-02-01","A ""q""",B,1,0,D']
    rows += [("d_2021_1.csv", i + 2, t, "x") for i, t in enumerate(body)]
    rows += [rows[3], ("nohead.csv", 2, "a,b", "x"), (None, 2, "a", "x")]
    parsed = R.parse_records(lines(spark, rows), block_lines=4).collect()
    bad = {(r.file_name, r.line_no): r.reason for r in parsed if r.reason}
    assert bad == {("d_2021_1.csv", 3): "quoting", ("d_2021_1.csv", 4): "column_count", ("d_2021_1.csv", 5): "invalid_value", ("d_2021_1.csv", 7): "invalid_value", ("d_2021_1.csv", 8): "column_count", ("d_2021_1.csv", 9): "invalid_value", ("nohead.csv", 2): "column_count"}
    assert {r.line_no for r in parsed if not r.reason} == {2, 6, 10}
    assert R.bad_lines(R.parse_records(lines(spark, rows))).count() == 7
    assert R.parse_records(lines(spark, [])).count() == 0


def test_bisection_agrees_with_the_strict_reader():
    import pyarrow as pa

    fields = [field_of(h) for h in HEADER.split(",")]
    texts = [f"{i % 28 + 1:02d}/02/2021,T{i},U,{i % 5},{'x' if i % 37 == 0 else 1},{'HDA'[i % 3]}" for i in range(500)]
    found = {n: r for who, reasons, _ in R._halves(pa.array(texts), np.arange(500), [R.code_of(fields)] * 500) for n, r in zip(who, reasons, strict=True)}
    assert found == {i: R.diagnose(t, fields)[0] for i, t in enumerate(texts)}


def test_tree_edit_distance():
    a, b = ("r", [("x", []), ("y", [("z", [])])]), ("r", [("y", [("z", []), ("w", [])])])
    cost, script = edit_script(a, b, lambda p, q: 0 if p == q else 3)
    assert cost == 2
    assert sorted(op for op, _, _ in script if op != "keep") == ["delete", "insert"]


def test_drift_between_files(spark):
    rows = [("d_2021_1.csv", 1, HEADER + ",HS"), ("d_2021_1.csv", 2, "01/02/2021,A,B,1,0,H,7"), ("d_2021_2.csv", 1, HEADER.replace("FTHG", "HomeGoals") + ",HS,HC"), ("d_2021_2.csv", 2, "01/02/2021,A,B,1,0,H,7.5,3"), ("d_2122_1.csv", 1, HEADER + ",HS"), ("d_2122_1.csv", 2, "01/02/2021,A,B,1,0,H,NA")]
    got = {tuple(r) for r in D.drift_report(spark.createDataFrame(rows, "file_name string, line_no long, line_text string")).filter("change_kind != 'moved'").select("file_name", "field_name", "change_kind").collect()}
    assert got == {("d_2021_2.csv", "home_goals", "renamed"), ("d_2021_2.csv", "home_shots", "retyped"), ("d_2021_2.csv", "home_corners", "added"), ("d_2122_1.csv", "home_goals", "renamed"), ("d_2122_1.csv", "home_corners", "removed")}
    table = D.consistent_table(R.parse_records(spark.createDataFrame(rows, "file_name string, line_no long, line_text string"), D.compile_projections(spark.createDataFrame(rows, "file_name string, line_no long, line_text string"))))
    assert {(r.file_name, r.home_shots) for r in table.collect()} == {("d_2021_1.csv", 7), ("d_2021_2.csv", 7), ("d_2122_1.csv", None)}


def test_wordings_in_no_list_are_decided_by_the_edit_distance(spark):
    assert field_of("HomeGoalz") is None and field_of("Home Shotss") is None
    assert D.assign_fields(["Date", "HomeTeam", "AwayTeam", "HomeGoalz", "FTAG", "FTR", "Home Shotss", "Homepage"]) == ("match_date", "home_team", "away_team", "home_goals", "away_goals", "full_time_result", "home_shots", None)
    # a column that says so itself is dearer to part with than one that is only like it
    assert D.assign_fields(["HomeGoalz", "FTHG"]) == (None, "home_goals")
    rows = [("d_2021_1.csv", 1, HEADER), ("d_2021_1.csv", 2, "01/02/2021,A,B,1,0,H"), ("d_2021_2.csv", 1, HEADER.replace("FTHG", "HomeGoalz")), ("d_2021_2.csv", 2, "01/02/2021,A,B,3,0,H")]
    lines_ = spark.createDataFrame(rows, "file_name string, line_no long, line_text string")
    assert [tuple(r) for r in D.drift_report(lines_).collect()] == [("d_2021_2.csv", "home_goals", "renamed", "FTHG", "HomeGoalz")]
    table = D.consistent_table(R.parse_records(lines_, D.compile_projections(lines_)))
    assert {(r.file_name, r.home_goals) for r in table.collect()} == {("d_2021_1.csv", 1), ("d_2021_2.csv", 3)}


def test_moves_come_from_the_script():
    columns = lambda names: [{"field": f, "header": f, "kind": None, "position": i} for i, f in enumerate(names)]
    was, now = columns(["match_date", "home_team", "away_team", "home_goals"]), columns(["home_goals", "match_date", "home_team", "away_team"])
    assert D.schema_changes(was, now) == [("home_goals", "moved", None, None)]
    assert D.schema_changes(was, was) == []
