import urllib.error

import pytest

from fixtura.plans import pipeline
from fixtura.sources import client, files


def test_files(spark, tmp_path):
    files.save_raw(b"Date,Home\n01/02/2021,NA\n02/02/2021, x ,extra\n", str(tmp_path), "a.csv")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), ("Date",)).collect()] == [("01/02/2021", None), ("02/02/2021", "x")]
    with pytest.raises(files.SourceError, match="Away"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ("Away",))
    files.write_parquet(spark.createDataFrame([("2019/20", 1)], "season string, a long"), str(tmp_path / "b/season=1920"))
    files.write_parquet(spark.createDataFrame([("2020/21", 1.5)], "season string, b double"), str(tmp_path / "b/season=2021"))
    assert {r.season for r in files.read_seasons(spark, str(tmp_path / "b")).collect()} == {"2019/20", "2020/21"}
    assert files.read_optional(spark, str(tmp_path / "none"), "a long").count() == 0
    assert files.read_report(str(files.write_report({"a": 1}, str(tmp_path / "r.json")))) == {"a": 1}


def test_client():
    calls = []

    def flaky(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise TimeoutError
        return b'{"matches": []}'

    assert client.fetch("http://x/y", pause=0, opener=flaky) == b'{"matches": []}' and len(calls) == 3

    def refused(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 429, "slow down", {}, None)

    with pytest.raises(client.RateLimited):
        client.MatchApi("http://x", "t", refused).matches("PL", status="FINISHED")


def test_pipeline(tmp_path):
    def fail():
        raise ValueError("no")

    fine = pipeline.run_stages("data", [pipeline.Stage("a", fail, optional=True), pipeline.Stage("b", lambda: 1)])
    assert [s.status for s in fine.outcomes] == ["failed", "success"]
    with pytest.raises(pipeline.RunFailed) as e:
        pipeline.run_stages("data", [pipeline.Stage("a", fail), pipeline.Stage("b", lambda: 1)]).or_raise()
    assert [s.status for s in e.value.run.outcomes] == ["failed", "skipped"]
    assert pipeline.write_run(fine, str(tmp_path)).exists() and (tmp_path / "latest.json").exists()
    with pytest.raises(ValueError):
        pipeline.Stage(" ", fail)
