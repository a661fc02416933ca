from datetime import datetime

from fixtura.operators import asof, timestamps


def test_times(spark):
    rows = [
        (1, "eu", "Europe/Berlin", "13/02/2021", "2021-10-31 02:30:00", None), (2, "us", "America/New_York", "02/13/2021", "2021-03-14 02:30:00", ""),
        (3, "eu", "Europe/Berlin", "05/02/21", "2021-07-01T12:00:00.123456789", "1600000000123"), (4, "eu", "Europe/Berlin", "44937", "1 Jul 2021 14:00 CEST", "Sat, 26 Oct 2024 12:30:00 +1100"),
        (5, "eu", "Nowhere/Zone", "31.2.2021", "2021-07-01 12:00", "20210701T120000Z"), (6, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, feed string, feed_zone string, match_date string, kickoff_utc string, last_updated string")
    got = {(r[0], r[1]): r[2] for r in timestamps.normalise_times(df.union(df), "record_id", "feed", "feed_zone", ["match_date"], ["kickoff_utc", "last_updated"]).collect()}
    assert got == {
        (1, "match_date"): "2021-02-13", (1, "kickoff_utc"): "2021-10-31T00:30:00.000000Z", (2, "match_date"): "2021-02-13", (3, "match_date"): "2021-02-05", (3, "kickoff_utc"): "2021-07-01T10:00:00.123456Z",
        (3, "last_updated"): "2020-09-13T12:26:40.123000Z", (4, "match_date"): "2023-01-11", (4, "kickoff_utc"): "2021-07-01T12:00:00.000000Z", (4, "last_updated"): "2024-10-26T01:30:00.000000Z", (5, "last_updated"): "2021-07-01T12:00:00.000000Z",
    }
    assert timestamps.normalise_times(df.limit(0), "record_id", "feed", "feed_zone", ["match_date"], ["kickoff_utc"]).count() == 0


def test_state_as_of_against_brute_force(spark):
    import random

    rng = random.Random(1)
    day = lambda n: datetime(2024, 1, 1 + n)
    versions = [(i, rng.choice("aaaab"), day(rng.randrange(20)), day(rng.randrange(20)), float(i)) for i in range(120)] + [(900, None, day(1), day(1), 1.0), (901, "a", None, day(1), 2.0)]
    versions += versions[:10]
    events = [(f"e{i}", rng.choice("aabc"), day(rng.randrange(25))) for i in range(60)] + [("n", None, day(3)), ("t", "a", None)]
    v = spark.createDataFrame(versions, "rating_id long, team string, valid_from timestamp, recorded_at timestamp, elo double")
    e = spark.createDataFrame(events, "id string, team string, at timestamp")
    got = {r[0]: (r.known, r.elo) for r in asof.state_as_of(e, v, "team", "id", "at", ["elo"], order_by=["rating_id"], rows_per_bucket=10).collect()}
    for name, team, at in events:
        best = max(((f, r, i, x) for i, t, f, r, x in versions if t == team and team and f and r and at and f <= at and r <= at), default=None)
        assert got[name] == ((True, best[3]) if best else (False, None)), name
    assert asof.state_as_of(e, v.limit(0), "team", "id", "at", ["elo"]).filter("known").count() == 0
