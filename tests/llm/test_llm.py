import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtura.llm import leakage, linkage, queries, ranking, sentences, subtitles, survivorship, tokenizer


# problem 1
def test_names_and_hinges():
    same = lambda a, b: linkage.name_similarity(linkage.name_parts(a), linkage.name_parts(b))
    assert same("N. Fenimostow Alb", "FC North Fenimostow Albion") > 0.8
    assert same("Great Brioduminster", "Great Brioduminster Rovers F.C.") > 0.8
    assert same("Kesobridge Rovers", "Kesobridge Rovers II") < 0.6 > same("Old Ralistad", "East Coretokirk City")
    assert same("", "") >= 0
    one = np.ones(3)
    # two claims on one record: the one that agrees wins; a lone one that agrees stands
    got = linkage.solve_hinges(np.array([0, 1, 2]), np.array([0, 0, 1]), one, one, np.array([1.0, 0.4, 1.0]), np.array([1.0, 0.0, 1.0]), one, np.array([0.0, 14.0, 0.0]))
    assert got[0] > 0.8 and got[2] > 0.8 and got[1] < 0.5


def test_link_matches(spark):
    comps = spark.createDataFrame([("AAA", "Alpha League", "Europe/London")], "competition_code string, competition string, time_zone string")
    teams = [(f"Old Place{c}x City", i) for i, c in enumerate("abcdef")]
    hist, cur = [], []
    for k in range(30):
        (h, hi), (a, ai) = teams[k % 6], teams[(k + 1 + k // 6) % 6]
        if h == a:
            continue
        hist.append((f"h{k}", "2021/22", "Alpha League", date(2021, 9, 1 + k % 28), h.replace("City", "Cit"), a, k % 4, 1))
        cur.append((1000 + k, "AAA", "2021-2022", datetime(2021, 9, 1 + k % 28, 14), hi, ai, f"FC {h}", a, k % 4, 1))
    hist += [hist[0], (None, None, None, None, None, None, None, None), ("hx", "2021/22", "Alpha League", None, "A", "B", 1, 1)]
    cur += [cur[0], (5, None, None, None, None, None, None, None, None, None)]
    H = spark.createDataFrame(hist, "match_id string, season string, competition string, match_date date, home_team string, away_team string, home_goals long, away_goals long")
    K = spark.createDataFrame(cur, "api_match_id long, competition_code string, season string, kickoff_utc timestamp, home_team_id long, away_team_id long, home_team string, away_team string, home_goals long, away_goals long")
    got = {(r[0], r[1]) for r in linkage.link_matches(H, K, comps).collect()}
    assert got == {(h[0], c[0]) for h, c in zip(hist[:-3], cur[:-2], strict=True)}
    assert linkage.link_matches(H.limit(0), K, comps).count() == 0


# problem 5
def test_survivors(spark):
    t = lambda n: datetime(2024, 1, n)
    rows = [
        (1, "k", "matchfeed-api", "TIMED", datetime(2024, 1, 5, 14), None, None, None, t(1), t(1)), (2, "k", "matchfeed-api", "FINISHED", datetime(2024, 1, 5, 15), 5, 2, "A", t(6), t(6)),
        (3, "k", "results-archive", "FINISHED", datetime(2024, 1, 5), 2, 5, "A", None, t(9)), (4, "k", "mirror-west", "finished", datetime(2024, 1, 5, 16), 99, -1, "T", t(20), t(20)),
        (5, "one", "matchfeed-api", "FINISHED", t(5), 1, 1, "D", t(6), t(6)), (6, None, "matchfeed-api", "FINISHED", t(5), 1, 1, "D", t(6), t(6)), (7, "p", "matchfeed-api", "POSTPONED", t(5), None, None, None, t(6), t(6)), (8, "p", "mirror-west", "POSTPONED", t(5), 99, 0, None, t(7), t(7)),
    ]
    df = spark.createDataFrame(rows, "record_id long, match_key string, source string, status string, kickoff_utc timestamp, home_goals long, away_goals long, full_time_result string, last_updated timestamp, ingested_at timestamp")
    names = ["kickoff_utc", "status", "home_goals", "away_goals", "full_time_result"]
    got = {(r[0], r[1]): r[2] for r in survivorship.holders(df, survivorship.golden_matches(df, queries.RULES), "match_key", names, "record_id").collect()}
    assert got == {("k", "kickoff_utc"): 2, ("k", "status"): 2, ("k", "home_goals"): 3, ("k", "away_goals"): 3, ("k", "full_time_result"): 2}
    assert survivorship.golden_matches(df.limit(0), queries.RULES).count() == 0


# problem 7
def test_ranking_ways_agree(spark):
    rng = random.Random(3)
    true = {f"t{i}": (2.0 if i < 3 else 0.0) + rng.random() / 2 for i in range(12)}
    rows = []
    for _ in range(900):
        a, b = rng.sample(sorted(true), 2)
        gap = true[a] + 0.3 - true[b]
        w, d, l = np.exp(gap), np.exp(-0.5 + gap / 2), 1.0
        rows.append((a, b, rng.choices("HDA", [w, d, l])[0]))
    df = spark.createDataFrame(rows + [("t1", "t1", "H"), (None, "t2", "H"), ("t1", "t2", None), ("t1", "t2", "?")], "a string, b string, o string")
    one = ranking.rank_items(df, "a", "b", "o")
    assert {r[0] for r in ranking.above_widest_gap(one).collect()} == {"t0", "t1", "t2"}
    other = {r[0]: r[1:] for r in ranking.rank_items(df, "a", "b", "o", most_pairs=10).collect()}
    mine = {r[0]: r[1:] for r in one.collect()}
    assert mine.keys() == other.keys() and all(abs(mine[k][0] - other[k][0]) < 1e-6 and mine[k][1] == other[k][1] for k in mine)
    assert ranking.rank_items(df.limit(0), "a", "b", "o").count() == 0


# problem 8
def test_ids_against_another_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "<|endoftext|> I'll  go\n\n", "été 日本語 १२ ５²3½", "a" * 30_000, " \t x 12,345 \r\n", "été 日本語 १२ ５²3½"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenizer.encode_documents(df).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokenizer.encoder(tokenizer.VOCABULARY).decode(got[3]) == texts[3]


# problem 9
ITEM = "Every apprentice in Vustinol borrowed seven wooden ladders from Zeclemis because clause 3920 allowed nothing else. A retired clerk from Kakrirud wrote a slow letter about Suphemis."
OTHER = "Every apprentice in Tykrinol borrowed seven wooden ladders from Durgolum because clause 1177 allowed nothing else. A retired clerk from Hurgorud wrote a slow letter about Suvludim."
CUE = "\n\n{}\n00:00:0{},000 --> 00:00:0{},500\n"


def subtitle(text, every=7):
    words = text.split()
    parts = [" ".join(words[i : i + every]) for i in range(0, len(words), every)]
    return "".join(CUE.format(i + 1, i % 9, i % 9) + p for i, p in enumerate(parts))


def test_leaks(spark):
    worn = ITEM.replace("e", "é").replace("wooden", "w0oden").replace("from", "from [coughs] uh")
    texts = [subtitle(ITEM), subtitle(worn), subtitle(OTHER), subtitle(" ".join(ITEM.split()[:12])), None, "", subtitle(" ".join(ITEM.split()[:16])), "x" * 200_000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "en", ITEM), (2, "en", None), (3, "en", "short one"), (1, "en", ITEM)], "item_id long, lang string, text string")
    assert {(r[0], r[1]) for r in leakage.leaked_items(docs.union(docs), items).collect()} == {(0, 1), (1, 1), (6, 1)}
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_alignment_is_optimal_on_equal_texts():
    item = leakage.prepare_items([(1, ITEM)])[0]
    assert leakage.longest_run(item, "zzz" + item.text + "zzz")[0] == len(ITEM.split())


# problem 10
def test_sentence_ends(spark):
    model = sentences.Model(abbreviations={"dr": 0.0, "u.s": 0.2}, starters={"The": 1.0, "Dr": 1.0, "We": 0.9}, speech={"shouted"})
    text = "1\n00:00:01,000 --> 00:00:02,000\n<i>Dr. Jasvic ran 6.9 miles on a</i>\n\n2\n00:00:02,000 --> 00:00:03,000\n<i>pitch… like this.</i> [crowd roars] The\n\n3\n00:00:04,000 --> 00:00:05,000\nend! “Stop!” Cal shouted from here. We left\n\n4\n00:00:05,000 --> 00:00:06,000\n- Hm\n- No way?!"
    ends = sentences.sentence_ends(text, {"en": model}, set(), "en")
    assert [text[e - 3 : e + 1] for e in ends] == ["his.", "end!", "ere.", "left", "- Hm", "ay?!"]
    assert sentences.sentence_ends("", {}, set()) == [] and sentences.sentence_ends(" \n ", {}, set()) == []
    quoting = sentences.Model(clauses={"opening": {"と"}, "closing": set(), "leading": set()})
    japanese = "これは試験です。「止まれ。」と彼は言いました。本当？"
    assert [japanese[: e + 1][-2:] for e in sentences.sentence_ends(japanese, {"ja": quoting}, set(), "ja")] == ["す。", "た。", "当？"]


def test_splitting_documents(spark):
    base = "1\n00:00:01,000 --> 00:00:02,000\nThe crowd waits! Mr. Smith"
    docs = [(i, base + "\n\n2\n00:00:02,000 --> 00:00:03,000\nruns on? It is over.", "en") for i in range(30)] + [(100, None, "en"), (101, "", None), (102, " ", "en")]
    got = sentences.split_sentences(spark.createDataFrame(docs, "doc_id long, text string, lang string")).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got} == dict.fromkeys(range(30), 3)


def test_positions_survive_a_wrong_encoding():
    text = "Il a déjà marqué. Voilà !".encode().decode("cp1252")
    fixed, at = subtitles.unmangle_mapped(text, list(range(len(text))))
    assert fixed == "Il a déjà marqué. Voilà !" and text[at[fixed.index(".")]] == "." and len(at) == len(fixed)


def test_nothing_of_the_core_needs_this_folder():
    import pathlib

    root = pathlib.Path(leakage.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "fixtura.llm" in p.read_text()]
