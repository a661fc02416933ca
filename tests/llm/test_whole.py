"""What a cut would lose: each test holds an operator to the whole of its job."""

from datetime import date, datetime

from fixtura.llm import leakage, linkage, sentences


# problem 1
def test_one_name_of_two_teams(spark):
    comps = spark.createDataFrame([("AAA", "Alpha League", "Europe/London")], "competition_code string, competition string, time_zone string")
    sides = [("Old Oskadegate Town", 1), ("Old Oskadegate Wanderers", 2)]
    others = [("Velebury Rovers", 3), ("Kesotirk Albion", 4), ("Ralistad City", 5)]
    hist, cur = [], []
    for k in range(24):
        (h, hi), (a, ai) = sides[k % 2], others[k % 3]
        hist.append((f"h{k}", "2021/22", "Alpha League", date(2021, 9, 1 + k), "Old Oskadegate", a, k % 5, k % 4))
        cur.append((1000 + k, "AAA", "2021-2022", datetime(2021, 9, 1 + k, 14), hi, ai, h, a, k % 5, k % 4))
    H = spark.createDataFrame(hist, "match_id string, season string, competition string, match_date date, home_team string, away_team string, home_goals long, away_goals long")
    K = spark.createDataFrame(cur, "api_match_id long, competition_code string, season string, kickoff_utc timestamp, home_team_id long, away_team_id long, home_team string, away_team string, home_goals long, away_goals long")
    got = {(r[0], r[1]) for r in linkage.link_matches(H, K, comps).collect()}
    assert got == {(f"h{k}", 1000 + k) for k in range(24)}


# problem 10
def test_rare_abbreviations_of_a_large_corpus(spark):
    counts = [("en", "plain", "ball", 2_000_000), ("en", "dot", "ball", 100_000), ("en", "word", "Smith", 30), ("en", "dot", "prof", 4), ("en", "start", "We", 50_000), ("en", "word", "We", 60_000), ("en", "start", "Rare", 3), ("en", "word", "Rare", 3)]
    counts += [("en", "dotnext", f"prof\t{w}", 1) for w in ("mccabe", "bolton", "then", "Hayes")] + [("en", "dotnext", "ball\tWe", 90_000), ("en", "quote", "asked", 9), ("en", "plain", "asked", 1), ("en", "pauseup", "but", 1), ("en", "pauselow", "but", 2)]
    model = sentences.build_models([tuple(r) for r in sentences.word_lists(spark.createDataFrame(counts, "lang string, kind string, word string, n long")).collect()])["en"]
    assert model.abbreviations == {"prof": 0.0} and model.starters == {"We": 5 / 6, "Rare": 1.0}
    assert model.speech == {"asked"} and model.common == {"Smith", "We", "Rare"} and model.pauses == {"but": 1 / 3}


def test_how_quotations_go_on_is_learned(spark):
    cue = "{}\n00:00:0{},000 --> 00:00:0{},900\n{}\n\n"
    said = ["「止まれ。」と彼は言いました。", "試合は続く。雨が降る。", "「走れ！」と監督は叫んだ。", "これは試験です。"]
    docs = [(k, "".join(cue.format(i, i, i, said[(i + k) % 4]) for i in range(1, 9)), "ja") for k in range(30)]
    models, _ = sentences.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert models["ja"].clauses["opening"] == {"と"}


def test_collocations_join_an_abbreviation_that_may_end_a_sentence(spark):
    counts = [("de", "plain", "tor", 900_000), ("de", "dot", "tor", 90_000), ("de", "dot", "nr", 500), ("de", "dotend", "nr", 60), ("de", "word", "Liga", 400), ("de", "word", "Tor", 500_000), ("de", "word", "Die", 60_000), ("de", "start", "Die", 50_000), ("de", "start", "Liga", 120)]
    counts += [("de", "dotnext", "nr\tLiga", 180), ("de", "dotnext", "nr\tDie", 20), ("de", "dotnext", "nr\t#", 300), ("de", "dotnext", "tor\tDie", 50_000)]
    model = sentences.build_models([tuple(r) for r in sentences.word_lists(spark.createDataFrame(counts, "lang string, kind string, word string, n long")).collect()])["de"]
    assert model.collocations == {"nr\tLiga"} and "Die" in model.starters


def test_words_seen_once_count(spark):
    docs = [(k, f"1\n00:00:01,000 --> 00:00:02,000\nThe prof. {w} spoke. We left now.", "en") for k, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    models, _ = sentences.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert "prof" in models["en"].abbreviations


# problem 9
ITEM = "Every apprentice in Vustinol borrowed seven wooden ladders from Zeclemis because clause 3920 allowed nothing else."


def test_passages_that_many_items_hold(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "nothing of the kind")], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"Opening number {k * 7919}. {ITEM}") for k in range(5)], "item_id long, text string")
    assert {(r[0], r[1]) for r in leakage.leaked_items(docs, items).collect()} == {(1, k) for k in range(5)}


def test_worn_passages():
    items = leakage.prepare_items([(1, ITEM)])
    # 26 letters stand intact in a row, less than the former cover
    worn = "".join("ж" if k % 9 == 4 and not 18 <= k < 36 else c for k, c in enumerate(leakage.condense(ITEM)))
    found = leakage.find_in_texts([worn, "x" * 50], items, leakage.build_automaton(items))
    assert [f[0] for f in found[0]] == [1] and found[1] == []


def test_copies_of_items_and_places_in_the_raw_text(spark):
    raw = "<i>Heading</i>\n\n" + ITEM.replace("wooden", "w&#111;oden").replace("from", "[coughs] from")
    docs = spark.createDataFrame([(1, raw), (2, "nothing of the kind")], "doc_id long, text string")
    for copies in (1, 2, 3, 5):
        items = spark.createDataFrame([(k, ITEM + "!" * (k % 2)) for k in range(copies)], "item_id long, text string")
        found = leakage.leaked_items(docs, items).collect()
        assert {(r[0], r[1]) for r in found} == {(1, k) for k in range(copies)}
        assert {raw[r.start_pos : r.end_pos + 1] for r in found} == {raw[raw.index("Every") : -1]}


# problem 1
RECORDS = "match_id string, season string, competition string, match_date date, home_team string, away_team string, home_goals long, away_goals long"
FEED = "api_match_id long, competition_code string, season string, kickoff_utc timestamp, home_team_id long, away_team_id long, home_team string, away_team string, home_goals long, away_goals long"


def test_one_name_in_two_leagues(spark):
    comps = spark.createDataFrame([("AAA", "Alpha League", "Europe/London"), ("BBB", "Beta League", "Asia/Tokyo")], "competition_code string, competition string, time_zone string")
    hist, cur = [], []
    for league, (code, name) in enumerate((("AAA", "Alpha League"), ("BBB", "Beta League"))):
        others = [(f"{w} Town", 10 * league + 2 + i) for i, w in enumerate(("Velebury", "Kesotirk", "Ralistad") if league == 0 else ("Mondavar", "Tiruleth", "Osbeckam"))]
        for k in range(12):
            a, ai = others[k % 3]
            hist.append((f"h{league}-{k}", "2021/22", name, date(2021, 9, 1 + k), "Rovers", a, k % 4, k % 3))
            cur.append((1000 + 100 * league + k, code, "2021-2022", datetime(2021, 9, 1 + k, 5), 10 * league + 1, ai, "Rovers", a, k % 4, k % 3))
    got = {(r[0], r[1]) for r in linkage.link_matches(spark.createDataFrame(hist, RECORDS), spark.createDataFrame(cur, FEED), comps).collect()}
    assert got == {(h[0], c[0]) for h, c in zip(hist, cur, strict=True)} and len(got) == 24


def test_sides_the_other_way_round(spark):
    comps = spark.createDataFrame([("AAA", "Alpha League", "Europe/London")], "competition_code string, competition string, time_zone string")
    teams = [(w, i) for i, w in enumerate(("Velebury Rovers", "Kesotirk Albion", "Ralistad City", "Mondavar Town"))]
    hist, cur = [], []
    for k, (x, y) in enumerate((x, y) for x in range(4) for y in range(4) if x != y):
        (h, hi), (a, ai) = teams[x], teams[y]
        hg, ag = k % 4 + 1, k % 3
        hist.append((f"h{k}", "2021/22", "Alpha League", date(2021, 9, 1 + 2 * k), *((a, h, ag, hg) if k in (4, 9) else (h, a, hg, ag))))
        cur.append((1000 + k, "AAA", "2021-2022", datetime(2021, 9, 1 + 2 * k, 14), hi, ai, h, a, hg, ag))
    got = {(r[0], r[1]) for r in linkage.link_matches(spark.createDataFrame(hist, RECORDS), spark.createDataFrame(cur, FEED), comps).collect()}
    assert got == {(f"h{k}", 1000 + k) for k in range(12)}


# problem 10
def test_repeated_documents_give_one_result(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nThe crowd waits! We left."
    docs = spark.createDataFrame([(k, text, "en") for k in range(6)] + [(2, text, "en"), (2, text + " So did they.", "en"), (None, text, "en")], "doc_id long, text string, lang string")
    got = {r[0]: r[1] for r in sentences.split_sentences(docs).groupBy("doc_id").count().collect()}
    assert got == {k: 3 if k == 2 else 2 for k in range(6)}


def test_f1_a_word_is_cut_once_for_all_its_comparisons():
    linkage._runs_of_two.cache_clear()
    name, teams = linkage.name_parts("Old Plazex"), [linkage.name_parts(f"Old Place{c}x") for c in "abcdefgh"]
    assert all(linkage.name_similarity(name, team) > 0.4 for team in teams)
    words = {w for parts in (name, *teams) for w in (parts[0], *parts[1], parts[3])}
    assert 0 < linkage._runs_of_two.cache_info().misses <= len(words)
