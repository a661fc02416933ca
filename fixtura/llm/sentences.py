"""Sentence boundaries in many languages, from statistics of the corpus itself.

One pass over all documents counts, per language, how often each word is written with and without a
period, stands at a sure end or start of a sentence, or follows a pause or a closing quotation mark.
After Kiss and Strunk (2006) log-likelihood ratios turn these into abbreviations, frequent sentence
starters and collocations (here words that go on after a quotation: said, asked). A second pass
classifies each candidate (period, ellipsis, quotation, line and cue break) with these lists. Whole
cues that stand word for word in documents of many languages are set pieces (adverts, credits): they
are sentences of their own, and the sentence around them goes on.

Counts are combined on the map side and tested in Spark, however rare the word; what comes to the
driver are only the words that pass, and their size is checked. Defined results: null, empty and blank texts have no sentence; a document
without terminal marks ends a sentence with each cue; repeated rows of a document give one result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.llm.leakage import folding_table
from fixtura.llm.subtitles import ENTITY, MARKUP, SOUND, SURELY_MISREAD, cue_spans, unmangle_mapped
from fixtura.operators.joins import join_lookup
from fixtura.session import cut_lineage

CUE = "\x1e"
_begin = itemgetter(0)
MOST_ENTRIES = 500_000
#: Distinct counts that a task holds before it hands them on.
HELD = 1_000_000
SET_CUE_DOCUMENTS, SET_CUE_LANGUAGES, SET_CUE_SHARE, SET_CUE_LENGTH = 5, 4, 0.7, (16, 100)
ABBREVIATION_SCORE = 0.3
COMMON = 200
#: Log-likelihood ratio from which an association counts (the chi-square bound at 0.5 %).
LIKELY = 7.88
MOST_LANGUAGES = 10_000

#: Noise within a cue, looked for only where one of the characters stands that it can begin with.
_NOISE = re.compile("|".join((SOUND.pattern, ENTITY.pattern, MARKUP.pattern)))
_NOISE_BEGINS = re.compile("[\\[(（【*♪♫♬&<{\u200b-\u200f\u2060\ufeff\u00ad]")
_HEADER = re.compile(r"\A﻿?WEBVTT[^\n]*")
_CLOSE = r"(?:[   ]?»|[\"”“’'\)\]』」】）])*"
_TERMS = frozenset(".!?…。！？؟।॥")
_LABELLED = r"[A-ZÀ-ÞА-ЯЁ][A-ZÀ-ÞА-ЯЁ.'’-]{2,24}(?: [A-ZÀ-Þ.]{1,20})?:[  ]"
_MARK = ".!?…。！？؟।॥"
#: What can end a sentence: marks with what closes after them, or a gap. Each pattern begins with one set
#: of characters, so that a search can skip to them; which of them it was is asked after.
_CANDIDATE = re.compile(rf"[{_MARK}\n{CUE}](?:(?<=[{_MARK}])[{_MARK}]*(?P<close>{_CLOSE})|(?P<gap>(?<=[\n{CUE}])[\s{CUE}]*+))")
#: As before, but of the gaps those that can end a sentence outside a dialogue: before a dash, a label or nothing.
_FEWER = re.compile(rf"[{_MARK}\n{CUE}](?:(?<=[{_MARK}])[{_MARK}]*(?P<close>{_CLOSE})|(?P<gap>(?<=[\n{CUE}])[\s{CUE}]*+)(?=[-–‐‑]|{_LABELLED}|\Z))")
_THAI_CANDIDATE = re.compile(rf"[{_MARK}\n{CUE} ](?:(?<=[{_MARK}])[{_MARK}]*(?P<close>{_CLOSE})|(?P<gap>(?<=[\n{CUE}])[\s{CUE}]*+)|(?P<space>(?<=[\u0e00-\u0e7f”\"] )(?=[\u0e00-\u0e7f“\"])))")
_LABEL = re.compile(_LABELLED)
_DASH = re.compile(r"[-–‐‑][  ]*(?=\S)")
_WORD = re.compile(r"[^\W_](?:[^\s\x1e]*[^\W_])?|\S")
_NEXT = re.compile(r"[\s\x1e]*([«„“\"'‘¿¡(\[『「—–-]*[   ]?)([^\s\x1e]+)")
_CASED = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]")
_THAI = re.compile(r"[฀-๿]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")
_NO_SPACES = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_TOKEN = re.compile(r"\S+")
_QUOTES = frozenset("»”“’\"』」")
_STRONG = "!?。！？؟।॥"


@dataclass
class Text:
    """Running text of a document: cues joined, noise taken out, with the way back to raw positions."""

    text: str
    _clean: list[int]
    _raw: list[int]
    _map: list[int] | None = None

    def raw(self, at: int) -> int:
        k = bisect_right(self._clean, at) - 1
        place = self._raw[k] + (at - self._clean[k])
        return self._map[place] if self._map else place


def running_text(raw: str) -> Text:
    mapped = None
    if not raw.isascii() and SURELY_MISREAD.search(raw):
        raw, mapped = unmangle_mapped(raw, list(range(len(raw))))
    head = _HEADER.match(raw)
    last = head.end() if head else 0
    spans = cue_spans(raw)
    noise, free = [], last
    for b in _NOISE_BEGINS.finditer(raw, last):
        at = b.start()
        if at >= free and (m := _NOISE.match(raw, at)):
            free = m.end()
            noise.append((at, free, m.group()))
    if not noise and (not spans or spans[0][0] >= last):
        begins = [last, *[b for _, b in spans]]
        pieces = [raw[b:a] for b, a in zip(begins, [*[a for a, _ in spans], len(raw)], strict=True)]
        return Text(CUE.join(pieces), [0, *accumulate([len(c) + 1 for c in pieces[:-1]])], begins, mapped)
    parts: list[str] = []
    clean, place, size = [0], [0], 0
    for a, b, what in sorted([(a, b, None) for a, b in spans] + noise, key=_begin):
        if a < last:
            if b <= last or what is not None:
                continue
            a = last
        if last < a:
            clean.append(size)
            place.append(last)
            parts.append(raw[last:a])
            size += a - last
        said = CUE if what is None else _said(what)
        if said:
            clean.append(size)
            place.append(b - 1 if what and what[0] == "&" else a)
            parts.append(said)
            size += len(said)
        last = b
    clean.append(size)
    place.append(last)
    parts.append(raw[last:])
    return Text("".join(parts), clean, place, mapped)


def _said(noise: str) -> str:
    """What stands for a piece of noise: the character of an entity, a space for a sound, nothing for markup."""
    if noise[0] == "&":
        return html.unescape(noise)[:1]
    return " " if noise[0] in "[(（【*♪♫♬" else ""


_KEEP_CUES = folding_table(CUE)
#: Letters of a set piece that are compared before its whole wording is.
HEAD = 3


def cue_keys(text: str) -> list[str]:
    """The key of each cue of a running text that could be a set piece: the first letters of its
    wording, and a hash of it all."""
    least, most = SET_CUE_LENGTH
    return [c[:HEAD] + xxhash.xxh64_hexdigest(c) for c in text.translate(_KEEP_CUES).split(CUE) if least <= len(c) <= most]


def first_word(text: str) -> str:
    """What stands for the next word: in Thai, which has no spaces, its first letters."""
    if not text:
        return ""
    if "\u0e00" <= text[0] <= "\u0e7f":
        return text[:5]
    if text.isalpha():
        return text
    m = _WORD.match(text)
    return _DIGITS.sub("#", m.group()) if m else text[:1]


@dataclass
class Model:
    """What the corpus says of one language."""

    abbreviations: dict[str, float] = field(default_factory=dict)  # word -> share of sure ends
    starters: dict[str, float] = field(default_factory=dict)  # word -> share of sure starts
    pauses: dict[str, float] = field(default_factory=dict)  # word -> share of starts after a pause
    speech: set[str] = field(default_factory=set)  # words that go on after a quotation
    collocations: set[str] = field(default_factory=set)  # abbreviation, tab, word that belongs to it
    clauses: dict[str, set[str]] = field(default_factory=lambda: {"opening": set(), "closing": set(), "leading": set()})
    common: set[str] = field(default_factory=set)


_UPPER, _LOWER, _ANY = re.compile(r"[A-ZÀ-ÞА-ЯЁ]+"), re.compile(r"[a-zß-ÿа-яё]+"), re.compile(r"[^\W_]")
#: Scripts that by themselves tell a language.
_SCRIPTS = (("th", re.compile(r"[\u0e00-\u0e7f]+")), ("ja", re.compile(r"[\u3040-\u30ff]+")), ("zh", re.compile(r"[\u4e00-\u9fff]+")), ("hi", re.compile(r"[\u0900-\u097f]+")), ("ar", re.compile(r"[\u0600-\u06ff]+")), ("ru", re.compile(r"[\u0400-\u04ff]+")))


_NOT_UPPER, _NOT_LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def _case(text: str) -> str:
    """mixed, or one where a text of a cased script has lost the difference, or none."""
    plain = text.encode("ascii", "ignore")
    up, low = len(plain) - len(plain.translate(None, _NOT_UPPER)), len(plain) - len(plain.translate(None, _NOT_LOWER))
    if (up + low) * 4 < len(text):
        up, low = _letters(_UPPER, text), _letters(_LOWER, text)
    letters = up + low
    if letters * 4 < len(text):
        return "none"
    return "one" if up * 200 < letters or up * 4 > letters * 3 else "mixed"


_MARKS = frozenset(".!?…؟।॥»”\"")
_AFTER_QUOTE = re.compile(r"[.!?…,][\xa0\u202f]?[»”“’\"][ \n\xa0]+(\S+)(?: (\S+)(?: (\S+))?)?")
_DIALOGUE = re.compile(r"\n[ \t]*[-–‐‑][ \t\xa0]*(\S+)(?:[^\n]*[ \t])?(\S*)[ \t\r]*(?=\n)")
_OPEN = "«„“\"'‘¿¡(—–-"


def count_document(raw: str, counts: dict[str, Counter]) -> list[str]:
    """Adds a document's raw observations (tokens, pairs around marks) to the counters of its
    language, all by C code; they are made sense of once per distinct token, in `observations`."""
    text = running_text(raw).text
    keys = cue_keys(text)
    flat = text.replace(CUE, "\n")
    tokens = flat.split()
    counts["word"].update(tokens)
    case = _case(flat)
    counts["pair", case].update([(a, b) for a, b in zip(tokens, tokens[1:], strict=False) if a[-1] in _MARKS])
    counts["quote"].update(_AFTER_QUOTE.findall(flat))
    counts["dialogue"].update(_DIALOGUE.findall(f"\n{flat}\n"))
    counts["begin"].update(tokens[:1])
    if not flat.isascii() and _NO_SPACES.search(flat):
        count_unspaced(flat, counts)
    return keys


#: In scripts without spaces: the clause after a closing quotation, any clause, what stands before an
#: opening quotation mark and before any gap.
_QUOTED_CLAUSE = re.compile(r"[。！？…!?][」』”\"]([^\W\d_])((?:[^\W\d_]{0,12}([^\W\d_])(?=[。！？…，、：]))?)")
_CLAUSE = re.compile(r"(?<![^\W_])([\u3040-\u30ff\u3400-\u9fff])|([\u3040-\u30ff\u3400-\u9fff])(?=[。！？…，、：])")
_BEFORE_QUOTE = re.compile(r"([\u0e00-\u0e7f]{3}) ?[“\"]")
_BEFORE_GAP = re.compile(r"([\u0e00-\u0e7f]{3}) ")


def count_unspaced(flat: str, counts: dict[str, Counter]) -> None:
    """Observations of how clauses begin and end, which words take the place of in such scripts."""
    for opening, _, closing in _QUOTED_CLAUSE.findall(flat):
        counts["opening"][opening] += 1
        counts["closing"][closing] += 1
    for opening, closing in _CLAUSE.findall(flat):
        counts["anyopening"][opening] += 1
        counts["anyclosing"][closing] += 1
    counts["leading"].update(_BEFORE_QUOTE.findall(flat))
    counts["anyleading"].update(_BEFORE_GAP.findall(flat))


UNSPACED = ("opening", "closing", "leading", "anyopening", "anyclosing", "anyleading")


def observations(lang: str, counts: dict, out: Counter) -> None:
    """Turns raw counters of one language into counts by (lang, kind, word)."""
    plain = lambda low: low if low.isalpha() else _DIGITS.sub("#", low)
    low_of = lambda t: plain(t.strip("«„“\"'‘¿¡(),;:»”’!?…—-–").rstrip(".").lower())
    for token, n in counts["word"].items():
        bare = token.strip("«„“\"'‘¿¡(),;:»”’!?…—-–")
        low = plain(bare.rstrip(".").lower())
        if low:
            out[lang, "word", first_word(token.lstrip(_OPEN))] += n
            out[lang, "dot" if bare.endswith(".") and not bare.endswith("..") else "plain", low] += n
    for kind, pairs in counts.items():
        if kind[0] != "pair":
            continue
        for (before, after), n in pairs.items():
            after = after.lstrip(_OPEN)
            whole = first_word(after)
            if not whole:
                continue
            end = before.rstrip("»”“’\"')")[-1:]
            if before.endswith(("…", "...")):
                if kind[1] == "mixed" and whole[0].isalpha():
                    out[lang, "pauseup" if whole[0].isupper() else "pauselow", whole.lower()] += n
            elif end == ".":
                low = low_of(before)
                if low:
                    out[lang, "dotnext", f"{low}\t{whole}"] += n
            elif end and end in _STRONG:
                out[lang, "start", whole] += n
    for first, n in counts["begin"].items():
        out[lang, "start", first_word(first.lstrip(_OPEN))] += n
    for (first, last), n in counts["dialogue"].items():
        out[lang, "start", first_word(first.lstrip(_OPEN))] += n
        last = last or first
        if last.endswith(".") and not last.endswith(".."):
            out[lang, "dotend", low_of(last)] += n
    for kind in UNSPACED:
        for word, n in counts[kind].items():
            if word:
                out[lang, kind, word] += n
    for words, n in counts["quote"].items():
        for w in words:
            low = low_of(w)
            if low:
                out[lang, "quote", low] += n


_DIGITS = re.compile(r"\d+")


def association(both: Column, one: Column, other: Column, every: Column) -> tuple[Column, Column]:
    """(more often than by chance, Dunning's log-likelihood ratio) of two events seen `both` times
    together, `one` and `other` times each, of `every` observations."""
    held = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    likelihood = lambda k, n, p: k * F.log(held(p)) + (n - k) * F.log(held(1 - p))
    rest, left = F.greatest(one - both, F.lit(0)), F.greatest(every - other, F.lit(0))
    p, p1, p2 = one / every, both / F.greatest(other, F.lit(1)), rest / F.greatest(left, F.lit(1))
    return p1 > p2, -2 * (likelihood(both, other, p) + likelihood(rest, left, p) - likelihood(both, other, p1) - likelihood(rest, left, p2))


def word_lists(counted: DataFrame) -> DataFrame:
    """(lang, kind, word, value) of the words that pass, from summed counts (lang, kind, word, n).

    Kinds: abbreviation (value: share of sure ends), starter and pause (shares of starts), speech, common,
    collocation (an abbreviation and the word that belongs to it), clause (how clauses go on after a
    quotation in scripts without spaces).
    Counts are taken together per word here, however rare; of the starters those whose share makes no
    difference to `_starter` are left out.
    """
    c = F.col
    kinds = ("word", "start", "pauseup", "pauselow", "dot", "plain", "dotend", "quote", *UNSPACED)
    # one shuffle for the counts of all kinds of a word; the lists are filters of this table
    wide = counted.filter(c("kind").isin(*kinds)).groupBy("lang", "word").agg(*[F.coalesce(F.sum(F.when(c("kind") == k, c("n"))), F.lit(0)).alias(f"n_{k}") for k in kinds])
    wide = cut_lineage(wide)
    totals = {"total": c("n_dot") + c("n_plain"), "dots": c("n_dot"), "quotes": c("n_quote"), "words": c("n_word"), "begun": c("n_start")} | {f"all_{k}": c(f"n_{k}") for k in UNSPACED}
    per_language = cut_lineage(wide.groupBy("lang").agg(*[F.sum(n).cast("double").alias(name) for name, n in totals.items()]))
    if per_language.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels")
    per_language = F.broadcast(per_language)

    def counts(*kinds: str) -> DataFrame:
        found = reduce(lambda a, b: a | b, [c(f"n_{k}") > 0 for k in kinds])
        return wide.filter(found).select("lang", "word", *[f"n_{k}" for k in kinds])

    cased = counts("word", "start").join(per_language.select("lang", F.greatest("words", "total").alias("words"), "begun"), "lang").withColumn("share", F.when(c("n_start") >= 1, c("n_start") / F.greatest("n_start", "n_word")))
    # as a starter counts what stands at sure starts more often than chance would have it
    positive, ratio_of = association(c("n_start"), F.greatest("n_start", "n_word"), c("begun"), F.greatest("words", "begun"))
    head = F.substring("word", 1, 1)
    starters = cased.filter((c("share") >= 0.4) & positive & (ratio_of >= LIKELY) | (c("n_start") >= 3) & (c("share") < 0.2) & (F.lower(head) != head))
    cased = cased.withColumn("share", F.when((c("n_start") >= 3) | positive & (ratio_of >= LIKELY), c("share")))
    common = cased.filter("n_word > 0").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_word"), "word"))).filter(c("_n") <= COMMON)
    pauses = counts("pauseup", "pauselow").filter(c("n_pauseup") + c("n_pauselow") >= 3)

    # what follows a word with a period: does it go on?
    after = F.split_part("word", F.lit("\t"), F.lit(2))
    next_head = F.substring("after", 1, 1)
    pairs = counted.filter("kind = 'dotnext'").select("lang", F.split_part("word", F.lit("\t"), F.lit(1)).alias("word"), after.alias("after"), "n")
    pairs = pairs.withColumn("capital", F.concat(F.upper(next_head), F.lower(F.expr("substring(after, 2)"))))
    known = cased.filter("n_word >= 20 or share is not null")
    pairs = pairs.join(known.select("lang", c("word").alias("after"), c("n_word").alias("seen"), c("share").alias("own")), ["lang", "after"], "left")
    pairs = pairs.join(known.filter("share is not null").select("lang", c("word").alias("capital"), c("share").alias("upper")), ["lang", "capital"], "left")
    pairs = cut_lineage(pairs)
    own, upper = F.coalesce("own", F.lit(0.0)), F.coalesce("upper", F.lit(0.0))
    lower = (F.lower(next_head) == next_head) & (F.upper(next_head) != next_head)
    goes_on = (next_head == "#") | lower & (upper < 0.2) | (F.coalesce("seen", F.lit(0)) >= 20) & (F.greatest(own, upper) < 0.1)
    followed = pairs.groupBy("lang", "word").agg(F.sum("n").alias("follows"), F.coalesce(F.sum(F.when(goes_on, c("n"))), F.lit(0)).alias("goes_on"))

    plain = counts("dot", "plain", "dotend", "quote").join(per_language.select("lang", "total", "dots", "quotes").filter("total > 0"), "lang")
    dotted = plain.filter("n_dot >= 3").join(followed, ["lang", "word"], "left").fillna(0, ["follows", "goes_on"])
    n, both, rate = c("n_dot"), c("n_dot") + c("n_plain"), c("dots") / c("total")
    letters = F.replace("word", F.lit("."), F.lit(""))
    term = lambda p: n * F.log(F.greatest(p, F.lit(1e-12))) + c("n_plain") * F.log(F.greatest(1 - p, F.lit(1e-12)))
    # Dunning's log-likelihood ratio that the periods come at a rate of 0.99 rather than at that of all words
    ratio = -2 * (term(rate) - term(F.lit(0.99)))
    score = ratio * F.exp(-F.length(letters)) * (F.length("word") - F.length(letters) + 1) * F.pow(n / both, F.lit(8))
    on = c("goes_on") / F.greatest(F.lit(1), c("follows"))
    # written with a period like no ordinary word, or followed by what starts no sentence
    passes = letters.rlike(r"^\p{L}$") | (c("follows") >= 3) & (on >= 0.3) | (score >= ABBREVIATION_SCORE) & ((on >= 0.1) | (n >= 20) & (c("n_dotend") < 0.01 * n) & (c("follows") > 0.8 * n))
    abbreviations = dotted.filter(passes)
    # a word that belongs to the abbreviation before it, though it could begin a sentence
    pairs_of = pairs.join(abbreviations.select("lang", "word", "n_dot", c("n_dotend").alias("ends")).filter(c("ends") >= 0.02 * c("n_dot")).drop("ends"), ["lang", "word"]).join(per_language.select("lang", F.greatest("words", "total").alias("words")), "lang")
    together, how_much = association(c("n"), F.greatest(c("seen"), c("n")), c("n_dot").cast("double"), F.greatest("words", c("seen"), c("n_dot")))
    collocations = pairs_of.filter((c("n") >= 2) & (c("seen") >= 1) & together & (how_much >= LIKELY) & (F.coalesce("own", F.lit(0.6)) >= 0.2) & (F.coalesce("own", F.lit(0.0)) < 0.4))
    collocations = collocations.select("lang", F.concat_ws("\t", "word", "after").alias("word"))

    def clauses(kind: str) -> DataFrame:
        both = counts(kind, f"any{kind}").join(per_language.select("lang", c(f"all_{kind}").alias("at"), c(f"all_any{kind}").alias("of")), "lang")
        every = F.greatest(c(f"n_{kind}"), c(f"n_any{kind}"))
        more, ratio = association(c(f"n_{kind}"), every, c("at"), F.greatest("of", "at"))
        return both.filter(more & (ratio >= LIKELY) & (c(f"n_{kind}") >= 0.3 * every)).select("lang", F.concat(F.lit(f"{kind}\t"), "word").alias("word"))

    unspaced = reduce(DataFrame.unionByName, [clauses(k) for k in UNSPACED[:3]])
    said = c("n_quote")
    speech = plain.filter((said >= 5) & (said > 0.6 * F.greatest(said, both)) & (said > 0.004 * c("quotes")))
    lists = ((collocations, "collocation", F.lit(1.0)), (unspaced, "clause", F.lit(1.0)), (abbreviations, "abbreviation", c("n_dotend") / n), (starters, "starter", c("share")), (pauses, "pause", c("n_pauseup") / (c("n_pauseup") + c("n_pauselow"))), (speech, "speech", F.lit(1.0)), (common, "common", F.lit(1.0)))
    return reduce(DataFrame.unionByName, [rows.select("lang", F.lit(kind).alias("kind"), "word", value.alias("value")) for rows, kind, value in lists])


def build_models(rows: list[tuple[str, str, str, float]]) -> dict[str, Model]:
    """Models from listed words (lang, kind, word, value)."""
    out: dict[str, Model] = defaultdict(Model)
    for lang, kind, word, value in rows:
        model = out[lang]
        if kind == "clause":
            place, _, letters = word.partition("\t")
            model.clauses[place].add(letters)
        elif kind == "collocation":
            model.collocations.add(word)
        elif kind in ("speech", "common"):
            if kind == "speech" or word.isalpha():
                getattr(model, kind).add(word)
        else:
            {"abbreviation": model.abbreviations, "starter": model.starters, "pause": model.pauses}[kind][word] = value
    return dict(out)


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, Model], set[str]]:
    """(models by language, keys of set cues) from all documents."""

    def rows(out: Counter, cues: dict[str, Counter]) -> pa.RecordBatch:
        columns = [[k[i] for k in out] for i in range(3)] + [list(out.values())]
        for code, keys in cues.items():
            for column, more in zip(columns, ([code] * len(keys), ["cue"] * len(keys), keys.keys(), keys.values()), strict=True):
                column.extend(more)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:3]] + [pa.array(columns[3], pa.int64())], names=["lang", "kind", "word", "n"])

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        cues: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            raw: dict[str, dict] = defaultdict(lambda: defaultdict(Counter))
            for t, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    code = (code or "und").strip().lower()
                    cues[code].update(set(count_document(t, raw[code])))
            for code, counts in raw.items():
                observations(code, counts, out)
            if len(out) + sum(map(len, cues.values())) > HELD:
                yield rows(out, cues)
                out, cues = Counter(), defaultdict(Counter)
        yield rows(out, cues)

    counted = documents.select(F.col(text), F.col(lang).cast("string")).mapInArrow(observe, "lang string, kind string, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    # of cues those that come again in a language; of words all
    counted = cut_lineage(counted.filter("n >= 2 or kind != 'cue'"))
    named = F.col("lang") != "und"
    per_cue = counted.filter("kind = 'cue'").groupBy("word").agg(F.sum("n").alias("n"), F.max(F.when(named, F.col("n"))).alias("most"), F.sum(F.when(named, F.col("n"))).alias("named"), F.count_if(named).alias("languages"))
    set_cues = per_cue.filter((F.col("n") >= SET_CUE_DOCUMENTS) & (F.col("languages") >= SET_CUE_LANGUAGES) & (F.coalesce("most", F.lit(0)) < SET_CUE_SHARE * F.col("named")))
    rows = word_lists(counted.filter("kind != 'cue'")).limit(MOST_ENTRIES + 1).collect()
    cues = set_cues.select("word").limit(MOST_ENTRIES + 1).collect()
    if max(len(rows), len(cues)) > MOST_ENTRIES:
        raise ValueError("more listed words than expected of the languages: raise the thresholds")
    return build_models([tuple(r) for r in rows]), {r[0] for r in cues}


_FAR = re.compile(r"[\u0400-\uffef](?<![\u2000-\u2fff])")


def _letters(script: re.Pattern, text: str) -> int:
    """How many characters lie in the runs of a script."""
    return sum(map(len, script.findall(text)))


def language_of(text: str, models: dict[str, Model], said: str) -> str:
    """The language of a text: by its script, else by whose commonest words it has most of; its
    label settles a tie."""
    if not text.isascii() and _FAR.search(text):
        for code, script in _SCRIPTS:
            if _letters(script, text) * 8 > len(text):
                return code
    index = _common_words(models)
    votes = {said: 0.5}
    for word in set(text.split()) & index.keys():
        for code in index[word]:
            votes[code] = votes.get(code, 0) + 1
    return max(votes, key=votes.__getitem__)


_common: tuple[object, dict[str, list[str]]] = (None, {})


def _common_words(models: dict[str, Model]) -> dict[str, list[str]]:
    """The languages that each common word is common in; made once per set of models."""
    global _common
    if _common[0] is not models:
        words: dict[str, list[str]] = defaultdict(list)
        for code, model in models.items():
            if code != "und":
                for word in model.common:
                    words[word].append(code)
        _common = (models, dict(words))
    return _common[1]


def _split_set_cues(text: str, set_cues: set[str], heads: set[str]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The (offset, text) of ordinary cues and of set pieces, whose first letters are in `heads`."""
    plain, pieces, at = [], [], 0
    for cue in text.split(CUE):
        begin = cue[: 4 * HEAD].translate(_KEEP_CUES)[:HEAD] if len(cue) > SET_CUE_LENGTH[0] else ""
        known = begin and (begin in heads or len(begin) < HEAD) and not set_cues.isdisjoint(cue_keys(cue))
        (pieces if known else plain).append((at, cue))
        at += len(cue) + 1
    return plain, pieces


def sentence_ends(raw: str, models: dict[str, Model], set_cues: set[str], said: str = "und", heads: set[str] | None = None) -> list[int]:
    """Raw positions of the last character of each sentence; `heads` are the first letters of set cues."""
    heads = {c[:HEAD] for c in set_cues} if heads is None else heads
    run = running_text(raw)
    plain, pieces = _split_set_cues(run.text, set_cues, heads) if set_cues else ([], [])
    if not pieces:
        model = models.get(language_of(run.text, models, said)) or models.get(said) or Model()
        return sorted(set(map(run.raw, _ends(run.text, model))))
    out: set[int] = set()
    for at, piece in pieces:
        for m in re.finditer(r"[.!?]+(?=\s+\S)|\S(?=\s*\Z)", piece):
            out.add(run.raw(at + m.end() - 1))
    flow = CUE.join(c for _, c in plain)
    starts, offsets, size = [], [], 0
    for at, cue in plain:
        starts.append(size)
        offsets.append(at)
        size += len(cue) + 1
    where = lambda i: run.raw(offsets[k := bisect_right(starts, i) - 1] + i - starts[k])
    model = models.get(language_of(flow, models, said)) or models.get(said) or Model()
    out.update(where(i) for i in _ends(flow, model))
    return sorted(out)


def _starter(model: Model, case: str, thai: bool):  # noqa: ANN202
    """Does a sentence start with this word, as far as case and statistics say?"""
    starters, pauses = model.starters, model.pauses

    def starts(word: str, unknown: float = 0.6) -> bool:
        if not word:
            return True
        key = first_word(word)
        if case == "mixed" and _CASED.match(key):
            if key[0].islower():
                return key[0] == "l" and starters.get("I" + key[1:], 0) > 0.5
            return starters.get(key, unknown) >= 0.2
        if case == "one":
            share = pauses.get(key.lower())
            if share is not None:
                return share >= 0.5
            return max(starters.get(key.capitalize(), 0), starters.get(key.title(), 0)) >= 0.5
        return starters.get(key, 0) >= 0.4

    return starts


_BLANK = re.compile(rf"[\s{CUE}]*")
_TAKEN_UP = re.compile(rf"[\s{CUE}]*(?:\.\.\.|…)")
_CLAUSE_END = re.compile(r"[^\W\d_]{0,13}?([^\W\d_])(?=[。！？…，、：]|$)")
_LAST = re.compile(rf"[^\s{CUE}](?=[\s{CUE}]*\Z)")


def _ends(text: str, model: Model) -> Iterator[int]:
    n = len(text)
    case, thai = _case(text), not text.isascii() and _letters(_THAI, text) * 4 > n
    cues = [c for c in map(str.rstrip, text.split(CUE)) if c]
    closed = sum(not _TERMS.isdisjoint(c[-4:]) for c in cues)
    by_cue = not thai and closed < 0.12 * len(cues)  # marks are missing: every cue is a sentence
    starts, abbreviations = _starter(model, case, thai), model.abbreviations
    opening, closing, leading = model.clauses["opening"], model.clauses["closing"], model.clauses["leading"]
    m = _BLANK.match(text)
    d = _DASH.match(text, m.end())
    dialogue = d is not None
    lab = _LABEL.match(text, d.end() if d else m.end())
    begun = lab.end() if lab else 0  # where the sentence being read begins

    def last_char(i: int) -> int:
        while i >= begun and (text[i].isspace() or text[i] == CUE):
            i -= 1
        return i

    every = _THAI_CANDIDATE if thai else _CANDIDATE
    fewer = every if thai or by_cue else _FEWER
    after = 0
    while m := (every if dialogue else fewer).search(text, after):
        i, after = m.span()
        gap = m["gap"]
        if gap is not None:
            head = text[after : after + 1]
            lab = _LABEL.match(text, after) if head.isupper() else None
            d = _DASH.match(text, after) if head in "-–‐‑" and head else None
            if d is not None and not lab:
                lab = _LABEL.match(text, d.end())
            fresh = CUE in text[i:after]
            if dialogue or d or lab or not head or by_cue and fresh or thai:
                end = last_char(i - 1)
                if end >= begun and _ANY.search(text, begun, end + 1):
                    if not thai or dialogue or d or lab or not head or starts(text[after : after + 40]) and text[end] not in ".…":
                        yield end
                        begun = end + 1
            dialogue = d is not None
            if lab and begun <= after:
                begun = lab.end()
            continue
        if i < begun or not _ANY.search(text, begun, i + 1):
            continue  # leading marks, as of a cue that takes up an interrupted sentence
        if thai and m["space"] is not None:
            nxt = text[after : after + 40]
            before = text[max(begun, i - 12) : i]
            said = before[-3:] in leading
            if nxt[0] in "“\"" and not said or nxt[0] not in "“\"" and before[-1:] not in "”\"" and starts(nxt) and not said:
                end = last_char(i)
                yield end
                begun = end + 1
            continue
        shut = m["close"]
        term = text[i : after - len(shut)]
        end = after - 1
        follow = _NEXT.match(text, after)
        if follow is None:
            nxt = lead = ""
            sure = True
        else:
            lead, nxt = follow.groups()
            begins, head = follow.start(1), nxt[0]
            if begins + len(lead) == after and not _CJK.search(term + shut + head) and head not in _THAI_LETTERS and term[-1] not in "।॥؟":
                continue  # inside a word or number
            sure = False
            between = text[after : begins + len(lead)]
            if "\n" in between or CUE in between:
                sure = dialogue or text[begins] in "-–‐‑" and _DASH.match(text, begins) is not None
            lead = lead.strip()
        quoted = bool(shut) and not _QUOTES.isdisjoint(shut)
        go = True
        if term[-1] in _STRONG or term[0] in _STRONG:
            if quoted and not sure:
                heads = [_DIGITS.sub("#", w.strip("«„“\"'‘(),;:»”’!?…—–.").lower()) for w in (nxt + text[follow.end() : follow.end() + 60]).split()[:3]]
                if nxt[:1] in "，,、" or lead[:1] in ("—", "–", ",") or _CJK.match(nxt) and (nxt[0] in opening or (m := _CLAUSE_END.match(nxt)) and m[1] in closing) or case == "mixed" and nxt[:1].islower() or not model.speech.isdisjoint(heads):
                    go = False
            elif lead[:1] == "—" and not sure and (nxt[:1].islower() or case != "mixed"):
                go = False
        elif len(term) > 1 or term == "…":
            if not sure:
                if _TAKEN_UP.match(text, after):
                    go = False  # taken up again in the next cue
                elif _CJK.match(text[max(0, i - 1)]) or _CJK.match(nxt):
                    go = term.count("…") >= 2 or len(term) >= 4
                else:
                    go = starts(nxt, 1)
        else:
            if sure or quoted:
                yield end
                begun = after
                continue
            tail = text[max(begun, i - 40) : i].split()
            word = tail[-1].lstrip(_OPEN).lower() if tail else ""
            if not word.isalpha():
                word = _DIGITS.sub("#", word)
            share = abbreviations.get(word)
            if thai:
                go = share is None and starts(nxt)
            elif share is not None:
                go = share >= 0.02 and starts(nxt) and f"{word}\t{first_word(nxt)}" not in model.collocations
            elif len(word) == 1 and _CASED.match(word) or case == "mixed" and nxt[:1].islower():
                go = len(word) > 1 and starts(nxt)
        if go:
            yield end
            begun = end + 1
    end = last_char(n - 1)
    if end >= begun and _ANY.search(text, begun, end + 1):
        yield end


_THAI_LETTERS = {chr(c) for c in range(0x0E00, 0x0E80)}


def split_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, end_pos): the last character of every sentence of every document."""
    models, set_cues = learn(documents, text, lang)
    shared = documents.sparkSession.sparkContext.broadcast((models, set_cues))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = shared.value
        heads = {c[:HEAD] for c in pieces}
        for batch in batches:
            ids: list[int] = []
            ends: list[int] = []
            for d, t, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t and d is not None:
                    found = sentence_ends(t, known, pieces, (code or "und").strip().lower(), heads)
                    ends += found
                    ids += [d] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])

    def ends(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, end_pos long")

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    # ends of one row are distinct; only ids that come again need theirs made distinct
    again = rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    if again.isEmpty():
        return ends(rows)
    marked = join_lookup(rows, cut_lineage(again.select("doc_id", F.lit(True).alias("again"))), ["doc_id"])
    return ends(marked.filter("again is null")).unionByName(ends(marked.filter("again")).distinct())
