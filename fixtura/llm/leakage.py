"""Evaluation passages inside a training corpus.

All items become one Aho-Corasick automaton over normalised text: letters and digits only, accents
and case dropped, letters that recognition confuses folded into one. Its patterns are the pieces of
the items that belong to one or two items only, so that wording which many items share raises no
candidates; where a long enough run of an item has too few of them (copies, overlapping items), all
its pieces. Copies of an item are one to it. Each document is normalised alike, read on across lines and cues, and scanned once. Every
hit is then checked exactly: the item is aligned with the text around its hits, and counts if at
least `least_words` running words (characters, in scripts without spaces) of it are found. Where the
run stands is mapped back to positions in the raw text.

The automaton is built once and broadcast behind a check of the items' number and letters; documents are mapped in place, without
a shuffle. Defined results: null and empty documents contain nothing; items with null text, or with
fewer words than `least_words`, are in no document; repeated documents and items give one row each.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.subtitles import spoken, spoken_mapped

LEAST_WORDS, LEAST_CHARACTERS = 15, 30
#: Bounds of what is broadcast: items and their letters (the automaton takes some hundred bytes a letter).
MOST_ITEMS, MOST_CHARACTERS = 200_000, 2_000_000
PIECE, PIECE_UNSPACED = 10, 6
#: Letters of a long enough run that its rare pieces cover at least; where fewer, shared pieces stand in too.
COVER, COVER_UNSPACED = 28, 12
#: Text between two found words that may belong to neither: fillers, repeats, a label.
MOST_BETWEEN = 40
#: Alignments made at once, and texts whose alignments are gathered for it.
ALIGNED, TEXTS = 32, 500
#: Share of a countable run from which on the whole item is aligned.
NEAR = 0.6

#: Letters that recognition confuses, each group folded into its first.
CONFUSED = ("li1j|", "o0", "s5", "ec", "hb", "tf", "a4", "g9q", "ト卜", "ニ二", "カ力", "ロ口", "エ工", "ハ八", "タ夕", "ヘへ", "一ー", "ミ三", "チ千", "日曰", "未末", "己已巳", "人入", "大太", "千干", "土士", "田由", "目自", "木本", "天夫", "问间", "候侯", "便使")
_FOLD = {ord(c): group[0] for group in CONFUSED for c in group[1:]}
_DROP = re.compile(r"[\W_]+")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


class _Folding(dict):
    """Character to what stands for it in comparison; each character is worked out once."""

    def __missing__(self, code: int) -> str | None:
        low = unicodedata.normalize("NFKC", chr(code)).lower().replace("ß", "ss")
        # only the marks of accents are dropped: kana keep their voicing
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", low) if not "\u0300" <= c <= "\u036f"))
        self[code] = _DROP.sub("", bare).translate(_FOLD) or None
        return self[code]


_FOLDING = _Folding()


def folding_table(keep: str = "") -> dict:
    """The folding as a table for str.translate that leaves the characters of `keep` as they are."""
    return _Folding({ord(c): c for c in keep})


def condense(text: str) -> str:
    """Letters and digits of a text, folded for comparison."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(_FOLDING)


@dataclass
class Item:
    item_id: int
    text: str  # condensed
    units: list[tuple[int, int, bool, int]]  # start, end in `text`; rare; length that counts
    unspaced: bool
    starts: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.starts = [u[0] for u in self.units]

    @property
    def least(self) -> int:
        return LEAST_CHARACTERS if self.unspaced else LEAST_WORDS

    @property
    def cover(self) -> int:
        return COVER_UNSPACED if self.unspaced else COVER


def prepare_items(items: list[tuple[int, str | None]]) -> list[Item]:
    """Condensed items cut into words, or characters where the script has no spaces."""
    cut = []
    for item_id, text in items:
        if not text or item_id is None:
            continue
        unspaced = len(_UNSPACED.findall(text)) * 2 > len(re.sub(r"\s", "", text))
        # of a script without spaces, marks count with the character before them
        raw = re.findall(r"\w\W*", re.sub(r"\s", "", text)) if unspaced else text.split()
        words = [(condense(w), len(w) if unspaced else 1) for w in raw]
        cut.append((item_id, unspaced, [(w, n) for w, n in words if w]))
    pieces = lambda unspaced, words: {a + b for (a, _), (b, _) in zip(words, words[1:], strict=False)} if unspaced else {w for w, _ in words}
    inside = Counter(p for _, unspaced, words in cut for p in pieces(unspaced, words))
    common = max(3, len(cut) // 50)
    out = []
    for item_id, unspaced, words in cut:
        at, units = 0, []
        for k, (w, n) in enumerate(words):
            if unspaced:  # a character is rare if both pairs that it is in are
                rare = all(inside[words[j][0] + words[j + 1][0]] <= common for j in (k - 1, k) if 0 <= j < len(words) - 1)
            else:
                rare = inside[w] < common
            if unspaced and rare and units and units[-1][2]:
                units[-1] = (units[-1][0], at + len(w), True, units[-1][3] + n)  # a name is one unit
            else:
                units.append((at, at + len(w), rare, n))
            at += len(w)
        out.append(Item(item_id, "".join(w for w, _ in words), units, unspaced))
    return out


def build_automaton(items: list[Item]):  # noqa: ANN201
    """Automaton over the pieces that at most two items hold, and over all pieces of runs that these
    hardly cover; a value is [(item index, offset)]."""
    import ahocorasick

    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, item in enumerate(items):
        size = PIECE_UNSPACED if item.unspaced else PIECE
        for at in range(len(item.text) - size + 1):
            where[item.text[at : at + size]].append((i, at))
    rare = {piece for piece, places in where.items() if len({i for i, _ in places}) <= 2}
    asked = [_shared_pieces(item, rare) for item in items]
    automaton = ahocorasick.Automaton()
    for piece, places in where.items():
        if kept := places if piece in rare else [(i, at) for i, at in places if at in asked[i]]:
            automaton.add_word(piece, (len(piece), kept))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _shared_pieces(item: Item, rare: set[str]) -> set[int]:
    """Offsets of all pieces of the shortest countable runs whose rare pieces cover too few letters."""
    size, out = PIECE_UNSPACED if item.unspaced else PIECE, set()
    is_rare = [item.text[at : at + size] in rare for at in range(len(item.text) - size + 1)]
    last = length = 0
    for first in range(len(item.units)):
        while last < len(item.units) and length < item.least:
            length += item.units[last][3]
            last += 1
        if length < item.least:
            break
        inside = range(item.units[first][0], item.units[last - 1][1] - size + 1)
        if len({x for at in inside if is_rare[at] for x in range(at, at + size)}) < item.cover:
            out.update(inside)
        length -= item.units[first][3]
    return out


def _align(texts: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[list[tuple[int, int]]]:
    """Of each (a, b, low, high), pairs of equal characters of the best local alignment of `a` with `b`
    whose places differ (in b less in a) by low up to high. All are worked out together, in a band that
    runs along the diagonal; the shorter ones are filled up with what equals nothing."""
    match, miss, gap = 2, -1, 1
    n, m = max(len(a) for a, *_ in texts), max(high - low for *_, low, high in texts) + 1
    left, right = np.full((len(texts), n), 0xFFFFFFFF, np.uint32), np.full((len(texts), n + m), 0xFFFFFFFE, np.uint32)
    for k, (a, b, low, high) in enumerate(texts):
        left[k, : len(a)] = a
        part = b[max(0, low) : max(0, len(a) + high)]
        right[k, max(0, -low) : max(0, -low) + len(part)] = part
    kind = np.int16 if match * n + gap * m < 32_000 else np.int32
    steps = (np.arange(m) * gap).astype(kind)
    h = np.zeros((n + 1, len(texts), m + 1), dtype=kind)  # the last column stays empty
    row, diagonal = np.empty((len(texts), m), kind), np.empty((len(texts), m), kind)
    for i in range(1, n + 1):
        before = h[i - 1]
        np.multiply(right[:, i - 1 : i - 1 + m] == left[:, i - 1 : i], kind(match - miss), out=diagonal)
        diagonal += before[:, :m]
        diagonal += kind(miss)
        np.subtract(before[:, 1:], kind(gap), out=row)
        np.maximum(row, diagonal, out=row)
        np.maximum(row, 0, out=row)
        row += steps
        np.maximum.accumulate(row, axis=1, out=row)
        np.subtract(row, steps, out=h[i, :, :m])
    return [_trace(h[: len(a) + 1, k], left[k], right[k], low, match, miss, gap) for k, (a, _, low, _) in enumerate(texts)]


def _trace(h: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, match: int, miss: int, gap: int) -> list[tuple[int, int]]:
    """Pairs of the alignment with the greatest value; column j of row i stands for place i - 1 + j + low."""
    i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    pairs = []
    at = h.item
    here = at(i, j)
    while i > 0 and here > 0:
        same = a[i - 1] == b[i - 1 + j]
        above = at(i - 1, j)
        if here == above + (match if same else miss):
            if same:
                pairs.append((i - 1, i - 1 + j + low))
            i, here = i - 1, above
        elif here == (up := at(i - 1, j + 1)) - gap:
            i, j, here = i - 1, j + 1, up
        else:
            j -= 1
            here = at(i, j)
    return pairs[::-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def longest_run(item: Item, text: str) -> tuple[int, int, int]:
    """(length, start, end): of the running words of the item found in `text`, and where."""
    return _run_of(item, dict(_align([(_codes(item.text), _codes(text), -len(item.text), len(text))])[0]))


def _run_of(item: Item, place: dict[int, int]) -> tuple[int, int, int]:
    """The longest run by the place of each found letter of the item."""
    best, run = (0, 0, 0), []

    def close() -> None:
        nonlocal best, run
        while run and run[-1][1] is None:
            run.pop()
        length = sum(n for n, _ in run)
        if length > best[0]:
            found = [p for _, ps in run if ps for p in ps]
            best = (length, found[0], found[-1])
        run = []

    last, loose = None, 0
    for start, end, rare, counted in item.units:
        found = [place[k] for k in range(start, end) if k in place]
        hit = len(found) >= (0.7 if rare else 0.5) * (end - start) and (not found or found[-1] - found[0] <= 2 * (end - start) + MOST_BETWEEN)
        if hit and last is not None and found[0] - last > MOST_BETWEEN:
            close()
        if hit:
            run.append((counted, found))
            last, loose = found[-1], 0
        elif rare or loose or not run:
            close()
            last, loose = None, 0
        else:
            run.append((counted, None))  # one worn word, between two found ones
            loose = 1
    close()
    return best


def _follow(a: str, b: str, i: int, j: int) -> list[tuple[int, int]]:
    """Pairs of equal letters from (i, j) on, stepping over single wrong, lost or added letters and
    over insertions of up to a few words in `b`; stops at the first place that is neither."""
    pairs = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
            continue
        ahead = a[i + 1 : i + 5]
        if len(ahead) == 4 and b.startswith(ahead, j + 1):
            i, j = i + 1, j + 1
        elif len(ahead) == 4 and b.startswith(ahead, j):
            i += 1
        else:
            at = b.find(a[i : i + 5], j + 1, j + 25) if i + 5 <= len(a) else -1
            if at < 0:
                break
            j = at
    return pairs


def _greedy_run(item: Item, text: str, doc: int, at: int) -> tuple[int, int, int] | None:
    """The run around a hit by following both texts from it, if that already is long enough."""
    place = dict(_follow(item.text, text, at, doc))
    low = max(0, doc - 2 * at - 60)
    for i, j in _follow(item.text[:at][::-1], text[low:doc][::-1], 0, 0):
        place[at - 1 - i] = doc - 1 - j
    run = _run_of(item, dict(sorted(place.items())))
    return run if run[0] >= item.least else None


def _around(item: Item, first: int, last: int) -> tuple[int, int]:
    """Letters of the item that any shortest countable run through the letters first..last lies in."""
    a, b = bisect_right(item.starts, first) - 1, bisect_right(item.starts, last) - 1
    for _ in range(2):  # a run may begin or end on a worn word
        a, b = max(0, a - 1), min(len(item.units) - 1, b + 1)
    before = after = 0
    while a > 0 and before < 1.5 * item.least:
        a -= 1
        before += item.units[a][3]
    while b + 1 < len(item.units) and after < 1.5 * item.least:
        b += 1
        after += item.units[b][3]
    return item.units[a][0], item.units[b][1]


def find_in_texts(texts: list[str], items: list[Item], automaton) -> list[list[tuple[int, int, int, int]]]:  # noqa: ANN001
    """Of each text, (item id, length of the run, start, end in the condensed text) of the items it contains.

    A hit that cannot simply be followed is aligned twice: first the part of the item that a countable
    run through the hit needs and as much again by half, which settles nearly all of them; of those
    that come near to passing, the whole item.
    """
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    open_: list[tuple] = []  # text, item, offset and characters to align with, band, letters of the item
    whole: dict[tuple[int, int, int], tuple] = {}
    for t, text in enumerate(texts):
        flat = condense(spoken(text))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, places) in automaton.iter(flat):
            for i, at in places:
                hits[i].append((end - size + 1, at))
        for i, pairs in hits.items():
            item = items[i]
            low, slack = 0, len(item.text) // 2 + 80

            def span(own: list[tuple[int, int]], a: int, b: int, flat: str = flat) -> tuple[int, str, int, int]:
                start = max(0, own[0][0] - (own[0][1] - a) * 3 // 2 - 60)
                text = flat[start : min(len(flat), own[-1][0] + (b - own[-1][1]) * 3 // 2 + 60)]
                # places may differ by what is lost or added over half of the way to either end
                off, far = [doc - start - (at - a) for doc, at in own], max(own[0][1] - a, b - own[-1][1]) // 2 + 60
                return start, text, min(off) - far, max(off) + far

            for k in range(len(pairs)):
                if k + 1 < len(pairs) and abs((pairs[k + 1][0] - pairs[k + 1][1]) - (pairs[k][0] - pairs[k][1])) <= slack:
                    continue
                own, low = pairs[low : k + 1], k + 1
                run = _greedy_run(item, flat, *own[len(own) // 2])
                if run is None:
                    a, b = _around(item, min(at for _, at in own), max(at for _, at in own))
                    open_.append((t, i, *span(own, a, b), a, b))
                    whole[t, i, open_[-1][2]] = (t, i, *span(own, 0, len(item.text)), 0, len(item.text))
                else:
                    best[t][i] = max(best[t].get(i, (0, 0, 0)), run)
    passed = [whole[key] for key in _runs(open_, items, best)]
    _runs(passed, items, best)
    return [[(items[i].item_id, *run) for i, run in runs.items()] for runs in best]


def _runs(asked: list[tuple], items: list[Item], best: list[dict[int, tuple[int, int, int]]]) -> list[tuple]:
    """Aligns what is asked, enters the runs that are long enough into `best`, and names what comes near."""
    asked, passed = sorted(asked, key=lambda o: (o[7] - o[6], o[5] - o[4])), []
    for k in range(0, len(asked), ALIGNED):
        part = asked[k : k + ALIGNED]
        for (t, i, at, _, _, _, a, _), pairs in zip(part, _align([(_codes(items[i].text[a:b]), _codes(flat), low, high) for _, i, _, flat, low, high, a, b in part]), strict=True):
            length, start, end = _run_of(items[i], {a + x: y for x, y in pairs})
            if length >= items[i].least:
                best[t][i] = max(best[t].get(i, (0, 0, 0)), (length, start + at, end + at))
            if length >= NEAR * items[i].least:
                passed.append((t, i, at))
    return passed


def _pieces_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest parts of a text that can be put into NFC on their own."""
    start = 0
    for k in range(1, len(text)):
        if not unicodedata.combining(text[k]) and unicodedata.normalize("NFC", text[k - 1 : k + 1]) == unicodedata.normalize("NFC", text[k - 1]) + unicodedata.normalize("NFC", text[k]):
            yield start, k
            start = k
    if text:
        yield start, len(text)


def condense_mapped(text: str) -> tuple[str, list[int]]:
    """As `condense(spoken(text))`, with the raw position of each letter."""
    flat, places = spoken_mapped(text)
    out, at = [], []
    whole = flat.isascii() or unicodedata.is_normalized("NFC", flat)
    for a, b in ((k, k + 1) for k in range(len(flat))) if whole else _pieces_of(flat):
        letters = condense(flat[a:b])
        out.append(letters)
        at += [places[a]] * len(letters)
    return "".join(out), at


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_items: int = MOST_ITEMS, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(doc_id, item_id, run_length, start_pos, end_pos) of each document and item of which it holds a
    long enough run: its length and the raw 0-based positions of its first and last letter, of the
    longest run (of several rows of one document, the greatest)."""
    rows = items.select(F.col(item_id).cast("long"), F.col(item_text)).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct()
    total = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    if total[0] > most_items or total[1] > most_characters:
        raise ValueError(f"more than {most_items} items or {most_characters} characters: scan them in parts")
    # copies of one item are one item to the automaton; its hits go to all their ids
    copies: dict[str, tuple[str, list[int]]] = {}
    for i, t in rows.collect():
        copies.setdefault(condense(t), (t, []))[1].append(i)
    ready = prepare_items([(k, t) for k, (t, _) in enumerate(copies.values())])
    shared = documents.sparkSession.sparkContext.broadcast((ready, build_automaton(ready), [ids for _, ids in copies.values()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton, ids = shared.value  # read once per worker
        for batch in batches:
            out = []
            if len(automaton):
                given_texts = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and d is not None]
                for at in range(0, len(given_texts), TEXTS):
                    part = given_texts[at : at + TEXTS]
                    for (d, t), found in zip(part, find_in_texts([t for _, t in part], known, automaton), strict=True):
                        places = condense_mapped(t)[1] if found else []
                        out += [(d, item, n, places[a], places[b]) for k, n, a, b in found for item in ids[k]]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "run_length", "start_pos", "end_pos"])

    found = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, "doc_id long, item_id long, run_length long, start_pos long, end_pos long")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("run_length", "start_pos", "end_pos")).alias("r")).select("doc_id", "item_id", "r.*")
