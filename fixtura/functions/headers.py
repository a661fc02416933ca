"""Which field of the project's mapping a CSV header names, in whatever wording."""

from __future__ import annotations

import re
from functools import lru_cache

#: The fields of the mapping, in their canonical order.
FIELDS = (
    "match_date",
    "kickoff_time",
    "home_team",
    "away_team",
    "home_goals",
    "away_goals",
    "full_time_result",
    "half_time_home_goals",
    "half_time_away_goals",
    "half_time_result",
    "home_shots",
    "away_shots",
    "home_shots_on_target",
    "away_shots_on_target",
    "home_fouls",
    "away_fouls",
    "home_corners",
    "away_corners",
)

#: The usual short codes of result files.
CODES = {
    "fthg": "home_goals",
    "ftag": "away_goals",
    "hg": "home_goals",
    "ag": "away_goals",
    "ftr": "full_time_result",
    "hthg": "half_time_home_goals",
    "htag": "half_time_away_goals",
    "htr": "half_time_result",
    "hs": "home_shots",
    "as": "away_shots",
    "hst": "home_shots_on_target",
    "ast": "away_shots_on_target",
    "hf": "home_fouls",
    "af": "away_fouls",
    "hc": "home_corners",
    "ac": "away_corners",
}

#: Words of spelled-out headers and what they stand for; "" is filler.
WORDS = {
    "home": "home", "h": "home", "hosts": "home", "host": "home",
    "away": "away", "a": "away", "visitors": "away", "visitor": "away", "visiting": "away", "guest": "away", "guests": "away",
    "half": "half", "halftime": "half", "ht": "half", "interval": "half",
    "full": "full", "fulltime": "full", "ft": "full", "final": "full",
    "goals": "goals", "goal": "goals", "score": "goals", "scored": "goals", "g": "goals",
    "result": "result", "res": "result", "outcome": "result", "r": "result",
    "shots": "shots", "shot": "shots", "attempts": "shots", "s": "shots",
    "target": "target", "sot": "target", "ontarget": "target",
    "fouls": "fouls", "foul": "fouls", "f": "fouls", "committed": "",
    "corners": "corners", "corner": "corners", "c": "corners", "kicks": "",
    "team": "team", "side": "team", "club": "team", "teams": "team",
    "date": "date", "day": "date",
    "time": "time", "kickoff": "kickoff", "kick": "kickoff", "off": "", "ko": "kickoff", "start": "kickoff",
    "match": "", "game": "", "fixture": "", "name": "", "of": "", "on": "", "the": "", "at": "", "no": "", "total": "", "number": "", "by": "", "local": "", "won": "", "taken": "",
}

_PIECES = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")
_GLUED = re.compile("|".join(sorted((w for w in WORDS if len(w) > 1), key=len, reverse=True)))


def _words(header: str) -> list[str] | None:
    """The known words of a header, or None if it holds anything else."""
    out: list[str] = []
    for piece in _PIECES.findall(header):
        low = piece.lower()
        if low in WORDS:
            out.append(WORDS[low])
            continue
        at = 0
        while at < len(low):
            m = _GLUED.match(low, at)
            if not m:
                return None
            out.append(WORDS[m.group()])
            at = m.end()
    return [w for w in out if w]


def field_of(header: str | None) -> str | None:
    """The mapped field that a header names, or None for a further column."""
    if header is None:
        return None
    compact = re.sub(r"[\W_]+", "", header).lower()
    if compact in CODES:
        return CODES[compact]
    words = _words(header)
    if not words:
        return None
    have = set(words)
    side = "home" if "home" in have else "away" if "away" in have else None
    if {"home", "away"} <= have:
        return None
    half = "half" in have
    if side and "target" in have:
        return f"{side}_shots_on_target"
    for measure in ("shots", "fouls", "corners"):
        if measure in have:
            return f"{side}_{measure}" if side and not half else None
    if "result" in have:
        return None if side else "half_time_result" if half else "full_time_result"
    if "goals" in have:
        return None if not side else f"half_time_{side}_goals" if half else f"{side}_goals"
    if half or "full" in have:
        return None
    if side:
        return f"{side}_team" if not have - {side, "team"} else None
    if "date" in have:
        return "match_date" if have == {"date"} else None
    if have <= {"time", "kickoff"}:
        return "kickoff_time"
    return None


def fields_of(headers: list[str]) -> list[str | None]:
    """The field of each column; of several columns of one field only the first counts."""
    seen: set[str] = set()
    out: list[str | None] = []
    for header in headers:
        field = field_of(header)
        out.append(None if field is None or field in seen else field)
        seen.add(field or "")
    return out


def _letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def _pairs(text: str) -> set[str]:
    padded = f"^{text}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


@lru_cache(maxsize=65_536)
def header_likeness(header: str, field: str) -> float:
    """How far a header's wording could name a field, in [0, 1]: 1 where its words say so, else the
    likeness of its letters to a name of the field (shared pairs of letters), which a header whose
    words name another field cannot claim."""
    named = field_of(header)
    if named is not None:
        return 1.0 if named == field else 0.0
    own = _letters(header)
    if len(own) < 4:
        return 0.0  # two or three letters are a code or nothing
    have = _pairs(own)
    known = [_letters(field), *(code for code, f in CODES.items() if f == field and len(code) > 3)]
    return max(2 * len(have & _pairs(name)) / (len(have) + len(_pairs(name))) for name in known)
