"""What a vitals row says: the measure its name means, the numbers of its value, the unit it claims.

Pure Python over distinct strings; the operators call it from Arrow UDFs that first reduce a batch to its distinct
strings, so the cost follows the number of different texts, not of rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .editing import osa

# Missing tokens, compared after trimming and in lower case.
MISSING = frozenset(
    ["", "na", "n/a", "nan", "null", "none", ".", "-", "?", "see note", "see comment", "tnp", "pending"]
)
MISSING_ID = MISSING | {"unknown"}
MISSING_UNIT = MISSING | {"unknown", "missing"}

# Phrases that mean a measure, beside the reference list's own names.
PHRASES = {
    "bp": ["blood pressure", "bp", "b/p", "nibp"],
    "pulse": ["pulse", "hr", "heart rate", "pulse rate", "heart rate pulse"],
    "temperature": ["temperature", "temp", "body temperature", "temp oral", "temp celsius", "temp fahrenheit"],
    "respirations": ["respirations", "rr", "resp", "resp rate", "respiratory rate", "respiration"],
    "spo2": ["spo2", "sp02", "o2 sat", "pulse ox", "pulse oximetry", "o2 saturation", "oxygen saturation"],
    "height": ["height", "ht", "stature", "height length", "body height", "standing height"],
    "weight": ["weight scale", "wt", "body weight", "weight"],
    "bmi": ["body mass index", "bmi", "body mass ind", "bmi calculated", "bmi calc"],
    "pain_score": ["pain score", "nrs pain", "pain"],
    "o2_device": ["o2 device", "oxygen delivery", "o2 delivery device", "oxygen device", "o2 device type"],
    "patient_position": ["patient position", "bp position", "position", "pt position"],
}
# Words that leave the measure as it is (place, posture, manner, unit).
HARMLESS = frozenset(
    "r l ed right left arm leg manual automatic sitting standing lying supine oral tympanic axillary rectal temporal core apical "
    "radial calculated calc stated measured estimated reported bed scale length at rest per min minute mmhg kpa kg lb lbs oz "
    "in cm m c f percent fraction pounds ounces inches centimeters meters celsius fahrenheit type rate nibp 0 10 the of".split()
)
# Words that make another quantity of it.
CHANGING = frozenset(
    "goal target ideal dry birth change gain loss mean map arterial line variation circumference output risk fall head "
    "peak flow braden total note urine adjusted predicted previous usual cuff intracranial venous fetal".split()
)
# Spellings of units, without blanks and in lower case.
UNITS = {
    "kg": ["kg", "kg.", "kgs", "kilograms", "kilogram"],
    "lb": ["lb", "lbs", "lbs.", "lb.", "pounds", "pound", "[lb_av]"],
    "oz": ["oz", "ounces", "ounce", "[oz_av]", "oz."],
    "cm": ["cm", "cm.", "centimeters", "centimeter"],
    "in": ["in", "in.", "inches", "inch", '"', "[in_i]"],
    "ft_in": ["ft/in", "ft-in", "ftin"],
    "m": ["m", "meters", "meter", "m."],
    "degC": ["c", "degc", "°c", "cel", "celsius"],
    "degF": ["f", "degf", "°f", "[degf]", "fahrenheit"],
    "mmHg": ["mmhg", "mm[hg]"],
    "kPa": ["kpa"],
    "pct": ["%", "pct", "percent"],
    "fraction": ["fraction", "ratio", "0-1"],
    "mg/dL": ["mg/dl", "mg%", "mg/100ml"],
    "umol/L": ["umol/l", "µmol/l", "μmol/l", "micromol/l", "mcmol/l", "umol"],
}
UNIT_OF = {s: u for u, many in UNITS.items() for s in many}
QUANTITY_UNITS = {
    "weight": ["kg", "lb", "oz"],
    "height": ["cm", "in", "ft_in", "m"],
    "temperature": ["degC", "degF"],
    "bp": ["mmHg", "kPa"],
    "spo2": ["pct", "fraction"],
    "creatinine": ["mg/dL", "umol/L"],
}
NUMERIC = ("bp", "pulse", "temperature", "respirations", "spo2", "height", "weight", "bmi", "pain_score")
TEXTUAL = ("o2_device", "patient_position")

_WORD = re.compile(r"[a-z0-9]+")


def is_missing(text: str | None, tokens: frozenset[str] = MISSING) -> bool:
    return text is None or text.strip().lower() in tokens


class MeasureNames:
    """Maps a typed measure name to ``attribute`` of the reference list, or None if the list has none.

    A name that is exactly a known phrase plus harmless words is decided by its words; any other one by the edit distance
    of its letters to every known phrase, relative to the length. A changing word (goal, dry, ...) always means none;
    short ones must be spelled right, lest "ain" become "gain" where "pain" is meant.
    """

    def __init__(self, reference: list[tuple[str, str | None, str]], tolerance: float = 0.3) -> None:
        self.tolerance = tolerance
        phrases: dict[str, str] = {}
        for name, also, attribute in reference:
            for text in [name, *(also or "").split(";"), *PHRASES.get(attribute, [])]:
                if key := " ".join(_WORD.findall(text.lower())):
                    phrases.setdefault(key, attribute)
        self.phrases = phrases
        self.by_length = sorted(phrases.items(), key=lambda x: (-len(x[0]), x[0]))
        self.compact = [(k.replace(" ", ""), a) for k, a in self.by_length]
        self.words = sorted({w for k in phrases for w in k.split()} | HARMLESS | CHANGING, key=lambda w: (-len(w), w))
        self.known = set(self.words)
        self.memo: dict[str | None, str | None] = {}

    def resolve(self, name: str | None) -> str | None:
        if name not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[name] = self._resolve(name)
        return self.memo[name]

    def _resolve(self, name: str | None) -> str | None:
        if is_missing(name):
            return None
        words = _WORD.findall(name.lower())
        if not words:
            return None
        if any(w in CHANGING for w in words):
            return None
        if (found := self._exact(words)) and all(w in self.known or len(w) < 4 for w in words):
            return found
        joined = self._rejoin(words)
        if any(w in CHANGING for w in joined):
            return None
        if joined != words and (found := self._exact(joined)) and all(w in self.known or len(w) < 4 for w in joined):
            return found
        return self._near(words) or self._exact(joined)

    def _exact(self, words: list[str]) -> str | None:
        """The longest known phrase that occurs among the words, in order."""
        text = f" {' '.join(words)} "
        for phrase, attribute in self.by_length:
            if f" {phrase} " in text:
                return attribute
        return None

    def _near(self, words: list[str]) -> str | None:
        """The known phrase nearest to all letters, or to those without trailing or leading words that repair to harmless ones."""
        best, found = 9.0, None
        letters = "".join(words)
        for phrase, attribute in self.compact:
            limit = int(len(phrase) * self.tolerance)
            if limit and (d := osa(letters, phrase, limit)) <= limit and d / len(phrase) < best:
                best, found = d / len(phrase), attribute
        return found

    def _rejoin(self, words: list[str]) -> list[str]:
        """Words repaired one by one; where none is near, cut in two or joined with the next, for blanks typed wrongly."""
        out: list[str] = []
        i = 0
        while i < len(words):
            w = words[i]
            pair = w + words[i + 1] if i + 1 < len(words) else ""
            if w in self.known:
                out.append(w)
            elif pair and pair in self.known:
                out.append(pair)
                i += 1
            elif (one := self._repair(w)) is not None:
                out.append(one)
            elif pair and (one := self._repair(pair)) is not None:
                out.append(one)
                i += 1
            else:
                out.extend(self._cut(w))
            i += 1
        return out

    def _repair(self, word: str) -> str | None:
        limit = 0 if len(word) < 3 else 1 if len(word) < 6 else 2 if len(word) < 9 else 3
        best, found = limit + 1, None
        for w in self.words:
            if len(w) > 2 and (w not in CHANGING or len(w) > 5) and (d := osa(word, w, min(limit, len(w) // 3))) < best and d <= len(w) // 3:
                best, found = d, w
        return found

    def _cut(self, word: str) -> list[str]:
        best, found = 9, [word]
        for k in range(2, len(word) - 1):
            a, b = word[:k], word[k:]
            x, y = (a if a in self.known else self._repair(a)), (b if b in self.known else self._repair(b))
            if x and y and (d := osa(a, x, 3) + osa(b, y, 3)) < best:
                best, found = d, [x, y]
        return found


_NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"
_FEET = re.compile(r"^\s*(\d+)\s*(?:'|ft\.?|feet|foot)\s*(?:(\d+(?:\.\d+)?)\s*(?:\"|''|in\.?|inches)?)?\s*$", re.I)
_PAIR = re.compile(rf"^\s*({_NUMBER})\s*/\s*(?:({_NUMBER})|-*)\s*(.*?)\s*$")
_ONE = re.compile(rf"^\s*[<>~=]*\s*({_NUMBER})\s*(.*?)\s*$")


@lru_cache(200_000)
def parse_value(text: str | None) -> tuple[float | None, float | None, str | None]:
    """First number, second number (of a pair, or inches of feet-and-inches as total inches), unit written in the text.

    Feet and inches give the total inches as the first number and ``ft_in`` as unit. No number: three times None.
    """
    if is_missing(text):
        return None, None, None
    if m := _FEET.match(text):
        return int(m[1]) * 12 + float(m[2] or 0), None, "ft_in"
    if m := _PAIR.match(text):
        return _float(m[1]), _float(m[2]) if m[2] else None, unit_code(m[3])
    if m := _ONE.match(text):
        return _float(m[1]), None, unit_code(m[2])
    return None, None, None


def _float(text: str) -> float:
    return float(text.replace(",", ""))


@lru_cache(10_000)
def unit_code(text: str | None) -> str | None:
    """The unit that a label spells, or None."""
    if is_missing(text, MISSING_UNIT):
        return None
    return UNIT_OF.get(re.sub(r"\s+", "", text.lower()))


_NAMED_UNIT = re.compile(r"\(([^()]+)\)\s*$|\bin\s+([a-z]+)\s*$|\b(celsius|fahrenheit|kg|mmhg)\s*\)?$|(%)\s*$", re.I)


@lru_cache(50_000)
def unit_in_name(name: str | None) -> str | None:
    """The unit at the end of a measure's name: ``WEIGHT/SCALE (KG)``, ``Height in inches``, ``Temp Celsius``."""
    if name is None or not (m := _NAMED_UNIT.search(name.strip())):
        return None
    return unit_code(next(x for x in m.groups() if x))


def clean_id(text: str | None) -> str | None:
    return None if is_missing(text, MISSING_ID) else text.strip()
