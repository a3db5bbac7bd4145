"""Race distances: from prose, from units and names, rounding for comparison, and labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF, FULL = 21.097, 42.195
KM_A_MILE = 1.60934

_PRICE = re.compile(r"(?:R\$|US?\$|[$€£])\s*\d+(?:[.,]\d{1,2})?")
#: One regex splits prose into named distances, numbers (with a unit or not) and what may join them.
_TOKEN = re.compile(
    r"(?P<half>meia[\s-]?maratona|half[\s-]?marathon|medi[oa][\s-]?marat[oó]n)"
    r"|(?P<full>\b(?:maratona|marathon|marat[oó]n)\b)"
    r"|(?<![:.,\d])(?P<number>\d+(?:[.,]\d+)?)(?:\s*(?P<unit>km?)\b)?"
    r"|(?P<join>\s*(?:[,;/|]|\b(?:e|ou|y|and)\b)\s*)"
    r"|(?P<other>\S)",
    re.I,
)
_LABEL = re.compile(r"(?:dist[âa]ncia|modalidade|percurso|prova|categoria|trajeto|recorrido)s?\s*:?\s*$", re.I)


def snapped(km: float) -> float:
    """Half and full marathon lengths to their exact values."""
    return FULL if 41.5 <= km <= 43.0 else HALF if 20.5 <= km <= 21.5 else km


def thinned(values: list[float], least: float, most: float, apart: float = 0.5) -> list[float]:
    """Values in range, snapped; one too near to an earlier one is left out."""
    out: list[float] = []
    for v in values:
        if least <= v <= most and all(abs(snapped(v) - x) >= apart for x in out):
            out.append(snapped(v))
    return out


def _runs(text: str) -> list[list[tuple[str, float | None, bool, int]]]:
    """Tokens that only joins part: (kind, value, has unit, place in the text)."""
    runs: list[list] = [[]]
    joined = True
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "unit" else "number"
        if kind == "join":
            joined = bool(runs[-1])
        elif kind == "other":
            runs.append([])
        else:
            if not joined:
                runs.append([])
            value = {"half": HALF, "full": FULL}.get(kind)
            runs[-1].append((kind, value if value else float(m["number"].replace(",", ".")), bool(m["unit"]) or kind != "number", m.start(), m["number"] or ""))
            joined = False
    return [r for r in runs if r]


def distances_in(text: str | None, title: str = "", least: float = 3.0, most: float = 200.0, limit: int = 8, named: bool = False) -> list[float]:
    """Distances in km of an enumeration, else of a labelled value, else of any number with a unit."""
    text = _PRICE.sub(" ", text or "")
    runs = _runs(text)
    found: list[float] = []
    if named:
        found += [t[1] for r in runs for t in r if t[0] != "number"]
    for r in runs:
        units = [i for i, t in enumerate(r) if t[2]]
        if len(r) > 1 and units:
            # A unit after the last of several numbers holds for all before it.
            found += [t[1] for t in r[: units[-1] + 1] if t[0] != "number" or t[2] or not re.fullmatch(r"\d+[.,]\d\d", t[4])]
    if not found:
        found = [t[1] for r in runs for t in r[:1] if t[2] and _LABEL.search(text[: t[3]])]
    if not found:
        found = [t[1] for r in runs for t in r if t[0] == "number" and t[2]]
    if not found and (inner := re.search(r"\(([^)]*\d\s*km?\b[^)]*)\)", title, re.I)):
        found = [t[1] for r in _runs(inner[1]) for t in r if t[0] == "number" and t[2]]
    return sorted(thinned(found, least, most)[:limit])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def extract_distances(texts: pd.Series, titles: pd.Series) -> pd.Series:
    """Distances in km that a text (or else the title's brackets) gives, ascending."""
    return pd.Series([distances_in(t, h or "") for t, h in zip(texts, titles, strict=True)])


def km_key(d: Column) -> Column:
    """What two distances must share to be the same: whole km (half to even) or the label."""
    return F.coalesce(F.bround(d["km"]).cast("long").cast("string"), d["label"])


def thin(values: Column, apart: float = 0.5) -> Column:
    """Ordered fold: a value nearer than `apart` to one already kept is left out."""
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda kept, v: F.when(F.exists(kept, lambda k: F.abs(k - v) < apart), kept).otherwise(F.concat(kept, F.array(v))))


def named_distance(c: Column) -> Column:
    """km of a worded distance ('meia', 'dez', '10k'); null if there is none."""
    low = F.lower(c)
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for word, km in (("cinco", 5.0), ("dez", 10.0), ("quinze", 15.0), ("vinte", 20.0), ("meia", HALF), ("half", HALF), ("maratona", FULL), ("marathon", FULL), ("full", FULL)):
        out = out.when(low.contains(word), km)
    return out.otherwise(F.replace(F.regexp_extract(low, r"(\d+(?:[.,]\d+)?)\s*k", 1), F.lit(","), F.lit(".")).try_cast("double"))


def from_units(value: Column, unit: Column) -> Column:
    """struct(km, label) of a number and its unit: K and metres give km, M and miles give a label."""
    u = F.lower(F.trim(unit))
    km = F.when(u.isin("k", "km"), value).when(u.isin("meters", "metres", "m.", "metros"), F.bround(value / 1000, 3))
    label = F.when(u.isin("m", "mi", "mile", "miles"), F.concat(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(" mi"))).when(
        u.isin("h", "hour", "hours"), F.concat(value.cast("int").cast("string"), F.lit("h"))
    )
    return F.struct(km.alias("km"), label.alias("label"))


def label_miles(label: Column) -> Column:
    """Length in km of a label in miles."""
    return F.regexp_extract(label, r"^\s*(\d+(?:\.\d+)?)\s*mi", 1).try_cast("double") * KM_A_MILE


def km_label(d: Column) -> Column:
    """'42K', '21K', '10K', or the label as it is."""
    km = d["km"]
    return F.when(km.isNull(), d["label"]).when(km.between(42, 42.2), "42K").when(km.between(21, 21.1), "21K").otherwise(F.concat(F.regexp_replace(km.cast("string"), r"\.0$", ""), F.lit("K")))


#: Numbers in words that stand before miles (fixed values).
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
_HALF_WORDS = r"half[\s-]?marathon|\bhalf\b|1\s*/\s*2\s*marathon"


def spelled_distances(text: Column) -> Column:
    """distances of an English title as texts: half and full marathon, km, then 'N mi' and 'Nh'; each once.

    km of 3 to 200, miles of 1 to 200 in digits or words, hours of timed events. Lengths that round
    to the same km are one.
    """
    low = F.lower(text)
    found = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    plain = lambda x: F.regexp_replace(x, r"\.0+$", "")
    fixed = F.array(F.when(low.rlike(_HALF_WORDS), F.lit(HALF)), F.when(F.regexp_replace(low, _HALF_WORDS, "").rlike(r"\bmarathon\b"), F.lit(FULL)))
    kms = F.filter(F.transform(found(r"\b(\d+(?:\.\d+)?)\s*km?\b"), lambda x: x.cast("double")), lambda x: x.between(3, 200))
    every = F.array_compact(F.concat(fixed, kms))
    once = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: F.bround(y)), F.bround(x)) == i + 1)
    digits = F.filter(found(r"\b(\d+(?:\.\d+)?)\s*-?\s*mile[rs]?\b"), lambda x: x.cast("double").between(1, 200))
    words = F.transform(found(rf"\b({'|'.join(NUMBER_WORDS)})\s*-?\s*mile[rs]?\b"), lambda w: F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), w).cast("string"))
    miles = F.transform(F.concat(digits, words), lambda x: F.concat(plain(x), F.lit(" mi")))
    hours = F.transform(found(r"\b(\d+)\s*-?\s*(?:hours?|hrs?)\b"), lambda x: F.concat(x, F.lit("h")))
    return F.concat(F.transform(F.array_sort(once), lambda x: plain(x.cast("string"))), F.array_distinct(F.concat(miles, hours)))


def expanded_units(text: Column) -> Column:
    """a unit that several numbers share is written behind each: '5/10km', '5 e 10 km' to '5km 10km'."""
    shared = F.regexp_replace(text, r"(\d+(?:[.,]\d+)?)\s+e\s+(\d+(?:[.,]\d+)?)\s+([kK][mM])\b", "$1$3 $2$3")
    # A number followed by more numbers and slashes up to a unit gets that unit.
    return F.regexp_replace(shared, r"(?<![\d.,])(\d+(?:[.,]\d+)?)/(?=(?:\d+(?:[.,]\d+)?/)*\d+(?:[.,]\d+)?\s*([kK][mM]?)\b)", "$1$2 ")


_SECTION_KM = re.compile(r"(?<![.,\d])(\d+(?:[.,]\d+)?)\s*km\b", re.I)
_SECTION_TIME = re.compile(r"(\d{1,2})h(\d{2})\b")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("km", T.DoubleType()), T.StructField("start_time", T.StringType())])))
def section_times(texts: pd.Series) -> pd.Series:
    """(km, start time) of regulations: a heading line that ends in a colon and names lengths, and the first time within four lines below it."""

    def one(text: str | None) -> list[dict]:
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        out: dict[float, str] = {}
        for i, line in enumerate(lines):
            kms = [snapped(float(x.replace(",", "."))) for x in _SECTION_KM.findall(line)] if line.endswith(":") else []
            times = [m for m in map(_SECTION_TIME.match, lines[i + 1 : i + 5]) if m]
            if times and 4 <= int(times[0][1]) <= 22:
                for km in kms:
                    if 3 <= km <= 200:
                        out.setdefault(km, f"{int(times[0][1]):02d}:{times[0][2]}")
        return [{"km": k, "start_time": v} for k, v in out.items()]

    return texts.map(one)


def plausible_km(km: Column, least: float, most: float, usual: float) -> Column:
    """A length found on a page of one known event if it is in range, else the usual one."""
    return F.when(km.between(least, most), km).otherwise(F.lit(usual))
