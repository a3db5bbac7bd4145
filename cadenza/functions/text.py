"""Text functions. All but the title case and the similarity are column expressions."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's limit on the bytes of a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lower the session's limit on the bytes of a batch to `most`: where rows are whole texts or pages, a worker holds a batch several times over."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES, "1g"))
    if now > most:
        spark.conf.set(BATCH_BYTES, f"{most}b")


#: Letters that have no decomposition (fixed values).
_WHOLE = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "ð": "d"}
_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def _fold_map() -> dict[str, str]:
    """Lower-case Latin letters with marks to their base letter, by Unicode decomposition."""
    out = dict(_WHOLE)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code).lower()
        base = unicodedata.normalize("NFKD", c)[:1]
        if len(c) == 1 and base != c and base.isascii() and base.isalpha():
            out[c] = base
    return out


_FROM, _TO = ("".join(x) for x in zip(*sorted(_fold_map().items()), strict=True))


def fold(c: Column | str) -> Column:
    """Lower case without accents; letters of other scripts stay."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"\p{M}+", "")
    for a, b in _PAIRS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    # Most texts have no letter to fold.
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(out)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))


#: Words that say nothing about which event it is (fixed values).
STOP_WORDS = ("corrida", "run", "race", "maratona", "meia", "de", "da", "do", "das", "dos", "em", "a", "o", "e", "na", "no", "para")


def title_tokens(c: Column | str) -> Column:
    """Words of a title that tell events apart: folded, without years 20xx and stop words."""
    words = F.split(F.regexp_replace(fold(c), "[^a-z0-9 ]", " "), " +")
    return F.filter(words, lambda w: (w != "") & ~w.rlike("^20[0-9]{2}$") & ~w.isin(*STOP_WORDS))


def title_key(c: Column | str) -> Column:
    return F.concat_ws(" ", title_tokens(c))


def tokens_contained(a: Column, b: Column) -> Column:
    """All words of the shorter list are in the longer one, and it has two at least."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return (F.size(short) >= 2) & (F.size(F.array_except(short, long)) == 0)


def link_key(c: Column | str, patterns: dict[str, str] | None = None) -> Column:
    """A link without trailing slashes, in lower case; patterns map a regex with one group to a prefix for its id."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lower(F.regexp_replace(c, "/+$", ""))
    for pattern, prefix in (patterns or {}).items():
        found = F.regexp_extract(c, pattern, 1)
        out = F.when(found != "", F.concat(F.lit(prefix), found)).otherwise(out)
    return out


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), "^www[.]", "")


def registered_domain(url: Column) -> Column:
    """Last two parts of the host, three under second-level registries."""
    p = F.split(host(url), "[.]")
    n = F.when((F.size(p) >= 3) & F.element_at(p, -2).isin("co", "com", "org", "net", "gov", "edu"), 3).otherwise(2)
    return F.concat_ws(".", F.slice(p, F.greatest(F.lit(1), F.size(p) - n + 1), n))


def clean_text(c: Column) -> Column:
    """Without control characters, white space squeezed."""
    return squeezed(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def has_entities(c: Column) -> Column:
    """HTML entities or doubly decoded UTF-8 left in a text."""
    return c.rlike("&(amp|lt|gt|quot|nbsp|#[0-9]+);") | c.rlike("Ã[\u0080-¿]")


def city_and_subdivision(c: Column) -> Column:
    """struct(city, subdivision) of 'City, XX', 'City-XX' or 'Place, City - XX'; empty where there is none."""
    place = F.regexp_extract(c, r"(?:^|,\s*)([^,]+?)\s*[-,]\s*([A-Z]{2})\s*$", 1)
    return F.struct(F.trim(place).alias("city"), F.regexp_extract(c, r"[-,]\s*([A-Z]{2})\s*$", 1).alias("subdivision"))


def last_part(c: Column, sep: str = ",") -> Column:
    return F.trim(F.element_at(F.split(c, sep), -1))


def matches_all_tokens(haystack: Column, needle: Column | str) -> Column:
    """Every word of the needle is somewhere in the (folded) haystack."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    words = F.filter(F.split(fold(needle), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(haystack, w))


#: States whose codes stay in capitals (fixed values).
STATES = frozenset("AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split())
_EDITION = re.compile(r"(?=[ivx])x{0,3}(?:ix|iv|v?i{0,3})[ªº°.,]?\Z", re.I)
_LENGTH = re.compile(r"\d+[km],?\Z", re.I)


def _title_word(word: str) -> str:
    if word.isupper() and word in STATES or _EDITION.match(word) or _LENGTH.match(word):
        return word.upper()
    return word.title()


def _title(raw: str | None) -> str:
    text = raw or ""
    for _ in range(3):
        text = html.unescape(text)
    return " ".join(_title_word(w) for w in "".join(c for c in text if unicodedata.category(c) != "So").split())


@F.pandas_udf(T.StringType())
def normal_title(titles: pd.Series) -> pd.Series:
    """Display form of a title: entities resolved, no emoji, title case with states, editions and lengths in capitals."""
    return titles.map(_title)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio of two title keys; 0 if either has fewer than two words."""
    two = (F.size(F.split(a, " ")) >= 2) & (F.size(F.split(b, " ")) >= 2)
    return F.when(two, sequence_ratio(F.when(two, a), F.when(two, b))).otherwise(0.0)


def display_city(c: Column, canonical: dict[str, str] | None = None) -> Column:
    """City name in title case with small articles and unchanged abbreviations; canonical maps folded names."""
    small = F.array(*map(F.lit, ("de", "da", "do", "das", "dos", "e", "del", "la", "el")))
    words = F.transform(
        F.split(squeezed(c), " "),
        lambda w, i: F.when((F.length(w) >= 2) & (w == F.upper(w)) & (F.size(F.split(squeezed(c), " ")) > 1), w)
        .when((i > 0) & F.array_contains(small, F.lower(w)), F.lower(w))
        .otherwise(F.initcap(w)),
    )
    out = F.array_join(words, " ")
    for key, name in (canonical or {}).items():
        out = F.when(fold(c) == key, F.lit(name)).otherwise(out)
    return out


def money(c: Column) -> Column:
    """'R$ 1.234,56' to 1234.56."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[R$\s]", ""), "[.]", "")
    return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")


def activity_title(c: Column, prefix: str = "", suffix: str = "") -> Column:
    """a title from an activity feed without the feed's prefix and suffix (patterns), emoji and loose marks at its ends."""
    out = F.trim(c)
    for pattern in filter(None, (prefix and f"^(?:{prefix})", suffix and f"(?:{suffix})$")):
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    out = squeezed(F.replace(F.regexp_replace(out, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", ""), F.lit("’"), F.lit("'")))
    return F.regexp_replace(out, r"^[\s\-–—·|]+|[\s\-–—·|]+$", "")


def plausible_city(c: Column, venue: str = r"(?i)\b(?:parque|park|arena|club|clube|shopping|hotel|pier|píer|deck)\b") -> Column:
    """whether a text may be a city: short, without digits, four words at most, no venue's word."""
    some = c.isNotNull() & (c != "") & (F.length(c) <= 35) & ~c.rlike(r"\d")
    return F.coalesce(some & (F.size(F.split(F.trim(c), r"\s+")) <= 4) & ~c.rlike(venue), F.lit(False))


def split_place(c: Column, country: str = "BR", names: str = r"bra(?:s|z)il") -> Column:
    """struct(city, second, country) of 'City, State, Country'; the country only where its name is in the text."""
    parts = F.filter(F.transform(F.split(c, "[,•·|]"), lambda x: F.trim(x)), lambda x: x != "")
    here = fold(c).rlike(names)
    return F.struct(F.coalesce(F.get(parts, 0), F.lit("")).alias("city"), F.when(here, F.coalesce(F.get(parts, 1), F.lit(""))).otherwise("").alias("second"), F.when(here, country).otherwise("").alias("country"))


def by_name(c: Column, language: str = "pt") -> Column:
    """A text as it sorts in a language, accents and case after letters."""
    return F.collate(c, language)
