"""Which events are valid, and what is wrong with the others."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.dates import time_required
from cadenza.functions.distance import label_miles
from cadenza.functions.text import has_entities, host, registered_domain
from cadenza.schema import KINDS

# Word lists that decide validity (fixed values).
NAVIGATION_TITLES = (
    "calendário", "calendario", "calendrio", "listagem completa", "listagem", "sugira uma corrida", "sugira corrida",
    "outros estados", "estados", "distrito federal",
    "espírito santo", "mato grosso", "mato grosso do sul", "minas gerais", "pernambuco", "rio de janeiro",
    "rio grande do norte", "rio grande do sul", "são paulo", "santa catarina", "calendário completo", "home", "menu",
    "buscar", "search", "início", "inicio", "sobre", "contato",
)
NAVIGATION_PARTS = (
    "quero dicas", "por e-mail", "experiências além", "para todos e variados", "roteiros que fogem", "inspirações para",
    "suplementação saudável", "do treino ao lifestyle", "calendrio completo", "outros estados:",
)
OTHER_SPORTS = (
    "pedal", "ciclismo", "ciclista", "bicicleta", " bike ", "mtb", "cycling", "cyclist", "pedalada", "gravel", "velódromo",
    "velodrome", "granfondo", "gran fondo", "gran-fondo", "fondo", "sportive", "uci ", "uci-", "l'étape", "l etape", "letape",
    " gf ", "triathlon", "triathon", "duathlon", "ironman", "swimrun", "aquabike", "aqua bike", "aquathlon", "natação",
    "natacao", "nado ", "águas abertas", "aguas abertas", "travessia", "aquático", "aquatica", "remo ", "canoagem", "kayak",
    "caiaque", "stand up paddle", "stand-up paddle", "futebol", "voleibol", "vôlei", "volei", "basquete", "basquetebol",
    "handball", "handebol", "tênis", "badminton", "esgrima",
)
KIDS_BRANDS = r"(?i)\bmarotinga\b|pezinho\s+veloz"
KIDS_WORDS = r"(?i)\binfantil\b|\bmirim\b|\bkids?\s+run\b|\bkids?\s+dash\b|corrida\s+(?:de\s+)?kids|baby\s+run|\bkids?\s+marathon\b"
#: A heading of what comes next, in two words.
NEXT_HEADING = r"^pr[oó]ximas\s+\p{L}+$"
# What structured fields say of a cancelled event in the sources' languages, and beginnings of words that do (fixed values).
CANCELLED = ("cancelad", "canceled", "cancelled", "abgesagt", "annullat", "geannuleerd", "odwołan")
CANCELLED_WORDS = ("annul",)
# Words in hosts that do not serve an event's images, and networks that serve anyone's (fixed values).
SUSPICIOUS_HOSTS = (
    "casino", "silver", "gold", "crypto", "bet", "poker", "loan", "forex", "pharma", "adult", "xxx", "porn", "drug", "pill",
    "slot", "wager", "clickad", "doubleclick", "adserv", "tracker", "analytics",
)
TRUSTED_NETWORKS = (
    "cloudfront.net", "amazonaws.com", "bubble.io", "wixstatic.com", "imgix.net", "fastly.net", "akamaized.net", "cloudinary.com",
    "staticflickr.com", "cdn.jsdelivr.net", "londonmarathonevents.co.uk",
)


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text has one of the words."""
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def has_adult_distance(distances: Column, least: float = 3.0) -> Column:
    return F.exists(distances, lambda d: F.coalesce(d["km"], label_miles(d["label"])) >= least)


def is_kids_only(title: Column, distances: Column) -> Column:
    """A children's brand, or children's wording without a distance for adults."""
    return title.rlike(KIDS_BRANDS) | (title.rlike(KIDS_WORDS) & ~F.coalesce(has_adult_distance(distances), F.lit(False)))


def is_cancelled(*signals: Column) -> Column:
    """Any structured signal says so, in any of the languages."""
    marks = "|".join([*map(re.escape, CANCELLED), *(rf"\b{re.escape(w)}" for w in CANCELLED_WORDS)])
    return F.coalesce(F.exists(F.array(*signals), lambda s: s.rlike(f"(?iu){marks}")), F.lit(False))


def violations(df: DataFrame, site_names: tuple[str, ...] = ()) -> Column:
    """Names of the rules that an event breaks; empty for a valid one. A title that is only a site's name counts as navigation."""
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    rules = {
        "no_location": F.coalesce(F.trim("location_text"), F.lit("")) == "",
        "short_title": F.length(title) < 4,
        "navigation_title": title.isin(*NAVIGATION_TITLES, *site_names) | any_of(title, NAVIGATION_PARTS) | title.rlike(NEXT_HEADING),
        "other_sport": any_of(title, OTHER_SPORTS) | title.rlike(r"\btri\d"),
        "kids_only": is_kids_only(title, F.col("distances")),
        "no_date": F.col("event_date").isNull(),
        "no_distance": F.coalesce(F.size("distances"), F.lit(0)) < 1,
        "single_long_word": title.rlike(r"^\p{L}{21,}$"),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(F.size(violations(events)) == 0)


def rejected_events(events: DataFrame) -> DataFrame:
    """Events with a reason each: the report beside valid_events (O3)."""
    return events.withColumn("rule", F.explode(violations(events)))


def record_problems(events: DataFrame) -> DataFrame:
    """(id, problem) of every rule a published record breaks."""
    link = F.coalesce(F.get(F.flatten(F.transform("listings", lambda x: F.coalesce(x["signup_urls"], F.array()))), 0), F.lit(""))
    rules = {
        "no_date": F.col("event_date").isNull(),
        "no_title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "entities_in_title": has_entities(F.col("title")),
        "no_distance": F.coalesce(F.size("distances"), F.lit(0)) < 1,
        "no_country": F.coalesce(F.col("country"), F.lit("")).isin("", "??", "INT"),
        "no_listing": F.coalesce(F.size("listings"), F.lit(0)) < 1,
        "link_not_http": ~link.rlike("^https?://") & (link != ""),
        "many_listings": F.size("listings") >= 6,
    }
    return events.select("id", F.explode(F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())))).alias("problem"))


def safe_image(url: Column, page: Column | None = None, trusted: tuple[str, ...] = TRUSTED_NETWORKS, suspicious: tuple[str, ...] = SUSPICIOUS_HOSTS) -> Column:
    """The image's address, unless its host has a suspicious word, or is neither of the page's domain nor of a trusted network; null then.

    Without a page only the host's words count. A network is trusted with all hosts below it.
    """
    of = host(url)
    ok = url.startswith("http") & (of != "") & ~any_of(of, suspicious)
    if page is None:
        return F.when(ok, url)
    below = F.exists(F.array(*map(F.lit, trusted)), lambda t: of.endswith(F.concat(F.lit("."), t))) if trusted else F.lit(False)
    own = registered_domain(url)
    return F.when(ok & ((F.coalesce(page, F.lit("")) == "") | own.isin(*trusted) | below | (own == registered_domain(page))), url)


def in_horizon(date: Column, as_of: Column, days: int = 365) -> Column:
    """P7."""
    return date.between(as_of, F.date_add(as_of, days))


def with_signup_links(listings: Column) -> Column:
    """A listing without signup links gets its page as one."""
    return F.transform(listings, lambda x: x.withField("signup_urls", F.when(F.coalesce(F.size(x["signup_urls"]), F.lit(0)) < 1, F.array(x["page_url"])).otherwise(x["signup_urls"])))


def has_link(listings: Column) -> Column:
    """P10."""
    return F.exists(listings, lambda x: (F.coalesce(x["page_url"], F.lit("")) != "") | (F.coalesce(F.size(x["signup_urls"]), F.lit(0)) > 0))


def is_sport(title: Column, excluded: str, area: Column | None = None, areas: str = "", rescue: str = "") -> Column:
    """P5: not one of the excluded sports, and of a wanted area; events without an area pass, and a rescue word in the title outdoes another area."""
    title = F.coalesce(title, F.lit(""))
    out = ~title.rlike(excluded)
    if area is not None:
        wanted = F.coalesce(area, F.lit("")).rlike(f"(?i)^$|{areas}") | (title.rlike(rescue) if rescue else F.lit(False))
        out = out & wanted
    return out


#: What stands in place of a city or an address of events held nowhere, and postal codes of forces abroad (fixed values).
VIRTUAL_PLACES = ("de onde você estiver", "de onde voce estiver", "não informado", "nao informado", "virtual", "online", "anytime")
FORCES = ("AA", "AE", "AP")


def is_virtual(title: Column, place: Column, country: Column, subdivision: Column) -> Column:
    """An event without a place of its own."""
    nowhere = F.lower(F.trim(F.coalesce(place, F.lit("")))).isin(*VIRTUAL_PLACES)
    abroad = (country == "US") & subdivision.isin(*FORCES)
    return F.coalesce(title.rlike(r"(?i)\bvirtual\b"), F.lit(False)) | nowhere | F.coalesce(abroad, F.lit(False))


def for_adults(events: DataFrame, as_of: Column, months: int = 0) -> DataFrame:
    """Events that are not for children only and that have a start time where one is required."""
    untimed = (F.coalesce("start_time", F.lit("")) == "") & time_required(F.col("event_date"), as_of, months)
    return events.filter(~F.coalesce(is_kids_only(F.col("title"), F.col("distances")), F.lit(False)) & ~untimed)


def upcoming_or_undated(date: Column, as_of: Column) -> Column:
    """What a source should give; a comparison alone would leave out rows without a date."""
    return date.isNull() | (date >= as_of)


def validation_stats(events: DataFrame, as_of: Column) -> DataFrame:
    """By country: events, with and without a date, future and past."""
    dated = F.col("event_date").isNotNull()
    future = dated & (F.col("event_date") >= as_of)
    counts = {"dated": dated, "undated": ~dated, "future": future, "past": dated & ~future}
    return events.groupBy(F.coalesce("country", F.lit("BR")).alias("country")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def batch_problems(events: DataFrame, as_of: Column, stale_days: int = 30) -> DataFrame:
    """(source, problem, n) of one run's rows, for the checks that a source must pass before it is taken in.

    Ids given twice count once an id, all else by row. events has `source`.
    """
    today = F.date_format(as_of, "yyyy-MM-dd")
    links = F.exists("listings", lambda x: (F.coalesce(x["page_url"], F.lit("")) != "") | (F.coalesce(F.get(x["signup_urls"], 0), F.lit("")) != ""))
    checks = {
        "title": F.length(F.coalesce("title", F.lit(""))) < 3,
        "run_date_in_id": F.contains(F.coalesce("id", F.lit("")), today) & ~F.coalesce(F.col("event_date") == as_of, F.lit(False)),
        "no_date": F.col("event_date").isNull(),
        "stale_date": F.coalesce(F.col("event_date") < F.date_sub(as_of, stale_days), F.lit(False)),
        "no_distance": F.coalesce(F.size("distances"), F.lit(0)) < 1,
        "empty_distance": F.coalesce(F.exists("distances", lambda d: d["km"].isNull() & d["label"].isNull()), F.lit(False)),
        "no_link": ~F.coalesce(links, F.lit(False)),
        "kind": F.coalesce(F.exists("listings", lambda x: ~F.coalesce(x["kind"].isin(*KINDS), F.lit(False))), F.lit(False)),
    }
    rows = events.select("source", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))).alias("problem"))
    twice = events.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source", F.lit("repeated_id").alias("problem"))
    return rows.union(twice).groupBy("source", "problem").agg(F.count(F.lit(1)).alias("n"))
