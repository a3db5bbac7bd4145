"""Queries without SQL against plain Python over the same rows."""

import difflib
import hashlib
import html
import re

import pandas as pd

from cadenza.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLE_SQL) == {"title_similarity", "page_text", "distance_extract"}


def test_title_similarity(spark):
    part = pd.read_parquet(f"{SF}/part.parquet").set_index("p_partkey")["p_name"].str.lower()

    def similar(a, b):
        several = len(a.split(" ")) > 1 and len(b.split(" ")) > 1
        return round(difflib.SequenceMatcher(None, a, b).ratio(), 9) if several else 0.0

    want = {k: similar(name, part[k + 1]) for k, name in part.items() if k + 1 in part.index}
    got = {r.p_partkey: r.sim for r in QUERIES["title_similarity"](spark, SF).collect()}
    assert got == want and 0 < sum(v > 0.3 for v in want.values())


def test_page_text(spark):
    """What stands outside tags, comments, scripts and styles, entities resolved, blanks squeezed."""
    pages = pd.read_parquet(f"{SF}/pages.parquet")

    def shown(page):
        page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "\0", page)
        page = re.sub(r"(?s)<!--.*?-->|<[!?][^>]*>|</?[A-Za-z][^>]*>", "\0", page)
        return " ".join(" ".join(html.unescape(x) for x in page.split("\0")).split())

    want = {i: shown(p) for i, p in zip(pages.page_id, pages.html, strict=True) if p is not None}
    got = {r.page_id: (r.n, r.h) for r in QUERIES["page_text"](spark, SF).collect()}
    same = [i for i, t in want.items() if got[i] == (len(t), hashlib.md5(t.encode()).hexdigest())]
    assert len(same) == len(want)


def test_distance_extract(spark):
    """Numbers of the enumeration before the price: 3 to 200 km, marathons and halves exact, those within half a km of an earlier one once, ascending."""
    snapped = lambda x: 42.195 if 41.5 <= x <= 43 else 21.097 if 20.5 <= x <= 21.5 else x
    part = pd.read_parquet(f"{SF}/part.parquet")
    want = {}
    for k, size in zip(part.p_partkey, part.p_size, strict=True):
        kept = []
        for x in map(snapped, (float(size), 10.0, float(size % 7 + 12))):
            if 3 <= x <= 200 and all(abs(x - y) >= 0.5 for y in kept):
                kept.append(x)
        want[k] = " ".join(str(x) for x in sorted(kept))
    assert {r.p_partkey: r.km for r in QUERIES["distance_extract"](spark, SF).collect()} == want
