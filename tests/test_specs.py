"""Every shipped specification on a small landed payload."""

import json

import pytest


def ld(**node):
    return '<html><script type="application/ld+json">' + json.dumps(node) + "</script></html>"


def place(city, region, country=None):
    return {"address": {"addressLocality": city, "addressRegion": region, **({"addressCountry": country} if country else {})}}


PAYLOADS = {
    "finishers": json.dumps({"results": [{"hits": [
        {"document": {"eventId": "f1", "eventName": "city run", "raceDistance": d, "raceDistanceUnit": u, "editionStartDate": "2026-05-03", "city": "Lyon", "countryCode": "FR", "level1": "ARA", "slug": "city-run", "raceDate": 1}} for d, u in ((10000, "meters"), (42195, "meters"), (5, "miles"))
    ]}]}),
    "runsignup": json.dumps({"races": [{"race": {"race_id": 7, "name": "hill run", "next_date": "05/03/2026", "address": {"city": "Boston", "state": "MA", "country_code": "US"}, "url": "https://runsignup.com/r", "events": [{"start_time": "7:30", "distance": "10K"}, {"distance": "5K"}]}}]}),
    "raceroster": json.dumps({"data": [{"eventId": 9, "name": "lake run", "date": "2026-05-03", "location": {"city": "Toronto", "province": {"abbreviation": "ON"}, "countryISO": "CA"}, "url": "https://raceroster.com/e", "distances": ["10 km", "5 km"]}]}),
    "tf_sports": json.dumps({"data": [{"id": 3, "attributes": {"title": "corrida 10 km", "date": "2026-05-03", "city": "Recife", "state": "PE", "slug": "corrida-x"}}]}),
    "ticket_sports": json.dumps({"events": [{"id": 4, "title": "corrida 10 km", "date": "03/05/2026", "address": "Parque", "city": "Recife", "state": "PE", "uri": "/e/4"}]}),
    "brazil_table": '<table><tr height="35"><td>03/05/26</td><td> Recife</td><td><a href="https://c/x?c=58913&prova=b">corrida b</a></td><td>15/10km</td></tr></table>',
    "worldsmarathons": ld(**{"@type": "SportsEvent", "name": "city marathon", "startDate": "2026-05-03", "location": place("Rome", "RM", "IT"), "url": "https://w/m"}),
    "usroadrunning": ld(**{"@graph": [{"@type": "Event", "name": "road run 10K", "startDate": "2026-05-03T07:00:00", "location": place("Austin", "TX"), "url": "https://u/r"}]}),
    "atletis": ld(**{"@type": "SportsEvent", "name": "corrida 10 km", "startDate": "2026-05-03T07:00:00-03:00", "location": place("Recife", "PE"), "url": "https://a/4966"}),
    "brazil_portal": ld(**{"@type": "Event", "name": "corrida 10 km", "startDate": "2026-05-03T07:00:00", "location": place("Recife", "PE"), "url": "https://p/x"}),
}
WANT = {
    "finishers": ("finishers_f1", "City Run", "Lyon", "ARA", "FR", [10.0, 42.195], "https://www.finishers.com/en/event/city-run"),
    "runsignup": ("runsignup_7", "Hill Run", "Boston", "MA", "US", [5.0, 10.0], "https://runsignup.com/r"),
    "raceroster": ("raceroster_9", "Lake Run", "Toronto", "ON", "CA", [5.0, 10.0], "https://raceroster.com/e"),
    "tf_sports": ("tf_sports_3", "Corrida 10 Km", "Recife", "PE", "BR", [10.0], "https://www.tfsports.com.br/evento/corrida-x"),
    "ticket_sports": ("ticket_sports_4", "Corrida 10 Km", "Recife", "PE", "BR", [10.0], "https://www.ticketsports.com.br/e/4"),
    "brazil_table": ("brazil_table_58913", "Corrida B", "Recife", None, "BR", [10.0, 15.0], "https://c/x?c=58913&prova=b"),
    "worldsmarathons": (None, "City Marathon", "Rome", "RM", "IT", [], "https://w/m"),
    "usroadrunning": (None, "Road Run 10K", "Austin", "TX", "US", [10.0], "https://u/r"),
    "atletis": (None, "Corrida 10 Km", "Recife", "PE", "BR", [10.0], "https://a/4966"),
    "brazil_portal": (None, "Corrida 10 Km", "Recife", "PE", "BR", [10.0], "https://p/x"),
}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    for name, text in PAYLOADS.items():
        (root / name).mkdir()
        (root / name / "page1.html").write_text(text)
    return root


def test_all_specifications(spark, landed):
    from cadenza.sources.specs import FORMS, events_of

    assert set(FORMS) == set(PAYLOADS)
    rows, failed = events_of(spark, f"file://{landed}")
    got = {r.source: r for r in rows.collect()}
    assert not failed and set(got) == set(WANT) and sorted(r.ordinal for r in got.values()) == list(range(1, 11))
    for name, (id_, title, city, sub, country, kms, page) in WANT.items():
        r = got[name]
        assert (r.title, r.city, r.subdivision, r.country, [d.km for d in r.distances], r.listings[0].page_url) == (title, city, sub, country, kms, page), name
        assert str(r.event_date) == "2026-05-03" and (id_ is None or r.id == id_), (name, r.id, r.event_date)


def test_ordinals_do_not_depend_on_partitions(spark, tmp_path):
    from cadenza.sources.parsers import Spec, parse_html_cards
    from cadenza.sources.readers import read_pages
    from cadenza.sources.registry import Registry

    for i in range(6):
        (tmp_path / f"p{i}.html").write_text("".join(f'<li><a href="https://x/{i}/{j}">t{i}-{j}</a>' for j in range(7)))
    spec = Spec("x", {"id": r"x/(\d+/\d+)", "title": r">([^<]+)<", "page": r'href="([^"]+)'}, rows="<li>")
    got = []
    for n in (1, 5):
        r = Registry()
        r.register_source("x", f"file://{tmp_path}", lambda s, p, n=n: read_pages(s, p).repartition(n), lambda d: parse_html_cards(d, spec))
        got.append({x.id: x.ordinal for x in r.read(spark)[0].collect()})
    assert got[0] == got[1] and sorted(got[0].values()) == list(range(1, 43))
    ordered = sorted(got[0], key=got[0].get)
    assert ordered == sorted(ordered, key=lambda x: tuple(map(int, x.removeprefix("x_").split("/"))))


def test_no_cap_on_cards(spark):
    from cadenza.sources.parsers import Spec, parse_html_cards

    page = spark.createDataFrame([("<li>x" * 100_001,)], "html string")
    assert parse_html_cards(page, Spec("x", {}, rows="<li>")).count() == 100_001
