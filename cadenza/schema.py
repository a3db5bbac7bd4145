"""Record types of the calendar and the thresholds of its rules."""

from __future__ import annotations

from dataclasses import dataclass

LISTING = "struct<name:string,page_url:string,signup_urls:array<string>,kind:string>"
DISTANCE = "struct<km:double,label:string,date:date,start_time:string>"
SIGNUP_WINDOW = "struct<opens:date,closes:date>"

#: One event. km is in kilometres; what is not a length in km (miles, hours, a children's race) is a label.
RACE_EVENT = ", ".join(
    [
        "id string",
        "title string",
        "event_date date",
        "start_time string",
        "location_text string",
        "city string",
        "subdivision string",
        "country string",
        f"distances array<{DISTANCE}>",
        "image_url string",
        "signup_open boolean",
        f"signup_window {SIGNUP_WINDOW}",
        f"listings array<{LISTING}>",
        "miss_count int",
        "first_seen_at timestamp",
        "updated_at timestamp",
        "label_tier string",
        "is_major boolean",
        "is_cancelled boolean",
    ]
)

KINDS = ("signup", "organizer", "calendar")


@dataclass(frozen=True)
class Rules:
    """Limits that the operators share; each can be set by the caller."""

    generic_link_uses: int = 3
    band_days: int = 31
    strict_similarity: float = 0.95
    strict_days: int = 30
    close_similarity: float = 0.85
    close_days: int = 14
    same_day_similarity: float = 0.75
    drop_after_misses: int = 10
    active_days_back: int = 15
    horizon_days: int = 30
    shared_by_events: int = 3
    kept_runs: int = 40
    failures_in_a_row: int = 3
    alive_status: tuple[int, ...] = (200, 403, 406, 429, 503)


RULES = Rules()
