"""Question answering row by row in plain Python, to compare small results with."""

from __future__ import annotations

import calendar
import datetime
import re
from decimal import Decimal

STOP = set(
    "a an and at check compare comparison did for from how i in is last list me month much "
    "my on show spend spending the this to top transactions transaction week what year "
    "yesterday today up".split()
)


def months_back(day: datetime.date, months: int) -> datetime.date:
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return datetime.date(year, month + 1, min(day.day, last))


def first_day(query: str, newest: datetime.date) -> datetime.date | None:
    text = query.lower()
    rules = [
        ("last month", months_back(newest, 1)),
        ("this month", newest.replace(day=1)),
        ("last week", newest - datetime.timedelta(7)),
        ("this week", newest - datetime.timedelta(newest.weekday())),
        ("last year", months_back(newest, 12)),
        ("this year", newest.replace(month=1, day=1)),
        ("today", newest),
        ("yesterday", newest - datetime.timedelta(1)),
    ]
    return next((day for phrase, day in rules if phrase in text), None)


def words(query: str) -> list[str]:
    return [w for w in re.findall("[a-z]+", query.lower()) if w not in STOP and len(w) > 2]


def matching(query: str, rows: list[dict], known: set[str]) -> tuple[list[dict], bool]:
    """Matching rows and whether they are the fallback."""
    dates = [row["date"] for row in rows if row["date"]]
    if not dates:
        return [], False
    start = first_day(query, max(dates))
    inside = [r for r in rows if start is None or (r["date"] and r["date"] >= start)]
    return among(query, inside, known)


def between(query: str, rows: list[dict], known: set[str], first, last) -> tuple[list[dict], bool]:
    """As matching, for rows from ``first`` to ``last``; None is an open bound."""
    inside = [
        r
        for r in rows
        if (first is None and last is None)
        or (r["date"] and (first is None or r["date"] >= first) and (last is None or r["date"] <= last))
    ]
    return among(query, inside, known)


def among(query: str, inside: list[dict], known: set[str]) -> tuple[list[dict], bool]:
    found = words(query)
    if not found:
        return inside, False
    merchant_words = [w for w in found if w in known] or found

    def hit(row: dict) -> bool:
        category, merchant = (row["category"] or "").lower(), (row["merchant"] or "").lower()
        return any(w in category for w in found) or any(w in merchant for w in merchant_words)

    hits = [row for row in inside if hit(row)]
    return (hits, False) if hits else (inside, True)


def summary(rows: list[dict]) -> dict:
    income = [r for r in rows if (r["category"] or "").lower() == "income"]
    spent = [r for r in rows if (r["category"] or "").lower() != "income"]

    def total(some: list[dict]) -> Decimal:
        return sum((r["amount"] for r in some if r["amount"] is not None), Decimal("0.00"))

    def ranked(key: str) -> list[tuple[str, Decimal]]:
        names = {r[key] or "" for r in spent}
        sums = [(n, total([r for r in spent if (r[key] or "") == n])) for n in names]
        return sorted(sums, key=lambda pair: (-pair[1], pair[0]))

    return {
        "total_spend": total(spent),
        "total_income": total(income),
        "net": total(income) - total(spent),
        "transaction_count": len(spent),
        "categories": ranked("category"),
        "merchants": ranked("merchant")[:5],
    }
