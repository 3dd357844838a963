"""A small warehouse's grants, role members and query log, and statements, as plain rows for queries and tests."""

from __future__ import annotations

import datetime as dt
import hashlib
import random


def stream(seed: int, name: str) -> random.Random:
    """A generator of its own for each name, so that drawing more of one thing changes nothing else."""
    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big"))


FIRST, LAST = dt.date(2026, 6, 1), dt.date(2026, 9, 21)
GRANTS = [
    ("analyst", "customer", "select"), ("analyst", "mart.daily", "select"), ("billing", "orders", "select"), ("billing", "customer", "all"),
    ("loader", "orders", "insert"), ("research", "mart.daily", "select"), ("research", "mart.segments", "select"), ("audit", "customer", "select"),
]
MEMBERS = [("ana", "analyst"), ("bo", "analyst"), ("bo", "billing"), ("cy", "billing"), ("dee", "loader"), ("eve", "research"), ("flo", "research"), ("gus", "audit")]
QUERIED = [
    "customer.c_custkey", "customer.c_mktsegment", "customer.c_nationkey", "orders.o_orderdate", "orders.o_totalprice",
    "mart.daily.day", "mart.daily.segment", "mart.daily.nation", "mart.segments.segment", "mart.segments.total",
]
ADDRESSES = ["customer.c_mktsegment", "customer.c_nationkey", "orders.o_orderdate", "orders.o_totalprice", "customer.c_name"]

STATEMENTS = [
    "INSERT INTO mart.segments SELECT d.segment AS segment, CAST(d.day AS DATE) AS day, sum(d.orders) AS total, d.mean_price * 2 AS twice FROM mart.daily d GROUP BY d.segment, CAST(d.day AS DATE), d.mean_price * 2",
    "INSERT INTO mart.broken SELECT o.*, c.c_name::string AS n, (SELECT max(x) FROM t) AS m, z.q AS q FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "INSERT INTO mart.windowed SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders",
]


STAR_RATE = 0.22


def query_log(seed: int = 20260917, queries: int = 400, start: dt.date = FIRST, end: dt.date = LAST) -> list[tuple]:
    """(query_id, user, at, tables, columns, select_star): some are stars, which name no column."""
    if start > end or queries < 1:
        raise ValueError(f"no log of {queries} queries from {start} to {end}")
    draw, users = stream(seed, "queries"), sorted({u for u, _ in MEMBERS})
    out = []
    for i in range(queries):
        at = start + dt.timedelta(days=draw.randrange((end - start).days + 1))
        user, star = draw.choice(users), draw.random() < STAR_RATE
        columns = [] if star else sorted(draw.sample(QUERIED, draw.randint(1, 2)))
        tables = [draw.choice(["customer", "orders", "mart.daily", "mart.segments"])] if star else sorted({c.rsplit(".", 1)[0] for c in columns})
        out.append((f"q{i:04d}", user, at, tables, columns, star))
    return out
