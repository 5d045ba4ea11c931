"""The audit of all declared constraints, over tables in which rows break each of them; the SQL twin has a statement for every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame

from staffloom.fixtures import Tables
from staffloom.operators import quality as q
from staffloom.plans.catalog import ORACLES, query

#: Every rule is broken by the rows whose number has its place as remainder of this.
EVERY = 101
TIMES = {"created_at": "d", "updated_at": "d", "expires_at": "d + INTERVAL 3 DAY", "interview_starts_at": "d + INTERVAL 9 HOUR", "interview_ends_at": "d + INTERVAL 10 HOUR", "booking_deadline_at": "CASE WHEN k % 5 = 0 THEN NULL ELSE d END", "cancelled_at": "CASE WHEN k % 3 = 0 THEN d + INTERVAL 1 DAY END"}
WRONG = {"time_order": ("interview_ends_at", "d + INTERVAL 9 HOUR"), "deadline_before_start": ("booking_deadline_at", "d + INTERVAL 12 HOUR"), "cancel_after_create": ("cancelled_at", "d - INTERVAL 1 DAY")}


def columns_of(table: str) -> list[str]:
    """All columns that a rule of the table speaks of."""
    named = [*q.REQUIRED[table], *q.LENGTHS.get(table, {}), *q.REFERENCES.get(table, {}), *(c for keys, _ in q.UNIQUE.get(table, {}).values() for c in keys)]
    return list(dict.fromkeys([q.KEYS[table], *named, *(c for n, c in {"interview_slots": [(0, "booking_deadline_at")], "interview_bookings": [(0, "cancelled_at")]}.get(table, []))]))


def good(table: str, column: str) -> str:
    """A value that breaks no rule, as SQL of either engine over the row's number k and day d."""
    if column in q.ALLOWED.get(table, {}):
        values = q.ALLOWED[table][column]
        return "CASE " + " ".join(f"WHEN k % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    if column == q.KEYS[table] or column in q.REFERENCES.get(table, {}):
        return "k + 1"
    return TIMES.get(column) or ("CAST(1 + k % 4 AS INT)" if column == "capacity" else f"'{column[:3]}' || CAST(k AS VARCHAR(20))")


def bad(table: str, rule: str) -> dict[str, str]:
    """The columns by which rows break a rule, and how."""
    kind, _, column = rule.partition(":")
    if kind in ("required", "length", "allowed", "exists"):
        return {column: {"required": "NULL", "length": f"repeat('x', {q.LENGTHS.get(table, {}).get(column, 0) + 1})", "allowed": "'none'", "exists": "-1"}[kind]}
    if rule in WRONG:
        return dict([WRONG[rule]])
    return dict.fromkeys(q.unique_rules(table)[rule][0], "'same'" if rule in ("unique_token", "unique_email") else "k" if kind == "unique" else "7")


def table_sql(table: str) -> str:
    """The table as SQL that both engines read."""
    cases: dict[str, list[str]] = {c: [] for c in columns_of(table)}
    for place, rule in enumerate(q.rules(table)):
        for column, value in bad(table, rule).items():
            cases[column].append(f"WHEN k % {EVERY} = {place} THEN {value}")
    exprs = [f"CASE {' '.join(whens)} ELSE {good(table, c)} END AS {c}" if whens else f"{good(table, c)} AS {c}" for c, whens in cases.items()]
    return f"SELECT {', '.join(exprs)} FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders) AS o"


def twin() -> str:
    found = []
    for t, key in q.KEYS.items():
        say = lambda rule, rest, k=key, t=t: f"SELECT '{t}' AS table_name, '{rule}' AS rule, CAST({k} AS VARCHAR) AS key FROM {rest}"
        found += [say(f"required:{c}", f"{t} WHERE {c} IS NULL") for c in [key, *q.REQUIRED[t]]]
        found += [say(f"length:{c}", f"{t} WHERE length({c}) > {n}") for c, n in q.LENGTHS.get(t, {}).items()]
        found += [say(f"allowed:{c}", f"{t} WHERE {c} NOT IN ({', '.join(repr(v) for v in values)})") for c, values in q.ALLOWED.get(t, {}).items()]
        found += [say(name, f"{t} WHERE NOT ({condition})") for name, condition in q.CHECKS.get(t, {}).items()]
        found.append(say(f"unique:{key}", f"{t} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"))
        for name, (keys, among) in q.UNIQUE.get(t, {}).items():
            given = " AND ".join([*(f"{k} IS NOT NULL" for k in keys), *([among] if among else [])])
            found.append(f"SELECT '{t}', '{name}', concat_ws(':', {', '.join(keys)}) FROM {t} WHERE {given} GROUP BY {', '.join(keys)} HAVING count(*) > 1")
        found += [say(f"exists:{c}", f"{t} WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} AS p WHERE p.{q.KEYS[p]} = {t}.{c})") for c, p in q.REFERENCES.get(t, {}).items()]
    return "WITH " + ", ".join(f"{t} AS ({table_sql(t)})" for t in q.KEYS) + " " + " UNION ALL ".join(found)


def audited(t: Tables) -> dict[str, DataFrame]:
    orders = t.raw("orders")
    return {name: t.spark.sql(table_sql(name).replace("FROM orders)", "FROM {orders})"), orders=orders) for name in q.KEYS}


ORACLES["h8_audit_constraints"] = twin()  # its tables are not the views of that name


@query("h8_audit_constraints")
def _(t: Tables) -> DataFrame:
    return q.audit_constraints(audited(t))
