"""Registration of queries, and the SQL relations that their oracles share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: name -> (relations it reads, text)
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def relation(name: str, text: str, needs: str = "") -> None:
    RELATIONS[name] = (tuple(needs.split()), text)


def sql(needs: str, body: str, recursive: bool = False) -> str:
    """body after the relations that it needs, and those that they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in RELATIONS[n][0]:
            add(x)
        if n not in order:
            order.append(n)

    for n in needs.split():
        add(n)
    own = [f"{n} AS MATERIALIZED ({RELATIONS[n][1]})" for n in order]
    head, sep, rest = body.partition("WITH ")
    if not head.strip() and sep:
        own.append(rest)
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(own)
    return ("WITH " + ",\n".join(own) + "\n" if own else "") + body


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def q6(x: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round({x}, {digits}) + 0.0)"


relation("grid", "SELECT vec_id::INT AS r, unnest(range(len(embedding)))::INT AS c, unnest(embedding)::DOUBLE AS v FROM embeddings")
relation("size", "SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM grid", "grid")
relation("dem", "SELECT r, c, v * 4 * 1000 AS z FROM grid", "grid")
relation("shadow", "SELECT r, c, v * 4 * 1000 AS z, CASE WHEN v < 0.1 THEN 1 ELSE 0 END AS psr FROM grid", "grid")
relation("lines", "SELECT vec_id::INT AS r, t.c::INT AS c, embedding AS e FROM embeddings, range(64) t(c)")


def at(k: int) -> str:
    return f"e[(c + {k}) % 64 + 1]::DOUBLE"


relation("sli", "SELECT r, c, " + ", ".join(f"{at(k)} AS {p}_{x}" for p, ks in {"hh": (0, 16), "hv": (32, 48), "vh": (8, 24), "vv": (40, 56)}.items() for x, k in zip(("re", "im"), ks)) + " FROM lines", "lines")
relation(
    "bands",
    f"""SELECT r, c, CASE WHEN {at(5)} <= 0.2 THEN 0.4 + 2 * {at(0)} END AS cpr, CASE WHEN {at(9)} <= 0.15 THEN abs({at(8)}) * 2 END AS dop,
    CASE WHEN {at(17)} <= 0.25 THEN 110 + 300 * {at(16)} END AS tmean, 1 + 5 * abs({at(24)}) AS zit,
    CASE WHEN {at(33)} <= 0.1 THEN 10 * {at(32)} * {at(32)} END AS pump, 40 * abs({at(40)}) AS slope,
    CASE WHEN {at(48)} < -0.05 THEN 1.0::DOUBLE ELSE 0.0 END AS psr, CASE WHEN {at(48)} < -0.15 THEN 1.0::DOUBLE ELSE 0.0 END AS dpsr,
    CASE WHEN {at(57)} <= 0.2 THEN 0.5 + 1.6 * {at(0)} + 0.6 * {at(56)} END AS official FROM lines""",
    "lines",
)
relation(
    "numbers",
    """SELECT l_orderkey AS r, l_linenumber AS c, l_partkey AS lid, floor(l_quantity * 10 - 100 + 0.5) AS hh, floor(l_discount * 1000 + 0.5) AS hv,
    floor(l_tax * 1000 + 0.5) AS vh, floor(l_extendedprice / 100 + 0.5) AS vv FROM lineitem""",
)
relation("ties", "SELECT event_id AS n, event_id % 9 * 200 + 0.1::DOUBLE * value AS slant, -90 + value / 50 AS lat, user_id * 2.4::DOUBLE - 180 AS lon FROM events")
relation("pair", "SELECT r, c, cpr AS a, official AS b FROM bands WHERE cpr > 0 AND cpr <= 20 AND official > 0 AND official <= 20", "bands")
