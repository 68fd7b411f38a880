"""Views that turn the driver's tables into particles, halos, spectra and logs: one text for both SQL engines.

Coordinates are multiples of 1/256, so that all cloud-in-cell weights and their sums are exact in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Cells along an axis of the mesh, and the box's side, in the queries.
N = 32

VIEWS = {
    # x, y, z in [1, N + 1): a mesh's first cell starts at 1
    "particles": """
SELECT ix*67108864 + iy*8192 + iz AS id,
       CAST(ix AS DOUBLE)/256.0e0 + 1e0 AS x, CAST(iy AS DOUBLE)/256.0e0 + 1e0 AS y, CAST(iz AS DOUBLE)/256.0e0 + 1e0 AS z,
       CAST(kx-512 AS DOUBLE)/64.0e0 AS vx, CAST(ky-512 AS DOUBLE)/64.0e0 AS vy, CAST(kz-512 AS DOUBLE)/64.0e0 AS vz, mass
FROM (SELECT (l_orderkey*7919 + l_linenumber*104729) % 8192 AS ix,
             (l_partkey*15485863 + l_linenumber*31)  % 8192 AS iy,
             (l_suppkey*32452843 + l_orderkey*17)    % 8192 AS iz,
             (l_partkey*31 + l_linenumber*7)         % 1024 AS kx,
             (l_suppkey*37 + l_linenumber*11)        % 1024 AS ky,
             (l_orderkey*41 + l_linenumber*13)       % 1024 AS kz,
             l_quantity AS mass FROM lineitem) q""",
    # positions in [0, N); ids are unique
    "halos": """
SELECT o_orderkey AS id,
       CAST((o_orderkey*7919)            % 8192 AS DOUBLE)/256.0e0 AS x,
       CAST((o_custkey*104729+o_orderkey)% 8192 AS DOUBLE)/256.0e0 AS y,
       CAST((o_orderkey*15485863)        % 8192 AS DOUBLE)/256.0e0 AS z,
       CAST((o_orderkey*31+o_custkey*7)%1024-512 AS DOUBLE)/64.0e0 AS vx,
       CAST((o_orderkey*37+o_custkey*11)%1024-512 AS DOUBLE)/64.0e0 AS vy,
       CAST((o_orderkey*41+o_custkey*13)%1024-512 AS DOUBLE)/64.0e0 AS vz,
       CAST(1+(o_orderkey*2654435)%97    AS DOUBLE)/64.0e0  AS r,
       CAST(1+(o_orderkey*48271)%100003  AS DOUBLE)         AS m,
       CAST(50+(o_orderkey*69621)%1950   AS DOUBLE)         AS vcirc,
       CAST(128+(o_orderkey*40692)%3072  AS DOUBLE)/128.0e0 AS conc,
       CAST((o_orderkey*39373)%256       AS DOUBLE)/1024.0e0 AS xoff,
       CAST((o_orderkey*16807)%256       AS DOUBLE)/1024.0e0 AS spin,
       CAST((o_orderkey*45991)%512       AS DOUBLE)/256.0e0 AS virrat,
       (o_orderkey*5) % 4 = 0 AS is_sub
FROM orders""",
    "pk_realizations": """
SELECT l_suppkey % 16 AS realization, l_partkey % 64 AS bin, SUM(l_quantity) AS pk, COUNT(*) AS n
FROM lineitem GROUP BY l_suppkey % 16, l_partkey % 64""",
    "log": "SELECT event_id AS line, event_id % 7 AS iter, value AS residual FROM events",
}
TABLES = {"particles": "lineitem", "halos": "orders", "pk_realizations": "lineitem", "log": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = TABLES[name]
    return spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


#: Common table expressions of the SQL side, by name, with those that each builds on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {name: ((), text) for name, text in VIEWS.items()}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def sql(text: str, *needs: str) -> str:
    """text after a WITH of the expressions that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return text
    return "WITH " + ",\n".join(f"{x} AS ({CTES[x][1]})" for x in order) + "\n" + text


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, text: str | None = None, *needs: str):
    """Registers a query, and its SQL with what that builds on."""

    def register(f):
        QUERIES[name] = f
        if text is not None:
            ORACLES[name] = sql(text, *needs)
        return f

    return register
