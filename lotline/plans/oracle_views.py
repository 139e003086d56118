"""The derived inputs as DuckDB CTEs (same column expressions as ``derived``)."""

from __future__ import annotations

from . import derived as D


def _sel(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {k}" for k, e in cols.items())


VEHICLE_COLS = ("id, dealer, title, year, make, model, trim, vin, msrp, price, odometer, ext_color, "
                "int_color, options, dealer_platform, source_url, scraped_at")

CTES: dict[str, tuple[list[str], str]] = {
    "obs": ([], f"SELECT {_sel(D.OBS_COLUMNS)} FROM lineitem JOIN part ON l_partkey = p_partkey "
                f"JOIN supplier ON l_suppkey = s_suppkey"),
    "vehicles": (["obs"], f"SELECT {VEHICLE_COLS}, scraped_at AS updated_at, created_at FROM ("
                          f"SELECT *, row_number() OVER (PARTITION BY vin ORDER BY scraped_at DESC, "
                          f"l_orderkey DESC, l_linenumber DESC) AS rn__, "
                          f"min(scraped_at) OVER (PARTITION BY vin) AS created_at FROM obs) WHERE rn__ = 1"),
    "dealers": ([], f"SELECT {_sel(D.DEALER_COLUMNS)} FROM supplier LEFT JOIN nation "
                    f"ON s_nationkey = n_nationkey"),
    "platform_map": ([], f"SELECT {_sel(D.PLATFORM_MAP_COLUMNS)} FROM supplier WHERE {D.PLATFORM_MAP_WHERE}"),
    "runs": ([], f"SELECT {_sel(D.RUN_COLUMNS)} FROM events"),
    "live": ([], f"SELECT DISTINCT {_sel(D.LIVE_COLUMNS)} FROM events WHERE {D.LIVE_WHERE}"),
    "run_events": ([], f"SELECT {_sel(D.RUN_EVENT_COLUMNS)} FROM events"),
}


def register(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it reads (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {body}\n{sql}"
