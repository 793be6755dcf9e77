"""SQL fragments the checking statements share."""

from __future__ import annotations


def py_round(x: str, digits: int) -> str:
    """Python's rounding of a DOUBLE expression (see functions.numbers.py_round)."""
    x, m = f"({x})::DOUBLE", f"{10**digits}::DOUBLE"
    return (
        f"(SELECT (low + CASE WHEN side > 0 OR (side = 0 AND abs(low % 2) = 1) THEN 1 ELSE 0 END) / {m}"
        f" FROM (SELECT low, (s - low - 0.5::DOUBLE) + ((hi * {m} - s) + (x - hi) * {m}) AS side"
        f" FROM (SELECT x, s, hi, floor(s) AS low FROM (SELECT x, x * {m} AS s,"
        f" x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) AS hi FROM (SELECT {x} AS x) a) b) c) d)"
    )


def tps(tokens: str, latency: str) -> str:
    """Tokens per second to one decimal, 0 without latency."""
    rounded = py_round(f"{tokens} / nullif({latency} / 1000.0::DOUBLE, 0)", 1)
    return f"CASE WHEN {latency} > 0 THEN {rounded} ELSE 0.0::DOUBLE END"


def us(ms: str) -> str:
    return f"CAST(round(({ms}) * 1000) AS BIGINT)"


WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))"


def normalised(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{WS}+', ' ', 'g'))"


def hash32(text: str) -> str:
    return f"CAST(('0x' || substr(sha256({text}), 1, 8)) AS UBIGINT)"


def percentiles(source: str, keys: str, us_expr: str, points: dict[str, int], scale: int = 1000) -> str:
    """SELECT of interpolated percentiles by explicit ranks, divided by ``scale`` (µs to ms)."""
    cols = []
    for name, t in points.items():
        lo = f"max(CASE WHEN i = (n - 1) * {t} // 1000 THEN us END)"
        hi = f"max(CASE WHEN i = ((n - 1) * {t} + 999) // 1000 THEN us END)"
        rem = f"((max(n) - 1) * {t} % 1000)"
        cols.append(f"({lo} * (1000 - {rem}) + {hi} * {rem})::DOUBLE / 1000 / {scale} AS {name}")
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {head}{', '.join(cols)} FROM (SELECT {head}us, row_number() OVER ({part} ORDER BY us) - 1 AS i,"
        f" count(*) OVER ({part}) AS n FROM (SELECT {head}{us_expr} AS us FROM {source}) s0) s1{tail}"
    )
