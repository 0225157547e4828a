"""Names of venues, underlyings and instruments, as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of underlyings, of venues, and the instruments that venues list.
ALIASES = {
    "BTC": "BTC", "XBT": "BTC", "BTC/USD": "BTC", "BTC-USD": "BTC", "BTC/USDC": "BTC", "PF_XBTUSD": "BTC", "BTC-PERPETUAL": "BTC",
    "ETH": "ETH", "ETH/USD": "ETH", "ETH-USD": "ETH", "ETH/USDC": "ETH", "PF_ETHUSD": "ETH", "ETH-PERPETUAL": "ETH",
    "SOL": "SOL", "SOL/USD": "SOL", "SOL-USD": "SOL", "SOL/USDC": "SOL", "PF_SOLUSD": "SOL", "SOL_USDC-PERPETUAL": "SOL",
}
VENUES = {"hl": "hyperliquid", "hyperliquid": "hyperliquid", "db": "deribit", "deribit": "deribit", "kr": "kraken", "kraken": "kraken"}
LISTED = {
    "BTC": {"hyperliquid": "BTC", "deribit": "BTC-PERPETUAL", "kraken": "PF_XBTUSD", "lighter": "BTC", "extended": "BTC-USD", "risex": "BTC/USDC"},
    "ETH": {"hyperliquid": "ETH", "deribit": "ETH-PERPETUAL", "kraken": "PF_ETHUSD", "lighter": "ETH", "extended": "ETH-USD", "risex": "ETH/USDC"},
    "SOL": {"hyperliquid": "SOL", "deribit": "SOL_USDC-PERPETUAL", "kraken": "PF_SOLUSD", "lighter": "SOL", "extended": "SOL-USD", "risex": "SOL/USDC"},
}
SUFFIXES = ["/USD", "-USD", "/USDC", "-USDC", "-PERPETUAL"]


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def underlying(symbol: Column) -> Column:
    """The underlying of a venue's name or an alias: upper case without blanks, looked up whole, then
    without a known suffix; else as it is."""
    s = F.replace(F.upper(F.trim(symbol)), F.lit(" "), F.lit(""))
    out = [_look_up(ALIASES, s)]
    for suffix in SUFFIXES:
        base = F.when(s.endswith(suffix), F.substring(s, F.lit(1), F.length(s) - len(suffix)))
        out.append(F.coalesce(_look_up(ALIASES, base), F.when(base.isin(*LISTED), base)))
    return F.coalesce(*out, s)


def venue(name: Column) -> Column:
    v = F.lower(F.trim(name))
    return F.coalesce(_look_up(VENUES, v), v)


def instrument(symbol: Column, at: Column) -> Column:
    """What the venue calls the underlying; the symbol as given where it is not listed."""
    listed = {f"{u}@{v}": name for u, names in LISTED.items() for v, name in names.items()}
    return F.coalesce(_look_up(listed, F.concat(underlying(symbol), F.lit("@"), venue(at))), F.trim(symbol))


def base_symbol(symbol: Column) -> Column:
    """The part before a slash, without a quote currency or a perpetual's mark at its end."""
    s = F.substring_index(F.upper(F.trim(F.coalesce(symbol, F.lit("")))), "/", 1)
    for suffix in ("USDT", "USDC", "-PERPETUAL"):
        s = F.when(s.endswith(suffix), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)
    return s
