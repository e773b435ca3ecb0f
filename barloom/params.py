"""Parameters of the features; their defaults are part of the semantics."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Momentum:
    rsi: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    stoch_k: int = 14
    stoch_d: int = 3
    williams: int = 14
    cci: int = 14
    roc: int = 10
    tsi_fast: int = 13
    tsi_slow: int = 25
    ao_fast: int = 5
    ao_slow: int = 34
    ppo_fast: int = 12
    ppo_slow: int = 26


@dataclass(frozen=True)
class Volatility:
    atr: int = 14
    bollinger: int = 20
    bollinger_width: float = 2.0
    keltner_width: float = 2.0
    donchian: int = 20
    historical: int = 30
    chaikin: int = 10
    sar_start: float = 0.02
    sar_step: float = 0.02
    sar_max: float = 0.2


@dataclass(frozen=True)
class Volume:
    mfi: int = 14
    vwma: int = 20
    cmf: int = 20
    klinger_fast: int = 34
    klinger_slow: int = 55
    oscillator_fast: int = 14
    oscillator_slow: int = 28
    vzo: int = 14


@dataclass(frozen=True)
class Statistical:
    window: int = 20
    hurst: int = 100
    hurst_max_lag: int = 20
    entropy: int = 20
    entropy_bins: int = 10


@dataclass(frozen=True)
class Pattern:
    doji: float = 0.1
    hammer_body: float = 0.3
    hammer_shadow: float = 2.0
    levels: int = 20


@dataclass(frozen=True)
class Labels:
    horizons: tuple = (("1h", 1), ("4h", 4), ("12h", 12), ("1d", 24), ("3d", 72), ("1w", 168), ("2w", 336))
    max_return: int = 24
    drawdown: int = 12


@dataclass(frozen=True)
class CrossPair:
    correlation: int = 24
    btc: str = "BTC-USDT"
    eth: str = "ETH-USDT"


@dataclass(frozen=True)
class Params:
    """All groups, and which of them run. ``rolling`` rows a pair are written by a rolling update."""

    momentum: Momentum = field(default_factory=Momentum)
    volatility: Volatility = field(default_factory=Volatility)
    volume: Volume = field(default_factory=Volume)
    statistical: Statistical = field(default_factory=Statistical)
    pattern: Pattern = field(default_factory=Pattern)
    labels: Labels = field(default_factory=Labels)
    cross_pair: CrossPair = field(default_factory=CrossPair)
    rolling: int = 450
    look_back: int = 600
    disabled: frozenset = frozenset()

    @classmethod
    def from_ini(cls, text: str) -> Params:
        """Overrides from ini text: a section for each group, ``[GENERAL]`` rolling, ``[FEATURES]`` group = bool."""
        ini = configparser.ConfigParser()
        ini.read_string(text)
        out = cls()
        for f in fields(cls):
            if ini.has_section(f.name.upper()):
                group = getattr(out, f.name)
                typed = {k: type(getattr(group, k))(v) for k, v in ini[f.name.upper()].items() if not isinstance(getattr(group, k), tuple)}
                out = replace(out, **{f.name: replace(group, **typed)})
        if ini.has_section("GENERAL"):
            out = replace(out, rolling=ini.getint("GENERAL", "rolling", fallback=out.rolling))
        if ini.has_section("FEATURES"):
            off = {k for k in ini["FEATURES"] if not ini.getboolean("FEATURES", k)}
            out = replace(out, disabled=frozenset(off))
        return out
