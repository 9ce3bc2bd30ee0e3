"""Measure sheets: what each discipline counts, said once.

A *measure* is a function from an optional ball predicate to an aggregate
column, so the same line serves a whole innings (``m()``) and any part of
it (``m(phase == "death")``). A *rate* divides one aggregate by another. A
:class:`Sheet` lists the measures and rates of one discipline; the innings
facts, phase splits, situational profiles and form summaries are generated
from it, so a new measure is one line here.

All ball measures are sums or counts: fixed-width buffers, partial
aggregation before the shuffle, hash aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.exprs import (
    conceded_runs, credited_wickets, is_four, is_six, legal_ball, opposing_team, safe_rate,
)
from formbook.schema import BOWLER_EXCLUDED_KINDS

Measure = Callable[..., Column]


def count(event: Callable[[], Column]) -> Measure:
    """Balls on which ``event`` holds."""
    return lambda where=None: F.count_if(event() if where is None else where & event())


def total(value: Callable[[], Column]) -> Measure:
    """Sum of ``value``; balls outside ``where`` add 0."""
    return lambda where=None: F.sum(
        value() if where is None else F.when(where, value()).otherwise(F.lit(0))).cast("bigint")


@dataclass(frozen=True)
class Rate:
    """``round(top * scale / bottom, 2)``, NULL where ``bottom`` is not
    positive. ``top`` is a SQL expression over aggregated columns."""

    name: str
    top: str
    bottom: str
    scale: float = 1.0

    def column(self) -> Column:
        return safe_rate(F.expr(self.top), self.bottom, self.scale)


def with_rates(df: DataFrame, rates: Iterable[Rate]) -> DataFrame:
    return df.withColumns({r.name: r.column() for r in rates})


@dataclass(frozen=True)
class Sheet:
    """One discipline. ``balls`` is the measure that floors and rates refer
    to; ``in_phase`` maps a measure to its name in the powerplay (``pp_``)
    and death (``death_``) columns of the innings facts."""

    player: str                              # name column of a ball row
    side: str                                # column naming the player's team
    side_of: Callable[[], Column]
    runs: str
    balls: str
    innings: Mapping[str, Measure]
    in_phase: Mapping[str, str]
    innings_rates: Sequence[Rate]
    summary_sums: Sequence[str]              # innings columns a summary adds up
    summary_extra: Mapping[str, Callable[[], Column]]
    summary_rates: Sequence[Rate]
    regressed: str                           # name of the credibility-weighted rate
    per: float                               # scale of that rate: per 100 balls, per over
    splits: Mapping[str, Measure]            # (player, phase) measures
    split_rates: Sequence[Rate]
    wide: Mapping[str, str]                  # suffix in the wide phase table -> split column
    situations: Mapping[str, Sequence[str]]  # situation -> innings columns it adds up
    situation_rate: Rate                     # per situation; names are prefixed
    situation_extra: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    situation_end_rates: Sequence[Rate] = ()

    @property
    def key(self) -> str:
        return f"{self.player}_key"

    @property
    def id(self) -> str:
        return f"{self.player}_id"

    def phase_columns(self) -> dict[str, Column]:
        """Powerplay and death columns of the innings facts."""
        return {f"{prefix}_{stem}": self.innings[name](F.col("phase") == phase)
                for prefix, phase in PHASE_PREFIXES.items() for name, stem in self.in_phase.items()}


# Column prefixes of the phase parts of the innings facts.
PHASE_PREFIXES = {"pp": "powerplay", "death": "death"}

# Innings in which a situation holds.
SITUATIONS: dict[str, Callable[[], Column]] = {
    "chase": lambda: F.col("is_chase"),
    "defend": lambda: ~F.col("is_chase"),
    "close_match": lambda: F.col("is_close_match"),
    "knockout": lambda: F.col("is_knockout"),
}


def _phase_rates(name: str, top: str, bottom: str, scale: float) -> tuple[Rate, ...]:
    return tuple(Rate(f"{p}_{name}", f"{p}_{top}", f"{p}_{bottom}", scale) for p in PHASE_PREFIXES)


def _batter_runs() -> Column:
    return F.col("runs_batter")


_STRIKE_RATES = (
    Rate("strike_rate", "runs", "balls_faced", 100.0),
    Rate("boundary_pct", "fours + sixes", "balls_faced", 100.0),
    *_phase_rates("strike_rate", "runs", "balls", 100.0),
)

BATTING = Sheet(
    player="batter",
    side="batting_team",
    side_of=lambda: F.col("batting_team"),
    runs="runs",
    balls="balls_faced",
    innings={
        "runs": total(_batter_runs),
        "balls_faced": count(legal_ball),
        "dot_balls": count(lambda: legal_ball() & (_batter_runs() == 0)),
        "fours": count(is_four),
        "sixes": count(is_six),
    },
    in_phase={"runs": "runs", "balls_faced": "balls"},
    innings_rates=(*_STRIKE_RATES, Rate("dot_pct", "dot_balls", "balls_faced", 100.0)),
    summary_sums=("runs", "balls_faced", "fours", "sixes",
                  *(f"{p}_{m}" for p in PHASE_PREFIXES for m in ("runs", "balls"))),
    summary_extra={
        "dismissals": lambda: F.count_if("is_out"),
        "runs_stddev": lambda: F.round(F.stddev_samp("runs"), 2),
    },
    summary_rates=(
        *_STRIKE_RATES,
        Rate("average", "runs", "dismissals"),
        Rate("not_out_pct", "innings - dismissals", "innings", 100.0),
    ),
    regressed="regressed_strike_rate",
    per=100.0,
    splits={
        "runs": total(_batter_runs),
        "balls_faced": count(legal_ball),
        "boundaries": count(lambda: is_four() | is_six()),
    },
    split_rates=(Rate("strike_rate", "runs", "balls_faced", 100.0),
                 Rate("boundary_pct", "boundaries", "balls_faced", 100.0)),
    wide={"sr": "strike_rate", "balls": "balls_faced"},
    situations={s: ("runs", "balls_faced") for s in SITUATIONS},
    situation_rate=Rate("sr", "runs", "balls", 100.0),
    situation_extra={"dismissals_total": lambda: F.count_if("is_out")},
    situation_end_rates=(Rate("finisher_pct", "innings_total - dismissals_total", "innings_total", 100.0),),
)

_ECONOMY_RATES = (
    Rate("economy", "runs_conceded", "balls_bowled", 6.0),
    Rate("dot_pct", "dot_balls", "balls_bowled", 100.0),
    Rate("bowling_average", "runs_conceded", "wickets"),
    Rate("bowling_strike_rate", "balls_bowled", "wickets"),
    *_phase_rates("economy", "runs_conceded", "balls_bowled", 6.0),
)


def bowling_sheet(excluded_kinds: Sequence[str] = BOWLER_EXCLUDED_KINDS) -> Sheet:
    """The bowling sheet; wickets of ``excluded_kinds`` are not credited."""
    charged = {
        "runs_conceded": total(conceded_runs),
        "balls_bowled": count(legal_ball),
        "wickets": total(lambda: credited_wickets(excluded_kinds)),
    }
    return Sheet(
        player="bowler",
        side="bowling_team",
        side_of=opposing_team,
        runs="runs_conceded",
        balls="balls_bowled",
        innings={
            **charged,
            "dot_balls": count(lambda: legal_ball() & (F.col("runs_total") == 0)),
            "wides": count(lambda: F.col("extras_wides") > 0),
            "noballs": count(lambda: F.col("extras_noballs") > 0),
        },
        in_phase={name: name for name in charged},
        innings_rates=_ECONOMY_RATES,
        summary_sums=(*charged, "dot_balls", *(f"{p}_{m}" for p in PHASE_PREFIXES for m in charged)),
        summary_extra={},
        summary_rates=_ECONOMY_RATES,
        regressed="regressed_economy",
        per=6.0,
        splits=charged,
        split_rates=(Rate("economy", "runs_conceded", "balls_bowled", 6.0),),
        wide={"economy": "economy", "balls": "balls_bowled"},
        situations={"chase": ("runs_conceded", "balls_bowled"),
                    "close_match": tuple(charged), "knockout": tuple(charged)},
        situation_rate=Rate("economy", "runs_conceded", "balls_bowled", 6.0),
    )


BOWLING = bowling_sheet()
