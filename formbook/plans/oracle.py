"""DuckDB oracle SQL, composed from CTE fragments.

Each fragment is a ``name AS (...)`` text; ``with_ctes(names, select)``
emits the transitive closure in dependency order. These are the
independent re-statements used by the driver's correctness gate, so
they are written straight from the semantics, not generated from the
Spark plans.
"""

from __future__ import annotations

EXCLUDED = "('run out', 'retired hurt', 'retired not out', 'retired out', 'obstructing the field', 'timed out')"
T20 = "('IPL', 'BBL', 'PSL', 'CPL', 'SA20', 'ILT20', 'T20I')"


def r(expr: str, digits: int = 2) -> str:
    """Spark's ``round``: HALF_UP on the decimal value of the double."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def rate(num: str, den: str, scale: str = "1") -> str:
    return f"CASE WHEN {den} > 0 THEN {r(f'CAST({num} AS DOUBLE) * {scale} / {den}')} END"


def name_of(u: str) -> str:
    return f"concat(chr(CAST(65 + {u} % 26 AS INT)), ' Surname', CAST(CAST(floor({u} / 4) AS BIGINT) AS VARCHAR))"


def id_of(u: str) -> str:
    return f"CASE WHEN {u} % 37 = 0 THEN NULL ELSE concat('r', CAST({u} AS VARCHAR)) END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


# ------------------------------------------------------------------ D1
cte("e", (), """
  SELECT event_id, CASE WHEN user_id % 3 = 0 THEN user_id % 4 ELSE user_id END AS user_id, event_type, ts,
         CAST(round(value * 100) AS BIGINT) AS v,
         CAST(floor(event_id / 240) AS BIGINT) AS match_no,
         CAST(floor((event_id % 240) / 120) AS BIGINT) + 1 AS innings_seq,
         CAST(floor((event_id % 120) / 6) AS BIGINT) AS over_number,
         event_id % 6 AS delivery_seq
  FROM events""")
cte("k", ("e",), """
  SELECT e.*,
         first_value(user_id) OVER (PARTITION BY match_no, innings_seq, over_number ORDER BY event_id) AS bowler_user,
         first_value(user_id) OVER (PARTITION BY match_no, innings_seq ORDER BY event_id) AS keeper_user,
         CAST(CAST(first_value(ts) OVER (PARTITION BY match_no ORDER BY event_id) AS DATE) AS VARCHAR) AS match_date
  FROM e""")
cte("d1", ("k",), f"""
  SELECT concat('1', lpad(CAST(match_no AS VARCHAR), 6, '0')) AS match_id,
         CASE match_no % 9 WHEN 0 THEN 'IPL' WHEN 1 THEN 'BBL' WHEN 2 THEN 'PSL' WHEN 3 THEN 'CPL'
              WHEN 4 THEN 'SA20' WHEN 5 THEN 'ILT20' WHEN 6 THEN 'T20I' WHEN 7 THEN 'ODI' ELSE 'TEST' END AS competition,
         innings_seq, over_number, delivery_seq,
         CASE WHEN innings_seq = 1 THEN concat('Team ', CAST(match_no % 10 AS VARCHAR))
              ELSE concat('Team ', CAST((match_no + 3) % 10 AS VARCHAR)) END AS batting_team,
         concat('Team ', CAST(match_no % 10 AS VARCHAR)) AS team_1,
         concat('Team ', CAST((match_no + 3) % 10 AS VARCHAR)) AS team_2,
         {name_of('user_id')} AS batter,
         {id_of('user_id')} AS batter_id,
         {name_of('bowler_user')} AS bowler,
         {id_of('bowler_user')} AS bowler_id,
         CAST(CASE WHEN event_type = 'error' THEN 0 WHEN v % 10 < 4 THEN 0 WHEN v % 10 < 7 THEN 1
              WHEN v % 10 = 7 THEN 2 WHEN v % 10 = 8 THEN 4 ELSE 6 END AS BIGINT) AS runs_batter,
         v % 97 = 0 AS non_boundary,
         CASE WHEN event_type = 'error' AND v % 4 = 0 THEN 1 ELSE 0 END AS extras_wides,
         CASE WHEN event_type = 'error' AND v % 4 = 1 THEN 1 ELSE 0 END AS extras_noballs,
         CASE WHEN event_type = 'error' AND v % 4 = 2 THEN 1 ELSE 0 END AS extras_byes,
         CASE WHEN event_type = 'error' AND v % 4 = 3 THEN 1 ELSE 0 END AS extras_legbyes,
         event_type = 'signup' AND v % 5 = 0 AS is_wicket,
         CASE WHEN event_type = 'signup' AND v % 5 = 0 THEN
              CASE CAST(floor(v / 5) AS BIGINT) % 6 WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'run out'
                   WHEN 3 THEN 'lbw' WHEN 4 THEN 'stumped' ELSE 'retired hurt' END END AS wicket_kind,
         {id_of('keeper_user')} AS fielder_id,
         {name_of('keeper_user')} AS fielder_name,
         concat('Venue ', CAST(match_no % 7 AS VARCHAR)) AS venue,
         match_date,
         CAST(year(CAST(match_date AS DATE)) AS VARCHAR) AS season,
         CASE WHEN innings_seq = 2 THEN 100 + match_no % 50 END AS innings_target_runs,
         CASE WHEN match_no % 3 = 0 THEN match_no % 25 END AS outcome_by_runs,
         CASE WHEN match_no % 3 = 1 THEN match_no % 10 END AS outcome_by_wickets,
         CASE WHEN match_no % 8 = 0 THEN 'Final' END AS event_stage,
         CASE WHEN match_no % 9 = 8 THEN 'Test' WHEN match_no % 9 = 7 THEN 'ODI' ELSE 'T20' END AS match_type,
         match_no % 9 <> 8 AND over_number < 6 AS in_powerplay
  FROM k""")

# ------------------------------------------------------------ enrichment
cte("en", ("d1",), f"""
  SELECT d1.*,
         runs_batter + extras_wides + extras_noballs + extras_byes + extras_legbyes AS runs_total,
         max(over_number) OVER (PARTITION BY match_id, innings_seq) + 1 AS innings_overs,
         innings_target_runs IS NOT NULL AS is_chase,
         coalesce((outcome_by_runs IS NOT NULL AND outcome_by_runs <= 10)
                  OR (outcome_by_wickets IS NOT NULL AND outcome_by_wickets <= 2), false) AS is_close_match,
         event_stage IS NOT NULL AS is_knockout,
         coalesce(batter_id, concat('name:', batter)) AS batter_key,
         coalesce(bowler_id, concat('name:', bowler)) AS bowler_key,
         CASE WHEN is_wicket AND wicket_kind NOT IN {EXCLUDED} THEN 1 ELSE 0 END AS credited,
         extras_wides = 0 AND extras_noballs = 0 AS legal,
         runs_batter + extras_wides + extras_noballs AS conceded,
         CASE WHEN batting_team = team_1 THEN team_2 ELSE team_1 END AS bowling_team
  FROM d1""")
cte("enp", ("en",), """
  SELECT *,
         CASE WHEN match_type = 'Test' THEN NULL
              WHEN in_powerplay THEN 'powerplay'
              WHEN over_number >= (CASE WHEN innings_overs <= 20 THEN innings_overs - 4 ELSE innings_overs - 10 END)
                THEN 'death'
              ELSE 'middle' END AS phase,
         CASE WHEN match_type = 'Test' THEN NULL
              WHEN innings_overs <= 20 THEN innings_overs - 4 ELSE innings_overs - 10 END AS death_over_threshold
  FROM en""")

# ------------------------------------------------------------ innings facts
_ATTR = """bool_or(is_chase) AS is_chase, bool_or(is_close_match) AS is_close_match,
         bool_or(is_knockout) AS is_knockout, max(season) AS season, max(match_date) AS match_date,
         max(venue) AS venue, max(match_type) AS match_type"""
cte("dism", ("d1",), """
  SELECT match_id, innings_seq, batter AS player_out, wicket_kind AS dismissal_kind FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, innings_seq, batter
                                 ORDER BY over_number DESC, delivery_seq DESC, wicket_kind DESC) AS rn
    FROM d1 WHERE is_wicket) t
  WHERE rn = 1""")
cte("bat_base", ("enp",), f"""
  SELECT match_id, competition, innings_seq, batting_team, batter_key, batter_id, batter,
         CAST(sum(runs_batter) AS BIGINT) AS runs,
         CAST(sum(CASE WHEN legal THEN 1 ELSE 0 END) AS BIGINT) AS balls_faced,
         CAST(sum(CASE WHEN runs_batter = 4 AND NOT non_boundary THEN 1 ELSE 0 END) AS BIGINT) AS fours,
         CAST(sum(CASE WHEN runs_batter = 6 AND NOT non_boundary THEN 1 ELSE 0 END) AS BIGINT) AS sixes,
         CAST(sum(CASE WHEN legal AND runs_batter = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dot_balls,
         CAST(sum(CASE WHEN phase = 'powerplay' THEN runs_batter ELSE 0 END) AS BIGINT) AS pp_runs,
         CAST(sum(CASE WHEN phase = 'powerplay' AND legal THEN 1 ELSE 0 END) AS BIGINT) AS pp_balls,
         CAST(sum(CASE WHEN phase = 'death' THEN runs_batter ELSE 0 END) AS BIGINT) AS death_runs,
         CAST(sum(CASE WHEN phase = 'death' AND legal THEN 1 ELSE 0 END) AS BIGINT) AS death_balls,
         {_ATTR}
  FROM enp GROUP BY match_id, competition, innings_seq, batting_team, batter_key, batter_id, batter""")
cte("bat", ("bat_base", "dism"), f"""
  SELECT b.*, d.dismissal_kind, d.dismissal_kind IS NOT NULL AS is_out,
         {rate('runs', 'balls_faced', '100')} AS strike_rate,
         {rate('fours + sixes', 'balls_faced', '100')} AS boundary_pct,
         {rate('dot_balls', 'balls_faced', '100')} AS dot_pct,
         {rate('pp_runs', 'pp_balls', '100')} AS pp_strike_rate,
         {rate('death_runs', 'death_balls', '100')} AS death_strike_rate
  FROM bat_base b LEFT JOIN dism d
    ON b.match_id = d.match_id AND b.innings_seq = d.innings_seq AND b.batter = d.player_out""")
cte("bowl", ("enp",), f"""
  SELECT *,
         {rate('runs_conceded', 'balls_bowled', '6')} AS economy,
         {rate('runs_conceded', 'wickets')} AS bowling_average,
         {rate('balls_bowled', 'wickets')} AS bowling_strike_rate,
         {rate('dot_balls', 'balls_bowled', '100')} AS dot_pct,
         {rate('pp_runs_conceded', 'pp_balls_bowled', '6')} AS pp_economy,
         {rate('death_runs_conceded', 'death_balls_bowled', '6')} AS death_economy
  FROM (
    SELECT match_id, competition, innings_seq, bowling_team, bowler_key, bowler_id, bowler,
           CAST(sum(conceded) AS BIGINT) AS runs_conceded,
           CAST(sum(CASE WHEN legal THEN 1 ELSE 0 END) AS BIGINT) AS balls_bowled,
           CAST(sum(credited) AS BIGINT) AS wickets,
           CAST(sum(CASE WHEN legal AND runs_total = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dot_balls,
           CAST(sum(CASE WHEN extras_wides > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wides,
           CAST(sum(CASE WHEN extras_noballs > 0 THEN 1 ELSE 0 END) AS BIGINT) AS noballs,
           CAST(sum(CASE WHEN phase = 'powerplay' THEN conceded ELSE 0 END) AS BIGINT) AS pp_runs_conceded,
           CAST(sum(CASE WHEN phase = 'powerplay' AND legal THEN 1 ELSE 0 END) AS BIGINT) AS pp_balls_bowled,
           CAST(sum(CASE WHEN phase = 'powerplay' THEN credited ELSE 0 END) AS BIGINT) AS pp_wickets,
           CAST(sum(CASE WHEN phase = 'death' THEN conceded ELSE 0 END) AS BIGINT) AS death_runs_conceded,
           CAST(sum(CASE WHEN phase = 'death' AND legal THEN 1 ELSE 0 END) AS BIGINT) AS death_balls_bowled,
           CAST(sum(CASE WHEN phase = 'death' THEN credited ELSE 0 END) AS BIGINT) AS death_wickets,
           {_ATTR}
    FROM enp GROUP BY match_id, competition, innings_seq, bowling_team, bowler_key, bowler_id, bowler) t""")


# ------------------------------------------------------------ summaries
def bat_summary(src: str, keys: str, where: str, min_balls: int) -> str:
    return f"""
  SELECT *,
         {rate('runs', 'balls_faced', '100')} AS strike_rate,
         {rate('runs', 'dismissals')} AS average,
         {rate('innings - dismissals', 'innings', '100')} AS not_out_pct,
         {rate('fours + sixes', 'balls_faced', '100')} AS boundary_pct,
         {rate('pp_runs', 'pp_balls', '100')} AS pp_strike_rate,
         {rate('death_runs', 'death_balls', '100')} AS death_strike_rate
  FROM (
    SELECT {keys},
           arg_max(batter, concat_ws('|', match_date, match_id, batter)) AS player_name,
           count(DISTINCT concat(match_id, '#', CAST(innings_seq AS VARCHAR))) AS innings,
           CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls_faced) AS BIGINT) AS balls_faced,
           CAST(sum(fours) AS BIGINT) AS fours, CAST(sum(sixes) AS BIGINT) AS sixes,
           CAST(sum(CASE WHEN is_out THEN 1 ELSE 0 END) AS BIGINT) AS dismissals,
           CAST(sum(pp_runs) AS BIGINT) AS pp_runs, CAST(sum(pp_balls) AS BIGINT) AS pp_balls,
           CAST(sum(death_runs) AS BIGINT) AS death_runs, CAST(sum(death_balls) AS BIGINT) AS death_balls,
           {r('stddev_samp(runs)')} AS runs_stddev
    FROM {src} WHERE {where} GROUP BY {keys}) t
  WHERE balls_faced >= {min_balls}"""


def bowl_summary(src: str, keys: str, where: str, min_balls: int) -> str:
    return f"""
  SELECT *,
         {rate('runs_conceded', 'balls_bowled', '6')} AS economy,
         {rate('runs_conceded', 'wickets')} AS bowling_average,
         {rate('balls_bowled', 'wickets')} AS bowling_strike_rate,
         {rate('dot_balls', 'balls_bowled', '100')} AS dot_pct,
         {rate('pp_runs_conceded', 'pp_balls_bowled', '6')} AS pp_economy,
         {rate('death_runs_conceded', 'death_balls_bowled', '6')} AS death_economy
  FROM (
    SELECT {keys},
           arg_max(bowler, concat_ws('|', match_date, match_id, bowler)) AS player_name,
           count(DISTINCT concat(match_id, '#', CAST(innings_seq AS VARCHAR))) AS innings,
           CAST(sum(runs_conceded) AS BIGINT) AS runs_conceded, CAST(sum(balls_bowled) AS BIGINT) AS balls_bowled,
           CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(dot_balls) AS BIGINT) AS dot_balls,
           CAST(sum(pp_runs_conceded) AS BIGINT) AS pp_runs_conceded,
           CAST(sum(pp_balls_bowled) AS BIGINT) AS pp_balls_bowled,
           CAST(sum(pp_wickets) AS BIGINT) AS pp_wickets,
           CAST(sum(death_runs_conceded) AS BIGINT) AS death_runs_conceded,
           CAST(sum(death_balls_bowled) AS BIGINT) AS death_balls_bowled,
           CAST(sum(death_wickets) AS BIGINT) AS death_wickets
    FROM {src} WHERE {where} GROUP BY {keys}) t
  WHERE balls_bowled >= {min_balls}"""


RECENT = ("competition IN " + T20 + " AND CAST(match_date AS DATE) >= "
          "(SELECT max(CAST(match_date AS DATE)) FROM bat) - 545")

cte("bat_career", ("bat",), bat_summary("bat", "batter_key", "true", 60))
cte("bowl_career", ("bowl",), bowl_summary("bowl", "bowler_key", "true", 60))
cte("bat_t20_base", ("bat",), bat_summary("bat", "batter_key", f"competition IN {T20}", 60))
cte("bowl_t20_base", ("bowl",), bowl_summary("bowl", "bowler_key", f"competition IN {T20}", 60))
cte("bat_recent_base", ("bat",), bat_summary("bat", "batter_key", RECENT, 30))
cte("bowl_recent_base", ("bowl", "bat"), bowl_summary("bowl", "bowler_key", RECENT, 30))
cte("bat_venue", ("bat",), bat_summary("bat", "batter_key, venue", f"competition IN {T20}", 60))
cte("bowl_venue", ("bowl",), bowl_summary("bowl", "bowler_key, venue", f"competition IN {T20}", 60))


def regressed_bat(base: str) -> str:
    return f"""
  SELECT *, {r(f"(runs + 120 * (SELECT CAST(sum(runs) AS DOUBLE) / sum(balls_faced) FROM {base}))"
                 " / (balls_faced + 120) * 100")} AS regressed_strike_rate
  FROM {base}"""


def regressed_bowl(base: str) -> str:
    return f"""
  SELECT *, {r(f"(runs_conceded + 120 * (SELECT CAST(sum(runs_conceded) AS DOUBLE) / sum(balls_bowled) FROM {base}))"
                 " / (balls_bowled + 120) * 6")} AS regressed_economy
  FROM {base}"""


cte("bat_t20", ("bat_t20_base",), regressed_bat("bat_t20_base"))
cte("bowl_t20", ("bowl_t20_base",), regressed_bowl("bowl_t20_base"))
cte("bat_recent", ("bat_recent_base",), regressed_bat("bat_recent_base"))
cte("bowl_recent", ("bowl_recent_base",), regressed_bowl("bowl_recent_base"))


RECURSIVE = {"ledger_rec"}


def with_ctes(names: tuple[str, ...] | list[str], select: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    kw = "WITH RECURSIVE" if RECURSIVE & set(order) else "WITH"
    return f"{kw} {body}\n{select}"


# ------------------------------------------------------------ phases / situational
_LABEL_BAT = "arg_max(batter, concat_ws('|', match_date, match_id, batter))"
_LABEL_BOWL = "arg_max(bowler, concat_ws('|', match_date, match_id, bowler))"
_INN = "count(DISTINCT concat(match_id, '#', CAST(innings_seq AS VARCHAR)))"

cte("bat_phase", ("enp",), f"""
  SELECT *, {rate('runs', 'balls_faced', '100')} AS strike_rate,
            {rate('boundaries', 'balls_faced', '100')} AS boundary_pct
  FROM (
    SELECT batter_key, phase, {_LABEL_BAT} AS player_name, {_INN} AS innings,
           CAST(sum(runs_batter) AS BIGINT) AS runs,
           CAST(sum(CASE WHEN legal THEN 1 ELSE 0 END) AS BIGINT) AS balls_faced,
           CAST(sum(CASE WHEN runs_batter IN (4, 6) AND NOT non_boundary THEN 1 ELSE 0 END) AS BIGINT) AS boundaries
    FROM enp WHERE competition IN {T20} AND phase IS NOT NULL
    GROUP BY batter_key, phase) t
  WHERE balls_faced >= 30""")
cte("bowl_phase", ("enp",), f"""
  SELECT *, {rate('runs_conceded', 'balls_bowled', '6')} AS economy
  FROM (
    SELECT bowler_key, phase, {_LABEL_BOWL} AS player_name, {_INN} AS innings,
           CAST(sum(conceded) AS BIGINT) AS runs_conceded,
           CAST(sum(CASE WHEN legal THEN 1 ELSE 0 END) AS BIGINT) AS balls_bowled,
           CAST(sum(credited) AS BIGINT) AS wickets
    FROM enp WHERE competition IN {T20} AND phase IS NOT NULL
    GROUP BY bowler_key, phase) t
  WHERE balls_bowled >= 30""")
cte("bat_phase_wide", ("bat_phase",), """
  SELECT batter_key,
         max(CASE WHEN phase = 'powerplay' THEN strike_rate END) AS powerplay_sr,
         max(CASE WHEN phase = 'powerplay' THEN balls_faced END) AS powerplay_balls,
         max(CASE WHEN phase = 'middle' THEN strike_rate END) AS middle_sr,
         max(CASE WHEN phase = 'middle' THEN balls_faced END) AS middle_balls,
         max(CASE WHEN phase = 'death' THEN strike_rate END) AS death_sr,
         max(CASE WHEN phase = 'death' THEN balls_faced END) AS death_balls
  FROM bat_phase GROUP BY batter_key""")
cte("bowl_phase_wide", ("bowl_phase",), """
  SELECT bowler_key,
         max(CASE WHEN phase = 'powerplay' THEN economy END) AS powerplay_economy,
         max(CASE WHEN phase = 'powerplay' THEN balls_bowled END) AS powerplay_balls,
         max(CASE WHEN phase = 'middle' THEN economy END) AS middle_economy,
         max(CASE WHEN phase = 'middle' THEN balls_bowled END) AS middle_balls,
         max(CASE WHEN phase = 'death' THEN economy END) AS death_economy,
         max(CASE WHEN phase = 'death' THEN balls_bowled END) AS death_balls
  FROM bowl_phase GROUP BY bowler_key""")


def _csum(cond: str, col: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN {col} ELSE 0 END) AS BIGINT)"


cte("bat_sit", ("bat",), f"""
  SELECT *, {rate('chase_runs', 'chase_balls', '100')} AS chase_sr,
            {rate('defend_runs', 'defend_balls', '100')} AS defend_sr,
            {rate('close_match_runs', 'close_match_balls', '100')} AS close_match_sr,
            {rate('knockout_runs', 'knockout_balls', '100')} AS knockout_sr,
            {rate('innings_total - dismissals_total', 'innings_total', '100')} AS finisher_pct
  FROM (
    SELECT batter_key, {_LABEL_BAT} AS player_name,
           {_csum('is_chase', 'runs')} AS chase_runs, {_csum('is_chase', 'balls_faced')} AS chase_balls,
           {_csum('NOT is_chase', 'runs')} AS defend_runs, {_csum('NOT is_chase', 'balls_faced')} AS defend_balls,
           {_csum('is_close_match', 'runs')} AS close_match_runs,
           {_csum('is_close_match', 'balls_faced')} AS close_match_balls,
           {_csum('is_knockout', 'runs')} AS knockout_runs, {_csum('is_knockout', 'balls_faced')} AS knockout_balls,
           {_csum('is_out', '1')} AS dismissals_total, {_INN} AS innings_total
    FROM bat WHERE competition IN {T20} GROUP BY batter_key) t
  WHERE innings_total >= 10""")
cte("bowl_sit", ("bowl",), f"""
  SELECT *, {rate('chase_runs_conceded', 'chase_balls_bowled', '6')} AS chase_economy,
            {rate('close_match_runs_conceded', 'close_match_balls_bowled', '6')} AS close_match_economy,
            {rate('knockout_runs_conceded', 'knockout_balls_bowled', '6')} AS knockout_economy
  FROM (
    SELECT bowler_key, {_LABEL_BOWL} AS player_name,
           {_csum('is_chase', 'runs_conceded')} AS chase_runs_conceded,
           {_csum('is_chase', 'balls_bowled')} AS chase_balls_bowled,
           {_csum('is_close_match', 'runs_conceded')} AS close_match_runs_conceded,
           {_csum('is_close_match', 'balls_bowled')} AS close_match_balls_bowled,
           {_csum('is_close_match', 'wickets')} AS close_match_wickets,
           {_csum('is_knockout', 'runs_conceded')} AS knockout_runs_conceded,
           {_csum('is_knockout', 'balls_bowled')} AS knockout_balls_bowled,
           {_csum('is_knockout', 'wickets')} AS knockout_wickets,
           {_INN} AS innings_total
    FROM bowl WHERE competition IN {T20} GROUP BY bowler_key) t
  WHERE innings_total >= 10""")
cte("allround", ("bat_t20", "bowl_t20"), f"""
  SELECT b.batter_key AS player_key, b.player_name, b.innings AS batting_innings, b.runs, b.strike_rate,
         b.average AS batting_average, w.innings AS bowling_innings, w.wickets, w.economy, w.bowling_average,
         {r('w.innings * 100.0 / b.innings', 1)} AS bowling_involvement_pct
  FROM bat_t20 b JOIN bowl_t20 w ON b.batter_key = w.bowler_key""")

# ------------------------------------------------------------ positions / keeper / profiles
cte("pos", ("en",), f"""
  SELECT match_id, innings_seq, batter_key, fbo AS first_ball_ordinal,
         CAST(row_number() OVER (PARTITION BY match_id, innings_seq ORDER BY fbo, batter_key) AS BIGINT)
           AS batting_position
  FROM (SELECT match_id, innings_seq, batter_key, min(over_number * 1000 + delivery_seq) AS fbo
        FROM en WHERE competition IN {T20} GROUP BY match_id, innings_seq, batter_key) t""")
cte("pos_sum", ("pos",), """
  SELECT batter_key, CAST(quantile_disc(batting_position, 0.5) AS BIGINT) AS usual_batting_position,
         count(*) AS position_sample_innings
  FROM pos GROUP BY batter_key""")
cte("keeper", ("d1",), f"""
  SELECT coalesce(fielder_id, concat('name:', fielder_name)) AS fielder_key, count(*) AS likely_keeper_signal
  FROM d1 WHERE competition IN {T20} AND is_wicket AND wicket_kind = 'stumped' GROUP BY 1""")
cte("batter_profile", ("bat_recent", "bat_t20", "pos_sum", "bat_sit", "bat_phase_wide", "keeper"), """
  SELECT r.batter_key, r.player_name, r.innings AS recent_innings, r.runs AS recent_runs,
         r.balls_faced AS recent_balls_faced, r.average AS recent_average, r.strike_rate AS recent_strike_rate,
         r.regressed_strike_rate, r.not_out_pct AS recent_not_out_pct, r.boundary_pct AS recent_boundary_pct,
         c.innings AS career_innings, c.runs AS career_runs, c.average AS career_average,
         c.strike_rate AS career_strike_rate,
         p.usual_batting_position, p.position_sample_innings,
         s.chase_sr, s.defend_sr, s.close_match_sr, s.knockout_sr, s.finisher_pct,
         w.powerplay_sr, w.powerplay_balls, w.middle_sr, w.middle_balls, w.death_sr, w.death_balls,
         coalesce(k.likely_keeper_signal, 0) AS likely_keeper_signal
  FROM bat_recent r
  LEFT JOIN bat_t20 c ON c.batter_key = r.batter_key
  LEFT JOIN pos_sum p ON p.batter_key = r.batter_key
  LEFT JOIN bat_sit s ON s.batter_key = r.batter_key
  LEFT JOIN bat_phase_wide w ON w.batter_key = r.batter_key
  LEFT JOIN keeper k ON k.fielder_key = r.batter_key""")
cte("bowler_base", ("bowl_recent", "bowl_t20", "bowl_sit", "bowl_phase_wide"), """
  SELECT r.bowler_key, r.player_name, r.innings AS recent_innings, r.wickets AS recent_wickets,
         r.balls_bowled AS recent_balls_bowled, r.runs_conceded AS recent_runs_conceded,
         r.economy AS recent_economy, r.regressed_economy, r.bowling_strike_rate AS recent_bowling_strike_rate,
         r.bowling_average AS recent_bowling_average, r.dot_pct AS recent_dot_pct,
         c.innings AS career_innings, c.wickets AS career_wickets, c.economy AS career_economy,
         c.bowling_strike_rate AS career_bowling_strike_rate,
         s.chase_economy, s.close_match_economy, s.knockout_economy,
         w.powerplay_economy, w.powerplay_balls, w.middle_economy, w.middle_balls, w.death_economy, w.death_balls
  FROM bowl_recent r
  LEFT JOIN bowl_t20 c ON c.bowler_key = r.bowler_key
  LEFT JOIN bowl_sit s ON s.bowler_key = r.bowler_key
  LEFT JOIN bowl_phase_wide w ON w.bowler_key = r.bowler_key""")
cte("bowler_ranked", ("bowler_base",), f"""
  SELECT *,
         {r('percent_rank() OVER (ORDER BY regressed_economy ASC NULLS FIRST)', 3)} AS economy_percentile,
         {r('percent_rank() OVER (ORDER BY recent_bowling_strike_rate ASC NULLS FIRST)', 3)}
           AS strike_rate_percentile
  FROM bowler_base""")
cte("bowler_profile", ("bowler_ranked",), """
  SELECT *,
         CASE WHEN recent_wickets = 0 THEN NULL
              WHEN strike_rate_percentile + 0.15 < economy_percentile THEN 'strike bowler'
              WHEN economy_percentile + 0.15 < strike_rate_percentile THEN 'containment bowler'
              ELSE 'balanced' END AS bowler_type
  FROM bowler_ranked""")


# ------------------------------------------------------------ D3 league state
cte("franchises", (), """
  SELECT CAST(n_nationkey AS BIGINT) AS franchise_id, n_name AS name,
         CAST(125 AS DECIMAL(10,2)) AS purse_total_cr,
         CAST(5 + n_nationkey % 20 AS DECIMAL(10,2)) AS purse_remaining_cr,
         CASE WHEN n_nationkey % 2 = 1 THEN 1000000 ELSE 25 END AS max_squad_size,
         CASE WHEN n_nationkey % 4 = 1 THEN 1000000 ELSE 8 END AS max_overseas,
         concat('Venue ', CAST(n_nationkey % 7 AS VARCHAR)) AS home_venue,
         n_nationkey % 12 <> 11 AS is_active
  FROM nation""")
cte("roster", (), """
  SELECT c_custkey AS roster_id, CAST(c_nationkey AS BIGINT) AS franchise_id,
         concat(chr(CAST(65 + c_custkey % 26 AS INT)), CASE WHEN c_custkey % 2 = 1 THEN 'lex' ELSE '' END,
                ' Surname', CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS VARCHAR)) AS player_name,
         CASE c_custkey % 4 WHEN 0 THEN 'batter' WHEN 1 THEN 'bowler' WHEN 2 THEN 'all-rounder'
              ELSE 'wicketkeeper' END AS role,
         CASE c_custkey % 3 WHEN 0 THEN 'pace' WHEN 1 THEN 'spin' ELSE 'na' END AS bowling_style,
         c_custkey % 3 = 0 AS is_overseas,
         CASE WHEN c_custkey % 5 = 0 THEN 'auction' ELSE 'imported' END AS acquisition_type,
         CAST(c_custkey % 9 AS DECIMAL(10,2)) AS price_cr,
         CASE WHEN c_custkey % 11 = 0 THEN 'released' ELSE 'active' END AS status
  FROM customer""")
cte("pool", (), """
  SELECT s_suppkey AS pool_id, s_suppkey + 1 AS sr_no,
         concat(chr(CAST(65 + (s_suppkey * 7) % 26 AS INT)), ' Surname',
                CAST(CAST(floor(s_suppkey * 7 / 4) AS BIGINT) AS VARCHAR)) AS player_name,
         concat('Country ', CAST(s_nationkey AS VARCHAR)) AS country,
         20 + s_suppkey % 20 AS age,
         CASE s_suppkey % 4 WHEN 0 THEN 'batter' WHEN 1 THEN 'bowler' WHEN 2 THEN 'all-rounder'
              ELSE 'wicketkeeper' END AS role,
         CASE WHEN s_suppkey % 2 = 0 THEN 'capped' ELSE 'uncapped' END AS capped_status,
         CASE s_suppkey % 3 WHEN 0 THEN 'spin' WHEN 1 THEN 'pace' ELSE 'na' END AS bowling_style,
         s_suppkey % 3 = 0 AS is_overseas,
         CAST(30 + (s_suppkey % 5) * 40 AS DECIMAL(10,2)) AS base_price_lakh,
         s_suppkey % 13 <> 12 AS is_current_reference
  FROM supplier""")
cte("bids", (), """
  SELECT o_orderkey AS bid_id, CAST(floor(o_orderkey / 500) AS BIGINT) AS auction_id, o_custkey % 27 AS franchise_id,
         o_orderkey % (SELECT count(*) + count(*) // 10 FROM supplier) AS pool_id,
         CAST(floor(o_totalprice / 1000) AS DOUBLE) / 100 AS price_cr
  FROM orders""")

SUR = "list_extract(string_split_regex(lower(trim({x})), '\\s+'), -1)"
INI = "substring(lower(trim({x})), 1, 1)"


def sur(x: str) -> str:
    return SUR.format(x=x)


def ini(x: str) -> str:
    return INI.format(x=x)


def resolve_sql(src: str, src_name: str, prof: str, key: str, out: str, extra_keys: str = "") -> str:
    """Exact -> unique surname -> unique surname+initial, as a SELECT
    adding ``out`` (and ``out``_tier) to every row of ``src``."""
    return f"""
  SELECT s.*,
         CASE WHEN trim(coalesce(s.{src_name}, '')) = '' THEN NULL
              WHEN e.k IS NOT NULL THEN e.k WHEN su.n = 1 THEN su.k WHEN si.n = 1 THEN si.k END AS {out},
         CASE WHEN trim(coalesce(s.{src_name}, '')) = '' THEN NULL
              WHEN e.k IS NOT NULL THEN 'exact' WHEN su.n = 1 THEN 'surname'
              WHEN si.n = 1 THEN 'surname_initial' END AS {out}_tier
  FROM {src} s
  LEFT JOIN (SELECT lower(player_name) AS l, min({key}) AS k FROM {prof} GROUP BY 1) e
    ON e.l = lower(trim(s.{src_name}))
  LEFT JOIN (SELECT {sur('player_name')} AS su, count(*) AS n, min({key}) AS k FROM {prof} GROUP BY 1) su
    ON su.su = {sur('s.' + src_name)}
  LEFT JOIN (SELECT {sur('player_name')} AS su, {ini('player_name')} AS i, count(*) AS n, min({key}) AS k
             FROM {prof} GROUP BY 1, 2) si
    ON si.su = {sur('s.' + src_name)} AND si.i = {ini('s.' + src_name)}"""


cte("resolved_roster", ("roster", "batter_profile"),
    resolve_sql("roster", "player_name", "batter_profile", "batter_key", "matched_key"))


def search_sql(terms: str, tid: str, term: str, prof: str, key: str, k: int) -> str:
    t = f"(SELECT {tid} AS tid, lower(trim({term})) AS term FROM {terms} WHERE length(trim({term})) > 0)"
    return f"""
  SELECT tid AS {tid}, pk AS {key}, pname AS player_name, tier AS match_tier, match_rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY tid ORDER BY pname, pk) AS BIGINT) AS match_rank FROM (
      SELECT t.tid, p.{key} AS pk, p.player_name AS pname, 'substring' AS tier
      FROM {t} t JOIN {prof} p ON contains(lower(p.player_name), t.term)
      UNION ALL
      SELECT x.tid, p.{key}, p.player_name, x.tier FROM (
        SELECT t.tid, string_split_regex(t.term, '\\s+')[-1] AS su,
               substring(string_split_regex(t.term, '\\s+')[1], 1, 1) AS i,
               CASE WHEN EXISTS (SELECT 1 FROM {prof} p2
                                 WHERE {sur('p2.player_name')} = string_split_regex(t.term, '\\s+')[-1]
                                   AND {ini('p2.player_name')} = substring(string_split_regex(t.term, '\\s+')[1], 1, 1))
                    THEN 'surname_initial' ELSE 'surname' END AS tier
        FROM {t} t
        WHERE NOT EXISTS (SELECT 1 FROM {prof} p3 WHERE contains(lower(p3.player_name), t.term))) x
      JOIN {prof} p ON {sur('p.player_name')} = x.su AND (x.tier = 'surname' OR {ini('p.player_name')} = x.i)
    ) a
  ) b WHERE match_rank <= {k}"""


cte("searched_roster", ("roster", "batter_profile"),
    search_sql("roster", "roster_id", "player_name", "batter_profile", "batter_key", 3))

# ------------------------------------------------------------ league analytics
cte("league_summary", ("franchises", "roster"), """
  SELECT f.franchise_id, f.name, f.purse_total_cr, f.purse_remaining_cr, f.max_squad_size, f.max_overseas,
         f.home_venue,
         count(r.roster_id) AS squad_size,
         count(r.roster_id) FILTER (WHERE r.is_overseas) AS overseas_count,
         count(r.roster_id) FILTER (WHERE r.role = 'batter') AS batters,
         count(r.roster_id) FILTER (WHERE r.role = 'bowler') AS bowlers,
         count(r.roster_id) FILTER (WHERE r.role = 'all-rounder') AS all_rounders,
         count(r.roster_id) FILTER (WHERE r.role = 'wicketkeeper') AS wicketkeepers
  FROM franchises f LEFT JOIN roster r ON r.franchise_id = f.franchise_id AND r.status = 'active'
  WHERE f.is_active
  GROUP BY f.franchise_id, f.name, f.purse_total_cr, f.purse_remaining_cr, f.max_squad_size, f.max_overseas,
           f.home_venue""")
cte("cap_status", ("league_summary",), f"""
  SELECT franchise_id, name, squad_size, max_squad_size, overseas_count, max_overseas,
         max_squad_size - squad_size AS slots_left, max_overseas - overseas_count AS overseas_left,
         CASE WHEN max_squad_size - squad_size >= 0 THEN concat(CAST(max_squad_size - squad_size AS VARCHAR), ' LEFT')
              ELSE concat('OVER BY ', CAST(squad_size - max_squad_size AS VARCHAR)) END AS squad_slots_label,
         CASE WHEN max_overseas - overseas_count >= 0
              THEN concat(CAST(max_overseas - overseas_count AS VARCHAR), ' LEFT')
              ELSE concat('OVER BY ', CAST(overseas_count - max_overseas AS VARCHAR)) END AS overseas_slots_label,
         squad_size > max_squad_size AS over_squad_cap, overseas_count > max_overseas AS over_overseas_cap,
         CASE WHEN purse_total_cr > 0 THEN
              {r('CAST(purse_remaining_cr AS DOUBLE) / CAST(purse_total_cr AS DOUBLE) * 100')} END AS purse_pct_left
  FROM league_summary""")
cte("purse_board", ("franchises",), """
  SELECT franchise_id, name, CAST(purse_remaining_cr AS DOUBLE) AS remaining_cr,
         CAST(purse_total_cr - purse_remaining_cr AS DOUBLE) AS spent_cr
  FROM franchises WHERE is_active""")
cte("league_totals", ("league_summary",), f"""
  SELECT {r('sum(CAST(purse_remaining_cr AS DOUBLE))')} AS total_purse_left_cr,
         arg_max(name, CAST(purse_remaining_cr AS DOUBLE) * 1000000 - franchise_id) AS max_purse_team,
         max(CAST(purse_remaining_cr AS DOUBLE)) AS max_purse_cr,
         count(*) FILTER (WHERE squad_size > max_squad_size) AS teams_over_cap
  FROM league_summary""")
cte("unowned", ("pool", "roster"), """
  SELECT p.* FROM pool p
  WHERE p.is_current_reference
    AND NOT EXISTS (SELECT 1 FROM roster r WHERE lower(r.player_name) = lower(p.player_name)
                    AND r.status = 'active')""")
cte("pool_comp", ("pool",), """
  SELECT role, is_overseas, capped_status, count(*) AS players FROM pool GROUP BY 1, 2, 3""")
cte("franchise_status", ("franchises", "roster"), """
  SELECT q.query, f.franchise_id IS NOT NULL AS found, f.franchise_id, f.name,
         CAST(f.purse_total_cr AS DOUBLE) AS purse_total_cr, CAST(f.purse_remaining_cr AS DOUBLE) AS purse_remaining_cr,
         f.max_squad_size, f.max_overseas,
         CASE WHEN f.franchise_id IS NOT NULL THEN coalesce(c.squad_size, 0) END AS squad_size,
         CASE WHEN f.franchise_id IS NOT NULL THEN coalesce(c.overseas_count, 0) END AS overseas_count
  FROM (SELECT DISTINCT c_mktsegment AS query FROM customer
        UNION SELECT DISTINCT n_name FROM nation) q
  LEFT JOIN franchises f ON lower(f.name) = lower(q.query)
  LEFT JOIN (SELECT franchise_id, count(*) AS squad_size, count(*) FILTER (WHERE is_overseas) AS overseas_count
             FROM roster WHERE status = 'active' GROUP BY 1) c ON c.franchise_id = f.franchise_id""")


def resolve_in_group_sql(src: str, src_name: str, grp: str, sub: str, rowid: str, out: str) -> str:
    """Resolution restricted to the rows of ``sub`` with the same ``grp``."""
    return f"""
  SELECT s.*,
         CASE WHEN e.k IS NOT NULL THEN e.k WHEN su.n = 1 THEN su.k WHEN si.n = 1 THEN si.k END AS {out}
  FROM {src} s
  LEFT JOIN (SELECT {grp} AS g, lower(player_name) AS l, min({rowid}) AS k FROM {sub} GROUP BY 1, 2) e
    ON e.g = s.{grp} AND e.l = lower(trim(s.{src_name}))
  LEFT JOIN (SELECT {grp} AS g, {sur('player_name')} AS su, count(*) AS n, min({rowid}) AS k FROM {sub} GROUP BY 1, 2) su
    ON su.g = s.{grp} AND su.su = {sur('s.' + src_name)}
  LEFT JOIN (SELECT {grp} AS g, {sur('player_name')} AS su, {ini('player_name')} AS i, count(*) AS n,
                    min({rowid}) AS k FROM {sub} GROUP BY 1, 2, 3) si
    ON si.g = s.{grp} AND si.su = {sur('s.' + src_name)} AND si.i = {ini('s.' + src_name)}"""


cte("targets_base", ("unowned",), """
  SELECT pool_id, sr_no, player_name, role, country, age, is_overseas, capped_status,
         CAST(base_price_lakh AS DOUBLE) / 100.0 AS base_price_cr FROM unowned""")
cte("targets_bat", ("targets_base", "batter_profile"),
    resolve_sql("targets_base", "player_name", "batter_profile", "batter_key", "bat_k"))
cte("targets_both", ("targets_bat", "bowler_profile"),
    resolve_sql("targets_bat", "player_name", "bowler_profile", "bowler_key", "bowl_k"))
cte("auction_targets", ("targets_both",), """
  SELECT t.pool_id, t.sr_no, t.player_name, t.role, t.country, t.age, t.is_overseas, t.capped_status,
         t.base_price_cr,
         b.recent_innings AS bat_innings, b.recent_strike_rate AS bat_strike_rate, b.recent_average AS bat_average,
         w.recent_innings AS bowl_innings, w.recent_economy AS bowl_economy, w.recent_wickets AS bowl_wickets,
         w.bowler_type AS bowl_bowler_type,
         (b.recent_innings IS NOT NULL OR w.recent_innings IS NOT NULL) AS has_data
  FROM targets_both t
  LEFT JOIN batter_profile b ON b.batter_key = t.bat_k
  LEFT JOIN bowler_profile w ON w.bowler_key = t.bowl_k
  ORDER BY has_data DESC, sr_no, pool_id LIMIT 12""")
cte("targets_filtered", ("targets_both",), CTES["auction_targets"][1].replace(
    "ORDER BY", "WHERE lower(t.role) = 'bowler' AND t.is_overseas\n  ORDER BY"))

cte("fv", ("franchises", "bat_venue", "bowl_venue"), """
  SELECT DISTINCT f.franchise_id, v.venue
  FROM franchises f
  JOIN (SELECT venue FROM bat_venue UNION SELECT venue FROM bowl_venue) v
    ON f.is_active AND f.home_venue IS NOT NULL AND contains(lower(v.venue), lower(f.home_venue))""")
cte("ret_base", ("roster", "franchises"), """
  SELECT r.roster_id, r.franchise_id, f.name AS franchise_name, f.home_venue, r.player_name, r.role, r.is_overseas
  FROM roster r JOIN franchises f ON f.franchise_id = r.franchise_id AND f.is_active
  WHERE r.status = 'active'""")
cte("ret_bat", ("ret_base", "batter_profile"),
    resolve_sql("ret_base", "player_name", "batter_profile", "batter_key", "bat_k"))
cte("ret_both", ("ret_bat", "bowler_profile"),
    resolve_sql("ret_bat", "player_name", "bowler_profile", "bowler_key", "bowl_k"))
cte("vbat_sub", ("bat_venue", "fv"), """
  SELECT fv.franchise_id, b.*, concat_ws('|', b.batter_key, b.venue) AS rowid FROM bat_venue b JOIN fv USING (venue)""")
cte("vbowl_sub", ("bowl_venue", "fv"), """
  SELECT fv.franchise_id, b.*, concat_ws('|', b.bowler_key, b.venue) AS rowid FROM bowl_venue b JOIN fv USING (venue)""")
cte("ret_vbat", ("ret_both", "vbat_sub"),
    resolve_in_group_sql("ret_both", "player_name", "franchise_id", "vbat_sub", "rowid", "vbat_k"))
cte("ret_all", ("ret_vbat", "vbowl_sub"),
    resolve_in_group_sql("ret_vbat", "player_name", "franchise_id", "vbowl_sub", "rowid", "vbowl_k"))
cte("retention", ("ret_all", "batter_profile", "bowler_profile", "vbat_sub", "vbowl_sub"), """
  SELECT t.roster_id, t.franchise_id, t.franchise_name, t.home_venue, t.player_name, t.role, t.is_overseas,
         b.recent_innings AS bat_recent_innings, b.recent_strike_rate AS bat_recent_strike_rate,
         b.regressed_strike_rate AS bat_recent_regressed_strike_rate, b.recent_average AS bat_recent_average,
         w.recent_innings AS bowl_recent_innings, w.recent_economy AS bowl_recent_economy,
         w.regressed_economy AS bowl_recent_regressed_economy, w.recent_wickets AS bowl_recent_wickets,
         vb.innings AS venue_bat_innings, vb.strike_rate AS venue_bat_strike_rate, vb.average AS venue_bat_average,
         vw.innings AS venue_bowl_innings, vw.economy AS venue_bowl_economy, vw.wickets AS venue_bowl_wickets
  FROM ret_all t
  LEFT JOIN batter_profile b ON b.batter_key = t.bat_k
  LEFT JOIN bowler_profile w ON w.bowler_key = t.bowl_k
  LEFT JOIN vbat_sub vb ON vb.franchise_id = t.franchise_id AND vb.rowid = t.vbat_k
  LEFT JOIN vbowl_sub vw ON vw.franchise_id = t.franchise_id AND vw.rowid = t.vbowl_k""")


# ------------------------------------------------------------ bids
cte("bid_ctx", ("bids", "franchises", "pool", "roster"), """
  SELECT b.*, f.franchise_id IS NOT NULL AS franchise_known, p.pool_id IS NOT NULL AS player_known,
         p.player_name, p.is_overseas, CAST(p.base_price_lakh AS DOUBLE) / 100.0 AS base_price_cr,
         CAST(f.purse_remaining_cr AS DOUBLE) AS purse_remaining_cr, f.max_squad_size, f.max_overseas,
         coalesce(c.squad_size, 0) AS squad_size, coalesce(c.overseas_count, 0) AS overseas_count,
         EXISTS (SELECT 1 FROM roster r WHERE r.status = 'active' AND lower(r.player_name) = lower(p.player_name))
           AS owned
  FROM bids b
  LEFT JOIN franchises f ON f.franchise_id = b.franchise_id
  LEFT JOIN pool p ON p.pool_id = b.pool_id
  LEFT JOIN (SELECT franchise_id, count(*) AS squad_size, count(*) FILTER (WHERE is_overseas) AS overseas_count
             FROM roster WHERE status = 'active' GROUP BY 1) c ON c.franchise_id = b.franchise_id""")
cte("bid_validation", ("bid_ctx",), """
  SELECT bid_id, auction_id, franchise_id, pool_id, price_cr, player_name,
         reasons IS NULL AS accepted,
         CASE WHEN reasons IS NULL THEN 'success' ELSE concat('blocked: ', reasons) END AS result_status
  FROM (
    SELECT *,
      CASE WHEN NOT franchise_known THEN 'unknown franchise'
           WHEN NOT player_known THEN 'unknown player'
           ELSE nullif(concat_ws('; ',
                  CASE WHEN owned THEN 'already on an active roster' END,
                  CASE WHEN price_cr > purse_remaining_cr THEN 'bid exceeds remaining purse' END,
                  CASE WHEN squad_size >= max_squad_size THEN 'squad at max size' END,
                  CASE WHEN is_overseas AND overseas_count >= max_overseas THEN 'overseas cap reached' END,
                  CASE WHEN price_cr < base_price_cr THEN 'bid below base price' END), '') END AS reasons
    FROM bid_ctx) t""")

# ------------------------------------------------------------ D4 change log
cte("change_log", (), """
  SELECT event_id + 1 AS event_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'data_change' ELSE 'tool_call' END AS event_type,
         CASE event_type WHEN 'click' THEN 'get_player_form_profile' WHEN 'view' THEN 'search_player_news'
              WHEN 'purchase' THEN 'save_strategy_note' ELSE 'execute_player_bid' END AS tool_name,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 25 END AS franchise_id,
         props AS payload,
         CASE event_type WHEN 'error' THEN 'blocked: purse' WHEN 'signup' THEN 'success'
              WHEN 'purchase' THEN 'success' ELSE 'found' END AS result_status,
         ts AS created_at
  FROM events""")
cte("audit_trail", ("change_log", "franchises"), """
  SELECT c.event_id, c.event_type, c.tool_name, c.result_status, c.payload, c.created_at, f.name AS franchise_name
  FROM change_log c LEFT JOIN franchises f ON f.franchise_id = c.franchise_id
  ORDER BY c.event_id DESC LIMIT 25""")
cte("tool_usage", ("change_log",), "SELECT tool_name, count(*) AS calls FROM change_log GROUP BY 1")
cte("bid_outcomes", ("change_log",), """
  SELECT count(*) FILTER (WHERE result_status = 'success') AS successful_bids,
         count(*) FILTER (WHERE starts_with(result_status, 'blocked')) AS blocked_bids,
         count(*) AS bid_events
  FROM change_log WHERE tool_name = 'execute_player_bid'""")
cte("activity", ("change_log",), """
  SELECT *, CAST(row_number() OVER (ORDER BY created_at, event_id) AS BIGINT) AS running_count FROM change_log""")

# ------------------------------------------------------------ D6 notes
cte("notes_src", (), """
  SELECT conv_id * 100 + turn AS note_id, conv_id % 30 AS franchise_id,
         CASE turn % 6 WHEN 0 THEN 'retention_plan' WHEN 1 THEN 'auction_targets' WHEN 2 THEN 'playing_xi'
              WHEN 3 THEN 'scouting' WHEN 4 THEN 'general' ELSE 'unlisted_type' END AS note_type,
         CASE WHEN conv_id % 17 = 0 THEN '  ' ELSE text END AS content,
         role AS created_by
  FROM conversations""")
cte("notes_valid", ("notes_src", "franchises"), """
  SELECT n.note_id, n.franchise_id,
         CASE WHEN n.note_type IN ('retention_plan', 'auction_targets', 'playing_xi', 'scouting', 'general')
              THEN n.note_type ELSE 'general' END AS note_type,
         CASE WHEN NOT (n.content IS NULL OR length(trim(n.content)) = 0) THEN trim(n.content) END AS content,
         CAST(length(n.content) AS INTEGER) AS chars, n.created_by,
         NOT (n.content IS NULL OR length(trim(n.content)) = 0)
           AND NOT (n.franchise_id IS NOT NULL AND f.franchise_id IS NULL) AS accepted,
         CASE WHEN n.content IS NULL OR length(trim(n.content)) = 0 THEN 'empty note content'
              WHEN n.franchise_id IS NOT NULL AND f.franchise_id IS NULL THEN 'unknown franchise' END AS reason
  FROM notes_src n LEFT JOIN franchises f ON f.franchise_id = n.franchise_id""")
cte("notes_latest", ("notes_valid", "franchises"), """
  SELECT n.note_id, n.note_type, n.content, n.created_by, f.name AS franchise_name
  FROM notes_valid n LEFT JOIN franchises f ON f.franchise_id = n.franchise_id
  WHERE n.accepted ORDER BY n.note_id DESC LIMIT 20""")
cte("notes_audit", ("notes_valid",), """
  SELECT note_id, 'data_change' AS event_type, 'strategy_notes' AS table_name, 'save_strategy_note' AS tool_name,
         franchise_id,
         json_object('note_id', note_id, 'note_type', note_type, 'chars', chars)::VARCHAR AS payload,
         'success' AS result_status
  FROM notes_valid WHERE accepted""")

# ------------------------------------------------------------ D5 articles
cte("articles", (), """
  SELECT concat('r', CAST((page_id + k) % 150 AS VARCHAR)) AS player_key,
         url, html AS content, CAST(page_id % 100 AS DOUBLE) / 100 AS score,
         DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS ingested_on
  FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 10 AS k) x
  WHERE k = 0 OR page_id % 10 = 0""")
cte("article_ids", ("articles",), """
  SELECT player_key, url, score, ingested_on, CAST(length(content) AS INTEGER) AS content_chars,
         sha256(concat_ws('|', player_key, url)) AS article_id
  FROM (SELECT *, row_number() OVER (PARTITION BY sha256(concat_ws('|', player_key, url))
                                     ORDER BY ingested_on DESC, score DESC) AS rn FROM articles) t
  WHERE rn = 1""")
cte("shortlist", ("batter_profile", "bowler_profile"), """
  SELECT player_key, min(player_name) AS player_name FROM (
    (SELECT batter_key AS player_key, player_name FROM batter_profile
     ORDER BY recent_innings DESC, batter_key LIMIT 100)
    UNION ALL
    (SELECT batter_key, player_name FROM batter_profile WHERE recent_balls_faced >= 60
     ORDER BY regressed_strike_rate DESC, batter_key LIMIT 75)
    UNION ALL
    (SELECT bowler_key, player_name FROM bowler_profile ORDER BY recent_innings DESC, bowler_key LIMIT 100)
    UNION ALL
    (SELECT bowler_key, player_name FROM bowler_profile WHERE recent_balls_bowled >= 60
     ORDER BY regressed_economy ASC, bowler_key LIMIT 75)) u
  GROUP BY player_key""")
cte("refresh", ("shortlist", "articles"), """
  SELECT s.* FROM shortlist s
  WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.player_key = s.player_key
                    AND a.ingested_on >= DATE '2024-01-30' - INTERVAL 7 DAY)""")
cte("freshness", ("articles",), """
  SELECT player_key, count(*) AS articles, max(ingested_on) AS last_fetched FROM articles
  GROUP BY 1 ORDER BY last_fetched DESC, articles DESC, player_key LIMIT 20""")
cte("cited", (), """
  SELECT conv_id, turn, concat_ws(' ', text, url, concat('(', url, ')')) AS text
  FROM conversations LEFT JOIN pages ON page_id = conv_id""")
cte("urls", ("cited",), """
  SELECT conv_id * 100 + turn AS msg_id, CAST(i - 1 AS INTEGER) AS pos, u AS url FROM (
    SELECT conv_id, turn,
           unnest(regexp_extract_all(text, '(href="|\\()?(https?://[^\\s<>")\\]]+)', 1)) AS g,
           unnest(regexp_extract_all(text, '(href="|\\()?(https?://[^\\s<>")\\]]+)', 2)) AS u,
           unnest(generate_series(1, len(regexp_extract_all(text, '(href="|\\()?(https?://[^\\s<>")\\]]+)', 2))))
             AS i
    FROM cited) t
  WHERE coalesce(g, '') = ''""")

# ------------------------------------------------------------ vectors
cte("centroid_dims", (), """
  SELECT label, dim, avg(x) AS x FROM (
    SELECT label, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS dim,
           CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) t
  GROUP BY 1, 2""")
cte("vec_dims", (), """
  SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""")
cte("similar_vecs", ("centroid_dims", "vec_dims"), f"""
  SELECT label, vec_id, {r('s', 6)} AS score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS BIGINT) AS rank FROM (
      SELECT c.label, v.vec_id, sum(v.x * c.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(c.x * c.x))) AS s
      FROM vec_dims v JOIN centroid_dims c ON c.dim = v.dim GROUP BY 1, 2) a) b
  WHERE rank <= 5""")

# ------------------------------------------------------------ quality
cte("kind_hist", ("d1",), """
  SELECT wicket_kind AS dismissal_kind, count(*) AS dismissals FROM d1 WHERE is_wicket GROUP BY 1""")
cte("volume", ("d1",), f"""
  SELECT competition, count(DISTINCT match_id) AS matches, count(*) AS deliveries,
         {r('count(*) * 1.0 / count(DISTINCT match_id)', 1)} AS avg_deliveries_per_match
  FROM d1 GROUP BY 1""")
cte("coverage", ("d1",), f"""
  SELECT competition, count(*) AS deliveries, count(batter_id) AS deliveries_with_batter_id,
         {r('count(batter_id) * 100.0 / count(*)')} AS batter_id_coverage_pct
  FROM d1 GROUP BY 1""")

# ------------------------------------------------------------ boards
cte("top_recent_economy", ("bowl_recent",), """
  SELECT bowler_key, player_name, innings, balls_bowled, economy, regressed_economy FROM bowl_recent
  ORDER BY regressed_economy ASC, bowler_key LIMIT 10""")
cte("death_specialists", ("bat_phase",), """
  SELECT batter_key, player_name, balls_faced, strike_rate FROM bat_phase WHERE phase = 'death'
  ORDER BY strike_rate DESC, batter_key LIMIT 10""")
cte("genuine_allrounders", ("allround",), """
  SELECT * FROM allround WHERE bowling_involvement_pct >= 40 ORDER BY runs DESC, player_key LIMIT 10""")
cte("name_board", ("batter_profile",), """
  SELECT batter_key, player_name, recent_innings, recent_strike_rate, usual_batting_position, likely_keeper_signal
  FROM batter_profile WHERE contains(lower(player_name), 'surname1')""")
cte("radar", ("batter_profile",), """
  SELECT batter_key, player_name,
         [coalesce(powerplay_sr, 0.0), coalesce(middle_sr, 0.0), coalesce(death_sr, 0.0), coalesce(chase_sr, 0.0),
          CASE WHEN coalesce(finisher_pct, 0.0) <= 1 THEN coalesce(finisher_pct, 0.0) * 100
               ELSE finisher_pct END] AS radar
  FROM batter_profile""")


# ------------------------------------------------------------ bronze -> silver round trip
cte("roundtrip", ("d1",), """
  SELECT match_id, competition, CAST(innings_seq AS INTEGER) AS innings_seq, over_number, delivery_seq,
         batting_team, batter, batter_id, bowler, bowler_id, runs_batter,
         runs_batter + extras_wides + extras_noballs + extras_byes + extras_legbyes AS runs_total,
         CAST(extras_wides AS BIGINT) AS extras_wides, CAST(extras_noballs AS BIGINT) AS extras_noballs,
         CAST(extras_byes AS BIGINT) AS extras_byes, CAST(extras_legbyes AS BIGINT) AS extras_legbyes,
         is_wicket, wicket_kind, in_powerplay, innings_target_runs
  FROM d1""")
cte("silver_matches", ("d1",), """
  SELECT match_id, max(competition) AS competition, max(match_date) AS start_date, max(match_date) AS end_date,
         1 AS num_days, max(season) AS season, max(venue) AS venue, max(team_1) AS team_1, max(team_2) AS team_2,
         max(outcome_by_runs) AS outcome_by_runs, max(outcome_by_wickets) AS outcome_by_wickets,
         max(event_stage) AS event_stage, max(match_type) AS match_type,
         CAST(count(DISTINCT innings_seq) AS INTEGER) AS num_innings
  FROM d1 GROUP BY match_id""")


# ------------------------------------------------------------ table maintenance
cte("cfg_src", (), """
  SELECT CAST(r_regionkey AS BIGINT) AS franchise_id, r_name AS name, CAST(125 AS DECIMAL(10,2)) AS purse_total_cr,
         CAST(50 + r_regionkey AS DECIMAL(10,2)) AS purse_remaining_cr, 25 AS max_squad_size, 8 AS max_overseas,
         concat('Venue ', CAST(r_regionkey AS VARCHAR)) AS home_venue, true AS is_active
  FROM region
  UNION ALL
  SELECT CAST(100 + r_regionkey AS BIGINT), concat(r_name, ' XI'), CAST(125 AS DECIMAL(10,2)),
         CAST(125 AS DECIMAL(10,2)), 25, 8, NULL, true
  FROM region""")
cte("config_upsert", ("franchises", "cfg_src"), """
  SELECT * FROM franchises WHERE franchise_id NOT IN (SELECT franchise_id FROM cfg_src)
  UNION ALL SELECT * FROM cfg_src""")
cte("pool_candidates", ("roster",), """
  SELECT 1000000 + roster_id AS pool_id, 1000000 + roster_id AS sr_no, player_name, 'Unknown' AS country,
         CAST(NULL AS BIGINT) AS age, role, 'uncapped' AS capped_status, bowling_style, is_overseas,
         CAST(30 AS DECIMAL(10,2)) AS base_price_lakh, true AS is_current_reference
  FROM roster""")
cte("insert_absent", ("pool", "pool_candidates"), """
  SELECT * FROM pool
  UNION ALL
  SELECT * FROM pool_candidates c WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.player_name = c.player_name)""")
cte("rules_v", (), """
  SELECT CAST(r_regionkey AS BIGINT) AS rule_version, CAST(100 + 5 * r_regionkey AS DECIMAL(10,2)) AS max_purse_cr,
         25 AS max_squad_size, 8 AS max_overseas_players,
         r_regionkey = (SELECT max(r_regionkey) FROM region) AS is_current
  FROM region""")
cte("flip_current", ("rules_v",), """
  SELECT rule_version, max_purse_cr, max_squad_size, max_overseas_players, false AS is_current FROM rules_v
  UNION ALL
  SELECT max(rule_version) + 1, CAST(125 AS DECIMAL(10,2)), 25, 8, true FROM rules_v""")
cte("partition_replace", ("roster", "franchises"), """
  SELECT * FROM roster WHERE franchise_id NOT IN (SELECT franchise_id FROM franchises WHERE NOT is_active)
  UNION ALL
  SELECT roster_id, franchise_id, player_name, role, bowling_style, is_overseas, acquisition_type, price_cr,
         'released' AS status
  FROM roster WHERE franchise_id IN (SELECT franchise_id FROM franchises WHERE NOT is_active)""")
cte("backfill", ("articles",), """
  SELECT player_key, url, ingested_on, sha256(concat_ws('|', player_key, url)) AS article_id FROM articles""")
cte("roster_new", ("roster",), """
  SELECT r.roster_id, r.franchise_id, r.player_name, r.role, r.bowling_style, r.is_overseas, r.acquisition_type,
         r.price_cr, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'released' ELSE r.status END AS status
  FROM roster r JOIN customer c ON c.c_custkey = r.roster_id
  WHERE c.c_acctbal >= 0
  UNION ALL
  SELECT 1000000 + s_suppkey, CAST(s_nationkey AS BIGINT), s_name, 'batter', 'na', false, 'auction',
         CAST(1 AS DECIMAL(10,2)), 'active'
  FROM supplier""")
cte("snapshot_diff", ("roster", "roster_new"), """
  SELECT n.*, CASE WHEN o.roster_id IS NULL THEN 'insert' ELSE 'update' END AS change_type
  FROM roster_new n LEFT JOIN roster o ON o.roster_id = n.roster_id
  WHERE o.roster_id IS NULL OR o.status IS DISTINCT FROM n.status
  UNION ALL
  SELECT o.*, 'delete' FROM roster o WHERE o.roster_id NOT IN (SELECT roster_id FROM roster_new)""")
cte("cf_src", ("roster",), """
  SELECT r.roster_id, r.franchise_id, upper(r.player_name) AS player_name, r.role, r.bowling_style, r.is_overseas,
         r.acquisition_type, CAST(r.price_cr + 1 AS DECIMAL(10,2)) AS price_cr, r.status
  FROM roster r JOIN customer c ON c.c_custkey = r.roster_id WHERE c.c_mktsegment = 'MACHINERY'
  UNION ALL
  SELECT NULL, CAST(s_nationkey AS BIGINT), s_name, 'bowler', 'pace', false, 'auction', CAST(2 AS DECIMAL(10,2)),
         'active'
  FROM supplier""")
cte("case_folded_upsert", ("roster", "cf_src"), """
  SELECT count(*) FILTER (WHERE r.roster_id IS NULL) AS inserted, count(*) FILTER (WHERE r.roster_id IS NOT NULL)
         AS updated
  FROM cf_src s LEFT JOIN roster r
    ON r.franchise_id = s.franchise_id AND lower(r.player_name) = lower(s.player_name)
   AND r.acquisition_type = s.acquisition_type AND r.status = s.status""")


# ------------------------------------------------------------ coverage additions
def gold_hit(name: str, prof: str) -> str:
    """B7 membership: exact (case-sensitive) name, or exactly one distinct
    name with the surname, or with surname + initial."""
    return f"""(length(trim({name})) > 0 AND (
      {name} IN (SELECT player_name FROM {prof})
      OR (SELECT count(DISTINCT player_name) FROM {prof} q WHERE {sur('q.player_name')} = {sur(name)}) = 1
      OR (SELECT count(DISTINCT player_name) FROM {prof} q WHERE {sur('q.player_name')} = {sur(name)}
            AND {ini('q.player_name')} = substring(string_split_regex(lower(trim({name})), '\\s+')[1], 1, 1)) = 1))"""


cte("role_inf", ("roster", "pool", "batter_profile", "bowler_profile"), f"""
  SELECT roster_id, franchise_id, player_name,
         CASE WHEN prole IS NOT NULL THEN prole WHEN hb AND hw THEN 'all-rounder' WHEN hw THEN 'bowler'
              ELSE 'batter' END AS inferred_role,
         CASE WHEN prole IS NOT NULL THEN pstyle WHEN hw AND NOT hb THEN 'pace' ELSE 'na' END AS inferred_bowling_style,
         CASE WHEN prole IS NOT NULL THEN 'player_pool' WHEN hb AND hw THEN 'gold (bat+bowl)'
              WHEN hw THEN 'gold (bowl only)' WHEN hb THEN 'gold (bat only)' ELSE 'default' END AS role_source,
         prole IS NULL AND NOT hb AND NOT hw AS needs_review
  FROM (
    SELECT r.roster_id, r.franchise_id, r.player_name, p.prole, p.pstyle,
           coalesce({gold_hit('r.player_name', 'batter_profile')}, false) AS hb,
           coalesce({gold_hit('r.player_name', 'bowler_profile')}, false) AS hw
    FROM roster r
    LEFT JOIN (SELECT lower(player_name) AS l, arg_min(role, pool_id) AS prole,
                      arg_min(bowling_style, pool_id) AS pstyle FROM pool
               WHERE is_current_reference GROUP BY 1) p ON p.l = lower(r.player_name)) t""")
cte("universe_names", ("batter_profile", "bowler_profile", "pool"), """
  SELECT DISTINCT player_name FROM (
    SELECT player_name FROM batter_profile UNION ALL SELECT player_name FROM bowler_profile
    UNION ALL SELECT player_name FROM pool WHERE is_current_reference) u""")
cte("universe_bat", ("universe_names", "batter_profile"),
    resolve_sql("universe_names", "player_name", "batter_profile", "batter_key", "bat_k"))
cte("universe_both", ("universe_bat", "bowler_profile"),
    resolve_sql("universe_bat", "player_name", "bowler_profile", "bowler_key", "bowl_k"))
cte("universe", ("universe_both", "pool"), """
  SELECT player_name,
         lower(player_name) IN (SELECT lower(player_name) FROM pool WHERE is_current_reference) AS in_pool,
         CASE WHEN bat_k IS NOT NULL AND bowl_k IS NOT NULL THEN 'all-rounder'
              WHEN bowl_k IS NOT NULL THEN 'bowler' ELSE 'batter' END AS role_read
  FROM universe_both""")
cte("lookup_bat", ("pool", "batter_profile"), search_sql("pool", "pool_id", "player_name", "batter_profile",
                                                         "batter_key", 3))
cte("lookup_bowl", ("pool", "bowler_profile"), search_sql("pool", "pool_id", "player_name", "bowler_profile",
                                                          "bowler_key", 3))
cte("lookup_merged", ("lookup_bat", "lookup_bowl", "batter_profile", "bowler_profile"), """
  SELECT coalesce(b.pool_id, w.pool_id) AS pool_id, coalesce(b.batter_key, w.bowler_key) AS player_key,
         coalesce(b.player_name, w.player_name) AS player_name,
         bp.recent_innings AS bat_recent_innings, bp.recent_strike_rate AS bat_recent_strike_rate,
         bp.regressed_strike_rate AS bat_regressed_strike_rate,
         wp.recent_innings AS bowl_recent_innings, wp.recent_economy AS bowl_recent_economy,
         wp.recent_wickets AS bowl_recent_wickets, wp.bowler_type AS bowl_bowler_type
  FROM lookup_bat b
  FULL OUTER JOIN lookup_bowl w ON b.pool_id = w.pool_id AND b.batter_key = w.bowler_key
  LEFT JOIN batter_profile bp ON bp.batter_key = b.batter_key
  LEFT JOIN bowler_profile wp ON wp.bowler_key = w.bowler_key""")
cte("player_lookup", ("lookup_merged",), """
  SELECT *, count(*) OVER (PARTITION BY pool_id) AS match_count,
         count(*) OVER (PARTITION BY pool_id) > 1 AS is_ambiguous
  FROM lookup_merged""")
cte("recent_vs_career", ("batter_profile",), """
  SELECT batter_key, player_name, recent_strike_rate, career_strike_rate FROM batter_profile""")
cte("role_map", ("bowler_profile",), """
  SELECT bowler_key, player_name, economy_percentile, strike_rate_percentile, bowler_type FROM bowler_profile
  WHERE economy_percentile IS NOT NULL AND strike_rate_percentile IS NOT NULL""")
cte("partition_rows", ("d1",), """
  SELECT competition, count(DISTINCT match_id) AS matches FROM d1 GROUP BY 1""")
cte("current_rules", ("flip_current",), "SELECT * FROM flip_current WHERE is_current")
cte("activity_feed", ("change_log", "franchises"), """
  SELECT c.event_id, f.name AS franchise_name, c.result_status,
         array_to_string(list_transform(string_split(replace(c.tool_name, '_', ' '), ' '),
                         lambda x: upper(x[1]) || lower(x[2:])), ' ') AS tool_label,
         strftime(c.created_at, '%b %d, %H:%M') AS time_label
  FROM change_log c LEFT JOIN franchises f ON f.franchise_id = c.franchise_id
  ORDER BY c.event_id DESC LIMIT 25""")
cte("message_text", (), """
  SELECT conv_id, turn, concat_ws(' ', text, role) AS message FROM conversations""")
cte("index_terms", ("articles",), """
  SELECT article_id, player_key, url, term, count(*) AS tf FROM (
    SELECT article_id, player_key, url,
           unnest(list_filter(regexp_split_to_array(lower(content), '\\W+'), lambda x: x <> '')) AS term
    FROM (SELECT sha256(concat_ws('|', player_key, url)) AS article_id, player_key, url, content,
                 row_number() OVER (PARTITION BY concat_ws('|', player_key, url) ORDER BY ingested_on DESC, score DESC) AS rn
          FROM articles) a WHERE rn = 1) t GROUP BY 1, 2, 3, 4""")
cte("index_refresh", ("index_terms",), """
  SELECT article_id, player_key, url, count(*) AS terms,
         md5(string_agg(concat(term, ':', CAST(weight AS VARCHAR)), ',' ORDER BY term)) AS vector_md5
  FROM (SELECT *, CAST(floor(1000000 * tf / sqrt(sum(tf * tf) OVER (PARTITION BY article_id))) AS BIGINT) AS weight
        FROM index_terms) t GROUP BY 1, 2, 3""")
cte("bowler_roles", ("bowler_profile",), "SELECT bowler_type, count(*) AS bowlers FROM bowler_profile GROUP BY 1")
cte("top_activity", ("batter_profile",), """
  SELECT batter_key, player_name, recent_innings FROM batter_profile
  ORDER BY recent_innings DESC, batter_key LIMIT 100""")
cte("top_quality", ("bowler_profile",), """
  SELECT bowler_key, player_name, recent_balls_bowled, regressed_economy FROM bowler_profile
  WHERE recent_balls_bowled >= 60 ORDER BY regressed_economy ASC, bowler_key LIMIT 75""")


# ------------------------------------------------------------ T5 ledger (recursive, per auction in bid order)
cte("ledger_in", ("bid_ctx",), """
  SELECT bid_id, auction_id, franchise_id, pool_id, price_cr, player_name, franchise_known, player_known,
         coalesce(is_overseas, false) AS is_overseas, base_price_cr, purse_remaining_cr, max_squad_size,
         max_overseas, squad_size, overseas_count, coalesce(owned, false) AS owned,
         CAST(round(price_cr * 100) AS BIGINT) AS price_c, CAST(round(purse_remaining_cr * 100) AS BIGINT) AS purse_c,
         row_number() OVER (PARTITION BY auction_id ORDER BY bid_id) AS rn
  FROM bid_ctx""")

_LEDGER_STEP = """
    SELECT auction_id, rn, bid_id, franchise_id, pool_id, price_cr, player_name, accepted, result_status,
           purse_after_cr,
           CASE WHEN accepted THEN map_concat(sp, MAP([franchise_id], [spent_f + price_c])) ELSE sp END AS sp,
           CASE WHEN accepted THEN map_concat(bo, MAP([franchise_id], [bought_f + 1])) ELSE bo END AS bo,
           CASE WHEN accepted THEN map_concat(ov, MAP([franchise_id],
                                                       [os_f + CASE WHEN is_overseas THEN 1 ELSE 0 END]))
                ELSE ov END AS ov,
           CASE WHEN accepted THEN list_append(own, lower(player_name)) ELSE own END AS own
    FROM (
      SELECT y.*,
             franchise_known AND player_known AND reasons = '' AS accepted,
             CASE WHEN NOT franchise_known THEN 'blocked: unknown franchise'
                  WHEN NOT player_known THEN 'blocked: unknown player'
                  WHEN reasons = '' THEN 'success' ELSE concat('blocked: ', reasons) END AS result_status,
             CASE WHEN NOT franchise_known OR NOT player_known THEN NULL
                  WHEN reasons = '' THEN (purse_c - spent_f - price_c) / 100.0
                  ELSE (purse_c - spent_f) / 100.0 END AS purse_after_cr
      FROM (
        SELECT x.*, concat_ws('; ',
                 CASE WHEN owned OR list_contains(own, lower(player_name)) THEN 'already on an active roster' END,
                 CASE WHEN price_c > purse_c - spent_f THEN 'bid exceeds remaining purse' END,
                 CASE WHEN squad_size + bought_f >= max_squad_size THEN 'squad at max size' END,
                 CASE WHEN is_overseas AND overseas_count + os_f >= max_overseas THEN 'overseas cap reached' END,
                 CASE WHEN price_cr < base_price_cr THEN 'bid below base price' END) AS reasons
        FROM (
          SELECT z.*, coalesce(sp[franchise_id], 0) AS spent_f, coalesce(bo[franchise_id], 0) AS bought_f,
                 coalesce(ov[franchise_id], 0) AS os_f
          FROM {src} z) x) y) w"""

_LEDGER_FIRST = """(SELECT i.*, MAP()::MAP(BIGINT, BIGINT) AS sp, MAP()::MAP(BIGINT, BIGINT) AS bo,
                          MAP()::MAP(BIGINT, BIGINT) AS ov, []::VARCHAR[] AS own
                   FROM ledger_in i WHERE i.rn = 1)"""
_LEDGER_NEXT = """(SELECT i.*, r.sp, r.bo, r.ov, r.own
                   FROM ledger_rec r JOIN ledger_in i ON i.auction_id = r.auction_id AND i.rn = r.rn + 1)"""

cte("ledger_rec", ("ledger_in",),
    _LEDGER_STEP.format(src=_LEDGER_FIRST) + "\n  UNION ALL\n" + _LEDGER_STEP.format(src=_LEDGER_NEXT))
cte("bid_ledger", ("ledger_rec",), """
  SELECT bid_id, auction_id, franchise_id, pool_id, price_cr, player_name, accepted, result_status, purse_after_cr
  FROM ledger_rec""")
cte("bid_effects", ("bid_ledger",), """
  SELECT bid_id, auction_id, CASE WHEN accepted THEN 'data_change' ELSE 'tool_call' END AS event_type,
         'franchise_roster' AS table_name, 'execute_player_bid' AS tool_name, franchise_id,
         CASE WHEN player_name IS NULL THEN json_object('franchise_id', franchise_id, 'price_cr', price_cr)
              ELSE json_object('franchise_id', franchise_id, 'player_name', player_name, 'price_cr', price_cr)
         END::VARCHAR AS payload,
         result_status
  FROM bid_ledger""")
cte("bid_roster_rows", ("bid_ledger",), """
  SELECT auction_id, franchise_id, player_name, price_cr, 'auction' AS acquisition_type, 'active' AS status
  FROM bid_ledger WHERE accepted""")
cte("bid_purse", ("bid_ledger", "franchises"), f"""
  SELECT auction_id, franchise_id, spent_cr, players_bought, purse_before_cr,
         {r("purse_before_cr - spent_cr")} AS purse_after_cr
  FROM (SELECT auction_id, franchise_id, {r("sum(price_cr)")} AS spent_cr, count(*) AS players_bought
        FROM bid_ledger WHERE accepted GROUP BY 1, 2) s
  JOIN (SELECT franchise_id, CAST(purse_remaining_cr AS DOUBLE) AS purse_before_cr FROM franchises) f USING (franchise_id)""")
cte("quality_report", ("kind_hist", "volume", "coverage"), """
  SELECT 'dismissal_kind' AS check_name, dismissal_kind AS subject, CAST(dismissals AS DOUBLE) AS value FROM kind_hist
  UNION ALL SELECT 'matches', competition, CAST(matches AS DOUBLE) FROM volume
  UNION ALL SELECT 'deliveries', competition, CAST(deliveries AS DOUBLE) FROM volume
  UNION ALL SELECT 'avg_deliveries_per_match', competition, avg_deliveries_per_match FROM volume
  UNION ALL SELECT 'batter_id_coverage_pct', competition, batter_id_coverage_pct FROM coverage""")


def text_topk_sql(docs: str, doc_id: str, doc_text: str, queries: str, qid: str, qtext: str, k: int = 5) -> str:
    """B21 + B22 over every pair: CTEs ``ranked (qid, id, points, rank)``."""
    def tf(src, key, text):
        return f"""SELECT id, term, count(*) AS tf FROM (
    SELECT {key} AS id, unnest(list_filter(regexp_split_to_array(lower({text}), '\\W+'), lambda x: x <> '')) AS term
    FROM {src} WHERE {key} IS NOT NULL) t GROUP BY 1, 2"""

    def impact(src):
        return f"""SELECT id, term, CAST(floor(1000000 * (tf * idf) / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)))
    AS BIGINT) AS impact FROM {src}"""

    return f"""
dtf AS ({tf(docs, doc_id, doc_text)}),
qtf AS ({tf(queries, qid, qtext)}),
dsize AS (SELECT count(DISTINCT {doc_id}) AS n FROM {docs}),
dfs AS (SELECT term, count(*) AS df FROM dtf GROUP BY 1),
dw AS ({impact("(SELECT d.*, ln(CAST(n + 1 AS DOUBLE) / (df + 1)) AS idf FROM dtf d JOIN dfs USING (term), dsize)")}),
qw AS ({impact("(SELECT q.*, ln(CAST(n + 1 AS DOUBLE) / (coalesce(df, 0) + 1)) AS idf FROM qtf q LEFT JOIN dfs USING (term), dsize)")}),
points AS (SELECT q.id AS qid, d.id, sum(q.impact * d.impact) AS points
           FROM qw q JOIN dw d USING (term) WHERE q.impact > 0 AND d.impact > 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY points DESC, id) AS rank FROM points
           QUALIFY rank <= {k})"""


SCORE = "CAST((points + 500000) // 1000000 AS DOUBLE) / 1000000.0"
TEXT_EMBED_TOPK = "WITH " + text_topk_sql("documents", "doc_id", "text", "benchmark", "item_id", "text") + f"""
SELECT qid AS item_id, id AS doc_id, {SCORE} AS score, rank FROM ranked"""

cte("bodies", ("articles",), """
  SELECT article_id, player_key, title, url, concat_ws(' ', player_key, title, plain) AS body FROM (
    SELECT sha256(concat_ws('|', player_key, url)) AS article_id, player_key, url,
           coalesce(regexp_extract(content, '(?is)<title>(.*?)</title>', 1), '') AS title,
           regexp_replace(content, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<title\\b.*?</title>|<[^>]*>', ' ', 'g') AS plain,
           row_number() OVER (PARTITION BY concat_ws('|', player_key, url) ORDER BY ingested_on DESC, score DESC) AS rn
    FROM articles) t WHERE rn = 1""")
cte("asked", (), """
  SELECT item_id, concat_ws(': ', concat('r', CAST(item_id % 150 AS VARCHAR)), text) AS question FROM benchmark""")
NEWS_SEARCH = with_ctes(["bodies", "asked"], "") + "," + text_topk_sql(
    "bodies", "article_id", "body", "asked", "item_id", "question") + f"""
SELECT qid AS item_id, rank, {SCORE} AS score, player_key, title, url FROM ranked JOIN bodies ON id = article_id"""

# ------------------------------------------------------------ T6 rolling figures
_LAST = "(PARTITION BY batter_key ORDER BY match_date, match_id, innings_seq ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
cte("rolling_batting", ("bat",), f"""
  SELECT *, {rate("runs_last_5", "balls_last_5", "100")} AS strike_rate_last_5,
         {rate("runs_last_10", "balls_last_10", "100")} AS strike_rate_last_10
  FROM (SELECT batter_key, match_id, innings_seq, runs, balls_faced,
               row_number() OVER (PARTITION BY batter_key ORDER BY match_date, match_id, innings_seq) AS innings_no,
               CAST(sum(runs) OVER {_LAST.format(4)} AS BIGINT) AS runs_last_5,
               CAST(sum(balls_faced) OVER {_LAST.format(4)} AS BIGINT) AS balls_last_5,
               CAST(sum(runs) OVER {_LAST.format(9)} AS BIGINT) AS runs_last_10,
               CAST(sum(balls_faced) OVER {_LAST.format(9)} AS BIGINT) AS balls_last_10 FROM bat) t""")
cte("bid_trajectory", ("bids",), f"""
  SELECT bid_id, auction_id, pool_id, price_cr, bid_no,
         {r("cents / least(bid_no, 5) / 100.0", 4)} AS mean_price_last_5
  FROM (SELECT *, row_number() OVER (PARTITION BY auction_id, pool_id ORDER BY bid_id) AS bid_no,
               CAST(sum(CAST(round(price_cr * 100) AS BIGINT)) OVER (PARTITION BY auction_id, pool_id ORDER BY bid_id
                    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS cents FROM bids) t""")
cte("purse_burn_down", ("bid_ledger",), """
  SELECT auction_id, franchise_id, bid_id,
         row_number() OVER (PARTITION BY auction_id, franchise_id ORDER BY bid_id) AS purchase_no, price_cr, purse_after_cr
  FROM bid_ledger WHERE accepted""")
