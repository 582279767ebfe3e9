"""SQL for the registered queries, written by other means than the Spark plans where it can be:
islands instead of a fold, unnested ranges instead of array predicates, plain range joins
instead of tiles."""

from __future__ import annotations

from checks.queries import CLUSTER_ZOOMS, SIGN_QUERIES, SPOT_QUERIES
from kerbside.functions import text_ranges as words
from kerbside.functions.grid import Grid
from kerbside.operators.clusters import RADIUS
from kerbside.operators.radius_clusters import SEED
from kerbside.sources import star_schema as inputs


def _list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def _double(value) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def _description(key: str) -> str:
    first, second = f"(({key} * 5) % 24)", f"(({key} * 11 + 3) % 24)"
    minutes = f"{_list(inputs.MINUTES)}[({key} // 3) % {len(inputs.MINUTES)} + 1]"
    return f"""CASE WHEN {key} % 53 <> 7 THEN
        {_list(inputs.MARKERS)}[{key} % {len(inputs.MARKERS)} + 1]
        || CASE ({key} // 7) % {inputs.HOUR_FORMS}
             WHEN 1 THEN {first} || 'h-' || {second} || 'h'
             WHEN 2 THEN lpad({first}::VARCHAR, 2, '0') || 'h30-' || {second} || 'h'
             WHEN 3 THEN {first} || 'h' || {minutes} || '-' || {second} || 'h' || {minutes}
             WHEN 4 THEN '07h-19h CLIGNOTANT 22h-07h FIXE'
             WHEN 5 THEN {first} || 'H-' || {second} || 'H'
             WHEN 6 THEN 'EN TOUT TEMPS'
             WHEN 7 THEN lpad({first}::VARCHAR, 2, '0') || 'h-' || lpad({second}::VARCHAR, 2, '0')
                         || 'h' || {minutes} || ' 13h-15h30'
             ELSE '' END
        || ' ' || {_list(inputs.DAYS)}[({key} // 3) % {len(inputs.DAYS)} + 1]
        || ' ' || {_list(inputs.MONTHS)}[({key} // 11) % {len(inputs.MONTHS)} + 1]
        || {_list(inputs.SUFFIXES)}[({key} // 13) % {len(inputs.SUFFIXES)} + 1] END"""


# Inputs

_LON = f"((l_orderkey * 7919 + l_linenumber * 101) % {inputs.LON_SPAN})"
_LAT = f"((l_suppkey * 4801 + l_orderkey) % {inputs.LAT_SPAN})"


def _lon(offset: str) -> str:
    return f"({offset} - {inputs.LON_UNITS}) / 100000"


def _lat(offset: str) -> str:
    return f"({offset} + {inputs.LAT_UNITS}) / 100000"


RAW_SIGNS = f"""raw_signs AS (
  SELECT CASE WHEN l_orderkey % 97 <> 0 THEN 'C' || l_partkey END AS code_rpa,
         {_description('l_partkey')} AS description,
         CASE WHEN l_orderkey % 89 <> 1 THEN {_lon(_LON)} END AS longitude,
         {_lat(_LAT)} AS latitude,
         CASE WHEN l_suppkey % 19 <> 0 THEN 'Arrondissement ' || (l_suppkey % 19) END AS arrondissement,
         (l_linenumber % 4)::VARCHAR AS fleche
  FROM lineitem)"""

CODES = RAW_SIGNS + """,
codes AS (
  SELECT *, row_number() OVER (ORDER BY code_rpa, description NULLS FIRST) - 1 AS code_id,
         CASE WHEN left(ltrim(coalesce(raw, '')), 2) = '\\P' THEN 'permitted'
              WHEN left(ltrim(coalesce(raw, '')), 2) = '\\A' THEN 'prohibited'
              ELSE 'other' END AS category,
         coalesce(raw ILIKE '%reserve%', false) AS is_reserved
  FROM (SELECT DISTINCT code_rpa, coalesce(description, '') AS description, description AS raw
        FROM raw_signs WHERE code_rpa IS NOT NULL))"""


def _hours(ignore_case: bool) -> str:
    letter = "[hH]" if ignore_case else "h"

    def number(part: int) -> str:
        side = f"lower(split_part(span, '-', {part}))"
        minutes = f"split_part({side}, 'h', 2)"
        return (
            f"CAST(split_part({side}, 'h', 1) AS DOUBLE) + CASE WHEN {minutes} = '' THEN 0 "
            f"ELSE CAST({minutes} AS DOUBLE) / 60 END"
        )

    return f"""code_hours AS (
  SELECT code_rpa, pos, {number(1)} AS s, {number(2)} AS e
  FROM (SELECT code_rpa, unnest(spans) AS span, unnest(range(len(spans))) AS pos
        FROM (SELECT code_rpa, regexp_extract_all(description,
                '\\d{{1,2}}{letter}\\d{{0,2}}-\\d{{1,2}}{letter}\\d{{0,2}}') AS spans FROM codes)))"""


_WORDS = {
    **{w: ("m", n) for w, n in {**words.MONTH_NAMES, **words.MONTH_ABBREVIATIONS}.items()},
    **{w: ("d", n) for w, n in {**words.DAY_NAMES, **words.DAY_ABBREVIATIONS}.items()},
    "a": ("c", 0),
    "au": ("c", 0),
}
_WORD_ROWS = ", ".join(f"('{w}', '{kind}', {n})" for w, (kind, n) in _WORDS.items())

DAYS_MONTHS = f"""
vocabulary(word, kind, n) AS (VALUES {_WORD_ROWS}),
found AS (
  SELECT code_rpa, unnest(list) AS word, unnest(range(len(list))) AS i
  FROM (SELECT code_rpa, regexp_extract_all(lower(description),
          '\\b({"|".join([*_WORDS, "et"])})\\b') AS list FROM codes)),
valued AS (
  SELECT code_rpa, i, kind, n, lag(kind) OVER (PARTITION BY code_rpa ORDER BY i) AS before
  FROM found JOIN vocabulary USING (word)),
opened AS (
  SELECT *, CASE WHEN before = 'c' AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS opens
  FROM valued WHERE kind <> 'c' WINDOW w AS (PARTITION BY code_rpa, kind ORDER BY i)),
islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY code_rpa, kind ORDER BY i) - 1 AS pos FROM opened),
day_month AS (
  SELECT code_rpa, kind, pos::BIGINT AS pos, arg_min(n, i)::BIGINT AS s, arg_max(n, i)::BIGINT AS e,
         count(*) AS members
  FROM islands GROUP BY ALL),
code_days AS (SELECT * FROM day_month WHERE kind = 'd'),
code_months AS (SELECT * FROM day_month WHERE kind = 'm')"""

PARSED = CODES + ",\n" + _hours(False) + "," + DAYS_MONTHS


def _cell(longitude: str, latitude: str) -> str:
    grid = Grid()
    tiles = 1 << grid.max_level

    def index(value: str, low: float, high: float) -> str:
        scaled = f"({value} - {_double(low)}) / {_double(high - low)} * {_double(tiles)}"
        return f"least(greatest(floor({scaled})::BIGINT, 0), {tiles - 1})"

    column = index(longitude, grid.bounds[0], grid.bounds[2])
    row = index(latitude, grid.bounds[1], grid.bounds[3])
    bits = [f"((({column}) >> {i}) & 1) * {1 << (2 * i)}" for i in range(grid.max_level)]
    bits += [f"((({row}) >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(grid.max_level)]
    return " + ".join(bits)


SIGNS = f"""signs AS (
  SELECT row_number() OVER (ORDER BY cell, longitude, latitude, code_id,
           arrondissement NULLS FIRST, fleche NULLS FIRST) - 1 AS sign_id, *
  FROM (SELECT r.longitude, r.latitude, r.arrondissement, r.fleche, c.code_id, c.code_rpa,
               c.category, c.is_reserved, c.description,
               {_cell('r.longitude', 'r.latitude')} AS cell
        FROM raw_signs r JOIN codes c ON r.code_rpa = c.code_rpa WHERE r.longitude IS NOT NULL))"""

PERIODS = """periods AS (
  SELECT p_partkey::VARCHAR AS nid,
         lpad(((p_size * 7 + p_partkey) % 24)::VARCHAR, 2, '0') || ':' || half || ':00' AS start_time,
         CASE WHEN p_partkey % 10 = 3 THEN '23:59:59'
              ELSE lpad(((p_size * 3 + p_partkey * 5) % 24)::VARCHAR, 2, '0') || ':' || half || ':00'
         END AS end_time,
         p_partkey % 128 AS weekday_mask, 'R' || (p_partkey // 4) AS code, p_name AS description
  FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '00' ELSE '30' END AS half FROM part)),
timed AS (
  SELECT *, date_part('hour', start_time::TIME) + date_part('minute', start_time::TIME) / 60 AS start_hour,
            date_part('hour', end_time::TIME) + date_part('minute', end_time::TIME) / 60 AS end_hour,
            date_part('hour', start_time::TIME) + date_part('minute', start_time::TIME) / 60
              + floor(date_part('second', start_time::TIME)) / 3600 AS start_exact,
            date_part('hour', end_time::TIME) + date_part('minute', end_time::TIME) / 60
              + floor(date_part('second', end_time::TIME)) / 3600 AS end_exact
  FROM periods)"""

SPANS = """spans AS (
  SELECT mask, min(d) AS s, max(d) AS e
  FROM (SELECT mask, d, d - row_number() OVER (PARTITION BY mask ORDER BY d) AS island
        FROM (SELECT unnest(range(128)) AS mask) CROSS JOIN (SELECT unnest(range(1, 8)) AS d)
        WHERE (mask >> (d - 1)::INT) & 1 = 1)
  GROUP BY mask, island)"""

LINKS = PERIODS + """,
place_links AS (
  SELECT o_custkey::VARCHAR AS place_id,
         CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE 'R' END || (o_orderkey // 30) AS code
  FROM orders),
links AS (SELECT l.place_id, t.* FROM place_links l JOIN timed t ON l.code = t.code)"""

PLACES = f"""places AS (
  SELECT c_custkey::VARCHAR AS place_id,
         {_lon(f'((c_custkey * 7919) % {inputs.LON_SPAN})')} AS longitude,
         {_lat(f'((c_custkey * 4801) % {inputs.LAT_SPAN})')} AS latitude,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0
              THEN CAST(((c_custkey * 37) % 600 // 100) || '.'
                        || lpad(((c_custkey * 37) % 600 % 100)::VARCHAR, 2, '0') AS DOUBLE)
         END AS tariff_hourly,
         c_mktsegment AS spot_type,
         CASE WHEN c_nationkey <> 0 THEN 'Rue <' || c_nationkey || '> & Cie' END AS street
  FROM customer WHERE c_custkey % 101 <> 50)"""

_BOX_SIZE = f"{inputs.BOX_SIZES}[event_id % 3 + 1]"
_WEST = f"((user_id * 7919 + event_id * 13) % {inputs.LON_SPAN})"
_SOUTH = f"((event_id * 4801) % {inputs.LAT_SPAN})"
QUERY_ROWS = f"""moments AS (
  SELECT event_id, user_id, (epoch_us(ts) // 1000 % 86400000) / 3600000 AS hour,
         isodow(ts) AS day, month(ts) AS month, hour(ts) AS whole_hour
  FROM events),
queries AS (
  SELECT event_id AS query_id,
         {_lon(_WEST)} AS min_lon, {_lat(_SOUTH)} AS min_lat,
         {_lon(f'({_WEST} + {_BOX_SIZE})')} AS max_lon, {_lat(f'({_SOUTH} + {_BOX_SIZE})')} AS max_lat,
         CASE WHEN event_id % 14 <> 0 THEN hour END AS hour_start,
         CASE WHEN event_id % 7 <> 0 THEN CASE WHEN hour >= 23 THEN hour - 23 ELSE hour + 1 END END AS hour_end,
         CASE WHEN event_id % 8 <> 0 THEN day END AS day_start,
         CASE WHEN event_id % 8 <> 0 THEN day END AS day_end,
         CASE WHEN event_id % 2 = 0 THEN month END AS month_start,
         CASE WHEN event_id % 2 = 0 THEN month END AS month_end,
         CASE WHEN event_id % 40 = 7 THEN []
              WHEN event_id % 4 = 1 THEN ['permitted', 'prohibited']
              WHEN event_id % 4 = 2 THEN ['permitted', 'prohibited', 'other']
              ELSE ['permitted'] END AS categories,
         CASE event_id % 5 WHEN 1 THEN true WHEN 2 THEN false END AS reserved,
         event_id % 6 = 0 AS not_in_range
  FROM moments)"""


# Predicates


def within(qs: str, qe: str, ps: str, pe: str, base: str, strict: bool = False) -> str:
    """The containment table, one case per combination of wrapping."""
    if strict:
        turn = f"CASE WHEN {qs} < {ps} THEN {base} ELSE 0 END"
        last = f"{qs} + {turn} >= {ps} AND {qe} + {turn} <= {pe} + {base}"
    else:
        last = (
            f"(CASE WHEN {qs} < {ps} THEN {qs} + {base} ELSE {qs} END) >= {ps} AND "
            f"(CASE WHEN {qe} < {ps} THEN {qe} + {base} ELSE {qe} END) <= {pe} + {base}"
        )
    return f"""(CASE WHEN {pe} >= {ps} AND {qe} >= {qs} THEN {qs} >= {ps} AND {qe} <= {pe}
      WHEN {pe} >= {ps} THEN {qs} >= {ps} AND {qe} + {base} <= {pe}
      WHEN {qe} < {qs} THEN {qs} >= {ps} AND {qe} <= {pe}
      ELSE {last} END)"""


_DIMENSIONS = (("hour", "code_hours", 24), ("day", "code_days", 7), ("month", "code_months", 12))


def _in_force(ends: dict[str, tuple[str, str]], code: str, strict: bool) -> str:
    tests = ["true"]
    for name, ranges, base in _DIMENSIONS:
        if name in ends:
            qs, qe = ends[name]
            inside = within(qs, qe, "r.s", "r.e", str(base), strict)
            tests.append(
                f"({qs} IS NULL OR {qe} IS NULL"
                f" OR NOT EXISTS (SELECT 1 FROM {ranges} r WHERE r.code_rpa = {code})"
                f" OR EXISTS (SELECT 1 FROM {ranges} r WHERE r.code_rpa = {code} AND {inside}))"
            )
    return " AND ".join(tests)


def _all_pass(ends: dict[str, tuple[str, str]], code: str, negate: str) -> str:
    any_range = " OR ".join(
        f"EXISTS (SELECT 1 FROM {ranges} r WHERE r.code_rpa = {code})" for _, ranges, _ in _DIMENSIONS
    )
    tests = [f"({any_range})"]
    for name, ranges, base in _DIMENSIONS:
        if name in ends:
            qs, qe = ends[name]
            inside = within(qs, qe, "r.s", "r.e", str(base))
            chained = "" if name == "hour" else "r.members > 2 OR "
            tests.append(
                f"({qs} IS NULL OR {qe} IS NULL OR NOT EXISTS (SELECT 1 FROM {ranges} r"
                f" WHERE r.code_rpa = {code} AND ({chained}{inside} = {negate})))"
            )
    return " AND ".join(tests)


def _literal_ends(asked) -> dict[str, tuple[str, str]]:
    pairs = {"hour": asked.hour, "day": asked.day, "month": asked.month}
    return {
        name: (_double(pair[0]), _double(pair[1]))
        for name, pair in pairs.items()
        if pair is not None and None not in pair
    }


def _in_box(box, prefix: str = "") -> str:
    west, south, east, north = (_double(v) for v in box)
    return (
        f"{prefix}longitude BETWEEN {west} AND {east} AND {prefix}latitude BETWEEN {south} AND {north}"
    )


def _sign_rows(name: str) -> str:
    """FROM ... WHERE of a single sign query over the CTEs."""
    asked, options = SIGN_QUERIES[name]
    ends = _literal_ends(asked)
    negate = "true" if asked.not_in_range else "false"
    if options.get("mode") == "all":
        passed = _all_pass(ends, "s.code_rpa", negate)
    else:
        passed = f"({_in_force(ends, 's.code_rpa', options.get('strict', False))}) <> {negate}"
    tests = [_in_box(asked.bbox, "s."), passed]
    if asked.categories is not None:
        tests.append(f"list_contains({_list(asked.categories)}::VARCHAR[], s.category)")
    if asked.reserved is not None:
        tests.append(f"s.is_reserved = {str(asked.reserved).lower()}")
    if "regex" in options:
        # Without lookahead: the marker first, and no reservation after it on any line.
        tests.append("s.description ILIKE '\\P_%' ESCAPE ''" if "RESERVE" in options["regex"]
                     else "s.description ILIKE '\\P%' ESCAPE ''")
        if "RESERVE" in options["regex"]:
            tests.append("s.description NOT ILIKE '%reserve%'")
    return "FROM signs s WHERE " + " AND ".join(tests)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_SIGN_COLUMNS = "sign_id, longitude, latitude, category, is_reserved, arrondissement, description"
_ALL_SIGNS = _with(PARSED, SIGNS)
_COLUMN_ENDS = {
    name: (f"q.{name}_start", f"q.{name}_end") for name in ("hour", "day", "month")
}
_BOX_MATCH = (
    "s.longitude BETWEEN q.min_lon AND q.max_lon AND s.latitude BETWEEN q.min_lat AND q.max_lat"
)


def _batch_pairs(passed: str, queries: str = "queries") -> str:
    return f"""FROM (SELECT q.*, s.* FROM {queries} q JOIN signs s ON {_BOX_MATCH}
        AND list_contains(q.categories, s.category)
        AND (q.reserved IS NULL OR q.reserved = s.is_reserved)) q WHERE {passed}"""


_BATCH_ANY = f"({_in_force(_COLUMN_ENDS, 'q.code_rpa', False)}) <> q.not_in_range"


def _paid(hour: tuple[str, str], day: tuple[str, str], place: str) -> str:
    """Whether some period covers the window."""
    in_hours = within(*hour, "t.start_hour", "t.end_hour", "24")
    in_days = within(*day, "d.s", "d.e", "7")
    return f"""EXISTS (SELECT 1 FROM links t JOIN spans d ON d.mask = t.weekday_mask
        WHERE t.place_id = {place} AND {in_hours} AND {in_days})"""


_SPOT_COLUMNS = "place_id, longitude, latitude, tariff_hourly, spot_type, street"
_PERIOD_TEXT = "texts AS (SELECT DISTINCT place_id, description FROM links)"
_LABELS = """labels AS (
  SELECT place_id, coalesce(string_agg(label, ' | ' ORDER BY label), '') AS label
  FROM (SELECT DISTINCT place_id, CASE WHEN weekday_mask > 0 THEN
          array_to_string(list_filter(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'],
            lambda x, i: (weekday_mask >> (i - 1)::INT) & 1 = 1), ',')
          || ': ' || start_time || '-' || end_time END AS label FROM links)
  GROUP BY place_id)"""
_ALL_SPOTS = _with(LINKS, SPANS, PLACES, _PERIOD_TEXT)


def _answered_spots(name: str) -> str:
    asked = SPOT_QUERIES[name]
    ends = _literal_ends(asked)
    free = "true"
    if "hour" in ends and "day" in ends:
        free = f"NOT {_paid(ends['hour'], ends['day'], 'p.place_id')}"
    return f"(SELECT p.*, {free} AS is_currently_free FROM places p WHERE {_in_box(asked.bbox, 'p.')})"


def _described_spots(name: str) -> str:
    return f"{_answered_spots(name)} LEFT JOIN texts USING (place_id)"


# Saved filters

def _saved_filters() -> str:
    def piece(condition: str, *texts: str) -> str:
        return f"CASE WHEN {condition} THEN {' || '.join(texts)} END"

    k, h = "event_id", "whole_hour"
    pieces = [
        piece(f"{k} % 3 <> 0", "'signs=1'"),
        piece(f"{k} % 3 = 1", "'spots=1'"),
        piece(f"{k} % 9 = 3", "'spots=0'"),
        piece(f"{k} % 4 = 1", "'cat=permitted%2Cprohibited'"),
        piece(f"{k} % 4 = 2", "'cat=other'"),
        piece(f"{k} % 16 = 3", "'cat='"),
        piece(f"{k} % 5 = 1", "'reserved=1'"),
        piece(f"{k} % 5 = 2", "'reserved=0'"),
        piece(f"{k} % 7 = 1", "'hour='", h, "'-'", f"(({h} + 2) % 24)"),
        piece(f"{k} % 7 = 2", "'hour='", h, "'.5-'", f"(({h} + 5) % 24)", "'.25'"),
        piece(f"{k} % 7 = 3", "'hour='", h),
        piece(f"{k} % 7 = 4", "'hour=abc-'", h),
        piece(f"{k} % 7 = 5", "'hour=+'", h, "'+-%20'", f"(({h} + 3) % 24)"),
        piece(f"{k} % 8 = 1", "'day=1-5'"),
        piece(f"{k} % 8 = 2", "'day=6-7-3'"),
        piece(f"{k} % 8 = 3", "'day=1.5-2'"),
        piece(f"{k} % 6 = 1", "'month=4-12'"),
        piece(f"{k} % 6 = 2", "'month=-3'"),
        piece(f"{k} % 10 = 1", "'not=1'"),
        piece(f"{k} % 10 = 2", "'not=true'"),
        piece(f"{k} % 12 = 5", "'signs=0'"),
    ]

    def value(name: str) -> str:
        found = f"regexp_extract(qs, '(?:^|[?&]){name}=([^&]*)', 1)"
        return f"url_decode(replace({found}, '+', ' '))"

    def end(name: str, part: int) -> str:
        text = f"trim(split_part({value(name)}, '-', {part}))"
        return (
            f"CASE WHEN contains({value(name)}, '-') THEN "
            f"CASE WHEN {text} = '' THEN 0 ELSE TRY_CAST({text} AS DOUBLE) END END"
        )

    ranges = ", ".join(
        f"{end(name, 1)} AS {name}_a, {end(name, 2)} AS {name}_b" for name in ("hour", "day", "month")
    )
    both = ", ".join(
        f"CASE WHEN {n}_b IS NOT NULL THEN {n}_a END AS {n}_start, "
        f"CASE WHEN {n}_a IS NOT NULL THEN {n}_b END AS {n}_end"
        for n in ("hour", "day", "month")
    )
    return f"""strings AS (
  SELECT event_id AS query_id, CASE WHEN event_id % 2 = 0 THEN '?' ELSE '' END
         || concat_ws('&', {", ".join(pieces)}) AS qs FROM moments),
fields AS (
  SELECT query_id, {value('signs')} = '1' AS show_signs, {value('spots')} = '1' AS show_spots,
         CASE WHEN {value('cat')} = '' THEN ['permitted'] ELSE split({value('cat')}, ',') END AS categories,
         CASE WHEN contains(qs, 'reserved=') THEN {value('reserved')} = '1' END AS reserved,
         {ranges}, {value('not')} = '1' AS not_in_range
  FROM strings),
filters AS (
  SELECT query_id, show_signs, show_spots, categories, reserved, {both}, not_in_range FROM fields),
whole AS (
  SELECT f.*, q.min_lon, q.min_lat, q.max_lon, q.max_lat
  FROM filters f JOIN queries q USING (query_id)
  WHERE (f.day_start IS NULL OR f.day_start = floor(f.day_start))
    AND (f.day_end IS NULL OR f.day_end = floor(f.day_end))
    AND (f.month_start IS NULL OR f.month_start = floor(f.month_start))
    AND (f.month_end IS NULL OR f.month_end = floor(f.month_end)))"""


_FILTERS = QUERY_ROWS + ",\n" + _saved_filters()


def _encoded() -> str:
    def plain(column: str) -> str:
        return (
            f"CASE WHEN {column} = floor({column}) THEN {column}::BIGINT::VARCHAR "
            f"ELSE {column}::VARCHAR END"
        )

    ends = ", ".join(
        f"'{n}=' || {plain(n + '_start')} || '-' || {plain(n + '_end')}" for n in ("hour", "day", "month")
    )
    return f"""concat_ws('&', CASE WHEN show_signs THEN 'signs=1' END,
      CASE WHEN show_spots THEN 'spots=1' END,
      'cat=' || array_to_string(categories, '%2C'),
      CASE reserved WHEN true THEN 'reserved=1' WHEN false THEN 'reserved=0' END,
      {ends}, CASE WHEN not_in_range THEN 'not=1' END)"""


# Output


def _cluster(source: str, zooms) -> str:
    angle = "radians(latitude)"
    parts = []
    for zoom in zooms:
        if zoom >= 17:
            parts.append(
                f"SELECT {zoom}::INT AS zoom, NULL::BIGINT AS cell_x, NULL::BIGINT AS cell_y, "
                f"1::BIGINT AS n_points, longitude, latitude FROM {source}"
            )
            continue
        world = 256.0 * 2**zoom
        mercator = f"ln((1 + sin({angle})) / (1 - sin({angle}))) / 2"
        parts.append(f"""SELECT {zoom}::INT AS zoom,
          floor((longitude + 180) / 360 * {world} / 50)::BIGINT AS cell_x,
          floor((0.5 - {mercator} / (2 * pi())) * {world} / 50)::BIGINT AS cell_y,
          count(*)::BIGINT AS n_points,
          sum(round(longitude * {_double(1e7)})::HUGEINT)::DOUBLE / count(*) / {_double(1e7)} AS longitude,
          sum(round(latitude * {_double(1e7)})::HUGEINT)::DOUBLE / count(*) / {_double(1e7)} AS latitude
          FROM {source} GROUP BY ALL""")
    return "\nUNION ALL\n".join(
        f"SELECT zoom, cell_x, cell_y, n_points, longitude, latitude FROM ({p})" for p in parts
    )


def _radius_clusters(source: str, id_column: str, zooms) -> str:
    """Rounds over all undecided points: those that come before every undecided one around them are centres.
    Squares as wide as the radius serve only to find the points around."""
    parts, below = [], f"SELECT {id_column}::BIGINT AS id, longitude, latitude, 1 AS n FROM {source}"
    for zoom in range(16, min(zooms) - 1, -1):
        world, angle = 256.0 * 2**zoom, "radians(latitude)"
        mercator = f"ln((1 + sin({angle})) / (1 - sin({angle}))) / 2"
        parts.append(f"""
pixels{zoom} AS (
  SELECT *, md5('{SEED}:' || id) AS mark, (longitude + 180) / 360 * {world} AS x,
         (0.5 - {mercator} / (2 * pi())) * {world} AS y,
         floor((longitude + 180) / 360 * {world} / {RADIUS}) AS cx,
         floor((0.5 - {mercator} / (2 * pi())) * {world} / {RADIUS}) AS cy
  FROM ({below})),
around{zoom} AS (
  SELECT a.id, b.id AS other, (b.mark, b.id) < (a.mark, a.id) AS earlier, b.mark AS other_mark
  FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM pixels{zoom}) a
  JOIN pixels{zoom} b ON a.cx + a.dx = b.cx AND b.cy BETWEEN a.cy - 1 AND a.cy + 1
   AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS * RADIUS}
  WHERE a.id <> b.id),
rounds{zoom} AS (
  SELECT id, false AS centre FROM pixels{zoom}
  UNION ALL
  (WITH undecided AS (SELECT id FROM rounds{zoom} WHERE NOT centre),
        held AS (SELECT r.id, r.other, r.earlier FROM around{zoom} r
                 JOIN undecided u ON u.id = r.id JOIN undecided v ON v.id = r.other),
        chosen AS (SELECT id FROM undecided WHERE id NOT IN (SELECT id FROM held WHERE earlier)),
        gone AS (SELECT h.id FROM held h JOIN chosen c ON c.id = h.other)
   SELECT id, true FROM chosen
   UNION ALL
   SELECT id, false FROM undecided
   WHERE id NOT IN (SELECT id FROM chosen) AND id NOT IN (SELECT id FROM gone))),
owners{zoom} AS (
  SELECT p.id, p.n, CASE WHEN c.id IS NOT NULL THEN p.id ELSE near.owner END AS owner
  FROM pixels{zoom} p LEFT JOIN (SELECT id FROM rounds{zoom} WHERE centre) c ON c.id = p.id
  LEFT JOIN (SELECT r.id, arg_min(r.other, (r.other_mark, r.other)) AS owner
             FROM around{zoom} r JOIN rounds{zoom} s ON s.id = r.other AND s.centre GROUP BY r.id) near
    ON near.id = p.id),
level{zoom} AS (
  SELECT o.owner AS id, p.longitude, p.latitude, sum(o.n)::BIGINT AS n, count(*) AS n_members
  FROM owners{zoom} o JOIN pixels{zoom} p ON p.id = o.owner GROUP BY ALL)""")
        below = f"SELECT id, longitude, latitude, n FROM level{zoom}"
    chosen = "\nUNION ALL\n".join(
        f"SELECT {z}::INT AS zoom, id AS centre_id, longitude, latitude, n AS n_points, n_members FROM level{z}"
        for z in zooms
    )
    return ",".join(parts) + "\n" + chosen


def _signatures(passed: str) -> str:
    """Distinct time signatures of the saved filters, each with its codes."""
    ends = ", ".join(
        f"CASE WHEN {n}_start IS NOT NULL AND {n}_end IS NOT NULL THEN {n}_{e} END::{kind} AS {n}_{e}"
        for n, kind in (("hour", "DOUBLE"), ("day", "BIGINT"), ("month", "BIGINT"))
        for e in ("start", "end")
    )
    names = [f"q.{n}_{e}" for n in ("hour", "day", "month") for e in ("start", "end")]
    return f"""SELECT {', '.join(names)}, q.not_in_range, s.code_id
        FROM (SELECT DISTINCT {ends}, not_in_range FROM whole WHERE show_signs) q, codes s WHERE {passed}"""


def _json_text(column: str) -> str:
    return f"coalesce(to_json({column})::VARCHAR, 'null')"


def _feature(properties: str) -> str:
    return (
        "'{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' "
        "|| longitude::VARCHAR || ',' || latitude::VARCHAR || ']},\"properties\":{' || "
        + properties + " || '}}'"
    )


def _properties(*names: str) -> str:
    return " || ',' || ".join(f"'\"{n}\":' || {_json_text(n)}" for n in names)


_SIGN_FEATURE = _feature(
    _properties("sign_id", "category", "is_reserved", "arrondissement", "description")
)

def _escape(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def oracles() -> dict[str, str]:
    hours = "SELECT code_rpa, pos, s AS start_hour, e AS end_hour FROM code_hours"
    ranges = "SELECT code_rpa, pos, s AS range_start, e AS range_end, members FROM "
    matrix_base = "[24, 7, 12][l_linenumber % 3 + 1]"
    result = {
        "codes_hour_ranges": _with(CODES, _hours(False)) + hours,
        "hour_ranges_ignore_case": _with(CODES, _hours(True)) + hours,
        "hour_ranges_exploded": _with(CODES, _hours(False))
        + """SELECT c.code_rpa, c.description, h.s AS start_hour, h.e AS end_hour
             FROM codes c LEFT JOIN code_hours h USING (code_rpa)""",
        "codes_day_ranges": _with(PARSED) + ranges + "code_days",
        "codes_month_ranges": _with(PARSED) + ranges + "code_months",
        "codes_classify": _with(PARSED)
        + """SELECT code_rpa, description, category, is_reserved,
               EXISTS (SELECT 1 FROM code_days d WHERE d.code_rpa = c.code_rpa AND members > 2) AS chained_days,
               EXISTS (SELECT 1 FROM code_months m WHERE m.code_rpa = c.code_rpa AND members > 2) AS chained_months
             FROM codes c""",
        "codes_dictionary": _with(CODES)
        + "SELECT code_id, code_rpa, raw AS description FROM codes",
        "signs_curated": _ALL_SIGNS
        + """SELECT sign_id, longitude, latitude, arrondissement, fleche, code_id, category,
               is_reserved FROM signs""",
        "signs_report": _ALL_SIGNS
        + "SELECT category, count(*) AS n_signs FROM signs GROUP BY category ORDER BY category",
        "quality_report": _with(PARSED, SIGNS, LINKS, PLACES)
        + """SELECT 'codes' AS measure, count(*) AS n FROM codes
             UNION ALL SELECT 'signs', count(*) FROM signs
             UNION ALL SELECT 'reserved_signs', count(*) FROM signs WHERE is_reserved
             UNION ALL SELECT category || '_signs', count(*) FROM signs GROUP BY category
             UNION ALL SELECT 'spots', count(*) FROM places
             UNION ALL SELECT 'spots_with_periods', count(*) FROM places
               WHERE place_id IN (SELECT place_id FROM links)
             UNION ALL SELECT 'incomplete_periods', 0""",
        "period_scalars": _with(PERIODS)
        + """SELECT nid AS "nID", start_hour, end_hour, start_exact, end_exact, weekday_mask FROM timed""",
        "mask_day_ranges": _with(PERIODS, SPANS)
        + """SELECT nid AS "nID", weekday_mask, row_number() OVER (PARTITION BY nid ORDER BY s) - 1 AS pos,
               s AS start_day, e AS end_day FROM periods JOIN spans ON mask = weekday_mask""",
        "spot_periods": _with(LINKS)
        + """SELECT place_id, min(nid::BIGINT) AS first_period, start_time, end_time, start_hour, end_hour,
               weekday_mask, description, count(*) AS n_links
             FROM links GROUP BY ALL""",
        "spots_curated": _with(LINKS, PLACES)
        + f"""SELECT {_SPOT_COLUMNS}, start_hour, end_hour, weekday_mask, description, n_links
              FROM places LEFT JOIN (SELECT place_id, start_time, end_time, start_hour, end_hour,
                weekday_mask, description, count(*) AS n_links FROM links GROUP BY ALL) USING (place_id)""",
        "spots_split": _with(LINKS, PLACES)
        + f"""SELECT {_SPOT_COLUMNS}, start_hour, end_hour, weekday_mask, description, n_links,
                1::BIGINT AS n_first
              FROM places LEFT JOIN (SELECT place_id, start_time, end_time, start_hour, end_hour,
                weekday_mask, description, count(*) AS n_links FROM links GROUP BY ALL) USING (place_id)""",
        "via_regulations": _with(LINKS, PLACES)
        + """SELECT place_id, longitude, latitude, start_exact AS start_hour, end_exact AS end_hour,
               weekday_mask, description, count(*) AS n_links
             FROM links JOIN places USING (place_id)
             JOIN (SELECT DISTINCT 'R' || (p_partkey // 4) AS name FROM part
                   WHERE (p_partkey // 4) % 7 <> 0) ON name = code
             GROUP BY ALL""",
        "csv_read": _with(RAW_SIGNS)
        + """SELECT code_rpa AS "CODE_RPA", description AS "DESCRIPTION_RPA",
               printf('%.5f', longitude) AS "Longitude", printf('%.5f', latitude) AS "Latitude",
               arrondissement AS "NOM_ARROND", fleche AS "FLECHE_PAN" FROM raw_signs""",
        "interval_matrix": f"""
          WITH axes AS (SELECT {matrix_base} AS base, l_orderkey % 25 AS qs, l_partkey % 25 AS qe,
            l_suppkey % 25 AS ps, (l_orderkey + l_partkey + l_linenumber) % 25 AS pe FROM lineitem)
          SELECT base, qs, qe, ps, pe, count(*) AS n_rows,
                 {within('qs', 'qe', 'ps', 'pe', 'base')} AS is_within,
                 {within('qs', 'qe', 'ps', 'pe', 'base', strict=True)} AS is_within_strict
          FROM axes GROUP BY base, qs, qe, ps, pe""",
        "moment_query": _with(QUERY_ROWS) + "SELECT event_id, hour, day, month FROM moments",
        "spot_query_paid": _ALL_SPOTS
        + f"""SELECT place_id, longitude, latitude FROM {_answered_spots('spot_query_free')}
              WHERE NOT is_currently_free""",
        "spot_labels": _with(LINKS, _LABELS) + "SELECT place_id, label FROM labels",
        "batch_sign_query": _with(PARSED, SIGNS, QUERY_ROWS)
        + "SELECT query_id, sign_id, category, is_reserved, description " + _batch_pairs(_BATCH_ANY),
        "batch_sign_query_all_mode": _with(PARSED, SIGNS, QUERY_ROWS)
        + "SELECT query_id, sign_id "
        + _batch_pairs(_all_pass(_COLUMN_ENDS, "q.code_rpa", "q.not_in_range")),
        "batch_spot_query": _with(LINKS, SPANS, PLACES, _PERIOD_TEXT, QUERY_ROWS)
        + f"""SELECT query_id, {_SPOT_COLUMNS}, description,
                hour_start IS NULL OR hour_end IS NULL OR day_start IS NULL OR day_end IS NULL
                OR NOT {_paid(_COLUMN_ENDS['hour'], _COLUMN_ENDS['day'], 'q.place_id')} AS is_currently_free
              FROM (SELECT q.*, s.* FROM queries q JOIN places s ON {_BOX_MATCH}) q
              LEFT JOIN texts USING (place_id)""",
        "batch_split_spots": _with(LINKS, SPANS, PLACES, _PERIOD_TEXT, QUERY_ROWS)
        + f"""SELECT query_id, {_SPOT_COLUMNS}, description,
                hour_start IS NULL OR hour_end IS NULL OR day_start IS NULL OR day_end IS NULL
                OR NOT {_paid(_COLUMN_ENDS['hour'], _COLUMN_ENDS['day'], 'q.place_id')} AS is_currently_free
              FROM (SELECT q.*, s.* FROM queries q JOIN places s ON {_BOX_MATCH}) q
              LEFT JOIN texts USING (place_id)""",
        "filter_decode": _with(_FILTERS)
        + "SELECT * REPLACE (array_to_string(categories, '|') AS categories) FROM filters",
        "filter_encode": _with(_FILTERS) + f"SELECT query_id, {_encoded()} AS query_string FROM filters",
        "filter_sign_query": _with(PARSED, SIGNS, _FILTERS)
        + "SELECT query_id, sign_id "
        + _batch_pairs(_BATCH_ANY, "(SELECT * FROM whole WHERE show_signs)"),
        "filter_spot_query": _with(LINKS, SPANS, PLACES, _FILTERS)
        + f"""SELECT query_id, place_id, hour_start IS NULL OR day_start IS NULL
                OR NOT {_paid(_COLUMN_ENDS['hour'], _COLUMN_ENDS['day'], 'q.place_id')} AS is_currently_free
              FROM (SELECT q.*, s.* FROM (SELECT * FROM whole WHERE show_spots) q
                    JOIN places s ON {_BOX_MATCH}) q""",
        "signature_codes": _with(PARSED, _FILTERS)
        + _signatures(f"({_in_force(_COLUMN_ENDS, 's.code_rpa', False)}) <> q.not_in_range"),
        "signature_codes_strict": _with(PARSED, _FILTERS)
        + _signatures(f"({_in_force(_COLUMN_ENDS, 's.code_rpa', True)}) <> q.not_in_range"),
        "signature_codes_all_mode": _with(PARSED, _FILTERS)
        + _signatures(_all_pass(_COLUMN_ENDS, "s.code_rpa", "q.not_in_range")),
        "cluster_radius": "WITH RECURSIVE " + PLACES + "," + _radius_clusters("places", "place_id", CLUSTER_ZOOMS),
        "cluster_grid": _ALL_SIGNS + _cluster("signs", (10, 13, 16)),
        "cluster_spots": _with(PLACES) + _cluster("places", (12, 17)),
        "geojson_features": _ALL_SIGNS
        + f"SELECT sign_id, {_SIGN_FEATURE} AS feature " + _sign_rows("sign_query_time"),
        "geojson_spot_features": _ALL_SPOTS
        + f"SELECT {_SPOT_COLUMNS}, is_currently_free, description FROM {_described_spots('spot_query_free')}",
        "geojson_split_spots": _ALL_SPOTS
        + f"SELECT {_SPOT_COLUMNS}, is_currently_free, description FROM {_described_spots('spot_query_free')}",
        "geojson_document": _ALL_SIGNS + f"SELECT {_SIGN_COLUMNS} " + _sign_rows("sign_query_time"),
        "geojson_read": _ALL_SIGNS + f"SELECT {_SIGN_COLUMNS} " + _sign_rows("sign_query_reserved"),
        "feature_collections": _with(PARSED, SIGNS, QUERY_ROWS)
        + f"SELECT {_SIGN_COLUMNS} {_batch_pairs(_BATCH_ANY)}",
        "feature_collections_split": _with(PARSED, SIGNS, QUERY_ROWS)
        + f"SELECT {_SIGN_COLUMNS} {_batch_pairs(_BATCH_ANY)}",
        "filter_rejected": _with(_FILTERS)
        + """SELECT query_id, 'fractional day or month' AS reason FROM filters
             WHERE coalesce(day_start <> floor(day_start), false) OR coalesce(day_end <> floor(day_end), false)
                OR coalesce(month_start <> floor(month_start), false)
                OR coalesce(month_end <> floor(month_end), false)
             UNION ALL SELECT query_id, 'unknown category' FROM filters
             WHERE NOT list_has_all(['permitted', 'prohibited', 'other'], categories)""",
        "sign_display": _ALL_SIGNS
        + f"""SELECT sign_id, CASE category WHEN 'permitted' THEN '#2563eb' WHEN 'prohibited'
                THEN '#dc2626' ELSE '#9ca3af' END AS color,
                '<b class="capitalize">' || category || '</b><br>' || {_escape('description')} AS popup
              {_sign_rows('sign_query_all_dimensions')}""",
        "marker_layers": _with(PARSED, SIGNS, LINKS, SPANS, PLACES, _LABELS)
        + "SELECT 'sign' AS kind, latitude, longitude, description AS label "
        + _sign_rows("sign_query_view")
        + f""" UNION ALL
             SELECT CASE WHEN is_currently_free THEN 'free' ELSE 'paid' END, latitude, longitude,
               coalesce(label, '')
             FROM {_answered_spots('spot_query_view')} LEFT JOIN labels USING (place_id)""",
        "marker_layers_not": _ALL_SIGNS
        + "SELECT 'sign' AS kind, latitude, longitude, description AS label "
        + _sign_rows("sign_query_view_not"),
        "spot_display": _ALL_SPOTS
        + f"""SELECT place_id, CASE WHEN is_currently_free THEN '#16a34a' ELSE '#f59e0b' END AS color,
                '<b>' || CASE WHEN is_currently_free THEN 'Free now' ELSE 'Paid now' END || '</b>'
                || coalesce('<br>' || {_escape('street')}, '')
                || '<hr>' || coalesce({_escape('description')} || '<br>', '') || '&lt;&gt;' AS popup
              FROM {_described_spots('spot_query_free')}""",
        "result_cap": _with(PARSED, SIGNS, LINKS, SPANS, PLACES, _PERIOD_TEXT)
        + f"""SELECT n_signs, n_paid, n_free, n_signs + n_paid + n_free AS total,
                n_signs + n_paid + n_free > 1000 AS refused
              FROM (SELECT count(*) AS n_signs {_sign_rows('sign_query_all_dimensions')}),
                   (SELECT count(*) FILTER (WHERE NOT is_currently_free) AS n_paid,
                           count(*) FILTER (WHERE is_currently_free) AS n_free
                    FROM {_answered_spots('spot_query_free')})""",
    }
    result["place_changes"] = result["place_changes_stream"] = _with(LINKS, SPANS, PLACES) + f"""
        SELECT place_id, at_us, is_free
        FROM (SELECT *, lag(is_free) OVER (PARTITION BY place_id ORDER BY at_us) AS before
              FROM (SELECT DISTINCT e.place_id, epoch_us(ts) AS at_us, NOT {_paid(('hour', 'hour'), ('day', 'day'), 'e.place_id')}
                      AS is_free
                    FROM (SELECT *, (user_id + 1)::VARCHAR AS place_id, isodow(ts) AS day,
                                 (epoch_us(ts) // 1000 % 86400000) / 3600000 AS hour FROM events) e
                    JOIN places p ON p.place_id = e.place_id))
        WHERE before IS NULL OR before <> is_free"""
    result["filter_sign_query_indexed"] = result["filter_sign_query"]
    for name in SIGN_QUERIES:
        result[name] = _ALL_SIGNS + f"SELECT {_SIGN_COLUMNS} " + _sign_rows(name)
    for name in SPOT_QUERIES:
        result[name] = _ALL_SPOTS + (
            f"SELECT {_SPOT_COLUMNS}, is_currently_free, description FROM {_described_spots(name)}"
        )
    return result
