"""The registered queries in SQL, written independently of the DataFrame plans."""

from __future__ import annotations

import re

from hourloom import schema as S

TRAIN_END, VAL_END = "TIMESTAMP '2024-01-22'", "TIMESTAMP '2024-01-27'"
LO = "(SELECT date_trunc('day', min(ts)) FROM events)"
HI = "(SELECT date_trunc('day', max(ts)) + INTERVAL 23 HOUR FROM events)"
TZ = "'America/New_York'"
HOLIDAYS = "(DATE '2024-01-01', DATE '2024-01-15')"

# Common tables, in an order in which each uses only earlier ones.
COMMON = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k
        FROM events""",
    "trips": """
        SELECT CAST(event_id AS VARCHAR) AS ride_id, event_id AS n, ts AS started_at,
               CAST(user_id AS VARCHAR) AS station_id,
               CASE WHEN user_id % 50 = 0 AND ts >= TIMESTAMP '2024-01-20'
                    THEN c_name || ' (moved)' ELSE c_name END AS station_name,
               CAST(k % 7 AS DOUBLE) AS start_lat, CAST(k % 5 AS DOUBLE) AS start_lng
        FROM ev LEFT JOIN customer ON user_id = c_custkey""",
    "counts": """
        SELECT station_id, date_trunc('hour', started_at) AS datetime, count(*) AS departures
        FROM trips GROUP BY 1, 2""",
    "coords": """
        SELECT station_id, station_name, 'lat' AS axis, start_lat AS v, count(*) AS n
        FROM trips GROUP BY ALL
        UNION ALL
        SELECT station_id, station_name, 'lng', start_lng, count(*) FROM trips GROUP BY ALL""",
    "dim": """
        SELECT station_id, station_name, max(CASE WHEN axis = 'lat' THEN v END) AS start_lat,
               max(CASE WHEN axis = 'lng' THEN v END) AS start_lng
        FROM (SELECT *, row_number() OVER (PARTITION BY station_id, station_name, axis
                                           ORDER BY n DESC, v) AS r FROM coords)
        WHERE r = 1 GROUP BY 1, 2""",
    "one": """
        SELECT station_id, station_name, start_lat, start_lng
        FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY station_name) AS r FROM dim)
        WHERE r = 1""",
    "weather": """
        SELECT date_trunc('hour', ts) AS datetime, max(value) AS temperature,
               min(value) AS precipitation, CAST(0 AS DOUBLE) AS snowfall,
               CAST(count(*) AS DOUBLE) AS snow_depth
        FROM events WHERE event_type = 'error' GROUP BY 1""",
    "hours": f"""
        SELECT datetime,
               last_value(temperature IGNORE NULLS) OVER w AS temperature,
               last_value(precipitation IGNORE NULLS) OVER w AS precipitation,
               last_value(snowfall IGNORE NULLS) OVER w AS snowfall,
               last_value(snow_depth IGNORE NULLS) OVER w AS snow_depth,
               CASE WHEN CAST(datetime AS DATE) IN {HOLIDAYS} THEN 1 ELSE 0 END AS is_holiday
        FROM (SELECT DISTINCT datetime FROM counts) LEFT JOIN weather USING (datetime)
        WINDOW w AS (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "hourly": """
        SELECT station_id, station_name, start_lat, start_lng, datetime, departures,
               temperature, precipitation, snowfall, snow_depth, is_holiday
        FROM counts LEFT JOIN one USING (station_id) LEFT JOIN hours USING (datetime)""",
    "steps": f"SELECT unnest(generate_series({LO}, {HI}, INTERVAL 1 HOUR)) AS datetime",
    "grid": """
        SELECT station_id, datetime, coalesce(departures, 0) AS departures
        FROM (SELECT DISTINCT station_id FROM counts) CROSS JOIN steps
        LEFT JOIN counts USING (station_id, datetime)""",
    "lagged": """
        SELECT * FROM (
            SELECT *, CAST(lag(departures, 1) OVER w AS DOUBLE) AS lag_1h,
                   CAST(lag(departures, 2) OVER w AS DOUBLE) AS lag_2h,
                   CAST(lag(departures, 24) OVER w AS DOUBLE) AS lag_24h
            FROM grid WINDOW w AS (PARTITION BY station_id ORDER BY datetime))
        WHERE lag_24h IS NOT NULL""",
    "features": f"""
        SELECT station_id, station_name, start_lat, start_lng, datetime, departures,
               temperature, precipitation, snowfall, snow_depth, is_holiday,
               hour(datetime) AS hour_of_day, isodow(datetime) - 1 AS day_of_week,
               month(datetime) AS "month",
               CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               lag_1h, lag_2h, lag_24h,
               CASE WHEN datetime < {TRAIN_END} THEN 'train'
                    WHEN datetime < {VAL_END} THEN 'val' ELSE 'test' END AS split
        FROM lagged LEFT JOIN one USING (station_id) LEFT JOIN hours USING (datetime)""",
    "full_hours": f"""
        SELECT datetime,
               coalesce(last_value(temperature IGNORE NULLS) OVER w, 0) AS temperature,
               coalesce(last_value(precipitation IGNORE NULLS) OVER w, 0) AS precipitation,
               coalesce(last_value(snowfall IGNORE NULLS) OVER w, 0) AS snowfall,
               coalesce(last_value(snow_depth IGNORE NULLS) OVER w, 0) AS snow_depth,
               coalesce(last_value(is_holiday IGNORE NULLS) OVER w, 0) AS is_holiday
        FROM steps LEFT JOIN hours USING (datetime)
        WHERE datetime >= {LO} + INTERVAL 24 HOUR
        WINDOW w AS (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "model_rows": """
        SELECT f.* EXCLUDE (temperature, precipitation, snowfall, snow_depth, is_holiday),
               h.temperature, h.precipitation, h.snowfall, h.snow_depth, h.is_holiday
        FROM features f LEFT JOIN full_hours h USING (datetime)""",
    "scored": """
        SELECT *, greatest(0.0, CAST(0.5 AS DOUBLE) * lag_1h + CAST(0.2 AS DOUBLE) * lag_2h
                                + CAST(0.3 AS DOUBLE) * lag_24h) AS pred
        FROM features""",
    "test": "SELECT * FROM scored WHERE split = 'test'",
    "held_out": "SELECT * FROM scored WHERE split IN ('val', 'test')",
    "metrics": """
        SELECT model, split, sqrt(avg((p - departures) ** 2)) AS rmse, avg(abs(p - departures)) AS mae
        FROM (SELECT split, departures, 'lag_1h' AS model, lag_1h AS p FROM held_out
              UNION ALL SELECT split, departures, 'lag_2h', lag_2h FROM held_out
              UNION ALL SELECT split, departures, 'lag_24h', lag_24h FROM held_out
              UNION ALL SELECT split, departures, 'blend', pred FROM held_out)
        GROUP BY 1, 2""",
    "wide": """
        SELECT model, max(CASE WHEN split = 'val' THEN rmse END) AS rmse_val,
               max(CASE WHEN split = 'test' THEN rmse END) AS rmse_test,
               max(CASE WHEN split = 'val' THEN mae END) AS mae_val,
               max(CASE WHEN split = 'test' THEN mae END) AS mae_test
        FROM metrics GROUP BY 1""",
    "fractions": "SELECT unnest([{}]) AS fraction".format(
        ", ".join(f"CAST({f} AS DOUBLE)" for f in S.FRACTIONS)
    ),
    "curve_ranked": """
        SELECT departures, lag_1h, lag_24h,
               row_number() OVER (ORDER BY md5(station_id || '|' || CAST(datetime AS VARCHAR) || '|42'),
                                           station_id, datetime) AS k
        FROM features WHERE split = 'train'""",
    "curve_samples": """
        SELECT fraction, CAST(floor((SELECT count(*) FROM curve_ranked) * fraction) AS BIGINT) AS n_rows
        FROM fractions""",
    "curve_points": """
        SELECT 'ridge_lag_1h' AS model, fraction, n_rows, departures, lag_1h AS x FROM curve_samples JOIN curve_ranked ON k <= n_rows""",
    "curve_slopes": """
        SELECT model, fraction, n_rows, avg(departures) AS my, avg(x) AS mx,
               covar_pop(departures, x) * count(*) / (var_pop(x) * count(*) + 50.0::DOUBLE) AS w
        FROM curve_points GROUP BY 1, 2, 3""",
    "runs": """
        SELECT model, round(fraction, 2) AS fraction, n_rows,
               round(sqrt(avg((p - departures) ** 2) FILTER (WHERE split = 'val')), 4) AS val_rmse,
               round(sqrt(avg((p - departures) ** 2) FILTER (WHERE split = 'test')), 4) AS test_rmse
        FROM (SELECT model, fraction, n_rows, split, departures,
                     greatest(0, my + w * (lag_1h - mx)) AS p
              FROM curve_slopes CROSS JOIN (SELECT * FROM features WHERE split <> 'train'))
        GROUP BY 1, 2, 3""",
    "entities": """
        SELECT station_id, min(station_name) AS station_name, min(start_lat) AS lat, min(start_lng) AS lng,
               sqrt(avg((pred - departures) ** 2)) AS rmse, avg(departures) AS mean_demand,
               count(*) AS n_hours
        FROM test GROUP BY 1 HAVING count(*) >= 90""",
    "series": """
        SELECT datetime, CAST(sum(departures) AS BIGINT) AS departures, sum(pred) AS pred
        FROM test GROUP BY 1""",
    "daily": """
        SELECT d.day, coalesce(departures, 0) AS departures, coalesce(pred, 0) AS pred
        FROM (SELECT CAST(unnest(generate_series(date_trunc('day', min(datetime)),
                                                 date_trunc('day', max(datetime)), INTERVAL 1 DAY)) AS DATE)
                     AS day FROM series) d
        LEFT JOIN (SELECT CAST(datetime AS DATE) AS day, CAST(sum(departures) AS BIGINT) AS departures,
                          sum(pred) AS pred FROM series GROUP BY 1) USING (day)""",
    "focus": """
        SELECT station_id, station_name, avg(departures) AS mean_demand, count(*) AS n
        FROM test GROUP BY 1, 2 HAVING count(*) >= 90
        ORDER BY round(mean_demand, 9) DESC, station_id LIMIT 1""",
    "focus_rows": """
        SELECT station_id, station_name, datetime, departures, pred
        FROM test WHERE station_id IN (SELECT station_id FROM focus)""",
    "dirty": """
        SELECT ride_id,
               CASE WHEN n % 97 = 0 OR n % 89 = 0 THEN NULL ELSE started_at END AS t,
               n % 97 <> 0 AND n % 89 = 0 AS blank,
               CASE WHEN n % 83 <> 0 THEN station_id END AS start_station_id
        FROM trips""",
    "shifted": """
        SELECT started_at + INTERVAL 60 DAY AS t FROM trips
        UNION ALL SELECT started_at + INTERVAL 298 DAY FROM trips""",
    "edges": f"""
        SELECT t, CASE WHEN timezone({TZ}, timezone({TZ}, t)) <> t THEN 'nonexistent'
                       WHEN timezone({TZ}, timezone({TZ}, t) - INTERVAL 1 HOUR) = t THEN 'ambiguous'
                       ELSE 'kept' END AS state
        FROM shifted""",
    "supplier_days": """
        SELECT l_suppkey AS supplier_id, date_trunc('day', l_shipdate) AS day, count(*) AS items
        FROM lineitem GROUP BY 1, 2""",
    "supplier_panel": """
        SELECT * FROM (
            SELECT supplier_id, day, items, lag(items, 1) OVER w AS lag_1d,
                   lag(items, 2) OVER w AS lag_2d, lag(items, 7) OVER w AS lag_7d
            FROM (SELECT supplier_id, day, coalesce(items, 0) AS items
                  FROM (SELECT DISTINCT supplier_id FROM supplier_days)
                  CROSS JOIN (SELECT CAST(unnest(generate_series(
                              (SELECT date_trunc('year', min(l_shipdate)) FROM lineitem),
                              (SELECT date_trunc('year', max(l_shipdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY
                               FROM lineitem), INTERVAL 1 DAY)) AS TIMESTAMP) AS day)
                  LEFT JOIN supplier_days USING (supplier_id, day))
            WINDOW w AS (PARTITION BY supplier_id ORDER BY day))
        WHERE lag_7d IS NOT NULL""",
    # Name, kind, month, day, weekday, shift, observed, first year.
    "rules": """
        SELECT * FROM (VALUES
            ('New Year''s Day', 'date', 1, 1, NULL, 0, true, 0),
            ('Martin Luther King Jr. Day', 'nth', 1, 3, 0, 0, false, 1986),
            ('Lincoln''s Birthday', 'date', 2, 12, NULL, 0, true, 0),
            ('Susan B. Anthony Day', 'date', 2, 15, NULL, 0, false, 2004),
            ('Washington''s Birthday', 'nth', 2, 3, 0, 0, false, 0),
            ('Memorial Day', 'last', 5, NULL, 0, 0, false, 0),
            ('Juneteenth National Independence Day', 'date', 6, 19, NULL, 0, true, 2021),
            ('Independence Day', 'date', 7, 4, NULL, 0, true, 0),
            ('Labor Day', 'nth', 9, 1, 0, 0, false, 0),
            ('Columbus Day', 'nth', 10, 2, 0, 0, false, 0),
            ('Election Day', 'nth', 11, 1, 0, 1, false, 0),
            ('Veterans Day', 'date', 11, 11, NULL, 0, true, 0),
            ('Thanksgiving', 'nth', 11, 4, 3, 0, false, 0),
            ('Christmas Day', 'date', 12, 25, NULL, 0, true, 0)
        ) AS r(name, kind, m, d, w, shift, observed, since)""",
}


def _dates(years: str) -> str:
    """Holiday dates of the years a table covers, as a WITH-less subquery."""
    return f"""
        SELECT date, holiday_name FROM (
          SELECT CAST(base AS DATE) AS date, name AS holiday_name FROM dated
          UNION ALL
          SELECT CAST(CASE WHEN isodow(base) = 6 THEN base - INTERVAL 1 DAY ELSE base + INTERVAL 1 DAY END
                      AS DATE), name || ' (observed)'
          FROM dated WHERE observed AND isodow(base) >= 6)
        WHERE year(date) BETWEEN (SELECT lo FROM {years}) AND (SELECT hi FROM {years})"""


DATED = """
    dated AS (
      SELECT name, observed, base + to_days(shift) AS base FROM (
        SELECT *, CASE
            WHEN kind = 'date' THEN make_date(y, m, d)
            WHEN kind = 'nth' THEN make_date(y, m, 1)
                 + to_days(CAST((w - (isodow(make_date(y, m, 1)) - 1) + 7) % 7 + 7 * (d - 1) AS INTEGER))
            ELSE last_day(make_date(y, m, 1))
                 - to_days(CAST((isodow(last_day(make_date(y, m, 1))) - 1 - w + 7) % 7 AS INTEGER)) END AS base
        FROM rules CROSS JOIN (SELECT unnest(generate_series(lo - 1, hi + 1)) AS y FROM span) WHERE y >= since))"""


def _needed(text: str, names: list[str]) -> set[str]:
    return {n for n in names if re.search(rf"\b{n}\b", text)}


def sql(select: str, extra: str = "") -> str:
    """The statement with the common tables it uses in front."""
    names = list(COMMON)
    wanted = _needed(select + extra, names)
    for name in reversed(names):
        if name in wanted:
            wanted |= _needed(COMMON[name], names[: names.index(name)])
    parts = [f"{n} AS ({COMMON[n].strip()})" for n in names if n in wanted]
    if extra:
        parts.append(extra.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select.strip()


def r(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr}"


def text(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


WEATHER = ", ".join(r(c) for c in S.WEATHER_COLS)
HOURLY = f"""station_id, station_name, {r('start_lat')}, {r('start_lng')}, {text('datetime')}, departures,
    {WEATHER}, CAST(is_holiday AS BIGINT) AS is_holiday"""
LAGS = ", ".join(r(c) for c in ("lag_1h", "lag_2h", "lag_24h"))
CALENDAR = ", ".join(
    f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ("hour_of_day", "day_of_week", "month", "is_weekend")
)
FEATURE_ROW = f"""station_id, station_name, {r('start_lat')}, {r('start_lng')}, {text('datetime')},
    CAST(departures AS BIGINT) AS departures, {WEATHER}, CAST(is_holiday AS BIGINT) AS is_holiday,
    {CALENDAR}, {LAGS}, split"""


def _float32(c: str) -> str:
    return f"CAST({c} AS REAL)"


def _scores(model: str, rows: str, pred: str, y: str = "departures") -> str:
    return f"""
        SELECT '{model}' AS model, split, {r(f'sqrt(avg(({pred} - {y}) ** 2))', 'rmse')},
               {r(f'avg(abs({pred} - {y}))', 'mae')}
        FROM {rows} GROUP BY split"""


def _error_by(col: str, label: str | None) -> str:
    named = f", {label} AS label" if label else ""
    return f"""
        SELECT CAST("{col}" AS BIGINT) AS "{col}", {r('rmse')}, n,
               round(rmse, 9) = max(round(rmse, 9)) OVER () AS is_max, round(rmse, 9) = min(round(rmse, 9)) OVER () AS is_min{named}
        FROM (SELECT "{col}", sqrt(avg((pred - departures) ** 2)) AS rmse, count(*) AS n
              FROM held_out GROUP BY 1)"""


def _bucket(rows: str) -> str:
    dims = ", ".join(
        f"({i}, '{label}', {lo}, {hi})"
        for i, (label, lo, hi) in enumerate(zip(S.BUCKET_LABELS, S.BUCKET_EDGES, S.BUCKET_EDGES[1:]))
    )
    return f"""
        SELECT CAST(i AS BIGINT) AS bucket_no, label AS bucket,
               {r('coalesce(sqrt(avg((pred - departures) ** 2)), 0)', 'rmse')}, count(departures) AS n
        FROM (VALUES {dims}) AS b(i, label, lo, hi)
        LEFT JOIN {rows} ON departures >= lo AND departures < hi
        GROUP BY 1, 2"""


def _hexbin(rows: str, gridsize: int, ny: int, cap: float, min_count: int) -> str:
    return sql(
        f"""
        SELECT CAST(lattice AS BIGINT) AS lattice, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy,
               {r('x0 + (ix + lattice * 0.5::DOUBLE) * sx', 'x')},
               {r('y0 + (iy + lattice * 0.5::DOUBLE) * sy', 'y')}, n, {r('log10(n)', 'log_n')}
        FROM (SELECT lattice, CASE WHEN lattice = 0 THEN round_even(u, 0) ELSE floor(u) END AS ix,
                     CASE WHEN lattice = 0 THEN round_even(v, 0) ELSE floor(v) END AS iy,
                     x0, y0, sx, sy, count(*) AS n
              FROM (SELECT *, CASE WHEN (u - round_even(u, 0)) * (u - round_even(u, 0))
                        + 3.0::DOUBLE * (v - round_even(v, 0)) * (v - round_even(v, 0))
                        < (u - floor(u) - 0.5::DOUBLE) * (u - floor(u) - 0.5::DOUBLE)
                        + 3.0::DOUBLE * (v - floor(v) - 0.5::DOUBLE) * (v - floor(v) - 0.5::DOUBLE)
                        THEN 0 ELSE 1 END AS lattice FROM scaled)
              GROUP BY ALL HAVING count(*) >= {min_count})""",
        f"""
        points AS (SELECT least(CAST(departures AS DOUBLE), {cap}::DOUBLE) AS x,
                          least(pred, {cap}::DOUBLE) AS y FROM {rows}),
        box AS (SELECT min(x) - (max(x) - min(x)) * 1e-9::DOUBLE AS x0,
                       max(x) + (max(x) - min(x)) * 1e-9::DOUBLE AS x1,
                       min(y) - (max(y) - min(y)) * 1e-9::DOUBLE AS y0,
                       max(y) + (max(y) - min(y)) * 1e-9::DOUBLE AS y1 FROM points),
        scaled AS (SELECT x0, y0, (x1 - x0) / {gridsize} AS sx, (y1 - y0) / {ny} AS sy,
                          (x - x0) / ((x1 - x0) / {gridsize}) AS u, (y - y0) / ((y1 - y0) / {ny}) AS v
                   FROM points CROSS JOIN box)""",
    )


SAMPLE_KEY = "station_id || '|' || CAST(datetime AS VARCHAR) || '|42'"
TRIP_ROW = f"""ride_id, {text('started_at')}, station_id AS start_station_id,
    station_name AS start_station_name, {r('start_lat')}, {r('start_lng')}"""
YEARS = "span AS (SELECT year(min({c})) AS lo, year(max({c})) AS hi FROM {t}),"


def _calendar(table: str, col: str) -> str:
    return sql(
        f"""SELECT CAST(date AS VARCHAR) AS date, holiday_name, coalesce(n, 0) AS n
            FROM ({_dates('span')})
            LEFT JOIN (SELECT CAST({col} AS DATE) AS date, count(*) AS n FROM {table} GROUP BY 1)
            USING (date)""",
        YEARS.format(c=col, t=table) + DATED,
    )


def _ridge(scale: bool) -> str:
    slope = (
        "covar_pop(departures, lag_24h) / var_pop(lag_24h) * count(*) / (count(*) + 50.0::DOUBLE)"
        if scale
        else "covar_pop(departures, lag_24h) * count(*)"
        " / (var_pop(lag_24h) * count(*) + 50.0::DOUBLE)"
    )
    return sql(
        _scores("ridge", "fitted", "p"),
        f"""
        fit AS (SELECT {slope} AS w, avg(departures) AS my, avg(lag_24h) AS mx
                FROM features WHERE split = 'train'),
        fitted AS (SELECT split, departures, greatest(0, my + w * (lag_24h - mx)) AS p
                   FROM features CROSS JOIN fit)""",
    )


def _ridge_all(alpha: float) -> str:
    """The ridge over all inputs: its normal equations in standard units, solved by elimination."""
    k = len(S.FEATURES)
    cols = [f'CAST("{c}" AS REAL)::DOUBLE' for c in S.FEATURES]
    z = [f"(x[{i + 1}] - m[{i + 1}]) / s[{i + 1}]" for i in range(k)]
    sums = [
        "[" + ", ".join([*(f"sum(z[{i + 1}] * z[{j + 1}]) + {alpha if i == j else 0.0}::DOUBLE" for j in range(k)), f"sum(z[{i + 1}] * y)"]) + "]"
        for i in range(k)
    ]
    return sql(
        f"""SELECT 'ridge' AS model, split, {r('sqrt(avg((p - departures) ** 2))', 'rmse')}, {r('avg(abs(p - departures))', 'mae')}
            FROM (SELECT split, departures, greatest(0, my + list_dot_product(w, [{', '.join(z)}])) AS p
                  FROM (SELECT * FROM inputs WHERE split <> 'train') CROSS JOIN stats
                  CROSS JOIN (SELECT list_transform(a, lambda line: line[{k + 1}]) AS w FROM solved WHERE step = {k + 1}))
            GROUP BY split""",
        f"""inputs AS MATERIALIZED (SELECT split, departures::DOUBLE AS departures, [{', '.join(cols)}] AS x FROM model_rows),
            stats AS MATERIALIZED (
                SELECT avg(departures) AS my, [{', '.join(f'avg(x[{i + 1}])' for i in range(k))}] AS m,
                       [{', '.join(f'CASE WHEN stddev_pop(x[{i + 1}]) > 0 THEN stddev_pop(x[{i + 1}]) ELSE 1 END' for i in range(k))}] AS s
                FROM inputs WHERE split = 'train'),
            standard AS (SELECT departures - my AS y, [{', '.join(z)}] AS z FROM inputs CROSS JOIN stats WHERE split = 'train'),
            equations AS MATERIALIZED (SELECT [{', '.join(sums)}] AS a FROM standard),
            solved AS (
                SELECT 1 AS step, a FROM equations UNION ALL
                SELECT step + 1, list_transform(a, lambda line, i: list_transform(line, lambda v, j:
                    CASE WHEN i = step THEN v / a[step][step] ELSE v - line[step] * a[step][j] / a[step][step] END))
                FROM solved WHERE step <= {k})""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _tree_gains(inputs: tuple[str, ...]) -> str:
    """Per input the threshold with the largest fall of the squared error, among all between two values."""
    values = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, count(*) AS n, sum(departures)::DOUBLE AS s FROM train GROUP BY 2" for c in inputs
    )
    return sql(
        f"""SELECT feature, {r('(v + next) / 2', 'threshold')}, {r('1000 * gain / n_all', 'gain')}, CAST(n_all AS BIGINT) AS n,
                   CAST(n_left AS BIGINT) AS n_left, {r('s_left / n_left', 'left_mean')}, {r('(s_all - s_left) / (n_all - n_left)', 'right_mean')}
            FROM (SELECT *, s_left ** 2 / n_left + (s_all - s_left) ** 2 / (n_all - n_left) - s_all ** 2 / n_all AS gain
                  FROM running WHERE next IS NOT NULL)
            QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, v) = 1""",
        f"""train AS MATERIALIZED (SELECT departures, {', '.join(inputs)} FROM model_rows WHERE split = 'train'),
            vals AS ({values}),
            running AS (
                SELECT feature, v, lead(v) OVER by_value AS next, sum(n) OVER by_value AS n_left, sum(s) OVER by_value AS s_left,
                       sum(n) OVER (PARTITION BY feature) AS n_all, sum(s) OVER (PARTITION BY feature) AS s_all
                FROM vals WINDOW by_value AS (PARTITION BY feature ORDER BY v))""",
    )


def _described(col: str) -> str:
    q = lambda p, n: r(f"quantile_cont(CAST({col} AS DOUBLE), {p})", n)
    return f"""
        SELECT '{col}' AS column_name, count({col}) AS n, {r(f'avg({col})', 'mean')},
               {r(f'stddev_samp({col})', 'std')}, {r(f'min({col})', '"min"')}, {r(f'max({col})', '"max"')},
               {q(0.25, 'q25')}, {q(0.5, 'q50')}, {q(0.75, 'q75')} FROM hourly"""


def _null_count(col: str, cond: str) -> str:
    return f"SELECT '{col}' AS column_name, count(*) FILTER (WHERE {cond}) AS n_null FROM dirty"


DESCRIBED = ["departures", "temperature", "precipitation", "snow_depth", "start_lat", "is_holiday"]
IN_CUT = "t BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 12:59:59'"
RAW_MONTHS = "SELECT DISTINCT 'raw/' || strftime({c}, '%Y%m') || '-orders.csv' AS path, strftime({c}, '%Y%m') AS month FROM {t}"
QUANTILES = [0.05, 0.5, 0.9, 0.95]

ORACLES: dict[str, str] = {
    "naive_from_log": sql(
        f"""SELECT split, count(*) AS n, {r('sqrt(avg((lag_1h - departures) ** 2))', 'rmse')},
                   {r('avg(abs(lag_1h - departures))', 'mae')} FROM features GROUP BY 1"""
    ),
    "trip_csv_scan": sql(f"SELECT {TRIP_ROW} FROM trips"),
    "zipped_csv_scan": sql(f"SELECT {TRIP_ROW} FROM trips"),
    "skipped_csv_files": "SELECT 'missing columns: started_at' AS reason, count(DISTINCT 1) AS n FROM events",
    "weather_csv_scan": sql(f"SELECT {text('datetime')}, {WEATHER} FROM weather"),
    "weather_payload": sql(f"SELECT {text('datetime')}, {WEATHER} FROM weather"),
    "holiday_file_missing": sql("SELECT CAST(0 AS BIGINT) AS is_holiday, count(*) AS n FROM counts"),
    "hourly_csv_round_trip": sql(f"SELECT {HOURLY} FROM hourly"),
    "features_from_stored_hourly": sql(f"SELECT {FEATURE_ROW} FROM features"),
    "feature_store_scan": sql(
        f"""SELECT station_id, {text('datetime')}, CAST(departures AS BIGINT) AS departures,
                   {r('lag_1h')}, {r('lag_24h')}, split FROM features WHERE split = 'val'"""
    ),
    "holiday_events": _calendar("events", "ts"),
    "order_year_holidays": _calendar("orders", "o_orderdate"),
    "pending_archives": f"""
        SELECT path, month FROM ({RAW_MONTHS.format(c='l_shipdate', t='lineitem')})
        WHERE month NOT IN (SELECT strftime(o_orderdate, '%Y%m') FROM orders)""",
    "zip_outcomes": """
        SELECT 'whole' AS kind, 'none' AS problem, CAST(4 AS BIGINT) AS n, count(*) AS n_rows FROM events
        UNION ALL SELECT 'cut', 'cannot read', 4, 0
        UNION ALL SELECT 'odd', 'none', 4, 8
        UNION ALL SELECT 'odd', 'missing columns', 4, 0""",
    "pending_zip_members": """
        SELECT month_key, CAST(1 AS BIGINT) AS n FROM (VALUES ('202402'), ('202404')) AS m(month_key)""",
    "csv_outcomes": """
        SELECT kind, 'none' AS problem, count(*) AS n_rows
        FROM events CROSS JOIN (VALUES ('whole'), ('packed')) AS k(kind) GROUP BY 1
        UNION ALL SELECT 'cut', 'cannot read', 0
        UNION ALL SELECT 'odd', 'missing columns', 0""",
    "appended_results": sql(f"SELECT model, split, {r('rmse')}, {r('mae')} FROM metrics"),
    "best_params_json": sql(
        f"""SELECT {r('rmse', 'best_val_rmse')}, model, {r('mae')} FROM metrics WHERE split = 'val'
            ORDER BY rmse, model LIMIT 1"""
    ),
    "valid_trips": sql(
        "SELECT ride_id, start_station_id FROM dirty WHERE t IS NOT NULL AND start_station_id IS NOT NULL"
    ),
    "trips_in_range": sql(
        f"SELECT ride_id, start_station_id FROM dirty WHERE {IN_CUT} AND start_station_id IS NOT NULL"
    ),
    "quality_report": sql(
        f"""SELECT count(*) AS n_loaded, count(*) FILTER (WHERE t IS NULL) AS n_bad_time,
                   count(*) FILTER (WHERE start_station_id IS NULL) AS n_no_key,
                   count(*) FILTER (WHERE t IS NOT NULL AND start_station_id IS NOT NULL) AS n_valid,
                   count(*) FILTER (WHERE {IN_CUT} AND start_station_id IS NOT NULL) AS n_in_range,
                   CAST(0 AS BIGINT) AS n_dst_edge,
                   count(*) FILTER (WHERE {IN_CUT} AND start_station_id IS NOT NULL) AS n_kept
            FROM dirty"""
    ),
    "null_report": sql(
        " UNION ALL ".join(
            [
                _null_count("ride_id", "ride_id IS NULL"),
                _null_count("started_at", "blank"),
                _null_count("start_station_id", "start_station_id IS NULL"),
            ]
        )
    ),
    "dst_edge_report": sql("SELECT state, count(*) AS n FROM edges GROUP BY 1"),
    "dst_edges_dropped": sql(
        f"""SELECT {text("date_trunc('hour', t)", 'datetime')}, count(*) AS n
            FROM edges WHERE state = 'kept' GROUP BY 1"""
    ),
    "utc_to_wall_clock": f"""
        SELECT {text(f"date_trunc('hour', timezone({TZ}, timezone('UTC', ts)))", 'datetime')}, count(*) AS n
        FROM events GROUP BY 1""",
    "hourly_counts": sql(f"SELECT station_id, {text('datetime')}, departures FROM counts"),
    "streamed_hourly_counts": sql(f"SELECT station_id, {text('datetime')}, departures FROM counts"),
    "daily_item_counts": sql(f"SELECT supplier_id, {text('day')}, items FROM supplier_days"),
    "station_dimension": sql(
        f"SELECT station_id, station_name, {r('start_lat')}, {r('start_lng')} FROM dim"
    ),
    "station_one_name": sql(
        f"SELECT station_id, station_name, {r('start_lat')}, {r('start_lng')} FROM one"
    ),
    "renamed_stations": sql(
        """SELECT station_id, count(*) AS n_names, min(station_name) AS kept_name,
                  max(station_name) AS last_name FROM dim GROUP BY 1 HAVING count(*) > 1"""
    ),
    "hourly_demand": sql(f"SELECT {HOURLY} FROM hourly"),
    "hourly_demand_fan_out": sql(
        f"SELECT {HOURLY} FROM counts LEFT JOIN dim USING (station_id) LEFT JOIN hours USING (datetime)"
    ),
    "describe_hourly": sql(" UNION ALL ".join(_described(c) for c in DESCRIBED)),
    "holiday_flags": sql(
        f"""SELECT CAST(CASE WHEN CAST(datetime AS DATE) IN {HOLIDAYS} THEN 1 ELSE 0 END AS BIGINT)
                   AS is_holiday, count(*) AS n, CAST(sum(departures) AS BIGINT) AS departures
            FROM counts GROUP BY 1"""
    ),
    "holiday_rows": sql(
        f"""SELECT station_id, {text('datetime')}, departures FROM counts
            WHERE CAST(datetime AS DATE) IN {HOLIDAYS}"""
    ),
    "first_event_per_user": """
        SELECT user_id, event_id, event_type FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
        WHERE r = 1""",
    "distinct_hours": sql(
        f"SELECT DISTINCT {text('datetime')}, {WEATHER}, CAST(is_holiday AS BIGINT) AS is_holiday FROM hourly"
    ),
    "union_by_name": sql(
        f"SELECT ride_id, station_id AS start_station_id, {r('start_lat')} FROM trips"
    ),
    "quiet_customers": """
        SELECT c_custkey AS user_id FROM customer
        WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "dense_grid": sql(f"SELECT station_id, {text('datetime')} FROM grid"),
    "zero_filled_grid": sql(f"SELECT station_id, {text('datetime')}, departures FROM grid"),
    "density_report": sql(
        """SELECT count(DISTINCT station_id) AS n_keys, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_duplicates,
                  count(DISTINCT station_id) * (SELECT count(*) FROM steps) AS n_expected,
                  count(*) = count(DISTINCT station_id) * (SELECT count(*) FROM steps) AS is_dense FROM grid"""
    ),
    "lagged_panel": sql(f"SELECT station_id, {text('datetime')}, departures, {LAGS} FROM lagged"),
    "daily_item_panel": sql(
        f"""SELECT supplier_id, {text('day')}, items, {r('lag_1d')}, {r('lag_2d')}, {r('lag_7d')}
            FROM supplier_panel"""
    ),
    "features_table": sql(f"SELECT {FEATURE_ROW} FROM features"),
    "model_table": sql(
        "SELECT station_id, station_name, {}, split, {} FROM model_rows".format(
            f"{text('datetime')}, CAST(departures AS BIGINT) AS departures",
            ", ".join(r(f'{_float32(chr(34) + c + chr(34))}', f'"{c}"') for c in S.FEATURES),
        )
    ),
    "refilled_features": sql(
        f"""SELECT station_id, {text('datetime')}, {WEATHER}, CAST(is_holiday AS BIGINT) AS is_holiday
            FROM model_rows"""
    ),
    "filled_hours": sql(
        f"SELECT {text('datetime')}, {WEATHER}, CAST(is_holiday AS BIGINT) AS is_holiday FROM full_hours"
    ),
    "calendar_features": """
        SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour_of_day,
               CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(month(ts) AS BIGINT) AS "month",
               CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend FROM events""",
    "split_sizes": sql("SELECT split, count(*) AS n FROM features GROUP BY 1"),
    "split_selection": sql(
        """SELECT split, count(*) AS n, CAST(sum(departures) AS BIGINT) AS departures
           FROM features WHERE split IN ('val', 'test') GROUP BY 1"""
    ),
    "feature_vectors": sql(
        "SELECT station_id, {}, {} FROM model_rows".format(
            text("datetime"),
            ", ".join(r(_float32(f'"{c}"'), f"x{i:02d}") for i, c in enumerate(S.FEATURES)),
        )
    ),
    "naive_scores": sql(_scores("naive", "features", "lag_1h")),
    "daily_item_naive_scores": sql(
        f"""SELECT 'lag_7d' AS model, CAST(year(day) AS VARCHAR) AS split,
                   {r('sqrt(avg((lag_7d - items) ** 2))', 'rmse')}, {r('avg(abs(lag_7d - items))', 'mae')}
            FROM supplier_panel GROUP BY 2"""
    ),
    "lag_scores": sql(f"SELECT model, split, {r('rmse')}, {r('mae')} FROM metrics"),
    "leaderboard": sql(
        """SELECT model, round(rmse_val, 4) AS rmse_val, round(rmse_test, 4) AS rmse_test,
                  round(mae_val, 4) AS mae_val, round(mae_test, 4) AS mae_test FROM wide"""
    ),
    "improvement_over_naive": sql(
        f"""SELECT a.model, split, {r('(1 - a.rmse / b.rmse) * 100', 'rmse_gain_pct')},
                   {r('(1 - a.mae / b.mae) * 100', 'mae_gain_pct')}
            FROM metrics a JOIN (SELECT * FROM metrics WHERE model = 'lag_1h') b USING (split)"""
    ),
    "metrics_upsert": sql(
        f"""SELECT model, split, {r('rmse')}, {r('mae')} FROM metrics WHERE model <> 'lag_24h'
            UNION ALL
            SELECT 'lag_24h', split, {r('rmse')}, {r('mae')} FROM metrics WHERE model = 'blend'"""
    ),
    "pending_runs": sql(
        f"""SELECT model, {r('fraction')} FROM fractions
            CROSS JOIN (VALUES ('ridge_lag_1h')) AS m(model)
            WHERE fraction > {S.FRACTIONS[1]}"""
    ),
    "curve_table": sql(f"SELECT model, n_rows, {r('val_rmse')}, {r('test_rmse')} FROM runs"),
    "curve_endpoints": sql(f"SELECT model, n_rows, {r('val_rmse')} FROM runs WHERE fraction = 1"),
    "curve_ticks": sql(
        """SELECT model, string_agg(CAST(n_rows AS VARCHAR), ',' ORDER BY n_rows) AS ticks
           FROM curve_samples CROSS JOIN (VALUES ('ridge_lag_1h')) AS m(model) GROUP BY 1"""
    ),
    "ridge_normal_equations": "SELECT term, false AS is_off FROM (VALUES ('intercept'), {}) AS t(term)".format(
        ", ".join(f"('{c}')" for c in S.FEATURES)
    ),
    **{
        name: sql(
            f"""SELECT '{model}' AS model, split, count(*) AS n, CAST(0 AS BIGINT) AS n_negative,
                       CAST(0 AS BIGINT) AS n_missing, true AS beats_naive
                FROM features WHERE split IN ('val', 'test') GROUP BY split"""
        )
        for name, model in {
            "forest_scores": "forest", "boost_scores": "boost", "boost_leaves_scores": "leaves",
            "mlp_scores": "mlp", "best_trial_refit": "tuned",
        }.items()
    },
    "feature_importance": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{S.FEATURE_LABELS.get(c, c)}' AS label, CAST(100 AS DOUBLE) AS gain_total,
                   CAST(100 AS DOUBLE) AS splits_total, CAST(3 AS BIGINT) AS n_top, true AS is_counted"""
        for c in S.FEATURES
    ),
    "saved_model_scores": sql(
        "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_differing FROM features WHERE split = 'test'"
    ),
    "hyper_parameter_search_whole": """
        SELECT CAST(trial AS BIGINT) AS trial, true AS in_space, true AS not_better, true AS beats_naive
        FROM (SELECT unnest(generate_series(0, 29)) AS trial)""",
    "hyper_parameter_search": """
        SELECT CAST(trial AS BIGINT) AS trial, true AS in_space, true AS not_better
        FROM (VALUES (0), (1)) AS t(trial)""",
    "labelled_shares": f"""
        SELECT feature, splits, {r('gain')},
               CASE feature WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View'
                            WHEN 'signup' THEN 'Sign up' ELSE feature END AS label,
               {r('gain / sum(gain) OVER () * 100', 'gain_pct')},
               row_number() OVER (ORDER BY gain DESC, feature) <= 3 AS is_top
        FROM (SELECT event_type AS feature, count(*) AS splits, sum(value) AS gain FROM events GROUP BY 1)""",
    "label_table": """
        SELECT CAST(feature AS BIGINT) AS feature, n, coalesce(n_name, CAST(feature AS VARCHAR)) AS label
        FROM (SELECT c_nationkey AS feature, count(*) AS n FROM customer GROUP BY 1)
        LEFT JOIN nation ON feature = n_nationkey AND n_regionkey < 4""",
    "report_labels": """
        SELECT hour, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS clock,
               ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][hour % 7 + 1] AS weekday,
               CASE WHEN n * 1000 >= 1e6 THEN format('{:.1f}M', n * 1000 / 1e6)
                    ELSE format('{:.0f}K', n * 1000 / 1e3) END AS thousands,
               format('{:.1f}M', n * 100000 / 1e6) AS millions,
               format('{:.1f}%', round(top, 0)) AS percent,
               substr(kind, 1, 3) AS short, 'ridge|rf|' || kind AS names,
               round_even(n / 8, 2) AS eighths
        FROM (SELECT hour(ts) AS hour, count(*) AS n, max(value) AS top, max(event_type) AS kind
              FROM events GROUP BY 1)""",
    "residual_summary": sql(
        f"""SELECT count(*) AS n, {r('avg(e)', 'mean_residual')}, {r('stddev_pop(e)', 'std_residual')},
                   {r('avg(CASE WHEN e > 0 THEN 1 ELSE 0 END) * 100', 'pct_over')},
                   {r('avg(CASE WHEN e < 0 THEN 1 ELSE 0 END) * 100', 'pct_under')}
            FROM (SELECT pred - departures AS e FROM test)"""
    ),
    "residual_histogram": sql(
        f"""SELECT CAST(bin AS BIGINT) AS bin, {r('lo + (hi - lo) * bin / 80', 'bin_lo')},
                   {r('lo + (hi - lo) * (bin + 1) / 80', 'bin_hi')}, coalesce(n, 0) AS n
            FROM (SELECT unnest(generate_series(0, 79)) AS bin) CROSS JOIN box
            LEFT JOIN (SELECT least(79, CAST(floor((e - lo) / (hi - lo) * 80) AS BIGINT)) AS bin,
                              count(*) AS n FROM res CROSS JOIN box GROUP BY 1) USING (bin)""",
        """res AS (SELECT least(greatest(pred - departures, -20), 20) AS e FROM test),
           box AS (SELECT min(e) AS lo, max(e) AS hi FROM res)""",
    ),
    "scatter_sample": sql(
        f"""SELECT station_id, {text('datetime')}, CAST(departures AS BIGINT) AS departures, {r('pred')},
                   {r('max(greatest(departures, pred)) OVER ()', 'axis_max')}
            FROM (SELECT * FROM test ORDER BY md5({SAMPLE_KEY}), station_id, datetime LIMIT 3000)"""
    ),
    "bucket_error": sql(_bucket("test")),
    "item_bucket_error": sql(
        _bucket("rows_"),
        "rows_ AS (SELECT items AS departures, items * 0.5::DOUBLE + 1 AS pred FROM supplier_days)",
    ),
    "error_by_hour": sql(_error_by("hour_of_day", "lpad(CAST(hour_of_day AS VARCHAR), 2, '0') || ':00'")),
    "error_by_weekday": sql(
        _error_by("day_of_week", "['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][day_of_week + 1]")
    ),
    "error_by_month": sql(_error_by("month", "'Jan (val, test)'")),
    "entity_error": sql(
        f"""SELECT station_id, station_name, {r('lat')}, {r('lng')}, {r('rmse')}, {r('mean_demand')}, n_hours
            FROM entities"""
    ),
    **{
        f"{name}_entities": sql(
            f"""SELECT station_id, station_name, {r('lat')}, {r('lng')}, {r('rmse')}, {r('mean_demand')},
                       n_hours, substr(station_name, 1, 30) AS short_name
                FROM (SELECT * FROM entities ORDER BY round(rmse, 9) {order}, station_id LIMIT 10)"""
        )
        for name, order in {"worst": "DESC", "best": "ASC"}.items()
    },
    "error_trend_line": sql(
        f"""SELECT {r('regr_slope(rmse, mean_demand)', 'slope')},
                   {r('regr_intercept(rmse, mean_demand)', 'intercept')}, {r('max(mean_demand)', 'x_max')}
            FROM entities"""
    ),
    "error_trend": sql(
        f"""SELECT point, {r('m * point / 199.0::DOUBLE', 'x')}, {r('a + b * m * point / 199.0::DOUBLE', 'y')}
            FROM (SELECT regr_slope(rmse, mean_demand) AS b, regr_intercept(rmse, mean_demand) AS a,
                         max(mean_demand) AS m FROM entities)
            CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS point)"""
    ),
    "geo_error": sql(
        f"""SELECT station_id, {r('lat')}, {r('lng')}, {r('rmse')},
                   {r('(SELECT quantile_cont(rmse, 0.05) FROM entities)', 'vmin')},
                   {r('(SELECT quantile_cont(rmse, 0.95) FROM entities)', 'vmax')} FROM entities"""
    ),
    "entity_summary": sql(
        f"""SELECT count(*) AS n_entities, {r('avg(rmse)', 'mean_rmse')}, {r('max(rmse)', 'max_rmse')},
                   (SELECT station_name FROM entities ORDER BY round(rmse, 9) DESC, station_id LIMIT 1) AS max_name,
                   {r('min(rmse)', 'min_rmse')},
                   (SELECT station_name FROM entities ORDER BY round(rmse, 9), station_id LIMIT 1) AS min_name,
                   {r('quantile_cont(rmse, 0.5)', 'median_rmse')}, {r('quantile_cont(rmse, 0.9)', 'p90_rmse')}
            FROM entities"""
    ),
    "value_quantiles": " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont(value, {p})', 'quantile')} FROM events"
        for p in QUANTILES
    ),
    "price_quantiles_by_flag": " UNION ALL ".join(
        f"""SELECT l_returnflag, CAST({p} AS DOUBLE) AS prob,
                   {r(f'quantile_cont(l_extendedprice, {p})', 'quantile')} FROM lineitem GROUP BY 1"""
        for p in QUANTILES
    ),
    "price_quantiles_by_order": " UNION ALL ".join(
        f"""SELECT l_orderkey, CAST({p} AS DOUBLE) AS prob,
                   {r(f'quantile_cont(l_extendedprice, {p})', 'quantile')} FROM lineitem GROUP BY 1"""
        for p in (0.05, 0.5, 0.9)
    ),
    "hexbin_density": _hexbin("test", 60, 34, 30.0, 1),
    "hexbin_items": _hexbin(
        """(SELECT l_quantity AS departures,
                   l_extendedprice * (1 - l_discount) / 10000.0::DOUBLE AS pred FROM lineitem)""",
        30, 17, 40.0, 2,
    ),
    "total_series": sql(f"SELECT {text('datetime')}, departures, {r('pred')} FROM series"),
    "daily_totals": sql(f"SELECT {text('day')}, departures, {r('pred')} FROM daily"),
    "daily_order_totals": f"""
        SELECT {text('day')}, coalesce(n, 0) AS departures, {r('coalesce(p, 0)', 'pred')}
        FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE)
                     AS day FROM orders)
        LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(round(o_totalprice, 0)) AS p
                   FROM orders GROUP BY 1) USING (day)""",
    "daily_error": sql(
        f"""SELECT {r('sqrt(avg((pred - departures) ** 2))', 'rmse')},
                   {r('avg(abs(pred - departures))', 'mae')}, count(*) AS n FROM daily"""
    ),
    "focus_entity": sql(f"SELECT station_id, station_name, {r('mean_demand')}, n FROM focus"),
    "focus_series": sql(
        f"""SELECT station_id, station_name, {text('datetime')}, CAST(departures AS BIGINT) AS departures,
                   {r('pred')} FROM focus_rows"""
    ),
    "focus_error": sql(
        f"""SELECT {r('sqrt(avg((pred - departures) ** 2))', 'rmse')},
                   {r('avg(abs(pred - departures))', 'mae')}, count(*) AS n FROM focus_rows"""
    ),
    **{
        name: sql(
            f"""SELECT station_id, {text('datetime')}, CAST(departures AS BIGINT) AS departures
                FROM (SELECT * FROM features WHERE split = 'train'
                      ORDER BY md5({SAMPLE_KEY}), station_id, datetime LIMIT {n})"""
        )
        for name, n in {"uniform_sample": 5000, "nested_sample": 1000}.items()
    },
    "sampled_line_items": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem
        ORDER BY md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|7'),
                 l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20000""",
    "standardized_inputs": sql(
        "SELECT station_id, {}, {} FROM few CROSS JOIN stats WHERE split = 'test'".format(
            text("datetime"),
            ", ".join(
                r(f"({c} - {c}_m) / {c}_s", c) for c in ("temperature", "lag_1h", "lag_24h", "start_lat")
            ),
        ),
        """few AS MATERIALIZED (SELECT station_id, datetime, split, temperature, lag_1h, lag_24h, start_lat
                                 FROM model_rows WHERE split IN ('train', 'test')),
           stats AS MATERIALIZED (SELECT {} FROM few WHERE split = 'train')""".format(
            ", ".join(
                f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s"
                for c in ("temperature", "lag_1h", "lag_24h", "start_lat")
            )
        ),
    ),
    "tree_gains": _tree_gains(("hour_of_day", "day_of_week", "is_weekend", "is_holiday", "lag_1h", "lag_2h", "lag_24h")),
    "boost_closed_form": sql(
        # Each round moves a group's mean residual m by step * soft(n m, l1) / (n + l2): a geometric series
        # towards l1 / n, as long as n |m| stays above l1.
        f"""SELECT CAST(is_weekend AS BIGINT) AS is_weekend, n,
                   {r("""1000 * (mean + (m - CASE WHEN n * abs(m) > 2 THEN sign(m) * 2.0::DOUBLE / n ELSE m END)
                         * (1 - power(1 - 0.3::DOUBLE * n / (n + 50), 7)))""", 'prediction')}
            FROM moved""",
        """groups AS MATERIALIZED (SELECT is_weekend, count(*) AS n, avg(departures) AS y
                                   FROM features WHERE split = 'train' GROUP BY 1),
           moved AS (SELECT is_weekend, n, y - mean AS m, mean
                     FROM groups CROSS JOIN (SELECT sum(n * y) / sum(n) AS mean FROM groups))""",
    ),
    "ridge_scores": _ridge_all(1.0),
    "ridge_one_input": _ridge(True),
    "ridge_one_input_unscaled": _ridge(False),
    "learning_curve": sql(
        """SELECT 'ridge' AS model, round(fraction, 2) AS fraction, n_rows,
                  round(sqrt(avg((p - departures) ** 2) FILTER (WHERE split = 'val')), 4) AS val_rmse,
                  round(sqrt(avg((p - departures) ** 2) FILTER (WHERE split = 'test')), 4) AS test_rmse
           FROM (SELECT fraction, n_rows, split, departures, greatest(0, my + w * (lag_24h - mx)) AS p
                 FROM fits CROSS JOIN (SELECT * FROM features WHERE split <> 'train'))
           GROUP BY fraction, n_rows""",
        f"""
        ranked AS (SELECT departures, lag_24h,
                          row_number() OVER (ORDER BY md5({SAMPLE_KEY}), station_id, datetime) AS k
                   FROM features WHERE split = 'train'),
        sizes AS (SELECT fraction, CAST(floor((SELECT count(*) FROM ranked) * fraction) AS BIGINT) AS n_rows
                  FROM fractions),
        fits AS (SELECT fraction, n_rows, avg(departures) AS my, avg(lag_24h) AS mx,
                        covar_pop(departures, lag_24h) * count(*)
                        / (var_pop(lag_24h) * count(*) + 50.0::DOUBLE) AS w
                 FROM sizes JOIN ranked ON k <= n_rows GROUP BY 1, 2)""",
    ),
}
ORACLES["dst_edges_converted"] = ORACLES["dst_edges_dropped"]
ORACLES["station_dimension_late_names"] = ORACLES["station_dimension"]
ORACLES["lagged_panel_small_blocks"] = ORACLES["lagged_panel"]
ORACLES["refreshed_panel"] = ORACLES["lagged_panel"]
