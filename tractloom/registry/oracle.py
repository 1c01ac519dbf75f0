"""The registered queries once more, as plain SQL over the test tables.

Written from the meaning of each query, not from the Spark plans: joins
instead of pre-aggregation, window functions instead of folds.
"""

from __future__ import annotations

from tractloom.fixed_values import (
    COMPLAINT_TYPES,
    INDICATORS,
    RETRY_SUFFIXES,
    SURVEY_COLUMNS,
    SURVEY_VARIABLES,
    VIOLATION_CLASSES,
)
from tractloom.registry.queries import DETAIL_AREA
from tractloom.registry.views import BLOCK_KEYS, BLOCKS, SINCE

_NUMBER = f"({{0}} // {BLOCK_KEYS}) % {BLOCKS}"
_BLOCK = f"lpad(CAST({_NUMBER} AS VARCHAR), 5, '0')"
_LOT = "CAST({0} % 5 + 1 AS VARCHAR) || " + _BLOCK + " || lpad(CAST({1} AS VARCHAR), 12, '0')"


def _title(text: str) -> str:
    word = "upper(substr(w, 1, 1)) || lower(substr(w, 2))"

    def words(value: str, gap: str) -> str:
        return f"array_to_string(list_transform(string_split({value}, '{gap}'), lambda w: {word}), '{gap}')"

    blanks = words("h", " ").replace("lambda w: " + word, "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)")
    return (
        f"array_to_string(list_transform(string_split(lower({text}), '-'), "
        f"lambda h: {blanks}), '-')"
    )


_SURVEY_COUNTS = ",\n      ".join(
    f"CAST(sum(CASE WHEN c_custkey % {n} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS {name}"
    for n, name in enumerate(SURVEY_VARIABLES, start=1)
)
_POOR = "renter_pov_fam5 + renter_pov_fam9 + renter_pov_fam12"
_NOT_POOR = "renter_nonpov_fam16 + renter_nonpov_fam20 + renter_nonpov_fam23"
_CHILDREN = "renter_child_num18 + renter_child_num22 + renter_child_num25"
_BURDEN = "CASE WHEN rent_burden_num1 <> 0 THEN nullif(rent_burden_num1 - rent_burden_num11, 0) END"
_SHARES = {
    "rent_burden_30p_pct": (
        f"(rent_burden_num7 + rent_burden_num8 + rent_burden_num9 + rent_burden_num10) / {_BURDEN}"
    ),
    "rent_burden_50p_pct": f"rent_burden_num10 / {_BURDEN}",
    "renter_fam_pov_pct": f"({_POOR}) / nullif({_POOR} + {_NOT_POOR}, 0)",
    "renter_pct": "occ_renter_units / nullif(occ_units, 0)",
    "unit_occ_rent_child_pct": f"({_CHILDREN}) / nullif(occ_renter_units, 0)",
    "renter_white_pct": "renter_white_num / nullif(occ_renter_units, 0)",
    "renter_black_pct": "renter_black_num / nullif(occ_renter_units, 0)",
    "renter_asian_pct": "renter_asian_num / nullif(occ_renter_units, 0)",
    "renter_latin_pct": "renter_latin_num / nullif(occ_renter_units, 0)",
}
_SURVEY_COLUMNS = ", ".join(f"{_SHARES[c]} AS {c}" if c in _SHARES else c for c in SURVEY_COLUMNS)


def _conditional_sums(column: str, wanted: dict[str, str]) -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN {column} = '{v}' THEN 1 WHEN {column} IS NOT NULL THEN 0 END) AS BIGINT) AS {name}"
        for name, v in wanted.items()
    )


# One common table expression per view or step, in order of dependence.
_STEPS = {
    "areas": """
      SELECT n_nationkey, n_regionkey + 1 AS borocode,
        CASE n_regionkey WHEN 0 THEN 'MN' WHEN 1 THEN 'BX' WHEN 2 THEN 'BK' WHEN 3 THEN 'QN' ELSE 'SI' END AS borough,
        '36' || CASE n_regionkey WHEN 0 THEN '061' WHEN 1 THEN '005' WHEN 2 THEN '047' WHEN 3 THEN '081' ELSE '085' END
        || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || CASE WHEN n_nationkey >= 20 THEN '01' ELSE '00' END AS geoid
      FROM nation""",
    "area_list": "SELECT geoid FROM areas WHERE n_nationkey < 15 OR n_nationkey >= 22",
    "parcels": f"""
      SELECT CAST(borocode AS VARCHAR) AS borocode, borough, {_BLOCK.format('c_custkey')} AS block, geoid
      FROM customer JOIN areas ON c_nationkey = n_nationkey""",
    "xwalk": """
      SELECT borocode, block, geoid FROM (
        SELECT *, row_number() OVER (PARTITION BY borocode, block ORDER BY geoid) AS place
        FROM parcels WHERE geoid IN (SELECT geoid FROM area_list))
      WHERE place = 1""",
    "complaints": f"""
      SELECT o_orderkey AS complaintid, o_custkey % 5 + 1 AS boroughid, {_NUMBER.format('o_custkey')} AS block,
        o_orderdate AS receiveddate
      FROM orders""",
    "problems": """
      SELECT l_orderkey AS complaintid,
        CASE l_returnflag || l_linestatus WHEN 'NF' THEN 'NON EMERGENCY' WHEN 'AF' THEN 'EMERGENCY'
          WHEN 'AO' THEN 'IMMEDIATE EMERGENCY' WHEN 'RF' THEN 'HAZARDOUS' WHEN 'RO' THEN 'REFERRED' END AS type
      FROM lineitem""",
    "evictions": f"""
      SELECT {_LOT.format('user_id', 'event_id')} AS bbl, event_type AS residentialcommercialind FROM events""",
    "rs_before": f"""
      SELECT {_LOT.format('p_partkey', 'p_partkey')} AS ucbbl, p_size - 1 AS unitsstab2007 FROM part""",
    "rs_after": f"""
      SELECT {_LOT.format('l_partkey', 'l_partkey')} AS ucbbl, CAST(min(l_quantity) AS INTEGER) AS uc2018
      FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey""",
    "i_complaints": f"""
      SELECT geoid, {_conditional_sums('type', COMPLAINT_TYPES)}
      FROM complaints LEFT JOIN problems USING (complaintid)
      JOIN xwalk x ON CAST(x.borocode AS INTEGER) = boroughid AND CAST(x.block AS INTEGER) = complaints.block
      WHERE receiveddate >= DATE '{SINCE}' GROUP BY geoid""",
    "i_violations": f"""
      SELECT geoid, {_conditional_sums("translate(l_returnflag, 'ANR', 'ABC')", VIOLATION_CLASSES)}
      FROM lineitem
      JOIN xwalk x ON CAST(x.borocode AS INTEGER) = l_partkey % 5 + 1
        AND CAST(x.block AS INTEGER) = {_NUMBER.format('l_partkey')}
      WHERE l_shipdate >= DATE '{SINCE}' GROUP BY geoid""",
    "i_evictions": """
      SELECT geoid, count(*) AS marsh_evic_num
      FROM evictions JOIN xwalk x ON x.borocode || x.block = substr(bbl, 1, 6)
      WHERE residentialcommercialind = 'purchase' GROUP BY geoid""",
    "i_dereg": """
      SELECT geoid, CAST(sum(unitsstab2007 - uc2018) AS DOUBLE) AS dereg_units,
        CAST(sum(unitsstab2007 - uc2018) AS DOUBLE) / CAST(sum(unitsstab2007) AS DOUBLE) AS dereg_pct
      FROM rs_before LEFT JOIN rs_after USING (ucbbl)
      JOIN xwalk x ON x.borocode || x.block = substr(ucbbl, 1, 6)
      WHERE unitsstab2007 > 0 AND uc2018 <= unitsstab2007 GROUP BY geoid""",
    "indicators": """
      SELECT * FROM i_complaints FULL JOIN i_violations USING (geoid)
      FULL JOIN i_evictions USING (geoid) FULL JOIN i_dereg USING (geoid)""",
    "estimates": f"""
      SELECT geoid, {_SURVEY_COUNTS}
      FROM customer JOIN areas ON c_nationkey = n_nationkey GROUP BY geoid""",
    "ratios": f"SELECT geoid, {_SURVEY_COLUMNS} FROM estimates",
    "members": """
      SELECT CAST(c_custkey AS VARCHAR) AS uid, c_name AS name,
        CASE WHEN c_custkey % 2 = 0 THEN 'they/them' END AS pronouns,
        lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone,
        CASE WHEN c_custkey % 3 <> 0 THEN 'member' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email,
        address
      FROM places WHERE c_custkey % 13 <> 5""",
    "reference": """
      SELECT CASE WHEN house % 3 = 0 THEN address ELSE address || ', queens' END AS q,
        CASE WHEN house % 17 <> 4 THEN CAST(house + copy AS VARCHAR) END AS house_number,
        c_mktsegment || '-SIDE STREET' AS street, coalesce(postcode, '11385') AS zip,
        CASE WHEN house % 19 <> 7 THEN CAST(house AS DOUBLE) / CAST(10000 AS DOUBLE) + 40 - copy END AS latitude,
        CAST(house AS DOUBLE) / CAST(10000 AS DOUBLE) - 74 + copy AS longitude
      FROM places JOIN range(2) AS r(copy) ON copy = 0 OR c_custkey % 5 = 1
      WHERE address IS NOT NULL AND house % 3 <> 2""",
    "cleaned": f"""
      SELECT *, house_number || ' ' || {_title('street')} || ', ' || zip AS clean_address FROM reference""",
    "lines": """
      SELECT c_custkey * 2 AS line, CAST(c_custkey AS VARCHAR) AS uid,
        CASE WHEN c_custkey % 20 <> 0 THEN c_acctbal END AS latitude,
        CASE WHEN c_custkey % 20 <> 0 THEN c_acctbal END AS longitude
      FROM customer WHERE c_custkey % 10 = 0
      UNION ALL
      SELECT c_custkey * 2 + 1, CAST(c_custkey AS VARCHAR), c_acctbal + 1, c_acctbal - 1
      FROM customer WHERE c_custkey % 30 = 0""",
    "manual": """
      SELECT uid, latitude, longitude FROM (
        SELECT *, row_number() OVER (PARTITION BY uid ORDER BY line) AS place FROM lines)
      WHERE place = 1""",
    "pending": """
      SELECT * FROM members WHERE address IS NOT NULL AND uid NOT IN (SELECT uid FROM manual)""",
    "answers": """
      SELECT q, clean_address, latitude, longitude FROM (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY latitude NULLS FIRST, longitude NULLS FIRST,
          clean_address NULLS FIRST) AS place
        FROM cleaned WHERE latitude IS NOT NULL)
      WHERE place = 1""",
    "first_pass": "SELECT pending.*, clean_address, latitude, longitude FROM pending JOIN answers ON q = address",
    "second_pass": f"""
      SELECT pending.*, clean_address, latitude, longitude
      FROM pending JOIN answers ON q = address || '{RETRY_SUFFIXES[1]}'
      WHERE uid NOT IN (SELECT uid FROM first_pass)""",
    "placed": """
      SELECT members.*, NULL AS clean_address, latitude, longitude FROM members JOIN manual USING (uid)
      UNION ALL SELECT * FROM first_pass UNION ALL SELECT * FROM second_pass""",
    "located": """
      SELECT uid, name, coalesce(pronouns, '-') AS pronouns, phone, coalesce(email, '-') AS email,
        coalesce(clean_address, address, '-') AS address, latitude, longitude
      FROM placed WHERE latitude IS NOT NULL""",
    "work_list": """
      SELECT uid, address FROM pending
      WHERE uid NOT IN (SELECT uid FROM first_pass) AND uid NOT IN (SELECT uid FROM second_pass)""",
}

_STEPS = {
    "places": """
      SELECT *, CASE WHEN street_line IS NOT NULL THEN street_line || ', ' || coalesce(postcode, 'QN') END AS address
      FROM (
        SELECT *, c_custkey // 2 AS house,
          CASE WHEN c_custkey % 11 <> 3
            THEN CAST(c_custkey // 2 AS VARCHAR) || ' ' || c_mktsegment || ' ST' END AS street_line,
          CASE WHEN c_custkey % 7 <> 2 THEN CAST(c_nationkey + 11000 AS VARCHAR) END AS postcode
        FROM customer)""",
    **_STEPS,
}

_COUNTS = [*COMPLAINT_TYPES, *VIOLATION_CLASSES, "marsh_evic_num"]
_RECORDS = [*COMPLAINT_TYPES, *VIOLATION_CLASSES, "marsh_evic_num", "dereg_units", "dereg_pct"]


def _rates(columns: list[str]) -> str:
    return ", ".join(
        f"CAST({c} AS DOUBLE) / nullif(occ_renter_units, 0) * 100 AS {c.removesuffix('num')}rt" for c in columns
    )


def _doubles(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


_STEPS["wide"] = f"""
      SELECT ratios.geoid, {', '.join(f'ratios.{c}' for c in SURVEY_COLUMNS)}, {_doubles(_RECORDS)},
        {_rates(['pop_num', *_COUNTS])}
      FROM ratios LEFT JOIN indicators USING (geoid) WHERE ratios.geoid IN (SELECT geoid FROM area_list)"""
_STEPS["cells"] = "SELECT geoid, name, value FROM wide UNPIVOT INCLUDE NULLS (value FOR name IN (* EXCLUDE (geoid)))"
_STEPS["meta"] = (
    'SELECT * FROM (VALUES '
    + ", ".join(f"({o}, '{g}', '{n}', '{d}', '{f}')" for o, g, n, d, f in INDICATORS)
    + ') AS t("order", var_group, var_name, display_name, val_fmt)'
)
_STEPS["details"] = """
      SELECT a.geoid, m."order", m.var_group, m.display_name,
        coalesce(CASE m.val_fmt
          WHEN 'num' THEN format('{:,.0f}', c.value) WHEN 'rt' THEN format('{:,.1f}', c.value)
          WHEN 'pct' THEN format('{:,.1f}', c.value * 100) || '%'
          WHEN 'cur' THEN CASE WHEN c.value < 0 THEN '-$' ELSE '$' END || format('{:,.0f}', abs(c.value)) END,
          '—') AS value_text
      FROM wide a CROSS JOIN meta m LEFT JOIN cells c ON c.geoid = a.geoid AND c.name = m.var_name"""
_STEPS["menu"] = """
      SELECT p_partkey AS "order", 'v' || CAST(p_partkey AS VARCHAR) AS var_name, p_name AS display_name,
        CASE p_size WHEN 1 THEN 'Totals' WHEN 2 THEN 'Totals (2014-18)'
          ELSE p_type || ' (a) and ' || p_brand || ' (b)' END AS var_group
      FROM part"""


def _with(body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in _STEPS.items()) + "\n" + body


def _scale(direction: str) -> str:
    position = "(marsh_evic_num - low) / nullif(high - low, 0)"
    return _with(
        f"""SELECT geoid, marsh_evic_num AS value,
          CASE WHEN marsh_evic_num IS NULL THEN NULL WHEN low = high THEN 0.5
            ELSE {direction.format(position)} END AS pos,
          marsh_evic_num IS NULL AS is_missing
        FROM wide CROSS JOIN (SELECT min(marsh_evic_num) AS low, max(marsh_evic_num) AS high FROM wide) AS d"""
    )


_ESTIMATES_AND_MARGINS = ", ".join(f"{n} AS {n}E, {n} / 10 AS {n}M" for n in SURVEY_VARIABLES)
_INDICATOR_COLUMNS = "SELECT geoid, " + ", ".join(_RECORDS) + " FROM indicators"

ORACLE_SQL = {
    "area_indicators": _with("SELECT * FROM wide"),
    "src_area_list": _with("SELECT DISTINCT geoid FROM parcels WHERE geoid IN (SELECT geoid FROM area_list)"),
    "geoid_key": _with("SELECT borocode, block, geoid FROM parcels"),
    "geoid_key_borough": _with(
        "SELECT borocode, block, geoid, count(*) AS n_parcels FROM parcels WHERE borough = 'QN' GROUP BY ALL"
    ),
    "filter_semi_in_list": _with(
        "SELECT borocode, block, geoid FROM parcels WHERE geoid IN (SELECT geoid FROM area_list)"
    ),
    "crosswalk": _with("SELECT borocode, block, geoid FROM xwalk"),
    "ind_complaints": _with("SELECT * FROM i_complaints"),
    "ind_violations": _with("SELECT * FROM i_violations"),
    "ind_evictions": _with("SELECT * FROM i_evictions"),
    "ind_dereg": _with("SELECT * FROM i_dereg"),
    "full_join_indicators": _with(_INDICATOR_COLUMNS),
    "merged_indicators": _with(_INDICATOR_COLUMNS),
    "summed_indicators": _with(_INDICATOR_COLUMNS),
    "daily_sums": _with(
        f"""SELECT geoid, day, {', '.join([*COMPLAINT_TYPES, *VIOLATION_CLASSES])} FROM (
          SELECT geoid, CAST(receiveddate AS DATE) AS day, {_conditional_sums('type', COMPLAINT_TYPES)}
          FROM complaints LEFT JOIN problems USING (complaintid)
          JOIN xwalk x ON CAST(x.borocode AS INTEGER) = boroughid AND CAST(x.block AS INTEGER) = complaints.block
          WHERE receiveddate IS NOT NULL GROUP BY ALL)
        FULL JOIN (
          SELECT geoid, CAST(l_shipdate AS DATE) AS day,
            {_conditional_sums("translate(l_returnflag, 'ANR', 'ABC')", VIOLATION_CLASSES)}
          FROM lineitem
          JOIN xwalk x ON CAST(x.borocode AS INTEGER) = l_partkey % 5 + 1
            AND CAST(x.block AS INTEGER) = {_NUMBER.format('l_partkey')}
          WHERE l_shipdate IS NOT NULL GROUP BY ALL) USING (geoid, day)"""
    ),
    "join_left_fanout": _with(
        """SELECT CAST(boroughid AS INTEGER) AS boroughid, type, count(*) AS n_rows
        FROM complaints LEFT JOIN problems USING (complaintid) GROUP BY boroughid, type"""
    ),
    "join_prefix_key": _with(
        """SELECT bbl, residentialcommercialind, geoid
        FROM evictions JOIN xwalk x ON x.borocode || x.block = substr(bbl, 1, 6)"""
    ),
    "pivot_estimates": _with(f"SELECT geoid, {_ESTIMATES_AND_MARGINS} FROM estimates"),
    "proj_rename_pattern": _with("SELECT * FROM estimates"),
    "acs_ratios": _with("SELECT * FROM ratios"),
    "rate_across": _with(
        f"""SELECT e.geoid, occ_renter_units, {_doubles(_RECORDS)}, {_rates(_COUNTS)}
        FROM estimates e LEFT JOIN indicators USING (geoid)"""
    ),
    "unpivot_indicators": _with("SELECT * FROM cells"),
    "manual_dedupe": """
        SELECT o_custkey AS uid, o_orderkey AS line, o_orderdate, o_totalprice FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
        WHERE place = 1""",
    "manual_overrides": _with("SELECT * FROM manual"),
    "anti_join_chain": _with("SELECT uid, address FROM pending WHERE uid NOT IN (SELECT uid FROM first_pass)"),
    "address_clean": _with("SELECT q, coalesce(clean_address, q) AS address, clean_address FROM cleaned"),
    "address_parts": _with("SELECT CAST(c_custkey AS VARCHAR) AS uid, address FROM places"),
    "geocode_pass": _with("SELECT uid, address, clean_address, latitude, longitude FROM first_pass"),
    "union_by_name_fill": _with(
        """SELECT uid, address, latitude, longitude, NULL AS clean_address FROM members JOIN manual USING (uid)
        UNION ALL SELECT uid, address, latitude, longitude, clean_address FROM first_pass"""
    ),
    "geocode_members": _with("SELECT * FROM located"),
    "geocode_outcomes": _with(
        """SELECT outcome, count(*) AS n_members FROM (
          SELECT CASE WHEN manual.uid IS NOT NULL AND manual.latitude IS NOT NULL THEN 'override'
            WHEN manual.uid IS NOT NULL THEN 'blank override' WHEN members.address IS NULL THEN 'no address'
            WHEN f.uid IS NOT NULL THEN 'attempt 1' WHEN s.uid IS NOT NULL THEN 'attempt 2'
            ELSE 'unresolved' END AS outcome
          FROM members LEFT JOIN manual USING (uid) LEFT JOIN first_pass f USING (uid)
          LEFT JOIN second_pass s USING (uid))
        GROUP BY outcome"""
    ),
    "unresolved_worklist": _with("SELECT uid, address, '' AS latitude, '' AS longitude FROM work_list"),
    "fill_strings": _with(
        """SELECT uid, name, coalesce(pronouns, '-') AS pronouns, phone, coalesce(email, '-') AS email,
          coalesce(address, '-') AS address, CAST(nullif(length(uid), 3) AS INTEGER) AS number
        FROM members"""
    ),
    "member_points": _with("SELECT uid, name, address, longitude AS x, latitude AS y FROM located"),
    "variable_menu": _with(
        """SELECT "order", regexp_replace(var_group, '\\s\\(.*?\\)', '', 'g') || ': ' || display_name AS label, var_name
        FROM menu WHERE var_group <> 'Totals'"""
    ),
    "choropleth_scale": _scale("{0}"),
    "choropleth_reversed": _scale("1 - {0}"),
    "choropleth_layers": _with(
        """SELECT name, geoid, value, CASE WHEN value IS NULL THEN NULL WHEN low = high THEN 0.5
          ELSE (value - low) / (high - low) END AS pos, value IS NULL AS is_missing
        FROM cells JOIN (SELECT name, min(value) AS low, max(value) AS high FROM cells GROUP BY name) USING (name)"""
    ),
    "choropleth_legend": _with(
        "SELECT DISTINCT marsh_evic_num AS value FROM wide WHERE marsh_evic_num IS NOT NULL"
    ),
    "legend_breaks": _with(
        """SELECT CAST(place AS DOUBLE) * step AS value FROM (
          SELECT *, unnest(range(CAST(ceil(low / step) AS BIGINT), CAST(floor(high / step) AS BIGINT) + 1)) AS place
          FROM (SELECT *, CASE WHEN low = high THEN 1 ELSE base * CASE WHEN rough <= base THEN 1
              WHEN rough <= 2 * base THEN 2 WHEN rough <= 5 * base THEN 5 ELSE 10 END END AS step
            FROM (SELECT *, power(10, floor(log10(rough))) AS base
              FROM (SELECT min(marsh_evic_num) AS low, max(marsh_evic_num) AS high,
                (max(marsh_evic_num) - min(marsh_evic_num)) / 5 AS rough FROM wide))))"""
    ),
    "undescribed_columns": _with(
        """SELECT * FROM (SELECT "order", var_group, var_name, display_name FROM meta
          UNION ALL SELECT CAST("order" AS INTEGER), var_group, var_name, display_name FROM menu)
        WHERE var_name NOT IN (SELECT name FROM cells)"""
    ),
    "detail_table": _with("SELECT * FROM details"),
    "detail_table_area": _with(
        f"""SELECT "order", var_group, display_name, value_text FROM details WHERE geoid = '{DETAIL_AREA}'"""
    ),
}
