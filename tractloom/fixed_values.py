"""Fixed values that decide results: codes, names, labels and formats.

They are stated as plain text, in their natural order, because the published
city and census tables use exactly these codes.
"""

from __future__ import annotations

import datetime

# State code, and county code per borough number.
STATE = "36"
BOROUGH_COUNTIES = {
    "1": "061",
    "2": "005",
    "3": "047",
    "4": "081",
    "5": "085",
}

# Widths of the block and tract parts of a key.
BLOCK_WIDTH = 5
TRACT_WIDTH = 6
BLOCK_KEY_WIDTH = 6

# The slice of the source tables that is counted.
BOROUGH = "QN"
SURVEY_COUNTY = "081"
SINCE = datetime.date(2019, 1, 1)
RESIDENTIAL = "RESIDENTIAL"
RATE_BASE = 100

# Indicator column -> complaint problem type.
COMPLAINT_TYPES = {
    "comp_nonemerg_num": "NON EMERGENCY",
    "comp_emerg_num": "EMERGENCY",
    "comp_immed_num": "IMMEDIATE EMERGENCY",
    "comp_haz_num": "HAZARDOUS",
}

# Indicator column -> violation class.
VIOLATION_CLASSES = {
    "viol_a_num": "A",
    "viol_b_num": "B",
    "viol_c_num": "C",
}

# Column name -> census table cell.
SURVEY_VARIABLES = {
    "pop_num": "B01001_001",
    "occ_units": "B25003_001",
    "occ_renter_units": "B25003_003",
    "occ_renter_pop": "B25008_003",
    "gross_rent_med": "B25064_001",
    "renter_hh_inc_med": "B25119_003",
    "renter_pov_fam5": "B17019_005",
    "renter_pov_fam9": "B17019_009",
    "renter_pov_fam12": "B17019_012",
    "renter_nonpov_fam16": "B17019_016",
    "renter_nonpov_fam20": "B17019_020",
    "renter_nonpov_fam23": "B17019_023",
    "renter_white_num": "B25003H_003",
    "renter_black_num": "B25003B_003",
    "renter_asian_num": "B25003D_003",
    "renter_latin_num": "B25003I_003",
    "renter_child_num18": "B25115_018",
    "renter_child_num22": "B25115_022",
    "renter_child_num25": "B25115_025",
    "rent_burden_num1": "B25070_001",
    "rent_burden_num7": "B25070_007",
    "rent_burden_num8": "B25070_008",
    "rent_burden_num9": "B25070_009",
    "rent_burden_num10": "B25070_010",
    "rent_burden_num11": "B25070_011",
}

# Survey columns of the finished table, in output order.
SURVEY_COLUMNS = [
    "occ_units",
    "pop_num",
    "occ_renter_units",
    "occ_renter_pop",
    "gross_rent_med",
    "renter_hh_inc_med",
    "rent_burden_30p_pct",
    "rent_burden_50p_pct",
    "renter_fam_pov_pct",
    "renter_pct",
    "unit_occ_rent_child_pct",
    "renter_white_pct",
    "renter_black_pct",
    "renter_asian_pct",
    "renter_latin_pct",
]

# Columns of the raw member table.
RAW_MEMBER_COLUMNS = ["id", "Name", "Pronouns", "Phone Number", "E-Mail", "Address", "Zip code"]

# What the address cascade appends and fills in.
DEFAULT_ZIP = "QN"
RETRY_SUFFIXES = ("", ", queens")
EMPTY_TEXT = "-"
MISSING_TEXT = "—"
TOTALS_GROUP = "Totals"

# Order, var_group, var_name, display_name, val_fmt.
INDICATORS = [
    (0, "Totals (2014-18)", "occ_units", "Total Units", "num"),
    (1, "Totals (2014-18)", "pop_num", "Total Population", "num"),
    (2, "Renters (2014-18)", "occ_renter_units", "Renter Units", "num"),
    (3, "Renters (2014-18)", "renter_pct", "Renter % of Units", "pct"),
    (4, "Renters (2014-18)", "occ_renter_pop", "Renter Population", "num"),
    (5, "Renters (2014-18)", "renter_hh_inc_med", "Median Renter Household Income", "cur"),
    (6, "Renters (2014-18)", "renter_fam_pov_pct", "Renter Poverty Rate", "pct"),
    (7, "Renters (2014-18)", "gross_rent_med", "Median Gross Rent", "cur"),
    (8, "Renters (2014-18)", "rent_burden_30p_pct", "Rent/Income Ratio 30%+", "pct"),
    (9, "Renters (2014-18)", "rent_burden_50p_pct", "Rent/Income Ratio 50%+", "pct"),
    (10, "Renters (2014-18)", "renter_white_pct", "Renter % White", "pct"),
    (11, "Renters (2014-18)", "renter_black_pct", "Renter % Black", "pct"),
    (12, "Renters (2014-18)", "renter_asian_pct", "Renter % Asian", "pct"),
    (13, "Renters (2014-18)", "renter_latin_pct", "Renter % Latino", "pct"),
    (14, "Renters (2014-18)", "unit_occ_rent_child_pct", "Renter % with Children", "pct"),
    (15, "HPD Complaints (2019)", "comp_nonemerg_num", "Non-Emergency Number", "num"),
    (16, "HPD Complaints (2019)", "comp_nonemerg_rt", "Non-Emergency Rate", "rt"),
    (17, "HPD Complaints (2019)", "comp_emerg_num", "Emergency Number", "num"),
    (18, "HPD Complaints (2019)", "comp_emerg_rt", "Emergency Rate", "rt"),
    (19, "HPD Complaints (2019)", "comp_immed_num", "Immediate Emergency Number", "num"),
    (20, "HPD Complaints (2019)", "comp_immed_rt", "Immediate Emergency Rate", "rt"),
    (21, "HPD Complaints (2019)", "comp_haz_num", "Hazardous Number", "num"),
    (22, "HPD Complaints (2019)", "comp_haz_rt", "Hazardous Rate", "rt"),
    (23, "HPD Violations (2019)", "viol_a_num", "Non-Hazardous Number", "num"),
    (24, "HPD Violations (2019)", "viol_a_rt", "Non-Hazardous Rate", "rt"),
    (25, "HPD Violations (2019)", "viol_b_num", "Hazardous Number", "num"),
    (26, "HPD Violations (2019)", "viol_b_rt", "Hazardous Rate", "rt"),
    (27, "HPD Violations (2019)", "viol_c_num", "Immediately Hazardous Number", "num"),
    (28, "HPD Violations (2019)", "viol_c_rt", "Immediately Hazardous Rate", "rt"),
    (29, "Deregulated Units (2007-18)", "dereg_units", "Deregulated Units Number", "num"),
    (30, "Deregulated Units (2007-18)", "dereg_pct", "Deregulated Units Percent", "pct"),
    (31, "Marshall Evictions (2019)", "marsh_evic_num", "Marshall Eviction Number", "num"),
    (32, "Marshall Evictions (2019)", "marsh_evic_rt", "Marshall Eviction Rate", "rt"),
]
