"""SQL of each query for an independent engine, over the same test tables."""

from __future__ import annotations

import math

from sentria.sources.star_views import with_views

SINCE = 19961
MARGIN = 1700
Z = 1.959963984540054
# The component is in bits below, the master tables are in natural units.
LN2 = 0.6931471805599453

_IN_BRANDS = "DRUGNAME IN ('Brand#2 ECONOMY', 'Brand#17 ECONOMY', 'Brand#9 STANDARD')"
_IN_INGREDIENTS = "IN ('Brand#3', 'Brand#12')"
_IN_DRUGS = "IN ('Brand#5', 'Brand#6', 'Brand#20')"
_TERM_MATCH = (
    "(PT_NAME_ENG IN ('Supplier#000000004', 'Supplier#000000027', 'SMQ 0') "
    "OR SMQ IN ('Supplier#000000004', 'Supplier#000000027', 'SMQ 0'))"
)
_IN_SOCS = "SOC_NAME_ENG IN ('ASIA', 'EUROPE')"
_SERIOUS = "SERIOUSNESS_ENG = 'Yes' AND (DEATH IS NULL OR DEATH = 2)"
_COHORT = f"cohort AS (SELECT * FROM fact WHERE PT_NAME_ENG IS NOT NULL AND quarter >= {SINCE})"


def _age_group(age: str, unknown: str) -> str:
    return (
        f"CASE WHEN {age} IS NULL THEN '{unknown}' WHEN {age} <= 25.0/365 THEN 'Neonate' WHEN {age} < 1 THEN 'Infant' "
        f"WHEN {age} < 13 THEN 'Child' WHEN {age} < 18 THEN 'Adolescent' WHEN {age} <= 65 THEN 'Adult' ELSE 'Elderly' END"
    )


def _ct(counts: str, by: str = "") -> str:
    """Contingency CTE ``ct`` from a count CTE with columns drug_code, event_effect, n11."""
    lead = f"{by}, " if by else ""
    total = f"PARTITION BY {by}" if by else ""
    return (
        f"ct AS (SELECT {lead}drug_code, event_effect, CAST(n11 AS BIGINT) AS n11, "
        f"CAST(sum(n11) OVER (PARTITION BY {lead}drug_code) AS BIGINT) AS n1_, "
        f"CAST(sum(n11) OVER (PARTITION BY {lead}event_effect) AS BIGINT) AS n_1, "
        f"CAST(sum(n11) OVER ({total}) AS BIGINT) AS N FROM {counts})"
    )


_PT_COUNTS = (
    "pairs AS (SELECT DRUGNAME AS drug_code, PT_NAME_ENG AS event_effect, count(*) AS n11 FROM "
    "(SELECT DISTINCT REPORT_ID, DRUGNAME FROM report_drug) d JOIN (SELECT DISTINCT REPORT_ID, PT_NAME_ENG FROM reactions) r "
    "USING (REPORT_ID) GROUP BY 1, 2)"
)


def _fact_counts(level: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"{_COHORT}, pairs AS (SELECT {lead}ing AS drug_code, {level} AS event_effect, count(DISTINCT REPORT_ID) AS n11 "
        f"FROM cohort WHERE {level} IS NOT NULL GROUP BY {lead}ing, {level})"
    )


def _cells(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"cells AS (SELECT {lead}drug_code, event_effect, n11, n1_, n_1, N, CAST(n1_ - n11 AS DOUBLE) AS n10, "
        "CAST(n_1 - n11 AS DOUBLE) AS n01, CAST(N - n1_ - n_1 + n11 AS DOUBLE) AS n00, "
        "CAST(n1_ AS DOUBLE) * n_1 / N AS expected_count FROM ct)"
    )


def _ratio(name: str, ratio: str, variance: str) -> str:
    """CTE with a ratio statistic and its bounds, keeping every earlier column."""
    return (
        f"{name}_0 AS (SELECT *, {ratio} AS {name}, {variance} AS var_log{name} FROM {{prev}}), "
        f"{name}_t AS (SELECT *, ln({name}) AS log{name}, "
        f"ln({name}) - {Z} * sqrt(var_log{name}) AS LB95_log{name}, ln({name}) + {Z} * sqrt(var_log{name}) AS UB95_log{name}, "
        f"exp(ln({name}) - {Z} * sqrt(var_log{name})) AS LB95_{name}, exp(ln({name}) + {Z} * sqrt(var_log{name})) AS UB95_{name} "
        f"FROM {name}_0)"
    )


_PRR = _ratio("PRR", "(CAST(n11 AS DOUBLE) / n1_) / (n01 / (n01 + n00))", "1.0e0/n11 - 1.0e0/n1_ + 1.0e0/n01 - 1.0e0/(n01 + n00)")
_ROR = _ratio("ROR", "n11 * n00 / (n10 * n01)", "1.0e0/n11 + 1.0e0/n10 + 1.0e0/n01 + 1.0e0/n00")
_RRR = _ratio("RRR", "CAST(n11 AS DOUBLE) * N / (CAST(n1_ AS DOUBLE) * n_1)", "1.0e0/n11 - 1.0e0/n1_ + 1.0e0/n_1 - 1.0e0/N")


def _ratio_columns(name: str) -> list[str]:
    log = f"log{name}"
    return [name, log, f"var_{log}", f"LB95_{log}", f"UB95_{log}", f"LB95_{name}", f"UB95_{name}"]


def _r4(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


_CELL_KEYS = "drug_code, event_effect, n11, n1_, n_1, N, n10, n01, n00"

# Exact test: the tail of the hypergeometric distribution by log-gamma terms.
# For an odds ratio other than 1 the whole support is weighted.


def _log_pmf(k: str) -> str:
    def choose(n: str, r: str) -> str:
        return f"lgamma({n} + 1.0e0) - lgamma({r} + 1.0e0) - lgamma({n} - {r} + 1.0e0)"

    return f"{choose('n_1', k)} + {choose('(N - n_1)', f'(n1_ - {k})')} - ({choose('N', 'n1_')})"


def _fisher(or0: float = 1.0, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    low, high = "greatest(0, n1_ + n_1 - N)", "least(n1_, n_1)"
    weight = f"exp({_log_pmf('k')} + (k - n11) * ln({or0}e0))"
    return (
        f"support AS (SELECT {lead}drug_code, event_effect, n11, n1_, n_1, N, CAST(unnest(range({low}, {high} + 1)) AS DOUBLE) AS k FROM ct), "
        f"weights AS (SELECT {lead}drug_code, event_effect, n11, k, {weight} AS w FROM support), "
        f"fisher AS (SELECT {lead}drug_code, event_effect, n11, "
        "sum(CASE WHEN k >= n11 THEN w ELSE 0 END) / sum(w) AS RFET, "
        "(sum(CASE WHEN k >= n11 THEN w ELSE 0 END) - 0.5 * sum(CASE WHEN k = n11 THEN w ELSE 0 END)) / sum(w) AS midRFET "
        f"FROM weights GROUP BY {lead}drug_code, event_effect, n11)"
    )


# Digamma and trigamma by recurrence to x + 12 and the asymptotic series.
_STEPS = 12


def _digamma(x: str) -> str:
    below = " + ".join(f"1.0e0/({x} + {k})" for k in range(_STEPS))
    y = f"({x} + {_STEPS})"
    return f"(ln({y}) - 0.5e0/{y} - 1.0e0/(12*{y}*{y}) + 1.0e0/(120*pow({y},4)) - 1.0e0/(252*pow({y},6)) + 1.0e0/(240*pow({y},8)) - ({below}))"


def _trigamma(x: str) -> str:
    below = " + ".join(f"1.0e0/(({x} + {k})*({x} + {k}))" for k in range(_STEPS))
    y = f"({x} + {_STEPS})"
    return f"(1.0e0/{y} + 0.5e0/({y}*{y}) + 1.0e0/(6*pow({y},3)) - 1.0e0/(30*pow({y},5)) + 1.0e0/(42*pow({y},7)) - 1.0e0/(30*pow({y},9)) + ({below}))"


def _phi(z: str, steps: int = 200) -> str:
    """Normal distribution function by Simpson's rule from 0 to z."""
    inner = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: "
        f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
        f"* exp(-0.5e0 * pow({z} * i / {steps}.0e0, 2))))"
    )
    return f"(0.5e0 + {z} / {steps * 3}.0e0 / sqrt(2.0e0 * pi()) * {inner})"


def _bcpnn(source: str, rr0: float = 1.0, carry: str = "drug_code, event_effect, n11") -> str:
    r1, p1, q1, n2 = "(n11 + 1.0e0)", "(n1_ + 1.0e0)", "(n_1 + 1.0e0)", "(N + 2.0e0)"
    rn = f"(N + {n2} * {n2} / ({q1} * {p1}))"
    return (
        f"ic_0 AS (SELECT *, ({_digamma('r1')} - {_digamma('rn')} - {_digamma('p1')} + {_digamma('n2')} - {_digamma('q1')} + {_digamma('n2')}) / ln(2.0e0) AS IC, "
        f"({_trigamma('r1')} - {_trigamma('rn')} + {_trigamma('p1')} - {_trigamma('n2')} + {_trigamma('q1')} - {_trigamma('n2')}) / pow(ln(2.0e0), 2) AS var_IC "
        f"FROM (SELECT *, {r1} AS r1, {p1} AS p1, {q1} AS q1, {n2} AS n2, {rn} AS rn FROM {source}) t), "
        f"ic_1 AS (SELECT *, IC - {Z} * sqrt(var_IC) AS LB95_IC, IC + {Z} * sqrt(var_IC) AS UB95_IC, (ln({rr0}e0) - IC) / sqrt(var_IC) AS z FROM ic_0), "
        f"ic AS (SELECT {carry}, IC, var_IC, LB95_IC, UB95_IC, {_phi('z')} AS postH0 FROM ic_1)"
    )


# Shrinkage posterior under the fixed prior of the queries.
_A1, _B1, _A2, _B2, _W = 3.0, 2.5, 40.0, 41.0, 0.3


def _nb(a: float, b: float) -> str:
    return (
        f"(lgamma(n11 + {a}e0) - {math.lgamma(a)!r} + n11 * ln(e) - (n11 + {a}e0) * ln(e + {b}e0) + {a * math.log(b)!r})"
    )


_GPS = (
    f"gps_0 AS (SELECT *, {_nb(_A1, _B1)} AS l1, {_nb(_A2, _B2)} AS l2 FROM (SELECT *, CAST(n1_ AS DOUBLE) * n_1 / N AS e FROM ct) t), "
    f"gps_1 AS (SELECT *, 1.0e0 / (1.0e0 + {(1 - _W) / _W!r} * exp(l2 - l1)) AS Q FROM gps_0)"
)
_GPS_MEANS = (
    f"SELECT drug_code, event_effect, n11, round(n11 / e, 4) AS n11_over_E, round(Q, 4) AS Q, "
    f"round(Q * (n11 + {_A1}) / (e + {_B1}) + (1 - Q) * (n11 + {_A2}) / (e + {_B2}), 4) AS postE_lambda, "
    f"round((Q * ({_digamma(f'(n11 + {_A1}e0)')} - ln(e + {_B1})) + (1 - Q) * ({_digamma(f'(n11 + {_A2}e0)')} - ln(e + {_B2}))) / ln(2.0e0), 4) AS postE_log2_lambda "
    "FROM gps_1"
)


def _gamma_cdf(a: str, x: str) -> str:
    """P(a, x) by its power series, all terms positive."""
    terms = f"CAST(ceil({x} + 12 * sqrt({x}) + 80) AS BIGINT)"
    return (
        f"list_sum(list_transform(range(0, {terms}), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1.0e0))))"
    )


_GPS_H0 = (
    f"SELECT drug_code, event_effect, n11, round(Q * {_gamma_cdf(f'(n11 + {_A1}e0)', f'(e + {_B1}e0)')} "
    f"+ (1 - Q) * {_gamma_cdf(f'(n11 + {_A2}e0)', f'(e + {_B2}e0)')}, 4) AS postH0 FROM gps_1"
)
# 5% quantile by repeated halving of [0, 2 * largest mean].
_GPS_QUANTILE = (
    "halving AS (SELECT drug_code, event_effect, n11, e, Q, 0.0e0 AS lo, "
    f"2 * greatest((n11 + {_A1}) / (e + {_B1}), (n11 + {_A2}) / (e + {_B2})) AS hi, 0 AS step FROM gps_1 "
    "UNION ALL SELECT drug_code, event_effect, n11, e, Q, CASE WHEN p < 0.05 THEN mid ELSE lo END, CASE WHEN p < 0.05 THEN hi ELSE mid END, step + 1 "
    f"FROM (SELECT *, Q * {_gamma_cdf(f'(n11 + {_A1}e0)', f'(mid * (e + {_B1}e0))')} "
    f"+ (1 - Q) * {_gamma_cdf(f'(n11 + {_A2}e0)', f'(mid * (e + {_B2}e0))')} AS p "
    "FROM (SELECT *, (lo + hi) / 2 AS mid FROM halving WHERE step < 40) s) t) "
    "SELECT drug_code, event_effect, n11, round((lo + hi) / 2, 4) AS Q05_lambda FROM halving WHERE step = 40"
)


def _calendar_series(step: str) -> str:
    counts = (
        f"count(*) FILTER (WHERE {_SERIOUS}) AS serious_excl_death, count(*) FILTER (WHERE DEATH = 1) AS death, "
        "count(*) FILTER (WHERE SERIOUSNESS_ENG = 'No') AS nonserious"
    )
    return (
        f"series AS (SELECT CAST(date_trunc('{step}', DATINTRECEIVED_CLEAN) AS DATE) AS time_p, {counts} FROM chosen GROUP BY 1), "
        f"calendar AS (SELECT CAST(unnest(generate_series(min(date_trunc('{step}', DATINTRECEIVED_CLEAN)), "
        f"max(date_trunc('{step}', DATINTRECEIVED_CLEAN)), INTERVAL 1 {step})) AS DATE) AS time_p FROM chosen) "
        "SELECT time_p, coalesce(serious_excl_death, 0) AS serious_excl_death, coalesce(death, 0) AS death, "
        "coalesce(nonserious, 0) AS nonserious FROM calendar LEFT JOIN series USING (time_p)"
    )


def _top(column: str, source: str, k: int, count: str = "count(*)", condition: str = "TRUE") -> str:
    return (
        f"SELECT {column}, {count} AS n FROM {source} WHERE {condition} GROUP BY {column} "
        f"ORDER BY n DESC, {column} LIMIT {k}"
    )


def _categories(rows: list[str], column: str, source: str, value: str = "n") -> str:
    values = ", ".join(f"('{name}', {i})" for i, name in enumerate(rows))
    return (
        f"SELECT c.{column}, CAST(c.position AS BIGINT) AS position, CAST(coalesce({value}, 0) AS BIGINT) AS {value} "
        f"FROM (VALUES {values}) c({column}, position) LEFT JOIN {source} s ON s.{column} = c.{column}"
    )


def _labels(column: str, codes: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.items())
    return f"CASE {column} {cases} END"


_REPORTERS = {1: "Physician", 2: "Pharmacist", 3: "Other health professional", 4: "Lawyer",
              5: "Consumer or non-health professional"}
_SEXES = {0: "Unknown", 1: "Male", 2: "Female"}
_OUTCOMES = {1: "Recovered/resolved", 2: "Recovering/resolving", 3: "Not recovered/not resolved",
             4: "Recovered/resolved with sequelae (consequent health issues)", 5: "Fatal", 6: "Unknown"}
_GROUPS = ["Neonate", "Infant", "Child", "Adolescent", "Adult", "Elderly"]
_ONSET = (
    "CASE patientonsetageunit WHEN '800' THEN patientonsetage * 10 WHEN '801' THEN patientonsetage "
    "WHEN '802' THEN patientonsetage / 12 WHEN '803' THEN patientonsetage / 52 "
    "WHEN '804' THEN patientonsetage / 365 WHEN '805' THEN patientonsetage / 8760 END"
)
_AGES = (
    f"ages AS (SELECT age, n, {_age_group('age', 'Not reported')} AS age_group FROM (SELECT {_ONSET} AS age, count(*) AS n "
    "FROM doc_reports WHERE patientonsetage IS NULL OR patientonsetageunit IN ('800', '801', '802', '803', '804', '805') GROUP BY 1) t)"
)
_FOUND_DOCS = (
    "found AS (SELECT REPORT_ID FROM doc_reports WHERE receivedate BETWEEN DATE '1996-03-15' AND DATE '1999-09-30')"
)
_SEARCH = (
    f"ids AS (SELECT REPORT_ID FROM reports WHERE DATINTRECEIVED_CLEAN BETWEEN DATE '1996-03-01' AND DATE '1999-09-01' "
    "AND AGE_Y BETWEEN 0 AND 100 "
    f"AND REPORT_ID IN (SELECT REPORT_ID FROM report_drug WHERE {_IN_BRANDS}) "
    "AND REPORT_ID IN (SELECT REPORT_ID FROM reactions WHERE PT_NAME_ENG <> ''))"
)


def _master(level: str) -> str:
    ratios = _ratio_columns("PRR") + _ratio_columns("ROR") + _ratio_columns("RRR")
    return (
        f"WITH {_fact_counts(level)}, {_ct('pairs')}, {_fisher()}, {_cells()}, {_PRR.format(prev='cells')}, "
        f"{_ROR.format(prev='PRR_t')}, {_RRR.format(prev='ROR_t')}, {_bcpnn('ct')} "
        f"SELECT t.drug_code, t.event_effect, t.n11 AS \"count\", t.n1_ AS drug_margin, t.n_1 AS event_margin, t.N, "
        f"{_r4('expected_count', *ratios, 'RFET', 'midRFET')}, round(IC * {LN2}, 4) AS median_IC, round(LB95_IC * {LN2}, 4) AS LB95_IC, round(UB95_IC * {LN2}, 4) AS UB95_IC, {_r4('postH0')} "
        "FROM RRR_t t JOIN fisher USING (drug_code, event_effect) JOIN ic USING (drug_code, event_effect)"
    )


def _error_rates(counts: str, order: str, scores: str = "") -> str:
    return (
        f"WITH {counts}, {_ct('pairs')}, "
        + (scores or f"{_bcpnn('ct')}, s AS (SELECT drug_code, event_effect, round(postH0, 6) AS p, round(LB95_IC, 6) AS lb FROM ic), ") +
        f"r AS (SELECT *, row_number() OVER w AS rank, sum(p) OVER w AS cum, count(*) OVER () AS m, sum(p) OVER () AS total "
        f"FROM s WINDOW w AS (ORDER BY {order}, drug_code, event_effect ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        "SELECT drug_code, event_effect, rank, round(cum / rank, 4) AS FDR, "
        "round(CASE WHEN m = rank THEN CASE WHEN 1 - p > 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 - p = 0 THEN CAST('NaN' AS DOUBLE) END "
        "ELSE ((m - rank + 1) - (total - cum + p)) / (m - rank) END, 4) AS FNR, "
        "round((rank - cum) / (m - total), 4) AS Se, round((total - cum + p) / total, 4) AS Sp FROM r"
    )


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, body: str, *views: str) -> None:
        out[name] = with_views(body, *views) if views else body

    # Sources and sinks
    add("s1_read_extract", "SELECT REPORT_ID, DATINTRECEIVED, GENDER_ENG, AGE_Y, OUTCOME_ENG FROM reports", "reports")
    add("s1_read_quoted_extract", "SELECT REPORT_ID, '\"' || OUTCOME_ENG || '\"' || chr(10) || GENDER_ENG || '$' AS NOTE, AGE_Y FROM reports", "reports")
    add("s2_read_hierarchy",
        "SELECT CAST(PT_Code AS BIGINT) AS PT_Code, CAST(HLT_Code AS BIGINT) AS HLT_Code, CAST(HLGT_Code AS BIGINT) AS HLGT_Code, "
        "CAST(SOC_Code AS BIGINT) AS SOC_Code, PT_Term, HLT_Term, HLGT_Term, SOC_Term, SOC_Abbrev, "
        "CAST(Primary_PT_SOC AS BIGINT) AS Primary_PT_SOC, Primary_SOC_flag, MEDDRA_VERSION FROM hierarchy WHERE MEDDRA_VERSION = 'v.19.0'",
        "hierarchy")
    add("s3_s4_snapshot", "SELECT * FROM reactions", "reactions")
    add("s5_write_stats",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')} SELECT drug_code, event_effect, n11, "
        "round(CAST(n11 AS DOUBLE) * N / (CAST(n1_ AS DOUBLE) * n_1), 4) AS RRR FROM ct", "fact")
    def padded(c: str) -> str:
        text = f"CAST({c} AS VARCHAR)"
        return f"chr(9) || CASE WHEN length({text}) >= 9 THEN {text} ELSE lpad({text}, 9, '0') END AS {c}"

    add("s6_export_reports",
        f"SELECT {padded('REPORT_ID')}, {padded('REPORT_NO')}, CAST(DATINTRECEIVED_CLEAN AS VARCHAR) AS DATINTRECEIVED_CLEAN, GENDER_ENG, AGE_Y, OUTCOME_ENG FROM reports", "reports")
    add("s6_export_drugs", f"SELECT {padded('REPORT_ID')}, CAST(REPORT_DRUG_ID AS VARCHAR) AS REPORT_DRUG_ID, DRUGNAME, DRUGINVOLV_ENG FROM report_drug", "report_drug")
    add("s6_export_reactions", f"SELECT {padded('REPORT_ID')}, PT_NAME_ENG, SOC_NAME_ENG FROM reactions", "reactions")
    add("s7_export_signals",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')}, {_cells()}, {_PRR.format(prev='cells')} "
        "SELECT drug_code, event_effect, n11, round(PRR, 4) AS PRR FROM PRR_t", "fact")
    add("s8_read_nested",
        "SELECT receivedate, occurcountry, CAST(patientsex AS BIGINT) AS patientsex, coalesce(d.n, 0) AS n_drug, coalesce(d.n, 0) AS n_reaction FROM doc_reports "
        "LEFT JOIN (SELECT REPORT_ID, count(*) AS n FROM doc_drugs GROUP BY 1) d USING (REPORT_ID)", "doc_reports", "doc_drugs")

    # Cleaning
    clean = (
        "CASE WHEN year({c}) % 100 > 50 THEN make_date(1900 + year({c}) % 100, month({c}), day({c})) "
        "ELSE make_date(2000 + year({c}) % 100, month({c}), day({c})) END"
    )
    a, b = clean.format(c="received"), clean.format(c="first_received")
    add("c1_clean_date",
        f"SELECT REPORT_ID, DATRECEIVED, DATINTRECEIVED, {a} AS DATRECEIVED_CLEAN, {b} AS DATINTRECEIVED_CLEAN, "
        f"CAST({a} AS VARCHAR) AS DATRECEIVED_CHAR, CAST({b} AS VARCHAR) AS DATINTRECEIVED_CHAR FROM extract_dates", "extract_dates")
    groups = f"SELECT REPORT_ID, {_age_group('AGE_Y', 'Unknown')} AS AGE_GROUP_CLEAN FROM reports"
    add("c2_age_group", groups, "reports")
    add("c3_require_complete", groups, "reports")
    add("c4_onset_age", f"SELECT REPORT_ID, {_ONSET} AS age_years FROM doc_reports", "doc_reports")
    d = "DATINTRECEIVED_CLEAN"
    add("c5_quarter",
        f"SELECT REPORT_ID, CAST(year({d}) * 10 + quarter({d}) AS BIGINT) AS quarter, CAST(year({d}) AS VARCHAR) || '.' || CAST(quarter({d}) AS VARCHAR) AS quarter_label, "
        f"CAST(date_trunc('quarter', {d}) AS DATE) AS quarter_start, CAST(year({d}) * 10 + quarter({d}) AS BIGINT) AS quarter_back FROM reports", "reports")
    add("c6_relabel",
        "SELECT REPORT_ID, CASE REPORTER_TYPE_ENG WHEN '' THEN 'Not reported' ELSE REPORTER_TYPE_ENG END AS REPORTER_TYPE_ENG, "
        "CASE GENDER_ENG WHEN '' THEN 'Not specified' ELSE GENDER_ENG END AS GENDER_ENG FROM reports", "reports")
    add("c7_pad_id", "SELECT REPORT_ID, chr(9) || CASE WHEN length(REPORT_NO) >= 9 THEN REPORT_NO ELSE lpad(REPORT_NO, 9, '0') END AS padded FROM reports", "reports")
    add("c8_norm_term", "SELECT DISTINCT upper(PT_NAME_ENG) AS term FROM reactions", "reactions")
    add("c9_drop_terms",
        "SELECT DISTINCT term FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', ',') ELSE p_name END AS term FROM part) t "
        "WHERE term NOT LIKE '%,%' AND position('%' IN term) = 0")
    add("c10_explode_ingredients", "SELECT p_brand AS ing FROM part UNION SELECT p_type FROM part")
    add("c11_round_numeric",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')}, {_cells()}, {_PRR.format(prev='cells')} SELECT drug_code, event_effect, n11, "
        + ", ".join(f"round({c}, 3) AS {c}" for c in ("expected_count", *_ratio_columns("PRR"))) + " FROM PRR_t", "fact")
    add("c12_bucket_date", f"SELECT REPORT_ID, CAST(date_trunc('month', {d}) AS DATE) AS month, CAST(date_trunc('year', {d}) AS DATE) AS year FROM reports", "reports")
    add("c13_pair_label", f"WITH {_COHORT} SELECT DISTINCT ing || '_' || PT_NAME_ENG AS label FROM cohort", "fact")
    add("c14_standardise",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')} SELECT drug_code, event_effect, n11 AS \"count\", n1_ AS drug_margin, n_1 AS event_margin, N, "
        "round(CAST(n1_ AS DOUBLE) * n_1 / N, 4) AS expected_count FROM ct", "fact")

    # Cohort search
    def reports_where(name: str, condition: str) -> None:
        add(name, f"SELECT REPORT_ID FROM reports WHERE {condition}", "reports")

    reports_where("f1_in_period", f"{d} BETWEEN DATE '1996-03-01' AND DATE '1999-09-01'")
    reports_where("f1_in_period_same_month", f"{d} BETWEEN DATE '1997-06-01' AND DATE '1999-07-01'")
    reports_where("f1_in_period_whole_months", f"{d} >= DATE '1996-03-01' AND {d} < DATE '1999-10-01'")
    reports_where("f2_serious_death", "DEATH = 1")
    reports_where("f2_serious_excl_death", _SERIOUS)
    reports_where("f3_gender", "GENDER_ENG = 'Female'")
    reports_where("f4_age_between", "AGE_Y >= 0 AND AGE_Y <= 100")
    reports_where("f4_age_open_top", "AGE_Y >= 18")
    by_product = f"DRUG_PRODUCT_ID IN (SELECT DRUG_PRODUCT_ID FROM drug_ingredients WHERE ACTIVE_INGREDIENT_NAME {_IN_INGREDIENTS})"
    add("f5_brand", f"SELECT REPORT_DRUG_ID FROM report_drug WHERE {_IN_BRANDS}", "report_drug")
    add("f6_ingredient", f"SELECT REPORT_DRUG_ID FROM report_drug WHERE {by_product}", "report_drug", "drug_ingredients")
    add("f7_substance", "SELECT REPORT_DRUG_ID FROM report_drug WHERE DRUGNAME IN (SELECT DRUGNAME FROM substances WHERE ing = 'ECONOMY')", "report_drug", "substances")
    add("f8_involvement", "SELECT REPORT_DRUG_ID FROM report_drug WHERE DRUGINVOLV_ENG = 'Suspect'", "report_drug")
    add("f9_reaction", f"SELECT DISTINCT * FROM reactions WHERE PT_NAME_ENG <> '' AND {_TERM_MATCH}", "reactions")
    add("f10_soc", f"SELECT REPORT_ID, PT_NAME_ENG FROM reactions WHERE {_IN_SOCS}", "reactions")
    add("f11_search_reports",
        f"SELECT REPORT_ID FROM reports WHERE {d} BETWEEN DATE '1996-03-01' AND DATE '1999-09-01' AND {_SERIOUS} AND GENDER_ENG = 'Female' AND AGE_Y >= 13 "
        f"AND REPORT_ID IN (SELECT REPORT_ID FROM report_drug WHERE {by_product} AND DRUGINVOLV_ENG = 'Suspect') "
        f"AND REPORT_ID IN (SELECT REPORT_ID FROM reactions WHERE PT_NAME_ENG <> '' AND {_TERM_MATCH} AND {_IN_SOCS})",
        "reports", "report_drug", "drug_ingredients", "reactions")
    add("f11_search_by_brand", f"WITH {_SEARCH} SELECT REPORT_ID FROM ids", "reports", "report_drug", "reactions")
    add("f12_is_empty", "SELECT count(*) AS n_all, count(*) FILTER (WHERE AGE_Y BETWEEN 150 AND 160) = 0 AS found_nothing FROM reports", "reports")
    add("f13_restrict", f"WITH {_SEARCH} SELECT REPORT_DRUG_ID FROM report_drug WHERE REPORT_ID IN (SELECT REPORT_ID FROM ids)", "reports", "report_drug", "reactions")
    add("f13_restrict_nothing_found", "SELECT PT_NAME_ENG, count(*) AS n FROM reactions GROUP BY 1", "reactions")
    out["f11_search_set"] = out["f11_search_reports"]
    part = lambda label, value, source: (
        f"SELECT {value} AS value, count(*) AS n, '{label}' AS label FROM {source} WHERE REPORT_ID IN (SELECT REPORT_ID FROM ids) GROUP BY 1")
    add("f13_panels",
        f"WITH {_SEARCH} " + " UNION ALL ".join([
            part("sex", "CASE GENDER_ENG WHEN '' THEN 'Not specified' ELSE GENDER_ENG END", "reports"),
            part("outcome", "OUTCOME_ENG", "reports"),
            part("reporter", "CASE REPORTER_TYPE_ENG WHEN '' THEN 'Not reported' ELSE REPORTER_TYPE_ENG END", "reports"),
            "SELECT 'all', count(*), 'total' FROM ids",
            part("drug", "DRUGNAME", "report_drug"), part("involvement", "DRUGINVOLV_ENG", "report_drug"),
            part("reaction", "PT_NAME_ENG", "reactions"), part("class", "SOC_NAME_ENG", "reactions")]),
        "reports", "report_drug", "reactions")
    add("f14_search_nested",
        f"WITH {_FOUND_DOCS} SELECT count(*) AS n_reports FROM found WHERE REPORT_ID IN (SELECT REPORT_ID FROM doc_drugs WHERE generic_name {_IN_DRUGS}) "
        "AND REPORT_ID IN (SELECT REPORT_ID FROM doc_reactions WHERE reactionmeddrapt IN ('Supplier#000000004', 'Supplier#000000027'))",
        "doc_reports", "doc_drugs", "doc_reactions")
    add("f14_search_nested_brand",
        f"WITH {_FOUND_DOCS} SELECT reactionmeddrapt AS term, count(DISTINCT REPORT_ID) AS n FROM doc_reactions JOIN found USING (REPORT_ID) "
        f"WHERE REPORT_ID IN (SELECT REPORT_ID FROM doc_drugs WHERE {_IN_BRANDS.replace('DRUGNAME', 'brand_name')}) GROUP BY 1",
        "doc_reports", "doc_drugs", "doc_reactions")
    add("f15_missing", "SELECT count(*) FILTER (WHERE patientonsetage IS NULL) AS n FROM doc_reports", "doc_reports")
    add("f16_filter_signals",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')}, {_cells()}, {_PRR.format(prev='cells')} SELECT drug_code, event_effect, n11 AS \"count\", {_r4('expected_count', 'PRR')} "
        f"FROM PRR_t WHERE drug_code {_IN_DRUGS} AND n11 >= 20 AND expected_count >= 15 AND PRR <> CAST('Infinity' AS DOUBLE)", "fact")
    add("f17_analysis_cohort", f"WITH {_COHORT} SELECT quarter, ing, count(*) AS n FROM cohort GROUP BY 1, 2", "fact")
    add("f18_min_count", f"WITH {_PT_COUNTS}, {_ct('pairs')} SELECT * FROM ct WHERE n11 >= 25", "report_drug", "reactions")

    # Joins
    add("j1_add_hierarchy",
        "SELECT PT_NAME_ENG, f.MEDDRA_VERSION, h.HLT_Term AS HLT_NAME_ENG, h.HLGT_Term AS HLGT_NAME_ENG, count(*) AS n FROM fact f "
        "LEFT JOIN hierarchy h ON h.PT_Term = f.PT_NAME_ENG AND h.MEDDRA_VERSION = f.MEDDRA_VERSION AND h.Primary_SOC_flag = 'Y' GROUP BY 1, 2, 3, 4", "fact", "hierarchy")
    built = (
        "built AS (SELECT d.REPORT_ID, i.ACTIVE_INGREDIENT_NAME, r.PT_NAME_ENG FROM drug_ingredients i LEFT JOIN report_drug d "
        "ON d.DRUG_PRODUCT_ID = i.DRUG_PRODUCT_ID LEFT JOIN reactions r ON r.REPORT_ID = d.REPORT_ID)"
    )
    add("j2_build_fact", f"WITH {built} SELECT * FROM built", "drug_ingredients", "report_drug", "reactions")
    add("j3_in_reports",
        f"WITH {built} SELECT ACTIVE_INGREDIENT_NAME, PT_NAME_ENG, count(DISTINCT REPORT_ID) AS \"count\" FROM built "
        f"WHERE REPORT_ID IN (SELECT REPORT_ID FROM reports WHERE {d} BETWEEN DATE '1996-03-15' AND DATE '1999-09-30') GROUP BY 1, 2",
        "drug_ingredients", "report_drug", "reactions", "reports")
    add("j4_attach_flags",
        f"SELECT r.REPORT_ID, PT_NAME_ENG, SERIOUSNESS_ENG, CAST(DEATH AS BIGINT) AS DEATH FROM reactions r LEFT JOIN reports p ON p.REPORT_ID = r.REPORT_ID WHERE {_SERIOUS}", "reactions", "reports")
    add("j5_semi_keys",
        f"WITH {_PT_COUNTS}, top AS (SELECT drug_code, event_effect FROM pairs ORDER BY n11 DESC, drug_code || '_' || event_effect LIMIT 10) "
        "SELECT REPORT_ID, REPORT_DRUG_ID, DRUGNAME, PT_NAME_ENG FROM report_drug JOIN reactions USING (REPORT_ID) WHERE (DRUGNAME, PT_NAME_ENG) IN (SELECT (drug_code, event_effect) FROM top)", "report_drug", "reactions")
    add("j6_with_all_categories",
        "WITH s AS (SELECT DRUGINVOLV_ENG, count(*) AS n FROM report_drug GROUP BY 1) "
        + _categories(["Suspect", "Concomitant", "Treatment", "Past"], "DRUGINVOLV_ENG", "s"), "report_drug")
    daily = "SELECT DATINTRECEIVED_CLEAN AS time_p, count(*) AS n FROM reports WHERE"
    add("j7_class_counts",
        f"WITH a AS ({daily} REPORT_ID IN (SELECT REPORT_ID FROM report_drug WHERE {_IN_BRANDS}) GROUP BY 1), "
        f"b AS ({daily} DISABILITY = 1 GROUP BY 1), c AS ({daily} DEATH = 1 GROUP BY 1) "
        "SELECT time_p, CAST(coalesce(a.n, 0) AS BIGINT) AS with_brand, CAST(coalesce(b.n, 0) AS BIGINT) AS disabling, "
        "CAST(coalesce(c.n, 0) AS BIGINT) AS fatal FROM a FULL JOIN b USING (time_p) FULL JOIN c USING (time_p)", "reports", "report_drug")
    add("j8_fill_calendar",
        "WITH calendar AS (SELECT CAST(unnest(generate_series(CAST(min(time_p) AS TIMESTAMP), CAST(max(time_p) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS time_p FROM events_months) "
        "SELECT time_p, CAST(coalesce(n, 0) AS BIGINT) AS n FROM calendar LEFT JOIN events_months USING (time_p)", "events_months")
    rows_by_quarter = "rows_q AS (SELECT ing, PT_NAME_ENG, quarter, count(*) AS n FROM cohort GROUP BY 1, 2, 3)"
    add("j9_densify",
        f"WITH {_COHORT}, {rows_by_quarter}, grid AS (SELECT * FROM (SELECT DISTINCT ing, PT_NAME_ENG FROM rows_q) p CROSS JOIN (SELECT DISTINCT quarter FROM rows_q) q) "
        "SELECT ing, PT_NAME_ENG, quarter, coalesce(n, 0) AS n FROM grid LEFT JOIN rows_q USING (ing, PT_NAME_ENG, quarter)", "fact")
    add("j10_decode", f"SELECT DISTINCT REPORT_ID, {_labels('reactionoutcome', _OUTCOMES)} AS label FROM doc_reactions", "doc_reactions")
    add("j11_master_table",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')}, {_cells()}, {_PRR.format(prev='cells')}, {_ROR.format(prev='PRR_t')}, {_RRR.format(prev='ROR_t')} "
        f"SELECT drug_code, event_effect, n11, {_r4('PRR', 'ROR', 'RRR')} FROM RRR_t", "fact")
    add("j12_union_versions",
        "SELECT PT_Code, CAST(HLT_Code AS BIGINT) AS HLT_Code, CAST(HLGT_Code AS BIGINT) AS HLGT_Code, CAST(SOC_Code AS BIGINT) AS SOC_Code, PT_Term, HLT_Term, HLGT_Term, SOC_Term, SOC_Abbrev, "
        "CAST(Primary_PT_SOC AS BIGINT) AS Primary_PT_SOC, Primary_SOC_flag, MEDDRA_VERSION FROM hierarchy", "hierarchy")
    sexes = "SELECT CASE GENDER_ENG WHEN '' THEN 'Not specified' ELSE GENDER_ENG END AS {name}, count(*) AS n FROM reports GROUP BY 1"
    add("j13_stack_labelled",
        f"SELECT *, 'sex' AS label FROM ({sexes.format(name='value')}) a UNION ALL SELECT *, 'outcome' FROM (SELECT OUTCOME_ENG AS value, count(*) AS n FROM reports GROUP BY 1) b", "reports")
    add("j14_coverage",
        "SELECT DISTINCT p_brand AS ing, upper(p_brand) IN (SELECT upper(p_brand) FROM part WHERE p_size < 2 OR (p_type = 'ECONOMY' AND p_size > 48)) AS found FROM part")

    # Counts and summaries
    add("a1_pair_counts_pt", f"WITH {_COHORT} SELECT ing, PT_NAME_ENG, count(DISTINCT REPORT_ID) AS \"count\" FROM cohort GROUP BY 1, 2", "fact")
    add("a1_pair_counts_from_tables", f"WITH {_PT_COUNTS} SELECT drug_code AS DRUGNAME, event_effect AS PT_NAME_ENG, n11 AS \"count\" FROM pairs", "report_drug", "reactions")
    add("a2_pair_counts_hlt", f"WITH {_COHORT} SELECT ing, HLT_NAME_ENG, count(DISTINCT REPORT_ID) AS \"count\" FROM cohort WHERE HLT_NAME_ENG IS NOT NULL GROUP BY 1, 2", "fact")
    add("a3_pair_counts_quarter", f"WITH {_COHORT} SELECT quarter, ing, PT_NAME_ENG, count(DISTINCT REPORT_ID) AS \"count\" FROM cohort GROUP BY 1, 2, 3", "fact")
    add("a4_pair_rows_quarter", f"SELECT ing, HLT_NAME_ENG, quarter, count(*) AS n FROM fact WHERE quarter >= {SINCE} GROUP BY 1, 2, 3", "fact")
    add("a5_quarters", f"WITH {_COHORT} SELECT DISTINCT quarter FROM cohort", "fact")
    add("a6_contingency", f"WITH {_PT_COUNTS}, {_ct('pairs')} SELECT * FROM ct", "report_drug", "reactions")
    rounds = 12
    add("a6_contingency_threshold",
        f"WITH RECURSIVE {_PT_COUNTS}, kept(step, drug_code, event_effect, n11) AS (SELECT 0, drug_code, event_effect, n11 FROM pairs UNION ALL "
        "SELECT step + 1, drug_code, event_effect, n11 FROM (SELECT *, sum(n11) OVER (PARTITION BY drug_code) AS a, sum(n11) OVER (PARTITION BY event_effect) AS b FROM kept) m "
        f"WHERE a >= {MARGIN} AND b >= {MARGIN} AND step < {rounds}), last AS (SELECT drug_code, event_effect, n11 FROM kept WHERE step = {rounds}), "
        f"{_ct('last')} SELECT * FROM ct", "report_drug", "reactions")
    add("a7_report_series", f"WITH chosen AS (SELECT * FROM reports), {_calendar_series('year')}", "reports")
    add("a7_report_series_monthly", f"WITH chosen AS (SELECT * FROM reports WHERE {d} BETWEEN DATE '1997-02-10' AND DATE '1998-11-20'), {_calendar_series('month')}", "reports")
    add("a8_report_total", "SELECT count(DISTINCT REPORT_ID) AS n_reports FROM report_drug", "report_drug")
    add("a9_by_reporter", "SELECT CASE REPORTER_TYPE_ENG WHEN '' THEN 'Not reported' ELSE REPORTER_TYPE_ENG END AS REPORTER_TYPE_ENG, count(*) AS n FROM reports GROUP BY 1", "reports")
    add("a10_by_seriousness",
        "SELECT CAST(0 AS BIGINT) AS position, 'Serious(Excluding Death)' AS label, count(*) FILTER (WHERE SERIOUSNESS_ENG = 'Yes') - count(*) FILTER (WHERE DEATH = 1) AS n FROM reports "
        "UNION ALL SELECT 1, 'Death', count(*) FROM reports WHERE DEATH = 1 UNION ALL SELECT 2, 'Non-serious', count(*) FROM reports WHERE SERIOUSNESS_ENG = 'No' "
        "UNION ALL SELECT 3, 'Not reported', count(*) FROM reports WHERE SERIOUSNESS_ENG = ''", "reports")
    reasons = {"Death": "DEATH", "Life-threatening": "LIFE_THREATENING", "Hospitalization": "HOSP_REQUIRED", "Disability": "DISABILITY",
               "Congenital anomaly": "CONGENITAL_ANOMALY", "Other medically important condition": "OTHER_MEDICALLY_IMP_COND"}
    parts = [f"SELECT CAST({i} AS BIGINT) AS position, '{label}' AS label, count(*) AS n FROM reports WHERE SERIOUSNESS_ENG = 'Yes' AND {flag} = 1"
             for i, (label, flag) in enumerate(reasons.items())]
    none = " AND ".join(f"{flag} IS DISTINCT FROM 1" for flag in reasons.values())
    parts.append(f"SELECT 6, 'Not specified', count(*) FROM reports WHERE SERIOUSNESS_ENG = 'Yes' AND {none}")
    add("a11_serious_reasons", " UNION ALL ".join(parts), "reports")
    add("a12_by_sex", sexes.format(name="GENDER_ENG"), "reports")
    add("a13_by_age_group",
        f"WITH s AS (SELECT {_age_group('AGE_Y', 'Unknown')} AS AGE_GROUP_CLEAN, count(*) AS n FROM reports GROUP BY 1) "
        + _categories([*_GROUPS, "Unknown"], "AGE_GROUP_CLEAN", "s"), "reports")
    bins = "CAST(greatest(ceil(age / 2), 1) AS BIGINT)"
    add("a14_age_histogram",
        f"SELECT age_group, bin, count(*) AS n, (bin - 1) * 2 AS bin_lo, bin * 2 AS bin_hi FROM (SELECT {_age_group('AGE_Y', 'Unknown')} AS age_group, {bins.replace('age', 'AGE_Y')} AS bin "
        "FROM reports WHERE AGE_Y BETWEEN 0 AND 100) t GROUP BY 1, 2", "reports")
    add("a15_age_excluded", "SELECT count(*) FILTER (WHERE AGE_Y > 100) AS n FROM reports", "reports")
    add("a16_top_indications", _top("INDICATION_NAME_ENG", "report_drug", 25, condition="INDICATION_NAME_ENG IS NOT NULL"), "report_drug")
    per_report = "count(DISTINCT REPORT_ID)"
    add("a17_top_drugs", _top("DRUGNAME", "report_drug", 25, per_report), "report_drug")
    add("a17_top_drugs_suspect", _top("DRUGNAME", "report_drug", 25, per_report, "DRUGINVOLV_ENG = 'Suspect'"), "report_drug")
    add("a17_top_drugs_concomitant", _top("DRUGNAME", "report_drug", 25, per_report, "DRUGINVOLV_ENG = 'Concomitant'"), "report_drug")
    add("a17_top_drugs_none", "SELECT 'None' AS DRUGNAME, CAST(count(*) AS BIGINT) AS n FROM report_drug WHERE DRUGINVOLV_ENG = 'Interacting'", "report_drug")
    lines = "(SELECT REPORT_ID, count(*) AS n_drugs FROM report_drug GROUP BY 1) t"
    add("a18_drugs_per_report", f"SELECT n_drugs, count(*) AS n_reports FROM {lines} WHERE n_drugs <= 20 GROUP BY 1", "report_drug")
    add("a19_reports_over", f"SELECT count(*) AS n FROM {lines} WHERE n_drugs > 6", "report_drug")
    add("a20_top_pt", _top("PT_NAME_ENG", "reactions", 15), "reactions")
    add("a21_top_hlt", _top("HLT_Term", "reactions", 15, condition="HLT_Term IS NOT NULL"), "reactions")
    add("a22_by_outcome", "SELECT OUTCOME_ENG, count(*) AS n FROM reports GROUP BY 1", "reports")
    add("a23_vocabulary_brand", "SELECT DISTINCT DRUGNAME AS term FROM report_drug", "report_drug")
    add("a23_vocabulary_reaction", "SELECT PT_NAME_ENG AS term FROM reactions UNION SELECT SMQ FROM reactions WHERE SMQ IS NOT NULL", "reactions")
    add("a23_vocabulary_ingredient", "SELECT DISTINCT ACTIVE_INGREDIENT_NAME AS term FROM drug_ingredients", "drug_ingredients")
    add("a23_vocabulary_substance", "SELECT DISTINCT ing AS term FROM substances", "substances")
    add("a23_vocabulary_soc", "SELECT DISTINCT SOC_NAME_ENG AS term FROM reactions", "reactions")
    add("a23_nested_vocabulary", "SELECT DISTINCT generic_name AS term FROM doc_drugs WHERE generic_name NOT LIKE '%,%'", "doc_drugs")
    terms = "terms AS (SELECT DISTINCT ing, PT_NAME_ENG, HLT_NAME_ENG, SOC_NAME_ENG FROM cohort WHERE HLT_NAME_ENG IS NOT NULL)"
    add("a24_term_map", f"WITH {_COHORT}, {terms} SELECT * FROM terms", "fact")
    add("a25_choices_hlt", f"WITH {_COHORT}, {terms} SELECT DISTINCT HLT_NAME_ENG FROM terms WHERE ing = 'Brand#5'", "fact")
    add("a25_choices_pt", f"WITH {_COHORT}, {terms} SELECT DISTINCT PT_NAME_ENG FROM terms WHERE ing {_IN_DRUGS} AND HLT_NAME_ENG IN ('NATION_3', 'NATION_11')", "fact")
    add("a26_pair_series",
        f"WITH {_fact_counts('PT_NAME_ENG')}, {_ct('pairs')}, {_bcpnn('ct')}, {rows_by_quarter}, "
        "lead_pairs AS (SELECT drug_code AS ing, event_effect AS PT_NAME_ENG FROM ic ORDER BY IC DESC NULLS FIRST, LB95_IC DESC NULLS FIRST, drug_code, event_effect LIMIT 10), "
        "grid AS (SELECT * FROM lead_pairs CROSS JOIN (SELECT DISTINCT quarter FROM rows_q) q) "
        "SELECT ing || '_' || PT_NAME_ENG AS label, quarter, coalesce(n, 0) AS n FROM grid LEFT JOIN rows_q USING (ing, PT_NAME_ENG, quarter)", "fact")
    hlt_rows = "rows_q AS (SELECT ing, HLT_NAME_ENG, quarter, count(*) AS n FROM cohort GROUP BY 1, 2, 3)"
    add("a26_pair_series_hlt",
        f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')}, {_bcpnn('ct')}, {hlt_rows}, "
        "lead_pairs AS (SELECT drug_code AS ing, event_effect AS HLT_NAME_ENG FROM ic WHERE n11 >= 3 ORDER BY IC DESC NULLS FIRST, LB95_IC DESC NULLS FIRST, drug_code, event_effect LIMIT 10), "
        "grid AS (SELECT * FROM lead_pairs CROSS JOIN (SELECT DISTINCT quarter FROM cohort) q) "
        "SELECT ing || '_' || HLT_NAME_ENG AS label, quarter, coalesce(n, 0) AS n FROM grid LEFT JOIN rows_q USING (ing, HLT_NAME_ENG, quarter)", "fact")
    add("a27_total_series", f"WITH {_COHORT} SELECT 'total for query' AS label, quarter, count(*) AS n FROM cohort WHERE ing {_IN_DRUGS} GROUP BY quarter", "fact")

    # Nested documents, checked on the flat rows
    add("a8_nested_total", "SELECT count(*) AS n_reports FROM doc_reports", "doc_reports")
    add("a28_nested_series",
        "WITH series AS (SELECT date_trunc('month', CAST(receivedate AS TIMESTAMP)) AS m, count(*) AS total, count(*) FILTER (WHERE serious = 1) AS serious, count(*) FILTER (WHERE death = 1) AS death FROM doc_reports GROUP BY 1), "
        "calendar AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM series) "
        "SELECT CAST(m AS DATE) AS month, coalesce(total, 0) AS total, coalesce(serious, 0) AS serious, coalesce(death, 0) AS death FROM calendar LEFT JOIN series USING (m)", "doc_reports")

    def coded(column: str, codes: dict[int, str]) -> str:
        return f"SELECT CASE WHEN {column} IS NULL THEN 'Not reported' ELSE {_labels(column, codes)} END AS label, count(*) AS n FROM doc_reports GROUP BY {column}"

    add("a29_nested_reporter", coded("qualification", _REPORTERS), "doc_reports")
    add("a29_nested_sex", coded("patientsex", _SEXES), "doc_reports")
    add("a29_nested_seriousness",
        "SELECT CAST(0 AS BIGINT) AS position, 'Serious' AS label, count(*) AS n FROM doc_reports WHERE serious = 1 UNION ALL SELECT 1, 'Non-serious', count(*) FROM doc_reports WHERE serious <> 1 "
        "UNION ALL SELECT 2, 'Not Reported', count(*) FROM doc_reports WHERE serious IS NULL", "doc_reports")
    add("a29_nested_outcome", f"SELECT {_labels('reactionoutcome', _OUTCOMES)} AS label, count(DISTINCT REPORT_ID) AS n FROM doc_reactions GROUP BY reactionoutcome", "doc_reactions")
    flags = {"Death": "death", "Life-threatening condition": "lifethreatening", "Hospitalization": "hospitalization", "Disabling": "disabling",
             "Congenital anomaly": "congenitalanomali", "Other serious condition": "other"}
    add("a30_nested_reasons", " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{label}' AS label, count(*) AS n FROM doc_reports WHERE {flag} = 1" for i, (label, flag) in enumerate(flags.items())), "doc_reports")
    add("a31_nested_countries",
        "SELECT * FROM (SELECT occurcountry AS term, count(*) AS n FROM doc_reports WHERE occurcountry IS NOT NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 10) t "
        "UNION ALL SELECT 'not reported', count(*) FROM doc_reports WHERE occurcountry IS NULL", "doc_reports")
    for key, column, source in (
        ("indication", "drugindication", "doc_drugs"), ("generic", "generic_name", "doc_drugs"),
        ("class", "pharm_class_epc", "doc_drugs"), ("pt", "reactionmeddrapt", "doc_reactions"),
    ):
        add(f"a32_nested_top_{key}",
            f"SELECT {column} AS term, count(DISTINCT REPORT_ID) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 25", source)
    add("a33_nested_top_hlt",
        "WITH pt AS (SELECT reactionmeddrapt AS term, count(DISTINCT REPORT_ID) AS n FROM doc_reactions GROUP BY 1), "
        "rolled AS (SELECT HLT_Term, sum(n) AS n FROM (SELECT DISTINCT term, h.HLT_Term, n FROM pt JOIN hierarchy h ON upper(h.PT_Term) = upper(pt.term) AND h.Primary_SOC_flag = 'Y') t GROUP BY 1) "
        "SELECT HLT_Term, CAST(n AS BIGINT) AS n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM rolled) t WHERE r <= 15", "doc_reactions", "hierarchy")
    add("a34_nested_ages", f"WITH {_AGES} SELECT age, age_group, n FROM ages", "doc_reports")
    add("a34_nested_age_groups",
        f"WITH {_AGES}, s AS (SELECT age_group, sum(n) AS n FROM ages GROUP BY 1) " + _categories([*_GROUPS, "Not reported"], "age_group", "s"), "doc_reports")
    add("a34_nested_age_histogram",
        f"WITH {_AGES} SELECT age_group, bin, CAST(sum(n) AS BIGINT) AS n, (bin - 1) * 2 AS bin_lo, bin * 2 AS bin_hi FROM (SELECT age_group, n, {bins} AS bin FROM ages WHERE age BETWEEN 0 AND 100) t GROUP BY 1, 2", "doc_reports")
    add("a34_nested_age_excluded", f"WITH {_AGES} SELECT CAST(sum(n) AS BIGINT) AS n FROM ages WHERE age > 100", "doc_reports")

    # Statistics
    pt = f"WITH {_PT_COUNTS}, {_ct('pairs')}"
    pt_views = ("report_drug", "reactions")
    hlt = f"WITH {_fact_counts('HLT_NAME_ENG')}, {_ct('pairs')}"
    add("d0_cells", f"{pt}, {_cells()} SELECT {_CELL_KEYS}, {_r4('expected_count')} FROM cells", *pt_views)
    for key, name, cte in (("d1_prr", "PRR", _PRR), ("d2_ror", "ROR", _ROR), ("d3_rrr", "RRR", _RRR)):
        add(key, f"{pt}, {_cells()}, {cte.format(prev='cells')} SELECT {_CELL_KEYS}, {_r4('expected_count', *_ratio_columns(name))} FROM {name}_t", *pt_views)
    fisher = f"SELECT drug_code, event_effect, n11, {_r4('RFET', 'midRFET')} FROM fisher"
    add("d4_d5_rfet_pt", f"{pt}, {_fisher()} {fisher}", *pt_views)
    add("d4_d5_rfet_hlt", f"{hlt}, {_fisher()} {fisher}", "fact")
    add("d4_rfet_or2", f"{hlt}, {_fisher(2.0)} {fisher} WHERE n11 >= 100", "fact")
    ic = f"SELECT drug_code, event_effect, n11, {_r4('IC', 'var_IC', 'LB95_IC', 'UB95_IC', 'postH0')} FROM ic"
    add("d6_bcpnn_pt", f"{pt}, {_bcpnn('ct')} {ic}", *pt_views)
    add("d6_bcpnn_hlt", f"{hlt}, {_bcpnn('ct', 1.1)} {ic} WHERE n11 >= 90", "fact")
    add("d8b_gps_means", f"{pt}, {_GPS} {_GPS_MEANS}", *pt_views)
    add("d8b_gps_null_probability", f"{pt}, {_GPS} {_GPS_H0}", *pt_views)
    add("d8b_gps_quantile", f"WITH RECURSIVE {hlt[5:]}, {_GPS}, {_GPS_QUANTILE}", "fact")
    add("d9_signals_pt", _master("PT_NAME_ENG"), "fact")
    add("d9_signals_hlt", _master("HLT_NAME_ENG"), "fact")
    by_quarter = f"WITH {_fact_counts('HLT_NAME_ENG', 'quarter')}, {_ct('pairs', 'quarter')}, {_bcpnn('ct', carry='quarter, drug_code, event_effect, n11, n1_, n_1, N')}"
    ratios = [f"{bound}{name}" for name in ("PRR", "ROR", "RRR") for bound in ("", "LB95_", "UB95_")]
    add("d10_signals_quarter",
        f"{by_quarter}, {_fisher(by='quarter')}, {_cells('quarter')}, {_PRR.format(prev='cells')}, {_ROR.format(prev='PRR_t')}, {_RRR.format(prev='ROR_t')} "
        "SELECT t.quarter, t.drug_code, t.event_effect, t.n11 AS \"count\", t.n1_ AS drug_margin, t.n_1 AS event_margin, t.N, "
        f"{_r4('expected_count', *ratios, 'RFET', 'midRFET')}, round(IC * {LN2}, 4) AS median_IC, round(LB95_IC * {LN2}, 4) AS LB95_IC "
        "FROM RRR_t t JOIN fisher USING (quarter, drug_code, event_effect) JOIN ic USING (quarter, drug_code, event_effect)", "fact")
    add("d11_cumulative_contingency",
        f"WITH {_fact_counts('PT_NAME_ENG', 'quarter')}, qs AS (SELECT DISTINCT quarter FROM pairs), "
        "cum AS (SELECT q.quarter, p.drug_code, p.event_effect, CAST(sum(p.n11) AS BIGINT) AS n11 FROM qs q JOIN pairs p ON p.quarter <= q.quarter GROUP BY 1, 2, 3), "
        f"{_ct('cum', 'quarter')} SELECT quarter, drug_code, event_effect, n11, n1_, n_1, N FROM ct", "fact")
    add("d12_cumulative_ic",
        f"{by_quarter} SELECT quarter, drug_code, event_effect, round(sum(IC) OVER w * {LN2}, 4) AS IC_cumulative, round(sum(LB95_IC) OVER w * {LN2}, 4) AS LB95_IC_cumulative "
        "FROM ic WINDOW w AS (PARTITION BY drug_code, event_effect ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "fact")
    near = "TRUE AS median_near, TRUE AS lower_near, TRUE AS upper_near"
    add("d7_sampled_and_closed",
        f"{pt}, {_bcpnn('ct')} SELECT drug_code, event_effect, n11, round(IC * {LN2}, 4) AS mean, {near} FROM ic", *pt_views)
    add("d9_signals_sampled",
        f"{hlt}, {_fisher()}, {_cells()}, {_PRR.format(prev='cells')}, {_ROR.format(prev='PRR_t')}, {_RRR.format(prev='ROR_t')}, {_bcpnn('ct')} "
        f"SELECT t.drug_code, t.event_effect, t.n11 AS \"count\", t.n1_ AS drug_margin, t.n_1 AS event_margin, t.N, {_r4('PRR', 'ROR', 'RRR', 'RFET')}, "
        f"round(IC * {LN2}, 4) AS mean, {near} FROM RRR_t t JOIN fisher USING (drug_code, event_effect) JOIN ic USING (drug_code, event_effect)", "fact")
    slope = lambda q, a, b: (
        f"avg({q} * {a} * ({_digamma(f'(n11 + {a}e0)')} - {_digamma(f'{a}e0')} + ln({b}e0) - ln(e + {b}e0))), "
        f"avg({q} * ({a} - {b} * (n11 + {a}) / (e + {b})))")
    names = ("log_likelihood", "by_log_alpha1", "by_log_beta1", "by_log_alpha2", "by_log_beta2", "by_logit_w")
    add("d8a_gps_likelihood",
        f"{pt}, {_GPS}, sums({', '.join(names)}) AS (SELECT avg(l1 + ln({_W}e0) - ln(Q)), {slope('Q', _A1, _B1)}, {slope('(1 - Q)', _A2, _B2)}, avg(Q - {_W}) FROM gps_1) "
        f"SELECT {', '.join(f'round({n}, 8) AS {n}' for n in names)} FROM sums", *pt_views)
    out["a1_pair_counts_stored"] = out["a1_pair_counts_pt"]
    out["a3_quarters_loaded"], out["d11_quarters_loaded"] = out["a3_pair_counts_quarter"], out["d11_cumulative_contingency"]
    add("d12_quarters_loaded",
        f"{by_quarter}, {_cells('quarter')}, {_PRR.format(prev='cells')}, sums AS (SELECT quarter, drug_code, event_effect, "
        "IC, sum(IC) OVER w AS s, sum(LB95_IC) OVER w AS lb "
        "FROM ic WINDOW w AS (PARTITION BY drug_code, event_effect ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        "SELECT quarter, drug_code, event_effect, n11 AS \"count\", n1_ AS drug_margin, n_1 AS event_margin, N, round(PRR, 4) AS PRR, "
        f"round(IC * {LN2}, 4) AS median_IC, round(s * {LN2}, 4) AS IC_cumulative, round(lb * {LN2}, 4) AS LB95_IC_cumulative "
        "FROM PRR_t JOIN sums USING (quarter, drug_code, event_effect)", "fact")
    add("d13_error_rates_null_probability", _error_rates(_PT_COUNTS, "p"), *pt_views)
    add("d13_error_rates_lower_bound", _error_rates(_fact_counts("HLT_NAME_ENG"), "lb DESC"), "fact")
    finer = _GPS_H0.replace(", 4) AS postH0", ", 6) AS postH0")
    add("d13_error_rates_gps",
        _error_rates(_fact_counts("HLT_NAME_ENG"), "p", f"{_GPS}, s AS (SELECT drug_code, event_effect, postH0 AS p FROM ({finer}) h), "), "fact")
    add("d9_signals_gps",
        f"{hlt}, {_bcpnn('ct')}, {_GPS}, means AS ({_GPS_MEANS}), h0 AS ({_GPS_H0}) "
        f"SELECT drug_code, event_effect, means.n11 AS \"count\", round(IC * {LN2}, 4) AS median_IC, postE_lambda, postE_log2_lambda, h0.postH0 AS gps_postH0 "
        "FROM means JOIN h0 USING (drug_code, event_effect) JOIN ic USING (drug_code, event_effect)", "fact")
    return out
