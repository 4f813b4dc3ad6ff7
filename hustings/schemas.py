"""Declared schemas of the canonical tables, as DDL text for ``DataFrameReader.schema``."""

ENTITY_CYCLE = ["country", "election_year"]
SERIES_KEYS = ["country", "election_year", "party"]
LOT_KEYS = ["country", "election_year", "source_table"]

#: One row per data line of a raw table; the header line carries row_idx 0.
RAW_ROWS = "source_table string, country string, election_year int, row_idx bigint, cells array<string>"
POLLS_CLEAN = (
    "country string, election_year int, date_raw string, pollster string, sample_size string, party string, "
    "pct double, source_table string"
)
ACTUALS = "country string, election_year int, party string, actual_pct double"
ELECTION_DATES = "country string, election_year int, election_date date, date_source string"
SCOPE_OVERRIDES = (
    "country string, election_year int, source_table string, override_status string, reason string, evidence string"
)
SCOPE_AUDIT = (
    "country string, election_year int, source_table string, poll_party_rows bigint, party_count bigint, "
    "party_signature string, marker_candidate_count bigint, best_marker_date_raw string, "
    "best_marker_relevance string, national_overlap_parties bigint, marker_mae double, "
    "marker_max_abs_error double, scope_status string, scope_reason string"
)
ROLLING_FEATURES = (
    "country string, election_year int, party string, poll_date date, pct double, rolling_avg double, "
    "momentum_1st_diff double, momentum_2nd_diff double"
)
ELECTION_VECTORS = (
    "country string, election_year int, leader_party string, final_leader_pct double, poll_volatility double, "
    "actual_margin double, n_polls bigint"
)
SPLITS = "country string, election_year int, dataset_split string"
METRICS = "task string, model string, metric string, value double"


def column_names(ddl: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [part.split()[0] for part in ddl.split(",")]
