from .adapter import actuals, election_dates, load, polls, raw_rows
from .files import read_csv, read_csv_any_encoding, read_many, read_raw_rows, require_columns
from .sinks import dataset_manifest, fixed_decimals, json_records, write_csv, write_decision, write_json, write_once
