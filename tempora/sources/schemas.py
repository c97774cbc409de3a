"""Schemas of the stored tables."""

OHLCV = "sec_id string, trade_date date, open double, high double, low double, close double, volume bigint, known_from timestamp_ntz, ingestion_seq bigint"
ACTIONS = "sec_id string, action_type string, ex_date date, split_ratio double, cash_amount double, announcement_date date, known_from timestamp_ntz, ingestion_seq bigint"
ENTITY_MAP = "sec_id string, ticker string, valid_from timestamp_ntz, ingestion_seq bigint"
FUNDAMENTALS = "sec_id string, filing_type string, fiscal_period_end date, metric_name string, metric_value double, known_from timestamp_ntz, is_restatement boolean, ingestion_seq bigint"
LOG = "ingestion_seq bigint, ingested_at timestamp_ntz, table_name string, source string, row_count bigint, file_count bigint, files_written array<string>, file_hashes array<string>"
