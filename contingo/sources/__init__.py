from contingo.sources.io import (  # noqa: F401
    TABLES, literal_table, quarantine, read_checked, read_csv_header, read_csv_named, read_json_lines,
    read_labelled_matrix, read_parquet, read_table, write_parquet,
)
