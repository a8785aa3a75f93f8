"""Reading and writing telemetry tables."""

from tidewatt.sources.readers import check_headers, file_counts, merge_files, page, scan_csv, scan_parquet
from tidewatt.sources.writers import sink_json, sink_parquet, sink_text_preview, text_preview

__all__ = [
    "check_headers", "file_counts", "merge_files", "page", "scan_csv", "scan_parquet",
    "sink_json", "sink_parquet", "sink_text_preview", "text_preview",
]
