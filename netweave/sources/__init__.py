from netweave.sources.readers import header_names, read_flows, read_flows_reported, read_table
from netweave.sources.sinks import write_csv, write_report, write_table

__all__ = ["header_names", "read_flows", "read_flows_reported", "read_table", "write_csv", "write_report", "write_table"]
