from netweave.streaming.flows import run_to_table, score_stream, session_flows, stream_table

__all__ = ["run_to_table", "score_stream", "session_flows", "stream_table"]
