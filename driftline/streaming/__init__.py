from driftline.streaming.dedup import dedup_stream
from driftline.streaming.delta import stream_delta
from driftline.streaming.logs import log_stream

__all__ = ["dedup_stream", "log_stream", "stream_delta"]
