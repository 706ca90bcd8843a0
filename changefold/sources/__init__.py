"""Sources: the record envelope (files or a topic), SSE dumps, test data."""

from changefold.sources.envelope import RAW_TOPIC, read_envelope, read_envelope_stream
from changefold.sources.sse import decode_frames, read_sse_frames, sse_frame_text
from changefold.sources.testdata import AS_OF, events_envelope

__all__ = [
    "AS_OF",
    "RAW_TOPIC",
    "decode_frames",
    "events_envelope",
    "read_envelope",
    "read_envelope_stream",
    "read_sse_frames",
    "sse_frame_text",
]
