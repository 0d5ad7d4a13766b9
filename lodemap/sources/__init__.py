from lodemap.sources.readers import read_documents, read_turns, read_vectors, stream_events
from lodemap.sources.relations import parse_relations
from lodemap.sources.sinks import export_top, write_map

__all__ = [
    "export_top", "parse_relations", "read_documents", "read_turns", "read_vectors", "stream_events", "write_map",
]
