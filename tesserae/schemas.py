"""Row types of the engine's tables."""

CHUNK = "chunk_ord long, content string, file_path string, start_line int, end_line int, language string"
BOUNDARY = "start int, `end` int"
POSTING = "term string, chunk_ord long, tf long"
DOC_STATS = "chunk_ord long, dl long"
VECTOR_INT8 = "chunk_ord long, codes array<tinyint>, scale float"
VECTOR_FLOAT = "chunk_ord long, vector array<float>"
SCORES = "query_id long, chunk_ord long, score double"
FILE_STATE = "file_path string, mtime_ms long"
