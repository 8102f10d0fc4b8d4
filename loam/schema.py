"""Schemas of the stored tables."""

OUTLINE = "array<struct<level:int,header:string,anchor:string,char_start:int,char_end:int>>"
CHUNKS = "source_file string, section_header string, area_number int, doc_type string, content string, content_hash string, embedding array<float>, updated_at timestamp, status string, supersedes string, doc_date date, git_sha string, git_committed_at timestamp, depends_on array<string>, feeds_into array<string>, also_touches array<int>"
OUTLINES = f"source_file string, outline {OUTLINE}, updated_at timestamp"
EDGES = "source_file string, relation string, target string"
DECISIONS = "id int, decision_key string, area int, decision string, current_value string, source_doc string, decided_on date, cross_refs array<string>, superseded_by int, updated_at timestamp"
QUERY_LOG = "query_scrubbed string, top_k_ids array<string>, latency_ms int, caller string, created_at timestamp"
DRIFT = "file string, line int, signal string, reason string, authoritative_source string, suggested_replacement string, snippet string"
TRACKER = "array<struct<id:string,n:string,tg:string,s:string,sg:array<struct<n:string,it:array<struct<n:string,s:string,o:string,y:string,nt:string>>>>,d:array<struct<x:string>>,df:array<string>>>"
GIT = "source_file string, git_sha string, git_committed_at timestamp"
CHUNK_HASHES = "content_hash string, source_file string"
FILE_STATS = "source_file string, chunk_count long, first_updated timestamp, last_updated timestamp, status string, supersedes string, doc_date date, git_committed_at timestamp"
SNAPSHOT = "source_file string, path string, length long, modified timestamp, digest string"
_FILTERS = "source_file string, status string, area_number int, doc_type string"
#: A term's chunks of one block by their number there; content_hash and filters of a number are in LENGTHS.
POSTINGS = "term string, block long, nos array<int>, tfs array<int>"
LENGTHS = f"block long, no int, content_hash string, n int, {_FILTERS}"
VECTORS = f"content_hash string, v array<float>, {_FILTERS}"
TABLES = {"doc_chunks": CHUNKS, "doc_outlines": OUTLINES, "doc_relationships": EDGES, "chunk_hashes": CHUNK_HASHES, "file_stats": FILE_STATS, "snapshot": SNAPSHOT, "decisions": DECISIONS, "query_log": QUERY_LOG, "postings": POSTINGS, "lengths": LENGTHS, "vectors": VECTORS}
#: What a table's rows are dealt out to buckets by; the log has days instead.
KEYS = {"doc_chunks": "source_file", "doc_outlines": "source_file", "doc_relationships": "source_file", "chunk_hashes": "content_hash", "file_stats": "source_file", "snapshot": "source_file", "decisions": "decision_key", "lengths": "source_file", "vectors": "source_file"}
