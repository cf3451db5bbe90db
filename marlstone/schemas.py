"""Row types of the engine's tables as Spark DDL."""

PARSED_DOCUMENT = (
    "filename string, file_path string, raw_text string, page_count int, file_size_kb double, doc_type string, source_name string, "
    "issuing_authority string, issue_date string, reference_number string, tags array<string>, chapter string, section string, "
    "notification_number string, hs_code string, customs_section string, document_hash string, document_name string")
CHUNK = (
    "chunk_id string, doc_id string, filename string, chunk_index int, text string, token_estimate int, page_number int, doc_type string, "
    "source_name string, issuing_authority string, issue_date string, reference_number string, tags array<string>, section string, "
    "chapter string, notification string, hs_code string, doc_name string")
INGEST_RECORD = (
    "doc_id string, filename string, source_name string, doc_type string, issuing_authority string, issue_date string, "
    "reference_number string, tags array<string>, page_count int, file_size_kb double, chunk_count int, status string, "
    "ingested_at string, document_hash string")
