"""The manifest relation and the records around it."""

from __future__ import annotations

from pyspark.sql import types as T

# The manifest's columns in order, its statuses, and the header labels of a rendered message.
MANIFEST_FIELDS = ("source_pst_path", "source_pst_sha256", "eml_path", "pdf_path", "subject", "from", "to", "cc", "bcc", "date", "message_id", "attachment_filenames", "status", "error")
STATUSES = ("ok", "error", "timeout", "filtered")
HEADER_LABELS = ("Subject", "From", "To", "Cc", "Bcc", "Date", "Message-ID", "Source EML path", "Attachment filenames")
FILTERED_ERROR = "filtered by email participant"
PARTICIPANT_HEADERS = ("from", "to", "cc", "bcc", "reply-to", "sender")

MANIFEST = T.StructType([T.StructField(f, T.StringType(), False) for f in MANIFEST_FIELDS])
#: The stored manifest has an ordinal, which a CSV file has only implicitly.
STORED_MANIFEST = T.StructType([T.StructField("seq", T.LongType(), False), *MANIFEST.fields])

# The counts of a validation, and those of them that mean an inconsistency.
SUMMARY_FIELDS = (
    "total_eml_files", "total_pdf_files", "total_manifest_rows", "successful_rows", "failed_rows", "timeout_rows", "filtered_rows",
    "duplicate_eml_rows", "missing_pdfs_for_successful_rows", "eml_files_missing_manifest_rows", "manifest_eml_paths_missing_on_disk", "extra_pdf_files_not_referenced_by_manifest",
)
CONSISTENCY_FIELDS = ("duplicate_eml_rows", "missing_pdfs_for_successful_rows", "eml_files_missing_manifest_rows", "manifest_eml_paths_missing_on_disk")
