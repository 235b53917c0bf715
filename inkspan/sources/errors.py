"""Messages that a caller may see: known ones as they are, others by kind, the rest a general one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages that readers give, others that are shown as they are, and those that stand for the rest.
FILE_LIMIT, EMPTY = "Document exceeds the 8 MB file limit.", "Source contains no extractable text."
BAD_NAME, BAD_ADDRESS = "Invalid source filename.", "Enter a valid email address."
DOCX_LIMITS, DOCX_BROKEN = "DOCX expanded content exceeds extraction limits.", "Failed to read DOCX file. It may be corrupt, encrypted, or unsupported."
PDF_BROKEN = "Failed to read PDF file. It may be corrupt, encrypted, or unsupported."
MANY_ENTRIES, LARGE_ARCHIVE, LARGE_ENTRY = "Archive contains too many entries (maximum 100).", "Archive expanded size exceeds 32 MB.", "Archive contains an oversized or encrypted entry."
KNOWN = (
    "Document text must be a string.", "Document exceeds the 100,000 character analysis limit.", "A passage exceeds 500 words. Split long passages into sentences.",
    FILE_LIMIT, "Filename or extension must be provided.", "Invalid file input type.", DOCX_LIMITS, DOCX_BROKEN, PDF_BROKEN, MANY_ENTRIES, LARGE_ARCHIVE, LARGE_ENTRY,
    "Too many documents (maximum 100).", BAD_NAME, "No sources directory configured.", "Unsupported content type for source file.",
    EMPTY, BAD_ADDRESS, "Sentence text must be a string.", "Report data must be an object.",
    "Invalid sentence text or offset.", "Invalid matched spans.", "Scores must be finite numbers between 0 and 100.",
)
SHAPE, FORMAT, ARCHIVE, GENERAL = "Report data has an invalid structure.", "Unsupported file format.", "The uploaded file is not a valid ZIP archive.", "The request could not be processed."


def public_message(message: Column, kind: Column, default: str = GENERAL) -> Column:
    """What is shown for an error's message and type."""
    shape = message.endswith(" must be an object.") | message.endswith(" must be an array of objects.")
    return (
        F.when(message.isin(*KNOWN), message).when(shape, SHAPE).when(message.startswith("Unsupported file format"), FORMAT).when(kind == "BadZipFile", ARCHIVE).otherwise(default)
    )
