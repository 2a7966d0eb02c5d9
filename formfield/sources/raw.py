"""Pages as bytes: what is not UTF-8 goes to quarantine with its place and reason, instead of being read as other characters.

Everything is SQL functions over one scan. A page that ``is_valid_utf8`` accepts costs no more than that; only the others are
searched for their first wrong byte, as text of one character per byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_COLUMNS = ("page_id", "captured_at", "content")
BOM = "\ufeff"
#: Bytes after which more must follow, and what: the well-formed sequences of UTF-8.
_MORE = (
    ("[\\xC2-\\xDF]", "[\\x80-\\xBF]"), ("\\xE0", "[\\xA0-\\xBF][\\x80-\\xBF]"), ("[\\xE1-\\xEC\\xEE\\xEF]", "[\\x80-\\xBF]{2}"),
    ("\\xED", "[\\x80-\\x9F][\\x80-\\xBF]"), ("\\xF0", "[\\x90-\\xBF][\\x80-\\xBF]{2}"), ("[\\xF1-\\xF3]", "[\\x80-\\xBF]{3}"),
    ("\\xF4", "[\\x80-\\x8F][\\x80-\\xBF]{2}"),
)
_STRAY = r"(?<![\xC2-\xF4])(?<![\xE0-\xF4][\x80-\xBF])(?<![\xF0-\xF4][\x80-\xBF]{2})[\x80-\xBF]"
_NEVER = r"[\xC0\xC1\xF5-\xFF]"
_WRONG = "|".join([_NEVER, *(f"{start}(?!{more})" for start, more in _MORE), _STRAY])
#: The start of a sequence whose bytes are right as far as they go.
_CUT = r"^(?:[\xC2-\xF4]|\xE0[\xA0-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]|\xED[\x80-\x9F]|\xF0[\x90-\xBF][\x80-\xBF]?|[\xF1-\xF3][\x80-\xBF]{1,2}|\xF4[\x80-\x8F][\x80-\xBF]?)$"

MISSING, UTF16, CUT = "no content", "UTF-16 byte order mark", "ends within a character"
NEVER, STRAY, BROKEN = "byte that UTF-8 never has", "continuation byte without a start", "start byte without its continuation"
REASONS = (MISSING, UTF16, CUT, NEVER, STRAY, BROKEN)


def _whole_files(reader, path, glob: str | None) -> DataFrame:
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("page_id"), F.col("modificationTime").alias("captured_at"), "content")


def read_raw_pages(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """One row per file: its path, modification time and bytes. Spark's file scans pass over files without any bytes."""
    return _whole_files(spark.read.format("binaryFile"), path, glob)


def read_raw_page_stream(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """The same rows as a stream over a folder that receives files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _whole_files(spark.readStream.format("binaryFile").schema(schema), path, glob)


def wrong_byte(content: Column) -> Column:
    """Place (from 0) of the first byte that breaks UTF-8, NULL where there is none."""
    at = F.regexp_instr(F.decode(content, "ISO-8859-1"), F.lit(_WRONG))
    return F.when(at > 0, (at - 1).cast("long"))


def _reason(content: Column, at: Column) -> Column:
    rest = F.decode(F.substring(content, at.cast("int") + 1, F.lit(4)), "ISO-8859-1")
    return (
        F.when(content.isNull(), MISSING)
        .when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), UTF16)
        .when(rest.rlike("^" + _NEVER), NEVER).when(rest.rlike(r"^[\x80-\xBF]"), STRAY).when(rest.rlike(_CUT), CUT).otherwise(BROKEN)
    )


def decode_pages(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Split raw pages into decoded ones and undecodable ones.

    Decoded pages have ``text`` in place of the bytes, without a byte order mark at its beginning, otherwise unchanged. The
    others keep their bytes and get ``byte_offset``, the first wrong byte counted from 0, and ``reason``, one of REASONS. No bytes
    are a page of empty text; missing content (NULL) is undecodable, with no offset. Other columns pass.
    """
    if {"text", "byte_offset", "reason"} & (set(df.columns) - {content}):
        raise ValueError("raw pages have a column text, byte_offset or reason already")
    raw = F.col(f"`{content}`")
    good = F.coalesce(F.is_valid_utf8(raw.cast("string")), F.lit(False))
    text = raw.cast("string")
    plain = F.when(F.startswith(text, F.lit(BOM)), F.substr(text, F.lit(2))).otherwise(text)
    others = [F.col(f"`{c}`") for c in df.columns if c != content]
    at = wrong_byte(raw)
    return (
        df.filter(good).select(*others, plain.alias("text")),
        df.filter(~good).select(*others, raw.alias(content), at.alias("byte_offset"), _reason(raw, at).alias("reason")),
    )
