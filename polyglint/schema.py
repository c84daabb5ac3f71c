"""Schemas of catalogue entries and diagnostics."""

MESSAGE = "struct<line_number:int,value:string,byte_start:bigint,byte_end:bigint>"
PLURAL = "struct<idx:int,line_number:int,value:string,byte_start:bigint,byte_end:bigint>"
ENTRY = (
    "path string, entry_idx int, line_number int, keywords array<string>, fuzzy boolean, obsolete boolean, noqa boolean, nowrap boolean, encoding_error boolean, noqa_rules array<string>, format_language string, "
    f"msgctxt {MESSAGE}, msgid {MESSAGE}, msgid_plural {MESSAGE}, msgstr array<{PLURAL}>, byte_start bigint, byte_end bigint, "
    "is_header boolean, is_translated boolean, language string, language_code string, country string, encoding_name string, nplurals int"
)
SEVERITIES = ("info", "warning", "error")
