"""Row-local fixes on streaming DataFrames.

These fixes look at one row at a time and need no state, so the batch functions apply
to a stream as they are. Statistics a batch audit found enter as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.operators import clean, privacy, validate

ROW_LOCAL = {
    "drop_empty_rows": clean.drop_empty_rows,
    "junk_to_null": clean.junk_to_null,
    "standardize_strings": clean.standardize_strings,
    "strip_html_tags": clean.strip_html_tags,
    "remove_extra_whitespace": clean.remove_extra_whitespace,
    "remove_special_characters": clean.remove_special_characters,
    "fix_date_formats": clean.fix_date_formats,
    "validate_emails": validate.validate_emails,
    "validate_phones": validate.validate_phones,
    "flag_test_data": validate.flag_test_data,
}


def clean_stream(stream: DataFrame, fixes: Sequence[str], mask: Sequence[str] = ()) -> DataFrame:
    """Apply the named row-local fixes, then mask the given columns."""
    unknown = [f for f in fixes if f not in ROW_LOCAL]
    if unknown:
        raise ValueError(f"not row-local: {unknown}; known: {sorted(ROW_LOCAL)}")
    for fix in fixes:
        stream = ROW_LOCAL[fix](stream)
    return privacy.mask_pii(stream, mask) if mask else stream
