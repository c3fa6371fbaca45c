"""SQL fragments that the oracle queries share, and small helpers."""

from __future__ import annotations

from ..functions.headers import LICENSE_NAMES, SKIP_NAMES, TEXT_SUFFIXES
from ..functions.text import TOKEN


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: ASCII view of the column ``bytes``.
ASCII = r"decode(unhex(replace(regexp_replace(regexp_replace(hex(bytes), '(..)', '\1 ', 'g'), '[89A-F]. ', '20 ', 'g'), ' ', '')))"
TOKENS = f"regexp_extract_all(text, '{TOKEN}')"
NAME = "split_part(relpath, '/', -1)"
IS_TEXT = (
    f"({NAME} NOT IN ({quoted([*SKIP_NAMES, *LICENSE_NAMES])}) AND NOT starts_with({NAME}, 'ChangeLog') AND NOT ends_with({NAME}, '.patch') "
    f"AND (regexp_extract({NAME}, '[^.]\\.([^.]*)$', 1) IN ({quoted(TEXT_SUFFIXES)}) OR ends_with({NAME}, '.exp')))"
)
#: Distinct corpus files with their ASCII text.
CORPUS = f"corpus AS (SELECT DISTINCT file_id, project, relpath, size, bytes, {ASCII} AS text FROM corpus_files)"


def runs_sql(words: str, width: int) -> str:
    return (
        f"CASE WHEN len({words}) > 0 THEN list_transform(range(1, greatest(len({words}) - {width - 1}, 1) + 1), lambda i: array_to_string({words}[i:i+{width - 1}], ' ')) "
        "ELSE [] END"
    )


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both}::DOUBLE / (len({a}) + len({b}) - {both}) ELSE 0 END"
