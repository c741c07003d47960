"""SQL pieces that several queries share: how a text and a label are cleaned."""

from __future__ import annotations

SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{2028}\x{2029}]+"
_BIDI = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def _replaced(inner: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, to in pairs:
        inner = f"regexp_replace({inner}, '{pattern}', '{to}', 'g')"
    return inner


_ENTITIES = [("(?i)&quot;", '"'), ("(?i)&#39;", "''"), ("(?i)&amp;", "&"), ("(?i)&gt;", ">"), ("(?i)&lt;", "<")]
#: {0} is the text.
CLEAN = "trim(" + _replaced("@", [(_BIDI, ""), *_ENTITIES, (r"[\x{00AD}\x{200B}]", ""), (SPACE, " ")]).replace("{", "{{").replace("}", "}}").replace("@", "{0}") + ")"
#: {0} is the label: cleaned, without one lead-in of each kind.
LABEL = (
    "trim("
    + _replaced("@", [(r"(?i)^cf\.?\s+", ""), (r"(?i)^see also\s+", ""), (r"(?i)^see\s+", "")]).replace("@", CLEAN)
    + ")"
)

#: k(note_key, pos, segment, compare): segments of the footnotes.
SEGMENTS = (
    r"sl AS (SELECT note_key, regexp_split_to_array(regexp_replace(text, '(?i)\b(cf\.?)(\s|$)', chr(1) || '\1\2', 'g'), '[;' || chr(1) || ']') AS ss FROM footnotes WHERE text IS NOT NULL), "
    "sg AS (SELECT note_key, unnest(range(len(ss))) AS pos, unnest(ss) AS raw0 FROM sl), sc AS (SELECT note_key, pos, " + CLEAN.format("raw0") + " AS segment FROM sg), "
    r"k AS (SELECT *, max(CASE WHEN regexp_matches(segment, '(?i)^cf\.?(\s|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY note_key ORDER BY pos) = 1 AS compare FROM sc WHERE segment <> '')"
)
