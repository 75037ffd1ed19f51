"""Pieces of SQL that several oracles share."""

from quern.functions import fixed

from .notes import alternation

_SPACES = fixed.SPACE.replace("{", "{{").replace("}", "}}")
NORM = r"""trim(trim(regexp_replace(replace(nfc_normalize(coalesce({}, '')), chr(8203), ''), '""" + _SPACES + r"""+', ' ', 'g')), ' ' || chr(9) || '"''`')"""
META = alternation(fixed.META_NOTES)
FOLD = r"""trim(regexp_replace(regexp_replace(lower({}), '[.,;:!?\-]+', ' ', 'g'), '""" + _SPACES + r"""+', ' ', 'g'), ' ')"""
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')"
#: documents with norm, reason and key
PREPARED = rf"""
    n AS (SELECT *, {NORM.format('text')} AS norm FROM documents),
    prepared AS (
        SELECT *, CASE WHEN norm = '' THEN 'empty' WHEN regexp_matches(norm, '{META}') THEN 'meta'
                  WHEN length(regexp_replace(norm, '[^\p{{L}}\p{{N}}_]', '', 'g')) < 2 THEN 'short' END AS drop_reason,
               lang || '::' || {FOLD.format('norm')} AS dedup_key
        FROM n
    )"""
#: assistant turns as predictions, the user turn before as reference
PAIRS = """
    pairs AS (
        SELECT a.conv_id * 4294967296 + a.turn AS id, a.conv_id, coalesce(a.text, '') AS pred, coalesce(u.text, '') AS ref
        FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE a.role = 'assistant' AND u.role = 'user'
    )"""
METRIC_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_" + _SPACES[1:-1] + r"]', '', 'g'), '" + _SPACES + r"+'), lambda x: x <> '')"
