"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tsengine.llm import quality
from tsengine.llm.chat import op5_chat
from tsengine.llm.lm import op1_lm
from tsengine.llm.media import op9_media
from tsengine.llm.packing import op7_packing
from tsengine.llm.passages import op13_passages
from tsengine.llm.pieces import op8_pieces
from tsengine.llm.quality import op6_quality
from tsengine.llm.runs import op12_runs
from tsengine.llm.simhash import op4_simhash
from tsengine.llm.token_counts import op10_token_counts
from tsengine.llm.toxicity import op2_toxicity
from tsengine.llm.url_filters import op3_urls
from tsengine.llm.whitening import op11_whitening

QUERIES = {
    "op1_lm": op1_lm,
    "op2_toxicity": op2_toxicity,
    "op3_urls": op3_urls,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_pieces": op8_pieces,
    "op9_media": op9_media,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_runs": op12_runs,
    "op13_passages": op13_passages,
}

#: Digests of the turns as they were, and the length that the grammar gives them: a text is escaped once for each control string in it.
CHAT_SQL = r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
alone AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS g, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '[' || role || ']' END AS label FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('### ' || label || ': ') + length(text) + len(regexp_extract_all(text, '\\*(?:### (?:System|User|Assistant|\[[A-Za-z0-9_.~%-]*\]): |</turn>)')) + length(chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM alone GROUP BY conv_id, g"""


def quality_sql() -> str:
    """Counts, votes and the expectation-maximisation, which a recursive query walks round by round over the counts of votes."""
    rules = range(len(quality.RULES))
    space = r"[\x20\x09-\x0D]"
    share = lambda of: f"len(regexp_extract_all(t, '{of}')) / greatest(length(t), 1)"
    value = {
        "symbols": "n_symbols / n",
        "repeats": "n_repeat_words / n",
        "lines": "n_dup_lines / greatest(n_lines, 1)",
        "capitals": share("[A-Z]"),
        "digits": share("[0-9]"),
        "marks": share(r"""[!"''()+,\-./:;=?@\[\\\]^_`{}~]"""),
        "variety": "(n_words - n_kinds) / n - log10(n::DOUBLE / 50) * 0.15::DOUBLE",
    }
    votes = [f"CASE WHEN n_words = 0 THEN '0' WHEN {value[k]} >= {bad}::DOUBLE THEN '-' WHEN {value[k]} <= {good}::DOUBLE THEN '+' ELSE '0' END" for k, (bad, good) in quality.BOUNDS.items()]
    (low, high), (least, most) = quality.MEAN_WORD
    votes.append(f"CASE WHEN n_words = 0 THEN '0' WHEN word_chars / n < {low} OR word_chars / n > {high} THEN '-' WHEN word_chars / n BETWEEN {least} AND {most} THEN '+' ELSE '0' END")
    odds = " + ".join(f"CASE substr(votes, {i + 1}, 1) WHEN '+' THEN ln(g{i} / b{i}) WHEN '-' THEN ln((1 - g{i}) / (1 - b{i})) ELSE 0 END" for i in rules)
    posterior = f"1 / (1 + exp(-(ln(share / (1 - share)) + {odds})))"
    chance = lambda i, w, prior: f"(coalesce(sum({w}) FILTER (substr(votes, {i + 1}, 1) = '+'), 0) + {quality.PRIOR * prior}) / (coalesce(sum({w}) FILTER (substr(votes, {i + 1}, 1) <> '0'), 0) + {quality.PRIOR})"
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT id, doc_id, x, regexp_replace(x, '{space}', '', 'g') AS t, list_filter(string_split_regex(x, '{space}+'), lambda y: y <> '') AS words, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, words[i], words[i + 1], words[i + 2]) AS times FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeated AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(3) r(k) WHERE times > 1 GROUP BY 1),
q AS (SELECT doc_id, t, len(words) AS n_words, greatest(len(words), 1) AS n, len(list_distinct(words)) AS n_kinds, length(t) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN repeated USING (id)),
v AS (SELECT *, {" || ".join(votes)} AS votes, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q),
p AS (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY 1),
m AS (SELECT 0 AS i, 0.8::DOUBLE AS share, {", ".join(f"0.9::DOUBLE AS g{i}, 0.3::DOUBLE AS b{i}" for i in rules)} UNION ALL
SELECT i + 1, (sum(good) + {quality.PRIOR * 0.8}) / (sum(n) + {quality.PRIOR}), {", ".join(f"{chance(i, 'good', 0.9)}, {chance(i, 'n - good', 0.3)}" for i in rules)} FROM (SELECT *, n * ({posterior}) AS good FROM p, m WHERE i < {quality.ROUNDS}) GROUP BY i)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {posterior} >= {quality.KEEP} AS kept, round({posterior}, 6) AS good, votes FROM v, (SELECT * FROM m ORDER BY i DESC LIMIT 1)"""


#: Every window of 13 words with the smallest id that has it; words under a window of a larger id go.
PASSAGES_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS words FROM documents),
w AS (SELECT row, doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM d)),
gone AS (SELECT DISTINCT row, i + k AS i FROM (SELECT row, i FROM w JOIN (SELECT g, min(doc_id) AS least FROM w GROUP BY g) USING (g) WHERE doc_id > least), range(13) r(k)),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)"""


ORACLE_SQL: dict[str, str] = {"op5_chat": CHAT_SQL, "op6_quality": quality_sql(), "op13_passages": PASSAGES_SQL}
