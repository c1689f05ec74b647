"""The repetition rules in DuckDB's SQL."""

from __future__ import annotations

from mediasift.llm.quality import DUPLICATE_LIMITS, LINE_CHAR_LIMIT, LINE_LIMIT, TOP_LIMITS


def _gram(n: int) -> str:
    """A column with the n words from each place on, null where the text ends before."""
    return f"CASE WHEN lead(word, {n - 1}) OVER p IS NOT NULL THEN concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) OVER p" for k in range(1, n)) + f") END AS g{n}"


def sql() -> str:
    lengths = [*TOP_LIMITS, *DUPLICATE_LIMITS]
    grams = ", ".join(_gram(n) for n in lengths)
    counts = ", ".join(f"CASE WHEN g{n} IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id, g{n}) END AS c{n}" for n in lengths)
    inside = ", ".join(f"coalesce(max(c{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) > 1 AS in{n}" for n in DUPLICATE_LIMITS)
    lengths_on = ", ".join(f"lead(length(word), {k}) OVER p AS l{k}" for k in range(max(TOP_LIMITS)))
    before = ", ".join(f"lag(i) OVER (PARTITION BY doc_id, g{n} ORDER BY i) AS b{n}" for n in TOP_LIMITS)
    # an occurrence adds the words that the one before does not reach
    added = ", ".join(" + ".join(f"CASE WHEN b{n} IS NULL OR i + {k} >= b{n} + {n} THEN l{k} ELSE 0 END" for k in range(n)) + f" AS a{n}" for n in TOP_LIMITS)
    added_up = ", ".join(f"sum(a{n}) OVER (PARTITION BY doc_id, g{n}) AS s{n}" for n in TOP_LIMITS)
    tops = ", ".join(f"coalesce(arg_max(s{n}, (c{n}, s{n})) FILTER (WHERE c{n} > 1), 0) AS t{n}" for n in TOP_LIMITS)
    dups = ", ".join(f"coalesce(sum(length(word)) FILTER (WHERE in{n}), 0) AS d{n}" for n in DUPLICATE_LIMITS)
    shares = [(f"top_{n}gram_share", f"coalesce(t{n}, 0) / greatest(coalesce(word_chars, 0), 1)", limit) for n, limit in TOP_LIMITS.items()]
    shares += [(f"dup_{n}gram_share", f"coalesce(d{n}, 0) / greatest(coalesce(word_chars, 0), 1)", limit) for n, limit in DUPLICATE_LIMITS.items()]
    shares += [("dup_line_share", "coalesce(dup_lines, 0) / greatest(coalesce(n_lines, 0), 1)", LINE_LIMIT), ("dup_line_char_share", "coalesce(dup_chars, 0) / greatest(coalesce(line_chars, 0), 1)", LINE_CHAR_LIMIT)]
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS {name}" for name, e, _ in shares)
    bad = " OR ".join(f"{name} > {limit}" for name, _, limit in shares)
    return f"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), grams AS (SELECT doc_id, i, word, {lengths_on}, {grams} FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), counted AS (SELECT *, {counts}, {before} FROM grams
), added AS (SELECT *, {added} FROM counted
), covered AS (SELECT *, {inside}, {added_up} FROM added
), per_doc AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE in8) AS n_repeat_words, {tops}, {dups} FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, length(line) AS size, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), per_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again) AS dup_lines, sum(size) AS line_chars, sum(size) FILTER (WHERE again) AS dup_chars FROM lines GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {columns}
  FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_line USING (doc_id)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT (base_failed OR {bad}) AS kept FROM judged
"""
