"""The stemmer as DuckDB SQL over a table of words, for the queries' oracles: regular expressions, a step a table."""

from __future__ import annotations

from lodestrata.functions import stem as S

_V = S.VOWEL


def _has(end: str, w: str = "w") -> str:
    return f"ends_with({w}, '{end}')"


def _longest(rules: dict[str, str], region: str, extra: dict[str, str] | None = None) -> str:
    """CASE over endings, longest first; one that is found and may not go ends the step."""
    out = []
    for end in sorted(rules, key=len, reverse=True):
        fits = f"length(w) - {len(end)} >= {region}"
        if end in S.BEFORE:
            fits += f" AND regexp_matches(w, '{S.BEFORE[end]}{end}$')"
        if extra and end in extra:
            fits += f" AND {extra[end]}"
        out.append(f"WHEN {_has(end)} THEN CASE WHEN {fits} THEN w[:-{len(end) + 1}] || '{rules[end]}' ELSE w END")
    return f"CASE {' '.join(out)} ELSE w END"


def stem_sql(words: str) -> str:
    """SQL for (word, stem) of a table `words` of distinct words (word)."""
    special = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SPECIAL.items())
    region = lambda w: f"length(regexp_extract({w}, '^.*?{_V}[^aeiouy]'))"
    keep = "word, given, r1, r2"
    plural = f"""CASE WHEN {_has('sses')} THEN w[:-3] WHEN {_has('ied')} OR {_has('ies')} THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
      WHEN {_has('us')} OR {_has('ss')} THEN w WHEN {_has('s')} AND regexp_matches(w, '{_V}.+s$') THEN w[:-2] ELSE w END"""
    cut = " ".join(f"WHEN {_has(e)} THEN CASE WHEN regexp_matches(w, '{_V}.*{e}$') THEN w[:-{len(e) + 1}] END" for e in ("ingly", "edly", "ing", "ed"))
    past = f"CASE WHEN {_has('eedly')} OR {_has('eed')} THEN NULL {cut} END"
    eed = f"CASE WHEN {_has('eedly')} AND length(w) - 5 >= r1 THEN w[:-6] || 'ee' WHEN {_has('eed')} AND length(w) - 3 >= r1 THEN w[:-4] || 'ee' ELSE w END"
    mended = f"""CASE WHEN c IS NULL THEN {eed} WHEN regexp_matches(c, '(?:at|bl|iz)$') THEN c || 'e' WHEN regexp_matches(c, '(?:{S.DOUBLE})$') THEN c[:-2]
      WHEN length(c) <= r1 AND regexp_matches(c, '{S.SHORT}') THEN c || 'e' ELSE c END"""
    last = f"CASE WHEN {_has('e')} AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(w[:-2], '{S.SHORT}'))) THEN w[:-2] WHEN {_has('ll')} AND length(w) > r2 THEN w[:-2] ELSE w END"
    return f"""(WITH t0 AS (SELECT word, CASE word {special} ELSE CASE WHEN length(word) <= 2 OR NOT regexp_full_match(word, '[a-z]+') THEN word END END AS given,
    regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM {words}),
  t1 AS (SELECT word, given, w, CASE WHEN regexp_matches(w, '^(?:{'|'.join(S.LONG)})') THEN length(regexp_extract(w, '^(?:{'|'.join(S.LONG)})')) WHEN {region('w')} = 0 THEN length(w) ELSE {region('w')} END AS r1 FROM t0),
  t2 AS (SELECT word, given, r1, CASE WHEN {region('w[r1 + 1:]')} = 0 THEN length(w) ELSE r1 + {region('w[r1 + 1:]')} END AS r2, w FROM t1),
  t3 AS (SELECT {keep}, {plural} AS w FROM t2),
  t4 AS (SELECT word, CASE WHEN given IS NULL AND w IN {S.STAY} THEN w ELSE given END AS given, r1, r2, w FROM t3),
  t5 AS (SELECT {keep}, w, {past} AS c FROM t4),
  t6 AS (SELECT {keep}, {mended} AS w FROM t5),
  t7 AS (SELECT {keep}, regexp_replace(w, '^(..*[^aeiouy])[yY]$', '\\1i') AS w FROM t6),
  t8 AS (SELECT {keep}, {_longest(S.STEP2, 'r1')} AS w FROM t7),
  t9 AS (SELECT {keep}, {_longest(S.STEP3, 'r1', {'ative': 'length(w) - 5 >= r2'})} AS w FROM t8),
  t10 AS (SELECT {keep}, {_longest(S.STEP4, 'r2')} AS w FROM t9)
SELECT word, coalesce(given, replace({last}, 'Y', 'y')) AS stem FROM t10)"""
