"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

import re

from foliant.functions import classify
from foliant.functions.text import PUBLISHER
from foliant.operators.chunk import MAX_TOKENS, OVERLAP
from foliant.operators.quality import ISSUES, WEIGHTS

METRICS = ("duplication_integrity", "contamination_integrity", "truncation_integrity")
LINES = "lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def _any(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(t)})" for t in terms) + ")"


def _tokens(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_%.-]+'), lambda t: regexp_replace(t, '^[%.-]+|[%.-]+$', '', 'g')), lambda t: t <> '')"


def _numbers(x: str) -> str:
    split = rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1' || chr(1), 'g')"
    found = rf"regexp_extract_all(' ' || {split} || ' ', '[^\p{{L}}\p{{N}}_](\d+(?:,\x01\d{{3}})*(?:\.\x01\d+)?(?:[eE][+-]?\d+)?%?)[^\p{{L}}\p{{N}}_]', 1)"
    # a leading space has no mark behind it, so a text's first number is found as well
    return f"list_transform({found}, lambda t: replace(replace(t, chr(1), ''), ',', ''))"


WORDS = "list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _metrics() -> str:
    running = "|".join(f"(?:{p})" for p in classify.RUNNING_TEXT)
    words = WORDS.format(c="c")
    numeric = rf"list_filter({words}, lambda w: regexp_full_match(trim(w, ',.;:()[]'), '[-+]?\d+(?:\.\d+)?%?'))"
    emails = f"len(regexp_extract_all(c, {_q(classify.EMAIL)}))"
    endings = ", ".join(_q(x) for x in classify.BAD_ENDINGS)
    marks = " OR ".join(f"ends_with(c, {_q(x)})" for x in classify.BAD_MARKS)
    return rf"""{LINES}, marked AS (
      SELECT doc_id, c, length(c) AS n, lower(c) AS k, count(*) FILTER (length(c) >= 20) OVER (PARTITION BY doc_id, lower(c)) AS repeats,
        lower(regexp_extract(regexp_replace(c, '[^a-zA-Z]+$', ''), '(\S+)$', 1)) IN ({endings}) OR {marks} AS truncated
      FROM (SELECT doc_id, {_clean("text")} AS c FROM lines)),
    judged AS (SELECT *, (n < 180 AND repeats >= 3) OR regexp_matches(k, {_q(running)})
        OR {emails} >= 2 OR ({emails} >= 1 AND {_any("k", classify.CORRESPONDENCE)})
        OR (len({words}) >= 12 AND len({numeric}) / len({words}) >= 0.25 AND {_any("k", classify.CHART_TERMS)}) AS contaminated FROM marked),
    metrics AS (SELECT doc_id,
        coalesce(count(DISTINCT CASE WHEN length(k) >= 40 THEN k END) / nullif(count(*) FILTER (length(k) >= 40), 0), 0.0) AS duplication_integrity,
        coalesce(1 - avg(contaminated::INT) FILTER (n >= 20), 0.0) AS contamination_integrity,
        coalesce(1 - avg(truncated::INT) FILTER (n >= 50), 0.0) AS truncation_integrity
      FROM judged GROUP BY doc_id)"""


def _report() -> str:
    total = sum(WEIGHTS[m] for m in METRICS)
    score = "(" + " + ".join(f"{m} * {WEIGHTS[m]}" for m in METRICS) + f") / {total}"
    flags = ", ".join(f"CASE WHEN {m} < {bound} THEN {_q(flag)} END" for m, (bound, flag) in ISSUES.items() if m in METRICS)
    return f"""WITH {_metrics()}, scored AS (SELECT *, {score} AS s FROM metrics)
    SELECT doc_id, {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)}, round(s, 4) AS integrity_score,
      CASE WHEN s >= 0.85 THEN 'healthy' WHEN s >= 0.70 THEN 'review' ELSE 'poor' END AS status,
      array_to_string(list_filter([{flags}], lambda x: x IS NOT NULL), ',') AS issues, l.quality AS label
    FROM scored LEFT JOIN labels l USING (doc_id)"""


def _publisher(x: str) -> str:
    for p in PUBLISHER:
        x = f"regexp_replace({x}, {_q('(?is)' + re.escape(p) + '.*')}, '')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
PAGES = r"pairs AS (SELECT page_id, trim(regexp_replace(array_to_string(regexp_extract_all(html, '<p>([^<]*)', 1), chr(10)), '\s+', ' ', 'g')) AS tei, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS pdf FROM pages)"


def _multiset(left: str, right: str) -> str:
    return f"""WITH {PAGES}, a AS (SELECT page_id, item, count(*) AS a FROM (SELECT page_id, unnest({left}) AS item FROM pairs) GROUP BY ALL),
    b AS (SELECT page_id, item, count(*) AS b FROM (SELECT page_id, unnest({right}) AS item FROM pairs) GROUP BY ALL)"""


def _packing() -> str:
    """One sentence after another: a recursion over each document's sentences, with the open chunk as lists."""
    words = WORDS.format(c=_clean("s"))
    return f"""WITH RECURSIVE sents AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
    counted AS (SELECT doc_id, ss, list_transform(ss, lambda s: len({words})) AS ns FROM sents WHERE len(ss) > 0),
    walk(doc_id, ss, ns, i, first, n, closed) AS (
      SELECT doc_id, ss, ns, 1, 1, ns[1], NULL::VARCHAR FROM counted
      UNION ALL
      SELECT doc_id, ss, ns, i + 1,
        CASE WHEN n + ns[i + 1] > {MAX_TOKENS} THEN i + 1 - keep ELSE first END,
        CASE WHEN n + ns[i + 1] > {MAX_TOKENS} THEN coalesce(list_sum(ns[i + 1 - keep : i]), 0)::BIGINT ELSE n END + ns[i + 1],
        CASE WHEN n + ns[i + 1] > {MAX_TOKENS} THEN array_to_string(ss[first:i], ' ') END
      FROM (SELECT *, len(list_filter(range(1, i - first + 2), lambda k: list_sum(ns[i - k + 1 : i]) <= {OVERLAP})) AS keep FROM walk WHERE i < len(ss))),
    texts AS (SELECT doc_id, i, closed AS text FROM walk WHERE closed IS NOT NULL
      UNION ALL SELECT doc_id, i + 1, array_to_string(ss[first:i], ' ') FROM walk WHERE i = len(ss))
    SELECT doc_id, printf('%d_chunk_%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS chunk_id, 'Introduction' AS section,
      NULL::INTEGER AS page_no, sha256(text) AS text_sha256 FROM texts"""


def _made() -> dict[str, str]:
    """SQL of the queries whose papers are made of the tables' texts."""
    c = _clean("text")
    affiliation = _any("lower(text)", classify.AFFILIATION)
    person = f"(length(text) <= 250 AND NOT {_any('lower(text)', classify.PERSON_LINE_STOPS)} AND (contains(text, ' & ') OR regexp_matches(text, '\\b[A-Z][a-z]+\\d')))"
    correspondence = "(contains(lower(text), 'email') OR contains(lower(text), 'correspondence') OR contains(text, '*'))"
    name = f"(len(string_split({c}, ' ')) BETWEEN 2 AND 6 AND NOT regexp_matches(text, '\\d'))"
    front = f"(ord % 2 = 0 AND (lower({c}) IN ({', '.join(_q(x) for x in classify.METADATA_LINES)}) OR {affiliation} OR {correspondence} OR {_any(f'lower({c})', PUBLISHER)}))"
    bad = r"(c = '' OR length(c) > 180 OR len(string_split(c, ' ')) > 20 OR (len(string_split(c, ' ')) <= 10 AND regexp_matches(c, '[=^_{}]')))"
    garbage = rf"(c = '' OR length(c) > 180 OR c IN ('•', '-', '_') OR regexp_full_match(c, '[\d\s%=+\-*/().]+') OR regexp_matches(lower(c), 'scientific reports\s*\||proceedings of the .*conference|\b(?:copyright|correspondence to)\b') OR (len(string_split(c, ' ')) <= 10 AND regexp_matches(c, '[=^_{{}}]')))"
    score = "CASE WHEN n >= 500 THEN 1.0 WHEN n >= 300 THEN 0.95 WHEN n >= 200 THEN 0.85 WHEN n >= 100 THEN 0.7 WHEN n > 0 THEN 0.4 ELSE 0.0 END"
    weights = "(0.0::DOUBLE + " + " + ".join(f"{m} * {w}::DOUBLE" for m, w in WEIGHTS.items()) + f") / {sum(WEIGHTS.values())}::DOUBLE"
    flags = ", ".join(f"CASE WHEN {m} < {bound} THEN {_q(flag)} END" for m, (bound, flag) in ISSUES.items())
    year = r"(?:19|20)\d{2}"
    first = lambda x, p: f"TRY_CAST(nullif(regexp_extract({x}, {_q(p)}, 1), '') AS INTEGER)"
    return {
        "layout_order": f"""WITH {LINES}, r AS (SELECT doc_id, ord, (length(text) % 600)::DOUBLE AS x, (length(text) * 7 % 90)::DOUBLE AS y, ord % 3 + 1 AS p FROM lines)
          SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY (x >= 300)::INT, y, ord) AS in_columns, row_number() OVER (PARTITION BY doc_id ORDER BY p, y, x, ord) AS in_pages FROM r""",
        "font_stats": rf"""WITH {LINES}, w AS (SELECT doc_id, ord, string_split(text, ' ') AS ws FROM lines),
          s AS (SELECT doc_id, ord, unnest(ws) AS word, unnest(range(len(ws))) AS span FROM w),
          l AS (SELECT doc_id, ord, {_clean("string_agg(word || ' ', '' ORDER BY span)")} AS text, round(max(8 + (ord + span) % 5 * 0.55), 1)::DOUBLE AS size, bool_or(((span * 8) >> 4) & 1 = 1) AS bold FROM s GROUP BY doc_id, ord),
          k AS (SELECT * FROM l WHERE text <> ''), f AS (SELECT doc_id, median(size) AS body FROM k GROUP BY doc_id)
          SELECT doc_id, ord // 4 AS block_no, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5, max(size) AS font_size, bool_or(bold) AS is_bold, round(any_value(body), 3) AS body_font_size FROM k JOIN f USING (doc_id) GROUP BY doc_id, ord // 4""",
        "coordinate_integrity": f"""WITH {LINES} SELECT doc_id, round(avg((CASE WHEN ord % 2 = 0 THEN ord % 7 <> 0 AND length(text) % 11 >= 1 AND length(text) % 5 > 0 AND ord % 4 > 0 ELSE length(text) % 3 > 0 END)::INT), 6) AS coordinate_integrity FROM lines GROUP BY doc_id""",
        "reference_integrity": f"""WITH l AS (SELECT doc_id, source, unnest(range(len(x)))::INTEGER AS ord, unnest(x) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)),
          r AS (SELECT doc_id, concat_ws(' ', CASE WHEN ord % 2 = 0 THEN nullif(text, '') END, CASE WHEN ord % 5 = 1 THEN nullif(text, '') END, CASE WHEN ord % 3 = 0 THEN '[''' || source || ''', ''' || source || ''']' END) AS t FROM l)
          SELECT doc_id, round(avg((length({_clean("t")}) >= 20)::INT), 6) AS reference_integrity FROM r GROUP BY doc_id""",
        "structure_integrity": f"""WITH {LINES}, k AS (SELECT doc_id, ord, {c} AS c FROM lines),
          v AS (SELECT doc_id, avg((NOT {bad})::INT) AS valid FROM k WHERE ord % 5 = 0 GROUP BY doc_id), g AS (SELECT doc_id, avg((ord % 4 = 0)::INT) AS assigned FROM k WHERE ord % 5 <> 0 GROUP BY doc_id)
          SELECT doc_id, round(coalesce(0.6 * valid + 0.4 * assigned, 0.0), 6)::DOUBLE AS structure_integrity FROM v FULL JOIN g USING (doc_id)""",
        "abstract_integrity": f"""WITH {PAGES}, r AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '' ELSE tei END AS a, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN regexp_replace(pdf, '[aeiou]', '', 'g') ELSE pdf END AS p FROM pairs),
          t AS (SELECT page_id, unnest({_tokens("a")}) AS token FROM r), k AS (SELECT DISTINCT page_id, unnest({_tokens("p")}) AS token FROM r),
          h AS (SELECT page_id, count(k.token) / count(*) AS h FROM t LEFT JOIN k USING (page_id, token) GROUP BY page_id),
          q AS (SELECT page_id, lower({_clean("a")}) AS a, lower({_clean("p")}) AS p, length({_clean("a")}) AS n FROM r)
          SELECT page_id, round(CASE WHEN a = '' THEN 0.0 WHEN p = '' THEN {score} WHEN contains(p, a) THEN 1.0 ELSE coalesce(h, 0.0) END, 6)::DOUBLE AS abstract_integrity FROM q LEFT JOIN h USING (page_id)""",
        "abstract_regions": f"""WITH {LINES}, r AS (SELECT doc_id, ord, {c} AS c, min(CASE WHEN ord % 7 = 2 THEN ord END) OVER (PARTITION BY doc_id) AS f FROM lines),
          e AS (SELECT *, min(CASE WHEN ord % 7 = 5 AND ord > f THEN ord END) OVER (PARTITION BY doc_id) AS stop FROM r)
          SELECT doc_id, md5(string_agg(c, ' ' ORDER BY ord)) AS abstract_md5 FROM e WHERE ord >= f AND (stop IS NULL OR ord < stop) AND c <> '' GROUP BY doc_id""",
        "artifact_dedup": rf"""WITH {LINES}, k AS (SELECT *, {c} AS c, ord % 3 AS page FROM lines),
          f AS (SELECT doc_id, ord, 'formula' AS kind, printf('formula_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY ord)) AS name, page, regexp_replace(lower(text), '\s+', '', 'g') AS key FROM k),
          r AS (SELECT doc_id, ord, 'reference' AS kind, '' AS name, {_clean("CASE WHEN ord % 2 = 0 THEN text END")} AS raw, {_clean("text")} AS title FROM k),
          q AS (SELECT *, lower(CASE WHEN raw <> '' THEN raw ELSE title END) AS key FROM r WHERE raw = '' OR length(raw) >= 15)
          SELECT doc_id, ord, kind, name FROM f WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key, page ORDER BY ord) = 1
          UNION ALL (SELECT doc_id, ord, kind, name FROM q WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) = 1)
          UNION ALL (SELECT doc_id, ord, 'section', '' FROM k WHERE length(text) <= 60 AND NOT {garbage} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY ord) = 1)
          UNION ALL (SELECT doc_id, ord, 'figure', '' FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, {_clean("text")}, page ORDER BY ord) = 1)""",
        "page_blocks": rf"""WITH {LINES}, b AS (SELECT doc_id, ord, ord // 7 + 1 AS page, length(text) % 6 * 90 AS x0, 60 + ord * 37 % 11 * 60 AS y0, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS t FROM lines),
          k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(t), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) AS key FROM b WHERE t <> '' AND NOT regexp_matches(lower(trim(t)), '^(?:{'|'.join(classify.HEADER_FOOTER)})') AND NOT (regexp_full_match(trim(t), '\d+') AND (y0 < 60 OR y0 + 20 > 760))),
          f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page, key ORDER BY ord) = 1),
          p AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY y0, x0, ord) AS t FROM f GROUP BY doc_id, page)
          SELECT doc_id, count(*)::INTEGER AS num_pages, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM p GROUP BY doc_id""",
        "layout_passes": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), f AS (SELECT doc_id, count(*)::INTEGER AS n, (count(*) FILTER (regexp_matches(x, '[0-9]')))::INTEGER AS m, sum(length(x))::INTEGER AS c FROM l GROUP BY doc_id),
          e AS (SELECT *, CASE WHEN doc_id % 40 = 3 THEN 'ValueError' WHEN doc_id % 40 = 5 AND m > 0 THEN 'TimeoutError' END AS error FROM f)
          SELECT doc_id, CASE WHEN error IS NULL THEN n END AS n_blocks, CASE WHEN error IS NULL THEN m END AS n_formulas, CASE WHEN error IS NULL THEN c + 2 * m END AS n_chars, error IS NULL AND m > 0 AS enriched, error FROM e""",
        "cleaning_outcomes": """WITH e AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS n, CASE doc_id % 50 WHEN 1 THEN 'no layout tree' WHEN 2 THEN 'broken layout tree' WHEN 3 THEN 'a layout tree without texts' WHEN 4 THEN 'no filename' WHEN 5 THEN 'no result' END AS error FROM documents)
          SELECT doc_id, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS outcome, error, CASE WHEN error IS NULL THEN n END AS n_blocks, error IS NOT NULL AS again FROM e""",
        "page_abstracts": rf"""WITH {LINES}, m AS (SELECT doc_id, ord, trim(CASE WHEN ord % 6 = 1 THEN '1 Department of ' || text WHEN ord % 6 = 2 THEN 'Lee2 ' || text WHEN ord % 6 = 5 AND doc_id % 3 = 0 THEN '2.1 ' || text WHEN ord % 6 = 4 AND doc_id % 3 = 1 THEN ' Keywords ' || text ELSE text END) AS t FROM lines WHERE ord < 40),
          h AS (SELECT doc_id, min(ord) AS title FROM m WHERE length({_clean("t")}) BETWEEN 20 AND 250 AND NOT {_any("lower(t)", classify.TEXT_METADATA)} GROUP BY doc_id),
          a AS (SELECT m.* FROM m JOIN h USING (doc_id) WHERE t <> '' AND ord > title AND NOT (length(t) <= 300 AND regexp_matches(t, '[A-Z][a-z]+\d')) AND NOT {_any("lower(t)", classify.BLOCK_AFFILIATION)}),
          s AS (SELECT *, max((starts_with(lower(t), 'keywords') OR regexp_matches(t, '^[0-9]+(?:\.[0-9]+)*\.?\s+'))::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stopped FROM a),
          g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY ord) AS abstract FROM s WHERE stopped = 0 AND length(t) >= 60 GROUP BY doc_id)
          SELECT doc_id, md5(abstract) AS abstract_md5, length(abstract)::INTEGER AS n_chars FROM g""",
        "metadata_scores": f"""SELECT doc_id, round((CASE WHEN doc_id % 3 = 0 OR {c} = '' THEN 0 ELSE 1 END + (CASE WHEN doc_id % 4 <> 0 THEN 1990 + doc_id % 4 END IS NOT DISTINCT FROM CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 1 THEN 1991 ELSE 1990 + doc_id % 5 END)::INT
          + (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)::INT + doc_id % 6 / 6) / 4, 6)::DOUBLE AS metadata FROM documents""",
        "provenance_rules": f"""WITH {LINES}, b AS (SELECT *, length(text) % 9 <> 0 AND length(text) % 4 > ord % 3 AND length(text) % 7 > ord % 5 AS box FROM lines) SELECT doc_id, count(*) FILTER (box AND ord % 6 <> 0) AS n_valid, count(*) FILTER (box) AS n_boxes FROM b GROUP BY doc_id""",
        "author_names": rf"""WITH {LINES}, f AS (SELECT doc_id, ord, text, CASE ord % 4 WHEN 0 THEN text || ' & Bob Ray2*, ' || text WHEN 1 THEN 'Ann Lee1, ' || text || ' and Cy  Dee' WHEN 2 THEN 'Ann Lee,ann lee , ' || text ELSE text END AS field FROM lines),
          k AS (SELECT *, {_clean("field")} AS c FROM f),
          l AS (SELECT doc_id, ord, list_filter(list_transform(CASE WHEN contains(c, ' & ') THEN string_split(c, ' & ') WHEN contains(lower(c), ' and ') THEN string_split(c, ' and ') ELSE [c] END, lambda x: trim(regexp_replace(x, '[0-9]+[*†‡]*', '', 'g'), ' ,.*')), lambda x: x <> '') AS tei,
            list_filter(list_transform(regexp_split_to_array(c, ',\s*|\s+and\s+|\s*&\s*'), lambda x: trim(x)), lambda x: x <> '') AS pdf,
            list_filter(list_transform([' Bob Ray; ', text, ', ' || text || ' .', field], lambda x: trim({_clean("x")}, ' ,;.')), lambda x: x <> '') AS names FROM k)
          SELECT doc_id, ord, md5(array_to_string(tei, '|')) AS tei_md5, {", ".join(f"md5(array_to_string(list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i), '|')) AS {n}" for c, n in (("pdf", "pdf_md5"), ("names", "list_md5")))} FROM l""",
        "node_items": f"""WITH {LINES} SELECT doc_id, ord, md5(CASE WHEN ord % 3 = 0 AND text <> '' THEN {c} WHEN ord % 4 < 2 THEN {_clean("'f = ' || text")} ELSE '' END) AS text_md5, CASE WHEN ord % 5 <> 0 THEN 1 + ord % 3 END AS page_no FROM lines""",
        "reference_lists": rf"""WITH {LINES}, m AS (SELECT doc_id, ord, {_clean("CASE WHEN ord = 2 THEN 'References' WHEN ord % 10 = 4 THEN '[7] Lee, A.: A title.' WHEN ord % 10 = 9 THEN '7. lee a A Title' WHEN ord % 2 = 0 THEN '[' || ord || '] ' || text WHEN ord % 3 = 0 THEN ord || '. ' || text ELSE text END")} AS c FROM lines),
          h AS (SELECT *, min(ord) FILTER (lower(c) = 'references') OVER (PARTITION BY doc_id) AS begun, trim(regexp_replace(regexp_replace(lower(c), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM m)
          SELECT doc_id, ord, md5(c) AS text_md5 FROM h WHERE ord >= begun AND key <> '' AND regexp_matches(c, '^\s*(?:\[\d+\]|\d+\.)\s+') QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) = 1""",
        "front_abstracts": rf"""WITH {LINES}, m AS (SELECT doc_id, ord, {_clean("CASE WHEN ord % 6 = 1 THEN 'Ann Lee1 & ' || text WHEN ord % 6 = 2 THEN 'Department of ' || text WHEN ord = 3 AND doc_id % 3 = 0 THEN 'ABSTRACT : ' || text WHEN ord % 9 = 8 AND doc_id % 2 = 0 THEN 'Keywords ' || text ELSE text END")} AS text FROM lines),
          h AS (SELECT doc_id, min(ord) AS title FROM m WHERE length(text) BETWEEN 20 AND 300 AND NOT contains(lower(text), 'pdftitle') AND NOT starts_with(text, chr(92)) GROUP BY doc_id),
          a AS (SELECT doc_id, ord, text, starts_with(lower(text), 'abstract') OR (length(text) >= 60 AND len(string_split(text, ' ')) >= 10 AND regexp_matches(text, '[.!?]') AND NOT {front.replace("ord % 2 = 0 AND ", "")} AND NOT {person}) AS opens FROM m JOIN h USING (doc_id) WHERE ord > title),
          b AS (SELECT *, min(ord) FILTER (opens) OVER (PARTITION BY doc_id) AS begun FROM a), e AS (SELECT *, min(ord) FILTER (ord >= begun AND regexp_matches(text, '(?i)^\s*keywords?\b')) OVER (PARTITION BY doc_id) AS ended FROM b),
          g AS (SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (t <> ''), '') AS abstract FROM (SELECT doc_id, ord, trim(regexp_replace(text, '(?i)^abstract\s*:?\s*', '')) AS t FROM e WHERE ord >= begun AND (ended IS NULL OR ord < ended)) GROUP BY doc_id)
          SELECT doc_id, md5(abstract) AS abstract_md5, length(abstract)::INTEGER AS n_chars FROM g""",
        "canonical_texts": f"""WITH {LINES}, k AS (SELECT *, {c} AS c FROM lines),
          h AS (SELECT doc_id, ord AS place, lower(c) AS key, c AS heading FROM k WHERE length(text) <= 60 AND NOT {garbage} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY ord) = 1),
          p AS (SELECT doc_id, ord, c, CASE WHEN length(text) <= 60 THEN ' ' || text WHEN ord % 3 = 0 THEN 'Else' WHEN ord % 3 = 1 THEN '' END AS section FROM k WHERE c <> ''),
          j AS (SELECT p.*, lower({_clean("section")}) AS k, place, heading FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND lower({_clean("section")}) = h.key),
          o AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, k) AS since, first_value(section) OVER (PARTITION BY doc_id, k ORDER BY ord) AS own FROM j WHERE place IS NULL AND k <> ''),
          parts AS (SELECT doc_id, 0 AS rank, 0 AS a, 0 AS b, CASE WHEN doc_id % 4 <> 0 THEN {_clean("source")} END AS t FROM documents
            UNION ALL SELECT doc_id, 1, 0, 0, '## Abstract' || chr(10) || chr(10) || {_clean("' in  ' || lang")} FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL
            UNION ALL (SELECT DISTINCT doc_id, 2, place, -1, '## ' || heading FROM j WHERE place IS NOT NULL) UNION ALL SELECT doc_id, 2, place, ord, c FROM j WHERE place IS NOT NULL
            UNION ALL (SELECT DISTINCT doc_id, 3, 0, -1, '## Unsectioned' FROM j WHERE place IS NULL AND k = '') UNION ALL SELECT doc_id, 3, 0, ord, c FROM j WHERE place IS NULL AND k = ''
            UNION ALL (SELECT DISTINCT doc_id, 4, since, -1, '## ' || own FROM o) UNION ALL SELECT doc_id, 4, since, ord, c FROM o),
          g AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY rank, a, b) AS t FROM parts WHERE t <> '' GROUP BY doc_id)
          SELECT doc_id, md5(t) AS text_md5, length(t)::INTEGER AS n_chars FROM g""",
        "reference_scores": """WITH r AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
          k AS (SELECT doc_id, CASE WHEN ord % 5 <> 0 THEN text END AS a, CASE WHEN ord % 4 <> 1 THEN text || CASE WHEN ord % 3 = 0 THEN '?' ELSE '' END END AS e, length(text) % 3 AS y FROM r),
          n AS (SELECT doc_id, count(a)::INTEGER AS n_actual, count(e)::INTEGER AS n_expected FROM k GROUP BY doc_id),
          x AS (SELECT doc_id, a AS t, y, count(*) AS n FROM k WHERE a IS NOT NULL GROUP BY ALL), z AS (SELECT doc_id, e AS t, y, count(*) AS n FROM k WHERE e IS NOT NULL GROUP BY ALL),
          m AS (SELECT doc_id, sum(least(x.n, z.n)) AS m FROM x JOIN z USING (doc_id, t, y) GROUP BY doc_id)
          SELECT doc_id, n_actual, n_expected, round(CASE WHEN coalesce(m, 0) = 0 THEN 0.0 ELSE 2 * (m / n_actual) * (m / n_expected) / (m / n_actual + m / n_expected) END, 6)::DOUBLE AS reference_f1 FROM n LEFT JOIN m USING (doc_id)""",
        "sentence_repeats": """WITH l AS (SELECT doc_id, text, len(string_split(text, chr(10)))::INTEGER AS n FROM documents), s AS (SELECT doc_id, text, unnest(range(least(n, 12))) AS i FROM l WHERE n IS NOT NULL),
          g AS (SELECT doc_id, string_agg('S' || sha256(i || ' ' || text) || CASE WHEN i % 2 = 0 THEN '.' ELSE ' !' END, ' ' ORDER BY i) AS t FROM s GROUP BY doc_id)
          SELECT doc_id, n AS n_made, md5(t) AS text_md5 FROM l JOIN g USING (doc_id)""",
        "abstract_choices": rf"""WITH {LINES}, s AS (SELECT doc_id, string_agg(c, ' ' ORDER BY ord) AS s FROM (SELECT doc_id, ord, {c} AS c FROM lines WHERE doc_id % 3 = 0 AND ord BETWEEN 1 AND 3) WHERE c <> '' GROUP BY doc_id),
          p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {_clean("' by ' || source")} ELSE '' END AS a, {_clean("CASE doc_id % 4 WHEN 1 THEN 'Title ABSTRACT : ' || text || ' Keywords: none' WHEN 2 THEN 'Abstract short. Introduction ' || text ELSE text END")} AS t FROM documents),
          x AS (SELECT doc_id, a, trim(regexp_extract(t, '(?is)\babstract\b\s*:?\s*(.*?)(?:\bintroduction\b|\bkeywords?\b|\bbackground\b|\brelated\s+work\b|\bmaterials?\s+and\s+methods?\b|\bmethods?\b)', 1)) AS b FROM p),
          r AS (SELECT doc_id, coalesce(nullif(a, ''), s, CASE WHEN length(b) >= 80 THEN b END, '') AS abstract FROM x LEFT JOIN s USING (doc_id))
          SELECT doc_id, md5(abstract) AS abstract_md5, length(abstract)::INTEGER AS n_chars FROM r""",
        "canonical_records": rf"""WITH {LINES}, k AS (SELECT *, {c} AS c, 1 + ord % 2 AS page FROM lines),
          h AS (SELECT doc_id, ord AS place, lower(c) AS key, c AS heading FROM k WHERE length(text) <= 60 AND NOT {garbage} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY ord) = 1),
          a AS (SELECT doc_id, max(CASE WHEN doc_id % 3 = 0 AND ord = 0 THEN c ELSE '' END) AS abstract FROM k GROUP BY doc_id),
          p AS (SELECT k.doc_id, ord, c, page, CASE WHEN length(text) <= 60 THEN ' ' || text WHEN ord % 3 = 0 THEN 'Else' WHEN ord % 3 = 1 THEN '' END AS section FROM k JOIN a USING (doc_id) WHERE c <> '' AND lower(c) <> lower(abstract)),
          q AS (SELECT p.doc_id, ord, c, page, coalesce(heading, section) AS s FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND lower({_clean("section")}) = h.key),
          w AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM q),
          t AS (SELECT *, lower({_clean("section")}) AS k FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c), page ORDER BY ord) = 1),
          j AS (SELECT t.doc_id, t.ord, t.c, t.k, t.section, place, heading FROM t LEFT JOIN h ON t.doc_id = h.doc_id AND t.k = h.key),
          o AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, k) AS since, first_value(section) OVER (PARTITION BY doc_id, k ORDER BY ord) AS own FROM j WHERE place IS NULL AND k <> ''),
          title AS (SELECT doc_id, {_clean("' T  ' || source")} AS title FROM documents),
          parts AS (SELECT doc_id, 0 AS rank, 0 AS a, 0 AS b, title AS t FROM title UNION ALL SELECT doc_id, 1, 0, 0, '## Abstract' || chr(10) || chr(10) || abstract FROM a WHERE abstract <> ''
            UNION ALL (SELECT DISTINCT doc_id, 2, place, -1, '## ' || heading FROM j WHERE place IS NOT NULL) UNION ALL SELECT doc_id, 2, place, ord, c FROM j WHERE place IS NOT NULL
            UNION ALL (SELECT DISTINCT doc_id, 3, 0, -1, '## Unsectioned' FROM j WHERE place IS NULL AND k = '') UNION ALL SELECT doc_id, 3, 0, ord, c FROM j WHERE place IS NULL AND k = ''
            UNION ALL (SELECT DISTINCT doc_id, 4, since, -1, '## ' || own FROM o) UNION ALL SELECT doc_id, 4, since, ord, c FROM o),
          g AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY rank, a, b) AS t FROM parts WHERE t <> '' GROUP BY doc_id),
          n AS (SELECT doc_id, count(DISTINCT (regexp_replace(lower(text), '\s+', '', 'g'), page)) FILTER (regexp_replace(text, '\s+', '', 'g') <> '')::INTEGER AS n_formulas, count(DISTINCT (c, page))::INTEGER AS n_figures, count(DISTINCT (c, page)) FILTER (length(text) > 60)::INTEGER AS n_tables,
            count(DISTINCT lower(c)) FILTER (c <> '' AND (ord % 2 = 1 OR length(c) >= 15))::INTEGER AS n_references FROM k GROUP BY doc_id),
          names AS (SELECT doc_id, list_filter(['Ann Lee', trim({_clean("source")}, ' ,;.'), trim({_clean("source || ' .'")}, ' ,;.')], lambda x: x <> '') AS names FROM documents)
          SELECT doc_id, title, array_to_string(list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i), '|') AS authors, CASE WHEN doc_id % 300 + 1850 BETWEEN 1900 AND 2100 THEN (doc_id % 300 + 1850)::INTEGER END AS year, CASE WHEN doc_id % 4 <> 0 THEN '10.1/' || doc_id END AS doi,
            coalesce(n_s, 0)::INTEGER AS n_sections, coalesce(n_p, 0)::INTEGER AS n_paragraphs, n_formulas, n_figures, n_tables, n_references, md5(coalesce(t, '')) AS text_md5
          FROM documents JOIN title USING (doc_id) JOIN names USING (doc_id) JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_s FROM h GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_p FROM t GROUP BY doc_id) USING (doc_id)""",
        "cleaned_papers": rf"""WITH {LINES}, m AS (SELECT doc_id, ord, CASE WHEN ord < 6 THEN 1 ELSE 2 END AS page, {_clean("CASE WHEN ord = 1 THEN 'Ann Lee' || doc_id % 7 || '* & Bob Ray2, ' WHEN ord = 2 THEN 'Department of X' WHEN ord = 3 THEN 'Published: 2 May ' || (doc_id % 30 + 1990) WHEN ord = 4 AND doc_id % 3 = 0 THEN 'ABSTRACT : ' || text WHEN ord = 8 THEN 'REFERENCES' WHEN ord > 8 AND ord % 3 <> 0 THEN '[' || ord || '] ' || text ELSE text END")} AS text FROM lines WHERE ord <> 1 OR doc_id % 2 = 0),
          f AS (SELECT * FROM m WHERE page = 1 AND text <> ''), h AS (SELECT doc_id, min(ord) AS t, arg_min(text, ord) AS title FROM f WHERE length(text) BETWEEN 20 AND 300 AND NOT contains(lower(text), 'pdftitle') AND NOT starts_with(text, chr(92)) GROUP BY doc_id),
          b AS (SELECT f.*, t, {_any("lower(text)", classify.AUTHOR_SKIPS)} AS skip, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS turn FROM f LEFT JOIN h USING (doc_id) WHERE t IS NULL OR ord > t),
          s AS (SELECT *, max(((length(text) >= 60 AND len(string_split(text, ' ')) >= 10 AND regexp_matches(text, '[.!?]')) OR (NOT skip AND regexp_matches(text, '(?i)^\s*keywords?\b')))::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stopped FROM b WHERE turn <= 8),
          l AS (SELECT doc_id, ord, CASE WHEN contains(text, '&') THEN regexp_split_to_array(text, '\s*&\s*') ELSE regexp_split_to_array(text, '\s*;\s*') END AS parts FROM s WHERE stopped = 0 AND NOT skip AND length(text) <= 500),
          q AS (SELECT doc_id, ord, i, trim(regexp_replace(regexp_replace(part, '\d+[*†‡]*', '', 'g'), '[*†‡]+', '', 'g'), ' ,.') AS name FROM (SELECT doc_id, ord, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM l)),
          u AS (SELECT * FROM q WHERE name <> '' AND len(string_split({_clean("name")}, ' ')) BETWEEN 2 AND 6 AND NOT regexp_matches(name, '\d') QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY ord, i) = 1),
          g AS (SELECT doc_id, string_agg(name, '|' ORDER BY ord, i) AS names FROM u GROUP BY doc_id),
          y AS (SELECT doc_id, arg_min(y, ord) AS y FROM (SELECT doc_id, ord, nullif(regexp_extract(text, '\b((?:19|20)[0-9]{{2}})\b', 1), '')::INTEGER AS y FROM m WHERE page = 1 AND contains(lower(text), 'published')) WHERE y IS NOT NULL GROUP BY doc_id),
          o AS (SELECT doc_id, ord, text, length(text) >= 60 AND len(string_split(text, ' ')) >= 10 AND regexp_matches(text, '[.!?]') AND NOT {front.replace("ord % 2 = 0 AND ", "")} AND NOT {person} OR starts_with(lower(text), 'abstract') AS opens FROM b WHERE t IS NOT NULL),
          ob AS (SELECT *, min(ord) FILTER (opens) OVER (PARTITION BY doc_id) AS begun FROM o), oe AS (SELECT *, min(ord) FILTER (ord >= begun AND regexp_matches(text, '(?i)^\s*keywords?\b')) OVER (PARTITION BY doc_id) AS ended FROM ob),
          ab AS (SELECT doc_id, bool_or(regexp_replace(text, '(?i)^abstract\s*:?\s*', '') <> '') AS has FROM oe WHERE ord >= begun AND (ended IS NULL OR ord < ended) GROUP BY doc_id),
          z AS (SELECT *, coalesce(ord >= min(ord) FILTER (lower(text) = 'references') OVER (PARTITION BY doc_id), false) AS inside, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM m),
          rr AS (SELECT doc_id, ord, text FROM z WHERE inside AND key <> '' AND regexp_matches(text, '^\s*(?:\[\d+\]|\d+\.)\s+') QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) = 1),
          r AS (SELECT doc_id, count(*)::INTEGER AS n, string_agg(text, '|' ORDER BY ord) AS r FROM rr GROUP BY doc_id),
          n AS (SELECT doc_id, count(*)::INTEGER AS total, count(*) FILTER (NOT inside AND NOT {front.replace("ord % 2 = 0", "page = 1")} AND NOT regexp_matches(text, '(?i)^(?:Figure|Fig\.|Table)\s*\d+\b') AND NOT regexp_matches(text, '(?i)^\s*keywords?\b') AND {_publisher("text")} <> '')::INTEGER AS kept FROM z GROUP BY doc_id)
          SELECT doc_id, md5(regexp_replace(title, '[†‡]+$', '')) AS title_md5, coalesce(nullif(names, ''), CASE WHEN doc_id % 3 <> 0 THEN 'Zed Poe|Cy Dee' ELSE '' END) AS authors, coalesce(CASE doc_id % 4 WHEN 0 THEN 2011 WHEN 1 THEN 1987 END, y) AS year, coalesce(has, false) AS has_abstract,
            coalesce(r.n, 0) AS n_references, md5(coalesce(r, '')) AS references_md5, coalesce(total, 0) AS total_text_nodes, coalesce(kept, -1) AS n_kept
          FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN ab USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)""",
        "layout_pairs": f"""WITH {LINES},
          t AS (SELECT DISTINCT doc_id, false AS heading, lower({c}) AS x FROM lines WHERE ord % 3 = 0 UNION SELECT DISTINCT doc_id, true, lower({_clean("'2 ' || text")}) FROM lines WHERE ord % 3 = 1),
          b AS (SELECT doc_id, lower({_clean("CASE WHEN ord % 5 = 2 THEN 'Fig ' || text ELSE text END")}) AS y, max((ord % 2 = 0)::INT) = 1 AS head FROM lines GROUP BY ALL),
          l AS (SELECT doc_id, heading, x, list_distinct(string_split(x, ' ')) AS xs FROM t WHERE x <> ''), r AS (SELECT doc_id, y, head, list_distinct(string_split(y, ' ')) AS ys FROM b WHERE y <> ''),
          p AS (SELECT l.doc_id, heading, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.9 END AS direct, len(list_intersect(xs, ys)) / len(xs)::DOUBLE AS overlap, 2.0 * least(length(x), length(y)) / (length(x) + length(y)) AS bound
            FROM l JOIN r ON l.doc_id = r.doc_id AND (head OR NOT heading))
          SELECT doc_id, heading, count(*) FILTER (direct = 1.0) AS n_equal, count(*) FILTER (direct = 0.9) AS n_held, count(*) FILTER (direct IS NULL) AS n_ratio, round(sum(overlap), 6) AS overlap
          FROM p WHERE direct IS NOT NULL OR 0.65::DOUBLE * overlap + 0.35::DOUBLE * bound >= 0.45::DOUBLE GROUP BY doc_id, heading""",
        "paragraph_pairs": f"""WITH {LINES}, k AS (SELECT DISTINCT doc_id, ord % 2 AS side, lower({c}) AS x FROM lines WHERE {c} <> ''),
          u AS (SELECT *, row_number() OVER () AS id FROM k),
          g AS (SELECT id, doc_id, side, n, length(x) AS size, substr(x, i, n) AS gram, count(*) AS often FROM (SELECT *, unnest(range(1, length(x) - n + 2)) AS i FROM (SELECT *, unnest([1, 2]) AS n FROM u)) GROUP BY ALL),
          m AS (SELECT a.doc_id, a.id AS e, b.id AS a_, a.size AS s, b.size AS z, coalesce(sum(least(a.often, b.often)) FILTER (a.n = 1), 0) AS ones, coalesce(sum(least(a.often, b.often)) FILTER (a.n = 2), 0) AS twos
            FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.n = b.n AND a.gram = b.gram AND 3 * least(a.size, b.size) >= 2 * greatest(a.size, b.size) WHERE a.side = 1 AND b.side = 0 GROUP BY ALL)
          SELECT doc_id, count(*) AS n_pairs, sum(s)::BIGINT AS n_expected, sum(z)::BIGINT AS n_actual FROM m WHERE 5 * ones >= 2 * (s + z) AND 5 * twos >= s + z - 5 GROUP BY doc_id""",
        "canonical_paragraphs": f"""WITH {LINES}, k AS (SELECT *, {c} AS c FROM lines),
          h AS (SELECT doc_id, lower(c) AS key, c AS heading FROM k WHERE length(text) <= 60 AND NOT {garbage} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY ord) = 1),
          p AS (SELECT k.doc_id, ord, c, ord % 2 AS page, CASE WHEN length(text) <= 60 THEN ' ' || text WHEN ord % 3 = 0 THEN 'Else' END AS section, first_value(c) OVER (PARTITION BY k.doc_id ORDER BY ord) AS abstract FROM k),
          j AS (SELECT p.*, coalesce(h.heading, section) AS s FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND lower({_clean("section")}) = h.key WHERE c <> '' AND lower(c) <> lower(abstract)),
          w AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS own FROM j)
          SELECT doc_id, ord, md5(c) AS text_md5, own AS section FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c), page ORDER BY ord) = 1""",
        "title_rules": f"""WITH {LINES}, k AS (SELECT doc_id, ord, {c} AS c FROM lines),
          t AS (SELECT doc_id, min(ord) FILTER (length(c) BETWEEN 20 AND 300 AND NOT contains(lower(c), 'pdftitle') AND NOT starts_with(c, chr(92))) AS title_ord, min(ord) FILTER (length(c) BETWEEN 20 AND 250 AND NOT {_any("lower(c)", classify.TEXT_METADATA)}) AS candidate_ord FROM k GROUP BY doc_id)
          SELECT t.doc_id, md5(c) AS title_md5, title_ord, candidate_ord FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND k.ord = t.title_ord WHERE title_ord IS NOT NULL OR candidate_ord IS NOT NULL""",
        "front_authors": rf"""WITH {LINES}, n AS (SELECT doc_id, 2 * ord + k AS ord, {_clean("CASE WHEN ord = 1 AND k = 0 THEN 'Ann Lee' || (doc_id % 7) || '* & Bob Ray2, ; Cy Dee' WHEN ord = 1 THEN regexp_replace(text, '[.!?,]', ' &', 'g') WHEN ord = 2 THEN 'Department of X' ELSE text END")} AS c FROM lines JOIN (VALUES (0), (1)) AS v(k) ON ord = 1 OR k = 0),
          t AS (SELECT doc_id, min(ord) FILTER (length(c) BETWEEN 20 AND 300 AND NOT contains(lower(c), 'pdftitle') AND NOT starts_with(c, chr(92))) AS t FROM n GROUP BY doc_id),
          a AS (SELECT n.*, {_any("lower(c)", classify.AUTHOR_SKIPS)} AS skip, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS turn FROM n JOIN t USING (doc_id) WHERE t IS NULL OR ord > t),
          s AS (SELECT *, max(((length(c) >= 60 AND len(string_split(c, ' ')) >= 10 AND regexp_matches(c, '[.!?]')) OR (NOT skip AND regexp_matches(c, '(?i)^\s*keywords?\b')))::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stopped FROM a WHERE turn <= 8),
          l AS (SELECT doc_id, ord, CASE WHEN contains(c, '&') THEN regexp_split_to_array(c, '\s*&\s*') ELSE regexp_split_to_array(c, '\s*;\s*') END AS parts FROM s WHERE stopped = 0 AND c <> '' AND NOT skip AND length(c) <= 500),
          q AS (SELECT doc_id, ord, i, trim(regexp_replace(regexp_replace(part, '\d+[*†‡]*', '', 'g'), '[*†‡]+', '', 'g'), ' ,.') AS name FROM (SELECT doc_id, ord, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM l)),
          k AS (SELECT * FROM q WHERE name <> '' AND len(string_split({_clean("name")}, ' ')) BETWEEN 2 AND 6 AND NOT regexp_matches(name, '\d') QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY ord, i) = 1),
          g AS (SELECT doc_id, string_agg(name, '|' ORDER BY ord, i) AS authors FROM k GROUP BY doc_id)
          SELECT doc_id, coalesce(authors, '') AS authors FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN g USING (doc_id)""",
        "person_and_front_matter": f"""WITH {LINES} SELECT doc_id, count(*) FILTER ({person}) AS person_lines, count(*) FILTER ({name}) AS person_names, count(*) FILTER ({correspondence}) AS correspondence, count(*) FILTER ({front}) AS front_matter,
          count(*) FILTER (regexp_full_match(text, '(?i)\\s*references\\s*')) AS reference_headings, count(*) FILTER ({" OR ".join(f"starts_with(lower(trim(text)), {_q(t)})" for t in classify.CHUNK_METADATA)}) AS chunk_metadata, count(*) FILTER ({_any("lower(text)", classify.TEXT_METADATA)}) AS metadata FROM lines GROUP BY doc_id""",
        "year_rules": f"""WITH d AS (SELECT doc_id, length(text) AS n, (doc_id % 300 + 1850)::VARCHAR AS y, 'c. ' || (doc_id % 300 + 1850) || 'x' AS t FROM documents)
          SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN y::INT BETWEEN 1900 AND 2100 THEN y::INT ELSE {first("y", f"({year})")} END ELSE {first("t", f"({year})")} END AS year_of,
            CASE WHEN doc_id % 3 = 0 THEN y::INT END AS pdf_year, CASE WHEN regexp_full_match(y, '{year}') THEN y::INT END AS stated_year,
            CASE WHEN doc_id % 3 = 0 THEN y::INT WHEN doc_id % 2 = 1 AND regexp_full_match(y, '{year}') THEN y::INT END AS metadata_year, ({score})::DOUBLE AS length_score FROM d""",
        "text_rules": rf"""WITH d AS (SELECT doc_id, text, doc_id AS i FROM documents),
          o AS (SELECT doc_id, list_distinct(string_split(lower({_clean("text")}), ' ')) AS a, list_distinct(string_split(lower({_clean("regexp_replace(text, '[aeiou]', '', 'g')")}), ' ')) AS b FROM d)
          SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(10) || ' ')), lambda s: s <> '')) AS n_sentences,
            len(string_split(text, chr(10))) + 1 AS n_lines, md5(regexp_replace(lower(text), '\s+', '', 'g')) AS formula_key, '10.1/x' || i AS doi_key, md5({_clean("text")}) AS title,
            (i % 5) || '. Some heading' || CASE WHEN i % 5 = i % 3 THEN '' ELSE ' ' || (i % 3) || '.' END AS heading,
            lower(regexp_extract(regexp_replace({_clean("text")}, '[^a-zA-Z]+$', ''), '(\S+)$', 1)) AS last_word, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS overlap FROM d JOIN o USING (doc_id)""",
        "registry_update": """WITH f AS (SELECT doc_id, sha256(text) AS h, printf('/in/%09d.pdf', doc_id) AS path FROM documents), o AS (SELECT printf('paper_%03d', doc_id + 1) AS paper_id, doc_id || '.pdf' AS filename, h FROM f WHERE doc_id % 4 = 0),
          m AS (SELECT max(doc_id + 1) AS m FROM f WHERE doc_id % 4 = 0), n AS (SELECT path, h FROM f WHERE h NOT IN (SELECT h FROM o) QUALIFY row_number() OVER (PARTITION BY h ORDER BY path) = 1),
          lowest AS (SELECT h, min(paper_id) AS paper_id FROM o GROUP BY h)
          SELECT o.paper_id, filename, o.h AS file_hash, CASE WHEN l.paper_id IS NULL THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN l.paper_id IS NULL THEN 'e' END AS error FROM o LEFT JOIN lowest l ON l.paper_id = o.paper_id
          UNION ALL SELECT 'paper_' || lpad((m + row_number() OVER (ORDER BY path))::VARCHAR, greatest(3, length((m + row_number() OVER (ORDER BY path))::VARCHAR))::INTEGER, '0'), path[5:], h, 'hashed', NULL FROM n, m""",
        "layout_tree": f"""WITH {LINES} SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (ord % 4 = 0) AS n_formulas, count(*) FILTER (ord % 4 = 0 AND (ord % 3 = 0 OR text = '')) AS n_orig, count(*) FILTER (ord % 5 <> 0) AS n_coords,
          round(coalesce(sum((ord + 2.0) * length(text)) FILTER (ord % 5 <> 0), 0), 3)::DOUBLE AS area, 0 AS n_figures FROM lines GROUP BY doc_id""",
        "tei_records": rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^A-Za-z \n]', '', 'g'), chr(10))) AS x FROM documents),
          s AS (SELECT doc_id, 'H' || length(x) AS h, lower({_clean("'a b ' || x || '. Done now.'")}) AS p, lower({_clean("x")}) AS q FROM l),
          o AS (SELECT doc_id, count(*) AS n, sum(length(p)) AS c FROM (SELECT DISTINCT doc_id, h, p FROM s) GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS n, sum(length(q)) AS c FROM (SELECT DISTINCT doc_id, q FROM s WHERE q <> '') GROUP BY doc_id),
          g AS (SELECT s.doc_id, 2 * count(DISTINCT h) AS n_sections, any_value(o.n) + coalesce(any_value(i.n), 0) AS n_paragraphs, (any_value(o.c) + coalesce(any_value(i.c), 0))::INT AS n_chars, 2 * any_value(o.n) + coalesce(any_value(i.n), 0) AS n_sentences,
            coalesce(any_value(i.n), 0) AS n_nested, any_value(o.n) AS n_placed, any_value(o.n) AS n_coords, 1 AS n_figures, 3 AS table_page, 'All of it' AS caption, 1 AS n_references, 'Ref ' || s.doc_id AS ref_title, 'JournalRef ' || s.doc_id || 'Ann Lee' AS ref_raw, 'T' || s.doc_id AS title
            FROM s JOIN o USING (doc_id) LEFT JOIN i USING (doc_id) GROUP BY s.doc_id)
          SELECT doc_id, doc_id % 50 IN (7, 9) AS failed, {", ".join(f"CASE WHEN doc_id % 50 NOT IN (7, 9) THEN {k} END AS {k}" for k in ("n_sections", "n_paragraphs", "n_chars", "n_sentences", "n_nested", "n_placed", "n_coords", "n_figures", "table_page", "caption", "n_references", "ref_title", "ref_raw", "title"))} FROM g""",
        "accuracy_scores": """WITH d AS (SELECT doc_id, doc_id AS i, n_chars AS n FROM documents), s AS (SELECT *, CASE WHEN i % 11 > 0 THEN greatest(0.0, 1 - abs(n % 13 - i % 11) / (i % 11)) ELSE 0.0 END AS tables, CASE WHEN i % 5 > 0 THEN greatest(0.0, 1 - abs(n % 7 - i % 5) / (i % 5)) ELSE 0.0 END AS figures,
            coalesce(2 * (i % 4 / 4) * (i % 3 / 3) / nullif(i % 4 / 4 + i % 3 / 3, 0), 0.0) AS sections FROM d)
          SELECT doc_id, round(tables, 6) AS tables, round(figures, 6) AS figures, round(sections, 6) AS sections,
            round(i % 9 / 9 * 0.2 + sections * 0.15 + i % 5 / 5 * 0.2 + i % 6 / 6 * 0.15 + i % 7 / 7 * 0.1 + tables * 0.05 + figures * 0.05 + i % 8 / 8 * 0.1, 6) AS overall FROM s""",
        "integrity_evaluation": f"""WITH {_metrics()}, k AS (SELECT doc_id, ord, text, {c} AS c FROM lines),
          b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS tei, text AS pdf, source FROM documents),
          na AS (SELECT doc_id, item, count(*) AS a FROM (SELECT doc_id, unnest({_numbers("tei")}) AS item FROM b) GROUP BY ALL), nb AS (SELECT doc_id, item, count(*) AS b FROM (SELECT doc_id, unnest({_numbers("lower(pdf)")}) AS item FROM b) GROUP BY ALL),
          num AS (SELECT na.doc_id, sum(least(a, coalesce(b, 0))) / sum(a) AS h FROM na LEFT JOIN nb USING (doc_id, item) GROUP BY na.doc_id),
          ta AS (SELECT doc_id, item, count(*) AS a FROM (SELECT doc_id, unnest({_tokens("tei")}) AS item FROM b) GROUP BY ALL), tb AS (SELECT doc_id, item, count(*) AS b FROM (SELECT doc_id, unnest({_tokens("pdf")}) AS item FROM b) GROUP BY ALL),
          tok AS (SELECT doc_id, 2 * sum(least(coalesce(a, 0), coalesce(b, 0))) / (sum(a) + sum(b)) AS f FROM ta FULL JOIN tb USING (doc_id, item) GROUP BY doc_id),
          per AS (SELECT doc_id, count(*) AS n, avg((NOT {bad})::INT) AS valid, avg((ord % 4 <> 0)::INT) AS assigned, avg((length(c) >= 20)::INT) AS ref, avg((ord % 3 > 0)::INT) AS coord, max(text) FILTER (ord = 0) AS title FROM k GROUP BY doc_id),
          m AS (SELECT doc_id, n, ((doc_id % 2 = 0 AND title <> '')::INT + (source IS NOT NULL)::INT + 1) / 4 AS metadata_integrity, 0.0 AS abstract_integrity, 0.6 * valid + 0.4 * assigned AS structure_integrity, duplication_integrity, ref AS reference_integrity, truncation_integrity,
            CASE WHEN {_clean("tei")} = '' THEN 0.0 ELSE coalesce(h, 0.5) END AS numeric_consistency, coalesce(f, 0.0) AS cross_parser_consistency, contamination_integrity, coord AS coordinate_integrity, 1 - assigned AS orphan
            FROM per JOIN metrics USING (doc_id) JOIN b USING (doc_id) LEFT JOIN num USING (doc_id) LEFT JOIN tok USING (doc_id)), s AS (SELECT *, {weights} AS s FROM m)
          SELECT doc_id, {", ".join(f"round({x}::DOUBLE::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS {x}" for x in WEIGHTS)}, round(s::DOUBLE::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS integrity_score, CASE WHEN s >= 0.85 THEN 'healthy' WHEN s >= 0.70 THEN 'review' ELSE 'poor' END AS status, array_to_string(list_filter([{flags}], lambda x: x IS NOT NULL), ',') AS issues,
            round(orphan::DOUBLE::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS orphan_paragraph_ratio, n::INT AS n_figures, n::INT AS n_text_blocks, 0 AS n_formulas, n::INT AS tei_sections, n::INT AS tei_paragraphs, n::INT AS tei_references, (n // 2)::INT AS tei_figures, ((n + 1) // 2)::INT AS tei_tables FROM s""",
    }


def oracle_sql() -> dict[str, str]:
    c = _clean("text")
    garbage = rf"(c = '' OR length(c) > 180 OR c IN ('•', '-', '_') OR regexp_full_match(c, '[\d\s%=+\-*/().]+') OR regexp_matches(lower(c), 'scientific reports\s*\||proceedings of the .*conference|\b(?:copyright|correspondence to)\b') OR (len(string_split(c, ' ')) <= 10 AND regexp_matches(c, '[=^_{{}}]')))"
    bad = r"(c = '' OR length(c) > 180 OR len(string_split(c, ' ')) > 20 OR (len(string_split(c, ' ')) <= 10 AND regexp_matches(c, '[=^_{}]')))"
    weights = " ".join(f"WHEN '{m}' THEN {WEIGHTS[m]}" for m in METRICS)
    return {
        "quality_report": _report(),
        "metric_variance_report": f"""WITH {_metrics()}, long AS (UNPIVOT (SELECT doc_id, {", ".join(METRICS)} FROM metrics) ON {", ".join(METRICS)} INTO NAME metric VALUE value),
          stats AS (SELECT metric, (CASE metric {weights} END)::DOUBLE AS weight, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, arg_min(doc_id, (value, doc_id)) AS worst, count(*) AS n FROM long GROUP BY metric)
          SELECT metric, weight, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, worst, n, weight <= 0.06 AND std > 0.02 AS flagged, n < 15 AS few FROM stats""",
        "run_counters": f"SELECT status, count(*) AS n FROM ({_report()}) GROUP BY status",
        "paragraph_integrity": f"WITH {_metrics()} SELECT doc_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, 1.0::DOUBLE AS orphan_paragraph_ratio FROM metrics",
        "dedup_exact": "SELECT doc_id, sha256(text) AS file_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1",
        "line_dedup_first_wins": rf"WITH {LINES}, keyed AS (SELECT doc_id, ord, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) AS key FROM lines) SELECT * FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) = 1",
        "header_footer_filter": rf"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM lines WHERE NOT regexp_matches(lower(trim(text)), '^(?:{'|'.join(classify.HEADER_FOOTER)})') GROUP BY doc_id",
        "audit_stats": rf"SELECT doc_id, length(text) AS characters, len({WORDS.format(c=c)}) AS words, len(regexp_extract_all(text, '\b\d+(?:\.\d+)?%?\b')) AS numbers FROM documents",
        "numeric_tokens": f"SELECT doc_id, number, count(*) AS n FROM (SELECT doc_id, unnest({_numbers('text')}) AS number FROM documents) GROUP BY ALL",
        "token_frequency": f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token",
        "page_numeric_consistency": _multiset(_numbers("tei"), _numbers("lower(pdf)")) + """, hit AS (SELECT a.page_id, sum(least(a, coalesce(b, 0))) / sum(a) AS h FROM a LEFT JOIN b USING (page_id, item) GROUP BY a.page_id)
          SELECT page_id, round(CASE WHEN tei = '' OR pdf = '' THEN 0.0 ELSE coalesce(h, 0.5) END, 6)::DOUBLE AS numeric_consistency FROM pairs LEFT JOIN hit USING (page_id)""",
        "page_token_f1": _multiset(_tokens("tei"), _tokens("pdf")) + """, f AS (SELECT page_id, sum(least(coalesce(a, 0), coalesce(b, 0))) AS o, sum(a) AS a, sum(b) AS b FROM a FULL JOIN b USING (page_id, item) GROUP BY page_id)
          SELECT page_id, round(coalesce(2 * o / (a + b), 0.0), 6)::DOUBLE AS cross_parser_consistency FROM pairs LEFT JOIN f USING (page_id)""",
        "page_metadata": rf"""SELECT *, ((title <> '')::INT + (heading <> '')::INT + (lang <> '')::INT) / 4 AS completeness FROM (SELECT page_id,
          {_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_clean("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS heading, {_clean("regexp_extract(html, '<html lang=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS lang FROM pages)""",
        "publisher_text_truncation": f"WITH {LINES} SELECT doc_id, sum(length(text))::BIGINT AS n_chars, sum(length({_publisher('text')}))::BIGINT AS n_left FROM lines GROUP BY doc_id",
        "author_and_person_filters": rf"""WITH {LINES} SELECT doc_id, count(*) FILTER (length(text) <= 300 AND regexp_matches(text, '[A-Z][a-z]+\d')) AS author_blocks, count(*) FILTER ({_any("lower(text)", classify.AFFILIATION)}) AS affiliations,
          count(*) FILTER (length(text) >= 60 AND len(string_split({c}, ' ')) >= 10 AND regexp_matches(text, '[.!?]')) AS body_sentences, count(*) FILTER (regexp_matches(text, '(?i)^(?:Figure|Fig\.|Table)\s*\d+\b')) AS captions,
          count(*) FILTER (regexp_matches(text, '^\s*(?:\[\d+\]|\d+\.)\s+')) AS numbered, count(*) FILTER (regexp_matches(text, '(?i)^\s*keywords?\b')) AS keywords FROM lines GROUP BY doc_id""",
        "heading_filters": f"WITH {LINES}, k AS (SELECT doc_id, {c} AS c FROM lines) SELECT doc_id, count(*) FILTER ({garbage}) AS garbage, count(*) FILTER ({bad}) AS bad, count(*) FILTER (lower(c) IN ({', '.join(_q(x) for x in classify.MAJOR_SECTIONS)})) AS major FROM k GROUP BY doc_id",
        "conversation_carry_forward": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations",
        "section_segmentation": rf"""WITH {LINES}, r AS (SELECT doc_id, ord, CASE WHEN length(text) <= 60 AND {c} <> '' THEN (ord + 1) || '. ' || {c} ELSE {c} END AS line FROM lines),
          k AS (SELECT *, regexp_matches(line, '^\s*[0-9]+(?:\.[0-9]+)*\.?\s+.+?\s*$') AS opens FROM r WHERE line <> '' AND NOT ({" OR ".join(f"starts_with(lower(line), {_q(t)})" for t in classify.CHUNK_METADATA)})),
          s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS section_no FROM k)
          SELECT doc_id, section_no, coalesce(max(CASE WHEN opens THEN line END), 'Introduction') AS section, length(string_agg(CASE WHEN NOT opens THEN line END, ' ' ORDER BY ord)) AS n_chars FROM s GROUP BY doc_id, section_no HAVING count(*) FILTER (NOT opens) > 0""",
        "sentence_split": f"SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS n_chars, max(length(s)) AS longest FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents) GROUP BY doc_id",
        "chunk_packing": _packing(),
        "normalized_text": rf"""SELECT doc_id, md5({c}) AS cleaned, md5(lower({c})) AS normalized, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS block,
          md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS sentence_key FROM documents""",
        "benchmark_coverage": f"""WITH i AS (SELECT item_id, unnest({_tokens("text")}) AS token FROM benchmark), k AS (SELECT DISTINCT unnest({_tokens("text")}) AS token FROM documents)
          SELECT item_id, round(count(k.token) / count(*), 6) AS coverage, count(*) AS n_tokens FROM i LEFT JOIN k USING (token) GROUP BY item_id""",
        "reference_folding": r"""WITH r AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN (turn + 1) || '. ' || regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS line FROM conversations),
          stops AS (SELECT *, max((contains(lower(line), 'disclaimer') OR contains(lower(line), 'publisher''s note'))::INT) OVER w AS stopped FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
          n AS (SELECT *, sum(regexp_matches(line, '^[0-9]+\. ')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS ref_no FROM stops WHERE stopped = 0 AND line <> '')
          SELECT conv_id, ref_no, md5(trim(regexp_replace(string_agg(line, ' ' ORDER BY turn), '\s+', ' ', 'g'))) AS reference_md5 FROM n WHERE ref_no > 0 GROUP BY conv_id, ref_no""",
    } | _made()
