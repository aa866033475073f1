"""DuckDB SQL fragments for the oracle side of the driver contract.

They restate the selection rules in SQL over the same fixed values, so the oracle is
an independent formulation (regexes and list functions instead of Spark's).  Imports and
definitions are not searched in the text at all: ``planted`` states what each file holds.
"""

from __future__ import annotations

from ..functions import paths as P
from ..sources.corpus import FILES_SQL, corpus_cte
from . import planted


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re_escape(s: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in s)


NAME = "regexp_extract(rel_path, '[^/]*$', 0)"


def language_sql(name: str = NAME) -> str:
    ext = f"regexp_extract({name}, '^\\.*[^.].*(\\.[^.]*)$', 1)"
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in P.EXTENSION_LANGUAGE.items())
    return f"(CASE {ext} {whens} END)"


def skipped_dir_sql() -> str:
    alts = "|".join(_re_escape(d) for d in P.SKIP_DIRS) + "|\\.[^/]*"
    return f"regexp_matches(rel_path, {_q('(^|/)(' + alts + ')/')})"


def test_file_sql(name: str = NAME) -> str:
    n = f"lower({name})"
    parts = [f"starts_with({n}, {_q(p)})" for p in P.TEST_PREFIXES]
    parts += [f"ends_with({n}, {_q(s)})" for s in P.TEST_SUFFIXES]
    return "(" + " OR ".join(parts) + ")"


def skipped_suffix_sql(name: str = NAME) -> str:
    return "(" + " OR ".join(f"ends_with({name}, {_q(s)})" for s in P.SKIP_SUFFIXES) + ")"


def skipped_name_sql(name: str = NAME) -> str:
    return f"({name} IN ({', '.join(_q(x) for x in P.SKIP_FILENAMES)}))"


def selected_cte() -> str:
    """CTEs ``code_corpus`` and ``sel`` (selected files with ``language``)."""
    return (f"{corpus_cte()},\n"
            f"sel AS MATERIALIZED (SELECT repo_name, rel_path, content, size, {language_sql()} AS language\n"
            f"  FROM code_corpus\n"
            f"  WHERE NOT {skipped_dir_sql()} AND NOT {skipped_name_sql()} AND NOT {test_file_sql()}\n"
            f"    AND NOT {skipped_suffix_sql()} AND {language_sql()} IS NOT NULL\n"
            f"    AND size BETWEEN 1 AND {P.MAX_FILE_BYTES})")


def reason_sql() -> str:
    return (f"(CASE WHEN {skipped_dir_sql()} THEN 'skipped_dir' WHEN {skipped_name_sql()} THEN 'skipped_name' "
            f"WHEN {test_file_sql()} THEN 'test_file' WHEN {skipped_suffix_sql()} THEN 'skipped_suffix' "
            f"WHEN {language_sql()} IS NULL THEN 'unsupported_language' WHEN size <= 0 THEN 'empty' "
            f"WHEN size > {P.MAX_FILE_BYTES} THEN 'too_large' ELSE 'selected' END)")


LINE_BREAK_RE2 = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def lines_cte(src: str = "sel") -> str:
    """CTE ``lines``: one row per (repo_name, rel_path, language, i, line), 1-based, splitlines semantics."""
    return (f"split AS (SELECT repo_name, rel_path, language, string_split_regex(content, {_q(LINE_BREAK_RE2)}) AS parts\n"
            f"  FROM {src} WHERE regexp_matches(content, '[^\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')),\n"
            f"split2 AS (SELECT repo_name, rel_path, language,\n"
            f"  CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts)-1] ELSE parts END AS ls FROM split)")


def files_cte() -> str:
    """CTE ``b``: the selected files with the facts that their planted code follows from."""
    return (f"b AS MATERIALIZED (SELECT f.* FROM ({FILES_SQL.replace('{documents}', 'documents')}) f\n"
            f"  JOIN sel ON sel.repo_name = f.repo_name AND sel.rel_path = f.rel_path)")


def definitions_cte() -> str:
    """CTEs ending in ``defs``: the planted definitions that are long enough (C1-C5), stated by hand."""
    return f"""{files_cte()},
pd AS ({planted.definitions_sql()}),
defs AS (SELECT repo_name, rel_path AS file_path, language, chunk_type, name, CAST(start_line AS INTEGER) AS start_line,
           CAST(end_line AS INTEGER) AS end_line, ord,
           CASE WHEN length(whole) > 3000 THEN concat(substr(whole, 1, 3000), chr(10), '... [truncated]') ELSE whole END AS text
         FROM pd WHERE length(whole) >= 50)"""


def imports_cte(with_files: bool = True) -> str:
    """CTEs ending in ``imports``: what the files import by construction, in discovery order."""
    return f"""{files_cte() + "," if with_files else ""}
planted_imports AS ({planted.imports_sql()}),
head_imports AS (
  SELECT repo_name, rel_path, language, 1 AS grp, 0 AS ord,
         'm' || CASE WHEN doc_id % 100 < 2 THEN k_p20 ELSE k_p40 END AS import_path FROM b WHERE doc_id % 100 IN (0, 1, 40, 41)
  UNION ALL SELECT repo_name, rel_path, language, 2, o, n FROM b, (VALUES (0, 'os'), (1, 'sys')) v(o, n)
            WHERE language = 'python' AND doc_id % 7 = 0
  UNION ALL SELECT repo_name, rel_path, language, 3, 0, 'm' || k_m10 FROM b WHERE language = 'python' AND doc_id >= 20
  UNION ALL SELECT repo_name, rel_path, language, 4, 0, 'm' || k_m20 FROM b WHERE language = 'python' AND doc_id >= 20
  UNION ALL SELECT repo_name, rel_path, language, 4, 0, CASE WHEN doc_id >= 20 THEN up || dir_of_prev20 || 'm' || k_m20 ELSE 'react' END
            FROM b WHERE language <> 'python'),
imports AS MATERIALIZED (SELECT repo_name, rel_path AS src, language, import_path,
              row_number() OVER (PARTITION BY repo_name, rel_path ORDER BY grp, ord) - 1 AS import_ord
            FROM (SELECT * FROM planted_imports UNION ALL SELECT * FROM head_imports))"""


def graph_cte(with_files: bool = True) -> str:
    """CTEs over ``sel``: imports, resolved, edges, nodes, deg (naive formulations)."""
    return f"""
{imports_cte(with_files)},
pycand AS (SELECT i.repo_name, i.src, i.import_path, f.rel_path AS path,
             CASE WHEN ends_with(f.rel_path, replace(i.import_path, '.', '/') || '.py') THEN 0 ELSE 1 END AS is_pkg
           FROM (SELECT DISTINCT repo_name, src, import_path FROM imports WHERE language = 'python') i
           JOIN sel f ON f.repo_name = i.repo_name
            AND (ends_with(f.rel_path, replace(i.import_path, '.', '/') || '.py')
                 OR ends_with(f.rel_path, replace(i.import_path, '.', '/') || '/__init__.py'))),
pyres AS (SELECT repo_name, src, import_path, path AS dst FROM (
            SELECT *, row_number() OVER (PARTITION BY repo_name, src, import_path ORDER BY is_pkg,
              CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(src, '^(.*)/[^/]*$', 1) THEN 0 ELSE 1 END,
              length(path), path) AS r FROM pycand) WHERE r = 1),
jsb0 AS (SELECT DISTINCT repo_name, src, import_path,
           CASE WHEN starts_with(import_path, '@/') THEN 'frontend/src/' || substr(import_path, 3)
                WHEN starts_with(import_path, '.') THEN
                  CASE WHEN regexp_extract(src, '^(.*)/[^/]*$', 1) = '' THEN import_path
                       ELSE regexp_extract(src, '^(.*)/[^/]*$', 1) || '/' || import_path END END AS raw
         FROM imports WHERE language IN ('javascript', 'typescript')),
jsb1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '/\\.$', '') AS r1 FROM jsb0 WHERE raw IS NOT NULL),
jsb2 AS (SELECT *, {_fold_dotdot('r1', 8)} AS base FROM jsb1),
jscand AS (SELECT repo_name, src, import_path, c.pos AS pos, c.path AS path FROM jsb2,
             unnest(list_transform(
               (CASE WHEN ends_with(base, '.ts') OR ends_with(base, '.tsx') OR ends_with(base, '.js') OR ends_with(base, '.jsx')
                       OR ends_with(base, '.css') THEN [base] ELSE [] END)
               || [base || '.ts', base || '.tsx', base || '.js', base || '.jsx',
                   base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx'],
               lambda x, i: {{'pos': i, 'path': x}})) AS t(c)),
jsres AS (SELECT j.repo_name, j.src, j.import_path, arg_min(j.path, j.pos) AS dst FROM jscand j
          JOIN sel f ON f.repo_name = j.repo_name AND f.rel_path = j.path GROUP BY ALL),
resolved AS (SELECT * FROM pyres UNION ALL SELECT * FROM jsres),
edges AS (SELECT r.repo_name, r.src, r.dst, min(i.import_ord) AS first_ord, 1 AS weight
          FROM resolved r JOIN imports i ON i.repo_name = r.repo_name AND i.src = r.src AND i.import_path = r.import_path
          WHERE r.src <> r.dst GROUP BY r.repo_name, r.src, r.dst),
nodes AS (SELECT repo_name, rel_path AS node, language, size FROM sel),
deg AS (SELECT n.repo_name, n.node, n.language,
          (SELECT count(*) FROM edges e WHERE e.repo_name = n.repo_name AND e.dst = n.node) AS in_degree,
          (SELECT count(*) FROM edges e WHERE e.repo_name = n.repo_name AND e.src = n.node) AS out_degree
        FROM nodes n)"""


def _fold_dotdot(col: str, times: int) -> str:
    expr = col
    for _ in range(times):
        expr = f"regexp_replace({expr}, '(^|/)[^/.][^/]*/\\.\\.(/|$)', '\\1')"
    return f"(CASE WHEN {expr} = '' THEN '.' ELSE regexp_replace({expr}, '/$', '') END)"
