"""Independent DuckDB renderings of the registered queries (the correctness oracle).

These strings are run by the checker on the same parquet tables. They share common
table expressions that mirror the stages of the Spark jobs. NFKC is omitted: no row
of the given tables changes under it.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed patterns (RE2 syntax). RE2 has no look-behind, so the mention rule keeps the
# preceding character in a group and writes it back.
# ---------------------------------------------------------------------------
SP = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
NSP = r"[^\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
URL = r"(?i)https?://" + NSP + r"+|www\." + NSP + "+"
MENTION = r"(^|[^\p{L}\p{N}_])@[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_\x{0B80}-\x{0BFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def null_to_empty(e: str) -> str:
    return f"coalesce(CAST({e} AS VARCHAR), '')"


def strip_urls(e: str) -> str:
    return f"regexp_replace({e}, {q(URL)}, ' ', 'g')"


def strip_mentions(e: str) -> str:
    return f"regexp_replace({e}, {q(MENTION)}, '\\1 ', 'g')"


def strip_hash(e: str) -> str:
    return f"replace({e}, '#', ' ')"


def lower_ascii(e: str) -> str:
    return f"translate({e}, '{UPPER}', '{LOWER}')"


def collapse(e: str) -> str:
    return f"regexp_replace({e}, {q(SP + '+')}, ' ', 'g')"


def strip_spaces(e: str) -> str:
    return f"trim({e}, ' ')"


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + SP + '+|' + SP + '+$')}, '', 'g')"


def clean(e: str) -> str:
    return strip_spaces(collapse(lower_ascii(strip_hash(strip_mentions(strip_urls(null_to_empty(e)))))))


def tokens(e: str) -> str:
    return f"regexp_extract_all({e}, {q(TOKEN)})"


def split_hash(e: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({e} AS VARCHAR)))"


# ---------------------------------------------------------------------------
# Stage CTEs
# ---------------------------------------------------------------------------
P1 = f"""p1 AS (
  SELECT doc_id AS row_id, {py_strip(null_to_empty('text'))} AS original_text,
         {clean('text')} AS text, {py_strip(null_to_empty('lang'))} AS label
  FROM documents)"""

P2 = """p2 AS (SELECT * FROM p1 WHERE text <> '' AND label <> '')"""

W1 = """w1 AS (
  SELECT min(row_id) AS row_id, arg_min(original_text, row_id) AS original_text, text, label
  FROM p2 GROUP BY text, label)"""


def split_ctes(source: str = "w1", test_size: float = 0.2, seed: int = 42) -> str:
    return f"""labcnt AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
strat AS (SELECT s.*, CASE WHEN (SELECT min(n) FROM labcnt) >= 2 THEN s.label ELSE '' END AS stratum FROM {source} s),
counts AS (SELECT stratum, count(*) AS n FROM strat GROUP BY stratum),
q0 AS (SELECT stratum, n, sum(n) OVER () AS total,
              CAST(ceil(CAST({test_size} AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS n_test FROM counts),
q1 AS (SELECT *, total - n_test AS n_train, CAST(n AS HUGEINT) * (total - n_test) AS prod FROM q0),
q2 AS (SELECT *, prod // total AS base, prod % total AS rem FROM q1),
q3 AS (SELECT *, n_train - sum(base) OVER () AS leftover,
              row_number() OVER (ORDER BY rem DESC, stratum) AS seat FROM q2),
quotas AS (SELECT stratum, n - (base + CASE WHEN seat <= leftover THEN 1 ELSE 0 END) AS test_quota FROM q3),
ranked AS (SELECT strat.*, row_number() OVER (PARTITION BY stratum ORDER BY {split_hash('row_id', seed)}, row_id) AS rk
           FROM strat),
split AS (SELECT r.row_id, r.original_text, r.text, r.label,
                 CASE WHEN r.rk <= qq.test_quota THEN 'test' ELSE 'train' END AS split
          FROM ranked r JOIN quotas qq USING (stratum))"""


PREPARED = ",\n".join([P1, P2, W1])
SPLIT = PREPARED + ",\n" + split_ctes()


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------------------
# Frozen scorer replay (test split -> predictions)
# ---------------------------------------------------------------------------
def scorer_ctes(weights: dict[str, dict[str, int]], prefix: str = "", source: str = "split",
                where: str = "split = 'test'") -> str:
    classes = sorted({c for by in weights.values() for c in by})
    rows = ", ".join(f"({q(t)}, {q(c)}, {w})" for t, by in sorted(weights.items()) for c, w in sorted(by.items()))
    cls_rows = ", ".join(f"({q(c)}, {i})" for i, c in enumerate(classes))
    p = prefix
    return f"""{p}test AS (SELECT row_id, original_text, text, label FROM {source} WHERE {where}),
{p}sc AS (SELECT * FROM (VALUES {rows}) v(term, cls, w)),
{p}cls AS (SELECT * FROM (VALUES {cls_rows}) v(cls, idx)),
{p}ct AS (SELECT row_id, {clean('text')} AS cleaned_text FROM {p}test),
{p}tk AS (SELECT row_id, unnest({tokens('cleaned_text')}) AS term FROM {p}ct),
{p}z0 AS (SELECT tk.row_id, sc.cls, sum(sc.w) AS z FROM {p}tk tk JOIN {p}sc sc USING (term) GROUP BY 1, 2),
{p}zz AS (SELECT ct.row_id, c.cls, c.idx, coalesce(z0.z, 0) AS z
          FROM {p}ct ct CROSS JOIN {p}cls c LEFT JOIN {p}z0 z0 ON z0.row_id = ct.row_id AND z0.cls = c.cls),
{p}ez AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id)) AS e FROM {p}zz),
{p}prob AS (SELECT row_id, cls, idx, z, e / sum(e) OVER (PARTITION BY row_id) AS p FROM {p}ez),
{p}top AS (SELECT row_id, cls AS predicted_label, p AS confidence
           FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY z DESC, idx) AS r FROM {p}prob) WHERE r = 1),
{p}pred AS (SELECT t.row_id, t.original_text, ct.cleaned_text, t.label, top.predicted_label, top.confidence
            FROM {p}test t JOIN {p}ct ct USING (row_id) JOIN {p}top top USING (row_id))"""


def report_ctes(prefix: str = "") -> str:
    p = prefix
    return f"""{p}cc AS (
  SELECT lab AS label, sum(s) AS support, sum(pp) AS predicted, sum(t) AS tp FROM (
    SELECT label AS lab, 1 AS s, 0 AS pp, CASE WHEN label = predicted_label THEN 1 ELSE 0 END AS t FROM {p}pred
    UNION ALL SELECT predicted_label, 0, 1, 0 FROM {p}pred) GROUP BY lab),
{p}rep AS (
  SELECT label,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1,
         support, predicted, tp FROM {p}cc),
{p}summ AS (
  SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
         avg(precision) AS macro_precision, avg(recall) AS macro_recall,
         sum(precision * support) / sum(support) AS weighted_precision,
         sum(recall * support) / sum(support) AS weighted_recall, CAST(sum(support) AS BIGINT) AS support
  FROM {p}rep),
{p}grid AS (SELECT a.cls AS true_label, a.idx AS true_idx, b.cls AS pred_label, b.idx AS pred_idx
            FROM {p}cls a CROSS JOIN {p}cls b),
{p}cells AS (
  SELECT g.true_idx, g.pred_idx, g.true_label, g.pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
  FROM {p}grid g LEFT JOIN (SELECT label, predicted_label, count(*) AS n FROM {p}pred GROUP BY 1, 2) c
    ON c.label = g.true_label AND c.predicted_label = g.pred_label)"""
