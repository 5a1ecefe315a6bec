"""Named SQL building blocks that recompute the event study from the raw tables in DuckDB.

``statement`` puts the blocks a query needs, and the blocks those need, in front of it.
"""

from __future__ import annotations

import re

from trialweave.operators.posterior import FACTOR, MODULUS, START

BLOCKS: dict[str, str] = {
    "daily": """
        SELECT 'cohort_' || CAST(user_id % 2 AS VARCHAR) AS study_id, user_id AS subject_id,
               CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS calendar_t,
               max(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END) AS action,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 10000.0 AS reward
        FROM events GROUP BY 1, 2, 3""",
    "bounds": "SELECT study_id, min(calendar_t) AS t_min, max(calendar_t) AS t_max FROM daily GROUP BY 1",
    "grid": """
        SELECT s.study_id, s.subject_id, CAST(unnest(range(t_min, t_max + 1)) AS INTEGER) AS calendar_t
        FROM (SELECT DISTINCT study_id, subject_id FROM daily) s JOIN bounds b ON s.study_id = b.study_id""",
    "glog": """
        SELECT g.study_id, g.subject_id, g.calendar_t,
               CASE WHEN d.reward IS NULL THEN 0 ELSE 1 END AS active, d.action, d.reward,
               CASE WHEN d.reward IS NOT NULL THEN CAST(floor(g.calendar_t / 5.0) AS INTEGER) END AS policy_num,
               coalesce(lag(d.reward) OVER (PARTITION BY g.study_id, g.subject_id ORDER BY g.calendar_t), 0) AS past_reward
        FROM grid g LEFT JOIN daily d
          ON g.study_id = d.study_id AND g.subject_id = d.subject_id AND g.calendar_t = d.calendar_t""",
    "omonthly": """
        SELECT c_mktsegment AS study_id, o_custkey AS subject_id,
               CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS calendar_t,
               max(CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1 ELSE 0 END) AS action,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS reward
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "ospan": "SELECT study_id, min(calendar_t) AS lo, max(calendar_t) AS hi FROM omonthly GROUP BY 1",
    "ogrid": """
        SELECT s.study_id, subject_id, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS calendar_t
        FROM (SELECT DISTINCT study_id, subject_id FROM omonthly) s JOIN ospan p ON s.study_id = p.study_id""",
    "olog": """
        SELECT g.study_id, g.subject_id, g.calendar_t,
               CASE WHEN d.reward IS NULL THEN 0 ELSE 1 END AS active, d.action, d.reward,
               CASE WHEN d.reward IS NOT NULL THEN CAST(floor(g.calendar_t / 12.0) AS INTEGER) END AS policy_num,
               coalesce(lag(d.reward) OVER (PARTITION BY g.study_id, g.subject_id ORDER BY g.calendar_t), 0) AS past_reward
        FROM ogrid g LEFT JOIN omonthly d
          ON g.study_id = d.study_id AND g.subject_id = d.subject_id AND g.calendar_t = d.calendar_t""",
    "ranked": """
        SELECT study_id, policy_num, min(calendar_t) AS first_t, max(calendar_t) AS last_t,
               CAST(dense_rank() OVER (PARTITION BY study_id ORDER BY policy_num) - 2 AS INTEGER) AS k
        FROM glog WHERE active = 1 AND policy_num >= 0 GROUP BY study_id, policy_num""",
    "upd": "SELECT * FROM ranked WHERE k >= 0",
    "sizes": """
        SELECT s.study_id, n, (SELECT count(*) FROM upd u WHERE u.study_id = s.study_id) AS kk
        FROM (SELECT study_id, count(DISTINCT subject_id) AS n FROM glog GROUP BY 1) s""",
    "urows": """
        SELECT l.study_id, u.policy_num, u.k, l.subject_id, l.calendar_t, l.action, l.reward
        FROM glog l JOIN upd u ON l.study_id = u.study_id AND l.calendar_t < u.first_t WHERE l.active = 1""",
    "ustat": """
        SELECT study_id, policy_num, k, CAST(count(*) AS DOUBLE) AS c, CAST(sum(action) AS DOUBLE) AS sa,
               sum(reward) AS sr, sum(reward * action) AS sra, count(DISTINCT subject_id) AS users
        FROM urows GROUP BY 1, 2, 3""",
    "beta": """
        SELECT study_id, policy_num, k, (sa * sr - sa * sra) / (c * sa - sa * sa) AS b0,
               (c * sra - sa * sr) / (c * sa - sa * sa) AS b1 FROM ustat""",
    "dec0": """
        SELECT l.*, coalesce(b.k, -1) AS k, b.b0, b.b1, 1 / (1 + exp(-3.0 * b.b1)) AS e
        FROM glog l LEFT JOIN beta b ON l.study_id = b.study_id AND l.policy_num = b.policy_num
        WHERE l.active = 1""",
    "dec1": """
        SELECT *, CASE WHEN k < 0 THEN 0.5 WHEN e < 0.1 THEN 0.1 WHEN e > 0.9 THEN 0.9 ELSE e END AS pi,
               CASE WHEN k >= 0 AND e > 0.1 AND e < 0.9 THEN 3.0 * e * (1 - e) ELSE 0 END AS slope FROM dec0""",
    "dec": """
        SELECT *, CASE WHEN action = 1 THEN slope / pi ELSE -slope / (1 - pi) END AS score,
               action - pi AS d FROM dec1""",
    "tstat": """
        SELECT study_id, CAST(count(*) AS DOUBLE) AS c, sum(d) AS sd, sum(d * d) AS sdd, sum(reward) AS sr,
               sum(reward * d) AS srd FROM dec GROUP BY 1""",
    "theta": """
        SELECT study_id, (sdd * sr - sd * srd) / (c * sdd - sd * sd) AS t0,
               (c * srd - sd * sr) / (c * sdd - sd * sd) AS t1 FROM tstat""",
    "phi": """
        SELECT r.study_id, r.subject_id, r.k AS block, sum(-2 * (reward - b0 - b1 * action)) AS v0,
               sum(-2 * (reward - b0 - b1 * action) * action) AS v1
        FROM urows r JOIN beta b ON r.study_id = b.study_id AND r.k = b.k GROUP BY 1, 2, 3""",
    "psi": """
        SELECT d.study_id, subject_id, CAST(any_value(kk) AS INTEGER) AS block,
               sum(-2 * (reward - t0 - t1 * d)) AS v0, sum(-2 * (reward - t0 - t1 * d) * d) AS v1
        FROM dec d JOIN theta t ON d.study_id = t.study_id JOIN sizes z ON d.study_id = z.study_id GROUP BY 1, 2""",
    "stack": "SELECT * FROM phi UNION ALL SELECT * FROM psi",
    "cells": """
        SELECT study_id, subject_id, block, 0 AS pos, v0 AS v FROM stack
        UNION ALL SELECT study_id, subject_id, block, 1, v1 FROM stack""",
    "smean": """
        SELECT c.study_id, block, pos, sum(v) / any_value(n) AS mean
        FROM cells c JOIN sizes z ON c.study_id = z.study_id GROUP BY 1, 2, 3""",
    "meat": """
        SELECT a.study_id, a.block AS row_block, b.block AS col_block, a.pos AS r, b.pos AS c,
               sum(a.v * b.v) / any_value(n) AS value
        FROM cells a JOIN cells b ON a.study_id = b.study_id AND a.subject_id = b.subject_id
        JOIN sizes z ON a.study_id = z.study_id GROUP BY 1, 2, 3, 4, 5""",
    "scores": "SELECT study_id, subject_id, k, sum(score) AS s FROM dec WHERE k >= 0 GROUP BY 1, 2, 3",
    "own": """
        SELECT s.study_id, k AS row_block, k AS col_block, r, c2 AS c,
               2 * (CASE WHEN r = 0 AND c2 = 0 THEN s.c ELSE sa END) / n AS value
        FROM ustat s JOIN sizes z ON s.study_id = z.study_id,
             (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS p(r, c2)
        UNION ALL
        SELECT s.study_id, CAST(kk AS INTEGER), CAST(kk AS INTEGER), r, c2,
               2 * (CASE WHEN r + c2 = 0 THEN s.c WHEN r + c2 = 1 THEN sd ELSE sdd END) / n
        FROM tstat s JOIN sizes z ON s.study_id = z.study_id,
             (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS p(r, c2)""",
    "scorepart": """
        SELECT a.study_id, block AS row_block, k AS col_block, pos AS r, 1 AS c, sum(v * s) / any_value(n) AS value
        FROM cells a JOIN scores b ON a.study_id = b.study_id AND a.subject_id = b.subject_id AND b.k < a.block
        JOIN sizes z ON a.study_id = z.study_id GROUP BY 1, 2, 3, 4""",
    "probpart": """
        SELECT d.study_id, CAST(any_value(kk) AS INTEGER) AS row_block, k AS col_block, r, 1 AS c,
               sum(slope * (CASE WHEN r = 0 THEN -2 * t1 ELSE -2 * t1 * d + 2 * (reward - t0 - t1 * d) END))
                 / any_value(n) AS value
        FROM dec d JOIN theta t ON d.study_id = t.study_id JOIN sizes z ON d.study_id = z.study_id,
             (VALUES (0), (1)) AS p(r) WHERE k >= 0 GROUP BY 1, 3, 4""",
    "bread": """
        SELECT study_id, row_block, col_block, r, c, sum(value) AS value
        FROM (SELECT * FROM own UNION ALL SELECT * FROM scorepart UNION ALL SELECT * FROM probpart)
        GROUP BY 1, 2, 3, 4, 5""",
    "blocks": """
        SELECT study_id, row_block, col_block, coalesce(sum(value) FILTER (WHERE r = 0 AND c = 0), 0) AS m00,
               coalesce(sum(value) FILTER (WHERE r = 0 AND c = 1), 0) AS m01,
               coalesce(sum(value) FILTER (WHERE r = 1 AND c = 0), 0) AS m10,
               coalesce(sum(value) FILTER (WHERE r = 1 AND c = 1), 0) AS m11 FROM bread GROUP BY 1, 2, 3""",
    "dinv": """
        SELECT study_id, row_block AS b, m11 / (m00 * m11 - m01 * m10) AS i00, -m01 / (m00 * m11 - m01 * m10) AS i01,
               -m10 / (m00 * m11 - m01 * m10) AS i10, m00 / (m00 * m11 - m01 * m10) AS i11
        FROM blocks WHERE row_block = col_block""",
    "lower": "SELECT b.* FROM blocks b JOIN sizes z ON b.study_id = z.study_id WHERE col_block < row_block AND row_block < kk",
    "y0": """
        SELECT b.study_id, col_block AS b, m00 * i00 + m01 * i10 AS a00, m00 * i01 + m01 * i11 AS a01,
               m10 * i00 + m11 * i10 AS a10, m10 * i01 + m11 * i11 AS a11
        FROM blocks b JOIN sizes z ON b.study_id = z.study_id
        JOIN dinv d ON d.study_id = b.study_id AND d.b = col_block
        WHERE row_block = kk AND col_block < kk""",
    "adjpsi": """
        SELECT p.study_id, p.subject_id, p.v0 - coalesce(m0, 0) AS v0, p.v1 - coalesce(m1, 0) AS v1
        FROM psi p LEFT JOIN (
            SELECT f.study_id, f.subject_id, sum(a00 * v0 + a01 * v1) AS m0, sum(a10 * v0 + a11 * v1) AS m1
            FROM phi f JOIN adjm m ON f.study_id = m.study_id AND f.block = m.b GROUP BY 1, 2) q
        ON p.study_id = q.study_id AND p.subject_id = q.subject_id""",
    "tinv": """
        SELECT d.* FROM dinv d JOIN sizes z ON d.study_id = z.study_id WHERE b = kk""",
    "classical": """
        SELECT study_id, q.r, q.c, n, value FROM (
          SELECT s.study_id, any_value(n) AS n, sum(v0 * v0) / any_value(n) AS m00,
                 sum(v0 * v1) / any_value(n) AS m01, sum(v1 * v1) / any_value(n) AS m11
          FROM psi s JOIN sizes z ON s.study_id = z.study_id GROUP BY 1) m JOIN tinv i USING (study_id),
        LATERAL (VALUES
          (0, 0, (i00*i00*m00 + 2*i00*i01*m01 + i01*i01*m11) / n),
          (0, 1, (i00*i10*m00 + (i00*i11 + i01*i10)*m01 + i01*i11*m11) / n),
          (1, 0, (i00*i10*m00 + (i00*i11 + i01*i10)*m01 + i01*i11*m11) / n),
          (1, 1, (i10*i10*m00 + 2*i10*i11*m01 + i11*i11*m11) / n)) AS q(r, c, value)""",
}
BLOCKS["leverage"] = """
        SELECT d.study_id, d.subject_id, any_value(n) AS n,
               sum(2 * (i00 + (i01 + i10) * d.d + i11 * d.d * d.d)) / any_value(n) AS h
        FROM dec d JOIN tinv i ON d.study_id = i.study_id JOIN sizes z ON d.study_id = z.study_id GROUP BY 1, 2"""
BLOCKS["hcpsi"] = """
        SELECT s.study_id, s.subject_id, v0 / (1 - h) AS v0, v1 / (1 - h) AS v1
        FROM adjpsi s JOIN leverage x ON s.study_id = x.study_id AND s.subject_id = x.subject_id"""
BLOCKS["corrected"] = BLOCKS["classical"].replace("FROM psi s", "FROM hcpsi s")
BLOCKS["adjusted"] = BLOCKS["classical"].replace("FROM psi s", "FROM adjpsi s")
# The inverse of a block lower triangular matrix is a finite series, one term per update: it ends by itself.
BLOCKS["adjm"] = """
        SELECT study_id, b, sum(a00) AS a00, sum(a01) AS a01, sum(a10) AS a10, sum(a11) AS a11 FROM (
          WITH RECURSIVE term(study_id, b, a00, a01, a10, a11, m) AS (
            SELECT study_id, b, a00, a01, a10, a11, 0 FROM y0
            UNION ALL
            SELECT y.study_id, col_block,
                   -sum((a00*m00 + a01*m10) * i00 + (a00*m01 + a01*m11) * i10),
                   -sum((a00*m00 + a01*m10) * i01 + (a00*m01 + a01*m11) * i11),
                   -sum((a10*m00 + a11*m10) * i00 + (a10*m01 + a11*m11) * i10),
                   -sum((a10*m00 + a11*m10) * i01 + (a10*m01 + a11*m11) * i11), any_value(m) + 1
            FROM term y JOIN lower l ON y.study_id = l.study_id AND y.b = l.row_block
            JOIN dinv d ON d.study_id = l.study_id AND d.b = l.col_block GROUP BY 1, 2)
          SELECT * FROM term) GROUP BY 1, 2"""


def _powers(start: int, factor: int, count: int) -> str:
    """(i, x): ``start * factor^i`` modulo the draws' modulus."""
    return (f"(WITH RECURSIVE s(i, x) AS (SELECT 0, CAST({start} AS BIGINT) UNION ALL "
            f"SELECT i + 1, x * {factor} % {MODULUS} FROM s WHERE i < {count - 1}) SELECT i, x FROM s)")


# The draws' recurrence, 10,000 pairs, in two levels of 142 steps; a pair gives one normal draw.
BLOCKS["draws"] = f"""
        SELECT sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM (
          SELECT i // 2 AS j, max(x) FILTER (WHERE i % 2 = 0) / {MODULUS} AS u,
                 max(x) FILTER (WHERE i % 2 = 1) / {MODULUS} AS v
          FROM (SELECT big.i * 142 + small.i AS i, CAST(big.x * small.x % {MODULUS} AS DOUBLE) AS x
                FROM {_powers(START, pow(FACTOR, 142, MODULUS), 142)} big, {_powers(1, FACTOR, 142)} small)
          WHERE i < 20000 GROUP BY 1)"""


# The event log cut off at the last day of each five-day policy after the first.
BLOCKS["wholelog"] = BLOCKS["glog"]
ENDS = 5
for _k in range(ENDS):
    BLOCKS[f"endlog{_k}"] = f"SELECT * FROM wholelog WHERE calendar_t < {5 * (_k + 2)}"


def statement(select: str, log_block: str = "glog") -> str:
    """A query with every block it needs as a common table expression, in dependency order.

    ``log_block`` names the block that stands for the decision log.
    """
    order: list[str] = []

    def body(name: str) -> str:
        return re.sub(r"\bglog\b", log_block, BLOCKS[name].strip())

    def visit(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
            if name in BLOCKS and name not in order:
                visit(body(name))
                order.append(name)

    select = re.sub(r"\bglog\b", log_block, select.strip())
    visit(select)
    blocks = ", ".join(f"{name} AS MATERIALIZED ({body(name)})" for name in order)
    return f"WITH {blocks} {select}" if order else select
