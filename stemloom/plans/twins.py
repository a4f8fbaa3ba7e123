"""SQL for DuckDB that says what the relational queries must return, written apart from the operators.

Each text reads relations of ``RELATIONS``, texts themselves over ``cells``
(alignments derived from documents) or ``small`` (from nation). Spark never runs
these: the queries are DataFrame functions of ``stemloom.operators``.
"""

from __future__ import annotations

from stemloom.functions import energies as E

# fixed values: pair codes CG 1, GC 2, GU 3, UG 4, AU 5, UA 6, gap-gap 7, other 0
PAIR = "CASE WHEN {a} = 1 AND {b} = 2 THEN 1 WHEN {a} = 2 AND {b} = 1 THEN 2 WHEN {a} = 2 AND {b} = 3 THEN 3 WHEN {a} = 3 AND {b} = 2 THEN 4 WHEN {a} = 0 AND {b} = 3 THEN 5 WHEN {a} = 3 AND {b} = 0 THEN 6 WHEN {a} = 5 AND {b} = 5 THEN 7 ELSE 0 END"
_TYPE = PAIR.replace("{a}", "a.code").replace("{b}", "b.code")
_F = ", ".join(f"CAST(sum(CASE WHEN t = {k} THEN 1 ELSE 0 END) AS BIGINT) AS f{k}" for k in range(8))
#: Columns in which two pair types differ: the covariation that a mutation from one to the other shows.
_BASES = {1: "CG", 2: "GC", 3: "GU", 4: "UG", 5: "AU", 6: "UA"}
_COVARIATION = " + ".join(f"{sum(x != y for x, y in zip(_BASES[k], _BASES[m], strict=True))} * f{k} * f{m}" for k in _BASES for m in _BASES if k < m)

_DERIVED = """SELECT fam, seq, col, CAST(CASE WHEN nib = 13 THEN 5 WHEN nib = 12 THEN (anc + 1) % 4 ELSE anc END AS INT) AS code FROM (
  SELECT fam, seq, col, instr('0123456789abcdef', substr(d, col + 1, 1)) - 1 AS nib, CASE WHEN col < 16 THEN (col * col + 3 * col + fam) % 4 ELSE 3 - ((31 - col) * (31 - col) + 3 * (31 - col) + fam) % 4 END AS anc
  FROM (SELECT fam, seq, md5(coalesce(t, '')) AS d, CAST(unnest(range(0, 32)) AS INT) AS col FROM (ROWS)))"""
_BASE = "(CASE WHEN {x} BETWEEN 0 AND 3 THEN {x} + 1 ELSE 0 END)"


def _near(side: str, way: str, order: str) -> str:
    """The table base of the nearest base on one side of a column, 0 if there is none."""
    return f"coalesce((SELECT {_BASE.replace('{x}', 'n.code')} FROM {{{{small_positions}}}} n WHERE n.fam = {side}.fam AND n.seq = {side}.seq AND n.code <> 5 AND n.col {way} {side}.col ORDER BY n.col {order} LIMIT 1), 0)".replace("{{", "{").replace("}}", "}")


def _table(values: dict[str, tuple], kind: str, *at: str) -> str:
    """A published table by pair kind and bases, as cases; bases are counted from 1, 0 adds nothing."""
    out = "CASE"
    for k, name in enumerate(E.PAIRS, 1):
        row, place = values[name], at[0]
        if len(at) > 1:
            row, place = tuple(x for r in row for x in r), f"(({at[0]} - 1) * 4 + {at[1]})"
        out += f" WHEN {kind} = {k} AND least({', '.join(at)}) > 0 THEN ([{', '.join(map(str, row))}])[{place}]"
    return out + " ELSE 0 END"


_WEAK = f"CASE WHEN kind > 2 THEN {56} ELSE 0 END"
_NO_BASE = "CASE WHEN ia > 0 AND jb = 0 AND kind = 1 THEN -90 WHEN ia > 0 AND jb = 0 AND kind = 2 THEN -70 ELSE 0 END"
_LENGTHS = ", ".join(map(str, E.HAIRPIN[3:]))
_HAIRPIN = f"CASE WHEN size < 3 THEN 600 WHEN size = 3 THEN ([{_LENGTHS}])[1] + {_WEAK} ELSE ([{_LENGTHS}])[size - 2] + {_table(E.HAIRPIN_MISMATCH, 'kind', 'ia', 'jb')} + {_NO_BASE} END"
_STEM = f"{_WEAK} + CASE WHEN i > 0 THEN {_table(E.DANGLE5, 'kind', 'ib')} ELSE 0 END + CASE WHEN j < 31 THEN {_table(E.DANGLE3, 'kind', 'ja')} ELSE 0 END"
CELLS_SQL = {
    "cells": _DERIVED.replace("ROWS", "SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS fam, doc_id AS seq, text AS t FROM documents"),
    "small": _DERIVED.replace("ROWS", "SELECT n_regionkey AS fam, CAST(n_nationkey AS BIGINT) AS seq, n_name AS t FROM nation"),
}

RELATIONS = CELLS_SQL | {
    "occupancy": "SELECT fam, col, CAST(sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) AS BIGINT) AS bases, count(*) AS n FROM {cells} GROUP BY fam, col",
    "counted": "SELECT fam, col, n, CAST(sum(bases) OVER (PARTITION BY fam ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM {occupancy}",
    "smart_gap": "SELECT fam, col, sum(1.0e0 * bases / n) OVER (PARTITION BY fam ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {occupancy}",
    "histogram": f"SELECT fam, i, j, count(*) AS n, {_F} FROM (SELECT a.fam AS fam, a.col AS i, b.col AS j, {_TYPE} AS t FROM {{cells}} a JOIN {{cells}} b ON a.fam = b.fam AND a.seq = b.seq WHERE a.col < b.col) GROUP BY fam, i, j",
    "gated": "SELECT * FROM {histogram} WHERE 2 * f0 + f7 <= n",
    "pscore": f"SELECT fam, i, j, round(1.2e0 * (100.0e0 * ({_COVARIATION}) / n - 0.1e0 * 100.0e0 * (f0 + 0.25e0 * f7)) / n, 6) AS pscore FROM {{gated}}",
    "pairable": "SELECT fam, i, j, pscore FROM {pscore} WHERE pscore >= -40",
    "weights": "SELECT fam, i, j, f1 + f2 + f3 + f4 + f5 + f6 AS w, n FROM {gated}",
    "possible": "SELECT fam, i, j, f1 + f2 + f3 + f4 + f5 + f6 AS w FROM {histogram} WHERE f1 + f2 + f3 + f4 + f5 + f6 > 0",
    "ends": "SELECT fam, i AS pos, w FROM {weights} UNION ALL SELECT fam, j AS pos, w FROM {weights}",
    "load": "SELECT fam, pos, CAST(sum(w) AS BIGINT) AS w FROM {ends} GROUP BY fam, pos",
    "bpp": "SELECT p.fam AS fam, p.i AS i, p.j AS j, 1.0e0 * p.w / (CASE WHEN a.w > b.w THEN a.w ELSE b.w END + p.n) AS prob FROM {weights} p JOIN {load} a ON p.fam = a.fam AND p.i = a.pos JOIN {load} b ON p.fam = b.fam AND p.j = b.pos",
    "both_ends": "SELECT fam, i AS pos, j AS other, prob FROM {bpp} UNION ALL SELECT fam, j AS pos, i AS other, prob FROM {bpp}",
    "best": "SELECT fam, pos, other, prob FROM (SELECT fam, pos, other, prob, row_number() OVER (PARTITION BY fam, pos ORDER BY round(prob, 9) DESC, other) AS k FROM {both_ends} WHERE prob >= 0.02e0) WHERE k = 1",
    "mutual": "SELECT a.fam AS fam, a.pos AS i, a.other AS j, a.prob AS prob FROM {best} a JOIN {best} b ON a.fam = b.fam AND a.other = b.pos AND b.other = a.pos WHERE a.pos < a.other",
    "positions": "SELECT fam, seq, col, sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) OVER (PARTITION BY fam, seq ORDER BY col) - 1 AS pos FROM {cells}",
    "crossed1": "SELECT DISTINCT a.fam AS fam, a.i AS i, a.j AS j FROM {mutual} a JOIN {mutual} b ON a.fam = b.fam AND b.i < a.i AND a.i < b.j AND b.j < a.j",
    "crossed2": "SELECT DISTINCT a.fam AS fam, a.i AS i, a.j AS j FROM {crossed1} a JOIN {crossed1} b ON a.fam = b.fam AND b.i < a.i AND a.i < b.j AND b.j < a.j",
    "crossed3": "SELECT DISTINCT a.fam AS fam, a.i AS i, a.j AS j FROM {crossed2} a JOIN {crossed2} b ON a.fam = b.fam AND b.i < a.i AND a.i < b.j AND b.j < a.j",
    "columns": "SELECT DISTINCT fam, col FROM {occupancy}",
    "consensus": "SELECT fam, col, code FROM (SELECT fam, col, code, row_number() OVER (PARTITION BY fam, col ORDER BY n DESC, code) AS k FROM (SELECT fam, col, code, count(*) AS n FROM {cells} GROUP BY fam, col, code)) WHERE k = 1",
    "signs": "SELECT fam, seq, col, CASE WHEN col < 16 THEN CASE WHEN code < 3 THEN 1 ELSE 0 END ELSE 0 END AS opens FROM {cells}",
    "brackets": "SELECT a.fam AS fam, a.seq AS seq, a.col AS col, CASE WHEN a.col < 16 THEN a.opens ELSE -b.opens END AS sign FROM {signs} a JOIN {signs} b ON a.fam = b.fam AND a.seq = b.seq AND b.col = 31 - a.col",
    "depths": "SELECT fam, seq, col, sign, sum(sign) OVER (PARTITION BY fam, seq ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN sign > 0 THEN 1 ELSE 0 END AS depth FROM {brackets} WHERE sign <> 0",
    "matched": "SELECT fam, seq, col AS i, closer AS j FROM (SELECT fam, seq, col, sign, lead(col) OVER (PARTITION BY fam, seq, depth ORDER BY col) AS closer FROM {depths}) WHERE sign > 0 AND closer IS NOT NULL",
    "rows": "SELECT fam, seq, string_agg(substr('ACGUN-', code + 1, 1), '' ORDER BY col) AS text FROM {cells} GROUP BY fam, seq",
    "named": "SELECT fam, seq, text, 'src' || fam || '/d' || seq AS file FROM {rows}",
    "printed": "SELECT fam, i, j, CAST(printf('%.4e', 0.987654321e0 * prob) AS DOUBLE) AS prob, row_number() OVER (PARTITION BY fam ORDER BY i, j) AS at FROM {bpp} WHERE prob > 0 AND j >= i + 4",
    "drawn_gold": "SELECT c.fam AS fam, string_agg(CASE WHEN g.i IS NOT NULL THEN '(' WHEN h.j IS NOT NULL THEN ')' ELSE '.' END, '' ORDER BY c.col) AS structure FROM {columns} c LEFT JOIN {gold} g ON g.fam = c.fam AND g.i = c.col LEFT JOIN {gold} h ON h.fam = c.fam AND h.j = c.col GROUP BY c.fam",
    "small_positions": "SELECT fam, seq, col, code, CAST(sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) OVER (PARTITION BY fam, seq ORDER BY col) AS BIGINT) AS upto FROM {small}",
    "sites": f"SELECT a.fam AS fam, a.seq AS seq, a.col AS i, b.col AS j, CASE WHEN {_TYPE} BETWEEN 1 AND 6 THEN {_TYPE} ELSE 7 END AS kind, b.upto - a.upto - CASE WHEN b.code <> 5 THEN 1 ELSE 0 END AS size, {_near('a', '<', 'DESC')} AS ib, {_near('a', '>', 'ASC')} AS ia, {_near('b', '<', 'DESC')} AS jb, {_near('b', '>', 'ASC')} AS ja FROM {{small_positions}} a JOIN {{small_positions}} b ON a.fam = b.fam AND a.seq = b.seq AND b.col >= a.col + 4",
    "gold": "SELECT a.fam AS fam, a.col AS i, b.col AS j FROM {consensus} a JOIN {consensus} b ON a.fam = b.fam AND b.col = 31 - a.col WHERE a.col < b.col - 3 AND a.code + b.code = 3",
}

OPERATORS = {
    "msa_cells": "SELECT fam, seq, col, code FROM {cells}",
    "a2s_map": "SELECT fam, seq, col, CAST(sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) OVER (PARTITION BY fam, seq ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INT) AS pos FROM {cells}",
    "neighbour_s5": "SELECT fam, seq, col, CAST(coalesce(max(CASE WHEN code <> 5 THEN col * 8 + code END) OVER (PARTITION BY fam, seq ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 8, 4) AS INT) AS s5 FROM {cells}",
    "neighbour_s3": "SELECT fam, seq, col, CAST(coalesce(min(CASE WHEN code <> 5 THEN col * 8 + code END) OVER (PARTITION BY fam, seq ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) % 8, 4) AS INT) AS s3 FROM {cells}",
    "column_occupancy": "SELECT fam, col, round(1.0e0 * bases / n, 6) AS occupancy FROM {occupancy}",
    "smart_gap": "SELECT fam, col, round(upto, 5) AS upto FROM {smart_gap}",
    "energy_codes": "SELECT fam, seq, col, CAST(CASE WHEN code >= 4 THEN 0 ELSE code + 1 END AS INT) AS base FROM {cells}",
    "row_identity": "SELECT fam, a_seq, b_seq, CAST(sum(CASE WHEN ca <> cb THEN 1 ELSE 0 END) AS BIGINT) AS hamming, round(coalesce(100.0e0 * sum(CASE WHEN ca = cb AND ca <> 5 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN ca = 5 AND cb = 5 THEN 0 ELSE 1 END), 0), 0.0e0), 6) AS identity FROM (SELECT a.fam AS fam, a.seq AS a_seq, b.seq AS b_seq, a.code AS ca, b.code AS cb FROM {small} a JOIN {small} b ON a.fam = b.fam AND a.col = b.col WHERE a.seq < b.seq) GROUP BY fam, a_seq, b_seq",
    "pair_histogram": "SELECT fam, i, j, n, f0, f1, f2, f3, f4, f5, f6, f7 FROM {histogram}",
    "pair_gate": "SELECT fam, i, j FROM {gated}",
    "pscore_pairs": "SELECT fam, i, j, pscore FROM {pairable}",
    "next_pairable": "SELECT fam, i, j, coalesce(lead(j) OVER (PARTITION BY fam, i ORDER BY j), -1) AS nxt FROM {pairable}",
    "prev_pairable": "SELECT fam, i, j, coalesce(lag(j) OVER (PARTITION BY fam, i ORDER BY j), -1) AS prv FROM {pairable}",
    "hairpin_candidates": "SELECT p.fam AS fam, p.i AS i, p.j AS j FROM {pairable} p JOIN {smart_gap} a ON p.fam = a.fam AND p.i = a.col JOIN {smart_gap} b ON p.fam = b.fam AND p.j = b.col WHERE p.j >= p.i + 4 AND round(b.upto - a.upto, 6) >= 2.0e0",
    "range_pairs_30": "SELECT x.fam AS fam, x.i AS i, x.j AS j, y.i AS p, y.j AS q FROM {pairable} x JOIN {pairable} y ON x.fam = y.fam AND y.i < x.i AND x.j < y.j JOIN {counted} a ON a.fam = x.fam AND a.col = x.i - 1 JOIN {counted} b ON b.fam = x.fam AND b.col = y.i JOIN {counted} c ON c.fam = x.fam AND c.col = y.j - 1 JOIN {counted} d ON d.fam = x.fam AND d.col = x.j WHERE (a.upto - b.upto) + (c.upto - d.upto) <= 30 * a.n",
    "m_p_composition": "SELECT a.fam AS fam, a.i AS i, b.j AS j, max(a.w + b.w) AS best, count(*) AS ways FROM {possible} a JOIN {possible} b ON a.fam = b.fam AND a.j + 1 = b.i GROUP BY a.fam, a.i, b.j",
    "beam_topk": "SELECT fam, i, j, pscore FROM (SELECT fam, i, j, pscore, rank() OVER (PARTITION BY fam, j ORDER BY pscore DESC) AS k FROM {pairable}) WHERE k <= 6",
    "sorted_m": "SELECT fam, i, j, CAST(row_number() OVER (PARTITION BY fam, j ORDER BY pscore DESC, i DESC) AS INT) AS place FROM {pairable}",
    "viterbi_argmax": "SELECT fam, j, i, pscore FROM (SELECT fam, i, j, pscore, row_number() OVER (PARTITION BY fam, j ORDER BY pscore DESC, i) AS k FROM {pairable}) WHERE k = 1",
    "logsumexp_by_group": "SELECT fam, j, round(m + ln(s), 6) AS lse FROM (SELECT p.fam AS fam, p.j AS j, x.m AS m, sum(exp(p.pscore - x.m)) AS s FROM {pairable} p JOIN (SELECT fam, j, max(pscore) AS m FROM {pairable} GROUP BY fam, j) x ON p.fam = x.fam AND p.j = x.j GROUP BY p.fam, p.j, x.m)",
    "fast_log_exp": "SELECT fam, i, j, round(ln(1 + exp(x)), 6) AS logexp, round(CASE WHEN x < -9.91152e0 THEN 0 ELSE exp(x) END, 6) AS fastexp FROM (SELECT fam, i, j, pscore / 6.163207755e1 AS x FROM {pairable})",
    "dotbracket_pairs": "SELECT fam, seq, i, j FROM {matched}",
    "bracket_depth": "SELECT fam, seq, col, CAST(depth AS INT) AS depth FROM {depths}",
    "project_structure": "SELECT m.fam AS fam, m.seq AS seq, m.i AS i, m.j AS j FROM {matched} m JOIN {cells} a ON m.fam = a.fam AND m.seq = a.seq AND m.i = a.col JOIN {cells} b ON m.fam = b.fam AND m.seq = b.seq AND m.j = b.col WHERE " + PAIR.replace("{a}", "a.code").replace("{b}", "b.code") + " BETWEEN 1 AND 6",
    "pseudo_bpp": "SELECT fam, i, j, round(prob, 6) AS prob FROM {bpp}",
    "bpp_filter": "SELECT fam, i + 1 AS i, j + 1 AS j, round(prob, 6) AS prob FROM {bpp} WHERE prob >= 0.02e0 AND j >= i + 4",
    "bpp_mass": "SELECT fam, round(sum(prob), 5) AS mass, count(*) AS pairs FROM {bpp} WHERE j >= i + 4 GROUP BY fam",
    "unpaired_prob": "SELECT c.fam AS fam, c.col AS col, round(1 - coalesce(u.p, 0), 6) AS unpaired FROM {columns} c LEFT JOIN (SELECT fam, pos, sum(prob) AS p FROM {both_ends} GROUP BY fam, pos) u ON c.fam = u.fam AND c.col = u.pos",
    "bpp_rmsd": "SELECT a_fam, b_fam, round(sqrt(avg(d * d)), 6) AS rmsd, round(avg(abs(d)), 6) AS mean_dev, round(max(abs(d)), 6) AS max_dev, round(min(abs(d)), 6) AS min_dev, count(*) AS pairs_union, CAST(sum(shared) AS BIGINT) AS pairs_shared FROM (SELECT coalesce(x.fam, y.fam - 1) AS a_fam, coalesce(y.fam, x.fam + 1) AS b_fam, coalesce(x.prob, 0) - coalesce(y.prob, 0) AS d, CASE WHEN x.fam IS NULL OR y.fam IS NULL THEN 0 ELSE 1 END AS shared FROM {bpp} x FULL OUTER JOIN {bpp} y ON x.fam + 1 = y.fam AND x.i = y.i AND x.j = y.j) GROUP BY a_fam, b_fam",
    "mutual_best_pairs": "SELECT fam, i, j, round(prob, 6) AS prob FROM {mutual}",
    "pseudoknot_layers": "SELECT a.fam AS fam, a.i AS i, a.j AS j, CAST(sum(CASE WHEN b.i < a.i AND a.i < b.j AND b.j < a.j THEN 1 ELSE 0 END) AS BIGINT) AS crossed FROM {mutual} a JOIN {mutual} b ON a.fam = b.fam GROUP BY a.fam, a.i, a.j",
    "consensus_bases": "SELECT fam, col, code FROM {consensus}",
    "gold_pairs": "SELECT fam, i, j FROM {gold}",
    "eval_prf_sd": "SELECT fam, hit, predicted, gold, round(hit / (predicted + 1e-10), 6) AS prec, round(hit / (gold + 1e-10), 6) AS sens, round(CASE WHEN hit = 0 THEN 0 ELSE 2.0e0 * hit / (predicted + gold) END, 6) AS f1, 32 - 2 * hit - shared AS sd FROM (SELECT f.fam AS fam, CAST((SELECT count(*) FROM {mutual} m JOIN {gold} g ON m.fam = g.fam AND m.i = g.i AND m.j = g.j WHERE m.fam = f.fam) AS INT) AS hit, CAST((SELECT count(*) FROM {mutual} m WHERE m.fam = f.fam) AS INT) AS predicted, CAST((SELECT count(*) FROM {gold} g WHERE g.fam = f.fam) AS INT) AS gold, CAST((SELECT count(*) FROM {columns} c WHERE c.fam = f.fam AND NOT EXISTS (SELECT 1 FROM {mutual} m WHERE m.fam = c.fam AND (m.i = c.col OR m.j = c.col)) AND NOT EXISTS (SELECT 1 FROM {gold} g WHERE g.fam = c.fam AND (g.i = c.col OR g.j = c.col))) AS INT) AS shared FROM (SELECT DISTINCT fam FROM {columns}) f)",
    "ensemble_defect": "SELECT c.fam AS fam, round(32 - 2 * coalesce(max(p.s), 0) - sum(CASE WHEN gu.pos IS NULL THEN 1 - coalesce(u.p, 0) ELSE 0 END), 4) AS defect FROM {columns} c LEFT JOIN (SELECT g.fam AS fam, sum(b.prob) AS s FROM {gold} g JOIN {bpp} b ON g.fam = b.fam AND g.i = b.i AND g.j = b.j GROUP BY g.fam) p ON p.fam = c.fam LEFT JOIN (SELECT fam, pos, sum(prob) AS p FROM {both_ends} GROUP BY fam, pos) u ON u.fam = c.fam AND u.pos = c.col LEFT JOIN (SELECT fam, i AS pos FROM {gold} UNION SELECT fam, j FROM {gold}) gu ON gu.fam = c.fam AND gu.pos = c.col GROUP BY c.fam",
    "slip_edges": "SELECT m.fam AS fam, m.i AS i, m.j AS j, g.i AS gi, g.j AS gj FROM {mutual} m JOIN {gold} g ON m.fam = g.fam AND ((m.i = g.i AND g.j BETWEEN m.j - 1 AND m.j + 1) OR (m.j = g.j AND g.i BETWEEN m.i - 1 AND m.i + 1))",
    "family_rollup": "SELECT CAST(kind AS INT) AS kind, round(avg(p), 6) AS mean_prob, round(min(p), 6) AS min_prob, round(max(p), 6) AS max_prob FROM (SELECT fam % 4 AS kind, fam, avg(prob) AS p FROM {bpp} GROUP BY fam) GROUP BY kind",
    "set_union_pairs": "SELECT fam, i, j FROM {mutual} UNION SELECT fam, i, j FROM {gold}",
    "set_intersect_pairs": "SELECT fam, i, j FROM {mutual} INTERSECT SELECT fam, i, j FROM {gold}",
    "set_except_pairs": "SELECT fam, i, j FROM {mutual} EXCEPT SELECT fam, i, j FROM {gold}",
    "empirical_bpp": "SELECT p.fam AS fam, i, j, round(1.0e0 * p.n / t.n, 6) AS prob FROM (SELECT fam, i, j, count(*) AS n FROM {matched} GROUP BY fam, i, j) p JOIN (SELECT fam, count(DISTINCT seq) AS n FROM {cells} GROUP BY fam) t ON p.fam = t.fam",
    "covariation_energy": "SELECT m.fam AS fam, round(sum(-p.pscore) / 100, 6) AS energy, count(*) AS pairs FROM {mutual} m JOIN {pscore} p ON m.fam = p.fam AND m.i = p.i AND m.j = p.j GROUP BY m.fam",
    "identity_minmax": "SELECT fam, round(min(identity), 4) AS lo, round(max(identity), 4) AS hi, round(avg(identity), 4) AS mean FROM (SELECT fam, a_seq, b_seq, 100.0e0 * sum(same) / count(*) AS identity FROM (SELECT a.fam AS fam, a.seq AS a_seq, b.seq AS b_seq, CASE WHEN a.code = b.code THEN 1 ELSE 0 END AS same FROM {small} a JOIN {small} b ON a.fam = b.fam AND a.col = b.col WHERE a.seq < b.seq) GROUP BY fam, a_seq, b_seq) GROUP BY fam",
    "ungapped_length": "SELECT fam, round(avg(n), 6) AS mean_length FROM (SELECT fam, seq, sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) AS n FROM {cells} GROUP BY fam, seq) GROUP BY fam",
    "ribosum_bin": "SELECT fam, CAST(greatest(12, floor(floor(hi + 0.5e0) / 5)) AS INT) AS max_bin, CAST(least(greatest(5, floor(floor(lo + 0.5e0) / 5)), greatest(12, floor(floor(hi + 0.5e0) / 5)) - 1) AS INT) AS min_bin FROM (SELECT fam, min(identity) AS lo, max(identity) AS hi FROM (SELECT a.fam AS fam, a.seq, b.seq, 100.0e0 * sum(CASE WHEN a.code = b.code THEN 1 ELSE 0 END) / count(*) AS identity FROM {small} a JOIN {small} b ON a.fam = b.fam AND a.col = b.col WHERE a.seq < b.seq GROUP BY a.fam, a.seq, b.seq) GROUP BY fam) WHERE lo + 0.5e0 <= 100.45e0",
    "msa_identity_avg": "SELECT x.family AS family, round(x.identity, 6) AS identity, round(y.length, 6) AS length FROM (SELECT fam % 2 AS family, avg(identity) AS identity FROM (SELECT fam, avg(identity) AS identity FROM (SELECT a.fam AS fam, coalesce(100.0e0 * sum(CASE WHEN a.code = b.code AND a.code <> 5 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a.code = 5 AND b.code = 5 THEN 0 ELSE 1 END), 0), 0) AS identity FROM {small} a JOIN {small} b ON a.fam = b.fam AND a.col = b.col WHERE a.seq < b.seq GROUP BY a.fam, a.seq, b.seq) GROUP BY fam) GROUP BY fam % 2) x JOIN (SELECT fam % 2 AS family, 1.0e0 * sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) / count(DISTINCT seq) AS length FROM {small} GROUP BY fam % 2) y ON x.family = y.family",
    "ungapped_rows": "SELECT fam, seq, replace(text, '-', '') AS text FROM {rows}",
    "range_pairs_6": "SELECT x.fam AS fam, x.i AS i, x.j AS j, y.i AS p, y.j AS q FROM {pairable} x JOIN {pairable} y ON x.fam = y.fam AND y.i < x.i AND x.j < y.j JOIN {counted} a ON a.fam = x.fam AND a.col = x.i - 1 JOIN {counted} b ON b.fam = x.fam AND b.col = y.i JOIN {counted} c ON c.fam = x.fam AND c.col = y.j - 1 JOIN {counted} d ON d.fam = x.fam AND d.col = x.j WHERE (a.upto - b.upto) + (c.upto - d.upto) <= 6 * a.n",
    "multiloop_openings": "SELECT x.fam AS fam, x.i AS i, x.j AS j, y.i AS p, min(y.j) AS q FROM {mutual} x JOIN {pairable} y ON x.fam = y.fam AND y.i < x.i AND x.j < y.j JOIN {counted} a ON a.fam = x.fam AND a.col = x.i - 1 JOIN {counted} b ON b.fam = x.fam AND b.col = y.i WHERE a.upto - b.upto <= 6 * a.n GROUP BY x.fam, x.i, x.j, y.i",
    "ranked_composition": "SELECT fam, i, begins, j, total, place FROM (SELECT a.fam AS fam, a.i AS i, b.i AS begins, b.j AS j, a.w + b.w AS total, CAST(row_number() OVER (PARTITION BY a.fam, b.j ORDER BY a.w + b.w DESC, b.i, a.i) AS INT) AS place FROM {possible} a JOIN {possible} b ON a.fam = b.fam AND a.j + 1 = b.i) WHERE place <= 10",
    "project_on_rows": "SELECT m.fam AS fam, a.seq AS seq, CAST(p.pos AS INT) AS i, CAST(q.pos AS INT) AS j FROM {mutual} m JOIN {cells} a ON m.fam = a.fam AND m.i = a.col JOIN {cells} b ON m.fam = b.fam AND b.seq = a.seq AND m.j = b.col JOIN {positions} p ON p.fam = a.fam AND p.seq = a.seq AND p.col = m.i JOIN {positions} q ON q.fam = a.fam AND q.seq = a.seq AND q.col = m.j WHERE " + _TYPE + " BETWEEN 1 AND 6",
    "project_probabilities": "SELECT m.fam AS fam, a.seq AS seq, CAST(p.pos AS INT) AS i, CAST(q.pos AS INT) AS j, round(m.prob, 6) AS prob FROM {bpp} m JOIN {cells} a ON m.fam = a.fam AND m.i = a.col JOIN {cells} b ON m.fam = b.fam AND b.seq = a.seq AND m.j = b.col JOIN {positions} p ON p.fam = a.fam AND p.seq = a.seq AND p.col = m.i JOIN {positions} q ON q.fam = a.fam AND q.seq = a.seq AND q.col = m.j WHERE m.prob >= 0.02e0 AND " + _TYPE + " BETWEEN 1 AND 6",
    "bpp_deviation_box": "SELECT a_fam, CAST(unnest(range(0, 5)) AS INT) AS point, round(unnest(quantile_cont(d, [0.1, 0.25, 0.5, 0.75, 0.9])), 6) AS deviation FROM (SELECT coalesce(x.fam, y.fam - 1) AS a_fam, abs(coalesce(x.prob, 0) - coalesce(y.prob, 0)) AS d FROM {bpp} x FULL OUTER JOIN {bpp} y ON x.fam + 1 = y.fam AND x.i = y.i AND x.j = y.j) GROUP BY a_fam",
    "pseudoknot_kinds": "SELECT fam, i, j, CASE WHEN NOT once THEN 0 WHEN NOT twice THEN 1 WHEN NOT thrice THEN 2 ELSE 3 END AS layer FROM (SELECT p.fam AS fam, p.i AS i, p.j AS j, x.i IS NOT NULL AS once, y.i IS NOT NULL AS twice, z.i IS NOT NULL AS thrice FROM {mutual} p LEFT JOIN {crossed1} x ON p.fam = x.fam AND p.i = x.i LEFT JOIN {crossed2} y ON p.fam = y.fam AND p.i = y.i LEFT JOIN {crossed3} z ON p.fam = z.fam AND p.i = z.i)",
    "pairs_to_structure": "SELECT c.fam AS fam, string_agg(CASE WHEN g.i IS NOT NULL THEN '(' WHEN h.j IS NOT NULL THEN ')' ELSE '.' END, '' ORDER BY c.col) AS structure FROM {columns} c LEFT JOIN {mutual} g ON g.fam = c.fam AND g.i = c.col LEFT JOIN {mutual} h ON h.fam = c.fam AND h.j = c.col GROUP BY c.fam",
    "distinct_families": "SELECT DISTINCT fam % 4 AS kind FROM {cells}",
    "bag_union_pairs": "SELECT fam, i, j FROM {mutual} UNION ALL SELECT fam, i, j FROM {gold}",
    "msa_scan": "SELECT file AS msa, CAST(k AS INT) AS seq, substr(text, 1 + 12 * k, 12) AS text FROM (SELECT file, text, unnest(range(0, 3)) AS k FROM {named})",
    "fasta_unwrap": "SELECT file AS msa, 0 AS seq, file || '.ct' AS name, text FROM {named}",
    "seq_scan": "SELECT file, replace(text, '-', '') AS text FROM {named} WHERE length(replace(text, '-', '')) >= CASE fam WHEN 0 THEN 31 WHEN 1 THEN 30 ELSE 1 END",
    "structure_scan": "SELECT file, CASE WHEN substr(a, 1, 1) <> ')' THEN a ELSE b END AS first, CASE WHEN substr(b, 1, 1) <> ')' THEN b ELSE a END AS last FROM (SELECT file, translate(text, 'ACGU-', '.()(.') AS a, translate(text, 'ACGU-', '(.)(.') AS b FROM {named}) WHERE substr(a, 1, 1) <> ')' OR substr(b, 1, 1) <> ')'",
    "sample_scan": "SELECT * FROM (SELECT file, 1 AS at, translate(text, 'ACGU-', '.()(.') AS structure FROM {named} UNION ALL SELECT file, 2 AS at, translate(text, 'ACGU-', '(.)(.') AS structure FROM {named}) WHERE substr(structure, 1, 1) <> ')'",
    "sequence_scan": "SELECT file, '>a' || seq AS header, text, '>b' || seq AS last_header, reverse(text) AS last_text FROM {named}",
    "bpp_lines": "SELECT fam AS msa, string_agg(printf('%d %d %.4e', i + 1, j + 1, 0.987654321e0 * prob), chr(10) ORDER BY i, j) || chr(10) AS value FROM {bpp} WHERE prob > 0 AND j >= i + 4 GROUP BY fam",
    "bpp_file_scan": "SELECT 'src' || fam AS file, i, j, prob FROM {printed} WHERE prob >= 0.05e0",
    "bpp_file_scan_whole": "SELECT 'src' || fam AS file, i + 1 AS i, j + 1 AS j, prob FROM {printed}",
    "bpp_reference_scan": "SELECT * FROM (SELECT m.fam AS fam, a.seq AS seq, CAST(p.pos AS INT) AS i, CAST(q.pos AS INT) AS j, m.prob AS prob FROM {printed} m JOIN (SELECT fam, min(seq) AS seq FROM {cells} GROUP BY fam) r ON r.fam = m.fam JOIN {cells} a ON m.fam = a.fam AND a.seq = r.seq AND m.i = a.col JOIN {cells} b ON m.fam = b.fam AND b.seq = a.seq AND m.j = b.col JOIN {positions} p ON p.fam = a.fam AND p.seq = a.seq AND p.col = m.i JOIN {positions} q ON q.fam = a.fam AND q.seq = a.seq AND q.col = m.j WHERE m.at >= 5 AND " + _TYPE + " BETWEEN 1 AND 6) WHERE (i <= 10 OR i BETWEEN 20 AND 31) AND (j <= 10 OR j BETWEEN 20 AND 31) AND i <> 10 AND j <> 10",
    "ct_scan": "SELECT 'src' || fam || '/d' || seq AS file, i, j FROM {matched} UNION ALL SELECT 'src' || c.fam || '/d' || c.seq AS file, c.col AS i, -1 AS j FROM {cells} c WHERE NOT EXISTS (SELECT 1 FROM {matched} m WHERE m.fam = c.fam AND m.seq = c.seq AND (m.i = c.col OR m.j = c.col))",
    "header_lookup": "SELECT query, min(file) AS file, '>' || min(file) || '.ct' AS line, arg_min(text, file) AS following FROM (SELECT DISTINCT 'd' || seq AS query FROM {named} WHERE CAST(seq AS VARCHAR) LIKE '%00') JOIN {named} ON contains(file || '.ct', query) GROUP BY query",
    "ground_truth_rows": "SELECT file, '>x/d' || seq || 'z.ct' AS header, text FROM {named} WHERE CAST(seq AS VARCHAR) LIKE '%00'",
    "paired_files": "SELECT 'k_' || fam || '_' || seq || '.aln.fasta' AS name, 'k_' || fam AS family, fam AS ordinal, seq % 3 <> 0 AS found FROM {rows}",
    "run_configs": "SELECT './' || r_name AS input_dir, 30 AS k, 'x' AS dataset_name, r_name AS family_name, 's' AS subfamily_name, 2 AS align, unnest([10, r_regionkey]) AS count, unnest(['v1', 'v2']) AS output_dir FROM region",
    "gaps_removed": "SELECT file, 0 AS at, '>a-' || seq AS line FROM {named} UNION ALL SELECT file, 1 AS at, replace(text, '-', '') AS line FROM {named}",
    "find_replace": "SELECT file, 0 AS at, '>a-' || seq AS line FROM {named} UNION ALL SELECT file, 1 AS at, replace(text, 'GC', 'x') AS line FROM {named}",
    "sample_k_per_family": "SELECT fam, replicate, seq FROM (SELECT fam, replicate, seq, row_number() OVER (PARTITION BY fam, replicate ORDER BY md5('7/' || replicate || '/' || seq), seq) AS k FROM (SELECT fam, seq, CAST(unnest([1, 2]) AS INT) AS replicate FROM {rows})) WHERE k <= 3",
    "family_replicates": "SELECT fam, round(n, 6) AS mean_length, CAST(unnest(range(1, 11)) AS INT) AS copy FROM (SELECT fam, avg(length(replace(text, '-', ''))) AS n FROM {rows} GROUP BY fam)",
    "joined_regions": "SELECT fam, substr(structure, 1, 10) || '....' || substr(structure, 21, 11) AS joined, substr(structure, 1, 20) || '............' AS padded FROM {drawn_gold}",
    "region_pairs": "SELECT fam, i, j, 'within' AS kind FROM {gold} WHERE (i <= 10 OR i BETWEEN 20 AND 31) AND (j <= 10 OR j BETWEEN 20 AND 31) AND i <> 10 AND j <> 10 UNION ALL SELECT fam, i, j, 'leaving' AS kind FROM {gold} WHERE (i <= 10 AND j BETWEEN 11 AND 19) OR (j BETWEEN 20 AND 31 AND i BETWEEN 11 AND 19)",
    "gold_shift": "SELECT fam, CASE WHEN i >= 10 THEN i + 90 ELSE i END AS i, CASE WHEN j >= 10 THEN j + 90 ELSE j END AS j FROM {gold} UNION ALL SELECT fam, CASE WHEN col >= 10 THEN col + 90 ELSE col END AS i, -1 AS j FROM {columns} c WHERE col NOT BETWEEN 6 AND 9 AND NOT EXISTS (SELECT 1 FROM {gold} g WHERE g.fam = c.fam AND (g.i = c.col OR g.j = c.col))",
    "hairpin_energies": f"SELECT fam, seq, i, j, CAST({_HAIRPIN} AS INT) AS energy FROM {{sites}}",
    "stem_energies": f"SELECT fam, seq, i, j, CAST({_STEM} AS INT) AS outer_stem, CAST({_STEM} + 15 AS INT) AS inner_stem FROM {{sites}}",
    "hairpin_sums": f"SELECT fam, i, j, CAST(sum({_HAIRPIN}) AS BIGINT) AS energy FROM {{sites}} GROUP BY fam, i, j",
}

