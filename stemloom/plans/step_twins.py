"""SQL for DuckDB that says what the queries of ``steps`` must return, written apart from the operators."""

from __future__ import annotations

from stemloom.functions import energies as E

_STACK = "[" + ", ".join(str(v) for x in E.PAIRS for v in E.STACK[x]) + "]"
_BULGE = "[" + ", ".join(map(str, E.BULGE[1:])) + "]"
_INTERIOR = "[83, 83, 83, " + ", ".join(map(str, E.INTERIOR[4:])) + "]"
_LONG = "CAST(trunc(107.856e0 * ln({n} / 30.0e0)) AS INT)"
_OF = "CASE WHEN {n} <= 30 THEN ({t})[{n}] ELSE ({t})[30] + " + _LONG + " END"


def _sized(table: str, n: str) -> str:
    return _OF.replace("{t}", table).replace("{n}", n)


def _mismatch(t: str, a: str, b: str) -> str:
    weak = f"CASE WHEN {t} > 2 THEN 63 ELSE 0 END"
    pair = f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0 WHEN ({a} = 1 AND {b} = 3) OR ({a} = 3 AND {b} = 1) THEN {weak} - 50 WHEN {a} = 4 AND {b} = 4 THEN {weak} - 45 ELSE {weak} END"
    none = f"CASE WHEN ({a} = 1 AND {b} = 4) OR ({a} = 3 AND {b} = 1) THEN -20 WHEN {a} = 4 AND {b} = 4 THEN 20 ELSE 90 END"
    return f"(CASE WHEN {t} = 7 THEN {none} ELSE {pair} END)"


_BASE = "CASE WHEN {x} BETWEEN 0 AND 3 THEN {x} + 1 ELSE 0 END"
_KIND = "CASE WHEN {a} = 1 AND {b} = 2 THEN 1 WHEN {a} = 2 AND {b} = 1 THEN 2 WHEN {a} = 2 AND {b} = 3 THEN 3 WHEN {a} = 3 AND {b} = 2 THEN 4 WHEN {a} = 0 AND {b} = 3 THEN 5 WHEN {a} = 3 AND {b} = 0 THEN 6 ELSE 7 END"
_STACKED = f"(CASE WHEN t1 < 7 AND t2 < 7 THEN ({_STACK})[(t1 - 1) * 6 + t2] ELSE 0 END)"
_WEAK = "(CASE WHEN t1 > 2 THEN 56 ELSE 0 END + CASE WHEN t2 > 2 THEN 56 ELSE 0 END)"
_GENERAL = f"""CASE WHEN n1 = 0 AND n2 = 0 THEN {_STACKED} WHEN n1 + n2 = 1 THEN 281 + {_STACKED} WHEN least(n1, n2) = 0 THEN {_sized(_BULGE, "greatest(n1, n2)")} + {_WEAK}
  ELSE {_sized(_INTERIOR, "(n1 + n2)")} + least(300, 50 * abs(n1 - n2)) + {_mismatch("t1", "si", "sj")} + {_mismatch("t2", "sq", "sp")} END"""
_KEYS = {"(n1 = 1 AND n2 = 1)": "t1 t2 si sj 0 0", "(n1 = 1 AND n2 = 2)": "t1 t2 si sq sj 0", "(n1 = 2 AND n2 = 1)": "t2 t1 sq si sp 0", "(n1 = 2 AND n2 = 2)": "t1 t2 si sp sq sj"}
_LISTED = "CASE " + " ".join("WHEN {w} AND ({0} + 2 * {1} + {2} + {3} + {4} + {5}) % 3 <> 0 THEN 100 + 10 * {0} - 5 * {1} + 7 * {2} - 3 * {3} + 2 * {4} - {5}".replace("{w}", w).format(*keys.split()) for w, keys in _KEYS.items()) + " END"


def _near(cells: str) -> str:
    """Each cell with the bases up to it and the table bases of its nearest bases on both sides."""
    order = "(PARTITION BY fam, seq ORDER BY col ROWS BETWEEN "
    left = f"max(CASE WHEN code <> 5 THEN col * 8 + code END) OVER {order}UNBOUNDED PRECEDING AND 1 PRECEDING) % 8"
    right = f"min(CASE WHEN code <> 5 THEN col * 8 + code END) OVER {order}1 FOLLOWING AND UNBOUNDED FOLLOWING) % 8"
    base = lambda x: _BASE.replace("{x}", f"coalesce({x}, 4)")
    return f"SELECT fam, seq, col, code, CAST(sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) OVER {order}UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS upto, {base(left)} AS ib, {base(right)} AS ia FROM {{{cells}}}"


def _nested(pairs: str, counted: str, span: int) -> str:
    """Pairs of pairs with at most ``span`` bases a row between them."""
    return f"SELECT x.fam AS fam, x.i AS i, x.j AS j, y.i AS p, y.j AS q FROM {{{pairs}}} x JOIN {{{pairs}}} y ON x.fam = y.fam AND y.i < x.i AND x.j < y.j JOIN {{{counted}}} a ON a.fam = x.fam AND a.col = x.i - 1 JOIN {{{counted}}} b ON b.fam = x.fam AND b.col = y.i JOIN {{{counted}}} c ON c.fam = x.fam AND c.col = y.j - 1 JOIN {{{counted}}} d ON d.fam = x.fam AND d.col = x.j WHERE (a.upto - b.upto) + (c.upto - d.upto) <= {span} * a.n"


def _loops(near: str, nested: str) -> str:
    """The loops between them in each row."""
    bases = lambda x: f"CASE WHEN {x}.code <> 5 THEN 1 ELSE 0 END"
    kind = lambda a, b: _KIND.replace("{a}", f"{a}.code").replace("{b}", f"{b}.code")
    return f"""SELECT r.fam AS fam, i.seq AS seq, p, q, r.i AS i, r.j AS j, i.upto - {bases("i")} - o.upto AS n1, e.upto - {bases("e")} - j.upto AS n2,
  {kind("o", "e")} AS t1, {kind("j", "i")} AS t2, o.ia AS si, e.ib AS sj, i.ib AS sp, j.ia AS sq
  FROM {{{nested}}} r JOIN {{{near}}} i ON i.fam = r.fam AND i.col = r.i JOIN {{{near}}} j ON j.fam = r.fam AND j.seq = i.seq AND j.col = r.j JOIN {{{near}}} o ON o.fam = r.fam AND o.seq = i.seq AND o.col = p JOIN {{{near}}} e ON e.fam = r.fam AND e.seq = i.seq AND e.col = q"""


_ENERGY = f"CAST(coalesce({_LISTED}, {_GENERAL}) AS INT)"
_F = ", ".join(f"CAST(sum(CASE WHEN t = {k} THEN 1 ELSE 0 END) AS BIGINT) AS f{k}" for k in range(8))
_TYPE = _KIND.replace("ELSE 7", "WHEN {a} = 5 AND {b} = 5 THEN 7 ELSE 0")
_COVARIATION = " + ".join(f"{sum(x != y for x, y in zip(E.PAIRS[k], E.PAIRS[m], strict=True))} * f{k + 1} * f{m + 1}" for k in range(6) for m in range(k + 1, 6))
_SCORE = "round(1.2e0 * (100.0e0 * ({c}) / n - 0.1e0 * 100.0e0 * (f0 + 0.25e0 * f7)) / n, 6)"


def _histogram(cells: str) -> str:
    t = _TYPE.replace("{a}", "a.code").replace("{b}", "b.code")
    return f"SELECT fam, i, j, count(*) AS n, {_F} FROM (SELECT a.fam AS fam, a.col AS i, b.col AS j, {t} AS t FROM {{{cells}}} a JOIN {{{cells}}} b ON a.fam = b.fam AND a.seq = b.seq WHERE a.col < b.col) GROUP BY fam, i, j"


_GAMMAS = "[1024, 512, 256, 128, 64, 32, 16, 8, 6, 4, 2]"
#: Relations that DuckDB is to make once.
ONCE = {"near", "small_near", "nested", "small_nested"}
RELATIONS = {
    "near": _near("cells"),
    "small_near": _near("small"),
    "small_counted": "SELECT fam, col, n, CAST(sum(bases) OVER (PARTITION BY fam ORDER BY col) AS BIGINT) AS upto FROM (SELECT fam, col, sum(CASE WHEN code <> 5 THEN 1 ELSE 0 END) AS bases, count(*) AS n FROM {small} GROUP BY fam, col)",
    "small_pairable": f"SELECT fam, i, j FROM (SELECT *, {_SCORE.replace('{c}', _COVARIATION)} AS pscore FROM ({_histogram('small')})) WHERE 2 * f0 + f7 <= n AND pscore >= -400",
    "small_nested": _nested("small_pairable", "small_counted", 6),
    "nested": _nested("pairable", "counted", 6),
    "small_loops": _loops("small_near", "small_nested"),
    "loops": _loops("near", "nested"),
    "bins": "SELECT fam, CAST(greatest(12, floor(floor(hi + 0.5e0) / 5)) AS INT) AS max_bin, CAST(least(greatest(5, floor(floor(lo + 0.5e0) / 5)), greatest(12, floor(floor(hi + 0.5e0) / 5)) - 1) AS INT) AS min_bin FROM (SELECT fam, min(identity) AS lo, max(identity) AS hi FROM (SELECT a.fam AS fam, a.seq, b.seq, 100.0e0 * sum(CASE WHEN a.code = b.code THEN 1 ELSE 0 END) / count(*) AS identity FROM {cells} a JOIN {cells} b ON a.fam = b.fam AND a.col = b.col WHERE a.seq < b.seq GROUP BY a.fam, a.seq, b.seq) GROUP BY fam) WHERE lo + 0.5e0 <= 100.45e0",
    "choice": "SELECT fam, max_bin, min_bin, CAST(CASE WHEN min_bin >= 3 THEN least(min_bin - min_bin % 3, 18) END AS INT) AS used FROM {bins}",
    "wide": "SELECT fam, seq, CAST(col AS INT) AS col, CAST(CASE WHEN nib < 4 THEN 0 WHEN nib < 8 THEN 1 WHEN nib < 12 THEN 2 WHEN nib = 14 THEN 5 ELSE 3 END AS INT) AS code FROM (SELECT fam, seq, col, instr('0123456789abcdef', substr(d, CAST(col AS INT) + 1, 1)) - 1 AS nib FROM (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS fam, doc_id AS seq, sha256(coalesce(text, '')) || sha256(coalesce(text, '') || '/') AS d, unnest(range(0, 128)) AS col FROM documents))",
    "edges": "SELECT m.fam AS fam, 'p' || m.i || '/' || m.j AS a, 'g' || g.i || '/' || g.j AS b FROM {mutual} m JOIN {gold} g ON m.fam = g.fam AND ((m.i = g.i AND g.j BETWEEN m.j - 1 AND m.j + 1) OR (m.j = g.j AND g.i BETWEEN m.i - 1 AND m.i + 1))",
    "grid": f"SELECT c.fam AS fam, CAST(g.gamma AS DOUBLE) AS gamma, CAST(coalesce(sum(CASE WHEN p.prob > 1.0e0 / (g.gamma + 1) THEN 1 ELSE 0 END), 0) AS BIGINT) AS pairs, coalesce(sum(CASE WHEN p.prob > 1.0e0 / (g.gamma + 1) THEN p.prob ELSE 0 END), 0) AS hits, coalesce(sum(p.prob), 0) AS mass FROM (SELECT DISTINCT fam FROM {{columns}}) c CROSS JOIN (SELECT unnest({_GAMMAS}) AS gamma) g LEFT JOIN {{bpp}} p ON p.fam = c.fam AND p.j >= p.i + 4 GROUP BY c.fam, g.gamma",
    "correlations": "SELECT fam, gamma, pairs, hits, CASE WHEN pairs > 0 AND mass > 0 THEN (hits * tn - (pairs - hits) * (mass - hits)) / sqrt(pairs * mass * (tn + pairs - hits) * (tn + mass - hits)) ELSE 0 END AS correlation FROM (SELECT *, 32 * 15 - pairs - mass + hits AS tn FROM {grid})",
    "back": "SELECT fam, j, i FROM (SELECT fam, i, j, row_number() OVER (PARTITION BY fam, j ORDER BY pscore DESC, i) AS k FROM {pairable}) WHERE k = 1",
    "drawn_kinds": "SELECT fam, seq, i, j, (i + j * 3 + i * seq) % 4 AS kind FROM {matched}",
    "names": "SELECT DISTINCT fam, 'k_' || ((seq * 7) % 120) || CASE WHEN seq % 2 = 0 THEN '_00' || seq ELSE '' END || '.fasta' AS name FROM {rows}",
    "begun": "SELECT p.fam AS fam, p.i AS i, p.j AS j, p.pscore AS pscore, coalesce((SELECT max(b.pscore) FROM {pairable} b WHERE b.fam = p.fam AND b.j < p.i), 0) AS prefix FROM {pairable} p",
}

_WALK = """WITH RECURSIVE walk(fam, lo, hi, level) AS (
  SELECT DISTINCT fam, 0, 31, 0 FROM {back}
  UNION ALL
  SELECT fam, n.lo, n.hi, level + 1 FROM (
    SELECT w.fam AS fam, w.level AS level, unnest(CASE WHEN b.i >= w.lo THEN [{'lo': b.i + 1, 'hi': w.hi - 1}, {'lo': w.lo, 'hi': b.i - 1}] ELSE [{'lo': w.lo, 'hi': w.hi - 1}] END) AS n
    FROM walk w LEFT JOIN {back} b ON b.fam = w.fam AND b.j = w.hi) WHERE n.hi - n.lo >= 4),
traced AS (SELECT w.fam AS fam, b.i AS i, b.j AS j, w.level AS level FROM walk w JOIN {back} b ON b.fam = w.fam AND b.j = w.hi AND b.i >= w.lo) """
_REACH = """WITH RECURSIVE joined AS (SELECT fam, a, b FROM {edges} UNION SELECT fam, b AS a, a AS b FROM {edges}),
reach(fam, a, b) AS (SELECT fam, a, b FROM joined UNION SELECT r.fam, r.a, s.b FROM reach r JOIN joined s ON s.fam = r.fam AND s.a = r.b),
parts AS (SELECT fam, a, min(b) AS part FROM reach GROUP BY fam, a),
sizes AS (SELECT e.fam AS fam, p.part AS part, count(*) AS n FROM {edges} e JOIN parts p ON p.fam = e.fam AND p.a = e.a GROUP BY e.fam, p.part) """

OPERATORS = {
    "substitution_choice": "SELECT fam, max_bin, min_bin, used FROM {choice}",
    "pscore_by_identity": "SELECT fam, i, j, " + _SCORE.replace("{c}", "bonus") + " AS pscore FROM (SELECT h.fam AS fam, h.i AS i, h.j AS j, any_value(n) AS n, any_value(f0) AS f0, any_value(f7) AS f7, sum(CASE WHEN k = l THEN [f1, f2, f3, f4, f5, f6][k] * ([f1, f2, f3, f4, f5, f6][k] - 1) / 2.0e0 ELSE 1.0e0 * [f1, f2, f3, f4, f5, f6][k] * [f1, f2, f3, f4, f5, f6][l] END * (CASE WHEN c.used IS NULL THEN 0 ELSE (k * 3 + l * 5) % 7 / 2.0e0 + c.used / 8.0e0 END)) AS bonus FROM {gated} h LEFT JOIN {choice} c ON c.fam = h.fam CROSS JOIN (SELECT unnest(range(1, 7)) AS k) ks CROSS JOIN (SELECT unnest(range(1, 7)) AS l) ls WHERE k <= l GROUP BY h.fam, h.i, h.j)",
    "loop_energies": f"SELECT fam, seq, p, q, i, j, {_ENERGY} AS energy FROM {{small_loops}}",
    "loop_sums": f"SELECT fam, p, q, i, j, CAST(sum({_ENERGY}) AS BIGINT) AS energy FROM {{loops}} GROUP BY fam, p, q, i, j",
    "special_hairpins": "SELECT c.fam AS fam, c.seq AS seq, c.col AS col, l.kind AS kind, CAST(CASE WHEN c.code = 5 THEN -1 ELSE coalesce(list_position(l.entries, substr(b.bare, CAST(p.pos AS INT) + 1, length(l.entries[1]))), 0) - 1 END AS INT) AS place FROM {cells} c JOIN {positions} p ON p.fam = c.fam AND p.seq = c.seq AND p.col = c.col JOIN (SELECT fam, seq, replace(text, '-', '') AS bare FROM {rows}) b ON b.fam = c.fam AND b.seq = c.seq CROSS JOIN (SELECT 'tri' AS kind, ['CAACG', 'GUUAC'] AS entries UNION ALL SELECT 'tetra', ['CAACGG', 'CCAAGG', 'CCACGG', 'CCCAGG', 'CCGAGG', 'CCGCGG', 'CCUAGG', 'CCUCGG', 'CUAAGG', 'CUACGG', 'CUCAGG', 'CUCCGG', 'CUGCGG', 'CUUAGG', 'CUUCGG', 'CUUUGG'] UNION ALL SELECT 'hexa', ['ACAGUACU', 'ACAGUGAU', 'ACAGUGCU', 'ACAGUGUU']) l",
    "bracket_closings": "SELECT fam, seq, CAST(row_number() OVER (PARTITION BY fam, seq ORDER BY j) - 1 AS INT) AS nth, CAST(kind AS INT) AS kind, i, j FROM {drawn_kinds} WHERE seq % 5 <> 0 UNION ALL SELECT DISTINCT fam, seq, CAST(NULL AS INT) AS nth, CAST(NULL AS INT) AS kind, CAST(NULL AS INT) AS i, CAST(NULL AS INT) AS j FROM {cells} WHERE seq % 5 = 0",
    "traceback_pairs": _WALK + "SELECT fam, i, j, level FROM traced",
    "traceback_hits": _WALK + "SELECT t.fam AS fam, count(*) AS pairs, round(sum(coalesce(p.prob, 0)), 6) AS hits FROM traced t LEFT JOIN {bpp} p ON p.fam = t.fam AND p.i = t.i AND p.j = t.j GROUP BY t.fam",
    "slip_hits": _REACH + "SELECT m.fam AS fam, CAST(coalesce((SELECT sum((n + 1) // 2) FROM sizes s WHERE s.fam = m.fam), 0) AS BIGINT) AS hit, count(*) AS predicted FROM {mutual} m GROUP BY m.fam",
    "gamma_grid": "SELECT fam, gamma, pairs, round(hits, 6) AS hits, round(correlation, 6) AS correlation FROM {correlations}",
    "best_gamma": "SELECT f.fam AS fam, b.gamma AS gamma, round(b.correlation, 6) AS correlation FROM (SELECT DISTINCT fam FROM {columns}) f LEFT JOIN (SELECT fam, gamma, correlation FROM (SELECT fam, gamma, round(correlation, 12) AS correlation, row_number() OVER (PARTITION BY fam ORDER BY round(correlation, 12) DESC, gamma DESC) AS k FROM {correlations} WHERE round(correlation, 12) > 0) WHERE k = 1) b ON b.fam = f.fam",
    "natural_order": "SELECT fam, name, CAST(row_number() OVER (PARTITION BY fam ORDER BY array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(ltrim(x, '0'), 20, '0') ELSE x END FOR x IN regexp_extract_all(name, '[0-9]+|[^0-9]+')], chr(1)), length(name)) AS INT) AS place FROM {names}",
    "beam_prefix_topk": "SELECT fam, i, j, pscore, prefix FROM (SELECT *, rank() OVER (PARTITION BY fam, j ORDER BY round(prefix + pscore, 6) DESC) AS k FROM {begun}) WHERE k <= 6",
    "wide_pscore_pairs": f"SELECT fam, i, j, pscore FROM (SELECT *, {_SCORE.replace('{c}', _COVARIATION)} AS pscore FROM ({_histogram('wide')})) WHERE 2 * f0 + f7 <= n AND pscore >= -40",
}
