"""SQL for the registered queries, worked out in a different way where one exists.

Positions come from a scan into matches and single letters with a running length, Z-DNA from
prefix sums over single steps, regions from inequality joins.
"""

from __future__ import annotations

import re

from seqspark.operators import classify, clusters, disease
from seqspark.operators.g4 import BIPARTITE, FOUR_RUNS, TANDEM, TRIPLEX
from seqspark.operators.imotif import AC_PATTERNS, SEED
from seqspark.plans.catalog import DETECTED_CLASSES
from seqspark.sources.tables import sequences_sql

SEQS = f"seqs AS MATERIALIZED ({sequences_sql()})"


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SEQS, *ctes]) + "\n" + body


def tok(name: str, pattern: str, where: str = "") -> str:
    """Matches of a pattern with positions."""
    return f"""{name} AS MATERIALIZED (
      SELECT seq_id, CAST(e - length(t) + 1 AS INT) AS start_pos, CAST(e AS INT) AS end_pos, t AS motif FROM (
        SELECT seq_id, t, sum(length(t)) OVER (PARTITION BY seq_id ORDER BY i) AS e FROM (
          SELECT seq_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM (
            SELECT seq_id, regexp_extract_all(sequence, '(?:{pattern})|.') AS a FROM seqs
            WHERE regexp_matches(sequence, '{pattern}'))))
      WHERE length(t) > 1 {where})"""


def count(text: str, bases: str) -> str:
    return f"(length({text}) - length(translate({text}, '{bases}', '')))"


def frac(text: str, bases: str) -> str:
    return f"({count(text, bases)} / CAST(length({text}) AS DOUBLE))"


def n_re(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def lens(text: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda r: length(r))"


def runs_sum(text: str, plus: str, minus: str, weight: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '{plus}+|{minus}+'), lambda r: "
        f"(CASE WHEN r[1] = '{plus}' THEN 1.0 ELSE -1.0 END) * ({weight}))), 0)"
    )


RAMP = "CASE WHEN length(r) <= 4 THEN length(r) * (length(r) + 1) / 2.0 ELSE 10.0 + 4.0 * (length(r) - 4) END"
HUNTER = "length(r) * least(length(r), 4)"


def g4mean(text: str) -> str:
    return f"({runs_sum(text, 'G', 'C', RAMP)} / length({text}))"


def curvature(text: str) -> str:
    return (
        f"(length({text}) * (1.0 + {frac(text, 'AT')}) + 0.5 * coalesce(list_sum(list_transform("
        f"regexp_extract_all({text}, 'A+|T+'), lambda r: sqrt(length(r)))), 0))"
    )


def motif_rows(source: str, cls: str, subtype: str, score: str, detail: str = "''", spacer: str = "''", text="motif", digits=6) -> str:
    score = f"round({score}, {digits})" if digits else f"CAST({score} AS DOUBLE)"
    return (
        f"SELECT seq_id, start_pos, end_pos, {cls} AS class, {subtype} AS subtype, "
        f"CAST(end_pos - start_pos + 1 AS INT) AS length, {text} AS sequence, {score} AS score, "
        f"{detail} AS detail, {spacer} AS spacer FROM {source}"
    )


def greedy(name: str, source: str, order: str, shared: bool) -> str:
    """Best-first selection as a fold over each sequence's ordered list."""
    test = "NOT (x.e <= y.s OR x.s >= y.e)" if shared else "NOT (x.e < y.s OR x.s > y.e)"
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq_id, {order}) AS rn FROM {source}),
    {name}_f AS (SELECT seq_id, list_reduce(
        list_prepend({{'s': -9, 'e': -9, 'rn': CAST(0 AS BIGINT), 'sel': CAST([] AS STRUCT(s INT, e INT, rn BIGINT)[])}},
          list({{'s': start_pos, 'e': end_pos, 'rn': rn, 'sel': CAST([] AS STRUCT(s INT, e INT, rn BIGINT)[])}} ORDER BY rn)),
        lambda a, x: CASE WHEN len(list_filter(a.sel, lambda y: {test})) > 0 THEN a ELSE
          {{'s': -9, 'e': -9, 'rn': CAST(0 AS BIGINT), 'sel': list_append(a.sel, {{'s': x.s, 'e': x.e, 'rn': x.rn}})}} END) AS r
      FROM {name}_n GROUP BY seq_id),
    {name} AS (SELECT n.* EXCLUDE (rn) FROM {name}_n n JOIN (SELECT unnest(r.sel).rn AS rn FROM {name}_f) USING (rn))"""


BEST = "score DESC, length DESC, start_pos, subtype"

# --- detectors ------------------------------------------------------------------------------

TRACTS = tok("tracts", "A{4,}|T{4,}")
LONG_TRACTS = tok("long_tracts", "A{7,}|T{7,}")
CHAINS = """tl AS (SELECT seq_id, list({'s': start_pos, 'e': end_pos, 'c': (start_pos + end_pos - 2) // 2} ORDER BY start_pos) AS l
      FROM tracts GROUP BY seq_id),
    starts AS (SELECT seq_id, l, unnest(generate_series(1, len(l))) AS i FROM tl),
    chains AS (SELECT seq_id, l[i].s AS start_pos, list_reduce(list_transform(l[i:], lambda t:
          {'s': t.s, 'e': t.e, 'c': t.c, 'n': 1, 'bases': t.e - t.s + 1, 'phase': CAST(0 AS DOUBLE), 'shut': false}),
        lambda a, t: CASE
          WHEN NOT a.shut AND t.c - a.c BETWEEN 6 AND 15 THEN {'s': a.s, 'e': t.e, 'c': t.c, 'n': a.n + 1,
             'bases': a.bases + t.bases, 'phase': a.phase + greatest(0, 1 - ((t.c - a.c - 10.5) / 3.0) ** 2), 'shut': false}
          ELSE {'s': a.s, 'e': a.e, 'c': a.c, 'n': a.n, 'bases': a.bases, 'phase': a.phase, 'shut': a.shut OR a.n >= 3} END) AS r
      FROM starts),
    gcurve AS (SELECT g.*, substr(sequence, start_pos, end_pos - start_pos + 1) AS motif, bases / 8.0 + 1.5 * n + 3.0 * phase
        + CASE WHEN end_pos - start_pos + 1 >= 100 THEN 2 WHEN end_pos - start_pos + 1 >= 50 THEN 1 ELSE 0 END AS score
      FROM (SELECT seq_id, start_pos, r.e AS end_pos, r.n AS n, r.bases AS bases, r.phase AS phase FROM chains WHERE r.n >= 3) g
      JOIN seqs USING (seq_id))"""
GCURVE = motif_rows("gcurve", "'Curved DNA'", "'Global curvature'", "score", "'Tracts=' || n", "'Spacing=6-15'")
LCURVE_SRC = """(SELECT * FROM long_tracts t WHERE NOT EXISTS (SELECT 1 FROM gcurve g WHERE g.seq_id = t.seq_id
      AND (t.start_pos BETWEEN g.start_pos AND g.end_pos OR t.end_pos BETWEEN g.start_pos AND g.end_pos)))"""
LCURVE = motif_rows(LCURVE_SRC, "'Curved DNA'", "'Local Curvature'", curvature("motif"))

STICKY = tok("sticky", "(?:GAA){6,}|(?:TTC){6,}")
STICKY_ROWS = motif_rows(
    "sticky", "'Triplex'", "'sticky DNA'", f"length(motif) // 3 * (1 + 0.3 * {frac('motif', 'AT')})",
    "'Unit=' || motif[1:3] || ';Copies=' || (length(motif) // 3)",
)
EGZ = tok("egz_hits", "(?:CGG){3,}") + """,
    egz AS (SELECT e.seq_id, e.start_pos, e.end_pos, substr(sequence, e.start_pos, e.end_pos - e.start_pos + 1) AS motif FROM (
        SELECT seq_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (
          SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY start_pos) AS g FROM (
            SELECT *, CASE WHEN start_pos - 1 - lag(end_pos) OVER (PARTITION BY seq_id ORDER BY start_pos) <= 3 THEN 0 ELSE 1 END AS new
            FROM egz_hits)) GROUP BY seq_id, g) e JOIN seqs USING (seq_id))"""
EGZ_ROWS = motif_rows(
    "egz", "'Z-DNA'", "'eGZ (Extruded-G) DNA'", f"length(motif) // 3 * (1 + 2 * {frac('motif', 'G')})",
    "'Unit=CGG;Copies=' || (length(motif) // 3)",
)
STEPS = """steps AS MATERIALIZED (
      SELECT seq_id, pos, CASE WHEN d IN ('GC', 'CG') THEN 7.0 WHEN d IN ('GT', 'TG', 'AC', 'CA') THEN 1.25
          WHEN d IN ('AT', 'TA') THEN 0.5 + [0.5, 0.5, 0.5, 0.0, 0.0, -5.0, -100.0][CAST(least(k, 7) AS INT)]
          ELSE -3.0 * k END :: DOUBLE AS weight
      FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, kind, grp ORDER BY pos) AS k FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY seq_id, kind ORDER BY pos) AS grp FROM (
          SELECT seq_id, pos, d, CASE WHEN d IN ('GC', 'CG') THEN 's' WHEN d IN ('GT', 'TG', 'AC', 'CA') THEN 'm'
              WHEN d IN ('AT', 'TA') THEN 'w' ELSE 'x' END AS kind
          FROM (SELECT seq_id, pos, b || lead(b) OVER (PARTITION BY seq_id ORDER BY pos) AS d FROM (
            SELECT seq_id, unnest(string_split(sequence, '')) AS b, unnest(generate_series(1, length)) AS pos FROM seqs))
          WHERE d IS NOT NULL))))"""
ZSEG = STEPS + """,
    kadane AS (SELECT seq_id, pos, w - least(0, min(w) OVER (PARTITION BY seq_id ORDER BY pos)) AS s FROM (
        SELECT seq_id, pos, sum(weight) OVER (PARTITION BY seq_id ORDER BY pos) AS w FROM steps)),
    runs AS (SELECT *, sum(CASE WHEN s <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM kadane),
    best AS (SELECT seq_id, g, min(pos) AS p0, max(s) AS top FROM runs WHERE s > 0 GROUP BY seq_id, g),
    zseg AS (SELECT z.*, substr(sequence, start_pos, end_pos - start_pos + 1) AS motif FROM (
        SELECT b.seq_id, CAST(b.p0 AS INT) AS start_pos, CAST(min(r.pos) + 1 AS INT) AS end_pos, b.top FROM best b
        JOIN runs r ON r.seq_id = b.seq_id AND r.g = b.g AND r.s = b.top WHERE b.top >= 50
        GROUP BY b.seq_id, b.g, b.p0, b.top HAVING min(r.pos) - b.p0 + 1 >= 12) z JOIN seqs USING (seq_id))"""
Z_ROWS = motif_rows("zseg", "'Z-DNA'", "'Z-DNA'", "top")

RLFS = {
    "m1": tok("m1", "G{3,}[ACGT]{1,10}?G{3,}(?:[ACGT]{1,10}?G{3,})+"),
    "m2": tok("m2", "G{4,}(?:[ACGT]{1,10}?G{4,})+"),
}
ZONES = """zones AS (SELECT seq_id, start_pos, end_pos, 'm1' AS model, motif AS riz FROM m1
      UNION ALL SELECT seq_id, start_pos, end_pos, 'm2', motif FROM m2)"""
REZ = """rest AS (SELECT z.*, substr(sequence, end_pos + 1, 2000) AS rest FROM zones z JOIN seqs USING (seq_id) WHERE length >= 100),
    wins AS (SELECT *, substr(rest, a * 25 + 1, (b - a) * 25) AS rez FROM (
        SELECT *, unnest(generate_series(a + 2, length(rest) // 25)) AS b FROM (
          SELECT *, unnest(generate_series(0, length(rest) // 25 - 2)) AS a FROM rest))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id, start_pos, end_pos, model ORDER BY gc DESC, a, b) AS k
      FROM (SELECT *, length(rez) - length(translate(rez, 'GC', '')) AS gc FROM wins) WHERE gc * 2 >= length(rez)),
    rl AS (SELECT seq_id, start_pos, end_pos + b * 25 AS end_pos, riz, rez, riz || rez AS motif FROM ranked
      WHERE k = 1 AND length(riz) + length(rez) >= 100)"""
RL_SCORE = (
    f"((({frac('motif', 'GC')} * 50 + {n_re('motif', 'G{3,}')} * 10) * pow(length(motif), 0.25)) + "
    f"{runs_sum('motif', 'G', 'C', HUNTER)} * (1 + {frac('motif', 'GC')} + 0.05 * {n_re('motif', 'G{3,}')})) / 2"
)
RL_ROWS = (
    f"SELECT seq_id, start_pos, CAST(end_pos AS INT) AS end_pos, 'R-loop' AS class, 'R-loop' AS subtype, "
    f"length(motif) AS length, motif AS sequence, round({RL_SCORE}, 6) AS score, "
    "'RIZ=' || length(riz) || ';REZ=' || length(rez) AS detail, '' AS spacer FROM rl"
)

G4RUN = tok("g4run", FOUR_RUNS) + f""",
    g4four AS (SELECT seq_id, start_pos, end_pos, motif, mean, CASE kind WHEN 1 THEN 'Bulged G4' WHEN 2 THEN 'Canonical G4'
        WHEN 3 THEN 'Relaxed G4' ELSE 'Imperfect G4' END AS subtype FROM (
      SELECT *, CASE WHEN regexp_matches(motif, 'GG[ACT]GG') AND len(list_filter(r, lambda x: x >= 3)) >= 2 THEN 1
          WHEN list_min(r) >= 3 AND list_max(l) <= 7 THEN 2 WHEN list_min(r) >= 3 AND list_max(l) <= 12 THEN 3
          WHEN list_min(r) = 2 AND list_max(r) = 2 AND list_max(l) <= 12 THEN 4
          WHEN list_min(r) >= 2 AND list_max(l) <= 12 THEN 5 END AS kind FROM (
        SELECT *, m0 * CASE WHEN list_contains(l, 1) THEN 0.75 WHEN list_min(l) >= 2 AND list_max(l) <= 4 THEN 1.1
            WHEN list_max(l) > 12 THEN 0.5 ELSE 1.0 END AS mean FROM (
          SELECT *, {g4mean('motif')} AS m0, {lens('motif', 'G+')}[1:4] AS r, {lens('motif', '[ACT]+')}[1:3] AS l
          FROM g4run) WHERE len(r) >= 4) WHERE mean >= 1.2) WHERE kind IS NOT NULL)"""
G4BI = tok("bip", BIPARTITE) + f", g4bi AS (SELECT *, {g4mean('motif')} AS mean FROM bip WHERE {g4mean('motif')} >= 1.2)"
G4MULTI = tok("tand", TANDEM) + f""",
    g4multi AS (SELECT * FROM (SELECT *, {g4mean('motif')} AS mean FROM (
      SELECT e.seq_id, e.start_pos, e.end_pos, substr(sequence, e.start_pos, e.end_pos - e.start_pos + 1) AS motif FROM (
        SELECT seq_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (
          SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY start_pos) AS g FROM (
            SELECT *, CASE WHEN start_pos - 1 - lag(end_pos) OVER (PARTITION BY seq_id ORDER BY start_pos) <= 20 THEN 0 ELSE 1 END AS new
            FROM tand)) GROUP BY seq_id, g) e JOIN seqs USING (seq_id))) WHERE mean >= 1.2)"""
G4TRI = tok("tri", TRIPLEX) + f""",
    g4tri AS (SELECT * EXCLUDE (r, l) FROM (SELECT *, {g4mean('motif')} AS mean, {lens('motif', 'G+')}[1:3] AS r,
        {lens('motif', '[ACT]+')}[1:2] AS l FROM tri) WHERE len(r) >= 3 AND list_min(r) >= 3 AND list_max(l) <= 15 AND mean >= 1.5)"""
G4ALL = """g4all AS (SELECT *, length(motif) AS length, mean AS score FROM (
      SELECT seq_id, start_pos, end_pos, motif, mean, subtype FROM g4four
      UNION ALL SELECT seq_id, start_pos, end_pos, motif, mean, 'Bipartite G4' FROM g4bi
      UNION ALL SELECT seq_id, start_pos, end_pos, motif, mean, 'Multimeric G4' FROM g4multi
      UNION ALL SELECT seq_id, start_pos, end_pos, motif, mean, 'G-Triplex intermediate' FROM g4tri))"""
G4_RANK = (
    "list_position(['Multimeric G4','Canonical G4','Relaxed G4','Bulged G4','Bipartite G4','Imperfect G4',"
    "'G-Triplex intermediate'], subtype)"
)


def window_score(source: str, key: str, text: str) -> str:
    """Largest centred 25-base mean of the C-positive ramp, one row per key."""
    return f"""SELECT {key}, max(m) AS mean FROM (
        SELECT {key}, avg(v) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS m FROM (
          SELECT {key}, pos, CASE b WHEN 'C' THEN 1 WHEN 'G' THEN -1 ELSE 0 END
              * least(4, row_number() OVER (PARTITION BY {key}, b, grp ORDER BY pos)) AS v FROM (
            SELECT *, pos - row_number() OVER (PARTITION BY {key}, b ORDER BY pos) AS grp FROM (
              SELECT {key}, unnest(string_split({text}, '')) AS b, unnest(generate_series(1, length({text}))) AS pos
              FROM {source})))) GROUP BY {key}"""


IMOTIF = tok("iseed", SEED) + f""",
    icut AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (
      SELECT seq_id, start_pos, start_pos + length(motif) - 1 AS end_pos, motif, l FROM (
        SELECT seq_id, start_pos, array_to_string(p[1:7], '') AS motif, list_transform([p[1], p[3], p[5], p[7]], lambda x: length(x)) AS r,
               list_transform([p[2], p[4], p[6]], lambda x: length(x)) AS l
        FROM (SELECT *, regexp_extract_all(motif, 'C+|[AGT]+') AS p FROM iseed) WHERE len(p) >= 7)
      WHERE list_min(r) >= 3 AND list_max(l) <= 12)),
    imean AS ({window_score('icut', 'id', 'motif')}),
    icand AS (SELECT *, mean * greatest(1, factor) AS score FROM (
      SELECT c.seq_id, c.start_pos, CAST(c.end_pos AS INT) AS end_pos, c.motif, m.mean,
        CASE WHEN list_max(l) <= 7 AND mean >= 0.45 THEN 'Canonical i-motif' WHEN list_max(l) > 7 AND mean >= 0.3 THEN 'Relaxed i-motif' END AS subtype,
        greatest(0.1, 1 + 0.1 * greatest(0, {n_re('c.motif', 'C{3,}')} - 4)
          + CASE WHEN list_sum(l) / 3.0 <= 7 THEN 0.15 WHEN list_sum(l) / 3.0 <= 12 THEN 0.05 ELSE -0.1 END) AS factor
      FROM icut c JOIN imean m USING (id)) WHERE subtype IS NOT NULL)"""
AC_SCORE = (
    f"(length(motif) * {frac('motif', 'AC')} * 0.3 + 1.5 * ({n_re('motif', 'A{3,}')} + {n_re('motif', 'C{3,}')}) + "
    f"{n_re('motif', '(?:AC|CA){3,}')})"
)
AC = ",\n".join(tok(f"ac{i}", p) for i, p in enumerate(AC_PATTERNS, 1)) + f""",
    accand AS (SELECT *, {AC_SCORE} AS score, length(motif) AS length, 'AC-motif' AS subtype FROM (
      SELECT *, 1 AS p FROM ac1 UNION ALL SELECT *, 2 FROM ac2 UNION ALL SELECT *, 3 FROM ac3)
      WHERE length(motif) >= 15 AND contains(motif, 'CCC') AND {frac('motif', 'AC')} >= 0.6 AND {AC_SCORE} >= 10)"""

# --- disease --------------------------------------------------------------------------------

UNITS = disease.units()
DRUNS = ",\n".join(tok(f"u{i}", "(?:%s){3,}" % u) for i, u in enumerate(UNITS)) + ",\n    druns AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT seq_id, '{u}' AS repeat_unit, start_pos, end_pos, motif, CAST(length(motif) // {len(u)} AS INT) AS repeat_count FROM u{i}"
    for i, u in enumerate(UNITS)
) + ")"
_quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
DDIM = "ddim AS (SELECT * FROM (VALUES {}) t({}))".format(
    ", ".join("(" + ", ".join(_quote(v) for v in d.values()) + ")" for d in disease.disorders()),
    ", ".join(disease.disorders()[0]),
)
PDIM = "pdim AS (SELECT * FROM (VALUES {}) t(repeat_type, pop_mean, pop_std, p95))".format(
    ", ".join(f"('{k}', {m}, {s}, {p})" for k, m, s, p in disease.POPULATION)
)


def lookup(rows: list[tuple]) -> str:
    """CASE branches by repeat type and, where a row has a number, the copies above which it holds."""
    return " ".join(
        f"WHEN repeat_type = '{kind}'" + "".join(f" AND repeat_count > {n}" for n in least) + f" THEN '{text}'"
        for kind, *least, text in rows)


def disease_sql(gene: bool) -> str:
    same = "upper(gene_symbol) = upper(gene)" if gene else "false"
    return DRUNS + ",\n" + DDIM + ",\n" + PDIM + f""",
    dmatch AS (SELECT *, row_number() OVER (PARTITION BY seq_id, repeat_unit, start_pos
        ORDER BY CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN dim_order END NULLS LAST, ms DESC, disease_id DESC) AS k FROM (
      SELECT *, coalesce({same}, false) AS same,
        CASE WHEN repeat_count >= threshold THEN 100 WHEN repeat_count >= threshold * 0.8 THEN 50 WHEN repeat_count > normal_max THEN 25 ELSE 0 END
        + CASE WHEN threshold <= 50 THEN 10 WHEN threshold > 200 THEN -20 ELSE 0 END
        + CASE WHEN disease_id = 'huntington' AND repeat_count BETWEEN 36 AND 100 THEN 30
               WHEN disease_id = 'fragile_x' AND repeat_count > 200 THEN 50 WHEN disease_id = 'fragile_x' AND repeat_count >= 55 THEN 30
               WHEN disease_id = 'friedreich_ataxia' AND repeat_count >= 66 THEN 50 ELSE 0 END AS ms
      FROM druns JOIN ddim USING (repeat_unit) JOIN (SELECT seq_id, gene FROM seqs) USING (seq_id)) WHERE same OR ms > 0),
    dis AS MATERIALIZED (SELECT *, CASE clinical_significance
          WHEN 'Pathogenic' THEN 'Pathogenic variant - confirm diagnosis, family screening recommended, ' || inheritance || ' inheritance'
          WHEN 'Likely Pathogenic' THEN 'Likely pathogenic - consider clinical confirmation, ' || inheritance || ' inheritance'
          ELSE 'Variant of uncertain significance - monitor research updates, consider family studies' END AS genetic_counseling FROM (
      SELECT seq_id, gene, start_pos, end_pos, motif, repeat_unit, repeat_type, repeat_count, disease_id, disease_name, gene_symbol, inheritance,
        clinical_features, pmids,
        normal_min || '-' || normal_max AS normal_range, threshold,
        CASE WHEN repeat_count >= threshold THEN 'Pathogenic' WHEN repeat_count > normal_max AND repeat_count >= threshold * 0.8 THEN 'Likely Pathogenic'
             WHEN repeat_count > normal_max THEN 'Variant of Uncertain Significance' ELSE 'Benign' END AS clinical_significance,
        CASE WHEN repeat_count <= normal_max THEN 0.0 WHEN repeat_count >= threshold THEN least(100.0, 85 + (repeat_count - threshold) * 2.5)
             ELSE 15 + (repeat_count - normal_max) / CAST(threshold - normal_max AS DOUBLE) * 70 END :: DOUBLE AS risk_score,
        least(100, length(motif) * 0.1 + {frac('motif', 'GC')} * 20 + 30.0 * (
          SELECT count(*) FILTER (motif[i] = motif[(i - 1) % 3 + 1]) FROM unnest(generate_series(1, length(motif) // 3 * 3)) u(i)) / length(motif)) AS instability_score,
        CASE WHEN pop_mean IS NULL THEN 50 ELSE greatest(0, least(100, 50 + (repeat_count - pop_mean) / pop_std * 50 / 3)) END :: DOUBLE AS population_percentile,
        CASE WHEN repeat_count < threshold THEN 'No specific targets identified' {lookup(disease.THERAPY)} ELSE 'No specific targets identified' END AS therapeutic_target,
        100 * (0.4 * {frac('motif', 'GC')} + 0.6 * len(list_distinct(string_split(motif[1:9], ''))) / 9.0) AS conservation_score,
        CASE {lookup(disease.STRUCTURAL_IMPACT)} ELSE 'Minimal structural impact predicted' END AS structural_impact
      FROM dmatch LEFT JOIN pdim USING (repeat_type) WHERE k = 1) WHERE clinical_significance <> 'Benign')"""


# --- repeats: slipped, cruciform, mirror ----------------------------------------------------

# Strings of 2, 4, ... bases as numbers, put together from the numbers of their halves: f forward, m mirrored.
KMERS = """bases AS MATERIALIZED (
      SELECT seq_id, CAST(unnest(generate_series(1, length)) AS INT) AS pos,
        CAST(strpos('ACGT', unnest(string_split(sequence, ''))) - 1 AS BIGINT) AS c FROM seqs),
    two AS (SELECT *, c * 4 + lead(c) OVER w AS f2, lead(c) OVER w * 4 + c AS m2, lead(c, 2) OVER w AS c3 FROM bases
      WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
    four AS (SELECT seq_id, pos, c, f2 * 4 + c3 AS f3, c3 * 16 + m2 AS m3, f2 * 16 + lead(f2, 2) OVER w AS f4,
        lead(m2, 2) OVER w * 16 + m2 AS m4 FROM two WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
    eight AS (SELECT *, f4 * 256 + lead(f4, 4) OVER w AS f8, lead(m4, 4) OVER w * 256 + m4 AS m8 FROM four
      WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
    kmers AS MATERIALIZED (SELECT seq_id, pos, c, f8 * 64 + lead(f3, 8) OVER w AS f11, lead(m3, 8) OVER w * 65536 + m8 AS m11,
        f8 * 256 + lead(f4, 8) OVER w AS f12, lead(m4, 8) OVER w * 65536 + m8 AS m12, f8 * 65536 + lead(f8, 8) OVER w AS f16
      FROM eight WINDOW w AS (PARTITION BY seq_id ORDER BY pos))"""


def common(a: str, b: str, most: int) -> str:
    """How many letters two texts share from their beginning, `most` at most."""
    steps = ", ".join(str(1 << i) for i in range(most.bit_length() - 1, -1, -1))
    return (
        f"least({most}, list_reduce([0, {steps}], lambda x, b: CASE WHEN substr({a}, x + 1, b) = substr({b}, x + 1, b) "
        f"AND length(substr({a}, x + 1, b)) = b THEN x + b ELSE x END))"
    )


def arms(name: str, k: int, spacers: int, code: str, other: str, right: str) -> str:
    """Inner ends of the left arm with a spacer, and how far both arms match outward: 100 at most."""
    leads = ", ".join(f"lead({code}, {k + s}) OVER w" for s in range(spacers + 1))
    return f"""{name}_s AS (SELECT seq_id, pos + {k - 1} AS inner_end, unnest(list_filter(generate_series(0, {spacers}),
          lambda s: r[s + 1] = {other})) AS spacer FROM (
        SELECT *, [{leads}] AS r FROM kmers WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE list_contains(r, {other})),
    {name} AS MATERIALIZED (SELECT seq_id, inner_end, CAST(spacer AS INT) AS spacer, lft, {common('lft', 'rgt', 100)} AS reach FROM (
        SELECT a.*, reverse(substr(sequence, greatest(1, inner_end - 99), least(100, inner_end))) AS lft,
          {right.format('substr(sequence, CAST(inner_end + spacer + 1 AS BIGINT), 100)')} AS rgt FROM {name}_s a JOIN seqs USING (seq_id)))"""


IR_SCORE = """(CASE WHEN arm >= 100 THEN 8 WHEN arm >= 70 THEN 7 WHEN arm >= 50 THEN 6 WHEN arm >= 30 THEN 5 WHEN arm >= 20 THEN 4
      WHEN arm >= 15 THEN 3 WHEN arm >= 12 THEN 2 ELSE 1 END + CASE WHEN length >= 60 THEN 2 WHEN length >= 40 THEN 1 ELSE 0 END
      - CASE WHEN spacer >= 4 THEN 2 WHEN spacer >= 1 THEN 1 ELSE 0 END)"""
INVERTED = arms("irarms", 12, 5, "m12", "16777215 - f12", "translate({}, 'ACGT', 'TGCA')") + f""",
    ircand AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, CAST(start_pos + length - 1 AS INT) AS end_pos,
        row_number() OVER (PARTITION BY seq_id, start_pos ORDER BY arm DESC, spacer) AS k FROM (
          SELECT *, CAST({IR_SCORE} AS DOUBLE) AS score FROM (
            SELECT seq_id, CAST(inner_end - arm + 1 AS INT) AS start_pos, CAST(arm AS INT) AS arm, spacer, CAST(2 * arm + spacer AS INT) AS length
            FROM (SELECT *, unnest(generate_series(12, reach)) AS arm FROM irarms))) WHERE score >= 2) WHERE k = 1)"""
IR = greedy("irsel", "ircand", "score DESC, length DESC, start_pos, end_pos", True) + """,
    irtext AS (SELECT i.*, substr(sequence, start_pos, end_pos - start_pos + 1) AS motif FROM irsel i JOIN seqs USING (seq_id))"""
IR_ROWS = motif_rows("irtext", "'Cruciform DNA'", "'Cruciform DNA [IR]/HairPin [IR]'", "score", "'Arms=' || arm", "CAST(spacer AS VARCHAR)")

MIRROR = arms("mrarms", 11, 12, "m11", "f11", "{}") + f""",
    mrcand AS (SELECT *, arm * (1 + 1.5 * purity) - 0.8 * spacer + CASE WHEN length >= 50 THEN 1 ELSE 0 END AS score FROM (
        SELECT seq_id, CAST(inner_end - arm + 1 AS INT) AS start_pos, CAST(inner_end + spacer + arm AS INT) AS end_pos, arm, spacer,
          2 * arm + spacer AS length, greatest({frac('lft[1:arm]', 'AG')}, {frac('lft[1:arm]', 'CT')}) AS purity
        FROM (SELECT *, unnest(generate_series(11, reach)) AS arm FROM mrarms)) WHERE purity >= 0.9 AND length >= 25),
    mrbest AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, start_pos, end_pos ORDER BY round(score, 6) DESC, arm DESC) AS k
        FROM mrcand WHERE score >= 25) WHERE k = 1)"""
HDNA = greedy("hdsel", "mrbest", "round(score, 6) DESC, length DESC, start_pos, end_pos", True) + """,
    hdtext AS (SELECT h.*, substr(sequence, start_pos, end_pos - start_pos + 1) AS motif FROM hdsel h JOIN seqs USING (seq_id))"""
HDNA_ROWS = motif_rows("hdtext", "'Triplex'", "'Triplex'", "score", "'Arms=' || arm", "CAST(spacer AS VARCHAR)")

# Runs of text[i] = text[i + d], then every start with one copy, a spacer and another.
DIRECT_SCORE = """(greatest(2.0, 8.0 / unit) + least(copies * 2.5, 12.0) + CASE WHEN length >= 100 THEN 4 WHEN length >= 50 THEN 3
      WHEN length >= 30 THEN 2 WHEN length >= 20 THEN 1 ELSE 0 END - spacer * 0.3)"""
DIRECT = f"""rep16 AS (SELECT seq_id, f16, pos FROM (SELECT *, count(*) OVER (PARTITION BY seq_id, f16) AS n FROM kmers WHERE f16 IS NOT NULL) WHERE n > 1),
    pair16 AS (SELECT a.seq_id, a.pos, b.pos - a.pos AS d FROM rep16 a JOIN rep16 b ON a.seq_id = b.seq_id AND a.f16 = b.f16
      AND b.pos BETWEEN a.pos + 8 AND a.pos + 303),
    eqruns AS MATERIALIZED (SELECT seq_id, d, min(pos) AS s, max(pos) + 16 AS stop FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY seq_id, d ORDER BY pos) AS g FROM pair16) GROUP BY seq_id, d, g),
    plain AS (SELECT seq_id, i AS place, d AS unit, 0 AS spacer, d + stop - i AS length FROM (
        SELECT *, unnest(generate_series(s, stop - d)) AS i FROM eqruns WHERE d <= 300 AND stop - s >= d)),
    spaced AS (SELECT seq_id, i AS place, d - spacer AS unit, spacer, 2 * d - spacer + {common('one', 'third', 1023)} AS length FROM (
        SELECT x.*, substr(sequence, i, 1024) AS one, substr(sequence, i + 2 * d - spacer, 1024) AS third FROM (
          SELECT *, unnest(generate_series(CASE WHEN d > 300 THEN s ELSE greatest(s, stop - d + 1) END, stop - d + spacer)) AS i FROM (
            SELECT *, unnest([1, 2, 3]) AS spacer FROM eqruns) WHERE d - spacer BETWEEN 24 AND 300) x JOIN seqs USING (seq_id))),
    drcand AS MATERIALIZED (SELECT seq_id, CAST(place AS INT) AS start_pos, CAST(unit AS INT) AS unit, CAST(spacer AS INT) AS spacer,
        CAST(length AS INT) AS length, copies, CAST(score AS DOUBLE) AS score, CAST(place + length - 1 AS INT) AS end_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY seq_id, place ORDER BY unit DESC, spacer, length DESC) AS k FROM (
          SELECT *, CAST({DIRECT_SCORE} AS DOUBLE) AS score FROM (
            SELECT *, CAST(CASE WHEN spacer = 0 THEN length // unit ELSE 2 END AS INT) AS copies FROM (
              SELECT * FROM plain UNION ALL SELECT * FROM spaced))) WHERE score >= 10 - 1e-9) WHERE k = 1)"""

# Every place where a unit of 1 to 6 bases repeats for 15 bases, the shortest unit first; a fold takes the next place
# behind the repeat before it.
STR_SCORE = """([4.0, 3.0, 2.5, 2.0, 1.5, 1.0][unit] + least(copies * 1.5, 12.0) + CASE WHEN length >= 100 THEN 3
      WHEN length >= 50 THEN 2 WHEN length >= 30 THEN 1 ELSE 0 END)"""
STR = """eqstep AS (SELECT seq_id, pos, unnest(list_filter([1, 2, 3, 4, 5, 6], lambda u: r[u] = c)) AS unit FROM (
        SELECT *, [lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w, lead(c, 6) OVER w] AS r
        FROM bases WINDOW w AS (PARTITION BY seq_id ORDER BY pos))),
    periods AS (SELECT * FROM (SELECT seq_id, pos, unit, max(pos) OVER (PARTITION BY seq_id, unit, g) - pos + 1 + unit AS k FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY seq_id, unit ORDER BY pos) AS g FROM eqstep))
      WHERE k >= 15 AND k // unit >= [6, 5, 4, 3, 3, 3][unit]),
    tandem_at AS (SELECT seq_id, pos, arg_min(k, unit) AS k, min(unit) AS unit FROM periods JOIN seqs USING (seq_id)
      WHERE unit <> 3 OR substr(sequence, pos, 3) NOT IN ('GAA', 'TTC', 'AAG', 'AGG', 'GGA', 'TCT', 'CTC', 'CTT')
        OR NOT regexp_matches(substr(sequence, pos, 50), 'GAAGAA|TTCTTC') GROUP BY seq_id, pos),
    tandem_fold AS (SELECT seq_id, unnest(list_reduce(
        list_prepend({'s': CAST(0 AS INT), 'e': CAST(0 AS BIGINT), 'sel': CAST([] AS INT[])},
          list({'s': pos, 'e': CAST(pos + k - 1 AS BIGINT), 'sel': CAST([] AS INT[])} ORDER BY pos)),
        lambda a, x: CASE WHEN x.s > a.e THEN {'s': x.s, 'e': x.e, 'sel': list_append(a.sel, x.s)} ELSE a END).sel) AS pos
      FROM tandem_at GROUP BY seq_id),""" + f"""
    strcand AS MATERIALIZED (SELECT * FROM (SELECT *, CAST({STR_SCORE} AS DOUBLE) AS score FROM (
        SELECT seq_id, CAST(pos AS INT) AS start_pos, CAST(pos + k - 1 AS INT) AS end_pos, CAST(unit AS INT) AS unit, CAST(k AS INT) AS length, CAST(k // unit AS INT) AS copies
        FROM tandem_fold JOIN tandem_at USING (seq_id, pos))) WHERE score >= 10 - 1e-9)"""
STR_TEXT = """strtext AS (SELECT t.*, substr(sequence, start_pos, end_pos - start_pos + 1) AS motif FROM strcand t JOIN seqs USING (seq_id))"""


def str_rows(source: str) -> str:
    return motif_rows(source, "'Slipped DNA'", "'Slipped DNA [STR]'", "score", "'Unit=' || motif[1:unit] || ';Copies=' || copies")


SLIPPED = """slboth AS (SELECT seq_id, start_pos, end_pos, score, unit, copies, spacer, 0 AS kind FROM drcand
      UNION ALL SELECT seq_id, start_pos, end_pos, score, unit, copies, 0, 1 FROM strcand),
    """ + greedy("slsel", "slboth", "round(score, 6) DESC, kind, start_pos, end_pos", False) + """,
    sltext AS (SELECT t.*, substr(sequence, start_pos, end_pos - start_pos + 1) AS motif FROM slsel t JOIN seqs USING (seq_id))"""
SLIPPED_ROWS = motif_rows(
    "(SELECT * FROM sltext WHERE kind = 0)", "'Slipped DNA'", "'Slipped DNA [Direct Repeat]'", "score",
    "'UnitLen=' || unit || ';Copies=' || copies", "CAST(spacer AS VARCHAR)",
) + " UNION ALL " + str_rows("(SELECT * FROM sltext WHERE kind = 1)")
REPEAT_PARTS = [KMERS, INVERTED, IR, MIRROR, HDNA, DIRECT, STR, SLIPPED]

# --- the core motif set ---------------------------------------------------------------------

# Each class as its own query has it: common table expressions, then rows.
CURVED_PARTS = [
    TRACTS, CHAINS, LONG_TRACTS, f"both_kinds AS (SELECT *, score AS raw FROM ({GCURVE} UNION ALL {LCURVE}))",
    greedy("curved", "both_kinds", "raw DESC, subtype, start_pos, end_pos", False),
]
CURVED_ROWS = "SELECT * EXCLUDE (raw) FROM curved"
RLOOP_PARTS = [RLFS["m1"], RLFS["m2"], ZONES, REZ]
G4_PARTS = [G4RUN, G4BI, G4MULTI, G4TRI, G4ALL, greedy("g4sel", "g4all", f"{G4_RANK}, {BEST}", True)]
G4_ROWS = motif_rows("g4sel", "'G-Quadruplex Family'", "subtype", "mean")
IMOTIF_PARTS = [
    IMOTIF, "iall AS (SELECT *, length(motif) AS length FROM icand)", greedy("isel", "iall", "subtype, " + BEST, True),
]
IMOTIF_ROWS = motif_rows("isel", "'i-motif family'", "subtype", "score")
AC_PARTS = [AC, greedy("asel", "accand", "p, start_pos", True)]
AC_ROWS = motif_rows(
    "asel", "'i-motif family'", "subtype", "score",
    f"'A3=' || {n_re('motif', 'A{3,}')} || ';C3=' || {n_re('motif', 'C{3,}')}",
)
DISEASE_ROWS = motif_rows(
    "dis", "'Disease-Associated Motif'", "replace(disease_name, ' ', '_') || '_repeat'", "risk_score",
)
_PARTS = [*CURVED_PARTS, STICKY, EGZ, ZSEG, *RLOOP_PARTS, *G4_PARTS, *IMOTIF_PARTS, *AC_PARTS, disease_sql(False)]
_ROWS = [CURVED_ROWS, STICKY_ROWS, EGZ_ROWS, Z_ROWS, RL_ROWS, G4_ROWS, IMOTIF_ROWS, AC_ROWS, DISEASE_ROWS]


def all_rows(parts: list[str], rows: list[str]) -> str:
    """The motif rows of several classes; copy_no tells apart rows that are equal in place, class and subtype."""
    return ",\n".join(parts) + (
        ",\n    core AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_id, start_pos, end_pos, class, subtype ORDER BY score) AS copy_no FROM ("
        + " UNION ALL BY NAME ".join(f"(SELECT * FROM ({r}))" for r in rows) + "))")


CORE = all_rows(_PARTS, _ROWS)
DETECTED = all_rows([*_PARTS, *REPEAT_PARTS], [*_ROWS, IR_ROWS, HDNA_ROWS, SLIPPED_ROWS])


def on_core(body: str, *ctes: str) -> str:
    """A query on the rows of all detectors."""
    return sql(body, DETECTED, *ctes)


def r6(*names: str) -> str:
    """Rounded columns; a minus zero becomes zero."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


MERGE = """{name} AS MATERIALIZED (SELECT *, max(CASE WHEN reach IS NULL OR start_pos > reach THEN start_pos END) OVER (
        PARTITION BY seq_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS region FROM (
      SELECT *, max(end_pos) OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM {source}))"""
HOT = """hot_in AS MATERIALIZED (SELECT w.seq_id, w.w, c.class, c.subtype, c.score FROM (
        SELECT seq_id, unnest(generate_series(0, length - 100, 25)) AS w FROM seqs WHERE length >= 100) w
      JOIN core c ON c.seq_id = w.seq_id AND c.start_pos <= w.w + 100 AND c.end_pos >= w.w + 1),
    hot AS MATERIALIZED (SELECT seq_id, CAST(w + 1 AS INT) AS start_pos, CAST(w + 100 AS INT) AS end_pos, motif_count, class_diversity, subclass_diversity,
        subtype_diversity, CAST(10 * class_diversity + 5 * subclass_diversity + 2 * subtype_diversity AS DOUBLE) AS diversity_score,
        s + 10 * class_diversity + 5 * subclass_diversity + 2 * subtype_diversity AS score,
        CASE WHEN class_diversity >= 5 THEN 'High' WHEN class_diversity >= 3 THEN 'Moderate' ELSE 'Low' END AS complexity FROM (
      SELECT seq_id, w, count(*) AS motif_count, count(DISTINCT class) AS class_diversity, count(DISTINCT class || ':' || subtype) AS subclass_diversity,
        count(DISTINCT subtype) AS subtype_diversity, sum(score) AS s FROM hot_in GROUP BY seq_id, w HAVING count(*) >= 3))"""
HOT_MERGED = MERGE.format(name="hotr", source="hot") + """,
    hotk AS (SELECT r.seq_id, r.region, i.class, i.subtype, count(*) AS n FROM hotr r JOIN hot_in i ON i.seq_id = r.seq_id AND i.w + 1 = r.start_pos GROUP BY ALL),
    hotc AS (SELECT seq_id, region, count(*) AS class_diversity, string_agg(class || '(' || n || ')', '; ' ORDER BY class) AS class_detail
      FROM (SELECT seq_id, region, class, sum(n) AS n FROM hotk GROUP BY ALL) GROUP BY ALL),
    hots AS (SELECT seq_id, region, count(*) AS subclass_diversity, count(DISTINCT subtype) AS subtype_diversity,
        string_agg(split_part(subtype, ':', 1) || '(' || n || ')', '; ' ORDER BY class || ':' || subtype) AS subclass_detail FROM hotk GROUP BY ALL),
    hotm AS (SELECT seq_id, CAST(region AS INT) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_windows, CAST(sum(motif_count) AS BIGINT) AS motif_count, sum(score) AS score, region
      FROM hotr GROUP BY seq_id, region)"""
HYB = """hk AS MATERIALIZED (SELECT seq_id, class, subtype, copy_no, start_pos, end_pos, length, score FROM core),
    rises AS MATERIALIZED (SELECT m.seq_id, m.start_pos AS pos, m.class, m.subtype, m.end_pos,
        (SELECT count(*) FROM hk k WHERE k.seq_id = m.seq_id AND k.end_pos >= m.start_pos
           AND (k.start_pos, k.class, k.subtype, k.end_pos, k.copy_no) <= (m.start_pos, m.class, m.subtype, m.end_pos, m.copy_no)) AS open_now FROM hk m),
    hraw AS MATERIALIZED (SELECT m.seq_id, m.end_pos, m.start_pos AS own, m.class AS c, m.subtype AS st, m.copy_no AS cn,
        (SELECT max(pos) FROM rises r WHERE r.seq_id = m.seq_id AND r.pos <= m.end_pos AND r.open_now = 2) AS start_pos,
        list({'start_pos': k.start_pos, 'class': k.class, 'subtype': k.subtype}) AS members,
        count(*) AS n_motifs, max(k.length) AS longest, sum(k.score) AS total, list_sort(list(k.class)) AS cl, list_sort(list(k.class || ':' || k.subtype)) AS sl
      FROM hk m JOIN hk k ON k.seq_id = m.seq_id AND k.start_pos <= m.end_pos
        AND (k.end_pos > m.end_pos OR (k.end_pos = m.end_pos AND (k.start_pos, k.class, k.subtype, k.copy_no) >= (m.start_pos, m.class, m.subtype, m.copy_no)))
      GROUP BY ALL HAVING count(DISTINCT k.class) >= 2),
    hlab AS (SELECT *, end_pos - start_pos + 1 AS length,
        'Hybrid_' || array_to_string(list_transform(list_sort(list_distinct(cl)), lambda x: x || '(' || len(list_filter(cl, lambda y: y = x)) || ')'), '_') AS subtype,
        array_to_string(list_transform(list_sort(list_distinct(sl)), lambda x: split_part(x, ':', 2) || '(' || len(list_filter(sl, lambda y: y = x)) || ')'), '; ') AS subclass_detail
      FROM hraw),
    hyb AS MATERIALIZED (SELECT * FROM (SELECT *, max(end_pos) OVER (PARTITION BY seq_id ORDER BY start_pos, length DESC, n_motifs DESC, subtype
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hlab) WHERE reach IS NULL OR end_pos > reach)"""


def sub_groups(names: list[str]) -> str:
    return " + ".join(
        "(CASE WHEN {} THEN 1 ELSE 0 END)".format(" OR ".join(f"list_contains(kinds, '{s}')" for s in clusters.NAMES[n]))
        for n in names
    )


IDIM = "idim AS (SELECT * FROM (VALUES {}) t(sub_a, sub_b, weight))".format(
    ", ".join(f"('{a}', '{b}', {w})" for a, b, w in clusters._pairs(clusters.INTERACTION))
)
PAIRDIM = "pairdim AS (SELECT * FROM (VALUES {}) t(sub_a, sub_b, lev, bonus, fn))".format(
    ", ".join(f"('{a}', '{b}', '{l}', {x}, '{f}')" for a, b, l, x, f in clusters._pairs(clusters.PAIRS))
)
CLW = IDIM + f""",
    clin AS MATERIALIZED (SELECT w.w, c.* FROM (SELECT seq_id, unnest(generate_series(1, length - 500, 250)) AS w FROM seqs WHERE length > 500) w
      JOIN core c ON c.seq_id = w.seq_id AND c.start_pos >= w.w AND c.end_pos <= w.w + 500),
    clk AS (SELECT seq_id, w, sum(n) AS motif_count, list_sort(list(subtype)) AS kinds, -sum(n / t * log2(n / t)) AS diversity_index
      FROM (SELECT seq_id, w, subtype, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY seq_id, w) AS t FROM clin GROUP BY seq_id, w, subtype)
      GROUP BY seq_id, w HAVING sum(n) >= 3),
    cli AS (SELECT seq_id, w, avg(coalesce(weight, 0.3) * (1 - d / 200.0)) AS interaction_score FROM (
        SELECT a.seq_id, a.w, least(a.subtype, b.subtype) AS sub_a, greatest(a.subtype, b.subtype) AS sub_b,
          least(abs(a.start_pos - b.end_pos), abs(b.start_pos - a.end_pos)) AS d
        FROM clin a JOIN clin b ON a.seq_id = b.seq_id AND a.w = b.w AND (a.start_pos, a.end_pos, a.class, a.subtype, a.copy_no) < (b.start_pos, b.end_pos, b.class, b.subtype, b.copy_no))
      LEFT JOIN idim USING (sub_a, sub_b) WHERE d <= 200 GROUP BY seq_id, w),
    clc AS (SELECT seq_id, w, least(1, 0.4 * sum(CASE WHEN gap <= 200 THEN 1 - gap / 200.0 ELSE 0 END) / greatest(1, count(*) - 1)
        + 0.3 * sum(length) / (max(end_pos) - min(start_pos)) + 0.3 * count(DISTINCT subtype) / least(count(*), 7)) AS cooperative_score,
        bool_or(class = '{disease.CLASS}') AS sick FROM (
      SELECT *, lead(start_pos) OVER (PARTITION BY seq_id, w ORDER BY start_pos, end_pos, class, subtype, copy_no) - end_pos AS gap FROM clin) GROUP BY seq_id, w),
    clw AS MATERIALIZED (SELECT seq_id, CAST(w AS INT) AS start_pos, CAST(w + 500 AS INT) AS end_pos, CAST(motif_count AS BIGINT) AS motif_count, kinds,
        diversity_index, coalesce(interaction_score, 0) AS interaction_score, cooperative_score,
        CASE WHEN sick THEN 3 WHEN {sub_groups(clusters.CANCER)} >= 2 THEN 2 WHEN {sub_groups(clusters.REGULATORY)} >= 2 THEN 1 ELSE 0 END AS clinical_level
      FROM clk LEFT JOIN cli USING (seq_id, w) LEFT JOIN clc USING (seq_id, w))"""
HPAIR = PAIRDIM + f""",
    hp0 AS (SELECT a.seq_id, least(a.start_pos, b.start_pos) AS start_pos, greatest(a.end_pos, b.end_pos) AS end_pos, a.subtype AS first_subtype,
        b.subtype AS second_subtype, a.start_pos AS first_start, b.start_pos AS second_start, b.end_pos AS second_end, a.score AS s1, b.score AS s2,
        (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / CAST(least(a.end_pos - a.start_pos, b.end_pos - b.start_pos) AS DOUBLE) AS overlap
      FROM core a JOIN core b ON a.seq_id = b.seq_id AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos
        AND (a.start_pos, a.end_pos, a.class, a.subtype, a.copy_no) < (b.start_pos, b.end_pos, b.class, b.subtype, b.copy_no)),
    hp AS MATERIALIZED (SELECT seq_id, start_pos, end_pos, first_subtype, second_subtype, first_start, second_start, second_end, overlap,
        least(1, (s1 + s2) / 200 + 0.3 * overlap + coalesce(bonus, 0.3)) AS stability,
        CASE WHEN lev = 'high' AND overlap > 0.7 THEN '{clusters.MAJOR}' WHEN lev = 'high' AND overlap > 0.4 THEN '{clusters.SIGNIFICANT}'
          WHEN lev = 'high' THEN '{clusters.ALTERED}' WHEN lev = 'moderate' THEN '{clusters.CHANGED}' ELSE '{clusters.MINOR}' END AS impact,
        coalesce(fn, 'Unknown functional impact') AS function
      FROM hp0 LEFT JOIN pairdim ON sub_a = least(first_subtype, second_subtype) AND sub_b = greatest(first_subtype, second_subtype)
      WHERE overlap >= 0.1)"""

ALIAS_NEW = "alias AS (SELECT * FROM (VALUES {}) t(a, o))".format(
    ", ".join(f"('{k}', '{v}')" for k, v in classify.ALIASES.items())
)
_old = {v: k for k, v in reversed(list(classify.ALIASES.items()))}
ALIAS_OLD = "old AS (SELECT * FROM (VALUES {}) t(o, a))".format(", ".join(f"('{k}', '{v}')" for k, v in _old.items()))
CDIM = "cdim AS (SELECT * FROM (VALUES {}) t(class_no, class, subclass, subclass_no))".format(
    ", ".join(
        f"({no}, '{c}', {_quote(s) if s else 'NULL'}, {i})"
        for no, (c, subs) in enumerate(classify.TAXONOMY.items(), 1) for i, s in enumerate(subs or [None], 1)
    )
)
G4S = ", ".join(f"'{s}'" for s in classify.G4_SUBTYPES)
PER_SEQ = """ps AS MATERIALIZED (SELECT s.*, coalesce(n, 0) AS n_motifs FROM seqs s
      LEFT JOIN (SELECT seq_id, count(*) AS n FROM core GROUP BY seq_id) USING (seq_id))"""
_cat = f"CASE WHEN gc < 40 THEN 'Low GC' WHEN gc <= 55 THEN 'Medium GC' ELSE 'High GC' END"
CMP = PER_SEQ + f""",
    cmp AS MATERIALIZED (SELECT seq_id, name, length, gc, {_cat} AS gc_category, n_motifs, n_motifs / CAST(length AS DOUBLE) * 1000 AS motif_density, {
        ", ".join(f'coalesce(k{i}, 0) AS "{c}_Count", coalesce(k{i}, 0) / CAST(length AS DOUBLE) * 1000 AS "{c}_Density"' for i, c in enumerate(DETECTED_CLASSES))}
      FROM (SELECT *, {frac('sequence', 'GC')} * 100 AS gc FROM ps) LEFT JOIN (SELECT seq_id, {
        ", ".join(f"count(*) FILTER (class = '{c}') AS k{i}" for i, c in enumerate(DETECTED_CLASSES))} FROM core GROUP BY seq_id) USING (seq_id))"""
GENES = PER_SEQ + f""",
    genes AS MATERIALIZED (SELECT seq_id, name, coalesce(gene, 'Unknown') AS gene, length, {frac('sequence', 'GC')} * 100 AS gc, n_motifs,
        coalesce(d, 0) AS n_disease, n_motifs / CAST(length AS DOUBLE) * 1000 AS motif_density FROM ps
      LEFT JOIN (SELECT seq_id, count(*) AS d FROM core WHERE class = '{disease.CLASS}' GROUP BY seq_id) USING (seq_id))"""


def share_sql(by: str, tail: str = "") -> str:
    return on_core(
        f"SELECT {by}, n, round(n * 100.0 / sum(n) OVER (), 6) AS percentage FROM (SELECT {by}, count(*) AS n FROM core GROUP BY {by}) {tail}"
    )


def dist_sql(value: str, by: str) -> str:
    q = lambda p: f"quantile_cont(CAST({value} AS DOUBLE), {p})"
    return on_core(
        f"SELECT {by}, count(*) AS n, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, "
        f"min({value}) AS min, max({value}) AS max, round({q(0.25)}, 6) AS q1, round({q(0.5)}, 6) AS median, round({q(0.75)}, 6) AS q3 "
        f"FROM core GROUP BY {by}"
    )


def dis_q(body: str) -> str:
    return sql(body, disease_sql(True))


def intersections() -> str:
    mask = " | ".join(f"(CASE WHEN bool_or(class = '{c}') THEN {1 << i} ELSE 0 END)" for i, c in enumerate(DETECTED_CLASSES))
    n = len(DETECTED_CLASSES)
    sets = [[i] for i in range(n)] + [[i, j] for i in range(n) for j in range(i + 1, n)] + [
        [i, j, k] for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)
    ]
    values = ", ".join(f"({sum(1 << i for i in s)}, '{' + '.join(DETECTED_CLASSES[i] for i in s)}')" for s in sets)
    return on_core(
        "SELECT classes, CAST(count(*) AS BIGINT) AS bases FROM masks JOIN sets ON (mask & bits) = bits "
        "GROUP BY classes ORDER BY bases DESC, classes LIMIT 15",
        f"masks AS (SELECT seq_id, pos, {mask} AS mask FROM (SELECT seq_id, class, unnest(generate_series(start_pos, end_pos)) AS pos FROM core) GROUP BY seq_id, pos)",
        f"sets AS (SELECT * FROM (VALUES {values}) t(bits, classes))",
    )


def features_sql() -> str:
    """All features from single bases and pairs."""
    t = "sequence"
    gc, n = frac(t, "GC"), "length(sequence)"
    di = lambda p: f"len(list_filter(dn, lambda x: x = '{p}'))"
    from seqspark.functions.features import STACKING

    out = {f"comp_{k}": frac(t, b) for k, b in {"A": "A", "T": "T", "G": "G", "C": "C", "GC": "GC", "AT": "AT", "purine": "AG", "pyrimidine": "CT"}.items()}
    out.update({f"di_{a}{b}": f"{di(a + b)} / CAST({n} - 1 AS DOUBLE)" for a in "ATGC" for b in "ATGC"})
    out.update({f"struct_{k}": v for k, v in {
        "twist": f"36 + ({gc} - 0.5) * 2", "rise": f"3.4 - ({gc} - 0.5) * 0.2", "tilt": "0.0", "roll": "0.0", "slide": "0.0", "shift": "0.0",
        "bendability": f"{frac(t, 'AT')} * 100", "stability": f"{gc} * 100", "groove_width": "22.0",
        "stacking_energy": "(" + " + ".join(f"{di(k)} * ({v})" for k, v in STACKING.items()) + f") / ({n} - 1)"}.items()})
    out.update({f"thermo_{k}": v for k, v in {
        "melting_temp": f"81.5 + 16.6 * log10(0.05) + 41 * {gc} - 675.0 / {n}", "free_energy": f"-10 * {gc}", "enthalpy": f"-79 * {gc}",
        "entropy": f"-222 * {gc}", "salt_effect": "0.114 * ln(0.05)"}.items()})
    rep = " + ".join(
        f"(CASE WHEN {i} <= {n} // 2 AND contains(sequence, repeat(sequence[1:{i}], {n} // {i})) THEN {i} / CAST({n} AS DOUBLE) ELSE 0 END)" for i in range(2, 10))
    pal = f"(SELECT count(*) FROM unnest(generate_series(4, 19)) a(s), unnest(generate_series(1, {n})) b(j) WHERE j + s - 1 <= {n} AND sequence[j:j + s - 1] = reverse(sequence[j:j + s - 1]))"
    rc = "reverse(translate(sequence, 'ACGT', 'TGCA'))"
    same = lambda other, upto: f"(SELECT count(*) FROM unnest(generate_series(1, {upto})) a(j) WHERE sequence[j] = {other}[j])"
    out.update({f"pattern_{k}": v for k, v in {
        "repeat_score": rep, "palindrome_score": f"{pal} / CAST({n} AS DOUBLE)",
        "mirror_score": f"{same('reverse(sequence)', n + ' // 2')} / CAST({n} // 2 AS DOUBLE)",
        "inverted_score": f"{same(rc, n)} / CAST({n} AS DOUBLE)",
        "g_runs": f"CAST({n_re(t, 'G{3,}')} AS DOUBLE)", "c_runs": f"CAST({n_re(t, 'C{3,}')} AS DOUBLE)",
        "alternating": f"len(list_filter(dn, lambda x: x[1] <> x[2])) / CAST({n} - 1 AS DOUBLE)",
        "homopolymer": f"list_max({lens(t, 'A+|C+|G+|T+')}) / CAST({n} AS DOUBLE)"}.items()})
    kinds = f"len(list_distinct(string_split({t}, ''))) / 4.0"
    out.update({"cons_phylogeny": f"{gc} * 0.8 + 0.2", "cons_selection": f"1 - abs({gc} - 0.5) * 2", "cons_constraint": f"least(1.0, {kinds})", "cons_diversity": kinds})
    body = ", ".join(f"round(round(CAST({v} AS DOUBLE), 12), 6) + 0.0 AS {k}" for k, v in out.items())
    return on_core(
        f"SELECT seq_id, start_pos, end_pos, subtype, {body} FROM (SELECT *, list_transform(generate_series(1, length(sequence) - 1), "
        "lambda i: sequence[i:i + 1]) AS dn FROM core)"
    )


def unit_share(u: int) -> str:
    """The part of a sequence that its longest repeat of a unit of `u` bases takes."""
    same = f"array_to_string(list_transform(generate_series(1, length - {u}), lambda i: CASE WHEN sequence[i] = sequence[i + {u}] THEN '1' ELSE '0' END), '')"
    run = f"coalesce(list_max({lens(same, '1+')}), 0)"
    return f"CASE WHEN {u} < length // 2 THEN (1 + {run} // {u}) * {u} / CAST(length AS DOUBLE) ELSE 0 END"


PROB = f"""prob AS MATERIALIZED (SELECT *, CASE WHEN class = 'G-Quadruplex Family' THEN least(1, least(1, 2 * g) + gb + gp + gs)
          WHEN class = 'Z-DNA' THEN least(1, 0.5 * alt + 0.3 * greatest(0, (gc - 0.5) * 2) + 0.2 * zp)
          WHEN class = 'R-loop' THEN least(1, 0.4 * greatest(0, CASE WHEN gc > 0 THEN (2 * g - gc) / gc ELSE 0 END) + 0.3 * g
            + 0.2 * least(1, 0.5 * g) + 0.01 * {n_re('sequence', 'G{3,}')})
          WHEN class = 'Triplex' THEN pur WHEN class = 'Cruciform DNA' THEN least(1, inv)
          WHEN class = 'Slipped DNA' THEN least(1, rep) ELSE 0.5 END AS p FROM (
      SELECT *, {frac('sequence', 'G')} AS g, {frac('sequence', 'GC')} AS gc, {frac('sequence', 'AG')} AS pur,
        CASE WHEN class = 'Cruciform DNA' THEN (SELECT count(*) FROM unnest(generate_series(1, length(sequence))) u(i)
          WHERE sequence[i] = translate(sequence[length(sequence) - i + 1], 'ACGT', 'TGCA')) / CAST(length(sequence) AS DOUBLE) END AS inv,
        CASE WHEN class = 'Slipped DNA' THEN greatest({", ".join(unit_share(u) for u in range(2, 10))}) END AS rep,
        coalesce(list_sum(list_transform(regexp_extract_all(sequence, 'G+'), lambda r: CASE WHEN length(r) BETWEEN 3 AND 7 THEN 0.2 WHEN length(r) >= 8 THEN 0.1 ELSE 0 END)), 0) AS gb,
        CASE WHEN {n_re('sequence', 'G+')} >= 4 THEN 0.3 ELSE 0 END AS gp,
        0.3 * least(1, {count('sequence', 'G')} / (0.3 * length(sequence))) * CASE WHEN length(sequence) < 15 THEN length(sequence) / 15.0
          WHEN length(sequence) <= 40 THEN 1 ELSE 40.0 / length(sequence) END AS gs,
        (SELECT count(*) FROM unnest(generate_series(1, length(sequence) - 1)) u(i) WHERE (sequence[i] IN ('A', 'G')) <> (sequence[i + 1] IN ('A', 'G'))) / CAST(length(sequence) - 1 AS DOUBLE) AS alt,
        ({" + ".join(n_re('sequence', p) for p in ('CG', 'GC', 'CA', 'TG'))}) / CAST(length(sequence) - 1 AS DOUBLE) AS zp
      FROM core))"""


def oracle_sql() -> dict[str, str]:
    gc = frac("sequence", "GC")
    wrapped = "regexp_replace(regexp_replace(sequence, '(.{60})', '\\1\n', 'g'), '\n$', '')"
    out = {
        "seq_stats": sql(
            f"SELECT seq_id, length, round({gc} * 100, 6) AS gc, round({frac('sequence', 'AG')}, 6) AS purine, "
            f"round({frac('sequence', 'CT')}, 6) AS pyrimidine, md5(reverse(translate(sequence, 'ACGT', 'TGCA'))) AS revcomp_md5, "
            f"sequence = reverse(translate(sequence, 'ACGT', 'TGCA')) AS palindrome, md5({wrapped}) AS wrapped_md5 FROM seqs"
        ),
        "hunter_scores": sql(
            f"SELECT seq_id, round({runs_sum('sequence', 'G', 'C', HUNTER)} / length, 6) AS hunter, round({g4mean('sequence')}, 6) AS g4hunter, "
            f"round({AC_SCORE.replace('motif', 'sequence')}, 6) AS ac_score, round({curvature('sequence')}, 6) AS curvature, "
            f"round(1 + {gc} + 0.05 * {n_re('sequence', 'G{3,}')}, 6) AS rloop_factor, "
            f"round(1 + 0.05 * {n_re('sequence', '[AG][CT]')} + 0.1 * {n_re('sequence', 'GC|CG')}, 6) AS zdna_factor FROM seqs"
        ),
        "imotif_windows": sql(f"SELECT seq_id, round(mean, 6) AS score FROM ({window_score('seqs', 'seq_id', 'sequence')})"),
        "base_runs": sql(
            "SELECT seq_id, b AS base, count(*) AS n, sum(n)::BIGINT AS bases, max(n) AS longest, sum(p)::BIGINT AS start_sum FROM ("
            "SELECT seq_id, b, g, count(*) AS n, min(pos) AS p FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, b ORDER BY pos) AS g FROM ("
            "SELECT seq_id, unnest(string_split(sequence, '')) AS b, unnest(generate_series(1, length)) AS pos FROM seqs)) "
            "GROUP BY seq_id, b, g) GROUP BY seq_id, b"
        ),
        "fasta_records": sql(
            "SELECT name AS file, 1::BIGINT AS record_no, 'Sequence_1' AS name, 'Unknown' AS gene_symbol, 'Unknown' AS disease_info, length, md5(sequence) AS md5 FROM seqs "
            "UNION ALL SELECT name, 2, name || '|' || coalesce(gene, '') || '|a > b', coalesce(gene, 'Unknown'), 'a > b', length, md5(sequence) FROM seqs"
        ),
        "guarded_sequences": sql(
            "SELECT seq_id, true AS valid, length, md5(sequence) AS md5 FROM seqs WHERE length > 0 "
            "UNION ALL SELECT seq_id, false, length + 1, md5(sequence || 'N') FROM seqs WHERE sequence IS NOT NULL "
            "UNION ALL SELECT seq_id, false, NULL, NULL FROM seqs, generate_series(1, 2) WHERE sequence IS NULL"
        ),
        "poly_at_tracts": sql("SELECT * FROM long_tracts", LONG_TRACTS),
        "global_curvature": sql(GCURVE, TRACTS, CHAINS),
        "local_curvature": sql(LCURVE, TRACTS, CHAINS, LONG_TRACTS),
        "curved_dna": sql(CURVED_ROWS, *CURVED_PARTS),
        "sticky_dna": sql(STICKY_ROWS, STICKY),
        "egz": sql(EGZ_ROWS, EGZ),
        "zdna_weights": sql(
            "SELECT seq_id, count(*) AS n, sum(weight) AS total, min(weight) AS lowest, sum(pos * weight) AS moment FROM steps GROUP BY seq_id", STEPS
        ),
        "zdna": sql(Z_ROWS, ZSEG),
        "zdna_and_egz": sql(
            "SELECT * EXCLUDE (f) FROM zz", ZSEG, EGZ,
            f"zboth AS (SELECT t.*, CASE WHEN {n_re('s.sequence', 'CGG')} / CAST(greatest(1, s.length // 3) AS DOUBLE) > 0.5 THEN "
            f"t.subtype = 'Z-DNA' ELSE t.subtype <> 'Z-DNA' END AS f FROM ({Z_ROWS} UNION ALL {EGZ_ROWS}) t JOIN seqs s USING (seq_id))",
            greedy("zz", "zboth", "f, " + BEST, True),
        ),
        "rlfs_zones": sql("SELECT * FROM zones", RLFS["m1"], RLFS["m2"], ZONES),
        "rloops": sql(RL_ROWS, *RLOOP_PARTS),
        "g4_four_run": sql("SELECT seq_id, start_pos, end_pos, motif, round(mean, 6) AS mean, subtype FROM g4four", G4RUN),
        "g4_bipartite": sql("SELECT * REPLACE (round(mean, 6) AS mean) FROM g4bi", G4BI),
        "g4_multimeric": sql("SELECT * REPLACE (round(mean, 6) AS mean) FROM g4multi", G4MULTI),
        "g4_triplex": sql("SELECT * REPLACE (round(mean, 6) AS mean) FROM g4tri", G4TRI),
        "g4_family": sql(G4_ROWS, *G4_PARTS),
        "imotif_candidates": sql("SELECT seq_id, start_pos, end_pos, motif, subtype, " + r6("mean", "factor", "score") + " FROM icand", IMOTIF),
        "imotifs": sql(IMOTIF_ROWS, *IMOTIF_PARTS),
        "ac_motifs": sql(AC_ROWS, *AC_PARTS),
        "disease_runs": sql("SELECT * FROM druns", DRUNS),
        "disease_repeats": dis_q(
            "SELECT * EXCLUDE (motif, repeat_type) REPLACE (" + r6("risk_score", "instability_score", "population_percentile", "conservation_score") + ") FROM dis"
        ),
        "core_motifs": sql("SELECT * EXCLUDE (copy_no) FROM core", CORE),
        "all_detectors": on_core("SELECT * EXCLUDE (copy_no) FROM core"),
        "direct_repeats": sql("SELECT * REPLACE (round(score, 6) AS score) FROM drcand", KMERS, DIRECT),
        "str_repeats": sql(str_rows("strtext"), KMERS, STR, STR_TEXT),
        "slipped_dna": sql(SLIPPED_ROWS, KMERS, DIRECT, STR, SLIPPED),
        "cruciform_candidates": sql("SELECT * FROM ircand", KMERS, INVERTED),
        "cruciform": sql(IR_ROWS, KMERS, INVERTED, IR),
        "hdna": sql(HDNA_ROWS, KMERS, MIRROR, HDNA),
        "g4_priority": on_core(
            f"SELECT seq_id, start_pos, end_pos, class, subtype, score FROM core c WHERE class <> 'G-Quadruplex Family' OR {G4_RANK} = (SELECT min({G4_RANK}) "
            "FROM core k WHERE k.class = c.class AND k.seq_id = c.seq_id AND k.start_pos = c.start_pos AND k.end_pos = c.end_pos)"
        ),
        "hotspot_windows": on_core("SELECT * REPLACE (round(score, 6) AS score) FROM hot", HOT),
        "hotspots": on_core(
            "SELECT seq_id, start_pos, end_pos, end_pos - start_pos + 1 AS length, n_windows, motif_count, class_diversity, subclass_diversity, subtype_diversity, "
            "CAST(10 * class_diversity + 5 * subclass_diversity + 2 * subtype_diversity AS DOUBLE) AS diversity_score, round(score, 6) AS score, complexity, "
            "'Cluster_' || complexity || '_Complexity' AS subtype, class_detail, subclass_detail FROM (SELECT *, CASE WHEN class_diversity >= 5 THEN 'High' "
            "WHEN class_diversity >= 3 THEN 'Moderate' ELSE 'Low' END AS complexity FROM hotm JOIN hotc USING (seq_id, region) JOIN hots USING (seq_id, region))",
            HOT, HOT_MERGED,
        ),
        "hybrids": on_core(
            "SELECT seq_id, start_pos, end_pos, length, CAST(n_motifs AS INT) AS n_motifs, subtype, subclass_detail, round(length / CAST(longest AS DOUBLE), 6) AS overlap_degree, "
            "round(n_motifs * 0.2, 6) AS interaction_strength, round(total * (1 + n_motifs * 0.2) * length / longest, 6) AS score FROM hyb", HYB
        ),
        "longest_hybrids": on_core(
            "SELECT seq_id, start_pos, end_pos, length, overlap_count, 'Longest hybrid: ' || length || 'bp, ' || overlap_count || ' overlapping motifs, Classes=' || classes AS summary FROM ("
            "SELECT h.seq_id, h.start_pos, h.end_pos, h.length, h.classes, count(*) AS overlap_count "
            "FROM (SELECT *, array_to_string(list_sort(list_distinct(cl)), '+') AS classes, row_number() OVER (PARTITION BY seq_id ORDER BY length DESC, len(list_distinct(cl)) DESC, start_pos, end_pos) AS k FROM hyb) h "
            "JOIN core c ON c.seq_id = h.seq_id AND c.start_pos <= h.end_pos AND c.end_pos >= h.start_pos WHERE h.k = 1 GROUP BY h.seq_id, h.start_pos, h.end_pos, h.length, h.classes)", HYB
        ),
        "cluster_windows": on_core(
            "SELECT * EXCLUDE (kinds) REPLACE (" + r6("diversity_index") + ", round(round(interaction_score, 12), 6) + 0.0 AS interaction_score, round(round(cooperative_score, 12), 6) + 0.0 AS cooperative_score), array_to_string(kinds, '; ') AS motif_types FROM clw", CLW
        ),
        "clusters": on_core(
            "SELECT seq_id, CAST(region AS INT) AS start_pos, max(end_pos) AS end_pos, CAST(sum(motif_count) AS BIGINT) AS motif_count, "
            "array_to_string(list_sort(list_distinct(flatten(list(kinds)))), '; ') AS motif_types, round(max(diversity_index), 6) + 0.0 AS diversity_index, "
            "round(round(max(interaction_score), 12), 6) AS interaction_score, round(round(max(cooperative_score), 12), 6) AS cooperative_score, "
            "['" + "', '".join(clusters.LABELS) + "'][max(clinical_level) + 1] AS clinical_significance FROM clr GROUP BY seq_id, region",
            CLW, MERGE.format(name="clr", source="clw"),
        ),
        "hybrid_pairs": on_core("SELECT * REPLACE (" + r6("overlap", "stability") + ") FROM hp", HPAIR),
        "cooccurrence": on_core(
            "SELECT a.class, b.class AS other_class, count(*) AS n FROM core a JOIN core b ON a.seq_id = b.seq_id AND a.class <> b.class "
            "AND a.start_pos <= b.end_pos AND a.end_pos >= b.start_pos GROUP BY ALL"
        ),
        "class_intersections": intersections(),
        "proximity": on_core(
            "SELECT a.class, b.class AS other_class, count(*) AS n, CAST(sum(1000 - (b.start_pos - a.start_pos)) AS BIGINT) AS weight FROM core a JOIN core b ON a.seq_id = b.seq_id "
            "AND b.start_pos - a.start_pos < 1000 AND (a.start_pos, a.end_pos || '|' || a.class || '|' || a.subtype || '|' || a.copy_no) < (b.start_pos, b.end_pos || '|' || b.class || '|' || b.subtype || '|' || b.copy_no) GROUP BY ALL"
        ),
        "official_classes": on_core(
            f"SELECT c AS class, s AS subtype, CASE WHEN oc IN ({G4S}) OR os IN ({G4S}) THEN 'G-Quadruplex Family' ELSE oc END AS official_class, "
            f"CASE WHEN oc IN ({G4S}) THEN oc ELSE os END AS official_subtype, count(*) AS n FROM ("
            "SELECT c, s, coalesce(x.o, c) AS oc, coalesce(y.o, s) AS os FROM (SELECT coalesce(p.a, class) AS c, coalesce(q.a, subtype) AS s FROM core "
            "LEFT JOIN old p ON p.o = class LEFT JOIN old q ON q.o = subtype) LEFT JOIN alias x ON x.a = c LEFT JOIN alias y ON y.a = s) GROUP BY ALL", ALIAS_NEW, ALIAS_OLD
        ),
        "subtype_defaults": on_core(
            "SELECT class, s AS subtype, coalesce(nullif(s, ''), CASE " + " ".join(f"WHEN class = '{c}' THEN '{v}'" for c, v in classify.SINGLE_SUBTYPE.items())
            + " END, 'Canonical') AS filled, count(*) AS n FROM (SELECT class, CASE WHEN length % 2 = 0 THEN '' ELSE subtype END AS s FROM core) GROUP BY ALL"
        ),
        "filtered_motifs": on_core(
            "SELECT seq_id, start_pos, end_pos, s.name AS seq_name, class, subtype, c.length, score FROM core c JOIN seqs s USING (seq_id) "
            "WHERE class IN ('Z-DNA', 'Slipped DNA', 'R-loop') AND score >= 20 AND c.length BETWEEN 13 AND 400"
        ),
        "column_defaults": on_core(
            "SELECT seq_id, start_pos, end_pos, class, CASE WHEN length > 20 AND subtype <> '' THEN subtype ELSE 'Unknown' END AS subtype, "
            "CASE WHEN length % 2 = 0 THEN score ELSE 0 END AS score, CAST(0 AS DOUBLE) AS conservation_score, 'Unknown' AS gene FROM core"
        ),
        "disease_subset": on_core("SELECT seq_id, start_pos, end_pos, class, subtype, length, score FROM core WHERE class LIKE '%Disease%'"),
        "class_distribution": on_core(
            "SELECT class_no, class, coalesce(n, 0) AS count, CASE WHEN n > 0 THEN 'Detected' ELSE 'Not Found' END AS status, "
            "round(coalesce(n, 0) * 100.0 / sum(n) OVER (), 2) AS percentage FROM (SELECT DISTINCT class_no, class FROM cdim) LEFT JOIN (SELECT class, count(*) AS n FROM core GROUP BY class) USING (class)", CDIM
        ),
        "subclass_distribution": on_core(
            "SELECT class_no * 100 + subclass_no AS subclass_no, subclass, coalesce(n, 0) AS count, CASE WHEN n > 0 THEN 'Detected' ELSE 'Not Found' END AS status, "
            "round(coalesce(n, 0) * 100.0 / sum(n) OVER (), 2) AS percentage FROM (SELECT * FROM cdim WHERE subclass IS NOT NULL) LEFT JOIN (SELECT subtype AS subclass, count(*) AS n FROM core GROUP BY subtype) USING (subclass)", CDIM
        ),
        "features": features_sql(),
        "formation_probability": on_core(
            "SELECT seq_id, start_pos, end_pos, class, subtype, round(p, 6) AS ml_probability, round(CASE class WHEN 'G-Quadruplex Family' THEN least(0.95, 0.8 * p + 0.2) "
            "WHEN 'Z-DNA' THEN least(0.9, 0.7 * p + 0.3) WHEN 'R-loop' THEN least(0.85, 0.6 * p + 0.4) ELSE 0.7 END, 6) AS ml_confidence, round(CASE class WHEN 'G-Quadruplex Family' THEN gs WHEN 'R-loop' THEN least(1, 0.5 * g) ELSE 0.5 END, 6) AS ml_stability, "
            "round(CASE class WHEN 'G-Quadruplex Family' THEN gp WHEN 'Z-DNA' THEN zp ELSE 0.5 END, 6) AS ml_pattern_score, round(0.7 * score + 30 * p, 6) AS enhanced_score FROM prob", PROB
        ),
        "mean_probability": on_core("SELECT class, round(avg(p), 6) AS mean_probability FROM prob GROUP BY class", PROB),
        "class_counts": on_core("SELECT class, count(*) AS n FROM core GROUP BY class"),
        "sequence_summary": on_core("SELECT seq_id, name, length, n_motifs, round(n_motifs / CAST(length AS DOUBLE) * 1000, 2) AS motifs_per_kb FROM ps", PER_SEQ),
        "overview": on_core(
            "SELECT *, round(n_motifs / CAST(n_sequences AS DOUBLE), 6) AS motifs_per_sequence, round(n_motifs / CAST(total_bp AS DOUBLE) * 1000, 6) AS motifs_per_kb FROM "
            "(SELECT count(*) AS n_sequences, CAST(sum(length) AS BIGINT) AS total_bp FROM seqs), (SELECT count(*) AS n_motifs, count(DISTINCT class) AS n_classes, count(DISTINCT subtype) AS n_subtypes FROM core)"
        ),
        "count_statistics": on_core(
            "SELECT round(avg(n_motifs), 6) AS mean_motifs, round(median(n_motifs), 6) AS median_motifs, round(stddev_pop(n_motifs), 6) AS std_motifs, min(n_motifs) AS min_motifs, max(n_motifs) AS max_motifs, "
            "round(avg(length), 6) AS mean_length, round(median(length), 6) AS median_length, CAST(sum(length) AS BIGINT) AS total_length FROM ps", PER_SEQ
        ),
        "class_shares": share_sql("class"),
        "top_classes": share_sql("class", "ORDER BY n DESC, class LIMIT 5"),
        "top_subtypes": share_sql("subtype", "ORDER BY n DESC, subtype LIMIT 10"),
        "positional_density": on_core("SELECT seq_id, start_pos // greatest(s.length // 100, 1) AS bin, count(*) AS n FROM core JOIN (SELECT seq_id, length FROM seqs) s USING (seq_id) GROUP BY ALL"),
        "class_bins": on_core("SELECT class, start_pos // 100 AS bin, count(*) AS n FROM core GROUP BY ALL"),
        "class_subtype_counts": on_core("SELECT class, subtype, count(*) AS n FROM core GROUP BY CUBE (class, subtype)"),
        "score_pivot": on_core(
            "SELECT subtype, " + ", ".join(f"""round(coalesce(avg(score) FILTER (class = '{c}'), 0), 6) AS "{c}" """ for c in DETECTED_CLASSES) + " FROM core GROUP BY subtype"
        ),
        "score_distribution": dist_sql("score", "class"),
        "length_distribution": dist_sql("length", "subtype"),
        "length_score_trend": on_core("SELECT round(regr_slope(score, length), 6) AS slope, round(regr_intercept(score, length), 6) AS intercept FROM core"),
        "score_histogram": on_core(
            "SELECT CAST(least(19, floor((score - lo) / (hi - lo) * 20)) AS BIGINT) AS bin, count(*) AS n FROM core, (SELECT min(score) AS lo, max(score) AS hi FROM core) GROUP BY ALL"
        ),
        "circular_positions": on_core("SELECT c.seq_id, class, start_pos, end_pos, round(start_pos * 360.0 / s.length, 6) AS angle FROM core c JOIN seqs s ON s.seq_id = c.seq_id"),
        "sequence_comparison": on_core(
            "SELECT * REPLACE (" + r6("gc", "motif_density") + ", " + ", ".join(f'round("{c}_Density", 6) AS "{c}_Density"' for c in DETECTED_CLASSES) + ") FROM cmp", CMP
        ),
        "gc_category": on_core(
            "SELECT gc_category, round(min(gc), 6) AS min_gc, round(max(gc), 6) AS max_gc, round(avg(motif_density), 6) AS mean_density, round(stddev_samp(motif_density), 6) AS std_density, "
            "count(*) AS n_sequences, CAST(sum(n_motifs) AS BIGINT) AS n_motifs FROM cmp GROUP BY gc_category", CMP
        ),
        "gc_category_means": on_core("SELECT gc_category, " + ", ".join(f'round(avg("{c}_Count"), 6) AS "{c}"' for c in DETECTED_CLASSES) + " FROM cmp GROUP BY gc_category", CMP),
        "gc_correlation": on_core("SELECT round(corr(gc, motif_density), 6) AS r, count(*) AS n FROM cmp", CMP),
        "gene_summary": on_core("SELECT * REPLACE (" + r6("gc", "motif_density") + ") FROM genes", GENES),
        "gene_statistics": on_core(
            "SELECT count(*) AS n_sequences, CAST(sum(n_motifs) AS BIGINT) AS n_motifs, CAST(sum(n_disease) AS BIGINT) AS n_disease, round(avg(n_motifs), 6) AS mean_motifs, round(avg(n_disease), 6) AS mean_disease, "
            "round(avg(length), 6) AS mean_length, round(avg(gc), 6) AS mean_gc, count(*) FILTER (n_disease > 0) AS with_disease, "
            "(SELECT name FROM genes ORDER BY n_motifs DESC, seq_id LIMIT 1) AS most_motifs_name, max(n_motifs) AS most_motifs FROM genes", GENES
        ),
        "top_sequences": on_core(
            "SELECT seq_id, name, n_motifs, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM genes)) / (SELECT stddev_pop({c}) FROM genes), 6) AS z_{c}" for c in ("n_motifs", "gc", "motif_density"))
            + " FROM genes ORDER BY n_motifs DESC, seq_id LIMIT 10", GENES
        ),
        "comprehensive_table": on_core(
            "SELECT seq_id || '_' || row_number() OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos, class, subtype) AS motif_id, seq_id, class, subtype, start_pos, end_pos, length, "
            "round(score, 6) AS score, CASE WHEN length(sequence) > 100 THEN sequence[1:100] || '...' ELSE sequence END AS fragment FROM core"
        ),
        "clinical_counts": dis_q(
            "SELECT count(*) AS total, count(*) FILTER (clinical_significance = 'Pathogenic') AS pathogenic, count(*) FILTER (clinical_significance = 'Likely Pathogenic') AS likely_pathogenic, "
            "count(*) FILTER (clinical_significance LIKE 'Variant%') AS uncertain, count(DISTINCT disease_name) AS diseases, count(DISTINCT gene_symbol) AS genes FROM dis"
        ),
        "clinical_table": dis_q(
            "SELECT seq_id, disease_name, gene_symbol, repeat_unit, repeat_count, normal_range, threshold, clinical_significance, round(risk_score, 6) AS risk_score, inheritance, clinical_significance = 'Pathogenic' AS pathogenic FROM dis"
        ),
        "risk_bands": dis_q(
            "SELECT CASE WHEN risk_score >= 85 THEN 'Very High' WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 50 THEN 'Moderate' ELSE 'Low' END AS band, count(*) AS n FROM dis GROUP BY 1"
        ),
        "highest_risk": dis_q(
            "SELECT seq_id, start_pos, disease_name, gene_symbol, round(risk_score, 6) AS risk_score, clinical_significance FROM dis ORDER BY dis.risk_score DESC, repeat_count DESC, seq_id, start_pos LIMIT 1"
        ),
        "therapy_diseases": dis_q(
            "SELECT therapeutic_target, string_agg(DISTINCT disease_name, '; ' ORDER BY disease_name) AS diseases, count(*) AS n FROM dis WHERE therapeutic_target <> 'No specific targets identified' GROUP BY 1"
        ),
        "counselling_notes": dis_q(
            "SELECT genetic_counseling, inheritance, count(*) AS n, CASE inheritance WHEN 'AR' THEN 'Autosomal Recessive - Both parents are carriers' "
            "WHEN 'AD' THEN 'Autosomal Dominant - One affected parent passes the condition' WHEN 'XL' THEN 'X-Linked - Passed through X chromosome' "
            "WHEN 'MT' THEN 'Mitochondrial - Maternal inheritance' END AS explanation FROM dis GROUP BY 1, 2"
        ),
    }
    return out
