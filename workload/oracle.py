"""SQL that computes the same results as `queries`, written independently of the Spark operators."""

from __future__ import annotations

import re

from .inputs import CIGARS, FLAGS

GENOTYPES = ("AA", "AB", "BB")
JOINT = [f"{n}_{t}" for n in GENOTYPES for t in GENOTYPES]
POSTERIORS = [f"p_{g}" for g in JOINT]
COUNTS = ("a_N", "b_N", "a_T", "b_T")
PI = (1e6, 1e3, 1e3, 1e3, 1e4, 1e3, 1e1, 1e1, 1e4)
MU = (0.99, 0.5, 0.01)
ALPHA, BETA = (1000.0, 500.0, 1.0), (1.0, 500.0, 1000.0)
MU_ALPHA, MU_BETA = (1000.0, 500.0, 2.0), (2.0, 500.0, 1000.0)
DEPTH_FILTER = "a_N + b_N BETWEEN 5 AND 20 AND a_T + b_T BETWEEN 5 AND 20"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---- inputs ---------------------------------------------------------------------------------------

SAMPLE = "CASE WHEN l_linestatus = 'F' THEN 'normal' ELSE 'tumour' END"
MAPQ = "CAST(floor(l_extendedprice) AS BIGINT) % 61"
LETTER = "substr('ACGT', CAST(1 + p_size % 4 AS INT), 1)"

OBS = f"""obs AS (
  SELECT {SAMPLE} AS sample, l_returnflag AS chrom, CAST(l_partkey AS BIGINT) AS pos, {LETTER} AS ref_base,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 10 < 6 THEN {LETTER}
         ELSE substr('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) END AS base,
    CAST(l_quantity AS BIGINT) AS bq, {MAPQ} AS mq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def case(expression: str, values) -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


CIGAR = case("l_linenumber - 1", [c for c, _ in CIGARS])
LENGTH = case("l_linenumber - 1", [n for _, n in CIGARS])
READS = f"""reads AS (
  SELECT {SAMPLE} AS sample, concat(l_orderkey, '.', l_linenumber) AS qname,
    CAST({case('l_suppkey % 10', FLAGS)} AS BIGINT) AS flag, l_returnflag AS chrom, CAST(l_partkey AS BIGINT) AS pos,
    {MAPQ} AS mapq, {CIGAR} AS cigar, l_returnflag AS mate_chrom, CAST(l_partkey + 199 AS BIGINT) AS mate_pos,
    CAST(l_suppkey - 50 AS BIGINT) AS isize,
    substr(repeat('ACgT', 4), CAST(1 + l_suppkey % 4 AS INT), {LENGTH}) AS seq,
    substr(repeat('5?I!+', 4), CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS INT), {LENGTH}) AS qual,
    CAST(l_quantity AS BIGINT) AS nm, l_suppkey, l_linenumber
  FROM lineitem)"""


def walk(cigar: str) -> list[tuple]:
    """(cigar, offset, query position or NULL, is_del, is_refskip, indel, is_head, is_tail) per reference position."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)(\D)", cigar)]
    rows, x, y = [], 0, 0
    for k, (n, op) in enumerate(ops):
        after = ops[k + 1] if k + 1 < len(ops) else (0, "")
        change = {"I": after[0], "D": -after[0]}.get(after[1], 0)
        if op in "M=X":
            rows += [[cigar, x + i, y + i, False, False, change if i == n - 1 else 0] for i in range(n)]
        elif op in "DN":
            rows += [[cigar, x + i, None, True, op == "N", change if i == n - 1 else 0] for i in range(n)]
        x += n if op in "M=XDN" else 0
        y += n if op in "M=XIS" else 0
    return [(*r, r[1] == 0, r[1] == x - 1) for r in rows]


def sql_value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


KINDS = sorted({c for c, _ in CIGARS})
STEPS = "steps(cigar, off, qpos, is_del, is_refskip, indel, is_head, is_tail) AS (VALUES " + ", ".join(
    "(" + ", ".join(map(sql_value, row)) + ")" for c in KINDS for row in walk(c)
) + ")"
KEPT = "flag & 1796 = 0 AND chrom <> '*'"
ENTRIES = f"""entries AS (
  SELECT sample, chrom, pos + off AS pos, upper(substr(seq, CAST(qpos + 1 AS INT), 1)) AS base,
    CAST(ascii(substr(qual, CAST(qpos + 1 AS INT), 1)) - 33 AS BIGINT) AS bq, CASE WHEN qpos IS NULL THEN NULL ELSE 1 END AS has_base,
    mapq AS mq, is_del, is_refskip, CAST(indel AS BIGINT) AS indel, is_head, is_tail
  FROM reads JOIN steps USING (cigar) WHERE {KEPT})"""
REFERENCE = f"""reference AS (
  SELECT chrom, CAST(p_partkey AS BIGINT) AS pos, {LETTER} AS ref_base
  FROM part, (VALUES ('A'), ('N'), ('R')) contigs(chrom)),
last_position AS (SELECT max(p_partkey) AS last_pos FROM part)"""
READ_OBS = """obs AS (
  SELECT sample, e.chrom, e.pos, ref_base, CASE WHEN has_base = 1 THEN base END AS base, CASE WHEN has_base = 1 THEN bq END AS bq, mq
  FROM entries e, last_position l JOIN reference r ON r.chrom = e.chrom AND r.pos = least(e.pos, l.last_pos))"""
LISTED = """listed AS (
  SELECT chrom, CAST(p_partkey AS BIGINT) AS pos FROM part, (VALUES ('A'), ('R')) contigs(chrom) WHERE p_size <= 10)"""
REGIONS = f"""regions AS (
  SELECT {case('s_suppkey % 3', ('A', 'N', 'R'))} AS chrom, s_suppkey * 19 AS "start", s_suppkey * 19 + 5 + s_nationkey * 4 AS "end",
    s_name AS region FROM supplier)"""
SPANS = {c: max(r[1] for r in walk(c)) + 1 for c in KINDS}
SPAN = "CASE cigar " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in SPANS.items()) + " END"


# ---- sites ----------------------------------------------------------------------------------------


def sites(min_bq: int = 0, min_mq: int = 0, name: str = "sites", where: str = "TRUE") -> str:
    ok = f"base IS NOT NULL AND bq >= {min_bq} AND mq >= {min_mq}"
    per_base = ",\n".join(
        f"count(*) FILTER (WHERE {ok} AND base = '{b}' AND sample = '{s}') AS c{b}_{s[0]}" for b in "ACGT" for s in ("normal", "tumour")
    )
    best = ", ".join(
        f"CASE WHEN ref_base <> '{b}' AND c{b}_n + c{b}_t > 0 THEN (c{b}_n + c{b}_t) * 4 + {i} ELSE -1 END" for i, b in enumerate("ACGT")
    )
    pick = lambda s: "CASE var_base " + " ".join(f"WHEN '{b}' THEN c{b}_{s}" for b in "ACGT") + " ELSE 0 END"
    return f"""counted AS (
  SELECT chrom, pos, ref_base,
    count(*) FILTER (WHERE {ok} AND base = ref_base AND sample = 'normal') AS a_N,
    count(*) FILTER (WHERE {ok} AND base = ref_base AND sample = 'tumour') AS a_T,
    {per_base}
  FROM obs GROUP BY chrom, pos, ref_base
  HAVING count(*) FILTER (WHERE sample = 'normal') > 0 AND count(*) FILTER (WHERE sample = 'tumour') > 0),
ranked AS (SELECT *, greatest({best}) AS top FROM counted),
chosen AS (SELECT *, CASE WHEN top < 0 THEN 'N' ELSE substr('ACGT', CAST(top % 4 + 1 AS INT), 1) END AS var_base FROM ranked),
{name} AS (
  SELECT chrom, pos, ref_base, var_base, a_N, {pick('n')} AS b_N, a_T, {pick('t')} AS b_T FROM chosen WHERE {where})"""


def cells(min_bq: int = 0, min_mq: int = 0, source: str = "sites") -> str:
    """Reads of each site that show the reference or the variant base, with q and r."""
    return f"""cells AS (
  SELECT o.chrom, o.pos, CASE WHEN o.sample = 'normal' THEN 'N' ELSE 'T' END AS s,
    CASE WHEN base = s.ref_base THEN 1 - pow(10, -bq / 10.0) ELSE pow(10, -bq / 10.0) / 3 END AS q,
    1 - pow(10, -mq / 10.0) AS r
  FROM obs o JOIN {source} s ON s.chrom = o.chrom AND s.pos = o.pos
  WHERE base IS NOT NULL AND bq >= {min_bq} AND mq >= {min_mq} AND (base = s.ref_base OR base = s.var_base))"""


def lik(mu: str) -> str:
    return f"(0.5 * (1 - r) + r * ((1 - q) * (1 - {mu}) + q * {mu}))"


# ---- models ---------------------------------------------------------------------------------------


def logliks_binomial(source: str, params: str) -> str:
    terms = ", ".join(
        f"a_{s} * ln(mu_{s}_{g}) + b_{s} * ln(1 - mu_{s}_{g}) AS l_{s}_{g}, a_{s} AS ea_{s}_{g}, b_{s} AS eb_{s}_{g}" for s in "NT" for g in GENOTYPES
    )
    return f"SELECT x.*, pi.*, {terms} FROM {source} x, {params} pi"


def logliks_beta_binomial(source: str, params: str) -> str:
    lbeta = lambda a, b: f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
    terms = ", ".join(
        f"{lbeta(f'(a_{s} + {a})', f'(b_{s} + {b})')} - {lbeta(a, b)} AS l_{s}_{g}"
        for s in "NT" for g, a, b in zip(GENOTYPES, ALPHA, BETA)
    )
    return f"SELECT x.*, pi.*, {terms} FROM {source} x, {params} pi"


def logliks_quality(source: str, params: str) -> str:
    sums = ", ".join(
        f"sum(CASE WHEN s = '{s}' THEN ln({lik(f'mu_{s}_{g}')}) ELSE 0 END) AS l_{s}_{g}, "
        f"sum(CASE WHEN s = '{s}' THEN mu_{s}_{g} * (0.5 + r * (q - 0.5)) / {lik(f'mu_{s}_{g}')} ELSE 0 END) AS ea_{s}_{g}, "
        f"sum(CASE WHEN s = '{s}' THEN (1 - mu_{s}_{g}) * (0.5 + r * (0.5 - q)) / {lik(f'mu_{s}_{g}')} ELSE 0 END) AS eb_{s}_{g}"
        for s in "NT" for g in GENOTYPES
    )
    zero = ", ".join(f"coalesce({k}_{s}_{g}, 0) AS {k}_{s}_{g}" for k in ("l", "ea", "eb") for s in "NT" for g in GENOTYPES)
    return (
        f"SELECT x.*, pi.*, {zero} FROM {source} x LEFT JOIN "
        f"(SELECT chrom, pos, {sums} FROM cells, {params} GROUP BY chrom, pos) t ON t.chrom = x.chrom AND t.pos = x.pos, {params} pi"
    )


LOGLIKS = {"binomial": logliks_binomial, "beta_binomial": logliks_beta_binomial, "quality": logliks_quality}


def start_params(name: str = "theta0") -> str:
    columns = [f"CAST({p} AS DOUBLE) / {sum(PI)} AS pi_{g}" for g, p in zip(JOINT, PI)]
    columns += [f"CAST({m} AS DOUBLE) AS mu_{s}_{g}" for s in "NT" for g, m in zip(GENOTYPES, MU)]
    return f"{name} AS (SELECT {', '.join(columns)})"


def scores(model: str, source: str, params: str, name: str) -> str:
    joint = ", ".join(f"ln(pi_{n}_{t}) + l_N_{n} + l_T_{t} AS j_{n}_{t}" for n in GENOTYPES for t in GENOTYPES)
    largest = f"greatest({', '.join(f'j_{g}' for g in JOINT)})"
    lse = f"m + ln({' + '.join(f'exp(j_{g} - m)' for g in JOINT)})"
    posteriors = ", ".join(f"exp(j_{g} - lse) AS p_{g}" for g in JOINT)
    return f"""{name}_l AS ({LOGLIKS[model](source, params)}),
{name}_j AS (SELECT *, {joint} FROM {name}_l),
{name}_m AS (SELECT *, {largest} AS m FROM {name}_j),
{name}_s AS (SELECT *, {lse} AS lse FROM {name}_m),
{name} AS (SELECT *, {posteriors} FROM {name}_s)"""


def marginal(s: str, g: str) -> str:
    return "(" + " + ".join(f"p_{g}_{o}" if s == "N" else f"p_{o}_{g}" for o in GENOTYPES) + ")"


def statistics(model: str, source: str, name: str) -> str:
    sums = [f"sum(p_{g}) AS n_{g}" for g in JOINT]
    if model != "beta_binomial":
        sums += [f"sum({marginal(s, g)} * {k}_{s}_{g}) AS {k}_{s}_{g}" for s in "NT" for g in GENOTYPES for k in ("ea", "eb")]
    return f"{name} AS (SELECT {', '.join(sums)}, sum(lse) AS log_likelihood FROM {source})"


def update(model: str, stats: str, old: str, name: str) -> str:
    """M-step with the default priors, and the penalised log-likelihood under the old parameters."""
    whole = " + ".join(f"n_{g} + 1" for g in JOINT)
    columns = [f"(n_{g} + 1) / ({whole}) AS pi_{g}" for g in JOINT]
    prior = [f"ln(o.pi_{g})" for g in JOINT]
    for s in "NT":
        for g, a, b in zip(GENOTYPES, MU_ALPHA, MU_BETA):
            if model == "beta_binomial":
                columns.append(f"o.mu_{s}_{g} AS mu_{s}_{g}")
            else:
                up, down = f"(ea_{s}_{g} + {a} - 1)", f"(eb_{s}_{g} + {b} - 1)"
                columns.append(f"{up} / ({up} + {down}) AS mu_{s}_{g}")
                prior.append(f"({a} - 1) * ln(o.mu_{s}_{g}) + ({b} - 1) * ln(1 - o.mu_{s}_{g})")
    return f"{name}_full AS (SELECT {', '.join(columns)}, log_likelihood + {' + '.join(prior)} AS ll FROM {stats}, {old} o),\n" + (
        f"{name} AS (SELECT * EXCLUDE (ll) FROM {name}_full)"
    )


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


SITE_COLUMNS = "chrom, pos, ref_base, var_base, " + ", ".join(COUNTS)
RESULT = "chrom, pos + 1 AS \"position\", ref_base, var_base, a_N AS normal_counts_a, b_N AS normal_counts_b, a_T AS tumour_counts_a, b_T AS tumour_counts_b"


def scored(model: str, select: str, where: str = "b_T > 0", base: str = OBS) -> str:
    ctes = [base, sites(), f"picked AS (SELECT * FROM sites WHERE {where})"]
    if model == "quality":
        ctes.append(cells(source="picked"))
    return with_(*ctes, start_params(), scores(model, "picked", "theta0", "scored"), select=select)


def training(*ctes: str, model: str, select: str) -> str:
    start = [OBS, sites(), f"train AS (SELECT * FROM sites WHERE {DEPTH_FILTER})"]
    if model == "quality":
        start.append(cells(source="train"))
    return with_(*start, start_params(), *ctes, select=select)


def ess(model: str, select: str) -> str:
    return training(scores(model, "train", "theta0", "e0"), statistics(model, "e0", "stats"), model=model, select=select)


def ess_columns(model: str) -> list[str]:
    names = [f"n_{g}" for g in JOINT]
    if model != "beta_binomial":
        names += [f"{k}_{s}_{g}" for s in "NT" for g in GENOTYPES for k in ("ea", "eb")]
    return names


def em(model: str, select: str | None = None) -> str:
    """EM until the relative change of the log-likelihood falls below 1e-6, on every third site."""
    sampled = f"""ordered AS (SELECT *, row_number() OVER (ORDER BY chrom, pos) AS i FROM sites WHERE {DEPTH_FILTER}),
train AS MATERIALIZED (SELECT * EXCLUDE (i) FROM ordered WHERE i % 3 = 0)"""
    start = [OBS, sites(), sampled] + ([cells(source="train").replace("cells AS (", "cells AS MATERIALIZED (", 1)] if model == "quality" else [])
    step = with_(scores(model, "train", "loop", "e"), statistics(model, "e", "stats"), update(model, "stats", "loop", "theta"),
        select="SELECT o.step + 1 AS step, f.ll, o.ll AS before, f.* EXCLUDE (ll) FROM theta_full f, loop o WHERE o.step < 2 OR (o.ll - o.before) / abs(o.before) >= 1e-6")
    loop = f"loop AS (SELECT 0 AS step, CAST(NULL AS DOUBLE) AS ll, CAST(NULL AS DOUBLE) AS before, * FROM theta0 UNION ALL ({step}))"
    rows = [f"SELECT 'pi' AS component, '{g}' AS genotype, round(pi_{g}, 5) AS value FROM last" for g in JOINT]
    for s in "NT":
        for g, a, b in zip(GENOTYPES, ALPHA, BETA):
            if model == "beta_binomial":
                rows += [f"SELECT 'alpha_{s}', '{g}', {a}", f"SELECT 'beta_{s}', '{g}', {b}"]
            else:
                rows.append(f"SELECT 'mu_{s}', '{g}', round(mu_{s}_{g}, 5) FROM last")
    rows += ["SELECT 'log_likelihood', 'last', round(ll, 5) FROM last", "SELECT 'iterations', 'all', step FROM last"]
    last = "last AS MATERIALIZED (SELECT * FROM loop ORDER BY step DESC LIMIT 1)"
    return with_(*start, start_params(), loop, last, select=select or "\nUNION ALL ".join(rows)).replace("WITH ", "WITH RECURSIVE ", 1)


LABELS = {
    "wildtype": "p_AA_AA", "somatic": "p_AA_AB + p_AA_BB", "germline": "p_AB_AB + p_BB_BB", "loh": "p_AB_AA + p_AB_BB", "error": "p_BB_AA + p_BB_AB",
}
LABEL_OF = {
    "AA_AA": "wildtype", "AA_AB": "somatic", "AA_BB": "somatic", "AB_AA": "loh", "AB_AB": "germline", "AB_BB": "loh",
    "BB_AA": "error", "BB_AB": "error", "BB_BB": "germline",
}
HIGHEST = f"greatest({', '.join(POSTERIORS)})"
BEST = "CASE " + " ".join(f"WHEN p_{g} = {HIGHEST} THEN '{g}'" for g in JOINT) + " END"
LABEL = "CASE genotype " + " ".join(f"WHEN '{g}' THEN '{label}'" for g, label in LABEL_OF.items()) + " END"
LETTERS = {1: "p", 2: "P", 4: "u", 8: "U", 16: "r", 32: "R", 64: "1", 128: "2", 256: "s", 512: "f", 1024: "d"}
ISO = "concat(" + ", ".join(f"CASE WHEN flag & {bit} > 0 THEN '{letter}' ELSE '' END" for bit, letter in LETTERS.items()) + ")"
CONTIGS = "contigs AS (SELECT l_returnflag AS chrom, max(l_partkey) + 1 AS length FROM lineitem GROUP BY 1)"


def bin_of(start: str, end: str) -> str:
    levels = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)]
    return "CASE " + " ".join(f"WHEN ({start}) >> {s} = ({end} - 1) >> {s} THEN {o} + (({start}) >> {s})" for s, o in levels) + " ELSE 0 END"


ORACLE: dict[str, str] = {
    "sam_scan": with_(READS, select=f"""SELECT sample, qname, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, isize, seq, qual FROM reads"""),
    "contig_list": with_(CONTIGS, select="SELECT chrom, CAST(length AS BIGINT) AS length, CAST(row_number() OVER (ORDER BY chrom) - 1 AS BIGINT) AS tid FROM contigs"),
    "contig_intersect": with_(LISTED, select="""SELECT DISTINCT l_returnflag AS chrom FROM lineitem WHERE l_linestatus = 'F'
      AND l_returnflag IN (SELECT l_returnflag FROM lineitem WHERE l_linestatus <> 'F') AND l_returnflag IN (SELECT chrom FROM listed)"""),
    "flag_filter": with_(READS, select=f"""SELECT sample, chrom, flag, count(*) AS reads, CAST(sum(mapq) AS BIGINT) AS sum_mapq,
      CAST(sum(pos) AS BIGINT) AS sum_pos FROM reads WHERE {KEPT} GROUP BY ALL"""),
    "flag_decode": with_(READS, select=f"""SELECT flag, {ISO} AS flag_letters, flag & 1 > 0 AS is_paired, flag & 16 > 0 AS is_reverse,
      flag & 32 > 0 AS is_mate_reverse, flag & 64 > 0 AS is_read1, flag & 1024 > 0 AS is_duplicate, count(*) AS reads FROM reads GROUP BY ALL"""),
    "flag_parse": """SELECT CAST(l_suppkey AS BIGINT) AS value, CAST(f.form AS BIGINT) AS form,
      CAST(l_suppkey AS BIGINT) AS parsed, count(*) AS n
      FROM lineitem, (VALUES (0), (1), (2), (3)) f(form) GROUP BY ALL""",
    "cigar_spans": with_(READS, select=f"""SELECT cigar, pos, CAST(max(pos + {SPAN}) AS BIGINT) AS "end", CAST(sum(length(seq)) AS BIGINT) AS query_bases,
      CAST(sum(length(regexp_replace(cigar, '[0-9]', '', 'g'))) AS BIGINT) AS operations FROM reads GROUP BY cigar, pos"""),
    "record_validation": with_(READS, select="""SELECT sample, CASE
        WHEN pos % 6 = 5 THEN 'missing read name' WHEN pos % 6 = 2 THEN 'invalid CIGAR character'
        WHEN pos % 6 = 1 THEN 'invalid CIGAR operation' WHEN pos % 6 = 3 THEN 'CIGAR and sequence length are inconsistent'
        WHEN pos % 6 = 4 THEN 'sequence and quality are inconsistent' END AS error, count(*) AS reads FROM reads GROUP BY ALL"""),
    "base_normalise": r"""WITH t AS (SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz0123', 'ABCDEFGHIJKLMNOPQRSTUVWXYZACGT'),
      '[^=ACMGRSVTWYHKDBN]', 'N', 'g') AS seq FROM documents)
      SELECT doc_id, CAST(length(seq) AS BIGINT) AS letters, md5(seq) AS digest FROM t""",
    "tag_lookup": with_(READS, select="""SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'none' ELSE concat('rg', l_suppkey) END AS rg, nm, chrom AS xt,
      l_linenumber + CAST(0.5 AS DOUBLE) AS xf, CAST(NULL AS VARCHAR) AS zz, CAST(NULL AS BIGINT) AS not_a_number, count(*) AS reads FROM reads GROUP BY ALL"""),
    "tag_edit": with_(READS, select="""SELECT 'RG,XF' AS dropped, 'RG' AS kept, concat('i:', mapq) AS added, concat('A:', chrom) AS unchanged, count(*) AS reads
      FROM reads GROUP BY ALL"""),
    "library_join": with_(READS, select="""SELECT sample, CASE WHEN s_nationkey IS NOT NULL THEN concat('lib', s_nationkey) END AS library, count(*) AS reads
      FROM reads LEFT JOIN supplier ON s_suppkey = l_suppkey AND l_suppkey % 5 <> 0 GROUP BY ALL"""),
    "contig_stats": with_(READS, CONTIGS, "lost AS (SELECT CASE WHEN pos % 7 = 0 THEN '*' ELSE chrom END AS chrom, flag FROM reads)", select="""
      SELECT c.chrom, CAST(length AS BIGINT) AS length, count(flag) FILTER (WHERE flag & 4 = 0) AS mapped, count(flag) FILTER (WHERE flag & 4 > 0) AS unmapped
      FROM contigs c LEFT JOIN lost l ON l.chrom = c.chrom GROUP BY c.chrom, length
      UNION ALL SELECT '*', 0, 0, count(*) FROM lost WHERE chrom = '*' HAVING count(*) > 0"""),
    "region_scan": with_(READS, select=f"SELECT sample, qname, chrom, pos, cigar FROM reads WHERE chrom = 'N' AND pos < 700 AND pos + {SPAN} > 100"),
    "region_overlap": with_(READS, REGIONS, select=f"""SELECT g.chrom, region, CAST("start" AS BIGINT) AS region_start, CAST("end" AS BIGINT) AS region_end,
      count(*) AS reads, CAST(sum(pos) AS BIGINT) AS sum_pos, CAST(sum(mapq) AS BIGINT) AS sum_mapq
      FROM reads r JOIN regions g ON g.chrom = r.chrom AND pos < "end" AND pos + {SPAN} > "start" GROUP BY ALL"""),
    "region_reads": with_(READS, REGIONS, select=f"""SELECT sample, chrom, pos, cigar, count(*) AS reads FROM reads r
      WHERE EXISTS (SELECT 1 FROM regions g WHERE g.chrom = r.chrom AND r.pos < g."end" AND r.pos + {SPAN} > g."start") GROUP BY ALL"""),
    "region_parse": """WITH f AS (SELECT l_returnflag AS c, l_partkey AS k, form FROM lineitem, (VALUES (0), (1), (2), (3), (4)) f(form))
      SELECT CAST(form AS BIGINT) AS form, CASE form WHEN 4 THEN concat('HLA:', c, ':x-', k) ELSE c END AS chrom,
        CAST(CASE form WHEN 1 THEN k WHEN 2 THEN k * 1000 WHEN 3 THEN k ELSE 0 END AS BIGINT) AS "start",
        CAST(CASE form WHEN 2 THEN k * 1000 + 500 WHEN 3 THEN k + 9 END AS BIGINT) AS "end", count(*) AS n FROM f GROUP BY ALL""",
    "genomic_bin": f"""WITH t AS (SELECT CAST(l_orderkey * 4099 % 500000000 AS BIGINT) AS s, CAST(pow(10, l_linenumber) AS BIGINT) AS w FROM lineitem)
      SELECT CAST({bin_of('s', '(s + w)')} AS BIGINT) AS bin, count(*) AS reads FROM t GROUP BY 1""",
    "pileup_expand": with_(READS, STEPS, ENTRIES, select="""SELECT sample, chrom, pos, CASE WHEN has_base = 1 THEN base END AS base, count(*) AS n,
      CAST(sum(CASE WHEN has_base = 1 THEN bq END) AS BIGINT) AS sum_bq, CAST(sum(mq) AS BIGINT) AS sum_mq FROM entries GROUP BY ALL"""),
    "pileup_indels": with_(READS, STEPS, ENTRIES, select="""SELECT sample, chrom, pos, indel, is_del, is_refskip, is_head, is_tail, count(*) AS n
      FROM entries GROUP BY ALL"""),
    "coverage_depth": with_(READS, STEPS, ENTRIES, select="""SELECT sample, chrom, pos, count(*) AS entries, count(has_base) AS depth
      FROM entries GROUP BY sample, chrom, pos"""),
    "base_counts": with_(OBS, select="SELECT sample, chrom, pos, " + ", ".join(
        f"count(*) FILTER (WHERE bq >= 10 AND mq >= 10 AND base = '{b}') AS n_{b}" for b in "ACGTN") + " FROM obs GROUP BY sample, chrom, pos"),
    "base_histogram": with_(OBS, select="SELECT sample, chrom, pos, base, count(*) AS n FROM obs WHERE base IS NOT NULL AND mq >= 20 GROUP BY ALL"),
    "multi_sample_pileup": with_(OBS, select="SELECT sample AS chrom, pos, " + ", ".join(
        f"count(base) FILTER (WHERE chrom = '{s}') AS depth_{s}" for s in "ANR") + " FROM obs GROUP BY sample, pos"),
    "depth_cap": with_(OBS, "marked AS (SELECT sample, chrom, pos, coalesce(base, '-') AS base, bq, mq FROM obs)", select="""
      SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY mq, bq, base) <= 2"""),
    "joint_counts": with_(OBS, sites(), select=f"SELECT {SITE_COLUMNS} FROM sites"),
    "joint_counts_thresholds": with_(OBS, sites(10, 20), select=f"SELECT {SITE_COLUMNS} FROM sites"),
    "variant_base": with_(OBS, sites(), select="SELECT chrom, ref_base, var_base, count(*) AS sites, CAST(sum(b_N + b_T) AS BIGINT) AS variant_reads FROM sites GROUP BY ALL"),
    "site_depths": with_(OBS, sites(), select="SELECT a_N + b_N AS d_N, a_T + b_T AS d_T, count(*) AS sites FROM sites GROUP BY ALL"),
    "pair_join": with_(OBS, select="SELECT chrom, pos, " + ", ".join(
        f"count(*) FILTER (WHERE base = '{b}' AND sample = '{s}') AS n_{b}_{x}" for s, x in (("normal", "N"), ("tumour", "T")) for b in "ACGT")
        + " FROM obs GROUP BY chrom, pos HAVING count(DISTINCT sample) = 2"),
    "reference_lookup": with_(REFERENCE, select="""SELECT l_returnflag AS chrom, CAST(l_partkey + l_linenumber AS BIGINT) AS pos, ref_base, count(*) AS n
      FROM lineitem, last_position l JOIN reference r ON r.chrom = l_returnflag AND r.pos = least(l_partkey + l_linenumber, l.last_pos) GROUP BY ALL"""),
    "reference_interval": with_(REFERENCE, REGIONS, select="""SELECT g.chrom, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end",
      coalesce(string_agg(ref_base, '' ORDER BY r.pos), '') AS sequence
      FROM (SELECT *, row_number() OVER () AS id FROM regions) g LEFT JOIN reference r ON r.chrom = g.chrom AND r.pos >= "start" AND r.pos < "end"
      GROUP BY g.id, g.chrom, "start", "end" """),
    "positions_semi": with_(OBS, LISTED, select="""SELECT sample, chrom, pos, count(*) AS n, CAST(sum(bq) AS BIGINT) AS sum_bq
      FROM obs WHERE (chrom, pos) IN (SELECT chrom, pos FROM listed) GROUP BY ALL"""),
    "quality_histogram": with_(OBS, sites(5, 5), cells(5, 5), select="SELECT chrom, pos, s, round(q, 6) AS q, round(r, 6) AS r, count(*) AS n FROM cells GROUP BY ALL"),
    "phred_prob": with_(OBS, select="""SELECT bq, count(*) AS n, round(avg(1 - pow(10, -bq / 10.0)), 6) AS p,
      round(avg(pow(10, -bq / 10.0) / 3), 6) AS mismatch FROM obs GROUP BY bq"""),
    "read_likelihood": with_(OBS, "p AS (SELECT bq, mq, 1 - pow(10, -bq / 10.0) AS q, 1 - pow(10, -mq / 10.0) AS r FROM obs)", select="SELECT bq, mq, count(*) AS n, " + ", ".join(
        f"round(max({lik(str(m))}), 6) AS lik_{g}, round(max({m} * (0.5 + r * (q - 0.5)) / {lik(str(m))}), 6) AS exp_a_{g}, "
        f"round(max((1 - {m}) * (0.5 + r * (0.5 - q)) / {lik(str(m))}), 6) AS exp_b_{g}" for g, m in (("aa", 0.99), ("ab", 0.5), ("bb", 0.01)))
        + " FROM p GROUP BY bq, mq"),
    "log_beta": """WITH t AS (SELECT l_quantity, l_linenumber, l_quantity + 0.5 AS a, l_linenumber * 100.25 AS b FROM lineitem)
      SELECT l_quantity, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(max(lgamma(a) + lgamma(b) - lgamma(a + b)), 6) AS value FROM t GROUP BY ALL""",
    "log_sum_exp": """WITH t AS (SELECT l_returnflag, -l_quantity * 20 AS x, -l_extendedprice / 100 AS y, -l_discount * 9000 AS z FROM lineitem),
      u AS (SELECT *, greatest(x, y, z) + ln(exp(x - greatest(x, y, z)) + exp(y - greatest(x, y, z)) + exp(z - greatest(x, y, z))) AS lse FROM t)
      SELECT l_returnflag, round(sum(lse), 3) AS lse, round(sum(exp(x - lse)), 3) AS p0, round(sum(exp(y - lse)), 3) AS p1, round(sum(exp(z - lse)), 3) AS p2
      FROM u GROUP BY 1""",
    "simplex_normalise": """WITH t AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
      SELECT l_returnflag, l_linestatus, round(v / sum(v) OVER (PARTITION BY l_returnflag), 6) AS value FROM t""",
    "score_binomial": scored("binomial", f"SELECT {SITE_COLUMNS}, {rounded(POSTERIORS)} FROM scored"),
    "score_beta_binomial": scored("beta_binomial", f"SELECT {SITE_COLUMNS}, {rounded(POSTERIORS)} FROM scored"),
    "score_quality": scored("quality", f"SELECT {SITE_COLUMNS}, {rounded(POSTERIORS)} FROM scored"),
    "score_quality_arrays": scored("quality", f"SELECT {SITE_COLUMNS}, {rounded(POSTERIORS)} FROM scored", "TRUE"),
    "somatic_calls": scored("binomial", f"SELECT {RESULT}, {rounded(POSTERIORS)} FROM scored WHERE p_AA_AB + p_AA_BB >= 0.1"),
    "label_marginals": scored("binomial", "SELECT chrom, pos, " + ", ".join(f"round({e}, 6) AS p_{n}" for n, e in LABELS.items()) + " FROM scored"),
    "map_genotype": scored("binomial", f"SELECT chrom, pos, genotype, {LABEL} AS label FROM (SELECT chrom, pos, {BEST} AS genotype FROM scored)", "TRUE"),
    "hard_assignment": scored("binomial", "SELECT chrom, pos, " + ", ".join(
        f"CASE WHEN genotype = '{g}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_{g}" for g in JOINT) + f" FROM (SELECT chrom, pos, {BEST} AS genotype FROM scored)"),
    "genotype_long": scored("binomial", "\nUNION ALL ".join(
        f"SELECT chrom, pos, '{g}' AS joint_genotype, '{g[:2]}' AS normal_genotype, '{g[3:]}' AS tumour_genotype, round(p_{g}, 6) AS probability FROM scored" for g in JOINT)),
    "results_rows": scored("binomial", f"SELECT {RESULT}, " + ", ".join(f"printf('%.4f', {p}) AS {p}" for p in POSTERIORS) + " FROM scored"),
    "counts_rows": with_(OBS, sites(), select=f"SELECT chrom, pos + 1 AS \"position\", ref_base, var_base, {', '.join(COUNTS)} FROM sites"),
    "classify_reads": with_(READS, STEPS, ENTRIES, REFERENCE, READ_OBS, sites(5, 5), "picked AS (SELECT * FROM sites WHERE b_T > 0)", cells(5, 5, "picked"),
        start_params(), scores("quality", "picked", "theta0", "scored"),
        select=f"SELECT {RESULT}, {rounded(POSTERIORS)} FROM scored WHERE p_AA_AB + p_AA_BB >= 0.001"),
    "classify_positions": with_(READS, STEPS, ENTRIES, REFERENCE, READ_OBS, sites(), LISTED,
        "picked AS (SELECT * FROM sites WHERE chrom = 'R' AND (chrom, pos) IN (SELECT chrom, pos FROM listed))",
        start_params(), scores("binomial", "picked", "theta0", "scored"), select=f"SELECT {RESULT}, {rounded(POSTERIORS)} FROM scored"),
    "train_sites": with_(OBS, sites(), select=f"SELECT chrom, pos, {', '.join(COUNTS)} FROM sites WHERE {DEPTH_FILTER}"),
    "systematic_sample": with_(OBS, sites(), f"ordered AS (SELECT *, row_number() OVER (ORDER BY chrom, pos) AS i FROM sites WHERE {DEPTH_FILTER})",
        select=f"SELECT chrom, pos, {', '.join(COUNTS)} FROM ordered WHERE i % 3 = 0"),
    "count_histogram": with_(OBS, sites(), select=f"SELECT {', '.join(COUNTS)}, count(*) AS w FROM sites WHERE {DEPTH_FILTER} GROUP BY ALL"),
    **{f"ess_{m}": ess(m, f"SELECT {rounded(ess_columns(m), 4)} FROM stats") for m in LOGLIKS},
    **{f"train_{m}": em(m) for m in LOGLIKS},
}


def data_loglik() -> str:
    start = [OBS, sites(), f"train AS (SELECT * FROM sites WHERE {DEPTH_FILTER})", cells(source="train"), start_params()]
    ctes = [scores(m, "train", "theta0", f"e_{m}") for m in LOGLIKS]
    rows = [f"SELECT '{m}' AS model, round(sum(lse), 4) AS log_likelihood FROM e_{m}" for m in LOGLIKS]
    return with_(*start, *ctes, select="\nUNION ALL ".join(rows))


ORACLE["data_loglik"] = data_loglik()


def logliks_tempered(source: str, params: str) -> str:
    terms = ", ".join(f"(a_{s} * ln(mu_{s}_{g}) + b_{s} * ln(1 - mu_{s}_{g})) / 2 AS l_{s}_{g}" for s in "NT" for g in GENOTYPES)
    return f"SELECT x.*, pi.*, {terms} FROM {source} x, {params} pi"


LOGLIKS["tempered"] = logliks_tempered
ORACLE |= {
    "score_own_density": scored("tempered", f"SELECT {SITE_COLUMNS}, {rounded(POSTERIORS)} FROM scored"),
    "no_contig": with_(READS, select=f"""SELECT sample, chrom, count(*) AS reads, CAST(sum(pos) AS BIGINT) AS sum_pos
      FROM reads WHERE {KEPT} AND pos % 7 <> 0 GROUP BY ALL"""),
    "output_order": with_(OBS, sites(), select="""SELECT chrom, pos + 1 AS "position", row_number() OVER (ORDER BY chrom, pos) AS place FROM sites"""),
    "parameters_round_trip": f"""WITH w AS (SELECT {list(JOINT)}[l_partkey % 9 + 1] AS genotype, sum(l_quantity) AS value FROM lineitem GROUP BY 1),
      m AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'mu_N' ELSE 'mu_T' END AS component, {list(GENOTYPES)}[l_partkey % 3 + 1] AS genotype,
        avg(CASE WHEN l_linenumber > 2 THEN 0.75 ELSE 0.25 END) AS value FROM lineitem GROUP BY ALL)
      SELECT 'pi' AS component, genotype, round(value / sum(value) OVER (), 6) AS value FROM w
      UNION ALL SELECT component, genotype, round(value, 6) FROM m""",
}
ORACLE |= {
    "priors_round_trip": f"""SELECT 'pi' AS component, {list(JOINT)}[l_partkey % 9 + 1] AS genotype, round(count(*) / 100 + 1, 6) AS value FROM lineitem GROUP BY ALL
      UNION ALL SELECT CASE WHEN l_linestatus = 'F' THEN 'mu_N' ELSE 'mu_T' END || CASE WHEN l_linenumber > 2 THEN '_alpha' ELSE '_beta' END,
        {list(GENOTYPES)}[l_partkey % 3 + 1], round(sum(l_quantity), 6) FROM lineitem GROUP BY ALL""",
    "training_history": em("binomial", "SELECT CAST(step AS BIGINT) AS iteration, round(ll, 5) AS log_likelihood, round(ll - before, 5) AS change, "
        "round((ll - before) / abs(before), 5) AS relative_change, "
        + rounded([f"pi_{g}" for g in JOINT] + [f"mu_{s}_{g}" for s in "NT" for g in GENOTYPES], 5) + " FROM loop WHERE step > 0"),
}
ORACLE |= {f"{name}_wide": ORACLE[name] for name in ("reference_lookup", "reference_interval")}
