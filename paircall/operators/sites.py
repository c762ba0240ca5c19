"""Joint sites of a normal/tumour pair.

Observations of both samples are one table, so pairing needs no join: base counts are taken per
(chrom, pos, base) first, which combines map-side and spreads a very deep position over its bases,
and those few rows per position are then gathered per (chrom, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likelihood import read_likelihood
from ..functions.quality import mismatch_prob, phred_prob
from ..schema import BASE_CODES, COUNTS, GENOTYPES, NORMAL, NUCLEOTIDES, SAMPLES, SUFFIX, TUMOUR
from .once import compute_once
from .pileup import passes
from .reference import with_reference_base


def variant_base(ref: Column, totals: dict[str, Column]) -> Column:
    """Most frequent base that is not the reference, `N` if none occurs; ties go to the last letter."""
    ranked = F.greatest(*[
        F.when(ref != base, totals[base] * 4 + i).otherwise(i) for i, base in enumerate(NUCLEOTIDES)
    ])
    letter = F.element_at(F.array(*map(F.lit, NUCLEOTIDES)), (ranked % 4 + 1).cast("int"))
    return F.when(ranked >= 4, letter).otherwise("N")


def pick(base: Column, columns: dict[str, Column], default: Column) -> Column:
    """The column that belongs to `base`."""
    result = None
    for letter, column in columns.items():
        result = (F if result is None else result).when(base == letter, column)
    return result.otherwise(default)


def _is(sample: str) -> Column:
    return F.col("sample") == sample


def _keys(obs: DataFrame) -> list[str]:
    """Position keys; a reference base that comes with the observations is one per position."""
    return ["chrom", "pos"] + (["ref_base"] if "ref_base" in obs.columns else [])


def _with_reference(rows: DataFrame, reference: DataFrame | None) -> DataFrame:
    if "ref_base" in rows.columns:
        return rows
    if reference is None:
        raise ValueError("give a reference chunk table, or observations with a ref_base column")
    return with_reference_base(rows, reference)


def _per_base(obs: DataFrame, min_bq: int, min_mq: int, *extra: Column) -> DataFrame:
    """Counts per position and base; entries that do not count share a row with a null base.

    That row keeps alive positions that are covered only by deletions or by low qualities.
    """
    counted = obs.withColumn("base", F.when(passes(min_bq, min_mq), F.col("base")))
    return counted.groupBy(*_keys(obs), "base").agg(
        *[F.count_if(_is(s)).alias(f"n_{SUFFIX[s]}") for s in SAMPLES], *extra
    )


def _gather(rows: DataFrame, *extra: Column) -> DataFrame:
    """Per-base rows to one row per position that both samples cover."""
    matches = F.col("base") == F.col("ref_base")
    sums = []
    for s in "NT":
        n = F.col(f"n_{s}")
        sums.append(F.sum(n).alias(f"_cover_{s}"))
        sums.append(F.sum(F.when(matches, n).otherwise(0)).alias(f"a_{s}"))
        sums += [F.sum(F.when(F.col("base") == b, n).otherwise(0)).alias(f"_{b}_{s}") for b in NUCLEOTIDES]
    sites = rows.groupBy("chrom", "pos", "ref_base").agg(*sums, *extra).where("_cover_N > 0 AND _cover_T > 0")
    totals = {b: F.col(f"_{b}_N") + F.col(f"_{b}_T") for b in NUCLEOTIDES}
    sites = compute_once(sites, {"var_base": variant_base(F.col("ref_base"), totals)})
    zero = F.lit(0).cast("long")
    return sites.withColumns({
        f"b_{s}": pick(F.col("var_base"), {b: F.col(f"_{b}_{s}") for b in NUCLEOTIDES}, zero) for s in "NT"
    })


def joint_counts(
    obs: DataFrame, reference: DataFrame | None = None, min_bq: int = 0, min_mq: int = 0
) -> DataFrame:
    """`chrom, pos, ref_base, var_base, a_N, b_N, a_T, b_T` of every position that both samples cover.

    One aggregation by position: each base letter has its own conditional sum, which combines map-side also at a deep
    position. Which sum is the reference's is known at once where the observations carry it, else after the lookup.
    """
    counts = passes(min_bq, min_mq)
    given = "ref_base" in obs.columns
    letters = NUCLEOTIDES if given else tuple(BASE_CODES)
    sums = []
    for s in SAMPLES:
        mine, n = _is(s), SUFFIX[s]
        sums.append(F.count_if(mine).alias(f"_cover_{n}"))
        sums += [F.count_if(mine & counts & (F.col("base") == b)).alias(f"_{b}_{n}") for b in letters]
        if given:
            sums.append(F.count_if(mine & counts & (F.col("base") == F.col("ref_base"))).alias(f"a_{n}"))
    sites = obs.groupBy(*_keys(obs)).agg(*sums).where("_cover_N > 0 AND _cover_T > 0")
    zero = F.lit(0).cast("long")
    if not given:
        sites = _with_reference(sites, reference).withColumns({
            f"a_{n}": pick(F.col("ref_base"), {b: F.col(f"`_{b}_{n}`") for b in letters}, zero) for n in "NT"
        })
    totals = {b: F.col(f"_{b}_N") + F.col(f"_{b}_T") for b in NUCLEOTIDES}
    sites = compute_once(sites, {"var_base": variant_base(F.col("ref_base"), totals)})
    return sites.withColumns({
        f"b_{n}": pick(F.col("var_base"), {b: F.col(f"_{b}_{n}") for b in NUCLEOTIDES}, zero) for n in "NT"
    }).select("chrom", "pos", "ref_base", "var_base", *COUNTS)


def pair_counts(normal: DataFrame, tumour: DataFrame) -> DataFrame:
    """Inner join on position of two already aggregated tables `chrom, pos, n_A ... n_T`."""
    letters = [f"n_{b}" for b in NUCLEOTIDES]
    side = lambda df, s: df.select("chrom", "pos", *[F.col(c).alias(f"{c}_{s}") for c in letters])
    return side(normal, "N").join(side(tumour, "T"), ["chrom", "pos"])


def joint_qualities(
    obs: DataFrame, reference: DataFrame | None = None, min_bq: int = 0, min_mq: int = 0
) -> DataFrame:
    """Counts as in `joint_counts` with `reads_N`, `reads_T`: `array<struct<q,r,n>>`, third alleles dropped.

    Reads are counted per (position, sample, base, bq, mq) before anything is collected, so the arrays
    are bounded by the number of distinct qualities and not by the depth.
    """
    ok = passes(min_bq, min_mq)
    cells = obs.select(
        *_keys(obs),
        (_is(TUMOUR)).alias("is_tumour"),
        F.when(ok, F.col("base")).alias("base"),
        F.when(ok, F.col("bq")).alias("bq"),
        F.when(ok, F.col("mq")).alias("mq"),
        F.col("sample").isin(*SAMPLES).alias("known"),
    ).where("known")
    cells = cells.groupBy(*_keys(obs), "is_tumour", "base", "bq", "mq").agg(F.count("*").alias("n"))
    cells = _with_reference(cells, reference).withColumns({
        "n_N": F.when(F.col("is_tumour"), 0).otherwise(F.col("n")),
        "n_T": F.when(F.col("is_tumour"), F.col("n")).otherwise(0),
    })
    cell = F.when(F.col("base").isNotNull(), F.struct("is_tumour", "base", "bq", "mq", "n"))
    sites = _gather(cells, F.collect_list(cell).alias("_cells"))
    ref, var = F.col("ref_base"), F.col("var_base")

    def reads(tumour: bool) -> Column:
        kept = F.filter(
            "_cells",
            lambda c: (c["is_tumour"] == tumour) & ((c["base"] == ref) | ((c["base"] == var) & (var != "N"))),
        )
        prob = lambda c: phred_prob(c["bq"].cast("double"))
        return F.transform(
            kept,
            lambda c: F.struct(
                F.when(c["base"] == ref, prob(c)).otherwise(mismatch_prob(prob(c))).alias("q"),
                phred_prob(c["mq"].cast("double")).alias("r"),
                c["n"].alias("n"),
            ),
        )

    return sites.select(
        "chrom", "pos", "ref_base", "var_base", *COUNTS, reads(False).alias("reads_N"), reads(True).alias("reads_T")
    )


def quality_cells(
    obs: DataFrame, reference: DataFrame | None = None, min_bq: int = 0, min_mq: int = 0
) -> DataFrame:
    """Counts as in `joint_counts`, one row per site, sample and distinct (q, r) with a count: `s, q, r, n`.

    The long form of `joint_qualities`, which gathers nothing: reads are counted per (position, sample, base, bq, mq),
    and a window over a position's cells tells each of them the variant base and the counts of its site. Cells of third
    alleles, and of bases that do not count, have a null `s`: they keep a site without other reads.
    """
    ok = passes(min_bq, min_mq)
    graded = [F.when(ok, F.col(c)).alias(c) for c in ("base", "bq", "mq")]
    cells = obs.where(F.col("sample").isin(*SAMPLES)).select(*_keys(obs), F.when(_is(TUMOUR), "T").otherwise("N").alias("s"), *graded)
    cells = _with_reference(cells.groupBy(*_keys(obs), "s", "base", "bq", "mq").agg(F.count("*").alias("n")), reference)
    site = Window.partitionBy("chrom", "pos")
    total = lambda s, which: F.sum(F.when((F.col("s") == s) & which, F.col("n")).otherwise(0)).over(site)
    sums = {}
    for s in "NT":
        sums[f"_cover_{s}"] = total(s, F.lit(True))
        sums[f"a_{s}"] = total(s, F.col("base") == F.col("ref_base"))
        sums |= {f"_{b}_{s}": total(s, F.col("base") == b) for b in NUCLEOTIDES}
    cells = cells.withColumns(sums).where("_cover_N > 0 AND _cover_T > 0")
    totals = {b: F.col(f"_{b}_N") + F.col(f"_{b}_T") for b in NUCLEOTIDES}
    cells = compute_once(cells, {"var_base": variant_base(F.col("ref_base"), totals)})
    zero, ref = F.lit(0).cast("long"), F.col("base") == F.col("ref_base")
    cells = cells.withColumns({f"b_{s}": pick(F.col("var_base"), {b: F.col(f"_{b}_{s}") for b in NUCLEOTIDES}, zero) for s in "NT"})
    kept = ref | ((F.col("base") == F.col("var_base")) & (F.col("var_base") != "N"))
    prob = phred_prob(F.col("bq").cast("double"))
    read = {
        "s": F.col("s"),
        "q": F.when(ref, prob).otherwise(mismatch_prob(prob)),
        "r": phred_prob(F.col("mq").cast("double")),
        "n": F.col("n"),
    }
    return cells.select("chrom", "pos", "ref_base", "var_base", *COUNTS, *[F.when(kept, c).alias(name) for name, c in read.items()])


def joint_quality_loglik(
    obs: DataFrame, mu_N: tuple, mu_T: tuple, reference: DataFrame | None = None, min_bq: int = 0, min_mq: int = 0
) -> DataFrame:
    """Counts as in `joint_counts` with `l_N_AA ... l_T_BB`, the quality-model log-likelihood per genotype.

    Which reads are reference and which variant is known only once a position is gathered. So each
    base sums its log-likelihood both as a match and as a mismatch, and the position then picks the
    match sums of the reference base and the mismatch sums of the variant base. No read is collected.
    """
    bq, mq = F.col("bq").cast("double"), F.col("mq").cast("double")
    as_match, as_mismatch, r = phred_prob(bq), mismatch_prob(phred_prob(bq)), phred_prob(mq)
    terms = [(s, g, mu) for s, mus in ((NORMAL, mu_N), (TUMOUR, mu_T)) for g, mu in zip(GENOTYPES, mus)]
    sums, picked = [], []
    for sample, g, mu in terms:
        s = SUFFIX[sample]
        for kind, q in (("m", F.col("_q")), ("x", F.col("_qx"))):
            loglik = F.ln(read_likelihood(q, F.col("_r"), mu))
            sums.append(F.sum(F.when(_is(sample), loglik).otherwise(0.0)).alias(f"_{kind}_{s}_{g}"))
        picked.append(F.sum(F.when(F.col("base") == F.col("ref_base"), F.col(f"_m_{s}_{g}")).otherwise(0.0)).alias(f"_ref_{s}_{g}"))
        picked += [
            F.sum(F.when(F.col("base") == b, F.col(f"_x_{s}_{g}")).otherwise(0.0)).alias(f"_{b}_{s}_{g}")
            for b in NUCLEOTIDES
        ]
    graded = obs.withColumns({"_q": as_match, "_qx": as_mismatch, "_r": r})
    rows = _with_reference(_per_base(graded, min_bq, min_mq, *sums), reference)
    sites = _gather(rows, *picked)
    return sites.select(
        "chrom", "pos", "ref_base", "var_base", *COUNTS,
        *[
            (F.col(f"_ref_{SUFFIX[s]}_{g}")
             + pick(F.col("var_base"), {b: F.col(f"_{b}_{SUFFIX[s]}_{g}") for b in NUCLEOTIDES}, F.lit(0.0))
             ).alias(f"l_{SUFFIX[s]}_{g}")
            for s, g, _ in terms
        ],
    )


def depths(sites: DataFrame) -> DataFrame:
    """Add `d_N`, `d_T`, the reference plus variant depth of each sample."""
    return sites.withColumns({f"d_{s}": F.col(f"a_{s}") + F.col(f"b_{s}") for s in "NT"})


def variant_sites(sites: DataFrame) -> DataFrame:
    """Sites with a variant read in the tumour."""
    return sites.where(F.col("b_T") > 0)


def in_depth_range(
    sites: DataFrame,
    min_normal: int = 10,
    max_normal: int = 100,
    min_tumour: int = 10,
    max_tumour: int = 100,
) -> DataFrame:
    """Sites whose depths lie within both ranges, ends included."""
    return sites.where(
        (F.col("a_N") + F.col("b_N")).between(min_normal, max_normal)
        & (F.col("a_T") + F.col("b_T")).between(min_tumour, max_tumour)
    )
