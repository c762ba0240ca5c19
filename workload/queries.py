"""One query per operator family; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paircall.functions import bases, cigar, flags, likelihood, logspace, quality, tags
from paircall.functions import regions as region_functions
from paircall.models import MODELS, BinomialParams, BinomialPriors, expected_statistics, score, training_table
from paircall.models.density import LOGLIKS, Binomial, model_by_name
from paircall.operators import labels, pileup, positions, ranges, reads, reference, sites
from paircall.operators.sampling import genome_rank
from paircall.operators.sizing import spread
from paircall.plans import classify, paired_observations, train, training_rows, training_sites
from paircall.plans.classify import scored_sites
from paircall.schema import COUNTS, GENOTYPES, JOINT_GENOTYPES, POSTERIORS
from paircall.sinks import results_table, results_text, write_history, write_params
from paircall.sinks.tables import counts_table, in_order
from paircall.sources import read_params, read_priors
from paircall.sources.sam import parse_contigs, parse_read_groups
from paircall.sources.tables import parse_positions

from . import inputs
from .inputs import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DEPTHS = dict(min_normal_depth=5, max_normal_depth=20, min_tumour_depth=5, max_tumour_depth=20)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Comparable values: doubles rounded, integers as long."""
    chosen = set(columns)
    kinds = dict(df.dtypes)
    return df.select(*[
        F.round(c, digits).alias(c) if c in chosen else long(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c)
        for c in df.columns
    ])


# ---- reads ----------------------------------------------------------------------------------------


@query
def sam_scan(spark, sf):
    df = inputs.reads(spark, sf).drop("tags")
    return rounded(df, [])


@query
def contig_list(spark, sf):
    return rounded(parse_contigs(inputs.header_lines(spark, sf)), [])


@query
def contig_intersect(spark, sf):
    part = [parse_contigs(inputs.header_lines(spark, sf, s)) for s in ("normal", "tumour")]
    listed = parse_positions(inputs.position_lines(spark, sf))
    return reads.shared_contigs(*part, listed)


@query
def flag_filter(spark, sf):
    kept = reads.filter_flags(inputs.reads(spark, sf))
    return kept.groupBy("sample", "chrom", long("flag")).agg(
        F.count("*").alias("reads"), F.sum("mapq").alias("sum_mapq"), F.sum("pos").alias("sum_pos")
    )


@query
def no_contig(spark, sf):
    """Reads that lie on no contig go with the flag filter."""
    df = inputs.reads(spark, sf).withColumn("chrom", F.when(F.col("pos") % 7 == 0, "*").otherwise(F.col("chrom")))
    return reads.filter_flags(df).groupBy("sample", "chrom").agg(F.count("*").alias("reads"), F.sum("pos").alias("sum_pos"))


@query
def flag_decode(spark, sf):
    df = reads.decode_flags(inputs.reads(spark, sf))
    return df.groupBy(long("flag"), "flag_letters", "is_paired", "is_reverse", "is_mate_reverse", "is_read1", "is_duplicate").agg(
        F.count("*").alias("reads")
    )


@query
def flag_parse(spark, sf):
    """Every flag in decimal, hexadecimal, octal and letters."""
    value = F.col("l_suppkey").cast("int")
    forms = F.array(
        value.cast("string"),
        F.concat(F.lit("0x"), F.hex(value)),
        F.concat(F.lit("0"), F.conv(value.cast("string"), 10, 8)),
        F.concat(flags.flag_letters(value), F.lit("z")),
    )
    df = table(spark, sf, "lineitem").select(value.alias("value"), F.posexplode(forms).alias("form", "text"))
    return df.groupBy(long("value"), long("form"), long_of(flags.parse_flag(F.col("text")), "parsed")).agg(F.count("*").alias("n"))


def long_of(column: Column, name: str) -> Column:
    return column.cast("long").alias(name)


@query
def cigar_spans(spark, sf):
    df = inputs.reads(spark, sf)
    return df.groupBy("cigar", long("pos")).agg(
        F.max(cigar.reference_end(F.col("pos"), F.col("cigar"))).cast("long").alias("end"),
        F.sum(cigar.query_length(F.col("cigar"))).alias("query_bases"),
        F.sum(F.aggregate(cigar.parse_cigar(F.col("cigar")), F.lit(0), lambda n, _: n + 1)).alias("operations"),
    )


@query
def record_validation(spark, sf):
    """Records broken in several ways and the error found for each."""
    df = inputs.reads(spark, sf)
    how = F.col("pos") % 6
    broken = df.withColumns({
        "cigar": F.when(how == 1, "5M5Z").when(how == 2, "5M-").when(how == 3, "4M").otherwise(F.col("cigar")),
        "qual": F.when(how == 4, "II").otherwise(F.col("qual")),
        "qname": F.when(how == 5, "").otherwise(F.col("qname")),
    })
    return reads.validate(broken).groupBy("sample", "error").agg(F.count("*").alias("reads"))


@query
def base_normalise(spark, sf):
    """Document text as sequence letters: whole texts, counted by normalised letter."""
    df = table(spark, sf, "documents").select("doc_id", bases.normalise_bases(F.col("text")).alias("seq"))
    return df.select("doc_id", F.length("seq").cast("long").alias("letters"), F.md5("seq").alias("digest"))


@query
def tag_lookup(spark, sf):
    t = F.col("tags")
    df = inputs.reads(spark, sf).select(
        tags.tag_string(t, "RG").alias("rg"),
        tags.tag_int(t, "NM").alias("nm"),
        tags.tag_char(t, "XT").alias("xt"),
        tags.tag_float(t, "XF").cast("double").alias("xf"),
        tags.tag(t, "ZZ").alias("zz"),
        tags.tag_int(t, "RG").alias("not_a_number"),
    )
    return df.groupBy("rg", "nm", "xt", "xf", "zz", "not_a_number").agg(F.count("*").alias("reads"))


@query
def tag_edit(spark, sf):
    t = F.col("tags")
    df = inputs.reads(spark, sf).select(
        F.array_join(F.array_sort(F.map_keys(tags.drop_tags(t, "NM", "XT"))), ",").alias("dropped"),
        F.array_join(F.map_keys(tags.keep_tag(t, "RG")), ",").alias("kept"),
        tags.tag(tags.add_tag(t, "XQ", "i", F.col("mapq")), "XQ").alias("added"),
        tags.tag(tags.add_tag(t, "XT", "A", F.lit("z")), "XT").alias("unchanged"),
    )
    return df.groupBy("dropped", "kept", "added", "unchanged").agg(F.count("*").alias("reads"))


@query
def library_join(spark, sf):
    groups = parse_read_groups(inputs.header_lines(spark, sf))
    return reads.with_library(inputs.reads(spark, sf), groups).groupBy("sample", "library").agg(F.count("*").alias("reads"))


@query
def contig_stats(spark, sf):
    df = inputs.reads(spark, sf)
    lost = df.withColumn("chrom", F.when(F.col("pos") % 7 == 0, "*").otherwise(F.col("chrom")))
    return reads.contig_stats(lost, parse_contigs(inputs.header_lines(spark, sf)))


@query
def region_scan(spark, sf):
    return rounded(reads.in_region(inputs.reads(spark, sf), "N", 100, 700).select("sample", "qname", "chrom", "pos", "cigar"), [])


@query
def region_overlap(spark, sf):
    pairs = ranges.overlap_pairs(inputs.reads(spark, sf), inputs.regions(spark, sf))
    return pairs.groupBy("chrom", "region", long("region_start"), long("region_end")).agg(
        F.count("*").alias("reads"), F.sum("pos").alias("sum_pos"), F.sum("mapq").alias("sum_mapq")
    )


@query
def region_reads(spark, sf):
    hit = ranges.in_regions(inputs.reads(spark, sf), inputs.regions(spark, sf))
    return hit.groupBy("sample", "chrom", long("pos"), "cigar").agg(F.count("*").alias("reads"))


@query
def region_parse(spark, sf):
    """Region strings in several spellings."""
    key = F.col("l_partkey")
    forms = F.array(
        F.col("l_returnflag"),
        F.concat("l_returnflag", F.lit(":"), (key + 1).cast("string")),
        F.concat("l_returnflag", F.lit(":"), F.format_number(key * 1000 + 1, 0), F.lit("-"), F.format_number(key * 1000 + 500, 0)),
        F.concat("l_returnflag", F.lit(" : "), (key + 1).cast("string"), F.lit(" - "), (key + 9).cast("string")),
        F.concat(F.lit("HLA:"), "l_returnflag", F.lit(":x-"), key.cast("string")),
    )
    df = spread(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")).select(F.posexplode(forms).alias("form", "text"))
    r = region_functions.parse_region(F.col("text"))
    return df.select("form", r.alias("r")).groupBy(long("form"), "r.chrom", "r.start", "r.end").agg(F.count("*").alias("n"))


@query
def genomic_bin(spark, sf):
    start = F.col("l_orderkey") * 4099 % 500_000_000
    end = start + F.pow(F.lit(10), F.col("l_linenumber")).cast("long")
    df = table(spark, sf, "lineitem").select(region_functions.genomic_bin(start, end).cast("long").alias("bin"))
    return df.groupBy("bin").agg(F.count("*").alias("reads"))


# ---- pileup ---------------------------------------------------------------------------------------


@query
def pileup_expand(spark, sf):
    obs = pileup.expand(reads.filter_flags(inputs.reads(spark, sf)))
    return obs.groupBy("sample", "chrom", long("pos"), "base").agg(
        F.count("*").alias("n"), F.sum("bq").alias("sum_bq"), F.sum("mq").alias("sum_mq")
    )


@query
def pileup_indels(spark, sf):
    obs = pileup.expand(reads.filter_flags(inputs.reads(spark, sf)), annotate=True)
    return obs.groupBy("sample", "chrom", long("pos"), long("indel"), "is_del", "is_refskip", "is_head", "is_tail").agg(
        F.count("*").alias("n")
    )


@query
def coverage_depth(spark, sf):
    return rounded(pileup.coverage(pileup.expand(reads.filter_flags(inputs.reads(spark, sf)))), [])


@query
def base_counts(spark, sf):
    return rounded(pileup.base_counts(inputs.observations(spark, sf), 10, 10), [])


@query
def base_histogram(spark, sf):
    return rounded(pileup.base_histogram(inputs.observations(spark, sf), 0, 20), [])


@query
def multi_sample_pileup(spark, sf):
    """Three samples: the return flag names the sample, the line status the contig."""
    obs = inputs.observations(spark, sf)
    three = obs.select(F.col("chrom").alias("sample"), F.col("sample").alias("chrom"), "pos", "base")
    return rounded(pileup.multi_sample(three, list(inputs.CONTIGS)), [])


@query
def depth_cap(spark, sf):
    """The two entries with the lowest (mq, bq, base) of each sample and position."""
    obs = inputs.observations(spark, sf).withColumn("base", F.coalesce("base", F.lit("-")))
    kept = pileup.cap_depth(obs, 2, order=("mq", "bq", "base"))
    return rounded(kept.select("sample", "chrom", "pos", "base", "bq", "mq"), [])


# ---- sites ----------------------------------------------------------------------------------------


def site_counts(spark, sf, **options):
    return sites.joint_counts(inputs.observations(spark, sf), **options)


@query
def joint_counts(spark, sf):
    return rounded(site_counts(spark, sf), [])


@query
def joint_counts_thresholds(spark, sf):
    return rounded(site_counts(spark, sf, min_bq=10, min_mq=20), [])


@query
def variant_base(spark, sf):
    return site_counts(spark, sf).groupBy("chrom", "ref_base", "var_base").agg(
        F.count("*").alias("sites"), F.sum(F.col("b_N") + F.col("b_T")).alias("variant_reads")
    )


@query
def site_depths(spark, sf):
    return sites.depths(site_counts(spark, sf)).groupBy("d_N", "d_T").agg(F.count("*").alias("sites"))


@query
def pair_join(spark, sf):
    counts = pileup.base_counts(inputs.observations(spark, sf))
    normal, tumour = (counts.where(F.col("sample") == s) for s in ("normal", "tumour"))
    return rounded(sites.pair_counts(normal, tumour), [])


@query
def reference_lookup(spark, sf):
    """Bases at item positions shifted by the line number; the last ones lie past the contig end."""
    at = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") + F.col("l_linenumber")).cast("int").alias("pos")
    )
    found = reference.with_reference_base(at, inputs.reference_chunks(spark, sf))
    return found.groupBy("chrom", long("pos"), "ref_base").agg(F.count("*").alias("n"))


@query
def reference_interval(spark, sf):
    intervals = inputs.regions(spark, sf).select("chrom", "start", "end")
    return rounded(reference.fetch_intervals(intervals, inputs.reference_chunks(spark, sf)), [])


@query
def reference_lookup_wide(spark, sf):
    """The same through chunks of another width."""
    at = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") + F.col("l_linenumber")).cast("int").alias("pos")
    )
    found = reference.with_reference_base(at, reference.chunk_table(inputs.reference_bases(spark, sf), 1000))
    return found.groupBy("chrom", long("pos"), "ref_base").agg(F.count("*").alias("n"))


@query
def reference_interval_wide(spark, sf):
    intervals = inputs.regions(spark, sf).select("chrom", "start", "end")
    return rounded(reference.fetch_intervals(intervals, reference.chunk_table(inputs.reference_bases(spark, sf), 77)), [])


@query
def positions_semi(spark, sf):
    listed = parse_positions(inputs.position_lines(spark, sf))
    at = positions.at_positions(inputs.observations(spark, sf), listed)
    return at.groupBy("sample", "chrom", long("pos")).agg(F.count("*").alias("n"), F.sum("bq").alias("sum_bq"))


@query
def quality_histogram(spark, sf):
    """Per-read probabilities of each joint site, as (q, r) with a count."""
    cells = sites.quality_cells(inputs.observations(spark, sf), min_bq=5, min_mq=5).where("s IS NOT NULL")
    long_form = cells.select("chrom", "pos", "s", F.round("q", 6).alias("q"), F.round("r", 6).alias("r"), "n")
    return rounded(long_form.groupBy("chrom", "pos", "s", "q", "r").agg(F.sum("n").alias("n")), [])


# ---- scalar functions -----------------------------------------------------------------------------


@query
def phred_prob(spark, sf):
    p = quality.phred_prob(F.col("bq").cast("double"))
    df = inputs.observations(spark, sf).select("bq", p.alias("p"), quality.mismatch_prob(p).alias("mismatch"))
    return rounded(df.groupBy("bq").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("mismatch").alias("mismatch")), ["p", "mismatch"])


@query
def read_likelihood(spark, sf):
    """Likelihood and expected alleles of each observation at three allele probabilities."""
    q, r = F.col("q"), F.col("r")
    df = inputs.observations(spark, sf).select(
        "bq", "mq", quality.phred_prob(F.col("bq").cast("double")).alias("q"), quality.phred_prob(F.col("mq").cast("double")).alias("r")
    )
    columns = {}
    for name, mu in (("aa", 0.99), ("ab", 0.5), ("bb", 0.01)):
        columns[f"lik_{name}"] = likelihood.read_likelihood(q, r, mu)
        columns[f"exp_a_{name}"] = likelihood.expected_a(q, r, mu)
        columns[f"exp_b_{name}"] = likelihood.expected_b(q, r, mu)
    out = df.withColumns(columns).groupBy("bq", "mq").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in columns])
    return rounded(out, columns)


@query
def log_beta(spark, sf):
    value = likelihood.ln_beta(F.col("l_quantity") + 0.5, F.col("l_linenumber") * 100.25)
    df = table(spark, sf, "lineitem").groupBy("l_quantity", long("l_linenumber")).agg(F.max(value).alias("value"))
    return rounded(df, ["value"])


@query
def log_sum_exp(spark, sf):
    logs = F.array(-F.col("l_quantity") * 20, -F.col("l_extendedprice") / 100, -F.col("l_discount") * 9000)
    share = logspace.log_normalise_array(logs)
    df = table(spark, sf, "lineitem").select("l_returnflag", logspace.log_sum_exp_array(logs).alias("lse"), share.alias("p"))
    out = df.groupBy("l_returnflag").agg(
        F.sum("lse").alias("lse"), *[F.sum(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)]
    )
    return rounded(out, ["lse", "p0", "p1", "p2"], 3)


@query
def simplex_normalise(spark, sf):
    values = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("value"))
    return rounded(values.withColumn("value", logspace.simplex(F.col("value"), "l_returnflag")), ["value"])


# ---- scoring --------------------------------------------------------------------------------------


def scored(spark, sf, model, **options):
    return scored_sites(inputs.observations(spark, sf), model=model, **options)


@query
def score_binomial(spark, sf):
    return rounded(scored(spark, sf, "binomial"), POSTERIORS)


@query
def score_beta_binomial(spark, sf):
    return rounded(scored(spark, sf, "beta_binomial"), POSTERIORS)


@query
def score_quality(spark, sf):
    return rounded(scored(spark, sf, "quality"), POSTERIORS)


@query
def score_quality_arrays(spark, sf):
    """The quality model on collected reads, all positions."""
    df = sites.joint_qualities(inputs.observations(spark, sf))
    return rounded(score(df, model="quality").drop("reads_N", "reads_T"), POSTERIORS)


@query
def somatic_calls(spark, sf):
    obs = inputs.observations(spark, sf)
    return rounded(results_table(classify(obs, model="binomial", somatic_threshold=0.1)), POSTERIORS)


@query
def label_marginals(spark, sf):
    df = labels.marginals(scored(spark, sf, "binomial"))
    names = ["p_wildtype", "p_somatic", "p_germline", "p_loh", "p_error"]
    return rounded(df.select("chrom", "pos", *names), names)


@query
def map_genotype(spark, sf):
    df = labels.map_genotype(scored(spark, sf, "binomial", all_positions=True))
    return rounded(df.select("chrom", "pos", "genotype", "label"), [])


@query
def hard_assignment(spark, sf):
    df = labels.hard_assign(scored(spark, sf, "binomial"))
    return rounded(df.select("chrom", "pos", *POSTERIORS), [])


@query
def genotype_long(spark, sf):
    df = labels.to_long(scored(spark, sf, "binomial").select("chrom", "pos", *POSTERIORS))
    return rounded(df, ["probability"])


@query
def results_rows(spark, sf):
    """Result rows as the text sink writes them."""
    return rounded(results_text(scored(spark, sf, "binomial")), [])


@query
def counts_rows(spark, sf):
    return rounded(counts_table(site_counts(spark, sf)), [])


@query
def output_order(spark, sf):
    """Places of the sites in the order in which the sinks write them."""
    # Places are counted within blocks of positions and the blocks before are added: no window holds all sites.
    placed = genome_rank(site_counts(spark, sf)).select("chrom", (F.col("pos") + 1).alias("position"), F.col("rank").cast("int").alias("place"))
    return in_order(placed, "position")


class Tempered(Binomial):
    """A density of one's own: every read counts half."""

    name = "tempered"

    def with_loglik(self, sites, params):
        found = super().with_loglik(sites, params)
        return found.withColumns({c: F.col(c) / 2 for c in LOGLIKS})


@query
def score_own_density(spark, sf):
    return rounded(scored(spark, sf, Tempered()), POSTERIORS)


def parameter_rows(spark, sf):
    """Rows of a parameter table from the items: weights of the joint genotypes, mu between 0 and 1."""
    items = table(spark, sf, "lineitem")
    joint = F.element_at(F.array(*map(F.lit, JOINT_GENOTYPES)), (F.col("l_partkey") % 9 + 1).cast("int"))
    weights = items.groupBy(joint.alias("genotype")).agg(F.sum("l_quantity").alias("value")).select(F.lit("PI").alias("component"), "genotype", "value")
    single = F.element_at(F.array(*map(F.lit, GENOTYPES)), (F.col("l_partkey") % 3 + 1).cast("int"))
    share = F.avg(F.when(F.col("l_linenumber") > 2, 0.75).otherwise(0.25))
    mu = items.groupBy(F.when(F.col("l_linestatus") == "F", "mu_N").otherwise("mu_T").alias("component"), single.alias("genotype")).agg(share.alias("value"))
    return weights.unionByName(mu)


def shared_path(spark, name):
    """A new folder that all executors see: where the session keeps checkpoints, else its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def parameters_round_trip(spark, sf):
    """Parameters of the items, written as a table and read back; weights add up to one."""
    path = shared_path(spark, "parameters")
    write_params(spark, BinomialParams.from_rows([tuple(r) for r in parameter_rows(spark, sf).collect()]), path)
    rows = read_params(spark, path, "binomial").to_rows()
    return rounded(spark.createDataFrame(rows, "component string, genotype string, value double"), ["value"])


def prior_rows(spark, sf):
    """Rows of a table of priors from the items: a joint genotype's prior is one and its items, mu's are sums of sizes."""
    items = table(spark, sf, "lineitem")
    joint = F.element_at(F.array(*map(F.lit, JOINT_GENOTYPES)), (F.col("l_partkey") % 9 + 1).cast("int"))
    weights = items.groupBy(joint.alias("genotype")).agg((F.count("*") / 100 + 1).alias("value")).select(F.lit("pi").alias("component"), "genotype", "value")
    single = F.element_at(F.array(*map(F.lit, GENOTYPES)), (F.col("l_partkey") % 3 + 1).cast("int"))
    sample = F.when(F.col("l_linestatus") == "F", "mu_N").otherwise("mu_T")
    side = F.when(F.col("l_linenumber") > 2, "_alpha").otherwise("_beta")
    shapes = items.groupBy(F.concat(sample, side).alias("component"), single.alias("genotype")).agg(F.sum("l_quantity").alias("value"))
    return weights.unionByName(shapes)


@query
def priors_round_trip(spark, sf):
    """Priors from the items, written as a table and read back; they are no shares, so nothing is normalised."""
    path = shared_path(spark, "priors")
    write_params(spark, BinomialPriors.from_rows([tuple(r) for r in prior_rows(spark, sf).collect()]), path)
    rows = read_priors(spark, path, "binomial").to_rows()
    return rounded(spark.createDataFrame(rows, "component string, genotype string, value double"), ["value"])


@query
def classify_reads(spark, sf):
    """From SAM text to calls: flag filter, pileup, reference, counting, quality model."""
    obs = paired_observations(inputs.reads(spark, sf, "normal"), inputs.reads(spark, sf, "tumour"))
    calls = classify(obs, inputs.reference_chunks(spark, sf), min_bq=5, min_mq=5, somatic_threshold=0.001)
    return rounded(results_table(calls), POSTERIORS)


@query
def classify_positions(spark, sf):
    """The same at listed positions of one chromosome, with the binomial model and all positions."""
    listed = parse_positions(inputs.position_lines(spark, sf))
    obs = paired_observations(inputs.reads(spark, sf, "normal"), inputs.reads(spark, sf, "tumour"), chromosome="R", positions=listed)
    return rounded(results_table(classify(obs, inputs.reference_chunks(spark, sf), "binomial", all_positions=True)), POSTERIORS)


# ---- training -------------------------------------------------------------------------------------


def training(spark, sf, model, skip=1):
    return training_sites(inputs.observations(spark, sf), model=model, skip=skip, **DEPTHS)


@query
def train_sites(spark, sf):
    return rounded(training(spark, sf, "binomial").select("chrom", "pos", *COUNTS), [])


@query
def systematic_sample(spark, sf):
    return rounded(training(spark, sf, "binomial", skip=3).select("chrom", "pos", *COUNTS), [])


@query
def count_histogram(spark, sf):
    """Compressed training set of the count models."""
    return training_table(training(spark, sf, "binomial"), "binomial")


def statistics(spark, sf, model):
    density = model_by_name(model)
    rows = training_rows(inputs.observations(spark, sf), model=model, **DEPTHS)
    out = expected_statistics(rows, density.params_type(), model)
    return rounded(out, out.columns, 4)


@query
def ess_binomial(spark, sf):
    return statistics(spark, sf, "binomial").drop("log_likelihood")


@query
def ess_beta_binomial(spark, sf):
    return statistics(spark, sf, "beta_binomial").drop("log_likelihood")


@query
def ess_quality(spark, sf):
    return statistics(spark, sf, "quality").drop("log_likelihood")


@query
def data_loglik(spark, sf):
    parts = [statistics(spark, sf, m).select(F.lit(m).alias("model"), "log_likelihood") for m in MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trained(spark, sf, model):
    """Trained to convergence on every third site: parameters, log-likelihood and number of iterations."""
    result = train(inputs.observations(spark, sf), model=model, skip=3, **DEPTHS)
    rows = result.params.to_rows() + [("log_likelihood", "last", result.history[-1][1]), ("iterations", "all", float(result.iterations))]
    return rounded(spark.createDataFrame(rows, "component string, genotype string, value double"), ["value"], 5)


@query
def train_binomial(spark, sf):
    return trained(spark, sf, "binomial")


@query
def train_beta_binomial(spark, sf):
    return trained(spark, sf, "beta_binomial")


@query
def train_quality(spark, sf):
    return trained(spark, sf, "quality")


@query
def training_history(spark, sf):
    """The history of a fit on every third site, as the sink writes it: one row for each iteration."""
    path = shared_path(spark, "history")
    write_history(spark, train(inputs.observations(spark, sf), model="binomial", skip=3, **DEPTHS), path)
    names = {"pi": JOINT_GENOTYPES, "mu_N": GENOTYPES, "mu_T": GENOTYPES}
    values = [F.col(field)[i].alias(f"{field}_{g}") for field, genotypes in names.items() for i, g in enumerate(genotypes)]
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)  # the first iteration has no change
    df = spark.read.parquet(path).select("iteration", "log_likelihood", number("change"), number("relative_change"), *values)
    return rounded(df, df.columns[1:], 5).withColumn("iteration", F.col("iteration").cast("long"))
