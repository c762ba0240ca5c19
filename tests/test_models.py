"""Scoring, EM, sampling, labels, tables and streaming."""

import math

import brute
import pytest
from pyspark.sql import functions as F

from paircall.functions import likelihood, logspace
from paircall.models import (
    BetaBinomialParams,
    BetaBinomialPriors,
    Binomial,
    BinomialParams,
    BinomialPriors,
    expected_statistics,
    fit,
    score,
    training_table,
)
from paircall.operators import labels, sampling, sites
from paircall.plans import classify, observe, train
from paircall.schema import COUNTS, JOINT_GENOTYPES, POSTERIORS, RESULT_COLUMNS
from paircall.sinks import write_counts, write_history, write_params, write_results
from paircall.sinks.tables import params_table
from paircall.sources.tables import normalise_weights, read_parameter_table, read_params, read_priors
from paircall.streaming import score_stream

# Expected posteriors at default parameters, by (a_N, b_N, a_T, b_T).
BINOMIAL = {
    (3, 0, 3, 0): (0.9996, 0.0001, 0, 0.0001, 0.0002, 0, 0, 0, 0),
    (3, 0, 2, 1): (0.9715, 0.0124, 0, 0.0001, 0.0160, 0, 0, 0, 0),
    (3, 0, 2, 0): (0.9993, 0.0003, 0, 0.0001, 0.0003, 0, 0, 0, 0),
    (0, 3, 0, 3): (0, 0, 0, 0, 0.0161, 0.0125, 0, 0.0001, 0.9712),
    (1, 2, 2, 1): (0.0061, 0.0001, 0, 0.0077, 0.9858, 0.0001, 0, 0.0001, 0.0001),
    (1, 2, 0, 3): (0, 0, 0.0003, 0, 0.4192, 0.3254, 0, 0, 0.2551),
    (2, 1, 3, 0): (0.9715, 0.0001, 0, 0.0124, 0.0160, 0, 0, 0, 0),
    (1, 0, 0, 1): (0.6840, 0.0342, 0.0677, 0.0003, 0.1727, 0.0342, 0, 0, 0.0068),
    (0, 1, 0, 1): (0.0077, 0.0004, 0.0008, 0.0004, 0.1935, 0.0383, 0, 0.0004, 0.7585),
    (0, 1, 1, 0): (0.7604, 0.0004, 0, 0.0380, 0.1920, 0.0004, 0.0008, 0.0004, 0.0076),
}
BETA_BINOMIAL = {
    (3, 0, 2, 1): (0.7792, 0.0978, 0, 0.0001, 0.1230, 0, 0, 0, 0),
    (0, 3, 0, 3): (0, 0, 0, 0, 0.0154, 0.0122, 0, 0.0001, 0.9723),
    (1, 2, 2, 1): (0, 0, 0, 0.0008, 0.9992, 0, 0, 0, 0),
    (1, 2, 0, 3): (0, 0, 0, 0, 0.5380, 0.4279, 0, 0, 0.0341),
    (1, 0, 0, 1): (0.1813, 0.0907, 0.1813, 0.0001, 0.4541, 0.0907, 0, 0, 0.0018),
    (0, 1, 0, 1): (0.0001, 0, 0.0001, 0, 0.1925, 0.0385, 0, 0.0004, 0.7684),
    (0, 1, 1, 0): (0.2480, 0.0001, 0, 0.1241, 0.6214, 0.0001, 0.0025, 0.0012, 0.0025),
}
# Quality model, base quality 27: (normal bases, normal mapq, tumour bases, tumour mapq), r reference and v variant.
QUALITY = {
    ("rrr", (10, 20, 30), "rrr", (10, 25, 30)): (0.9995, 0.0001, 0, 0.0001, 0.0002, 0, 0, 0, 0),
    ("rrr", (10, 20, 30), "rrv", (10, 25, 30)): (0.9719, 0.0118, 0.0001, 0.0001, 0.0161, 0, 0, 0, 0),
    ("vvv", (10, 20, 30), "vvv", (10, 25, 30)): (0, 0, 0, 0, 0.0180, 0.0132, 0, 0.0001, 0.9686),
    ("r", (30,), "v", (30,)): (0.7055, 0.0317, 0.0626, 0.0004, 0.1603, 0.0317, 0, 0, 0.0079),
    ("v", (30,), "v", (30,)): (0.0096, 0.0004, 0.0009, 0.0004, 0.1934, 0.0383, 0, 0.0004, 0.7566),
}


def counts_frame(spark, counts):
    rows = [("1", i, "A", "C", *c) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "chrom string, pos int, ref_base string, var_base string, a_N long, b_N long, a_T long, b_T long")


def probabilities(frame):
    return [[r[p] for p in POSTERIORS] for r in frame.orderBy("pos").collect()]


@pytest.mark.parametrize("model,table", [("binomial", BINOMIAL), ("beta_binomial", BETA_BINOMIAL)])
def test_expected_posteriors(spark, table, model):
    got = probabilities(score(counts_frame(spark, table), model=model))
    for p, want in zip(got, table.values()):
        assert [round(x, 4) for x in p] == pytest.approx(list(want), abs=1.01e-4)
        assert sum(p) == pytest.approx(1)


def test_expected_quality_posteriors(spark):
    p27 = 1 - 10 ** -2.7
    rows = []
    for i, (nb, nm, tb, tm) in enumerate(QUALITY):
        reads = lambda bases, quals: [(p27 if b == "r" else (1 - p27) / 3, 1 - 10 ** (-m / 10), 1) for b, m in zip(bases, quals)]
        rows.append(("1", i, reads(nb, nm), reads(tb, tm)))
    cell = "array<struct<q:double,r:double,n:long>>"
    frame = spark.createDataFrame(rows, f"chrom string, pos int, reads_N {cell}, reads_T {cell}")
    for p, want in zip(probabilities(score(frame, model="quality")), QUALITY.values()):
        assert [round(x, 4) for x in p] == pytest.approx(list(want), abs=1.01e-4)


@pytest.mark.parametrize("depth", [100, 5000])
def test_no_nan_at_deep_sites(spark, depth):
    frame = counts_frame(spark, [(depth, 0, 0, depth), (0, depth, depth, 0), (depth, depth, 1, 0), (0, 0, 0, 0)])
    for model in ("binomial", "beta_binomial"):
        for p in probabilities(score(frame, model=model)):
            assert sum(p) == pytest.approx(1) and not any(map(math.isnan, p))


def test_scalar_functions(spark):
    xs = [0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 1500.0, 1e6]
    frame = spark.createDataFrame([(x, y) for x in xs for y in xs], "x double, y double")
    for r in frame.select("x", "y", likelihood.ln_gamma(F.col("x")).alias("g"), likelihood.ln_beta(F.col("x"), F.col("y")).alias("b")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)
        assert r.b == pytest.approx(brute.lbeta(r.x, r.y), rel=1e-9, abs=1e-8)
    q, r = F.col("x"), F.col("y")
    unit = spark.createDataFrame([(a / 10, b / 10) for a in range(1, 10) for b in range(10)], "x double, y double")
    both = unit.select((likelihood.expected_a(q, r, 0.3) + likelihood.expected_b(q, r, 0.3)).alias("s"))
    assert all(row.s == pytest.approx(1) for row in both.collect())
    row = spark.range(1).select(
        logspace.log_sum_exp_array(F.array(F.lit(-1000.0), F.lit(-1001.0))).alias("a"),
        logspace.log_normalise_array(F.array(F.lit(-1000.0), F.lit(-1000.0))).alias("b"),
        logspace.log_sum_exp([F.lit(-1000.0), F.lit(float("-inf"))]).alias("c"),
    ).first()
    assert row.a == pytest.approx(-1000 + math.log(1 + math.exp(-1))) and row.b == pytest.approx([0.5, 0.5]) and row.c == -1000


READS = brute.random_reads(700, 60, seed=11)
REFERENCE = {c: "ACGT" * 20 for c in "12"}


@pytest.fixture(scope="module")
def obs(spark):
    return observe(brute.reads_frame(spark, READS)).cache()


@pytest.fixture(scope="module")
def chunks(spark):
    return brute.chunks_frame(spark, REFERENCE).cache()


@pytest.fixture(scope="module")
def joint():
    return brute.joint(brute.pileup(READS), REFERENCE)


MODELS = {"binomial": BinomialParams, "beta_binomial": BetaBinomialParams, "quality": BinomialParams}


@pytest.mark.parametrize("model", MODELS)
def test_em_against_plain_python(spark, obs, chunks, joint, model):
    params = vars(MODELS[model]())
    priors = vars((BetaBinomialPriors if model == "beta_binomial" else BinomialPriors)())
    data = [(counts, reads) for _, _, counts, reads in joint.values()]
    frame = (sites.joint_qualities if model == "quality" else sites.joint_counts)(obs, chunks)
    result = fit(frame, model, max_iters=3, tolerance=0.0)
    assert result.iterations == 3 and not result.converged
    for _, ll, _, _, new in result.history:
        params, want = brute.em_step(model, params, priors, data)
        assert ll == pytest.approx(want, rel=1e-9)
        for name, values in vars(new).items():
            assert list(values) == pytest.approx(list(params[name]), rel=1e-7), name
    values = [h[1] for h in result.history]
    assert values == sorted(values)


def test_compressed_and_raw_statistics_agree(spark, obs, chunks):
    frame = sites.joint_counts(obs, chunks).cache()
    compressed = training_table(frame, "binomial")
    assert compressed.count() < frame.count()
    raw = frame.withColumn("w", F.lit(1))
    a, b = (expected_statistics(t, BinomialParams(), "binomial").first().asDict() for t in (compressed, raw))
    assert a == pytest.approx(b, rel=1e-9)


def test_parameters_are_recovered(spark):
    """Many equal sites of three kinds: weights and allele probabilities follow them."""
    kinds = [((40, 0, 40, 0), 700), ((20, 20, 20, 20), 200), ((40, 0, 20, 20), 100)]
    frame = counts_frame(spark, [c for c, n in kinds for _ in range(n)])
    result = fit(frame, "binomial")
    assert result.converged
    weights = dict(zip(JOINT_GENOTYPES, result.params.pi))
    assert [weights[g] for g in ("AA_AA", "AB_AB", "AA_AB")] == pytest.approx([0.7, 0.2, 0.1], abs=0.01)
    assert result.params.mu_N[0] > 0.99 and result.params.mu_N[1] == pytest.approx(0.5, abs=0.01)
    table = result.history_table(spark)
    assert table.count() == result.iterations and table.columns[:4] == ["iteration", "log_likelihood", "change", "relative_change"]


def test_identical_deep_sites(spark):
    frame = spark.range(100_000).select(*[F.lit(v).cast("long").alias(c) for c, v in zip(COUNTS, (100, 0, 50, 50))])
    result = fit(frame, "binomial")
    assert result.converged and dict(zip(JOINT_GENOTYPES, result.params.pi))["AA_AB"] > 0.99


def test_no_sites_is_an_error(spark):
    with pytest.raises(ValueError, match="no training sites"):
        fit(counts_frame(spark, [(1, 1, 1, 1)]).where("a_N > 5"), "binomial")


def test_train_samples_every_kth_site(obs, chunks, joint):
    limits = dict(min_normal_depth=3, max_normal_depth=30, min_tumour_depth=3, max_tumour_depth=30)
    eligible = [v for k, v in sorted(joint.items()) if 3 <= sum(v[2][:2]) <= 30 and 3 <= sum(v[2][2:]) <= 30]
    chosen = eligible[2::3]
    params, priors = vars(BinomialParams()), vars(BinomialPriors())
    for model in ("binomial", "quality"):
        result = train(obs, chunks, model, skip=3, max_iters=1, **limits)
        _, want = brute.em_step(model, params, priors, [v[2:] for v in chosen])
        assert result.history[0][1] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_genome_rank(spark, block):
    keys = [(c, p) for c in ("10", "2", "X") for p in range(0, 90, 1 + len(c))]
    frame = spark.createDataFrame(keys, "chrom string, pos int").orderBy(F.rand(1))
    ranked = {(r.chrom, r.pos): r["rank"] for r in sampling.genome_rank(frame, block).collect()}
    assert ranked == {k: i + 1 for i, k in enumerate(sorted(keys))}
    kept = sorted((r.chrom, r.pos) for r in sampling.every_kth(frame, 4, block).collect())
    assert kept == sorted(keys)[3::4]


def test_labels(spark):
    rows = [("1", i, *[0.9 if j == i else 0.0125 for j in range(9)]) for i in range(9)]
    frame = spark.createDataFrame(rows, "chrom string, pos int, " + ", ".join(f"{p} double" for p in POSTERIORS))
    best = labels.map_genotype(frame).orderBy("pos").collect()
    assert [r.genotype for r in best] == list(JOINT_GENOTYPES)
    assert [r.label for r in best] == ["wildtype", "somatic", "somatic", "loh", "germline", "loh", "error", "error", "germline"]
    assert labels.marginals(frame).where("pos = 1").first().p_somatic == pytest.approx(0.9125)
    hard = labels.hard_assign(frame).where("pos = 4").first()
    assert [hard[p] for p in POSTERIORS] == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    long = labels.to_long(frame)
    assert long.count() == 81 and long.where("normal_genotype = 'BB' AND tumour_genotype = 'AB' AND pos = 7").first().probability == 0.9
    assert [r.pos for r in labels.somatic_calls(frame, 0.9).orderBy("pos").collect()] == [1, 2]


def flat(params):
    return [v for values in vars(params).values() for v in values]


def test_parameter_tables(spark, tmp_path):
    params = BinomialParams(mu_N=(0.9, 0.4, 0.1))
    write_params(spark, params, str(tmp_path / "params"))
    again = read_params(spark, str(tmp_path / "params"), "binomial")
    assert flat(again) == pytest.approx(flat(params))
    priors = BinomialPriors(mu_T_beta=(3.0, 400.0, 900.0))
    write_params(spark, priors, str(tmp_path / "priors"))
    assert read_priors(spark, str(tmp_path / "priors")) == priors
    beta = BetaBinomialParams(alpha_N=(9.0, 5.0, 1.0))
    params_table(spark, beta).write.parquet(str(tmp_path / "beta"))
    assert flat(read_params(spark, str(tmp_path / "beta"), "beta_binomial", "parquet")) == pytest.approx(flat(beta))

    lower = params_table(spark, params).withColumns({"genotype": F.lower("genotype"), "value": F.col("value") * F.when(F.col("component") == "pi", 50).otherwise(1)})
    lower.write.option("sep", "\t").option("header", True).csv(str(tmp_path / "lower"))
    assert flat(read_params(spark, str(tmp_path / "lower"))) == pytest.approx(flat(params))
    shares = normalise_weights(read_parameter_table(spark, str(tmp_path / "lower")))
    assert shares.where("component = 'pi'").agg(F.sum("value")).first()[0] == pytest.approx(1)
    lower.where("genotype <> 'ab'").write.option("sep", "\t").option("header", True).csv(str(tmp_path / "part"))
    with pytest.raises(ValueError, match="no value for mu_N of AB"):
        read_params(spark, str(tmp_path / "part"))
    with pytest.raises(ValueError):
        BinomialPriors(pi=(0.5,) * 9)
    with pytest.raises(ValueError):
        BinomialParams(mu_N=(1.0, 0.5, 0.1))


def test_sinks(spark, obs, chunks, tmp_path):
    calls = classify(obs, chunks, "binomial")
    write_results(calls, str(tmp_path / "tsv"))
    write_results(calls, str(tmp_path / "parquet"), "parquet")
    text = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    full = {(r.chrom, r.position): r for r in spark.read.parquet(str(tmp_path / "parquet")).collect()}
    assert tuple(text.columns) == RESULT_COLUMNS
    rows = text.collect()
    assert len(rows) == len(full) > 0
    for r in rows:
        other = full[r.chrom, int(r.position)]
        assert [r[p] for p in POSTERIORS] == [f"{other[p]:.4f}" for p in POSTERIORS]
        assert int(r.tumour_counts_b) == other.tumour_counts_b > 0
    places = [(r.chrom, r.pos) for r in calls.collect()]
    assert places == sorted(places)
    write_counts(sites.joint_counts(obs, chunks), str(tmp_path / "counts"))
    counts = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "counts"))
    assert counts.columns == ["chrom", "position", "ref_base", "var_base", *COUNTS]
    result = fit(sites.joint_counts(obs, chunks), "binomial", max_iters=2)
    write_history(spark, result, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2


def test_score_stream(spark, tmp_path):
    frame = counts_frame(spark, [*BINOMIAL, (5, 0, 4, 4)])
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, somatic_threshold=0.01).writeStream.format("memory").queryName("scored_sites").start()
    query.processAllAvailable()
    query.stop()
    batch = labels.somatic_calls(score(sites.variant_sites(frame), model="binomial"), 0.01)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("scored_sites")) == rows(batch)
    with pytest.raises(ValueError):
        score_stream(frame)


def test_custom_density(spark):
    """A density of one's own: a binomial that trusts no read fully."""

    class Damped(Binomial):
        name = "damped"

        def with_loglik(self, frame, params):
            full = super().with_loglik(frame, params)
            return full.withColumns({c: F.col(c) * 0.5 for c in full.columns if c.startswith("l_")})

    frame = counts_frame(spark, [(10, 0, 5, 5)])
    plain, damped = probabilities(score(frame, model="binomial"))[0], probabilities(score(frame, model=Damped()))[0]
    assert damped[0] > plain[0] and sum(damped) == pytest.approx(1)
    with pytest.raises(ValueError, match="unknown model"):
        score(frame, model="nothing")
