"""Plain Python counterparts of the operators, for small inputs."""

import math
import random
import re
from collections import Counter, defaultdict

GENOTYPES = ("AA", "AB", "BB")
CODES = "=ACMGRSVTWYHKDBN"


def operations(cigar):
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def entries(read):
    """(pos, base or None, bq or None) per covered reference position of a read dict."""
    x, y = read["pos"], 0
    for n, op in operations(read["cigar"]):
        if op in "M=X":
            for i in range(n):
                base = read["seq"][y + i].upper() if read["seq"] else ""
                base = base if base == "" or base in CODES else "N"
                yield x + i, base, ord(read["qual"][y + i]) - 33 if read["qual"] else 0
        elif op in "DN":
            for i in range(n):
                yield x + i, None, None
        x += n if op in "M=XDN" else 0
        y += n if op in "M=XIS" else 0


def pileup(reads, mask=1796):
    for read in reads:
        if read["flag"] & (mask | 4) or read["chrom"] == "*":
            continue
        for pos, base, bq in entries(read):
            yield read["sample"], read["chrom"], pos, base, bq, read["mapq"]


def joint(observations, reference, min_bq=0, min_mq=0):
    """{(chrom, pos): (ref, var, counts, reads)} of jointly covered positions; reads per sample as (q, r)."""
    columns = defaultdict(list)
    for sample, chrom, pos, base, bq, mq in observations:
        columns[chrom, pos].append((sample, base, bq, mq))
    out = {}
    for (chrom, pos), column in columns.items():
        if {s for s, *_ in column} != {"normal", "tumour"}:
            continue
        sequence = reference[chrom]
        ref = sequence[min(pos, len(sequence) - 1)].upper()
        kept = [(s, b, bq, mq) for s, b, bq, mq in column if b is not None and bq >= min_bq and mq >= min_mq]
        totals = Counter(b for _, b, _, _ in kept if b in ("A", "C", "G", "T") and b != ref)
        var = max(totals, key=lambda b: (totals[b], b)) if totals else "N"
        count = lambda s, b: sum(1 for t, c, _, _ in kept if t == s and c == b)
        b_count = lambda s: count(s, var) if var != "N" else 0
        counts = (count("normal", ref), b_count("normal"), count("tumour", ref), b_count("tumour"))
        reads = {"normal": [], "tumour": []}
        for s, b, bq, mq in kept:
            p, r = 1 - 10 ** (-bq / 10), 1 - 10 ** (-mq / 10)
            if b == ref:
                reads[s].append((p, r))
            elif b == var and var != "N":
                reads[s].append(((1 - p) / 3, r))
        out[chrom, pos] = (ref, var, counts, reads)
    return out


def lik(q, r, mu):
    return 0.5 * (1 - r) + r * ((1 - q) * (1 - mu) + q * mu)


def lbeta(a, b):
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def site_loglik(model, params, sample, g, a, b, reads):
    if model == "binomial":
        mu = params[f"mu_{sample}"][g]
        return a * math.log(mu) + b * math.log(1 - mu)
    if model == "beta_binomial":
        alpha, beta = params[f"alpha_{sample}"][g], params[f"beta_{sample}"][g]
        return lbeta(a + alpha, b + beta) - lbeta(alpha, beta)
    mu = params[f"mu_{sample}"][g]
    return sum(math.log(lik(q, r, mu)) for q, r in reads)


def posterior(model, params, counts, reads=None):
    """Nine posteriors and the log-likelihood of a site."""
    reads = reads or {"normal": [], "tumour": []}
    normal = [site_loglik(model, params, "N", g, counts[0], counts[1], reads["normal"]) for g in range(3)]
    tumour = [site_loglik(model, params, "T", g, counts[2], counts[3], reads["tumour"]) for g in range(3)]
    ll = [math.log(params["pi"][3 * n + t]) + normal[n] + tumour[t] for n in range(3) for t in range(3)]
    top = max(ll)
    lse = top + math.log(sum(math.exp(x - top) for x in ll))
    return [math.exp(x - lse) for x in ll], lse


def em_step(model, params, priors, data):
    """One MAP-EM iteration over [(counts, reads)]; returns the new parameters and the old log-likelihood."""
    n = [0.0] * 9
    a = {s: [0.0] * 3 for s in "NT"}
    b = {s: [0.0] * 3 for s in "NT"}
    total = 0.0
    for counts, reads in data:
        p, lse = posterior(model, params, counts, reads)
        total += lse
        for j in range(9):
            n[j] += p[j]
            for s, g, ca, cb in (("N", j // 3, counts[0], counts[1]), ("T", j % 3, counts[2], counts[3])):
                if model == "quality":
                    for q, r in reads["normal" if s == "N" else "tumour"]:
                        mu = params[f"mu_{s}"][g]
                        a[s][g] += p[j] * mu * (0.5 + r * (q - 0.5)) / lik(q, r, mu)
                        b[s][g] += p[j] * (1 - mu) * (0.5 + r * (0.5 - q)) / lik(q, r, mu)
                else:
                    a[s][g] += p[j] * ca
                    b[s][g] += p[j] * cb
    prior = sum((k - 1) * math.log(x) for k, x in zip(priors["pi"], params["pi"]))
    new = dict(params)
    raw = [x + k - 1 for x, k in zip(n, priors["pi"])]
    new["pi"] = tuple(x / sum(raw) for x in raw)
    if model != "beta_binomial":
        for s in "NT":
            alpha, beta = priors[f"mu_{s}_alpha"], priors[f"mu_{s}_beta"]
            for g in range(3):
                mu = params[f"mu_{s}"][g]
                prior += (alpha[g] - 1) * math.log(mu) + (beta[g] - 1) * math.log(1 - mu)
            new[f"mu_{s}"] = tuple(
                (a[s][g] + alpha[g] - 1) / (a[s][g] + alpha[g] + b[s][g] + beta[g] - 2) for g in range(3)
            )
    return new, total + prior


CIGARS = ("12M", "5M1I6M", "3M2D9M", "4S8M", "3M7N9M", "6=1X5=", "2H12M", "4M1P2I6M", "10M2S", "1M3I2D8M", "4M2N2D8M")


def random_reads(count, length, contigs=("1", "2"), seed=7):
    """Read dicts of both samples with many kinds of CIGAR, letters, flags and missing values."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        cigar = rng.choice(CIGARS)
        size = sum(n for n, op in operations(cigar) if op in "MIS=X")
        seq = "".join(rng.choice("ACGTACGTACGTacgtNRn") for _ in range(size))
        qual = "".join(chr(33 + rng.randrange(0, 42)) for _ in range(size))
        out.append({
            "sample": rng.choice(("normal", "tumour")),
            "qname": f"r{i}",
            "flag": rng.choice((0, 0, 0, 16, 99, 147, 4, 256, 512, 1024)),
            "chrom": rng.choice((*contigs, *contigs, *contigs, "*")),
            "pos": rng.randrange(0, length),
            "mapq": rng.choice((0, 10, 20, 30, 60)),
            "cigar": cigar,
            "seq": seq,
            "qual": None if rng.random() < 0.05 else qual,
        })
    return out


def reads_frame(spark, reads):
    from paircall.schema import ALIGNMENT

    rows = [tuple(r.get(f.name) for f in ALIGNMENT.fields) for r in reads]
    return spark.createDataFrame(rows, ALIGNMENT)


def chunks_frame(spark, reference, chunk=128):
    """Chunk table of {contig: sequence}."""
    rows = [
        (name, i // chunk, i, seq[i:i + chunk], chunk) for name, seq in reference.items() for i in range(0, len(seq), chunk)
    ]
    return spark.createDataFrame(rows, "chrom string, chunk_id int, chunk_start int, seq string, width int")


def random_reference(length, contigs=("1", "2"), seed=3):
    rng = random.Random(seed)
    return {c: "".join(rng.choice("ACGTACGTacgtNR") for _ in range(length)) for c in contigs}
