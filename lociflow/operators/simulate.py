"""Simulated genomes, reads and counts. Everything follows from hashes of a seed and a number, so a lost task makes the same rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import reverse_complement

BASES = "ACGT"
#: Bases of a genome's row.
BLOCK = 1000


def uniform(*of: Column | int) -> Column:
    """A number from 0 up to, but not, 1 for the values: 52 bits of their MD5 digest."""
    text = F.concat_ws("|", *[F.lit(str(x)) if isinstance(x, int) else x.cast("string") for x in of])
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("bigint") / float(1 << 52)


def whole_number(most: Column, *of: Column | int) -> Column:
    """A whole number from 0 up to, but not, most for the values."""
    return F.floor(uniform(*of) * most)


def base_at(seed: int, chrom: Column, at: Column) -> Column:
    return F.substring(F.lit(BASES), (whole_number(F.lit(4), seed, chrom, at) + 1).cast("int"), F.lit(1))


def stretch(seed: int, chrom: Column, start: Column, size: Column) -> Column:
    """A genome's bases from start on: any stretch comes from its places alone."""
    return F.array_join(F.transform(F.sequence(start, start + size - 1), lambda at: base_at(seed, chrom, at)), "")


def genome(spark: SparkSession, chroms: int, size: int, seed: int) -> DataFrame:
    """(chrom, start, seq): chromosomes of `size` random bases in rows of BLOCK."""
    per = -(-size // BLOCK)
    d = spark.range(chroms * per).select(F.floor(F.col("id") / per).alias("chrom"), ((F.col("id") % per) * BLOCK).alias("start"))
    return d.withColumn("seq", stretch(seed, F.col("chrom"), F.col("start"), F.least(F.lit(BLOCK), F.lit(size) - F.col("start"))))


def reads(spark: SparkSession, n: int, chroms: int, size: int, length: int, errors: float, genome_seed: int, seed: int) -> DataFrame:
    """(id, chrom, start, strand, seq, subs): reads of that genome from both strands; each base is another one with chance `errors`."""
    i = F.col("id")
    d = spark.range(n).withColumns({"chrom": whole_number(F.lit(chroms), seed, 1, i), "start": whole_number(F.lit(size - length + 1), seed, 2, i), "strand": F.when(uniform(seed, 3, i) < 0.5, "+").otherwise("-")})
    # A changed base moves on by one to three in the alphabet.
    move = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.when(uniform(seed, 4, i, k) < errors, 1 + whole_number(F.lit(3), seed, 5, i, k)).otherwise(0))
    d = d.withColumn("_move", move).withColumn("_true", stretch(genome_seed, F.col("chrom"), F.col("start"), F.lit(length)))
    true = lambda k: F.substring(F.col("_true"), k + 1, F.lit(1))
    changed = F.transform("_move", lambda m, k: F.substring(F.lit(BASES), ((F.instr(F.lit(BASES), true(k)) - 1 + m) % 4 + 1).cast("int"), F.lit(1)))
    seq = F.array_join(changed, "")
    subs = F.size(F.filter("_move", lambda m: m > 0))
    return d.select("id", "chrom", "start", "strand", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"), subs.alias("subs"))


def read_pairs(spark: SparkSession, n: int, chroms: int, size: int, length: int, insert_least: int, insert_most: int, genome_seed: int, seed: int) -> DataFrame:
    """(id, chrom, start, insert, seq1, seq2): both ends of inserts, the second from the other strand."""
    i = F.col("id")
    d = spark.range(n).withColumns({"chrom": whole_number(F.lit(chroms), seed, 1, i), "insert": insert_least + whole_number(F.lit(insert_most - insert_least + 1), seed, 2, i)})
    d = d.withColumn("start", whole_number(F.lit(size) - F.col("insert") + 1, seed, 3, i))
    first = stretch(genome_seed, F.col("chrom"), F.col("start"), F.lit(length))
    second = reverse_complement(stretch(genome_seed, F.col("chrom"), F.col("start") + F.col("insert") - length, F.lit(length)))
    return d.select("id", "chrom", "start", "insert", first.alias("seq1"), second.alias("seq2"))


def resampled(df: DataFrame, order: list[str], rounds: int, seed: int) -> DataFrame:
    """df's rows drawn with replacement, as many as it has, `rounds` times: column round. order tells rows apart."""
    from .scans import running_sum

    d = df.withColumn("_h", uniform(seed, *map(F.col, order))).withColumn("_all", F.lit(1))
    d = running_sum(d, ["_all"], ["_h", *order], "_h", F.lit(1), "_n", cell=F.floor(F.col("_h") * 4096)).drop("_h", "_all")
    total = df.count()
    draws = df.sparkSession.range(rounds * total).select(F.floor(F.col("id") / F.lit(max(total, 1))).alias("round"), (whole_number(F.lit(total), seed, F.col("id")) + 1).alias("_n"))
    return draws.join(d, "_n").drop("_n")


def limited(df: DataFrame, order: list[str], n: int, seed: int) -> DataFrame:
    """n random rows of df, the same for one seed: those of least hash. The limit is the feature."""
    return df.orderBy(uniform(seed, *map(F.col, order)), *order).limit(n)


def profile(aligned: DataFrame, what: str) -> DataFrame:
    """(what, n, low, high): how often each value was seen, and its part of 0 to 1 when one is drawn."""
    c = aligned.groupBy(what).agg(F.count("*").alias("n"))  # a profile's values are few
    w = Window.orderBy(F.desc("n"), what)
    c = c.withColumns({"_u": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("n").over(Window.partitionBy())})
    return c.select(what, "n", ((F.col("_u") - F.col("n")) / F.col("_t")).alias("low"), (F.col("_u") / F.col("_t")).alias("high"))


def drawn(spark: SparkSession, n: int, seen: DataFrame, what: str, seed: int) -> DataFrame:
    """(id, what): n draws from a profile, which is small enough to send everywhere."""
    d = spark.range(n).withColumn("_u", uniform(seed, F.col("id")))
    return d.join(F.broadcast(seen.limit(1_000_000).select(what, "low", "high")), (F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).select("id", what)


def octamers(spark: SparkSession, k: int = 8) -> DataFrame:
    """(seq): all sequences of k bases."""
    digit = lambda i: F.substring(F.lit(BASES), (F.shiftright("id", 2 * (k - 1 - i)).bitwiseAND(3) + 1).cast("int"), F.lit(1))
    return spark.range(4**k).select(F.concat(*[digit(i) for i in range(k)]).alias("seq"))


def poisson(rate: Column, *of: Column | int) -> Column:
    """A Poisson number for the values, by the inverse of its distribution over up to 10 rate + 30 steps; for rates up to 500."""
    u = uniform(*of)
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("upto"), F.lit(0).cast("bigint").alias("k"))

    def step(a, i):
        p = a["p"] * rate / i
        done = a["upto"] > u
        return F.struct(F.when(done, a["p"]).otherwise(p).alias("p"), F.when(done, a["upto"]).otherwise(a["upto"] + p).alias("upto"), F.when(done, a["k"]).otherwise(i.cast("bigint")).alias("k"))

    return F.when(rate <= 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), (rate * 10 + 30).cast("int")), start, step, lambda a: a["k"]))


def log_factorial(n: Column) -> Column:
    """ln n!: summed up to 255, Stirling's series above."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    summed = F.aggregate(F.when(n >= 2, F.sequence(F.lit(2), F.least(n, F.lit(255)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(n < 256, summed).otherwise(series)


def fragments(spark: SparkSession, n: int, chroms: int, size: int, least: int, most: int, preference: dict[str, float], genome_seed: int, seed: int, tries: int = 64) -> DataFrame:
    """(id, chrom, start, length, seq): pieces of that genome cut where a site, as long as the keys, is preferred.

    A cut is accepted by its site's preference from 0 to 1 among up to `tries` random places; sites that aren't named have 0.
    A row whose places all fail is left out.
    """
    k = len(next(iter(preference)))
    i = F.col("id")
    each = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.struct(t.alias("t"), whole_number(F.lit(chroms), seed, 1, i, t).alias("chrom"), whole_number(F.lit(size - most + 1), seed, 2, i, t).alias("start"), uniform(seed, 3, i, t).alias("u")))
    weight = F.create_map(*[x for key, v in preference.items() for x in (F.lit(key), F.lit(v))])
    ok = F.filter(each, lambda x: x["u"] < F.coalesce(F.element_at(weight, stretch(genome_seed, x["chrom"], x["start"], F.lit(k))), F.lit(0.0)))
    d = spark.range(n).withColumn("_c", F.get(ok, F.lit(0))).filter("_c IS NOT NULL")
    length = least + whole_number(F.lit(most - least + 1), seed, 4, i)
    return d.select("id", "_c.chrom", "_c.start", length.alias("length")).withColumn("seq", stretch(genome_seed, F.col("chrom"), F.col("start"), F.col("length")))


def expression_counts(spark: SparkSession, genes: int, samples: int, mean: float, changed: float, fold: float, seed: int) -> DataFrame:
    """(gene, sample, treated, rate, n): Poisson counts of genes in samples, every second one treated; a share of genes changes by `fold` in these."""
    i = F.col("id")
    d = spark.range(genes * samples).select(F.floor(i / samples).alias("gene"), (i % samples).alias("sample"))
    base = -F.log(1 - uniform(seed, 1, F.col("gene"))) * mean  # rates of genes fall off exponentially
    treated = F.col("sample") % 2 == 1
    rate = base * F.when(treated & (uniform(seed, 2, F.col("gene")) < changed), fold).otherwise(1.0)
    d = d.withColumns({"treated": treated, "rate": F.least(rate, F.lit(500.0))})
    return d.withColumn("n", poisson(F.col("rate"), seed, 3, F.col("gene"), F.col("sample")))
