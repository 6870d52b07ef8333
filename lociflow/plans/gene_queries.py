"""Queries of gene structure: lengths, components, splice sites, assignment of loci to genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genes as G
from ..operators import genes as O
from ..sources.adapters import features, genes, loci, with_

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_len = "CAST(sum(greatest({}, 0)) AS BIGINT)"


@query(
    "gene_lengths",
    with_("features", "genes")
    + f""", g AS (SELECT name, any_value(strand) AS strand, any_value(ts < te) AS coding, count(*) AS n_exons, count(*) - 1 AS n_introns, {_len.format('xe - xs + 1')} AS transcribed,
    {_len.format('least(xe, te) - greatest(xs, ts) + 1')} AS cds, {_len.format('least(xe, ts - 1) - xs + 1')} AS before, {_len.format('xe - greatest(xs, te + 1) + 1')} AS after FROM exons GROUP BY name)
    SELECT name, n_exons, n_introns, transcribed, CASE WHEN coding THEN cds ELSE 0 END AS cds, CASE WHEN NOT coding THEN 0 WHEN strand = '-' THEN after ELSE before END AS utr5, CASE WHEN NOT coding THEN 0 WHEN strand = '-' THEN before ELSE after END AS utr3 FROM g""",
)
def gene_lengths(spark, d):
    x, ts, te, strand = F.col("exons"), F.col("ts"), F.col("te"), F.col("strand")
    return genes(spark, d).select(
        "name", G.n_exons(x).cast("bigint").alias("n_exons"), G.n_introns(x).cast("bigint").alias("n_introns"), G.transcribed_length(x).alias("transcribed"), G.cds_length(x, ts, te).cast("bigint").alias("cds"),
        G.utr5_length(x, ts, te, strand).cast("bigint").alias("utr5"), G.utr3_length(x, ts, te, strand).cast("bigint").alias("utr3"),
    )


@query("gene_parts", with_("features", "genes") + " SELECT name, max(xs) FILTER (WHERE nth = 2) AS exon2_s, max(xe) FILTER (WHERE nth = 2) AS exon2_e, max(xe + 1) FILTER (WHERE nth = 1) AS intron1_s, max(next_s - 1) FILTER (WHERE nth = 1) AS intron1_e, max(xs) FILTER (WHERE nth = 4) AS exon4_s FROM exons GROUP BY name")
def gene_parts(spark, d):
    x = F.col("exons")
    return genes(spark, d).select("name", G.exon(x, 2)["s"].alias("exon2_s"), G.exon(x, 2)["e"].alias("exon2_e"), G.intron(x, 1)["s"].alias("intron1_s"), G.intron(x, 1)["e"].alias("intron1_e"), G.exon(x, 4)["s"].alias("exon4_s"))


@query(
    "transcript_loci",
    with_("features", "genes")
    + """, x AS (SELECT *, sum(xe - xs + 1) OVER (PARTITION BY name ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM exons),
    o AS (SELECT name, s, e, unnest([-3, 0, 9, 10, 22, 40, 70]) AS ofs FROM genes)
    SELECT o.name, CAST(ofs AS BIGINT) AS ofs, CAST(CASE WHEN ofs < 0 THEN any_value(o.s) + ofs ELSE coalesce(max(xs + ofs - coalesce(b, 0)) FILTER (WHERE ofs >= coalesce(b, 0) AND ofs < coalesce(b, 0) + xe - xs + 1), any_value(o.e) + 1 + ofs - sum(xe - xs + 1)) END AS BIGINT) AS locus
    FROM o JOIN x ON x.name = o.name GROUP BY o.name, ofs""",
)
def transcript_loci(spark, d):
    """The loci of some offsets in each transcript."""
    ofs = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (-3, 0, 9, 10, 22, 40, 70)])).alias("ofs")
    return genes(spark, d).select("name", "s", "exons", ofs).select("name", "ofs", G.transcript_to_locus(F.col("exons"), F.col("s"), F.col("ofs")).alias("locus"))


def _bits_sql(distance: int) -> str:
    on = "l.s <= xe AND l.e >= xs"
    before, after = f"({on} AND greatest(l.s, x.s) < ts AND ts > xs)", f"({on} AND least(l.e, x.e) > te AND te < xe)"
    flags = {
        G.CDS: f"ts < te AND {on} AND greatest(l.s, x.s) <= te AND least(l.e, x.e) >= ts",
        G.UTR5: f"ts < te AND CASE WHEN x.strand = '-' THEN {after} ELSE {before} END",
        G.UTR3: f"ts < te AND CASE WHEN x.strand = '-' THEN {before} ELSE {after} END",
        G.INTRON: "next_s IS NOT NULL AND l.s < next_s AND l.e > xe AND l.s <= x.e AND l.e >= x.s",
        G.UPSTREAM: f"CASE WHEN x.strand = '-' THEN l.s <= x.e + {distance} AND l.e > x.e ELSE l.s < x.s AND l.e >= x.s - {distance} END",
        G.DOWNSTREAM: f"CASE WHEN x.strand = '-' THEN l.s < x.s AND l.e > x.s - {distance} ELSE l.s <= x.e + {distance} AND l.e > x.e END",
    }
    bits = " | ".join(f"(CASE WHEN {c} THEN {b} ELSE 0 END)" for b, c in flags.items())
    return f"b AS (SELECT l.src, bit_or({bits}) AS bits FROM loci l JOIN exons x ON l.chrom = x.chrom AND l.s <= x.e + {distance} AND l.e >= x.s - {distance} GROUP BY l.src), y AS (SELECT l.src, l.flag, l.e - l.s + 1 AS len, CAST(coalesce(bits, 0) AS INTEGER) AS bits FROM loci l LEFT JOIN b USING (src))"


@query("gene_component_bits", with_("loci", "features", "genes", then=_bits_sql(25)) + " SELECT src, bits FROM y")
def gene_component_bits(spark, d):
    return O.component_bits(loci(spark, d), genes(spark, d), 25)


_region = "CASE " + " ".join(f"WHEN bits & {b} > 0 THEN {i}" for b, i in G.PRIORITY) + " ELSE 0 END"
_name = "CASE " + " ".join("WHEN {} = {} THEN '{}'".format("region", i, n.replace("'", "''")) for i, n in G.REGIONS.items()) + " END"


@query("gene_region_counts", with_("loci", "features", "genes", then=_bits_sql(25)) + f", r AS (SELECT *, {_region} AS region FROM y) SELECT {_name} AS region, flag, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY flag), 4) AS percent FROM r GROUP BY region, flag")
def gene_region_counts(spark, d):
    """Loci and their bases by the region of highest priority, with its share of each flag's loci."""
    b = O.component_bits(loci(spark, d).withColumn("len", F.col("e") - F.col("s") + 1), genes(spark, d), 25, ["flag", "len"])
    c = b.groupBy(G.region_name(G.region_index(F.col("bits"))).alias("region"), "flag").agg(F.count("*").alias("n"), F.sum("len").alias("bases"))
    total = c.groupBy("flag").agg(F.sum("n").alias("all"))
    return c.join(total, "flag").select("region", "flag", "n", "bases", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("percent"))


for _q, _bit in (("in_cds", G.CDS), ("in_utr5", G.UTR5), ("in_utr3", G.UTR3), ("in_intron", G.INTRON), ("in_upstream", G.UPSTREAM), ("in_downstream", G.DOWNSTREAM)):
    query(_q, with_("loci", "features", "genes", then=_bits_sql(25)) + f" SELECT src FROM y WHERE bits & {_bit} > 0")(lambda spark, d, b=_bit: O.touching(loci(spark, d), genes(spark, d), b, 25))


@query("in_exon", with_("loci", "features", "genes") + " SELECT src FROM loci l WHERE EXISTS (SELECT 1 FROM exons x WHERE l.chrom = x.chrom AND l.s <= xe AND l.e >= xs)")
def in_exon(spark, d):
    from ..operators.intervals import overlap_any

    x = genes(spark, d).select("chrom", F.explode("exons").alias("x")).select("chrom", "x.s", "x.e")
    return overlap_any(loci(spark, d), x).select("src")


@query(
    "gene_splice_bits",
    with_("loci", "features", "genes")
    + f""", b AS (SELECT l.src, bit_or((CASE WHEN l.s <= xe - 1 AND l.e >= xe + 2 THEN CASE WHEN x.strand = '-' THEN {G.INTRON_EXON} ELSE {G.EXON_INTRON} END ELSE 0 END) | (CASE WHEN l.s <= next_s - 2 AND l.e >= next_s + 1 THEN CASE WHEN x.strand = '-' THEN {G.EXON_INTRON} ELSE {G.INTRON_EXON} END ELSE 0 END)) AS bits
    FROM loci l JOIN exons x ON l.chrom = x.chrom AND l.s <= x.e AND l.e >= x.s AND next_s IS NOT NULL GROUP BY l.src) SELECT l.src, CAST(coalesce(bits, 0) AS INTEGER) AS bits FROM loci l LEFT JOIN b USING (src)""",
)
def gene_splice_bits(spark, d):
    return O.splice_bits(loci(spark, d), genes(spark, d), 2)


@query(
    "locus_gene",
    with_("loci", "features", "genes")
    + """, p AS (SELECT l.src, g.name, CASE WHEN l.s >= g.s AND l.e <= g.e THEN 0 WHEN CASE WHEN g.strand = '-' THEN l.e > g.e AND l.s >= g.s ELSE l.s < g.s AND l.e <= g.e END THEN 1 ELSE 2 END AS how, greatest(g.s - l.e, l.s - g.e, 0) AS apart, g.e - g.s AS size
    FROM loci l JOIN genes g ON l.chrom = g.chrom AND l.s <= g.e + 15 AND l.e >= g.s - 15) SELECT src, name, CAST(how AS INTEGER) AS how FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY how, apart, size, name) = 1""",
)
def locus_gene(spark, d):
    return O.gene_of(loci(spark, d), genes(spark, d), 15)


_shared = "p AS (SELECT l.src, r.name, r.s, r.e, greatest(l.s, r.s) AS start, l.s AS ls, l.e AS le, least(l.e, r.e) - greatest(l.s, r.s) + 1 AS bases FROM loci l JOIN features r ON l.chrom = r.chrom AND l.s <= r.e AND l.e >= r.s)"


@query("nth_overlapping", with_("loci", "features", then=_shared) + " SELECT src, name, start, bases FROM p WHERE bases >= 10 QUALIFY row_number() OVER (PARTITION BY src, ls, le ORDER BY s DESC, e DESC, name) = 2")
def nth_overlapping(spark, d):
    return O.nth_overlapping(loci(spark, d), features(spark, d), 10, 2)


@query("n_overlapping", with_("loci", "features", then=_shared) + " SELECT l.src, coalesce(n, 0) AS n FROM loci l LEFT JOIN (SELECT src, count(*) AS n FROM p WHERE bases >= 10 GROUP BY src) c USING (src)")
def n_overlapping(spark, d):
    return O.n_overlapping(loci(spark, d), features(spark, d), 10)


@query("tolerant_dropouts", with_("loci", "features") + " SELECT src, chrom, s, e FROM loci l WHERE NOT EXISTS (SELECT 1 FROM features r WHERE r.chrom = l.chrom AND abs(l.s - r.s) <= greatest((l.e - l.s + 1) * 20 // 100, 3) AND abs(l.e - r.e) <= greatest((l.e - l.s + 1) * 20 // 100, 3))")
def tolerant_dropouts(spark, d):
    return O.tolerant_dropouts(loci(spark, d), features(spark, d), 20, 3).select("src", "chrom", "s", "e")


@query("dropout_classes", with_("loci", "features", "genes", then=_bits_sql(25)) + f", k AS (SELECT y.* FROM y JOIN loci l USING (src) WHERE NOT EXISTS (SELECT 1 FROM features r WHERE r.chrom = l.chrom AND l.s <= r.e AND l.e >= r.s)) SELECT (len >= 10)::INT + (len >= 20)::INT + (len >= 40)::INT AS cls, {_region} AS region, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM k GROUP BY ALL")
def dropout_classes(spark, d):
    """Dropped loci by length class and region."""
    from ..operators.intervals import overlap_any

    gone = overlap_any(loci(spark, d), features(spark, d), anti=True)
    b = O.component_bits(gone.withColumn("len", F.col("e") - F.col("s") + 1), genes(spark, d), 25, ["len"])
    return b.groupBy(G.length_class(F.col("len"), [10, 20, 40]).alias("cls"), G.region_index(F.col("bits")).alias("region")).agg(F.count("*").alias("n"), F.sum("len").alias("bases"))


@query("split_elements", with_("loci") + ", x AS (SELECT src, s, part AS g, strand, chrom, e FROM loci) SELECT src, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY strand, chrom, s, e, src) - 1 AS ordinal FROM x QUALIFY count(*) OVER (PARTITION BY g, strand, chrom, s, e) = 1")
def split_elements(spark, d):
    """Elements of one source in order; those that tie in all that orders them are left out here."""
    from pyspark.sql.window import Window

    x = loci(spark, d).withColumnRenamed("src", "id").withColumnRenamed("part", "src")
    x = O.split_elements(x).withColumn("k", F.count("*").over(Window.partitionBy("src", "strand", "chrom", "s", "e")))
    return x.filter("k = 1").select(F.col("id").alias("src"), F.col("n"), F.col("ordinal").cast("bigint").alias("ordinal"))
