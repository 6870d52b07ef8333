"""Whole jobs from files to files, put together from the readers, operators and writers.

Each tool is a function of a session, paths and options; `python -m lociflow.tools NAME ARGUMENT... --option VALUE` runs one.
Outputs are folders of part files. Tables are written as CSV with a heading.
"""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genes as G
from .functions.sequence import reverse_complement
from .operators import assembly, expression, filters, genes, intervals, ontology, reads, remap, scans, search, simulate, tables
from .sources import formats, lists, relational, writers
from .sources import tables as tabular

TOOLS: dict[str, Callable] = {}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__.replace("_", "-")] = f
    return f


def put(df: DataFrame, out: str) -> None:
    df.write.option("header", True).csv(out)


def words(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def numbered(df: DataFrame) -> DataFrame:
    """df with src, a number of each row."""
    return df.withColumn("src", F.monotonically_increasing_id())


def bed_elements(spark: SparkSession, path: str) -> DataFrame:
    return numbered(formats.bed(spark, path).filter("s IS NOT NULL AND e IS NOT NULL"))


def csv_elements(spark: SparkSession, path: str) -> DataFrame:
    return formats.loci_csv(spark, path).withColumns({"src": F.col("src_id"), "strand": F.lit("+")})


def gene_features(spark: SparkSession, path: str) -> DataFrame:
    """BED12 rows as genes: one exon where a row has no blocks, no coding span where it has none."""
    b = formats.bed(spark, path).filter("s IS NOT NULL")
    whole = F.array(F.struct("s", "e"))
    exons = F.when(F.size(F.coalesce("blocks", F.array())) > 0, F.col("blocks")).otherwise(whole)
    return b.select("chrom", "s", "e", "name", F.coalesce("strand", F.lit("+")).alias("strand"), exons.alias("exons"), F.coalesce("thick_s", "s").alias("ts"), F.coalesce("thick_e", "s").alias("te"))


@tool
def merge_bed(spark: SparkSession, source: str, out: str, gap: int = 0, stranded: bool = False) -> None:
    """Maximal unions of features, bridging gaps."""
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    writers.bed(intervals.merge_islands(bed_elements(spark, source), keys, gap).withColumn("score", F.col("n")), out)


@tool
def filter_bed(spark: SparkSession, source: str, out: str, least: int = 1, most: int = 1 << 40, strand: str = "*", least_score: float = -1e300, most_score: float = 1e300, include: str = "", exclude: str = "") -> None:
    """Features by length, score, strand and patterns of their chromosomes."""
    rules = filters.ElementFilter(least_length=least, most_length=most, strand=strand, include_chroms=words(include), exclude_chroms=words(exclude))
    kept = rules.kept(bed_elements(spark, source))
    writers.bed(kept.filter(F.coalesce("score", F.lit(0.0)).between(least_score, most_score)), out)


@tool
def bed_to_csv(spark: SparkSession, source: str, out: str, kind: str = "element", species: str = "") -> None:
    b = bed_elements(spark, source)
    writers.loci_csv(b.withColumns({"src_id": F.col("src") + 1, "el_type": F.lit(kind), "species": F.lit(species)}), out)


@tool
def csv_to_bed(spark: SparkSession, source: str, out: str) -> None:
    writers.bed(csv_elements(spark, source).withColumn("name", F.concat_ws(".", "el_type", F.col("src_id").cast("string"))), out)


@tool
def blast_to_csv(spark: SparkSession, source: str, out: str) -> None:
    put(tabular.blast(spark, source), out)


@tool
def psl_to_csv(spark: SparkSession, source: str, out: str) -> None:
    p = formats.psl(spark, source)
    writers.loci_csv(p.select(F.monotonically_increasing_id().alias("src_id"), F.lit("alignment").alias("el_type"), F.col("q_name").alias("species"), F.col("t_name").alias("chrom"), F.col("t_start").alias("s"), F.col("t_end").alias("e")), out)


@tool
def csv_sets(spark: SparkSession, ref: str, rel: str, out: str, mode: str = "intersect", least: int = 1, most: int = 1 << 40, flank: int = 0) -> None:
    """Set algebra of two files of elements: intersect, ref_only, rel_only, union or neither; by length at the end."""
    both = csv_elements(spark, ref).withColumn("ref", F.lit(True)).unionByName(csv_elements(spark, rel).withColumn("ref", F.lit(False)))
    both = both.withColumns({"s": F.greatest(F.col("s") - flank, F.lit(0)), "e": F.col("e") + flank})
    d = intervals.neither(both, ["chrom"]) if mode == "neither" else intervals.set_operation(both, ["chrom"], F.col("ref"), ~F.col("ref"), mode)
    d = d.filter((F.col("e") - F.col("s") + 1).between(least, most))
    writers.loci_csv(d.withColumns({"src_id": F.monotonically_increasing_id() + 1, "el_type": F.lit(mode), "species": F.lit("")}), out)


@tool
def filter_csv(spark: SparkSession, source: str, out: str, least: int = 1, most: int = 1 << 40, species: str = "", include: str = "", exclude: str = "", include_loci: str = "", exclude_loci: str = "", overlapped: str = "", limit: int = 0) -> None:
    """Elements by all rules at once; overlapped: yes for those that share bases with others, no for those that don't; limit: so many at random."""
    zone = lambda p: csv_elements(spark, p) if p else None
    rules = filters.ElementFilter(least_length=least, most_length=most, species=words(species), include_chroms=words(include), exclude_chroms=words(exclude), include_loci=zone(include_loci), exclude_loci=zone(exclude_loci))
    kept = rules.kept(csv_elements(spark, source))
    kept = filters.alone_or_not(kept, ["chrom"], overlapped == "yes") if overlapped else kept
    writers.loci_csv(simulate.limited(kept, ["src", "chrom", "s", "e"], limit, 1) if limit else kept, out)


@tool
def reject_reasons(spark: SparkSession, source: str, out: str, least: int = 1, most: int = 1 << 40, include: str = "", exclude: str = "") -> None:
    """How many elements each rule turns away."""
    rules = filters.ElementFilter(least_length=least, most_length=most, include_chroms=words(include), exclude_chroms=words(exclude))
    put(rules.reasons(csv_elements(spark, source)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n")), out)


@tool
def length_points(spark: SparkSession, source: str, out: str, points: str = "10,20,30,40,50,60,70,80,90") -> None:
    """The length down to which the longest sequences hold each share of all bases."""
    put(tables.nxx(formats.fasta(spark, source).select(F.char_length("seq").cast("bigint").alias("len")), [int(x) for x in words(points)]), out)


@tool
def sequence_bed(spark: SparkSession, source: str, out: str) -> None:
    """Names and lengths of sequences."""
    f = formats.fasta(spark, source)
    writers.bed(f.select(F.col("name").alias("chrom"), F.lit(0).cast("bigint").alias("s"), (F.char_length("seq").cast("bigint") - 1).alias("e"), "name").filter("e >= 0"), out)


@tool
def pseudo_genome(spark: SparkSession, source: str, out: str, offsets: str, spacer: int = 100, name: str = "pseudo") -> None:
    """All sequences in the order of their names as pieces of one, with Ns between, and where each begins."""
    f = formats.fasta(spark, source).withColumns({"len": F.char_length("seq").cast("bigint"), "all": F.lit(1)})
    cell = F.pmod(F.xxhash64("name"), F.lit(1 << 20))
    f = f.withColumn("key", cell)
    d = scans.running(f, ["all"], ["key", "name"], "key", {"s": ("sum", F.col("len") + spacer)}, before=True)
    writers.fasta(d.select(F.concat_ws(":", F.lit(name), F.col("s").cast("string")).alias("name"), F.concat("seq", F.repeat(F.lit("N"), F.lit(spacer))).alias("seq")), out)
    writers.bed(d.select(F.lit(name).alias("chrom"), "s", (F.col("s") + F.col("len") - 1).alias("e"), "name"), offsets)


@tool
def filter_fasta(spark: SparkSession, source: str, out: str, unknown: int = 1 << 20, flip: bool = False) -> None:
    """Sequences with unique names and without long runs of N; on the other strand if so asked."""
    f = filters.without_long_unknown(filters.unique_names(formats.fasta(spark, source), "name", ["descriptor", "seq"]), unknown)
    writers.fasta(f.withColumn("seq", reverse_complement(F.col("seq"))) if flip else f, out)


@tool
def extract_fasta(spark: SparkSession, source: str, out: str, patterns: str, start: int = 0, size: int = 1 << 30, flip: bool = False) -> None:
    """Sequences whose descriptors have a pattern, or a stretch of each."""
    writers.fasta(filters.extracted(formats.fasta(spark, source), words(patterns), start, size, flip), out)


@tool
def split_fasta(spark: SparkSession, source: str, out: str, files: int = 8) -> None:
    writers.fasta(formats.fasta(spark, source).repartition(files), out)


@tool
def loci_fasta(spark: SparkSession, loci: str, sequences: str, out: str, before: int = 0, after: int = 0) -> None:
    """The sequence of each element with its flanks."""
    s = formats.fasta(spark, sequences).select(F.col("name").alias("chrom"), "seq")
    d = remap.slices(csv_elements(spark, loci), s, before, after)
    writers.fasta(d.withColumn("name", F.concat_ws("|", F.col("src_id").cast("string"), "chrom", F.col("s").cast("string"), F.col("e").cast("string"))), out)


@tool
def composition(spark: SparkSession, source: str, out: str, size: int = 1) -> None:
    """How often each k-mer of bases occurs; ones with anything else aren't counted."""
    f = formats.fasta(spark, source).select(F.upper("seq").alias("text"))
    put(tables.kmer_counts(f, size, []).filter(F.col("kmer").rlike("^[ACGT]+$")), out)


@tool
def tandem_repeats(spark: SparkSession, source: str, out: str, shortest: int = 2, longest: int = 5, least: int = 5, most: int = 50) -> None:
    f = formats.fasta(spark, source).select(F.col("name").alias("id"), "seq")
    put(reads.tandem_repeats(f, shortest, longest, least, most), out)


@tool
def read_quality(spark: SparkSession, source: str, out: str, schema: int = 0) -> None:
    """How often each offset has each quality."""
    put(reads.quality_histogram(formats.fastq(spark, source).select(F.col("quality").alias("qual")), reads.phred(schema)), out)


@tool
def filter_reads(spark: SparkSession, source: str, out: str, schema: int = 0, least: float = 20.0, keep_copies: bool = False) -> None:
    """Reads of good quality without unknown bases, each sequence once."""
    r = reads.quality_filtered(formats.fastq(spark, source).withColumn("qual", F.col("quality")), schema, least)
    writers.fastq(r if keep_copies else r.groupBy("seq").agg(F.min(F.struct("name", "quality")).alias("f")).select("f.name", "seq", "f.quality"), out)


@tool
def stack_reads(spark: SparkSession, source: str, out: str) -> None:
    put(reads.stacks(formats.fastq(spark, source).select(F.col("name").alias("id"), "seq")), out)


@tool
def split_pairs(spark: SparkSession, source: str, out: str, flip: bool = False) -> None:
    d = reads.split_pairs(formats.fasta(spark, source).select(F.col("name").alias("id"), "seq"), flip)
    writers.fasta(d.withColumn("name", F.concat_ws("/", "id", F.col("mate").cast("string"))), out)


@tool
def merge_pairs(spark: SparkSession, first: str, second: str, out: str, least: int = 10, rate: float = 0.05) -> None:
    """Pairs whose reads overlap, as one sequence; mates have the same name up to a slash."""
    one = lambda p, k: formats.fastq(spark, p).select(F.regexp_replace("name", r"/[12]$", "").alias("id"), F.col("seq").alias(f"seq{k}"), F.col("quality").alias(f"qual{k}"))
    m = reads.merged_pairs(one(first, 1).join(one(second, 2), "id"), least, rate).filter("seq IS NOT NULL")
    writers.fasta(m.withColumn("name", F.col("id")), out)


@tool
def count_features(spark: SparkSession, loci: str, features: str, out: str) -> None:
    """Reads of each feature, and these by its length and by all reads."""
    l, f = bed_elements(spark, loci), formats.bed(spark, features)
    p = intervals.overlap_join(l.select("src", "chrom", "s", "e"), f.select("chrom", "s", "e", "name"))
    n = p.groupBy(F.col("r_name").alias("name"), (F.col("r_e") - F.col("r_s") + 1).alias("length")).agg(F.count("*").alias("reads"))
    total = l.agg(F.count("*").alias("all"))
    put(n.join(F.broadcast(total)).select("name", "length", "reads", (F.col("reads") * 1e9 / F.col("length") / F.col("all")).alias("rpkm")), out)


@tool
def gene_regions(spark: SparkSession, loci: str, features: str, out: str, distance: int = 2000) -> None:
    """Loci and their bases by length class and region."""
    l = bed_elements(spark, loci).withColumn("len", F.col("e") - F.col("s") + 1)
    b = genes.component_bits(l, gene_features(spark, features), distance, ["len"])
    cls = G.length_class(F.col("len"), [10, 20, 50, 100, 200, 500, 1000])
    put(b.groupBy(cls.alias("cls"), G.region_name(G.region_index(F.col("bits"))).alias("region")).agg(F.count("*").alias("n"), F.sum("len").alias("bases")), out)


@tool
def assign_genes(spark: SparkSession, loci: str, features: str, out: str, distance: int = 2000) -> None:
    l = bed_elements(spark, loci)
    g = genes.gene_of(l, gene_features(spark, features), distance)
    put(l.join(g.withColumnRenamed("name", "gene"), "src", "left").select("chrom", "s", "e", "gene", "how"), out)


@tool
def distances(spark: SparkSession, loci: str, features: str, out: str) -> None:
    """Bases from each locus to the last feature before it and the first after it."""
    l, f = bed_elements(spark, loci), formats.bed(spark, features)
    up = intervals.nearest_upstream(l, f).select("src", "chrom", "s", "e", F.col("dist").alias("before"))
    put(up.join(intervals.nearest_downstream(l, f).select("src", F.col("dist").alias("after")), "src").drop("src"), out)


@tool
def dropouts(spark: SparkSession, ref: str, rel: str, out: str, percent: int = 0, least: int = 0) -> None:
    """Elements of one file that the other has none alike of, both ends within a tolerance."""
    writers.loci_csv(genes.tolerant_dropouts(csv_elements(spark, ref), csv_elements(spark, rel), percent, least), out)


@tool
def regions(spark: SparkSession, source: str, out: str, depth: int = 2, gap: int = 10, least: int = 1) -> None:
    """Regions that reads cover so deep, gaps bridged, with the bases that cover them as the score."""
    seg = intervals.depth_segments(bed_elements(spark, source), ["chrom"], {"n": F.lit(True)}).filter(F.col("n") >= depth)
    roi = intervals.merge_islands(seg.withColumnRenamed("n", "deep"), ["chrom"], gap, {"bases": F.col("deep") * (F.col("e") - F.col("s") + 1)})
    writers.bed(roi.filter(F.col("e") - F.col("s") + 1 >= least).withColumn("score", F.col("bases")), out)


@tool
def coverage(spark: SparkSession, source: str, out: str) -> None:
    """Depth as wiggle."""
    seg = intervals.depth_segments(bed_elements(spark, source), ["chrom"], {"n": F.lit(True)})
    writers.wig(seg.withColumn("value", F.col("n")), out)


@tool
def feature_depth(spark: SparkSession, wig: str, features: str, out: str) -> None:
    w = tabular.wig_steps(spark, wig).withColumnRenamed("value", "depth")
    put(tables.feature_depth(w, formats.bed(spark, features), "depth"), out)


@tool
def remap_bed(spark: SparkSession, source: str, psl: str, out: str) -> None:
    """Features on a query's coordinates to the target's, through aligned blocks; blocks of the minus strand are left out."""
    p = formats.psl(spark, psl).filter("strand = '+'")
    b = p.select("q_name", "t_name", "strand", F.inline(F.arrays_zip("block_sizes", "q_starts", "t_starts")))
    blocks = b.select(F.col("q_name").alias("chrom"), F.col("q_starts").alias("s"), (F.col("q_starts") + F.col("block_sizes") - 1).alias("e"), F.col("t_name").alias("to_chrom"), F.col("t_starts").alias("to_s"), "strand")
    l = bed_elements(spark, source)
    m = remap.remapped_ends(l, blocks).join(l.select("src", "name", "score", "strand"), "src")
    writers.bed(m.select(F.col("to_chrom").alias("chrom"), F.col("to_s").alias("s"), F.col("to_e").alias("e"), "name", "score", "strand"), out)


@tool
def filter_alignments(spark: SparkSession, source: str, out: str, include: str = "", exclude: str = "", prefix: str = "") -> None:
    """Alignments by patterns of their chromosomes, or on those with a prefix, which is taken off."""
    a = formats.sam(spark, source).filter(filters.accepted(F.col("chrom"), words(include), words(exclude)))
    a = filters.of_prefix(a, "chrom", prefix) if prefix else a
    sizes = {r[0]: r[1] + 1 for r in a.filter("chrom <> '*'").groupBy("chrom").agg(F.max("e")).limit(1_000_000).collect()}
    writers.sam(a, out, sizes)


@tool
def prefix_fasta(spark: SparkSession, source: str, out: str, prefix: str) -> None:
    writers.fasta(filters.with_prefix(formats.fasta(spark, source), "name", prefix), out)


@tool
def snps_to_variants(spark: SparkSession, source: str, out: str, style: str = "vcf", least: int = 1) -> None:
    """SNP calls as VCF or personal genome alleles."""
    s = tabular.snps(spark, source).filter(F.col("bases") >= least)
    if style == "vcf":
        alt = F.array_join(F.filter(F.array(*[F.when((F.col(b) > 0) & (F.upper("ref") != b.upper()), b.upper()) for b in "acgt"]), lambda x: x.isNotNull()), ",")
        info = F.concat(F.lit("DP="), F.col("bases").cast("string"))
        writers.vcf(s.withColumns({"alt": F.when(alt == "", ".").otherwise(alt), "info": info, "name": F.col("site")}), out)
    else:
        writers.pg_snp(s, out)


@tool
def snp_tables(spark: SparkSession, source: str, folder: str, experiment: str, cultivar: str) -> None:
    s = tabular.snps(spark, source).withColumn("species", F.col("target"))
    relational.stored(relational.snp_tables(s, experiment, cultivar, source), folder)


@tool
def alignment_tables(spark: SparkSession, source: str, folder: str, experiment: str) -> None:
    relational.stored(relational.alignment_tables(formats.psl(spark, source), experiment, source), folder)


@tool
def enrich(spark: SparkSession, hits: str, obo: str, gaf: str, out: str, correction: str = "bh") -> None:
    """Terms that a sample of genes has more often than all annotated genes, with corrected chances."""
    terms = formats.obo(spark, obo)
    edges = terms.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))
    a = formats.gaf(spark, gaf).filter(~F.coalesce(F.col("qualifier").contains("NOT"), F.lit(False))).select(F.lower("symbol").alias("gene"), F.col("go_id").alias("term"))
    sample = ontology.weight_reduced(tabular.hits(spark, hits))
    e = ontology.enriched(a, edges, sample).withColumn("id", F.xxhash64("term"))
    adj = tables.corrected(e.select("id", F.col("fisher_p").alias("p")), correction).select("id", "adj")
    put(e.join(adj, "id").join(terms.select(F.col("id").alias("term"), "name"), "term", "left").drop("id"), out)


@tool
def substitutions(spark: SparkSession, source: str, out: str, size: int = 25, most: int = 2) -> None:
    """Of every k-mer of sequences the fewest substitutions to any other, on either strand."""
    f = formats.fasta(spark, source).select(F.col("name").alias("id"), F.upper("seq").alias("seq"))
    put(search.merged_distances(search.least_substitutions(f, size, most), search.least_substitutions(f, size, most, reverse=True)), out)


@tool
def kmer_counts(spark: SparkSession, source: str, out: str, size: int = 8) -> None:
    put(tables.kmer_counts(formats.fasta(spark, source).select(F.upper("seq").alias("text")), size, []), out)


@tool
def kmer_markers(spark: SparkSession, sources: str, out: str, size: int = 25) -> None:
    """k-mers that the sequences of one file only have, on either strand. sources: files, with commas."""
    parts = None
    for p in words(sources):
        f = formats.fasta(spark, p).select(F.lit(p).alias("grp"), F.upper("seq").alias("text"))
        parts = f if parts is None else parts.unionByName(f)
    c = tables.kmers(parts, size, ["grp"]).filter(~F.contains("kmer", F.lit("N"))).select("grp", F.least("kmer", reverse_complement(F.col("kmer"))).alias("kmer"))
    c = c.groupBy("grp", "kmer").agg(F.count("*").alias("n"))
    put(c.groupBy("kmer").agg(F.count("*").alias("k"), F.min("grp").alias("grp"), F.min("n").alias("n")).filter("k = 1").drop("k"), out)


@tool
def local_matches(spark: SparkSession, queries: str, targets: str, out: str, size: int = 12, least: float = 30, most: int = 5) -> None:
    """Chains of shared k-mers of queries and targets, the best ones of each query."""
    f = lambda p: formats.fasta(spark, p).select(F.col("name").alias("id"), F.upper("seq").alias("seq"))
    put(search.local_matches(f(queries), f(targets), size, least, most), out)


@tool
def assemble(spark: SparkSession, source: str, out: str, least: int = 20) -> None:
    """Sequences that overlap without a branch, as one; contained ones go."""
    f = search.without_contained(formats.fasta(spark, source).select(F.col("name").alias("id"), F.upper("seq").alias("seq")), least)
    c = assembly.contigs(f, assembly.reduced_edges(assembly.best_edges(search.end_overlaps(f, least))))
    writers.fasta(c.withColumn("name", F.col("contig")), out)


@tool
def scaffold(spark: SparkSession, source: str, out: str, least: int = 3) -> None:
    """Contigs that mates link, from alignments."""
    a = formats.sam(spark, source).filter("chrom <> '*' AND mate_chrom <> '*' AND chrom <> mate_chrom AND flag & 64 > 0")
    put(assembly.scaffold_edges(a.select(F.col("chrom").alias("contig1"), F.col("mate_chrom").alias("contig2"), F.abs("tlen").alias("gap")), least), out)


@tool
def genome_of_parts(spark: SparkSession, agp: str, contigs: str, out: str) -> None:
    """Sequences of assembled objects, a record for each part, named by object and place."""
    d = tabular.assembled(tabular.agp(spark, agp), formats.fasta(spark, contigs))
    writers.fasta(d.withColumn("name", F.concat_ws(":", "object", F.col("s").cast("string"))), out)


@tool
def alignment_statistics(spark: SparkSession, maf: str, out: str) -> None:
    put(remap.column_identity(tabular.maf(spark, maf)), out)


@tool
def conserved(spark: SparkSession, maf: str, out: str, mismatches: int = 0, least: int = 50) -> None:
    """Runs of columns of alignment blocks that are the same in all but so many columns."""
    put(remap.conserved_runs(tabular.maf(spark, maf), mismatches, least), out)


@tool
def differential(spark: SparkSession, control: str, treated: str, features: str, out: str, bins: int = 10) -> None:
    """Counts of features in two samples, their fold change, and how alike their bins are."""
    l = bed_elements(spark, control).withColumn("side", F.lit(0)).unionByName(bed_elements(spark, treated).withColumn("side", F.lit(1)), allowMissingColumns=True)
    b = tables.feature_bins(l, gene_features(spark, features), bins, {"control": F.col("side") == 0, "treated": F.col("side") == 1})
    total = b.groupBy("name").agg(F.sum("control").alias("control"), F.sum("treated").alias("treated"))
    both = total.join(expression.laplace_pearson(b, ["name"], "control", "treated"), "name").join(tables.bin_overlap(b, ["name"], "control", "treated"), "name")
    put(both.withColumn("fold", (F.col("treated") + 1) / (F.col("control") + 1)), out)


@tool
def count_matrix(spark: SparkSession, samples: str, out: str, least: int = 0) -> None:
    """Counts of features of several samples as a wide table. samples: files, with commas."""
    d = lists.sample_counts({p: lists.feature_counts(spark, p, least_count=least) for p in words(samples)})
    writers.count_matrix(d, "feature", "sample", "reads", words(samples), out)


@tool
def unpivot(spark: SparkSession, source: str, out: str) -> None:
    """A wide table in long form."""
    put(tabular.matrix(spark, source), out)


@tool
def alleles(spark: SparkSession, sources: str, out: str) -> None:
    """Loci, and those with alleles in all readsets, of files of packed base alleles."""
    a = lists.pba(spark, words(sources))
    n = a.select("readset").distinct().count()
    per = a.groupBy("chrom", "locus").agg(F.count("*").alias("n"), F.count_distinct("alleles").alias("k"))
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    put(per.groupBy("chrom").agg(F.count("*").alias("loci"), hit(F.col("n") == n).alias("full"), hit((F.col("n") == n) & (F.col("k") == 1)).alias("same")), out)


@tool
def simulate_reads(spark: SparkSession, out: str, genome: str, n: int = 1000, chroms: int = 2, size: int = 100_000, length: int = 100, errors: float = 0.01, seed: int = 1) -> None:
    """A random genome, and reads from it whose names tell where they come from."""
    g = simulate.genome(spark, chroms, size, seed)
    writers.fasta(g.select(F.concat_ws(":", F.col("chrom").cast("string"), F.col("start").cast("string")).alias("name"), "seq"), genome)
    r = simulate.reads(spark, n, chroms, size, length, errors, seed, seed + 1)
    writers.fasta(r.withColumn("name", F.concat_ws("|", *[F.col(c).cast("string") for c in ("id", "chrom", "start", "strand", "subs")])), out)


@tool
def simulate_counts(spark: SparkSession, out: str, features: int = 1000, samples: int = 6, mean: float = 50.0, changed: float = 0.1, fold: float = 3.0, seed: int = 1) -> None:
    put(simulate.expression_counts(spark, features, samples, mean, changed, fold, seed), out)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lociflow.tools", description=__doc__)
    names = parser.add_subparsers(dest="tool", required=True)
    for name, f in TOOLS.items():
        p = names.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for k, v in list(inspect.signature(f).parameters.items())[1:]:
            if v.default is inspect.Parameter.empty:
                p.add_argument(k)
            elif isinstance(v.default, bool):
                p.add_argument(f"--{k.replace('_', '-')}", dest=k, action="store_true")
            else:
                p.add_argument(f"--{k.replace('_', '-')}", dest=k, type=type(v.default), default=v.default)
    given = vars(parser.parse_args(arguments))
    f = TOOLS[given.pop("tool")]
    f(SparkSession.builder.getOrCreate(), **given)


if __name__ == "__main__":
    main()
