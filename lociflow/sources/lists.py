"""Readers of lists and small tables (names, classes, sizes, associations), estimates of files, and packed base alleles."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .formats import fields, lines, number
from .tables import delimited


def column(t: DataFrame, place: int) -> Column:
    """The column at a place from 1, null past the last."""
    return F.col(f"`{t.columns[place - 1]}`") if place <= len(t.columns) else F.lit(None).cast("string")


def sizes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(rows, most_fields, mean_fields, longest) of a delimited file."""
    t = spark.read.text(path).select(F.size(F.split("value", sep)).alias("n"), F.char_length("value").alias("c"))
    return t.agg(F.count("*").alias("rows"), F.max("n").alias("most_fields"), F.avg("n").alias("mean_fields"), F.max("c").alias("longest"))


def sequence_sizes(seqs: DataFrame) -> DataFrame:
    """(records, longest_descriptor, mean_descriptor, longest, mean) of sequences."""
    d, s = F.char_length("descriptor"), F.char_length("seq")
    return seqs.agg(F.count("*").alias("records"), F.max(d).alias("longest_descriptor"), F.avg(d).alias("mean_descriptor"), F.max(s).alias("longest"), F.avg(s).alias("mean"))


def sequence_kind(spark: SparkSession, path: str, looked_at: int = 100) -> str | None:
    """fasta or fastq by the first line that holds anything."""
    first = next((r[0].strip() for r in spark.read.text(path).limit(looked_at).collect() if r[0].strip()), "")
    return {">": "fasta", "@": "fastq"}.get(first[:1])


def of_descriptor(seqs: DataFrame, prefix: str) -> DataFrame:
    """Sequences whose descriptor begins so, whatever the case."""
    return seqs.filter(F.startswith(F.lower("descriptor"), F.lit(prefix.lower())))


def sub_sequence(seqs: DataFrame, start: int, most: int) -> DataFrame:
    """Up to `most` bases of each sequence from a place on."""
    return seqs.withColumn("seq", F.substring(F.col("seq"), start + 1, most))


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(src): whole numbers that begin the lines of a file."""
    return lines(spark, path).select(number(F.regexp_extract("value", r"^\s*\"?(-?\d+)", 1)).alias("src")).filter("src IS NOT NULL").distinct()


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name): the first field of each line, each once."""
    return lines(spark, path).select(F.regexp_extract("value", r"^\s*\"?([^\",\t]*)", 1).alias("name")).filter("name <> ''").distinct()


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(name, to): names and what they stand for, from two columns with a tab or a comma between."""
    p = F.split("value", r"\s*[\t,]\s*")
    return lines(spark, path).select(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("to")).filter("to IS NOT NULL AND to <> ''")


def gene_classes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cls)."""
    t = delimited(spark, path)
    return t.select(column(t, 1).alias("gene"), column(t, 2).alias("cls"))


def weighted_genes(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """(gene, weight) of expression results (gene, ..., p in the last column but one, adjusted p in the last): those up to the threshold, weighed by 1 - p."""
    t = delimited(spark, path)
    p = number(column(t, len(t.columns)), "double")
    return t.select(column(t, 1).alias("gene"), p.alias("_p")).filter(F.col("_p") <= threshold).select("gene", (1 - F.col("_p")).alias("weight"))


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size): the furthest end of a BED file's rows on each chromosome."""
    return formats.bed(spark, path).filter("e IS NOT NULL").groupBy("chrom").agg((F.max("e") + 1).alias("size"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e, strand) of elements' CSV: places to leave out; strand * where there is none."""
    t = formats.loci_csv(spark, path)
    return t.select("chrom", "s", "e", F.lit("*").alias("strand"))


def group_cores(spark: SparkSession, path: str, least: int = 0, most: int = 1 << 31) -> DataFrame:
    """Elements of a CSV as features (chrom, s, e, name, score), of some lengths."""
    t = formats.loci_csv(spark, path).filter((F.col("e") - F.col("s") + 1).between(least, most))
    return t.select("chrom", "s", "e", F.concat_ws("_", "el_type", F.col("src_id").cast("string")).alias("name"), F.lit(0.0).alias("score"))


def feature_counts(spark: SparkSession, path: str, least_length: int = 0, most_length: int = 1 << 31, least_count: int = 0) -> DataFrame:
    """(feature, length, rpkm, reads) of a sample's counts: fields 2, 3, 13 and 14."""
    t = delimited(spark, path)
    d = t.select(column(t, 2).alias("feature"), number(column(t, 3)).alias("length"), number(column(t, 13), "double").alias("rpkm"), number(column(t, 14)).alias("reads"))
    return d.filter(F.col("length").between(least_length, most_length) & (F.col("reads") >= least_count))


def sample_counts(samples: dict[str, DataFrame]) -> DataFrame:
    """(sample, feature, reads, rpkm) of several samples' counts, a feature's rows added up."""
    parts = [df.select(F.lit(k).alias("sample"), "feature", "reads", "rpkm") for k, df in samples.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("sample", "feature").agg(F.sum("reads").alias("reads"), F.sum("rpkm").alias("rpkm"))


def distances(spark: SparkSession, path: str) -> DataFrame:
    """(id, at, least) of distances as CSV: chromosome, place, distance."""
    t = delimited(spark, path)
    return t.select(column(t, 1).alias("id"), number(column(t, 2)).alias("at"), number(column(t, 3)).alias("least")).filter("at IS NOT NULL")


def snp_track(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e, name, strand, alleles) of a track with a leading bin column."""
    t = fields(lines(spark, path), "bin chrom start end name score strand ref_ncbi ref_ucsc observed".split())
    return t.select("chrom", number(F.col("start")).alias("s"), (number(F.col("end")) - 1).alias("e"), "name", "strand", F.split("observed", "/").alias("alleles"))


def marker_snps(spark: SparkSession, path: str, cultivars: list[str]) -> DataFrame:
    """(site, chrom, s, ref, species, base, score, a, c, g, t, n) of marker calls: four fields, then nine for each cultivar.

    A cultivar's fields: source, base, score, total, then the counts of A, C, G, T and N.
    """
    t = delimited(spark, path)
    each = [F.struct(F.lit(name).alias("species"), column(t, 6 + 9 * i).alias("base"), number(column(t, 7 + 9 * i)).alias("score"), *[number(column(t, 9 + 9 * i + k)).alias(b) for k, b in enumerate("acgtn")]) for i, name in enumerate(cultivars)]
    return t.select(number(column(t, 1)).alias("site"), column(t, 2).alias("chrom"), number(column(t, 3)).alias("s"), column(t, 4).alias("ref"), F.inline(F.array(*each))).filter("s IS NOT NULL")


def grouping(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, size, sample, grp) of groups in wide form: chromosome, start, size, then a group for each sample named in the heading."""
    t = delimited(spark, path)
    cells = F.array(*[F.struct(F.lit(c).alias("sample"), number(F.col(f"`{c}`")).alias("grp")) for c in t.columns[3:]])
    return t.select(column(t, 1).alias("chrom"), number(column(t, 2)).alias("s"), number(column(t, 3)).alias("size"), F.inline(cells))


def bin_specs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, size, least_distance, most_distance, most_groups) of bins to group in."""
    t = delimited(spark, path)
    return t.select(column(t, 1).alias("chrom"), *[number(column(t, i)).alias(n) for i, n in enumerate("s size least_distance most_distance most_groups".split(), 2)]).filter("s IS NOT NULL")


def gene_terms(spark: SparkSession, path: str) -> DataFrame:
    """(gene, term) of lines that name a gene and its terms, set apart by tabs, commas or blanks; terms look like GO:1234567."""
    gene = F.regexp_extract("value", r"^\s*([^\s,]+)", 1)
    return lines(spark, path).select(gene.alias("gene"), F.explode(F.regexp_extract_all("value", F.lit(r"(GO:\d{7})"), F.lit(1))).alias("term")).distinct()


def gff_terms(spark: SparkSession, path: str, name: str = "ID") -> DataFrame:
    """(gene, term) of GFF attributes, wherever they name a term."""
    t = formats.gff3(spark, path).filter(F.col("attributes")[name].isNotNull())
    terms = F.regexp_extract_all(F.array_join(F.map_values("attributes"), " "), F.lit(r"(GO:\d{7})"), F.lit(1))
    return t.select(F.col("attributes")[name].alias("gene"), F.explode(terms).alias("term")).distinct()


#: Kinds of contaminants by the digits that begin a descriptor.
CONTAMINANTS = {1: "5' end", 2: "3' end", 3: "vector"}


def contaminants(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, seq): contaminants of a FASTA file; kind is the number after an @ in the descriptor, 0 without one."""
    t = formats.fasta(spark, path)
    return t.select("name", F.coalesce(number(F.regexp_extract("descriptor", r"@(\d+)", 1), "int"), F.lit(0)).alias("kind"), F.upper("seq").alias("seq"))


def processed_reads(reads: DataFrame, trim5: int = 0, trim3: int = 0, keep_copies: bool = False) -> DataFrame:
    """(seq, n): reads without some bases at their ends; equal ones as one with their number unless copies are kept."""
    s = F.substring(F.col("seq"), trim5 + 1, F.greatest(F.char_length("seq") - trim5 - trim3, F.lit(0)))
    d = reads.select(s.alias("seq")).filter("seq <> ''")
    return d.withColumn("n", F.lit(1).cast("bigint")) if keep_copies else d.groupBy("seq").agg(F.count("*").alias("n"))


#: Bytes of alleles that a row of the plan stands for.
PBA_BLOCK = 1 << 20
PBA = "readset string, chrom string, locus long, alleles int"


def pba(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(readset, chrom, locus, alleles) of files of packed base alleles; loci without any allele are left out.

    The driver reads headings only, from chromosome to chromosome; blocks of alleles are read where they are unpacked.
    """
    from pyarrow import fs

    def opened(path: str):
        system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        return system.open_input_file(inner)

    plan = []
    for path in paths:
        with opened(path) as f:
            size = f.size()
            head = f.read_at(min(600, size), 0)
            tags = dict(x.split(":", 1) for x in head.split(b"\0", 1)[0].decode().split("\n") if ":" in x)
            if tags.get("Type") != "PbA" or tags.get("Version") != "1":
                raise ValueError(f"{path} holds no packed base alleles")
            at = head.index(b"\0") + 1
            while at < size:
                some = f.read_at(min(300, size - at), at)
                n = some[0]
                chrom, (length,) = some[1 : 1 + n].decode(), struct.unpack_from("<i", some, n + 2)
                first = at + n + 6
                plan += [(path, tags["ReadsetID"], chrom, k, first + k, min(PBA_BLOCK, length - k)) for k in range(0, length, PBA_BLOCK)]
                at = first + length

    def read(batches):
        import numpy as np

        for pdf in batches:
            for path, readset, chrom, start, at, n in pdf.itertuples(index=False, name=None):
                with opened(path) as f:
                    data = np.frombuffer(f.read_at(n, at), np.uint8)
                here = np.flatnonzero(data)
                yield pd.DataFrame({"readset": readset, "chrom": chrom, "locus": start + here, "alleles": data[here].astype(np.int32)})

    blocks = spark.createDataFrame(plan, "path string, readset string, chrom string, start long, at long, n long")
    return blocks.repartition(max(1, min(len(plan), 10_000))).mapInPandas(read, PBA)


def pba_bytes(readset: str, experiment: str, reference: str, chroms: dict[str, bytes]) -> bytes:
    """A file of packed base alleles."""
    head = f"Type:PbA\nVersion:1\nExperimentID:{experiment}\nReferenceID:{reference}\nReadsetID:{readset}".encode() + b"\0"
    return head + b"".join(bytes([len(c.encode())]) + c.encode() + b"\0" + struct.pack("<i", len(a)) + a for c, a in chroms.items())
