"""Readers of tabular files (delimited tables, matrices, SNP calls, hits) and of alignment blocks (MAF, AXT, AGP, BLAST, BAM).

As in formats, intervals come out 0-based and closed, and what doesn't parse is null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import carried, fields, lines, number


def likely_heading(values: list[str | None]) -> bool:
    """Whether a row is one of headings: every field that isn't empty is no number, quoted fields count as words, and fewer than three are empty."""

    def plain_number(v: str) -> bool:
        try:
            float(v)
        except ValueError:
            return False
        return True

    empty = sum(v is None or not v.strip() for v in values)
    return bool(values) and empty < 3 and empty < len(values) and not any(plain_number(v.strip()) for v in values if v is not None and v.strip())


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table of strings: columns have the first row's names if it reads like headings, else c1, c2 and so on; quotes are resolved."""
    t = spark.read.option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    first = t.first()
    if first is None or not likely_heading(list(first)):
        return t.toDF(*[f"c{i + 1}" for i in range(len(t.columns))])
    names = [v.strip() if v and v.strip() else f"c{i + 1}" for i, v in enumerate(first)]
    names = [n if names.index(n) == i else f"{n}_{i + 1}" for i, n in enumerate(names)]
    # Every file's first row is a heading then; one that differs is data.
    return spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def kind_of(spark: SparkSession, path: str, looked_at: int = 100) -> str | None:
    """csv, bed or sam by the first lines of a file; null where they tell nothing."""
    head = [r[0] for r in spark.read.text(path).limit(looked_at).collect()]
    for line in head:
        if line[:4] in ("@HD\t", "@SQ\t", "@RG\t", "@PG\t", "@CO\t"):
            return "sam"
        if not line.strip() or line.startswith(("#", "track", "browser")):
            continue
        tabs = line.split("\t")
        if len(tabs) >= 11 and tabs[1].isdigit() and tabs[3].isdigit():
            return "sam"
        if len(tabs) >= 3 and tabs[1].strip().isdigit() and tabs[2].strip().isdigit():
            return "bed"
        if len(line.split(",")) >= 3:
            return "csv"
    return None


def matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(row, col, value) of a wide table: a heading of column names, then a label and a number for each column; in long form."""
    t = delimited(spark, path, sep)
    label, rest = t.columns[0], t.columns[1:]
    cells = F.array(*[F.struct(F.lit(c).alias("col"), number(F.col(f"`{c}`"), "double").alias("value")) for c in rest])
    return t.select(F.col(f"`{label}`").alias("row"), F.inline(cells))


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(row, cls) of a table of labels."""
    t = delimited(spark, path)
    return t.select(F.col(f"`{t.columns[0]}`").alias("row"), F.col(f"`{t.columns[1]}`").alias("cls"))


def hits(spark: SparkSession, path: str) -> DataFrame:
    """(gene, weight): the weight is 1 where there is none."""
    t = delimited(spark, path)
    weight = number(F.col(f"`{t.columns[1]}`"), "double") if len(t.columns) > 1 else F.lit(None).cast("double")
    return t.select(F.col(f"`{t.columns[0]}`").alias("gene"), F.coalesce(weight, F.lit(1.0)).alias("weight"))


def renames(spark: SparkSession, path: str) -> dict[str, str]:
    """Names of chromosomes and what they are to be called: a short table."""
    t = delimited(spark, path)
    return {r[0]: r[1] for r in t.limit(1_000_000).collect()}


def renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with the names of a column replaced as the table (name, to) says; others stay."""
    to = names.select(F.col("name").alias("_name"), F.col("to").alias("_to"))
    return df.join(to, F.col(column) == F.col("_name"), "left").withColumn(column, F.coalesce("_to", column)).drop("_name", "_to")


#: Fields of SNP calls by their place from 1.
SNP = {"site": 1, "target": 3, "chrom": 4, "s": 5, "len": 7, "bases": 11, "mismatches": 12, "ref": 13, "a": 14, "c": 15, "g": 16, "t": 17, "n": 18, "rate": 19}


def snps(spark: SparkSession, path: str) -> DataFrame:
    """Sites of SNP calls with their base counts; a heading falls out, as its site is no number."""
    t = delimited(spark, path)
    at = lambda i: F.col(f"`{t.columns[i - 1]}`") if i <= len(t.columns) else F.lit(None).cast("string")
    whole = {"site", "s", "len", "bases", "mismatches", "a", "c", "g", "t", "n"}
    return t.select(*[number(at(i)).alias(k) if k in whole else number(at(i), "double").alias(k) if k == "rate" else at(i).alias(k) for k, i in SNP.items()]).filter("site IS NOT NULL AND s IS NOT NULL")


def blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits of 12 fields: ranges closed from 0, the strand by the order of the subject's ends."""
    names = "query subject identity length mismatches gaps q_from q_to s_from s_to expect bits".split()
    t = fields(lines(spark, path), names)
    a, b = number(F.col("s_from")), number(F.col("s_to"))
    return t.select(
        "query", F.col("subject").alias("chrom"), (F.least(a, b) - 1).alias("s"), (F.greatest(a, b) - 1).alias("e"), F.when(a <= b, "+").otherwise("-").alias("strand"), (number(F.col("q_from")) - 1).alias("q_s"), (number(F.col("q_to")) - 1).alias("q_e"),
        number(F.col("identity"), "double").alias("identity"), *[number(F.col(c)).alias(c) for c in ("length", "mismatches", "gaps")], number(F.col("expect"), "double").alias("expect"), number(F.col("bits"), "double").alias("bits"),
    )


def agp(spark: SparkSession, path: str) -> DataFrame:
    """Parts of assembled objects, from 0 and closed: kind N and U are gaps, with their length; others have a component and its range."""
    names = "object from to part kind component c_from c_to orientation".split()
    t = fields(lines(spark, path), names)
    gap = F.col("kind").isin("N", "U")
    return t.select(
        "object", (number(F.col("from")) - 1).alias("s"), (number(F.col("to")) - 1).alias("e"), number(F.col("part")).alias("part"), "kind", F.when(gap, number(F.col("component"))).alias("gap"), F.when(~gap, F.col("component")).alias("component"),
        F.when(~gap, number(F.col("c_from")) - 1).alias("c_s"), F.when(~gap, number(F.col("c_to")) - 1).alias("c_e"), F.when(~gap, F.col("orientation")).alias("orientation"),
    )


def assembled(parts: DataFrame, contigs: DataFrame) -> DataFrame:
    """(object, part, s, seq): the sequence of each part of an assembly; gaps are Ns, parts on the minus strand reverse complements."""
    from ..functions.sequence import reverse_complement

    d = parts.join(contigs.select(F.col("name").alias("component"), "seq"), "component", "left")
    piece = F.substring(F.col("seq"), (F.col("c_s") + 1).cast("int"), (F.col("c_e") - F.col("c_s") + 1).cast("int"))
    seq = F.when(F.col("gap").isNotNull(), F.repeat(F.lit("N"), F.col("gap").cast("int"))).when(F.col("orientation") == "-", reverse_complement(piece)).otherwise(piece)
    return d.select("object", "part", "s", seq.alias("seq"))


def maf(spark: SparkSession, path: str) -> DataFrame:
    """(block, score, src, s, size, strand, src_size, seq): the rows of alignment blocks; s counts on the row's strand."""
    t = carried(spark, path, F.col("value").rlike(r"^a(\s|$)")).filter(F.col("head").isNotNull() & F.col("value").rlike(r"^s\s"))
    p = F.split("value", r"\s+")
    score = number(F.regexp_extract("head.value", r"score=(\S+)", 1), "double")
    return t.select(F.concat_ws(":", "file", F.col("head.at")).alias("block"), score.alias("score"), p[1].alias("src"), number(p[2]).alias("s"), number(p[3]).alias("size"), p[4].alias("strand"), number(p[5]).alias("src_size"), p[6].alias("seq"))


def axt(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise blocks: a heading of both ranges (from 1 in the file), then the two aligned sequences."""
    t = carried(spark, path, F.col("value").rlike(r"^\d+\s+\S+\s+\d+\s")).filter(F.col("head").isNotNull() & F.col("value").rlike(r"^[A-Za-z-]+$"))
    two = t.groupBy("file", "head.at", F.col("head.value").alias("h")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at").alias("line"), "value"))), lambda x: x["value"]).alias("v"))
    p = F.split("h", r"\s+")
    return two.select(
        number(p[0]).alias("block"), p[1].alias("chrom"), (number(p[2]) - 1).alias("s"), (number(p[3]) - 1).alias("e"), p[4].alias("other"), (number(p[5]) - 1).alias("other_s"), (number(p[6]) - 1).alias("other_e"), p[7].alias("strand"),
        number(F.get(p, F.lit(8)), "double").alias("score"), F.get("v", F.lit(0)).alias("seq"), F.get("v", F.lit(1)).alias("other_seq"),
    )


def wig_steps(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e, value) of fixedStep and variableStep lines.

    A fixed step's place follows from the lines since its heading: within a split by their numbers, across splits by one row a split.
    """
    heading = F.col("value").rlike(r"^(fixed|variable)Step\b")
    t = carried(spark, path, heading)
    first = F.min("at").over(Window.partitionBy("file", "block"))
    t = t.withColumns({"_first": first, "_own": F.col("head.at") >= first})
    per = t.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("f"), F.max(F.when(F.col("_own"), F.col("head.at"))).alias("m"))
    # Lines of a split after its last heading, or all of them if it has none.
    per = per.withColumn("open", F.when(F.col("m").isNotNull(), F.col("f") + F.col("n") - 1 - F.col("m")).otherwise(F.col("n")))
    w = Window.partitionBy("file").orderBy("block")
    per = per.withColumn("_run", F.sum(F.col("m").isNotNull().cast("int")).over(w))
    per = per.withColumn("_upto", F.sum("open").over(Window.partitionBy("file", "_run").orderBy("block")))
    # A split's lines before any heading of its own follow the open ones of the splits since the last heading.
    since = per.select("file", "block", F.lag("_upto").over(w).alias("since"))
    d = t.join(since, ["file", "block"], "left").filter(F.col("head").isNotNull() & F.col("value").rlike(r"^[-+.\d]"))
    at = lambda key: F.regexp_extract("head.value", rf"\b{key}=(\S+)", 1)
    index = F.when(F.col("_own"), F.col("at") - F.col("head.at") - 1).otherwise(F.col("at") - F.col("_first") + F.coalesce("since", F.lit(0)))
    p = F.split("value", r"\s+")
    fixed = F.col("head.value").startswith("fixed")
    s = F.when(fixed, number(at("start")) - 1 + index * F.coalesce(number(at("step")), F.lit(1))).otherwise(number(p[0]) - 1)
    return d.select(at("chrom").alias("chrom"), s.alias("s"), (s + F.coalesce(number(at("span")), F.lit(1)) - 1).alias("e"), F.when(fixed, number(p[0], "double")).otherwise(number(F.get(p, F.lit(1)), "double")).alias("value"))


BAM = "read string, flag int, chrom string, s long, mapq int, cigar string, mate_chrom string, mate_s long, tlen long, seq string, quality string"
#: Letters of packed bases and of CIGAR operations.
BAM_BASES, BAM_OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def _bam_records(stream) -> Iterator[tuple]:
    """Alignments of an unpacked BAM stream, one after the other."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("the file ends within a record")
        return data

    if take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    chroms = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        name = take(struct.unpack("<i", take(4))[0])[:-1].decode()
        take(4)
        chroms.append(name)
    named = lambda i: chroms[i] if i >= 0 else "*"
    while head := stream.read(4):
        body = take(struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_ops, flag, n_bases, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
        at = 32
        read = body[at : at + n_name - 1].decode()
        at += n_name
        ops = struct.unpack_from(f"<{n_ops}I", body, at)
        at += 4 * n_ops
        packed = body[at : at + (n_bases + 1) // 2]
        at += len(packed)
        seq = "".join(BAM_BASES[b >> 4] + BAM_BASES[b & 15] for b in packed)[:n_bases]
        quality = body[at : at + n_bases]
        text = "*" if not quality or quality[0] == 255 else "".join(chr(q + 33) for q in quality)
        yield read, flag, named(ref), pos, mapq, "".join(f"{o >> 4}{BAM_OPS[o & 15]}" for o in ops) or "*", named(mate), mate_pos, tlen, seq or "*", text


def bam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Alignments of BAM files. A file is one task's work, as records cross its blocks, but streams through it: no file is held."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        from pyarrow import fs

        names = [x.split()[0] for x in BAM.split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
                with system.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows = []
                    for row in _bam_records(stream):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInPandas(read, BAM)


def range_bin(s: Column, e: Column) -> Column:
    """The bin of the UCSC scheme, of five levels, that holds a closed range: the smallest one."""
    return F.coalesce(*[F.when(F.shiftright(s, b) == F.shiftright(e, b), F.lit(((1 << (29 - b)) - 1) // 7) + F.shiftright(s, b)) for b in (14, 17, 20, 23, 26)], F.lit(0))


def overlapping_bins(s: Column, e: Column, least: int = 14, depth: int = 5) -> Column:
    """All bins of a scheme of `depth` levels, the smallest with 2 ** least bases, that overlap a closed range."""
    out = [F.array(F.lit(0).cast("bigint"))]
    for level in range(1, depth + 1):
        shift, first = least + 3 * (depth - level), ((1 << 3 * level) - 1) // 7
        out.append(F.sequence(F.lit(first) + F.shiftright(s, shift), F.lit(first) + F.shiftright(e, shift)))
    return F.concat(*out)


def smallest_bin(s: Column, e: Column, least: int = 14, depth: int = 5) -> Column:
    """The smallest bin of such a scheme that holds a closed range."""
    levels = [(least + 3 * (depth - level), ((1 << 3 * level) - 1) // 7) for level in range(depth, 0, -1)]
    return F.coalesce(*[F.when(F.shiftright(s, b) == F.shiftright(e, b), F.lit(first) + F.shiftright(s, b)) for b, first in levels], F.lit(0))
