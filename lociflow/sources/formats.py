"""Readers of text formats. Intervals come out 0-based and closed (chrom, s, e), whatever the file holds.

Formats whose rows depend on lines above them (wiggle, ontology stanzas) are read line by line in any number of
splits: `carried` hands the last heading on within each split, and between splits by one row each.
Lines that don't parse give nulls in the columns concerned. gzip files are read whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BED = "chrom start end name score strand thick_start thick_end rgb block_count block_sizes block_starts".split()
PSL = "matches mismatches rep_matches ns q_gaps q_gap_bases t_gaps t_gap_bases strand q_name q_size q_start q_end t_name t_size t_start t_end block_count block_sizes q_starts t_starts".split()
GAF = "db object_id symbol qualifier go_id reference evidence with_from aspect name synonym type taxon date assigned_by".split()
LOCI = "src_id el_type species chrom start end len rel_species features".split()


def number(c: Column, kind: str = "bigint") -> Column:
    return c.try_cast(kind)


def numbers(c: Column) -> Column:
    """Whole numbers of a list with commas, one after the last too."""
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: number(x))


def lines(spark: SparkSession, path: str, skip: str | None = r"^(#|track\b|browser\b|\s*$)") -> DataFrame:
    """(value) of every line that the pattern does not match."""
    t = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"))
    return t.filter(~F.col("value").rlike(skip)) if skip else t


def fields(t: DataFrame, names: list[str], sep: str = "\t") -> DataFrame:
    """The first fields of each line by name; null past the line's end."""
    parts = F.split("value", sep)
    return t.select(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """3 to 12 columns; blocks as an array of closed (s, e)."""
    t = fields(lines(spark, path), BED)
    start = number(F.col("start"))
    block = F.zip_with(numbers(F.col("block_starts")), numbers(F.col("block_sizes")), lambda o, n: F.struct((start + o).alias("s"), (start + o + n - 1).alias("e")))
    return t.select(
        "chrom", start.alias("s"), (number(F.col("end")) - 1).alias("e"), "name", number(F.col("score"), "double").alias("score"), "strand",
        number(F.col("thick_start")).alias("thick_s"), (number(F.col("thick_end")) - 1).alias("thick_e"), "rgb", block.alias("blocks"),
    )


def features(spark: SparkSession, path: str, pairs: Column) -> DataFrame:
    t = fields(lines(spark, path), "chrom source type start end score strand phase attributes".split())
    return t.select("chrom", "source", "type", (number(F.col("start")) - 1).alias("s"), (number(F.col("end")) - 1).alias("e"), number(F.col("score"), "double").alias("score"), "strand", number(F.col("phase"), "int").alias("phase"), pairs.alias("attributes"))


def entries(pattern: str) -> Column:
    """Map of key and value, the pattern's two groups; of a repeated key the first holds."""
    keys, values = (F.regexp_extract_all("attributes", F.lit(pattern), F.lit(i)) for i in (1, 2))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.map_from_entries(first)


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """attributes is a map of `key=value;` pairs."""
    return features(spark, path, entries(r"\s*([^=;]+)=([^;]*)"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """attributes is a map of `key "value";` pairs."""
    return features(spark, path, entries(r'([^\s;"]+)\s+"([^"]*)"'))


def records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(value, file, block, at) of what begins with the mark at a line's start; block and at give the order in a file."""
    t = spark.read.option("lineSep", "\n" + mark).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return t.withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n\z", ""))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, descriptor, seq) in the file's case; a record is one row."""
    t = records(spark, path, ">").withColumn("value", F.regexp_replace("value", r"\A>", "")).filter("value != ''")
    descriptor = F.substring_index("value", "\n", 1)
    return t.select(F.regexp_extract(descriptor, r"^\s*(\S*)", 1).alias("name"), descriptor.alias("descriptor"), F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)"), r"\s", "").alias("seq"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, descriptor, seq, quality) of records of four lines.

    A quality line that itself starts with @ is cut off its record; such halves follow each other and are joined
    again, within each split first, then the one that is left at each side of a split. A name's own leading @ falls."""
    t = records(spark, path, "@").withColumn("n", F.size(F.split("value", "\n"))).withColumn("value", F.when(F.col("n") > 1, F.regexp_replace("value", r"\A@", "")).otherwise(F.col("value")))
    t = t.filter("value != '' OR n = 1")
    halves = t.filter("n IN (1, 3)")
    for keys in (["file", "block"], ["file"]):
        w = Window.partitionBy(*keys).orderBy("block", "at")
        halves = halves.withColumn("after", F.lead(F.struct("n", "value")).over(w)).withColumn("before", F.lag("n").over(w))
        joined = halves.filter("n = 3 AND after.n = 1").select(F.concat("value", F.lit("\n@"), "after.value").alias("value"))
        whole = t.filter("n = 4").select("value").union(joined) if keys[1:] else whole.union(joined)
        halves = halves.filter("NOT coalesce(n = 3 AND after.n = 1, false) AND NOT coalesce(n = 1 AND before = 3, false)").drop("after", "before")
    p = F.split("value", "\n")
    return whole.select(F.regexp_extract(p[0], r"^(\S*)", 1).alias("name"), p[0].alias("descriptor"), p[1].alias("seq"), p[3].alias("quality"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments; e from the operations that use the reference, tags as a map of name to its typed text."""
    t = lines(spark, path, r"^(@[A-Z]{2}\t|\s*$)")
    f = F.split("value", "\t")
    spans = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: number(x))
    t = t.select(*(f[i].alias(n) for i, n in enumerate("read flag chrom pos mapq cigar mate_chrom mate_pos tlen seq quality".split())), F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"))
    s = number(F.col("pos")) - 1
    flag = number(F.col("flag"), "int")
    return t.select(
        "read", flag.alias("flag"), "chrom", s.alias("s"), (s + F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x) - 1).alias("e"),
        F.when(flag.bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), number(F.col("mapq"), "int").alias("mapq"), "cigar", F.when(F.col("mate_chrom") == "=", F.col("chrom")).otherwise(F.col("mate_chrom")).alias("mate_chrom"),
        (number(F.col("mate_pos")) - 1).alias("mate_s"), number(F.col("tlen")).alias("tlen"), "seq", "quality",
        F.map_from_entries(F.transform("tags", lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 4, 1 << 30)))).alias("tags"),
    )


def psl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 21 fields; the query and target ranges closed."""
    t = fields(lines(spark, path, r"^(psLayout|match\b|\s|-+$|$)"), PSL)
    words = {"strand", "q_name", "t_name", "block_sizes", "q_starts", "t_starts"}
    t = t.select(*(F.col(n) if n in words else number(F.col(n)).alias(n) for n in PSL))
    ends = {n: F.col(n) - 1 for n in ("q_end", "t_end")}
    return t.withColumns(ends | {n: numbers(F.col(n)) for n in ("block_sizes", "q_starts", "t_starts")})


def loci_csv(spark: SparkSession, path: str) -> DataFrame:
    """Elements of 7 fields or more, quoted or not; a first row of headings falls out, as its start is no number."""
    t = spark.read.schema(", ".join(f"{n} string" for n in LOCI)).option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    whole = ("src_id", "start", "end", "len", "features")
    t = t.select(*(number(F.col(n)).alias(n) if n in whole else F.col(n) for n in LOCI)).filter("start IS NOT NULL")
    return t.withColumnsRenamed({"start": "s", "end": "e"})


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """Associations of genes and terms; comments start with an exclamation mark."""
    return fields(lines(spark, path, r"^(!|\s*$)"), GAF)


def carried(spark: SparkSession, path: str, heading: Column) -> DataFrame:
    """(value, file, block, at, head): each line with the last line at or above it for which heading (of value) holds."""
    t = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    t = t.withColumn("mark", F.when(heading, F.struct("at", "value")))
    last = t.groupBy("file", "block").agg(F.max("mark").alias("mark"))
    over = lambda *k: Window.partitionBy(*k[:-1]).orderBy(k[-1])
    last = last.select("file", "block", F.last("mark", True).over(over("file", "block").rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    t = t.withColumn("head", F.last("mark", True).over(over("file", "block", "at").rowsBetween(Window.unboundedPreceding, 0)))
    return t.join(last, ["file", "block"]).select("value", "file", "block", "at", F.coalesce("head", "above").alias("head"))


def wig(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e, value) of variableStep lines; positions are 1-based in the file."""
    heading = F.col("value").startswith("variableStep")
    t = carried(spark, path, heading).filter(F.col("head").isNotNull() & F.col("value").rlike(r"^\d"))
    at = lambda key: F.regexp_extract("head.value", rf"\b{key}=(\S+)", 1)
    p = F.split("value", r"\s+")
    s = number(p[0]) - 1
    return t.select(at("chrom").alias("chrom"), s.alias("s"), (s + F.coalesce(number(at("span")), F.lit(1)) - 1).alias("e"), number(F.get(p, F.lit(1)), "double").alias("value"))


def obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, is_a) of each term; is_a sorted."""
    t = carried(spark, path, F.col("value").rlike(r"^\[")).filter("head.value = '[Term]'")
    key, value = F.substring_index("value", ":", 1), F.regexp_extract("value", r"^[^:]*:\s*(.*)$", 1)
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("of"))).alias(k)
    t = t.select("file", "head.at", key.alias("key"), value.alias("of")).groupBy("file", "at").agg(
        one("id"), one("name"), one("namespace"), F.array_sort(F.collect_list(F.when(F.col("key") == "is_a", F.regexp_extract("of", r"^(\S+)", 1)))).alias("is_a")
    )
    return t.drop("file", "at").filter("id IS NOT NULL")
