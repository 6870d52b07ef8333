"""Filters of elements, features, alignments and sequences, each rule by itself and all in one with the reason of a reject."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import reverse_complement
from .intervals import depth_segments, overlap_any

#: Names of regions in the order of their bits.
REGION_BITS = {"cds": 0x01, "5utr": 0x02, "3utr": 0x04, "introns": 0x08, "5upstream": 0x10, "3downstream": 0x20, "intergenic": 0x100}


def region_mask(names: str) -> int:
    """The bits of a list of region names with commas; an unknown name is an error."""
    out = 0
    for name in filter(None, (x.strip().lower().removesuffix("s") for x in names.split(","))):
        out |= next((b for k, b in REGION_BITS.items() if k.removesuffix("s") == name), 0) or _unknown(name)
    return out


def _unknown(name: str) -> int:
    raise ValueError(f"no region is called {name!r}")


def any_match(value: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns, whatever the case, is found in the value."""
    hits = [F.coalesce(value.rlike(f"(?i){p}"), F.lit(False)) for p in patterns]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def accepted(value: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Excluding patterns win; where there are including ones, one must be found."""
    return ~any_match(value, exclude) & (any_match(value, include) if include else F.lit(True))


def projection(df: DataFrame, fields: str) -> DataFrame:
    """The columns of a list of numbers from 1 and ranges, as in 1,3-5; each once, in the list's order."""
    out: list[str] = []
    for part in filter(None, (x.strip() for x in fields.split(","))):
        low, _, high = part.partition("-")
        numbers = range(int(low), int(high or low) + 1)
        if not numbers or numbers[0] < 1 or numbers[-1] > len(df.columns):
            raise ValueError(f"no columns {part!r}")
        out += [df.columns[i - 1] for i in numbers if df.columns[i - 1] not in out]
    return df.select(*[F.col(f"`{c}`") for c in out])


@dataclass
class ElementFilter:
    """Rules for elements (src, chrom, s, e and what the rules name); a rule that isn't given holds for all."""

    include_ids: DataFrame | None = None
    exclude_ids: DataFrame | None = None
    least_length: int | None = None
    most_length: int | None = None
    species: list[str] = field(default_factory=list)
    include_chroms: list[str] = field(default_factory=list)
    exclude_chroms: list[str] = field(default_factory=list)
    include_loci: DataFrame | None = None
    exclude_loci: DataFrame | None = None
    regions: int | None = None
    no_regions: int | None = None
    least_identity: float | None = None
    least_aligned: int | None = None
    strand: str | None = None
    least_score: float | None = None
    most_score: float | None = None

    def reasons(self, df: DataFrame) -> DataFrame:
        """df with reason: the first rule that a row fails, null if none."""
        size = F.col("e") - F.col("s") + 1
        rules: list[tuple[str, Column]] = []
        marks: list[str] = []

        def marked(name: str, ids: DataFrame, want: bool) -> None:
            nonlocal df
            mark = f"_{name}"
            df = df.join(ids.select(F.col("src")).distinct().withColumn(mark, F.lit(True)), "src", "left")
            marks.append(mark)
            rules.append((name, F.coalesce(mark, F.lit(False)) == want))

        if self.include_ids is not None:
            marked("include_ids", self.include_ids, True)
        if self.exclude_ids is not None:
            marked("exclude_ids", self.exclude_ids, False)
        if self.least_length is not None:
            rules.append(("short", size >= self.least_length))
        if self.most_length is not None:
            rules.append(("long", size <= self.most_length))
        if self.species:
            rules.append(("species", F.lower("species").isin([x.lower() for x in self.species])))
        if self.include_chroms or self.exclude_chroms:
            rules.append(("chrom", accepted(F.col("chrom").cast("string"), self.include_chroms, self.exclude_chroms)))
        if self.strand not in (None, "*"):
            rules.append(("strand", F.col("strand") == self.strand))
        if self.least_score is not None:
            rules.append(("low_score", F.col("score") >= self.least_score))
        if self.most_score is not None:
            rules.append(("high_score", F.col("score") <= self.most_score))
        if self.include_loci is not None:
            marked("include_loci", overlap_any(df.select("src", "chrom", "s", "e"), self.include_loci), True)
        if self.exclude_loci is not None:
            marked("exclude_loci", overlap_any(df.select("src", "chrom", "s", "e"), self.exclude_loci), False)
        if self.regions is not None:
            rules.append(("regions", F.col("bits").bitwiseAND(self.regions) > 0))
        if self.no_regions is not None:
            rules.append(("no_regions", F.col("bits").bitwiseAND(self.no_regions) == 0))
        if self.least_aligned is not None:
            rules.append(("aligned", F.col("matches") + F.col("mismatches") >= self.least_aligned))
        if self.least_identity is not None:
            rules.append(("identity", 100.0 * F.col("matches") >= self.least_identity * (F.col("matches") + F.col("mismatches"))))
        reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules], F.lit(None).cast("string"))
        return df.withColumn("reason", reason).drop(*marks)

    def kept(self, df: DataFrame) -> DataFrame:
        return self.reasons(df).filter("reason IS NULL").drop("reason")


def alone_or_not(df: DataFrame, keys: list[str], overlapped: bool) -> DataFrame:
    """Rows that share a base with another row of the keys, or those that share none."""
    joined = F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys])
    many = depth_segments(df, keys, {"n": F.lit(True)}).filter("n > 1").select(joined.alias("chrom"), "s", "e")
    named = df.withColumns({"_chrom": F.col("chrom"), "chrom": joined})
    return overlap_any(named, many, anti=not overlapped).withColumn("chrom", F.col("_chrom")).drop("_chrom")


def flagged(features: DataFrame, names: DataFrame, flag: int) -> DataFrame:
    """features with flags: the flag is added to those whose name is listed."""
    now = F.col("flags") if "flags" in features.columns else F.lit(0)
    hit = names.select(F.lower("name").alias("_n")).distinct().withColumn("_hit", F.lit(flag))
    d = features.withColumn("_l", F.lower("name")).join(hit, F.col("_l") == F.col("_n"), "left")
    return d.withColumn("flags", now.bitwiseOR(F.coalesce("_hit", F.lit(0)))).drop("_l", "_n", "_hit")


def by_flags(features: DataFrame, need: int, avoid: int) -> DataFrame:
    """Features with all flags that are needed and none of those to avoid."""
    return features.filter((F.col("flags").bitwiseAND(need) == need) & (F.col("flags").bitwiseAND(avoid) == 0))


def features_of(df: DataFrame, types: list[str], key: str | None = None, pattern: str | None = None) -> DataFrame:
    """Features of some types, and if asked those whose attribute has the pattern."""
    d = df.filter(F.lower("type").isin([t.lower() for t in types])) if types else df
    return d.filter(F.coalesce(F.col("attributes")[key].rlike(pattern), F.lit(False))) if key else d


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def of_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose value begins with the prefix, which is taken off."""
    return df.filter(F.startswith(column, F.lit(prefix))).withColumn(column, F.substring(F.col(column), len(prefix) + 1, 1 << 30))


def unique_names(df: DataFrame, column: str, order: list[str], sep: str = ".") -> DataFrame:
    """df with the second and later rows of one name numbered: name, name.2, name.3."""
    nth = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return df.withColumn("_nth", nth).withColumn(column, F.when(F.col("_nth") > 1, F.concat_ws(sep, column, "_nth")).otherwise(F.col(column))).drop("_nth")


def without_long_unknown(df: DataFrame, most: int) -> DataFrame:
    """Sequences without a run of more than `most` unknown bases."""
    return df.filter(~F.coalesce(F.col("seq").rlike(f"(?i)N{{{most + 1},}}"), F.lit(False)))


def extracted(seqs: DataFrame, include: list[str], start: int = 0, size: int | None = None, flip: bool = False) -> DataFrame:
    """Sequences whose descriptor has one of the patterns; of each the stretch from start, on the other strand if so asked."""
    d = seqs.filter(accepted(F.col("descriptor"), include))
    seq = F.substring(F.col("seq"), start + 1, size if size is not None else 1 << 30)
    return d.withColumn("seq", reverse_complement(seq) if flip else seq)


def named_instance(features: DataFrame, name: str, nth: int) -> DataFrame:
    """The nth feature of a name, whatever the case, by chromosome and start."""
    w = Window.partitionBy(F.lower("name")).orderBy("chrom", "s", "e")
    return features.filter(F.lower("name") == name.lower()).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") == nth)


#: Names that stand for the mitochondrial chromosome.
MITOCHONDRIAL = ["chrm", "chrmt", "mt", "m", "chrmitochondria", "mitochondria"]


def chrom_name(chrom: Column) -> Column:
    """The name in lower case, one name for the mitochondrial chromosome's."""
    low = F.lower(F.trim(chrom))
    return F.when(low.isin(MITOCHONDRIAL), MITOCHONDRIAL[0]).otherwise(low)


def first_on_chrom(loci: DataFrame) -> DataFrame:
    """(chrom, s, e) of the first element of each chromosome."""
    return loci.groupBy("chrom").agg(F.min(F.struct("s", "e")).alias("f")).select("chrom", "f.s", "f.e")


def identity_bands(df: DataFrame, which: str, edges: list[int]) -> DataFrame:
    """(band, n): rows by percent of identity, as the number of edges that it reaches.

    which: "matches" by aligned bases, "length" by the element's length, "core" by the reference's, "all" by the longer.
    """
    size = {"matches": F.col("matches") + F.col("mismatches"), "length": F.col("len"), "core": F.col("e") - F.col("s") + 1, "all": F.greatest(F.col("len"), F.col("e") - F.col("s") + 1)}[which]
    percent = F.try_divide(100.0 * F.col("matches"), size)
    band = sum(((percent >= x).cast("int") for x in edges), F.lit(0))
    return df.groupBy(F.coalesce(band, F.lit(0)).alias("band")).agg(F.count("*").alias("n"))
