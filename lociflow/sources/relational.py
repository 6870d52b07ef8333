"""Results as related tables: SNPs and markers, differential expression, alignments, records of runs.

Each function gives a dict of tables by name, with whole numbers as keys, in the order of what identifies a row.
Table and column names are fixed by what other programs read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a key from 1 in the order of columns that identify its rows, which are sorted in ranges, not in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    d = written(d.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("_part").agg((F.max("_at") + 1).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")  # a row for each partition
    out = d.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1)
    return out.select(name, *df.columns)


def keys_of(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Every distinct row of the columns with its key."""
    return numbered(df.select(*columns).distinct(), columns, name)


def with_key(df: DataFrame, table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with the key that a table has for its columns; null where it has none."""
    t = table.select(F.col(name), *[F.col(c).alias(f"_{c}") for c in columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return df.join(t, same, "left").drop(*[f"_{c}" for c in columns])


def by_name(table: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose name is this one, whatever the case."""
    return table.filter(F.lower(column) == name.lower())


def _one(spark: SparkSession, **values) -> DataFrame:
    kinds = {str: "string", int: "int"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def snp_tables(sites: DataFrame, experiment: str, cultivar: str, file: str = "", description: str = "") -> dict[str, DataFrame]:
    """Tables of SNP calls (species, chrom, s, ref, a, c, g, t, n, bases, mismatches) and, of rows with marker and score, of markers."""
    spark = sites.sparkSession
    marked = "marker" in sites.columns
    expr = _one(spark, ExprID=1, ExprType=0 if marked else 1, ExprInFile=file, ExprName=experiment, ExprDescr=description, CultName=cultivar)
    cult = keys_of(sites.select(F.col("species").alias("CultName")).union(expr.select("CultName")), ["CultName"], "CultID")
    seqs = keys_of(sites.select(F.lit(1).alias("ExprID"), F.col("chrom").alias("SeqName")), ["ExprID", "SeqName"], "SeqID")
    d = with_key(sites.withColumns({"SeqName": F.col("chrom"), "CultName": F.col("species")}), seqs, ["SeqName"], "SeqID")
    d = with_key(d, cult, ["CultName"], "CultID").withColumns({"ExprID": F.lit(1), "Offset": F.col("s"), "Base": F.col("ref")})
    loci = keys_of(d, ["ExprID", "SeqID", "Offset", "Base"], "LociID")
    d = with_key(d, loci, ["SeqID", "Offset", "Base"], "LociID")
    counts = {"Acnt": "a", "Ccnt": "c", "Gcnt": "g", "Tcnt": "t", "Ncnt": "n", "TotCovCnt": "bases", "TotMMCnt": "mismatches"}
    snps = numbered(d.groupBy("ExprID", "CultID", "LociID").agg(*[F.sum(v).alias(k) for k, v in counts.items()]), ["ExprID", "CultID", "LociID"], "SnpID")
    out = {"TblExprs": expr, "TblCults": cult, "TblSeqs": seqs, "TblLoci": loci, "TblSnps": snps}
    if marked:
        m = d.filter("marker IS NOT NULL").groupBy("ExprID", "CultID", "LociID", F.col("marker").alias("MarkerBase")).agg(F.max("score").alias("Score"))
        markers = numbered(m.withColumnRenamed("MarkerBase", "Base"), ["ExprID", "CultID", "LociID", "Base"], "MarkerID")
        pairs = snps.select("SnpID", "LociID").join(markers.select("MarkerID", "LociID"), "LociID").select("SnpID", "MarkerID")
        out |= {"TblMarkers": markers, "TblMarkerSnps": numbered(pairs, ["SnpID", "MarkerID"], "MarkerSnpsID")}
    return out


def expression_tables(transcripts: DataFrame, bins: DataFrame, experiment: str, n_bins: int, file: str = "", description: str = "", control: str = "", treated: str = "") -> dict[str, DataFrame]:
    """Tables of differential expression: transcripts (TransName, Exons, TransLen, TransAnnotation and results) and bins (TransName, NthBin, CtrlCounts, ExprCounts)."""
    spark = transcripts.sparkSession
    expr = _one(spark, ExprID=1, ExprType=2, ExprInFile=file, ExprName=experiment, ExprDescr=description, CtrlConditions=control, ExprConditions=treated, NumBins=n_bins)
    t = transcripts.withColumn("ExprID", F.lit(1))
    trans = numbered(t.select("ExprID", "TransName", "Exons", "TransLen", "TransAnnotation"), ["TransName"], "TransID")
    d = with_key(t, trans, ["TransName"], "TransID").drop("TransName", "Exons", "TransLen", "TransAnnotation")
    expres = numbered(d.select("ExprID", "TransID", *[c for c in d.columns if c not in ("ExprID", "TransID")]), ["TransID"], "ExpresID")
    b = with_key(with_key(bins, trans, ["TransName"], "TransID"), expres, ["TransID"], "ExpresID").withColumn("ExprID", F.lit(1))
    b = numbered(b.select("ExprID", "TransID", "ExpresID", "NthBin", "CtrlCounts", "ExprCounts"), ["TransID", "NthBin"], "BinID")
    return {"TblExprs": expr, "TblTrans": trans, "TblExpres": expres, "TblBins": b}


def alignment_tables(psl: DataFrame, experiment: str, file: str = "", description: str = "N/A") -> dict[str, DataFrame]:
    """Tables of alignments as formats.psl reads them: one row each, their blocks, and how many each sequence has."""
    expr = _one(psl.sparkSession, ExprID=1, ExprName=experiment, PSLFile=file, ExprDescr=description)
    cells = {
        "Matches": "matches", "Mismatches": "mismatches", "RepMatches": "rep_matches", "NCount": "ns", "QNumInDels": "q_gaps", "QBasesInDels": "q_gap_bases", "TNumInDels": "t_gaps", "TBasesInDels": "t_gap_bases", "Strand": "strand", "QName": "q_name",
        "QSize": "q_size", "QStart": "q_start", "QEnd": "q_end", "TName": "t_name", "TSize": "t_size", "TStart": "t_start", "TEnd": "t_end", "NumBlocks": "block_count",
    }
    score = F.col("matches") + F.floor(F.col("rep_matches") / 2) - F.col("mismatches") - F.col("q_gaps") - F.col("t_gaps")
    same = F.col("matches") + F.col("rep_matches")
    identity = F.coalesce(F.floor(F.try_divide(100 * same, same + F.col("mismatches"))), F.lit(0))
    d = psl.select(F.lit(1).alias("ExprID"), score.alias("Score"), identity.alias("Identity"), *[F.col(v).alias(k) for k, v in cells.items()], "block_sizes", "q_starts", "t_starts")
    d = numbered(d, ["TName", "TStart", "TEnd", "QName", "QStart", "QEnd", "Strand", "block_sizes", "q_starts", "t_starts"], "AlignmentID")
    each = F.inline(F.arrays_zip(F.col("block_sizes").alias("BlockSize"), F.col("q_starts").alias("QStart"), F.col("t_starts").alias("TStart")))
    blocks = numbered(d.select("ExprID", "AlignmentID", each), ["AlignmentID", "TStart", "QStart"], "BlockID")
    seen = d.select(F.lit(1).alias("IsQuery"), F.col("QName").alias("SeqName"), F.col("QSize").alias("SeqLen")).union(d.select(F.lit(0), "TName", "TSize"))
    summary = seen.groupBy(F.lit(1).alias("ExprID"), "IsQuery", "SeqName", "SeqLen").agg(F.count("*").alias("NumAlignments"))
    return {"TblExprs": expr, "TblAlignments": d.drop("block_sizes", "q_starts", "t_starts"), "TblAlignmentBlocks": blocks, "TblAlignSummaries": numbered(summary, ["IsQuery", "SeqName"], "AlignSummaryID")}


#: Kinds of values in records of runs.
KINDS = {"bool": 0, "int32": 1, "uint32": 2, "int64": 3, "uint64": 4, "double": 5, "text": 6}


def run_record(spark: SparkSession, experiment: str, process: str, version: str, start: str, params: list[tuple[str, str, str]], results: list[tuple[str, str, str, str]], points: list[tuple[str, str, str, str, str]] = ()) -> dict[str, DataFrame]:
    """Tables of one open run: params (kind, name, value), results (group, kind, name, value) and points (group, x name, x, y name, y)."""
    frame = lambda rows, schema: spark.createDataFrame([(i + 1, 1, *r) for i, r in enumerate(rows)], schema)
    return {
        "TblExprs": _one(spark, ExprID=1, ExprName=experiment, ExprTitle=experiment, ExprDescr=""), "TblProcess": _one(spark, ProcessID=1, ProcessName=process, ProcessTitle=process, ProcessDescr=""),
        "TblProcessing": spark.createDataFrame([(1, 1, 1, version, start, None, None)], "ProcessingID int, ExprID int, ProcessID int, ProcessVer string, Start string, Finish string, ResultCode int"),
        "TblParams": frame([(KINDS[k], n, v) for k, n, v in params], "ParamID int, ProcessingID int, ParamType int, ParamName string, ParamValue string"),
        "TblResults": frame([(g, KINDS[k], n, v) for g, k, n, v in results], "ResultID int, ProcessingID int, GroupAs string, ResultType int, ResultName string, ResultValue string"),
        "TblXYResults": frame([(g, KINDS["text"], xn, x, KINDS["text"], yn, y) for g, xn, x, yn, y in points], "ResultID int, ProcessingID int, GroupAs string, ResultXType int, ResultXName string, ResultXValue string, ResultYType int, ResultYName string, ResultYValue string"),
    }


def closed(processing: DataFrame, run: int, finish: str, code: int) -> DataFrame:
    """The runs with one of them finished."""
    own = F.col("ProcessingID") == run
    return processing.withColumns({"Finish": F.when(own, finish).otherwise(F.col("Finish")), "ResultCode": F.when(own, code).otherwise(F.col("ResultCode"))})


def stored(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
