"""Writers of text formats from 0-based closed intervals; one file a partition, in the frame's own partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def cell(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def bed(df: DataFrame, path: str) -> None:
    """Six columns; what is missing or null becomes a dot, a score 0."""
    cells = [cell(df, "chrom", "."), F.col("s").cast("string"), (F.col("e") + 1).cast("string"), cell(df, "name", "."), cell(df, "score", "0"), cell(df, "strand", ".")]
    text(df, F.concat_ws("\t", *cells), path)


def fasta(df: DataFrame, path: str, width: int = 70) -> None:
    """name and seq, wrapped at width; an empty sequence is an empty line."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    text(df, F.concat(F.lit(">"), "name", F.lit("\n"), wrapped), path)


def fastq(df: DataFrame, path: str) -> None:
    text(df, F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "quality"), path)


def with_heading(df: DataFrame, line: Column, heading: list[str], path: str) -> None:
    """Lines as text; every file begins with the heading. A frame without rows writes no lines at all."""

    def put(batches):
        first = True
        for pdf in batches:
            if first and len(pdf):
                yield pd.DataFrame({"value": heading})
                first = False
            yield pdf

    df.select(line.alias("value")).mapInPandas(put, "value string").write.mode("errorifexists").text(path)


def bed12(df: DataFrame, path: str, track: str | None = None) -> None:
    """Twelve columns with the blocks of exons; without a coding span (ts, te) the thick part is empty at the start."""
    s, e = F.col("s"), F.col("e") + 1
    coding = F.coalesce(F.col("ts") < F.col("te"), F.lit(False))
    each = lambda f: F.concat(F.array_join(F.transform("exons", lambda x: f(x).cast("string")), ","), F.lit(","))
    cells = [
        cell(df, "chrom", "."), s.cast("string"), e.cast("string"), cell(df, "name", "."), cell(df, "score", "0"), cell(df, "strand", "."), F.when(coding, F.col("ts")).otherwise(s).cast("string"), F.when(coding, F.col("te") + 1).otherwise(s).cast("string"),
        cell(df, "rgb", "0"), F.size("exons").cast("string"), each(lambda x: x["e"] - x["s"] + 1), each(lambda x: x["s"] - s),
    ]
    line = F.concat_ws("\t", *cells)
    with_heading(df, line, [f'track name="{track}"'], path) if track else text(df, line, path)


def gff3(df: DataFrame, path: str) -> None:
    """Nine columns from 1; attributes come from a map."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    cells = [cell(df, "chrom", "."), cell(df, "source", "."), cell(df, "type", "."), (F.col("s") + 1).cast("string"), (F.col("e") + 1).cast("string"), cell(df, "score", "."), cell(df, "strand", "."), cell(df, "phase", "."), F.coalesce(pairs, F.lit("."))]
    with_heading(df, F.concat_ws("\t", *cells), ["##gff-version 3"], path)


def loci_csv(df: DataFrame, path: str) -> None:
    """Elements of seven fields, texts in quotes."""
    quoted = lambda n: F.concat(F.lit('"'), cell(df, n, ""), F.lit('"'))
    cells = [cell(df, "src_id", "0"), quoted("el_type"), quoted("species"), quoted("chrom"), F.col("s").cast("string"), F.col("e").cast("string"), (F.col("e") - F.col("s") + 1).cast("string")]
    text(df, F.concat_ws(",", *cells), path)


def bedgraph(df: DataFrame, path: str) -> None:
    text(df, F.concat_ws("\t", "chrom", F.col("s").cast("string"), (F.col("e") + 1).cast("string"), F.col("value").cast("string")), path)


def wig(df: DataFrame, path: str) -> None:
    """variableStep spans from 1; each row has its own heading, so files can be split anywhere."""
    heading = F.concat(F.lit("variableStep chrom="), "chrom", F.lit(" span="), (F.col("e") - F.col("s") + 1).cast("string"))
    text(df, F.concat(heading, F.lit("\n"), (F.col("s") + 1).cast("string"), F.lit(" "), F.col("value").cast("string")), path)


def sam(df: DataFrame, path: str, chroms: dict[str, int]) -> None:
    """Eleven fields and tags, after a heading with the chromosomes' lengths. Columns as the reader's."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat(F.lit("\t"), x["key"], F.lit(":"), x["value"])), "") if "tags" in df.columns else F.lit("")
    place = lambda n: F.coalesce(F.col(n) + 1, F.lit(0)).cast("string")
    cells = [cell(df, "read", "*"), cell(df, "flag", "0"), cell(df, "chrom", "*"), place("s"), cell(df, "mapq", "255"), cell(df, "cigar", "*"), cell(df, "mate_chrom", "*"), place("mate_s"), cell(df, "tlen", "0"), cell(df, "seq", "*"), cell(df, "quality", "*")]
    with_heading(df, F.concat(F.concat_ws("\t", *cells), F.coalesce(tags, F.lit(""))), ["@HD\tVN:1.6\tSO:unknown", *[f"@SQ\tSN:{n}\tLN:{k}" for n, k in chroms.items()]], path)


def psl(df: DataFrame, path: str) -> None:
    """21 columns, ranges half-open; columns as the reader's."""
    from .formats import PSL

    lists = {"block_sizes", "q_starts", "t_starts"}
    one = lambda n: F.concat(F.array_join(F.transform(n, lambda x: x.cast("string")), ","), F.lit(",")) if n in lists else (F.col(n) + 1).cast("string") if n in ("q_end", "t_end") else F.col(n).cast("string")
    text(df, F.concat_ws("\t", *[F.coalesce(one(n), F.lit("")) for n in PSL]), path)


def maf(df: DataFrame, path: str) -> None:
    """Alignment blocks from rows (block, score, src, s, size, strand, src_size, seq); a block's rows are one record."""
    row = F.concat_ws(" ", F.lit("s"), "src", F.col("s").cast("string"), F.col("size").cast("string"), "strand", F.col("src_size").cast("string"), "seq")
    blocks = df.groupBy("block").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("src", "s", row.alias("row")))).alias("rows"))
    head = F.concat(F.lit("a"), F.coalesce(F.concat(F.lit(" score="), F.col("score").cast("string")), F.lit("")))
    lines = F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("\n"))
    with_heading(blocks, lines, ["##maf version=1"], path)


def vcf(df: DataFrame, path: str, samples: list[str] = ()) -> None:
    """Variants of version 4.1 from 1: chrom, s, name, ref, alt, quality, filter, info; genotypes are columns with the samples' names."""
    cells = [cell(df, "chrom", "."), (F.col("s") + 1).cast("string"), cell(df, "name", "."), cell(df, "ref", "N"), cell(df, "alt", "."), cell(df, "quality", "."), cell(df, "filter", "PASS"), cell(df, "info", ".")]
    cells += [F.lit("GT"), *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("./.")) for n in samples]] if samples else []
    columns = "#CHROM POS ID REF ALT QUAL FILTER INFO".split() + (["FORMAT", *samples] if samples else [])
    with_heading(df, F.concat_ws("\t", *cells), ["##fileformat=VCFv4.1", "\t".join(columns)], path)


def pg_snp(df: DataFrame, path: str) -> None:
    """Alleles of sites: chrom, s, e, alleles set apart by slashes, how many there are, and their counts. df: chrom, s and counts a, c, g, t."""
    seen = F.filter(F.array(*[F.struct(F.lit(b.upper()).alias("b"), F.col(b).alias("n")) for b in "acgt"]), lambda x: x["n"] > 0)
    join = lambda f, sep: F.array_join(F.transform(seen, f), sep)
    zeros = F.array_join(F.transform(seen, lambda x: F.lit("0")), ",")
    cells = ["chrom", F.col("s").cast("string"), (F.col("s") + 1).cast("string"), join(lambda x: x["b"], "/"), F.size(seen).cast("string"), join(lambda x: x["n"].cast("string"), ","), zeros]
    text(df, F.concat_ws("\t", *cells), path)


def count_matrix(df: DataFrame, rows: str, columns: str, value: str, names: list[str], path: str) -> None:
    """A wide table with tabs of the sums of value: rows by columns, whose names are given; only rows that have all of them."""
    wide = df.groupBy(rows).pivot(columns, names).agg(F.sum(value))
    for n in names:
        wide = wide.filter(F.col(f"`{n}`").isNotNull())
    with_heading(wide, F.concat_ws("\t", F.col(rows).cast("string"), *[F.col(f"`{n}`").cast("string") for n in names]), ["\t".join([rows, *names])], path)


def _escaped(c: Column) -> Column:
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def xml_entries(df: DataFrame, path: str, tag: str) -> None:
    """One element a row, columns as attributes."""
    pairs = [F.concat(F.lit(f' {n}="'), _escaped(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))), F.lit('"')) for n in df.columns]
    text(df, F.concat(F.lit(f"<{tag}"), *pairs, F.lit("/>")), path)


def _graph(spark, parts: list[tuple[DataFrame, Column]], before: list[str], between: list[str], after: list[str], path: str) -> None:
    """Nodes, then edges, in one ordered text of as many files as there are ranges: order is that of the file names."""
    rows = [spark.createDataFrame([(k, i, x) for k, some in ((0, before), (2, between), (4, after)) for i, x in enumerate(some)], "part int, at long, value string")]
    rows += [df.select(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("at"), line.alias("value")) for k, (df, line) in zip((1, 3), parts, strict=True)]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(n, "part", "at").sortWithinPartitions("part", "at").select("value").write.mode("errorifexists").text(path)


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A directed graph: nodes (node), edges (a, b, size)."""
    q = lambda c: _escaped(F.col(c).cast("string"))
    node = F.concat(F.lit('  <node id="'), q("node"), F.lit('"/>'))
    edge = F.concat(F.lit('  <edge source="'), q("a"), F.lit('" target="'), q("b"), F.lit('"><data key="size">'), q("size"), F.lit("</data></edge>"))
    before = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', ' <key id="size" for="edge" attr.name="size" attr.type="double"/>', ' <graph id="G" edgedefault="directed">']
    _graph(nodes.sparkSession, [(nodes, node), (edges, edge)], before, [], [" </graph>", "</graphml>"], path)


def gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The same graph in GEXF."""
    q = lambda c: _escaped(F.col(c).cast("string"))
    node = F.concat(F.lit('   <node id="'), q("node"), F.lit('" label="'), q("node"), F.lit('"/>'))
    edge = F.concat(F.lit('   <edge source="'), q("a"), F.lit('" target="'), q("b"), F.lit('" weight="'), q("size"), F.lit('"/>'))
    before = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', ' <graph defaultedgetype="directed">', "  <nodes>"]
    _graph(nodes.sparkSession, [(nodes, node), (edges, edge)], before, ["  </nodes>", "  <edges>"], ["  </edges>", " </graph>", "</gexf>"], path)


def phylip(df: DataFrame, path: str) -> None:
    """Aligned sequences (name, seq) of one length: a heading with how many and how long, then a line each. An alignment is few rows, in one file."""
    n, length = df.agg(F.count("*"), F.max(F.char_length("seq"))).first()
    ordered = df.orderBy("name").coalesce(1)
    with_heading(ordered, F.concat(F.rpad("name", 10, " "), F.lit(" "), "seq"), [f"{n} {length or 0}"], path)


def pslx(df: DataFrame, path: str) -> None:
    """As psl, with the blocks' sequences of query and target (q_seqs, t_seqs) as two more columns."""
    from .formats import PSL

    lists = {"block_sizes", "q_starts", "t_starts"}
    one = lambda n: F.concat(F.array_join(F.transform(n, lambda x: x.cast("string")), ","), F.lit(",")) if n in lists else (F.col(n) + 1).cast("string") if n in ("q_end", "t_end") else F.col(n).cast("string")
    seqs = [F.concat(F.array_join(n, ","), F.lit(",")) for n in ("q_seqs", "t_seqs")]
    text(df, F.concat_ws("\t", *[F.coalesce(one(n), F.lit("")) for n in PSL], *seqs), path)
