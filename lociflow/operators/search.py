"""Search of sequences in sequences: k-mer positions, exact and near hits, alignments, overlaps.

Sequences are rows (id, seq). Positions count from 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.sequence import reverse_complement, substitutions
from .tables import PIECE


def kmer_index(seqs: DataFrame, k: int) -> DataFrame:
    """(id, at, kmer): every k-mer and where it stands; sequences are cut into pieces first, as in tables.kmers."""
    size = max(PIECE, k)
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    d = seqs.filter("seq is not null").select("id", pieces.alias("pieces"))
    wide = F.transform("pieces", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("pieces", i + 1), F.lit(k - 1)), F.lit(""))))
    d = d.select("id", F.posexplode(wide).alias("n", "piece")).filter(F.char_length("piece") >= k)
    last = F.least(F.char_length("piece") - k + 1, F.lit(size))
    d = d.select("id", "n", "piece", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    return d.select("id", (F.col("n").cast("bigint") * size + F.col("i") - 1).alias("at"), F.substring(F.col("piece"), F.col("i"), F.lit(k)).alias("kmer"))


def exact_hits(probes: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(id, target, at): every place of each probe of at least k characters in each target."""
    p = probes.filter(F.char_length("seq") >= k).select("id", F.col("seq").alias("probe"), F.left("seq", F.lit(k)).alias("kmer"))
    seeds = kmer_index(targets, k).select(F.col("id").alias("target"), "at", "kmer").join(p, "kmer").drop("kmer")
    t = targets.select(F.col("id").alias("target"), "seq")
    same = F.substring(F.col("seq"), (F.col("at") + 1).cast("int"), F.char_length("probe")) == F.col("probe")
    return seeds.join(t, "target").filter(same).select("id", "target", "at")


def hit_counts(hits: DataFrame) -> DataFrame:
    """(id, n, first, last): how often each probe was found, and its first and last place as (target, at)."""
    place = F.struct("target", "at")
    h = hits.groupBy("id").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    return h.select("id", "n", F.col("a.target").alias("first_target"), F.col("a.at").alias("first_at"), F.col("b.target").alias("last_target"), F.col("b.at").alias("last_at"))


def near_hits(probes: DataFrame, targets: DataFrame, length: int, most: int) -> DataFrame:
    """(id, target, at, subs): places where a probe of `length` characters differs from a target in at most `most`.

    Of most + 1 parts of a probe one at least is there unchanged: parts are looked up as k-mers, hits compared whole.
    """
    edges = [length * i // (most + 1) for i in range(most + 2)]
    p = probes.filter(F.char_length("seq") == length)
    found = None
    for k in sorted({b - a for a, b in zip(edges[:-1], edges[1:], strict=True)}):
        parts = F.array(*[F.struct(F.lit(a).alias("ofs"), F.substring("seq", a + 1, k).alias("kmer")) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a == k])
        seeds = p.select("id", F.col("seq").alias("probe"), F.inline(parts)).join(kmer_index(targets, k).withColumnRenamed("id", "target"), "kmer")
        some = seeds.select("id", "probe", "target", (F.col("at") - F.col("ofs")).alias("at")).filter("at >= 0")
        found = some if found is None else found.unionByName(some)
    t = targets.select(F.col("id").alias("target"), "seq")
    d = found.distinct().join(t, "target").withColumn("subs", substitutions(F.substring(F.col("seq"), (F.col("at") + 1).cast("int"), F.lit(length)), F.col("probe")))
    return d.filter(F.col("subs") <= most).select("id", "target", "at", "subs")


def best_hits(hits: DataFrame, most: int) -> DataFrame:
    """Each probe's `most` hits of fewest substitutions, with how many have as few as the best."""
    w = Window.partitionBy("id").orderBy("subs", "target", "at")
    d = hits.withColumns({"rank": F.row_number().over(w), "_least": F.min("subs").over(Window.partitionBy("id"))})
    d = d.withColumn("as_good", F.sum((F.col("subs") == F.col("_least")).cast("int")).over(Window.partitionBy("id")))
    return d.filter(F.col("rank") <= most).drop("_least")


def unique_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each probe that has only one as good."""
    return best_hits(hits, 1).filter("as_good = 1").select("id", "target", "at", "subs")


def both_strands(probes: DataFrame) -> DataFrame:
    """Probes and their reverse complements: id, strand, seq."""
    plus = probes.select("id", F.lit("+").alias("strand"), "seq")
    return plus.unionByName(probes.select("id", F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))


def contained(texts: DataFrame, probes: DataFrame, k: int, most_broadcast: int = 100_000) -> DataFrame:
    """(id, probe): texts that hold a probe of at least k characters somewhere.

    Probes' leading k-mers meet the texts'; they are broadcast if there are few, else both sides are shuffled.
    """
    p = probes.filter(F.char_length("seq") >= k).select(F.col("id").alias("probe"), F.col("seq").alias("probe_seq"), F.left("seq", F.lit(k)).alias("kmer"))
    keys = p.select("kmer").distinct()
    keys = F.broadcast(keys) if p.limit(most_broadcast + 1).count() <= most_broadcast else keys
    seeds = kmer_index(texts, k).select("id", "kmer").join(keys, "kmer").distinct()
    pairs = seeds.join(p, "kmer").select("id", "probe", "probe_seq")
    return pairs.join(texts.select("id", "seq"), "id").filter(F.contains("seq", "probe_seq")).select("id", "probe").distinct()


def end_overlap(read: Column, adapter: Column, least: int, rate: float) -> Column:
    """Longest overlap of a read's end with an adapter's start of at least `least` bases and at most `rate` substitutions a base; 0 for none."""
    sizes = F.when(F.least(F.char_length(read), F.char_length(adapter)) >= least, F.sequence(F.lit(least), F.least(F.char_length(read), F.char_length(adapter))))
    fits = F.filter(sizes, lambda n: substitutions(F.right(read, n), F.left(adapter, n)) <= F.floor(n * rate))
    return F.coalesce(F.array_max(fits), F.lit(0))


def adapter_overlaps(reads: DataFrame, adapters: list[str], least: int, rate: float) -> DataFrame:
    """reads with overlap: the longest end overlap with any of a short list of adapters."""
    return reads.withColumn("overlap", F.greatest(F.lit(0), *[end_overlap(F.col("seq"), F.lit(a), least, rate) for a in adapters]))


ALIGNMENT = StructType([StructField(n, IntegerType()) for n in ("score", "end_a", "end_b")])


def _scores(a: str, b: str, match: int, mismatch: int, gap: int, local: bool) -> tuple[int, int, int]:
    """Best score and where it ends; rows one by one, gaps along a row by a running maximum."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = gap * np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, np.int64) if local else -steps
    best = (0, 0, 0)
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = 0 if local else -gap * i
        new[1:] = np.maximum(row[:-1] + np.where(y == c, match, -mismatch), row[1:] - gap)
        new = np.maximum.accumulate(new + steps) - steps
        if local:
            new = np.maximum(new, 0)
            j = int(new.argmax())
            if new[j] > best[0]:
                best = (int(new[j]), i, j)
        row = new
    return best if local else (int(row[-1]), len(x), len(y))


def _aligner(local: bool, match: int, mismatch: int, gap: int):
    @F.pandas_udf(ALIGNMENT)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if p is None or q is None else _scores(p, q, match, mismatch, gap, local) for p, q in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=ALIGNMENT.names, dtype="Int32")

    return align


def local_alignment(a: Column, b: Column, match: int = 1, mismatch: int = 1, gap: int = 1) -> Column:
    """(score, end_a, end_b) of the best local alignment; ends count from 1, of equals the first."""
    return _aligner(True, match, mismatch, gap)(a, b)


def global_alignment(a: Column, b: Column, match: int = 1, mismatch: int = 1, gap: int = 1) -> Column:
    """(score, end_a, end_b) of the alignment of both sequences from end to end."""
    return _aligner(False, match, mismatch, gap)(a, b)


def overlap_class(a_from: Column, a_to: Column, a_len: Column, b_from: Column, b_to: Column, b_len: Column, slack: int) -> Column:
    """What an alignment of a's and b's parts (from 0, closed) says: contained, contains, overlapping or artefact, ends within `slack` of the sequences'."""
    a_left, a_right = a_from <= slack, a_len - 1 - a_to <= slack
    b_left, b_right = b_from <= slack, b_len - 1 - b_to <= slack
    return F.when(a_left & a_right, "contained").when(b_left & b_right, "contains").when((a_right & b_left) | (a_left & b_right), "overlapping").otherwise("artefact")


def column_consensus(aligned: DataFrame) -> DataFrame:
    """(grp, at, base, n): the most frequent base of each column of a multiple alignment; of equals the first letter. aligned: grp, at, base."""
    c = aligned.groupBy("grp", "at", "base").agg(F.count("*").alias("n"))
    top = c.groupBy("grp", "at").agg(F.min(F.struct((-F.col("n")).alias("k"), "base")).alias("m"))
    return top.select("grp", "at", F.col("m.base").alias("base"), (-F.col("m.k")).alias("n"))


def end_overlaps(seqs: DataFrame, least: int) -> DataFrame:
    """(a, b, size): sequences of which the end of a, of at least `least` characters, begins b."""
    starts = seqs.filter(F.char_length("seq") >= least).select(F.col("id").alias("b"), F.col("seq").alias("b_seq"), F.left("seq", F.lit(least)).alias("kmer"))
    at = kmer_index(seqs, least).withColumnRenamed("id", "a").join(starts, "kmer").filter("a <> b")
    d = at.join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("a_seq")), "a").withColumn("size", F.char_length("a_seq") - F.col("at"))
    same = (F.col("size") <= F.char_length("b_seq")) & (F.right("a_seq", F.col("size").cast("int")) == F.left("b_seq", F.col("size").cast("int")))
    return d.filter(same).select("a", "b", F.col("size").cast("bigint").alias("size"))


def without_contained(seqs: DataFrame, k: int) -> DataFrame:
    """Sequences that no longer one holds, nor an equal one of smaller id; shorter ones than k stay."""
    held = contained(seqs, seqs, k).filter("id <> probe")
    sizes = seqs.select("id", F.char_length("seq").alias("len"))
    held = held.join(sizes, "id").join(sizes.select(F.col("id").alias("probe"), F.col("len").alias("probe_len")), "probe")
    gone = held.filter("probe_len < len OR (probe_len = len AND id < probe)").select(F.col("probe").alias("id")).distinct()
    return seqs.join(gone, "id", "left_anti")


def reciprocal(hits: DataFrame) -> DataFrame:
    """(a, b) of hits that are there both ways, a before b. hits: a, b."""
    h = hits.select("a", "b").distinct()
    return h.join(h.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).filter("a < b")


def shorter_runs(seq: Column, most: int) -> Column:
    """The sequence with runs of one base longer than `most` cut to it."""
    return F.regexp_replace(seq, rf"(.)\1{{{most},}}", "$1" * most)


def least_substitutions(windows: DataFrame, length: int, most: int, reverse: bool = False) -> DataFrame:
    """(id, at, least): of every window of `length` the fewest substitutions to any other, or any other's reverse complement, as far as `most`; null beyond.

    windows: (id, seq), sequences whose every window counts; equal windows elsewhere count as other ones.
    """
    each = kmer_index(windows, length)
    distinct = each.groupBy("kmer").agg(F.count("*").alias("n"))
    names = distinct.select(F.col("kmer").alias("id"), (reverse_complement(F.col("kmer")) if reverse else F.col("kmer")).alias("seq"))
    targets = distinct.select(F.col("kmer").alias("id"), F.col("kmer").alias("seq"))
    near = near_hits(names, targets, length, most).filter("at = 0")
    near = near if reverse else near.filter("id <> target")
    best = near.groupBy("id").agg(F.min("subs").alias("s"))
    least = distinct.join(best, distinct["kmer"] == best["id"], "left").select("kmer", F.col("s").alias("least") if reverse else F.when(F.col("n") > 1, 0).otherwise(F.col("s")).alias("least"))
    return each.join(least, "kmer").select("id", "at", "least")


def merged_distances(*files: DataFrame) -> DataFrame:
    """(id, at, least) of equally keyed distances: the least of all."""
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out.groupBy("id", "at").agg(F.min("least").alias("least"))


def flanks(sites: DataFrame, seqs: DataFrame, before: int, after: int) -> DataFrame:
    """sites (site, id, at) with flank: the sequence around each place, null where it would run over an end or holds an N."""
    d = sites.join(seqs.select("id", "seq"), "id")
    piece = F.substring(F.col("seq"), (F.col("at") - before + 1).cast("int"), F.lit(before + after + 1))
    ok = (F.col("at") >= before) & (F.col("at") + after < F.char_length("seq")) & ~F.contains(F.upper(piece), F.lit("N"))
    return d.select("site", "id", "at", F.when(ok, piece).alias("flank"))


def seed_hits(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query, target, q_at, t_at): k-mers that a query and a target share."""
    q = kmer_index(queries, k).select(F.col("id").alias("query"), F.col("at").alias("q_at"), "kmer")
    t = kmer_index(targets, k).select(F.col("id").alias("target"), F.col("at").alias("t_at"), "kmer")
    return q.join(t, "kmer").drop("kmer")


def seed_nodes(seeds: DataFrame, k: int, gap: int = 0) -> DataFrame:
    """(query, target, q_s, q_e, t_s, t_e): seeds on one diagonal as one where no more than `gap` characters lie between them."""
    from .intervals import merge_islands

    d = seeds.select("query", "target", (F.col("t_at") - F.col("q_at")).alias("diagonal"), F.col("q_at").alias("s"), (F.col("q_at") + k - 1).alias("e"))
    m = merge_islands(d, ["query", "target", "diagonal"], gap)
    return m.select("query", "target", F.col("s").alias("q_s"), F.col("e").alias("q_e"), (F.col("s") + F.col("diagonal")).alias("t_s"), (F.col("e") + F.col("diagonal")).alias("t_e"))


def best_chains(nodes: DataFrame, gap_cost: float = 0.1) -> DataFrame:
    """(query, target, score, nodes, q_s, q_e, t_s, t_e): the best chain of nodes of each query and target.

    Along a chain nodes follow one another in both sequences; where they overlap, the later one counts from the
    earlier one's end. A chain's score is the nodes' lengths less gap_cost for each diagonal between them. What a task holds are the nodes of one query in one target.
    """
    kinds = dict(nodes.dtypes)

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["q_s", "t_s", "q_e"])[["q_s", "q_e", "t_s", "t_e"]].to_numpy(np.int64)
        size = (v[:, 1] - v[:, 0] + 1).astype(float)
        score, back = size.copy(), np.full(len(v), -1)
        for i in range(1, len(v)):
            shared = np.maximum(0, np.maximum(v[:i, 1] - v[i, 0], v[:i, 3] - v[i, 2]) + 1)
            before = np.flatnonzero((v[:i, 0] < v[i, 0]) & (v[:i, 2] < v[i, 2]) & (shared < size[i]))
            if len(before):
                uneven = np.abs((v[i, 2] - v[i, 0]) - (v[before, 2] - v[before, 0]))
                offer = score[before] - gap_cost * uneven - shared[before]
                best = int(offer.argmax())
                if offer[best] > 0:
                    score[i], back[i] = size[i] + offer[best], before[best]
        end = at = int(score.argmax())
        n = 1
        while back[at] >= 0:
            at, n = back[at], n + 1
        return pd.DataFrame([(*key, float(score[end]), n, v[at, 0], v[end, 1], v[at, 2], v[end, 3])], columns=["query", "target", "score", "nodes", "q_s", "q_e", "t_s", "t_e"])

    return nodes.groupBy("query", "target").applyInPandas(chain, f"query {kinds['query']}, target {kinds['target']}, score double, nodes int, q_s long, q_e long, t_s long, t_e long")


def local_matches(queries: DataFrame, targets: DataFrame, k: int, least: float, most: int) -> DataFrame:
    """Each query's `most` best chains of at least a score, against targets on both strands: column strand."""
    found = None
    for strand, seq in (("+", F.col("seq")), ("-", reverse_complement(F.col("seq")))):
        some = best_chains(seed_nodes(seed_hits(queries.select("id", seq.alias("seq")), targets, k), k)).withColumn("strand", F.lit(strand))
        found = some if found is None else found.unionByName(some)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "target", "strand")
    return found.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def paired_hits(first: DataFrame, second: DataFrame, least: int, most: int) -> DataFrame:
    """(id, target, at, mate_at, insert): hits of both reads of a pair on one target, the second `least` to `most` characters on. Both: id, target, at."""
    from .series import band_pairs

    p = band_pairs(first.select("id", "target", "at"), second.select("id", "target", "at"), ["id", "target"], "at", most)
    return p.filter(F.col("distance").between(least, most)).select("id", "target", "at", F.col("r_at").alias("mate_at"), F.col("distance").alias("insert"))


def unique_flanks(sites: DataFrame, seqs: DataFrame, before: int, after: int) -> DataFrame:
    """flanks of sites that occur once in all sequences."""
    f = flanks(sites, seqs, before, after).filter("flank IS NOT NULL")
    n = exact_hits(f.select(F.col("site").alias("id"), F.col("flank").alias("seq")), seqs, before + after + 1).groupBy("id").agg(F.count("*").alias("n"))
    return f.join(n.filter("n = 1").select(F.col("id").alias("site")), "site", "left_semi")


def split_reads(reads: DataFrame, adapter: str, least: int) -> DataFrame:
    """(id, part, seq): what lies between an adapter's places in each read, on either strand, from `least` characters on."""
    flip = adapter[::-1].translate(str.maketrans("ACGTUacgtu", "TGCAAtgcaa"))
    parts = F.split("seq", f"(?i)(?:{adapter}|{flip})")
    return reads.select("id", F.posexplode(parts).alias("part", "seq")).filter(F.char_length("seq") >= least)
