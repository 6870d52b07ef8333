"""Sequence functions on columns; each stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Case is kept; anything but ACGTU stays as it is."""
    return F.translate(F.reverse(seq), "ACGTUacgtu", "TGCAAtgcaa")


def opposite(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def gc_percent(seq: Column) -> Column:
    """Share of G and C among A, C, G, T and U; null if there are none."""
    n = lambda of: F.length(F.regexp_replace(seq, f"[^{of}]", ""))
    return F.try_divide(100.0 * n("GCgc"), n("ACGTUacgtu"))


def complexity_class(seq: Column, percent: int) -> Column:
    """0 if a base is unknown, else 3 less the number of bases rarer than percent of the length."""
    n = F.length(seq)
    rare = sum(((n - F.length(F.translate(F.upper(seq), b, ""))) < F.floor(n * percent / 100)).cast("int") for b in "ACGT")
    return F.when(F.upper(seq).rlike("[^ACGT]"), 0).otherwise(3 - rare)


def without_isoform(name: Column) -> Column:
    """The name without a suffix of a dot and one or two digits."""
    return F.regexp_replace(name, r"\.\d{1,2}$", "")


def one_blank(value: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+", " ")


def without_quotes(value: Column) -> Column:
    """Without quotes around it, then without white space around that."""
    return F.regexp_replace(F.regexp_replace(value, "^[\"']+|[\"']+$", ""), r"^\s+|\s+$", "")


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement: one key for both strands."""
    return F.least(seq, reverse_complement(seq))


def sub_sequences(seq: Column, size: int, step: int) -> Column:
    """(at, seq) of windows of the size at every step, from position 0; the last may be short, none is empty.

    Put together from pieces of `step` characters, so that work grows with the length.
    """
    pieces = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    joined = lambda i: F.left(F.array_join(F.slice(pieces, i + 1, F.lit(-(-size // step))), ""), F.lit(size))
    return F.transform(pieces, lambda _, i: F.struct((i * step).alias("at"), joined(i).alias("seq")))


#: Codes of the bases, of unknown ones and of gaps; the bit that marks a soft-masked (lower-case) base.
CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3, "N": 4, "-": 6}
MASKED = 8


def base_codes(seq: Column) -> Column:
    """Codes of a sequence's bases; any other letter is unknown, lower case sets the mask bit."""

    def code(c):
        upper = F.upper(c)
        plain = F.coalesce(*[F.when(upper == b, k) for b, k in CODES.items()], F.lit(CODES["N"]))
        return plain.bitwiseOR(F.when(c != upper, MASKED).otherwise(0)).cast("int")

    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), code)


def base_letter(code: Column) -> Column:
    """The letter of a code, in lower case if it is masked; null for a code that stands for none."""
    plain = code.bitwiseAND(7)
    letter = F.coalesce(*[F.when(plain == k, b) for b, k in CODES.items() if b != "U"])
    return F.when(code.bitwiseAND(MASKED) > 0, F.lower(letter)).otherwise(letter)


def letters(codes: Column) -> Column:
    return F.array_join(F.transform(codes, base_letter), "")


def packed(seq: Column) -> Column:
    """Two bases a byte, the first in the high half; an odd last byte ends in a gap code. As hexadecimal digits."""
    digits = F.array_join(F.transform(base_codes(seq), lambda c: F.lower(F.hex(c))), "")
    return F.concat(digits, F.when(F.length(digits) % 2 == 1, "f").otherwise(""))


def unpacked(digits: Column) -> Column:
    """The sequence of packed bases."""
    each = F.filter(F.split(digits, ""), lambda c: (c != "") & (c != "f"))
    return letters(F.transform(each, lambda c: F.conv(c, 16, 10).cast("int")))


def shuffled(seq: Column, seed: int) -> Column:
    """The characters in random order, the same for the same text and seed: each goes by a hash of its place."""
    each = F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c, i: F.struct(F.xxhash64(seq, F.lit(seed), i).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["c"]), "")


def shuffled_within(seq: Column, seed: int, width: int) -> Column:
    """As shuffled, but each character stays in its window of `width`."""
    each = F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c, i: F.struct(F.floor(i / width).alias("w"), F.xxhash64(seq, F.lit(seed), i).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["c"]), "")


#: Seed, factor, shift and result for 0 of the name hashes by their number of bits.
NAME_HASHES = {16: (19937, 3119, 13, 19937), 24: (37199, 19937, 21, 1)}


def name_hash(name: Column, bits: int) -> Column:
    """A hash of a name of ASCII letters, whatever their case, with 16 or 24 bits; 0 for an empty name or none."""
    seed, factor, shift, least = NAME_HASHES[bits]
    mask = (1 << bits) - 1

    def step(h, c):
        wide = h.bitwiseXOR(F.ascii(c).cast("bigint")) * factor
        signed = (wide + (1 << 31)).bitwiseAND(0xFFFFFFFF) - (1 << 31)  # as 32 bits
        return signed.bitwiseXOR(F.shiftright(signed, shift)).bitwiseAND(mask)

    h = F.aggregate(F.filter(F.split(F.lower(name), ""), lambda c: c != ""), F.lit(seed).cast("bigint"), step)
    return F.when(F.length(name) > 0, F.when(h == 0, least).otherwise(h)).otherwise(0).cast("int")


def clean_text(value: Column) -> Column:
    """Control characters, percent signs and quotes as blanks."""
    return F.regexp_replace(value, r"[\x00-\x1f%'\"]", " ")


def bare_words(value: Column) -> Column:
    """Without any quotes, runs of blanks as one, none at the ends."""
    return one_blank(F.regexp_replace(value, "[\"']", ""))


def path_parts(path: Column) -> Column:
    """(dir, name) of a path; the directory ends in a slash, or is empty."""
    return F.struct(F.regexp_extract(path, r"^(.*/)?([^/]*)$", 1).alias("dir"), F.regexp_extract(path, r"^(.*/)?([^/]*)$", 2).alias("name"))


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with a suffix before its extension, or at the end where it has none."""
    return F.regexp_replace(path, r"^((?:.*/)?[^/]*?)(\.[^./]*)?$", "$1" + suffix.replace("$", r"\$") + "$2")


#: Escapes of ontology texts.
ESCAPES = {"n": "\n", "W": " ", "t": "\t", ":": ":", ",": ",", '"': '"', "\\": "\\", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}"}


def unescaped(value: Column) -> Column:
    """A text of an ontology file with its escapes resolved; others stay as they are."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)(\\.|[^\\]+|\\$)"), F.lit(1))

    def one(x):
        second = F.substring(x, 2, 1)
        known = F.coalesce(*[F.when(second == k, v) for k, v in ESCAPES.items()], x)
        return F.when(F.substring(x, 1, 1) == "\\", known).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


#: Bits of evidence codes.
EVIDENCE = {"IMP": 1, "IGI": 2, "IPI": 4, "ISS": 8, "IDA": 16, "IEP": 32, "IEA": 64, "TAS": 128, "NAS": 256, "ND": 512, "IC": 1024, "RC": 2048}


def evidence_bit(code: Column) -> Column:
    """The bit of an evidence code; 0 for any other."""
    return F.coalesce(*[F.when(F.upper(F.trim(code)) == c, b) for c, b in EVIDENCE.items()], F.lit(0))


def name_list(value: Column) -> Column:
    """The names of a list set apart by commas, semicolons or white space, each once, in order."""
    return F.array_distinct(F.filter(F.split(value, r"[,;\s]+"), lambda x: x != ""))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def substitutions(a: Column, b: Column) -> Column:
    """How many places two sequences of one length differ in; null for different lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))
