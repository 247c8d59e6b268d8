"""Column functions on bases: variant classes, 2-bit codes, permutations, the stream cipher.

All run inside the JVM. Bases are numbered in the order A, T, G, C.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the order in which bases are numbered and counted.
BASES = "ATGC"


def base_code(base: Column) -> Column:
    """0 to 3; null for anything that isn't one of the four bases."""
    at = F.call_function("instr", F.lit(BASES), base)
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def _joined(alleles: Column) -> Column:
    # One text to match instead of a loop over elements; a null is no base either.
    return F.array_join(alleles, ",", "?")


def is_snv(alleles: Column) -> Column:
    """Two or more alleles, each a single base."""
    return _joined(alleles).rlike("^[ATGC](,[ATGC])+$")


def is_indel(alleles: Column) -> Column:
    """Only bases in all alleles, and some allele of two bases or more."""
    return _joined(alleles).rlike("^(?=.*[ATGC]{2})[ATGC,]*$")


def shares_first_base(alleles: Column) -> Column:
    """Every allele begins with the base that the first one begins with."""
    return _joined(alleles).rlike(r"^([ATGC])[ATGC]*(,\1[ATGC]*)*$")


def swap_permutation(*pairs: tuple[Column, Column]) -> Column:
    """The four bases with each pair exchanged, as a string in the order of ``BASES``.

    Pairs must not overlap; a pair of equal bases changes nothing."""
    there = F.concat(*[x for a, b in pairs for x in (a, b)])
    back = F.concat(*[x for a, b in pairs for x in (b, a)])
    return F.call_function("translate", F.lit(BASES), there, back)


def permute_base(base: Column, permutation: Column) -> Column:
    """What a permutation string makes of a base; other letters stay."""
    return F.call_function("translate", base, F.lit(BASES), permutation)


def permutation_code(permutation: Column) -> Column:
    """The permutation as one byte, the first base's image in the lowest two bits."""
    codes = [base_code(F.substring(permutation, k + 1, 1)) for k in range(4)]
    return (codes[0] + codes[1] * 4 + codes[2] * 16 + codes[3] * 64).cast("int")


def code_permutation(code: Column) -> Column:
    """The permutation string of a byte of ``permutation_code``."""
    letters = F.array(*[F.lit(b) for b in BASES])
    return F.concat(*[F.element_at(letters, (F.shiftright(code, 2 * k).bitwiseAND(3) + 1).cast("int")) for k in range(4)])


def pack_bases(seq: Column) -> Column:
    """Two bits a base, first base in the highest bits, the last byte filled with zeros.

    Null if another letter occurs."""
    digits = F.translate(seq, BASES, "0123")
    padded = F.call_function("rpad", digits, ((F.length(seq) + 3) / 4).cast("int") * 4, F.lit("0"))
    pairs = F.regexp_extract_all(padded, F.lit("(..)"), F.lit(1))
    packed = F.unhex(F.array_join(F.transform(pairs, lambda p: F.conv(p, 4, 16)), ""))
    return F.when(seq.rlike(f"^[{BASES}]*$"), packed)


def unpack_bases(packed: Column, n_bases: Column) -> Column:
    """The bases of ``pack_bases``; null if there are fewer than ``n_bases``."""
    hexes = F.regexp_extract_all(F.hex(packed), F.lit("(.)"), F.lit(1))
    digits = F.array_join(F.transform(hexes, lambda h: F.lpad(F.conv(h, 16, 4), 2, "0")), "")
    return F.when(F.length(digits) >= n_bases, F.translate(F.call_function("left", digits, n_bases), "0123", BASES))


def stream_cipher(seq: Column, key: Column) -> Column:
    """XORs each base's code with two bits of the key, highest first; the key repeats.

    N passes but uses up its bits; applying the cipher twice gives the text again.
    Letters other than the bases and N raise; null in gives null out.
    """
    digits = F.hex(key)

    def turn(base: Column, at: Column) -> Column:
        nibble = F.conv(F.call_function("substring", digits, F.lit(1) + F.pmod((at / 2).cast("int"), F.length(digits)), F.lit(1)), 16, 10).cast("int")
        bits = F.when(at % 2 == 0, F.shiftright(nibble, 2)).otherwise(nibble.bitwiseAND(3))
        code = F.call_function("instr", F.lit(BASES), base) - 1
        return F.when(base == "N", base).when(code >= 0, F.element_at(F.array(*[F.lit(b) for b in BASES]), code.bitwiseXOR(bits) + 1)).otherwise(F.raise_error(F.concat(F.lit("not a base: "), base)))

    turned = F.array_join(F.transform(F.regexp_extract_all(seq, F.lit("(?s)(.)"), F.lit(1)), turn), "")
    return F.when(F.length(seq) > 0, turned).otherwise(seq)


def read_key(secret: Column, name: Column) -> Column:
    """64 bytes that belong to one read: SHA-512 over secret and read name."""
    return F.unhex(F.sha2(F.concat(secret, name.cast("binary")), 512))
