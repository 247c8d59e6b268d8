"""Column functions on CIGAR strings, short (``2M1I``) and expanded (``MMI``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operations, those that take up read bases, and those that take up reference.
OPERATIONS = "MIDNSHP=X"
ON_READ = "MIS=X"
ON_REFERENCE = "MDN=X"


def lengths(cigar: Column) -> Column:
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MIDNSHP=X]"), F.lit(1)), lambda n: n.cast("int"))


def operations(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit(r"[0-9]+([MIDNSHP=X])"), F.lit(1))


def _length_on(cigar: Column, ops: str) -> Column:
    parts = F.arrays_zip(lengths(cigar).alias("n"), operations(cigar).alias("op"))
    folded = F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.when(p["op"].isin(*ops), p["n"]).otherwise(0))
    # Most reads are one match from end to end.
    return F.when(cigar.rlike("^[0-9]+M$"), F.rtrim(cigar, F.lit("M")).try_cast("int")).otherwise(folded)


def reference_length(cigar: Column) -> Column:
    """Reference bases that an alignment covers; 0 for ``*``."""
    return _length_on(cigar, ON_REFERENCE)


def read_length(cigar: Column) -> Column:
    """Read bases that an alignment uses, clipped ones included; 0 for ``*``."""
    return _length_on(cigar, ON_READ)


def expand(cigar: Column) -> Column:
    """One letter per unit."""
    return F.array_join(F.zip_with(operations(cigar), lengths(cigar), lambda op, n: F.call_function("repeat", op, n)), "")


def shrink(expanded: Column) -> Column:
    """Runs of letters back to counts."""
    runs = F.regexp_extract_all(expanded, F.lit(r"(([MIDNSHP=X])\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")


def aligned_blocks(cigar: Column) -> Column:
    """The matched stretches of an alignment, as structs of four offsets or lengths:
    ``ref`` and ``seq`` (bases before it on reference and read), ``units`` (letters before
    it in the expanded CIGAR) and ``len``."""
    parts = F.arrays_zip(lengths(cigar).alias("n"), operations(cigar).alias("op"))
    none = F.array().cast("array<struct<ref:int,seq:int,units:int,len:int>>")
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("seq"), F.lit(0).alias("units"), none.alias("blocks"))

    def step(acc: Column, p: Column) -> Column:
        matched = p["op"].isin("M", "=", "X")
        block = F.struct(acc["ref"].alias("ref"), acc["seq"].alias("seq"), acc["units"].alias("units"), p["n"].alias("len"))
        return F.struct(
            (acc["ref"] + F.when(p["op"].isin(*ON_REFERENCE), p["n"]).otherwise(0)).alias("ref"),
            (acc["seq"] + F.when(p["op"].isin(*ON_READ), p["n"]).otherwise(0)).alias("seq"),
            (acc["units"] + p["n"]).alias("units"),
            F.when(matched, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["blocks"])


def unit_of_base(expanded: Column, seq_pos: Column) -> Column:
    """0-based letter of the expanded CIGAR that uses read base ``seq_pos``; null if none does."""
    letters = F.regexp_extract_all(expanded, F.lit("(.)"), F.lit(1))
    state = F.struct(F.lit(-1).alias("base"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, op: Column) -> Column:
        base = acc["base"] + op.isin(*ON_READ).cast("int")
        return F.struct(base.alias("base"), (acc["at"] + 1).alias("at"), F.coalesce(acc["found"], F.when(base == seq_pos, acc["at"])).alias("found"))

    return F.aggregate(letters, state, step, lambda acc: acc["found"])


def allele_cigar(allele: Column, reference: Column) -> Column:
    """Expanded CIGAR by which an allele stands against the reference allele."""
    shared, more = F.least(F.length(allele), F.length(reference)), F.length(allele) - F.length(reference)
    return F.concat(F.call_function("repeat", F.lit("M"), shared), F.call_function("repeat", F.when(more > 0, "I").otherwise("D"), F.abs(more)))


def matching_allele(seq: Column, expanded: Column, alleles: Column, reference: Column, seq_pos: Column, unit: Column) -> Column:
    """The allele that a read shows at a place, or null.

    Alleles are tried from the longest (of equal ones the last first). One whose CIGAR
    agrees as far as both go, but runs past the read's end or is continued by the same
    insertion or deletion (after a match, by either), leaves the place undecided."""
    numbered = F.transform(alleles, lambda a, i: F.struct((-F.length(a)).alias("size"), (-i).alias("turn"), a.alias("allele")))
    state = F.struct(F.lit(False).alias("over"), F.lit(None).cast("string").alias("found"))

    def attempt(acc: Column, option: Column) -> Column:
        allele = option["allele"]
        own = allele_cigar(allele, reference)
        rest = F.call_function("substring", expanded, unit + 1)
        shared = F.least(F.length(own), F.length(rest))
        agrees = F.call_function("left", own, shared) == F.call_function("left", rest, shared)
        after = F.call_function("substring", rest, F.length(own) + 1, F.lit(1))
        last = F.call_function("right", own, F.lit(1))
        continued = ((last == "I") & (after == "I")) | ((last == "D") & (after == "D")) | ((last == "M") & after.isin("I", "D"))
        undecided = (F.length(own) > F.length(rest)) | continued
        same = F.call_function("substring", seq, seq_pos + 1, F.length(allele)) == allele
        return (
            F.when(acc["over"] | ~agrees, acc)
            .when(undecided, F.struct(F.lit(True).alias("over"), F.lit(None).cast("string").alias("found")))
            .when(same, F.struct(F.lit(True).alias("over"), allele.alias("found")))
            .otherwise(acc)
        )

    return F.aggregate(F.array_sort(numbered), state, attempt, lambda acc: acc["found"])


def place_allele(cell: Column, seq: Column, expanded: Column, qualities: Column) -> Column:
    """Read, expanded CIGAR and qualities with a cell's allele replaced, as a struct.

    ``cell`` has seq_pos, unit, old, new, ref_allele. A longer allele takes the rounded-up
    mean quality for its extra bases, a shorter one loses the last of the old allele's;
    ``*`` stays. Qualities are Phred+33 text."""
    old_cigar, new_cigar = allele_cigar(cell["old"], cell["ref_allele"]), allele_cigar(cell["new"], cell["ref_allele"])

    def splice(text: Column, at: Column, cut: Column, put: Column) -> Column:
        return F.concat(F.call_function("left", text, at), put, F.call_function("substring", text, at + cut + 1))

    more = F.length(cell["new"]) - F.length(cell["old"])
    scores = F.transform(F.regexp_extract_all(qualities, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c))
    mean = F.ceil(F.aggregate(scores, F.lit(0), lambda a, x: a + x) / F.size(scores)).cast("int")
    end = cell["seq_pos"] + F.length(cell["old"])
    longer = splice(qualities, end, F.lit(0), F.call_function("repeat", F.chr(mean), more))
    shorter = splice(qualities, end + more, -more, F.lit(""))
    return F.struct(
        splice(seq, cell["seq_pos"], F.length(cell["old"]), cell["new"]).alias("seq"),
        splice(expanded, cell["unit"], F.length(old_cigar), new_cigar).alias("expanded"),
        F.when((qualities == "*") | (more == 0), qualities).when(more > 0, longer).otherwise(shorter).alias("qual"),
    )


def op_tuples(cigar: Column) -> Column:
    """(op, len) structs of a short CIGAR, operations by their number in ``OPERATIONS``."""
    return F.zip_with(operations(cigar), lengths(cigar), lambda op, n: F.struct((F.call_function("instr", F.lit(OPERATIONS), op) - 1).alias("op"), n.alias("len")))


def expand_tuples(tuples: Column) -> Column:
    """One letter per unit of (op, len) structs; a number that is no operation raises."""
    letters = F.array(*[F.lit(o) for o in OPERATIONS])
    return F.array_join(F.transform(tuples, lambda t: F.call_function("repeat", F.element_at(letters, t["op"] + 1), t["len"])), "")
